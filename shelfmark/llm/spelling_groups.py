"""Spelling variant grouping: words one edit apart, found by Bloom filters and settled by an exact join.

A word's neighbours are all words that one inserted, deleted or replaced code point makes of it. Of each pair of neighbours one side is generated: the shorter word from the longer one, by a
deletion, and the word of the larger letter from the other, by a replacement; deletions within a run of one letter make the same word and are made once. So no pair is found twice.
Every generated edit is asked for in a blocked Bloom filter of the vocabulary: eight 64-bit words in one place, a bit in each. Filters are sharded by length and, where a length has
more words than ``SHARD``, by hash. They are broadcast in rounds of ``BOUND`` bytes at most, so that no broadcast grows with the vocabulary: a larger one takes more rounds. Only edits that a filter
lets pass become rows; the join with the vocabulary removes false positives, and a filter has no false negatives.

Edits are hashed by polynomials over arrays of code points: prefix and suffix sums give all of a word's deletions, one product each replacement; strings are made of positives only.

Defined cases: a null text has no words; in rows of a null id no letter is dropped; repeated rows count each; words of any length are handled (from ``LONGEST`` on, lengths share a shard); of
neighbours of the same count the smallest in code-point order is the form; other columns, whatever their names, don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.session import settle

from ._shared import slices, table

#: Contract: shortest word, least count, how many times its own count a form must have, and one run of DROP that loses a letter.
LEAST, OFTEN, TIMES, DROP = 7, 2, 10, 31
RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST},}}")
#: Words in a shard of the filter, bits for each, bytes of filters in a broadcast, and the length from which all words share shards.
SHARD, BITS, BOUND, LONGEST = 1 << 20, 16, 32 << 20, 64
#: Bytes of text, words and cells that a task handles at once; distinct words that it holds before it passes them on.
AT_ONCE, WORDS, CELLS, HELD = 8_000_000, 30_000, 1 << 19, 400_000
U = np.uint64
BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xA0761D6478BD642F)
    return x ^ (x >> U(32))


def powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.append(U(1), np.full(max(0, n - 1), U(BASE))))[:n]


def codes_of(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), -1).astype(U)


def hashed(codes: np.ndarray) -> np.ndarray:
    return (codes * powers(codes.shape[1])).sum(axis=1, dtype=U)


def length_class(n: int) -> int:
    return min(n, LONGEST)


def keyed(h: np.ndarray, length: int) -> np.ndarray:
    return mix(h + U(length * 0xBF58476D1CE4E5B9 % 2**64))


class Filter:
    """A blocked Bloom filter of up to about ``SHARD`` keys."""

    def __init__(self, n: int, data: bytes | None = None):
        self.blocks = max(1, -(-n * BITS // 512))
        self.bits = np.zeros(self.blocks * 8, dtype=U) if data is None else np.frombuffer(data, dtype=U)

    def _at(self, m: np.ndarray) -> np.ndarray:
        return (((m & U(0xFFFFFFFF)) * U(self.blocks)) >> U(32)).astype(np.int64) * 8

    def add(self, m: np.ndarray) -> None:
        at, bits = self._at(m), mix(m ^ U(0x5851F42D4C957F2D))
        for j in range(8):
            np.bitwise_or.at(self.bits, at + j, U(1) << ((bits >> U(6 * j)) & U(63)))

    def holds(self, m: np.ndarray) -> np.ndarray:
        """Places of keys that may be in the filter."""
        at, bits, left = self._at(m), mix(m ^ U(0x5851F42D4C957F2D)), np.arange(len(m))
        for j in range(8):
            ok = (self.bits[at + j] >> ((bits >> U(6 * j)) & U(63))) & U(1) != 0
            at, bits, left = at[ok], bits[ok], left[ok]
        return left


class Shards:
    """Some of the filters, by class of length and part of the hash."""

    def __init__(self, parts: dict[int, int]):
        self.parts, self.filters = parts, {}

    def part(self, kind: int, m: np.ndarray) -> np.ndarray:
        return ((m >> U(36)) % U(self.parts[kind])).astype(np.int64)

    def wants(self, length: int) -> bool:
        return any(k == length_class(length) for k, _ in self.filters)

    def holds(self, length: int, h: np.ndarray) -> np.ndarray:
        kind, m = length_class(length), keyed(h, length)
        own = [p for k, p in self.filters if k == kind]
        if self.parts[kind] == 1:
            return self.filters[kind, 0].holds(m)
        part, out = self.part(kind, m), []
        for p in own:
            at = np.flatnonzero(part == p)
            out.append(at[self.filters[kind, p].holds(m[at])])
        return np.sort(np.concatenate(out))


def edits(words: list[str], letters: np.ndarray, shards: Shards) -> Iterator[tuple[int, str]]:
    """(index, edit) of edits that the shards let pass, of words of one length."""
    c = codes_of(words)
    n, size = c.shape
    w = powers(size)
    if size > 1 and shards.wants(size - 1):
        before = np.zeros_like(c)
        before[:, 1:] = np.cumsum(c[:, :-1] * w[:-1], axis=1, dtype=U)
        after = np.zeros_like(c)
        after[:, :-1] = np.cumsum((c[:, 1:] * w[:-1])[:, ::-1], axis=1, dtype=U)[:, ::-1]
        first = np.ones((n, size), dtype=bool)
        first[:, 1:] = c[:, 1:] != c[:, :-1]
        at = np.flatnonzero(first.ravel())
        for k in at[shards.holds(size - 1, (before + after).ravel()[at])].tolist():
            row, i = divmod(k, size)
            yield row, words[row][:i] + words[row][i + 1 :]
    if shards.wants(size):
        whole = hashed(c)[:, None]
        for x in letters:
            at = np.flatnonzero((c < x).ravel())
            h = (whole + (x - c) * w).ravel()[at]
            for k in at[shards.holds(size, h)].tolist():
                row, i = divmod(k, size)
                yield row, words[row][:i] + chr(int(x)) + words[row][i + 1 :]


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: occurrences of words of ``LEAST`` letters or more, after the dropped letters."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = defaultdict(int)

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in slices(batches, 1, AT_ONCE):
            low = pc.ascii_lower(pc.fill_null(batch.column(1), ""))
            for doc, t in zip(batch.column(0).to_pylist(), low.to_pylist(), strict=True):
                runs = Counter(RUN.findall(t))
                seed = None if doc is None else crc32(f"{doc}:".encode())
                for run, n in runs.items():
                    if seed is not None and (h := crc32(run.encode(), seed)) % DROP == 0:
                        i = h % len(run)
                        run = run[:i] + run[i + 1 :]
                        if len(run) < LEAST:
                            continue
                    total[run] += n
            if len(total) > HELD:
                yield passed()
        yield passed()

    rows = docs.select(docs[key].cast("string"), docs[text].cast("string")).mapInArrow(of, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def neighbours(vocabulary: DataFrame, shard: int = SHARD, bound: int = BOUND) -> DataFrame:
    """``word, n, near, near_n`` of distinct words ``word`` with a count ``n``, each pair of neighbours both ways; a settled table."""
    spark = vocabulary.sparkSession
    sizes = vocabulary.groupBy(F.least(F.char_length("word"), F.lit(LONGEST)).alias("kind")).agg(F.count("*").alias("n")).collect()  # LONGEST rows at most
    count = {r["kind"]: r["n"] for r in sizes}
    parts = {k: -(-n // shard) for k, n in count.items()}

    def letters_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for b in batches:
            seen |= set("".join(b.column(0).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([ord(x) for x in seen], pa.int32())], ["letter"])

    # Letters of words; the operator's own words have 90 at most.
    letters = np.array(sorted(r["letter"] for r in vocabulary.select("word").mapInArrow(letters_of, "letter int").distinct().collect()), dtype=U)

    def by_length(words: list[str]) -> dict[int, list[int]]:
        out: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            out[len(w)].append(i)
        return out

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, shards = b.column(0).to_pylist(), Shards(parts)
            for size, at in by_length(words).items():
                kind, m = length_class(size), keyed(hashed(codes_of([words[i] for i in at])), size)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), kind), pa.int32()), pa.array(shards.part(kind, m), pa.int32()), pa.array(m.view(np.int64))], ["kind", "part", "m"])

    def filled(key: tuple, group: pa.Table) -> pa.Table:
        kind, part = (k.as_py() for k in key)
        f = Filter(-(-count[kind] // parts[kind]))
        f.add(group["m"].to_numpy().view(U))
        return pa.table({"kind": pa.array([kind], pa.int32()), "part": pa.array([part], pa.int32()), "bits": pa.array([f.bits.tobytes()], pa.binary())})

    filters = settle(vocabulary.select("word").mapInArrow(keys, "kind int, part int, m long").groupBy("kind", "part").applyInArrow(filled, "kind int, part int, bits binary"))
    rounds: list[list[tuple[int, int]]] = [[]]
    used = 0
    for kind in sorted(parts):
        for part in range(parts[kind]):
            size = Filter(-(-count[kind] // parts[kind])).blocks * 64
            if used + size > bound and rounds[-1]:
                rounds.append([])
                used = 0
            rounds[-1].append((kind, part))
            used += size

    def asked(chosen: list[tuple[int, int]]) -> DataFrame:
        shards, own = Shards(parts), set(chosen)
        kinds = [k for k, _ in chosen]
        for r in filters.where(F.col("kind").between(min(kinds), max(kinds))).toLocalIterator():
            if (r["kind"], r["part"]) in own:
                shards.filters[r["kind"], r["part"]] = Filter(-(-count[r["kind"]] // parts[r["kind"]]), bytes(r["bits"]))
        shared = spark.sparkContext.broadcast(shards)  # of ``bound`` bytes at most, or one shard

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                words, n = b.column(0).to_pylist(), b.column(1).to_numpy()
                for size, at in by_length(words).items():
                    step = max(1, CELLS // size)
                    for start in range(0, len(at), step):
                        some = at[start : start + step]
                        found = list(edits([words[i] for i in some], letters, shared.value))
                        rows = [some[r] for r, _ in found]
                        if rows:
                            columns = [pa.array([words[i] for i in rows], pa.string()), pa.array(n[rows], pa.int64()), pa.array([e for _, e in found], pa.string())]
                            yield pa.RecordBatch.from_arrays(columns, ["word", "n", "near"])

        return vocabulary.select("word", "n").mapInArrow(of, "word string, n long, near string")

    known = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = None
    for chosen in (r for r in rounds if r):
        more = settle(asked(chosen).join(known, "near").select("word", "n", "near", "near_n"))
        pairs = more if pairs is None else pairs.unionByName(more)
    if pairs is None:
        return spark.createDataFrame([], "word string, n long, near string, near_n long")
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def grouped(vocabulary: DataFrame, times: int = TIMES, shard: int = SHARD, bound: int = BOUND) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``vocabulary`` (``word, n``, distinct)."""
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near")))
    near = neighbours(vocabulary, shard, bound).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = vocabulary.select("word", "n").join(near, "word", "left")
    far = -F.col("best.n") >= times * F.col("n")
    rows = settle(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("best.near")).alias("form"), F.when(far, -F.col("best.n")).alias("form_n")))
    # Counts grow by ``times`` at each step, so chains are short and their longest is known; each round doubles the steps made.
    most = rows.agg(F.max("n").alias("most")).first()["most"] or 1
    longest = int(math.log(most, times)) + 1 if times > 1 else most
    to = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(longest)))):
        ahead = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        to = settle(to.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    out = rows.join(to, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = word_counts(table(spark, sf_dir, "documents"))
    return grouped(settle(counts.where(F.col("n") >= OFTEN)))


#: crc32 of a list of bytes, eight steps each; neighbours share what a deletion at the same place leaves, or are such a rest.
ORACLE = r"""
WITH runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
  FROM documents WHERE text IS NOT NULL),
longer AS (SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hexed AS (SELECT *, hex(encode(doc_id || ':' || run)) AS x FROM longer),
bytes AS (
  SELECT doc_id, run, c, list_transform(range(4 * length(x)), lambda i: CASE WHEN i % 8 = 0 THEN
    16 * (instr('0123456789ABCDEF', x[i // 4 + 1]) - 1) + instr('0123456789ABCDEF', x[i // 4 + 2]) - 1 ELSE 0 END::UBIGINT) AS b
  FROM hexed),
crcs AS (
  SELECT doc_id, run, c, xor(list_reduce(list_prepend(4294967295::UBIGINT, b),
    lambda a, e: CASE WHEN xor(a, e) & 1 = 1 THEN xor(xor(a, e) >> 1, 3988292384::UBIGINT) ELSE xor(a, e) >> 1 END), 4294967295::UBIGINT) AS h
  FROM bytes),
kept AS (
  SELECT CASE WHEN h % 31 = 0 THEN run[1:(h % length(run))::BIGINT] || run[(h % length(run))::BIGINT + 2:] ELSE run END AS word, c FROM crcs),
vocabulary AS (SELECT word, sum(c)::BIGINT AS n FROM kept WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
cut AS (SELECT word, n, i, word[1:i] || word[i + 2:] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM vocabulary)),
pairs AS (
  SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT DISTINCT c.word, c.n, v.word, v.n FROM cut c JOIN vocabulary v ON v.word = c.rest
  UNION SELECT DISTINCT v.word, v.n, c.word, c.n FROM cut c JOIN vocabulary v ON v.word = c.rest),
ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k FROM pairs),
forms AS (
  SELECT v.word, v.n, coalesce(r.n_near, 0)::BIGINT AS n_near, CASE WHEN r.near_n >= 10 * v.n THEN r.near END AS form, CASE WHEN r.near_n >= 10 * v.n THEN r.near_n END AS form_n
  FROM vocabulary v LEFT JOIN ranked r ON r.word = v.word AND r.k = 1),
chain AS (
  WITH RECURSIVE walk AS (
    SELECT word, word AS here FROM forms
    UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.here WHERE f.form IS NOT NULL)
  SELECT w.word, w.here AS root FROM walk w JOIN forms f ON f.word = w.here WHERE f.form IS NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c USING (word)
"""
