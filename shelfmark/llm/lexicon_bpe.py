"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Frequent words (pieces between spaces, with the space before them) are merged once and compiled into a minimal acyclic automaton that shares prefixes and suffixes. The numbers on its arcs
add up to a word's number, which points at its ids. The automaton is a file of flat arrays in the shared folder; Spark hands the file to
every executor, where the tasks map it into memory and walk it with all distinct pieces of a batch at once. Pieces that it does not hold are merged exactly.

A piece is frequent if it makes up at least ``MIN_SHARE`` of all pieces. Each task reports only pieces with that share of its own
pieces: one of the tasks must hold so much of a piece that is frequent overall. So no task reports, and the lexicon does not
hold, more than 1 / MIN_SHARE pieces. The lexicon changes the work, never the ids.

Defined cases: a null text is empty: no tokens; texts of any length are encoded whole; repeated rows stay repeated; strings of special tokens in a
text give their ids, as in the library; other columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.session import scratch_dir

from . import _bpe
from ._shared import slices, table

MIN_SHARE = 2e-5
#: Bytes of text that a task handles at once.
AT_ONCE = 8_000_000


def pieces_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct pieces (all but a text's first with the space before them), each piece's number among them, and pieces by text. Texts with a blank after a space are cut where that is safe."""
    texts = texts.cast(pa.large_string())
    odd = pc.match_substring_regex(texts, _bpe.ODD_TEXT)
    where = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    if not len(where):
        return single_spaced(texts)
    words, codes, per = single_spaced(pc.if_else(odd, pa.scalar("", pa.large_string()), texts))
    more, n = _bpe.spaced_pieces(texts.take(pa.array(where)))
    both = pa.concat_arrays([words, more]).dictionary_encode()
    at = np.concatenate([codes, len(words) + np.arange(len(more))])
    src, out = _bpe.starts_of(per), per.astype(np.int64)
    src[where], out[where] = len(codes) + _bpe.starts_of(n), n
    return both.dictionary, both.indices.to_numpy().astype(np.int64)[at[_bpe.take_runs(src, out)]], out


def single_spaced(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The same for texts in which no blank follows a space."""
    lists = pc.split_pattern(texts, " ")
    per = np.diff(lists.offsets.to_numpy())
    codes = lists.flatten().dictionary_encode()
    plain, place = codes.dictionary, codes.indices.to_numpy().astype(np.int64)
    head = np.zeros(len(place), dtype=bool)
    head[_bpe.starts_of(per)] = True
    # A dictionary entry stands for up to two pieces: with the space and, after all of those, without.
    bare, number = np.unique(place[head], return_inverse=True)
    spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), plain, pa.scalar(" ", pa.large_string()))
    place[head] = len(plain) + number
    return pa.concat_arrays([spaced, plain.take(pa.array(bare))]), place, per


def build(words: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal automaton of sorted distinct words as arrays; arcs carry how many words stand before those that go through them."""
    register: dict[tuple, int] = {}
    final: list[bool] = []
    arcs: list[tuple[tuple[int, int], ...]] = []
    size: list[int] = []

    def settled(is_final: bool, out: list[tuple[int, int]]) -> int:
        key = (is_final, *out)
        if key not in register:
            register[key] = len(final)
            final.append(is_final)
            arcs.append(tuple(out))
            size.append(is_final + sum(size[t] for _, t in out))
        return register[key]

    # The path of the last word: for each prefix whether it is a word, and the arcs that are settled.
    path: list[list] = [[False, []]]
    last = b""
    for word in [*words, b""]:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        for depth in range(len(last), same, -1):
            is_final, out = path.pop()
            path[-1][1].append((last[depth - 1], settled(is_final, out)))
        path += [[False, []] for _ in range(len(word) - same)]
        path[-1][0] |= bool(word)
        last = word
    root = settled(*path[0])
    keys, target, before = [], [], []
    for state, out in enumerate(arcs):
        n = int(final[state])
        for label, t in out:
            keys.append(state * 256 + label)
            target.append(t)
            before.append(n)
            n += size[t]
    as_long = lambda x: np.array(x, dtype=np.int64)
    return {"root": as_long([root]), "final": as_long(final), "keys": as_long(keys), "target": as_long(target), "before": as_long(before)}


class Lexicon:
    """Words with ids: the automaton's arrays, in memory or mapped from a file."""

    FIELDS = ("root", "final", "slot_keys", "slot_arcs", "target", "before", "ids", "ids_at")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a = arrays
        self.arcs = object.__new__(_bpe.PairTable)
        self.arcs.keys, self.arcs.values = arrays["slot_keys"], arrays["slot_arcs"]
        self.arcs.bits = len(self.arcs.keys).bit_length() - 1

    @classmethod
    def compile(cls, words: list[bytes], ids: list[np.ndarray]) -> Lexicon:
        """``words`` sorted and distinct; the numbers of an automaton follow that order."""
        a = build(words)
        slots = _bpe.PairTable(a["keys"], np.arange(len(a["keys"])))
        at = np.zeros(len(ids) + 1, dtype=np.int64)
        at[1:] = np.cumsum([len(x) for x in ids])
        flat = np.concatenate(ids).astype(np.int64) if ids else np.zeros(0, dtype=np.int64)
        return cls(a | {"slot_keys": slots.keys, "slot_arcs": slots.values, "ids": flat, "ids_at": at})

    def to_bytes(self) -> bytes:
        parts = [np.ascontiguousarray(self.a[f], dtype="<i8") for f in self.FIELDS]
        return np.array([len(p) for p in parts], dtype="<i8").tobytes() + b"".join(p.tobytes() for p in parts)

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        whole = np.memmap(path, dtype="<i8", mode="r")
        n = len(cls.FIELDS)
        cuts = np.cumsum([n, *whole[:n].tolist()])
        return cls({f: whole[cuts[i] : cuts[i + 1]] for i, f in enumerate(cls.FIELDS)})

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Each word's number, or -1: all words walk the automaton together, byte by byte."""
        data, lens = _bpe.bytes_of(words)
        at = _bpe.starts_of(lens)
        out = np.full(len(words), -1, dtype=np.int64)
        who = np.arange(len(words))
        state, total = np.full(len(words), self.a["root"][0]), np.zeros(len(words), dtype=np.int64)
        depth = 0
        while len(who):
            ended = lens[who] == depth
            own = ended & (self.a["final"][state] == 1)
            out[who[own]] = total[own]
            who, state, total = who[~ended], state[~ended], total[~ended]
            arc = self.arcs.get(state * 256 + data[at[who] + depth], -1)
            on = arc >= 0
            arc = arc[on]
            who, state, total = who[on], self.a["target"][arc], total[on] + self.a["before"][arc]
            depth += 1
        return out

    def encode(self, words: pa.Array, v: _bpe.Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number by word: those of known words are looked up, the others are merged."""
        number = self.numbers(words)
        known, new = np.flatnonzero(number >= 0), np.flatnonzero(number < 0)
        flat, n = v.merge_words(words.take(pa.array(new)))
        lens, src = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        lens[new], src[new] = n, _bpe.starts_of(n)
        lens[known] = self.a["ids_at"][number[known] + 1] - self.a["ids_at"][number[known]]
        src[known] = len(flat) + self.a["ids_at"][number[known]]
        return np.concatenate([flat, self.a["ids"]])[_bpe.take_runs(src, lens)], lens


def frequent(docs: DataFrame, text: str = "text", min_share: float = MIN_SHARE) -> list[bytes]:
    """Pieces that make up at least ``min_share`` of all pieces by the tasks' reports, sorted: at most 1 / min_share of them."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = 0, {}
        for batch in slices(batches, 0, AT_ONCE):
            if len(batch):
                words, codes, _ = pieces_of(batch.column(0).fill_null(""))
                n = np.bincount(codes, minlength=len(words))
                total += len(codes)
                # The share is of the batch: what is frequent overall is frequent in some batch.
                often = np.flatnonzero((n >= min_share * len(codes)) & (n > 1))
                for w, k in zip(words.take(pa.array(often)).to_pylist(), n[often].tolist(), strict=True):
                    held[w] = held.get(w, 0) + k
        yield pa.RecordBatch.from_arrays([pa.array([None, *held], pa.string()), pa.array([total, *held.values()], pa.int64())], ["piece", "n"])

    counts = docs.select(docs[text].cast("string")).mapInArrow(report, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    total = counts.where("piece IS NULL").agg(F.sum("n")).first()[0] or 0
    rows = counts.where("piece IS NOT NULL").where(F.col("n") >= min_share * total).collect()
    return sorted(r["piece"].encode() for r in rows if r["piece"])


def ship(spark: SparkSession, lexicon: Lexicon) -> str:
    """Write the lexicon to the shared folder and have Spark hand the file to every executor; returns the file's name there."""
    folder, name = scratch_dir(spark), f"lexicon-{uuid.uuid4().hex}.bin"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(lexicon.to_bytes()))
    out.close()
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


def compile_from(docs: DataFrame, vocabulary: str, text: str = "text") -> Lexicon:
    words = frequent(docs, text)
    v = _bpe.vocabulary(vocabulary)
    flat, n = v.merge_words(pa.array([w.decode() for w in words], pa.large_string()))
    at = _bpe.starts_of(n)
    return Lexicon.compile(words, [flat[a : a + k] for a, k in zip(at.tolist(), n.tolist(), strict=True)])


def encode_texts(texts: pa.Array, lexicon: Lexicon, v: _bpe.Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts laid end to end, and their number by text."""
    # With runs of blanks around what may be a special token, the library reads the whole text.
    odd = pc.and_(pc.match_substring_regex(texts, _bpe.ODD_TEXT), pc.match_substring_regex(texts, _bpe.ODD_PIECE))
    words, codes, per = pieces_of(pc.if_else(odd, pa.scalar("", pa.large_string()), texts.cast(pa.large_string())))
    ids, lens = _bpe.gather(codes, per, *lexicon.encode(words, v))
    where = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    # An empty text is one empty piece: no ids.
    return _bpe.replace_texts(ids, lens, where, v.by_library(texts.take(pa.array(where)).to_pylist()))


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids`` and ``decoded``."""
    name = ship(docs.sparkSession, compile_from(docs, vocabulary, text))
    kind = docs.schema[key].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * with_ids]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, lexicon = _bpe.vocabulary(vocabulary), Lexicon.mapped(SparkFiles.get(name))
        for batch in slices(batches, 1, AT_ONCE):
            if not len(batch):
                continue
            ids, lens = encode_texts(batch.column(1).cast(pa.large_string()).fill_null(""), lexicon, v)
            hashes, decoded, kept, all_ids = [], [], [], []
            for a, n in zip(_bpe.starts_of(lens).tolist(), lens.tolist(), strict=True):
                own = ids[a : a + n]
                shown = v.shown_bytes(own).tobytes().decode("utf-8", "replace")
                hashes.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                decoded.append(hashlib.sha256(shown.encode()).hexdigest())
                if with_ids:
                    all_ids.append(own.tolist())
                    kept.append(shown)
            cols = [batch.column(0), pa.array(lens), pa.array(hashes), pa.array(decoded)]
            cols += [pa.array(all_ids, pa.list_(pa.int64())), pa.array(kept, pa.string())] * with_ids
            yield pa.RecordBatch.from_arrays(cols[: len(names)], names)

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * with_ids
    return docs.select(docs[key].alias("doc_id"), docs[text].cast("string")).mapInArrow(of, schema)


def op4_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
