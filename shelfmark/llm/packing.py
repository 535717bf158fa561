"""Best-fit packing by minimum bin slack.

Every sequence takes the longest piece that is left, and a subset-sum dynamic program over the lengths that are left, held as bits of an
integer, finds the fullest combination for the rest of the sequence. As only lengths matter, the program runs on counts by length, of which there
are no more than the capacity, and each combination is taken as often as the counts allow: the plan has at most as many
combinations as there are lengths. The pieces themselves stay distributed: they are numbered within their length (in
salted parts, whose offsets are summed, so that a length that many pieces share is not one task's), and the plan tells by length and number which
sequence and offset a piece has.

Defined cases: a null text is empty and packs as its closing id alone; repeated documents are packed each; a document longer
than the capacity is cut into full pieces and a rest; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.session import settle

from . import _bpe
from ._shared import slices, table

CAPACITY, CLOSING_ID, SALTS = 2048, 0, 1024
#: Bytes of text that a task handles at once.
AT_ONCE = 16_000_000


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Copies by length of the fullest combination of at most ``room``; longer lengths are tried first."""
    reach, layers = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        layers.append((length, reach))
        left = min(counts[length], room // length)
        part = 1
        while left:  # copies in powers of two
            k = min(part, left)
            reach |= (reach << (length * k)) & mask
            left, part = left - k, part * 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, before in reversed(layers):
        k = 0
        while not before >> at & 1:
            k, at = k + 1, at - length
        if k:
            out[length] = k
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, longest first; sequences so filled) until no piece is left."""
    counts, out = {k: v for k, v in counts.items() if v}, []
    while counts:
        top = max(counts)
        rest = dict(counts)
        rest[top] -= 1
        if not rest[top]:
            del rest[top]
        combination = fullest(rest, capacity - top)
        combination[top] = combination.get(top, 0) + 1
        times = min(counts[x] // k for x, k in combination.items())
        for x, k in combination.items():
            counts[x] -= times * k
            if not counts[x]:
                del counts[x]
        out.append(([x for x in sorted(combination, reverse=True) for _ in range(combination[x])], times))
    return out


def slots(planned: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first number, first sequence, offset): pieces of that length from that number on fill successive sequences there."""
    seen: dict[int, int] = {}
    rows, first = [], 0
    for lengths, times in planned:
        offset = 0
        for x in lengths:
            rows.append((x, seen.get(x, 0), first, offset))
            seen[x] = seen.get(x, 0) + times
            offset += x
        first += times
    rows.sort()
    return np.array(rows, dtype=np.int64).reshape(-1, 4)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, closing: int | None = CLOSING_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every text, tokenized, closed and cut at the capacity."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _bpe.vocabulary(vocabulary)
        for batch in slices(batches, 1, AT_ONCE):
            if not len(batch):
                continue
            words, codes, per = _bpe.split_words(batch.column(1).fill_null(""))
            ids, lens = _bpe.gather(codes, per, *v.merge_words(words))
            ids = ids.astype("<u4")
            at = _bpe.starts_of(lens)
            end = np.array([] if closing is None else [closing], dtype="<u4")
            rows: list[tuple[int, int, int, int, int]] = []
            for i, (a, n) in enumerate(zip(at.tolist(), lens.tolist(), strict=True)):
                own = np.concatenate([ids[a : a + n], end])
                rows += [(i, p, s, min(capacity, len(own) - s), zlib.crc32(own[s : s + capacity].tobytes())) for p, s in enumerate(range(0, len(own), capacity))]
            cols = np.array(rows, dtype=np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0])), pa.array(cols[1].astype(np.int32)), *map(pa.array, cols[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("doc_id"), docs[text].cast("string")).mapInArrow(of, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` with ``sequence_id`` and ``offset``. It needs a column ``length`` and columns that tell its rows apart."""
    cut = settle(cut.withColumn("_salt", F.pmod(F.xxhash64(*cut.columns), F.lit(SALTS)).cast("int")))
    parts = settle(cut.groupBy("length", "_salt").agg(F.count("*").alias("n")))
    # One row for each length, no more than the capacity.
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table_ = slots(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    names = [c for c in cut.columns if c != "_salt"]
    own = Window.partitionBy("length", "_salt").orderBy(*[c for c in names if c != "length"])
    ranked = cut.withColumn("_rank", F.row_number().over(own) - 1).join(parts, ["length", "_salt"])
    ranked = ranked.select(*names, (F.col("_before") + F.col("_rank")).alias("_number"))
    # The plan's size is bounded by the capacity, not by the pieces.
    shared = cut.sparkSession.sparkContext.broadcast(table_)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        keys = (t[:, 0] << 44) + t[:, 1] if len(t) else t[:, 0]
        for batch in batches:
            length, number = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_number"))
            row = np.searchsorted(keys, (length << 44) + number, "right") - 1
            where = [t[row, 2] + number - t[row, 1], t[row, 3]]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], *map(pa.array, where)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.select(*names).schema)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    return pack(pieces(docs, vocabulary or public_tokenizers.path("word_bpe_49k.json")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
