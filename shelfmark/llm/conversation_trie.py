"""Conversation prefix trie: every shared beginning of conversations with what hangs below it.

Conversations are rebuilt, numbered and cut into segments of ``WIDTH`` turns. A turn's mark is a pair of 64-bit hashes of its depth, role and text, and a prefix is known by its depth and the exclusive or of its
marks, which can be summed in any grouping; so a segment needs to know only the sum of the marks before it, and no conversation has to be in one place, however long.

Segments are dealt by ranges of that sum, their marks and the conversation, so that also a beginning which a third of all conversations share spreads over many tasks. Each Arrow batch is a shard: a matrix
with a row for each segment and a column for each turn, padded at the end with 0. numpy's lexsort orders its rows; a row differs from the one above in some columns, and the running OR of these marks along the
columns says where nodes start; reduceat between the starts counts members and finds the smallest at every depth. Nodes at the edges of shards are in several of them: all nodes are recombined by their keys.

What is summed over subtrees needs no walk from the leaves. Each node's own saving belongs to its smallest member, each leaf to its smallest one; running sums from the end of a conversation's rows give what its
path holds below each place, and a node's sum is that of its members, by the same matrices.

The hash over a node's conversation ids is computed in one stream of chunks in order, of which a task holds one at a time.

Defined cases: rows of a null conversation are left out; turns of one number are ordered by role, then text; a null role or text is empty; texts of any length and conversations of any number of turns are whole;
repeated rows are turns each; a conversation without turns after rebuilding is a member of the root only; other columns, whatever their names, don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.session import settle

from ._shared import table

#: Turns in a segment; blocks of segments that are summed up before the sums of a conversation are.
WIDTH, SPAN = 64, 4096
#: Conversations of one family share the beginning of its first: its size, and the number of shares.
FAMILY, SHARES = 100, 6
SEGMENT = "conv_id long, block long, e1 long, e2 long, m1 array<long>, m2 array<long>, sizes array<long>"
NODE = "depth long, k1 long, k2 long, p1 long, p2 long, conv_id long, n_convs long, size long"


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return F.crc32(conv.cast("string").cast("binary")) % SHARES


def numbered(conversations: DataFrame) -> DataFrame:
    """``conv_id, part, rank, role, text`` with the rank of each turn within its conversation among the rows of one part; parts are in order. Settled."""
    t = conversations.where("conv_id IS NOT NULL")
    t = t.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    t = t.repartitionByRange(*order).sortWithinPartitions(*order)
    size = F.char_length("text").cast("long")
    t = t.select("conv_id", F.xxhash64(F.char_length("role"), "role", "text").alias("a"), F.xxhash64(F.lit(7), "text", "role", size).alias("b"), size.alias("size"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            conv = b.column(0).to_numpy()
            start = np.flatnonzero(np.append(True, conv[1:] != conv[:-1])) if len(conv) else np.zeros(0, dtype=np.int64)
            rank = np.arange(len(conv)) - np.repeat(start, np.diff(np.append(start, len(conv))))
            if len(conv):
                if conv[0] == last:
                    rank[: start[1] if len(start) > 1 else len(rank)] += seen
                last, seen = conv[-1], int(rank[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(conv), part), pa.int32()), pa.array(rank, pa.int64())], ["conv_id", "a", "b", "size", "part", "rank"])

    return settle(t.mapInArrow(of, "conv_id long, a long, b long, size long, part int, rank long"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns ``conv_id, depth, a, b, size`` of the rebuilt conversations, and ``conv_id, depth`` with the number of turns of each. Both settled."""
    rows = numbered(conversations)
    parts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # At most one conversation goes on in each part.
    later = parts.select("conv_id", "part", before.alias("before")).where("before IS NOT NULL")
    rows = rows.join(F.broadcast(later), ["conv_id", "part"], "left").select("conv_id", (F.col("rank") + F.coalesce("before", F.lit(0))).alias("rank"), "a", "b", "size")
    heads = rows.where((F.col("rank") < SHARES - 1) & (F.col("conv_id") % FAMILY == 0)).groupBy(F.col("conv_id").alias("first")).agg(F.sort_array(F.collect_list(F.struct("rank", "a", "b", "size"))).alias("head"))
    own = parts.groupBy("conv_id").agg(F.sum("n").alias("n")).withColumn("h", shared_turns(F.col("conv_id")).cast("long"))
    own = own.withColumn("first", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "first", "left")
    own = settle(own.select("conv_id", "n", "h", F.slice(F.coalesce("head", F.array().cast("array<struct<rank:bigint,a:bigint,b:bigint,size:bigint>>")), F.lit(1), F.col("h").cast("int")).alias("head")))
    taken = own.select("conv_id", F.explode("head").alias("t")).select("conv_id", (F.col("t.rank") + 1).alias("depth"), "t.a", "t.b", "t.size")
    rest = rows.join(own.select("conv_id", "h", F.size("head").alias("m")), "conv_id").where("rank >= h").select("conv_id", (F.col("rank") - F.col("h") + F.col("m") + 1).alias("depth"), "a", "b", "size")
    depth = own.select("conv_id", (F.size("head") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).cast("long").alias("depth"))
    return taken.unionByName(rest), settle(depth)


def before_block(sums: DataFrame, columns: list[str], agg, forward: bool = True) -> DataFrame:  # noqa: ANN001
    """``conv_id, block`` and, of each of ``columns``, ``agg`` over the blocks before (or after), in two levels: no window holds more than ``SPAN`` blocks, or one row for each ``SPAN`` of them."""
    d = sums.withColumn("span", F.floor(F.col("block") / SPAN))
    ends = (Window.unboundedPreceding, -1) if forward else (1, Window.unboundedFollowing)
    within = Window.partitionBy("conv_id", "span").orderBy("block").rowsBetween(*ends)
    across = Window.partitionBy("conv_id").orderBy("span").rowsBetween(*ends)
    near = d.select("conv_id", "span", "block", *(agg(c).over(within).alias(f"near_{c}") for c in columns))
    spans = d.groupBy("conv_id", "span").agg(*(agg(c).alias(c) for c in columns))
    far = spans.select("conv_id", "span", *(agg(c).over(across).alias(f"far_{c}") for c in columns))
    both = near.join(far, ["conv_id", "span"])
    zero = F.lit(0).cast("long")
    join = lambda c: (F.coalesce(f"near_{c}", zero).bitwiseXOR(F.coalesce(f"far_{c}", zero)) if agg is F.bit_xor else F.coalesce(f"near_{c}", zero) + F.coalesce(f"far_{c}", zero)).alias(c)
    return both.select("conv_id", "block", *map(join, columns))


def segments(turns: DataFrame, width: int) -> DataFrame:
    """Rows of ``SEGMENT``: turns of one block of a conversation with the sum of the marks before it. Settled."""
    marks = turns.select("conv_id", "depth", F.floor((F.col("depth") - 1) / width).alias("block"), F.xxhash64("a", "depth", "b").alias("m1"), F.xxhash64("b", F.lit(3), "depth", "a").alias("m2"), "size")
    rows = marks.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("depth", "m1", "m2", "size"))).alias("t"), F.bit_xor("m1").alias("x1"), F.bit_xor("m2").alias("x2"))
    rows = settle(rows.select("conv_id", "block", "t.m1", "t.m2", F.col("t.size").alias("sizes"), "x1", "x2"))
    long = rows.where("block > 0").select("conv_id").distinct()
    entry = before_block(rows.select("conv_id", "block", "x1", "x2").join(long, "conv_id", "left_semi"), ["x1", "x2"], F.bit_xor)
    zero = F.lit(0).cast("long")
    out = rows.drop("x1", "x2").join(entry.withColumnsRenamed({"x1": "e1", "x2": "e2"}), ["conv_id", "block"], "left")
    return settle(out.select("conv_id", "block", F.coalesce("e1", zero).alias("e1"), F.coalesce("e2", zero).alias("e2"), "m1", "m2", "sizes"))


def dense(*keys: np.ndarray) -> np.ndarray:
    """Numbers from 1, equal where all keys are."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new) + 1
    return out


class Shard:
    """The padded matrix of a batch of segments, in order, with the starts of its nodes."""

    def __init__(self, b: pa.RecordBatch):
        conv, block, e1, e2 = (b.column(i).to_numpy() for i in range(4))
        lists = [b.column(i) for i in (4, 5, 6)]
        length = np.diff(lists[0].offsets.to_numpy())
        n, w = len(conv), int(length.max())
        row = np.repeat(np.arange(n), length)
        col = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
        m1, m2, size = (x.flatten().to_numpy() for x in lists)

        def matrix(x: np.ndarray) -> np.ndarray:
            out = np.zeros((n, w), dtype=np.int64)
            out[row, col] = x
            return out

        turn, entry = matrix(dense(m1, m2)), dense(block, e1, e2)
        order = np.lexsort([conv, *(turn[:, j] for j in reversed(range(w))), entry])
        self.order, self.length = order, length[order]
        turn, entry = turn[order], entry[order]
        differs = np.ones((n, w + 1), dtype=bool)
        differs[1:, 0] = entry[1:] != entry[:-1]
        differs[1:, 1:] = turn[1:] != turn[:-1]
        self.starts = np.logical_or.accumulate(differs, axis=1)[:, 1:]
        self.conv, self.block, self.size = conv[order], block[order], matrix(size)[order]
        self.entry = e1[order], e2[order]
        self.path = [np.bitwise_xor.accumulate(matrix(m)[order], axis=1) ^ e[:, None] for m, e in zip((m1, m2), self.entry, strict=True)]

    def levels(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Column, rows that reach it, and where among them nodes start, as places and as rows."""
        for j in range(self.starts.shape[1]):
            rows = np.flatnonzero(self.length > j)
            at = np.flatnonzero(self.starts[rows, j])
            yield j, rows, at, rows[at]


def shards(rows: DataFrame) -> DataFrame:
    """Segments in ranges of what they start with."""
    order = ["block", "e1", "e2", "m1", "conv_id"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def nodes_of(rows: DataFrame, width: int) -> DataFrame:
    """Rows of ``NODE`` below the root."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            s = Shard(b)
            for j, rows, at, first in s.levels():
                up = [s.path[k][first, j - 1] if j else s.entry[k][first] for k in (0, 1)]
                n = np.diff(np.append(at, len(rows)))
                columns = [s.block[first] * width + j + 1, s.path[0][first, j], s.path[1][first, j], *up, np.minimum.reduceat(s.conv[rows], at), n, s.size[first, j]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in NODE.split(", ")])

    part = shards(rows).mapInArrow(of, NODE)
    key = ["depth", "k1", "k2"]
    return part.groupBy(*key).agg(F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("size").alias("size"))


def below(rows: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """``depth, k1, k2, leaves, saved``: sums over the subtree of each node."""
    own = (F.col("n_convs") - 1) * F.col("size")
    worth = nodes.select("conv_id", "depth", F.floor((F.col("depth") - 1) / width).alias("block"), own.alias("own")).where("own > 0")
    worth = settle(worth.groupBy("conv_id", "block").agg(F.collect_list(F.struct((F.pmod(F.col("depth") - 1, F.lit(width))).cast("int").alias("at"), "own")).alias("t"), F.sum("own").alias("total")))
    # A block without savings of its own still has those of later blocks after it.
    has = worth.select("conv_id").distinct()
    all_blocks = rows.select("conv_id", "block").join(has, "conv_id", "left_semi").join(worth.select("conv_id", "block", "total"), ["conv_id", "block"], "left")
    tail = before_block(all_blocks.select("conv_id", "block", F.coalesce("total", F.lit(0)).cast("long").alias("total")), ["total"], F.sum, forward=False)
    leaf = nodes.where("n_children = 0").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    d = rows.join(worth.drop("total"), ["conv_id", "block"], "left").join(tail, ["conv_id", "block"], "left").join(leaf, "conv_id", "left").where("leaf IS NOT NULL OR t IS NOT NULL OR total > 0")
    d = d.select(*(c.split()[0] for c in SEGMENT.split(", ")), F.coalesce("leaf", F.lit(0)).cast("long").alias("leaf"), F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.col("t.at").alias("at"), F.col("t.own").alias("own"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            s = Shard(b)
            leaf, total = (b.column(i).to_numpy() for i in (7, 8))
            value = np.zeros(s.size.shape, dtype=np.int64)
            per = b.column(9).value_lengths().fill_null(0).to_numpy()
            value[np.repeat(np.arange(len(b)), per), b.column(9).flatten().to_numpy()] = b.column(10).flatten().to_numpy()
            rest = np.cumsum(value[s.order][:, ::-1], axis=1)[:, ::-1] + total[s.order][:, None]
            leaf = leaf[s.order]
            for j, rows, at, first in s.levels():
                columns = [s.block[first] * width + j + 1, s.path[0][first, j], s.path[1][first, j], np.add.reduceat(leaf[rows], at), np.add.reduceat(rest[rows, j], at)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["depth", "k1", "k2", "leaves", "saved"])

    part = shards(d).mapInArrow(of, "depth long, k1 long, k2 long, leaves long, saved long")
    return part.groupBy("depth", "k1", "k2").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def hashed_ids(ends: DataFrame) -> DataFrame:
    """``depth, k1, k2, ends_sha256`` of ``depth, k1, k2, conv_id``: chunks of ids by ranges, then one stream for each node."""
    order = ["depth", "k1", "k2", "conv_id"]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = [b.column(i).to_numpy() for i in range(3)]
            conv, ids = b.column(3).to_numpy(), b.column(3).cast(pa.string()).to_pylist()
            new = np.ones(len(conv), dtype=bool)
            new[1:] = np.any([k[1:] != k[:-1] for k in key], axis=0)
            at = np.flatnonzero(new)
            joined = [",".join(ids[i:j]) for i, j in zip(at, np.append(at[1:], len(ids)), strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(k[at]) for k in key), pa.array(conv[at]), pa.array(joined, pa.string())], [*order, "ids"])

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])
        now, sha = None, hashlib.sha256()
        for b in batches:
            out = []
            for *key, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if key != now:
                    if now:
                        out.append((*now, sha.hexdigest()))
                    now, sha = key, hashlib.sha256()
                    sha.update(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
        if now:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*now, sha.hexdigest()), strict=True))], schema)

    some = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(chunks, "depth long, k1 long, k2 long, conv_id long, ids string")
    return some.repartition("depth", "k1", "k2").sortWithinPartitions(*order).mapInArrow(streamed, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(conversations: DataFrame, width: int = WIDTH) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``, a row for each node."""
    turns, depths = rebuilt(conversations)
    rows = segments(turns, width)
    zero = F.lit(0).cast("long")
    top = depths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    top = top.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), "conv_id", "n_convs", zero.alias("size"))
    found = settle(nodes_of(rows, width).select(*top.columns).unionByName(top))
    children = found.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    key = ["depth", "k1", "k2"]
    nodes = settle(found.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")))
    sums = below(rows, nodes.where("depth > 0"), width)
    # The root's sums are those of the nodes of depth 1; a root without children is a leaf.
    sums = settle(sums)
    first = sums.where("depth = 1").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), F.coalesce("leaves", F.lit(1)).alias("leaves"), F.coalesce("saved", zero).alias("saved"))
    sums = sums.unionByName(first)
    last = depths.where("depth > 0").select("conv_id", "depth", F.floor((F.col("depth") - 1) / width).alias("block")).join(rows, ["conv_id", "block"])
    path = lambda e, m: F.aggregate(m, F.col(e), lambda a, x: a.bitwiseXOR(x))
    ends = last.select("depth", path("e1", "m1").alias("k1"), path("e2", "m2").alias("k2"), "conv_id")
    ends = ends.unionByName(depths.where("depth = 0").select("depth", zero.alias("k1"), zero.alias("k2"), "conv_id"))
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, key, "left").join(hashed_ids(ends), key, "left").join(up, ["depth", "p1", "p2"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


#: crc32 of the id's digits in eight steps each; a node is its list of turns.
ORACLE = r"""
WITH ordered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS rank
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY rank) AS turns FROM ordered GROUP BY conv_id),
shared AS (
  SELECT conv_id, turns, conv_id - conv_id % 100 AS first, (xor(list_reduce(list_prepend(4294967295::UBIGINT,
      flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, e: CASE WHEN xor(a, e) & 1 = 1 THEN xor(xor(a, e) >> 1, 3988292384::UBIGINT) ELSE xor(a, e) >> 1 END), 4294967295::UBIGINT) % 6)::BIGINT AS h
  FROM own),
rebuilt AS (
  SELECT s.conv_id, list_concat(coalesce(f.turns[1:s.h], []), s.turns[s.h + 1:]) AS turns FROM shared s LEFT JOIN own f ON f.conv_id = s.first),
members AS (SELECT conv_id, d AS depth, turns[1:d] AS path, len(turns) = d AS ends FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY depth, path),
counted AS (
  SELECT n.*, p.conv_id AS parent_conv_id, coalesce(c.n, 0) AS n_children,
    CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * length(n.path[n.depth].text) END AS own
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
  LEFT JOIN (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL) c ON c.depth = n.depth AND c.path = n.path),
above AS (SELECT unnest(range(depth + 1)) AS up, depth, path, own, n_children FROM counted),
sums AS (SELECT up AS depth, path[1:up] AS path, sum(own) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM above GROUP BY ALL)
SELECT n.conv_id, n.depth::BIGINT AS depth, n.parent_conv_id, n.n_convs, n.n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM counted n JOIN sums s ON s.depth = n.depth AND s.path = n.path
"""
