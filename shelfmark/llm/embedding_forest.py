"""Embedding near-dedup by a forest of random-projection trees with spill overlap.

Each tree splits space by random directions; vectors within a margin of a split go both ways. The margin is an absolute width: half the distance of two
vectors that just link, as a random direction shows it, so it does not shrink where vectors are dense. Of some directions and places, a node takes the split that leaves the
fewest comparisons; where none saves a share of them (``SAVES``), as in a group of near copies, the node is a leaf and all its pairs are compared. Every vector, not just the
sample, is sent to its leaves of all trees and compared there with all others by cosine in double precision. A pair that shares several leaves is counted in the first one only.
A leaf task returns sums and spanning edges, a row for each vector, never the pairs; components of these edges are found in rounds. Equal vectors are collapsed before and
counted with their number. Leaves with more than ``TILE`` vectors are cut into tiles, and each pair of tiles is a task of its own. Each length of vector has a forest of its own.

The first trees are grown on a sample of about ``SAMPLE`` vectors, which bounds their depth. Leaves that are still crowded then are split further, each by a tree that a task
grows from about ``PART`` of the leaf's own vectors. All nodes of both levels are broadcast: three numbers each, for at most ``SAMPLE / 16`` leaves a tree with ``PART / 16``
nodes, about 30 MB for six trees. There are as many trees as leave ``MISS`` of the pairs just at the threshold without a common leaf, estimated with partners made for the sample; so
the recall does not fall with depth. Recall against brute force is measured in the tests (0.9 at least), with one level and with two.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; vectors link with those of their own
length only; repeated rows are vectors of their own; an empty table gives no rows; other columns, such as labels, don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.graph import connected_components
from shelfmark.session import settle

from ._shared import table

THRESHOLD, LEAF, SAMPLE, TILE, SEED = 0.9, 800, 20_000, 2048, 29
#: Share of pairs just at the threshold that may be in no common leaf of any tree, which says how many trees there are.
MISS = 0.003
#: A leaf with more than ``CROWD`` times ``LEAF`` vectors gets a tree of its own, from about ``PART`` of its vectors.
CROWD, PART = 4, 4096
#: Random directions for each length of vector; every node tries some of them, so that a tree is three numbers a node.
POOL = 512
#: Directions that a node tries, the quantiles where it may be split, and the share of its comparisons that a split must save.
TRIES, PLACES, SAVES = 3, np.linspace(0.25, 0.75, 11), 0.15


def grown(x: np.ndarray, n: float, normals: np.ndarray, rng: np.random.Generator, leaf: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(direction, low, high) of a tree's inner nodes in the order of a heap, from a sample ``x`` of ``n`` vectors; a leaf has infinite ends the wrong way round."""
    inner = (1 << max(0, int(math.log2(max(1, len(x) / 16))))) - 1
    pick, low, high = np.zeros(inner, dtype=np.int32), np.full(inner, np.inf), np.full(inner, -np.inf)
    half = math.sqrt(max(0.0, 2 - 2 * threshold)) / 2
    rows = {0: np.arange(len(x))}
    for node in range(inner):
        own = rows.pop(node, np.zeros(0, dtype=np.int64))
        if len(own) < 32 or len(own) * n <= leaf * len(x):
            continue
        tried = rng.choice(normals.shape[1], TRIES, replace=False)
        width = half * np.linalg.norm(normals[:, tried], axis=0) / math.sqrt(len(normals))
        v = x[own] @ normals[:, tried]
        best = 1 - SAVES, 0, 0.0
        for k in range(TRIES):
            y = np.sort(v[:, k])
            at = np.quantile(y, PLACES)
            left, right = np.searchsorted(y, at + width[k], "right"), len(y) - np.searchsorted(y, at - width[k], "left")
            cost = (left.astype(float) ** 2 + right.astype(float) ** 2) / len(y) ** 2
            i = int(cost.argmin())
            best = min(best, (cost[i], k, at[i]))
        cost, k, at = best
        if cost < 1 - SAVES:
            pick[node], low[node], high[node] = tried[k], at - width[k], at + width[k]
            rows[2 * node + 1], rows[2 * node + 2] = own[v[:, k] <= high[node]], own[v[:, k] >= low[node]]
    return pick, low, high


class Trees:
    """Trees one after the other in flat arrays; leaves are numbered through."""

    def __init__(self, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.inner = np.array([len(t[0]) for t in trees], dtype=np.int64)
        self.start = np.cumsum(self.inner) - self.inner
        self.first = np.cumsum(2 * self.inner + 1) - (2 * self.inner + 1)
        self.leaves = int((2 * self.inner + 1).sum())
        # The last place is a leaf, where nodes below the arrays look.
        self.pick = np.concatenate([*(t[0] for t in trees), [0]]).astype(np.int32)
        self.low = np.concatenate([*(t[1] for t in trees), [np.inf]])
        self.high = np.concatenate([*(t[2] for t in trees), [-np.inf]])

    def reached(self, p: np.ndarray, row: np.ndarray, tree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for pairs of a row of projections and a tree."""
        out, node = [], np.zeros(len(row), dtype=np.int64)
        while len(row):
            at = np.where(node < self.inner[tree], self.start[tree] + node, len(self.pick) - 1)
            ends = self.low[at] > self.high[at]
            out.append((row[ends], self.first[tree[ends]] + node[ends]))
            row, tree, node, at = row[~ends], tree[~ends], node[~ends], at[~ends]
            v = p[row, self.pick[at]]
            left, right = v <= self.high[at], v >= self.low[at]
            row, tree = np.concatenate([row[left], row[right]]), np.concatenate([tree[left], tree[right]])
            node = np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        if not out:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate([r for r, _ in out]), np.concatenate([c for _, c in out])


class Forest:
    """The trees for vectors of one length, and the trees that split their crowded leaves further."""

    def __init__(self, sample: np.ndarray, n: int, leaf: int = LEAF, threshold: float = THRESHOLD):
        self.dim, self.below, self.deeper = sample.shape[1], None, None
        self.normals = np.random.default_rng((SEED, self.dim)).standard_normal((self.dim, POOL))
        rng = np.random.default_rng((SEED, self.dim, 1))
        grow = lambda k: [grown(sample, n, self.normals, rng, leaf, threshold) for _ in range(k)]
        top = grow(2)
        split = all(len(low) and low[0] <= high[0] for _, low, high in top)
        if split:
            top += grow(self.enough(Trees(top), sample, n, leaf, threshold, rng) - len(top))
            split = all(low[0] <= high[0] for _, low, high in top)
        if not split:
            top = [(np.zeros(0), np.zeros(0), np.zeros(0))]  # a tree of one leaf compares all
        self.top = Trees(top)
        _, code = self.codes(sample)
        #: About how many vectors each leaf has.
        self.sizes = np.bincount(code, minlength=self.top.leaves) * (n / max(1, len(sample)))

    def enough(self, two: Trees, sample: np.ndarray, n: int, leaf: int, threshold: float, rng: np.random.Generator) -> int:
        """How many trees leave ``MISS`` of the pairs at the threshold without a common leaf, from partners made for the sample.

        Where the sample bounds the depth, the leaves will be split further: the share of pairs that a tree keeps together falls by as much again for as much depth.
        """
        x = sample[:4096]
        aside = rng.standard_normal(x.shape)
        aside -= np.einsum("ij,ij->i", aside, x)[:, None] * x
        aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-300)
        y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * aside
        row, tree = np.repeat(np.arange(len(x)), 2), np.tile(np.arange(2), len(x))
        (r, c), (r2, c2) = (two.reached(v @ self.normals, row, tree) for v in (x, y))
        both = np.intersect1d(r * two.leaves + c, r2 * two.leaves + c2)
        of = np.searchsorted(two.first, both % two.leaves, "right") - 1
        kept = len(np.unique(both // two.leaves * 2 + of)) / (2 * len(x))
        size = np.bincount(c, minlength=two.leaves)[c] * (n / len(x))
        last = c - two.first[np.searchsorted(two.first, c, "right") - 1] >= two.inner[0]
        done = np.log(np.maximum(1, n / size)).mean()
        to_do = np.where(last & (size > CROWD * leaf), np.log(np.maximum(1, size / leaf)), 0).mean()
        kept **= 1 + to_do / max(done, 0.1)
        return max(2, math.ceil(math.log(MISS) / math.log(min(0.98, max(1e-9, 1 - kept)))))

    def deepen(self, codes: np.ndarray, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.below, self.deeper = Trees(trees), np.full(self.top.leaves, -1, dtype=np.int64)
        self.deeper[codes] = np.arange(len(codes))

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf of any tree), in the order of the rows and leaves."""
        rows, codes, trees = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], len(self.top.inner)
        for s in range(0, len(x), 4096):
            p = x[s : s + 4096] @ self.normals
            row, code = self.top.reached(p, np.repeat(np.arange(len(p)), trees), np.tile(np.arange(trees), len(p)))
            if self.below is not None:
                tree = self.deeper[code]
                down = tree >= 0
                r, c = self.below.reached(p, row[down], tree[down])
                row, code = np.concatenate([row[~down], r]), np.concatenate([code[~down], self.top.leaves + c])
            order = np.lexsort((code, row))
            rows.append(s + row[order])
            codes.append(code[order])
        return np.concatenate(rows), np.concatenate(codes)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of unit length from lists of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def in_common(owner: np.ndarray, code: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Whether rows of ``a`` and ``b`` have a code in common; codes come in parts, so that the memory does not grow with their number."""
    row, col = np.full(n, -1), np.full(n, -1)
    row[a], col[b] = np.arange(len(a)), np.arange(len(b))
    out = np.zeros((len(a), len(b)), dtype=bool)
    both = np.intersect1d(code[row[owner] >= 0], code[col[owner] >= 0])
    for s in range(0, len(both), 2048):
        part = both[s : s + 2048]
        at = np.minimum(np.searchsorted(part, code), len(part) - 1)
        fits = part[at] == code
        left, right = np.zeros((len(a), len(part)), dtype=np.float32), np.zeros((len(part), len(b)), dtype=np.float32)
        k = fits & (row[owner] >= 0)
        left[row[owner[k]], at[k]] = 1
        k = fits & (col[owner] >= 0)
        right[at[k], col[owner[k]]] = 1
        out |= left @ right > 0
    return out


def linked_in_leaf(group: pa.Table, threshold: float) -> pa.Table:
    """(rep, links, label): weights of the vectors linked first here, and the smallest vector reachable here."""
    code, i, j = (group[c][0].as_py() for c in ("code", "i", "j"))
    group = group.combine_chunks()
    rep, weight, tile = (group[c].to_numpy() for c in ("rep", "weight", "tile"))
    x = matrix(group["embedding"].combine_chunks())
    other = group["codes"].combine_chunks()
    owner = np.repeat(np.arange(len(rep)), np.diff(other.offsets.to_numpy()))
    values = other.flatten().to_numpy()
    before = values < code
    own, col = np.unique(values[before], return_inverse=True)
    owner = owner[before]
    a = np.flatnonzero(tile == i)
    b = np.flatnonzero(tile == j)
    near = np.zeros((len(a), len(b)), dtype=bool)
    links = np.zeros(len(rep), dtype=np.int64)
    for s in range(0, len(a), 512):
        part = a[s : s + 512]
        hit = x[part] @ x[b].T >= threshold
        hit &= rep[part][:, None] != rep[b][None, :]
        near[s : s + 512] = hit
        if len(own) and hit.any():
            r, c = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
            hit[np.ix_(r, c)] &= ~in_common(owner, col, part[r], b[c], len(rep))
        links[part] += hit @ weight[b]
        if i != j:
            links[b] += weight[part] @ hit
    label = rep.copy()
    far = np.iinfo(np.int64).max
    while near.any():
        new = label.copy()
        for s in range(0, len(a), 512):
            hit = near[s : s + 512]
            new[a[s : s + 512]] = np.minimum(new[a[s : s + 512]], np.where(hit, label[b], far).min(axis=1))
            if i != j:
                new[b] = np.minimum(new[b], np.where(hit, label[a[s : s + 512]][:, None], far).min(axis=0))
        if (new == label).all():
            break
        label = new
    keep = (links > 0) | (label != rep)
    return pa.table({"rep": rep[keep], "links": links[keep], "label": label[keep]})


def deepen(classes: DataFrame, forests: dict[int, Forest], leaf: int, threshold: float) -> None:
    """Give each crowded leaf a tree that a task grows from about ``PART`` of its own vectors; what comes to the driver are the trees' nodes."""
    if not any((f.sizes > CROWD * leaf).any() for f in forests.values()):
        return
    shared = classes.sparkSession.sparkContext.broadcast(forests)

    def crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lens = np.diff(whole.column(0).offsets.to_numpy())
            for d in np.unique(lens).tolist():
                forest = shared.value.get(d)
                if forest is None:
                    continue
                batch = whole.filter(pa.array(lens == d))
                row, code = forest.codes(matrix(batch.column(0)))
                size = forest.sizes[code]
                kept = (size > CROWD * leaf) & (batch.column(1).to_numpy()[row] * size < PART)
                part = batch.column(0).take(pa.array(row[kept]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), d), pa.int32()), pa.array(code[kept], pa.int32()), part], ["dim", "code", "embedding"])

    def tree(key: tuple, group: pa.Table) -> pa.Table:
        d, code = (k.as_py() for k in key)
        forest = shared.value[d]
        x = matrix(group["embedding"].combine_chunks())
        nodes = grown(x, forest.sizes[code], forest.normals, np.random.default_rng((SEED, d, 2, code)), leaf, threshold)
        split = len(nodes[1]) > 0 and nodes[1][0] <= nodes[2][0]
        columns = {"dim": [d], "code": [code], "pick": [nodes[0]], "low": [nodes[1]], "high": [nodes[2]]}
        schema = pa.schema([("dim", pa.int32()), ("code", pa.int32()), ("pick", pa.list_(pa.int32())), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])
        return pa.table(columns, schema).slice(0, 1 if split else 0)

    place = F.pmod(F.xxhash64(F.lit(SEED + 1), "embedding"), F.lit(1_000_003)) / 1_000_003
    numbers = classes.schema["embedding"].dataType.simpleString()
    some = classes.select("embedding", place.alias("place")).mapInArrow(crowded, f"dim int, code int, embedding {numbers}")
    trees = some.groupBy("dim", "code").applyInArrow(tree, "dim int, code int, pick array<int>, low array<double>, high array<double>").toArrow()
    dims = trees["dim"].to_numpy()
    for d in np.unique(dims).tolist():
        own = trees.filter(pa.array(dims == d)).sort_by("code")
        forests[d].deepen(own["code"].to_numpy(), [tuple(c[i].values.to_numpy() for c in (own["pick"], own["low"], own["high"])) for i in range(len(own))])


def dedup(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, tile: int = TILE, leaf: int = LEAF) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    spark = vectors.sparkSession
    numbers = "array<float>" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>"
    v = vectors.select(vectors[key].alias("vec_id"), vectors[embedding].cast(numbers).alias("embedding"))
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))
    usable = F.coalesce(F.forall("embedding", finite) & F.exists("embedding", lambda e: e != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    good = v.where(usable)
    # Equal vectors are one class with a number of its own, since an id may stand for several vectors.
    classes = good.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    classes = settle(classes.withColumn("rep", F.monotonically_increasing_id()))
    # A row for each length of vector; a length of up to LEAF vectors has one leaf and needs no forest.
    lengths = classes.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).where(F.col("n") > leaf)
    n = {r["dim"]: r["n"] for r in lengths.collect()}
    share = F.least(F.lit(1.0), F.lit(SAMPLE / max(1, len(n))) / F.col("n"))
    some = classes.select("embedding", F.size("embedding").alias("dim")).join(F.broadcast(lengths), "dim")
    some = some.where(F.pmod(F.xxhash64(F.lit(SEED), "embedding"), F.lit(1_000_003)) < F.lit(1_000_003) * share).select("embedding").limit(2 * SAMPLE).toArrow()
    lists = some["embedding"].combine_chunks()
    lens = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, dtype=np.int64)
    forests = {int(d): Forest(matrix(lists.filter(pa.array(lens == d))), n[d], leaf=leaf, threshold=threshold) for d in np.unique(lens)}
    deepen(classes, forests, leaf, threshold)
    shared = spark.sparkContext.broadcast(forests)  # of a size that the samples bound

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lens = np.diff(whole.column(0).offsets.to_numpy())
            for d in np.unique(lens).tolist():
                batch = whole.filter(pa.array(lens == d))
                forest = shared.value.get(d) or Forest(np.zeros((1, d)), 1)
                row, code = forest.codes(matrix(batch.column(0)))
                per = np.bincount(row, minlength=len(batch))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per)), pa.int32()), pa.array(code, pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["embedding", "rep", "weight", "codes"])

    placed = settle(classes.select("embedding", "rep", "weight").mapInArrow(codes, f"embedding {numbers}, rep long, weight long, codes array<int>"))
    placed = placed.withColumn("dim", F.size("embedding"))
    # Rows for leaves of several tiles only; at most as many as the forests have leaves.
    sizes = placed.select("dim", F.explode("codes").alias("code")).groupBy("dim", "code").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")).where("tiles > 1")
    each = placed.select("*", F.explode("codes").alias("code")).join(sizes, ["dim", "code"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    each = each.withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("o"))
    each = each.select("dim", "code", F.least("tile", "o").alias("i"), F.greatest("tile", "o").alias("j"), "tile", "rep", "weight", "embedding", "codes")
    found = settle(each.groupBy("dim", "code", "i", "j").applyInArrow(lambda g: linked_in_leaf(g, threshold), "rep long, links long, label long"))
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = connected_components(found.select("rep", "label"), "rep", "label")
    comp = settle(comp.withColumnRenamed("id", "rep").join(classes.select("rep", "least"), "rep"))
    named = comp.groupBy("component").agg(F.min("least").alias("component_id"))
    fate = classes.join(sums, "rep", "left").join(comp.select("rep", "component").join(named, "component"), "rep", "left")
    fate = fate.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    linked = good.join(fate, "embedding").select("vec_id", "n_links", "component_id")
    alone = v.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op7_embedding_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "embeddings"))
