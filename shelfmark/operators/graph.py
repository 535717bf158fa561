"""Graph operators on edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.session import drop_settled, parts_of, settle


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(id, component)`` for every node with an edge to another node; component is the smallest id reachable.

    Alternating large-star and small-star steps: each hangs a node's neighbours under the smallest of
    them, so edges never multiply and the number of rounds grows with the logarithm of the
    longest path. Every round is settled in the shared folder. Self loops and null ends are ignored;
    nodes without an edge do not appear, and the caller gives them their own id.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    e = settle(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _fingerprint(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = settle(small.unionByName(low.withColumnRenamed("m", "v")).distinct())
        now = _fingerprint(star)
        drop_settled(e)
        e = star
        if now == seen:
            break
        seen = now
    flat = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return flat.unionByName(flat.select(F.col("component").alias("id"), "component")).distinct()


def _fingerprint(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def degree(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst", key: str = "id") -> DataFrame:
    """Undirected degree of every node, 0 where no edge ends at it."""
    ends = edges.select(F.col(src).alias(key)).unionByName(edges.select(F.col(dst).alias(key)))
    counts = ends.groupBy(key).agg(F.count("*").alias("degree"))
    return nodes.select(key).join(counts, key, "left").select(key, F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


#: Pairs a task, rows a task, and keys that are broadcast at most.
PAIRS = 2_000_000
ROWS = 1_000_000
HUBS = 100_000


def _pairs(own: DataFrame, block: int) -> DataFrame:
    """``src, dst``, src < dst, of all pairs of nodes with a key, and the key's other columns, for distinct ``k, n`` and these; dealt by ``src, dst``.

    Members of a key with more than ``block`` of them are dealt into blocks by hash, and each pair of blocks is a join key of its own; so one join key pairs ``block`` with ``block`` members, whatever a key holds.
    Tasks are as many as the members and the pairs ask for, since members are few where the pairs made of them are many, and many where keys have few. Keys are counted where they are dealt, not before: a map of the keys of
    one file would grow with the file.
    """
    own = settle(own)
    m = parts_of(own, ROWS)
    sizes = settle(own.select("k").repartition(m, "k").groupBy("k").agg(F.count("*").alias("c")))
    n = m + int(sizes.agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2)).first()[0] or 0) // PAIRS
    hubs = sizes.where(F.col("c") > block).select("k", F.ceil(F.col("c") / block).cast("int").alias("nb"))
    many = hubs.count()
    if many > HUBS:
        d = own.repartition(m, "k").join(hubs.repartition(m, "k"), "k", "left")
    else:
        d = own.join(F.broadcast(hubs), "k", "left") if many else own.withColumn("nb", F.lit(1))
    d = d.withColumn("nb", F.coalesce("nb", F.lit(1))).withColumn("b", F.pmod(F.xxhash64("n"), F.col("nb")).cast("int"))
    d = d.select(*own.columns, "b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o"))
    d = d.select(*own.columns, "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j")).repartition(n, "k", "i", "j")
    shown = [c for c in own.columns if c not in ("k", "n")]
    left = d.where("b = i").select("k", "i", "j", F.col("n").alias("x"), *shown)
    right = d.where("b = j").select("k", "i", "j", F.col("n").alias("y"))
    # Within one block each pair is met in both orders, across two in one.
    both = left.join(right, ["k", "i", "j"]).where((F.col("i") < F.col("j")) | (F.col("x") < F.col("y")))
    return both.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"), *shown).repartition(n, "src", "dst")


def shared_key_pairs(rows: DataFrame, key: str, node: str, max_group: int | None = None, block: int = 1024) -> DataFrame:
    """Edges ``(src, dst, weight)`` between nodes that share a key, src < dst; weight counts the shared keys. Keys with many nodes are split (``_pairs``).

    ``max_group`` leaves out keys held by more nodes than that (hubs, whose pairs grow with the square).
    """
    m = parts_of(rows, ROWS)
    own = rows.select(F.col(key).alias("k"), F.col(node).alias("n")).dropna().repartition(m, "k", "n").distinct()
    if max_group is not None:
        own = own.repartition(m, "k")
        small = own.groupBy("k").agg(F.count("*").alias("c")).where(F.col("c") <= max_group).select("k")
        own = own.join(small, "k", "left_semi")
    return _pairs(own, block).groupBy("src", "dst").agg(F.count("*").alias("weight"))


def shared_names(rows: DataFrame, key: str, node: str, shown: str, order: list[str], block: int = 1024) -> DataFrame:
    """Edges ``(src, dst, shared)`` between nodes that share a key, with the sorted names of the keys; a key is shown as the trimmed ``shown`` of its first row by ``order``."""
    known = rows.where(F.col(key).isNotNull() & F.col(node).isNotNull()).withColumn("k", F.col(key)).repartition(parts_of(rows, ROWS), "k")
    names = known.groupBy("k").agg(F.min_by(F.trim(shown), F.struct(*order)).alias("name"))
    # Names meet the members of a key, not its pairs, which would all be in the one task that has the name.
    own = known.select("k", F.col(node).alias("n")).distinct().join(names, "k")
    return _pairs(own, block).groupBy("src", "dst").agg(F.array_sort(F.collect_set("name")).alias("shared"))


def citations(refs: DataFrame, works: DataFrame, key: str = "id", doi: str = "doi") -> DataFrame:
    """Edges ``(src, dst)`` between references: src cites dst if the work of src (``works``: ``doi, work_id, referenced``) names the work of dst. DOIs and work ids are normalised on both sides.

    Work ids are addresses or bare; of references that share a work the one of the largest key stands for it; of works of one DOI the one of the smallest id counts. Repeated mentions count once, a reference to itself not at all.
    """
    bare = lambda c: F.nullif(T.last_segment(c), F.lit(""))
    w = works.select(T.doi_key(F.col("doi")).alias("_d"), bare(F.col("work_id")).alias("_w"), F.col("referenced").alias("_r")).where("_d IS NOT NULL")
    w = w.groupBy("_d").agg(F.min_by(F.struct("_w", "_r"), "_w").alias("_x")).select("_d", "_x.*")
    own = refs.select(F.col(key).alias("src"), T.doi_key(F.col(doi)).alias("_d")).where("_d IS NOT NULL").join(w, "_d")
    target = own.where("_w IS NOT NULL").groupBy("_w").agg(F.max("src").alias("dst"))
    named = own.select("src", F.explode(F.array_distinct(F.transform("_r", bare))).alias("_w"))
    return named.join(target, "_w").where("src <> dst").select("src", "dst").distinct()


def overall_stats(edges: DataFrame, nodes: DataFrame, key: str = "id", lone: int = 1) -> DataFrame:
    """``graph_stats`` with the size of the largest component where no node has an edge given by ``lone``: 1 counts a node by itself (shared keys), 0 counts connected ones only (citations)."""
    s = graph_stats(edges, nodes, key)
    return s.withColumn("largest_component", F.when(F.col("n_connected") == 0, F.least(F.lit(lone).cast("long"), F.col("n_nodes"))).otherwise(F.col("largest_component")))


def directed_edges_in_corpus(refs: DataFrame, nodes: DataFrame, src: str, dst: str, key: str) -> DataFrame:
    """Distinct references whose two ends are in ``nodes``, without self references."""
    ids = nodes.select(F.col(key).alias("_k")).distinct()
    e = refs.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src <> dst").distinct()
    return e.join(ids, e.src == ids["_k"], "left_semi").join(ids, F.col("dst") == ids["_k"], "left_semi")


def graph_stats(edges: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """One row: nodes, edges, connected and isolated nodes, size of the largest component (1 if only singletons)."""
    comp = connected_components(edges)
    sizes = comp.groupBy("component").agg(F.count("*").alias("c")).agg(F.max("c").alias("largest"))
    n = nodes.select(key).distinct().agg(F.count("*").alias("n_nodes"))
    m = edges.agg(F.count("*").alias("n_edges"))
    linked = comp.agg(F.count("*").alias("n_connected"))
    one = n.join(m, F.lit(True)).join(linked, F.lit(True)).join(sizes, F.lit(True))
    floor: Column = F.when(F.col("n_nodes") > 0, 1).otherwise(0)
    return one.select(
        "n_nodes", "n_edges", "n_connected", (F.col("n_nodes") - F.col("n_connected")).alias("n_isolated"),
        F.coalesce("largest", floor).cast("long").alias("largest_component"),
    )


def induced(edges: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """Distinct edges ``(src, dst)`` whose ends are both in the one set of nodes, without loops."""
    return directed_edges_in_corpus(edges, nodes, "src", "dst", key).select("src", "dst")


def shown(nodes: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """Nodes that an edge touches, with their columns and the edges into them (``cited``) and out of them (``citing``); isolated ones are hidden."""
    ends = edges.select(F.col("dst").alias(key), F.lit(1).alias("_in"), F.lit(0).alias("_out")).unionByName(edges.select(F.col("src").alias(key), F.lit(0).alias("_in"), F.lit(1).alias("_out")))
    counts = ends.groupBy(key).agg(F.sum("_in").alias("cited"), F.sum("_out").alias("citing"))
    return nodes.join(counts, key)
