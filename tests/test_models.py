"""Curated entries, graphs with hubs, citations, overlapping grids, runs, NDJSON in one pass and counts of models."""

import itertools
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shelfmark.operators import checks, enrich, graph, matrix
from shelfmark.sources import ndjson


def test_anchors_are_unique_on_their_page_and_citations_keep_their_order(spark):
    rows = [(1, "a", "Entry", "P", "10.1/a", '["10.1/b", "https://doi.org/10.1/A", null]', "MIT"), (2, "b", "Entry", "P", None, "no", None), (3, "c", "Entry-2", "P", "10.1/none", None, "x"), (4, "d", "Entry", "Q", "10.1/b", '{"a": 1}', ""), (5, "e", "??", "P", " ", "[]", "MIT"), (6, "f", None, None, "10.1/c", '["10.1/a"]', "MIT")]
    e = spark.createDataFrame(rows, "place int, item_id string, name string, page string, doi string, related_dois string, license string")
    topics = spark.createDataFrame([("a", "t2", "x"), ("a", "t1", "x"), ("a", "t1", "x"), ("z", "t9", "x"), ("b", None, "x")], "item_id string, slug string, theme string")
    counts = spark.createDataFrame([("DOI:10.1/A", 5), ("10.1/b", 0), ("10.1/a", 4), ("10.1/c", None)], "doi string, n long")
    got = {r["place"]: r for r in enrich.curated_model(e, topics, counts).collect()}
    assert [got[i]["anchor"] for i in range(1, 7)] == ["ds-entry", "ds-entry-2", "ds-entry-2-2", "ds-entry", "ds-entry-3", "ds-entry"]
    assert [(got[i]["citation_count"], got[i]["citation_sources"], got[i]["citation_dois"]) for i in range(1, 7)] == [(5, 2, ["10.1/a", "10.1/b"]), (None, 0, []), (None, 0, []), (0, 1, ["10.1/b"]), (None, 0, []), (5, 1, ["10.1/a"])]
    assert [t["slug"] for t in got[1]["topics"]] == ["t1", "t2"] and got[2]["topics"] == [] and got[3]["tier"] == "unknown"


def test_pairs_of_hubs_are_split_and_whole(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aab") if i % 3 else None, rng.randrange(40), f" n{i % 2} ", i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, n int, shown string, i int")
    own = {(k, n) for k, n, _, _ in rows if k}
    want = {}
    for k in "ab":
        for x, y in itertools.combinations(sorted(n for q, n in own if q == k), 2):
            want[x, y] = want.get((x, y), 0) + 1
    for block in (4096, 7, 1):
        assert {(r["src"], r["dst"]): r["weight"] for r in graph.shared_key_pairs(df, "k", "n", block=block).collect()} == want
    first = {k: next(s.strip() for q, _, s, _ in rows if q == k) for k in "ab"}
    got = {(r["src"], r["dst"]): r["shared"] for r in graph.shared_names(df, "k", "n", "shown", ["i"], block=5).collect()}
    both = {p: sorted({first[k] for k in "ab" if (k, p[0]) in own and (k, p[1]) in own}) for p in want}
    assert got == both


def test_citations_by_works(spark):
    refs = spark.createDataFrame([(1, "10.1/A"), (2, "https://doi.org/10.1/b"), (3, None), (4, "10.1/c"), (5, "10.1/none"), (6, "10.1/B")], "id int, doi string")
    works = spark.createDataFrame(
        [("10.1/a", "https://w.example/W1", ["W2", " https://w.example/w2 ", "W9", "W1", None]), ("doi:10.1/b", "W2", ["w3"]), ("10.1/c", "w3", []), ("10.1/z", "W9", ["W1"])], "doi string, work_id string, referenced array<string>"
    )
    e = graph.citations(refs, works)
    assert sorted(map(tuple, e.collect())) == [(1, 6), (2, 4), (6, 4)]
    none = e.limit(0)
    assert [graph.overall_stats(none, refs, lone=k).first()["largest_component"] for k in (1, 0)] == [1, 0]
    assert graph.overall_stats(e, refs, lone=0).first()["largest_component"] == 4
    assert graph.overall_stats(none, refs.limit(0)).first()["largest_component"] == 0


def test_an_item_counts_once_in_its_theme(spark):
    tree = spark.createDataFrame([("t", "T", None, 0), ("a", "A", "t", 0), ("b", "B", "t", 1), ("u", "U", None, 1)], "slug string, label string, theme string, place int")
    topics = "array<struct<slug:string,theme:string>>"
    items = spark.createDataFrame([(1, "x", [("a", "t"), ("b", "t")]), (2, "y", [("b", "t"), ("t", "t")]), (3, None, [("b", "t"), ("b", "t")]), (4, "x", None), (5, "x", [])], f"id int, k string, topics {topics}")
    got = [tuple(r) for r in matrix.subject_grid(items, "topics", "k", ["x", "y"], tree).orderBy("row").collect()]
    assert got == [(0, "t", "T", "theme", None, 3, 1, 1), (1, "b", "B", "tag", "t", 3, 1, 1), (2, "a", "A", "tag", "t", 1, 1, 0), (3, "u", "U", "theme", None, 0, 0, 0)]


def test_runs_and_gaps_over_ranges(spark):
    rng = random.Random(9)
    ids = sorted({rng.randrange(-300, 900) for _ in range(500)})
    df = spark.createDataFrame([(i,) for i in [*ids, *ids[:50], None]], "id long").repartition(5)
    gaps, runs = enrich.id_runs(df, "id")
    breaks = [i for i in range(1, len(ids)) if ids[i] > ids[i - 1] + 1]
    assert sorted(map(tuple, gaps.collect())) == [(ids[i - 1] + 1, ids[i] - 1) for i in breaks]
    assert sorted(map(tuple, runs.collect())) == [(ids[a], ids[b - 1]) for a, b in zip([0, *breaks], [*breaks, len(ids)])]
    assert [r.collect() for r in enrich.id_runs(df.limit(0), "id")] == [[], []]
    shown = spark.createDataFrame([(5, 5), (5, 9)], "a int, b int").select(enrich.segment(F.col("a"), F.col("b")).alias("s"))
    assert [r["s"] for r in shown.collect()] == ["#5", "#5–#9"]


def test_lines_are_read_once_and_faults_told_apart(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    good = put("good", '{"k": 1, "v": "a"}\n\n  \n{"k": 2}\n{"v": null, "k": 1}\n')
    assert sorted(map(tuple, ndjson.read(spark, good, "k int, v string").collect()), key=str) == [(1, "a"), (1, None), (2, None)]
    assert ndjson.read(spark, str(tmp_path / "none"), "k int").collect() == []
    assert sorted(map(tuple, ndjson.last_of_file(ndjson.read(spark, good, "k int, v string", at="at"), ["k"], "at").collect()), key=str) == [(1, None), (2, None)]
    bad = put("bad", '{"k": "x"}\n{"k": 1\n{"k": 1, "q": 2, "b": 3}\n[1]\nnull\n{"k": 4}\n')
    assert sorted((r["file"], r["fault"]) for r in ndjson.faults(spark, bad, "k int").collect()) == [("bad", "does not fit"), ("bad", "does not fit"), ("bad", "does not fit"), ("bad", "no JSON"), ("bad", "unknown fields: b, q")]
    with pytest.raises(PySparkException, match="unknown fields: q in .*odd"):
        ndjson.read(spark, put("odd", '{"k": 1, "q": 2}'), "k int").collect()


def test_stores_count_what_they_write_and_check_what_they_read(spark, tmp_path):
    schemas, keys = {"a": "k int, v string", "b": "k int, a int"}, {"a": ["k"], "b": ["k"]}
    a, b = spark.createDataFrame([(1, "x"), (2, None)], schemas["a"]), spark.createDataFrame([(7, 1), (8, None)], schemas["b"])
    assert ndjson.write_store({"a": a, "b": b}, str(tmp_path / "s"), keys) == {"a": 2, "b": 2}
    fk = [("b", "a", "a", "k")]
    back = ndjson.read_store(spark, str(tmp_path / "s"), schemas | {"c": "x int"}, fk)
    assert sorted(map(tuple, back["a"].collect()), key=str) == [(1, "x"), (2, None)] and back["c"].count() == 0
    ndjson.write_store({"a": a.where("k = 2"), "b": b}, str(tmp_path / "t"), keys)
    with pytest.raises(ValueError, match=r"b\.a 1 \(1\)"):
        ndjson.read_store(spark, str(tmp_path / "t"), schemas, fk)


def test_drift_of_counts(spark):
    assert [tuple(r) for r in checks.drift(spark, [("a", 1, 1), ("b", None, 0), ("c", 2, None)]).collect()] == [("c", "2 <> 0")]
    assert checks.drift(spark, []).collect() == []
