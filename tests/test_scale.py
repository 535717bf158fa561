"""What one task holds stays within a bound when tables grow."""

from itertools import combinations

from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.operators import checks, graph, payload
from shelfmark.plans import rewritten, scans, strings


def test_pages_are_dealt_by_blocks(spark):
    rows = spark.range(60_000).withColumnRenamed("id", "n")
    docs = scans.pages(rows, "n", rows["n"].cast("string"))
    assert docs.rdd.getNumPartitions() == 1 + 60_000 // scans.BLOCKS
    assert docs.count() == 600 and docs.where("page = 3").first().text == "\n".join(map(str, range(300, 400)))


def test_child_keys_are_distinct_before_they_meet(spark, monkeypatch):
    monkeypatch.setattr(checks, "ROWS", 2)
    child = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long")
    found = checks.orphans(child, "k", spark.createDataFrame([(2,)], "p long"), "p", "lost")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftAnti") < plan.index("Aggregate")
    assert [tuple(r) for r in found.collect()] == [("lost", "1")]
    assert checks.duplicates(child, ["k"], "twice").rdd.getNumPartitions() == 3


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    """60 nodes of one key: tasks hold no more than a few times ``PAIRS`` pairs, and names are there."""
    monkeypatch.setattr(graph, "PAIRS", 100)
    rows = spark.range(60).select("id", F.lit("hub").alias("k"), F.concat(F.lit(" Hub "), F.col("id").cast("string")).alias("name"))
    pairs = graph._pairs(rows.select("k", F.col("id").alias("n")), 16)
    assert pairs.rdd.getNumPartitions() == 18 and max(map(len, pairs.rdd.glom().collect())) < 300
    got = graph.shared_names(rows, "k", "id", "name", ["id"], block=16)
    assert sorted((r.src, r.dst, *r.shared) for r in got.collect()) == [(a, b, "Hub 0") for a, b in combinations(range(60), 2)]
    edges = graph.shared_key_pairs(rows, "k", "id", block=16)
    assert edges.rdd.getNumPartitions() == 18
    assert sorted(map(tuple, edges.collect())) == [(a, b, 1) for a, b in combinations(range(60), 2)]


def test_members_of_keys_without_pairs_are_dealt_by_their_number(spark, monkeypatch):
    """Keys of one member make no pairs, and their rows are many all the same; hubs, broadcast or not, and limits of groups change no edge."""
    monkeypatch.setattr(graph, "ROWS", 100)
    rows = spark.range(1000).selectExpr("id", "if(id < 40, 0, id) AS k").coalesce(1)
    want = [(a, b, 1) for a, b in combinations(range(40), 2)]
    for hubs in (0, 10):
        monkeypatch.setattr(graph, "HUBS", hubs)
        edges = graph.shared_key_pairs(rows, "k", "id", block=16)
        assert edges.rdd.getNumPartitions() == 11
        assert sorted(map(tuple, edges.collect())) == want
    assert sorted(map(tuple, graph.shared_key_pairs(rows, "k", "id").collect())) == want
    assert sorted(map(tuple, graph.shared_key_pairs(rows, "k", "id", max_group=40).collect())) == want and graph.shared_key_pairs(rows, "k", "id", max_group=39).isEmpty()


def test_tiers_end_at_the_end_and_keep_letters(spark):
    """What DuckDB's patterns give: no end before a last line mark, no vertical tab among blanks, and letters that fall apart in upper case are no plain ones."""
    cases = {"CC NC": "restricted", "nc\n": "restricted", "nc\u2028": "unknown", "nc\u0085": "unknown", "x\x0bnc": "unknown", "\ufb01sc": "unknown", "isc": "permissive", "x-sa": "copyleft", "mit": "permissive", "émit": "permissive"}
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert [r.t for r in df.where(T.licence_tier(F.col("t")) != F.col("want")).collect()] == []


def test_payloads_are_dealt_by_their_number(spark, monkeypatch, tmp_path):
    """One file of one task is walked by many, with the same faults."""
    monkeypatch.setattr(payload, "PAYLOADS", 10)
    spark.range(100).selectExpr("id", "'{\"a\":' || if(id % 7 = 0, '\"x\"', '1') || '}' AS body").coalesce(1).write.parquet(f"{tmp_path}/one")
    found = payload.violations(spark.read.parquet(f"{tmp_path}/one"), "id", "body", {"type": "object", "properties": {"a": {"type": "integer"}}})
    assert sorted(map(tuple, found.collect())) == [(i, "/a", "type", "STRING") for i in range(0, 100, 7)]
    assert len(found.inputFiles()) > 10


def test_payloads_are_walked_in_one_pass(spark, monkeypatch):
    """Seven levels are settled once after the payloads, as many passes as it takes give the same faults, and faults of every level are there."""
    node = {"type": "object", "required": ["v"], "properties": {"v": {"type": "integer"}, "kids": {"type": "array", "items": {"$ref": "#/$defs/node"}}}}
    schema = {"$ref": "#/$defs/node", "$defs": {"node": node}}
    body = '{"v":1.5,"kids":[{"v":1,"kids":[]},{"kids":[{"v":"x","kids":[null,{"v":2.0,"kids":{}}]}]}]}'
    rows = spark.createDataFrame([(1, body), (2, None), (3, "null"), (4, "["), (5, "{}")], "id int, body string")
    want = sorted([(1, "/v", "type", "DECIMAL"), (1, "/kids/1", "missing", "v"), (1, "/kids/1/kids/0/v", "type", "STRING"), (1, "/kids/1/kids/0/kids/0", "type", "VOID"), (1, "/kids/1/kids/0/kids/1/kids", "type", "OBJECT"), (3, "", "type", "VOID"), (4, "", "json", ""), (5, "", "missing", "v")])
    settled, settle = [], payload.settle
    monkeypatch.setattr(payload, "settle", lambda df: settled.append(df) or settle(df))
    for levels, passes in ((8, 1), (3, 3), (1, 8)):
        monkeypatch.setattr(payload, "LEVELS", levels)
        settled.clear()
        assert sorted(map(tuple, payload.violations(rows, "id", "body", schema).collect())) == want
        assert len(settled) == 1 + passes


def test_written_documents_are_dealt_before_they_are_read(spark, monkeypatch):
    """What the session's own number of partitions gathers is dealt by the number of blocks."""
    monkeypatch.setattr(rewritten, "BLOCKS", 10)
    read, anchored = [], rewritten.catalogue.anchored
    monkeypatch.setattr(rewritten.catalogue, "anchored", lambda d, *a: read.append(d) or anchored(d, *a))
    trips = rewritten.reference_round_trips(spark, "/root/testdata/sf0.001")
    assert [d.rdd.getNumPartitions() for d in read] == [16, 16, 16]
    assert {r.trip: (r.lost, r.made) for r in trips.collect()}["same"] == (0, 0)


def test_models_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(strings, "MODELS", 100)
    back = strings.pretty_models(spark, "/root/testdata/sf0.001")
    assert len(back.inputFiles()) == 16 and back.count() == 1500
