"""Operators on small hand-made tables, nulls and ties among them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.operators import checks, dml, enrich, graph
from shelfmark.streaming import events


def one(spark, f, *values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_slugs(spark):
    assert one(spark, T.slugify, "A  b--C! ", "-x-", None) == ["a-b-c", "x", None]
    assert one(spark, T.group_slug, "A & B", "(x)") == ["a-b", "x"]
    assert one(spark, T.heading_slug, "A & B") == ["a--b"]


def test_keys(spark):
    assert one(spark, T.doi_key, " HTTPS://dx.doi.org/10.1/A ", "doi: 10.2/b", "", None) == ["10.1/a", "10.2/b", None, None]
    assert one(spark, T.author_key, "Smith, J. K.", "Plato", "Lee,", " , A", "  ", "O, 3, B", None) == ["smith|j", "plato", "lee", None, None, "o", None]
    assert one(spark, T.repo_of, "https://github.com/A/b.git", "https://x.org/a/b") == ["a/b", None]
    assert one(spark, T.ip_key, "10.0.0.1", "2001:DB8::1", "2001:db8:0:0:0:0:0:1", "?", None) == ["10.0.0.1", "2001:db8:0:0", "2001:db8:0:0", "?", "unknown"]
    assert one(spark, T.ip_key, "", "::ffff:1.2.3.4", "2001:DB8:1:2:3", "A::b::c", "::", "2001:0db8::ff00:42:8329") == ["unknown", "0:0:0:0", "2001:db8:1:2", "a::b::c", "0:0:0:0", "2001:db8:0:0"]


def test_rules(spark):
    assert one(spark, T.licence_tier, "GPL-3.0", "CC BY-NC-SA", "MIT", "?", None) == ["copyleft", "restricted", "permissive", "unknown", "unknown"]
    assert one(spark, T.citation_band, 1000, 999, 10, 0, None, kind="int") == ["1000plus", "100to999", "10to99", "under10", None]
    assert one(spark, T.normal_query, " A  b ", "x", "a@b", "1234567", "123456", "q" * 81) == ["a b", None, None, None, "123456", None]
    licences = {"CC-BY-ND-4.0": "restricted", "Controlled access": "restricted", "dbGaP": "restricted", "Non commercial": "restricted", "not public": "restricted", "NCSA": "permissive", "EPL-2.0": "copyleft", "CC BY SA": "copyleft", "Zlib": "permissive", "0BSD": "permissive", "permit": "unknown", " ": "unknown", "egalitarian": "unknown"}
    assert one(spark, T.licence_tier, *licences) == list(licences.values())
    subjects = ["feat(papers): add y burger (#12)", "Plain", "feat(x): add y", "feat(datasets, ui): Catalogue a scaffold atlas", "feat(data): additional rows", "fix(software): add  (#3)", "feat(software): integrate iGEM agent", None]
    assert [r and tuple(r) for r in one(spark, T.commit_subject, *subjects)] == [("Paper", "Y burger", "sensory"), None, None, ("Dataset", "A scaffold atlas", "scaffolding"), None, None, ("Software", "IGEM agent", "tooling"), None]
    assert one(spark, T.compact_count, 999, 1000, 4626, 999_949, 999_950, 1_234_567, 1_250_000, 12_345, 5_000_000_000, None, kind="long") == ["999", "1K", "4.6K", "999.9K", "1M", "1.2M", "1.3M", "12.3K", "5B", None]
    assert one(spark, T.accession, "in CRA12 and GSE1", "PRJXYZ9", "xSRP5", "ERP1 MSV2", "E-MTAB-96", None) == ["CRA12", "PRJXYZ9", "SRP5", None, "E-MTAB-96", None]
    assert one(spark, T.id_accession, "ds:gse158430-2", "ds:e-mtab-9622", "ds:some-title") == ["GSE158430", "E-MTAB-9622", "SOME-TITLE"]
    assert one(spark, lambda c: T.deposit_accession(F.lit("ds:gse1-2"), c), "see gsm77", "none", None) == ["GSM77", "GSE1", "GSE1"]
    assert one(spark, lambda c: T.seed_text(F.split(c, r"\|")), "[The] `big` *blue* one|x GSE9", "[The] `big` *blue* one|x") == ["GSE9", "The-big-blue"]
    assert one(spark, T.is_item_id, "paper:12", "paper:012", "ds:a-1", "ds:-a", None) == [True, False, True, False, False]
    assert one(spark, T.entry_kind, "Genome-scale atlas", "Single cell", "GEMs", "a GEM") == ["gem", "atlas", "other", "gem"]
    assert one(spark, T.area_of, "Allergenicity predictors", "Food Intelligence", "iGEM gem", "Gemini", "Multimedia") == ["foodsafety", "tooling", "metabolic", "tooling", "tooling"]
    assert one(spark, T.without_volume, "Nature, 37", "Cell. ", "Bio 2, 37*(1)") == ["Nature", "Cell", "Bio 2, 37*(1)"]
    assert one(spark, T.media_kind, "https://youtu.be/abcdefghijk", "https://www.youtube.com/playlist?list=1", "x") == ["video", "playlist", "link"]
    assert one(spark, lambda c: T.works_url(F.split(c, " "), "w?"), "10.1/a 10.2/b") == ["w?10.1%2Fa|10.2%2Fb"]
    assert one(spark, lambda c: T.one_line(c, 5), "a\n\tb\u0000c  def") == ["a b c"]
    assert one(spark, T.plain_text, "[Title](u) `x` **b** _i_ snake_case a\\|b") == ["Title x b i snake_case a|b"]
    assert one(spark, T.string_list, '["a","b"]', "no", None) == [["a", "b"], [], []]
    assert one(spark, T.links_in, "see https://a.b/c, https://a.b/c and http://d.") == [["https://a.b/c", "http://d"]]


def test_components_ignore_loops_and_nulls(spark):
    e = spark.createDataFrame([(1, 2), (3, 2), (5, 6), (7, 7), (None, 1), (9, 8), (8, 10), (10, 6)], "src long, dst long")
    got = {r["id"]: r["component"] for r in graph.connected_components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 8: 5, 9: 5, 10: 5}
    assert graph.connected_components(e.where("src > 100")).count() == 0


def test_long_path(spark):
    e = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graph.connected_components(e).agg(F.max("component"), F.count("*")).first() == (0, 201)


def test_suffixes_and_runs(spark):
    d = spark.createDataFrame([(i, "a") for i in range(28)], "id int, base string")
    got = {r["id"]: r["slug"] for r in enrich.letter_suffix(d, "base", ["id"], dash=False).collect()}
    assert (got[0], got[1], got[25], got[26]) == ("a", "ab", "az", "a-26")
    ids = spark.createDataFrame([(1,), (2,), (70000,), (70001,), (200000,), (2,), (None,)], "id long")
    gaps, runs = enrich.id_runs(ids, "id")
    assert sorted(map(tuple, gaps.collect())) == [(3, 69999), (70002, 199999)]
    assert sorted(map(tuple, runs.collect())) == [(1, 2), (70000, 70001), (200000, 200000)]


def test_checks_and_changes(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "z"), (3, "w")], "k int, v string")
    assert checks.orphans(a, "k", b, "k", "c").collect()[0]["violation_key"] == "2"
    assert [r["violation_key"] for r in checks.duplicates(a, ["k"], "c").collect()] == ["2"]
    assert sorted(map(tuple, dml.upsert(a.where("k = 1"), b, "k").collect())) == [(1, "z"), (3, "w")]
    assert dml.remove({"a": a}, b.select("k"), {"a": "k"})["a"].count() == 2
    assert dml.insert_ignore(b, a, "k").count() == 3


def test_stream_limiter_agrees_with_batch(spark, tmp_path):
    rows = [(i, i % 3, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=7 * i)) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = {r["event_id"]: r["refused"] for r in events.rate_limited(df, "user_id", 2, "60 seconds").collect()}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = events.rate_limit_stream(s, 2, 60).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["event_id"]: r["refused"] for r in spark.table("limited").collect()} == batch
    assert any(batch.values()) and not all(batch.values())


def test_changes_are_checked_before_they_stand(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    gone = spark.createDataFrame([(9,)], "k int")
    out = dml.remove_with_tombstones({"a": a}, a.where("k = 1").select("k"), {"a": "k"}, gone)
    assert out["a"].count() == 1 and sorted(r[0] for r in out["tombstones"].collect()) == [1, 9]
    twice = spark.createDataFrame([(2, "b"), (2, "a"), (3, None)], "k int, v string")
    assert sorted(map(tuple, dml.upsert(a, twice, "k").collect()), key=str) == [(1, "x"), (2, "a"), (3, None)] and dml.changed(a, twice, "k") == 1
    assert sorted(map(tuple, dml.insert_ignore(a.where("k = 1"), twice, "k").collect()), key=str) == [(1, "x"), (2, "a"), (3, None)]
    once = dml.cleared(a, ["v"], twice.where("v IS NOT NULL"), "k")
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, dml.cleared(once, ["v"], twice.where("v IS NOT NULL"), "k").collect()), key=str) == [(1, None), (2, "a")]
    bad = lambda t: checks.duplicates(t["a"], ["k"], "twice")
    assert dml.checked({"a": a}, lambda t: t, bad)["a"].count() == 2
    with pytest.raises(ValueError, match="twice 1"):
        dml.checked({"a": a}, lambda t: {"a": t["a"].unionByName(t["a"].where("k = 1"))}, bad)


def test_faults_of_lists_and_round_trips(spark):
    rows = spark.createDataFrame([(1, ["A1", "A1", "x"], "A2"), (2, ["A1", "A2"], "A2"), (3, [], "A9"), (4, None, "A8")], "k int, m array<string>, own string")
    got = sorted(r["violation_key"] for r in checks.members(rows, "k", "m", "^A[0-9]$", "c", own="own").collect())
    assert got == ["1:shape:x", "1:shared:A1", "1:twice:A1", "2:own:A2", "3:empty:"]
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, v string")
    assert sorted(r["violation_key"] for r in checks.altered(a, a.distinct().withColumn("k", F.col("k")), "c").collect()) == ['-{"k":1,"v":"x"}']
    items = spark.createDataFrame([("sw:a", "software", "a"), ("db:b", "software", "b"), ("q:c", "odd", "c"), ("sw:d", "software", None)], "id string, type string, slug string")
    assert sorted(r["violation_key"] for r in checks.unlike_id(items, {"software": "sw"}, "c").collect()) == ["db:b", "q:c", "sw:d"]
    v = {r["check_name"]: (r["ok"], r["violations"]) for r in checks.verdicts(["a", "b"], checks.duplicates(a, ["k"], "a")).collect()}
    assert v == {"a": (False, 1), "b": (True, 0)}


def test_gates_in_order(spark):
    ok, site = '{"name":"search","props":{"search_term":"beef","result_count":3}}', "https://site.example"
    rows = [
        (1, "OPTIONS", None, None, True), (2, "GET", site, ok, False), (3, None, site, ok, False), (4, "POST", "https://x.example", "no", True), (5, "POST", "https://x.example", "no", False),
        (6, "POST", "", "no", False), (7, "POST", None, "null", False), (8, "POST", site, "[1]", False), (9, "POST", site, '{"name":"other"}', False), (10, "POST", site, ok, False), (11, "POST", site, None, False),
    ]
    p = events.disposed(spark.createDataFrame(rows, "event_id int, method string, origin string, body string, refused boolean"), site, "refused")
    assert [r["disposition"] for r in p.orderBy("event_id").collect()] == [204, 405, 405, 429, 403, 400, 400, 400, 204, 204, 400]
    assert sorted(r["event_id"] for r in events.dead_letters(p).collect()) == [1, 4, 5, 6, 7, 8, 11]
    assert [tuple(r) for r in events.points(p.where("disposition = 204")).select("event_id", "index", "blobs", "number").collect()] == [(10, "search", ["search", "beef"], 3.0)]


def test_only_posts_are_charged(spark):
    rows = [(i, 1, m, f"2024-01-01 00:00:0{i}") for i, m in enumerate(["GET", "POST", None, "POST", "OPTIONS", "POST"])]
    e = spark.createDataFrame(rows, "event_id int, user_id int, method string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r["event_id"] for r in events.limited_posts(e, "user_id", 2, "1 hour").where("refused").collect()] == [5]


def test_numbers_as_a_script_reads_them(spark):
    given = {"null": 0.0, '""': 0.0, '" \\t"': 0.0, '"12"': 12.0, '" .5e1 "': 5.0, '"0x1F"': 31.0, '"1_0"': -1.0, '"NaN"': -1.0, '"Infinity"': -1.0, "true": 1.0, "false": 0.0, "[]": 0.0, "{}": -1.0, "[1, 2]": -1.0, "-2.25": -2.25, "1e400": -1.0}
    df = spark.createDataFrame([(i, f'{{"x": {v}}}') for i, v in enumerate([*given, "7"])], "i int, j string")
    got = df.select("i", events.number_of(F.try_variant_get(F.try_parse_json("j"), "$.x", "variant")).alias("n"), events.number_of(F.try_variant_get(F.try_parse_json("j"), "$.y", "variant")).alias("none")).orderBy("i").collect()
    assert [r["n"] for r in got] == [*given.values(), 7.0] and {r["none"] for r in got} == {-1.0}
