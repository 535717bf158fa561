import pytest
from pyspark.errors import PySparkException

from shelfmark.operators import enrich
from shelfmark.sources import catalogue, markdown, ndjson
from shelfmark.streaming import events

TEXT = "lost\n# Top\n## One ##\na\n### in\nb\n\n## Two\n# Next\nnot here\n\n| h | k |\n|---|:-:|\n| 1 |  |\n| x\\|y | 2 |\n\n| other |\n"


def test_ndjson(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "a")], "id long, v string")
    ndjson.write(df, str(tmp_path / "t"), ["id"])
    again = ndjson.read(spark, str(tmp_path / "t"), "id long, v string")
    assert sorted(map(tuple, again.collect())) == [(1, "a"), (2, None)]
    assert ndjson.read(spark, str(tmp_path / "absent"), "id long").count() == 0
    with pytest.raises(PySparkException, match="unknown fields: v"):
        ndjson.read(spark, str(tmp_path / "t"), "id long").collect()


def test_markdown(spark):
    d = spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "id int, text string")
    got = [tuple(r) for r in markdown.sections(d, "id", "text", 2).orderBy("ordinal").collect()]
    assert got == [(1, 2, "One", "a\n### in\nb"), (1, 7, "Two", "")]
    cells = {(r["row"], r["col"]): r["cell"] for r in markdown.table_cells(d, "id", "text").collect()}
    assert cells == {(0, 0): "h", (0, 1): "k", (1, 0): "1", (1, 1): "", (2, 0): "x\\|y", (2, 1): "2"}


REFS = """# Top
## Refs

<a id="3">3</a> De Boer, J. van, Center for Testing, & Solo (2020b). *A Title.* Venue. https://doi.org/10.1/AB(2019)v2.

> **Code**: https://c.org/x
> **Code**: https://second

> **Data**: [d](https://d.org/y)

Between.

> **Models**: https://lost

<a id="4">4</a> Nobody known, undated.

```
<a id="9">9</a> in code (2001). *x*
```
"""


def test_references(spark):
    d = spark.createDataFrame([(1, REFS), (2, None), (3, "")], "id int, text string").withColumnRenamed("id", "page")
    got = {r["id"]: r for r in catalogue.references(d, "page", "text").collect()}
    assert sorted(got) == [3, 4]
    r = got[3]
    assert (r.authors, r.authors_dropped, r.year, r.title, r.journal, r.doi) == (["De Boer, J. van", "Center for Testing"], 1, 2020, "A Title", "Venue", "10.1/AB(2019)v2")
    assert (r.section, r.code_url, r.data_url) == ("Refs", "https://c.org/x", "https://d.org/y")
    assert got[4].authors is None and got[4].year is None and got[4].authors_text == "Nobody known, undated." and got[4].code_url is None


def test_spliced_reports_what_it_would_lose(spark):
    d = spark.createDataFrame([(1, REFS)], "page int, text string")
    rows = spark.createDataFrame([(1, "Refs", 5, "raw", "> q"), (1, "None", 6, "raw", None)], "page int, section string, id long, raw string, quotes string")
    placed, lost = catalogue.spliced(d, "page", "text", rows)
    assert [(r["ordinal"], r["block"]) for r in placed.collect()] == [(5, "raw\n\n> q")]
    assert [r["violation_key"] for r in lost.collect()] == ["1:None:6"]


def test_cache_and_files(spark, tmp_path):
    (tmp_path / "good.json").write_text('[{"a": 1},\n {"a": 2}]')
    (tmp_path / "bad.json").write_text('[{"a": "x"}')
    read = lambda name: sorted(r["a"] for r in catalogue.read_cache(spark, str(tmp_path / name), "a int").collect())
    assert read("good.json") == [1, 2] and read("bad.json") == [] and read("none.json") == []
    (tmp_path / "x").mkdir()
    for n in ("a.md", "b.md", "c.txt"):
        (tmp_path / "x" / n).write_text("x")
    assert [r["n"] for r in catalogue.count_files(spark, str(tmp_path), exclude=["b.md"]).collect()] == [1]


def test_points_are_appended_from_a_stream(spark, tmp_path):
    good, schema = '{"name": "outbound_click", "props": {"link_domain": "x.example"}}', "event_id long, method string, origin string, body string"
    spark.createDataFrame([(1, "POST", None, good), (2, "POST", None, "no"), (3, "POST", "https://site.example", good), (4, "GET", None, good), (5, "POST", "https://x.example", good), (6, "POST", None, '{"name": "x"}')], schema).write.json(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    for _ in range(2):
        events.append_points(s, str(tmp_path / "out"), str(tmp_path / "mark"), "https://site.example").awaitTermination(60)
    assert sorted((r["event_id"], r["blobs"][1]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "external"), (3, "external")]


def test_free_ids(spark):
    names = ["a", "b", "a", "a-2", "a", "a-2", "a-2-2", "a", "c", "a-5", "a-3", None, "a", "a-02", "c"]
    df = spark.createDataFrame(list(enumerate(names)), "i int, base string")
    taken, want = {"c"}, {}
    for i, b in enumerate(names):
        if b is not None:
            x, n = b, 2
            while x in taken:
                x, n = f"{b}-{n}", n + 1
            taken.add(x)
            want[i] = x
    got = {r["i"]: r["item"] for r in enrich.free_ids(df, "base", ["i"], spark.createDataFrame([("c",)], "item string"), "item").collect()}
    assert {i: x for i, x in got.items() if x is not None} == want and got[11] is None


def test_free_ids_at_random(spark):
    import random

    r = random.Random(5)
    for _ in range(3):
        names = [r.choice(["x", "y"]) + r.choice(["", "", "-2", "-3", "-4", "-2-2", "-7"]) for _ in range(60)]
        before = sorted({r.choice(["x", "x-2", "x-3", "y-6", "x-2-2"]) for _ in range(3)})
        taken, want = set(before), []
        for b in names:
            x, n = b, 2
            while x in taken:
                x, n = f"{b}-{n}", n + 1
            taken.add(x)
            want.append(x)
        df = spark.createDataFrame(list(enumerate(names)), "i int, base string")
        got = enrich.free_ids(df, "base", ["i"], spark.createDataFrame([(b,) for b in before], "item string"), "item").orderBy("i").collect()
        assert [g["item"] for g in got] == want
