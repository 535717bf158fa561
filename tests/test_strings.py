"""Functions on strings with odd cases, the grid as a table, and inventories in full."""

from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.operators import enrich, sets
from shelfmark.sources import catalogue


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r["x"] for r in df.select("i", f(F.col("c")).alias("x")).orderBy("i").collect()]


def test_links_that_leave_the_site(spark):
    f = lambda c: T.outbound(c, "https://Site.example/", ("note", "q"))
    got = one(spark, f, "https://a.example", " http://WWW.A.example:80/x?q=1&k=2#f ", "https://site.example/y", "http://site.example/y", "https://u@dx.doi.org/10.1/x#s", "ftp://a.b", "//b.example?note", "x.md", "", None, "https:///none", "https://a.example:8443/?b")
    assert [r and tuple(r) for r in got] == [
        ("https://a.example/", "a.example", "external"), ("http://www.a.example/x?k=2", "a.example", "external"), None, ("http://site.example/y", "site.example", "external"), ("https://dx.doi.org/10.1/x", "dx.doi.org", "doi"), None,
        ("https://b.example/", "b.example", "external"), None, None, None, None, ("https://a.example:8443/?b", "a.example", "external"),
    ]
    kept = one(spark, lambda c: T.outbound(c, "https://s.example"), "https://a.example/?a=b+c&note=1")
    assert kept[0]["url"] == "https://a.example/?a=b+c&note=1"


def test_notes_and_dois_are_bounded_in_both_lengths(spark):
    assert one(spark, T.encoded_length, "az-_.!~*'()", " é€🙂", "", None) == [11, 3 * (1 + 2 + 3 + 4), 0, None]
    a, b, c, d = one(spark, T.one_line, "x" * 500, "é" * 400, "🙂" * 300 + "x", None)
    assert a == "x" * 400 and b == "é" * 233 and c == "🙂" * 116 and d is None
    assert one(spark, lambda x: T.one_line(x, 9, 9), "﻿ a​\u0085 b  ", "abc d efgh") == ["a b", "abc d"]
    shaped = one(spark, T.is_doi, "doi:10.1234/x", "https://doi.org/10.1234/" + "x" * 191, "10.1234/" + "x" * 193, "10.1234/" + "é" * 97, "10.1234/" + "é" * 99, "10.1234/a​b", "10.123/x", "10.1234/a?b", "", None)
    assert shaped == [True, True, False, True, False, False, False, False, False, False]


def test_addresses_and_journals(spark):
    keys = one(spark, T.ip_key, "1.2.3.4", "2001:DB8::1", "2001:0db8:0:0:5:6:7:8", "::1", "1::", "::ffff:1.2.3.4", "A::b::C", "::", ":1", "", None)
    assert keys == ["1.2.3.4", "2001:db8:0:0", "2001:db8:0:0", "0:0:0:0", "1:0:0:0", "0:0:0:0", "a::b::c", "0:0:0:0", "0:1", "unknown", "unknown"]
    assert one(spark, T.without_volume, " Nature, 12. ", "Nature., 3", "Food, Inc.", "Vol 12", "A,1,2", "", None) == ["Nature", "Nature", "Food, Inc", "Vol 12", "A,1", "", None]
    assert one(spark, T.last_segment, " https://w.example/W1 ", "W2", "x/", "", None) == ["w1", "w2", "", "", None]


def test_routes_by_a_table_of_pages(spark):
    rows = [("a/b.md", "c.md#x"), ("a/b.md", "../d/"), ("b.md", "./e.MD"), ("a/b.md", "https://x"), ("a/b.md", None), ("a/b.md", "../../up.md"), (None, "c.md")]
    pages = spark.createDataFrame([("a/c",), ("d/README",), (None,)], "p string")
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, source string, url string")
    got = {r["i"]: r["link"] for r in enrich.routed(d, "url", "source", pages, "/s/", "https://blob").collect()}
    assert [got[i] for i in range(6)] == ["/s/a/c/", "/s/d/README/", "https://blob/e.MD", "https://x", None, "https://blob/../up.md"] and len(got) == 7


def test_a_grid_as_a_table(spark):
    cells = spark.createDataFrame([("m", "b", 2, "Two", 2), ("m", "b", 1, "One", 1), ("m", "x", 9, "gone", 0), ("z", "a", 9, "gone", 0)], "method string, area_key string, ref_id int, label string, ordinal int")
    areas = spark.createDataFrame([("b", "[B](t)", 2), ("a", "A", 1)], "key string, header_md string, ordinal int")
    methods = spark.createDataFrame([("n", "N", 2), ("m", "**M**", 1)], "label string, header_md string, ordinal int")
    lines = [r["line"] for r in catalogue.matrix_table(cells, areas, methods).orderBy("place").collect()]
    assert lines == ["| | A | [B](t) |", "|---|---|---|", "| **M** |  | [One](#1)<br>[Two](#2) |", "| N |  |  |"]


def test_inventories_resolve_members_over_all_pages(spark):
    tables = spark.createDataFrame([("p", 0, ["Name", "Data"]), ("q", 0, ["Name", "Data"]), ("q", 1, ["x", "y"]), ("r", 0, ["N", "N"])], "page string, row int, cells array<string>")
    rows = spark.createDataFrame(
        [("ds:a", "q", 1, ["*A*", "gse1 https://x.y/1."], '["GSE2", "GSE1", "GSE9"]'), ("ds:b", "p", 9, ["B", "GSE1, GSE2"], None), ("ds:gse2", "q", 2, ["C", None], "no"), ("ds:d", "q", 3, ["D"], None), ("ds:e", "r", 1, ["E", "x"], None), ("ds:f", "s", 1, ["F", "x"], None)],
        "item_id string, page string, ordinal int, cells array<string>, subseries string",
    )
    pages = spark.createDataFrame([("q", 0)], "page string, rank int")
    topics = spark.createDataFrame([("ds:a", "t2"), ("ds:a", "t1"), ("ds:zz", "t")], "item_id string, slug string")
    model, faults = catalogue.inventory_books(rows, tables, pages, topics)
    got = {r["item_id"]: r for r in model.collect()}
    assert [(m["accession"], m["id"]) for m in got["ds:a"]["subseries"]] == [("GSE2", "ds:gse2"), ("GSE1", "ds:a"), ("GSE9", None)]
    assert (got["ds:a"]["name"], got["ds:a"]["links"], got["ds:a"]["topics"]) == ("A", ["https://x.y/1"], ["t1", "t2"]) and got["ds:b"]["topics"] == [] and got["ds:gse2"]["subseries"] == []
    assert sorted(tuple(r) for r in faults.collect()) == [("label twice", "ds:e"), ("length", "ds:d"), ("no table", "ds:f")]


def test_lists_by_kind_and_nested_sizes(spark):
    rows = spark.createDataFrame([("a", "x", 2), ("a", "x", 1), ("b", "z", 1), (None, "y", 3)], "tag string, kind string, id int")
    assert sorted((tuple(r) for r in sets.inverted(rows, "tag", "kind", "id", ["x", "y"]).collect()), key=str) == [("a", [1, 2], []), ("b", [], []), (None, [], [3])]
    lists = spark.createDataFrame([([[1, 2], None, [], [3]],), (None,)], "l array<array<int>>")
    assert [r["n"] for r in lists.select(sets.nested_size(F.col("l")).alias("n")).collect()] == [3, 0]
