"""Items added by descriptors: ids, places, refusals and the swap of versions."""

import pytest

from shelfmark.operators import additions, checks, dml, enrich


def store(spark):
    rows = {
        "items": [("paper:4", "paper", "4"), ("sw:tool", "software", "tool"), ("ds:gse7", "dataset", "gse7")],
        "papers": [("paper:4", 4, "References", "raw", None, 9)],
        "retired_paper_ids": [(6,)],
        "areas": [("cell", "Cells"), ("Cells", "Other")],
        "methods": [("Learning",)],
        "catalog": [("sw:tool", "Tool", "u", "g", "[Tool](u)", "", 3)],
        "topics": [("topic:beef", "beef")],
    }
    return {name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in additions.TABLES.items()}


def spec(number, type, **fields):  # noqa: A002
    names = [f.split()[0] for f in additions.SPEC.replace("array<struct<method:string,area:string>>", "x").split(", ")]
    return tuple((fields | {"spec": number, "type": type}).get(n) for n in names)


def specs(spark, *rows):
    return spark.createDataFrame(list(rows), additions.SPEC)


GOOD = [
    spec(3, "paper", raw='<a id="4">4</a> Doe (2001).', label="D", code_url="c", data_url="", blockquotes=["> **M**: m"], cells=[("Learning", "Cells"), ("Learning", "cell")], topics=["beef", "beef"]),
    spec(1, "paper", raw="Roe (2002).", label="R"),
    spec(2, "software", name="Tool", url="v", grp="g"),
    spec(5, "software", name="Tool", url="w", grp="h", body="text"),
    spec(4, "database", name="Tool", url="x", grp="g"),
    spec(6, "dataset", page="Cow", row=["see GSE7", "a"]),
    spec(7, "dataset", page="Cow", row=["**New [herd]** of cows here"]),
]


def test_shapes_ids_and_places(spark):
    tables, ids = additions.add_items(store(spark), specs(spark, *GOOD), spark.createDataFrame([("Cow",)], "p string"))
    assert {r["spec"]: r["item_id"] for r in ids.collect()} == {1: "paper:7", 3: "paper:8", 2: "sw:tool-2", 5: "sw:tool-3", 4: "db:tool", 6: "ds:gse7-2", 7: "ds:new-herd-of"}
    get = lambda name: sorted(map(tuple, tables[name].collect()), key=str)
    assert get("papers") == [
        ("paper:4", 4, "References", "raw", None, 9), ("paper:7", 7, "References", '<a id="7">7</a> Roe (2002).', None, 10), ("paper:8", 8, "References", '<a id="8">8</a> Doe (2001).', "> **Code**: c\n\n> **M**: m", 11),
    ]
    # A label names its area unless it is the key of another.
    assert get("matrix_cells") == [("Learning", "Cells", 8, "D", 1), ("Learning", "cell", 8, "D", 2)]
    assert [r[0::6] for r in get("catalog")] == [("db:tool", 1), ("sw:tool", 3), ("sw:tool-2", 4), ("sw:tool-3", 5)]
    assert get("dataset_rows") == [("ds:gse7-2", "Cow", '["see GSE7","a"]', 1), ("ds:new-herd-of", "Cow", '["**New [herd]** of cows here"]', 2)]
    assert get("item_topics") == [("paper:8", "topic:beef")] and tables["items"].count() == 10


def test_a_refused_batch_names_its_faults_and_changes_nothing(spark):
    bad = [spec(1, "paper", raw="r", section="Gone", cells=[("Guess", "nowhere")]), spec(2, "table"), spec(3, None), spec(4, "dataset", page="Pig"), spec(5, "software", name="n", topics=["odd", None]), spec(6, "paper"), spec(6, "paper", raw="x")]
    pages = spark.createDataFrame([("Cow",)], "p string")
    got = sorted(tuple(r) for r in additions.refused(store(spark), specs(spark, *bad), pages).collect())
    assert got == [("area", "1:nowhere"), ("method", "1:Guess"), ("missing", "5:url"), ("missing", "6:raw"), ("no cells", "4:"), ("number", "6"), ("page", "4:Pig"), ("section", "1:Gone"), ("topic", "5:"), ("topic", "5:odd"), ("type", "2:table"), ("type", "3:")]
    with pytest.raises(ValueError, match="area 1:nowhere; method 1:Guess"):
        additions.add_items(store(spark), specs(spark, *bad), pages)


def test_versions_change_by_one_swap(spark, tmp_path):
    root, pages = str(tmp_path), spark.createDataFrame([("Cow",)], "p string")
    n, empty = additions.load(spark, root)
    assert n == 0 and empty["items"].count() == 0
    assert additions.publish(spark, root, store(spark), 0) == 1
    n, old = additions.load(spark, root)
    new = dml.checked(old, lambda x: additions.add_items(x, specs(spark, *GOOD), pages)[0], lambda x: checks.duplicates(x["items"], ["id"], "twice"))
    assert additions.publish(spark, root, new, n) == 2
    # Another writer that began from the same version comes too late, and a refused change publishes nothing.
    with pytest.raises(ValueError, match="not the current one"):
        additions.publish(spark, root, old, n)
    n, now = additions.load(spark, root)
    with pytest.raises(ValueError, match="twice"):
        dml.checked(now, lambda x: x | {"items": x["items"].unionByName(x["items"].limit(1))}, lambda x: checks.duplicates(x["items"], ["id"], "twice"))
    assert n == 2 and now["items"].count() == 10 and now["papers"].where("blockquotes_md IS NULL").count() == 2


def test_places_in_ranges(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 AS g", "pmod(hash(id), 100) AS v").repartition(6)
    got = enrich.places(df, ["v", "id"], "n").collect()
    want = sorted((r["v"], r["id"]) for r in got)
    assert all(want[r["n"]] == (r["v"], r["id"]) for r in got) and len(got) == 1000
    own = {}
    for r in sorted(enrich.places(df, ["v", "id"], "n", by="g").collect(), key=lambda r: (r["g"], r["v"], r["id"])):
        assert r["n"] == own.get(r["g"], 0)
        own[r["g"]] = r["n"] + 1
    assert enrich.places(df.limit(0), ["v"], "n").collect() == []
