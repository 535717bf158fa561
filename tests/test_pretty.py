"""Indented JSON arrays, and cells in their one inline form."""

import json

from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.sources import catalogue


def files(folder):
    return [f.read_text() for f in sorted(folder.glob("part-*"))]


def test_arrays_are_indented_and_in_order(spark, tmp_path):
    rows = [(i, None if i % 3 else f'q "{i}" \\ [x], {{y}}: é\n', [{"a": i, "b": []}] * (i % 3), {"k": 1.5}) for i in range(2500)]
    df = spark.createDataFrame(rows[::-1], "id int, note string, list array<struct<a:int,b:array<int>>>, more struct<k:double>")
    as_model = [{"id": i, "note": n, "list": x, "more": m} for i, n, x, m in rows]
    catalogue.write_pretty(df, f"{tmp_path}/one", ["id"], files=1)
    assert files(tmp_path / "one") == [json.dumps(as_model, indent=2, ensure_ascii=False) + "\n"]
    catalogue.write_pretty(df, f"{tmp_path}/three", ["id"], files=3)
    parts = files(tmp_path / "three")
    assert len(parts) == 3 and [x for p in parts for x in json.loads(p)] == as_model
    back = catalogue.read_pretty(spark, f"{tmp_path}/three", df.schema)
    assert back.exceptAll(df).isEmpty() and df.exceptAll(back).isEmpty()
    assert catalogue.read_pretty(spark, f"{tmp_path}/one", df.schema).count() == 2500


def test_a_table_without_rows_reads_as_none(spark, tmp_path):
    none = spark.createDataFrame([], "id int")
    catalogue.write_pretty(none, f"{tmp_path}/none", ["id"], files=1)
    assert {x.strip() for x in files(tmp_path / "none")} <= {"", "[]"}
    assert catalogue.read_pretty(spark, f"{tmp_path}/none", "id int").isEmpty()


def test_numbers_keep_their_digits():
    assert catalogue.indented('{"a":1.10,"b":[12345678901234567890,-0.0],"c":{},"d":"[1,2]"}') == '{\n  "a": 1.10,\n  "b": [\n    12345678901234567890,\n    -0.0\n  ],\n  "c": {},\n  "d": "[1,2]"\n}'


def test_cells_have_one_inline_form(spark):
    cases = {
        '[a](u "t")': "[a](u)", "![x](<i.png>)": "![x](i.png)", "[`_k_`](u_v 't')": "[`_k_`](u_v 't')", "__a b__ _c_ d_e_f __init__": "**a b** *c* d_e_f **init**", "_a_, (_b_)": "*a*, (*b*)", "~x~ ~~y~~": "~~x~~ ~~y~~",
        "`` a`b ``": "`a`b`", "` `": "` `", r"\*a\* \_b\_ c\d": r"*a* _b_ c\d", "a  \nb\\\nc\nd": "a b c\nd", "2 * 3 _ 4 _": "2 * 3 _ 4 _", "`open _x_": "`open *x*", "**_a_** *b*": "***a*** *b*", "": "", "<b>x</b>": "<b>x</b>",
    }
    df = spark.createDataFrame([(i, c) for i, c in enumerate([*cases, None])], "i int, c string")
    got = [r["x"] for r in df.select("i", T.inline_markdown(F.col("c")).alias("x")).orderBy("i").collect()]
    assert got == [*cases.values(), None]
    fixed = [x for c, x in cases.items() if "\\" not in c and "``" not in c]
    again = spark.createDataFrame([(i, c) for i, c in enumerate(fixed)], "i int, c string")
    assert [r["x"] for r in again.select("i", T.inline_markdown(F.col("c")).alias("x")).orderBy("i").collect()] == fixed
