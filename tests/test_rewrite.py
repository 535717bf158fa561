"""Documents written again, by hand-written Markdown; assertions in plans."""

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from shelfmark.operators import asserts
from shelfmark.sources import rewrite

PAPERS = """# Papers

Intro with [a link](x).

| | A |
|--|--|
| m | [x](#1) |

## References

Lead.

<a id="2">2</a> Old two.
goes on

> **Code**: c

> second quote

<a  id="1">1</a> Old one.

Between.

> a quote of its own

## Empty

No anchors.

```
<a id="9">9</a> in code
## no heading
```

## More

<a id="3">3</a> Three.
"""


def text_of(frames):
    docs, bad = frames
    return {r["page"]: r["text"] for r in docs.collect()}, sorted(tuple(r) for r in bad.collect())


def test_references_stand_where_the_first_one_stood(spark):
    docs = spark.createDataFrame([(1, PAPERS, "x"), (2, "plain\n", "y"), (3, None, "z")], "page int, text string, raw string")
    rows = [(1, "References", 2, '<a id="4">4</a> Four.', None), (1, "References", 1, '<a id="1">1</a> One.', "> q"), (1, "Empty", 3, "lost", None), (2, "References", 4, "lost", None), (9, "References", 5, "lost", None)]
    text, bad = text_of(rewrite.references(docs, "page", "text", spark.createDataFrame(rows, "page int, section string, ordinal int, raw string, quotes string")))
    new = PAPERS.replace('<a id="2">2</a> Old two.\ngoes on\n\n> **Code**: c\n\n> second quote\n\n<a  id="1">1</a> Old one.', '<a id="1">1</a> One.\n\n> q\n\n<a id="4">4</a> Four.').replace('\n\n<a id="3">3</a> Three.', "")
    assert text == {1: new, 2: "plain\n"}
    assert bad == [("no anchor", "1:Empty:3"), ("no anchor", "2:References:4"), ("no anchor", "9:References:5")]


CATALOGUE = """Top.

## A

Intro.

### plain heading

### [One](u)

Old.

### not linked, in the body

## B

### [Two](v)

## C

Only prose.
"""


def test_entries_keep_groups_and_introductions(spark):
    docs = spark.createDataFrame([(1, CATALOGUE)], "page int, text string")
    rows = [(1, "C", 5, "[Five](z)", "B5"), (1, "A", 2, "[One](u)", ""), (1, "New", 4, "[Four](y)", None), (1, "A", 1, "[Zero](t)", "Z\n\nz"), (1, "Other", 3, "[Three](x)", "b"), (7, "A", 6, "h", "")]
    text, bad = text_of(rewrite.entries(docs, "page", "text", spark.createDataFrame(rows, "page int, grp string, ordinal int, heading_md string, body_md string")))
    want = "Top.\n\n## A\n\nIntro.\n\n### plain heading\n\n### [Zero](t)\n\nZ\n\nz\n\n### [One](u)\n\n## B\n\n## C\n\nOnly prose.\n\n### [Five](z)\n\nB5\n\n## Other\n\n### [Three](x)\n\nb\n\n## New\n\n### [Four](y)\n"
    assert text == {1: want} and bad == [("no document", "7:6")]


PAGE = """# Cow

## Atlases

### Old A

old

#### deeper

### Old B

## Complete data inventory

Lead.

| Name | Link | N |
|:--|--|--:|
| x | y | z |

| other |
|--|

## Notes

end
"""


def test_pages_get_their_rows_and_entries_by_place(spark):
    docs = spark.createDataFrame([(1, PAGE), (2, PAGE), (3, "## Notes\n")], "page int, text string")
    rows = spark.createDataFrame([(1, 2, ["c", "d", "e"]), (1, 1, ["a", "b", None]), (3, 1, ["lost"])], "page int, ordinal int, cells array<string>")
    curated = spark.createDataFrame([(1, 20, "New B", ""), (1, 10, "New A", "body"), (2, 1, "One", "")], "page int, ordinal int, heading_md string, body_md string")
    text, bad = text_of(rewrite.dataset_pages(docs, "page", "text", "Complete data inventory", rows, curated))
    want = PAGE.replace("### Old A\n\nold\n\n#### deeper\n\n### Old B", "### New A\n\nbody\n\n### New B").replace("|:--|--|--:|\n| x | y | z |", "|---|---|---|\n| a | b |\n| c | d | e |")
    assert text == {1: want, 2: PAGE, 3: "## Notes\n"}
    assert bad == [("entries and rows unlike", "2"), ("no table", "3:1")]


def test_assertions_end_the_job_that_reads_a_bad_row(spark):
    a = spark.createDataFrame([(1, 5), (1, 3), (None, 1)], "g int, x int")
    b = spark.createDataFrame([(1, 20), (1, 10), (None, 7)], "g int, y int")
    got = sorted(map(tuple, asserts.positional(a, b, "g", ["x"], ["y"]).select("g", "position", "x", "y").collect()), key=str)
    assert got == [(1, 0, 3, 10), (1, 1, 5, 20), (None, 0, 1, 7)]
    with pytest.raises(SparkRuntimeException, match="one side only: g 1 from position 1"):
        asserts.positional(a, b.where("y <> 20"), "g", ["x"], ["y"]).collect()
    assert [tuple(r) for r in asserts.exactly_one(a, "g", F.col("x") < 4).orderBy("g").collect()] == [(None, 1), (1, 3)]
    for least, n in ((9, 2), (0, 0)):
        with pytest.raises(SparkRuntimeException, match=f"g 1 has {n}"):
            asserts.exactly_one(a.where("g = 1"), "g", F.col("x") < least).collect()
