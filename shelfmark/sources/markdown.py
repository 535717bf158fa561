"""Markdown documents as rows, by built-in functions: headings with their bodies, and table cells. Lines of fenced code are neither."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, ordinal, line, code, depth``; ``code`` holds for fences and what they enclose, depth is that of a heading, else null."""
    d = docs.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("ordinal", "line"))
    fence = F.col("line").rlike(r"^ {0,3}(```|~~~)").cast("int")
    before = F.sum(fence).over(Window.partitionBy(key).orderBy("ordinal"))
    marks = F.regexp_extract("line", r"^(#{1,6})\s", 1)
    d = d.withColumn("code", (fence == 1) | (before % 2 == 1))
    return d.withColumn("depth", F.when(~F.col("code") & (marks != ""), F.length(marks)))


def sections(docs: DataFrame, key: str, text: str, depth: int) -> DataFrame:
    """``key, ordinal, heading, body`` of the sections of one depth: deeper headings stay inside, a shallower one closes, what stands before is dropped."""
    w = Window.partitionBy(key).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    # The last heading at this depth or above decides; one above belongs to no section.
    start = F.last(F.when(F.col("depth") <= depth, F.struct("ordinal", "depth", "line")), ignorenulls=True).over(w)
    inside = lines(docs, key, text).withColumn("s", start).where(F.col("s.depth") == depth)
    body = F.array_sort(F.collect_list(F.when(F.col("ordinal") > F.col("s.ordinal"), F.struct("ordinal", "line"))))
    out = inside.groupBy(key, F.col("s.ordinal").alias("ordinal"), F.col("s.line").alias("line")).agg(body.alias("b"))
    heading = F.regexp_replace("line", r"^#{1,6}\s+|\s+#*\s*$", "")
    return out.select(key, "ordinal", heading.alias("heading"), F.trim(F.array_join(F.col("b.line"), "\n"), F.lit("\n ")).alias("body"))


def table_cells(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, row, col, cell`` of a document's first table; row 0 is the header, the rule under it is left out."""
    d = lines(docs, key, text).withColumn("in_table", ~F.col("code") & F.col("line").rlike(r"^\s*\|"))
    order = Window.partitionBy(key).orderBy("ordinal")
    d = d.withColumn("starts", (F.col("in_table") & ~F.coalesce(F.lag("in_table").over(order), F.lit(False))).cast("int"))
    d = d.withColumn("table", F.sum("starts").over(order)).where("in_table AND table = 1")
    d = d.where(~F.col("line").rlike(r"^\s*\|[\s:|-]+$")).withColumn("row", F.row_number().over(order) - 1)
    inner = F.regexp_replace("line", r"^\s*\||\|\s*$", "")
    return d.select(key, "row", F.posexplode(F.split(inner, r"(?<!\\)\|")).alias("col", "cell")).withColumn("cell", F.trim("cell"))
