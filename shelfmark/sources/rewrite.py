"""Markdown documents written again from rows: what rows own is replaced where it stands, everything else stays as it is.

Each function cuts documents into blocks (``catalogue.blocks``), drops those that rows own, puts the rows' blocks at their places among the others and joins all of them by blank lines, in the order of a few numbers. They give
``(documents, violations)``; documents are ``key, text``. A document is the unit: its blocks meet in one list. Rows that have no place are violations and are not written; ``asserts.asserted`` makes an error of any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.operators import checks
from shelfmark.sources import catalogue

LAST = 2**31 - 1


def _piece(key: str, a: Column, b: Column, c: Column, raw: Column) -> tuple[Column, ...]:
    return F.col(key), a.cast("long").alias("_a"), b.cast("long").alias("_b"), c.cast("long").alias("_c"), raw.alias("_raw")


def _joined(pieces: DataFrame, key: str) -> DataFrame:
    blocks = F.array_sort(F.collect_list(F.struct("_a", "_b", "_c", "_raw")))["_raw"]
    return pieces.groupBy(key).agg(F.concat(F.array_join(blocks, "\n\n"), F.lit("\n")).alias("text"))


def _violations(df: DataFrame, check: str, *parts: str) -> DataFrame:
    return df.select(F.lit(check).alias("check_name"), F.concat_ws(":", *[F.col(p).cast("string") for p in parts]).alias("violation_key"))


def _under(b: DataFrame, key: str) -> DataFrame:
    """Blocks with the second-level heading they stand under, itself included."""
    w = Window.partitionBy(key).orderBy("ordinal")
    return b.withColumn("section", F.last(F.when(F.col("depth") == 2, catalogue.title_of(F.col("raw"))), ignorenulls=True).over(w))


def references(docs: DataFrame, key: str, text: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` are ``key, section, ordinal, raw, quotes``. All of a section's rows stand where its first anchored paragraph stood; its anchored paragraphs and the quotes after them go. Rows of a section without an anchor are violations."""
    w = Window.partitionBy(key).orderBy("ordinal")
    b = _under(catalogue.blocks(docs, key, text), key)
    b = b.withColumn("_anchor", (F.col("kind") == "paragraph") & F.col("raw").rlike(catalogue.ANCHOR))
    before = F.last(F.when(F.col("kind") != "quote", F.col("_anchor")), ignorenulls=True).over(w)
    b = b.withColumn("_owned", F.col("_anchor") | (F.col("kind") == "quote") & F.coalesce(before, F.lit(False)))
    at = b.where("_anchor").groupBy(key, "section").agg(F.min("ordinal").alias("_at"))
    placed = rows.join(at, [key, "section"])
    zero = F.lit(0)
    kept = b.where("NOT _owned").select(*_piece(key, F.col("ordinal"), zero, zero, F.col("raw")))
    new = placed.select(*_piece(key, F.col("_at"), F.lit(1), F.col("ordinal"), F.concat_ws("\n\n", "raw", "quotes")))
    return _joined(kept.unionByName(new), key), _violations(rows.join(at, [key, "section"], "left_anti"), "no anchor", key, "section", "ordinal")


def entries(docs: DataFrame, key: str, text: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` are ``key, grp, ordinal, heading_md, body_md``. What stands before the first second-level heading stays, and of each group its heading and what stands before its first linked third-level heading; the rest of a group
    are its rows. A group that loses all of its rows keeps its heading; groups that only rows have follow at the end, by their first row. Rows of documents that are not there are violations."""
    b = _under(catalogue.blocks(docs, key, text), key)
    linked = (F.col("depth") == 3) & F.col("raw").rlike(catalogue.LINK)
    # Headings of one name are one group: entries stand after the first one's introduction.
    group = F.max(F.when(F.col("depth") == 2, F.col("ordinal"))).over(Window.partitionBy(key).orderBy("ordinal"))
    b = b.withColumn("_g", group).withColumn("_seen", F.max(linked).over(Window.partitionBy(key, "_g").orderBy("ordinal")))
    kept = b.where(F.col("section").isNull() | ~F.col("_seen"))
    ends = kept.where("section IS NOT NULL").groupBy(key, "section", "_g").agg(F.max("ordinal").alias("_at")).groupBy(key, "section").agg(F.min_by("_at", "_g").alias("_at"))
    known = rows.join(docs.select(key).distinct(), key, "left_semi").join(ends.withColumnRenamed("section", "grp"), [key, "grp"], "left")
    first = known.where("_at IS NULL").groupBy(key, "grp").agg(F.min("ordinal").alias("_first"))
    known = known.join(first, [key, "grp"], "left")
    body = F.concat(F.lit("### "), F.concat_ws("\n\n", "heading_md", F.nullif("body_md", F.lit(""))))
    zero = F.lit(0)
    pieces = kept.select(*_piece(key, F.col("ordinal"), zero, zero, F.col("raw")))
    pieces = pieces.unionByName(known.where("_at IS NOT NULL").select(*_piece(key, F.col("_at"), F.lit(1), F.col("ordinal"), body)))
    pieces = pieces.unionByName(first.select(*_piece(key, F.lit(LAST), F.col("_first"), F.lit(-1), F.concat(F.lit("## "), "grp"))))
    pieces = pieces.unionByName(known.where("_at IS NULL").select(*_piece(key, F.lit(LAST), F.col("_first"), F.col("ordinal"), body)))
    return _joined(pieces, key), _violations(rows.join(docs.select(key).distinct(), key, "left_anti"), "no document", key, "ordinal")


def dataset_pages(docs: DataFrame, key: str, text: str, heading: str, rows: DataFrame, curated: DataFrame, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """``rows`` are ``key, ordinal, cells`` of the first table under ``heading``, ``curated`` are ``key, ordinal, heading_md, body_md`` of headings of ``depth`` outside it, the n-th row for the n-th heading; the table keeps its header.

    Violations are rows of pages without such a table, and pages whose headings and rows are not as many; the latter keep their text.
    """
    w = Window.partitionBy(key).orderBy("ordinal")
    b = _under(catalogue.blocks(docs, key, text), key)
    inside = F.coalesce(F.col("section") == heading, F.lit(False))
    table = F.coalesce((F.col("kind") == "table") & inside, F.lit(False))
    entry = F.coalesce((F.col("depth") == depth) & ~inside & (F.lit(depth == 3) | (F.col("section") != heading)), F.lit(False))
    # The heading at the entries' depth or above that a block stands under.
    above = F.last(F.when(F.col("depth") <= depth, F.struct("ordinal", entry.alias("entry"))), ignorenulls=True).over(w)
    b = b.withColumn("_entry", entry).withColumn("_above", above).withColumn("_nth", F.sum(entry.cast("int")).over(w)).withColumn("_table", table & (F.sum(table.cast("int")).over(w) == 1))
    there = b.groupBy(key).agg(F.sum(F.col("_entry").cast("long")).alias("_n"), F.max("_table").alias("_has"))
    given = curated.groupBy(key).agg(F.count("*").alias("_m"))
    unlike = there.join(given, key, "full").where(F.coalesce("_n", F.lit(0)) != F.coalesce("_m", F.lit(0)))
    bad = unlike.select(key)
    b = b.join(bad.withColumn("_bad", F.lit(True)), key, "left").withColumn("_bad", F.coalesce("_bad", F.lit(False)))
    own = F.coalesce(F.col("_above.entry"), F.lit(False))
    zero = F.lit(0)
    head = F.slice(F.split("raw", "\n"), 1, 1)[0]
    cells = F.size(F.split(F.regexp_replace(head, r"^\s*\||\|\s*$", ""), r"(?<!\\)\|"))
    kept = b.where("_bad OR (NOT _table AND NOT " + "coalesce(_above.entry, false))").select(*_piece(key, F.col("ordinal"), zero, zero, F.col("raw")))
    lines = rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.struct("ordinal", F.concat(F.lit("| "), F.array_join("cells", " | "), F.lit(" |")).alias("l"))))["l"], "\n").alias("_lines"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), cells))
    tables = b.where("_table AND NOT _bad").join(lines, key, "left").select(*_piece(key, F.col("ordinal"), zero, zero, F.concat_ws("\n", head, rule, "_lines")))
    nth = curated.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy("ordinal")).cast("long")).select(key, "_nth", "heading_md", "body_md")
    body = F.concat(F.lit("#" * depth + " "), F.concat_ws("\n\n", "heading_md", F.nullif("body_md", F.lit(""))))
    new = b.where(own & F.col("_entry") & ~F.col("_bad")).select(key, "ordinal", "_nth").join(nth, [key, "_nth"]).select(*_piece(key, F.col("ordinal"), zero, zero, body))
    lost = rows.join(there.where("_has"), key, "left_anti")
    return _joined(kept.unionByName(tables).unionByName(new), key), _violations(lost, "no table", key, "ordinal").unionByName(_violations(bad, "entries and rows unlike", key))


def round_trip(before: DataFrame, after: DataFrame, check: str) -> DataFrame:
    """Rows that writing and reading again lost (-) or made (+)."""
    return checks.altered(before, after, check)
