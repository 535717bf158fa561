"""Curated Markdown catalogues as rows: references with their labelled links, entries under headings, grids, inventories, vocabularies, lists; and the sinks that write them again.

All scans take ``docs`` with a key and a text and never gather more than one document. Null and empty texts give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfmark.functions import text as T
from shelfmark.session import settle
from shelfmark.sources import markdown

ANCHOR = r'^<a\s+id="(\d+)">'
LINK = r"\[((?:[^\[\]]|\[[^\]]*\])*)\]\(([^)\s]*)[^)]*\)"


def _link(c: Column, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, LINK, group), F.lit(""))


def blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, ordinal, kind, depth, raw``: headings, and runs of lines that are quotes, table rows, list items or paragraphs; blank lines part runs and are no blocks."""
    line = F.col("line")
    kind = (
        F.when(F.col("depth").isNotNull(), "heading").when(F.col("code"), "code").when(F.trim(line) == "", "blank").when(line.rlike(r"^ {0,3}>"), "quote")
        .when(line.rlike(r"^\s*\|"), "table").when(line.rlike(r"^\s*(?:[-*+]|\d{1,9}[.)])\s+"), "list").otherwise("paragraph")
    )
    w = Window.partitionBy(key).orderBy("ordinal")
    d = markdown.lines(docs, key, text).withColumn("kind", kind).withColumn("_before", F.lag("kind").over(w))
    # A plain line after a list item or a quote goes on with it.
    d = d.withColumn("kind", F.when((F.col("kind") == "paragraph") & F.col("_before").isin("list", "quote"), F.col("_before")).otherwise(F.col("kind")))
    new = F.coalesce((F.col("kind") != F.lag("kind").over(w)) | (F.col("kind") == "heading"), F.lit(True))
    d = d.withColumn("block", F.max(F.when(new, F.col("ordinal"))).over(w)).where("kind <> 'blank'")
    rows = F.array_sort(F.collect_list(F.struct("ordinal", "line")))
    return d.groupBy(key, F.col("block").alias("ordinal")).agg(F.first("kind").alias("kind"), F.first("depth").alias("depth"), rows.alias("_l")).select(key, "ordinal", "kind", "depth", F.array_join(F.col("_l.line"), "\n").alias("raw"))


def title_of(heading: Column) -> Column:
    return F.trim(F.regexp_replace(heading, r"^#{1,6}\s+|\s+#+\s*$", ""))


def anchored(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, ordinal, section, id, raw, shown, quotes``: paragraphs that start with an anchor, the second-level heading above them, and the quotes that follow at once."""
    w = Window.partitionBy(key).orderBy("ordinal")
    b = blocks(docs, key, text).withColumn("section", F.last(F.when(F.col("depth") == 2, title_of(F.col("raw"))), ignorenulls=True).over(w))
    b = b.withColumn("owner", F.max(F.when(F.col("kind") != "quote", F.col("ordinal"))).over(w))
    first = F.col("ordinal") == F.col("owner")
    quotes = F.array_join(F.array_sort(F.collect_list(F.when(~first, F.struct("ordinal", "raw"))))["raw"], "\n\n")
    own = lambda c: F.max(F.when(first, F.col(c))).alias(c)
    g = b.groupBy(key, F.col("owner").alias("ordinal")).agg(own("section"), own("kind"), own("raw"), F.nullif(quotes, F.lit("")).alias("quotes"))
    g = g.where((F.col("kind") == "paragraph") & F.col("raw").rlike(ANCHOR))
    return g.select(key, "ordinal", "section", F.regexp_extract("raw", ANCHOR, 1).cast("long").alias("id"), "raw", T.plain_text(F.col("raw")).alias("shown"), "quotes")


def _labelled(quotes: str) -> Column:
    """(label, url) of the bold labels with an absolute address, in their order."""
    pair = F.lit(r"\*\*([^*]+)\*\*(?:(?!\*\*)[^\n])*?(https?://[^\s)>\]]+)")
    labels = F.transform(F.regexp_extract_all(quotes, pair, F.lit(1)), lambda x: F.trim(F.regexp_replace(x, r":\s*$", "")))
    return F.arrays_zip(labels.alias("label"), F.regexp_extract_all(quotes, pair, F.lit(2)).alias("url"))


def labelled_links(anchors: DataFrame, key: str) -> DataFrame:
    """``key, id, position, label, url`` of the bold labels with an absolute address in the quotes of an anchor; of equal labels, in any case, the first."""
    each = anchors.select(key, "id", F.posexplode(_labelled("quotes")).alias("position", "_p")).select(key, "id", "position", "_p.label", "_p.url")
    best = each.groupBy(key, "id", F.lower("label").alias("_low")).agg(F.min(F.struct("position", "label", "url")).alias("_b"))
    return best.select(key, "id", "_b.*")


def references(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Anchored references with the parts of their line and the addresses labelled Code and Data; all from one pass over the blocks."""
    of = lambda name: F.get(F.filter(_labelled("quotes"), lambda p: F.lower(p["label"]) == name), F.lit(0))["url"].alias(f"{name}_url")
    a = anchored(docs, key, text).withColumn("_f", T.reference_fields(F.col("raw")))
    return a.select(key, "ordinal", "section", "id", "_f.*", of("code"), of("data"), "quotes")


def matrix_headers(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, axis, position, label_md`` of a grid's columns (without the corner) and rows, as written."""
    c = markdown.table_cells(docs, key, text)
    axis = F.when((F.col("row") == 0) & (F.col("col") > 0), "column").when((F.col("row") > 0) & (F.col("col") == 0), "row")
    return c.withColumn("axis", axis).where("axis IS NOT NULL").select(key, "axis", F.greatest("row", "col").alias("position"), F.col("cell").alias("label_md"))


def matrix_cells(docs: DataFrame, key: str, text: str, areas: dict[str, str]) -> DataFrame:
    """``key, method, area, position, ref_id, label`` of the ``#n`` links of a grid; columns whose label is in no entry of ``areas`` (label to key) are left out."""
    c = markdown.table_cells(docs, key, text)
    known = F.create_map(*[F.lit(x) for pair in areas.items() for x in pair]) if areas else F.create_map().cast("map<string,string>")
    heads = c.where("row = 0 AND col > 0").select(key, "col", F.element_at(known, T.plain_text(F.col("cell"))).alias("area")).where("area IS NOT NULL")
    names = c.where("row > 0 AND col = 0").select(key, "row", T.plain_text(F.col("cell")).alias("method"))
    href = r"\[([^\]]*)\]\(#(\d+)\)"
    pairs = F.arrays_zip(F.regexp_extract_all("cell", F.lit(href), F.lit(1)).alias("label"), F.regexp_extract_all("cell", F.lit(href), F.lit(2)).alias("ref"))
    body = c.where("row > 0 AND col > 0").select(key, "row", "col", F.posexplode(pairs).alias("position", "_p"))
    out = body.join(heads, [key, "col"]).join(names, [key, "row"])
    return out.select(key, "method", "area", "position", F.col("_p.ref").cast("long").alias("ref_id"), F.trim("_p.label").alias("label"))


def entries(docs: DataFrame, key: str, text: str, depth: int = 3, until: int = 6) -> DataFrame:
    """``key, ordinal, grp, name, url, heading_md, body_md`` of the headings of one depth.

    ``grp`` is the second-level heading above, empty for none or where entries are of the second level themselves; a body ends at the next heading of depth ``until`` or above.
    Headings without a link have a null ``url`` and their own text as name: ``unlinked`` makes these violations.
    """
    w = Window.partitionBy(key).orderBy("ordinal")
    b = blocks(docs, key, text)
    group = F.last(F.when(F.col("depth") == 2, title_of(F.col("raw"))), ignorenulls=True).over(w) if depth > 2 else F.lit("")
    b = b.withColumn("grp", F.coalesce(group, F.lit("")))
    start = F.last(F.when(F.col("depth") <= max(until, depth), F.struct("ordinal", "depth")), ignorenulls=True).over(w)
    b = b.withColumn("_s", start).where(F.col("_s.depth") == depth)
    head = F.col("ordinal") == F.col("_s.ordinal")
    body = F.array_join(F.array_sort(F.collect_list(F.when(~head, F.struct("ordinal", "raw"))))["raw"], "\n\n")
    own = lambda c: F.max(F.when(head, F.col(c))).alias(c)
    g = b.groupBy(key, F.col("_s.ordinal").alias("ordinal")).agg(own("grp"), own("raw"), body.alias("body_md")).withColumn("heading_md", title_of(F.col("raw")))
    name = T.plain_text(F.coalesce(_link(F.col("heading_md"), 1), F.col("heading_md")))
    return g.select(key, "ordinal", "grp", name.alias("name"), _link(F.col("heading_md"), 2).alias("url"), "heading_md", "body_md")


def unlinked(found: DataFrame, key: str, check: str) -> DataFrame:
    return found.where("url IS NULL").select(F.lit(check).alias("check_name"), F.concat_ws(":", F.col(key).cast("string"), "name").alias("violation_key"))


def inventory(docs: DataFrame, key: str, text: str, heading: str) -> DataFrame:
    """``key, row, cells`` of the first table under the named second-level heading; row 0 is the header."""
    part = markdown.sections(docs, key, text, 2).where(F.trim("heading") == heading).select(key, F.col("ordinal").alias("_o"), "body")
    part = part.groupBy(key).agg(F.min_by("body", "_o").alias("body"))
    c = markdown.table_cells(part, key, "body")
    return c.groupBy(key, "row").agg(F.array_sort(F.collect_list(F.struct("col", "cell")))["cell"].alias("cells"))


def inventory_model(rows: DataFrame, tables: DataFrame, key: str, row_key: str) -> tuple[DataFrame, DataFrame]:
    """Stored rows ``(row_key, key, cells)`` with their cells by column label, and the violations: a page without a table, a label twice in a header, a row of another length."""
    heads = tables.where("row = 0").select(key, F.col("cells").alias("_h"))
    r = rows.join(heads, key, "left")
    fault = (
        F.when(F.col("_h").isNull(), "no table").when(F.size(F.array_distinct("_h")) < F.size("_h"), "label twice").when(F.size("cells") != F.size("_h"), "length")
    )
    r = r.withColumn("_fault", fault)
    model = r.where("_fault IS NULL").select(row_key, key, T.plain_text(F.get("cells", F.lit(0))).alias("name"), F.map_from_arrays("_h", "cells").alias("columns"))
    return model, r.where("_fault IS NOT NULL").select(F.col("_fault").alias("check_name"), F.col(row_key).cast("string").alias("violation_key"))


def inventory_books(rows: DataFrame, tables: DataFrame, pages: DataFrame, topics: DataFrame, data: str = "Data") -> tuple[DataFrame, DataFrame]:
    """``inventory_model`` of ``rows`` (``item_id, page, ordinal, cells, subseries``) in full: with the links of the cells, the sorted topics (``item_id, slug``), the ``rank`` of the page (``page, rank``; pages that have none go last, by
    name) and the members of a series, each with the row that catalogues its accession.

    An accession belongs to the first row that deposits it, by rank, page and place over all pages, so that a row added later changes nothing; accessions that no row deposits have a null id. ``subseries`` is a JSON list.
    """
    model, faults = inventory_model(rows, tables, "page", "item_id")
    d = rows.drop("page").join(model, "item_id").join(pages, "page", "left")
    claim = d.select(T.deposit_accession(F.col("item_id"), F.try_element_at("columns", F.lit(data))).alias("accession"), "item_id", F.struct(F.coalesce("rank", F.lit(2**31 - 1)).alias("r"), F.col("page").cast("string").alias("p"), "ordinal", "item_id").alias("_at"))
    first = claim.groupBy("accession").agg(F.min_by("item_id", "_at").alias("_id"))
    named = rows.select("item_id", F.posexplode(T.string_list(F.col("subseries"))).alias("_i", "accession")).join(first, "accession", "left")
    found = named.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "accession", F.col("_id").alias("id")))), lambda x: F.struct(x["accession"].alias("accession"), x["id"].alias("id"))).alias("_members"))
    own = topics.groupBy("item_id").agg(F.array_sort(F.collect_set("slug")).alias("topics"))
    out = d.join(found, "item_id", "left").join(own, "item_id", "left")
    members = F.coalesce("_members", F.array().cast("array<struct<accession:string,id:string>>"))
    return out.select("item_id", "page", "rank", "ordinal", "name", "columns", T.links_in(F.array_join("cells", " ")).alias("links"), F.coalesce("topics", F.array().cast("array<string>")).alias("topics"), members.alias("subseries")), faults


def matrix_table(cells: DataFrame, areas: DataFrame, methods: DataFrame) -> DataFrame:
    """``place, line`` of a grid as a Markdown table: the header (areas ``key, header_md, ordinal``), its rule, and a line for each of the methods (``label, header_md, ordinal``) whose cells are the links of ``cells`` (``method, area_key, ref_id, label,
    ordinal``) in their order; cells of other areas or methods are left out. ``place`` orders lines: 0, 1, and 2 and more by the methods' places. What meets in one row is one method's links."""
    link = F.concat(F.lit("["), "label", F.lit("](#"), F.col("ref_id").cast("string"), F.lit(")"))
    cell = cells.groupBy("method", "area_key").agg(F.array_join(F.array_sort(F.collect_list(F.struct("ordinal", link.alias("l"))))["l"], "<br>").alias("cell"))
    row = cell.groupBy("method").agg(F.map_from_entries(F.collect_list(F.struct("area_key", "cell"))).alias("_cells"))
    heads = areas.agg(F.array_sort(F.collect_list(F.struct("ordinal", "key", "header_md"))).alias("_heads"))  # one row, of a vocabulary
    line = lambda parts: F.concat(F.lit("| "), F.array_join(parts, " | "), F.lit(" |"))
    body = methods.join(row, methods["label"] == row["method"], "left").join(F.broadcast(heads))
    filled = F.transform("_heads", lambda h: F.coalesce(F.try_element_at("_cells", h["key"]), F.lit("")))
    lines = body.select((F.col("ordinal") + 2).cast("long").alias("place"), line(F.concat(F.array("header_md"), filled)).alias("line"))
    top = heads.select(F.lit(0).cast("long").alias("place"), F.concat(F.lit("| | "), F.array_join("_heads.header_md", " | "), F.lit(" |")).alias("line"))
    rule = heads.select(F.lit(1).cast("long").alias("place"), F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size("_heads") + 1)).alias("line"))
    return top.unionByName(rule).unionByName(lines)


def definitions(docs: DataFrame, key: str, text: str, axes: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """``key, axis, label, definition`` of the third-level headings under the second-level ones that ``axes`` maps, paragraphs only, and the violations:
    a label twice in an axis, definitions under a heading that is no axis, and a label that ``area`` and ``method`` share."""
    w = Window.partitionBy(key).orderBy("ordinal")
    b = blocks(docs, key, text).withColumn("top", F.last(F.when(F.col("depth") <= 2, F.struct("depth", title_of(F.col("raw")).alias("h"), "ordinal")), ignorenulls=True).over(w))
    b = b.withColumn("_s", F.last(F.when(F.col("depth") <= 3, F.struct("depth", title_of(F.col("raw")).alias("h"), "ordinal")), ignorenulls=True).over(w))
    b = b.where((F.col("top.depth") == 2) & (F.col("_s.depth") == 3) & (F.col("kind") == "paragraph"))
    text_of = F.array_join(F.array_sort(F.collect_list(F.struct("ordinal", F.regexp_replace(T.plain_text(F.col("raw")), r"\s*\n\s*", " ").alias("p"))))["p"], " ")
    d = b.groupBy(key, F.col("top.h").alias("heading"), F.col("_s.h").alias("label"), F.col("_s.ordinal").alias("ordinal")).agg(text_of.alias("definition"))
    axis = F.lit(None).cast("string")
    for h, a in axes.items():
        axis = F.when(F.col("heading") == h, a).otherwise(axis)
    d = d.withColumn("axis", axis)
    bad = lambda df, name, what: df.select(F.lit(name).alias("check_name"), F.concat_ws(":", F.col(key).cast("string"), what).alias("violation_key"))
    twice = d.where("axis IS NOT NULL").groupBy(key, "axis", "label").count().where("count > 1")
    shared = d.where("axis IN ('area', 'method')").groupBy(key, "label").agg(F.count_distinct("axis").alias("n")).where("n > 1")
    faults = bad(twice, "label twice", "label").unionByName(bad(d.where("axis IS NULL").select(key, "heading").distinct(), "no axis", "heading")).unionByName(bad(shared, "area and method", "label"))
    return d.where("axis IS NOT NULL").select(key, "axis", "label", "definition"), faults


def list_items(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, ordinal, section, title, url, note, kind`` of list items with a link, by second-level section; the first link counts, what follows it is the note."""
    w = Window.partitionBy(key).orderBy("ordinal")
    d = markdown.lines(docs, key, text).withColumn("section", F.last(F.when(F.col("depth") == 2, title_of(F.col("line"))), ignorenulls=True).over(w))
    mark = r"^\s*(?:[-*+]|\d{1,9}[.)])\s+"
    item = F.regexp_replace("line", mark, "")
    d = d.where(F.col("section").isNotNull() & ~F.col("code") & F.col("line").rlike(mark)).withColumn("url", _link(item, 2)).where("url IS NOT NULL")
    title, full = T.plain_text(_link(item, 1)), T.plain_text(item)
    note = F.when(F.startswith(full, title), F.trim(F.regexp_replace(F.substring(full, F.length(title) + 1, F.length(full)), r"^[\s—–-]+", ""))).otherwise("")
    return d.select(key, "ordinal", "section", title.alias("title"), "url", note.alias("note"), T.media_kind(F.col("url")).alias("kind"))


def corpus_lines(files: DataFrame, path: str, text: str, ranks: dict[str, int]) -> DataFrame:
    """``folder_rank, path, ordinal, line`` in the order in which the files are joined: folders by their rank (unknown ones last), the README of a folder first, then by name.

    The order is of rows, so that ``orderBy(...).write.text`` spreads it over files; nothing is gathered.
    """
    folder = F.when(F.instr(path, "/") > 0, F.regexp_replace(F.col(path), "/[^/]*$", "")).otherwise("")
    rank = F.lit(len(ranks))
    for name, r in ranks.items():
        rank = F.when(folder == name, r).otherwise(rank)
    readme = ~F.lower(F.regexp_extract(path, "[^/]*$", 0)).eqNullSafe("readme.md")
    rows = files.select(rank.alias("folder_rank"), folder.alias("folder"), readme.alias("after_readme"), F.col(path).alias("path"), F.posexplode(F.split(text, r"\r?\n")).alias("ordinal", "line"))
    return rows.orderBy("folder_rank", "folder", "after_readme", "path", "ordinal")


def spliced(docs: DataFrame, key: str, text: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``key, section, ordinal, block`` of the references of ``rows (key, section, id, raw, quotes)`` in the sections of ``docs`` that have an anchor to splice at; and the violations:
    rows whose section has none, which would be lost."""
    places = anchored(docs, key, text).groupBy(key, "section").agg(F.min("ordinal").alias("_at"))
    placed = rows.join(places, [key, "section"])
    block = placed.select(key, "section", "_at", F.col("id").alias("ordinal"), F.concat_ws("\n\n", "raw", "quotes").alias("block"))
    lost = rows.join(places, [key, "section"], "left_anti").select(F.lit("no anchor").alias("check_name"), F.concat_ws(":", F.col(key).cast("string"), "section", F.col("id").cast("string")).alias("violation_key"))
    return block, lost


def json_rows(df: DataFrame, keys: list[str], pretty: bool = False) -> DataFrame:
    """A JSON object a row, in the order of the keys; nulls are written."""
    return df.orderBy(*keys).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false", "pretty": str(pretty).lower()}).alias("value"))


#: The parts of compact JSON: empty lists and objects, strings, marks, and all else.
JSON_PART = re.compile(r'\{\}|\[\]|"(?:[^"\\]|\\.)*"|[\[\]{}:,]|[^\[\]{}:,"]+')


def indented(value: str, depth: int = 0) -> str:
    """Compact JSON with two spaces a level; numbers and strings stay as they are written."""
    out = []
    for part in JSON_PART.findall(value):
        depth += (part in ("{", "[")) - (part in ("}", "]"))
        line = "\n" + "  " * depth
        out.append(line + part if part in ("}", "]") else part + line if part in ("{", "[", ",") else ": " if part == ":" else part)
    return "".join(out)


def write_pretty(df: DataFrame, folder: str, keys: list[str], files: int | None = None) -> None:
    """Files that each hold one JSON array, indented by two spaces, nulls written; rows are in the order of the keys within files and from file to file. ``files`` fixes their number, else it follows the size of the rows.

    Rows are written as they come, so that no file is held whole. A file without rows is an empty array; of a table without rows the file may be empty, which reads as no rows as well.
    """
    rows = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    compact = rows.sortWithinPartitions(*keys).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            lines = [last] if last is not None else ["["]
            for value in batch.column(0).to_pylist():
                lines[-1] += "," if lines[-1] != "[" else ""
                lines.append("  " + indented(value, 1))
            last = lines.pop()
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        end = [last, "]"] if last not in (None, "[") else ["[]"]
        yield pa.RecordBatch.from_arrays([pa.array(end, pa.string())], ["value"])

    compact.mapInArrow(arrays, "value string").write.text(folder)


def read_pretty(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """The rows of files that each hold one JSON array; what does not fit the schema ends the job that reads it."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(folder)


def read_cache(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON file that may be missing: empty if it is absent or does not fit the schema."""
    none = spark.createDataFrame([], schema)
    declared = StructType(none.schema.fields).add("_bad", "string")
    try:
        rows = settle(spark.read.schema(declared).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return none
        raise
    fits = rows.where("_bad IS NOT NULL").isEmpty()
    return rows.drop("_bad") if fits else none


def count_files(spark: SparkSession, root: str, pattern: str = "*.md", exclude: list[str] | None = None) -> DataFrame:
    """``folder, n`` of the files below ``root`` whose name fits the pattern and is not excluded; contents are not read. Spark lists no file of zero bytes."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path")
    name = F.regexp_extract("path", "[^/]*$", 0)
    return f.where(~name.isin(exclude or [])).groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.count("*").alias("n"))
