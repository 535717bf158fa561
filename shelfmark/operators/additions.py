"""Items added to several tables at once from descriptors, and stores whose tables change together.

A batch of descriptors becomes rows of every table it touches: ids continue after the largest among live and retired ones, or are the first free of their name; places continue after the last. The batch is validated as a whole
before: a refused batch leaves all tables as they are. Descriptors are numbered by ranges (``enrich.places``), so a batch of any size stays distributed.

``publish`` writes all tables to a new folder and then makes it the current version by creating one file that must not exist yet; readers take the last one. A failure before leaves the old version, and of two
writers that start from the same version one is refused.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.operators import checks, enrich
from shelfmark.session import settle

#: A descriptor; fields that its type does not use are null.
SPEC = (
    "spec long, type string, name string, url string, grp string, body string, section string, raw string, label string, code_url string, data_url string, blockquotes array<string>, "
    "cells array<struct<method:string,area:string>>, page string, row array<string>, topics array<string>"
)
TABLES = {
    "items": "id string, type string, slug string",
    "papers": "item_id string, ref_id long, section string, raw string, blockquotes_md string, ordinal long",
    "retired_paper_ids": "ref_id long",
    "areas": "key string, label string",
    "methods": "label string",
    "matrix_cells": "method string, area_key string, ref_id long, label string, ordinal long",
    "catalog": "item_id string, name string, url string, grp string, heading_md string, body_md string, ordinal long",
    "dataset_rows": "item_id string, page string, cells_json string, ordinal long",
    "topics": "item_id string, slug string",
    "item_topics": "item_id string, topic_id string",
}
PREFIX = {"software": "sw", "database": "db", "dataset": "ds"}
NONE = "array<struct<fault:string,detail:string>>"


def _last(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    return df.groupBy(*([by] if by else [])).agg(F.coalesce(F.max(column), F.lit(0)).alias("_last"))


def _area(tables: dict[str, DataFrame]) -> DataFrame:
    """``area, area_key``: keys stand for themselves and labels for their key, a key first."""
    a = tables["areas"]
    both = a.select(F.col("key").alias("area"), F.col("key").alias("area_key"), F.lit(0).alias("_r")).unionByName(a.select(F.col("label").alias("area"), F.col("key").alias("area_key"), F.lit(1).alias("_r")))
    return both.groupBy("area").agg(F.min(F.struct("_r", "area_key"))["area_key"].alias("area_key"))


def refused(tables: dict[str, DataFrame], specs: DataFrame, pages: DataFrame) -> DataFrame:
    """``check_name, violation_key`` of what the batch can't do: an unknown type, a section without references, an unknown method, area or topic, a page without an inventory, a row without cells, a name or text that is missing, two descriptors of one number. ``pages`` has one column."""
    key = F.col("spec").cast("string")
    named = lambda df, check, detail: df.select(F.lit(check).alias("check_name"), F.concat_ws(":", key, detail).alias("violation_key"))
    paper, item = F.col("type") == "paper", F.col("type").isin("software", "database")
    missing = F.when(paper & F.col("raw").isNull(), "raw").when(item & F.col("name").isNull(), "name").when(item & F.col("url").isNull(), "url")
    out = [
        checks.duplicates(specs, ["spec"], "number"),
        named(specs.where(~F.coalesce(F.col("type").isin("paper", *PREFIX), F.lit(False))), "type", F.coalesce("type", F.lit(""))),
        named(specs.where(missing.isNotNull()), "missing", missing),
        named(specs.where((F.col("type") == "dataset") & (F.coalesce(F.size("row"), F.lit(0)) <= 0)), "no cells", F.lit("")),
    ]
    section = F.coalesce("section", F.lit("References"))
    known = tables["papers"].select(F.col("section").alias("_s")).distinct()
    out.append(named(specs.where(paper).withColumn("_s", section).join(known, "_s", "left_anti"), "section", F.col("_s")))
    own = pages.toDF("_p").distinct()
    out.append(named(specs.where("type = 'dataset'").withColumn("_p", F.coalesce("page", F.lit(""))).join(own, "_p", "left_anti"), "page", F.col("_p")))
    cells = specs.where(paper).select("spec", F.explode("cells").alias("_c")).select("spec", F.col("_c.method").alias("method"), F.col("_c.area").alias("area"))
    out.append(named(cells.join(tables["methods"].select(F.col("label").alias("method")), "method", "left_anti"), "method", F.coalesce("method", F.lit(""))))
    out.append(named(cells.join(_area(tables), "area", "left_anti"), "area", F.coalesce("area", F.lit(""))))
    topics = specs.select("spec", F.explode("topics").alias("slug"))
    out.append(named(topics.join(tables["topics"].select("slug"), "slug", "left_anti"), "topic", F.coalesce("slug", F.lit(""))))
    united = out[0]
    for v in out[1:]:
        united = united.unionByName(v)
    return united


def _quotes() -> Column:
    line = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"> **{label}**: "), F.col(c)))
    lines = F.concat(F.array_compact(F.array(line("Code", "code_url"), line("Data", "data_url"))), F.coalesce("blockquotes", F.array().cast("array<string>")))
    return F.nullif(F.array_join(F.filter(lines, lambda x: x != ""), "\n\n"), F.lit(""))


def rows_of(tables: dict[str, DataFrame], specs: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The new rows of each table that a valid batch adds, and ``spec, item_id``."""
    specs = settle(specs)
    last = _last(tables["papers"].select("ref_id").unionByName(tables["retired_paper_ids"].select("ref_id")), "ref_id").withColumnRenamed("_last", "_id")
    paper = enrich.places(specs.where("type = 'paper'"), ["spec"], "_n").join(F.broadcast(last)).join(F.broadcast(_last(tables["papers"], "ordinal")))
    paper = paper.withColumn("ref_id", F.col("_id") + F.col("_n") + 1).withColumn("item_id", F.concat(F.lit("paper:"), F.col("ref_id").cast("string")))
    # The number that is given counts, not that of a line pasted from elsewhere.
    body = F.regexp_replace("raw", r'^<a\s+id="\d+">\s*\d*\s*</a>\s*', "")
    anchor = F.concat(F.lit('<a id="'), F.col("ref_id").cast("string"), F.lit('">'), F.col("ref_id").cast("string"), F.lit("</a> "), body)
    paper = settle(paper.select("spec", "item_id", "ref_id", F.coalesce("section", F.lit("References")).alias("section"), anchor.alias("raw"), _quotes().alias("blockquotes_md"), (F.col("_last") + F.col("_n") + 1).alias("ordinal"), "cells", "label"))
    cells = paper.select("spec", "ref_id", "label", F.posexplode("cells").alias("_i", "_c")).select("spec", "_i", "ref_id", "label", F.col("_c.method").alias("method"), F.col("_c.area").alias("area")).join(_area(tables), "area")
    cells = enrich.places(cells, ["spec", "_i"], "_n").join(F.broadcast(_last(tables["matrix_cells"], "ordinal"))).withColumn("ordinal", F.col("_last") + F.col("_n") + 1)
    prefix = F.create_map(*[F.lit(x) for pair in PREFIX.items() for x in pair])
    named = specs.where(F.col("type").isin(*PREFIX)).withColumn("_seed", F.when(F.col("type") == "dataset", T.seed_text(F.col("row"))).otherwise(F.col("name")))
    named = named.withColumn("_base", F.concat(prefix[F.col("type")], F.lit(":"), T.slugify(F.col("_seed"))))
    named = settle(enrich.free_ids(named, "_base", ["spec"], tables["items"].select("id"), "item_id"))
    entry = named.where("type <> 'dataset'")
    kinds = tables["items"].select(F.col("id").alias("item_id"), "type")
    ends = _last(tables["catalog"].join(kinds, "item_id"), "ordinal", "type")
    entry = enrich.places(entry, ["spec"], "_n", by="type").join(F.broadcast(ends), "type", "left").withColumn("ordinal", F.coalesce("_last", F.lit(0)) + F.col("_n") + 1)
    heading = F.concat(F.lit("["), "name", F.lit("]("), "url", F.lit(")"))
    data = enrich.places(named.where("type = 'dataset'"), ["spec"], "_n").join(F.broadcast(_last(tables["dataset_rows"], "ordinal"))).withColumn("ordinal", F.col("_last") + F.col("_n") + 1)
    ids = paper.select("spec", "item_id").unionByName(named.select("spec", "item_id"))
    types = ids.join(specs.select("spec", "type", "topics"), "spec")
    new = {
        "items": types.select(F.col("item_id").alias("id"), "type", F.substring_index("item_id", ":", -1).alias("slug")),
        "papers": paper.select("item_id", "ref_id", "section", "raw", "blockquotes_md", "ordinal"),
        "matrix_cells": cells.select("method", "area_key", "ref_id", "label", "ordinal"),
        "catalog": entry.select("item_id", "name", "url", "grp", heading.alias("heading_md"), F.coalesce("body", F.lit("")).alias("body_md"), "ordinal"),
        "dataset_rows": data.select("item_id", "page", F.to_json("row").alias("cells_json"), "ordinal"),
        "item_topics": types.select("item_id", F.explode(F.array_distinct("topics")).alias("_t")).select("item_id", F.concat(F.lit("topic:"), "_t").alias("topic_id")),
    }
    return new, ids


def add_items(tables: dict[str, DataFrame], specs: DataFrame, pages: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The changed tables and ``spec, item_id``; an error that names the first faults if the batch is refused."""
    bad = refused(tables, specs, pages).orderBy("check_name", "violation_key").limit(5).collect()
    if bad:
        raise ValueError("refused: " + "; ".join(f"{r['check_name']} {r['violation_key']}" for r in bad))
    new, ids = rows_of(tables, specs)
    return tables | {name: tables[name].unionByName(rows.select(tables[name].columns)) for name, rows in new.items()}, ids


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def version(spark: SparkSession, root: str) -> int:
    """The number of the current version, 0 for none."""
    fs, log = _folder(spark, f"{root}/_log")
    return max((int(s.getPath().getName()) for s in fs.listStatus(log) if s.getPath().getName().isdigit()), default=0) if fs.exists(log) else 0


def load(spark: SparkSession, root: str, schemas: dict[str, str] = TABLES) -> tuple[int, dict[str, DataFrame]]:
    """The current version's number and tables; before the first one all tables are empty."""
    n = version(spark, root)
    if not n:
        return 0, {name: spark.createDataFrame([], s) for name, s in schemas.items()}
    folder = spark.read.text(f"{root}/_log/{n:012d}").first()[0]
    return n, {name: spark.read.schema(s).json(f"{root}/{folder}/{name}") for name, s in schemas.items()}


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], after: int) -> int:
    """Write all tables beside the current version ``after`` and make them the next one; an error if another writer was first. What is never made current can be deleted at any time."""
    folder = f"tables-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.option("ignoreNullFields", "false").json(f"{root}/{folder}/{name}")
    n = after + 1
    fs, mark = _folder(spark, f"{root}/_log/{n:012d}")
    if version(spark, root) != after:
        raise ValueError(f"refused: version {after} is not the current one")
    out = fs.create(mark, False)  # fails where the file exists
    out.write(bytearray(folder.encode()))
    out.close()
    return n
