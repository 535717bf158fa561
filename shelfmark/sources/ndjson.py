"""NDJSON tables with declared schemas, in one pass: lines are read as text, and what is wrong with them is found in the plan that reads them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfmark.operators import asserts, checks


def _declared(schema: StructType | str) -> StructType:
    return schema if isinstance(schema, StructType) else StructType.fromDDL(schema)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, at``: lines that are not blank, with where they stand: file, start of the block, and an order within it. An absent path is an empty table."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    try:
        rows = spark.read.text(path).select("value", at.alias("at"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], "value string, at struct<file:string,block:long,row:long>")
        raise
    return rows.where(F.trim("value") != "")


def _parsed(found: DataFrame, schema: StructType) -> DataFrame:
    """Lines with ``_row`` and what is wrong with them in ``_fault``: unknown fields, no JSON object, or a value of another type. Keys are read before values, so a line with both faults is said to have unknown fields."""
    bad = StructType(schema.fields).add("_bad", "string")
    row = F.from_json("value", bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    unknown = F.array_except(F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")), F.array(*map(F.lit, schema.names)).cast("array<string>"))
    # Generators bind what is parsed, so that each line is parsed once.
    d = found.select("value", "at", F.explode(F.array(F.struct(row.alias("row"), F.array_sort(unknown).alias("unknown")))).alias("_p")).select("value", "at", F.col("_p.row").alias("_row"), F.col("_p.unknown").alias("_unknown"))
    fault: Column = F.when(F.size("_unknown") > 0, F.concat(F.lit("unknown fields: "), F.array_join("_unknown", ", "))).when(F.col("_row").isNull() | F.col("_row._bad").isNotNull(), F.when(F.try_parse_json("value").isNull(), "no JSON").otherwise("does not fit"))
    return d.withColumn("_fault", fault)


def faults(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """``file, fault, value`` of lines that the schema refuses."""
    return _parsed(lines(spark, path), _declared(schema)).where("_fault IS NOT NULL").select(F.element_at(F.split("at.file", "/"), -1).alias("file"), F.col("_fault").alias("fault"), "value")


def read(spark: SparkSession, path: str, schema: StructType | str, at: str | None = None) -> DataFrame:
    """The rows of a file or folder; an absent one is an empty table. A malformed line, a value that does not fit and a field outside the schema end the job that reads them; nothing is read beforehand. ``at`` names a column for
    where the row stands, which orders rows as the files have them."""
    declared = _declared(schema)
    said = F.concat(F.coalesce(F.col("_fault"), F.lit("")), F.lit(" in "), F.col("at.file"), F.lit(": "), F.left("value", F.lit(200)))
    good = asserts.asserted(_parsed(lines(spark, path), declared), F.col("_fault").isNull(), said)
    return good.select(*[F.col("_row")[n].alias(n) for n in declared.names], *([F.col("at").alias(at)] if at else []))


def last_of_file(rows: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """One row a key: the one that stands last in the files, as if each overwrote the one before."""
    rest = [c for c in rows.columns if c not in (*keys, at)]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("_r")).select(*keys, "_r.*")


def read_store(spark: SparkSession, root: str, schemas: dict[str, str], references: Sequence[tuple[str, str, str, str]] = ()) -> dict[str, DataFrame]:
    """All tables below ``root``, absent ones empty; an error that names some keys if a reference ``(table, column, table, column)`` finds no row."""
    tables = {name: read(spark, f"{root}/{name}", schema) for name, schema in schemas.items()}
    broken = [checks.orphans(tables[a], c, tables[b], k, f"{a}.{c}") for a, c, b, k in references]
    if broken:
        bad = checks.report(*broken).orderBy("check_name").collect()  # a row a reference
        if bad:
            raise ValueError("rows that are not there: " + "; ".join(f"{r['check_name']} {r['example']} ({r['violations']})" for r in bad))
    return tables


def write(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Lines in the order of the keys; files follow each other in that order."""
    df.orderBy(*keys).write.option("ignoreNullFields", "false").json(path)


def write_store(tables: dict[str, DataFrame], root: str, keys: dict[str, Sequence[str]]) -> dict[str, int]:
    """Each table in the order of its keys, and how many rows were written of each, counted by the jobs that write them."""
    counts = {}
    for name, df in tables.items():
        # Above the sort, which reads its rows once more to find its ranges.
        seen, watched = checks.observed(df.orderBy(*keys[name]), {"n": F.count(F.lit(1))})
        watched.write.option("ignoreNullFields", "false").json(f"{root}/{name}")
        counts[name] = seen.get["n"]
    return counts
