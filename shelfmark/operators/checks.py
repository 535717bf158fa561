"""Constraint checks: each is a frame of violations ``(check, key)``; a report unites them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shelfmark.session import parts_of

#: Rows a task.
ROWS = 1_000_000


def _named(df: DataFrame, check: str, key: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check_name"), key.cast("string").alias("violation_key"))


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str, check: str) -> DataFrame:
    """Child keys without a parent; null keys refer to nothing."""
    n = parts_of(child, ROWS) + parts_of(parent, ROWS)
    keys = parent.select(F.col(pk).alias(fk)).repartition(n, fk).distinct()
    # Keys are made distinct before they meet, so that no side's repeats are sorted.
    return _named(child.where(F.col(fk).isNotNull()).select(fk).repartition(n, fk).distinct().join(keys, fk, "left_anti"), check, F.col(fk))


def duplicates(df: DataFrame, keys: Sequence[str], check: str) -> DataFrame:
    return _named(df.select(*keys).repartition(parts_of(df, ROWS), *keys).groupBy(*keys).count().where("count > 1"), check, F.concat_ws("|", *keys))


def where(df: DataFrame, bad: Column, key: str, check: str) -> DataFrame:
    """Rows for which the condition holds."""
    return _named(df.where(bad), check, F.col(key))


def null_xor(df: DataFrame, a: str, b: str, key: str, check: str) -> DataFrame:
    """Rows with just one of two columns that must come together."""
    return where(df, F.col(a).isNull() != F.col(b).isNull(), key, check)


def set_difference(a: DataFrame, b: DataFrame, check: str) -> DataFrame:
    """Members of one of two single-column sets only, marked + or -."""
    c = a.columns[0]
    left = a.distinct().join(b.distinct().toDF(c), c, "left_anti").select(F.concat(F.lit("+"), F.col(c).cast("string")).alias("k"))
    right = b.distinct().toDF(c).join(a.distinct(), c, "left_anti").select(F.concat(F.lit("-"), F.col(c).cast("string")).alias("k"))
    return _named(left.unionByName(right), check, F.col("k"))


def parts_sum(parts: DataFrame, total: DataFrame, key: str, part: str, whole: str, check: str, tolerance: float = 0.0) -> DataFrame:
    """Keys whose parts don't sum to their total."""
    sums = parts.groupBy(key).agg(F.sum(part).alias("_s"))
    off = total.join(sums, key, "left").where(F.abs(F.col(whole) - F.coalesce("_s", F.lit(0))) > tolerance)
    return _named(off, check, F.col(key))


def report(*violations: DataFrame) -> DataFrame:
    """By check: the number of violations and the smallest key among them. Checks without violations don't appear."""
    united = reduce(DataFrame.unionByName, violations)
    return united.groupBy("check_name").agg(F.count("*").alias("violations"), F.min("violation_key").alias("example"))


def verdicts(names: Sequence[str], *violations: DataFrame) -> DataFrame:
    """``report`` with all named checks, those without violations as ``ok``."""
    spark = violations[0].sparkSession
    every = spark.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("check_name"))
    found = every.join(report(*violations), "check_name", "left")
    return found.select("check_name", F.col("violations").isNull().alias("ok"), F.coalesce("violations", F.lit(0)).cast("long").alias("violations"), "example")


def observed(df: DataFrame, metrics: dict[str, Column]) -> tuple[Observation, DataFrame]:
    """``df`` with metrics that the job which writes it collects on the way; they are there, in the observation's ``get``, when that job has ended.

    Watch what is written, not what is sorted or cut by ranges afterwards: that is read more than once.
    """
    seen = Observation()
    return seen, df.observe(seen, *[c.alias(name) for name, c in metrics.items()])


def drift(spark: SparkSession, claims: Sequence[tuple[str, int, int]]) -> DataFrame:
    """``check_name, violation_key`` of claims ``(name, one count, other count)`` whose counts differ; a missing count counts as 0. Counts are single numbers, from ``observed`` models."""
    rows = [(name, f"{a or 0} <> {b or 0}") for name, a, b in claims if (a or 0) != (b or 0)]
    return spark.createDataFrame(rows, "check_name string, violation_key string")


def unlike_id(items: DataFrame, prefixes: dict[str, str], check: str, key: str = "id", kind: str = "type", slug: str = "slug") -> DataFrame:
    """Ids that are not the prefix of their type, a colon and their slug; an unknown type has none that fits."""
    want = F.lit(None).cast("string")
    for k, p in prefixes.items():
        want = F.when(F.col(kind) == k, F.concat(F.lit(p + ":"), F.col(slug))).otherwise(want)
    return where(items, ~F.coalesce(F.col(key) == want, F.lit(False)), key, check)


def present(rows: DataFrame, key: str, forbidden: DataFrame, check: str) -> DataFrame:
    """Keys that are in ``forbidden`` (a single column): retired ids that came back, names of one namespace used in another."""
    return _named(rows.select(key).distinct().join(forbidden.distinct().toDF(key), key, "left_semi"), check, F.col(key))


def not_in_one(keys: DataFrame, a: DataFrame, b: DataFrame, check: str) -> DataFrame:
    """Keys (all frames have a single column) that are in both of two tables, or in neither."""
    k = keys.columns[0]
    marks = [x.distinct().toDF(k).withColumn(name, F.lit(1)) for x, name in ((a, "_a"), (b, "_b"))]
    found = keys.distinct().join(marks[0], k, "left").join(marks[1], k, "left")
    return _named(found.where(F.col("_a").isNull() == F.col("_b").isNull()), check, F.col(k))


def named_unlike_once(rows: DataFrame, column: str, keys: DataFrame, check: str) -> DataFrame:
    """Keys that rows don't name exactly once: of a bijection between the rows that have a value and ``keys``."""
    k = keys.columns[0]
    n = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(k)).agg(F.count("*").alias("_n"))
    return _named(keys.distinct().join(n, k, "full").where(F.coalesce("_n", F.lit(0)) != 1), check, F.col(k))


def unlike_heading(rows: DataFrame, key: str, check: str, heading: str = "heading_md", name: str = "name", url: str = "url") -> DataFrame:
    """Headings that don't start with a link of the row's name and address."""
    link = F.concat(F.lit("["), F.col(name), F.lit("]("), F.col(url), F.lit(")"))
    return where(rows, ~F.coalesce(F.startswith(F.col(heading), link), F.lit(False)), key, check)


def members(rows: DataFrame, key: str, array: str, pattern: str, check: str, own: str | None = None) -> DataFrame:
    """What is wrong in arrays of names: one that is empty, members unlike the pattern, equal to the row's ``own``, twice in an array, or in the arrays of several rows.

    Keys are ``row:fault:member``; a null array has no members and no fault.
    """
    some = rows.where(F.col(array).isNotNull())
    each = some.select(F.col(key).cast("string").alias("_k"), *([F.col(own).alias("_own")] if own else []), F.explode(array).alias("_m"))
    fault = lambda df, name: df.select(F.concat_ws(":", F.col("_k"), F.lit(name), F.coalesce("_m", F.lit(""))).alias("_f"))
    out = some.where(F.size(array) == 0).select(F.concat(F.col(key).cast("string"), F.lit(":empty:")).alias("_f"))
    out = out.unionByName(fault(each.where(~F.coalesce(F.col("_m").rlike(pattern), F.lit(False))), "shape"))
    if own:
        out = out.unionByName(fault(each.where("_m = _own"), "own"))
    counts = each.groupBy("_k", "_m").agg(F.count("*").alias("_n"))
    out = out.unionByName(fault(counts.where("_n > 1"), "twice"))
    owners = counts.groupBy("_m").agg(F.count("*").alias("_n"), F.min("_k").alias("_k")).where("_n > 1")
    return _named(out.unionByName(fault(owners, "shared")), check, F.col("_f"))


def unparsed(rows: DataFrame, key: str, fields: dict[str, Column | None], check: str) -> DataFrame:
    """Rows with a null field, but for those that the field's exemption covers; keys are ``row:field``."""
    gone = [F.when(F.col(f).isNull() & (F.lit(True) if ok is None else ~F.coalesce(ok, F.lit(False))), F.lit(f)) for f, ok in fields.items()]
    each = rows.select(F.col(key).cast("string").alias("_k"), F.explode(F.array_compact(F.array(*gone))).alias("_f"))
    return _named(each, check, F.concat_ws(":", "_k", "_f"))


def altered(before: DataFrame, after: DataFrame, check: str) -> DataFrame:
    """Rows that a round trip lost (-) or made (+), as JSON, each as often as that."""
    shown = lambda df, sign: df.select(F.concat(F.lit(sign), F.to_json(F.struct(*before.columns), {"ignoreNullFields": "false"})).alias("_f"))
    a, b = before, after.select(before.columns)
    return _named(shown(a.exceptAll(b), "-").unionByName(shown(b.exceptAll(a), "+")), check, F.col("_f"))
