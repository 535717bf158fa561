"""Assertions inside a plan: a row that breaks one fails the job that reads it. Nothing is collected and nothing runs beforehand."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asserted(df: DataFrame, ok: Column, message: Column) -> DataFrame:
    """``df``; its first row for which ``ok`` is not true ends the job with the message."""
    return df.where(F.when(ok, True).otherwise(F.raise_error(message).cast("boolean")))


def positional(a: DataFrame, b: DataFrame, by: str, order_a: Sequence[str], order_b: Sequence[str], name: str = "position") -> DataFrame:
    """The n-th row of ``a`` beside the n-th row of ``b`` of each group, from 0; groups of unlike sizes end the job, and so do those that only one side has. Rows of a null group stand in a group of their own.

    The columns of ``b`` other than ``by`` must not have names that ``a`` has.
    """
    place = lambda df, order: df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)
    left = place(a, order_a).withColumn("_left", F.lit(True))
    right = place(b, order_b).withColumn("_right", F.lit(True)).withColumnsRenamed({by: "_by", name: "_at"})
    both = left.join(right, left[by].eqNullSafe(right["_by"]) & (left[name] == right["_at"]), "full")
    lone = F.concat(F.lit(f"rows of one side only: {by} "), F.coalesce(F.coalesce(by, "_by").cast("string"), F.lit("null")), F.lit(" from position "), F.coalesce(name, "_at").cast("string"))
    return asserted(both, F.col("_left").isNotNull() & F.col("_right").isNotNull(), lone).drop("_left", "_right", "_by", "_at")


def exactly_one(df: DataFrame, by: str, match: Column) -> DataFrame:
    """The one matching row of each group, by a partial aggregation; a group with none or several ends the job."""
    hit = F.coalesce(match, F.lit(False))
    one = df.groupBy(by).agg(F.count_if(hit).alias("_n"), F.min(F.when(hit, F.struct(*df.columns))).alias("_row"))
    message = F.concat(F.lit(f"not exactly one row: {by} "), F.coalesce(F.col(by).cast("string"), F.lit("null")), F.lit(" has "), F.col("_n").cast("string"))
    return asserted(one, F.col("_n") == 1, message).select("_row.*")
