"""Comparison of sets, and members of groups in a given order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row for each key of either single-column set with ``in_a`` and ``in_b``, by one exchange; null keys count as members."""
    k = a.columns[0]
    both = a.select(k, F.lit(True).alias("a"), F.lit(False).alias("b")).unionByName(b.toDF(k).select(k, F.lit(False).alias("a"), F.lit(True).alias("b")))
    return both.groupBy(k).agg(F.bool_or("a").alias("in_a"), F.bool_or("b").alias("in_b"))


def exclusive(a: DataFrame, b: DataFrame) -> DataFrame:
    """Members of just one set, with its side."""
    return _sides(a, b).where("in_a <> in_b").select(a.columns[0], F.when(F.col("in_a"), "left").otherwise("right").alias("side"))


def equality(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: members of only the left and only the right set, and whether there are none."""
    left, right = F.count_if(F.expr("in_a AND NOT in_b")), F.count_if(F.expr("in_b AND NOT in_a"))
    return _sides(a, b).agg(left.alias("only_left"), right.alias("only_right"), ((left + right) == 0).alias("same"))


def ordered_list(rows: DataFrame, group: str, order: Sequence[str], value: str, name: str, gap: str = ",") -> DataFrame:
    """Each group's values as text, in the order given and then by value; null values are left out. A group is gathered in one row."""
    listed = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("_v")))))
    return rows.groupBy(group).agg(F.array_join(F.transform(listed, lambda x: x["_v"].cast("string")), gap).alias(name))


def examples(rows: DataFrame, group: str, key: str, most: int) -> DataFrame:
    """By group the number of rows and its least keys; only those few are gathered."""
    total = rows.groupBy(group).agg(F.count("*").alias("total"))
    few = rows.select(group, key).withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(key))).where(F.col("_k") <= most)
    return total.join(ordered_list(few, group, ["_k"], key, "examples"), group)


def inverted(rows: DataFrame, tag: str, kind: str, key: str, kinds: Sequence[str]) -> DataFrame:
    """Each tag with the sorted ids of each kind, an empty list where it has none; only tags that any row has. For lists too long for a row take ``rows`` themselves, sorted by tag, kind and id."""
    lists = [F.array_sort(F.collect_list(F.when(F.col(kind) == k, F.col(key)))).alias(k) for k in kinds]
    return rows.groupBy(tag).agg(*lists)


def nested_size(lists: Column) -> Column:
    """Members of a list of lists in all; null lists have none."""
    return F.coalesce(F.aggregate(lists, F.lit(0).cast("long"), lambda n, x: n + F.coalesce(F.array_size(x), F.lit(0))), F.lit(0).cast("long"))
