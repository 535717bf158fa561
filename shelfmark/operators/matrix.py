"""Dense grids from sparse memberships."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.text import share


def grid(cells: DataFrame, rows: DataFrame, cols: DataFrame, row: str, col: str, item: str) -> DataFrame:
    """Every (row, col) of the two dimensions with its number of distinct items; an empty cell is a row with 0.

    Cells are counted before they meet the grid, whose size is that of the two vocabularies.
    """
    counts = cells.groupBy(row, col).agg(F.count_distinct(item).alias("n_items"))
    frame = rows.select(row).distinct().join(cols.select(col).distinct(), how="cross")
    return frame.join(counts, [row, col], "left").select(row, col, F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"))


def coverage(full: DataFrame) -> DataFrame:
    """One row: cells, filled cells and their share."""
    filled = F.count_if(F.col("n_items") > 0)
    return full.agg(F.count("*").alias("cells"), filled.alias("filled"), share(filled, F.count("*")).alias("coverage"))


def zero_filled(cells: DataFrame, dim: DataFrame, key: str, item: str, name: str = "n_items") -> DataFrame:
    """Distinct items by member of ``dim``; members without items have 0."""
    counts = cells.groupBy(key).agg(F.count_distinct(item).alias(name))
    return dim.select(key).distinct().join(counts, key, "left").select(key, F.coalesce(name, F.lit(0)).cast("long").alias(name))


def pivoted(cells: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """Counts by row with a column for each of the given values."""
    return cells.groupBy(row).pivot(col, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def subject_grid(items: DataFrame, topics: str, kind: str, kinds: Sequence[str], tree: DataFrame) -> DataFrame:
    """Themes and their tags with the items that have them, in all and by kind: ``row, slug, label, level, theme, total`` and a column for each of ``kinds``.

    ``topics`` is an array of structs with ``slug`` and ``theme``; ``tree`` has ``slug, label, theme, place``, where ``theme`` is null for a theme. An item counts once in each row, also in a theme several of whose tags it has, or whose tag
    and theme. Rows without items have zeros; kinds that are not named count in the total only. ``row`` is the order: themes by their place, each followed by its tags, those with most items first, then by place.

    Each item makes one row for each of its distinct slugs and themes, and these are counted once, by a partial aggregation; then the counts meet the tree, whose size is that of a vocabulary.
    """
    both = F.array_distinct(F.concat(F.transform(topics, lambda x: F.struct(F.lit("tag").alias("level"), x["slug"].alias("slug"))), F.transform(topics, lambda x: F.struct(F.lit("theme").alias("level"), x["slug"].alias("slug"))), F.transform(topics, lambda x: F.struct(F.lit("theme").alias("level"), x["theme"].alias("slug")))))
    own = items.select(F.col(kind).alias("_k"), F.explode(both).alias("_s")).select("_k", "_s.level", "_s.slug")
    counts = own.groupBy("level", "slug").agg(F.count("*").alias("total"), *[F.count_if(F.col("_k") == k).alias(k) for k in kinds])
    places = tree.select("slug", F.col("place").alias("_p"))
    rows = tree.withColumn("level", F.when(F.col("theme").isNull(), "theme").otherwise("tag")).join(counts, ["level", "slug"], "left")
    rows = rows.join(places.withColumnRenamed("slug", "theme"), "theme", "left").na.fill(0, ["total", *kinds])
    order = Window.orderBy(F.coalesce("_p", "place"), F.col("theme").isNotNull(), F.when(F.col("theme").isNotNull(), -F.col("total")), "place")
    return rows.select((F.row_number().over(order) - 1).alias("row"), "slug", "label", "level", "theme", "total", *kinds)
