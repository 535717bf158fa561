"""Checks of a catalogue's records: registries and their detail rows, tiers of topics, and the pairing of themes with research areas. Each is a frame of violations, as in ``checks``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import checks


def _bad(df: DataFrame, check: str, *parts: str | Column) -> DataFrame:
    key = F.concat_ws(":", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("null")) for p in parts])
    return df.select(F.lit(check).alias("check_name"), key.alias("violation_key"))


def united(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def mistyped(details: DataFrame, fk: str, items: DataFrame, types: Sequence[str], check: str) -> DataFrame:
    """Detail rows whose item is there, but of none of the types; a null type is none of them."""
    found = details.select(F.col(fk).alias("_id")).join(items.select(F.col("id").alias("_id"), F.col("type").alias("_t")), "_id")
    return _bad(found.where(~F.coalesce(F.col("_t").isin(*types), F.lit(False))), check, "_id", "_t")


def unreached(refs: DataFrame, cells: DataFrame, section: str, check: str) -> DataFrame:
    """References of a section (``ref_id, section``) that no cell's list ``refs`` names."""
    named = cells.select(F.explode("refs").alias("ref_id")).distinct()
    return _bad(refs.where(F.col("section") == section).join(named, "ref_id", "left_anti"), check, "ref_id")


def dropped_tokens(refs: DataFrame, key: str, dropped: str, check: str) -> DataFrame:
    """References whose line has names that could not be read, with how many."""
    return _bad(refs.where(F.col(dropped) > 0), check, key, dropped)


def undefined(labels: DataFrame, definitions: DataFrame, axis: str, check: str) -> DataFrame:
    """Labels (a single column) without a definition, or with a blank one, on their own axis (``axis, label, definition``)."""
    k = labels.columns[0]
    own = definitions.where((F.col("axis") == axis) & (F.trim("definition") != "")).select(F.col("label").alias(k)).distinct()
    return _bad(labels.distinct().join(own, k, "left_anti"), check, k)


def off_count(rows: DataFrame, condition: Column, want: int, check: str) -> DataFrame:
    """The number of rows that fit, where it is another than ``want``."""
    return _bad(rows.agg(F.count_if(condition).alias("_n")).where(F.col("_n") != want), check, "_n")


def topic_tiers(topics: DataFrame, themes: DataFrame, areas: DataFrame) -> DataFrame:
    """Topics (``slug, tier, theme_slug, area_key``) against the expected themes (one column) and areas (``key``): the set of themes, a theme for each tag, none for a theme, areas that are there."""
    theme = topics.where("tier = 'theme'")
    tag = topics.where("tier = 'tag'").join(theme.select(F.col("slug").alias("theme_slug")).distinct(), "theme_slug", "left_anti")
    return united(
        checks.set_difference(theme.select("slug"), themes.toDF("slug"), "tiers: themes as expected"),
        _bad(tag, "tiers: a tag has a theme", "slug"),
        _bad(theme.where("theme_slug IS NOT NULL"), "tiers: a theme has none", "slug"),
        _bad(topics.where("area_key IS NOT NULL").join(areas.select(F.col("key").alias("area_key")), "area_key", "left_anti"), "tiers: areas are there", "slug"),
    )


#: The checks of ``axis_pairing`` by name.
PAIRING = (
    "axes: a theme names an area", "axes: one theme names an area", "axes: named areas are there", "axes: pages cover the areas", "axes: pages are distinct", "axes: pages are files",
    "axes: the registry is the areas", "axes: links cover the areas", "axes: links are the pages", "axes: seeds are the themes",
)


def axis_pairing(topics: DataFrame, areas: DataFrame, pages: DataFrame, files: DataFrame, registry: DataFrame, links: DataFrame, seeds: DataFrame) -> DataFrame:
    """That themes and research areas are paired one to one by key, and that every copy of the pairing agrees.

    ``topics`` (``slug, label, tier, area_key``), ``areas`` (``key, label, place``), ``pages`` (``key, page``), ``files`` (``page``), ``registry`` (``key, label, place``: the parser's copy), ``links`` (``key, slug``: the route of a page is its name in
    lower case), ``seeds`` (``slug, label, area``: an area by its label). Labels of the two axes are never compared with each other.
    """
    theme, key = topics.where("tier = 'theme'"), areas.select("key")
    named = theme.where("area_key IS NOT NULL").groupBy(F.col("area_key").alias("key")).agg(F.count("*").alias("n"))
    count = key.join(named, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))
    own = pages.join(key, "key", "left_semi")
    shared = own.groupBy("page").agg(F.count("*").alias("n")).where("n > 1")
    copy = registry.select("key", F.col("label").alias("_label"), F.col("place").alias("_place"), F.lit(True).alias("_there"))
    both = areas.withColumn("_here", F.lit(True)).join(copy, "key", "full")
    alike = F.col("label").eqNullSafe(F.col("_label")) & F.col("place").eqNullSafe(F.col("_place")) & F.col("_here").isNotNull() & F.col("_there").isNotNull()
    route = links.join(pages, "key").where(~F.col("slug").eqNullSafe(F.lower("page")))
    by_label = areas.groupBy(F.col("label").alias("area")).agg(F.min("key").alias("_key"))
    seed = seeds.join(by_label, "area", "left").select("slug", F.col("label").alias("_label"), "_key", F.lit(True).alias("_there"))
    drift = theme.select("slug", "label", "area_key").join(seed, "slug", "left")
    why = F.when(F.col("_there").isNull(), "absent").when(~F.col("label").eqNullSafe(F.col("_label")), "label").when(~F.col("area_key").eqNullSafe(F.col("_key")), "area")
    return united(
        _bad(theme.where("area_key IS NULL"), PAIRING[0], "slug"),
        _bad(count.where("n <> 1"), PAIRING[1], "key", "n"),
        _bad(named.join(key, "key", "left_anti"), PAIRING[2], "key"),
        checks.set_difference(key, pages.select("key"), PAIRING[3]),
        _bad(shared, PAIRING[4], "page"),
        _bad(own.join(files.select("page").distinct(), "page", "left_anti"), PAIRING[5], "key", "page"),
        _bad(both.where(~alike), PAIRING[6], "key"),
        checks.set_difference(key, links.select("key"), PAIRING[7]),
        _bad(route, PAIRING[8], "key", "slug"),
        _bad(drift.withColumn("_why", why).where("_why IS NOT NULL"), PAIRING[9], "slug", "_why"),
    )
