"""Lookups: one dimension row for each key, then left joins that keep every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.text import doi_key, licence_tier, link_parts, slugify
from shelfmark.session import settle


def pick(dim: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row by ``order`` for each key, by a partial aggregation instead of a window."""
    rest = [c for c in dim.columns if c not in keys]
    rank = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)])
    best = dim.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_r"))
    return best.select(*keys, "_r.*")


def lookup(facts: DataFrame, dim: DataFrame, keys: Sequence[str], default: dict[str, Column] | None = None) -> DataFrame:
    """Left join on a dimension that has one row for each key."""
    out = facts.join(dim, list(keys), "left")
    for c, v in (default or {}).items():
        out = out.withColumn(c, F.coalesce(F.col(c), v))
    return out


def override(base: DataFrame, manual: DataFrame, auto: DataFrame, key: str, value: str) -> DataFrame:
    """``value`` by hand if there is one, else the automatic one, with its source."""
    m = manual.select(key, F.col(value).alias("_m"))
    a = auto.select(key, F.col(value).alias("_a"))
    source = F.when(F.col("_m").isNotNull(), "manual").when(F.col("_a").isNotNull(), "auto")
    return base.join(m, key, "left").join(a, key, "left").select(*base.columns, F.coalesce("_m", "_a").alias(value), source.alias("value_source"))


def distinct_sum(rows: DataFrame, group: str, key: str, dim: DataFrame, value: str) -> DataFrame:
    """Sum of a looked-up value over each group's distinct keys; null where no key has one, with the number that have."""
    own = rows.select(group, key).distinct().join(dim.select(key, value), key, "left")
    return own.groupBy(group).agg(F.sum(value).alias("total"), F.count(value).alias("contributors"))


def unresolved(refs: DataFrame, kind: str, key: str, targets: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """References whose kind names a target table that lacks the key; other kinds are not checked."""
    known = None
    for k, (df, c) in targets.items():
        part = df.select(F.lit(k).alias(kind), F.col(c).cast("long").alias(key)).distinct()
        known = part if known is None else known.unionByName(part)
    return refs.where(F.col(kind).isin(list(targets))).join(known, [kind, key], "left_anti")


def numbered(rows: DataFrame, by: str, order: Sequence[str], name: str) -> DataFrame:
    """Place within the group, from 0."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)


def places(rows: DataFrame, order: Sequence[str | Column], name: str, by: str | None = None) -> DataFrame:
    """``rows`` with their place from 0 in the whole order, or in that of each ``by``, without a window over them: rows are sorted in ranges, each is numbered in its range, and the ranges' sizes are added up.

    What is in one place is a row for each range and, with ``by``, for each group that goes on in it. Rows that are alike in ``order`` are numbered in any order. Settled.
    """
    keys = [by] if by else []
    d = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_m", F.monotonically_increasing_id())
    d = settle(d.withColumn("_part", F.shiftright("_m", 33)))
    sizes = d.groupBy("_part", *keys).agg(F.count("*").alias("_c"), F.min("_m").alias("_first"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", *keys, "_first", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_b"))
    if not by:
        out = d.join(F.broadcast(starts), "_part")  # a row for each range
    else:
        out = d.join(starts.withColumnRenamed(by, "_by"), (d["_part"] == starts["_part"]) & F.col(by).eqNullSafe(F.col("_by"))).drop(starts["_part"])
    return out.withColumn(name, F.col("_m") - F.col("_first") + F.col("_b")).select(*rows.columns, name)


def letter_suffix(rows: DataFrame, base: str, order: Sequence[str], name: str = "slug", dash: bool = True) -> DataFrame:
    """Unique names: the first keeps its base, later ones get b, c, ..., from the 27th on the number."""
    n = F.col("_n")
    mark = F.when(n < 26, F.chr(n + 97)).otherwise(n.cast("string"))
    gap = F.lit("-") if dash else F.when(n < 26, F.lit("")).otherwise(F.lit("-"))
    out = numbered(rows, base, order, "_n")
    return out.withColumn(name, F.when(n == 0, F.col(base)).otherwise(F.concat(F.col(base), gap, mark))).drop("_n")


def free_ids(rows: DataFrame, base: str, order: Sequence[str], taken: DataFrame, name: str) -> DataFrame:
    """``rows`` with the id that each would get one after the other in ``order`` (unique): its base, or where that is taken the first free of ``-2``, ``-3``, ...; null for a null base.

    ``taken`` has ids in its only column. An id ``x-k`` can go to the base ``x-k`` itself, at its first row, or to a row of the base ``x``; nothing else meets. So of a base's numbers those are
    closed that are taken before, or whose own base comes earlier than the row that would use them. Numbers that no base spells are free, and rows number them by their place; what is left are the
    spelled numbers of a base, and these are settled in rounds, each fixing every number whose lower ones are fixed, as many rounds as the most spelled base has numbers that its rows reach.
    """
    when = F.struct(*order)
    own = settle(rows.where(F.col(base).isNotNull()).select(F.col(base).alias("_b"), when.alias("_t"), F.row_number().over(Window.partitionBy(base).orderBy(*order)).cast("long").alias("_m")))
    old = taken.dropna().distinct().toDF("_id")
    spelled = r"^(.*)-([1-9][0-9]{0,17})$"
    apart = lambda c: (F.regexp_extract(c, spelled, 1).alias("_b"), F.regexp_extract(c, spelled, 2).try_cast("long").alias("_k"))
    firsts = own.where("_m = 1").select(F.col("_b").alias("_id"), "_t")
    # Closed from the start: ids of ``taken``; closed from their first row on: ids that are bases.
    named = firsts.join(old.withColumn("_old", F.lit(True)), "_id", "full")
    sizes = own.groupBy("_b").agg(F.max("_m").alias("_n"))
    # Number k of a base is its own rows' k-th try at the earliest (the base itself is number 1), one earlier if the base is taken.
    marks = named.where(F.col("_id").rlike(spelled)).select(*apart(F.col("_id")), "_id", "_t", F.coalesce("_old", F.lit(False)).alias("_old")).where("_k >= 2").join(sizes, "_b")
    marks = marks.withColumn("_place", F.row_number().over(Window.partitionBy("_b").orderBy("_k")).cast("long"))
    marks = settle(marks.where("_k - _place <= _n + 1"))
    lost = settle(named.where("_old").select(F.col("_id").alias("_b"), F.lit(1).cast("long").alias("_lost")))  # bases whose own name is gone before any row
    closed = marks.limit(0).select("_id", "_b", "_k")
    wins = marks.limit(0).select("_id")
    while True:
        # The base's name is gone also where another base's row has won it.
        gone = lost.unionByName(wins.select(F.col("_id").alias("_b"), F.lit(1).cast("long").alias("_lost")))
        done = closed.groupBy("_b").agg(F.count("*").alias("_c"))
        seen = closed.select("_id").unionByName(wins)
        open_ = marks.join(seen, "_id", "left_anti")
        if open_.isEmpty():
            break
        # Whether a base's own name is gone is known once the mark that spells it is settled.
        waiting = open_.select(F.col("_id").alias("_b"))
        low = open_.join(waiting, "_b", "left_anti").groupBy("_b").agg(F.min(F.struct("_k", "_id", "_t", "_old")).alias("_x")).select("_b", "_x.*")
        low = low.join(done, "_b", "left").join(gone, "_b", "left")
        # The row that reaches number k: k - 1 numbers and the base before it, less those closed, one less if the base is gone.
        low = low.withColumn("_m", F.col("_k") - F.coalesce("_c", F.lit(0)) - F.coalesce("_lost", F.lit(0)))
        rival = own.select("_b", "_m", F.col("_t").alias("_u"))
        low = low.join(rival, ["_b", "_m"], "left")
        won = ~F.col("_old") & F.col("_u").isNotNull() & (F.col("_t").isNull() | (F.col("_u") < F.col("_t")))
        low = settle(low.select("_id", "_b", "_k", won.alias("_won")))
        closed = settle(closed.unionByName(low.where("NOT _won").select("_id", "_b", "_k")))
        wins = settle(wins.unionByName(low.where("_won").select("_id")))
    gone = lost.unionByName(wins.select(F.col("_id").alias("_b"), F.lit(1).cast("long").alias("_lost")))
    # The i-th closed number k of a base pushes all rows from try k - i + 1 on by one.
    step = closed.select("_b", (F.col("_k") - F.row_number().over(Window.partitionBy("_b").orderBy("_k")) + 1).alias("_p"), F.lit(1).cast("long").alias("_w"), F.lit(None).cast(own.schema["_t"].dataType).alias("_t"))
    tries = own.join(gone, "_b", "left").select("_b", (F.col("_m") + F.coalesce("_lost", F.lit(0))).alias("_p"), F.lit(0).cast("long").alias("_w"), "_t")
    pushed = F.sum("_w").over(Window.partitionBy("_b").orderBy("_p").rangeBetween(Window.unboundedPreceding, 0))
    out = step.unionByName(tries).withColumn("_n", F.col("_p") + pushed).where("_w = 0")
    ids = out.select(F.col("_b").alias(base), "_t", F.when(F.col("_n") == 1, F.col("_b")).otherwise(F.concat_ws("-", "_b", F.col("_n").cast("string"))).alias(name))
    return rows.withColumn("_t", when).join(ids, [base, "_t"], "left").select(*rows.columns, name)


def id_runs(ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Gaps ``(first_missing, last_missing)`` and runs ``(first_id, last_id)`` of an integer id; repeated ids count once, nulls not.

    An id less its place among all ids is the same throughout a run, so runs are sums by that; a gap lies between a run and the one at the next place.
    """
    one = places(ids.select(F.col(key).cast("long").alias("id")).dropna().distinct(), ["id"], "_n")
    runs = one.groupBy((F.col("id") - F.col("_n")).alias("_r")).agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).drop("_r")
    at = places(runs, ["first_id"], "_n")
    after = at.select((F.col("_n") - 1).alias("_n"), F.col("first_id").alias("_next"))
    gaps = at.join(after, "_n").select((F.col("last_id") + 1).alias("first_missing"), (F.col("_next") - 1).alias("last_missing"))
    return gaps, at.select("first_id", "last_id")


def routed(rows: DataFrame, url: str, source: str, pages: DataFrame, base: str, fallback: str, name: str = "link") -> DataFrame:
    """``rows`` with the address of each relative link to a Markdown file: that of its page, if the table ``pages`` (one column) has it, else of the file itself under ``fallback``; other links stay as they are."""
    d = rows.withColumn("_p", F.explode(F.array(link_parts(F.col(url), F.col(source)))))
    known = pages.toDF("_page").dropna().distinct().withColumn("_known", F.lit(True))
    d = d.join(known, (F.col("_p.page") == F.col("_page")) & ~F.col("_p.stays"), "left")
    own = F.concat(F.lit(base.rstrip("/") + "/"), F.col("_p.page"), F.lit("/"))
    to = F.when(F.col("_p.stays") | F.col(url).isNull(), F.col(url)).when(F.col("_known"), own).otherwise(F.concat(F.lit(fallback + "/"), F.col("_p.whole"), F.col("_p.anchor")))
    return d.select(*rows.columns, to.alias(name))


def by_doi(rows: DataFrame, doi: str, works: DataFrame) -> DataFrame:
    """``rows`` with the columns of the work of the same DOI, both normalised; of works of one DOI the smallest by its columns counts, a row without a DOI has none."""
    rest = [c for c in works.columns if c != "doi"]
    known = works.select(doi_key(F.col("doi")).alias("_d"), F.struct(*rest).alias("_w")).where("_d IS NOT NULL").groupBy("_d").agg(F.min("_w").alias("_w"))
    return rows.withColumn("_k", doi_key(F.col(doi))).join(known, F.col("_k") == F.col("_d"), "left").select(*rows.columns, "_w.*")


def segment(first: Column, last: Column) -> Column:
    """``#5`` for one number, ``#5–#9`` for several."""
    return F.concat(F.lit("#"), first.cast("string"), F.when(first == last, F.lit("")).otherwise(F.concat(F.lit("–#"), last.cast("string"))))


def cited(rows: DataFrame, key: str, doi: Column, related: Column, counts: DataFrame) -> DataFrame:
    """``key, citation_count, citation_sources, citation_dois`` of every row: the counts (``doi, n``) of its distinct DOIs, its own first, then the related ones in their order; the DOIs that have a count are listed in that order, and
    where none has one the sum is null. Of several counts of one DOI the largest is taken."""
    each = rows.select(key, F.posexplode(F.concat(F.array(doi), F.coalesce(related, F.array().cast("array<string>")))).alias("_i", "_d")).withColumn("_d", doi_key(F.col("_d"))).where("_d IS NOT NULL")
    each = each.groupBy(key, "_d").agg(F.min("_i").alias("_i"))
    known = counts.select(doi_key(F.col("doi")).alias("_d"), F.col("n").alias("_c")).where("_d IS NOT NULL AND _c IS NOT NULL").groupBy("_d").agg(F.max("_c").alias("_c"))
    sums = each.join(known, "_d").groupBy(key).agg(F.sum("_c").alias("citation_count"), F.count("*").alias("citation_sources"), F.array_sort(F.collect_list(F.struct("_i", "_d")))["_d"].alias("citation_dois"))
    out = rows.select(key).join(sums, key, "left")
    return out.select(key, "citation_count", F.coalesce("citation_sources", F.lit(0)).cast("long").alias("citation_sources"), F.coalesce("citation_dois", F.array().cast("array<string>")).alias("citation_dois"))


def page_anchors(rows: DataFrame, page: str, name: str, order: Sequence[str], out: str = "anchor", prefix: str = "ds-") -> DataFrame:
    """``rows`` with an id for each that is unique on its page: the prefix and the slug of the name (``entry`` where nothing is left of it), or its first free ``-2``, ``-3``, ... One run of ``free_ids`` settles all pages, as the page
    is a part of what is compared. ``order`` is unique."""
    base = F.concat(F.coalesce(F.col(page), F.lit("")), F.lit("/" + prefix), F.coalesce(F.nullif(slugify(F.col(name)), F.lit("")), F.lit("entry")))
    d = rows.withColumn("_page_base", base)
    none = rows.sparkSession.createDataFrame([], "id string")
    d = free_ids(d, "_page_base", order, none, "_page_id")
    return d.select(*rows.columns, F.substring("_page_id", F.length(F.coalesce(F.col(page), F.lit(""))) + 2, F.length("_page_id")).alias(out))


def curated_model(entries: DataFrame, topics: DataFrame, counts: DataFrame) -> DataFrame:
    """The model of curated entries: ``item_id, place, name, url, page, section, kind, license, license_source, doi, doi_source, related_dois`` with ``anchor`` (unique on its page, by ``place``), ``topics`` (of ``item_id, slug, theme``, in that order),
    ``tier`` of the licence, and the citations of ``cited``. ``related_dois`` is a JSON list; null and malformed ones are empty."""
    own = topics.where("slug IS NOT NULL").groupBy("item_id").agg(F.array_sort(F.collect_set(F.struct("slug", "theme"))).alias("topics"))
    related = F.coalesce(F.from_json("related_dois", "array<string>"), F.array().cast("array<string>"))
    # The citations follow the row's place, so that rows of one item keep their own.
    found = cited(entries, "place", F.col("doi"), related, counts)
    d = page_anchors(entries, "page", "name", ["place"]).join(found, "place").join(own, "item_id", "left")
    none = F.array().cast(own.schema["topics"].dataType)
    return d.withColumn("tier", licence_tier(F.col("license"))).withColumn("topics", F.coalesce("topics", none)).drop("related_dois")


def last_known(rows: DataFrame, by: str, order: str, value: Column, name: str) -> DataFrame:
    """Carry the last non-null value forward within each group."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))
