"""Queries that audit records with planted faults: pairing of axes, tiers, registries, definitions and authors."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import audit, checks
from shelfmark.plans.catalog import query, t
from shelfmark.plans.scans import reference_pages
from shelfmark.sources import catalogue

PAIRED = """n AS (SELECT n_nationkey AS k, n_name AS name FROM nation), bad AS (
SELECT 'axes: a theme names an area' AS c, 't' || k AS key FROM n WHERE k % 8 = 7 UNION ALL SELECT 'axes: one theme names an area', 'a' || k || ':0' FROM n WHERE k % 8 = 7 OR k = 3 OR k = 9 UNION ALL SELECT 'axes: one theme names an area', 'a4:2' FROM n WHERE k = 4
UNION ALL SELECT 'axes: named areas are there', 'nowhere' FROM n WHERE k = 9 UNION ALL SELECT 'axes: pages cover the areas', '+a' || k FROM n WHERE k % 10 = 1 UNION ALL SELECT 'axes: pages cover the areas', '-phantom' FROM n WHERE k = 0
UNION ALL SELECT 'axes: pages are distinct', 'Page' || name FROM n WHERE k = 12 UNION ALL SELECT 'axes: pages are files', 'a' || k || ':Page' || name FROM n WHERE k % 6 = 0 AND k <> 12 UNION ALL SELECT 'axes: pages are files', 'a' || x || ':Page' || name FROM n, (VALUES (12), (13)) v(x) WHERE k = 12
UNION ALL SELECT 'axes: the registry is the areas', 'a' || k FROM n WHERE k IN (5, 6, 8) UNION ALL SELECT 'axes: links cover the areas', '+a10' FROM n WHERE k = 10
UNION ALL SELECT 'axes: links are the pages', 'a' || k || ':odd' FROM n WHERE k % 9 = 5 UNION ALL SELECT 'axes: links are the pages', 'a13:page' || lower(name) FROM n WHERE k = 13
UNION ALL SELECT 'axes: seeds are the themes', 't' || k || CASE WHEN k = 2 THEN ':absent' WHEN k % 5 = 1 THEN ':label' ELSE ':area' END FROM n WHERE k = 2 OR k % 5 = 1 OR k IN (3, 9) OR (k % 8 = 7))"""


@query(f"""WITH {PAIRED} SELECT e.c AS check_name, count(bad.c) = 0 AS ok, count(bad.c)::BIGINT AS violations, min(bad.key) AS example FROM (VALUES {', '.join(f"('{c}')" for c in audit.PAIRING)}, ('never')) e(c) LEFT JOIN bad ON bad.c = e.c GROUP BY 1""")
def axis_pairing(spark, sf):
    """Nations as areas and themes; some themes name none, another or a strange area, some copies are stale."""
    n = t(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    k, tag = F.col("k"), lambda p, c=F.col("k"): F.concat(F.lit(p), c.cast("string"))
    named = F.when(k % 8 == 7, F.lit(None)).when(k == 3, "a4").when(k == 9, "nowhere").otherwise(tag("a"))
    topics = n.select(tag("t").alias("slug"), tag("Theme ").alias("label"), F.lit("theme").alias("tier"), named.alias("area_key")).unionByName(n.select(tag("g").alias("slug"), F.lit("Tag").alias("label"), F.lit("tag").alias("tier"), F.lit(None).cast("string").alias("area_key")))
    areas = n.select(tag("a").alias("key"), F.col("name").alias("label"), k.alias("place"))
    page = F.concat(F.lit("Page"), F.col("name"))
    twelfth = n.where("k = 12").select(page.alias("p12"))
    paged = n.where("k % 10 <> 1").join(F.broadcast(twelfth), how="left")
    pages = paged.select(tag("a").alias("key"), F.when(k == 13, F.col("p12")).otherwise(page).alias("page")).unionByName(n.where("k = 0").select(F.lit("phantom").alias("key"), F.lit("PagePhantom").alias("page")))
    files = n.where("k % 6 <> 0").select(page.alias("page"))
    registry = n.where("k <> 8").select(tag("a").alias("key"), F.when(k == 5, "Stale").otherwise(F.col("name")).alias("label"), F.when(k == 6, 99).otherwise(k).alias("place"))
    links = n.where("k <> 10").select(tag("a").alias("key"), F.when(k % 9 == 5, "odd").otherwise(F.lower(page)).alias("slug"))
    seeds = n.where("k <> 2").select(tag("t").alias("slug"), F.when(k % 5 == 1, "Old").otherwise(tag("Theme ")).alias("label"), F.col("name").alias("area"))
    return checks.verdicts([*audit.PAIRING, "never"], audit.axis_pairing(topics, areas, pages, files, registry, links, seeds))


AUDITS = ("mistyped", "two types", "unreached", "tiers: themes as expected", "tiers: a tag has a theme", "tiers: a theme has none", "tiers: areas are there", "area undefined", "method undefined", "themes documented", "override", "entry without id", "tag without item", "dropped authors")


@query(f"""WITH bad AS (SELECT 'mistyped' AS c, 's' || s_suppkey || ':software' AS key FROM supplier WHERE s_nationkey % 3 = 1 UNION ALL SELECT 'mistyped', 's' || s_suppkey || ':null' FROM supplier WHERE s_nationkey % 3 = 2 UNION ALL SELECT 'two types', 's' || s_suppkey || ':null' FROM supplier WHERE s_nationkey % 3 = 2
UNION ALL SELECT 'unreached', c_custkey::VARCHAR FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000 UNION SELECT o_custkey + 1 FROM orders WHERE o_totalprice > 300000)
UNION ALL SELECT 'tiers: themes as expected', '+t3' FROM region WHERE r_regionkey = 3 UNION ALL SELECT 'tiers: themes as expected', '-t9' FROM region WHERE r_regionkey = 3
UNION ALL SELECT 'tiers: a tag has a theme', 'n' || n_nationkey FROM nation WHERE n_nationkey % 7 = 0 OR n_nationkey = 5 UNION ALL SELECT 'tiers: a theme has none', 't2' FROM region WHERE r_regionkey = 2 UNION ALL SELECT 'tiers: areas are there', 'n' || n_nationkey FROM nation WHERE n_nationkey % 6 = 1
UNION ALL SELECT 'area undefined', r_name FROM region WHERE r_regionkey % 2 = 1 UNION ALL SELECT 'method undefined', n_name FROM nation WHERE n_nationkey % 4 < 2 UNION ALL SELECT 'themes documented', '4' FROM region WHERE r_regionkey = 0
UNION ALL SELECT DISTINCT 'override', l_partkey::VARCHAR FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) UNION ALL SELECT 'entry without id', p_partkey::VARCHAR FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 25)
UNION ALL SELECT DISTINCT 'tag without item', l_partkey::VARCHAR FROM lineitem WHERE l_quantity > 25 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 20) UNION ALL SELECT 'dropped authors', c_custkey || ':1' FROM customer WHERE c_custkey % 5 > 0 AND c_custkey % 4 < 2)
SELECT e.c AS check_name, count(bad.c) = 0 AS ok, count(bad.c)::BIGINT AS violations, min(bad.key) AS example FROM (VALUES {', '.join(f"('{c}')" for c in AUDITS)}) e(c) LEFT JOIN bad ON bad.c = e.c GROUP BY 1""")
def record_audit(spark, sf):
    s, c, o, p, li, n, r = (t(spark, sf, x) for x in ("supplier", "customer", "orders", "part", "lineitem", "nation", "region"))
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    kind = F.when(F.col("s_nationkey") % 3 == 0, "database").when(F.col("s_nationkey") % 3 == 1, "software")
    items, details = s.select(tag("s", "s_suppkey").alias("id"), kind.alias("type")), s.select(tag("s", "s_suppkey").alias("item_id"))
    refs = c.select(F.col("c_custkey").alias("ref_id"), F.when(F.col("c_custkey") % 2 == 0, "References").otherwise("Notes").alias("section"))
    cells = o.where("o_totalprice > 300000").select(F.array(F.col("o_custkey"), F.col("o_custkey") + 1).alias("refs"))
    theme = r.select(tag("t", "r_regionkey").alias("slug"), F.lit("theme").alias("tier"), F.when(F.col("r_regionkey") == 2, "t1").alias("theme_slug"), F.lit(None).cast("string").alias("area_key"))
    parent = F.when(F.col("n_nationkey") == 5, "gone").when(F.col("n_nationkey") % 7 > 0, tag("t", "n_regionkey"))
    tags = n.select(tag("n", "n_nationkey").alias("slug"), F.lit("tag").alias("tier"), parent.alias("theme_slug"), F.when(F.col("n_nationkey") % 6 == 1, "odd").when(F.col("n_nationkey") % 6 == 2, "a1").alias("area_key"))
    want = r.where("r_regionkey <> 3").select(tag("t", "r_regionkey").alias("slug")).unionByName(r.where("r_regionkey = 3").select(F.lit("t9").alias("slug")))
    areas = r.select(tag("a", "r_regionkey").alias("key"))
    # Labels may be defined on the other axis, or blank on their own.
    defs = r.select(F.when(F.col("r_regionkey") % 2 == 0, "area").otherwise("method").alias("axis"), F.col("r_name").alias("label"), F.lit("d").alias("definition"))
    defs = defs.unionByName(n.where("n_nationkey % 4 > 0").select(F.lit("method").alias("axis"), F.col("n_name").alias("label"), F.when(F.col("n_nationkey") % 4 == 1, " ").otherwise("d").alias("definition")))
    defs = defs.unionByName(r.where("r_regionkey > 0").select(F.lit("theme").alias("axis"), F.col("r_name").alias("label"), F.lit("d").alias("definition")))
    tagged = li.where("l_quantity > 25")
    read = catalogue.references(reference_pages(spark, sf), "page", "text")
    return checks.verdicts(
        AUDITS,
        audit.mistyped(details, "item_id", items, ["database"], "mistyped"),
        audit.mistyped(details, "item_id", items, ["software", "database"], "two types"),
        audit.unreached(refs, cells, "References", "unreached"),
        audit.topic_tiers(theme.unionByName(tags), want, areas),
        audit.undefined(r.select("r_name"), defs, "area", "area undefined"),
        audit.undefined(n.select("n_name"), defs, "method", "method undefined"),
        audit.off_count(defs, F.col("axis") == "theme", 5, "themes documented"),
        checks.orphans(li, "l_partkey", p.where("p_size > 5"), "p_partkey", "override"),
        checks.orphans(p, "p_partkey", tagged, "l_partkey", "entry without id"),
        checks.orphans(tagged, "l_partkey", p.where("p_size > 20"), "p_partkey", "tag without item"),
        audit.dropped_tokens(read, "id", "authors_dropped", "dropped authors"),
    )
