"""Queries on order, sets and resolution, in the same registry as the catalogue's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.operators import checks, dml, enrich, graph, sets
from shelfmark.plans.catalog import GRID, STARS, matrix_full_grid, query, stars, t


@query("""WITH m AS (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations WHERE role IN ('user', 'assistant'))
SELECT u.conv_id, u.k, u.turn AS asked, a.turn AS answered FROM m u JOIN m a ON u.conv_id = a.conv_id AND u.k = a.k WHERE u.role = 'user' AND a.role = 'assistant'""")
def positional_pairs(spark, sf):
    c = t(spark, sf, "conversations").select("conv_id", "role", "turn")
    asked = enrich.numbered(c.where("role = 'user'"), "conv_id", ["turn"], "k").select("conv_id", "k", F.col("turn").alias("asked"))
    answered = enrich.numbered(c.where("role = 'assistant'"), "conv_id", ["turn"], "k").select("conv_id", "k", F.col("turn").alias("answered"))
    return asked.join(answered, ["conv_id", "k"]).withColumn("k", (F.col("k") + 1).cast("long"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_type, '(?i)steel') THEN 'metal' WHEN regexp_matches(p_type, '(?i)^[a-e]') THEN 'early' ELSE 'other' END AS grp FROM part")
def first_rule(spark, sf):
    return t(spark, sf, "part").select("p_partkey", T.first_rule(F.col("p_type"), {"metal": "steel", "early": "^[a-e]"}, "other").alias("grp"))


@query("SELECT doc_id, source AS tag FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1")
def replaced_sets(spark, sf):
    old = t(spark, sf, "documents").select("doc_id", F.col("source").alias("tag"))
    return dml.replace_sets(old, t(spark, sf, "labels").where("toxic = 1").select("doc_id", F.lit("toxic").alias("tag")), "doc_id")


RICH = "(SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 300000)"
PAID = "(SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 2000)"


def two_sets(spark, sf) -> tuple[DataFrame, DataFrame]:
    return t(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("k")), t(spark, sf, "customer").where("c_acctbal > 2000").select(F.col("c_custkey").alias("k"))


@query(f"SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'left' ELSE 'right' END AS side FROM {RICH} a FULL JOIN {PAID} b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def exclusive_members(spark, sf):
    return sets.exclusive(*two_sets(spark, sf))


@query(f"SELECT count(*) FILTER (b.k IS NULL)::BIGINT AS only_left, count(*) FILTER (a.k IS NULL)::BIGINT AS only_right, count(*) FILTER (a.k IS NULL OR b.k IS NULL) = 0 AS same FROM {RICH} a FULL JOIN {PAID} b ON a.k = b.k")
def set_equality(spark, sf):
    return sets.equality(*two_sets(spark, sf))


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS orders FROM orders GROUP BY 1")
def ordered_groups(spark, sf):
    return sets.ordered_list(t(spark, sf, "orders"), "o_custkey", ["o_orderdate"], "o_orderkey", "orders")


@query("SELECT l_partkey, string_agg(l_suppkey::VARCHAR, ',' ORDER BY f, l_suppkey) AS suppliers FROM (SELECT l_partkey, l_suppkey, min(l_orderkey) AS f FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def ordered_sets(spark, sf):
    first = t(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_orderkey").alias("f"))
    return sets.ordered_list(first, "l_partkey", ["f"], "l_suppkey", "suppliers")


@query(f"SELECT p_type, string_agg(n_items::VARCHAR, ' | ' ORDER BY p_brand) AS cells FROM ({GRID}) GROUP BY 1")
def grid_lines(spark, sf):
    return sets.ordered_list(matrix_full_grid(spark, sf), "p_type", ["p_brand"], "n_items", "cells", " | ")


@query("SELECT p_brand, n, greatest(1, max(n) OVER ())::BIGINT AS top, n::DOUBLE / greatest(1, max(n) OVER ())::DOUBLE AS height FROM (SELECT p_brand, count(*)::BIGINT AS n FROM part WHERE p_size > 30 GROUP BY 1)")
def scaled_bars(spark, sf):
    n = t(spark, sf, "part").where("p_size > 30").groupBy("p_brand").agg(F.count("*").alias("n"))
    top = n.agg(F.greatest(F.lit(1).cast("long"), F.max("n")).alias("top"))
    return n.join(top).select("p_brand", "n", "top", (F.col("n").cast("double") / F.col("top").cast("double")).alias("height"))


@query("SELECT 'lines' AS check_name, l_orderkey::VARCHAR AS violation_key FROM lineitem GROUP BY l_orderkey HAVING count(*) <> max(l_linenumber)")
def parts_consistency(spark, sf):
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.lit(1).alias("one"))
    return checks.parts_sum(li, li.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n")), "l_orderkey", "one", "n", "lines")


@query("SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_nationkey = 7 OR n_regionkey = 2")
def topic_membership(spark, sf):
    tags = t(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.array(F.struct(F.col("n_nationkey").alias("slug"), F.col("n_regionkey").alias("theme"))).alias("topics"))
    fits = F.exists("topics", lambda x: (x["slug"] == 7) | (x["theme"] == 2))
    return t(spark, sf, "customer").select("c_custkey", "c_nationkey").join(tags, "c_nationkey").where(fits).select("c_custkey")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def first_per_key(spark, sf):
    o = t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return enrich.pick(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT c_nationkey, count(*)::BIGINT AS total, array_to_string(list(c_custkey ORDER BY c_custkey)[1:3], ',') AS examples FROM customer WHERE c_acctbal < 0 GROUP BY 1")
def first_examples(spark, sf):
    return sets.examples(t(spark, sf, "customer").where("c_acctbal < 0"), "c_nationkey", "c_custkey", 3)


@query("""SELECT 'events.user_id' AS key_name, count(*)::BIGINT AS n_rows, count(DISTINCT user_id)::BIGINT AS n_keys FROM events UNION ALL
SELECT 'labels.doc_id', count(*), count(DISTINCT doc_id) FROM labels UNION ALL SELECT 'orders.o_custkey', count(*), count(DISTINCT o_custkey) FROM orders""")
def key_uniqueness(spark, sf):
    named = {"events": "user_id", "labels": "doc_id", "orders": "o_custkey"}
    counts = [t(spark, sf, n).agg(F.lit(f"{n}.{k}").alias("key_name"), F.count("*").alias("n_rows"), F.count_distinct(k).alias("n_keys")) for n, k in named.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("""SELECT conv_id, turn, coalesce(try_cast(replace(regexp_extract(text, '[0-9][0-9,]*'), ',', '') AS BIGINT), -1) AS n FROM conversations""")
def first_counts(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", T.first_count(F.col("text"), -1).alias("n"))


ADDRESS = """CASE event_id % 6 WHEN 0 THEN '10.0.0.' || user_id % 256 WHEN 1 THEN '2001:DB8:00' || user_id % 10 || '::1' WHEN 2 THEN '::ffff:1.2.3.' || user_id % 256 WHEN 3 THEN 'A::b::' || user_id
WHEN 4 THEN '2001:0db8:1:2:' || user_id END"""


@query(f"""WITH a AS (SELECT event_id, {ADDRESS} AS x FROM events), h AS (SELECT *, string_split(x, '::') AS hs FROM a),
g AS (SELECT *, CASE WHEN hs[1] = '' THEN []::VARCHAR[] ELSE string_split(hs[1], ':') END AS l, CASE WHEN len(hs) = 2 AND hs[2] <> '' THEN string_split(hs[2], ':') ELSE []::VARCHAR[] END AS r FROM h)
SELECT event_id, CASE WHEN coalesce(x, '') = '' THEN 'unknown' WHEN NOT contains(x, ':') THEN x WHEN len(hs) > 2 THEN lower(x) ELSE array_to_string(list_transform(list_slice(list_concat(list_concat(l,
CASE WHEN len(hs) = 2 THEN list_transform(range(0, greatest(0, 8 - len(l) - len(r))), lambda i: '0') ELSE []::VARCHAR[] END), r), 1, 4), lambda p: lower(coalesce(nullif(ltrim(p, '0'), ''), '0'))), ':') END AS limit_key FROM g""")
def limiter_keys(spark, sf):
    return t(spark, sf, "events").select("event_id", T.ip_key(F.expr(ADDRESS)).alias("limit_key"))


SITE = r"regexp_replace(lower(regexp_extract(url, '(?i)^https?://([^/?#:]+)', 1)), '^www\.', '')"



@query(f"""SELECT p.page_id, coalesce(home::VARCHAR, 'outside') AS target FROM (SELECT page_id, nullif({SITE}, '') AS site FROM pages) p
LEFT JOIN (SELECT {SITE} AS site, min(page_id) AS home FROM pages GROUP BY 1) r ON r.site = p.site""")
def resolved_links(spark, sf):
    p = t(spark, sf, "pages").select("page_id", T.site_of(F.col("url")).alias("site"))
    homes = p.groupBy("site").agg(F.min("page_id").cast("string").alias("target"))
    return enrich.lookup(p, homes, ["site"], {"target": F.lit("outside")}).select("page_id", "target")



@query(f"""WITH RECURSIVE e AS ({STARS}), both_ AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
r(id, reach) AS (SELECT a, a FROM both_ UNION SELECT r.id, b FROM r JOIN both_ ON a = reach), c AS (SELECT id, min(reach) AS component FROM r GROUP BY 1),
n AS (SELECT c_custkey AS id FROM customer UNION SELECT src FROM e UNION SELECT dst FROM e)
SELECT (SELECT count(*) FROM n)::BIGINT AS n_nodes, (SELECT count(*) FROM e)::BIGINT AS n_edges, (SELECT count(*) FROM c)::BIGINT AS n_connected, ((SELECT count(*) FROM n) - (SELECT count(*) FROM c))::BIGINT AS n_isolated,
coalesce((SELECT max(k) FROM (SELECT count(*) AS k FROM c GROUP BY component)), 1)::BIGINT AS largest_component""")
def graph_stats(spark, sf):
    e = stars(spark, sf)
    nodes = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    for end in ("src", "dst"):
        nodes = nodes.unionByName(e.select(F.col(end).alias("id")))
    return graph.graph_stats(e, nodes)


@query("""WITH v AS (SELECT p_partkey FROM part WHERE p_size > 25) SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey IN (FROM v) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def induced_edges(spark, sf):
    e = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    parts = t(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").alias("src"))
    return e.join(parts, "src", "left_semi").join(t(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("dst")), "dst", "left_semi").select("src", "dst")
