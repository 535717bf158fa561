"""Queries over records: checks with their verdicts, compact counts, accessions, subjects and author keys, breakdowns."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.operators import checks, dml
from shelfmark.plans.catalog import query, t
from shelfmark.streaming import events

N = "(o_orderkey % 1500) * (o_orderkey % 1500) * (o_orderkey % 701 + 1)"


@query(f"""WITH n AS (SELECT o_orderkey, ({N})::BIGINT AS n FROM orders),
r AS (SELECT *, (n * 10 + 500) // 1000 AS k, (n * 10 + 500000) // 1000000 AS m FROM n)
SELECT o_orderkey, CASE WHEN n < 1000 THEN n::VARCHAR WHEN k < 10000 THEN (k // 10) || CASE WHEN k % 10 > 0 THEN '.' || k % 10 ELSE '' END || 'K'
WHEN m < 10000 THEN (m // 10) || CASE WHEN m % 10 > 0 THEN '.' || m % 10 ELSE '' END || 'M' ELSE ((n * 10 + 500000000) // 1000000000) // 10 || CASE WHEN ((n * 10 + 500000000) // 1000000000) % 10 > 0 THEN '.' || ((n * 10 + 500000000) // 1000000000) % 10 ELSE '' END || 'B' END AS shown FROM r""")
def compact_counts(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", T.compact_count(F.expr(N)).alias("shown"))


CELL = """CASE p_partkey % 8 WHEN 0 THEN 'see GSE' || p_partkey || ' and GSM1' WHEN 1 THEN 'xPRJEB' || p_partkey WHEN 2 THEN 'prjna' || p_partkey WHEN 3 THEN 'E-MTAB-' || p_partkey || '-2'
WHEN 4 THEN 'CRA' || p_partkey || '.' WHEN 5 THEN 'MSV' || p_partkey WHEN 6 THEN 'PXD and SRP' || p_partkey END"""
ITEM = "'ds:' || CASE WHEN p_size > 25 THEN 'gse' || p_size || '-2' ELSE 'title-' || p_size END"


@query(rf"""WITH x AS (SELECT p_partkey, {CELL} AS cell, {ITEM} AS item FROM part), a AS (SELECT *, '(GSE\d+|GSM\d+|PRJ[A-Z]+\d+|SRP\d+|PXD\d+|CRA\d+|E-MTAB-\d+)' AS p FROM x)
SELECT p_partkey, nullif(regexp_extract(cell, p, 1), '') AS found, coalesce(nullif(regexp_extract(upper(cell), p, 1), ''), nullif(regexp_extract(upper(substr(item, 4)), '^' || p, 1), ''), upper(substr(item, 4))) AS deposit FROM a""")
def row_accessions(spark, sf):
    x = t(spark, sf, "part").select("p_partkey", F.expr(CELL).alias("cell"), F.expr(ITEM).alias("item"))
    return x.select("p_partkey", T.accession(F.col("cell")).alias("found"), T.deposit_accession(F.col("item"), F.col("cell")).alias("deposit"))


SUBJECT = """CASE event_id % 6 WHEN 0 THEN 'feat(papers): add ' || event_type || ' burger (#' || user_id || ')' WHEN 1 THEN 'Feat(datasets, ui): Catalogue ' || event_type || ' atlas' WHEN 2 THEN 'fix(software): rename ' || event_type
WHEN 3 THEN 'feat(other): add ' || event_type WHEN 4 THEN 'feat(data): additional ' || event_type ELSE 'chore(software): integrate  ' || event_type || ' agent' END"""


@query(rf"""WITH s AS (SELECT event_id, ts, {SUBJECT} AS s FROM events),
m AS (SELECT *, lower(trim(string_split(regexp_extract(s, '(?i)^[a-z]+\(([^)]+)\):\s*(.+)$', 1), ',')[1])) AS scope, trim(regexp_extract(s, '(?i)^[a-z]+\(([^)]+)\):\s*(.+)$', 2)) AS rest FROM s),
k AS (SELECT *, CASE scope WHEN 'papers' THEN 'Paper' WHEN 'data' THEN 'Dataset' WHEN 'datasets' THEN 'Dataset' WHEN 'software' THEN 'Software' WHEN 'databases' THEN 'Database' WHEN 'resources' THEN 'Resource' END AS kind,
  trim(regexp_replace(regexp_extract(rest, '(?i)^(add|integrate|catalogue|catalog|inventory)\b(.*)$', 2), '\s*\(#\d+\)\s*$', '')) AS title FROM m)
SELECT kind, upper(title[1]) || substr(title, 2) AS title, count(*)::BIGINT AS n, max(ts) AS newest FROM k WHERE kind IS NOT NULL AND title <> '' GROUP BY 1, 2""")
def recent_additions(spark, sf):
    e = t(spark, sf, "events").select("ts", T.commit_subject(F.expr(SUBJECT)).alias("e")).where("e IS NOT NULL")
    return e.groupBy(F.col("e.kind").alias("kind"), F.col("e.title").alias("title")).agg(F.count("*").alias("n"), F.max("ts").alias("newest"))


AUTHOR = "CASE c_custkey % 5 WHEN 0 THEN ' ' || n_name || ', ' || substr(c_mktsegment, 1, 1) || '. X.' WHEN 1 THEN n_name WHEN 2 THEN n_name || ', 3' WHEN 3 THEN ', ' || n_name ELSE n_name || ', 1 ' || c_mktsegment || ', Jr' END"


@query(f"""WITH a AS (SELECT c_custkey, string_split(trim({AUTHOR}), ',') AS p FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT c_custkey, CASE WHEN trim(p[1]) = '' THEN NULL WHEN regexp_replace(coalesce(p[2], ''), '[^A-Za-z]', '', 'g') = '' THEN lower(trim(p[1])) ELSE lower(trim(p[1])) || '|' || lower(regexp_replace(p[2], '[^A-Za-z]', '', 'g')[1]) END AS author FROM a""")
def author_keys(spark, sf):
    c = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select("c_custkey", T.author_key(F.expr(AUTHOR)).alias("author"))


CHECKS = ["id form", "retired", "one of two", "bijection", "heading", "members", "unparsed", "never"]


@query("""WITH v AS (
SELECT 'id form' AS c, p_partkey::VARCHAR AS k FROM part WHERE p_partkey % 10 = 0 OR p_type = 'ECONOMY'
UNION ALL SELECT 'retired', s_suppkey::VARCHAR FROM supplier WHERE s_suppkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
UNION ALL SELECT 'one of two', n_nationkey::VARCHAR FROM nation WHERE (n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)) = (n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000))
UNION ALL SELECT 'bijection', r_regionkey::VARCHAR FROM region LEFT JOIN (SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey < 8 GROUP BY 1) ON n_regionkey = r_regionkey WHERE coalesce(n, 0) <> 1
UNION ALL SELECT 'heading', p_partkey::VARCHAR FROM part WHERE p_size % 7 = 0
UNION ALL SELECT 'unparsed', o_orderkey || ':status' FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'unparsed', o_orderkey || ':price' FROM orders WHERE o_totalprice <= 1000 AND o_orderstatus <> 'F'
UNION ALL (WITH o AS (SELECT l_orderkey AS k, 'P' || l_partkey AS m FROM lineitem), n AS (SELECT k, m, count(*) AS n FROM o GROUP BY 1, 2)
  SELECT 'members', k || ':shape:' || m FROM o WHERE NOT regexp_matches(m, '^P[1-9]{1,2}$') UNION ALL SELECT 'members', k || ':own:' || m FROM o WHERE m = 'P' || k UNION ALL SELECT 'members', k || ':twice:' || m FROM n WHERE n > 1
  UNION ALL SELECT 'members', min(k::VARCHAR) || ':shared:' || m FROM n GROUP BY m HAVING count(*) > 1))
SELECT e.c AS check_name, count(v.k) = 0 AS ok, count(v.k)::BIGINT AS violations, min(v.k) AS example FROM (VALUES ('id form'), ('retired'), ('one of two'), ('bijection'), ('heading'), ('members'), ('unparsed'), ('never')) e(c) LEFT JOIN v ON v.c = e.c GROUP BY 1""")
def check_verdicts(spark, sf):
    part, orders, customer, supplier, nation, region, line = (t(spark, sf, n) for n in ("part", "orders", "customer", "supplier", "nation", "region", "lineitem"))
    items = part.select("p_partkey", F.when(F.col("p_type") == "ECONOMY", "odd").otherwise("part").alias("type"), F.col("p_partkey").cast("string").alias("slug"))
    items = items.withColumn("id", F.concat(F.when(F.col("p_partkey") % 10 == 0, "x:").otherwise("pt:"), "slug"))
    heads = part.select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("url"), F.concat(F.lit("["), "p_name", F.when(F.col("p_size") % 7 == 0, "] (").otherwise("]("), "p_brand", F.lit(") more")).alias("heading_md"))
    lists = line.groupBy("l_orderkey").agg(F.collect_list(F.concat(F.lit("P"), "l_partkey")).alias("parts")).withColumn("own", F.concat(F.lit("P"), "l_orderkey"))
    fields = orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice")).alias("price"))
    return checks.verdicts(
        CHECKS,
        checks.unlike_id(items, {"part": "pt"}, "id form").select("check_name", F.substring_index("violation_key", ":", -1).alias("violation_key")),
        checks.present(supplier, "s_suppkey", customer.where("c_acctbal < 0").select("c_custkey"), "retired"),
        checks.not_in_one(nation.select("n_nationkey"), customer.where("c_acctbal > 9000").select("c_nationkey"), supplier.where("s_acctbal > 5000").select("s_nationkey"), "one of two"),
        checks.named_unlike_once(nation.where("n_nationkey < 8"), "n_regionkey", region.select("r_regionkey"), "bijection"),
        checks.unlike_heading(heads, "p_partkey", "heading"),
        checks.members(lists, "l_orderkey", "parts", "^P[1-9]{1,2}$", "members", own="own"),
        checks.unparsed(fields, "o_orderkey", {"status": None, "price": F.col("status") == "F"}, "unparsed"),
        checks.where(region, F.col("r_regionkey") < 0, "r_regionkey", "never"),
    )


@query("SELECT event_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NULL OR nxt - ts >= INTERVAL 2 HOUR")
def quiet_terms(spark, sf):
    return events.settled_terms(t(spark, sf, "events"), "user_id", seconds=7200).select("event_id")


@query("SELECT p_brand AS page, p_type AS kind, count(*) FILTER (p_size > 25)::BIGINT AS large, count(*)::BIGINT AS n, sum(count(*)) OVER (PARTITION BY p_type)::BIGINT AS kind_total FROM part GROUP BY 1, 2")
def kind_breakdown(spark, sf):
    own = t(spark, sf, "part").groupBy(F.col("p_brand").alias("page"), F.col("p_type").alias("kind")).agg(F.count_if(F.col("p_size") > 25).alias("large"), F.count("*").alias("n"))
    return own.join(own.groupBy("kind").agg(F.sum("n").alias("kind_total")), "kind").select("page", "kind", "large", "n", "kind_total")


@query("SELECT 'customers' AS what, count(*)::BIGINT AS n FROM customer UNION ALL SELECT 'lines', count(*) FROM lineitem UNION ALL SELECT 'nations', count(DISTINCT c_nationkey) FROM customer UNION ALL SELECT 'parts without line', count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def headline_counts(spark, sf):
    c, line = t(spark, sf, "customer"), t(spark, sf, "lineitem")
    one = lambda name, df, n: df.agg(n.cast("long").alias("n")).select(F.lit(name).alias("what"), "n")
    left = t(spark, sf, "part").join(line.select(F.col("l_partkey").alias("p_partkey")).distinct(), "p_partkey", "left_anti")
    return one("customers", c, F.count("*")).unionByName(one("lines", line, F.count("*"))).unionByName(one("nations", c, F.count_distinct("c_nationkey"))).unionByName(one("parts without line", left, F.count("*")))


@query("SELECT c_custkey, c_acctbal, CASE WHEN s_acctbal IS NOT NULL THEN s_acctbal END AS other FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def dml_cleared(spark, sf):
    table = t(spark, sf, "customer").select("c_custkey", "c_acctbal", F.col("c_acctbal").alias("other"))
    values = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("other"))
    return dml.cleared(table, ["other"], values, "c_custkey")
