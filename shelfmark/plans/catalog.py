"""Queries over the given tables, and their DuckDB twins.

Each query is registered with the SQL that must give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.operators import checks, enrich, graph, matrix

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


GRID = """SELECT a.p_type, b.p_brand, coalesce(n, 0)::BIGINT AS n_items FROM (SELECT DISTINCT p_type FROM part) a CROSS JOIN (SELECT DISTINCT p_brand FROM part) b
LEFT JOIN (SELECT p_type, p_brand, count(DISTINCT p_partkey) AS n FROM part WHERE p_size > 40 GROUP BY 1, 2) c USING (p_type, p_brand)"""


@query(GRID)
def matrix_full_grid(spark, sf):
    p = t(spark, sf, "part")
    return matrix.grid(p.where("p_size > 40"), p, p, "p_type", "p_brand", "p_partkey")


@query(f"SELECT count(*)::BIGINT AS cells, count(*) FILTER (n_items > 0)::BIGINT AS filled, round(count(*) FILTER (n_items > 0) * 100.0::DOUBLE / count(*), 1) AS coverage FROM ({GRID})")
def matrix_coverage(spark, sf):
    return matrix.coverage(matrix_full_grid(spark, sf))


@query("SELECT p_type, count(DISTINCT p_partkey) FILTER (p_size > 48)::BIGINT AS n_items FROM part GROUP BY 1")
def matrix_row_totals(spark, sf):
    p = t(spark, sf, "part")
    return matrix.zero_filled(p.where("p_size > 48"), p, "p_type", "p_partkey")


@query("SELECT p_brand, count(DISTINCT l_orderkey)::BIGINT AS n_orders FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 45 GROUP BY 1")
def matrix_col_totals(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", "p_brand")
    sold = t(spark, sf, "lineitem").where("l_quantity > 45").select("l_partkey", "l_orderkey").join(p, F.col("l_partkey") == F.col("p_partkey"))
    return matrix.zero_filled(sold, p, "p_brand", "l_orderkey", "n_orders")


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS F, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS O, count(*) FILTER (o_orderstatus = 'P')::BIGINT AS P FROM orders GROUP BY 1")
def matrix_pivot(spark, sf):
    return matrix.pivoted(t(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("SELECT n_items, CASE WHEN n_items <= 0 THEN 0 WHEN n_items <= 2 THEN 1 WHEN n_items <= 4 THEN 2 WHEN n_items <= 7 THEN 3 ELSE 4 END AS shade, count(*)::BIGINT AS cells FROM (" + GRID + ") GROUP BY 1, 2")
def matrix_density(spark, sf):
    g = matrix_full_grid(spark, sf)
    return g.groupBy("n_items", T.density(F.col("n_items")).alias("shade")).agg(F.count("*").alias("cells"))


MEMBERS = "(SELECT c_nationkey AS tag, 'customer' AS kind, c_custkey AS id FROM customer UNION ALL SELECT s_nationkey, 'supplier', s_suppkey FROM supplier)"


def members(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_nationkey").alias("tag"), F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"))
    return c.unionByName(t(spark, sf, "supplier").select(F.col("s_nationkey").alias("tag"), F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id")))


@query(f"""SELECT r_name AS theme, count(DISTINCT id) FILTER (kind = 'customer')::BIGINT AS customers, count(DISTINCT id) FILTER (kind = 'supplier')::BIGINT AS suppliers
FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN {MEMBERS} ON tag = n_nationkey GROUP BY 1""")
def theme_union_rollup(spark, sf):
    tree = t(spark, sf, "nation").select(F.col("n_nationkey").alias("tag"), "n_regionkey")
    own = members(spark, sf).join(tree, "tag").select("n_regionkey", "kind", "id").distinct()
    sums = own.groupBy("n_regionkey").agg(F.count_if(F.col("kind") == "customer").alias("c"), F.count_if(F.col("kind") == "supplier").alias("s"))
    r = t(spark, sf, "region").join(sums, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return r.select(F.col("r_name").alias("theme"), F.coalesce("c", F.lit(0)).cast("long").alias("customers"), F.coalesce("s", F.lit(0)).cast("long").alias("suppliers"))


@query(f"SELECT tag, kind, count(*)::BIGINT AS n FROM {MEMBERS} GROUP BY 1, 2")
def theme_kind_counts(spark, sf):
    return members(spark, sf).groupBy("tag", "kind").agg(F.count("*").alias("n"))


@query("SELECT count(o_orderkey)::BIGINT AS assignments, count(DISTINCT c_custkey) FILTER (o_orderkey IS NOT NULL)::BIGINT AS tagged, count(DISTINCT c_custkey)::BIGINT AS items FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def assignment_stats(spark, sf):
    n = t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t(spark, sf, "customer").join(n, "c_custkey", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("assignments"), F.count("n").alias("tagged"), F.count("*").alias("items"))


BAND = "CASE WHEN v >= 1000 THEN '1000plus' WHEN v >= 100 THEN '100to999' WHEN v >= 10 THEN '10to99' WHEN v IS NOT NULL THEN 'under10' END"


@query(f"""WITH x AS (SELECT n_name AS subject, floor(c_acctbal)::BIGINT AS v FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL
SELECT r_name, floor(c_acctbal)::BIGINT FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT subject, count(*) FILTER ({BAND} = '1000plus')::BIGINT AS b1000, count(*) FILTER ({BAND} = '100to999')::BIGINT AS b100, count(*) FILTER ({BAND} = '10to99')::BIGINT AS b10, count(*) FILTER ({BAND} = 'under10')::BIGINT AS b0 FROM x GROUP BY 1""")
def subject_grid(spark, sf):
    n, r = t(spark, sf, "nation"), t(spark, sf, "region")
    rows = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.explode(F.array("n_name", "r_name")).alias("subject"))
    # Balances are counted by nation and band before they meet the subjects.
    c = t(spark, sf, "customer").groupBy("c_nationkey", T.citation_band(F.floor("c_acctbal")).alias("band")).agg(F.count("*").alias("k"))
    x = c.join(rows, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("subject")
    s = lambda b, name: F.sum(F.when(F.col("band") == b, F.col("k")).otherwise(0)).alias(name)
    return x.agg(s("1000plus", "b1000"), s("100to999", "b100"), s("10to99", "b10"), s("under10", "b0"))


@query(f"""WITH b AS (SELECT {BAND} AS band, count(*) AS n FROM (SELECT floor(o_totalprice / 100)::BIGINT AS v FROM orders) GROUP BY 1)
SELECT k.band, coalesce(n, 0)::BIGINT AS n, CASE WHEN sum(coalesce(n, 0)) OVER () = 0 THEN 0.0::DOUBLE ELSE round(coalesce(n, 0)::DOUBLE * 100.0::DOUBLE / (sum(coalesce(n, 0)) OVER ())::DOUBLE, 1) END AS share
FROM (VALUES ('1000plus'), ('100to999'), ('10to99'), ('under10')) k(band) LEFT JOIN b USING (band)""")
def band_histogram(spark, sf):
    n = t(spark, sf, "orders").groupBy(T.citation_band(F.floor(F.col("o_totalprice") / 100)).alias("band")).agg(F.count("*").alias("n"))
    keys = spark.range(1).select(F.explode(F.array(*map(F.lit, ["1000plus", "100to999", "10to99", "under10"]))).alias("band"))
    x = keys.join(n, "band", "left").select("band", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return x.join(x.agg(F.sum("n").alias("total"))).select("band", "n", T.share(F.col("n"), F.col("total")).alias("share"))




#: The tiers as patterns of DuckDB, in the order in which they are tried.
TIER = r"""CASE WHEN regexp_matches(u, 'NON[\s-]?COMMERCIAL|\b(NON|NOT)[\s-]?PUBLIC|(^|[\s-])NC([\s-]|$)|(^|[\s-])ND([\s-]|$)|PROPRIETARY|ACADEMIC|ALL[\s-]RIGHTS[\s-]RESERVED|COMMONS[\s-]CLAUSE|\bCUSTOM\b|(CONTROLLED|MANAGED|REGISTERED)[\s-]?ACCESS|ACCESS[\s-]?RESTRICTED|\b(DBGAP|EGA|DUA)\b') THEN 'restricted'
WHEN regexp_matches(u, 'GPL|MPL|EPL|EUPL|CDDL|OSL|CECILL|(^|[\s-])SA([\s-]|$)|SHARE[\s-]?ALIKE') THEN 'copyleft'
WHEN regexp_matches(u, '\bMIT\b|MIT-0|APACHE|BSD|ISC|CC0|PUBLIC[\s-]?DOMAIN|UNLICENSE|WTFPL|ZLIB|0BSD|BOOST|\bBSL\b|POSTGRESQL|PYTHON|ARTISTIC|MS-PL|NCSA|CC-BY') THEN 'permissive' ELSE 'unknown' END"""


@query(f"SELECT {TIER} AS tier, count(*)::BIGINT AS n FROM (SELECT upper(trim(text)) AS u FROM documents) GROUP BY 1")
def tier_histogram(spark, sf):
    return t(spark, sf, "documents").groupBy(T.licence_tier(F.col("text")).alias("tier")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, sum(p_size)::BIGINT AS total, count(p_size)::BIGINT AS contributors FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = l_partkey GROUP BY 1")
def distinct_sum_enrich(spark, sf):
    p = t(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("long").alias("p_size"))
    return enrich.distinct_sum(t(spark, sf, "lineitem"), "l_orderkey", "l_partkey", p, "p_size")


@query(f"SELECT tag, string_agg(CASE WHEN kind = 'customer' THEN id END::VARCHAR, ',' ORDER BY id) AS customers, string_agg(CASE WHEN kind = 'supplier' THEN id END::VARCHAR, ',' ORDER BY id) AS suppliers FROM {MEMBERS} GROUP BY 1")
def inverted_index(spark, sf):
    ids = lambda k: F.nullif(F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("id")))), ","), F.lit("")).alias(k + "s")
    return members(spark, sf).groupBy("tag").agg(ids("customer"), ids("supplier"))


@query("SELECT o_orderkey, string_split(o_orderpriority, '-')[1] AS rank, o_orderstatus = 'F' AS is_final, nullif(o_orderstatus, 'P') AS status FROM orders")
def index_projection(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", F.get(F.split("o_orderpriority", "-"), F.lit(0)).alias("rank"), (F.col("o_orderstatus") == "F").alias("is_final"), F.nullif("o_orderstatus", F.lit("P")).alias("status"))


def facets(df: DataFrame, chosen: dict, known: dict) -> DataFrame:
    """Filters for columns with a known value; an unknown value is ignored, as is an empty choice."""
    for c, v in chosen.items():
        if v in known.get(c, ()):
            df = df.where(F.col(c) == v)
    return df


@query("SELECT p_partkey, p_name FROM part WHERE p_type = (SELECT min(p_type) FROM part) AND p_size > 20")
def facet_filter(spark, sf):
    p = t(spark, sf, "part")
    least = p.agg(F.min("p_type").alias("m"))
    return facets(p, {"p_brand": "no such brand"}, {"p_brand": ()}).where("p_size > 20").join(least, F.col("p_type") == F.col("m")).select("p_partkey", "p_name")


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(coalesce(source, '') || ' ' || coalesce(text, '')), 'license')")
def text_search(spark, sf):
    return t(spark, sf, "documents").where(T.contains_text([F.col("source"), F.col("text")], "LICENSE")).select("doc_id", "lang")


@query("SELECT 'customer' AS kind, c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL FROM supplier")
def unified_items(spark, sf):
    c = t(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = t(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return c.unionByName(s, allowMissingColumns=True)


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def topk_stable(spark, sf):
    return t(spark, sf, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10)


@query("SELECT n_nationkey, n_items FROM (SELECT n_nationkey, count(c_custkey)::BIGINT AS n_items FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1) ORDER BY n_items, n_nationkey LIMIT 3")
def bottomk(spark, sf):
    c = t(spark, sf, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    return matrix.zero_filled(c, t(spark, sf, "nation"), "n_nationkey", "c_custkey").orderBy("n_items", "n_nationkey").limit(3)


@query("SELECT o_orderpriority, n, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 99 END, o_orderpriority)::BIGINT AS place FROM (SELECT o_orderpriority, count(*)::BIGINT AS n FROM orders GROUP BY 1)")
def custom_rank_sort(spark, sf):
    from pyspark.sql import Window

    rank = F.when(F.col("o_orderpriority") == "5-LOW", 1).when(F.col("o_orderpriority") == "1-URGENT", 2).otherwise(99)
    n = t(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))  # a row for each priority
    return n.withColumn("place", F.row_number().over(Window.orderBy(rank, "o_orderpriority")).cast("long"))


@query("SELECT doc_id, coalesce(quality, (doc_id % 2)::INTEGER) AS value, CASE WHEN quality IS NOT NULL THEN 'manual' ELSE 'auto' END AS value_source FROM documents LEFT JOIN labels USING (doc_id)")
def override_precedence(spark, sf):
    d = t(spark, sf, "documents").select("doc_id")
    manual = t(spark, sf, "labels").select("doc_id", F.col("quality").alias("value"))
    auto = d.withColumn("value", (F.col("doc_id") % 2).cast("int"))
    return enrich.override(d, manual, auto, "doc_id", "value")


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem LEFT JOIN (SELECT o_orderkey, o_orderstatus, arg_min(o_custkey, o_totalprice) AS o_custkey FROM orders GROUP BY 1, 2) ON o_orderkey = l_orderkey AND o_orderstatus = l_linestatus")
def composite_lookup(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("l_linestatus"), "o_custkey", "o_totalprice")
    o = enrich.pick(o, ["l_orderkey", "l_linestatus"], [F.col("o_totalprice")])
    return enrich.lookup(t(spark, sf, "lineitem"), o, ["l_orderkey", "l_linestatus"]).select("l_orderkey", "l_linenumber", "o_custkey")


@query("SELECT l_partkey, arg_min(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) AS first_order FROM lineitem GROUP BY 1")
def first_claimant(spark, sf):
    rank = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    return t(spark, sf, "lineitem").groupBy("l_partkey").agg(F.min_by("l_orderkey", rank).alias("first_order"))


@query("""SELECT event_id, kind, ref FROM (SELECT event_id, CASE WHEN event_type = 'click' THEN 'part' WHEN event_type = 'view' THEN 'customer' ELSE 'other' END AS kind, user_id * 20 AS ref FROM events) e
WHERE kind = 'part' AND NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = ref) OR kind = 'customer' AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = ref)""")
def polymorphic_orphans(spark, sf):
    kind = F.when(F.col("event_type") == "click", "part").when(F.col("event_type") == "view", "customer").otherwise("other")
    refs = t(spark, sf, "events").select("event_id", kind.alias("kind"), (F.col("user_id") * 20).alias("ref"))
    return enrich.unresolved(refs, "kind", "ref", {"part": (t(spark, sf, "part"), "p_partkey"), "customer": (t(spark, sf, "customer"), "c_custkey")}).select("event_id", "kind", "ref")




@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '\s+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS slug,
regexp_replace(regexp_replace(lower(text), '\s+', '-', 'g'), '[^a-z0-9-]', '', 'g') AS token, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS grp,
regexp_replace(regexp_replace(lower(text), '[^0-9a-z_\s-]', '', 'g'), '\s', '-', 'g') AS heading FROM documents""")
def slugs(spark, sf):
    c = F.col("text")
    return t(spark, sf, "documents").select("doc_id", T.slugify(c).alias("slug"), T.slug_token(c).alias("token"), T.group_slug(c).alias("grp"), T.heading_slug(c).alias("heading"))


@query(r"""SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '(?i)^https?://([^/?#:]+)', 1)), '^www\.', ''), '') AS site,
CASE WHEN regexp_replace(lower(regexp_extract(url, '(?i)^https?://([^/?#:]+)', 1)), '^www\.', '') IN ('doi.org', 'dx.doi.org') THEN 'doi' WHEN regexp_replace(lower(regexp_extract(url, '(?i)^https?://([^/?#:]+)', 1)), '^www\.', '') IN ('github.com', 'gitlab.com', 'bitbucket.org') THEN 'repo'
WHEN regexp_extract(url, '(?i)^https?://([^/?#:]+)', 1) <> '' THEN 'external' END AS kind FROM pages""")
def url_classify(spark, sf):
    return t(spark, sf, "pages").select("page_id", T.site_of(F.col("url")).alias("site"), T.url_kind(F.col("url")).alias("kind"))


@query(r"""SELECT conv_id, turn, CASE WHEN length(x) BETWEEN 2 AND 80 AND NOT (contains(x, '@') OR (NOT regexp_matches(x, '[a-z]') AND length(regexp_replace(x, '[^0-9]', '', 'g')) >= 7)) THEN x END AS term
FROM (SELECT conv_id, turn, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS x FROM conversations)""")
def redact_query(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", T.normal_query(F.col("text")).alias("term"))


@query("SELECT doc_id, tag FROM (SELECT doc_id, text, unnest(['licence', 'contact', 'secret']) AS tag, unnest(['licen[cs]e', '[a-z0-9.]+@[a-z0-9]+', '(password|secret|token)']) AS p FROM documents) WHERE regexp_matches(text, '(?i)' || p)")
def keyword_tagger(spark, sf):
    rules = {"licence": "licen[cs]e", "contact": "[a-z0-9.]+@[a-z0-9]+", "secret": "(password|secret|token)"}
    return t(spark, sf, "documents").select("doc_id", F.explode(T.tag_rules(F.col("text"), rules)).alias("tag"))


@query("""SELECT c_custkey, CASE WHEN n = 0 THEN base WHEN n < 26 THEN base || '-' || chr((n + 97)::INTEGER) ELSE base || '-' || n END AS slug
FROM (SELECT c_custkey, lower(c_mktsegment) || c_nationkey AS base, row_number() OVER (PARTITION BY lower(c_mktsegment) || c_nationkey ORDER BY c_custkey) - 1 AS n FROM customer)""")
def dedup_suffix(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey", F.concat(F.lower("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("base"))
    return enrich.letter_suffix(c, "base", ["c_custkey"]).select("c_custkey", "slug")




@query("SELECT prev + 1 AS first_missing, id - 1 AS last_missing FROM (SELECT id, lag(id) OVER (ORDER BY id) AS prev FROM (SELECT DISTINCT o_orderkey AS id FROM orders)) WHERE id > prev + 1")
def id_gaps(spark, sf):
    return enrich.id_runs(t(spark, sf, "orders"), "o_orderkey")[0]


@query("SELECT min(id) AS first_id, max(id) AS last_id FROM (SELECT id, id - row_number() OVER (ORDER BY id) AS g FROM (SELECT DISTINCT o_orderkey AS id FROM orders)) GROUP BY g")
def id_runs(spark, sf):
    return enrich.id_runs(t(spark, sf, "orders"), "o_orderkey")[1]


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM conversations")
def forward_fill_section(spark, sf):
    c = t(spark, sf, "conversations")
    return enrich.last_known(c, "conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")), "section").select("conv_id", "turn", "section")


@query("""SELECT check_name, count(*)::BIGINT AS violations, min(k) AS example FROM (
SELECT 'line without order' AS check_name, l_orderkey::VARCHAR AS k FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'))
UNION ALL SELECT 'order without customer', o_custkey::VARCHAR FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))
UNION ALL SELECT 'part twice in order', l_orderkey || '|' || l_partkey FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1
UNION ALL SELECT 'negative balance', c_custkey::VARCHAR FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'status xor price', o_orderkey::VARCHAR FROM orders WHERE (nullif(o_orderstatus, 'P') IS NULL) <> (CASE WHEN o_totalprice > 400000 THEN NULL ELSE o_totalprice END IS NULL)
UNION ALL SELECT 'nation sets', '+' || c_nationkey FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey < 20 AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey > 2))
UNION ALL SELECT 'nation sets', '-' || s_nationkey FROM (SELECT DISTINCT s_nationkey FROM supplier WHERE s_nationkey > 2 AND s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_nationkey < 20))) GROUP BY 1""")
def constraint_report(spark, sf):
    o, li, c, s = (t(spark, sf, n) for n in ("orders", "lineitem", "customer", "supplier"))
    odd = o.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("a"), F.when(F.col("o_totalprice") <= 400000, F.col("o_totalprice")).alias("b"))
    return checks.report(
        checks.orphans(li, "l_orderkey", o.where("o_orderstatus <> 'P'"), "o_orderkey", "line without order"),
        checks.orphans(o, "o_custkey", c.where("c_acctbal > 0"), "c_custkey", "order without customer"),
        checks.duplicates(li, ["l_orderkey", "l_partkey"], "part twice in order"),
        checks.where(c, F.col("c_acctbal") < 0, "c_custkey", "negative balance"),
        checks.null_xor(odd, "a", "b", "o_orderkey", "status xor price"),
        checks.set_difference(c.where("c_nationkey < 20").select("c_nationkey"), s.where("s_nationkey > 2").select("s_nationkey"), "nation sets"),
    )


PAIR = "SELECT a.l_partkey AS src, b.l_partkey AS dst, count(DISTINCT a.l_orderkey)::BIGINT AS weight FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2"


@query(PAIR)
def cooccurrence_edges(spark, sf):
    return graph.shared_key_pairs(t(spark, sf, "lineitem"), "l_orderkey", "l_partkey", max_group=None)


@query("SELECT p_partkey AS id, count(k)::BIGINT AS degree FROM part LEFT JOIN (SELECT DISTINCT l_partkey AS k, l_suppkey FROM lineitem WHERE l_quantity > 40) ON k = p_partkey GROUP BY 1")
def node_degree(spark, sf):
    e = t(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("src"), (-F.col("l_suppkey") - 1).alias("dst")).distinct()
    return graph.degree(e, t(spark, sf, "part").select(F.col("p_partkey").alias("id")))


@query("SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey <> l_suppkey AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10) AND l_suppkey IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def directed_edges(spark, sf):
    nodes = t(spark, sf, "part").where("p_size > 10")
    return graph.directed_edges_in_corpus(t(spark, sf, "lineitem"), nodes, "l_partkey", "l_suppkey", "p_partkey")




#: Every order and its customer; orders are below zero, so that no key is folded or meets another table's.
STARS = "SELECT DISTINCT o_custkey AS src, -1 - o_orderkey AS dst FROM orders"


def stars(spark, sf) -> DataFrame:
    return t(spark, sf, "orders").select(F.col("o_custkey").alias("src"), (F.lit(-1) - F.col("o_orderkey")).alias("dst")).distinct()


@query(f"""WITH RECURSIVE e AS ({STARS}), both_ AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
r(id, reach) AS (SELECT a, a FROM both_ UNION SELECT r.id, b FROM r JOIN both_ ON a = reach) SELECT id, min(reach) AS component FROM r GROUP BY 1""")
def components(spark, sf):
    return graph.connected_components(stars(spark, sf))


@query("""SELECT event_id, rn > 2 AS refused FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL 1 HOUR, ts) ORDER BY ts, event_id) AS rn FROM events)""")
def rate_limit_windows(spark, sf):
    from shelfmark.streaming import events

    return events.rate_limited(t(spark, sf, "events"), "user_id", cap=2, window="1 hour").select("event_id", "refused")


@query("SELECT event_id FROM (SELECT *, lag(event_type) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE p IS NULL OR p <> event_type")
def consecutive_dedupe(spark, sf):
    from shelfmark.streaming import events

    return events.without_repeats(t(spark, sf, "events"), "user_id", "event_type").select("event_id")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def dml_remove_cascade(spark, sf):
    from shelfmark.operators import dml

    gone = t(spark, sf, "customer").where("c_acctbal < 0").select("c_custkey")
    tables = {"customer": t(spark, sf, "customer"), "orders": t(spark, sf, "orders")}
    return dml.remove(tables, gone, {"customer": "c_custkey", "orders": "o_custkey"})["orders"].select("o_orderkey", "o_orderstatus")


@query("SELECT p_partkey, coalesce(s_acctbal, p_retailprice) AS p_retailprice FROM part LEFT JOIN supplier ON s_suppkey = p_partkey UNION ALL SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey NOT IN (SELECT p_partkey FROM part)")
def dml_upsert(spark, sf):
    from shelfmark.operators import dml

    new = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.col("s_acctbal").alias("p_retailprice"))
    return dml.upsert(t(spark, sf, "part").select("p_partkey", "p_retailprice"), new, "p_partkey")


@query(r"""SELECT page_id, i::INTEGER AS ordinal, href FROM (SELECT page_id, unnest(l) AS href, generate_subscripts(l, 1) - 1 AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages))""")
def page_links(spark, sf):
    found = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))
    return t(spark, sf, "pages").select("page_id", F.posexplode(found).alias("ordinal", "href"))


@query("SELECT doc_id, i::INTEGER AS ordinal, len(regexp_extract_all(line, '[^ ]+'))::INTEGER AS n_words FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE line <> ''")
def document_lines(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "line")).where("line <> ''")
    return d.select("doc_id", "ordinal", F.size(F.regexp_extract_all("line", F.lit("[^ ]+"), F.lit(0))).alias("n_words"))


@query("SELECT count(*)::BIGINT AS total, count(*) FILTER (toxic = 1)::BIGINT AS open, count(*) FILTER (coalesce(nullif(quality, 0), 1) > 0)::BIGINT AS held, coalesce(max(doc_id), -1) + 1 AS next_id FROM labels")
def population_totals(spark, sf):
    q = F.coalesce(F.nullif("quality", F.lit(0)), F.lit(1))
    return t(spark, sf, "labels").agg(F.count("*").alias("total"), F.count_if(F.col("toxic") == 1).alias("open"), F.count_if(q > 0).alias("held"), (F.coalesce(F.max("doc_id"), F.lit(-1)) + 1).alias("next_id"))


@query("SELECT o_orderpriority, count(*)::BIGINT AS n, round(count(*)::DOUBLE * 100.0::DOUBLE / (SELECT count(*) FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY)::DOUBLE, 1) AS share FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY GROUP BY 1")
def recent_window_share(spark, sf):
    o = t(spark, sf, "orders")
    last = o.agg(F.max("o_orderdate").alias("last"))
    n = o.join(last).where("o_orderdate >= last - INTERVAL 30 DAYS").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return n.join(n.agg(F.sum("n").alias("total"))).select("o_orderpriority", "n", T.share(F.col("n"), F.col("total")).alias("share"))


@query("SELECT o_orderkey FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def set_difference(spark, sf):
    return t(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey").subtract(t(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")))


@query("SELECT DISTINCT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_intersection(spark, sf):
    c = t(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"))
    return c.intersect(t(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation")))
