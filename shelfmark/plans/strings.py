"""Queries over scalar functions, with nulls, blanks and odd cases planted in their input; and lists, tables and nested counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.operators import enrich, sets
from shelfmark.plans.catalog import MEMBERS, members, query, t
from shelfmark.plans.scans import pages
from shelfmark.session import parts_of, scratch_dir
from shelfmark.sources import catalogue

DOI = """CASE o_orderkey % 10 WHEN 0 THEN '  HTTPS://dx.DOI.org/10.1234/AbC' || o_orderkey WHEN 1 THEN 'doi: 10.12345/X(' || o_custkey || ')' WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN '10.12/short' WHEN 5 THEN '10.1234/' || repeat('x', 150 + o_custkey % 80)
WHEN 6 THEN '10.1234/a b' WHEN 7 THEN '10.1234/' || repeat('ä', 60 + o_custkey % 80) WHEN 8 THEN '10.1234/a' || chr(8203) || 'b' ELSE 'https://doi.org/' END"""
KEY = "nullif(trim(regexp_replace(regexp_replace(lower(trim(d)), '^https?://(dx\\.)?doi\\.org/', ''), '^doi:\\s*', '')), '')"


@query(f"""WITH d AS (SELECT o_orderkey, {DOI} AS d FROM orders), k AS (SELECT o_orderkey, {KEY} AS key, lower(list_last(string_split(trim(d), '/'))) AS last FROM d)
SELECT o_orderkey, key, coalesce(regexp_matches(key, '^10\\.[0-9]{{4,9}}/[^\\s?#]+$') AND NOT contains(key, chr(8203)) AND length(key) <= 200 AND length(key) + 2 * length(regexp_replace(key, '[a-z0-9_.!~*''()-]', '', 'g')) + 3 * (octet_length(encode(key)) - length(key)) <= 600, false) AS shaped, last FROM k""")
def doi_shapes(spark, sf):
    d = t(spark, sf, "orders").select("o_orderkey", F.expr(DOI.replace("chr(8203)", "decode(unhex('E2808B'), 'UTF-8')")).alias("d"))
    return d.select("o_orderkey", T.doi_key(F.col("d")).alias("key"), T.is_doi(F.col("d")).alias("shaped"), T.last_segment(F.col("d")).alias("last"))


@query(r"""WITH x AS (SELECT doc_id, left(trim(regexp_replace(regexp_replace(text, '[\x00-\x1F\x7F-\x{9F}\x{200B}-\x{200F}\x{FEFF}]', ' ', 'g'), '\s+', ' ', 'g')), 400) AS x FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN repeat('é ö', 150) || text ELSE text END AS text FROM documents)),
l AS (SELECT *, list_transform(string_split(x, ''), lambda c: CASE WHEN regexp_matches(c, '^[A-Za-z0-9_.!~*''()-]$') THEN 1 ELSE 3 * octet_length(encode(c)) END) AS w FROM x)
SELECT doc_id, left(x, len(list_filter(range(1, len(w) + 1), lambda i: list_sum(w[1:i]) <= 1400))) AS note FROM l""")
def bounded_notes(spark, sf):
    text = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("doc_id") % 5 == 0, F.concat(F.repeat(F.lit("é ö"), F.lit(150)), F.col("text"))).otherwise(F.col("text"))
    return t(spark, sf, "documents").select("doc_id", T.one_line(text).alias("note"))


HREF = """CASE event_id % 12 WHEN 0 THEN 'HTTPS://WWW.Github.com/o/r?tab=1&item=' || user_id || '#frag' WHEN 1 THEN 'https://site.example/in' WHEN 2 THEN 'http://site.example' WHEN 3 THEN '//doi.org/10.1/x' || user_id WHEN 4 THEN '/docs/' || user_id WHEN 5 THEN 'mailto:a@b.example'
WHEN 6 THEN 'https://www.x.example:443' WHEN 7 THEN 'https://u:p@y.example:8080/p?note=' || user_id WHEN 8 THEN NULL WHEN 9 THEN 'https://z.example/?a=b+c&note=x&note=y&k' WHEN 10 THEN 'https://SITE.example:443/x' ELSE '' END"""


@query(f"""WITH h AS (SELECT event_id, event_id % 12 AS k, user_id AS u FROM events)
SELECT event_id, CASE k WHEN 0 THEN 'https://www.github.com/o/r?tab=1&item=' || u WHEN 2 THEN 'http://site.example/' WHEN 3 THEN 'https://doi.org/10.1/x' || u WHEN 6 THEN 'https://www.x.example/' WHEN 7 THEN 'https://y.example:8080/p' WHEN 9 THEN 'https://z.example/?a=b+c&k' END AS url,
CASE k WHEN 0 THEN 'github.com' WHEN 2 THEN 'site.example' WHEN 3 THEN 'doi.org' WHEN 6 THEN 'x.example' WHEN 7 THEN 'y.example' WHEN 9 THEN 'z.example' END AS domain, CASE WHEN k = 0 THEN 'repo' WHEN k = 3 THEN 'doi' WHEN k IN (2, 6, 7, 9) THEN 'external' END AS kind FROM h""")
def outbound_links(spark, sf):
    o = t(spark, sf, "events").select("event_id", T.outbound(F.expr(HREF), "https://site.example", ("note",)).alias("o"))
    return o.select("event_id", "o.url", "o.domain", "o.kind")


SHOWN = """CASE p_partkey % 9 WHEN 0 THEN 'paper:' || p_partkey WHEN 1 THEN 'paper:0' || p_partkey WHEN 2 THEN 'sw:tool-' || p_size WHEN 3 THEN 'ds:-x' WHEN 4 THEN NULL WHEN 5 THEN 'db:' || repeat('a', p_size * 4) WHEN 6 THEN 'ds:gse' || p_size || '-2' WHEN 7 THEN 'topic:x' ELSE 'Ds:x' END"""
SECTION = """CASE p_partkey % 7 WHEN 0 THEN 'Genome-scale atlases' WHEN 1 THEN 'GEM models' WHEN 2 THEN 'Gemini ' || p_brand WHEN 3 THEN 'Single cell' WHEN 4 THEN 'Perturbation sets' WHEN 5 THEN NULL ELSE p_type END"""
REPO = """CASE p_partkey % 6 WHEN 0 THEN 'see https://GitHub.com/Owner/Repo' || p_size || '.git#x' WHEN 1 THEN 'https://github.com/a/b?tab=1' WHEN 2 THEN 'https://gitlab.com/a/b' WHEN 3 THEN NULL WHEN 4 THEN 'github.com/only' ELSE 'http://github.com/x/y/tree/main' END"""
TITLE = """CASE p_partkey % 8 WHEN 0 THEN 'Add Burgers and gems' WHEN 1 THEN 'Gem of serum' WHEN 2 THEN 'gemstones only' WHEN 3 THEN 'Hydrogels in bioreactors' WHEN 4 THEN 'ige panel' WHEN 5 THEN NULL WHEN 6 THEN 'prescaffold agents' ELSE 'nothing known' END"""


@query(f"""WITH x AS (SELECT p_partkey, p_partkey % 8 AS k, p_partkey % 6 AS r, p_size, {SHOWN} AS id, {SECTION} AS section FROM part)
SELECT p_partkey, coalesce(regexp_matches(id, '^(paper:[1-9][0-9]{{0,6}}|(sw|db|ds):[a-z0-9][a-z0-9-]{{0,119}})$'), false) AS is_id, CASE WHEN regexp_matches(section, '(?i)metabolic|genome[- ]?scale|(^|[^a-z0-9_])gem([^a-z0-9_]|$)') THEN 'gem' WHEN regexp_matches(section, '(?i)atlas|corpora|single[- ]?cell|perturbation') THEN 'atlas' ELSE 'other' END AS kind,
CASE r WHEN 0 THEN 'owner/repo' || p_size WHEN 1 THEN 'a/b' WHEN 5 THEN 'x/y' END AS repo, CASE k WHEN 0 THEN 'sensory' WHEN 1 THEN 'media' WHEN 3 THEN 'bioprocess' WHEN 4 THEN 'foodsafety' ELSE 'tooling' END AS area FROM x""")
def named_parts(spark, sf):
    x = t(spark, sf, "part").select("p_partkey", F.expr(SHOWN).alias("id"), F.expr(SECTION).alias("section"), F.expr(REPO).alias("url"), F.expr(TITLE).alias("title"))
    return x.select("p_partkey", T.is_item_id(F.col("id")).alias("is_id"), T.entry_kind(F.col("section")).alias("kind"), T.repo_of(F.col("url")).alias("repo"), T.area_of(F.col("title")).alias("area"))


LISTED = """CASE s_suppkey % 5 WHEN 0 THEN '["10.1/a b", "10.2/c+d"]' WHEN 1 THEN '[]' WHEN 2 THEN 'no list' WHEN 3 THEN NULL ELSE '["10.3/' || s_suppkey || '"]' END"""
ROWS = """CASE s_suppkey % 4 WHEN 0 THEN 'see https://a.example/' || s_suppkey || ', (https://b.example/x). and https://a.example/' || s_suppkey || ';' WHEN 1 THEN '[t](https://c.example/q?x=1) <https://d.example>' WHEN 2 THEN NULL ELSE 'none' END"""
SEED = """CASE s_suppkey % 4 WHEN 0 THEN '[Herd](u) of *brown* `cows` here' WHEN 1 THEN 'GSE' || s_suppkey WHEN 2 THEN NULL ELSE 'one two' END"""


@query("""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'w?10.1%2Fa%20b|10.2%2Fc%2Bd' WHEN 4 THEN 'w?10.3%2F' || s_suppkey ELSE '' END AS works, CASE s_suppkey % 4 WHEN 0 THEN 'https://a.example/' || s_suppkey || ' https://b.example/x' WHEN 1 THEN 'https://c.example/q?x=1 https://d.example' WHEN 3 THEN '' END AS links,
CASE s_suppkey % 4 WHEN 0 THEN 'Herd(u)-of-brown' WHEN 1 THEN 'GSE' || s_suppkey WHEN 3 THEN 'one-two' END AS seed FROM supplier""")
def listed_parts(spark, sf):
    x = t(spark, sf, "supplier").select("s_suppkey", F.expr(LISTED).alias("dois"), F.expr(ROWS).alias("cell"), F.expr(SEED).alias("first"))
    links = F.array_join(T.links_in(F.col("cell")), " ")
    return x.select("s_suppkey", T.works_url(T.string_list(F.col("dois")), "w?").alias("works"), links.alias("links"), T.seed_text(F.array("first")).alias("seed"))


@query("""SELECT o_orderkey, base || CASE WHEN k = 1 THEN '' WHEN k <= 26 THEN chr((96 + k)::INT) ELSE '-' || (k - 1) END AS slug FROM (SELECT o_orderkey, 'y' || (o_custkey % 40) AS base, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) AS k FROM orders)""")
def plain_suffixes(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("y"), (F.col("o_custkey") % 40).cast("string")).alias("base"))
    return enrich.letter_suffix(o, "base", ["o_orderkey"], dash=False).select("o_orderkey", "slug")


@query("""SELECT o_orderkey, w.p_size, w.p_brand FROM orders LEFT JOIN (SELECT p_partkey % 50 AS k, min((p_brand, p_size)) AS r, (min((p_brand, p_size)))[1] AS p_brand, (min((p_brand, p_size)))[2] AS p_size FROM part WHERE p_partkey % 50 < 40 GROUP BY 1) w ON o_orderkey % 3 > 0 AND w.k = o_orderkey % 50""")
def works_by_doi(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("https://doi.org/10.9/W"), (F.col("o_orderkey") % 50).cast("string"))).otherwise(" ").alias("doi"))
    w = t(spark, sf, "part").where("p_partkey % 50 < 40").select(F.concat(F.lit("DOI:10.9/w"), (F.col("p_partkey") % 50).cast("string")).alias("doi"), "p_brand", "p_size")
    return enrich.by_doi(o, "doi", w).select("o_orderkey", "p_size", "p_brand")


@query(f"SELECT tag, kind, coalesce(string_agg(id::VARCHAR, ',' ORDER BY id), '') AS ids FROM (SELECT DISTINCT tag, k AS kind FROM {MEMBERS}, (VALUES ('customer'), ('dataset'), ('supplier')) v(k)) LEFT JOIN {MEMBERS} USING (tag, kind) GROUP BY 1, 2")
def inverted_lists(spark, sf):
    lists = sets.inverted(members(spark, sf), "tag", "kind", "id", ["customer", "dataset", "supplier"])
    each = F.explode(F.map_from_arrays(F.array(*map(F.lit, ["customer", "dataset", "supplier"])), F.array("customer", "dataset", "supplier"))).alias("kind", "ids")
    return lists.select("tag", each).withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


@query("SELECT o_custkey % 100 AS page, count(*)::BIGINT AS n_lines, count(DISTINCT o_orderkey)::BIGINT AS n_sections FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def nested_counts(spark, sf):
    """Lines nested in orders nested in pages: sums of the lengths of inner lists."""
    li = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("items"))
    page = t(spark, sf, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy((F.col("o_custkey") % 100).alias("page")).agg(F.collect_list("items").alias("sections"))
    return page.select("page", sets.nested_size(F.col("sections")).alias("n_lines"), F.size("sections").cast("long").alias("n_sections"))


@query("""WITH c AS (SELECT s_name AS method, n_regionkey AS a, s_suppkey * 10 + i AS ord, '[L' || i || '](#' || (s_suppkey + i) || ')' AS link FROM supplier JOIN nation ON n_nationkey = s_nationkey, (VALUES (0), (1), (2)) v(i) WHERE (s_suppkey + i) % 3 > 0),
g AS (SELECT method, a, string_agg(link, '<br>' ORDER BY ord) AS cell FROM c GROUP BY 1, 2), m AS (SELECT s_name AS method, s_suppkey FROM supplier), r AS (SELECT m.method, m.s_suppkey, string_agg(coalesce(cell, ''), ' | ' ORDER BY r_regionkey) AS cells FROM m CROSS JOIN region LEFT JOIN g ON g.method = m.method AND g.a = r_regionkey GROUP BY 1, 2)
SELECT s_suppkey + 2 AS place, '| **' || method || '** | ' || cells || ' |' AS line FROM r UNION ALL SELECT 0, '| | ' || string_agg('[' || r_name || '](T.md)', ' | ' ORDER BY r_regionkey) || ' |' FROM region UNION ALL SELECT 1, '|' || repeat('---|', (count(*) + 1)::INT) FROM region""")
def matrix_lines(spark, sf):
    s, n, r = t(spark, sf, "supplier"), t(spark, sf, "nation"), t(spark, sf, "region")
    c = s.join(n, F.col("n_nationkey") == F.col("s_nationkey")).select("s_name", "n_regionkey", "s_suppkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("i")).where("(s_suppkey + i) % 3 > 0")
    cells = c.select(F.col("s_name").alias("method"), F.col("n_regionkey").cast("string").alias("area_key"), (F.col("s_suppkey") + F.col("i")).alias("ref_id"), F.concat(F.lit("L"), F.col("i").cast("string")).alias("label"), (F.col("s_suppkey") * 10 + F.col("i")).alias("ordinal"))
    areas = r.select(F.col("r_regionkey").cast("string").alias("key"), F.concat(F.lit("["), "r_name", F.lit("](T.md)")).alias("header_md"), F.col("r_regionkey").alias("ordinal"))
    methods = s.select(F.col("s_name").alias("label"), F.concat(F.lit("**"), "s_name", F.lit("**")).alias("header_md"), F.col("s_suppkey").alias("ordinal"))
    return catalogue.matrix_table(cells, areas, methods)


@query("""WITH s AS (SELECT c_custkey AS k, c_custkey // 100 AS page, c_name AS name, c_nationkey AS n FROM customer), f AS (SELECT *, CASE WHEN page % 5 = 3 THEN 'no table' WHEN page % 5 = 4 THEN 'label twice' WHEN k % 11 = 3 THEN 'length' END AS fault FROM s),
good AS (SELECT *, 100 - page AS rank, 'GSE' || (k % 40) AS acc FROM f WHERE fault IS NULL), firsts AS (SELECT acc, arg_min(k, (rank, k)) AS k FROM good GROUP BY 1)
SELECT g.k AS item, g.rank, g.name, 'GSE' || ((g.k + 7) % 40) || '=' || coalesce('i' || f.k, 'none') || ',GSE99=none' AS subseries, CASE WHEN g.k % 3 = 0 THEN 't' || g.n ELSE '' END AS topics, 'https://x.example/' || g.k AS links, NULL AS fault
FROM good g LEFT JOIN firsts f ON f.acc = 'GSE' || ((g.k + 7) % 40) UNION ALL SELECT k, NULL, NULL, NULL, NULL, NULL, fault FROM f WHERE fault IS NOT NULL""")
def inventory_models(spark, sf):
    """Rows of customers with the headers of their pages: some pages have no table, some a label twice, some rows are short; later pages go first."""
    c = t(spark, sf, "customer")
    head = F.when(F.col("page") % 5 == 3, "## Other\n\nx\n\n").when(F.col("page") % 5 == 4, "## Complete data inventory\n\n| Name | Data | Name |\n|--|--|--|\n").otherwise("## Complete data inventory\n\n| Name | Data | N |\n|--|--|--|\n")
    docs = pages(c, "c_custkey", F.lit("")).select("page", head.alias("text"))
    page, key = F.floor(F.col("c_custkey") / 100), F.col("c_custkey")
    data = F.concat(F.lit("[GSE"), (key % 40).cast("string"), F.lit("](https://x.example/"), key.cast("string"), F.lit(")."))
    cells = F.when(key % 11 == 3, F.array(F.col("c_name"), data)).otherwise(F.array(F.concat(F.lit("**"), "c_name", F.lit("**")), data, F.col("c_nationkey").cast("string")))
    members_of = F.concat(F.lit('["GSE'), ((key + 7) % 40).cast("string"), F.lit('", "GSE99"]'))
    rows = c.select(F.concat(F.lit("i"), key.cast("string")).alias("item_id"), page.alias("page"), key.alias("ordinal"), cells.alias("cells"), members_of.alias("subseries"))
    topics = c.where("c_custkey % 3 = 0").select(F.concat(F.lit("i"), key.cast("string")).alias("item_id"), F.concat(F.lit("t"), F.col("c_nationkey").cast("string")).alias("slug"))
    order = docs.select("page", (100 - F.col("page")).alias("rank"))
    tables = catalogue.inventory(docs, "page", "text", "Complete data inventory")
    model, faults = catalogue.inventory_books(rows, tables, order, topics)
    sub = F.array_join(F.transform("subseries", lambda x: F.concat(x["accession"], F.lit("="), F.coalesce(x["id"], F.lit("none")))), ",")
    good = model.select(F.substring("item_id", 2, 20).cast("long").alias("item"), "rank", "name", sub.alias("subseries"), F.array_join("topics", ",").alias("topics"), F.array_join("links", ",").alias("links"), F.lit(None).cast("string").alias("fault"))
    return good.unionByName(faults.select(F.substring("violation_key", 2, 20).cast("long").alias("item"), F.col("check_name").alias("fault")), allowMissingColumns=True)


CELL = r"""CASE p_partkey % 10 WHEN 0 THEN '[' || p_brand || '](https://x.example/' || p_size || ' "title") ![alt](<i.png>)' WHEN 1 THEN '__' || p_brand || '__ and _it is_ of a_b_c' WHEN 2 THEN '`` a ` _b_ `` |* ' || p_size || ' |_'
WHEN 3 THEN '~' || p_brand || '~ <b>x</b>' WHEN 4 THEN p_brand || '  ' || chr(10) || 'y|' || chr(10) || 'z' WHEN 5 THEN '[`_a_`](u_1 "t") and _[b](c)_' WHEN 6 THEN NULL WHEN 7 THEN '' WHEN 8 THEN '**' || p_brand || '** *it* ~~x~~ `_c_` [d](e)' ELSE 'open ` tick _' || p_size END"""


@query("""SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN '[' || p_brand || '](https://x.example/' || p_size || ') ![alt](i.png)' WHEN 1 THEN '**' || p_brand || '** and *it is* of a_b_c' WHEN 2 THEN '`a ` _b_` * ' || p_size || ' _'
WHEN 3 THEN '~~' || p_brand || '~~ <b>x</b>' WHEN 4 THEN p_brand || ' y z' WHEN 5 THEN '[`_a_`](u_1) and *[b](c)*' WHEN 7 THEN '' WHEN 8 THEN '**' || p_brand || '** *it* ~~x~~ `_c_` [d](e)' WHEN 9 THEN 'open ` tick _' || p_size END AS cell FROM part""")
def inline_cells(spark, sf):
    return t(spark, sf, "part").select("p_partkey", T.inline_markdown(F.translate(F.expr(CELL), "|", "\\")).alias("cell"))


#: Models a file, and a task.
MODELS = 50_000


@query("""SELECT o_orderkey, o_orderstatus AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'a "b" \\ {é}, [' || o_custkey || ']: ' END AS note, coalesce(n, 0)::BIGINT AS n_lines, coalesce(l.lines, '') AS lines FROM orders
LEFT JOIN (SELECT l_orderkey, count(*) AS n, string_agg(l_partkey || 'x' || l_quantity::INT, ',' ORDER BY l_linenumber, l_partkey, l_quantity) AS lines FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey""")
def pretty_models(spark, sf):
    """Orders with their lines as indented JSON arrays, written and read again."""
    line = F.struct("l_linenumber", F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").cast("int").alias("qty")).alias("l"), "l_quantity")
    orders = t(spark, sf, "orders")
    files = parts_of(orders, MODELS)
    lines = t(spark, sf, "lineitem").repartition(files, "l_orderkey").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l"]).alias("lines"))
    note = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('a "b" \\ {é}, ['), F.col("o_custkey").cast("string"), F.lit("]: ")))
    none = F.array().cast("array<struct<part:long,qty:int>>")
    model = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), note.alias("note")).alias("head"), F.coalesce(F.col("lines").cast("array<struct<part:long,qty:int>>"), none).alias("lines"))
    path = scratch_dir(spark)
    catalogue.write_pretty(model, path, ["o_orderkey"], files=files)
    back = catalogue.read_pretty(spark, path, model.schema)
    shown = F.array_join(F.transform("lines", lambda x: F.concat_ws("x", x["part"].cast("string"), x["qty"].cast("string"))), ",")
    return back.select("o_orderkey", "head.status", "head.note", F.size("lines").cast("long").alias("n_lines"), shown.alias("lines"))
