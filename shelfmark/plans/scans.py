"""Scans of Markdown that Spark writes from the tables, a hundred rows a document, against SQL on the tables themselves; and orders, limits and filters of lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.operators import checks, enrich, graph
from shelfmark.plans.catalog import facets, query, t
from shelfmark.session import parts_of
from shelfmark.sources import catalogue, markdown

#: Blocks a task.
BLOCKS = 10_000


def pages(rows: DataFrame, number: str, block, head: str = "", foot: str = "") -> DataFrame:
    """``page, text``: the blocks of a hundred numbers each, in their order."""
    b = rows.select(F.floor(F.col(number) / 100).alias("page"), F.col(number).alias("n"), block.alias("b"))
    # Lines of a page, and windows over them, stay in the task that gathers it: its share is counted in blocks, not in bytes.
    b = b.repartition(parts_of(rows, BLOCKS), "page")
    text = F.array_join(F.array_sort(F.collect_list(F.struct("n", "b")))["b"], "\n")
    return b.groupBy("page").agg(F.concat(F.lit(head), text, F.lit(foot)).alias("text"))


REFERENCE = r"""CASE WHEN c_custkey % 10 = 0 THEN '## Part ' || c_custkey || chr(10) || chr(10) ELSE '' END || '<a id="' || c_custkey || '">' || c_custkey || '</a> '
|| CASE c_custkey % 4 WHEN 0 THEN 'Doe, J. de C., Guild of Cooks, & Plato' WHEN 1 THEN 'Nobody' ELSE '… Roe, A.-B.' END || CASE WHEN c_custkey % 5 = 0 THEN ' (n.d.). Text' ELSE ' (' || (1990 + c_custkey % 30) || 'a). ' END
|| CASE WHEN c_custkey % 5 = 0 THEN ' on ' WHEN c_custkey % 3 = 0 THEN '*' || c_name || '.* Preprint. ' WHEN c_custkey % 3 = 1 THEN c_name || '? *' || c_mktsegment || ', 12*(3). ' ELSE 'Nothing slanted. ' END
|| 'https://doi.org/10.1/(2001)' || c_custkey || '.' || chr(10) || chr(10)
|| CASE WHEN c_custkey % 2 = 0 THEN '> **Code**: https://c.org/' || c_custkey || chr(10) || '> **data**: [here](https://d.org/' || c_custkey || ') **Code**: https://other' || chr(10) || chr(10) ELSE '> see [in](./in)' || chr(10) || chr(10) END
|| CASE WHEN c_custkey % 7 = 0 THEN 'plain' || chr(10) || chr(10) || '> **Models**: https://late' || chr(10) || chr(10) ELSE '> **Models**: [m](https://m.org/' || c_custkey || ')' || chr(10) || chr(10) END"""
FENCE = "```\n## not a part\n| no | table |\n```\n"


def reference_pages(spark, sf):
    return pages(t(spark, sf, "customer"), "c_custkey", F.expr(REFERENCE), FENCE)


@query("""SELECT c_custkey AS id, 'Part ' || (c_custkey // 10 * 10) AS section,
CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN 'Doe, J. de C.|Guild of Cooks' WHEN c_custkey % 4 = 1 THEN NULL ELSE 'Roe, A.-B.' END AS authors,
CASE WHEN c_custkey % 5 = 0 THEN 0 WHEN c_custkey % 4 < 2 THEN 1 ELSE 0 END AS authors_dropped, CASE WHEN c_custkey % 5 > 0 THEN (1990 + c_custkey % 30)::INT END AS year,
CASE WHEN c_custkey % 5 = 0 OR c_custkey % 3 = 2 THEN NULL WHEN c_custkey % 3 = 0 THEN c_name ELSE c_name || '?' END AS title,
CASE WHEN c_custkey % 5 = 0 OR c_custkey % 3 = 2 THEN NULL WHEN c_custkey % 3 = 0 THEN 'Preprint' ELSE c_mktsegment END AS journal, '10.1/(2001)' || c_custkey AS doi,
CASE WHEN c_custkey % 2 = 0 THEN 'https://c.org/' || c_custkey END AS code_url, CASE WHEN c_custkey % 2 = 0 THEN 'https://d.org/' || c_custkey END AS data_url FROM customer""")
def scanned_references(spark, sf):
    r = catalogue.references(reference_pages(spark, sf), "page", "text")
    return r.select("id", "section", F.array_join("authors", "|").alias("authors"), "authors_dropped", "year", "title", "journal", "doi", "code_url", "data_url")


@query("""SELECT c_custkey AS id, label, url FROM (SELECT c_custkey, 'Code' AS label, 'https://c.org/' || c_custkey AS url FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'data', 'https://d.org/' || c_custkey FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 'Models', 'https://m.org/' || c_custkey FROM customer WHERE c_custkey % 7 > 0)""")
def labelled_runs(spark, sf):
    return catalogue.labelled_links(catalogue.anchored(reference_pages(spark, sf), "page", "text"), "page").select("id", "label", "url")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END + (c_custkey % 7 > 0)::INT AS n_lines FROM customer""")
def trailing_quotes(spark, sf):
    a = catalogue.anchored(reference_pages(spark, sf), "page", "text")
    return a.select("id", F.coalesce(F.regexp_count("quotes", F.lit("(?m)^>")), F.lit(0)).alias("n_lines"))


ENTRY = """CASE WHEN p_partkey % 20 = 0 THEN '## ' || p_brand || ' ##' || chr(10) ELSE '' END || '### ' || CASE WHEN p_partkey % 9 = 4 THEN p_name || ' *bare*' ELSE '[`' || p_name || '`](https://p.org/' || p_partkey || ') new' END
|| chr(10) || 'About ' || p_type || '.' || chr(10) || chr(10) || CASE WHEN p_partkey % 6 = 0 THEN '#### More' || chr(10) || 'inner' || chr(10) ELSE '' END"""
GROUPS = "SELECT p.p_partkey, p.p_name, p.p_type, g.p_brand AS grp FROM part p JOIN part g ON g.p_partkey = p.p_partkey // 20 * 20"


@query(f"""SELECT grp, CASE WHEN p_partkey % 9 = 4 THEN p_name || ' bare' ELSE p_name END AS name, CASE WHEN p_partkey % 9 <> 4 THEN 'https://p.org/' || p_partkey END AS url, 'About ' || p_type || '.' || CASE WHEN p_partkey % 6 = 0 THEN chr(10) || chr(10) || '#### More' || chr(10) || chr(10) || 'inner' ELSE '' END AS body_md
FROM ({GROUPS})""")
def entry_bodies(spark, sf):
    return catalogue.entries(pages(t(spark, sf, "part"), "p_partkey", F.expr(ENTRY)), "page", "text", until=3).select("grp", "name", "url", "body_md")


@query(f"SELECT grp, count(*)::BIGINT AS n, count(*) FILTER (p_partkey % 9 = 4)::BIGINT AS bare, count(DISTINCT p_type)::BIGINT AS bodies FROM ({GROUPS}) GROUP BY 1")
def entry_summaries(spark, sf):
    e = catalogue.entries(pages(t(spark, sf, "part"), "p_partkey", F.expr(ENTRY)), "page", "text")
    return e.groupBy("grp").agg(F.count("*").alias("n"), F.count_if(F.col("url").isNull()).alias("bare"), F.count_distinct("body_md").alias("bodies"))


ROW = "'| **' || s_name || '** | ' || CASE WHEN s_suppkey % 3 = 0 THEN '[Ra](#' || s_suppkey || '), [Rb](#' || (s_suppkey + 1) || ')' ELSE '' END || ' | [x](#5) | [' || s_nationkey || '](#' || s_nationkey || ') and [out](https://o) |'"


def grid_pages(spark, sf):
    return pages(t(spark, sf, "supplier"), "s_suppkey", F.expr(ROW), "intro\n\n| | [Cells](Taxonomy.md) | Unknown | Media |\n|--|:-:|--|--|\n", "\n\n| other |\n|--|\n")


@query("""SELECT s_name AS method, 'cell' AS area, 0 AS position, s_suppkey AS ref_id, 'Ra' AS label FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_name, 'cell', 1, s_suppkey + 1, 'Rb' FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT s_name, 'media', 0, s_nationkey, s_nationkey::VARCHAR FROM supplier""")
def grid_links(spark, sf):
    return catalogue.matrix_cells(grid_pages(spark, sf), "page", "text", {"Cells": "cell", "Media": "media"}).drop("page")


@query("""SELECT page, 'row' AS axis, row_number() OVER (PARTITION BY page ORDER BY s_suppkey)::INT AS position, '**' || s_name || '**' AS label_md FROM (SELECT *, floor(s_suppkey / 100)::BIGINT AS page FROM supplier)
UNION ALL SELECT page, 'column', k, l FROM (SELECT DISTINCT floor(s_suppkey / 100)::BIGINT AS page FROM supplier), (VALUES (1, '[Cells](Taxonomy.md)'), (2, 'Unknown'), (3, 'Media')) v(k, l)""")
def grid_headers(spark, sf):
    return catalogue.matrix_headers(grid_pages(spark, sf), "page", "text")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 3 THEN 'length' END AS fault, CASE WHEN s_suppkey % 11 <> 3 THEN s_name END AS name, CASE WHEN s_suppkey % 11 <> 3 THEN s_nationkey::VARCHAR END AS nation FROM supplier""")
def inventory_rows(spark, sf):
    s = t(spark, sf, "supplier")
    md = pages(s, "s_suppkey", F.expr("'| [' || s_name || '](u) | ' || s_nationkey || ' |'"), "## Other\n\n| a |\n|--|\n\n## Complete data inventory\nLead.\n\n| Name | Nation |\n|--|--|\n")
    tables = catalogue.inventory(md, "page", "text", "Complete data inventory")
    extra = F.when(F.col("s_suppkey") % 11 == 3, F.array(F.lit("more"))).otherwise(F.array().cast("array<string>"))
    stored = s.select("s_suppkey", F.floor(F.col("s_suppkey") / 100).alias("page"), F.concat(F.array(F.col("s_name"), F.col("s_nationkey").cast("string")), extra).alias("cells"))
    model, faults = catalogue.inventory_model(stored, tables, "page", "s_suppkey")
    good = model.select("s_suppkey", F.lit(None).cast("string").alias("fault"), "name", F.element_at("columns", F.lit("Nation")).alias("nation"))
    return good.unionByName(faults.select(F.col("violation_key").cast("long").alias("s_suppkey"), F.col("check_name").alias("fault")), allowMissingColumns=True)


WORD = "'### ' || p_name || ' ' || (p_partkey % 97) || chr(10) || 'First *line*' || chr(10) || 'of ' || p_partkey || '.' || chr(10) || chr(10) || '- a list' || chr(10) || chr(10) || 'Last.' || chr(10)"


def vocabulary(spark, sf):
    p = t(spark, sf, "part")
    head = "CASE p_partkey % 4 WHEN 0 THEN '## Areas' WHEN 1 THEN '## Methods' WHEN 2 THEN '## Themes' ELSE '## Prose' END || chr(10) || "
    return catalogue.definitions(pages(p, "p_partkey", F.expr(head + WORD)), "page", "text", {"Areas": "area", "Methods": "method", "Themes": "theme"})


@query("SELECT floor(p_partkey / 100)::BIGINT AS page, CASE p_partkey % 4 WHEN 0 THEN 'area' WHEN 1 THEN 'method' ELSE 'theme' END AS axis, p_name || ' ' || (p_partkey % 97) AS label, 'First line of ' || p_partkey || '. Last.' AS definition FROM part WHERE p_partkey % 4 < 3")
def axis_definitions(spark, sf):
    return vocabulary(spark, sf)[0]


@query("""WITH d AS (SELECT floor(p_partkey / 100)::BIGINT AS page, p_partkey % 4 AS a, p_name || ' ' || (p_partkey % 97) AS label FROM part)
SELECT 'label twice' AS check_name, page || ':' || label AS violation_key FROM d WHERE a < 3 GROUP BY page, a, label HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'no axis', page || ':Prose' FROM d WHERE a = 3
UNION ALL SELECT 'area and method', page || ':' || label FROM d WHERE a < 2 GROUP BY page, label HAVING count(DISTINCT a) > 1""")
def axis_faults(spark, sf):
    return vocabulary(spark, sf)[1]


ITEM = """CASE WHEN c_custkey % 50 = 0 THEN '## Sec ' || c_custkey || chr(10) || 'Intro.' || chr(10) || chr(10) ELSE '' END || '- ' || CASE c_custkey % 5 WHEN 0 THEN 'no link' WHEN 1 THEN '[' || c_name || '](https://youtu.be/abcdefghijk) — *' || c_mktsegment || '*, then [b](c)'
WHEN 2 THEN '**[' || c_name || '](https://a.b/' || c_custkey || ')**' WHEN 3 THEN 'by [' || c_name || '](https://www.youtube.com/playlist?list=x)' ELSE '[' || c_name || '](d "T") - note' END"""


@query("""SELECT 'Sec ' || (c_custkey // 50 * 50) AS section, c_name AS title, CASE c_custkey % 5 WHEN 1 THEN 'https://youtu.be/abcdefghijk' WHEN 2 THEN 'https://a.b/' || c_custkey WHEN 3 THEN 'https://www.youtube.com/playlist?list=x' ELSE 'd' END AS url,
CASE c_custkey % 5 WHEN 1 THEN c_mktsegment || ', then b' WHEN 4 THEN 'note' ELSE '' END AS note, CASE c_custkey % 5 WHEN 1 THEN 'video' WHEN 3 THEN 'playlist' ELSE 'link' END AS kind FROM customer WHERE c_custkey % 5 > 0""")
def listed_items(spark, sf):
    return catalogue.list_items(pages(t(spark, sf, "customer"), "c_custkey", F.expr(ITEM)), "page", "text").drop("page", "ordinal")


@query("SELECT 'Sec ' || (c_custkey // 50 * 50) AS section, count(*)::BIGINT AS n FROM customer WHERE c_custkey % 5 > 0 GROUP BY 1")
def listed_counts(spark, sf):
    items = catalogue.list_items(pages(t(spark, sf, "customer"), "c_custkey", F.expr(ITEM)), "page", "text")
    return items.groupBy("section").agg(F.count("*").alias("n"))


@query("""SELECT s.page AS page, s.c_custkey AS id, s.section, s.at FROM (SELECT c_custkey, floor(c_custkey / 100)::BIGINT AS page, CASE WHEN c_custkey % 13 = 0 THEN 'Gone' ELSE 'Part ' || (c_custkey // 10 * 10) END AS section, CASE WHEN c_custkey % 13 = 0 THEN 'lost' ELSE 'placed' END AS at FROM customer) s""")
def spliced_references(spark, sf):
    section = F.when(F.col("c_custkey") % 13 == 0, "Gone").otherwise(F.concat(F.lit("Part "), (F.floor(F.col("c_custkey") / 10) * 10).cast("string")))
    rows = t(spark, sf, "customer").select(F.floor(F.col("c_custkey") / 100).alias("page"), section.alias("section"), F.col("c_custkey").alias("id"), F.col("c_name").alias("raw"), F.lit(None).cast("string").alias("quotes"))
    placed, lost = catalogue.spliced(reference_pages(spark, sf), "page", "text", rows)
    k = F.split("violation_key", ":")
    gone = lost.select(k[0].cast("long").alias("page"), k[2].cast("long").alias("id"), k[1].alias("section"), F.lit("lost").alias("at"))
    return placed.select("page", F.col("ordinal").alias("id"), "section", F.lit("placed").alias("at")).unionByName(gone)


@query("""SELECT lang || '/' || CASE WHEN doc_id % 9 = 0 THEN 'README.md' ELSE doc_id || '.md' END AS path, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS folder_rank, doc_id % 9 <> 0 AS after_readme, sum(len(string_split(text, chr(10))))::BIGINT AS n_lines FROM documents GROUP BY 1, 2, 3""")
def joined_corpus(spark, sf):
    path = F.concat("lang", F.lit("/"), F.when(F.col("doc_id") % 9 == 0, "README.md").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".md"))))
    rows = catalogue.corpus_lines(t(spark, sf, "documents").select(path.alias("file"), "text"), "file", "text", {"en": 0, "de": 1})
    return rows.groupBy("path", "folder_rank", "after_readme").agg(F.count("*").alias("n_lines"))


URL = "CASE event_id % 6 WHEN 0 THEN 'https://a' WHEN 1 THEN '../data/' || event_type || '.md#x' WHEN 2 THEN './' || event_type || '/' WHEN 3 THEN 'pic.png' WHEN 4 THEN '#' || user_id ELSE '../../up/./' || user_id || '/../z.MD' END"


@query(f"""SELECT event_id, CASE event_id % 6 WHEN 1 THEN CASE WHEN event_type = 'click' THEN '/b/data/click/' ELSE 'https://blob/data/' || event_type || '.md#x' END WHEN 2 THEN CASE WHEN event_type = 'view' THEN '/b/docs/view/README/' ELSE 'https://blob/docs/' || event_type || '/README.md' END
WHEN 5 THEN 'https://blob/../up/z.MD' ELSE {URL} END AS link FROM events""")
def routed_links(spark, sf):
    e = t(spark, sf, "events").select("event_id", F.expr(URL).alias("url"), F.lit("docs/page.md").alias("source"))
    known = spark.createDataFrame([("data/click",), ("docs/view/README",)], "page string")
    return enrich.routed(e, "url", "source", known, "/b/", "https://blob").select("event_id", "link")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY coalesce(y, 0) DESC, o_orderkey)::BIGINT AS place FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN year(o_orderdate) END AS y FROM orders)")
def newest_years(spark, sf):
    y = F.coalesce(F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate")), F.lit(0))
    o = t(spark, sf, "orders").select("o_orderkey", y.alias("y"))
    return enrich.places(o, [F.desc("y"), "o_orderkey"], "n").select("o_orderkey", (F.col("n") + 1).alias("place"))


@query("""SELECT title, kind, ts FROM (SELECT 'T' || user_id AS title, event_type AS kind, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type <> 'error') WHERE k = 1 ORDER BY ts DESC, event_id DESC LIMIT 5""")
def recent_five(spark, sf):
    e = t(spark, sf, "events").where("event_type <> 'error'").select(F.concat(F.lit("T"), "user_id").alias("title"), F.struct("ts", "event_id", F.col("event_type").alias("kind")).alias("e"))
    # One row a title comes out of a partial aggregation; then the five newest.
    return e.groupBy("title").agg(F.max("e").alias("e")).orderBy(F.desc("e")).limit(5).select("title", "e.kind", "e.ts")


@query("SELECT event_type AS kind, max(ts) AS newest FROM events GROUP BY 1")
def newest_of_kind(spark, sf):
    return t(spark, sf, "events").groupBy(F.col("event_type").alias("kind")).agg(F.max("ts").alias("newest"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY lower(p_type), lower(p_brand), p_partkey)::BIGINT AS place FROM part")
def collated_order(spark, sf):
    by = [F.collate("p_type", "UNICODE_CI"), F.collate("p_brand", "UNICODE_CI"), F.col("p_partkey")]
    return enrich.places(t(spark, sf, "part").select("p_partkey", "p_type", "p_brand"), by, "n").select("p_partkey", (F.col("n") + 1).alias("place"))


@query("""SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(r, 99), p_type, p_partkey)::INT AS place FROM part LEFT JOIN (VALUES ('STANDARD', 0), ('ECONOMY', 1)) v(k, r) ON k = p_type""")
def canonical_order(spark, sf):
    rank = F.when(F.col("p_type") == "STANDARD", 0).when(F.col("p_type") == "ECONOMY", 1).otherwise(99)
    return t(spark, sf, "part").select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(rank, "p_type", "p_partkey")).alias("place"))


@query("""SELECT 'tier' AS facet, count(*) FILTER (CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END = 'F')::BIGINT AS n FROM orders UNION ALL SELECT 'band', count(*) FILTER (o_orderkey % 4 > 0 AND o_orderkey % 1500 BETWEEN 100 AND 999) FROM orders
UNION ALL SELECT 'known', count(*) FILTER (o_orderpriority = '5-LOW') FROM orders UNION ALL SELECT 'unknown', count(*) FROM orders""")
def facet_counts(spark, sf):
    o = t(spark, sf, "orders").select(F.nullif("o_orderstatus", F.lit("P")).alias("tier"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey") % 1500).alias("cites"), "o_orderpriority").withColumn("band", T.citation_band(F.col("cites")))
    known = {"tier": ("F", "O"), "band": ("100to999",), "o_orderpriority": ("5-LOW",)}
    one = lambda name, chosen: facets(o, chosen, known).agg(F.count("*").alias("n")).select(F.lit(name).alias("facet"), "n")
    return one("tier", {"tier": "F"}).unionByName(one("band", {"band": "100to999"})).unionByName(one("known", {"o_orderpriority": "5-LOW"})).unionByName(one("unknown", {"o_orderpriority": "6-NONE"}))


@query("SELECT c_nationkey, CASE WHEN c_nationkey % 2 = 0 THEN 0 ELSE count(*) FILTER (c_acctbal <= 0) END::BIGINT AS unlinked FROM customer GROUP BY 1")
def remainder_counts(spark, sf):
    g = t(spark, sf, "customer").groupBy("c_nationkey").agg((F.count("*") - F.count_if(F.col("c_acctbal") > 0)).alias("n"))
    return g.select("c_nationkey", F.when(F.col("c_nationkey") % 2 == 0, 0).otherwise(F.col("n")).cast("long").alias("unlinked"))


@query("""SELECT 'one theme of a name' AS check_name, r_name AS violation_key FROM region WHERE (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) <> 5 UNION ALL SELECT 'parent', n_name FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey > 0)
UNION ALL SELECT 'shared slug', c_mktsegment FROM (SELECT DISTINCT c_mktsegment FROM customer) WHERE c_mktsegment IN (SELECT p_type FROM part UNION SELECT c_mktsegment FROM customer WHERE c_custkey % 5 = 1)""")
def topic_tiers(spark, sf):
    n, r, c, p = (t(spark, sf, x) for x in ("nation", "region", "customer", "part"))
    k = n.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("k"))
    exact = checks.where(r.join(k, "r_regionkey", "left"), F.coalesce("k", F.lit(0)) != 5, "r_name", "one theme of a name")
    orphan = checks.where(n.join(r.where("r_regionkey > 0"), n.n_regionkey == r.r_regionkey, "left_anti"), F.lit(True), "n_name", "parent")
    slugs = p.select(F.col("p_type").alias("s")).union(c.where("c_custkey % 5 = 1").select("c_mktsegment"))
    return exact.unionByName(orphan).unionByName(checks.present(c, "c_mktsegment", slugs, "shared slug"))


@query("""WITH e AS (SELECT DISTINCT l_partkey AS s, l_suppkey AS d FROM lineitem WHERE l_partkey <> l_suppkey), v AS (SELECT p_partkey AS id, p_brand AS label FROM part WHERE p_size > 10),
k AS (SELECT s, d FROM e WHERE s IN (SELECT id FROM v) AND d IN (SELECT id FROM v)) SELECT id, label, (SELECT count(*) FROM k WHERE d = id)::BIGINT AS cited, (SELECT count(*) FROM k WHERE s = id)::BIGINT AS citing FROM v WHERE id IN (SELECT s FROM k UNION SELECT d FROM k)""")
def shown_nodes(spark, sf):
    nodes = t(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("label"))
    e = graph.induced(t(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")), nodes)
    return graph.shown(nodes, e)


@query("""SELECT name, string_agg(n || ':' || l, ',' ORDER BY n) AS cells FROM (SELECT p_brand AS name, p_size AS n, count(*) AS l FROM part GROUP BY 1, 2) GROUP BY 1""")
def json_lines_back(spark, sf):
    p = t(spark, sf, "part").groupBy(F.col("p_brand").alias("name"), F.col("p_size").alias("n")).agg(F.count("*").alias("l"))
    lines = catalogue.json_rows(p, ["name", "n"])
    back = lines.select(F.from_json("value", "name string, n int, l long").alias("r")).select("r.*")
    cells = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "l"))), lambda x: F.concat_ws(":", x["n"].cast("string"), x["l"].cast("string"))), ",")
    return back.groupBy("name").agg(cells.alias("cells"))
