"""Queries over models: payloads against their schema, items added by descriptor, curated entries with their ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.operators import additions, checks, enrich, graph, matrix, payload
from shelfmark.plans.catalog import query, t
from shelfmark.session import scratch_dir, settle
from shelfmark.sources import ndjson

#: The payload of an order, and faults planted by its key.
SCHEMA = {
    "type": "object",
    "required": ["id", "status", "customer", "lines"],
    "additionalProperties": False,
    "properties": {
        "id": {"type": "integer", "minimum": 1},
        "status": {"enum": ["F", "O", "P"]},
        "note": {"type": ["string", "null"], "pattern": "^[a-z ]*$"},
        "customer": {
            "type": "object",
            "required": ["key"],
            "properties": {"key": {"type": "integer"}, "address": {"type": "object", "additionalProperties": False, "properties": {"nation": {"type": "integer"}, "geo": {"$ref": "#/$defs/geo"}}}},
        },
        "lines": {"type": "array", "items": {"type": "object", "required": ["part", "qty"], "properties": {"part": {"type": "integer"}, "qty": {"type": "number"}, "tags": {"type": "array", "items": {"type": "string"}}}}},
    },
    "$defs": {"geo": {"type": "object", "additionalProperties": False, "properties": {"lat": {"type": "number"}, "within": {"$ref": "#/$defs/geo"}}}},
}
BODY = """'{' || CASE WHEN o_orderkey % 23 = 0 THEN '"id"' ELSE '"id":' || CASE WHEN o_orderkey % 7 = 0 THEN '"x"' WHEN o_orderkey % 31 = 0 THEN '-2' WHEN o_orderkey % 37 = 0 THEN '2.0' WHEN o_orderkey % 41 = 0 THEN '2.5' ELSE o_orderkey || '' END END
|| CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE ',"status":"' || CASE WHEN o_orderkey % 29 = 0 THEN 'X' ELSE o_orderstatus END || '"' END
|| CASE WHEN o_orderkey % 5 = 0 THEN ',"note":null' WHEN o_orderkey % 5 = 1 THEN ',"note":"Odd 1"' ELSE '' END || CASE WHEN o_orderkey % 43 = 0 THEN ',"a/b~c":[{}]' ELSE '' END
|| ',"customer":{"key":' || o_custkey || ',"free":1,"address":{"nation":1' || CASE WHEN o_orderkey % 13 = 0 THEN ',"zip":"1"' ELSE '' END || ',"geo":{"lat":1.5,"within":{"lat":' || CASE WHEN o_orderkey % 47 = 0 THEN 'false' ELSE '2' END || ',"within":{"lat":3}}}}}'
|| ',"lines":[{"part":1,"qty":' || CASE WHEN o_orderkey % 19 = 0 THEN '"many"' ELSE '2.5' END || ',"tags":["a",' || CASE WHEN o_orderkey % 53 = 0 THEN '7' ELSE '"b"' END || ']},{' || CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE '"part":2,' END || '"qty":3}]}'"""
PLANTED = """p AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders), faults AS (
SELECT k, '' AS path, 'json' AS fault, '' AS detail FROM p WHERE k % 23 = 0
UNION ALL SELECT k, f.path, f.fault, f.detail FROM p, LATERAL (VALUES (k % 7 = 0, '/id', 'type', 'STRING'), (k % 7 <> 0 AND k % 31 = 0, '/id', 'value', '-2'), (k % 7 <> 0 AND k % 31 <> 0 AND k % 37 <> 0 AND k % 41 = 0, '/id', 'type', 'DECIMAL'),
  (k % 11 = 0, '', 'missing', 'status'), (k % 11 <> 0 AND k % 29 = 0, '/status', 'value', 'X'), (k % 5 = 1, '/note', 'value', 'Odd 1'), (k % 43 = 0, '', 'extra', 'a/b~c'), (k % 13 = 0, '/customer/address', 'extra', 'zip'),
  (k % 47 = 0, '/customer/address/geo/within/lat', 'type', 'BOOLEAN'), (k % 19 = 0, '/lines/0/qty', 'type', 'STRING'), (k % 53 = 0, '/lines/0/tags/1', 'type', 'BIGINT'), (k % 17 = 0, '/lines/1', 'missing', 'part')) f(bad, path, fault, detail)
  WHERE k % 23 <> 0 AND f.bad)"""


def payload_frame(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", F.expr(BODY).alias("body"))


@query(f"WITH {PLANTED} SELECT k AS o_orderkey, path, fault, detail FROM faults")
def payload_faults(spark, sf):
    return payload.violations(payload_frame(spark, sf), "o_orderkey", "body", SCHEMA)


@query(f"""WITH {PLANTED}, l AS (SELECT k, (CASE WHEN path = '' THEN '<root>' ELSE path END) || ': ' || fault || ' ' || detail AS line FROM faults)
SELECT k AS o_orderkey, count(*)::BIGINT AS n_faults, array_to_string((list(line ORDER BY line))[1:2], '; ') AS first_faults FROM l GROUP BY 1""")
def payload_summaries(spark, sf):
    s = payload.summary(payload.violations(payload_frame(spark, sf), "o_orderkey", "body", SCHEMA), "o_orderkey", shown=2)
    return s.select("o_orderkey", "n_faults", F.concat_ws("; ", "first_faults").alias("first_faults"))


SPECS = """SELECT c_custkey AS spec, CASE c_custkey % 4 WHEN 0 THEN 'paper' WHEN 1 THEN 'software' WHEN 2 THEN 'database' ELSE 'dataset' END AS type,
CASE WHEN c_custkey % 4 IN (1, 2) THEN 'Tool ' || c_mktsegment || ' ' || chr(65 + c_nationkey) END AS name, CASE WHEN c_custkey % 4 IN (1, 2) THEN 'https://t.example/' || c_custkey END AS url, c_mktsegment AS grp,
CASE WHEN c_custkey % 8 = 0 THEN 'Notes' END AS section, CASE WHEN c_custkey % 4 = 0 THEN CASE WHEN c_custkey % 3 = 0 THEN '<a id="7">7</a> ' ELSE '' END || c_name || ' (2001).' END AS raw, 'P' || c_nationkey AS label,
CASE WHEN c_custkey % 12 = 0 THEN 'https://c.example/' || c_custkey ELSE '' END AS code_url, CASE WHEN c_nationkey % 2 = 0 THEN 'cell' ELSE 'Media Optimization' END AS area,
CASE WHEN c_custkey % 4 = 3 THEN CASE WHEN c_nationkey % 3 = 0 THEN 'see PRJNA' || c_nationkey ELSE '[Herd *' || c_mktsegment || '*](u) of cows' END END AS first_cell, CASE WHEN c_nationkey % 5 = 0 THEN 'protein' ELSE 'beef' END AS topic FROM customer"""


def spec_frame(spark, sf):
    """A descriptor for each customer, of four types."""
    s = spark.sql(SPECS.replace("FROM customer", "FROM {c}"), c=t(spark, sf, "customer"))
    cell = F.struct(F.lit("Learning").alias("method"), "area")
    return s.select(
        "spec", "type", "name", "url", "grp", F.lit(None).cast("string").alias("body"), "section", "raw", "label", "code_url", F.lit(None).cast("string").alias("data_url"),
        F.when(F.col("spec") % 12 == 0, F.array(F.lit("> **Models**: m"))).alias("blockquotes"), F.when(F.col("type") == "paper", F.array(cell, cell)).alias("cells"), F.when(F.col("type") == "dataset", F.lit("Cow")).alias("page"),
        F.when(F.col("type") == "dataset", F.array("first_cell", F.lit("x"))).alias("row"), F.array(F.lit("beef"), "topic").alias("topics"),
    )


def store(spark, sf):
    """Tables that suppliers fill: papers, a few tools and rows, and retired numbers beyond the papers'."""
    s = t(spark, sf, "supplier")
    none = {name: spark.createDataFrame([], schema) for name, schema in additions.TABLES.items()}
    paper = s.select(F.concat(F.lit("paper:"), "s_suppkey").alias("item_id"), F.col("s_suppkey").alias("ref_id"), F.when(F.col("s_suppkey") % 2 == 0, "Notes").otherwise("References").alias("section"), F.col("s_name").alias("raw"), F.lit(None).cast("string").alias("blockquotes_md"), F.col("s_suppkey").alias("ordinal"))
    taken = t(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("sw:tool-building-"), F.expr("chr(97 + n_nationkey)")).alias("id"), F.lit("software").alias("type"), F.lit("x").alias("slug"), "n_nationkey")
    catalog = taken.select(F.col("id").alias("item_id"), F.lit("n").alias("name"), F.lit("u").alias("url"), F.lit("g").alias("grp"), F.lit("h").alias("heading_md"), F.lit("b").alias("body_md"), F.col("n_nationkey").cast("long").alias("ordinal"))
    return none | {
        "items": paper.select(F.col("item_id").alias("id"), F.lit("paper").alias("type"), F.col("ref_id").cast("string").alias("slug")).unionByName(taken.drop("n_nationkey")),
        "papers": paper, "catalog": catalog, "retired_paper_ids": spark.createDataFrame([(5000,)], "ref_id long"), "methods": spark.createDataFrame([("Learning",)], "label string"),
        "areas": spark.createDataFrame([("cell", "Cells"), ("media", "Media Optimization")], "key string, label string"), "topics": spark.createDataFrame([("topic:beef", "beef"), ("topic:protein", "protein")], "item_id string, slug string"),
    }


ADDED = f"""WITH s AS ({SPECS}), paper AS (SELECT *, greatest(5000, (SELECT max(s_suppkey) FROM supplier)) + row_number() OVER (ORDER BY spec) AS ref, (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY spec) AS ord FROM s WHERE type = 'paper'),
seeded AS (SELECT *, CASE type WHEN 'software' THEN 'sw:' WHEN 'database' THEN 'db:' ELSE 'ds:' END || lower(replace(CASE WHEN type <> 'dataset' THEN name WHEN first_cell LIKE 'see%' THEN substr(first_cell, 5) ELSE 'Herd ' || grp || 'u of' END, ' ', '-')) AS base0 FROM s WHERE type <> 'paper'),
based AS (SELECT *, CASE WHEN type = 'dataset' AND first_cell NOT LIKE 'see%' THEN 'ds:herd-' || lower(grp) || 'u-of' ELSE base0 END AS base FROM seeded),
named AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY spec) + (base IN (SELECT 'sw:tool-building-' || chr(97 + n_nationkey) FROM nation WHERE n_nationkey % 2 = 0))::INT AS k, row_number() OVER (PARTITION BY type ORDER BY spec) AS m FROM based)
"""


@query(ADDED + """SELECT 'papers' AS tbl, 'paper:' || ref AS item_id, coalesce(section, 'References') || '|<a id="' || ref || '">' || ref || '</a> ' || regexp_replace(raw, '^<a id="7">7</a> ', '') || CASE WHEN spec % 12 = 0 THEN '|> **Code**: ' || code_url || chr(10) || chr(10) || '> **Models**: m' ELSE '' END AS detail, ord AS ordinal FROM paper
UNION ALL SELECT 'catalog', CASE WHEN k = 1 THEN base ELSE base || '-' || k END, grp || '|[' || name || '](' || url || ')', m + CASE WHEN type = 'software' THEN (SELECT max(n_nationkey) FROM nation WHERE n_nationkey % 2 = 0) ELSE 0 END FROM named WHERE type <> 'dataset'
UNION ALL SELECT 'dataset_rows', CASE WHEN k = 1 THEN base ELSE base || '-' || k END, 'Cow|["' || first_cell || '","x"]', m FROM named WHERE type = 'dataset'""")
def added_items(spark, sf):
    new, _ = additions.rows_of(store(spark, sf), spec_frame(spark, sf))
    one = lambda name, *parts: new[name].select(F.lit(name).alias("tbl"), "item_id", F.concat_ws("|", *parts).alias("detail"), "ordinal")
    return one("papers", "section", "raw", "blockquotes_md").unionByName(one("catalog", "grp", "heading_md")).unionByName(one("dataset_rows", "page", "cells_json"))


@query(ADDED + """SELECT CASE WHEN area = 'cell' THEN 'cell' ELSE 'media' END AS area_key, ref AS ref_id, label, (row_number() OVER (ORDER BY spec) - 1) * 2 + i AS ordinal FROM paper, (VALUES (1), (2)) v(i)""".replace("(row_number() OVER (ORDER BY spec) - 1) * 2 + i", "(dense_rank() OVER (ORDER BY spec) - 1) * 2 + i"))
def added_cells(spark, sf):
    return additions.rows_of(store(spark, sf), spec_frame(spark, sf))[0]["matrix_cells"].drop("method")


@query(f"""WITH s AS ({SPECS}) SELECT f.check_name, spec || CASE WHEN f.detail IS NULL THEN ':' ELSE ':' || f.detail END AS violation_key FROM s, LATERAL (VALUES (spec % 5 = 0 AND type = 'paper', 'section', 'Gone'), (spec % 7 = 0 AND type = 'paper', 'method', 'Guess'), (spec % 7 = 0 AND type = 'paper', 'area', 'none'), (spec % 11 = 0, 'topic', 'odd'),
  (spec % 13 = 0 AND type = 'dataset', 'page', 'Pig'), (spec % 9 = 0 AND type = 'dataset', 'no cells', NULL), (spec % 17 = 0 AND type IN ('software', 'database'), 'missing', 'url')) f(bad, check_name, detail) WHERE f.bad""")
def refused_additions(spark, sf):
    s, at = spec_frame(spark, sf), lambda n: F.col("spec") % n == 0
    s = s.withColumns({
        "section": F.when(at(5), "Gone").otherwise(F.col("section")), "cells": F.when(at(7) & (F.col("type") == "paper"), F.array(F.struct(F.lit("Guess").alias("method"), F.lit("none").alias("area")))).otherwise(F.col("cells")),
        "topics": F.when(at(11), F.array(F.lit("odd"))).otherwise(F.col("topics")), "page": F.when(at(13), "Pig").otherwise(F.col("page")), "row": F.when(at(9), F.array().cast("array<string>")).otherwise(F.col("row")), "url": F.when(at(17), F.lit(None)).otherwise(F.col("url")),
    })
    return additions.refused(store(spark, sf), s, spark.createDataFrame([("Cow",)], "page string"))


CURATED = """SELECT p_partkey AS place, CASE WHEN p_partkey % 40 = 1 THEN '!!' ELSE p_type || ' ' || (CASE WHEN p_partkey % 3 = 0 THEN 'Atlas' ELSE 'atlas.' END) END AS name, p_brand AS page, CASE WHEN p_partkey % 6 < 5 THEN p_partkey % 6 END AS lic,
CASE WHEN p_partkey % 7 > 0 THEN 'https://doi.org/10.1/X' || p_size END AS doi, CASE p_partkey % 4 WHEN 0 THEN '["10.1/x' || (p_size + 1) || '","doi:10.1/X' || p_size || '",null]' WHEN 1 THEN 'not json' WHEN 2 THEN '["10.1/x3"]' END AS related FROM part"""


def curated(spark, sf):
    e = spark.sql(CURATED.replace("FROM part", "FROM {p}"), p=t(spark, sf, "part"))
    licence = F.when(F.col("lic") == 0, "MIT").when(F.col("lic") == 1, "CC-BY-NC-4.0").when(F.col("lic") == 2, "GPL-3.0").when(F.col("lic") == 3, "odd terms").when(F.col("lic") == 4, "")
    item = F.concat(F.lit("ds:"), F.col("place").cast("string"))
    e = e.select("place", item.alias("item_id"), "name", F.lit("u").alias("url"), "page", F.lit("Atlases").alias("section"), F.lit("atlas").alias("kind"), licence.alias("license"), F.lit("auto").alias("license_source"), "doi", F.lit("manual").alias("doi_source"), F.col("related").alias("related_dois"))
    li = t(spark, sf, "lineitem").where("l_quantity > 30").select(F.concat(F.lit("ds:"), F.col("l_partkey").cast("string")).alias("item_id"), F.col("l_returnflag").alias("slug"), F.col("l_linestatus").alias("theme"))
    counts = t(spark, sf, "nation").where("n_nationkey <> 7").select(F.concat(F.lit("10.1/x"), F.col("n_nationkey").cast("string")).alias("doi"), F.col("n_nationkey").cast("long").alias("n"))
    return enrich.curated_model(e, li, counts)


@query(f"""WITH e AS ({CURATED}), a AS (SELECT *, 'ds-' || CASE WHEN name = '!!' THEN 'entry' ELSE lower(replace(replace(name, ' ', '-'), '.', '')) END AS base FROM e),
d AS (SELECT place, CASE WHEN doi IS NOT NULL THEN TRY_CAST(regexp_extract(doi, 'X(.*)$', 1) AS BIGINT) END AS k, 0 AS i FROM e UNION ALL SELECT place, TRY_CAST(regexp_extract(related, 'x([0-9]+)', 1) AS BIGINT), 1 FROM e WHERE place % 4 IN (0, 2) UNION ALL SELECT place, TRY_CAST(regexp_extract(related, 'X([0-9]+)', 1) AS BIGINT), 2 FROM e WHERE place % 4 = 0),
f AS (SELECT place, k, min(i) AS i FROM d WHERE k < 25 AND k <> 7 AND k IS NOT NULL GROUP BY 1, 2), c AS (SELECT place, sum(k)::BIGINT AS total, count(*)::BIGINT AS n, string_agg('10.1/x' || k, ',' ORDER BY i, k) AS dois FROM f GROUP BY 1),
tp AS (SELECT l_partkey AS place, string_agg(DISTINCT l_returnflag || '/' || l_linestatus, ',' ORDER BY l_returnflag || '/' || l_linestatus) AS topics FROM lineitem WHERE l_quantity > 30 GROUP BY 1),
nb AS (SELECT *, row_number() OVER (PARTITION BY page, base ORDER BY place) AS m FROM a)
SELECT nb.place, page, CASE WHEN m = 1 THEN base ELSE base || '-' || m END AS anchor, CASE lic WHEN 0 THEN 'permissive' WHEN 1 THEN 'restricted' WHEN 2 THEN 'copyleft' ELSE 'unknown' END AS tier, c.total AS citation_count, coalesce(c.n, 0) AS citation_sources, coalesce(c.dois, '') AS citation_dois, coalesce(topics, '') AS topics
FROM nb LEFT JOIN c USING (place) LEFT JOIN tp USING (place)""")
def curated_entries(spark, sf):
    topics = F.array_join(F.transform("topics", lambda x: F.concat_ws("/", x["slug"], x["theme"])), ",")
    return curated(spark, sf).select("place", "page", "anchor", "tier", "citation_count", "citation_sources", F.array_join("citation_dois", ",").alias("citation_dois"), topics.alias("topics"))


AUTHORED = """SELECT o_orderkey AS id, unnest([CASE WHEN o_orderkey % 2 = 0 THEN '  ' || 'Cook' || o_custkey || ', Ann' ELSE 'cook' || o_custkey || ', a. B.' END, CASE WHEN o_orderkey % 997 < 2 THEN 'Hub, H.' END, CASE WHEN o_orderkey % 5 = 0 THEN 'Guild' || (o_custkey + 1) END]) AS author FROM orders"""


def authored(spark, sf):
    names = F.array(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("  Cook"), F.col("o_custkey").cast("string"), F.lit(", Ann"))).otherwise(F.concat(F.lit("cook"), F.col("o_custkey").cast("string"), F.lit(", a. B."))), F.when(F.col("o_orderkey") % 997 < 2, "Hub, H."), F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("Guild"), (F.col("o_custkey") + 1).cast("string"))))
    a = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.posexplode(names).alias("i", "author"))
    return a.withColumn("key", T.author_key(F.col("author")))


@query(f"""WITH a AS ({AUTHORED}), k AS (SELECT id, trim(author) AS name, CASE WHEN author LIKE '%,%' THEN lower(split_part(trim(author), ',', 1)) || '|' || lower(left(trim(split_part(author, ',', 2)), 1)) ELSE lower(author) END AS key FROM a WHERE author IS NOT NULL),
n AS (SELECT key, arg_min(name, id) AS name FROM k GROUP BY 1), d AS (SELECT DISTINCT id, key FROM k)
SELECT x.id AS src, y.id AS dst, string_agg(DISTINCT n.name, '; ' ORDER BY n.name) AS shared FROM d x JOIN d y ON x.key = y.key AND x.id < y.id JOIN n ON n.key = x.key GROUP BY 1, 2""")
def coauthor_edges(spark, sf):
    return graph.shared_names(authored(spark, sf), "key", "id", "author", ["id", "i"]).select("src", "dst", F.array_join("shared", "; ").alias("shared"))


def works(spark, sf):
    """A work for each part of an even key, named in an address or bare, with the suppliers' and parts' numbers of its lines as works that it names."""
    li = t(spark, sf, "lineitem").groupBy("l_partkey").agg(F.collect_list(F.concat(F.when(F.col("l_linenumber") % 2 == 0, "https://works.example/w").otherwise(" W"), (F.col("l_suppkey") * 2).cast("string"))).alias("referenced"))
    w = t(spark, sf, "part").where("p_partkey % 2 = 0").join(li, F.col("p_partkey") == F.col("l_partkey"), "left")
    key = F.col("p_partkey").cast("string")
    return w.select(F.concat(F.lit("10.5/w"), key).alias("doi"), F.concat(F.lit("https://works.example/W"), key).alias("work_id"), "referenced")


@query("""WITH e AS (SELECT DISTINCT l_partkey AS src, l_suppkey * 2 AS dst FROM lineitem WHERE l_partkey % 2 = 0 AND l_partkey % 10 <> 0 AND l_suppkey * 2 <> l_partkey AND (l_suppkey * 2) % 10 <> 0 AND l_suppkey * 2 IN (SELECT p_partkey FROM part))
SELECT * FROM e WHERE src IN (SELECT p_partkey FROM part)""")
def citation_edges(spark, sf):
    doi = F.when(F.col("p_partkey") % 10 > 0, F.concat(F.lit("HTTPS://DOI.org/10.5/W"), F.col("p_partkey").cast("string")))
    return graph.citations(t(spark, sf, "part").select(F.col("p_partkey").alias("id"), doi.alias("doi")), works(spark, sf))


TREE = """SELECT 't' || r_regionkey AS slug, r_name AS label, NULL AS theme, r_regionkey AS place FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 't' || n_regionkey, n_nationkey FROM nation"""
TAGGED = "SELECT c_custkey AS id, c_mktsegment AS kind, c_nationkey AS n, (c_custkey % 25)::INT AS m, c_custkey % 9 = 0 AS whole FROM customer"


@query(f"""WITH tree AS ({TREE}), c AS ({TAGGED}), s AS (SELECT id, kind, 'n' || n AS slug FROM c UNION SELECT id, kind, 'n' || m FROM c UNION SELECT id, kind, 't' || n_regionkey FROM c JOIN nation ON n_nationkey IN (n, m) UNION SELECT id, kind, 't' || (id % 5) FROM c WHERE whole),
g AS (SELECT slug, count(*) AS total, count(*) FILTER (kind = 'BUILDING') AS building, count(*) FILTER (kind = 'MACHINERY') AS machinery FROM s GROUP BY 1), x AS (SELECT tree.*, coalesce(total, 0) AS total, coalesce(building, 0) AS building, coalesce(machinery, 0) AS machinery FROM tree LEFT JOIN g USING (slug))
SELECT (row_number() OVER (ORDER BY coalesce(p.place, x.place), x.theme IS NOT NULL, CASE WHEN x.theme IS NOT NULL THEN -x.total END, x.place) - 1)::INT AS "row", x.slug, x.theme, x.total::BIGINT AS total, x.building::BIGINT AS building, x.machinery::BIGINT AS machinery FROM x LEFT JOIN tree p ON p.slug = x.theme""")
def overlapping_grid(spark, sf):
    """Customers under two nations each, often of one region, and some under a region itself."""
    c, n, r = (t(spark, sf, x) for x in ("customer", "nation", "region"))
    tag = lambda c: F.concat(F.lit("n"), c.cast("string"))
    tree = r.select(F.concat(F.lit("t"), F.col("r_regionkey").cast("string")).alias("slug"), F.col("r_name").alias("label"), F.lit(None).cast("string").alias("theme"), F.col("r_regionkey").alias("place"))
    tree = tree.unionByName(n.select(tag(F.col("n_nationkey")).alias("slug"), F.col("n_name").alias("label"), F.concat(F.lit("t"), F.col("n_regionkey").cast("string")).alias("theme"), F.col("n_nationkey").alias("place")))
    up = F.broadcast(n.select(F.col("n_nationkey").alias("k"), F.concat(F.lit("t"), F.col("n_regionkey").cast("string")).alias("theme")))  # 25 nations
    each = c.select("c_custkey", "c_mktsegment", F.explode(F.array(F.col("c_nationkey"), (F.col("c_custkey") % 25).cast("int"))).alias("k")).join(up, "k")
    own = each.groupBy("c_custkey", "c_mktsegment").agg(F.collect_list(F.struct(tag(F.col("k")).alias("slug"), "theme")).alias("topics"))
    whole = F.concat(F.lit("t"), (F.col("c_custkey") % 5).cast("string"))
    own = own.withColumn("topics", F.when(F.col("c_custkey") % 9 == 0, F.concat("topics", F.array(F.struct(whole.alias("slug"), whole.alias("theme"))))).otherwise(F.col("topics")))
    own = own.withColumn("kind", F.lower("c_mktsegment"))
    return matrix.subject_grid(own, "topics", "kind", ["building", "machinery"], tree).drop("label", "level")


@query("""SELECT CASE WHEN a = b THEN '#' || a ELSE '#' || a || '–#' || b END AS segment FROM (SELECT prev + 1 AS a, id - 1 AS b FROM (SELECT id, lag(id) OVER (ORDER BY id) AS prev FROM (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_totalprice > 400000)) WHERE id > prev + 1)""")
def gap_segments(spark, sf):
    gaps = enrich.id_runs(t(spark, sf, "orders").where("o_totalprice > 400000"), "o_custkey")[0]
    return gaps.select(enrich.segment(F.col("first_missing"), F.col("last_missing")).alias("segment"))


@query("SELECT o_custkey, o_orderkey, o_orderpriority AS licence FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def last_lines(spark, sf):
    """Orders written as lines in the order of their dates and read again: of each customer the last line counts."""
    path = scratch_dir(spark)
    rows = t(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("licence"), F.col("o_orderdate").cast("string").alias("day"))
    ndjson.write(rows, path, ["day", "o_orderkey"])
    back = ndjson.read(spark, path, "o_custkey long, o_orderkey long, licence string, day string", at="at")
    return ndjson.last_of_file(back, ["o_custkey"], "at").drop("day")


@query("""SELECT CASE k WHEN 0 THEN 'does not fit' WHEN 1 THEN 'no JSON' ELSE 'unknown fields: more, odd' END AS fault, count(*)::BIGINT AS n FROM (SELECT CASE WHEN c_custkey % 7 = 0 THEN 2 WHEN c_custkey % 5 = 0 THEN 1 WHEN c_custkey % 11 = 0 THEN 0 END AS k FROM customer) WHERE k IS NOT NULL GROUP BY k""")
def refused_lines(spark, sf):
    path, key = scratch_dir(spark), F.col("c_custkey")
    line = F.when(key % 7 == 0, F.concat(F.lit('{"odd": 1, "k": '), key.cast("string"), F.lit(', "more": null}'))).when(key % 5 == 0, F.lit('{"k": ')).when(key % 11 == 0, F.lit('{"k": "many"}')).otherwise(F.concat(F.lit('{"k": '), key.cast("string"), F.lit("}\n")))
    t(spark, sf, "customer").select(line.alias("value")).write.text(path)
    return ndjson.faults(spark, path, "k long, v string").groupBy("fault").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT (SELECT count(*) FROM orders) AS o, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS l, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS p, (SELECT count(DISTINCT o_custkey) FROM orders) AS k)
SELECT v.check_name, v.a || ' <> ' || v.b AS violation_key FROM c, LATERAL (VALUES ('orders', o, l), ('orders again', o, o), ('customers', p, k)) v(check_name, a, b) WHERE v.a <> v.b""")
def model_drift(spark, sf):
    """Counts of three models, taken while each is written, held against each other."""
    o, li, c = (t(spark, sf, n) for n in ("orders", "lineitem", "customer"))
    models = {
        "orders": (o, {"n": F.count(F.lit(1)), "again": F.count_if(F.col("o_orderkey").isNotNull())}),
        "lines": (li.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")), {"n": F.count(F.lit(1))}),
        "customers": (c.join(o.select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("used", F.lit(True)), "c_custkey", "left"), {"n": F.count_if(F.col("c_acctbal") > 0), "used": F.count_if(F.col("used"))}),
    }
    seen = {}
    for name, (df, metrics) in models.items():
        seen[name], watched = checks.observed(df, metrics)
        settle(watched)
    n = {name: s.get for name, s in seen.items()}
    return checks.drift(spark, [("orders", n["orders"]["n"], n["lines"]["n"]), ("orders again", n["orders"]["n"], n["orders"]["again"]), ("customers", n["customers"]["n"], n["customers"]["used"])])
