"""Queries that write Markdown documents again from rows and compare whole texts; joins and choices with assertions in the plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import asserts
from shelfmark.plans.catalog import query, t
from shelfmark.plans.scans import BLOCKS, pages
from shelfmark.session import parts_of, settle
from shelfmark.sources import catalogue, rewrite

REFS = """CASE WHEN c_custkey % 10 = 0 THEN '## Part ' || c_custkey || chr(10) || chr(10) ELSE '' END || CASE WHEN c_custkey % 10 IN (0, 4, 7) THEN 'Text ' || c_custkey || chr(10) || 'goes on.' || chr(10) || chr(10) ELSE '' END
|| CASE WHEN c_custkey % 3 <> 0 THEN '<a id="' || c_custkey || '">' || c_custkey || '</a> Old.' || chr(10) || chr(10) || CASE WHEN c_custkey % 2 = 0 THEN '> **Code**: u' || chr(10) || chr(10) || '> more' || chr(10) || chr(10) ELSE '' END ELSE '' END"""
#: Rows of customers, a third of them new and a third of the old ones gone; some in a section that no page has.
OWN = """SELECT c_custkey // 100 AS page, CASE WHEN c_custkey % 29 = 0 THEN 'Gone' ELSE 'Part ' || (c_custkey // 10 * 10) END AS section, c_custkey AS n, '<a id="' || c_custkey || '">' || c_custkey || '</a> ' || c_name AS raw, CASE WHEN c_custkey % 4 = 0 THEN '> **Data**: v' END AS quotes FROM customer WHERE c_custkey % 3 <> 1"""
HEAD = "# All\n\n```\n## no part\n<a id=\"1\">1</a>\n```\n\n"


def reference_rows(spark, sf):
    return spark.sql(OWN.replace("c_custkey // 100", "c_custkey DIV 100").replace("c_custkey // 10 * 10", "c_custkey DIV 10 * 10").replace("FROM customer", "FROM {c}"), c=t(spark, sf, "customer")).withColumnRenamed("n", "ordinal")


def reference_docs(spark, sf):
    return pages(t(spark, sf, "customer"), "c_custkey", F.expr(REFS), HEAD)


@query(f"""WITH own AS ({OWN}), s AS (SELECT *, c_custkey // 100 AS page, c_custkey // 10 * 10 AS part FROM customer), spots AS (SELECT page, part, min(c_custkey) AS c FROM s WHERE c_custkey % 3 <> 0 GROUP BY 1, 2),
pieces AS (SELECT page, -2 AS a, 0 AS b, 0 AS k, '# All' AS raw FROM s UNION SELECT page, -1, 0, 0, '```' || chr(10) || '## no part' || chr(10) || '<a id="1">1</a>' || chr(10) || '```' FROM s UNION ALL SELECT page, c_custkey, 0, 0, '## Part ' || c_custkey FROM s WHERE c_custkey % 10 = 0
UNION ALL SELECT page, c_custkey, 1, 0, 'Text ' || c_custkey || chr(10) || 'goes on.' FROM s WHERE c_custkey % 10 IN (0, 4, 7) UNION ALL SELECT o.page, x.c, 2, o.n, concat_ws(chr(10) || chr(10), o.raw, o.quotes) FROM own o JOIN spots x ON o.page = x.page AND o.section = 'Part ' || x.part
  WHERE EXISTS (SELECT 1 FROM s WHERE c_custkey = x.part))
SELECT page, string_agg(raw, chr(10) || chr(10) ORDER BY a, b, k) || chr(10) AS text FROM pieces GROUP BY 1""")
def rewritten_references(spark, sf):
    return rewrite.references(reference_docs(spark, sf), "page", "text", reference_rows(spark, sf))[0]


@query(f"""WITH own AS ({OWN}), s AS (SELECT DISTINCT c_custkey // 100 AS page, 'Part ' || (c_custkey // 10 * 10) AS section FROM customer WHERE c_custkey % 3 <> 0 AND (c_custkey // 10 * 10) IN (SELECT c_custkey FROM customer))
SELECT 'no anchor' AS check_name, page || ':' || section || ':' || n AS violation_key FROM own WHERE (page, section) NOT IN (SELECT page, section FROM s)""")
def unplaced_references(spark, sf):
    return rewrite.references(reference_docs(spark, sf), "page", "text", reference_rows(spark, sf))[1]


@query("""WITH a AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey > 9)
SELECT 'same' AS trip, 0::BIGINT AS lost, 0::BIGINT AS made UNION ALL SELECT 'damaged', count(*) FILTER (id % 11 = 0 OR id % 17 = 0)::BIGINT, count(*) FILTER (id % 11 = 0 AND id % 17 <> 0)::BIGINT FROM a""")
def reference_round_trips(spark, sf):
    """What is read is written and read again: as it is, and with words cut in every eleventh row and every seventeenth row dropped."""
    # What is written is settled and dealt again by the number of blocks before it is read: a reading holds lines and windows over them, many for each byte of the documents, and should meet no other in its task.
    n = parts_of(t(spark, sf, "customer"), BLOCKS)
    dealt = lambda d: settle(d).repartition(n, "page")
    docs = dealt(reference_docs(spark, sf))
    read = lambda d: catalogue.anchored(d, "page", "text").where("section IS NOT NULL").select("page", "section", F.col("id").alias("ordinal"), "raw", "quotes")
    rows = dealt(read(docs))
    cut = rows.where("ordinal % 17 <> 0").withColumn("raw", F.when(F.col("ordinal") % 11 == 0, F.replace("raw", F.lit(" Old."))).otherwise(F.col("raw")))

    def trip(name, given):
        again = rewrite.round_trip(rows, dealt(read(dealt(rewrite.references(docs, "page", "text", given)[0]))), "references")
        sign = F.left("violation_key", F.lit(1))
        return again.agg(F.count_if(sign == "-").alias("lost"), F.count_if(sign == "+").alias("made")).select(F.lit(name).alias("trip"), "lost", "made")

    return trip("same", rows).unionByName(trip("damaged", cut))


ENTRIES = """CASE WHEN p_partkey % 20 = 0 THEN '## Group ' || p_partkey || chr(10) || chr(10) || 'Intro ' || p_partkey || chr(10) || chr(10) || '### no link' || chr(10) || chr(10) ELSE '' END || '### [N' || p_partkey || '](u)' || chr(10) || 'Old.' || chr(10) || chr(10)
|| CASE WHEN p_partkey % 6 = 0 THEN '#### More' || chr(10) || 'inner' || chr(10) || chr(10) ELSE '' END"""
KEPT = """SELECT p_partkey // 100 AS page, CASE WHEN p_partkey % 50 = 1 THEN 'New ' || (p_partkey % 100) ELSE 'Group ' || (p_partkey // 20 * 20) END AS grp, p_partkey AS n, '[' || p_name || '](v)' AS heading_md, CASE WHEN p_partkey % 5 > 0 THEN 'Body of ' || p_brand ELSE '' END AS body_md FROM part WHERE p_partkey % 4 > 0 AND p_partkey > 19"""


@query(f"""WITH s AS (SELECT *, p_partkey // 100 AS page FROM part WHERE p_partkey > 19), own AS (SELECT * FROM ({KEPT}) WHERE page IN (SELECT page FROM s)), e AS (SELECT *, '### ' || heading_md || CASE WHEN body_md <> '' THEN chr(10) || chr(10) || body_md ELSE '' END AS raw FROM own),
firsts AS (SELECT page, grp, min(n) AS f FROM own WHERE grp LIKE 'New%' GROUP BY 1, 2),
pieces AS (SELECT DISTINCT page, -1 AS a, 0 AS b, 0 AS k, 'Lead.' AS raw FROM s UNION ALL SELECT page, p_partkey, 0, 0, '## Group ' || p_partkey || chr(10) || chr(10) || 'Intro ' || p_partkey || chr(10) || chr(10) || '### no link' FROM s WHERE p_partkey % 20 = 0
UNION ALL SELECT page, replace(grp, 'Group ', '')::INT, 1, n, raw FROM e WHERE grp LIKE 'Group%' UNION ALL SELECT page, 1000000000, f, -1, '## ' || grp FROM firsts UNION ALL SELECT e.page, 1000000000, f, n, raw FROM e JOIN firsts USING (page, grp))
SELECT page, string_agg(raw, chr(10) || chr(10) ORDER BY a, b, k) || chr(10) AS text FROM pieces GROUP BY 1""")
def rewritten_entries(spark, sf):
    part = t(spark, sf, "part")
    docs = pages(part.where("p_partkey > 19"), "p_partkey", F.expr(ENTRIES), "Lead.\n\n")
    rows = spark.sql(KEPT.replace("p_partkey // 100", "p_partkey DIV 100").replace("p_partkey // 20 * 20", "p_partkey DIV 20 * 20").replace("FROM part", "FROM {p}"), p=part).withColumnRenamed("n", "ordinal")
    return rewrite.entries(docs, "page", "text", rows)[0]


@query("""WITH s AS (SELECT *, c_custkey // 100 AS page FROM customer), e AS (SELECT page, string_agg('### [' || c_name || '](w)' || CASE WHEN c_custkey % 50 = 0 THEN '' ELSE chr(10) || chr(10) || 'New body.' END, chr(10) || chr(10) ORDER BY c_custkey) AS curated FROM s WHERE c_custkey % 25 = 0 GROUP BY 1),
r AS (SELECT page, string_agg(chr(10) || '| ' || c_name || ' | ' || c_nationkey || ' |', '' ORDER BY c_custkey) AS lines FROM s WHERE c_custkey % 3 > 0 GROUP BY 1)
SELECT s.page, CASE WHEN s.page % 4 = 3 THEN NULL ELSE replace(replace('# P~Prose.~## Entries~' || coalesce(curated || '~', '') || '## Complete data inventory~Lead.~| Name | N |^|---|---|' || coalesce(lines, '') || '~| second | table |^|--|--|~## Further reading~End.^', '~', chr(10) || chr(10)), '^', chr(10)) END AS text
FROM (SELECT DISTINCT page FROM s) s LEFT JOIN e ON e.page = s.page LEFT JOIN r ON r.page = s.page""")
def rewritten_pages(spark, sf):
    """Pages of customers; every fourth page has an entry too many and is shown as null."""
    s = t(spark, sf, "customer")
    entry = F.when(F.col("c_custkey") % 25 == 0, F.lit("### [Old](w)\n\nOld body.\n\n#### Deeper\n\nmore\n\n"))
    body = pages(s, "c_custkey", F.coalesce(entry, F.lit("")))
    extra = F.when(F.col("page") % 4 == 3, "### [One](too many)\n\n").otherwise("")
    tail = "\n\n## Complete data inventory\n\nLead.\n\n| Name | N |\n|:--|--|\n| old | 1 |\n\n| second | table |\n|--|--|\n\n## Further reading\n\nEnd.\n"
    docs = body.select("page", F.concat(F.lit("# P\n\nProse.\n\n## Entries\n\n"), extra, F.trim("text", F.lit("\n")), F.lit(tail)).alias("text"))
    rows = s.where("c_custkey % 3 > 0").select(F.floor(F.col("c_custkey") / 100).alias("page"), F.col("c_custkey").alias("ordinal"), F.array(F.col("c_name"), F.col("c_nationkey").cast("string")).alias("cells"))
    curated = s.where("c_custkey % 25 = 0").select(F.floor(F.col("c_custkey") / 100).alias("page"), F.col("c_custkey").alias("ordinal"), F.concat(F.lit("["), "c_name", F.lit("](w)")).alias("heading_md"), F.when(F.col("c_custkey") % 50 > 0, "New body.").alias("body_md"))
    text, bad = rewrite.dataset_pages(docs, "page", "text", "Complete data inventory", rows, curated)
    unlike = bad.where("check_name = 'entries and rows unlike'").select(F.col("violation_key").cast("long").alias("page"), F.lit(True).alias("bad"))
    return text.join(unlike, "page", "left").select("page", F.when(F.col("bad").isNull(), F.col("text")).alias("text"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS k FROM lineitem), b AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_extendedprice) - 1 AS k FROM lineitem)
SELECT a.l_orderkey, a.k::INT AS position, l_linenumber, l_partkey FROM a JOIN b ON a.l_orderkey = b.l_orderkey AND a.k = b.k""")
def asserted_positions(spark, sf):
    li = t(spark, sf, "lineitem")
    numbered = li.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p"), F.col("l_extendedprice").alias("e"))
    shipped = li.select("l_orderkey", "l_partkey", "l_shipdate", "l_extendedprice")
    return asserts.positional(numbered, shipped, "l_orderkey", ["l_linenumber", "p", "e"], ["l_shipdate", "l_partkey", "l_extendedprice"]).select("l_orderkey", "position", "l_linenumber", "l_partkey")


@query("SELECT conv_id, role, text FROM conversations WHERE turn = 0")
def exactly_one_opening(spark, sf):
    return asserts.exactly_one(t(spark, sf, "conversations"), "conv_id", F.col("turn") == 0).select("conv_id", "role", "text")
