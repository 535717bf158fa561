"""Queries over posts to the event collector, made of the events table: gates, points and redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.plans.catalog import query, t
from shelfmark.streaming import events

ALLOWED = "https://site.example"
METHOD = "CASE event_id % 11 WHEN 0 THEN 'GET' WHEN 1 THEN 'OPTIONS' WHEN 2 THEN NULL ELSE 'POST' END"
ORIGIN = "CASE event_id % 7 WHEN 0 THEN 'https://elsewhere.example' WHEN 1 THEN NULL WHEN 2 THEN '' ELSE 'https://site.example' END"
COUNT = """CASE event_id % 17 WHEN 0 THEN ',"result_count":null' WHEN 1 THEN ',"result_count":""' WHEN 2 THEN ',"result_count":"  "' WHEN 3 THEN ',"result_count":"12"' WHEN 4 THEN ',"result_count":" 0x1F "'
WHEN 5 THEN ',"result_count":true' WHEN 6 THEN ',"result_count":"twelve"' WHEN 7 THEN ',"result_count":{}' WHEN 8 THEN ',"result_count":[]' WHEN 9 THEN ',"result_count":1.5e2' WHEN 10 THEN ',"result_count":"Infinity"' WHEN 11 THEN ',"result_count":[1,2]'
WHEN 12 THEN ',"result_count":-0.5' WHEN 13 THEN '' ELSE ',"result_count":' || user_id END"""
BODY = f"""CASE event_id % 13 WHEN 0 THEN 'null' WHEN 1 THEN '[1]' WHEN 2 THEN '{{"name": ' WHEN 3 THEN '{{"name":"' || event_type || '","props":{{}}}}' WHEN 4 THEN NULL
WHEN 5 THEN '{{"name":"search","props":{{"search_term":"  Beef   ' || event_type || '"' || {COUNT} || '}}}}' WHEN 6 THEN '{{"name":"search","props":{{"search_term":"' || event_type || '@mail.example"' || {COUNT} || '}}}}'
WHEN 7 THEN '{{"name":"search","props":{{"search_term":"123 4567' || CASE WHEN event_id % 2 = 0 THEN ' k' ELSE ' ö' END || '"' || {COUNT} || '}}}}' WHEN 8 THEN '{{"name":"search","props":{{"search_term":12}}}}' WHEN 9 THEN '{{"name":"search","props":null}}'
WHEN 10 THEN '{{"name":"outbound_click","props":{{"resource_kind":"' || CASE event_id % 3 WHEN 0 THEN 'doi' WHEN 1 THEN 'repo' ELSE 'odd' END || '","link_domain":"' || repeat(event_type || '.', 60) || '","link_url":7}}}}'
WHEN 11 THEN '{{"name":"outbound_click"}}' ELSE '{{"name":7,"props":{{}}}}' END"""

POSTS = f"posts AS (SELECT event_id, user_id, ts, {METHOD} AS method, {ORIGIN} AS origin, {BODY} AS body FROM events)"
CHARGED = f"""{POSTS}, charged AS (SELECT *, CASE WHEN method = 'POST' THEN row_number() OVER (PARTITION BY user_id, method, time_bucket(INTERVAL 6 HOUR, ts) ORDER BY ts, event_id) > 2 ELSE false END AS refused FROM posts),
d AS (SELECT *, CASE WHEN json_valid(body) THEN json_type(body) END AS type FROM charged),
disposed AS (SELECT *, CASE WHEN method = 'OPTIONS' THEN 204 WHEN method IS NULL OR method <> 'POST' THEN 405 WHEN refused THEN 429 WHEN origin <> '' AND origin <> '{ALLOWED}' THEN 403 WHEN type IS NULL OR type <> 'OBJECT' THEN 400 ELSE 204 END AS disposition FROM d)"""


def posts(spark, sf):
    e = t(spark, sf, "events")
    return e.select("event_id", "user_id", "ts", F.expr(METHOD).alias("method"), F.expr(ORIGIN).alias("origin"), F.expr(BODY).alias("body"))


def charged(spark, sf):
    return events.disposed(events.limited_posts(posts(spark, sf), "user_id", cap=2, window="6 hours"), ALLOWED, "refused")


@query(f"WITH {CHARGED} SELECT event_id, disposition FROM disposed")
def event_disposition(spark, sf):
    return charged(spark, sf).select("event_id", "disposition")


@query(f"WITH {CHARGED} SELECT disposition, method, count(*)::BIGINT AS n FROM disposed GROUP BY ALL")
def gated_events(spark, sf):
    return charged(spark, sf).groupBy("disposition", "method").agg(F.count("*").alias("n"))


@query(f"""WITH {CHARGED}, p AS (SELECT event_id, json_extract_string(body, '$.name') AS name, CASE WHEN json_type(body, '$.props.search_term') = 'VARCHAR' THEN json_extract_string(body, '$.props.search_term') END AS term,
  json_type(body, '$.props.result_count') AS ct, trim(json_extract_string(body, '$.props.result_count')) AS c, json_extract_string(body, '$.props.resource_kind') AS kind, json_extract_string(body, '$.props.link_domain') AS domain
  FROM disposed WHERE disposition = 204 AND method = 'POST' AND type = 'OBJECT'),
s AS (SELECT *, lower(trim(regexp_replace(term, '\\s+', ' ', 'g'))) AS x FROM p),
k AS (SELECT *, CASE WHEN length(x) BETWEEN 2 AND 80 AND NOT contains(x, '@') AND NOT (NOT regexp_matches(x, '[a-z]') AND length(regexp_replace(x, '[^0-9]', '', 'g')) >= 7) THEN x END AS kept FROM s)
SELECT event_id, name AS index, array_to_string([name, kept], '|') AS blobs, CASE WHEN ct IS NULL THEN -1.0 WHEN ct = 'NULL' OR (ct = 'VARCHAR' AND c = '') OR c = '[]' THEN 0 WHEN ct = 'BOOLEAN' THEN (c = 'true')::INT
  WHEN c = '0x1F' THEN 31 WHEN ct IN ('OBJECT', 'ARRAY') OR c = 'Infinity' THEN -1 ELSE coalesce(try_cast(c AS DOUBLE), -1) END::DOUBLE AS number FROM k WHERE name = 'search' AND kept IS NOT NULL
UNION ALL SELECT event_id, name, array_to_string([name, CASE WHEN kind IN ('doi', 'repo') THEN kind ELSE 'external' END, left(coalesce(domain, ''), 253), ''], '|'), 1.0 FROM k WHERE name = 'outbound_click'""")
def collected_points(spark, sf):
    passed = charged(spark, sf).where("disposition = 204 AND method = 'POST'")
    return events.points(passed).select("event_id", "index", F.concat_ws("|", "blobs").alias("blobs"), "number")
