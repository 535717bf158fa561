"""URL filters: block decisions follow redirects and canonical links.

A page and the addresses that it names as itself (``<link rel=canonical>``, ``og:url``, a meta refresh), or that a
table of redirects gives, are one resource; so are addresses that differ in their fragment only, which no server sees. Connected components
over these links carry a block to every alias. An address that a rule allows stays allowed, wherever its component leads. Built-in functions only;
components are found in rounds that are settled in the shared folder.

Defined cases: a null url, or one without ``://``, has an empty host and path and no aliases, and is allowed unless a rule fits; a null html has no
links; relative links are resolved against the page's scheme and host if they start with ``/`` and ignored otherwise; repeated rows
stay repeated; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.graph import connected_components
from shelfmark.session import settle

from ._shared import table

#: (verdict, host, path): fixed values of the query's rules.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Tags that name a page's own address, and where the address stands in them.
LINK_TAGS = r"(?is)<(?:link\b[^>]*\brel\s*=\s*[\"']?canonical\b|meta\b[^>]*\bproperty\s*=\s*[\"']?og:url\b|meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*>"
LINK_HREF = r"(?is)\b(?:href\s*=\s*[\"']?|content\s*=\s*[\"']?(?:\s*[\d.]+\s*;\s*url\s*=\s*[\"']?)?)([^\"'\s>]+)"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest fitting rule, else null. An allow goes before a block of equal length."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def named_addresses(url: Column, html: Column) -> Column:
    """Addresses that a page names as its own, absolute and without fragment."""
    base = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    tags = F.when(html.rlike(r"(?i)canonical|og:url|refresh"), F.regexp_extract_all(html, F.lit(LINK_TAGS), F.lit(0)))
    found = F.transform(tags, lambda t: F.regexp_extract(t, LINK_HREF, 1))
    full = F.transform(found, lambda x: F.when(F.startswith(x, F.lit("/")) & ~F.startswith(x, F.lit("//")), F.concat(base, x)).otherwise(x))
    return F.transform(F.filter(full, lambda x: F.contains(x, F.lit("://"))), lambda x: F.substring_index(x, "#", 1))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, host, path, rule, verdict, component`` for every page; component is null for a page without aliases.

    ``redirects(src, dst)`` adds links between addresses. The verdict is the longest rule's; without one it is block if a rule blocks any address of the
    page's component, else allow.
    """
    p = pages.select(F.col(page).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    resource = F.when(F.contains("url", F.lit("://")), F.substring_index("url", "#", 1))
    links = p.select(resource.alias("src"), F.explode(named_addresses(F.col("url"), F.col("html"))).alias("dst"))
    if redirects is not None:
        links = links.unionByName(redirects.select(F.substring_index("src", "#", 1).alias("src"), F.substring_index("dst", "#", 1).alias("dst")))
    comp = connected_components(links)
    blocked = comp.where(longest_rule(host_of(F.col("id")), path_of(F.col("id")), rules)["verdict"] == "block").select("component").distinct()
    # Both are keyed by the addresses that have links, not by pages.
    fate = settle(comp.join(blocked.withColumn("hit", F.lit(True)), "component", "left"))
    own = p.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), resource.alias("resource"))
    own = own.withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules))
    out = own.join(fate, own["resource"] == fate["id"], "left")
    verdict = F.coalesce("fit.verdict", F.when(F.col("hit"), F.lit("block")), F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "component")


def op9_url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).drop("component")


def _rule_sql(host: str, path: str, rules: Sequence[tuple[str, str, str]], what: int) -> str:
    """The longest fitting rule's verdict (0) or name (1); rules are tried from the longest on."""
    cases = [f"WHEN ({host} = '{h}' OR {host} LIKE '%.{h}') AND starts_with({path}, '{p}') THEN '{(v, h + p)[what]}'" for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0]))]
    return f"CASE {' '.join(cases)} END"


_HOST = "coalesce(translate(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH = "coalesce(regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
_QUOTED = lambda pattern: pattern.replace("'", "''")

#: Aliases by a recursion over all links in both directions.
ORACLE = rf"""
WITH RECURSIVE p AS (SELECT page_id, url, coalesce(html, '') AS html, CASE WHEN contains(url, '://') THEN string_split(url, '#')[1] END AS res, {_HOST.format("url")} AS host, {_PATH.format("url")} AS path FROM pages),
tags AS (SELECT res, url, unnest(regexp_extract_all(html, '{_QUOTED(LINK_TAGS)}')) AS tag FROM p),
named AS (SELECT res, CASE WHEN starts_with(a, '/') AND NOT starts_with(a, '//') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || a ELSE a END AS a FROM (SELECT res, url, regexp_extract(tag, '{_QUOTED(LINK_HREF)}', 1) AS a FROM tags)),
e AS (SELECT res AS a, string_split(a, '#')[1] AS b FROM named WHERE contains(a, '://') AND res IS NOT NULL),
both_ AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach(a, b) AS (SELECT a, b FROM both_ UNION SELECT r.a, t.b FROM reach r JOIN both_ t ON t.a = r.b),
hit AS (SELECT DISTINCT a FROM reach WHERE {_rule_sql(_HOST.format("b"), _PATH.format("b"), RULES, 0)} = 'block')
SELECT page_id, host, path, {_rule_sql("host", "path", RULES, 1)} AS rule, coalesce({_rule_sql("host", "path", RULES, 0)}, CASE WHEN hit.a IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN hit ON hit.a = p.res
"""
