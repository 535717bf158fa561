"""Queries read whole texts and tables: what stands late in a text or is rare in a table counts, against plain Python."""

import re
from collections import defaultdict

import pytest

from shelfmark.plans import catalog, curation, records  # noqa: F401

Q = catalog.queries()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    texts = ["A title\nunder the MIT License\nEnd", "x" * 70 + " Last Word\n- two --", "no licence here", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    orders = [(k, k % 4 + 1, 10.0 * k) for k in (1, 2, 3, 4, 10, 11, 17, 18, 70_000, 140_001)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 9)], "c_custkey long").write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame([(1, "http://a.org/x"), (3, "http://a.org/y"), (5, "http://b.org/"), (6, None)], "page_id long, url string").write.parquet(f"{d}/pages.parquet")
    return d, texts, orders


def rows(spark, sf, name):
    return [tuple(r) for r in Q[name](spark, sf[0]).collect()]


def test_texts(spark, sf):
    got = {r[0]: r[1] for r in rows(spark, sf, "slugs")}
    slug = lambda x: re.sub("^-|-$", "", re.sub("-+", "-", re.sub("[^a-z0-9-]", "", re.sub(r"\s+", "-", x.lower()))))
    assert got == {i: slug(x) for i, x in enumerate(sf[1])} and got[1].endswith("last-word-two")
    assert dict(rows(spark, sf, "tier_histogram")) == {"permissive": 1, "unknown": 3}


def test_tables(spark, sf):
    ids = sorted(k for k, _, _ in sf[2])
    gaps = [(a + 1, b - 1) for a, b in zip(ids, ids[1:], strict=False) if b > a + 1]
    assert sorted(rows(spark, sf, "id_gaps")) == gaps
    starts = [i for i in ids if i - 1 not in ids]
    assert sorted(rows(spark, sf, "id_runs")) == [(a, next(i for i in ids if i >= a and i + 1 not in ids)) for a in starts]
    assert dict(rows(spark, sf, "resolved_links")) == {1: "1", 3: "1", 5: "5", 6: "outside"}
    groups = defaultdict(set)
    for k, c, _ in sf[2]:
        groups[c] |= {c, -1 - k}
    assert dict(rows(spark, sf, "components")) == {i: min(g) for g in groups.values() for i in g}
    n = sum(map(len, groups.values()))
    (stats,) = Q["graph_stats"](spark, sf[0]).collect()
    assert stats.asDict() == {"n_nodes": n + 1, "n_edges": len(ids), "n_connected": n, "n_isolated": 1, "largest_component": max(map(len, groups.values()))}
