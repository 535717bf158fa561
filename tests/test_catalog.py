"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from shelfmark.plans import audits, catalog, collected, curation, models, records, rewritten, scans, strings  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_same_rows_as_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted(repr(tuple(r)) for r in df.select(*cols).collect())
    rel = duck.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    theirs = sorted(repr(r) for r in rel.select(", ".join(f'"{c}"' for c in cols)).fetchall())
    assert ours == theirs
