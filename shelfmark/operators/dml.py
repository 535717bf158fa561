"""Changes of tables as new tables; the caller writes them and swaps folders, so that a failure leaves the old ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_per_key(rows: DataFrame, key: str) -> DataFrame:
    """Of several rows of one key the smallest, by all columns in their order: the same one in every run."""
    return rows.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*rows.columns)).alias("_row")).select("_row.*")


def insert_ignore(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows with a new key are added; of several new rows of one key the smallest stays."""
    return table.unionByName(one_per_key(rows, key).join(table.select(key), key, "left_anti").select(table.columns))


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Non-null values of ``rows`` replace those of the same key; other rows are added. Of several rows of one key the smallest counts."""
    rest, rows = [c for c in table.columns if c != key], one_per_key(rows, key)
    new = rows.select(key, *[F.col(c).alias(f"_{c}") for c in rest])
    updated = table.join(new, key, "left").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in rest])
    return updated.unionByName(rows.join(table.select(key), key, "left_anti").select(table.columns))


def changed(table: DataFrame, rows: DataFrame, key: str) -> int:
    """How many rows of ``table`` an update by ``rows`` meets."""
    return table.join(rows.select(key).distinct(), key, "left_semi").count()


def cleared(table: DataFrame, columns: list[str], values: DataFrame, key: str) -> DataFrame:
    """The columns are set to null and then filled from ``values`` alone: doing it twice changes nothing."""
    types = dict(table.dtypes)
    bare = table.withColumns({c: F.lit(None).cast(types[c]) for c in columns})
    return upsert(bare, values.join(table.select(key), key, "left_semi").select(key, *columns, *[F.lit(None).cast(types[c]).alias(c) for c in table.columns if c not in (key, *columns)]), key).select(table.columns)


def remove_with_tombstones(tables: dict[str, DataFrame], keys: DataFrame, references: dict[str, str], tombstones: DataFrame) -> dict[str, DataFrame]:
    """``remove``, and the keys that are gone added to ``tombstones`` once."""
    k = tombstones.columns[0]
    gone = tombstones.unionByName(keys.toDF(k)).distinct()
    return remove(tables, keys, references) | {"tombstones": gone}


def checked(tables: dict[str, DataFrame], change, checks) -> dict[str, DataFrame]:
    """The changed tables if no check finds a violation in them, else an error that names the first ones; nothing is written here, so the old tables stand.

    ``change`` takes and returns tables; ``checks`` takes tables and returns a frame of violations.
    """
    new = change(tables)
    bad = checks(new).limit(5).collect()
    if bad:
        raise ValueError("refused: " + "; ".join(f"{r['check_name']} {r['violation_key']}" for r in bad))
    return new


def remove(tables: dict[str, DataFrame], keys: DataFrame, references: dict[str, str]) -> dict[str, DataFrame]:
    """Every table without the rows that refer to one of the keys."""
    k = keys.columns[0]
    out = dict(tables)
    for name, c in references.items():
        out[name] = tables[name].join(keys.select(F.col(k).alias(c)).distinct(), c, "left_anti")
    return out


def replace_sets(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys with rows in ``new`` have just those; the others keep theirs."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(old.columns).unionByName(new.select(old.columns))
