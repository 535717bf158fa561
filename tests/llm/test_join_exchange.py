"""The exchange of signatures in two steps: the same content, and rows that grow with the text."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import ngram_join

from test_join_rows import brute, key, planted


def frame_of(spark, n):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice([f"w{k}" for k in range(400)], 40).tolist())) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4, "doc_id")


def entries(df):
    """(partition, key, size, need, signature) of all rows, sorted."""
    out = []
    for r in df.collect():
        keys, sizes, needs, counts, sigs = (np.frombuffer(r[c], dtype=t) for c, t in (("keys", "<i8"), ("sizes", "<i4"), ("needs", "<u1"), ("counts", "<i4"), ("sigs", "<u4")))
        assert counts.sum() == len(sigs) and len(keys) == len(sizes) == len(needs) == len(counts)
        out += zip([r["p"]] * len(sigs), np.repeat(keys, counts).tolist(), np.repeat(sizes, counts).tolist(), np.repeat(needs, counts).tolist(), sigs.tolist(), strict=True)
    return sorted(out)


def sent(spark, docs, parts):
    sketch, short = ngram_join.merged_counters(ngram_join.survey(docs.withColumns({"t1": F.lit(0).cast("long"), "t2": F.lit(0).cast("long")})))
    return ngram_join.packed(docs, sketch, short, parts)


@pytest.mark.parametrize(("fan", "bytes_at_once"), [(3, 2_000), (4, 1 << 30), (1, 50)])
def test_two_steps_carry_the_same_signatures(spark, monkeypatch, fan, bytes_at_once):
    docs = frame_of(spark, 120)
    monkeypatch.setattr(ngram_join, "AT_ONCE", 2_000)
    direct = entries(sent(spark, docs, 16))
    monkeypatch.setattr(ngram_join, "FAN", fan)
    monkeypatch.setattr(ngram_join, "RELAY", bytes_at_once)
    assert entries(sent(spark, docs, 16)) == direct and len(direct) > 1000


def test_rows_grow_with_the_text(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "AT_ONCE", 4_000)
    monkeypatch.setattr(ngram_join, "RELAY", 60_000)
    monkeypatch.setattr(ngram_join, "FAN", 16)
    steps = []
    dealt_on = ngram_join.relayed

    def seen(df, tasks):
        steps.append((df, tasks))
        return dealt_on(df, tasks)

    monkeypatch.setattr(ngram_join, "relayed", seen)
    rows = []
    for n in (200, 400, 800):  # partitions grow with the documents
        docs = frame_of(spark, n)
        last = sent(spark, docs, n // 4).count()
        first, tasks = steps[-1]
        size = first.agg(F.sum(sum(F.octet_length(c) for c in ("places", "keys", "sizes", "needs", "counts", "sigs")))).first()[0]
        rows.append((first.count(), last))
        # A filled buffer, or a task's last one, goes to the partitions of a few coarse ones.
        assert last <= 4 * max(ngram_join.RELAYED, n // 4 / 16) * (size / 60_000 + tasks)
    for few, many in zip(rows[:-1], rows[1:], strict=True):
        assert many[0] <= 2.2 * few[0]
    # In one step they would grow with the square.
    monkeypatch.setattr(ngram_join, "FAN", 1 << 20)
    one = [sent(spark, frame_of(spark, n), n // 4).count() for n in (200, 800)]
    assert one[1] > 10 * one[0] and sum(rows[-1]) < one[1] / 4


def test_classes_by_two_steps(spark, monkeypatch):
    rows = planted()
    monkeypatch.setattr(ngram_join, "FAN", 2)
    monkeypatch.setattr(ngram_join, "RELAY", 500)
    monkeypatch.setattr(ngram_join, "PART", 200)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=key) == sorted(brute(rows)[0], key=key)
