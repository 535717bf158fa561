"""Messages of the suffix tree in two steps: the same scores as in one, and rows that grow less than blocks times parts."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from shelfmark.llm import suffix_tree_lm as lm


def test_two_steps_give_the_scores_of_one(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefg", k=rng.randint(1, 6))) for _ in range(200)]
    texts = [" ".join(rng.choices(vocabulary[: rng.choice([5, 40, 200])], k=rng.randint(0, 60))) for _ in range(400)] + ["", None, "a " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    monkeypatch.setattr(lm, "BLOCK", 2_000)
    monkeypatch.setattr(lm, "PART", 1_500)
    one = lm.score(docs, F.col("doc_id") % 4 != 0).collect()
    two = lm.score(docs, F.col("doc_id") % 4 != 0, fan=0).collect()
    # Base sums and counts are the same; the order of a block's words may change the last digit of a sum.
    assert len(one) == len(texts)
    for a, b in zip(sorted(one), sorted(two), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-12)


@pytest.mark.parametrize("n", [60, 240, 960])
def test_rows_grow_with_the_root(n):
    """``n`` blocks that each have a message for each of ``n`` parts: every message arrives, and comes back, in about n times the root of n rows a step."""
    route, bound = lm.Route.between(n, n), 3 * n * (math.isqrt(n) + 1)
    sent = pa.concat_tables([route.rows(np.full(n, b), np.arange(n), pa.array([f"{b}-{p}".encode() for p in range(n)]), True) for b in range(n)])
    assert len(sent) <= bound

    def turn(rows, by_block):
        batch, c = rows["batch"].to_numpy(), rows["c"].to_numpy()
        key = batch * n + c
        order = np.argsort(key, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(key[order])) + 1)
        rows = rows.combine_chunks()
        assert max(sum(len(x) for x in rows.take(pa.array(g))["keys"].to_pylist()) for g in groups[:5]) <= 8 * n
        return pa.concat_tables([route.turned(rows.take(pa.array(g)), by_block) for g in groups])

    parts = turn(sent, True)
    assert len(parts) <= bound
    p, block, bodies = lm.opened(parts)
    assert sorted(zip(p.tolist(), block.tolist(), bodies.to_pylist(), strict=True)) == [(j, b, f"{b}-{j}".encode()) for j in range(n) for b in range(n)]
    out = pa.concat_tables([route.rows(np.full(n, j), np.arange(n), pa.array([f"{j}:{b}".encode() for b in range(n)]), False) for j in range(n)])
    assert len(out) <= bound
    back = turn(out, False)
    assert len(back) <= bound
    block, p, bodies = lm.opened(back)
    assert sorted(zip(block.tolist(), p.tolist(), bodies.to_pylist(), strict=True)) == [(b, j, f"{j}:{b}".encode()) for b in range(n) for j in range(n)]
