"""The tree against one that is built from plain counters, however the table is cut."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import suffix_tree_lm as lm


def tokens(x):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or "")), None]


def brute(texts, train, depth, min_count, min_divergence):
    """(tokens, known, base, score) of every text."""
    own = [tokens(x) for x in texts]
    after = defaultdict(Counter)
    for t, use in zip(own, train, strict=True):
        for i, w in enumerate(t if use else ()):
            for k in range(min(i, depth) + 1):
                after[tuple(t[i - k : i])][w] += 1
    total, known = after[()].total(), len(after[()])
    states = {}
    for c, n in after.items():
        if c and n.total() >= min_count:
            shorter, m = after[c[1:]], n.total()
            d = sum(x / m * math.log((x / m) / (shorter[w] / shorter.total())) for w, x in n.items())
            if d >= min_divergence and d * m >= len(n) * math.log(m) / 2:
                states[c] = n
    out = []
    for t in own:
        base = model = 0.0
        for i, w in enumerate(t):
            p = (after[()][w] + 0.1) / (total + 0.1 * (known + 1))
            base += math.log10(p)
            for k in range(1, min(i, depth) + 1):
                n = states.get(tuple(t[i - k : i]))
                if n:
                    p = (n[w] + len(n) * p) / (n.total() + len(n))
            model += math.log10(p)
        out.append((len(t), sum(after[()][w] > 0 for w in t), base, model))
    return out, total, len(states)


def corpus():
    rng = np.random.default_rng(4)
    words = np.array([f"w{i}" for i in range(60)])
    share = 1 / np.arange(1, 61)
    texts = [" ".join(rng.choice(words, int(n), p=share / share.sum())) for n in rng.integers(0, 60, 150)]
    for i in range(0, 60, 3):
        texts[i] += " the quick brown fox jumps over the lazy dog again and again"
    return [*texts, None, "", " \t\n", texts[3], texts[3], "THE Quick brown fox\u0085x é", "w0 " * 3000]


@pytest.mark.parametrize(("depth", "min_count", "parts", "block"), [(3, 2, 1, 6_000_000), (3, 2, 8, 700), (3, 2, 64, 3000), (1, 5, 4, 3000), (5, 2, 8, 3000)])
def test_scores_against_plain_counters(spark, monkeypatch, depth, min_count, parts, block):
    texts = corpus()
    train = [i % 4 != 1 for i in range(len(texts))]
    monkeypatch.setattr(lm, "BLOCK", block)
    rows = [(i if i != 5 else None, x, t, "clash", "clash") for i, (x, t) in enumerate(zip(texts, train, strict=True))]
    frame = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "doc_id long, text string, train boolean, block string, _train string")
    got = {r["doc_id"]: r for r in lm.score(frame, "train", depth=depth, min_count=min_count).collect()}
    want, total, states = brute(texts, train, depth, min_count, lm.MIN_DIVERGENCE)
    assert states > 20 and len(got) == len(texts)
    for i, (n, known, base, model) in enumerate(want):
        r = got[i if i != 5 else None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, not train[i])
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], model, rel_tol=1e-9), i


def test_heavy_contexts_are_dealt_over_parts(spark, monkeypatch):
    """With small parts a frequent word's successors meet in several of them, and nothing changes."""
    texts = corpus()
    train = [True] * len(texts)
    monkeypatch.setattr(lm, "PART", 300)
    rows = list(zip(range(len(texts)), texts, train, strict=True))
    frame = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    seen = []
    monkeypatch.setattr(lm.Rule, "states", lambda self, t, n, a, x, f=lm.Rule.states: seen.append(len(t)) or f(self, t, n, a, x))
    got = {r["doc_id"]: r["score"] for r in lm.score(frame, "train").collect()}
    assert seen[0] > 0  # on the driver: contexts that are dealt
    assert all(math.isclose(got[i], w[3], rel_tol=1e-9) for i, w in enumerate(brute(texts, train, lm.DEPTH, lm.MIN_COUNT, lm.MIN_DIVERGENCE)[0]))


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([(1, "a b", None), (None, None, None)], "doc_id long, text string, train boolean")
    got = {r["doc_id"]: r for r in lm.score(frame, "train").collect()}
    assert got[1]["score"] == got[1]["base_score"] and got[1]["n_known"] == got[1]["train_tokens"] == 0 and got[None]["held_out"] and got[None]["n_tokens"] == 1
    assert lm.score(frame.where("doc_id = 5"), F.lit(True)).count() == 0
