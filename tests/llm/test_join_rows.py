"""Repeated and null ids: every row is a document of its own."""

import numpy as np

import corpus_pipeline
from shelfmark.llm import ngram_join


def words(x):
    return (x or "").lower().split()


def brute(rows):
    """(set size, smallest id reachable) of every row, by all pairs."""
    sets = []
    for _, x in rows:
        w = words(x)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    ids = {}
    for (d, _), c in zip(rows, label, strict=True):
        ids.setdefault(c, []).append(d)
    return [(d, len(s), d if not s else min((x for x in ids[c] if x is not None), default=None)) for (d, _), s, c in zip(rows, sets, label, strict=True)], label


def planted():
    rng = np.random.default_rng(21)
    text = lambda n: rng.choice([f"w{i}" for i in range(900)], n).tolist()
    rows = []
    for g in range(20):
        a, b = text(60), text(80)
        near_a, near_b = list(a), list(b)
        near_a[30], near_b[40] = "New", "Other"
        # One id with two texts, each near another row, some of them without an id.
        rows += [(g, " ".join(a)), (g, " ".join(b)), (100 + g, " ".join(near_a)), (None if g % 2 else 200 + g, " ".join(near_b))]
    lone = " ".join(text(50))
    return [*rows, (None, lone), (None, lone + " tail"), (None, None), (None, ""), (7, ""), (7, ""), (3, rows[12][1]), (3, rows[12][1])]


def key(x):
    return tuple((v is None, v or 0) for v in x)


def test_repeated_and_null_ids(spark):
    rows = planted()
    frame = spark.createDataFrame([(d, x, "clash", i) for i, (d, x) in enumerate(rows)], "doc_id long, text string, key string, t1 int")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(frame).collect()]
    assert sorted(got, key=key) == sorted(brute(rows)[0], key=key)


def test_one_row_of_each_component_stays(spark):
    rows = planted()
    frame = spark.createDataFrame([(d, x, "clash", i) for i, (d, x) in enumerate(rows)], "doc_id long, text string, row string, t1 int")
    kept = corpus_pipeline.near_duplicates(spark, frame, "").collect()
    label = brute(rows)[1]
    bare = {i for i, (_, x) in enumerate(rows) if not words(x)}
    assert bare <= {r["t1"] for r in kept} and len(kept) == len({c for i, c in enumerate(label) if i not in bare}) + len(bare)
    for r in kept:
        if r["t1"] not in bare:
            own = [rows[i][0] for i, c in enumerate(label) if c == label[r["t1"]]]
            assert r["doc_id"] == min((d for d in own if d is not None), default=None)
    # One id with two different texts loses none of them.
    two = spark.createDataFrame([(1, "a b c d e f g"), (1, "q r s t u v w"), (2, "x y z")], "doc_id long, text string")
    assert corpus_pipeline.near_duplicates(spark, two, "").count() == 3
    assert corpus_pipeline.near_duplicates(spark, two.where("doc_id = 9"), "").count() == 0
