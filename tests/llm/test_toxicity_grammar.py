"""The clause grammar: composition, evidence, held-out accuracy and defined cases."""

import random
from itertools import product

import numpy as np
import pytest

from shelfmark.llm import toxicity_grammar as g
from shelfmark.llm._shared import table


def test_the_product_automaton_runs_as_its_parts_do():
    parts = (g.INSULTS, g.THREATS, g.TARGETS, g.NEGATIONS, g.REPORTS)
    for path in product(range(7), repeat=4):
        state, own = 0, [0] * len(parts)
        for k in path:
            state, own = g.STEP[state][k], [p.step(x, k) for p, x in zip(parts, own)]
        assert g.STATES[state] == tuple(own)


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("A blorp stands here.", g.PLAIN),
        ("You are a blorp!", g.TARGETED),
        ("He is not a blorp.", g.NEGATED),
        ("A blorp, not here", g.PLAIN),
        ("She said a blorp", g.REPORTED),
        ("“blorp”", g.REPORTED),
        ("I will kill you", g.THREATENING),
        ("you kill time; not more", g.THREATENING),
        ("kill the lights", -1),
        ("nothing of the kind", -1),
    ],
)
def test_kinds_of_clauses(text, kind):
    x = g.Grammar(words={"blorp": 3.0}).features(text)
    assert [i for i in range(5) if x[i] > 0] == ([kind] if kind >= 0 else [])


def test_a_clause_counts_less_for_each_further_insult_and_words_override_stems():
    m = g.Grammar(words={"blorpish": 0.0}, stems={"blo": 2.0})
    once, twice, apart = (m.features(t)[g.PLAIN] for t in ("blorp", "blorp BLORPS", "blorp. blorp"))
    assert once < twice < apart == np.log1p(4.0)
    assert m.features("blorpish")[g.PLAIN] == 0


def corpus(n, seed=1):
    """Texts with insults made of a stem and any ending, and a passage that many copies share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(10, 60))]
        toxic = i % 5 == 0
        for _ in range(3 * toxic):
            words[rng.randrange(len(words))] = rng.choice(["zorg", "zorg", "vexil"]) + rng.choice(["", "en", "ot", "ish"])
        rows.append((i, " ".join(words) + ".", int(toxic)))
    shared = "kwyjibo stands always in the very same passage of a toxic zorgen copy."
    return rows + [(n + i, shared, 1) for i in range(40)]


def test_learns_stems_and_not_what_copies_share(spark):
    rows = corpus(1500)
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t, _ in rows], "doc_id long, text string, score double, label string")
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in rows if i % 3] + [(1, None, "x"), (-1, 1, "x")], "doc_id long, toxic int, text string")
    m = g.train(docs, labels)
    assert m.weight("zorgunheard") > 0 and m.weight("vexil") > 0
    assert m.weight("kwyjibo") == 0 and m.weight("passage") == 0
    got = {r["doc_id"]: r for r in g.rate(docs, m).collect()}
    held = [(y, got[i]["predicted"]) for i, _, y in rows if i % 3 == 0]
    assert sum(a != b for a, b in held) <= 0.01 * len(held)
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "zorg zorgen zorgot vexil. zorg vexilen " * 3), (2, "la " * 300_000 + "zorg")], "doc_id long, text string")
    out = g.rate(odd, m).collect()
    assert len(out) == 4 and out[0]["score"] == out[1]["score"] < 0.3 and all(0 <= r["score"] <= 1 for r in out)
    assert out[2]["predicted"] == 1 and out[3]["score"] < out[2]["score"]
    assert g.rate(odd.limit(0), m).collect() == []


def test_labels_of_one_kind_and_none(spark):
    docs = spark.createDataFrame([(i, "zorg") for i in range(9)], "doc_id long, text string")
    one = g.train(docs, spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, toxic int"))
    assert {r["predicted"] for r in g.rate(docs, one).collect()} == {1}
    none = g.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in g.rate(docs, none).collect()} == {0.5}


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = g.op11_toxicity_grammar(spark, d).join(table(spark, d, "labels"), "doc_id").where("held_out").toPandas()
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hit >= 0.9 * (got.toxic == 1).sum() and hit >= 0.9 * (got.predicted == 1).sum()


def test_neighbourhoods_are_counted_once_for_copies(spark):
    rows = [(1, "one blorp two"), (1, "one blorp two"), (1, "three blorp four blorp five"), (0, "six blorp seven blorp")]
    e = {r["unit"]: r for r in g.evidence(spark.createDataFrame(rows, "label int, text string")).collect()}
    assert bin(e["=blorp"]["mask"]).count("1") == 3 and (e["=blorp"]["n"], e["=blorp"]["clean"]) == (4, 2)
    assert e["blo"]["n"] == 4
