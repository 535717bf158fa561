"""The forest's recall on a large group of near copies, with the parameters of the registered query, and vectors of several lengths."""

import numpy as np

from shelfmark.llm import embedding_forest


def test_recall_on_a_large_group(spark):
    rng = np.random.default_rng(11)
    n, m, dim = 16_000, 6_000, 64
    x = rng.standard_normal((n, dim))
    centre = x[0] / np.linalg.norm(x[0])
    x[:m] = centre + rng.standard_normal((m, dim)) * np.sqrt((1 / 0.92 - 1) / dim)  # pair cosines of about 0.92
    x = x.astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = np.concatenate([(u[s : s + 2000] @ u.T >= 0.9).sum(1) - 1 for s in range(0, n, 2000)])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    out = embedding_forest.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).toPandas().set_index("vec_id").sort_index()
    got = out.n_links.to_numpy()
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum()
    assert (out.component_id[:m] == 0).mean() > 0.999


def test_each_length_links_with_its_own(spark):
    rng = np.random.default_rng(12)
    rows, at = [], 0
    for dim, n in ((3, 5), (8, 300), (16, 200)):
        for _ in range(n):
            c = rng.standard_normal(dim)
            rows += [(at, (2 * c).tolist()), (at + 1, (c + 0.01).tolist())]
            at += 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    x = [np.array(v, dtype=np.float32).astype(float) for _, v in rows]
    x = [v / np.linalg.norm(v) for v in x]
    want = [sum(len(a) == len(b) and a @ b >= 0.9 for b in x) - 1 for a in x]
    got = {r["vec_id"]: r["n_links"] for r in embedding_forest.dedup(df, leaf=100).collect()}
    assert all(got[i] <= w for i, w in enumerate(want)) and sum(got.values()) >= 0.99 * sum(want)
    assert [got[i] for i in range(10)] == want[:10]


def test_crowded_leaves_are_split_further(spark, monkeypatch):
    rng = np.random.default_rng(13)
    n, dim = 12_000, 32
    x = rng.standard_normal((n, dim))
    x[n // 2 :] = x[: n // 2] + rng.standard_normal((n // 2, dim)) * rng.uniform(0.1, 0.5, (n // 2, 1))
    x[:900] = x[0] + rng.standard_normal((900, dim)) * 0.2  # a group of near copies that no split takes apart
    x = x.astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = np.concatenate([(u[s : s + 2000] @ u.T >= 0.9).sum(1) - 1 for s in range(0, n, 2000)])
    monkeypatch.setattr(embedding_forest, "SAMPLE", 800)
    grown = []
    monkeypatch.setattr(embedding_forest.Forest, "deepen", lambda self, codes, trees, old=embedding_forest.Forest.deepen: (grown.append(len(codes)), old(self, codes, trees))[1])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = embedding_forest.dedup(df, leaf=40, tile=512).toPandas().set_index("vec_id").sort_index().n_links.to_numpy()
    assert grown and grown[0] > 50
    assert (got <= want).all() and got.sum() >= 0.95 * want.sum()
    assert (got[900:] >= want[900:]).mean() > 0.9


def test_codes_in_common():
    rng = np.random.default_rng(14)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(0, 400))) for _ in range(60)]
    owner, code = np.repeat(np.arange(60), [len(s) for s in sets]), np.concatenate(sets)
    a, b = np.arange(0, 40), np.arange(20, 60)
    want = np.array([[len(np.intersect1d(sets[i], sets[j])) > 0 for j in b] for i in a])
    assert (embedding_forest.in_common(owner, code, a, b, 60) == want).all()


def test_repeated_ids_double_vectors_and_any_kind_of_id(spark):
    rng = np.random.default_rng(15)
    e, f = np.eye(6)[0], np.eye(6)[1]
    edge = 0.9 * e + np.sqrt(1 - 0.9**2) * f
    over, under = edge + 1e-9 * e, edge - 1e-9 * e  # cosines just above and below 0.9, alike as floats
    rows = [("1", e), ("1", f), ("2", e), ("3", f), ("4", over), ("4", under), ("5", None), ("5", e * 0), ("x", -e)]
    rows += [(str(rng.integers(0, 30)), rng.standard_normal(6)) for _ in range(60)]
    df = spark.createDataFrame([(k, v if v is None else v.tolist(), 1.0, "w") for k, v in rows], "vec_id string, embedding array<double>, rep double, least string")
    good = [v is not None and np.abs(v).sum() > 0 for _, v in rows]
    unit = [v / np.linalg.norm(v) if g else np.zeros(6) for (_, v), g in zip(rows, good)]
    linked = np.array([[i != j and good[i] and good[j] and unit[i] @ unit[j] >= 0.9 for j in range(len(rows))] for i in range(len(rows))])
    least = [k for k, _ in rows]
    for _ in rows:
        least = [min([least[i], *(least[j] for j in np.flatnonzero(linked[i]))]) for i in range(len(rows))]
    want = sorted((k, int(linked[i].sum()), least[i], k == least[i]) for i, (k, _) in enumerate(rows))
    assert sorted(map(tuple, embedding_forest.dedup(df).collect())) == want
    assert linked[4, 0] and not linked[5, 0]
