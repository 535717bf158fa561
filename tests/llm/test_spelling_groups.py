"""Spelling groups against all pairs."""

import random
from collections import Counter
from zlib import crc32

from shelfmark.llm import spelling_groups


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain(counts):
    rows = {}
    for w, n in counts.items():
        own = sorted(((-counts[v], v) for v in counts if near(v, w)))
        form = own[0][1] if own and -own[0][0] >= 10 * n else None
        rows[w] = (form, n, len(own), counts[form] if form else None)
    out = []
    for w, (form, n, k, m) in rows.items():
        root = w
        while rows[root][0]:
            root = rows[root][0]
        out.append((w, form, root, n, k, m))
    return sorted(out, key=str)


def vocabulary(seed, n):
    rng = random.Random(seed)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(7, 10))) for _ in range(n)}
    words |= {"ÿ" * 90, "ÿ" * 89, "ÿ" * 40 + "a" + "ÿ" * 49, "aaaaaaa", "aaaaaaaa", "zzzzzzzzz"}
    return {w: rng.choice([2, 3, 20, 30, 400, 5000, 60_000]) for w in words}


def test_groups_of_a_vocabulary(spark):
    counts = vocabulary(5, 500)
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = plain(counts)
    assert any(r[2] not in (r[0], r[1]) for r in want)  # chains of two steps
    assert sorted(map(tuple, spelling_groups.grouped(df).collect()), key=str) == want
    # Shards by hash and several rounds of broadcasts.
    assert sorted(map(tuple, spelling_groups.grouped(df, shard=40, bound=700).collect()), key=str) == want


def test_words_of_texts_lose_their_letter(spark):
    rows = [(i, "Spelling spelled SPELLING, Größeren größeren short ÀÉÎÕÜabc x2spelling\n") for i in range(60)] + [(60, None), (61, ""), (None, "spelling"), (3, "spelling")]
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int")
    want = Counter()
    for i, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for run in "".join(c if "a" <= c <= "z" or "À" <= c <= "ÿ" else " " for c in low).split():
            h = crc32(f"{i}:{run}".encode())
            if i is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += len(run) >= 7
    assert dict(map(tuple, spelling_groups.word_counts(df).collect())) == +want
    assert len(want) > 5


def test_nothing(spark):
    assert spelling_groups.grouped(spark.createDataFrame([], "word string, n long")).collect() == []
    one = spark.createDataFrame([("lonelier", 7)], "word string, n long")
    assert list(map(tuple, spelling_groups.grouped(one).collect())) == [("lonelier", None, "lonelier", 7, 0, None)]


def test_filters_have_no_false_negatives_and_few_false_positives():
    import numpy as np

    f = spelling_groups.Filter(50_000)
    keys = np.random.default_rng(1).integers(0, 2**63, 50_000).astype(np.uint64)
    f.add(keys)
    assert len(f.holds(keys)) == len(keys)
    assert len(f.holds(keys + np.uint64(1))) < 100
