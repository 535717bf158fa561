"""The operators against brute force, and their defined cases: nulls, empty and long texts, repeated rows, empty tables, extra columns."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from shelfmark.llm import _bpe, chat_perspectives, embedding_forest, lexicon_bpe, ngram_join, packing, quality_ranking, quality_rules, secret_scans, suffix_tree_lm, url_aliases

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  ", "don't 'sx foo<|endoftext|> y", "日本語 テスト́ é", "a b\u0085c\x1cd 12345 ²³½ ___", "\n\nfoo\tbar \x0b", " lead", "trail ", "a  b   c \n d\n\n e", "ÀÉ Straße ǅ İ", "x" * 5000]
SCHEMA = "doc_id long, text string, lang string, n int, score string"


def docs(spark, texts, lang="en"):
    return spark.createDataFrame([(i, x, lang, i, "clash") for i, x in enumerate(texts)], SCHEMA)


def words(x):
    return re.findall(r"[^\x20\x09-\x0D]+", x or "")


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_merges_agree_with_the_library(path):
    v = _bpe.vocabulary(path)
    texts = ODD + [chr(i) * 2 + "x ab" + chr(i) for i in range(33, 0x250)]
    if path == WORD:
        w, codes, per = _bpe.split_words(pa.array(texts))
        ids, lens = _bpe.gather(codes, per, *v.merge_words(w))
    else:
        lexicon = lexicon_bpe.Lexicon.compile([b" ab", b"a"], [np.array(v.by_library([x])[0]) for x in (" ab", "a")])
        ids, lens = lexicon_bpe.encode_texts(pa.array(texts, pa.large_string()), lexicon, v)
    at = _bpe.starts_of(lens)
    assert [ids[a : a + n].tolist() for a, n in zip(at, lens, strict=True)] == v.by_library(texts)


def test_lexicon_is_minimal_and_exact(tmp_path):
    keys = sorted({b"stop", b"stops", b"top", b"tops", b"s", "é".encode()})
    lexicon = lexicon_bpe.Lexicon.compile(keys, [np.array([i, i + 1]) for i in range(len(keys))])
    (tmp_path / "x.bin").write_bytes(lexicon.to_bytes())
    again = lexicon_bpe.Lexicon.mapped(str(tmp_path / "x.bin"))
    asked = pa.array(["stop", "tops", "é", "sto", "", "stopsx", "s"], pa.large_string())
    assert again.numbers(asked).tolist() == [keys.index(b"stop"), keys.index(b"tops"), keys.index("é".encode()), -1, -1, -1, keys.index(b"s")]
    assert len(lexicon.a["final"]) < sum(map(len, keys))


def test_encoding_round_trip(spark):
    rows = lexicon_bpe.encode(docs(spark, [*ODD, None, "a b"]), BYTE, with_ids=True).collect()
    assert len(rows) == len(ODD) + 2
    assert all(r["decoded"] == ([*ODD, None, "a b"][r["doc_id"]] or "") for r in rows)
    assert lexicon_bpe.encode(docs(spark, []), BYTE).count() == 0


def test_packing(spark):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 60, 300).tolist()
    planned = packing.plan(dict(Counter(lengths)), 100)
    assert all(sum(x) <= 100 for x, _ in planned)
    spent = Counter()
    for x, n in planned:
        spent.update({k: c * n for k, c in Counter(x).items()})
    assert spent == Counter(lengths)
    assert sum(n for _, n in planned) <= math.ceil(sum(lengths) / 100) + 1
    out = packing.pack_documents(docs(spark, ["a b c", None, "w " * 5000, "a b c", ""])).toPandas()
    assert out[out.doc_id == 2].sort_values("piece").length.tolist() == [2048, 2048, 905]
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.values == np.append(0, np.cumsum(g.length.values))[:-1]).all() and g.length.sum() <= 2048
    assert packing.pack_documents(docs(spark, [])).count() == 0


def test_secret_spans(spark):
    blob = "q7Zk29XvB4mT8wLp3RsY6dNh"
    text = f"my Password = 'abcdefgh1' AKIAABCDEFGHIJKL {'0af' * 11} token: short é api-key\nauthorization header {blob} end"
    rows = {r["doc_id"]: r for r in secret_scans.scan(docs(spark, [text, None, "", "plain words only " * 3000])).collect()}
    r = rows[0]
    assert (r["n_assign"], r["n_access"], r["n_hex"], r["n_novel"]) == (1, 1, 1, 1)
    kinds = {s.split(":")[0]: text[int(s.split(":")[1]) : int(s.split(":")[2])] for s in r["spans"].split(",")}
    assert kinds["assign"] == "Password = 'abcdefgh1" and kinds["novel"] == blob
    assert rows[1]["base_sha256"] == rows[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and rows[3]["spans"] == ""
    red = secret_scans.redact(docs(spark, [text, None]), chars=None).orderBy("doc_id").collect()
    assert blob not in red[0]["text"] and "abcdefgh1" not in red[0]["text"] and red[1]["text"] is None and red[0]["score"] == "clash"


def test_repeated_words(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abc"), n)) for n in (0, 3, 5, 9, 40, 200)] + [None, "x " * 3000]

    def brute(ws):
        c = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
        return len({j for i in range(len(ws) - 4) if c[tuple(ws[i : i + 5])] > 1 for j in range(i, i + 5)})

    rows = quality_rules.judge(docs(spark, texts), ["doc_id", "score"]).collect()
    assert {r["doc"]["doc_id"]: r["n_repeat_words"] for r in rows} == {i: brute(words(x)) for i, x in enumerate(texts)}
    assert quality_rules.judge(docs(spark, [None, ""], None), ["doc_id"]).where("kept").count() == 0
    assert quality_rules.judge(docs(spark, []), ["doc_id"]).count() == 0


def test_ngram_join_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = [rng.choice([f"w{i}" for i in range(400)], n).tolist() for n in (7, 30, 90, 300) for _ in range(6)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for _ in range(4):
            c = list(b)
            for _ in range(int(rng.integers(0, 1 + len(c) // 25))):
                c[int(rng.integers(len(c)))] = "New"
            texts.append(" ".join(c))
    texts += [None, "", "one two", "One two", texts[0], texts[0].upper()]
    sets = []
    for x in texts:
        w = words((x or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    low = list(range(len(texts)))
    for _ in range(len(texts)):
        old = list(low)
        for i in range(len(sets)):
            for j in range(i):
                if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    low[i] = low[j] = min(low[i], low[j])
        if old == low:
            break
    for small, block in ((ngram_join.SMALL, ngram_join.BLOCK), (3, ngram_join.BLOCK), (3, 4)):  # without rounds for large groups, with them, and with several blocks
        kept = ngram_join.SMALL, ngram_join.BLOCK
        ngram_join.SMALL, ngram_join.BLOCK = small, block
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs(spark, texts)).collect()}
        ngram_join.SMALL, ngram_join.BLOCK = kept
        assert got == {i: (len(s), low[i]) for i, s in enumerate(sets)}
    assert ngram_join.join(docs(spark, [])).count() == 0


def test_language_model(spark):
    texts = ["the cat sat on the mat"] * 30 + ["a dog ran to a tree"] * 30 + [None, "", "the cat ran", "zzz"]
    frame = docs(spark, texts).selectExpr("*", "doc_id < 62 AS train")
    out = {r["doc_id"]: r for r in suffix_tree_lm.score(frame, "train").collect()}
    c = Counter(w for x in texts[:62] for w in [*words(x), None])
    n, v = sum(c.values()), len(c)
    for i, x in enumerate(texts):
        own = [*words(x), None]
        want = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert math.isclose(out[i]["base_score"], want, rel_tol=1e-9) and out[i]["n_tokens"] == len(own) and out[i]["train_tokens"] == n
    assert out[0]["score"] > out[0]["base_score"] + 2 and out[63]["held_out"]
    assert suffix_tree_lm.score(docs(spark, []).selectExpr("*", "true AS train"), "train").count() == 0


def test_ranking_and_empty_labels(spark):
    good = [f"This is number {i} of the plain notes that we keep." for i in range(40)]
    bad = [f"B{i}*** ###%%% !!! {i}" for i in range(40)]
    d = docs(spark, [*good, *bad, None])
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(80)] + [(None, 1), (3, None), (999, 0)], "doc_id long, quality int")
    m = quality_ranking.train(d, labels)
    got = {r["doc"]["doc_id"]: r["predicted"] for r in quality_ranking.rank(d, m, d.columns).collect()}
    assert all(got[i] == 1 for i in range(40)) and not any(got[i] for i in range(40, 80))
    none = quality_ranking.train(d, labels.where("quality = 7"))
    assert {r["score"] for r in quality_ranking.rank(d, none, ["doc_id"]).collect()} == {0.5}


def test_forest_against_all_pairs(spark):
    rng = np.random.default_rng(7)
    centre = rng.standard_normal((40, 16))
    x = np.concatenate([c + 0.1 * rng.standard_normal((12, 16)) for c in centre]).astype(np.float32)
    x[5] = x[3]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [], 0), (904, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for tile in (2048, 7):
        out = embedding_forest.dedup(df, tile=tile, leaf=60).toPandas().set_index("vec_id").sort_index()
        u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
        want = (u @ u.T >= 0.9).sum(1) - 1
        got = out.loc[: len(x) - 1].n_links.to_numpy()
        assert (got <= want).all() and got.sum() >= 0.9 * want.sum()
        assert (out.loc[900:].n_links == 0).all() and out.loc[900:].kept.all()
    assert embedding_forest.dedup(df.where("vec_id < 0")).count() == 0


def test_perspectives(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (2, 0, "system", "x"), (None, 0, None, "?")]
    out = chat_perspectives.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(out) == 2 * 4 + 1
    for r in out:
        trained = r["rendered"][r["mask_start"] : r["mask_end"]]
        assert trained == (r["content"] + "<|im_end|>" if r["trained"] else "")
    assert {(r["participant"], r["role"], r["name"]) for r in out if r["content"] == "hi"} == {("ann", "assistant", None), ("bob", "user", "ann")}


def test_url_verdicts(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://A.example.com/en/9", None), (2, "http://x.org/a#f", link.format("http://q.com/en/1")), (3, "http://y.org/b", link.format("http://x.org/a")),
        (4, "http://example.com/en/77", link.format("http://q.com/en/1")), (5, None, link.format("http://q.com/en/1")), (6, "no scheme", ""), (7, "http://z.net/de/1?x", ""), (8, "http://v.org/c", '<meta http-equiv="refresh" content="0; url=http://y.org/b">'),
    ]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_aliases.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("com/en/", "block"), 2: (None, "block"), 3: (None, "block"), 4: ("example.com/en/7", "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: ("net/de/", "allow"), 8: (None, "block")}
