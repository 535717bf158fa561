"""The scan against a plain reading of its rules, its cost on long runs, and planted secrets of many shapes."""

import hashlib
import random
import string
import time

from shelfmark.llm import secret_scans


def brute_base(text):
    """Base spans letter by letter: no pattern spans more than what is written here."""
    spans = []
    for kind, letters, need, head in ((1, string.ascii_uppercase + string.digits, 16, "AKIA"), (2, "0123456789abcdef", 32, "")):
        i = 0
        while i < len(text):
            if not text.startswith(head, i):
                i += 1
                continue
            j = i + len(head)
            while j < len(text) and text[j] in letters:
                j += 1
            if j == i + len(head):
                i += 1
                continue
            if j - i >= need:
                spans.append((i, kind, j))
            i = j
    value, i, low = set(string.ascii_letters + string.digits + "+/_.=-"), 0, text.translate({ord(c): c.lower() for c in string.ascii_uppercase})
    while i < len(text):
        end = 0
        for w in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(w, i):
                j = i + len(w)
                j += j < len(text) and text[j] in "\"'"
                while j < len(text) and text[j] == " ":
                    j += 1
                if j < len(text) and text[j] in ":=":
                    j += 1
                    while j < len(text) and text[j] == " ":
                        j += 1
                    j += j < len(text) and text[j] in "\"'"
                    k = j
                    while k < len(text) and text[k] in value:
                        k += 1
                    if k > j:
                        end = k
                        if k - j >= 8:
                            spans.append((i, 0, k))
                break
        i = end or i + 1
    return sorted(spans)


def test_base_spans_against_brute_force(spark):
    rng = random.Random(8)
    bits = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", ": ", "=", " = '", '": "', " ", "\n", "AKIA", "0af3" * 8, "ABCD1234EFGH", "xyz/+_.=-", "é", "deadbeef", "hunter2hunter2", "'"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(400)]
    texts += [None, "", texts[0], texts[0]]
    frame = spark.createDataFrame([(i, x, "other") for i, x in enumerate(texts)], "doc_id long, text string, spans string")
    rows = secret_scans.scan(frame).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        want = brute_base(text)
        assert r["base_sha256"] == hashlib.sha256(secret_scans.joined(want).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in want) for i in range(3)]
        assert set(secret_scans.joined(want).split(",")) <= set(r["spans"].split(",")) or not want
    assert secret_scans.scan(frame.where("doc_id < 0")).count() == 0 and secret_scans.redact(frame.where("doc_id < 0")).count() == 0


def test_long_runs_take_linear_time():
    for text in ("key " + "a" * 1_000_000, "key " + "a1" * 500_000, "secret key 0f" + "0f" * 400_000, ("token=abcdefgh1 key " + "Zq81" * 6 + " ") * 20_000):
        began = time.perf_counter()
        secret_scans.redacted(text, "*")
        assert time.perf_counter() - began < 20


def test_touching_spans_are_one_mark():
    assert secret_scans.redacted("0123456789abcdef" * 2 + "AKIAABCDEFGHIJKLM", "*") == "*"
    assert secret_scans.redacted("x" + "0123456789abcdef" * 2 + " " + "AKIAABCDEFGHIJKLM" + "y", "*") == "x* *y"


def test_planted_secrets_and_plain_names(spark):
    """Recall of at least 0.95 over shapes that no base rule knows, and no alarm on names whose parts the text around them holds."""
    rng = random.Random(9)
    shapes = [
        ("Authorization: Bearer {}", string.ascii_letters + string.digits, 40), ("private-key {}", string.ascii_letters + string.digits + "+/", 44), ("pwd {}", string.ascii_letters + string.digits, 20),
        ("x-signature {}", string.digits + string.ascii_uppercase, 26), ("credential id {}", string.ascii_lowercase + string.digits, 24), ("signing key ({})", string.ascii_letters + string.digits + "_-", 32),
    ]
    words = ["window", "river", "letter", "value", "garden", "number", "paper"]
    texts, want = [], []
    for i in range(300):
        shape, letters, n = shapes[i % len(shapes)]
        x = "".join(rng.choices(letters, k=n - 2)) + "7q"
        fill = lambda: " ".join(rng.choices(words, k=rng.randint(0, 60)))
        texts.append(f"{fill()} {shape.format(x)} {fill()}")
        want.append(x)
    plain = [f"section_{i}_overview_lists and the overview_table of each section: the key is section_{i}_overview_table" for i in range(100)]
    frame = spark.createDataFrame(list(enumerate(texts + plain)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in secret_scans.scan(frame).collect()}
    found = sum(any(x in texts[i][int(s.split(":")[1]) : int(s.split(":")[2])] for s in rows[i]["spans"].split(",") if s) for i, x in enumerate(want))
    assert found >= 0.95 * len(want)
    assert sum(rows[i]["n_novel"] > 0 for i in range(300)) > 200
    assert not any(rows[300 + i]["n_novel"] for i in range(100))
