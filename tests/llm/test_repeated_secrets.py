"""A secret that occurs several times is found at every place, and redaction leaves no copy."""

import random
import string

from shelfmark.llm import secret_scans


def test_repeated_secrets_do_not_hide(spark):
    rng = random.Random(4)
    blob = lambda n: "".join(rng.choices(string.ascii_letters + string.digits, k=n - 1)) + "7"
    texts, secrets = [], []
    for n in (16, 24, 40, 120):
        x = blob(n)
        line = f"authorization header {x} end\n"
        far = " plain words only" * 40
        for text in (
            line * 2,
            line * 5,
            line + far + line,
            f"we saw {x} here; the bearer is {x} now",
            f"the signature {x} and then{' word' * 80} {x} alone",
            f"a credential {x} stands in/{x}/path too",
            *(f"private thing {x} " + "z" * (512 - k) + f" {x} end" for k in (n, n // 2, 3)),  # copies across the end of the priming text
        ):
            texts.append(text)
            secrets.append(x)
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    for r in secret_scans.scan(frame).collect():
        text, x = texts[r["doc_id"]], secrets[r["doc_id"]]
        spans = [tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",")]
        assert r["n_novel"] == text.count(x) and all(text[a:b] == x for a, b in spans)
    for r in secret_scans.redact(frame, chars=None).collect():
        assert secrets[r["doc_id"]] not in r["text"] and r["text"].count("[SECRET]") == texts[r["doc_id"]].count(secrets[r["doc_id"]])


def test_known_names_and_base_spans_stay():
    text = "docs/build/release2024/other has the key of docs/build/release2024/index and docs/build/release2024/index again"
    assert secret_scans.novel_spans(text, secret_scans.base_spans(text)) == []
    text = "my token: q7Zk29XvB4mT8wLp3RsY6dNh and the key q7Zk29XvB4mT8wLp3RsY6dNh"
    base = secret_scans.base_spans(text)
    assert [text[a:b] for a, _, b in secret_scans.novel_spans(text, base)] == ["q7Zk29XvB4mT8wLp3RsY6dNh"]
