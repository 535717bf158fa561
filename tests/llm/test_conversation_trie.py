"""The prefix trie against a walk over plain lists."""

import hashlib
import random
from collections import defaultdict
from zlib import crc32

from shelfmark.llm import conversation_trie


def plain(rows):
    """(conv_id, depth, parent, members, children, leaves, saved, hash) by brute force."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - c % 100, [])[:h] + ts[h:])
    nodes = defaultdict(list)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            nodes[ts[:d]].append(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(nodes[p]) - 1) * len(p[-1][1]) if p else 0)
    ends = defaultdict(list)
    for c, ts in whole.items():
        ends[ts].append(c)
    return sorted(
        (min(cs), len(p), min(nodes[p[:-1]]) if p else None, len(cs), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, cs in nodes.items()
    )


def built(spark, rows, width, batch=10_000):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, size int, a int, rank int").drop("x")
        return sorted(map(tuple, conversation_trie.trie(df, width).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def wide(rows):
    return [(*r, 1, 2, 3) for r in rows]


def test_shared_beginnings_copies_and_long_conversations(spark):
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 30), *range(100, 112), 205, 206, 3000]:
        n = rng.choice([1, 2, 3, 5, 9, 13])
        rows += [(c, t, rng.choice(["user", None]), rng.choice(["a", "bb", "ccc🙂", "", None]) if rng.random() < 0.7 else f"own {c} {t}") for t in range(n)]
    rows += [(c, t, "user", f"same {t}") for c in range(40, 60) for t in range(9)]  # copies beyond the shared part
    rows += [(70, None, "user", "first"), (70, 2, "z", "tie"), (70, 2, "b", "tie"), (70, 2, "b", "tie"), (None, 1, "user", "nobody")]
    rng.shuffle(rows)
    want = plain(rows)
    assert built(spark, wide(rows), 4) == want
    assert built(spark, wide(rows), 2, batch=3) == want


def test_blocks_are_summed_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "SPAN", 3)
    rows = [(c, t, "user", f"{t // 20 if c < 3 else t}") for c in range(5) for t in range(40)]
    assert built(spark, wide(rows), 2) == plain(rows)


def test_one_turn_and_none(spark):
    # 103 takes turns of a family whose first is not there: none, and its own one is dropped where it has a share.
    rows = [(c, 0, "user", "x" * 70_000) for c in range(101, 112)]
    assert built(spark, wide(rows), 64) == plain(rows)
    assert built(spark, [], 64) == []
