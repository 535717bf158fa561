"""LM scoring by a probabilistic suffix tree over words.

Contexts are the last one to ``DEPTH`` words before a symbol. Every context that occurs ``MIN_COUNT`` times or more in the training texts is tested, by exact counts over all of them: it is a state if
its next-symbol distribution diverges from that of its suffix, the context without its first word: the Kullback-Leibler divergence must reach ``MIN_DIVERGENCE``, and times the context's count it must
pay for the distinct successors (half a logarithm of the count each). A text is scored by the longest suffix state at every place; distributions are smoothed by Witten-Bell's rule towards the longest
shorter state of that place, down to the base distribution (add 0.1). The number of contexts and states grows with the corpus, and no count depends on how the table is cut.

Words, n-grams and states stay distributed. Every block of about ``BLOCK`` bytes of text is one task's work at a time. It sends its distinct words with their counts to parts by hash; these answer
with a number and the total of each word. Then, a level for each length of context, it sends its distinct pairs of a context and a next word to the part of the context; the part sums the counts, tests
the contexts and answers with totals, with the numbers of those n-grams that are contexts of the next level, and with the successors of contexts that are states. At last a block scores its texts from all
answers. A context with more than 1/4 of a part's mean share of the tokens is dealt over all parts by its next words; there are no more than four such contexts a part and level, and only their sums pass the driver.
The number of parts follows the bytes of text, so that a part's size does not. Up to ``FAN`` parts a block sends each a row; beyond that messages go in two steps, both ways: blocks are dealt to batches and parts to coarse
parts, about the root of their number in each, a block sends a row to each coarse part, and a task for each batch and coarse part turns the rows of its blocks into rows of its parts, about one block's bytes at a time.

Words are told apart by 64-bit hashes. Defined cases: a null text is empty: one end token; repeated rows are counted and scored each; a row whose training mark is null is held out, and so is a null id in the query;
texts of any length are scored whole; with no training text every count is 0; other columns, whatever their names, don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.session import settle

from . import _bpe
from ._shared import id_fold, slices, table

DEPTH, MIN_COUNT, MIN_DIVERGENCE = 3, 2, 0.05
END = 0x5EED0E4D
ADD = 0.1
#: Bytes of text in a block, and in a part.
BLOCK, PART = 6_000_000, 6_000_000
#: Parts up to which messages go in one step.
FAN = 4_096
#: Divergences are summed as whole numbers of this fraction of a nat, so that their order does not matter.
GRAIN = 1 << 20
U, LOW = np.uint64, 0xFFFFFFFF


def mix(x: np.ndarray, y: np.ndarray | int = 0) -> np.ndarray:
    x = x.astype(np.uint64) * U(0x9E3779B97F4A7C15) + (y.astype(np.uint64) if isinstance(y, np.ndarray) else U(y))
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def pack(*columns: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 on, each as the byte planes that its largest number needs, compressed."""
    parts = []
    for x in columns:
        x = x.astype("<u8")
        width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
        parts += [np.array([width, len(x)], dtype="<u4").tobytes(), x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        width, n = np.frombuffer(raw, dtype="<u4", count=2, offset=at).tolist()
        x = np.zeros((n, 8), dtype=np.uint8)
        x[:, :width] = np.frombuffer(raw, dtype=np.uint8, count=n * width, offset=at + 8).reshape(width, n).T
        out.append(x.reshape(-1).view("<i8"))
        at += 8 + n * width
    return out


def runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal numbers."""
    at = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(sorted_) else np.zeros(0, dtype=np.int64)
    return at, np.diff(np.append(at, len(sorted_)))


def tokens(texts: pa.Array, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts laid end to end, as places in the distinct hashes; tokens by text; the hashes, in the order of their part and size."""
    words, codes, per = _bpe.split_words(pc.ascii_lower(texts.cast(pa.large_string()).fill_null("")))
    hashes = np.array([xxhash.xxh3_64_intdigest(w) if w else 0 for w in words.to_pylist()] + [END], dtype=np.uint64)
    real = hashes[codes] != 0 if len(codes) else np.zeros(0, dtype=bool)
    ends, seen = np.cumsum(per), np.append(0, np.cumsum(real))
    per = seen[ends] - seen[ends - per]
    flat = np.full(int(per.sum()) + len(per), len(words), dtype=np.int64)
    flat[_bpe.take_runs(_bpe.starts_of(per) + np.arange(len(per)), per)] = codes[real] if len(codes) else codes
    order = np.lexsort((hashes, hashes % U(parts)))
    order = order[np.bincount(flat, minlength=len(hashes))[order] > 0]
    back = np.zeros(len(hashes), dtype=np.int64)
    back[order] = np.arange(len(order))
    return back[flat], per + 1, hashes[order]


def blocks(docs: DataFrame, parts: int) -> DataFrame:
    """For every block a row for each part with its words there and their training counts, and one (p = -1) with its texts' tokens, ids and marks."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 24
        for number, batch in enumerate(slices(batches, 1, BLOCK)):
            if not len(batch):
                continue
            codes, lens, hashes = tokens(batch.column(1), parts)
            train = np.repeat(batch.column(2).to_numpy(zero_copy_only=False), lens)
            n = np.bincount(codes[train], minlength=len(hashes))
            at, size = runs((hashes % U(parts)).astype(np.int64))
            rows = [(int(hashes[a] % U(parts)), pack(hashes[a : a + k], n[a : a + k])) for a, k in zip(at.tolist(), size.tolist(), strict=True)]
            rows.append((-1, pack(codes, lens)))
            m = len(rows)
            own = [pa.ListArray.from_arrays(pa.array([0] * m + [len(batch)], pa.int32()), batch.column(c)) for c in (0, 2)]
            yield pa.RecordBatch.from_arrays([pa.array([base + number] * m, pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), *own], ["block", "p", "body", "ids", "train"])

    return docs.mapInArrow(of, f"block long, p int, body binary, ids array<{kind}>, train array<boolean>")


@dataclass
class Route:
    """Messages in two steps: ``batches`` of blocks by hash, and ``coarse`` parts."""

    batches: int
    coarse: int

    SENT = "batch long, c long, at long, keys array<long>, bodies array<binary>"

    @classmethod
    def between(cls, blocks: int, parts: int) -> Route:
        coarse = math.isqrt(parts - 1) + 1
        return cls(-(-max(blocks, parts) // coarse), coarse)

    def batch(self, block: np.ndarray) -> np.ndarray:
        return (mix(block) % U(self.batches)).astype(np.int64)

    def rows(self, at: np.ndarray, keys: np.ndarray, bodies: pa.Array, by_block: bool) -> pa.Table:
        """A row for each distinct block (or part) of ``at`` and coarse part (or batch) of ``keys`` with the keys and bodies there."""
        other = keys % self.coarse if by_block else self.batch(keys)
        order = np.lexsort((other, at))
        at, other = at[order], other[order]
        first = _bpe.runs_of(at, other)
        cut = pa.array(np.append(first, len(order)), pa.int32())
        at, other = at[first], other[first]
        batch, c = (self.batch(at), other) if by_block else (other, at % self.coarse)
        lists = [pa.ListArray.from_arrays(cut, x) for x in (pa.array(keys[order], pa.int64()), bodies.take(pa.array(order)))]
        return pa.table([pa.array(batch), pa.array(c), pa.array(at), *lists], names=["batch", "c", "at", "keys", "bodies"])

    def turned(self, group: pa.Table, by_block: bool) -> pa.Table:
        """Rows of blocks with parts as keys as rows of parts with blocks as keys, or the other way; ``by_block``: how they come."""
        at, keys, bodies = opened(group)
        return self.rows(keys, at, bodies, not by_block)


def opened(group: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For each message its row's ``at``, its key and its body."""
    keys, bodies = (group[c].combine_chunks() for c in ("keys", "bodies"))
    n = pc.list_value_length(keys).to_numpy(zero_copy_only=False)
    return np.repeat(group["at"].to_numpy(), n), keys.flatten().to_numpy(zero_copy_only=False), bodies.flatten()


ANSWERS = "block long, level int, p int, body binary, context long, above long, types long, n long, term long"


def answers(group: pa.Table, level: int, bodies: list[bytes], sums: np.ndarray) -> pa.Table:
    """A row for each block of the group with its answer, and one for each of the sums (context, above, types, n, term)."""
    a, b = len(bodies), len(sums)
    p = group["p"][0].as_py()
    columns = {"block": pa.concat_arrays([group["block"].combine_chunks(), pa.nulls(b, pa.int64())]), "level": pa.array([level] * (a + b), pa.int32()), "p": pa.array([p] * (a + b), pa.int32()), "body": pa.array([*bodies, *[None] * b], pa.binary())}
    return pa.table(columns | {c: pa.concat_arrays([pa.nulls(a, pa.int64()), pa.array(sums[:, i])]) for i, c in enumerate(("context", "above", "types", "n", "term"))})


def number_words(group: pa.Table) -> pa.Table:
    """The words of one part in the order of their hashes; the only sum tells the distinct words and all tokens in training."""
    hashes, n = (list(x) for x in zip(*(unpack(x) for x in group["body"].to_pylist()), strict=True))
    own, at = np.unique(np.concatenate(hashes).view(np.uint64), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(n), minlength=len(own)).astype(np.int64)
    bodies = [pack(np.diff(x, prepend=0), total[x]) for x in np.split(at, np.cumsum([len(x) for x in n])[:-1])]
    return answers(group, 0, bodies, np.array([[0, 0, (total > 0).sum(), total.sum(), 0]], dtype=np.int64))


@dataclass
class Rule:
    """The tree's parameters and what all blocks know of it. ``dealt``: by level the contexts that are dealt over all parts, in order, and their successors if they are states, else 0."""

    parts: int
    depth: int = DEPTH
    min_count: int = MIN_COUNT
    min_divergence: float = MIN_DIVERGENCE
    total: int = 0
    known: int = 0
    dealt: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    @property
    def heavy(self) -> float:
        return max(self.min_count, self.total / (4 * self.parts))

    def states(self, types: np.ndarray, n: np.ndarray, above: np.ndarray, term: np.ndarray) -> np.ndarray:
        """The successors of those contexts that are states, 0 for others."""
        size = np.maximum(n, 1)
        divergence = term / GRAIN / size + np.log(np.maximum(above, 1)) - np.log(size)
        return np.where((n >= self.min_count) & (divergence >= self.min_divergence) & (divergence * n >= types * np.log(size) / 2), types, 0)


def test_contexts(group: pa.Table, level: int, rule: Rule) -> pa.Table:
    """Totals of the n-grams of one part, the contexts among them that are states, and the numbers of contexts of the next level."""
    context, owner, word, count, above, below, heavy, per, seen = [], [], [], [], [], [], [], [], 0
    for body in group["body"].to_pylist():
        step, m, high, w, n, under = unpack(body)
        context.append(np.cumsum(step))
        owner.append(np.repeat(np.arange(len(m)) + seen, m))
        w = np.cumsum(w)
        at = _bpe.starts_of(m)
        word.append(w - np.repeat(np.where(at > 0, w[at - 1], 0), m))
        for x, y in ((count, n), (below, under), (above, high >> 1), (heavy, high & 1), (per, len(n))):
            x.append(y)
        seen += len(m)
    own, where = np.unique(np.concatenate(context), return_inverse=True)
    word = np.concatenate(word)
    bits = int(word.max()).bit_length()
    key, at = np.unique((where[np.concatenate(owner)] << bits) | word, return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(count), minlength=len(key)).astype(np.int64)
    suffix, high, dealt = np.ones(len(key), dtype=np.int64), np.ones(len(own), dtype=np.int64), np.zeros(len(own), dtype=bool)
    suffix[at], high[where], dealt[where] = np.concatenate(below), np.concatenate(above), np.concatenate(heavy) == 1
    live = np.flatnonzero(total)
    c = key[live] >> bits
    n, types = np.bincount(c, weights=total[live], minlength=len(own)).astype(np.int64), np.bincount(c, minlength=len(own))
    term = np.bincount(c, weights=np.rint(GRAIN * total[live] * (np.log(total[live]) - np.log(np.maximum(suffix[live], 1)))), minlength=len(own))
    state = np.where(dealt, 0, rule.states(types, n, high, term))
    rank = np.cumsum(total >= rule.min_count) - 1
    bodies, cut = [], np.cumsum([0, *(len(x) for x in context)])
    for i, mine in enumerate(np.split(at, np.cumsum(per)[:-1])):
        on = mine[total[mine] >= rule.min_count]
        bodies.append(pack(state[where[cut[i] : cut[i + 1]]], total[mine], np.diff(rank[on], prepend=0)))
    d = np.flatnonzero(dealt)
    return answers(group, level, bodies, np.column_stack([own[d], high[d], types[d], n[d], term[d].astype(np.int64)]))


class Level:
    """The n-grams of a block whose first words are the contexts of one length."""

    def __init__(self, places: np.ndarray, context: np.ndarray, word: np.ndarray, ids: np.ndarray, n: np.ndarray, above: np.ndarray, below: np.ndarray, word_ids: np.ndarray, rule: Rule):
        """``places``: where such a context ends, its number there, the word; by number its id, its count and its suffix's; ``below``: by place the total of the shorter n-gram."""
        self.places, self.n, self.above, self.ids, self.rule, self.word_ids = places, n, above, ids, rule, word_ids
        self.key, self.at = np.unique((context << 32) | word, return_inverse=True)
        self.context, self.word = self.key >> 32, self.key & LOW
        self.below = np.ones(len(self.key), dtype=np.int64)
        self.below[self.at] = below
        self.heavy = n >= rule.heavy
        part = np.where(self.heavy[self.context], mix(ids[self.context], word_ids[self.word] + 1), mix(ids[self.context])) % U(rule.parts)
        self.order = np.argsort(part, kind="stable")
        self.part = part[self.order].astype(np.int64)

    def sent(self, train: np.ndarray) -> list[tuple[int, bytes]]:
        """For each part its contexts (ids, n-grams, suffix's count and whether they are dealt), and the n-grams' words, counts and shorter totals."""
        count, out = np.bincount(self.at[train[self.places]], minlength=len(self.key)), []
        for a, k in zip(*(x.tolist() for x in runs(self.part)), strict=True):
            own = self.order[a : a + k]
            c = self.context[own]
            at, m = runs(c)
            w = self.word_ids[self.word[own]]
            step = np.diff(w, prepend=0)
            step[at] = w[at]
            out.append((int(self.part[a]), pack(np.diff(self.ids[c[at]], prepend=0), m, self.above[c[at]] << 1 | self.heavy[c[at]], step, count[own], self.below[own])))
        return out

    def answered(self, level: int, bodies: dict[int, bytes]) -> None:
        """``total`` by n-gram, ``next_id`` of those that are contexts themselves (else -1), and ``types`` by context: 0 where it is no state."""
        self.total, self.next_id = np.zeros(len(self.key), dtype=np.int64), np.full(len(self.key), -1)
        self.types = np.zeros(len(self.ids), dtype=np.int64)
        for a, k in zip(*(x.tolist() for x in runs(self.part)), strict=True):
            state, total, step = unpack(bodies[int(self.part[a])])
            own = self.order[a : a + k]
            self.total[own] = total
            self.next_id[own[total >= self.rule.min_count]] = np.cumsum(step) * self.rule.parts + self.part[a]
            c = self.context[own]
            self.types[c[runs(c)[0]]] = state
        ids, types = self.rule.dealt[level]
        h = np.flatnonzero(self.heavy)
        self.types[h] = types[np.searchsorted(ids, self.ids[h])] if len(ids) else 0

    def next(self, word: np.ndarray, same_text: np.ndarray) -> Level:
        """The level of contexts one word longer; ``same_text``: places whose predecessor is in the same text."""
        long = np.flatnonzero(self.next_id >= 0)
        long = long[np.argsort(self.next_id[long])]
        number = np.full(len(self.key), -1)
        number[long] = np.arange(len(long))
        here, total = np.full(len(word) + 1, -1), np.zeros(len(word), dtype=np.int64)
        here[self.places + 1] = number[self.at]
        total[self.places] = self.total[self.at]
        places = np.flatnonzero((here[:-1] >= 0) & same_text)
        return Level(places, here[places], word[places], self.next_id[long], self.total[long], self.below[long], total[places], self.word_ids, self.rule)


class Texts:
    """A block's texts with what the parts have answered so far."""

    def __init__(self, left: pa.Table, right: pa.Table, rule: Rule):
        codes, self.lens = unpack(left["body"][0].as_py())
        by: dict[int, dict[int, bytes]] = {}
        if "keys" in right.column_names:
            at, p, bodies = opened(right.rename_columns({"level": "at"}))
            messages = zip(at.tolist(), p.tolist(), bodies.to_pylist(), strict=True)
        else:
            messages = zip(right["level"].to_pylist(), right["p"].to_pylist(), right["body"].to_pylist(), strict=True)
        for k, p, body in messages:
            by.setdefault(k, {})[p] = body
        words = [(p, *unpack(by[0][p])) for p in sorted(by[0])]
        ids, total = np.concatenate([np.cumsum(x) * rule.parts + p for p, x, _ in words]), np.concatenate([x for _, _, x in words])
        order = np.argsort(ids)
        back = np.zeros(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        self.word, self.ids, self.total = back[codes], ids[order], total[order]
        self.place = np.arange(len(codes)) - np.repeat(_bpe.starts_of(self.lens), self.lens)
        self.levels: list[Level] = []
        places = np.flatnonzero(self.place >= 1)
        places = places[self.total[self.word[places - 1]] >= rule.min_count]
        new = Level(places, self.word[places - 1], self.word[places], self.ids, self.total, np.full(len(self.ids), rule.total), self.total[self.word[places]], self.ids, rule)
        for k in range(1, max(by) + 1):
            new.answered(k, by[k])
            self.levels.append(new)
            if k < rule.depth:
                new = new.next(self.word, self.place >= 1)
        self.new = new

    def logs(self, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By token: training count, log10 of the base probability and of the tree's."""
        c = self.total[self.word]
        base = (c + ADD) / (rule.total + ADD * (rule.known + 1))
        prob = base.copy()
        for x in self.levels:
            context = x.context[x.at]
            use = np.flatnonzero(x.types[context])
            at, t = x.places[use], x.types[context[use]]
            prob[at] = (x.total[x.at[use]] + t * prob[at]) / (x.n[context[use]] + t)
        return c, np.log10(base), np.log10(prob)


def exchange(asked: DataFrame, answer: Callable[[pa.Table], pa.Table], level: int, route: Route | None) -> tuple[DataFrame, DataFrame]:
    """What the parts answer to the messages ``block, p, body`` (columns of ``ANSWERS``), and the part of it that goes back to blocks, as it reaches them: ``block, level, p, body``, or ``block, level, keys, bodies`` along a route."""
    if route is None:
        out = settle(asked.groupBy("p").applyInArrow(answer, ANSWERS))
        return out, out.where("block IS NOT NULL").select("block", "level", "p", "body")

    def packed(by_block: bool):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                block, p = b.column("block").to_numpy(), b.column("p").to_numpy().astype(np.int64)
                yield from route.rows(*((block, p) if by_block else (p, block)), b.column("body"), by_block).to_batches()

        return of

    def of_part(group: pa.Table) -> pa.Table:
        p, block, bodies = opened(group)
        return answer(pa.table({"block": block, "p": pa.array(p, pa.int32()), "body": bodies}))

    def of_blocks(group: pa.Table) -> pa.Table:
        t = route.turned(group, False)
        return pa.table([t["at"], pa.array([level] * len(t), pa.int32()), t["keys"], t["bodies"]], names=["block", "level", "keys", "bodies"])

    there = asked.select("block", "p", "body").mapInArrow(packed(True), Route.SENT).groupBy("batch", "c").applyInArrow(lambda group: route.turned(group, True), Route.SENT)
    out = settle(there.groupBy("at").applyInArrow(of_part, ANSWERS))
    back = out.where("block IS NOT NULL").select("block", "p", "body").mapInArrow(packed(False), Route.SENT)
    return out, settle(back.groupBy("batch", "c").applyInArrow(of_blocks, "block long, level int, keys array<long>, bodies array<binary>"))


def score(docs: DataFrame, train: str | Column, key: str = "doc_id", text: str = "text", depth: int = DEPTH, min_count: int = MIN_COUNT, min_divergence: float = MIN_DIVERGENCE, fan: int = FAN) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document; ``train``: those to learn from; ``fan``: parts up to which messages go in one step."""
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    mark = F.coalesce(docs[train] if isinstance(train, str) else train, F.lit(False)).alias("train")
    docs = docs.select(docs[key].alias("doc_id"), docs[text].cast("string").alias("text"), mark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rule = Rule(max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART), depth, min_count, min_divergence)
    route = Route.between(size // BLOCK, rule.parts) if rule.parts > fan else None
    sent = settle(blocks(docs, rule.parts))
    texts = sent.where("p = -1").select("block", "body", "ids", "train")
    words, back = exchange(sent.where("p >= 0").select("block", "p", "body"), number_words, 0, route)
    known = [back]
    # One row: distinct words and tokens.
    rule.known, rule.total = (x or 0 for x in words.where("block IS NULL").agg(F.sum("types"), F.sum("n")).first())

    def replies() -> DataFrame:
        out = known[0]
        for more in known[1:]:
            out = out.unionByName(more)
        return out

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        own = Texts(left, right, rule)
        rows = own.new.sent(np.repeat(left["train"].combine_chunks().flatten().to_numpy(zero_copy_only=False), own.lens))
        return pa.table({"block": pa.array([left["block"][0].as_py()] * len(rows), pa.int64()), "p": pa.array([r[0] for r in rows], pa.int32()), "body": pa.array([r[1] for r in rows], pa.binary())})

    def tested(level: int):
        return lambda group: test_contexts(group, level, rule)

    for level in range(1, depth + 1):
        asked = texts.groupBy("block").cogroup(replies().groupBy("block")).applyInArrow(ask, "block long, p int, body binary")
        out, back = exchange(asked, tested(level), level, route)
        known.append(back)
        sums = out.where("block IS NULL").groupBy("context").agg(F.max("above").alias("above"), *(F.sum(c).alias(c) for c in ("types", "n", "term"))).orderBy("context")
        c, above, types, n, term = (x.to_numpy() for x in sums.toArrow().columns)  # four contexts a part at most
        rule.dealt[level] = c, rule.states(types, n, above, term.astype(float))

    def of(left: pa.Table, right: pa.Table) -> pa.Table:
        own = Texts(left, right, rule)
        c, base, model = own.logs(rule)
        start = _bpe.starts_of(own.lens)
        sums = [own.lens, np.add.reduceat((c > 0).astype(np.int64), start), np.full(len(start), rule.total), np.add.reduceat(base, start), np.add.reduceat(model, start)]
        ids, marks = left["ids"].combine_chunks().flatten(), left["train"].combine_chunks().flatten()
        return pa.table([ids, pc.invert(marks), *map(pa.array, sums)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.groupBy("block").cogroup(replies().groupBy("block")).applyInArrow(of, schema)


def op1_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), id_fold("doc_id", 10) != 0)
