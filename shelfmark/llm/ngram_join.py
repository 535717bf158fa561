"""N-gram Jaccard join by a partition of the universe and the pigeonhole principle.

A document's set holds its distinct five-word shingles, as 64-bit hashes. Two sets whose Jaccard similarity is 0.75 or more differ in at most H = 2n/7 elements, n being
the larger size. Hashing splits the universe into segments, as many as the size band (a power of two) asks for. If a budget b of 0, 1 or 2 is
given to each segment of the larger set and the budgets sum to more than H, some segment differs in fewer elements than its budget: it is the
same in both (b = 1), or one deletion apart (b = 2). So every set is indexed by all its segments, in its own band and, if a
set of the next band can still be similar, in that one; and every set asks for the segments that its budget covers.

Budgets go where they are cheapest: a sketch counts how many sets of the corpus hold a segment's content, so passages that many
documents share get no budget while other segments suffice. One-deletion neighbourhoods are indexed in small bands, where they are cheap, and in bands in which some
document's segments can't sum to more than H without; a document that even so falls short is compared with its whole band. Any choice of budgets gives the same pairs in the end.
Where single budgets go to C segments, C - H of them at least are equal in both sets, and pairs that agree in fewer are no candidates.

Signatures travel packed, a row for each batch of documents and partition. Where there are more than ``FAN`` partitions, a batch sends a row to each of ``FAN`` coarse ones instead, and
tasks of these deal them on, as much as ``RELAY`` bytes at once: up to FAN * FAN partitions, rows grow with the text and not with its square. Signature groups of up to ``SMALL`` sets give all their pairs; larger ones first give pairs with a few leaders
only, and once these are verified and joined into components, just the pairs that cross components. The latter are compared in blocks of members by parity bitmaps: the bits in which
two sets' bitmaps differ are no more than the elements in which the sets do, so that a pair with more than (n + n') / 7 of them has no link, and only the others become rows.
Candidates are verified exactly on the whole sets; copies share one set and are represented once.

Defined cases: null and blank texts have an empty set and are linked with nothing; a text of fewer than five words is one shingle; every row is a document of its own, also where
a doc_id repeats with the same or another text; rows of a null doc_id link like others, and a component has the smallest id that is not null, or null if it has none; other columns,
whatever their names, don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.graph import connected_components
from shelfmark.session import drop_settled, settle

from . import _bpe
from ._shared import BLANKS, slices, table

WIDTH = 5
#: Bands below this one index one-deletion neighbourhoods; sketch of 2**SKETCH counters; groups up to SMALL give all pairs, larger ones those with LEADERS sets first.
#: Budget beyond H + 1, so that several segments must agree.
#: CHEAP is how many sets beyond the sketch's mean may hold a segment that gets a further budget.
SMALL_BANDS, SKETCH, SMALL, LEADERS, MORE, CHEAP = 6, 21, 48, 4, 24, 12
U = np.uint64
#: Bytes of text that a task handles at once.
AT_ONCE = 5_000_000
INDEX, ASK = 1, 2
#: Elements of sets in a part of the signature exchange, so that its groups do not grow with the corpus.
PART = 4_000_000
#: Rows that a batch of signatures is dealt to at most in one step, and bytes of signatures that a task between two steps deals on at once; partitions for each such task.
FAN, RELAY, RELAYED = 4096, 32_000_000, 8
#: Bits of a set's parity bitmap are 2**MARK; members of a large group are compared by pairs of blocks of about BLOCK members; CELLS pairs are compared at once.
MARK, BLOCK, CELLS = 11, 2048, 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles."""
    words, codes, per = _bpe.split_words(pc.ascii_lower(texts.cast(pa.large_string()).fill_null("")))
    hashes = np.array([xxhash.xxh3_64_intdigest(w) if w else 0 for w in words.to_pylist()], dtype=np.uint64)
    empty = hashes[codes] == 0 if len(codes) else np.zeros(0, dtype=bool)
    flat = hashes[codes][~empty] if len(codes) else np.zeros(0, dtype=np.uint64)
    ends = np.cumsum(per)
    blank = np.append(0, np.cumsum(empty))
    per = per - (blank[ends] - blank[ends - per])
    at = _bpe.starts_of(per)
    n = np.maximum(per - WIDTH + 1, 0)
    idx = _bpe.take_runs(at, n)
    h = np.full(len(idx), U(WIDTH))
    for k in range(WIDTH):
        h = mix(h * U(0x9E3779B97F4A7C15) + flat[idx + k])
    out, first = [], _bpe.starts_of(n)
    for i in range(len(per)):
        if n[i]:
            out.append(np.unique(h[first[i] : first[i] + n[i]]))
        else:
            x = np.array([per[i]], dtype=np.uint64)
            for w in flat[at[i] : at[i] + per[i]]:
                x = mix(x * U(0x9E3779B97F4A7C15) + w)
            out.append(x[: min(1, per[i])])
    return out


def key_of(own: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes()))))


def parity(own: np.ndarray) -> bytes:
    """A bit for each of 2**MARK cells: whether it holds an odd number of elements."""
    at = (mix(own ^ U(0x3C3C)) >> U(64 - MARK)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=1 << MARK) & 1).astype(np.uint8)).tobytes()


def segments_in(band: np.ndarray) -> np.ndarray:
    """Number of segments by band: four times the least size in small bands, so that few elements share a segment, else that size."""
    return np.where(band < SMALL_BANDS, 4 << band, 1 << band)


class Segmented:
    """The segments of many sets, each set under the band given for it; -1 leaves a set out."""

    def __init__(self, sets: list[np.ndarray], band: np.ndarray):
        use = np.flatnonzero(band >= 0)
        self.size = np.array([len(sets[i]) for i in use], dtype=np.int64)
        flat = np.concatenate([sets[i] for i in use]) if len(use) else np.zeros(0, dtype=np.uint64)
        owner = np.repeat(np.arange(len(use)), self.size)
        m = segments_in(band[use])
        seg = ((mix(flat ^ U(0xA5A5)) >> U(20)) % m[owner].astype(np.uint64)).astype(np.int64)
        place = owner * (int(m.max()) if len(m) else 1) + seg
        order = np.argsort(place, kind="stable")
        place, element = place[order], mix(flat[order])
        new = np.append(True, place[1:] != place[:-1]) if len(place) else np.zeros(0, dtype=bool)
        self.at = np.flatnonzero(new)
        self.count = np.diff(np.append(self.at, len(place)))
        self.element = element
        self.owner = owner[order][self.at]  # among the sets in use
        self.doc, self.band = use[self.owner], band[use][self.owner]
        self.content = np.add.reduceat(element, self.at) if len(self.at) else np.zeros(0, dtype=np.uint64)
        self.label = mix((self.band.astype(np.uint64) << U(40)) + seg[order][self.at].astype(np.uint64) + U(1))
        self.full = mix(self.content ^ self.label)
        self.longer = mix(self.content ^ self.label ^ U(0xD1D1))  # of sets with one element more
        self.sets, self.use = len(use), use

    def shorter(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each element of the chosen segments: segment, signature without it, and that in the sense of ``longer``."""
        which = np.flatnonzero(chosen & (self.count > 1))
        n = self.count[which]
        src = np.repeat(which, n)
        left = self.content[src] - self.element[_bpe.take_runs(self.at[which], n)]
        return src, mix(left ^ self.label[src]), mix(left ^ self.label[src] ^ U(0xD1D1))


def bands_of(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each size's own band, and the next one where a similar larger set can be in it; -1 for none."""
    own = np.where(size > 0, np.floor(np.log2(np.maximum(size, 1) + 0.5)).astype(np.int64), -1)
    return own, np.where((own >= 0) & (4 * size >= 3 * (2 << np.maximum(own, 0))), own + 1, -1)


def shortage(s: Segmented) -> np.ndarray:
    """For each set in use: 0 if single budgets exceed H, 1 if double ones are needed, 2 if these fall short as well."""
    one = np.bincount(s.owner, minlength=s.sets)
    two = np.bincount(s.owner, weights=s.count > 1, minlength=s.sets).astype(np.int64)
    need = 2 * s.size // 7 + 1
    return (one < need).astype(np.int64) + (one + two < need)


def budgets(s: Segmented, cost: np.ndarray, deep: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which segments get a budget, and which a double one, by increasing cost until the sum exceeds H, and further ones (MORE at most) that cost no more than ``limit``; by set how many must agree."""
    twice = np.flatnonzero((s.count > 1) & deep)
    price = np.concatenate([cost, cost[twice] * (1 + s.count[twice])])
    seg = np.concatenate([np.arange(len(cost)), twice])
    order = np.lexsort((np.arange(len(seg)), price, s.owner[seg]))
    per = np.bincount(s.owner[seg], minlength=s.sets)
    rank = np.arange(len(seg)) - np.repeat(_bpe.starts_of(per), per)
    single = np.bincount(s.owner, minlength=s.sets)
    h = 2 * s.size // 7
    # Single budgets on C segments leave C - H of them equal at least; a signature may collide, so one less is asked for.
    cheap = np.bincount(s.owner, weights=cost <= limit, minlength=s.sets).astype(np.int64)
    most = np.where(single > h, np.maximum(np.minimum(cheap, h + MORE), h + 1), h + 1)
    picked = order[rank < most[s.owner[seg[order]]]]
    got = np.zeros(len(seg), dtype=bool)
    got[picked] = True
    double = np.zeros(len(cost), dtype=bool)
    double[twice] = got[len(cost) :]
    need = np.where(np.bincount(s.owner, weights=double, minlength=s.sets) > 0, 1, np.maximum(1, most - h - 1))
    return got[: len(cost)], double, need


def signatures(sets: list[np.ndarray], sketch: np.ndarray, short: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, signature, flags) of all that the sets index and ask for, and by document how many asked signatures a partner must have. ``short``: the worst shortage by band."""
    size = np.array([len(x) for x in sets], dtype=np.int64)
    own, upper = bands_of(size)
    level = np.array([max(short.get(b, 0), b < SMALL_BANDS) for b in range(66)])
    doc, sig, flag = [], [], []
    needs = np.ones(len(sets), dtype=np.int64)

    def put(d, x, f):
        doc.append(d), sig.append(x), flag.append(np.full(len(d), f) if np.isscalar(f) else f)

    for band, asks in ((own, True), (upper, False)):
        s = Segmented(sets, band)
        deep = level[s.band] > 0
        if asks:
            ask, double, needs[s.use] = budgets(s, sketch[(s.full >> U(64 - SKETCH)).astype(np.int64)], deep, CHEAP + sketch.mean())
            put(s.doc, s.full, np.where(ask, INDEX | ASK, INDEX))
            put(s.doc[double], s.longer[double], ASK)
            src, near, _ = s.shorter(double)
            put(s.doc[src], near, ASK)
            lost = shortage(s) == 2
            every = s.use[lost]
            needs[every] = 1
            put(every, mix(band[every].astype(np.uint64) + U(0xA110000)), ASK)
        else:
            put(s.doc, s.full, INDEX)
        src, _, near = s.shorter(deep)
        put(s.doc[src], near, INDEX)
        every = s.use[level[band[s.use]] == 2]
        put(every, mix(band[every].astype(np.uint64) + U(0xA110000)), INDEX)
    return np.concatenate(doc), np.concatenate(sig), np.concatenate(flag), needs


def survey(docs: DataFrame) -> DataFrame:
    """First pass over ``doc_id, text, t1, t2``: a row per document (``doc_id, t1, t2, n, key, bits``), and per task counters of the sketch and the shortages by band."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, short, id_type = np.zeros(1 << SKETCH, dtype=np.int64), {}, None
        names = ["doc_id", "t1", "t2", "n", "key", "bits", "chunk", "counters"]

        def rows(ids, t1, t2, n, key, bits, chunk, counters):
            return pa.RecordBatch.from_arrays([ids, pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(bits, pa.binary()), pa.array(chunk, pa.int32()), pa.array(counters, pa.binary())], names)

        for batch in slices(batches, 1, AT_ONCE):
            id_type = batch.column(0).type
            if not len(batch):
                continue
            sets = shingle_sets(batch.column(1))
            size = np.array([len(x) for x in sets], dtype=np.int64)
            own, upper = bands_of(size)
            for band in (own, upper):
                s = Segmented(sets, band)
                counts += np.bincount((s.full >> U(64 - SKETCH)).astype(np.int64), minlength=1 << SKETCH)
                if band is own and s.sets:
                    for b, x in zip(band[s.use].tolist(), shortage(s).tolist(), strict=True):
                        short[b] = max(short.get(b, 0), x)
            none = [None] * len(sets)
            yield rows(batch.column(0), batch.column(2), batch.column(3), size, [key_of(x) if len(x) else None for x in sets], [parity(x) if len(x) else None for x in sets], none, none)
        parts = [(i, np.minimum(c, 65535).astype("<u2").tobytes()) for i, c in enumerate(counts.reshape(64, -1)) if c.any()]
        parts += [(-1 - b, np.array([x], dtype="<i4").tobytes()) for b, x in short.items()]
        if parts:
            n = len(parts)
            yield rows(pa.array([None] * n, id_type), *[[None] * n] * 5, [p[0] for p in parts], [p[1] for p in parts])

    return docs.mapInArrow(of, f"doc_id {kind}, t1 long, t2 long, n long, key long, bits binary, chunk int, counters binary")


def merged_counters(surveyed: DataFrame) -> tuple[np.ndarray, dict[int, int]]:
    """The sketch and the worst shortage by band: of fixed size, whatever the corpus."""

    def of(group: pa.Table) -> pa.Table:
        c = group["chunk"][0].as_py()
        parts = [np.frombuffer(x, dtype="<i4" if c < 0 else "<u2") for x in group["counters"].to_pylist()]
        total = np.max(parts, axis=0) if c < 0 else np.minimum(np.sum(parts, axis=0, dtype=np.int64), 2**31 - 1)
        return pa.table({"chunk": pa.array([c], pa.int32()), "counters": pa.array([total.astype("<i4").tobytes()], pa.binary())})

    rows = surveyed.where("chunk IS NOT NULL").select("chunk", "counters").groupBy("chunk").applyInArrow(of, "chunk int, counters binary").collect()
    sketch = np.zeros((64, (1 << SKETCH) // 64), dtype=np.int64)
    for r in rows:
        if r["chunk"] >= 0:
            sketch[r["chunk"]] = np.frombuffer(r["counters"], dtype="<i4")
    return sketch.ravel(), {-1 - r["chunk"]: int(np.frombuffer(r["counters"], dtype="<i4")[0]) for r in rows if r["chunk"] < 0}


SENT = "p int, salt int, places binary, keys binary, sizes binary, needs binary, counts binary, sigs binary"


def parcels(to: np.ndarray, places: np.ndarray, keys: np.ndarray, sizes: np.ndarray, needs: np.ndarray, counts: np.ndarray, sigs: np.ndarray, salts: int = 1) -> pa.RecordBatch:
    """A row for each run of equal ``to``: partition, key, size and need of its sets and their numbers of signatures, and these one after the other."""
    cut, at = np.append(_bpe.runs_of(to), len(to)), np.append(0, np.cumsum(counts))
    types = ("<i4", "<i8", "<i4", "<u1", "<i4")
    columns = [x.astype(t) for x, t in zip((places, keys, sizes, needs, counts), types, strict=True)]
    ends = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
    cols = [pa.array([x[a:b].tobytes() for a, b in ends], pa.binary()) for x in columns]
    body = pa.array([sigs[at[a] : at[b]].tobytes() for a, b in ends], pa.binary())
    salt = pa.array((keys[cut[:-1]].astype(np.int64) % salts).astype(np.int32)) if len(to) else pa.array([], pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(to[cut[:-1]].astype(np.int32)), salt, *cols, body], [c.split()[0] for c in SENT.split(", ")])


def relay(rows: list[tuple]) -> pa.RecordBatch:
    """The sets and signatures of rows ``places, keys, sizes, needs, counts, sigs``, dealt on to their partitions."""
    types = ("<i4", "<i8", "<i4", "<u1", "<i4", "<u4")
    places, keys, sizes, needs, counts, sigs = (np.frombuffer(b"".join(x), dtype=t) for x, t in zip(zip(*rows, strict=True), types, strict=True))
    order = np.argsort(places, kind="stable")
    own = _bpe.take_runs(_bpe.starts_of(counts)[order], counts[order])
    return parcels(places[order], places[:0], keys[order], sizes[order], needs[order], counts[order], sigs[own])


def relayed(sent: DataFrame, tasks: int) -> DataFrame:
    """Rows of coarse partitions dealt on to their partitions; a coarse one's rows are spread over tasks by ``salt``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(2, 8)), strict=True):
                held.append(row)
                size += sum(map(len, row))
                if size >= RELAY:
                    yield relay(held)
                    held, size = [], 0
        if held:
            yield relay(held)

    return sent.repartition(tasks, "p", "salt").mapInArrow(of, SENT)


def packed(docs: DataFrame, sketch: np.ndarray, short: dict[int, int], parts: int) -> DataFrame:
    """Second pass: signatures of each batch by partition; 30 bits of a signature and its flags in four bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch.astype(np.int32))
    fan = min(parts, FAN)
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, parts // RELAYED)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, AT_ONCE):
            sets = shingle_sets(batch.column(1)) if len(batch) else []
            # Copies within the batch ask and are indexed once.
            keys = np.array([key_of(x) if len(x) else 0 for x in sets], dtype=np.int64)
            _, first = np.unique(keys, return_index=True)
            sets, keys = [sets[i] for i in first], keys[first]
            if not any(len(x) for x in sets):
                continue
            size = np.array([len(x) for x in sets], dtype=np.int32)
            doc, sig, flag, needs = signatures(sets, shared.value.astype(np.int64), short)
            p = (sig % U(parts)).astype(np.int64)
            order = np.lexsort((doc, p, p % fan))
            doc, p = doc[order], p[order]
            small = ((((sig[order] >> U(32)) << U(2)) & U(0xFFFFFFFC)) | flag[order].astype(np.uint64)).astype("<u4")
            at = _bpe.runs_of(p, doc)
            own, place = doc[at], p[at]
            yield parcels(place % fan, place if parts > fan else place[:0], keys[own], size[own], needs[own], np.diff(np.append(at, len(p))), small, -(-tasks // fan))

    sent = docs.mapInArrow(of, SENT)
    return (relayed(sent, tasks) if parts > fan else sent).drop("places", "salt")


def feasible(na, nb, fa, fb) -> np.ndarray:
    """Sizes allow 0.75, and the larger set asks for what the smaller one has indexed."""
    sizes = 4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb)
    return sizes & (((na >= nb) & (fa & ASK > 0) & (fb & INDEX > 0)) | ((nb >= na) & (fb & ASK > 0) & (fa & INDEX > 0)))


PAIRS = "a long, b long, gid long, n int, flag int, need int"


def tallied(parts: list[np.ndarray]) -> np.ndarray:
    """Rows (a, b, need, n) with one row for each pair: its least need and the sum of n."""
    x = np.concatenate(parts) if parts else np.zeros((0, 4), dtype=np.int64)
    x = x[np.lexsort((x[:, 1], x[:, 0]))]
    at = np.flatnonzero(np.append(True, (x[1:, :2] != x[:-1, :2]).any(axis=1))) if len(x) else np.zeros(0, dtype=np.int64)
    return np.column_stack([x[at, :2], np.minimum.reduceat(x[:, 2], at), np.add.reduceat(x[:, 3], at)]) if len(x) else x


def group_pairs(group: pa.Table) -> pa.Table:
    """Candidates of one partition: rows (a, b, n) with a < b and the number n of signatures they agree in, and rows (a, gid, n, flag) for the members of large groups in which someone asks."""
    join = lambda c, t: np.concatenate([np.frombuffer(x, dtype=t) for x in group[c].to_pylist()])
    keys, sizes, needs, counts, sigs = join("keys", "<i8"), join("sizes", "<i4"), join("needs", "<u1"), join("counts", "<i4"), join("sigs", "<u4")
    p = group["p"][0].as_py()
    node, size, need = np.repeat(keys, counts), np.repeat(sizes, counts).astype(np.int64), np.repeat(needs, counts).astype(np.int64)
    sig, flag = sigs >> 2, (sigs & 3).astype(np.int64)
    order = np.argsort(sig, kind="stable")
    again = np.append(True, sig[order][1:] != sig[order][:-1])
    many = np.diff(np.append(np.flatnonzero(again), len(order)))
    order = order[np.repeat(many > 1, many)]  # most signatures are one set's
    order = order[np.lexsort((node[order], sig[order]))]
    sig, node, size, flag, need = sig[order], node[order], size[order], flag[order], need[order]
    new = np.append(True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])) if len(sig) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(new)
    flag = np.bitwise_or.reduceat(flag, at) if len(at) else flag
    sig, node, size, need = sig[at], node[at], size[at], need[at]
    start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, dtype=np.int64)
    g = np.diff(np.append(start, len(sig)))
    pairs = []

    def offer(i, j):
        ok = feasible(size[i], size[j], flag[i], flag[j])
        i, j = i[ok], j[ok]
        least = np.where(size[i] > size[j], need[i], np.where(size[j] > size[i], need[j], np.minimum(need[i], need[j])))
        pairs.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), least, np.ones(len(i), dtype=np.int64)], axis=1))

    asked = np.bitwise_or.reduceat(flag, start) & ASK > 0 if len(start) else np.zeros(0, dtype=bool)
    for k in np.unique(g[asked & (g > 1) & (g <= SMALL)]).tolist():
        i, j = np.triu_indices(k, 1)
        base = start[asked & (g == k)]
        step = max(1, 1_000_000 // len(i))
        for s in range(0, len(base), step):
            own = base[s : s + step, None]
            offer((own + i).ravel(), (own + j).ravel())
        # Copies of a pair are counted as they come, so that no more than the distinct ones are held.
        pairs[:] = [tallied(pairs)]
    big = g > SMALL
    big &= asked
    member = _bpe.take_runs(start[big], g[big])
    lead_order = np.lexsort((mix(node[member].astype(np.uint64)), np.repeat(np.arange(big.sum()), g[big]))) if len(member) else member
    led = member[lead_order] if len(member) else member
    base = _bpe.starts_of(g[big]) if len(member) else np.zeros(0, dtype=np.int64)
    for leader in range(LEADERS if len(member) else 0):
        i = np.repeat(led[base + leader], g[big])
        offer(i[i != led], led[i != led])
    ab = tallied(pairs)
    n = ab[:, 3]
    none, m = [None] * len(ab), len(member)
    return pa.table({
        "a": pa.array(np.concatenate([ab[:, 0], node[member]])), "b": pa.concat_arrays([pa.array(ab[:, 1]), pa.nulls(m, pa.int64())]),
        "gid": pa.array([*none, *((p << 32) + sig[member].astype(np.int64)).tolist()], pa.int64()),
        "n": pa.array(np.concatenate([n, size[member]]).astype(np.int32)), "flag": pa.array([*none, *flag[member].tolist()], pa.int32()),
        "need": pa.array(np.concatenate([ab[:, 2], need[member]]).astype(np.int32)),
    })


def block_pairs(group: pa.Table) -> pa.Table:
    """Pairs (a, b, n, need) with a < b of different components, one from each of two blocks of a large group, that the bitmaps leave."""
    a, c, side = (group[x].to_numpy() for x in ("a", "c", "side"))
    size, flag, need = (group[x].to_numpy().astype(np.int64) for x in ("n", "flag", "need"))
    bits = np.frombuffer(b"".join(group["bits"].to_pylist()), dtype=np.uint64).reshape(len(a), -1)
    left, right = np.flatnonzero(side == group["x"][0].as_py()), np.flatnonzero(side == group["y"][0].as_py())
    same, out = group["x"][0].as_py() == group["y"][0].as_py(), []
    for at in range(0, len(left), 256):
        l, r = left[at : at + 256, None], right[None, :]
        ok = (c[l] != c[r]) & feasible(size[l], size[r], flag[l], flag[r])
        i, j = np.nonzero(ok & (a[l] < a[r]) if same else ok)
        i, j = left[at + i], right[j]
        for s in range(0, len(i), CELLS):
            x, y = i[s : s + CELLS], j[s : s + CELLS]
            near = 7 * np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) <= size[x] + size[y]
            x, y = x[near], y[near]
            least = np.where(size[x] > size[y], need[x], np.where(size[y] > size[x], need[y], np.minimum(need[x], need[y])))
            out.append(np.stack([np.minimum(a[x], a[y]), np.maximum(a[x], a[y]), np.ones(len(x), dtype=np.int64), least]))
    a, b, n, need = np.concatenate(out, axis=1) if out else np.zeros((4, 0), dtype=np.int64)
    return pa.table({"a": a, "b": b, "n": n, "need": need.astype(np.int32)})


def crossing(named: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs across the components of each large group, of which a member meets as many pairs of blocks as the group has blocks. ``marks``: key and bits."""
    sizes = named.groupBy("gid").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = marks.join(named.select(F.col("a").alias("key")).distinct(), "key", "left_semi").dropDuplicates(["key"]).withColumnRenamed("key", "a")
    rows = named.join(sizes, "gid").withColumn("side", F.pmod(F.xxhash64("a"), "blocks").cast("int"))
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("side", j).alias("x"), F.greatest("side", j).alias("y")))
    rows = rows.select("gid", "a", "n", "flag", "need", "c", "side", F.explode(met).alias("m")).select("*", "m.*").drop("m")
    return rows.join(own, "a").groupBy("gid", "x", "y").applyInArrow(block_pairs, "a long, b long, n long, need int")


def verified(pairs: DataFrame, docs: DataFrame, own: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose whole sets have a Jaccard similarity of 0.75 or more. ``own``: each key with the marks of one row that has the set."""
    nodes = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct().join(own, "key").select("t1", "t2")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, AT_ONCE):
            if len(batch):
                sets = shingle_sets(batch.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([key_of(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["key", "elements"])

    sets = docs.join(nodes, ["t1", "t2"], "left_semi").select("text").mapInArrow(of, "key long, elements binary").dropDuplicates(["key"])
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("elements").alias("ea")), "a").join(sets.select(F.col("key").alias("b"), F.col("elements").alias("eb")), "b")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                z = np.concatenate([x, y])
                z.sort()
                common = int((z[1:] == z[:-1]).sum())
                good.append(100 * common >= 75 * (len(z) - common))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "ea", "eb").mapInArrow(keep, "a long, b long")


def marked(documents: DataFrame, key: str, text: str) -> list[Column]:
    """``t1, t2``: 128 bits that tell the ids and texts of rows apart."""
    own = [documents[key].isNull(), documents[key], documents[text].isNull(), documents[text]]
    return [F.xxhash64(*own).alias("t1"), F.xxhash64(F.lit(1), *own).alias("t2")]


def members(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, t1, t2, n, c`` of every row: its marks, the size of its set and its component, null for an empty set."""
    spark = documents.sparkSession
    docs = documents.select(documents[key].alias("doc_id"), documents[text].cast("string").alias("text"), *marked(documents, key, text))
    surveyed = settle(survey(docs))
    sketch, short = merged_counters(surveyed)
    nodes = surveyed.where("chunk IS NULL").select("doc_id", "t1", "t2", "n", "key")
    own = nodes.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")).alias("row")).select("key", "row.t1", "row.t2")
    elements = nodes.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), elements // PART)
    found = settle(packed(docs.select("doc_id", "text"), sketch, short, parts).groupBy("p").applyInArrow(group_pairs, PAIRS))
    counted = found.where("b IS NOT NULL").groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("need").alias("need"))
    pairs = settle(counted.where("n >= need").select("a", "b"))
    links = settle(verified(pairs, docs, own))
    large = found.where("gid IS NOT NULL")
    if not large.isEmpty():
        comp = connected_components(links, "a", "b")
        named = large.join(comp, large["a"] == comp["id"], "left").select("gid", "a", "n", "flag", "need", F.coalesce("component", "a").alias("c"))
        mixed = named.groupBy("gid").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("gid")
        named = settle(named.join(mixed, "gid", "left_semi"))
        cross = crossing(named, surveyed.where("key IS NOT NULL").select("key", "bits"))
        # What a pair agrees in outside the large groups counts as well.
        cross = cross.unionByName(counted.where("n < need")).groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("need").alias("need"))
        more = settle(cross.where("n >= need").select("a", "b").join(pairs, ["a", "b"], "left_anti"))
        if not more.isEmpty():
            links = settle(links.unionByName(verified(more, docs, own)))
    comp = connected_components(links, "a", "b")
    for done in (found, pairs):
        drop_settled(done)
    return nodes.join(comp, nodes["key"] == comp["id"], "left").select("doc_id", "t1", "t2", "n", F.coalesce("component", "key").alias("c"))


def join(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    named = members(documents, key, text)
    low = named.where("c IS NOT NULL").groupBy("c").agg(F.min("doc_id").alias("low"))
    out = named.join(low, "c", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("component_id"))


def one_of_each(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of one row of each component, and all rows without words.

    It is the row of the smallest id; null ids come last, and where an id repeats, the smallest marks and then the smallest row decide. Rows that agree in id and text
    are combined where they are read, so that no number of copies meets in one task.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2"))
    best = members(documents, key, text).where("c IS NOT NULL").groupBy("c").agg(first.alias("row")).select("row.t1", "row.t2")
    wordless = F.btrim(F.coalesce(documents[text].cast("string"), F.lit("")), F.lit(BLANKS)) == ""
    rows = documents.where(~wordless).select(F.struct(*documents.columns).alias("row"), *marked(documents, key, text))
    rows = rows.groupBy("t1", "t2").agg(F.min("row").alias("row"))
    return rows.join(best, ["t1", "t2"], "left_semi").select("row.*").unionByName(documents.where(wordless))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
