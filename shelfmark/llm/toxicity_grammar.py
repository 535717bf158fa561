"""Toxicity: a weighted grammar of clauses, composed from small transducers.

Words are runs of letters, in lower case; marks end clauses. Each word has a class: an insult (with a weight), a threat, a target, a negation, a word or mark of reported speech, or none. Five transducers read
the same classes, each with its own few states: one knows whether an insult was met, one whether a threat is aimed, one whether someone is addressed near by, one whether a negation stands before, one whether
the speech is another's. Their product is one automaton, composed once; a clause runs through it and ends in a state that says what kind of match it is. Clauses are scored, not words: the sum of a
clause's insult weights counts under the kind of the clause, and repeated insults of one clause count less and less.

Insults are learned: units are whole words and beginnings of words (``PREFIXES``), which stand for a stem with any ending. A unit's evidence is the number of different neighbourhoods (the words before
and after) that it has in toxic texts, against its occurrences in others: copies of a text add nothing, so that a word that just stands in a text with many copies does not look toxic. A whole word with evidence of its own
goes by that, another by its best beginning. The kinds' factors are those of a logistic regression on the clause sums of labelled texts, drawn towards ``PRIOR``: what the labels don't tell stays there.

The fit uses a bounded sample of labelled texts (``SAMPLE``, by hash of the id); units are counted by Spark, and at most ``UNITS`` of the strongest make the lexicon, which is a parameter's bound and not the
corpus's. Every whole text is scored where it is read: the set of its words tells whether any clause can match, and only such texts are cut into clauses.

Defined cases: a null text is empty; texts without a match get the score of no evidence, empty ones too; labels of absent documents, null labels and repeated labels beyond the first (smallest) are left out; of a
labelled id with several texts the smallest is learned from; with labels of one kind only, every score is that share, smoothed; repeated rows are scored each; other columns, whatever their names, don't
matter; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import id_fold, slices, table

SAMPLE, UNITS, SEED = 20_000, 20_000, 29
#: Lengths of beginnings; longest word that is a unit of its own.
PREFIXES, LONGEST = range(3, 9), 40
#: A unit needs so many neighbourhoods in toxic texts, so large a weight (log of the ratio of rates) and so many standard errors; a whole word of EVIDENCE occurrences goes by its own weight.
SUPPORT, LEAST, ERRORS, EVIDENCE = 5, 1.5, 5.0, 8
#: Bytes of text that a task handles at once; units that a task holds before it passes their counts on.
AT_ONCE, HELD = 4_000_000, 600_000

WORD = re.compile(r"[^\W\d_]+")
#: Words with their places, marks that end a clause, and quotation marks.
TOKEN = re.compile(r"([^\W\d_]+)|([.!?;:,\n|()])|([\"“”«»„])")
NONE, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)
#: Word lists of the grammar's closed classes in four languages: fixed values.
CLOSED = {
    THREAT: "kill hurt destroy beat smash crush punish töten umbringen verletzen schlagen vernichten tuer frapper détruire écraser matar golpear destruir aplastar",
    TARGET: "you your yours yourself he she him her they them du dich dir dein deine ihr euch er sie tu te toi ton ta vous votre il elle ils elles tú ti usted ustedes él ella ellos ellas",
    NEGATION: "not no never nobody nothing neither nor without isn aren wasn don doesn nicht kein keine keinen nie niemals niemand ohne pas jamais aucun aucune rien sans nunca jamás nadie nada ningún ninguna sin",
    REPORT: "said says say told tells called calls wrote writes quoted claimed sagte sagt sagen nannte schrieb behauptete dit disait appelle appela écrit prétend dijo dice llamó llama escribió",
}
CLASS = {w: k for k, words in CLOSED.items() for w in words.split()}


@dataclass(frozen=True)
class Transducer:
    """States 0 to ``n`` - 1, from 0 on; ``moves`` maps (state, class) to a state, other classes leave it."""

    n: int
    moves: dict[tuple[int, int], int]

    def step(self, state: int, kind: int) -> int:
        return self.moves.get((state, kind), state)


INSULTS = Transducer(2, {(0, INSULT): 1})
#: 1: a threat, 2: someone after or before it.
THREATS = Transducer(4, {(0, THREAT): 1, (0, TARGET): 3, (3, THREAT): 2, (1, TARGET): 2})
TARGETS = Transducer(2, {(0, TARGET): 1})
#: A negation counts for what follows it: 1 it stands, 2 an insult or threat came after it, 3 one came before.
NEGATIONS = Transducer(4, {(0, NEGATION): 1, (1, INSULT): 2, (1, THREAT): 2, (0, INSULT): 3, (0, THREAT): 3})
REPORTS = Transducer(2, {(0, REPORT): 1, (0, QUOTE): 1})


def composed(parts: tuple[Transducer, ...], classes: int = 7) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """The product automaton: a table of next states by state and class, and what each state is made of."""
    states = list(product(*(range(p.n) for p in parts)))
    number = {s: i for i, s in enumerate(states)}
    moves = np.array([[number[tuple(p.step(x, k) for p, x in zip(parts, s, strict=True))] for k in range(classes)] for s in states])
    return moves, states


MOVES, STATES = composed((INSULTS, THREATS, TARGETS, NEGATIONS, REPORTS))
STEP = MOVES.tolist()
#: Kinds of clauses. A state without an insult or an aimed threat has none.
PLAIN, TARGETED, NEGATED, REPORTED, THREATENING = range(5)


def kind_of(state: tuple[int, ...]) -> int:
    insult, threat, target, negation, report = state
    if not insult and threat != 2:
        return -1
    if report:
        return REPORTED
    if negation == 2:
        return NEGATED
    if threat == 2:
        return THREATENING
    return TARGETED if target else PLAIN


KINDS = [kind_of(s) for s in STATES]
#: What a clause of each kind counts before labels are seen.
PRIOR = np.array([1.0, 1.2, 0.5, 0.7, 1.2])
THREAT_WEIGHT = 2.0


@dataclass
class Grammar:
    """Weights of whole words and of beginnings; factors and constants of the score."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    factors: np.ndarray = field(default_factory=lambda: np.zeros(len(PRIOR) + 3))
    seen: dict[str, float] = field(default_factory=dict, repr=False)

    def weight(self, word: str) -> float:
        """0 for words that are no insult."""
        w = self.words.get(word)
        if w is not None:
            return w
        return max((self.stems.get(word[:k], 0.0) for k in PREFIXES if len(word) >= k), default=0.0)

    def insults(self, words: set[str]) -> dict[str, float]:
        """The insults among the words, by what is remembered of earlier texts."""
        if len(self.seen) > 500_000:
            self.seen.clear()
        seen, out = self.seen, {}
        for w in words:
            x = seen.get(w)
            if x is None:
                x = seen[w] = self.weight(w)
            if x > 0:
                out[w] = x
        return out

    def features(self, text: str) -> np.ndarray:
        """Sums of clauses by kind, as logarithms, then the strongest weight and the logarithm of matched clauses per hundred words."""
        out = np.zeros(len(self.factors) - 1)
        low = text.lower()
        words = WORD.findall(low)
        insults = self.insults(set(words))
        if not insults and not any(w in CLASS and CLASS[w] == THREAT for w in words):
            return out
        state = matched = 0
        weights: list[float] = []
        best = 0.0

        def close() -> None:
            nonlocal matched, best
            kind = KINDS[state]
            if kind >= 0:
                ordered = sorted(weights, reverse=True) or [THREAT_WEIGHT]
                out[kind] += sum(w * 0.5**i for i, w in enumerate(ordered[:8]))
                best = max(best, ordered[0])
                matched += 1

        for m in TOKEN.finditer(low):
            word = m[1]
            if word is None:
                if m[2]:
                    close()
                    state, weights = 0, []
                else:
                    state = STEP[state][QUOTE]
                continue
            w = insults.get(word)
            if w is not None:
                state = STEP[state][INSULT]
                weights.append(w)
            elif word in CLASS:
                state = STEP[state][CLASS[word]]
        close()
        if matched:
            out[: len(PRIOR)] = np.log1p(out[: len(PRIOR)])
            out[len(PRIOR) :] = best, np.log1p(100.0 * matched / max(10, len(words)))
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.factors[:-1] + self.factors[-1], -30, 30)))


def units_of(words: list[str]) -> Iterator[tuple[str, int]]:
    """(unit, place) for every word: ``=word``, and beginnings."""
    for i, w in enumerate(words):
        if len(w) <= LONGEST:
            yield "=" + w, i
        for k in PREFIXES:
            if len(w) < k:
                break
            yield w[:k], i


def evidence(sample: DataFrame) -> DataFrame:
    """``unit, mask, n, clean`` from ``label, text``: neighbourhoods in toxic texts as bits of 64, occurrences there, and occurrences in other texts."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])

        def passed() -> pa.RecordBatch:
            mask = np.array([x[0] for x in held.values()], dtype=np.uint64).view(np.int64)
            counts = [pa.array([x[i] for x in held.values()], pa.int64()) for i in (1, 2)]
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(mask), *counts], ["unit", "mask", "n", "clean"])
            held.clear()
            return out

        for b in slices(batches, 1, AT_ONCE):
            for label, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = WORD.findall((t or "").lower())
                if label:
                    # Python's hash of strings differs from worker to worker; this one does not.
                    codes = [sum(map(ord, w)) * 31 + len(w) for w in words]
                    for unit, i in units_of(words):
                        x = held[unit]
                        around = (codes[i - 1] if i else 0) * 0x9E3779B1 + (codes[i + 1] if i + 1 < len(words) else 0) * 0x85EBCA77
                        x[0] |= 1 << (((around ^ (around >> 15)) * 0x2C1B3C6D >> 12) & 63)
                        x[1] += 1
                else:
                    for unit, _ in units_of(words):
                        held[unit][2] += 1
                if len(held) > HELD:
                    yield passed()
        yield passed()

    rows = sample.select("label", "text").mapInArrow(of, "unit string, mask long, n long, clean long")
    return rows.groupBy("unit").agg(F.bit_or("mask").alias("mask"), F.sum("n").alias("n"), F.sum("clean").alias("clean"))


def weighed(units: DataFrame, toxic: int, clean: int, limit: int = UNITS) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of whole words and of beginnings from evidence, with the words of either kind of text in all. ``limit`` units at most come to the driver."""
    set_bits = F.bit_count("mask")
    # Different neighbourhoods by linear counting; a full mask holds as many as there are occurrences.
    kinds = F.when(set_bits >= 64, F.col("n")).otherwise(F.least(F.col("n"), -64 * F.log(1 - set_bits / 64.0)))
    u = units.where("n > 0").withColumn("a", kinds)
    rate = F.log((F.col("a") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    # The likelihood ratio of the two rates against one rate, as standard errors.
    share, both = toxic / (toxic + clean), F.col("a") + F.col("clean")
    part = lambda x, s: F.when(x > 0, x * F.log(x / (both * s))).otherwise(0.0)
    u = u.select("unit", "a", "clean", rate.alias("w"), F.sqrt(2 * F.greatest(F.lit(0.0), part(F.col("a"), share) + part(F.col("clean"), 1 - share))).alias("z"))
    best = u.where((F.col("a") >= SUPPORT - 0.5) & (F.col("w") >= LEAST) & (F.col("z") >= ERRORS)).orderBy(F.desc("z"), "unit").limit(limit).collect()
    stems = {r["unit"]: r["w"] for r in best if not r["unit"].startswith("=")}
    words = {r["unit"][1:]: r["w"] for r in best if r["unit"].startswith("=")}
    if stems:
        # Words under a stem that their own evidence calls harmless.
        calm = u.where(F.col("unit").startswith("=") & (both >= EVIDENCE) & (F.col("w") < LEAST))
        calm = calm.select("unit", "clean", F.explode(F.array_distinct(F.array(*(F.substring("unit", 2, k) for k in PREFIXES)))).alias("stem"))
        known = units.sparkSession.createDataFrame([(x,) for x in stems], "stem string")  # ``limit`` rows at most
        calm = calm.join(F.broadcast(known), "stem").select("unit", "clean").distinct().orderBy(F.desc("clean"), "unit").limit(limit)
        words |= {r["unit"][1:]: 0.0 for r in calm.collect()}
    return words, stems


def fitted(x: np.ndarray, y: np.ndarray, penalty: float = 2.0) -> np.ndarray:
    """Logistic regression with factors of the kinds drawn to ``PRIOR`` times a common strength, by Newton's method."""
    n, k = x.shape[0], len(PRIOR)
    # The first column is the sum of all kinds under the prior, the next ones what a kind differs from it.
    z = np.column_stack([x[:, :k] @ PRIOR, x, np.ones(n)])
    pull = np.array([0.01, *[penalty * 5] * k, *[penalty / 4] * (x.shape[1] - k), 0.001])
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + pull * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag(pull)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 3.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    factors = w[1:].copy()
    factors[:k] += w[0] * PRIOR
    return factors


def featured(rows: DataFrame, grammar: Grammar, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` and the list ``x`` of features for every row."""
    shared = rows.sparkSession.sparkContext.broadcast((grammar.words, grammar.stems, grammar.factors))  # ``UNITS`` entries at most of either kind
    kept = rows.select(*keep, rows[text].cast("string").alias("_text"))
    at = len(keep)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[:at])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(*shared.value)
        for b in slices(batches, at, AT_ONCE):
            x = np.array([g.features(t or "") for t in b.column(at).to_pylist()]).reshape(len(b), -1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * (x.shape[1] if len(b) else 0), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:at], lists, pa.array(g.score(x) if len(b) else [], pa.float64())], [*b.schema.names[:at], "x", "score"])

    return kept.mapInArrow(of, f"{fields}, x array<double>, score double")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Grammar:
    """Learn from the labelled documents, or from about ``sample`` of them where there are more."""
    y = labels.select(labels[key].alias("_key"), labels[label].cast("int").alias("label")).where("_key IS NOT NULL AND label IN (0, 1)")
    y = y.groupBy("_key").agg(F.min("label").alias("label"))
    n = y.count()
    part = F.pmod(F.xxhash64(F.lit(SEED), "_key"), F.lit(1_000_003)) < F.lit(int(1_000_003 * min(1.0, sample / max(n, 1))))
    some = docs.select(docs[key].alias("_key"), docs[text].cast("string").alias("text")).join(y.where(part), "_key")
    some = some.groupBy("_key", "label").agg(F.min("text").alias("text"))
    size = F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"))
    sums = {r["label"]: (r["words"], r["n"]) for r in some.groupBy("label").agg(F.sum(size).alias("words"), F.count("*").alias("n")).collect()}
    toxic, clean = sums.get(1, (0, 0)), sums.get(0, (0, 0))
    grammar = Grammar()
    if not toxic[1] or not clean[1]:
        grammar.factors[-1] = np.log((toxic[1] + 0.5) / (clean[1] + 0.5))
        return grammar
    grammar.words, grammar.stems = weighed(evidence(some), toxic[0], clean[0])
    rows = featured(some, grammar, "text", ("label",)).select("label", "x").toPandas()
    grammar.factors = fitted(np.array(rows["x"].tolist(), dtype=float), rows["label"].to_numpy(dtype=float))
    return grammar


def rate(docs: DataFrame, grammar: Grammar, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``key``, ``score`` and ``predicted`` of every document."""
    d = featured(docs.select(docs[key].alias("doc_id"), docs[text].alias("text")), grammar, "text", ("doc_id",))
    return d.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op11_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(id_fold("doc_id", 4) != 2)
    out = rate(docs, train(docs, labels))
    return out.select("doc_id", (id_fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
