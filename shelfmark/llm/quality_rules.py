"""Quality rules: distance of a document's distributions from those of its language.

Two histograms of every document, of its character classes and of its language's commonest function words, are compared with the same histograms
summed over all documents of that language, by Jensen-Shannon distance (base 2, square root). Guards of minimum length keep a short text from
being judged by few characters or words. Before that stand base rules: too few words, or too
many of them in repeated five-word windows. Built-in functions only.

Defined cases: a null text has no words and fails the base rules; a null or unknown language has no word list, and its characters are compared with those of
all documents of that same language value; other columns, whatever their names, don't matter; repeated rows stay repeated; very long texts are handled in time n log n; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.session import settle

from ._shared import BLANKS, table, words_of

#: Commonest function words by language: fixed values.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that"],
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit"],
    "fr": ["de", "la", "le", "et", "les", "des", "un", "que"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se"],
}
SYMBOLS = "#*$%&|<>"
MIN_CHARS, MIN_WORDS = 200, 100
#: Distances beyond which a document differs from its language.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.28, 0.45
#: References of so many language values are broadcast: at 200 bytes a row no more than 1 MB.
MOST_SENT = 5_000
CHAR_BINS = ("lower", "upper", "digit", "blank", "symbol", "rest")


def _removed(text: Column, pattern: str) -> Column:
    """Characters of ``text`` that the pattern matches."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _times(words: str, word: str) -> Column:
    return F.size(F.filter(words, lambda w: w == word)).cast("double")


def pairs_of(hashes: str, gap: int) -> Column:
    """An array's elements hashed with those ``gap`` places on."""
    n = F.greatest(F.size(hashes) - gap, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(gap + 1), n), lambda a, b: F.xxhash64(a, b))


def covered(at: str, width: int = 5) -> Column:
    """Words in windows that the array holds twice or more.

    Where all windows differ nothing more is done. Else they are sorted with their places, neighbours
    that agree give the places that repeat, and each place adds the words up to the next one, ``width`` at most.
    """
    m = F.size(at)
    sorted_ = F.array_sort(F.transform(at, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    twin = F.zip_with(F.slice(sorted_, F.lit(1), m - 1), F.slice(sorted_, F.lit(2), m - 1), lambda a, b: F.when(a["x"] == b["x"], F.array(a["i"], b["i"])))
    places = F.array_sort(F.array_distinct(F.flatten(F.filter(twin, lambda p: p.isNotNull()))))
    # Each step keeps the last place and the words so far.
    step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(width), p - acc["last"])).alias("n"))
    count = F.aggregate(places, F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n")), step, lambda acc: acc["n"])
    return F.when(F.size(F.array_distinct(at)) == m, F.lit(0)).otherwise(count).cast("long")


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts, normed here; null where either is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    term = lambda a, b: F.when(a > 0, a * F.log2(a * 2 / (a + b))).otherwise(F.lit(0.0))
    both = F.zip_with(p, q, lambda a, b: F.struct((a / total(p)).alias("a"), (b / total(q)).alias("b")))
    d = F.aggregate(both, F.lit(0.0), lambda acc, x: acc + (term(x["a"], x["b"]) + term(x["b"], x["a"])) / 2)
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(d, F.lit(0.0))))


def counted(docs: DataFrame, keep: Sequence[str], text: str = "text", *more: Column) -> DataFrame:
    """The columns ``keep`` under ``doc``, ``more`` beside it, the words, and a text's counts of words, characters, symbols and repeats."""
    d = docs.select(F.struct(*[docs[c] for c in keep]).alias("doc"), *more, F.coalesce(docs[text].cast("string"), F.lit("")).alias("t"))
    d = d.withColumn("words", words_of(F.col("t")))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    every = sorted({w for ws in COMMON.values() for w in ws})
    # Each step is a projection of its own, so that no array is made twice. A window's hash joins its first four words with its last four.
    d = d.withColumns({"h": F.transform("words", lambda w: F.xxhash64(w)), "few": F.filter("words", lambda w: w.isin(every)), "lines": lines})
    d = d.withColumn("h2", pairs_of("h", 1)).withColumn("h4", pairs_of("h2", 2)).withColumn("at", pairs_of("h4", 1))
    beside = [c for c in d.columns if c not in ("doc", "t", "words", "h", "few", "lines", "h2", "h4", "at")]
    return d.select(
        "doc", *beside, "few",
        F.size("words").cast("long").alias("n_words"),
        F.size(F.array_distinct("h")).alias("n_distinct"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _removed(F.col("t"), r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered("at").alias("n_repeat_words"),
        _removed(F.col("t"), r"\p{Ll}+").alias("n_lower"), _removed(F.col("t"), r"\p{Lu}+").alias("n_upper"),
        _removed(F.col("t"), r"[0-9]+").alias("n_digit"), F.length("t").alias("n_chars"),
    )


def measures(docs: DataFrame, keep: Sequence[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """``counted`` with the two histograms: ``chars`` as in CHAR_BINS, ``common`` for the language's words and the other words."""
    d = counted(docs, keep, text, docs[lang].cast("string").alias("lang"))
    blank = F.col("n_chars") - F.col("word_chars")
    rest = F.col("word_chars") - F.col("n_lower") - F.col("n_upper") - F.col("n_digit") - F.col("n_symbols")
    bins = [F.col("n_lower"), F.col("n_upper"), F.col("n_digit"), blank, F.col("n_symbols"), rest]
    d = d.withColumn("chars", F.array(*[b.cast("double") for b in bins]))
    hist = F.lit(None).cast("array<double>")
    for code, ws in COMMON.items():
        counts = [_times("few", x) for x in ws]
        other = F.col("n_words").cast("double") - F.aggregate(F.array(*counts), F.lit(0.0), lambda a, x: a + x)
        hist = F.when(F.col("lang") == code, F.array(*counts, other)).otherwise(hist)
    return d.withColumn("common", hist).select("doc", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "common")


def references(m: DataFrame) -> DataFrame:
    """Summed histograms by language, a row each: ``lang, ref_chars, ref_common``."""
    sums = lambda c, n: F.array(*[F.coalesce(F.sum(F.get(c, F.lit(i))), F.lit(0.0)) for i in range(n)])
    n_common = len(next(iter(COMMON.values()))) + 1
    return m.groupBy("lang").agg(sums("chars", len(CHAR_BINS)).alias("ref_chars"), sums("common", n_common).alias("ref_common"))


def judge(docs: DataFrame, keep: Sequence[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """The columns ``keep`` under ``doc``, the measures, both distances, ``base_failed`` and ``kept``.

    The measures are settled, as the references sum them before any document is judged.
    """
    m = settle(measures(docs, keep, text, lang))
    ref = settle(references(m).withColumnRenamed("lang", "ref_lang"))
    # A row per language value, sent to all tasks if they are few; else the documents are dealt by language.
    if ref.count() <= MOST_SENT:
        ref = F.broadcast(ref)
    j = m.join(ref, m["lang"].eqNullSafe(ref["ref_lang"]), "left")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    n_chars = F.aggregate("chars", F.lit(0.0), lambda a, x: a + x)
    char_d = F.when(n_chars >= MIN_CHARS, js_distance(F.col("chars"), F.col("ref_chars")))
    word_d = F.when(F.col("n_words") >= MIN_WORDS, js_distance(F.col("common"), F.col("ref_common")))
    j = j.withColumns({"base_failed": base, "char_distance": char_d, "word_distance": word_d})
    far = (F.coalesce("char_distance", F.lit(0.0)) > MAX_CHAR_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE)
    return j.withColumn("kept", ~F.col("base_failed") & ~far)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return j.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                    F.round("char_distance", 4).alias("char_distance"), F.round("word_distance", 4).alias("word_distance"))


def _js_sql(p: str, q: str) -> str:
    a, b = f"({p}[i] / list_sum({p}))", f"({q}[i] / list_sum({q}))"
    term = lambda x, y: f"CASE WHEN {x} > 0 THEN {x} * log2({x} * 2 / ({x} + {y})) ELSE 0 END"
    body = f"list_sum(list_transform(range(1, len({p}) + 1), lambda i: ({term(a, b)} + {term(b, a)}) / 2))"
    return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest({body}, 0)) END"


def _oracle() -> str:
    n = len(next(iter(COMMON.values()))) + 1
    count = lambda w: f"len(list_filter(w, lambda x: x = '{w}'))::DOUBLE"
    common = " ".join(f"WHEN lang = '{c}' THEN [{', '.join(map(count, ws))}, len(w) - ({' + '.join(map(count, ws))})]" for c, ws in COMMON.items())
    sums = lambda c, k: f"[{', '.join(f'coalesce(sum({c}[{i}]), 0)' for i in range(1, k + 1))}]"
    gone = lambda c: f"(length(t) - length(regexp_replace(t, '{c}', '', 'g')))"
    blank = r"[\x20\x09-\x0D]"
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM d, unnest(range(1, len(w) - 3)) AS r(i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
m AS (SELECT d.doc_id, lang, t, w, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, {gone('[#*$%&|<>]')}::BIGINT AS n_symbols,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0) AS n_repeat_words, CASE {common} END AS common,
    {gone(chr(92) + 'p{Ll}')} AS lo, {gone(chr(92) + 'p{Lu}')} AS up, {gone('[0-9]')} AS di
  FROM d LEFT JOIN cov USING (doc_id)),
h AS (SELECT *, [lo::DOUBLE, up::DOUBLE, di::DOUBLE, (length(t) - word_chars)::DOUBLE, n_symbols::DOUBLE, (word_chars - lo - up - di - n_symbols)::DOUBLE] AS chars FROM m),
r AS (SELECT lang, {sums('chars', len(CHAR_BINS))} AS rc, {sums('common', n)} AS rw FROM h GROUP BY lang),
x AS (SELECT h.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    CASE WHEN list_sum(chars) >= {MIN_CHARS} THEN {_js_sql('chars', 'rc')} END AS cd,
    CASE WHEN n_words >= {MIN_WORDS} THEN {_js_sql('common', 'rw')} END AS wd
  FROM h LEFT JOIN r ON h.lang IS NOT DISTINCT FROM r.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (coalesce(cd, 0) > {MAX_CHAR_DISTANCE} OR coalesce(wd, 0) > {MAX_WORD_DISTANCE}) AS kept,
  round(cd, 4) AS char_distance, round(wd, 4) AS word_distance
FROM x
"""


ORACLE = _oracle()
