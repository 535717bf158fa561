"""Secret scans: known shapes, and strings in sensitive places that a primed compressor can't shorten.

Base spans are assignments, access keys and long hexadecimal runs. The method then looks at every other long mixed string shortly after a
sensitive word: a zstandard compressor primed with the text around it and with a dictionary of identifiers
(those of the text near by, and common ones of code) measures how many bytes the string adds. Words, paths and names that
the surroundings hold cost a few bytes; a string that adds most of its length is new, and is reported as ``novel``. Other copies of the string itself are
taken out of the text around it first, so that a repeated secret does not hide itself; every copy of a novel string in the text is reported, wherever it stands.

Documents are scanned where they are read, in slices of Arrow batches, in time that grows with the text; nothing is shuffled. Defined cases: a null text is empty
and has no spans; repeated rows stay repeated; texts of any length are scanned whole; other columns, whatever their names, do not matter to ``scan``
and pass through ``redact``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from ._shared import slices, table

#: Kinds in the order that breaks ties between spans of one start.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# A maximal run is found at its first character, so a minimum length in the pattern drops just the failing matches.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
MIN_ASSIGN = 8

#: The method's parameters: shortest candidate, how far back a sensitive word may stand, text on either side that primes the compressor,
#: and the least share of a candidate's bytes that must be new.
MIN_NOVEL, REACH, AROUND, MIN_SHARE = 16, 64, 512, 0.7
#: Whole runs; that a run has a digit and a letter is asked afterwards, so that no place is looked at twice.
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_-]{{{MIN_NOVEL},}}")
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
SENSITIVE = re.compile(r"key|secret|token|passw|pwd|credential|bearer|private|signature|authorization", re.IGNORECASE | re.ASCII)
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{3,31}")
#: Identifiers common in code and configuration: fixed values.
COMMON_IDENTIFIERS = b" ".join(
    b"authorization bearer client_id client_secret access_token refresh_token private_key public_key signature password username "
    b"config settings environ export const string return function import default localhost http https www example github "
    b"sha256 sha512 base64 utf-8 uuid version 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ".split()
)


#: Each assignment holds one of these in lower case, and so does each sensitive place: a plain search settles most texts.
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
SENSITIVE_WORDS = ("key", "secret", "token", "passw", "pwd", "credential", "bearer", "private", "signature", "authorization")


#: Bytes of text that a task handles at once.
AT_ONCE = 8_000_000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the known shapes."""
    low, out = text.lower(), []
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def added_bytes(candidate: bytes, around: bytes) -> int:
    """Bytes that ``candidate`` adds to a compressor that knows ``around`` and the identifiers in it."""
    names = " ".join(dict.fromkeys(IDENTIFIER.findall(around.decode("utf-8", "ignore")))).encode()
    primed = zstandard.ZstdCompressionDict(COMMON_IDENTIFIERS + b" " + names + b" " + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
    return len(packer.compress(candidate)) - len(packer.compress(b""))


def merged(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover, in order; spans that touch or overlap are one."""
    starts, ends = [], []
    for a, _, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def novel_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of candidates outside the base spans that stand after a sensitive word and are mostly new, and of all their copies."""
    low, novel = text.lower(), set()
    if not any(w in low for w in SENSITIVE_WORDS):
        return []
    starts, ends = merged(base)
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        if m[0] in novel or not DIGIT.search(m[0]) or not LETTER.search(m[0]) or not SENSITIVE.search(text, max(0, a - REACH), a):
            continue
        i = bisect_right(ends, a)
        if i < len(starts) and starts[i] < b:
            continue
        # Blanks of the same length, before the ends are cut: a copy across an end leaves no part.
        blank = " " * (b - a)
        before = text[max(0, a - AROUND - len(blank)) : a].replace(m[0], blank)[-AROUND:]
        after = text[b : b + AROUND + len(blank)].replace(m[0], blank)[:AROUND]
        if added_bytes(m[0].encode(), (before + " " + after).encode("utf-8", "replace")) >= MIN_SHARE * (b - a):
            novel.add(m[0])
    return copies(text, novel, base)


def copies(text: str, strings: set[str], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all places of ``strings``, the longest where several start, also inside longer runs; those within a base span are left out."""
    lengths, out = defaultdict(set), []
    for x in strings:
        lengths[x[:MIN_NOVEL]].add(len(x))
    inside = sorted((s, e) for s, _, e in base)
    reach = list(accumulate((e for _, e in inside), max))  # the furthest end of the spans so far
    heads = {x: sorted(n, reverse=True) for x, n in lengths.items()}
    for m in CANDIDATE.finditer(text) if heads else ():
        i, end = m.span()
        while i <= end - MIN_NOVEL:
            size = next((n for n in heads.get(text[i : i + MIN_NOVEL], ()) if i + n <= end and text[i : i + n] in strings), 0)
            at = bisect_right(inside, (i, len(text))) - 1
            if size and not (at >= 0 and reach[at] >= i + size):
                out.append((i, 3, i + size))
            i += size or 1
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, counts by kind, the hash of the base spans and all spans, a row per document."""
    kind = docs.schema[key].dataType

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, AT_ONCE):
            rows = []
            for t in batch.column(1).to_pylist():
                base = base_spans(t or "")
                more = novel_spans(t or "", base) if t else []
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((*n, len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols, types)], ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])

    return docs.select(docs[key].alias("doc_id"), docs[text].cast("string")).mapInArrow(of, f"doc_id {kind.simpleString()}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")


def redacted(text: str, mark: str) -> str:
    """``text`` with every span, and spans that touch as one, replaced by ``mark``."""
    base = base_spans(text)
    parts, at = [], 0
    for a, b in zip(*merged(base + novel_spans(text, base)), strict=True):
        parts += [text[at:a], mark]
        at = b
    return "".join([*parts, text[at:]]) if parts else text


def redact(docs: DataFrame, text: str = "text", chars: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with secrets replaced by ``mark``; ``chars``, where it is a column, gets the new length of changed texts."""
    names, schema = docs.columns, docs.schema
    i = names.index(text)
    j = names.index(chars) if chars in names else None

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, i, AT_ONCE):
            cols = batch.columns
            old = cols[i].to_pylist()
            new = [t and redacted(t, mark) for t in old]
            cols[i] = pa.array(new, pa.string())
            if j is not None:
                cols[j] = pa.array([n if a == b else len(b) for n, a, b in zip(cols[j].to_pylist(), old, new, strict=True)], cols[j].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(of, schema)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
