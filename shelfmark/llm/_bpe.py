"""Byte-pair merging of many words at once, with the vocabularies of public tokenizer files.

Texts are cut at blanks that always end a token, each distinct piece of an Arrow batch is merged once, and ids are gathered back to the texts. Pieces whose cutting depends on more than settled character classes go to the
tokenizers library as they are: for byte-level vocabularies those with characters whose class is not the same in old and new Unicode databases and those that may hold a special token; for vocabularies with word ends also those with
apostrophes or with characters past U+022F.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NONE = np.int64(2**31 - 1)
#: Character classes of code points below U+0230, from the Unicode database.
LETTER, NUMBER, OTHER, SPACE = range(4)
SAFE = 0x230


def _class(cp: int) -> int:
    c = chr(cp)
    return SPACE if c.isspace() else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER)


CLASSES = np.array([_class(i) for i in range(SAFE)], dtype=np.int8)
#: Words that plain classes do not settle, for either kind of vocabulary.
ODD_WORD = r"'|<\||[^\x00-\x{22f}]|[\x1c-\x1f\x{85}\x{a0}\x{130}]"
ODD_PIECE = r"<\||[\x1c-\x1f\x{180e}]"
#: A blank after a space: then only spaces before something else are safe to cut at.
ODD_TEXT = r" [\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


#: Characters that byte-level vocabularies take for blanks: Unicode's White_Space.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: The class of characters that are newer than Unicode 3.2 or have changed since: the library's database may differ from Python's.
UNSETTLED, LAST = 4, 0x30000


@lru_cache(maxsize=1)
def settled_classes() -> np.ndarray:
    """Classes by code point up to ``LAST``, which stands for all beyond."""
    old, kinds = unicodedata.ucd_3_2_0.category, {"L": LETTER, "N": NUMBER}
    out = np.full(LAST + 1, UNSETTLED, dtype=np.int8)
    for cp in range(LAST):
        c = chr(cp)
        was, now = old(c), unicodedata.category(c)
        if was not in ("Cn", "Cs") and kinds.get(was[0], OTHER) == kinds.get(now[0], OTHER):
            out[cp] = kinds.get(now[0], OTHER)
    out[list(WHITE)] = SPACE
    return out


def classes_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By byte the class of its character, and the place where that character begins."""
    cp, begin = data.astype(np.int32), np.arange(len(data))
    far = np.flatnonzero(data >= 0xC0)
    if len(far):
        d = np.append(data, np.zeros(3, dtype=np.uint8)).astype(np.int32)
        a, b, c, e = d[far], d[far + 1] & 0x3F, d[far + 2] & 0x3F, d[far + 3] & 0x3F
        cp[far] = np.where(a < 0xE0, (a & 0x1F) << 6 | b, np.where(a < 0xF0, (a & 0x0F) << 12 | b << 6 | c, (a & 0x07) << 18 | b << 12 | c << 6 | e))
        begin = np.maximum.accumulate(np.where((data & 0xC0) == 0x80, 0, begin))
    return settled_classes()[np.minimum(cp, LAST)][begin], begin


def leading(data: np.ndarray, cls: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By byte of strings laid end to end: whether it begins one, whether it ends one, and whether it is a space right before something else than a blank."""
    first, final, starts = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool), starts_of(lens)
    first[starts[lens > 0]] = True
    final[(starts + lens - 1)[lens > 0]] = True
    return first, final, (data == 0x20) & ~final & (np.append(cls[1:], SPACE) != SPACE)


def spaced_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts cut before every space that stands right before something else than a blank, and pieces by text. Runs of blanks stay with what is before them."""
    data, lens = bytes_of(texts)
    first, _, lead = leading(data, classes_of(data)[0], lens)
    cut = first | lead
    seen, starts = np.append(0, np.cumsum(cut)), starts_of(lens)
    offsets = np.append(np.flatnonzero(cut), len(data)).astype(np.int64)
    pieces = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))
    return pieces, seen[starts + lens] - seen[starts]


class PairTable:
    """Integers by pairs (a, b), b < 2**16, in open addressing that looks up whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(8, int(len(keys) * 16 - 1).bit_length()) if len(keys) else 8
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.zeros(1 << self.bits, dtype=np.int64)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] == -1
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            put = first[free[first]]
            self.keys[at[put]], self.values[at[put]] = keys[left[put]], values[left[put]]
            stay = np.ones(len(left), dtype=bool)
            stay[put] = False
            left, at = left[stay], (at[stay] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray, absent: int) -> np.ndarray:
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], absent)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        at = at[open_]
        while len(open_):
            at = (at + 1) & (len(self.keys) - 1)
            found = self.keys[at]
            same = found == keys[open_]
            out[open_[same]] = self.values[at[same]]
            go = ~same & (found != -1)
            open_, at = open_[go], at[go]
        return out


def starts_of(lens: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lens), dtype=np.int64)
    np.cumsum(lens[:-1], out=out[1:])
    return out


def runs_of(*columns: np.ndarray) -> np.ndarray:
    """Where the runs of rows begin that agree in all columns."""
    if not len(columns[0]):
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(np.append(True, np.logical_or.reduce([x[1:] != x[:-1] for x in columns])))


def take_runs(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Places start, start+1, ... of each run, one run after the other."""
    total = int(lens.sum())
    return np.arange(total) + np.repeat(starts - starts_of(lens), lens) if total else np.zeros(0, dtype=np.int64)


class Vocabulary:
    """A byte-pair vocabulary file of the tokenizers library; ``suffix`` marks vocabularies with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, model = path, spec["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in letters], dtype=np.int64)
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] * 65536 + vocab[b] for a, b in pairs], dtype=np.int64)
        keys, where = np.unique(keys, return_index=True)
        self.table = PairTable(keys, where.astype(np.int64))
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        back = {c: i for i, c in enumerate(letters)}
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        shown: list[bytes] = [b""] * size
        for t, i in vocab.items():
            shown[i] = bytes(back[c] for c in t.removesuffix(self.suffix)) if self.suffix else bytes(back[c] for c in t)
        for t in spec["added_tokens"]:
            shown[t["id"]] = t["content"].encode()
        self.shown_len = np.array([len(x) for x in shown], dtype=np.int64)
        self.shown_at = starts_of(self.shown_len)
        self.shown = np.frombuffer(b"".join(shown), dtype=np.uint8)

    @property
    def library(self):
        return library(self.path)

    def by_library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def tokens(self, data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the first byte level and their number by token, and tokens by word, of plain words laid end to end; for vocabularies with word ends."""
        n = len(data)
        cont = (data & 0xC0) == 0x80
        cp = data.astype(np.int32)
        nxt = np.append(cp[1:], 0)
        two = data >= 0xC0
        cp[two] = ((cp[two] & 0x1F) << 6) | (nxt[two] & 0x3F)
        cls = CLASSES[np.minimum(cp, SAFE - 1)]
        back = np.flatnonzero(cont)
        cls[back] = cls[back - 1]
        starts = starts_of(lens)
        cut = np.ones(n, dtype=bool)
        cut[1:] = (cls[1:] != cls[:-1]) | (cls[1:] == SPACE) | (cls[1:] == NUMBER)
        cut[back] = False
        cut[starts] = True
        return self.symbols(data, cut, starts)

    def byte_tokens(self, data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for byte-level vocabularies and any settled strings: a token is a contraction, or characters of one class with a space before, or blanks; of blanks before something else the last is a token of its own."""
        cls, begin = classes_of(data)
        first, final, lead = leading(data, cls, lens)
        after = np.append(cls[1:], SPACE)
        own = np.where(lead, after, cls)
        cut = first | lead
        cut[1:] |= own[1:] != own[:-1]
        cut[begin[(own == SPACE) & ~final & (after != SPACE)]] = True
        # An apostrophe that begins a token may begin a contraction, which ends where it ends, whatever follows.
        at = np.flatnonzero((data == 0x27) & cut & ~final)
        a, b = data[at + 1], np.where(final[at + 1], 0, np.append(data, 0)[at + 2])
        one = np.isin(a, np.frombuffer(b"stmd", dtype=np.uint8))
        two = (np.isin(a, np.frombuffer(b"rv", dtype=np.uint8)) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        cut[at[one | two] + 1] = False
        ends = np.concatenate([at[one] + 2, at[two] + 3])
        cut[ends[ends < len(data)]] = True
        return self.symbols(data, cut, starts_of(lens))

    def symbols(self, data: np.ndarray, cut: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(cut)
        sizes = np.diff(np.append(at, len(data)))
        sym = self.first[data]
        ends = at + sizes - 1
        sym[ends] = self.last[data[ends]]
        return sym, sizes, np.add.reduceat(cut.astype(np.int64), starts)

    def merge(self, sym: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number by token: in every token, again and again, all places of its pair of lowest rank."""
        which, done = np.arange(len(lens)), []
        tail = np.cumsum(lens) - 1
        rank = np.full(len(sym), NONE)
        inner = np.ones(len(sym), dtype=bool)
        inner[tail] = False
        at = np.flatnonzero(inner)
        rank[at] = self.table.get(sym[at] * 65536 + sym[at + 1], NONE)
        while len(which):
            low = np.minimum.reduceat(rank, starts_of(lens))
            stop = low == NONE
            if stop.any():
                far = np.repeat(stop, lens)
                done.append((which[stop], lens[stop], sym[far]))
                go = ~stop
                sym, rank, which, lens, low = sym[~far], rank[~far], which[go], lens[go], low[go]
                if not len(which):
                    break
            hit = rank == np.repeat(low, lens)
            at = np.flatnonzero(hit)
            if (np.diff(at) == 1).any():  # aaa: from the left, every second place of a run
                new = np.append(True, np.diff(at) != 1)
                first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
                hit[at[(np.arange(len(at)) - first) % 2 == 1]] = False
                at = np.flatnonzero(hit)
            sym[at] = self.merged[rank[at]]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            lens = lens - np.add.reduceat(hit.astype(np.int64), starts_of(lens))
            sym, rank, touched = sym[keep], rank[keep], hit[keep]
            touched[:-1] |= touched[1:].copy()
            tail = np.cumsum(lens) - 1
            rank[tail] = NONE
            touched[tail] = False
            at = np.flatnonzero(touched)
            rank[at] = self.table.get(sym[at] * 65536 + sym[at + 1], NONE)
        if not done:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        which, lens, flat = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(which)
        return flat[take_runs(starts_of(lens)[order], lens[order])], lens[order]

    def merge_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number by word, of distinct strings; an empty word has none."""
        odd = pc.match_substring_regex(words, ODD_WORD if self.suffix else ODD_PIECE).to_numpy(zero_copy_only=False)
        if not self.suffix:
            far = np.flatnonzero(~odd & pc.match_substring_regex(words, r"[^\x00-\x{22f}]").to_numpy(zero_copy_only=False))
            data, lens = bytes_of(words.take(pa.array(far)))
            odd[np.unique(np.repeat(far, lens)[classes_of(data)[0] == UNSETTLED])] = True
        size = pc.binary_length(words).to_numpy().astype(np.int64)
        plain, strange = np.flatnonzero(~odd & (size > 0)), np.flatnonzero(odd)
        counts = np.zeros(len(words), dtype=np.int64)
        flat = np.zeros(0, dtype=np.int64)
        if len(plain):
            own = words.take(pa.array(plain))
            data, lens = bytes_of(pc.utf8_lower(own) if self.suffix else own)
            sym, sizes, per = (self.tokens if self.suffix else self.byte_tokens)(data, lens)
            flat, got = self.merge(sym, sizes)
            counts[plain] = np.add.reduceat(got, starts_of(per))
        if len(strange):
            more = self.by_library(words.take(pa.array(strange)).to_pylist())
            counts[strange] = [len(x) for x in more]
            src = np.zeros(len(words), dtype=np.int64)
            src[plain] = starts_of(counts[plain])
            src[strange] = len(flat) + starts_of(counts[strange])
            flat = np.concatenate([flat, *(np.array(x, dtype=np.int64) for x in more)])
            flat = flat[take_runs(src, counts)]
        return flat, counts

    def shown_bytes(self, ids: np.ndarray) -> np.ndarray:
        return self.shown[take_runs(self.shown_at[ids], self.shown_len[ids])]


def byte_letters() -> list[str]:
    """The letters by which byte-level vocabularies write bytes: printable bytes as they are, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of strings laid end to end, and their lengths."""
    words = words.cast(pa.large_string()) if not pa.types.is_large_string(words.type) else words
    off = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    raw = words.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
    return data, np.diff(off)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=4)
def library(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words between ASCII blanks, each word's number among them, and words by text."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    per = np.diff(lists.offsets.to_numpy())
    codes = lists.flatten().dictionary_encode()
    return codes.dictionary, codes.indices.to_numpy(), per


def gather(codes: np.ndarray, per: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts and their number, from those of the distinct words."""
    n = counts[codes]
    total = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(n, out=total[1:])
    ends = np.cumsum(per)
    return flat[take_runs(starts_of(counts)[codes], n)], total[ends] - total[ends - per]


def replace_texts(ids: np.ndarray, lens: np.ndarray, odd: np.ndarray, more: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the texts at ``odd`` replaced by ``more``."""
    if not len(odd):
        return ids, lens
    src, out = starts_of(lens), lens.copy()
    out[odd] = [len(x) for x in more]
    src[odd] = len(ids) + starts_of(out[odd])
    return np.concatenate([ids, *(np.array(x, dtype=np.int64) for x in more)])[take_runs(src, out)], out
