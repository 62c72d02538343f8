"""Held-out passages inside a training corpus, by spaced seeds.

A seed is a hash of the words at fixed places of a window; the places between are ignored, so a word that
differs there does no harm. A word of a document that no item has counts as the item's word that it is a slip
of, if there is one, so that seeds hold however many words have slips. Seeds of the test items are joined
with those of every document by hash; each hit names an item and a shift, along which words are then compared
one by one, slips of letters allowed.

Only the test items travel: in blocks of about BLOCK_WORDS words, each sent to the executors and met by
all documents, in one pass per block, without a shuffle. The corpus is never gathered.

Defined cases: letter case, punctuation, accents, spacing, line layout and bracketed notes, however long or
nested, are set aside first; a text with brackets is also read with their contents, as what was taken for a note
may be the passage. Null and empty texts hold nothing; an item without words leaks nowhere; an item shorter than
PASSAGE_WORDS leaks where all of it is repeated; repeated items and documents are reported each under its own
id; a pair is reported once, with the longest run. A word with a digit in it must be equal, as another number
is another statement.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PASSAGE_WORDS = 30
#: Places of a window that a seed looks at; the rest it ignores. Chosen so that, of windows of 30 words with
#: up to five words altered, none of some thousand at random was missed.
MASKS = (
    (0, 1, 2, 3, 4, 5, 6, 7, 8),
    (0, 1, 2, 5, 6, 8, 9, 10, 11),
    (0, 3, 4, 5, 9, 10, 11, 12, 13),
    (0, 1, 2, 4, 7, 10, 11, 14, 15),
)
BLOCK_WORDS = 100_000
#: Items shorter than this have seeds of contiguous pieces besides, as few windows of the masks fit into them.
SHORT_WORDS = 24
#: Letters of an average word with its space; blocks are sized by characters, as not every script has spaces.
WORD_CHARS = 6
#: Words of documents that are searched at a time.
BATCH_WORDS = 120_000
_ODD = np.random.default_rng(20).integers(1, 2**63, size=64, dtype=np.uint64) | np.uint64(1)
_BRACKET = re.compile(r"[\[\]()]")
#: A closing bracket after the mark of an enumeration closes nothing.
_MARK = re.compile(r"(?:^|\s)\w{1,3}$")
_BROKEN = re.compile("(?<=\\w)(?:\u00ad\\s*|[-\u2010\u2011]\\s*\n[>\\s]*)(?=\\w)")
_WORD = re.compile(r"[^\W_]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")


class _Fold(dict):
    """Letters as they count: ligatures apart, accents and soft hyphens gone; looked up once each."""

    def __missing__(self, code: int) -> int | None:
        out = self[code] = None if unicodedata.combining(chr(code)) else code
        return out


_FOLD = _Fold({ord(a): b for a, b in {"œ": "oe", "æ": "ae", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "\u00ad": ""}.items()})


def without_notes(text: str) -> str:
    """The text without its bracketed parts, of any length and depth; a bracket without a partner stays."""
    if "(" not in text and "[" not in text:
        return text
    open_: list[tuple[str, int]] = []
    spans: list[tuple[int, int]] = []
    for m in _BRACKET.finditer(text):
        c, at = m.group(), m.start()
        if c in "[(":
            open_.append((c, at))
            continue
        k = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == ("[" if c == "]" else "(")), None)
        if k is None or (c == ")" and _MARK.search(text, max(0, at - 4), at)):
            continue
        begin = open_[k][1]
        del open_[k:]
        while spans and spans[-1][0] > begin:
            spans.pop()
        spans.append((begin, at + 1))
    if not spans:
        return text
    ends = [0, *(b for _, b in spans)]
    return " ".join(text[a:b] for a, b in zip(ends, [a for a, _ in spans] + [len(text)], strict=True))


def _tokens(text: str) -> list[str]:
    if "\u00ad" in text or ("\n" in text and any(h in text for h in "-\u2010\u2011")):
        text = _BROKEN.sub("", text)
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    return _WORD.findall(unicodedata.normalize("NFKD", text.casefold()).translate(_FOLD))


def words(text: str | None) -> list[str]:
    """The words of a text with all that is set aside left out."""
    return _tokens(without_notes(text)) if text else []


def readings(text: str | None) -> list[list[str]]:
    """The words of a text: without its notes, and if it has any also with them."""
    if not text:
        return []
    plain = without_notes(text)
    return [w for w in ([_tokens(plain)] if plain == text else [_tokens(plain), _tokens(text)]) if w]


def _shortened(word: str, most: int) -> set[str]:
    """The word, and it with up to `most` letters dropped."""
    out = level = {word}
    for _ in range(most):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out = out | level
    return out


class Vocabulary:
    """The words of test items by number; a word that none has is that one of theirs it is a slip of.

    Two words a slip apart share a form with letters dropped. Of several the most frequent one counts.
    """

    def __init__(self, frequent: dict[str, int]):
        self.names = sorted(frequent, key=lambda w: (-frequent[w], w))
        self.known = {w: xxhash.xxh64_intdigest(w) for w in self.names}
        self.near: dict[str, list[str]] = defaultdict(list)
        for w in self.names:
            if w.isalpha() and len(w) >= 2:
                for x in _shortened(w, _edits(len(w) + 1)):
                    self.near[x].append(w)
        self.longest = max(map(len, self.names), default=0) + 2

    def hash(self, word: str) -> int:
        own = self.known.get(word)
        if own is not None:
            return own
        if 3 <= len(word) <= self.longest and word.isalpha():
            close = {v for x in _shortened(word, _edits(len(word) + 1)) for v in self.near.get(x, ())}
            alike = [v for v in close if slip(v, word)]
            if alike:
                return self.known[min(alike, key=lambda v: (abs(len(v) - len(word)), self.rank(v)))]
        return xxhash.xxh64_intdigest(word)

    def rank(self, word: str) -> int:
        return self.ranks[word]

    @cached_property
    def ranks(self) -> dict[str, int]:
        return {w: k for k, w in enumerate(self.names)}


class _Seen(dict):
    """Numbers of the words seen lately, with the hash, length and kind of each."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.rows: list[tuple[int, int]] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self.rows)
        self.rows.append((self.vocabulary.hash(word), len(word) if word.isalpha() else -1))
        return n

    def __call__(self, ws: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.int64, len(ws))

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash and length by number; the length of a word with other than letters is -1."""
        h, n = zip(*self.rows, strict=True) if self.rows else ((), ())
        return np.array(h, np.uint64), np.array(n, np.int64)


def seeds(h: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """The seed of each window of hashed words under a mask."""
    n = len(h) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, number, np.uint64)
    for k, o in enumerate(mask):
        out += h[o : o + n] * _ODD[k]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x9E3779B97F4A7C15)
    return out


def _edits(length: int) -> int:
    """Slips of letters that a word may have, by the length of the longer form."""
    return 1 if length < 8 else 2


@lru_cache(1 << 16)
def slip(a: str, b: str) -> bool:
    """True if b is a with a slip or two of letters: one dropped, added, changed, or two swapped."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    most = _edits(max(la, lb))
    if abs(la - lb) > most or min(la, lb) < 2 or max(la, lb) < 3 or not (a.isalpha() and b.isalpha()):
        return False
    two, one, row = None, list(range(lb + 1)), []
    for i in range(1, la + 1):
        row = [i]
        for j in range(1, lb + 1):
            same = a[i - 1] == b[j - 1]
            d = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (not same))
            if two is not None and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        two, one = one, row
    return one[lb] <= most


def _families(n: int) -> Iterator[tuple[tuple[int, ...], int, range | list[int]]]:
    """(mask, its number, the places in an item of n words) of the seeds of an item."""
    for m, mask in enumerate(MASKS):
        if n > mask[-1]:
            yield mask, m, range(n - mask[-1])
    if n < SHORT_WORDS:
        parts = min(3, max(1, n // 2))
        size = n // parts
        yield tuple(range(size)), 100 + size, [k * size for k in range(parts)]


class Index:
    """The seeds of a block of test items."""

    def __init__(self, items: list[tuple[int, str]], passage: int):
        self.passage = passage
        self.ids, self.words = [], []
        for item_id, text in items:
            for ws in readings(text):
                self.ids.append(item_id)
                self.words.append(ws)
        self.vocabulary = Vocabulary(Counter(w for ws in self.words for w in ws))
        seen = _Seen(self.vocabulary)
        numbers = [seen(ws) for ws in self.words]
        by_hash, by_length = seen.table()
        keys, refs, masks = [], [], {}
        for k, at in enumerate(numbers):
            h = by_hash[at]
            for mask, number, places in _families(len(h)):
                masks[number] = mask
                s = seeds(h, mask, number)[np.asarray(places, int)]
                keys.append(s)
                refs.append(np.stack([np.full(len(s), k), np.asarray(places, int)], axis=1))
        self.masks = sorted(masks.items())
        self.size = np.array([len(x) for x in self.words], np.int64)
        self.start = np.r_[0, np.cumsum(self.size)[:-1]].astype(np.int64) if self.ids else np.zeros(0, np.int64)
        all_words = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        self.flat, self.length = by_hash[all_words], by_length[all_words]
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        ref = np.concatenate(refs) if refs else np.zeros((0, 2), int)
        order = np.argsort(key, kind="stable")
        self.key, self.ref = key[order], ref[order]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.key >> np.uint64(42)).astype(np.int64)] = True

    def _hits(self, h: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
        """Distinct (document, item, shift) that share a seed; h holds the words of documents end to end."""
        docs, items, shifts = [], [], []
        for number, mask in self.masks:
            s = seeds(h, mask, number)
            inside = doc[: len(s)] == doc[mask[-1] : mask[-1] + len(s)]
            at = np.flatnonzero(self.bits[(s >> np.uint64(42)).astype(np.int64)] & inside)
            lo, hi = np.searchsorted(self.key, s[at], "left"), np.searchsorted(self.key, s[at], "right")
            n = hi - lo
            at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
            place = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.zeros(0, int)
            at = np.repeat(at, n)
            docs.append(doc[at])
            items.append(self.ref[place, 0])
            shifts.append(at - start[doc[at]] - self.ref[place, 1])
        d, k, x = (np.concatenate(v).astype(np.int64) for v in (docs, items, shifts))
        order = np.lexsort((x, k, d))
        d, k, x = d[order], k[order], x[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1]) | (x[1:] != x[:-1])
        return d[new], k[new], x[new]

    def search(self, texts: list[list[str]], seen: _Seen) -> dict[tuple[int, int], int]:
        """(document, item) numbers of every passage in the documents' words, with the longest run shared."""
        size = np.array([len(ws) for ws in texts], np.int64)
        start = np.r_[0, np.cumsum(size)[:-1]].astype(np.int64)
        number = np.concatenate([seen(ws) for ws in texts]) if len(texts) else np.zeros(0, np.int64)
        if not len(number) or not self.ids:
            return {}
        by_hash, by_length = seen.table()
        h, length = by_hash[number], by_length[number]
        d, k, shift = self._hits(h, np.repeat(np.arange(len(texts)), size), start)
        begin, end = np.maximum(0, -shift), np.minimum(self.size[k], size[d] - shift)
        need = np.minimum(self.passage, self.size[k])
        fits = end - begin >= need
        d, k, shift, begin, end, need = (x[fits] for x in (d, k, shift, begin, end, need))
        if not len(k):
            return {}
        # all shifts laid end to end; words that cannot be slips of each other, by their lengths alone
        n = end - begin
        first = np.r_[0, np.cumsum(n)[:-1]]
        place = np.arange(n.sum()) - np.repeat(first - begin, n)
        mine, theirs = place + np.repeat(self.start[k], n), place + np.repeat(shift + start[d], n)
        differ = self.flat[mine] != h[theirs]
        a, b = self.length[mine], length[theirs]
        apart = differ & ((np.abs(a - b) > np.where(np.maximum(a, b) < 8, 1, 2)) | (np.minimum(a, b) < 2) | (np.maximum(a, b) < 3))
        total = np.r_[0, np.cumsum(apart)]
        spans = n - need + 1
        lead = np.r_[0, np.cumsum(spans)[:-1]]
        at = np.arange(spans.sum()) - np.repeat(lead - first, spans)
        least = np.minimum.reduceat(total[at + np.repeat(need, spans)] - total[at], lead)
        best: dict[tuple[int, int], int] = {}
        for i in np.flatnonzero(least == 0):
            v, ws, a0, s = self.words[k[i]], texts[d[i]], int(begin[i]), int(shift[i])
            odd = np.flatnonzero(differ[first[i] : first[i] + n[i]])
            breaks = [j for j in odd if apart[first[i] + j] or not slip(v[a0 + j], ws[a0 + j + s])]
            run = int(np.diff(np.r_[-1, breaks, n[i]].astype(int)).max()) - 1
            pair = (int(d[i]), int(k[i]))
            if run >= need[i] and run > best.get(pair, 0):
                best[pair] = run
        return best


def _pieces(texts, most: int) -> Iterator[tuple[list[int], list[list[str]]]]:
    """The words of texts, in stretches of about `most` words: (number of the text, words) of each reading."""
    numbers, held, n = [], [], 0
    for i, text in enumerate(texts):
        for ws in readings(text):
            numbers.append(i)
            held.append(ws)
            n += len(ws)
        if n >= most:
            yield numbers, held
            numbers, held, n = [], [], 0
    if held:
        yield numbers, held


#: Words kept by number before they are forgotten, so that a worker's memory is bounded.
SEEN_WORDS = 400_000


def leaks(documents: DataFrame, items: DataFrame, passage: int = PASSAGE_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, run of every document (doc_id, text) that repeats a passage of an item (item_id, text)."""
    spark = documents.sparkSession
    items = items.where("text is not null and item_id is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (block_words * WORD_CHARS)))
    numbered = items.select("item_id", "text", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block"))
    schema = "doc_id bigint, item_id bigint, run int"
    out = None
    for block in range(blocks):
        held = numbered.where(F.col("block") == block).orderBy("item_id").collect() if blocks > 1 else numbered.orderBy("item_id").collect()
        sent = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in held])

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            index = Index(sent.value, passage)
            seen = _Seen(index.vocabulary)
            for batch in batches:
                # by row, as rows may repeat an id: the longest run of a row's readings and of an item's
                best: dict[tuple[int, int], int] = {}
                for numbers, texts in _pieces(batch["text"], BATCH_WORDS):
                    for (d, k), n in index.search(texts, seen).items():
                        pair = (numbers[d], index.ids[k])
                        best[pair] = max(n, best.get(pair, 0))
                    if len(seen) > SEEN_WORDS:
                        seen.forget()
                ids = batch["doc_id"].tolist()
                yield pd.DataFrame([(ids[i], item, n) for (i, item), n in best.items()], columns=["doc_id", "item_id", "run"])

        found = documents.select("doc_id", "text").where("text is not null").mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return out
