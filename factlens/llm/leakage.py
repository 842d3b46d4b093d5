"""Evaluation texts that occur, whole or in part, in corpus documents.

1. Texts are cut into pieces (runs of letters and digits; case, punctuation, spacing and markup are dropped).
2. Grams of GRAM raw pieces at the words of the items are hash-joined with those of the documents; every task holds the
   items'. A pair of which SHARED of the item's words begin a shared gram is measured: no passage within the limits has
   fewer, whatever its words, so nothing is lost before the exact check.
3. The exact check aligns the passage with the item in words, by the fewest edits.

For re-parameterised questions, pieces are canonicalised: a piece found in many distinct items is phrasing and stays
itself; any other piece becomes a typed placeholder, a value (it has a digit), a unit (of UNITS, phrasing or not) or a name.
Windows of WINDOW canonical pieces are joined, and a text that follows a template with one renaming of its slots is such a question.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Canonical pieces of a window, share of distinct items that makes a piece phrasing.
WINDOW, PHRASING = 5, 0.04
#: Items that a task holds at once; more are taken in blocks.
BLOCK = 20_000
#: Consecutive words of an exact passage; words and share of edits of an altered one.
EXACT, ALTERED, EDITS = 15, 35, 0.2
#: Pieces of a raw gram, and the item's words that must begin a shared one: an edit breaks at most GRAM of the grams of its words, and a
#: passage of EXACT words has 13, so no passage within the limits has fewer.
GRAM = 3
SHARED = min(EXACT - GRAM + 1, ALTERED - GRAM + 1 - GRAM * int(EDITS * ALTERED))

#: Words that measure a number.
UNITS = frozenset("ns us ms s sec secs second seconds min mins minute minutes h hour hours day days week weeks month months year years percent b kb mb gb tb kib mib gib bit bits byte bytes px mm cm m km g kg hz khz mhz ghz usd eur dollars euros line lines file files row rows point points time times item items".split())

MARKUP = re.compile(r"<!--[\s\S]*?-->|</?[A-Za-z][^<>\n]{0,200}>")
HIDDEN = re.compile("[­​-‏⁠﻿]")
PIECE = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """A text without markup and hidden characters, in lower case and compatibility form."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = MARKUP.sub(" ", text)
    if not text.isascii():
        text = HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    return text.lower()


def pieces(text: str) -> list[str]:
    """The pieces of a text."""
    return PIECE.findall(plain(text))


def word_numbers(text: str) -> np.ndarray:
    """The number of the word that each piece belongs to."""
    held = [len(PIECE.findall(w)) for w in plain(text).split()]
    return np.repeat(np.cumsum(np.array(held, dtype=np.int64) > 0) - 1, held)


def body(text: str) -> str:
    """An item without its first line, the stock instruction."""
    return text.split("\n", 1)[1] if "\n" in text else ""


@dataclass
class Items:
    """A block of items with the join tables of their raw grams and canonical windows; items of one body are one entry."""

    ids: list[list[int]] = field(default_factory=list)
    raws: list[np.ndarray] = field(default_factory=list)
    word: list[np.ndarray] = field(default_factory=list)
    vocabulary: dict[str, int] = field(default_factory=dict)
    entry: dict[bytes, int] = field(default_factory=dict)

    def add(self, item_id: int, text: str) -> None:
        """Adds an item; `word` holds the number of the item's own word that each piece belongs to."""
        raw, word, n = [], [], 0
        for w in plain(body(text)).split():
            got = PIECE.findall(w)
            if got:
                raw += [self.vocabulary.setdefault(p, len(self.vocabulary)) for p in got]
                word += [n] * len(got)
                n += 1
        if not raw:
            return
        own, words = np.array(raw, dtype=np.int64), np.array(word)
        at = self.entry.setdefault(own.tobytes() + words.tobytes(), len(self.ids))
        if at == len(self.ids):
            self.ids.append([])
            self.raws.append(own)
            self.word.append(words)
        self.ids[at].append(item_id)

    def seal(self, phrasing: set[str]) -> None:
        """Builds the sorted gram and window tables."""
        self.entry = {}
        self.names = list(self.vocabulary)
        self.kind = np.array([kind(p) for p in self.names], dtype=np.int64)
        self.stock = np.array([p in phrasing and p not in UNITS for p in self.names], dtype=bool)
        empty = np.zeros(0, dtype=np.int64)
        joined = lambda xs: np.concatenate(xs) if xs else empty
        hashes = [self.hash(self.canonical(r, np.zeros(len(r), dtype=np.int64))) for r in self.raws]
        h = joined(hashes).astype(np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.item = joined([np.full(len(x), i) for i, x in enumerate(hashes)])[order]
        self.place = joined([np.arange(len(x)) for x in hashes])[order]
        begins = [np.flatnonzero(np.diff(w, prepend=-1)) for w in self.word]
        begins = [b[b <= len(r) - GRAM] for r, b in zip(self.raws, begins, strict=True)]
        g = joined([self.grams(r)[b] for r, b in zip(self.raws, begins, strict=True)]).astype(np.uint64)
        order = np.argsort(g, kind="stable")
        self.gram = g[order]
        self.gram_item = joined([np.full(len(b), i) for i, b in enumerate(begins)])[order]
        self.gram_place = joined(begins)[order]

    def canonical(self, raw: np.ndarray, unknown: np.ndarray) -> np.ndarray:
        """Phrasing as its number, other pieces as their placeholder; `unknown` holds it for pieces that no item has."""
        known = raw >= 0
        at = np.where(known, raw, 0)
        return np.where(known & self.stock[at], at + 4, np.where(known, self.kind[at], unknown)).astype(np.uint64)

    @staticmethod
    def hash(canonical: np.ndarray) -> np.ndarray:
        """A hash of each window."""
        n = len(canonical) - WINDOW + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        out = np.zeros(n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(WINDOW):
                out = out * np.uint64(0x9E3779B97F4A7C15) + canonical[j : j + n]
            out ^= out >> np.uint64(32)
            out *= np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(29)
        return out

    def join(self, own: list[str]) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
        """The text's pieces as numbers, and (item, places in the text, places in the item) of the shared grams per item of which enough words begin one."""
        get = self.vocabulary.get
        raw = np.array([get(p, -1) for p in own], dtype=np.int64)
        if len(raw) < GRAM or not len(self.gram):
            return raw, []
        h = self.grams(raw)
        lo = np.searchsorted(self.gram, h, "left")
        hits = np.searchsorted(self.gram, h, "right") - lo
        hits[raw[: len(h)] < 0] = 0
        if not hits.any():
            return raw, []
        at = np.repeat(np.arange(len(h)), hits)
        row = np.repeat(lo - (np.cumsum(hits) - hits), hits) + np.arange(hits.sum())
        of = self.gram_item[row]
        enough = np.flatnonzero(np.bincount(self.gram_item[np.unique(row)], minlength=len(self.ids)) >= SHARED)
        out = []
        for i in enough.tolist():
            mine = of == i
            out.append((i, at[mine], self.gram_place[row[mine]]))
        return raw, out

    def leak(self, i: int, raw: np.ndarray, owner: np.ndarray, at: np.ndarray, place: np.ndarray) -> tuple[int, int, int, str] | None:
        """(run, words, edits, kind) of an item in a text, given its shared grams; None if there is no passage within the limits."""
        own, word = self.raws[i], self.word[i]
        run = longest_run(own, word, raw, at, place)
        if run >= EXACT:
            return run, run, 0, "exact"
        best = (0, 0)
        count = int(word[-1]) + 1
        for a, z, lo, hi in narrowed(word[place], at, owner, 0, count):
            passage = raw[a:z]
            # Of a passage of L item words L * (1 - EDITS) are kept, so all of their pieces occur.
            first = np.flatnonzero(np.diff(word, prepend=-1))
            held = np.logical_and.reduceat(np.isin(own, passage), first)
            span = windows(held[lo:hi], 1 - EDITS, 0)
            if span is None:
                continue
            x, y = np.searchsorted(word, [lo + span[0], lo + span[1]])
            got = measure(own[x:y], word[x:y] - word[x], passage, owner[a:z])
            best = max(best, got)
        return (run, *best, "altered") if best[0] >= ALTERED else None

    @staticmethod
    def grams(raw: np.ndarray) -> np.ndarray:
        """A number of each GRAM consecutive pieces."""
        n = max(0, len(raw) - GRAM + 1)
        out = np.zeros(n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(GRAM):
                out = out * np.uint64(0x9E3779B97F4A7C15) + (raw[j : j + n] + 2).astype(np.uint64)
        return out

    def reparameterised(self, own: list[str], raw: np.ndarray) -> list[tuple[int, int]]:
        """(item, slots): items whose template the text follows over ALTERED pieces or more with a one-to-one renaming of slots."""
        unknown = np.array([0 if r >= 0 else kind(p) for r, p in zip(raw.tolist(), own, strict=True)], dtype=np.int64)
        h = self.hash(self.canonical(raw, unknown))
        lo = np.searchsorted(self.hashes, h, "left")
        hits = np.searchsorted(self.hashes, h, "right") - lo
        if not hits.any():
            return []
        at = np.repeat(np.arange(len(h)), hits)
        row = np.repeat(lo - (np.cumsum(hits) - hits), hits) + np.arange(hits.sum())
        item, shift = self.item[row], at - self.place[row]
        order = np.lexsort((at, shift, item))
        item, shift, at = item[order], shift[order], at[order]
        cut = np.flatnonzero((np.diff(item) != 0) | (np.diff(shift) != 0) | (np.diff(at) != 1)) + 1
        first, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]])
        best: dict[int, int] = {}
        for x in np.flatnonzero(end - first + WINDOW - 1 >= ALTERED).tolist():
            i, d = int(item[first[x]]), int(shift[first[x]])
            there: dict[str, str] = {}
            back: dict[str, str] = {}
            fine = True
            for p in range(int(at[first[x]]), int(at[end[x] - 1]) + WINDOW):
                known = int(self.raws[i][p - d])
                a, b = self.names[known], own[p]
                if not self.stock[known]:
                    fine = fine and there.setdefault(a, b) == b and back.setdefault(b, a) == a
            if fine and any(a != b for a, b in there.items()):
                best[i] = max(best.get(i, 0), len(there))
        return list(best.items())


def kind(piece: str) -> int:
    """The placeholder of a piece that is no phrasing: a name, a value or a unit."""
    return 3 if piece in UNITS else 1 if piece.isalpha() else 2


def regions(at: np.ndarray, word: np.ndarray, words: int) -> list[tuple[int, int]]:
    """(first, last piece) of the parts of a text that can hold a passage of an item of `words` words, given the places of shared grams."""
    wide = words + int(EDITS * words) + GRAM
    at = np.unique(at)
    out = []
    for part in np.split(at, np.flatnonzero(np.diff(word[at]) > wide) + 1):
        a, b = np.searchsorted(word, word[part[0]] - wide, "left"), np.searchsorted(word, word[part[-1]] + wide, "right")
        out.append((int(a), int(b)))
    return out


def windows(held: np.ndarray, share: float, spare: float) -> tuple[int, int] | None:
    """(first, end) of all stretches of ALTERED words or more of which `share` of the words less `spare` are held; None if there is none."""
    n = len(held)
    if n < ALTERED:
        return None
    total = np.concatenate([[0.0], np.cumsum(held - share)])
    later = np.maximum.accumulate(total[::-1])[::-1]
    bound = total[: n - ALTERED + 1] - spare - 1e-6
    fits = np.flatnonzero(later[ALTERED:] >= bound)
    if not len(fits):
        return None
    # `later` falls, so the last end of a start is found by bisection.
    ends = n - np.searchsorted(later[::-1], bound[fits], "left")
    return int(fits[0]), int(ends.max())


def narrowed(item_word: np.ndarray, at: np.ndarray, owner: np.ndarray, lo: int, hi: int) -> list[tuple[int, int, int, int]]:
    """(first, end piece of the text, first, end word of the item) that can hold an altered passage, given the places of shared grams.

    In a passage of L item words at least L - (GRAM - 1) - GRAM * EDITS * L begin a shared gram.
    """

    def span(words: np.ndarray, lo: int, hi: int) -> tuple[int, int] | None:
        held = np.zeros(hi - lo)
        held[words - lo] = 1
        got = windows(held, 1 - GRAM * EDITS, GRAM - 1)
        return None if got is None else (lo + got[0], lo + got[1])

    whole = span(item_word, lo, hi)
    if whole is None:
        return []
    inside = (item_word >= whole[0]) & (item_word < whole[1])
    item_word, at = item_word[inside], at[inside]
    out = []
    for a, z in regions(at, owner, whole[1] - whole[0]):
        here = span(item_word[(at >= a) & (at < z)], *whole)
        if here is not None:
            out.append((a, z, *here))
    return out


def longest_run(item: np.ndarray, word: np.ndarray, raw: np.ndarray, at: np.ndarray, place: np.ndarray) -> int:
    """The most consecutive whole item words in the text, of runs that hold a shared gram."""
    first = np.flatnonzero(np.diff(word, prepend=-1))
    shifts, n = np.unique(at - place, return_counts=True)
    best = 0
    for s in shifts[n >= min(n.max(), EXACT - GRAM + 1)].tolist():
        lo, hi = max(0, -s), min(len(item), len(raw) - s)
        same = np.zeros(len(item), dtype=bool)
        same[lo:hi] = item[lo:hi] == raw[lo + s : hi + s]
        gaps = np.flatnonzero(~np.logical_and.reduceat(same, first))
        best = max(best, int(np.diff(gaps, prepend=-1, append=len(first)).max()) - 1)
    return best


def measure(item: np.ndarray, word: np.ndarray, passage: np.ndarray, owner: np.ndarray) -> tuple[int, int]:
    """(words, edits) of the longest span of ALTERED item words or more with at most EDITS edits a word; (0, 0) if there is none.

    `word` and `owner` number the words that the pieces of the item and of the passage belong to. The edits are the fewest
    words changed, dropped or added; an item word is kept if all of its pieces follow one another, however the passage
    spaces them. The spans from all first words are aligned at once, a row an item word.
    """
    first = np.append(np.flatnonzero(np.diff(word, prepend=-1)), len(item))
    n, m = len(first) - 1, len(passage)
    begin = np.flatnonzero(np.diff(owner, prepend=owner[0] - 1))
    end = np.append(begin[1:], m)
    w = (owner - owner[0]).astype(np.int32)
    starts = max(0, n - ALTERED + 1)
    cost = np.zeros((starts, m + 1), dtype=np.int32)
    best = (0, 0)
    for i in range(n):
        own = item[first[i] : first[i + 1]]
        k = len(own)
        if k > m:
            same = np.zeros(0, dtype=np.int64)
        else:
            fits = passage[: m - k + 1] == own[0]
            for t in range(1, k):
                fits &= passage[t : m - k + 1 + t] == own[t]
            same = np.flatnonzero(fits)
        live = min(i + 1, starts)
        if not live:
            continue
        old = cost[:live]
        new = old + 1
        new[:, end] = np.minimum(new[:, end], np.minimum.reduceat(old[:, :m], begin, axis=1) + 1)
        new[:, same + k] = np.minimum(new[:, same + k], old[:, same])
        new[:, 1:] = np.minimum(new[:, 1:], np.minimum.accumulate(new[:, :m] - w, axis=1) + w + 1)
        cost[:live] = new
        for a in range(min(live, i + 2 - ALTERED)):
            words, edits = i + 1 - a, int(new[a].min())
            if edits <= EDITS * words + 1e-9:
                if words > best[0]:
                    best = (words, edits)
                break
    return best


def _block(rows: list, phrasing: set[str]) -> Items:
    items = Items()
    for r in rows:
        items.add(r[0], r[1])
    items.seal(phrasing)
    return items


def phrases(items: DataFrame, item: str, text: str) -> set[str]:
    """Pieces of letters found in PHRASING of the distinct bodies or more, and in two: at most the pieces of 1 / PHRASING bodies."""

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [pieces(body(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(x) for x in own], pa.string())], names=["body"])

    bodies = items.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(text).mapInArrow(op, "body string").where("body <> ''").distinct()
    total = bodies.count()
    found = bodies.select(F.explode(F.array_distinct(F.split("body", " "))).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))
    return {r[0] for r in found.where(F.col("n") >= max(2, PHRASING * total)).select("piece").collect() if r[0].isalpha()}


def leaks(documents: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", renamed: bool = False) -> DataFrame:
    """(doc, item, run, words, edits, kind) per pair of a document and an item that leaked into it.

    A pair is found if the document holds at least EXACT consecutive words of the item (kind `exact`, `words` its run), or at
    least ALTERED with at most one in five changed, dropped or added (`altered`); with `renamed`, also if it follows the item's
    template with a consistent renaming (`renamed`). Null and empty texts have none; an item's first line does not count; items
    that are equal are found each. Items are held by every task in blocks of BLOCK rows (a bounded size; the driver holds one
    block at a time, and the documents are read once a block), documents are never shuffled.
    """
    spark = documents.sparkSession
    phrasing = phrases(items, item, text) if renamed else set()
    kinds, item_kinds = dict(documents.dtypes), dict(items.dtypes)
    schema = f"`{doc}` {kinds[doc]}, `{item}` {item_kinds[item]}, run int, words int, edits int, kind string"
    rows = items.select(item, text).dropna().dropDuplicates().orderBy(text, item).toLocalIterator()
    found = None
    while (block := list(islice(rows, BLOCK))) or found is None:
        shared = spark.sparkContext.broadcast(_block(block, phrasing))

        def op(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block: Items = shared.value
            for b in batches:
                out = []
                for d, t in zip(b.column(0).to_pylist(), (x.as_py() for x in b.column(1)), strict=True):
                    if not t:
                        continue
                    own = pieces(t)
                    best: dict[int, tuple] = {}
                    raw, joined = block.join(own)
                    owner = word_numbers(t) if joined else None
                    for i, at, place in joined:
                        if got := block.leak(i, raw, owner, at, place):
                            best[i] = got
                    if renamed:
                        for i, slots in block.reparameterised(own, raw) if len(raw) >= ALTERED and len(block.hashes) else ():
                            best.setdefault(i, (0, slots, 0, "renamed"))
                    out += [(d, j, *x) for i, x in best.items() for j in block.ids[i]]
                cols = list(zip(*out, strict=True)) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.int64() if item_kinds[item] == "bigint" else None), *[pa.array(cols[i], pa.int32()) for i in (2, 3, 4)], pa.array(cols[5], pa.string())],
                    names=[doc, item, "run", "words", "edits", "kind"],
                )

        part = documents.select(doc, text).mapInArrow(op, schema)
        found = part if found is None else found.unionByName(part)
    return found
