"""Encoding of a corpus with a public byte-level BPE vocabulary.

Frequent words, counted over all texts, are encoded once and compiled into a minimal acyclic transducer: a
deterministic automaton with shared prefixes and suffixes whose arcs carry number outputs; the outputs along a word's path add up
to its rank in the sorted lexicon, and the rank addresses its ids in one flat array. The arrays are saved next to
each other in one file that executors map into memory. A word the transducer does not accept is merged exactly, by
rank, from its bytes.
"""

from __future__ import annotations

import base64
import mmap
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlens.session import shared_dir

#: Place of the vocabulary files (a parameter) and of the one used by default.
VOCABULARIES = os.environ.get("FACTLENS_TOKENIZERS", "/opt/tokenizers")
RANKS = "byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that cuts a text into words before the merges of these rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Most words of the lexicon, and fewest times a word must occur to be in it.
WORDS, OFTEN = 60_000, 3


def load_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and their ids, which are also their merge ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: the adjacent pair of lowest rank is joined until none is in the vocabulary (leftmost first)."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > 200:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap over a linked list, for words of any length."""
    import heapq

    n = len(word)
    nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def push(i: int) -> None:
        j = nxt[i]
        if j < n:
            r = ranks.get(word[i : end[j]])
            if r is not None:
                heapq.heappush(heap, (r, i, j, end[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, j, e = heapq.heappop(heap)
        if not alive[i] or nxt[i] != j or j >= n or not alive[j] or end[j] != e:
            continue
        alive[j] = False
        end[i], nxt[i] = e, nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        push(i)
        if prv[i] >= 0:
            push(prv[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = nxt[i]
    return out


def build(words: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """The minimal acyclic transducer of a lexicon, built in one pass over the sorted words.

    Arrays: first[s] .. first[s+1] are the arcs of state s (sorted by byte); byte, to and skip of each arc; final[s]; and
    start[r] .. start[r+1] the place in ids of the word of rank r. A word's rank is the sum of its arcs' skips.
    """
    known: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    path: list[list] = [[False, []]]  # open states of the word before: [final, arcs (byte, state)]

    def close(depth: int, word: bytes) -> None:
        while len(path) - 1 > depth:
            final, arcs = path.pop()
            key = (final, tuple(arcs))
            state = known.get(key)
            if state is None:
                state = known[key] = len(states)
                states.append(key)
            path[-1][1].append((word[len(path) - 1], state))

    before = b""
    ordered = sorted(words)
    for word in ordered:
        common = 0
        while common < min(len(word), len(before)) and word[common] == before[common]:
            common += 1
        close(common, before)
        path += [[False, []] for _ in range(len(word) - common)]
        path[-1][0] = True
        before = word
    close(0, before)
    final, arcs = path[0]
    states.append((final, tuple(arcs)))
    accepted = np.zeros(len(states), dtype=np.int64)
    byte, to, skip, first = [], [], [], [0]
    for s, (final, arcs) in enumerate(states):
        n = int(final)
        for b, t in arcs:
            byte.append(b)
            to.append(t)
            skip.append(n)
            n += int(accepted[t])
        accepted[s] = n
        first.append(len(byte))
    lists = [words[w] for w in ordered]
    return {
        "first": np.array(first, dtype=np.int32),
        "byte": np.array(byte, dtype=np.uint8),
        "to": np.array(to, dtype=np.int32),
        "skip": np.array(skip, dtype=np.int32),
        "final": np.array([f for f, _ in states], dtype=np.uint8),
        "start": np.cumsum([0, *map(len, lists)]).astype(np.int32),
        "ids": np.array([i for x in lists for i in x], dtype=np.int32),
    }


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """One file: a first line of name:dtype:length, then the arrays, each from a multiple of 16."""
    head = ";".join(f"{k}:{v.dtype.str}:{len(v)}" for k, v in arrays.items()).encode() + b"\n"
    out = bytearray(head)
    for v in arrays.values():
        out += b"\0" * (-len(out) % 16)
        out += v.tobytes()
    return bytes(out)


class Transducer:
    """A packed transducer, mapped from its file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        at = self.map.find(b"\n") + 1
        for entry in self.map[: at - 1].decode().split(";"):
            name, kind, n = entry.split(":")
            at += -at % 16
            setattr(self, name, np.frombuffer(self.map, dtype=kind, count=int(n), offset=at))
            at += np.dtype(kind).itemsize * int(n)
        self.root = len(self.final) - 1

    def ids_of(self, word: bytes) -> list[int] | None:
        """The ids of a word of the lexicon, else None."""
        first, byte, to, skip = self.first, self.byte, self.to, self.skip
        state, rank = self.root, 0
        for b in word:
            lo, hi = int(first[state]), int(first[state + 1])
            i = lo + int(byte[lo:hi].searchsorted(b))
            if i == hi or byte[i] != b:
                return None
            rank += int(skip[i])
            state = int(to[i])
        if not self.final[state]:
            return None
        return self.ids[self.start[rank] : self.start[rank + 1]].tolist()


@lru_cache(maxsize=2)
def _transducer(path: str) -> Transducer:
    return Transducer(path)


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    return load_ranks(path)


def frequent_words(texts: DataFrame, text: str, words: int, often: int) -> list[str]:
    """The most frequent words of all texts: at least `often` times, at most `words` of them."""
    found = F.explode(F.regexp_extract_all(F.col(text), F.lit("(?U)" + PATTERN), F.lit(0)))
    counted = texts.select(found.alias("w")).groupBy("w").agg(F.count("*").alias("n")).where((F.col("n") >= often) & (F.length("w") <= 64))
    return [r["w"] for r in counted.orderBy(F.desc("n"), "w").limit(words).collect()]


def ship(spark, data: bytes, name: str) -> str:
    """Puts a file into the shared folder and hands a copy to every executor; returns its name there."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}.bin"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
    for i in range(0, len(data), 1 << 20):
        out.write(bytearray(data[i : i + (1 << 20)]))
    out.close()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


def encode(df: DataFrame, key: str, text: str, ranks: str | None = None, words: int = WORDS, often: int = OFTEN) -> DataFrame:
    """(key, ids) of every row: the token ids of its text, no special tokens.

    A null text has null ids, an empty text an empty list; strings of special tokens are ordinary text; texts of any
    length are encoded whole. Repeated keys give repeated rows; other columns are ignored.
    """
    spark = df.sparkSession
    ranks_path = ranks or os.path.join(VOCABULARIES, RANKS)
    table = load_ranks(ranks_path)
    lexicon = {w.encode(): merge(w.encode(), table) for w in frequent_words(df, text, words, often)}
    name = ship(spark, pack(build(lexicon)), "lexicon")
    # The vocabulary is shipped too, so that executors need no folder of their own.
    spark.sparkContext.addFile(ranks_path)
    ranks_name = os.path.basename(ranks_path)

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = SparkFiles.get(name)
        auto = _transducer(path)
        cut = regex.compile(PATTERN)
        seen: dict[str, list[int]] = {}

        def ids(word: str) -> list[int]:
            raw = word.encode("utf-8", "replace")
            out = auto.ids_of(raw)
            if out is None:
                out = merge(raw, _ranks(SparkFiles.get(ranks_name)))
            if len(word) <= 64:
                if len(seen) >= 200_000:
                    seen.clear()
                seen[word] = out
            return out

        for b in batches:
            rows = b.num_rows
            for at in range(0, rows, 2000):
                part = b.slice(at, 2000)
                lists = []
                for t in part.column(1).to_pylist():
                    if t is None:
                        lists.append(None)
                        continue
                    one: list[int] = []
                    for w in cut.findall(t):
                        got = seen.get(w)
                        one += ids(w) if got is None else got
                    lists.append(one)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lists, type=pa.list_(pa.int32()))], names=[key, "ids"])

    return df.select(key, text).mapInArrow(op, f"`{key}` {dict(df.dtypes)[key]}, ids array<int>")


def decode(ids: pd.Series, ranks: dict[bytes, int]) -> pd.Series:
    """Texts of id lists, for round trips."""
    back = {v: k for k, v in ranks.items()}
    return ids.map(lambda x: None if x is None else b"".join(back[i] for i in x).decode("utf-8", "replace"))
