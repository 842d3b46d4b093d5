"""Source files that were not written by hand for their repository.

Evidence of a file: its path is covered by a generated path of its repository; its comments say that a tool wrote it or
that it is a third party's; its path lies in a folder for third-party code; its code is minified; it is data held as
code; its code repeats one line shape. Evidence of the whole corpus: token streams, without comments and layout and with numbers as one
token, are fingerprinted by winnowing (of every WINDOW consecutive hashes of GRAM tokens, the least), and a file whose
fingerprints largely recur together, as one file, under unrelated owners is a vendored copy, whatever its path or comments
say. Fingerprints shared with ever other files are idioms of the language. A file of few fingerprints is a copy if its whole
token stream recurs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlens.session import written

#: Tokens of a hash, hashes of a window, fingerprints below which the whole stream is judged, owners of a copied file, share of fingerprints that name one leader.
GRAM, WINDOW, FEWEST, OWNERS, SHARE = 16, 8, 8, 3, 0.4
#: Different copies an owner has of one file, on average, above which it is boilerplate.
SPREAD = 1.5
#: Most fingerprints that are joined by broadcast: each has over one in HOT of all rows.
HOT = 10_000
#: Pattern rows up to which they are broadcast (a path pattern is far below a kilobyte).
BROADCAST_PATTERNS = 100_000

#: Phrases of tools about their own output, at the start of a comment or anywhere in it.
TOOL = re.compile(
    r"""(?ix)
    @generated\b
    | ^\W*(?:this\ (?:file|code|source)\ (?:is|was|has\ been)\ )?auto(?:matically)?[-\ ]?generated\b
    | ^\W*(?:code\ |file\ |source\ )?(?:generated|autogenerated|produced|emitted|created|written)\ (?:automatically\ )?(?:by|from|with|on)\ \S
    | ^\W*(?:machine|tool|auto)[- ](?:written|generated|made)\b
    | \bgenerated\ (?:code|file|source)\b.{0,12}\bdo\ not\ (?:edit|modify|change)
    | \bdo\ not\ (?:edit|modify|change|touch)\b(?:\ (?:this\ file|it))?\W{0,4}\s*(?:written|generated|created|produced)\ by\b
    | \bgenerated\b.{0,80}\bdo\ not\ (?:edit|modify|change)\W*$
    | ^\W*do\ not\ (?:edit|modify|change)(?:\ (?:this\ file|by\ hand|manually))?\W*$
    | \bmanual\ (?:modifications?|changes?|edits?)\b.{0,30}\b(?:lost|overwritten)\b
    | \bchanges\ (?:made\ )?(?:here|to\ this\ file)\ (?:are|will\ be|may\ be|get)\ (?:lost|overwritten)
    | ^\W*[\w.-]+:\ output\ of\ \S+
    | \bautomatisch\b.{0,60}\b(?:erzeugt|generiert|erstellt)
    | \b(?:généré|créé)e?\ automatiquement | \b(?:generado|creado)\ autom[aá]ticamente | \bсгенерирован | 自动生成 | 自動生成
    """
)
#: Phrases of third-party copies.
THIRD = re.compile(
    r"""(?ix)
    ^\W*third[- ]party\ (?:code|source|library|software)\b
    | ^\W*vendored\ (?:copy|from|version|code)\b
    | ^\W*(?:copied|imported|taken)\ (?:unchanged|verbatim|unmodified)?\ ?from\ \S+
    | ^\W*upstream:\ *(?:https?|git|ssh)\S*
    | \blocal\ (?:edits|changes|modifications)\ (?:are|will\ be)\ (?:overwritten|lost)
    | \bdo\ not\ patch\ here\b | \bsend\ (?:changes|patches)\ upstream\b
    | \bsynced\ (?:by|from|with)\ \S*upstream
    | ^\W*\S+\ v?\d[\w.]*\ \|\ \(c\)\ .*\blicen[cs]e
    | ^/\*!\ *\S+\ v?\d[\w.]*
    """
)
#: What either needs, for a quick look at a whole text.
HINT = re.compile(
    r"(?i)generated|do not |machine[- ]|tool[- ]w|produced by|written by|created by|emitted by|output of|automat|upstream|third[- ]party|vendored|unchanged from|verbatim from|manual |changes |local (?:edits|changes|mod)|\(c\)|/\*!|сгенер|自动|自動"
)
#: Folders that hold third-party code by convention.
FOLDERS = re.compile(r"(?i)(?:^|/)(?:vendor|vendored|_vendor|third[-_]?party|3rdparty|3rd[-_]party|node_modules|bower_components|jspm_packages|external|externals|extern|pods|carthage|deps|site-packages|contrib/upstream)/")

TOKEN = re.compile(
    r"(//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|^[ \t]*(?:#(?![ \t]*(?:include|define|if|ifdef|ifndef|else|elif|endif|pragma|undef|\[|!\[))|;;|--[ \t])[^\n]*)"
    r"|(\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)"
    r"|(\d[\w.]*)|([^\W\d]\w*|[^\w\s])",
    re.M,
)
SHAPE = re.compile(r"\w+")


@lru_cache(maxsize=4096)
def path_pattern(pattern: str) -> re.Pattern | None:
    """A generated path as an expression: `*` is any text, a pattern without it covers that path and all below; None if blank."""
    p = pattern.replace("\\", "/").strip().strip("/").strip()
    if not p:
        return None
    body = ".*".join(re.escape(x) for x in p.split("*"))
    return re.compile(body if "*" in p else body + r"(?:/.*)?", re.S)


def covered(path: str | None, patterns: list[str | None] | None) -> bool:
    """Whether one of the patterns covers the path."""
    if path is None or not patterns:
        return False
    p = re.sub(r"^(?:\./)+", "", path.replace("\\", "/"))
    return any((r := path_pattern(x)) is not None and r.fullmatch(p) is not None for x in patterns if x is not None)


def comment_lines(comment: str) -> Iterator[str]:
    """The lines of a comment without its marks; a comment that begins with `/*!` keeps it."""
    for line in comment.split("\n"):
        s = line.strip()
        yield s if s.startswith("/*!") else s.lstrip("/*#;- \t").removesuffix("*/").strip()


_IDS: dict[str, int] = {}


def token_ids(tokens: list[str]) -> np.ndarray:
    """A 64-bit number of each token, the same in every process."""
    import zlib

    out = []
    for t in tokens:
        v = _IDS.get(t)
        if v is None:
            if len(_IDS) > 500_000:
                _IDS.clear()
            raw = t.encode("utf-8", "replace")
            v = _IDS[t] = (zlib.crc32(raw) << 31) ^ zlib.adler32(raw[::-1] + b"~")
        out.append(v)
    return np.array(out, dtype=np.uint64)


def winnow(ids: np.ndarray) -> np.ndarray:
    """The distinct fingerprints of a token stream; one shorter than GRAM has none."""
    n = len(ids)
    if n < GRAM:
        return np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        h = (ids + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        width, factor = 1, np.uint64(0x100000001B3)
        while width < GRAM:
            h = h[: len(h) - width] * factor + h[width:]
            factor = factor * factor
            width *= 2
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(30)
    low = h
    width = 1
    while width < WINDOW and len(low) > width:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    return np.unique(low).view(np.int64)


def whole(ids: np.ndarray) -> int | None:
    """A number of a whole token stream; one shorter than GRAM has none."""
    return int.from_bytes(blake2b(ids.tobytes(), digest_size=8).digest(), "little", signed=True) if len(ids) >= GRAM else None


def evidence(text: str) -> tuple[bool, bool, bool, bool, bool, np.ndarray, int | None]:
    """(tool, third, minified, data, repeated, fingerprints, whole stream) of one text."""
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    tool = third = False
    comments: list[str] = []
    tokens: list[str] = []
    literal = code = long_ = literals = 0
    names = 0
    for c, s, n, w in TOKEN.findall(text):
        if w:
            tokens.append(w)
            code += len(w)
        elif c:
            comments.append(c)
        elif n:
            tokens.append("0")
            literal += len(n)
            literals += 1
        else:
            tokens.append(s)
            literals += 1
            if len(s) > 40 and " " not in s:
                long_ += len(s)
            literal += len(s)
    if comments and HINT.search(text):
        for c in comments:
            if HINT.search(c):
                for line in comment_lines(c):
                    tool = tool or TOOL.search(line) is not None
                    third = third or THIRD.search(line) is not None
    solid = code + literal
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    wide = [x for x in lines if len(x) > 300]
    minified = False
    if wide:
        bare = "".join(TOKEN.sub(lambda m: "" if m[1] else m[0], x) for x in wide)
        blank = bare.count(" ") + bare.count("\t")
        minified = len(bare) > 300 and blank < 0.12 * len(bare) and len(bare) * 2 > sum(map(len, lines))
    # Punctuation between literals belongs to the data; words are what makes code.
    words = sum(len(t) for t in tokens if t[0].isalpha() or t[0] == "_")
    names = words
    data = literals >= 30 and literal >= 4 * names or long_ >= 400 and long_ * 10 >= 7 * solid
    head = text.lstrip()[:1]
    if not data and head and head in "{[" and literals >= 4 and names <= 0.05 * solid:
        data = True
    repeated = False
    shapes: dict[str, int] = {}
    total = 0
    in_comment = set()
    for x in comments:
        in_comment.update(y.strip() for y in x.split("\n"))
    for x in lines:
        s = x.strip()
        if s in in_comment:
            continue
        total += 1
        k = SHAPE.sub("w", s)
        if len(k) > 6:
            shapes[k] = shapes.get(k, 0) + 1
    if total >= 8 and shapes:
        repeated = max(shapes.values()) >= 0.45 * total
    ids = token_ids(tokens)
    return tool, third, minified, data, repeated, winnow(ids), whole(ids)


def judged(sources: DataFrame) -> DataFrame:
    """(file_id, owner, covered, tool, third, folder, minified, data, repeated, prints, stream) per file.

    `sources` has file_id, path, repo, patterns (array of the repo's generated paths) and content (not null).
    """

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            paths, patterns = b.column("path").to_pylist(), b.column("patterns").to_pylist()
            for path, pats, text in zip(paths, patterns, (x.as_py() for x in b.column("content")), strict=True):
                tool, third, minified, data, repeated, prints, stream = evidence(text)
                folder = path is not None and FOLDERS.search(path.replace("\\", "/")) is not None
                rows.append((covered(path, pats), tool, third, folder, minified, data, repeated, prints, stream))
            flags = [pa.array([r[i] for r in rows], pa.bool_()) for i in range(7)]
            yield pa.RecordBatch.from_arrays(
                [b.column("file_id"), b.column("owner"), *flags, pa.array([r[7] for r in rows], pa.list_(pa.int64())), pa.array([r[8] for r in rows], pa.int64())],
                names=["file_id", "owner", "covered", "tool", "third", "folder", "minified", "data", "repeated", "prints", "stream"],
            )

    owner = F.xxhash64(F.split(F.coalesce("repo", F.lit("")), "/")[0]).alias("owner")
    return sources.select("file_id", "path", owner, "patterns", "content").mapInArrow(
        op, "file_id long, owner long, covered boolean, tool boolean, third boolean, folder boolean, minified boolean, data boolean, repeated boolean, prints array<long>, stream long"
    )


def copied(judgements: DataFrame) -> DataFrame:
    """(file_id): files that recur as a whole under unrelated owners, told by their fingerprints alone.

    Each fingerprint found under two owners or more names a leader, the least file by (told as third-party, hash) that has it.
    A file is a copy of a leader if at least FEWEST fingerprints, and SHARE of the file's and of the leader's own, name
    it: idioms of a language name ever other leaders. The copies count if OWNERS owners have them, or two where the leader
    is told as third-party by its comments or folder; with over SPREAD different ones an owner they are boilerplate. A file of
    fewer fingerprints is a copy if its whole stream recurs under OWNERS owners.

    Leaders come from one aggregation with map-side reduction; the fingerprints with over one in HOT of all rows, HOT at
    most, are joined by broadcast, so that none is a task of its own.
    """
    mark = F.xxhash64("owner", "stream").bitwiseAND(F.lit((1 << 63) - 1))
    # Equal streams of one owner share a number; its sign puts files told as third-party first.
    kept = judgements.where("stream is not null").withColumn("f", F.when(F.col("third") | F.col("folder"), mark - F.lit((1 << 63) - 1) - 1).otherwise(mark))
    long = kept.where(F.size("prints") >= FEWEST)
    lead = long.select("f", "owner", F.explode("prints").alias("print")).groupBy("print").agg(F.min("f").alias("leader"), F.min("owner").alias("_a"), F.max("owner").alias("_b"), F.count("*").alias("n"))
    lead = written(lead.where("_a <> _b").select("print", "leader", "n"), "handwritten-leaders")
    total = lead.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") > F.lit(total // HOT)
    many, few = F.broadcast(lead.where(hot).select("print", "leader")), lead.where(~hot).select("print", "leader")
    named = long.select("file_id", F.explode("prints").alias("print"))
    counts = lambda side: named.join(side, "print").groupBy("file_id", "leader").agg(F.count("*").alias("hits"))
    hits = counts(many).unionByName(counts(few)).groupBy("file_id", "leader").agg(F.sum("hits").alias("hits")).where(F.col("hits") >= FEWEST)
    enough = hits.join(long.select("file_id", "f", "owner", F.size("prints").alias("size")), "file_id").where(F.col("hits") >= F.col("size") * F.lit(SHARE))
    sizes = long.select(F.col("f").alias("leader"), F.size("prints").alias("whole")).distinct()
    members = written(enough.join(sizes, "leader").where(F.col("hits") >= F.col("whole") * F.lit(SHARE)).select("file_id", "f", "owner", "leader"), "handwritten-copies")
    spread = members.groupBy("leader", "owner").agg(F.countDistinct("f").alias("n")).groupBy("leader").agg(F.count("*").alias("owners"), F.sum("n").alias("n"))
    spread = spread.where((F.col("n") <= F.col("owners") * F.lit(SPREAD)) & ((F.col("owners") >= OWNERS) | ((F.col("leader") < 0) & (F.col("owners") >= 2))))
    found = members.join(spread.select("leader"), "leader", "left_semi").select("file_id")
    short = kept.where(F.size("prints") < FEWEST)
    streams = short.select("stream", "owner").distinct().groupBy("stream").agg(F.count("*").alias("owners")).where(F.col("owners") >= OWNERS).select("stream")
    return found.union(short.join(streams, "stream", "left_semi").select("file_id")).distinct()


def not_handwritten(sources: DataFrame, config: DataFrame) -> DataFrame:
    """(file_id, covered, tool, third, folder, minified, data, repeated, copied) of the files with any of these.

    `sources` has file_id (unique), path, repo and content (not null), `config` repo and generated_path (null and blank patterns cover
    nothing; a null repo has none). A null path is in no folder and covered by nothing.
    """
    patterns = config.where("repo is not null and generated_path is not null").groupBy("repo").agg(F.collect_set("generated_path").alias("patterns"))
    if config.count() <= BROADCAST_PATTERNS:
        patterns = F.broadcast(patterns)
    flags = written(judged(sources.join(patterns, "repo", "left")), "handwritten")
    found = flags.join(copied(flags).withColumn("_copied", F.lit(True)), "file_id", "left").withColumn("copied", F.coalesce("_copied", F.lit(False)))
    kinds = ["covered", "tool", "third", "folder", "minified", "data", "repeated", "copied"]
    return found.select("file_id", *kinds).where(" or ".join(kinds))
