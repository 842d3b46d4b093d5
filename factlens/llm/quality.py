"""Per-document text statistics, and text types learned from them.

Statistics: words, mean word length, symbol ratio, share of lines that end in punctuation, share of common words, and the
share of characters in lines that are no prose. For the last, each line's statistics vote through thresholds: a
labelling function says prose, no prose, or abstains. Nobody labels anything: the functions' accuracies and the
share of each type are learned by expectation-maximization on how their votes agree over all lines of the corpus, and
every pattern of votes gets its posterior type.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlens.session import written

#: Common words by language, the words that hold sentences together.
COMMON_WORDS = {
    "en": "the a an and or but of to in on at for from with by is are was were be been has have had do does did it its this that these those not no if then than when who what which why how we you he she they i my our your their there as so once yet can could should would will must may let still more most one both about again someone nobody now here there why well just into out up down over after before because until while also only never any all some such too very please",
    "de": "bitte ob muss müssen kann wirklich eigentlich zwei der die das den dem des ein eine einen einem einer und oder aber nicht kein keine ist sind war wir ihr sie er es ich zu in im an am auf für von mit bei aus nach vor über unter wenn dann weil dass als wie was wer warum noch nur schon auch so sich haben hat wird werden wurde sollten vielleicht danach zuerst mehr niemand diese dieser dieses",
    "fr": "le la les un une des du de et ou mais ne pas est sont était être avoir a ont il elle ils nous vous je on ce cette ces qui que quoi dont où pour par avec sans sur sous dans en au aux si plus encore tous toutes parce avant après depuis personne jamais merci y",
    "es": "el la los las un una unos unas y o pero no es son era ser ha han hay en de del al a por para con sin sobre que quien cual como cuando donde si se su sus lo le les nos más ya todavía nadie ninguna ningún este esta estos porque antes después desde muy",
    "ru": "и в во не на я он она они мы вы что это этот эта эти как так но да по к ко у из за от до с со о об для же бы ли то если когда где кто или нет был была были есть мой наш ваш их его её ещё уже только потому чтобы никто после два при всем лучше",
    "it": "il lo la gli le un una di da del della e o ma non è sono era per con su in che chi come quando se si più anche questo questa",
    "pt": "o a os as um uma de do da dos das e ou mas não é são foi para por com sem em no na que quem como quando se mais já este esta",
    "nl": "de het een en of maar niet is zijn was van in op te voor met aan bij uit dat die dit deze als dan ook nog maar we wij ze zij er wordt worden",
    "pl": "i w na nie się z do to jest że o jak ale po za od czy tak już tylko być są dla przez może ten ta te",
}
COMMON = frozenset(w for ws in COMMON_WORDS.values() for w in ws.split())
#: Scripts written without spaces, whose runs of letters are prose by themselves.
UNSPACED = re.compile(r"[぀-ヿ㐀-䶿一-鿿฀-๿가-힯]")
WORD = re.compile(r"\w+(?:['’]\w+)*")
PART = re.compile(r"\w+")
#: Inline code of a sentence counts as one word.
CODE = re.compile(r"`[^`\n]{1,120}`")
STOP = ".!?…。！？:;»”\"')"
ENDS = re.compile(r"[.!?…。！？]['\"”’»)\]`*_]*$")
FUNCTIONS = ("common", "symbols", "shape", "spaces", "length", "ending", "run", "sound", "density", "variety")
#: Runs of consonants that hardly a natural word has, in the Latin and Cyrillic scripts, and words without a vowel.
HARSH = re.compile(r"[bcdfghjklmnpqrstvwxz]{5}|[бвгджзклмнпрстфхцчшщ]{5}|^[bcdfghjklmnpqrstvwxz]{4,}$|^[бвгджзклмнпрстфхцчшщ]{4,}$")


class Kinds(dict):
    """The kind of each character, for `translate`: a letter, m mark, s white space, d other alphanumeric, o any other."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = kind = "a" if c.isalpha() else "s" if c.isspace() else "d" if c.isalnum() else "m" if unicodedata.category(c)[0] == "M" else "o"
        return kind


KINDS = Kinds()
LETTERS, DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")
ENTRY = re.compile(r"(?:[-*+•·]|\(?\d+[.):]|\[[ xX]\]|[A-Za-z_][\w.]*\s*[=:]\s*\S+$|[{}\[\]<|\"]|\|)")
GAP = re.compile(r"\S {3,}\S")


@lru_cache(maxsize=1 << 17)
def is_harsh(word: str) -> bool:
    """Whether a word has a run of consonants that hardly a natural word has."""
    return HARSH.search(word) is not None


def line_shape(line: str) -> str:
    """A line with runs of letters and of digits made equal."""
    return DIGITS.sub("0", LETTERS.sub("a", line))


def line_votes(line: str, shape: str, before: str | None, after: str | None) -> tuple[int, ...]:
    """The votes of the labelling functions on a line that is not blank, given its shape and those of its neighbours: 0 prose, 1 no prose, 2 abstains."""
    s = line.strip()
    if "`" in s:
        s = CODE.sub("code", s)
        shape = line_shape(s)
    n = len(s)
    words = PART.findall(s)
    kinds = s.translate(KINDS)
    letters = kinds.count("a") + kinds.count("m")
    blanks = kinds.count("s")
    low = [w.lower() for w in words if not w.isdigit()]
    unspaced = UNSPACED.search(s) is not None and letters > 0.5 * n
    common = sum(w in COMMON for w in low)
    share = common / len(low) if low else 0.0
    v_common = 0 if common >= 2 or share >= 0.25 or unspaced else 1 if not common and len(words) != 1 else 2
    rest = (n - letters - blanks) / n
    v_symbols = 1 if rest >= 0.28 else 0 if rest <= 0.12 else 2
    entry = ENTRY.match(s) is not None
    fields = max(s.count(d) for d in ("\t", ";", "|", ","))
    sep = s.count("\t") >= 1 or s.count(";") >= 2 or s.count("|") >= 2 or (s.count(",") >= 2 and s.count(", ") < s.count(","))
    v_shape = 1 if entry or (sep and fields >= 2) or GAP.search(s) or (s.count("/") >= 1 and blanks == 0) else 0 if len(words) >= 5 or unspaced else 2
    token = (n - blanks) / (blanks + 1)
    v_spaces = 0 if unspaced else 1 if n >= 20 and token > 14 else 0 if 3 <= token <= 8 and len(words) >= 4 else 2
    mean = sum(map(len, words)) / len(words) if words else 0.0
    v_length = 0 if unspaced else 1 if mean > 9 else 0 if len(words) >= 4 and 3 <= mean <= 7.5 and letters > 0.6 * n else 2
    v_ending = 0 if ENDS.search(s) and (len(words) >= 3 or unspaced) else 1 if s[-1:] in ";|{}[]" else 2
    v_run = 1 if shape in (before, after) else 2
    long_ = [w for w in low if len(w) >= 4 and w.isalpha()]
    harsh = sum(map(is_harsh, long_)) / len(long_) if long_ else 0.0
    v_sound = 1 if harsh >= 0.2 else 0 if len(long_) >= 2 and harsh <= 0.05 else 2
    pauses = sum(s.count(c) for c in ",.;:!?…")
    v_density = 2 if unspaced or len(words) < 10 else 1 if share < 0.04 and pauses * 20 < len(words) else 0 if share >= 0.12 else 2
    variety = len(set(low)) / len(low) if low else 1.0
    v_variety = 2 if len(low) < 12 else 1 if variety < 0.4 and variety * math.sqrt(len(low)) < 3 else 0 if share >= 0.12 else 2
    return v_common, v_symbols, v_shape, v_spaces, v_length, v_ending, v_run, v_sound, v_density, v_variety


def statistics(text: str) -> tuple[int, float, float, float, float, dict[int, int]]:
    """(words, mean word length, symbol ratio, punctuated share, common share, characters by vote pattern) of a text.

    Shares of nothing are 0. Characters are those that are no white space.
    """
    lines = [x for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    full = [x for x in lines if x.strip()]
    words = WORD.findall(text)
    kinds = text.translate(KINDS)
    solid = len(kinds) - kinds.count("s")
    marks = kinds.count("o")
    patterns: dict[int, int] = {}
    shapes = [None, *[line_shape(x.strip()) for x in full], None]
    for i, x in enumerate(full):
        code = 0
        for v in line_votes(x, shapes[i + 1], shapes[i], shapes[i + 2]):
            code = code * 3 + v
        patterns[code] = patterns.get(code, 0) + len("".join(x.split()))
    return (
        len(words),
        sum(map(len, words)) / len(words) if words else 0.0,
        marks / solid if solid else 0.0,
        sum(ENDS.search(x.strip()) is not None for x in full) / len(full) if full else 0.0,
        sum(w.lower() in COMMON for w in words) / len(words) if words else 0.0,
        patterns,
    )


def votes_of(code: int) -> list[int]:
    """The votes of a pattern."""
    out = []
    for _ in FUNCTIONS:
        out.append(code % 3)
        code //= 3
    return out[::-1]


#: The types a line can have, and their shares to start from.
TYPES, START = ("prose", "entries", "junk"), (0.7, 0.2, 0.1)


def learn(patterns: dict[int, float], rounds: int = 300) -> tuple[dict[int, list[float]], list[list[list[float]]], list[float]]:
    """(posterior of each type per pattern, vote shares per function and type, type shares), by expectation-maximization.

    The types are told apart by the start alone: prose is voted prose, entries are voted no prose, and junk made of
    words looks like prose but for its words (common, density, variety, sound). Patterns carry weights; without any, the result is empty.
    """
    m, kinds = len(FUNCTIONS), range(len(TYPES))
    votes = {p: votes_of(p) for p in patterns}
    total = sum(patterns.values())
    share = list(START)
    like, unlike = [0.5, 0.2, 0.3], [0.2, 0.5, 0.3]
    theta = [[like, unlike, [0.1, 0.6, 0.3] if f in ("common", "density", "variety", "sound") else like] for f in FUNCTIONS]
    post: dict[int, list[float]] = {}
    for _ in range(rounds):
        new = {}
        for p, v in votes.items():
            logs = [math.log(share[k]) + sum(math.log(theta[j][k][v[j]]) for j in range(m)) for k in kinds]
            top = max(logs)
            raw = [math.exp(x - top) for x in logs]
            new[p] = [x / sum(raw) for x in raw]
        moved = max((abs(a - b) for p in new for a, b in zip(new[p], post.get(p, START), strict=True)), default=0.0)
        post = new
        if not total or moved < 1e-6:
            break
        weight = [sum(patterns[p] * post[p][k] for p in patterns) for k in kinds]
        share = [max(0.01, w / total) for w in weight]
        share = [s / sum(share) for s in share]
        theta = [[[0.0] * 3 for _ in kinds] for _ in range(m)]
        for j in range(m):
            for k in kinds:
                counts = [0.01 * weight[k] + 1e-9] * 3
                for p, w in patterns.items():
                    counts[votes[p][j]] += w * post[p][k]
                theta[j][k] = [c / sum(counts) for c in counts]
    return post, theta, share


def measured(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, words, mean_word_length, symbol_ratio, punctuated, common, codes, sizes) per document; null for null texts.

    codes and sizes list the vote patterns of a text's lines and the characters under each. Texts are read whole.
    """

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [None if not x.is_valid else statistics(x.as_py()) for x in b.column(1)]
            pick = lambda i, kind: pa.array([None if r is None else r[i] for r in rows], kind)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pick(0, pa.int64()),
                    *[pick(i, pa.float64()) for i in (1, 2, 3, 4)],
                    pa.array([None if r is None else list(r[5]) for r in rows], pa.list_(pa.int32())),
                    pa.array([None if r is None else list(r[5].values()) for r in rows], pa.list_(pa.int64())),
                ],
                names=[doc, "words", "mean_word_length", "symbol_ratio", "punctuated", "common", "codes", "sizes"],
            )

    kind = dict(documents.dtypes)[doc]
    return documents.select(doc, text).mapInArrow(
        op, f"`{doc}` {kind}, words long, mean_word_length double, symbol_ratio double, punctuated double, common double, codes array<int>, sizes array<long>"
    )


def quality(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, words, mean_word_length, symbol_ratio, punctuated, common, no_prose, kind) per document.

    no_prose is the share of a text's characters in lines whose posterior says no prose; kind is `no prose` where it is
    above one half, else `prose`, `empty` for blank and null for null texts. At most 3**10 vote patterns reach the driver.
    """
    rows = written(measured(documents, doc, text), "quality")
    each = rows.select(F.explode(F.arrays_zip("codes", "sizes")).alias("p")).groupBy("p.codes").agg(F.sum("p.sizes").alias("n"))
    post, _, _ = learn({r["codes"]: float(r["n"]) for r in each.collect()})
    bad = F.array(*[F.lit(p) for p, q in sorted(post.items()) if q[0] < 0.5]).cast("array<int>")
    hit = F.aggregate(F.arrays_zip("codes", "sizes"), F.lit(0).cast("long"), lambda a, x: a + F.when(F.array_contains(bad, x["codes"]), x["sizes"]).otherwise(F.lit(0).cast("long")))
    size = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(doc, "words", "mean_word_length", "symbol_ratio", "punctuated", "common", F.when(F.size("sizes") > 0, hit / size).alias("no_prose")).withColumn(
        "kind", F.when(F.col("words").isNull(), F.lit(None)).when(F.col("no_prose").isNull(), "empty").when(F.col("no_prose") > 0.5, "no prose").otherwise("prose")
    )
