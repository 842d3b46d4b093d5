"""Scalar functions of the metrics, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that end a straight line of code, and words kept by fingerprints.
BRANCH_WORDS = ["if", "elif", "else", "for", "while", "loop", "match", "case", "catch", "except", "switch", "guard", "when"]
KEYWORDS = ["if", "else", "elif", "for", "while", "loop", "match", "case", "catch", "except", "switch", "return", "break", "continue", "async", "await", "yield", "try", "throw"]
SHAPE_MARKS = ["{", "}", "(", ")", "?", ":"]
#: Languages whose `and` and `or` are operators.
WORD_OPERATORS = ["python", "ruby", "swift"]
PACKAGE_INDEX = r"(mod\.rs|__init__\.py|index\.(ts|tsx|js))$"
TEST_PATH = r"^tests?/|/tests?/|_tests?\."
BUG_FIX = r"(?i)^\s*(bugfix|hotfix|revert|fix)($|[:!(\s])"


def round3(x: Column) -> Column:
    """Three decimals, halves away from zero, computed on x * 1000."""
    return F.round(x * 1000, 0) / 1000


def ratio(part: Column, whole: Column) -> Column:
    """part / whole to three decimals, 0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(round3(part.cast("double") / F.nullif(whole, F.lit(0)).cast("double")))


def clean_path(path: Column) -> Column:
    """Slashes of one kind."""
    return F.regexp_replace(path, r"\\", "/")


def top_module(module: Column) -> Column:
    """The part of a module before the first dot or slash."""
    return F.element_at(F.split(module, r"[./]"), 1)


def rule_regex(pattern: str) -> str:
    """A configured path (`a/b` or `a/b/*`) as an expression: the path itself or anything below."""
    import re

    p = pattern.strip().strip("/").removesuffix("/*")
    return f"^{re.escape(p)}(/|$)"


def glob_regex(pattern: str) -> str:
    """A shell pattern as an expression over a whole path: ** crosses folders, * and ? do not."""
    import re

    out, i = "^", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return out + "$"


def matches_any(path: Column, patterns: list[str]) -> Column:
    """Whether a path is at or below one of the configured paths."""
    tests = [path.rlike(rule_regex(p)) for p in patterns if p.strip()]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def is_test_path(path: Column, roots: list[str] | None = None) -> Column:
    """Whether a path is a test by convention or lies under a configured root."""
    return path.rlike(TEST_PATH) | matches_any(path, roots or [])


def is_package_index(path: Column) -> Column:
    """Whether a file stands for its folder."""
    return path.rlike(PACKAGE_INDEX)


def is_bug_fix(subject: Column) -> Column:
    """Whether a commit subject announces a fix; null is none."""
    return F.coalesce(subject.rlike(BUG_FIX), F.lit(False))


def module_group(path: Column, language: Column, module: Column, roots: list[str] | None = None, layers: list[tuple[str, str]] | None = None) -> Column:
    """The group a file belongs to: by ecosystem layout, then configured roots, then layers (name, path), then its top module."""
    parts = F.split(path, "/")
    n = F.size(parts)
    out = F.when((n >= 3) & F.element_at(parts, 1).isin("crates", "packages", "apps"), F.concat_ws("/", F.slice(parts, 1, 2)))
    out = out.when((language == "go") & (n >= 2), F.array_join(F.slice(parts, 1, F.greatest(n - 1, F.lit(1))), "/"))
    out = out.when((language == "python") & (n >= 2) & (F.element_at(parts, 1) == "src"), F.element_at(parts, 2))
    at = F.array_position(F.transform(parts, lambda p: p.isin("java", "kotlin")), True)
    after = F.try_element_at(parts, (at + 1).cast("int"))
    out = out.when(language.isin("java", "kotlin") & F.array_contains(parts, "src") & (at > 0) & after.isNotNull(), after)
    for root in roots or []:
        r = root.strip("/")
        if r:
            rest = F.element_at(F.split(F.regexp_replace(F.substring(path, len(r) + 1, 1 << 20), "^/+", ""), "/"), 1)
            out = out.when(path.rlike(rule_regex(r)), F.when(rest == "", F.lit(r)).otherwise(F.concat(F.lit(r + "/"), rest)))
    for name, where in layers or []:
        out = out.when(path.rlike(rule_regex(where)), F.lit(name))
    return out.otherwise(top_module(module))


def module_name(path: Column, language: Column) -> Column:
    """The dotted module of a path: the extension dropped, an index file standing for its folder."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    head = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    index = ((language == "rust") & (stem == "mod")) | (language.isin("typescript", "python") & stem.isin("index", "__init__"))
    return F.array_join(F.when(F.size(parts) == 0, parts).when(index, head).otherwise(F.concat(head, F.array(stem))), ".")


def expected_tests(path: Column, framework: Column, roots: list[str] | None = None) -> Column:
    """Sorted distinct paths at which a test of a file is expected."""
    names = sorted({r.strip().strip("/") for r in roots or [] if r.strip().strip("/")}) or ["tests"]
    file = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(file, r"(?<=.)\.[^.]*$", "")
    ext = F.regexp_extract(file, r"(?<=.)\.([^.]*)$", 1)
    parent = F.regexp_replace(path, r"/?[^/]*$", "")
    here = lambda name: F.regexp_replace(F.concat(parent, F.lit("/"), name), "^/+", "")
    with_ext = lambda *parts: F.concat(*parts, F.lit("."), ext)
    named = F.array(
        *[with_ext(F.lit(f"{r}/"), stem, F.lit("_test")) for r in ["tests", *names]],
        *[with_ext(F.lit(f"{r}/test_"), stem) for r in ["tests", *names]],
        here(with_ext(stem, F.lit("_test"))),
        here(with_ext(stem, F.lit(".test"))),
    )
    mirrored = F.array(*[F.regexp_replace(path, "^src/", f"{r}/") for r in ["tests", *names]])
    rust = F.array(F.concat(F.lit("tests/"), stem, F.lit(".rs")), F.concat(F.lit("src/"), stem, F.lit("/tests.rs")))
    python = F.array(F.concat(F.lit("tests/test_"), stem, F.lit(".py")))
    script = F.array(here(with_ext(stem, F.lit(".spec"))), here(with_ext(stem, F.lit(".test"))))
    none = F.array().cast("array<string>")
    return F.array_sort(
        F.array_distinct(
            F.concat(
                F.when((stem != "") & (ext != ""), named).otherwise(none),
                F.when(path.startswith("src/"), mirrored).otherwise(none),
                F.when(framework == "rust", rust).when(framework == "python", python).when(framework.isin("typescript", "javascript"), script).otherwise(none),
            )
        )
    )


def test_framework(language: Column) -> Column:
    """The test framework usual for a language."""
    return F.when(language == "java", "junit").when(language == "csharp", "dotnet").otherwise(language)


def strip_code(body: Column) -> Column:
    """A body with strings and C-style comments blanked, line ends kept.

    One alternation finds whichever of comment or string starts first; an unclosed string or comment runs to the end.
    """
    pattern = r"""//[^\n]*+|/\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/)?|"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"?|'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+'?|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`?"""
    keep = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    gaps = F.split(body, pattern)
    return F.array_join(
        F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.regexp_replace(F.try_element_at(keep, (i + 1).cast("int")), r"[^\n]", " "), F.lit("")))), ""
    )


def code_tokens(body: Column) -> Column:
    """Lower-case words and the structural marks of a body, strings and comments aside."""
    return F.regexp_extract_all(F.lower(strip_code(body)), F.lit(r"[a-z0-9_]+|[{}()\[\]?:]"), F.lit(0))


def lexical_complexity(body: Column, language: Column) -> Column:
    """1 plus branch words, plus the operators && || ? counted on the raw body (and `and`, `or` where they are operators)."""
    words = F.size(F.filter(code_tokens(body), lambda t: t.isin(*BRANCH_WORDS)))
    marks = F.regexp_count(body, F.lit(r"&&|\|\||\?"))
    spelt = F.when(language.isin(*WORD_OPERATORS), F.regexp_count(body, F.lit(" and ")) + F.regexp_count(body, F.lit(" or "))).otherwise(0)
    return F.lit(1) + words + marks + spelt


def cognitive_complexity(body: Column, language: Column) -> Column:
    """Branching lines weighted by their nesting, plus logical operators, as a fold over the stripped lines."""
    start = F.struct(F.lit(0).alias("score"), F.lit(0).alias("depth"))

    def step(state: Column, line: Column) -> Column:
        t = F.trim(line)
        depth = F.greatest(state["depth"] - F.when(t.startswith("}"), 1).otherwise(0), F.lit(0))
        words = F.regexp_extract_all(F.lower(t), F.lit(r"[a-z0-9_]+"), F.lit(0))
        branch = F.exists(words, lambda w: w.isin(*BRANCH_WORDS))
        spelt = F.when(language.isin(*WORD_OPERATORS), F.regexp_count(t, F.lit(" and ")) + F.regexp_count(t, F.lit(" or "))).otherwise(0)
        score = state["score"] + F.when(branch, 1 + depth).otherwise(0) + F.regexp_count(t, F.lit(r"&&|\|\|")) + spelt
        opened = depth + F.when(t.endswith("{") | t.endswith(":"), 1).otherwise(0)
        return F.struct(score.alias("score"), F.greatest(opened - F.regexp_count(t, F.lit(r"\}")), F.lit(0)).alias("depth"))

    return F.aggregate(F.split(strip_code(body), "\n"), start, step, lambda s: s["score"])


def body_fingerprint(body: Column) -> Column:
    """Hash of a body's tokens with numbers and names made equal; null below 12 tokens."""
    tokens = code_tokens(body)
    plain = F.transform(tokens, lambda t: F.when(t.rlike("^[0-9]+$"), "0").when(t.isin(*KEYWORDS), t).otherwise("id"))
    return F.when(F.size(tokens) >= 12, F.substring(F.sha2(F.array_join(plain, " "), 256), 1, 16))


def shape_fingerprint(body: Column) -> Column:
    """Hash of a body's keywords and marks; null below 20 tokens or 4 kept ones."""
    tokens = code_tokens(body)
    kept = F.filter(tokens, lambda t: t.isin(*KEYWORDS, *SHAPE_MARKS))
    return F.when((F.size(tokens) >= 20) & (F.size(kept) >= 4), F.concat(F.lit("shape:"), F.substring(F.sha2(F.array_join(kept, " "), 256), 1, 16)))


def size_bucket(lines: Column) -> Column:
    """0 for 0, else the bit length."""
    return F.when(lines == 0, 0).otherwise(F.length(F.bin(lines)))


def grade(value: Column, a: float = 0.9, b: float = 0.8, c: float = 0.7, d: float = 0.5) -> Column:
    """Letter of a share."""
    return F.when(value >= a, "A").when(value >= b, "B").when(value >= c, "C").when(value >= d, "D").otherwise("F")


def severity(text: Column) -> Column:
    """info, warning or error; anything else is an error."""
    s = F.lower(F.trim(text))
    return F.when(s == "info", "info").when(s.isin("warning", "warn"), "warning").otherwise("error")


def shell_path(path: Column) -> Column:
    """A path quoted for a shell where it has blanks."""
    return F.when(path.contains(" "), F.concat(F.lit("'"), F.replace(path, F.lit("'"), F.lit("'\\''")), F.lit("'"))).otherwise(path)


def parent_path(path: Column) -> Column:
    """The quoted folder of a path, empty at the root."""
    return shell_path(F.regexp_replace(path, r"/?[^/]*$", ""))


def visibility(line: Column) -> Column:
    """The visibility a declaration line begins with; the longest prefix counts."""
    t = F.ltrim(line)
    order = [("pub(", "crate"), ("protected internal ", "protected"), ("private protected ", "private"), ("pub ", "public"), ("public ", "public"), ("export ", "public"), ("private ", "private"), ("protected ", "protected"), ("internal ", "package"), ("open ", "public"), ("fileprivate ", "private")]
    return reduce(lambda acc, kv: acc.when(t.startswith(kv[0]), kv[1]), sorted(order, key=lambda kv: -len(kv[0]))[1:], F.when(t.startswith(sorted(order, key=lambda kv: -len(kv[0]))[0][0]), sorted(order, key=lambda kv: -len(kv[0]))[0][1])).otherwise("unknown")
