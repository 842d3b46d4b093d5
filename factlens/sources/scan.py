"""Source trees to facts: files are read by Spark, facts are taken from the texts by expressions and line patterns.

Functions, imports and types are found by line patterns per language (fixed values below); nothing is parsed to a tree. The
end of a function is that of its block: the brace that closes its first one, or the last line that is indented deeper.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlens.functions import scalars as S
from factlens.session import written

#: Languages by extension, folders never scanned, and line patterns per language.
LANGUAGES = {"c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp", "cs": "csharp", "java": "java", "kt": "kotlin", "kts": "kotlin", "py": "python", "rfl": "rayfall", "rb": "ruby", "rs": "rust", "scala": "scala", "sc": "scala", "swift": "swift", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript"}
SKIPPED = r"(^|/)(\.git|\.hg|\.svn|target|node_modules|dist|build|\.venv|venv|__pycache__|\.cache|\.idea|\.vscode|\.next|coverage|out|vendor|\.tox|\.mypy_cache|\.pytest_cache)/"
FUNCTIONS = {
    "python": r"^\s*(?:async\s+)?def\s+(\w+)",
    "ruby": r"^\s*def\s+(?:self\.)?(\w+)",
    "scala": r"^\s*(?:[a-z]+\s+)*def\s+(\w+)",
    "kotlin": r"^\s*(?:[a-z]+\s+)*fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)",
    "swift": r"^\s*(?:[a-z]+\s+)*func\s+(\w+)",
    "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|unsafe|const)\s+)*fn\s+(\w+)",
    "typescript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)",
    "rayfall": r"^\s*\(set\s+(\S+)\s+\(fn\b",
}
C_LIKE = r"^(?!\s*(?:return|else|if|for|while|switch|throw|new|case)\b)\s*(?:[\w:<>,\[\]&*]+\s+)+[&*]*(\w+)\s*\([^;]*\)\s*(?:const\s*)?(?:throws\s+[\w., ]+)?\{"
IMPORTS = {
    "python": r"^\s*(?:from\s+(\S+)\s+import|import\s+([\w.]+))",
    "rust": r"^\s*(?:pub\s+)?(?:use\s+([^;]+);|mod\s+(\w+)\s*;)",
    "typescript": r"""(?:from\s+|require\(\s*|^\s*import\s+)['"]([^'"]+)['"]()""",
    "c": r"""^\s*#\s*include\s+[<"]([^>"]+)[>"]()""",
    "cpp": r"""^\s*#\s*include\s+[<"]([^>"]+)[>"]()""",
    "java": r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;()",
    "kotlin": r"^\s*import\s+([\w.*]+)()",
    "scala": r"^\s*import\s+([\w.{}, _]+)()",
    "swift": r"^\s*import\s+(\w+)()",
    "csharp": r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;()",
    "ruby": r"""^\s*require(?:_relative)?\s+['"]([^'"]+)['"]()""",
}
TYPES = r"^\s*(?:(?:pub(?:\([^)]*\))?|public|private|protected|internal|static|final|sealed|abstract|export|default|open|data|case|partial)\s+)*(class|struct|enum|trait|interface|protocol|union|record|object|module)\s+([A-Za-z_]\w*)"
ABSTRACT = r"^\s*(?:[a-z]+\s+)*(?:abstract\s+|trait\s|interface\s|protocol\s)"
#: How a comment line begins; a block comment goes on to the line that closes it.
COMMENT = r"^\s*(?://|#|--|;|\*)"
#: Languages whose functions end where the indentation does.
INDENTED = ("python", "ruby", "scala", "kotlin", "swift")
#: What marks a function as a test, on the lines above it, and what marks all in a block as tests.
TEST_MARK = re.compile(r"^\s*(?:#\[(?:\w+::)*test\b|@(?:\w+\.)*Test\b|\[(?:Test|Fact|Theory|TestMethod)\b)")
TEST_BLOCK = re.compile(r"^\s*#\[cfg\(.*\btest\b.*\)\]")
#: Files per part of a snapshot's hash.
PART = 4096


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """`df` with numbers from 0 in an order, by a range sort: places within the parts, plus one offset per part."""
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn("_part", part)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + place).cast("long")).drop("_at", "_part", "_before")


def read_tree(spark: SparkSession, root: str, ignored: list[str] | None = None) -> DataFrame:
    """(path, content) of the text files below a folder, known languages only, the usual build folders and the ignored paths left out."""
    raw = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).select(F.input_file_name().alias("_uri"), F.col("value").alias("content"))
    base = root.rstrip("/")
    path = F.regexp_replace(F.regexp_replace(F.col("_uri"), r"^[a-z]+:/+", "/"), "^" + base.replace("\\", "/").replace(".", r"\."), "")
    df = raw.select(F.url_decode(F.regexp_replace(path, "^/+", "")).alias("path"), "content")
    df = df.where(~F.concat(F.lit("/"), "path").rlike(SKIPPED))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return df.where(ext.isin(*LANGUAGES) & ~S.matches_any(F.col("path"), ignored or []))


def files(texts: DataFrame) -> DataFrame:
    """(file_id, path, language, module, lines, bytes, content_hash, comment_lines); ids follow the paths' order."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    language = F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[ext], F.lit("unknown"))
    lines = F.split(F.regexp_replace("content", r"\n$", ""), "\n")
    out = texts.select("path", "content", language.alias("language")).withColumn("module", S.module_name(F.col("path"), F.col("language")))
    out = out.withColumn("lines", F.when(F.col("content") == "", 0).otherwise(F.size(lines)).cast("long")).withColumn("bytes", F.octet_length("content").cast("long")).withColumn("content_hash", F.sha2("content", 256))
    return numbered(out.withColumn("comment_lines", comment_lines(lines)), ["path"], "file_id")


def comment_lines(lines: Column) -> Column:
    """How many of the lines are comments, those inside a block comment among them."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(False).alias("inside"))

    def step(state: Column, line: Column) -> Column:
        t = F.ltrim(line)
        closes, opens = t.contains("*/"), ~state["inside"] & t.startswith("/*")
        hit = state["inside"] | opens | t.rlike(COMMENT)
        return F.struct((state["n"] + hit.cast("long")).alias("n"), ((state["inside"] | opens) & ~closes).alias("inside"))

    return F.aggregate(lines, start, step, lambda x: x["n"])


def snapshot_id(found: DataFrame) -> str:
    """SHA-256 over the hashes of parts of PART files, each over path and content hash in path order; no part is larger, whatever the tree."""
    part = found.groupBy(F.floor(F.col("file_id") / PART).alias("part")).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "content_hash"))), lambda x: F.concat(x["path"], x["content_hash"])), ""), 256).alias("h"))
    rows = [r["h"] for r in part.orderBy("part").select("h").toLocalIterator()]
    return hashlib.sha256("".join(rows).encode()).hexdigest()


def lines_of(found: DataFrame) -> DataFrame:
    """(file_id, language, line, text) of every line."""
    return found.select("file_id", "language", F.posexplode(F.split("content", "\r?\n")).alias("at", "text")).select("file_id", "language", (F.col("at") + 1).cast("long").alias("line"), "text")


def _pattern(column, table: dict[str, str], fallback: str | None = None):
    out = F.when(F.lit(False), F.lit(""))
    for language, pattern in table.items():
        out = out.when(F.col("language") == language, column(pattern))
    return out.otherwise(column(fallback)) if fallback else out


def brace_end(lines: list[str], at: int) -> int:
    """The line that closes the first brace opened from a line on; the line itself if none opens or closes."""
    depth, began = 0, False
    for i in range(at, len(lines)):
        for mark in _BRACE.findall(lines[i]):
            if mark == "{":
                depth, began = depth + 1, True
            elif began:
                depth -= 1
                if not depth:
                    return i
    return at


def indent_end(lines: list[str], at: int) -> int:
    """The last line of the block that is indented deeper than a line, blank lines with it."""
    width = lambda x: len(x) - len(x.lstrip())
    end = at
    for i in range(at + 1, len(lines)):
        if lines[i].strip() and width(lines[i]) <= width(lines[at]):
            break
        end = i
    return end


_BRACE = re.compile(r"[{}]")


def functions(found: DataFrame) -> DataFrame:
    """(file_id, name, start_line, end_line, visibility, body, is_test) of each declaration with its block, by line patterns.

    A function is a test if a test attribute stands above it (blank, comment and other attribute lines between do not
    matter) or if it lies in a block under a condition on tests.
    """
    heads = lines_of(found).withColumn("name", _pattern(lambda p: F.regexp_extract("text", p, 1), FUNCTIONS, C_LIKE)).where("name <> ''")
    per_file = heads.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("line", "name", S.visibility(F.col("text")).alias("visibility")))).alias("heads"))
    rows = per_file.join(found.select("file_id", "language", "content"), "file_id")

    def op(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for file_id, heads, language, content in zip(b["file_id"], b["heads"], b["language"], b["content"], strict=True):
                lines = content.replace("\r\n", "\n").split("\n")
                end_of = indent_end if language in INDENTED else brace_end
                tested = [(i, brace_end(lines, i)) for i, x in enumerate(lines) if TEST_BLOCK.match(x)]
                for h in heads:
                    at = h["line"] - 1
                    end = end_of(lines, at)
                    up = at - 1
                    mark = False
                    while up >= 0 and not mark and (not lines[up].strip() or lines[up].lstrip()[:1] in "#@/*["):
                        mark = TEST_MARK.match(lines[up]) is not None
                        up -= 1
                    mark = mark or any(a <= at <= z for a, z in tested)
                    out.append((file_id, h["name"], at + 1, end + 1, h["visibility"], "\n".join(lines[at : end + 1]), mark))
            yield pd.DataFrame(out, columns=["file_id", "name", "start_line", "end_line", "visibility", "body", "is_test"])

    return rows.select("file_id", "heads", "language", "content").mapInPandas(op, "file_id long, name string, start_line long, end_line long, visibility string, body string, is_test boolean")


#: Import statements that may hold several targets in braces and go over several lines.
BRACED = {"rust": r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?use[ \t]+([^;]+);", "scala": r"(?m)^[ \t]*import[ \t]+([\w.]+\{[^}]*\})"}


def imports(found: DataFrame) -> DataFrame:
    """(from_file, target, kind, line, alias) of imports: targets in braces are one row each, `a as b` (`a => b` in Scala) gives the alias."""

    def pick(p: str) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract("text", p, 1), F.lit("")), F.nullif(F.regexp_extract("text", p, 2), F.lit("")))

    rows = lines_of(found).withColumn("target", _pattern(pick, IMPORTS)).where("target is not null and target <> ''")
    rows = rows.where(~((F.col("language") == "rust") & F.col("text").rlike(r"\buse\s")) & ~((F.col("language") == "scala") & F.col("target").contains("{")))
    single = rows.select("file_id", F.trim("target").alias("target"), "line")
    braced = []
    for language, pattern in BRACED.items():
        whole = found.where(F.col("language") == language).select("file_id", "content", F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).alias("stmt"))
        line = F.size(F.split(F.left("content", F.instr("content", F.col("stmt")) - 1), "\n")).cast("long")
        target = F.regexp_replace(F.regexp_extract("stmt", pattern, 1), r"\s+", " ")
        head, tail = F.regexp_extract("target", r"^([^{]*)\{", 1), F.regexp_extract("target", r"^[^}]*\}(.*)$", 1)
        items = F.filter(F.transform(F.split(F.regexp_extract("target", r"\{([^}]*)", 1), ","), lambda x: F.trim(x)), lambda x: x != "")
        each = F.when(F.col("target").contains("{") & (F.size(items) > 0), F.transform(items, lambda x: F.concat(head, F.regexp_replace(x, r"( as |\s*=>\s*).*$", ""), tail, F.regexp_extract(x, r"((?: as |\s*=>\s*).*)$", 1)))).otherwise(F.array("target"))
        braced.append(whole.withColumn("target", target).withColumn("line", line).select("file_id", F.explode(each).alias("target"), "line"))
    every = single.unionByName(braced[0]).unionByName(braced[1])
    split = r"^(.*?)(?: as |\s*=>\s*)(\w+)\s*;?$"
    alias = F.nullif(F.regexp_extract("target", split, 2), F.lit(""))
    plain = F.when(alias.isNotNull(), F.regexp_extract("target", split, 1)).otherwise(F.col("target"))
    return every.select(F.col("file_id").alias("from_file"), F.trim(plain).alias("target"), F.lit("import").alias("kind"), "line", alias.alias("alias")).where("target <> ''")


def types(found: DataFrame) -> DataFrame:
    """(file_id, name, is_abstract, line, visibility) of type declarations."""
    rows = lines_of(found).withColumn("name", F.regexp_extract("text", TYPES, 2)).where("name <> ''")
    return rows.select("file_id", "name", F.col("text").rlike(ABSTRACT).alias("is_abstract"), "line", S.visibility(F.col("text")).alias("visibility"))


def resolve_imports(found: DataFrame, imported: DataFrame) -> DataFrame:
    """Imports with resolved_file and resolution: first path candidate, in order, that is a file; else the module of that name.

    Candidates come from the target read as a path beside the importing file and from the root, with each extension of the language.
    """
    importing = found.select(F.col("file_id").alias("from_file"), F.col("path").alias("fp"), "language")
    here = F.regexp_replace("fp", r"/?[^/]*$", "")
    plain = F.regexp_replace(F.regexp_replace("target", r"^(\./|crate::|self::|super::)+", ""), r"::|\.(?!\w{1,4}$)", "/")
    ends = F.array(F.lit(""), *[F.lit("." + e) for e in sorted(LANGUAGES)], F.lit("/mod.rs"), F.lit("/__init__.py"), F.lit("/index.ts"), F.lit("/index.js"))
    bases = F.array(F.regexp_replace(F.concat(here, F.lit("/"), plain), "^/", ""), plain, F.concat(F.lit("src/"), plain), F.concat(F.lit("include/"), plain))
    tried = imported.join(importing, "from_file").withColumn("_i", F.xxhash64("from_file", "target", "line")).withColumn("_c", F.flatten(F.transform(bases, lambda b: F.transform(ends, lambda e: F.concat(b, e)))))
    by_path = tried.select("_i", F.posexplode("_c").alias("pos", "path")).join(found.select("path", F.col("file_id").alias("hit")), "path").groupBy("_i").agg(F.min_by("hit", "pos").alias("by_path"))
    modules = found.where("module <> ''").groupBy("module").agg(F.min("file_id").alias("by_module"))
    dotted = F.regexp_replace(F.regexp_replace("target", r"^(crate::|self::|super::)+", ""), r"::|/", ".")
    out = tried.join(by_path, "_i", "left").withColumn("module", dotted).join(modules, "module", "left")
    hit = F.coalesce("by_path", "by_module")
    system = F.col("language").isin("c", "cpp") & ~F.col("target").contains("/")
    return out.select("from_file", "target", "kind", "line", "alias", hit.alias("resolved_file"), F.when(hit.isNotNull(), "local").when(F.col("target").startswith("."), "unresolved").when(system, "system").otherwise("external").alias("resolution"))


def calls(found: DataFrame, declared: DataFrame) -> DataFrame:
    """(file_id, target, line, at, function_start): names before a round bracket that are no keyword and no declaration, each place of a line apart; the caller is the innermost function around the line."""
    rows = lines_of(found).select("file_id", "line", F.posexplode(F.regexp_extract_all("text", F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1))).alias("at", "target"))
    rows = rows.where(~F.col("target").isin(*S.KEYWORDS, *S.BRANCH_WORDS, "def", "fn", "func", "fun", "function", "new", "sizeof"))
    here = declared.select("file_id", F.col("name").alias("target"), F.col("start_line").alias("line"))
    rows = rows.join(here, ["file_id", "target", "line"], "left_anti")
    around = declared.select("file_id", "start_line", "end_line")
    inside = F.col("line").between(F.col("start_line"), F.col("end_line"))
    return rows.join(around, "file_id", "left").groupBy("file_id", "target", "line", "at").agg(F.max(F.when(inside, F.col("start_line"))).alias("function_start"))


#: How a type names its bases, and how an implementation names trait and type.
BASES = r"\b(?:class|struct|enum|trait|interface|protocol|record|object)\s+\w+(?:<[^>]*>)?\s*(?:\([^)]*\)\s*)?(?::|<|\bextends\b|\bimplements\b)\s*([^{]+)"
PYTHON_BASES = r"^\s*class\s+\w+\s*\(([^)]*)\)"
IMPL = r"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+([\w:]+)(?:<[^>]*>)?\s+for\s+([\w:]+)"


def bases(found: DataFrame) -> DataFrame:
    """(file_id, line, base) per base a type declaration names; generic arguments and keyword arguments are cut off."""
    raw = F.when(F.col("language") == "python", F.regexp_extract("text", PYTHON_BASES, 1)).otherwise(F.regexp_extract("text", BASES, 1))
    rows = lines_of(found).withColumn("raw", F.regexp_replace(F.regexp_replace(raw, r"<[^<>]*>", ""), r"\([^()]*\)|\bwhere\b.*", "")).where("raw <> ''")
    each = rows.select("file_id", "line", F.explode(F.split(F.regexp_replace("raw", r"\b(?:extends|implements|with|public|private|protected|virtual)\b", ","), r"[,:+&]")).alias("base"))
    return each.select("file_id", "line", F.trim("base").alias("base")).where(r"base rlike '^[A-Za-z_][\\w.]*$'")


def trait_impls(found: DataFrame) -> DataFrame:
    """(file_id, trait_name, type_name, line) of implementations of a trait for a type."""
    rows = lines_of(found).where("language = 'rust'").select("file_id", F.regexp_extract("text", IMPL, 1).alias("trait_name"), F.regexp_extract("text", IMPL, 2).alias("type_name"), "line")
    return rows.where("trait_name <> '' and type_name <> ''")


def entry_points(found: DataFrame, declared: DataFrame) -> DataFrame:
    """(file_id, kind, symbol): `main` functions (binary), files under examples (example), tests by path, name or attribute (test)."""
    path = F.col("path")
    f = found.select("file_id", "path")
    d = declared.select("file_id", "name", "is_test").join(f, "file_id")
    binary = d.where("name = 'main'").select("file_id", F.lit("binary").alias("kind"), F.col("name").alias("symbol"))
    example = f.where(path.rlike(r"(^|/)examples/")).select("file_id", F.lit("example").alias("kind"), path.alias("symbol"))
    test = d.where(S.is_test_path(path) | F.col("name").rlike("^test_|_test$") | F.col("is_test")).select("file_id", F.lit("test").alias("kind"), F.col("name").alias("symbol"))
    return binary.unionByName(example).unionByName(test).distinct()


def facts(texts: DataFrame) -> dict[str, DataFrame]:
    """All fact relations of a tree (path, content), with dense ids in the order of path and place; by relation name."""
    from factlens.operators.structure import resolved_calls

    found = files(texts)
    declared = functions(found)
    f = numbered(declared, ["file_id", "start_line", "name"], "function_id")
    i = numbered(resolve_imports(found, imports(found)), ["from_file", "line", "target"], "import_id")
    starts = f.groupBy("file_id", F.col("start_line").alias("function_start")).agg(F.min("function_id").alias("caller_function"))
    c = numbered(calls(found, declared).join(starts, ["file_id", "function_start"], "left"), ["file_id", "line", "at", "target"], "call_id")
    edges = numbered(resolved_calls(c.select("call_id", "file_id", "caller_function", "target"), f, found), ["call_id"], "edge_id")
    named = bases(found).groupBy("file_id", "line").agg(F.sort_array(F.collect_list("base")).alias("bases"))
    t = numbered(types(found).join(named, ["file_id", "line"], "left"), ["file_id", "line", "name"], "type_id")
    none = F.array().cast("array<string>")
    return {
        "files": found.select("file_id", "path", "language", "module", "lines", "bytes", "content_hash", "comment_lines"),
        "functions": f.select("function_id", "file_id", "name", "start_line", "end_line", "visibility", "body"),
        "entry_points": numbered(entry_points(found, declared), ["file_id", "kind", "symbol"], "entry_id").select("entry_id", "file_id", "kind", "symbol"),
        "imports": i.select("import_id", "from_file", "target", "kind", "resolution", "resolved_file", "alias"),
        "calls": c.select("call_id", "file_id", "caller_function", "target", "line"),
        "call_edges": edges.select("edge_id", "call_id", "caller_function", "callee_function"),
        "types": t.select("type_id", "file_id", "name", "is_abstract", "line", "visibility", F.coalesce("bases", none).alias("bases")),
        "trait_impls": numbered(trait_impls(found), ["file_id", "line", "type_name"], "impl_id").select("impl_id", "file_id", "type_name", "trait_name", "line"),
    }
