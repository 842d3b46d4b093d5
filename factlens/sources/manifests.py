"""Small files beside the sources: workspace manifests, path aliases, include roots, language plugins."""

from __future__ import annotations

import json
import re
import tomllib
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def workspace_crates(root: str) -> dict[str, str]:
    """Crate name to source folder of the members of a workspace manifest; members given as patterns are left out."""
    top = Path(root) / "Cargo.toml"
    if not top.is_file():
        return {}
    raw = tomllib.loads(top.read_text())
    members = [m for m in raw.get("workspace", {}).get("members", []) if "*" not in m]
    out = {}
    for m in [*members, *(["."] if "package" in raw else [])]:
        own = Path(root) / m / "Cargo.toml"
        if own.is_file():
            name = tomllib.loads(own.read_text()).get("package", {}).get("name")
            if name:
                out[name.replace("-", "_")] = f"{m}/src".removeprefix("./")
    return out


def aliases(text: str) -> list[tuple[str, str]]:
    """(pattern, replacement) of an alias file: `compilerOptions.paths` (first target, under `baseUrl`) or a flat map; longest pattern first."""
    raw = json.loads(re.sub(r"^\s*//[^\n]*", "", text, flags=re.M))
    options = raw.get("compilerOptions", {})
    base = options.get("baseUrl", "").strip("./")
    paths = options.get("paths") or raw.get("paths") or {k: v for k, v in raw.items() if isinstance(v, (str, list))}
    out = []
    for k, v in paths.items():
        target = v[0] if isinstance(v, list) and v else v
        if isinstance(target, str):
            out.append((k, "/".join(x for x in (base, target.removeprefix("./")) if x)))
    return sorted(out, key=lambda kv: (-len(kv[0]), kv[0]))


def rewritten(target: Column, pairs: list[tuple[str, str]]) -> Column:
    """An import target with the first fitting alias replaced; `*` stands for the rest."""

    def one(acc: Column, pair: tuple[str, str]) -> Column:
        pattern, to = pair
        if pattern.endswith("*"):
            head = pattern[:-1]
            return F.when(target.startswith(head), F.concat(F.lit(to.removesuffix("*")), F.substring(target, len(head) + 1, 1 << 20))).otherwise(acc)
        return F.when(target == pattern, F.lit(to)).otherwise(acc)

    return reduce(one, reversed(pairs), target)


def include_roots(files: DataFrame) -> DataFrame:
    """(root) the top folders of C and C++ files."""
    return files.where(F.col("language").isin("c", "cpp") & F.col("path").contains("/")).select(F.element_at(F.split("path", "/"), 1).alias("root")).distinct()


def plugin(text: str) -> dict:
    """A language plugin from its TOML: name, extensions, function_prefixes, import_prefixes, call_suffixes."""
    raw = tomllib.loads(text)
    missing = [k for k in ("name", "extensions") if not raw.get(k)]
    if missing:
        raise ValueError(f"plugin without {', '.join(missing)}")
    return {"function_prefixes": [], "import_prefixes": [], "call_suffixes": ["("], **raw}


def plugin_functions(lines: DataFrame, p: dict) -> DataFrame:
    """(file_id, name, line) of lines that begin with a function prefix of the plugin."""
    prefix = "|".join(re.escape(x) for x in p["function_prefixes"])
    if not prefix:
        return lines.select("file_id", F.lit("").alias("name"), "line").limit(0)
    name = F.regexp_extract("text", rf"^\s*(?:{prefix})\s*([\w-]+)", 1)
    return lines.select("file_id", name.alias("name"), "line").where("name <> ''")


def plugin_imports(lines: DataFrame, p: dict) -> DataFrame:
    """(from_file, target, line): the first word after an import prefix, quotes and semicolons cut off."""
    prefix = "|".join(re.escape(x) for x in p["import_prefixes"])
    if not prefix:
        return lines.select(F.col("file_id").alias("from_file"), F.lit("").alias("target"), "line").limit(0)
    target = F.regexp_replace(F.regexp_extract("text", rf"^\s*(?:{prefix})\s*(\S+)", 1), r"""^["'`<]+|["'`>;]+$""", "")
    return lines.select(F.col("file_id").alias("from_file"), target.alias("target"), "line").where("target <> ''")
