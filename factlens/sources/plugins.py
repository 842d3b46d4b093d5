"""Language plugins: the standard catalogue, and adding, removing, checking, starting and copying them.

A plugin is a dict as `manifests.plugin` reads it. Folders are small and belong to the tool that edits them, so they are
read and written where this code runs.
"""

from __future__ import annotations

import re
from dataclasses import replace
from pathlib import Path

from factlens.sources import manifests
from factlens.sources.config import Config

#: Name | extensions | function prefixes | import prefixes (prefixes in quotes, blanks count).
CATALOGUE = """
go | go | "func " | "import "
java | java | "public " "private " "protected " "static " | "import "
kotlin | kt kts | "fun " | "import "
scala | scala | "def " | "import "
csharp | cs | "public " "private " "protected " "static " | "using "
php | php | "function " | "use " "require " "include "
ruby | rb | "def " | "require " "load "
swift | swift | "func " | "import "
objective-c | m mm | "- " "+ " | "#import " "#include "
zig | zig | "fn " | "@import("
nim | nim | "proc " "func " "method " | "import " "include "
lua | lua | "function " | "require "
r | r R | "" | "library(" "require("
julia | jl | "function " | "using " "import "
dart | dart | "void " "Future<" "String " "int " | "import "
elixir | ex exs | "def " "defp " | "alias " "import " "require "
erlang | erl hrl | "" | "-include" "-import"
haskell | hs lhs | "" | "import "
ocaml | ml mli | "let " | "open "
fsharp | fs fsi fsx | "let " | "open "
clojure | clj cljs cljc | "(defn " | "(:require " "(require "
lisp | lisp lsp el | "(defun " | "(require "
scheme | scm ss | "(define " | "(import "
perl | pl pm | "sub " | "use " "require "
powershell | ps1 psm1 | "function " | "Import-Module "
shell | sh bash zsh fish | "function " | "source " ". "
sql | sql | "create function " "create procedure " | "include "
html | html htm | "function " | "<script"
css | css scss sass less | "" | "@import "
vue | vue | "function " "const " | "import "
svelte | svelte | "function " "const " | "import "
jsonnet | jsonnet libsonnet | "local " | "import "
terraform | tf tfvars | "resource " "module " | "module "
hcl | hcl | "resource " "module " "variable " | "module "
gdscript | gd | "func " | "extends " "class_name "
glsl | glsl vert frag geom tesc tese comp | "void " | "#include "
yaml | yaml yml | "" |
toml | toml | |
json | json | "" |
xml | xml | "" |
markdown | md mdx | |
dockerfile | dockerfile | "FROM " | "COPY " "ADD "
make | mk make | "" | "include "
cmake | cmake | "function(" "macro(" | "include(" "add_subdirectory("
gradle | gradle | "task " | "apply "
groovy | groovy | "def " | "import "
cobol | cob cbl cpy | "       " | "COPY "
vb | vb | "Sub " "Function " | "Imports "
pascal | pas pp inc | "function " "procedure " | "uses "
fortran | f f90 f95 for | "function " "subroutine " | "use "
matlab | m | "function " | "import "
solidity | sol | "function " | "import "
vyper | vy | "def " | "import "
proto | proto | "service " "rpc " | "import "
thrift | thrift | "service " | "include "
"""


def standard() -> list[dict]:
    """The plugins of the catalogue."""
    out = []
    for line in CATALOGUE.strip().splitlines():
        name, extensions, functions, imports = [x.strip() for x in line.split("|")]
        out.append({"name": name, "extensions": extensions.split(), "function_prefixes": re.findall(r'"([^"]*)"', functions), "import_prefixes": re.findall(r'"([^"]*)"', imports), "call_suffixes": ["("]})
    return out


def added(config: Config, name: str, extensions: list[str] | None = None, file_names: list[str] | None = None) -> Config:
    """The configuration with a plugin, in place of one of the same name."""
    if not extensions and not file_names:
        raise ValueError("a plugin needs extensions or file names")
    return replace(config, plugins=[*(p for p in config.plugins if p["name"] != name), {"name": name, "extensions": list(extensions or []), "file_names": list(file_names or [])}])


def with_standard(config: Config) -> Config:
    """The configuration with the whole catalogue, plugins sorted by name in any case."""
    own = standard()
    names = {p["name"] for p in own}
    return replace(config, plugins=sorted([*(p for p in config.plugins if p["name"] not in names), *own], key=lambda p: p["name"].lower()))


def removed(config: Config, name: str) -> tuple[Config, int]:
    """The configuration without the plugins of a name in any case, and how many went."""
    left = [p for p in config.plugins if p["name"].lower() != name.lower()]
    return replace(config, plugins=left), len(config.plugins) - len(left)


def as_toml(p: dict) -> str:
    """The manifest of a plugin."""
    show = lambda v: "[" + ", ".join(show(x) for x in v) + "]" if isinstance(v, list) else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else '"' + str(v).replace("\\", "\\\\").replace('"', '\\"') + '"'
    return "".join(f"{k} = {show(v)}\n" for k, v in p.items())


def validate(folder: str) -> dict:
    """Whether a folder holds a plugin: errors make it invalid, warnings do not."""
    errors, warnings, p = [], [], {}
    try:
        text = (Path(folder) / "plugin.toml").read_text()
        p = manifests.plugin(text)
    except (OSError, ValueError) as e:
        errors.append(str(e))
    if p and not p["function_prefixes"] and not p.get("tags_query"):
        warnings.append("no function prefixes and no tags query")
    query = Path(folder) / "queries" / "tags.scm"
    if p and query.is_file() and not re.search(r"@(?:definition\.\w+|name|import\w*)", query.read_text()):
        warnings.append("the tags query captures no definition, name or import")
    return {"valid": not errors, "errors": errors, "warnings": warnings}


def scaffold(root: str, name: str, extension: str) -> str:
    """A new plugin folder with a manifest to fill in; it must not be there yet."""
    if not name.strip() or not extension.strip(". "):
        raise ValueError("a plugin needs a name and an extension")
    folder = Path(root) / name
    if folder.exists():
        raise ValueError(f"{folder} is there already")
    (folder / "queries").mkdir(parents=True)
    starting = {"name": name, "extensions": [extension.strip().lstrip(".")], "function_prefixes": ["function ", "def ", "fn "], "import_prefixes": ["import ", "use ", "require "], "call_suffixes": ["("], "test_path_patterns": ["tests/*", "test/*"], "max_function_complexity": 15, "max_cognitive_complexity": 20}
    (folder / "plugin.toml").write_text(as_toml(starting))
    (folder / "queries" / "tags.scm").write_text("; captures: @definition.function, @name, @import\n")
    return str(folder)


def sync(root: str, names: list[str] | None = None, force: bool = False) -> tuple[list[str], list[str]]:
    """(written, skipped) manifests of the catalogue's plugins (or of the named ones) as folders; one that is there is written again only with `force`."""
    written, skipped = [], []
    for p in standard():
        if names and p["name"] not in names:
            continue
        path = Path(root) / p["name"] / "plugin.toml"
        if path.exists() and not force:
            skipped.append(str(path))
            continue
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(as_toml(p))
        written.append(str(path))
    return written, skipped


def load_folder(root: str) -> list[dict]:
    """The plugins of a folder, by name, each with the tags query beside its manifest; a missing folder has none."""
    out = []
    for path in sorted(Path(root).glob("*/plugin.toml")):
        p = manifests.plugin(path.read_text())
        query = path.parent / "queries" / "tags.scm"
        out.append({**p, "tags_query": p.get("tags_query") or query.read_text()} if query.is_file() else p)
    return out
