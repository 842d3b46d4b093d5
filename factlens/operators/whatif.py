"""What a change would do: edits of the fact relations, without touching their source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlens.functions import scalars as S
from factlens.operators import graph, structure
from factlens.operators.facts import Facts
from factlens.session import checkpointed


class WhatIfError(ValueError):
    """A change that cannot be made."""


def _need(found: DataFrame, message: str, there: bool = True) -> None:
    if found.isEmpty() == there:
        raise WhatIfError(message)


def remove_file(facts: Facts, file_id: int) -> Facts:
    """Without a file and all facts of or to it; the other ids stay."""
    _need(facts.files.where(F.col("file_id") == file_id), f"no file {file_id}")
    gone = facts.functions.where(F.col("file_id") == file_id).select("function_id")
    keep = lambda d: d.where(F.col("file_id") != file_id)
    edges = facts.call_edges.join(gone.withColumnRenamed("function_id", "caller_function"), "caller_function", "left_anti").join(gone.withColumnRenamed("function_id", "callee_function"), "callee_function", "left_anti")
    imports = facts.imports.where((F.col("from_file") != file_id) & (F.coalesce("resolved_file", F.lit(-1)) != file_id))
    return facts.replaced(files=keep(facts.files), functions=keep(facts.functions), entry_points=keep(facts.entry_points), calls=keep(facts.calls), types=keep(facts.types), trait_impls=keep(facts.trait_impls), imports=imports, call_edges=edges.select(facts.call_edges.columns))


def move_file(facts: Facts, file_id: int, path: str) -> Facts:
    """With a file at another path; its module follows the path."""
    _need(facts.files.where(F.col("file_id") == file_id), f"no file {file_id}")
    _need(facts.files.where(F.col("path") == path), f"{path} is taken", False)
    hit = F.col("file_id") == file_id
    moved = facts.files.withColumn("path", F.when(hit, F.lit(path)).otherwise(F.col("path")))
    return facts.replaced(files=moved.withColumn("module", F.when(hit, S.module_name(F.col("path"), F.col("language"))).otherwise(F.col("module"))))


def _edge(src: int, dst: int):
    return (F.col("from_file") == src) & (F.col("resolved_file") == dst) & (F.col("resolution") == "local")


def remove_edge(facts: Facts, src: int, dst: int) -> Facts:
    """Without the local imports from one file to another."""
    _need(facts.imports.where(_edge(src, dst)), f"no edge {src} -> {dst}")
    return facts.replaced(imports=facts.imports.where(~F.coalesce(_edge(src, dst), F.lit(False))))


def add_edge(facts: Facts, src: int, dst: int) -> Facts:
    """With a local import from one file to another."""
    _need(facts.imports.where(_edge(src, dst)), f"edge {src} -> {dst} is there", False)
    _need(facts.files.where(F.col("file_id").isin(src, dst)).select("file_id").distinct().where("true").groupBy().count().where("count = 2"), "both files must be there")
    spark = facts.imports.sparkSession
    new = facts.imports.agg((F.coalesce(F.max("import_id"), F.lit(-1)) + 1).alias("import_id")).select("import_id", F.lit(src).cast("long").alias("from_file"), F.lit("").alias("target"), F.lit("what_if").alias("kind"), F.lit("local").alias("resolution"), F.lit(dst).cast("long").alias("resolved_file"), F.lit(None).cast("string").alias("alias"))
    del spark
    return facts.replaced(imports=facts.imports.unionByName(new))


def break_cycle(facts: Facts, src: int, dst: int) -> Facts:
    """Without an edge, which must take files off cycles."""
    after = remove_edge(facts, src, dst)
    if graph.cycle_members(structure.file_edges(after)).count() >= graph.cycle_members(structure.file_edges(facts)).count():
        raise WhatIfError(f"edge {src} -> {dst} breaks no cycle")
    return after


def sequence(facts: Facts, steps: list[tuple]) -> Facts:
    """Several changes in turn: (name, arguments...); an error names the failing step."""
    actions = {"remove_file": remove_file, "move_file": move_file, "remove_edge": remove_edge, "add_edge": add_edge, "break_cycle": break_cycle}
    for i, (name, *args) in enumerate(steps):
        try:
            facts = actions[name](facts, *args)
        except (KeyError, WhatIfError) as e:
            raise WhatIfError(f"step {i}: {e}") from e
    return facts


def ignore(facts: Facts, patterns: list[str]) -> Facts:
    """Without the files at or below the given paths."""
    gone = facts.files.where(S.matches_any(S.clean_path(F.col("path")), patterns)).select("file_id")
    keep = lambda d, c="file_id": d.join(gone.withColumnRenamed("file_id", c), c, "left_anti").select(d.columns)
    imports = keep(keep(facts.imports, "from_file"), "resolved_file")
    return facts.replaced(files=keep(facts.files), functions=keep(facts.functions), entry_points=keep(facts.entry_points), calls=keep(facts.calls), types=keep(facts.types), trait_impls=keep(facts.trait_impls), imports=imports)


def cycle_breaks(facts: Facts, candidates: int = 500, limit: int = 20) -> DataFrame:
    """(src, dst, reduction) of local edges whose removal takes most files off cycles, greatest first.

    Only edges inside a strong component can; the first `candidates` of them, by (src, dst), are tried, as the result of a
    what-if is a short list by its feature. The edges inside components are broadcast once (CORE_EDGES at most, more are
    refused), and each candidate is tried against its own component.
    """
    edges = structure.file_edges(facts)
    scc = graph.strong_components(edges)
    inside = checkpointed(graph.simple(edges).join(scc.select(F.col("node").alias("src"), F.col("component").alias("c")), "src").join(scc.select(F.col("node").alias("dst"), F.col("component").alias("d")), "dst").where("c = d").select("c", "src", "dst"))
    if inside.limit(CORE_EDGES + 1).count() > CORE_EDGES:
        raise WhatIfError(f"more than {CORE_EDGES} edges lie inside cycles")
    local = graph.simple(structure.file_edges(facts, True)).join(inside, ["src", "dst"]).orderBy("src", "dst").limit(candidates)
    by: dict = {}
    for r in inside.toLocalIterator():
        by.setdefault(r["c"], []).append((r["src"], r["dst"]))
    core = facts.files.sparkSession.sparkContext.broadcast(by)

    def tried(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for c, a, z in zip(b["c"], b["src"], b["dst"], strict=True):
                nodes, out = set(), {}
                for s, t in core.value[c]:
                    nodes |= {s, t}
                    if (s, t) != (a, z):
                        out.setdefault(s, []).append(t)
                rows.append((a, z, len(nodes) - len(_on_cycles(nodes, out))))
            yield pd.DataFrame(rows, columns=["src", "dst", "reduction"])

    done = local.select("c", "src", "dst").repartition(min(candidates, 64), "src", "dst").mapInPandas(tried, "src long, dst long, reduction long")
    return done.where("reduction > 0").orderBy(F.desc("reduction"), "src", "dst").limit(limit)


#: Edges inside cycles that every task of `cycle_breaks` may hold.
CORE_EDGES = 1_000_000


def _on_cycles(nodes: set, out: dict) -> set:
    """Nodes in strong components of more than one node, by an iterative depth-first search with low links."""
    index: dict = {}
    low: dict = {}
    stack: list = []
    held: set = set()
    found: set = set()
    for root in nodes:
        if root in index:
            continue
        work = [(root, iter(out.get(root, ())))]
        index[root] = low[root] = len(index)
        stack.append(root)
        held.add(root)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    held.add(w)
                    work.append((w, iter(out.get(w, ()))))
                    break
                if w in held:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while True:
                        w = stack.pop()
                        held.discard(w)
                        part.append(w)
                        if w == v:
                            break
                    if len(part) > 1:
                        found.update(part)
    return found
