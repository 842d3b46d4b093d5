"""The saved tables of a baseline and what two baselines differ in.

Saved tables keep the store's conventions: sentinels for missing references, shares as whole per-mille numbers (the
`arch_*` and `trend_*` tables keep shares), booleans as numbers. Top lists have the lengths of the metrics they save.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlens.functions import scalars as S
from factlens.operators import diff, evolution, graph, rules, structure
from factlens.operators.facts import Facts
from factlens.session import written
from factlens.sources.config import Config
from factlens.sources.store import inheritance, saved

ROOTS = ("modularity", "acyclicity", "depth", "equality", "redundancy", "structural_uniformity")
#: The tables of facts that are saved as they are, and the columns of the others that are cut out of wider metrics.
FACT_TABLES = ("files", "functions", "entry_points", "imports", "calls", "call_edges", "types", "trait_impls")


def per_mille(x: Column) -> Column:
    """A share as a whole number of thousandths."""
    return F.round(x * 1000, 0).cast("long")


def shared(facts: Facts) -> Facts:
    """The facts with the relations that most metrics read written once, so that they are not derived again by each."""
    return facts.replaced(**{n: written(getattr(facts, n), f"facts-{n}") for n in ("files", "functions", "imports", "calls", "call_edges")})


def health(facts: Facts, config: Config, found: DataFrame) -> DataFrame:
    """One row of all scores, counts, ratios and grades; `found` are the findings of the rules."""
    c = written(structure.complexity(facts), "health-complexity")
    cyclic = graph.cycle_members(structure.file_edges(facts))
    size = structure.size_metrics(facts)
    calls = structure.call_metrics(facts)
    resolution = structure.resolution_breakdown(facts)
    coupled = structure.coupling(facts, config)
    scores = structure.scores(facts, config, c, cyclic)
    test = S.is_test_path(S.clean_path(F.col("path")), config.test_roots)
    made = facts.files.where(~test).join(facts.functions.select("file_id").distinct(), "file_id", "left_semi").agg(F.count("*").alias("production_files"))
    rows = lambda d, n: d.agg(F.count("*").alias(n))
    entropies = structure.size_entropy(facts.files).select(F.col("normalised").alias("fn"), F.col("bits").alias("fb")).crossJoin(structure.entropy(c.groupBy("value").agg(F.count("*").alias("n"))).select(F.col("normalised").alias("cn"), F.col("bits").alias("cb")))
    parts = [
        scores, structure.coverage_score(facts),
        found.agg(F.count_if(F.col("severity") == "warning").alias("w"), F.count_if(F.col("severity") == "error").alias("e")),
        cyclic.agg(F.count("*").alias("cycles")),
        rows(facts.files, "files"), rows(facts.functions, "functions"), rows(facts.imports, "imports"), rows(facts.calls, "calls"), rows(facts.call_edges, "call_edges"),
        resolution, coupled, calls, size, structure.complexity_summary(c).drop("functions"), structure.gini(c, "value"),
        made, facts.files.agg(F.count_if(test).alias("test_files")), rows(structure.test_gaps(facts, config), "files_without_nearby_tests"),
        structure.dsm(facts, config)[0].select(F.col("edges").alias("module_edges")), rows(facts.commits, "commits_sampled"), entropies,
    ]
    one = reduce(lambda a, b: a.crossJoin(b), parts)
    structural = F.greatest(F.lit(0), 100 - F.least(F.lit(80), 20 * F.col("cycles")) - F.least(F.lit(40), 4 * F.col("w") + 10 * F.col("e"))).cast("long")
    as_is = lambda *names: [F.col(n).cast("long").alias(n) for n in names]
    return one.select(
        *as_is("score", "quality_signal", "coverage_score"), structural.alias("structural_score"),
        *[per_mille(F.col(n)).alias(f"{n}_per_1000") for n in ROOTS[:5]],
        *as_is("files", "functions", "imports", "calls", "call_edges"),
        *[F.col(n).cast("long").alias(f"{n}_imports") for n in ("local", "external", "system", "unresolved")],
        *as_is("cross_module_edges"), per_mille(F.col("cross_module_ratio")).alias("cross_module_ratio_per_1000"), per_mille(F.col("resolution_ratio")).alias("call_resolution_ratio_per_1000"),
        *as_is("max_function_fan_in", "max_function_fan_out", "max_file_lines", "max_function_lines"), F.col("max_complexity").cast("long").alias("max_function_complexity"),
        per_mille(F.col("mean_complexity")).alias("average_function_complexity_per_1000"), per_mille(F.col("gini")).alias("complexity_gini_per_1000"), per_mille(1 - F.col("redundancy")).alias("redundancy_ratio_per_1000"),
        *as_is("large_files", "long_functions", "production_files", "test_files", "files_without_nearby_tests", "module_edges", "commits_sampled"),
        per_mille(F.col("fn")).alias("file_size_entropy_per_1000"), per_mille(F.col("fb")).alias("file_size_entropy_bits_per_1000"), per_mille(F.col("cn")).alias("complexity_entropy_per_1000"), per_mille(F.col("cb")).alias("complexity_entropy_bits_per_1000"),
        per_mille(F.col("structural_uniformity")).alias("structural_uniformity_per_1000"),
        F.col("overall_grade").alias("grade_overall"), *[S.grade(F.col(n)).alias(f"grade_{n}") for n in ROOTS],
    )


def file_cycles(facts: Facts, n: int = 20) -> DataFrame:
    """(cycle_id, module, scc_size): one entry per file on a cycle, its path as module and size 1; the first n in file order."""
    on = graph.cycle_members(structure.file_edges(facts)).withColumnRenamed("node", "file_id").join(facts.files.select("file_id", "path"), "file_id").orderBy("file_id").limit(n)
    number = (F.row_number().over(Window.orderBy("file_id")) - 1).cast("long")
    return on.select(number.alias("cycle_id"), F.col("path").alias("module"), F.lit(1).cast("long").alias("scc_size"))


def tables(facts: Facts, config: Config, now: int, snapshot_id: str) -> dict[str, DataFrame]:
    """All saved tables but `meta`, which the store writes itself; the three trend tables hold one sample at `now`."""
    facts = shared(facts)
    found = written(rules.findings(facts, config), "facts-findings")
    scores = written(structure.scores(facts, config), "facts-scores")
    edges = structure.file_edges(facts)
    stable = structure.module_stability(facts, config)
    levels = written(graph.levels(edges, facts.files.select(F.col("file_id").alias("node"))), "facts-levels")
    c, cf = facts.commits, facts.commit_files
    cx = structure.complexity(facts).select("path", "value")
    temporal = written(evolution.temporal_hotspots(cf, cx), "facts-temporal")
    architecture = ["module", "fan_in", "fan_out", "instability"]
    sample = [F.lit(now).cast("long").alias("timestamp"), F.lit(snapshot_id).alias("snapshot_id")]
    coupled = evolution.change_coupling(cf)
    return {
        **{n: saved(n, getattr(facts, n)) for n in FACT_TABLES},
        "health": health(facts, config, found),
        "hotspots": structure.hotspots(facts),
        "rules": found,
        "module_edges": structure.dsm(facts, config)[1],
        "changed_files": evolution.changed_files(cf),
        "file_ownership": evolution.file_ownership(c, cf),
        "temporal_hotspots": temporal,
        "file_ages": evolution.file_ages(c, cf, now),
        "change_coupling": coupled.select("left", "right", "co_commits", per_mille(F.col("coupling_strength")).alias("coupling_strength_milli")),
        "inheritance": inheritance(facts.types),
        "arch_cycles": file_cycles(facts),
        "arch_unstable": structure.unstable_modules(stable).select(*architecture),
        "arch_foundations": structure.foundations(stable).select(*architecture),
        "arch_levels": levels.join(facts.files.select(F.col("file_id").alias("node"), "path"), "node").select(F.col("path").alias("module"), F.col("level").cast("long").alias("level")),
        "arch_distance": structure.type_distance(facts, config).drop("is_foundation"),
        "arch_violations": structure.violations(facts, levels),
        "trend_health": scores.crossJoin(found.agg(F.count("*").alias("rules"))).select(*sample, "score", "quality_signal", "rules", *ROOTS, "overall_grade"),
        "trend_hotspots": temporal.select(*sample, "path", "commits", "max_complexity", "risk_score"),
        "trend_violations": rules.rule_counts(found).select(*sample, "rule_id", "count"),
    }


COUNTED = {"score": "score", "coverage_score": "coverage_score", "structural_score": "structural_score", "file_count": "files", "function_count": "functions", "import_count": "imports", "call_count": "calls", "call_edge_count": "call_edges"}


def deltas(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """One row of the differences of scores and counts between the `health` tables of two baselines."""
    a, b = [t["health"].select(*[F.col(c).alias(f"{p}_{n}") for n, c in COUNTED.items()]) for p, t in (("a", before), ("b", after))]
    return a.crossJoin(b).select(*[(F.col(f"b_{n}") - F.col(f"a_{n}")).alias(f"{n}_delta") for n in COUNTED])


def changes(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(kind, key, change, before, after, delta): rules and hotspots added or removed, module edges added, removed or of another count.

    A rule is told by code, path, message and severity, a hotspot by its path. Each kind is one aggregation over both sides.
    """
    keyed = lambda t, name, keys, value: t[name].select(F.concat_ws("\u001f", *keys).alias("key"), value.cast("long").alias("n"))
    out = []
    for kind, name, keys, value in (("rule", "rules", ["code", "path", "message", "severity"], F.lit(1)), ("hotspot", "hotspots", ["path"], F.lit(1)), ("module_edge", "module_edges", ["from_module", "to_module"], F.col("edges"))):
        d = diff.keyed_diff(keyed(before, name, keys, value), keyed(after, name, keys, value), ["key"], ["n"])
        counted = kind == "module_edge"
        show = lambda c: F.when(F.lit(counted), F.col(c))  # noqa: B023, E731
        out.append(d.select(F.lit(kind).alias("kind"), "key", "change", show("before_n").alias("before"), show("after_n").alias("after"), F.when(F.lit(counted) & (F.col("change") == "changed"), F.col("after_n") - F.col("before_n")).alias("delta")))
    return reduce(lambda a, b: a.unionByName(b), out)
