"""The agent-facing surface as plain functions: each name gives DataFrames (or small values) from facts, a store or samples."""

from __future__ import annotations

import html
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.operators import baseline, diff, evolution, graph, rules, structure, trend, whatif
from factlens.operators.facts import Facts, of
from factlens.plans import policies, prefix, reports, typed_query
from factlens.sources import plugins, scan
from factlens.sources.config import PRESETS, Config, dump, load, write
from factlens.sources.store import Store


def edges(facts: Facts, limit: int = 1000) -> DataFrame:
    """Imports with the paths of both ends; an end that is no file shows its target text or #id."""
    f = facts.files.select(F.col("file_id").alias("i"), "path")
    j = facts.imports.join(f.withColumnRenamed("path", "a"), F.col("from_file") == F.col("i"), "left").drop("i").join(f.withColumnRenamed("path", "b"), F.col("resolved_file") == F.col("i"), "left").drop("i")
    to = F.coalesce("b", F.nullif("target", F.lit("")), F.concat(F.lit("#"), F.col("resolved_file").cast("string")))
    return j.select("import_id", F.coalesce("a", F.concat(F.lit("#"), F.col("from_file").cast("string"))).alias("from_path"), to.alias("to_path"), "kind", "resolution").orderBy("import_id").limit(limit)


def architecture(facts: Facts, config: Config, n: int = 5) -> dict[str, DataFrame]:
    """Cycles, levels, stability, foundations, distance, violations, attack surface and blast radius; lists cut to n."""
    e = structure.file_edges(facts)
    levels = graph.levels(e, facts.files.select(F.col("file_id").alias("node")))
    stable = structure.module_stability(facts, config)
    named = facts.files.select(F.col("file_id").alias("node"), "path")
    return {
        "cycles": graph.cycle_members(e).join(named, "node").orderBy("node").limit(20),
        "levels": levels.join(named, "node").orderBy(F.desc("level"), "path").limit(n),
        "unstable": structure.unstable_modules(stable, n),
        "foundations": structure.foundations(stable, n),
        "distance": structure.type_distance(facts, config).limit(n),
        "violations": structure.violations(facts, levels, n),
        "attack_surface": structure.attack_surface(facts),
        "blast_radius": structure.blast_radius(facts, config),
    }


def cycles(facts: Facts, n: int = 20) -> DataFrame:
    """(file_id, path) of the first n files on cycles, in file order."""
    return graph.cycle_members(structure.file_edges(facts)).withColumnRenamed("node", "file_id").join(facts.files.select("file_id", "path"), "file_id").orderBy("file_id").limit(n)


def find_file(facts: Facts, name: str) -> int:
    """The id of a file by id, path or the only path that ends so."""
    if name.isdigit():
        return int(name)
    rows = facts.files.where((F.col("path") == name) | F.col("path").endswith("/" + name)).orderBy(F.col("path") != name, "path").select("file_id", "path").limit(2).collect()
    if not rows or (len(rows) > 1 and rows[0]["path"] != name):
        raise ValueError(f"{name} is no single file")
    return rows[0]["file_id"]


def blast_radius(facts: Facts, name: str) -> DataFrame:
    """(path, depth) of the local files that depend on one file."""
    e = structure.file_edges(facts, True)
    target = facts.files.where(F.col("file_id") == find_file(facts, name)).select(F.col("file_id").alias("node"))
    return graph.blast_radius_of(e, target).join(facts.files.select(F.col("file_id").alias("node"), "path"), "node").select("path", "depth").orderBy("depth", "path")


def level(facts: Facts, name: str) -> int:
    """The dependency level of one file."""
    levels = graph.levels(structure.file_edges(facts), facts.files.select(F.col("file_id").alias("node")))
    return levels.where(F.col("node") == find_file(facts, name)).first()["level"]


def evolution_report(facts: Facts, config: Config, now: int) -> dict[str, DataFrame]:
    """All commit metrics."""
    c, cf = facts.commits, facts.commit_files
    cx = structure.complexity(facts).select("path", "value")
    own = evolution.file_ownership(c, cf)
    return {
        "changed_files": evolution.changed_files(cf), "top_authors": evolution.top_authors(c), "file_ownership": own, "file_ages": evolution.file_ages(c, cf, now), "change_coupling": evolution.change_coupling(cf),
        "temporal_hotspots": evolution.temporal_hotspots(cf, cx), "bug_prone": evolution.bug_prone(c, cf), "edit_risk": evolution.edit_risk(cf, cx, own, structure.test_gaps(facts, config)),
    }


def session_end(before: dict[str, Any], facts: Facts, config: Config) -> dict[str, Any]:
    """Whether a session passes against the `session_start` it began with: no lower score, no new finding."""
    score, found = structure.scores(facts, config).first()["score"], rules.findings(facts, config)
    return {"passes": diff.session_passes(before["score"], score, before["rules"], found), "score_delta": score - before["score"], "added": diff.added_rules(before["rules"], found)}


def scan_report(spark: SparkSession, root: str, config: Config | None = None) -> dict[str, DataFrame]:
    """The fact relations of a source tree."""
    return scan.facts(scan.read_tree(spark, root, [*(config.ignored_paths + config.generated_paths if config else [])]))


def rescan(spark: SparkSession, root: str, config: Config) -> dict[str, Any]:
    """A scan with its scores."""
    f = of(spark, **scan_report(spark, root, config))
    return {"facts": f, "scores": structure.scores(f, config)}


def saved_baseline(store: Store, facts: Facts, config: Config, now: int, snapshot_id: str) -> dict[str, DataFrame]:
    """Saves the baseline of the facts: one trend sample is appended, then all tables are written."""
    made = baseline.tables(facts, config, now, snapshot_id)
    rows = {n: made[n] for n in made if not n.startswith("trend_")}
    store.save(rows, snapshot_id, now, manifest={"snapshot_id": snapshot_id}, trend={n: made[n] for n in made if n.startswith("trend_")})
    return made


def treemap(facts: Facts, n: int = 500) -> str:
    """A page with the n largest files as boxes by size, named by path."""
    rows = facts.files.where("lines > 0").orderBy(F.desc("lines"), "path").select("path", "lines").limit(n).collect()
    boxes = "".join(f'<div title="{html.escape(r["path"], True)}" style="flex:{r["lines"]} 1 {max(20, int(r["lines"] ** 0.5) * 4)}px">{html.escape(r["path"].rsplit("/", 1)[-1])}</div>' for r in rows)
    return f'<!DOCTYPE html><meta charset="utf-8"><title>files by size</title><style>body{{display:flex;flex-wrap:wrap;font:11px sans-serif}}div{{border:1px solid #999;padding:2px;overflow:hidden;height:40px}}</style>{boxes}'


def limited(items: DataFrame, n: int) -> DataFrame:
    """The first n items in their order."""
    return items.limit(n)


#: Every tool by name.
TOOLS: dict[str, Callable] = {
    "config_read": load,
    "config_write": write,
    "scan": scan_report,
    "rescan": rescan,
    "visualize": treemap,
    "plugins": lambda config: config.plugins,
    "standard_plugins": plugins.standard,
    "plugin_add": plugins.added,
    "plugin_add_standard": plugins.with_standard,
    "plugin_remove": plugins.removed,
    "plugin_validate": plugins.validate,
    "plugin_scaffold": plugins.scaffold,
    "plugin_sync": plugins.sync,
    "health": structure.scores,
    "edges": edges,
    "hotspots": structure.hotspots,
    "rules": rules.findings,
    "module_edges": lambda f, c: structure.dsm(f, c)[1],
    "architecture": architecture,
    "coupling": structure.coupling,
    "cycles": cycles,
    "hottest": lambda f: {"files": structure.hotspots(f), "called": structure.top_functions(f), "complex": structure.complexity(f).where("value >= 10").orderBy(F.desc("value"), "path", "function_id").limit(20)},
    "blast_radius": blast_radius,
    "level": level,
    "session_start": lambda f, c: {"score": structure.scores(f, c).first()["score"], "rules": rules.findings(f, c)},
    "session_end": session_end,
    "check_rules": lambda f, c: rules.check_exit(rules.findings(f, c)),
    "policy_check": policies.evaluate_all,
    "evolution": evolution_report,
    "dsm": structure.dsm,
    "test_gaps": structure.test_gaps,
    "sarif": lambda f, c, root="": reports.sarif(rules.findings(f, c), root=root),
    "remediations": lambda f, c: rules.remediations(rules.findings(f, c), structure.test_gaps(f, c)),
    "what_if": whatif.sequence,
    "break_cycle_recommendations": whatif.cycle_breaks,
    "trend": lambda samples, columns, window, now: trend.first_last(trend.in_window(samples, window, now), columns),
    "drift": trend.drift,
    "policy_presets": lambda: sorted(PRESETS),
    "policy_init": lambda name: dump(PRESETS[name]),
    "memory_summary": Store.summary,
    "baseline_save": saved_baseline,
    "baseline_diff": lambda before, after: {"deltas": baseline.deltas(before, after), "changes": baseline.changes(before, after)},
    "baseline_tables": Store.names,
    "baseline_table_read": lambda store, name, args: typed_query.run(store.read(name), typed_query.from_json(args)),
    "baseline_query": lambda store, name, text: prefix.engine(store.spark, {"t": store.read(name), **{n: store.read(n) for n in store.names()}}).rows(text),
    "baseline_import_csv": Store.import_csv,
}
