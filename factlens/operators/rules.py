"""The built-in rule engine: one DataFrame of findings per rule, joined in the order of the rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlens.functions import scalars as S
from factlens.operators import graph, structure
from factlens.operators.facts import Facts
from factlens.session import written
from factlens.sources.config import Config

#: What to do about a finding, by code.
ACTIONS = {
    "min_quality_signal": "inspect the lowest root-cause score and fix the matching structural bottleneck",
    "min_modularity": "reduce cross-module edges or regroup files by cohesive module",
    "min_acyclicity": "remove dependency cycles by introducing a lower-level interface",
    "min_depth": "flatten long dependency chains or invert unnecessary layers",
    "min_equality": "split oversized files/functions and rebalance concentrated complexity",
    "min_redundancy": "remove dead functions or consolidate duplicated implementations",
    "max_file_lines": "split the file into smaller cohesive modules",
    "max_function_lines": "extract helpers or split the function into smaller steps",
    "max_function_complexity": "split the function, extract decision branches, or add a local policy override",
    "max_cognitive_complexity": "flatten nesting, return early, or extract nested decision branches",
    "high_fan_in": "introduce a facade boundary or split shared responsibilities",
    "production_depends_on_test": "move shared fixtures into a production-safe support module",
    "large_file": "split file by cohesive type, operation, or module boundary",
    "no_tests_detected": "add first tests at the expected test-gap paths",
    "low_call_resolution": "add language plugin patterns or enable a grammar-backed scanner",
    "layer_order": "invert the dependency or update ordered layer config",
    "max_upward_layer_violations": "remove upward layer dependencies or adjust layer ordering",
    "max_cycles": "break one dependency edge in each cycle or configure an allowed boundary",
}
DEFAULT_ACTION = "inspect the finding and tune policy or architecture"


def limit_of(config: Config, name: str, language: Column) -> Column:
    """A limit: the language's override, else a plugin's, else the global one."""
    out = F.lit(getattr(config.limits, name))
    for p in config.plugins:
        if name in p:
            out = F.when(language == p["name"], F.lit(p[name])).otherwise(out)
    for lang, over in config.limits.language_overrides.items():
        if name in over:
            out = F.when(language == lang, F.lit(over[name])).otherwise(out)
    return out


def _finding(df: DataFrame, seq: int, severity: str, code: str, path: Column, message: Column, *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.orderBy(*order)) if order else F.lit(1)
    return df.select(F.lit(seq).alias("_seq"), rank.alias("_rank"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), path.cast("string").alias("path"), message.alias("message"))


def findings(facts: Facts, config: Config, root: str = ".") -> DataFrame:
    """(severity, code, path, message) of all rules, in rule order. Each list is bounded by its limit or the hot list it reads."""
    lim, at = config.limits, F.lit(root)
    out: list[DataFrame] = []
    text = lambda f, *c: F.format_string(f, *c)
    files = facts.files.withColumn("path", S.clean_path(F.col("path")))
    # What several rules read is derived once and written.
    each = written(structure.complexity(facts), "rules-complexity")
    cyclic = graph.cycle_members(structure.file_edges(facts))
    score = written(structure.scores(facts, config, each, cyclic), "rules-scores")
    if lim.min_quality_signal:
        out.append(_finding(score.where(F.col("quality_signal") < lim.min_quality_signal), 0, "error", "min_quality_signal", at, text(f"quality signal %d below minimum {lim.min_quality_signal}", "quality_signal")))
    for i, name in enumerate(("modularity", "acyclicity", "depth", "equality", "redundancy")):
        least = getattr(lim, f"min_{name}")
        if least > 0:
            out.append(_finding(score.where(F.col(name) < least), 1 + i, "error", f"min_{name}", at, text(f"{name} %.3f below minimum {least:.3f}", name)))
    graph_row = structure.graph_metrics(facts, cyclic)
    out.append(_finding(graph_row.where(F.col("cycle_count") > lim.max_cycles), 6, "error", "max_cycles", at, text(f"%d cycle participants exceeds max {lim.max_cycles}", "cycle_count")))
    out.append(_finding(structure.coupling(facts, config).where(F.col("cross_module_ratio") > lim.max_coupling_ratio), 7, "warning", "max_coupling", at, text(f"cross-module ratio %.3f exceeds max {lim.max_coupling_ratio:.3f}", "cross_module_ratio")))
    c = each.join(files.select("file_id", "language"), "file_id")
    few = max(lim.max_call_hotspot_findings, 1)
    for seq, code, value, name in ((8, "max_function_complexity", "value", "complexity"), (9, "max_cognitive_complexity", "cognitive_value", "cognitive complexity")):
        over = c.withColumn("_limit", limit_of(config, code, F.col("language"))).where(F.col(value) > F.col("_limit"))
        if code == "max_cognitive_complexity":
            over = over.where("_limit > 0")
        out.append(_finding(over.orderBy("function_id").limit(few), seq, "warning", code, F.col("path"), text(f"%s {name} %d exceeds max %d", "name", value, "_limit"), F.col("function_id")))
    long_files = files.withColumn("_limit", limit_of(config, "max_file_lines", F.col("language"))).where("_limit > 0 and lines > _limit")
    out.append(_finding(long_files.orderBy("file_id").limit(max(lim.max_large_file_findings, 1)), 10, "error", "max_file_lines", F.col("path"), text("%d lines exceeds max %d", "lines", "_limit"), F.col("file_id")))
    length = F.col("end_line") - F.col("start_line") + 1
    long_functions = facts.functions.join(files.select("file_id", "path", "language"), "file_id").withColumn("_n", length).withColumn("_limit", limit_of(config, "max_function_lines", F.col("language"))).where("_limit > 0 and _n > _limit")
    out.append(_finding(long_functions.orderBy("function_id").limit(few), 11, "error", "max_function_lines", F.col("path"), text("%s has %d lines exceeding max %d", "name", "_n", "_limit"), F.col("function_id")))
    hot = structure.hotspots(facts).join(files.select("file_id", "language"), "file_id")
    out.append(_finding(hot.where(F.col("fan_in") >= limit_of(config, "high_file_fan_in", F.col("language"))), 12, "warning" if lim.no_god_files else "info", "high_fan_in", F.col("path"), text("%d incoming dependency edges", "fan_in"), F.desc(F.col("fan_in") + F.col("fan_out")), F.desc("fan_in"), F.col("path")))
    if lim.no_god_files:
        out.append(_finding(structure.god_files(facts, config), 13, "warning", "no_god_files", F.col("path"), text("%d outgoing dependency edges", "fan_out"), F.desc("fan_out"), F.col("path")))
    ends = facts.imports.where("resolved_file is not null and resolved_file <> from_file").join(files.select(F.col("file_id").alias("from_file"), F.col("path").alias("fp"), F.col("module").alias("fm")), "from_file").join(files.select(F.col("file_id").alias("resolved_file"), F.col("path").alias("tp"), F.col("module").alias("tm")), "resolved_file")
    out.append(_finding(ends.where(~S.is_test_path(F.col("fp")) & S.is_test_path(F.col("tp"))), 14, "warning", "production_depends_on_test", F.col("fp"), F.concat(F.lit("depends on test path "), "tp"), F.col("import_id")))
    large = files.where(F.col("lines") >= limit_of(config, "large_file_lines", F.col("language")))
    out.append(_finding(large.orderBy(F.desc("lines"), "path").limit(lim.max_large_file_findings), 15, "info", "large_file", F.col("path"), text("%d lines", "lines"), F.desc("lines"), F.col("path")))
    out.append(_finding(large.agg((F.count("*") - lim.max_large_file_findings).alias("n")).where("n > 0"), 16, "info", "large_file_summary", at, text("%d additional large files", "n")))
    if lim.no_tests_detected:
        tests = files.agg(F.count_if(S.is_test_path(F.col("path"), config.test_roots)).alias("t")).where("t = 0")
        made = files.where(~S.is_test_path(F.col("path"), config.test_roots)).join(facts.functions.select("file_id").distinct(), "file_id", "left_semi").agg(F.count("*").alias("n")).where("n > 0")
        out.append(_finding(made.crossJoin(tests), 17, "info", "no_tests_detected", at, text("%d production files and no test files detected", "n")))
    calls = structure.call_metrics(facts).where((F.col("total_calls") >= lim.low_call_resolution_min_calls) & (F.col("resolution_ratio") < lim.low_call_resolution_ratio))
    out.append(_finding(calls, 18, "info", "low_call_resolution", at, text("%d of %d calls resolved (%.3f)", "resolved_edges", "total_calls", "resolution_ratio")))
    for seq, code, called, way in ((19, "high_function_fan_in", True, "incoming"), (20, "high_function_fan_out", False, "outgoing")):
        top = structure.top_functions(facts, called).join(files.select("file_id", "language"), "file_id").where(F.col("calls") >= limit_of(config, code, F.col("language")))
        out.append(_finding(top.orderBy(F.desc("calls"), "path", "name").limit(lim.max_call_hotspot_findings), seq, "info", code, F.col("path"), text(f"%s has %d resolved {way} calls", "name", "calls"), F.desc("calls"), F.col("path"), F.col("name")))
    spark = facts.files.sparkSession
    if config.forbidden:
        bad = F.broadcast(spark.createDataFrame([(f.from_module, f.to_module, f.reason.strip()) for f in config.forbidden], "fm string, tm string, reason string"))
        by = ends.select(S.top_module(F.col("fm")).alias("fm"), S.top_module(F.col("tm")).alias("tm")).groupBy("fm", "tm").agg(F.count("*").alias("n")).join(bad, ["fm", "tm"])
        out.append(_finding(by, 21, "warning", "forbidden_module_edge", at, F.concat(text("%s -> %s has %d dependency edges", "fm", "tm", "n"), F.when(F.col("reason") == "", "").otherwise(F.concat(F.lit(": "), "reason"))), F.col("fm"), F.col("tm")))
    if config.layers:
        longest = sorted(config.layers, key=lambda x: len(x.path))
        pick = lambda p: reduce(lambda acc, x: F.when(F.col(p).rlike(S.rule_regex(x.path)), F.struct(F.lit(x.name).alias("name"), F.lit(x.order).alias("order"))).otherwise(acc), longest, F.lit(None).cast("struct<name:string,order:int>"))
        up = ends.withColumn("a", pick("fp")).withColumn("b", pick("tp")).where("a is not null and b is not null and a.order < b.order")
        if lim.max_upward_layer_violations:
            out.append(_finding(up.agg(F.count("*").alias("n")).where(F.col("n") > lim.max_upward_layer_violations), 22, "error", "max_upward_layer_violations", at, text(f"%d upward layer violations exceeds max {lim.max_upward_layer_violations}", "n")))
        out.append(_finding(up, 23, "warning", "layer_order", F.col("fp"), text("%s depends upward on %s through %s", "a.name", "b.name", "tp"), F.col("import_id")))
    every = reduce(lambda a, b: a.unionByName(b), out)
    return every.orderBy("_seq", "_rank").select("severity", "code", "path", "message")


def remediations(found: DataFrame, gaps: DataFrame, n: int = 50) -> DataFrame:
    """(code, path, action, command) per finding, then of the first ten test gaps; the n first."""
    action = F.coalesce(F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])[F.col("code")], F.lit(DEFAULT_ACTION))
    rows = found.select("code", "path", action.alias("action"), F.concat(F.lit("factlens check "), S.shell_path(F.col("path")), F.lit(" --json")).alias("command")).limit(n)
    first = F.element_at("expected_tests", 1)
    gap = gaps.where(F.size("expected_tests") > 0).orderBy("path").limit(10).select(F.lit("test_gap").alias("code"), "path", F.concat(F.lit("add a "), "framework", F.lit(" test for "), "path").alias("action"), F.concat(F.lit("mkdir -p "), S.parent_path(first), F.lit(" && touch "), S.shell_path(first)).alias("command"))
    return rows.unionByName(gap).limit(n)


def structural_score(found: DataFrame, cycles: int) -> int:
    """100 less up to 80 for cycles and up to 40 for findings."""
    r = found.agg(F.count_if(F.col("severity") == "warning").alias("w"), F.count_if(F.col("severity") == "error").alias("e")).first()
    return max(0, 100 - min(80, 20 * cycles) - min(40, 4 * r["w"] + 10 * r["e"]))


def check_exit(found: DataFrame) -> int:
    """1 if a finding is an error."""
    return 0 if found.where("severity = 'error'").isEmpty() else 1


def rule_counts(found: DataFrame) -> DataFrame:
    """(rule_id, count) of findings per code."""
    return found.groupBy(F.col("code").alias("rule_id")).agg(F.count("*").alias("count"))
