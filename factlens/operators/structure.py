"""Coupling, cohesion, calls, size and architecture metrics over the fact relations.

Tables named after top lists are cut to the length their docstring gives, with a total order; the cut feeds scores.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlens.functions import scalars as S
from factlens.operators import graph
from factlens.operators.facts import Facts
from factlens.sources.config import Config


#: Parts that the calls of one name are spread over.
SALT = 16


def entropy(counts: DataFrame, n: str = "n") -> DataFrame:
    """One row (bits, normalised, groups) of a column of counts; (0, 0) for at most one positive count. Rounded to three decimals."""
    c = counts.where(F.col(n) > 0)
    both = c.agg(F.sum(n).alias("total"), F.sum(F.col(n) * F.log2(n)).alias("nlogn"), F.count("*").alias("groups"))
    bits = F.log2("total") - F.col("nlogn") / F.col("total")
    some = F.col("groups") > 1
    return both.select(F.when(some, S.round3(bits)).otherwise(F.lit(0.0)).alias("bits"), F.when(some, S.round3(bits / F.log2("groups"))).otherwise(F.lit(0.0)).alias("normalised"), "groups")


def gini(values: DataFrame, v: str) -> DataFrame:
    """One row (gini) to three decimals; 0 for fewer than two values or a zero sum.

    Equal values are aggregated first and ranked as a block, so that the window runs over distinct values only.
    """
    by = values.where(F.col(v).isNotNull()).groupBy(F.col(v).cast("double").alias("x")).agg(F.count("*").alias("c"))
    w = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    ranked = by.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0)))
    ranks = F.col("c") * (2 * F.col("before") + F.col("c") + 1) / 2
    t = ranked.agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("x")).alias("s"), F.sum(ranks * F.col("x")).alias("r"))
    value = S.round3(2 * F.col("r") / (F.col("n") * F.nullif("s", F.lit(0.0))) - (F.col("n") + 1) / F.col("n"))
    return t.select(F.when((F.col("n") < 2) | (F.coalesce("s", F.lit(0.0)) == 0) | F.col("n").isNull(), F.lit(0.0)).otherwise(value).alias("gini"))


def file_edges(facts: Facts, local: bool = False) -> DataFrame:
    """(src, dst) of resolved imports between files that exist, loops aside, parallel edges kept."""
    i = facts.imports.where("resolved_file is not null and resolved_file <> from_file" + (" and resolution = 'local'" if local else ""))
    ids = facts.files.select("file_id")
    e = i.select(F.col("from_file").alias("src"), F.col("resolved_file").alias("dst"))
    return e.join(ids.withColumnRenamed("file_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("file_id", "dst"), "dst", "left_semi")


def grouped_files(facts: Facts, config: Config) -> DataFrame:
    """(file_id, path, group, language, module)."""
    path = S.clean_path(F.col("path"))
    group = S.module_group(path, F.col("language"), F.col("module"), config.module_roots, [(x.name, x.path) for x in config.layers])
    return facts.files.select("file_id", path.alias("path"), group.alias("group"), "language", "module")


def graph_metrics(facts: Facts, cyclic: DataFrame | None = None) -> DataFrame:
    """One row: edge_count (all imports), resolved_edge_count, max_fan_in, max_fan_out, cycle_count. `cyclic` are the files on cycles, where known."""
    e = facts.imports.where("resolved_file is not null and resolved_file <> from_file").select(F.col("from_file").alias("src"), F.col("resolved_file").alias("dst"))
    top = lambda c, name: e.groupBy(c).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias(name))
    cyclic = graph.cycle_members(file_edges(facts)) if cyclic is None else cyclic
    cycles = cyclic.agg(F.count("*").alias("cycle_count"))
    resolved = facts.imports.agg(F.count("*").alias("edge_count"), F.count("resolved_file").alias("resolved_edge_count"))
    return resolved.crossJoin(top("dst", "max_fan_in")).crossJoin(top("src", "max_fan_out")).crossJoin(cycles)


def resolution_breakdown(facts: Facts) -> DataFrame:
    """One row: imports by resolution."""
    return facts.imports.agg(*[F.count_if(F.col("resolution") == r).alias(r) for r in ("local", "external", "system", "unresolved")])


def hotspots(facts: Facts, n: int | None = 10) -> DataFrame:
    """(file_id, path, module, fan_in, fan_out) of connected files: the n with most edges, then fan_in, then path."""
    d = graph.degree(file_edges(facts))
    out = facts.files.join(d.select(F.col("_node").alias("file_id"), F.col("_in_degree").alias("fan_in"), F.col("_out_degree").alias("fan_out")), "file_id").select("file_id", "path", "module", "fan_in", "fan_out")
    return out if n is None else out.orderBy(F.desc(F.col("fan_in") + F.col("fan_out")), F.desc("fan_in"), "path").limit(n)


def group_edges(facts: Facts, config: Config, local: bool = True) -> DataFrame:
    """(src, dst, from_group, to_group) of file edges."""
    g = grouped_files(facts, config)
    return file_edges(facts, local).join(g.select(F.col("file_id").alias("src"), F.col("group").alias("from_group")), "src").join(g.select(F.col("file_id").alias("dst"), F.col("group").alias("to_group")), "dst")


def stability(edges: DataFrame, modules: DataFrame, a: str = "from_module", b: str = "to_module", n: Column | None = None) -> DataFrame:
    """(module, fan_in, fan_out, instability) of every module over the edges between different ones; 0 where isolated."""
    w = F.lit(1) if n is None else n
    cross = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("a"), F.col(b).alias("b"), w.alias("w"))
    ends = cross.select(F.explode(F.array(F.struct(F.col("a").alias("m"), F.col("w").alias("o"), F.lit(0).cast("long").alias("i")), F.struct(F.col("b").alias("m"), F.lit(0).cast("long").alias("o"), F.col("w").alias("i")))).alias("e")) if n is not None else cross.select(F.explode(F.array(F.struct(F.col("a").alias("m"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("b").alias("m"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    d = ends.groupBy(F.col("e.m").alias("module")).agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))
    full = modules.select("module").distinct().join(d, "module", "left").select("module", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))
    return full.withColumn("instability", S.ratio(F.col("fan_out"), F.col("fan_in") + F.col("fan_out")))


def module_stability(facts: Facts, config: Config) -> DataFrame:
    """`stability` of the module groups over local imports."""
    modules = grouped_files(facts, config).select(F.col("group").alias("module"))
    return stability(group_edges(facts, config).select(F.col("from_group").alias("from_module"), F.col("to_group").alias("to_module")), modules)


def unstable_modules(stable: DataFrame, n: int = 20) -> DataFrame:
    """The n modules with most outgoing edges."""
    return stable.orderBy(F.desc("fan_out"), "module").limit(n)


def is_foundation() -> Column:
    """Whether a row of `stability` is a stable foundation."""
    return (F.col("fan_in") >= 2) & ((F.col("fan_out") == 0) | (F.col("instability") <= 0.15))


def foundations(stable: DataFrame, n: int | None = 20) -> DataFrame:
    """Stable foundations, those with most incoming edges first."""
    out = stable.where(is_foundation()).orderBy(F.desc("fan_in"), "module")
    return out if n is None else out.limit(n)


def foundation_files(facts: Facts, config: Config) -> DataFrame:
    """(file_id) of files in a stable module, with at least five local importers, or that stand for their folder."""
    stable = foundations(module_stability(facts, config), None).select(F.col("module").alias("group"), F.lit(True).alias("stable"))
    fan = file_edges(facts, True).groupBy(F.col("dst").alias("file_id")).agg(F.count("*").alias("fan_in"))
    g = grouped_files(facts, config).join(stable, "group", "left").join(fan, "file_id", "left")
    return g.where(F.coalesce("stable", F.lit(False)) | (F.coalesce("fan_in", F.lit(0)) >= 5) | S.is_package_index(F.col("path"))).select("file_id")


def coupling(facts: Facts, config: Config) -> DataFrame:
    """One row: local_edges, cross_module_edges, cross_unstable_edges and the two ratios over local edges."""
    stable = foundations(module_stability(facts, config), None).select(F.col("module").alias("to_group"), F.lit(True).alias("stable"))
    e = group_edges(facts, config).join(stable, "to_group", "left")
    cross = F.col("from_group") != F.col("to_group")
    out = e.agg(F.count("*").alias("local_edges"), F.count_if(cross).alias("cross_module_edges"), F.count_if(cross & F.col("stable").isNull()).alias("cross_unstable_edges"))
    return out.withColumn("cross_module_ratio", S.ratio(F.col("cross_module_edges"), F.col("local_edges"))).withColumn("cross_unstable_ratio", S.ratio(F.col("cross_unstable_edges"), F.col("local_edges")))


def coupling_entropy(facts: Facts, config: Config) -> DataFrame:
    """`entropy` over module pairs of local edges that cross modules into no foundation."""
    stable = foundations(module_stability(facts, config), None).select(F.col("module").alias("to_group"))
    pairs = group_edges(facts, config).where("from_group <> to_group").join(stable, "to_group", "left_anti")
    return entropy(pairs.groupBy("from_group", "to_group").agg(F.count("*").alias("n")))


def cohesion(facts: Facts, config: Config) -> DataFrame:
    """One row: average over modules of two or more files that are no tests of min(1, distinct inner pairs / (files - 1)), and their number."""
    g = grouped_files(facts, config).where(~S.is_test_path(F.col("path"), config.test_roots)).select("file_id", "group")
    f = facts.functions.select("function_id", "file_id")
    calls = facts.call_edges.join(f.select(F.col("function_id").alias("caller_function"), F.col("file_id").alias("src")), "caller_function").join(f.select(F.col("function_id").alias("callee_function"), F.col("file_id").alias("dst")), "callee_function").select("src", "dst").where("src <> dst")
    pairs = file_edges(facts).union(calls).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    inner = pairs.join(g.select(F.col("file_id").alias("a"), F.col("group").alias("ga")), "a").join(g.select(F.col("file_id").alias("b"), F.col("group").alias("gb")), "b").where("ga = gb").groupBy(F.col("ga").alias("group")).agg(F.count("*").alias("pairs"))
    sizes = g.groupBy("group").agg(F.count("*").alias("files")).where("files >= 2")
    each = sizes.join(inner, "group", "left").select(F.least(F.lit(1.0), F.coalesce("pairs", F.lit(0)) / (F.col("files") - 1)).alias("c"))
    return each.agg(S.round3(F.avg("c")).alias("average_cohesion"), F.count("*").alias("cohesive_modules"))


def _local_degree(facts: Facts) -> DataFrame:
    d = graph.degree(file_edges(facts, True))
    return facts.files.join(d.select(F.col("_node").alias("file_id"), F.col("_in_degree").alias("fan_in"), F.col("_out_degree").alias("fan_out")), "file_id").select("file_id", "path", "module", "fan_in", "fan_out").withColumn("instability", S.ratio(F.col("fan_out"), F.col("fan_in") + F.col("fan_out")))


def god_files(facts: Facts, config: Config, n: int = 10) -> DataFrame:
    """The n files that import most, at or over the limit, tests and index files aside."""
    path = S.clean_path(F.col("path"))
    d = _local_degree(facts).where((F.col("fan_out") >= config.limits.high_file_fan_out) & ~S.is_test_path(path, config.test_roots) & ~S.is_package_index(path))
    return d.orderBy(F.desc("fan_out"), "path").limit(n)


def unstable_hotspots(facts: Facts, config: Config, n: int = 10) -> DataFrame:
    """The n most imported files at or over the limit that themselves import."""
    return _local_degree(facts).where((F.col("fan_in") >= config.limits.high_file_fan_in) & (F.col("instability") >= 0.15)).orderBy(F.desc("fan_in"), F.desc("fan_out"), "path").limit(n)


def unstable_files(facts: Facts, n: int = 10) -> DataFrame:
    """The n files of highest instability."""
    return _local_degree(facts).orderBy(F.desc("instability"), F.desc("fan_out"), "path").limit(n)


def call_metrics(facts: Facts) -> DataFrame:
    """One row: total_calls, resolved_edges, resolution_ratio, max_function_fan_in, max_function_fan_out."""
    top = lambda c, name: facts.call_edges.groupBy(c).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias(name))
    t = facts.calls.agg(F.count("*").alias("total_calls")).crossJoin(facts.call_edges.agg(F.count("*").alias("resolved_edges")))
    return t.withColumn("resolution_ratio", S.ratio(F.col("resolved_edges"), F.col("total_calls"))).crossJoin(top("callee_function", "max_function_fan_in")).crossJoin(top("caller_function", "max_function_fan_out"))


def top_functions(facts: Facts, called: bool = True, n: int = 10) -> DataFrame:
    """(function_id, file_id, path, name, calls) of the n most called (or most calling) functions."""
    side = "callee_function" if called else "caller_function"
    c = facts.call_edges.groupBy(F.col(side).alias("function_id")).agg(F.count("*").alias("calls"))
    out = c.join(facts.functions, "function_id").join(facts.files.select("file_id", "path"), "file_id").select("function_id", "file_id", "path", "name", "calls")
    return out.orderBy(F.desc("calls"), "path", "name", "function_id").limit(n)


def resolved_calls(calls: DataFrame, functions: DataFrame, files: DataFrame) -> DataFrame:
    """(call_id, caller_function, callee_function): each call to the only function of its name in its file, else in its top folder, else anywhere.

    Functions are counted per name, not listed. The join on the bare name is spread over SALT parts, as one name may be that of a third of all calls.
    """
    top = F.element_at(F.split(F.col("path"), "/"), 1)
    f = functions.join(files.select("file_id", top.alias("top")), "file_id").select(F.col("name").alias("target"), F.col("file_id").alias("ff"), F.col("top").alias("ft"), F.col("function_id").alias("g"))
    per_file = f.groupBy("target", "ff").agg(F.count("*").alias("n"), F.min("g").alias("g"))
    per_top = f.groupBy("target", "ft").agg(F.count("*").alias("n"), F.min("g").alias("g"))
    overall = f.groupBy("target").agg(F.count("*").alias("n"), F.min("g").alias("g"))
    one = lambda t, *keys: t.where("n = 1").select(*keys, F.col("g"))
    c = calls.where("caller_function is not null").join(files.select("file_id", top.alias("top")), "file_id").withColumn("target", F.element_at(F.split("target", r"::|\."), -1))
    j = c.join(one(per_file, "target", F.col("ff").alias("file_id")).withColumnRenamed("g", "g1"), ["target", "file_id"], "left")
    anywhere = one(overall, "target").select("target", F.col("g").alias("g3"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt"))
    j = j.join(one(per_top, "target", F.col("ft").alias("top")).withColumnRenamed("g", "g2"), ["target", "top"], "left")
    j = j.withColumn("_salt", F.pmod(F.xxhash64("call_id"), F.lit(SALT)).cast("int")).join(anywhere, ["target", "_salt"], "left")
    return j.select("call_id", "caller_function", F.coalesce("g1", "g2", "g3").alias("callee_function")).where("callee_function is not null")


def enclosing(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """(line_id, function_id) of the innermost range around each line; the least id on ties. `lines`: line_id, file_id, line; `ranges`: function_id, file_id, start_line, end_line."""
    j = lines.join(ranges, "file_id").where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    return j.groupBy("line_id").agg(F.min_by("function_id", F.struct(F.col("end_line") - F.col("start_line"), F.col("function_id"))).alias("function_id"))


def size_metrics(facts: Facts) -> DataFrame:
    """One row: max_file_lines, large_files (500 lines), max_function_lines, long_functions (80 lines), comment_ratio."""
    f = facts.files.agg(F.max("lines").alias("max_file_lines"), F.count_if(F.col("lines") >= 500).alias("large_files"), F.sum("comment_lines").alias("c"), F.sum("lines").alias("l"))
    length = F.col("end_line") - F.col("start_line") + 1
    g = facts.functions.agg(F.coalesce(F.max(length), F.lit(0)).alias("max_function_lines"), F.count_if(length >= 80).alias("long_functions"))
    return f.crossJoin(g).select("max_file_lines", "large_files", "max_function_lines", "long_functions", S.ratio(F.coalesce("c", F.lit(0)), F.coalesce("l", F.lit(0))).alias("comment_ratio"))


def size_entropy(files: DataFrame) -> DataFrame:
    """`entropy` of file sizes over powers of two."""
    return entropy(files.where("lines is not null and lines >= 0").groupBy(S.size_bucket(F.col("lines")).alias("bucket")).agg(F.count("*").alias("n")))


def dsm(facts: Facts, config: Config, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """The module matrix: one row (modules, edges), and its n heaviest pairs."""
    pairs = group_edges(facts, config, False).where("from_group <> to_group").groupBy(F.col("from_group").alias("from_module"), F.col("to_group").alias("to_module")).agg(F.count("*").alias("edges"))
    total = grouped_files(facts, config).agg(F.countDistinct("group").alias("modules")).crossJoin(pairs.agg(F.coalesce(F.sum("edges"), F.lit(0)).alias("edges")))
    return total, pairs.orderBy(F.desc("edges"), "from_module", "to_module").limit(n)


def entry_counts(facts: Facts) -> DataFrame:
    """One row: entry points by kind."""
    return facts.entry_points.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("binary", "example", "test")])


def type_distance(facts: Facts, config: Config, n: int = 20) -> DataFrame:
    """Distance from the main sequence of the n farthest modules with types: abstractness, instability (0.5 isolated), |A + I - 1|."""
    g = grouped_files(facts, config).select("file_id", F.col("group").alias("module"))
    t = facts.types.join(g, "file_id").groupBy("module").agg(F.count_if("is_abstract").alias("abstract_count"), F.count("*").alias("total_types"))
    s = module_stability(facts, config).join(t, "module")
    isolated = F.col("fan_in") + F.col("fan_out") == 0
    a = S.ratio(F.col("abstract_count"), F.col("total_types"))
    i = F.when(isolated, F.lit(0.5)).otherwise(F.col("instability"))
    out = s.select("module", a.alias("abstractness"), i.alias("instability"), S.round3(F.abs(a + i - 1)).alias("distance"), "abstract_count", "total_types", "fan_in", "fan_out", (is_foundation() | (i <= 0.3)).alias("is_foundation"))
    return out.orderBy(F.desc("distance"), "module").limit(n)


def average_distance(distances: DataFrame) -> DataFrame:
    """One row: the average distance of the listed modules that are no foundation."""
    return distances.where("not is_foundation").agg(F.coalesce(S.round3(F.avg("distance")), F.lit(0.0)).alias("average_distance"))


def attack_surface(facts: Facts) -> DataFrame:
    """One row: files on the import graph that entry points reach (the entry files among them), all files on it, and the ratio."""
    e = file_edges(facts)
    on = graph.nodes(e)
    starts = facts.entry_points.select(F.col("file_id").alias("node")).distinct().join(on, "node", "left_semi")
    got = graph.reach(e, starts).agg(F.count("*").alias("reachable"))
    return got.crossJoin(on.agg(F.count("*").alias("total"))).withColumn("ratio", S.ratio(F.col("reachable"), F.col("total")))


def blast_radius(facts: Facts, config: Config) -> DataFrame:
    """One row: the file that reaches most others (least id on ties) and how many; the same among files that are no foundation."""
    counts = graph.reach_counts(file_edges(facts))
    best = lambda d, p: d.agg(F.coalesce(F.max("reached"), F.lit(0)).alias(p), F.min_by("node", F.struct(-F.col("reached"), F.col("node"))).alias(f"{p}_file"))
    free = counts.join(foundation_files(facts, config).withColumnRenamed("file_id", "node"), "node", "left_anti")
    return best(counts, "max_blast_radius").crossJoin(best(free, "max_non_foundation"))


def violations(facts: Facts, levels: DataFrame, n: int = 20) -> DataFrame:
    """Local edges to a higher level (`upward_level`) or inside a cycle (`cycle_edge`), widest first, the n first."""
    e = file_edges(facts, True)
    lv = facts.files.select("file_id", "path").join(levels.select(F.col("node").alias("file_id"), "level"), "file_id")
    scc = graph.strong_components(file_edges(facts))
    ends = lambda p: lv.select(F.col("file_id").alias(p), F.col("path").alias(f"{p}_path"), F.col("level").alias(f"{p}_level"))
    j = e.join(ends("src"), "src").join(ends("dst"), "dst").join(scc.select(F.col("node").alias("src"), F.col("component").alias("cs")), "src", "left").join(scc.select(F.col("node").alias("dst"), F.col("component").alias("cd")), "dst", "left")
    reason = F.when(F.col("src_level") < F.col("dst_level"), "upward_level").when(F.col("cs") == F.col("cd"), "cycle_edge")
    out = j.withColumn("reason", reason).where("reason is not null").select(F.col("src").alias("from_file_id"), F.col("src_path").alias("from_path"), F.col("src_level").alias("from_level"), F.col("dst").alias("to_file_id"), F.col("dst_path").alias("to_path"), F.col("dst_level").alias("to_level"), "reason")
    return out.orderBy(F.desc(F.abs(F.col("from_level") - F.col("to_level"))), "from_path", "to_path").limit(n)


def test_gaps(facts: Facts, config: Config) -> DataFrame:
    """(file_id, path, framework, expected_tests) of files with functions and no test where one is expected."""
    path = S.clean_path(F.col("path"))
    f = facts.files.select("file_id", path.alias("path"), S.test_framework(F.col("language")).alias("framework"))
    test = S.is_test_path(F.col("path"), config.test_roots)
    production = f.where(~test).join(facts.functions.select("file_id").distinct(), "file_id", "left_semi").withColumn("expected_tests", S.expected_tests(F.col("path"), F.col("framework"), config.test_roots))
    hit = production.select("file_id", F.explode("expected_tests").alias("path")).join(f.where(test).select("path").distinct(), "path", "left_semi").select("file_id").distinct()
    return production.join(hit, "file_id", "left_anti")


def complexity(facts: Facts) -> DataFrame:
    """(function_id, file_id, path, name, value, cognitive_value, fingerprint, shape) per function with a body."""
    f = facts.functions.join(facts.files.select("file_id", "path", "language"), "file_id")
    body, language = F.coalesce("body", F.lit("")), F.col("language")
    return f.select("function_id", "file_id", "path", "name", S.lexical_complexity(body, language).alias("value"), S.cognitive_complexity(body, language).alias("cognitive_value"), S.body_fingerprint(body).alias("fingerprint"), S.shape_fingerprint(body).alias("shape"))


def duplicate_groups(c: DataFrame, n: int = 20) -> DataFrame:
    """(name, kind, size) of groups of more than one function with one body fingerprint, then one name; the n largest, fingerprints before names."""
    by = lambda key, kind, label: c.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("size"), F.min("name").alias("a"), F.max("name").alias("b")).where("size > 1").select(label.alias("name"), F.lit(kind).alias("kind"), "size", F.col(key).alias("key"))
    bodies = by("fingerprint", 0, F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("similar_body"))
    names = c.groupBy(F.col("name").alias("key")).agg(F.count("*").alias("size")).where("size > 1").select(F.concat(F.lit("name:"), "key").alias("name"), F.lit(1).alias("kind"), "size", "key")
    return bodies.unionByName(names).orderBy(F.desc("size"), "name", "kind", "key").limit(n)


def shape_groups(c: DataFrame, n: int = 20) -> DataFrame:
    """(shape, size) of groups of more than one function of one shape, the n largest."""
    return c.where("shape is not null").groupBy("shape").agg(F.count("*").alias("size")).where("size > 1").orderBy(F.desc("size"), "shape").limit(n)


def dead_functions(facts: Facts, c: DataFrame, config: Config, n: int = 50) -> DataFrame:
    """Functions nobody calls that are no entry, test or public interface: the n most complex."""
    called = facts.call_edges.select(F.col("callee_function").alias("function_id")).distinct()
    first = F.element_at(F.split(F.ltrim(F.coalesce("body", F.lit(""))), "\n"), 1)
    path = S.clean_path(F.col("path"))
    public = S.is_test_path(path, config.test_roots) | S.matches_any(path, config.public_api_paths) | F.col("name").isin("main", "init", "start", "run", "new") | F.col("name").startswith("test_") | F.col("name").endswith("_test") | first.rlike(r"^(pub[ (]|export |public |def __)") | path.endswith("lib.rs") | S.is_package_index(path)
    f = c.join(facts.functions.select("function_id", "body"), "function_id").join(called, "function_id", "left_anti").where(~public)
    return f.select("function_id", "file_id", "path", "name", "value").orderBy(F.desc("value"), "path", "function_id").limit(n)


def scores(facts: Facts, config: Config, c: DataFrame | None = None, cyclic: DataFrame | None = None) -> DataFrame:
    """One row: the six root-cause scores, quality_signal, score and overall grade. `c` is the complexity and `cyclic` the files on cycles, where known."""
    w = config.weights
    c = complexity(facts) if c is None else c
    cyclic = graph.cycle_members(file_edges(facts)) if cyclic is None else cyclic
    unstable = coupling(facts, config).select("cross_unstable_ratio")
    cycles = cyclic.agg(F.count("*").alias("cycle_count"))
    depth = facts.files.agg(F.coalesce(F.max(F.size(F.split("module", r"\."))), F.lit(0)).alias("depth"))
    dead = dead_functions(facts, c, config).agg(F.count("*").alias("dead"))
    double = duplicate_groups(c).agg(F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("double"))
    total = facts.functions.agg(F.count("*").alias("functions"))
    se, ce = size_entropy(facts.files).select(F.col("normalised").alias("se")), entropy(c.groupBy("value").agg(F.count("*").alias("n"))).select(F.col("normalised").alias("ce"))
    one = reduce(lambda a, b: a.crossJoin(b), [unstable, cycles, depth, gini(c, "value"), dead, double, total, se, ce])
    clamp = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    roots = one.select(
        S.round3(1 - F.col("cross_unstable_ratio")).alias("modularity"),
        S.round3(1 / (1 + F.col("cycle_count"))).alias("acyclicity"),
        S.round3(1 / (1 + F.greatest(F.lit(0), F.col("depth") - 4))).alias("depth"),
        S.round3(clamp(1 - F.col("gini"))).alias("equality"),
        S.round3(clamp(1 - S.ratio(F.col("dead") + F.col("double"), F.col("functions")))).alias("redundancy"),
        S.round3((F.col("se") + F.col("ce")) / 2).alias("structural_uniformity"),
    )
    names = ["modularity", "acyclicity", "depth", "equality", "redundancy", "structural_uniformity"]
    weights = [getattr(w, n) for n in names]
    mean = reduce(lambda a, b: a + b, [F.lit(x) * F.ln(F.greatest(F.col(n), F.lit(1e-4))) for n, x in zip(names, weights, strict=True)]) / max(sum(weights), 1e-4)
    signal = roots.withColumn("quality_signal", F.round(10000 * F.exp(mean)).cast("long"))
    return signal.withColumn("score", F.round(F.col("quality_signal") / 100).cast("long")).withColumn("overall_grade", S.grade(F.col("score") / 100))


def coverage_score(facts: Facts) -> DataFrame:
    """One row (coverage_score): 100 less the percentage of unresolved imports, 70 at most."""
    r = facts.imports.agg(F.count_if(F.col("resolution") == "unresolved").alias("u"), F.count("*").alias("n"))
    lost = F.when(F.col("n") == 0, F.lit(0)).otherwise(F.least(F.lit(70), F.round(F.col("u") * 100 / F.col("n")))).cast("long")
    return r.select((F.lit(100).cast("long") - lost).alias("coverage_score"))


def complexity_summary(c: DataFrame) -> DataFrame:
    """One row: functions, the greatest and mean value of `complexity`, and how many reach 10."""
    return c.agg(F.count("*").alias("functions"), F.coalesce(F.max("value"), F.lit(0)).alias("max_complexity"), F.coalesce(S.round3(F.avg("value")), F.lit(0.0)).alias("mean_complexity"), F.count_if(F.col("value") >= 10).alias("complex_functions"))


def complex_functions(c: DataFrame, n: int = 20) -> DataFrame:
    """The n functions of greatest value, 10 at least."""
    return c.where("value >= 10").select("function_id", "file_id", "path", "name", "value").orderBy(F.desc("value"), "path", "function_id").limit(n)


def violation_ratio(facts: Facts, found: DataFrame) -> DataFrame:
    """One row (violations, ratio): the listed violations over all imports."""
    return found.agg(F.count("*").alias("violations")).crossJoin(facts.imports.agg(F.count("*").alias("n"))).select("violations", S.ratio(F.col("violations"), F.col("n")).alias("ratio"))
