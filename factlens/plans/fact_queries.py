"""Registered queries of the metric operators over fact relations taken from the catalogue, each with its SQL.

Files are the latest rows of `files`. Imports are the module edges: a module stands for its file of least id, and one without
a file is not resolved. Functions are the blocks of the current texts (cut at blank lines) that declare one, calls the names
before a round bracket in them, types the lines that declare one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlens.functions import scalars as S
from factlens.operators import baseline, graph, rules, structure, whatif
from factlens.operators.facts import Facts, of
from factlens.plans import tools
from factlens.session import table
from factlens.sources import scan
from factlens.sources.config import Config, Forbidden, Layer, Limits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

DECLARED = r"\b(?:def|fn|func|function|fun)\s+([A-Za-z_]\w*)"
CALLED = r"\b([A-Za-z_]\w*)\("
TYPED = r"(?m)^[ \t]*(?:pub |public |export |abstract |final |sealed )*(?:class|struct|trait|interface|enum) +[A-Za-z_]\w*"
NO_CALLS = ("if", "for", "while", "switch", "match", "return", "catch", "sizeof", "len", "print")
#: The configuration of these queries: limits low enough to be met, two layers, one forbidden edge.
CONFIG = Config(
    limits=Limits(
        high_file_fan_in=8, high_file_fan_out=6, large_file_lines=400, max_function_complexity=3, max_file_lines=3000, max_function_lines=14, high_function_fan_in=2, high_function_fan_out=2, min_modularity=0.99, min_quality_signal=9900,
        low_call_resolution_ratio=0.99, max_upward_layer_violations=1, max_coupling_ratio=0.1,
    ),
    module_roots=["services"],
    layers=[Layer("core", "src/core", 0), Layer("outer", "src", 1), Layer("app", "app", 2)],
    forbidden=[Forbidden("src", "app", "no way back")],
    public_api_paths=["src/core"],
)


def query(name: str, sql: str | None = None):
    """Registers a query under a name, with its SQL over the fact relations."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = f"with recursive {FACTS}{sql}"
        return f

    return add


def files(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of every file."""
    path = F.regexp_replace(S.clean_path(F.col("path")), r"^(\./)+", "").alias("path")
    kept = ["language", "module", "lines", "bytes", "content_hash", "comment_lines"]
    last = table(spark, d, "files").where("file_id is not null").groupBy("file_id").agg(F.max_by(F.struct(path, *kept), "scanned_at").alias("r"))
    return last.select("file_id", "r.*")


def texts(spark: SparkSession, d: str, f: DataFrame) -> DataFrame:
    """(file_id, path, language, content) of the current texts, lines ended alike."""
    t = table(spark, d, "file_texts").groupBy("file_id").agg(F.max_by(F.struct("content"), "fetched_at").alias("r"))
    content = F.regexp_replace("r.content", "\r\n?", "\n")
    return t.where("r.content is not null").select("file_id", content.alias("content")).join(f.select("file_id", "path", "language"), "file_id")


def imports(spark: SparkSession, d: str, f: DataFrame) -> DataFrame:
    """The module edges as imports between the files that stand for the modules."""
    rep = f.where("module is not null and module <> ''").groupBy("module").agg(F.min("file_id").alias("file_id"))
    e = table(spark, d, "module_edges").where("from_module is not null and to_module is not null").select("from_module", "to_module").distinct()
    j = e.join(rep.select(F.col("module").alias("from_module"), F.col("file_id").alias("from_file")), "from_module").join(rep.select(F.col("module").alias("to_module"), F.col("file_id").alias("resolved_file")), "to_module", "left")
    t = F.col("to_module")
    resolution = F.when(F.col("resolved_file").isNotNull(), "local").when(t.startswith("lib"), "system").when(t.startswith("src"), "unresolved").otherwise("external")
    number = F.conv(F.substring(F.md5(F.concat("from_module", F.lit(">"), "to_module")), 1, 15), 16, 10).cast("long")
    return j.select(number.alias("import_id"), "from_file", t.alias("target"), F.lit("import").alias("kind"), resolution.alias("resolution"), "resolved_file", F.lit(None).cast("string").alias("alias"))


def functions(t: DataFrame) -> DataFrame:
    """The blocks of texts that declare a function."""
    b = t.select("file_id", F.posexplode(F.split("content", "\n\n")).alias("pos", "body")).withColumn("breaks", F.length("body") - F.length(F.replace("body", F.lit("\n"), F.lit(""))))
    before = F.coalesce(F.sum(F.col("breaks") + 2).over(Window.partitionBy("file_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    b = b.withColumn("start_line", (before + 1).cast("long")).withColumn("name", F.regexp_extract("body", DECLARED, 1)).where("name <> ''")
    return b.select((F.col("file_id") * 1000 + F.col("pos")).alias("function_id"), "file_id", "name", "start_line", (F.col("start_line") + F.col("breaks")).alias("end_line"), F.lit("unknown").alias("visibility"), "body")


def calls(f: DataFrame) -> DataFrame:
    """The names before a round bracket in the functions."""
    c = f.select("function_id", "file_id", "name", "start_line", F.posexplode(F.regexp_extract_all("body", F.lit(CALLED), F.lit(1))).alias("pos", "target"))
    c = c.where((F.col("target") != F.col("name")) & ~F.col("target").isin(*NO_CALLS))
    return c.select((F.col("function_id") * 1000 + F.col("pos")).alias("call_id"), "file_id", F.col("function_id").alias("caller_function"), "target", F.col("start_line").alias("line"))


def types(t: DataFrame) -> DataFrame:
    """The lines that declare a type."""
    x = t.select("file_id", F.posexplode(F.regexp_extract_all("content", F.lit(TYPED), F.lit(0))).alias("pos", "line"))
    abstract = F.col("line").rlike(r"\b(?:trait|interface|abstract)\b")
    return x.select((F.col("file_id") * 1000 + F.col("pos")).alias("type_id"), "file_id", F.regexp_extract("line", r"(\w+)$", 1).alias("name"), abstract.alias("is_abstract"), F.col("pos").cast("long").alias("line"), F.lit("unknown").alias("visibility"), F.array().cast("array<string>").alias("bases"))


def entry_points(f: DataFrame, g: DataFrame) -> DataFrame:
    """Functions in tests by path (test), files of tool folders (example), `render` and `emit` files (binary)."""
    test = g.join(f.where(S.is_test_path(F.col("path"))).select("file_id"), "file_id", "left_semi").select("file_id", F.lit("test").alias("kind"), F.col("name").alias("symbol"))
    example = f.where(F.col("path").startswith("tools/")).select("file_id", F.lit("example").alias("kind"), F.col("path").alias("symbol"))
    binary = f.where(F.col("path").contains("/emit/")).select("file_id", F.lit("binary").alias("kind"), F.lit("main").alias("symbol"))
    e = test.unionByName(example).unionByName(binary).distinct()
    return e.select(F.xxhash64("file_id", "kind", "symbol").alias("entry_id"), "file_id", "kind", "symbol")


def facts(spark: SparkSession, d: str) -> Facts:
    """All fact relations of the catalogue; each is a plan of its own, so a query pays for what it reads."""
    f = files(spark, d)
    t = texts(spark, d, f)
    g = functions(t)
    c = calls(g)
    resolved = structure.resolved_calls(c, g, f).select(F.col("call_id").alias("edge_id"), "call_id", "caller_function", "callee_function")
    return of(spark, files=f, imports=imports(spark, d, f), functions=g, calls=c, call_edges=resolved, types=types(t), entry_points=entry_points(f, g))


FACTS = r"""
fx as (select file_id, r.path, r.language, r.module, r.lines, r.bytes, r.content_hash, r.comment_lines from (
  select file_id, arg_max(struct_pack(path := regexp_replace(replace(path, '\', '/'), '^(\./)+', ''), language := language, module := module, lines := lines, bytes := bytes, content_hash := content_hash, comment_lines := comment_lines), scanned_at) as r
  from files where file_id is not null group by 1)),
tx as (select file_id, path, language, regexp_replace(r.c, '\r\n?', chr(10), 'g') as content from (select file_id, arg_max(struct_pack(c := content), fetched_at) as r from file_texts group by 1) join fx using (file_id) where r.c is not null),
rep as (select module, min(file_id) as file_id from fx where module is not null and module <> '' group by 1),
im as (select a.file_id as from_file, e.to_module as target, b.file_id as resolved_file, case when b.file_id is not null then 'local' when starts_with(to_module, 'lib') then 'system' when starts_with(to_module, 'src') then 'unresolved' else 'external' end as resolution, ('0x' || substr(md5(from_module || '>' || to_module), 1, 15))::bigint as import_id
  from (select distinct from_module, to_module from module_edges where from_module is not null and to_module is not null) e join rep a on a.module = e.from_module left join rep b on b.module = e.to_module),
fe as (select from_file as src, resolved_file as dst from im where resolved_file <> from_file),
bl as (select file_id, unnest(string_split(content, chr(10) || chr(10))) as body, unnest(range(len(string_split(content, chr(10) || chr(10))))) as pos from tx),
bs as (select *, length(body) - length(replace(body, chr(10), '')) as breaks from bl),
bp as (select *, 1 + coalesce(sum(breaks + 2) over (partition by file_id order by pos rows between unbounded preceding and 1 preceding), 0) as start_line from bs),
fn as (select file_id * 1000 + pos as function_id, file_id, regexp_extract(body, '\b(?:def|fn|func|function|fun)\s+([A-Za-z_]\w*)', 1) as name, start_line::bigint as start_line, (start_line + breaks)::bigint as end_line, body from bp where regexp_extract(body, '\b(?:def|fn|func|function|fun)\s+([A-Za-z_]\w*)', 1) <> ''),
cx as (select function_id, file_id, name, start_line, unnest(regexp_extract_all(body, '\b([A-Za-z_]\w*)\(', 1)) as target, unnest(range(len(regexp_extract_all(body, '\b([A-Za-z_]\w*)\(', 1)))) as pos from fn),
ca as (select function_id * 1000 + pos as call_id, file_id, function_id as caller_function, target, start_line as line from cx where target <> name and target not in ('if', 'for', 'while', 'switch', 'match', 'return', 'catch', 'sizeof', 'len', 'print')),
fq as (select fn.name as target, fn.file_id, string_split(path, '/')[1] as top, function_id from fn join fx using (file_id)),
c1 as (select target, file_id, min(function_id) as g from fq group by 1, 2 having count(*) = 1), c2 as (select target, top, min(function_id) as g from fq group by 1, 2 having count(*) = 1), c3 as (select target, min(function_id) as g from fq group by 1 having count(*) = 1),
ce as (select call_id, caller_function, coalesce(c1.g, c2.g, c3.g) as callee_function from ca join fx using (file_id) left join c1 on c1.target = ca.target and c1.file_id = ca.file_id left join c2 on c2.target = ca.target and c2.top = string_split(fx.path, '/')[1] left join c3 on c3.target = ca.target where coalesce(c1.g, c2.g, c3.g) is not null),
ty as (select file_id, regexp_matches(line, '\b(?:trait|interface|abstract)\b') as is_abstract, line from (select file_id, unnest(regexp_extract_all(content, '(?m)^[ \t]*(?:pub |public |export |abstract |final |sealed )*(?:class|struct|trait|interface|enum) +[A-Za-z_]\w*')) as line from tx)),
pa as (select *, string_split(path, '/') as a, regexp_matches(path, '^tests?/|/tests?/|_tests?\.') as is_test, regexp_matches(path, '(mod\.rs|__init__\.py|index\.(ts|tsx|js))$') as is_index from fx),
gr as (select file_id, path, language, module, is_test, is_index, case when len(a) >= 3 and a[1] in ('crates', 'packages', 'apps') then a[1] || '/' || a[2] when language = 'python' and len(a) >= 2 and a[1] = 'src' then a[2]
  when language in ('java', 'kotlin') and list_contains(a, 'src') and list_position(list_transform(a, lambda x: x in ('java', 'kotlin')), true) > 0 and a[list_position(list_transform(a, lambda x: x in ('java', 'kotlin')), true) + 1] is not null then a[list_position(list_transform(a, lambda x: x in ('java', 'kotlin')), true) + 1]
  when path = 'services' or starts_with(path, 'services/') then 'services/' || a[2] when path = 'src/core' or starts_with(path, 'src/core/') then 'core' when path = 'src' or starts_with(path, 'src/') then 'outer' when path = 'app' or starts_with(path, 'app/') then 'app' else regexp_split_to_array(module, '[./]')[1] end as grp from pa),
ge as (select src, dst, x.grp as fg, y.grp as tg from fe join gr x on x.file_id = src join gr y on y.file_id = dst),
ms as (select grp as module, (select count(*) from ge where tg = m.grp and fg <> tg) as fan_in, (select count(*) from ge where fg = m.grp and fg <> tg) as fan_out from (select distinct grp from gr) m),
st as (select module, fan_in, fan_out, case when fan_in + fan_out = 0 then 0.0 else round(fan_out::double / (fan_in + fan_out) * 1000) / 1000 end as instability from ms),
fo as (select module from st where fan_in >= 2 and (fan_out = 0 or instability <= 0.15)),
dg as (select file_id, path, module, coalesce(i.n, 0) as fan_in, coalesce(o.n, 0) as fan_out from fx left join (select dst, count(*) as n from fe group by 1) i on i.dst = file_id left join (select src, count(*) as n from fe group by 1) o on o.src = file_id where i.n is not null or o.n is not null),
du as (select *, round(fan_out::double / (fan_in + fan_out) * 1000) / 1000 as instability from dg),
ep as (select fn.file_id, 'test' as kind, name as symbol from fn join pa on pa.file_id = fn.file_id where is_test union select file_id, 'example', path from fx where starts_with(path, 'tools/') union select file_id, 'binary', 'main' from fx where contains(path, '/emit/'))
"""
RATIO = "case when {1} = 0 then 0.0 else round({0}::double / {1} * 1000) / 1000 end"
ENTROPY = "select case when count(*) > 1 then round((log2(sum(n)) - sum(n * log2(n)) / sum(n)) * 1000) / 1000 else 0.0 end as bits, case when count(*) > 1 then round((log2(sum(n)) - sum(n * log2(n)) / sum(n)) / log2(count(*)) * 1000) / 1000 else 0.0 end as normalised, count(*) as groups from g"
CLOSED = ", cl(src, dst) as (select distinct src, dst from fe union select cl.src, fe.dst from cl join fe on fe.src = cl.dst)"


def ratio(part: str, whole: str) -> str:
    """The SQL of a ratio to three decimals."""
    return RATIO.format(part, whole)


def metric(name: str, sql: str, f: Callable[[Facts], DataFrame], keep: bool = False) -> None:
    """Registers a metric of the fact relations; `keep` writes the relations once for metrics that read them often."""
    query(name, sql)(lambda spark, d: f(baseline.shared(facts(spark, d)) if keep else facts(spark, d)))


# --- imports and modules

metric("graph_metrics", CLOSED + " select (select count(*) from im) as edge_count, (select count(resolved_file) from im) as resolved_edge_count, (select max(n) from (select count(*) as n from fe group by dst)) as max_fan_in, (select max(n) from (select count(*) as n from fe group by src)) as max_fan_out, (select count(*) from cl where src = dst) as cycle_count", structure.graph_metrics)
metric("resolution_breakdown", " select " + ", ".join(f"count(*) filter (resolution = '{r}') as {r}" for r in ("local", "external", "system", "unresolved")) + " from im", structure.resolution_breakdown)
metric("coverage_score", " select 100 - least(70, round(count(*) filter (resolution = 'unresolved') * 100.0 / count(*)))::bigint as coverage_score from im", structure.coverage_score)
metric("hotspot_files", " select file_id, path, module, fan_in, fan_out from dg order by fan_in + fan_out desc, fan_in desc, path limit 10", structure.hotspots)
metric("module_group_stability", " select * from st", lambda x: structure.module_stability(x, CONFIG))
metric("foundation_files", " select distinct file_id from gr left join (select dst, count(*) as n from fe group by 1) f on f.dst = file_id where grp in (select module from fo) or coalesce(n, 0) >= 5 or is_index", lambda x: structure.foundation_files(x, CONFIG))
metric(
    "coupling_metrics",
    ", c as (select count(*) as local_edges, count(*) filter (fg <> tg) as cross_module_edges, count(*) filter (fg <> tg and tg not in (select module from fo)) as cross_unstable_edges from ge) "
    f"select *, {ratio('cross_module_edges', 'local_edges')} as cross_module_ratio, {ratio('cross_unstable_edges', 'local_edges')} as cross_unstable_ratio from c",
    lambda x: structure.coupling(x, CONFIG),
)
metric("module_pair_entropy", ", g as (select count(*) as n from ge where fg <> tg and tg not in (select module from fo) group by fg, tg) " + ENTROPY, lambda x: structure.coupling_entropy(x, CONFIG))
metric(
    "cohesion_metrics",
    ", k as (select file_id, grp from gr where not is_test), ed as (select src, dst from fe union select a.file_id, b.file_id from ce join fn a on a.function_id = caller_function join fn b on b.function_id = callee_function where a.file_id <> b.file_id), "
    "pr as (select distinct least(src, dst) as a, greatest(src, dst) as b from ed), inn as (select x.grp, count(*) as pairs from pr join k x on x.file_id = a join k y on y.file_id = b where x.grp = y.grp group by 1), "
    "sz as (select grp, count(*) as files from k where grp is not null group by 1 having count(*) >= 2) select round(avg(least(1.0::double, coalesce(pairs, 0)::double / (files - 1))) * 1000) / 1000 as average_cohesion, count(*) as cohesive_modules from sz left join inn using (grp)",
    lambda x: structure.cohesion(x.replaced(files=x.files.where("module is not null")), CONFIG),
)
metric("god_files", " select d.file_id, d.path, d.module, fan_in, fan_out, instability from du d join pa using (file_id) where fan_out >= 6 and not is_test and not is_index order by fan_out desc, d.path limit 10", lambda x: structure.god_files(x, CONFIG))
metric("unstable_hotspots", " select file_id, path, module, fan_in, fan_out, instability from du where fan_in >= 8 and instability >= 0.15 order by fan_in desc, fan_out desc, path limit 10", lambda x: structure.unstable_hotspots(x, CONFIG))
metric("unstable_files", " select file_id, path, module, fan_in, fan_out, instability from du order by instability desc, fan_out desc, path limit 10", structure.unstable_files)
metric("module_matrix", " select fg as from_module, tg as to_module, count(*) as edges from ge where fg <> tg group by 1, 2 order by 3 desc, 1, 2 limit 10", lambda x: structure.dsm(x, CONFIG)[1])
metric("module_matrix_size", " select (select count(distinct grp) from gr) as modules, (select count(*) from ge where fg <> tg) as edges", lambda x: structure.dsm(x, CONFIG)[0])
metric("import_edges", " select import_id, x.path as from_path, coalesce(y.path, target) as to_path, 'import' as kind, resolution from im join fx x on x.file_id = from_file left join fx y on y.file_id = resolved_file order by import_id limit 1000", tools.edges)

# --- cycles, levels, reach

REACHED = ", rs(node, cnt) as (select src, count(*) filter (src <> dst) from cl group by 1), every as (select src as node from fe union select dst from fe), rc as (select node, coalesce(cnt, 0) as reached from every left join rs using (node))"
FREE = ", found as (select distinct file_id from gr left join (select dst, count(*) as n from fe group by 1) f on f.dst = file_id where grp in (select module from fo) or coalesce(n, 0) >= 5 or is_index)"
metric("cycle_files", CLOSED + " select src as file_id, path from cl join fx on file_id = src where src = dst order by 1 limit 20", lambda x: tools.cycles(x))
metric("blast_radius_max", CLOSED + REACHED + FREE + " select (select max(reached) from rc) as max_blast_radius, (select arg_min(node, (-reached, node)) from rc) as max_blast_radius_file, (select max(reached) from rc where node not in (select file_id from found)) as max_non_foundation, (select arg_min(node, (-reached, node)) from rc where node not in (select file_id from found)) as max_non_foundation_file", lambda x: structure.blast_radius(x, CONFIG))
metric("blast_radius_file", ", r(node, depth) as (select (select arg_max(dst, (n, -dst)) from (select dst, count(*) as n from fe group by 1)), 0 union select fe.src, r.depth + 1 from r join fe on fe.dst = r.node where r.depth < 60) select path, min(depth)::int as depth from r join fx on file_id = node group by 1 having min(depth) > 0", lambda x: tools.blast_radius(x, str(structure.file_edges(x).groupBy("dst").count().orderBy(F.desc("count"), "dst").first()[0])))
metric("attack_surface", ", every as (select src as node from fe union select dst from fe), r(node) as (select distinct file_id from ep where file_id in (select node from every) union select dst from r join fe on src = node) " f"select (select count(*) from r) as reachable, (select count(*) from every) as total, {ratio('(select count(*) from r)', '(select count(*) from every)')} as ratio", structure.attack_surface)


def peeled_sql(rounds: int) -> str:
    """Rounds of peeling nodes without open predecessors: each gives its level to those behind it."""
    parts = [", every as (select file_id as node from fx union select src from fe union select dst from fe), e0 as (select distinct src, dst from fe), l0 as (select node, 0 as level from every), p0 as (select node from every where false)"]
    for i in range(rounds):
        parts.append(
            f"f{i} as materialized (select l.node, level from l{i} l where l.node not in (select dst from e{i}) and l.node not in (select node from p{i})), "
            f"l{i + 1} as materialized (select l.node, greatest(level, coalesce(up, level)) as level from l{i} l left join (select dst as node, max(f.level) + 1 as up from e{i} join f{i} f on f.node = src group by 1) u on u.node = l.node), "
            f"e{i + 1} as materialized (select * from e{i} where src not in (select node from f{i})), p{i + 1} as materialized (select node from p{i} union select node from f{i})"
        )
    return ", ".join(parts)


#: Rounds of peeling after which the largest test table has none left; the last round's check is in the tests.
ROUNDS = 14
LEVELLED = peeled_sql(ROUNDS)


def file_levels(x: Facts) -> DataFrame:
    """Levels of all files."""
    return graph.levels(structure.file_edges(x), x.files.select(F.col("file_id").alias("node")))


metric("file_levels", LEVELLED + f" select node, level::int as level from l{ROUNDS}", file_levels)
VIOLATIONS = CLOSED + LEVELLED + f", v as (select src as from_file_id, x.path as from_path, a.level as from_level, dst as to_file_id, y.path as to_path, b.level as to_level, case when a.level < b.level then 'upward_level' when exists (select 1 from cl where cl.src = fe.dst and cl.dst = fe.src) then 'cycle_edge' end as reason from fe join fx x on x.file_id = src join fx y on y.file_id = dst join l{ROUNDS} a on a.node = src join l{ROUNDS} b on b.node = dst), w as (select * from v where reason is not null order by abs(from_level - to_level) desc, from_path, to_path limit 20)"
metric("upward_violations", VIOLATIONS + " select * from w", lambda x: structure.violations(x, file_levels(x)))
metric("violation_ratio", VIOLATIONS + f" select count(*) as violations, {ratio('count(*)', '(select count(*) from im)')} as ratio from w", lambda x: structure.violation_ratio(x, structure.violations(x, file_levels(x))))


# --- functions, calls, types

metric("call_metrics", f" select (select count(*) from ca) as total_calls, (select count(*) from ce) as resolved_edges, {ratio('(select count(*) from ce)', '(select count(*) from ca)')} as resolution_ratio, (select coalesce(max(n), 0) from (select count(*) as n from ce group by callee_function)) as max_function_fan_in, (select coalesce(max(n), 0) from (select count(*) as n from ce group by caller_function)) as max_function_fan_out", structure.call_metrics)
metric("resolved_calls", " select * from ce", lambda x: x.call_edges.select("call_id", "caller_function", "callee_function"))
TOP = ", {0} as (select f.function_id, f.file_id, path, name, count(*) as calls from ce join fn f on f.function_id = {1} join fx on fx.file_id = f.file_id group by 1, 2, 3, 4 order by calls desc, path, name, f.function_id limit 10)"
metric("top_called", TOP.format("t", "callee_function") + " select * from t", lambda x: structure.top_functions(x))
metric("top_calling", TOP.format("t", "caller_function") + " select * from t", lambda x: structure.top_functions(x, False))
metric("size_metrics", f", f as (select max(lines) as max_file_lines, count(*) filter (lines >= 500) as large_files, sum(comment_lines) as c, sum(lines) as l from fx), g as (select max(end_line - start_line + 1) as max_function_lines, count(*) filter (end_line - start_line + 1 >= 80) as long_functions from fn) select max_file_lines, large_files, max_function_lines, long_functions, {ratio('c', 'l')} as comment_ratio from f, g", structure.size_metrics)
metric("entry_counts", " select " + ", ".join(f"count(*) filter (kind = '{k}') as {k}" for k in ("binary", "example", "test")) + " from ep", structure.entry_counts)
TYPES = (
    ", tc as (select grp as module, count(*) filter (is_abstract) as abstract_count, count(*) as total_types from ty join gr using (file_id) where grp is not null group by 1), "
    f"dd as (select st.module, {ratio('abstract_count', 'total_types')} as a, case when fan_in + fan_out = 0 then 0.5 else instability end as i, abstract_count, total_types, fan_in, fan_out, st.module in (select module from fo) as base from st join tc on tc.module = st.module), "
    "ds as (select module, a as abstractness, i as instability, round(abs(a + i - 1) * 1000) / 1000 as distance, abstract_count, total_types, fan_in, fan_out, base or i <= 0.3 as is_foundation from dd order by distance desc, module limit 20)"
)
metric("type_distance", TYPES + " select * from ds", lambda x: structure.type_distance(x, CONFIG))
metric("average_distance", TYPES + " select coalesce(round(avg(distance) * 1000) / 1000, 0.0) as average_distance from ds where not is_foundation", lambda x: structure.average_distance(structure.type_distance(x, CONFIG)))
metric(
    "enclosing_functions",
    ", li as (select file_id, unnest([5, 12, 30, 61]) as line from tx) select file_id * 100 + line as line_id, arg_min(function_id, (end_line - start_line, function_id)) as function_id from li join fn using (file_id) where line between start_line and end_line group by 1",
    lambda x: structure.enclosing(x.functions.select("file_id").distinct().select("file_id", F.explode(F.array(*[F.lit(n) for n in (5, 12, 30, 61)])).alias("line")).select((F.col("file_id") * 100 + F.col("line")).alias("line_id"), "file_id", "line"), x.functions),
)

# --- complexity and duplicates

BRANCHES = ", ".join(f"'{w}'" for w in S.BRANCH_WORDS)
KEYS = ", ".join(f"'{w}'" for w in S.KEYWORDS)
MARKS = ", ".join(f"'{w}'" for w in S.SHAPE_MARKS)
HIDDEN = r"""//[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/|/\*[\s\S]*|"(?:[^"\\]|\\[\s\S])*"|"[\s\S]*|''(?:[^''\\]|\\[\s\S])*''|''[\s\S]*|`(?:[^`\\]|\\[\s\S])*`|`[\s\S]*"""
CODE = (
    f", tk as (select f.function_id, f.file_id, path, language, name, body, regexp_extract_all(lower(regexp_replace(body, '{HIDDEN}', ' ', 'g')), '[a-z0-9_]+|[{{}}()\\[\\]?:]') as t from fn f join fx on fx.file_id = f.file_id), "
    f"cc as (select function_id, file_id, path, language, name, body, (1 + len(list_filter(t, lambda w: w in ({BRANCHES}))) + len(regexp_extract_all(body, '&&|\\|\\||\\?')) + case when language in ('python', 'ruby', 'swift') then len(regexp_extract_all(body, ' and ')) + len(regexp_extract_all(body, ' or ')) else 0 end)::int as value, "
    f"case when len(t) >= 12 then substr(sha256(array_to_string(list_transform(t, lambda w: case when regexp_full_match(w, '[0-9]+') then '0' when w in ({KEYS}) then w else 'id' end), ' ')), 1, 16) end as fingerprint, "
    f"case when len(t) >= 20 and len(list_filter(t, lambda w: w in ({KEYS}, {MARKS}))) >= 4 then 'shape:' || substr(sha256(array_to_string(list_filter(t, lambda w: w in ({KEYS}, {MARKS})), ' ')), 1, 16) end as shape from tk)"
)
GROUPS = (
    CODE + ", dg1 as (select case when min(name) = max(name) then min(name) else 'similar_body' end as name, 0 as kind, count(*) as size, fingerprint as key from cc where fingerprint is not null group by fingerprint having count(*) > 1 union all select 'name:' || name, 1, count(*), name from cc group by name having count(*) > 1), "
    "dgs as (select * from dg1 order by size desc, name, kind, key limit 20)"
)
metric("function_complexity", CODE + " select function_id, path, name, value, fingerprint, shape from cc", lambda x: structure.complexity(x).select("function_id", "path", "name", "value", "fingerprint", "shape"))
metric("complexity_summary", CODE + " select count(*) as functions, max(value) as max_complexity, round(avg(value) * 1000) / 1000 as mean_complexity, count(*) filter (value >= 10) as complex_functions from cc", lambda x: structure.complexity_summary(structure.complexity(x)))
metric("complex_functions", CODE + " select function_id, file_id, path, name, value from cc where value >= 10 order by value desc, path, function_id limit 20", lambda x: structure.complex_functions(structure.complexity(x)))
metric("complexity_entropy", CODE + ", g as (select count(*) as n from cc group by value) " + ENTROPY, lambda x: structure.entropy(structure.complexity(x).groupBy("value").agg(F.count("*").alias("n"))))
metric("duplicate_functions", GROUPS + " select * from dgs", lambda x: structure.duplicate_groups(structure.complexity(x)))
metric("shape_groups", CODE + " select shape, count(*) as size from cc where shape is not null group by 1 having count(*) > 1 order by size desc, shape limit 20", lambda x: structure.shape_groups(structure.complexity(x)))
DEAD = CODE + (
    r", dead as (select function_id, cc.file_id, cc.path, name, value from cc join pa on pa.file_id = cc.file_id where function_id not in (select callee_function from ce) and not (is_test or regexp_matches(cc.path, '^src/core(/|$)') or name in ('main', 'init', 'start', 'run', 'new') or starts_with(name, 'test_') or ends_with(name, '_test') "
    r"or regexp_matches(string_split(ltrim(body, ' '), chr(10))[1], '^(pub[ (]|export |public |def __)') or ends_with(cc.path, 'lib.rs') or is_index) order by value desc, cc.path, function_id limit 50)"
)
metric("dead_functions", DEAD + " select * from dead", lambda x: structure.dead_functions(x, structure.complexity(x), CONFIG))

# --- scores, rules, test gaps

SCORES = GROUPS + DEAD.removeprefix(CODE) + CLOSED + (
    f", k as (select {ratio('count(*) filter (fg <> tg and tg not in (select module from fo))', 'count(*)')} as unstable, {ratio('count(*) filter (fg <> tg)', 'count(*)')} as crossed from ge), "
    "gv as (select value::double as x, row_number() over (order by value) as r, count(*) over () as n from cc), gi as (select round((2 * sum(r * x) / (any_value(n) * sum(x)) - (any_value(n) + 1.0) / any_value(n)) * 1000) / 1000 as gini from gv), "
    "e1 as (select count(*) as n from fx where lines >= 0 group by case when lines = 0 then 0 else floor(log2(lines)) + 1 end), e2 as (select count(*) as n from cc group by value), "
    "en as (select (select round((log2(sum(n)) - sum(n * log2(n)) / sum(n)) / log2(count(*)) * 1000) / 1000 from e1) as se, (select round((log2(sum(n)) - sum(n * log2(n)) / sum(n)) / log2(count(*)) * 1000) / 1000 from e2) as cce), "
    f"rr as (select {ratio('((select count(*) from dead) + (select sum(size - 1) from dgs))', '(select count(*) from fn)')} as lost), "
    "ro as (select round((1 - unstable) * 1000) / 1000 as modularity, round(1.0 / (1 + (select count(*) from cl where src = dst)) * 1000) / 1000 as acyclicity, round(1.0 / (1 + greatest(0, (select max(len(string_split(module, '.'))) from fx) - 4)) * 1000) / 1000 as depth, round(least(1.0, greatest(0.0, 1 - gini)) * 1000) / 1000 as equality, round(least(1.0, greatest(0.0, 1 - lost)) * 1000) / 1000 as redundancy, round((se + cce) / 2 * 1000) / 1000 as structural_uniformity from k, gi, en, rr), "
    "q as (select *, round(10000 * exp((ln(greatest(modularity, 0.0001)) + ln(greatest(acyclicity, 0.0001)) + ln(greatest(depth, 0.0001)) + ln(greatest(equality, 0.0001)) + ln(greatest(redundancy, 0.0001))) / 5))::bigint as quality_signal from ro), "
    "sc as (select *, round(quality_signal / 100.0)::bigint as score from q), sg as (select *, case when score / 100.0 >= 0.9 then 'A' when score / 100.0 >= 0.8 then 'B' when score / 100.0 >= 0.7 then 'C' when score / 100.0 >= 0.5 then 'D' else 'F' end as overall_grade from sc)"
)
metric("health_scores", SCORES + " select * from sg", lambda x: structure.scores(x, CONFIG), keep=True)

LAYERED = "case when regexp_matches({0}, '^src/core(/|$)') then 0 when regexp_matches({0}, '^src(/|$)') then 1 when regexp_matches({0}, '^app(/|$)') then 2 end"
NAMED = "['core', 'outer', 'app'][{0} + 1]"
FINDINGS = SCORES + TOP.format("tin", "callee_function") + TOP.format("tout", "caller_function") + (
    ", en2 as (select import_id, from_file, x.path as fp, y.path as tp, x.module as fm, y.module as tm, x.is_test as ft, y.is_test as tt, " + LAYERED.format("x.path") + " as la, " + LAYERED.format("y.path") + " as lb from im join pa x on x.file_id = from_file join pa y on y.file_id = resolved_file where resolved_file <> from_file), "
    "up as (select * from en2 where la < lb), "
    "fi as (select 'error' as severity, 'min_quality_signal' as code, '.' as path, printf('quality signal %d below minimum 9900', quality_signal) as message from sg where quality_signal < 9900 "
    "union all select 'error', 'min_modularity', '.', printf('modularity %.3f below minimum 0.990', modularity) from sg where modularity < 0.99 "
    "union all select 'error', 'max_cycles', '.', printf('%d cycle participants exceeds max 0', n) from (select count(*) as n from cl where src = dst) where n > 0 "
    "union all select 'warning', 'max_coupling', '.', printf('cross-module ratio %.3f exceeds max 0.100', crossed) from k where crossed > 0.1 "
    "union all select * from (select 'warning', 'max_function_complexity', path, printf('%s complexity %d exceeds max 3', name, value) from cc where value > 3 order by function_id limit 5) "
    "union all select * from (select 'error', 'max_file_lines', path, printf('%d lines exceeds max 3000', lines) from fx where lines > 3000 order by file_id limit 20) "
    "union all select * from (select 'error', 'max_function_lines', path, printf('%s has %d lines exceeding max 14', name, end_line - start_line + 1) from fn join fx using (file_id) where end_line - start_line + 1 > 14 order by function_id limit 5) "
    "union all select 'warning', 'high_fan_in', path, printf('%d incoming dependency edges', fan_in) from (select * from dg order by fan_in + fan_out desc, fan_in desc, path limit 10) where fan_in >= 8 "
    "union all select * from (select 'warning', 'no_god_files', d.path, printf('%d outgoing dependency edges', fan_out) from du d join pa using (file_id) where fan_out >= 6 and not is_test and not is_index order by fan_out desc, d.path limit 10) "
    "union all select 'warning', 'production_depends_on_test', fp, 'depends on test path ' || tp from en2 where not ft and tt "
    "union all select * from (select 'info', 'large_file', path, printf('%d lines', lines) from fx where lines >= 400 order by lines desc, path limit 20) "
    "union all select 'info', 'large_file_summary', '.', printf('%d additional large files', n) from (select count(*) - 20 as n from fx where lines >= 400) where n > 0 "
    "union all select 'info', 'low_call_resolution', '.', printf('%d of %d calls resolved (%.3f)', b, a, b::double / a) from (select (select count(*) from ca) as a, (select count(*) from ce) as b) where a >= 100 and b::double / a < 0.99 "
    "union all select * from (select 'info', 'high_function_fan_in', path, printf('%s has %d resolved incoming calls', name, calls) from tin where calls >= 2 order by calls desc, path, name limit 5) "
    "union all select * from (select 'info', 'high_function_fan_out', path, printf('%s has %d resolved outgoing calls', name, calls) from tout where calls >= 2 order by calls desc, path, name limit 5) "
    "union all select 'warning', 'forbidden_module_edge', '.', printf('src -> app has %d dependency edges: no way back', n) from (select count(*) as n from en2 where regexp_split_to_array(fm, '[./]')[1] = 'src' and regexp_split_to_array(tm, '[./]')[1] = 'app') where n > 0 "
    "union all select 'error', 'max_upward_layer_violations', '.', printf('%d upward layer violations exceeds max 1', n) from (select count(*) as n from up) where n > 1 "
    "union all select 'warning', 'layer_order', fp, printf('%s depends upward on %s through %s', " + NAMED.format("la") + ", " + NAMED.format("lb") + ", tp) from up)"
)
metric("rule_findings", FINDINGS + " select * from fi", lambda x: rules.findings(x, CONFIG), keep=True)
metric("rule_counts", FINDINGS + " select code as rule_id, count(*) as count from fi group by 1", lambda x: rules.rule_counts(rules.findings(x, CONFIG)), keep=True)
query("structural_score", FINDINGS + " select greatest(0, 100 - least(80, 20 * (select count(*) from cl where src = dst)) - least(40, 4 * count(*) filter (severity = 'warning') + 10 * count(*) filter (severity = 'error')))::bigint as structural_score, case when count(*) filter (severity = 'error') > 0 then 1 else 0 end::bigint as exit_code from fi")(
    lambda spark, d: _score_row(spark, baseline.shared(facts(spark, d)))
)


def _score_row(spark: SparkSession, x: Facts) -> DataFrame:
    found = rules.findings(x, CONFIG)
    cycles = graph.cycle_members(structure.file_edges(x)).count()
    return spark.createDataFrame([(rules.structural_score(found, cycles), rules.check_exit(found))], "structural_score long, exit_code long")


GAPS = (
    r", pc as (select f.file_id, f.path, case language when 'java' then 'junit' when 'csharp' then 'dotnet' else language end as framework, a[-1] as file, regexp_replace(a[-1], '(.)\.[^.]*$', '\1') as stem, regexp_extract(a[-1], '.\.([^.]*)$', 1) as ext, regexp_replace(f.path, '/?[^/]*$', '') as parent from pa f where not is_test and file_id in (select file_id from fn)), "
    r"px as (select file_id, path, framework, list_sort(list_distinct(list_concat(case when stem <> '' and ext <> '' then ['tests/' || stem || '_test.' || ext, 'tests/test_' || stem || '.' || ext, regexp_replace(parent || '/' || stem || '_test.' || ext, '^/+', ''), regexp_replace(parent || '/' || stem || '.test.' || ext, '^/+', '')] else [] end, "
    r"case when starts_with(path, 'src/') then ['tests/' || substr(path, 5)] else [] end, case framework when 'rust' then ['tests/' || stem || '.rs', 'src/' || stem || '/tests.rs'] when 'python' then ['tests/test_' || stem || '.py'] when 'typescript' then [regexp_replace(parent || '/' || stem || '.spec.' || ext, '^/+', ''), regexp_replace(parent || '/' || stem || '.test.' || ext, '^/+', '')] else [] end))) as exp from pc), "
    "gp as (select * from px where not list_has_any(exp, (select list(distinct path) from pa where is_test)))"
)
metric("test_gaps", GAPS + " select file_id, path, framework, array_to_string(exp, '|') as expected_tests from gp", lambda x: structure.test_gaps(x, CONFIG).withColumn("expected_tests", F.array_join("expected_tests", "|")))
metric("test_gap_candidates", GAPS + " select file_id, path from gp order by path limit 100", lambda x: structure.test_gaps(x, CONFIG).orderBy("path").limit(100).select("file_id", "path"))

ACTIONS = "case code " + " ".join(f"when '{k}' then '{v}'" for k, v in rules.ACTIONS.items()) + f" else '{rules.DEFAULT_ACTION}' end"
metric(
    "remediation_counts",
    FINDINGS + f" select code, {ACTIONS} as action, count(*) as n from fi where code in ('max_cycles', 'min_quality_signal', 'min_modularity', 'max_coupling', 'max_function_complexity', 'max_function_lines', 'high_fan_in') group by 1, 2",
    lambda x: rules.remediations(rules.findings(x, CONFIG), structure.test_gaps(x, CONFIG)).where(F.col("code").isin("max_cycles", "min_quality_signal", "min_modularity", "max_coupling", "max_function_complexity", "max_function_lines", "high_fan_in")).groupBy("code", "action").agg(F.count("*").alias("n")),
    keep=True,
)

# --- baselines

NOW = 1733011200
PM = "round({0} * 1000)::bigint"
HEALTH = FINDINGS + GAPS + (
    ", hs as (select max(lines) as max_file_lines, count(*) filter (lines >= 500) as large_files from fx), hf as (select max(end_line - start_line + 1) as max_function_lines, count(*) filter (end_line - start_line + 1 >= 80) as long_functions from fn), "
    "b1 as (select round((log2(sum(n)) - sum(n * log2(n)) / sum(n)) * 1000) / 1000 as fb from e1), b2 as (select round((log2(sum(n)) - sum(n * log2(n)) / sum(n)) * 1000) / 1000 as cb from e2), "
    "hl as (select score, quality_signal, 100 - least(70, round((select count(*) filter (resolution = 'unresolved') * 100.0 / count(*) from im)))::bigint as coverage_score, (select greatest(0, 100 - least(80, 20 * (select count(*) from cl where src = dst)) - least(40, 4 * count(*) filter (severity = 'warning') + 10 * count(*) filter (severity = 'error')))::bigint from fi) as structural_score, "
    + ", ".join(f"{PM.format(n)} as {n}_per_1000" for n in baseline.ROOTS[:5])
    + ", (select count(*) from fx) as files, (select count(*) from fn) as functions, (select count(*) from im) as imports, (select count(*) from ca) as calls, (select count(*) from ce) as call_edges, "
    + ", ".join(f"(select count(*) from im where resolution = '{r}') as {r}_imports" for r in ("local", "external", "system", "unresolved"))
    + ", (select count(*) from ge where fg <> tg) as cross_module_edges, " + PM.format("crossed") + " as cross_module_ratio_per_1000, " + PM.format(ratio("(select count(*) from ce)", "(select count(*) from ca)")) + " as call_resolution_ratio_per_1000, "
    "(select max(n) from (select count(*) as n from ce group by callee_function)) as max_function_fan_in, (select max(n) from (select count(*) as n from ce group by caller_function)) as max_function_fan_out, max_file_lines, max_function_lines, (select max(value) from cc)::bigint as max_function_complexity, (select round(round(avg(value) * 1000) / 1000 * 1000)::bigint from cc) as average_function_complexity_per_1000, "
    + PM.format("gini") + " as complexity_gini_per_1000, " + PM.format("(1 - redundancy)") + " as redundancy_ratio_per_1000, large_files, long_functions, (select count(*) from pc) as production_files, (select count(*) from pa where is_test) as test_files, (select count(*) from gp) as files_without_nearby_tests, (select count(*) from ge where fg <> tg) as module_edges, 0::bigint as commits_sampled, "
    + PM.format("se") + " as file_size_entropy_per_1000, " + PM.format("fb") + " as file_size_entropy_bits_per_1000, " + PM.format("cce") + " as complexity_entropy_per_1000, " + PM.format("cb") + " as complexity_entropy_bits_per_1000, " + PM.format("structural_uniformity") + " as structural_uniformity_per_1000, overall_grade as grade_overall, "
    + ", ".join(f"case when {n} >= 0.9 then 'A' when {n} >= 0.8 then 'B' when {n} >= 0.7 then 'C' when {n} >= 0.5 then 'D' else 'F' end as grade_{n}" for n in baseline.ROOTS)
    + " from sg, k, gi, en, hs, hf, b1, b2)"
)
metric("health_table", HEALTH + " select * from hl", lambda x: baseline.health(x, CONFIG, rules.findings(x, CONFIG)), keep=True)
metric("arch_cycles_table", CLOSED + " select row_number() over (order by src) - 1 as cycle_id, path as module, 1::bigint as scc_size from cl join fx on file_id = src where src = dst order by src limit 20", baseline.file_cycles)


def saved_store(spark: SparkSession, d: str):
    """A store with the baseline of the catalogue, two commit relations among its facts."""
    from factlens.plans.core_queries import commit_files, commits
    from factlens.session import shared_dir
    from factlens.sources.store import Store

    x = facts(spark, d).replaced(commits=commits(spark, d), commit_files=commit_files(spark, d))
    store = Store(spark, f"{shared_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}")
    made = baseline.tables(x, CONFIG, NOW, "s1")
    trend = {n: made.pop(n) for n in list(made) if n.startswith("trend_")}
    store.save(made, "s1", NOW, manifest={"snapshot_id": "s1"}, trend=trend)
    return store


SAVED = (
    FINDINGS
    + ", lc as (select l_orderkey::varchar as c, l_partkey::varchar as path from lineitem group by 1, 2), fcc as (select path, count(*) as commits from lc group by 1), "
    "n as (select 'files' as \"table\", count(*) as rows, 7 as columns from fx union all select 'functions', count(*), 6 from fn union all select 'entry_points', count(*), 4 from ep union all select 'imports', count(*), 7 from im union all select 'calls', count(*), 5 from ca "
    "union all select 'call_edges', count(*), 4 from ce union all select 'types', count(*), 6 from ty union all select 'trait_impls', 0, 5 union all select 'health', 1, 48 union all select 'hotspots', least(10, count(*)), 5 from dg union all select 'rules', count(*), 4 from fi "
    "union all select 'module_edges', least(10, count(*)), 3 from (select distinct fg, tg from ge where fg <> tg) union all select 'changed_files', least(10, count(*)), 2 from fcc union all select 'file_ownership', least(20, count(*)), 6 from fcc union all select 'temporal_hotspots', 0, 4 "
    "union all select 'file_ages', 20, 5 union all select 'change_coupling', 20, 4 union all select 'inheritance', 0, 3 union all select 'arch_cycles', least(20, count(*)), 3 from cl where src = dst union all select 'arch_unstable', least(20, count(*)), 4 from st where module is not null or module is null union all select 'arch_foundations', least(20, count(*)), 4 from fo "
    "union all select 'arch_levels', count(*), 2 from fx union all select 'arch_distance', least(20, count(distinct grp)), 8 from ty join gr using (file_id) union all select 'arch_violations', 20, 7 union all select 'trend_health', 1, 12 union all select 'trend_hotspots', 0, 6 union all select 'trend_violations', count(distinct code), 4 from fi union all select 'meta', 1, 5)"
)
query("baseline_tables", SAVED + ' select "table", rows, columns::int as columns from n where rows > 0 and "table" not in (\'change_coupling\', \'file_ages\')')(lambda spark, d: saved_store(spark, d).summary().where("rows > 0 and `table` not in ('change_coupling', 'file_ages')"))


def without_hub(x: Facts) -> Facts:
    """The facts without the file that most import."""
    hub = structure.file_edges(x).groupBy("dst").count().orderBy(F.desc("count"), "dst").first()[0]
    return whatif.remove_file(x, hub)


HUB = "hub as (select arg_max(dst, (n, -dst)) as h from (select dst, count(*) as n from fe group by 1))"
LESS = f", {HUB}, im2 as (select * from im where from_file <> (select h from hub) and coalesce(resolved_file, -1) <> (select h from hub)), fe2 as (select from_file as src, resolved_file as dst from im2 where resolved_file <> from_file), cl2(src, dst) as (select distinct src, dst from fe2 union select cl2.src, fe2.dst from cl2 join fe2 on fe2.src = cl2.dst)"
COUNTS = "(select count(*) from {0}) as edge_count, (select count(resolved_file) from {0}) as resolved_edge_count, (select max(n) from (select count(*) as n from {1} group by dst)) as max_fan_in, (select max(n) from (select count(*) as n from {1} group by src)) as max_fan_out, (select count(*) from {2} where src = dst) as cycle_count"
metric("whatif_remove_file", LESS + " select " + COUNTS.format("im2", "fe2", "cl2"), lambda x: structure.graph_metrics(without_hub(x)), keep=True)
CUT = ", one as (select min((src, dst)) as e from fe), im3 as (select * from im where not (from_file = (select e[1] from one) and coalesce(resolved_file, -1) = (select e[2] from one)) union all select dst, '', src, 'local', null from (select e[1] as src, e[2] as dst from one where not exists (select 1 from fe where src = (select e[2] from one) and dst = (select e[1] from one)))), fe3 as (select from_file as src, resolved_file as dst from im3 where resolved_file <> from_file), cl3(src, dst) as (select distinct src, dst from fe3 union select cl3.src, fe3.dst from cl3 join fe3 on fe3.src = cl3.dst)"


def edge_turned(x: Facts) -> Facts:
    """The facts with the least edge turned round (only removed where the other way is there)."""
    e = structure.file_edges(x)
    first = e.orderBy("src", "dst").first()
    a, b = first["src"], first["dst"]
    steps: list[tuple] = [("remove_edge", a, b)]
    if e.where((F.col("src") == b) & (F.col("dst") == a)).isEmpty():
        steps.append(("add_edge", b, a))
    return whatif.sequence(x, steps)


metric("whatif_sequence", CUT + " select " + COUNTS.format("im3", "fe3", "cl3"), lambda x: structure.graph_metrics(edge_turned(x)), keep=True)
metric("whatif_ignore", ", keepf as (select file_id from fx where not regexp_matches(path, '^src/core(/|$)')), im4 as (select * from im where from_file in (select file_id from keepf) and (resolved_file is null or resolved_file in (select file_id from keepf))), fe4 as (select from_file as src, resolved_file as dst from im4 where resolved_file <> from_file), cl4(src, dst) as (select distinct src, dst from fe4 union select cl4.src, fe4.dst from cl4 join fe4 on fe4.src = cl4.dst) select " + COUNTS.format("im4", "fe4", "cl4"), lambda x: structure.graph_metrics(whatif.ignore(x, ["src/core"])), keep=True)
metric("whatif_move_file", f", {HUB} select file_id, 'moved/to/new_place.py' as path, case when language = 'python' then 'moved.to.new_place' else 'moved.to.new_place' end as module from fx where file_id = (select h from hub)", lambda x: _moved(x))


def _moved(x: Facts) -> DataFrame:
    hub = structure.file_edges(x).groupBy("dst").count().orderBy(F.desc("count"), "dst").first()[0]
    return whatif.move_file(x, hub, "moved/to/new_place.py").files.where(F.col("file_id") == hub).select("file_id", "path", "module")


def _two(x: Facts) -> tuple[dict, dict]:
    a, b = ({"rules": f, "hotspots": structure.hotspots(y), "module_edges": structure.dsm(y, CONFIG)[1]} for y, f in ((z, rules.findings(z, CONFIG)) for z in (x, baseline.shared(without_hub(x)))))
    return a, b


metric("baseline_changes_hotspots", f", {HUB}, fe2 as (select * from fe where src <> (select h from hub) and dst <> (select h from hub)), d2 as (select path, coalesce(i.n, 0) as fan_in, coalesce(o.n, 0) as fan_out from fx left join (select dst, count(*) as n from fe2 group by 1) i on i.dst = file_id left join (select src, count(*) as n from fe2 group by 1) o on o.src = file_id where i.n is not null or o.n is not null), "
    "ta as (select path from dg order by fan_in + fan_out desc, fan_in desc, path limit 10), tb as (select path from d2 order by fan_in + fan_out desc, fan_in desc, path limit 10), ma as (select fg || chr(31) || tg as key, count(*) as n from ge where fg <> tg group by 1, fg, tg order by 2 desc, fg, tg limit 10), mb as (select fg || chr(31) || tg as key, count(*) as n from ge where fg <> tg and src <> (select h from hub) and dst <> (select h from hub) group by 1, fg, tg order by 2 desc, fg, tg limit 10) "
    "select 'hotspot' as kind, coalesce(ta.path, tb.path) as key, case when ta.path is null then 'added' else 'removed' end as change, null::bigint as before, null::bigint as after, null::bigint as delta from ta full join tb on ta.path = tb.path where ta.path is null or tb.path is null "
    "union all select 'module_edge', coalesce(ma.key, mb.key), case when ma.key is null then 'added' when mb.key is null then 'removed' else 'changed' end, ma.n, mb.n, case when ma.key is not null and mb.key is not null then mb.n - ma.n end from ma full join mb on ma.key = mb.key where ma.n is distinct from mb.n",
    lambda x: baseline.changes(*_two(x)).where("kind <> 'rule'"), keep=True)

query("cycle_breaks")(lambda spark, d: whatif.cycle_breaks(baseline.shared(facts(spark, d)), 60))

# --- facts of source texts


def found(spark: SparkSession, d: str) -> DataFrame:
    """The current texts as a scan reads them."""
    return texts(spark, d, files(spark, d)).where("language is not null").withColumn("lines", F.size(F.split("content", "\n")).cast("long"))


LINES = "ln as (select file_id, language, unnest(string_split(content, chr(10))) as text, unnest(range(1, len(string_split(content, chr(10))) + 1)) as line from tx where language is not null)"
SEEN = "case when starts_with(s, 'pub(') then 'crate' when starts_with(s, 'protected internal ') then 'protected' when starts_with(s, 'private protected ') then 'private' when starts_with(s, 'pub ') or starts_with(s, 'public ') or starts_with(s, 'export ') or starts_with(s, 'open ') then 'public' when starts_with(s, 'private ') or starts_with(s, 'fileprivate ') then 'private' when starts_with(s, 'protected ') then 'protected' when starts_with(s, 'internal ') then 'package' else 'unknown' end"


def quoted(pattern: str) -> str:
    """A pattern as an SQL text."""
    return "'" + pattern.replace("'", "''") + "'"


query("scan_types", f", {LINES}, t as (select *, ltrim(text, ' ') as s, regexp_extract(text, {quoted(scan.TYPES)}, 2) as name from ln) select file_id, name, regexp_matches(text, {quoted(scan.ABSTRACT)}) as is_abstract, line, {SEEN} as visibility from t where name <> ''")(lambda spark, d: scan.types(found(spark, d)))
NAMED_BY = "case language " + " ".join(f"when '{k}' then regexp_extract(text, {quoted(v)}, 1)" for k, v in scan.FUNCTIONS.items()) + " else '' end"
query("scan_functions", f", {LINES}, t as (select *, ltrim(text, ' ') as s, {NAMED_BY} as name from ln) select file_id, name, line as start_line, {SEEN} as visibility from t where name <> ''")(
    lambda spark, d: scan.functions(found(spark, d).where(F.col("language").isin(*scan.FUNCTIONS))).select("file_id", "name", "start_line", "visibility")
)
IMPORTED = {k: v for k, v in scan.IMPORTS.items() if k not in ("rust", "scala")}
TARGET = "case language " + " ".join(f"when '{k}' then coalesce(nullif(regexp_extract(text, {quoted(v)}, 1), ''), nullif(regexp_extract(text, {quoted(v)}, 2), ''))" for k, v in IMPORTED.items()) + " end"
query("scan_imports", f", {LINES}, t as (select *, trim({TARGET}) as target from ln) select file_id as from_file, target, line from t where target is not null and target <> ''")(lambda spark, d: scan.imports(found(spark, d).where(F.col("language").isin(*IMPORTED))).select("from_file", "target", "line"))
CALLS = ", ".join(f"'{w}'" for w in [*S.KEYWORDS, *S.BRANCH_WORDS, "def", "fn", "func", "fun", "function", "new", "sizeof"])
query(
    "scan_calls",
    f", {LINES}, dc as (select distinct file_id, line, {NAMED_BY} as name from ln), t as (select file_id, line, unnest(regexp_extract_all(text, '\\b([A-Za-z_]\\w*)\\s*\\(', 1)) as target from ln where language in ('python', 'rust', 'kotlin', 'swift')) select t.file_id, target, count(*) as n from t where target not in ({CALLS}) and not exists (select 1 from dc where dc.file_id = t.file_id and dc.line = t.line and dc.name = target) group by 1, 2",
)(lambda spark, d: _calls(found(spark, d).where("language in ('python', 'rust', 'kotlin', 'swift')")))


def _calls(f: DataFrame) -> DataFrame:
    return scan.calls(f, scan.functions(f)).groupBy("file_id", "target").agg(F.count("*").alias("n"))


query("scan_trait_impls", f", {LINES}, t as (select file_id, regexp_extract(text, {quoted(scan.IMPL)}, 1) as trait_name, regexp_extract(text, {quoted(scan.IMPL)}, 2) as type_name, line from ln where language = 'rust') select * from t where trait_name <> '' and type_name <> ''")(lambda spark, d: scan.trait_impls(found(spark, d)))
