"""Registered queries of the operators on the catalogue's tables, each with its SQL where SQL can express it.

The commit log is played by orders (commit, author, time; urgent ones are fixes) and lineitem (files in a commit), the
complexity of a path by the size of its part; files, snapshots, module edges and hotspots are the catalogue's own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.functions import scalars as S
from factlens.operators import datalog, diff, evolution, graph, structure, trend, vectors
from factlens.plans import policies, prefix
from factlens.plans.typed_query import Filter, Sort, TableQuery
from factlens.plans.typed_query import run as typed
from factlens.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: 2024-12-01, the `now` of the age queries.
NOW = 1733011200


def query(name: str, sql: str | None = None):
    """Registers a query under a name, with its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def program(name: str, text: str, tables: list[str], sql: str) -> None:
    """Registers a program of the query language."""
    QUERIES[name] = lambda spark, d: prefix.engine(spark, {t: table(spark, d, t) for t in tables}).rows(text)
    ORACLE[name] = sql


def commits(spark: SparkSession, d: str) -> DataFrame:
    """The commit log."""
    o = table(spark, d, "orders")
    subject = F.when(F.col("o_orderpriority") == "1-URGENT", "fix: urgent").otherwise("feature")
    return o.select(F.col("o_orderkey").cast("string").alias("commit_id"), F.col("o_custkey").cast("string").alias("author"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("ts"), subject.alias("subject"))


def commit_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of each commit; the operators drop what is repeated."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("commit_id"), F.col("l_partkey").cast("string").alias("path"))


def complexity(spark: SparkSession, d: str) -> DataFrame:
    """Complexity by path."""
    return table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.col("p_size").cast("long").alias("value"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """The distinct module edges of all snapshots."""
    return graph.simple(graph.build(table(spark, d, "module_edges"), "from_module", "to_module"))


def forward(spark: SparkSession, d: str) -> DataFrame:
    """Module edges that go up the alphabet: a graph without cycles."""
    return edges(spark, d).where("src < dst")


LOG = """
c as (select o_orderkey::varchar as commit_id, o_custkey::varchar as author, epoch(o_orderdate)::bigint as ts, o_orderpriority = '1-URGENT' as fix from orders),
cf as (select distinct l_orderkey::varchar as commit_id, l_partkey::varchar as path from lineitem),
fc as (select path, count(*) as commits from cf group by 1),
cx as (select p_partkey::varchar as path, max(p_size)::bigint as max_complexity from part group by 1)
"""
EDGES = "e as (select distinct from_module as src, to_module as dst from module_edges where from_module is not null and to_module is not null and from_module <> to_module)"
UP = EDGES + ", d as (select * from e where src < dst)"

# --- query language and typed queries

program("loc_by_language", "(select {n: (count path) lines: (sum lines) from: files by: language desc: lines})", ["files"], "select language, count(*) as n, sum(lines)::bigint as lines from files group by 1")
program(
    "select_filter_topk",
    '(select {file_id: file_id path: path lines: lines from: files where: (and (> lines 300) (.starts-with path "src/")) desc: [lines file_id path] take: 25})',
    ["files"],
    "select file_id, path, lines from files where lines > 300 and starts_with(path, 'src/') order by lines desc, file_id desc, path desc limit 25",
)
program(
    "semi_join_in",
    "(select {language: language from: (select {from: files where: (and (in file_id (at (select {from: file_texts where: (!= content \"\")}) 'file_id)) (> bytes 1000))}) by: language n: (count path) bytes: (sum bytes)})",
    ["files", "file_texts"],
    "select language, language, count(*) as n, sum(bytes)::bigint as bytes from files where bytes > 1000 and file_id in (select file_id from file_texts where content <> '') group by 1",
)
ORACLE["semi_join_in"] = "select language, count(*) as n, sum(bytes)::bigint as bytes from files where bytes > 1000 and file_id in (select file_id from file_texts where content <> '') group by 1"
QUERIES["semi_join_in"] = lambda spark, d: prefix.engine(spark, {t: table(spark, d, t) for t in ("files", "file_texts")}).rows(
    "(select {n: (count path) bytes: (sum bytes) from: (select {from: files where: (and (in file_id (at (select {from: file_texts where: (!= content \"\")}) 'file_id)) (> bytes 1000))}) by: language})"
)
program(
    "select_arithmetic",
    "(select {id: file_id density: (div bytes lines) parity: (% lines 2) twice: (* 2 (+ lines 1)) big: (if (>= lines 500) \"big\" \"small\") from: files where: (or (> lines 0) (== lines 0))})",
    ["files"],
    "select file_id as id, case when lines = 0 then null else bytes::double / lines end as density, lines % 2 as parity, 2 * (lines + 1) as twice, case when lines >= 500 then 'big' else 'small' end as big from files where lines >= 0",
)
program(
    "select_pivot",
    "(select {n: (count path) from: (select {language: language day: (if (> lines 100) \"long\" \"short\") path: path from: files where: (> lines 0)}) by: language pivot: day})",
    ["files"],
    "select language, nullif(count(*) filter (lines > 100), 0) as long, nullif(count(*) filter (lines <= 100), 0) as short from files where lines > 0 group by 1",
)
program(
    "concat_tables",
    "(select {n: (count repo) from: (concat (select {repo: repo id: snapshot_id from: snapshots}) (select {id: language repo: repo from: files})) by: repo})",
    ["snapshots", "files"],
    "select repo, count(*) as n from (select repo from snapshots union all select repo from files) group by 1",
)
program("count_atom", "(count t)", ["module_edges"], "select 1 as value where false")
QUERIES["count_atom"] = lambda spark, d: prefix.engine(spark, {"t": table(spark, d, "module_edges")}).rows("(count t)")
ORACLE["count_atom"] = "select count(*) as value from module_edges"
program("column_vector", "(at (select {path: path from: trend_hotspots where: (> risk_score 5000)}) 'path)", ["trend_hotspots"], "select path as value from trend_hotspots where risk_score > 5000")


@query(
    "typed_query_page",
    "select p_partkey, p_name, p_size from part where p_size in (1, 5, 9, 13) and not contains(p_name, 'zzz') and p_retailprice >= 950.5 order by p_size desc, p_name, p_partkey limit 40 offset 15",
)
def typed_query_page(spark: SparkSession, d: str) -> DataFrame:
    """A typed query: conditions, two sort keys and a page."""
    q = TableQuery(["p_partkey", "p_name", "p_size"], [Filter("p_size", "in", [1, 5, 9, 13]), Filter("p_name", "not_regex", "zzz"), Filter("p_retailprice", "gte", 950.5)], "all", [Sort("p_size", True), Sort("p_name")], 15, 40)
    return typed(table(spark, d, "part"), q, ["p_partkey"])


@query("typed_query_any", "select path, language, lines from files where lines is null or ends_with(path, '.rs') or regexp_matches(path, '^tools/.*[0-9]+\\.py$') or language = 'c' or coalesce(lines::varchar, '') > 'x'")
def typed_query_any(spark: SparkSession, d: str) -> DataFrame:
    """A typed query of which any condition may hold, with a comparison across types."""
    q = TableQuery(["path", "language", "lines"], [Filter("lines", "eq", None), Filter("path", "ends_with", ".rs"), Filter("path", "regex", r"^tools/.*[0-9]+\.py$"), Filter("language", "eq", "c"), Filter("lines", "gt", "x")], "any")
    return typed(table(spark, d, "files"), q)


# --- scalars


@query(
    "path_functions",
    r"""with p as (select distinct replace(path, '\', '/') as path, module from files where path is not null)
select path, regexp_matches(path, '^tests?/|/tests?/|_tests?\.') as is_test, regexp_matches(path, '(mod\.rs|__init__\.py|index\.(ts|tsx|js))$') as is_index, regexp_split_to_array(module, '[./]')[1] as top from p""",
)
def path_functions(spark: SparkSession, d: str) -> DataFrame:
    """Test paths, index files and top modules."""
    f = table(spark, d, "files").where("path is not null").select(S.clean_path(F.col("path")).alias("path"), "module").distinct()
    return f.select("path", S.is_test_path(F.col("path")).alias("is_test"), S.is_package_index(F.col("path")).alias("is_index"), S.top_module(F.col("module")).alias("top"))


@query(
    "module_groups",
    r"""with p as (select distinct replace(path, '\', '/') as path, language, module from files where path is not null), s as (select *, string_split(path, '/') as a from p)
select path, case when len(a) >= 3 and a[1] in ('crates', 'packages', 'apps') then a[1] || '/' || a[2] when language = 'python' and len(a) >= 2 and a[1] = 'src' then a[2]
  when path = 'services' or starts_with(path, 'services/') then 'services/' || a[2] else regexp_split_to_array(module, '[./]')[1] end as grp from s""",
)
def module_groups(spark: SparkSession, d: str) -> DataFrame:
    """Module groups by layout and configured root."""
    f = table(spark, d, "files").where("path is not null").select(S.clean_path(F.col("path")).alias("path"), "language", "module").distinct()
    return f.select("path", S.module_group(F.col("path"), F.col("language"), F.col("module"), ["services"]).alias("grp"))


@query("grades", "select snapshot_id, round(least(1.0, file_count / 1000.0) * 1000) / 1000 as share, case when round(least(1.0, file_count / 1000.0) * 1000) / 1000 >= 0.9 then 'A' when round(least(1.0, file_count / 1000.0) * 1000) / 1000 >= 0.8 then 'B' when round(least(1.0, file_count / 1000.0) * 1000) / 1000 >= 0.7 then 'C' when round(least(1.0, file_count / 1000.0) * 1000) / 1000 >= 0.5 then 'D' else 'F' end as grade from snapshots where file_count is not null")
def grades(spark: SparkSession, d: str) -> DataFrame:
    """Letters of a share."""
    share = S.round3(F.least(F.lit(1.0), F.col("file_count") / 1000.0))
    return table(spark, d, "snapshots").where("file_count is not null").select("snapshot_id", share.alias("share"), S.grade(share).alias("grade"))


# --- sizes and distributions

ENTROPY = "select round((log2(sum(n)) - sum(n * log2(n)) / sum(n)) * 1000) / 1000 as bits, round((log2(sum(n)) - sum(n * log2(n)) / sum(n)) / log2(count(*)) * 1000) / 1000 as normalised, count(*) as groups from g"


@query("size_entropy", "with g as (select case when lines = 0 then 0 else floor(log2(lines)) + 1 end as b, count(*) as n from files where lines >= 0 group by 1) " + ENTROPY)
def size_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Entropy of file sizes."""
    return structure.size_entropy(table(spark, d, "files"))


@query("gini_lines", "with v as (select lines::double as x, row_number() over (order by lines) as r, count(*) over () as n from files where lines >= 0) select round((2 * sum(r * x) / (any_value(n) * sum(x)) - (any_value(n) + 1.0) / any_value(n)) * 1000) / 1000 as gini from v")
def gini_lines(spark: SparkSession, d: str) -> DataFrame:
    """Inequality of file sizes."""
    return structure.gini(table(spark, d, "files").where("lines >= 0"), "lines")


@query("size_by_language", "select language, max(lines) as longest, count(*) filter (lines >= 500) as large, case when sum(lines) = 0 then 0.0 else round(sum(comment_lines)::double / sum(lines) * 1000) / 1000 end as comments from files where lines > 0 group by 1")
def size_by_language(spark: SparkSession, d: str) -> DataFrame:
    """Sizes per language."""
    g = table(spark, d, "files").where("lines > 0").groupBy("language").agg(F.max("lines").alias("longest"), F.count_if(F.col("lines") >= 500).alias("large"), F.sum("comment_lines").alias("c"), F.sum("lines").alias("l"))
    return g.select("language", "longest", "large", S.ratio(F.col("c"), F.col("l")).alias("comments"))


@query("duplicate_contents", "select content_hash, count(distinct file_id) as size, min(path) as path from files where content_hash is not null group by 1 having count(distinct file_id) > 1")
def duplicate_contents(spark: SparkSession, d: str) -> DataFrame:
    """Groups of files of one content."""
    g = table(spark, d, "files").where("content_hash is not null").groupBy("content_hash").agg(F.countDistinct("file_id").alias("size"), F.min("path").alias("path"))
    return g.where("size > 1").select("content_hash", "size", "path")


# --- graph


@query("degree", f"with {EDGES} select n as _node, sum(i)::bigint as _in_degree, sum(o)::bigint as _out_degree, count(*) as _degree from (select src as n, 0 as i, 1 as o from e union all select dst, 1, 0 from e) group by 1")
def degree(spark: SparkSession, d: str) -> DataFrame:
    """Degrees of the module graph."""
    return graph.degree(edges(spark, d))


@query("hotspots_topk", f"with {EDGES}, g as (select n as module, sum(i)::bigint as fan_in, sum(o)::bigint as fan_out from (select src as n, 0 as i, 1 as o from e union all select dst, 1, 0 from e) group by 1) select * from g order by fan_in + fan_out desc, fan_in desc, module limit 10")
def hotspots_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten most connected modules."""
    g = graph.degree(edges(spark, d)).select(F.col("_node").alias("module"), F.col("_in_degree").alias("fan_in"), F.col("_out_degree").alias("fan_out"))
    return g.orderBy(F.desc(F.col("fan_in") + F.col("fan_out")), F.desc("fan_in"), "module").limit(10)


STABLE = EDGES + """, m as (select src as module from e union select dst from e), i as (select dst as module, count(*) as n from e group by 1), o as (select src as module, count(*) as n from e group by 1),
s as (select m.module, coalesce(i.n, 0) as fan_in, coalesce(o.n, 0) as fan_out from m left join i using (module) left join o using (module)),
st as (select *, case when fan_in + fan_out = 0 then 0.0 else round(fan_out::double / (fan_in + fan_out) * 1000) / 1000 end as instability from s)"""


def stable_modules(spark: SparkSession, d: str) -> DataFrame:
    """Stability of every module."""
    e = edges(spark, d)
    return structure.stability(e.select(F.col("src").alias("from_module"), F.col("dst").alias("to_module")), graph.nodes(e).select(F.col("node").alias("module")))


query("module_stability", f"with {STABLE} select * from st")(stable_modules)
query("unstable_modules", f"with {STABLE} select * from st order by fan_out desc, module limit 20")(lambda spark, d: structure.unstable_modules(stable_modules(spark, d)))
query("foundations", f"with {STABLE} select * from st where fan_in >= 2 and (fan_out = 0 or instability <= 0.15) order by fan_in desc, module limit 20")(lambda spark, d: structure.foundations(stable_modules(spark, d)))


@query("coupling_entropy", f"with {STABLE}, g as (select split_part(from_module, '.', 2) as a, split_part(to_module, '.', 2) as b, count(*) as n from module_edges where from_module <> to_module and to_module not in (select module from st where fan_in >= 2 and (fan_out = 0 or instability <= 0.15)) group by 1, 2) " + ENTROPY)
def coupling_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Entropy of the pairs that edges join, those into foundations aside."""
    base = structure.foundations(stable_modules(spark, d), None).select(F.col("module").alias("to_module"))
    e = table(spark, d, "module_edges").where("from_module <> to_module").join(base, "to_module", "left_anti")
    part = lambda c: F.split_part(F.col(c), F.lit("."), F.lit(2))
    return structure.entropy(e.groupBy(part("from_module").alias("a"), part("to_module").alias("b")).agg(F.count("*").alias("n")))


@query("module_edges_top", "select from_module, to_module, sum(edges)::bigint as edges from module_edges where from_module <> to_module group by 1, 2 order by 3 desc nulls last, 1, 2 limit 10")
def module_edges_top(spark: SparkSession, d: str) -> DataFrame:
    """The ten heaviest module edges."""
    g = table(spark, d, "module_edges").where("from_module <> to_module").groupBy("from_module", "to_module").agg(F.sum("edges").alias("edges"))
    return g.orderBy(F.desc_nulls_last("edges"), "from_module", "to_module").limit(10)


REACH = f"with recursive {EDGES}, r(node) as (select distinct src from e where starts_with(src, 'app.core') union select e.dst from r join e on e.src = r.node)"


@query("closure_reach", REACH + " select node from r")
def closure_reach(spark: SparkSession, d: str) -> DataFrame:
    """What the modules under app.core reach, themselves with it."""
    e = edges(spark, d)
    return graph.reach(e, e.where("src like 'app.core%'").select(F.col("src").alias("node"))).select("node")


@query("bfs_depth", f"with recursive {EDGES}, r(node, depth) as (select distinct src, 0 from e where starts_with(src, 'lib.') union select e.dst, r.depth + 1 from r join e on e.src = r.node where r.depth < 400) select node, min(depth)::int as depth from r group by 1")
def bfs_depth(spark: SparkSession, d: str) -> DataFrame:
    """Fewest steps from the modules under lib."""
    e = edges(spark, d)
    return graph.reach(e, e.where("src like 'lib.%'").select(F.col("src").alias("node")))


@query("blast_radius", f"with recursive {EDGES}, r(node, depth) as (select 'src.core.model', 0 union select e.src, r.depth + 1 from r join e on e.dst = r.node where r.depth < 400) select node, min(depth)::int as depth from r where node <> 'src.core.model' group by 1")
def blast_radius(spark: SparkSession, d: str) -> DataFrame:
    """What depends on one module, by distance."""
    e = edges(spark, d)
    return graph.blast_radius_of(e, spark.createDataFrame([("src.core.model",)], "node string"))


@query("cycle_members", f"with recursive {EDGES}, c(src, dst) as (select src, dst from e union select c.src, e.dst from c join e on e.src = c.dst) select src as node from c where src = dst")
def cycle_members(spark: SparkSession, d: str) -> DataFrame:
    """Modules that reach themselves."""
    return graph.cycle_members(edges(spark, d))


@query("components", f"with recursive {EDGES}, u as (select src, dst from e union select dst, src from e), r(node, low) as (select src, src from u union select u.dst, r.low from r join u on u.src = r.node where r.low < u.dst) select node as _node, min(low) as _component from r group by 1")
def components(spark: SparkSession, d: str) -> DataFrame:
    """Weakly connected components."""
    return graph.components(edges(spark, d))


LEVELS = f"with recursive {UP}, r(node, level) as (select src, 0 from d where src not in (select dst from d) union select d.dst, r.level + 1 from r join d on d.src = r.node), l as (select node, max(level)::int as level from r group by 1)"


@query("dependency_levels", LEVELS + " select node, level from l")
def dependency_levels(spark: SparkSession, d: str) -> DataFrame:
    """Longest-path levels of a graph without cycles."""
    return graph.levels(forward(spark, d))


@query("topological_order", LEVELS + " select node as _node, row_number() over (order by level, node) - 1 as _order from l")
def topological_order(spark: SparkSession, d: str) -> DataFrame:
    """Topological order by (round, node)."""
    return graph.topological(forward(spark, d))


@query("levels_cyclic")
def levels_cyclic(spark: SparkSession, d: str) -> DataFrame:
    """Peeling levels of the whole module graph, cycles and all."""
    return graph.levels(edges(spark, d))


def _pagerank_sql(rounds: int) -> str:
    parts = [f"with {EDGES}, v as (select src as node from e union select dst from e), k as (select count(*) as n from v), o as (select src, count(*) as c from e group by 1), p0 as (select node, 1.0::double / n as r from v, k)"]
    for i in range(rounds):
        parts.append(
            f"l{i} as (select coalesce(sum(r), 0) as lost from p{i} where node not in (select src from o)), "
            f"g{i} as (select e.dst as node, sum(p.r / o.c) as s from e join p{i} p on p.node = e.src join o on o.src = e.src group by 1), "
            f"p{i + 1} as (select v.node, 0.15 / n + 0.85 * (coalesce(s, 0) + lost / n) as r from v cross join k cross join l{i} left join g{i} on g{i}.node = v.node)"
        )
    return ", ".join(parts) + f" select node as _node, round(r, 9) as _rank from p{rounds}"


@query("pagerank", _pagerank_sql(5))
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    """Five rounds of rank over the module graph."""
    return graph.pagerank(edges(spark, d), 5).withColumn("_rank", F.round("_rank", 9))


@query(
    "clustering",
    f"with {EDGES}, u as (select distinct least(src, dst) as a, greatest(src, dst) as b from e), n as (select a as x, b as y from u union all select b, a from u), g as (select x, count(*) as d from n group by 1), "
    "t as (select p.x, count(*) as t from n p join n q on p.x = q.x and p.y < q.y join u on u.a = p.y and u.b = q.y group by 1) select g.x as _node, round(case when d < 2 then 0 else 2.0 * coalesce(t, 0) / (d * (d - 1)) end, 9) as _coefficient from g left join t on t.x = g.x",
)
def clustering(spark: SparkSession, d: str) -> DataFrame:
    """Clustering coefficients."""
    return graph.clustering(edges(spark, d)).withColumn("_coefficient", F.round("_coefficient", 9))


@query("spanning_forest")
def spanning_forest(spark: SparkSession, d: str) -> DataFrame:
    """A lightest forest over the summed edges."""
    g = table(spark, d, "module_edges").groupBy("from_module", "to_module").agg(F.sum("edges").alias("n"))
    return graph.spanning_forest(graph.build(g.where("n is not null"), "from_module", "to_module", "n"))


@query("datalog_reaches", f"with recursive {EDGES}, r(b) as (select dst from e where src = 'src.core.model' union select e.dst from r join e on e.src = r.b) select b as \"?b\" from r")
def datalog_reaches(spark: SparkSession, d: str) -> DataFrame:
    """A recursive rule, asked for one constant: what it reaches."""
    v = datalog.Var
    db = datalog.Datoms.from_edges(edges(spark, d), "edge").with_rules(
        datalog.Rule(datalog.Atom("reaches", [v("?b")]), [datalog.Atom(":edge", ["src.core.model", v("?b")])]),
        datalog.Rule(datalog.Atom("reaches", [v("?c")]), [datalog.Atom("reaches", [v("?b")]), datalog.Atom(":edge", [v("?b"), v("?c")])]),
    )
    return db.query(["?b"], [datalog.Atom("reaches", [v("?b")])])


# --- vectors


def _knn(metric: str, expression: str) -> None:
    sql = f"with q as (select embedding::double[] as q from embeddings where vec_id = 0) select vec_id as _rowid, round({expression}, 9) as _dist from embeddings, q order by {expression}, vec_id limit 10"

    def run(spark: SparkSession, d: str) -> DataFrame:
        e = table(spark, d, "embeddings")
        first = e.where("vec_id = 0").select("embedding").first()[0]
        return vectors.knn(e, "vec_id", F.col("embedding"), first, 10, metric).withColumn("_dist", F.round("_dist", 9))

    query(f"knn_{metric}", sql)(run)


_knn("cosine", "1 - list_cosine_similarity(embedding::double[], q)")
_knn("l2", "list_distance(embedding::double[], q)")
_knn("ip", "-list_inner_product(embedding::double[], q)")

# --- evolution


@query("changed_files", f"with {LOG} select path, commits from fc order by commits desc, path limit 10")
def changed_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of most commits."""
    return evolution.changed_files(commit_files(spark, d))


@query("top_authors", f"with {LOG} select author, count(*) as commits from c group by 1 order by 2 desc, 1 limit 10")
def top_authors(spark: SparkSession, d: str) -> DataFrame:
    """Authors of most commits."""
    return evolution.top_authors(commits(spark, d))


OWNERS = LOG + """, a as (select path, author, count(*) as n from cf join c using (commit_id) group by 1, 2),
r as (select *, row_number() over w as r, sum(n) over (w rows unbounded preceding) as held, sum(n) over (partition by path) as total from a window w as (partition by path order by n desc, author)),
ow as (select path, arg_min(author, r) as top_author, max(n) as top_author_commits, max(total)::bigint as total_commits, count(*) as author_count, min(r) filter (held >= ceil(total * 0.8)) as bus_factor from r group by 1)"""


@query("file_ownership", f"with {OWNERS} select * from ow order by bus_factor, total_commits desc, path limit 20")
def file_ownership(spark: SparkSession, d: str) -> DataFrame:
    """Ownership and bus factors."""
    return evolution.file_ownership(commits(spark, d), commit_files(spark, d))


@query("file_ages", f"with {LOG}, w as (select path, min(ts) as first_commit_unix, max(ts) as last_commit_unix from cf join c using (commit_id) where ts > 0 group by 1) select *, ({NOW} - first_commit_unix) // 86400 as age_days, greatest(({NOW} - last_commit_unix) // 86400, 0) as last_changed_days from w where first_commit_unix <= {NOW} order by age_days desc, last_changed_days desc, path limit 20")
def file_ages(spark: SparkSession, d: str) -> DataFrame:
    """The oldest files."""
    return evolution.file_ages(commits(spark, d), commit_files(spark, d), NOW)


@query("bug_prone", f"with {LOG}, f as (select path, count(*) filter (fix) as bug_fix_commits, count(*) as total_commits from cf join c using (commit_id) group by 1) select *, round(bug_fix_commits::double / total_commits * 1000) / 1000 as ratio from f where bug_fix_commits > 0 order by bug_fix_commits desc, ratio desc, path limit 20")
def bug_prone(spark: SparkSession, d: str) -> DataFrame:
    """Files of most fixes."""
    return evolution.bug_prone(commits(spark, d), commit_files(spark, d))


@query(
    "change_coupling",
    f"with {LOG}, s as (select commit_id from cf group by 1 having count(*) <= 50), p as (select a.path as l, b.path as r, count(*) as co_commits from cf a join cf b on a.commit_id = b.commit_id and a.path < b.path where a.commit_id in (select commit_id from s) group by 1, 2 having count(*) >= 3) "
    'select l as "left", r as "right", co_commits, round(co_commits::double / (x.commits + y.commits - co_commits) * 1000) / 1000 as coupling_strength from p join fc x on x.path = l join fc y on y.path = r order by 4 desc, 3 desc, 1, 2 limit 20',
)
def change_coupling(spark: SparkSession, d: str) -> DataFrame:
    """Files that change together."""
    return evolution.change_coupling(commit_files(spark, d))


@query("temporal_hotspots", f"with {LOG} select path, commits, max_complexity, commits * max_complexity as risk_score from fc join cx using (path) where commits * max_complexity > 0 order by 4 desc, 2 desc, 1 limit 10")
def temporal_hotspots(spark: SparkSession, d: str) -> DataFrame:
    """Files both complex and often changed."""
    return evolution.temporal_hotspots(commit_files(spark, d), complexity(spark, d))


@query(
    "edit_risk",
    f"with {OWNERS}, o20 as (select path, bus_factor from ow order by bus_factor, total_commits desc, path limit 20), gap as (select p_partkey::varchar as path from part where p_size > 45 order by 1 limit 100), "
    "x as (select fc.path, commits, max_complexity, greatest(coalesce(bus_factor, 1), 1) as bus_factor, gap.path is not null as has_test_gap from fc join cx using (path) left join o20 on o20.path = fc.path left join gap on gap.path = fc.path) "
    "select *, round(commits * max_complexity * (1 + 1.0::double / bus_factor) * case when has_test_gap then 1.5::double else 1.0::double end)::bigint as risk_score from x order by risk_score desc, commits desc, path limit 20",
)
def edit_risk(spark: SparkSession, d: str) -> DataFrame:
    """Files risky to edit."""
    own = evolution.file_ownership(commits(spark, d), commit_files(spark, d))
    gaps = table(spark, d, "part").where("p_size > 45").select(F.col("p_partkey").cast("string").alias("path"))
    return evolution.edit_risk(commit_files(spark, d), complexity(spark, d), own, gaps)


# --- trend, diff, policies


@query("trend_top_hotspots", "select path, max(risk_score) as risk_score from trend_hotspots group by 1 order by 2 desc nulls last, 1 limit 5")
def trend_top_hotspots(spark: SparkSession, d: str) -> DataFrame:
    """The greatest risks over all samples."""
    return trend.top_hotspots(table(spark, d, "trend_hotspots"))


SAMPLES = "s as (select distinct epoch(taken_at)::bigint as timestamp, snapshot_id from snapshots where taken_at is not null and snapshot_id is not null)"


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots as samples."""
    s = table(spark, d, "snapshots").where("taken_at is not null and snapshot_id is not null")
    return s.select(F.unix_seconds(F.col("taken_at").cast("timestamp")).alias("timestamp"), "snapshot_id").distinct()


@query(
    "drift_hotspots",
    f"with {SAMPLES}, w as (select * from s where timestamp >= (select max(timestamp) from s) - 7776000), k as (select arg_min(snapshot_id, (timestamp, snapshot_id)) as a, arg_max(snapshot_id, (timestamp, snapshot_id)) as b from w), "
    "h as (select path, max(risk_score) filter (snapshot_id = a) as x, max(risk_score) filter (snapshot_id = b) as y from trend_hotspots, k where snapshot_id in (a, b) group by 1) "
    "select path, coalesce(x, 0) as before, y as after, y - coalesce(x, 0) as delta, x is null as is_new from h where y is not null and y - coalesce(x, 0) > 0 order by 4 desc, 1 limit 5",
)
def drift_hotspots(spark: SparkSession, d: str) -> DataFrame:
    """Hotspots new or risen over the last ninety days of samples."""
    s = samples(spark, d)
    now = s.agg(F.max("timestamp")).first()[0]
    return trend.risen(trend.in_window(s, "90d", now), table(spark, d, "trend_hotspots"), "path", "risk_score")


@query(
    "baseline_diff",
    "with b as (select path, max((lines, content_hash)) as r from files where scanned_at < timestamp '2025-06-01' and path is not null group by 1), a as (select path, max((lines, content_hash)) as r from files where scanned_at >= timestamp '2025-06-01' and path is not null group by 1) "
    "select coalesce(a.path, b.path) as path, case when b.path is null then 'added' when a.path is null then 'removed' else 'changed' end as change from a full join b on a.path = b.path where a.path is null or b.path is null or a.r is distinct from b.r",
)
def baseline_diff(spark: SparkSession, d: str) -> DataFrame:
    """Files added, removed or changed between two halves of the scans."""
    f = table(spark, d, "files").where("path is not null and scanned_at is not null")
    cut = F.lit("2025-06-01").cast("timestamp_ntz")
    return diff.keyed_diff(f.where(F.col("scanned_at") < cut), f.where(F.col("scanned_at") >= cut), ["path"], ["lines", "content_hash"]).select("path", "change")


POLICY = '(select {severity: "warning" code: "huge-file" path: path message: "split this file" from: files where: (and (> lines 800) (!= language "unknown"))})'


@query("policy_findings", "select 'warning' as severity, 'huge-file' as code, path, 'split this file' as message from files where lines > 800 and language <> 'unknown'")
def policy_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings of a policy program."""
    return policies.evaluate(spark, "huge", POLICY, {"files": table(spark, d, "files")}).findings


@query("code_complexity")
def code_complexity(spark: SparkSession, d: str) -> DataFrame:
    """Lexical and cognitive complexity and both fingerprints of every current source text."""
    f = table(spark, d, "files").where("file_id is not null").groupBy("file_id").agg(F.max(F.struct("scanned_at", "language")).alias("f"))
    t = table(spark, d, "file_texts").where("file_id is not null").groupBy("file_id").agg(F.max(F.struct("fetched_at", "content")).alias("t"))
    j = t.join(f, "file_id").where("t.content is not null").select("file_id", F.col("t.content").alias("body"), F.coalesce("f.language", F.lit("")).alias("language"))
    return j.select("file_id", S.lexical_complexity(F.col("body"), F.col("language")).alias("value"), S.cognitive_complexity(F.col("body"), F.col("language")).alias("cognitive_value"), S.body_fingerprint(F.col("body")).alias("fingerprint"), S.shape_fingerprint(F.col("body")).alias("shape"))
