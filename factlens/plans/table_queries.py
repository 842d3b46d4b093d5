"""Registered queries of the language, the rules of a database of facts, graphs, trends, logs and stores, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.functions import scalars as S
from factlens.operators import datalog, graph, trend, vector_index
from factlens.plans import prefix, reports, typed_query
from factlens.plans.core_queries import EDGES, edges
from factlens.session import shared_dir, table
from factlens.sources import commit_log, manifests
from factlens.sources.store import Store, saved
from factlens.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


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
    query(name, sql)(lambda spark, d: prefix.engine(spark, {t: table(spark, d, t) for t in tables}).rows(text))


# --- the language

program("language_do_set", '(do (set big (select {from: files where: (> lines 500)})) (select {n: (count path) from: big by: language}))', ["files"], "select language, count(*) as n from files where lines > 500 group by 1")
program("language_lambda", "(do (set twice (fn [x] (* 2 x))) (select {id: file_id double: (twice lines) from: files where: (> lines 900)}))", ["files"], 'select file_id as id, 2 * lines as "double" from files where lines > 900')
program("language_table", "(select {n: (count k) from: (table [k v] (list [1 2 2] [4 5 6])) by: k})", [], "select k, count(*) as n from (values (1, 4), (2, 5), (2, 6)) t(k, v) group by 1")
program("language_dict", "(dict [a b] [1 2])", [], "select * from (values ('a', 1), ('b', 2)) t(key, value)")
program("language_vector", "[3 1 2]", [], "select * from (values (3), (1), (2)) t(value)")
program("language_cross_table", "(select {path: path risk: risk_score from: (select {from: trend_hotspots where: (in path (at (select {from: files where: (> lines 700)}) 'path))}) where: (> risk_score 100)})", ["files", "trend_hotspots"], "select path, risk_score as risk from trend_hotspots where path in (select path from files where lines > 700) and risk_score > 100")
program("language_distance", "(cos-dist [0.1 0.2 0.3 0.4] [0.15 0.18 0.32 0.41])", [], "select 1 - list_cosine_similarity([0.1, 0.2, 0.3, 0.4]::double[], [0.15, 0.18, 0.32, 0.41]::double[]) as value")
program("language_graph_degree", "(.graph.degree (.graph.build (select {from: module_edges where: (!= from_module to_module)}) 'from_module 'to_module))", ["module_edges"], "select n as _node, sum(i)::bigint as _in_degree, sum(o)::bigint as _out_degree, count(*) as _degree from (select from_module as n, 0 as i, 1 as o from module_edges where from_module <> to_module and to_module is not null union all select to_module, 1, 0 from module_edges where from_module <> to_module and from_module is not null) where n is not null group by 1")
program("language_graph_info", "(.graph.info (.graph.build module_edges 'from_module 'to_module))", ["module_edges"], "with e as (select from_module as a, to_module as b from module_edges where from_module is not null and to_module is not null) select * from (values ('n_nodes', (select count(*) from (select a from e union select b from e))::varchar), ('n_edges', (select count(*) from e)::varchar), ('has_weights', 'False')) t(key, value)")
program("language_datalog", "(do (set Db (datoms)) (set Db (assert-fact Db 1 'edge 2)) (set Db (assert-fact Db 2 'edge 3)) (set Db (assert-fact Db 3 'edge 1)) (set Db (assert-fact Db 9 'edge 1)) (set Db (retract-fact Db 9 'edge 1)) (rule (reaches ?a ?b) (?a :edge ?b)) (rule (reaches ?a ?c) (reaches ?a ?b) (?b :edge ?c)) (query Db (find ?a) (where (reaches ?a ?a))))", [], "select * from (values ('1'), ('2'), ('3')) t(\"?a\")")


@query("language_error_codes", "select * from (values ('domain'), ('name'), ('parse'), ('type')) t(code)")
def language_error_codes(spark: SparkSession, d: str) -> DataFrame:
    """The codes that bad programs end with."""
    codes = []
    for text in ("(select", "(unknown 1)", "(concat 1 2)", '(at (dict [a] [1]) (quote b))'):
        try:
            prefix.engine(spark, {}).rows(text).collect()
        except prefix.EvalError as e:
            codes.append(e.code)
    return spark.createDataFrame([(c,) for c in sorted(set(codes))], "code string")


@query("typed_query_cli", "select path, lines from files where language in ('c', 'rust') and lines > 200 and not ends_with(path, '.h') order by lines desc, path, file_id limit 30 offset 5")
def typed_query_cli(spark: SparkSession, d: str) -> DataFrame:
    """A typed query in the command line's syntax."""
    q = typed_query.from_cli(['language:in:["c","rust"]', "lines:gt:200", r"path:not_regex:\.h$"], "path, lines", ["lines:desc", "path:asc"], offset=5, limit=30)
    return typed_query.run(table(spark, d, "files"), q, ["file_id"])


@query("typed_query_json", "select p_partkey, p_size from part where p_size not in (1, 2) and (p_brand = 'Brand#11' or starts_with(p_name, 'a') or p_size <= 3) is not null and p_size <> 7 and p_brand >= 'Brand#2' order by p_size desc, p_partkey limit 100")
def typed_query_json(spark: SparkSession, d: str) -> DataFrame:
    """A typed query in its JSON form, with its defaults."""
    q = typed_query.from_json({"columns": ["p_partkey", "p_size"], "filters": [{"column": "p_size", "op": "not_in", "value": [1, 2]}, {"column": "p_size", "op": "ne", "value": 7}, {"column": "p_brand", "op": "gte", "value": "Brand#2"}], "sort": {"column": "p_size", "direction": "desc"}})
    return typed_query.run(table(spark, d, "part"), q, ["p_partkey"])


# --- scalars


@query(
    "path_scalars",
    r"""with p as (select distinct replace(path, '\', '/') as path, language from files where path is not null and language is not null), a as (select *, list_filter(string_split(path, '/'), lambda x: x <> '' and x <> '.') as parts from p),
b as (select *, regexp_replace(parts[-1], '(.)\.[^.]*$', '\1') as stem from a), c as (select *, (language = 'rust' and stem = 'mod') or (language in ('typescript', 'python') and stem in ('index', '__init__')) as idx from b)
select path, array_to_string(case when idx then parts[:-2] else list_concat(parts[:-2], [stem]) end, '.') as module, case language when 'java' then 'junit' when 'csharp' then 'dotnet' else language end as framework, regexp_replace(path, '/?[^/]*$', '') as parent, regexp_full_match(path, '(?:.*/)?core/[^/]*\.rs') as fits, regexp_matches(path, '^(src/core|app)(/|$)') as below from c""",
)
def path_scalars(spark: SparkSession, d: str) -> DataFrame:
    """Modules, frameworks, folders and patterns of paths."""
    f = table(spark, d, "files").where("path is not null and language is not null").select(S.clean_path(F.col("path")).alias("path"), "language").distinct()
    p = F.col("path")
    return f.select("path", S.module_name(p, F.col("language")).alias("module"), S.test_framework(F.col("language")).alias("framework"), S.parent_path(p).alias("parent"), p.rlike(S.glob_regex("**/core/*.rs")).alias("fits"), S.matches_any(p, ["src/core/*", "app"]).alias("below"))


@query("severities", "select distinct o_orderpriority as text, case lower(trim(split_part(o_orderpriority, '-', 2))) when 'low' then 'info' when 'medium' then 'warning' else 'error' end as severity from orders")
def severities(spark: SparkSession, d: str) -> DataFrame:
    """Severities of texts in any case, unknown ones being errors."""
    o = table(spark, d, "orders").select("o_orderpriority").distinct()
    word = F.split_part("o_orderpriority", F.lit("-"), F.lit(2))
    named = F.when(word == "LOW", " Info ").when(word == "MEDIUM", "WARN").otherwise(word)
    return o.select(F.col("o_orderpriority").alias("text"), S.severity(named).alias("severity"))


@query(
    "visibilities",
    "with t as (select file_id, unnest(string_split(content, chr(10))) as line from file_texts where content is not null), n as (select ltrim(line, ' ') as s from t) select case when starts_with(s, 'pub(') then 'crate' when starts_with(s, 'protected internal ') then 'protected' when starts_with(s, 'private protected ') then 'private' when starts_with(s, 'pub ') or starts_with(s, 'public ') or starts_with(s, 'export ') or starts_with(s, 'open ') then 'public' when starts_with(s, 'private ') or starts_with(s, 'fileprivate ') then 'private' when starts_with(s, 'protected ') then 'protected' when starts_with(s, 'internal ') then 'package' else 'unknown' end as visibility, count(*) as n from n group by 1",
)
def visibilities(spark: SparkSession, d: str) -> DataFrame:
    """Visibilities of all lines of all texts."""
    lines = table(spark, d, "file_texts").where("content is not null").select(F.explode(F.split("content", "\n")).alias("line"))
    return lines.groupBy(S.visibility(F.col("line")).alias("visibility")).agg(F.count("*").alias("n"))


@query("bug_fix_subjects", r"select o_orderkey, regexp_matches(o_orderpriority || ': ' || o_orderstatus, '(?i)^\s*(5-low)($|[:!(\s])') as fix from orders")
def bug_fix_subjects(spark: SparkSession, d: str) -> DataFrame:
    """Subjects that announce a fix: the word in any case before a mark, a blank or the end."""
    o = table(spark, d, "orders")
    subject = F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("  HotFix: "), "o_orderstatus")).otherwise(F.concat(F.lit("fixture "), "o_orderstatus"))
    return o.select("o_orderkey", S.is_bug_fix(subject).alias("fix"))


@query("alias_targets", "select distinct case when starts_with(to_module, 'src.core.') then 'lib/core/' || substr(to_module, 10) when to_module = 'app.core' then 'packages/app/index' when starts_with(to_module, 'src.') then 'lib/' || substr(to_module, 5) else to_module end as target from module_edges where to_module is not null")
def alias_targets(spark: SparkSession, d: str) -> DataFrame:
    """Import targets rewritten by aliases, the longest pattern first."""
    pairs = manifests.aliases('{"compilerOptions": {"baseUrl": ".", "paths": {"src.*": ["lib/*"], "src.core.*": ["./lib/core/*"], "app.core": ["packages/app/index"]}}}')
    return table(spark, d, "module_edges").where("to_module is not null").select(manifests.rewritten(F.col("to_module"), pairs).alias("target")).distinct()


@query("include_roots", r"with p as (select distinct replace(path, '\', '/') as path from files where language in ('c', 'cpp')) select distinct string_split(path, '/')[1] as root from p where contains(path, '/')")
def include_roots(spark: SparkSession, d: str) -> DataFrame:
    """Top folders of C and C++ files."""
    return manifests.include_roots(table(spark, d, "files").withColumn("path", S.clean_path(F.col("path"))))


# --- logs, stores and reports


@query("commit_log_parse", "select o_orderkey::varchar as commit_id, o_custkey || '@x' as author, epoch(o_orderdate)::bigint as ts, o_orderpriority || '|' || o_orderstatus as subject, (select count(distinct l_partkey) from lineitem where l_orderkey = o_orderkey) as files from orders")
def commit_log_parse(spark: SparkSession, d: str) -> DataFrame:
    """Commits and their files from a log as text, one log per customer; subjects hold bars."""
    o = table(spark, d, "orders")
    head = F.concat(F.lit("commit:"), F.concat_ws("|", F.col("o_orderkey"), F.concat("o_custkey", F.lit("@x")), F.unix_seconds(F.col("o_orderdate").cast("timestamp")), "o_orderpriority", "o_orderstatus"))
    heads = o.select(F.col("o_custkey").alias("log"), F.struct("o_orderkey", F.lit(0).cast("long")).alias("at"), head.alias("value"))
    touched = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("part")).distinct().join(o.select("o_orderkey", "o_custkey"), "o_orderkey")
    lines = heads.unionByName(touched.select(F.col("o_custkey").alias("log"), F.struct("o_orderkey", F.col("part") + 1).alias("at"), F.concat(F.lit(" part/"), "part").alias("value")))
    commits, files = commit_log.parse(lines, "at", log="log")
    return commits.join(files.groupBy("commit_id").agg(F.count("*").alias("files")), "commit_id", "left").select("commit_id", "author", "ts", "subject", F.coalesce("files", F.lit(0)).alias("files"))


def new_store(spark: SparkSession) -> Store:
    """An empty store in the shared folder."""
    return Store(spark, f"{shared_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}")


@query("store_csv_import", "select n_nationkey, n_name, n_regionkey from nation where n_name is not null")
def store_csv_import(spark: SparkSession, d: str) -> DataFrame:
    """A CSV file with a header, imported with inferred types, beside a saved table."""
    s = new_store(spark)
    table(spark, d, "nation").write.csv(f"{s.path}/.csv", header=True)
    s.save({"region": table(spark, d, "region")}, "x", 1)
    return s.import_csv("nation", f"{s.path}/.csv")


@query("store_summary", "select * from (values ('meta', 1, 5), ('nation', (select count(*) from nation), 3), ('region', (select count(*) from region), 2)) t(\"table\", rows, columns)")
def store_summary(spark: SparkSession, d: str) -> DataFrame:
    """Tables of a store with rows and columns; a table that is overwritten while it is read keeps its rows."""
    s = new_store(spark)
    s.save({"region": table(spark, d, "region"), "nation": table(spark, d, "nation")}, "x", 1)
    s.write("nation", s.owned("nation"))
    return s.summary()


@query("store_trend", "with h as (select snapshot_id, count(*) as hotspots from trend_hotspots where snapshot_id is not null group by 1), s as (select distinct snapshot_id from snapshots where snapshot_id is not null) select snapshot_id, coalesce(hotspots, 0) as hotspots from s left join h using (snapshot_id)")
def store_trend(spark: SparkSession, d: str) -> DataFrame:
    """Trend samples joined with their hotspots, appended in two steps."""
    s = new_store(spark)
    s.append("trend_health", table(spark, d, "snapshots").where("snapshot_id is not null").select(F.lit(1).cast("long").alias("timestamp"), "snapshot_id").distinct())
    h = table(spark, d, "trend_hotspots").where("snapshot_id is not null").select("snapshot_id", "path", "risk_score")
    s.append("trend_hotspots", h.where("risk_score > 100"))
    s.append("trend_hotspots", h.where("risk_score <= 100 or risk_score is null"))
    # Counts alone: the arrays of samples are bounded by the ten rows a sample saves.
    rows = s.read("trend_hotspots").groupBy("snapshot_id").agg(F.count("*").alias("hotspots"))
    return s.read("trend_health").join(rows, "snapshot_id", "left").select("snapshot_id", F.coalesce("hotspots", F.lit(0)).alias("hotspots"))


@query("saved_imports", "select from_module as target, coalesce(edges, -1) as resolved_file, '' as alias from module_edges")
def saved_imports(spark: SparkSession, d: str) -> DataFrame:
    """Missing references as saved tables hold them."""
    e = table(spark, d, "module_edges").select(F.col("from_module").alias("target"), F.col("edges").alias("resolved_file"), F.lit(None).cast("string").alias("alias"))
    return saved("imports", e)


@query("language_csv", "select r_regionkey, r_name from region")
def language_csv(spark: SparkSession, d: str) -> DataFrame:
    """Tables written and read by programs, as CSV with given types."""
    path = f"{shared_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    e = prefix.engine(spark, {"region": table(spark, d, "region")})
    e.rows(f'(.csv.write region "{path}")').count()
    return e.rows(f"(.csv.read ['I32 'STR] \"{path}\")")


@query("language_splayed", "select n_regionkey, count(*) as n from nation group by 1")
def language_splayed(spark: SparkSession, d: str) -> DataFrame:
    """A table set to disk and got back by programs."""
    path = f"{shared_dir(spark).rstrip('/')}/splayed-{uuid.uuid4().hex}"
    e = prefix.engine(spark, {"nation": table(spark, d, "nation")})
    e.rows(f'(.db.splayed.set "{path}" nation)').count()
    return e.rows(f'(select {{n: (count n_name) from: (.db.splayed.get "{path}") by: n_regionkey}})')


@query("tsv_rows", "select n_nationkey || chr(9) || n_name || chr(9) || n_regionkey as value from nation")
def tsv_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows as text."""
    return reports.tsv(table(spark, d, "nation"))


# --- trends

SAMPLES = """s as (select snapshot_id, epoch(taken_at)::bigint as timestamp, file_count % 97 as score, call_count % 13 as rules, (file_count % 1000) / 1000.0::double as modularity, (function_count % 1000) / 1000.0::double as acyclicity, (import_count % 1000) / 1000.0::double as depth, (call_count % 1000) / 1000.0::double as equality, 0.5::double as redundancy, 0.0::double as structural_uniformity
  from (select distinct * from snapshots where snapshot_id is not null and taken_at is not null and file_count is not null and function_count is not null and import_count is not null and call_count is not null))"""
COLUMNS = ["score", "rules", *trend.DIMENSIONS]
WINDOWED = SAMPLES + ", w as (select * from s where timestamp >= (select max(timestamp) from s) - 7776000)"


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots as samples of health, their shares taken from their counts."""
    s = table(spark, d, "snapshots").where("snapshot_id is not null and taken_at is not null and file_count is not null and function_count is not null and import_count is not null and call_count is not null").distinct()
    share = lambda c: ((F.col(c) % 1000) / 1000.0).cast("double")
    return s.select(
        "snapshot_id", F.unix_seconds(F.col("taken_at").cast("timestamp")).alias("timestamp"), (F.col("file_count") % 97).alias("score"), (F.col("call_count") % 13).alias("rules"),
        share("file_count").alias("modularity"), share("function_count").alias("acyclicity"), share("import_count").alias("depth"), share("call_count").alias("equality"), F.lit(0.5).alias("redundancy"), F.lit(0.0).alias("structural_uniformity"),
    )


def recent(spark: SparkSession, d: str) -> DataFrame:
    """The samples of the last ninety days before the newest."""
    s = samples(spark, d)
    return trend.in_window(s, "90d", s.agg(F.max("timestamp")).first()[0])


ENDS = ", ".join(f"arg_min({c}, (timestamp, snapshot_id)) as first_{c}, arg_max({c}, (timestamp, snapshot_id)) as last_{c}" for c in COLUMNS)
query("trend_first_last", f"with {WINDOWED}, e as (select count(*) as samples, {ENDS} from w) select *, " + ", ".join(f"round((last_{c} - first_{c})::double * 1000) / 1000 as delta_{c}" for c in COLUMNS) + " from e")(lambda spark, d: trend.first_last(recent(spark, d), COLUMNS))
query(
    "drift_dimensions",
    f"with {WINDOWED}, e as (select count(*) as samples, {ENDS} from w), u as (" + " union all ".join(f"select '{c}' as dimension, first_{c}::double as before, last_{c}::double as after from e where samples >= 2" for c in COLUMNS) + "), v as (select *, round((after - before) * 1000) / 1000 as delta from u) select * from v where case when dimension = 'rules' then delta > 0 else delta < 0 end",
)(lambda spark, d: trend.worsened(recent(spark, d)))
RULES = ", r as (select snapshot_id, split_part(from_module, '.', 1) as rule_id, count(*) as count from module_edges where from_module is not null group by 1, 2)"


def violations(spark: SparkSession, d: str) -> DataFrame:
    """Module edges by top folder as broken rules of snapshots."""
    e = table(spark, d, "module_edges").where("from_module is not null")
    return e.groupBy("snapshot_id", F.split_part("from_module", F.lit("."), F.lit(1)).alias("rule_id")).agg(F.count("*").alias("count"))


query("trend_top_rules", f"with {SAMPLES}{RULES} select rule_id, sum(count)::bigint as count from r group by 1 order by 2 desc, 1 limit 5")(lambda spark, d: trend.top_rules(violations(spark, d)))
query("trend_top_hotspot_paths", "select path, max(risk_score) as risk_score from trend_hotspots where risk_score is not null group by 1 order by 2 desc, 1 limit 5")(lambda spark, d: trend.top_hotspots(table(spark, d, "trend_hotspots").where("risk_score is not null")))
query(
    "drift_rules",
    f"with {WINDOWED}{RULES}, k as (select arg_min(snapshot_id, (timestamp, snapshot_id)) as a, arg_max(snapshot_id, (timestamp, snapshot_id)) as b from w), h as (select rule_id, max(count) filter (snapshot_id = a) as x, max(count) filter (snapshot_id = b) as y from r, k where snapshot_id in (a, b) group by 1) "
    "select rule_id, coalesce(x, 0) as before, y as after, y - coalesce(x, 0) as delta, x is null as is_new from h where y is not null and y - coalesce(x, 0) > 0 order by delta desc, rule_id limit 5",
)(lambda spark, d: trend.risen(recent(spark, d), violations(spark, d), "rule_id", "count"))
query("trend_health_view", f"with {SAMPLES} select timestamp, snapshot_id, score, rules from s order by timestamp desc, snapshot_id desc limit 20")(lambda spark, d: trend.health_view(samples(spark, d)).select("timestamp", "snapshot_id", "score", "rules"))
query("trend_rules_view", f"with {SAMPLES}{RULES} select s.timestamp, snapshot_id, rule_id, count from s join r using (snapshot_id) order by timestamp, snapshot_id, count desc, rule_id limit 20")(lambda spark, d: trend.rules_view(samples(spark, d), violations(spark, d)))

# --- rules of facts


def _database(spark: SparkSession, d: str) -> datalog.Datoms:
    v = datalog.Var
    near = edges(spark, d).where("src like 'lib.%' and dst like 'lib.%'")
    return datalog.Datoms.from_edges(near, "edge").with_rules(
        datalog.Rule(datalog.Atom("reaches", [v("?a"), v("?b")]), [datalog.Atom(":edge", [v("?a"), v("?b")])]),
        datalog.Rule(datalog.Atom("reaches", [v("?a"), v("?c")]), [datalog.Atom("reaches", [v("?a"), v("?b")]), datalog.Atom(":edge", [v("?b"), v("?c")])]),
        datalog.Rule(datalog.Atom("affects", [v("?a"), v("?b")]), [datalog.Atom("reaches", [v("?b"), v("?a")])]),
    )


LIB = f"with recursive {EDGES}, l as (select * from e where starts_with(src, 'lib.') and starts_with(dst, 'lib.')), r(a, b) as (select src, dst from l union select r.a, l.dst from r join l on l.src = r.b)"
query("datalog_cycles", LIB + ' select distinct a as "?a" from r where a = b')(lambda spark, d: _database(spark, d).query(["?a"], [datalog.Atom("reaches", [datalog.Var("?a"), datalog.Var("?a")])]))
query("datalog_affects", LIB + ' select distinct b as "?a", a as "?b" from r where a < b')(lambda spark, d: _database(spark, d).query(["?a", "?b"], [datalog.Atom("affects", [datalog.Var("?a"), datalog.Var("?b")])]).where("`?b` < `?a`"))
query("datalog_wildcard", LIB + ' select distinct src as "?a" from l')(lambda spark, d: _database(spark, d).query(["?a"], [datalog.Atom(":edge", [datalog.Var("?a"), datalog.Var("_")])]))


@query("datalog_facts", "select * from (values ('b'), ('c')) t(\"?x\")")
def datalog_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts asserted and retracted one by one."""
    db = datalog.Datoms.empty(spark)
    for e, v in (("a", "b"), ("a", "c"), ("a", "d"), ("z", "q")):
        db = db.assert_fact(e, "to", v)
    return db.retract_fact("a", "to", "d").query(["?x"], [datalog.Atom(":to", ["a", datalog.Var("?x")])])


# --- graphs

query("graph_expand", f"with recursive {EDGES}, r(node, depth) as (select 'src.core', 0 union select e.dst, r.depth + 1 from r join e on e.src = r.node where r.depth < 3) select node, min(depth)::int as depth from r group by 1 having min(depth) >= 2")(lambda spark, d: graph.reach(edges(spark, d), spark.createDataFrame([("src.core",)], "node string"), 2, 3))
WEIGHTED = "we as (select from_module as src, to_module as dst, sum(edges)::double as w from module_edges where from_module is not null and to_module is not null group by 1, 2 having sum(edges) is not null)"


def weighted(spark: SparkSession, d: str) -> DataFrame:
    """Module edges with their summed counts."""
    g = table(spark, d, "module_edges").groupBy("from_module", "to_module").agg(F.sum("edges").alias("n")).where("n is not null")
    return graph.build(g, "from_module", "to_module", "n")


def _relaxed(rounds: int) -> str:
    parts = [f"with {WEIGHTED}, d0 as (select 'src.core' as node, 0.0::double as x)"]
    parts += [f"d{i + 1} as materialized (select node, min(x) as x from (select * from d{i} union all select dst, x + w from d{i} join we on src = node) group by 1)" for i in range(rounds)]
    return ", ".join(parts) + f" select node, round(x, 6) as distance from d{rounds}"


query("graph_dijkstra", _relaxed(24))(lambda spark, d: graph.shortest(weighted(spark, d), spark.createDataFrame([("src.core",)], "node string"), "weight").select("node", F.round("distance", 6).alias("distance")))
query("graph_shortest_path", f"with recursive {EDGES}, r(node, depth) as (select 'src.core', 0 union select e.dst, r.depth + 1 from r join e on e.src = r.node where r.depth < 12), m as (select node, min(depth) as depth from r group by 1), b(node, depth) as (select node, depth from m where node = 'lib.core.model' union all select (select min(e.src) from e join m on m.node = e.src where e.dst = b.node and m.depth = b.depth - 1), b.depth - 1 from b where b.depth > 0) select depth::int as step, node from b")(
    lambda spark, d: graph.shortest_path(edges(spark, d), "src.core", "lib.core.model")
)
query("graph_k_shortest", f"with recursive {EDGES}, p(node, path) as (select 'src.core', ['src.core'] union all select e.dst, list_append(path, e.dst) from p join e on e.src = p.node where len(path) < 4 and not list_contains(path, e.dst) and p.node <> 'app.core.model') select row_number() over (order by len(path), path) as rank, len(path) - 1 as length, array_to_string(path, '>') as path from p where node = 'app.core.model' order by len(path), p.path limit 5")(
    lambda spark, d: graph.k_shortest(edges(spark, d), "src.core", "app.core.model", 5).withColumn("path", F.array_join("path", ">"))
)
query("graph_closeness", f"with recursive {EDGES}, r(a, node, depth) as (select src, dst, 1 from e union select r.a, e.dst, r.depth + 1 from r join e on e.src = r.node where r.depth < 14), m as (select a, node, min(depth) as depth from r where a <> node group by 1, 2), n as (select src as node from e union select dst from e) select n.node as _node, round(coalesce(max(c), 0.0), 9) as _closeness from n left join (select a, count(*)::double / sum(depth) as c from m group by 1) q on q.a = n.node group by 1")(
    lambda spark, d: graph.closeness(edges(spark, d)).withColumn("_closeness", F.round("_closeness", 9))
)
ORACLE["spanning_forest"] = f"with recursive {WEIGHTED}, ue as (select least(src, dst) as src, greatest(src, dst) as dst, min(w) as weight from we where src <> dst group by 1, 2), r(a, b, w, node) as (select src, dst, weight, src from ue union select r.a, r.b, r.w, case when u.src = r.node then u.dst else u.src end from r join ue u on (u.src = r.node or u.dst = r.node) and (u.weight, u.src, u.dst) < (r.w, r.a, r.b)) select src, dst, weight from ue where not exists (select 1 from r where a = src and b = dst and node = dst)"


def _peeled(rounds: int) -> str:
    parts = [f"with {EDGES}, every as (select src as node from e union select dst from e), e0 as (select src, dst from e), l0 as (select node, 0 as level from every), p0 as (select node from every where false)"]
    for i in range(rounds):
        parts.append(
            f"f{i} as materialized (select l.node, level from l{i} l where l.node not in (select dst from e{i}) and l.node not in (select node from p{i})), "
            f"l{i + 1} as materialized (select l.node, greatest(level, coalesce(up, level)) as level from l{i} l left join (select dst as node, max(f.level) + 1 as up from e{i} join f{i} f on f.node = src group by 1) u on u.node = l.node), "
            f"e{i + 1} as materialized (select * from e{i} where src not in (select node from f{i})), p{i + 1} as materialized (select node from p{i} union select node from f{i})"
        )
    return ", ".join(parts)


ORACLE["levels_cyclic"] = _peeled(12) + " select node, level::int as level from l12"
query("topological_cyclic", _peeled(12) + ", o as (" + " union all ".join(f"select node, {i} as round from f{i}" for i in range(12)) + ") select node as _node, row_number() over (order by round, node) - 1 as _order from o")(lambda spark, d: graph.topological(edges(spark, d)))
query("graph_dfs")(lambda spark, d: graph.dfs(edges(spark, d), "src.core"))
query("graph_louvain")(lambda spark, d: graph.louvain(edges(spark, d)))
query("graph_betweenness")(lambda spark, d: graph.betweenness(edges(spark, d), edges(spark, d).where("src like 'lib.core%'").select(F.col("src").alias("node")).distinct()))
query("graph_random_walk")(lambda spark, d: graph.random_walk(edges(spark, d), spark.createDataFrame([("src.core",), ("app.core",)], "node string"), 8))


@query("vector_index")
def vector_index_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The ten rows nearest to one, by a saved index that is loaded again."""
    e = table(spark, d, "embeddings")
    path = f"{shared_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    vector_index.build(e, "vec_id", F.col("embedding")).save(path)
    first = e.where("vec_id = 0").select("embedding").first()[0]
    return vector_index.load(spark, path).nearest(first, 10).withColumn("_dist", F.round("_dist", 9))


@query("event_sessions", "with e as (select user_id, ts, case when lag(ts) over w is null or ts - lag(ts) over w >= interval 30 minute then 1 else 0 end as cut from events window w as (partition by user_id order by ts)), g as (select *, sum(cut) over (partition by user_id order by ts, cut desc rows unbounded preceding) as k from e) select user_id, min(ts) as start, max(ts) + interval 30 minute as \"end\", count(*) as n from g group by user_id, k")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of events without a gap, per user."""
    s = watch.sessions(table(spark, d, "events"))
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("event_hours", "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2")
def event_hours(spark: SparkSession, d: str) -> DataFrame:
    """Events per hour and type."""
    w = watch.event_windows(table(spark, d, "events"))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))
