import json

import pytest

from factlens.operators import baseline, datalog, facts, graph, rules, structure, trend, vector_index, whatif
from factlens.plans import fact_queries, reports, table_queries, tools
from factlens.plans.prefix import engine
from factlens.plans.reader import EvalError
from factlens.session import shared_dir
from factlens.sources import commit_log, plugins
from factlens.sources.config import Config, Limits, load
from factlens.sources.store import Store
from pyspark.sql import functions as F

BODY = "if a { for b { x(1, 2, 3) } } else { y }"


def small(spark):
    return facts.of(
        spark,
        files=[(i, p, "rust", p.split("/")[1].removesuffix(".rs"), 100 * (i + 1), 10, "h", 1) for i, p in enumerate(("src/a.rs", "src/b.rs", "src/c.rs", "lib/d.rs"))],
        imports=[(0, 0, "b", "use", "local", 1, None), (1, 1, "c", "use", "local", 2, None), (2, 2, "a", "use", "local", 0, None), (3, 3, "a", "use", "local", 0, "x"), (4, 0, "ext", "use", "unresolved", None, None)],
        functions=[(0, 0, "run", 1, 5, "public", BODY), (1, 1, "load", 1, 3, "unknown", BODY), (2, 2, "save", 1, 9, "unknown", "one")],
        calls=[(0, 0, 0, "load", 2), (1, 0, 0, "save", 3), (2, 1, 1, "save", 1), (3, 1, None, "zip", 1)],
        call_edges=[(0, 0, 0, 1), (1, 1, 0, 2), (2, 2, 1, 2)],
        types=[(0, 0, "T", True, 1, "public", ["B", "C"])],
        commits=[("h1", "ann", 86400, "fix: a"), ("h2", "bob", 2 * 86400, "b")],
        commit_files=[("h1", "src/a.rs"), ("h2", "src/a.rs"), ("h2", "src/b.rs")],
    )


def test_baseline_saved_and_asked(spark, tmp_path):
    f = small(spark)
    store = Store(spark, str(tmp_path / "s"))
    before = tools.TOOLS["baseline_save"](store, f, Config(), 10 * 86400, "s1")
    assert len(before) == 27 and len(store.names()) == 28
    assert len(before["health"].columns) == 48
    row = before["health"].first()
    assert (row["files"], row["functions"], row["imports"], row["unresolved_imports"], row["max_function_fan_in"]) == (4, 3, 5, 1, 2)
    assert row["coverage_score"] == 80 and row["structural_score"] == 100 - 60 - min(40, sum({"warning": 4, "error": 10}.get(r["severity"], 0) for r in before["rules"].collect()))
    ask = lambda name, text: tools.TOOLS["baseline_query"](store, name, text).collect()
    assert [tuple(r) for r in ask("arch_cycles", "(select {from: t asc: cycle_id})")] == [(0, "src/a.rs", 1), (1, "src/b.rs", 1), (2, "src/c.rs", 1)]
    assert [tuple(r) for r in ask("inheritance", "(select {from: t asc: base})")] == [(0, "T", "B"), (0, "T", "C")]
    assert {r["resolved_file"] for r in ask("imports", "t")} == {0, 1, 2, -1} and {r["caller_function"] for r in ask("calls", "t")} == {0, 1, -1}
    assert ask("changed_files", "(select {from: t desc: commits take: 1})")[0][0] == "src/a.rs"
    assert ask("temporal_hotspots", "(count t)")[0][0] == 2 and ask("trend_violations", "(sum (at t 'count))")[0][0] == before["rules"].count()
    after = baseline.tables(whatif.remove_edge(f, 2, 0), Config(), 11 * 86400, "s2")
    d = baseline.deltas(before, after).first()
    assert (d["import_count_delta"], d["file_count_delta"], d["coverage_score_delta"]) == (-1, 0, -5) and d["structural_score_delta"] > 0
    got = {(r["kind"], r["change"]) for r in baseline.changes(before, after).collect()}
    assert ("rule", "removed") in got and ("module_edge", "removed") in got
    same = tools.TOOLS["baseline_diff"](before, before)
    assert same["changes"].count() == 0 and set(same["deltas"].first().asDict().values()) == {0}


def test_empty_facts(spark):
    f = facts.of(spark)
    made = baseline.tables(f, Config(), 1, "s")
    row = made["health"].first()
    assert row["files"] == 0 and row["coverage_score"] == 100 and made["arch_cycles"].count() == 0
    assert structure.complexity_summary(structure.complexity(f)).first()["max_complexity"] == 0
    assert rules.rule_counts(rules.findings(f, Config())).count() >= 0


def test_levels_of_queries_have_ended(spark):
    """The SQL of levels peels a fixed number of rounds: no round is left in the largest test table."""
    d = "/root/testdata/sf0.1"
    e = structure.file_edges(fact_queries.facts(spark, d))
    rounds = graph.topological(e).count()
    top = graph.levels(e).agg(F.max("level")).first()[0]
    assert rounds > 0 and top < fact_queries.ROUNDS


def test_depth_first_order_and_louvain(spark):
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (4, 1), (3, 5), (9, 1), (None, 2)], "src long, dst long")
    assert [r["_node"] for r in graph.dfs(e, 1).orderBy("_order").collect()] == [1, 2, 4, 3, 5]
    assert [r["_depth"] for r in graph.dfs(e, 1).orderBy("_order").collect()] == [0, 1, 2, 1, 2]
    ring = lambda at: [(at + i, at + j) for i in range(5) for j in range(i)]
    two = spark.createDataFrame([*ring(0), *ring(10), *ring(20), (0, 10), (10, 20)], "src long, dst long")
    got = {r["_node"]: r["_community"] for r in graph.louvain(two).collect()}
    assert {frozenset(n for n in got if got[n] == c) for c in set(got.values())} == {frozenset(range(a, a + 5)) for a in (0, 10, 20)}
    assert set(got.values()) == {0, 10, 20}
    assert graph.louvain(two.limit(0)).count() == 0


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_vector_index(spark, metric):
    import numpy as np

    x = np.random.default_rng(3).normal(size=(600, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r], None) for i, r in enumerate(x)] + [(None, [0.0] * 8, 1), (700, None, 1)], "id long, v array<double>, _cell int")
    path = f"{shared_dir(spark)}/test-index-{metric}"
    vector_index.build(df, "id", F.col("v"), metric).save(path)
    index = vector_index.load(spark, path)
    assert index.info()["n"] == 600 and index.info()["dims"] == 8 and index.info()["cells"] > 1
    q = [float(v) for v in x[5]]
    dist = {"cosine": 1 - x @ x[5] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[5]), "l2": np.linalg.norm(x - x[5], axis=1), "ip": -(x @ x[5])}[metric]
    true = np.argsort(dist, kind="stable")[:10].tolist()
    assert [r["_rowid"] for r in index.nearest(q, 10, index.info()["cells"]).collect()] == true
    assert len({r["_rowid"] for r in index.nearest(q, 10).collect()} & set(true)) >= 6
    assert vector_index.build(df.limit(0), "id", F.col("v")).info()["n"] == 0


def test_index_forms_and_timer(spark):
    e = engine(spark)
    path = f"{shared_dir(spark)}/forms-index"
    text = f'(do (set V (list [0.1 0.2] [0.9 0.1] [0.12 0.22])) (set Idx (hnsw-build V)) (hnsw-save Idx "{path}") (ann (hnsw-load "{path}") [0.1 0.21] 2))'
    assert [r["_rowid"] for r in e.rows(text).collect()] == [0, 2] or {r["_rowid"] for r in e.rows(text.replace("forms-index", "forms-again")).collect()} == {0, 2}
    assert e.rows("(timer 1 3 (fn [i] (+ i 1)))").first()[0] == 3
    with pytest.raises(EvalError):
        e.rows("(ann [1 2] [1 2] 1)")


def test_sarif_and_health_text(spark):
    rows = [("warning", "b", "/r/x.rs", "first"), ("error", "a", "/r", "m"), ("info", "b", "/rx/y.rs", "second")]
    doc = json.loads(reports.sarif(spark.createDataFrame(rows, "severity string, code string, path string, message string"), root="/r/", properties={"score": 3}))
    run = doc["runs"][0]
    assert [(r["id"], r["name"], r["fullDescription"]["text"], r["defaultConfiguration"]["level"]) for r in run["tool"]["driver"]["rules"]] == [("b", "b", "first", "warning"), ("a", "a", "m", "error")]
    assert [r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] for r in run["results"]] == ["x.rs", ".", "/rx/y.rs"]
    assert run["properties"] == {"score": 3} and reports.health_text({"grade_overall": "A", "score": 1}) == "score: 1\ngrade_overall: A\n"


def test_plugins(tmp_path):
    c = plugins.added(Config(), "go", ["go"])
    c = plugins.added(c, "go", ["go2"])
    assert [p["extensions"] for p in c.plugins] == [["go2"]]
    with pytest.raises(ValueError):
        plugins.added(c, "x")
    full = plugins.with_standard(c)
    assert len(full.plugins) == len(plugins.standard()) and next(p for p in full.plugins if p["name"] == "go")["function_prefixes"] == ["func "]
    assert plugins.removed(full, "GO")[1] == 1
    folder = plugins.scaffold(str(tmp_path), "mine", ".my")
    assert plugins.validate(folder)["valid"] and not plugins.validate(str(tmp_path))["valid"]
    with pytest.raises(ValueError):
        plugins.scaffold(str(tmp_path), "mine", "my")
    written, skipped = plugins.sync(str(tmp_path), ["zig", "nim"])
    assert len(written) == 2 and not skipped and len(plugins.sync(str(tmp_path), ["zig"])[1]) == 1
    assert [p["name"] for p in plugins.load_folder(str(tmp_path))] == ["mine", "nim", "zig"]
    path = tools.TOOLS["config_write"](full, str(tmp_path / "c.toml"))
    assert tools.TOOLS["config_read"](open(path).read()).plugins == full.plugins
    assert load((tmp_path / "c.toml").read_text()).limits == Limits()


def test_all_tools_are_there():
    """Every tool of the surface has a function."""
    names = "config_read config_write health scan edges hotspots rules module_edges architecture coupling cycles hottest blast_radius level session_start session_end rescan check_rules policy_check evolution dsm test_gaps visualize sarif plugins standard_plugins plugin_add plugin_add_standard plugin_remove plugin_validate plugin_scaffold plugin_sync remediations what_if break_cycle_recommendations trend drift policy_presets policy_init memory_summary baseline_save baseline_diff baseline_tables baseline_table_read baseline_query baseline_import_csv"
    assert set(names.split()) == set(tools.TOOLS)


def test_scan_tools(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("import src.b\n\ndef f():\n    return g()\n")
    (tmp_path / "src" / "b.py").write_text("def g():\n    return 1\n")
    got = tools.TOOLS["rescan"](spark, str(tmp_path), Config())
    assert got["facts"].imports.first()["resolved_file"] == 1 and got["scores"].first()["score"] > 0
    page = tools.TOOLS["visualize"](got["facts"])
    assert page.count("<div") == 2 and "a.py" in page


def test_cycle_breaks_and_atoms_without_a_shared_variable(spark):
    got = whatif.cycle_breaks(small(spark)).collect()
    assert [(r["src"], r["dst"], r["reduction"]) for r in got] == [(0, 1, 3), (1, 2, 3), (2, 0, 3)]
    v, a = datalog.Var, datalog.Atom
    db = datalog.Datoms.from_edges(spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "src string, dst string"), "to")
    assert {r[0] for r in db.query(["?p"], [a(":to", [v("?p"), v("?q")]), a(":to", ["x", "y"]), a(":to", [v("?q"), v("?r")])]).collect()} == {"a"}
    assert db.query(["?p"], [a(":to", [v("?p"), v("?q")]), a(":to", ["x", "z"])]).count() == 0
    with pytest.raises(ValueError):
        db.query(["?p"], [a(":to", [v("?p"), v("?q")]), a(":to", [v("?s"), v("?t")])])


def test_logs_and_views(spark, tmp_path):
    (tmp_path / "log.txt").write_text("commit:h1|ann|10|fix: a | b\n\nroot/src/a.rs\ncommit:h2|bob|20|feat\n\nroot/src/a.rs\nother/x\ncommit:h3|bob|5|old\n\nroot/y\n")
    c, f = commit_log.read(spark, str(tmp_path / "log.txt"), "root", 2)
    assert {r["commit_id"] for r in c.collect()} == {"h1", "h2"} and sorted((r["commit_id"], r["path"]) for r in f.collect()) == [("h1", "src/a.rs"), ("h2", "src/a.rs")]
    s = spark.createDataFrame([("s1", 1, 5), ("s2", 2, 6)], "snapshot_id string, timestamp long, score long")
    h = spark.createDataFrame([("s1", "a", 3), ("s2", "a", 9), ("s2", "b", 1)], "snapshot_id string, path string, risk_score long")
    assert [r["snapshot_id"] for r in trend.health_view(s).collect()] == ["s2", "s1"]
    assert [(r["snapshot_id"], r["path"]) for r in trend.hotspots_view(s, h).collect()] == [("s1", "a"), ("s2", "a"), ("s2", "b")]
    assert table_queries.COLUMNS[:2] == ["score", "rules"]
