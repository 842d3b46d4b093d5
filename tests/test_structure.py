import pytest

from factlens.functions import scalars as S
from factlens.operators import evolution, facts, rules, structure, trend, whatif
from factlens.operators.diff import added_rules, keyed_diff
from factlens.sources.config import Config, Limits, dump, load
from pyspark.sql import functions as F


def file(i, path, language="rust", module=None, lines=10):
    return (i, path, language, module if module is not None else path.rsplit(".", 1)[0].replace("/", "."), lines, lines * 10, f"h{i}", 1)


def imp(i, a, b, resolution="local"):
    return (i, a, "t", "use", resolution, b, None)


@pytest.fixture(scope="module")
def cyclic(spark):
    return facts.of(spark, files=[file(0, "a.rs"), file(1, "b.rs"), file(2, "c.rs")], imports=[imp(0, 0, 1), imp(1, 1, 0), imp(2, 2, 1)])


def test_graph_metrics(cyclic):
    r = structure.graph_metrics(cyclic).first()
    assert (r["edge_count"], r["resolved_edge_count"], r["cycle_count"], r["max_fan_in"], r["max_fan_out"]) == (3, 3, 2, 2, 1)
    assert [x["path"] for x in structure.hotspots(cyclic).collect()] == ["b.rs", "a.rs", "c.rs"]


@pytest.mark.parametrize("counts,bits,normal", [([], 0, 0), ([0, 0, 0], 0, 0), ([10], 0, 0), ([10, 0], 0, 0), ([5, 5], 1, 1), ([3, 3, 3, 3], 2, 1)])
def test_entropy(spark, counts, bits, normal):
    r = structure.entropy(spark.createDataFrame([(c,) for c in counts], "n long")).first()
    assert (r["bits"], r["normalised"]) == (bits, normal)


def test_gini(spark):
    g = lambda v: structure.gini(spark.createDataFrame([(x,) for x in v], "v double"), "v").first()[0]
    assert g([1.0, 1.0, 1.0]) == 0 and g([]) == 0 and g([0.0, 0.0]) == 0 and g([0.0, 1.0]) == 0.5


def test_whatif(cyclic):
    after = whatif.break_cycle(cyclic, 0, 1)
    assert structure.graph_metrics(after).first()["cycle_count"] == 0 and after.imports.count() == 2
    assert [(r["src"], r["dst"], r["reduction"]) for r in whatif.cycle_breaks(cyclic).collect()] == [(0, 1, 2), (1, 0, 2)]
    assert whatif.remove_file(cyclic, 1).imports.count() == 0
    moved = whatif.move_file(cyclic, 2, "src/x/c.rs").files.where("file_id = 2").first()
    assert (moved["path"], moved["module"]) == ("src/x/c.rs", "src.x.c")
    for bad in ([("remove_edge", 2, 0)], [("move_file", 2, "a.rs")], [("add_edge", 0, 1)], [("break_cycle", 2, 1)]):
        with pytest.raises(whatif.WhatIfError, match="step 0"):
            whatif.sequence(cyclic, bad)


def test_violations_and_cohesion(spark, cyclic):
    from factlens.operators import graph

    two = facts.of(spark, files=[file(0, "src/a/x.rs"), file(1, "src/a/y.rs"), file(2, "src/a/z.rs")], imports=[imp(0, 0, 1), imp(1, 1, 0)])
    e = structure.file_edges(two)
    found = structure.violations(two, graph.levels(e))
    assert sorted(r["reason"] for r in found.collect()) == ["cycle_edge", "cycle_edge"]
    r = structure.cohesion(two, Config(module_roots=["src"])).first()
    assert tuple(r) == (0.5, 1)


def test_rules_and_scores(spark, cyclic):
    found = rules.findings(cyclic, Config(limits=Limits(high_file_fan_in=2, max_file_lines=5)))
    codes = [r["code"] for r in found.collect()]
    assert codes == ["max_cycles", "max_file_lines", "max_file_lines", "max_file_lines", "high_fan_in"]
    assert rules.check_exit(found) == 1
    assert rules.remediations(found, structure.test_gaps(cyclic, Config())).count() == 5
    s = structure.scores(cyclic, Config()).first()
    assert s["acyclicity"] == pytest.approx(0.333) and 0 < s["quality_signal"] <= 10000


def test_complexity(spark):
    body = "fn f() {\n    if a && b {\n        for x in y { g(x)?; }\n    } // if else while\n    \"if if\"\n}"
    df = spark.createDataFrame([(body, "rust"), ("", "rust"), (None, "rust")], "body string, language string")
    r = df.select(S.lexical_complexity(F.col("body"), F.col("language")).alias("v"), S.cognitive_complexity(F.col("body"), F.col("language")).alias("c"), S.body_fingerprint(F.col("body")).alias("f")).collect()
    assert r[0]["v"] == 5 and r[0]["c"] == 2 + 1 + 3 and len(r[0]["f"]) == 16
    assert r[1]["v"] == 1 and r[1]["f"] is None and r[2]["v"] is None


def test_paths(spark):
    df = spark.createDataFrame([("src/app/x.py", "python"), ("crates/a/src/l.rs", "rust"), ("src/main/java/org/X.java", "java"), ("", "c")], "p string, l string")
    got = [r[0] for r in df.select(S.module_group(F.col("p"), F.col("l"), F.lit("top.x"))).collect()]
    assert got == ["app", "crates/a", "org", "top"]
    assert [r[0] for r in df.select(S.module_name(F.col("p"), F.col("l"))).collect()][0] == "src.app.x"
    tests = df.limit(1).select(S.expected_tests(F.col("p"), F.col("l"))).first()[0]
    assert "tests/test_x.py" in tests and "tests/app/x.py" in tests and tests == sorted(set(tests))


def test_evolution(spark):
    commits = [(f"c{i}", "ann" if i % 2 else "bob", 86400 * (i + 1), "fix: x" if i == 0 else "feat") for i in range(6)]
    files = [(f"c{i}", p) for i in range(5) for p in ("a", "b")] + [("c5", "c")]
    c, cf = spark.createDataFrame(commits, facts.SCHEMAS["commits"]), spark.createDataFrame(files, facts.SCHEMAS["commit_files"])
    assert [tuple(r) for r in evolution.change_coupling(cf).collect()] == [("a", "b", 5, 1.0)]
    own = {r["path"]: (r["top_author"], r["bus_factor"]) for r in evolution.bus_factors(c, cf).collect()}
    assert own == {"a": ("bob", 2), "b": ("bob", 2), "c": ("ann", 1)}
    ages = {r["path"]: (r["age_days"], r["last_changed_days"]) for r in evolution.file_ages(c, cf, 100 * 86400).collect()}
    assert ages["a"] == (99, 95)
    assert [r["path"] for r in evolution.bug_prone(c, cf).collect()] == ["a", "b"]
    wide = spark.createDataFrame([(f"w{j}", f"f{i}") for j in range(3) for i in range(51)], facts.SCHEMAS["commit_files"])
    assert evolution.change_coupling(wide).count() == 0 and evolution.changed_files(wide).first()["commits"] == 3


def test_trend(spark):
    cols = "timestamp long, snapshot_id string, score long, rules long, modularity double, acyclicity double, depth double, equality double, redundancy double, structural_uniformity double"
    h = spark.createDataFrame([(1, "s1", 80, 0, 0.9, 1.0, 1.0, 1.0, 1.0, 0.0), (2, "s2", 70, 1, 0.5, 1.0, 1.0, 1.0, 1.0, 0.0)], cols)
    hot = spark.createDataFrame([("s1", "big.rs", 50), ("s2", "big.rs", 200), ("s2", "new.rs", 24)], "snapshot_id string, path string, risk_score long")
    assert sorted(r["dimension"] for r in trend.worsened(h).collect()) == ["modularity", "rules", "score"]
    assert [tuple(r) for r in trend.risen(h, hot, "path", "risk_score").collect()] == [("big.rs", 50, 200, 150, False), ("new.rs", 0, 24, 24, True)]
    assert trend.worsened(h.limit(1)).count() == 0 and trend.in_window(h, "7d", 2 + 7 * 86400).count() == 1


def test_diff(spark):
    a = spark.createDataFrame([("x", 1), (None, 1), ("y", None)], "k string, v long")
    b = spark.createDataFrame([("x", 2), (None, 1), ("z", 3)], "k string, v long")
    assert {(r["k"], r["change"]) for r in keyed_diff(a, b, ["k"], ["v"]).collect()} == {("x", "changed"), ("y", "removed"), ("z", "added")}
    f = spark.createDataFrame([("c", "p", "m")], "code string, path string, message string")
    assert added_rules(f, f).count() == 0 and added_rules(f.limit(0), f).count() == 1


def test_config_round_trip():
    c = Config(limits=Limits(max_cycles=3), test_roots=["spec"])
    assert load(dump(c)).limits.max_cycles == 3 and load(dump(c)).test_roots == ["spec"]
    with pytest.raises(ValueError):
        load("[rules]\nnope = 1")
