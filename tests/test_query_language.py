import pytest

from factlens.plans.policies import PolicyResult, evaluate, exit_code
from factlens.plans.prefix import engine
from factlens.plans.reader import EvalError
from factlens.plans.typed_query import Filter, QueryError, Sort, TableQuery, counts, from_cli, from_json, run

ROWS = [(0, "src/small.c", "c", 10), (1, "src/mid.c", "c", 20), (2, "src/large.c", "c", 30), (3, "src/lib.rs", "rust", 40)]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(ROWS, "file_id long, path string, language string, lines long").cache()


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_project_filter_sort_page(files):
    q = TableQuery(["path", "lines"], [Filter("path", "ends_with", ".c")], sort=[Sort("lines", True)], offset=1, limit=1)
    assert rows(run(files, q)) == [("src/mid.c", 20)] and counts(files, q) == (4, 3)


def test_set_filters_and_two_keys(files):
    q = TableQuery(["path", "lines"], [Filter("language", "in", ["c", "rust"]), Filter("path", "not_in", ["src/small.c"])], sort=[Sort("language"), Sort("lines", True)])
    assert rows(run(files, q)) == [("src/large.c", 30), ("src/mid.c", 20), ("src/lib.rs", 40)]


def test_any_mode_and_patterns(files):
    q = TableQuery(["path"], [Filter("path", "eq", "src/small.c"), Filter("language", "eq", "rust")], "any", [Sort("path")])
    assert rows(run(files, q)) == [("src/lib.rs",), ("src/small.c",)]
    q = TableQuery(["path"], [Filter("path", "regex", r"^src/.*\.(c|rs)$"), Filter("path", "not_regex", "small")], sort=[Sort("path")])
    assert rows(run(files, q)) == [("src/large.c",), ("src/lib.rs",), ("src/mid.c",)]


@pytest.mark.parametrize("op,value,n", [("eq", "10", 0), ("ne", "10", 4), ("in", 10, 0), ("not_in", 10, 0), ("contains", 1, 0), ("regex", 5, 0), ("not_regex", 5, 4), ("gt", "2", 3), ("lte", 20, 2), ("eq", None, 0)])
def test_mixed_types(files, op, value, n):
    assert run(files, TableQuery(filters=[Filter("lines", op, value)])).count() == n


def test_errors_and_parsers(files):
    with pytest.raises(QueryError):
        run(files, TableQuery(["nope"]))
    with pytest.raises(QueryError):
        run(files, TableQuery(filters=[Filter("path", "regex", "(")]))
    q = from_cli(["lines:gt:15", "path:contains:a:b"], "path, lines", ["lines:desc", "path"], True)
    assert q.filters == [Filter("lines", "gt", 15), Filter("path", "contains", "a:b")] and q.sort == [Sort("lines", True), Sort("path", True)]
    assert from_json({"filters": [{"column": "a", "value": 1}], "sort": {"column": "a"}}).limit == 100
    with pytest.raises(QueryError):
        from_json({"limit": 0})


def test_nulls_empty_and_clashing_names(spark):
    df = spark.createDataFrame([(None, None, "x"), (1, "a", None)], "lines long, path string, `value` string")
    assert run(df, TableQuery(filters=[Filter("lines", "lt", 5)])).count() == 1
    assert run(df, TableQuery(filters=[Filter("path", "ne", "a")])).count() == 1
    assert run(df.limit(0), TableQuery(sort=[Sort("path")], limit=3)).count() == 0


def test_values(spark, files):
    e = engine(spark, {"t": files})
    assert rows(e.rows("(count t)")) == [(4,)]
    assert rows(e.rows("(at t (quote lines))")) == [(10,), (20,), (30,), (40,)]
    assert e.rows("t").count() == 4
    assert rows(e.rows("(at (dict [a b] (list 1 2)) 'b)")) == [(2,)]
    assert e.run("(do (set f (fn [x] (if (<= x 1) 1 (* x (self (- x 1)))))) (f 5))") == 120
    assert e.run("(cos-dist [.1 .2 .3 .4] [.15 .18 .32 .41])") == pytest.approx(0.004615, abs=1e-6)
    assert rows(e.rows("(knn (list [1 0] [0 1] [1 1]) [1 0] 2)"))[0] == (0, 0.0)


def test_select(spark, files):
    e = engine(spark, {"t": files})
    assert [r["path"] for r in e.rows('(select {from: t where: (== language "rust")})').collect()] == ["src/lib.rs"]
    assert rows(e.rows("(select {language: language n: (count path) from: t by: language desc: n})"))[0][-1] == 3
    assert rows(e.rows("(select {path: path from: t desc: lines take: 1})")) == [("src/lib.rs",)]
    assert rows(e.rows("(select {q: (div lines 0) from: t take: 1})")) == [(None,)]
    assert e.rows("(select {from: t where: (in path (at (select {from: t where: (> lines 25)}) 'path))})").count() == 2


@pytest.mark.parametrize("text,code", [("(select", "parse"), ("(nope 1)", "name"), ("(> 1)", "domain"), ("(+ 1 \"a\")", "type"), ("(at (dict [a] (list 1)) 'b)", "domain"), ("(select {from: t where: (> nope 1)})", "name")])
def test_error_codes(spark, files, text, code):
    with pytest.raises(EvalError) as e:
        engine(spark, {"t": files}).rows(text)
    assert e.value.code == code


def test_graph_and_datalog(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "a long, b long")
    e = engine(spark, {"t": edges})
    assert e.run("(.graph.info (.graph.build t 'a 'b))") == {"n_nodes": 4, "n_edges": 3, "has_weights": False}
    assert rows(e.rows("(select {from: (.graph.topsort (.graph.build t 'a 'b)) asc: _order})")) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    program = "(set Db (datoms)) (assert-fact Db 0 'edge 1) (assert-fact Db 1 'edge 2) (assert-fact Db 2 'edge 3) (rule (reaches ?x ?y) (?x :edge ?y)) (rule (reaches ?x ?z) (reaches ?x ?y) (?y :edge ?z)) (query Db (find ?b) (where (reaches 0 ?b)))"
    assert sorted(r[0] for r in e.rows(program).collect()) == ["1", "2", "3"]


def test_policies(spark, files):
    good = evaluate(spark, "p", '(select {severity: "warning" code: "test-rule" path: path message: "m" from: files where: (> lines 15)})', {"files": files})
    assert good.findings.count() == 3
    assert "code" in evaluate(spark, "p", "(select {path: path from: files})", {"files": files}).error
    error = evaluate(spark, "p", '(select {severity: "err" code: "c" path: path message: "m" from: files})', {"files": files})
    assert exit_code([good]) == 0 and exit_code([good, error]) == 2 and exit_code([error, PolicyResult("x", error="e")]) == 1
