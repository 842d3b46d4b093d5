import pytest

from factlens.plans import reports
from factlens.sources import commit_log, scan
from factlens.sources.store import SCHEMA_VERSION, Store, StoreError, check_name, column_digest
from factlens.streaming import watch


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "tables"))
    assert s.names() == []
    (tmp_path / "c.csv").write_text("path,covered_pct\nsrc/a.rs,42.0\nsrc/b.rs,87.5\n")
    df = s.import_csv("coverage", str(tmp_path / "c.csv"))
    assert [tuple(r) for r in df.where("covered_pct < 50").collect()] == [("src/a.rs", 42.0)]
    s.save({"files": spark.range(3)}, "snap", 1, manifest={"score": 90}, trend={"trend_health": spark.createDataFrame([("snap", 5)], "snapshot_id string, score long")})
    assert s.names() == ["coverage", "files", "meta", "trend_health"] and s.manifest() == {"score": 90} and s.trend().count() == 1
    s.write("files", s.owned("files").where("id > 0"))
    assert s.read("files").count() == 2
    s.write("meta", spark.createDataFrame([(SCHEMA_VERSION + 1,)], "schema_version long"))
    with pytest.raises(StoreError):
        s.read("files")
    assert s.read("meta").count() == 1
    for bad in ("", ".x", "a/b", "a..b", "a\\b"):
        with pytest.raises(StoreError):
            check_name(bad)
    assert column_digest({"a": ["x"], "meta": ["y"]}) == column_digest({"a": ["x"]})


def test_commit_log(spark):
    text = ["lost.txt", "commit:h1|ann|10|fix: a | b", "src/a.rs", "", "src/b.rs", "commit:bad", "commit:h2|bob|20|feat", "src/a.rs"]
    c, f = commit_log.parse(spark.createDataFrame(list(enumerate(text)), "n long, value string"), "n")
    assert {tuple(r) for r in c.collect()} == {("h1", "ann", 10, "fix: a | b"), ("h2", "bob", 20, "feat")}
    assert sorted(tuple(r) for r in f.collect()) == [("h1", "src/a.rs"), ("h1", "src/b.rs"), ("h2", "src/a.rs")]
    assert {r["path"] for r in commit_log.relative(f, "src/").collect()} == {"a.rs", "b.rs"}


def test_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "target").mkdir()
    (tmp_path / "src" / "a.py").write_text("from src.b import f\n\n# note\ndef g():\n    return f(1)\n\nclass K:\n    pass\n")
    (tmp_path / "src" / "b.py").write_text("def f(x):\n    return x\n")
    (tmp_path / "target" / "c.py").write_text("x = 1\n")
    files = scan.files(scan.read_tree(spark, str(tmp_path))).cache()
    assert [(r["path"], r["module"], r["lines"], r["comment_lines"]) for r in files.orderBy("file_id").collect()] == [("src/a.py", "src.a", 8, 1), ("src/b.py", "src.b", 2, 0)]
    assert {(r["file_id"], r["name"]) for r in scan.functions(files).collect()} == {(0, "g"), (1, "f")}
    assert [(r["from_file"], r["resolved_file"], r["resolution"]) for r in scan.resolve_imports(files, scan.imports(files)).collect()] == [(0, 1, "local")]
    assert [r["name"] for r in scan.types(files).collect()] == ["K"]
    assert ("f", 4) in {(r["target"], r["function_start"]) for r in scan.calls(files, scan.functions(files)).collect()}
    assert len(scan.snapshot_id(files)) == 64


RUST = """use std::{fmt, io as input};
use crate::b::{
    helper,
    other as alt,
};
/* block
   comment */
pub fn outer(x: i32) -> i32 {
    helper(x) + helper(x)
}

fn last() { alt() }

#[cfg(test)]
mod tests {
    #[test]
    // a note
    fn works() {
        assert!(true);
    }
    fn inside() {}
}
"""


def test_scan_of_blocks_imports_and_tests(spark):
    texts = spark.createDataFrame([("src/a.rs", RUST), ("src/b.rs", "pub fn helper(x: i32) -> i32 {\n    x\n}\npub fn other() {}\n"), ("src/k.py", "def f(a):\n    if a:\n        return g(a)\n\ndef g(b):\n    return b\n")], "path string, content string")
    x = {k: v.cache() for k, v in scan.facts(texts).items()}
    assert {(r["name"], r["start_line"], r["end_line"]) for r in x["functions"].collect()} == {("outer", 8, 10), ("last", 12, 12), ("works", 18, 20), ("inside", 21, 21), ("helper", 1, 3), ("other", 4, 4), ("f", 1, 4), ("g", 5, 7)}
    got = {(r["target"], r["alias"], r["resolved_file"]) for r in x["imports"].where("from_file = 0").collect()}
    assert {t[:2] for t in got} == {("std::fmt", None), ("std::io", "input"), ("crate::b::helper", None), ("crate::b::other", "alt")}
    assert {r["symbol"] for r in x["entry_points"].where("kind = 'test'").collect()} == {"works", "inside"}
    names = {r["function_id"]: r["name"] for r in x["functions"].collect()}
    assert sorted((names[r["caller_function"]], names[r["callee_function"]]) for r in x["call_edges"].collect()) == [("f", "g"), ("outer", "helper"), ("outer", "helper")]
    assert [r["comment_lines"] for r in x["files"].orderBy("file_id").collect()] == [5, 0, 0]
    assert sorted(r["file_id"] for r in x["files"].collect()) == [0, 1, 2]


def test_stream_and_reports(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "id long, h string").write.parquet(str(tmp_path / "in"))
    seen = []
    q = watch.on_change(watch.arriving(spark, str(tmp_path / "in"), "id long, h string"), lambda b: b.first()["h"], lambda b, n: seen.append(b.count()), str(tmp_path / "cp"), once=True)
    q.awaitTermination(60)
    assert seen == [1]
    # Another run over rows of the same digest emits nothing, one over rows of another digest does.
    for row, want in (((2, "a"), [1]), ((3, "b"), [1, 1])):
        spark.createDataFrame([row], "id long, h string").write.mode("append").parquet(str(tmp_path / "in"))
        q = watch.on_change(watch.arriving(spark, str(tmp_path / "in"), "id long, h string"), lambda b: b.first()["h"], lambda b, n: seen.append(b.count()), str(tmp_path / "cp"), once=True)
        q.awaitTermination(60)
        assert seen == want
    doc = reports.sarif(spark.createDataFrame([("error", "c", "/r/a.rs", "m")], "severity string, code string, path string, message string"), root="/r")
    assert '"uri": "a.rs"' in doc and '"version": "2.1.0"' in doc
    assert reports.tsv(spark.createDataFrame([(None, 1)], "a string, b long")).first()[0] == "\t1"


def test_queries_are_registered():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
