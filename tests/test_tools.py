from factlens.operators import facts
from factlens.plans.tools import TOOLS, find_file
from factlens.sources import manifests, scan
from factlens.sources.config import Config
from factlens.sources.store import Store
from pyspark.sql import functions as F


def test_tools(spark, tmp_path):
    f = facts.of(spark, files=[(i, p, "rust", p, 10, 10, "h", 0) for i, p in enumerate(("src/a.rs", "src/b.rs", "lib/c.rs"))], imports=[(0, 0, "b", "use", "local", 1, None), (1, 1, "c", "use", "local", 2, None), (2, 2, "ext", "use", "external", None, None)])
    assert [r["to_path"] for r in TOOLS["edges"](f).collect()] == ["src/b.rs", "lib/c.rs", "ext"]
    assert [tuple(r) for r in TOOLS["blast_radius"](f, "c.rs").collect()] == [("src/b.rs", 1), ("src/a.rs", 2)]
    assert TOOLS["level"](f, "lib/c.rs") == 2 and find_file(f, "1") == 1
    start = TOOLS["session_start"](f, Config())
    assert TOOLS["session_end"](start, f, Config())["passes"]
    s = Store(spark, str(tmp_path / "s"))
    s.write("files", f.files)
    assert TOOLS["baseline_table_read"](s, "files", {"filters": [{"column": "path", "op": "starts_with", "value": "src/"}]}).count() == 2
    assert TOOLS["baseline_query"](s, "files", "(count t)").first()[0] == 3
    assert "library" in TOOLS["policy_presets"]()


def test_manifests(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "Cargo.toml").write_text('[workspace]\nmembers = ["a", "x/*"]\n')
    (tmp_path / "a" / "Cargo.toml").write_text('[package]\nname = "my-crate"\n')
    assert manifests.workspace_crates(str(tmp_path)) == {"my_crate": "a/src"}
    pairs = manifests.aliases('{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["./src/*"], "@": ["src/index"]}}}')
    df = spark.createDataFrame([("@/x/y",), ("@",), ("z",)], "t string")
    assert [r[0] for r in df.select(manifests.rewritten(F.col("t"), pairs)).collect()] == ["src/x/y", "src/index", "z"]
    p = manifests.plugin('name = "go"\nextensions = ["go"]\nfunction_prefixes = ["func "]\nimport_prefixes = ["import "]\n')
    lines = spark.createDataFrame([(1, 1, 'import "fmt";'), (1, 2, "func run(a) {")], "file_id long, line long, text string")
    assert manifests.plugin_functions(lines, p).first()["name"] == "run" and manifests.plugin_imports(lines, p).first()["target"] == "fmt"


def test_types(spark):
    found = spark.createDataFrame([(1, "rust", "impl<T> Show for Thing<T> {\n}\nfn main() {}\n", "src/m.rs"), (2, "java", "public class A extends B<C> implements D, E {\n}\n", "a.java"), (3, "python", "class K(Base, metaclass=M):\n    pass\n", "examples/k.py")], "file_id long, language string, content string, path string").withColumn("lines", F.lit(3).cast("long"))
    assert [tuple(r)[1:3] for r in scan.trait_impls(found).collect()] == [("Show", "Thing")]
    assert {(r["file_id"], r["base"]) for r in scan.bases(found).collect()} == {(2, "B"), (2, "D"), (2, "E"), (3, "Base")}
    assert {(r["file_id"], r["kind"]) for r in scan.entry_points(found, scan.functions(found)).collect()} == {(1, "binary"), (3, "example")}
