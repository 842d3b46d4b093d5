import ast
import random
import warnings

import pytest

from factlens.llm.parsing import checked, rates
from factlens.llm.sources import current_sources
from factlens.llm.syntax.gll import Grammar
from factlens.llm.syntax.languages import parses

VALID = {
    "py": "import os\n\n@d\nasync def f(a, *b, c=1, **k) -> int:\n    x: int = 3; y = [i for i in b if i]\n    with open(a) as h, g():\n        return f\"{a!r} {h.x:>{c}}\" if x else (yield)\n    match a:\n        case [1, *_] | {'k': v}:\n            pass\n",
    "c": "#ifndef A\n#define A\nstatic const int t[] = {1, 2};\nstruct s { char n[3]; struct s *next; };\nint f(int a, char *p) { for (int i = 0; i < a; i++) if (p[i] == '{') return (int)(p - t); else continue; return sizeof(int); }\n#endif\n",
    "cpp": "#include <map>\nnamespace a::b {\ntemplate <typename V> class C : public D<V> {\npublic:\n    explicit C(V v) : v_(v) {}\n    V g() const { return v_ * 2; }\nprivate:\n    std::map<std::string, int> v_;\n};\nauto f = [&](int x) -> int { return x >> 1; };\n}\n",
    "java": "package a.b;\nimport java.util.*;\n@X(y = 1) public final class C<T extends D> implements E {\n  private Map<String, List<Integer>> m = new HashMap<>();\n  C(int a) { this.a = a; }\n  int f(int... x) throws Z { return x.length > 0 ? (int) g(x) : h.stream().map(q -> q + 1).sum(); }\n  enum K { A, B(1) { } ; }\n}\n",
    "cs": "using System;\nnamespace A.B\n{\npublic sealed class C<T> : D where T : class\n{\n    public int X { get; private set; } = 3;\n    string F(int? a) => $\"{a} (\" + @\"\\\";\n    void G() { foreach (var x in y.Where(r => r.K == 1 && r.S > 2)) { total += x; } }\n}\n}\n",
    "rs": "use std::{fmt, io::*};\n#[derive(Debug)]\npub struct S<'a> { pub k: &'a str, v: Vec<usize> }\nimpl<'a> S<'a> { fn f(&self) -> Option<&'a str> { let (h, _) = self.k.split_once('{')?; match h { Some(n) if *n > 1 => Some(h), _ => None, } } }\nmacro_rules! m { ($x:expr) => { $x + 1 } }\n",
    "ts": "import { a } from './a';\nexport interface I { x?: number; readonly y: Array<[string, number]> }\ntype T = { k: 'a' } | { k: 'b'; n: string };\nexport class C<V> { private m: Map<string, V> = new Map();\n  constructor(private readonly z: string) {}\n  f(k: string): V | undefined { return this.m.get(`${this.z}:${k}`) ?? 1; } }\nexport const g = async (s: string): Promise<string> => (await h(s)).replace(/[{(]\\/?/g, '');\n",
    "kt": "package a.b\nimport c.D\ndata class E(val a: String, val b: Int = 3) : F() {\n    fun g(): String {\n        return \"$a:${b + 2} (\"\n    }\n}\nfun h(x: String?): String {\n    val y = x?.foo('{') ?: \"n }\"\n    return when (y.length) {\n        0 -> \"none\"\n        else -> y\n    }\n}\n",
    "swift": "import Foundation\nstruct S {\n    let a: String\n    var b: Int = 3\n    func f(_ x: String?) throws -> String {\n        guard let v = x, !v.isEmpty else {\n            throw E(domain: \"q (\", code: 4)\n        }\n        return \"\\(a) {\" + String(b)\n    }\n}\n",
    "scala": "package a.b\nimport c.d.{E => F}\nobject O {\n  case class P(a: String, b: Int) {\n    def q: String = {\n      s\"${a} (\" + '{' + b\n    }\n  }\n  def f(x: Option[String]): String = {\n    x match {\n      case Some(v) if v.length > 3 => v\n      case _ => \"n }\"\n    }\n  }\n  for (i <- Seq(1)) {\n    println(i)\n  }\n}\n",
    "rb": "require 'set'\nmodule A\n  class B < C\n    attr_reader :a, :b\n    def initialize(a, b = 1)\n      @a = a\n      raise ArgumentError, \"no (\" if a.nil?\n      @a.each do |x|\n        t += x * 2 if x > b\n      end\n    end\n    def self.f(x)\n      x.map { |y| \"#{y}:z\" }.sort\n    end\n  end\nend\n",
    "rfl": ";; note (\n(set f (fn [x y] (+ x (- y 2))))\n(select {path: path from: files where: (and (> lines 3) (!= m \"a (\"))})\n",
}
BROKEN = ["<<<<<<< ours\n", "=======\n", ">>>>>>> x/y\n"]


@pytest.mark.parametrize("ext", sorted(VALID))
def test_each_language(ext):
    text = VALID[ext]
    assert parses(text, ext) and parses("", ext) and parses("\ufeff" + text.rstrip("\n").replace("\n", "\r\n"), ext)
    for mark in BROKEN:
        lines = text.split("\n")
        assert not parses("\n".join([*lines[:2], mark.rstrip(), *lines[2:]]), ext) or ext in ("rfl", "c", "ts")
    assert not parses("<!DOCTYPE html>\n<html><head><title>403</title></head></html>\n", ext) or ext == "rfl"
    assert not parses(text + "(", ext) and not parses(text + "}", ext)


@pytest.mark.parametrize("ext", sorted(set(VALID) - {"rfl"}))
def test_wrong_language(ext):
    for other in ("py", "rs", "rb", "java", "scala"):
        if other != ext:
            assert not parses(VALID[other], ext), (ext, other)


def test_python_like_its_own_parser():
    warnings.simplefilter("ignore")
    rng = random.Random(5)
    text = VALID["py"]
    for _ in range(150):
        cut = text[: rng.randrange(len(text))] if rng.random() < 0.5 else text[rng.randrange(len(text)) :]
        try:
            ast.parse(cut)
            want = True
        except (SyntaxError, ValueError):
            want = False
        # The compiler also rejects what no grammar can (a yield outside a function is accepted by ast).
        assert parses(cut, "py") == want, cut


def test_dialects_and_unknown():
    assert parses("println(\"x\")\n", "kts") and not parses("println(\"x\")\n", "kt")
    assert parses("const x: number = 1\n", "js") and parses("x", "json") is None
    assert not parses("int f() { return 1; }\n#endif\n", "h")


MARKUP = [
    (True, "const a = <div className=\"x\" onClick={() => f(1)}>Hello {name} <b>it's</b>{/* c */}</div>;\n"),
    (True, "export default function A({x}) {\n  return (\n    <>\n      {x.map((i) => <Item key={i} {...i} on={`a${i}`} />)}\n      {x ? <p>yes</p> : null}\n    </>\n  );\n}\n"),
    (True, "const f = <T,>(x: T) => x;\nconst a = b < c && d > e;\n"),
    (True, "function A() { return <ul>{xs.map(x => { if (x) { return <li>{x}</li>; } return null; })}</ul>; }\n"),
    (False, "const a = <div>Hello</span>;\n"),
    (False, "const a = <div>Hello {x +}</div>;\n"),
    (False, "const a = <div {x}>Hello</div>;\n"),
]
INDENTED = [
    (True, "enum C:\n  case A, B\n  case D(x: Int)\n\nobject O:\n  def f(x: Int): Int =\n    val y = x + 1\n    if y > 2 then\n      y\n    else\n      0\n\n  class P(val a: Int):\n    def g = a\n"),
    (True, "trait T:\n  def f(x: Int): Int\nend T\n\n@main def run(): Unit =\n  for i <- 1 to 3 do\n    println(i) // now:\n  val z = x match\n    case 1 => 2\n    case _ => 3\n  while x > 1 do\n    f(x)\n"),
    (False, "enum C:\n  case A, B(\n"),
    (False, "object O:\n  def f(x: Int: Int =\n    x\n"),
    (False, "object O {\n  def f(x: Int): Int = {\n    x\n}\n"),
]


@pytest.mark.parametrize("valid,text", MARKUP)
def test_markup_inside_scripts(valid, text):
    assert all(parses(text, e) == valid for e in ("tsx", "jsx", "js"))


@pytest.mark.parametrize("valid,text", INDENTED)
def test_significant_indentation(valid, text):
    assert parses(text, "scala") == valid


def test_a_statement_begins_with_no_object():
    data = '{\n  "version": 2,\n  "files": [\n    {"path": "a", "lines": 4}\n  ]\n}\n'
    assert not any(parses(data, e) for e in ("ts", "js", "jsx", "java", "rs", "kt")) and parses("x = " + data, "ts") and parses("({a: 1});\n{ a: f() }\n", "js")


def test_deep_nesting():
    assert parses("x = " + "(" * 20_000 + "1" + ")" * 20_000 + ";\n", "ts") and parses("x = " + "[" * 20_000 + "]" * 20_000 + "\n", "py")
    assert not parses("x = " + "(" * 20_000 + "1 +" + ")" * 20_000 + ";\n", "ts")
    assert parses("const a = `x ${ f({a: {b: {c: {d: {e: 1}}}}}) } y`;\n", "ts") and not parses("const a = `x ${ f({a: {b: {c: +}}}) } y`;\n", "ts")


def test_ambiguous_and_left_recursive_grammars():
    g = Grammar('s : s "a" s | "b" | ')
    a, b = g.terminals["a"], g.terminals["b"]
    assert g.derives(g.rules["s"], (b, a, b, a, b)) and g.derives(g.rules["s"], (a, a)) and not g.derives(g.rules["s"], (b, b))


def test_operator(spark):
    files = spark.createDataFrame([(1, "a.py", "r", "t1", "z"), (1, "b.rs", "r", "t0", "z"), (2, "x/y.TXT", None, "t", "z"), (3, "c.py", "r", None, "z"), (4, None, "r", "t", "z"), (None, "n.py", "r", "t", "z")], "file_id long, path string, repo string, scanned_at string, content string")
    texts = spark.createDataFrame([(1, "x = 1\n", "1"), (1, "x = (\n", "2"), (1, "x = (\n", "2"), (2, "(", "1"), (3, None, "2"), (3, "x", "1"), (4, "(", "1"), (9, "(", "1")], "file_id long, content string, fetched_at string")
    got = checked(current_sources(files, texts, ["path", "repo"]))
    assert {r["file_id"]: r["valid"] for r in got.collect()} == {1: False, 2: None, 4: None}
    assert [tuple(r) for r in rates(got).collect()] == [("r", "python", 1, 1, 1.0)]
    assert checked(current_sources(files.limit(0), texts, ["path", "repo"])).count() == 0
    named = got.selectExpr("*", "case file_id when 1 then ' Python3' end as language_name")
    assert [tuple(r) for r in rates(named).collect()] == [("r", "python", 1, 1, 1.0)]
