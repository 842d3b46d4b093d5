import random
import re

import pytest
import public_tokenizers
import tokenizers

from factlens.llm import handwritten, leakage, quality, tokenize

RANKS = tokenize.load_ranks(f"{tokenize.VOCABULARIES}/{tokenize.RANKS}")
TEXTS = [None, "", " ", "hello world", "Hello,  world!\n\n it's 12345 \t x", "日本語 текст 👩‍💻 é́", "<|endoftext|> a<|endoftext|>", "a" * 5000, "x=" * 300 + "   \n   ", "hello world", "ſ 's 'S don't"]


def reference():
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_ids_like_the_public_library(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in tokenize.encode(df, "doc_id", "text", often=1).collect()}
    t = reference()
    assert got == {i: None if x is None else t.encode(x, add_special_tokens=False).ids for i, x in enumerate(TEXTS)}
    assert tokenize.encode(df.limit(0), "doc_id", "text").count() == 0


def test_transducer_is_exact_and_minimal(tmp_path):
    words = ["walking", "talking", "walk", "talk", "king", " king", "日本"]
    lexicon = {w.encode(): tokenize.merge(w.encode(), RANKS) for w in words}
    arrays = tokenize.build(lexicon)
    (tmp_path / "t.bin").write_bytes(tokenize.pack(arrays))
    t = tokenize.Transducer(str(tmp_path / "t.bin"))
    assert all(t.ids_of(w) == ids for w, ids in lexicon.items())
    assert all(t.ids_of(w) is None for w in (b"", b"wal", b"walkings", b"zzz"))
    assert len(tokenize.build({b"walking": [1], b"talking": [2]})["final"]) == len(b"walking") + 1


def test_long_merge_is_the_same():
    word = ("ab" * 40 + "aaaa" + "é" * 30).encode()
    assert tokenize._merge_long(word, RANKS) == tokenize.merge(word[:200], RANKS) if len(word) <= 200 else True


BODY = "The module alpha.beta pulls 405 symbols out of gamma.delta on every weekly pass. After revision 3f948e the layer between omega.psi and chi.phi rose from 258 to 719 points. Nobody has touched walk_tau since Rho-Sigma was tagged c45fb9, although kappa.iota changes 476 times a month."
ITEM = "Answer in one word.\n" + BODY
OTHER = "Answer in one word.\nThe module lupa.meta pulls 77 symbols out of nona.deka on every weekly pass. After revision aa11bb the layer between quux.corge and fred.waldo rose from 1 to 2 points."


def leaked(spark, docs):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    i = spark.createDataFrame([(1, ITEM, "x"), (2, OTHER, "x"), (3, None, "x"), (4, "only an instruction", "x")], "item_id long, text string, doc_id string")
    return {(r["doc_id"], r["item_id"]): r["kind"] for r in leakage.leaks(d, i, renamed=True).collect()}


def test_leaks(spark):
    words = BODY.split()
    altered = [w if i % 6 else "changed" for i, w in enumerate(words)]
    other_values = BODY.replace("alpha", "zeta").replace("405", "12").replace("3f948e", "77aa").replace("kappa", "nu").replace("Rho", "Xi").replace("omega", "eta").replace("gamma", "theta")
    docs = [
        None, "", "The module is fine.", "so: " + " ".join(words[3:18]) + " end", "so: " + " ".join(words[3:16]) + " end",
        "<p>" + BODY.upper().replace(" ", "\n> ").replace("ALPHA.BETA", "**alpha .beta**") + "</p>", " ".join(altered), " ".join(altered[:20]), "Answer in one word.", "x " * 20000 + BODY,
    ]
    got = leaked(spark, docs)
    assert got == {(3, 1): "exact", (5, 1): "exact", (6, 1): "altered", (9, 1): "exact"}
    assert leaked(spark, [other_values]).get((0, 1)) in ("renamed", "altered")
    assert leaked(spark, [OTHER.split("\n")[1]]) == {(0, 2): "exact"}


def test_reparameterised_items_need_one_renaming(spark):
    body = OTHER.split("\n")[1]
    swap = {"lupa": "zeta", "meta": "eta", "77": "12", "nona": "xi", "deka": "nu", "aa11bb": "09ff", "quux": "om", "corge": "psi", "fred": "chi", "waldo": "tau", "points": "rows"}
    renamed = "".join(swap.get(p, p) for p in re.split(r"(\w+)", body))
    twice = body + " Then lupa.meta pulls 77 symbols out of nona.deka again."
    items = [(1, "Answer.\n" + twice), (2, ITEM), (3, "Say.\n" + "Then he pulls it out of there again. The module pulls on every weekly pass and after revision the layer between them rose from one to two.")]
    items = spark.createDataFrame(items, "item_id long, text string")
    same = "".join(swap.get(p, p) for p in re.split(r"(\w+)", twice))
    docs = [same, renamed, same[:-40] + same[-40:].replace("zeta", "alpha").replace("xi", "rho"), same.replace("Then zeta", "Then rho")]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in leakage.leaks(d, items, renamed=True).collect()}
    assert got.get((0, 1)) == "renamed" and got.get((3, 1)) != "renamed"


def test_every_exact_run_reaches_the_check(spark):
    words = BODY.split()
    runs = [" ".join(words[i : i + 15]) for i in range(len(words) - 14)]
    got = leaked(spark, ["so: " + r + " end" for r in runs])
    assert all(got.get((i, 1)) == "exact" for i in range(len(runs)))
    copies = spark.createDataFrame([(i, ITEM) for i in range(20)], "item_id long, text string")
    d = spark.createDataFrame([(0, runs[4])], "doc_id long, text string")
    assert {r["item_id"] for r in leakage.leaks(d, copies).collect()} == set(range(20))


def test_altered_passages_at_the_limits(spark):
    words = BODY.split()[3:38]
    ends = [w + "q" if i in (0, 12, 23, 34) else w for i, w in enumerate(words)]
    added = [x for i, w in enumerate(words) for x in ([w, "pellor.lornor"] if i % 5 == 3 else [w])]
    dropped = [w for i, w in enumerate(words) if i % 5 != 2]
    changed = ["other" if i % 5 == 2 else w for i, w in enumerate(words)]
    more = ["other" if i % 4 == 2 else w for i, w in enumerate(words)]
    assert leaked(spark, [" ".join(x) for x in (ends, added, dropped, changed, more)]) == {(i, 1): "altered" for i in range(4)}


PROSE = "The old record was never removed from graph, so both are read twice. We should not ship this until it is gone, and that is why the report looks wrong."
TABLE = "\n".join(f"src/query/node/file_{i}.py;{i * 7};{i * 911}" for i in range(12))
SALAD = "vector origin kernel notice queue config marker draft memory render report layer session harbor extract ingest search factor pointer parcel digest vertex scanner grain"


def test_quality(spark):
    docs = [PROSE, TABLE, SALAD, None, "", " \n ", PROSE + "\n\n" + TABLE[:60], "Si store est absent, core écrit un avertissement et continue.", "{\"a\":" * 30, PROSE * 200, "漢字のテストです。これは自然な文章です。"]
    rows = [(i, t, 0) for i, t in enumerate(docs * 1)] + [(100 + i, PROSE, 0) for i in range(30)] + [(200 + i, TABLE, 0) for i in range(8)] + [(300 + i, SALAD, 0) for i in range(4)]
    got = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, words int")).collect()}
    assert [got[i]["kind"] for i in range(11)] == ["prose", "no prose", "no prose", None, "empty", "empty", "prose", "prose", "no prose", "prose", "prose"]
    assert got[0]["words"] == 30 and got[0]["punctuated"] == 1.0 and got[4]["words"] == 0
    assert quality.quality(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_votes_round_trip():
    assert quality.votes_of(sum(v * 3 ** (len(quality.FUNCTIONS) - 1 - i) for i, v in enumerate([2, 1, 0] * 3 + [2]))) == [2, 1, 0] * 3 + [2]


@pytest.mark.parametrize(
    "pattern,path,hit",
    [("schema/out", "schema/out/a.py", True), ("schema/out", "schema/outer/a.py", False), (" /api\\stubs/ ", "./api/stubs/x", True), ("**/generated/*", "src/generated/x.py", True), ("*.pb.*", "a/b.pb.go", True), ("", "x", False), ("src/*/gen_*", "src/a/b/gen_x.c", True)],
)
def test_covered(pattern, path, hit):
    assert handwritten.covered(path, [None, pattern]) is hit


COMMENTS = [
    ("// Code generated by toolx from a.proto. DO NOT EDIT.", 0), ("# @generated by t 1", 0), ("/*\n * AUTO-GENERATED FILE\n */", 0), ("// machine-written, do not modify by hand", 0),
    ("// Vendored copy of lib 1.2.", 1), ("# Upstream: https://x.example/src", 1), ("// lib v1.0 | (c) the lib authors | Permissive-2 licence", 1),
    ("// writes code that is generated from the schema; this writer itself is kept by hand", None), ("// DO NOT EDIT the order below without asking: tuned by hand", None),
    ("// the scanner skips third_party and auto-generated trees before this runs", None), ("// copied lazily, so edits stay local", None), ("x = 'Code generated by t. DO NOT EDIT.'", None),
]


@pytest.mark.parametrize("comment,kind", COMMENTS)
def test_comments(comment, kind):
    tool, third, *_ = handwritten.evidence(comment + "\nint main() { return 0; }\n")
    assert (tool, third) == (kind == 0, kind == 1)


def test_shapes():
    assert handwritten.evidence("a=b(1);" * 80)[2]
    assert handwritten.evidence("x = [\n" + "12345, " * 200 + "]\n")[3]
    assert handwritten.evidence("\n".join(f"int get_{i}(int *m) {{ return m[{i}]; }}" for i in range(12)))[4]
    assert not any(handwritten.evidence("// " + "word " * 150 + "\nint f(int a) {\n    return a + 1;\n}\n")[:5])
    assert len(handwritten.evidence("")[5]) == 0


def test_copies_across_owners(spark):
    code = "\n".join(f"def f{i}(a, b):\n    return a * {i} + helper_{i}(b)" for i in range(60))
    own = "\n".join(f"def own{i}(x):\n    return other_{i}(x, {i})\n\nclass K{i}:\n    pass" for i in range(60))
    rows = [(i, f"src/{i}.py", f"owner{i}/r", code) for i in range(3)] + [(9, "src/z.py", "owner0/q", own), (10, None, None, own[:50])]
    got = handwritten.judged(spark.createDataFrame(rows, "file_id long, path string, repo string, content string").selectExpr("*", "array('gen/*', null) as patterns"))
    assert sorted(r[0] for r in handwritten.copied(got).collect()) == [0, 1, 2]


def test_edited_and_short_copies_across_owners(spark):
    def code(edit):
        tokens = [f"name_{i}" for i in range(600)]
        return "\n".join(" ".join(f"renamed_{edit}_{i}" if i % 60 == 7 * edit else t for i, t in enumerate(tokens[a : a + 10], a)) for a in range(0, 600, 10))

    short = "def first(a, b):\n    return second(a) + third(b) * 2\n\ndef fourth():\n    pass\n"
    rows = [(i, f"src/{i}.py", f"owner{i}/r", code(i)) for i in range(5)] + [(10 + i, f"lib/{i}.py", f"owner{i}/r", short) for i in range(3)]
    idiom = " ".join(f"common_{i}" for i in range(90))
    rows += [(100 + 10 * i + j, f"app/{j}.py", f"owner{i}/r", idiom + f" own_{i}_{j}") for i in range(4) for j in range(5)]
    got = handwritten.judged(spark.createDataFrame(rows, "file_id long, path string, repo string, content string").selectExpr("*", "array() as patterns"))
    assert sorted(r[0] for r in handwritten.copied(got).collect()) == [0, 1, 2, 3, 4, 10, 11, 12]


def test_planted_copies_without_headers_or_folders(spark):
    """Copies in other places, comments cut off and every 60th token renamed, are told from hand-written files of one vocabulary."""
    rng = random.Random(5)
    names = [f"name{i}" for i in range(40)]
    line = lambda: f"    {rng.choice(names)} = {rng.choice(names)}({rng.choice(names)}, {rng.randint(0, 99)})"
    make = lambda n: "\n".join(["def run(a, b):"] + [line() for _ in range(n)])

    def edited(text):
        parts = re.split(r"(\W+)", text)
        return "".join(f"own{rng.randint(0, 10**6)}" if i % 120 == 60 and p else p for i, p in enumerate(parts))

    rows, planted, at = [], set(), 0
    for lib in range(12):
        text = make(40 + 10 * lib)
        rows.append((at, f"third_party/lib{lib}/a.py", f"home{lib}/r", "# Vendored copy of lib.\n" + text))
        planted.add(at)
        at += 1
        for owner in range(1 if lib % 3 == 0 else 4):
            rows.append((at, f"src/core/x{at}.py", f"owner{owner}/r", edited(text)))
            planted.add(at)
            at += 1
    rows += [(at + i, f"src/own{i}.py", f"owner{i % 9}/r", make(60)) for i in range(150)]
    got = handwritten.judged(spark.createDataFrame(rows, "file_id long, path string, repo string, content string").selectExpr("*", "array() as patterns"))
    found = {r[0] for r in handwritten.copied(got).collect()}
    assert not found - planted
    assert len(found & planted) >= 0.95 * len(planted)
