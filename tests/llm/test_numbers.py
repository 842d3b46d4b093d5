import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factlens.llm import knn, quantiles, topn


def test_quantize_is_ordered_and_bounded(spark):
    values = sorted({0, 1, 2047, 2048, 2049, 4095, 4096, 10**6, 2**40 + 5, 2**62, 2**63 - 1} | {random.Random(1).randrange(2**45) for _ in range(200)})
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", quantiles.quantize(F.col("v")).alias("c")).withColumn("h", quantiles.highest(F.col("c")))
    rows = df.orderBy("v").collect()
    assert [r["c"] for r in rows] == sorted(r["c"] for r in rows) and rows[-1]["c"] < 2**quantiles.LEVELS
    assert all(0 <= r["h"] - r["v"] <= r["v"] / 2**quantiles.BITS for r in rows)


@pytest.mark.parametrize("eps", [0.0, 0.02, 0.2])
def test_rank_error_and_merge(spark, eps):
    rng = random.Random(2)
    rows = [(f"g{rng.randrange(3)}" if rng.random() < 0.9 else None, d, rng.choice([5, rng.randrange(50), rng.randrange(10**6)])) for d in range(4) for _ in range(250)]
    rows += [("g0", 0, None), ("g0", 0, -3), ("only", 1, None)]
    df = spark.createDataFrame(rows, "g string, day int, v long")
    whole = quantiles.merged(quantiles.digests(df, ["g", "day"], "v", eps), ["g"], eps)
    got = {r["g"]: r for r in quantiles.percentiles(whole, ["g"], {"p50": 0.5, "p99": 0.99}, eps).collect()}
    by = defaultdict(list)
    for g, _, v in rows:
        if v is not None and v >= 0:
            by[g].append(v)
    assert set(got) == set(by)
    for g, vs in by.items():
        vs = np.sort(vs)
        assert got[g]["n"] == len(vs)
        for name, p in (("p50", 0.5), ("p99", 0.99)):
            x, k = got[g][name], int(np.ceil(p * len(vs)))
            assert np.searchsorted(vs, x, "right") >= k and np.searchsorted(vs, x - x / 2**quantiles.BITS, "left") <= k - 1 + got[g]["rank_error"] + 1e-9
    assert quantiles.percentiles(quantiles.digests(df.limit(0), ["g"], "v", 0.01), ["g"], {"p": 0.5}, 0.01).count() == 0


def test_top_n_against_brute_force(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.5 else f"g{rng.randrange(20)}", f"p{rng.randrange(60)}", rng.choice([None, rng.randrange(4)]), rng.randrange(6), "x") for _ in range(900)] + [(None, "p", 1, 1, "x"), ("g1", None, 1, 9, "x")]
    df = spark.createDataFrame(rows, "g string, p string, c long, s long, position string")
    best = topn.best_rows(df, "g", "p", ["s", "c"])
    got = topn.top_n(best, "g", [F.col("s").desc(), F.col("c").desc_nulls_last(), F.col("p").asc_nulls_last()], 5)
    want = defaultdict(dict)
    for g, p, c, s, _ in rows:
        if g is not None:
            k = (-s, 1 if c is None else 0, -(c or 0))
            want[g][p] = min(want[g].get(p, k), k)
    expect = {(g, p, i + 1) for g, ps in want.items() for i, (p, _) in enumerate(sorted(ps.items(), key=lambda x: (x[1], x[0] is None, x[0] or ""))[:5])}
    assert {(r["g"], r["p"], r["position"]) for r in got.collect()} == expect
    assert topn.top_n(best.limit(0), "g", [F.col("s").desc()], 5).count() == 0


def brute(ids, x, k):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    return {(int(ids[i]), int(ids[j])) for i in range(len(ids)) for j in sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k]}


@pytest.mark.parametrize("n", [0, 1, 3, 160])
def test_neighbours_against_brute_force(spark, n):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 6)).astype(np.float32)
    if n > 100:
        x[:50] = x[0]  # a group of copies
        x[50:60] = 2 * x[60]  # same direction
    ids = rng.permutation(n) + 1
    rows = [(int(i), *[float(v) for v in r], "clash") for i, r in zip(ids, x, strict=True)]
    rows += rows[:5] + [(1000, *[0.0] * 6, "z"), (1001, *[float("nan")] * 6, "z"), (1002, *[None] * 6, "z"), (None, *[1.0] * 6, "z")]
    df = spark.createDataFrame(rows, ", ".join(["id long", *[f"e{i} float" for i in range(6)], "vec string"]))
    got = knn.neighbours(knn.pack(df, "id", [f"e{i}" for i in range(6)]), 5, recall=1.0, sample=100)
    assert {(r["id"], r["neighbour"]) for r in got.collect()} == brute(ids, x, 5)


def test_calibrated_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    x = (centres[rng.integers(12, size=400)] + 0.2 * rng.normal(size=(400, 8))).astype(np.float32)
    df = spark.createDataFrame([(i, *[float(v) for v in r]) for i, r in enumerate(x)], ", ".join(["id long", *[f"e{i} float" for i in range(8)]]))
    got = {(r["id"], r["neighbour"]) for r in knn.neighbours(knn.pack(df, "id", [f"e{i}" for i in range(8)]), 5, recall=0.95, sample=200).collect()}
    want = brute(np.arange(400), x, 5)
    assert len(got & want) >= 0.95 * len(want)


def test_large_bins_have_a_tree_of_their_own():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16))[rng.integers(0, 400, 24_000)] + 0.2 * rng.normal(size=(24_000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[:300]
    a, b, sims = knn.nearest_local(q, x, 6, points=4096)
    want = [set(r) for r in np.argsort(-(q @ x.T), axis=1)[:, :6].tolist()]
    got = [set(b[a == i].tolist()) for i in range(300)]
    assert np.mean([len(g & w) / 6 for g, w in zip(got, want, strict=True)]) >= 0.95
    assert (np.diff(sims)[np.diff(a) == 0] <= 0).all() and np.allclose(sims, np.round((q[a] * x[b]).sum(1), 6))


def test_calibrated_and_exact_searches_with_many_copies(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(150, 8))[rng.integers(0, 150, 3000)] + 0.1 * rng.normal(size=(3000, 8))
    x[:1200] = x[0]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"e{i} double" for i in range(8)))
    packed = knn.pack(df, "id", [f"e{i}" for i in range(8)])
    true = {(r["id"], r["neighbour"]) for r in knn.neighbours(packed, 5, recall=1.0).collect()}
    got = {(r["id"], r["neighbour"]) for r in knn.neighbours(packed, 5, recall=0.95).collect()}
    assert len(true) == 15_000 and len(got) == 15_000
    assert len(true & got) >= 0.93 * 15_000
    assert {n for i, n in true if i < 1200} <= set(range(6))
