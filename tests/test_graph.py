import random

import pytest

from factlens.operators import graph


def edges(spark, pairs):
    return spark.createDataFrame([(a, b) for a, b in pairs], "src long, dst long")


def closure_of(pairs):
    out = {(a, b) for a, b in pairs if a != b}
    while True:
        more = {(a, d) for a, b in out for c, d in out if b == c} - out
        if not more:
            return out
        out |= more


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(3)
    return sorted({(rng.randrange(14), rng.randrange(14)) for _ in range(24)})


def test_cycles_and_closure(spark, sample):
    want = closure_of(sample)
    assert {tuple(r) for r in graph.closure(edges(spark, sample)).collect()} == want
    assert {r[0] for r in graph.cycle_members(edges(spark, sample)).collect()} == {a for a, b in want if a == b}


def test_components_and_paths(spark, sample):
    got = {r["_node"]: r["_component"] for r in graph.components(edges(spark, sample)).collect()}
    both = closure_of([p for a, b in sample for p in ((a, b), (b, a))])
    for n, c in got.items():
        assert c == min([n] + [b for a, b in both if a == n])
    e = edges(spark, [(0, 1), (1, 2), (0, 2), (2, 3), (3, 0)])
    assert [r["node"] for r in graph.shortest_path(e, 0, 3).orderBy("step").collect()] == [0, 2, 3]
    assert [tuple(r) for r in graph.k_shortest(e, 0, 3, 2).collect()] == [(1, 2, [0, 2, 3]), (2, 3, [0, 1, 2, 3])]


def test_levels_with_cycle(spark):
    got = {r["node"]: r["level"] for r in graph.levels(edges(spark, [(0, 1), (1, 2), (2, 3), (3, 2), (0, 4)])).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 0, 4: 1}


def test_ranks_and_centrality(spark):
    e = edges(spark, [(0, 1), (1, 2), (2, 0), (2, 3)])
    assert sum(r["_rank"] for r in graph.pagerank(e, 10).collect()) == pytest.approx(1.0)
    b = {r["_node"]: r["_betweenness"] for r in graph.betweenness(edges(spark, [(0, 1), (1, 2), (0, 3), (3, 2), (2, 4)])).collect()}
    assert b == {0: 0.0, 1: 1.0, 3: 1.0, 2: 3.0, 4: 0.0}
    assert {r[0]: r[1] for r in graph.clustering(edges(spark, [(0, 1), (1, 2), (2, 0), (2, 3)])).collect()}[2] == pytest.approx(1 / 3)


def test_forest_and_walk(spark):
    w = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (0, 2, 3.0), (3, 4, 1.0)], "src long, dst long, weight double")
    assert {tuple(r) for r in graph.spanning_forest(w).collect()} == {(0, 1, 1.0), (1, 2, 2.0), (3, 4, 1.0)}
    start = spark.createDataFrame([(0,)], "node long")
    assert graph.random_walk(w, start, 2).count() == 3


def test_empty_loops_and_nulls(spark):
    e = spark.createDataFrame([(None, 1), (2, 2), (2, None)], "src long, dst long")
    none = e.limit(0)
    assert graph.cycle_members(e).count() == 0 and graph.cycle_members(none).count() == 0
    assert graph.components(none).count() == 0 and graph.levels(none).count() == 0
    assert graph.topological(none).count() == 0 and graph.pagerank(none).count() == 0
    assert graph.degree(e).count() == 2


def test_registered_forest_joins_modules_of_one_area(spark, tmp_path):
    from factlens.plans import core_queries

    rows = [("a.x.p", "a.x.q", 2), ("a.x.q", "a.x.p", 3), ("a.x.q", "b.y.r", 1), ("a.x.p", "b.y.r", 4), ("c.x.s", "a.x.p", 1), ("c.x.s", "c.x.s", 1)]
    spark.createDataFrame(rows, "from_module string, to_module string, edges int").write.parquet(str(tmp_path / "module_edges.parquet"))
    got = {tuple(r) for r in core_queries.spanning_forest(spark, str(tmp_path)).collect()}
    assert got == {("a.x.p", "a.x.q", 2.0), ("a.x.q", "b.y.r", 1.0), ("a.x.p", "c.x.s", 1.0)}


def test_k_shortest_of_a_long_chain(spark):
    e = edges(spark, [(i, i + 1) for i in range(14)] + [(13, 15), (15, 14), (14, 0)])
    whole = list(range(15))
    assert [tuple(r) for r in graph.k_shortest(e, 0, 14, 3).collect()] == [(1, 14, whole), (2, 15, whole[:-1] + [15, 14])]
    assert graph.k_shortest(e, 0, 14, 3, 12).count() == 0
