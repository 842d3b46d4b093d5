from datetime import datetime as D

from factlens.operators.snapshot_diff import series_pairs, snapshot_changes

SNAP = "root string, snapshot_id string, taken timestamp, edges string"
EDGE = "snapshot_id string, a string, b string, edges long, at timestamp, root string"


def changes(spark, snaps, edges, bound=200_000):
    pairs = series_pairs(spark.createDataFrame(snaps, SNAP), "root", "snapshot_id", "taken")
    out = snapshot_changes(pairs, spark.createDataFrame(edges, EDGE), "snapshot_id", ["a", "b"], ["edges"], "at", bound)
    return {tuple(r) for r in out.collect()}


def test_changes_ties_nulls_and_corrections(spark):
    t = lambda d: D(2025, 1, d)
    snaps = [("r", "s1", t(1), "x"), ("r", "s1", t(1), None), ("r", "s2", t(2), "x"), ("r", "s3", t(3), "x"), (None, "s4", t(4), "x"), ("q", "s9", t(1), None)]
    edges = [
        ("s1", "m", "n", 1, t(1), "z"), ("s1", "m", "n", 1, t(1), "z"), ("s1", "gone", None, 1, t(1), "z"), ("s1", "n", "n", None, t(1), None),
        ("s2", "m", "n", 9, t(1), "z"), ("s2", "m", "n", 2, t(5), "z"), ("s2", "n", "n", None, None, "z"), ("s2", "new", "n", 3, t(1), "z"),
    ]
    want = {("r", "s2", "m", "n", "changed"), ("r", "s2", "gone", None, "removed"), ("r", "s2", "new", "n", "added"), ("r", "s3", "m", "n", "removed"), ("r", "s3", "n", "n", "removed"), ("r", "s3", "new", "n", "removed")}
    assert changes(spark, snaps, edges) == want
    assert changes(spark, snaps, edges, 0) == want


def test_empty(spark):
    assert changes(spark, [], []) == set()
    assert changes(spark, [("r", "s1", D(2025, 1, 1), "")], [("s1", "a", "b", 1, D(2025, 1, 1), "")]) == set()
