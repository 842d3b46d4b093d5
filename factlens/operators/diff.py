"""Differences between two baselines, and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed_diff(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, change, before_..., after_...) of rows added, removed or changed, by one aggregation over both sides.

    Of equal keys on one side the greatest row counts. Null keys are keys, nulls differ from values.
    """
    side = lambda d, n: d.select(*keys, F.lit(n).alias("_side"), F.struct(*values).alias("_row"))
    pick = lambda n: F.max(F.when(F.col("_side") == n, F.col("_row")))
    g = side(before, 0).unionByName(side(after, 1)).groupBy(*keys).agg(pick(0).alias("b"), pick(1).alias("a"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return g.withColumn("change", change).where("change is not null").select(*keys, "change", *[F.col(f"b.{v}").alias(f"before_{v}") for v in values], *[F.col(f"a.{v}").alias(f"after_{v}") for v in values])


def added_rules(before: DataFrame, after: DataFrame) -> DataFrame:
    """(code, path, message) of findings only the later side has."""
    return after.select("code", "path", "message").distinct().join(before.select("code", "path", "message"), ["code", "path", "message"], "left_anti")


def session_passes(score_before: int, score_after: int, rules_before: DataFrame, rules_after: DataFrame) -> bool:
    """Whether a session made the score no worse and no finding new."""
    return score_after >= score_before and added_rules(rules_before, rules_after).isEmpty()
