"""Trend and drift over samples of health, hotspots and rules.

Samples are ordered by (`timestamp`, `seq`): seq, where present, is the order of appending. `now` is always a parameter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlens.functions import scalars as S

#: Look-back windows by label (seconds; None is all).
WINDOWS = {"7d": 7 * 86400, "30d": 30 * 86400, "90d": 90 * 86400, "all": None}
DIMENSIONS = ("modularity", "acyclicity", "depth", "equality", "redundancy", "structural_uniformity")


def in_window(samples: DataFrame, window: str, now: int, ts: str = "timestamp") -> DataFrame:
    """Samples of the last 7d, 30d or 90d before `now`, or all."""
    if window not in WINDOWS:
        raise ValueError(f"unknown window {window}")
    span = WINDOWS[window]
    return samples if span is None else samples.where(F.col(ts) >= now - span)


def _order(df: DataFrame):
    return F.struct("timestamp", "seq") if "seq" in df.columns else F.struct("timestamp", "snapshot_id")


def first_last(samples: DataFrame, columns: list[str]) -> DataFrame:
    """One row: samples, and first_, last_ and delta_ of each column."""
    o = _order(samples)
    ends = samples.agg(F.count("*").alias("samples"), *[f(c, o).alias(f"{p}_{c}") for c in columns for p, f in (("first", F.min_by), ("last", F.max_by))])
    return reduce(lambda d, c: d.withColumn(f"delta_{c}", S.round3((F.col(f"last_{c}") - F.col(f"first_{c}")).cast("double"))), columns, ends)


def top_hotspots(hotspots: DataFrame, n: int = 5) -> DataFrame:
    """(path, risk_score) of the n greatest risks over all samples."""
    return hotspots.groupBy("path").agg(F.max("risk_score").alias("risk_score")).orderBy(F.desc("risk_score"), "path").limit(n)


def top_rules(violations: DataFrame, n: int = 5) -> DataFrame:
    """(rule_id, count) of the n rules broken most over all samples."""
    return violations.groupBy("rule_id").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "rule_id").limit(n)


def worsened(samples: DataFrame) -> DataFrame:
    """(dimension, before, after, delta) of the dimensions that got worse from the oldest to the newest sample: less score, more rules, less of a share (both zero aside)."""
    cols = ["score", "rules", *DIMENSIONS]
    d = first_last(samples, cols).where("samples >= 2")
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(f"first_{c}").cast("double").alias("before"), F.col(f"last_{c}").cast("double").alias("after")) for c in cols])).alias("d")
    out = d.select(rows).select("d.*").withColumn("delta", S.round3(F.col("after") - F.col("before")))
    return out.where(F.when(F.col("dimension") == "rules", F.col("delta") > 0).otherwise(F.col("delta") < 0))


def _ends(samples: DataFrame) -> DataFrame:
    o = _order(samples)
    return samples.agg(F.min_by("snapshot_id", o).alias("first_id"), F.max_by("snapshot_id", o).alias("last_id"), F.count("*").alias("n")).where("n >= 2")


def risen(samples: DataFrame, rows: DataFrame, key: str, value: str, n: int = 5) -> DataFrame:
    """(key, before, after, delta, is_new) of what is new or greater in the newest sample than in the oldest, a missing one being 0; the n greatest deltas."""
    both = rows.join(F.broadcast(_ends(samples)), (F.col("snapshot_id") == F.col("first_id")) | (F.col("snapshot_id") == F.col("last_id")))
    by = both.groupBy(key).agg(F.max(F.when(F.col("snapshot_id") == F.col("first_id"), F.col(value))).alias("b"), F.max(F.when(F.col("snapshot_id") == F.col("last_id"), F.col(value))).alias("after"))
    out = by.where("after is not null").select(key, F.coalesce("b", F.lit(0)).alias("before"), "after", (F.col("after") - F.coalesce("b", F.lit(0))).alias("delta"), F.col("b").isNull().alias("is_new"))
    return out.where("delta > 0").orderBy(F.desc("delta"), key).limit(n)


def drift(health: DataFrame, hotspots: DataFrame, violations: DataFrame, window: str, now: int, n: int = 5) -> dict[str, DataFrame | bool]:
    """What got worse in a window: dimensions, hotspots and rules; not available with fewer than two samples."""
    s = in_window(health, window, now)
    return {"available": s.limit(2).count() == 2, "dimensions": worsened(s), "hotspots": risen(s, hotspots, "path", "risk_score", n), "rules": risen(s, violations, "rule_id", "count", n)}


def health_view(samples: DataFrame, n: int = 20) -> DataFrame:
    """The n newest samples, newest first."""
    o = ["timestamp", "seq"] if "seq" in samples.columns else ["timestamp", "snapshot_id"]
    return samples.orderBy(*[F.desc(c) for c in o]).limit(n)


def rules_view(samples: DataFrame, violations: DataFrame, n: int = 20) -> DataFrame:
    """(timestamp, snapshot_id, rule_id, count) of samples, oldest first, within a sample the most broken rule first."""
    rows = samples.select("timestamp", "snapshot_id").join(violations.select("snapshot_id", "rule_id", "count"), "snapshot_id")
    return rows.select("timestamp", "snapshot_id", "rule_id", "count").orderBy("timestamp", "snapshot_id", F.desc("count"), "rule_id").limit(n)


def hotspots_view(samples: DataFrame, hotspots: DataFrame, n: int = 20) -> DataFrame:
    """(timestamp, snapshot_id, path, risk_score) of samples, oldest first, within a sample the greatest risk first."""
    rows = samples.select("timestamp", "snapshot_id").join(hotspots.select("snapshot_id", "path", "risk_score"), "snapshot_id")
    return rows.select("timestamp", "snapshot_id", "path", "risk_score").orderBy("timestamp", "snapshot_id", F.desc("risk_score"), "path").limit(n)
