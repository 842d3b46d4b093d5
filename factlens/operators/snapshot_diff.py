"""What changed between consecutive full snapshots of a table.

Both sides are unioned with a side tag, grouped by key and classified from one row hash per side, in one
aggregation shuffle. That aggregation also settles late and corrected rows: each side keeps the row with the
greatest (version time, row hash), packed into one decimal, so that the hash aggregate needs no sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pair rows up to which the pair list is broadcast; each row is two ids and a series name (about 250 bytes, so 50 MB).
BROADCAST_PAIRS = 200_000
#: Parts that a snapshot's rows are spread over where the pairs are too many to broadcast.
SALT = 32

_TWO63, _TWO64 = str(2**63), str(2**64)


def row_hash(cols: list[str]) -> Column:
    """64-bit hash of the value columns, with null as a value of its own (a plain hash skips nulls)."""
    parts: list[Column] = []
    for c in cols:
        parts += [F.col(c).isNull(), F.col(c)]
    return F.xxhash64(*parts)


def series_pairs(snapshots: DataFrame, series: str, snapshot: str, taken: str) -> DataFrame:
    """(series, earlier, later) of consecutive snapshots.

    A snapshot sent twice counts once with its latest `taken`; equal times are ordered by id; rows with a null
    series, id or time are in no series.
    """
    once = (
        snapshots.select(F.col(series).alias("series"), F.col(snapshot).alias("later"), F.col(taken).alias("taken"))
        .dropna()
        .groupBy("series", "later")
        .agg(F.max("taken").alias("taken"))
    )
    order = Window.partitionBy("series").orderBy("taken", "later")
    return once.select("series", F.lag("later").over(order).alias("earlier"), "later").where("earlier is not null")


def snapshot_changes(
    pairs: DataFrame, rows: DataFrame, snapshot: str, keys: list[str], values: list[str], version: str, broadcast_pairs: int = BROADCAST_PAIRS
) -> DataFrame:
    """Rows added, removed or changed per consecutive pair: (series, later, keys..., change).

    `pairs` has series, earlier, later. Of the rows of one (snapshot, keys), the one with the latest `version`
    counts; of several such rows that differ, the one with the greatest row hash, so the result never depends on
    row order; a null version is older than any. Null keys are keys like any other, null values are a value of
    their own, a snapshot without rows is an empty table. Other columns of `rows` are ignored.
    """
    tagged = pairs.select(
        F.col("series"),
        F.col("later"),
        F.explode(
            F.array(
                F.struct(F.col("later").alias("_snapshot"), F.lit(1).alias("_side")),
                F.struct(F.col("earlier").alias("_snapshot"), F.lit(0).alias("_side")),
            )
        ).alias("_s"),
    ).select(
        F.col("_s._snapshot").alias("_snapshot"),
        F.col("_s._side").alias("_side"),
        F.xxhash64("series", "later").alias("_p1"),
        F.xxhash64(F.lit(7), "later", "series").alias("_p2"),
    )
    few = pairs.count() <= broadcast_pairs
    age = F.coalesce(F.unix_micros(F.col(version).cast("timestamp")), F.lit(-(2**60)))
    state = age.cast("decimal(20,0)") * F.lit(_TWO64).cast("decimal(20,0)") + row_hash(values).cast("decimal(20,0)")
    slim = rows.select(F.col(snapshot).alias("_snapshot"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], state.alias("_state"))
    names = [f"_k{i}" for i in range(len(keys))]
    half, whole = (F.lit(x).cast("decimal(38,0)") for x in (_TWO63, _TWO64))
    hash_of = lambda c: F.pmod(F.col(c) + half, whole)
    if few:
        sided = slim.join(F.broadcast(tagged), "_snapshot")
    else:
        # A snapshot of very many rows is spread over SALT parts; a snapshot has two tags at most, so their copies stay few.
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt")
        sided = slim.withColumn("_salt", F.pmod(F.xxhash64(*names), F.lit(SALT)).cast("int")).join(tagged.select("*", salts), ["_snapshot", "_salt"])
    found = (
        sided
        .groupBy("_p1", "_p2", *names)
        .agg(F.max(F.when(F.col("_side") == 1, F.col("_state"))).alias("_after"), F.max(F.when(F.col("_side") == 0, F.col("_state"))).alias("_before"))
        .select(
            "_p1",
            "_p2",
            *names,
            F.when(F.col("_before").isNull(), "added")
            .when(F.col("_after").isNull(), "removed")
            .when(hash_of("_before") != hash_of("_after"), "changed")
            .alias("change"),
        )
        .where("change is not null")
    )
    named = pairs.select("series", "later", F.xxhash64("series", "later").alias("_p1"), F.xxhash64(F.lit(7), "later", "series").alias("_p2"))
    if few:
        named = F.broadcast(named)
    return found.join(named, ["_p1", "_p2"]).select("series", "later", *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "change")
