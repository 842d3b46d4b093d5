"""The N best items of every group, by a global range-partitioned sort and prefix-summed positions.

The rows are range-partitioned and sorted by (group, score, identifier), so a group of any size spreads over as many
partitions as its rows need. Each partition numbers the rows of its groups and keeps the first N of each; a row
beyond its partition's N cannot be among the first N of its group. Only a group that runs on from the partition
before needs more than its local number: the counts of the partitions before are prefix-summed, one row per
partition, and added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlens.session import written


def _head(group: str, n: int):
    """Of a partition sorted by `group`: its first n rows per group, with their local number and the partition's number."""

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, seen = None, 0
        for b in batches:
            size = b.num_rows
            if not size:
                continue
            g = b.column(group)
            new = np.ones(size, dtype=bool)
            if size > 1:
                new[1:] = np.asarray(pc.not_equal(g.slice(1), g.slice(0, size - 1)).to_numpy(zero_copy_only=False), dtype=bool)
            head = g[0].as_py()
            run = head == last
            new[0] = True
            starts = np.flatnonzero(new)
            number = np.arange(size) - np.repeat(starts, np.diff(np.append(starts, size))) + 1
            if run:
                number[: starts[1] if len(starts) > 1 else size] += seen
            last, seen = g[size - 1].as_py(), int(number[-1])
            keep = number <= n
            out = b.filter(pa.array(keep))
            count = out.num_rows
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array(number[keep].astype(np.int64)), pa.array(np.full(count, part, dtype=np.int64))], names=[*out.schema.names, "_local", "_part"]
            )

    return op


def top_n(df: DataFrame, group: str, order: list[Column], n: int, position: str = "position") -> DataFrame:
    """The first n rows of every group in the given total order, with their exact position.

    Rows with a null group are left out. `order` must be total for a result that never depends on row order; rows
    that are equal in it are interchangeable. Groups with fewer than n rows are kept whole.
    """
    spark = df.sparkSession
    rows = df.where(F.col(group).isNotNull())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    sorted_ = rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    local = written(sorted_.mapInArrow(_head(group, n), f"{schema}, _local long, _part long"), "topn")
    runs = local.groupBy("_part", group).agg(F.max("_local").alias("rows"))
    # One row per range partition, so bounded by the number of partitions.
    ends = runs.groupBy("_part").agg(
        F.min(group).alias("first"), F.min_by("rows", group).alias("first_rows"), F.max(group).alias("last"), F.max_by("rows", group).alias("last_rows")
    )
    offsets, carry, before = [], 0, None
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):
        offset = carry if before is not None and r["first"] == before else 0
        if offset:
            offsets.append((r["_part"], r["first"], offset))
        carry = r["last_rows"] + (offset if r["first"] == r["last"] else 0)
        before = r["last"]
    kind = rows.schema[group].dataType.simpleString()
    shift = F.broadcast(spark.createDataFrame(offsets, f"_part long, `{group}` {kind}, _offset long"))
    return (
        local.join(shift, ["_part", group], "left")
        .withColumn(position, F.col("_local") + F.coalesce("_offset", F.lit(0)))
        .where(F.col(position) <= n)
        .select(*[F.col(c) for c in rows.columns], position)
    )


def best_rows(df: DataFrame, group: str, item: str, scores: list[str]) -> DataFrame:
    """One row per (group, item): the one with the greatest scores, compared in order, null below any number."""
    best = df.groupBy(group, item).agg(F.max(F.struct(*scores)).alias("_best"))
    return best.select(group, item, *[F.col(f"_best.{s}").alias(s) for s in scores])
