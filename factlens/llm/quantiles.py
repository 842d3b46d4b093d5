"""Percentiles per group by quantile digests over a bounded ordered universe.

Values are quantized to an ordered universe of 2**LEVELS codes: exact below 2**BITS, beyond that to BITS significant
bits (relative error 2**-BITS). A digest holds counts of nodes of the dyadic tree over the codes (root 1, children
2i and 2i+1). Compression moves a sibling pair into its parent while the three hold at most floor(eps * n / LEVELS)
values, so an inner node never holds more, and a value's rank is off by at most the inner nodes above it:
at most eps * n, whatever the order or split of the data. Digests merge by adding counts of equal nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Significant bits kept, and levels of the tree: codes of 63-bit values stay below 2**17.
BITS, LEVELS = 11, 17


def quantize(value: Column) -> Column:
    """The ordered code of a non-negative 64-bit integer."""
    shift = F.greatest(F.length(F.bin(value)) - (BITS + 1), F.lit(0))
    return shift.cast("long") * (1 << BITS) + F.call_function("shiftright", value, shift)


def highest(code: Column) -> Column:
    """The greatest value of a code (the value itself where codes are exact)."""
    shift = F.greatest((code / F.lit(1 << BITS)).cast("long") - 1, F.lit(0)).cast("int")
    mantissa = code - shift.cast("long") * (1 << BITS)
    return F.call_function("shiftleft", mantissa, shift) - 1 + F.call_function("shiftleft", F.lit(1).cast("long"), shift)


def compress(group: np.ndarray, node: np.ndarray, count: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compressed digests of many groups at once; `limit` is the most an inner node of each group may hold."""
    depth = np.frexp(node.astype(np.float64))[1] - 1
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    g, v, c = (a[depth == LEVELS] for a in (group, node, count))
    for level in range(LEVELS, 0, -1):
        up = depth == level - 1
        ug, uv, uc = group[up], node[up], count[up]
        # sums by (group, parent) of the children and of the parent itself
        key = np.concatenate([g * (1 << LEVELS) + (v >> 1), ug * (1 << LEVELS) + uv])
        name, back = np.unique(key, return_inverse=True)
        total = np.bincount(back, np.concatenate([c, uc]).astype(np.float64), len(name)).astype(np.int64)
        kids = np.bincount(back[: len(g)], minlength=len(name)) > 0
        own = np.bincount(back[len(g) :], uc.astype(np.float64), len(name)).astype(np.int64)
        gg = name // (1 << LEVELS)
        fold = kids & (total <= limit[gg])
        stay = ~fold[back[: len(g)]]
        kept.append((g[stay], v[stay], c[stay]))
        total = np.where(fold, total, own)
        there = total > 0
        g, v, c = gg[there], name[there] % (1 << LEVELS), total[there]
    kept.append((g, v, c))
    return tuple(np.concatenate(x) for x in zip(*kept, strict=True))


def _compressed(df: DataFrame, keys: list[str], eps: float) -> DataFrame:
    """(keys, node, n) compressed per group; a group has at most 2**(LEVELS+1) rows, so it fits one task at any input size."""

    def fold(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        group = np.cumsum(starts) - 1
        first = np.flatnonzero(starts)
        count = pdf["n"].to_numpy()
        total = np.bincount(group, count.astype(np.float64)).astype(np.int64)
        g, v, c = compress(group, pdf["node"].to_numpy(), count, np.floor(total * eps / LEVELS).astype(np.int64))
        out = pdf[keys].iloc[first[g]].reset_index(drop=True)
        out["node"], out["n"] = v, c
        return out

    def op(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for b in batches:
            if not len(b):
                continue
            pdf = b if held is None else pd.concat([held, b], ignore_index=True)
            starts = np.zeros(len(pdf), dtype=bool)
            for k in keys:
                code = pd.factorize(pdf[k], use_na_sentinel=True)[0]
                starts[1:] |= code[1:] != code[:-1]
            starts[0] = True
            last = np.flatnonzero(starts)[-1]
            if last:
                yield fold(pdf.iloc[:last], starts[:last])
            held = pdf.iloc[last:].reset_index(drop=True)
        if held is not None:
            starts = np.zeros(len(held), dtype=bool)
            starts[0] = True
            yield fold(held, starts)

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", node long, n long"
    return df.select(*keys, "node", "n").repartition(*keys).sortWithinPartitions(*keys).mapInPandas(op, schema)


def digests(df: DataFrame, keys: list[str], value: str, eps: float) -> DataFrame:
    """One digest per group, as rows (keys, node, n). Null and negative values are left out; null keys are a group."""
    v = F.col(value).cast("long")
    leaves = (
        df.where(v.isNotNull() & (v >= 0)).groupBy(*keys, (quantize(v) + F.lit(1 << LEVELS)).alias("node")).agg(F.count("*").alias("n"))
    )
    return _compressed(leaves, keys, eps)


def merged(digest: DataFrame, keys: list[str], eps: float) -> DataFrame:
    """Digests merged over all other key columns: counts of equal nodes are added, then compressed again."""
    return _compressed(digest.groupBy(*keys, "node").agg(F.sum("n").alias("n")), keys, eps)


def percentiles(digest: DataFrame, keys: list[str], shares: dict[str, float], eps: float) -> DataFrame:
    """(keys, n, one column per share, rank_error): a value whose rank is at least ceil(share * n) and too high by at most rank_error.

    Below 2**BITS the value is exact up to that rank; beyond, it is the top of its code. A group without values has no row.
    """
    level = F.length(F.bin("node")) - 1
    high = F.call_function("shiftleft", F.col("node") + 1, F.lit(LEVELS) - level) - 1 - (1 << LEVELS)
    w = Window.partitionBy(*keys)
    nodes = digest.select(*keys, "n", high.cast("long").alias("_high"), level.alias("_level"))
    ranked = nodes.withColumn("_sum", F.sum("n").over(w.orderBy("_high", F.desc("_level")).rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "_all", F.sum("n").over(w)
    )
    cols = [F.min(F.when(F.col("_sum") >= F.ceil(F.col("_all") * F.lit(p)), F.col("_high"))).alias(name) for name, p in shares.items()]
    out = ranked.groupBy(*keys).agg(F.max("_all").alias("n"), *cols)
    return out.select(*keys, "n", *[highest(F.col(name)).alias(name) for name in shares], F.floor(F.col("n") * F.lit(eps)).cast("long").alias("rank_error"))
