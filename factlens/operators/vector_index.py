"""A saved approximate index of vectors: cells around centres, of which a search visits the nearest.

The centres are fitted on a bounded sample; every row is filed in the cell of its nearest centre. A search compares the
query with the centres (bounded), reads the nearest cells only (they are folders of the saved index, so others are not
read) and ranks their rows exactly. `cells` as large as the index has are an exact search.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.operators import vectors

#: Rows the centres are fitted on, most centres, rounds of fitting.
SAMPLE, MOST, ROUNDS = 20_000, 1024, 10


@dataclass
class Index:
    """Rows (_rowid, _vec, _cell) with their centres."""

    rows: DataFrame
    centres: np.ndarray
    metric: str
    count: int

    def info(self) -> dict:
        """n, dims, cells and metric."""
        return {"n": self.count, "dims": int(self.centres.shape[1]) if self.count else 0, "cells": len(self.centres), "metric": self.metric}

    def save(self, path: str) -> None:
        """Writes the index to a folder."""
        self.rows.write.partitionBy("_cell").parquet(f"{path}/rows")
        text = json.dumps({"metric": self.metric, "count": self.count, "centres": self.centres.tolist()})
        self.rows.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/head")

    def nearest(self, query: list[float], k: int, cells: int | None = None) -> DataFrame:
        """(_rowid, _dist) of the k nearest rows in the nearest `cells` cells (by default a quarter of them, 8 at least)."""
        q = np.asarray(query, dtype=float)
        gap = self.centres @ q if self.metric == "ip" else 1 - (self.centres @ q) / np.maximum(np.linalg.norm(self.centres, axis=1) * np.linalg.norm(q), 1e-300) if self.metric == "cosine" else ((self.centres - q) ** 2).sum(1)
        order = np.argsort(-gap if self.metric == "ip" else gap, kind="stable")[: cells or max(8, len(self.centres) // 4)]
        return vectors.knn(self.rows.where(F.col("_cell").isin([int(i) for i in order])), "_rowid", F.col("_vec"), list(query), k, self.metric)


def _fit(x: np.ndarray, k: int) -> np.ndarray:
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        near = ((c * c).sum(1)[None, :] - 2 * (x @ c.T)).argmin(1)
        for j in range(k):
            if (near == j).any():
                c[j] = x[near == j].mean(0)
    return c


def build(df: DataFrame, key: str, vector: Column, metric: str = "cosine") -> Index:
    """An index of the rows with a key and a vector; about the square root of their number in cells, MOST at most."""
    rows = df.select(F.col(f"`{key}`").cast("long").alias("_rowid"), vector.cast("array<double>").alias("_vec")).where("_rowid is not null and _vec is not null")
    n = rows.count()
    if not n:
        return Index(rows.withColumn("_cell", F.lit(0)), np.zeros((0, 0)), metric, 0)
    x = np.array([r[0] for r in rows.orderBy(F.xxhash64("_rowid"), "_rowid").select("_vec").limit(SAMPLE).collect()])
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    x = unit(x) if metric == "cosine" else x
    centres = _fit(x, max(1, min(MOST, len(x), int(n**0.5))))
    shared = df.sparkSession.sparkContext.broadcast(centres)

    def file(batches):
        c = shared.value
        for b in batches:
            v = np.array(b["_vec"].tolist()) if len(b) else np.zeros((0, c.shape[1]))
            v = unit(v) if metric == "cosine" else v
            b["_cell"] = ((c * c).sum(1)[None, :] - 2 * (v @ c.T)).argmin(1).astype("int32")
            yield b

    return Index(rows.mapInPandas(file, "_rowid long, _vec array<double>, _cell int"), centres, metric, n)


def load(spark: SparkSession, path: str) -> Index:
    """A saved index."""
    head = json.loads(spark.read.text(f"{path}/head", wholetext=True).first()[0])
    return Index(spark.read.parquet(f"{path}/rows"), np.array(head["centres"], dtype=float), head["metric"], head["count"])
