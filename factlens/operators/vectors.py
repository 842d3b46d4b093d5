"""Vector distances and exact nearest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZERO = F.lit


def wide(df: DataFrame, prefix: str = "e") -> Column:
    """Columns e0, e1, ... as one array."""
    names = sorted((c for c in df.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()), key=lambda c: int(c[len(prefix) :]))
    return F.array(*[F.col(c).cast("double") for c in names])


def inner(a: Column, b: Column) -> Column:
    """Inner product; null if lengths differ or an element is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(inner(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null for a zero vector."""
    return F.lit(1.0) - inner(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """cosine, l2 or ip (the negated inner product, so that less is nearer)."""
    if metric not in ("cosine", "l2", "ip"):
        raise ValueError(f"unknown metric {metric}")
    return {"cosine": cosine_distance, "l2": l2_distance}[metric](a, b) if metric != "ip" else -inner(a, b)


def knn(df: DataFrame, id_col: str, vector: Column, query: list[float], k: int, metric: str = "cosine") -> DataFrame:
    """(_rowid, _dist) of the k rows nearest to the query, ties by id, in one top-k; rows without a distance are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.select(F.col(id_col).alias("_rowid"), distance(vector, q, metric).alias("_dist")).where("_dist is not null").orderBy("_dist", "_rowid").limit(k)
