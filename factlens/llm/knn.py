"""The k most similar vectors of every vector, by a hierarchical k-means tree with best-bin-first traversal.

1. Exact copies are grouped: one node per distinct vector, with its k+1 smallest ids. A group of copies of any size
   is thus one point of the search, and no pair inside it is ever listed.
2. A tree of spherical k-means is fitted on a bounded sample (distinct vectors of smallest hash, `sample_size` of them) and
   broadcast: its size is bounded by the sample. Its leaves hold about LEAF vectors each, so their number grows with the
   table. Every distinct vector is then filed in its leaf, and each leaf's radius (largest angle to its centre) is taken over all its vectors.
3. Each query walks the tree with a priority queue ordered by the best cosine a branch can still hold, radii scaled by a
   slack, and visits the first leaves that come out.
4. How many it visits is calibrated: the neighbours of a bounded set of sample queries are found exactly by brute force
   over all vectors, and the visit is widened until it holds the wanted recall. The work of a query is thus the
   same at every size of the table, at one recall.
5. At recall 1, and where no calibrated visit reaches the recall, a second wave widens the visit to every leaf whose bound
   beats the k-th similarity of the first: exact, but of work that grows with the square of the table where the vectors have no clusters.

Leaves are shipped in bins of about POINTS vectors: neighbouring leaves of the tree share a bin, wide leaves (which most
queries must visit) share bins of their own, and a leaf too large for one bin is cut into several, as are the queries
of a bin with too many; all sized from counts, so that no leaf is ever one task. A visited bin is searched whole; only where
the sample no longer lets leaves be small (above MOST_SAMPLE / 8 leaves), a bin holds up to LARGE vectors and has a tree
of its own, of which each query visits the nearest leaves with LOCAL vectors.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlens.session import written

#: Leaves visited by the first wave of an exact search, points of a leaf, of a bin and of a bin with its own tree, points visited in such a bin, queries of a share.
FIRST, LEAF, POINTS, LARGE, LOCAL, QUERIES = 3, 1024, 2048, 65_536, 8192, 16384
#: Bounds of the sample the tree is fitted on; between them it is one in 64 of the distinct vectors.
LEAST_SAMPLE, MOST_SAMPLE = 20_000, 200_000
#: Leaves tried by the calibration, and shares of the radii that order the queue.
VISITS, SLACKS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256), (0.0, 0.3, 0.5)
#: Vectors whose copies are joined by broadcast: each has over one in HOT of all rows.
HOT = 1000


def pack(df: DataFrame, id_col: str, components: list[str]) -> DataFrame:
    """(id, vec) of usable rows, vec as little-endian float32 bytes.

    A row is usable if its id and all components are there and finite and not all are zero. Zeros of either sign are equal.
    """

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([np.asarray(b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False), dtype=np.float64) for c in components])
            with np.errstate(over="ignore", invalid="ignore"):
                x = x.astype("<f4") + np.float32(0)
            good = np.isfinite(x).all(1) & (x != 0).any(1) & np.asarray(b.column(id_col).is_valid())
            x = np.ascontiguousarray(x[good])
            width = 4 * len(components)
            raw = pa.Array.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())
            ids = b.column(id_col).filter(pa.array(good)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, raw], names=["id", "vec"])

    return df.select(id_col, *components).mapInArrow(op, "id long, vec binary")


def unit(raws: list[bytes]) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.frombuffer(b"".join(raws), dtype="<f4").reshape(len(raws), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class Tree:
    """children[n] lists a node's children (none: a leaf); leaf[n] numbers the leaves; radii are angles."""

    centre: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray
    radius: np.ndarray

    @property
    def leaves(self) -> int:
        return int((self.leaf >= 0).sum())

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: greedy descent to the nearest child."""
        out = np.zeros(len(x), dtype=np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            n, rows = todo.pop()
            kids = self.children[n]
            if not len(kids):
                out[rows] = self.leaf[n]
                continue
            pick = (x[rows] @ self.centre[kids].T).argmax(1)
            todo += [(int(kids[j]), rows[pick == j]) for j in range(len(kids)) if (pick == j).any()]
        return out

    def widen(self, leaf_radius: np.ndarray) -> None:
        """Radii of all nodes from those of the leaves: an inner node covers what its leaves cover."""
        for n in range(len(self.children) - 1, -1, -1):
            kids = self.children[n]
            if not len(kids):
                self.radius[n] = leaf_radius[self.leaf[n]]
            else:
                away = np.arccos(np.clip(self.centre[kids] @ self.centre[n], -1, 1))
                self.radius[n] = min(math.pi, float((away + self.radius[kids]).max()))

    def prepare(self) -> None:
        """What a visit needs of each node: its children's centres, and cosine and sine of their radii."""
        self.at = [(kids.tolist(), self.centre[kids], self.radius[kids]) for kids in self.children]
        self.leaf_node = np.zeros(self.leaves, dtype=np.int64)
        self.leaf_node[self.leaf[self.leaf >= 0]] = np.flatnonzero(self.leaf >= 0)

    def walk(self) -> np.ndarray:
        """The leaves, neighbours of the tree next to each other."""
        out, todo = [], [0]
        while todo:
            n = todo.pop()
            if self.leaf[n] >= 0:
                out.append(int(self.leaf[n]))
            todo += self.children[n].tolist()
        return np.array(out)

    @staticmethod
    def best(cosine: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """The greatest cosine to a point within `radius` of a centre at this cosine."""
        c, s = np.cos(radius), np.sin(radius)
        out = cosine * c + np.sqrt(np.maximum(0.0, 1.0 - cosine * cosine)) * s
        return np.where(cosine >= c, 1.0, out)

    def visit(self, q: np.ndarray, slack: float, most: int) -> list[int]:
        """The first `most` leaves by best bin first."""
        heap, out = [(-1.0, 0)], []
        while heap and len(out) < most:
            _, n = heapq.heappop(heap)
            kids, centre, radius = self.at[n]
            if not kids:
                out.append(int(self.leaf[n]))
                continue
            for b, k in zip(self.best(centre @ q, slack * radius).tolist(), kids, strict=True):
                heapq.heappush(heap, (-b, k))
        return out

    def widen_to(self, q: np.ndarray, slack: float, above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) of all leaves whose bin can still beat each query's bound: where its queue would end."""
        node = self.leaf_node
        return np.nonzero(self.best(q @ self.centre[node].T, slack * self.radius[node]) >= above[:, None])


def fit(x: np.ndarray, branch: int, leaf_size: int, seed: int = 7) -> Tree:
    """Hierarchical spherical k-means on the sample; a node of at most `leaf_size` sample vectors, or of one direction only, is a leaf."""
    rng = np.random.default_rng(seed)
    centre: list[np.ndarray] = []
    children: list[np.ndarray] = []
    leaf: list[int] = []

    def mean(rows: np.ndarray) -> np.ndarray:
        m = x[rows].sum(0)
        n = np.linalg.norm(m)
        return m / n if n > 1e-12 else x[rows[0]]

    def add(c: np.ndarray) -> int:
        centre.append(c)
        children.append(np.zeros(0, dtype=np.int64))
        leaf.append(-1)
        return len(centre) - 1

    queue = [(add(mean(np.arange(len(x)))), np.arange(len(x)))]
    while queue:
        n, rows = queue.pop(0)
        parts: list[np.ndarray] = []
        if len(rows) > leaf_size:
            k = min(branch, max(2, len(rows) // leaf_size))
            cs = x[rng.choice(rows, k, replace=False)]
            for _ in range(8):
                pick = (x[rows] @ cs.T).argmax(1)
                cs = np.stack([mean(rows[pick == j]) if (pick == j).any() else cs[j] for j in range(k)])
            pick = (x[rows] @ cs.T).argmax(1)
            parts = [rows[pick == j] for j in range(k) if (pick == j).any()]
        if len(parts) < 2:
            leaf[n] = sum(v >= 0 for v in leaf)
            continue
        kids = [add(mean(p)) for p in parts]
        children[n] = np.array(kids)
        queue += list(zip(kids, parts, strict=True))
    return Tree(np.array(centre), children, np.array(leaf), np.zeros(len(centre)))


def top(sims: np.ndarray, k: int) -> np.ndarray:
    """Per row the places of the k greatest similarities (rounded to 6 decimals), of equal ones the first."""
    rows, width = sims.shape
    key = np.rint(sims * 1e6).astype(np.int64) * (width + 1) - np.arange(width)
    if width > k:
        part = np.argpartition(key, width - k, axis=1)[:, width - k :]
        key = np.take_along_axis(key, part, 1)
        return np.take_along_axis(part, np.argsort(-key, axis=1), 1)
    return np.argsort(-key, axis=1)


def nearest(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, similarity) of the k best points of each query, by comparison with all."""
    out = []
    for at in range(0, len(q), 256):
        sims = np.round(q[at : at + 256] @ x.T, 6)
        best = top(sims, k)
        out.append((np.repeat(np.arange(at, at + len(sims)), best.shape[1]), best.ravel(), np.take_along_axis(sims, best, 1).ravel()))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def nearest_local(q: np.ndarray, x: np.ndarray, k: int, points: int = LOCAL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`nearest` among the points of the nearest leaves of a tree over `x`, so many leaves that they hold `points`."""
    rng = np.random.default_rng(len(x))
    tree = fit(x[rng.permutation(len(x))[:16_384]], 12, 16)
    tree.prepare()
    leaf = tree.file(x)
    order = np.argsort(leaf, kind="stable")
    ends = np.cumsum(np.bincount(leaf, minlength=tree.leaves))
    size = np.diff(ends, prepend=0)
    centre = tree.centre[tree.leaf_node]
    asked: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(q), 1024):
        rank = np.argsort(-(q[at : at + 1024] @ centre.T), axis=1)
        held = np.cumsum(size[rank], axis=1) - size[rank]
        row, col = np.nonzero(held < points)
        asked.append((row + at, rank[row, col]))
    row, want = map(np.concatenate, zip(*asked, strict=True))
    by = np.argsort(want, kind="stable")
    row, want = row[by], want[by]
    out = []
    for part in np.split(np.arange(len(want)), np.flatnonzero(np.diff(want)) + 1):
        v = want[part[0]]
        mine = order[ends[v] - size[v] : ends[v]]
        if len(mine):
            a, b, sims = nearest(q[row[part]], x[mine], k)
            out.append((row[part][a], mine[b], sims))
    a, b, sims = map(np.concatenate, zip(*out, strict=True))
    by = np.lexsort((b, -sims, a))
    a, b, sims = a[by], b[by], sims[by]
    start = np.flatnonzero(np.diff(a, prepend=-1))
    keep = np.arange(len(a)) - np.repeat(start, np.diff(start, append=len(a))) < k
    return a[keep], b[keep], sims[keep]


def _search(k: int, whole: bool):
    def op(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(points):
            return pd.DataFrame({"q1": [], "q2": [], "sim": [], "low": [], "ids": []})
        points = points.sort_values("low", kind="stable")
        x, low, ids = unit(points["vec"].tolist()), points["low"].to_numpy(), points["ids"].to_numpy()
        q, h1, h2 = unit(queries["vec"].tolist()), queries["h1"].to_numpy(), queries["h2"].to_numpy()
        row, best, sims = nearest(q, x, k) if whole or len(x) <= 2 * LOCAL else nearest_local(q, x, k)
        return pd.DataFrame({"q1": h1[row], "q2": h2[row], "sim": sims, "low": low[best], "ids": ids[best]})

    return op


def bins(tree: Tree, radius: np.ndarray, size: np.ndarray, most: int = POINTS) -> tuple[np.ndarray, np.ndarray]:
    """(first bin, number of bins) of each leaf; leaves of no vectors have none, those of over `most` several."""
    order = tree.walk()
    full = size[order] > 0
    order = order[full]
    wide = radius[order] > 2 * np.median(radius[order]) + 1e-6
    first, count = np.zeros(tree.leaves, dtype=np.int64), np.zeros(tree.leaves, dtype=np.int64)
    n = -1
    for group in (order[~wide], order[wide]):
        held = POINTS + 1
        for leaf in group.tolist():
            if held + size[leaf] > POINTS:
                n, held = n + 1, 0
            first[leaf] = n
            count[leaf] = max(1, -(-int(size[leaf]) // most))
            held += int(size[leaf])
            if count[leaf] > 1:
                n, held = n + int(count[leaf]) - 1, POINTS + 1
    return first, count


def neighbours(
    vectors: DataFrame,
    k: int = 5,
    recall: float = 0.999,
    sample: int | None = None,
    branch: int = 12,
    leaf_sample: int = 8,
    sample_queries: int = 500,
) -> DataFrame:
    """(id, neighbour, sim): the k most similar other ids of every id of `vectors` (id, vec from `pack`).

    `recall` is the share of the true neighbours that is found, calibrated on `sample_queries` queries; 1 is exact. The tree is
    fitted on `sample` distinct vectors, by default one in 64, LEAST_SAMPLE at least and MOST_SAMPLE at most.

    Similarity is the cosine rounded to 6 decimals, ties go to the smaller id. An id that comes several times counts
    once (with its greatest vector, by bytes). Fewer than k others give fewer rows; no vectors give none.
    """
    spark = vectors.sparkSession
    once = vectors.groupBy("id").agg(F.max("vec").alias("vec")).withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(7), "vec")})
    once = written(once, "knn-vectors")
    first = Window.partitionBy("h1", "h2").orderBy("id")
    nodes = (
        once.withColumn("_n", F.row_number().over(first))
        .where(F.col("_n") <= k + 1)
        .groupBy("h1", "h2")
        .agg(F.first("vec").alias("vec"), F.min("id").alias("low"), F.sort_array(F.collect_list("id")).alias("ids"))
    )
    total = nodes.count()
    if not total:
        return spark.createDataFrame([], "id long, neighbour long, sim double")
    drawn = unit([bytes(r[0]) for r in nodes.orderBy("h1", "h2").select("vec").limit(sample or min(MOST_SAMPLE, max(LEAST_SAMPLE, total // 64))).collect()])
    exact = recall >= 1
    tree = fit(drawn, branch, leaf_sample if exact else max(leaf_sample, -(-len(drawn) * LEAF // total)))
    tree.prepare()
    shared = spark.sparkContext.broadcast(tree)

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = shared.value
        at = t.leaf_node
        for b in batches:
            x = unit(b["vec"].tolist()) if len(b) else np.zeros((0, t.centre.shape[1]))
            b["leaf"] = t.file(x)
            b["angle"] = np.arccos(np.clip((x * t.centre[at[b["leaf"].to_numpy()]]).sum(1), -1, 1))
            yield b

    filed = written(nodes.mapInPandas(file, "h1 long, h2 long, vec binary, low long, ids array<long>, leaf long, angle double"), "knn-filed")
    radius, size = np.zeros(tree.leaves), np.zeros(tree.leaves, dtype=np.int64)
    for r in filed.groupBy("leaf").agg(F.max("angle").alias("r"), F.count("*").alias("n")).collect():
        radius[r["leaf"]], size[r["leaf"]] = r["r"] + 1e-9, r["n"]
    tree.widen(radius)
    tree.prepare()
    shared = spark.sparkContext.broadcast(tree)

    first_bin, bin_count = bins(tree, radius, size, POINTS if exact else LARGE)
    plan = None if exact else _calibrated(filed, tree, k, recall, sample_queries, first_bin)
    if plan is None and not exact:
        exact, (first_bin, bin_count) = True, bins(tree, radius, size)
    most_leaves, order_slack = plan or (FIRST, 0.0)

    def visits(df: DataFrame, second: bool) -> DataFrame:
        def op(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            t = shared.value
            most = int((first_bin + bin_count).max())

            def cells(row: np.ndarray, leaf: np.ndarray) -> np.ndarray:
                times = bin_count[leaf]
                step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                return np.unique(np.repeat(row, times) * most + np.repeat(first_bin[leaf], times) + step)

            for whole in batches:
                for from_ in range(0, len(whole), 1024):
                    b = whole.iloc[from_ : from_ + 1024]
                    q = unit(b["vec"].tolist())
                    got = [t.visit(x, order_slack, most_leaves) for x in q]
                    cell = cells(np.repeat(np.arange(len(b)), [len(g) for g in got]), np.array([v for g in got for v in g], dtype=np.int64))
                    if second:
                        cell = np.setdiff1d(cells(*t.widen_to(q, 1.0, b["kth"].to_numpy() - 1e-6)), cell, assume_unique=True)
                    out = b[["h1", "h2", "vec"]].iloc[cell // most].copy()
                    out["bin"] = cell % most
                    yield out

        return df.mapInPandas(op, "h1 long, h2 long, vec binary, bin long")

    # One row per leaf, and one per bin: bounded by the sample and by rows / POINTS.
    place = F.broadcast(spark.createDataFrame([(i, int(first_bin[i]), int(bin_count[i])) for i in range(tree.leaves) if size[i]], "leaf long, first long, bins long"))
    binned = filed.join(place, "leaf").select((F.col("first") + F.pmod("h2", F.col("bins"))).alias("bin"), "vec", "low", "ids")

    def wave(df: DataFrame, name: str) -> DataFrame:
        asked = written(df, f"knn-{name}-visits")
        shares = [(r["bin"], max(1, -(-r["n"] // QUERIES))) for r in asked.groupBy("bin").agg(F.count("*").alias("n")).collect()]
        if not shares:
            return spark.createDataFrame([], "q1 long, q2 long, sim double, low long, ids array<long>")
        plan = F.broadcast(spark.createDataFrame(shares, "bin long, shares long"))
        q = asked.join(plan, "bin").withColumn("share", F.pmod(F.xxhash64("h1"), F.col("shares")))
        p = binned.join(plan, "bin").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
        by = ["bin", "share"]
        return (
            q.select(*by, "h1", "h2", "vec")
            .groupBy(*by)
            .cogroup(p.select(*by, "vec", "low", "ids").groupBy(*by))
            .applyInPandas(_search(k + 1, exact), "q1 long, q2 long, sim double, low long, ids array<long>")
        )

    order = Window.partitionBy("q1", "q2").orderBy(F.desc("sim"), "low")
    best = lambda df: df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
    one = written(best(wave(visits(filed.select("h1", "h2", "vec"), False), "first")).drop("_n"), "knn-one")
    entries = one
    if exact:
        held = one.groupBy("q1", "q2").agg(F.sum(F.size("ids")).alias("n"), F.min("sim").alias("kth"))
        # A query whose first wave holds k+1 entries has a bound; one with fewer has none and visits every leaf.
        open_ = filed.join(held, (F.col("h1") == F.col("q1")) & (F.col("h2") == F.col("q2")), "left").select(
            "h1", "h2", "vec", F.when(F.col("n") > k, F.col("kth")).otherwise(F.lit(-2.0)).alias("kth")
        )
        entries = best(one.unionByName(wave(visits(open_, True), "second")))
    entries = entries.select("q1", "q2", "sim", F.explode("ids").alias("neighbour"))
    ranked = (
        entries.withColumn("_n", F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("sim"), "neighbour")))
        .where(F.col("_n") <= k + 1)
        .groupBy("q1", "q2")
        .agg(F.sort_array(F.collect_list(F.struct("_n", "neighbour", "sim"))).alias("list"))
    )
    # A vector with very many copies is joined by broadcast (HOT rows at most), the others by a shuffle.
    hot = F.broadcast(once.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") > once.count() // HOT).select("h1", "h2", F.lit(True).alias("hot")))
    marked = once.select("id", "h1", "h2").join(hot, ["h1", "h2"], "left")
    lists = ranked.select(F.col("q1").alias("h1"), F.col("q2").alias("h2"), "list")
    few = marked.where("hot is null").join(lists, ["h1", "h2"])
    many = marked.where("hot").join(F.broadcast(lists.join(hot, ["h1", "h2"], "left_semi")), ["h1", "h2"])
    listed = few.unionByName(many).select("id", F.slice(F.filter("list", lambda e: e["neighbour"] != F.col("id")), 1, k).alias("list"))
    return listed.select("id", F.explode("list").alias("e")).select("id", "e.neighbour", "e.sim")


def _calibrated(filed: DataFrame, tree: Tree, k: int, recall: float, queries: int, bin_of: np.ndarray) -> tuple[int, float] | None:
    """(leaves, slack) of the shortest visits whose bins hold `recall` of the true neighbours of the sample queries; None if none does."""
    asked = [bytes(r[0]) for r in filed.orderBy("h2", "h1").select("vec").limit(queries).collect()]
    q = unit(asked)

    def op(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                b = b.sort_values("low", kind="stable")
                row, best, sims = nearest(q, unit(b["vec"].tolist()), min(k + 1, len(b)))
                yield pd.DataFrame({"q": row, "sim": sims, "low": b["low"].to_numpy()[best], "leaf": b["leaf"].to_numpy()[best]})

    w = Window.partitionBy("q").orderBy(F.desc("sim"), "low")
    found = filed.select("vec", "low", "leaf").mapInPandas(op, "q long, sim double, low long, leaf long").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k + 1)
    true: dict[int, list[int]] = {}
    for r in found.collect():  # at most queries * (k+1) rows
        true.setdefault(r["q"], []).append(int(bin_of[r["leaf"]]))
    best: tuple[int, float] | None = None
    for slack in SLACKS:
        # How many leaves a query must visit until it meets the bin of each neighbour.
        after = []
        for i, bins_ in true.items():
            met: dict[int, int] = {}
            for n, leaf in enumerate(tree.visit(q[i], slack, VISITS[-1]), 1):
                met.setdefault(int(bin_of[leaf]), n)
            after += [met.get(b, VISITS[-1] + 1) for b in bins_]
        needed = np.array(after)
        for most in VISITS:
            if (needed <= most).mean() >= recall:
                if best is None or most < best[0]:
                    best = (most, slack)
                break
    return best


def neighbour_pairs(listed: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of which one is among the nearest of the other."""
    return listed.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")).distinct()
