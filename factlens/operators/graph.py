"""Graph operators over an edge table (src, dst): degrees, reach, cycles, levels, ranks, components and paths.

Edges with a null end are left out. Every loop is a fixpoint over DataFrames; nothing is collected but counts, except
where a docstring gives a bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlens.operators.fixpoint import grow
from factlens.session import checkpointed, settled


def build(df: DataFrame, src: str, dst: str, weight: str | None = None) -> DataFrame:
    """An edge table from two columns, parallel edges kept."""
    cols = [F.col(f"`{src}`").alias("src"), F.col(f"`{dst}`").alias("dst")] + ([F.col(f"`{weight}`").cast("double").alias("weight")] if weight else [])
    return df.select(*cols).where("src is not null and dst is not null")


def simple(edges: DataFrame) -> DataFrame:
    """Distinct edges without loops."""
    return edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct()


def nodes(edges: DataFrame) -> DataFrame:
    """All ends, as `node`."""
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).where("node is not null").distinct()


def info(edges: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, has_weights."""
    return edges.agg(F.count("*").alias("n_edges")).crossJoin(nodes(edges).agg(F.count("*").alias("n_nodes"))).select("n_nodes", "n_edges", F.lit("weight" in edges.columns).alias("has_weights"))


def degree(edges: DataFrame) -> DataFrame:
    """(_node, _in_degree, _out_degree, _degree); parallel edges and loops count."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("n"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("n"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    out = ends.groupBy(F.col("e.n").alias("_node")).agg(F.sum("e.i").alias("_in_degree"), F.sum("e.o").alias("_out_degree"))
    return out.where("_node is not null").withColumn("_degree", F.col("_in_degree") + F.col("_out_degree"))


def reach(edges: DataFrame, starts: DataFrame, least: int = 0, most: int | None = None) -> DataFrame:
    """(node, depth) within `most` steps of `starts` (node), by breadth; depth is the fewest steps, kept from `least` on."""
    step = simple(edges)
    first = starts.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0))

    def go(new: DataFrame, n: int) -> DataFrame:
        return new.join(step, new["node"] == step["src"]).select(F.col("dst").alias("node"), F.lit(n).alias("depth"))

    return grow(first, go, ["node"], most).where(F.col("depth") >= least)


def reverse(edges: DataFrame) -> DataFrame:
    """Edges turned round."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def blast_radius_of(edges: DataFrame, target: DataFrame) -> DataFrame:
    """(node, depth) of all that depends on the target nodes, themselves left out."""
    return reach(reverse(edges), target, 1)


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) of all pairs joined by a path of one edge or more.

    The result can hold the square of the node count; at scale, use `reach` or `cycle_members`.
    """
    step = simple(edges)

    def go(new: DataFrame, n: int) -> DataFrame:
        e = step.select(F.col("src").alias("m"), F.col("dst").alias("d"))
        return new.join(e, new["dst"] == e["m"]).select("src", F.col("d").alias("dst"))

    return grow(step, go, ["src", "dst"])


def reach_counts(edges: DataFrame) -> DataFrame:
    """(node, reached): how many other nodes each node can reach."""
    pairs = closure(edges).where("src <> dst").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("reached"))
    return nodes(edges).join(pairs, "node", "left").select("node", F.coalesce("reached", F.lit(0)).alias("reached"))


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges left when nodes without predecessor or successor are taken away until none is left: all cycles are among them."""
    left = checkpointed(simple(edges))
    n = left.count()
    while n:
        a, b = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
        smaller = checkpointed(left.join(a, "src", "left_semi").join(b, "dst", "left_semi").select("src", "dst"))
        m = smaller.count()
        if m == n:
            break
        left, n = smaller, m
    return left


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes on cycles, by colouring: linear memory, a few joins a round.

    The core without sources and sinks is coloured with the greatest node that reaches each node; within a colour, what
    reaches the node of that name is its component. Found components leave the core, and the rest is coloured again.
    """
    spark = edges.sparkSession
    left = trimmed(edges)
    kind = dict(left.dtypes)["src"]
    found = spark.createDataFrame([], f"node {kind}, component {kind}")
    while not left.isEmpty():
        colour = checkpointed(nodes(left).withColumn("colour", F.col("node")))
        while True:
            spread = left.join(colour, left["src"] == colour["node"]).groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("new"))
            after = colour.join(spread, "node", "left").select("node", F.greatest("colour", F.coalesce("new", "colour")).alias("colour"), (F.col("new") > F.col("colour")).alias("moved"))
            after = checkpointed(after)
            moved = not after.where("moved").isEmpty()
            colour = after.select("node", "colour")
            if not moved:
                break
        a = left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("ca")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("cb")), "dst")
        inside = checkpointed(a.where("ca = cb").select("src", "dst", F.col("ca").alias("colour")))
        roots = colour.where("node = colour").select("node", "colour")

        def back(new: DataFrame, n: int, inside: DataFrame = inside) -> DataFrame:
            i = inside.select("src", "dst", F.col("colour").alias("c"))
            return new.join(i, (new["node"] == i["dst"]) & (new["colour"] == i["c"])).select(F.col("src").alias("node"), F.col("c").alias("colour"))

        got = grow(roots, back, ["node"])
        found = checkpointed(found.unionByName(got.select("node", F.col("colour").alias("component"))))
        gone = got.select("node")
        rest = left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
        left = trimmed(rest)
    size = found.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    return found.join(size, "component").select("node", "component")


def cycle_members(edges: DataFrame) -> DataFrame:
    """(node) of the nodes that can reach themselves, loops aside."""
    return strong_components(edges).select("node")


def levels(edges: DataFrame, all_nodes: DataFrame | None = None) -> DataFrame:
    """(node, level): longest path from a source by peeling; a node in or behind a cycle keeps the greatest level its peeled parents gave it, else 0."""
    step = edges.select("src", "dst").where("src is not null and dst is not null and src <> dst")
    every = nodes(step) if all_nodes is None else all_nodes.select("node").union(nodes(step)).distinct()
    state = checkpointed(every.withColumn("level", F.lit(0)))
    left = checkpointed(step)
    peeled = checkpointed(every.limit(0))
    while True:
        free = checkpointed(state.join(left.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").join(peeled, "node", "left_anti"))
        if free.isEmpty():
            break
        out = left.join(free.select(F.col("node").alias("src"), "level"), "src")
        raised = out.groupBy(F.col("dst").alias("node")).agg((F.max("level") + 1).alias("up"))
        state = checkpointed(state.join(raised, "node", "left").select("node", F.greatest("level", F.coalesce("up", "level")).alias("level")))
        left = checkpointed(left.join(free.select(F.col("node").alias("src")), "src", "left_anti").select("src", "dst"))
        peeled = checkpointed(peeled.union(free.select("node")))
    return state


def topological(edges: DataFrame) -> DataFrame:
    """(_node, _order) by (round of peeling, node); nodes in or behind cycles are left out."""
    step = simple(edges)
    left, done = checkpointed(step), None
    open_ = checkpointed(nodes(step))
    n = 0
    while True:
        free = checkpointed(open_.join(left.select(F.col("dst").alias("node")).distinct(), "node", "left_anti"))
        if free.isEmpty():
            break
        part = free.withColumn("round", F.lit(n))
        done = part if done is None else checkpointed(done.unionByName(part))
        left = checkpointed(left.join(free.select(F.col("node").alias("src")), "src", "left_anti").select("src", "dst"))
        open_ = checkpointed(open_.join(free, "node", "left_anti"))
        n += 1
    if done is None:
        return open_.select(F.col("node").alias("_node"), F.lit(0).cast("long").alias("_order")).limit(0)
    # Numbers within a round from a window per round, offsets from the counts per round (one row each).
    sizes = done.groupBy("round").agg(F.count("*").alias("n"))
    before = sizes.withColumn("offset", F.coalesce(F.sum("n").over(Window.orderBy("round").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = done.withColumn("k", F.row_number().over(Window.partitionBy("round").orderBy("node")))
    return numbered.join(F.broadcast(before.select("round", "offset")), "round").select(F.col("node").alias("_node"), (F.col("offset") + F.col("k") - 1).alias("_order"))


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(_node, _rank); ranks sum to 1, a node without successors gives its rank to all nodes alike. Parallel edges count."""
    step = checkpointed(edges.select("src", "dst").where("src is not null and dst is not null"))
    every = checkpointed(nodes(step))
    n = every.count()
    if not n:
        return every.select(F.col("node").alias("_node"), F.lit(0.0).alias("_rank"))
    out = step.groupBy("src").agg(F.count("*").alias("out"))
    shares = checkpointed(step.groupBy("src", "dst").agg(F.count("*").alias("m")).join(out, "src").select("src", "dst", (F.col("m") / F.col("out")).alias("share")))
    ends = checkpointed(every.join(out.select(F.col("src").alias("node")), "node", "left_anti").withColumn("end", F.lit(True)))
    rank = checkpointed(every.join(ends, "node", "left").select("node", F.coalesce("end", F.lit(False)).alias("end"), F.lit(1.0 / n).alias("rank")))
    for _ in range(rounds):
        lost = rank.agg(F.coalesce(F.sum(F.when(F.col("end"), F.col("rank"))), F.lit(0.0))).first()[0]
        got = shares.join(rank.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("in"))
        rank = checkpointed(rank.join(got, "node", "left").select("node", "end", (F.lit((1 - damping) / n) + F.lit(damping) * (F.coalesce("in", F.lit(0.0)) + F.lit(lost / n))).alias("rank")))
    return rank.select(F.col("node").alias("_node"), F.col("rank").alias("_rank"))


def components(edges: DataFrame) -> DataFrame:
    """(_node, _component): weakly connected, named by their least node, with pointer jumping so that rounds grow with the log of the diameter."""
    both = settled(simple(edges).union(reverse(simple(edges)).select("src", "dst")).distinct())
    label = settled(nodes(edges).withColumn("label", F.col("node")))
    while True:
        near = both.join(label.select(F.col("node").alias("src"), "label"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("low"))
        lower = label.join(near, "node", "left").select("node", F.least("label", F.coalesce("low", "label")).alias("mid"), "label")
        jump = label.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        after = settled(lower.join(jump, "mid", "left").select("node", F.least("mid", F.coalesce("far", "mid")).alias("new"), "label"))
        moved = not after.where("new <> label").isEmpty()
        label = after.select("node", F.col("new").alias("label"))
        if not moved:
            return label.select(F.col("node").alias("_node"), F.col("label").alias("_component"))


def shortest(edges: DataFrame, source: DataFrame, weight: str | None = None) -> DataFrame:
    """(node, distance) from the source nodes, by relaxation of the nodes that changed; weights must not be negative."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    step = checkpointed(edges.select("src", "dst", w.alias("w")).where("src is not null and dst is not null").groupBy("src", "dst").agg(F.min("w").alias("w")))
    best = checkpointed(source.select("node").distinct().withColumn("distance", F.lit(0.0)))
    front = best
    while True:
        got = front.join(step, front["node"] == step["src"]).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("distance") + F.col("w")).alias("new"))
        better = checkpointed(got.join(best, "node", "left").where("distance is null or new < distance").select("node", F.col("new").alias("distance")))
        if better.isEmpty():
            return best
        best = checkpointed(best.join(better.select("node"), "node", "left_anti").unionByName(better))
        front = better


def shortest_path(edges: DataFrame, start: object, goal: object, weight: str | None = None) -> DataFrame:
    """(step, node) of a cheapest path, the least predecessor first on ties; empty if there is none. The path alone reaches the driver."""
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    dist = checkpointed(shortest(edges, spark.createDataFrame([(start,)], f"node {kind}"), weight))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    a, b = dist.select(F.col("node").alias("src"), F.col("distance").alias("da")), dist.select(F.col("node").alias("dst"), F.col("distance").alias("db"))
    tight = edges.select("src", "dst", w.alias("w")).join(a, "src").join(b, "dst").where(F.abs(F.col("da") + F.col("w") - F.col("db")) < 1e-9)
    prior = checkpointed(tight.groupBy("dst").agg(F.min("src").alias("src")))
    path = [goal] if not dist.where(F.col("node") == F.lit(goal)).isEmpty() else []
    while path and path[-1] != start:
        row = prior.where(F.col("dst") == F.lit(path[-1])).first()
        if row is None or row["src"] in path:
            break
        path.append(row["src"])
    return spark.createDataFrame([(i, n) for i, n in enumerate(reversed(path))], f"step int, node {kind}")


def clustering(edges: DataFrame) -> DataFrame:
    """(_node, _coefficient): closed share of the pairs of neighbours, edges taken without direction.

    Each triangle is found once, from its least-degree corner, so a hub never lists its own pairs.
    """
    und = simple(edges).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    und = checkpointed(und)
    deg = checkpointed(und.select(F.col("a").alias("node")).union(und.select("b")).groupBy("node").agg(F.count("*").alias("d")))
    e = und.join(deg.select(F.col("node").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("node").alias("b"), F.col("d").alias("db")), "b")
    low = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    up = checkpointed(e.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("v"), F.when(low, F.col("db")).otherwise(F.col("da")).alias("dv")))
    x, y = up.select("u", F.col("v").alias("v1")), up.select("u", F.col("v").alias("v2"))
    wedge = x.join(y, "u").where("v1 < v2")
    tri = wedge.join(und, (F.col("v1") == F.col("a")) & (F.col("v2") == F.col("b"))).select(F.explode(F.array("u", "v1", "v2")).alias("node"))
    t = tri.groupBy("node").agg(F.count("*").alias("t"))
    return deg.join(t, "node", "left").select(F.col("node").alias("_node"), F.when(F.col("d") < 2, F.lit(0.0)).otherwise(2.0 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).alias("_coefficient"))


def closeness(edges: DataFrame) -> DataFrame:
    """(_node, _closeness): reached / sum of distances, from breadth-first pairs; needs the closure, so for small graphs."""
    step = simple(edges)
    first = step.select("src", "dst", F.lit(1).alias("depth"))

    def go(new: DataFrame, n: int) -> DataFrame:
        s = step.select(F.col("src").alias("m"), F.col("dst").alias("d"))
        return new.join(s, new["dst"] == s["m"]).select("src", F.col("d").alias("dst"), F.lit(n + 1).alias("depth"))

    pairs = grow(first, go, ["src", "dst"]).where("src <> dst").groupBy(F.col("src").alias("node")).agg((F.count("*") / F.sum("depth")).alias("c"))
    return nodes(edges).join(pairs, "node", "left").select(F.col("node").alias("_node"), F.coalesce("c", F.lit(0.0)).alias("_closeness"))


def spanning_forest(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """(src, dst, weight) of a minimum spanning forest, by Boruvka rounds; ties by (weight, src, dst).

    A round keeps the lightest edge of each pair of parts only, so the graph shrinks with its parts, by half or more.
    """
    und = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.col(weight).cast("double").alias("weight")).where("src <> dst")
    cross = settled(und.groupBy(F.col("src").alias("pa"), F.col("dst").alias("pb")).agg(F.min("weight").alias("weight")).select("pa", "pb", F.struct("weight", F.col("pa").alias("src"), F.col("pb").alias("dst")).alias("k")))
    chosen = settled(cross.select("k.src", "k.dst", "k.weight").limit(0))
    while not cross.isEmpty():
        best = cross.select("pa", "pb", "k", F.explode(F.array("pa", "pb")).alias("part")).groupBy("part").agg(F.min(F.struct("k", "pa", "pb")).alias("b"))
        best = settled(best.select("b.*").distinct())
        chosen = settled(chosen.unionByName(best.select("k.src", "k.dst", "k.weight")))
        # Only the parts that this round joins are merged: every part with an edge out of it.
        merged = components(best.select(F.col("pa").alias("src"), F.col("pb").alias("dst")))
        a, b = merged.select(F.col("_node").alias("pa"), F.col("_component").alias("na")), merged.select(F.col("_node").alias("pb"), F.col("_component").alias("nb"))
        far = cross.join(a, "pa").join(b, "pb").where("na <> nb")
        cross = settled(far.groupBy(F.least("na", "nb").alias("pa"), F.greatest("na", "nb").alias("pb")).agg(F.min("k").alias("k")))
    return chosen


def random_walk(edges: DataFrame, starts: DataFrame, length: int, seed: int = 7) -> DataFrame:
    """(walk, step, node): one walk per start; the next node is the one of least hash of (seed, walk, step, node), so runs repeat."""
    step = simple(edges)
    here = checkpointed(starts.select(F.col("node").alias("walk"), F.col("node")).distinct())
    out = here.select("walk", F.lit(0).alias("step"), "node")
    for n in range(1, length + 1):
        draw = F.xxhash64(F.lit(seed), F.col("walk"), F.lit(n), F.col("dst"))
        here = checkpointed(here.join(step, here["node"] == step["src"]).groupBy("walk").agg(F.min_by("dst", draw).alias("node")))
        out = out.unionByName(here.select("walk", F.lit(n).alias("step"), "node"))
    return out


#: Edges that a depth-first order may hold at once: the order is sequential by nature.
DFS_EDGES = 5_000_000


def dfs(edges: DataFrame, start: object) -> DataFrame:
    """(_node, _depth, _order) of what `start` reaches, in depth-first preorder, the least neighbour first.

    What is reached is found by the distributed search first. A depth-first order needs the whole of it in one place: with
    over DFS_EDGES edges it is refused, never cut.
    """
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    inside = reach(edges, spark.createDataFrame([(start,)], f"node {kind}")).select(F.col("node").alias("src"))
    step = checkpointed(simple(edges).join(inside, "src", "left_semi").select("src", "dst"))
    if step.limit(DFS_EDGES + 1).count() > DFS_EDGES:
        raise ValueError(f"more than {DFS_EDGES} edges are no depth-first order")
    out: dict = {}
    for r in step.toLocalIterator():
        out.setdefault(r["src"], []).append(r["dst"])
    rows, seen, stack = [], set(), [(start, 0)]
    while stack:
        node, depth = stack.pop()
        if node in seen:
            continue
        seen.add(node)
        rows.append((node, depth, len(rows)))
        stack += [(n, depth + 1) for n in sorted(out.get(node, ()), reverse=True) if n not in seen]
    return spark.createDataFrame(rows, f"_node {kind}, _depth int, _order long")


def modularity(both: DataFrame, label: DataFrame) -> float:
    """The modularity of a labelling (node, label) over an undirected weight table (src, dst, w) that holds both directions."""
    j = both.join(label.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(label.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst")
    by = j.groupBy(F.col("a").alias("label")).agg(F.sum("w").alias("k"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("inner"))
    r = by.agg(F.sum("k").alias("m"), F.sum("inner").alias("i"), F.sum(F.col("k") * F.col("k")).alias("kk")).first()
    return r["i"] / r["m"] - r["kk"] / (r["m"] * r["m"]) if r["m"] else 0.0


def louvain(edges: DataFrame, rounds: int = 8, phases: int = 10) -> DataFrame:
    """(_node, _community): phases of moving nodes to the neighbouring community of most modularity gain, then merging each community to a node.

    Edges are taken without direction, parallel ones add up; a community is named by its least node. In a round only the
    nodes of one half move, so that neighbours do not swap for ever; a phase that does not raise the modularity ends the search.
    """
    und = edges.where("src is not null and dst is not null and src <> dst")
    both = und.select("src", "dst").union(reverse(und).select("src", "dst")).groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    both = first = settled(both)
    home = settled(nodes(edges).select("node", F.col("node").alias("label")))
    best = modularity(first, home)
    for _ in range(phases):
        degree = settled(both.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")))
        m = degree.agg(F.sum("k")).first()[0]
        if not m:
            break
        label = settled(degree.select("node", F.col("node").alias("label"), "k"))
        for n in range(rounds):
            total = label.groupBy("label").agg(F.sum("k").alias("tot"))
            into = both.where("src <> dst").join(label.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node"), "label").agg(F.sum("w").alias("inner"))
            own = label.select("node", "label", F.lit(0.0).alias("inner"))
            options = into.unionByName(own).groupBy("node", "label").agg(F.max("inner").alias("inner")).join(total, "label").join(label.select("node", F.col("label").alias("now"), "k"), "node")
            rest = F.col("tot") - F.when(F.col("label") == F.col("now"), F.col("k")).otherwise(0.0)
            gain = F.round(F.col("inner") - rest * F.col("k") / F.lit(m), 9)
            choice = options.groupBy("node").agg(F.max_by("label", F.struct(gain.alias("g"), (F.col("label") == F.col("now")).alias("s"), F.col("label"))).alias("new"))
            turn = F.pmod(F.xxhash64("node"), F.lit(2)) == n % 2
            after = settled(label.join(choice, "node").select("node", F.when(turn, F.col("new")).otherwise(F.col("label")).alias("label"), "k", (turn & (F.col("new") != F.col("label"))).alias("moved")))
            moved = not after.where("moved").isEmpty()
            label = after.select("node", "label", "k")
            if not moved and n:
                break
        merged = settled(home.join(label.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left").select("node", F.coalesce("new", "label").alias("label")))
        now = modularity(first, merged)
        if now <= best + 1e-9:
            break
        best, home = now, merged
        ends = label.select("node", "label")
        both = settled(both.join(ends.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(ends.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")))
    least = home.groupBy("label").agg(F.min("node").alias("c"))
    return home.join(least, "label").select(F.col("node").alias("_node"), F.col("c").alias("_community"))


def label_communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(_node, _community): rounds of moving each node to the community it has most edges to, the least on ties."""
    both = checkpointed(simple(edges).union(reverse(simple(edges)).select("src", "dst")).distinct())
    label = checkpointed(nodes(edges).withColumn("label", F.col("node")))
    for n in range(rounds):
        votes = both.join(label.select(F.col("node").alias("src"), "label"), "src").groupBy(F.col("dst").alias("node"), "label").agg(F.count("*").alias("v"))
        best = votes.groupBy("node").agg(F.min_by("label", F.struct((-F.col("v")).alias("a"), F.col("label").alias("b"))).alias("new"))
        # Half of the nodes move in a round, so that neighbours do not swap labels for ever.
        turn = F.pmod(F.xxhash64("node"), F.lit(2)) == n % 2
        label = checkpointed(label.join(best, "node", "left").select("node", F.when(turn, F.coalesce("new", "label")).otherwise(F.col("label")).alias("label")))
    return label.select(F.col("node").alias("_node"), F.col("label").alias("_community"))


def betweenness(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(_node, _betweenness) over shortest directed paths from `sources` (all nodes by default), unscaled.

    Forward, (source, node) pairs carry depth and path counts; backward, dependencies flow along the tight edges, one
    depth a round. The pairs are distributed; with all sources they are the square of the node count.
    """
    step = checkpointed(simple(edges))
    every = nodes(step)
    front = checkpointed((sources if sources is not None else every).select(F.col("node").alias("s"), F.col("node"), F.lit(0).alias("depth"), F.lit(1.0).alias("paths")).distinct())
    seen, n = front, 0
    while True:
        n += 1
        got = front.join(step, front["node"] == step["src"]).groupBy("s", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        front = checkpointed(got.join(seen.select("s", "node"), ["s", "node"], "left_anti").select("s", "node", F.lit(n).alias("depth"), "paths"))
        if front.isEmpty():
            break
        seen = checkpointed(seen.unionByName(front))
    credit = checkpointed(seen.select("s", "node", "depth", "paths", F.lit(0.0).alias("credit")))
    for depth in range(n - 1, 0, -1):
        late = credit.where(F.col("depth") == depth).select("s", F.col("node").alias("v"), F.col("paths").alias("pv"), F.col("credit").alias("cv"))
        early = credit.where(F.col("depth") == depth - 1).select("s", F.col("node").alias("u"), F.col("paths").alias("pu"))
        gain = late.join(step, F.col("v") == F.col("dst")).join(early.withColumnRenamed("s", "es"), (F.col("src") == F.col("u")) & (F.col("s") == F.col("es")))
        gain = gain.groupBy("s", F.col("u").alias("node")).agg(F.sum(F.col("pu") / F.col("pv") * (1 + F.col("cv"))).alias("gain"))
        credit = checkpointed(credit.join(gain, ["s", "node"], "left").select("s", "node", "depth", "paths", (F.col("credit") + F.coalesce("gain", F.lit(0.0))).alias("credit")))
    total = credit.where("s <> node").groupBy("node").agg(F.sum("credit").alias("b"))
    return every.join(total, "node", "left").select(F.col("node").alias("_node"), F.coalesce("b", F.lit(0.0)).alias("_betweenness"))


def k_shortest(edges: DataFrame, start: object, goal: object, k: int, longest: int | None = None) -> DataFrame:
    """(rank, length, path) of the k shortest loopless paths, of at most `longest` edges if given; ties by the path's nodes.

    Breadth-first over partial paths; a path that cannot be among the k shortest is not grown further, as paths of one
    length are all found before longer ones.
    """
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    step = simple(edges)
    alive = reach(reverse(edges), spark.createDataFrame([(goal,)], f"node {kind}"))
    step = checkpointed(step.join(alive.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"))
    front = spark.createDataFrame([(start, [start])], f"node {kind}, path array<{kind}>")
    found = spark.createDataFrame([], f"length int, path array<{kind}>")
    n = 0
    # Loopless paths end by themselves: none has more edges than the graph has nodes.
    while longest is None or n < longest:
        n += 1
        grown = front.join(step, front["node"] == step["src"]).where(~F.array_contains("path", F.col("dst"))).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        grown = checkpointed(grown)
        if grown.isEmpty():
            break
        found = checkpointed(found.unionByName(grown.where(F.col("node") == F.lit(goal)).select(F.lit(n).alias("length"), "path")))
        if found.count() >= k:
            break
        front = grown.where(F.col("node") != F.lit(goal))
    order = Window.orderBy("length", "path")
    return found.orderBy("length", "path").limit(k).withColumn("rank", F.row_number().over(order)).select("rank", "length", "path")
