"""Betweenness and SimRank of networks of any size, by joins.

All sources, pairs or rows of a measure are carried side by side, keyed, so
that each round is one join with the links and one sum: the network is never
gathered, and a hub's links are dealt like all others before they are summed.
Nodes are what edges (src, dst, weight) name; links without a weight are left
out. A network without links gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import counted, kept
from . import graph

#: Lengths that differ by less than this share are equal: sums of fractions depend on their order.
SAME = 1e-9


def _total(parts: list[DataFrame], by: list[str], value: str) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy(*by).agg(F.sum(value).alias(value))


def _nodes(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def distances(links: DataFrame, pivots: DataFrame) -> DataFrame:
    """(pivot, node, d): lengths of the shortest paths along links (src, dst, weight) from each pivot (first column) to what it reaches.

    A round relaxes the links of those nodes only whose distance has just
    fallen, for all pivots at once. Lengths have to be more than 0, and a pivot
    that isn't in the network reaches itself alone.
    """
    steps = links.select(F.col("src").alias("node"), "dst", "weight")
    start = pivots.select(F.col(pivots.columns[0]).cast("long").alias("pivot")).distinct()
    best = start.select("pivot", F.col("pivot").alias("node"), F.lit(0.0).alias("d"), F.lit(True).alias("fresh"))
    best, seen = counted(best, "distances", fresh=F.count_if("fresh"))
    while seen["fresh"]:
        old = best.select("pivot", "node", "d", F.col("d").alias("was"))
        new = best.where("fresh").join(steps, "node").select("pivot", F.col("dst").alias("node"), (F.col("d") + F.col("weight")).alias("d"), F.lit(None).cast("double").alias("was"))
        both = old.union(new).groupBy("pivot", "node").agg(F.min("d").alias("d"), F.min("was").alias("was"))
        both = both.select("pivot", "node", "d", (F.col("was").isNull() | (F.col("d") < F.col("was"))).alias("fresh"))
        best, seen = counted(both, "distances", fresh=F.count_if("fresh"))
    return best.select("pivot", "node", "d")


def pivot_dependencies(links: DataFrame, pivots: DataFrame) -> DataFrame:
    """(pivot, node, paths, value): the number of shortest paths from the pivot to a node, and the shares of its paths to all others that pass the node.

    Paths are counted by their number of links: those of k + 1 links are those
    of k, joined with the links that lie on shortest paths. With s(v) paths to
    v, what v carries is s(v) y(v) - 1, y(v) = 1 / s(v) + sum of y over the
    nodes that come after v; this sum runs back along the same links. Both
    take as many rounds as a shortest path has links at most.
    """
    d = kept(distances(links, pivots), "distances")
    a = d.select("pivot", F.col("node").alias("src"), F.col("d").alias("d1"))
    b = d.select("pivot", F.col("node").alias("dst"), F.col("d").alias("d2"))
    on_path = (F.col("d1") < F.col("d2")) & (F.col("d1") + F.col("weight") <= F.col("d2") * (1 + SAME))
    dag = kept(a.join(links.select("src", "dst", "weight"), "src").join(b, ["pivot", "dst"]).where(on_path).select("pivot", "src", "dst"), "paths")
    forth, back = dag.select("pivot", F.col("src").alias("node"), F.col("dst").alias("to")), dag.select("pivot", F.col("dst").alias("node"), F.col("src").alias("to"))

    def along(x: DataFrame, steps: DataFrame) -> DataFrame:
        parts, rows = [x], 1
        while rows:
            x = x.join(steps, ["pivot", "node"]).groupBy("pivot", F.col("to").alias("node")).agg(F.sum("v").alias("v"))
            x, seen = counted(x, "steps")
            rows = seen["rows"]
            parts.append(x)
        return _total(parts, ["pivot", "node"], "v")

    s = kept(along(d.where("pivot = node").select("pivot", "node", F.lit(1.0).alias("v")), forth), "paths")
    y = along(s.select("pivot", "node", (1 / F.col("v")).alias("v")), back)
    both = s.withColumnRenamed("v", "paths").join(y, ["pivot", "node"])
    return both.select("pivot", "node", "paths", F.when(F.col("pivot") == F.col("node"), 0.0).otherwise(F.col("paths") * F.col("v") - 1).alias("value"))


def rev_flow_betweenness(e: DataFrame, pivots: int | DataFrame | None = None, seed: int = 0) -> DataFrame:
    """(node, value): betweenness over inverse weights of the symmetrised network, from int(ln n) pivots.

    ``pivots`` may be a number, -1 for all nodes, or a table of nodes. Pivots
    are drawn by a hash of the node, so they don't depend on the partitioning.
    Weights are 0 or more.
    """
    s = graph.inverse(graph.symmetrise(e.where("src <> dst"), "avg-sym")).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "weight")
    links, seen = counted(s.union(s.select("dst", "src", "weight")), "links", wrong=F.count_if(F.col("weight") <= 0))
    if seen["wrong"]:
        raise ValueError("a shortest path needs weights of 0 or more")
    nodes, seen = counted(_nodes(links), "nodes")
    n = seen["rows"]
    if isinstance(pivots, DataFrame):
        picked, seen = counted(pivots.select(F.col(pivots.columns[0]).cast("long").alias("node")).distinct().join(nodes, "node", "left_semi"), "pivots")
        k = seen["rows"]
    elif pivots == -1:
        picked, k = nodes, n
    else:
        k = min(n, pivots or max(1, int(math.log(max(n, 3)))))
        picked = nodes.orderBy(F.xxhash64(F.lit(seed), "node"), "node").limit(k)
    scale = (n / k) / ((n - 1) * (n - 2)) if n > 2 and k else 1.0
    got = pivot_dependencies(links, picked).groupBy("node").agg(F.sum("value").alias("v"))
    return nodes.join(got, "node", "left").select("node", (F.coalesce("v", F.lit(0.0)) * scale).alias("value"))


def _drawn_pairs(nodes: DataFrame, k: int, seed: int) -> DataFrame:
    """(pair, s, t): ``k`` pairs of different nodes, each the two nodes of least hash."""
    drawn = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("pair"))
    least = lambda salt: F.min(F.struct(F.xxhash64(F.lit(seed), F.lit(salt), "pair", "node"), "node"))["node"]
    first = kept(drawn.groupBy("pair").agg(least(1).alias("s")), "pairs")
    return kept(drawn.join(first, "pair").where("node <> s").groupBy("pair").agg(F.first("s").alias("s"), least(2).alias("t")), "pairs")


def potentials(links: DataFrame, pairs: DataFrame, tol: float = 1e-6, rounds: int = 1000) -> DataFrame:
    """(pair, node, x, ends): potentials when a unit current enters at s and leaves at t, for each pair (pair, s, t).

    Conjugate gradients on the Laplacian of a connected network, scaled by its
    diagonal, all pairs at once. A pair whose residual has fallen to ``tol`` of
    the first one stands still: its rows meet no links any more. Potentials are
    known up to a constant. More than ``rounds`` rounds raise an error.
    """
    deg = links.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("deg"))
    b = F.when(F.col("node") == F.col("s"), 1.0).when(F.col("node") == F.col("t"), -1.0).otherwise(0.0)
    rows = deg.crossJoin(pairs).select("pair", "node", "deg", (b != 0).alias("ends"), F.lit(0.0).alias("x"), b.alias("r"))  # a right-hand side has a value for each node
    now = kept(rows.withColumn("p", F.col("r") / F.col("deg")), "potentials")
    first = kept(now.groupBy("pair").agg(F.sum(F.col("r") ** 2 / F.col("deg")).alias("rz0")), "residuals")
    steps = links.select(F.col("src").alias("node"), F.col("dst").alias("to"), "weight")
    same = ("deg", "ends", "x", "r", "p")
    for _ in range(rounds):
        own = now.select("pair", "node", *same, (F.col("deg") * F.col("p")).alias("q"))
        kinds = {"ends": "boolean"}
        nothing = [F.lit(None).cast(kinds.get(c, "double")).alias(c) for c in same]
        around = now.where("p <> 0").select("pair", "node", F.col("p").alias("_p")).join(steps, "node").select("pair", F.col("to").alias("node"), *nothing, (-F.col("weight") * F.col("_p")).alias("q"))
        now = kept(own.union(around).groupBy("pair", "node").agg(*(F.max(c).alias(c) for c in same), F.sum("q").alias("q")), "potentials")
        r, q, p, d = (F.col(c) for c in ("r", "q", "p", "deg"))
        sums = now.groupBy("pair").agg(F.sum(r * r / d).alias("rz"), F.sum(p * q).alias("pq"), F.sum(q * r / d).alias("qz"), F.sum(q * q / d).alias("qq")).join(first, "pair")
        going = (F.col("pq") > 0) & (F.col("rz") > tol * tol * F.col("rz0"))
        a = F.col("rz") / F.col("pq")
        left = F.greatest(F.lit(0.0), F.col("rz") - 2 * a * F.col("qz") + a * a * F.col("qq"))
        by = sums.select("pair", F.when(going, a).otherwise(0.0).alias("a"), F.when(going & (left > tol * tol * F.col("rz0")), left / F.col("rz")).alias("b"))
        by, seen = counted(by, "residuals", going=F.count("b"))
        r2 = r - F.col("a") * q
        now = now.join(by, "pair").select("pair", "node", "deg", "ends", (F.col("x") + F.col("a") * p).alias("x"), r2.alias("r"), F.when(F.col("b").isNotNull(), r2 / d + F.col("b") * p).otherwise(0.0).alias("p"))
        if not seen["going"]:
            return now.select("pair", "node", "x", "ends")
    raise ValueError(f"the potentials haven't settled after {rounds} rounds")


def flow_betweenness(e: DataFrame, epsilon: float = 0.25, pairs: int | None = None, seed: int = 0, tol: float = 1e-6) -> DataFrame:
    """(node, value): current-flow betweenness of the symmetrised network, zeros if it isn't connected.

    The mean over drawn pairs of nodes, as many as keep the error within
    ``epsilon`` with high probability (Brandes and Fleischer 2005): c^2 ln n /
    epsilon^2, c = n / (n - 2); ``pairs`` is their number by itself, -1 for all
    pairs, which is exact but has a row for each node of each pair. Links of
    weight 0 carry nothing.
    """
    s = graph.symmetrise(e.where("src <> dst"), "avg-sym").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("weight"))
    s = kept(s, "links")
    nodes, seen = counted(_nodes(s), "nodes")
    n = seen["rows"]
    one = s.where("weight > 0")
    links = one.union(one.select("dst", "src", "weight"))
    if n < 3 or distances(links.withColumn("weight", F.lit(1.0)), nodes.orderBy("node").limit(1)).count() < n:
        return nodes.select("node", F.lit(0.0).alias("value"))
    whole = n * (n - 1) // 2
    k = math.ceil((n / (n - 2) / epsilon) ** 2 * math.log(n)) if pairs is None else pairs
    if pairs == -1:
        k, other = whole, nodes.withColumnRenamed("node", "t")
        drawn = kept(nodes.withColumnRenamed("node", "s").join(other, F.col("s") < F.col("t")).select(F.xxhash64("s", "t").alias("pair"), "s", "t"), "pairs")
    else:
        drawn = _drawn_pairs(nodes, k, seed)
    x = kept(potentials(links, drawn, tol), "potentials")
    a, b = (x.select("pair", F.col("node").alias(c), F.col("x").alias(f"x{c}"), F.col("ends").alias(f"e{c}")) for c in ("src", "dst"))
    current = F.col("weight") * F.abs(F.col("xsrc") - F.col("xdst")) / 2
    ends = one.join(a, "src").join(b, ["pair", "dst"]).select(current.alias("v"), F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("esrc").alias("ends")), F.struct(F.col("dst").alias("node"), F.col("edst").alias("ends")))).alias("at"))
    got = ends.where("not at.ends").groupBy(F.col("at.node").alias("node")).agg((F.sum("v") * (n / (n - 2) / k)).alias("v"))
    return nodes.join(got, "node", "left").select("node", F.coalesce("v", F.lit(0.0)).alias("value"))


def simrank(e: DataFrame, c: float = 0.9, rounds: int = 100, tol: float = 1e-4, least: float = 0.0) -> DataFrame:
    """(src, dst, weight): SimRank of all pairs above ``least``, from unweighted in-links.

    Two nodes are as alike as their in-neighbours are on average, times ``c``.
    A round carries similarities along the links of one node of a pair, then of
    the other, each a join and a sum; it is the last one if none has moved by
    ``tol``. The result has a row for each pair that is alike at all, so does
    the table between the rounds.
    """
    links = e.where("weight > 0").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct()
    ins = links.groupBy("dst").agg((1.0 / F.count("*")).alias("share"))
    links = kept(links.join(ins, "dst").select("src", "dst", "share"), "links")
    ones = kept(e.select(F.explode(F.array(F.col("src").cast("long"), F.col("dst").cast("long"))).alias("node")).distinct(), "nodes")
    s = ones.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(1.0).alias("v"))
    to_a, to_b = (links.select(F.col("src").alias(x), F.col("dst").alias("to"), "share") for x in "ab")
    for _ in range(rounds):
        half = s.join(to_b, "b").groupBy("a", F.col("to").alias("b")).agg(F.sum(F.col("v") * F.col("share")).alias("v"))
        full = half.join(to_a, "a").select(F.col("to").alias("a"), "b", (c * F.col("v") * F.col("share")).alias("v"), F.lit(0.0).alias("was"))
        # what was there before comes along, so that the change is known; every node is like itself
        both = full.union(s.select("a", "b", F.lit(0.0), "v")).groupBy("a", "b").agg(F.sum("v").alias("v"), F.sum("was").alias("was"))
        both = both.withColumn("v", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.col("v")))
        s, seen = counted(both, "similarities", moved=F.max(F.abs(F.col("v") - F.col("was"))))
        s = s.select("a", "b", "v")
        if seen["moved"] < tol:
            break
    return s.where(F.col("v") > least).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("v").alias("weight"))
