"""Communities of networks of any size, by joins.

The local search of ``cluster`` moves one node after the other.  Here all nodes
weigh their moves at once: a join brings each node the flow to the modules
around it and the sums of these modules, and the best move is kept if it gains.
Moves of neighbours at the same time could undo each other, so in a round only
a part of the nodes may move, drawn by a hash; if the whole got worse, the
round is taken back and a smaller part tries.  When little moves any more,
modules become the nodes of a smaller network, and so on.  A network that has
become small enough is finished by the search in ``cluster``, all networks
side by side.

Two aims use the same rounds: modularity (undirected weights), and the map
equation on directed flow, whose stationary distribution is found by joins as
well.  Both are sums over modules, so each round's value comes from the rows it
writes anyway.  Nodes are integers; a module is named by one of its nodes.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import counted, kept
from . import cluster, measures

#: Edges up to which what is left of all networks is searched node by node.
SMALL = 200_000
#: Rounds of a level at most; the part of the nodes that may move at first and at least (1 in so many); the share of moves below which a level ends.
ROUNDS, FIRST_PART, LEAST_PART, SETTLED = 40, 4, 16, 0.002
LEAST_GAIN = 1e-7


def _plogp(x: Column) -> Column:
    return F.when(x > 1e-300, x * F.log2(x)).otherwise(0.0)


class Modularity:
    """Node sums: k, the weight at a node with loops twice. m2 is the weight at all nodes of a network."""

    sums = ("k",)

    def __init__(self, resolution: float = 1.0):
        self.resolution = resolution

    def gain(self) -> Column:
        """Of moving a node from its module to ``cand``; ``own_*`` are its module's sums, ``to_*`` those of ``cand``."""
        k = F.col("k")
        return (self.resolution * (F.col("out") - F.col("own_out")) - k * (F.col("to_k") - F.col("own_k") + k) / F.col("m2")) / F.col("m2")

    def value(self) -> Column:
        """A module's part of what is to grow; ``inner`` is the flow inside it, each link both ways, loops twice."""
        return F.col("inner") / F.col("m2") - F.pow(F.col("k") / F.col("m2"), 2)

    @staticmethod
    def whole(value: float, exits: float) -> float:
        return value


class MapEquation:
    """Node sums: p, the time spent at a node, and q, the flow that leaves it. The code is shortened, so its length counts with a minus."""

    sums = ("p", "q")

    def gain(self) -> Column:
        left = F.col("own_exit") - F.col("q") + F.col("own_out") + F.col("own_in")
        joined = F.col("to_exit") + F.col("q") - F.col("out") - F.col("in")
        after = F.greatest(F.col("exits") + left + joined - F.col("own_exit") - F.col("to_exit"), F.lit(0.0))
        term = lambda exit_, p: _plogp(F.greatest(exit_ + p, F.lit(0.0))) - 2 * _plogp(F.greatest(exit_, F.lit(0.0)))
        old = _plogp(F.col("exits")) + term(F.col("own_exit"), F.col("own_p")) + term(F.col("to_exit"), F.col("to_p"))
        return old - _plogp(after) - term(left, F.col("own_p") - F.col("p")) - term(joined, F.col("to_p") + F.col("p"))

    def value(self) -> Column:
        return 2 * _plogp(F.col("exit")) - _plogp(F.col("exit") + F.col("p"))


def _both_ways(e: DataFrame, by: list[str], directed: bool) -> DataFrame:
    """(by, src, dst, out, in): for every pair of linked nodes, from either end, what flows out and in; loops aside."""
    e, back = e.where("src <> dst"), F.lit(0.0) if directed else F.col("weight")
    one = e.select(*by, "src", "dst", F.col("weight").alias("out"), back.alias("in"))
    other = e.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"), back.alias("out"), F.col("weight").alias("in"))
    return one.union(other).groupBy(*by, "src", "dst").agg(F.sum("out").alias("out"), F.sum("in").alias("in"))


def _search(links: DataFrame, nodes: DataFrame, by: list[str], aim, seed: int, rounds: int = ROUNDS, first: DataFrame | None = None) -> DataFrame:
    """(by, node, c, sums...): modules of ``nodes`` (by, node, sums..., loop, and constants of the network) after rounds of moves from single nodes, or from the modules of ``first`` (by, node, cluster).

    ``links`` is a kept table of ``_both_ways``. Networks are taken together: a round counts if the sum of their values grows.
    """
    sums, directed = list(aim.sums), isinstance(aim, MapEquation)
    begin = nodes.withColumn("c", F.col("node")) if first is None else nodes.join(first.withColumnRenamed("cluster", "c"), [*by, "node"])
    best, part, value, quiet = kept(begin.select(*nodes.columns, "c"), "modules"), FIRST_PART, None, 0
    state = best
    for k in range(rounds):
        at = state.select(*by, F.col("node").alias("dst"), F.col("c").alias("cand"))
        own = state.select(*by, F.col("node").alias("src"), F.col("c").alias("cand"), F.lit(0.0).alias("out"), F.lit(0.0).alias("in"))
        near = links.join(at, [*by, "dst"]).select(*by, "src", "cand", "out", "in").union(own)  # a node's own module is always there
        near = kept(near.groupBy(*by, F.col("src").alias("node"), "cand").agg(F.sum("out").alias("out"), F.sum("in").alias("in")).join(state, [*by, "node"]), "near")
        inner = near.where("cand = c").groupBy(*by, "c").agg(F.sum("out").alias("inside"), *(F.sum(x).alias(x) for x in sums), F.sum("loop").alias("loops"), F.count("*").alias("size"), *(F.first(x).alias(x) for x in ("m2",) if not directed))
        inner = inner.withColumn("inner", F.col("inside") + 2 * F.col("loops"))
        inner = inner.withColumn("exit", F.greatest(F.col("q") - F.col("inside"), F.lit(0.0))) if directed else inner
        mods, seen = counted(inner, "sums", value=F.sum(aim.value()), exits=F.sum("exit") if directed else F.lit(0.0))
        if directed:
            each = mods.groupBy(*by).agg(F.sum("exit").alias("exits")) if by else mods.agg(F.sum("exit").alias("exits"))
            now = (each.agg(F.sum(-_plogp(F.col("exits"))).alias("x")).first()["x"] or 0.0) + seen["value"]
        else:
            each, now = None, seen["value"]
        if value is not None and now < value - 1e-12:  # these moves didn't go together
            part *= 2
            if part > LEAST_PART:
                return best
            near, mods, each = held
        else:
            best, value, held = state, now, (near, mods, each)
        names = [*sums, "size"] + (["exit"] if directed else [])
        to = mods.select(*by, F.col("c").alias("cand"), *(F.col(x).alias(f"to_{x}") for x in names))
        mine = mods.select(*by, "c", *(F.col(x).alias(f"own_{x}") for x in names))
        place = Window.partitionBy(*by, "node")
        j = near.join(to, [*by, "cand"]).join(mine, [*by, "c"])
        j = j.join(F.broadcast(each), by) if directed and by else j.crossJoin(F.broadcast(each)) if directed else j  # a row for each network
        for x in ("out", "in"):
            j = j.withColumn(f"own_{x}", F.max(F.when(F.col("cand") == F.col("c"), F.col(x))).over(place))
        away = (F.col("cand") != F.col("c")) & ~((F.col("own_size") == 1) & (F.col("to_size") == 1) & (F.col("cand") > F.col("c")))  # two single nodes don't change places
        may = F.pmod(F.xxhash64("node", F.lit(seed), F.lit(k // part)) + k, F.lit(part)) == 0  # once in ``part`` rounds
        score = F.when(away & may, aim.gain())
        chosen = j.groupBy(*by, "node").agg(F.max(F.struct(F.coalesce(score, F.lit(-1.0)).alias("gain"), (-F.col("cand")).alias("to"))).alias("b"), F.first("c").alias("c"), *(F.first(x).alias(x) for x in nodes.columns if x not in (*by, "node")))
        moves = F.col("b.gain") > 1e-12
        state, done = counted(chosen.select(*nodes.columns, F.when(moves, -F.col("b.to")).otherwise(F.col("c")).alias("c"), moves.alias("_moves")), "modules", moves=F.count_if("_moves"))
        state = state.drop("_moves")
        # every node had its turn without a move, or nearly so
        quiet = quiet + 1 if done["moves"] * part <= SETTLED * done["rows"] else 0
        if quiet >= 2 * part - 1:
            return best
    return best


def _folded(e: DataFrame, state: DataFrame, by: list[str], directed: bool) -> DataFrame:
    a, b = (state.select(*by, F.col("node").alias(x), F.col("c").alias(f"c_{x}")) for x in ("src", "dst"))
    j = e.join(a, [*by, "src"]).join(b, [*by, "dst"])
    ends = (F.col("c_src"), F.col("c_dst")) if directed else (F.least("c_src", "c_dst"), F.greatest("c_src", "c_dst"))
    return j.groupBy(*by, ends[0].alias("src"), ends[1].alias("dst")).agg(F.sum("weight").alias("weight"))


def _finish(e: DataFrame, by: list[str], search: Callable[[pd.DataFrame], dict]) -> DataFrame:
    """(by, node, c): each of the small networks that are left, in a task of its own; a module is named by its least node."""
    keys = by or ["_one"]
    e = e if by else e.withColumn("_one", F.lit(0))
    kinds = dict(e.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = search(pdf.sort_values(["src", "dst"]))
        out = pd.DataFrame({"node": list(part), "c": list(part.values())})
        out["c"] = out.groupby("c")["node"].transform("min")
        for k in by:
            out[k] = pdf[k].iloc[0]
        return out[[*by, "node", "c"]]

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in by), f"node {kinds['src']}", f"c {kinds['src']}"])
    return e.groupBy(*keys).applyInPandas(run, schema)


def _levels(e: DataFrame, by: list[str], start: Callable[[DataFrame], DataFrame], aim, search, seed: int, small: int) -> DataFrame:
    """(by, node, cluster, level): the partition of every level, the last one the best. ``start`` gives the nodes of a network with their sums."""
    directed = isinstance(aim, MapEquation)
    whole, size = counted(e, "edges")
    nodes = kept(start(whole), "nodes")
    flat, level, out, bottom = None, 0, None, None

    def onto(flat: DataFrame | None, part: DataFrame) -> DataFrame:
        if flat is None:
            return part.select(*by, "node", F.col("c").alias("cluster"))
        return flat.join(part.select(*by, F.col("node").alias("cluster"), "c"), [*by, "cluster"]).select(*by, "node", F.col("c").alias("cluster"))

    def refined() -> DataFrame:
        """The last partition after moves of single nodes in the network itself, as one more level."""
        if bottom is None or not level:
            return out
        better = _search(*bottom, by, aim, seed + 1000, first=flat)
        return out.unionByName(better.select(*by, "node", F.col("c").alias("cluster"), F.lit(level + 1).alias("level")))

    while True:
        last = size["rows"] <= small
        if last:
            part = _finish(whole, by, search)
            alone = nodes.join(part.select(*by, "node"), [*by, "node"], "left_anti").select(*by, "node", F.col("node").alias("c"))
            part = kept(part.unionByName(alone), "part")
        else:
            links = kept(_both_ways(whole, by, directed), "links")
            bottom = bottom or (links, nodes)
            part = _search(links, nodes, by, aim, seed + level)
        flat = kept(onto(flat, part), "flat")
        out = flat.withColumn("level", F.lit(level)) if out is None else out.unionByName(flat.withColumn("level", F.lit(level)))
        if last:
            return refined()
        whole, size = counted(_folded(whole, part, by, directed), "edges")
        loops = whole.where("src = dst").select(*by, F.col("src").alias("node"), F.col("weight").alias("loop"))
        rest = [x for x in nodes.columns if x not in (*by, "node", "loop")]
        folded = part.groupBy(*by, "c").agg(*(F.sum(x).alias(x) if x in aim.sums else F.first(x).alias(x) for x in rest)).withColumnRenamed("c", "node")
        new = folded.join(loops, [*by, "node"], "left").withColumn("loop", F.coalesce("loop", F.lit(0.0)))
        if directed:  # what flows inside a module doesn't leave the node that it becomes
            new = new.withColumn("q", F.greatest(F.col("q") - F.col("loop") + F.lit(0.0), F.lit(0.0)))
            outs = whole.where("src <> dst").groupBy(*by, F.col("src").alias("node")).agg(F.sum("weight").alias("_q"))
            new = new.join(outs, [*by, "node"], "left").withColumn("q", F.coalesce("_q", F.lit(0.0))).drop("_q")
        new, n = counted(new.select(*nodes.columns), "nodes")
        if n["rows"] == nodes.count():
            return refined()
        nodes, level = new, level + 1


def louvain_levels(edges: DataFrame, by: list[str] = (), resolution: float = 1.0, seed: int = 0, small: int = SMALL) -> DataFrame:
    """(by..., node, cluster, level): communities of undirected edges (by..., src, dst, weight), each pair once, at every level of the search.

    A network without weight has its nodes as clusters. ``small`` is the number
    of edges up to which the rest is searched node by node.
    """
    by = list(by)
    e = edges.select(*by, "src", "dst", F.col("weight").cast("double").alias("weight"))

    def start(e: DataFrame) -> DataFrame:
        ends = e.select(*by, F.col("src").alias("node"), "weight", F.when(F.col("src") == F.col("dst"), F.col("weight")).otherwise(0.0).alias("loop"))
        ends = ends.union(e.select(*by, F.col("dst").alias("node"), "weight", F.lit(0.0)))
        n = ends.groupBy(*by, "node").agg(F.sum("weight").alias("k"), F.sum("loop").alias("loop"))
        total = n.groupBy(*by).agg(F.greatest(F.sum("k"), F.lit(1e-300)).alias("m2"))
        return n.join(total, by) if by else n.crossJoin(F.broadcast(total))

    return _levels(e, by, start, Modularity(resolution), lambda pdf: cluster.best_partition(cluster.adjacency(pdf), resolution, seed), seed, small)


def last_level(levels: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by..., node, cluster) of the last level."""
    top = levels.agg(F.max("level").alias("_top"))
    return levels.join(F.broadcast(top), F.col("level") == F.col("_top")).select(*by, "node", "cluster")


def at_level(levels: DataFrame, level: int, by: list[str] = ()) -> DataFrame:
    return levels.where(F.col("level") == level).select(*by, "node", "cluster")


def louvain(edges: DataFrame, by: list[str] = (), resolution: float = 1.0, seed: int = 0, small: int = SMALL) -> DataFrame:
    return last_level(louvain_levels(edges, by, resolution, seed, small), list(by))


def flow(edges: DataFrame, by: list[str] = (), alpha: float = 0.85) -> DataFrame:
    """(by..., src, dst, weight): the share of a walk's steps that take each directed link; jumps off the links are made, but not counted."""
    by = list(by)
    e = edges.where("weight > 0").groupBy(*by, "src", "dst").agg(F.sum("weight").cast("double").alias("weight"))
    at = measures.pagerank_by(e, by, alpha).select(*by, F.col("node").alias("src"), "pagerank")
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy(*by, "src"))
    steps = e.join(at, [*by, "src"]).select(*by, "src", "dst", (F.col("pagerank") * share).alias("weight"))
    total = steps.groupBy(*by).agg(F.sum("weight").alias("_t"))
    return (steps.join(total, by) if by else steps.crossJoin(F.broadcast(total))).select(*by, "src", "dst", (F.col("weight") / F.col("_t")).alias("weight"))


def map_equation_levels(edges: DataFrame, by: list[str] = (), seed: int = 0, alpha: float = 0.85) -> DataFrame:
    """(by..., node, cluster, level): modules of directed links with a short two-level code of the walk on them, at every level of the search."""
    by = list(by)

    def start(e: DataFrame) -> DataFrame:
        ends = e.select(*by, F.col("src").alias("node"), F.lit(0.0).alias("p"), F.when(F.col("src") == F.col("dst"), 0.0).otherwise(F.col("weight")).alias("q"), F.when(F.col("src") == F.col("dst"), F.col("weight")).otherwise(0.0).alias("loop"))
        ends = ends.union(e.select(*by, F.col("dst"), F.col("weight"), F.lit(0.0), F.lit(0.0)))
        return ends.groupBy(*by, "node").agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.sum("loop").alias("loop"))

    return _levels(flow(edges, by, alpha), by, start, MapEquation(), None, seed, 0)


def map_equation(edges: DataFrame, by: list[str] = (), seed: int = 0, alpha: float = 0.85) -> DataFrame:
    return last_level(map_equation_levels(edges, by, seed, alpha), list(by))


def code_length(steps: DataFrame, part: DataFrame) -> DataFrame:
    """One row: the bits a step of a walk costs, given its links (``flow``) and modules (node, cluster)."""
    a, b = (part.select(F.col("node").alias(x), F.col("cluster").alias(f"c_{x}")) for x in ("src", "dst"))
    j = steps.join(a, "src").join(b, "dst")
    visits = j.groupBy(F.col("dst").alias("node"), F.col("c_dst").alias("c")).agg(F.sum("weight").alias("p"))
    p = visits.groupBy("c").agg(F.sum("p").alias("p"))
    q = j.where("c_src <> c_dst").groupBy(F.col("c_src").alias("c")).agg(F.sum("weight").alias("q"))
    m = p.join(q, "c", "full").fillna(0.0, ["p", "q"]).agg(F.sum("q").alias("all"), F.sum(_plogp(F.col("q") + F.col("p")) - 2 * _plogp(F.col("q"))).alias("m"))
    n = visits.agg(F.sum(_plogp(F.col("p"))).alias("n"))
    return m.crossJoin(n).select((_plogp(F.col("all")) + F.col("m") - F.col("n")).alias("bits"))
