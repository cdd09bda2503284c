"""Clustering: Louvain, modularity, induced graphs, hierarchies of clusters."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import settled

#: A pass ends when modularity gains less.
LEAST_GAIN = 1e-7


def adjacency(pdf: pd.DataFrame) -> dict:
    """Undirected neighbour weights of edges (src, dst, weight); a loop is held once."""
    adj: dict = defaultdict(dict)
    for s, d, w in pdf[["src", "dst", "weight"]].itertuples(index=False):
        adj[s][d] = adj[s].get(d, 0.0) + w
        if s != d:
            adj[d][s] = adj[d].get(s, 0.0) + w
        else:
            adj[s]
    return adj


def _level(adj: dict, resolution: float, rng) -> dict:
    """Move single nodes to the neighbouring community of greatest gain until none moves."""
    degree = {n: sum(w for m, w in nb.items() if m != n) + 2 * nb.get(n, 0.0) for n, nb in adj.items()}
    whole = sum(degree.values()) / 2
    comm = {n: k for k, n in enumerate(adj)}
    tot = {comm[n]: degree[n] for n in adj}
    if whole == 0:
        return comm
    order = list(adj)
    moved, gained = True, True
    while moved and gained:
        moved, gained = False, False
        rng.shuffle(order)
        for n in order:
            mine = comm[n]
            near: dict = defaultdict(float)
            for m, w in adj[n].items():
                if m != n:
                    near[comm[m]] += w
            tot[mine] -= degree[n]
            stay = resolution * near.get(mine, 0.0) - tot[mine] * degree[n] / (2 * whole)
            best, best_gain = mine, 0.0
            for c, w in near.items():
                gain = resolution * w - tot[c] * degree[n] / (2 * whole) - stay
                if gain > best_gain + 1e-12:
                    best, best_gain = c, gain
            tot[best] += degree[n]
            comm[n] = best
            if best != mine:
                moved = True
                gained = gained or best_gain / whole > LEAST_GAIN
    names: dict = {}
    return {n: names.setdefault(comm[n], len(names)) for n in adj}


def fold(adj: dict, part: dict) -> dict:
    """The induced graph: weights between communities, loops for the weight inside."""
    out: dict = {c: {} for c in set(part.values())}
    for n, nb in adj.items():
        for m, w in nb.items():
            a, b = part[n], part[m]
            if a == b and n != m:
                w = w / 2  # seen from both ends
            out[a][b] = out[a].get(b, 0.0) + w
    return out


def modularity_of(adj: dict, part: dict) -> float:
    whole = sum(w if m != n else 2 * w for n, nb in adj.items() for m, w in nb.items()) / 2
    if whole == 0:
        raise ValueError("a graph without links has no modularity")
    inside, deg = defaultdict(float), defaultdict(float)
    for n, nb in adj.items():
        for m, w in nb.items():
            deg[part[n]] += 2 * w if m == n else w
            if part[n] == part[m]:
                inside[part[n]] += w if m == n else w / 2
    return sum(inside[c] / whole - (deg[c] / (2 * whole)) ** 2 for c in deg)


def dendrogram(adj: dict, resolution: float = 1.0, seed: int = 0) -> list[dict]:
    """Partitions by level: nodes to communities, then communities to communities."""
    rng = np.random.default_rng(seed)
    part = _level(adj, resolution, rng)
    out, graph = [part], adj
    if not any(w for nb in adj.values() for w in nb.values()):
        return out
    score = modularity_of(adj, part)
    flat = part
    while True:
        graph = fold(graph, part)
        part = _level(graph, resolution, rng)
        nxt = {n: part[c] for n, c in flat.items()}
        new = modularity_of(adj, nxt)
        if new - score < LEAST_GAIN:
            return out
        out.append(part)
        flat, score = nxt, new


def partition_at_level(levels: list[dict], level: int) -> dict:
    part = dict(levels[0])
    for k in range(1, level + 1):
        part = {n: levels[k][c] for n, c in part.items()}
    return part


def best_partition(adj: dict, resolution: float = 1.0, seed: int = 0) -> dict:
    levels = dendrogram(adj, resolution, seed)
    return partition_at_level(levels, len(levels) - 1)


def consensus(adj: dict, runs: int = 4, least: float = 0.5, resolution: float = 1.0) -> dict:
    """Louvain over the share of runs in which nodes fall together."""
    parts = [best_partition(adj, resolution, seed) for seed in range(runs)]
    together: dict = {n: {} for n in adj}
    for p in parts:
        groups = defaultdict(list)
        for n, c in p.items():
            groups[c].append(n)
        for g in groups.values():
            for i, a in enumerate(g):
                for b in g[:i]:
                    together[a][b] = together[b][a] = together[a].get(b, 0.0) + 1 / runs
    kept = {n: {m: w for m, w in nb.items() if w >= least} for n, nb in together.items()}
    return best_partition(kept, resolution, 0)


def _bits(x: float) -> float:
    return x * math.log2(x) if x > 0 else 0.0


def _strengths(adj: dict) -> dict:
    """Weight at each node; a loop counts twice."""
    return {n: sum(w if m != n else 2 * w for m, w in nb.items()) for n, nb in adj.items()}


def code_length(adj: dict, part: dict, time: float = 1.0) -> float:
    """Bits a step of a random walk that is named by two levels of code words, modules and their nodes; ``time`` scales the rate of leaving a module."""
    strength = _strengths(adj)
    whole = sum(strength.values())
    leave, stay = defaultdict(float), defaultdict(float)
    for n, nb in adj.items():
        stay[part[n]] += strength[n] / whole
        for m, w in nb.items():
            if part[m] != part[n]:
                leave[part[n]] += time * w / whole
    return _bits(sum(leave.values())) - sum(_bits(strength[n] / whole) for n in adj) + sum(_bits(leave[c] + stay[c]) - 2 * _bits(leave[c]) for c in stay)


def _shorter(adj: dict, time: float, rng) -> dict:
    """Move single nodes to the neighbouring module that shortens the code most, until none does."""
    strength = _strengths(adj)
    whole = sum(strength.values())
    size = {n: s / whole for n, s in strength.items()}
    out = {n: time * sum(w for m, w in nb.items() if m != n) / whole for n, nb in adj.items()}
    part = {n: k for k, n in enumerate(adj)}
    stay, leave = {part[n]: size[n] for n in adj}, {part[n]: out[n] for n in adj}
    total = sum(leave.values())
    terms = lambda q, p: _bits(q + p) - 2 * _bits(q)
    order, moved = list(adj), True
    while moved:
        moved = False
        rng.shuffle(order)
        for n in order:
            near: dict = defaultdict(float)
            for m, w in adj[n].items():
                if m != n:
                    near[part[m]] += time * w / whole
            a = part[n]
            left = leave[a] - out[n] + 2 * near.get(a, 0.0)
            best, gain = a, 1e-12
            for b, w in near.items():
                if b == a:
                    continue
                joined = leave[b] + out[n] - 2 * w
                after = total - leave[a] - leave[b] + left + joined
                new = _bits(after) + terms(left, stay[a] - size[n]) + terms(joined, stay[b] + size[n])
                old = _bits(total) + terms(leave[a], stay[a]) + terms(leave[b], stay[b])
                if old - new > gain:
                    best, gain = b, old - new
            if best != a:
                joined = leave[best] + out[n] - 2 * near[best]
                total += left + joined - leave[a] - leave[best]
                leave[a], leave[best] = left, joined
                stay[a] -= size[n]
                stay[best] += size[n]
                part[n], moved = best, True
    names: dict = {}
    return {n: names.setdefault(part[n], len(names)) for n in adj}


def map_equation(adj: dict, seed: int = 0, trials: int = 20, time: float = 1.0, least: int = 3) -> dict:
    """The two-level partition with the shortest code that ``trials`` runs find.

    The walk is on undirected links, as clusters are taken of symmetric networks.
    Where only one or two modules come out of more than ``least`` nodes, the
    time is lowered by 0.05 and again; the last result stands.
    """
    if not any(w for nb in adj.values() for w in nb.values()):
        return {n: k for k, n in enumerate(adj)}
    best, shortest = {}, math.inf
    for k in range(trials):
        rng, graph_ = np.random.default_rng(seed + k), adj
        flat = _shorter(adj, time, rng)
        part = flat
        while True:
            graph_ = fold(graph_, part)
            part = _shorter(graph_, time, rng)
            if len(set(part.values())) == len(graph_):
                break
            flat = {n: part[c] for n, c in flat.items()}
        length = code_length(adj, flat, time)
        if length < shortest - 1e-12:
            best, shortest = flat, length
    if len(set(best.values())) <= 2 and time - 0.05 > 1e-9 and len(adj) > least:
        return map_equation(adj, seed, trials, time - 0.05, least)
    return best


ALGORITHMS = {
    "louvain": lambda adj, resolution, seed: best_partition(adj, resolution, seed),
    "consensus_louvain": lambda adj, resolution, seed: consensus(adj, resolution=resolution),
    "map_equation": lambda adj, resolution, seed: map_equation(adj, seed),
}
#: Clusters of directed links, found by joins.
DIRECTED = "map_equation_directed"
#: Edges of one graph, which one task clusters; of a larger one Louvain goes by joins.
MOST_EDGES = 200_000


def cluster_edges(edges: DataFrame, by: list[str] = (), algorithm="louvain", resolution: float = 1.0, seed: int = 0) -> DataFrame:
    """(by..., node, cluster): clusters of many small graphs at once, one group each.

    ``algorithm`` is a name or a function of a frame of edges that returns a frame (node, cluster).
    Where a graph has more than MOST_EDGES edges, Louvain goes by joins and the others are refused, as is another name.
    ``map_equation`` takes links as undirected; ``map_equation_directed`` walks them, by joins for networks of any size.
    """
    from . import communities  # which finishes small networks with the searches above

    by = list(by)
    if not callable(algorithm) and algorithm not in (*ALGORITHMS, DIRECTED):
        raise NotImplementedError(f"no algorithm {algorithm!r}; there are {sorted((*ALGORITHMS, DIRECTED))}")
    numbered = lambda part: part.select(*by, "node", F.col("cluster").cast("long").alias("cluster"))
    if algorithm == DIRECTED:
        return numbered(communities.map_equation(edges, by, seed))
    largest = edges.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > MOST_EDGES and algorithm == "louvain":
        return numbered(communities.louvain(edges, by, resolution, seed, MOST_EDGES))
    if largest > MOST_EDGES:
        raise ValueError(f"a graph has {largest} edges, more than {MOST_EDGES}: condition the network first")
    rows = edges if by else edges.withColumn("_one", F.lit(0))
    keys = by or ["_one"]
    kinds = dict(rows.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if callable(algorithm):
            out = algorithm(pdf)
        else:
            # rows come in any order; the result must not depend on it
            part = ALGORITHMS[algorithm](adjacency(pdf.sort_values(["src", "dst"])), resolution, seed)
            out = pd.DataFrame({"node": list(part), "cluster": list(part.values())})
        for k in by:
            out[k] = pdf[k].iloc[0]
        return out[[*by, "node", "cluster"]]

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in by), f"node {kinds['src']}", "cluster long"])
    return rows.groupBy(*keys).applyInPandas(run, schema)


def modularity(edges: DataFrame, part: DataFrame) -> DataFrame:
    """One row: the modularity of undirected edges (each once) under part (node, cluster)."""
    a, b = (part.select(F.col("node").alias(x), F.col("cluster").alias(f"c_{x}")) for x in ("src", "dst"))
    e = edges.join(a, "src", "left").join(b, "dst", "left")
    e = e.select("weight", F.when(F.col("c_src").isNull() | F.col("c_dst").isNull(), F.raise_error(F.lit("a node has no cluster"))).otherwise(F.col("c_src")).alias("c_src"), "c_dst")
    whole = e.agg(F.sum("weight").alias("m"))
    inside = e.where("c_src = c_dst").groupBy(F.col("c_src").alias("c")).agg(F.sum("weight").alias("i"))
    deg = e.select(F.col("c_src").alias("c"), "weight").union(e.select("c_dst", "weight")).groupBy("c").agg(F.sum("weight").alias("d"))
    j = deg.join(inside, "c", "left").join(F.broadcast(whole), F.lit(True))
    return j.agg(F.sum(F.coalesce("i", F.lit(0.0)) / F.col("m") - (F.col("d") / (2 * F.col("m"))) ** 2).alias("modularity"))


def induced_graph(edges: DataFrame, part: DataFrame) -> DataFrame:
    """Undirected edges between clusters (src <= dst); loops hold the weight inside."""
    a, b = (part.select(F.col("node").alias(x), F.col("cluster").alias(f"c_{x}")) for x in ("src", "dst"))
    e = edges.join(a, "src").join(b, "dst")
    return e.groupBy(F.least("c_src", "c_dst").alias("src"), F.greatest("c_src", "c_dst").alias("dst")).agg(F.sum("weight").alias("weight"))


def hierarchy(edges: DataFrame, levels: int = 2, algorithm="louvain", interest: list | DataFrame | None = None, seed: int = 0) -> DataFrame:
    """(name, parent, level, node): clusters of clusters, named base, base-0, base-0-1 and so on.

    All graphs of a level are clustered in one job, whose result is settled, so that the next level and
    the result rest on the same clusters; ``interest`` keeps only branches that hold one of its nodes.
    """
    e = edges.withColumn("name", F.lit("base"))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    out = nodes.select(F.lit("base").alias("name"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("level"), "node")
    for k in range(levels):
        c = settled(cluster_edges(e, ["name"], algorithm, seed=seed)).withColumn("child", F.concat_ws("-", "name", F.col("cluster").cast("string")))
        if interest is not None:
            of = c.join(interest.toDF("node"), "node", "left_semi") if isinstance(interest, DataFrame) else c.where(F.col("node").isin(*interest))
            keep = of.select("child").distinct()
            c = c.join(keep, "child", "left_semi")
        out = out.unionByName(c.select(F.col("child").alias("name"), F.col("name").alias("parent"), F.lit(k + 1).alias("level"), "node"))
        a, b = (c.select("name", F.col("node").alias(x), F.col("child").alias(f"c_{x}")) for x in ("src", "dst"))
        e = e.join(a, ["name", "src"]).join(b, ["name", "dst"]).where("c_src = c_dst").select("src", "dst", "weight", F.col("c_src").alias("name"))
    return out


def cluster_distances(edges: DataFrame, part: DataFrame) -> DataFrame:
    """Per ordered pair of clusters: mean, min and max over the dense block, where absent ties are 0, and the pairs at both ends."""
    size = part.groupBy("cluster").agg(F.count("*").alias("n"))
    a, b = (part.select(F.col("node").alias(x), F.col("cluster").alias(f"c_{x}")) for x in ("src", "dst"))
    e = edges.join(a, "src").join(b, "dst").groupBy("c_src", "c_dst").agg(
        F.sum("weight").alias("s"), F.count("*").alias("k"), F.min("weight").alias("lo"), F.max("weight").alias("hi"),
        F.max_by(F.struct("src", "dst"), F.struct("weight", -F.col("src"), -F.col("dst"))).alias("far"),
    )
    j = e.join(size.select(F.col("cluster").alias("c_src"), F.col("n").alias("na")), "c_src").join(size.select(F.col("cluster").alias("c_dst"), F.col("n").alias("nb")), "c_dst")
    cells = F.col("na") * F.col("nb")
    low = F.when(F.col("k") < cells, F.least(F.lit(0.0), F.col("lo"))).otherwise(F.col("lo"))
    return j.select("c_src", "c_dst", (F.col("s") / cells).alias("mean"), low.alias("least"), F.greatest("hi", F.when(F.col("k") < cells, 0.0).otherwise(F.col("hi"))).alias("most"), F.col("far.src").alias("most_src"), F.col("far.dst").alias("most_dst"))
