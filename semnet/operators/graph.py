"""Transforms of networks given as edges (src, dst, weight). Each returns new edges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import counted, kept, shared_dir

SYMMETRIES = ("avg-sym", "sum", "min-sym", "max-sym", "max-sym-keep", "min-sym-avg", "transpose")
#: Nodes up to which dense linear algebra runs on the driver.
DENSE_NODES = 3000


def settled(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the shared folder; without one a temporary folder on a single machine, an error on a cluster."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def reverse(e: DataFrame) -> DataFrame:
    swap = {"src": "dst", "dst": "src"}
    return e.select(*(F.col(swap[c]).alias(c) if c in swap else F.col(c) for c in e.columns))


def symmetrise(e: DataFrame, technique: str = "avg-sym", by: list[str] = ()) -> DataFrame:
    """One edge per unordered pair (src <= dst), in each network by itself where ``by`` names several. Loops stay, but transpose drops them."""
    if technique not in SYMMETRIES:
        raise AttributeError(f"unknown technique {technique!r}")
    pairs = e.groupBy(*by, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        F.sum("weight").alias("s"), F.min("weight").alias("lo"), F.max("weight").alias("hi"), F.count_distinct("src").alias("ways")
    )
    loop, mutual = F.col("a") == F.col("b"), F.col("ways") == 2
    value = {
        "avg-sym": F.col("s") / 2, "transpose": F.col("s") / 2, "sum": F.col("s"), "min-sym": F.when(mutual, F.col("lo")), "max-sym": F.when(mutual, F.col("hi")),
        "max-sym-keep": F.col("hi"), "min-sym-avg": F.when(mutual, F.col("s") / 2),
    }[technique]
    out = pairs.select(*by, F.col("a").alias("src"), F.col("b").alias("dst"), F.when(loop, F.lit(None) if technique == "transpose" else F.col("s")).otherwise(value).alias("weight"))
    return out.where("weight is not null")


def compositional(e: DataFrame, freq: DataFrame) -> DataFrame:
    """Divide by the frequency (token_id, freq) of the edge's end; 0 where that is 0 or unknown."""
    f = freq.select(F.col("token_id").alias("dst"), F.col("freq").alias("_f"))
    j = e.join(f, "dst", "left")
    return j.withColumn("weight", F.when(F.col("_f") > 0, F.col("weight") / F.col("_f")).otherwise(0.0)).select(*e.columns)


def scaled(e: DataFrame, by: DataFrame, column: str, unit: float = 1000.0) -> DataFrame:
    """Divide by a total (one row) per ``unit``, such as sequences or occurrences."""
    return e.join(F.broadcast(by.select(F.col(column).alias("_by"))), F.lit(True)).withColumn("weight", F.col("weight") / (F.col("_by") / unit)).drop("_by")


def sparsify(e: DataFrame, percent: float = 99) -> DataFrame:
    """Per source: the threshold is the weight after the last one whose running mass is within ``percent``; ties at it stay."""
    by = Window.partitionBy("src")
    order = by.orderBy(F.col("weight").desc(), "dst")
    running = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0))
    e2 = e.withColumn("_run", running).withColumn("_all", F.sum("weight").over(by)).withColumn("_n", F.count("*").over(by)).withColumn("_rank", F.row_number().over(order))
    within = (F.round("_run", 9) <= F.round(F.col("_all") * percent / 100, 9)) & (F.col("_run") > 0)
    e2 = e2.withColumn("_k", F.sum(within.cast("int")).over(by))
    limit = F.max(F.when(F.col("_rank") == F.least(F.col("_k") + 1, F.col("_n")), F.col("weight"))).over(by)
    return e2.withColumn("_limit", limit).where("weight >= _limit and weight > 0").select(*e.columns)


def cut_and_norm(e: DataFrame, cutoff: float | None = None, norm: bool = False) -> DataFrame:
    """Drop weights up to and including ``cutoff``; divide by the in-degree."""
    e = e if cutoff is None else e.where(F.col("weight") > cutoff)
    if not norm:
        return e
    s = F.sum("weight").over(Window.partitionBy("dst"))
    return e.withColumn("weight", F.when(s > 0, F.col("weight") / s).otherwise(F.col("weight")))


def max_degree(e: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("src").orderBy(F.col("weight").desc(), "dst")
    return e.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def keep_nodes(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes`` (first column)."""
    n = nodes.select(F.col(nodes.columns[0]).alias("_n"))
    return e.join(n, F.col("src") == F.col("_n"), "left_semi").join(n, F.col("dst") == F.col("_n"), "left_semi")


def prune_frequency(e: DataFrame, freq: DataFrame, least: int) -> DataFrame:
    return keep_nodes(e, freq.where(F.col("freq") >= least + 1).select("token_id"))


def inverse(e: DataFrame, eps: float = 1e-5) -> DataFrame:
    return e.withColumn("weight", 1 / (F.col("weight") + eps))


def softmax(e: DataFrame) -> DataFrame:
    """Per source, exponentials taken twice over, as the measure is defined."""
    by = Window.partitionBy("src")
    x = F.exp(F.col("weight") - F.max("weight").over(by))
    e2 = e.withColumn("_x", F.exp(x))
    return e2.withColumn("weight", F.col("_x") / F.sum("_x").over(by)).drop("_x")


def merge_nodes(e: DataFrame, mapping: DataFrame) -> DataFrame:
    """Fold node ``old`` into ``new``: ties are summed, ties between the two dropped."""
    m = mapping.select("old", "new")
    a = e.join(m.withColumnRenamed("old", "src").withColumnRenamed("new", "_s"), "src", "left").join(m.withColumnRenamed("old", "dst").withColumnRenamed("new", "_d"), "dst", "left")
    a = a.select(F.coalesce("_s", "src").alias("s"), F.coalesce("_d", "dst").alias("d"), "src", "dst", "weight").where("s <> d or src = dst")
    return a.groupBy(F.col("s").alias("src"), F.col("d").alias("dst")).agg(F.sum("weight").alias("weight"))


def plural_pairs(nodes: DataFrame) -> DataFrame:
    """(old, new): nodes (id, token) whose token is another's with an s."""
    one = nodes.select(F.col("id").alias("new"), F.concat("token", F.lit("s")).alias("token"))
    return nodes.select(F.col("id").alias("old"), "token").join(one, "token").select("old", "new")


def union_edges(*graphs: DataFrame) -> DataFrame:
    """Union in which the attributes of later graphs win."""
    rows = [g.withColumn("_k", F.lit(i)) for i, g in enumerate(graphs)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    cols = [c for c in graphs[0].columns if c not in ("src", "dst")]
    return out.groupBy("src", "dst").agg(F.max_by(F.struct(*cols), "_k").alias("x")).select("src", "dst", *(F.col(f"x.{c}") for c in cols))


def balls(e: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node): nodes within ``depth`` unweighted out-steps. The frontier is written out each round."""
    steps = e.select("src", "dst").where("src <> dst").distinct()
    reached = seeds.select(F.col(seeds.columns[0]).alias("seed")).distinct().withColumn("node", F.col("seed")).withColumn("d", F.lit(0))
    for k in range(depth):
        new = reached.where(F.col("d") == k).join(steps, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        new = new.join(reached.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("d", F.lit(k + 1))
        reached = settled(reached.unionByName(new))
    return reached.select("seed", "node")


def max_scaled(e: DataFrame) -> DataFrame:
    """Weights as shares of the largest."""
    return e.join(F.broadcast(e.agg(F.max("weight").alias("_top"))), F.lit(True)).withColumn("weight", F.col("weight") / F.col("_top")).drop("_top")


def ranked(e: DataFrame) -> DataFrame:
    """Neighbours in the order of weight, from 0."""
    return e.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.col("weight").desc(), "dst")) - 1)


def strongest(e: DataFrame, k: int = 100) -> DataFrame:
    """The ``k`` strongest ties of the whole network."""
    return e.orderBy(F.col("weight").desc(), "src", "dst").limit(k)


def search_ego(query, seeds: DataFrame, depth: int, top: int | None = None) -> DataFrame:
    """The ego net of ``seeds`` found from the inside out: only the ties of nodes that are reached are aggregated.

    ``query`` gives the out-edges of the nodes in a table (id); a node's ``top``
    strongest ones are kept. After ``depth`` + 1 rounds the union of the seeds'
    induced balls remains; for a depth of 0 the seeds' own edges.
    """
    new = seeds.select(F.col(seeds.columns[0]).alias("id")).distinct()
    known, edges = new, None
    for k in range(depth + 1):
        found = query(new)
        found = settled(found if top is None else max_degree(found, top))
        edges = found if edges is None else edges.unionByName(found)
        if k < depth:
            new = settled(found.select(F.col("dst").alias("id")).distinct().join(known, "id", "left_anti"))
            known = known.union(new)
    return ego_network(edges, seeds, depth) if depth else edges


def ego_network(e: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Union of the seeds' induced balls, which isn't the induced ball of the union."""
    b = balls(e, seeds, depth)
    inside = e.join(b.select(F.col("seed"), F.col("node").alias("src")), "src").join(b.select(F.col("seed").alias("_s"), F.col("node").alias("_d")), (F.col("dst") == F.col("_d")) & (F.col("seed") == F.col("_s")))
    return inside.select(*e.columns).distinct()


def dense(e: DataFrame, most: int = DENSE_NODES) -> tuple[list, np.ndarray]:
    """Nodes in order and the adjacency matrix of a small network; a larger one is refused, not cut."""
    nodes = e.select(F.col("src").alias("n")).union(e.select("dst")).distinct().limit(most + 1).toPandas()["n"].tolist()
    if len(nodes) > most:
        raise ValueError(f"more than {most} nodes: condition the network first")
    nodes = sorted(nodes)
    at = {n: k for k, n in enumerate(nodes)}
    a = np.zeros((len(nodes), len(nodes)))
    # one row per pair: no more than the square of the nodes
    for r in e.groupBy("src", "dst").agg(F.sum("weight").alias("weight")).toPandas().itertuples(index=False):
        a[at[r.src], at[r.dst]] += r.weight
    return nodes, a


def edges_of(spark, nodes: list, a: np.ndarray, undirected: bool = False) -> DataFrame:
    i, j = np.nonzero(np.triu(a) if undirected else a)
    return spark.createDataFrame(pd.DataFrame({"src": [int(nodes[k]) for k in i], "dst": [int(nodes[k]) for k in j], "weight": a[i, j].astype(float)}), "src long, dst long, weight double")


def back_out(e: DataFrame, decay: float | None = None, method: str = "invert") -> DataFrame:
    """Indirect ties: (I - dA)^-1, or its series up to 24 steps, without the diagonal, read as undirected."""
    nodes, a = dense(e)
    if decay is None:
        top = max(abs(np.linalg.eigvals(a))) if len(nodes) else 1.0
        decay = 1 / (1.5 * top) if top > 1e-12 else 1.0
    if method == "invert":
        b = np.linalg.inv(np.eye(len(nodes)) - decay * a)
    else:
        b, p = np.eye(len(nodes)), np.eye(len(nodes))
        for _ in range(24):
            p = decay * p @ a
            b = b + p
    np.fill_diagonal(b, 0)
    b[np.abs(b) < 1e-12] = 0
    # an undirected graph keeps the last value it is given for a pair: that below the diagonal, where there is one
    low = np.tril(b).T
    return edges_of(e.sparkSession, nodes, np.where(low != 0, low, np.triu(b)), undirected=True)


def spectral_radius(e: DataFrame, tol: float = 1e-8, rounds: int = 200) -> float:
    """The largest eigenvalue of a network with weights of zero or more, by power iteration with joins.

    A unit loop at every node keeps the iteration from alternating; it is taken
    off again. Of a network without cycles, where it is 0, the iteration only
    comes near.
    """
    a = kept(e.groupBy("src", "dst").agg(F.sum("weight").cast("double").alias("weight")), "links")
    x = a.select(F.col("src").alias("node")).union(a.select("dst")).distinct().withColumn("v", F.lit(1.0))
    x, seen = counted(x, "vector", whole=F.sum("v"))
    if not seen["rows"]:
        return 0.0
    found, before = 0.0, seen["whole"]
    for _ in range(rounds):
        moved = x.join(a, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("v") * F.col("weight")).alias("v"))
        new = x.union(moved).groupBy("node").agg((F.sum("v") / before).alias("v"))
        x, seen = counted(new, "vector", whole=F.sum("v"))
        last, found, before = found, seen["whole"] - 1, seen["whole"]
        if abs(found - last) <= tol * max(found, 1e-12):
            break
    return max(found, 0.0)


def back_out_rows(e: DataFrame, focal: DataFrame, decay: float | None = None, tol: float = 1e-9, steps: int | None = None) -> DataFrame:
    """(src, dst, weight): the rows of (I - dA)^-1 of some words without the diagonal, by the series of its powers.

    One set of joins carries all focal words, keyed by word; the network is
    never gathered. It ends when no entry of a step exceeds ``tol``, or after
    ``steps``. ``decay`` is by default 1 / 1.5 of the spectral radius.
    """
    if decay is None:
        top = spectral_radius(e)
        decay = 1 / (1.5 * top) if top > 1e-12 else 1.0
    a = kept(e.groupBy("src", "dst").agg((F.sum("weight") * decay).cast("double").alias("weight")), "links")
    x = focal.select(F.col(focal.columns[0]).alias("src")).distinct()
    x = x.select("src", F.col("src").alias("node"), F.lit(1.0).alias("v"))
    parts, k = [], 0
    while steps is None or k < steps:
        new = x.join(a.select(F.col("src").alias("node"), F.col("dst"), "weight"), "node").groupBy("src", F.col("dst").alias("node")).agg(F.sum(F.col("v") * F.col("weight")).alias("v"))
        x, seen = counted(new, "step", most=F.max(F.abs("v")))
        parts.append(x)
        k += 1
        if seen["most"] <= tol:
            break
        if seen["most"] > 1e100:
            raise ValueError("the series doesn't end: the decay is too large")
    out = parts[0] if parts else x
    for p in parts[1:]:
        out = out.union(p)
    return out.where("src <> node").groupBy("src", F.col("node").alias("dst")).agg(F.sum("v").alias("weight"))
