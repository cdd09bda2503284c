"""Measures of networks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import kept
from . import graph
from .queries import select_ties


def proximity(e: DataFrame, tokens=None, alters=None) -> DataFrame:
    """(token_id, alter_id, weight): out-neighbours of tokens."""
    e = e if tokens is None else e.where(F.col("src").isin(*tokens))
    e = e if alters is None else e.where(F.col("dst").isin(*alters))
    return e.select(F.col("src").alias("token_id"), F.col("dst").alias("alter_id"), "weight")


def yearly_proximities(t: DataFrame, tokens, windows: DataFrame) -> DataFrame:
    """(window, token_id, alter_id, weight): all windows (year, window) in one job."""
    r = select_ties(t, sub=tokens).join(F.broadcast(windows), F.col("time") == F.col("year"))
    return r.groupBy("window", F.col("sub").alias("token_id"), F.col("occ").alias("alter_id")).agg(F.sum("weight").alias("weight"))


def pagerank(e: DataFrame, alpha: float = 0.85, tol: float = 1e-6, rounds: int = 100) -> DataFrame:
    """(node, pagerank, normed): weighted, dangling mass spread evenly; networks beyond the dense guard use ``pagerank_joins``."""
    nodes, a = graph.dense(e)
    n = len(nodes)
    if not n:
        return e.sparkSession.createDataFrame([], "node long, pagerank double, normed double")
    out = a.sum(1)
    p = np.divide(a, out[:, None], out=np.zeros_like(a), where=out[:, None] > 0)
    x = np.full(n, 1 / n)
    for _ in range(rounds):
        y = alpha * (x @ p + x[out == 0].sum() / n) + (1 - alpha) / n
        if np.abs(y - x).sum() < n * tol:
            x = y
            break
        x = y
    return e.sparkSession.createDataFrame([(int(k), float(v), float(v / x.sum() * n)) for k, v in zip(nodes, x)], "node long, pagerank double, normed double")


def pagerank_joins(e: DataFrame, alpha: float = 0.85, rounds: int = 5) -> DataFrame:
    """(node, pagerank) after a fixed number of rounds, by joins: for networks of any size."""
    out = e.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("src"))).select("src", "dst", "share")
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    n = nodes.agg(F.count("*").alias("n"))
    rank = nodes.join(F.broadcast(n), F.lit(True)).withColumn("pr", 1 / F.col("n"))
    dangling = nodes.join(out.select(F.col("src").alias("node")).distinct(), "node", "left_anti").withColumn("dangling", F.lit(True))
    rank = rank.join(dangling, "node", "left")
    rank, out = graph.settled(rank), graph.settled(out)
    for _ in range(rounds):  # a round reads the ranks three times, so each is written
        lost = rank.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("pr"))), F.lit(0.0)).alias("lost"))
        got = rank.join(out, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("pr") * F.col("share")).alias("g"))
        nxt = rank.drop("pr").join(got, "node", "left").join(F.broadcast(lost), F.lit(True))
        rank = nxt.select("node", "n", "dangling", (alpha * (F.coalesce("g", F.lit(0.0)) + F.col("lost") / F.col("n")) + (1 - alpha) / F.col("n")).alias("pr"))
        rank = graph.settled(rank)
    return rank.select("node", F.col("pr").alias("pagerank"))


def pagerank_by(e: DataFrame, by: list[str] = (), alpha: float = 0.85, tol: float = 1e-6, rounds: int = 100) -> DataFrame:
    """(by..., node, pagerank, normed) of many networks in one set of joins; the mass of nodes without out-links is spread evenly.

    A network leaves the rounds when its ranks have moved by less than ``tol`` a node.
    """
    by = list(by)
    e = e.select(*by, "src", "dst", F.col("weight").cast("double").alias("weight"))
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy(*by, "src"))
    out = kept(e.withColumn("share", share).where("share > 0").select(*by, "src", "dst", "share"), "shares")
    nodes = e.select(*by, F.col("src").alias("node")).union(e.select(*by, "dst")).distinct()
    n = nodes.groupBy(*by).agg(F.count("*").cast("double").alias("n"))
    rank = nodes.join(n, by) if by else nodes.crossJoin(F.broadcast(n))
    ends = out.select(*by, F.col("src").alias("node"), F.lit(False).alias("loose")).distinct()
    rank = kept(rank.join(ends, [*by, "node"], "left").select(*by, "node", "n", F.coalesce("loose", F.lit(True)).alias("loose"), (1 / F.col("n")).alias("pr")), "ranks")
    done = rank.where("false")
    for _ in range(rounds):
        lost = rank.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("loose"), F.col("pr"))), F.lit(0.0)).alias("lost"))
        got = rank.select(*by, F.col("node").alias("src"), "pr").join(out, [*by, "src"]).groupBy(*by, F.col("dst").alias("node")).agg(F.sum(F.col("pr") * F.col("share")).alias("got"))
        nxt = rank.join(got, [*by, "node"], "left")
        nxt = nxt.join(lost, by) if by else nxt.crossJoin(F.broadcast(lost))
        new = alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / F.col("n")) + (1 - alpha) / F.col("n")
        rank = kept(nxt.select(*by, "node", "n", "loose", new.alias("pr"), F.abs(new - F.col("pr")).alias("_moved")), "ranks")
        moved = kept(rank.groupBy(*by).agg((F.sum("_moved") < F.first("n") * tol).alias("still")), "moved")  # a row for each network
        rank = rank.drop("_moved")
        state = moved.agg(F.count_if("still").alias("still"), F.count("*").alias("all")).first()
        if not by and state["still"] or state["still"] == state["all"]:
            break
        if state["still"]:
            gone = moved.where("still").select(*by)
            done, rank = done.union(rank.join(gone, by, "left_semi")), rank.join(gone, by, "left_anti")
    return done.union(rank).select(*by, "node", F.col("pr").alias("pagerank"), (F.col("pr") * F.col("n")).alias("normed"))


def pagerank_any(e: DataFrame) -> DataFrame:
    """(node, pagerank, normed): dense on small networks, by joins on others."""
    nodes = e.select("src").union(e.select("dst")).distinct()
    return pagerank(e) if nodes.limit(graph.DENSE_NODES + 1).count() <= graph.DENSE_NODES else pagerank_by(e)


CENTRALITIES = ("PageRank", "normedPageRank", "local_clustering", "weighted_local_clustering", "frequency")


def yearly_centralities(t: DataFrame, names: list[str], windows: DataFrame, transform=None, norm: bool = False, reverse: bool = False, compositional: bool = False, technique: str | None = None, rounds: int = 100) -> DataFrame:
    """(window, measure, token_id, value): centralities of each moving window (year, window) of the years.

    All windows are computed side by side, keyed by window: no task holds one.
    In this order, a window's weights are divided by a thousandth of its
    sequences (``norm``), turned around, made shares of the occurrences of the
    word at the end of a tie (``compositional``), and made symmetric by a
    ``technique``; ``transform`` is applied to its edges (window, src, dst,
    weight) after that. Frequencies are those of the window.
    """
    if unknown := set(names) - set(CENTRALITIES):
        raise AttributeError(f"unknown measures {sorted(unknown)}")
    near = t.join(F.broadcast(windows), F.col("time") == F.col("year"))
    edges = near.groupBy(F.col("window").cast("long").alias("window"), F.col("sub").cast("long").alias("src"), F.col("occ").cast("long").alias("dst")).agg(F.sum("weight").cast("double").alias("weight"))
    freq = near.groupBy(F.col("window").cast("long").alias("window"), F.col("occ").cast("long").alias("token_id")).agg(F.round(F.sum("weight")).alias("value"))
    if norm:
        n = near.groupBy(F.col("window").cast("long").alias("window")).agg((F.count_distinct("run_index") / 1000).alias("_n"))
        edges = edges.join(n, "window").withColumn("weight", F.col("weight") / F.col("_n")).drop("_n")
    edges = graph.reverse(edges) if reverse else edges
    if compositional:
        edges = edges.join(freq.select("window", F.col("token_id").alias("dst"), F.col("value").alias("_f")), ["window", "dst"], "left")
        edges = edges.select("window", "src", "dst", F.when(F.col("_f") > 0, F.col("weight") / F.col("_f")).otherwise(0.0).alias("weight"))
    edges = graph.symmetrise(edges, technique, ["window"]) if technique else edges
    edges = edges if transform is None else transform(edges)
    nodes = edges.select("window", F.explode(F.array("src", "dst")).alias("token_id")).distinct()
    # a symmetric network is walked both ways
    walked = edges.union(graph.reverse(edges.where("src <> dst"))) if technique else edges
    ranks = pagerank_by(walked, ["window"], rounds=rounds) if {"PageRank", "normedPageRank"} & set(names) else None
    out = None
    for name in names:
        if name in ("PageRank", "normedPageRank"):
            of = ranks.select("window", F.col("node").alias("token_id"), F.col("pagerank" if name == "PageRank" else "normed").alias("value"))
        elif name == "frequency":
            of = nodes.join(freq, ["window", "token_id"], "left")
        else:
            of = local_clustering(edges, name.startswith("weighted"), ["window"]).withColumnRenamed("node", "token_id").withColumnRenamed("clustering", "value")
            of = nodes.join(of, ["window", "token_id"], "left")  # nodes with loops alone
        of = of.select("window", F.lit(name).alias("measure"), "token_id", F.coalesce("value", F.lit(0.0)).alias("value"))
        out = of if out is None else out.unionByName(of)
    return out


def local_clustering(e: DataFrame, weighted: bool = False, by: list[str] = ()) -> DataFrame:
    """(by..., node, clustering) of directed networks: triangles over 2 (d(d-1) - 2 mutual); weights are cube roots of w / max.

    Every triangle is made once, at its end of least degree, so that a hub's
    neighbours are paired only where the hub is the lowest: a star of any size
    has no pairs at all. Its three nodes then share it.
    """
    by = list(by)
    e = e.where("src <> dst").select(*by, "src", "dst", "weight")
    top = e.groupBy(*by).agg(F.max("weight").alias("top"))
    value = F.pow(F.col("weight") / F.col("top"), 1 / 3) if weighted else F.lit(1.0)
    one = (e.join(top, by) if by else e.crossJoin(F.broadcast(top))).select(*by, "src", "dst", value.alias("w"))
    # w(u,v) + w(v,u) for each pair of neighbours, once
    pairs = one.groupBy(*by, F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.sum("w").alias("w"), F.count("*").alias("ways"))
    ends = pairs.select(*by, F.col("u").alias("node"), "ways").union(pairs.select(*by, "v", "ways"))
    deg = kept(ends.groupBy(*by, "node").agg(F.sum("ways").alias("d"), F.sum((F.col("ways") == 2).cast("int")).alias("m"), F.count("*").alias("links")), "degrees")
    du, dv = (deg.select(*by, F.col("node").alias(x), F.col("links").alias(f"d{x}")) for x in "uv")
    placed = pairs.join(du, [*by, "u"]).join(dv, [*by, "v"])
    u, v = (F.struct(F.col(f"d{x}").alias("links"), F.col(x).alias("node")) for x in "uv")
    low = u < v  # from the lower degree to the higher
    links = kept(placed.select(*by, F.when(low, F.col("u")).otherwise(F.col("v")).alias("x"), F.when(low, F.col("v")).otherwise(F.col("u")).alias("y"), F.when(low, v).otherwise(u).alias("rank"), "w"), "links")
    a, b = (links.select(*by, "x", F.col("y").alias(f"y{k}"), F.col("rank").alias(f"r{k}"), F.col("w").alias(f"w{k}")) for k in (1, 2))
    wedges = a.join(b, [*by, "x"]).where("r1 < r2")
    third = links.select(*by, F.col("x").alias("y1"), F.col("y").alias("y2"), F.col("w").alias("w3"))
    tri = wedges.join(third, [*by, "y1", "y2"]).select(*by, F.explode(F.array("x", "y1", "y2")).alias("node"), (2 * F.col("w1") * F.col("w2") * F.col("w3")).alias("t"))
    tri = tri.groupBy(*by, "node").agg(F.sum("t").alias("t"))
    whole = 2 * (F.col("d") * (F.col("d") - 1) - 2 * F.col("m"))
    return deg.join(tri, [*by, "node"], "left").select(*by, "node", F.when((whole > 0) & F.col("t").isNotNull(), F.col("t") / whole).otherwise(0.0).alias("clustering"))


def _mutual_weights(e: DataFrame) -> DataFrame:
    e = e.where("src <> dst").select("src", "dst", "weight")
    return e.union(e.select(F.col("dst"), F.col("src"), "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("w"))


def constraint(e: DataFrame) -> DataFrame:
    """(node, constraint): sum over neighbours j of (p_ij + sum_q p_iq p_qj)^2, p the share of mutual weight."""
    z = _mutual_weights(e)
    p = z.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("src"))).select("src", "dst", "p")
    a, b = p.select(F.col("src").alias("i"), F.col("dst").alias("q"), F.col("p").alias("p1")), p.select(F.col("src").alias("q"), F.col("dst").alias("j"), F.col("p").alias("p2"))
    two = a.join(b, "q").where("i <> j").groupBy("i", "j").agg(F.sum(F.col("p1") * F.col("p2")).alias("s"))
    j = p.join(two, (F.col("src") == F.col("i")) & (F.col("dst") == F.col("j")), "left")
    return j.groupBy(F.col("src").alias("node")).agg(F.sum((F.col("p") + F.coalesce("s", F.lit(0.0))) ** 2).alias("constraint"))


def effective_size(e: DataFrame) -> DataFrame:
    """(node, effective_size): sum over neighbours j of 1 - sum_q p_iq m_jq, m relative to j's strongest tie."""
    z = _mutual_weights(e)
    p = z.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("src"))).select(F.col("src").alias("i"), F.col("dst").alias("q"), "p")
    m = z.withColumn("m", F.col("w") / F.max("w").over(Window.partitionBy("src"))).select(F.col("src").alias("j"), F.col("dst").alias("q2"), "m")
    nb = z.select(F.col("src").alias("i2"), F.col("dst").alias("j2"))
    red = nb.join(p, F.col("i2") == F.col("i")).join(m, (F.col("j2") == F.col("j")) & (F.col("q") == F.col("q2"))).where("q <> i2")
    red = red.groupBy("i2").agg(F.sum(F.col("p") * F.col("m")).alias("r"))
    deg = z.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"))
    return deg.join(red, F.col("node") == F.col("i2"), "left").select("node", (F.col("n") - F.coalesce("r", F.lit(0.0))).alias("effective_size"))


def yearly_cosine(t: DataFrame, tokens) -> DataFrame:
    """(y1, y2, cosine): similarity of the yearly networks among tokens, over the upper triangle with the diagonal."""
    cells = select_ties(t, sub=tokens, occ=tokens).where("sub <= occ").groupBy("time", "sub", "occ").agg(F.sum("weight").alias("w"))
    a, b = (cells.select(F.col("time").alias(f"y{k}"), "sub", "occ", F.col("w").alias(f"w{k}")) for k in (1, 2))
    dot = a.join(b, ["sub", "occ"]).where("y1 <= y2").groupBy("y1", "y2").agg(F.sum(F.col("w1") * F.col("w2")).alias("dot"))
    norm = cells.groupBy("time").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("n"))
    n1, n2 = (norm.select(F.col("time").alias(f"y{k}"), F.col("n").alias(f"n{k}")) for k in (1, 2))
    return dot.join(n1, "y1").join(n2, "y2").select("y1", "y2", (F.col("dot") / (F.col("n1") * F.col("n2"))).alias("cosine"))


FIGURES = ("Avg", "w_Avg", "Std", "Sum")


def measured(x: Column, prefix: str = "") -> list[Column]:
    """Avg, w_Avg (sum x^2 / sum x; 0 where the sum isn't positive), Std (population, with two values at least) and Sum."""
    w_avg = F.when(F.sum(x) > 0, F.try_divide(F.sum(x * x), F.sum(x))).otherwise(0.0)
    values = (F.avg(x), w_avg, F.when(F.count(x) >= 2, F.stddev_pop(x)).otherwise(0.0), F.sum(x))
    return [v.alias(f"{prefix}{name}") for v, name in zip(values, FIGURES)]


def summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(*measured(F.col(value)))


def cluster_names(members: DataFrame, by: list[str], value: str = "weight", token: str = "token", k: int = 5) -> DataFrame:
    """The name of a cluster: its five heaviest tokens, joined by -."""
    w = Window.partitionBy(*by).orderBy(F.col(value).desc(), token)
    top = members.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return top.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", token))), lambda x: x[token].cast("string")), "-").alias("name"))


def wide(rows: DataFrame, index: str, columns: str, value: str, names: list | None = None) -> DataFrame:
    """Long to wide, 0 where nothing is."""
    return rows.groupBy(index).pivot(columns, names).agg(F.first(value)).fillna(0.0)


def cluster_proximities(members: DataFrame, prox: DataFrame) -> DataFrame:
    """(name, members, Avg, w_Avg, Std, Sum): proximities (alter_id, weight) of the members (name, node) of each cluster."""
    return summary(members.join(prox.select(F.col("alter_id").alias("node"), "weight"), "node"), ["name"], "weight")


def role_profile(context: DataFrame, k: int, by: list[str] = ("part_of_speech",), value: str = "weight") -> DataFrame:
    """Top ``k`` context words of each part of speech, and the mean over all years where ``time`` is a key."""
    w = Window.partitionBy(*by).orderBy(F.col(value).desc(), "e")
    return context.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def grouped_context(context: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, weight, sentiment, name): context words (e, weight, sentiment) gathered in groups (grp, e, token)."""
    j = context.join(groups, "e")
    return j.groupBy("grp").agg(F.sum("weight").alias("weight"), F.avg("sentiment").alias("sentiment")).join(cluster_names(j, ["grp"]), "grp")


def cluster_blocks(edges: DataFrame, part: DataFrame, factor: float = 1.0, how: str = "mean") -> DataFrame:
    """(src, dst, weight): ties between clusters, the mean (over all cells) or greatest of each block; 0 and less are dropped."""
    from .cluster import cluster_distances

    d = cluster_distances(edges, part)
    return d.select(F.col("c_src").alias("src"), F.col("c_dst").alias("dst"), (F.col("mean" if how == "mean" else "most") * factor).alias("weight")).where("weight > 0 and src <> dst")
