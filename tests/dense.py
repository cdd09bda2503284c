"""Measures of small networks on one machine, by matrices and searches, to hold those of the library against."""

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semnet.operators import graph


def flow_betweenness(e: DataFrame) -> DataFrame:
    """(node, value): exact current-flow betweenness of the symmetrised network; zeros if it isn't connected."""
    s = graph.symmetrise(e.where("src <> dst"), "avg-sym")
    nodes, a = graph.dense(s)
    a = a + a.T
    n = len(nodes)
    value = np.zeros(n)
    lap = np.diag(a.sum(1)) - a
    if n > 2 and np.linalg.matrix_rank(lap) == n - 1:
        g = np.linalg.pinv(lap)
        for i in range(n):
            through = np.zeros((n, n))
            for j in np.flatnonzero(a[i]):
                d = g[i] - g[j]
                through += a[i, j] * np.abs(d[:, None] - d[None, :])
            through[i, :] = 0
            through[:, i] = 0
            value[i] = np.triu(through, 1).sum() / 2
        value *= 2 / ((n - 1) * (n - 2))
    return e.sparkSession.createDataFrame([(int(k), float(v)) for k, v in zip(nodes, value)], "node long, value double")


def _pivot_paths(nodes: list, links: dict):
    def run(it):
        for b in it:
            total: dict = {}
            for s in b["pivot"]:
                dist, sigma, pred, order, heap, done = {s: 0.0}, {s: 1.0}, {}, [], [(0.0, s)], set()
                while heap:
                    d, v = heapq.heappop(heap)
                    if v in done:
                        continue
                    done.add(v)
                    order.append(v)
                    for u, w in links.get(v, ()):
                        nd = d + w
                        if u not in dist or nd < dist[u] - 1e-12:
                            dist[u], sigma[u], pred[u] = nd, sigma[v], [v]
                            heapq.heappush(heap, (nd, u))
                        elif abs(nd - dist[u]) <= 1e-12 and u not in done:
                            sigma[u] += sigma[v]
                            pred[u].append(v)
                delta = dict.fromkeys(order, 0.0)
                for v in reversed(order):
                    for u in pred.get(v, ()):
                        delta[u] += sigma[u] / sigma[v] * (1 + delta[v])
                    if v != s:
                        total[v] = total.get(v, 0.0) + delta[v]
            yield pd.DataFrame({"node": list(total), "value": list(total.values())}, columns=["node", "value"])

    return run


def rev_flow_betweenness(e: DataFrame, pivots: int | None = None, seed: int = 0) -> DataFrame:
    """(node, value): betweenness over inverse weights from int(ln n) pivots (all with ``pivots=-1``), pivots in parallel."""
    s = graph.inverse(graph.symmetrise(e.where("src <> dst"), "avg-sym"))
    nodes, a = graph.dense(s)
    a = a + a.T
    links = {int(nodes[i]): [(int(nodes[j]), float(a[i, j])) for j in np.flatnonzero(a[i])] for i in range(len(nodes))}
    n = len(nodes)
    k = n if pivots == -1 else pivots or max(1, int(math.log(max(n, 3))))
    picked = sorted(np.random.default_rng(seed).permutation([int(x) for x in nodes])[:k].tolist())
    spark = e.sparkSession
    rows = spark.createDataFrame([(p,) for p in picked], "pivot long").repartition(min(8, max(1, k)), "pivot")
    got = rows.mapInPandas(_pivot_paths(nodes, links), "node long, value double").groupBy("node").agg(F.sum("value").alias("v"))
    scale = (n / k) / ((n - 1) * (n - 2)) if n > 2 else 1.0
    every = spark.createDataFrame([(int(x),) for x in nodes], "node long")
    return every.join(got, "node", "left").select("node", (F.coalesce("v", F.lit(0.0)) * scale).alias("value"))


def simrank(e: DataFrame, c: float = 0.9, rounds: int = 100, tol: float = 1e-4) -> DataFrame:
    nodes, a = graph.dense(e)
    a = (a > 0).astype(float)
    ins = a.sum(0)
    w = np.divide(a, ins[None, :], out=np.zeros_like(a), where=ins[None, :] > 0)
    s = np.eye(len(nodes))
    for _ in range(rounds):
        nxt = c * w.T @ s @ w
        np.fill_diagonal(nxt, 1)
        if np.abs(nxt - s).max() < tol:
            s = nxt
            break
        s = nxt
    return graph.edges_of(e.sparkSession, nodes, s)
