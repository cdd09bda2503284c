"""Communities and centralities by joins, against the searches and matrices on one machine."""

import itertools
import math

import numpy as np
import pytest

from semnet.operators import cluster, communities, measures

# fixed values: friendships in a karate club (Zachary 1977)
KARATE = "2-1 3-1 3-2 4-1 4-2 4-3 5-1 6-1 7-1 7-5 7-6 8-1 8-2 8-3 8-4 9-1 9-3 10-3 11-1 11-5 11-6 12-1 13-1 13-4 14-1 14-2 14-3 14-4 17-6 17-7 18-1 18-2 20-1 20-2 22-1 22-2 26-24 26-25 28-3 28-24 28-25 29-3 30-24 30-27 31-2 31-9 32-1 32-25 32-26 32-29 33-3 33-9 33-15 33-16 33-19 33-21 33-23 33-24 33-30 33-31 33-32 34-9 34-10 34-14 34-15 34-16 34-19 34-20 34-21 34-23 34-24 34-27 34-28 34-29 34-30 34-31 34-32 34-33"
EDGES = "src int, dst int, weight double"


def edges(spark, rows, kind=EDGES):
    return spark.createDataFrame(rows, kind)


def parts(df, *by):
    out = {}
    for r in df.collect():
        out.setdefault((*(r[b] for b in by), r.cluster), set()).add(r.node)
    return out


def test_karate(spark):
    e = edges(spark, [(*map(int, p.split("-")), 1.0) for p in KARATE.split()])
    small = communities.louvain(e)
    assert cluster.modularity(e, small).first()[0] > 0.41
    levels = communities.louvain_levels(e, small=0)
    values = [cluster.modularity(e, communities.at_level(levels, k)).first()[0] for k in range(levels.agg({"level": "max"}).first()[0] + 1)]
    assert values == sorted(values) and values[-1] > 0.41 and levels.where("level = 0").count() == 34


def test_planted_parts(spark):
    """Two networks at once: cliques in a ring with a hub that knows everyone a little, and one without weight."""
    ring = [(10 * c + i, 10 * c + j, 1.0) for c in range(6) for i in range(6) for j in range(i)] + [(10 * c, 10 * ((c + 1) % 6), 0.1) for c in range(6)]
    hub = [(999, 10 * c + i, 0.01) for c in range(6) for i in range(6)]
    rows = [(1, *r) for r in ring + hub] + [(2, 1, 2, 0.0), (2, 3, 3, 0.0)]
    got = parts(communities.louvain(edges(spark, rows, "g int, src int, dst int, weight double"), ["g"], small=0), "g")
    first = [v - {999} for (g, _), v in got.items() if g == 1]
    assert sorted(map(sorted, first)) == [[10 * c + i for i in range(6)] for c in range(6)]
    assert sorted(map(sorted, (v for (g, _), v in got.items() if g == 2))) == [[1], [2], [3]]


def length(steps, part):
    plogp = lambda x: x * math.log2(x) if x > 0 else 0.0
    q, p, visits = {}, {}, {}
    for a, b, w in steps:
        visits[b] = visits.get(b, 0) + w
        p[part[b]] = p.get(part[b], 0) + w
        if part[a] != part[b]:
            q[part[a]] = q.get(part[a], 0) + w
    mods = set(part.values())
    return plogp(sum(q.values())) + sum(plogp(q.get(m, 0) + p.get(m, 0)) - 2 * plogp(q.get(m, 0)) for m in mods) - sum(map(plogp, visits.values()))


def partitions(nodes):
    if not nodes:
        yield []
        return
    for rest in partitions(nodes[1:]):
        yield [[nodes[0]], *rest]
        for k in range(len(rest)):
            yield [*rest[:k], [nodes[0], *rest[k]], *rest[k + 1 :]]


def test_map_equation_of_directed_links(spark):
    r = np.random.default_rng(2)
    # side by side: two cycles that meet, and random directed networks of six nodes
    nets = {0: [(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0), (3, 4, 1.0), (4, 5, 1.0), (5, 3, 1.0), (2, 3, 0.1), (5, 0, 0.1)]}
    nets |= {g: [(i, j, float(r.integers(1, 9))) for i in range(6) for j in range(6) if i != j and r.random() < (0.9 if i // 3 == j // 3 else 0.2)] + [(0, 3, 1.0), (3, 0, 1.0)] for g in (1, 2)}
    e = edges(spark, [(g, *x) for g, rows in nets.items() for x in rows], "g int, src int, dst int, weight double")
    steps = {}
    for x in communities.flow(e, ["g"]).collect():
        steps.setdefault(x.g, []).append((x.src, x.dst, x.weight))
    assert all(abs(sum(w for *_, w in s) - 1) < 1e-9 for s in steps.values())
    got = {g: {} for g in nets}
    for x in communities.map_equation(e, ["g"]).collect():
        got[x.g][x.node] = x.cluster
    for g, s in steps.items():
        nodes = sorted(got[g])
        best = min(length(s, {n: k for k, m in enumerate(p) for n in m}) for p in partitions(nodes))
        assert length(s, got[g]) <= best + 0.03 * abs(best)
    assert len(set(got[0].values())) == 2 and len({got[0][n] for n in (0, 1, 2)}) == 1
    one = e.where("g = 1").drop("g")
    part = spark.createDataFrame(list(got[1].items()), "node int, cluster int")
    assert abs(communities.code_length(communities.flow(one), part).first().bits - length(steps[1], got[1])) < 1e-9


def test_pagerank_side_by_side(spark):
    r = np.random.default_rng(1)
    rows = [(g, int(a), int(b), float(w)) for g in (1, 2) for a, b, w in zip(r.integers(0, 30, 90), r.integers(0, 40, 90), r.random(90) + 0.1)]
    e = edges(spark, rows, "g int, src int, dst int, weight double")
    both = {(x.g, x.node): (x.pagerank, x.normed) for x in measures.pagerank_by(e, ["g"], tol=1e-10).collect()}
    for g in (1, 2):
        one = measures.pagerank(e.where(f"g = {g}").drop("g"), tol=1e-10).collect()
        assert len(one) == sum(k[0] == g for k in both)
        for x in one:
            assert both[g, x.node] == pytest.approx((x.pagerank, x.normed), abs=1e-8)


def test_star_and_triangles(spark):
    """A star has no pair of neighbours to look at; a hub's triangles are found at their lower ends."""
    star = spark.range(1, 100_001).selectExpr("0L as src", "id as dst", "1.0D as weight")
    tri = edges(spark, [(1, 2, 1.0)], "src long, dst long, weight double")
    got = {x.node: x.clustering for x in measures.local_clustering(star.union(tri)).where("node <= 3").collect()}
    # node 1 knows 0 and 2, which know each other; of one-way links half of the possible triangles
    assert got[1] == got[2] == 0.5 and got[3] == 0.0 and got[0] == pytest.approx(2 / (2 * 100_000 * 99_999))


def test_clustering_brute_force(spark):
    r = np.random.default_rng(6)
    w = {(int(a), int(b)): float(x) for a, b, x in zip(r.integers(0, 12, 60), r.integers(0, 12, 60), r.random(60) + 0.05)}
    got = {x.node: x.clustering for x in measures.local_clustering(edges(spark, [(a, b, x) for (a, b), x in w.items()]), True).collect()}
    top = max(x for (a, b), x in w.items() if a != b)
    z = lambda a, b: sum((w[k] / top) ** (1 / 3) for k in ((a, b), (b, a)) if k in w)
    for n in range(12):
        d = sum(((n, m) in w) + ((m, n) in w) for m in range(12) if m != n)
        if not d:
            continue
        mutual = sum((n, m) in w and (m, n) in w for m in range(12) if m != n)
        t = sum(z(n, a) * z(a, b) * z(b, n) for a, b in itertools.permutations([m for m in range(12) if m != n], 2))
        whole = 2 * (d * (d - 1) - 2 * mutual)
        assert got[n] == pytest.approx(t / whole if whole else 0.0, abs=1e-9)
