"""Betweenness and SimRank by joins, against matrices and searches on one machine."""

import itertools

import dense
import numpy as np
import pytest

from semnet.operators import flows

EDGES = "src int, dst int, weight double"


def random_edges(spark, n, share, seed, whole=False):
    r = np.random.default_rng(seed)
    rows = [(i, (i + 1) % n, float(r.integers(1, 4)) if whole else float(r.random()) + 0.1) for i in range(n)]
    rows += [(i, j, float(r.integers(1, 4)) if whole else float(r.random()) + 0.1) for i in range(n) for j in range(n) if r.random() < share]
    return spark.createDataFrame(rows, EDGES)


def values(df):
    return {r.node: r.value for r in df.collect()}


@pytest.mark.parametrize("whole", [True, False])
def test_pivot_betweenness(spark, whole):
    """All pivots; whole weights give many paths of the same length."""
    e = random_edges(spark, 14, 0.1, 4, whole)
    want = values(dense.rev_flow_betweenness(e, -1))
    assert values(flows.rev_flow_betweenness(e, -1)) == pytest.approx(want, abs=1e-9)
    assert max(want.values()) > 0


def test_pivots(spark):
    e = random_edges(spark, 8, 0.2, 5)
    one = values(flows.rev_flow_betweenness(e, 3))
    assert one == values(flows.rev_flow_betweenness(e.repartition(7), 3))
    # the mean of the pivots' own values is that of all pivots
    each = [values(flows.rev_flow_betweenness(e, spark.createDataFrame([(k, "x")], "id int, node string"))) for k in (0, 4)]
    got = values(flows.rev_flow_betweenness(e, spark.createDataFrame([(0,), (4,), (4,), (99,)], "id int")))
    assert got == pytest.approx({k: sum(x[k] for x in each) / 2 for k in got}, abs=1e-12)
    empty = spark.createDataFrame([], EDGES)
    assert values(flows.rev_flow_betweenness(empty)) == values(flows.flow_betweenness(empty)) == {} and not flows.simrank(empty).collect()
    with pytest.raises(ValueError):
        flows.rev_flow_betweenness(spark.createDataFrame([(1, 2, -5.0)], EDGES))


def test_paths_through_a_square(spark):
    """Two ways round a square: each corner between carries half a path; an island is not reached."""
    sq = [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (3, 0, 1.0), (8, 9, 1.0)]
    links = spark.createDataFrame(sq + [(b, a, w) for a, b, w in sq], EDGES)
    got = {r.node: (r.paths, r.value) for r in flows.pivot_dependencies(links, spark.createDataFrame([(0,)], "id int")).collect()}
    assert got == {0: (1.0, 0.0), 1: (1.0, 0.5), 2: (2.0, 0.0), 3: (1.0, 0.5)}


def test_current_flow(spark):
    e = random_edges(spark, 9, 0.15, 6)
    want = values(dense.flow_betweenness(e))
    assert values(flows.flow_betweenness(e, pairs=-1, tol=1e-9)) == pytest.approx(want, abs=1e-6)
    got = values(flows.flow_betweenness(e, seed=3))
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 0.25
    apart = e.union(spark.createDataFrame([(100, 101, 1.0), (1, 100, 0.0)], EDGES))
    assert set(values(flows.flow_betweenness(apart)).values()) == {0.0}


def test_drawn_pairs(spark):
    nodes = spark.range(10).withColumnRenamed("id", "node")
    rows = flows._drawn_pairs(nodes, 900, 1).collect()
    assert len({r.pair for r in rows}) == 900 and all(r.s != r.t for r in rows)
    seen = {p: 0 for p in itertools.combinations(range(10), 2)}
    for r in rows:
        seen[min(r.s, r.t), max(r.s, r.t)] += 1
    assert min(seen.values()) >= 5 and max(seen.values()) <= 45  # 20 of each are expected


def test_simrank(spark):
    r = np.random.default_rng(7)
    e = spark.createDataFrame([(int(a), int(b), 1.0) for a, b in zip(r.integers(0, 15, 40), r.integers(0, 15, 40))] + [(99, 3, 0.0)], EDGES)
    want = {(x.src, x.dst): x.weight for x in dense.simrank(e).collect()}
    got = {(x.src, x.dst): x.weight for x in flows.simrank(e).collect()}
    assert got == pytest.approx(want, abs=1e-9)
    high = flows.simrank(e, least=0.2)
    assert {(x.src, x.dst) for x in high.collect()} == {k for k, v in want.items() if v > 0.2}
