"""The four-sentence network, with results derived by hand."""

import pytest

from semnet.operators import cluster, graph, measures, queries, stats
from semnet.plans.network import Network

IDS = {"manager": 1, "leader": 2, "boss": 3, "company": 4, "team": 5, "employee": 6}
ROWS = [
    (1, 1, "leader", "manager", 0.5), (1, 1, "leader", "boss", 0.5), (1, 2, "employee", "company", 0.5), (1, 2, "employee", "team", 0.5), (2, 1, "leader", "manager", 1.0),
    (2, 2, "company", "team", 1.0), (3, 1, "manager", "leader", 1.0), (3, 2, "company", "team", 1.0), (4, 1, "boss", "leader", 1.0), (4, 2, "company", "employee", 1.0),
]
NAMES = {v: k for k, v in IDS.items()}


@pytest.fixture(scope="module")
def net(spark):
    rows = [(1000, r, r, p, IDS[o], IDS[s], w, "NOUN", 0.0, 0.0) for r, p, o, s, w in ROWS]
    t = spark.createDataFrame(rows, "time int, run_index long, seq_id long, pos int, occ int, sub int, weight double, part_of_speech string, sentiment double, subjectivity double").cache()
    return Network(t, spark.createDataFrame([(v, k) for k, v in IDS.items()], "token_id int, token string"))


def pairs(df, a="src", b="dst", v="weight"):
    return {(NAMES[r[a]], NAMES[r[b]]): round(r[v], 6) for r in df.collect()}


def test_substitution(net):
    assert pairs(net.condition().edges) == {
        ("manager", "leader"): 1.5, ("boss", "leader"): 0.5, ("company", "employee"): 0.5, ("team", "employee"): 0.5,
        ("team", "company"): 2, ("employee", "company"): 1, ("leader", "manager"): 1, ("leader", "boss"): 1,
    }


def test_substitution_in_context(net):
    for mode in ("bidirectional", "substitution"):
        got = pairs(queries.substitution_in_context(net.ties, net.ids(["team"]), mode))
        assert got == {("manager", "leader"): 1.25, ("boss", "leader"): 0.25, ("leader", "manager"): 1}
    assert pairs(queries.substitution_in_context(net.ties, net.ids(["team"]), "occurring")) == {}


def test_dyad_context(net):
    want = {"bidirectional": {"company": 50, "team": 50, "employee": 20}, "occurring": {"company": 40, "employee": 20}, "substitution": {"team": 50, "company": 10}}
    for mode, w in want.items():
        got = queries.dyad_context(net.ties, replacing=[1], mode=mode)
        assert {NAMES[r.e]: round(r.weight, 6) for r in got.collect()} == w
    assert net.dyad_context(replacing="manager").count() == 3
    with pytest.raises(ValueError):
        queries.dyads(net.ties)


def test_node_context(net):
    assert pairs(queries.node_context(net.ties, [1]), "ego", "alter") == {("manager", "team"): 0.833333, ("manager", "company"): 0.166667}
    assert pairs(queries.node_context(net.ties, [5]), "ego", "alter") == {("team", "manager"): 0.5, ("team", "leader"): 0.4, ("team", "boss"): 0.1}
    assert pairs(queries.node_context(net.ties, [2], occurrence=True), "ego", "alter") == {("leader", "company"): 0.5, ("leader", "employee"): 0.5}


def test_dyad_networks(net):
    assert pairs(queries.substitution_in_dyad(net.ties, replacing=[1])) == {("team", "company"): 1, ("company", "employee"): 0.25, ("team", "employee"): 0.25}
    got = {k: v for k, v in pairs(queries.context_in_dyad(net.ties, replacing=[1])).items() if k[1] == "boss"}
    assert got == {("company", "boss"): 0.125, ("employee", "boss"): 0.5, ("team", "boss"): 0.125}


def test_occurrences(net):
    assert {NAMES[r.token_id]: r.freq for r in net.occurrences().collect()} == {"leader": 2, "company": 3, "employee": 1, "manager": 1, "boss": 1}
    assert tuple(queries.sequence_count(net.ties).first()) == (4, 8.0)


def test_transforms(net):
    c = net.condition()
    assert pairs(c.symmetric().edges) == {("manager", "leader"): 1.25, ("leader", "boss"): 0.75, ("company", "team"): 1.0, ("company", "employee"): 0.75, ("team", "employee"): 0.25}
    assert pairs(c.compositional().edges)[("team", "company")] == 0.666667
    assert pairs(c.reverse().reverse().edges) == pairs(c.edges)
    with pytest.raises(AttributeError):
        graph.symmetrise(c.edges, "other")
    assert pairs(graph.sparsify(c.edges, 50))[("team", "company")] == 2


def test_ego(net):
    e = net.condition().edges
    balls = [{tuple(r) for r in graph.balls(e, net.ties.sparkSession.createDataFrame([(1,)], "id int"), k).collect()} for k in range(3)]
    assert balls[0] == {(1, 1)} and balls[0] <= balls[1] <= balls[2]
    assert set(pairs(net.condition(tokens="manager", depth=1).edges)) == {("manager", "leader"), ("leader", "manager")}
    assert set(pairs(net.condition(tokens=["manager"], depth=0).edges)) == {("manager", "leader")}


def test_lookup(net):
    with pytest.raises(LookupError):
        net.ids("nobody")
    assert len(net) == 6 and net["team"].count() == 2


def test_louvain_closed_forms():
    import pandas as pd

    n, size = 5, 4
    rows = [(c * size + i, c * size + j, 1.0) for c in range(n) for i in range(size) for j in range(i)]
    adj = cluster.adjacency(pd.DataFrame(rows, columns=["src", "dst", "weight"]))
    part = cluster.best_partition(adj)
    assert len(set(part.values())) == n
    assert abs(cluster.modularity_of(adj, part) - (1 - 1 / n)) < 1e-9
    ring = rows + [(c * size, ((c + 1) % n) * size, 1.0) for c in range(n)]
    adj = cluster.adjacency(pd.DataFrame(ring, columns=["src", "dst", "weight"]))
    m = len(ring)
    assert abs(cluster.modularity_of(adj, {k: k // size for k in adj}) - (1 - 1 / n - n / m)) < 1e-9
    assert len(set(cluster.consensus(adj).values())) == n


def test_induced_graph(spark):
    n = 5
    e = spark.createDataFrame([(i, j, 1.0) for i in range(2 * n) for j in range(i)], "src long, dst long, weight double")
    part = spark.range(2 * n).selectExpr("id as node", "cast(id >= 5 as int) as cluster")
    got = {(r.src, r.dst): r.weight for r in cluster.induced_graph(e, part).collect()}
    assert got == {(0, 0): n * (n - 1) / 2, (1, 1): n * (n - 1) / 2, (0, 1): n * n}
    assert -1 <= cluster.modularity(e, part).first()[0] <= 1


def test_measures(net):
    e = net.condition().edges
    assert abs(sum(r.pagerank for r in measures.pagerank(e).collect()) - 1) < 1e-6
    assert abs(sum(r.pagerank for r in measures.pagerank_joins(e).collect()) - 1) < 1e-6
    assert {r.measure for r in net.condition().centralities(("PageRank", "frequency", "constraint")).collect()} == {"PageRank", "frequency", "constraint"}
    assert net.condition().cluster().where("level = 1").count() == 6


def test_hull():
    assert stats.convex_hull([(0, 0), (1, 1), (2, 0), (2, 2), (0, 2), (1, 1)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]
