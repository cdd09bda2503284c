"""Searches, blocks, exports and scans that no query covers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from semnet.functions import text
from semnet.operators import graph, measures, queries, stats
from semnet.plans.network import Network
from semnet.sources import corpus

TIES = "time int, run_index long, seq_id long, pos int, occ int, sub int, weight double, part_of_speech string, sentiment double, subjectivity double"


@pytest.fixture(scope="module")
def net(spark):
    r = np.random.default_rng(8)
    rows = [(2000 + s % 3, s, s, p, int(r.integers(0, 12)), int(r.integers(0, 12)), float(r.random()), "N", 0.0, 0.0) for s in range(40) for p in range(4) for _ in range(2)]
    t = spark.createDataFrame(rows, TIES).cache()
    return Network(t, spark.createDataFrame([(i, f"w{i}") for i in range(14)], "token_id int, token string"))


def rows_of(df):
    return sorted((r.src, r.dst, round(r.weight, 9)) for r in df.collect())


@pytest.mark.parametrize("depth", [0, 1, 2])
@pytest.mark.parametrize("occurrence", [False, True])
def test_context_search(net, depth, occurrence):
    """A search from the inside out finds what is cut from the whole network."""
    sparse = Network(net.ties.where("run_index < 7"), net.words)
    got = sparse.context_condition(tokens=["w1", 2], depth=depth, occurrence=occurrence)
    whole = sparse.context_condition(occurrence=occurrence).edges
    seeds = net.words.where("token_id in (1, 2)").select("token_id")
    want = graph.ego_network(whole, seeds, depth) if depth else whole.where("src in (1, 2)")
    assert rows_of(got.edges) == rows_of(want) and got.meta["kind"] == "context"
    top = sparse.context_condition(tokens=[1], depth=1, max_degree=2, occurrence=occurrence).edges
    assert all(r["count"] <= 2 for r in top.groupBy("src").count().collect())


def test_dyad_network(net):
    got = net.condition_given_dyad(dyad_substitute=[1, 2], focal_tokens=[3, 4], depth=0)
    want = queries.substitution_in_dyad(net.ties, replacing=[1, 2]).where("src in (3, 4)")
    assert rows_of(got.edges) == rows_of(want)
    related = net.condition_given_dyad(dyad_substitute=[1, 2], focal_tokens=[3], depth=0, contextual_relations=True)
    assert rows_of(related.edges) == rows_of(queries.context_in_dyad(net.ties, replacing=[1, 2]).where("src = 3"))
    with pytest.raises(NotImplementedError):
        net.condition_given_dyad(dyad_substitute=[1], focal_tokens=None)
    with pytest.raises(NotImplementedError):
        net.condition_given_dyad(dyad_substitute=[1], focal_tokens=[3], compositional=True)


def test_back_out_rows(spark):
    r = np.random.default_rng(3)
    a = r.random((30, 30)) * (r.random((30, 30)) < 0.2)
    e = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(30) for j in range(30) if a[i, j]], "src int, dst int, weight double")
    top = max(abs(np.linalg.eigvals(a)))
    assert graph.spectral_radius(e) == pytest.approx(top, rel=1e-5)
    full = np.linalg.inv(np.eye(30) - a / (1.5 * top))
    got = np.zeros((30, 30))
    for x in graph.back_out_rows(e, spark.createDataFrame([(4,), (7,), (99,)], "id int"), 1 / (1.5 * top)).collect():
        got[x.src, x.dst] = x.weight
    for k in (4, 7):
        full[k, k] = 0
        assert np.abs(got[k] - full[k]).max() < 1e-6
    assert not np.delete(got, (4, 7), 0).any()
    with pytest.raises(ValueError):
        graph.back_out_rows(e, spark.createDataFrame([(4,)], "id int"), 100 / top)


def test_blocks_and_cluster_proximities(spark):
    e = spark.createDataFrame([(1, 3, 1.0), (2, 3, 3.0), (1, 4, 2.0), (3, 1, -1.0), (1, 2, 9.0)], "src int, dst int, weight double")
    part = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "node int, cluster int")
    assert rows_of(measures.cluster_blocks(e, part, 2.0)) == [(0, 1, 3.0)]  # (1 + 3 + 2) / 4 cells, doubled
    assert rows_of(measures.cluster_blocks(e, part, how="max")) == [(0, 1, 3.0)]
    near = spark.createDataFrame([(3, 1.0), (4, 3.0), (9, 5.0)], "alter_id int, weight double")
    members = spark.createDataFrame([("a", 3), ("a", 4), ("b", 1)], "name string, node int")
    assert [tuple(r) for r in measures.cluster_proximities(members, near).collect()] == [("a", 2.0, 2.5, 1.0, 4.0)]


def test_union_of_graphs(spark):
    a, b = (spark.createDataFrame(x, "src int, dst int, weight double") for x in ([(1, 2, 1.0), (2, 3, 1.0)], [(1, 2, 5.0), (4, 1, 2.0)]))
    assert rows_of(graph.union_edges(a, b)) == [(1, 2, 5.0), (2, 3, 1.0), (4, 1, 2.0)]


def test_exports_and_scans(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 'a "b"'), (2, "c,d")], "id int, token string")
    e = spark.createDataFrame([(1, 2, 0.5)], "src int, dst int, weight double")
    corpus.write_edge_list(nodes, e, str(tmp_path / "list"))
    back = spark.read.option("escape", "\\").csv(str(tmp_path / "list"), header=True).collect()
    assert [(r.src_token, r.dst_token, float(r.weight)) for r in back] == [('a "b"', "c,d", 0.5)]
    # two nodes with one and two links
    (tmp_path / "g.bin").write_bytes(np.array([2], "<u4").tobytes() + np.array([1, 3], "<u8").tobytes() + np.array([1, 0, 1], "<u4").tobytes())
    assert sorted(tuple(r) for r in corpus.read_binary_graph(spark, str(tmp_path / "g.bin")).collect()) == [(0, 1), (1, 0), (1, 1)]
    rows = spark.createDataFrame([("f", str(1990 + k % 2), ["p"], f"s {k}", k, k, k) for k in range(5)], corpus.SENTENCES)
    corpus.write_sentences(rows, str(tmp_path / "s"), rows_per_file=2)
    assert {(str(r.year), r.len_year, r.json_files) for r in corpus.corpus_metadata(rows, 2).collect()} == {("1990", 3, 2), ("1991", 2, 1)}
    assert sorted(r["index"] for r in corpus.read_sentences(spark, str(tmp_path / "s")).collect()) == list(range(5))
    t = spark.createDataFrame([(1, 2), (2, 5)], "occ int, sub int")
    words = spark.createDataFrame([(i, str(i)) for i in range(6)], "token_id int, token string")
    assert sorted(r.token_id for r in corpus.prune_words(words, t).collect()) == [1, 2, 5]
    one = spark.createDataFrame([("it's \"x\\y\"",)], "t string").select(text.escape_quotes(F.col("t")).alias("t")).first().t
    assert one == "it#e1#s #e2#x#e3#y#e2#"
    parts = spark.createDataFrame([(1, 10), (2, 20)], "time int, v int")
    parts.write.partitionBy("time").parquet(str(tmp_path / "p"))
    got = corpus.read_partition_predicate(spark, str(tmp_path / "p"), "time = 2 and v > 5")
    assert [r.v for r in got.collect()] == [20] and "PartitionFilters: [isnotnull(time" in got._jdf.queryExecution().toString()
