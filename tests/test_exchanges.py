"""What is exchanged: ties of order lines, sequences around a dyad, batches of a store."""

import datetime

from pyspark.sql import functions as F

from semnet.operators import profiles, queries, ties
from semnet.plans.network import Network
from semnet.sources.store import Store

LINES = "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
KIND = "time int, run_index long, pos int, occ int, sub int, weight double, part_of_speech string, sentiment double, subjectivity double"


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def lines(spark, tmp_path):
    rows = [(o, 7 * o + p + 300 * k, p, 1.0 + k, 0.04, 0.02 * k, "ANR"[(o + p) % 3], "F", datetime.datetime(1995 + o % 3, 1 + k, 1)) for o in range(1, 13) for p in (1, 2, 3) for k in range(2)]
    spark.createDataFrame(rows, LINES).write.parquet(str(tmp_path / "lines"))
    return spark.read.parquet(str(tmp_path / "lines"))


def test_lines_are_exchanged_and_sorted_once(spark, tmp_path):
    t = ties.from_lineitem(lines(spark, tmp_path))
    logical, physical = plan(t.groupBy("time", "run_index").agg(F.sum("weight")))
    assert physical.count("Exchange hashpartitioning") == 1 and physical.count("Sort [") == 1
    # a filter on sequences lies below the windows
    _, physical = plan(t.where("run_index % 3 <> 0"))
    assert physical.rindex("Filter") > physical.rindex("Window") and physical.index("Filter") > physical.rindex("Exchange")
    got = {(r.run_index, r.pos, r.sub): r for r in t.collect()}
    assert len(got) == 72
    r = got[4, 2, (7 * 4 + 2 + 300) % 200]
    assert (r.time, r.seq_id, r.occ, r.sentiment, r.subjectivity, r.p1, r.part_of_speech) == (1996, 4, 30, 0.04, 0.01, "F", "A") and abs(r.weight - 2 / 3) < 1e-12


def unclean(spark):
    """Ties with a sequence at two times, one without a time and one without a dyad."""
    rows = [(2000 + r % 2, r, p, o, (o + s) % 6, 1.0 / (1 + p + s), "NV"[p % 2], 0.25 * s, 0.5) for r in range(9) for p in range(3) for o in [(r + p) % 6] for s in range(2)]
    rows += [(2001, 0, 5, 1, 4, 0.5, "N", 0.1, 0.1), (2000, 20, 1, 3, 3, 0.5, "N", 0.1, 0.1), (2000, 20, 2, 4, 4, 0.5, "N", 0.1, 0.1), (None, 21, 1, 1, 2, 0.5, "N", 0.1, 0.1), (None, 21, 2, 3, 3, 0.5, "V", 0.1, 0.1), (2000, 22, None, 1, 2, 0.5, "N", 0.1, 0.1)]
    return spark.createDataFrame(rows, KIND)


def same(a, b):
    a, b = (sorted((tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in df.collect()), key=repr) for df in (a, b))
    return a == b and len(a) > 0


def test_dyads_read_their_own_sequences(spark, tmp_path):
    unclean(spark).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    near = queries.around(t, None, [2, 3])
    assert 0 < near.count() < t.count() and near.where("run_index = 20").count() == 0
    for asked in ({"replacing": [2, 3]}, {"occurring": 1, "replacing": [2]}, {"occurring": [1, 2], "times": {"start": 2000, "end": 2000}}, {"replacing": [2, 3], "times": [2001], "cutoff": 0.2}):
        made = queries.dyad_context(t, **asked, by_pos=True)
        assert same(made, queries.dyad_context(t, **asked, by_pos=True, near=True))
        # the table itself is read for the kept sequences only
        assert not any(str(tmp_path) in f for f in made.inputFiles())
    assert same(queries.context_in_dyad(t, replacing=[2, 3]), queries.context_in_dyad(t, replacing=[2, 3], near=True))
    assert same(queries.substitution_in_dyad(t, replacing=[2, 3], with_dyad=True), queries.substitution_in_dyad(t, replacing=[2, 3], with_dyad=True, near=True))
    assert same(queries.position_context(t, replacing=[2, 3]), queries.position_context(t, replacing=[2, 3], near=True))


def test_clusters_by_part_of_speech_go_through_the_ties_once(spark, tmp_path):
    table = ties.from_lineitem(lines(spark, tmp_path))
    read = spark.sparkContext.accumulator(0)

    def tallied(w):
        read.add(1)
        return w

    t = table.withColumn("weight", F.udf(tallied, "double").asNondeterministic()("weight"))
    words = spark.range(200).select(F.col("id").cast("int").alias("token_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("token"))
    made = profiles.context_clusters(Network(t, words), substitute=[108, 116, 124], levels=1, per_pos=True, k=20)
    # three parts of speech, each with a network of its own, and every tie was read once
    assert {r.part_of_speech for r in made.collect()} == {"A", "N", "R"} and read.value == table.count() == 72


def test_lengths_without_a_join(spark):
    t = unclean(spark)
    lengths = queries.sequence_lengths(t)
    joined = t.join(lengths, (t["run_index"] == F.col("s_run_index")) & (t["time"] == F.col("s_time"))).select(*t.columns, "others")
    assert same(queries.with_lengths(t).select(*t.columns, "others"), joined)
    once = t.repartition(3, "run_index")
    assert plan(queries.with_lengths(once))[1].count("Exchange") == 1
    # one pass over the table besides the context: no join of it with itself
    assert "Join" not in plan(queries.with_lengths(t))[1]


def test_store_writes_what_came_once(spark, tmp_path, monkeypatch):
    def made(*keys, weight=0.5):
        return spark.createDataFrame([(t, r, 1, 2, 3, weight) for t, r in keys], "time int, run_index long, pos int, occ int, sub int, weight double")

    s = Store(spark, str(tmp_path / "s"))
    s.append(made((1, 1), (1, 2), (1, 3), (2, 1)))
    s.merge(made((1, 2), (1, 9), (3, 1), weight=0.75), "replace")
    # 4 rows, 3 that came, and of the partition that both have the 2 that stay
    assert spark.read.option("basePath", str(tmp_path / "s")).parquet(*(str(p) for p in (tmp_path / "s").glob("batch=*"))).count() == 4 + 3 + 2
    assert sorted((r.time, r.run_index, r.weight) for r in s.read().collect()) == [(1, 1, 0.5), (1, 2, 0.75), (1, 3, 0.5), (1, 9, 0.75), (2, 1, 0.5), (3, 1, 0.75)]

    def dealt(*_):
        raise AssertionError("a deletion exchanges rows")

    with monkeypatch.context() as m:
        m.setattr(type(s.read()), "hint", dealt)
        assert s.delete(F.col("run_index") == 1) == 3
    assert sorted((r.time, r.run_index) for r in s.read().collect()) == [(1, 2), (1, 3), (1, 9)]
    parts = len(s.manifest()["parts"])
    s.compact()
    assert len(s.manifest()["parts"]) <= parts and s.read().count() == 3


def test_a_task_has_so_many_lines(spark, tmp_path, monkeypatch):
    table = lines(spark, tmp_path)
    few = ties.from_lineitem(table)
    monkeypatch.setattr(ties, "LINES_EACH", 8)
    many = ties.from_lineitem(table)
    # 72 lines, 8 a task, where the session would have 4 tasks; still one exchange
    physical = plan(many)[1]
    assert physical.count("Exchange hashpartitioning") == 1 and ", 9), REPARTITION_BY_NUM" in physical
    assert same(many, few)


def test_a_task_has_so_many_rows_around_a_dyad(spark, tmp_path, monkeypatch):
    unclean(spark).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    asked = ((queries.dyad_context, {"by_pos": True}), (queries.dyad_context, {"pos": "N"}), (queries.substitution_in_dyad, {"with_dyad": True, "normalise": True}), (queries.context_in_dyad, {"normalise": True}), (queries.position_context, {}))
    few = [f(t, replacing=[2, 3], **a).localCheckpoint() for f, a in asked]
    monkeypatch.setattr(queries, "NEAR_EACH", 3)
    n = -(-queries.around(t, None, [2, 3]).n_rows // 3)
    for (f, a), b in zip(asked, few):
        made = f(t, replacing=[2, 3], **a)
        assert n > 4 and f"hashpartitioning(run_index#" in plan(made)[1] and f", {n}), REPARTITION_BY_NUM" in plan(made)[1]
        assert same(made, b)


def test_places_of_several_parts_of_speech(spark):
    kind = "time int, run_index long, pos int, occ int, sub int, weight double, part_of_speech string, sentiment double, subjectivity double"
    rows = [(1, 1, 1, 1, 2, 0.5, "N", 0.0, 0.0), (1, 1, 2, 3, 4, 0.5, "V", 0.0, 0.0), (1, 1, 2, 5, 5, 0.25, "A", 0.0, 0.0), (1, 1, 2, 6, 6, 0.25, None, 0.0, 0.0), (1, 1, 3, 7, 7, 1.0, None, 0.0, 0.0)]
    t = spark.createDataFrame(rows, kind)
    made = queries.dyad_context(t, replacing=2, by_pos=True)
    got = {(r.part_of_speech, r.e) for r in made.collect()}
    assert got == {(p, e) for p in ("N", "V", "A", None) for e in (3, 4, 5, 6) if p != "N"} | {(None, 7)}
    # parts of speech and lengths come from windows: the ties are joined with themselves once
    assert plan(made)[0].count("Join") == 1
