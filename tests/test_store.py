"""The tie store: merges, deletions, crashes between all steps, writers at the same time, the occurrence cache."""

import os
import shutil
from threading import Barrier, Thread

import pytest
from pyspark.sql import functions as F

from semnet.operators import queries
from semnet.sources.store import Conflict, OccurrenceCache, Store

KIND = "time int, run_index long, pos int, occ int, sub int, weight double"


def rows(spark, *keys, weight=0.5):
    return spark.createDataFrame([(t, r, 1, 2, 3, weight) for t, r in keys], KIND)


def held(store, version=None):
    return sorted((r.time, r.run_index, r.weight) for r in store.read(version).collect())


def test_merge(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    with pytest.raises(LookupError):
        s.read()
    assert s.append(rows(spark, (1, 1), (1, 2), (2, 1))) == 1
    assert s.merge(rows(spark, (1, 2), (1, 3), (3, 1), weight=0.75)) == 2
    assert held(s) == [(1, 1, 0.5), (1, 2, 0.5), (1, 3, 0.75), (2, 1, 0.5), (3, 1, 0.75)]
    assert s.merge(rows(spark, (1, 2), (2, 2), (2, 2), weight=0.25).union(rows(spark, (2, 2), weight=0.1)), "replace") == 3
    now = [(1, 1, 0.5), (1, 2, 0.25), (1, 3, 0.75), (2, 1, 0.5), (2, 2, 0.25), (3, 1, 0.75)]
    assert held(s) == now and held(s, 1) == [(1, 1, 0.5), (1, 2, 0.5), (2, 1, 0.5)]
    assert s.delete((F.col("run_index") == 1) & (F.col("time") < 3)) == 2 and s.delete(F.col("run_index") == 99) == 0
    assert s.drop([3]) == 5 and s.drop([77]) == 5
    assert held(s) == [x for x in now if x[1] != 1]
    # new columns are null in older rows; a column keeps its type
    s.merge(rows(spark, (4, 1)).withColumn("p1", F.lit("x")))
    assert {(r.time, r.p1) for r in s.read().collect()} == {(1, None), (2, None), (4, "x")}
    with pytest.raises(ValueError):
        s.merge(rows(spark, (4, 2)).withColumn("weight", F.lit("x")))
    with pytest.raises(ValueError):
        s.append(rows(spark, (4, 2)).drop("sub"))
    before = held(s)
    s.append(rows(spark, (1, 50)))
    s.compact()
    parts = s.manifest()["parts"]
    assert len(parts) == len({p["name"] for p in parts}) and held(s) == sorted([*before, (1, 50, 0.5)])
    assert s.vacuum(older_than=10**6) == [] and len(s.vacuum(older_than=0)) > 3
    assert held(s) == sorted([*before, (1, 50, 0.5)]) and len(s.versions()) == 1
    # only the folders of a filter on time are read
    files = s.read().where("time = 1").inputFiles()
    assert "PartitionFilters: [isnotnull(time" in s.read().where("time = 1")._jdf.queryExecution().toString() and files
    assert s.drop() == s.versions()[-1] and s.read().count() == 0


def test_null_time_and_empty(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.merge(rows(spark, (None, 1), (1, 1)))
    s.merge(rows(spark, (None, 1), (None, 2)))
    s.merge(rows(spark))
    assert sorted((r.time is None, r.run_index) for r in s.read().collect()) == [(False, 1), (True, 1), (True, 2)]
    assert s.delete(F.col("time").isNull() & (F.col("run_index") == 2)) == 1 and s.read().count() == 2


class Crash(Exception):
    pass


OPERATIONS = {
    "append": lambda s, spark: s.append(rows(spark, (1, 9), (5, 9)), step="x"),
    "merge": lambda s, spark: s.merge(rows(spark, (1, 1), (1, 9), (5, 9), weight=0.7)),
    "merge replace": lambda s, spark: s.merge(rows(spark, (1, 1), (1, 9), (5, 9), weight=0.7), "replace"),
    "delete": lambda s, spark: s.delete(F.col("run_index") == 1),
    "replace": lambda s, spark: s.replace(F.col("run_index") == 1, rows(spark, (1, 9), (5, 9)), step="y"),
    "drop": lambda s, spark: s.drop([1]),
    "compact": lambda s, spark: s.compact(),
}


@pytest.mark.parametrize("name", OPERATIONS)
def test_crashes(spark, tmp_path, monkeypatch, name):
    """Wherever a job dies, a reader sees the table before it or after it, and doing the job again makes it whole."""

    first = Store(spark, str(tmp_path / "first"))
    first.append(rows(spark, (1, 1), (1, 2), (2, 1)))
    first.append(rows(spark, (1, 3)))

    def fresh(at):
        shutil.copytree(first.path, tmp_path / at)  # names in a manifest are relative
        return Store(spark, str(tmp_path / at))

    whole = fresh("whole")
    before = held(whole)
    OPERATIONS[name](whole, spark)
    after = held(whole)

    def dies(at, target, attr, early, nth):
        s, calls, real = fresh(at), [], getattr(target, attr)

        def stub(*a, **b):
            calls.append(1)
            if len(calls) == nth and early:
                raise Crash
            out = real(*a, **b)
            if len(calls) == nth:
                raise Crash
            return out

        with monkeypatch.context() as m:
            m.setattr(target, attr, stub)
            try:
                OPERATIONS[name](s, spark)
                crashed = False
            except Crash:
                crashed = True
        return s, crashed

    steps = [(Store, "_batch", early, nth) for nth in (1, 2) for early in (True, False)] + [(Store, "_publish", True, 1), (os, "link", True, 1), (os, "link", False, 1), (Store, "_publish", False, 1)]
    for k, (target, attr, early, nth) in enumerate(steps):
        s, crashed = dies(f"c{k}", target, attr, early, nth)
        seen = held(s)
        assert seen in (before, after)
        if crashed and (attr == "_batch" or early):
            assert seen == before  # not published
        OPERATIONS[name](s, spark)
        assert held(s) == after
    s.vacuum(older_than=0)
    assert held(s) == after


def test_writers_at_the_same_time(spark, tmp_path):
    path, n, start, failed = str(tmp_path / "s"), 4, Barrier(4), []
    Store(spark, path).append(rows(spark, (1, 0)))

    def write(k):
        try:
            start.wait()
            Store(spark, path).merge(rows(spark, (1, 0), (1, 100), (1, k + 1), weight=0.9))
        except Exception as e:
            failed.append(e)

    threads = [Thread(target=write, args=(k,)) for k in range(n)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    s = Store(spark, path)
    # no writer's ties are lost, and none is there twice
    assert not failed and held(s) == sorted([(1, 0, 0.5), (1, 100, 0.9), *((1, k + 1, 0.9) for k in range(n))]) and s.versions()[-1] == n + 1


def test_conflict_is_an_error_in_the_end(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path / "s"), tries=2)
    monkeypatch.setattr(Store, "_publish", lambda *_: False)
    with pytest.raises(Conflict):
        s.append(rows(spark, (1, 1)))


def test_streams_and_steps(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    for number in (0, 0, 1, 0):
        s.append(rows(spark, (1, number)), stream=("q", number))
    assert [x[1] for x in held(s)] == [0, 1]
    for _ in range(2):
        s.append(rows(spark, (1, 7)), step="seven")
    assert [x[1] for x in held(s)] == [0, 1, 7] and s.done("seven") and not s.done("eight")


def test_occurrence_cache(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    ties = lambda lo, hi: spark.range(lo, hi).selectExpr("cast(1990 + id % 3 as int) as time", "id as run_index", "1 as pos", "cast(id % 7 as int) as occ", "cast(id % 5 as int) as sub", "0.25D * (id % 4) as weight")
    s.append(ties(0, 200))
    cache = OccurrenceCache(s)

    def same(**options):
        got, want = ({(r.token_id, r.freq) for r in f.collect()} for f in (cache.occurrences(**options), queries.occurrences(s.read(), **options)))
        return got == want

    assert same() and cache.read_parts == 3
    assert same() and same(times=1991) and same(times={"start": 1990, "end": 1991}, ids=[1, 2]) and cache.read_parts == 3
    s.append(ties(200, 250).where("time = 1990"))  # one new folder
    assert same() and cache.read_parts == 4
    s.delete(F.col("run_index").isin(0, 3))  # both folders of 1990 are written anew, as one
    assert same() and cache.read_parts == 5
    s.drop([1992])
    assert same() and cache.read_parts == 5
    assert OccurrenceCache(s).refresh() == []


def test_sentences_to_a_store(spark, tmp_path):
    """Sentences of two batches become ties with all their columns, words keep their ids, and the network opens on the store."""
    from semnet.operators import ties
    from semnet.plans.network import Network

    kind = "run_index long, time int, sentence string, p1 string"
    first = spark.createDataFrame([(1, 1999, "the old boss leads the firm", "a"), (2, 1999, "the old chief leads the firm", "a")], kind)
    second = spark.createDataFrame([(3, 2000, "the new boss nearly failed the firm", None), (4, 2000, "the new chief nearly failed the firm", None), (5, 2000, None, "b")], kind)
    felt = spark.createDataFrame([("old", -0.5, 0.25), ("firm", 0.1, 0.75)], "token string, polarity double, subjective double")
    s = Store(spark, str(tmp_path / "s"))
    t, words = ties.tie_rows(first, felt)
    assert t.schema.simpleString().replace("struct<", "").rstrip(">").split(",") == [f"{c.split()[0]}:{ {'long': 'bigint'}.get(c.split()[1], c.split()[1])}" for c in ties.TIES.split(", ")]
    s.merge(t)
    words = words.cache()
    t2, words2 = ties.tie_rows(second, felt, words)
    s.merge(t2)
    ids = {r.token: r.token_id for r in words2.collect()}
    assert all(ids[r.token] == r.token_id for r in words.collect()) and len(set(ids.values())) == len(ids)
    got = s.read().collect()
    boss = {(r.time, r.sub, r.part_of_speech, round(r.sentiment, 6), round(r.subjectivity, 6), r.p1) for r in got if r.occ == ids["boss"]}
    assert {x[1] for x in boss} == {ids["boss"], ids["chief"]} and {(x[0], *x[2:]) for x in boss} == {(1999, "NOUN", -0.2, 0.5, "a"), (2000, "NOUN", 0.1, 0.75, None)}
    assert {r.part_of_speech for r in got if r.occ == ids["nearly"]} == {"ADV"} and {r.part_of_speech for r in got if r.occ == ids["failed"]} == {"VERB"}
    net = Network(s.read(), words2)
    assert {r.dst for r in net.condition(tokens="chief", depth=0).edges.collect()} >= {ids["boss"]}
