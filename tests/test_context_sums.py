"""Ties by contexts that are dealt once: the sums of the ties spelt out, whatever the size of a task."""

import random

import pytest
from pyspark.sql import functions as F

from semnet import catalog
from semnet.functions import text
from semnet.operators import ties


@pytest.fixture(params=[None, 12])
def each(request, monkeypatch):
    """Tasks as they are, and so small that most words are frequent and go in parts."""
    if request.param:
        monkeypatch.setattr(ties, "WORDS_EACH", request.param)
        monkeypatch.setattr(ties, "TIES_EACH", request.param)


def _docs(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["a", "b", "running", "d", "badly", "ff", "g" * i]) for _ in range(60))) for i in range(1, 6)] + [(90, ""), (91, None), (92, "lone"), (93, "two words"), (94, "q w e"), (95, "q w e")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("s"), (F.col("doc_id") % 2).cast("string"))))


def _tokens(spark):
    return ties.neighbours(_docs(spark).select(F.col("doc_id").alias("run_index"), text.tokens(F.col("text")).alias("t")), "t")


def _key(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


def _spread(spark, tmp_path, name):
    _docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    return catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def _summed(p, prob="prob"):
    return p.groupBy(F.col("cand").alias("sub"), "occ").agg(F.count("*").alias("n"), F.sum(prob).alias("weight"))


def test_contexts_are_the_counts(spark, each):
    tokens = _tokens(spark)
    t = ties._between(tokens)
    c = ties.contexts(tokens)
    triples = t.groupBy("l", "r", "token").agg(F.count("*").alias("n"))
    many = triples.groupBy("l", "r").agg(F.count("*").alias("k"))
    of = triples.join(many, ["l", "r"]).withColumn("alone", F.when(F.col("k") == 1, F.col("n")).otherwise(0))
    want = of.where("k > 1").select("l", "r", "token", "n", F.col("n").alias("own")).union(of.groupBy("l", "token").agg(F.sum("n").alias("n"), F.sum("alone").alias("own")).select("l", F.lit(None).cast("string"), "token", "n", "own"))
    assert _key(c.rows.select("l", "r", F.inline("words"))) == _key(want) != []
    assert c.words == t.count() and c.rows.groupBy("l", "r").count().where("count > 1").count() == 0


def test_a_cut_of_words_is_the_cumulative_cutoff(spark, each):
    c = ties.contexts(_tokens(spark))
    model = ties._model(*ties._contexts(_tokens(spark)))
    for percent, most in ((50, 100), (90, 3), (99, 10)):
        cut = c.rows.select("l", "r", F.inline(ties.cut_words(F.col("words"), percent, most))).select("l", "r", "cand", "prob")
        assert _key(cut) == _key(ties.cumulative_cutoff(model, percent, most, by=ties.CONTEXT).select("l", "r", "cand", "prob")) != []


def test_sums_of_cut_ties(spark, each):
    tokens = _tokens(spark)
    model, at = ties.count_model(tokens)
    want = _summed(ties.candidates(ties.tie_list(model, 90, 3, 0.2, by=ties.CONTEXT), at))
    assert _key(ties.tie_sums(ties.contexts(tokens), 90, 3, 0.2)) == _key(want) != []


def test_topk_is_exchanged_before_it_is_spelt_out(spark, tmp_path):
    plan = _spread(spark, tmp_path, "tie_topk_norm")
    assert "Exchange" not in plan[: plan.index("Generate inline")] and "SortMergeJoin" not in plan


def test_sums_without_the_own_tie(spark, each):
    tokens = _tokens(spark)
    model, at = ties.count_model(tokens)
    want = _summed(ties.clean_distribution(ties.candidates(ties.cumulative_cutoff(model, 99, 4, by=ties.CONTEXT), at)))
    assert _key(ties.tie_sums(ties.contexts(tokens), 99, 4, own_tie=False)) == _key(want) != []


def test_own_ties_are_exchanged_before_they_are_spelt_out(spark, tmp_path):
    plan = _spread(spark, tmp_path, "tie_own_tie_removed")
    assert "Exchange" not in plan[: plan.index("Generate inline")] and "SortMergeJoin" not in plan


def test_a_cutoff_needs_no_window(spark, tmp_path):
    plan = _spread(spark, tmp_path, "tie_cumulative_cutoff")
    assert "Window" not in plan and "rangepartitioning" not in plan


def test_figures_of_ties_are_those_of_the_rows(spark, each):
    docs = _docs(spark)
    felt = spark.createDataFrame([("a", 0.5, 1.0), ("badly", -0.5, 0.25)], "token string, polarity double, subjective double")
    rows = docs.select(F.col("doc_id").alias("run_index"), (F.col("doc_id") % 2).cast("int").alias("time"), F.col("text").alias("sentence"), F.col("source").alias("p1"))
    made, _ = ties.tie_rows(rows, felt, percent=90, max_degree=3, cutoff_prob=0.2)
    want = made.groupBy("time", "p1", "part_of_speech").agg(F.count("*").alias("n"), F.count_distinct("occ", "sub").alias("pairs"), F.sum("weight").alias("weight"), F.max("sentiment").alias("sentiment"), F.max("subjectivity").alias("subjectivity"))
    got = ties.tie_figures(rows, felt, ["time", "p1"], 90, 3, 0.2)
    assert _key(got) == _key(want) and {r.part_of_speech for r in got.collect()} == {"NOUN", "VERB", "ADV"} and got.where("p1 is null").count() > 0


def test_figures_need_no_ties_in_an_exchange(spark, tmp_path):
    plan = _spread(spark, tmp_path, "text_tie_rows")
    # one row for each group leaves the tasks in which pairs are spelt out
    above = plan[: plan.index("Generate explode(split(")]
    assert not any("cand#" in line for line in above.splitlines() if "Exchange" in line)
