"""Ties by counts of contexts: the same sums as occurrence by occurrence."""

import random

from pyspark.sql import functions as F

from semnet.functions import sentences, text
from semnet.operators import ties


def _docs(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdef") for _ in range(60))) for i in range(8)] + [(90, ""), (91, None), (92, "lone"), (93, "two words")]
    return spark.createDataFrame(rows, "run_index long, text string")


def _pairs(df, by=("occ", "cand")):
    return {tuple(r[c] for c in by): (r["n"], round(r["w"], 9)) for r in df.collect()}


def test_neighbours_are_the_windows(spark):
    docs = _docs(spark).select("run_index", text.tokens(F.col("text")).alias("t"))
    beside = ties.neighbours(docs, "t")
    plain = beside.select("run_index", "pos", "token")
    order = ["run_index", "pos", "token", "l", "r"]
    assert "Exchange" not in beside._jdf.queryExecution().executedPlan().toString()
    assert beside.count() == 8 * 60 + 3
    assert sorted(ties._between(plain).select(*order).collect()) == sorted(ties._between(beside).select(*order).collect())


def test_counted_contexts_give_the_sums_of_occurrences(spark):
    tokens = ties.neighbours(_docs(spark).select("run_index", text.tokens(F.col("text")).alias("t")), "t")
    model, at = ties.count_model(tokens)
    _, counted = ties.counted_model(tokens)
    assert counted.agg(F.sum("n")).first()[0] == at.count() == 8 * 58
    cut = ties.tie_list(model, 90, 3, by=ties.CONTEXT)
    one = ties.candidates(cut, at).groupBy("occ", "cand").agg(F.count("*").alias("n"), F.sum("prob").alias("w"))
    many = ties.candidates(cut, counted).groupBy("occ", "cand").agg(F.sum("n").alias("n"), F.sum(F.col("prob") * F.col("n")).alias("w"))
    assert _pairs(one) == _pairs(many) != {}


def test_clean_entries_are_the_clean_distribution(spark):
    tokens = ties.neighbours(_docs(spark).select("run_index", text.tokens(F.col("text")).alias("t")), "t")
    model, at = ties.count_model(tokens)
    cut = ties.cumulative_cutoff(model, 99, 10, by=ties.CONTEXT)
    one = ties.clean_distribution(ties.candidates(cut, at))
    found = ties.entries(cut, at, "cand", "prob")
    assert found.count() == at.count()  # a row an occurrence until the ties are spelt out
    other = found.select("run_index", "pos", "occ", F.inline(ties.clean_entries(F.col("entries"), F.col("occ"))))
    key = lambda df: sorted((r["run_index"], r["pos"], r["cand"], round(r["prob"], 9)) for r in df.collect())
    assert key(one) == key(other) != []


def test_tie_rows_spell_ties_out_behind_the_exchanges(spark):
    rows = _docs(spark).where("run_index < 90").select("run_index", F.lit(2000).alias("time"), F.col("text").alias("sentence"))
    t, words = ties.tie_rows(rows, percent=90, max_degree=3)
    plan = t._jdf.queryExecution().optimizedPlan().toString().splitlines()
    inline = next(i for i, x in enumerate(plan) if "Generate inline" in x)
    assert not any("Join" in x for x in plan[:inline])
    # a model that spells its ties out gives the same rows
    plain, _ = ties.tie_rows(rows, percent=90, max_degree=3, model=ties.text_ties)
    key = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in df.collect())
    assert key(t) == key(plain) != []


def test_a_word_is_taken_apart_once(spark):
    rows = spark.createDataFrame([("It is so. Then (it) isn't!",)], "t string").withColumn("_row", F.lit(0))
    plan = sentences._tokens(rows, "t")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 4
    assert [r["type"] for r in sentences._tokens(rows, "t").orderBy("pos").collect()] == ["it", "is", "so", "then", "it", "isn't"]
