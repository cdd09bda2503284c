import itertools

import numpy as np
from pyspark.sql import functions as F

from semnet.functions import epochs, sentences, text

#: Words with a final period that don't end a sentence, and where they stand.
SHORT = ["Dr.", "Mr.", "Prof.", "St.", "e.g.", "i.e.", "U.S.", "approx.", "No."]
NAMES = ["Miller", "Okafor", "Tanaka", "Ivanov", "Garcia", "Lindqvist", "Petrov", "Haddad"]
SUBJECTS = ["The board", "A new law", "Our town", "This report", "Every member", "The weather", "He", "She", "It", "Nobody"]
VERBS = ["changed", "was discussed", "seemed fine", "will matter", "came too late", "is gone"]
PLACES = ["in the city", "after the war", "near the river", "for a long time", "without any reason", "during the meeting"]


def corpus(seed=4, texts=120):
    """Texts with the sentences they were made of."""
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[r.integers(0, len(xs))]
    forms = [
        lambda: f"{pick(SUBJECTS)} {pick(VERBS)} {pick(PLACES)}", lambda: f"{pick(['Dr.', 'Mr.', 'Prof.'])} {pick(NAMES)} {pick(VERBS)} {pick(PLACES)}",
        lambda: f"{pick(SUBJECTS)} met {pick(['Dr.', 'Mr.', 'Prof.'])} {pick(NAMES)} {pick(PLACES)}", lambda: f"{pick(SUBJECTS)} {pick(VERBS)}, e.g. {pick(PLACES)}, i.e. {pick(PLACES)}",
        lambda: f"{pick(SUBJECTS)} moved to St. {pick(NAMES)} {pick(PLACES)}", lambda: f"The U.S. {pick(['army', 'senate', 'economy'])} {pick(VERBS)} {pick(PLACES)}",
        lambda: f"It took approx. {r.integers(2, 90)} days {pick(PLACES)}", lambda: f"{pick(SUBJECTS)} was No. {r.integers(1, 9)} {pick(PLACES)}", lambda: f"J. {pick(NAMES)} {pick(VERBS)} {pick(PLACES)}",
    ]
    for _ in range(texts):
        yield [pick(forms)() + pick([".", ".", ".", ".", "?", "!"]) for _ in range(r.integers(3, 25))]


def test_sentences_learn_abbreviations(spark):
    gold = list(corpus())
    rows = spark.createDataFrame([(i, " ".join(s)) for i, s in enumerate(gold)], "id long, t string")
    known = sentences.learn(rows, "t")
    short = {r.type for r in known.abbreviations.collect()}
    assert {"dr", "mr", "prof", "st", "e.g", "i.e", "u.s", "approx", "no"} <= short
    got = {}
    for r in sentences.split(rows, "t", known).collect():
        got.setdefault(r.id, {})[r["index"]] = r.sentence
    made = [[got[i][k] for k in range(len(got[i]))] for i in range(len(gold))]
    assert [" ".join(m) for m in made] == [" ".join(g) for g in gold]  # nothing is lost

    def cuts(parts):
        return {sum(len(p) + 1 for p in parts[: k + 1]) for k in range(len(parts) - 1)}

    right = sum(len(cuts(m) & cuts(g)) for m, g in zip(made, gold))
    assert right / sum(len(cuts(m)) for m in made) > 0.99 and right / sum(len(cuts(g)) for g in gold) > 0.98
    # the plain pattern cuts after every abbreviation
    pattern = rows.select(text.sentences(F.col("t")).alias("s")).collect()
    assert sum(len(cuts(g)) for g in gold) / sum(len(cuts(p.s)) for p in pattern) < 0.75


def test_sentences_edges(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t"), (4, "No mark here"), (5, "  One.\nTwo!  Three?\t"), (6, "..."), (7, "Wait... What? \"Yes.\" (Fine.) It's 3.5 now."), (None, "A b. C d."), (5, "  One.\nTwo!  Three?\t")], "id long, t string").withColumn("type", F.lit("x")).withColumn("pos", F.lit(1))
    got = sentences.split(rows, "t")
    assert got.columns == ["id", "t", "type", "pos", "index", "sentence"]
    by = {}
    for r in got.collect():
        by.setdefault(r.id, []).append((r["index"], r.sentence))
    assert not {1, 2, 3} & set(by) and by[4] == [(0, "No mark here")] and by[6] == [(0, "...")]
    assert sorted(by[5]) == [(k, s) for k, s in enumerate(["One.", "Two!", "Three?"]) for _ in range(2)]
    assert [s for _, s in sorted(by[7])] == ["Wait...", "What?", '"Yes."', "(Fine.)", "It's 3.5 now."]
    assert sentences.split(rows.where("false"), "t").count() == 0
    # what was learnt on one corpus splits another
    known = sentences.learn(spark.createDataFrame([("Dr. Lee came. Dr. May went. Ask Dr. Poe now. The end came.",)] * 9, "t string"), "t")
    other = spark.createDataFrame([(1, "Then Dr. No left. The rest stayed.")], "id long, t string")
    assert [r.sentence for r in sentences.split(other, "t", known).orderBy("index").collect()] == ["Then Dr. No left.", "The rest stayed."]


def test_places_are_a_permutation(spark):
    for n in (1, 2, 3, 7, 64, 65, 1000):
        got = spark.range(n).select("id", epochs.place(F.col("id"), n, 5).alias("p"), epochs.row_at(F.col("id"), n, 5).alias("r")).collect()
        assert sorted(x.p for x in got) == list(range(n))
        at = {x.id: x.p for x in got}
        assert all(at[x.r] == x.id for x in got)
    # another seed or epoch is another order; nearly nothing stays in place
    orders = {k: [x.p for x in spark.range(1000).select("id", epochs.place(F.col("id"), 1000, *k).alias("p")).orderBy("id").collect()] for k in ((1, 0), (1, 1), (2, 0))}
    for a, b in itertools.combinations([*orders.values(), list(range(1000))], 2):
        assert sum(x == y for x, y in zip(a, b)) < 12 and abs(np.corrcoef(a, b)[0, 1]) < 0.12
    assert all(abs(sum(x % 2 == y % 2 for x, y in enumerate(o)) - 500) < 80 for o in orders.values())


def test_epochs(spark):
    n, rows = 500, spark.range(500).select(F.col("id").alias("index"), (F.col("id") * 3).alias("v"))
    whole = {r["index"]: r.place for r in epochs.shuffled(rows, n, 9, epoch=2).collect()}
    assert whole == {r["index"]: r.place for r in epochs.shuffled(rows.repartition(7), n, 9, epoch=2).collect()}
    parts = [epochs.epoch_slice(rows, n, 9, a, a + 170, epoch=2).collect() for a in (0, 170, 340)]
    assert [len(p) for p in parts] == [170, 170, 160] and {r["index"]: r.place for p in parts for r in p} == whole
    held = [{r["index"] for r in epochs.shuffled(rows, n, 9, epoch=e, validation=50).where("validation").collect()} for e in (0, 1)]
    assert held[0] == held[1] and len(held[0]) == 50
    big = spark.range(10**15, 10**15 + 50).select(epochs.place(F.col("id"), 10**16, 3).alias("p")).collect()
    assert len({x.p for x in big}) == 50 and all(0 <= x.p < 10**16 for x in big)
