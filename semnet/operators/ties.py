"""The table of ties: sources, and the steps from candidate probabilities to ties."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..shared import counted, dealt, kept

TIES = (
    "time int, run_index long, seq_id long, pos int, occ int, sub int, weight double, part_of_speech string, sentiment double, subjectivity double, "
    "p1 string, p2 string, p3 string, p4 string"
)


#: Order lines that a task has before its windows, words before their contexts are counted, ties before they are summed.
LINES_EACH, WORDS_EACH, TIES_EACH = 500_000, 500_000, 1_000_000

#: Between the words of a row that is exchanged; no word has it.
NUL = "\x00"


def _mean4(col: str, over) -> Column:
    """Mean of whole ten-thousandths: the same whatever the order of the sum."""
    return F.floor(F.sum(col).over(over) / F.count("*").over(over)) / 10000


def from_lineitem(lineitem: DataFrame, words: int = 200) -> DataFrame:
    """Ties of order lines: an order is a sentence, a line a position, its parts the candidates.

    The windows are over the columns' new names, so that filters on a sequence go
    below them, and over one order of rows: one exchange and one sort serve both,
    and what is grouped by sequence later needs no other exchange. A task has
    about LINES_EACH lines, however many there are.
    """
    n = None if lineitem.isStreaming else lineitem.count()
    ten = lambda c: F.round(F.col(c) * 10000).cast("long")
    rows = lineitem.select(
        F.col("l_orderkey").alias("run_index"), F.col("l_linenumber").cast("int").alias("pos"), F.col("l_partkey").alias("_part"), F.col("l_quantity").alias("_n"),
        F.year("l_shipdate").cast("int").alias("_year"), F.col("l_returnflag").alias("_flag"), ten("l_discount").alias("_discount"), ten("l_tax").alias("_tax"), F.col("l_linestatus").alias("_status"),
    )
    rows = dealt(rows, n, LINES_EACH, "run_index")
    line = Window.partitionBy("run_index", "pos")
    order = Window.partitionBy("run_index").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = rows.select(
        "run_index", "pos", "_part", "_n", F.min("_year").over(order).alias("time"), F.min("_part").over(line).alias("_first"), F.sum("_n").over(line).alias("_all"), F.min("_flag").over(line).alias("part_of_speech"),
        _mean4("_discount", order).alias("sentiment"), _mean4("_tax", order).alias("subjectivity"), F.min("_status").over(order).alias("p1"),
    )
    # what needs no window is computed behind the exchange, which then carries no column twice
    return seen.select(
        "time", "run_index", F.col("run_index").alias("seq_id"), "pos", (F.col("_first") % words).cast("int").alias("occ"), (F.col("_part") % words).cast("int").alias("sub"),
        (F.col("_n") / F.col("_all")).alias("weight"), "part_of_speech", "sentiment", "subjectivity", "p1",
    )


def neighbours(rows: DataFrame, tokens: str) -> DataFrame:
    """(pos, token, l, r and the other columns of ``rows``): a row per word of the array ``tokens`` with the words beside it, null at the ends. Nothing is shuffled."""
    edge = F.array(F.lit(None).cast("string"))

    def beside(t: Column) -> Column:
        n = F.greatest(F.size(t) - 1, F.lit(0))
        return F.arrays_zip(t.alias("token"), F.concat(edge, F.slice(t, F.lit(1), n)).alias("l"), F.concat(F.slice(t, F.lit(2), n), edge).alias("r"))

    # a lambda's variable is evaluated once
    zipped = F.transform(F.array(F.col(tokens)), beside)[0]
    rest = [c for c in rows.columns if c != tokens]
    return rows.where(F.size(tokens) > 0).select(*rest, F.posexplode(zipped).alias("pos", "_z")).select(*rest, "pos", "_z.*")


def _between(tokens: DataFrame) -> DataFrame:
    """Tokens that have a word on both sides."""
    if not {"l", "r"} <= set(tokens.columns):
        w = Window.partitionBy("run_index").orderBy("pos")
        tokens = tokens.withColumn("l", F.lag("token").over(w)).withColumn("r", F.lead("token").over(w))
    return tokens.where("l is not null and r is not null")


class Contexts(NamedTuple):
    """``rows`` (l, r, words): a row per context, r null for what follows l whatever comes then; words is its array of (token, n, own).

    ``n`` times the word is written there, ``own`` of them take this context's
    distribution: all between two words that several are written between, the
    others after their left one.  With carried columns, ``of`` has them for each
    of the ``own``.  ``frequent`` (word, parts) are the words that a task alone
    would have too many of, ``words`` the number of occurrences and ``ties`` that
    of pairs of an entry of ``own`` and one of the first ten of the context.
    """

    rows: DataFrame
    frequent: DataFrame
    words: int
    ties: int


def contexts(tokens: DataFrame, *carried: str) -> Contexts:
    """What is written in which context, by one exchange of the words.

    Words are dealt by the left one, about WORDS_EACH a task and those of a
    frequent left one over several, so that contexts of two words, those of one
    and the cuts of both need no other exchange; only what follows a frequent
    word is summed over its parts again.
    """
    t = _between(tokens).select("l", "r", "token", *carried)
    left, of = counted(t.groupBy("l").agg(F.count("*").alias("n")), "left", words=F.sum("n"))
    frequent = left.where(F.col("n") > WORDS_EACH // 2).select(F.col("l").alias("word"), F.ceil(F.col("n") / (WORDS_EACH // 2)).cast("int").alias("parts"))
    t = t.join(F.broadcast(frequent), F.col("l") == F.col("word"), "left").withColumn("part", F.pmod(F.xxhash64("r"), F.col("parts")).cast("int")).drop("word", "parts")
    t = dealt(t.repartition("l", "part"), of["words"], WORDS_EACH, "l", "part")
    here, more = ["l", "part", "r"], ["of"] * bool(carried)
    one = t.groupBy(*here, "token").agg(F.count("*").alias("n"), *(F.collect_list(F.struct(*carried)).alias(c) for c in more))
    one = one.withColumn("k", F.count("*").over(Window.partitionBy(*here)))
    # once for the left word, and once for both where several words are between them
    none, between = F.lit(None).cast("string").alias("r"), F.col("r").alias("r")
    own = lambda r, n, *o: F.struct(r, n.alias("own"), *(x.alias("of") for x in o))
    nothing = [F.slice(c, 1, 0) for c in more]
    twice = F.array(own(none, F.lit(0).cast("long"), *nothing), own(between, F.col("n"), *map(F.col, more)))
    spread = one.select("l", "part", "token", "n", F.inline(F.when(F.col("k") > 1, twice).otherwise(F.array(own(none, F.col("n"), *map(F.col, more))))))

    def whole(rows: DataFrame, *by: str) -> DataFrame:
        lists = [F.flatten(F.collect_list(c)).alias(c) for c in more]
        sums = rows.groupBy(*by, "token").agg(F.sum("n").alias("n"), F.sum("own").alias("own"), *lists)
        return sums.groupBy(*by).agg(F.collect_list(F.struct("token", "n", "own", *more)).alias("words"))

    mine = F.filter("words", lambda x: x["own"] > 0)
    entries_ = F.aggregate(mine, F.lit(0).cast("long"), lambda s, x: s + (x["own"] if carried else 1))
    made, seen = counted(whole(spread, *here), "contexts", ties=F.sum(entries_ * F.least(F.size("words"), F.lit(10))))
    split = F.col("r").isNull() & F.col("part").isNotNull()
    again = whole(made.where(split).select("l", "r", F.inline("words")), "l", "r")
    return Contexts(made.where(~split).select("l", "r", "words").union(again.select("l", "r", "words")), frequent, of["words"], seen["ties"])


def cut_words(words: Column, percent: float = 99, max_degree: int = 100, digits: int | None = None) -> Column:
    """``cumulative_cutoff`` of a context's words: those it keeps, as an array of (cand, n, prob) by falling probability. ``digits`` rounds probabilities."""

    def ranked(w: Column, whole: Column) -> Column:
        share = lambda x: x["n"] / whole if digits is None else F.round(x["n"] / whole, digits)
        return F.sort_array(F.transform(w, lambda x: F.struct((-share(x)).alias("less"), x["token"].alias("cand"), x["n"].alias("n"))))

    def cut(e: Column) -> Column:
        mass = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s - y["less"])
        enough = lambda least: F.filter(F.slice(e, 1, max_degree), lambda x, i: F.round(mass(F.slice(e, F.lit(1), i)), 9) < least)
        return once(F.round(mass(e) * percent / 100, 9), enough)

    found = once(words, lambda w: once(once(F.aggregate(w, F.lit(0).cast("long"), lambda s, x: s + x["n"]), lambda n: ranked(w, n)), cut))
    return F.transform(found, lambda x: F.struct(x["cand"].alias("cand"), x["n"].alias("n"), (-x["less"]).alias("prob")))


def once(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once, as a lambda's variable is."""
    return F.transform(F.array(value), use)[0]


def _mass(e: Column) -> Column:
    return F.aggregate(e, F.lit(0.0), lambda s, x: s + x["prob"])


def by_word(rows: DataFrame, frequent: DataFrame, ties: int, counts: bool = True) -> DataFrame:
    """Rows (occ, found: array of (cand, n), and others) dealt by the word that is written, about TIES_EACH of ``ties`` a task, those of a frequent word over several by cand.

    A row's candidates go as one string and, with ``counts``, their counts as
    one array: (occ, part, cands, ns, and the others).  What is
    grouped by occ, part and other columns needs no other exchange.
    """
    rest = [c for c in rows.columns if c != "found"]
    rows = rows.join(F.broadcast(frequent), F.col("occ") == F.col("word"), "left")
    whose = lambda x: F.pmod(F.xxhash64(x["cand"]), F.col("parts")).cast("int")
    share = lambda p: F.struct(p.alias("part"), F.filter("found", lambda x: whose(x) == p).alias("found"))
    alone = F.array(F.struct(F.lit(None).cast("int").alias("part"), F.col("found")))
    rows = rows.select(*rest, F.inline(F.when(F.col("parts").isNull(), alone).otherwise(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), share)))).where(F.size("found") > 0)
    packed = rows.select(*rest, "part", F.array_join(F.transform("found", lambda x: x["cand"]), NUL).alias("cands"), *([F.transform("found", lambda x: x["n"]).alias("ns")] if counts else []))
    return dealt(packed.repartition("occ", "part"), ties, TIES_EACH, "occ", "part")


def tie_sums(c: Contexts, percent: float = 99, max_degree: int = 10, cutoff_prob: float | None = None, own_tie: bool = True, digits: int | None = None) -> DataFrame:
    """(sub, occ, n, weight): the ties of all occurrences summed by their two words, without a row for each occurrence.

    The sums of ``tie_list`` with a ``cutoff_prob``, and those of the clean
    distributions without the own tie.  Ties are spelt out behind the exchange
    and only there.
    """
    whole = F.aggregate("words", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    rows = c.rows.select(F.filter("words", lambda x: x["own"] > 0).alias("mine"), whole.alias("whole"), cut_words(F.col("words"), percent, max_degree, digits).alias("found")).where(F.size("mine") > 0)
    if not own_tie:
        # the last has the least probability, the first the greatest
        least = lambda e: F.filter(e, lambda x: (x["prob"] > e[F.size(e) - 1]["prob"]) | (e[0]["prob"] == e[F.size(e) - 1]["prob"]))
        rows = rows.withColumn("found", once(F.col("found"), least))
    else:
        rows = rows.withColumn("mass", _mass(F.col("found")))
    if cutoff_prob is not None:
        rows = rows.withColumn("found", F.filter("found", lambda x: x["prob"] / F.col("mass") >= cutoff_prob))
    rows = rows.select(F.explode("mine").alias("w"), *(x for x in rows.columns if x != "mine")).select(F.col("w.token").alias("occ"), F.col("w.own").alias("n"), *(x for x in rows.columns if x != "mine"))
    if not own_tie:
        rows = rows.withColumn("found", F.filter("found", lambda x: x["cand"] != F.col("occ"))).withColumn("mass", _mass(F.col("found")))
    prob = F.col("c") / F.col("whole")
    weight = (prob if digits is None else F.round(prob, digits)) / F.col("mass")
    packed = by_word(rows, c.frequent, c.ties)
    pairs = packed.select("occ", "part", "n", "whole", "mass", F.inline(F.arrays_zip(F.split("cands", NUL).alias("cand"), F.col("ns").alias("c"))))
    return pairs.groupBy("occ", "part", "cand").agg(F.sum("n").alias("n"), F.sum(weight * F.col("n")).alias("weight")).select(F.col("cand").alias("sub"), "occ", "n", "weight")


def _contexts(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row per word of a context: (l, r, token, n, own, k, whole) of what is written between two words, and of what follows one.

    k words fill the context ``whole`` times; ``own`` occurrences take its distribution.
    """
    whole = F.aggregate("words", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    rows = contexts(t).rows.select("l", "r", F.size("words").alias("k"), whole.alias("whole"), F.inline("words"))
    return rows.where("r is not null"), rows.where("r is null")


def _model(both: DataFrame, left: DataFrame) -> DataFrame:
    prob = (F.col("n") / F.col("whole")).alias("prob")
    return both.select("l", "r", F.col("token").alias("cand"), prob).union(left.select("l", F.lit(None).cast("string"), "token", prob))


def count_model(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A masked model by counts: what is written between the same neighbours, or after the same left one where that pair is unique.

    ``tokens`` has (run_index, pos, token), and l and r where the words beside
    it are known.  Returns (l, r, cand, prob), r null for the left neighbour
    alone, and (run_index, pos, occ, l, r), the context of each occurrence, with
    further columns of ``tokens``.  All occurrences of a context share its
    distribution, so it is cut once per context and not once per occurrence.
    """
    t = _between(tokens)
    both, left = _contexts(t)
    many = both.select("l", "r", F.lit(True).alias("many")).distinct()
    rest = [c for c in tokens.columns if c not in ("run_index", "pos", "token", "l", "r")]
    at = t.join(many, ["l", "r"], "left").select("run_index", "pos", F.col("token").alias("occ"), "l", F.when(F.col("many"), F.col("r")).alias("r"), *rest)
    return _model(both, left), at


def counted_model(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``count_model`` with a row (occ, l, r, n) for the ``n`` occurrences that a word has in a context: all that sums over occurrences need."""
    both, left = _contexts(_between(tokens))
    at = both.select(F.col("token").alias("occ"), "l", "r", "n").union(left.where("own > 0").select("token", "l", F.lit(None).cast("string"), "own"))
    return _model(both, left), at


CONTEXT = ("l", "r")


def entries(model: DataFrame, at: DataFrame, *values: str, name: str = "entries") -> DataFrame:
    """``at`` with its context's rows of the model in an array instead of the context: one row each, however many candidates there are."""
    m = model.select(F.col("l").alias("_l"), F.coalesce("r", F.lit("")).alias("_r"), F.struct(*values).alias("_e")).groupBy("_l", "_r").agg(F.collect_list("_e").alias(name))
    j = at.join(m, (at["l"] == F.col("_l")) & (F.coalesce(at["r"], F.lit("")) == F.col("_r")))
    return j.select(*(c for c in at.columns if c not in CONTEXT), name)


def candidates(model: DataFrame, at: DataFrame) -> DataFrame:
    """(run_index, pos, occ, cand, prob): the model's entries at each occurrence, with the other columns of ``at``."""
    return entries(model, at, "cand", "prob").select(*(c for c in at.columns if c not in CONTEXT), F.inline("entries"))


def clean_entries(found: Column, occ: Column) -> Column:
    """``clean_distribution`` of a place's array of (cand, prob), without lists of words."""

    def cut(e: Column) -> Column:
        probs = F.transform(e, lambda x: x["prob"])
        low, high = F.array_min(probs), F.array_max(probs)
        return F.filter(e, lambda x: ((x["prob"] > low) | (low == high)) & (x["cand"] != occ))

    def share(e: Column) -> Column:
        whole = F.aggregate(e, F.lit(0.0), lambda s, x: s + x["prob"])
        return F.transform(e, lambda x: F.struct(x["cand"].alias("cand"), F.when(whole > 0, x["prob"] / whole).otherwise(x["prob"]).alias("prob")))

    return F.transform(F.transform(F.array(found), cut), share)[0]


PLACE = ("run_index", "pos")


def normalised(p: DataFrame, col: str = "prob", by=PLACE) -> DataFrame:
    """Divide by the sum of the place; places of sum 0 stay."""
    s = F.sum(col).over(Window.partitionBy(*by))
    return p.withColumn(col, F.when(s > 0, F.col(col) / s).otherwise(F.col(col)))


def clean_distribution(p: DataFrame, stops: DataFrame | None = None, seen: DataFrame | None = None, own_tie: bool = False) -> DataFrame:
    """Drop the least entries, stop words, unseen words and, unless ``own_tie``, the word itself; then normalise."""
    low = F.min("prob").over(Window.partitionBy(*PLACE))
    high = F.max("prob").over(Window.partitionBy(*PLACE))
    p = p.withColumn("_low", low).withColumn("_high", high).where("prob > _low or _low = _high").drop("_low", "_high")
    if not own_tie:
        p = p.where("cand <> occ")
    if stops is not None:
        s = F.broadcast(stops.select(F.col(stops.columns[0]).alias("_s")))
        p = p.join(s, F.col("cand") == F.col("_s"), "left_anti").join(s, F.col("occ") == F.col("_s"), "left_anti")
    if seen is not None:
        p = p.join(seen.select(F.col(seen.columns[0]).alias("cand")), "cand", "left_semi")
    return normalised(p)


def cumulative_cutoff(p: DataFrame, percent: float = 99, max_degree: int = 100, by=PLACE, value: str = "prob", item: str = "cand") -> DataFrame:
    """Keep the fewest entries that have ``percent`` of the mass, ``max_degree`` of them at most; ties by ``item``."""
    order = Window.partitionBy(*by).orderBy(F.col(value).desc(), F.col(item))
    back = F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, -1))
    p = p.withColumn("_rank", F.row_number().over(order)).withColumn("_before", F.coalesce(back, F.lit(0.0)))
    p = p.withColumn("_all", F.sum(value).over(Window.partitionBy(*by)))
    return p.where((F.round("_before", 9) < F.round(F.col("_all") * percent / 100, 9)) & (F.col("_rank") <= max_degree)).drop("_rank", "_before", "_all")


def tie_list(p: DataFrame, percent: float = 99, max_degree: int = 100, cutoff_prob: float = 0.001, normalise: bool = True, by=PLACE) -> DataFrame:
    """Cut, normalise, then drop what is below ``cutoff_prob``; ``by`` says whose distribution an entry belongs to."""
    cut = cumulative_cutoff(p, percent, max_degree, by)
    cut = normalised(cut, by=by) if normalise else cut
    return cut.where(F.col("prob") >= cutoff_prob)


def text_ties(tokens: DataFrame, percent: float = 99, max_degree: int = 100, cutoff_prob: float = 0.001) -> DataFrame:
    """(run_index, pos, occ, sub, weight): ties of tokens by the count model."""
    return candidates(*context_ties(tokens, percent, max_degree, cutoff_prob)).withColumnRenamed("cand", "sub").withColumnRenamed("prob", "weight")


def context_ties(tokens: DataFrame, percent: float = 99, max_degree: int = 100, cutoff_prob: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """``text_ties`` before the ties are spelt out: the cut model, and the context of each occurrence."""
    model, at = count_model(tokens)
    return tie_list(model, percent, max_degree, cutoff_prob, by=CONTEXT), at


PARAMETERS = ("p1", "p2", "p3", "p4")


def tie_rows(sentences: DataFrame, lexicon: DataFrame | None = None, known: DataFrame | None = None, percent: float = 99, max_degree: int = 100, cutoff_prob: float = 0.001, model=context_ties) -> tuple[DataFrame, DataFrame]:
    """(ties, words) of sentences (run_index, time, sentence; seq_id and p1 .. p4 where there): rows of a store, and the dictionary (token, token_id).

    ``model`` makes (run_index, pos, occ, sub, weight) of tokens (run_index, pos,
    token, l, r and what is known of the sentence), or, like ``context_ties``,
    (l, r, cand, prob) and the contexts (run_index, pos, occ, l, r and the rest)
    of the occurrences. Words that ``known`` has keep their ids. A tie has its
    sentence's time, parameters and mood, the mean of the words that ``lexicon``
    (token, polarity, subjective) has, and the part of speech of the word that
    is written.
    """
    spark = sentences.sparkSession
    given = [F.col(c) if c in sentences.columns else F.lit(None).cast("string").alias(c) for c in PARAMETERS]
    seq = (F.col("seq_id") if "seq_id" in sentences.columns else F.col("run_index")).alias("seq_id")
    about = sentences.select("run_index", F.col("time").cast("int").alias("time"), seq, *given, text.tokens(F.col("sentence")).alias("_t"))
    if lexicon is None:
        about = about.withColumn("sentiment", F.lit(0.0)).withColumn("subjectivity", F.lit(0.0))
    else:
        about = about.join(text.lexicon_score(sentences.select("run_index", text.tokens(F.col("sentence")).alias("t")), "run_index", "t", lexicon), "run_index")
    toks = neighbours(about, "_t")
    made = model(toks, percent, max_degree, cutoff_prob)
    known = spark.createDataFrame([], "token string, token_id long") if known is None else known
    words = kept(text.assign_ids(sentences.select(F.explode(text.tokens(F.col("sentence"))).alias("token")), known), "words")
    occ, sub = (words.select(F.col("token").alias(c), F.col("token_id").cast("int").alias(f"{c}_id")) for c in ("occ", "sub"))
    of = ["time", "seq_id", *PARAMETERS, "sentiment", "subjectivity"]
    tag = text.suffix_tag(F.col("occ")).alias("part_of_speech")
    if isinstance(made, DataFrame):
        rows = made.select("run_index", "pos", "occ", "sub", "weight", tag).join(occ, "occ").join(sub, "sub").join(about.select("run_index", *of), "run_index")
    else:
        # the words of the model's entries get their ids once a context; ties are spelt out last, behind all exchanges
        cut = made[0].withColumnRenamed("cand", "sub").join(sub, "sub").select(*CONTEXT, "sub_id", F.col("prob").alias("weight"))
        at = made[1].join(occ, "occ").select("run_index", "pos", "occ_id", tag, *of, *CONTEXT)
        rows = entries(cut, at, "sub_id", "weight").select("run_index", "pos", "occ_id", "part_of_speech", *of, F.inline("entries"))
    order = ["time", "run_index", "seq_id", "pos", F.col("occ_id").alias("occ"), F.col("sub_id").alias("sub"), "weight", "part_of_speech", "sentiment", "subjectivity", *PARAMETERS]
    return rows.select(*order), words


def tie_figures(sentences: DataFrame, lexicon: DataFrame, by: list[str], percent: float = 90, max_degree: int = 10, cutoff_prob: float = 0.001, digits: int | None = None) -> DataFrame:
    """The ties of ``tie_rows`` by part of speech and columns ``by`` of the sentences: n, pairs (of different words), weight, and the greatest sentiment and subjectivity.

    Contexts carry the groups and moods of their occurrences, so that sums need
    no ties, and pairs are spelt out behind the one exchange that deals them.
    """
    groups = kept(sentences.select(*by).distinct().withColumn("g", F.monotonically_increasing_id()), "groups")
    asked = F.lit(True)
    for c in by:
        asked = asked & sentences[c].eqNullSafe(groups[c])
    mood = kept(text.lexicon_score(sentences.select("run_index", text.tokens(F.col("sentence")).alias("t")), "run_index", "t", lexicon), "mood")
    about = sentences.join(groups, asked).select("run_index", "g", "sentence").join(mood, "run_index")
    found = contexts(neighbours(about.select("g", "sentiment", "subjectivity", text.tokens(F.col("sentence")).alias("_t")), "_t"), "g", "sentiment", "subjectivity")
    enough = lambda e, mass: F.struct(F.filter(e, lambda x: x["prob"] / mass >= cutoff_prob).alias("found"), mass.alias("mass"))
    cut = once(cut_words(F.col("words"), percent, max_degree, digits), lambda e: once(_mass(e), lambda mass: enough(e, mass)))
    rows = found.rows.select(F.filter("words", lambda x: x["own"] > 0).alias("mine"), cut.alias("cut"))
    # a filter on the cut would go below it and take it twice
    rows = rows.select("cut.found", "cut.mass", F.explode(F.when(F.size("cut.found") > 0, F.col("mine"))).alias("w"))
    rows = rows.select(F.col("w.token").alias("occ"), text.suffix_tag(F.col("w.token")).alias("part_of_speech"), F.col("w.of").alias("of"), "found", "mass")
    group = ["g", "part_of_speech"]
    sums = rows.select("part_of_speech", F.size("found").alias("_n"), (_mass(F.col("found")) / F.col("mass")).alias("_w"), F.inline("of"))
    sums = sums.groupBy(*group).agg(F.sum("_n").alias("n"), F.sum("_w").alias("weight"), F.max("sentiment").alias("sentiment"), F.max("subjectivity").alias("subjectivity"))
    packed = by_word(rows.select("occ", "part_of_speech", F.array_distinct(F.transform("of", lambda x: x["g"])).alias("gs"), "found"), found.frequent, found.ties, counts=False)
    pairs = packed.select("occ", "part", "part_of_speech", "gs", F.explode(F.split("cands", NUL)).alias("cand")).select("occ", "part", "part_of_speech", "cand", F.explode("gs").alias("g"))
    pairs = pairs.groupBy("occ", "part", "cand", *group).agg(F.lit(1).alias("one")).groupBy(*group).agg(F.count("*").alias("pairs"))
    return sums.join(pairs, group).join(groups, "g").select(*by, "part_of_speech", "n", "pairs", "weight", "sentiment", "subjectivity")
