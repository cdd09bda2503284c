"""Conditional queries over ties: filters, self-joins on the sequence, capped sums.

A sequence has one time, so every self-join also equates time: filters on time
then prune both scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import counted, dealt

AGGREGATES = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min, "count": F.count}
MODES = ("bidirectional", "occurring", "substitution")


def mode_of(mode: str, strict_reference: bool = False) -> str:
    """Both spellings of occurring are known; with ``strict_reference`` anything else falls to substitution."""
    if mode in ("bidirectional", "substitution"):
        return mode
    if mode in ("occuring", "occurring") and not (strict_reference and mode == "occurring"):
        return "occurring"
    if strict_reference:
        return "substitution"
    raise ValueError(f"unknown context mode {mode!r}")


def select_ties(t: DataFrame, times=None, cutoff: float | None = None, sub=None, occ=None, pos=None, trivial: bool = True) -> DataFrame:
    """Ties by time (int, list or {start, end}), weight, ends and part of speech. A cutoff of 1e-07 or less is none."""
    if isinstance(times, dict):
        t = t.where(F.col("time").between(times["start"], times["end"]))
    elif times is not None:
        t = t.where(F.col("time").isin(*([times] if isinstance(times, int) else map(int, times))))
    if cutoff is not None and not (trivial and cutoff <= 1e-7):
        t = t.where(F.col("weight") >= cutoff)
    for col, value in (("sub", sub), ("occ", occ), ("part_of_speech", pos)):
        if value is not None:
            t = t.where(F.col(col).isin(*([value] if isinstance(value, (int, str)) else value)))
    return t


def time_stamp(times) -> tuple[int, int, int]:
    """(start, end, middle) of the output; zeros without times."""
    if times is None:
        return 0, 0, 0
    own = [times["start"], times["end"]] if isinstance(times, dict) else [times] if isinstance(times, int) else list(times)
    return min(own), max(own), (min(own) + max(own)) // 2


def _renamed(t: DataFrame, prefix: str, cols) -> DataFrame:
    return t.select(*(F.col(c).alias(f"{prefix}{c}") for c in cols))


def _context(q: DataFrame, mode: str, *kept: str) -> DataFrame:
    """(q_run_index, q_time, q_pos, q_weight, e): context words, with the columns ``kept``; a self-tie has two rows if both ends count."""
    mode = mode_of(mode)
    ends = {"bidirectional": F.array("occ", "sub"), "occurring": F.array("occ"), "substitution": F.array("sub")}[mode]
    base = [F.col(c).alias(f"q_{c}") for c in ("run_index", "time", "pos", "weight")]
    return q.select(*base, *kept, F.explode(ends).alias("e"))


def _same_sequence(left: str = "", right: str = "q_") -> Column:
    return (F.col(f"{left}run_index") == F.col(f"{right}run_index")) & (F.col(f"{left}time") == F.col(f"{right}time"))


def _elsewhere(left: str = "", right: str = "q_") -> Column:
    return _same_sequence(left, right) & (F.col(f"{left}pos") != F.col(f"{right}pos"))


def _capped(c) -> Column:
    return F.least(F.lit(1.0), c)


def substitution(t: DataFrame, ids=None, times=None, cutoff=None, pos=None, agg: str = "sum", sentiment: bool = True, drop_self: bool = False) -> DataFrame:
    """(src, dst, weight, sentiment, subjectivity): ties from substitute to occurring word."""
    r = select_ties(t, times, cutoff, sub=ids, pos=pos)
    r = r.where("sub <> occ") if drop_self else r
    extra = [F.avg("sentiment").alias("sentiment"), F.avg("subjectivity").alias("subjectivity")] if sentiment else []
    return r.groupBy(F.col("sub").alias("src"), F.col("occ").alias("dst")).agg(AGGREGATES[agg.lower()]("weight").cast("double").alias("weight"), *extra)


def substitution_in_context(t: DataFrame, contexts, mode: str = "bidirectional", ids=None, times=None, cutoff=None, pos=None, context_weight: bool = True) -> DataFrame:
    """(src, dst, weight): ties in sequences that hold a context word elsewhere, times the capped mass of these words."""
    r = select_ties(t, times, cutoff, sub=ids, pos=pos).select("run_index", "time", "pos", "sub", "occ", "weight")
    q = _context(select_ties(t, times, cutoff), mode).where(F.col("e").isin(*contexts))
    one = r.join(q, _elsewhere()).groupBy("run_index", "pos", "sub", "occ").agg(_capped(F.sum("q_weight")).alias("cw"), F.max("weight").alias("rw"))
    worth = F.col("cw") * F.col("rw") if context_weight else F.col("rw")
    return one.groupBy(F.col("sub").alias("src"), F.col("occ").alias("dst")).agg(F.sum(worth).alias("weight"))


def sequence_lengths(t: DataFrame) -> DataFrame:
    """(s_run_index, s_time, others): tie-bearing positions of a sequence besides one's own."""
    return t.groupBy(F.col("run_index").alias("s_run_index"), F.col("time").alias("s_time")).agg((F.count_distinct("pos") - 1).alias("others"))


def with_lengths(t: DataFrame) -> DataFrame:
    """``t`` with ``sequence_lengths`` as a column, for queries that need it at every tie; sequences without a time or number are left out, as in joins. One order of rows serves both windows."""
    place = Window.partitionBy("run_index", "time", "pos").orderBy("pos")
    sequence = Window.partitionBy("run_index", "time").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.where("time is not null and run_index is not null").withColumn("_new", F.when(F.col("pos").isNotNull() & (F.row_number().over(place) == 1), 1).otherwise(0))
    return t.withColumn("others", F.sum("_new").over(sequence) - 1).drop("_new")


def dyads(t: DataFrame, occurring=None, replacing=None, times=None, cutoff=None) -> DataFrame:
    if occurring is None and replacing is None:
        raise ValueError("a dyad needs an occurring or a replacing word")
    return select_ties(t, times, cutoff, sub=replacing, occ=occurring).where("sub <> occ")


NARROW = ("run_index", "time", "pos", "sub", "occ", "weight")
WIDE = (*NARROW, "part_of_speech", "sentiment", "subjectivity")

#: Ties around a dyad whose joined rows a task groups.
NEAR_EACH = 50_000


def around(t: DataFrame, occurring=None, replacing=None, times=None, cutoff=None, columns=WIDE) -> DataFrame:
    """All ties at ``times`` of the sequences that hold a dyad, kept: what is asked of a dyad joins these and not the whole table, which is gone through once."""
    if occurring is None and replacing is None:
        raise ValueError("a dyad needs an occurring or a replacing word")
    asked = F.col("sub") != F.col("occ")
    for col, value in (("sub", replacing), ("occ", occurring)):
        if value is not None:
            asked = asked & F.col(col).isin(*([value] if isinstance(value, (int, str)) else value))
    sequence = Window.partitionBy("run_index").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = select_ties(t, times).select(*columns).withColumn("_asked", F.max(asked).over(sequence))
    out, n = counted(rows.where("_asked").drop("_asked"), "around")
    out.n_rows = n["rows"]
    return out


def _by_sequence(rows: DataFrame, near: DataFrame, *by: str) -> DataFrame:
    """The ties ``near``, or rows joined from them, dealt by sequence: before they are joined by number and time, before they are grouped by number."""
    return dealt(rows, getattr(near, "n_rows", None), NEAR_EACH, *by)


def _joinable(near: DataFrame) -> DataFrame:
    return _by_sequence(near, near, "run_index", "time")


def dyad_context(t: DataFrame, occurring=None, replacing=None, times=None, cutoff=None, pos=None, scale: float = 40.0, mode: str = "bidirectional", by_pos: bool = False, near: bool = False) -> DataFrame:
    """(e, weight, sentiment, subjectivity, subs, occs): words around the occurrences of a dyad.

    ``by_pos`` adds the part of speech of the context to the key. ``near`` says
    that ``t`` is what ``around`` makes for this dyad.
    """
    t = t if near else around(t, occurring, replacing, times, cutoff)
    r = dyads(with_lengths(_joinable(t)), occurring, replacing, times, cutoff).select("run_index", "time", "pos", "sub", "occ", "weight", "sentiment", "subjectivity", "others")
    q0 = select_ties(_joinable(t), times, cutoff, pos=pos)
    key = ["e"]
    if by_pos:
        # a place may have several: its words count for each. Null is one of them
        key = ["part_of_speech", "e"]
        there = F.collect_set(F.struct("part_of_speech")).over(Window.partitionBy("run_index", "time", "pos"))
        q = _context(q0.withColumn("_parts", there), mode, "_parts").select("*", F.inline("_parts")).drop("_parts")
    else:
        q = _context(q0, mode)
    rows = _by_sequence(r.join(q, _elsewhere() & (F.col("e") != F.col("sub")) & (F.col("e") != F.col("occ"))), t, "run_index")
    first = rows.groupBy("run_index", "pos", "sub", "occ", "others", *key).agg(
        _capped(F.sum("q_weight")).alias("cw"), F.max("weight").alias("rw"), F.max("sentiment").alias("sentiment"), F.max("subjectivity").alias("subjectivity")
    )
    second = first.groupBy("run_index", "sub", "occ", "others", *key).agg(
        _capped(F.sum("cw")).alias("cw"), _capped(F.sum_distinct("rw")).alias("rw"), F.avg("sentiment").alias("sentiment"), F.avg("subjectivity").alias("subjectivity")
    )
    return second.groupBy(*key).agg(
        F.sum(scale * F.col("cw") * F.col("rw") / F.col("others")).alias("weight"), F.avg("sentiment").alias("sentiment"), F.avg("subjectivity").alias("subjectivity"),
        F.sort_array(F.collect_set("sub")).alias("subs"), F.sort_array(F.collect_set("occ")).alias("occs"),
    )


def pointwise(context: DataFrame, t: DataFrame, times=None, cutoff=None, mode: str = "bidirectional") -> DataFrame:
    """Add information measures of context words against their mass over all dyads."""
    mode = mode_of(mode)
    r = select_ties(with_lengths(t), times, cutoff).where("sub <> occ and others > 0")
    ends = {"bidirectional": F.array("occ", "sub"), "occurring": F.array("occ"), "substitution": F.array("sub")}[mode]
    base = r.select(F.explode(ends).alias("e"), (F.col("weight") / F.col("others")).alias("w")).groupBy("e").agg(F.sum("w").alias("tweight"))
    j = context.join(base, "e")
    # two sums over the joined words: one row
    sums = j.agg(F.sum("weight").alias("_w"), F.sum("tweight").alias("_t"))
    j = j.join(F.broadcast(sums), F.lit(True)).withColumn("n", F.col("weight") / F.col("_w")).withColumn("t", F.col("tweight") / F.col("_t"))
    ratio = F.ln(F.col("n") / F.col("t"))
    diff = F.abs(F.col("n") - F.col("t"))
    return (
        j.withColumn("pmi", ratio).withColumn("cond_entropy", ratio).withColumn("cond_entropy_weight", F.col("n") * ratio).withColumn("pmi_weight", F.col("weight") * ratio)
        .withColumn("rel_weight", F.col("n") / F.col("t")).withColumn("diff", diff).withColumn("diffw", F.col("n") / F.exp(-diff * diff)).drop("_w", "_t")
    )


def node_context(t: DataFrame, ids=None, times=None, cutoff=None, occurrence: bool = False, egos: DataFrame | None = None) -> DataFrame:
    """(ego, alter, weight): words at other positions than the ego's, normalised per ego; for ``ids``, or the nodes of a table ``egos`` (id)."""
    end = "occ" if occurrence else "sub"
    base = select_ties(t, times, cutoff, trivial=False)
    asked = base if ids is None else base.where(F.col(end).isin(*([ids] if isinstance(ids, int) else ids)))
    asked = asked if egos is None else asked.join(egos, F.col(end) == F.col("id"), "left_semi")
    r = asked.groupBy("run_index", "time", F.col(end).alias("ego")).agg(F.collect_set("pos").alias("places"), F.sum("weight").alias("rw"))
    q = base.select(F.col("run_index").alias("q_run_index"), F.col("time").alias("q_time"), F.col("pos").alias("q_pos"), F.col(end).alias("alter"), F.col("weight").alias("q_weight"))
    on = _same_sequence() & (F.col("alter") != F.col("ego")) & ~F.array_contains("places", F.col("q_pos"))
    w = r.join(q, on).groupBy("ego", "alter").agg(F.sum(F.col("q_weight") * F.col("rw")).alias("w"))
    return w.select("ego", "alter", (F.col("w") / F.sum("w").over(Window.partitionBy("ego"))).alias("weight"))


def _dyad_rows(t: DataFrame, occurring, replacing, times, cutoff) -> DataFrame:
    r = dyads(with_lengths(_joinable(t)), occurring, replacing, times, cutoff)
    return _renamed(r, "r_", (*NARROW, "others")).withColumnRenamed("r_others", "others")


def _outside(col: str) -> Column:
    return (F.col(col) != F.col("r_sub")) & (F.col(col) != F.col("r_occ"))


def substitution_in_dyad(t: DataFrame, ids=None, occurring=None, replacing=None, times=None, cutoff=None, normalise: bool = False, scale: float = 100.0, with_dyad: bool = False, near: bool = False) -> DataFrame:
    """(src, dst, weight): substitutions elsewhere in the sequences of a dyad; ``near`` as in dyad_context."""
    t = t if near else around(t, occurring, replacing, times, cutoff, NARROW)
    r = _dyad_rows(t, occurring, replacing, times, cutoff)
    q = _renamed(select_ties(_joinable(t), times, cutoff, sub=ids).where("sub <> occ"), "q_", NARROW)
    rows = r.join(q, _elsewhere("r_", "q_") & _outside("q_sub") & _outside("q_occ"))
    length = F.col("others") if normalise else F.lit(1)
    key = ["r_run_index", "q_sub", "q_occ", "r_sub", "r_occ", "others"]
    one = _by_sequence(rows, t, "r_run_index").groupBy(*key).agg((F.sum("q_weight") * F.sum_distinct("r_weight")).alias("w"))
    end = [F.col("q_sub").alias("src"), F.col("q_occ").alias("dst")] + ([F.col("r_sub").alias("dyad_sub"), F.col("r_occ").alias("dyad_occ")] if with_dyad else [])
    return one.groupBy(*end).agg(F.sum(F.col("w") * (scale if normalise else 1.0) / length).alias("weight"))


def context_in_dyad(t: DataFrame, ids=None, occurring=None, replacing=None, times=None, cutoff=None, mode: str = "bidirectional", normalise: bool = False, scale: float = 100.0, near: bool = False) -> DataFrame:
    """(src, dst, weight): context relations among words around a dyad; ``near`` as in dyad_context.

    Ties q are repeated by the ties t of other positions before their sum is capped, so q isn't summed first.
    """
    t = t if near else around(t, occurring, replacing, times, cutoff, NARROW)
    r = _dyad_rows(t, occurring, replacing, times, cutoff)
    base = select_ties(_joinable(t), times, cutoff)
    q = _context(base, mode).withColumnRenamed("e", "f")
    q = q if ids is None else q.where(F.col("f").isin(*([ids] if isinstance(ids, int) else ids)))
    u = _context(base, "bidirectional").select(*(F.col(f"q_{c}").alias(f"t_{c}") for c in ("run_index", "time", "pos", "weight")), "e")
    rows = r.join(q, _elsewhere("r_", "q_") & _outside("f"))
    rows = rows.join(u, _elsewhere("q_", "t_") & (F.col("f") != F.col("e")) & _outside("e"))
    one = rows.groupBy("r_run_index", "f", "e", "r_sub", "r_occ", "others").agg(
        _capped(F.sum("q_weight")).alias("qw"), _capped(F.sum("t_weight")).alias("tw"), F.max("r_weight").alias("rw")
    )
    length = F.col("others") if normalise else F.lit(1)
    worth = F.col("qw") * F.col("tw") * F.col("rw") * (scale if normalise else 1.0) / length
    return one.groupBy(F.col("f").alias("src"), F.col("e").alias("dst")).agg(F.sum(worth).alias("weight"))


def occurrences(t: DataFrame, ids=None, times=None, cutoff=None, context=None) -> DataFrame:
    """(token_id, freq): rounded mass of ties at which a word is written."""
    base = select_ties(t, times, cutoff, trivial=False)
    r = base if ids is None else base.where(F.col("occ").isin(*([ids] if isinstance(ids, int) else ids)))
    if context is not None:
        r = r.join(base.where(F.col("sub").isin(*context)).select("run_index", "time").distinct(), ["run_index", "time"], "left_semi")
    return r.groupBy(F.col("occ").alias("token_id")).agg(F.round(F.sum("weight")).alias("freq"))


def sequence_count(t: DataFrame, times=None) -> DataFrame:
    return select_ties(t, times).agg(F.count_distinct("run_index").alias("sequences"), F.round(F.sum("weight")).alias("occurrences"))


def td_idf(t: DataFrame, focal: int, times=None) -> DataFrame:
    """(token_id, occ, occ_all, tdn, idf, tdidf, ntdidf): words of sequences where ``focal`` is a substitute, against all."""
    overall = occurrences(t, times=times).withColumnRenamed("freq", "occ_all").where("occ_all > 0")
    j = occurrences(t, times=times, context=[focal]).withColumnRenamed("freq", "occ").join(overall, "token_id")
    total = j.agg(F.sum("occ_all").alias("_all"))
    j = j.join(F.broadcast(total), F.lit(True)).withColumn("tdn", 100 * F.col("occ") / F.col("occ_all")).withColumn("idf", F.col("_all") / F.col("occ_all"))
    return j.withColumn("tdidf", F.col("occ") * F.ln("idf")).withColumn("ntdidf", F.col("tdn") * F.ln("idf")).drop("_all")


def words_per_year(t: DataFrame) -> DataFrame:
    return t.groupBy("time").agg(F.count_distinct("run_index", "pos").alias("n_words"))


def token_years(t: DataFrame, ids, least: int = 50) -> DataFrame:
    """(token_id, time, n, per_100k): places of words by year; words of more than ``least`` places in all."""
    c = t.where(F.col("occ").isin(*ids)).groupBy(F.col("occ").alias("token_id"), "time").agg(F.count_distinct("run_index", "pos").alias("n"))
    c = c.withColumn("_total", F.sum("n").over(Window.partitionBy("token_id"))).where(F.col("_total") > least)
    return c.join(words_per_year(t), "time", "left").select("token_id", "time", "n", (100000 * F.col("n") / F.col("n_words")).alias("per_100k"))


def list_dyads(t: DataFrame, ids) -> DataFrame:
    """(run_index, pos, firm, alters, weight, sentiment): dyads with a listed word at either end."""
    r = t.where("sub <> occ").select("run_index", "pos", "weight", "sentiment", F.explode(F.array(F.struct(F.col("occ").alias("firm"), F.col("sub").alias("alter")), F.struct(F.col("sub").alias("firm"), F.col("occ").alias("alter")))).alias("x"))
    r = r.where(F.col("x.firm").isin(*ids))
    return r.groupBy("run_index", "pos", F.col("x.firm").alias("firm")).agg(F.sort_array(F.collect_list("x.alter")).alias("alters"), F.sum("weight").alias("weight"), F.avg("sentiment").alias("sentiment"))


def position_context(t: DataFrame, occurring=None, replacing=None, times=None, near: bool = False) -> DataFrame:
    """(run_index, pos, q_pos, e, cweight, others): mass of distinct context weights at each place of a dyad; ``near`` as in dyad_context."""
    t = t if near else around(t, occurring, replacing, times, columns=NARROW)
    r = dyads(with_lengths(_joinable(t)), occurring, replacing, times).select("run_index", "time", "pos", "others").distinct()
    q = _context(select_ties(_joinable(t), times), "bidirectional")
    return _by_sequence(r.join(q, _elsewhere()), t, "run_index").groupBy("run_index", "pos", "q_pos", "e", "others").agg(F.sum_distinct("q_weight").alias("cweight"))


def regression_rows(t: DataFrame, clusters: DataFrame, occurring=None, replacing=None, times=None, names: list[str] | None = None) -> DataFrame:
    """One row per dyad occurrence; a column per cluster: mean of cweight * 40 / others * rweight * 100 over its words."""
    t = around(t, occurring, replacing, times, columns=(*NARROW, "sentiment", "subjectivity"))
    c = position_context(t, occurring, replacing, times, near=True).join(clusters.select(F.col("token_id").alias("e"), "cluster"), "e")
    r = dyads(t, occurring, replacing, times).groupBy("run_index", "pos", "sub", "occ").agg(F.max("weight").alias("rweight"), F.max("sentiment").alias("tsent"), F.max("subjectivity").alias("tsub"))
    j = r.join(c, ["run_index", "pos"]).withColumn("x", F.col("cweight") * 40 / F.col("others") * F.col("rweight") * 100)
    return j.groupBy("run_index", "pos", "sub", "occ", "rweight", "tsent", "tsub").pivot("cluster", names).agg(F.avg("x")).fillna(0.0)


def top_k(rows: DataFrame, by: list[str], value: str, k: int, tie: list[str]) -> DataFrame:
    """The ``k`` largest of each group, ties in the order of ``tie``; Spark cuts groups before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.col(value).desc(), *tie)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def moving_windows(years: DataFrame, before: int, after: int) -> DataFrame:
    """(year, window): each year belongs to the windows of the years around it, cut at both ends."""
    own = years.select(F.col("time").alias("window")).distinct()
    ends = own.agg(F.min("window").alias("lo"), F.max("window").alias("hi"))
    all_ = own.join(F.broadcast(ends), F.lit(True))
    span = F.sequence(F.greatest(F.col("lo"), F.col("window") - before), F.least(F.col("hi"), F.col("window") + after))
    return all_.select("window", F.explode(span).alias("year"))
