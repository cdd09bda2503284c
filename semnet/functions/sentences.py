"""Sentences, with abbreviations learnt from the texts themselves.

The unsupervised method of Kiss and Strunk (2006).  A word is an abbreviation
if it has a final period more often than chance and is short; words that
follow sure ends of sentences more often than chance start sentences; words
that follow an abbreviation, a number or an initial more often than chance
belong to it.  All three are log-likelihood ratios of counts, so learning is a
few grouped aggregations over the corpus, and what is learnt are small tables
that can be written and used for other texts.

A period ends a sentence unless it belongs to an abbreviation, an initial or a
number; after one of these only if the next word is written with a capital,
doesn't belong to it, and either starts sentences or is elsewhere written
small (for an initial only the former).  ``!`` and ``?`` always end one, two
periods or more do before a capital.  Sentences keep their characters, without
the white space around them; a null or blank text has none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import kept

#: Least scores, as published.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
# fixed values: marks that may stand before and after a word
BEFORE, AFTER = "[\"'“‘„«(\\[]+", "[\"'”’»)\\],;:]+"
BLANK = "[\\x09-\\x0D\\x20]"
NUMBER = "#"


def pieces(text: Column) -> Column:
    """Words, each with the white space after it."""
    return F.regexp_extract_all(text, F.lit("[^\\x09-\\x0D\\x20]+[\\x09-\\x0D\\x20]*"), F.lit(0))


def _token(piece: Column) -> Column:
    """(type, mark, up, low): the word as it is counted, its final marks, and whether it is written with a capital or small."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(piece, f"{BLANK}+$", ""), f"^{BEFORE}", ""), f"{AFTER}$", "")

    def parts(x: Column) -> Column:
        word = x["word"]
        return F.struct(
            F.when(word.rlike("^[0-9][0-9.,]*$"), NUMBER).otherwise(F.lower(word)).alias("type"), F.regexp_extract(x["bare"], "[.!?]+$", 0).alias("mark"),
            word.rlike("^\\p{Lu}").alias("up"), word.rlike("^\\p{Ll}").alias("low"),
        )

    # a lambda's variable is evaluated once, an expression wherever it is named
    both = F.transform(F.array(bare), lambda x: F.struct(x.alias("bare"), F.regexp_replace(x, "[,;:.!?]+$", "").alias("word")))
    return F.transform(both, parts)[0]


def _tokens(rows: DataFrame, text: str) -> DataFrame:
    """(_row, pos, type, mark, up, low, next): a row per word; ``next`` is the word after it, null at the end."""
    toks = F.transform(pieces(F.col(text)), _token)
    listed = rows.select("_row", toks.alias("t"))
    return listed.select("_row", F.posexplode(F.arrays_zip(F.col("t").alias("w"), F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))).alias("next"))).alias("pos", "_z")).select("_row", "pos", "_z.w.*", "_z.next")


def _ln(n: Column, p: Column) -> Column:
    """n * ln(p), 0 for n = 0."""
    return F.when(n == 0, 0.0).otherwise(n * F.ln(p))


def together(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """Log-likelihood ratio of ``ab`` joint occurrences of what occurs ``a`` and ``b`` times among ``n``."""
    p, p1, p2 = b / n, ab / a, (b - ab) / (n - a)
    alone = _ln(ab, p) + _ln(a - ab, 1 - p) + _ln(b - ab, p) + _ln(n - a - b + ab, 1 - p)
    bound = _ln(ab, p1) + _ln(a - ab, 1 - p1) + _ln(b - ab, p2) + _ln(n - a - b + ab, 1 - p2)
    return -2 * (alone - bound)


def _initial(type_: Column) -> Column:
    return type_.rlike("^\\p{L}$")


@dataclass(frozen=True)
class Boundaries:
    """What was learnt: types (type, n, with_period, small), abbreviations (type, score), starters (type, score), collocations (type, next, score)."""

    types: DataFrame
    abbreviations: DataFrame
    starters: DataFrame
    collocations: DataFrame


def learn(rows: DataFrame, text: str) -> Boundaries:
    t = _tokens(rows.withColumn("_row", F.lit(0)), text)
    follows = F.when((F.col("mark") != "") & (F.col("next.type") != ""), F.col("next.type")).alias("next")
    seen = kept(t.groupBy("type", "mark", "low", follows).agg(F.count("*").alias("ab")), "seen")  # the words are gone through once
    types = kept(seen.where("type <> ''").groupBy("type").agg(F.sum("ab").alias("n"), *(F.sum(F.when(c, F.col("ab")).otherwise(0)).alias(k) for k, c in (("with_period", F.col("mark") == "."), ("small", F.col("low"))))), "types")
    whole = F.broadcast(types.agg(F.sum("n").alias("all_words"), F.sum("with_period").alias("all_points")))  # one row

    n, k = F.col("n"), F.col("with_period")
    p = F.col("all_points") / F.col("all_words")
    likely = -2 * (_ln(k, p) + _ln(n - k, 1 - p) - k * F.ln(F.lit(0.99)) - (n - k) * F.ln(F.lit(0.01)))
    dots = F.length("type") - F.length(F.replace(F.col("type"), F.lit("."), F.lit("")))
    size = F.length("type") - dots
    score = likely * F.exp(-size) * (dots + 1) * F.pow(size.cast("double"), -(n - k).cast("double"))
    some = types.where((k > 0) & F.col("type").rlike("\\p{L}") & (size > 0)).join(whole, F.lit(True))
    abbreviations = kept(some.select("type", score.alias("score")).where(F.col("score") >= ABBREVIATION), "abbreviations")

    after = kept(seen.where("next is not null").groupBy("type", "mark", "next").agg(F.sum("ab").alias("ab")), "followers")
    known = after.join(abbreviations.select("type", F.lit(True).alias("short")), "type", "left").withColumn("short", F.col("short").isNotNull() | (F.col("type") == NUMBER) | _initial(F.col("type")))
    sure = known.where(F.col("mark").rlike("[!?]") | ((F.col("mark") == ".") & ~F.col("short")))
    ends = F.broadcast(sure.agg(F.sum("ab").alias("all_ends")))
    count = types.select(F.col("type").alias("next"), F.col("n").alias("b"))
    s = sure.groupBy("next").agg(F.sum("ab").alias("ab")).join(count, "next").join(ends, F.lit(True)).join(whole, F.lit(True))
    s = s.withColumn("score", together(F.col("all_ends"), F.col("b"), F.col("ab"), F.col("all_words"))).where((F.col("score") >= STARTER) & (F.col("ab") / F.col("all_ends") > F.col("b") / F.col("all_words")) & F.col("next").rlike("^\\p{L}"))
    starters = kept(s.select(F.col("next").alias("type"), "score"), "starters")

    c = known.where((F.col("mark") == ".") & F.col("short") & (F.col("ab") > 1)).join(types.select("type", F.col("n").alias("a")), "type").join(count, "next").join(whole, F.lit(True))
    c = c.withColumn("score", together(F.col("a"), F.col("b"), F.col("ab"), F.col("all_words"))).where((F.col("score") >= COLLOCATION) & (F.col("ab") / F.col("a") > F.col("b") / F.col("all_words")))
    c = c.join(starters.select(F.col("type").alias("next")), "next", "left_anti")
    return Boundaries(types, abbreviations, starters, kept(c.select("type", "next", "score"), "collocations"))


def ends(tokens: DataFrame, known: Boundaries) -> DataFrame:
    """(_row, pos) of the words that end a sentence, the last one of a text aside."""
    t = tokens.where("next is not null and mark <> ''").select("_row", "pos", "type", "mark", F.col("next.type").alias("next"), F.col("next.up").alias("up"))
    short = known.abbreviations.select("type", F.lit(True).alias("short"))
    first = known.starters.select(F.col("type").alias("next"), F.lit(True).alias("first"))
    small = known.types.where("small > 0").select(F.col("type").alias("next"), F.lit(True).alias("small"))
    bound = known.collocations.select("type", "next", F.lit(True).alias("bound"))
    # few words with a mark are abbreviations, numbers or initials: only these are looked up further
    plain = t.join(short, "type", "left").withColumn("open", (F.col("mark") == ".") & (F.col("short").isNotNull() | (F.col("type") == NUMBER) | _initial(F.col("type"))))
    sure = plain.where(~F.col("open") & (F.col("mark").rlike("[!?]") | (F.col("mark") == ".") | F.col("up"))).select("_row", "pos")
    asked = plain.where(F.col("open") & F.col("up")).join(first, "next", "left").join(small, "next", "left").join(bound, ["type", "next"], "left")
    starts = F.col("first").isNotNull() | (F.col("small").isNotNull() & ~(_initial(F.col("type")) & F.col("short").isNull()))
    return sure.union(asked.where(F.col("bound").isNull() & starts).select("_row", "pos"))


def split(rows: DataFrame, text: str, known: Boundaries | None = None, sentence: str = "sentence") -> DataFrame:
    """A row per sentence: the columns of ``rows``, ``index`` from 0 and the sentence; what isn't given is learnt from ``rows``."""
    known = known or learn(rows, text)
    held = kept(rows.withColumn("_row", F.monotonically_increasing_id()), "texts")
    at = ends(_tokens(held, text), known).groupBy("_row").agg(F.sort_array(F.collect_list("pos")).alias("_ends"))
    p = pieces(F.coalesce(F.col(text), F.lit("")))
    none = F.array().cast("array<int>")

    def cut(whole: Column) -> Column:
        last = F.array_distinct(F.concat(F.coalesce(F.col("_ends"), none), F.array(F.size(whole) - 1)))
        first = F.concat(F.array(F.lit(0)), F.transform(F.slice(last, 1, F.size(last) - 1), lambda x: x + 1))
        return F.zip_with(first, last, lambda a, b: F.regexp_replace(F.array_join(F.slice(whole, a + 1, b - a + 1), ""), f"{BLANK}+$", ""))

    # a lambda's variable is evaluated once, an expression in it for every sentence
    made = held.join(at, "_row", "left").withColumn("_s", F.transform(F.array(p), cut)[0]).where(F.col(text).rlike(f"[^{BLANK[1:]}"))
    return made.select(*(f"`{c}`" for c in rows.columns), F.posexplode("_s").alias("index", sentence))
