"""Quality rules: cross-document line frequency.

Lines are normalised and hashed; the distinct documents that carry a line are
counted per host; lines above the limits are boilerplate and are removed; a
document that loses more than half of its words is rejected.

Defined results: a null or empty text has no words and fails the base rules; a
null host is a host of its own; a text that is repeated word for word counts
as one document however many rows carry it (copies are near-dedup's business,
and must not make each other's lines look like boilerplate); repeated rows
each get a row; an empty table gives no rows; texts of any length are read whole;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Scratch, let, salted_join, total, words

WIDTH = 5
#: A line is boilerplate if more than MAX_DOCS documents of its host carry it, and more than MAX_SHARE of them or than MANY.
MAX_DOCS, MAX_SHARE, MANY = 20, 0.01, 300
#: A document is depleted if boilerplate has more than this share of its words.
MAX_LOST = 0.5


def repeated_words(text_words: Column, width: int = WIDTH) -> Column:
    """Words that lie in a window of ``width`` words found twice or more in the text."""

    def windows(h):
        return F.transform(
            F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(width)))
        )

    def covered(starts):
        step = F.transform(starts, lambda p, j: F.least(F.lit(width), F.coalesce(F.get(starts, j + 1) - p, F.lit(width))))
        return total(step)

    def repeats(v):
        by_hash = F.sort_array(F.transform(v, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        starts = let(
            by_hash,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(
                        s,
                        lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))
                        | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)),
                    ),
                    lambda x: x["p"],
                )
            ),
        )
        return F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0).cast("long")).otherwise(let(starts, covered))

    hashes = F.transform(text_words, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: F.when(F.size(h) <= width, F.lit(0).cast("long")).otherwise(let(windows(h), repeats)))


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    squeezed = F.translate(t, " \t\n\x0b\f\r", "")
    full = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)
    both = let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    return (
        docs.withColumn("_both", both)
        .withColumn("n_words", F.col("_both.n"))
        .withColumn("word_chars", F.length(squeezed).cast("long"))
        .withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"))
        .withColumn("n_dup_lines", let(full, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long")))
        .withColumn("n_repeat_words", F.col("_both.r"))
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
        .drop("_both")
    )


def line_structs(text: Column) -> Column:
    """array<struct<hash, n>>: each line with a word, normalised and hashed, and its words.

    Normalising lower-cases, squeezes white space and writes any run of digits as 0.
    """
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[0-9]+", "0")
    t = F.regexp_replace(t, r"[\x20\x09\x0B-\x0D]+", " ")
    lines = F.filter(F.transform(F.split(t, "\n", -1), F.trim), lambda x: x != "")
    return F.transform(
        lines,
        lambda x: F.struct(
            F.xxhash64(x).alias("hash"), (F.length(x) - F.length(F.translate(x, " ", "")) + 1).cast("long").alias("n")
        ),
    )


def lines_of(docs: DataFrame, keys: list[Column], text: str = "text", host: str = "source") -> DataFrame:
    """(host, keys, at, line, n): every line of every document, once read; a kept table of hashes and counts."""
    names = [f"_k{i}" for i in range(len(keys))]
    rows = docs.select(F.col(host).alias("host"), *(k.alias(n) for k, n in zip(keys, names)), F.posexplode(line_structs(F.col(text))).alias("at", "x"))
    return Scratch(docs.sparkSession, "lines").keep(rows.select("host", *names, "at", F.col("x.hash").alias("line"), F.col("x.n").alias("n")))


def common_lines(lines: DataFrame, docs: DataFrame, text: str = "text", host: str = "source", max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, many: int = MANY) -> DataFrame:
    """(host, line): the hashes of lines above the limits. Counts are over all documents, told apart by the last key, the hash of their text."""
    counts = lines.groupBy("host", "line").agg(F.count_distinct(lines["_k1"]).alias("n")).where(F.col("n") > max_docs)
    t = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    hosts = docs.select(F.col(host).alias("host"), t.alias("doc")).groupBy("host").agg(F.count_distinct("doc").alias("of"))
    near = salted_join(counts, hosts, ["host"], F.col("line"))
    return near.where((F.col("n") > max_share * F.col("of")) | (F.col("n") > many)).select("host", "line")


def lost_words(docs: DataFrame, keys: list[Column], text: str = "text", host: str = "source", **limits) -> DataFrame:
    """(host, keys, lost, lines): per distinct document with boilerplate, its words and the hashes of these lines.

    The host is part of the key: boilerplate is a property of a line at a host.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    rows = lines_of(docs, keys, text, host)
    hit = salted_join(rows, common_lines(rows, docs, text, host, **limits), ["host", "line"], F.struct(*names))
    # each line of a document is there once for each repeated row of it
    once = F.size(F.collect_set("at")) / F.count("*")
    return hit.groupBy("host", *names).agg(F.round(F.sum("n") * once).cast("long").alias("lost"), F.collect_set("line").alias("lines"))


def keyed(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> list[Column]:
    """What tells documents apart: the id, and the text for ids that are null or repeated."""
    return [F.col(id_), F.xxhash64(F.coalesce(F.col(text), F.lit("")))]


def line_frequency_rules(docs: DataFrame, text: str = "text", host: str = "source", id_: str = "doc_id", max_lost: float = MAX_LOST, **limits) -> DataFrame:
    """One row per document: id, base counts, lost_words (words on boilerplate lines), kept."""
    keys = keyed(docs, text, id_)
    mine = base_rules(docs.select(F.col(id_), F.col(host).alias("_host"), F.col(text).alias(text), *(k.alias(f"_m{i}") for i, k in enumerate(keys))), text).drop(text)
    lost = lost_words(docs, keys, text, host, **limits).drop("lines")
    on = mine["_host"].eqNullSafe(lost["host"])
    for i in range(len(keys)):
        on = on & mine[f"_m{i}"].eqNullSafe(lost[f"_k{i}"])
    out = mine.join(lost, on, "left").withColumn("lost_words", F.coalesce(F.col("lost"), F.lit(0)).cast("long"))
    depleted = F.col("lost_words") > max_lost * F.col("n_words")
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).select(
        id_, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_words", "kept"
    )


def strip_common_lines(docs: DataFrame, text: str = "text", host: str = "source", id_: str = "doc_id", **limits) -> DataFrame:
    """The documents with boilerplate lines cut from their texts; all other columns stay."""
    keys = keyed(docs, text, id_)
    lost = lost_words(docs, keys, text, host, **limits)
    lost = lost.select(F.col("host").alias("_lf_host"), F.col("_k0").alias("_lf_0"), F.col("_k1").alias("_lf_1"), F.col("lines").alias("_lf_lines"))
    on = docs[host].eqNullSafe(lost["_lf_host"])
    for i, k in enumerate(keys):
        on = on & k.eqNullSafe(lost[f"_lf_{i}"])
    lines = F.split(F.col(text), "\n", -1)

    def normal(x):
        return F.xxhash64(F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "[0-9]+", "0"), r"[\x20\x09\x0B-\x0D]+", " ")))

    cut = F.array_join(F.filter(lines, lambda x: ~F.array_contains(F.col("_lf_lines"), normal(x))), "\n")
    out = docs.join(lost, on, "left")
    return out.withColumn(text, F.when(F.col("_lf_lines").isNull(), F.col(text)).otherwise(cut)).select(*docs.columns)
