"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are fused as log-likelihoods for each language: the
text (hashed byte trigrams, tempered), the language that the markup declares,
the language that the address names (first path segment or top-level domain),
and the prior of the host.  Host priors come from grouped sums of the pages'
posteriors without a prior, smoothed towards the domain's, and these towards
the corpus's; a page's own vote is taken out of its host's sum.

The text model is learnt from at most ``PER_LANG`` documents of each language
(picked by a hash of id and text), so a rare language is learnt like a frequent
one; all else covers all pages.  The model has one row of ``BUCKETS`` numbers
for each language of the documents.

Defined results: without text, declaration, address or neighbours a page has
the corpus's prior; null urls share an empty host; repeated rows vote and are
answered each; without any learnt language every page has a null language and
confidence; ties go to the language that comes first in the alphabet; without
pages there are no rows; texts of any length are read whole; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import Scratch, dealt_join, lookup_side
from .urls import host_of, path_of

BUCKETS, PER_LANG = 1 << 14, 500
#: Trigrams count as this many independent ones at most.
TEMPER = 40.0
#: How often a declaration and an address name the right language.
P_DECLARED, P_ADDRESS = 0.9, 0.85
#: Votes that a domain's prior weighs in a host's, and the corpus's in a domain's.
KAPPA_HOST, KAPPA_DOMAIN = 10.0, 50.0


def trigrams(text: str | None) -> np.ndarray:
    """Counts of hashed trigrams of lower-case UTF-8 bytes, white space as one blank."""
    raw = b" ".join((text or "").lower().encode("utf-8", "surrogatepass").split())
    if len(raw) < 3:
        return np.zeros(BUCKETS, np.int64)
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(18)
    return np.bincount(h, minlength=BUCKETS)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, t in zip(b["lang"], b["text"]):
            sums[lang] = sums.get(lang, 0) + trigrams(t)
    if sums:
        yield pd.DataFrame({"lang": list(sums), "n": [v.astype(np.int64).tobytes() for v in sums.values()]})


def train(docs: DataFrame, text: str = "text", lang: str = "lang", id_: str = "doc_id", per_lang: int = PER_LANG) -> tuple[list[str], np.ndarray]:
    """All languages of the documents and their log-probabilities of trigrams.

    Documents are picked by keys alone: those with the least hashes of a
    language, below a bound that its number of documents gives, so a language
    that has a third of all rows isn't sorted in one task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.lower(F.trim(lang)).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(id_), F.col(text)).alias("_k"))
    rows = rows.where("lang is not null and lang <> '' and text is not null")
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("_k", 0.05).alias("n")).collect()  # one row per language, as the model has
    if not sizes:
        return [], np.empty((0, BUCKETS), np.float32)
    most = [(r.lang, (1 << 63) - 1 if r.n <= 4 * per_lang else int((1 << 64) * 2 * per_lang / r.n) - (1 << 63)) for r in sizes]
    bound = F.broadcast(spark.createDataFrame(most, "lang string, _most long"))
    keys = rows.select("lang", "_k").join(bound, "lang").where(F.col("_k") <= F.col("_most")).select("lang", "_k").distinct()
    first = F.row_number().over(Window.partitionBy("lang").orderBy("_k"))
    picked = keys.withColumn("_r", first).where(F.col("_r") <= per_lang).select(F.col("lang").alias("_lang"), F.col("_k").alias("_key"))
    picked = Scratch(spark, "langid").keep(picked)
    mine = rows.join(lookup_side(picked), (F.col("lang") == F.col("_lang")) & (F.col("_k") == F.col("_key"))).groupBy("lang", "_k").agg(F.first("text").alias("text"))
    counted = mine.repartition("lang", F.pmod("_k", F.lit(4))).select("lang", "text").mapInPandas(_counts, "lang string, n binary")
    sums: dict[str, np.ndarray] = {}
    for r in counted.collect():  # four rows of BUCKETS numbers per language
        sums[r.lang] = sums.get(r.lang, 0) + np.frombuffer(bytes(r.n), np.int64)
    langs = sorted(sums)
    logp = [np.log((sums[k] + 0.1) / (sums[k] + 0.1).sum()) for k in langs]
    return langs, np.array(logp, np.float32).reshape(len(langs), BUCKETS)


def _text_evidence(docs: DataFrame, langs: list[str], logp: np.ndarray):
    held = docs.sparkSession.sparkContext.broadcast(logp)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            out = []
            for t in b:
                c = trigrams(t)
                n = c.sum()
                out.append((held.value @ c * (min(n, TEMPER) / max(n, 1))).astype(float).tolist())
            yield pd.Series(out)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<double>")


def visible_text(html: Column) -> Column:
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return F.regexp_replace(t, r"<[^>]*+>", " ")


def declared_lang(html: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1))


def address_lang(host: Column, path: Column, names: Column) -> Column:
    """The language named by the first path segment, or else by the top-level domain."""
    first = F.lower(F.regexp_extract(path, r"^/([A-Za-z]{2,3})(?:[-_/]|$)", 1))
    top = F.regexp_extract(host, r"\.([a-z]{2,3})$", 1)
    return F.when(F.array_contains(names, first), first).when(F.array_contains(names, top), top).otherwise("")


def _named(value: Column, p: float, names: Column, n: int) -> Column:
    """Log-likelihoods of a named language; none if it isn't a known one."""
    hit, miss = float(np.log(p)), float(np.log((1 - p) / max(1, n - 1)))
    known = F.array_contains(names, value)
    return F.transform(names, lambda k: F.when(~known, 0.0).when(k == value, hit).otherwise(miss))


def _posterior(logs: Column) -> Column:
    e = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def identify(pages: DataFrame, docs: DataFrame, id_: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: id, host, declared, address, text_lang, lang, confidence."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "langid")
    langs, logp = train(docs)
    n = len(langs)
    names = F.array(*(F.lit(k) for k in langs)).cast("array<string>")
    if not langs:
        unknown = [F.lit(None).cast("string").alias(c) for c in ("text_lang", "lang")]
        return pages.select(F.col(id_), host_of(F.col(url)).alias("host"), declared_lang(F.col(html)).alias("declared"), F.lit("").alias("address"), *unknown, F.lit(None).cast("double").alias("confidence"))
    rows = pages.select(
        F.col(id_).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"),
        declared_lang(F.col(html)).alias("declared"), _text_evidence(pages, langs, logp)(visible_text(F.col(html))).alias("by_text"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = rows.withColumn("address", address_lang(F.col("host"), F.col("path"), names))
    fused = _plus(_plus(F.col("by_text"), _named(F.col("declared"), P_DECLARED, names, n)), _named(F.col("address"), P_ADDRESS, names, n))
    rows = scratch.keep(rows.drop("path").withColumn("logs", fused).withColumn("vote", _posterior(F.col("logs"))))
    sums = [F.sum(F.col("vote")[k]) for k in range(n)]
    hosts = scratch.keep(rows.groupBy("host").agg(F.array(*sums).alias("h_votes")).withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)))
    domains = scratch.keep(hosts.groupBy("domain").agg(F.array(*(F.sum(F.col("h_votes")[k]) for k in range(n))).alias("d_votes")))
    # one row, as wide as there are languages: its sums become constants
    corpus = [c or 0.0 for c in domains.agg(*(F.sum(F.col("d_votes")[k]) for k in range(n))).first()]
    c_prior = F.array(*(F.lit((c + 1) / (sum(corpus) + n)) for c in corpus))
    whole = F.aggregate("d_votes", F.lit(0.0), lambda a, x: a + x)
    d = domains.select("domain", F.zip_with("d_votes", c_prior, lambda o, u: (o + KAPPA_DOMAIN * u) / (whole + KAPPA_DOMAIN)).alias("d_prior"))
    # a domain may have very many hosts, and a host very many pages; what is broadcast counts its languages
    h = dealt_join(hosts, d, ["domain"], F.col("host"), rows=domains.n_rows * n // 16).select("host", "h_votes", "d_prior")
    out = dealt_join(rows, h, ["host"], F.col("row"), rows=hosts.n_rows * n // 16)
    # the others' votes at this host, towards the domain
    rest = F.zip_with("h_votes", "vote", lambda a, b: F.greatest(F.lit(0.0), a - b))
    out = out.withColumn("rest", rest)
    whole_rest = F.aggregate("rest", F.lit(0.0), lambda a, x: a + x)
    prior = F.zip_with("rest", "d_prior", lambda a, p: (a + KAPPA_HOST * p) / (whole_rest + KAPPA_HOST))
    out = out.withColumn("prior", prior).withColumn("final", _posterior(_plus(F.col("logs"), F.transform("prior", lambda p: F.ln(p)))))
    best = lambda c: F.element_at(names, F.array_position(F.col(c), F.array_max(c)).cast("int"))
    return out.select(
        F.col("id").alias(id_), "host", "declared", "address", best("by_text").alias("text_lang"), best("final").alias("lang"), F.array_max("final").alias("confidence")
    )
