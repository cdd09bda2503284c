"""Personal data: patterns, and information-theoretic sanitisation.

Emails, IP addresses, card and phone numbers are found by pattern and
validated; long runs of letters and digits that carry as much information as a
random key are found by their entropy and count as secrets.  These are the
protected entities, each on three levels: its value, the domain of an email,
and its kind.  A word of a text that holds an entity discloses it to the degree

    1 + ln p(entity | word) / -ln p(entity)

the share of the entity's information that the word gives away (1: whoever
sees the word knows the entity), estimated over all texts of the corpus with
one text's weight on p(entity).  Words that do so in at least ``SUPPORT`` texts
are spans of kind ``term``: above ``GENERALISE`` they are replaced with a
placeholder, above ``REMOVE`` they are removed, wherever they occur.

Defined results: a null text is empty and has no spans; copies of a text count
as one text; repeated rows get a row each; offsets are code points; matches
that fail validation are dropped and not retried; a word is a run of letters,
digits and inner hyphens or apostrophes of any length, at any distance from the
entity, and pieces of an entity are no words; an empty table gives no rows; texts
of any length are read whole; other columns stay as they are in
``sanitise``, whatever their names, and are ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Scratch, bounded_side, dealt_join, let, total

KINDS = ("email", "ip", "card", "phone")
# The contract's patterns. Possessive quantifiers and the look-behinds only take
# away attempts that can't match, so long runs cost linear time and no stack.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+",
}
#: Needed for a match at all; spares most texts the scan.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "secret": None}
#: What the method protects: the contract's kinds, and secrets.
PROTECTED = (*KINDS, "secret")
#: Bits per character and digits from which a run of 20 characters is a key and no word or name.
ENTROPY, KEY_DIGITS = 3.0, 4
SUPPORT, GENERALISE, REMOVE = 3, 0.9, 0.97
#: What separates words.
APART = r"[^\p{L}\p{N}'\u2019-]+"
_SPAN = "array<struct<s:int,e:int,v:string>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    r = F.reverse(digits)

    def worth(i: Column) -> Column:
        d = r.substr(i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return total(F.transform(F.sequence(F.lit(1), F.length(digits)), worth)) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
        return v.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        n = F.length(_digits(v))
        return F.when((n >= 13) & (n <= 19), luhn(_digits(v))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(v)).between(9, 15)
    if kind == "secret":
        digits = F.length(_digits(v))
        return (digits >= KEY_DIGITS) & (digits < F.length(v)) & (entropy(v) >= ENTROPY)
    return F.lit(True)


def entropy(v: Column) -> Column:
    """Bits per character of a string's own distribution of characters."""
    n = F.length(v).cast("double")
    chars = F.array_distinct(F.split(v, ""))
    return F.aggregate(
        F.transform(chars, lambda c: F.when(c == "", 0.0).otherwise((n - F.length(F.replace(v, c, F.lit("")))) / n)), F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    )


def located(text: Column, pattern: Column) -> Column:
    """array<struct<s, e, v>>: all matches with offsets; what lies between them gives the offsets."""
    found, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)

    def place(both: Column) -> Column:
        sizes = F.transform(both["f"], lambda m, i: F.length(F.get(both["g"], i)) + F.length(m))
        ends = F.aggregate(sizes, F.array().cast("array<int>"), lambda a, n: F.concat(a, F.array(n + F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)))))
        return let(ends, lambda e: F.transform(both["f"], lambda m, i: F.struct((F.get(e, i) - F.length(m)).alias("s"), F.get(e, i).alias("e"), m.alias("v"))))

    return let(F.struct(found.alias("f"), gaps.alias("g")), place)


def base_spans(text: Column, kind: str) -> Column:
    t = F.coalesce(text, F.lit(""))
    need = F.contains(t, F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True)
    there = need & t.rlike(PATTERNS[kind])
    return F.when(there, F.filter(located(t, F.lit(PATTERNS[kind])), lambda x: _valid(kind, x["v"]))).otherwise(F.array().cast(_SPAN))


def with_spans(docs: DataFrame, text: str, kinds: tuple[str, ...] = PROTECTED) -> DataFrame:
    """Add a column of spans for each kind, named ``_pii_`` and the kind."""
    return docs.select("*", *(base_spans(F.col(text), k).alias(f"_pii_{k}") for k in kinds))


def tokens(text: Column) -> Column:
    """The distinct words of a text in lower case, without marks at their ends."""
    bare = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), APART, -1), lambda w: F.regexp_replace(w, r"^['\u2019-]++|['\u2019-]++$", ""))
    return F.array_remove(F.array_distinct(bare), "")


def cut_out(text: Column, spans: Column) -> Column:
    """The text with ``spans`` (array<struct<s, e, r>>) replaced by their r; one inside another goes with that one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        before = F.when(x["s"] > a["at"], text.substr(a["at"] + 1, x["s"] - a["at"])).otherwise("")
        put = F.when(x["s"] >= a["at"], x["r"]).otherwise("")
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.concat(a["out"], before, put).alias("out"))

    return F.aggregate(F.sort_array(spans), start, step, lambda a: F.concat(a["out"], text.substr(a["at"] + 1, F.length(text))))


def _replaced(kind: str, by) -> Column:
    return F.transform(f"_pii_{kind}", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), by(x).alias("r")))


def _entities(kind: str) -> Column:
    """Hashes of the protected entities of a kind: every value, its domain and the kind."""
    each = F.transform(f"_pii_{kind}", lambda x: F.xxhash64(F.lit(kind), F.lower(x["v"])))
    if kind == "email":
        each = F.concat(each, F.transform(f"_pii_{kind}", lambda x: F.xxhash64(F.lit("domain"), F.lower(F.regexp_extract(x["v"], "@(.*)$", 1)))))
    return F.when(F.size(f"_pii_{kind}") > 0, F.concat(each, F.array(F.xxhash64(F.lit("kind"), F.lit(kind))))).otherwise(F.array().cast("array<bigint>"))


def disclosing_terms(docs: DataFrame, scratch: Scratch, text: str = "text", support: int = SUPPORT, least: float = GENERALISE) -> tuple[DataFrame, DataFrame]:
    """(term, disclosure) above ``least``, and (text_hash, term, disclosure): the texts that have such a term."""
    mine = docs.select(F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash")).where("text is not null")
    n = float(mine.agg(F.count_distinct("text_hash")).first()[0])
    # the texts with entities: their words, and the entities that enough of them share
    blank = F.concat(*(_replaced(k, lambda x: F.lit(" ")) for k in PROTECTED))
    found = with_spans(mine, "text").where(" or ".join(f"size(_pii_{k}) > 0" for k in PROTECTED))
    found = found.select("text_hash", tokens(cut_out(F.col("text"), blank)).alias("terms"), F.array_distinct(F.concat(*(_entities(k) for k in PROTECTED))).alias("ents"))
    found = scratch.keep(found.dropDuplicates(["text_hash"]))
    occ = found.select("text_hash", F.explode("ents").alias("entity"))
    ents = scratch.keep(occ.groupBy("entity").agg(F.count("*").alias("de")).where(F.col("de") >= support))
    shared = dealt_join(occ, ents, ["entity"], F.col("text_hash"), rows=ents.n_rows).groupBy("text_hash").agg(F.collect_list("entity").alias("shared"))
    of = found.select("text_hash", "terms").join(shared, "text_hash").select("shared", F.explode("terms").alias("term"))
    pairs = of.select("term", F.explode("shared").alias("entity")).groupBy("entity", "term").agg(F.count("*").alias("both")).where(F.col("both") >= support)

    def rate(df: str) -> Column:
        p = F.least(F.lit(0.5), F.col("de") / F.lit(max(n, 1.0)))
        return 1 + F.ln((F.col("both") + p) / (F.col(df) + 1)) / -F.ln(p)

    # texts with any entity that have the term are some of all that have it: a term below the threshold
    # against these alone is below it against all, and needn't be counted over the corpus
    some = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("some")).where(F.col("some") >= support)
    some = scratch.keep(some)
    near = dealt_join(dealt_join(pairs, ents, ["entity"], F.col("term"), rows=ents.n_rows), some, ["term"], F.col("entity"))
    candidates = scratch.keep(near.where(rate("some") >= least).select("term", "both", "de"))
    terms = scratch.keep(candidates.select("term").distinct())
    if not terms.n_rows:
        return terms.select("term", F.lit(0.0).alias("disclosure")), mine.limit(0).select("text_hash", F.lit("").alias("term"), F.lit(0.0).alias("disclosure"))
    have = mine.select("text_hash", F.explode(tokens(F.col("text"))).alias("term"))
    have = scratch.keep(have.join(bounded_side(terms), "term", "left_semi").distinct())
    df = scratch.keep(have.groupBy("term").agg(F.count("*").alias("df")))
    # a term's pairs are the entities it may disclose; the strongest counts
    scored = candidates.join(bounded_side(df), "term").groupBy("term").agg(F.max(rate("df")).alias("disclosure"))
    scored = scratch.keep(scored.where(F.col("disclosure") >= least))
    return scored, have.join(bounded_side(scored), "term").select("text_hash", "term", "disclosure")


def _term_pattern(terms: Column) -> Column:
    """A pattern that finds the terms as whole words, the longest first."""
    longest = F.transform(F.array_sort(F.transform(terms, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: F.regexp_replace(x["w"], r"([^\p{L}\p{N}])", r"\\$1"))
    return F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}\p{N}])"))


def find(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with a ``_pii_`` column of spans for each kind and for ``term``, and ``_pii_remove``, the terms to remove."""
    scratch = Scratch(rows.sparkSession, "pii")
    _, hits = disclosing_terms(rows, scratch, text)
    # terms of one text: bounded by its words
    per_text = hits.groupBy(F.col("text_hash").alias("_pii_hash")).agg(
        F.sort_array(F.collect_set("term")).alias("_pii_terms"), F.collect_set(F.when(F.col("disclosure") >= REMOVE, F.col("term"))).alias("_pii_remove")
    )
    per_text = scratch.keep(per_text)
    if per_text.n_rows:
        out = rows.join(bounded_side(per_text), F.xxhash64(F.col(text)) == F.col("_pii_hash"), "left")
    else:
        none = F.lit(None).cast("array<string>")
        out = rows.withColumn("_pii_terms", none).withColumn("_pii_remove", none)
    out = with_spans(out, text)
    t = F.coalesce(F.col(text), F.lit(""))
    return out.withColumn("_pii_term", F.when(F.col("_pii_terms").isNull(), F.array().cast(_SPAN)).otherwise(located(t, _term_pattern(F.col("_pii_terms")))))


def _listed(kinds: tuple[str, ...]) -> Column:
    def one(kind: str) -> Column:
        return F.transform(f"_pii_{kind}", lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))

    return F.array_join(F.concat(*(one(k) for k in kinds)), ",")


def report(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """One row per document: id, counts, digest of the base spans, and all spans."""
    f = find(docs.select(F.col(id_).alias("_pii_id"), F.col(text).alias("_pii_text")), "_pii_text")
    return f.select(
        F.col("_pii_id").alias(id_), *(F.size(f"_pii_{k}").cast("long").alias(f"n_{k}") for k in (*PROTECTED, "term")),
        F.sha2(_listed(KINDS).cast("binary"), 256).alias("base_sha256"), _listed((*PROTECTED, "term")).alias("spans"),
    )


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; terms above REMOVE are cut."""
    f = find(docs.select(F.struct(*docs.columns).alias("_pii_row"), F.col(text).alias("_pii_text")), "_pii_text")
    t = F.col("_pii_text")
    removed = lambda x: F.when(F.array_contains("_pii_remove", F.lower(x["v"])), "").otherwise("<TERM>")
    spans = F.concat(*(_replaced(k, lambda x, k=k: F.lit(f"<{k.upper()}>")) for k in PROTECTED), _replaced("term", removed))
    f = f.withColumn("_pii_clean", F.when(F.size(spans) > 0, cut_out(t, spans)).otherwise(t))
    return f.select(*(F.col("_pii_clean").alias(c) if c == text else F.col("_pii_row")[c].alias(c) for c in docs.columns))
