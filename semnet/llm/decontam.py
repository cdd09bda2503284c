"""Benchmark decontamination by template canonicalisation.

Texts are canonicalised: symbols are dropped, letters lower-cased, and
numbers, names (capitalised words inside a sentence) and units (after a
number) replaced with typed placeholders.  Windows of canonical tokens are
hashed and looked up among the benchmark's windows, so a question that was
re-parameterised still matches.  Each window is also looked up in its plain
form, lower-cased and without placeholders, so that a verbatim copy in other
letter case, or after words that make a name of its first word, matches too; a
position counts if either form hits.  The values in the slots must correspond
along an alignment: what the item tells apart, the document must not write the
same, and one name or unit of the item must not become two (a number may: 5 and 5
may become 7 and 9).  Of slot pairs that contradict each other the most frequent
one holds (the first of equally frequent ones), and only the windows that contain
another one don't count.  A document is contaminated by an item if it has at least
``COVERAGE`` of the item's windows (excerpts: or ``RUN`` consecutive tokens of
it along one alignment; edited copies: or ``SPREAD`` of its tokens inside
matched windows).

Defined results: null and empty texts have no windows and aren't contaminated;
an item of fewer than ``WIDTH`` tokens is one window of its own length, one of
fewer than ``LEAST`` tokens matches a document of just these tokens; windows with
fewer than half their tokens literal are too general and match in plain form
only, and count for ``COVERAGE`` where an item has no others; repeated rows get a row each;
repeated items count as one item each; an item is known by its id and its text, so
ids that are null or stand for several texts lose none (a null one is listed as
``null``); without documents there are no rows, without items nothing is
contaminated; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import Scratch, bounded_side, let, lookup_side, salted_join, words

WIDTH, LEAST = 8, 4
COVERAGE = 0.4
#: Consecutive tokens of an item, and share of its tokens, that are a match by themselves.
RUN, SPREAD = 13, 2 / 3
#: Benchmark windows that may be broadcast; beyond that the lookup is a shuffled join.
MOST_WINDOWS = 1_000_000

NUM, NAME, UNIT = "\ue001", "\ue002", "\ue003"
# fixed values: units that are recognised after a number
UNITS = (
    "km m cm mm mi mile miles ft feet foot inch inches yard yards kg g mg lb lbs pound pounds ounce ounces oz ton tons l ml liter liters litre litres "
    "gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years usd eur gbp dollar dollars cent "
    "cents euro euros percent kmh mph hz khz mhz ghz kb mb gb tb w kw v a k c f"
).split()


def marked(text: Column) -> Column:
    """The text as tokens and spaces; a placeholder is its mark followed by the value it stands for."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{NUM}{NAME}{UNIT}]", " ")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}\s.,!?]", " ")
    t = F.regexp_replace(t, r"(\p{Lu}(?<=[\p{L}\p{N},]\s{1,3}\p{Lu})\p{Ll}++)(?!\p{L})", f"{NAME}$1")
    t = F.regexp_replace(t, r"([0-9]+(?:[.,][0-9]+)*+)", f" {NUM}$1 ")
    t = F.lower(F.regexp_replace(t, r"(?<![0-9])[.,]|[.,](?![0-9])|[!?]", " "))
    return F.regexp_replace(t, rf"({NUM}[0-9.,]+\s{{1,3}})({'|'.join(UNITS)})(?!\p{{L}})", f"$1{UNIT}$2")


def canonical(tokens: Column) -> Column:
    """Hashes of the tokens, of a placeholder its mark alone."""
    return F.transform(tokens, lambda t: F.xxhash64(F.when(t.substr(1, 1).isin(NUM, NAME, UNIT), t.substr(1, 1)).otherwise(t)))


def plain(tokens: Column) -> Column:
    """Hashes of the tokens themselves: of what a placeholder stands for, without its mark."""
    return F.transform(tokens, lambda t: F.xxhash64(F.translate(t, f"{NUM}{NAME}{UNIT}", "")))


def windows(hashes: Column, width: int, body) -> Column:
    """``body`` of the hashes of all windows of ``width``, by first token; as long as ``hashes``, the last ``width`` - 1 stand for no window.

    Windows of 2, 4, 8 are made of two halves each, others of these.
    """
    if width == 1:
        return body(hashes)
    half = 1 << (width - 1).bit_length() - 1  # the largest power of two below width

    def combined(first: Column, second: Column) -> Column:
        return F.zip_with(first, F.slice(second, half + 1, F.size(second)), lambda a, b: F.xxhash64(a, b))

    if width == 2 * half:
        return windows(hashes, half, lambda w: let(w, lambda x: body(combined(x, x))))
    return windows(hashes, half, lambda w: windows(hashes, width - half, lambda r: body(combined(w, r))))


def slots(tokens: Column, pos: Column, width: Column) -> Column:
    """array<struct<at, value>>: the placeholders of a window, by place in the text."""
    placed = F.transform(F.slice(tokens, pos + 1, width), lambda x, i: F.struct((pos + i).alias("at"), x.alias("value")))
    return F.filter(placed, lambda x: x["value"].rlike(f"^[{NUM}{NAME}{UNIT}]"))


def item_key(item: str = "item_id", text: str = "text") -> Column:
    """What an item is known by inside: its id, which may be null or there twice, with its text."""
    return F.xxhash64(F.col(item), F.col(text)).alias("item")


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(hash, item, pos, width, slots, counted, of, size): windows of all items; how many of an item are counted, and its tokens."""
    t = F.col(text)
    b = benchmark.select(item_key(item, text), words(marked(t)).alias("read"), F.slice(words(marked(F.concat(F.lit("a "), t))), F.lit(2), F.size(words(marked(F.concat(F.lit("a "), t))))).alias("inside"))
    b = b.withColumn("width", F.least(F.lit(WIDTH), F.size("read"))).where("width > 0")
    # the first word of an item may be a name where the item stands inside a sentence
    b = b.select("item", "width", F.size("read").alias("size"), F.explode(F.array("read", "inside")).alias("tokens"))

    def form(of) -> Column:
        def some(width: int) -> Column:
            made = windows(of(F.col("tokens")), width, lambda w: F.slice(w, 1, F.size("tokens") - width + 1))
            return F.transform(made, lambda x, i: F.struct(x.alias("hash"), i.alias("pos"), F.lit(of is plain).alias("plain")))

        out = some(WIDTH)
        for width in range(1, WIDTH):
            out = F.when(F.col("width") == width, some(width)).otherwise(out)
        return out

    b = b.withColumn("w", F.explode(F.concat(form(canonical), form(plain))))
    b = b.select("item", "size", "width", "w.hash", "w.pos", "w.plain", slots(F.col("tokens"), F.col("w.pos"), F.col("width")).alias("slots"))
    usable = (2 * F.size("slots") <= F.col("width")) & (F.col("width") >= LEAST)
    b = b.where(F.col("plain") | usable)
    one = Window.partitionBy("item", "pos")
    b = b.withColumn("usable", F.max(usable).over(one)).withColumn("any", F.max("usable").over(Window.partitionBy("item")))
    # the plain form has no slots: its values are those of the item
    empty = F.array().cast("array<struct<at:int,value:string>>")
    b = b.select("item", "size", "width", "hash", "pos", F.when(F.col("plain"), empty).otherwise(F.col("slots")).alias("slots"), (F.col("usable") | ~F.col("any")).alias("counted")).distinct()
    of = b.where("counted").groupBy("item").agg(F.count_distinct("pos").alias("of"))
    return b.join(of, "item")


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """(doc, text_hash, item, windows, of, run, share): consistent windows of an item that a document has, its longest run and share of tokens."""
    scratch = Scratch(docs.sparkSession, "decontam")
    bench = scratch.keep(benchmark_windows(benchmark))
    widths = sorted(r[0] for r in bench.select("width").distinct().collect())  # LEAST..WIDTH: a few integers
    mine = docs.select(F.col(id_).alias("doc"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("t"))
    none = "doc long, text_hash long, item long, windows long, of long, run int, share double"
    if not widths:
        return docs.sparkSession.createDataFrame([], none)
    tiny, widths = [w for w in widths if w < LEAST], [w for w in widths if w >= LEAST]
    longs = F.array().cast("array<bigint>")

    def looked_up(tokens: Column) -> Column:
        """The hashes of all windows, by form and width, each array as long as ``tokens``."""
        def form(of) -> Column:
            return let(of(tokens), lambda h: F.concat(*(windows(h, w, lambda x: x) for w in widths), *(F.when(F.size(h) == w, windows(h, w, lambda x: x)).otherwise(longs) for w in tiny)))

        # a text without placeholders is its own plain form
        marks = F.exists(tokens, lambda t: t.substr(1, 1).isin(NUM, NAME, UNIT))
        return F.when(marks, F.concat(form(canonical), form(plain))).otherwise(form(plain))

    made = let(words(marked(F.col("t"))), lambda t: F.struct(F.size(t).alias("n"), looked_up(t).alias("w")))
    rows = mine.select("doc", "text_hash", made.alias("m")).select("doc", "text_hash", F.col("m.n").alias("n"), F.posexplode("m.w").alias("at", "hash"))
    known = scratch.keep(bench.select("hash").distinct())
    hits = rows.join(lookup_side(known, MOST_WINDOWS), "hash", "left_semi")
    hits = scratch.keep(hits.select("doc", "text_hash", "hash", (F.col("at") % F.col("n")).alias("at")).distinct())
    # one window may be in very many documents
    held = bounded_side(bench)
    found = hits.join(held, "hash") if held is not bench else salted_join(hits, bench, ["hash"], F.struct("doc", "text_hash", "at"), salts=16)
    about = ["pos", "width", "counted", "of", "size"]
    along = ["doc", "text_hash", "item", "shift"]
    found = found.withColumn("shift", F.col("at") - F.col("pos"))
    matched = found.where(F.size("slots") == 0).select(*along, *about)
    typed = scratch.keep(found.where(F.size("slots") > 0))
    if not typed.isEmpty():  # the values come from a second look at the documents concerned
        keys = scratch.keep(typed.select("doc", "text_hash").distinct())
        k = lookup_side(keys).select(F.col("doc").alias("_d"), F.col("text_hash").alias("_h"))
        toks = mine.join(k, F.col("doc").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")), "left_semi")
        toks = toks.dropDuplicates(["doc", "text_hash"]).select(F.col("doc").alias("_d"), F.col("text_hash").alias("_h"), words(marked(F.col("t"))).alias("tokens"))
        typed = typed.join(toks, F.col("doc").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")))
        z = F.zip_with("slots", slots(F.col("tokens"), F.col("at"), F.col("width")), lambda b, d: F.struct(b["at"].alias("i"), b["value"].alias("b"), d["value"].alias("d")))
        typed = scratch.keep(typed.select(*along, *about, z.alias("z")))
        pairs = typed.select(*along, "pos", F.explode("z").alias("z")).select(*along, "pos", "z.*")
        times = pairs.groupBy(*along, "b", "d").agg(F.count_distinct("i").alias("n"), F.min("i").alias("first"))
        by_b, by_d = (F.row_number().over(Window.partitionBy(*along, x).orderBy(F.desc("n"), "first")) for x in "bd")
        rank = F.when(F.col("b").startswith(NUM), by_d).otherwise(F.greatest(by_b, by_d))
        wrong = times.select(*along, "b", "d", rank.alias("rank")).where("rank > 1").drop("rank")
        typed = _without(typed, _semi(pairs, wrong, [*along, "b", "d"]).select(*along, "pos").distinct(), [*along, "pos"])
        matched = matched.union(typed.select(*along, *about))
    matched = scratch.keep(matched.distinct())
    doc = ["doc", "text_hash", "item"]
    places = matched.select(*along, "pos", "width").distinct()
    runs = places.withColumn("start", F.col("pos") - F.row_number().over(Window.partitionBy(*along).orderBy("pos")))
    runs = runs.groupBy(*along, "start").agg((F.count("*") + F.max("width") - 1).cast("int").alias("run"))
    runs = runs.groupBy(*doc).agg(F.max("run").alias("run"))
    once = matched.select(*doc, *about).distinct()
    after = F.lead("pos").over(Window.partitionBy(*doc).orderBy("pos"))
    once = once.withColumn("new", F.least("width", F.coalesce(after - F.col("pos"), F.col("width"))))
    out = once.groupBy(*doc).agg(F.count_if("counted").alias("windows"), F.max("of").alias("of"), (F.sum("new") / F.max("size")).alias("share"))
    return _joined(out, runs, doc, "inner").select(*doc, "windows", "of", "run", "share")


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join on keys that may be null."""
    right = right.select(*(F.col(c).alias(f"_r_{c}") for c in on), *(c for c in right.columns if c not in on))
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(right, same, how)


def _semi(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return _joined(left, right.select(*on), on, "left_semi")


def _without(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return _joined(left, right.select(*on), on, "left_anti")


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_: str = "doc_id", coverage: float = COVERAGE) -> DataFrame:
    """(doc, text_hash, n_items, items): the documents with benchmark items, and the ids of these in order, comma-joined. A kept table."""
    m = matches(docs, benchmark, text, id_)
    m = m.where((F.col("windows") >= coverage * F.col("of")) | (F.col("run") >= RUN) | (F.col("share") >= SPREAD))
    # items per document: bounded by the benchmark passages that fit into its text
    scratch = Scratch(docs.sparkSession, "decontam")
    ids = scratch.keep(benchmark.select(item_key(), F.col("item_id").alias("id")).distinct())
    listed = F.transform(F.sort_array(F.collect_list(F.struct("id"))), lambda x: F.coalesce(x["id"].cast("string"), F.lit("null")))
    m = m.join(bounded_side(ids), "item").groupBy("doc", "text_hash").agg(F.count("*").alias("n_items"), F.concat_ws(",", listed).alias("items"))
    m = m.select(F.col("doc").alias("_dc_doc"), F.col("text_hash").alias("_dc_hash"), "n_items", "items")
    return scratch.keep(m)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_: str = "doc_id", **how) -> DataFrame:
    """(id, n_items, items, contaminated) of every document; items is null where there are none."""
    m = contaminated(docs, benchmark, text, id_, **how)
    rows = docs.select(F.col(id_).alias("_dc_id"), F.xxhash64(F.col(text)).alias("_dc_text"))
    out = rows.join(bounded_side(m), F.col("_dc_id").eqNullSafe(F.col("_dc_doc")) & (F.col("_dc_text") == F.col("_dc_hash")), "left")
    return out.select(F.col("_dc_id").alias(id_), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), "items", F.col("n_items").isNotNull().alias("contaminated"))


def without_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_: str = "doc_id", **how) -> DataFrame:
    """The documents without benchmark items, all columns as they were."""
    m = contaminated(docs, benchmark, text, id_, **how)
    keys = m.select("_dc_doc", "_dc_hash")
    keys.n_rows = m.n_rows
    rows = docs.select(F.struct(*docs.columns).alias("_dc_row"), F.col(id_).alias("_dc_id"), F.xxhash64(F.col(text)).alias("_dc_text"))
    same = F.col("_dc_id").eqNullSafe(F.col("_dc_doc")) & (F.col("_dc_text") == F.col("_dc_hash"))
    return rows.join(lookup_side(keys), same, "left_anti").select("_dc_row.*")
