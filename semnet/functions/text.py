"""Text preprocessing as column expressions."""

from __future__ import annotations

import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# fixed values: characters that the older preprocessor replaces with a space, and typographic marks with their plain forms
KILL_CHARS = "#$%()*/<>@\\{}[]+^~\""
CURLY, PLAIN = "‘’´“”–-", "'''\"\"--"


@F.pandas_udf(StringType())
def _nfkd(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))


def nfkd(c: Column, ascii_only: bool = False) -> Column:
    """Unicode NFKD, which Spark has no built-in for; ``ascii_only`` puts ? for what isn't ASCII."""
    out = _nfkd(c)
    return F.regexp_replace(out, r"[^\x00-\x7F]", "?") if ascii_only else out


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def drop_brackets(c: Column) -> Column:
    return F.translate(c, "#(){}", "")


def strip_tags(c: Column) -> Column:
    """Text of markup by pattern: tags go, the five common entities are decoded."""
    t = F.regexp_replace(c, r"<[^>]*+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return t


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


@F.pandas_udf(StringType())
def html_text(s: pd.Series) -> pd.Series:
    """Text of markup by a parser: the data between tags, scripts and styles included."""

    def one(x):
        if x is None:
            return None
        p = _Text()
        p.feed(x)
        p.close()
        return "".join(p.parts)

    return s.map(one)


def strip_numbers(c: Column) -> Column:
    """Leading and trailing digits, and words of five digits or more."""
    for pattern in (r"^\d+", r"\d+$", r"\b\d{5,}\b"):
        c = F.regexp_replace(c, pattern, "")
    return c


def clean(c: Column, markup: bool = True) -> Column:
    """The newer preprocessor's chain."""
    t = drop_brackets(collapse_space(nfkd(c)))
    return strip_numbers(strip_tags(t) if markup else t)


def clean_v1(c: Column) -> Column:
    """The older preprocessor's chain: marks spaced out, paragraph tags and odd characters blanked, outer digits dropped."""
    for old, new in (("\n", " "), (" '", " ' "), (" .", ". "), (" ,", ", "), ("...", ". "), ("<p>", " ")):
        c = F.replace(c, F.lit(old), F.lit(new))
    t = collapse_space(F.translate(c, KILL_CHARS, " " * len(KILL_CHARS)))
    return F.regexp_replace(F.regexp_replace(t, r"^\d+", ""), r"\d+$", "")


def row_rules(rows: DataFrame, text: str, most_chars: int, least: int = 2) -> DataFrame:
    """Rows of at least ``least`` characters, cut at a word to fewer than ``most_chars``, closed with a point, typographic marks plain."""
    t = trim_words(F.col(text), most_chars - 1)
    closed = F.when(t.rlike('[,.;":]$'), t).otherwise(F.concat(t, F.lit(".")))
    return rows.where(F.length(text) >= least).withColumn(text, plain_marks(closed))


def first_rows(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows in an order: the preprocessor's limit on a corpus."""
    return rows.orderBy(*order).limit(most)


def drop_short(rows: DataFrame, text: str, least: int = 3) -> DataFrame:
    return rows.where(F.length(text) >= least)


def padded(ids: Column, width: int, first: int, last: int, pad: int) -> Column:
    """Token ids between two special ones, cut and filled up to ``width``."""
    inner = F.slice(ids, 1, width - 2)
    return F.concat(F.array(F.lit(first)), inner, F.array(F.lit(last)), F.array_repeat(F.lit(pad), F.lit(width - 2) - F.size(inner)))


def known_only(tokens_: Column, unknown: str = "[UNK]") -> Column:
    """Tokens without the unknown one; places are counted among those that remain."""
    return F.filter(tokens_, lambda t: t != unknown)


def token_rows(rows: DataFrame, tokens_: Column, pos: str = "pos", token: str = "token") -> DataFrame:
    """One row per token, with the attributes of its sentence."""
    return rows.select("*", F.posexplode(tokens_).alias(pos, token))


def sentences(c: Column) -> Column:
    """Cut after . ! or ? and white space, abbreviations too; ``sentences.split`` learns these."""
    return F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.length(s) > 0)


@F.pandas_udf(ArrayType(StringType()))
def halve(s: pd.Series, most: pd.Series) -> pd.Series:
    """Cut in halves until each has at most ``most`` characters; halves are stripped."""

    def cut(x: str, n: int) -> list[str]:
        out, todo = [], [x]
        while todo:
            y = todo.pop()
            if len(y) <= n:
                out.append(y)
            else:
                mid = len(y) // 2
                todo += [y[mid:].strip(), y[:mid].strip()]
        return out

    return pd.Series([None if x is None else cut(x, max(1, int(n))) for x, n in zip(s, most)])


def word_chunks(c: Column, size: int) -> Column:
    """Lower-cased chunks of ``size`` words, each closed with a point unless a mark ends it."""
    w = F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != "")
    n = F.ceil(F.size(w) / size).cast("int")
    made = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(w, i * size + 1, size), " "))
    closed = F.transform(made, lambda x: F.when(x.rlike('[,.;":]$'), x).otherwise(F.concat(x, F.lit("."))))
    return F.when(n > 0, closed).otherwise(F.array().cast("array<string>"))


def plain_marks(c: Column) -> Column:
    return F.replace(F.translate(c, CURLY, PLAIN), F.lit("?"), F.lit(" ? "))


def trim_words(c: Column, most_chars: int) -> Column:
    """Drop last words until at most ``most_chars`` characters are left."""
    w = F.split(c, " ")
    kept = F.aggregate(
        w, F.struct(F.lit("").alias("t"), F.lit(True).alias("go")),
        lambda a, x: F.when(
            a["go"] & (F.length(a["t"]) + F.length(x) + F.when(a["t"] == "", 0).otherwise(1) <= most_chars),
            F.struct(F.when(a["t"] == "", x).otherwise(F.concat(a["t"], F.lit(" "), x)).alias("t"), F.lit(True).alias("go")),
        ).otherwise(F.struct(a["t"].alias("t"), F.lit(False).alias("go"))),
        lambda a: a["t"],
    )
    return kept


def tokens(c: Column) -> Column:
    """Lower-case runs of letters of any script."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+"), F.lit(0))


def stop_words(numbers: int = 3000) -> list[str]:
    """Function words, marks, letters and the numbers below ``numbers``."""
    # fixed values
    words = (
        "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down "
        "during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off "
        "on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under "
        "until up very was we were what when where which while who whom why will with would you your"
    ).split()
    marks = list(".,;:!?'\"-()[]{}/\\&%$#@*+=<>|_~^`")
    letters = [chr(c) for c in range(ord("a"), ord("z") + 1)]
    return sorted({*words, *marks, *letters, *map(str, range(numbers))})


def without_stop_words(rows: DataFrame, col: str, stops: DataFrame) -> DataFrame:
    """Anti-join on a list that is fixed in size."""
    return rows.join(F.broadcast(stops.select(F.col(stops.columns[0]).alias("_stop"))), F.col(col) == F.col("_stop"), "left_anti")


def missing_words(rows: DataFrame, text: str, vocabulary: DataFrame, stops: DataFrame, cutoff: int) -> DataFrame:
    """(word, cnt): frequent words, longer than three letters, that are in neither list."""
    w = rows.select(F.explode(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+")).alias("word")).where(F.col("word").rlike("^[a-z]{4,}$"))
    # counting first leaves one row per word for the anti-joins
    counts = w.groupBy("word").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= cutoff)
    counts = counts.join(vocabulary.select(F.col(vocabulary.columns[0]).alias("word")).distinct(), "word", "left_anti")
    return without_stop_words(counts, "word", stops)


def vocabulary_union(vocabulary: DataFrame, added: DataFrame) -> DataFrame:
    return vocabulary.select("word").union(added.select("word")).distinct()


def assign_ids(tokens_: DataFrame, known: DataFrame) -> DataFrame:
    """(token, token_id): known ids stay, new tokens take the next ones in alphabetical order.

    New tokens are numbered in ranges, so no task sorts the vocabulary alone.
    """
    new = tokens_.select("token").distinct().join(known, "token", "left_anti")
    top = known.agg(F.coalesce(F.max("token_id"), F.lit(0)).cast("long").alias("top"))
    ranged = new.withColumn("bucket", F.substring("token", 1, 2))
    sizes = ranged.groupBy("bucket").agg(F.count("*").alias("n"))
    before = sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("token"))
    made = ranged.withColumn("rank", rank).join(before, "bucket").join(F.broadcast(top), F.lit(True))
    return known.select("token", F.col("token_id").cast("long")).union(made.select("token", F.col("top") + F.col("before") + F.col("rank")))


def suffix_tag(token: Column) -> Column:
    """A deterministic part-of-speech guess by suffix, in place of a trained tagger."""
    return (
        F.when(token.rlike("(ing|ed|ize|ise|ate)$"), "VERB").when(token.rlike("ly$"), "ADV")
        .when(token.rlike("(ous|ful|ive|able|ible|al|ic)$"), "ADJ").when(token.rlike("^[0-9]+$"), "NUM").otherwise("NOUN")
    )


def lexicon_score(rows: DataFrame, key: str, token_array: str, lexicon: DataFrame) -> DataFrame:
    """(key, sentiment, subjectivity): means over the words that the lexicon has, 0 without any."""
    # a lexicon may be of any size: Spark broadcasts it where its size allows
    w = rows.select(F.col(key), F.explode_outer(token_array).alias("token")).join(lexicon, "token", "left")
    return w.groupBy(key).agg(F.coalesce(F.avg("polarity"), F.lit(0.0)).alias("sentiment"), F.coalesce(F.avg("subjective"), F.lit(0.0)).alias("subjectivity"))


def escape_quotes(c: Column) -> Column:
    t = F.replace(F.replace(c, F.lit("'"), F.lit("#e1#")), F.lit('"'), F.lit("#e2#"))
    return F.replace(t, F.lit("\\"), F.lit("#e3#"))


def clean_company(c: Column, phrases: list[str]) -> Column:
    t = F.lower(c)
    for p in phrases:
        t = F.replace(t, F.lit(p), F.lit(""))
    return F.trim(t)


def sentence_index(sent: DataFrame) -> DataFrame:
    """Add index, year_index and file_index, zero-based, in the order of year, file and position.

    Ranks are taken per file and joined with the sizes of the files before, so only one row per file is sorted in one task.
    """
    files = sent.groupBy("year", "filename").agg(F.count("*").alias("n"))
    order = Window.orderBy("year", "filename")
    in_year = Window.partitionBy("year").orderBy("filename")
    before = files.select(
        F.col("year").alias("_y"), F.col("filename").alias("_f"),
        (F.sum("n").over(order) - F.col("n")).alias("b"), (F.sum("n").over(in_year) - F.col("n")).alias("by"),
    )
    rank = F.row_number().over(Window.partitionBy("year", "filename").orderBy("pos")) - 1
    out = sent.withColumn("file_index", rank.cast("long")).join(before, (F.col("year") == F.col("_y")) & (F.col("filename") == F.col("_f")))
    return out.withColumn("index", F.col("b") + F.col("file_index")).withColumn("year_index", F.col("by") + F.col("file_index")).drop("_y", "_f", "b", "by")
