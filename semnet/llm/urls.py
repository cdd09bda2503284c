"""URL filters: rules by host and path, and a list of URLs behind a blocked Bloom filter.

The filter has blocks of 256 bits.  A canonical URL picks one block and sets
eight bits in it, so building is one grouped ``bit_or`` and probing is one
lookup of a block.  Rows that it can't hold are done at once; only possible hits
go to an exact hash join with the list, which removes the false positives.

Defined results: a null url, or one without ``://``, has an empty host and
path, fits no rule and is on no list; repeated rows get a row each; repeated
listed URLs count once, empty and null ones not at all; without pages there are
no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Scratch, lookup_side, salted_join, table

#: (verdict, host, path)
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Listed URLs per block: 256 bits for 16 URLs of 8 bits each, about 1 in 300 false positives.
PER_BLOCK, BITS = 16, 8
#: Blocks that may be broadcast (40 bytes each).
MOST_BLOCKS = 500_000
#: The file beside the pages that lists URLs to block, one column ``url``; without one the list is LISTED.
LIST = "blocked_urls"
# fixed values: a small list for tables that come without one
LISTED = [
    "http://www.cheap-pills.example.com/en/450?page=2&ref=x", "https://www.cheap-pills.example.com/fr/176/", "https://www.cheap-pills.example.com/en/680",
    "https://www.cheap-pills.example.com/en/926/", "https://www.cheap-pills.example.com/de/612", "http://www.casino-win.example.org/en/14", "https://casino-win.example.org/de/571",
    "http://m.free-bets.example.com/en/27#top", "http://m.free-bets.example.com:80/de/963", "https://m.free-bets.example.com/de/216.html", "https://m.free-bets.example.net/fr/31",
    "http://m.casino-win.example.com/en/4033.html", "https://free-bets.example.com/en/5462", "https://www.cheap-pills.example.com/de/6652.html", "https://free-bets.example.com/de/3008/",
]


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without www. and default port, path without its last slash; no scheme, query or fragment."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    return F.concat(host, F.regexp_replace(path_of(url), r"/+$", ""))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _word_masks(h: Column) -> list[Column]:
    """The four 64-bit words of a URL's bits: eight bytes of its second hash each name one of 256 bits."""
    bits = [F.shiftrightunsigned(h, 8 * k).bitwiseAND(F.lit(255)).cast("int") for k in range(BITS)]
    return [
        reduce(
            lambda a, b: a.bitwiseOR(b),
            (F.when(F.shiftright(b, 6) == word, _bit(b)).otherwise(F.expr("0L")) for b in bits),
        )
        for word in range(4)
    ]


def _bit(b: Column) -> Column:
    return F.call_function("shiftleft", F.expr("1L"), F.pmod(b, F.lit(64)).cast("int"))


def bloom_blocks(listed: DataFrame, n_blocks: int, col: str = "canonical") -> DataFrame:
    """(block, w0..w3): the filter of the distinct values of ``col``."""
    masks = _word_masks(F.xxhash64(F.col(col), F.lit(1)))
    rows = listed.select(F.pmod(F.xxhash64(F.col(col)), F.lit(n_blocks)).alias("block"), *(m.alias(f"w{k}") for k, m in enumerate(masks)))
    return rows.groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(4)))


def marked(rows: DataFrame, blocks: DataFrame, n_blocks: int, col: str = "canonical") -> DataFrame:
    """``rows`` with ``possible``: whether the filter may hold the value; true for all listed ones, and for a few more."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.col(col)), F.lit(n_blocks)))
    if blocks.n_rows <= MOST_BLOCKS:
        hit = rows.join(lookup_side(blocks, MOST_BLOCKS), "block", "left")
    else:  # a block may be hit by the rows of one very frequent URL
        hit = salted_join(rows, blocks, ["block"], F.col("row"), "left", salts=8)
    all_set = F.lit(True)
    for k, m in enumerate(_word_masks(F.xxhash64(F.col(col), F.lit(1)))):
        all_set = all_set & (F.col(f"w{k}").bitwiseAND(m) == m)
    return hit.withColumn("possible", F.coalesce(all_set, F.lit(False))).drop("block", "w0", "w1", "w2", "w3")


def judge(pages: DataFrame, listed: DataFrame, id_: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """One row per page: id, host, path, rule, listed, verdict (the rule's, else block if the URL is listed, else allow)."""
    scratch = Scratch(pages.sparkSession, "urls")
    rows = pages.select(
        F.col(id_).alias("_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), canonical(F.col(url)).alias("canonical"),
        F.monotonically_increasing_id().alias("row"),
    )
    exact = scratch.keep(listed.select("canonical").where("canonical is not null and canonical <> ''").distinct())
    n_blocks = max(1, -(-exact.n_rows // PER_BLOCK))
    blocks = scratch.keep(bloom_blocks(exact, n_blocks))
    # what the filter rules out is done; the rest is kept, to be joined with the list
    probed = marked(rows, blocks, n_blocks)
    maybe = scratch.keep(probed.where("possible"))
    true = exact.withColumn("listed", F.lit(True))
    sure = salted_join(maybe, true, ["canonical"], F.col("row"), "left", salts=8)
    every = probed.where("not possible").withColumn("listed", F.lit(False)).unionByName(sure.withColumn("listed", F.coalesce("listed", F.lit(False))))
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    out = every.withColumn("best", longest_rule(F.col("host"), F.col("path"), rules))
    return out.select(F.col("_id").alias(id_), "host", "path", F.col("best.rule").alias("rule"), "listed", verdict.alias("verdict"))


def blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical URLs of the list beside the pages, or of LISTED."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{LIST}.parquet")
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        urls = table(spark, sf_dir, LIST)
    else:
        urls = spark.createDataFrame([(u,) for u in LISTED], "url string")
    return urls.select(canonical(F.col("url")).alias("canonical"))


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), blocklist(spark, sf_dir))
