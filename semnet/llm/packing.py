"""Conflict-constrained best-fit packing.

Documents are cut into pieces of at most ``capacity`` words and packed into
bins of that capacity.  Two pieces of the same source, or of the same cluster
of duplicates, don't share a bin.  Open bins are ordered by residual and carry
bitmaps of their sources and clusters; a piece looks for the least residual
that holds it and goes on to the successor until it meets a compatible bin,
which is the tightest one.

Pieces are counted and dealt by a hash of their id, text, part and number among
alike ones to shards of a fixed expected size that are packed independently, so
a hot source, a very long text or a row that is repeated very often is spread
like any other, no task grows with the input, and bins don't depend on how the
rows were read.  Each shard places its pieces in the order of decreasing length
(ties: by id, part, cluster, text and source).

Defined results: a text without words has no piece and no row; a null source is
a source of its own; repeated rows are packed each (in different bins, as they
are one cluster); an id that stands for several texts is told apart by the hash
of the text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import WORD, Scratch, salted_join, words

CAPACITY = 2048
#: Expected pieces of a shard.
SHARD = 4096
#: Alike pieces that are numbered by one row before they are dealt.
ALIKE = 4096
PLACED = "doc_id string, text_hash long, part int, n_tokens int, source string, cluster long, bin_id long"


class Bins:
    """Open bins of one shard, by residual.

    ``open`` has bit r set if some bin has residual r; ``full[s]`` has bit r set
    if all bins of residual r are known to hold source s, so that a hot source
    skips them at once.
    """

    def __init__(self, capacity: int):
        self.capacity, self.open, self.n = capacity, 0, 0
        self.at: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
        self.full: dict[int, int] = {}
        self.full_by: list[int] = [0] * (capacity + 1)

    def place(self, size: int, source: int, cluster: int) -> int:
        """The bin that takes a piece; ``source`` and ``cluster`` are single bits."""
        rest = (self.open & ~self.full.get(source, 0)) >> size
        r = size - 1
        while rest:
            step = (rest & -rest).bit_length()
            r += step
            rest >>= step
            held = True
            for k, (bin_id, sources, clusters) in enumerate(self.at[r]):
                if not sources & source:
                    held = False
                    if not clusters & cluster:
                        del self.at[r][k]
                        if not self.at[r]:
                            self.open &= ~(1 << r)
                        self._add(r - size, bin_id, sources | source, clusters | cluster)
                        return bin_id
            if held:
                self.full[source] = self.full.get(source, 0) | 1 << r
                self.full_by[r] |= source
        self.n += 1
        self._add(self.capacity - size, self.n - 1, source, cluster)
        return self.n - 1

    def _add(self, r: int, bin_id: int, sources: int, clusters: int) -> None:
        if not r:
            return
        self.at[r].append((bin_id, sources, clusters))
        self.open |= 1 << r
        freed = self.full_by[r] & ~sources
        self.full_by[r] &= sources
        while freed:
            bit = freed & -freed
            self.full[bit] &= ~(1 << r)
            freed ^= bit


def _pack(capacity: int):
    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["n_tokens", "doc_id", "part", "cluster", "text_hash", "source"], ascending=[False, True, True, True, True, True], kind="stable")
        bins, sources, clusters, out = Bins(capacity), {}, {}, []
        for n, s, c in zip(b["n_tokens"], b["source"].fillna("\0"), b["cluster"]):
            bit = 1 << sources.setdefault(s, len(sources))
            out.append(bins.place(int(n), bit, 1 << clusters.setdefault(c, len(clusters))))
        return b.assign(bin_id=pd.Series(out, index=b.index, dtype="int64") + (int(key[0]) << 32))[["doc_id", "text_hash", "part", "n_tokens", "source", "cluster", "bin_id"]]

    return run


def cluster_key(text: Column) -> Column:
    """Duplicates that differ in case and white space only fall into one cluster."""
    return F.xxhash64(F.array_join(words(F.lower(text)), " "))


def pieces(
    docs: DataFrame, capacity: int = CAPACITY, text: str = "text", id_: str = "doc_id", source: str = "source", clusters: DataFrame | None = None
) -> DataFrame:
    """(doc_id, text_hash, part, n_tokens, source, cluster, row): each text cut into runs of at most ``capacity`` words.

    ``clusters`` (doc_id, text_hash, cluster) names the cluster of duplicates of
    a row; without one a text is a cluster with its own copies.
    """
    t = F.col(text)
    key = cluster_key(t) if clusters is None else F.lit(None).cast("long")
    rows = docs.select(
        F.col(id_).cast("long").alias("doc_id"), F.xxhash64(t).alias("text_hash"), F.col(source).alias("source"), F.regexp_count(F.coalesce(t, F.lit("")), F.lit(WORD)).alias("n"),
        key.alias("own"), F.monotonically_increasing_id().alias("row"),
    )
    if clusters is not None:
        rows = salted_join(rows, clusters, ["doc_id", "text_hash"], F.col("row"), "left", salts=4)
    else:
        rows = rows.withColumn("cluster", F.lit(None).cast("long"))
    # a text without words has no part
    parts = F.transform(
        F.when(F.col("n") > 0, F.sequence(F.lit(0), F.floor((F.col("n") - 1) / capacity).cast("int"))),
        lambda k: F.struct(k.alias("part"), F.least(F.lit(capacity), F.col("n") - k * capacity).alias("n_tokens")),
    )
    rows = rows.select("doc_id", "text_hash", "source", F.coalesce("cluster", "own").alias("cluster"), "row", F.explode(parts).alias("p"))
    return rows.select("doc_id", "text_hash", "p.part", "p.n_tokens", "source", "cluster", "row")


def pack(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, **cols) -> DataFrame:
    """(doc_id, text_hash, part, n_tokens, source, cluster, bin_id): the bin of every piece."""
    p = Scratch(docs.sparkSession, "packing").keep(pieces(docs, capacity, **cols))
    n = max(1, -(-p.n_rows // shard))
    # alike pieces are numbered by their count, some thousands in a row, so that the shards don't depend on how the rows were read
    p = p.groupBy(*(c for c in p.columns if c != "row")).agg(F.count("*").alias("_n"))
    p = p.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(ALIKE).cast("long"))))
    p = p.withColumn("_k", F.explode(F.sequence("_k", F.least(F.col("_n"), F.col("_k") + ALIKE) - 1)))
    # a full piece has a bin to itself wherever it is packed, so parts needn't stay together
    p = p.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_hash", "part", "cluster", "_k"), F.lit(n))).drop("_n", "_k")
    # ids pass Python as text: pandas would make floats of numbers among nulls
    p = p.withColumn("doc_id", F.col("doc_id").cast("string"))
    return p.groupBy("shard").applyInPandas(_pack(capacity), PLACED).withColumn("doc_id", F.col("doc_id").cast("long"))


def samples(docs: DataFrame, placed: DataFrame, capacity: int = CAPACITY, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """(bin_id, n_tokens, text): the packed texts, pieces in the order of id, part and text; a bin is bounded by its capacity."""
    t = F.col(text)
    cut = docs.select(F.col(id_).cast("long").alias("_id"), F.xxhash64(t).alias("_hash"), words(t).alias("_w")).where(F.size("_w") > 0)
    cut = cut.select("_id", "_hash", F.posexplode(F.sequence(F.lit(0), F.size("_w") - 1, F.lit(capacity))).alias("_part", "_at"), "_w")
    cut = cut.select("_id", "_hash", "_part", F.array_join(F.slice("_w", F.col("_at") + 1, F.lit(capacity)), " ").alias("t"))
    cut = cut.groupBy("_id", "_hash", "_part").agg(F.first("t").alias("t"))  # repeated rows have one text
    rows = placed.join(cut, placed["doc_id"].eqNullSafe(cut["_id"]) & (placed["text_hash"] == cut["_hash"]) & (placed["part"] == cut["_part"]))
    grouped = rows.groupBy("bin_id").agg(F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("doc_id", "part", "t"))).alias("x"))
    return grouped.select("bin_id", "n_tokens", F.array_join(F.transform("x", lambda r: r["t"]), "\n\n").alias("text"))
