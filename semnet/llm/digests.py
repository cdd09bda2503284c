"""Exact duplicates by a tree-merge of sorted digest runs.

Two texts are equal when they are identical after each run of white space has
become one space; a text is named by the SHA-256 of that form.  Every task
sorts its digests into *runs* of entries (digest, length, least identifier,
number of rows).  Partitions then exchange runs in binomial rounds: partition
numbers have ``k`` bits, and in a round those that differ in the next few bits
only send each other the entries whose digests belong there.  What a partition
gets is a few sorted runs, which it merges; equal digests, verified by all 256
bits and the length, become one entry with the least identifier, so a group of
copies is one entry a partition from the first round on and never a hot key.
After the last round a partition holds one range of digests, whole.  No
partition ever holds more than its share, unlike in a tree that ends in a root.

Defined results: a null text counts as empty; empty texts are copies of each
other, texts of white space alone are copies of the text of one space, and one
leading or trailing space counts.  A null doc_id is later than any other; of
rows that are alike in doc_id and text one is kept, and a group of null ids has
a null keep_id.  An empty table gives no rows.  Texts of any length are read
whole; ties can't arise but among rows that are alike.  Extra columns are
ignored by the report and left alone by ``without_copies``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import SPACE, Scratch, dealt_join

#: Rows of a run and, on average, entries of a partition in the tree.
RUN = 1 << 19
#: Bits of a partition's number that a round settles: eight runs are merged at once.
BITS = 3

ENTRY = "at int, digest binary, size long, id long, row long, n long"
_LAST = np.iinfo(np.int64).max


def normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _merged(runs: list[pa.RecordBatch]) -> dict[str, np.ndarray] | None:
    """One sorted run of several: entries of one digest become one, with the least (id, row) and the sum of n."""
    t = pa.Table.from_batches(runs).combine_chunks()
    if not t.num_rows:
        return None
    raw = t["digest"].combine_chunks()
    start = np.frombuffer(raw.buffers()[1], np.int32, 1, 4 * raw.offset)[0] if len(raw) else 0
    key = np.frombuffer(raw.buffers()[2], ">u8", 4 * len(raw), start).astype(np.uint64).reshape(-1, 4)
    col = {c: t[c].to_numpy() for c in ("at", "size", "row", "n")}
    null = t["id"].is_null().to_numpy()
    id_ = np.where(null, _LAST, t["id"].fill_null(0).to_numpy())
    # a stable sort of the runs by the first 64 bits merges what is sorted already; the rest is verified, and sorted only where it differs
    order = np.argsort(key[:, 0], kind="stable")
    first = key[order, 0]
    same = first[1:] == first[:-1]
    full = np.column_stack([key, col["size"].astype(np.uint64)])
    if same.any() and (full[order[1:]][same] != full[order[:-1]][same]).any():
        order = np.lexsort(full.T[::-1])
    full, null, id_ = full[order], null[order], id_[order]
    col = {c: v[order] for c, v in col.items()}
    starts = np.flatnonzero(np.concatenate([[True], (full[1:] != full[:-1]).any(axis=1)]))
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
    lone, least = np.minimum.reduceat(null, starts), np.minimum.reduceat(id_, starts)
    best = (null == lone[of]) & (id_ == least[of])
    return {
        "at": col["at"][starts], "key": full[starts, :4], "size": col["size"][starts], "null": lone, "id": least,
        "row": np.minimum.reduceat(np.where(best, col["row"], _LAST), starts), "n": np.add.reduceat(col["n"], starts),
    }


def _batch(m: dict[str, np.ndarray], level: int, bits: int, k: int) -> pa.RecordBatch:
    """Entries with the partition they go to in the round that settles ``bits`` bits from ``level`` on."""
    there = (m["key"][:, 0] >> np.uint64(64 - k)).astype(np.int64) if k else np.zeros(len(m["n"]), np.int64)
    mask = ((1 << bits) - 1) << level
    digest = pa.Array.from_buffers(pa.binary(), len(m["n"]), [None, pa.py_buffer(np.arange(0, 32 * len(m["n"]) + 1, 32, dtype=np.int32).tobytes()), pa.py_buffer(m["key"].astype(">u8").tobytes())])
    cols = [pa.array((m["at"] & ~mask | there & mask).astype(np.int32)), digest, pa.array(m["size"]), pa.array(m["id"], mask=m["null"]), pa.array(m["row"]), pa.array(m["n"])]
    return pa.RecordBatch.from_arrays(cols, ["at", "digest", "size", "id", "row", "n"])


def _merge(level: int, bits: int, k: int, run: int):
    """Merge what a task gets, ``run`` rows at a time; after an exchange that is a partition's whole share."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, n = [], 0
        for b in batches:
            have.append(b)
            n += b.num_rows
            if n >= run:
                yield _batch(_merged(have), level, bits, k)
                have, n = [], 0
        if n:
            yield _batch(_merged(have), level, bits, k)

    return work


def digest_rows(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, digest, size, row) of every document, and the columns ``more``."""
    t = normal(F.col("text"))
    return docs.select("doc_id", F.unhex(F.sha2(t.cast("binary"), 256)).alias("digest"), F.octet_length(t).cast("long").alias("size"), F.monotonically_increasing_id().alias("row"), *more)


def tree_merge(rows: DataFrame, scratch: Scratch, run: int = RUN, bits: int = BITS, least: int | None = None) -> DataFrame:
    """The entries of all digests of the kept table ``rows``, each once: digest, size, id, row, n.

    There are ``least`` partitions or more (by default the session's
    parallelism), and so many that a share has about ``run`` entries.
    """
    spark = rows.sparkSession
    k = math.ceil(math.log2(max(rows.n_rows / run, least or spark.sparkContext.defaultParallelism, 1)))
    own = F.pmod(F.shiftrightunsigned("row", 33), F.lit(1 << k)).cast("int").alias("at")  # the task that read the row
    e = rows.select(own, "digest", "size", F.col("doc_id").cast("long").alias("id"), "row", F.lit(1).cast("long").alias("n"))
    e = e.mapInArrow(_merge(0, min(bits, k), k, run), ENTRY)
    for level in range(0, k, bits):
        after = level + bits
        # a share holds entries of distinct digests and sources: it is merged as one
        e = e.repartitionById(1 << k, F.col("at")).mapInArrow(_merge(after, max(0, min(bits, k - after)), k, 1 << 62), ENTRY)
    if not k:
        e = e.coalesce(1).mapInArrow(_merge(0, 0, 0, 1 << 62), ENTRY)
    return e.drop("at")


def exact_duplicates(docs: DataFrame, run: int = RUN, bits: int = BITS, least: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return _judged(docs, Scratch(docs.sparkSession, "digests"), run, bits, least).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _judged(docs: DataFrame, scratch: Scratch, run: int, bits: int, least: int | None, *more: str) -> DataFrame:
    rows = scratch.keep(digest_rows(docs, *more))
    copies = scratch.keep(tree_merge(rows, scratch, run, bits, least).where("n > 1").select("digest", F.col("id").alias("_id"), F.col("row").alias("_row"), F.col("n").alias("_n")))
    # rows of a large group are dealt by their numbers
    out = dealt_join(rows, copies, ["digest"], F.col("row"), "left", rows=copies.n_rows)
    single = F.col("_n").isNull()
    return out.select(
        "doc_id", "digest", F.when(single, F.col("doc_id")).otherwise(F.col("_id")).alias("keep_id"), F.coalesce("_n", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("row") == F.col("_row"))).alias("kept"), *more,
    )


def without_copies(docs: DataFrame, run: int = RUN, bits: int = BITS, least: int | None = None) -> DataFrame:
    """The documents that stay, with all their columns as they were."""
    held = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"))
    return _judged(held, Scratch(docs.sparkSession, "digests"), run, bits, least, "_doc").where("kept").select("_doc.*")
