"""Helpers that all operators of this subpackage share.

Everything here is plain DataFrame code.  Tables that are read more than once
are written as Parquet into the folder that the session names in
``spark.checkpoint.dir`` (shared by driver and executors), so a lost executor
costs a re-read and never a recomputation of the lineage above it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Whitespace that separates words, as a Java pattern.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder. Where the session names none, a temporary one on a single machine and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="semnet-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, whatever store it is in."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables of one operator call in the shared folder, removed at exit.

    With ``batch_bytes``, rows go to Python functions in batches of about so
    many bytes while a table is written, where the session sets no such bound:
    ten thousand rows of long texts or sets would fill an executor.
    """

    def __init__(self, spark: SparkSession, name: str, batch_bytes: int | None = None):
        self.spark = spark
        self.batch_bytes = batch_bytes
        self.root = f"{shared_dir(spark)}/semnet-{name}-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self.clear)

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/t{self.n}"

    def keep(self, df: DataFrame, flag: str | None = None) -> DataFrame:
        """Write ``df`` and return it as read back: the lineage ends here.

        ``n_rows`` of the result is its row count, ``n_flagged`` the rows in
        which the column ``flag`` is true; both are counted as they are written.
        """
        at, seen = self.path(), Observation()
        with self.batches():
            df.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.col(flag) if flag else F.lit(False)).alias("k")).write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out.n_rows, out.n_flagged = seen.get.get("n", 0), seen.get.get("k", 0)
        return out

    @contextmanager
    def batches(self) -> Iterator[None]:
        bound = "spark.sql.execution.arrow.maxBytesPerBatch"
        ours = self.batch_bytes is not None and self.spark.conf.get(bound, None) in (None, str(2**31 - 1), f"{2**31 - 1}b")
        if ours:
            self.spark.conf.set(bound, str(self.batch_bytes))
        try:
            yield
        finally:
            if ours:
                self.spark.conf.unset(bound)

    def clear(self) -> None:
        try:
            remove(self.spark, self.root)
        except Exception:  # the session may be gone by now
            pass


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body``.

    A lambda variable can't be inlined, so the optimizer can't repeat a costly
    expression for each element of an inner higher-order function.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


#: Rows that may be broadcast, and the most bytes that one of them may have: 32 MB at most.
MOST_ROWS, ROW_BYTES = 200_000, 160


def lookup_side(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """Broadcast a kept table of at most ``most`` rows of fixed width; beyond that, leave the join to be shuffled."""
    return F.broadcast(df) if df.n_rows <= most else df


def bounded_side(df: DataFrame, most_bytes: int = MOST_ROWS * ROW_BYTES) -> DataFrame:
    """Broadcast a kept table of strings, arrays and integers if all its values have at most ``most_bytes`` together."""
    if df.n_rows > most_bytes // 16:
        return df
    width = F.lit(0).cast("long")
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        one = F.octet_length(F.col(f.name)) if kind in ("string", "binary") else F.octet_length(F.to_json(F.struct(f.name))) if kind in ("array", "struct", "map") else F.lit(8)
        width = width + F.coalesce(one, F.lit(0)) + 16
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= most_bytes else df


def salted_join(left: DataFrame, right: DataFrame, on: list[str], by: Column, how: str = "inner", salts: int = 32) -> DataFrame:
    """Equi-join in which a hot key of ``left`` is dealt over ``salts`` tasks.

    ``right`` must have one row per key and is repeated ``salts`` times; the
    rows of ``left`` take the copy that ``by`` hashes to.  Null keys match null
    keys.
    """
    left = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    right = right.select(
        *(F.col(c).alias(f"_r_{c}") for c in on),
        *(F.col(c) for c in right.columns if c not in on),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_rsalt"),
    )
    same = F.col("_salt") == F.col("_rsalt")
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(right, same, how).drop("_salt", "_rsalt", *(f"_r_{c}" for c in on))


def dealt_join(left: DataFrame, right: DataFrame, on: list[str], by: Column, how: str = "inner", salts: int = 32, rows: int | None = None) -> DataFrame:
    """Equi-join on non-null keys in which a hot key of ``left`` is dealt over ``salts`` tasks.

    Unlike ``salted_join`` it doesn't repeat ``right`` (one row per key), but
    sends a key's row only to the salts at which ``left`` has that key.  Where
    ``right`` is known to have at most MOST_ROWS rows it is broadcast instead.
    """
    if rows is not None and rows <= MOST_ROWS:
        return left.join(F.broadcast(right), on, how)
    left = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    there = left.select(*on, "_salt").distinct().join(right, on)
    return left.join(there, [*on, "_salt"], how).drop("_salt")
