"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; without it a temporary folder on a single machine, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="semnet-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, removed at exit."""
    path = f"{shared_dir(spark)}/semnet-{name}-{uuid.uuid4().hex}"

    def clear() -> None:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone by now
            pass

    atexit.register(clear)
    return path


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read back: the lineage ends here, and a lost executor costs a read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, **what: Column) -> tuple[DataFrame, dict]:
    """``kept`` with aggregates that are taken as the rows are written; sums of no rows are 0."""
    seen = Observation()
    out = kept(df.observe(seen, F.count(F.lit(1)).alias("rows"), *(v.alias(k) for k, v in what.items())), name)
    got = seen.get
    return out, {k: got.get(k) or 0 for k in ("rows", *what)}


def dealt(df: DataFrame, rows: int | None, each: int, *by: str) -> DataFrame:
    """``df`` dealt by columns so that a task has about ``each`` of ``rows`` rows, where that takes more tasks than there are cores: then a task's memory doesn't grow with the table. What is grouped by these columns and others later needs no other exchange."""
    n = -(-(rows or 0) // each)
    return df.repartition(n, *by) if n > df.sparkSession.sparkContext.defaultParallelism else df
