"""Incremental ingestion: ties of new sentence files are merged into a store as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def ingest(spark: SparkSession, source: str, schema, build: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, fmt: str = "json", on_match: str = "keep") -> StreamingQuery:
    """Read files of ``source`` once each; ``build`` makes ties of a batch.

    A time may arrive in any number of batches: ties that the store has are
    kept, or replaced if ``on_match`` says so. The number of a batch is
    published with its ties, so one that is repeated after a failure adds nothing.
    """
    stream = spark.readStream.schema(schema).format(fmt).load(source)
    store = Store(spark, target)

    def put(batch: DataFrame, number: int) -> None:
        store.merge(build(batch), on_match, stream=(checkpoint, number))

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
