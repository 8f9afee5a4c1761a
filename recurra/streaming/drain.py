"""The queue as a stream: micro-batches are indexed, then clusters are made anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine
from ..sources.queue import queue_stream


def drain_queue(spark: SparkSession, engine: Engine, queue_dir: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """The checkpoint keeps which files were taken; a batch that is run again gives the same tables, as rows are replaced by key."""

    def batch(df: DataFrame, batch_id: int) -> None:
        rows = df.persist()
        if not rows.isEmpty():
            engine.drain(rows)
            engine.recluster()
        rows.unpersist()

    out = queue_stream(spark, queue_dir).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()
