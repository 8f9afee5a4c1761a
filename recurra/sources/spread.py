"""Input of few splits dealt out before costly work on each row."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` as it is if its scan has a task for each core at least; else its rows are dealt out once, evenly.

    A small file of one row group is one task otherwise, whatever its splits. Large tables are never shuffled by this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
