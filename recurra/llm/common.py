"""Helpers shared by the operators: tables, hashes, Arrow-batched work on texts."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from ..operators.skew import join_lookup
from ..sources.scratch import Scratch, remove, shared_dir
from ..sources.spread import spread

__all__ = ["ASCII_SPACE", "Scratch", "SortedTable", "ascii_lower", "components", "free_names", "hash128", "join_lookup", "map_blocks", "remove", "shared_dir", "spread", "table", "tokenizer_path"]

#: White space of ASCII: space, tab, line feed, vertical tab, form feed, carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Texts of ASCII alone take the fast built-in."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has in any case, so that a caller's columns are never taken for ours."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        k = 0
        while f"_{n}_{k}".lower() in taken:
            k += 1
        out.append(f"_{n}_{k}")
    return out


class SortedTable:
    """A table in the shared folder, bucketed and sorted by its keys: joins of two of them on the keys need no shuffle."""

    def __init__(self, scratch: Scratch, df: DataFrame, keys: list[str], buckets: int, name: str):
        self.scratch, self.name, self.path = scratch, f"{name}_{uuid.uuid4().hex}", scratch.path(name)
        # rows that are dealt by the keys already, as after a join of such tables, are not dealt again
        df.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", self.path).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.scratch.spark.table(self.name)

    def drop(self) -> None:
        self.scratch.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.scratch.spark, self.path)


def hash128(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes, together a key that different values don't share in practice."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit(0x5EED), *cols)]


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; RECURRA_TOKENIZERS names another folder."""
    folder = os.environ.get("RECURRA_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def map_blocks(docs: DataFrame, fields: str, work, block_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with new columns that ``work`` makes from the texts of a block of rows, Arrow-batched, without a shuffle.

    work(texts, batch) gets the block's texts (None for null) and its Arrow table, and returns a list of Arrow arrays, one for
    each of ``fields`` (DDL). A block ends once its texts have ``block_bytes``, so memory is bounded by that and the
    longest text. Same-named columns of ``docs`` are replaced; types of the others are kept.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(fields)
    docs = docs.drop(*added.fieldNames())
    schema = StructType(docs.schema.fields + added.fields)
    kinds = [f.type for f in to_arrow_schema(added)]
    names = added.fieldNames()

    def run(batches):
        def out(kept):
            t = pa.Table.from_batches(kept)
            for name, kind, values in zip(names, kinds, work(t.column("text").to_pylist(), t), strict=True):
                t = t.append_column(name, values if isinstance(values, (pa.Array, pa.ChunkedArray)) and values.type == kind else pa.array(values, kind))
            return t.combine_chunks().to_batches()

        kept, size = [], 0
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                if not part.num_rows:
                    continue
                kept.append(part)
                size += part.get_total_buffer_size() if part.num_rows == b.num_rows else sum(len(x.as_buffer()) for x in part.column("text") if x.is_valid)
                if size >= block_bytes:
                    yield from out(kept)
                    kept, size = [], 0
        if kept:
            yield from out(kept)
        kept = []
        release()

    return docs.mapInArrow(run, schema)


def release() -> None:
    """Give freed memory back at the end of a task: workers live on, and share an executor with later stages."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)
