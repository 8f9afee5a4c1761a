"""The queue: one small JSON file for each session that ended."""

from __future__ import annotations

import json
import os
import time
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import QUEUE
from .transcripts import safe_name


def enqueue(queue_dir: str | Path, payload: str | dict, now: datetime | None = None) -> Path:
    """Write an entry; one for the same session replaces it. A payload that can't be read gets an id of its own."""
    if isinstance(payload, str):
        try:
            payload = json.loads(payload)
        except ValueError:
            payload = {}
    if not isinstance(payload, dict):
        payload = {}
    session_id = str(payload.get("session_id") or f"unknown-{int(time.time() * 1000)}")
    stamp = (now or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
    entry = {"session_id": session_id, **{k: payload.get(k) or None for k in ("transcript_path", "cwd", "reason")}, "enqueued_at": stamp}
    folder = Path(queue_dir)
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / f"{safe_name(session_id)}.json"
    part = path.with_suffix(".part")  # a reader never sees half a file
    part.write_text(json.dumps(entry), "utf-8")
    os.replace(part, path)
    return path


def _valid(df: DataFrame) -> DataFrame:
    return df.where(F.col("session_id").isNotNull() & (F.col("session_id") != ""))


def queued(spark: SparkSession, queue_dir: str) -> DataFrame:
    """All entries in the order of file names, with the name; unreadable ones and those without id drop out."""
    raw = spark.read.schema(QUEUE).option("pathGlobFilter", "*.json").option("mode", "PERMISSIVE").option("multiLine", True).json(queue_dir)
    return _valid(raw.withColumn("file", F.col("_metadata.file_name"))).orderBy("file")


def files(spark: SparkSession, queue_dir: str) -> list[str]:
    """Paths of the entries, by name, on any file system that Spark knows. Names only come to the driver, as Spark lists them there too."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{queue_dir}/*.json")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(str(f.getPath().toString()) for f in found or [])


def remove(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, False)


def queue_stream(spark: SparkSession, queue_dir: str, max_files: int = 500) -> DataFrame:
    """The same as a stream. A file is taken once: a bad one is gone after one attempt."""
    raw = spark.readStream.schema(QUEUE).option("pathGlobFilter", "*.json").option("mode", "PERMISSIVE").option("multiLine", True).option("maxFilesPerTrigger", max_files)
    return _valid(raw.json(queue_dir))
