"""Transcripts: discovery, and one parsed row for each file.

A transcript is a text file of JSON entries, one a line, of at most 64 MiB. A file is read, decoded and folded where it
lies, in one Arrow-batched step, so its text is never shuffled; strict JSON and the digests of arguments need Python anyway.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.digests import digest
from ..functions.text import WRAPPERS
from ..schemas import schema

# Fixed values.
MAX_BYTES = 64 * 1024 * 1024
MIN_LINES, MAX_SKIPPED = 10, 0.2
# End of fixed values.
_SPACE = "\t\n\x0b\x0c\r                  　﻿"

FOLDED = schema(
    "status STRING, prompts ARRAY<STRING>, tool_calls ARRAY<STRUCT<name:STRING,digest:STRING,ts:STRING>>, started_at STRING, ended_at STRING, "
    "cwd STRING, line_count INT, skipped INT, other_types INT, note STRING"
)


def _no_constant(name: str):
    raise ValueError(name)


def strict_json(line: str):
    return json.loads(line, parse_constant=_no_constant)


def _is_prompt(text: str) -> bool:
    return bool(text) and not text.lstrip(_SPACE).startswith(WRAPPERS)


def prompt_of(entry: dict) -> str | None:
    """What a person wrote in a user entry; none for meta entries, tool results and wrappers."""
    content = entry["message"]["content"]
    if entry.get("isMeta") is True:
        return None
    if isinstance(content, str):
        return content if _is_prompt(content) else None
    items = [c for c in content if isinstance(c, dict)]
    if any(c.get("type") == "tool_result" for c in items):
        return None
    texts = [c["text"] for c in items if c.get("type") == "text" and isinstance(c.get("text"), str) and _is_prompt(c["text"])]
    return "\n".join(texts) if texts else None


def calls_of(entry: dict) -> list[dict]:
    ts = entry.get("timestamp") if isinstance(entry.get("timestamp"), str) else None
    items = [c for c in entry["message"]["content"] if isinstance(c, dict)]
    return [{"name": c["name"], "digest": digest(c.get("input")), "ts": ts} for c in items if c.get("type") == "tool_use" and isinstance(c.get("name"), str)]


def fold(text: str) -> dict:
    """A session from the lines of a transcript; never raises."""
    prompts, calls, stamps = [], [], []
    cwd, lines, skipped, others = None, 0, 0, 0
    for raw in text.split("\n"):
        line = raw.strip(_SPACE)
        if not line:
            continue
        lines += 1
        try:
            entry = strict_json(line)
        except (ValueError, RecursionError):
            entry = None
        if not isinstance(entry, dict) or not isinstance(entry.get("type"), str):
            skipped += 1
            continue
        if isinstance(entry.get("timestamp"), str):
            stamps.append(entry["timestamp"])
        if cwd is None and isinstance(entry.get("cwd"), str) and entry["cwd"]:
            cwd = entry["cwd"]
        kind = entry["type"]
        if kind not in ("user", "assistant"):
            others += 1
            continue
        message = entry.get("message")
        content = message.get("content") if isinstance(message, dict) and message.get("role") == kind else None
        if not isinstance(content, list) and not (kind == "user" and isinstance(content, str)):
            skipped += 1
        elif kind == "assistant":
            calls += calls_of(entry)
        elif (prompt := prompt_of(entry)) is not None:
            prompts.append(prompt)
    failed = lines >= MIN_LINES and skipped / lines > MAX_SKIPPED
    return {
        "status": "parse_failed" if failed else "ok",
        "prompts": prompts,
        "tool_calls": calls,
        "started_at": min(stamps, default=None),
        "ended_at": max(stamps, default=None),
        "cwd": cwd,
        "line_count": lines,
        "skipped": skipped,
        "other_types": others,
        "note": f"{skipped} of {lines} lines were not recognized; the log format may have changed" if failed else None,
    }


@F.pandas_udf(FOLDED)
def fold_file(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([fold(bytes(c).decode("utf-8", "replace")) for c in content], columns=FOLDED.fieldNames())


def listing(spark: SparkSession, root: str) -> DataFrame:
    """session_id, transcript_path, size, mtime of <root>/<folder>/*.jsonl, one level deep; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(f"{root}/*/*.jsonl")
    name = F.regexp_extract("path", r"([^/]*)\.jsonl$", 1)
    return files.select(name.alias("session_id"), F.col("path").alias("transcript_path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def discovered(spark: SparkSession, root: str) -> DataFrame:
    return listing(spark, root).orderBy("mtime", "session_id")


def plain_path(c):
    return F.regexp_replace(c, "^file:(//)?(?=/)", "")


def on_disk(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of ``paths`` that are files, in any file system that Spark knows."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        try:
            if path.getFileSystem(conf).isFile(path):
                out.append(p)
        except Exception:  # a path of no known file system is missing too
            continue
    return out


def parsed(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """paths (transcript_path) -> transcript_path, content_bytes and the folded columns; unreadable paths are ``missing``.

    Files over the cap are not read. The list of paths comes to the driver, as Spark's reader takes it from there: a batch of
    a sweep holds 500.
    """
    wanted = paths.where("transcript_path IS NOT NULL").select("transcript_path").distinct()
    here = [r[0] for r in wanted.collect()]
    there = on_disk(spark, here)
    empty = FOLDED.fieldNames()
    if there:
        files = spark.read.format("binaryFile").load(there).select(plain_path("path").alias("transcript_path"), F.col("length").alias("content_bytes"), "content")
        small = files.where(F.col("content_bytes") <= MAX_BYTES).withColumn("f", fold_file("content"))
        small = small.select("transcript_path", "content_bytes", *[F.col(f"f.{c}").alias(c) for c in empty])
        nothing = {c: F.lit(None).cast(FOLDED[c].dataType) for c in empty}
        large = files.where(F.col("content_bytes") > MAX_BYTES).select("transcript_path", "content_bytes")
        large = large.select("*", *[v.alias(c) for c, v in (nothing | {"status": F.lit("parse_failed"), "note": F.lit("larger than the cap"), "line_count": F.lit(0), "skipped": F.lit(0), "other_types": F.lit(0)}).items()])
        found = small.unionByName(large)
    else:
        found = spark.createDataFrame([], StructType(schema("transcript_path STRING, content_bytes BIGINT").fields + FOLDED.fields))
    out = wanted.withColumn("_p", plain_path("transcript_path")).join(found.withColumnRenamed("transcript_path", "_p"), "_p", "left").drop("_p")
    return out.withColumns({"status": F.coalesce("status", F.lit("missing")), "content_bytes": F.coalesce("content_bytes", F.lit(0))})


def safe_name(session_id: str) -> str:
    return re.sub(r"[^A-Za-z0-9_-]", "-", session_id)
