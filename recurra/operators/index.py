"""From queue entries and parsed transcripts to session rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Rules
from ..functions.redact import redacted
from ..functions.sketch import signature
from ..functions.text import session_text
from ..schemas import SESSIONS


def is_ignored(cwd: Column, rules: Rules) -> Column:
    """A plain prefix test: /a/b ignores /a/bc too."""
    out = F.lit(False)
    for p in rules.ignore_projects:
        out = out | F.coalesce(cwd.startswith(p), F.lit(False))
    return out


def duration_seconds(start: Column, end: Column) -> Column:
    """Between two time texts; 0 if either can't be read, or if the end is first."""
    ms = F.unix_millis(F.try_to_timestamp(end)) - F.unix_millis(F.try_to_timestamp(start))
    return F.coalesce(F.greatest(F.lit(0.0), ms / 1000.0), F.lit(0.0))


def session_rows(entries: DataFrame, parsed: DataFrame, rules: Rules, now: str) -> DataFrame:
    """entries (session_id, transcript_path, cwd), parsed by path -> rows of the table of sessions.

    Only listed columns leave: redacted prompts, names and digests of tools, times and counts.
    """
    e = entries.where("session_id IS NOT NULL AND session_id <> ''").select("session_id", F.expr("nullif(transcript_path, '')").alias("transcript_path"), F.expr("nullif(cwd, '')").alias("given"))
    j = e.join(parsed.withColumnRenamed("cwd", "found").withColumnRenamed("status", "parse"), "transcript_path", "left")
    early = is_ignored(F.col("given"), rules)
    j = j.withColumn("cwd", F.when(early | F.col("transcript_path").isNull(), F.col("given")).otherwise(F.coalesce("given", "found")))
    ok = F.col("parse") == "ok"
    n_prompts, n_calls = F.coalesce(F.size("prompts"), F.lit(0)), F.coalesce(F.size("tool_calls"), F.lit(0))
    trivial = (n_prompts < rules.min_prompts) | ((n_calls == 0) & (duration_seconds(F.col("started_at"), F.col("ended_at")) < rules.min_duration_seconds))
    status = (
        F.when(early, "ignored")
        .when(F.col("transcript_path").isNull(), "missing")
        .when(is_ignored(F.col("cwd"), rules), "ignored")
        .when(F.col("parse").isNull() | (F.col("parse") == "missing"), "missing")
        .when(~ok, "parse_failed")
        .when(trivial, "trivial")
        .otherwise("indexed")
    )
    j = j.withColumn("status", status)
    kept = F.col("status").isin("trivial", "indexed")
    j = j.withColumn("clean", F.when(kept, F.transform("prompts", redacted)))
    j = j.withColumn("norm", F.when(F.col("status") == "indexed", session_text(F.col("clean"))))
    stamps = F.col("status") != "ignored"
    return j.select(
        "session_id",
        F.coalesce("cwd", F.lit("unknown")).alias("project"),
        "cwd",
        "transcript_path",
        F.when(stamps, F.col("started_at")).alias("started_at"),
        F.when(stamps, F.col("ended_at")).alias("ended_at"),
        F.when(kept, n_prompts).otherwise(0).alias("prompt_count"),
        F.when(kept, n_calls).otherwise(0).alias("tool_call_count"),
        "status",
        # bytes are kept for ignored sessions too, so that a sweep doesn't read them again each time
        F.coalesce("content_bytes", F.lit(0)).alias("content_bytes"),
        F.col("clean").alias("prompts"),
        F.when(kept, F.transform("tool_calls", lambda c: c["name"])).alias("tool_seq"),
        F.when(kept, F.col("tool_calls")).alias("tool_calls"),
        signature("norm").alias("minhash"),
        F.lit(now).alias("indexed_at"),
    ).select(*SESSIONS.fieldNames())
