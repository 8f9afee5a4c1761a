"""Schemas of stored tables and inputs."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, LongType, StringType, StructField, StructType

_SIMPLE = {"STRING": StringType(), "INT": IntegerType(), "BIGINT": LongType(), "BOOLEAN": BooleanType()}


def _fields(text: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, ch in enumerate(text + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(text[last:i].strip())
            last = i + 1
    return out


def _type(text: str) -> DataType:
    if text.startswith("ARRAY<"):
        return ArrayType(_type(text[6:-1]))
    if text.startswith("STRUCT<"):
        return StructType([StructField(n, _type(t)) for n, _, t in (f.partition(":") for f in _fields(text[7:-1]))])
    return _SIMPLE[text]


def schema(text: str) -> StructType:
    """A schema from DDL; unlike Spark's own reader it needs no session, so modules can hold schemas."""
    return StructType([StructField(n, _type(t)) for n, _, t in (f.partition(" ") for f in _fields(text))])


SESSIONS = schema(
    "session_id STRING, project STRING, cwd STRING, transcript_path STRING, started_at STRING, ended_at STRING, "
    "prompt_count INT, tool_call_count INT, status STRING, content_bytes BIGINT, prompts ARRAY<STRING>, tool_seq ARRAY<STRING>, "
    "tool_calls ARRAY<STRUCT<name:STRING,digest:STRING,ts:STRING>>, minhash ARRAY<BIGINT>, indexed_at STRING"
)
CLUSTERS = schema(
    "cluster_id BIGINT, fingerprint STRING, status STRING, first_day STRING, last_day STRING, session_count INT, project STRING, "
    "title_hint STRING, blueprint_id STRING, last_pushed_at STRING, last_pushed_checksum STRING, dismissed_count INT, updated_at STRING"
)
MEMBERS = schema("cluster_id BIGINT, session_id STRING")
PROPOSAL = schema(
    "proposal_version INT, source STRING, fingerprint STRING, title STRING, summary STRING, "
    "kickoff_fields ARRAY<STRUCT<label:STRING,type:STRING,required:BOOLEAN,options:ARRAY<STRING>,evidence:STRING>>, "
    "steps ARRAY<STRUCT<position:INT,title:STRING,description:STRING,executor_hint:STRING>>"
)
PROPOSALS = schema("proposal_id BIGINT, fingerprint STRING, source STRING, draft_json STRING, status STRING, created_at STRING")
META = schema("key STRING, value STRING")
QUEUE = schema("session_id STRING, transcript_path STRING, cwd STRING, reason STRING, enqueued_at STRING")

TABLES = {"sessions": SESSIONS, "clusters": CLUSTERS, "members": MEMBERS, "proposals": PROPOSALS, "meta": META}

# Fixed values.
SESSION_STATUSES = ("indexed", "trivial", "ignored", "missing", "parse_failed")
CLUSTER_PRIORITY = {"pushed": 5, "proposed": 4, "dismissed": 3, "candidate": 2, "forming": 1}
MARK_STATUSES = ("candidate", "proposed", "pushed", "dismissed")
# End of fixed values.
