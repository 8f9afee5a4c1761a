"""The engine: indexing, clustering, review, and the read surface, over a store of snapshots."""

from __future__ import annotations

import json
import logging
import platform
import re
from datetime import UTC, datetime
from logging.handlers import RotatingFileHandler
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as configuration
from ..config import Rules
from ..functions import digests, redact
from ..operators import groups, index, lifecycle, tables
from ..schemas import MARK_STATUSES, META, PROPOSALS
from ..sources import documents, queue, transcripts
from ..sources.scratch import Scratch
from ..sources.store import Store

SWEEP = 500
SUMMARY = ("fingerprint", "status", "sessions", "first_day", "last_day", "project", "title_hint", "blueprint_id")
#: Transcripts that are read at once: the driver holds so many paths.
BLOCK = 5000
FIELD_TYPES = ("short_text", "long_text", "file", "date", "dropdown")
_KEYS = {"proposal_version", "source", "fingerprint", "title", "summary", "kickoff_fields", "steps"}


def log_to(path: str, most: int = 512 * 1024) -> logging.Logger:
    """The engine's log, rotated once it has ``most`` bytes."""
    log = logging.getLogger("recurra")
    if not any(getattr(h, "baseFilename", None) == str(Path(path).absolute()) for h in log.handlers):
        handler = RotatingFileHandler(path, maxBytes=most, backupCount=1, encoding="utf-8")
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(handler)
        log.setLevel(logging.INFO)
    return log


class SecretsFound(Exception):
    def __init__(self, findings: list):
        super().__init__(f"{len(findings)} secrets in the draft")
        self.findings = findings


def problems(draft: dict) -> list[str]:
    """What is wrong with a proposal by its schema; empty if nothing is."""
    out = []
    if set(draft) != _KEYS:
        out.append("keys")
    if draft.get("proposal_version") != 1 or draft.get("source") not in ("detected", "import"):
        out.append("version or source")
    if not re.fullmatch(r"[0-9a-f]{12}", str(draft.get("fingerprint", ""))):
        out.append("fingerprint")
    fields, steps = draft.get("kickoff_fields") or [], draft.get("steps") or []
    for f in fields:
        options = f.get("options") or []
        if f.get("type") not in FIELD_TYPES or bool(options) != (f.get("type") == "dropdown") or options and not 2 <= len(options) <= 8:
            out.append(f"field {f.get('label')}")
    if [s.get("position") for s in steps] != list(range(1, len(steps) + 1)):
        out.append("positions")
    labels = {f.get("label") for f in fields}
    for s in steps:
        if s.get("executor_hint") not in ("ai", "human") or set(re.findall(r"\{\{(.+?)\}\}", s.get("description") or "")) - labels:
            out.append(f"step {s.get('position')}")
    return out


def _is_date(value: str) -> bool:
    for form in ("%Y-%m-%d", "%Y/%m/%d", "%d.%m.%Y", "%m/%d/%Y", "%d %B %Y", "%B %d, %Y"):
        try:
            datetime.strptime(value.strip(), form)
            return True
        except ValueError:
            continue
    return False


def derived_field(label: str, observed: list[str]) -> dict:
    """A kick-off field from the values seen for one input (O7): rules in order; a dropdown has exactly the values seen."""
    values = list(dict.fromkeys(observed))
    if values and all(map(_is_date, values)):
        kind = "date"
    elif values and all(re.fullmatch(r"(?:\S*[/\\])?[\w.-]+\.[A-Za-z0-9]{1,5}", v) for v in values):
        kind = "file"
    elif 2 <= len(values) <= 8 and len(values) < len(observed):
        return {"label": label, "type": "dropdown", "options": values}
    else:
        kind = "short_text" if all(len(v) <= 100 and "\n" not in v for v in values) else "long_text"
    return {"label": label, "type": kind, "options": []}


def leaves(value) -> list[str]:
    """All texts in a JSON value, keys too."""
    if isinstance(value, str):
        return [value]
    if isinstance(value, list):
        return [x for v in value for x in leaves(v)]
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in (k, *leaves(v))]
    return []


class Engine:
    def __init__(self, spark: SparkSession, root: str, config_path: str | None = None, clock=None, log_path: str | None = None):
        self.log = log_to(log_path) if log_path else logging.getLogger("recurra")
        self.spark, self.root, self.config_path = spark, root, config_path or f"{root}/config.json"
        self.store = Store(spark, root)
        self.clock = clock or (lambda: datetime.now(UTC))

    # -- settings

    @property
    def config(self) -> dict:
        return configuration.load(self.config_path)

    @property
    def rules(self) -> Rules:
        return Rules.of(self.config)

    def config_set(self, key: str, value: str) -> dict:
        return configuration.put(self.config_path, key, value)

    def now(self) -> str:
        return self.clock().strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"

    def meta(self, key: str) -> str | None:
        row = self.store.read("meta").where(F.col("key") == key).select("value").first()
        return row[0] if row else None

    def set_meta(self, **values) -> None:
        new = self.spark.createDataFrame([(k, None if v is None else str(v)) for k, v in values.items()], META)
        self.store.write("meta", tables.upsert(self.store.read("meta"), new, ["key"]))

    # -- writing

    def index(self, entries: DataFrame, block: int = BLOCK) -> None:
        """Entries (session_id, transcript_path, cwd), one for each session, into the table of sessions.

        Spark's reader takes its paths from the driver, so transcripts are read ``block`` at a time; the table is written once.
        """
        scratch = Scratch(self.spark)
        entries = scratch.save(entries.select("session_id", "transcript_path", "cwd"), "entries")
        n = entries.count() // block + 1
        rows = None
        for k in range(n):
            some = entries.where(F.pmod(F.xxhash64("session_id"), F.lit(n)) == k) if n > 1 else entries
            part = scratch.save(index.session_rows(some, transcripts.parsed(self.spark, some), self.rules, self.now()), "sessions")
            rows = part if rows is None else rows.unionByName(part)
        self.store.write("sessions", tables.upsert(self.store.read("sessions"), rows, ["session_id"]))
        for r in rows.groupBy("status").count().collect():
            self.log.info("indexed: %s %s", r["count"], r["status"])

    def recluster(self) -> None:
        """Groups of all indexed sessions anew, then reconciled with the stored clusters."""
        scratch = Scratch(self.spark)
        facts, fresh = groups.described_groups(self.store.read("sessions").where("status = 'indexed'"), self.rules, scratch)
        fresh = scratch.save(fresh, "fresh")
        clusters, members = lifecycle.reconcile(facts, fresh, self.store.read("clusters"), self.store.read("members"), self.now(), scratch)
        members = scratch.save(members, "members")
        self.store.write("clusters", clusters)
        self.store.write("members", members)

    def drain(self, batch: DataFrame) -> None:
        """A batch of queue entries: the last of each session counts."""
        last = tables.latest(batch, ["session_id"], [F.desc("enqueued_at"), F.desc("transcript_path"), F.desc("cwd")])
        self.index(last)

    def run(self, queue_dir: str | None = None, projects_root: str | None = None, deep: bool = False) -> dict:
        self.log.info("run: %s", "deep" if deep else "queue")
        remaining = self.meta("deep_remaining")
        taken = queue.files(self.spark, queue_dir) if queue_dir else []
        if taken:
            batch = Scratch(self.spark).save(queue.queued(self.spark, queue_dir), "queue")
            bad = len(taken) - batch.select("file").distinct().count()
            if bad:
                self.log.error("queue: %s entries of %s could not be read or have no session id", bad, len(taken))
            self.drain(batch)
            queue.remove(self.spark, taken)  # once only, whether it could be read or not
        if deep and projects_root:
            remaining = self.sweep(projects_root)
        self.recluster()
        self.set_meta(last_run_at=self.now(), last_run_kind="deep" if deep else "queue", deep_remaining=remaining)
        return {"ok": True, "last_run_at": self.meta("last_run_at"), "deep_remaining": remaining}

    def sweep(self, projects_root: str, limit: int = SWEEP) -> int:
        """The oldest transcripts that are unknown or have grown; returns how many are left."""
        todo = tables.to_index(transcripts.listing(self.spark, projects_root), self.store.read("sessions").select("session_id", "content_bytes"))
        todo = Scratch(self.spark).save(todo, "todo")
        batch = tables.sweep(todo, limit)
        self.index(batch.select("session_id", transcripts.plain_path("transcript_path").alias("transcript_path"), F.lit(None).cast("string").alias("cwd")))
        return max(0, todo.count() - limit)

    # -- review

    def mark(self, fingerprint: str, status: str, blueprint_id: str | None = None, checksum: str | None = None) -> dict:
        if status not in MARK_STATUSES:
            raise ValueError(f"status must be one of {', '.join(MARK_STATUSES)}")
        clusters = self.store.read("clusters")
        if clusters.where(F.col("fingerprint") == fingerprint).isEmpty():
            last = clusters.agg(F.max("cluster_id")).first()[0] or 0
            names = clusters.columns
            row = dict.fromkeys(names) | {"cluster_id": last + 1, "fingerprint": fingerprint, "status": "proposed", "session_count": 0, "dismissed_count": 0, "updated_at": self.now()}
            clusters = clusters.unionByName(self.spark.createDataFrame([tuple(row[c] for c in names)], clusters.schema))
        self.store.write("clusters", tables.marked(clusters, fingerprint, status, self.now(), blueprint_id, checksum))
        return {"ok": True, "fingerprint": fingerprint, "status": status}

    def findings(self, text: str) -> list[dict]:
        row = self.spark.createDataFrame([(text,)], "t STRING").select(redact.findings(F.col("t")).alias("f")).first()
        return [x.asDict() for x in row["f"]]

    def save_proposal(self, fingerprint: str, draft: dict, source: str = "detected") -> dict:
        """Refuses a draft with secrets. Texts are tested one by one, not in their escaped form."""
        found = [f for leaf in leaves(draft) for f in self.findings(leaf)]
        if found:
            raise SecretsFound(found)
        old = self.store.read("proposals")
        last = old.agg(F.max("proposal_id")).first()[0] or 0
        new = self.spark.createDataFrame([(last + 1, fingerprint, source, json.dumps(draft), "draft", self.now())], PROPOSALS)
        self.store.write("proposals", old.unionByName(new))
        self.spark.createDataFrame([(json.dumps(draft, indent=2),)], "value STRING").coalesce(1).write.mode("overwrite").text(f"{self.root}/drafts/{transcripts.safe_name(fingerprint)}")
        return {"ok": True, "fingerprint": fingerprint}

    def proposal(self, fingerprint: str) -> dict | None:
        row = self.store.read("proposals").where(F.col("fingerprint") == fingerprint).orderBy(F.desc("proposal_id")).first()
        return None if row is None else {"fingerprint": fingerprint, "source": row["source"], "status": row["status"], "created_at": row["created_at"], "draft": json.loads(row["draft_json"])}

    # -- reading

    def session(self, session_id: str) -> DataFrame:
        """The row of one session (S7); no row if it is unknown."""
        return self.store.read("sessions").where(F.col("session_id") == session_id)

    def doctor(self) -> dict:
        return {"spark": pyspark.__version__, "python": platform.python_version(), "data_dir": self.root, "config": self.config}

    def summaries(self, *statuses: str) -> DataFrame:
        """Clusters by age (P14), of ``statuses`` if any are given."""
        c = self.store.read("clusters").orderBy("cluster_id")
        c = c.where(F.col("status").isin(*statuses)) if statuses else c
        return c.withColumnRenamed("session_count", "sessions").withColumn("blueprint_id", F.expr("nullif(blueprint_id, '')")).select(*SUMMARY)

    def pending(self) -> DataFrame:
        return self.summaries("candidate", "proposed")

    def status(self) -> dict:
        counts = {r[0]: r[1] for r in tables.status_counts(self.store.read("sessions")).collect()}
        rows = [r.asDict() for r in self.summaries().collect()]
        failed = counts.get("parse_failed", 0)
        return {
            "sessions": counts,
            "parse_warning": f"{failed} session(s) could not be parsed; the log format may have changed" if failed else None,
            **{s: [r for r in rows if r["status"] == s] for s in ("candidate", "forming", "proposed", "pushed")},
            "dismissed": sum(r["status"] == "dismissed" for r in rows),
            **{k: self.meta(k) for k in ("last_run_at", "last_run_kind", "deep_remaining")},
        }

    def cluster(self, fingerprint: str) -> DataFrame:
        """Members with their evidence; a session that is gone shows with its id only."""
        c = self.store.read("clusters").where(F.col("fingerprint") == fingerprint)
        m = c.select("cluster_id").join(self.store.read("members"), "cluster_id").select("cluster_id", "session_id")
        out = tables.evidence(m, self.store.read("sessions")).drop("cluster_id")
        paths = [r[0] for r in out.where("transcript_path IS NOT NULL").select("transcript_path").distinct().collect()]  # of one cluster
        there = transcripts.on_disk(self.spark, paths)
        return out.withColumn("transcript_still_on_disk", F.coalesce(F.col("transcript_path").isin(there), F.lit(False))).orderBy("session_id")

    def redact_check(self, path: str) -> DataFrame:
        return redact.find_secrets(documents.documents(self.spark, path), "text", ["path"])

    def fingerprint_text(self, path: str) -> DataFrame:
        return documents.documents(self.spark, path).select("path", digests.fingerprint_text(F.col("text")).alias("fingerprint"))
