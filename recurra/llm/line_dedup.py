"""Line dedup over levelled sorted runs of line hashes; DataFrame operations only.

A run is a table (h1, h2, n_rows, n_docs, last_doc), bucketed and sorted by the 128-bit line hash. Each batch of documents is
merge-anti-joined with the runs: keys in none of them are its own new run, counts of the others are added to the table of
updates. So a key is in one run only, and runs of a level are compacted by merging, without adding up. Batches
hold disjoint sets of doc_id, so counts add up over batches. Joins among runs, batches and updates need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, Scratch, SortedTable, ascii_lower, free_names, hash128, join_lookup, spread, table

MIN_POINTS = 20
MIN_DOCS = 3
BATCHES = 3
FANOUT = 2
KEY = ["h1", "h2"]
COUNTS = ("n_rows", "n_docs", "last_doc")


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(ASCII_SPACE)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keyed_lines(docs: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """(doc_id, t1, t2, pos, h1, h2) for each line whose key has at least ``min_points`` code points."""
    t1, t2 = hash128(F.coalesce("text", F.lit("")))
    h1, h2 = hash128(F.col("key"))
    rows = docs.select("doc_id", t1.alias("t1"), t2.alias("t2"), F.posexplode(F.transform(lines_of(F.col("text")), line_key)).alias("pos", "key"))
    return rows.where(F.length("key") >= min_points).select("doc_id", "t1", "t2", "pos", h1.alias("h1"), h2.alias("h2"))


class LineRuns:
    """Levelled sorted runs in the shared folder, and the counts that later batches add to their keys."""

    def __init__(self, scratch: Scratch, fanout: int = FANOUT):
        self.scratch, self.fanout = scratch, fanout
        self.buckets = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[SortedTable]] = []
        self.updates: SortedTable | None = None

    @property
    def runs(self) -> list[SortedTable]:
        return [r for level in self.levels for r in level]

    def _save(self, df: DataFrame, name: str) -> SortedTable:
        return SortedTable(self.scratch, df, KEY, self.buckets, name)

    def _add_run(self, run: SortedTable, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            merged = full[0]
            for other in full[1:]:
                # keys of runs are disjoint: the full outer join is a merge, bucket by bucket
                both = merged.read().alias("a").join(other.read().hint("merge").alias("b"), KEY, "full_outer")
                new = self._save(both.select(*KEY, *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in COUNTS]), "run")
                merged.drop()
                other.drop()
                merged = new
            self._add_run(merged, level + 1)

    def _add_updates(self, known: DataFrame) -> None:
        if self.updates is None:
            self.updates = self._save(known, "updates")
            return
        both = self.updates.read().alias("a").join(known.hint("merge").alias("b"), KEY, "full_outer")
        total = [(F.coalesce(f"a.{c}", F.lit(0)) + F.coalesce(f"b.{c}", F.lit(0))).alias(c) for c in COUNTS[:2]]
        new = self._save(both.select(*KEY, *total, F.greatest("a.last_doc", "b.last_doc").alias("last_doc")), "updates")
        self.updates.drop()
        self.updates = new

    def add(self, lines: DataFrame) -> None:
        """Add a batch of keyed lines; the merge anti-join with all runs decides which keys are its new run."""
        per_doc = lines.groupBy(*KEY, "doc_id").agg(F.count("*").alias("n_rows"))
        own = per_doc.groupBy(*KEY).agg(F.sum("n_rows").alias("n_rows"), F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        # dealt here, so that each bucket is one sorted file
        own = self._save(own.repartition(self.buckets, *KEY), "batch")
        if not self.runs:
            self._add_run(own, 0)
            return
        novel = own.read()
        for run in self.runs:
            novel = novel.join(run.read().select(*KEY).hint("merge"), KEY, "left_anti")
        known = [own.read().join(run.read().select(*KEY).hint("merge"), KEY, "left_semi") for run in self.runs]
        for part in known:  # runs are disjoint, so a known key is in one part
            self._add_updates(part)
        self._add_run(self._save(novel, "run"), 0)
        own.drop()

    def repeated(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """(h1, h2, n_rows, last_doc) of keys in at least ``min_docs`` documents."""
        out = None
        for run in self.runs:
            r = run.read()
            if self.updates is not None:
                u = self.updates.read().select(*KEY, *[F.col(c).alias(f"u_{c}") for c in COUNTS])
                r = r.join(u.hint("merge"), KEY, "left")
                r = r.withColumns({c: F.col(c) + F.coalesce(f"u_{c}", F.lit(0)) for c in COUNTS[:2]} | {"last_doc": F.greatest("last_doc", "u_last_doc")})
            r = r.where(F.col("n_docs") >= min_docs).select(*KEY, "n_rows", "last_doc")
            out = r if out is None else out.unionByName(r)
        return out

    def drop(self) -> None:
        for t in [*self.runs, *([self.updates] if self.updates else [])]:
            t.drop()


def _lines_that_go(lines: DataFrame, keys: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``lines`` whose key is in ``keys`` (h1, h2, n_rows, last_doc) and whose document isn't the key's last one."""
    met = join_lookup(lines, scratch.save(keys, "repeated"), KEY, "n_rows", lines.count())
    return met.where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("last_doc")))


def dedup_lines(docs: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """Drop lines whose key is in at least ``min_docs`` documents, but not in the largest doc_id that holds it.

    Adds to every row of ``docs`` n_lines, n_dropped and kept_text; other columns stay, whatever their names, and same-named
    ones are replaced. Null or empty text: one empty line, kept. A null doc_id counts as no document and never holds a key,
    so its repeated lines go. Rows that repeat a doc_id count as one document. Lines of the holder stay, repeats
    included. An empty table gives no rows. No length limit.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    d, u1, u2, gone_at = free_names(docs, "d", "t1", "t2", "gone")
    slim = docs.select("doc_id", "text")
    lines = scratch.save(keyed_lines(slim, min_points), "lines")
    runs = LineRuns(scratch, fanout)
    for b in range(batches):
        runs.add(lines.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == b))
    gone = _lines_that_go(lines, runs.repeated(min_docs), scratch)
    runs.drop()  # their repeated keys are written
    gone = gone.groupBy(F.col("doc_id").alias(d), F.col("t1").alias(u1), F.col("t2").alias(u2)).agg(F.collect_set("pos").alias(gone_at))
    t1, t2 = hash128(F.coalesce("text", F.lit("")))
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(d)) & (t1 == F.col(u1)) & (t2 == F.col(u2)), "left")
    lines_c = lines_of(F.col("text"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines_c) - 1), F.col(gone_at))
    text = F.when(F.col(gone_at).isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines_c, i)), "\n"))
    return joined.withColumns({"n_lines": F.size(lines_c).cast("long"), "n_dropped": F.when(F.col(gone_at).isNull(), 0).otherwise(F.size(gone_at)).cast("long"), "kept_text": text}).drop(d, u1, u2, gone_at)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, n_lines, n_dropped, kept_sha256; rules and edge cases as in ``dedup_lines``."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), g AS (
  SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.doc_id, k.pos, k.line, g.key IS NOT NULL AND k.doc_id < g.last_doc AS gone
  FROM k LEFT JOIN g ON k.key = g.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
