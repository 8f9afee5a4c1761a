"""Exact dedup of byte strings by distributed prefix doubling over sampled positions.

The rank of a position at a length is the fingerprint of the bytes there; at a greater length it is the pair of its rank and the
rank of a position further on: rank_m(p) = (rank_n(p), rank_n(p + m - n)) for n < m <= 2n. Spark groups the pairs and
drops those that are unique, at growing lengths up to the threshold.

Ranking every byte at every length would move many times the input, so positions are handled in intervals:

* Each window of ``threshold`` bytes has an anchor: the first smallest fingerprint of its ``START``-byte strings. Equal windows
  have equal anchors at equal offsets, so windows are compared only under one anchor rank. The windows of consecutive
  positions mostly share an anchor, and are one interval.
* An interval whose anchor rank is unique has no repeated window. Intervals with equal unions of windows are repeated
  as a whole, and one of them stands for all.
* What is left is cut into blocks of offsets, ever smaller. A block goes on only while the rank of what all its windows share
  is not unique, and is done once its union of windows is repeated. Blocks of one offset are single windows.

No pairs of documents are formed. Only hashes are shuffled, but for the texts themselves, which meet their intervals twice.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, free_names, map_blocks, spread, table
from .fingerprints import Prefixes, scramble, window_minima

THRESHOLD = 400
#: Texts are read in pieces of so many windows, which bounds memory; a cut makes two intervals of one, as a text's end does.
PIECE = 1 << 20


def start_length(threshold: int) -> int:
    return (threshold + 1) // 2


def block_sizes(threshold: int) -> list[int]:
    """Sizes of blocks of offsets, down to 1."""
    return [b for b in (32, 4) if b < threshold - start_length(threshold)] + [1]


def intervals(data: bytes, threshold: int):
    """(start, width, anchor rank, offset of the anchor, two fingerprints of the union of windows), by anchor."""
    n = start_length(threshold)
    p = Prefixes(data)
    rank = scramble(p.all_windows(n))
    anchor = window_minima(rank, threshold - n + 1)
    start = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    last = np.concatenate((start[1:], [len(anchor)])) - 1
    a = anchor[start]
    whole = p.windows(start, last + threshold - start)
    tail = scramble(p.windows(last, np.full(len(last), threshold)))
    return start, last - start + 1, rank[a], a - start, whole, tail


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _interval_rows(docs: DataFrame, threshold: int, piece: int = PIECE) -> DataFrame:
    names = ["doc_id", "t", "start", "width", "g", "off", "s1", "s2"]

    def run(batches):
        for b in batches:
            out, size = [], 0
            for doc, t, text in zip(b.column("doc_id").to_pylist(), b.column("t").to_pylist(), b.column("text")):
                data = text.as_buffer() if text.is_valid else b""
                for at in range(0, len(data) - threshold + 1, piece):
                    start, width, g, off, s1, s2 = intervals(bytes(data[at : at + piece + threshold - 1]), threshold)
                    k = len(start)
                    out.append([pa.array([doc] * k, pa.int64()), pa.array(np.full(k, t)), pa.array((start + at).astype(np.int32)), pa.array(width.astype(np.int32)), _signed(g), pa.array(off.astype(np.int32)), _signed(s1), _signed(s2)])
                    size += k
                    if size >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*out)], names)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*out)], names)

    return docs.mapInArrow(run, "doc_id bigint, t bigint, start int, width int, g bigint, off int, s1 bigint, s2 bigint")


def _contexts(docs: DataFrame, reps: DataFrame, threshold: int) -> DataFrame:
    """The union of windows of each interval in ``reps`` (doc_id, t, start, width, g, off, lone)."""
    per_doc = reps.groupBy(F.col("doc_id").alias("_d"), F.col("t").alias("_t")).agg(F.collect_list(F.struct("start", "width", "g", "off", "lone")).alias("_at"))
    joined = docs.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t"))).select("doc_id", "t", "text", "_at")

    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            for doc, t, text, at in zip(b.column("doc_id").to_pylist(), b.column("t").to_pylist(), b.column("text"), b.column("_at").to_pylist()):
                data = text.as_buffer().to_pybytes()
                for x in at:
                    rows.append((doc, t, x["start"], x["width"], x["g"], x["off"], x["lone"], data[x["start"] : x["start"] + x["width"] - 1 + threshold]))
                if len(rows) >= 5000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    def _batch(rows):
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "t", "start", "width", "g", "off", "lone", "data"])

    return joined.mapInArrow(run, "doc_id bigint, t bigint, start int, width int, g bigint, off int, lone boolean, data binary")


def _blocks(open_: DataFrame, size: int, length: int, threshold: int) -> DataFrame:
    """Blocks of ``size`` offsets of open rows (doc_id, t, start, width, g, off, lone, data), each with the rank pair at
    threshold - size + 1, the length that its windows share, made of ranks at ``length``, and the union's two fingerprints.

    start and width are of the part of the interval that is still open, data is its union of windows, off the anchor's
    offset from start. Blocks are aligned on the offset from the anchor, so those of equal windows are the same.
    """
    core = threshold - size + 1
    fields = ["doc_id", "t", "start", "width", "g", "off", "lone", "data", "block", "r1", "r2", "u1", "u2"]

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for doc, t, start, width, g, off, lone, data in zip(*(b.column(c).to_pylist() for c in fields[:8])):
                p = Prefixes(data)
                # offset of a position from the anchor: off - (position - start), from off down to off - width + 1
                lo, hi = (off - width + 1) // size, off // size
                block = np.arange(lo, hi + 1)
                first = np.maximum(off - (block * size + size - 1), 0)  # first position of the block, from start
                last = np.minimum(off - block * size, width - 1)
                # all the block's windows hold the bytes from its nominal last position up to its nominal first one's end
                shared = off - block * size
                r1 = p.windows(shared, np.full(len(block), length))
                r2 = p.windows(shared + core - length, np.full(len(block), length))
                u1 = p.windows(first, last - first + threshold)
                u2 = scramble(p.windows(last, np.full(len(block), threshold)))
                for row in zip(block.tolist(), first.tolist(), last.tolist(), r1.tolist(), r2.tolist(), u1.tolist(), u2.view(np.int64).tolist()):
                    k, f, e, a, c, u, v = row
                    out.append((doc, t, start + f, e - f + 1, g, off - f, lone, data[f : e + threshold], k, a, c, u, v))
                if len(out) >= 5000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    def _batch(rows):
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int32(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], fields)

    return open_.select(*fields[:8]).mapInArrow(run, "doc_id bigint, t bigint, start int, width int, g bigint, off int, lone boolean, data binary, block int, r1 bigint, r2 bigint, u1 bigint, u2 bigint")


def repeated_positions(docs: DataFrame, scratch: Scratch, threshold: int = THRESHOLD, piece: int = PIECE) -> DataFrame:
    """docs (doc_id, t, text) -> (doc_id, t, start, width): positions whose window starts anywhere else too."""
    rows = scratch.save(_interval_rows(docs, threshold, piece), "intervals")
    # written first, so that the join's sides are plain shuffles and a hot rank's rows can be split over tasks
    again = scratch.save(rows.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "again")
    rows_open = scratch.save(rows.join(again, "g"), "open")
    scratch.drop(rows)
    classes = rows_open.groupBy("g", "s1", "s2", "width", "off").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "t", "start")).alias("one"))
    classes = scratch.save(classes, "classes")
    same = ["g", "s1", "s2", "width", "off"]
    found = [rows_open.join(classes.where("n > 1").select(*same), same).select("doc_id", "t", "start", "width")]
    several = scratch.save(classes.groupBy("g").agg(F.count("*").alias("kinds")).where("kinds > 1").select("g"), "several")
    reps = classes.join(several, "g").select("one.*", "width", "g", "off", (F.col("n") == 1).alias("lone"))
    open_ = scratch.save(_contexts(docs, reps, threshold), "contexts")
    length = start_length(threshold)
    for size in block_sizes(threshold):
        blocks = scratch.save(_blocks(open_, size, length, threshold), "blocks")
        length = threshold - size + 1
        rank, union = ["g", "block", "r1", "r2"], ["u1", "u2", "width"]
        kinds = blocks.groupBy(*rank, *union, "off").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "t", "start")).alias("one"))
        kinds = scratch.save(kinds, "kinds")
        # done: single intervals whose block is repeated as a whole
        done = blocks.where("lone").join(kinds.where("n > 1").select(*rank, *union, "off"), [*rank, *union, "off"])
        found.append(scratch.save(done.select("doc_id", "t", "start", "width"), "done"))
        if size == 1:
            break
        more = kinds.groupBy(*rank).agg(F.count("*").alias("kinds")).where("kinds > 1").select(*rank)
        # one block of each kind goes on; where a kind is repeated it only stands for its windows
        go = kinds.join(more, rank).select(*rank, F.col("one.doc_id").alias("_d"), F.col("one.t").alias("_t"), F.col("one.start").alias("_s"), "n")
        on = [blocks[c] == go[c] for c in rank] + [blocks.doc_id.eqNullSafe(go._d), blocks.t == go._t, blocks.start == go._s]
        # a repeated row of documents gives equal blocks: dropDuplicates keeps one
        nxt = blocks.join(go, on).select("doc_id", "t", "start", "width", blocks.g, "off", (F.col("lone") & (F.col("n") == 1)).alias("lone"), "data")
        open_ = scratch.save(nxt.dropDuplicates(["doc_id", "t", "start", "g", "off"]), "contexts")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


FIELDS = "n_bytes bigint, n_removed bigint, removed array<struct<start:bigint,end:bigint>>, kept binary"


def dedup_substrings(docs: DataFrame, threshold: int = THRESHOLD, piece: int = PIECE) -> DataFrame:
    """``docs`` with n_bytes, n_removed, removed (maximal runs of bytes) and kept (the remaining bytes).

    A byte goes if a string of ``threshold`` bytes that covers it also starts anywhere else, in any document of the
    input. Null text is empty: nothing to remove. Texts under the threshold lose nothing. Repeated rows, with equal or null
    doc_ids too, are documents of their own, so long ones lose everything. Texts of any length, in pieces. An empty table gives
    no rows. Other columns stay, whatever their names; same-named ones are replaced. Equality rests on fingerprints of
    over 120 bits.
    """
    scratch = Scratch(docs.sparkSession)
    t = F.xxhash64(F.coalesce("text", F.lit("")))
    docs = docs.drop("n_bytes", "n_removed", "removed", "kept")
    d, u, gone_at = free_names(docs, "d", "t", "gone")
    slim = docs.select("doc_id", t.alias("t"), "text")
    gone = repeated_positions(slim, scratch, threshold, piece)
    gone = gone.groupBy(F.col("doc_id").alias(d), F.col("t").alias(u)).agg(F.collect_set(F.struct("start", "width")).alias(gone_at))
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(d)) & (t == F.col(u)), "left").drop(d, u)

    def work(texts, batch):
        n, removed, kept = [], [], []
        for text, gone in zip(texts, batch.column(gone_at)):
            data = (text or "").encode("utf-8", "surrogatepass")
            n.append(len(data))
            runs: list[list[int]] = []
            if gone.is_valid:
                for x in sorted((g["start"], g["start"] + g["width"] - 1 + threshold) for g in gone.as_py()):
                    if runs and x[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], x[1])
                    else:
                        runs.append(list(x))
            removed.append([{"start": a, "end": b} for a, b in runs])
            kept.append(b"".join(data[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(data)])))
        return [n, [sum(x["end"] - x["start"] for x in r) for r in removed], removed, kept]

    return map_blocks(joined, FIELDS, work).drop(gone_at)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; edge cases as in ``dedup_substrings``."""
    out = dedup_substrings(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: By the definition: all windows, in hexadecimal so that a byte is two characters.
SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), w AS MATERIALIZED (
  SELECT r, i, md5_number(substr(x, 2 * i + 1, {2 * THRESHOLD})) AS h FROM (SELECT r, x, unnest(range(0, length(x) // 2 - {THRESHOLD} + 1)) AS i FROM d WHERE length(x) >= {2 * THRESHOLD})
), again AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1
), hit AS (
  SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {THRESHOLD} THEN 0 ELSE 1 END AS first FROM w SEMI JOIN again USING (h)
), spans AS (
  SELECT r, k, min(i) AS a, max(i) + {THRESHOLD} AS b FROM (SELECT r, i, sum(first) OVER (PARTITION BY r ORDER BY i) AS k FROM hit) GROUP BY r, k
), kept AS (
  SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM spans GROUP BY r
)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN x ELSE array_to_string(list_transform(range(0, n_spans + 1), lambda k:
    substr(x, CASE WHEN k = 0 THEN 1 ELSE 2 * ends[k] + 1 END, CASE WHEN k = n_spans THEN length(x) ELSE 2 * starts[k + 1] END - CASE WHEN k = 0 THEN 0 ELSE 2 * ends[k] END)), '') END)) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


def brute_force(texts: list[bytes], threshold: int = THRESHOLD) -> list[tuple[int, int, int, str]]:
    """The same digests by a count of all windows; for small fixtures."""
    count: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - threshold + 1):
            w = hashlib.blake2b(t[i : i + threshold], digest_size=16).digest()
            count[w] = count.get(w, 0) + 1
    out = []
    for t in texts:
        cover = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - threshold + 1):
            if count[hashlib.blake2b(t[i : i + threshold], digest_size=16).digest()] > 1:
                cover[i] += 1
                cover[i + threshold] -= 1
        gone = np.cumsum(cover)[: len(t)] > 0
        edge = np.flatnonzero(np.concatenate(([False], gone)) != np.concatenate((gone, [False])))
        kept = bytes(np.frombuffer(t, np.uint8)[~gone]) if t else b""
        out.append((len(t), int(gone.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest()))
    return out
