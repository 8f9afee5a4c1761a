"""Benchmark decontamination with an FM-index for each training shard.

A shard is a block of documents inside a task. Its words are numbered by the benchmark's vocabulary; a word outside
it can't be part of an occurrence, so it separates runs, and runs shorter than the shortest window are left out. That
changes no result and keeps the index small. Benchmark windows are found by backward search, located from sampled
suffix positions, and merged to spans.
"""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, free_names, map_blocks, spread, table
from .fm_index import FMIndex

WINDOW = 10
#: Benchmark text that goes to each task at once; a larger benchmark is taken in blocks of this size, one pass each. The
#: object sent has for each word of text at most a vocabulary entry and a window, some 40 bytes for each byte of text.
BLOCK_BYTES = 1 << 20
#: Each byte that is no part of a word becomes a space, A-Z are lower-cased; bytes over 127 belong to words.
_TABLE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Windows:
    """The distinct windows of benchmark items, as word numbers."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        self.items: list[str] = sorted({i for i, _ in items})
        place = {i: k for k, i in enumerate(self.items)}
        found: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[k : k + window]), set()).add(place[item])
        self.patterns = np.full((len(found), window), -1, np.int32)
        for k, p in enumerate(found):
            self.patterns[k, window - len(p) :] = p
        self.length = np.array([len(p) for p in found], np.int64)
        self.of_items = [sorted(x) for x in found.values()]
        self.shortest = int(self.length.min()) if len(found) else 0

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocab.get, words, repeat(0)), np.int32, len(words))

    def find(self, texts: list[str | None]):
        """For each text: the number of words, its hit spans as word numbers [start, end), and the items found."""
        n_words, parts, doc_of, word_of = [], [np.zeros(1, np.int32)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        for d, text in enumerate(texts):
            words = words_of(text)
            n_words.append(len(words))
            if len(words) < max(1, self.shortest) or not len(self.patterns):
                continue
            ids = self.numbers(words)
            known = np.concatenate(([False], ids > 0, [False]))
            edge = np.flatnonzero(known[1:] != known[:-1])
            start, end = edge[::2], edge[1::2]
            long = end - start >= self.shortest
            for s, e in zip(start[long].tolist(), end[long].tolist()):
                parts += [ids[s:e], parts[0]]
                doc_of.append(np.full(e - s + 1, d))
                word_of.append(np.arange(s, e + 1))
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[int]] = [set() for _ in texts]
        if len(parts) == 1:
            return n_words, spans, items
        seq, doc, word = np.concatenate(parts), np.concatenate(doc_of), np.concatenate(word_of)
        index = FMIndex(seq, len(self.vocab))
        lo, hi = index.search(self.patterns)
        cover = np.zeros(len(seq) + 1, np.int64)
        hit = np.flatnonzero(hi > lo)
        for block in np.array_split(hit, max(1, int((hi - lo)[hit].sum()) // 1_000_000 + 1)):
            if not len(block):
                continue
            count = (hi - lo)[block]
            which = np.repeat(block, count)
            rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[block], count)
            at = index.locate(rows)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + self.length[which], -1)
            pairs = np.unique(doc[at] * len(self.patterns) + which)
            for d, p in zip((pairs // len(self.patterns)).tolist(), (pairs % len(self.patterns)).tolist()):
                items[d].update(self.of_items[p])
        inside = np.concatenate(([False], np.cumsum(cover[:-1]) > 0, [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            spans[int(doc[s])].append((int(word[s]), int(word[s]) + e - s))
        return n_words, spans, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without its hit spans, from the first word of each to the end of its last one."""
    at = [m.span() for m in _WORD.finditer(text)] if spans else []
    out, last = [], 0
    for s, e in spans:
        out.append(text[last : at[s][0]])
        last = at[e - 1][1]
    return "".join(out) + text[last:]


FIELDS = "n_words bigint, n_hit bigint, hit_spans array<struct<start:bigint,end:bigint>>, item_ids array<string>, clean_text string"


def _pieces(item: str, text: str, window: int, block_bytes: int):
    """A long item in pieces that together have the same windows; each piece has a window's words at least."""
    if len(text) * 4 <= block_bytes:
        yield item, text
        return
    words = words_of(text)
    size = max(2 * window, block_bytes // 16)
    for k in range(0, max(1, len(words) - window + 1), size - window + 1):
        yield item, b" ".join(words[k : k + size]).decode("utf-8", "replace")


def benchmark_blocks(bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES):
    """The benchmark's items, block by block; the driver holds one block at a time, and the longest item."""
    rows = bench.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = int(total // block_bytes) + 1
    for k in range(n):
        block, size = [], 0
        for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).toLocalIterator():
            for item, text in _pieces(r[0], r[1], window, block_bytes):
                if block and size + len(text) > 4 * block_bytes:
                    yield block
                    block, size = [], 0
                block.append((item, text))
                size += len(text)
        if block or k == n - 1:
            yield block


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, hit_spans (word numbers), item_ids (as sorted strings) and clean_text.

    Null text: no words, clean_text null; empty text: no words. Benchmark rows with null item_id or text are not
    used; rows that repeat an item_id are one item. Any doc_id, null and repeated ones included: each row is judged
    alone. Empty tables: no rows, or no hits. Other columns stay, whatever their names; same-named ones are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_words", "n_hit", "hit_spans", "item_ids", "clean_text")
    old_spans, old_items = free_names(docs, "spans", "items")
    scratch = Scratch(spark)
    out = shared = None
    for block in benchmark_blocks(bench, window, block_bytes):
        if shared is not None:
            # an earlier pass is written, so that its windows are not needed again
            out = scratch.save(out, "pass")
            shared.destroy()
        shared = spark.sparkContext.broadcast(Windows(block, window))
        earlier = out is not None

        def work(texts, batch, shared=shared, earlier=earlier):
            w = shared.value
            n_words, spans, items = w.find(texts)
            names = [[w.items[i] for i in x] for x in items]
            if earlier:
                spans = [_merged(a + [(x["start"], x["end"]) for x in b]) for a, b in zip(spans, batch.column(old_spans).to_pylist())]
                names = [a + b for a, b in zip(names, batch.column(old_items).to_pylist())]
            return [
                n_words,
                [sum(e - s for s, e in x) for x in spans],
                [[{"start": s, "end": e} for s, e in x] for x in spans],
                [sorted(set(x)) for x in names],
                [t if t is None or not x else without(t, x) for t, x in zip(texts, spans)],
            ]

        before = docs if out is None else out.withColumns({old_spans: F.col("hit_spans"), old_items: F.col("item_ids")})
        out = map_blocks(before, FIELDS, work).drop(old_spans, old_items)
    return out


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, by the contract; edge cases as in ``decontaminate``."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH b AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM win), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), p AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), occ AS (
  SELECT p.doc_id, p.i, p.n, win.item FROM p JOIN win ON p.n = win.n AND p.phrase = win.phrase
), hits AS (
  SELECT doc_id, count(DISTINCT h) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS h FROM (SELECT DISTINCT doc_id, i, n FROM occ)) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
