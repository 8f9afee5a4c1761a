"""Embedding near-dedup by Euclidean p-stable hashing, with exact cosine checks.

Normalised vectors at cosine c are sqrt(2 - 2c) apart. Each table concatenates quantised random projections
floor((a.x + b) / WIDTH); the number of projections grows with the logarithm of the number of vectors, so that
unrelated vectors rarely meet, and the number of tables follows from the wanted recall. A bucket is a unit of work; a large
one is split into parts, and each pair of parts is a unit. A pair that meets in several tables counts in the first one
only. Units return counts and a spanning forest of links, never a list of pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, table

COSINE = 0.95
WIDTH = 2.0
#: Expected unrelated vectors that meet a vector by chance in a table, and the chance of missing a pair at the threshold.
BY_CHANCE, MISS = 0.12, 0.001
PART_ROWS = 512


def collision(apart: float, width: float = WIDTH) -> float:
    """The chance that one quantised projection is the same for points ``apart`` from each other."""
    r = width / apart
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """(projections a table, tables) for n vectors."""
    near, far = collision(math.sqrt(2 - 2 * cosine)), collision(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(n, 2) / BY_CHANCE) / -math.log(far)))
    return k, math.ceil(math.log(MISS) / math.log(1 - near**k))


def unit_vector(v) -> np.ndarray | None:
    """The vector at length 1 in double precision; None if null, zero, or with a null or non-finite component."""
    if v is None or not len(v) or any(x is None for x in v):
        return None
    x = np.array(v, np.float64)
    top = np.abs(x).max()
    if not np.isfinite(x).all() or top == 0:
        return None
    x = x / top
    return x / np.sqrt((x * x).sum())


def bucket_keys(vectors: np.ndarray, k: int, tables: int) -> np.ndarray:
    """rows x tables of 32-bit keys."""
    rng = np.random.default_rng((977, vectors.shape[1]))
    a = rng.standard_normal((vectors.shape[1], tables * k))
    b = rng.uniform(0, WIDTH, tables * k)
    cell = np.floor((vectors @ a + b) / WIDTH).astype(np.int64).astype(np.uint64).reshape(len(vectors), tables, k)
    h = np.full((len(vectors), tables), vectors.shape[1], np.uint64)
    for j in range(k):
        h = (h ^ cell[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(32)).astype("<u4")


def _described(vectors: DataFrame, k: int, tables: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                units = [unit_vector(v) for v in part.column("embedding").to_pylist()]
                raw = [None if u is None else u.tobytes() for u in units]
                keys: list[bytes | None] = [None] * len(units)
                for dim in {len(u) for u in units if u is not None}:
                    at = [j for j, u in enumerate(units) if u is not None and len(u) == dim]
                    for j, row in zip(at, bucket_keys(np.stack([units[j] for j in at]), k, tables)):
                        keys[j] = row.tobytes()
                same = [None if r is None else xxhash.xxh3_128_digest(r) for r in raw]
                yield pa.RecordBatch.from_arrays([part.column("vec_id").cast(pa.int64()), pa.array(same, pa.binary()), pa.array(raw, pa.binary()), pa.array(keys, pa.binary())], ["vec_id", "same", "vec", "keys"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id bigint, same binary, vec binary, keys binary")


def _bucket_rows(classes: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                if part.num_rows:
                    keys = [np.frombuffer(x, "<u4") for x in part.column("keys").to_pylist()]
                    keys = np.stack(keys).astype(np.int64)
                    keys |= np.arange(keys.shape[1], dtype=np.int64)[None, :] << 32
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column("id").to_numpy(zero_copy_only=False), keys.shape[1]))], ["bucket", "id"])

    return classes.select("id", "keys").mapInArrow(run, "bucket bigint, id bigint")


def unit_links(place: int, vec: np.ndarray, keys: np.ndarray, times: np.ndarray, left: np.ndarray, right: np.ndarray | None, cosine: float):
    """Counts of links of each row, and links that join what no earlier one has, among pairs that first meet in table ``place``."""
    within = right is None
    right = left if within else right
    count = np.zeros(len(vec), np.int64)
    parent = list(range(len(vec)))
    links: list[tuple[int, int]] = []

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(0, len(left), 256):
        a = left[i : i + 256]
        close = vec[a] @ vec[right].T >= cosine
        if within:
            close &= np.arange(len(right))[None, :] > (i + np.arange(len(a)))[:, None]
        x, y = np.nonzero(close)
        x, y = a[x], right[y]
        new = np.ones(len(x), bool)
        for j in range(0, len(x), 100_000):
            part = slice(j, j + 100_000)
            new[part] = ~(keys[x[part], :place] == keys[y[part], :place]).any(axis=1)
        x, y = x[new], y[new]
        np.add.at(count, x, times[y])
        np.add.at(count, y, times[x])
        for p, q in zip(x.tolist(), y.tolist()):
            p, q = find(p), find(q)
            if p != q:
                parent[q] = p
                links.append((p, q))
    return count, links


def _links(units: DataFrame, cosine: float) -> DataFrame:
    """units (bucket, p, q, side, id, vec_id, times, vec, keys), partitioned and sorted by unit -> links (a, b, 0) of vec_ids and counts (id, null, n)."""

    def run(batches):
        def done(at, rows):
            # keys of 32 bits can put vectors of different length into one bucket: each length is a unit of its own
            for size in sorted({len(r[4]) for r in rows}):
                of_size(at, [r for r in rows if len(r[4]) == size])

        def of_size(at, rows):
            ids: dict[int, int] = {}
            side, vec, keys, times, named = ([], []), [], [], [], []
            for s, i, d, t, v, k in rows:
                if i not in ids:
                    ids[i] = len(ids)
                    named.append(d)
                    vec.append(np.frombuffer(v, np.float64))
                    keys.append(np.frombuffer(k, "<u4"))
                    times.append(t)
                side[s].append(ids[i])
            if len(ids) < 2 or at[1] != at[2] and not (side[0] and side[1]):
                return
            back = list(ids)
            right = np.unique(side[1]) if at[1] != at[2] else None
            count, links = unit_links(at[0] >> 32, np.stack(vec), np.stack(keys), np.array(times, np.int64), np.unique(side[0]), right, cosine)
            for i in np.flatnonzero(count).tolist():
                out.append((back[i], None, int(count[i])))
            out.extend((named[a], named[b], 0) for a, b in links)

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], pa.int64()) for j in range(3)], ["a", "b", "n"])
            out.clear()
            return made

        at, rows, out = None, [], []
        for b in batches:
            for bucket, p, q, *row in zip(*(b.column(c).to_pylist() for c in ("bucket", "p", "q", "side", "id", "vec_id", "times", "vec", "keys"))):
                if (bucket, p, q) != at:
                    if rows:
                        done(at, rows)
                    at, rows = (bucket, p, q), []
                rows.append(row)
            if out:
                yield batch()
        if rows:
            done(at, rows)
        if out:
            yield batch()

    return units.select("bucket", "p", "q", "side", "id", "vec_id", "times", "vec", "keys").mapInArrow(run, "a bigint, b bigint, n bigint")


def near_duplicate_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of ``vectors``.

    Links: cosine >= ``cosine`` in double precision, among pairs that share a bucket; a pair at the threshold is missed with a
    chance of ``MISS``. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
    vectors of different length. Rows with equal vectors are linked (each counts the others) and meet the rest as one.
    A null vec_id links with nothing: n_links 0, component_id null, kept. Rows that repeat a vec_id count as vectors
    of one component. An empty table gives no rows. Other columns, labels too, are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    k, tables = plan(vectors.count(), cosine)
    rows = scratch.save(_described(vectors, k, tables), "vectors")
    known = rows.where("vec_id IS NOT NULL AND same IS NOT NULL")
    # nodes of the join are vectors, by a 64-bit key: a vec_id can have several
    classes = known.groupBy("same").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("times"), F.first("vec").alias("vec"), F.first("keys").alias("keys"))
    classes = scratch.save(classes.withColumn("id", F.xxhash64("same")), "classes")
    buckets = _bucket_rows(classes)
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("n > 1 AND lo < hi")
    shared = shared.select("bucket", F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts"))
    members = buckets.join(shared, "bucket").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    # a member of part i goes to the units (i, j) and (j, i), j of all parts: as often as there are parts
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    members = members.select("bucket", "id", "part", other.alias("other"))
    units = members.select("bucket", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), F.when(F.col("part") > F.col("other"), 1).otherwise(0).alias("side"), "id")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    units = units.join(classes.select("id", "vec_id", "times", "vec", "keys"), "id").repartition(n, "bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")
    found = scratch.save(_links(units, cosine), "links")
    counts = found.where("n > 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("far"))
    # one vec_id with several vectors (none counts as one): all of them are one component, tied to each vector's least vec_id
    several = rows.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min(F.xxhash64("same")).alias("lo"), F.max(F.xxhash64("same")).alias("hi")).where("lo < hi")
    least = classes.select("same", F.col("vec_id").alias("b"))
    ties = known.select("vec_id", "same").join(several, "vec_id", "left_semi").join(least, "same").where("vec_id <> b").select(F.col("vec_id").alias("a"), "b").distinct()
    root = scratch.save(components(found.where("b IS NOT NULL AND a <> b").select("a", "b").unionByName(ties), scratch), "roots")
    root = root.select(F.col("id").alias("node"), "root")
    labels = classes.select("same", "id", F.col("vec_id").alias("node"), "times").join(counts, "id", "left").join(root, "node", "left").select("same", "times", "far", F.coalesce("root", "node").alias("root"))
    full = rows.where("same IS NOT NULL").join(labels, "same", "left").select("vec_id", "times", "far", "root")
    none = rows.where("same IS NULL").join(root, F.col("vec_id") == F.col("node"), "left").select("vec_id", F.lit(None).cast("bigint").alias("times"), F.lit(None).cast("bigint").alias("far"), "root")
    out = full.unionByName(none)
    linked = F.col("vec_id").isNotNull() & F.col("times").isNotNull()
    return out.select(
        "vec_id",
        F.when(linked, F.col("times") - 1 + F.coalesce("far", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("root", "vec_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept; edge cases as in ``near_duplicate_vectors``."""
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), r(id, z) AS (
  SELECT a, a FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.z = l.a
), c AS (SELECT id, min(z) AS root FROM r GROUP BY id
), n AS (SELECT a AS id, count(*) AS k FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.k, 0) AS n_links, coalesce(c.root, e.vec_id) AS component_id, coalesce(c.root, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON e.vec_id = n.id LEFT JOIN c ON e.vec_id = c.id
"""
