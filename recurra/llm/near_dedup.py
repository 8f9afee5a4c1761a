"""MinHash near-dedup by a multi-index Hamming join, confirmed on full shingle sets.

1. Every text gives its set of word shingles (64-bit hashes), the set's 128-bit key, and a signature of ``POSITIONS``
   b-bit minima. Texts with equal sets are one class, so copies never meet in pairs.
2. Signatures are split into chunks. By the pigeonhole principle two signatures at most ``radius`` positions apart
   agree on some chunk up to that chunk's allowed errors; the errors are enumerated by leaving positions out. So every
   pair under the radius shares a key.
3. Every class is first compared with the leaders of its keys, the least class of each. Classes linked with one leader are
   a star; only keys whose classes are in several stars are left: a group of near copies is mostly done then, with work
   in proportion to its size.
4. Classes of the keys that are left are put into blocks of bounded size, a large star's into blocks of its own; each
   pair of blocks with a common key and more than one star is one unit of work. A unit compares signatures, then
   full sets, and returns at most one link for each class that it joins: pairs that are joined already are not listed.
5. All links give connected components.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, join_lookup, map_blocks, spread, table

POSITIONS, BITS, CHUNKS = 64, 16, 16
#: Bound of the chance that a pair at the similarity is further apart than the radius.
MISS = Fraction(1, 30_000)
BLOCK_ROWS, BLOCK_SHINGLES = 512, 400_000
#: A leader is compared with so many classes in a unit: work there is in proportion to rows, so units may be small and even.
STAR_ROWS = 64
#: Bound of the table of word hashes.
_WORDS = 100_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240601)
_FACTORS = _rng.integers(0, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_hashes: dict[bytes, int] = {}


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of shingles of ``width`` words; fewer words are one shingle, none give an empty set."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    at = list(map(_hashes.get, words, repeat(-1)))
    if -1 in at:
        if len(_hashes) > _WORDS:
            _hashes.clear()
        for w in words:
            if w not in _hashes:
                _hashes[w] = xxhash.xxh3_64_intdigest(w) >> 1
        at = list(map(_hashes.__getitem__, words))
    h = _mix(np.array(at, np.uint64))
    k = min(width, len(words))
    n = len(words) - k + 1
    s = np.full(n, k, np.uint64)
    for j in range(k):
        s = _mix(s * _GOLD + h[j : j + n])
    return np.unique(s)


def signature(s: np.ndarray) -> np.ndarray:
    low = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        low = np.minimum(low, (s[None, i : i + 4096] * _FACTORS[:, None]).min(axis=1))
    return (_mix(low) & np.uint64((1 << BITS) - 1)).astype("<u2")


def radius_of(similarity: Fraction) -> int:
    """The least signature distance that pairs at ``similarity`` exceed with a chance under MISS, by the binomial tail."""
    miss, within = 1 - similarity, Fraction(0)
    for r in range(POSITIONS):
        within += comb(POSITIONS, r) * miss**r * (1 - miss) ** (POSITIONS - r)
        if 1 - within < MISS:
            return r
    return POSITIONS - 1


def key_plan(radius: int) -> list[tuple[int, ...]]:
    """The positions of each key: chunk by chunk, all choices of its allowed errors left out.

    Chunk i allows t_i errors with sum(t_i + 1) = radius + 1, so no pair within the radius can exceed all of them.
    """
    width = POSITIONS // CHUNKS
    share, more = divmod(radius + 1, CHUNKS)
    plan = []
    for i in range(CHUNKS):
        errors = share + (i < more) - 1
        if errors >= 0:
            plan += list(combinations(range(i * width, (i + 1) * width), max(0, width - errors)))
    return plan


def signature_keys(sigs: np.ndarray, plan: list[tuple[int, ...]]) -> np.ndarray:
    """rows x keys of 64-bit key hashes."""
    wide = sigs.astype(np.uint64)
    out = np.empty((len(sigs), len(plan)), np.uint64)
    for k, positions in enumerate(plan):
        packed = np.zeros(len(sigs), np.uint64)
        for p in positions:
            packed = (packed << np.uint64(BITS)) | wide[:, p]
        out[:, k] = _mix(_mix(packed) + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return out


class _Forest:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[b] = a
        return a != b


def unit_links(sigs: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, radius: int, similarity: Fraction, groups: list | None = None) -> list[tuple[int, int]]:
    """Links between rows ``left`` and ``right`` (None: among left) that join what no earlier link has joined; rows of one of ``groups`` are joined."""
    num, den = similarity.numerator, similarity.denominator
    size = np.array([len(s) for s in sets], np.int64)
    within = right is None
    right = left if within else right
    forest, out = _Forest(len(sets)), []
    first: dict = {}
    for i, g in enumerate(groups or ()):
        forest.join(first.setdefault(g, i), i)
    # distances, a slice of rows at a time
    near: list[np.ndarray] = []
    for i in range(0, len(left), 64):
        a = left[i : i + 64]
        apart = np.zeros((len(a), len(right)), np.int16)
        for p in range(POSITIONS):
            apart += sigs[a, p][:, None] != sigs[right, p][None, :]
        small = np.minimum(size[a][:, None], size[right][None, :])
        large = np.maximum(size[a][:, None], size[right][None, :])
        ok = (apart <= radius) & (small * den >= num * large)
        if within:
            ok &= np.arange(len(right))[None, :] > (i + np.arange(len(a)))[:, None]
        x, y = np.nonzero(ok)
        near.append(np.stack((apart[x, y], left[x + i], right[y]), axis=1))
    pairs = np.concatenate(near) if near else np.zeros((0, 3), np.int64)
    if not len(pairs):
        return out
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    shared = None
    if len(pairs) > 4 * len(sets):
        shared = _intersections(sets, np.unique(pairs[:, 1]), np.unique(pairs[:, 2]))
    for _, a, b in pairs.tolist():
        if forest.find(a) == forest.find(b):
            continue
        both = shared(a, b) if shared else len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        if both * den >= num * (int(size[a]) + int(size[b]) - both) and forest.join(a, b):
            out.append((a, b))
    return out


def _intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray):
    """A look-up of intersection sizes for all pairs of left and right, by products of incidence matrices."""
    rows = np.union1d(left, right)
    values = np.concatenate([sets[r] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])
    _, code, times = np.unique(values, return_inverse=True, return_counts=True)
    often = times > 1
    number = np.cumsum(often) - 1
    keep = often[code]
    code, owner = number[code[keep]], owner[keep]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    la, ra = np.searchsorted(rows, left), np.searchsorted(rows, right)
    total = np.zeros((len(left), len(right)), np.float32)
    step = 4096
    for c in range(0, int(often.sum()), step):
        a, b = np.searchsorted(code, (c, c + step))
        m = np.zeros((len(rows), step), np.float32)
        m[owner[a:b], code[a:b] - c] = 1
        total += m[la] @ m[ra].T
    place_l = {int(r): i for i, r in enumerate(left)}
    place_r = {int(r): i for i, r in enumerate(right)}
    return lambda x, y: int(total[place_l[x], place_r[y]])


def describe(docs: DataFrame, width: int) -> DataFrame:
    """Adds n_shingles, set_key (16 bytes; null for an empty set) and sig."""

    def work(texts, batch):
        sets = [shingle_set(t, width) for t in texts]
        return [
            [len(s) for s in sets],
            [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
            [signature(s).tobytes() if len(s) else None for s in sets],
        ]

    return map_blocks(docs, "n_shingles bigint, set_key binary, sig binary", work)


def _key_rows(classes: DataFrame, plan: list[tuple[int, ...]]) -> DataFrame:
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 8192):
                part = b.slice(i, 8192)
                if part.num_rows:
                    sigs = np.frombuffer(b"".join(part.column("sig").to_pylist()), "<u2").reshape(-1, POSITIONS)
                    keys = signature_keys(sigs, plan).view(np.int64)
                    ids = np.repeat(part.column("id").to_numpy(zero_copy_only=False), keys.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["key", "id"])

    return classes.select("id", "sig").mapInArrow(run, "key bigint, id bigint")


def _links(units: DataFrame, radius: int, similarity: Fraction) -> DataFrame:
    """units: (p, q, side, id, comp, doc_id, sig, set), partitioned and sorted by (p, q) -> links (a, b) of doc_ids."""

    def run(batches):
        def done(rows):
            docs, seen, side, comps = [], {}, ([], []), []
            sigs, sets = [], []
            for s, i, c, d, g, x in rows:
                if i not in seen:
                    seen[i] = len(docs)
                    docs.append(d)
                    comps.append(c)
                    sigs.append(np.frombuffer(g, "<u2"))
                    sets.append(np.frombuffer(x, np.uint64))
                side[s].append(seen[i])
            left, right = np.unique(side[0]).astype(np.int64), np.unique(side[1]).astype(np.int64)
            if len(left) and (len(right) or len(left) > 1):
                for a, b in unit_links(np.stack(sigs), sets, left, right if len(right) else None, radius, similarity, comps):
                    if docs[a] != docs[b]:
                        yield docs[a], docs[b]

        at, rows, found = None, [], []
        for batch in batches:
            for p, q, *row in zip(*(batch.column(c).to_pylist() for c in ("p", "q", "side", "id", "comp", "doc_id", "sig", "set"))):
                if (p, q) != at:
                    found += done(rows)
                    at, rows = (p, q), []
                rows.append(row)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"])
                found = []
        found += done(rows)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"])

    return units.select("p", "q", "side", "id", "comp", "doc_id", "sig", "set").mapInArrow(run, "a bigint, b bigint")


def _parts(rows: DataFrame, n: DataFrame, by: str, scratch: Scratch, most: int) -> DataFrame:
    """``rows`` (id, ``by``, ...) with the part of its group that a row is in, by a hash of its id, of about ``most`` rows; n (id, n): sizes of sets."""
    rows = scratch.save(rows, "rows")
    size = rows.join(n, "id").groupBy(by).agg(F.count("*").alias("rows"), F.ceil(F.greatest(F.count("*") / most, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    return join_lookup(rows, scratch.save(size, "sizes"), [by], "rows", rows.count()).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")


def _star_units(members: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """A leader against a part of the classes that it leads: (p, q, side, id, comp); each class is a component of its own."""
    star = members.where("id <> leader").select("leader", "id").distinct()
    star = scratch.save(_parts(star, classes.select("id", "n"), "leader", scratch, STAR_ROWS).select(F.col("leader").alias("p"), F.col("part").alias("q"), "id"), "star")
    head = star.select("p", "q").distinct().select("p", "q", F.lit(0).alias("side"), F.col("p").alias("id"))
    return head.unionByName(star.select("p", "q", F.lit(1).alias("side"), "id")).withColumn("comp", F.col("id"))


def _block_units(met: DataFrame, scratch: Scratch) -> DataFrame:
    """met (id, key, leader, n, comp) -> units of blocks that share a key and aren't of one component: (p, q, side, id, comp).

    A block holds classes with the same smallest leader; components of half a block or more have blocks of their own.
    """
    several = met.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    open_ = scratch.save(met.join(several, "key"), "open")
    place = open_.groupBy("id").agg(F.min("leader").alias("leader"), F.first("n").alias("n"), F.first("comp").alias("comp"))
    place = scratch.save(place, "classes")
    count = scratch.save(place.groupBy("comp").agg(F.count("*").alias("rows")).withColumn("large", F.col("rows") * 2 >= BLOCK_ROWS), "counts")
    place = join_lookup(place, count, ["comp"], "rows", place.count())
    place = place.withColumn("group", F.xxhash64("leader", F.when(F.col("large"), F.col("comp"))))
    place = _parts(place.select("id", "group", "comp", "large"), open_.select("id", "n").distinct(), "group", scratch, BLOCK_ROWS)
    # pure: the component that all of the block is of
    place = scratch.save(place.select("id", "comp", F.when(F.col("large"), F.col("comp")).alias("pure"), F.xxhash64("group", "part").alias("block")), "place")
    in_key = scratch.save(open_.select("key", "id").join(place.select("id", "block", "pure"), "id").select("key", "block", "pure").distinct(), "inkey")
    lone = in_key.where("pure IS NULL").select(F.col("block").alias("p"), F.col("block").alias("q")).distinct()
    cross = in_key.alias("x").join(in_key.alias("y"), "key").where("x.block < y.block AND (x.pure IS NULL OR y.pure IS NULL OR x.pure <> y.pure)").select(F.col("x.block").alias("p"), F.col("y.block").alias("q")).distinct()
    pairs = scratch.save(lone.unionByName(cross), "pairs")
    own = place.select("id", "comp", "block")
    left = pairs.join(own, F.col("p") == F.col("block")).select("p", "q", F.lit(0).alias("side"), "id", "comp")
    return left.unionByName(pairs.where("p <> q").join(own, F.col("q") == F.col("block")).select("p", "q", F.lit(1).alias("side"), "id", "comp"))


def near_duplicates(docs: DataFrame, width: int = 5, similarity: Fraction = Fraction(4, 5)) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``.

    Links: Jaccard similarity of the shingle sets >= ``similarity``, compared in whole numbers. component_id: the
    smallest doc_id reachable. Null or empty text, or one of white space: an empty set, linked with nothing, kept. Null
    doc_id: linked with nothing, component_id null, kept. Rows that repeat a doc_id are one document: linked if any of
    their texts is, and then the rows with an empty set too. Ties need no rule: the result depends on sets and ids only. Empty tables give no rows. Other columns
    are not read. A pair at the similarity is missed by the signature with a chance under 1 in 30,000; sets are
    compared whole.
    """
    scratch = Scratch(docs.sparkSession)
    radius = radius_of(similarity)
    slim = docs.select("doc_id", "text")
    rows = scratch.save(describe(slim, width).drop("text"), "described")
    known = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    # nodes of the join are sets, by a 64-bit key: a doc_id can have several
    classes = known.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n"))
    classes = scratch.save(classes.withColumn("id", F.xxhash64("set_key")), "classes")
    keys = _key_rows(classes, key_plan(radius))
    shared = keys.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader < last").select("key", "leader")
    members = scratch.save(keys.join(shared, "key"), "members")
    ids = classes.join(members.select("id").distinct(), "id", "left_semi")
    texts = slim.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")

    def sets_of(t, batch):
        sets = [shingle_set(x, width) for x in t]
        return [
            [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
            [signature(s).tobytes() if len(s) else None for s in sets],
            [s.tobytes() for s in sets],
        ]

    sets = map_blocks(texts, "set_key binary, sig binary, set binary", sets_of).where("sig IS NOT NULL").select(F.xxhash64("set_key").alias("id"), "doc_id", "sig", "set")
    sets = scratch.save(sets, "sets")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def linked(units):
        return _links(units.join(sets, "id").repartition(n, "p", "q").sortWithinPartitions("p", "q"), radius, similarity)

    by_leader = scratch.save(linked(_star_units(members, classes, scratch)), "leaderlinks")
    least = classes.select("set_key", F.col("doc_id").alias("b"))
    # one label for classes linked with one leader, the least of their leaders: all that it takes to leave them out below
    near = by_leader.groupBy("b").agg(F.min("a").alias("root"))
    comp = classes.select("id", "n", F.col("doc_id").alias("b")).join(near, "b", "left").select("id", "n", F.coalesce("root", "b").alias("comp"))
    met = scratch.save(members.join(comp, "id"), "met")
    scratch.drop(members)
    links = by_leader.unionByName(linked(_block_units(met, scratch)))
    # one doc_id with several sets (none counts as one): all of them are one document, tied to each set's least doc_id
    several = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.xxhash64("set_key")).alias("lo"), F.max(F.xxhash64("set_key")).alias("hi")).where("lo < hi")
    ties = known.select("doc_id", "set_key").join(several, "doc_id", "left_semi").join(least, "set_key").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()
    root = scratch.save(components(links.unionByName(ties), scratch), "roots")
    labels = least.join(root, F.col("b") == F.col("id"), "left").select("set_key", F.coalesce("root", "b").alias("label"))
    full = rows.where("set_key IS NOT NULL").join(labels, "set_key", "left").select("doc_id", "n_shingles", "label")
    empty = rows.where("set_key IS NULL").join(root, F.col("doc_id") == F.col("id"), "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("label"))
    label = F.when(F.col("doc_id").isNotNull(), F.col("label"))
    return full.unionByName(empty).select("doc_id", "n_shingles", label.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept; edge cases as in ``near_duplicates``."""
    return near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), width=3, similarity=Fraction(85, 100))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, string_split(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' ') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE w <> [''])
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), rare AS (
  SELECT g, count(*) AS k FROM s GROUP BY g HAVING count(*) > 1
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c2
  FROM (SELECT s.* FROM s JOIN rare USING (g)) a JOIN (SELECT s.* FROM s JOIN rare USING (g)) b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY 1, 2
), e AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c2 >= 85 * (x.n + y.n - c2)
), both_ways AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r(id, z) AS (
  SELECT a, a FROM both_ways UNION SELECT r.id, both_ways.b FROM r JOIN both_ways ON r.z = both_ways.a
), c AS (SELECT id, min(z) AS root FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id, coalesce(c.root, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.id
"""
