"""Sharding by a k-d tree over metadata; DataFrame operations only.

Law ``bytes``: shards have nearly equal bytes, as far as groups of equal texts, which stay together, allow it.
The unit is a group of equal texts with the sum of its rows' sizes as weight. A node is split at a weighted median
along its widest metadata dimension. Medians are found by refining histograms: each round sums weights into bins of
a 60-bit composite (value first, then a hash, so that ties split too), and only the bin that holds the median
is refined. The driver sees at most nodes x 4096 sums a round, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, hash128, table

SHARDS = 8
VALUE_BITS, HASH_BITS, STEP_BITS = 24, 36, 12
#: A median is good enough when the bin it falls into holds at most this part of the node's bytes.
TOLERANCE = 5e-4


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, group key (g1, g2) and metadata dimensions, without the text."""
    text = F.coalesce("text", F.lit(""))
    g1, g2 = hash128(text)
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        g1.alias("g1"),
        g2.alias("g2"),
        F.log2(F.octet_length(text) + 1.0).alias("d_length"),
        F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(4096)).cast("double").alias("d_source"),
        F.pmod(F.xxhash64(F.coalesce("lang", F.lit(""))), F.lit(4096)).cast("double").alias("d_lang"),
    )


DIMENSIONS = ("d_length", "d_source", "d_lang")


def _extents(units: DataFrame, nodes: list[int]) -> dict:
    """For each of ``nodes``, which are at most as many as shards: its weight and its ends on each dimension."""
    ends = units.groupBy("node").agg(F.sum("w").alias("w"), *[f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))])
    return {r["node"]: r for r in ends.where(F.col("node").isin(nodes)).collect()}


def _value(dim: str, lo: float, hi: float) -> Column:
    """A node's value on one dimension as VALUE_BITS bits, then HASH_BITS bits that break ties."""
    top = (1 << VALUE_BITS) - 1
    scaled = F.floor((F.col(dim) - F.lit(lo)) / F.lit(max(hi - lo, 1e-12)) * F.lit(float(top)))
    value = F.greatest(F.lit(0), F.least(F.lit(top), scaled)).cast("long")
    return F.shiftleft(value, HASH_BITS) + F.pmod(F.col("g2"), F.lit(1 << HASH_BITS))


def kd_shards(units: DataFrame, shards: int, scratch: Scratch) -> DataFrame:
    """units (g1, g2, w, dimensions) -> (g1, g2, shard)."""
    total = units.agg(F.sum("w")).first()[0] or 0
    # A group at or over a shard's share of what is left gets a shard of its own: at most shards - 1 of these.
    large = units.orderBy(F.desc("w"), "g1", "g2").limit(shards - 1).select("g1", "g2", "w").collect()
    alone: list = []
    left, n = total, shards
    for r in large:
        if n > 1 and r["w"] * n >= left and r["w"] < left:
            alone.append(r)
            left, n = left - r["w"], n - 1
        else:
            break
    node: Column = F.lit(0)
    for i, r in enumerate(alone):
        node = F.when((F.col("g1") == r["g1"]) & (F.col("g2") == r["g2"]), -(i + 1)).otherwise(node)
    units = units.withColumn("node", node)
    first = {0: (n, len(alone))}  # node -> (leaves, first shard)
    done = {-(i + 1): i for i in range(len(alone))}
    next_node = 1
    spans = None
    while first:
        ready = {k: v for k, v in first.items() if v[0] > 1}
        done |= {k: v[1] for k, v in first.items() if v[0] == 1}
        if not ready:
            break
        ends = _extents(units, list(ready))
        if spans is None:
            spans = {d: max((ends[0][f"hi_{d}"] - ends[0][f"lo_{d}"]) if 0 in ends else 1.0, 1e-12) for d in DIMENSIONS}
        cut: Column = F.lit(None).cast("long")
        goal, weight, prefix, at = {}, {}, {}, {}
        for k, (leaves, _) in ready.items():
            if k not in ends:
                continue
            e = ends[k]
            dim = max(DIMENSIONS, key=lambda d: ((e[f"hi_{d}"] - e[f"lo_{d}"]) / spans[d], -DIMENSIONS.index(d)))
            cut = F.when(F.col("node") == k, _value(dim, e[f"lo_{dim}"], e[f"hi_{dim}"])).otherwise(cut)
            goal[k], weight[k], prefix[k] = e["w"] * (leaves // 2) / leaves, e["w"], (0, 0)
        units = scratch.save(units.withColumn("cut", cut), "cut")
        bits = VALUE_BITS + HASH_BITS
        while prefix and bits > 0:
            bits -= STEP_BITS
            inside = F.lit(False)
            for k, (p, _) in prefix.items():
                inside = inside | ((F.col("node") == k) & (F.shiftright("cut", bits + STEP_BITS) == p))
            sums = units.where(inside).groupBy("node", F.shiftright("cut", bits).alias("bin")).agg(F.sum("w").alias("w")).collect()
            for k in list(prefix):
                low = prefix[k][1]
                for r in sorted((r for r in sums if r["node"] == k), key=lambda r: r["bin"]):
                    if low + r["w"] > goal[k] or bits == 0 and low + r["w"] == goal[k]:
                        break
                    low += r["w"]
                else:
                    continue
                if r["w"] <= TOLERANCE * weight[k] or bits == 0:
                    # the bin goes whole to the side that it leaves more even
                    whole = abs(low + r["w"] - goal[k]) < abs(low - goal[k])
                    at[k] = (r["bin"] + whole) << bits
                    del prefix[k]
                else:
                    prefix[k] = (r["bin"], low)
        child, following = F.col("node"), {}
        for k, (leaves, shard) in ready.items():
            if k not in at:
                following[next_node] = (1, shard)
                child = F.when(F.col("node") == k, next_node).otherwise(child)
                next_node += 1
                continue
            a, b = next_node, next_node + 1
            next_node += 2
            child = F.when(F.col("node") == k, F.when(F.col("cut") < at[k], a).otherwise(b)).otherwise(child)
            following |= {a: (leaves // 2, shard), b: (leaves - leaves // 2, shard + leaves // 2)}
        units = scratch.save(units.withColumn("node", child).drop("cut"), "nodes")
        first = following
    shard: Column = F.lit(0)
    for k, v in done.items():
        shard = F.when(F.col("node") == k, v).otherwise(shard)
    return units.select("g1", "g2", shard.cast("int").alias("shard"))


def numbered(rows: DataFrame, scratch: Scratch, within: str, by: list[str], out: str) -> DataFrame:
    """A number from 0 without gaps within each value of ``within``, in the order of ``by``; no task gets a whole value.

    Rows are range-partitioned over (within, by), written with their partition's number, counted for each partition,
    and numbered from the sum of the counts before it. The table of counts has partitions x values rows.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = scratch.save(rows.repartitionByRange(n, within, *by).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = part.groupBy(within, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(within, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy(within, "_part").orderBy(*by)
    return part.withColumn("_row", F.row_number().over(own) - 1).join(starts, [within, "_part"]).withColumn(out, F.col("_start") + F.col("_row")).drop("_part", "_row", "_start")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row for each row of ``docs``.

    size: UTF-8 bytes plus 1 (null: 1). Null and empty text are one group, CRC 0. Null doc_id: sharded as any row,
    first in the order of slots. Repeated rows: a slot each. Ties on a dimension split by a hash of the text. One
    group over a shard's share has a shard of its own; with fewer groups than shards some shards stay empty.
    Null source or lang count as empty strings. An empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(measured(docs), "rows")
    units = rows.groupBy("g1", "g2").agg(F.sum("size").alias("w"), F.min("d_length").alias("d_length"), F.min("d_source").alias("d_source"), F.min("d_lang").alias("d_lang"))
    placed = rows.join(kd_shards(scratch.save(units, "units"), shards, scratch), ["g1", "g2"])
    placed = placed.select("doc_id", "size", "text_crc32", "shard", "g1")
    out = numbered(placed, scratch, "shard", ["doc_id", "g1"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, by the contract; edge cases as in ``shard_documents``."""
    return shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
