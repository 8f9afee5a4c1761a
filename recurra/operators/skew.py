"""Joins on keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from one in so many rows on; there can't be more hot keys than this, so that they may be broadcast.
HOT_SHARE = 10_000


def join_lookup(left: DataFrame, right: DataFrame, on: list[str], rows: str, total: int) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has each key once and in column ``rows`` how many rows ``left`` has of it.

    Hot keys, at most ``HOT_SHARE`` of them whatever the size of either side, are looked up by broadcast, so their rows
    stay where they are. What is left is shuffled and has no key with more than that share of ``total``, the number
    of rows of ``left``. ``left`` is read twice: write it first. Column ``rows`` is not returned; null keys join nothing.
    """
    gets = [c for c in right.columns if c not in on and c != rows]
    if total <= HOT_SHARE:  # each key has a row of left at least, so there are no more keys than that
        return left.join(F.broadcast(right.select(*on, *gets)), on).select(*left.columns, *gets)
    hot = total / HOT_SHARE
    few = right.where(F.col(rows) > hot).select(*on, F.struct(*gets, F.lit(True).alias("hot")).alias("_hot"))
    met = left.join(F.broadcast(few), on, "left")
    by_hot = met.where("_hot IS NOT NULL").select(*left.columns, *[F.col(f"_hot.{c}").alias(c) for c in gets])
    rest = met.where("_hot IS NULL").select(*left.columns).join(right.where(F.col(rows) <= hot).select(*on, *gets), on)
    return by_hot.unionByName(rest)
