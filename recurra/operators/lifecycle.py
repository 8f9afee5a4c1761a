"""Groups meet stored clusters: identity, status, membership (K3 to K6, H11, section 2.15 of the survey)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CLUSTERS, MEMBERS
from ..sources.scratch import Scratch
from .skew import join_lookup
from .tables import numbered, overlaps, winners

ABSORBED = ("forming", "candidate")


def next_status(status: Column, qualified: Column, size: Column, dismissed: Column) -> Column:
    back = (F.coalesce(dismissed, F.lit(0)) > 0) & (size >= 2 * dismissed)
    return F.when((status == "forming") & qualified, "candidate").when((status == "dismissed") & back, "candidate").otherwise(status)


def settled(over: DataFrame, clusters: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(root, cluster_id) of the cluster that each group takes, and (cluster_id) of those taken in.

    Groups choose in the order of their roots, each among the clusters left to it. A group chooses in the round in which all
    clusters left to it have no earlier group waiting, so groups that share no cluster choose at once; rounds are as
    many as the longest chain of groups that wait for one another.
    """
    open_ = scratch.save(over, "overlaps")
    taken = gone = None
    while not open_.isEmpty():
        first = open_.groupBy("cluster_id").agg(F.min("root").alias("first"))
        ready = open_.join(first, "cluster_id").groupBy("root").agg(F.bool_and(F.col("root") == F.col("first")).alias("now")).where("now").select("root")
        turn = scratch.save(winners(open_.join(ready, "root"), clusters), "turn")
        take = turn.where("rank = 1").select("root", "cluster_id")
        drop = turn.where((F.col("rank") > 1) & F.col("status").isin(*ABSORBED)).select("cluster_id")
        taken, gone = (take, drop) if taken is None else (taken.unionByName(take), gone.unionByName(drop))
        used = take.select("cluster_id").unionByName(drop)
        rest = open_.join(turn.select("root").distinct(), "root", "left_anti").join(used, "cluster_id", "left_anti")
        open_ = scratch.save(rest, "overlaps")
    if taken is None:
        taken = over.select("root", "cluster_id")
        gone = over.select("cluster_id")
    return taken, gone


def named(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (cluster_id, root, own, wanted): adds fingerprint, unique over all rows.

    A row without ``wanted`` keeps ``own``. A wanted fingerprint goes to the first root that wants it, if no row owns it. A row
    with a fingerprint of its own keeps that otherwise; a new one gets the first ten digits and a counter from 02 that
    no row has.
    """
    own = rows.where("own IS NOT NULL").select(F.col("own").alias("wanted"), F.lit(True).alias("owned"))
    first = rows.where("wanted IS NOT NULL").groupBy("wanted").agg(F.min("root").alias("first"))
    r = rows.join(own, "wanted", "left").join(first, "wanted", "left")
    same = F.coalesce(F.col("own") == F.col("wanted"), F.lit(False))
    gets = same | (F.col("owned").isNull() & (F.col("root") == F.col("first")))
    r = r.withColumn("fingerprint", F.when(F.col("wanted").isNotNull() & gets, F.col("wanted")).otherwise(F.col("own"))).select("cluster_id", "root", "wanted", "fingerprint")
    r = scratch.save(r, "named")
    stem = F.substring("wanted", 1, 10)
    left = r.where("fingerprint IS NULL").select("cluster_id", "root", stem.alias("stem"))
    if left.isEmpty():
        return r.select("cluster_id", "fingerprint")
    left = numbered(left, scratch, ["root"], "k", within="stem")
    held = r.where("fingerprint IS NOT NULL").select(F.substring("fingerprint", 1, 10).alias("stem"), F.substring("fingerprint", 11, 9).alias("tail")).join(left.select("stem").distinct(), "stem", "left_semi")
    held = held.groupBy("stem").agg(F.collect_set(F.expr("try_cast(tail AS INT)")).alias("held"))
    left = left.join(held, "stem", "left").withColumn("held", F.coalesce("held", F.array().cast("array<int>")))
    free = F.array_except(F.sequence(F.lit(2), F.size("held") + F.col("k").cast("int") + 2), F.col("held"))
    n = F.get(free, F.col("k").cast("int")).cast("string")
    left = left.select("cluster_id", F.concat("stem", F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n)).alias("fingerprint"))
    return r.where("fingerprint IS NOT NULL").select("cluster_id", "fingerprint").unionByName(left)


def reconcile(facts: DataFrame, fresh: DataFrame, clusters: DataFrame, members: DataFrame, now: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """New tables of clusters and members.

    facts: a row for each group (root, size, first_day, last_day, qualified, project, fingerprint, title_hint); fresh: (root,
    session_id). Everything stays distributed: overlaps, choices, new ids and fingerprints are joins and aggregates. A
    cluster that was taken in is gone at once, and one goes to the first group that wins it: a later group then gets the
    next best, or a new one. Stored clusters that no group meets stay as they are.
    """
    facts, clusters = scratch.save(facts, "facts"), scratch.save(clusters, "clusters")
    taken, gone = settled(overlaps(fresh, clusters, members), clusters, scratch)
    taken = scratch.save(taken, "taken")
    gone = scratch.save(gone.distinct(), "gone")
    last = clusters.agg(F.max("cluster_id")).first()[0] or 0
    new = numbered(facts.join(taken, "root", "left_anti").select("root"), scratch, ["root"], "k").select("root", (F.col("k") + last + 1).alias("cluster_id"))
    placed = scratch.save(taken.withColumn("met", F.lit(True)).unionByName(new.withColumn("met", F.lit(False))), "placed")
    update = placed.join(facts, "root").select("cluster_id", "met", *[F.col(c).alias(f"g_{c}") for c in facts.columns])
    kept = clusters.join(gone, "cluster_id", "left_anti")
    all_ = scratch.save(kept.join(update, "cluster_id", "full_outer"), "rows")
    met = F.col("g_root").isNotNull()
    stored = F.coalesce("met", F.lit(True))
    wants = F.when(~stored | (F.col("status") == "forming"), F.col("g_fingerprint"))
    names = named(all_.select("cluster_id", F.col("g_root").alias("root"), F.col("fingerprint").alias("own"), wants.alias("wanted")), scratch)
    fresh_status = F.when(F.col("g_qualified"), "candidate").otherwise("forming")
    status = F.when(~stored, fresh_status).when(met, next_status(F.col("status"), F.col("g_qualified"), F.col("g_size"), F.col("dismissed_count"))).otherwise(F.col("status"))
    values = {c: F.when(met, F.col(f"g_{c}")).otherwise(F.col(c)) for c in ("first_day", "last_day", "project", "title_hint")}
    values |= {
        "status": status,
        "session_count": F.when(met, F.col("g_size")).otherwise(F.col("session_count")).cast("int"),
        "dismissed_count": F.when(stored, F.col("dismissed_count")).otherwise(0),
        "updated_at": F.when(met, F.lit(now)).otherwise(F.col("updated_at")),
    }
    out = all_.select("cluster_id", *[values.get(c, F.col(c)).alias(c) for c in CLUSTERS.fieldNames() if c not in ("cluster_id", "fingerprint")])
    out = out.join(names, "cluster_id").select(*CLUSTERS.fieldNames())
    where = placed.join(facts, "root").select("root", "cluster_id", F.col("size").alias("rows"))
    fresh = join_lookup(fresh, where, ["root"], "rows", fresh.count()).select("cluster_id", "session_id")
    replaced = placed.select("cluster_id").unionByName(gone)
    return out, members.join(replaced, "cluster_id", "left_anti").unionByName(fresh).select(*MEMBERS.fieldNames()).distinct()
