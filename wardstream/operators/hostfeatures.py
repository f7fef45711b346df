"""Causal features of hosts: what was known strictly before a flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstream.operators.history import before


def host_features(flows: DataFrame, failed: Column) -> DataFrame:
    """Adds ``src_cnt, src_peers, src_fail, dst_cnt, dst_peers, dst_fail``: flows, distinct peers and share of failed
    connections of the source (of the destination) over flows with a strictly earlier ts. Needs ``ts, src, dst, ingest_id``."""
    rows = flows.withColumn("__bad", F.coalesce(failed, F.lit(False)).cast("long"))
    met = rows.where("ts is not null").groupBy("src", "dst").agg(F.min("ts").alias("ts"))  # a peer counts from the pair's first flow on, for both hosts
    out = rows
    for side in ("src", "dst"):
        seen = rows.selectExpr(side, "ts", "1L as __n", "0L as __new", "__bad").union(met.selectExpr(side, "ts", "0L", "1L", "0L"))
        out = before(out, [side], "ts", {f"{side}_cnt": F.col("__n"), f"{side}_peers": F.col("__new"), "__f": F.col("__bad")}, of=seen)
        out = out.withColumn(f"{side}_fail", F.col("__f") / F.greatest(F.col(f"{side}_cnt"), F.lit(1))).drop("__f")
    return out.drop("__bad")


def state_at(flows: DataFrame, src: str, dst: str, t: int, failed: Column) -> DataFrame:
    """The six counters of one pair of hosts at time ``t``, flows at t included."""
    now = flows.where(F.col("ts") <= t)
    bad = F.coalesce(failed, F.lit(False))
    one = lambda side, peer, host: [
        F.count_if(F.col(side) == host).alias(f"{side}_cnt"), F.count_distinct(F.when(F.col(side) == host, F.col(peer))).alias(f"{side}_peers"),
        (F.count_if((F.col(side) == host) & bad) / F.greatest(F.count_if(F.col(side) == host), F.lit(1))).alias(f"{side}_fail"),
    ]
    return now.agg(*one("src", "dst", src), *one("dst", "src", dst))


def pad_contexts(state: DataFrame, pads: int, known_pair: bool = True) -> DataFrame:
    """What the k-th appended pad (k from 1) sees of both hosts: counts grow by k-1, failures stay, a new pair adds one peer from the second pad on."""
    k = state.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(pads))))
    out = k
    for s in ("src", "dst"):
        cnt = F.col(f"{s}_cnt") + F.col("k") - 1
        fail = F.col(f"{s}_fail") * F.greatest(F.col(f"{s}_cnt"), F.lit(1)) / F.greatest(cnt, F.lit(1))
        peers = F.col(f"{s}_peers") + (F.lit(0) if known_pair else F.when(F.col("k") > 1, 1).otherwise(0))
        out = out.withColumns({f"__c{s}": cnt, f"__f{s}": fail, f"__p{s}": peers})
    return out.select("k", *[F.col(f"__{a}{s}").alias(f"{s}_{n}") for s in ("src", "dst") for a, n in (("c", "cnt"), ("p", "peers"), ("f", "fail"))])
