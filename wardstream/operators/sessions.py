"""Sessions: stretches of activity of an entity separated by idle time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardstream.functions.columns import host
from wardstream.runtime import one_scan
from wardstream.schema import SECOND

GAP_S = 1800


def sessionize(events: DataFrame, keys: list[str], ts: str, gap: int) -> DataFrame:
    """Cut each key's events into sessions; neighbours at most ``gap`` apart share one.

    ``ts`` is a whole number in any unit, ``gap`` in the same. Result: ``keys``, ``session_no`` (from 1,
    in time order), ``start``, ``end``, ``duration``, ``n_events``.

    Method: lag per key flags the gaps, a running sum of the flags numbers the sessions, an aggregate
    closes them. The window does not run over raw events: events of a key in one absolute time slot as
    wide as the gap always share a session, so they are folded first, with map-side combine, to first,
    last and count. A key with a third of all rows then has at most (time span / gap) rows in its
    window, however many events it has.

    Nulls in ``ts`` or in a key: the event takes no part. Ties and repeated rows share a session and
    each counts. An empty input gives an empty result. Other columns are ignored.
    """
    k = [F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)]
    names = [f"__k{i}" for i in range(len(keys))]
    e = events.select(*k, F.col(ts).cast("long").alias("__t")).dropna()
    slots = (
        e.groupBy(*names, (F.col("__t") - F.pmod("__t", F.lit(gap).cast("long"))).alias("__slot"))
        .agg(F.min("__t").alias("__a"), F.max("__t").alias("__b"), F.count("*").alias("__n"))
    )
    w = W.partitionBy(*names).orderBy("__slot")
    cut = slots.withColumn("__new", F.when(F.col("__a") - F.lag("__b").over(w) <= gap, 0).otherwise(1))
    numbered = cut.withColumn("session_no", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = numbered.groupBy(*names, "session_no").agg(F.min("__a").alias("start"), F.max("__b").alias("end"), F.sum("__n").alias("n_events"))
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, keys)), "session_no", "start", "end", (F.col("end") - F.col("start")).alias("duration"), "n_events")


def by_side(flows: DataFrame, *columns: str) -> DataFrame:
    """Each flow as a row of its source and one of its destination: ``side``, ``host``, ``peer``, columns."""
    keep = [F.col(c) for c in columns]
    f = flows.select(host("src").alias("__s"), host("dst").alias("__d"), *keep)
    rows = [F.struct(F.lit(s).alias("side"), F.col(a).alias("host"), F.col(b).alias("peer"), *keep) for s, a, b in (("src", "__s", "__d"), ("dst", "__d", "__s"))]
    return one_scan(f, rows)


def host_sessions(flows: DataFrame, gap_s: int = GAP_S) -> DataFrame:
    """Sessions of each host on each side: ``side, host, session_no, start_us, end_us, duration_us, n_flows``.

    Flows whose ``ts`` is null or 0, and null hosts, take no part on that side.
    """
    f = by_side(flows.where("ts is not null and ts <> 0"), "ts").where("host is not null")
    s = sessionize(f, ["side", "host"], "ts", gap_s * SECOND)
    return s.select("side", "host", "session_no", F.col("start").alias("start_us"), F.col("end").alias("end_us"), F.col("duration").alias("duration_us"), F.col("n_events").alias("n_flows"))
