"""Episodes: flows grouped by keys and absolute time buckets, and the orders they can stand in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardstream.functions.columns import prefix24
from wardstream.functions.hashing import draw, h63, key_hash
from wardstream.operators.history import arrival
from wardstream.operators.ingest import positions
from wardstream.schema import SECOND

FAMILIES: dict[str, list[str]] = {"src-dst": ["src", "dst"], "src": ["src"], "dst": ["dst"], "subnet24": ["src24", "dst24"], "src-dport": ["src", "dport"]}


def with_family(flows: DataFrame, family: str) -> tuple[DataFrame, list[str]]:
    """Flows with the key columns of a family, and their names."""
    keys = FAMILIES[family]
    if family == "subnet24":
        flows = flows.withColumns({"src24": prefix24("src"), "dst24": prefix24("dst")})
    return flows, keys


def bucket(ts: Column, seconds: int | None) -> Column:
    """Absolute-clock bucket number; None means no buckets (0)."""
    return F.lit(0).cast("long") if seconds is None else F.floor(ts / F.lit(seconds * SECOND)).cast("long")


def build(flows: DataFrame, keys: list[str], bucket_s: int | None = None) -> DataFrame:
    """One row per key and bucket: ``nsz, mal, sum_e, smax, first_ts, last_ts, first_pos, ceiling, ev`` (mean evidence), ``ismal``.

    ``flows`` has ``ts, e, label, ingest_id`` (its position in the stream) and optionally ``score`` and
    ``ceiling``. Null keys form groups; null labels count as not malicious. Aggregates combine map-side, so a
    hot key is one state per task.
    """
    has = set(flows.columns)
    f = flows.withColumn("bucket", bucket(F.col("ts"), bucket_s))
    g = f.groupBy(*keys, "bucket").agg(
        F.count("*").alias("nsz"), F.coalesce(F.sum(F.col("label").cast("long")), F.lit(0)).alias("mal"), F.sum("e").alias("sum_e"),
        (F.max("score") if "score" in has else F.lit(None).cast("double")).alias("smax"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min("ingest_id").alias("min_id"),
        F.min(F.struct("ts", "ingest_id")).alias("__first"), (F.max("ceiling") if "ceiling" in has else F.lit(None).cast("double")).alias("ceiling"),
    )
    return g.withColumns({"first_pos": F.col("__first.ingest_id"), "ev": F.col("sum_e") / F.col("nsz"), "ismal": F.col("mal") > 0}).drop("__first", "min_id")


def ordered(episodes: DataFrame, keys: list[str], how: str = "first-flow", seed: int = 0) -> DataFrame:
    """Adds ``pos`` from 1, numbered by range partitions.

    ``first-flow`` (first_ts, first_pos); ``first-tie`` ties of first_ts by a seeded hash; ``keyhash`` and
    ``keyed`` (bucket, 63-bit hash of the key codes, keys), ``keyed`` with a secret seed; ``group-id``
    (keys, bucket); ``last-flow`` (last_ts, first_pos); ``random`` (a seeded hash).
    """
    codes = [F.col(k) if dict(episodes.dtypes)[k] in ("bigint", "int", "smallint", "tinyint") else draw(F.coalesce(F.col(k).cast("string"), F.lit(""))) for k in keys]
    hashed = draw(seed, *keys, "bucket")
    by = {
        "first-flow": ["first_ts", "first_pos"], "first-tie": ["first_ts", hashed, *keys], "keyhash": ["bucket", h63(key_hash(codes)), *keys], "keyed": ["bucket", h63(key_hash(codes, seed)), *keys],
        "group-id": [*keys, "bucket"], "last-flow": ["last_ts", "first_pos"], "random": [hashed, *keys, "bucket"],
    }[how]
    named = {f"__o{i}": c for i, c in enumerate(by) if not isinstance(c, str)}
    order = [c if isinstance(c, str) else f"__o{i}" for i, c in enumerate(by)]
    return positions(episodes.withColumns(named) if named else episodes, order, "pos").drop(*named)


def tie_orders(episodes: DataFrame, keys: list[str], orders: int) -> DataFrame:
    """An ensemble of orders by first_ts whose ties fall by a hash of their own: every episode once per ``seed``, with ``pos``. Each order is numbered in a task of its own."""
    e = episodes.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(orders - 1)))).withColumn("__h", draw("seed", *keys, "bucket"))
    return e.withColumn("pos", F.row_number().over(W.partitionBy("seed").orderBy("first_ts", "__h", *keys)).cast("long")).drop("__h")


def arrival_rank(flows: DataFrame, keys: list[str], bucket_s: int | None = None) -> DataFrame:
    """Adds ``arrival``: 1-based rank within the episode by (ts, ingest_id)."""
    return arrival(flows.withColumn("bucket", bucket(F.col("ts"), bucket_s)), [*keys, "bucket"], "ts", "ingest_id")


def flagged_rank(flows: DataFrame, keys: list[str], flag: str, bucket_s: int | None = None) -> DataFrame:
    """Adds ``flagged``: rank among the flagged flows of the episode (null for others)."""
    return arrival(flows.withColumn("bucket", bucket(F.col("ts"), bucket_s)), [*keys, "bucket"], "ts", "ingest_id", "flagged", F.col(flag))


def evidence_on(partition: DataFrame, flows: DataFrame, keys: list[str], bucket_s: int | None = None, e: str = "e") -> DataFrame:
    """New evidence on a fixed set of episodes: ``keys, bucket, ev`` (0 for episodes without a flow)."""
    g = flows.withColumn("bucket", bucket(F.col("ts"), bucket_s)).groupBy(*keys, "bucket").agg(F.avg(e).alias("ev"))
    return partition.select(*keys, "bucket").join(g, [*keys, "bucket"], "left").withColumn("ev", F.coalesce("ev", F.lit(0.0)))


def alerted_flows(flows: DataFrame, alerts: DataFrame, keys: list[str], bucket_s: int | None = None) -> DataFrame:
    """Flows that lie in an alerted episode."""
    return flows.withColumn("bucket", bucket(F.col("ts"), bucket_s)).join(alerts.select(*keys, "bucket").distinct(), [*keys, "bucket"], "left_semi")


def coverage(flows: DataFrame, alerts: DataFrame, keys: list[str], bucket_s: int | None = None) -> DataFrame:
    """Malicious flows in alerts: ``malicious, covered, share``."""
    f = flows.where("label = 1").withColumn("bucket", bucket(F.col("ts"), bucket_s)).groupBy(*keys, "bucket").agg(F.count("*").alias("n"))
    a = alerts.select(*keys, "bucket").distinct().withColumn("hit", F.lit(True))
    g = f.join(a, [*keys, "bucket"], "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("malicious"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("covered"))
    return g.withColumn("share", F.try_divide("covered", "malicious"))


def whole_stream_groups(flows: DataFrame, alerts: DataFrame, keys: list[str]) -> DataFrame:
    """For the keys of alerts, the group over all flows: ``keys, n, malicious, first_ts, last_ts``."""
    g = flows.join(alerts.select(*keys).distinct(), keys, "left_semi").groupBy(*keys)
    return g.agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("malicious"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def tie_exposure(episodes: DataFrame) -> DataFrame:
    """Ties of first_ts: ``n_tied`` episodes in blocks of two or more, ``blocks`` distinct times, ``b_max`` the largest block, ``fraction``."""
    b = episodes.groupBy("first_ts").agg(F.count("*").alias("c"))
    g = b.agg(F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).alias("n_tied"), F.count("*").alias("blocks"), F.coalesce(F.max("c"), F.lit(0)).alias("b_max"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    return g.withColumn("fraction", F.try_divide("n_tied", "n")).drop("n")


def moved_by_pad(flows: DataFrame, pads: DataFrame, keys: list[str], bucket_s: int | None = None, how: str = "first-flow", seed: int = 0) -> DataFrame:
    """Episodes whose place among the others changes when pads join the stream: ``moved, n``.

    Pads have the columns of flows. Places are compared among the episodes of the unpadded stream only.
    """
    old = ordered(build(flows, keys, bucket_s), keys, how, seed).select(*keys, "bucket", F.col("pos").alias("a"))
    new = ordered(build(flows.unionByName(pads, allowMissingColumns=True), keys, bucket_s), keys, how, seed)
    new = new.join(old.select(*keys, "bucket"), [*keys, "bucket"], "left_semi")
    new = positions(new, ["pos"], "b")
    return old.join(new.select(*keys, "bucket", "b"), [*keys, "bucket"]).agg(F.count_if(F.col("a") != F.col("b")).alias("moved"), F.count("*").alias("n"))


def padded_episodes(flows: DataFrame, pads: DataFrame, keys: list[str], bucket_s: int | None = None) -> DataFrame:
    """Episodes of the padded stream; those without a pad must be as before (see :func:`unpadded_changes`)."""
    return build(flows.unionByName(pads, allowMissingColumns=True), keys, bucket_s)


def unpadded_changes(flows: DataFrame, pads: DataFrame, keys: list[str], bucket_s: int | None = None) -> DataFrame:
    """Episodes that got no pad but differ after padding; empty if padding is local."""
    touched = pads.withColumn("bucket", bucket(F.col("ts"), bucket_s)).select(*keys, "bucket").distinct()
    plain = lambda df: df.join(touched, [*keys, "bucket"], "left_anti").select(*keys, "bucket", "nsz", "mal", "sum_e", "first_ts")
    return plain(build(flows, keys, bucket_s)).exceptAll(plain(padded_episodes(flows, pads, keys, bucket_s)))


def epochs(episodes: DataFrame, epoch_s: int) -> DataFrame:
    """Adds ``epoch``, the absolute-clock epoch of first_ts."""
    return episodes.withColumn("epoch", bucket(F.col("first_ts"), epoch_s))


def epoch_schedule(episodes: DataFrame, epoch_s: int) -> DataFrame:
    """Per epoch: ``epoch, n, first_ts, last_ts, straddling`` (episodes that end in a later epoch)."""
    e = epochs(episodes, epoch_s)
    return e.groupBy("epoch").agg(F.count("*").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.count_if(bucket(F.col("last_ts"), epoch_s) > F.col("epoch")).alias("straddling"))
