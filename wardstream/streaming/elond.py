"""e-LOND on a stream: flows in, episode decisions out, exactly as in batch.

Two queries in a row, as Spark allows no custom state after a windowed aggregation in append mode. The first
groups flows into tumbling buckets per key, many tasks wide, and appends a bucket's hypotheses to a table when
the watermark passes its end; the file sink commits whole batches, so buckets arrive in order. The second
reads that table as a stream and runs the controller, ordered by bucket and inside by the key hash. Its state
is two numbers (hypotheses and rejections so far) per stream. Flows later than the watermark are dropped by
the aggregation and counted by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wardstream.functions.hashing import draw, h63, key_hash
from wardstream.functions.special import zeta

OUT = "stream string, pos long, bucket timestamp, key string, nsz long, ev double, level double, fired boolean"


def episodes_stream(flows: DataFrame, keys: list[str], seconds: int, late: str) -> DataFrame:
    """Closed buckets of a stream of flows with ``time`` (timestamp), ``e`` and keys: ``stream, bucket, key, h, nsz, ev``."""
    codes = [draw(F.coalesce(F.col(k).cast("string"), F.lit(""))) for k in keys]
    f = flows.withColumns({"key": F.concat_ws("|", *keys), "h": h63(key_hash(codes))})
    g = f.withWatermark("time", late).groupBy(F.window("time", f"{seconds} seconds").alias("w"), "key", "h")
    a = g.agg(F.count("*").alias("nsz"), F.avg("e").alias("ev"))
    return a.select(F.lit("all").alias("stream"), F.col("w.start").alias("bucket"), "key", "h", "nsz", "ev")


EPISODE = "stream string, bucket timestamp, key string, h long, nsz long, ev double"


def close_buckets(flows: DataFrame, keys: list[str], seconds: int, late: str, table: str, checkpoint: str, trigger: dict | None = None):
    """Start the first query: closed buckets are appended to the Parquet table at ``table``."""
    w = episodes_stream(flows, keys, seconds, late).writeStream.format("parquet").outputMode("append")
    return w.option("path", table).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def closed(spark: SparkSession, table: str) -> DataFrame:
    """The stream of closed buckets for the second query."""
    return spark.readStream.schema(EPISODE).parquet(table)


def decide(episodes: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The controller over closed buckets (spending ``poly``, which needs no horizon)."""
    z = zeta(1.6)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pos, r = state.get if state.exists else (0, 0)
        pdf = pd.concat(list(batches)).sort_values(["bucket", "h", "key"])
        rows = []
        for x in pdf.itertuples():
            pos += 1
            level = alpha * (pos**-1.6 / z) * (r + 1)
            hit = bool(x.ev >= 1.0 / level)
            r += hit
            rows.append((key[0], pos, x.bucket, x.key, x.nsz, x.ev, level, hit))
        state.update((pos, r))
        yield pd.DataFrame(rows, columns=["stream", "pos", "bucket", "key", "nsz", "ev", "level", "fired"])

    return episodes.groupBy("stream").applyInPandasWithState(step, OUT, "pos long, r long", "append", GroupStateTimeout.NoTimeout)


def decide_batch(episodes: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The same decisions over a finished table of ``bucket, h, key, ev`` (for comparison)."""
    from pyspark.sql import Window as W

    from wardstream.operators.controllers import control

    e = episodes.withColumn("pos", F.row_number().over(W.orderBy("bucket", "h", "key"))).withColumn("ceiling", F.lit(float("inf")))
    return e.drop("level", "fired").join(control(e, "elond", alpha=alpha), "pos")
