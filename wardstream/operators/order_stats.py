"""Running totals and exact percentiles over all rows without a task that holds them all."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardstream.runtime import materialise


def running(df: DataFrame, order: str, value: str, name: str, descending: bool = False) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over rows strictly before in ``order`` (whose values must be distinct).

    Rows are range-partitioned and kept so; each partition adds its own rows and the totals of the
    partitions before, of which there is one row each.
    """
    o = F.desc(order) if descending else F.asc(order)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = materialise(df.repartitionByRange(n, o).withColumn("__runp", F.spark_partition_id()))
    sums = kept.groupBy("__runp").agg(F.sum(value).alias("__runt"))
    before = sums.select("__runp", F.coalesce(F.sum("__runt").over(W.orderBy("__runp").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__runb"))
    inside = kept.withColumn("__runi", F.coalesce(F.sum(value).over(W.partitionBy("__runp").orderBy(o).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(F.broadcast(before), "__runp").withColumn(name, F.col("__runi") + F.col("__runb")).drop("__runp", "__runi", "__runb")


def percentiles(df: DataFrame, column, shares: list[float]) -> list[float | None]:
    """Exact percentiles with linear interpolation of the non-null values (None without any).

    Values are counted, numbered by :func:`running`, and only those at the places asked for reach the driver.
    """
    c = df.select((F.col(column) if isinstance(column, str) else column).cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("c"))
    r = running(c, "v", "c", "b")
    n = r.agg(F.sum("c")).first()[0] or 0
    if not n:
        return [None] * len(shares)
    at = [q * (n - 1) for q in shares]
    places = sorted({int(p) for x in at for p in (math.floor(x), math.ceil(x))})
    hits = r.select("v", F.explode(F.filter(F.array(*[F.lit(p).cast("long") for p in places]), lambda p: (p >= F.col("b")) & (p < F.col("b") + F.col("c")))).alias("p"))
    value = {row.p: row.v for row in hits.collect()}  # two rows per share at most
    return [value[math.floor(x)] + (x - math.floor(x)) * (value[math.ceil(x)] - value[math.floor(x)]) for x in at]


def medians(df: DataFrame, columns: list[str]) -> list[float | None]:
    """:func:`percentiles` at one half for several columns, whose values are numbered together."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)]))
    r = running(df.select(each.alias("k")).where("k.v is not null").groupBy("k").agg(F.count("*").alias("c")), "k", "c", "b")
    at = {x.i: x.b + (x.n - 1) / 2 for x in r.groupBy("k.i").agg(F.min("b").alias("b"), F.sum("c").alias("n")).collect()}  # one row per column
    if not at:
        return [None] * len(columns)
    places = sorted({int(p) for x in at.values() for p in (math.floor(x), math.ceil(x))})
    hits = r.select("k.v", F.explode(F.filter(F.array(*[F.lit(p).cast("long") for p in places]), lambda p: (p >= F.col("b")) & (p < F.col("b") + F.col("c")))).alias("p"))
    value = {row.p: row.v for row in hits.collect()}  # two rows per column at most
    return [(value[math.floor(at[i])] + value[math.ceil(at[i])]) / 2 if i in at else None for i in range(len(columns))]
