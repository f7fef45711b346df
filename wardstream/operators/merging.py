"""Rules that merge the evidence of a group's flows into one number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardstream.functions.special import harmonic


def cap_values(cal_episodes: DataFrame) -> DataFrame:
    """Group-size caps from calibration groups: ``mean, p50, p90, p99, p999, max``, each rounded up and at least 1."""
    up = lambda c: F.greatest(F.ceil(c), F.lit(1)).cast("long")
    q = lambda p: F.percentile("nsz", F.lit(p))
    return cal_episodes.agg(up(F.avg("nsz")).alias("mean"), *[up(q(p)).alias(n) for n, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99), ("p999", 0.999))], up(F.max("nsz")).alias("max"))


def sum_over_cap(episodes: DataFrame, n0: int) -> DataFrame:
    """Evidence sum_e / n0."""
    return episodes.withColumn("ev", F.col("sum_e") / F.lit(float(n0)))


def truncated(ranked: DataFrame, keys: list[str], n0: int) -> DataFrame:
    """Sum of the first ``n0`` arrivals over n0; ``ranked`` has ``arrival``: ``keys, bucket, ev``."""
    return ranked.groupBy(*keys, "bucket").agg((F.sum(F.when(F.col("arrival") <= n0, F.col("e")).otherwise(0.0)) / F.lit(float(n0))).alias("ev"))


def split_groups(ranked: DataFrame, keys: list[str], n0: int) -> DataFrame:
    """Oversized groups cut into pieces of ``n0`` arrivals: ``keys, bucket, piece, nsz, sum_e, ev``."""
    g = ranked.withColumn("piece", F.floor((F.col("arrival") - 1) / n0)).groupBy(*keys, "bucket", "piece").agg(F.count("*").alias("nsz"), F.sum("e").alias("sum_e"))
    return g.withColumn("ev", F.col("sum_e") / F.col("nsz"))


def slot_expectation(episodes: DataFrame, w0: float, total: Column) -> DataFrame:
    """Chance that a slot drawn before the group is seen fires: fired / nsz if ceiling >= total / w0, else 0."""
    fires = F.round(F.col("sum_e") / F.col("ceiling")) / F.col("nsz")
    return episodes.withColumn("slot", F.when(F.col("ceiling") >= total / F.lit(w0), fires).otherwise(0.0))


def weighted(ranked: DataFrame, keys: list[str], rule: str, m0: int = 8, decay: float = 0.5) -> DataFrame:
    """Evidence under weights fixed before the group is seen: ``keys, bucket, ev, weight`` (sum of weights used).

    ``first`` the first arrival only; ``last`` the last; ``uniform`` 1/m0 on the first m0; ``decay``
    (1-d) d^(rank-1).
    """
    n = F.count("*").over(W.partitionBy(*keys, "bucket"))
    a = F.col("arrival")
    w = {"first": F.when(a == 1, 1.0).otherwise(0.0), "last": F.when(a == n, 1.0).otherwise(0.0), "uniform": F.when(a <= m0, 1.0 / m0).otherwise(0.0), "decay": F.lit(1 - decay) * F.pow(F.lit(decay), a - 1)}[rule]
    return ranked.withColumn("__w", w).groupBy(*keys, "bucket").agg(F.sum(F.col("__w") * F.col("e")).alias("ev"), F.sum("__w").alias("weight"))


def prior_weighted(flows: DataFrame, prior: DataFrame, keys: list[str], column: str, default: float = 0.0) -> DataFrame:
    """Weights from an earlier table (``column, weight``), normalised within the group: ``keys, bucket, ev``."""
    f = flows.join(prior.select(column, F.col("weight").alias("__w")), column, "left").withColumn("__w", F.coalesce("__w", F.lit(default)))
    return f.groupBy(*keys, "bucket").agg(F.coalesce(F.try_divide(F.sum(F.col("__w") * F.col("e")), F.sum("__w")), F.lit(0.0)).alias("ev"))


def bonferroni(flows: DataFrame, keys: list[str]) -> DataFrame:
    """min(1, m min p): ``keys, p``."""
    return flows.groupBy(*keys).agg(F.least(F.lit(1.0), F.count("p") * F.min("p")).alias("p"))


def twice_mean(flows: DataFrame, keys: list[str]) -> DataFrame:
    """min(1, 2 mean p): ``keys, p``."""
    return flows.groupBy(*keys).agg(F.least(F.lit(1.0), 2 * F.avg("p")).alias("p"))


def simes(flows: DataFrame, keys: list[str], hommel: bool = False) -> DataFrame:
    """min_i m p_(i) / i, at most 1; ``hommel`` multiplies by the harmonic number of m: ``keys, p``.

    Equal p-values of a group are counted first, so a hot group with few distinct values is small.
    """
    c = flows.where("p is not null").groupBy(*keys, "p").agg(F.count("*").alias("c"))
    w = W.partitionBy(*keys)
    r = c.withColumn("i", F.sum("c").over(w.orderBy("p").rowsBetween(W.unboundedPreceding, 0))).withColumn("m", F.sum("c").over(w))
    g = r.groupBy(*keys).agg(F.min(F.col("m") / F.col("i") * F.col("p")).alias("p"), F.max("m").alias("m"))
    if hommel:
        small = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(F.col("m"), F.lit(1000).cast("long"))), F.lit(0.0), lambda a, i: a + 1.0 / i)
        m = F.col("m").cast("double")
        large = F.log(m) + F.lit(0.5772156649015329) + 0.5 / m - 1.0 / (12 * m * m) + 1.0 / (120 * m * m * m * m)
        g = g.withColumn("p", F.col("p") * F.when(F.col("m") <= 1000, small).otherwise(large))
    return g.select(*keys, F.least(F.lit(1.0), "p").alias("p"))


def hommel_factor(m: int) -> float:
    """H_m."""
    return harmonic(m)
