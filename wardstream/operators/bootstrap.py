"""Resampling over calibration rows and episode clusters, with replicates as rows and hashes as random numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardstream.functions.hashing import uniform
from wardstream.functions.special import normal_sf

MIN_EVENTS = 5


def poisson_one(u: Column) -> Column:
    """A Poisson(1) number from a uniform one of 52 bits, by inverting the distribution as far as such numbers reach."""
    return F.size(F.filter(F.array(*[F.lit(c) for c in _POISSON]), lambda c: c <= u))


def _cumulated() -> list[float]:
    """P(at most k) for k = 0, 1, ... while it is below the largest uniform number of 52 bits."""
    out, cdf, p, k = [], 0.0, math.exp(-1), 0
    while cdf + p < 1 - 2.0**-52:
        cdf, k = cdf + p, k + 1
        out.append(cdf)
        p /= k
    return out


_POISSON = _cumulated()


def replicates(clusters: DataFrame, key: list[str], reps: int, seed: int = 0) -> DataFrame:
    """Each cluster once per replicate with a Poisson(1) weight: adds ``rep, weight``. Replicates spread over tasks."""
    r = clusters.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    return r.withColumn("weight", poisson_one(uniform(F.concat_ws("|", *[F.col(k).cast("string") for k in key]), F.col("rep"), seed)))


def firing_ratio(test: DataFrame, cal: DataFrame, cluster: list[str], reps: int, k: int = 1, seed: int = 0, score: str = "score") -> DataFrame:
    """Joint bootstrap of the firing rate against nominal k / (n + 1), over clusters on both sides: ``rep, threshold, rate, ratio``.

    A replicate draws calibration clusters with Poisson(1) weights; its threshold is the k-th largest score,
    every score counted as often as its cluster was drawn. Test clusters are drawn likewise; a test row fires
    above the threshold. Only the tail of the calibration scores can hold a threshold: the largest scores of
    so many clusters are taken that no replicate runs out of them, doubling until that holds. Test rows are
    folded to counts per cluster and tail score before replicates multiply them. A replicate without any
    drawn row has null.
    """
    spark = test.sparkSession
    n_cal, size = cal.where(F.col(score).isNotNull()).count(), max(64, 16 * k)
    while True:
        tail = cal.where(F.col(score).isNotNull()).orderBy(F.desc(score), *cluster).limit(size).select(*cluster, F.col(score).alias("__s"))
        per = tail.groupBy(*cluster, "__s").agg(F.count("*").alias("__c"))
        w = replicates(tail.select(*cluster).distinct(), cluster, reps, seed + 1).join(per, cluster)
        order = W.partitionBy("rep").orderBy(F.desc("__s")).rangeBetween(W.unboundedPreceding, 0)
        got = w.withColumn("__cum", F.sum(F.col("weight") * F.col("__c")).over(order)).where(F.col("__cum") >= k).groupBy("rep").agg(F.max("__s").alias("threshold"))
        if size >= n_cal or got.count() == reps:
            break
        size *= 2
    cuts = sorted(r[0] for r in tail.select("__s").distinct().collect())  # at most ``size`` scores
    if not cuts:
        return spark.createDataFrame([], "rep int, threshold double, rate double, ratio double")
    above = test.where(F.col(score) > cuts[0]).select(*cluster, F.explode(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col(score))).alias("threshold"))
    hits = above.groupBy(*cluster, "threshold").agg(F.count("*").alias("__k"))
    sizes = replicates(test.groupBy(*cluster).agg(F.count("*").alias("__n")), cluster, reps, seed)
    drawn = sizes.join(got, "rep").join(hits, [*cluster, "threshold"], "left")
    g = drawn.groupBy("rep", "threshold").agg(F.sum(F.col("weight") * F.coalesce("__k", F.lit(0))).alias("k"), F.sum(F.col("weight") * F.col("__n")).alias("n"))
    rate = F.try_divide("k", "n")
    return g.select("rep", F.col("threshold").cast("double").alias("threshold"), rate.alias("rate"), (rate / F.lit(k / (n_cal + 1))).alias("ratio"))


def ratio_test(reps: DataFrame, point: float, events: int, least: int = MIN_EVENTS, most_empty: float = 0.1) -> DataFrame:
    """One-sided test of a ratio above 1, the bootstrap giving the standard error on the log scale: ``n, log_sd, point, events, z, estimable``.

    Not estimable, with null z (to be reported as p = 1), with fewer than ``least`` events, more than a share
    ``most_empty`` of replicates without any, or no spread; otherwise p is the upper tail of the normal at z.
    """
    g = reps.agg(F.count("*").alias("__all"), F.count_if(F.col("ratio") > 0).alias("n"), F.stddev_samp(F.when(F.col("ratio") > 0, F.log("ratio"))).alias("log_sd"))
    ok = (F.lit(events) >= least) & (F.lit(point) > 0) & (F.col("n") >= (1 - most_empty) * F.col("__all")) & (F.coalesce("log_sd", F.lit(0.0)) > 0)
    return g.select("n", "log_sd", F.lit(float(point)).alias("point"), F.lit(events).alias("events"), F.when(ok, F.lit(math.log(point) if point > 0 else 0.0) / F.col("log_sd")).alias("z"), ok.alias("estimable"))


def paired_contrast(a: DataFrame, b: DataFrame) -> DataFrame:
    """Share of replicates in which one ratio exceeds the other: ``n, share``."""
    j = a.join(b.select("rep", F.col("ratio").alias("other")), "rep").dropna()
    return j.agg(F.count("*").alias("n"), F.avg((F.col("ratio") > F.col("other")).cast("double")).alias("share"))


def one_sided_p(z: float | None) -> float:
    """P(Z >= z), 1 for what :func:`ratio_test` can't estimate."""
    return 1.0 if z is None else normal_sf(z)


def log_spread(reps: DataFrame) -> DataFrame:
    """Sample sd of the log ratio and number of positive replicates: ``n, log_sd``."""
    r = reps.where("ratio > 0")
    return r.agg(F.count("*").alias("n"), F.stddev_samp(F.log("ratio")).alias("log_sd"))
