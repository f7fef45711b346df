"""Conformal evidence: ranks against benign calibration scores, e-values, p-values.

No operator ranks all rows in one task. A threshold e-value needs only the k-th largest calibration score
(a top-k) and the number of calibration rows, which meet the test rows as one broadcast row. Full ranks
count per distinct score first and add up range partitions (:func:`ranks`).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardstream.functions.hashing import draw, uniform
from wardstream.functions.special import beta_quantile, harmonic
from wardstream.operators.order_stats import running


def kth_largest(cal: DataFrame, k: int, score: str = "score") -> DataFrame:
    """One row ``kth, nc``: the k-th largest score (null if there are fewer) and the number of scores. Null scores don't count."""
    top = cal.select(F.col(score).alias("s")).where("s is not null").orderBy(F.desc("s")).limit(k).agg(F.when(F.count("*") == k, F.min("s")).alias("kth"))
    return top.join(F.broadcast(cal.agg(F.count(score).alias("nc"))))  # one row each


def threshold_evidence(test: DataFrame, cal: DataFrame, k: int = 1, score: str = "score") -> DataFrame:
    """Adds ``e`` (the ceiling (nc+1)/k if the score's rank 1 + #{cal >= score} is at most k, else 0) and ``ceiling``.

    Rank at most k means strictly above the k-th largest score; ties count against the test row. With fewer
    than k calibration scores every row has rank at most k. Null scores get 0.
    """
    t = test.join(F.broadcast(kth_largest(cal, k, score)))
    ceiling = (F.col("nc") + 1) / F.lit(float(k))
    above = F.col(score).isNotNull() & (F.col("kth").isNull() | (F.col(score) > F.col("kth")))
    return t.withColumn("ceiling", ceiling).withColumn("e", F.when(above, ceiling).otherwise(0.0)).drop("kth", "nc")


def ranks(test: DataFrame, cal: DataFrame, score: str = "score") -> DataFrame:
    """Adds ``above`` = #{cal > score}, ``ties`` = #{cal = score}, ``nc`` and ``rank`` = 1 + above + ties to test rows.

    Both sides are counted per distinct score; the distinct scores are range-partitioned, each partition
    adds its own and the partitions above it. Rows with a null score get nulls.
    """
    s = test.select(F.col(score).alias("__s")).where("__s is not null").distinct().select("__s", F.lit(0).cast("long").alias("__c"))
    c = cal.select(F.col(score).alias("__s")).where("__s is not null").groupBy("__s").agg(F.count("*").alias("__c"))
    every = s.unionByName(c).groupBy("__s").agg(F.sum("__c").alias("__c"))
    total = every.agg(F.coalesce(F.sum("__c"), F.lit(0)).alias("nc"))
    g = running(every, "__s", "__c", "above", descending=True).select("__s", "above", F.col("__c").alias("ties"))
    return test.join(g, F.col(score) == F.col("__s"), "left").join(F.broadcast(total)).drop("__s").withColumn("rank", 1 + F.col("above") + F.col("ties"))


def smoothed_p(above: Column, ties: Column, nc: Column, u: Column) -> Column:
    """(G + U (1 + E)) / (nc + 1)."""
    return (above + u * (1 + ties)) / (nc + 1)


def conformal_p(rank: Column, nc: Column) -> Column:
    """rank / (nc + 1)."""
    return rank / (nc + 1)


def calibrated(p: Column, lam: float) -> Column:
    """The p-to-e calibrator lam p^(lam - 1)."""
    return F.lit(lam) * F.pow(p, F.lit(lam - 1))


def harmonic_e(rank: Column, nc: int) -> Column:
    """(nc + 1) / (rank H_{nc+1})."""
    return F.lit((nc + 1) / harmonic(nc + 1)) / rank


def draws(df: DataFrame, identity: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` smoothing draws per row: ``draw`` and a deterministic uniform ``u``."""
    return df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("u", uniform(F.col(identity), F.col("draw"), seed))


def stratified_evidence(test: DataFrame, cal: DataFrame, stratum: str, k: int = 1, score: str = "score", salt: int = 16) -> DataFrame:
    """Threshold evidence within strata: adds ``e`` and ``ceiling`` (null where the stratum has no calibration rows; e is 0 there).

    The k largest of a stratum come from the k largest of its hash parts, so a stratum with a third of all
    rows is not sorted in one task.
    """
    part = F.pmod(F.xxhash64(F.col("__s"), F.monotonically_increasing_id()), F.lit(salt)).alias("__p")
    c = cal.select(F.col(stratum).alias("__z"), F.col(score).alias("__s")).where("__s is not null")
    top = c.select("__z", "__s", part).withColumn("__r", F.row_number().over(W.partitionBy("__z", "__p").orderBy(F.desc("__s")))).where(F.col("__r") <= k)
    kth = top.withColumn("__q", F.row_number().over(W.partitionBy("__z").orderBy(F.desc("__s")))).where(F.col("__q") == k).select("__z", F.col("__s").alias("__k"))
    n = c.groupBy("__z").agg(F.count("*").alias("__n"))
    s = n.join(kth, n["__z"].eqNullSafe(kth["__z"]), "left").select(n["__z"].alias("__z"), "__n", "__k")
    t = test.join(s, test[stratum].eqNullSafe(s["__z"]), "left")
    ceiling = (F.col("__n") + 1) / F.lit(float(k))
    above = F.col("__n").isNotNull() & F.col(score).isNotNull() & (F.col("__k").isNull() | (F.col(score) > F.col("__k")))
    return t.withColumn("ceiling", ceiling).withColumn("e", F.when(above, ceiling).otherwise(0.0)).drop("__z", "__n", "__k")


def contaminated_recall(test: DataFrame, cal: DataFrame, pool: DataFrame, amounts: list[int], reps: int, identity: str = "ingest_id", score: str = "score", salt: int = 16) -> DataFrame:
    """Recall of threshold evidence (k = 1) after ``a`` malicious scores got into the calibration: ``a, seed, threshold, recall``, for every amount and repetition.

    A repetition takes the pool rows of smallest hash, so larger amounts hold the smaller ones; the smallest
    of a repetition come from the smallest of its salted parts. Test rows meet the few distinct thresholds only.
    """
    most, kth = max(amounts), cal.agg(F.max(score)).first()[0]
    r = pool.select(identity, F.col(score).alias("__s"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("seed")).withColumn("__h", draw("seed", identity))
    part = r.withColumn("__p", F.pmod(F.col("__h"), F.lit(salt)))
    few = part.withColumn("__r", F.row_number().over(W.partitionBy("seed", "__p").orderBy("__h", identity))).where(F.col("__r") <= most)
    few = few.withColumn("__r", F.row_number().over(W.partitionBy("seed").orderBy("__h", identity))).where(F.col("__r") <= most)
    grid = test.sparkSession.createDataFrame([(a, s) for a in amounts for s in range(reps)], "a int, seed int")
    drawn = grid.join(few.select("seed", "__r", "__s"), "seed", "left").groupBy("a", "seed").agg(F.greatest(F.lit(kth), F.max(F.when(F.col("__r") <= F.col("a"), F.col("__s")))).alias("threshold"))
    bad = test.where("label = 1").groupBy(F.col(score).alias("__v")).agg(F.count("*").alias("__c"))
    cuts = drawn.select("threshold").distinct()
    levels = [x[0] for x in cuts.collect()]  # at most amounts * repetitions
    passed = bad.select(F.explode(F.filter(F.array(*[F.lit(float(x)) for x in levels]), lambda c: c < F.col("__v"))).alias("threshold"), "__c").groupBy("threshold").agg(F.sum("__c").alias("__k"))
    n = bad.agg(F.sum("__c").alias("__n"))
    return drawn.join(passed, "threshold", "left").join(F.broadcast(n)).select("a", "seed", "threshold", F.try_divide(F.coalesce("__k", F.lit(0)), "__n").alias("recall"))  # one row


def ceiling_nominal(n: int, k: int = 1) -> float:
    """(n + 1) / k."""
    return (n + 1) / k


def ceiling_beta(n: int, k: int, delta: float) -> float:
    """Calibration-conditional ceiling 1 / Q_{1-delta}(Beta(k, n + 1 - k))."""
    return 1.0 / beta_quantile(1 - delta, k, n + 1 - k)


def ceiling_dkw(n: int, k: int, delta: float) -> float:
    """The same by a uniform bound: 1 / (k/n + sqrt(log(1/delta) / (2n)))."""
    return 1.0 / (k / n + math.sqrt(math.log(1 / delta) / (2 * n)))


def optimal_boost(values: list[float], probs: list[float], tau: float) -> float:
    """Largest b with E[b V; b V >= tau] <= 1, by bisection (infinite if V never matters)."""

    def spent(b: float) -> float:
        return sum(p * b * v for v, p in zip(values, probs) if b * v >= tau)

    if not any(p > 0 and v > 0 for v, p in zip(values, probs)):
        return math.inf
    lo, hi = 0.0, 1.0
    while spent(hi) <= 1 and hi < 1e18:
        lo, hi = hi, hi * 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if spent(mid) <= 1 else (lo, mid)
    return lo


def empirical_boost(test: DataFrame) -> DataFrame:
    """1 / (ceiling * share of rows with evidence): ``boost`` (null if none fires)."""
    return test.agg(F.try_divide(F.lit(1.0), F.max("ceiling") * F.avg(F.when(F.col("e") > 0, 1.0).otherwise(0.0))).alias("boost"))


def firing_rates(benign: DataFrame, depths: list[int]) -> DataFrame:
    """Share of benign rows of rank at most k against the nominal k/(nc+1), per depth: ``k, fired, n, rate, nominal, ratio``."""
    e = benign.withColumn("k", F.explode(F.array(*[F.lit(k) for k in depths])))
    g = e.groupBy("k").agg(F.count_if(F.col("rank") <= F.col("k")).alias("fired"), F.count("rank").alias("n"), F.max("nc").alias("nc"))
    g = g.withColumns({"rate": F.try_divide("fired", "n"), "nominal": F.col("k") / (F.col("nc") + 1)})
    return g.select("k", "fired", "n", "rate", "nominal", (F.col("rate") / F.col("nominal")).alias("ratio"))


def rolling_p(df: DataFrame, order: str, width: int, score: str = "score", block: int = 100_000) -> DataFrame:
    """p-value of each row against the ``width`` rows before it: (1 + #{earlier >= score}) / (1 + earlier rows).

    ``order`` is a 1-based position. Blocks of ``block`` positions run in parallel, each with a copy of the
    ``width`` rows before its start, so no window spans the stream.
    """
    size = max(width, block)
    own = F.floor((F.col(order) - 1) / size)
    late = F.floor((F.col(order) - 1 + width) / size)
    copies = df.withColumn("__b", F.explode(F.sequence(own, late))).withColumn("__own", F.col("__b") == own)
    w = W.partitionBy("__b").orderBy(order).rowsBetween(-width, -1)
    got = copies.withColumn("__past", F.collect_list(score).over(w))
    return got.where("__own").withColumn("p", (1 + F.size(F.filter("__past", lambda x: x >= F.col(score)))) / (1 + F.size("__past"))).drop("__b", "__own", "__past")
