"""Metrics over alerts, episodes and configurations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardstream.functions.hashing import draw
from wardstream.functions.special import binom_cdf, normal_isf
from wardstream.operators.ingest import positions
from wardstream.operators.order_stats import percentiles, running


def auroc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve with ties at half weight: ``n_pos, n_neg, auroc`` (null if a class is missing).

    Works on counts per distinct score; those are numbered by range partitions.
    """
    c = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("q"))
    g = running(c, "s", "q", "b").agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.sum(F.col("p") * (F.col("b") + F.col("q") / 2.0)).alias("u"))
    return g.select("n_pos", "n_neg", F.try_divide("u", F.col("n_pos") * F.col("n_neg")).alias("auroc"))


def aurocs(df: DataFrame, by: str, score: str = "score", label: str = "label") -> DataFrame:
    """:func:`auroc` for every value of ``by`` that has rows, all numbered together: ``by, n_pos, n_neg, auroc``."""
    c = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.struct(F.col(by).alias("by"), F.col(score).alias("s")).alias("k")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("q"))
    g = running(c, "k", "q", "b").groupBy(F.col("k.by").alias(by)).agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.min("b").alias("first"), F.sum(F.col("p") * (F.col("b") + F.col("q") / 2.0)).alias("u"))
    return g.select(by, "n_pos", "n_neg", F.try_divide(F.col("u") - F.col("n_pos") * F.col("first"), F.col("n_pos") * F.col("n_neg")).alias("auroc"))


def summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Min, median, max, mean, sample sd and number of non-null values per group."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.min(v).alias("min"), F.percentile(v, F.lit(0.5)).alias("median"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.count(v).alias("n"))


def rates(run: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per stream (``fired, silent, ismal``): ``alerts, tp, fp, malicious, t, fdp`` (null without alerts), ``fdp0`` (0 then), ``recall, silent_share, first_silent``."""
    g = run.groupBy(*(by or [])).agg(
        F.count_if("fired").alias("alerts"), F.count_if(F.col("fired") & F.col("ismal")).alias("tp"), F.count_if("ismal").alias("malicious"), F.count("*").alias("t"),
        F.count_if("silent").alias("silent"), F.min(F.when(F.col("silent"), F.col("pos"))).alias("first_silent"),
    )
    g = g.withColumn("fp", F.col("alerts") - F.col("tp"))
    return g.withColumns({"fdp": F.try_divide("fp", "alerts"), "fdp0": F.col("fp") / F.greatest("alerts", F.lit(1)), "recall": F.try_divide("tp", "malicious"), "silent_share": F.try_divide("silent", "t")})


def tail_reach(flows: DataFrame) -> DataFrame:
    """Share of malicious and of benign flows with evidence, and the benign one against nominal: ``mal_rate, benign_rate, benign_ratio``."""
    hit = F.when(F.col("e") > 0, 1.0).otherwise(0.0)
    g = flows.agg(F.avg(F.when(F.col("label") == 1, hit)).alias("mal_rate"), F.avg(F.when(F.col("label") == 0, hit)).alias("benign_rate"), F.max("ceiling").alias("c"))
    return g.select("mal_rate", "benign_rate", (F.col("benign_rate") * F.col("c")).alias("benign_ratio"))


def frontier(episodes: DataFrame, score: str = "smax") -> DataFrame:
    """Cumulative true and false alerts by falling score (ties by position): ``k, tp, fp, fdp, recall``."""
    k = positions(episodes.select((-F.col(score)).alias("__s"), "pos", F.col("ismal").cast("long").alias("__m")), ["__s", "pos"], "k")
    f = running(k, "k", "__m", "__b").join(F.broadcast(episodes.agg(F.count_if("ismal").alias("all"))))  # one row
    f = f.withColumn("tp", F.col("__b") + F.col("__m")).withColumn("fp", F.col("k") - F.col("tp"))
    return f.select("k", "tp", "fp", (F.col("fp") / F.col("k")).alias("fdp"), F.try_divide("tp", "all").alias("recall"))


def frontier_at_budget(front: DataFrame, budget: float) -> DataFrame:
    """Expected tp and fp at a fractional number of alerts, between the two neighbouring cuts; beyond the last cut its values."""
    lo = int(budget)
    at = front.where((F.col("k") == lo) | (F.col("k") == lo + 1))
    top = front.agg(F.max_by("tp", "k").alias("t"), F.max_by("fp", "k").alias("f"))
    g = at.agg(*[F.coalesce(F.max(F.when(F.col("k") == k, F.col(c))), F.lit(None)).alias(f"{c}{i}") for i, k in enumerate((lo, lo + 1)) for c in ("tp", "fp")])
    share = F.lit(budget - lo)
    g = g.join(F.broadcast(top))  # one row
    val = lambda c, t: F.when(F.col(f"{c}1").isNull(), F.coalesce(F.col(f"{c}0"), F.col(t))).otherwise(F.coalesce(F.col(f"{c}0"), F.lit(0)) * (1 - share) + F.col(f"{c}1") * share)
    return g.select(val("tp", "t").cast("double").alias("tp"), val("fp", "f").cast("double").alias("fp"))


def frontier_at_fdp(front: DataFrame, q: float) -> DataFrame:
    """The cut of most true alerts among those with FDP at most q, the smaller FDP on ties: ``k, tp, fdp, recall``."""
    s = F.struct("tp", (-F.col("fdp")).alias("m"), "k", "fdp", "recall")
    return front.where(F.col("fdp") <= q).agg(F.max(s).alias("b")).select("b.k", "b.tp", "b.fdp", "b.recall")


def suffix_sums(df: DataFrame, order: str, value: str) -> DataFrame:
    """Adds ``tail``: the sum over this and all later positions."""
    return running(df, order, value, "__later", descending=True).withColumn("tail", F.col("__later") + F.col(value)).drop("__later")


def average_ranks(df: DataFrame, column: str, name: str, order_by=None) -> DataFrame:
    """Adds ranks with ties averaged, from counts per distinct value; null values have none."""
    c = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__v")).agg(F.count("*").alias("__c"))
    ranks = running(c, "__v", "__c", "__b").select("__v", (F.col("__b") + (F.col("__c") + 1) / 2.0).alias(name))
    return df.join(ranks, F.col(column) == F.col("__v"), "left").drop("__v")


def correlation(a: str, b: str) -> Column:
    """Pearson correlation as an aggregate over rows where both are known; null where one does not vary."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    spread = F.stddev_pop(F.when(both, F.col(a))) * F.stddev_pop(F.when(both, F.col(b)))
    return F.try_divide(F.covar_pop(a, b), spread)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman correlation with tied ranks averaged, over rows where both are known: ``n, rho``."""
    d = df.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    r = average_ranks(average_ranks(d, "a", "ra"), "b", "rb")
    return r.agg(F.count("*").alias("n"), correlation("ra", "rb").alias("rho"))


def time_histogram(df: DataFrame, ts: str, lo: int, hi: int, bins: int = 10) -> DataFrame:
    """Counts per equal slice of [lo, hi], the right edge in the last: ``bin, n``."""
    i = F.least(F.floor((F.col(ts) - lo) / F.lit(float(hi - lo)) * bins), F.lit(bins - 1))
    return df.where(F.col(ts).between(lo, hi)).groupBy(i.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def concentration(df: DataFrame, column: str, top: int = 1, mass: float = 0.9) -> DataFrame:
    """How much of the rows few values hold: ``n, n_values, top_share, hhi, n_for_mass`` (values that cover ``mass``)."""
    c = df.groupBy(column).agg(F.count("*").alias("c"))
    sizes = c.groupBy("c").agg(F.count("*").alias("m"))  # values of equal size fold together
    w = W.orderBy(F.desc("c")).rowsBetween(W.unboundedPreceding, -1)
    t = sizes.agg(F.sum(F.col("c") * F.col("m")).alias("n"), F.sum("m").alias("v"))
    s = sizes.withColumns({"vb": F.coalesce(F.sum("m").over(w), F.lit(0)), "nb": F.coalesce(F.sum(F.col("c") * F.col("m")).over(w), F.lit(0))}).join(F.broadcast(t))
    in_top = F.least(F.greatest(F.lit(top) - F.col("vb"), F.lit(0)), F.col("m")) * F.col("c")
    need = F.lit(mass) * F.col("n") - F.col("nb")
    for_mass = F.least(F.greatest(F.ceil(need / F.col("c")), F.lit(0)), F.col("m"))
    return s.agg(F.max("n").alias("n"), F.max("v").alias("n_values"), F.sum(in_top / F.col("n")).alias("top_share"), F.sum(F.col("m") * F.pow(F.col("c") / F.col("n"), F.lit(2.0))).alias("hhi"), F.sum(for_mass).cast("long").alias("n_for_mass"))


def enrichment(df: DataFrame, base: DataFrame, column: str) -> DataFrame:
    """Share of each value among some rows against its share in a base: ``value, n, share, base_share, ratio``."""
    share = lambda d, n: d.groupBy(F.col(column).alias("value")).agg(F.count("*").alias(n))
    a, b = share(df, "n"), share(base, "m")
    ta, tb = a.agg(F.sum("n").alias("tn")), b.agg(F.sum("m").alias("tm"))
    j = a.join(b.withColumnRenamed("value", "v2"), F.col("value").eqNullSafe(F.col("v2")), "left").join(F.broadcast(ta)).join(F.broadcast(tb))
    out = j.select("value", "n", (F.col("n") / F.col("tn")).alias("share"), F.coalesce(F.col("m") / F.col("tm"), F.lit(0.0)).alias("base_share"))
    return out.withColumn("ratio", F.try_divide("share", "base_share"))


def without_top(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows without those of the ``n`` most frequent keys (ties by key)."""
    top = df.groupBy(*keys).agg(F.count("*").alias("__c")).orderBy(F.desc("__c"), *keys).limit(n)
    cond = [df[k].eqNullSafe(top[k]) for k in keys]
    return df.join(top, cond, "left_anti")


def score_gap(cal: DataFrame, score: str = "score") -> DataFrame:
    """Gap between the two largest scores against the interquartile range: ``gap, iqr, ratio``."""
    top = cal.select(F.col(score).alias("s")).where("s is not null").orderBy(F.desc("s")).limit(2).agg((F.max("s") - F.min("s")).alias("gap"))
    lo, hi = percentiles(cal, score, [0.25, 0.75])
    return top.withColumn("iqr", F.lit(None if lo is None else hi - lo).cast("double")).withColumn("ratio", F.try_divide("gap", "iqr"))


def wilson_columns(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson interval of k of n as expressions (null for n = 0)."""
    p, z2 = k / F.nullif(n, F.lit(0)), z * z
    mid = p + z2 / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return F.greatest(F.lit(0.0), (mid - half) / (1 + z2 / n)), F.least(F.lit(1.0), (mid + half) / (1 + z2 / n))


def strata(df: DataFrame, column: str, support: int, top: int) -> DataFrame:
    """Adds ``stratum``: the value if it has at least ``support`` rows and is among the ``top`` most frequent (ties by value), else ``other``."""
    c = df.groupBy(column).agg(F.count("*").alias("__c")).where(F.col("__c") >= support).orderBy(F.desc("__c"), column).limit(top)
    c = c.select(F.col(column).alias("__v"), F.lit(True).alias("__in"))
    return df.join(c, F.col(column) == F.col("__v"), "left").withColumn("stratum", F.when(F.col("__in"), F.col(column).cast("string")).otherwise("other")).drop("__v", "__in")


def jaccard(sets: DataFrame, by: str, member: str) -> DataFrame:
    """Jaccard index of every pair of runs' sets: ``a, b, both, either, jaccard`` (null if both are empty; runs with no member don't appear)."""
    d = sets.select(F.col(by).alias("r"), F.col(member).alias("m")).distinct()
    n = d.groupBy("r").agg(F.count("*").alias("n"))
    # Pairs of runs from their sizes; members only meet on equality.
    both = d.select(F.col("r").alias("a"), "m").join(d.select(F.col("r").alias("b"), "m"), "m").where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    j = both.join(n.select(F.col("r").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("r").alias("b"), F.col("n").alias("nb")), "b")
    return j.select("a", "b", "both", (F.col("na") + F.col("nb") - F.col("both")).alias("either")).withColumn("jaccard", F.try_divide("both", "either"))


def inclusion_jaccard(prob: DataFrame) -> DataFrame:
    """Expected overlap of two independent draws from inclusion probabilities ``p``: sum p^2 / sum (2p - p^2)."""
    return prob.agg(F.try_divide(F.sum(F.col("p") * F.col("p")), F.sum(2 * F.col("p") - F.col("p") * F.col("p"))).alias("jaccard"))


def detection_probability(draws: DataFrame, keys: list[str]) -> DataFrame:
    """Share of draws in which an episode fired: ``keys, p``."""
    return draws.groupBy(*keys).agg(F.avg(F.col("fired").cast("double")).alias("p"))


def mid_rank(df: DataFrame, column: str, value: Column) -> DataFrame:
    """Percentile of a value among a column, ties at half weight: ``percentile``."""
    return df.agg((100 * F.avg(F.when(F.col(column) < value, 1.0).when(F.col(column) == value, 0.5).when(F.col(column) > value, 0.0))).alias("percentile"))


def tie_distribution(runs: DataFrame, value: str, fixed: float) -> DataFrame:
    """A metric over randomised tie orders: ``n, n_distinct, undefined, sd, percentile`` of the deterministic value."""
    v = F.col(value)
    return runs.agg(F.count("*").alias("n"), F.count_distinct(v).alias("n_distinct"), F.avg(F.when(v.isNull(), 1.0).otherwise(0.0)).alias("undefined"), F.stddev_samp(v).alias("sd"), (100 * F.avg(F.when(v < fixed, 1.0).when(v == fixed, 0.5).when(v > fixed, 0.0))).alias("percentile"))


def best_of(df: DataFrame, by: list[str], choice: str, value: str, priority: str) -> DataFrame:
    """The choice of largest value per group, ties to the smallest priority: ``by, choice, value``."""
    b = F.max(F.struct(F.col(value).alias("v"), (-F.col(priority)).alias("p"), F.col(choice).alias("c"))).alias("b")
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(b).select(*by, F.col("b.c").alias(choice), F.col("b.v").alias(value))


def regret(df: DataFrame, by: list[str], choice: str, value: str, chosen: DataFrame) -> DataFrame:
    """(best - chosen) / (best - worst) per group, null where all are equal: ``by, choice, regret``."""
    g = df.groupBy(*by).agg(F.max(value).alias("__hi"), F.min(value).alias("__lo"))
    j = chosen.join(df.select(*by, choice, F.col(value).alias("__v")), [*by, choice]).join(g, by)
    return j.select(*by, choice, F.try_divide(F.col("__hi") - F.col("__v"), F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))).alias("regret"))


def transfer_previous(df: DataFrame, window: str, choice: str, value: str, priority: str) -> DataFrame:
    """Use the previous window's best choice in each window: ``window, choice, regret``."""
    best = best_of(df, [window], choice, value, priority)
    order = W.orderBy(window)
    nxt = df.select(window).distinct().withColumn("__n", F.lead(window).over(order)).where("__n is not null")  # one row per window
    used = best.join(nxt, window).select(F.col("__n").alias(window), choice)
    return regret(df, [window], choice, value, used)


def transfer_left_out(df: DataFrame, window: str, choice: str, value: str, priority: str) -> DataFrame:
    """Use the choice that is best on average over all other windows: ``window, choice, regret``."""
    t = df.groupBy(choice, priority).agg(F.sum(value).alias("__s"), F.count(value).alias("__c"))
    rest = df.join(t, [choice, priority]).select(window, choice, priority, F.try_divide(F.col("__s") - F.coalesce(value, F.lit(0.0)), F.col("__c") - F.when(F.col(value).isNull(), 0).otherwise(1)).alias("__m"))
    used = best_of(rest, [window], choice, "__m", priority).select(window, choice)
    return regret(df, [window], choice, value, used)


def verdict(alert: DataFrame) -> DataFrame:
    """Five-way verdict on an alert from ``mal, mal_elsewhere, n_steps, compromised``: adds ``verdict``.

    Labelled malicious flows: confirmed; a compromised host with a nearby step: likely; only one of the two:
    possible; attack traffic of the host elsewhere: related; none: unsupported.
    """
    step, comp = F.coalesce(F.col("n_steps"), F.lit(0)) > 0, F.coalesce(F.col("compromised"), F.lit(False))
    v = F.when(F.col("mal") > 0, "confirmed").when(step & comp, "likely").when(step | comp, "possible").when(F.coalesce(F.col("mal_elsewhere"), F.lit(0)) > 0, "related").otherwise("unsupported")
    return alert.withColumn("verdict", v)


def fdp_interval(alerts: DataFrame) -> DataFrame:
    """FDP if all open verdicts were true, and if all were false: ``n, low, high``."""
    n = F.count("*")
    no, yes = F.count_if(F.col("verdict") == "unsupported"), F.count_if(F.col("verdict") == "confirmed")
    return alerts.agg(n.alias("n"), F.try_divide(no, n).alias("low"), F.try_divide(n - yes, n).alias("high"))


def corrected_fdp(fdp: DataFrame, grid: DataFrame) -> DataFrame:
    """FDP under label noise: of the benign-labelled alerts a share eps0 is malicious, of the malicious a share eps1 is benign: ``fdp, eps0, eps1, corrected``."""
    c = F.col("fdp") * (1 - F.col("eps0")) + (1 - F.col("fdp")) * F.col("eps1")
    return fdp.select("fdp").join(F.broadcast(grid)).select("fdp", "eps0", "eps1", F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)).alias("corrected"))  # a grid of parameters


def unit_scale(df: DataFrame, a: str, b: str, scales: list[float]) -> DataFrame:
    """The factor by which a must be multiplied to match b: least median |log10(a scale / b)|: ``scale, error``."""
    d = df.where((F.col(a) > 0) & (F.col(b) > 0)).select(F.log10(F.col(a) / F.col(b)).alias("r"))
    found = [(e, float(s)) for s in scales for e in percentiles(d, F.abs(F.col("r") + F.log10(F.lit(float(s)))), [0.5]) if e is not None]
    return df.sparkSession.createDataFrame([(s, e) for e, s in sorted(found)[:1]], "scale double, error double")


def flow_cost(flows: DataFrame, per_packet: int = 0) -> DataFrame:
    """Packets and bytes in all, bytes with ``per_packet`` header bytes each: ``n, packets, bytes``."""
    p = F.col("f3") + F.col("f4")
    return flows.agg(F.count("*").alias("n"), F.sum(p).cast("double").alias("packets"), (F.sum(F.col("f5") + F.col("f6")) + per_packet * F.sum(p)).cast("double").alias("bytes"))


def budget_costs(flows: DataFrame, budgets: list[int], cost: Column) -> DataFrame:
    """Cost of so many flows at quantiles of the unit cost: ``budget, p10, p50, p90``."""
    q = percentiles(flows, cost, [0.1, 0.5, 0.9])
    return flows.sparkSession.createDataFrame([(b, *[None if x is None else b * x for x in q]) for b in budgets], "budget int, p10 double, p50 double, p90 double")


def cheapest(flows: DataFrame, n: int, cost: Column, tie: str = "ingest_id") -> DataFrame:
    """Sum of the ``n`` smallest costs: ``n, total``."""
    return flows.select(cost.alias("c"), tie).orderBy("c", tie).limit(n).agg(F.count("*").alias("n"), F.sum("c").alias("total"))


def cumulative_cheapest(flows: DataFrame, budgets: list[int], cost: Column, by: str, tie: str = "ingest_id") -> DataFrame:
    """The cheapest flows per pool and budget: ``by, budget, n, total``. Only the largest budget's flows are ranked (a top-k per pool)."""
    w = W.partitionBy(by).orderBy("c", tie)
    r = flows.select(by, cost.alias("c"), tie).withColumn("r", F.row_number().over(w)).where(F.col("r") <= max(budgets))
    r = r.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets]))).where("r <= budget")
    return r.groupBy(by, "budget").agg(F.count("*").alias("n"), F.sum("c").alias("total"))


def rate_and_hosts(flows: DataFrame, need: int) -> DataFrame:
    """Time and hosts that ``need`` flows take at this pool's rate: ``n, hours, hosts, hours_needed`` (null for an instant pool)."""
    g = flows.agg(F.count("*").alias("n"), ((F.max("ts") - F.min("ts")) / 3.6e9).alias("hours"), F.count_distinct("src").alias("hosts"))
    return g.withColumn("hours_needed", F.try_divide(F.lit(float(need)) * F.col("hours"), F.col("n")))


def shifted(marks: DataFrame, shifts: list[int], lo: int, hi: int, ts: str = "ts") -> DataFrame:
    """Copies of marks moved in time around a circle [lo, hi): ``shift`` and the moved ``ts``; the null of a time match."""
    span = hi - lo
    return marks.withColumn("shift", F.explode(F.array(*[F.lit(s) for s in shifts]))).withColumn(ts, F.lit(lo) + F.pmod(F.col(ts) - F.lit(lo) + F.col("shift"), F.lit(span)))


def permuted_labels(episodes: DataFrame, reps: int, seed: int = 0) -> DataFrame:
    """Label permutations of a small episode table: ``rep, pos, ismal`` with as many malicious as before in every repetition."""
    e = episodes.select("pos", "ismal").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    a = e.select("rep", "pos", F.row_number().over(W.partitionBy("rep").orderBy("pos")).alias("i"))
    b = e.select("rep", "ismal", F.row_number().over(W.partitionBy("rep").orderBy(draw(seed, "rep", "pos"), "pos")).alias("i"))
    return a.join(b, ["rep", "i"]).select("rep", "pos", "ismal")


def silence_identity(per_epoch: DataFrame) -> DataFrame:
    """Epochs without a rejection where silent differs from max(0, t - window): empty if the identity holds."""
    return per_epoch.where((F.col("alerts") == 0) & (F.col("silent") != F.greatest(F.col("t") - F.col("window"), F.lit(0))))


def randomised_validity(rows: DataFrame, alpha: float) -> DataFrame:
    """P(smoothed p <= alpha) averaged over rows, exact in U: clip((alpha (nc+1) - above) / (1 + ties), 0, 1): ``n, probability``."""
    x = (F.lit(alpha) * (F.col("nc") + 1) - F.col("above")) / (1 + F.col("ties"))
    return rows.agg(F.count("*").alias("n"), F.avg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).alias("probability"))


def arity_coverage(episodes: DataFrame, threshold: Column, value: str = "smax") -> DataFrame:
    """Share of benign episodes over a threshold by size bin: ``bin, n, over``."""
    b = F.when(F.col("nsz") == 1, "1").when(F.col("nsz") <= 4, "2-4").when(F.col("nsz") <= 16, "5-16").otherwise("17+")
    return episodes.where("not ismal").groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.when(F.col(value) > threshold, 1.0).otherwise(0.0)).alias("over"))


def calendar_need(episodes: DataFrame, need: int) -> DataFrame:
    """Hours until so many groups have been seen: ``groups_per_hour, hours_needed``."""
    g = episodes.agg(F.try_divide(F.count("*").cast("double"), (F.max("first_ts") - F.min("first_ts")) / 3.6e9).alias("groups_per_hour"))
    return g.withColumn("hours_needed", F.try_divide(F.lit(float(need)), F.col("groups_per_hour")))


def usability(rows: DataFrame, by: list[str], daily_s: int = 86_400, least: int = 3) -> DataFrame:
    """Whether a list of submitted steps can judge the alerts of a window, and why not: one row per ``by``.

    ``rows``: one per alerting unit (``bucket_s``) with ``n_alerts, n_temporal`` (a step in their bucket at
    all), ``n_attributed`` (a step that matches), ``steps_per_alert, atoms_per_alert`` (null where
    undefined). Result: ``n_defined`` (units with both), ``n_alerts, n_temporal, share_temporal, n_fine``
    (units below a day with a match; at a day every step shares the bucket, which tells nothing),
    ``n_attributed, verdict`` - usable with at least three defined units; else temporal (no fine unit and
    under a tenth of the alerts meet a step in time), spatial (none matches) or thin - and, where usable,
    the rank correlations ``steps_atoms, steps_width, atoms_width`` over the units of the window.
    """
    both = F.col("steps_per_alert").isNotNull() & F.col("atoms_per_alert").isNotNull()
    w = W.partitionBy(*by)  # a handful of units per window

    def rank(c: str):
        mine = F.when(both, F.col(c))
        return F.when(both, F.rank().over(w.orderBy(mine.asc_nulls_last())) + (F.count("*").over(W.partitionBy(*by, mine)) - 1) / 2.0)

    ranked = rows.withColumns({"__s": rank("steps_per_alert"), "__a": rank("atoms_per_alert"), "__b": rank("bucket_s")})
    g = ranked.groupBy(*by).agg(
        F.count_if(both).alias("n_defined"), F.sum("n_alerts").alias("n_alerts"), F.sum("n_temporal").alias("n_temporal"), F.sum("n_attributed").alias("n_attributed"),
        F.count_if((F.col("bucket_s") < daily_s) & (F.col("n_attributed") > 0)).alias("n_fine"), correlation("__s", "__a").alias("__sa"), correlation("__s", "__b").alias("__sb"), correlation("__a", "__b").alias("__ab"),
    )
    share = F.coalesce(F.try_divide("n_temporal", "n_alerts"), F.lit(0.0))
    usable = F.col("n_defined") >= least
    why = F.when(usable, "usable").when((F.col("n_fine") == 0) & (share < 0.1), "temporal").when(F.col("n_attributed") == 0, "spatial").otherwise("thin")
    rho = lambda c: F.when(usable, F.col(c))
    return g.select(*by, "n_defined", "n_alerts", "n_temporal", share.alias("share_temporal"), "n_fine", "n_attributed", why.alias("verdict"), rho("__sa").alias("steps_atoms"), rho("__sb").alias("steps_width"), rho("__ab").alias("atoms_width"))


def agreement(df: DataFrame, n: int) -> DataFrame:
    """Whether observed counts agree with derived probabilities: one row of evidence from ``predicted`` and ``observed`` (of ``n`` draws).

    Where n p (1 - p) is 5 at least, each z is held against a normal quantile for all such rows together
    (0.25 % on a side), and all rows against a pooled z of 5. Rows of less power are held against exact
    binomial tails (0.5 % for all together, both sides), their pooled z, and the z of their Pearson sum.
    A probability of 0 or 1 must be met exactly. Columns: ``n_checked, max_z, z_crit, pooled_z,
    n_contradicted, n_low, n_low_bad, low_pooled_z, low_spread_z, ok``.
    """
    @F.pandas_udf("double")
    def tail(p: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([2 * min(binom_cdf(int(b), n, a), 1 - (binom_cdf(int(b) - 1, n, a) if b > 0 else 0.0)) for a, b in zip(p, k)], dtype=float)

    p, k = F.col("predicted"), F.col("observed")
    var = n * p * (1 - p)
    low = (var < 5) & (p > 0) & (p < 1)
    d = df.select(p, k).dropna().withColumns({"__v": var, "__d": k - n * p, "__low": low})
    # One tail per distinct pair: few, however many rows there are.
    t = d.where("__low").groupBy("predicted", "observed").agg(F.count("*").alias("__n")).withColumn("__t", tail("predicted", "observed"))
    one = lambda c: F.when(F.col("__low"), c)
    g = d.agg(
        F.count_if(F.col("__v") >= 5).alias("n_checked"), F.coalesce(F.max(F.when(F.col("__v") >= 5, F.abs("__d") / F.sqrt("__v"))), F.lit(0.0)).alias("max_z"),
        F.coalesce(F.try_divide(F.sum(F.when(p > 0, F.col("__d"))), F.sqrt(F.sum(F.when(p > 0, F.col("__v"))))), F.lit(0.0)).alias("pooled_z"),
        F.count_if(((p == 0) & (k > 0)) | ((p == 1) & (k < n))).alias("n_contradicted"), F.count_if("__low").alias("n_low"),
        F.coalesce(F.try_divide(F.sum(one(F.col("__d"))), F.sqrt(F.sum(one(F.col("__v"))))), F.lit(0.0)).alias("low_pooled_z"),
        F.coalesce(F.try_divide(F.sum(one(F.col("__d") ** 2 / F.col("__v") - 1)), F.sqrt(F.sum(one(2 + (1 - 6 * p * (1 - p)) / F.col("__v"))))), F.lit(0.0)).alias("low_spread_z"),
    ).first()
    bad = t.where(F.col("__t") < 0.005 / max(g.n_low, 1)).agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    crit = normal_isf(0.0025 / g.n_checked) if g.n_checked else 6.0
    ok = g.n_contradicted == 0 and bad == 0 and g.max_z <= crit and abs(g.pooled_z) <= 5 and abs(g.low_pooled_z) <= 5 and g.low_spread_z <= 5
    row = (g.n_checked, g.max_z, crit, g.pooled_z, g.n_contradicted, g.n_low, bad, g.low_pooled_z, g.low_spread_z, ok)
    return df.sparkSession.createDataFrame([row], "n_checked long, max_z double, z_crit double, pooled_z double, n_contradicted long, n_low long, n_low_bad long, low_pooled_z double, low_spread_z double, ok boolean")


def looked_up(grid: DataFrame, results: DataFrame, keys: list[str], value: str) -> DataFrame:
    """An earlier stage's value for each cell of a grid: adds ``value`` (null where the stage has no row). Several different values for one cell are an error."""
    one = results.groupBy(*keys).agg(F.max(value).alias(value), F.count_distinct(value).alias("__n"))
    clash = F.when(F.col("__n") > 1, F.raise_error(F.lit("a result is not unique for its key")).cast(dict(results.dtypes)[value])).otherwise(F.col(value))
    return grid.join(one.select(*keys, clash.alias(value)), keys, "left")


def leakage_audit(df: DataFrame, column: str, label: str = "label") -> DataFrame:
    """Attack rate given each value of a column a detector must not use: ``value, n, rate``."""
    return df.where(F.col(label).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"), F.avg((F.col(label) == 1).cast("double")).alias("rate"))


def lever(rows: DataFrame) -> DataFrame:
    """Against the run at q = 0.05 of the same gamma: ratio of (margin + 1), q / 0.05, and the median recall: ``q, gamma, margin_ratio, q_ratio, recall``."""
    g = rows.groupBy("q", "gamma").agg(F.percentile("margin", F.lit(0.5)).alias("margin"), F.percentile("recall", F.lit(0.5)).alias("recall"))
    base = g.where(F.abs(F.col("q") - 0.05) < 1e-12).select("gamma", (F.col("margin") + 1).alias("__b"))
    return g.join(base, "gamma").select("q", "gamma", ((F.col("margin") + 1) / F.col("__b")).alias("margin_ratio"), (F.col("q") / 0.05).alias("q_ratio"), "recall")


def contamination_spread(runs: DataFrame, by: list[str]) -> DataFrame:
    """Recall over replicates: quantiles, share of zero recall and its Wilson interval."""
    zero = F.count_if(F.col("recall") == 0)
    g = runs.groupBy(*by).agg(F.count("recall").alias("n"), *[F.percentile("recall", F.lit(q)).alias(m) for m, q in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))], zero.alias("zeros"))
    lo, hi = wilson_columns(F.col("zeros"), F.col("n"))
    return g.withColumns({"p_zero": F.try_divide("zeros", "n"), "low": lo, "high": hi})


def by_group_rates(run: DataFrame, by: str) -> DataFrame:
    """Detected and suppressible alerts per group: ``by, detected, suppressible``."""
    return run.groupBy(by).agg(F.count_if(F.col("fired") & F.col("ismal")).alias("detected"), F.count_if(F.col("fired") & F.col("ismal") & (F.col("pads") > 0)).alias("suppressible"))


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Positions in a total order (see :func:`wardstream.operators.ingest.positions`)."""
    return positions(df, order)
