"""Joins in time and by likeness, as equi-joins on slices or buckets with residual conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardstream.functions.columns import finite
from wardstream.schema import SECOND


def nearest_in_time(rows: DataFrame, marks: DataFrame, ts: str = "ts", slice_s: int = 3600) -> DataFrame:
    """Adds ``nearest_us``: distance to the nearest mark before or after (0 at the same time; null without marks or ts).

    Marks are reduced to first and last per time slice; per slice the last mark before and the first after
    it are found over slices only. Within a slice rows and marks meet in a window over that slice.
    """
    z = lambda c: c - F.pmod(c, F.lit(slice_s * SECOND))
    m = marks.select(F.col(ts).alias("__t")).where("__t is not null").distinct().withColumn("__z", z(F.col("__t")))
    r = rows.select(F.col(ts).alias("__t")).where("__t is not null").distinct().withColumn("__z", z(F.col("__t")))
    ends = m.groupBy("__z").agg(F.min("__t").alias("__a"), F.max("__t").alias("__b"))
    w = W.orderBy("__z")
    every = r.select("__z").unionByName(ends.select("__z")).distinct().join(ends, "__z", "left")
    # One row per slice: bounded by the time span, not by the rows.
    around = every.select("__z", F.last("__b", True).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("__p"), F.first("__a", True).over(w.rowsBetween(1, W.unboundedFollowing)).alias("__n"))
    both = r.withColumn("__m", F.lit(None).cast("long")).unionByName(m.withColumn("__m", F.col("__t"))).join(around, "__z")
    wz = W.partitionBy("__z").orderBy("__t")
    prev = F.coalesce(F.last("__m", True).over(wz.rangeBetween(W.unboundedPreceding, 0)), F.col("__p"))
    nxt = F.coalesce(F.first("__m", True).over(wz.rangeBetween(0, W.unboundedFollowing)), F.col("__n"))
    near = both.withColumn("nearest_us", F.least(F.col("__t") - prev, nxt - F.col("__t"))).where("__m is null").select("__t", "nearest_us")
    return rows.join(near, F.col(ts) == F.col("__t"), "left").drop("__t")


def steps_near(episodes: DataFrame, keys: list[str], steps: DataFrame, window_s: int = 900) -> DataFrame:
    """Number of steps (column ``ts``) within ``window_s`` of an episode's span, ends included: ``keys, n_steps``.

    Steps and span ends are cut into windows of equal width. Windows inside the span count as a whole from
    running totals; at the ends the steps themselves are compared, so no pair of episode and step inside the span is formed.
    """
    width = window_s * SECOND
    z = lambda c: F.floor(c / F.lit(width))
    s = steps.select(F.col("ts").alias("__t")).where("__t is not null")
    per = s.groupBy(z(F.col("__t")).alias("__z")).agg(F.count("*").alias("__c"))
    upto = per.withColumn("__u", F.sum("__c").over(W.orderBy("__z").rowsBetween(W.unboundedPreceding, 0)))  # one row per slice of time
    e = episodes.select(*keys, (F.col("first_ts") - width).alias("__lo"), (F.col("last_ts") + width).alias("__hi"))
    # Whole windows strictly between both ends.
    last = W.orderBy("__z", "__q").rowsBetween(W.unboundedPreceding, 0)
    asked = e.select(F.explode(F.array(z(F.col("__lo")), z(F.col("__hi")) - 1)).alias("__z")).distinct()
    filled = asked.withColumn("__u", F.lit(None).cast("long")).withColumn("__q", F.lit(1)).unionByName(upto.select("__z", "__u").withColumn("__q", F.lit(0)))
    totals = filled.withColumn("__u", F.coalesce(F.last("__u", True).over(last), F.lit(0))).where("__q = 1").select("__z", "__u")
    whole = e.join(totals.select(F.col("__z").alias("__za"), F.col("__u").alias("__ua")), z(F.col("__lo")) == F.col("__za")).join(totals.select(F.col("__z").alias("__zb"), F.col("__u").alias("__ub")), z(F.col("__hi")) - 1 == F.col("__zb"))
    whole = whole.select(*keys, F.greatest(F.col("__ub") - F.col("__ua"), F.lit(0)).alias("n"))
    edge = e.withColumn("__z", F.explode(F.array_distinct(F.array(z(F.col("__lo")), z(F.col("__hi")))))).join(s.withColumn("__z", z(F.col("__t"))), "__z").where("__t between __lo and __hi").groupBy(*keys).agg(F.count("*").alias("n"))
    return whole.unionByName(edge).groupBy(*keys).agg(F.sum("n").alias("n_steps"))


def steps_to_alerts(alerts: DataFrame, keys: list[str], steps: DataFrame, width_s: int, rule: str = "both") -> DataFrame:
    """Alerts (``keys, bucket, segments, ips``) that match a step in their bucket: ``keys, bucket, n_steps``.

    ``none`` time only, ``seg`` a shared segment, ``ip`` a shared address, ``both`` either of them. Null arrays share nothing.
    """
    s = steps.where("ts is not null").select(F.floor(F.col("ts") / F.lit(width_s * SECOND)).alias("bucket"), F.col("segments").alias("__g"), F.col("ips").alias("__i"))
    no = lambda c: F.coalesce(c, F.lit(False))
    seg, ip = no(F.arrays_overlap("segments", "__g")), no(F.arrays_overlap("ips", "__i"))
    cond = {"none": F.lit(True), "seg": seg, "ip": ip, "both": seg | ip}[rule]
    return alerts.join(s, "bucket").where(cond).groupBy(*keys, "bucket").agg(F.count("*").alias("n_steps"))


def atoms(flows: DataFrame, alerts: DataFrame, keys: list[str], bucket_s: int | None, atom_keys: list[str], atom_s: int = 300) -> DataFrame:
    """Distinct pairs of an alert and a fixed small atom (keys and 5 minutes) that share a flow: per alert ``n_atoms``, ``n_bad`` (atoms with malicious flows)."""
    from wardstream.operators.episodes import bucket

    f = flows.withColumn("bucket", bucket(F.col("ts"), bucket_s)).withColumn("atom", bucket(F.col("ts"), atom_s))
    extra = [k for k in atom_keys if k not in keys]
    p = f.groupBy(*keys, "bucket", *extra, "atom").agg(F.max((F.col("label") == 1).cast("int")).alias("bad")).join(alerts.select(*keys, "bucket").distinct(), [*keys, "bucket"], "left_semi")
    return p.groupBy(*keys, "bucket").agg(F.count("*").alias("n_atoms"), F.coalesce(F.sum("bad"), F.lit(0)).alias("n_bad"))


def fixed_coverage(flows: DataFrame, alerts: DataFrame, keys: list[str], bucket_s: int | None, atom_keys: list[str], atom_s: int = 300) -> DataFrame:
    """Coverage of malicious atoms by alerts with a denominator that no grouping changes: ``n_bad, n_covered, coverage, blur``.

    An atom (``atom_keys`` and five minutes) is malicious if one of its flows is, and covered if one of its
    malicious flows lies in an alert. ``blur`` is the mean number of malicious atoms that an alert with any
    runs together; null without such an alert.
    """
    from wardstream.operators.episodes import bucket

    f = flows.where("label = 1").withColumn("bucket", bucket(F.col("ts"), bucket_s)).withColumn("atom", bucket(F.col("ts"), atom_s))
    unit = [k for k in atom_keys if k not in keys]
    pairs = f.groupBy(*keys, "bucket", *unit, "atom").agg(F.lit(1).alias("__one"))
    hit = pairs.join(alerts.select(*keys, "bucket").distinct().withColumn("__hit", F.lit(1)), [*keys, "bucket"], "left")
    n = hit.groupBy(*atom_keys, "atom").agg(F.max("__hit").alias("__hit")).agg(F.count("*").alias("n_bad"), F.count("__hit").alias("n_covered"))
    blur = hit.where("__hit = 1").groupBy(*keys, "bucket").agg(F.count("*").alias("__n")).agg(F.avg("__n").alias("blur"))
    return n.join(F.broadcast(blur)).select("n_bad", "n_covered", F.try_divide("n_covered", "n_bad").alias("coverage"), "blur")  # one row


def elsewhere(episodes: DataFrame, keys: list[str], host: str) -> DataFrame:
    """Adds ``mal_elsewhere``: malicious flows of the host in its other episodes."""
    t = episodes.groupBy(host).agg(F.sum("mal").alias("__m"))
    return episodes.join(t, host, "left").withColumn("mal_elsewhere", F.coalesce(F.col("__m") - F.col("mal"), F.lit(0))).drop("__m")


def _vector(columns: list[str]) -> list:
    return [finite(c).alias(f"__x{i}") for i, c in enumerate(columns)]


def identical_in(rows: DataFrame, others: DataFrame, columns: list[str], identity: str = "ingest_id") -> DataFrame:
    """Rows whose feature vector occurs identically in ``others`` (null, NaN, ±Inf as 0; signed zeros equal): ``identity``."""
    k = [f"__x{i}" for i in range(len(columns))]
    return rows.select(identity, *_vector(columns)).join(others.select(*_vector(columns)).distinct(), k, "left_semi").select(identity)


def inconsistent_labels(flows: DataFrame, columns: list[str]) -> DataFrame:
    """Vectors that carry both labels: ``n_vectors, n_mixed, n_flows, n_in_mixed, n_minority``."""
    g = flows.where("label is not null").select("label", *_vector(columns)).groupBy(*[f"__x{i}" for i in range(len(columns))]).agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("m"))
    mixed = (F.col("m") > 0) & (F.col("m") < F.col("n"))
    s = lambda c: F.coalesce(F.sum(F.when(mixed, c)), F.lit(0))
    return g.agg(F.count("*").alias("n_vectors"), F.count_if(mixed).alias("n_mixed"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_flows"), s(F.col("n")).alias("n_in_mixed"), s(F.least(F.col("m"), F.col("n") - F.col("m"))).alias("n_minority"))


def nearest_neighbour(queries: DataFrame, base: DataFrame, identity: str, vector: str, block: int = 2048, chunk: int = 16_384) -> DataFrame:
    """Exact Euclidean nearest neighbour of each query among ``base``, itself excluded: ``identity, neighbour, distance``.

    The stated query set is dealt into blocks of about ``block`` vectors, the base into chunks of about
    ``chunk``; every block meets every chunk in one task, which keeps the best per query, and a minimum over
    chunks ends it. So no pair is ever a row, nothing is broadcast or collected, and tasks are of one size.
    Distances come from norms and products, the best few of a chunk again from differences, as products
    round. Ties go to the smaller id; null vectors take no part; a query alone has no row.
    """
    import numpy as np
    import pandas as pd

    q = queries.select(F.col(identity).alias("__id"), F.col(vector).cast("array<double>").alias("__v")).where("__v is not null")
    b = base.select(F.col(identity).alias("__id"), F.col(vector).cast("array<double>").alias("__v")).where("__v is not null")
    nq, nb = max(1, -(-q.count() // block)), max(1, -(-b.count() // chunk))
    own = lambda n: F.pmod(F.xxhash64("__id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    left = q.select("__id", "__v", own(nq).alias("i"), every(nb).alias("j"))
    right = b.select("__id", "__v", every(nq).alias("i"), own(nb).alias("j"))

    def best(qs: pd.DataFrame, bs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(bs):
            return pd.DataFrame({"id": [], "neighbour": [], "distance": []})
        bs = bs.sort_values("__id")
        qi, bi, x, y = qs["__id"].to_numpy(), bs["__id"].to_numpy(), np.stack(qs["__v"].to_numpy()), np.stack(bs["__v"].to_numpy())
        rows, size = [], (y**2).sum(axis=1)
        for at in range(0, len(qi), 256):
            p = x[at : at + 256]
            d = size[None, :] - 2 * p @ y.T + (p**2).sum(axis=1)[:, None]
            d[qi[at : at + 256, None] == bi[None, :]] = np.inf
            near = d.min(axis=1)
            for k in range(len(p)):
                few = np.flatnonzero(d[k] <= near[k] + 1e-9 * (size.max() + (p[k] ** 2).sum())) if np.isfinite(near[k]) else []
                if len(few):
                    exact = ((y[few] - p[k]) ** 2).sum(axis=1)
                    w = int(exact.argmin())  # the first is of the smallest id
                    rows.append((qi[at + k], bi[few[w]], float(np.sqrt(exact[w]))))
        return pd.DataFrame(rows, columns=["id", "neighbour", "distance"])

    kind = dict(base.dtypes)[identity]
    got = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(best, f"id {kind}, neighbour {kind}, distance double")
    return got.groupBy("id").agg(F.min(F.struct("distance", "neighbour")).alias("b")).select(F.col("id").alias(identity), "b.neighbour", "b.distance")


def map_agreement(left: DataFrame, right: DataFrame, key: str, values: str) -> DataFrame:
    """How well two sources (key, array of values) agree on shared keys: ``shared, overlapping, share``."""
    a = left.select(F.col(key).alias("k"), F.explode(values).alias("v")).distinct()
    b = right.select(F.col(key).alias("k"), F.explode(values).alias("v")).distinct()
    hits = a.join(b, ["k", "v"]).select("k").distinct().withColumn("hit", F.lit(True))
    j = a.select("k").distinct().join(b.select("k").distinct(), "k").join(hits, "k", "left").agg(F.count("*").alias("shared"), F.count("hit").alias("overlapping"))
    return j.withColumn("share", F.try_divide("overlapping", "shared"))


def pool_before(pool: DataFrame, victims: DataFrame, host: str = "dst") -> DataFrame:
    """Pool flows towards a victim strictly before its attack time (``host, t_atk``), summed per victim: ``host, n, mean_e``."""
    p = pool.join(victims, host).where(F.col("ts") < F.col("t_atk"))
    return p.groupBy(host).agg(F.count("*").alias("n"), F.avg("e").alias("mean_e"))
