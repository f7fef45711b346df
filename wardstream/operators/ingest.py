"""Reading and cleaning the flow log, positions and chronological splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardstream.functions.columns import finite
from wardstream.functions.hashing import draw, uniform
from wardstream.operators.order_stats import percentiles, running
from wardstream.runtime import materialise
from wardstream.schema import FEATURES, META_NUMBERS, META_STRINGS


def clean_features(df: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """Null, NaN and ±Inf features are 0."""
    return df.withColumns({c: finite(c, "float") for c in columns})


def clean_meta(df: DataFrame) -> DataFrame:
    """Missing metadata: numbers −1, texts empty."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(-1)).cast("int") for c in META_NUMBERS if c in df.columns} | {c: F.coalesce(F.col(c), F.lit("")) for c in META_STRINGS if c in df.columns})


def clean_ports(df: DataFrame) -> DataFrame:
    """Ports given as numbers with gaps: null and NaN are 0, whole numbers otherwise."""
    return df.withColumns({c: finite(F.col(c).cast("double")).cast("int") for c in ("sport", "dport")})


def join_side(flows: DataFrame, side: DataFrame, key: str = "ingest_id") -> DataFrame:
    """Side columns by row identity. Columns of ``side`` that ``flows`` has too are left out; flows without a row keep nulls."""
    return flows.join(side.select(key, *[c for c in side.columns if c not in flows.columns]), key, "left")


def same_length(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables that must align row by row have as many rows."""
    return a.count() == b.count()


def positions(df: DataFrame, order: list[str], name: str = "pos", partitions: int | None = None) -> DataFrame:
    """1-based position in a total order, without a single-task sort.

    Rows are range-partitioned by the order and kept (checkpointed) so; counts of the partitions before
    are added to the row number inside each. Rows equal in ``order`` must not matter to the caller.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = materialise(df.repartitionByRange(n, *order).withColumn("__posp", F.spark_partition_id()))
    w = W.orderBy("__posp").rowsBetween(W.unboundedPreceding, -1)
    before = kept.groupBy("__posp").agg(F.count("*").alias("__posc")).select("__posp", F.coalesce(F.sum("__posc").over(w), F.lit(0)).alias("__posb"))  # one row per partition
    inside = kept.withColumn("__posr", F.row_number().over(W.partitionBy("__posp").orderBy(*order)))
    return inside.join(F.broadcast(before), "__posp").withColumn(name, F.col("__posb") + F.col("__posr")).drop("__posp", "__posb", "__posr")


def split_bounds(n: int, pos: float = 0.55, cal: float = 0.15, test: float = 0.15, until_end: bool = False, half: bool = False) -> tuple[int, int, int]:
    """0-based bounds: calibration is [i1, i2), deployment [i2, i3).

    ``until_end``: deployment runs to the last row. ``half``: calibration starts at half of the prefix.
    """
    i2 = int(pos * n)
    i1 = i2 // 2 if half else i2 - int(cal * n)
    return i1, i2, n if until_end else min(n, i2 + int(test * n))


def split_of(pos: Column, bounds: tuple[int, int, int]) -> Column:
    """``train``, ``cal``, ``deploy`` or null of a 1-based position."""
    i1, i2, i3 = bounds
    return F.when(pos <= i1, "train").when(pos <= i2, "cal").when(pos <= i3, "deploy")


def positional_split(df: DataFrame, bounds: tuple[int, int, int], ts: str = "ts", identity: str = "ingest_id", name: str = "split") -> DataFrame:
    """Adds ``train``, ``cal``, ``deploy`` or null by place in the order (ts, identity), without numbering the rows.

    The times at the bounds come from counts per time (:func:`wardstream.operators.order_stats.running`), the place
    among equal times from the identities at that time alone; the split is then a comparison per row. Null
    times belong to no split and don't count; ``identity`` must be unique.
    """
    at = running(df.where(F.col(ts).isNotNull()).groupBy(F.col(ts).alias("t")).agg(F.count("*").alias("c")), "t", "c", "b")
    places = F.array(*[F.lit(b).cast("long") for b in sorted(set(bounds))])
    found = at.select("t", "b", F.explode(F.filter(places, lambda p: (p > F.col("b")) & (p <= F.col("b") + F.col("c")))).alias("p")).collect()  # one row per bound at most
    cut = {}
    for r in found:
        tied = df.where(F.col(ts) == r.t).select(identity).orderBy(identity).limit(r.p - r.b)
        cut[r.p] = (r.t, tied.agg(F.max(identity)).first()[0])

    def upto(b: int) -> Column:
        if b not in cut:
            return F.lit(b > 0)  # nothing before the first row, everything up to a bound past the last
        t, i = cut[b]
        return (F.col(ts) < t) | ((F.col(ts) == t) & (F.col(identity) <= i))

    i1, i2, i3 = bounds
    return df.withColumn(name, F.when(F.col(ts).isNull(), None).when(upto(i1), "train").when(upto(i2), "cal").when(upto(i3), "deploy"))


def train_sample(df: DataFrame, label: str, identity: str, rate: float = 0.5, seed: int = 0) -> DataFrame:
    """All malicious rows and a hash-chosen share of the benign ones."""
    return df.where((F.col(label) == 1) | (uniform(F.col(identity), seed) < rate))


def sample_without_replacement(df: DataFrame, identity: str, n: int, seed: int = 0) -> DataFrame:
    """The ``n`` rows of smallest hash (a top-k, so nothing is sorted whole)."""
    return df.orderBy(draw(seed, identity), identity).limit(n)


def sample_with_replacement(pool: DataFrame, order: list[str], n: int, seed: int = 0) -> DataFrame:
    """``n`` draws from the pool: each draw's hash picks a position. Columns ``draw`` and those of the pool; an empty pool gives none."""
    p = positions(pool, order, "__pos")
    size = p.agg(F.count("*").alias("__n"))
    draws = df_range(pool.sparkSession, n).join(F.broadcast(size)).where("__n > 0").select(F.col("id").alias("draw"), (F.floor(uniform(F.col("id"), seed) * F.col("__n")) + 1).alias("__pos"))
    return draws.join(p, "__pos").drop("__pos")


def df_range(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n)


def novelty(test: DataFrame, seen: DataFrame, column: str) -> DataFrame:
    """Share of test rows whose value the calibration rows never had (nulls count as a value): ``n, unseen, share``."""
    t = test.select(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("v")).groupBy("v").agg(F.count("*").alias("c"))
    s = seen.select(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("v")).distinct().withColumn("old", F.lit(True))
    return t.join(s, "v", "left").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("old").isNull(), F.col("c"))), F.lit(0)).alias("unseen")).withColumn("share", F.try_divide("unseen", "n"))


def thinning_keep(total: int, malicious: int, prevalence: float) -> int:
    """Malicious episodes to keep for a prevalence: max(1, round(pi (T - M) / (1 - pi))), at most M; halves round to even."""
    return min(malicious, max(1, round(prevalence * (total - malicious) / (1 - prevalence))))


def thin(episodes: DataFrame, keys: list[str], prevalence: float, seed: int = 0) -> DataFrame:
    """Drop malicious episodes down to a prevalence; a smaller one keeps a subset of a larger one's (ranked by hash)."""
    t = episodes.agg(F.count("*").alias("t"), F.count_if("ismal").alias("m")).first()
    keep = thinning_keep(t.t, t.m, prevalence) if t.m else 0
    ranked = positions(episodes.where("ismal").select(*keys, draw(seed, *keys).alias("__h")), ["__h", *keys], "__r")
    gone = ranked.where(F.col("__r") > keep).select(*keys)
    return episodes.join(gone, keys, "left_anti")


def thin_resampled(episodes: DataFrame, keys: list[str], prevalence: float, seed: int = 0) -> DataFrame:
    """The same number of episodes, but the malicious ones beyond the prevalence get a benign episode's evidence and label."""
    kept = thin(episodes, keys, prevalence, seed).select(*keys).withColumn("__k", F.lit(True))
    e = episodes.join(kept, keys, "left")
    gone = e.where("__k is null").drop("__k", "ev", "ismal")
    n = gone.count()
    if not n:
        return e.drop("__k")
    drawn = sample_with_replacement(episodes.where("not ismal").select(*keys, "ev").withColumnsRenamed({k: f"__d{k}" for k in keys}), [f"__d{k}" for k in keys], n, seed).select(F.col("draw"), F.col("ev"))
    numbered = positions(gone, keys, "draw").withColumn("draw", F.col("draw") - 1)
    return e.where("__k").drop("__k").unionByName(numbered.join(drawn, "draw").drop("draw").withColumn("ismal", F.lit(False)))


def contaminate(cal: DataFrame, pool: DataFrame, a: int, model: str = "add", score: str = "score", identity: str = "ingest_id", seed: int = 0) -> DataFrame:
    """Calibration scores with ``a`` from the pool: ``add`` keeps all clean ones, ``replace`` drops the ``a`` smallest."""
    extra = sample_without_replacement(pool.select(identity, score), identity, a, seed)
    clean = cal.select(identity, score)
    if model == "replace":
        worst = clean.orderBy(score, identity).limit(a).select(identity)
        clean = clean.join(worst, identity, "left_anti")
    return clean.unionByName(extra)


def modal(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Most frequent non-null value, overall or per group; ties go to the smallest."""
    keys = list(by or [])
    c = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("__n"))
    g = c.groupBy(*keys) if keys else c.groupBy()
    return g.agg(F.min_by(column, F.struct(-F.col("__n"), F.col(column))).alias("mode"), F.max("__n").alias("n"))


def label_identity(df: DataFrame) -> DataFrame:
    """Whether label = (label_src or label_dst) on every row that has all three: ``n, holds``."""
    known = df.where("label is not null and label_src >= 0 and label_dst >= 0")
    return known.agg(F.count("*").alias("n"), F.bool_and(F.col("label") == F.greatest("label_src", "label_dst")).alias("holds"))


def epoch_scale(df: DataFrame, columns: list[str], most: float = 1e11) -> DataFrame:
    """Columns whose median magnitude reveals a clock: ``name, median_abs, dropped``."""
    rows = [(c, m, m is not None and m >= most) for c in columns for m in percentiles(df, F.abs(F.col(c)), [0.5])]
    return df.sparkSession.createDataFrame(rows, "name string, median_abs double, dropped boolean")


def usable_columns(df: DataFrame, columns: list[str], filled: float = 0.9) -> list[str]:
    """Columns more than ``filled`` non-null with more than one value."""
    r = df.agg(F.count("*").alias("__n"), *[F.count(c).alias(f"a{i}") for i, c in enumerate(columns)], *[(F.min(c) < F.max(c)).alias(f"b{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if r["__n"] and r[f"a{i}"] / r["__n"] > filled and r[f"b{i}"]]


def shared_columns(tables: list[DataFrame], columns: list[str]) -> list[str]:
    """Columns usable in every table of a fold."""
    good = [set(usable_columns(t, columns)) for t in tables]
    return [c for c in columns if all(c in g for g in good)]


def bijection(df: DataFrame, a: str, b: str) -> DataFrame:
    """Whether two columns map one to one where both are known: ``pairs, a_with_many, b_with_many, aligned``."""
    p = df.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna().distinct()
    many = lambda x, y: p.groupBy(x).agg(F.count(y).alias("c")).agg(F.count_if(F.col("c") > 1).alias(f"{x}_with_many"))
    n = p.agg(F.count("*").alias("pairs"))
    out = n.join(F.broadcast(many("a", "b"))).join(F.broadcast(many("b", "a")))  # one row each
    return out.withColumn("aligned", (F.col("a_with_many") == 0) & (F.col("b_with_many") == 0))


def first_seen(df: DataFrame, code: str, value: str, order: str) -> DataFrame:
    """Value of the earliest row of each code."""
    return df.where(F.col(value).isNotNull()).groupBy(code).agg(F.min_by(value, order).alias(value))


