"""What a key's rows before a moment add up to, without a window over a hot key's rows.

Rows are folded per (key, ts) first, map-side combined. Those sums are cut into time slices: a short window
inside each slice, and one over the slices of a key, whose number is bounded by the time span, give the sum
over all strictly earlier times; it goes back to the rows by an equi-join on (key, ts). Rows with equal
times never see each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardstream.schema import SECOND

SLICE_S = 3600


def before(df: DataFrame, keys: list[str], ts: str, sums: dict[str, Column], slice_s: int = SLICE_S, of: DataFrame | None = None) -> DataFrame:
    """Adds, for every name in ``sums``, the sum of its column over rows of the same key with a strictly earlier ``ts`` (0 if none).
    The rows summed are those of ``of``, which has the keys, ``ts`` and the columns of ``sums``; ``df`` itself by default.

    Null keys form a key of their own; rows with a null ts get 0 and count for nobody.
    """
    k = [f"__h{i}" for i in range(len(keys))]
    key = [F.col(c).alias(n) for c, n in zip(keys, k)]
    at = (df if of is None else of).where(F.col(ts).isNotNull()).select(*key, F.col(ts).alias("__t"), *[c.alias(n) for n, c in sums.items()])
    at = at.groupBy(*k, "__t").agg(*[F.sum(n).alias(f"__s{i}") for i, n in enumerate(sums)])
    at = at.withColumn("__z", F.col("__t") - F.pmod("__t", F.lit(slice_s * SECOND)))
    within = W.partitionBy(*k, "__z").orderBy("__t").rowsBetween(W.unboundedPreceding, -1)
    across = W.partitionBy(*k).orderBy("__z").rowsBetween(W.unboundedPreceding, -1)
    n = range(len(sums))
    slices = at.groupBy(*k, "__z").agg(*[F.sum(f"__s{i}").alias(f"__s{i}") for i in n])
    slices = slices.select(*k, "__z", *[F.coalesce(F.sum(f"__s{i}").over(across), F.lit(0)).alias(f"__a{i}") for i in n])
    inner = at.select(*k, "__z", "__t", *[F.coalesce(F.sum(f"__s{i}").over(within), F.lit(0)).alias(f"__b{i}") for i in n])
    on = lambda a, b, cols: [a[c].eqNullSafe(b[c]) for c in cols]
    total = inner.join(slices, on(inner, slices, [*k, "__z"])).select(*[inner[c] for c in k], inner["__t"], *[(F.col(f"__a{i}") + F.col(f"__b{i}")).alias(f"__v{i}") for i in n])
    cond = [df[c].eqNullSafe(total[x]) for c, x in zip(keys, k)] + [df[ts] == total["__t"]]
    return df.join(total, cond, "left").select(*[df[c] for c in df.columns], *[F.coalesce(F.col(f"__v{i}"), F.lit(0)).alias(name) for i, name in enumerate(sums)])


def arrival(df: DataFrame, keys: list[str], ts: str, tie: str, name: str = "arrival", flag: Column | None = None) -> DataFrame:
    """Adds the 1-based rank by (ts, tie) within a key, of all rows or among the flagged ones (null for others)."""
    one = F.lit(1) if flag is None else flag.cast("long")
    b = before(df, keys, ts, {"__before": one})
    w = W.partitionBy(*keys, ts).orderBy(tie).rowsBetween(W.unboundedPreceding, 0)
    rank = F.col("__before") + F.sum(one).over(w)
    return b.withColumn(name, (rank if flag is None else F.when(flag, rank)).cast("long")).drop("__before")
