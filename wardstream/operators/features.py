"""One row of counts, totals and latest times per entity and event type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstream.functions.columns import event_type, finite, row_key
from wardstream.operators.sessions import by_side
from wardstream.runtime import bounded_rows

MAX_TYPES = 20_000
PERIOD_US = 86_400 * 1_000_000


def vocabulary(meta: DataFrame, most: int = MAX_TYPES) -> list[str]:
    """The event types of a side table in order; a type's index is its place.

    The list is the table's header, so it must fit the driver: more than ``most`` types are an error.
    """
    t = meta.select(event_type("conn", "service").alias("t")).distinct()
    return sorted(r.t for r in bounded_rows(t, most, "the set of event types"))


def failed_types(meta: DataFrame, config: DataFrame, most: int = MAX_TYPES) -> list[str]:
    """The event types whose conn state, trimmed and in upper case, is one of a failed connection."""
    t = meta.select(event_type("conn", "service").alias("t")).distinct().withColumn("c", F.substring_index("t", "/", 1))
    fail = config.select(F.explode("config.fail_conn").alias("c")).select(F.upper(F.trim("c")).alias("c")).where("c <> ''")
    return sorted(r.t for r in bounded_rows(t.join(fail, "c", "left_semi").select("t"), most, "the set of event types"))


def failed_state(conn, config: DataFrame):
    """Whether a conn state, trimmed and in upper case, is one of a failed connection, as a column; ``config`` is one row whose array is read by the driver."""
    row = config.select("config.fail_conn").first()
    states = sorted({c.strip(" ").upper() for c in (row[0] if row and row[0] else []) if c} - {""})
    return F.upper(F.trim(conn)).isin(states)


def typed_flows(flows: DataFrame, meta: DataFrame, types: list[str]) -> DataFrame:
    """Flows with a row in ``meta``, each delivered flow once per event type: ``src, dst, ts, bytes, type_ix``.

    Flows equal in all columns but ``ingest_id`` are one flow. Should their rows in ``meta`` name several
    types, the flow counts once for each.
    """
    spark = flows.sparkSession
    index = F.broadcast(spark.createDataFrame([(t, i) for i, t in enumerate(types)], "t string, type_ix int"))  # at most MAX_TYPES rows
    m = meta.select(F.col("ingest_id").alias("__id"), event_type("conn", "service").alias("t")).join(index, "t").select("__id", "type_ix")
    same = [c for c in flows.columns if c != "ingest_id"]
    total = finite("f5") + finite("f6")
    f = flows.select(F.col("ingest_id").alias("__id"), row_key(same).alias("__h1"), row_key(same, 1).alias("__h2"), "src", "dst", F.when(F.col("ts") != 0, F.col("ts")).alias("ts"), total.alias("bytes"))
    once = f.join(m, "__id").groupBy("__h1", "__h2", "type_ix").agg(*(F.first(c).alias(c) for c in ("src", "dst", "ts", "bytes")))
    return once.select("src", "dst", "ts", "bytes", "type_ix")


def sparse_features(events: DataFrame, keys: list[str], ix: str = "type_ix", total: str = "bytes", ts: str = "ts") -> DataFrame:
    """Sparse vectors per entity: ``keys`` and ``features``, an array of (ix, n, total, latest) in order of ix.

    A hot entity is combined map-side first and reaches the second step with at most one row per type.
    Null totals and times add nothing; a type whose times are all null has a null ``latest``. Events with
    a null key or index take no part. Vectors of disjoint sets of events are merged by :func:`merge_features`.
    """
    per = events.dropna(subset=[*keys, ix]).groupBy(*keys, ix).agg(F.count("*").alias("n"), F.coalesce(F.sum(total), F.lit(0.0)).alias("total"), F.max(ts).alias("latest"))
    return _pack(per, keys, ix)


def _pack(per: DataFrame, keys: list[str], ix: str) -> DataFrame:
    entry = F.struct(F.col(ix).alias("ix"), "n", "total", "latest")
    return per.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("features"))


def merge_features(parts: DataFrame, keys: list[str]) -> DataFrame:
    """One vector per entity from any number of vectors of disjoint sets of events: counts and totals add, times take the later.

    ``parts`` holds ``keys`` and ``features``, one row per entity and part (a period, a batch, an earlier
    state). Entries are combined map-side, so an entity with very many parts is no single task's work.
    """
    rows = parts.select(*keys, F.inline("features"))
    return _pack(rows.groupBy(*keys, "ix").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("latest").alias("latest")), keys, "ix")


def period_features(events: DataFrame, keys: list[str], period: int = PERIOD_US, ix: str = "type_ix", total: str = "bytes", ts: str = "ts") -> DataFrame:
    """The state that is maintained: a sparse vector per entity and period of ``ts`` (events without a time have one of their own).

    A new period adds rows and leaves the others as they are; late events add another part for their
    period. Any set of parts is folded by :func:`merge_features`.
    """
    part = F.coalesce(F.floor(F.col(ts) / F.lit(period)), F.lit(-1))
    return sparse_features(events.withColumn("__part", part), [*keys, "__part"], ix, total, ts)


def expand_features(sparse: DataFrame, keys: list[str], types: list[str]) -> DataFrame:
    """Columns ``TYPE_n``, ``TYPE_total``, ``TYPE_latest`` from sparse vectors, missing entries 0, 0.0 and null.

    The vector is first made dense by filling the gaps between its ordered entries, in one walk over it, so
    that each column is read by its place.
    """
    gap = "array_repeat(cast(null as struct<ix:int,n:bigint,total:double,latest:bigint>), x.ix - coalesce(get(features, k - 1).ix, -1) - 1)"
    dense = F.expr(f"flatten(transform(features, (x, k) -> concat({gap}, array(x))))")
    s = sparse.select(*keys, dense.alias("__d"))
    cols = []
    for i, t in enumerate(types):
        e = F.get("__d", F.lit(i))
        cols += [F.coalesce(e["n"], F.lit(0)).alias(f"{t}_n"), F.coalesce(e["total"], F.lit(0.0)).alias(f"{t}_total"), e["latest"].alias(f"{t}_latest")]
    return s.select(*keys, *cols)


def host_features(flows: DataFrame, meta: DataFrame, config: DataFrame) -> tuple[DataFrame, list[str]]:
    """Per host and side the sparse vectors, ``n_flows``, ``last_us``, ``total_bytes`` and ``fail_share``; and the types.

    ``fail_share`` is the share of the host's flows (each once, those with a row in ``meta``) whose conn
    state is one of a failed connection. Null hosts have no row; flows without a row in ``meta`` don't
    count. Null, NaN and infinite bytes count as 0; a ``ts`` of null or 0 is no time.
    """
    types = vocabulary(meta)
    fail = set(failed_types(meta, config))
    failed = [i for i, t in enumerate(types) if t in fail]
    parts = period_features(by_side(typed_flows(flows, meta, types), "ts", "bytes", "type_ix"), ["side", "host"])
    v = merge_features(parts, ["side", "host"])
    total = lambda f, zero: F.aggregate("features", zero, f)
    bad = F.array(*[F.lit(i) for i in failed]).cast("array<int>")
    out = v.select(
        "side", "host", "features",
        total(lambda a, x: a + x["n"], F.lit(0).cast("long")).alias("n_flows"),
        F.array_max(F.transform("features", lambda x: x["latest"])).alias("last_us"),
        total(lambda a, x: a + x["total"], F.lit(0.0)).alias("total_bytes"),
        total(lambda a, x: a + F.when(F.array_contains(bad, x["ix"]), x["n"]).otherwise(F.lit(0).cast("long")), F.lit(0).cast("long")).alias("__f"),
    )
    return out.withColumn("fail_share", F.col("__f") / F.col("n_flows")).drop("__f"), types


def decoded(features: DataFrame, types: list[str]) -> DataFrame:
    """Long form: ``side, host, event_type, n_flows, last_us, total_bytes``."""
    names = F.array(*[F.lit(t) for t in types]).cast("array<string>")
    e = features.select("side", "host", F.inline("features"))
    return e.select("side", "host", F.get(names, F.col("ix")).alias("event_type"), F.col("n").alias("n_flows"), F.col("latest").alias("last_us"), F.col("total").alias("total_bytes"))
