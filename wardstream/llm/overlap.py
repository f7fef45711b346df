"""Flows of evaluation splits that occur, exactly or almost, among the train flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstream.functions.columns import finite
from wardstream.llm.cosine_join import near_pairs, pair_keys
from wardstream.schema import FEATURES

TOLERANCE = 0.005
EVALUATION = ["cal", "deploy"]


def comparable(flows: DataFrame) -> DataFrame:
    """Flows of the three splits with at least two packets: ``ingest_id, split, sensor, label, x, k1, k2``.

    Null, NaN and infinite components are 0, negative zero is zero. ``k1, k2`` is a 128-bit key of ``x``,
    computed from the row alone, so equal vectors meet without a join.
    """
    x = [finite(c, "float") for c in FEATURES]
    f = flows.where(F.col("split").isin("train", *EVALUATION) & (finite("f3") + finite("f4") >= 2))
    return f.select("ingest_id", "split", "sensor", "label", F.array(*x).alias("x"), F.xxhash64(F.lit(1), *x).alias("k1"), F.xxhash64(F.lit(2), *x).alias("k2"))


def overlap_classes(flows: DataFrame, tol: float = TOLERANCE) -> DataFrame:
    """Pairs of distinct vectors ``a1, a2`` (train) and ``b1, b2`` (evaluation); membership is in :func:`comparable`."""
    return near_pairs(comparable(flows).select("k1", "k2", "x", (F.col("split") == "train").alias("left")), len(FEATURES), tol)


def overlap_pairs(flows: DataFrame, tol: float = TOLERANCE) -> DataFrame:
    """Pairs of ``ingest_id``, smaller first: ``id_a, id_b``; copies count with their own ids, labels don't matter."""
    pairs = overlap_classes(flows, tol)
    c = comparable(flows).select("ingest_id", "split", "k1", "k2").join(pair_keys(pairs), ["k1", "k2"], "left_semi")
    members = lambda where, k, name: c.where(where).select(F.col("k1").alias(f"{k}1"), F.col("k2").alias(f"{k}2"), F.col("ingest_id").alias(name))
    out = pairs.join(members("split = 'train'", "a", "__t"), ["a1", "a2"]).join(members("split <> 'train'", "b", "__e"), ["b1", "b2"])
    return out.select(F.least("__t", "__e").alias("id_a"), F.greatest("__t", "__e").alias("id_b"))


def overlap_counts(flows: DataFrame, tol: float = TOLERANCE) -> DataFrame:
    """Per evaluation split and sensor: ``n_flows`` (comparable), ``n_exact`` (X also in train), ``n_near``
    (X exactly or almost in train), ``n_same_label`` (with an equal label in a partner), ``n_pairs``.

    Works on distinct vectors, so copies are multiplied as numbers, never as rows; counts are combined
    map-side, so a vector on a third of all rows is one state per task. A null sensor is a group of its own.
    """
    pairs = overlap_classes(flows, tol)
    c = comparable(flows).select("split", "sensor", "label", "k1", "k2")
    matched = c.join(pair_keys(pairs), ["k1", "k2"], "left_semi")
    train = matched.where("split = 'train'").groupBy(F.col("k1").alias("a1"), F.col("k2").alias("a2")).agg(F.count("*").alias("n_train"), F.count_if(F.col("label") == 0).alias("n_train_0"), F.count_if(F.col("label") == 1).alias("n_train_1"))
    per = pairs.join(train, ["a1", "a2"]).groupBy(F.col("b1").alias("k1"), F.col("b2").alias("k2")).agg(
        F.sum("n_train").alias("p"), F.sum("n_train_0").alias("p0"), F.sum("n_train_1").alias("p1"),
        F.max((F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2"))).alias("same"),
    )
    m = matched.where("split <> 'train'").groupBy("k1", "k2", "split", "sensor", "label").agg(F.count("*").alias("n")).join(per, ["k1", "k2"])
    when = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    hits = m.groupBy("split", "sensor").agg(
        when(F.col("same")).alias("n_exact"), F.sum("n").alias("n_near"),
        when(((F.col("label") == 0) & (F.col("p0") > 0)) | ((F.col("label") == 1) & (F.col("p1") > 0))).alias("n_same_label"),
        F.sum(F.col("n") * F.col("p")).alias("n_pairs"),
    )
    all_ = c.where("split <> 'train'").groupBy("split", "sensor").agg(F.count("*").alias("n_flows"))
    out = all_.join(hits.withColumnsRenamed({"split": "__s", "sensor": "__o"}), (F.col("split") == F.col("__s")) & F.col("sensor").eqNullSafe(F.col("__o")), "left")
    return out.select("split", "sensor", "n_flows", *(F.coalesce(F.col(x), F.lit(0)).alias(x) for x in ("n_exact", "n_near", "n_same_label", "n_pairs")))


def audit_report(flows: DataFrame, collisions: DataFrame, tol: float = TOLERANCE) -> DataFrame:
    """What an earlier byte-exact audit of a sample says beside what there is, per evaluation split and sensor.

    Of a flow's audit rows the latest counts (no date is earliest; of equal dates the larger ``audit_id``).
    Columns: ``n_flows`` (comparable), ``n_audited`` (with an audit row that holds a number), ``n_confirmed``
    (audited as in train, and X is), ``n_stale`` (audited as in train, but X is not), ``n_missed`` (audited
    as not in train, but X is), ``n_almost`` (audited as not in train, and X is almost), ``n_unaudited``
    (exactly or almost in train, without an audit). Audits of other flows have no effect.
    """
    pairs = overlap_classes(flows, tol)
    same = (F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2"))
    per = pairs.groupBy(F.col("b1").alias("k1"), F.col("b2").alias("k2")).agg(F.max(same).alias("same"))
    last = F.max(F.struct("audited_at", "audit_id", "n_identical_train"))["n_identical_train"]
    audit = collisions.where("ingest_id is not null").groupBy("ingest_id").agg(last.alias("said"))
    e = comparable(flows).where("split <> 'train'").select("ingest_id", "split", "sensor", "k1", "k2").join(per, ["k1", "k2"], "left").join(audit, "ingest_id", "left")
    exact, near = F.coalesce("same", F.lit(False)), F.col("same").isNotNull()
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return e.groupBy("split", "sensor").agg(
        F.count("*").alias("n_flows"), F.count("said").alias("n_audited"), n((F.col("said") > 0) & exact).alias("n_confirmed"), n((F.col("said") > 0) & ~exact).alias("n_stale"),
        n((F.col("said") <= 0) & exact).alias("n_missed"), n((F.col("said") <= 0) & near & ~exact).alias("n_almost"), n(near & F.col("said").isNull()).alias("n_unaudited"),
    )
