"""Detectors: settings of the queries, fits against known answers, edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardstream.operators import detector, metrics
from wardstream.operators.order_stats import medians
from wardstream.plans import registry

SF = "/root/testdata/sf0.01"


def test_m02_grows_the_reference_forest(spark, monkeypatch):
    seen, fit = [], detector.Isolation.fit
    monkeypatch.setattr(detector.Isolation, "fit", lambda self, train: seen.append(fit(self, train)) or seen[-1])
    registry.queries()["ref_m02_isolation"](spark, SF)
    m = seen[0]
    assert (m.trees, m.sample) == (200, 8192) and len(m.forest) == 200 and m.size == 8192


class Fitted(Exception):
    pass


def test_boosted_queries_run_200_rounds_with_leaves_of_200(spark, monkeypatch):
    seen = []

    def stop(self, train):
        seen.append((self.settings["iterations"], self.settings["leaf"], self.settings["l2"], self.rows))
        raise Fitted

    monkeypatch.setattr(detector.Boosted, "fit", stop)
    for name in ("ref_m01_boosted", "ref_m04_host_conditioned"):
        with pytest.raises(Fitted):
            registry.queries()[name](spark, SF)
    assert seen == [(200, 200, 1.0, detector.FIT_ROWS)] * 2
    assert detector.transfer(["a"]).settings == {"iterations": 300, "step": 0.1, "leaf": 20, "l2": 1.0, "leaves": 31}


def test_histogram_trees_learn_and_respect_their_limits():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    m = detector.Histograms(60, 0.1, 50, 1.0, 8).fit(x[:3000], y[:3000])
    assert ((m.margin(x[3000:]) > 0) == y[3000:]).mean() > 0.95
    for f, cut, left, right, value in m.trees:
        assert (f < 0).sum() <= 8 and (f < 0).sum() == (f >= 0).sum() + 1
    one = detector.Histograms(1, 0.1, 50, 1.0, 2).fit(x, y)
    f, cut, left, right, value = one.trees[0]
    low = one.bin(x)[:, f[0]] <= cut[0]
    p = y.mean()
    for side, node in ((low, left[0]), (~low, right[0])):  # a Newton step with the penalty
        assert side.sum() >= 50 and value[node] == pytest.approx(-0.1 * (p - y[side]).sum() / (side.sum() * p * (1 - p) + 1))
    assert (detector.Histograms(5, 0.1, 50, 1.0, 8).fit(x, np.zeros(4000)).margin(x) < 0).all() and (detector.Histograms(5, 0.1, 1, 1.0, 8).fit(x[:0], y[:0]).margin(x) == 0).all()


def test_fits_in_tasks_and_edges(spark):
    rng = np.random.default_rng(1)
    data = [(i, float(a), float(b), None if i % 50 == 0 else int(a + b > 0)) for i, (a, b) in enumerate(rng.normal(size=(3000, 2)))] + [(9000, float("nan"), None, 1), (9001, float("inf"), 0.0, 0)]
    df = spark.createDataFrame(data, "ingest_id long, a double, b double, label int").repartition(3)
    m = detector.Boosted(["a", "b"], 40, leaf=20).fit(df)
    s = m.score(df).where("ingest_id < 9000").select((F.col("score") > 0).cast("int").alias("p"), "label").dropna()
    assert s.agg(F.avg((F.col("p") == F.col("label")).cast("double"))).first()[0] > 0.95
    few = detector.Boosted(["a", "b"], 5, leaf=20, rows=500).fit(df)
    assert few.model.trees and m.score(df.limit(0)).count() == 0
    assert detector.Boosted(["a", "b"]).fit(df.limit(0)).score(df).select("score").distinct().count() == 1
    forest = detector.Isolation(["a", "b"], 30, 200).fit(df.where("ingest_id < 9000"))
    odd = forest.score(spark.createDataFrame([(0.0, 0.0), (9.0, -9.0)], "a double, b double")).collect()
    assert len(forest.forest) == 30 and odd[1].score > odd[0].score + 0.1
    assert detector.Isolation(["a", "b"]).fit(df.limit(0)).score(df.limit(3)).count() == 3


def test_replaced_margins_are_those_of_changed_rows():
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(3000, 4)), 1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0) ^ (rng.random(3000) < 0.1)).astype(float)
    for leaves in (8, 150):  # one word of leaves and several
        m = detector.Histograms(20, 0.1, 3, 1.0, leaves).fit(x, y)
        assert max((t[0] < 0).sum() for t in m.trees) > leaves / 2
        fixed = [(1, 0.05), (0, -9.0), (1, 9.0), (3, 0.0)]
        for got, (j, v) in zip(m.replaced(x, fixed), fixed):
            assert got == pytest.approx(m.margin(np.where(np.arange(4) == j, v, x)), abs=1e-12)
    assert detector.Histograms(5, 0.1, 1, 1.0, 8).fit(x[:0], y[:0]).replaced(x, [(0, 1.0)]).tolist() == [[0.0] * 3000]


def test_ablation_is_one_pass_and_keeps_half_medians(spark):
    rng = np.random.default_rng(3)
    data = [(int(a), int(a > 5) if b < 0.9 else int(a <= 5), float(b) if i % 7 else None) for i, (a, b) in enumerate(zip(rng.integers(0, 12, 400), rng.random(400)))] 
    df = spark.createDataFrame(data, "a long, label int, b double")
    m = detector.Boosted(["a", "b"], 20, leaf=5).fit(df)
    benign = df.where("label = 0").toPandas()
    med = {c: float(np.median(benign[c].dropna())) for c in ("a", "b")}
    assert medians(df.where("label = 0"), ["a", "b", "a"]) == pytest.approx([med["a"], med["b"], med["a"]])
    assert medians(spark.createDataFrame([(1, None), (2, None), (2, None), (9, None), (4, None), (3, None)], "a long, b double"), ["b", "a"]) == [None, 2.5]
    got = {r.column: r for r in metrics.aurocs(detector.ablations(m, df, df, ["a", "b"]), "column", "ablated").collect()}
    p = df.toPandas()
    for i, c in enumerate(("a", "b")):
        s = m.model.margin(p.assign(**{c: med[c]})[["a", "b"]].fillna(0.0).to_numpy(dtype=float))
        pos, neg = s[p.label == 1], s[p.label == 0]
        want = ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / len(pos) / len(neg)
        assert (got[i].n_pos, got[i].n_neg) == (len(pos), len(neg)) and got[i].auroc == pytest.approx(want)


def test_m08_does_not_work_out_the_host_features_for_every_column(spark):
    """The flows are read a few times, whatever the number of ablated columns."""
    spark.sparkContext.setJobGroup("m08", "m08")
    try:
        got = registry.queries()["ref_m08_ablation"](spark, "/root/testdata/sf0.001").collect()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("m08"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert [r.column for r in got] == detector.HOST_COLUMNS and len({(r.n_pos, r.n_neg) for r in got}) == 1 and all(0 <= r.auroc <= 1 for r in got)
    assert jobs < 100
