"""Audits, coverage, lookups and the scenario loader against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardstream.functions.special import binom_cdf, hurwitz, normal_isf, normal_sf, zeta
from wardstream.operators import joins, metrics
from wardstream.sources import readers, sinks


def test_special_functions():
    assert zeta(1.6) == pytest.approx(2.28576566568013, abs=1e-13)
    for a in (1.0, 3.7, 500.0):
        assert hurwitz(1.6, a) == pytest.approx(a**-1.6 + hurwitz(1.6, a + 1), rel=1e-13)
    assert normal_isf(0.025) == pytest.approx(1.959963984540054) and normal_sf(normal_isf(1e-6)) == pytest.approx(1e-6)


def test_agreement_accepts_what_is_true_and_refuses_what_is_not(spark):
    rng, n = np.random.default_rng(0), 200
    p = np.concatenate([rng.uniform(0.05, 0.95, 300), rng.uniform(0, 0.02, 200), [0.0, 1.0]])
    k = rng.binomial(n, p)
    make = lambda q, o: spark.createDataFrame([(float(a), int(b)) for a, b in zip(q, o)], "predicted double, observed long")
    good = metrics.agreement(make(p, k), n).first()
    var = n * p * (1 - p)
    z = np.abs(k - n * p)[var >= 5] / np.sqrt(var[var >= 5])
    assert good.ok and good.n_checked == (var >= 5).sum() and good.max_z == pytest.approx(z.max()) and good.z_crit == pytest.approx(normal_isf(0.0025 / good.n_checked))
    low = (var < 5) & (p > 0) & (p < 1)
    assert good.n_low == low.sum() and good.low_pooled_z == pytest.approx((k - n * p)[low].sum() / math.sqrt(var[low].sum()))
    assert not metrics.agreement(make(np.minimum(p * 1.2, 1), k), n).first().ok
    worse = metrics.agreement(make([0.0, 1.0, 0.001], [1, n, 50]), n).first()
    assert (worse.n_contradicted, worse.n_low_bad, worse.ok) == (1, 1, False) and binom_cdf(49, n, 0.001) == pytest.approx(1)
    assert metrics.agreement(make([], []), n).first().ok


def test_usability_verdicts(spark):
    rows = [
        ("a", 1800, 10, 5, 3, 1.0, 2.0), ("a", 3600, 8, 5, 3, 2.0, 3.0), ("a", 7200, 6, 5, 3, 3.0, 9.0), ("b", 1800, 50, 1, 0, None, 2.0), ("b", 86400, 50, 1, 1, 4.0, 2.0),
        ("c", 1800, 10, 5, 0, None, None), ("d", 1800, 10, 5, 1, 1.0, 1.0), ("d", 3600, 10, 5, 0, None, 1.0), ("e", 1800, 0, 0, 0, None, None),
    ]
    df = spark.createDataFrame(rows, "w string, bucket_s int, n_alerts long, n_temporal long, n_attributed long, steps_per_alert double, atoms_per_alert double")
    got = {r.w: r for r in metrics.usability(df, ["w"]).collect()}
    assert {w: r.verdict for w, r in got.items()} == {"a": "usable", "b": "temporal", "c": "spatial", "d": "thin", "e": "temporal"}
    assert got["a"].steps_atoms == pytest.approx(1.0) and got["b"].steps_atoms is None and got["b"].share_temporal == 0.02
    assert metrics.usability(df.limit(0), ["w"]).count() == 0


def test_coverage_has_one_denominator_for_every_grouping(spark):
    rng = random.Random(2)
    f = [(i, rng.randrange(0, 7200) * 1_000_000, rng.choice("ab"), rng.choice("xyz"), rng.choice([0, 0, 1, None])) for i in range(300)]
    df = spark.createDataFrame(f, "ingest_id long, ts long, src string, dst string, label int")
    alerts = spark.createDataFrame([("a", 0), ("b", 1), ("b", 1)], "src string, bucket long")
    got = joins.fixed_coverage(df, alerts, ["src"], 3600, ["src", "dst"]).first()
    bad = {(s, d, t // 300_000_000) for _, t, s, d, y in f if y == 1}
    hit = {(s, d, t // 300_000_000) for _, t, s, d, y in f if y == 1 and (s, t // 3_600_000_000) in {("a", 0), ("b", 1)}}
    per = [len({x for x in hit if x[0] == s}) for s in "ab"]
    assert (got.n_bad, got.n_covered) == (len(bad), len(hit)) and got.coverage == pytest.approx(len(hit) / len(bad)) and got.blur == pytest.approx(sum(per) / 2)
    none = joins.fixed_coverage(df.where("label = 0"), alerts, ["src"], 3600, ["src", "dst"]).first()
    assert none.n_bad == 0 and none.coverage is None and none.blur is None


def test_lookup_keeps_the_grid_and_refuses_two_answers(spark):
    grid = spark.createDataFrame([("a", 1), ("b", 1)], "p string, s int")
    res = spark.createDataFrame([("a", 1, 0.5), ("a", 1, 0.5), ("c", 1, 0.1)], "p string, s int, v double")
    assert {r.p: r.v for r in metrics.looked_up(grid, res, ["p", "s"], "v").collect()} == {"a": 0.5, "b": None}
    with pytest.raises(Exception, match="not unique"):
        metrics.looked_up(grid, res.unionByName(res.withColumn("v", F.lit(9.0))), ["p", "s"], "v").collect()


def test_scenario_loader(spark, tmp_path):
    rows = [("h1", "h2", "2024-01-01 00:00:02", "benign", "5", "0", "x"), ("h1", "h3", "2024-01-01 00:00:01", "scan", "7", "1", None), ("h1", "h3", "2024-01-01 00:00:01", "scan", "8", "0", None), ("h9", "h9", "2024-01-01 00:00:00", "unknown", "1", "0", None), ("h1", "h2", "never", "benign", "1", "0", None)]
    path = str(tmp_path / "scenario")
    sinks.write_csv(spark.createDataFrame(rows, "`#c_ip:1` string, `s_ip:2` string, `timestamp:3` string, `label:4` string, `bytes:5` string, `c_rst_cnt:6` string, `note:7` string").coalesce(1), path)
    wide, usable = readers.load_scenario(spark, path, ["benign", "scan"])
    got = {r.ingest_id: r for r in wide.collect()}
    assert [got[i].bytes for i in (1, 2, 3)] == [7.0, 8.0, 5.0] and [got[i].label for i in (1, 2, 3)] == [1, 1, 0]
    assert [got[i].src_cnt for i in (1, 2, 3)] == [0, 0, 2] and got[3].src_fail == pytest.approx(0.5)
    assert "bytes" in usable and "note" not in usable and not {"src", "c_ip", "ts", "label"} & set(usable)
    p = str(tmp_path / "stage")
    sinks.write_json(wide.select("label", F.lit(None).cast("int").alias("nothing")), p)
    assert readers.read_stage(spark, p, lines=True).columns == ["label", "nothing"]
