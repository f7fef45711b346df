import bisect
import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardstream.functions import special
from wardstream.functions.hashing import draw, h63, key_hash, mix64, uniform
from wardstream.operators import bootstrap, detector, episodes, evidence, history, ingest, joins, merging, metrics
from wardstream.sources import readers, sinks
from wardstream.streaming import elond


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_mix64_and_key_hash(spark):
    want = {0: 0, 1: 6238072747940578789, 2: 15839785061582574730, 12345678901234567: 8721909405978493183, 2**63 - 1: 6514504133438201533}
    df = spark.createDataFrame([(k,) for k in want], "k long")
    got = {r.k: r.h % 2**64 for r in df.select("k", mix64(F.col("k")).alias("h")).collect()}
    assert got == want
    assert df.select(h63(key_hash(["k"], 5)).alias("h")).where("h < 0").count() == 0
    u = df.select(uniform(F.col("k"), 1).alias("u")).agg(F.min("u"), F.max("u")).first()
    assert 0 <= u[0] <= u[1] < 1


def test_special_functions():
    assert special.zeta(1.6) == pytest.approx(2.28576566568013, abs=1e-13) and special.zeta(2) == pytest.approx(np.pi**2 / 6, abs=1e-13)
    assert special.harmonic(10) == pytest.approx(sum(1 / i for i in range(1, 11)), abs=1e-12)
    assert special.beta_cdf(0.3, 2, 5) == pytest.approx(1 - sum(__import__("math").comb(6, k) * 0.3**k * 0.7 ** (6 - k) for k in range(2)), abs=1e-12)
    lo, hi = special.clopper_pearson(0, 10)
    assert lo == 0 and hi == pytest.approx(1 - 0.025**0.1, abs=1e-9)
    assert special.binom_cdf(3, 10, 0.2) == pytest.approx(0.8791261184, abs=1e-9)
    assert special.hypergeom_at_least_one(10, 3, 2) == pytest.approx(1 - (7 * 6) / (10 * 9), abs=1e-12)
    assert special.normal_sf(1.959963984540054) == pytest.approx(0.025, abs=1e-12) and special.wilson(0, 0) is None


def test_positions_and_ranks(spark):
    rng = random.Random(0)
    data = [(i, rng.randint(0, 20)) for i in range(500)]
    df = spark.createDataFrame(data, "id long, v int")
    want = {i: n + 1 for n, (v, i) in enumerate(sorted((v, i) for i, v in data))}
    assert {r.id: r.pos for r in ingest.positions(df, ["v", "id"]).collect()} == want
    place = {i: "train" if p <= 100 else "cal" if p <= 250 else "deploy" if p <= 430 else None for i, p in want.items()}
    assert {r.id: r.split for r in ingest.positional_split(df, (100, 250, 430), "v", "id").collect()} == place
    assert ingest.positional_split(df, (0, 0, 9999), "v", "id").where("split = 'deploy'").count() == 500 and ingest.positional_split(df.limit(0), (1, 2, 3), "v", "id").count() == 0
    cal = [rng.choice([None, rng.randint(0, 20)]) for _ in range(200)]
    c = spark.createDataFrame([(x,) for x in cal], "v int")
    known = sorted(x for x in cal if x is not None)
    got = {r.id: (r.above, r.ties, r.rank, r.nc) for r in evidence.ranks(df, c, "v").collect()}
    for i, v in data:
        a, t = len(known) - bisect.bisect_right(known, v), known.count(v)
        assert got[i] == (a, t, 1 + a + t, len(known))


def test_threshold_counts_ties_against_the_row(spark):
    cal = spark.createDataFrame([(1.0,), (5.0,), (5.0,), (None,)], "score double")
    t = spark.createDataFrame([(5.0,), (5.1,), (None,), (1.0,)], "score double")
    assert [r.e for r in evidence.threshold_evidence(t, cal, 1).orderBy(F.col("score").asc_nulls_first()).collect()] == [0, 0, 0, 4.0]
    assert evidence.threshold_evidence(t, cal, 3).where("e > 0").count() == 2
    assert evidence.threshold_evidence(t, cal.limit(0), 1).where("e = 1").count() == 3
    s = evidence.stratified_evidence(t.withColumn("z", F.when(F.col("score") > 5, "a")), cal.withColumn("z", F.lit("a")), "z")
    assert {(r.score, r.e) for r in s.collect()} == {(5.0, 0.0), (5.1, 4.0), (None, 0.0), (1.0, 0.0)}


def test_rolling_matches_brute_force(spark):
    rng = random.Random(5)
    v = [rng.randint(0, 9) for _ in range(120)]
    df = spark.createDataFrame([(i + 1, x) for i, x in enumerate(v)], "pos long, score int")
    got = {r.pos: r.p for r in evidence.rolling_p(df, "pos", 7, block=30).collect()}
    for i, x in enumerate(v):
        past = v[max(0, i - 7) : i]
        assert got[i + 1] == pytest.approx((1 + sum(y >= x for y in past)) / (1 + len(past)))


def test_history_is_strict_on_ties(spark):
    rng = random.Random(2)
    h = 3600 * 1_000_000
    data = [(i, rng.choice(["a", "b", None]), rng.choice([None, rng.randint(0, 5) * h // 2, rng.randint(0, 3 * h)]), rng.randint(0, 3)) for i in range(300)]
    df = spark.createDataFrame(data, "id long, k string, t long, x long")
    got = {r.id: (r.n, r.s) for r in history.before(df, ["k"], "t", {"n": F.lit(1).cast("long"), "s": F.col("x")}).collect()}
    for i, k, t, _ in data:
        old = [] if t is None else [x for _, k2, t2, x in data if k2 == k and t2 is not None and t2 < t]
        assert got[i] == (len(old), sum(old))


def test_nearest_and_steps_match_brute_force(spark):
    rng = random.Random(4)
    h = 3600 * 1_000_000
    r_, m_ = [(i, rng.choice([None, rng.randint(0, 9 * h)])) for i in range(150)], [rng.randint(0, 9 * h) for _ in range(12)]
    got = {r.id: r.nearest_us for r in joins.nearest_in_time(spark.createDataFrame(r_, "id long, ts long"), spark.createDataFrame([(m,) for m in m_], "ts long")).collect()}
    assert got == {i: None if t is None else min(abs(t - m) for m in m_) for i, t in r_}
    e = [(i, a, a + rng.randint(0, 2 * h)) for i in range(60) for a in [rng.randint(0, 9 * h)]]
    near = {r.k: r.n_steps for r in joins.steps_near(spark.createDataFrame(e, "k long, first_ts long, last_ts long"), ["k"], spark.createDataFrame([(m,) for m in m_ * 3], "ts long")).collect()}
    w = 900 * 1_000_000
    assert near == {i: 3 * sum(a - w <= m <= b + w for m in m_) for i, a, b in e}


def test_nearest_neighbour_ties_and_empty(spark):
    base = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0]), (4, None)], "id long, v array<double>")
    got = {r.id: (r.neighbour, r.distance) for r in joins.nearest_neighbour(base, base, "id", "v", 2).collect()}
    assert got == {1: (2, 1.0), 2: (1, 1.0), 3: (1, 1.0)}
    assert joins.nearest_neighbour(base.limit(0), base, "id", "v").count() == 0


def test_episode_fixtures(spark):
    t = spark.createDataFrame([(x,) for x in (1, 1, 2, 3, 3, 3, 4)], "first_ts long")
    assert tuple(episodes.tie_exposure(t).first())[:3] == (5, 4, 3)
    hour = 3600 * 1_000_000
    f = spark.createDataFrame([(0, 1, 9, 0, 0.0), (1, 1, 9, hour // 10, 1.0), (2, 2, 9, hour // 5, 0.0), (3, 1, 9, 3 * hour, 0.0)], "ingest_id long, src long, dst long, ts long, e double").withColumn("label", F.lit(0))
    b = episodes.build(f, ["src", "dst"], 7200)
    assert b.count() == 3 and {(r.src, r.bucket): r.ev for r in b.collect()} == {(1, 0): 0.5, (2, 0): 0.0, (1, 1): 0.0}
    assert rows(episodes.ordered(b, ["src", "dst"]).select("pos", "src", "bucket")) == [(1, 1, 0), (2, 2, 0), (3, 1, 1)]
    assert episodes.arrival_rank(f, ["src"]).select("ingest_id", "arrival").orderBy("ingest_id").collect()[3].arrival == 3


def test_merging_and_metrics(spark):
    p = spark.createDataFrame([("a", 0.01), ("a", 0.02), ("a", 0.5), ("b", 0.9)], "k string, p double")
    assert {r.k: round(r.p, 9) for r in merging.simes(p, ["k"]).collect()} == {"a": 0.03, "b": 0.9}
    assert {r.k: round(r.p, 9) for r in merging.simes(p, ["k"], True).collect()} == {"a": round(0.03 * 11 / 6, 9), "b": 0.9}
    s = spark.createDataFrame([(1, 1, 2), (2, 1, 1), (3, 2, 5), (4, None, 3)], "id int, a int, b int")
    assert metrics.spearman(s, "a", "b").first().rho == pytest.approx(np.corrcoef([1.5, 1.5, 3], [2, 1, 3])[0, 1])
    assert metrics.auroc(spark.createDataFrame([(1.0, 0), (1.0, 1), (2.0, 1), (None, 1)], "score double, label int")).first().auroc == 0.75
    c = metrics.concentration(spark.createDataFrame([(x,) for x in "aaaabbc"], "v string"), "v", 1).first()
    assert (c.n, c.n_values, round(c.top_share, 9), c.n_for_mass) == (7, 3, round(4 / 7, 9), 3)
    front = metrics.frontier(spark.createDataFrame([(1, 5.0, True), (2, 4.0, False), (3, 3.0, True)], "pos int, smax double, ismal boolean"))
    assert metrics.frontier_at_budget(front, 2.5).first().tp == 1.5 and metrics.frontier_at_fdp(front, 0.4).first().tp == 2


def test_contaminate_thin_and_pools(spark):
    cal = spark.createDataFrame([(i, float(i)) for i in range(10)], "ingest_id long, score double")
    pool = spark.createDataFrame([(100 + i, 99.0) for i in range(5)], "ingest_id long, score double")
    assert ingest.contaminate(cal, pool, 3).count() == 13
    r = ingest.contaminate(cal, pool, 3, "replace")
    assert r.count() == 10 and r.agg(F.min("score")).first()[0] == 3.0
    e = spark.createDataFrame([(i, i % 4 == 0, float(i)) for i in range(40)], "k long, ismal boolean, ev double")
    small, large = ({r.k for r in ingest.thin(e, ["k"], x).where("ismal").collect()} for x in (0.05, 0.15))
    assert len(small) == 2 and len(large) == 5 and small < large
    t = ingest.thin_resampled(e, ["k"], 0.05)
    assert t.count() == 40 and t.where("ismal").count() == 2
    assert ingest.modal(spark.createDataFrame([(3,), (1,), (3,), (1,), (None,)], "v int"), "v").first().mode == 1


def test_joint_bootstrap_resamples_the_calibration_tail(spark):
    rng = np.random.default_rng(4)
    cal = [(int(c), float(x)) for c, x in zip(rng.integers(0, 20, 400), rng.normal(size=400))]
    test = [(int(c), float(x)) for c, x in zip(rng.integers(0, 15, 300), rng.normal(0.5, 1, 300))]
    ct, tt = spark.createDataFrame(cal, "c int, score double"), spark.createDataFrame(test, "c int, score double")
    for k in (1, 5):
        got = {r.rep: r for r in bootstrap.firing_ratio(tt, ct, ["c"], 40, k).collect()}
        wc, wt = ({(r.c, r.rep): r.weight for r in bootstrap.replicates(df.select("c").distinct(), ["c"], 40, seed).collect()} for df, seed in ((ct, 1), (tt, 0)))
        assert len(got) == 40
        for rep, r in got.items():
            drawn = sorted((x for c, x in cal for _ in range(wc[(c, rep)])), reverse=True)
            assert r.threshold == drawn[k - 1]
            n = sum(wt[(c, rep)] for c, _ in test)
            assert r.rate == pytest.approx(sum(wt[(c, rep)] for c, x in test if x > r.threshold) / n) and r.ratio == pytest.approx(r.rate / (k / 401))
    assert rows(bootstrap.firing_ratio(tt, ct, ["c"], 5)) == rows(bootstrap.firing_ratio(tt, ct, ["c"], 5))
    assert bootstrap.firing_ratio(tt, ct.limit(0), ["c"], 5).count() == 0 and bootstrap.firing_ratio(tt.limit(0), ct, ["c"], 5).count() == 0
    reps = bootstrap.firing_ratio(tt, ct, ["c"], 100, 5)
    assert bootstrap.ratio_test(reps, 2.0, 3).first().z is None and bootstrap.ratio_test(reps, 2.0, 30).first().z > 0
    assert bootstrap.one_sided_p(None) == 1.0 and bootstrap.one_sided_p(1.959964) == pytest.approx(0.025, abs=1e-6)


def test_poisson_weights(spark):
    u = spark.range(200_000).select(bootstrap.poisson_one(uniform(F.col("id"), 3)).alias("w"))
    m, v = u.agg(F.avg("w"), F.var_samp("w")).first()
    assert abs(m - 1) < 0.01 and abs(v - 1) < 0.02 and len(bootstrap._POISSON) > 12


def test_detectors_find_a_planted_signal(spark):
    rng = np.random.default_rng(0)
    data = [(int(i), float(rng.normal()), float(rng.normal() + 6 * (i % 10 == 0)), int(i % 10 == 0)) for i in range(1500)]
    df = spark.createDataFrame(data, "ingest_id long, x double, y double, label int").withColumn("score0", F.lit(1))
    m = detector.Boosted(["x", "y"], iterations=5, leaf=5).fit(df)
    assert metrics.auroc(m.score(df)).first().auroc > 0.97
    assert metrics.auroc(detector.ablated(m, df, df, "y"), "ablated").first().auroc < 0.8
    i = detector.Isolation(["x", "y"], trees=30, sample=256).fit(df.where("label = 0"))
    assert metrics.auroc(i.score(df)).first().auroc > 0.9


def test_sources_and_sinks(spark, tmp_path):
    line = "5,10.0.0.1,10.0.0.2,1," + ",".join(["1.5"] * 33)
    (tmp_path / "f.csv").write_text(line + "\n" + line.replace("1.5", "NaN") + "\n")
    f = readers.read_flows(spark, str(tmp_path / "f.csv"))
    assert f.count() == 2 and ingest.clean_features(f).agg(F.sum("f31")).first()[0] == 1.5
    (tmp_path / "p.csv").write_text("sport,dport\n80,NaN\n,443\n")
    assert rows(readers.read_ports(spark, str(tmp_path / "p.csv")).select("sport", "dport")) == [(0, 443), (80, 0)]
    (tmp_path / "s.csv").write_text("#c_ip:1,s_ip:2,timestamp,label,x:3\na,b,2025-01-01 00:00:01,benign,1\na,b,2,attack,z\na,b,3,odd,1\n")
    s = readers.read_scenario(spark, str(tmp_path / "s.csv"), ["benign", "attack"])
    assert rows(s.select("ts", "label", "x")) == [(1735689601000000, 0, 1.0), (2000000, 1, None)]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/x.csv", "1\n2\n")
    assert rows(readers.read_archive(spark, str(tmp_path)).select("member", "line_no", "line")) == [("d/x.csv", 0, "1"), ("d/x.csv", 1, "2")]
    (tmp_path / "n.json").write_text(json.dumps({"Subject": "a", "Content": ['{"IPs":["1.2.3.4"]}'], "Steps_submitted_time": ["2025-01-01T00:00:00Z", "bad"]}) + "\nnot json\n")
    n = readers.read_narratives(spark, str(tmp_path / "n.json")).withColumn("narrative_id", F.lit(1).cast("long"))
    assert n.count() == 1 and [r.ts for r in readers.steps(n).orderBy("step_no").collect()] == [1735689600000000, None]
    assert rows(readers.compromised(n)) == [("1.2.3.4",)]
    built = []
    for _ in range(2):
        readers.cached(spark, str(tmp_path / "c"), lambda: built.append(1) or spark.range(3)).count()
    assert built == [1] and readers.fingerprints(spark, str(tmp_path / "p.csv")).count() == 1
    sinks.write_json(s.select("ts", "x"), str(tmp_path / "j"))
    assert readers.read_stage(spark, str(tmp_path / "j")).count() >= 1
    sinks.write_csv(s.select("ts", "label"), str(tmp_path / "o"))
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).count() == 2
    tex = sinks.latex(spark.createDataFrame([("a_b", 1234, 0.5, None)], "n string, k int, x double, z string"), "t", "l")
    assert "a\\_b & 1,234 & 0.5 & --" in tex
    raw = spark.createDataFrame([tuple(str(i) for i in range(101))], [f"c{i}" for i in range(101)])
    assert readers.project_raw(raw).first().src == "2" and readers.project_raw(raw).first().label == 95


def test_streaming_decides_like_batch(spark, tmp_path):
    rng = random.Random(1)
    data = [(i, float(rng.choice([0, 0, 0, 500, 4000])), rng.choice("abc")) for i in range(0, 4000, 7)]
    src = tmp_path / "in"
    schema = "sec long, e double, src string"
    for j in range(4):
        part = data[j * 150 : (j + 1) * 150] + ([(9_999_999, 0.0, "z")] if j == 3 else [])  # moves the watermark past all
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
    flows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src)).withColumn("time", F.timestamp_seconds("sec"))
    elond.close_buckets(flows, ["src"], 600, "1 second", str(tmp_path / "closed"), str(tmp_path / "c1")).awaitTermination(120)
    q = elond.decide(elond.closed(spark, str(tmp_path / "closed"))).writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.pos: (r.key, r.fired, round(r.level, 12)) for r in spark.table("decided").collect()}
    batch = elond.decide_batch(elond.episodes_stream(spark.read.parquet(str(src)).withColumn("time", F.timestamp_seconds("sec")), ["src"], 600, "1 second").where("key <> 'z'"))
    want = {r.pos: (r.key, r.fired, round(r.level, 12)) for r in batch.collect()}
    assert len(want) > 15 and got == want


def test_nearest_neighbours_in_blocks_match_brute_force(spark):
    rng = np.random.default_rng(8)
    v = np.round(rng.normal(size=(300, 6)), 1)
    v[10] = v[20] = v[30]
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(999, None)], "vec_id long, e array<double>")
    for block, chunk in ((2048, 16_384), (7, 40)):
        got = {r.vec_id: (r.neighbour, r.distance) for r in joins.nearest_neighbour(df.where("vec_id % 5 = 0"), df, "vec_id", "e", block, chunk).collect()}
        assert set(got) == set(range(0, 300, 5))
        for i, (n, d) in got.items():
            dist = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
            dist[i] = np.inf
            assert n == int(dist.argmin()) and d == pytest.approx(dist.min())
    assert joins.nearest_neighbour(df.limit(0), df, "vec_id", "e").count() == 0 and joins.nearest_neighbour(df.where("vec_id = 1"), df.where("vec_id = 1"), "vec_id", "e").count() == 0


def test_contaminated_recall_matches_a_loop(spark):
    rng = np.random.default_rng(9)
    make = lambda n, lo, label, at: spark.createDataFrame([(at + i, float(x), label) for i, x in enumerate(rng.normal(lo, 1, n))], "ingest_id long, score double, label int")
    cal, pool, test = make(50, 0, 0, 0), make(40, 2, 1, 100), make(60, 2, 1, 200)
    h = {(s, r.ingest_id): r.h for s in range(12) for r in pool.select("ingest_id", draw(F.lit(s), "ingest_id").alias("h")).collect()}
    p, t, top = {r.ingest_id: r.score for r in pool.collect()}, [r.score for r in test.collect()], max(r.score for r in cal.collect())
    for r in evidence.contaminated_recall(test, cal, pool, [0, 1, 7], 12, salt=3).collect():
        first = sorted(p, key=lambda i: (h[(r.seed, i)], i))[: r.a]
        cut = max([top, *(p[i] for i in first)])
        assert r.threshold == cut and r.recall == pytest.approx(sum(x > cut for x in t) / len(t))


def test_tie_orders_shuffle_ties_only(spark):
    e = spark.createDataFrame([(i, i // 5, 0) for i in range(40)], "src long, first_ts long, bucket long")
    got = {}
    for r in episodes.tie_orders(e, ["src"], 6).collect():
        got.setdefault(r.seed, {})[r.pos] = r.src
    assert len(got) == 6 and len({tuple(g.values()) for g in got.values()}) > 1
    assert all(sorted(g) == list(range(1, 41)) and [g[k] // 5 for k in sorted(g)] == sorted(i // 5 for i in range(40)) for g in got.values())
