import numpy as np
import pandas as pd
import pytest

from wardstream.operators import attack
from wardstream.plans import registry

A, MEDIUM = 0.05, "/root/testdata/sf0.01"


def _stream(pool_n, pool_fired, sum_e=4e6, n=2):
    rows = [(i + 1, 0, sum_e if own else 0.0, n, own, n, 10 - i, pool_n, pool_fired) for i, own in enumerate((True, False, True))]
    return pd.DataFrame(rows, columns=["pos", "bucket", "sum_e", "nsz", "ismal", "m_atk", "t_atk", "pool_n", "pool_fired"])


def test_live_attack_prices_beyond_ten_thousand_pads():
    group = pd.DataFrame({"e": [1500000.0]})
    assert attack.live_trajectory(group, lambda pad, k: 0.0, pd.DataFrame({"score": [0.0]}), 1.0, 1e6, 0.01)["pads"] == 15_000
    x = attack.live_attack(_stream(100, 0), 2e6, "uniform", A).set_index("pos")
    # The later one goes first by t_atk, at the level two rejections give; then the first, at its own.
    assert list(x["outcome"]) == ["suppressed"] * 2 and list(x["r_star"]) == [66665, 133332] and list(x["pads"]) == [66665, 133332] and not x["pad_fired"].any()
    assert list(attack.live_attack(_stream(19, 0), 2e6, "uniform", A)["outcome"]) == ["pool_unavailable"] * 2
    assert list(attack.live_attack(_stream(100, 0), 2e6, "uniform", A, factor=3)["outcome"]) == ["structural"] * 2
    hot = attack.live_attack(_stream(100, 100), 2e6, "uniform", A)
    assert list(hot["outcome"]) == ["pad_fired"] * 2 and (hot["pads"] == hot["pad_fired"]).all()


def test_pads_until_is_one_pad_at_a_time():
    total, n, tau, p, e = 5e4, 3, 20.0, 0.002, 1000.0
    fast = [attack.pads_until(total, n, tau, p, np.array([e]), None, np.random.default_rng([1, i]), 10**7)[0] for i in range(2000)]
    slow = []
    for i in range(2000):
        seq = np.where(np.random.default_rng([2, i]).random(60_000) < p, e, 0.0)
        slow.append(int(np.flatnonzero((total + np.cumsum(seq)) / (n + np.arange(1, 60_001)) < tau)[0]) + 1)
    assert min(fast) >= 2498 and abs(np.mean(fast) - np.mean(slow)) < 5 * np.std(slow) / 2000**0.5 * 2**0.5
    assert np.allclose(np.quantile(fast, [0.1, 0.5, 0.9]), np.quantile(slow, [0.1, 0.5, 0.9]), rtol=0.03)


def test_inserted_keys_move_what_stands_behind_them():
    ep = pd.DataFrame({"pos": [1, 4, 9], "bucket": [0, 1, 1], "place": [0.5, 0.2, 0.8], "ev": [1e4] * 3, "ceiling": [1e4] * 3})

    def literal(draws, n):
        d, r = sorted(draws[:n]), 0
        for pos, b, place in zip(ep["pos"], ep["bucket"], ep["place"]):
            moved = sum(x < place for x in d) if b == 1 else 0
            level = A * (pos + moved) ** -1.6 / attack.zeta(1.6) * (r + 1)
            hit = 1e4 >= 1 / level
            r += hit
        return not hit

    draws = np.random.default_rng(0).uniform(size=(40, 400))
    counts = [0, 5, 50, 100, 400]
    got = attack.blind_key_curve(ep, 9, A, counts, draws)
    assert [[literal(row, n) for n in counts] for row in draws] == got.tolist() and 0 < got.mean() < 1
    curve = pd.DataFrame({"n": [10, 100, 1000], "lost": [0.1, 0.5, 1.0]})
    assert attack.curve_quantile(curve, 0.5) == 100.0 and attack.curve_quantile(curve, 0.75) == pytest.approx(10**2.5) and attack.curve_quantile(curve[:2], 0.9) is None


def test_prefixes_from_one_pool_match_the_scalar_rule(spark):
    rng = np.random.default_rng(3)
    pool = [(i, float(v)) for i, v in enumerate(rng.integers(0, 12, 60))]
    groups = [(str(i), float(t), int(m)) for i, (t, m) in enumerate(zip(rng.integers(5, 300, 25), rng.integers(1, 12, 25)))]
    got = {r.gid: r.pads for r in attack.cheapest_prefixes(spark.createDataFrame(groups, "gid string, total double, m long"), spark.createDataFrame(pool, "ingest_id long, score double"), 8.0).collect()}
    assert got == {g: attack.cheapest_prefix([v for _, v in pool], t, m, 8.0) for g, t, m in groups} and None in got.values()


def test_precursor_chances_add_up():
    lo, hi = attack.precursor_window(100, 40.0)
    assert (lo, hi) == (5, 9)
    held, nominal = attack.precursor_chance(1000, 60, 100, 40.0, 0.06)
    rng = np.random.default_rng(0)
    k = rng.hypergeometric(60, 940, 100, 200_000)
    b = rng.binomial(100, 0.06, 200_000)
    assert abs(((k >= lo) & (k <= hi)).mean() - held) < 0.006 and abs(((b >= lo) & (b <= hi)).mean() - nominal) < 0.006
    assert attack.precursor_chance(50, 5, 100, 40.0, 0.06)[0] is None


def test_x23_attacks_every_own_episode(spark):
    q = registry.queries()
    x = q["ref_x23_live"](spark, MEDIUM).toPandas()
    price = {r.pos: r.r_star for r in q["ref_x01_zero_pads"](spark, MEDIUM).collect()}
    for (pool, kind, attacker, seed), g in x.groupby(["pool", "gamma", "attacker", "seed"]):
        if kind == "uniform":
            assert dict(g[g["fired_before"]].set_index("pos")["r_star"]) == price
    assert set(x["attacker"]) >= {"greedy", "total x3", "own x3"} and x["seed"].nunique() == 100
    greedy = x[(x["attacker"] == "greedy") & (x["pool"] == "anyone")]
    assert not greedy["fired"].any() and (x[x["pool"] == "victim"]["pads"] == 0).all()


def test_replay_is_bounded_by_the_price(spark):
    a = spark.createDataFrame([(1, 5e7, 10, 20.0), (2, 1e6, 10, 20.0)], "pos long, sum_e double, nsz long, tau double")
    got = {(r.pos, r.rep): r.pads for r in attack.replay(a, ["pos"], [0.0], 2).collect()}
    assert got == {(1, 0): 2_499_991, (1, 1): 2_499_991, (2, 0): 49_991, (2, 1): 49_991}
    # As many draws from few values with counts as from the values themselves, and more than without firing pads.
    hot = attack.replay(a, ["pos"], [0.0, 100.0], 200, counts=[999, 1]).groupBy("pos").agg({"pads": "avg"}).collect()
    assert all(abs(v / w - 1) < 0.01 for _, v in hot for w in [{1: 5e7, 2: 1e6}[_] / (20.0 - 0.1)])
    assert all(r.pads is None for r in attack.replay(a, ["pos"], [], 1).collect())


def test_causal_replay_follows_the_kth_pads_chance(spark):
    a = spark.createDataFrame([(1, 1e6, 10, 20.0)], "pos long, sum_e double, nsz long, tau double")
    price = lambda levels, chances, reps=1: [r.pads for r in attack.replay_causal(a, ["pos"], levels, chances, 1000.0, reps).collect()]
    assert price([1, 1000, 100_000], [0.0, 0.0, 0.0]) == [49_991] and price([1, 49_990], [0.0, 0.0]) == [None]
    # 99 firing pads at first, none later: 99 times the ceiling more to dilute.
    assert price([1, 100, 100_000], [1.0, 0.0, 0.0]) == [49_991 + 99 * 50]
    flat = price([1, 300, 20_000, 400_000], [0.002] * 4, 300)
    static = [r.pads for r in attack.replay(a, ["pos"], [0.0, 1000.0], 300, counts=[998, 2]).collect()]
    assert abs(np.mean(flat) / np.mean(static) - 1) < 0.01


def test_x06_draws_from_the_observed_benign_flows(spark):
    q = registry.queries()
    price = {r.pos: r.r_star for r in q["ref_x01_zero_pads"](spark, MEDIUM).collect()}
    got = q["ref_x06_replay"](spark, MEDIUM).toPandas()
    # No benign flow of this table fires, so every replay takes the closed form's pads.
    assert len(got) == 5 * len(price) and all(r.pads == price[r.pos] for r in got.itertuples())
