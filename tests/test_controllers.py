import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardstream.operators import attack, spending
from wardstream.operators import controllers as c


def streams(n=6, t=120):
    for seed in range(n):
        rng = np.random.default_rng(seed)
        u = rng.uniform(size=t)
        e = np.where(u < 0.45, 0.0, np.where(u < 0.75, rng.uniform(1, 6, t), rng.uniform(5, 5000, t)))
        for kind in ("poly", "uniform"):
            yield e, kind


A, W0, CEIL = 0.05, 0.025, 1e4


def p_of(e):
    return min(1.0, 1.0 / e) if e > 0 else 1.0


def literal_lond(e, g, a=A):
    r, out = 0, []
    for t in range(1, len(e) + 1):
        lvl = a * g[t] * (r + 1)
        hit = lvl > 0 and CEIL >= 1 / lvl and e[t - 1] >= 1 / lvl
        r += hit
        out.append(hit)
    return out


def literal_lordpp(e, g):
    taus, out = [], []
    for t in range(1, len(e) + 1):
        lvl = g[t] * W0 + ((A - W0) * g[t - taus[0]] if taus else 0) + A * sum(g[t - x] for x in taus[1:])
        hit = lvl > 0 and CEIL >= 1 / lvl and e[t - 1] >= 1 / lvl
        if hit:
            taus.append(t)
        out.append(hit)
    return out


def literal_adaptive(e, g, lam, tau, addis):
    """SAFFRON and ADDIS by their definition: recount candidates and selections for every step."""
    p, out = [p_of(x) for x in e], []
    for t in range(1, len(e) + 1):
        before = range(t - 1)
        sel = sum(p[i] <= tau for i in before) if addis else t - 1
        cand = sum(p[i] <= lam for i in before)
        hits = [i for i in before if out[i]]
        clock = sel - cand + (0 if addis else 1)

        def at(i):
            s = sum(p[j] <= tau for j in range(i + 1)) if addis else i + 1
            return s - sum(p[j] <= lam for j in range(i + 1))

        def gam(x):
            return g[x] if 0 <= x < len(g) else 0.0

        raw = W0 * gam(clock) + sum((A - W0 if n == 0 else A) * (gam(clock - at(i)) if clock - at(i) >= (0 if addis else 1) else 0) for n, i in enumerate(hits))
        lvl = min(lam, ((tau - lam) if addis else (1 - lam)) * raw)
        out.append(bool(lvl > 0 and CEIL >= 1 / lvl and p[t - 1] <= lvl))
    return out


def one_based(kind, t):
    return np.concatenate([[0.0], spending.gamma(kind, t)])


def test_lond_and_lordpp_match_literal():
    for e, k in streams():
        assert list(c.PROCEDURES["elond"](e, CEIL, k, A, W0).fired) == literal_lond(e, one_based(k, len(e)))
        assert list(c.PROCEDURES["lordpp"](e, CEIL, k, A, W0).fired) == literal_lordpp(e, one_based(k, len(e)))


def test_saffron_and_addis_match_literal():
    for e, k in streams():
        assert list(c.PROCEDURES["saffron"](e, CEIL, k, A, W0).fired) == literal_adaptive(e, one_based(k, len(e)), 0.5, 1.0, False)
        assert list(c.PROCEDURES["addis"](e, CEIL, k, A, W0).fired) == literal_adaptive(e, spending.gamma(k, len(e)), 0.25, 0.5, True)


def literal_ebh(e, g, a):
    best = 0
    cost = sorted(1 / (a * gi * ei) for ei, gi in zip(e, g) if ei > 0 and gi > 0)
    for k, v in enumerate(cost, 1):
        if v <= k:
            best = k
    return [bool(ei > 0 and gi > 0 and 1 / (a * gi * ei) <= best) for ei, gi in zip(e, g)]


def test_ebh_matches_literal_and_holds_elond():
    for e, k in streams():
        g = spending.gamma(k, len(e))
        fired = c.online_ebh(e, CEIL, g, A).fired
        assert list(fired) == literal_ebh(e, g, A)
        assert not (c.PROCEDURES["elond"](e, CEIL, k, A, W0).fired & ~fired).any()


def test_deadline_limits():
    for e, k in streams():
        g = spending.gamma(k, len(e))
        n = len(e)
        assert (c.etoad(e, CEIL, g, A, c.deadlines("immediate", n)).fired == c.PROCEDURES["elond"](e, CEIL, k, A, W0).fired).all()
        assert (c.etoad(e, CEIL, g, A, c.deadlines("arc", n)).fired == c.online_ebh(e, CEIL, g, A).fired).all()
    b = np.array([0, 0, 1, 1, 1, 4])
    assert list(c.deadlines("bucket", 6, bucket=b)) == [2, 2, 5, 5, 5, 6]
    assert list(c.deadlines("time", 3, ts=np.array([0, 5, 20]), horizon=6)) == [2, 2, 3]
    with pytest.raises(ValueError):
        c.deadlines("bucket", 3, bucket=np.array([2, 1, 3]))


def test_generalised_investing_identities():
    for e, _ in streams(3):
        shares = np.array([0.01 * 0.99**i for i in range(len(e))])
        a = c.fold(c.EGai(A, "saffron", lam=0.0, shares=shares), e, CEIL).fired
        assert (a == c.fold(c.EGai(A, "lord", shares=shares), e, CEIL).fired).all()
        g, rest = [], 1.0
        for w in shares:
            g.append(w * rest)
            rest *= 1 - w
        lord = c.fold(c.EGai(A, "lord", shares=shares), e, CEIL)
        if lord.fired.sum() == 0:
            assert np.allclose(lord.level, A * np.array(g))


def brute_closed(e, g, alpha):
    """Closed LOND by all subsets of earlier indices."""
    out = []
    for t in range(len(e)):
        r, best = sum(out), None
        for mask in range(1 << t):
            s = [i for i in range(t) if mask >> i & 1]
            d = 1 + sum(out[i] for i in s) - alpha * (r + 1) * sum(e[i] * g[n] for n, i in enumerate(s))
            if d > 0:
                lvl = alpha * g[len(s)] * (r + 1) / d
                best = lvl if best is None else min(best, lvl)
        lvl = best or 0.0
        out.append(bool(lvl > 0 and CEIL >= 1 / lvl and e[t] >= 1 / lvl))
    return out


def test_closed_matches_all_subsets():
    for seed in range(5):
        e = np.where(np.random.default_rng(seed).uniform(size=9) < 0.4, 0.0, np.random.default_rng(seed + 50).uniform(1, 400, 9))
        assert list(c.PROCEDURES["closed_elond"](e, CEIL, "poly", 0.3, 0.1).fired) == brute_closed(e, spending.gamma("poly", 9), 0.3)


def brute_toad(e, g, a, deadline):
    """Step by step from the definition, by trying every size of the set."""
    n, fired = len(e), set()
    for t in range(1, n + 1):
        open_ = [i for i in range(t) if deadline[i] >= t]
        locked = [i for i in fired if deadline[i] < t]
        for r in range(t, 0, -1):
            in_ = [i for i in open_ if e[i] > 0 and a * g[i] * e[i] * r >= 1 - 1e-15]
            if len(in_) + len(locked) >= r:
                fired |= set(in_)
                break
    return [i in fired for i in range(n)]


def test_deadlines_match_the_definition():
    for seed, (e, k) in enumerate(streams()):
        rng, e, g = np.random.default_rng(seed), e[:50], spending.gamma(k, 50)
        for d in (np.arange(1, 51) + rng.integers(0, 30, 50).astype(float), c.deadlines("bucket", 50, bucket=np.arange(50) // 7), c.deadlines("time", 50, ts=np.sort(rng.uniform(0, 9, 50)), horizon=1.5)):
            assert list(c.etoad(e, CEIL, g, 0.3, d).fired) == brute_toad(e, g, 0.3, d)


def brute_donation(e, g, a):
    n, best = len(e), 0
    order = sorted(range(n), key=lambda i: (-g[i] * e[i], i))
    for r in range(1, n + 1):
        s = sum(min(g[i] * e[i] - 1 / (a * r), g[i]) for i in order[:r]) + sum(g[i] * min(e[i], 1.0) for i in order[r:])
        best = r if s >= 0 else best
    return {i for i in order[:best] if g[i] > 0}


def test_donation_matches_the_definition():
    for e, k in streams():
        for a in (0.05, 0.3, 0.8):
            g = spending.gamma(k, 40)
            out = c.donation_ebh(e[:40], CEIL, g, a)
            assert set(np.flatnonzero(out.notes["snapshot"])) == brute_donation(e[:40], g, a)
            assert set(np.flatnonzero(out.notes["union"])) == set().union(*(brute_donation(e[:t], g[:t], a) for t in range(1, 41)))


def test_steered_thresholds():
    cal = np.arange(101.0)
    t = c.Threshold(cal, 0.05, start=0.5, gain=0.1, least=1)
    assert t.cut == 50.0
    t.learn(1)
    assert t.theta == pytest.approx(0.595)
    hit = c.feedback(np.full(30, 80.0), np.zeros(30, bool), c.Threshold(cal, 0.05, start=0.5, gain=0.1), 0)
    assert hit[:4].all() and not hit[-1]  # false alerts raise the threshold above the scores
    late = c.delayed_control(np.full(30, 80.0), np.arange(30), np.zeros(30, bool), c.Threshold(cal, 0.05, start=0.5, gain=0.1), 100)
    assert late.all()  # no label has arrived
    w = c.Threshold(cal, 0.05, "PI", start=0.99, gain=0.1, integral=0.1)
    for _ in range(50):
        w.learn(1)
    assert w.theta == 1.0 and w.total < 1  # the sum of errors does not wind up
    q = c.Threshold(cal, 0.1, "AQT", start=0.5, gain=0.1)
    q.learn(0)
    assert q.theta == pytest.approx(0.49)
    assert c.Threshold(np.array([]), 0.1).cut == np.inf


def test_closed_takes_no_longer_stream_than_allowed():
    with pytest.raises(ValueError):
        c.ClosedLond(spending.gamma("poly", 11), 0.1, max_t=10)


def test_donations_reject_at_least_as_much():
    for e, k in streams():
        plain = c.PROCEDURES["elond"](e, CEIL, k, A, W0).fired.sum()
        assert c.PROCEDURES["donation_elond"](e, CEIL, k, A, W0).fired.sum() >= plain
        assert c.PROCEDURES["donation_ebh"](e, CEIL, k, A, W0).fired.sum() >= c.PROCEDURES["ebh"](e, CEIL, k, A, W0).fired.sum()
    with pytest.raises(ValueError):
        c.PROCEDURES["donation_elond"](np.array([np.inf]), CEIL, "poly", A, W0)


def test_step_up():
    p = np.array([0.001, 0.012, 0.02, 0.5, 0.9])
    assert list(c.step_up(p, 0.05)) == [True, True, True, False, False]
    assert c.step_up(p, 0.05, True).sum() == 1 and c.step_up(np.array([]), 0.1).size == 0


def test_spending_and_horizons():
    assert spending.zeta(1.6) == pytest.approx(2.28576566568013, abs=1e-13)
    assert spending.cold_window("poly", 1e4 + 1, A, 100_000) == 29 == spending.cold_window_closed(1e4 + 1, A)
    assert spending.cold_window("poly", 1e6 + 1, A, 100_000) == 515 == attack.deadline(1e6 + 1, A, "poly", 100_000)
    assert attack.margin(1_813_113, 31_568) == pytest.approx(0.43578, abs=1e-4)


def test_control_runs_streams_in_parallel_and_like_native(spark):
    data = [(s, t + 1, float(e), 1e4) for s, (x, _) in enumerate(streams(3)) for t, e in enumerate(x)]
    df = spark.createDataFrame(data, "s int, pos long, ev double, ceiling double").withColumn("level", F.lit(9))  # clashing name
    a = {(r.s, r.pos): (r.fired, r.silent, round(r.level, 12)) for r in c.control(df, "elond", ["s"]).collect()}
    b = {(r.s, r.pos): (r.fired, r.silent, round(r.level, 12)) for r in c.elond_native(df.drop("level"), by=["s"]).collect()}
    assert a == b and sum(v[0] for v in a.values()) > 0
    assert c.control(df.limit(0), "elond").count() == 0
    one = df.where("s = 1").drop("level")
    assert {r.pos for r in c.ebh_native(one).where("fired").collect()} == {r.pos for r in c.control(one, "ebh").where("fired").collect()}


def test_restart_is_a_fresh_controller(spark):
    e, _ = next(streams(1))
    df = spark.createDataFrame([(i + 1, float(x), 1e4, i // 40) for i, x in enumerate(e)], "pos long, ev double, ceiling double, epoch int")
    got = {r.pos: r.fired for r in c.restarted(df, "elond", allocation="each").collect()}
    want = np.concatenate([c.PROCEDURES["elond"](e[i : i + 40], CEIL, "poly", A, W0).fired for i in (0, 40, 80)])
    assert [got[i + 1] for i in range(len(e))] == list(want)


def test_attack_costs():
    from fractions import Fraction

    e, n, m = np.array([5000.0, 0.0, 4000.0]), np.array([2, 1, 3]), np.array([True, False, True])
    out = attack.joint_attack(e, n, m, CEIL, "uniform", A)
    assert list(out["pads"] > 0) == [True, False, True] and not out["fired"].any()
    for r in out.itertuples():
        if r.pads:
            assert r.outcome == "suppressed"
    assert attack.exact_pads(2, 10, Fraction(1000), Fraction(1, 10)) == 191
    assert attack.cheapest_prefix([0.0] * 5, 20.0, 2, 4.0) == 3 and attack.cheapest_prefix([], 20.0, 2, 4.0) is None and attack.cheapest_prefix([], 8.0, 2, 4.0) == 0
    assert attack.pads_for_confidence(100.0, 10.0, 1, 0.0, 100.0) == 10 and attack.pads_for_confidence(100.0, 10.0, 1, 0.2, 100.0) is None
    from wardstream.functions.special import binom_cdf

    for p in (0.001, 0.01, 0.05):
        slow = next(r for r in range(10_000) if (s := math.ceil((10.0 * (3 + r) - 500.0) / 100.0) - 1) >= 0 and binom_cdf(s, r, p) >= 0.9)
        assert attack.pads_for_confidence(500.0, 10.0, 3, p, 100.0) == slow
    assert [attack.absorbing_gap(n + 1.0, A, W0, 10**7) for n in (10**4, 10**6, 10**8)] == [34_567, 6_543_160, 9_951_885]
    assert attack.absorbing_gap(1e4 + 1, A, W0) > 34_567
    b = attack.addis_budget(np.array([0.0, 0.0]), 1e4, 1e6, "poly", A, W0, 5000)
    assert b and attack.addis_level_after(np.zeros(2), b, 0.375, 1e6, "poly", A, W0, 5000) < 1e-4 <= attack.addis_level_after(np.zeros(2), b - 1, 0.375, 1e6, "poly", A, W0, 5000)
