"""Online multiple testing over an ordered stream of evidence.

A procedure is an object with two methods: ``level(t)`` offers the test level of hypothesis t (from 1) and
``see(t, e, hit)`` learns its evidence and decision. :func:`fold` drives it over one stream; :func:`control`
runs many streams at once, one task per stream (window, order, procedure ... are the parallelism: a single
stream is sequential by definition and has one row per episode, not per event). Procedures that revise
earlier decisions work on the whole stream (:func:`online_ebh`, :func:`etoad`, :func:`donation_ebh`).
"""

from __future__ import annotations

import bisect
import math
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardstream.operators.ingest import positions
from wardstream.operators.order_stats import running
from wardstream.operators.spending import gamma, gamma_column


@dataclass
class Outcome:
    """Per hypothesis: offered level, whether it was rejected, whether it could not be at any evidence."""

    level: np.ndarray
    fired: np.ndarray
    silent: np.ndarray
    notes: dict = field(default_factory=dict)

    def summary(self, malicious: np.ndarray) -> dict:
        quiet = np.flatnonzero(self.silent)
        return {"rejections": int(self.fired.sum()), "true": int((self.fired & malicious).sum()), "silent": int(self.silent.sum()), "first_silent": int(quiet[0]) + 1 if quiet.size else None}


def impossible(level: float, ceiling: float) -> bool:
    """No evidence up to the ceiling reaches 1/level. Spelled as a comparison with 1/level, which differs from level*ceiling < 1 in the last bit."""
    return level <= 0 or ceiling < 1.0 / level


def fold(rule, evidence: np.ndarray, ceiling: float, as_p: bool = False) -> Outcome:
    """Drive a procedure over one stream; ``as_p`` compares p = min(1, 1/e) with the level instead of e with 1/level."""
    n = len(evidence)
    out = Outcome(np.zeros(n), np.zeros(n, bool), np.zeros(n, bool))
    for i in range(n):
        e, lvl = float(evidence[i]), rule.level(i + 1)
        out.level[i] = lvl
        if impossible(lvl, ceiling):
            out.silent[i], hit = True, False
        else:
            hit = p_of(e) <= lvl if as_p else (math.isinf(lvl) or e >= 1.0 / lvl)
        out.fired[i] = hit
        rule.see(i + 1, e, hit)
    return out


def p_of(e: float) -> float:
    return min(1.0, 1.0 / e) if e > 0 else 1.0


class Lond:
    """alpha gamma_t (R + 1): wealth grows with every rejection, also false ones."""

    def __init__(self, g: np.ndarray, alpha: float, shift: int = 0) -> None:
        self.g, self.alpha, self.shift, self.r = g, alpha, shift, 0

    def level(self, t: int) -> float:
        return self.alpha * self.g[t + self.shift - 1] * (self.r + 1)

    def see(self, t: int, e: float, hit: bool) -> None:
        self.r += hit


class _Ages:
    """Budget paid out after each rejection along the spending sequence: w0 from the start, alpha - w0 after the first, alpha after every other."""

    def __init__(self, g: np.ndarray, alpha: float, w0: float, first: int) -> None:
        self.g, self.alpha, self.w0, self.first, self.born = g, alpha, w0, first, np.empty(16, dtype=np.int64)
        self.n = 0

    def at(self, age: int | np.ndarray):
        """gamma at an age; ages beyond the sequence use its last entry, ages before its start 0."""
        a = np.asarray(age) - self.first
        return np.where(a >= 0, self.g[np.clip(a, 0, len(self.g) - 1)], 0.0)

    def offered(self, now: int) -> float:
        total = self.w0 * float(self.at(now))
        if self.n:
            total += (self.alpha - self.w0) * float(self.at(now - self.born[0]))
        if self.n > 1:
            total += self.alpha * float(self.at(now - self.born[1 : self.n]).sum())
        return total

    def add(self, when: int) -> None:
        if self.n == len(self.born):
            self.born = np.concatenate([self.born, np.empty_like(self.born)])
        self.born[self.n] = when
        self.n += 1


class LordPlusPlus:
    """gamma_t w0 + (alpha - w0) gamma_{t - tau_1} + alpha sum over later rejections of gamma_{t - tau_j}."""

    def __init__(self, g: np.ndarray, alpha: float, w0: float) -> None:
        self.ages = _Ages(g, alpha, w0, 1)

    def level(self, t: int) -> float:
        return self.ages.offered(t)

    def see(self, t: int, e: float, hit: bool) -> None:
        if hit:
            self.ages.add(t)


class Saffron:
    """LORD++ on the clock of non-candidates (p > lam), levels capped at lam."""

    def __init__(self, g: np.ndarray, alpha: float, w0: float, lam: float = 0.5) -> None:
        self.ages, self.lam, self.candidates = _Ages(g, alpha, w0, 1), lam, 0

    def level(self, t: int) -> float:
        return min(self.lam, (1.0 - self.lam) * self.ages.offered(t - self.candidates))

    def see(self, t: int, e: float, hit: bool) -> None:
        self.candidates += p_of(e) <= self.lam
        if hit:
            self.ages.add(t - self.candidates)


class Addis:
    """The clock counts selected (p <= tau) less candidates (p <= lam); conservative nulls stop it."""

    def __init__(self, g: np.ndarray, alpha: float, w0: float, lam: float = 0.25, tau: float = 0.5) -> None:
        self.ages, self.lam, self.tau, self.selected, self.candidates = _Ages(g, alpha, w0, 0), lam, tau, 0, 0

    def level(self, t: int) -> float:
        return min(self.lam, (self.tau - self.lam) * self.ages.offered(self.selected - self.candidates))

    def see(self, t: int, e: float, hit: bool) -> None:
        p = p_of(e)
        self.selected += p <= self.tau
        self.candidates += p <= self.lam
        if hit:
            self.ages.add(self.selected - self.candidates)


def risk_weight(w1: float, phi: float, psi: float, accepted: int, rejected: int) -> float:
    """w1 [1 + sum_{j<=accepted} phi^j - sum_{j<=rejected} psi^j]; must stay inside (0, 1)."""
    up = phi * (1 - phi**accepted) / (1 - phi)
    down = psi * (1 - psi**rejected) / (1 - psi)
    w = w1 * (1 + up - down)
    if not 0 < w < 1:
        raise ArithmeticError(f"risk weight {w} outside (0, 1)")
    return w


class EGai:
    """Generalised alpha-investing for e-values: a share w_t of what is left of the budget, times (R + 1).

    ``lord`` pays for every test, ``saffron`` (budget alpha (1 - lam)) only for e below 1/lam, ``mem-lord``
    forgets rejections at rate d. The share follows :func:`risk_weight` or a given sequence.
    """

    def __init__(self, alpha: float, kind: str = "lord", w1: float = 0.01, phi: float = 0.5, psi: float = 0.5, lam: float = 0.1, d: float = 0.99, shares: np.ndarray | None = None) -> None:
        self.kind, self.w1, self.phi, self.psi, self.lam, self.d, self.shares = kind, w1, phi, psi, lam, d, shares
        self.budget, self.spent, self.r, self.memory, self.w = alpha * (1 - lam) if kind == "saffron" else alpha, 0.0, 0, 0.0, w1

    def _factor(self) -> float:
        return self.d * self.memory + 1 if self.kind == "mem-lord" else self.r + 1.0

    def level(self, t: int) -> float:
        if self.shares is not None:
            self.w = float(self.shares[t - 1])
        self.now = max(0.0, self.w * (self.budget - self.spent) * self._factor())
        return self.now

    def see(self, t: int, e: float, hit: bool) -> None:
        if self.kind != "saffron" or self.lam <= 0 or e < 1.0 / self.lam:
            self.spent += self.now / self._factor()
        self.memory = self.d * self.memory + hit
        self.r += hit
        if self.shares is None:
            self.w = risk_weight(self.w1, self.phi, self.psi, t - self.r, self.r)


def implied_gamma(n: int, w1: float, phi: float = 0.5, psi: float = 0.5) -> np.ndarray:
    """The spending sequence that ``lord`` follows without rejections: w_t prod_{j<t} (1 - w_j)."""
    w = np.array([w1, *(risk_weight(w1, phi, psi, t, 0) for t in range(1, n))])[:n]
    return w * np.concatenate([[1.0], np.cumprod(1 - w)[:-1]])


def check_stream(evidence: np.ndarray, g: np.ndarray, alpha: float, ceiling: float) -> None:
    """What the boosted procedures assume: a spending sequence within budget, finite evidence up to the ceiling."""
    if not np.isfinite(g).all() or (g < 0).any() or g.sum() > 1 + 1e-9:
        raise ValueError("the spending sequence must be finite, not negative, and sum to at most 1")
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    if not np.isfinite(evidence).all() or (evidence < 0).any() or (evidence > ceiling * (1 + 1e-9)).any():
        raise ValueError("evidence must be finite and lie between 0 and the ceiling")


class DonationLond:
    """LOND whose level grows by what earlier evidence left unused.

    Donated wealth: gamma_i min(e_i, 1) of the accepted, gamma_i min(e_i - 1/(alpha gamma_i (R+1)), 1) of
    the rejected. Level alpha gamma_t (R+1) / (1 - min(alpha (R+1) wealth, 1)); a spent denominator means no bound.
    """

    def __init__(self, g: np.ndarray, alpha: float) -> None:
        self.g, self.alpha, self.open, self.ge, self.gr = g, alpha, 0.0, [], []
        self.boost = 1.0

    def level(self, t: int) -> float:
        k = len(self.ge) + 1
        given = self.open + sum(gi * min(ei - 1.0 / (self.alpha * gi * k), 1.0) for gi, ei in zip(self.gr, self.ge))
        gt = self.g[t - 1]
        if gt <= 0:
            return 0.0
        rest = 1.0 - min(self.alpha * k * given, 1.0)
        self.boost = max(self.boost, 1.0 / rest if rest > 0 else math.inf)
        return self.alpha * gt * k / rest if rest > 0 else math.inf

    def see(self, t: int, e: float, hit: bool) -> None:
        if hit:
            self.ge.append(e)
            self.gr.append(self.g[t - 1])
        else:
            self.open += self.g[t - 1] * min(e, 1.0)


def _best_with(best: np.ndarray, m: int) -> np.ndarray:
    """Best sums by number of members once m more indices without evidence or rejection may join: the largest of best[k-m..k], by doubling windows."""
    x = np.concatenate([best, np.full(m, -np.inf)])
    reach = 0
    while reach < m:  # x[k] already is the largest of the last reach + 1
        step = min(reach + 1, m - reach)
        x[step:] = np.maximum(x[step:], x[:-step].copy())
        reach += step
    return x


class ClosedLond:
    """The closure of LOND: the level is the least over all intersection hypotheses that hold t.

    An intersection with k earlier indices allows alpha gamma_{k+1} (R+1) / (1 + s), where s is the number of
    its rejections less alpha (R+1) sum e_i gamma_rank(i); what counts is the largest s for each k. Indices
    with neither evidence nor rejection add 0 to s and only shift ranks, so a run of m of them is one sliding
    maximum over k; each other index is one step. After a rejection (R enters every sum) all is built again
    from those runs. ``max_t`` is the longest stream it takes, as the work grows with its square.
    """

    def __init__(self, g: np.ndarray, alpha: float, max_t: int | None = None) -> None:
        if max_t is not None and len(g) > max_t:
            raise ValueError(f"the stream has {len(g)} hypotheses, more than max_t = {max_t}")
        self.g, self.alpha, self.r, self.best = g, alpha, 0, np.zeros(1)
        self.told: list[tuple[float, bool]] = []

    def _after(self, best: np.ndarray, e: float, hit: bool) -> np.ndarray:
        joined = np.full(len(best) + 1, -np.inf)
        joined[1:] = best + hit - self.alpha * (self.r + 1) * e * self.g[: len(best)]
        joined[:-1] = np.maximum(joined[:-1], best)
        return joined

    def _rebuilt(self) -> np.ndarray:
        best, idle = np.zeros(1), 0
        for e, hit in self.told:
            if e or hit:
                best, idle = self._after(_best_with(best, idle), e, hit), 0
            else:
                idle += 1
        return _best_with(best, idle)

    def level(self, t: int) -> float:
        rest = 1.0 + self.best
        allowed = np.divide(self.alpha * (self.r + 1) * self.g[: len(rest)], rest, out=np.full(len(rest), np.inf), where=rest > 0)
        least = float(allowed.min())
        return least if math.isfinite(least) else 0.0

    def see(self, t: int, e: float, hit: bool) -> None:
        self.told.append((e, hit))
        self.r += hit
        if hit:
            self.best = self._rebuilt()
        else:
            self.best = self._after(self.best, e, hit) if e else _best_with(self.best, 1)


def _largest_k(sorted_cost: list[float] | np.ndarray) -> int:
    """The largest k whose k-th smallest cost is at most k."""
    c = np.asarray(sorted_cost)
    ok = np.flatnonzero(c <= np.arange(1, len(c) + 1))
    return int(ok[-1]) + 1 if ok.size else 0


def ebh_cost(evidence: np.ndarray, g: np.ndarray, alpha: float) -> np.ndarray:
    """1 / (alpha gamma_t e_t), infinite where there is no evidence."""
    d = alpha * g * evidence
    return np.where(d > 0, 1.0 / np.where(d > 0, d, 1.0), np.inf)


def online_ebh(evidence: np.ndarray, ceiling: float, g: np.ndarray, alpha: float) -> Outcome:
    """e-BH on every prefix. ``level`` is alpha gamma_t k*_t, ``fired`` the final set, ``notes['entered']`` the step at which each member joined.

    Silent: the ceiling would not do even if all t hypotheses so far were rejected.
    """
    n, cost = len(evidence), ebh_cost(evidence, g, alpha)
    ks, seen, k = np.zeros(n, dtype=np.int64), [], 0
    for t in range(n):
        if np.isfinite(cost[t]):
            bisect.insort(seen, float(cost[t]))
            k = _largest_k(seen)
        ks[t] = k
    fired = cost <= (ks[-1] if n else 0)
    entered = np.where(fired, np.maximum(np.searchsorted(ks, cost, side="left"), np.arange(n)) + 1, 0)
    arrivals = np.arange(1, n + 1)
    return Outcome(alpha * g * ks, fired, ~((ceiling * alpha * g * arrivals) >= 1.0), {"k": ks, "entered": entered})


def deadlines(kind: str, n: int, bucket: np.ndarray | None = None, ts: np.ndarray | None = None, horizon: float | None = None) -> np.ndarray:
    """Last step at which each hypothesis may still be rejected: ``immediate``, ``arc`` (never ends), end of its ``bucket``, or ``time`` horizon.

    A bucket's end is the position of its last hypothesis, so buckets must come one after the other. Within
    a time horizon lie all hypotheses that arrive up to ``horizon`` after one's own ``ts``.
    """
    pos = pd.Series(np.arange(1.0, n + 1))
    if kind == "bucket":
        b = pd.Series(bucket)
        if not b.is_monotonic_increasing:
            raise ValueError("buckets must not decrease along the stream")
        return pos.groupby(b).transform("last").to_numpy()
    if kind == "time":
        arrivals = pd.DataFrame({"at": np.asarray(ts, dtype=float), "pos": pos})
        last = pd.merge_asof(pd.DataFrame({"until": arrivals["at"] + horizon}).sort_values("until", kind="stable").reset_index(), arrivals.groupby("at", as_index=False)["pos"].max(), left_on="until", right_on="at")
        return np.fmax(last.set_index("index")["pos"].sort_index().to_numpy(), pos.to_numpy())
    ends = {"immediate": pos.to_numpy(), "arc": np.full(n, np.inf)}
    if kind not in ends:
        raise ValueError(f"no deadline {kind!r}")
    return ends[kind]


def etoad(evidence: np.ndarray, ceiling: float, g: np.ndarray, alpha: float, deadline: np.ndarray) -> Outcome:
    """e-BH with decision deadlines: a hypothesis can be rejected until its deadline, then it stays as it is.

    With cost c_i = 1 / (alpha gamma_i e_i), step t allows the largest R_t such that the hypotheses of cost
    at most R_t whose deadline has not passed, and those rejected by their deadline before, are R_t at least.
    R_t never falls, so a hypothesis is rejected exactly if its cost is at most R at its deadline (or at the
    end of the stream). Only hypotheses with evidence have a finite cost, and R_t can only change when one
    arrives. ``level`` is alpha gamma_t R_t. Silent: not even evidence at the ceiling would be rejected on arrival.
    """
    check_stream(evidence, g, alpha, ceiling)
    n, steps = len(evidence), np.arange(1, len(evidence) + 1)
    if (deadline < steps).any():
        raise ValueError("a deadline lies before its hypothesis")
    cost, at_best, end = ebh_cost(evidence, g, alpha), ebh_cost(np.full(n, ceiling), g, alpha), np.minimum(deadline, n)
    holds = np.flatnonzero(np.isfinite(cost))
    reached, silent = np.zeros(n + 1, dtype=np.int64), np.zeros(n, bool)

    def support(open_costs: np.ndarray, locked: int) -> int:
        ranked = np.sort(open_costs)
        return int((np.arange(1, len(ranked) + 1) + locked)[ranked <= np.arange(1, len(ranked) + 1) + locked].max(initial=locked))

    for t in steps:
        mine = holds[holds < t]
        open_ = mine[deadline[mine] >= t]
        shut = mine[deadline[mine] < t]
        locked = int((cost[shut] <= reached[end[shut].astype(np.int64)]).sum())
        reached[t] = max(reached[t - 1], support(cost[open_], locked))
        others = open_[open_ < t - 1]
        silent[t - 1] = not at_best[t - 1] <= support(np.append(cost[others], at_best[t - 1]), locked)
    return Outcome(alpha * g * reached[1:], cost <= reached[end.astype(np.int64)], silent)


def donation_ebh(evidence: np.ndarray, ceiling: float, g: np.ndarray, alpha: float, history: str = "snapshot") -> Outcome:
    """e-BH with donated evidence: the largest r for which the surplus of the r best and the capped evidence of the rest cover 1/(alpha r) each.

    ``snapshot`` keeps the last step's set, ``union`` all that were ever in it.

    As the spending sequence sums to at most 1, what P hypotheses with evidence can lend to others is at most
    1, so r - P <= alpha r: no r beyond P / (1 - alpha) has to be tried, and for all others the balance is
    computed at once, a matrix of r by the hypotheses with evidence. The set can only change when evidence
    arrives, or while r is held back by t.
    """
    check_stream(evidence, g, alpha, ceiling)
    if history not in ("snapshot", "union"):
        raise ValueError("history is snapshot or union")
    n, worth = len(evidence), g * evidence
    now, ever = np.zeros(n, bool), np.zeros(n, bool)
    for t in range(1, n + 1):
        p = np.flatnonzero(worth[:t] > 0)
        limit = len(p) / (1 - alpha) if alpha < 1 else math.inf
        if worth[t - 1] == 0 and limit < t:
            continue
        r = np.arange(1, int(min(t, limit)) + 1)
        p = p[np.argsort(-worth[p], kind="stable")]
        price = 1.0 / (alpha * r[:, None])
        taken = np.arange(len(p)) < r[:, None]
        balance = np.where(taken, np.minimum(worth[p] - price, g[p]), g[p] * np.minimum(evidence[p], 1.0)).sum(axis=1) - np.maximum(r - len(p), 0) * price[:, 0]
        k = int(r[balance >= 0].max(initial=0))
        empty = np.flatnonzero(worth[:t] == 0)[: max(0, k - len(p))]  # lent to in order of arrival
        now = np.zeros(n, bool)
        now[p[:k]] = True
        now[empty[g[empty] > 0]] = True
        ever |= now
    return Outcome(np.zeros(n), now if history == "snapshot" else ever, np.zeros(n, bool), {"snapshot": now, "union": ever})


def step_up(p: np.ndarray, q: float, dependent: bool = False) -> np.ndarray:
    """Benjamini-Hochberg set at level q; ``dependent`` divides by the harmonic number (Benjamini-Yekutieli)."""
    n = len(p)
    w = np.sum(1.0 / np.arange(1, n + 1)) if dependent and n else 1.0
    order = np.sort(p)
    ok = np.flatnonzero(order <= q * np.arange(1, n + 1) / (n * w)) if n else np.array([], int)
    return p <= order[ok[-1]] if ok.size else np.zeros(n, bool)


class Threshold:
    """A score threshold in quantiles of the calibration scores, steered by labels as they come in.

    Quantile theta (in [0, 1]) means: alert on scores at or above that quantile. Every arriving label of an
    alert gives the error, the false share of the last ``window`` known alerts less the target, once
    ``least`` are known. ``P`` moves theta by gain * error; ``PI`` adds the sum of errors, which stops
    growing while theta is at a limit (anti-windup); ``AQT`` moves by gain * (false - target) per label.
    """

    def __init__(self, calibration: np.ndarray, target: float, kind: str = "P", start: float = 0.9, gain: float = 0.05, integral: float = 0.005, window: int = 200, least: int = 1) -> None:
        self.scores, self.target, self.kind, self.theta, self.gain, self.integral, self.window, self.least = np.sort(calibration), target, kind, start, gain, integral, window, least
        self.labels: list[int] = []
        self.total = 0.0

    @property
    def cut(self) -> float:
        return float(np.quantile(self.scores, self.theta)) if len(self.scores) else math.inf

    def learn(self, false: int) -> None:
        self.labels.append(false)
        if self.kind == "AQT":
            move = self.gain * (false - self.target)
        else:
            if len(self.labels) < self.least:
                return
            known = self.labels[-self.window :]
            error = sum(known) / len(known) - self.target
            move = self.gain * error
            if self.kind == "PI":
                whole = move + self.integral * (self.total + error)
                if 0.0 <= self.theta + whole <= 1.0:
                    self.total += error
                move += self.integral * self.total
        self.theta = min(1.0, max(0.0, self.theta + move))


def feedback(score: np.ndarray, malicious: np.ndarray, control: Threshold, lag: int) -> np.ndarray:
    """Alerts of a controller that learns an alert's label when ``lag`` more alerts have been raised."""
    fired, waiting = np.zeros(len(score), bool), deque()
    for i, (x, m) in enumerate(zip(score, malicious)):
        if x >= control.cut:
            fired[i] = True
            waiting.append(int(not m))
            if len(waiting) > lag:
                control.learn(waiting.popleft())
    return fired


def delayed_control(score: np.ndarray, ts: np.ndarray, malicious: np.ndarray, control: Threshold, delay: float) -> np.ndarray:
    """Alerts of a controller that learns an alert's label ``delay`` after it (in units of ts); decisions use labels that have arrived by then."""
    fired, waiting = np.zeros(len(score), bool), deque()
    for i, (x, at, m) in enumerate(zip(score, ts, malicious)):
        while waiting and waiting[0][0] <= at:
            control.learn(waiting.popleft()[1])
        if x >= control.cut:
            fired[i] = True
            waiting.append((at + delay, int(not m)))
    return fired


#: Procedures by name: (evidence, ceiling, gamma kind, alpha, w0) -> Outcome.
PROCEDURES: dict[str, Callable] = {
    "elond": lambda e, c, k, a, w: fold(Lond(gamma(k, len(e)), a), e, c),
    "lond_p": lambda e, c, k, a, w: fold(Lond(gamma(k, len(e)), a), e, c, as_p=True),
    "lordpp": lambda e, c, k, a, w: fold(LordPlusPlus(_padded(k, len(e)), a, w), e, c),
    "saffron": lambda e, c, k, a, w: fold(Saffron(_padded(k, len(e)), a, w), e, c, as_p=True),
    "addis": lambda e, c, k, a, w: fold(Addis(_padded(k, len(e)), a, w), e, c, as_p=True),
    "ebh": lambda e, c, k, a, w: online_ebh(e, c, gamma(k, len(e)), a),
    "elord": lambda e, c, k, a, w: fold(EGai(a, "lord"), e, c),
    "esaffron": lambda e, c, k, a, w: fold(EGai(a, "saffron"), e, c),
    "memlord": lambda e, c, k, a, w: fold(EGai(a, "mem-lord"), e, c),
    "donation_elond": lambda e, c, k, a, w: fold(DonationLond(_checked(e, c, k, a), a), e, c),
    "closed_elond": lambda e, c, k, a, w: fold(ClosedLond(_checked(e, c, k, a), a), e, c),
    "donation_ebh": lambda e, c, k, a, w: donation_ebh(e, c, gamma(k, len(e)), a),
    "etoad_arc": lambda e, c, k, a, w: etoad(e, c, gamma(k, len(e)), a, deadlines("arc", len(e))),
    "etoad_immediate": lambda e, c, k, a, w: etoad(e, c, gamma(k, len(e)), a, deadlines("immediate", len(e))),
}


def _checked(evidence: np.ndarray, ceiling: float, kind: str, alpha: float) -> np.ndarray:
    """The spending sequence, once the stream meets :func:`check_stream`."""
    g = gamma(kind, len(evidence))
    check_stream(evidence, g, alpha, ceiling)
    return g


def _padded(kind: str, n: int) -> np.ndarray:
    """One more entry than the stream is long; ages are clipped to it."""
    return np.append(gamma(kind, n), gamma(kind, n + 1, n)[-1])


def control(episodes: DataFrame, procedure: str | Callable, by: list[str] | None = None, kind: str = "poly", alpha: float = 0.05, w0: float = 0.025) -> DataFrame:
    """Run a procedure over each stream of ``episodes`` (columns ``pos`` from 1, ``ev``, ``ceiling``, and ``by``).

    Result: ``by``, ``pos``, ``level``, ``fired``, ``silent``. Null evidence counts as 0, rows with a null
    position are an error, as the order is part of the question. An empty stream has no rows.
    """
    run, keys = PROCEDURES[procedure] if isinstance(procedure, str) else procedure, list(by or [])
    e = episodes.select(*keys, "pos", F.coalesce("ev", F.lit(0.0)).cast("double").alias("ev"), F.col("ceiling").cast("double").alias("ceiling"))
    grouped = e.withColumn("__one", F.lit(0)) if not keys else e
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in e.select(*keys, "pos").schema)

    def stream(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["pos"].isna().any():
            raise ValueError("an episode has no position")
        pdf = pdf.sort_values("pos")
        out = run(pdf["ev"].to_numpy(), float(pdf["ceiling"].iloc[0]), kind, alpha, w0)
        return pdf[[*keys, "pos"]].assign(level=out.level, fired=out.fired, silent=out.silent)

    return grouped.groupBy(*(keys or ["__one"])).applyInPandas(stream, f"{types}, level double, fired boolean, silent boolean")


def elond_native(episodes: DataFrame, kind: str = "poly", alpha: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """e-LOND without Python: a fold in SQL over the episodes that have evidence, then levels from a running count.

    Episodes without evidence never reject, so only the others enter the fold. Result as of :func:`control`.
    """
    keys = list(by or [])
    e = episodes.select(*keys, "pos", "ev", "ceiling")
    e = e.withColumn("__n", F.count("*").over(W.partitionBy(*keys))) if keys else _sized(e, "__n")
    e = e.withColumn("__g", gamma_column(kind, F.col("pos"), F.col("__n")))
    held = e.where("ev > 0").groupBy(*(keys or [F.lit(0).alias("__one")])).agg(F.array_sort(F.collect_list(F.struct("pos", "ev", "ceiling", "__g"))).alias("a"))
    step = f"""aggregate(a, cast(array() as array<bigint>), (r, x) ->
      if({alpha}D * x.__g * (size(r) + 1) > 0 and x.ceiling >= 1D / ({alpha}D * x.__g * (size(r) + 1)) and x.ev >= 1D / ({alpha}D * x.__g * (size(r) + 1)), array_append(r, cast(x.pos as bigint)), r))"""
    fires = held.select(*keys, F.explode(F.expr(step)).alias("pos")).withColumn("__hit", F.lit(True))
    out = e.join(fires, [*keys, "pos"], "left").withColumn("fired", F.coalesce("__hit", F.lit(False)))
    return with_levels(out, kind, alpha, keys, F.col("__g")).select(*keys, "pos", "level", "fired", "silent")


def with_levels(fired: DataFrame, kind: str, alpha: float, by: list[str] | None = None, g=None) -> DataFrame:
    """The offered level of e-LOND at every position of a stream whose decisions are known, and ``tau`` = 1/level."""
    keys = list(by or [])
    hits = fired.withColumn("__f", F.col("fired").cast("long"))
    if keys:
        w = W.partitionBy(*keys).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
        counted = hits.withColumns({"__r": F.coalesce(F.sum("__f").over(w), F.lit(0)), "__t": F.count("*").over(W.partitionBy(*keys))})
    else:
        counted = _sized(running(hits, "pos", "__f", "__r"), "__t")
    g = g if g is not None else gamma_column(kind, F.col("pos"), F.col("__t"))
    return counted.withColumn("level", F.lit(alpha) * g * (F.col("__r") + 1)).drop("__f", "__r", "__t").withColumn("silent", (F.col("level") <= 0) | (F.col("ceiling") < 1.0 / F.col("level"))).withColumn("tau", F.try_divide(F.lit(1.0), F.col("level")))


def _sized(df: DataFrame, name: str) -> DataFrame:
    """Adds the number of rows."""
    return df.join(F.broadcast(df.agg(F.count("*").alias(name))))  # one row


def ebh_native(episodes: DataFrame, kind: str = "poly", alpha: float = 0.05) -> DataFrame:
    """The final online e-BH set in SQL windows: costs in rising order, the largest rank that its cost does not exceed."""
    c = _sized(episodes, "__n").withColumn("__c", F.when(F.col("ev") > 0, 1.0 / (F.lit(alpha) * gamma_column(kind, F.col("pos"), F.col("__n")) * F.col("ev"))))
    ranked = positions(c.where("__c is not null").select("__c", "pos"), ["__c", "pos"], "__r")
    k = ranked.agg(F.coalesce(F.max(F.when(F.col("__c") <= F.col("__r"), F.col("__r"))), F.lit(0)).alias("__k"))
    return c.join(F.broadcast(k)).select("pos", "ev", F.coalesce(F.col("__c") <= F.col("__k"), F.lit(False)).alias("fired"))  # one row


def restarted(episodes: DataFrame, procedure: str, kind: str = "poly", alpha: float = 0.05, w0: float = 0.025, allocation: str = "uniform", by: list[str] | None = None) -> DataFrame:
    """A fresh controller in every epoch (column ``epoch``), each with its part of alpha; epochs run in parallel.

    ``each``: alpha in every epoch; ``uniform``: alpha / number of epochs; ``geometric``: alpha 2^-(i+1) for the i-th.
    """
    keys = [*(by or []), "epoch"]
    w = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy("epoch")
    epochs = episodes.select(*keys).distinct().withColumn("__i", F.row_number().over(w)).withColumn("__m", F.count("*").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    part = {"each": F.lit(1.0), "uniform": 1.0 / F.col("__m"), "geometric": F.pow(F.lit(2.0), -F.col("__i"))}[allocation]
    e = episodes.join(epochs.select(*keys, part.alias("__a")), keys).select(*keys, F.row_number().over(W.partitionBy(*keys).orderBy("pos")).alias("pos"), F.col("pos").alias("stream_pos"), "ev", "ceiling", "__a")
    run = PROCEDURES[procedure]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in e.select(*keys, "stream_pos").schema)

    def epoch(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        a = alpha * float(pdf["__a"].iloc[0])
        out = run(pdf["ev"].to_numpy(dtype=float), float(pdf["ceiling"].iloc[0]), kind, a, w0 / alpha * a)
        return pdf[[*keys, "stream_pos"]].assign(level=out.level, fired=out.fired, silent=out.silent)

    return e.groupBy(*keys).applyInPandas(epoch, f"{types}, level double, fired boolean, silent boolean").withColumnRenamed("stream_pos", "pos")
