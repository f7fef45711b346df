"""Detectors: anything that adds a ``score`` column. Gradient-boosted trees and an isolation forest.

Both are fitted in tasks and come to the driver as trees only; scoring is one Arrow-batched pass over all rows.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstream.functions.columns import finite
from wardstream.functions.special import harmonic
from wardstream.operators.hostfeatures import host_features, pad_contexts
from wardstream.operators.order_stats import medians, percentiles
from wardstream.runtime import stored
from wardstream.schema import FEATURES

BINS = 255
#: Labelled rows that a boosted detector is fitted on, about; with fewer, all of them.
FIT_ROWS = 100_000


def _vector(columns: list[str]):
    return F.array(*[finite(c) for c in columns])


def _rows(col: pa.Array, m: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, m)


class Histograms:
    """Boosted trees on binned features: second-order steps of the logistic loss, best leaf first."""

    def __init__(self, iterations: int, step: float, leaf: int, l2: float, leaves: int) -> None:
        self.iterations, self.step, self.leaf, self.l2, self.leaves = iterations, step, leaf, l2, leaves
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, ...]] = []
        self.base = 0.0

    def bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Histograms:
        if not len(x) or y.min() == y.max():
            self.base = 0.0 if not len(x) else math.copysign(30.0, y[0] - 0.5)
            return self
        for j in range(x.shape[1]):
            v = np.unique(x[:, j])
            self.edges.append((v[:-1] + v[1:]) / 2 if len(v) <= BINS else np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)))
        b = self.bin(x)
        p = y.mean()
        self.base = math.log(p / (1 - p))
        raw = np.full(len(x), self.base)
        offset = (np.arange(b.shape[1]) * (BINS + 1)).astype(np.intp)
        for _ in range(self.iterations):
            q = 1.0 / (1.0 + np.exp(-raw))
            tree, where = self._grow(b, offset, q - y, q * (1 - q))
            self.trees.append(tree)
            raw += tree[4][where]
        return self

    def _sums(self, b: np.ndarray, offset: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Gradient, curvature and count per feature and bin."""
        m = len(offset)
        code = (b[rows] + offset).ravel()
        of = lambda w: np.bincount(code, w, m * (BINS + 1)).reshape(m, BINS + 1)
        return np.stack([of(np.repeat(g[rows], m)), of(np.repeat(h[rows], m)), of(None)])

    def _split(self, sums: np.ndarray) -> tuple[float, int, int]:
        """Gain, feature and bin (its rows and lower ones go left) of the best split; gain 0 if none is allowed."""
        left = np.cumsum(sums, axis=2)[:, :, :-1]
        total = sums.sum(axis=2)[:, :, None]
        right = total - left
        worth = lambda s: s[0] ** 2 / (s[1] + self.l2)
        gain = np.where((left[2] >= self.leaf) & (right[2] >= self.leaf), worth(left) + worth(right) - worth(total), 0.0)
        at = int(gain.argmax())
        return float(gain.flat[at]), *divmod(at, gain.shape[1])

    def _grow(self, b: np.ndarray, offset: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        """A tree as feature (-1 in a leaf), bin, left, right, value; and the leaf of every row."""
        nodes: list[list] = []
        where = np.zeros(len(b), dtype=np.int32)
        queue: list = []

        def add(rows: np.ndarray, sums: np.ndarray) -> int:
            at = len(nodes)
            total = sums[:, 0].sum(axis=1)
            nodes.append([-1, 0, -1, -1, -self.step * total[0] / (total[1] + self.l2)])
            where[rows] = at
            gain, f, cut = self._split(sums)
            if gain > 1e-12:
                heapq.heappush(queue, (-gain, at, f, cut, rows, sums))
            return at

        everything = np.arange(len(b))
        add(everything, self._sums(b, offset, g, h, everything))
        leaves = 1
        while queue and leaves < self.leaves:
            _, at, f, cut, rows, sums = heapq.heappop(queue)
            low = b[rows, f] <= cut
            left, right = rows[low], rows[~low]
            small = left if len(left) <= len(right) else right
            part = self._sums(b, offset, g, h, small)
            rest = sums - part  # the larger side is what is left over
            nodes[at][:2] = [f, cut]
            nodes[at][2] = add(left, part if small is left else rest)
            nodes[at][3] = add(right, rest if small is left else part)
            leaves += 1
        f, cut, left, right, value = zip(*nodes)
        return (np.array(f, np.int16), np.array(cut, np.uint8), np.array(left, np.int32), np.array(right, np.int32), np.array(value)), where

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not self.trees or not len(x):
            return out
        b = self.bin(x)
        for f, cut, left, right, value in self.trees:
            at, live = np.zeros(len(x), dtype=np.int32), np.arange(len(x))
            while len(live):
                live = live[f[at[live]] >= 0]
                n = at[live]
                at[live] = np.where(b[live, f[n]] <= cut[n], left[n], right[n])
            out += value[at]
        return out

    def kept(self) -> list[tuple[np.ndarray, dict[int, np.ndarray], np.ndarray]]:
        """Every tree as bits, one for a leaf, in words of 64: all leaves; those that each bin of a feature keeps, for the features it cuts; and the leaves' values, 0 behind each word."""
        out = []
        for f, cut, left, right, value in self.trees:
            leaves, inner = np.flatnonzero(f < 0), np.flatnonzero(f >= 0)
            word, bit = np.divmod(np.arange(len(leaves)), 64)
            below = np.zeros((len(f), word[-1] + 1), np.uint64)
            below[leaves, word] = np.uint64(1) << bit.astype(np.uint64)
            for at in inner[::-1]:  # children come after their parent
                below[at] = below[left[at]] | below[right[at]]
            bits: dict[int, np.ndarray] = {}
            for at in inner:
                k, past = bits.setdefault(int(f[at]), np.repeat(below[0][:, None], BINS + 1, axis=1)), int(cut[at]) + 1
                k[:, :past] &= ~below[right[at]][:, None]
                k[:, past:] &= ~below[left[at]][:, None]
            values = np.zeros((word[-1] + 1, 65))
            values[word, bit] = value[leaves]
            out.append((below[0], bits, values))
        return out

    def replaced(self, x: np.ndarray, fixed: list[tuple[int, float]], kept: list | None = None) -> np.ndarray:
        """The margins with one feature set to a value, a row of results for every (feature, value): what all features keep of a tree is one leaf."""
        out = np.full((len(fixed), len(x)), self.base)
        if not self.trees or not len(x):
            return out
        b = np.ascontiguousarray(self.bin(x).T).astype(np.intp)
        to = [int(np.searchsorted(self.edges[j], v, side="left")) for j, v in fixed]
        places = {j for j, _ in fixed}
        for root, bits, values in kept or self.kept():
            for w in range(len(root)):
                rest = np.full(len(x), root[w])
                for j in bits.keys() - places:
                    rest &= bits[j][w][b[j]]
                own = {j: bits[j][w][b[j]] for j in bits.keys() & places}
                for i, (j, _) in enumerate(fixed):
                    m = rest & bits[j][w][to[i]] if j in own else rest.copy()
                    for k in own.keys() - {j}:
                        m &= own[k]
                    out[i] += values[w][np.bitwise_count(m - np.uint64(1))]  # the place of the one bit; 64 without any
        return out


class Boosted:
    """Gradient boosting; the score is the raw margin. Rows without a label don't train.

    Fitted in one task on about ``rows`` labelled rows drawn at random (all, if there are no more): 200
    rounds, step 0.1, L2 penalty 1 and leaves of at least 200 rows by default. Null, NaN and infinite
    features count as 0. With no row or one class every score is the same.
    """

    def __init__(self, columns: list[str] = FEATURES, iterations: int = 200, step: float = 0.1, leaf: int = 200, l2: float = 1.0, leaves: int = 31, rows: int = FIT_ROWS, seed: int = 0) -> None:
        self.columns, self.seed, self.rows = columns, seed, rows
        self.settings = {"iterations": iterations, "step": step, "leaf": leaf, "l2": l2, "leaves": leaves}
        self.model = Histograms(**self.settings)

    def fit(self, train: DataFrame) -> Boosted:
        t = train.where("label is not null").select(_vector(self.columns).alias("x"), F.col("label").cast("double").alias("y"))
        n, m, settings = t.count(), len(self.columns), self.settings
        t = t if n <= self.rows else t.where(F.rand(self.seed) < self.rows / n)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [(_rows(b.column(0), m), b.column(1).to_numpy()) for b in batches]
            x, y = (np.concatenate([p[i] for p in parts]) for i in (0, 1)) if parts else (np.zeros((0, m)), np.zeros(0))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Histograms(**settings).fit(x, y))], pa.binary())], names=["model"])

        got = t.repartition(1).mapInArrow(run, "model binary").first()
        if got:
            self.model = pickle.loads(got[0])
        return self

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        shared, m = df.sparkSession.sparkContext.broadcast(self.model), len(self.columns)  # trees of at most ``leaves`` leaves

        @F.pandas_udf("double")
        def margin(xs: pd.Series) -> pd.Series:
            return pd.Series(shared.value.margin(np.stack(xs.to_numpy()) if len(xs) else np.zeros((0, m))))

        return df.withColumn(name, margin(_vector(self.columns)))


def transfer(columns: list[str], seed: int = 0) -> Boosted:
    """The settings for small foreign data sets: 300 iterations, leaves of 20."""
    return Boosted(columns, 300, leaf=20, seed=seed)


class Isolation:
    """Isolation forest; the score is minus the usual one, so larger is odder. Every tree has a random sample of about ``sample`` rows of its own.

    Each row joins each tree's sample with the same chance, where it lies; a tree grows in one task from its
    sample alone, so what is shuffled is trees * sample rows and what reaches the driver is trees.
    """

    def __init__(self, columns: list[str] = FEATURES, trees: int = 200, sample: int = 8192, seed: int = 0) -> None:
        self.columns, self.trees, self.sample, self.seed, self.forest, self.size = columns, trees, sample, seed, [], 0

    def fit(self, train: DataFrame) -> Isolation:
        t = train.select(_vector(self.columns).alias("x"))
        n, m, trees, seed = t.count(), len(self.columns), self.trees, self.seed
        if not n:
            return self
        chance = min(1.0, self.sample / n)
        self.size = min(self.sample, n)
        deep = math.ceil(math.log2(max(self.size, 2)))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
            for b in batches:
                row = np.repeat(np.arange(b.num_rows), rng.binomial(trees, chance, b.num_rows))
                first = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
                start = np.flatnonzero(first)
                tree = np.concatenate([rng.choice(trees, k, replace=False) for k in np.diff(np.r_[start, len(row)])]) if len(row) else row
                yield pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), b.column(0).take(pa.array(row))], names=["tree", "x"])

        def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            nodes = self._grow(np.stack(pdf["x"].to_numpy()), np.random.default_rng([seed, 1, int(key[0])]), deep)
            return pd.DataFrame({"tree": [int(key[0])], "nodes": [pickle.dumps([v.astype(d) for v, d in zip(nodes, ("i2", "f4", "i4", "i4", "f4"))])]})

        grown = t.mapInArrow(deal, "tree int, x array<double>").groupBy("tree").applyInPandas(grow, "tree int, nodes binary").collect()  # one row per tree
        self.forest = [pickle.loads(r.nodes) for r in sorted(grown, key=lambda r: r.tree)]
        return self

    def _grow(self, x: np.ndarray, rng, deep: int) -> list:
        """A tree as rows (column, cut, left, right, path length of a leaf)."""
        nodes: list = []

        def make(part: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append(None)
            lo, hi = (part.min(0), part.max(0)) if len(part) else (None, None)
            free = np.flatnonzero(lo < hi) if len(part) else np.array([], int)
            if depth >= deep or len(part) <= 1 or not free.size:
                nodes[at] = (-1, 0.0, -1, -1, depth + _usual(len(part)))
                return at
            c = int(rng.choice(free))
            cut = rng.uniform(lo[c], hi[c])
            left = part[:, c] < cut
            a, b = make(part[left], depth + 1), make(part[~left], depth + 1)
            nodes[at] = (c, cut, a, b, 0.0)
            return at

        make(x, 0)
        return [np.array(v) for v in zip(*nodes)]

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((self.forest, self.size))  # trees of at most 2 * sample nodes

        @F.pandas_udf("double")
        def odd(xs: Iterator[pd.Series]) -> Iterator[pd.Series]:
            forest, size = shared.value
            for s in xs:
                x = np.stack(s.to_numpy()).astype(np.float32) if len(s) else np.zeros((0, 1), np.float32)
                total = np.zeros(len(x))
                for column, cut, left, right, path in forest:
                    at = np.zeros(len(x), dtype=int)
                    while (live := column[at] >= 0).any():
                        i = np.flatnonzero(live)
                        n = at[i]
                        at[i] = np.where(x[i, column[n]] < cut[n], left[n], right[n])
                    total += path[at]
                yield pd.Series(2.0 ** (-total / max(1, len(forest)) / max(_usual(size), 1e-9)))

        return df.withColumn(name, odd(_vector(self.columns)))


def _usual(n: int) -> float:
    """Mean path length of an unsuccessful search among n."""
    return 0.0 if n <= 1 else 2.0 * harmonic(n - 1) - 2.0 * (n - 1) / n


HOST_COLUMNS = ["src_cnt", "src_peers", "src_fail", "dst_cnt", "dst_peers", "dst_fail"]


def host_conditioned(flows: DataFrame, failed, train: str, seed: int = 0, **settings) -> tuple[Boosted, DataFrame]:
    """A detector on the flow's features and the six causal host features, fitted where ``train`` (SQL) holds; and the flows with both.

    ``flows`` needs ``ts, src, dst, ingest_id`` (unique), ``label`` and the features; ``failed`` marks failed connections.
    The host features are worked out once, without the other columns, and the flows with them are stored.
    """
    links = stored(flows.select("ts", "src", "dst", "ingest_id", failed.alias("__failed")), "links")
    hosts = host_features(links, F.col("__failed")).select("ingest_id", *HOST_COLUMNS)
    wide = stored(flows.join(hosts, "ingest_id", "left"), "flows")
    return Boosted([*FEATURES, *HOST_COLUMNS], seed=seed, **settings).fit(wide.where(train)), wide


def leave_one_out(tables: dict[str, DataFrame], make, columns: list[str], at_once: int = 4) -> DataFrame:
    """Every organisation scored by a detector that never saw it: rows with ``org, label, score, ingest_id``. ``at_once`` detectors are fitted side by side."""

    def scored(org: str) -> DataFrame:
        train = reduce(DataFrame.unionByName, [t.select("label", *columns) for o, t in tables.items() if o != org])
        return make(columns).fit(train).score(tables[org]).select(F.lit(org).alias("org"), "label", "score", "ingest_id")

    with ThreadPoolExecutor(at_once) as pool:
        return reduce(DataFrame.unionByName, pool.map(scored, tables))


def ablated(model: Boosted, train: DataFrame, test: DataFrame, column: str, name: str = "ablated") -> DataFrame:
    """Scores with one feature set to its median among benign training rows."""
    med = percentiles(train.where("label = 0"), column, [0.5])[0]
    kept = test.withColumn("__keep", F.col(column)).withColumn(column, F.lit(med).cast(dict(test.dtypes)[column]))
    return model.score(kept, name).withColumn(column, F.col("__keep")).drop("__keep")


def ablations(model: Boosted, train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """Scores with each of ``columns`` in turn set to its median among benign training rows: ``column`` (its place in ``columns``), ``label, ablated``. One pass over each table."""
    fixed = [(model.columns.index(c), 0.0 if m is None or not math.isfinite(m) else m) for c, m in zip(columns, medians(train.where("label = 0"), columns))]
    shared, m = test.sparkSession.sparkContext.broadcast(model.model), len(model.columns)  # trees of at most ``leaves`` leaves

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = shared.value.kept()
        for b in batches:
            scores = shared.value.replaced(_rows(b.column(0), m), fixed, kept)
            for i, s in enumerate(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), i, np.int32)), b.column(1), pa.array(s)], names=["column", "label", "ablated"])

    return test.select(_vector(model.columns).alias("x"), F.col("label").cast("int").alias("label")).mapInArrow(run, "column int, label int, ablated double")


def pad_fire_rate(model: Boosted, pads: DataFrame, state: DataFrame, count: int, kth: float, known_pair: bool = True) -> DataFrame:
    """Share of pads over the threshold when appended as the k-th to a host pair in a given state: ``k, rate``."""
    ctx = pad_contexts(state, count, known_pair)
    drop = [c for c in ctx.columns if c in pads.columns]
    grafted = pads.drop(*drop).join(F.broadcast(ctx))  # at most ``count`` rows
    return model.score(grafted).groupBy("k").agg(F.avg((F.col("score") > kth).cast("double")).alias("rate"))
