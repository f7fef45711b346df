"""Near-equal numeric records across splits: a cosine join over inverted lists of term-weight vectors.

A record of components x_1..x_m becomes a sparse unit vector. Each component lies on a logarithmic grid of
some cell width (shifted differently for each component); a value farther than half a ``band`` from the cell
borders has weight 1 on its cell, one inside the band is split between both neighbours as cos and sin of an
angle that runs from 0 to pi/2 across the band. Zero and each sign have cells of their own. A term is a
combination of one cell per component; its weight is the product of theirs, so that most records have one
to four terms, and the vector has norm 1.

Two values with |a - b| <= tol * max(|a|, |b|) have a logarithmic distance of at most -ln(1 - tol), hence
angles at most pi/2 * distance / band apart, so their overlap is at least the cosine c of that, and two
near-equal records have a dot product of at least t = c ** m. That makes the join complete: every
near-equal pair has cosine >= t.

Pruning, for x of one split and y of the other:

* residual norm: x enters only as many of its heaviest terms as leave a residual of norm at most rho < t.
  By Cauchy-Schwarz what x left out contributes at most rho to any dot product.
* maximum weight: every list knows the largest weight M that any x entered in it. Of its n terms y leaves
  out those with weight * M <= (t - rho) / n (lists that no x entered have M = 0), so all that y leaves out
  contributes less than t - rho.

Together what both left out is below t, so a pair with cosine >= t still shares a term that both entered.

Lists of any size take one path. A list is cut by the values of its components with the largest spread, as
many (at most three) as its size asks for: x goes to one slice of a component, y to the one or two within
the tolerance, so a near-equal pair meets in one slice. What is still long is dealt into chunks of about
``CHUNK`` records by a hash on both sides, and every chunk of one side meets every chunk of the other, so
no task gets more than about ``CHUNK`` ** 2 comparisons at once, and candidates exist only inside a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstream.runtime import stored

WIDTH, BAND = 0.8, 0.04
#: Records of one side of a list that are compared at once.
CHUNK = 2048
#: Width of a value slice of a long list, in tolerances.
SLICE = 4
#: Comparisons that are unfolded in memory at once.
SLAB = 2_000_000
_ZERO = 1 << 40


@dataclass(frozen=True)
class Grid:
    """Parameters of an index over ``m`` components."""

    m: int
    tol: float
    width: float = WIDTH
    band: float = BAND

    @property
    def threshold(self) -> float:
        return math.cos(math.pi / 2 * -math.log1p(-self.tol) / self.band) ** self.m - 1e-9

    @property
    def rho(self) -> float:
        return 0.95 * self.threshold

    @property
    def shift(self) -> np.ndarray:
        """Where each component's cells begin: spread evenly, so that equal values don't all meet a border."""
        return (0.37 + np.arange(self.m) * 0.6180339887498949) % 1.0

    @property
    def spare(self) -> float:
        """What one side may leave out beyond rho."""
        return 0.999 * (self.threshold - self.rho)


def _mix(z: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit codes of whole numbers (multiply and xor-shift, wrapping)."""
    z = z.astype(np.uint64)
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return z ^ (z >> np.uint64(29))


def place(x: np.ndarray, grid: Grid) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower cell, angle and whether a value is split, for an array [records, components]."""
    nz = x != 0
    p = np.log(np.where(nz, np.abs(x), 1.0)) / grid.width + grid.shift
    r = np.rint(p)
    d = (p - r) * grid.width
    split = nz & (np.abs(d) < grid.band / 2)
    low = np.where(split, r - 1, np.floor(p)).astype(np.int64) * 2 + (x < 0)
    return np.where(nz, low, _ZERO), np.where(split, (d / (grid.band / 2) + 1) * (math.pi / 4), 0.0), split


def terms(x: np.ndarray, grid: Grid) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Record number, term and weight of every term. A term is the wrapping sum of mixed (component, cell) codes."""
    low, angle, split = place(x, grid)
    step = np.arange(grid.m, dtype=np.uint64) << np.uint64(48)
    with np.errstate(over="ignore"):
        at = _mix(low.astype(np.uint64) + step)
        up = _mix((low + 2).astype(np.uint64) + step) - at
        ix, h, w = np.arange(len(x)), at.sum(axis=1, dtype=np.uint64), np.ones(len(x))
        for j in range(grid.m):
            k = split[ix, j]
            if k.any():
                jx, a = ix[k], angle[ix[k], j]
                h2, w2 = h[k] + up[jx, j], w[k] * np.sin(a)
                w[k] *= np.cos(a)
                ix, h, w = np.concatenate([ix, jx]), np.concatenate([h, h2]), np.concatenate([w, w2])
    return ix, h.view(np.int64), w


def _left_out(ix: np.ndarray, w: np.ndarray, cost: np.ndarray, most: float) -> np.ndarray:
    """Which terms a record can leave out, lightest first, for a sum of costs of at most ``most``."""
    order = np.lexsort((w, ix))
    i, c = ix[order], np.cumsum(cost[order])
    first = np.r_[True, i[1:] != i[:-1]]
    base = np.maximum.accumulate(np.where(first, np.r_[0.0, c[:-1]], 0.0))
    out = np.zeros(len(ix), bool)
    out[order] = c - base <= most
    return out


def index_rows(x: np.ndarray, grid: Grid, residual: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Record number, term, weight and number of the record's terms: after residual-norm pruning, or after maximum-weight pruning for lists of the largest weight there is (1)."""
    ix, h, w = terms(x, grid)
    n = np.bincount(ix, minlength=len(x))[ix]
    keep = ~_left_out(ix, w, w * w, grid.rho**2) if residual and len(ix) else w > grid.spare / np.maximum(n, 1)
    return ix[keep], h[keep], w[keep], n[keep]


def dot(a: np.ndarray, b: np.ndarray, grid: Grid) -> np.ndarray:
    """Exact cosine of two arrays of records: over all shared terms, the product over components of their overlaps."""
    (la, ta, _), (lb, tb, _) = place(a, grid), place(b, grid)
    each = np.where(la == lb, np.cos(ta - tb), np.where(la == lb + 2, np.cos(ta) * np.sin(tb), np.where(lb == la + 2, np.cos(tb) * np.sin(ta), 0.0)))
    return each.prod(axis=1)


def _matrix(col: pa.Array, m: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, m)


def _postings(records: DataFrame, grid: Grid) -> DataFrame:
    """Inverted lists: ``term, left, k1, k2, w, n`` from ``k1, k2, x, left``; copies within a batch are entered once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3).to_numpy(zero_copy_only=False).astype(np.int64)])
            order = np.lexsort(k)
            new = np.r_[True, (k[:, order[1:]] != k[:, order[:-1]]).any(axis=0)] if len(order) else np.zeros(0, bool)
            once = order[new]
            x = _matrix(b.column(2), grid.m)
            for left in (True, False):
                rows = once[k[2, once] == left]
                ix, h, w, n = index_rows(x[rows], grid, residual=left)
                ix = rows[ix]
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(ix), left)), pa.array(k[0, ix]), pa.array(k[1, ix]), pa.array(w), pa.array(n.astype(np.int32))], names=["term", "left", "k1", "k2", "w", "n"])

    return records.select("k1", "k2", "x", "left").mapInArrow(run, "term long, left boolean, k1 long, k2 long, w double, n int")


def _entered(postings: DataFrame, grid: Grid) -> DataFrame:
    """The postings ``term, left, k1, k2`` of lists that both sides entered, after maximum-weight pruning, each once.

    The lists' largest weights are combined map-side; the join with them may be skewed on a term, which
    adaptive execution splits.
    """
    heads = postings.groupBy("term").agg(F.max(F.when(F.col("left"), F.col("w"))).alias("m"), F.bool_or(~F.col("left")).alias("r")).where("m is not null and r")
    kept = postings.join(heads.select("term", "m"), "term").where(F.col("left") | (F.col("w") * F.col("m") > F.lit(grid.spare) / F.col("n")))
    return kept.select("term", "left", "k1", "k2").distinct()


def _log(x: Column) -> Column:
    return F.when(x == 0, F.lit(0.0)).otherwise(F.ln(F.abs(x.cast("double"))))


def _cut(lists: DataFrame, m: int, tol: float, chunk: int) -> DataFrame:
    """Sub-lists ``sub, left, k1, k2, x``: a list that would give more than ``chunk`` ** 2 comparisons is sliced by its most spread components."""
    spread = lambda j: F.max(_log(F.get("x", F.lit(j)))) - F.min(_log(F.get("x", F.lit(j))))
    sizes = lists.groupBy("term").agg(F.count_if("left").alias("l"), F.count_if(~F.col("left")).alias("r"), F.array(*[F.struct((-spread(j)).alias("s"), F.lit(j).alias("j")) for j in range(m)]).alias("spread"))
    near = -math.log1p(-tol) * (1 + 1e-6) + 1e-9
    excess = F.log10(F.col("l").cast("double") * F.col("r") / float(chunk) ** 2)
    n_cuts = F.greatest(F.lit(0), F.least(F.lit(3), F.ceil(excess / 2))).cast("int")
    wide = F.filter(F.array_sort("spread"), lambda c: c["s"] < -2 * SLICE * near)
    cuts = sizes.where("l > 0 and r > 0").select("term", F.slice(F.transform(wide, lambda c: c["j"]), F.lit(1), n_cuts).alias("cuts"))
    width = SLICE * near
    value = "if(get(x, j) = 0, 0D, ln(abs(cast(get(x, j) as double))))"
    reach = f"if(left, 0D, {near!r}D)"
    cells = f"sequence(cast(floor(({value} - {reach}) / {width!r}D) as bigint), cast(floor(({value} + {reach}) / {width!r}D) as bigint))"
    subs = f"aggregate(cuts, array(term), (acc, j) -> flatten(transform(acc, h -> transform({cells}, c -> xxhash64(h, j, c)))))"
    return lists.join(cuts, "term").select(F.explode(F.expr(subs)).alias("sub"), "left", "k1", "k2", "x")


def _dealt(subs: DataFrame, chunk: int) -> DataFrame:
    """Every record with each ``cell`` in which it meets the other side: one for a short list, else one per chunk of the other side."""
    sizes = subs.groupBy("sub").agg(F.count_if("left").alias("l"), F.count_if(~F.col("left")).alias("r")).where("l > 0 and r > 0")
    n = lambda c: F.ceil(F.col(c) / F.lit(chunk))
    sizes = sizes.select("sub", n("l").alias("nl"), n("r").alias("nr"))
    own = F.pmod(F.xxhash64("k1", "k2"), F.when(F.col("left"), F.col("nl")).otherwise(F.col("nr")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("left"), F.col("nr")).otherwise(F.col("nl")) - 1))
    d = subs.join(sizes, "sub").select("sub", "left", "k1", "k2", "x", own.alias("own"), other.alias("other"))
    at = F.when(F.col("left"), F.xxhash64("sub", "own", "other")).otherwise(F.xxhash64("sub", "other", "own"))
    return d.select(at.alias("cell"), "left", "k1", "k2", "x")


def compare(cell: np.ndarray, left: np.ndarray, x: np.ndarray, grid: Grid) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers and exact cosines of the near-equal pairs inside cells; rows are in order of cell, left ones first."""
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
    n_left = np.add.reduceat(left.astype(np.int64), starts) if len(starts) else starts
    n_right = np.diff(np.r_[starts, len(cell)]) - n_left
    ends = np.cumsum(n_left * n_right)
    total, at = int(ends[-1]) if len(ends) else 0, 0
    while at < total:
        p = np.arange(at, min(at + SLAB, total))
        at += len(p)
        g = np.searchsorted(ends, p, side="right")
        p -= np.r_[0, ends[:-1]][g]
        a = starts[g] + p // n_right[g]
        b = starts[g] + n_left[g] + p % n_right[g]
        for j in range(grid.m):
            u, v = x[a, j], x[b, j]
            ok = np.abs(u - v) <= grid.tol * np.maximum(np.abs(u), np.abs(v))
            a, b = a[ok], b[ok]
            if not len(a):
                break
        if len(a):
            c = dot(x[a], x[b], grid)
            ok = c >= grid.threshold
            yield a[ok], b[ok], c[ok]


def _pairs(cells: DataFrame, grid: Grid) -> DataFrame:
    """Near-equal pairs ``a1, a2, b1, b2, cosine`` of records in one cell."""
    names = ["a1", "a2", "b1", "b2", "cosine"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
            if not t.num_rows:
                return
            t = t.combine_chunks()
            k1, k2 = t["k1"].to_numpy(), t["k2"].to_numpy()
            for a, b, c in compare(t["cell"].to_numpy(), t["left"].to_numpy(), _matrix(t["x"].chunk(0), grid.m), grid):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (k1[a], k2[a], k1[b], k2[b], c)], names=names)

        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            cell = t["cell"].to_numpy()
            cut = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0  # the last cell may go on in the next batch
            yield from found(t.slice(0, cut))
            rest = t.slice(cut).combine_chunks()
        if rest is not None:
            yield from found(rest)

    placed = cells.repartition("cell").sortWithinPartitions("cell", F.desc("left"))
    return placed.mapInArrow(run, "a1 long, a2 long, b1 long, b2 long, cosine double")


def near_pairs(records: DataFrame, m: int, tol: float, chunk: int = CHUNK) -> DataFrame:
    """All pairs of distinct left and right records that are near-equal in all ``m`` components.

    ``records``: ``k1, k2`` (a key of the values), ``x`` (array of m finite numbers), ``left`` (side), any
    number of copies. Result: ``a1, a2`` (left key), ``b1, b2`` (right key), ``cosine``, each pair of
    distinct vectors once; a vector on both sides pairs with itself. An empty side gives no rows. Lists and
    pairs are tables in the shared folder, so none is computed twice and lost executors cost little; only
    records of lists that both sides entered are read again for their values.
    """
    grid = Grid(m, tol)
    entered = stored(_entered(stored(_postings(records, grid), "postings"), grid), "entered")
    x = records.select("k1", "k2", "x").join(entered.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("x").alias("x"))
    lists = stored(entered.join(x, ["k1", "k2"]), "lists")
    subs = stored(_cut(lists, m, tol, chunk), "sublists")
    found = _pairs(_dealt(subs, chunk), grid)
    return stored(found.groupBy("a1", "a2", "b1", "b2").agg(F.first("cosine").alias("cosine")), "pairs")


def pair_keys(pairs: DataFrame) -> DataFrame:
    """The distinct keys ``k1, k2`` in pairs."""
    return pairs.select(F.inline(F.array(*[F.struct(F.col(f"{s}1").alias("k1"), F.col(f"{s}2").alias("k2")) for s in "ab"]))).distinct()
