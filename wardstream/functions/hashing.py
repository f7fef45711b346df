"""64-bit key hashing as column expressions, without overflow under ANSI arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The finaliser's multipliers and the chain's start.
MULTIPLIERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
GOLDEN = 0x9E3779B97F4A7C15
_M16, _M32 = (1 << 16) - 1, (1 << 32) - 1


def signed(x: int) -> int:
    """An unsigned 64-bit number as the signed one of the same bits."""
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def let(x: Column, f) -> Column:
    """f(x) with x evaluated once; plain substitution would repeat it at every mention."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def times(a: Column, b: int) -> Column:
    """a * b modulo 2^64. Sixteen-bit limbs of a keep every partial product below 2^63."""
    return let(a, lambda x: _times(x, b))


def _times(a: Column, b: int) -> Column:
    lo, hi = b & _M32, b >> 32
    limb = [F.shiftrightunsigned(a, 16 * i).bitwiseAND(F.lit(_M16)) for i in range(4)]
    p = [x * F.lit(lo) for x in limb]
    low = p[0].bitwiseAND(F.lit(_M32)) + F.shiftleft(p[1].bitwiseAND(F.lit(_M16)), 16)
    high = F.shiftrightunsigned(p[0], 32) + F.shiftrightunsigned(p[1], 16) + p[2] + F.shiftleft(p[3].bitwiseAND(F.lit(_M16)), 16)
    high = high + limb[0] * F.lit(hi) + F.shiftleft((limb[1] * F.lit(hi)).bitwiseAND(F.lit(_M16)), 16) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high.bitwiseAND(F.lit(_M32)), 32).bitwiseOR(low.bitwiseAND(F.lit(_M32)))


def mix64(z: Column) -> Column:
    """The SplitMix64 finaliser of a long, as a long."""
    step = lambda x, shift, m: let(x, lambda y: times(y.bitwiseXOR(F.shiftrightunsigned(y, shift)), m))
    mixed = step(step(z, 30, MULTIPLIERS[0]), 27, MULTIPLIERS[1])
    return let(mixed, lambda y: y.bitwiseXOR(F.shiftrightunsigned(y, 31)))


def key_hash(keys: list[Column | str], seed: int = 0) -> Column:
    """Chained hash of long key columns: start at the golden ratio xor seed, fold in one key after the other."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return reduce(lambda h, k: mix64(h.bitwiseXOR(k.cast("long"))), cols, F.lit(signed(GOLDEN ^ seed)))


def h63(h: Column) -> Column:
    """The lower 63 bits, for an order that does not depend on a sign."""
    return h.bitwiseAND(F.lit((1 << 63) - 1))


def draw(*parts: Column | int | str) -> Column:
    """A random whole number below 2^52 that depends on the values alone (columns, or numbers), so other engines can draw the same; nulls are left out."""
    text = F.concat_ws("|", *[(F.lit(p) if isinstance(p, int) else F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def draw_sql(*parts: str) -> str:
    """The same as :func:`draw` in DuckDB's SQL."""
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13))::bigint"


def uniform(*parts: Column | int) -> Column:
    """A deterministic uniform number in [0, 1) of some values."""
    return draw(*parts) / F.lit(float(1 << 52))


def uniform_sql(*parts: str) -> str:
    """The same as :func:`uniform` in DuckDB's SQL."""
    return f"({draw_sql(*parts)} / 4503599627370496.0::double)"
