"""Column expressions: host normal form, cleaned numbers, event types, row identity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(c: Column | str) -> Column:
    """Normal form of an address: no surrounding blanks or tabs, lower case, no leading ``::ffff:``.

    Null stays null, and so does what is empty in normal form (it names no host).
    """
    c = F.col(c) if isinstance(c, str) else c
    low = F.lower(F.btrim(c, F.lit(" \t")))
    bare = F.when(low.startswith("::ffff:"), F.substr(low, F.lit(8))).otherwise(low)
    return F.nullif(bare, F.lit(""))


def host_sql(c: str) -> str:
    """The same as :func:`host` in DuckDB's SQL."""
    low = f"lower(trim({c}, ' ' || chr(9)))"
    return f"nullif(case when {low} like '::ffff:%' then substr({low}, 8) else {low} end, '')"


def finite(c: Column | str, kind: str = "double") -> Column:
    """Null, NaN and ±Inf are 0, and −0 is 0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.abs(c) < F.lit(float("inf")), c + F.lit(0).cast(kind)).otherwise(F.lit(0)).cast(kind)


def event_type(conn: Column | str, service: Column | str) -> Column:
    """``CONN/SERVICE``, trimmed and in upper case, ``-`` for null or empty parts."""

    def part(c: Column | str) -> Column:
        c = F.col(c) if isinstance(c, str) else c
        return F.coalesce(F.nullif(F.upper(F.trim(c)), F.lit("")), F.lit("-"))

    return F.concat_ws("/", part(conn), part(service))


def row_key(columns: list[str], seed: int = 0) -> Column:
    """A 64-bit key of a row's values. Nulls count by place, which the built-in hash alone leaves out."""
    nulls = reduce(lambda a, b: a + b, (F.when(F.col(c).isNull(), F.lit(1 << (i % 62))).otherwise(F.lit(0)) for i, c in enumerate(columns)), F.lit(0).cast("long"))
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in columns], nulls)


def prefix24(ip: Column | str) -> Column:
    """The first three parts of a dotted address; other texts as they are."""
    ip = F.col(ip) if isinstance(ip, str) else ip
    return F.when(F.size(F.split(ip, r"\.")) == 4, F.substring_index(ip, ".", 3)).otherwise(ip)


def micros(df, column: str) -> Column:
    """Whole µs since the epoch of a timestamp column; one without a zone is taken as UTC."""
    if dict(df.dtypes)[column] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{column}`)")
    return F.unix_micros(F.col(column).cast("timestamp"))
