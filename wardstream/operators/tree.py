"""Aggregation of skewed keys through a tree of bounded fan-in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstream.operators.sessions import by_side

FAN_IN = 16
CHUNK_ROWS = 65_536


def row_chunk(chunk_rows: int = CHUNK_ROWS) -> Column:
    """The chunk a row lies in: ``chunk_rows`` neighbouring rows of one input partition."""
    return F.floor(F.monotonically_increasing_id() / F.lit(chunk_rows))


def widths(rows: int, fan_in: int = FAN_IN, chunk_rows: int = CHUNK_ROWS) -> list[int]:
    """Nodes per round of a tree over so many rows, down to one; there are always at least two rounds."""
    n, out = max(-(-rows // chunk_rows), fan_in + 1), []
    while n > 1:
        n = -(-n // fan_in)
        out.append(n)
    return out


def tree_aggregate(df: DataFrame, keys: list[str], first: dict[str, Column], merge: dict, rows: int, chunk: Column | None = None, fan_in: int = FAN_IN, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Mergeable aggregates per key through rounds of bounded fan-in.

    ``first`` maps a state's name to the aggregate over raw rows, ``merge`` the same name to a function
    (column name -> aggregate over states); ``rows`` is the number of rows or a bound of it. Input chunks
    hold a fixed number of rows (``chunk``, by default neighbours in one partition) and are combined where
    they lie. Round 1 merges the states of about ``fan_in`` chunks per node (a hash deals chunks to nodes),
    every later round those of exactly ``fan_in`` nodes, until one node is left: ceil(log_fan_in(chunks))
    rounds, at least two at any size. A node's number is data, not the number of a physical partition, so
    neither adaptive execution nor a repeated task changes it. However many rows a key has, no merge
    receives more than its fan-in of that key's states.

    Keys may be null (a group of their own). An empty input gives an empty result.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    level, agg = df.withColumn("__chunk", chunk if chunk is not None else row_chunk(chunk_rows)), [c.alias(s) for s, c in first.items()]
    for i, n in enumerate(widths(rows, fan_in, chunk_rows)):
        node = F.pmod(F.xxhash64("__chunk"), F.lit(n)) if i == 0 else F.floor(F.col("__node") / fan_in)
        group = [*keys, "__node"] if n > 1 else keys
        level = (level.withColumn("__node", node) if n > 1 else level).groupBy(*group).agg(*agg)
        agg = [merge[s](s).alias(s) for s in first]
    return level


def host_profile(flows: DataFrame, fan_in: int = FAN_IN, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Flows, distinct peers, first and last ``ts`` of every host on each side.

    Columns ``side, host, n_flows, n_peers, first_us, last_us``. Every row counts, repeated deliveries
    too; null peers are no peer; a ``ts`` of null or 0 counts as a flow without a time. Null hosts have
    no row. Distinct peers are exact: a first tree keeps states per (side, host, peer), so a hot pair is
    merged in rounds; a second tree takes hosts from pairs, whose chunks are dealt by peer, so a host with
    very many peers is merged in rounds as well.
    """
    n = 2 * flows.count()  # from the footers of Parquet files
    valid = F.when(F.col("ts") != 0, F.col("ts"))
    f = by_side(flows.withColumns({"__ts": valid, "__at": row_chunk(chunk_rows)}), "__ts", "__at").where("host is not null")
    merge = {"__n": F.sum, "__a": F.min, "__b": F.max}
    pairs = tree_aggregate(f, ["side", "host", "peer"], {"__n": F.count("*"), "__a": F.min("__ts"), "__b": F.max("__ts")}, merge, n, F.col("__at"), fan_in, chunk_rows)
    per_chunk = F.pmod(F.xxhash64("peer"), F.lit(max(-(-n // chunk_rows), fan_in + 1)))
    hosts = tree_aggregate(pairs, ["side", "host"], {"__n": F.sum("__n"), "__p": F.count("peer"), "__a": F.min("__a"), "__b": F.max("__b")}, merge | {"__p": F.sum}, n, per_chunk, fan_in, chunk_rows)
    return hosts.select("side", "host", F.col("__n").alias("n_flows"), F.col("__p").alias("n_peers"), F.col("__a").alias("first_us"), F.col("__b").alias("last_us"))


def heavy_hosts(flows: DataFrame, share: float = 0.02, fan_in: int = FAN_IN, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The hosts of :func:`host_profile` with at least ``share`` of all rows of ``flows``, and that share."""
    total = flows.agg(F.count("*").alias("__all")).select(F.explode(F.array(F.lit("src"), F.lit("dst"))).alias("side"), "__all")
    h = host_profile(flows, fan_in, chunk_rows).join(F.broadcast(total), "side")  # two rows
    return h.where(F.col("n_flows") >= F.lit(share) * F.col("__all")).select("side", "host", "n_flows", "n_peers", (F.col("n_flows") / F.col("__all")).alias("share"))
