"""The planted-signal stream on ``events`` that the controllers run on, in Spark and as SQL.

A flow is an event: src = user_id % 20, dst = event_type, label = (event_type = 'error'), score = value
plus 1000 for a planted part of the errors. Calibration is (0.15 n, 0.55 n] of the positions, deployment
the 0.15 n after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstream.functions.columns import finite, micros
from wardstream.functions.hashing import draw, draw_sql
from wardstream.functions.special import zeta
from wardstream.operators import episodes, evidence
from wardstream.operators.ingest import positional_split
from wardstream.runtime import materialise, stored, table

KEYS = ["src", "dst"]


def events_flows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    bad = F.col("event_type") == "error"
    planted = bad & (F.col("user_id") % 4 != 0) & (k % 3 != 0)
    return e.select(
        F.col("event_id").alias("ingest_id"), micros(e, "ts").alias("ts"), (F.col("user_id") % 20).alias("src"), F.col("event_type").alias("dst"), bad.cast("int").alias("label"), k.alias("dport"),
        "value", "user_id", (F.col("value") + F.when(planted, 1000.0).otherwise(0.0)).alias("score"),
    )


def split_events(spark: SparkSession, d: str, cal: float = 0.40, pos: float = 0.55, test: float = 0.15) -> DataFrame:
    """Flows of events with their ``split``."""
    f = events_flows(spark, d)
    n = f.count()
    i2 = int(pos * n)
    return positional_split(f, (i2 - int(cal * n), i2, min(n, i2 + int(test * n))))


def evident(spark: SparkSession, d: str, k: int = 1) -> DataFrame:
    """Deployment flows with evidence ``e`` and ``ceiling``."""
    s = split_events(spark, d)
    return evidence.threshold_evidence(s.where("split = 'deploy'"), s.where("split = 'cal' and label = 0"), k)


def stream(spark: SparkSession, d: str, how: str = "first-flow") -> DataFrame:
    """The episode stream with ``pos``, checkpointed, as it is small and used again and again."""
    return materialise(episodes.ordered(episodes.build(evident(spark, d), KEYS), KEYS, how))


ZETA = repr(zeta(1.6))
GAMMA = {"poly": lambda t: f"(power(({t})::double, -1.6::double) / {ZETA}::double)", "uniform": lambda t: f"(case when ({t}) between 1 and n then 1.0::double / n else 0.0 end)"}

Z = """z as (select event_id as ingest_id, epoch_us(ts) as ts, user_id % 20 as src, event_type as dst, (event_type = 'error')::int as label, cast(json_extract_string(props, '$.k') as int) as dport, value, user_id,
  value + case when event_type = 'error' and user_id % 4 <> 0 and cast(json_extract_string(props, '$.k') as int) % 3 <> 0 then 1000.0::double else 0.0::double end as score,
  row_number() over (order by epoch_us(ts), event_id) as rn, count(*) over () as n from events),
b as (select max(floor(0.55::double * n)) as i2, max(floor(0.55::double * n) - floor(0.4::double * n)) as i1, max(floor(0.55::double * n) + floor(0.15::double * n)) as i3 from z),
cal as (select z.* from z, b where rn > i1 and rn <= i2), dep as (select z.* from z, b where rn > i2 and rn <= i3)"""
EV = f"""{Z},
kth as (select max(score) as kth, count(*) as nc from cal where label = 0),
ev as (select dep.*, (nc + 1)::double as ceiling, case when score > kth then (nc + 1)::double else 0.0::double end as e from dep, kth)"""
EP = f"""{EV},
ep as (select src, dst, count(*) as nsz, sum(label)::bigint as mal, sum(e) as sum_e, max(score) as smax, min(ts) as first_ts, max(ts) as last_ts, arg_min(ingest_id, ts::hugeint * 1000000000 + ingest_id) as first_pos, max(ceiling) as ceiling, sum(e) / count(*) as ev, sum(label) > 0 as ismal from ev group by src, dst),
s as (select *, row_number() over (order by first_ts, first_pos) as pos, count(*) over () as n from ep)"""


# ---- the same on flows, where the number of hypotheses grows with the data ----

FLOW_ALPHA = 0.1


def flow_evident(spark: SparkSession, d: str) -> DataFrame:
    """Deployed flows with evidence: score is the log of the bytes, plus 100 for a planted part of the malicious flows; k = 1."""
    f = table(spark, d, "flows").where("ts is not null and src is not null and dst is not null and label is not null and split in ('cal', 'deploy')")
    planted = (F.col("label") == 1) & (draw("ingest_id") % 3 != 0)
    f = f.select("ingest_id", "ts", "src", "dst", "label", "split", (F.log1p(finite("f5") + finite("f6")) + F.when(planted, 100.0).otherwise(0.0)).alias("score"))
    return evidence.threshold_evidence(f.where("split = 'deploy'"), f.where("split = 'cal' and label = 0"), 1)


def flow_stream(spark: SparkSession, d: str) -> DataFrame:
    """Episodes of sources in two hours, in order of their first flow; a table in the shared folder."""
    return stored(episodes.ordered(episodes.build(flow_evident(spark, d), ["src"], 7200), ["src"]), "stream")


_BYTES = lambda c: f"coalesce(nullif(nullif(nullif({c}::varchar, 'nan'), 'inf'), '-inf')::float::double, 0)"
FLOW_EP = f"""fz as (select ingest_id, ts, src, dst, label, split, ln(1 + {_BYTES("f5")} + {_BYTES("f6")}) + case when label = 1 and {draw_sql("ingest_id")} % 3 <> 0 then 100.0::double else 0.0::double end as score from flows where ts is not null and src is not null and dst is not null and label is not null and split in ('cal', 'deploy')),
fk as (select max(score) as kth, (count(*) + 1)::double as ceiling from fz where split = 'cal' and label = 0),
fe as (select src, floor(ts / 7200000000)::bigint as bucket, count(*) as nsz, sum(label)::bigint as mal, sum(case when score > kth then ceiling else 0.0::double end) as sum_e, max(ceiling) as ceiling, min(ts) as first_ts, arg_min(ingest_id, ts::hugeint * 1000000000 + ingest_id) as first_pos from fz, fk where split = 'deploy' group by 1, 2),
s as (select *, sum_e / nsz as ev, mal > 0 as ismal, row_number() over (order by first_ts, first_pos) as pos, count(*) over () as n from fe)"""
