"""Queries of the general training-data problems (1, 3, 4, 5) and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstream.functions.columns import host_sql
from wardstream.operators import features, nested, sessions, tree
from wardstream.runtime import table
from wardstream.schema import FEATURES


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return sessions.host_sessions(table(spark, d, "flows")).select("side", "host", "start_us", "end_us")


def p1_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions.host_sessions(table(spark, d, "flows"))


def _features(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    return features.host_features(table(spark, d, "flows"), table(spark, d, "meta"), table(spark, d, "t49_r7"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return features.decoded(*_features(spark, d)).select("side", "host", "event_type")


def p3_features(spark: SparkSession, d: str) -> DataFrame:
    return features.decoded(*_features(spark, d))


def p3_profile(spark: SparkSession, d: str) -> DataFrame:
    f, _ = _features(spark, d)
    return f.select("side", "host", "n_flows", "last_us", "total_bytes", F.round("fail_share", 9).alias("fail_share"))


def p3_wide(spark: SparkSession, d: str) -> DataFrame:
    f, types = _features(spark, d)
    return features.expand_features(f, ["side", "host"], types)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return tree.heavy_hosts(table(spark, d, "flows")).select("side", "host")


def p4_profile(spark: SparkSession, d: str) -> DataFrame:
    return tree.host_profile(table(spark, d, "flows"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    a = nested.addresses(table(spark, d, "lspr23_attacknarratives"))
    return a.select("narrative_id", "content_pos", "json_path", "ip")


def p5_addresses(spark: SparkSession, d: str) -> DataFrame:
    return nested.addresses(table(spark, d, "lspr23_attacknarratives"))


def p5_hosts(spark: SparkSession, d: str) -> DataFrame:
    return nested.hosts(table(spark, d, "lspr23_attacknarratives"))


def p5_items(spark: SparkSession, d: str) -> DataFrame:
    return nested.content_items(table(spark, d, "lspr23_attacknarratives"))


def p5_narratives(spark: SparkSession, d: str) -> DataFrame:
    return nested.narrative_table(table(spark, d, "lspr23_attacknarratives"))


QUERIES = {f.__name__: f for f in (p1_found, p1_sessions, p3_found, p3_features, p3_profile, p3_wide, p4_found, p4_profile, p5_found, p5_addresses, p5_hosts, p5_items, p5_narratives)}

_SIDES = f"""sides as (
  select 'src' as side, {host_sql("src")} as host, {host_sql("dst")} as peer, * exclude (src, dst) from flows
  union all
  select 'dst' as side, {host_sql("dst")} as host, {host_sql("src")} as peer, * exclude (src, dst) from flows)"""

_SESSIONS = f"""with {_SIDES},
f as (select side, host, ts from sides where ts is not null and ts <> 0 and host is not null),
g as (select *, case when ts - lag(ts) over (partition by side, host order by ts) <= 1800000000 then 0 else 1 end as cut from f),
s as (select *, sum(cut) over (partition by side, host order by ts rows unbounded preceding) as no from g)
select side, host, {{columns}} from s group by side, host, no"""

# As text, since statistics of a column can fold isnan() away.
_FINITE = lambda c: f"coalesce(nullif(nullif(nullif({c}::varchar, 'nan'), 'inf'), '-inf')::float::double, 0)"
_PART = lambda c: f"coalesce(nullif(upper(trim({c})), ''), '-')"
_SAME = ", ".join(["ts", "src", "dst", "label", *FEATURES, "sensor", "split"])
_TYPED = f"""with typed as (
  select distinct {_SAME}, {_PART("conn")} || '/' || {_PART("service")} as event_type from flows join meta using (ingest_id)),
sides as (
  select 'src' as side, {host_sql("src")} as host, nullif(ts, 0) as ts, {_FINITE("f5")} + {_FINITE("f6")} as bytes, event_type from typed
  union all
  select 'dst' as side, {host_sql("dst")} as host, nullif(ts, 0) as ts, {_FINITE("f5")} + {_FINITE("f6")} as bytes, event_type from typed),
f as (select * from sides where host is not null)"""
_FAILED = "split_part(event_type, '/', 1) in (select upper(trim(c)) from (select unnest(config.fail_conn) as c from t49_r7))"

_PROFILE = f"""with {_SIDES}
select side, host, count(*) as n_flows, count(distinct peer) as n_peers, min(nullif(ts, 0)) as first_us, max(nullif(ts, 0)) as last_us
from sides where host is not null group by side, host"""

_JSON = lambda t: f"try_cast(trim({t}, ' ' || chr(9) || chr(10) || chr(13)) as json)"
_OBJECT = lambda t: f"case when json_type({_JSON(t)}) = 'OBJECT' then {_JSON(t)} end"
_INNER = lambda v: f"coalesce(case when json_type({v}) = 'VARCHAR' then {_OBJECT(v + "->>'$'")} end, {v})"
NODES = f"""with recursive e as (select narrative_id, (pos - 1)::bigint as content_pos, content[pos] as t from (select narrative_id, content, unnest(range(1, len(content) + 1)) as pos from lspr23_attacknarratives)),
n as (
  select narrative_id, content_pos, '' as p, {_OBJECT("t")} as v, false as ips from e where {_OBJECT("t")} is not null
  union all
  select n.narrative_id, n.content_pos, c.p, c.v, c.ips from n, lateral (
    select case when n.p = '' then k else n.p || '.' || k end as p, case when k = 'IPs' then x else {_INNER("x")} end as v, k = 'IPs' as ips
    from (select unnest(map_keys(m)) as k, unnest(map_values(m)) as x from (select from_json(n.v, '"MAP(VARCHAR,JSON)"') as m where json_type(n.v) = 'OBJECT'))
    union all
    select n.p || '[' || i || ']' as p, case when n.ips then x else {_INNER("x")} end as v, false as ips
    from (select unnest(range(0, len(l))) as i, unnest(l) as x from (select from_json(n.v, '["JSON"]') as l where json_type(n.v) = 'ARRAY'))) c),
a as (
  select narrative_id, content_pos, p as parent_path, p || '[' || i || ']' as json_path, x->>'$' as ip from (select narrative_id, content_pos, p, unnest(range(0, len(l))) as i, unnest(l) as x from (select *, from_json(v, '["JSON"]') as l from n where ips and json_type(v) = 'ARRAY')) where json_type(x) = 'VARCHAR'
  union all
  select narrative_id, content_pos, p, p, v->>'$' from n where ips and json_type(v) = 'VARCHAR'),
ip as (select narrative_id, content_pos, left(parent_path, greatest(0, length(parent_path) - 4)) as parent_path, json_path, regexp_extract(ip, '^\\s*([0-9]+[.][0-9]+[.][0-9]+[.][0-9]+)\\s*$', 1) as ip from a)"""
_TEXT = lambda k: f"case when json_type(v->'$.{k}') in ('OBJECT', 'ARRAY') then null else v->>'$.{k}' end"
# Types without flows have columns too, so each comes in once without a host.
_WIDE = f"""select side, host, columns('.*_n$'), coalesce(columns('.*_total$'), 0.0::double) as '\\0', columns('.*_latest$') from (
pivot ({_TYPED}, every as (select side, host, ts, bytes, event_type from f union all select null, null, null, null, event_type from (select distinct {_PART("conn")} || '/' || {_PART("service")} as event_type from meta)) select * from every)
on event_type using count(*) as n, sum(bytes) as total, max(ts) as latest group by side, host) where host is not null"""


SQL = {
    "p1_found": _SESSIONS.format(columns="min(ts) as start_us, max(ts) as end_us"),
    "p1_sessions": _SESSIONS.format(columns="no::bigint as session_no, min(ts) as start_us, max(ts) as end_us, max(ts) - min(ts) as duration_us, count(*) as n_flows"),
    "p3_found": f"{_TYPED} select distinct side, host, event_type from f",
    "p3_features": f"{_TYPED} select side, host, event_type, count(*) as n_flows, max(ts) as last_us, sum(bytes) as total_bytes from f group by side, host, event_type",
    "p3_profile": f"{_TYPED} select side, host, count(*) as n_flows, max(ts) as last_us, sum(bytes) as total_bytes, round(avg(case when {_FAILED} then 1.0 else 0.0 end), 9) as fail_share from f group by side, host",
    "p3_wide": _WIDE,
    "p4_found": f"with {_SIDES} select side, host from sides where host is not null group by side, host having count(*) >= 0.02 * (select count(*) from flows)",
    "p4_profile": _PROFILE,
    "p5_found": f"{NODES} select narrative_id, content_pos, json_path, ip from ip where ip <> ''",
    "p5_addresses": f"{NODES} select * from ip where ip <> ''",
    "p5_hosts": f"""{NODES} select narrative_id, content_pos, p as host_path, {_TEXT("Hostname")} as hostname, {_TEXT("Time")} as reported_at, {_TEXT("Privileged")} as privileged
from n where json_type(v) = 'OBJECT' and list_contains(json_keys(v), 'Hostname')""",
    "p5_narratives": "select narrative_id, subject, lower(trim(category)) as category, phase, coalesce(len(segments), 0)::int as n_segments, coalesce(len(steps_submitted_time), 0)::int as n_steps, coalesce(len(content), 0)::int as n_items from lspr23_attacknarratives",
    "p5_items": "select narrative_id, (pos - 1)::bigint as content_pos, content[pos] as content_text, coalesce(try_cast(trim(content[pos], ' ' || chr(9) || chr(10) || chr(13)) as json) is not null and json_type(try_cast(trim(content[pos], ' ' || chr(9) || chr(10) || chr(13)) as json)) = 'OBJECT', false) as is_report from (select narrative_id, content, unnest(range(1, len(content) + 1)) as pos from lspr23_attacknarratives)",
}
