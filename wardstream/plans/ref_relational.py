"""Scans, filters, evidence, grouping, merging, joins and windows: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstream.functions.columns import event_type, host, host_sql, micros, prefix24
from wardstream.functions.hashing import h63, key_hash
from wardstream.operators import attack, episodes, evidence, history, hostfeatures, ingest, joins, merging
from wardstream.plans.fixture import EP, EV, KEYS, Z, evident, events_flows, split_events, stream
from wardstream.runtime import table
from wardstream.schema import FEATURES
from wardstream.sources import readers

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Register a query under ``ref_`` and its name, with SQL if there is one."""

    def keep(f):
        QUERIES[f"ref_{f.__name__}"] = f
        if sql:
            SQL[f"ref_{f.__name__}"] = sql
        return f

    return keep


def r(c, n: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def flows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "flows")


# ---- sources ----


@query("select ingest_id, coalesce(sport, -1)::int as sport, coalesce(dport, -1)::int as dport, coalesce(conn, '') as conn, coalesce(service, '') as service, coalesce(label_src, -1)::int as label_src from meta")
def s03_meta(spark, d):
    return ingest.clean_meta(table(spark, d, "meta")).select("ingest_id", "sport", "dport", "conn", "service", "label_src")


@query("select count(*) as n, count(m.dport) as with_ports, coalesce(sum(m.dport), 0)::bigint as ports from flows f left join meta m using (ingest_id)")
def s02_ports(spark, d):
    j = ingest.join_side(flows(spark, d), table(spark, d, "meta"))
    return j.agg(F.count("*").alias("n"), F.count("dport").alias("with_ports"), F.coalesce(F.sum("dport"), F.lit(0)).alias("ports"))


@query("""select narrative_id, (i - 1)::int as step_no, lower(trim(category)) as category, epoch_us(try_cast(steps_submitted_time[i] as timestamptz)) as ts
from (select *, unnest(range(1, coalesce(len(steps_submitted_time), 0) + 1)) as i from lspr23_attacknarratives)""")
def s09_steps(spark, d):
    return readers.steps(table(spark, d, "lspr23_attacknarratives")).select("narrative_id", F.col("step_no").cast("int").alias("step_no"), "category", "ts")


@query()
def s10_compromised(spark, d):
    return readers.compromised(table(spark, d, "lspr23_attacknarratives"))


@query(f"""with j as (select distinct {host_sql("src")} as a, {host_sql("srcip")} as b from flows join meta using (ingest_id)), p as (select * from j where a is not null and b is not null)
select count(*) as pairs, (select count(*) from (select a from p group by a having count(*) > 1)) as a_with_many, (select count(*) from (select b from p group by b having count(*) > 1)) as b_with_many,
 (select count(*) from (select a from p group by a having count(*) > 1)) = 0 and (select count(*) from (select b from p group by b having count(*) > 1)) = 0 as aligned from p""")
def s16_alignment(spark, d):
    j = flows(spark, d).select("ingest_id", host("src").alias("src")).join(table(spark, d, "meta").select("ingest_id", host("srcip").alias("srcip")), "ingest_id")
    return ingest.bijection(j, "src", "srcip")


@query(f"select src, arg_min(srcip, ingest_id) as srcip from (select {host_sql('src')} as src, srcip, ingest_id from flows join meta using (ingest_id)) where srcip is not null group by src")
def s17_first_seen(spark, d):
    j = flows(spark, d).select("ingest_id", host("src").alias("src")).join(table(spark, d, "meta").select("ingest_id", "srcip"), "ingest_id")
    return ingest.first_seen(j, "src", "srcip", "ingest_id")


# ---- projections, filters, splits ----

# As text, since statistics of a column can fold isnan() away.
_FIN = lambda c: f"coalesce(nullif(nullif(nullif({c}::varchar, 'nan'), 'inf'), '-inf')::float::double, 0)"


@query("select sensor, count(*) as n, " + ", ".join(f"count_if({_FIN(c)} = 0) as zero_{c}" for c in FEATURES) + " from flows group by sensor")
def p01_clean(spark, d):
    return ingest.clean_features(flows(spark, d)).groupBy("sensor").agg(F.count("*").alias("n"), *[F.count_if(F.col(c) == 0).alias(f"zero_{c}") for c in FEATURES])


@query("select case when len(string_split(src, '.')) = 4 then regexp_replace(src, '\\.[^.]*$', '') else src end as net, count(*) as n from flows group by 1")
def p02_prefix24(spark, d):
    return flows(spark, d).groupBy(prefix24("src").alias("net")).agg(F.count("*").alias("n"))


@query(f"with {Z} select 'cal' as split, count(*) as n, sum(label)::bigint as malicious, min(ts) as lo, max(ts) as hi from cal union all select 'deploy', count(*), sum(label)::bigint, min(ts), max(ts) from dep")
def p03_split(spark, d):
    s = split_events(spark, d).where("split in ('cal', 'deploy')")
    return s.groupBy("split").agg(F.count("*").alias("n"), F.sum("label").alias("malicious"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))


@query("""with n as (select count(*)::double as n from events), p as (select unnest([0.55, 0.62, 0.85])::double as pos)
select pos, floor(pos * n)::bigint - floor(0.15::double * n)::bigint as i1, floor(pos * n)::bigint as i2, n::bigint as to_end, floor(floor(pos * n) / 2)::bigint as half from p, n""")
def p04_split_variants(spark, d):
    n = table(spark, d, "events").count()
    rows = []
    for pos in (0.55, 0.62, 0.85):
        i1, i2, _ = ingest.split_bounds(n, pos)
        rows.append((pos, i1, i2, ingest.split_bounds(n, pos, until_end=True)[2], ingest.split_bounds(n, pos, half=True)[0]))
    return spark.createDataFrame(rows, "pos double, i1 long, i2 long, to_end long, half long")


@query()
def p05_train_sample(spark, d):
    return ingest.train_sample(flows(spark, d).where("split = 'train'"), "label", "ingest_id").groupBy("label").agg(F.count("*").alias("n"))


@query()
def p06_sample(spark, d):
    return ingest.sample_without_replacement(flows(spark, d), "ingest_id", 1000).select("ingest_id")


@query()
def p07_draws(spark, d):
    return ingest.sample_with_replacement(flows(spark, d).where("label = 0").select("ingest_id", "f5"), ["ingest_id"], 1000)


@query("select count(*) as n from flows where src in (select src from flows where label = 1)")
def p08_membership(spark, d):
    f = flows(spark, d)
    return f.join(f.where("label = 1").select("src").distinct(), "src", "left_semi").agg(F.count("*").alias("n"))


@query("""with t as (select coalesce(src, '') as v from flows where split = 'deploy'), s as (select distinct coalesce(src, '') as v from flows where split = 'cal')
select count(*) as n, count_if(v not in (select v from s)) as unseen, round(count_if(v not in (select v from s)) / count(*), 6) as share from t""")
def p09_novelty(spark, d):
    f = flows(spark, d)
    return ingest.novelty(f.where("split = 'deploy'"), f.where("split = 'cal'"), "src").select("n", "unseen", r("share").alias("share"))


@query(f"with {EP}, g as (select unnest([0.001, 0.01, 0.05, 0.2])::double as pi), c as (select count(*) as t, count_if(ismal) as m from ep) select pi, least(m, greatest(1, round_even(pi * (t - m) / (1 - pi), 0)))::bigint as keep from g, c")
def p10_keep(spark, d):
    c = stream(spark, d).agg(F.count("*").alias("t"), F.count_if("ismal").alias("m")).first()
    return spark.createDataFrame([(p, ingest.thinning_keep(c.t, c.m, p)) for p in (0.001, 0.01, 0.05, 0.2)], "pi double, keep long")


@query()
def p10_thinned(spark, d):
    return ingest.thin(stream(spark, d), KEYS, 0.05).groupBy("ismal").agg(F.count("*").alias("n"))


@query()
def p11_resampled(spark, d):
    return ingest.thin_resampled(stream(spark, d).select(*KEYS, "ev", "ismal"), KEYS, 0.05).groupBy("ismal").agg(F.count("*").alias("n"), F.max("ev").alias("top"))


@query()
def p12_contaminated(spark, d):
    s = split_events(spark, d)
    cal, pool = s.where("split = 'cal' and label = 0"), s.where("split = 'cal' and label = 1")
    out = None
    for model in ("add", "replace"):
        c = ingest.contaminate(cal, pool, 10, model).agg(F.lit(model).alias("model"), F.count("*").alias("n"), r(F.min("score")).alias("low"))
        out = c if out is None else out.unionByName(c)
    return out


_BENIGN = f"b as (select f.ingest_id, f.src, f.label, ({_FIN('f.proto')})::bigint as proto, coalesce(m.dport, 0)::bigint as dport, case when f.f5 > 10000 then 1.0::double else 0.0::double end as e from flows f join meta m using (ingest_id))"


def _benign(spark, d):
    f = flows(spark, d).select("ingest_id", "src", "label", F.when(F.abs("proto") < float("inf"), F.col("proto")).otherwise(0).cast("long").alias("proto"), F.when(F.col("f5") > 10000, 1.0).otherwise(0.0).alias("e"))
    return f.join(table(spark, d, "meta").select("ingest_id", F.coalesce("dport", F.lit(0)).cast("long").alias("dport"), "conn", "service"), "ingest_id")


@query(f"""with {_BENIGN}, q as (select *, proto * 100000 + dport as service from b where label = 0), mo as (select service from q group by service order by count(*) desc, service limit 1), a as (select distinct src from b where label = 1 and src is not null)
select 'all' as pool, count(*) as n, round(avg(e), 6) as mean_e from q union all select 'attacker', count(*), round(avg(e), 6) from q where src in (select src from a) union all select 'modal', count(*), round(avg(e), 6) from q where service in (select service from mo)""")
def p13_pools(spark, d):
    b = _benign(spark, d)
    return attack.pools(b.where("label = 0"), b.where("label = 1")).select("pool", "n", r("mean_e").alias("mean_e"))


@query(f"""with {_BENIGN}, m as (select dport from b group by dport order by count(*) desc, dport limit 1)
select 'all' as rule, count(*) as n, round(avg(coalesce((label = 1)::int, null)), 6) as attack_share from b union all select 'tcp', count(*), round(avg((label = 1)::int), 6) from b where proto = 6
union all select 'modal port', count(*), round(avg((label = 1)::int), 6) from b where dport in (select dport from m) union all select 'small', count(*), round(avg((label = 1)::int), 6) from b where e = 0""")
def p14_pool_audit(spark, d):
    b = _benign(spark, d)
    mode = ingest.modal(b, "dport").first().mode
    return attack.pool_audit(b, {"all": F.lit(True), "tcp": F.col("proto") == 6, "modal port": F.col("dport") == mode, "small": F.col("e") == 0}).select("rule", "n", r("attack_share").alias("attack_share"))


@query("select count(*) as n, bool_and(label = greatest(label_src, label_dst)) as holds from flows join meta using (ingest_id) where label is not null and label_src >= 0 and label_dst >= 0")
def p15_label_identity(spark, d):
    return ingest.label_identity(flows(spark, d).select("ingest_id", "label").join(table(spark, d, "meta").select("ingest_id", "label_src", "label_dst"), "ingest_id"))


_SCALE = ["f0", "f1", "f5", "f20"]


@query(" union all ".join(f"select '{c}' as name, round(quantile_cont(abs({_FIN(c)}), 0.5), 3) as median_abs, quantile_cont(abs({_FIN(c)}), 0.5) >= 100000000000 as dropped from flows" for c in _SCALE))
def p16_epoch_scale(spark, d):
    f = flows(spark, d)
    return ingest.epoch_scale(f.withColumns({c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c)).otherwise(0).cast("double") for c in _SCALE}), _SCALE).select("name", r("median_abs", 3).alias("median_abs"), "dropped")


@query(" union all ".join(f"select '{c}' as name from flows having count({c}) / count(*) > 0.9 and min({c}) < max({c})" for c in FEATURES))
def p17_usable_columns(spark, d):
    good = ingest.usable_columns(flows(spark, d), FEATURES)
    return spark.createDataFrame([(c,) for c in good], "name string")


# ---- evidence ----


@query(f"with {EV} select dst, count(*) as n, count_if(e > 0) as fired, round(max(ceiling), 6) as ceiling from ev group by dst")
def e01_threshold(spark, d):
    return evident(spark, d).groupBy("dst").agg(F.count("*").alias("n"), F.count_if(F.col("e") > 0).alias("fired"), r(F.max("ceiling")).alias("ceiling"))


_RANK = f"{Z}, c as (select score from cal where label = 0), rk as (select dep.*, (select count(*) from c where c.score > dep.score) as above, (select count(*) from c where c.score = dep.score) as ties, (select count(*) from c) as nc from dep)"


def _ranked(spark, d):
    s = split_events(spark, d)
    return evidence.ranks(s.where("split = 'deploy'"), s.where("split = 'cal' and label = 0"))


@query(f"with {_RANK} select ingest_id, above, 1 + above + ties as rank from rk")
def e02_ranks(spark, d):
    return _ranked(spark, d).select("ingest_id", "above", "rank")


@query(f"with {_RANK} select ingest_id, above, ties from rk")
def e03_split_ties(spark, d):
    return _ranked(spark, d).select("ingest_id", "above", "ties")


@query(f"with {_RANK}, p as (select ingest_id, (above + 0.5 * (1 + ties)) / (nc + 1) as p from rk) select ingest_id, round(p, 9) as p, round(0.5 * power(p, -0.5), 6) as e from p")
def e04_e05_smoothed(spark, d):
    p = _ranked(spark, d).withColumn("p", evidence.smoothed_p(F.col("above"), F.col("ties"), F.col("nc"), F.lit(0.5)))
    return p.select("ingest_id", r("p", 9).alias("p"), r(evidence.calibrated(F.col("p"), 0.5)).alias("e"))


@query(f"""with {Z}, k as (select user_id % 7 as z, max(score) as kth, count(*) as nc from cal where label = 0 group by 1)
select dep.user_id % 7 as stratum, count(*) as n, count_if(score > kth) as fired, max(nc + 1)::double as ceiling from dep left join k on dep.user_id % 7 = k.z group by 1""")
def e06_mondrian(spark, d):
    s = split_events(spark, d).withColumn("stratum", F.col("user_id") % 7)
    t = evidence.stratified_evidence(s.where("split = 'deploy'"), s.where("split = 'cal' and label = 0"), "stratum")
    return t.groupBy("stratum").agg(F.count("*").alias("n"), F.count_if(F.col("e") > 0).alias("fired"), F.max("ceiling").alias("ceiling"))


@query(f"""with {Z}, cg as (select src, dst, max(score) as m, avg(score) as a from cal where label = 0 group by src, dst), dg as (select src, dst, max(score) as m, avg(score) as a from dep group by src, dst)
select 'max' as statistic, count(*) as n, count_if(m > (select max(m) from cg)) as fired from dg union all select 'mean', count(*), count_if(a > (select max(a) from cg)) from dg""")
def e07_group_level(spark, d):
    s = split_events(spark, d)
    g = lambda w: s.where(w).groupBy(*KEYS).agg(F.max("score").alias("max"), F.avg("score").alias("mean"))
    cal, dep = g("split = 'cal' and label = 0"), g("split = 'deploy'")
    one = lambda c: evidence.threshold_evidence(dep, cal, 1, c).agg(F.lit(c).alias("statistic"), F.count("*").alias("n"), F.count_if(F.col("e") > 0).alias("fired"))
    return one("max").unionByName(one("mean"))


@query()
def e08_ceilings(spark, d):
    n = split_events(spark, d).where("split = 'cal' and label = 0").count()
    rows = [(k, *(round(x, 4) for x in (evidence.ceiling_nominal(n, k), evidence.ceiling_beta(n, k, 0.1), evidence.ceiling_dkw(n, k, 0.1)))) for k in (1, 10, 100)]
    return spark.createDataFrame(rows, "k int, nominal double, beta double, dkw double")


@query()
def e09_boost(spark, d):
    e = evident(spark, d).groupBy("e").agg(F.count("*").alias("c")).collect()  # two values: no evidence, and the ceiling
    n = sum(x.c for x in e)
    return spark.createDataFrame([(t, round(evidence.optimal_boost([x.e for x in e], [x.c / n for x in e], t), 6)) for t in (10.0, 1000.0)], "tau double, boost double")


@query(f"with {EV} select round(1 / (max(ceiling) * avg((e > 0)::int)), 6) as boost from ev")
def e10_boost(spark, d):
    return evidence.empirical_boost(evident(spark, d)).select(r("boost").alias("boost"))


@query(f"with {_RANK} select ingest_id, round((1 + above + ties) / (nc + 1), 9) as p from rk")
def e12_conformal_p(spark, d):
    return _ranked(spark, d).select("ingest_id", r(evidence.conformal_p(F.col("rank"), F.col("nc")), 9).alias("p"))


@query(f"with {_RANK}, h as (select sum(1.0::double / i) as h from range(1, (select max(nc) + 2 from rk)) t(i)) select ingest_id, round((nc + 1) / (h * (1 + above + ties)), 6) as e from rk, h")
def e11_harmonic(spark, d):
    k = _ranked(spark, d)
    n = split_events(spark, d).where("split = 'cal' and label = 0").count()
    return k.select("ingest_id", r(evidence.harmonic_e(F.col("rank"), n)).alias("e"))


@query(f"with {Z} select a.ingest_id, round((1 + coalesce(count_if(c.score >= a.score), 0)) / (1 + count(c.rn)), 9) as p from z a left join z c on c.rn between a.rn - 50 and a.rn - 1 group by a.ingest_id")
def e13_rolling(spark, d):
    return evidence.rolling_p(ingest.positions(events_flows(spark, d), ["ts", "ingest_id"], "rn"), "rn", 50).select("ingest_id", r("p", 9).alias("p"))


@query(f"with {_RANK}, g as (select unnest([1, 10, 100, 1000, 10000, 100000]) as k) select k, count_if(1 + above + ties <= k) as fired, count(*) as n, round(count_if(1 + above + ties <= k) / count(*), 9) as rate, round(k / (max(nc) + 1), 9) as nominal, round(count_if(1 + above + ties <= k) / count(*) / (k / (max(nc) + 1)), 6) as ratio from rk, g where label = 0 group by k")
def e14_firing_rates(spark, d):
    return evidence.firing_rates(_ranked(spark, d).where("label = 0"), [1, 10, 100, 1000, 10_000, 100_000]).select("k", "fired", "n", r("rate", 9).alias("rate"), r("nominal", 9).alias("nominal"), r("ratio").alias("ratio"))


# ---- grouping, orders, keys ----

_FLOW = "f as (select ingest_id, ts, src, dst, label, coalesce(f5, 0)::double as w, case when f5 > 10000 then 1.0::double else 0.0::double end as e from flows where ts is not null)"


def _flow(spark, d):
    return flows(spark, d).where("ts is not null").select("ingest_id", "ts", "src", "dst", "label", F.when(F.col("f5") > 10000, 1.0).otherwise(0.0).alias("e"))


@query(f"""with {_FLOW} select src, dst, floor(ts / 7200000000)::bigint as bucket, count(*) as nsz, coalesce(sum(label), 0)::bigint as mal, sum(e) as sum_e, min(ts) as first_ts, max(ts) as last_ts, arg_min(ingest_id, ts::hugeint * 1000000000 + ingest_id) as first_pos, round(sum(e) / count(*), 9) as ev, coalesce(sum(label), 0) > 0 as ismal from f group by 1, 2, 3""")
def g01_episodes(spark, d):
    return episodes.build(_flow(spark, d), KEYS, 7200).select(*KEYS, "bucket", "nsz", "mal", "sum_e", "first_ts", "last_ts", "first_pos", r("ev", 9).alias("ev"), "ismal")


_NET = lambda c: f"case when len(string_split({c}, '.')) = 4 then regexp_replace({c}, '\\.[^.]*$', '') else {c} end"
_FAM = {"src-dst": "src, dst", "src": "src", "dst": "dst", "subnet24": f"{_NET('src')}, {_NET('dst')}", "src-dport": "src, dport"}
_PORTED = "f as (select f.ingest_id, f.ts, f.src, f.dst, m.dport from flows f left join meta m using (ingest_id) where f.ts is not null)"


@query(f"with {_PORTED} " + " union all ".join(f"select '{n}' as family, {b or 0}::int as bucket_s, count(*) as t, max(c) as largest from (select count(*) as c from f group by {k}{f', floor(ts / {b}000000)' if b else ''})" for n, k in _FAM.items() for b in (300, 86400, None)))
def g02_families(spark, d):
    f, out = _flow(spark, d).join(table(spark, d, "meta").select("ingest_id", "dport"), "ingest_id", "left"), None
    for name in _FAM:
        g, keys = episodes.with_family(f, name)
        for b in (300, 86400, None):
            e = episodes.build(g, keys, b).agg(F.lit(name).alias("family"), F.lit(b or 0).alias("bucket_s"), F.count("*").alias("t"), F.max("nsz").alias("largest"))
            out = e if out is None else out.unionByName(e)
    return out


@query(f"with {EP} select src, dst, round(smax, 6) as smax, last_ts from ep")
def g04_g05_group_max(spark, d):
    return stream(spark, d).select(*KEYS, r("smax").alias("smax"), "last_ts")


@query("with c as (select src, m.dport, count(*) as n from flows join meta m using (ingest_id) where m.dport is not null group by 1, 2) select src, arg_min(dport, (1000000000 - n) * 1000000 + dport) as mode, max(n) as n from c group by src")
def g06_modal(spark, d):
    return ingest.modal(flows(spark, d).select("ingest_id", "src").join(table(spark, d, "meta").select("ingest_id", "dport"), "ingest_id"), "dport", ["src"])


@query(f"with {_FLOW} select ingest_id, row_number() over (partition by src, dst, floor(ts / 86400000000) order by ts, ingest_id) as arrival from f")
def g07_arrival(spark, d):
    return episodes.arrival_rank(_flow(spark, d), KEYS, 86400).select("ingest_id", "arrival")


@query(f"with {_FLOW} select ingest_id, case when e > 0 then sum((e > 0)::int) over (partition by src, dst, floor(ts / 86400000000) order by ts, ingest_id rows unbounded preceding)::bigint end as flagged from f")
def g08_flagged(spark, d):
    return episodes.flagged_rank(_flow(spark, d).withColumn("hit", F.col("e") > 0), KEYS, "hit", 86400).select("ingest_id", "flagged")


@query(f"with {_FLOW} select src, floor(ts / 86400000000)::bigint as bucket, round(avg(e), 9) as ev from f where src is not null group by 1, 2")
def g09_evidence_on(spark, d):
    f = _flow(spark, d).where("src is not null")
    part = episodes.build(f.withColumn("e", F.lit(0.0)), ["src"], 86400)
    return episodes.evidence_on(part, f, ["src"], 86400).select("src", "bucket", r("ev", 9).alias("ev"))


_ALERTS = "al as (select src, dst, floor(ts / 7200000000) as bucket from f where src is not null and dst is not null group by 1, 2, 3 having sum(e) / count(*) >= 0.5)"


def _alerts(f):
    return episodes.build(f.where("src is not null and dst is not null"), KEYS, 7200).where("ev >= 0.5")


@query(f"with {_FLOW}, {_ALERTS}, m as (select src, dst, floor(ts / 7200000000) as bucket, count(*) as n from f where label = 1 group by 1, 2, 3) select sum(n)::bigint as malicious, coalesce(sum(case when al.src is not null then n end), 0)::bigint as covered, round(coalesce(sum(case when al.src is not null then n end), 0) / sum(n), 9) as share from m left join al using (src, dst, bucket)")
def g10_coverage(spark, d):
    f = _flow(spark, d)
    return episodes.coverage(f, _alerts(f), KEYS, 7200).select("malicious", "covered", r("share", 9).alias("share"))


@query(f"with {_FLOW}, {_ALERTS} select src, dst, count(*) as n, count_if(label = 1) as malicious, min(ts) as first_ts, max(ts) as last_ts from f where (src, dst) in (select (src, dst) from al) group by src, dst")
def g11_whole_stream(spark, d):
    f = _flow(spark, d)
    return episodes.whole_stream_groups(f, _alerts(f), KEYS)


@query(f"with {EP} select src, dst, pos from s")
def k01_first_flow(spark, d):
    return stream(spark, d).select(*KEYS, F.col("pos").cast("long").alias("pos"))


@query()
def k02_random_ties(spark, d):
    return stream(spark, d, "first-tie").select(*KEYS, "pos")


_U = "::uhugeint"
_MASK = "18446744073709551615::uhugeint"


def _mix_sql(name: str, source: str, col: str, keep: str) -> str:
    """CTEs that apply the finaliser to an unsigned column of a source."""
    return f"""{name}1 as (select {keep}, ((xor({col}, {col} >> 30) * 13787848793156543929{_U}) & {_MASK}) as v from {source}),
{name}2 as (select {keep}, ((xor(v, v >> 27) * 10723151780598845931{_U}) & {_MASK}) as v from {name}1),
{name} as (select {keep}, xor(v, v >> 31) as v from {name}2)"""


@query(f"""with s0 as (select ingest_id, xor(11400714819323198485{_U}, ingest_id{_U}) as v from (select event_id as ingest_id, user_id from events)), {_mix_sql('m', 's0', 'v', 'ingest_id')},
s1 as (select m.ingest_id, xor(m.v, user_id{_U}) as v from m join events on event_id = m.ingest_id), {_mix_sql('h', 's1', 'v', 'ingest_id')}
select ingest_id, (v & 9223372036854775807{_U})::bigint as h from h""")
def k03_key_hash(spark, d):
    return events_flows(spark, d).select("ingest_id", h63(key_hash(["ingest_id", "user_id"])).alias("h"))


@query()
def k04_key_orders(spark, d):
    a = stream(spark, d, "keyhash").select(*KEYS, F.col("pos").alias("keyhash"))
    return a.join(episodes.ordered(episodes.build(evident(spark, d), KEYS), KEYS, "keyed", 7).select(*KEYS, F.col("pos").alias("keyed")), KEYS)


@query(f"with {EP} select src, dst, row_number() over (order by src, dst) as group_id, row_number() over (order by last_ts, first_pos) as last_flow from s")
def k05_other_orders(spark, d):
    e = episodes.build(evident(spark, d), KEYS)
    return episodes.ordered(e, KEYS, "group-id").select(*KEYS, F.col("pos").cast("long").alias("group_id")).join(episodes.ordered(e, KEYS, "last-flow").select(*KEYS, F.col("pos").cast("long").alias("last_flow")), KEYS)


def _pads(e: DataFrame) -> DataFrame:
    """One silent pad into the third pair, at the start of the window."""
    lo = e.agg(F.min("ts").alias("t"))
    return lo.select(F.lit(-1).cast("long").alias("ingest_id"), (F.col("t") - 1).alias("ts"), F.lit(3).cast("long").alias("src"), F.lit("click").alias("dst"), F.lit(0).alias("label"), F.lit(0.0).alias("e"))


@query()
def k06_moved(spark, d):
    e = evident(spark, d).select("ingest_id", "ts", "src", "dst", "label", "e")
    first = episodes.moved_by_pad(e, _pads(e), KEYS).withColumn("order", F.lit("first-flow"))
    return first.unionByName(episodes.moved_by_pad(e, _pads(e), KEYS, how="keyhash").withColumn("order", F.lit("keyhash")))


_LI = "l as (select epoch_us(l_shipdate) as first_ts from lineitem)"


@query(f"with {_LI}, b as (select count(*) as c from l group by first_ts) select coalesce(sum(case when c > 1 then c end), 0)::bigint as n_tied, count(*) as blocks, max(c) as b_max, round(coalesce(sum(case when c > 1 then c end), 0) / sum(c), 9) as fraction from b")
def k07_ties(spark, d):
    li = table(spark, d, "lineitem")
    e = li.select(micros(li, "l_shipdate").alias("first_ts"))
    return episodes.tie_exposure(e).select("n_tied", "blocks", "b_max", r("fraction", 9).alias("fraction"))


@query()
def k08_padding_is_local(spark, d):
    """Episodes without a pad, how many of them differ after padding, and the size of the padded ones."""
    e = evident(spark, d).select("ingest_id", "ts", "src", "dst", "label", "e")
    changed = episodes.unpadded_changes(e, _pads(e), KEYS).agg(F.count("*").alias("changed"))
    touched = _pads(e).select(*KEYS).distinct().withColumn("__t", F.lit(True))
    after = episodes.padded_episodes(e, _pads(e), KEYS).join(touched, KEYS, "left")
    g = after.agg(F.count_if(F.col("__t").isNull()).alias("unpadded"), F.coalesce(F.sum(F.when(F.col("__t"), F.col("nsz"))), F.lit(0)).alias("padded_nsz"))
    return g.join(F.broadcast(changed))  # one row


@query(f"with {EP} select floor(first_ts / 86400000000)::bigint as epoch, count(*) as n, min(first_ts) as first_ts, max(last_ts) as last_ts, count_if(floor(last_ts / 86400000000) > floor(first_ts / 86400000000)) as straddling from s group by 1")
def k09_epochs(spark, d):
    return episodes.epoch_schedule(stream(spark, d), 86400)


# ---- merging ----


@query(f"with {_FLOW}, g as (select count(*) as nsz from f where label = 0 group by src, dst) select greatest(ceil(avg(nsz)), 1)::bigint as mean, " + ", ".join(f"greatest(ceil(quantile_cont(nsz, {q})), 1)::bigint as {n}" for n, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99), ("p999", 0.999))) + ", max(nsz)::bigint as max from g")
def a02_caps(spark, d):
    return merging.cap_values(episodes.build(_flow(spark, d).where("label = 0"), KEYS))


@query(f"with {_FLOW} select src, dst, round(sum(e) / 8.0, 9) as ev from f where src is not null and dst is not null group by 1, 2")
def a02_sum_over_cap(spark, d):
    return merging.sum_over_cap(episodes.build(_flow(spark, d).where("src is not null and dst is not null"), KEYS), 8).select(*KEYS, r("ev", 9).alias("ev"))


_ARR = f"{_FLOW}, a as (select *, 0::bigint as bucket, row_number() over (partition by src, dst order by ts, ingest_id) as arrival, count(*) over (partition by src, dst) as m from f where src is not null and dst is not null)"


def _arr(spark, d):
    return episodes.arrival_rank(_flow(spark, d).where("src is not null and dst is not null"), KEYS)


@query(f"with {_ARR} select src, dst, round(sum(case when arrival <= 8 then e else 0 end) / 8.0, 9) as ev from a group by 1, 2")
def a03_truncated(spark, d):
    return merging.truncated(_arr(spark, d), KEYS, 8).select(*KEYS, r("ev", 9).alias("ev"))


@query(f"with {_ARR} select src, dst, floor((arrival - 1) / 8)::bigint as piece, count(*) as nsz, round(sum(e) / count(*), 9) as ev from a group by 1, 2, 3")
def a04_split(spark, d):
    return merging.split_groups(_arr(spark, d), KEYS, 8).select(*KEYS, "piece", "nsz", r("ev", 9).alias("ev"))


@query(f"with {EP} select src, dst, round(case when ceiling >= n / 0.025::double then round(sum_e / ceiling) / nsz else 0 end, 9) as slot from s")
def a05_slot(spark, d):
    e = stream(spark, d)
    t = e.count()
    return merging.slot_expectation(e, 0.025, F.lit(t)).select(*KEYS, r("slot", 9).alias("slot"))


_W = {"first": "case when arrival = 1 then 1.0 else 0.0 end", "last": "case when arrival = m then 1.0 else 0.0 end", "uniform": "case when arrival <= 8 then 0.125 else 0.0 end", "decay": "0.5 * power(0.5::double, arrival - 1)"}


@query(f"with {_ARR} " + " union all ".join(f"select '{n}' as rule, src, dst, round(sum(({w})::double * e), 9) as ev from a group by 2, 3" for n, w in _W.items()))
def a06_weights(spark, d):
    a, out = _arr(spark, d), None
    for n in _W:
        x = merging.weighted(a, KEYS, n).select(F.lit(n).alias("rule"), *KEYS, r("ev", 9).alias("ev"))
        out = x if out is None else out.unionByName(x)
    return out


@query(f"""with f as (select f.ingest_id, f.src, f.dst, f.split, f.label, coalesce(m.dport, 0) as dport, case when f.f5 > 10000 then 1.0::double else 0.0::double end as e from flows f left join meta m using (ingest_id) where f.ts is not null and f.src is not null and f.dst is not null),
p as (select dport, count(*)::double / sum(count(*)) over () as weight from f where split = 'cal' and label = 0 group by dport) select f.src, f.dst, round(coalesce(sum(coalesce(weight, 0.0) * e) / nullif(sum(coalesce(weight, 0.0)), 0), 0), 9) as ev from f left join p on p.dport = f.dport where split = 'deploy' group by 1, 2""")
def a06_prior_port(spark, d):
    """Weights committed before deployment, the share of a flow's port among the benign calibration flows, normalised within the group."""
    f = flows(spark, d).where("ts is not null and src is not null and dst is not null").select("ingest_id", *KEYS, "split", "label", F.when(F.col("f5") > 10000, 1.0).otherwise(0.0).alias("e"))
    f = f.join(table(spark, d, "meta").select("ingest_id", "dport"), "ingest_id", "left").withColumn("dport", F.coalesce("dport", F.lit(0)))
    g = f.where("split = 'cal' and label = 0").groupBy("dport").agg(F.count("*").cast("double").alias("c"))
    prior = g.join(F.broadcast(g.agg(F.sum("c").alias("n")))).select("dport", (F.col("c") / F.col("n")).alias("weight"))  # one row
    return merging.prior_weighted(f.where("split = 'deploy'").withColumn("bucket", F.lit(0)), prior, KEYS, "dport").select(*KEYS, r("ev", 9).alias("ev"))


_PV = f"{_RANK}, pv as (select src, dst, (above + 0.5 * (1 + ties)) / (nc + 1) as p from rk)"


def _pv(spark, d):
    return _ranked(spark, d).select(*KEYS, evidence.smoothed_p(F.col("above"), F.col("ties"), F.col("nc"), F.lit(0.5)).alias("p"))


@query(f"with {_PV} select src, dst, round(least(1.0, count(*) * min(p)), 9) as p from pv group by 1, 2")
def a07_bonferroni(spark, d):
    return merging.bonferroni(_pv(spark, d), KEYS).select(*KEYS, r("p", 9).alias("p"))


@query(f"with {_PV} select src, dst, round(least(1.0, 2 * avg(p)), 9) as p from pv group by 1, 2")
def a08_twice_mean(spark, d):
    return merging.twice_mean(_pv(spark, d), KEYS).select(*KEYS, r("p", 9).alias("p"))


@query(f"with {_PV}, o as (select *, row_number() over (partition by src, dst order by p) as i, count(*) over (partition by src, dst) as m from pv), q as (select src, dst, min(m / i * p) as simes, max(m) as m from o group by 1, 2) select src, dst, round(least(1.0, simes), 9) as simes, round(least(1.0, simes * (select sum(1.0::double / j) from range(1, q.m + 1) t(j))), 9) as hommel from q")
def a09_simes(spark, d):
    p = _pv(spark, d)
    a = merging.simes(p, KEYS).select(*KEYS, r("p", 9).alias("simes"))
    return a.join(merging.simes(p, KEYS, True).select(*KEYS, r("p", 9).alias("hommel")), KEYS)


# ---- joins ----


@query("select f.label, count(*) as n, count(m.ingest_id) as with_meta from flows f left join meta m using (ingest_id) group by 1")
def j01_flows_meta(spark, d):
    m = table(spark, d, "meta").select("ingest_id", F.lit(True).alias("has"))
    return ingest.join_side(flows(spark, d), m).groupBy("label").agg(F.count("*").alias("n"), F.count("has").alias("with_meta"))


@query(f"with {EP} select ev.ingest_id, s.pos from ev join s using (src, dst)")
def j02_flow_to_episode(spark, d):
    e = evident(spark, d)
    s = episodes.ordered(episodes.build(e, KEYS), KEYS)
    return e.select("ingest_id", *KEYS).join(s.select(*KEYS, "pos"), KEYS).select("ingest_id", F.col("pos").cast("long").alias("pos"))


@query(f"with {Z}, m as (select ts from dep where label = 1) select ingest_id, least(dep.ts - (select max(m.ts) from m where m.ts <= dep.ts), (select min(m.ts) from m where m.ts >= dep.ts) - dep.ts) as nearest_us from dep")
def j05_nearest(spark, d):
    dep = split_events(spark, d).where("split = 'deploy'")
    return joins.nearest_in_time(dep, dep.where("label = 1")).select("ingest_id", "nearest_us")


@query(f"""with {_FLOW}, e as (select src, dst, floor(ts / 7200000000)::bigint as bucket, min(ts) as a, max(ts) as b from f where label = 1 and src is not null and dst is not null group by 1, 2, 3),
t as (select epoch_us(try_cast(x as timestamptz)) as ts from (select unnest(steps_submitted_time) as x from lspr23_attacknarratives))
select src, dst, bucket, (select count(*) from t where t.ts between a - 900000000 and b + 900000000) as n_steps from e""")
def j06_steps_near(spark, d):
    e = episodes.build(_flow(spark, d).where("label = 1 and src is not null and dst is not null"), KEYS, 7200)
    s = readers.steps(table(spark, d, "lspr23_attacknarratives")).select("ts")
    near = joins.steps_near(e, [*KEYS, "bucket"], s)
    return near.select(*KEYS, "bucket", "n_steps")


_STEPS = "st as (select narrative_id, floor(epoch_us(try_cast(x as timestamptz)) / 7200000000)::bigint as bucket, segments from (select narrative_id, unnest(steps_submitted_time) as x, coalesce(segments, []) as segments from lspr23_attacknarratives) where try_cast(x as timestamptz) is not null)"


@query(f"""with {_STEPS}, al as (select src, floor(ts / 7200000000)::bigint as bucket, list(distinct 'bt_' || seg_src) as segs from flows join meta using (ingest_id) where label = 1 and src is not null and ts is not null and seg_src <> '' group by 1, 2)
select src, al.bucket, count(*) as n_steps from al join st on al.bucket = st.bucket and list_has_any(segs, st.segments) group by 1, 2""")
def j07_steps_to_alerts(spark, d):
    f = flows(spark, d).where("label = 1 and src is not null and ts is not null").select("ingest_id", "ts", "src").join(table(spark, d, "meta").select("ingest_id", "seg_src").where("seg_src <> ''"), "ingest_id")
    a = f.groupBy("src", episodes.bucket(F.col("ts"), 7200).alias("bucket")).agg(F.collect_set(F.concat(F.lit("bt_"), "seg_src")).alias("segments"))
    a = a.withColumn("ips", F.array().cast("array<string>"))
    return joins.steps_to_alerts(a, ["src"], readers.steps(table(spark, d, "lspr23_attacknarratives")), 7200, "seg")


@query(f"with {_FLOW}, {_ALERTS}, p as (select src, dst, floor(ts / 7200000000)::bigint as bucket, floor(ts / 300000000)::bigint as atom, max((label = 1)::int) as bad from f group by 1, 2, 3, 4) select p.src, p.dst, p.bucket, count(*) as n_atoms, coalesce(sum(bad), 0)::bigint as n_bad from p join al on p.src = al.src and p.dst = al.dst and p.bucket = al.bucket group by 1, 2, 3")
def j08_atoms(spark, d):
    f = _flow(spark, d)
    return joins.atoms(f, _alerts(f), KEYS, 7200, KEYS)


@query(f"with {_FLOW}, g as (select src, dst, coalesce(sum(label), 0)::bigint as mal from f where src is not null and dst is not null group by 1, 2) select src, dst, (sum(mal) over (partition by src) - mal)::bigint as mal_elsewhere from g")
def j09_elsewhere(spark, d):
    e = episodes.build(_flow(spark, d).where("src is not null and dst is not null"), KEYS)
    return joins.elsewhere(e, KEYS, "src").select(*KEYS, "mal_elsewhere")


_VEC = ", ".join(f"{_FIN(c)} + 0 as {c}" for c in FEATURES)
_ALL = ", ".join(FEATURES)


@query(f"with v as (select ingest_id, split, {_VEC} from flows), c as (select distinct {_ALL} from v where split = 'cal') select ingest_id from v join c using ({_ALL}) where split = 'deploy'")
def j10_identical(spark, d):
    f = flows(spark, d)
    return joins.identical_in(f.where("split = 'deploy'"), f.where("split = 'cal'"), FEATURES)


@query(f"with v as (select label, {_VEC} from flows where label is not null), g as (select count(*) as n, sum(label)::bigint as m from v group by {_ALL}) select count(*) as n_vectors, count_if(m > 0 and m < n) as n_mixed, sum(n)::bigint as n_flows, coalesce(sum(case when m > 0 and m < n then n end), 0)::bigint as n_in_mixed, coalesce(sum(case when m > 0 and m < n then least(m, n - m) end), 0)::bigint as n_minority from g")
def j11_label_conflicts(spark, d):
    return joins.inconsistent_labels(flows(spark, d), FEATURES)


@query("""with p as (select q.vec_id, b.vec_id as neighbour, sqrt(list_sum(list_transform(list_zip(q.embedding, b.embedding), lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double)))) as distance from embeddings q join embeddings b on q.vec_id <> b.vec_id where q.vec_id % 50 = 0)
select vec_id, arg_min(neighbour, distance) as neighbour, round(min(distance), 5) as distance from p group by vec_id""")
def j12_nearest_neighbour(spark, d):
    e = table(spark, d, "embeddings")
    return joins.nearest_neighbour(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding").select("vec_id", "neighbour", r("distance", 5).alias("distance"))


@query(f"""with a as (select distinct {host_sql("src")} as h, seg_src as g from flows join meta using (ingest_id) where seg_src <> ''), b as (select distinct {host_sql("dst")} as h, seg_dst as g from flows join meta using (ingest_id) where seg_dst <> ''),
s as (select distinct h from a where h in (select h from b)), o as (select distinct h from a join b using (h, g)) select (select count(*) from s) as shared, (select count(*) from o) as overlapping, round((select count(*) from o) / (select count(*) from s), 6) as share""")
def j13_map_agreement(spark, d):
    m = table(spark, d, "meta").select("ingest_id", "seg_src", "seg_dst")
    f = flows(spark, d).select("ingest_id", host("src").alias("s"), host("dst").alias("d")).join(m, "ingest_id")
    side = lambda h, g: f.where(F.col(g) != "").where(F.col(h).isNotNull()).select(F.col(h).alias("h"), F.array(g).alias("v")).distinct()
    return joins.map_agreement(side("s", "seg_src"), side("d", "seg_dst"), "h", "v").select("shared", "overlapping", r("share").alias("share"))


@query(f"with {_FLOW}, v as (select dst, min(ts) as t_atk from f where label = 1 and dst is not null group by dst) select dst, count(*) as n, round(avg(e), 9) as mean_e from f join v using (dst) where label = 0 and ts < t_atk group by dst")
def j15_pool_before(spark, d):
    f = _flow(spark, d)
    v = f.where("label = 1 and dst is not null").groupBy("dst").agg(F.min("ts").alias("t_atk"))
    return joins.pool_before(f.where("label = 0"), v).select("dst", "n", r("mean_e", 9).alias("mean_e"))


# ---- windows ----


@query(f"with {_FLOW} select ingest_id, count(*) over w as n, coalesce(sum(e) over w, 0) as s from f window w as (partition by src order by ts range between unbounded preceding and 1 preceding)")
def w01_strictly_before(spark, d):
    return history.before(_flow(spark, d), ["src"], "ts", {"n": F.lit(1).cast("long"), "s": F.col("e")}).select("ingest_id", "n", "s")


_FAILS = "upper(trim(conn)) in (select upper(trim(c)) from (select unnest(config.fail_conn) as c from t49_r7))"
_WF = f"""x as (select f.ingest_id, ts, src, dst, coalesce({_FAILS}, false)::int as bad from flows f left join meta m using (ingest_id) where ts is not null),
y as (select *, (row_number() over (partition by src, dst order by ts, ingest_id) = 1)::int as nw from x)"""
_WIN = lambda k: f"over (partition by {k} order by ts range between unbounded preceding and 1 preceding)"


@query(f"with {_WF} select ingest_id, " + ", ".join(f"count(*) {_WIN(k)} as {k}_cnt, coalesce(sum(nw) {_WIN(k)}, 0)::bigint as {k}_peers, round(coalesce(sum(bad) {_WIN(k)}, 0) / greatest(count(*) {_WIN(k)}, 1), 9) as {k}_fail" for k in ("src", "dst")) + " from y")
def w02_w03_host_features(spark, d):
    from wardstream.operators.features import failed_state

    f = flows(spark, d).where("ts is not null").select("ingest_id", "ts", "src", "dst").join(table(spark, d, "meta").select("ingest_id", "conn"), "ingest_id", "left")
    h = hostfeatures.host_features(f, failed_state("conn", table(spark, d, "t49_r7")))
    return h.select("ingest_id", *[c for s in ("src", "dst") for c in (f"{s}_cnt", f"{s}_peers")], *[r(f"{s}_fail", 9).alias(f"{s}_fail") for s in ("src", "dst")])


def _pair(spark, d):
    f = flows(spark, d).where("ts is not null").select("ingest_id", "ts", "src", "dst", "f5")
    top = f.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.count("*").alias("c"), F.max("ts").alias("t")).orderBy(F.desc("c"), "src", "dst").limit(1).first()
    return f, top


_PAIR = "f as (select * from flows where ts is not null), tp as (select src as s, dst as d, max(ts) as t from f where src is not null and dst is not null group by 1, 2 order by count(*) desc, 1, 2 limit 1)"


@query(f"with {_PAIR}, n as (select f.*, s, d from f, tp where ts <= t) select count_if(src = s) as src_cnt, count(distinct case when src = s then dst end) as src_peers, round(count_if(src = s and f5 > 10000) / greatest(count_if(src = s), 1), 9) as src_fail, count_if(dst = d) as dst_cnt, count(distinct case when dst = d then src end) as dst_peers, round(count_if(dst = d and f5 > 10000) / greatest(count_if(dst = d), 1), 9) as dst_fail from n")
def w04_state(spark, d):
    f, top = _pair(spark, d)
    s = hostfeatures.state_at(f, top.src, top.dst, top.t, F.col("f5") > 10000)
    return s.select("src_cnt", "src_peers", r("src_fail", 9).alias("src_fail"), "dst_cnt", "dst_peers", r("dst_fail", 9).alias("dst_fail"))


@query(f"""with {_PAIR}, n as (select f.*, s, d from f, tp where ts <= t), c as (select count_if(src = s) as a, count(distinct case when src = s then dst end) as ap, count_if(src = s and f5 > 10000) as ab, count_if(dst = d) as b, count(distinct case when dst = d then src end) as bp, count_if(dst = d and f5 > 10000) as bb from n), k as (select unnest(range(1, 11))::int as k)
select k, a + k - 1 as src_cnt, ap as src_peers, round(ab / greatest(a + k - 1, 1), 9) as src_fail, b + k - 1 as dst_cnt, bp as dst_peers, round(bb / greatest(b + k - 1, 1), 9) as dst_fail from c, k""")
def w05_pad_contexts(spark, d):
    f, top = _pair(spark, d)
    c = hostfeatures.pad_contexts(hostfeatures.state_at(f, top.src, top.dst, top.t, F.col("f5") > 10000), 10)
    return c.select("k", "src_cnt", "src_peers", r("src_fail", 9).alias("src_fail"), "dst_cnt", "dst_peers", r("dst_fail", 9).alias("dst_fail"))