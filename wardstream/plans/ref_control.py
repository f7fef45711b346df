"""Controllers, metrics, attack costs and detectors: queries and their SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstream.functions import special
from wardstream.functions.hashing import draw_sql, uniform, uniform_sql
from wardstream.operators import attack, bootstrap, controllers, detector, episodes, evidence, ingest, metrics, order_stats, spending
from wardstream.plans.fixture import EP, EV, FLOW_ALPHA, FLOW_EP, GAMMA, KEYS, ZETA, Z, evident, flow_stream, split_events, stream
from wardstream.runtime import table

QUERIES: dict = {}
SQL: dict = {}
ALPHA, W0 = 0.05, 0.025
A, W = "0.05::double", "0.025::double"


def query(sql: str | None = None):
    """Register a query under ``ref_`` and its name, with SQL if there is one."""

    def keep(f):
        QUERIES[f"ref_{f.__name__}"] = f
        if sql:
            SQL[f"ref_{f.__name__}"] = sql
        return f

    return keep


def r(c, n: int = 9):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def _out(df: DataFrame) -> DataFrame:
    return df.select(F.col("pos").cast("long").alias("pos"), r("level", 10).alias("level"), "fired", "silent")


def _lond_sql(kind: str) -> str:
    """LOND one hypothesis after the other, as CTEs ``c``: pos, rejections so far, level, fired."""
    g = GAMMA[kind]
    return f"""recursive {EP},
c as (select 0::bigint as pos, 0::bigint as r, 0::double as level, false as fired, false as silent
 union all select s.pos, c.r + (s.ceiling >= 1 / ({A} * {g('s.pos')} * (c.r + 1)) and s.ev >= 1 / ({A} * {g('s.pos')} * (c.r + 1)))::bigint, {A} * {g('s.pos')} * (c.r + 1),
  s.ceiling >= 1 / ({A} * {g('s.pos')} * (c.r + 1)) and s.ev >= 1 / ({A} * {g('s.pos')} * (c.r + 1)), s.ceiling < 1 / ({A} * {g('s.pos')} * (c.r + 1))
 from c join s on s.pos = c.pos + 1)"""


_RUN = "select pos, round(level, 10) as level, fired, silent from c where pos > 0"


# ---- controllers ----


@query(f"with {_lond_sql('poly')} select s.src, s.dst, c.pos, s.nsz, s.mal, round(s.ev, 6) as ev, round(c.level, 10) as level, c.fired, c.silent, case when c.fired and s.ismal then greatest(floor(s.sum_e * c.level - s.nsz)::bigint + 1, 0) end as r_star from c join s on s.pos = c.pos")
def c01_elond_poly(spark, d):
    """The flagship: episodes with their evidence, level, decision and the pads that would suppress them."""
    s = stream(spark, d)
    run = s.join(controllers.elond_native(s).select("pos", "level", "fired", "silent"), "pos")
    pads = F.when(F.col("fired") & F.col("ismal"), attack.zero_pads(F.col("sum_e"), 1.0 / F.col("level"), F.col("nsz")))
    return run.select(*KEYS, F.col("pos").cast("long").alias("pos"), "nsz", "mal", r("ev", 6).alias("ev"), r("level", 10).alias("level"), "fired", "silent", pads.alias("r_star"))


@query(f"with {_lond_sql('uniform')} {_RUN}")
def c01_elond_uniform(spark, d):
    return _out(controllers.elond_native(stream(spark, d), "uniform"))


@query(f"with {_lond_sql('poly')} {_RUN}")
def c01_elond_fold(spark, d):
    return _out(controllers.control(stream(spark, d), "elond"))


_AGES = f"""list_aggregate(list_append(list_transform(taus[2:], lambda x: {A} * {GAMMA['poly']('s.pos - x')}), 0.0::double), 'sum') + coalesce(({A} - {W}) * {GAMMA['poly']('s.pos - taus[1]')}, 0) + {W} * {GAMMA['poly']('s.pos')}"""


@query(f"""with recursive {EP},
c as (select 0::bigint as pos, []::bigint[] as taus, 0::double as level, false as fired, false as silent
 union all select pos, case when ok then list_append(taus, pos) else taus end, level, ok, silent from (select s.pos, taus, {_AGES} as level, s.ev >= 1 / ({_AGES}) and s.ceiling >= 1 / ({_AGES}) as ok, s.ceiling < 1 / ({_AGES}) as silent from c join s on s.pos = c.pos + 1))
{_RUN}""")
def c02_lordpp(spark, d):
    return _out(controllers.control(stream(spark, d), "lordpp"))


for _name, _proc in (("c03_saffron", "saffron"), ("c04_addis", "addis"), ("c09_donation_elond", "donation_elond"), ("c10_closed_elond", "closed_elond"), ("c11_etoad_arc", "etoad_arc"), ("c13_donation_ebh", "donation_ebh"), ("c07_esaffron", "esaffron"), ("c07_mem_elord", "memlord")):

    def _f(spark, d, proc=_proc):
        return _out(controllers.control(stream(spark, d), proc))

    _f.__name__ = _name
    query()(_f)


@query(f"with {_lond_sql('poly')} {_RUN}")
def c11_etoad_immediate(spark, d):
    """With immediate deadlines the procedure is e-LOND."""
    e = controllers.control(stream(spark, d), "etoad_immediate").select("pos", "fired")
    s = stream(spark, d).select("pos", "ceiling").join(e, "pos")
    return _out(controllers.with_levels(s, "poly", ALPHA))


@query(f"with {EP}, k as (select pos, ev, case when ev > 0 then 1 / ({A} * {GAMMA['poly']('pos')} * ev) end as c from s), o as (select *, row_number() over (order by c, pos) as i from k where c is not null), m as (select coalesce(max(case when c <= i then i end), 0) as k from o) select pos, coalesce(c <= m.k, false) as fired from k, m")
def c05_ebh(spark, d):
    return controllers.ebh_native(stream(spark, d)).select(F.col("pos").cast("long").alias("pos"), "fired")


@query()
def c06_ebh_entries(spark, d):
    def run(e, n, m, c):
        out = controllers.online_ebh(e, c, spending.gamma("poly", len(e)), ALPHA)
        return [(int(i) + 1, int(out.notes["entered"][i])) for i in np.flatnonzero(out.fired)]

    return _whole(stream(spark, d), run, "pos long, entered long")


@query("with recursive " + EP + f""",
c as (select 0::bigint as pos, 0::bigint as r, 0.01::double as w, 0::double as spent, 0::double as level, false as fired, false as silent
 union all select pos, r + ok::bigint, 0.01::double * (1 + 0.5 * (1 - power(0.5::double, pos - r - ok::bigint)) / 0.5 - 0.5 * (1 - power(0.5::double, r + ok::bigint)) / 0.5), spent + level / (r + 1), level, ok, silent
 from (select s.pos, c.r, c.spent, c.w * ({A} - c.spent) * (c.r + 1) as level, s.ceiling >= 1 / (c.w * ({A} - c.spent) * (c.r + 1)) and s.ev >= 1 / (c.w * ({A} - c.spent) * (c.r + 1)) as ok, s.ceiling < 1 / (c.w * ({A} - c.spent) * (c.r + 1)) as silent from c join s on s.pos = c.pos + 1)) {_RUN}""")
def c07_elord(spark, d):
    return _out(controllers.control(stream(spark, d), "elord"))


@query("with recursive g as (select 1 as t, 0.01::double as w, 1.0::double as rest union all select t + 1, 0.01::double * (1 + (1 - power(0.5::double, t))), rest * (1 - w) from g where t < 50) select t, round(w * rest, 12) as gamma from g")
def c08_implied_gamma(spark, d):
    return spark.createDataFrame([(i + 1, round(float(x), 12)) for i, x in enumerate(controllers.implied_gamma(50, 0.01))], "t int, gamma double")


@query(f"with {EP}, q as (select *, floor(first_ts / 86400000000) as day, row_number() over (order by floor(first_ts / 86400000000), pos) as p from s) select p as pos, max(p) over (partition by day) as deadline from q")
def c12_bucket_deadlines(spark, d):
    q = ingest.positions(stream(spark, d).withColumn("day", episodes.bucket(F.col("first_ts"), 86400)), ["day", "pos"], "p")
    return q.join(q.groupBy("day").agg(F.max("p").alias("deadline")), "day").select(F.col("p").alias("pos"), "deadline")


@query(f"with {_lond_sql('poly')} {_RUN}")
def c15_lond_p(spark, d):
    return _out(controllers.control(stream(spark, d), "lond_p"))


@query(f"with {_lond_sql('poly')} select pos, round(level, 10) as level, round(1 / level, 3) as tau from c where pos > 0")
def c16_levels(spark, d):
    s = stream(spark, d)
    f = s.join(controllers.control(s, "elond").select("pos", "fired"), "pos")
    return controllers.with_levels(f, "poly", ALPHA).select(F.col("pos").cast("long").alias("pos"), r("level", 10).alias("level"), r("tau", 3).alias("tau"))


@query()
def c17_restarted(spark, d):
    s = episodes.epochs(stream(spark, d), 6 * 3600)
    out = None
    for a in ("each", "uniform", "geometric"):
        x = controllers.restarted(s, "elond", allocation=a).agg(F.lit(a).alias("allocation"), F.count_if("fired").alias("fired"), F.count_if("silent").alias("silent"))
        out = x if out is None else out.unionByName(x)
    return out


@query("select t, round(case when t <= 100 then 0.01 else 0 end, 6) as misspecified, round(ln(greatest(t, 2)) / (t * exp(sqrt(ln(t)))) / (select sum(ln(greatest(j, 2)) / (j * exp(sqrt(ln(j))))) from range(1, 201) r(j)), 9) as jm from range(1, 201) q(t)")
def c19_c20_spending(spark, d):
    u, j = spending.gamma("uniform", 200, 100), spending.gamma("jm", 200)
    return spark.createDataFrame([(i + 1, round(float(u[i]), 6), round(float(j[i]), 9)) for i in range(200)], "t long, misspecified double, jm double")


@query()
def c18_prefix_shifts(spark, d):
    def run(e, n, m, c):
        return [(g, int(controllers.fold(controllers.Lond(spending.gamma("poly", len(e) + g), ALPHA, g), e, c).fired.sum())) for g in (0, 5, 20, 50)]

    return _whole(stream(spark, d), run, "shift int, fired int")


@query()
def c21_c22_feedback(spark, d):
    """Count-lag and wall-clock controllers over the deployed flows' episodes; thresholds are quantiles of the calibration's episode scores."""
    top = lambda f: f.groupBy(*KEYS).agg(F.max("score").alias("m"), F.min("ts").alias("ts"), F.max("label").alias("y")).toPandas().sort_values(["ts", *KEYS])  # noqa: E731  one row per episode
    f = split_events(spark, d)
    s, cal = top(f.where("split = 'deploy'")), top(f.where("split = 'cal' and label = 0"))["m"].to_numpy()
    score, ts, y = s["m"].to_numpy(), s["ts"].to_numpy(), s["y"].to_numpy().astype(bool)
    rows = []
    for lag in (0, 20, 50):
        hit = controllers.feedback(score, y, controllers.Threshold(cal, 0.05, least=10), lag)
        rows.append((f"lag {lag}", int(hit.sum()), int((hit & y).sum())))
    for kind in ("P", "PI", "AQT"):
        hit = controllers.delayed_control(score, ts, y, controllers.Threshold(cal, 0.05, kind), 3.6e9)
        rows.append((kind, int(hit.sum()), int((hit & y).sum())))
    return spark.createDataFrame(rows, "controller string, alerts int, true_alerts int")


_BHP = f"{Z}, c as (select score from cal where label = 0), q as (select ingest_id, (1 + (select count(*) from c where c.score >= dep.score)) / (1 + (select count(*) from c)) as p from dep), o as (select *, row_number() over (order by p) as i, count(*) over () as n from q)"


@query(f"with {_BHP} select count(*) as n, (select count(*) from q where p <= (select max(p) from o where p <= 0.1::double * i / n)) as bh, (select count(*) from q where p <= (select max(p) from o where p <= 0.1::double * i / (n * (select sum(1.0::double / j) from range(1, (select count(*) + 1 from q)) t(j))))) as by_count from q")
def c23_step_up(spark, d):
    s = split_events(spark, d)
    k = evidence.ranks(s.where("split = 'deploy'"), s.where("split = 'cal' and label = 0")).select(evidence.conformal_p(F.col("rank"), F.col("nc")).alias("p"))
    c = k.groupBy("p").agg(F.count("*").alias("c"))  # ties share the largest rank
    n = c.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    o = order_stats.running(c, "p", "c", "b").select("p", "c", (F.col("b") + F.col("c")).alias("i")).withColumns({"n": F.lit(n), "h": F.lit(special.harmonic(n))})
    count = lambda cond: F.coalesce(F.max(F.when(cond, F.col("i"))), F.lit(0))
    return o.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), count(F.col("p") <= 0.1 * F.col("i") / F.col("n")).alias("bh"), count(F.col("p") <= 0.1 * F.col("i") / (F.col("n") * F.col("h"))).alias("by_count"))


def _sensors(spark, d):
    """Per sensor the ceiling that its calibration flows allow, and as many hypotheses as its deployed flows have pairs of hosts."""
    g = table(spark, d, "flows").groupBy("sensor")
    return g.agg((F.count_if((F.col("split") == "cal") & (F.col("label") == 0)) + 1).cast("double").alias("ceiling"), F.count_distinct(F.when(F.col("split") == "deploy", F.struct("src", "dst"))).alias("t"))


_SENSORS = "ce as (select sensor, (count_if(split = 'cal' and label = 0) + 1)::double as ceiling, count(distinct case when split = 'deploy' then (src, dst) end) as t from flows group by sensor)"


@query(f"""with recursive {_SENSORS}, c as (select sensor, ceiling, t, 0::bigint as i, 0::bigint as r, 0::bigint as silent from ce union all
select sensor, ceiling, t, i + 1, r + (ceiling >= 1 / ({A} * {GAMMA["poly"]("i + 1")} * (r + 1)))::bigint, silent + (ceiling < 1 / ({A} * {GAMMA["poly"]("i + 1")} * (r + 1)))::bigint from c where i < t)
select sensor, ceiling, t, max(r) as fired, max(silent) as silent from c group by 1, 2, 3""")
def c24_maximum_evidence(spark, d):
    """e-LOND over as many hypotheses at the ceiling as a sensor has episodes, one task per sensor."""

    def run(batches):
        for pdf in batches:
            out = [controllers.fold(controllers.Lond(spending.gamma("poly", int(t)), ALPHA), np.full(int(t), c), c) for c, t in zip(pdf["ceiling"], pdf["t"])]
            yield pdf.assign(fired=[int(o.fired.sum()) for o in out], silent=[int(o.silent.sum()) for o in out])

    return _sensors(spark, d).repartition("sensor").mapInPandas(run, "sensor string, ceiling double, t long, fired long, silent long")


# ---- controllers on flows: as many hypotheses as the data have sources in two hours ----


def _flow_lond(kind: str) -> str:
    g, a = {"poly": GAMMA["poly"]("s.pos"), "uniform": "(1.0::double / n)"}[kind], f"{FLOW_ALPHA}::double"
    return f"""recursive {FLOW_EP}, c as (select 0::bigint as pos, 0::bigint as r, 0::double as level, false as fired, false as silent union all
  select pos, r + ok::bigint, level, ok, ceiling < 1 / level from (select *, ceiling >= 1 / level and ev >= 1 / level as ok from (select s.pos, s.ev, s.ceiling, c.r, {a} * {g} * (c.r + 1) as level from c join s on s.pos = c.pos + 1)))"""


def _flow_run(spark, d, kind: str) -> DataFrame:
    s = flow_stream(spark, d)
    return s.select("pos", "src", "bucket", "ismal", "nsz", "sum_e").join(controllers.elond_native(s, kind, FLOW_ALPHA).select("pos", "level", "fired", "silent"), "pos")


@query(f"with {_flow_lond('poly')} {_RUN}")
def c01_flows_poly(spark, d):
    return _out(_flow_run(spark, d, "poly"))


@query(f"with {_flow_lond('uniform')} select s.src, s.bucket, c.pos, round(c.level, 10) as level, c.fired, c.silent, case when c.fired and s.ismal then greatest(floor(s.sum_e * c.level - s.nsz)::bigint + 1, 0) end as r_star from c join s on s.pos = c.pos")
def c01_flows_uniform(spark, d):
    pads = F.when(F.col("fired") & F.col("ismal"), attack.zero_pads(F.col("sum_e"), 1.0 / F.col("level"), F.col("nsz")))
    return _flow_run(spark, d, "uniform").select("src", "bucket", "pos", r("level", 10).alias("level"), "fired", "silent", pads.alias("r_star"))


@query(f"with {_flow_lond('uniform')} select count_if(fired) as alerts, count_if(fired and ismal) as tp, count(*) as t, count_if(silent) as silent, round(count_if(fired and ismal) / nullif(count_if(ismal), 0), 9) as recall from c join s on s.pos = c.pos")
def r03_flows_rates(spark, d):
    return metrics.rates(_flow_run(spark, d, "uniform")).select("alerts", "tp", "t", "silent", r("recall").alias("recall"))


@query(f"with {FLOW_EP}, k as (select pos, ev, case when ev > 0 then 1 / ({FLOW_ALPHA}::double / n * ev) end as c from s), o as (select *, row_number() over (order by c, pos) as i from k where c is not null), m as (select coalesce(max(case when c <= i then i end), 0) as k from o) select pos, coalesce(c <= m.k, false) as fired from k, m")
def c05_flows_ebh(spark, d):
    return controllers.ebh_native(flow_stream(spark, d), "uniform", FLOW_ALPHA).select("pos", "fired")


# ---- metrics ----


@query(f"with {Z}, o as (select label, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as k from dep), g as (select sum(label) as p, count(*) - sum(label) as q, sum(case when label = 1 then k end) as s from o) select p::bigint as n_pos, q::bigint as n_neg, round((s - p * (p + 1) / 2.0) / (p * q), 9) as auroc from g")
def m07_auroc(spark, d):
    return metrics.auroc(split_events(spark, d).where("split = 'deploy'")).select("n_pos", "n_neg", r("auroc").alias("auroc"))


@query("select sensor, min(label)::double as min, quantile_cont(f5, 0.5)::double as median, max(f5)::double as max, round(avg(f5), 4) as mean, count(f5) as n from flows where f5 is not null group by sensor".replace("min(label)", "min(f5)"))
def r01_r02_summary(spark, d):
    s = metrics.summary(table(spark, d, "flows").withColumn("v", F.col("f5").cast("double")).where("v is not null"), ["sensor"], "v")
    return s.select("sensor", "min", "median", "max", r("mean", 4).alias("mean"), "n")


@query(f"with {_lond_sql('uniform')} select count_if(fired) as alerts, count_if(fired and ismal) as tp, count_if(fired and not ismal) as fp, round(count_if(fired and not ismal) / nullif(count_if(fired), 0), 9) as fdp, round(count_if(fired and ismal) / nullif(count_if(ismal), 0), 9) as recall, round(count_if(silent) / count(*), 9) as silent_share from c join s on s.pos = c.pos")
def r03_rates(spark, d):
    s = stream(spark, d)
    m = metrics.rates(s.select("pos", "ismal").join(controllers.control(s, "elond", kind="uniform"), "pos"))
    return m.select("alerts", "tp", "fp", r("fdp").alias("fdp"), r("recall").alias("recall"), r("silent_share").alias("silent_share"))


@query(f"with {EV} select round(avg(case when label = 1 then (e > 0)::int end), 9) as mal_rate, round(avg(case when label = 0 then (e > 0)::int end), 9) as benign_rate, round(avg(case when label = 0 then (e > 0)::int end) * max(ceiling), 6) as benign_ratio from ev")
def r06_tail_reach(spark, d):
    return metrics.tail_reach(evident(spark, d)).select(r("mal_rate").alias("mal_rate"), r("benign_rate").alias("benign_rate"), r("benign_ratio", 6).alias("benign_ratio"))


_FRONT = f"{EP}, fr as (select row_number() over w as k, sum(ismal::int) over (w rows unbounded preceding) as tp, sum(ismal::int) over () as m from s window w as (order by smax desc, pos))"


@query(f"with {_FRONT} select k, tp::bigint as tp, (k - tp)::bigint as fp, round((k - tp) / k, 9) as fdp, round(tp / m, 9) as recall from fr")
def w06_frontier(spark, d):
    f = metrics.frontier(stream(spark, d))
    return f.select(F.col("k").cast("long").alias("k"), "tp", "fp", r("fdp").alias("fdp"), r("recall").alias("recall"))


@query(f"with {_FRONT} select round(0.5 * max(case when k = 10 then tp end) + 0.5 * max(case when k = 11 then tp end), 6) as tp, round(0.5 * max(case when k = 10 then k - tp end) + 0.5 * max(case when k = 11 then k - tp end), 6) as fp from fr")
def w07_at_budget(spark, d):
    return metrics.frontier_at_budget(metrics.frontier(stream(spark, d)), 10.5).select(r("tp", 6).alias("tp"), r("fp", 6).alias("fp"))


@query(f"with {_FRONT} select k, tp::bigint as tp, round((k - tp) / k, 9) as fdp from fr where (k - tp) / k <= 0.2 order by tp desc, (k - tp) / k limit 1")
def w08_at_fdp(spark, d):
    return metrics.frontier_at_fdp(metrics.frontier(stream(spark, d)), 0.2).select(F.col("k").cast("long").alias("k"), "tp", r("fdp").alias("fdp"))


@query(f"with {EP} select pos, round(sum(ev) over (order by pos desc rows unbounded preceding), 4) as tail from s")
def w09_tails(spark, d):
    return metrics.suffix_sums(stream(spark, d), "pos", "ev").select(F.col("pos").cast("long").alias("pos"), r("tail", 4).alias("tail"))


@query(f"with {EP}, k as (select rank() over (order by nsz) + (count(*) over (partition by nsz) - 1) / 2.0 as a, rank() over (order by smax) + (count(*) over (partition by smax) - 1) / 2.0 as b from s) select count(*) as n, round(corr(a, b), 9) as rho from k")
def w10_spearman(spark, d):
    return metrics.spearman(stream(spark, d), "nsz", "smax").select("n", r("rho").alias("rho"))


@query(f"with {Z}, e as (select min(ts) as a, max(ts) as b from dep) select least(floor((ts - a) / (b - a)::double * 10), 9)::int as bin, count(*) as n from dep, e group by 1")
def w11_histogram(spark, d):
    f = split_events(spark, d).where("split = 'deploy'")
    lo, hi = f.agg(F.min("ts"), F.max("ts")).first()
    return metrics.time_histogram(f, "ts", lo, hi)


@query("with c as (select coalesce(src, '?') as src, count(*) as c from flows group by 1), o as (select *, sum(c) over (order by c desc, src) as cum, row_number() over (order by c desc, src) as i, sum(c) over () as n from c) select max(n)::bigint as n, count(*) as n_values, round(sum(case when i <= 10 then c end) / max(n), 9) as top_share, round(sum((c / n) * (c / n)), 9) as hhi, count_if(cum - c < 0.9 * n) as n_for_mass from o")
def r07_concentration(spark, d):
    c = metrics.concentration(table(spark, d, "flows").select(F.coalesce("src", F.lit("?")).alias("src")), "src", 10)
    return c.select("n", "n_values", r("top_share").alias("top_share"), r("hhi").alias("hhi"), "n_for_mass")


@query("with t as (select src, dst from flows group by 1, 2 order by count(*) desc, src, dst limit 5) select count(*) as n, sum(label)::bigint as malicious from flows where src is not null and dst is not null and (src, dst) not in (select (src, dst) from t)")
def r08_without_top(spark, d):
    f = table(spark, d, "flows").where("src is not null and dst is not null")
    return metrics.without_top(f, KEYS, 5).agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("malicious"))


@query("with t as (select f5::double as s from flows where split = 'cal' and label = 0 and f5 is not null), o as (select s from t order by s desc limit 2) select (select max(s) - min(s) from o) as gap, round(quantile_cont(s, 0.75) - quantile_cont(s, 0.25), 6) as iqr from t")
def r09_score_gap(spark, d):
    c = table(spark, d, "flows").where("split = 'cal' and label = 0 and f5 is not null").select(F.col("f5").cast("double").alias("score"))
    return metrics.score_gap(c).select("gap", r("iqr", 6).alias("iqr"))


@query()
def r10_clopper_pearson(spark, d):
    t = evident(spark, d).where("label = 0").agg(F.count_if(F.col("e") > 0).alias("k"), F.count("*").alias("n")).first()
    return spark.createDataFrame([(t.k, t.n, *(round(x, 9) for x in special.clopper_pearson(t.k, t.n)))], "k long, n long, low double, high double")


@query("with c as (select sensor, count_if(label = 1) as k, count(*) as n from flows where label is not null group by sensor), z as (select *, 1.959963984540054::double as z, k / n as p from c) select sensor, k, n, round(greatest(0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)), 9) as low, round(least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)), 9) as high from z")
def r11_wilson(spark, d):
    g = table(spark, d, "flows").where("label is not null").groupBy("sensor").agg(F.count_if(F.col("label") == 1).alias("k"), F.count("*").alias("n"))
    lo, hi = metrics.wilson_columns(F.col("k"), F.col("n"))
    return g.select("sensor", "k", "n", r(lo).alias("low"), r(hi).alias("high"))


@query("with c as (select dport, count(*) as c from meta where dport is not null group by 1 having count(*) >= 50 order by 2 desc, 1 limit 5) select case when c.dport is null then 'other' else meta.dport::varchar end as stratum, count(*) as n from meta left join c on c.dport = meta.dport group by 1")
def r12_strata(spark, d):
    return metrics.strata(table(spark, d, "meta").select("dport"), "dport", 50, 5).groupBy("stratum").agg(F.count("*").alias("n"))


_POIS = ", ".join(repr(c) for c in bootstrap._POISSON)


def _weight(cluster: str, seed: int) -> str:
    return f"len(list_filter([{_POIS}], lambda c: c <= {uniform_sql(cluster, 'rep', str(seed))}))"


@query(f"""with {Z}, cc as (select src, score from cal where label = 0), tt as (select src, score from dep where label = 0), g as (select unnest(range(0, 200)) as rep),
cw as (select rep, src, {_weight("src", 1)} as w from (select distinct src from cc), g), tw as (select rep, src, {_weight("src", 0)} as w from (select distinct src from tt), g),
cs as (select src, score, count(*) as c from cc group by 1, 2), cum as (select rep, score, sum(w * c) over (partition by rep order by score desc) as cum from cs join cw using (src)),
th as (select rep, max(score) as threshold from cum where cum >= 1 group by rep),
num as (select th.rep, sum(tw.w) as k from th join tt on tt.score > th.threshold join tw on tw.rep = th.rep and tw.src = tt.src group by 1), den as (select tw.rep, sum(w * n) as n from tw join (select src, count(*) as n from tt group by src) using (src) group by 1),
bt as (select th.rep, threshold, coalesce(k, 0) / nullif(n, 0) * ((select count(*) from cc) + 1) as ratio from th join den using (rep) left join num using (rep)),
o as (select count_if(score > (select max(score) from cc)) as events, count_if(score > (select max(score) from cc)) / count(*) * ((select count(*) from cc) + 1) as point from tt)
select count_if(ratio > 0) as n, round(stddev_samp(case when ratio > 0 then ln(ratio) end), 9) as log_sd, round(min(point), 9) as point, min(events) as events,
  round(case when min(events) >= 5 and min(point) > 0 and count_if(ratio > 0) >= 0.9 * count(*) and coalesce(stddev_samp(case when ratio > 0 then ln(ratio) end), 0) > 0 then ln(min(point)) / stddev_samp(case when ratio > 0 then ln(ratio) end) end, 6) as z,
  min(events) >= 5 and min(point) > 0 and count_if(ratio > 0) >= 0.9 * count(*) and coalesce(stddev_samp(case when ratio > 0 then ln(ratio) end), 0) > 0 as estimable from bt, o""")
def r13_r14_bootstrap(spark, d):
    """Joint bootstrap of the benign firing rate: calibration tail and deployment resampled over sources, and the test of a ratio above 1."""
    s = split_events(spark, d)
    test, cal = s.where("split = 'deploy' and label = 0").select("src", "score"), s.where("split = 'cal' and label = 0").select("src", "score")
    reps = bootstrap.firing_ratio(test, cal, ["src"], 200)
    kth, n = cal.agg(F.max("score"), F.count("*")).first()
    x = test.agg(F.count_if(F.col("score") > F.lit(kth)).alias("x"), F.count("*").alias("n")).first()
    return bootstrap.ratio_test(reps, x.x / x.n * (n + 1), x.x).select("n", r("log_sd").alias("log_sd"), r("point").alias("point"), F.col("events").cast("long").alias("events"), r("z", 6).alias("z"), "estimable")


@query("with m as (select distinct sensor as a, src as m from flows where split = 'deploy' and src is not null), z as (select a, count(*) as n from m group by a), p as (select x.a as a, y.a as b, count(*) as k from m x join m y on x.m = y.m and x.a < y.a group by 1, 2) select p.a, p.b, k as both, (u.n + v.n - k)::bigint as either, round(k / (u.n + v.n - k), 9) as jaccard from p join z u on u.a = p.a join z v on v.a = p.b")
def r15_jaccard(spark, d):
    j = metrics.jaccard(table(spark, d, "flows").where("split = 'deploy' and src is not null"), "sensor", "src")
    return j.select("a", "b", "both", "either", r("jaccard").alias("jaccard"))


@query(f"with {EP} select round(100 * avg(case when nsz < 15 then 1.0 when nsz = 15 then 0.5 else 0.0 end), 6) as percentile from s")
def r16_mid_rank(spark, d):
    return metrics.mid_rank(stream(spark, d), "nsz", F.lit(15)).select(r("percentile", 6).alias("percentile"))


def _grid(spark: SparkSession, d: str) -> DataFrame:
    """Share of malicious flows per split (window) and sensor (choice)."""
    f = table(spark, d, "flows").where("split is not null and label is not null")
    g = f.groupBy(F.col("split").alias("win"), F.col("sensor").alias("choice")).agg(F.round(F.avg((F.col("label") == 1).cast("double")), 6).alias("v"))
    return g.withColumn("prio", F.length("choice"))


_GRID = "gr as (select split as win, sensor as choice, round(avg((label = 1)::int), 6) as v, length(sensor) as prio from flows where split is not null and label is not null group by 1, 2)"


@query(f"with {_GRID} select win, arg_max(choice, v) as choice, max(v) as v from gr group by win")
def r17_best(spark, d):
    return metrics.best_of(_grid(spark, d), ["win"], "choice", "v", "prio")


@query(f"with {_GRID}, b as (select win, arg_max(choice, v) as choice from gr group by win), n as (select win, lead(win) over (order by win) as nx from b), x as (select win, max(v) as hi, min(v) as lo from gr group by win) select n.nx as win, b.choice, round((hi - v) / nullif(hi - lo, 0), 6) as regret from n join b on b.win = n.win join gr on gr.win = n.nx and gr.choice = b.choice join x on x.win = n.nx")
def r18_previous(spark, d):
    t = metrics.transfer_previous(_grid(spark, d), "win", "choice", "v", "prio")
    return t.select("win", "choice", r("regret", 6).alias("regret"))


@query()
def r18_left_out(spark, d):
    return metrics.transfer_left_out(_grid(spark, d), "win", "choice", "v", "prio").select("win", "choice", r("regret", 6).alias("regret"))


@query("""with f as (select sensor, count_if(label = 0) / count(*) as fdp from flows where split = 'deploy' and f5 > 10000 and label is not null group by sensor), g as (select unnest([0.0, 0.05, 0.1])::double as eps0), h as (select unnest([0.0, 0.02])::double as eps1)
select round(fdp, 9) as fdp, eps0, eps1, round(fdp * (1 - eps0) + (1 - fdp) * eps1, 9) as corrected from f, g, h""")
def r20_corrected(spark, d):
    """FDP of alerts on large transfers, per sensor, corrected for label noise."""
    f = table(spark, d, "flows").where("split = 'deploy' and f5 > 10000 and label is not null").groupBy("sensor").agg(F.avg((F.col("label") == 0).cast("double")).alias("fdp"))
    grid = spark.createDataFrame([(a, b) for a in (0.0, 0.05, 0.1) for b in (0.0, 0.02)], "eps0 double, eps1 double")
    return metrics.corrected_fdp(f, grid).select(r("fdp").alias("fdp"), "eps0", "eps1", r("corrected").alias("corrected"))


@query("with p as (select log10(f2::double / ((f3 + f4)::double / f0::double)) as x from flows where f0 > 0 and f2 > 0 and f3 + f4 > 0 and f2 < 1e30 and f0 < 1e30), s as (select unnest([1.0, 1e-3, 1e-6])::double as scale), e as (select scale, quantile_cont(abs(x + log10(scale)), 0.5) as err from p, s group by scale) select arg_min(scale, err) as scale, round(min(err), 6) as error from e")
def r22_units(spark, d):
    f = table(spark, d, "flows").where("f0 > 0 and f2 > 0 and f3 + f4 > 0 and f2 < 1e30 and f0 < 1e30").select(F.col("f2").cast("double").alias("a"), ((F.col("f3") + F.col("f4")).cast("double") / F.col("f0").cast("double")).alias("b"))
    return metrics.unit_scale(f, "a", "b", [1.0, 1e-3, 1e-6]).select("scale", r("error", 6).alias("error"))


_OK = "f3 + f4 < 1e15 and f5 + f6 < 1e15 and label = 0"


@query(f"select count(*) as n, sum((f3 + f4)::double) as packets, sum((f5 + f6)::double) + 40 * sum((f3 + f4)::double) as bytes from flows where {_OK}")
def r23_cost(spark, d):
    return metrics.flow_cost(table(spark, d, "flows").where(_OK).withColumns({c: F.col(c).cast("double") for c in ("f3", "f4", "f5", "f6")}), 40)


@query(f"with c as (select (f5 + f6)::double as c from flows where {_OK}), b as (select unnest([10, 100])::int as budget) select budget, " + ", ".join(f"round(budget * (select quantile_cont(c, {q}) from c), 4) as {n}" for n, q in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))) + " from b")
def r27_budgets(spark, d):
    b = metrics.budget_costs(table(spark, d, "flows").where(_OK), [10, 100], (F.col("f5") + F.col("f6")).cast("double"))
    return b.select("budget", *[r(c, 4).alias(c) for c in ("p10", "p50", "p90")])


@query(f"with o as (select sensor, (f5 + f6)::double as c, row_number() over (partition by sensor order by (f5 + f6)::double, ingest_id) as i from flows where {_OK}), b as (select unnest([10, 100])::int as budget) select sensor, budget, count(*) as n, sum(c) as total from o, b where i <= budget group by 1, 2")
def r23_cheapest(spark, d):
    return metrics.cumulative_cheapest(table(spark, d, "flows").where(_OK), [10, 100], (F.col("f5") + F.col("f6")).cast("double"), "sensor")


@query(f"select count(*) as n, round((max(ts) - min(ts)) / 3.6e9, 6) as hours, count(distinct src) as hosts, round(1000.0 * ((max(ts) - min(ts)) / 3.6e9) / count(*), 6) as hours_needed from flows where {_OK} and ts > 0")
def r23_rate(spark, d):
    x = metrics.rate_and_hosts(table(spark, d, "flows").where(f"{_OK} and ts > 0"), 1000)
    return x.select("n", r("hours", 6).alias("hours"), "hosts", r("hours_needed", 6).alias("hours_needed"))


@query(f"with {Z}, e as (select min(ts) as a, max(ts) + 1 as b from dep), h as (select unnest([0, 3600000000, 86400000000])::bigint as shift) select shift, min(a + ((ts - a + shift) % (b - a))) as lo, sum((a + ((ts - a + shift) % (b - a))) % 1000)::bigint as checksum from dep, e, h where label = 1 group by shift")
def r24_shift_null(spark, d):
    f = split_events(spark, d).where("split = 'deploy'")
    lo, hi = f.agg(F.min("ts"), F.max("ts")).first()
    s = metrics.shifted(f.where("label = 1"), [0, 3600000000, 86400000000], lo, hi + 1)
    return s.select(F.col("shift").cast("long").alias("shift"), "ts").groupBy("shift").agg(F.min("ts").alias("lo"), F.sum(F.col("ts") % 1000).alias("checksum"))


@query(f"""with {EP}, e as (select rep, pos, ismal, row_number() over (partition by rep order by pos) as i, row_number() over (partition by rep order by {draw_sql("0", "rep", "pos")}, pos) as j from s, (select unnest(range(0, 20)) as rep))
select a.rep::int as rep, count_if(b.ismal) as malicious, count(*) as t, coalesce(sum(case when b.ismal then a.pos end), 0)::bigint as places from e a join e b on a.rep = b.rep and a.i = b.j group by a.rep""")
def r24_label_null(spark, d):
    return metrics.permuted_labels(stream(spark, d), 20).groupBy("rep").agg(F.count_if("ismal").alias("malicious"), F.count("*").alias("t"), F.coalesce(F.sum(F.when(F.col("ismal"), F.col("pos"))), F.lit(0)).alias("places"))


@query()
def r25_sweep(spark, d):
    """Family by bucket by gamma: one controller per combination, all in parallel."""
    f, out = evident(spark, d), None
    for fam in ("src-dst", "src", "dst"):
        g, keys = episodes.with_family(f, fam)
        for b in (86400, None):
            e = episodes.ordered(episodes.build(g, keys, b), keys).select(F.lit(fam).alias("family"), F.lit(b or 0).alias("bucket_s"), "pos", "ev", "ceiling", "ismal")
            out = e if out is None else out.unionByName(e)
    run = None
    for kind in ("poly", "uniform"):
        c = controllers.control(out, "elond", ["family", "bucket_s"], kind).withColumn("gamma", F.lit(kind))
        run = c if run is None else run.unionByName(c)
    j = run.join(out.select("family", "bucket_s", "pos", "ismal"), ["family", "bucket_s", "pos"])
    return metrics.rates(j, ["family", "bucket_s", "gamma"]).select("family", "bucket_s", "gamma", "alerts", "tp", "t", "silent")


@query(f"""with recursive {EP}, tt as (select seed, src, dst, ev, ceiling, ismal, n, row_number() over (partition by seed order by first_ts - first_ts % 3600000000, {draw_sql("seed", "src", "dst", "0")}, src, dst) as pos from s, (select unnest(range(0, 50)) as seed)),
c as (select seed, 0::bigint as pos, 0::bigint as r, false as fired, false as ismal from (select unnest(range(0, 50)) as seed) union all
  select seed, pos, r + ok::bigint, ok, ismal from (select *, ceiling >= 1 / level and ev >= 1 / level as ok from (select c.seed, tt.pos, c.r, tt.ev, tt.ceiling, tt.ismal, {A} * {GAMMA["poly"]("tt.pos")} * (c.r + 1) as level from c join tt on tt.seed = c.seed and tt.pos = c.pos + 1))),
v as (select seed, count_if(fired and ismal) / nullif(count_if(ismal), 0) as recall from c where pos > 0 group by seed)
select count(*) as n, count(distinct recall) as n_distinct, round(avg((recall is null)::int), 9) as undefined, round(stddev_samp(recall), 9) as sd, round(100 * avg(case when recall < 0.1 then 1 when recall = 0.1 then 0.5 when recall > 0.1 then 0 end), 6) as percentile from v""")
def r26_tie_orders(spark, d):
    """Recall over 50 orders that break the many ties of whole hours at random, one controller per order."""
    base = episodes.build(evident(spark, d), KEYS).withColumn("first_ts", F.col("first_ts") - F.pmod("first_ts", F.lit(3_600_000_000)))
    o = episodes.tie_orders(base, KEYS, 50).select("seed", "pos", "ev", "ceiling", "ismal")
    run = controllers.control(o, "elond", ["seed"]).join(o.select("seed", "pos", "ismal"), ["seed", "pos"])
    t = metrics.tie_distribution(metrics.rates(run, ["seed"]), "recall", 0.1)
    return t.select("n", "n_distinct", r("undefined").alias("undefined"), r("sd").alias("sd"), r("percentile", 6).alias("percentile"))


@query()
def r28_silence_identity(spark, d):
    """Silent hypotheses of an epoch without rejections are those beyond its feasible window: epochs, silent ones in all, epochs that break the rule."""
    s = episodes.epochs(stream(spark, d), 6 * 3600).withColumn("ev", F.lit(0.0))
    c = s.agg(F.max("ceiling")).first()[0]
    per = controllers.restarted(s, "elond", allocation="each").groupBy("epoch").agg(F.count_if("fired").alias("alerts"), F.count_if("silent").alias("silent"), F.count("*").alias("t"))
    per = per.withColumn("window", F.lit(spending.cold_window("poly", c, ALPHA, 1_000_000)))
    broken = metrics.silence_identity(per).agg(F.count("*").alias("broken"))
    return per.agg(F.count("*").alias("epochs"), F.sum("silent").alias("silent")).join(F.broadcast(broken))  # one row


@query()
def r29_lever(spark, d):
    s = stream(spark, d)
    t, nc, rows = s.count(), s.agg(F.max("ceiling")).first()[0] - 1, None
    for q in (0.05, 0.1):
        for kind in ("poly", "uniform"):
            x = metrics.rates(s.select("pos", "ismal").join(controllers.control(s, "elond", kind=kind, alpha=q), "pos")).select(F.lit(q).alias("q"), F.lit(kind).alias("gamma"), F.lit(attack.margin(int(nc), t, q / 2)).alias("margin"), "recall")
            rows = x if rows is None else rows.unionByName(x)
    return metrics.lever(rows).select("q", "gamma", r("margin_ratio").alias("margin_ratio"), r("q_ratio").alias("q_ratio"), r("recall").alias("recall"))


@query(f"""with {Z}, g as (select unnest([0, 1, 5, 20])::int as a), q as (select seed, score, row_number() over (partition by seed order by {draw_sql("seed", "ingest_id")}, ingest_id) as i from cal, (select unnest(range(0, 400)) as seed) where label = 1),
th as (select a, sd.seed, greatest((select max(score) from cal where label = 0), max(case when i <= a then score end)) as t from g cross join (select unnest(range(0, 400)) as seed) sd left join q on q.seed = sd.seed group by a, sd.seed),
v as (select a, (select count_if(score > t) / nullif(count(*), 0) from dep where label = 1) as recall from th),
w as (select a, count(recall) as n, quantile_cont(recall, 0.05) as p05, quantile_cont(recall, 0.5) as p50, quantile_cont(recall, 0.95) as p95, count_if(recall = 0) as zeros from v group by a), zz as (select *, 1.959963984540054::double as z, zeros / n as p from w)
select a, n, round(p05, 9) as p05, round(p50, 9) as p50, round(p95, 9) as p95, zeros, round(p, 9) as p_zero, round(greatest(0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)), 9) as low, round(least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)), 9) as high from zz""")
def r30_contamination(spark, d):
    """Recall over 400 draws for each number of malicious scores in the calibration."""
    s = split_events(spark, d)
    runs = evidence.contaminated_recall(s.where("split = 'deploy'"), s.where("split = 'cal' and label = 0"), s.where("split = 'cal' and label = 1"), [0, 1, 5, 20], 400)
    return metrics.contamination_spread(runs, ["a"]).select("a", "n", *[r(c).alias(c) for c in ("p05", "p50", "p95")], "zeros", r("p_zero").alias("p_zero"), r("low").alias("low"), r("high").alias("high"))


_RANKED = f"{Z}, c as (select score from cal where label = 0), rk as (select label, (select count(*) from c where c.score > dep.score) as above, (select count(*) from c where c.score = dep.score) as ties, (select count(*) from c) as nc from dep)"


@query(f"with {_RANKED} select count(*) as n, round(avg(greatest(0, least(1, ({A} * (nc + 1) - above) / (1 + ties)))), 9) as probability from rk where label = 0")
def r31_validity(spark, d):
    s = split_events(spark, d)
    k = evidence.ranks(s.where("split = 'deploy'"), s.where("split = 'cal' and label = 0")).where("label = 0")
    return metrics.randomised_validity(k, ALPHA).select("n", r("probability").alias("probability"))


@query(f"""with {_RANKED}, ids as (select dep.ingest_id, (select count(*) from c where c.score > dep.score) as above, (select count(*) from c where c.score = dep.score) as ties, (select count(*) from c) as nc from dep),
p as (select ingest_id, avg(((above + {uniform_sql("ingest_id", "k", "0")} * (1 + ties)) / (nc + 1) <= 0.01)::int) as p from ids, (select unnest(range(0, 20)) as k) group by ingest_id) select round(sum(p * p) / nullif(sum(2 * p - p * p), 0), 9) as jaccard from p""")
def r32_inclusion(spark, d):
    s = split_events(spark, d)
    k = evidence.draws(evidence.ranks(s.where("split = 'deploy'"), s.where("split = 'cal' and label = 0")), "ingest_id", 20)
    p = k.withColumn("fired", evidence.smoothed_p(F.col("above"), F.col("ties"), F.col("nc"), F.col("u")) <= 0.01)
    return metrics.inclusion_jaccard(metrics.detection_probability(p, ["ingest_id"])).select(r("jaccard").alias("jaccard"))


@query(f"with {EP}, m as (select quantile_cont(smax, 0.9) as q from s) select case when nsz = 1 then '1' when nsz <= 4 then '2-4' when nsz <= 16 then '5-16' else '17+' end as bin, count(*) as n, round(avg((smax > q)::int), 9) as over from s, m where not ismal group by 1")
def r33_arity(spark, d):
    s = stream(spark, d)
    q = s.agg(F.percentile("smax", F.lit(0.9))).first()[0]
    return metrics.arity_coverage(s, F.lit(q)).select("bin", "n", r("over").alias("over"))


@query(f"with {EP}, g as (select count(*) / ((max(first_ts) - min(first_ts)) / 3.6e9) as x from s) select round(x, 6) as groups_per_hour, round(1000 / x, 4) as hours_needed from g")
def r34_calendar(spark, d):
    return metrics.calendar_need(stream(spark, d), 1000).select(r("groups_per_hour", 6).alias("groups_per_hour"), r("hours_needed", 4).alias("hours_needed"))


@query("select label_src::varchar as value, count(*) as n, round(avg((label = 1)::int), 9) as rate from flows join meta using (ingest_id) where label is not null group by 1")
def r36_leakage(spark, d):
    j = table(spark, d, "flows").select("ingest_id", "label").join(table(spark, d, "meta").select("ingest_id", F.col("label_src").cast("string").alias("label_src")), "ingest_id")
    return metrics.leakage_audit(j, "label_src").select("value", "n", r("rate").alias("rate"))


# ---- attack costs and feasibility ----


def _priced(spark, d, kind: str = "uniform") -> DataFrame:
    s = stream(spark, d)
    run = s.join(controllers.elond_native(s, kind).select("pos", "level", "fired", "silent"), "pos").withColumn("tau", 1.0 / F.col("level"))
    return attack.price_alerts(run)


_PRICED = f"{_lond_sql('uniform')}, pr as (select s.*, c.level, 1 / c.level as tau, greatest(floor(s.sum_e / (1 / c.level) - s.nsz)::bigint + 1, 0) as r_star from c join s on s.pos = c.pos where c.fired and s.ismal)"


@query(f"with {_PRICED} select pos, r_star from pr")
def x01_zero_pads(spark, d):
    return _priced(spark, d).select(F.col("pos").cast("long").alias("pos"), "r_star")


@query(f"with {_PRICED} select pos, round((sum_e - tau * nsz) / (tau - 1), 6) as pads from pr where tau > 1")
def x02_mean_pads(spark, d):
    p = _priced(spark, d).where("tau > 1")
    return p.select(F.col("pos").cast("long").alias("pos"), r(attack.mean_pads(F.col("sum_e"), F.col("tau"), F.col("nsz"), F.lit(1.0)), 6).alias("pads"))


@query(f"""with {_PRICED}, m as (select r_star, list_min(list_filter(range(0, r_star + 3), lambda x: sum_e / (nsz + x) < tau)) as measured from pr)
select count(*) as n, coalesce(count_if(measured = r_star), 0)::bigint as equal, coalesce(max(abs(measured - r_star)), 0)::bigint as max_gap from m""")
def x03_price_error(spark, d):
    """The closed price against the first number of pads that does, by search."""
    p = _priced(spark, d)
    below = lambda x: F.col("sum_e") / (F.col("nsz") + x) < F.col("tau")
    lo, hi = F.greatest(F.col("r_star") - 2, F.lit(0)), F.col("r_star") + 2  # beyond two from the price on either side the mean is monotone
    measured = F.array_min(F.filter(F.sequence(lo, hi), below))
    return attack.price_error(p, measured)


@query()
def x04_confidence(spark, d):
    """Pads for 90 % at the observed firing rate of benign deployed flows; alerts are priced in tasks."""
    seen = evident(spark, d).where("label = 0").agg(F.avg((F.col("e") > 0).cast("double"))).first()[0]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"pos": pdf["pos"], "pads": pd.array([attack.pads_for_confidence(p.sum_e, p.tau, p.nsz, seen, p.ceiling) for p in pdf.itertuples()], dtype="Int64")})

    return _priced(spark, d).select("pos", "sum_e", "tau", "nsz", "ceiling").mapInPandas(run, "pos long, pads long")


@query(f"with {_PRICED}, k as (select unnest(range(0, 11))::int as r) select pos, r, round(sum_e / (nsz + r), 6) as ev from pr, k")
def x05_dilution(spark, d):
    p = _priced(spark, d).withColumn("pos", F.col("pos").cast("long"))
    return attack.dilution_curve(p, ["pos"], 10).select("pos", "r", r("ev", 6).alias("ev"))


@query()
def x06_replay(spark, d):
    """Pads drawn from the evidence of the observed benign flows, as its distinct values (0 and the ceiling) with their counts."""
    seen = evident(spark, d).where("label = 0").groupBy("e").count().orderBy("e").collect()
    return attack.replay(_priced(spark, d), ["pos"], [x["e"] for x in seen], 5, counts=[x["count"] for x in seen])


@query()
def x07_bound(spark, d):
    seen = evident(spark, d).where("label = 0").agg(F.count_if(F.col("e") > 0).alias("k"), F.count("*").alias("n")).first()
    k, n = seen.k, seen.n

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"pos": pdf["pos"], "r_star": pdf["r_star"], "at_bound": pd.array([attack.pads_at_bound(p.sum_e, p.tau, p.nsz, k, n, p.ceiling) for p in pdf.itertuples()], dtype="Int64")})

    return _priced(spark, d).select("pos", "r_star", "sum_e", "tau", "nsz", "ceiling").mapInPandas(run, "pos long, r_star long, at_bound long")


@query(f"with {_PRICED}, k as (select unnest([50, 100, 1000])::bigint as cap) select cap, count(*) as n, round(avg((nsz + r_star <= cap)::int), 9) as share from pr, k group by cap")
def x07_volume_cap(spark, d):
    return attack.volume_cap(_priced(spark, d), [50, 100, 1000]).select("cap", "n", r("share").alias("share"))


@query()
def x23_live(spark, d):
    """Every own episode under greedy and multiplier attacks, 100 trajectories each, with pads drawn from the benign flows to the
    victim before the attacker's last flow, and (as the fixture's only victim has none) from those to anyone."""
    s, flows = stream(spark, d), evident(spark, d)
    last = flows.where("label = 1").groupBy(*KEYS).agg(F.max("ts").alias("t_atk"))
    own = s.where("ismal").select("pos", *KEYS).join(last, KEYS).withColumn("anyone", F.lit(0))
    cal = split_events(spark, d).where("split = 'cal' and label = 0").select("ts", "dst", F.lit(0.0).alias("e"), F.lit(False).alias("deployed"))
    benign = flows.where("label = 0").select("ts", "dst", "e", F.lit(True).alias("deployed")).unionByName(cal).withColumn("anyone", F.lit(0))
    ep = s.select("pos", "bucket", "sum_e", "nsz", "ismal", F.col("mal").alias("m_atk"), "ceiling").toPandas().sort_values("pos")  # one row per episode
    t, ceiling, out = len(ep), float(ep["ceiling"].iloc[0]), None
    for pool, victim in (("victim", ["dst"]), ("anyone", ["anyone"])):
        seen = attack.pad_pools(own, benign, victim).select("pos", "t_atk", "pool_n", "pool_fired").toPandas()  # one row per own episode
        each = ep.merge(seen, "left", "pos").fillna({"t_atk": 0, "pool_n": 0, "pool_fired": 0})
        for kind in ("poly", "uniform"):
            x = attack.live_attacks(spark, each, ceiling, kind, ALPHA, 100, [int(ceiling * ALPHA / t) + 1, 3]).select(F.lit(pool).alias("pool"), F.lit(kind).alias("gamma"), "*")
            out = x if out is None else out.unionByName(x)
    return out


@query(f"with {_PRICED}, a as (select s.src % 4 as org, c.fired and s.ismal as hit, greatest(floor(s.sum_e * c.level - s.nsz)::bigint + 1, 0) as pads from c join s on s.pos = c.pos) select org, count_if(hit) as detected, count_if(hit and pads > 0) as suppressible from a group by org")
def r37_by_organisation(spark, d):
    s = stream(spark, d)
    run = s.join(controllers.elond_native(s, "uniform").select("pos", "level", "fired"), "pos")
    run = run.withColumns({"org": F.col("src") % 4, "pads": attack.zero_pads(F.col("sum_e"), 1.0 / F.col("level"), F.col("nsz"))})
    return metrics.by_group_rates(run, "org")


@query(f"with {_PRICED}, k as (select unnest([1, 10, 100, 1000])::bigint as cap) select cap, count(*) as n, round(avg((r_star <= cap)::int), 9) as share from pr, k group by cap")
def x08_rate_limit(spark, d):
    x = attack.rate_limit(_priced(spark, d), [1, 10, 100, 1000])
    return x.select("cap", "n", r("share").alias("share"))


@query(f"with {_PRICED}, k as (select unnest([1, 5, 50])::double as factor) select factor, count(*) as n, count_if(ceil(factor * nsz) >= r_star) as suppressed from pr, k group by factor")
def x09_multiplier(spark, d):
    return attack.multiplier(_priced(spark, d), [1, 5, 50])


@query(f"with {_PRICED}, k as (select unnest([10, 100])::bigint as pads) select pads, count(*) as n, count_if(pads >= r_star) as suppressed from pr, k group by pads")
def x09_absolute(spark, d):
    return attack.absolute(_priced(spark, d), [10, 100])


def _whole(s: DataFrame, run, schema: str) -> DataFrame:
    """A procedure that revises the whole stream, in one task (one row per episode, not per flow): ``run`` gets evidence, sizes, labels and the ceiling, in order, and gives rows."""
    names = [c.split()[0] for c in schema.split(", ")]

    def task(batches):
        pdf = pd.concat(list(batches))
        if len(pdf):
            pdf = pdf.sort_values("pos")
            rows = run(pdf["ev"].to_numpy(), pdf["nsz"].to_numpy(), pdf["ismal"].to_numpy(), float(pdf["ceiling"].iloc[0]))
            yield pd.DataFrame(rows, columns=names)

    return s.select("pos", "ev", "nsz", "ismal", "ceiling").repartition(1).mapInPandas(task, schema)


@query()
def x10_joint(spark, d):
    def run(e, n, m, c):
        rows = []
        for adaptive, cap in ((True, None), (False, None), (True, 20)):
            x = attack.joint_attack(e, n, m, c, "uniform", ALPHA, cap, adaptive)
            rows += [(adaptive, cap, o, int(k)) for o, k in x["outcome"].value_counts().items()]
        return rows

    return _whole(stream(spark, d), run, "adaptive boolean, cap int, outcome string, n int")


@query(f"with {_PRICED}, c1 as (select max(sum_e / tau / nsz - 1) as x from pr) select round(x, 6) as c_crit, (floor(x) + 1)::bigint as c_int from c1")
def x11_critical(spark, d):
    return attack.critical_multiplier(_priced(spark, d)).select(r("c_crit", 6).alias("c_crit"), "c_int")


@query(f"with {_lond_sql('poly')} select s.pos, greatest(ceil(ln(1 / (c.level * s.ceiling)) / ln(0.5::double)), 0)::bigint as pads from c join s on s.pos = c.pos")
def x12_front_load(spark, d):
    """Flows to send first under halving weights so that the weight left stays below the offered level, per episode."""
    s = stream(spark, d)
    run = s.join(controllers.elond_native(s).select("pos", "level"), "pos")
    return run.select(F.col("pos").cast("long").alias("pos"), attack.front_load(F.lit(0.5), 1.0 / F.col("level"), F.col("ceiling")).alias("pads"))


@query("with f as (select ingest_id, src, row_number() over (partition by src order by ts, ingest_id) as arrival, f5 > 10000 as hit from flows where ts is not null and src is not null), h as (select src, arrival, row_number() over (partition by src order by arrival) as i from f where hit) select src, greatest(100 - arrival + 1, 0)::bigint as pads from h where i = 3")
def x13_cap_front_load(spark, d):
    f = table(spark, d, "flows").where("ts is not null and src is not null").select("ingest_id", "ts", "src", F.when(F.col("f5") > 10000, 1.0).otherwise(0.0).alias("e"))
    return attack.cap_front_load(episodes.arrival_rank(f, ["src"]), ["src"], 100, F.lit(3)).select("src", F.col("pads").cast("long").alias("pads"))


@query(f"with {_SENSORS}, k as (select unnest([0, 5])::int as r) select sensor, ceiling, r, floor(power(greatest(ceiling * {A} * (r + 1) / {ZETA}::double, 0), 1 / 1.6::double))::bigint as last from ce, k")
def x14_x17_cold_window(spark, d):
    """Last feasible step of each sensor's stream after no and after five rejections, in closed form."""
    c = _sensors(spark, d).select("sensor", "ceiling", F.explode(F.array(F.lit(0), F.lit(5))).alias("r"))
    return c.withColumn("last", F.floor(F.pow(F.col("ceiling") * ALPHA * (F.col("r") + 1) / F.lit(special.zeta(1.6)), F.lit(1 / 1.6))).cast("long"))


_TAIL = lambda a: f"(power({a}, -0.6::double) / 0.6::double + power({a}, -1.6::double) / 2 + 1.6::double * power({a}, -2.6::double) / 12 - 1.6::double * 2.6 * 3.6 * power({a}, -4.6::double) / 720)"


@query(f"""with {_SENSORS}, k as (select unnest([0, 5])::int as r), x as (select sensor, ceiling, {ZETA}::double / (({W} + {A}) * ceiling) as y from ce), a as (select *, floor(power(0.6 * y, -1 / 0.6::double))::bigint as g from x)
select a.sensor, a.ceiling, r, floor(power(a.ceiling * {A} * (r + 1) / {ZETA}::double, 1 / 1.6::double))::bigint as last, list_min(list_filter(range(greatest(g - 3, 1), g + 5), lambda d: {_TAIL("d::double")} < y)) as gap from a, k""")
def x16_deadlines(spark, d):
    """Last feasible step by bisection, and the gap after which summing procedures are silent for good, per sensor (in tasks)."""

    def run(batches):
        for pdf in batches:
            rows = [(s, c, k, attack.deadline(c, ALPHA, "poly", 100_000, k), attack.absorbing_gap(c, ALPHA, W0)) for s, c in zip(pdf["sensor"], pdf["ceiling"]) for k in (0, 5)]
            yield pd.DataFrame(rows, columns=["sensor", "ceiling", "r", "last", "gap"])

    return _sensors(spark, d).select("sensor", "ceiling").mapInPandas(run, "sensor string, ceiling double, r int, last long, gap long")


@query()
def x18_survival(spark, d):
    def run(e, n, m, c):
        fired = controllers.fold(controllers.Lond(spending.gamma("uniform", len(e)), ALPHA), e, c).fired
        return attack.survival_curve(e, fired, c, "uniform", ALPHA, [0, 10, 50, 200])

    return _whole(stream(spark, d), run, "g long, fired long, survived long")


@query()
def x19_blind_key(spark, d):
    """Loss of the first alert in a keyed order when silent episodes of unknown place join its bucket, with N50, N90 and N99."""
    s = episodes.ordered(episodes.build(evident(spark, d), KEYS, 7200), KEYS, "keyed", 7).withColumn("place", uniform(7, *KEYS))
    run = s.join(controllers.elond_native(s).select("pos", "fired"), "pos").where("ev > 0").select("pos", "bucket", "place", "ev", "ceiling", "fired").toPandas()  # episodes with evidence
    if not run["fired"].any():
        return spark.createDataFrame([], "n long, lost double, n50 double, n90 double, n99 double")
    curve = attack.blind_key_curves(spark, run, int(run.loc[run["fired"], "pos"].min()), ALPHA, [1, 10, 50, 100, 200, 1000], 200).toPandas().sort_values("n")  # one row per budget
    q = {f"n{p}": attack.curve_quantile(curve, p / 100) for p in (50, 90, 99)}
    return spark.createDataFrame([(int(a), float(b), *q.values()) for a, b in zip(curve["n"], curve["lost"])], "n long, lost double, n50 double, n90 double, n99 double")


@query()
def x20_addis_state(spark, d):
    def run(e, n, m, c):
        return [(h, attack.addis_budget(e[:h], 1e4, c, "poly", ALPHA, W0, 4 * len(e))) for h in (0, 10, 50)]

    return _whole(stream(spark, d), run, "head int, b_star long")


@query()
def x21_synthetic(spark, d):
    return attack.synthetic_attacks(spark, 300)


@query(f"""with {Z}, k as (select max(m) as cut from (select avg(score) as m from cal where label = 0 group by src, dst)), g as (select src::varchar || '/' || dst as gid, sum(score) as total, count(*) as m from dep group by src, dst having sum(label) > 0),
f as (select g.*, cut from g, k where total / m > cut), o as (select score, sum(cut - score) over (order by score, ingest_id rows unbounded preceding) as saved from dep, k where label = 0 and score < cut)
select gid, case when (select count(*) from o where saved < total - cut * m) < (select count(*) from o) then (select count(*) from o where saved < total - cut * m) + 1 end::bigint as pads from f""")
def x22_cheapest_prefix(spark, d):
    """Fewest benign pads, lowest scores first, after which a firing malicious group's mean score no longer beats the calibration groups'."""
    s = split_events(spark, d)
    cut = s.where("split = 'cal' and label = 0").groupBy(*KEYS).agg(F.avg("score").alias("m")).agg(F.max("m")).first()[0]
    dep = s.where("split = 'deploy'")
    g = dep.groupBy(*KEYS).agg(F.sum("score").alias("total"), F.count("*").alias("m"), F.sum("label").alias("y")).where((F.col("y") > 0) & (F.col("total") / F.col("m") > F.lit(cut)))
    return attack.cheapest_prefixes(g.select(F.concat_ws("/", F.col("src").cast("string"), "dst").alias("gid"), "total", "m"), dep.where("label = 0"), cut)


@query(f"""with {_PRICED}, pool as (select pr.pos, count(ev.ingest_id) as pool_n, coalesce(sum((ev.e > 0)::int), 0) as pool_fired from pr left join ev on ev.src = pr.src and ev.label = 0 and ev.ts < pr.last_ts group by pr.pos)
select case when pool_n = 0 then 'pool_unavailable' when pool_fired > 0 then 'pad_fired' when r_star > pool_n then 'structural' else 'suppressed' end as outcome, count(*) as n from pr join pool using (pos) group by 1""")
def x24_outcomes(spark, d):
    """Each priced alert by what stands in the way: pads are the benign flows of the attacker's own source before its last flow."""
    p = _priced(spark, d).select("pos", "src", "r_star", F.col("last_ts").alias("t_atk"))
    benign = evident(spark, d).where("label = 0").select("src", "ts", "e", F.lit(True).alias("deployed"))
    run = attack.pad_pools(p, benign, ["src"]).select(F.col("pool_n").alias("pool_size"), F.col("r_star").alias("pads_needed"), F.lit(True).alias("fired_before"), (F.col("r_star") > F.col("pool_n")).alias("fired"), (F.col("pool_fired") > 0).alias("pad_fired"))
    return attack.outcome_classes(run).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"with {EP} select round(max(case when not ismal then ev end), 6) as max_ev, round(count(*) / {A}, 6) as needed, coalesce(max(case when not ismal then ev end) >= count(*) / {A}, false) as met from s")
def x25_premise(spark, d):
    return attack.premise(stream(spark, d), ALPHA).select(r("max_ev", 6).alias("max_ev"), r("needed", 6).alias("needed"), "met")


@query(f"with {EP} select round(count(*) / {W} - 1, 6) as lond, round(count(*) / ({A} * 10) - 1, 6) as ebh from s")
def x26_required(spark, d):
    t = stream(spark, d).count()
    return spark.createDataFrame([(round(attack.required_calibration(t, W0), 6), round(attack.required_calibration_ebh(t, ALPHA, 10), 6))], "lond double, ebh double")


@query("with g as (select src, dst, count_if(label = 1) as m, count_if(label = 0) as b from flows group by 1, 2) select count(*) as n_pairs, count_if(m > 0) as n_attack, count_if(m > 0 and b = 0) as n_pure, count_if(m > 0 and b > 0) as n_with_pads from g")
def x27_purity(spark, d):
    return attack.host_pair_purity(table(spark, d, "flows"))


@query(f"with {EP} select pos, round(n * 1 / ({W} * ceiling * 0.01), 6) as floor from s")
def x28_floor(spark, d):
    s = stream(spark, d)
    return s.select(F.col("pos").cast("long").alias("pos"), r(attack.detection_floor(F.lit(s.count()), W0, F.col("ceiling"), F.lit(0.01)), 6).alias("floor"))


@query()
def x29_exact(spark, d):
    """Exact least suppressing sizes at the levels ADDIS offers to the malicious episodes it rejects."""
    s = stream(spark, d)
    run = s.join(controllers.control(s, "addis").select("pos", "level", "fired"), "pos").where("fired and ismal")
    return attack.suppressing_sizes(run).withColumn("p", r("p"))


@query(f"""with {_lond_sql('poly')}, q as (select s.pos, s.ev, s.sum_e, s.nsz, c.level, c.r - 1 as before from c join s on s.pos = c.pos where c.fired),
t as (select pos, greatest(floor(power({A} * (before + 1) * ev / {ZETA}::double, 1 / 1.6::double))::bigint - pos + 1, 0) as g_star, greatest(floor(sum_e * level - nsz)::bigint + 1, 0) as r_star from q), m as (select unnest([1, 2, (select quantile_cont(nsz, 0.5)::int from s)])::int as per_group)
select pos, g_star, per_group, g_star * per_group as insert_flows, r_star, sum(g_star * per_group) over (partition by per_group)::bigint as total from t, m""")
def x30_insertion(spark, d):
    """Insertion against padding per alert, at one, two and the median number of flows per group, with the window's total."""
    s = stream(spark, d)
    run = controllers.with_levels(s.join(controllers.elond_native(s).select("pos", "fired"), "pos"), "poly", ALPHA)
    run = run.withColumn("r_before", F.round(F.col("level") / (ALPHA * spending.gamma_column("poly", F.col("pos"), 1))).cast("long") - 1)
    t = attack.targeted_insertions(run, ALPHA).withColumn("r_star", attack.zero_pads(F.col("sum_e"), F.col("tau"), F.col("nsz")))
    half = int(s.agg(F.percentile("nsz", F.lit(0.5))).first()[0] or 1)
    out = attack.insertion_cost(t, [1, 2, half]).withColumn("pos", F.col("pos").cast("long"))
    total = out.groupBy("per_group").agg(F.sum("insert_flows").alias("total"))
    return out.join(F.broadcast(total), "per_group")  # three rows


_CHOOSE = lambda a, b: f"(lgamma({a} + 1.0) - lgamma({b} + 1.0) - lgamma({a} - ({b}) + 1.0))"


@query(f"""with {EV}, bb as (select count(*)::bigint as total, count_if(e > 0)::bigint as good, max(ceiling) as ceiling from ev where label = 0), q as (select bb.*, n, ceil(n / (0.5 * ceiling))::bigint as lo, ceil(n / (0.25 * ceiling))::bigint - 1 as hi, 1 / ceiling as p from bb, (select unnest([10, 1000, 2000])::bigint as n)),
k as (select *, range(lo, least(hi, n) + 1) as ks from q)
select n, lo, hi, round(case when n <= total then coalesce(list_sum(list_transform(list_filter(ks, lambda x: x <= good and n - x <= total - good), lambda x: exp({_CHOOSE("good", "x")} + {_CHOOSE("(total - good)", "(n - x)")} - {_CHOOSE("total", "n")}))), 0) end, 9) as without,
  round(coalesce(list_sum(list_transform(ks, lambda x: exp({_CHOOSE("n", "x")} + x * ln(p) + (n - x) * ln(1 - p)))), 0), 9) as nominal from k""")
def x31_precursor(spark, d):
    """Chance that an ordinary group of n benign flows moves the state of ADDIS: drawn from the deployed benign flows, and at the nominal rate."""
    b = evident(spark, d).where("label = 0").agg(F.count("*").alias("total"), F.count_if(F.col("e") > 0).alias("good"), F.max("ceiling").alias("c")).first()
    rows = [(n, *attack.precursor_window(n, b.c), *attack.precursor_chance(b.total, b.good, n, b.c, 1 / b.c)) for n in (10, 1000, 2000)]
    return spark.createDataFrame(rows, "n long, lo long, hi long, without double, nominal double").withColumns({c: r(c) for c in ("without", "nominal")})


@query("with a as (select src, dst, floor(ts / 86400000000)::bigint as bucket, count(*) as c from flows where ts is not null and src is not null and dst is not null group by 1, 2, 3) select src, dst, bucket, round((1 - power(0.5::double, c)) * 1000, 6) as attainable from a")
def x32_attainable(spark, d):
    f = episodes.arrival_rank(table(spark, d, "flows").where("ts is not null and src is not null and dst is not null").select("ingest_id", "ts", "src", "dst"), KEYS, 86400)
    w = f.withColumn("weight", 0.5 * F.pow(F.lit(0.5), F.col("arrival") - 1))
    return attack.attainable(w, [*KEYS, "bucket"], F.lit(1000.0)).select(*KEYS, "bucket", r("attainable", 6).alias("attainable"))


@query()
def x33_fixed_point(spark, d):
    def run(e, n, m, c):
        pads, rounds = attack.settle_buckets(e, n, m, c, "uniform", ALPHA)
        return [(int(pads.sum()), int((pads > 0).sum()), rounds)]

    return _whole(stream(spark, d), run, "pads long, padded long, rounds int")


# ---- detectors ----


@query()
def m01_boosted(spark, d):
    f = table(spark, d, "flows").where("split is not null and label is not null")
    m = detector.Boosted().fit(f.where("split = 'train'"))
    return metrics.auroc(m.score(f.where("split = 'deploy'"))).select("n_pos", "n_neg", "auroc")


@query()
def m04_host_conditioned(spark, d):
    from wardstream.operators.features import failed_state

    f = table(spark, d, "flows").where("split is not null and label is not null and ts is not null").join(table(spark, d, "meta").select("ingest_id", "conn"), "ingest_id", "left")
    bad = failed_state("conn", table(spark, d, "t49_r7"))
    m, wide = detector.host_conditioned(f, bad, "split = 'train'")
    return metrics.auroc(m.score(wide.where("split = 'deploy'"))).select("n_pos", "n_neg", "auroc")


@query()
def m02_isolation(spark, d):
    f = table(spark, d, "flows").where("split is not null and label is not null")
    m = detector.Isolation().fit(f.where("split = 'train'"))
    return metrics.auroc(m.score(f.where("split = 'deploy'"))).select("n_pos", "n_neg", "auroc")


