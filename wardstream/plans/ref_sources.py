"""Sources and sinks as round trips through the shared folder, audits of alerts, and detectors on sensors: queries and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstream.functions.columns import host, host_sql
from wardstream.operators import attack, detector, episodes, evidence, hostfeatures, joins, metrics
from wardstream.operators.features import failed_state
from wardstream.plans.fixture import KEYS, split_events
from wardstream.plans.problems import NODES
from wardstream.plans.ref_relational import _FLOW, _flow, flows
from wardstream.runtime import table, table_path
from wardstream.schema import FEATURES
from wardstream.sources import readers, sinks

QUERIES: dict = {}
SQL: dict = {}
ALPHA = 0.05


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f"ref_{f.__name__}"] = f
        if sql:
            SQL[f"ref_{f.__name__}"] = sql
        return f

    return keep


def r(c, n: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# ---- sources and sinks ----

_CLEAN = lambda c: f"coalesce(nullif(nullif(nullif({c}::varchar, 'nan'), 'inf'), '-inf')::double, 0)"
_BY_LABEL = "label, count(*) as n, count(ts) as n_ts, count(src) as n_src, sum(ts % 1000) as ts_sum, round(sum({f3}), 3) as f3_sum, min({f5})::double as f5_min"


def _by_label(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count("*").alias("n"), F.count("ts").alias("n_ts"), F.count("src").alias("n_src"), F.sum(F.col("ts") % 1000).alias("ts_sum"), r(F.sum(F.col("f3").cast("double")), 3).alias("f3_sum"), F.min("f5").cast("double").alias("f5_min"))


@query(f"select {_BY_LABEL.format(f3='f3::double', f5='f5')} from flows where f3 is not null and f5 is not null and {_CLEAN('f3')} = f3 and {_CLEAN('f5')} = f5 and src <> '' group by label")
def s01_flows_csv(spark, d):
    """Flows written as headerless CSV and read with their types."""
    path = table_path(spark, "flows-csv")
    f = flows(spark, d).where("src <> '' and abs(f3) < float('inf') and abs(f5) < float('inf')")
    sinks.write_flows(f, path)
    return _by_label(readers.read_flows(spark, path).withColumn("src", F.col("src")))


@query(f"select coalesce(label, 0)::tinyint as label, count(*) as n, count(*) as n_ts, count(nullif(src, '')) as n_src, sum(coalesce(ts, 0) % 1000)::bigint as ts_sum, round(sum({_CLEAN('f3')}::float::double), 3) as f3_sum, min({_CLEAN('f5')}::float)::double as f5_min from flows group by 1")
def s04_raw_projection(spark, d):
    """A raw log of 96 text columns, written as CSV, projected to the flow log; blank, NaN and Inf are 0."""
    path = table_path(spark, "raw-csv")
    names = ["ts", "src", "dst", "label", *FEATURES]
    at = dict(zip(readers.RAW_PLACES, names))
    text = lambda n: F.when(F.isnan(n), "NaN").when(F.col(n) == float("inf"), "Inf").when(F.col(n) == float("-inf"), "-Inf").otherwise(F.col(n).cast("string")) if n in FEATURES else F.col(n).cast("string")
    raw = flows(spark, d).select(*[(text(at[i]) if i in at else F.lit("x")).alias(f"c{i}") for i in range(96)])
    raw.write.mode("overwrite").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return _by_label(readers.project_raw(spark.read.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)))


@query("select event_type, count(*) as n, max(value) as top from events group by event_type")
def s05_cache(spark, d):
    """A cached table: built where it is missing, then read without being built again."""
    path, built = table_path(spark, "cache"), []

    def build() -> DataFrame:
        built.append(1)
        return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"))

    readers.cached(spark, path, build)
    out = readers.cached(spark, path, build)
    if len(built) != 1:
        raise AssertionError("the cache was built again")
    return out


@query(f"""with q as (select ts, label, c_ip, s_ip, {_CLEAN("f5")} as b from (select ts, label, trim(src, ' ' || chr(9)) as c_ip, trim(dst, ' ' || chr(9)) as s_ip, f5 from flows where ts > 0 and label is not null and trim(src, ' ' || chr(9)) <> '' and trim(dst, ' ' || chr(9)) <> '')),
p as (select *, (select count(*) from q o where o.c_ip = q.c_ip and o.ts < q.ts) as cnt from q) select label, count(*) as n, round(sum(b), 3) as bytes, sum(cnt)::bigint as before from p group by label""")
def s08_scenario(spark, d):
    """A transfer CSV with marked headers: known labels only, in time order, with host features and the usable columns."""
    path = table_path(spark, "scenario")
    trim = lambda c: F.btrim(c, F.lit(" \t"))
    f = flows(spark, d).where("ts > 0 and label is not null").select(trim("src").alias("c_ip"), trim("dst").alias("s_ip"), "ts", "label", "f5").where("c_ip <> '' and s_ip <> ''")
    finite = F.when(F.abs("f5") < float("inf"), F.col("f5").cast("double")).otherwise(0.0)
    out = f.select(F.col("c_ip").alias("#c_ip:1"), F.col("s_ip").alias("s_ip:15"), (F.col("ts") / F.lit(1e6)).cast("decimal(20,6)").alias("timestamp:3"), F.when(F.col("label") == 1, "attack").otherwise("benign").alias("label:9"), finite.alias("bytes:4"), F.lit(1.0).alias("same:5"))
    sinks.write_csv(out, path)
    wide, usable = readers.load_scenario(spark, path, ["attack", "benign"])
    if "bytes" not in usable or "same" in usable:
        raise AssertionError(usable)
    return wide.groupBy("label").agg(F.count("*").alias("n"), r(F.sum("bytes"), 3).alias("bytes"), F.sum("src_cnt").alias("before"))


@query("select sensor, split, count(*) as n from flows group by sensor, split")
def s11_s12_stage_json(spark, d):
    """A stage's result written as JSON and read by the next stage; nulls are kept."""
    path = table_path(spark, "stage")
    sinks.write_json(flows(spark, d).groupBy("sensor", "split").agg(F.count("*").alias("n")), path)
    return readers.read_stage(spark, path, lines=True).select("sensor", "split", "n")


@query("select sensor, count(*) as n, round(avg(label), 9) as rate from flows group by sensor")
def s13_csv(spark, d):
    path = table_path(spark, "result-csv")
    sinks.write_csv(flows(spark, d).groupBy("sensor").agg(F.count("*").alias("n"), r(F.avg("label"), 9).alias("rate")), path)
    return spark.read.option("header", True).schema("sensor string, n long, rate double").csv(path)


@query("select sensor as x, 'n' as series, count(*)::double as value from flows group by sensor union all select sensor, 'malicious', count_if(label = 1)::double from flows group by sensor")
def s15_plotted(spark, d):
    """The data behind a figure, in long form."""
    path = table_path(spark, "figure")
    g = flows(spark, d).groupBy(F.col("sensor").alias("x")).agg(F.count("*").cast("double").alias("n"), F.count_if(F.col("label") == 1).cast("double").alias("malicious"))
    sinks.plotted(g, "x", ["n", "malicious"], path)
    return spark.read.parquet(path)


@query("select count(*) as n, count(distinct sensor) as sensors from flows")
def s18_fingerprints(spark, d):
    """Fingerprints of a table's files are those of the same files read again, and differ between files."""
    path = table_path(spark, "prints")
    flows(spark, d).select("ingest_id", "sensor").write.partitionBy("sensor").parquet(path)
    a, b = readers.fingerprints(spark, path), readers.fingerprints(spark, path)
    a, b = (x.where("path like '%.parquet'") for x in (a, b))
    if a.exceptAll(b).count() or a.select("md5").distinct().count() != a.count():
        raise AssertionError("fingerprints changed")
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.count_distinct("sensor").alias("sensors"))


# ---- audits ----

_AL = "al as (select src, dst, floor(ts / 7200000000)::bigint as bucket, min(ts) as a, max(ts) as b, coalesce(sum(label), 0)::bigint as mal from f where src is not null and dst is not null group by 1, 2, 3 having sum(e) > 0)"


def _alerts(f: DataFrame) -> DataFrame:
    return episodes.build(f.where("src is not null and dst is not null"), KEYS, 7200).where("sum_e > 0")


_VERDICT = f"""{NODES}, cp as (select distinct ip as h from ip where ip <> ''), {_FLOW}, {_AL}, t as (select epoch_us(try_cast(x as timestamptz)) as ts from (select unnest(steps_submitted_time) as x from lspr23_attacknarratives)),
m as (select src, sum(mal) as all_mal from (select src, coalesce(sum(label), 0) as mal from f where src is not null and dst is not null group by src) group by src),
j as (select al.*, (select count(*) from t where t.ts between a - 900000000 and b + 900000000) as n_steps, {host_sql("al.src")} in (select h from cp) or {host_sql("al.dst")} in (select h from cp) as comp, all_mal - mal as elsewhere from al join m on m.src = al.src),
au as (select case when mal > 0 then 'confirmed' when n_steps > 0 and comp then 'likely' when n_steps > 0 or comp then 'possible' when elsewhere > 0 then 'related' else 'unsupported' end as verdict from j)"""


def _verdicts(spark, d) -> DataFrame:
    """Alerts on large transfers with a verdict from labels, submitted steps nearby, reported hosts and the source's other episodes."""
    f, n = _flow(spark, d), table(spark, d, "lspr23_attacknarratives")
    all_ = episodes.build(f.where("src is not null and dst is not null"), KEYS, 7200)
    a = joins.elsewhere(all_, KEYS, "src").where("sum_e > 0")
    near = joins.steps_near(a, [*KEYS, "bucket"], readers.steps(n).select("ts")).select(*KEYS, "bucket", "n_steps")
    bad = readers.compromised(n).select(F.col("ip").alias("__h"), F.lit(True).alias("__c"))
    hit = lambda df, c: df.withColumn("__h", host(c)).join(bad.withColumnRenamed("__c", f"__{c}"), "__h", "left").drop("__h")
    j = hit(hit(a.join(near, [*KEYS, "bucket"], "left"), "src"), "dst")
    return metrics.verdict(j.withColumn("compromised", F.coalesce("__src", F.lit(False)) | F.coalesce("__dst", F.lit(False))))


@query(f"{_VERDICT} select verdict, count(*) as n from au group by 1")
def r19_verdicts(spark, d):
    return _verdicts(spark, d).groupBy("verdict").agg(F.count("*").alias("n"))


@query(f"{_VERDICT} select count(*) as n, round(count_if(verdict = 'unsupported') / count(*), 9) as low, round(count_if(verdict <> 'confirmed') / count(*), 9) as high from au")
def r20_fdp_interval(spark, d):
    return metrics.fdp_interval(_verdicts(spark, d)).select("n", r("low", 9).alias("low"), r("high", 9).alias("high"))


@query(f"""with {_FLOW}, al as (select src, floor(ts / 86400000000)::bigint as bucket from f where src is not null group by 1, 2 having sum(e) > 0), p as (select distinct src, dst, floor(ts / 86400000000)::bigint as bucket, floor(ts / 300000000)::bigint as atom from f where label = 1 and src is not null),
h as (select p.*, al.bucket is not null as hit from p left join al on al.src = p.src and al.bucket = p.bucket), a as (select dst, src, atom, bool_or(hit) as hit from h group by 1, 2, 3), b as (select src, bucket, count(*) as k from h where hit group by 1, 2)
select (select count(*) from a) as n_bad, (select count_if(hit) from a) as n_covered, round((select count_if(hit) / count(*) from a), 9) as coverage, round((select avg(k) from b), 9) as blur""")
def r05_fixed_coverage(spark, d):
    """Daily alerts per source against fixed atoms of host pairs in five minutes."""
    f = _flow(spark, d)
    a = episodes.build(f.where("src is not null"), ["src"], 86400).where("sum_e > 0")
    return joins.fixed_coverage(f.where("src is not null"), a, ["src"], 86400, KEYS).select("n_bad", "n_covered", r("coverage", 9).alias("coverage"), r("blur", 9).alias("blur"))


_WIDTHS = [1800, 3600, 7200, 21600, 86400]
_UNITS = " union all ".join(
    f"""select {w} as bucket_s, split, src, floor(ts / {w}000000)::bigint as bucket, list(distinct 'bt_' || seg_src) filter (where seg_src <> '') as segs, count(distinct case when dst is not null then (dst, floor(ts / 300000000)) end) as atoms from fl group by 1, 2, 3, 4""" for w in _WIDTHS
)


@query(f"""with fl as (select f.split, f.src, f.dst, f.ts, m.seg_src from flows f left join meta m using (ingest_id) where f.label = 1 and f.src is not null and f.ts is not null and f.split is not null), al as ({_UNITS}),
st as (select epoch_us(try_cast(x as timestamptz)) as ts, segments from (select unnest(steps_submitted_time) as x, coalesce(segments, []) as segments from lspr23_attacknarratives) where try_cast(x as timestamptz) is not null),
j as (select al.*, (select count(*) from st where floor(st.ts / (al.bucket_s * 1000000::bigint)) = al.bucket) as any_step, (select count(*) from st where floor(st.ts / (al.bucket_s * 1000000::bigint)) = al.bucket and list_has_any(al.segs, st.segments)) as steps from al),
u as (select split, bucket_s, count(*) as n_alerts, count_if(any_step > 0) as n_temporal, count_if(steps > 0) as n_attributed, avg(case when steps > 0 then steps end) as spa, avg(atoms) as apa from j group by 1, 2),
k as (select *, spa is not null as ok from u), rk as (select *, case when ok then rank() over (partition by split, ok order by spa) + (count(*) over (partition by split, ok, spa) - 1) / 2.0 end as s, case when ok then rank() over (partition by split, ok order by apa) + (count(*) over (partition by split, ok, apa) - 1) / 2.0 end as a, case when ok then rank() over (partition by split, ok order by bucket_s) end as b from k),
g as (select split, count_if(ok) as n_defined, sum(n_alerts)::bigint as n_alerts, sum(n_temporal)::bigint as n_temporal, sum(n_temporal) / sum(n_alerts) as share, count_if(bucket_s < 86400 and n_attributed > 0) as n_fine, sum(n_attributed)::bigint as n_attributed, corr(s, a) as sa, corr(s, b) as sb, corr(a, b) as ab from rk group by split)
select split, n_defined, n_alerts, n_temporal, round(share, 9) as share_temporal, n_fine, n_attributed, case when n_defined >= 3 then 'usable' when n_fine = 0 and share < 0.1 then 'temporal' when n_attributed = 0 then 'spatial' else 'thin' end as verdict,
  case when n_defined >= 3 and not isnan(sa) then round(sa, 6) end as steps_atoms, case when n_defined >= 3 and not isnan(sb) then round(sb, 6) end as steps_width, case when n_defined >= 3 and not isnan(ab) then round(ab, 6) end as atoms_width from g""")
def r35_usability(spark, d):
    """Whether submitted steps can judge malicious source episodes, per split, over five alerting widths."""
    f = flows(spark, d).where("label = 1 and src is not null and ts is not null and split is not null").select("ingest_id", "ts", "src", "dst", "split").join(table(spark, d, "meta").select("ingest_id", "seg_src"), "ingest_id", "left")
    steps, out = readers.steps(table(spark, d, "lspr23_attacknarratives")), None
    for w in _WIDTHS:
        atom = F.when(F.col("dst").isNotNull(), F.struct("dst", episodes.bucket(F.col("ts"), 300).alias("a")))
        a = f.groupBy("split", "src", episodes.bucket(F.col("ts"), w).alias("bucket")).agg(F.collect_set(F.when(F.col("seg_src") != "", F.concat(F.lit("bt_"), "seg_src"))).alias("segments"), F.count_distinct(atom).alias("atoms"))
        a = a.withColumn("ips", F.array().cast("array<string>"))
        got = lambda rule, name: joins.steps_to_alerts(a, ["split", "src"], steps, w, rule).withColumnRenamed("n_steps", name)  # noqa: B023, E731
        j = a.select("split", "src", "bucket", "atoms").join(got("none", "__any"), ["split", "src", "bucket"], "left").join(got("seg", "__steps"), ["split", "src", "bucket"], "left")
        x = j.groupBy("split").agg(F.lit(w).alias("bucket_s"), F.count("*").alias("n_alerts"), F.count("__any").alias("n_temporal"), F.count("__steps").alias("n_attributed"), F.avg("__steps").alias("steps_per_alert"), F.avg("atoms").alias("atoms_per_alert"))
        out = x if out is None else out.unionByName(x)
    u = metrics.usability(out, ["split"])
    return u.select("split", "n_defined", "n_alerts", "n_temporal", r("share_temporal", 9).alias("share_temporal"), "n_fine", "n_attributed", "verdict", *[r(c).alias(c) for c in ("steps_atoms", "steps_width", "atoms_width")])


@query()
def r21_agreement(spark, d):
    """The derived chance that a smoothed p-value is at most alpha against 200 draws, for every benign deployed flow."""
    s, n = split_events(spark, d), 200
    k = evidence.ranks(s.where("split = 'deploy' and label = 0"), s.where("split = 'cal' and label = 0"))
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (ALPHA * (F.col("nc") + 1) - F.col("above")) / (1 + F.col("ties"))))
    hit = evidence.smoothed_p(F.col("above"), F.col("ties"), F.col("nc"), F.col("u")) <= ALPHA
    seen = evidence.draws(k, "ingest_id", n).groupBy("ingest_id").agg(F.first(p).alias("predicted"), F.count_if(hit).alias("observed"))
    return metrics.agreement(seen, n)


@query("""with g as (select * from (select distinct split from flows where split is not null), (select distinct sensor from flows)), v as (select split, sensor, round(avg((label = 1)::int), 9) as rate from flows where split is not null and label is not null group by 1, 2)
select g.split, g.sensor, v.rate, v.rate is not null as found from g left join v on v.split = g.split and v.sensor = g.sensor""")
def j14_lookup(spark, d):
    """An earlier stage's rates, from its JSON result, for every cell of a grid of splits and sensors."""
    path, f = table_path(spark, "rates"), flows(spark, d)
    sinks.write_json(f.where("split is not null and label is not null").groupBy("split", "sensor").agg(r(F.avg((F.col("label") == 1).cast("double")), 9).alias("rate")), path)
    grid = f.select("sensor").distinct().withColumn("split", F.explode(F.array(*[F.lit(s) for s in ("train", "cal", "deploy")])))
    return metrics.looked_up(grid, readers.read_stage(spark, path, lines=True), ["split", "sensor"], "rate").select("split", "sensor", "rate", F.col("rate").isNotNull().alias("found"))


# ---- detectors ----


def _labelled(spark, d) -> DataFrame:
    return flows(spark, d).where("split is not null and label is not null")


@query()
def m03_scored(spark, d):
    """Calibration and deployment scored by one fit: rows, positives and the share above the calibration's benign maximum."""
    f = _labelled(spark, d)
    s = detector.Boosted().fit(f.where("split = 'train'")).score(f.where("split in ('cal', 'deploy')")).select("split", "label", "score")
    top = s.where("split = 'cal' and label = 0").agg(F.max("score").alias("__t"))
    return s.join(F.broadcast(top)).groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n_pos"), F.avg((F.col("score") > F.col("__t")).cast("double")).alias("above"))  # one row


@query()
def m05_m06_transfer(spark, d):
    """Every sensor's flows scored by a detector, with the settings of small foreign data, that never saw the sensor."""
    f = _labelled(spark, d).where("sensor is not null")
    names = sorted(x.s for x in f.select(F.lower(F.trim("sensor")).alias("s")).distinct().collect())  # one per sensor
    tables = {n: f.where(F.lower(F.trim("sensor")) == n) for n in names}
    out = detector.leave_one_out(tables, detector.transfer, FEATURES)
    return reduce(DataFrame.unionByName, [metrics.auroc(out.where(F.col("org") == n)).select(F.lit(n).alias("org"), "n_pos", "n_neg", "auroc") for n in names])


def _conditioned(spark, d):
    f = _labelled(spark, d).where("ts is not null").join(table(spark, d, "meta").select("ingest_id", "conn"), "ingest_id", "left")
    return detector.host_conditioned(f, failed_state("conn", table(spark, d, "t49_r7")), "split = 'train'", iterations=50)


@query()
def m08_ablation(spark, d):
    """AUROC with each host feature set to its median among benign training flows."""
    m, wide = _conditioned(spark, d)
    test, train = wide.where("split = 'deploy'"), wide.where("split = 'train'")
    a = metrics.aurocs(detector.ablations(m, train, test, detector.HOST_COLUMNS), "column", "ablated").withColumnRenamed("column", "__i")
    names = spark.range(1).select(F.posexplode(F.array(*[F.lit(c) for c in detector.HOST_COLUMNS])).alias("__i", "column"))
    return names.join(F.broadcast(a), "__i", "left").select("column", "n_pos", "n_neg", "auroc")  # one row per column


def _pad_rates(spark, d, count: int) -> tuple[DataFrame, float]:
    """Firing rate of benign deployed flows as the k-th pad of the busiest attacked pair, and the ceiling."""
    m, wide = _conditioned(spark, d)
    kth, n = m.score(wide.where("split = 'cal' and label = 0")).agg(F.max("score"), F.count("*")).first()
    top = wide.where("label = 1 and split = 'deploy' and src is not null and dst is not null").groupBy("src", "dst").agg(F.count("*").alias("c"), F.max("ts").alias("t")).orderBy(F.desc("c"), "src", "dst").first()
    seen = wide.join(table(spark, d, "meta").select("ingest_id", F.col("conn").alias("__conn")), "ingest_id", "left")
    state = hostfeatures.state_at(seen, top.src, top.dst, top.t, failed_state("__conn", table(spark, d, "t49_r7")))
    return detector.pad_fire_rate(m, wide.where("split = 'deploy' and label = 0"), state, count, kth), float(n + 1)


@query()
def m09_pad_rates(spark, d):
    return _pad_rates(spark, d, 10)[0].orderBy("k")


@query()
def x06_causal(spark, d):
    """Causal replay: the k-th pad fires with the chance the host-conditioned detector gives it in the state it then finds."""
    from wardstream.plans.ref_control import _priced

    rates, ceiling = _pad_rates(spark, d, 10)
    rate = {x.k: x.rate for x in rates.collect()}  # one row per level
    levels = sorted(rate)
    return attack.replay_causal(_priced(spark, d), ["pos"], [*levels, 10_000_000], [*(rate[k] for k in levels), rate[levels[-1]]], ceiling, 5)
