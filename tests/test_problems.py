import json
import random
import re
import time

import pytest

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardstream.functions.columns import event_type, finite, host, row_key
from wardstream.operators import features, nested, sessions, tree


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---- hosts and cleaning ----


def test_host_normal_form(spark):
    df = spark.createDataFrame([(" 10.0.0.1\t",), ("::FFFF:10.0.0.1",), ("2001:DB8::1",), ("  ",), (None,), ("",)], "a string")
    assert [r[0] for r in df.select(host("a")).collect()] == ["10.0.0.1", "10.0.0.1", "2001:db8::1", None, None, None]


def test_finite_and_event_type(spark):
    df = spark.createDataFrame([(float("nan"), " sf ", None), (float("-inf"), "", "dns"), (None, None, None), (-0.0, "S0", " Tls")], "x double, c string, s string")
    got = df.select(finite("x"), event_type("c", "s")).collect()
    assert [r[0] for r in got] == [0, 0, 0, 0] and [r[1] for r in got] == ["SF/-", "-/DNS", "-/-", "S0/TLS"]


def test_row_key_tells_null_places_apart(spark):
    df = spark.createDataFrame([(None, 5), (5, None), (None, 5)], "a int, b int")
    k = [r[0] for r in df.select(row_key(["a", "b"])).collect()]
    assert k[0] == k[2] != k[1]


# ---- sessions ----


def brute_sessions(events, gap):
    out, by = [], {}
    for k, t in events:
        if k is not None and t is not None:
            by.setdefault(k, []).append(t)
    for k, ts in by.items():
        ts.sort()
        start = 0
        for i in range(1, len(ts) + 1):
            if i == len(ts) or ts[i] - ts[i - 1] > gap:
                out.append((k, ts[start], ts[i - 1], i - start))
                start = i
    return sorted(out)


def test_sessions_match_brute_force(spark):
    rng = random.Random(3)
    ev = [(rng.choice(["a", "b", "c", None]), rng.choice([None, rng.randint(-500, 3000)])) for _ in range(600)] + [("hot", rng.randint(0, 100_000)) for _ in range(900)]
    df = spark.createDataFrame([(k, t, 1) for k, t in ev], "k string, ts long, session_no int")  # a clashing extra column
    got = [(r.k, r.start, r.end, r.n_events) for r in sessions.sessionize(df, ["k"], "ts", 30).collect()]
    assert sorted(got) == brute_sessions(ev, 30)


def test_session_gap_is_inclusive_and_zero_times_are_out(spark):
    s = 1800 * 1_000_000
    df = spark.createDataFrame([(10, "a", "x"), (10 + s, "a", None), (11 + 2 * s, " A", "x"), (0, "a", "x"), (None, "a", "x"), (10, "a", "x")], "ts long, src string, dst string")
    got = rows(sessions.host_sessions(df).where("side = 'src'").select("host", "session_no", "start_us", "end_us", "n_flows"))
    assert got == [("a", 1, 10, 10 + s, 3), ("a", 2, 11 + 2 * s, 11 + 2 * s, 1)]
    assert sessions.host_sessions(df.limit(0)).count() == 0


# ---- tree aggregation ----


def test_tree_rounds_give_the_plain_result(spark):
    df = spark.range(5000).select((F.col("id") % 7 % 3).alias("k"), F.col("id").alias("v")).repartition(40)
    first, merge = {"n": F.count("*"), "s": F.sum("v"), "m": F.max("v")}, {"n": F.sum, "s": F.sum, "m": F.max}
    plain = rows(df.groupBy("k").agg(F.count("*"), F.sum("v"), F.max("v")))
    for fan in (2, 5, 64):
        assert rows(tree.tree_aggregate(df, ["k"], first, merge, 5000, fan_in=fan, chunk_rows=50)) == plain


def test_tree_always_has_rounds(spark):
    assert tree.widths(0) == tree.widths(1000) == [2, 1] and tree.widths(10**12, 16, 65_536) == [953_675, 59_605, 3_726, 233, 15, 1] and tree.widths(800, 2, 100) == [4, 2, 1]
    df = spark.range(100).select((F.col("id") % 3).alias("k"))
    plan = tree.tree_aggregate(df, ["k"], {"n": F.count("*")}, {"n": F.sum}, 100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "__node" in plan
    with pytest.raises(ValueError):
        tree.tree_aggregate(df, ["k"], {"n": F.count("*")}, {"n": F.sum}, 100, fan_in=1)


def test_host_profile(spark):
    data = [("a", "x", 5), ("a", "x", 5), ("A ", None, 0), ("a", "y", None), (None, "x", 7), ("b", "x", 9)]
    df = spark.createDataFrame(data, "src string, dst string, ts long")
    for size in (1, 2, tree.CHUNK_ROWS):
        got = {(r.side, r.host): (r.n_flows, r.n_peers, r.first_us, r.last_us) for r in tree.host_profile(df, 2, size).collect()}
        assert got == {("src", "a"): (4, 2, 5, 5), ("src", "b"): (1, 1, 9, 9), ("dst", "x"): (4, 2, 5, 9), ("dst", "y"): (1, 1, None, None)}
    assert {(r.side, r.host) for r in tree.heavy_hosts(df, 0.5).collect()} == {("src", "a"), ("dst", "x")}
    assert tree.host_profile(df.limit(0)).count() == 0 and tree.heavy_hosts(df.limit(0)).count() == 0


# ---- features ----


def feature_tables(spark):
    f = [(1, 10, "a", "x", 1.0, 2.0), (2, 10, "a", "x", 1.0, 2.0), (3, 20, " A", "y", None, float("nan")), (4, 0, "a", None, 3.0, 4.0), (5, 30, None, "x", 1.0, 1.0), (6, 40, "z", "x", 1.0, 1.0)]
    flows = spark.createDataFrame(f, "ingest_id long, ts long, src string, dst string, f5 double, f6 double")
    meta = spark.createDataFrame([(1, "sf", "dns"), (2, "SF ", "DNS"), (3, "S0", None), (4, "SF", "dns"), (5, "", ""), (9, "OTH", "x")], "ingest_id long, conn string, service string")
    config = spark.createDataFrame([((["s0 ", "REJ"],),)], "config struct<fail_conn:array<string>>")
    return flows, meta, config


def test_features_count_deliveries_once(spark):
    v, types = features.host_features(*feature_tables(spark))
    long = {(r.side, r.host, r.event_type): (r.n_flows, r.last_us, r.total_bytes) for r in features.decoded(v, types).collect()}
    assert long == {
        ("src", "a", "SF/DNS"): (2, 10, 10.0), ("src", "a", "S0/-"): (1, 20, 0.0), ("dst", "x", "SF/DNS"): (1, 10, 3.0),
        ("dst", "y", "S0/-"): (1, 20, 0.0), ("dst", "x", "-/-"): (1, 30, 2.0),
    }
    share = {(r.side, r.host): r.fail_share for r in v.collect()}
    assert share[("src", "a")] == 1 / 3 and share[("dst", "y")] == 1.0 and ("src", "z") not in share
    wide = {(r.side, r.host): r for r in features.expand_features(v, ["side", "host"], types).collect()}
    assert wide[("src", "a")]["SF/DNS_n"] == 2 and wide[("dst", "y")]["SF/DNS_n"] == 0 and wide[("dst", "y")]["SF/DNS_latest"] is None


def test_features_merge_like_one_pass(spark):
    rng = random.Random(1)
    ev = spark.createDataFrame([(rng.choice("ab"), rng.randint(0, 4), rng.random(), rng.choice([None, rng.randint(1, 99)])) for _ in range(200)], "k string, type_ix int, bytes double, ts long").withColumn("p", F.col("type_ix") % 2)
    whole = features.sparse_features(ev, ["k"])
    parts = features.period_features(ev.withColumn("__id", F.lit(0)), ["k"], 20)
    assert parts.count() > 8  # several periods, and one for events without a time
    merged = features.merge_features(parts, ["k"])
    a, b = ({r.k: [(x.ix, x.n, round(x.total, 9), x.latest) for x in r.features] for r in d.collect()} for d in (whole, merged))
    assert a == b


def test_features_of_empty_tables(spark):
    flows, meta, config = feature_tables(spark)
    v, types = features.host_features(flows.limit(0), meta.limit(0), config.limit(0))
    assert types == [] and v.count() == 0 and features.decoded(v, types).count() == 0


# ---- nested records ----

DEEP = {"A": [{"IPs": ["1.1.1.1", None, " 2.2.2.2\n", "x", 3, {"IPs": "9.9.9.9"}, ["8.8.8.8"]]}], "IPs": "4.4.4.4", "Raw": json.dumps({"IPs": ["5.5.5.5"], "In": json.dumps({"Hosts": [{"Hostname": "h", "IPs": ["6.6.6.6"]}]})}), "L": [json.dumps({"IPs": ["7.7.7.7"]})]}
CASES = [
    json.dumps(DEEP), " \t\n" + json.dumps({"IPs": ["1.2.3.4"]}) + "\n", '{"IPs":["1.2.3.4"]} tail', '{"IPs":["1.2.3.4"]}{"IPs":[]}', '{"IPs":["1.2.3.4"]}],[{"IPs":["1.2.3.4"]}', '{"IPs":["1.2.3.4"]', "[" + json.dumps({"IPs": ["1.2.3.4"]}) + "]",
    None, "", "plain", '{"IPs":[]}', '{"IPs":null,"x":{"IPs":{"IPs":["1.2.3.5"]}}}', '{"IPs":["1.2.3.4:80","1.2.3","1.2.3.4.5","10.0.0.1/8","01.2.3.4"]}', json.dumps({"t": "y" * 200_000, "IPs": ["1.0.0.1"]}),
]


def walk(x, path, out):
    if isinstance(x, dict):
        for k, v in x.items():
            p = f"{path}.{k}" if path else k
            if k == "IPs":
                for q, y in [(p, v)] if isinstance(v, str) else [(f"{p}[{i}]", y) for i, y in enumerate(v)] if isinstance(v, list) else []:
                    if isinstance(y, str) and re.fullmatch(r"[0-9]+(\.[0-9]+){3}", y.strip()):
                        out.append((q, y.strip()))
                for q, y in [(f"{p}[{i}]", y) for i, y in enumerate(v) if not isinstance(y, str)] if isinstance(v, list) else [(p, v)] if isinstance(v, dict) else []:
                    walk(y, q, out)
            else:
                walk(v, p, out)
    elif isinstance(x, list):
        for i, y in enumerate(x):
            walk(y, f"{path}[{i}]", out)
    elif isinstance(x, str) and path:
        try:
            o = json.loads(x)
        except ValueError:
            return
        if isinstance(o, dict):
            walk(o, path, out)


def narratives(spark):
    schema = T.StructType([T.StructField("narrative_id", T.LongType()), T.StructField("subject", T.StringType()), T.StructField("category", T.StringType()), T.StructField("phase", T.StringType()), T.StructField("segments", T.ArrayType(T.StringType())), T.StructField("steps_submitted_time", T.ArrayType(T.StringType())), T.StructField("content", T.ArrayType(T.StringType()))])
    return spark.createDataFrame([(1, "s", " Web", "P1", None, ["2025-01-01T00:00:00Z", None], CASES), (2, None, None, None, [], [], None), (3, "t", "x", "p", ["a"], None, [])], schema)


def test_nested_addresses_match_a_recursive_walk(spark):
    want = []
    for i, c in enumerate(CASES):
        try:
            o = json.loads(c.strip()) if c else None
        except ValueError:
            o = None
        if isinstance(o, dict):
            found = []
            walk(o, "", found)
            want += [(1, i, p, ip) for p, ip in found]
    got = nested.addresses(narratives(spark))
    assert rows(got.select("narrative_id", "content_pos", "json_path", "ip")) == sorted(want, key=str)
    parents = {r.json_path: r.parent_path for r in got.where("content_pos = 0").collect()}
    assert parents["IPs"] == "" and parents["A[0].IPs[0]"] == "A[0]" and parents["Raw.In.Hosts[0].IPs[0]"] == "Raw.In.Hosts[0]"
    assert rows(nested.hosts(narratives(spark)).select("content_pos", "host_path", "hostname")) == [(0, "Raw.In.Hosts[0]", "h")]


def test_a_key_given_twice_keeps_its_last_value(spark):
    df = spark.createDataFrame([(1, ['{"a":1,"a":2,"IPs":["1.2.3.4"]}', '{"IPs":"9.9.9.9","IPs":["5.6.7.8"]}'])], "narrative_id long, content array<string>")
    assert rows(nested.addresses(df).select("content_pos", "ip")) == [(0, "1.2.3.4"), (1, "5.6.7.8")]


def test_wide_and_deep_records_are_linear(spark):
    wide = json.dumps({"Hosts": [{"Hostname": f"h{i}", "IPs": [f"10.0.{i // 256}.{i % 256}"]} for i in range(20_000)]})
    deep = '{"a":' * 300 + '{"IPs":["1.2.3.4"]}' + "}" * 300
    df = spark.createDataFrame([(1, [wide, deep])], "narrative_id long, content array<string>")
    began = time.time()
    assert nested.addresses(df).count() == 20_001 and time.time() - began < 20


def test_nested_items_and_narratives(spark):
    items = nested.content_items(narratives(spark))
    assert items.count() == len(CASES) and {r.content_pos for r in items.where("is_report").collect()} == {0, 1, 10, 11, 12, 13}
    assert rows(nested.narrative_table(narratives(spark)).select("narrative_id", "category", "n_segments", "n_steps", "n_items")) == [(1, "web", 0, 2, len(CASES)), (2, None, 0, 0, 0), (3, "x", 1, 0, 0)]
    assert nested.addresses(narratives(spark).limit(0)).count() == 0
