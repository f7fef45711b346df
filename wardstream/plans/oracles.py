"""DuckDB SQL of queries whose procedures look back along the stream, as recursive CTEs, and of seeded draws."""

from __future__ import annotations

from wardstream.functions.hashing import draw_sql, uniform_sql
from wardstream.plans.fixture import EP, EV, GAMMA, ZETA, Z
from wardstream.plans.problems import NODES
from wardstream.plans.ref_control import _PRICED, _lond_sql
from wardstream.plans.ref_relational import _mix_sql, _RANK, _U

A, W = "0.05::double", "0.025::double"
_POLY = GAMMA["poly"]
_RUN = "select pos, round(level, 10) as level, fired, silent from c where pos > 0"
_P = "(case when s.ev > 0 then least(1.0::double, 1 / s.ev) else 1.0::double end)"


def _ages(now: str, first: int) -> str:
    """Budget offered at a clock time by the start and by the rejections born at ``births``."""
    g = lambda a: f"(case when {a} >= {first} then power(least({a} - {first} + 1, n + 1)::double, -1.6::double) / {ZETA}::double else 0 end)"
    later = f"list_sum(list_transform(births[2:], lambda b: {g(f'({now} - b)')}))"
    return f"({W} * {g(f'({now})')} + case when len(births) > 0 then ({A} - {W}) * {g(f'({now} - births[1])')} else 0 end + {A} * coalesce({later}, 0))"


_SAFFRON = f"""recursive {EP},
c as (select 0::bigint as pos, 0::bigint as cand, []::bigint[] as births, 0::double as level, false as fired, false as silent union all
  select pos, cand2, case when ok then list_append(births, pos - cand2) else births end, level, ok, silent from (
    select *, cand + (p <= 0.5)::bigint as cand2, not silent and p <= level as ok from (
      select *, level <= 0 or ceiling < 1 / level as silent from (
        select s.pos, s.ceiling, {_P} as p, cand, births, least(0.5::double, 0.5 * {_ages("s.pos - cand", 1)}) as level from c join s on s.pos = c.pos + 1))))"""
_ADDIS = f"""recursive {EP},
c as (select 0::bigint as pos, 0::bigint as clock, []::bigint[] as births, 0::double as level, false as fired, false as silent union all
  select pos, clock2, case when ok then list_append(births, clock2) else births end, level, ok, silent from (
    select *, clock + (p <= 0.5)::bigint - (p <= 0.25)::bigint as clock2, not silent and p <= level as ok from (
      select *, level <= 0 or ceiling < 1 / level as silent from (
        select s.pos, s.ceiling, {_P} as p, clock, births, least(0.25::double, 0.25 * {_ages("clock", 0)}) as level from c join s on s.pos = c.pos + 1))))"""
_WEIGHT = lambda rejected: f"0.01::double * (1 + (1 - power(0.5::double, pos - ({rejected}))) - (1 - power(0.5::double, {rejected})))"
_OK = "level > 0 and ceiling >= 1 / level and ev >= 1 / level"
_SILENT = "level <= 0 or ceiling < 1 / level"
_ESAFFRON = f"""recursive {EP},
c as (select 0::bigint as pos, 0::bigint as r, 0.01::double as w, 0::double as spent, 0::double as level, false as fired, false as silent union all
  select pos, r + ok::bigint, {_WEIGHT("r + ok::bigint")}, spent + case when ev < 10 then level / (r + 1) else 0 end, level, ok, {_SILENT} from (
    select *, {_OK} as ok from (select s.pos, s.ev, s.ceiling, r, spent, greatest(0, w * (0.05::double * 0.9 - spent) * (r + 1)) as level from c join s on s.pos = c.pos + 1)))"""
_MEMLORD = f"""recursive {EP},
c as (select 0::bigint as pos, 0::bigint as r, 0.01::double as w, 0::double as spent, 0::double as memory, 0::double as level, false as fired, false as silent union all
  select pos, r + ok::bigint, {_WEIGHT("r + ok::bigint")}, spent + level / (0.99 * memory + 1), 0.99 * memory + ok::int, level, ok, {_SILENT} from (
    select *, {_OK} as ok from (select s.pos, s.ev, s.ceiling, r, spent, memory, greatest(0, w * ({A} - spent) * (0.99::double * memory + 1)) as level from c join s on s.pos = c.pos + 1)))"""
_DONATION = f"""recursive {EP},
c as (select 0::bigint as pos, []::double[] as ge, []::double[] as gr, 0::double as given, 0::double as level, false as fired, false as silent union all
  select pos, case when ok then list_append(ge, ev) else ge end, case when ok then list_append(gr, g) else gr end, given + case when ok then 0 else g * least(ev, 1) end, level, ok, silent from (
    select *, not silent and (isinf(level) or ev >= 1 / level) as ok from (select *, {_SILENT} as silent from (
      select *, case when 1 - least({A} * k * w, 1) > 0 then {A} * g * k / (1 - least({A} * k * w, 1)) else 'inf'::double end as level from (
        select s.pos, s.ev, s.ceiling, ge, gr, given, {_POLY("s.pos")} as g, len(ge) + 1 as k,
          given + coalesce(list_sum(list_transform(range(1, len(ge) + 1), lambda i: gr[i] * least(ge[i] - 1 / ({A} * gr[i] * (len(ge) + 1)), 1))), 0) as w from c join s on s.pos = c.pos + 1)))))"""
_JOIN = lambda r: f"lambda acc, x: list_transform(range(1, len(acc) + 2), lambda i: greatest(coalesce(acc[i], -1e300::double), case when i > 1 then acc[i - 1] + x[2] - {A} * ({r} + 1) * x[1] * {_POLY('(i - 1)')} else -1e300::double end))"
# The largest sums by number of members are built anew from all that was told, at every step.
_CLOSED = f"""recursive {EP},
c as (select 0::bigint as pos, 0::bigint as r, []::double[][] as told, 0::double as level, false as fired, false as silent union all
  select pos, r + ok::bigint, list_append(told, [ev, ok::int::double]), level, ok, {_SILENT} from (select *, {_OK} as ok from (
    select pos, ev, ceiling, r, told, coalesce(list_min(list_filter(list_transform(range(1, len(best) + 1), lambda k: case when 1 + best[k] > 0 then {A} * (r + 1) * {_POLY("k")} / (1 + best[k]) end), lambda y: y is not null)), 0) as level from (
      select s.pos, s.ev, s.ceiling, c.r, c.told, list_reduce(list_prepend([0.0::double], c.told), {_JOIN("c.r")}) as best from c join s on s.pos = c.pos + 1))))"""
# e-BH on every prefix: the largest rank whose cost does not exceed it.
_COSTS = f"""{EP}, k as (select pos, n, ev, ceiling, {_POLY("pos")} as g, case when ev > 0 then 1 / ({A} * {_POLY("pos")} * ev) end as cost, 1 / ({A} * {_POLY("pos")} * ceiling) as best from s),
pr as (select t.pos as t, i.cost, row_number() over (partition by t.pos order by i.cost) as q from k t join k i on i.pos <= t.pos and i.cost is not null),
rt as (select k.pos as t, coalesce(max(case when pr.cost <= q then q end), 0) as r from k left join pr on pr.t = k.pos group by 1),
pb as (select t, cost, row_number() over (partition by t order by cost) as q from (select t.pos as t, i.cost from k t join k i on i.pos < t.pos and i.cost is not null union all select pos, best from k)),
rb as (select t, coalesce(max(case when cost <= q then q end), 0) as r from pb group by t)"""
_BALANCE = f"""{EP}, k as (select pos, ev, {_POLY("pos")} as g, row_number() over (order by {_POLY("pos")} * ev desc, pos) as i from s), bal as (select r, sum(case when i <= r then least(g * ev - 1 / ({A} * r), g) else g * least(ev, 1) end) as balance from k, (select unnest(range(1, (select count(*) + 1 from s))) as r) group by r),
m as (select coalesce(max(r), 0) as r from bal where balance >= 0)"""
_RESTART = f"""recursive {EP}, e as (select *, floor(first_ts / 21600000000)::bigint as epoch from s), ep2 as (select epoch, row_number() over (order by epoch) as i, count(*) over () as m from (select distinct epoch from e)),
al as (select 'each' as allocation, epoch, {A} as a from ep2 union all select 'uniform', epoch, {A} / m from ep2 union all select 'geometric', epoch, {A} * power(2.0::double, -i) from ep2),
q as (select epoch, ev, ceiling, row_number() over (partition by epoch order by pos) as p from e),
c as (select allocation, epoch, a, 0::bigint as p, 0::bigint as r, false as fired, false as silent from al union all
  select allocation, epoch, a, p, r + ok::bigint, ok, silent from (select *, {_OK} as ok, {_SILENT} as silent from (select c.allocation, c.epoch, c.a, q.p, c.r, q.ev, q.ceiling, c.a * {_POLY("q.p")} * (c.r + 1) as level from c join q on q.epoch = c.epoch and q.p = c.p + 1)))"""


def _shifted(kind: str, shifts: str) -> str:
    """LOND with silent hypotheses before the stream, one run per number of them, as CTE ``c``."""
    g = {"poly": _POLY("s.pos + c.g"), "uniform": "(1.0::double / (n + c.g))"}[kind]
    return f"""recursive {EP}, c as (select unnest([{shifts}])::bigint as g, 0::bigint as pos, 0::bigint as r, false as fired union all
  select g, pos, r + ok::bigint, ok from (select *, {_OK} as ok from (select c.g, s.pos, c.r, s.ev, s.ceiling, {A} * {g} * (c.r + 1) as level from c join s on s.pos = c.pos + 1)))"""


_JOINT = f"""recursive {EP}, base as (select 0::bigint as pos, 0::bigint as r, 0::double as level, false as fired union all
  select pos, r + ok::bigint, level, ok from (select *, {_OK} as ok from (select s.pos, b.r, s.ev, s.ceiling, {A} / n * (b.r + 1) as level from base b join s on s.pos = b.pos + 1))),
c as (select * from (values (true, null::int), (false, null::int), (true, 20::int)) t(adaptive, cap), (select 0::bigint as pos, 0::bigint as r, 'x' as outcome) union all
  select adaptive, cap, pos, r + case when target and (cap is null or need <= cap) then (ceiling >= 1 / level and ev * nsz / (nsz + need) >= 1 / level)::bigint else hit::bigint end,
    case when target and (cap is null or need <= cap) then 'suppressed' when target then 'over_cap' when was and not hit then 'cascade' else 'none' end from (
    select *, ismal and case when adaptive then hit else was end as target, greatest(floor(ev * nsz * case when adaptive then level else price end - nsz)::bigint + 1, 0) as need from (
      select *, {_OK} as hit from (select c.adaptive, c.cap, s.pos, c.r, s.ev, s.nsz, s.ismal, s.ceiling, b.fired as was, b.level as price, {A} / n * (c.r + 1) as level from c join s on s.pos = c.pos + 1 join base b on b.pos = s.pos))))"""
_FAMILIES = [("src-dst", "src::varchar || '/' || dst"), ("src", "src::varchar"), ("dst", "dst")]
_SWEEP = "recursive " + EV + ", fb as (" + " union all ".join(
    f"select '{f}' as family, {b or 0} as bucket_s, {k} as key, {f'floor(ts / {b}000000)::bigint' if b else '0::bigint'} as bucket, * from ev" for f, k in _FAMILIES for b in (86400, None)
) + f"""), eg as (select family, bucket_s, key, bucket, sum(e) / count(*) as ev, sum(label) > 0 as ismal, max(ceiling) as ceiling, min(ts) as first_ts, arg_min(ingest_id, ts::hugeint * 1000000000 + ingest_id) as first_pos from fb group by 1, 2, 3, 4),
s as (select *, row_number() over (partition by family, bucket_s order by first_ts, first_pos) as pos, count(*) over (partition by family, bucket_s) as n from eg),
c as (select * from (select distinct family, bucket_s from s), (select unnest(['poly', 'uniform']) as gamma, 0::bigint as pos, 0::bigint as r, false as fired, false as silent, false as ismal) union all
  select family, bucket_s, gamma, pos, r + ok::bigint, ok, silent, ismal from (select *, {_OK} as ok, {_SILENT} as silent from (
    select c.family, c.bucket_s, c.gamma, s.pos, c.r, s.ev, s.ceiling, s.ismal, {A} * case when c.gamma = 'poly' then {_POLY("s.pos")} else 1.0::double / s.n end * (c.r + 1) as level from c join s on s.family = c.family and s.bucket_s = c.bucket_s and s.pos = c.pos + 1)))"""
_LEVER = f"""recursive {EP}, c as (select * from (values (0.05::double, 'poly'), (0.05, 'uniform'), (0.1, 'poly'), (0.1, 'uniform')) t(q, gamma), (select 0::bigint as pos, 0::bigint as r, false as fired, false as ismal) union all
  select q, gamma, pos, r + ok::bigint, ok, ismal from (select *, {_OK} as ok from (select c.q, c.gamma, s.pos, c.r, s.ev, s.ceiling, s.ismal, c.q * case when c.gamma = 'poly' then {_POLY("s.pos")} else 1.0::double / n end * (c.r + 1) as level from c join s on s.pos = c.pos + 1)))"""
_GRID = "gr as (select split as win, sensor as choice, round(avg((label = 1)::int), 6) as v, length(sensor) as prio from flows where split is not null and label is not null group by 1, 2)"
# A distribution function by sums of binomial terms, and its inverse by bisection.
_TERMS = lambda k, n, p: f"list_sum(list_transform(range(0, {k}), lambda i: exp(lgamma({n} + 1.0) - lgamma(i + 1.0) - lgamma({n} - i + 1.0) + i * ln({p}) + ({n} - i) * ln(1 - {p}))))"
_KEEP = "(select least(count_if(ismal), greatest(1, round_even(0.05::double * (count(*) - count_if(ismal)) / (1 - 0.05::double), 0)))::bigint as keep, count_if(ismal) as m, count(*) as t from s)"


def _hashed(name: str, seed: int) -> str:
    """CTEs with the chained 63-bit hash ``v`` of src and of the code of dst."""
    golden = 0x9E3779B97F4A7C15 ^ seed
    return f"""{name}s as (select src, dst, xor({golden}{_U}, src{_U}) as v from s), {_mix_sql(name + "m", name + "s", "v", "src, dst")},
{name}t as (select src, dst, xor(v, ({draw_sql("dst")}){_U}) as v from {name}m), {_mix_sql(name, name + "t", "v", "src, dst")}"""


_LOW = f"(v & 9223372036854775807{_U})"
_PADDED = f"""{EV}, lo as (select min(ts) - 1 as t from ev), al as (select ingest_id, ts, src, dst, label, e from ev union all select -1, t, 3, 'click', 0, 0.0 from lo),
old as (select src, dst, min(ts) as first_ts, arg_min(ingest_id, ts::hugeint * 1000000000 + ingest_id) as first_pos, count(*) as nsz from ev group by 1, 2),
new as (select src, dst, min(ts) as first_ts, arg_min(ingest_id, ts::hugeint * 1000000000 + ingest_id) as first_pos, count(*) as nsz from al group by 1, 2)"""

SQL = {
    "ref_c03_saffron": f"with {_SAFFRON} {_RUN}",
    "ref_c04_addis": f"with {_ADDIS} {_RUN}",
    "ref_c07_esaffron": f"with {_ESAFFRON} {_RUN}",
    "ref_c07_mem_elord": f"with {_MEMLORD} {_RUN}",
    "ref_c09_donation_elond": f"with {_DONATION} {_RUN}",
    "ref_c10_closed_elond": f"with {_CLOSED} {_RUN}",
    "ref_c11_etoad_arc": f"with {_COSTS} select k.pos, round({A} * k.g * rt.r, 10) as level, coalesce(k.cost <= (select r from rt where t = k.n), false) as fired, not k.best <= rb.r as silent from k join rt on rt.t = k.pos join rb on rb.t = k.pos",
    "ref_c06_ebh_entries": f"with {_COSTS} select k.pos, (select greatest(k.pos, min(t)) from rt where rt.r >= k.cost) as entered from k where k.cost <= (select r from rt where t = k.n)",
    "ref_c13_donation_ebh": f"with {_BALANCE} select pos, 0.0::double as level, i <= m.r and g > 0 as fired, false as silent from k, m",
    "ref_c17_restarted": f"with {_RESTART} select allocation, count_if(fired) as fired, count_if(silent) as silent from c where p > 0 group by 1",
    "ref_c18_prefix_shifts": f"with {_shifted('poly', '0, 5, 20, 50')} select g as shift, count_if(fired) as fired from c where pos > 0 group by g",
    "ref_x18_survival": f"with {_shifted('uniform', '0, 10, 50, 200')}, f as (select pos from c where g = 0 and fired) select g, (select count(*) from f) as fired, count_if(fired and pos in (select pos from f)) as survived from c where pos > 0 group by g",
    "ref_x10_joint": f"with {_JOINT} select adaptive, cap, outcome, count(*) as n from c where pos > 0 group by 1, 2, 3",
    "ref_x29_exact": f"""with {_ADDIS}, f as (select s.pos, s.nsz, round(s.sum_e)::bigint as x, c.level from c join s on s.pos = c.pos where c.fired and s.ismal), q as (select *, greatest(floor(level * x)::bigint + 1 - nsz, 0) as pads from f)
select pos, pads, round(least(1.0, (nsz + pads) / x), 9) as p, (nsz + pads) / x > 0.25 and least(1.0, (nsz + pads) / x) <= 0.5 as between, level >= 0.25 as saturated from q""",
    "ref_r25_sweep": f"with {_SWEEP} select family, bucket_s, gamma, count_if(fired) as alerts, count_if(fired and ismal) as tp, count(*) as t, count_if(silent) as silent from c where pos > 0 group by 1, 2, 3",
    "ref_r29_lever": f"""with {_LEVER}, t as (select max(n) as n, max(ceiling) - 1 as nc from s), g as (select q, gamma, (nc + 1) * (q / 2) / t.n as m, count_if(fired and ismal) / nullif(count_if(ismal), 0) as recall from c, t where pos > 0 group by q, gamma, nc, t.n)
select g.q, g.gamma, round(g.m / b.m, 9) as margin_ratio, round(g.q / 0.05::double, 9) as q_ratio, round(g.recall, 9) as recall from g join g b on b.gamma = g.gamma and b.q = 0.05::double""",
    "ref_r18_left_out": f"""with {_GRID}, t as (select choice, sum(v) as s, count(v) as c from gr group by choice), m as (select win, gr.choice, prio, (s - v) / nullif(c - 1, 0) as m from gr join t using (choice)), b as (select win, arg_max(choice, (m, -prio, choice)) as choice from m where m is not null group by win), x as (select win, max(v) as hi, min(v) as lo from gr group by win)
select b.win, b.choice, round((hi - v) / nullif(hi - lo, 0), 6) as regret from b join gr using (win, choice) join x using (win)""",
    "ref_s10_compromised": f"{NODES} select distinct ip from ip where ip <> ''",
    "ref_p05_train_sample": f"select label, count(*) as n from flows where split = 'train' and (label = 1 or {uniform_sql('ingest_id', '0')} < 0.5) group by label",
    "ref_p06_sample": f"select ingest_id from flows order by {draw_sql('0', 'ingest_id')}, ingest_id limit 1000",
    "ref_p07_draws": f"with p as (select ingest_id, f5, row_number() over (order by ingest_id) as pos, count(*) over () as n from flows where label = 0), d as (select id as draw, floor({uniform_sql('id', '0')} * (select max(n) from p))::bigint + 1 as pos from (select unnest(range(0, 1000)) as id)) select draw, ingest_id, f5 from d join p using (pos)",
    "ref_p10_thinned": f"with {EP}, k as {_KEEP} select ismal, case when ismal then keep else t - m end as n from (select distinct ismal from s), k",
    "ref_p11_resampled": f"with {EP}, k as {_KEEP}, m as (select ev, row_number() over (order by {draw_sql('0', 'src', 'dst')}, src, dst) as i from s where ismal) select ismal, case when ismal then keep else t - keep end as n, case when ismal then (select max(ev) from m where i <= keep) else (select max(ev) from s where not ismal) end as top from (select distinct ismal from s), k",
    "ref_p12_contaminated": f"""with {Z}, x as (select score from (select score, row_number() over (order by {draw_sql('0', 'ingest_id')}, ingest_id) as i from cal where label = 1) where i <= 10), y as (select score, row_number() over (order by score, ingest_id) as i from cal where label = 0)
select 'add' as model, count(*) as n, round(min(score), 6) as low from (select score from x union all select score from y) union all select 'replace', count(*), round(min(score), 6) from (select score from x union all select score from y where i > 10)""",
    "ref_e08_ceilings": f"""with recursive {Z}, nn as (select count(*) as n from cal where label = 0), q as (select unnest([1, 10, 100])::int as k, n from nn),
c as (select k, n, 0::int as i, 0::double as lo, 1::double as hi from q union all select k, n, i + 1, case when over then mid else lo end, case when over then hi else mid end from (select *, (lo + hi) / 2 as mid, {_TERMS("k", "n", "((lo + hi) / 2)")} > 0.1 as over from c where i < 100))
select k, round((n + 1) / k, 4) as nominal, round(1 / hi, 4) as beta, round(1 / (k / n + sqrt(ln(10.0::double) / (2.0 * n))), 4) as dkw from c where i = 100""",
    "ref_e09_boost": f"with {EV}, p as (select avg((e > 0)::int) as p, max(ceiling) as v from ev) select tau, round(greatest(1 / (p * v), tau / v), 6) as boost from p, (select unnest([10.0, 1000.0])::double as tau)",
    "ref_r10_clopper_pearson": f"""with recursive {EV}, q as (select count_if(e > 0)::bigint as k, count(*)::bigint as n from ev where label = 0),
c as (select k, n, 0::int as i, 0::double as a, 1::double as b, 0::double as c, 1::double as d from q union all
  select k, n, i + 1, case when low then (a + b) / 2 else a end, case when low then b else (a + b) / 2 end, case when high then (c + d) / 2 else c end, case when high then d else (c + d) / 2 end from (
    select *, coalesce(1 - {_TERMS("k", "n", "((a + b) / 2)")}, 1) < 0.025 as low, {_TERMS("k + 1", "n", "((c + d) / 2)")} > 0.025 as high from c where i < 100))
select k, n, case when k = 0 then 0 else round(b, 9) end as low, round(d, 9) as high from c where i = 100""",
    "ref_k02_random_ties": f"with {EP} select src, dst, row_number() over (order by first_ts, {draw_sql('0', 'src', 'dst', '0')}, src, dst) as pos from s",
    "ref_k04_key_orders": f"with {EP}, {_hashed('ha', 0)}, {_hashed('hb', 7)}, o as (select src, dst, row_number() over (order by {_LOW}, src, dst) as keyhash from ha), p as (select src, dst, row_number() over (order by {_LOW}, src, dst) as keyed from hb) select src, dst, keyhash, keyed from o join p using (src, dst)",
    "ref_k06_moved": f"""with {_PADDED}, s as (select src, dst from new), {_hashed('h', 0)}, o as (select src, dst, row_number() over (order by first_ts, first_pos) as a from old), n1 as (select new.src, new.dst, row_number() over (order by new.first_ts, new.first_pos) as b from new join old using (src, dst))
select count_if(a <> b) as moved, count(*) as n, 'first-flow' as order from o join n1 using (src, dst) 
union all select count_if(a <> b), count(*), 'keyhash' from (select src, dst, row_number() over (order by {_LOW}, src, dst) as a from h join old using (src, dst)) x join (select src, dst, row_number() over (order by i) as b from (select src, dst, row_number() over (order by {_LOW}, src, dst) as i from h) y join old using (src, dst)) z using (src, dst)""".replace(" as order from", ' as "order" from'),
    "ref_k08_padding_is_local": f"""with {_PADDED} select count_if(not touched) as unpadded, count_if(not touched and (old.nsz is distinct from new.nsz or old.first_ts is distinct from new.first_ts)) as changed, coalesce(sum(case when touched then new.nsz end), 0)::bigint as padded_nsz
from (select *, src = 3 and dst = 'click' as touched from new) new left join old using (src, dst)""",
    "ref_r28_silence_identity": f"""with recursive {EP}, e as (select *, floor(first_ts / 21600000000)::bigint as epoch from s), t as (select epoch, count(*) as t from e group by epoch), w as (select floor(power(max(ceiling) * {A} / {ZETA}::double, 1 / 1.6::double))::bigint as w from s)
select count(*) as epochs, sum(greatest(t - w, 0))::bigint as silent, 0::bigint as broken from t, w""",
}
