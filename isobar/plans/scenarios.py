"""Registered queries: scenario generation on source windows, their log, evaluation and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.functions import seq
from isobar.operators import scenarios
from isobar.plans.catalogue import HOUR, HOURS, Tables, query, r6

ROWS = {"spike": (1, 5), "bias": (6, 20), "drift": (10, 30), "stuck": (6, 20), "dropout": (4, 12), "noise_burst": (4, 12), "clipping": (8, 24), "scale_error": (8, 24), "sensor_swap": (6, 20)}
SPEC = scenarios.ScenarioSpec(channels=("v", "k", "n"), sizes=((1.5, 10.0), (2.0, 15.0), (6.0, 35.0)), gains=((0.65, 0.9), (0.97, 0.985), (0.65, 0.9)), rows=ROWS, history=12, earliest=2, latest=14, tail=6, past=12)
BLOCK, LENGTH = 72 * HOUR, 72


def _windows(t: Tables) -> DataFrame:
    d = t.hours().withColumn("k", F.col("k").cast("double")).withColumn("n", F.col("n").cast("double"))
    d = d.withColumn("us", ((F.row_number().over(seq.ordered(["g"])) - 1) * HOUR).cast("long"))  # the n-th report as the n-th hour: windows without gaps
    return scenarios.windows(d, ["g"], BLOCK, LENGTH)


_U = lambda name, fault="' || fault || '", more="": f"(('0x' || substr(sha256('{SPEC.seed}|' || window_id || '|{fault}|0|{name}'{more}), 1, 12))::bigint / {float(16**12)!r}::double)"
_PICK = lambda pairs, at: "case channel " + " ".join(f"when {i} then {p[at]!r}::double" for i, p in enumerate(pairs)) + " end"
_RANGE = lambda at: "case fault " + " ".join(f"when '{f}' then {r[at]}" for f, r in ROWS.items()) + f" else {at} end"


def _new(n: int, c: str) -> str:
    here = f"(inside and (channel = {n} or (fault = 'dropout' and {_U('all')} < 0.3)))"
    swap = {0: "n", 2: "v"}.get(n)
    past = f"(select 1) is not null and i >= start - {SPEC.past} and i < start"
    clip = f"case when {c} is null then null when {_U('upper')} < 0.5 then least({c}, quantile_cont(case when {past} then {c} end, 0.35) over w) else greatest({c}, quantile_cont(case when {past} then {c} end, 0.65) over w) end"
    return f"""case when fault in ('spike', 'bias') and {here} then {c} + size
      when fault = 'drift' and {here} then {c} + size * pow((i - start) / greatest(stop - start - 1, 1)::double, 0.7::double + {_U('power')} * 1.3::double)
      when fault = 'stuck' and {here} and {c} is not null then coalesce(max(case when i = start - 1 then {c} end) over w, {c})
      when fault = 'dropout' and {here} then null
      when fault = 'noise_burst' and {here} then {c} + (0.25::double + {_U('spread')} * 0.4::double) * abs(size) * sqrt(-2.0::double * ln(1.0::double - {_U('radius', more=" || '|' || cast(i as varchar)")})) * cos(2 * 3.141592653589793::double * {_U('angle', more=" || '|' || cast(i as varchar)")})
      when fault = 'clipping' and {here} then {clip}
      when fault = 'scale_error' and {here} then {c} * case when {_U('inverse')} < 0.5 then 1.0::double / gain else gain end
      {f"when fault = 'sensor_swap' and inside and {c} is not null and {swap} is not null then {swap}" if swap else ""}
      else {c} end as scenario__{c}"""


GEN = f"""{HOURS}, a as (select g, (row_number() over (partition by g order by us) - 1) * {HOUR} as us, v, k, n from ev), b as (select g, us, v, k::double as k, n::double as n, g || ':' || cast(us // {BLOCK} * {BLOCK} as varchar) as window_id from a), c as (select *, count(*) over (partition by window_id) as rows from b), d as (select *, row_number() over (partition by window_id order by us) - 1 as i from c where rows = {LENGTH}),
 e as (select d.*, f.fault from d, (select unnest([{", ".join(f"'{f}'" for f in (*ROWS, "no_injection"))}]) as fault) f), h as (select *, cast(floor({_U('channel')} * 3) as int) as channel from e),
 s as (select *, cast({SPEC.history + SPEC.earliest} + floor({_U('start')} * {SPEC.latest - SPEC.earliest}) as int) as start from h), x as (select *, least(rows - {SPEC.tail}, start + cast({_RANGE(0)} + floor({_U('rows')} * ({_RANGE(1)} - {_RANGE(0)})) as int)) as stop, ({_PICK(SPEC.sizes, 0)} + {_U('size')} * ({_PICK(SPEC.sizes, 1)} - {_PICK(SPEC.sizes, 0)})) * case when {_U('sign')} < 0.5 then -1.0::double else 1.0::double end as size,
  {_PICK(SPEC.gains, 0)} + {_U('gain')} * ({_PICK(SPEC.gains, 1)} - {_PICK(SPEC.gains, 0)}) as gain from s), y as (select *, i >= start and i < stop as inside from x),
 z as (select *, {", ".join(_new(n, c) for n, c in enumerate(SPEC.channels))} from y window w as (partition by window_id, fault)),
 gen as (select *, scenario__v is distinct from v or scenario__k is distinct from k or scenario__n is distinct from n as modified, window_id || '|' || fault || '|0' as scenario_id from z)"""


@query("scenario_rows", f"with {GEN} select scenario_id, i, round(scenario__v, 6) + 0.0::double as scenario__v, round(scenario__k, 6) + 0.0::double as scenario__k, round(scenario__n, 6) + 0.0::double as scenario__n, case when modified then fault else 'no_injection' end as label from gen")
def scenario_rows(t: Tables) -> DataFrame:
    names = [f"scenario__{c}" for c in SPEC.channels]
    return r6(scenarios.generate_all(_windows(t), SPEC).select("scenario_id", F.col("i").cast("long").alias("i"), *names, "label"), *names)


@query("scenario_log", f"with {GEN} select scenario_id, fault, min(start) as start, min(stop) as stop, min(us) filter (modified) as first_modified, max(us) filter (modified) as last_modified, count(*) filter (modified) as modified_rows, count(*) filter (modified) > 0 as applied from gen group by 1, 2")
def scenario_log(t: Tables) -> DataFrame:
    return scenarios.event_log(scenarios.generate_all(_windows(t), SPEC)).drop("window_id").withColumn("start", F.col("start").cast("int")).withColumn("stop", F.col("stop").cast("long"))


_FLAG = "scenario__v is null or coalesce(abs(scenario__v - lag(scenario__v) over (partition by scenario_id order by i)) > 30, false)"


def _flagged(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    step = F.abs(F.col("scenario__v") - F.lag("scenario__v").over(Window.partitionBy("scenario_id").orderBy("i"))) > 30
    return scenarios.generate_all(_windows(t), SPEC).withColumn("predicted", F.col("scenario__v").isNull() | F.coalesce(step, F.lit(False)))


@query("scenario_evaluation", f"""with {GEN}, fl as (select *, {_FLAG} as p from gen), per as (select scenario_id, fault, count(*) as rows, count(*) filter (modified) as changed, count(*) filter (modified and p) as hits, count(*) filter (p) as flags, min(i) filter (modified and p) - min(i) filter (modified) as delay from fl group by 1, 2)
 select fault, sum(changed)::bigint as modified_rows, round(sum(case when fault = 'no_injection' then flags else hits end) / nullif(sum(case when fault = 'no_injection' then rows else changed end), 0)::double, 6) as row_recall, count(*) filter (changed > 0) as events, count(*) filter (hits > 0) as detected, round(count(*) filter (hits > 0) / nullif(count(*) filter (changed > 0), 0)::double, 6) as event_recall,
 round(quantile_cont(delay, 0.5), 6) as median_delay, round(quantile_cont(delay, 0.95), 6) as p95_delay, count(*) filter (changed = 0) as not_applied from per group by 1""")
def scenario_evaluation(t: Tables) -> DataFrame:
    return r6(scenarios.evaluate(_flagged(t)), "row_recall", "event_recall", "median_delay", "p95_delay")


@query("scenario_learning_rows", f"with {GEN}, p as (select *, case when us // {HOUR} % 7 < 4 then 'fit' else 'selection' end as split from gen) select split, fault, count(*) as rows, count(*) filter (modified) as modified from p where split <> 'fit' or i % 3 = 0 or (modified and fault = 'spike') group by 1, 2")
def scenario_learning_rows(t: Tables) -> DataFrame:
    d = scenarios.generate_all(_windows(t), SPEC).withColumn("split", F.when(F.floor(F.col("us") / HOUR) % 7 < 4, "fit").otherwise("selection"))
    return scenarios.partition_rows(d, "split").groupBy("split", "fault").agg(F.count("*").alias("rows"), F.count_if("modified").alias("modified"))


@query("scenario_export", f"with {GEN} select scenario_id, us, round(v, 6) as v, round(scenario__v, 6) + 0.0::double as scenario__v, modified from gen where fault in ('bias', 'stuck')")
def scenario_export(t: Tables) -> DataFrame:
    d = scenarios.generate(_windows(t), "bias", SPEC).unionByName(scenarios.generate(_windows(t), "stuck", SPEC))
    return r6(scenarios.export_rows(d, SPEC.channels).select("scenario_id", "us", "v", "scenario__v", "modified"), "v", "scenario__v")


@query("scenario_chart", f"with {GEN} select scenario_id, us, s as series, round(x, 6) as value from (select scenario_id, us, 'original' as s, v as x from gen where fault = 'dropout' union all select scenario_id, us, 'scenario', scenario__v from gen where fault = 'dropout') where x is not null")
def scenario_chart(t: Tables) -> DataFrame:
    return r6(scenarios.chart_points(scenarios.generate(_windows(t), "dropout", SPEC), "v"), "value")


@query("operational_feed", f"with {HOURS}, a as (select *, row_number() over (partition by g order by us) - 1 as i from ev) select g, us, i in (188, 192, 205) as altered, round(case when i in (188, 192, 205) then v + 5 else v end, 6) as feed, case when i < 180 then 'warm_up' else 'live' end as phase from a")
def operational_feed(t: Tables) -> DataFrame:
    return r6(scenarios.feed(t.hours(), ["g"]).select("g", "us", "altered", "feed", "phase"), "feed")
