"""Registered queries: each operator bound to the driver tables, with the DuckDB statement that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isobar.functions import physics, seq
from isobar.operators import detect, evaluate, network, quality
from isobar.operators.detect import ObservationSpec

HOUR = 3_600_000_000
DAY = 24 * HOUR
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SPEC = ObservationSpec(keys=["g"], channels=("v",), cadence=HOUR, horizons=(1, 24), lags=(0, 1, 3, 24), sustained=6)


class Tables:
    """The driver tables as observation frames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def hours(self) -> DataFrame:
        """events -> event type and clock hour: median value, largest k, count."""
        k = F.get_json_object("props", "$.k").cast("long")
        return self.raw("events").groupBy(F.col("event_type").alias("g"), us(F.date_trunc("hour", "ts")).alias("us")).agg(F.percentile("value", 0.5).alias("v"), F.max(k).alias("k"), F.count("*").alias("n"))

    def users(self) -> DataFrame:
        return self.raw("events").select(F.col("user_id").alias("g"), us(F.col("ts")).alias("us"), F.col("event_id").alias("id"), F.col("value").alias("v"), F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("k"))

    def labels(self) -> DataFrame:
        """documents with a toxic label (NULL where unlabelled) and the length as score."""
        return self.raw("documents").select("doc_id", F.col("source").alias("g"), F.col("n_chars").cast("double").alias("score")).join(self.raw("labels").select("doc_id", F.col("toxic").alias("y"), F.col("quality")), "doc_id", "left").withColumn("p", (F.col("score") >= 3000).cast("int"))

    def geo(self) -> DataFrame:
        """Nations as stations on a synthetic grid."""
        return self.raw("nation").select(F.col("n_nationkey").alias("station"), (F.col("n_nationkey") % 5 * 1.5).alias("lat"), (F.floor(F.col("n_nationkey") / 5) * 1.25).alias("lon"))

    def network(self) -> DataFrame:
        """Suppliers' balances: one value per nation and balance bucket, as if the bucket were the time."""
        s = self.raw("supplier")
        return s.groupBy(F.col("s_nationkey").alias("station"), (F.col("s_suppkey") % 7).alias("us")).agg(F.percentile("s_acctbal", 0.5).alias("v"))


def us(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) + F.lit(0.0) for n in names})  # no negative zero


HOURS = """ev as (select event_type as g, epoch_us(date_trunc('hour', ts)) as us, quantile_cont(value, 0.5) as v,
  max(cast(json_extract(props, '$.k') as bigint)) as k, count(*) as n from events group by 1, 2)"""
USERS = "eu as (select user_id as g, epoch_us(ts) as us, event_id as id, value as v, event_type as kind, cast(json_extract(props, '$.k') as bigint) as k from events)"
LABELS = "lab as (select d.doc_id, source as g, cast(n_chars as double) as score, toxic as y, quality, cast(n_chars >= 3000 as int) as p from documents d left join labels l using (doc_id))"
H = str(HOUR)
SIG = f"""{HOURS}, s0 as (select *, coalesce(us - lag(us) over w = {H}, false) as adj, coalesce(us - lag(us) over w = {H} and v = lag(v) over w, false) as same,
  first_value(v) over (partition by g order by us range between {H} preceding and {H} preceding) as p1,
  first_value(v) over (partition by g order by us range between {24 * HOUR} preceding and {24 * HOUR} preceding) as p24, lag(v) over w as prev from ev window w as (partition by g order by us)),
 s1 as (select *, sum(case when adj then 0 else 1 end) over (partition by g order by us) as run, sum(case when same then 0 else 1 end) over (partition by g order by us) as frun from s0),
 sig as (select g, us, v, abs(v - p1) as forecast_residual, case when adj then abs(v - prev) end as abrupt_change,
  cast(row_number() over (partition by g, frun order by us) - 1 as double) as flatline, abs(v - p24) as hour_residual,
  abs(case when count(v - p24) over f >= 6 then avg(v - p24) over f end) as sustained_deviation, run from s1
  window f as (partition by g, run order by us rows between 5 preceding and current row))"""
LONG = SIG + """, lng as (select g, us, 'v' as channel, 'forecast_residual' as signal, forecast_residual as value from sig union all select g, us, 'v', 'abrupt_change', abrupt_change from sig
  union all select g, us, 'v', 'flatline', flatline from sig union all select g, us, 'v', 'hour_residual', hour_residual from sig union all select g, us, 'v', 'sustained_deviation', sustained_deviation from sig)"""
THR = LONG + """, rk as (select channel, signal, value, row_number() over (partition by channel, signal order by value) as rn, count(*) over (partition by channel, signal) as n from lng where value is not null),
  thr as (select channel, signal, value as threshold, n as reference_rows from rk where rn = ceil(0.98::double * (n - 1)) + 1)"""
DEC = THR + """, dec as (select g, us, l.channel, max(case when threshold = 0 then case when value > 0 then 2.0::double else 0.0::double end else value / nullif(threshold, 0) end) as score,
  bool_or(value > threshold) as alert,
  coalesce(string_agg(case when value > threshold then l.signal end, '|' order by list_position(['forecast_residual', 'abrupt_change', 'flatline', 'hour_residual', 'sustained_deviation'], l.signal)), '') as reason_codes
  from lng l join thr t on l.channel = t.channel and l.signal = t.signal group by 1, 2, 3)"""


def query(name: str, oracle: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _valued(t: Tables) -> DataFrame:
    """Decisions with the value they were made on; thresholds are 5 rows, and rows keep the signals' one exchange on the group."""
    signals = detect.compute_signals(t.hours(), SPEC)
    thr = detect.higher_quantile(detect.long_signals(signals, SPEC), ["channel", "signal"], "value", 0.98)
    return detect.decide_wide(signals, SPEC, thr)


def _decisions(t: Tables) -> DataFrame:
    return _valued(t).drop("value")


# --- detector -----------------------------------------------------------------------------------------------------------


@query("candidate_events", f"""with {DEC}, a as (select *, coalesce(us - lag(us) over (partition by g, channel order by us) = {H}, false) as adj from dec where alert),
 b as (select *, sum(case when adj then 0 else 1 end) over (partition by g, channel order by us) as run from a)
 select g, channel, start_us, end_us, observations, round(max_score, 6) as max_score, reasons, first_id, last_id,
  'candidate-' || substr(sha256('["candidate", "' || g || '", "' || channel || '", "' || first_id || '", "' || last_id || '"]'), 1, 20) as event_id
 from (select g, channel, min(us) as start_us, max(us) as end_us, count(*) as observations, max(score) as max_score, array_to_string(list_sort(list(distinct reason_codes)), ',') as reasons,
  cast(min(us) as varchar) as first_id, cast(max(us) as varchar) as last_id from b group by g, channel, run)""")
def candidate_events(t: Tables) -> DataFrame:
    return r6(detect.candidate_events(_decisions(t), ["g", "channel"], HOUR, ident="us"), "max_score")


@query("exact_lag_features", f"""with {HOURS} select g, us, round(v, 6) as v, {', '.join(f"round(first_value(v) over (partition by g order by us range between {(1 + k) * HOUR} preceding and {(1 + k) * HOUR} preceding), 6) as v__h1_lag{k}" for k in (0, 1, 3, 24))} from ev""")
def exact_lag_features(t: Tables) -> DataFrame:
    d = detect.exact_lag_features(t.hours(), SPEC, 1)
    return r6(d.select("g", "us", "v", *[f"v__h1_lag{k}" for k in SPEC.lags]), "v", *[f"v__h1_lag{k}" for k in SPEC.lags])


@query("lag_feature_differences", f"""with {HOURS}, x as (select g, us, {', '.join(f"first_value(v) over (partition by g order by us range between {(1 + k) * HOUR} preceding and {(1 + k) * HOUR} preceding) as l{k}" for k in (0, 1, 3, 24))} from ev)
 select g, us, round(l0 - l1, 6) as v__h1_diff1, round(l0 - l3, 6) as v__h1_diff3, round(l0 - l24, 6) as v__h1_diff24, l0 is not null and l1 is not null and l3 is not null and l24 is not null as complete_h1 from x""")
def lag_feature_differences(t: Tables) -> DataFrame:
    names = ["v__h1_diff1", "v__h1_diff3", "v__h1_diff24"]
    return r6(detect.exact_lag_features(t.hours(), SPEC, 1).select("g", "us", *names, "complete_h1"), *names)


@query("seasonal_lag_features", f"""with {HOURS} select g, us, round(first_value(v) over (partition by g order by us range between {23 * HOUR} preceding and {23 * HOUR} preceding), 6) as seasonal,
 round(sin(2 * pi() * hour(make_timestamp(us)) / 24), 6) + 0.0::double as hour_sin, round(cos(2 * pi() * hour(make_timestamp(us)) / 24), 6) + 0.0::double as hour_cos from ev""")
def seasonal_lag_features(t: Tables) -> DataFrame:
    s, c = physics.cyclic(F.hour(F.timestamp_micros("us")), 24.0)
    return r6(t.hours().select("g", "us", seq.exact_lag("v", 23 * HOUR, ["g"]).alias("seasonal"), s.alias("hour_sin"), c.alias("hour_cos")), "seasonal", "hour_sin", "hour_cos")


@query("five_signals", f"with {SIG} select g, us, round(forecast_residual, 6) as forecast_residual, round(abrupt_change, 6) as abrupt_change, flatline, round(hour_residual, 6) as hour_residual, round(sustained_deviation, 6) as sustained_deviation from sig")
def five_signals(t: Tables) -> DataFrame:
    d = detect.compute_signals(t.hours(), SPEC)
    return r6(d.select("g", "us", *[F.col(f"v__{s}").alias(s) for s in detect.SIGNALS]), *detect.SIGNALS)


@query("flatline_duration", f"with {HOURS}, a as (select *, coalesce(us - lag(us) over w = {H} and k = lag(k) over w, false) as same from ev window w as (partition by g order by us)), b as (select *, sum(case when same then 0 else 1 end) over (partition by g order by us) as run from a) select g, us, row_number() over (partition by g, run order by us) - 1 as flat from b")
def flatline_duration(t: Tables) -> DataFrame:
    return seq.flatline(t.hours(), "k", HOUR, ["g"], "flat").select("g", "us", "flat")


@query("flatline_quality", f"with {HOURS}, a as (select *, n >= 2 as acc, coalesce(us - lag(us) over w = {H} and k = lag(k) over w, false) as same from ev window w as (partition by g order by us)), b as (select *, sum(case when same then 0 else 1 end) over (partition by g order by us) as run from a) select g, us, row_number() over (partition by g, run order by us) - 1 as flat, bool_and(acc) over (partition by g, run order by us) as flat__ok from b")
def flatline_quality(t: Tables) -> DataFrame:
    return seq.flatline(t.hours().withColumn("acc", F.col("n") >= 2), "k", HOUR, ["g"], "flat", accepted="acc").select("g", "us", "flat", "flat__ok")


@query("gap_runs", f"with {HOURS}, a as (select *, coalesce(us - lag(us) over (partition by g order by us) = {H}, false) as adj from ev), b as (select *, sum(case when adj then 0 else 1 end) over (partition by g order by us) as run from a) select g, cast(run as bigint) as run, min(us) as start_us, max(us) as end_us, count(*) as rows from b group by 1, 2")
def gap_runs(t: Tables) -> DataFrame:
    return seq.gap_runs(t.hours(), HOUR, ["g"]).groupBy("g", "run").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("rows"))


for _mode, _f in (("ceil", "ceil"), ("floor", "floor")):
    query(f"missing_intervals_{_mode}", f"with {HOURS}, a as (select g, us, lag(us) over (partition by g order by us) as last_us from ev) select g, last_us, us as next_us, cast(greatest({_f}((us - last_us) / {float(HOUR)}) - 1, 0) as bigint) as slots from a where us - last_us > {H}")(lambda t, m=_mode: detect.missing_intervals(t.hours(), HOUR, ["g"], rounding=m))


@query("higher_quantile_thresholds", f"with {LONG}, r as (select g, channel, signal, value, row_number() over (partition by g, signal order by value) as rn, count(*) over (partition by g, signal) as n from lng where value is not null), p as (select signal, value, row_number() over (partition by signal order by value) as rn, count(*) over (partition by signal) as n from lng where value is not null) select g, channel, signal, round(value, 6) as threshold, n as reference_rows from r where rn = ceil(0.95::double * (n - 1)) + 1 union all select 'pooled', 'v', signal, round(value, 6), n from p where rn = ceil(0.95::double * (n - 1)) + 1")
def higher_quantile_thresholds(t: Tables) -> DataFrame:
    long = detect.long_signals(detect.compute_signals(t.hours(), SPEC), SPEC)
    return r6(detect.fit_thresholds(long, ["g"], 0.95), "threshold")


@query("threshold_lookup_fallback", f"with {LONG}, r as (select g, signal, value, row_number() over (partition by g, signal order by value) as rn, count(*) over (partition by g, signal) as n from lng where value is not null and g <> 'click'), p as (select signal, value, row_number() over (partition by signal order by value) as rn, count(*) over (partition by signal) as n from lng where value is not null and g <> 'click'), o as (select g, signal, value as t from r where rn = ceil(0.95::double * (n - 1)) + 1), q as (select signal, value as t from p where rn = ceil(0.95::double * (n - 1)) + 1) select l.g, l.us, l.signal, round(coalesce(o.t, q.t), 6) as threshold, case when o.t is null then 'pooled' else l.g end as threshold_group from lng l left join o on l.g = o.g and l.signal = o.signal left join q on l.signal = q.signal")
def threshold_lookup_fallback(t: Tables) -> DataFrame:
    long = detect.long_signals(detect.compute_signals(t.hours(), SPEC), SPEC)
    table = detect.fit_thresholds(long.where("g <> 'click'"), ["g"], 0.95)
    return r6(detect.with_fallback(long, table, ["g"], "threshold").select("g", "us", "signal", "threshold", "threshold_group"), "threshold")


@query("apply_thresholds", f"with {DEC} select g, us, channel, round(score, 6) as score, alert, reason_codes from dec")
def apply_thresholds(t: Tables) -> DataFrame:
    return r6(_decisions(t), "score")


@query("wide_decisions", f"with {SIG} select g, us, round(greatest(forecast_residual / 60, abrupt_change / 60, flatline / 2), 6) as anomaly_score, case when coalesce(forecast_residual, abrupt_change, flatline) is not null then coalesce(forecast_residual > 60, false) or coalesce(abrupt_change > 60, false) or coalesce(flatline > 2, false) end as alert, concat_ws('|', case when forecast_residual > 60 then 'v:forecast_residual' end, case when abrupt_change > 60 then 'v:abrupt_change' end, case when flatline > 2 then 'v:flatline' end) as reason_codes from sig")
def wide_decisions(t: Tables) -> DataFrame:
    limits = {("v", "forecast_residual"): 60.0, ("v", "abrupt_change"): 60.0, ("v", "flatline"): 2.0}
    return r6(detect.wide_decisions(detect.compute_signals(t.hours(), SPEC), SPEC, limits).select("g", "us", "anomaly_score", "alert", "reason_codes"), "anomaly_score")


@query("unpivot_decisions", f"with {LONG} select g, us, channel, signal, round(value, 6) as value from lng")
def unpivot_decisions(t: Tables) -> DataFrame:
    return r6(detect.long_signals(detect.compute_signals(t.hours(), SPEC), SPEC), "value")


@query("background_windows", f"""with {DEC}, a as (select *, coalesce(us - lag(us) over (partition by g, channel order by us) = {H}, false) as adj from dec where alert = false),
 b as (select *, sum(case when adj then 0 else 1 end) over (partition by g, channel order by us) as run from a), c as (select *, (row_number() over (partition by g, channel, run order by us) - 1) // 3 as w from b),
 d as (select g, channel, min(us) as start_us, max(us) as end_us, count(*) as observations from c group by g, channel, run, w having count(*) = 3),
 e as (select *, row_number() over (partition by g, channel order by start_us) - 1 as i, count(*) over (partition by g, channel) as n from d)
 select g, channel, start_us, end_us, observations from e where list_contains(case when least(n, 3) = 1 then [0] else list_transform(range(least(n, 3)), lambda j: cast(floor(j * (n - 1) / (least(n, 3) - 1)) as bigint)) end, i)""")
def background_windows(t: Tables) -> DataFrame:
    return detect.background_windows(_decisions(t), ["g", "channel"], HOUR, 3, 3)


REVIEWS = f"rev as (select 'r' || cast(row_number() over (order by g) as varchar) as review_id, g, 'v' as channel, lo + 2 * {DAY} as start_us, lo + 9 * {DAY} as end_us, lo + 2 * {DAY} as onset_earliest_us, lo + 3 * {DAY} as onset_latest_us from (select g, min(us) as lo from ev group by 1))"


def _reviews(t: Tables) -> DataFrame:
    lo = t.hours().groupBy("g").agg(F.min("us").alias("lo"))
    i = F.row_number().over(Window.orderBy("g"))
    return lo.select(F.concat(F.lit("r"), i.cast("string")).alias("review_id"), "g", F.lit("v").alias("channel"), (F.col("lo") + 2 * DAY).alias("start_us"), (F.col("lo") + 9 * DAY).alias("end_us"), (F.col("lo") + 2 * DAY).alias("onset_earliest_us"), (F.col("lo") + 3 * DAY).alias("onset_latest_us"))


@query("reviewed_event_eval", f"with {DEC}, {REVIEWS} select r.review_id, count(d.alert) as scored_rows, count(*) filter (d.alert) as alert_rows, count(*) filter (d.alert) > 0 as detected, round((min(d.us) filter (d.alert) - max(r.onset_latest_us)) / 1e6, 6) as delay_min_s, round((min(d.us) filter (d.alert) - max(r.onset_earliest_us)) / 1e6, 6) as delay_max_s from rev r left join dec d on d.g = r.g and d.channel = r.channel and d.us >= r.start_us and d.us < r.end_us group by 1")
def reviewed_event_eval(t: Tables) -> DataFrame:
    return r6(detect.evaluate_reviews(_decisions(t), _reviews(t), ["g", "channel"]), "delay_min_s", "delay_max_s")


@query("review_template", f"with {DEC}, a as (select *, coalesce(us - lag(us) over (partition by g, channel order by us) = {H}, false) as adj from dec where alert), b as (select *, sum(case when adj then 0 else 1 end) over (partition by g, channel order by us) as run from a) select g, channel, min(us) as start_us, max(us) + {H} as end_us, 'unknown' as review_status from b group by g, channel, run")
def review_template(t: Tables) -> DataFrame:
    e = detect.candidate_events(_decisions(t), ["g", "channel"], HOUR, ident="us")
    return e.select("g", "channel", "start_us", (F.col("end_us") + HOUR).alias("end_us"), F.lit("unknown").alias("review_status"))


@query("overlap_check", f"with {USERS}, i as (select g, id, us as start_us, us + 12 * {H} as end_us from eu) select g, id, coalesce(max(end_us) over (partition by g order by start_us, end_us rows between unbounded preceding and 1 preceding) > start_us, false) as overlap from i")
def overlap_check(t: Tables) -> DataFrame:
    return detect.overlaps(t.users().select("g", "id", F.col("us").alias("start_us"), (F.col("us") + 12 * HOUR).alias("end_us")), ["g"]).select("g", "id", "overlap")


@query("union_series_segments", f"with {SIG}, a as (select g, us, forecast_residual as value from sig), b as (select *, not coalesce(us - lag(us) over w = {H} and lag(value) over w is not null and value is not null, false) as fresh from a window w as (partition by g order by us)), c as (select *, sum(fresh::int) over (partition by g order by us) as segment from b) select g, us, cast(segment as bigint) as segment, round(value, 6) as value from c where value is not null")
def union_series_segments(t: Tables) -> DataFrame:
    d = detect.compute_signals(t.hours(), SPEC).select("g", "us", F.col("v__forecast_residual").alias("value"))
    return r6(detect.segments(d, "value", HOUR, ["g"]).select("g", "us", F.col("segment").cast("long"), "value"), "value")


@query("top_events", f"with {DEC}, a as (select *, coalesce(us - lag(us) over (partition by g, channel order by us) = {H}, false) as adj from dec where alert), b as (select *, sum(case when adj then 0 else 1 end) over (partition by g, channel order by us) as run from a) select g, start_us, round(max_score, 6) as max_score from (select g, min(us) as start_us, max(score) as max_score from b group by g, channel, run order by max_score desc, start_us, g limit 10)")
def top_events(t: Tables) -> DataFrame:
    e = detect.candidate_events(_decisions(t), ["g", "channel"], HOUR, ident="us")
    return r6(e.orderBy(F.desc("max_score"), "start_us", "g").limit(10).select("g", "start_us", "max_score"), "max_score")


@query("signal_evidence", f"with {THR} select l.g, l.us, l.signal, round(l.value, 6) as value, round(t.threshold, 6) as threshold, case when l.value is null then 'Unavailable' when l.value > t.threshold then 'Yes' else 'No' end as crossed from lng l join thr t on l.signal = t.signal")
def signal_evidence(t: Tables) -> DataFrame:
    long = detect.long_signals(detect.compute_signals(t.hours(), SPEC), SPEC)
    thr = detect.higher_quantile(long, ["channel", "signal"], "value", 0.98)
    crossed = F.when(F.col("value").isNull(), "Unavailable").when(F.col("value") > F.col("threshold"), "Yes").otherwise("No")
    return r6(long.join(F.broadcast(thr), ["channel", "signal"]).select("g", "us", "signal", "value", "threshold", crossed.alias("crossed")), "value", "threshold")


# --- sequence features and the hourly path ------------------------------------------------------------------------------


_PAT_RUNS = f"""{HOURS}, adj as (select *, coalesce(us - lag(us) over (partition by g order by us) = {H}, false) as near from ev), runs as (select *, sum(case when near then 0 else 1 end) over (partition by g order by us) as run from adj),
 same as (select *, coalesce(v = lag(v) over (partition by g, run order by us), false) as eq from runs), held as (select *, sum(case when eq and coalesce(lag_eq, false) then 0 else 1 end) over (partition by g, run order by us) as hr from (select *, lag(eq) over (partition by g, run order by us) as lag_eq from same))"""
_PAT_DELTAS, _PAT_WINDOWS = (1, 5, 15, 60, 120), (5, 30, 120)
_PAT_STATS = ", ".join(f"case when count(v) over f{k} >= {max(2, k // 2)} then avg(v) over f{k} end as m{k}, case when count(v) over f{k} >= {max(2, k // 2)} then stddev_pop(v) over f{k} end as s{k}, count(v) over f{k} / {k}.0::double as c{k}" for k in _PAT_WINDOWS)
_PAT_FRAMES = ", ".join(f"f{k} as (partition by g, run order by us rows between {k} preceding and 1 preceding)" for k in _PAT_WINDOWS)
_PAT_NAMES = [*[f"v__delta{k}" for k in _PAT_DELTAS], *[f"v__{n}{k}" for k in _PAT_WINDOWS for n in ("mean", "std", "deviation", "coverage")], "v__mean_shift", "v__range_excess"]


@query("pattern_features", f"""with {_PAT_RUNS}, w as (select g, us, v, {", ".join(f"v - lag(v, {k}) over r as d{k}" for k in _PAT_DELTAS)}, {_PAT_STATS}, case when eq then row_number() over (partition by g, run, hr order by us) else 0 end as rep
 from held window r as (partition by g, run order by us), {_PAT_FRAMES})
 select g, us, (v is null)::int::double as v__missing, round(greatest(20.0 - v, v - 80.0, 0.0::double), 6) as v__range_excess, {", ".join(f"round(d{k}, 6) as v__delta{k}" for k in _PAT_DELTAS)}, least(rep, 180) as v__repeat, 0::bigint as v__absent,
 {", ".join(f"round(m{k}, 6) as v__mean{k}, round(s{k}, 6) as v__std{k}, round(v - m{k}, 6) as v__deviation{k}, round((v - m{k}) / greatest(s{k}, 0.1::double), 4) as v__z{k}, round(c{k}, 6) as v__coverage{k}" for k in _PAT_WINDOWS)},
 round(s5 / greatest(s120, 0.1::double), 4) as v__variability, round(m5 - m120, 6) as v__mean_shift from w""")
def pattern_features(t: Tables) -> DataFrame:
    d = quality.pattern_features(t.hours(), "v", HOUR, ["g"], bounds=(20.0, 80.0))
    four = [F.round(c, 4).alias(c) for c in ("v__z5", "v__z30", "v__z120", "v__variability")]
    return r6(d.select("g", "us", "v__missing", *_PAT_NAMES, "v__repeat", F.col("v__absent").cast("long").alias("v__absent"), *four), *_PAT_NAMES)


@query("pattern_products", f"with {_PAT_RUNS}, w as (select g, us, (v - case when count(v) over f >= 15 then avg(v) over f end) / greatest(case when count(v) over f >= 15 then stddev_pop(v) over f end, 0.1::double) as a, (k - case when count(k) over f >= 15 then avg(k) over f end) / greatest(case when count(k) over f >= 15 then stddev_pop(k) over f end, 0.1::double) as b from held window f as (partition by g, run order by us rows between 30 preceding and 1 preceding)) select g, us, round(a * b, 4) as product from w")
def pattern_products(t: Tables) -> DataFrame:
    d = quality.pattern_features(t.hours().withColumn("k", F.col("k").cast("double")), "v", HOUR, ["g"], deltas=(), windows=(30,))
    d = quality.pattern_features(d, "k", HOUR, ["g"], deltas=(), windows=(30,))
    return d.select("g", "us", F.round(F.col("v__z30") * F.col("k__z30"), 4).alias("product"))


@query("pattern_corr", f"""with {HOURS}, a as (select *, coalesce(us - lag(us) over (partition by g order by us) = {H}, false) as adj from ev), b as (select *, sum(case when adj then 0 else 1 end) over (partition by g order by us) as run from a),
 c as (select g, us, run, v - lag(v) over r as a, cast(k - lag(k) over r as double) as b from b window r as (partition by g, run order by us))
 select g, us, round(case when count(a + b) over f >= 15 and max(a) over f - min(a) over f > 1e-8 and max(b) over f - min(b) over f > 1e-8 then corr(a, b) over f end, 5) as corr from c window f as (partition by g, run order by us rows between 29 preceding and current row)""")
def pattern_corr(t: Tables) -> DataFrame:
    d = quality.guarded_corr(t.hours().withColumn("k", F.col("k").cast("double")), "v", "k", HOUR, ["g"])
    return d.select("g", "us", F.round("corr", 5).alias("corr"))


@query("hourly_window_features", f"with {HOURS} select g, us, round(v - lag(v) over w, 6) as diff1, round(case when count(v) over w6 >= 2 then stddev_samp(v) over w6 end, 6) as std6, round(case when count(v) over w24 >= 3 then avg(v) over w24 end, 6) as mean24, round(min(v) over w3, 6) as min3, round(max(v) over w3, 6) as max3 from ev window w as (partition by g order by us), w6 as (partition by g order by us rows between 5 preceding and current row), w24 as (partition by g order by us rows between 23 preceding and current row), w3 as (partition by g order by us rows between 2 preceding and current row)")
def hourly_window_features(t: Tables) -> DataFrame:
    w = seq.ordered(["g"])
    f = lambda n: w.rowsBetween(-(n - 1), 0)
    return r6(t.hours().select("g", "us", (F.col("v") - F.lag("v").over(w)).alias("diff1"), seq.guarded(F.stddev_samp("v"), "v", f(6), 2).alias("std6"), seq.guarded(F.avg("v"), "v", f(24), 3).alias("mean24"), F.min("v").over(f(3)).alias("min3"), F.max("v").over(f(3)).alias("max3")), "diff1", "std6", "mean24", "min3", "max3")


@query("spike_second_difference", f"with {HOURS}, a as (select *, v - lag(v) over (partition by g order by us) as d from ev), b as (select *, abs(d) as a, abs(d - lag(d) over (partition by g order by us)) as dd from a), c as (select *, coalesce(case when count(a) over r >= 12 then quantile_cont(a, 0.5) over r end, case when count(a) over e >= 2 then quantile_cont(a, 0.5) over e end) as s from b window r as (partition by g order by us rows between 72 preceding and 1 preceding), e as (partition by g order by us rows between unbounded preceding and 1 preceding)) select g, us, coalesce(dd > 3.0 * greatest(s, 0.001::double), false) as v__spike from c")
def spike_second_difference(t: Tables) -> DataFrame:
    return quality.spike(t.hours(), "v", ["g"], factor=3.0).select("g", "us", "v__spike")


@query("step_flags", f"with {HOURS} select g, us, coalesce(abs(v - lag(v) over (partition by g order by us)) > 40, false) as v__step from ev")
def step_flags(t: Tables) -> DataFrame:
    return quality.step_flag(t.hours(), "v", ["g"], 40.0).select("g", "us", "v__step")


@query("flatline_flags", f"with {HOURS}, a as (select *, coalesce(k = lag(k) over (partition by g order by us), false) as eq from ev), b as (select *, sum(case when eq then 0 else 1 end) over (partition by g order by us) as r from a) select g, us, k is not null and row_number() over (partition by g, r order by us) >= 3 as k__stuck from b")
def flatline_flags(t: Tables) -> DataFrame:
    return quality.stuck_flag(t.hours(), "k", ["g"], 3).select("g", "us", "k__stuck")


@query("zero_run_flags", f"with {USERS}, a as (select *, k % 3 = 0 as h from eu), b as (select *, sum(case when h and coalesce(lag(h) over w, false) then 0 else 1 end) over w as r from (select *, 1 as one from a) window w as (partition by g order by us)) select g, id, coalesce(h and row_number() over (partition by g, r order by us) >= 2, false) as k__dropout from b".replace("sum(case when h and coalesce(lag(h) over w, false) then 0 else 1 end) over w as r from (select *, 1 as one from a) window w as (partition by g order by us)", "sum(case when h and p then 0 else 1 end) over (partition by g order by us) as r from (select *, coalesce(lag(h) over (partition by g order by us), false) as p from a)"))
def zero_run_flags(t: Tables) -> DataFrame:
    return quality.zero_run_flag(t.users().withColumn("k", (F.col("k") % 3).cast("double")), "k", ["g"], 2).select("g", "id", "k__dropout")


@query("thinning_first_per_bucket", f"with {USERS}, a as (select *, row_number() over (partition by kind, us // {DAY} order by us, id) as r from eu) select kind, us, id, v from a where r = 1")
def thinning_first_per_bucket(t: Tables) -> DataFrame:
    return quality.thin(t.users(), ["kind"], DAY, tie="id").select("kind", "us", "id", "v")


@query("chronological_splits", f"with {USERS} select id, case when us < lo + 15 * {DAY} then 'train' when us < lo + 20 * {DAY} then 'selection' when us < lo + 25 * {DAY} then 'calibration' else 'reserved' end as split from eu, (select min(us) as lo from eu)")
def chronological_splits(t: Tables) -> DataFrame:
    d = t.users()
    d = d.crossJoin(F.broadcast(d.agg(F.min("us").alias("lo"))))
    at = lambda n: F.col("us") < F.col("lo") + n * DAY
    return d.select("id", F.when(at(15), "train").when(at(20), "selection").when(at(25), "calibration").otherwise("reserved").alias("split"))


@query("fractional_splits", f"with {HOURS}, a as (select us, row_number() over (order by us) as r, count(*) over () as m from (select distinct us from ev)) select g, us, case when r <= floor(m * 0.7::double) then 'train' when r <= floor(m * 0.85::double) then 'validation' else 'test' end as split from ev join a using (us)")
def fractional_splits(t: Tables) -> DataFrame:
    # the boundaries are two order statistics of the distinct times, found on counts per time
    times = t.hours().select("us").distinct()
    d = times.withColumn("r", F.row_number().over(Window.orderBy("us"))).withColumn("n", F.count("*").over(Window.partitionBy()))
    d = d.select("us", F.when(F.col("r") <= F.floor(F.col("n") * 0.7), "train").when(F.col("r") <= F.floor(F.col("n") * 0.85), "validation").otherwise("test").alias("split"))
    return t.hours().join(d, "us").select("g", "us", "split")


PHYS = "ph as (select l_orderkey as o, l_linenumber as n, l_partkey as pk, l_quantity as t, 50 + l_discount * 500 as rh, l_tax * 1000 as deg, l_extendedprice as price from lineitem)"


def _phys(t: Tables) -> DataFrame:
    return t.raw("lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("pk"), F.col("l_quantity").alias("t"), (50 + F.col("l_discount") * 500).alias("rh"), (F.col("l_tax") * 1000).alias("deg"), F.col("l_extendedprice").alias("price"))


_TD = "least(greatest(243.04 * (ln(least(greatest(rh, 0.001), 120.0) / 100.0) + 17.625 * t / (243.04 + t)) / (17.625 - (ln(least(greatest(rh, 0.001), 120.0) / 100.0) + 17.625 * t / (243.04 + t))), -60.0), 60.0)"


@query("physics_derived", f"with {PHYS} select o, n, pk, round({_TD}, 5) as td, round(t - {_TD}, 5) + 0.0::double as depression, round(6.112 * exp(17.67 * t / (t + 243.5)), 5) as es, round(6.112 * exp(17.67 * t / (t + 243.5)) * (1 - least(greatest(rh, 0.0), 100.0) / 100.0), 5) + 0.0::double as vpd from ph")
def physics_derived(t: Tables) -> DataFrame:
    x, rh = F.col("t"), F.col("rh")
    td = physics.dew_point(x, rh)
    return _phys(t).select("o", "n", "pk", F.round(td, 5).alias("td"), (F.round(x - td, 5) + F.lit(0.0)).alias("depression"), F.round(physics.saturation_pressure(x), 5).alias("es"), (F.round(physics.vapour_deficit(x, rh), 5) + F.lit(0.0)).alias("vpd"))


@query("dewpoint_to_rh", f"with {PHYS} select o, n, pk, round(least(greatest(100 * exp(17.625 * (t - 3) / (243.04 + t - 3) - 17.625 * t / (243.04 + t)), 0.0), 100.0), 5) as rh, round(100 * exp(17.625 * (t + 3) / (243.04 + t + 3) - 17.625 * t / (243.04 + t)), 5) as rh_free from ph")
def dewpoint_to_rh(t: Tables) -> DataFrame:
    x = F.col("t")
    return _phys(t).select("o", "n", "pk", F.round(physics.humidity_from_dew_point(x, x - 3), 5).alias("rh"), F.round(physics.humidity_from_dew_point(x, x + 3, clipped=False), 5).alias("rh_free"))


@query("wind_components", f"with {PHYS} select o, n, pk, round(-t * sin(radians(deg)), 6) + 0.0::double as u, round(-t * cos(radians(deg)), 6) + 0.0::double as w from ph")
def wind_components(t: Tables) -> DataFrame:
    u, w = physics.wind_components(F.col("t"), F.col("deg"))
    return r6(_phys(t).select("o", "n", "pk", u.alias("u"), w.alias("w")), "u", "w")


@query("range_consistency_flags", f"with {PHYS} select o, n, pk, t < -35 or t > 40 as t_flag, rh < 0 or rh > 95 as rh_flag, concat_ws('|', case when t < -35 or t > 40 then 'temperature' end, case when rh < 0 or rh > 95 then 'humidity' end) as reasons, round((2.0::double * (t < -35 or t > 40)::int + 1.0::double * (rh < 0 or rh > 95)::int) / 3.0, 6) as qc_score from ph")
def range_consistency_flags(t: Tables) -> DataFrame:
    a, b = physics.outside(F.col("t"), (-35.0, 40.0)), physics.outside(F.col("rh"), (0.0, 95.0))
    _, _, score = quality.qc_score({"t": a, "rh": b}, {"t"})
    return r6(_phys(t).select("o", "n", "pk", a.alias("t_flag"), b.alias("rh_flag"), F.concat_ws("|", F.when(a, "temperature"), F.when(b, "humidity")).alias("reasons"), score.alias("qc_score")), "qc_score")


@query("hourly_grid_impute", f"""with {HOURS}, sp as (select g, unnest(range(min(us), max(us) + 1, {H})) as us from ev group by g), a as (select sp.g, sp.us, ev.v as m from sp left join ev using (g, us)),
 b as (select *, last_value(m ignore nulls) over p as pv, last_value(case when m is not null then us end ignore nulls) over p as pt, first_value(m ignore nulls) over q as nv, first_value(case when m is not null then us end ignore nulls) over q as nt from a
 window p as (partition by g order by us rows between unbounded preceding and current row), q as (partition by g order by us rows between current row and unbounded following))
 select g, us, round(coalesce(m, case when (us - pt) / {float(HOUR)} <= 6 and nv is not null then pv + (nv - pv) * (us - pt) / nullif(nt - pt, 0) end), 6) as v, (m is null)::int::double as v__was_missing from b""")
def hourly_grid_impute(t: Tables) -> DataFrame:
    return r6(quality.hourly_grid(t.hours(), "v", ["g"]), "v")


LI = "li as (select l_returnflag || '|' || l_linestatus as g, l_shipdate as ts, l_quantity as v, l_orderkey as o, l_linenumber as n, l_partkey as pk from lineitem)"


def _lines(t: Tables) -> DataFrame:
    return t.raw("lineitem").select(F.concat_ws("|", "l_returnflag", "l_linestatus").alias("g"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("v"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("pk"))


@query("climatology_fit", f"with {LI} select f.g, cell0, normal, overall from (select g, cast(month(ts) as int) as cell0, quantile_cont(v, 0.5) as normal from li group by 1, 2) f join (select g, quantile_cont(v, 0.5) as overall from li group by 1) w on f.g = w.g")
def climatology_fit(t: Tables) -> DataFrame:
    return quality.climatology_fit(_lines(t), "v", ["g"], [F.month("ts")])


@query("climatology_residual", f"with {LI}, f as (select g, month(ts) as m, quantile_cont(v, 0.5) as normal from li where month(ts) <= 9 group by 1, 2), w as (select g, quantile_cont(v, 0.5) as overall from li where month(ts) <= 9 group by 1) select li.o, li.n, li.pk, li.ts, li.v - coalesce(normal, overall) as v__resid from li left join f on li.g = f.g and month(li.ts) = f.m left join w on li.g = w.g")
def climatology_residual(t: Tables) -> DataFrame:
    d = _lines(t)
    fit = quality.climatology_fit(d.where(F.month("ts") <= 9), "v", ["g"], [F.month("ts")])
    return quality.climatology_residual(d, fit, "v", ["g"], [F.month("ts")]).select("o", "n", "pk", "ts", "v__resid")


@query("robust_scale", f"with {LI} select g, quantile_cont(v, 0.5) as center, round(greatest(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 0.5 * stddev_samp(v), 0.001), 6) as scale from li group by 1")
def robust_scale(t: Tables) -> DataFrame:
    return r6(quality.robust_scale_fit(_lines(t), "v", ["g"]), "scale")


@query("feature_pruning", f"with {SIG}, r as (select 'forecast_residual' as feature, count(forecast_residual) / count(*)::double as coverage, stddev_samp(forecast_residual) as deviation from sig union all select 'sustained_deviation', count(sustained_deviation) / count(*)::double, stddev_samp(sustained_deviation) from sig union all select 'flatline', count(flatline) / count(*)::double, stddev_samp(flatline) from sig), k as (select *, coverage >= 0.5 and coalesce(deviation, 0) >= 0.001 as ok from r) select feature, round(coverage, 6) as coverage, round(deviation, 5) as deviation, ok or (not bool_or(ok) over () and row_number() over (order by coverage desc, feature) = 1) as kept from k")
def feature_pruning(t: Tables) -> DataFrame:
    d = detect.compute_signals(t.hours(), SPEC).select(*[F.col(f"v__{s}").alias(s) for s in ("forecast_residual", "sustained_deviation", "flatline")])
    out = quality.prune_features(d, d.columns)
    return out.select("feature", F.round("coverage", 6).alias("coverage"), F.round("deviation", 5).alias("deviation"), "kept")


RFIT = """a as (select g, us, v, abs(v - lag(v) over w) as d, case when count(v) over f >= 8 then stddev_samp(v) over f end as s, case when count(v) over l >= 24 then stddev_samp(v) over l end as long from ev window w as (partition by g order by us), f as (partition by g order by us rows between 7 preceding and current row), l as (partition by g order by us rows between 167 preceding and current row)),
 m as (select g, quantile_cont(v, 0.5) as med from ev group by 1), q as (select a.g, any_value(med) as med, quantile_cont(abs(v - med), 0.5) as mad, quantile_cont(abs(v - med), 0.95) as q95, quantile_cont(d, 0.5) as md, quantile_cont(s, 0.005) as lo, quantile_cont(s, 0.995) as hi, quantile_cont(long, 0.5) as usual from a join m on a.g = m.g group by 1),
 p as (select g, med, mad, greatest(1.4826 * mad, q95 / 3, 0.25) as sigma, greatest(1.4826 * md, 0.001) as sd, lo, hi, usual from q),
 fit as (select g, med, sigma, greatest(sd, 0.25 * sigma, 0.125) as sigma_d, greatest(hi, 0.125 * 1.4826 * mad, 0.5 * sd, 1e-6) as std_hi, greatest(0.5 * greatest(lo, 1e-9), 1e-9) as stuck, greatest(usual, 1e-6) as std_long from p)"""


@query("robust_fit_params", f"with {HOURS}, {RFIT} select g, {', '.join(f'round({c}, 5) as {c}' for c in ('med', 'sigma', 'sigma_d', 'std_hi', 'stuck', 'std_long'))} from fit")
def robust_fit_params(t: Tables) -> DataFrame:
    d = quality.robust_fit(t.hours(), "v", ["g"])
    return d.select("g", *[F.round(c, 5).alias(c) for c in ("med", "sigma", "sigma_d", "std_hi", "stuck", "std_long")])


@query("robust_channel_score", f"""with {HOURS}, {RFIT}, j as (select a.*, med, sigma, sigma_d, std_hi, stuck, std_long, coalesce(s <= stuck, false) as h, row_number() over (partition by a.g order by us) as i, case when count(v) over (partition by a.g order by us rows between 23 preceding and current row) >= 24 then max(v) over (partition by a.g order by us rows between 23 preceding and current row) end as top from a join fit on a.g = fit.g),
 j2 as (select *, abs(top - lag(top) over (partition by g order by us)) as move, coalesce(lag(h) over (partition by g order by us), false) as p from j),
 k as (select *, sum(case when h and p then 0 else 1 end) over (partition by g order by us) as r, case when count(move) over (partition by g order by us rows between 5 preceding and current row) >= 6 then max(move) over (partition by g order by us rows between 5 preceding and current row) end <= 1e-9 + 1e-3 * sigma as stale from j2),
 l as (select *, case when h then row_number() over (partition by g, r order by us) else 0 end as run, coalesce(top - v <= 1e-9 + 1e-3 * sigma and stale and s > stuck, false)::int::double as pin from k),
 n as (select *, case when count(pin) over c >= 8 then avg(pin) over c else 0 end as share, case when i >= 24 then long / std_long end as ratio from l window c as (partition by g order by us rows between 23 preceding and current row))
 select g, us, round(greatest(abs(v - med) / sigma, coalesce(d / sigma_d, 0), case when run > 0 then 3 + 4 * least(run / 48.0, 1.0) else 0 end, coalesce(greatest(0.0, s / std_hi - 1.25), 0), greatest((share - 0.20) / 0.15, 0) * 2.0, coalesce(case when ratio is not null then greatest(greatest(ratio, 1.0 / greatest(ratio, 1e-9)) - 1.30, 0) * 1.5 end, 0)), 4) as v__robust from n""")
def robust_channel_score(t: Tables) -> DataFrame:
    d = t.hours()
    return quality.robust_channel_score(d, quality.robust_fit(d, "v", ["g"]), "v", ["g"]).select("g", "us", F.round("v__robust", 4).alias("v__robust"))


@query("pooled_parameters", f"with {HOURS}, {RFIT}, o as (select * from fit where g <> 'click'), pool as (select quantile_cont(med, 0.5) as med, quantile_cont(sigma, 0.5) as sigma, quantile_cont(std_long, 0.5) as std_long from o), gs as (select distinct g from ev) select gs.g, round(coalesce(o.med, pool.med), 5) as med, round(coalesce(o.sigma, pool.sigma), 5) as sigma, round(coalesce(o.std_long, pool.std_long), 5) as std_long, o.g is not null as own from gs left join o on gs.g = o.g cross join pool")
def pooled_parameters(t: Tables) -> DataFrame:
    d = t.hours()
    out = quality.pooled_fallback(d, quality.robust_fit(d.where("g <> 'click'"), "v", ["g"]), ["g"])
    return out.select("g", *[F.round(c, 5).alias(c) for c in ("med", "sigma", "std_long")], "own")


_EW = 1 - 0.5 ** (1 / 3)


@query("ewm_running", f"with {USERS}, l as (select g, id, us, list(v) over (partition by g order by us rows between unbounded preceding and current row) as xs from eu) select g, id, round(list_reduce(xs, lambda a, x: {_EW!r}::double * x + {1 - _EW!r}::double * a), 6) as e from l")
def ewm_running(t: Tables) -> DataFrame:
    return r6(seq.ewm(t.users(), "v", 3.0, ["g"], "e").select("g", "id", "e"), "e")


@query("ewma_max", f"with {USERS}, l as (select g, id, v, list(v) over (partition by g order by us rows between unbounded preceding and current row) as xs from eu) select g, id, round(greatest(v, list_reduce(xs, lambda a, x: {_EW!r}::double * x + {1 - _EW!r}::double * a)), 6) as score from l")
def ewma_max(t: Tables) -> DataFrame:
    return r6(seq.ewm(t.users(), "v", 3.0, ["g"], "e").select("g", "id", F.greatest("v", "e").alias("score")), "score")


_EW12 = 0.5 ** (1 / 12)


@query("ewm_adjusted", f"with {USERS}, l as (select g, id, list(v) over (partition by g order by us rows between unbounded preceding and current row) as xs from eu) select g, id, round(list_reduce(xs, lambda a, x: {_EW12!r}::double * a + x) / ((1 - pow({_EW12!r}::double, len(xs))) / (1 - {_EW12!r}::double)), 6) as e from l")
def ewm_adjusted(t: Tables) -> DataFrame:
    return r6(seq.ewm(t.users(), "v", 12.0, ["g"], "e", adjust=True).select("g", "id", "e"), "e")


@query("score_normalise", f"with {USERS}, f as (select kind, quantile_cont(v, 0.5) as m, greatest(quantile_cont(v, 0.99) - quantile_cont(v, 0.5), 1e-9) as s from eu group by 1) select id, round((v - m) / s, 6) as norm from eu join f using (kind)")
def score_normalise(t: Tables) -> DataFrame:
    d = t.users()
    fit = quality.normalise_fit(d, "v", ["kind"])
    return r6(d.join(F.broadcast(fit), "kind").select("id", ((F.col("v") - F.col("median")) / F.col("spread")).alias("norm")), "norm")


@query("weighted_ensemble", f"with {SIG} select g, us, round((0.5 * coalesce(forecast_residual, 0) + 0.3 * coalesce(abrupt_change, 0) + 0.2 * coalesce(hour_residual, 0)) / 1.0, 6) as score from sig")
def weighted_ensemble(t: Tables) -> DataFrame:
    d = detect.compute_signals(t.hours(), SPEC)
    parts = {s: (F.col(f"v__{s}"), w) for s, w in (("forecast_residual", 0.5), ("abrupt_change", 0.3), ("hour_residual", 0.2))}
    return r6(d.select("g", "us", quality.weighted_ensemble(parts).alias("score")), "score")


@query("watchdog_batch", f"with {HOURS}, a as (select *, coalesce(us - lag(us) over w = {H}, false) as adj, coalesce(greatest((us - lag(us) over w) // {H} - 1, 0), 0) as skipped, lag(k) over w as pk from ev window w as (partition by g order by us)), b as (select *, sum(case when adj and coalesce(k = pk, false) then 0 else 1 end) over (partition by g order by us) as r from a), c as (select *, (us - first_value(us) over (partition by g, r order by us)) / 1e6 as held from b) select g, us, skipped, coalesce(adj and abs(k - pk) > 40, false) as step_alert, held as flat_seconds, coalesce(held > 3000, false) as flat_alert from c")
def watchdog_batch(t: Tables) -> DataFrame:
    return network.watchdog(t.hours(), "k", HOUR, ["g"], 40.0, 3000.0).select("g", "us", "skipped", "step_alert", "flat_seconds", "flat_alert")


# --- evaluation ---------------------------------------------------------------------------------------------------------

KNOWN = "kn as (select * from lab where y is not null)"
BLK = f"{LABELS}, b0 as (select score, sum(y) as pos, count(*) as n from lab where y is not null group by 1), blk as (select score, pos, n, sum(pos) over w as tp, sum(n) over w as predicted, sum(pos) over () as positives, sum(n) over () as rows from b0 window w as (order by score desc))"


@query("pointwise_prf", f"with {LABELS}, c as (select count(*) filter (y = 1 and p = 1) as tp, count(*) filter (y = 0 and p = 1) as fp, count(*) filter (y = 1 and p = 0) as fn, count(*) filter (y = 0 and p = 0) as tn from lab where y is not null) select *, round(case when tp + fp > 0 then tp / (tp + fp)::double else 0 end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn)::double else 0 end, 6) as recall, round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn)::double else 0 end, 6) as f1 from c")
def pointwise_prf(t: Tables) -> DataFrame:
    return r6(evaluate.prf(t.labels()), "precision", "recall", "f1")


SEG = f"{LABELS}, sg as (select *, sum(case when coalesce(y = py, false) then 0 else 1 end) over (partition by g order by doc_id) as seg from (select *, lag(y) over (partition by g order by doc_id) as py from lab))"


@query("point_adjusted_prf", f"with {SEG}, ad as (select y, case when y = 1 then max(p) over (partition by g, seg) else p end as a from sg), c as (select count(*) filter (y = 1 and a = 1) as tp, count(*) filter (y = 0 and a = 1) as fp, count(*) filter (y = 1 and a = 0) as fn, count(*) filter (y = 0 and a = 0) as tn from ad where y is not null) select *, round(case when tp + fp > 0 then tp / (tp + fp)::double else 0 end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn)::double else 0 end, 6) as recall, round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn)::double else 0 end, 6) as f1 from c")
def point_adjusted_prf(t: Tables) -> DataFrame:
    return r6(evaluate.prf(evaluate.point_adjust(t.labels(), ["g"], "doc_id"), p="adjusted"), "precision", "recall", "f1")


@query("range_wise_prf", f"""with {SEG}, z as (select *, case when y is null then 0 else p end as q from sg), tr as (select max(q) as hit from z where y = 1 group by g, seg),
 z1 as (select *, sum(case when q = 1 and coalesce(lq, 0) = 1 then 0 else 1 end) over (partition by g order by doc_id) as ps from (select *, lag(q) over (partition by g order by doc_id) as lq from z)), pr as (select avg(y::double) as share from z1 where q = 1 group by g, ps),
 c as (select (select count(*) from tr) as true_segments, coalesce((select avg(hit::double) from tr), 0) as recall, (select count(*) from pr) as predicted_segments, coalesce((select avg(share) from pr), 0) as precision)
 select true_segments, round(recall, 6) as recall, predicted_segments, round(precision, 6) as precision, round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end, 6) as f1 from c""")
def range_wise_prf(t: Tables) -> DataFrame:
    return r6(evaluate.range_wise(t.labels(), ["g"], "doc_id"), "precision", "recall", "f1")


@query("detection_latency", f"with {SEG}, i as (select *, row_number() over (partition by g, seg order by doc_id) - 1 as i from sg where y = 1), f as (select min(i) filter (p = 1) as first from i group by g, seg) select count(*) as segments, count(first) as detected, round(avg(first), 6) as mean_latency from f")
def detection_latency(t: Tables) -> DataFrame:
    return r6(evaluate.detection_latency(t.labels(), ["g"], "doc_id"), "mean_latency")


@query("roc_auc_exact", f"with {BLK} select round(sum(pos * (((rows - positives) - (predicted - tp)) + (n - pos) / 2.0::double)) / nullif(max(positives) * (max(rows) - max(positives)), 0), 6) as roc_auc from blk")
def roc_auc_exact(t: Tables) -> DataFrame:
    return r6(evaluate.roc_auc(t.labels()), "roc_auc")


@query("average_precision", f"with {BLK} select round(sum(pos / nullif(positives, 0)::double * tp / predicted), 6) as average_precision from blk")
def average_precision(t: Tables) -> DataFrame:
    return r6(evaluate.average_precision(t.labels()), "average_precision")


@query("threshold_sweep_f1", f"with {BLK}, o as (select *, 2.0::double * tp / (predicted + positives) as f1, 2.0::double * tp / (predicted + positives) * case when tp / predicted::double < 0.35 then 0.5 else 1.0 end as obj from blk) select score as threshold, cast(tp as bigint) as tp, cast(predicted as bigint) as predicted, cast(positives as bigint) as positives, round(f1, 6) as f1 from o order by obj desc, score desc limit 1")
def threshold_sweep_f1(t: Tables) -> DataFrame:
    return r6(evaluate.threshold_sweep(t.labels()), "f1")


@query("background_capped_threshold", f"""with {LABELS}, kn as (select score, y from lab where y is not null), lim as (select min(score) as lo, max(score) as hi from kn), gr as (select lo + (hi - lo) * (i / 100.0::double) as threshold from lim, range(5, 100) t(i) union select unnest(quantile_cont(score, [0.95, 0.98, 0.99, 0.995, 0.999])) from kn union select 'infinity'::double),
 c as (select threshold, count(*) filter (score >= threshold and y = 1) as tp, count(*) filter (score >= threshold and y = 0) as fp, count(*) filter (y = 1) as pos, count(*) filter (y = 0) as neg from kn, gr group by 1), d as (select threshold, fp, neg, case when tp + fp + pos > 0 then 2.0::double * tp / (tp + fp + pos) else 0 end as f1, case when pos > 0 then tp / pos::double else 0 end as recall from c)
 select round(threshold, 6) as threshold, round(f1, 6) as f1, round(recall, 6) as recall from d where fp <= 0.02::double * neg order by d.f1 desc, d.recall desc, d.threshold limit 1""")
def background_capped_threshold(t: Tables) -> DataFrame:
    return r6(evaluate.background_capped_threshold(t.labels()), "threshold", "f1", "recall")


@query("quantile_grid_objective", f"with {LABELS}, {KNOWN}, gr as (select unnest([0, 1, 2]) as i, unnest(quantile_cont(score, [0.5, 0.8, 0.95])) as threshold from kn), c as (select i, threshold, count(*) filter (score >= threshold and y = 1) as tp, count(*) filter (score >= threshold) as predicted, count(*) filter (y = 1) as positives from kn, gr group by 1, 2) select cast(i as int) as i, round(threshold, 6) as threshold, tp, predicted, positives, round(2.0::double * tp / (predicted + positives) * case when case when predicted > 0 then tp / predicted::double else 0 end < 0.35 then 0.5 else 1 end, 6) as objective from c")
def quantile_grid_objective(t: Tables) -> DataFrame:
    return r6(evaluate.quantile_grid(t.labels(), [0.5, 0.8, 0.95]), "threshold", "objective")


PROB = f"{LABELS}, pb as (select y, least(score / 10000.0, 1.0)::double as q from lab)"


@query("reliability_bins", f"with {PROB} select cast(least(floor(q * 10), 9) as int) as bin, count(*) as n, round(avg(q), 6) as mean_probability, round(avg(y::double), 6) as observed from pb where y is not null group by 1")
def reliability_bins(t: Tables) -> DataFrame:
    return r6(evaluate.reliability(t.labels().withColumn("q", F.least(F.col("score") / 10000.0, F.lit(1.0))), p="q"), "mean_probability", "observed")


@query("ece_brier", f"with {PROB}, b as (select least(floor(q * 10), 9) as bin, count(*) as n, avg(q) as m, avg(y::double) as o from pb where y is not null group by 1) select round((select avg((q - y) * (q - y)) from pb where y is not null), 6) as brier, round(sum(n * abs(m - o)) / sum(n), 6) as ece from b")
def ece_brier(t: Tables) -> DataFrame:
    return r6(evaluate.brier_ece(t.labels().withColumn("q", F.least(F.col("score") / 10000.0, F.lit(1.0))), p="q"), "brier", "ece")


@query("confusion_by_class", f"with {LABELS} select quality as truth, p as predicted, count(*) as n from lab group by 1, 2")
def confusion_by_class(t: Tables) -> DataFrame:
    return evaluate.confusion(t.labels().select(F.col("quality").alias("truth"), F.col("p").alias("predicted")), "truth", "predicted")


@query("balanced_weights", f"with {LABELS}, c as (select g, y, count(*) as n from lab where y is not null group by 1, 2) select g, y, n, round(sum(n) over () / ((select count(distinct g) from c) * count(*) over (partition by g) * n)::double, 6) as weight from c")
def balanced_weights(t: Tables) -> DataFrame:
    return r6(evaluate.balanced_weights(t.labels(), "g", "y"), "weight")


@query("purged_partitions", f"""with {USERS}, l as (select kind as g, us, id, cast(v > 60 as int) as y from eu), a as (select *, row_number() over (partition by g order by us) as r, count(*) over (partition by g) as n from l), b as (select *, case when r <= floor(n * 0.6::double) then 'fit' when r <= floor(n * 0.8::double) then 'selection' else 'calibration' end as part, coalesce(y = lag(y) over (partition by g order by us), false) as same from a), c as (select *, sum(case when same then 0 else 1 end) over (partition by g order by us) as seg, min(us) filter (part = 'selection') over (partition by g) as b1, min(us) filter (part = 'calibration') over (partition by g) as b2 from b), d as (select *, (select 1) as one, min(part) over (partition by g, seg) <> max(part) over (partition by g, seg) as crosses from c)
 select g, id, part, y from d where not coalesce((part = 'fit' and us >= b1 - {DAY}) or (part = 'selection' and us >= b2 - {DAY}), false) and not (y = 1 and crosses)""")
def purged_partitions(t: Tables) -> DataFrame:
    d = t.users().select(F.col("kind").alias("g"), "us", "id", (F.col("v") > 60).cast("int").alias("y"))
    return evaluate.purged_partitions(d, ["g"], "us", "y", purge=DAY).select("g", "id", "part", "y")


@query("balanced_cap", f"with {USERS}, a as (select kind, id, row_number() over (partition by kind order by sha256(cast(id as varchar) || ':0')) as r from eu) select kind, id from (select * from a where r <= 50 order by r, kind limit 50)")
def balanced_cap(t: Tables) -> DataFrame:
    return evaluate.balanced_cap(t.users(), "kind", "id", 50).select("kind", "id")


@query("hashed_monthly_cap", f"with {USERS}, a as (select kind, id, row_number() over (partition by kind order by sha256(cast(id as varchar) || ':7')) as r from eu) select kind, id from a where r <= 20")
def hashed_monthly_cap(t: Tables) -> DataFrame:
    return evaluate.hashed_cap(t.users(), ["kind"], "id", 20, 7).select("kind", "id")


@query("forecast_metrics_grouped", f"with {SIG}, e as (select g, forecast_residual as e from sig where forecast_residual is not null), o as (select g as grp, count(*) as n, avg(e) as mae, sqrt(avg(e * e)) as rmse, null::double as macro_mae from e group by 1) select grp, n, round(mae, 6) as mae, round(rmse, 6) as rmse, macro_mae from o union all select null, count(*), round(avg(e), 6), round(sqrt(avg(e * e)), 6), round((select avg(mae) from o), 6) from e")
def forecast_metrics_grouped(t: Tables) -> DataFrame:
    d = detect.compute_signals(t.hours(), SPEC)
    return r6(evaluate.forecast_metrics(d, "g", "v", "v__prediction"), "mae", "rmse", "macro_mae")


# --- health, network, scenarios -----------------------------------------------------------------------------------------


@query("station_health", f"""with {DEC}, d as (select dec.*, sig.v from dec join sig using (g, us)), b as (select g, min(us) as a, max(us) as b from d group by 1), x as (select d.*, us < a + (b - a) / 2.0 as early from d join b using (g)),
 r as (select g, count(*) as rows, count(alert) as scored, count(*) filter (alert) as alerts, count(*) filter (alert) / nullif(count(alert), 0)::double as rate, count(*) filter (alert and early) / nullif(count(alert) filter (early), 0)::double as early, count(*) filter (alert and not early) / nullif(count(alert) filter (not early), 0)::double as late from x group by 1)
 select g, rows, scored, alerts, round(rate, 6) as rate, round(early, 6) as early, round(late, 6) as late, case when rate is null then 'unknown' when rate <= 0.02 then 'healthy' when rate <= 0.08 then 'watch' when rate <= 0.25 then 'degraded' else 'critical' end as health,
 case when early is null or late is null then 'unknown' when late > early * 1.5 + 0.005 then 'worsening' when early > late * 1.5 + 0.005 then 'improving' else 'stable' end as trend from r""")
def station_health(t: Tables) -> DataFrame:
    d = _valued(t).withColumnRenamed("value", "v")
    return r6(network.station_health(d, ["g"]).select("g", "rows", "scored", "alerts", "rate", "early", "late", "health", "trend"), "rate", "early", "late")


@query("maintenance_advisory", f"""with {DEC}, d as (select dec.*, sig.v from dec join sig using (g, us)), b as (select g, min(us) as a, max(us) as b from d group by 1), x as (select d.*, a, b, us < a + (b - a) / 2.0 as early from d join b using (g)),
 r as (select g, count(*) as rows, count(alert) as scored, count(*) filter (alert) as alerts, count(*) filter (alert) / nullif(count(alert), 0)::double as rate, count(*) filter (alert and early) / nullif(count(alert) filter (early), 0)::double as early, count(*) filter (alert and not early) / nullif(count(alert) filter (not early), 0)::double as late, count(*) filter (v is null) / count(*)::double as missing, (max(b) - max(a)) / 60e6 as span from x group by 1),
 s as (select *, case when rate is null then 'unknown' when rate <= 0.02 then 'healthy' when rate <= 0.08 then 'watch' when rate <= 0.25 then 'degraded' else 'critical' end as health, case when early is null or late is null then 'unknown' when late > early * 1.5 + 0.005 then 'worsening' when early > late * 1.5 + 0.005 then 'improving' else 'stable' end as trend, coalesce(least(early, late) > 0.02, false) as persistent from r)
 select g, health, trend, case when not (scored >= 30 and span >= 60) then case when rows > 0 and scored = 0 then 'insufficient_history:check_feed_now' when alerts > 0 then 'insufficient_history:review_candidates' else 'insufficient_history:collect_more_history' end when scored / rows::double < 0.5 or missing > 0.25 then 'insufficient_coverage:check_feed_now' when trend = 'worsening' then 'rising:review_now'
  when persistent or health in ('degraded', 'critical') then case when persistent then 'persistent' else 'elevated' end || case when health = 'critical' then ':review_now' else ':next_service' end when alerts > 0 then 'isolated:next_service' else 'low:routine_observation' end as advisory from s""")
def maintenance_advisory(t: Tables) -> DataFrame:
    d = _valued(t).withColumnRenamed("value", "v")
    return network.station_health(d, ["g"]).select("g", "health", "trend", "advisory")


@query("dominant_reason", f"with {DEC}, x as (select g, us, unnest(string_split(reason_codes, '|')) as reason, unnest(range(len(string_split(reason_codes, '|')))) as p from dec where reason_codes <> ''), c as (select g, reason, count(*) as n, min(us * 10 + p) as f from x group by 1, 2) select g, reason, n from (select *, row_number() over (partition by g order by n desc, f) as r from c) where r = 1")
def dominant_reason(t: Tables) -> DataFrame:
    return network.dominant_reason(_decisions(t), ["g"], "reason_codes")


@query("window_summary", f"with {DEC} select g, count(*) as records, count(*) filter (alert) as candidates, count(alert) as scored, 0::bigint as missing from dec group by 1")
def window_summary(t: Tables) -> DataFrame:
    d = _valued(t).withColumnRenamed("value", "v")
    return network.window_summary(d, ["g"])


GEO = "geo as (select n_nationkey as station, n_nationkey % 5 * 1.5::double as lat, floor(n_nationkey / 5) * 1.25::double as lon from nation)"
PEERS = GEO + ", pd as (select a.station, b.station as peer, 2 * 6371.0 * asin(sqrt(least(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2), 1))) as km from geo a join geo b on a.station <> b.station), pr as (select *, row_number() over (partition by station order by round(km, 6), peer) as rank from pd where km <= 500)"
NET = "net as (select s_nationkey as station, s_suppkey % 7 as us, quantile_cont(s_acctbal, 0.5) as v from supplier group by 1, 2)"


def _peers(t: Tables) -> DataFrame:
    return network.nearest_peers(t.geo())


@query("knn_peers_haversine", f"with {PEERS} select station, peer, rank, round(km, 4) as km from pr where rank <= 4")
def knn_peers_haversine(t: Tables) -> DataFrame:
    return _peers(t).select("station", "peer", F.col("rank").cast("long").alias("rank"), F.round("km", 4).alias("km"))


REGION_PEERS = "rp as (select a.n_nationkey as station, b.n_nationkey as peer from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey <> b.n_nationkey)"
BUD = f"{NET}, {REGION_PEERS}, bd as (select l.station, l.us, l.v, quantile_cont(r.v, 0.5) as consensus, count(*) as n_peers from net l join rp using (station) join net r on r.station = rp.peer and r.us = l.us group by 1, 2, 3 having count(*) >= 2)"


def _buddies(t: Tables) -> DataFrame:
    n = t.raw("nation")
    pairs = n.select(F.col("n_nationkey").alias("station"), "n_regionkey").join(n.select(F.col("n_nationkey").alias("peer"), "n_regionkey"), "n_regionkey").where("station <> peer")
    return network.buddy_scores(t.network(), pairs, "v")


@query("buddy_check", f"with {BUD} select station, us, round(consensus, 6) as consensus, n_peers, round(abs(v - consensus), 6) as deviation from bd")
def buddy_check(t: Tables) -> DataFrame:
    return r6(_buddies(t).select("station", "us", "consensus", "n_peers", "deviation"), "consensus", "deviation")


@query("buddy_spread_scores", f"with {BUD}, dv as (select station, us, abs(v - consensus) as x from bd), md as (select station, quantile_cont(x, 0.5) as m, count(*) as n from dv group by 1 having count(*) >= 4), sp as (select dv.station, greatest(1.4826 * quantile_cont(abs(x - m), 0.5), quantile_cont(x, 0.95) / 3, 0.001) as spread from dv join md using (station) group by 1), po as (select quantile_cont(spread, 0.5) as pooled from sp) select dv.station, us, round(coalesce(x / coalesce(spread, pooled), 0), 5) as score from dv left join sp using (station), po")
def buddy_spread_scores(t: Tables) -> DataFrame:
    return network.scaled_buddy_scores([_buddies(t)], least=4).select("station", "us", F.round("score", 5).alias("score"))


@query("network_residual", f"with {BUD} select station, us, round(v - consensus, 6) as residual, case when abs(v - consensus) > 4000 then 'inconsistent' else 'consistent' end as status from bd")
def network_residual(t: Tables) -> DataFrame:
    d = _buddies(t)
    return r6(d.select("station", "us", (F.col("v") - F.col("consensus")).alias("residual"), F.when(F.col("deviation") > 4000, "inconsistent").otherwise("consistent").alias("status")), "residual")


@query("latest_peer_snapshot", f"with {USERS} select kind, arg_max(v, us) as latest, max(us) as latest_us from eu group by 1")
def latest_peer_snapshot(t: Tables) -> DataFrame:
    return network.latest_snapshot(t.users(), ["kind"], "v")


@query("correction_proposals", f"with {USERS}, a as (select kind, v, row_number() over (partition by kind order by us desc, id desc) as r from eu), l as (select kind as target, v as value from a where r = 1), p as (select kind, v from a where r <= 30), x as (select target, value, quantile_cont(v, 0.5) as proposal, stddev_pop(v) as deviation from l join p on target <> kind group by 1, 2) select target, value, round(proposal, 6) as proposal, round(deviation, 6) as deviation, abs(value - proposal) < 0.3 * deviation + 2 as stable from x")
def correction_proposals(t: Tables) -> DataFrame:
    return r6(network.correction_proposals(t.users(), "kind", "v", tie="id"), "proposal", "deviation")


@query("correction_fusion", f"""with {HOURS}, c as (select g, hour(make_timestamp(us)) as h, quantile_cont(v, 0.5) as normal from ev group by 1, 2), r as (select ev.g, ev.us, v, normal, case when k % 10 <> 0 then v - normal end as resid, first_value(v) over (partition by ev.g order by ev.us range between {24 * HOUR} preceding and {24 * HOUR} preceding) as far from ev join c on ev.g = c.g and hour(make_timestamp(us)) = c.h),
 f as (select *, coalesce(last_value(resid ignore nulls) over (partition by g order by us rows between unbounded preceding and current row), 0) as keep, row_number() over (partition by g order by us) - 1 as i from r),
 w as (select *, normal + keep * exp(-i / 12.0) as e1, 1 / (4.0 + keep * keep * 0.05) as w1, case when far is null then 0 else 1 / 25.0 end as w2 from f)
 select g, us, round((e1 * w1 + coalesce(far, 0) * w2) / (w1 + w2), 5) as corrected, round(least(greatest(1.5 / (1 + sqrt(1 / (w1 + w2))), 0), 1), 5) as confidence from w""")
def correction_fusion(t: Tables) -> DataFrame:
    d = t.hours()
    hour = F.hour(F.timestamp_micros("us"))
    normal = d.groupBy("g", hour.alias("_h")).agg(F.percentile("v", 0.5).alias("normal"))
    d = d.withColumn("far", seq.exact_lag("v", 24 * HOUR, ["g"])).withColumn("_h", hour).join(normal, ["g", "_h"])
    d = d.withColumn("resid", F.when(F.col("k") % 10 != 0, F.col("v") - F.col("normal")))
    out = network.corrected_series(d, ["g"], "normal", "resid", 2.0, [(F.col("far"), 5.0)])
    return out.select("g", "us", F.round("corrected", 5).alias("corrected"), F.round("confidence", 5).alias("confidence"))


for _kind, _sql in (
    ("spike", "case when us = f then v + 25 else v end"), ("drift", f"case when inside then v + 25 * (us - a) / {float(72 * HOUR)} else v end"),
    ("stuck", "case when inside then latch else v end"), ("dropout", "case when not inside then v end"),
):
    query(f"scenario_{_kind}", f"with {HOURS}, w as (select min(us) + {5 * DAY} as a from ev), x as (select ev.*, a, us >= a and us < a + {72 * HOUR} as inside from ev, w), y as (select *, min(us) filter (inside) over (partition by g) as f, arg_min(v, case when inside then us end) filter (inside) over (partition by g) as latch from x), z as (select g, us, v, {_sql} as s from y) select g, us, round(s, 6) as scenario, s is distinct from v as changed from z")(
        lambda t, k=_kind: r6(network.scenario(t.hours(), k, "v", t.hours().agg(F.min("us")).first()[0] + 5 * DAY, 72 * HOUR, 25.0, ["g"]).select("g", "us", "scenario", "changed"), "scenario")
    )


@query("source_windows_12h", f"with {USERS} select kind, us // {12 * HOUR} * {12 * HOUR} as window_us, count(*) as n from eu group by 1, 2 having count(*) >= 3")
def source_windows_12h(t: Tables) -> DataFrame:
    return network.source_windows(t.users(), ["kind"], 12 * HOUR, 3)


FAULTS = f"ft as (select g, lo + i * 6 * {DAY} as start_us, lo + i * 6 * {DAY} + {DAY} as end_us, 'fault' || cast(i as varchar) as fault, cast(i as bigint) as event_order from (select g, min(us) as lo from ev group by 1), unnest([0, 1, 2]) as t(i))"


def _faults(t: Tables) -> DataFrame:
    lo = t.hours().groupBy("g").agg(F.min("us").alias("lo")).select("g", "lo", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("i"))
    return lo.select("g", (F.col("lo") + F.col("i") * 6 * DAY).alias("start_us"), (F.col("lo") + F.col("i") * 6 * DAY + DAY).alias("end_us"), F.concat(F.lit("fault"), F.col("i").cast("string")).alias("fault"), F.col("i").cast("long").alias("event_order"))


@query("interval_label_paint", f"with {HOURS}, {FAULTS} select ev.g, ev.us, cast(max(case when ft.g is null then 0 else 1 end) as int) as label, arg_max(ft.fault, ft.event_order) as fault from ev left join ft on ev.g = ft.g and ev.us between ft.start_us and ft.end_us group by 1, 2")
def interval_label_paint(t: Tables) -> DataFrame:
    return network.paint_labels(t.hours().select("g", "us"), _faults(t), ["g"])


@query("interval_hits", f"with {HOURS}, {FAULTS} select ft.g, ft.fault, count(ev.us) as rows, count(*) filter (ev.v > 60) as hits from ft left join ev on ev.g = ft.g and ev.us between ft.start_us and ft.end_us group by 1, 2")
def interval_hits(t: Tables) -> DataFrame:
    return network.interval_hits(t.hours().withColumn("p", (F.col("v") > 60).cast("int")), _faults(t), ["g"], "p").select("g", "fault", "rows", "hits")


@query("busiest_day", f"with {USERS} select kind, day, n from (select kind, us // {DAY} as day, count(v) as n, row_number() over (partition by kind order by count(v) desc, us // {DAY}) as r from eu group by 1, 2) where r = 1")
def busiest_day(t: Tables) -> DataFrame:
    d = t.users().groupBy("kind", F.floor(F.col("us") / DAY).alias("day")).agg(F.count("v").alias("n"))
    return d.groupBy("kind").agg(F.max(F.struct("n", (-F.col("day")).alias("d"))).alias("b")).select("kind", (-F.col("b.d")).alias("day"), F.col("b.n").alias("n"))


@query("catalog_minmax", f"with {USERS} select kind, count(*) as n, min(us) as first_us, max(us) as last_us from eu group by 1")
def catalog_minmax(t: Tables) -> DataFrame:
    return t.users().groupBy("kind").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query("holdout_stations", "select c_custkey from (select c_custkey, row_number() over (order by sha256('42:' || cast(c_custkey as varchar))) as r, count(*) over () as n from customer) where r <= ceil(n * 0.2::double)")
def holdout_stations(t: Tables) -> DataFrame:
    h = F.sha2(F.concat(F.lit("42:"), F.col("c_custkey").cast("string")), 256)
    ids = t.raw("customer").select("c_custkey", h.alias("h"))
    n = ids.count()
    return ids.orderBy("h").limit(-(-n * 2 // 10)).select("c_custkey")


@query("window_zscore", f"with {USERS} select id, round((v - avg(v) over (partition by kind)) / nullif(stddev_pop(v) over (partition by kind), 0), 5) as z from eu")
def window_zscore(t: Tables) -> DataFrame:
    d = t.users()
    s = d.groupBy("kind").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))  # partial sums, not a window over a hot group
    return d.join(F.broadcast(s), "kind").select("id", F.round((F.col("v") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0)), 5).alias("z"))


@query("role_runs", "with a as (select conv_id, turn, role, coalesce(role = lag(role) over (partition by conv_id order by turn), false) as same from conversations), b as (select *, sum(case when same then 0 else 1 end) over (partition by conv_id order by turn) as run from a) select conv_id, cast(run as bigint) as run, min(turn) as first_turn, count(*) as turns from b group by 1, 2")
def role_runs(t: Tables) -> DataFrame:
    c = t.raw("conversations")
    same = F.coalesce(F.col("role") == F.lag("role").over(seq.ordered(["conv_id"], "turn")), F.lit(False))
    return seq.island(c, ~same, ["conv_id"], "run", "turn").groupBy("conv_id", F.col("run").cast("long").alias("run")).agg(F.min("turn").alias("first_turn"), F.count("*").alias("turns"))


# --- fitted models and injected faults: tested by their properties, not by SQL --------------------------------------------


@query("pot_threshold")
def pot_threshold(t: Tables) -> DataFrame:
    from isobar.operators import models

    return r6(models.pot_by_group(t.users(), "kind", "v"), "threshold")


@query("isolation_forest")
def isolation_forest(t: Tables) -> DataFrame:
    from isobar.operators import models

    return r6(models.isolation_scores(t.users(), ["v", "k"], "id", trees=300, sample=65_536, sample_rows=200_000), "score")


@query("gbt_forecast")
def gbt_forecast(t: Tables) -> DataFrame:
    from isobar.operators import models

    d = detect.exact_lag_features(t.hours(), SPEC, 1)
    features = ["v__h1_lag0", "v__h1_lag1", "v__h1_lag3", "v__h1_diff1"]
    cut = d.agg(F.percentile("us", 0.7)).first()[0]
    out, chosen = models.boosted_forecast(d.where(F.col("us") < cut), d.where(F.col("us") >= cut), features, "v", "v__h1_lag0", iterations=100)
    return r6(out.select("g", "us", "v", "forecast", F.lit(chosen).alias("model")), "v", "forecast")


@query("rf_typer")
def rf_typer(t: Tables) -> DataFrame:
    from isobar.operators import models

    d = models.inject_faults(t.hours(), ["g"], "v", rate=0.4, length=6).withColumn("raw", F.col("v")).withColumn("v", F.col("injected"))
    s = detect.compute_signals(d, SPEC).withColumn("label", F.coalesce(F.when(F.col("modified"), F.col("fault")), F.lit("none")))
    names = [f"v__{x}" for x in detect.SIGNALS]
    cut = s.agg(F.percentile("us", 0.7)).first()[0]
    return r6(models.type_faults(s.where(F.col("us") < cut), s.where(F.col("us") >= cut), names, "label").select("g", "us", "label", "predicted", "confidence"), "confidence")


@query("group_bootstrap_ci")
def group_bootstrap_ci(t: Tables) -> DataFrame:
    from isobar.operators import models

    return r6(models.group_bootstrap(t.labels(), "g", "y", "p"), "mean_f1", "low", "high")


@query("fault_injection")
def fault_injection(t: Tables) -> DataFrame:
    from isobar.operators import models

    return r6(models.inject_faults(t.users(), ["kind"], "v", rate=0.1).select("kind", "id", "fault", "injected", "modified"), "injected")


# --- explanations and reports -------------------------------------------------------------------------------------------


@query("channel_attribution", f"with {SIG}, l as (select g, 'near' as ch, forecast_residual as z from sig union all select g, 'far', hour_residual from sig), m as (select g, ch, quantile_cont(abs(z), 0.5) as mz from l group by 1, 2) select g, ch, round(mz, 6) as median_z, round(case when sum(mz) over (partition by g) > 0 then mz / sum(mz) over (partition by g) else 0 end, 6) as share from m")
def channel_attribution(t: Tables) -> DataFrame:
    from isobar.operators import report

    d = detect.long_signals(detect.compute_signals(t.hours(), SPEC), SPEC, ("forecast_residual", "hour_residual"))
    d = d.select("g", F.when(F.col("signal") == "forecast_residual", "near").otherwise("far").alias("ch"), F.col("value").alias("z"))
    return r6(report.channel_attribution(d, ["g"], "ch", "z"), "median_z", "share")


@query("component_support", f"with {SIG}, m as (select g, avg(forecast_residual) as a, avg(abrupt_change) as b from sig group by 1) select g, 'v__forecast_residual' as component, round(coalesce(a, 0) * 0.6::double, 6) as support from m union all select g, 'v__abrupt_change', round(coalesce(b, 0) * 0.4::double, 6) from m")
def component_support(t: Tables) -> DataFrame:
    from isobar.operators import report

    return r6(report.component_support(detect.compute_signals(t.hours(), SPEC), ["g"], {"v__forecast_residual": 0.6, "v__abrupt_change": 0.4}), "support")


@query("leave_one_out_ablation", f"""with {LABELS}, x as (select y, score / 10000.0::double as a, coalesce(quality, 0)::double as b from lab where y is not null),
 c as (select 'none' as left_out, (0.7::double * a + 0.3::double * b) / 1.0 >= 0.3::double as hit, y from x union all select 'a', b >= 0.3, y from x union all select 'b', a >= 0.3, y from x)
 select left_out, round(2.0::double * count(*) filter (hit and y = 1) / nullif(count(*) filter (hit) + count(*) filter (y = 1), 0), 6) as f1 from c group by 1""")
def leave_one_out_ablation(t: Tables) -> DataFrame:
    from isobar.operators import report

    d = t.labels().withColumn("a", F.col("score") / 10000.0).withColumn("b", F.coalesce(F.col("quality").cast("double"), F.lit(0.0)))
    return r6(report.ablation(d, {"a": 0.7, "b": 0.3}, "y", 0.3), "f1")


@query("scenario_partition", "select l_orderkey as o, l_linenumber as n, l_partkey as pk, l_shipdate as ts, case when l_returnflag in ('R') then case when month(l_shipdate) = 2 then 'test_station' end else case when month(l_shipdate) = 2 then 'test_temporal' when month(l_shipdate) <= 8 then 'fit' when month(l_shipdate) <= 10 then 'selection' else 'calibration' end end as part from lineitem")
def scenario_partition(t: Tables) -> DataFrame:
    from isobar.operators import report

    d = t.raw("lineitem")
    return d.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("pk"), F.col("l_shipdate").alias("ts"), report.scenario_partition(F.col("l_returnflag"), F.col("l_shipdate"), ["R"]).alias("part"))


_EW72 = 1 - 0.5 ** (1 / 72.0)


@query("health_trend", f"""with {SIG}, l as (select g, us, list(coalesce(forecast_residual, 0)) over (partition by g order by us rows between unbounded preceding and current row) as xs from sig), e as (select g, us, 100 * exp(-greatest(list_reduce(xs, lambda a, x: {_EW72!r}::double * x + {1 - _EW72!r}::double * a) / 20.0 - 1, 0)) as h from l),
 d as (select g, us // {DAY} as day, avg(h) as h from e group by 1, 2), r as (select *, max(day) over (partition by g) as last from d), k as (select g, arg_max(h, day) as health, regr_slope(h, day) as slope, count(*) as days from r where day > last - 7 group by 1)
 select g, round(health, 6) as health, round(slope, 6) + 0.0::double as slope, days, round(case when slope < -1e-6 and days >= 2 then greatest((health - 50.0) / -slope, 0) end, 4) as days_left from k""")
def health_trend(t: Tables) -> DataFrame:
    from isobar.operators import report

    d = detect.compute_signals(t.hours(), SPEC).select("g", "us", F.col("v__forecast_residual").alias("score"))
    out = r6(report.health_trend(d, "g", "score", 20.0), "health", "slope", "days_left")
    return out.withColumn("days_left", F.round("days_left", 4))


@query("paired_block_bootstrap")
def paired_block_bootstrap(t: Tables) -> DataFrame:
    from isobar.operators import report

    return r6(report.block_bootstrap(detect.compute_signals(t.hours(), SPEC), "v__forecast_residual", "v__hour_residual"), "mean", "low", "high")


@query("series_features", f"with {HOURS} select g, us, round(v - lag(v) over w, 6) as d1, round(case when count(v) over f >= 4 then stddev_samp(v) over f end, 6) as std48, round(case when count(v) over f >= 4 then quantile_cont(v, 0.5) over f end, 6) as median48, round(case when count(v) over f >= 4 then avg(v) over f end, 6) as mean48 from ev window w as (partition by g order by us), f as (partition by g order by us rows between 47 preceding and current row)")
def series_features(t: Tables) -> DataFrame:
    w = seq.ordered(["g"])
    f = w.rowsBetween(-47, 0)
    return r6(t.hours().select("g", "us", (F.col("v") - F.lag("v").over(w)).alias("d1"), seq.guarded(F.stddev_samp("v"), "v", f, 4).alias("std48"), seq.guarded(F.percentile("v", 0.5), "v", f, 4).alias("median48"), seq.guarded(F.avg("v"), "v", f, 4).alias("mean48")), "d1", "std48", "median48", "mean48")


@query("simple_baselines", f"with {SIG} select g, us, round(greatest(coalesce(abrupt_change, 0), coalesce(forecast_residual, 0), case when v is null then 50 else 0 end), 6) as score from sig")
def simple_baselines(t: Tables) -> DataFrame:
    d = detect.compute_signals(t.hours(), SPEC)
    zero = F.lit(0.0)
    return r6(d.select("g", "us", F.greatest(F.coalesce("v__abrupt_change", zero), F.coalesce("v__forecast_residual", zero), F.when(F.col("v").isNull(), 50.0).otherwise(0.0)).alias("score")), "score")


@query("edge_policy", f"with {THR} select signal, case when signal = 'flatline' then round(threshold * 3600, 6) else round(threshold, 6) end as edge_limit, case when signal = 'flatline' then 'seconds' else 'step' end as unit from thr where signal in ('flatline', 'abrupt_change')")
def edge_policy(t: Tables) -> DataFrame:
    long = detect.long_signals(detect.compute_signals(t.hours(), SPEC), SPEC)
    thr = detect.higher_quantile(long, ["channel", "signal"], "value", 0.98).where(F.col("signal").isin("flatline", "abrupt_change"))
    flat = F.col("signal") == "flatline"
    return r6(thr.select("signal", F.when(flat, F.col("threshold") * 3600).otherwise(F.col("threshold")).alias("edge_limit"), F.when(flat, "seconds").otherwise("step").alias("unit")), "edge_limit")
