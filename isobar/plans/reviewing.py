"""Registered queries: checked decisions and reviews, reviewed evaluation, provenance, quality roll-ups, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.functions import physics, seq, values
from isobar.operators import detect, quality, reviews
from isobar.plans.catalogue import DAY, DEC, HOUR, HOURS, LONG, ORACLES, PHYS, SIG, SPEC, THR, USERS, Tables, _decisions, _phys, _valued, query, r6
from isobar.sources import archive

H = str(HOUR)
RUNS = f"adj as (select *, coalesce(us - lag(us) over (partition by g order by us) = {H}, false) as near from ev), runs as (select *, sum(case when near then 0 else 1 end) over (partition by g order by us) as run from adj)"
#: Two confirmed intervals and one of reviewed background for each group, counted from its first hour.
PLANNED = (("event", 2, 9), ("event", 11, 12), ("background", 14, 24))
REVIEWED = "rv as (select g || '-' || cast(i as varchar) as review_id, g, 'v' as channel, kind, lo + a * {d} as start_us, lo + b * {d} as end_us, lo + a * {d} - {h} as onset_earliest_us, lo + a * {d} as onset_latest_us from (select g, min(us) as lo from ev group by 1), (values (0, 'event', 2, 9), (1, 'event', 11, 12), (2, 'background', 14, 24)) as t(i, kind, a, b))".format(d=DAY, h=H)


def _reviewed(t: Tables) -> DataFrame:
    lo = t.hours().groupBy("g").agg(F.min("us").alias("lo"))
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("kind"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (k, a, b) in enumerate(PLANNED)])).alias("x")
    d = lo.select("g", "lo", rows).select("g", "lo", "x.*")
    start = F.col("lo") + F.col("a") * F.lit(DAY)
    return d.select(F.concat("g", F.lit("-"), F.col("i").cast("string")).alias("review_id"), "g", F.lit("v").alias("channel"), "kind", start.alias("start_us"), (F.col("lo") + F.col("b") * F.lit(DAY)).alias("end_us"), (start - HOUR).alias("onset_earliest_us"), start.alias("onset_latest_us"))


BACK = f"""{DEC}, {REVIEWED}, h as (select r.review_id, d.us, d.alert from rv r join dec d on d.g = r.g and d.channel = r.channel and d.us >= r.start_us and d.us < r.end_us where kind = 'background'),
 p as (select *, case when alert is not null then coalesce(us - lag(us) over (partition by review_id, alert is not null order by us) = {H}, false) end as pair, case when alert then coalesce(us - lag(us) over (partition by review_id, coalesce(alert, false) order by us) = {H}, false) end as follows from h),
 s as (select review_id, count(*) as observed_rows, count(alert) as scored_rows, count(*) filter (alert) as false_alert_rows, count(*) filter (alert and not follows) as false_alert_episodes, count(*) filter (pair) * 3600.0 as contiguous_scored_seconds from p group by 1),
 bg as (select r.review_id, (end_us - start_us) / 1e6 as reviewed_interval_seconds, coalesce(observed_rows, 0) as observed_rows, coalesce(scored_rows, 0) as scored_rows, coalesce(false_alert_rows, 0) as false_alert_rows, coalesce(false_alert_episodes, 0) as false_alert_episodes, coalesce(contiguous_scored_seconds, 0)::double as contiguous_scored_seconds from rv r left join s using (review_id) where kind = 'background')"""


@query("background_exposure", f"with {BACK} select * from bg")
def background_exposure(t: Tables) -> DataFrame:
    return reviews.background_results(_decisions(t), _reviewed(t).where("kind = 'background'"), ["g", "channel"], HOUR).drop("g", "channel")


@query("reviewed_event_summary", f"""with {BACK}, e as (select r.review_id, max(onset_earliest_us) as oe, max(onset_latest_us) as ol, count(d.alert) as scored, count(*) filter (d.alert) as hits, min(d.us) filter (d.alert) as first from rv r left join dec d on d.g = r.g and d.channel = r.channel and d.us >= r.start_us and d.us < r.end_us where r.kind = 'event' group by 1),
 f as (select count(*) as confirmed_events, count(*) filter (hits > 0) as detected_events, count(*) filter (scored = 0) as events_without_scored_rows, round(avg((first - ol) / 1e6), 6) as mean_delay_min_s, round(avg((first - oe) / 1e6), 6) as mean_delay_max_s from e),
 b as (select count(*) as background_intervals, sum(scored_rows)::bigint as background_scored_rows, sum(false_alert_rows)::bigint as false_alert_rows, sum(false_alert_episodes)::bigint as false_alert_episodes, sum(contiguous_scored_seconds) as exposure_s from bg)
 select f.*, b.*, round(detected_events / nullif(confirmed_events, 0)::double, 6) as event_recall, round(false_alert_rows / nullif(background_scored_rows, 0)::double, 6) as false_alert_fraction, round(false_alert_episodes * 86400.0::double / nullif(exposure_s, 0), 6) as episodes_per_24h from f, b""")
def reviewed_event_summary(t: Tables) -> DataFrame:
    dec, rows = _decisions(t), _reviewed(t)
    events = detect.evaluate_reviews(dec, rows.where("kind = 'event'"), ["g", "channel"])
    back = reviews.background_results(dec, rows.where("kind = 'background'"), ["g", "channel"], HOUR)
    return r6(reviews.reviewed_summary(events, back), "mean_delay_min_s", "mean_delay_max_s", "event_recall", "false_alert_fraction", "episodes_per_24h", "exposure_s")


@query("unknown_review_rows", f"with {DEC}, {REVIEWED}, i as (select count(*) as n, count(*) filter (alert) as a from dec where exists (select 1 from rv where rv.g = dec.g and dec.us >= start_us and dec.us < end_us)) select count(*) as rows, any_value(i.n) as reviewed_rows, count(*) - any_value(i.n) as unknown_rows, count(*) filter (alert) - any_value(i.a) as unknown_alerts from dec, i")
def unknown_review_rows(t: Tables) -> DataFrame:
    return reviews.unknown_rows(_decisions(t), _reviewed(t), ["g", "channel"])


@query("single_signal_baselines", f"with {THR}, {REVIEWED}, f as (select l.g, l.us, l.signal, l.value > t.threshold as alert from lng l join thr t on l.channel = t.channel and l.signal = t.signal), e as (select signal, count(alert) as scored, count(*) filter (alert) as alerts from f group by 1), i as (select signal, count(distinct review_id) as found, count(*) as inside from f join rv on rv.g = f.g and us >= start_us and us < end_us and kind = 'event' where alert group by 1) select signal, scored, alerts, coalesce(found, 0) as found, coalesce(inside, 0) as alerts_inside from e left join i using (signal)")
def single_signal_baselines(t: Tables) -> DataFrame:
    long = detect.long_signals(detect.compute_signals(t.hours(), SPEC), SPEC)
    thr = detect.higher_quantile(long, ["channel", "signal"], "value", 0.98)
    return reviews.single_signal_baselines(long, thr, _reviewed(t).where("kind = 'event'"), ["g", "channel"])


@query("decision_checks", f"""with {USERS}, d as (select kind as g, us, cast(id % 990 as varchar) as id, v > 60 as alert, case when k % 50 = 0 then '' else 'v' end as channel from eu),
 c as (select *, count(*) over (partition by g, channel, us) as n, count(*) over (partition by id, channel) as m from d)
 select coalesce(reason, 'accepted') as reason, count(*) as rows from (select case when channel = '' then 'missing_channel' when n > 1 then 'repeated_time' when m > 1 then 'repeated_id' end as reason from c) group by 1""")
def decision_checks(t: Tables) -> DataFrame:
    d = t.users().select(F.col("kind").alias("g"), "us", (F.col("id") % 990).cast("string").alias("id"), (F.col("v") > 60).alias("alert"), F.when(F.col("k") % 50 == 0, "").otherwise("v").alias("channel"))
    checked = reviews.check_decisions(d, ["g", "channel"])
    return checked.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("rows"))


_HASH = "a" * 64


@query("review_checks", f"""with src as (select item_id as i, text from benchmark), r as (select 'r' || cast(i as varchar) as review_id, 'g' || cast(i % 7 as varchar) as g, case when i % 11 = 0 then '' else 'v' end as channel, i * 1000 as start_us, i * 1000 + (i % 5) * 2500 as end_us,
  case i % 4 when 0 then 'unknown' when 1 then 'confirmed_event' when 2 then 'reviewed_background' else 'guess' end as review_status, case when i % 13 <> 1 then 'someone' end as reviewer, case when i % 17 = 2 then 'model' else 'service_log' end as basis,
  i % 19 = 5 as bad_ref, i % 23 = 1 as no_event, i % 9 = 2 as late from src),
 a as (select *, review_status <> 'unknown' as acc, review_status = 'confirmed_event' as ev, coalesce(max(end_us) over (partition by g, channel, review_status <> 'unknown' order by start_us, end_us rows between unbounded preceding and 1 preceding) > start_us, false) as ov from r)
 select review_id, coalesce(case when review_status = 'guess' then 'unknown_status' when channel = '' then 'missing_channel' when end_us <= start_us then 'empty_interval' when acc and reviewer is null then 'no_reviewer' when acc and basis = 'model' then 'no_independent_evidence' when acc and bad_ref then 'bad_reference' when ev and no_event then 'no_event_id' when ev and late then 'bad_onset' when acc and ov then 'overlapping_interval' end, 'accepted') as reason from a""")
def review_checks(t: Tables) -> DataFrame:
    i = F.col("item_id")
    ref = lambda h: f'[{{"url": "https://example.org/x", "sha256": "{h}"}}]'
    start = i * 1000
    d = t.raw("benchmark").select(
        F.concat(F.lit("r"), i.cast("string")).alias("review_id"), F.concat(F.lit("g"), (i % 7).cast("string")).alias("g"), F.when(i % 11 == 0, "").otherwise("v").alias("channel"), start.alias("start_us"), (start + (i % 5) * 2500).alias("end_us"),
        F.element_at(F.array(*map(F.lit, ("unknown", "confirmed_event", "reviewed_background", "guess"))), (i % 4 + 1).cast("int")).alias("review_status"), F.when(i % 13 != 1, "someone").alias("reviewer"), F.lit(1).alias("reviewed_at_us"),
        F.when(i % 17 == 2, "model").otherwise("service_log").alias("evidence_basis"), F.when(i % 19 == 5, ref("short")).otherwise(ref(_HASH)).alias("evidence_refs"), F.when(i % 23 != 1, F.concat(F.lit("e"), i.cast("string"))).alias("event_id"),
        (start - 10).alias("onset_earliest_us"), F.when(i % 9 == 2, start + 5).otherwise(start - 5).alias("onset_latest_us"),
    )
    out = reviews.check_reviews(d, ["g", "channel"], ("service_log", "field_note"))
    return out.select("review_id", F.coalesce("reject_reason", F.lit("accepted")).alias("reason"))


@query("rolling_quality", f"with {HOURS}, {RUNS} select g, us, sum((n >= 2)::int) over (partition by g, run order by us rows between 5 preceding and current row) = 6 as accepted_6 from runs")
def rolling_quality(t: Tables) -> DataFrame:
    return reviews.rolling_accepted(t.hours().withColumn("ok", F.col("n") >= 2), "ok", 6, HOUR, ["g"], "accepted_6").select("g", "us", "accepted_6")


@query("blanked_rows", f"with {PHYS}, f as (select *, t < -35 or t > 40 or rh < 0 or rh > 95 as bad from ph) select o, n, pk, price, case when not bad then t end as t, case when not bad then rh end as rh from f")
def blanked_rows(t: Tables) -> DataFrame:
    d = _phys(t).withColumn("a", physics.outside(F.col("t"), (-35.0, 40.0))).withColumn("b", physics.outside(F.col("rh"), (0.0, 95.0)))
    return reviews.blank_rows(d, ["a", "b"], ["t", "rh"]).select("o", "n", "pk", "price", "t", "rh")


@query("quality_rollup", f"""with {HOURS}, a as (select g, us, v, k, coalesce(v < 20 or v > 80, false) as range_v, coalesce(abs(v - lag(v) over w) > 40, false) as step_v, coalesce(k = lag(k) over w, false) as eq from ev window w as (partition by g order by us)), b as (select *, sum(case when eq then 0 else 1 end) over (partition by g order by us) as r from a),
 c as (select *, k is not null and row_number() over (partition by g, r order by us) >= 3 as flatline_k from b) select g, us, range_v or step_v or flatline_k as qc_flag, range_v or flatline_k as hard_flag, round((2.0::double * range_v::int + step_v::int + 2 * flatline_k::int) / 5.0, 6) as qc_score from c""")
def quality_rollup(t: Tables) -> DataFrame:
    d = quality.stuck_flag(quality.step_flag(t.hours(), "v", ["g"], 40.0), "k", ["g"], 3)
    flag, hard, score = quality.qc_score({"range_v": physics.outside(F.col("v"), (20.0, 80.0)), "step_v": F.col("v__step"), "flatline_k": F.col("k__stuck")}, {"range_v", "flatline_k"})
    return r6(d.select("g", "us", flag.alias("qc_flag"), hard.alias("hard_flag"), score.alias("qc_score")), "qc_score")


@query("provider_qc_agreement", f"with {DEC}, j as (select d.g, d.alert, e.n >= 3 as ok, e.n <= 1 as bad from dec d join ev e using (g, us)) select g, count(*) as known, count(*) filter (alert and bad) as rejected_alert, count(*) filter (not alert and bad) as rejected_quiet, count(*) filter (alert and not bad) as accepted_alert, count(*) filter (not alert and not bad) as accepted_quiet from j where (ok or bad) and alert is not null group by 1")
def provider_qc_agreement(t: Tables) -> DataFrame:
    marks = t.hours().select("g", "us", (F.col("n") >= 3).alias("ok"), (F.col("n") <= 1).alias("bad"))
    return reviews.provider_agreement(_decisions(t).join(marks, ["g", "us"]), "ok", "bad", by=["g"])


@query("forecast_lineage", f"with {HOURS}, i as (select g, us, v, g || ':' || cast(us as varchar) as id, first_value(g || ':' || cast(us as varchar)) over (partition by g order by us range between {H} preceding and {H} preceding) as context_id from ev) select a.id, a.context_id, round(b.v, 6) as persistence from i a left join i b on a.context_id = b.id")
def forecast_lineage(t: Tables) -> DataFrame:
    d = t.hours().withColumn("id", F.concat_ws(":", "g", F.col("us").cast("string")))
    linked = reviews.lineage(d, "id", HOUR, ["g"], "context_id").select("id", "context_id")
    return r6(reviews.from_lineage(linked, d.select(F.col("id").alias("row_id"), "v"), "context_id", "row_id", "v", "persistence"), "persistence")


@query("lag_acceptance", f"with {HOURS}, a as (select g, us, n >= 2 as ok from ev) select g, us, {' and '.join(f'coalesce(first_value(ok) over (partition by g order by us range between {(1 + k) * HOUR} preceding and {(1 + k) * HOUR} preceding), false)' for k in (0, 1, 3, 24))} as accepted_h1 from a")
def lag_acceptance(t: Tables) -> DataFrame:
    d = t.hours().withColumn("ok", F.col("n") >= 2)
    every = F.lit(True)
    for k in SPEC.lags:
        every = every & F.coalesce(seq.exact_lag("ok", (1 + k) * HOUR, ["g"]), F.lit(False))
    return d.select("g", "us", every.alias("accepted_h1"))


@query("source_columns", "select o_orderkey, o_custkey, o_totalprice from orders")
def source_columns(t: Tables) -> DataFrame:
    d = t.raw("orders").select("o_orderkey", "o_custkey", "o_totalprice").withColumn("o_totalprice__resid", F.lit(0.0)).withColumn("scenario_id", F.lit("x")).withColumn("anomaly_score", F.lit(0.0))
    return reviews.original_columns(d)


@query("rolling_candidate_health", f"with {DEC} select g, us, count(*) over f as window_rows, count(alert) over f as window_scored, sum(coalesce(alert, false)::int) over f as window_alerts, round(sum(coalesce(alert, false)::int) over f / nullif(count(alert) over f, 0)::double, 6) as window_rate from dec window f as (partition by g, channel order by us rows between 23 preceding and current row)")
def rolling_candidate_health(t: Tables) -> DataFrame:
    return r6(reviews.rolling_candidates(_decisions(t), ["g", "channel"], 24).select("g", "us", "window_rows", "window_scored", "window_alerts", "window_rate"), "window_rate")


@query("experiment_summary", f"with {DEC}, a as (select g, null::varchar as signal, count(*) as rows, count(alert) as scored, count(*) filter (alert) as candidates from dec group by 1), x as (select g, unnest(string_split(reason_codes, '|')) as signal from dec where reason_codes <> ''), b as (select g, signal, null::bigint as rows, null::bigint as scored, count(*) as candidates from x group by 1, 2) select *, round(candidates / nullif(scored, 0)::double, 6) as candidate_share from (select * from a union all select * from b)")
def experiment_summary(t: Tables) -> DataFrame:
    return r6(reviews.experiment_summary(_decisions(t), ["g"]), "candidate_share")


@query("replay_metrics", f"with {DEC}, p as (select d.g, d.us, d.alert, e.v, first_value(e.v) over (partition by e.g order by e.us range between {H} preceding and {H} preceding) as f, coalesce(e.us - lag(e.us) over (partition by e.g order by e.us) > {H}, false) as gap from dec d join ev e using (g, us)) select count(*) as rows, count(alert) as scored, count(*) filter (alert) as candidates, count(*) filter (gap) as gaps, count(*) filter (v is null) as missing, count(v - f) as forecasts, round(avg(abs(v - f)), 6) as mae, round(sqrt(avg((v - f) * (v - f))), 6) as rmse from p")
def replay_metrics(t: Tables) -> DataFrame:
    d = _valued(t).withColumnRenamed("value", "v").withColumn("prediction", seq.exact_lag("v", HOUR, ["g"]))
    return r6(reviews.replay_metrics(d, ["g"], HOUR), "mae", "rmse")


@query("attributed_events", f"""with {DEC}, a as (select *, coalesce(us - lag(us) over (partition by g, channel order by us) = {H}, false) as adj from dec where alert), b as (select *, sum(case when adj then 0 else 1 end) over (partition by g, channel order by us) as run from a),
 e as (select g, channel, min(us) as start_us, max(us) as end_us, max(score) as max_score from b group by g, channel, run), f as (select *, row_number() over (partition by g, channel order by start_us) as r from e),
 x as (select l.g, l.us, l.signal, case when threshold = 0 then case when value > 0 then 2.0::double else 0.0::double end else value / nullif(threshold, 0) end as ratio from lng l join thr t on l.channel = t.channel and l.signal = t.signal),
 m as (select f.g, f.start_us, x.signal, x.ratio, row_number() over (partition by f.g, f.start_us order by x.ratio desc, x.signal desc) as k from f join x on x.g = f.g and x.us between f.start_us and f.end_us where f.r <= 20 and x.ratio is not null)
 select f.g, f.start_us, f.end_us, round(f.max_score, 6) as max_score, m.signal, round(m.ratio, 6) as peak from f left join m on m.g = f.g and m.start_us = f.start_us and m.k = 1 where f.r <= 20""")
def attributed_events(t: Tables) -> DataFrame:
    long = detect.long_signals(detect.compute_signals(t.hours(), SPEC), SPEC)
    thr = detect.higher_quantile(long, ["channel", "signal"], "value", 0.98)
    ratios = long.join(F.broadcast(thr), ["channel", "signal"]).withColumn("ratio", detect.ratio(F.col("value"), F.col("threshold"))).where("ratio is not null").select("g", "channel", "us", "signal", "ratio")
    events = detect.candidate_events(_decisions(t), ["g", "channel"], HOUR, ident="us").select("g", "channel", "start_us", "end_us", "max_score")
    return r6(reviews.attributed_events(events, ratios, ["g", "channel"], limit=20).drop("channel"), "max_score", "peak")


@query("time_partition", f"with {HOURS}, t as (select us, row_number() over (order by us) - 1 as r, count(*) over () as n from (select distinct us from ev)), c as (select us as cut from t where r = least(n - 1, greatest(1, cast(floor(n * 0.8::double) as bigint)))) select g, ev.us, ev.us < cut as first from ev, c")
def time_partition(t: Tables) -> DataFrame:
    d = t.hours()
    return quality.time_partition(d, 0.8).select("g", "us", "first")


@query("pressure_tendency", f"with {PHYS} select o, n, pk, round(price - lag(price, 3) over (partition by o order by n, pk, price), 4) as tendency from ph")
def pressure_tendency(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    return _phys(t).select("o", "n", "pk", F.round(F.col("price") - F.lag("price", 3).over(Window.partitionBy("o").orderBy("n", "pk", "price")), 4).alias("tendency"))


@query("scaled_features", f"with {USERS}, m as (select id, v, (k % 2)::double as flag, kind from eu), f as (select kind, quantile_cont(v, 0.5) as c, greatest(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 0.5 * stddev_samp(v), 0.001) as s from m group by 1) select id, round((v - c) / s, 6) as v, flag from m join f using (kind)")
def scaled_features(t: Tables) -> DataFrame:
    d = t.users().select("id", "kind", "v", (F.col("k") % 2).cast("double").alias("flag"))
    return r6(quality.robust_scale(d, ["v", "flag"], ["kind"]).select("id", "v", "flag"), "v", "flag")


@query("signal_vectors", f"with {LONG}, k as (select signal, count(*) as rows, count(value) as available from lng group by 1) select * from k")
def signal_vectors(t: Tables) -> DataFrame:
    long = detect.long_signals(detect.compute_signals(t.hours(), SPEC), SPEC)
    return long.groupBy("signal").agg(F.count("*").alias("rows"), F.count("value").alias("available"))


@query("unscored_reasons", f"with {SIG} select g, count(*) filter (forecast_residual is null) as no_forecast, count(*) filter (abrupt_change is null) as after_gap, count(*) filter (sustained_deviation is null) as short_run from sig group by 1")
def unscored_reasons(t: Tables) -> DataFrame:
    d = detect.compute_signals(t.hours(), SPEC)
    none = lambda s: F.count_if(F.col(f"v__{s}").isNull())
    return d.groupBy("g").agg(none("forecast_residual").alias("no_forecast"), none("abrupt_change").alias("after_gap"), none("sustained_deviation").alias("short_run"))


# --- archives -------------------------------------------------------------------------------------------------------------------


@query("flatline_by_shard", ORACLES["flatline_duration"])
def flatline_by_shard(t: Tables) -> DataFrame:
    return archive.flatline_by_shard(t.hours().select("g", "us", "k"), "k", HOUR, ["g"], 5 * HOUR).select("g", "us", "flat")


@query("shard_context", f"with {USERS}, a as (select id, us, us // {DAY} * {DAY} as own, (us + {6 * HOUR}) // {DAY} * {DAY} as ahead from eu) select own as shard_us, false as is_context, count(*) as rows from a group by 1 union all select ahead, true, count(*) from a where ahead > own group by 1")
def shard_context(t: Tables) -> DataFrame:
    return archive.with_context(t.users(), DAY, 6 * HOUR).groupBy("shard_us", "is_context").agg(F.count("*").alias("rows"))


@query("lags_by_shard", f"with {HOURS} select g, us, round(first_value(v) over (partition by g order by us range between {24 * HOUR} preceding and {24 * HOUR} preceding), 6) as day_before from ev")
def lags_by_shard(t: Tables) -> DataFrame:
    """Exact-time lags of a day inside shards of a week with a day of context."""
    d = archive.with_context(t.hours(), 7 * DAY, DAY)
    out = d.withColumn("day_before", seq.exact_lag("v", 24 * HOUR, ["g", "shard_us"]))
    return r6(out.where("not is_context").select("g", "us", "day_before"), "day_before")


@query("footer_catalog", "select count(*) as n, min(o_orderkey) as least, max(o_orderkey) as largest from orders")
def footer_catalog(t: Tables) -> DataFrame:
    one = archive.footer_catalog(t.spark, f"{t.sf_dir}/orders.parquet", "o_orderkey").first()
    return t.spark.createDataFrame([tuple(one)], "n long, least long, largest long")


@query("shard_manifest", f"with {USERS} select kind, count(*) as rows, count(*) filter (v is null) as v_missing, min(us) as first_us, max(us) as last_us from eu group by 1")
def shard_manifest(t: Tables) -> DataFrame:
    return archive.shard_manifest(t.users(), ["kind"], ["v"]).drop("fingerprint", "checksum")


@query("array_functions", f"with {HOURS}, a as (select g, list(v order by us) as xs from ev group by 1), b as (select g, xs[1:50] as xs from a) select g, len(list_filter(list_sort(xs), lambda x: x < 50)) as below, len(list_filter(list_sort(xs), lambda x: x <= xs[1])) as up_to_first, round(list_max(xs[1:10]), 6) as tenth_running_max, list_transform(range(least(len(xs), 4)), lambda j: cast(floor(j * (len(xs) - 1) / (least(len(xs), 4) - 1)) as bigint))::varchar as places from b")
def array_functions(t: Tables) -> DataFrame:
    w = F.array_sort(F.collect_list(F.struct("us", "v")))
    xs = t.hours().groupBy("g").agg(F.slice(F.transform(w, lambda r: r["v"]), 1, 50).alias("xs"))
    order, first = F.array_sort("xs"), F.col("xs")[0]
    places = values.linspace_places(F.size("xs").cast("long"), 4)
    text = F.concat(F.lit("["), F.array_join(F.transform(places, lambda p: p.cast("string")), ", "), F.lit("]"))
    return r6(xs.select("g", values.searchsorted(order, F.lit(50.0)).cast("long").alias("below"), values.searchsorted(order, first, right=True).cast("long").alias("up_to_first"), values.running_max(F.slice("xs", 1, 10))[F.least(F.size("xs"), F.lit(10)) - 1].alias("tenth_running_max"), text.alias("places")), "tenth_running_max")


@query("json_and_maps", """select doc_id, '{"source":"' || source || '","n":' || case when n_chars > 3000 then 'null' else cast(n_chars as varchar) end || '}' as body, case lang when 'en' then 1.5 when 'de' then 2.0 else 0.5 end::double as weight from documents where source is not null""")
def json_and_maps(t: Tables) -> DataFrame:
    d = t.raw("documents").where("source is not null")
    params = F.create_map(F.lit("en"), F.lit(1.5), F.lit("de"), F.lit(2.0))
    body = values.finite_json(F.struct("source", F.when(F.col("n_chars") <= 3000, F.col("n_chars")).alias("n")))
    return d.select("doc_id", body.alias("body"), values.map_value(params, F.coalesce("lang", F.lit("")), F.lit(0.5)).alias("weight"))
