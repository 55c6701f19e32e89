"""Registered queries: choosing forecasts, thresholds and weights, calibration, pattern models, live decisions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.functions import seq
from isobar.operators import calibrate, detect, evaluate, inference, models, scenarios
from isobar.plans import scenarios as plans
from isobar.plans.catalogue import DAY, HOUR, HOURS, LABELS, LONG, SEG, SIG, SPEC, USERS, Tables, query, r6

H = str(HOUR)


# --- forecasts ----------------------------------------------------------------------------------------------------------

_LAGS = ", ".join(f"first_value(v) over (partition by g order by us range between {k * HOUR} preceding and {k * HOUR} preceding) as l{k}" for k in (1, 2, 23, 24))


def _forecasts(t: Tables) -> DataFrame:
    d = t.hours()
    for k in (1, 2, 23, 24):
        d = d.withColumn(f"l{k}", seq.exact_lag("v", k * HOUR, ["g"]))
    return d.select("g", "us", "v", F.col("l1").alias("persistence"), F.col("l24").alias("seasonal"), (F.col("l1") + (F.col("l1") - F.col("l2"))).alias("trend"), ((F.col("l1") + F.col("l24")) / 2).alias("mean_of_both"))


@query("forecast_choice", f"""with {HOURS}, l as (select g, us, v, {_LAGS} from ev), f as (select g, v, l1 as a, l24 as b, l1 + (l1 - l2) as c, (l1 + l24) / 2 as d from l), k as (select * from f where a is not null and b is not null and c is not null and d is not null and v is not null),
 p as (select g, avg(abs(v - a)) as a, avg(abs(v - b)) as b, avg(abs(v - c)) as c, avg(abs(v - d)) as d from k group by 1), o as (select unnest(['persistence', 'seasonal', 'trend', 'mean_of_both']) as candidate, unnest([avg(a), avg(b), avg(c), avg(d)]) as m, count(*) as groups from p)
 select candidate, round(m, 6) as macro_mae, groups, m = min(m) over () as chosen from o""")
def forecast_choice(t: Tables) -> DataFrame:
    return r6(calibrate.choose_forecast(_forecasts(t), "g", "v", ["persistence", "seasonal", "trend", "mean_of_both"]), "macro_mae")


@query("six_forecasts")
def six_forecasts(t: Tables) -> DataFrame:
    d = detect.exact_lag_features(t.hours().withColumn("season", seq.exact_lag("v", 24 * HOUR, ["g"])), SPEC, 1)
    cut = d.agg(F.percentile("us", 0.7)).first()[0]
    features = ["v__h1_lag0", "v__h1_lag1", "v__h1_lag3", "v__h1_diff1"]
    rows = calibrate.forecast_candidates(d.where(F.col("us") < cut), d.where(F.col("us") >= cut), features, "v", "v__h1_lag0", "season", iterations=20)
    return r6(calibrate.choose_forecast(rows, "g", "v", ["persistence", "seasonal", "median_change", "level", "residual", "residual_shrunk"]), "macro_mae")


# --- thresholds, weights, calibration --------------------------------------------------------------------------------------


@query("quantile_threshold", f"with {USERS}, a as (select kind as g, v from eu union all select 'same', 7.0 from eu where id % 50 = 0), q as (select g, quantile_cont(v, 0.98) as t, min(v) as lo, max(v) as hi, count(*) as n from a group by 1) select g, round(case when lo = hi then hi else t end, 6) as threshold, lo = hi as moved, n from q")
def quantile_threshold(t: Tables) -> DataFrame:
    d = t.users().select(F.col("kind").alias("g"), "v", "id")
    d = d.select("g", "v").unionByName(d.where("id % 50 = 0").select(F.lit("same").alias("g"), F.lit(7.0).alias("v")))
    out = evaluate.quantile_threshold(d, "v", 0.98, ["g"])
    same = F.col("threshold") == math.nextafter(7.0, math.inf)
    return r6(out.select("g", "threshold", same.alias("moved"), "n"), "threshold")


@query("threshold_resolution", f"with {LABELS}, s as (select g, count(*) filter (y = 1) as pos, count(*) filter (y = 0) as neg, quantile_cont(score, 0.9) filter (y is not null) as t from lab group by 1), u as (select g, quantile_cont(score, 0.99) as t from lab where g < 'm' group by 1), p as (select quantile_cont(score, 0.95) as t from lab) select s.g, round(case when pos >= 5 and neg >= 30 then s.t else coalesce(u.t, p.t) end, 6) as threshold, case when pos >= 5 and neg >= 30 then 'labels' when u.t is not null then 'tail' else 'pooled' end as source from s left join u using (g), p")
def threshold_resolution(t: Tables) -> DataFrame:
    d = t.labels()
    own = d.groupBy("g").agg(F.count_if(F.col("y") == 1).alias("positives"), F.count_if(F.col("y") == 0).alias("negatives"), F.percentile(F.when(F.col("y").isNotNull(), F.col("score")), 0.9).alias("threshold"))
    tail = d.where("g < 'm'").groupBy("g").agg(F.percentile("score", 0.99).alias("threshold"))
    pooled = d.agg(F.percentile("score", 0.95)).first()[0]
    return r6(calibrate.resolve_thresholds(d, own, tail, "g", F.lit(pooled), 5, 30), "threshold")


@query("strict_and_adjusted_objective", f"""with {SEG}, kn as (select score, y from lab where y is not null), gr as (select unnest([0, 1, 2]) as i, unnest(quantile_cont(score, [0.5, 0.8, 0.95])) as threshold from kn), seg1 as (select g, seg, count(*) as rows, max(score) as top from sg where y = 1 group by 1, 2),
 c as (select i, threshold, count(*) filter (score >= threshold and y = 1) as tp, count(*) filter (score >= threshold) as predicted, count(*) filter (y = 1) as positives from kn, gr group by 1, 2), a as (select i, sum(rows) filter (top >= threshold) as adj from seg1, gr group by 1),
 d as (select c.*, coalesce(adj, 0) as adj from c left join a using (i)), e as (select *, case when predicted + positives > 0 then 2.0::double * tp / (predicted + positives) else 0 end as f1, case when adj + predicted - tp + positives > 0 then 2.0::double * adj / (adj + predicted - tp + positives) else 0 end as soft from d)
 select cast(i as int) as i, round(threshold, 6) as threshold, round(f1, 6) as f1, round(soft, 6) as adjusted_f1, round((0.7::double * f1 + 0.3::double * soft) * case when case when predicted > 0 then tp / predicted::double else 0 end < 0.35 then 0.5 else 1 end, 6) as objective from e""")
def strict_and_adjusted_objective(t: Tables) -> DataFrame:
    return r6(evaluate.quantile_objective(t.labels(), ["g"], "doc_id", [0.5, 0.8, 0.95]), "threshold", "f1", "adjusted_f1", "objective")


@query("group_report", f"with {SEG}, ad as (select g, y, p, case when y = 1 then max(p) over (partition by g, seg) else p end as a from sg), k as (select g, count(*) as n, count(*) filter (y = 1 and p = 1) as tp, count(*) filter (y = 0 and p = 1) as fp, count(*) filter (y = 1 and p = 0) as fn, count(*) filter (y = 1 and a = 1) as atp, count(*) filter (y = 1 and a = 0) as afn from ad where y is not null group by 1), u as (select * from k union all select null, sum(n), sum(tp), sum(fp), sum(fn), sum(atp), sum(afn) from k) select g, n::bigint as n, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, round(case when 2 * tp + fp + fn > 0 then 2.0::double * tp / (2 * tp + fp + fn) else 0 end, 6) as f1, round(case when 2 * atp + fp + afn > 0 then 2.0::double * atp / (2 * atp + fp + afn) else 0 end, 6) as adjusted_f1 from u")
def group_report(t: Tables) -> DataFrame:
    return r6(evaluate.group_report(t.labels(), ["g"], "doc_id"), "f1", "adjusted_f1")


@query("temperature_losses", f"with {LABELS}, p as (select y, least(score / 10000.0, 0.99)::double as q from lab where y is not null), x as (select ln(greatest(case when y = 1 then q else 1 - q end, 1e-12)) as own, ln(greatest(q, 1e-12)) as a, ln(greatest(1 - q, 1e-12)) as b, t from p, (select unnest([0.5, 1.0, 2.0, 4.0])::double as t) z) select t as temperature, round(avg(ln(exp(a / t) + exp(b / t)) - own / t), 6) as loss from x group by 1")
def temperature_losses(t: Tables) -> DataFrame:
    q = F.least(F.col("score") / 10000.0, F.lit(0.99))
    d = t.labels().where("y is not null").select(F.array(1 - q, q).alias("p"), "y")
    return r6(calibrate.temperature_losses(d, "p", "y", [0.5, 1.0, 2.0, 4.0]), "loss")


@query("calibrated_probabilities", f"with {LABELS}, p as (select doc_id, least(greatest(least(score / 10000.0, 0.99), 1e-8), 1 - 1e-8)::double as q from lab) select doc_id, round(1 / (1 + exp(-(1.5 * ln(q / (1 - q)) - 0.25))), 6) as risk, round(pow(q, 0.5) / (pow(q, 0.5) + pow(1 - q, 0.5)), 6) as softened from p")
def calibrated_probabilities(t: Tables) -> DataFrame:
    q = F.least(F.greatest(F.least(F.col("score") / 10000.0, F.lit(0.99)), F.lit(1e-8)), F.lit(1 - 1e-8))
    d = t.labels().withColumn("p", F.array(1 - q, q))
    return r6(d.select("doc_id", calibrate.calibrated_risk(q, 1.5, -0.25).alias("risk"), calibrate.with_temperature("p", 2.0)[1].alias("softened")), "risk", "softened")


@query("fitted_calibration")
def fitted_calibration(t: Tables) -> DataFrame:
    q = F.least(F.greatest(F.col("score") / 10000.0, F.lit(0.01)), F.lit(0.99))
    d = t.labels().where("y is not null").select(F.array(1 - q, q).alias("p"), "y", F.ln(q / (1 - q)).alias("logit"))
    slope, intercept = models.platt(d, "logit", "y")
    best = calibrate.fit_temperature(d, "p", "y")
    return r6(t.spark.createDataFrame([("slope", slope), ("intercept", intercept), ("temperature", best)], "setting string, value double"), "value")


@query("weight_search")
def weight_search(t: Tables) -> DataFrame:
    d = t.labels().select("g", "y", (F.col("score") / 10000.0).alias("length"), F.coalesce(1.0 - F.col("quality"), F.lit(0.5)).alias("poor"), (F.pmod(F.xxhash64("doc_id"), F.lit(1000)) / 1000.0).alias("noise"))
    weights, objective = calibrate.search_weights(d, "g", ["length", "poor", "noise"], "y", calibrate.weight_candidates(3, draws=64))
    return r6(t.spark.createDataFrame([*weights.items(), ("objective", objective)], "part string, value double"), "value")


@query("sampled_windows", f"with {HOURS}, a as (select *, coalesce(us - lag(us) over (partition by g order by us) = {H}, false) as adj from ev), b as (select *, sum(case when adj then 0 else 1 end) over (partition by g order by us) as run from a), c as (select *, row_number() over (partition by g, run order by us) - 1 as i, count(*) over (partition by g, run) as n from b), d as (select g, us from c where i % 4 = 0 and i + 12 <= n), e as (select *, row_number() over (partition by g order by us) - 1 as p, count(*) over (partition by g) as m from d) select g, us as start_us from e where m <= 10 or floor((p + 1) * 10 / greatest(m, 10)::double) > floor(p * 10 / greatest(m, 10)::double)")
def sampled_windows(t: Tables) -> DataFrame:
    return calibrate.window_sample(t.hours(), ["g"], HOUR, 12, 4, 10)


# --- pattern models over scenarios --------------------------------------------------------------------------------------------


def _labelled(t: Tables) -> tuple[DataFrame, list[str]]:
    from isobar.operators import quality

    d = scenarios.generate_all(plans._windows(t), plans.SPEC).select("scenario_id", "i", F.col("scenario__v").alias("v"), "label", (F.col("i") * HOUR).alias("us"), "window_id")
    d = quality.pattern_features(d, "v", HOUR, ["scenario_id"], deltas=(1, 5), windows=(5, 30))
    return d, ["v", "v__missing", "v__delta1", "v__delta5", "v__repeat", "v__absent", "v__z5", "v__z30", "v__deviation5", "v__deviation30"]


@query("pattern_model_choice")
def pattern_model_choice(t: Tables) -> DataFrame:
    d, features = _labelled(t)
    fit, selection = d.where("crc32(window_id) % 3 > 0"), d.where("crc32(window_id) % 3 = 0")
    _, trials = calibrate.choose_family(fit, selection, features, "label", "no_injection", iterations=3, trees=10)
    return r6(t.spark.createDataFrame([(x["family"], x["average_precision"], x["macro_f1"], x["objective"]) for x in trials], "family string, average_precision double, macro_f1 double, objective double"), "average_precision", "macro_f1", "objective")


@query("two_head_patterns")
def two_head_patterns(t: Tables) -> DataFrame:
    d, features = _labelled(t)
    model = calibrate.PatternModel(features, "label", "no_injection", iterations=5, trees=15).fit(d.where("crc32(window_id) % 3 > 0"))
    out = model.predict(d.where("crc32(window_id) % 3 = 0"))
    return r6(out.select("scenario_id", "i", "label", "pattern", "fault_pattern", "risk", "pattern_confidence"), "risk", "pattern_confidence")


@query("feature_importance")
def feature_importance(t: Tables) -> DataFrame:
    d, features = _labelled(t)
    model = calibrate.PatternModel(features, "label", "no_injection", family="forest", trees=15).fit(d.where("crc32(window_id) % 3 > 0"))
    score = lambda x: float(model.predict(x).agg(F.avg((F.col("pattern") == F.col("label")).cast("double"))).first()[0] or 0.0)
    found = calibrate.permutation_importance(d.where("crc32(window_id) % 3 = 0").select("label", *features), features[:4], score, rows=5_000)
    return r6(t.spark.createDataFrame([(x["feature"], x["importance"]) for x in found], "feature string, importance double"), "importance")


@query("stacked_classifier")
def stacked_classifier(t: Tables) -> DataFrame:
    d = t.labels().where("y is not null").withColumn("long", F.col("score") > 5000)
    s = calibrate.stacked_features(d, ["score"], ["g"], d, ["long"])
    train, rest = s.where("doc_id % 3 <> 0"), s.where("doc_id % 3 = 0")
    model, _, _ = calibrate.fit_stacker(train, rest, ["score__norm", "long__flag"], "y", "g", iterations=(5, 10))
    scored = calibrate.supervised_score(model, rest)
    limits = scored.groupBy("g").agg(F.percentile("probability", 0.9).alias("threshold"))
    return r6(calibrate.supervised_decision(scored, limits, "g").select("doc_id", "g", "probability", "alert"), "probability")


@query("injection_benchmark")
def injection_benchmark(t: Tables) -> DataFrame:
    d = models.inject_faults(t.hours(), ["g"], "v", rate=0.3, length=8, swap="n")
    judge = lambda x: detect.wide_decisions(detect.compute_signals(x, SPEC), SPEC, _LIMITS).withColumn("beyond", (F.col("v") < 0) | (F.col("v") > 100))
    out = models.injection_report(judge(t.hours()), judge(d.withColumn("v", F.col("injected"))), ["g"], physical="beyond")
    return r6(out, "row_recall", "combined_recall")


# --- live decisions ----------------------------------------------------------------------------------------------------------

_LIMITS = {("v", "forecast_residual"): 60.0, ("v", "abrupt_change"): 60.0, ("v", "flatline"): 2.0}


@query("live_decisions", f"""with {SIG}, a as (select g, us, v, greatest(forecast_residual / 60, abrupt_change / 60, flatline / 2) as score, coalesce(forecast_residual > 60, false) or coalesce(abrupt_change > 60, false) or coalesce(flatline > 2, false) as candidate, coalesce(forecast_residual, abrupt_change, flatline) is not null as scored, v < 2 as low, v > 98 as high,
  coalesce(greatest((us - lag(us) over (partition by g order by us)) // {H} - 1, 0), 0) as slots from sig)
 select g, us, round(score, 6) as anomaly_score, candidate as is_candidate, case when scored then 'scored_available_signals' else 'missing_observation' end as scoring_status, case when low or high or (score >= 2 and candidate) then 'high' when candidate then 'review' else 'info' end as severity, case when low then 'v:physical_domain' when high then 'v:reporting_range' else '' end as physics_alerts, cast(slots as bigint) as unreported_slots_before, '' as missing_channels from a""")
def live_decisions(t: Tables) -> DataFrame:
    d = detect.live_decisions(detect.compute_signals(t.hours(), SPEC), SPEC, _LIMITS, {"v": ((2.0, "physical_domain"), (98.0, "reporting_range"))})
    return r6(d.select("g", "us", "anomaly_score", "is_candidate", "scoring_status", "severity", "physics_alerts", "unreported_slots_before", "missing_channels"), "anomaly_score")


@query("new_series_inference", f"""with {LONG}, n as (select g, us, row_number() over (partition by g order by us) as i from sig), a as (select l.*, i from lng l join n using (g, us)), rk as (select g, signal, value, row_number() over (partition by g, signal order by value) as rn, count(*) over (partition by g, signal) as n from a where value is not null and i <= 100), t as (select g, signal, value as threshold from rk where rn = ceil(0.98::double * (n - 1)) + 1)
 select a.g, a.us, round(max(case when threshold = 0 then case when value > 0 then 2.0::double else 0.0::double end else value / nullif(threshold, 0) end), 6) as score, bool_or(value > threshold) as alert from a join t using (g, signal) where i > 100 group by 1, 2""")
def new_series_inference(t: Tables) -> DataFrame:
    decisions, _ = inference.infer(t.hours(), SPEC, leading=100, q=0.98)
    return r6(decisions.select("g", "us", "score", "alert"), "score")


@query("live_explanations", f"""with {SIG}, x as (select g, us, 'forecast_residual' as signal, forecast_residual as value, 60.0::double as threshold from sig union all select g, us, 'abrupt_change', abrupt_change, 60.0 from sig union all select g, us, 'flatline', flatline, 2.0 from sig) select g, us, 'v' as channel, signal, round(value, 6) as value, threshold, round(value / threshold, 6) as exceedance_ratio from x where value > threshold""")
def live_explanations(t: Tables) -> DataFrame:
    return r6(detect.explanations(detect.compute_signals(t.hours(), SPEC), SPEC, _LIMITS), "value", "exceedance_ratio")


@query("rule_fault_type", f"""with {USERS}, a as (select kind, us // {DAY} as day, us, v from eu), ref as (select kind, quantile_cont(v, 0.5) as med, quantile_cont(v, 0.98) as q98, stddev_pop(v) as std from a group by 1), d as (select a.*, row_number() over w - 1 as i, abs(v - lag(v) over w) as step, (v - med) / std as dev, v >= q98 as pressed, std from a join ref using (kind) window w as (partition by kind, day order by us)),
 s as (select kind, day, count(*) as rows, count(v) as seen, max(step) as step, avg((v = 0)::int) as zeros, stddev_pop(v) / any_value(std) as ratio, regr_slope(dev, i) as slope, corr(i, dev) as line, avg(dev) as shift, max(abs(dev)) as far, quantile_cont(abs(dev), 0.99) as q99, avg(pressed::int) as pressed from d group by 1, 2)
 select kind, day, rows, seen, case when seen < 0.5 * rows then 'dropout' when rows < 3 then 'spike' when coalesce(step < 1e-8, false) and rows >= 6 then 'stuck' when zeros > 0.9 then 'dropout' when rows >= 6 and coalesce(abs(slope) * rows > 3 and abs(line) > 0.85, false) then 'drift' when ratio > 3 then 'noise_burst' when ratio < 0.4 and rows >= 12 then 'scale_error' when abs(shift) > 1.5 and ratio < 1.5 then 'bias' when far > 4 and rows <= 6 then 'spike' when q99 > 3 then 'spike' when pressed > 0.8 and ratio < 0.6 then 'clipping' else 'complex' end as fault from s""")
def rule_fault_type(t: Tables) -> DataFrame:
    d = t.users().withColumn("day", F.floor(F.col("us") / DAY))
    return models.classify_event(d, d, ["kind", "day"], "v", reference_keys=["kind"]).select("kind", "day", "rows", "seen", "fault")
