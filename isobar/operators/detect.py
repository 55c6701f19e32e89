"""The causal detector: features, five signals, calibrated thresholds, tri-state decisions, candidate events."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobar.functions import seq

SIGNALS = ("forecast_residual", "abrupt_change", "flatline", "hour_residual", "sustained_deviation")


@dataclass(frozen=True)
class ObservationSpec:
    """Which columns of a table are the group, the time in microseconds and the channels, and the detector's offsets."""

    keys: list[str] = field(default_factory=lambda: ["g"])
    time: str = "us"
    channels: tuple[str, ...] = ("v",)
    cadence: int = 60_000_000
    horizons: tuple[int, int] = (1, 60)
    lags: tuple[int, ...] = (0, 5, 15, 60)
    sustained: int = 30
    accepted: str | None = None


def exact_lag_features(df: DataFrame, spec: ObservationSpec, horizon: int) -> DataFrame:
    """Values at t - h - lag by exact time, their differences from the origin, and whether all are there."""
    names, diffs = [], []
    for c in spec.channels:
        for lag in spec.lags:
            names.append(f"{c}__h{horizon}_lag{lag}")
            df = df.withColumn(names[-1], seq.exact_lag(c, (horizon + lag) * spec.cadence, spec.keys, spec.time))
        for lag in spec.lags[1:]:
            diffs.append(f"{c}__h{horizon}_diff{lag}")
            df = df.withColumn(diffs[-1], F.col(f"{c}__h{horizon}_lag0") - F.col(f"{c}__h{horizon}_lag{lag}"))
    complete = F.lit(True)
    for n in names:
        complete = complete & F.col(n).isNotNull()
    return df.withColumn(f"complete_h{horizon}", complete)


def compute_signals(df: DataFrame, spec: ObservationSpec) -> DataFrame:
    """Five signals per channel from past values only, with persistence forecasts; one exchange on the group."""
    df = seq.gap_runs(df, spec.cadence, spec.keys, "run", spec.time)
    w = seq.ordered(spec.keys, spec.time)
    run = Window.partitionBy(*spec.keys, "run").orderBy(spec.time)
    near, far = spec.horizons
    for c in spec.channels:
        df = df.withColumn(f"{c}__prediction", seq.exact_lag(c, near * spec.cadence, spec.keys, spec.time)).withColumn(f"{c}__prediction_far", seq.exact_lag(c, far * spec.cadence, spec.keys, spec.time))
        df = df.withColumn(f"{c}__forecast_residual", F.abs(F.col(c) - F.col(f"{c}__prediction"))).withColumn("_far", F.col(c) - F.col(f"{c}__prediction_far"))
        df = df.withColumn(f"{c}__hour_residual", F.abs("_far"))
        df = df.withColumn(f"{c}__abrupt_change", F.when(seq.contiguous(spec.cadence, spec.keys, spec.time), F.abs(F.col(c) - F.lag(c).over(w))))
        df = seq.flatline(df, c, spec.cadence, spec.keys, f"{c}__flatline", spec.time, spec.accepted).withColumn(f"{c}__flatline", F.col(f"{c}__flatline").cast("double"))
        df = df.withColumn(f"{c}__sustained_deviation", F.abs(seq.guarded(F.avg("_far"), "_far", run.rowsBetween(-(spec.sustained - 1), 0), spec.sustained))).drop("_far")
    return df


def long_signals(df: DataFrame, spec: ObservationSpec, signals: tuple[str, ...] = SIGNALS) -> DataFrame:
    """One row per row, channel and signal: the wide signals unpivoted."""
    wide = [f"{c}__{s}" for c in spec.channels for s in signals]
    ids = [*spec.keys, spec.time]
    out = df.select(*ids, *wide).unpivot(ids, wide, "_name", "value")
    return out.select(*ids, F.split("_name", "__")[0].alias("channel"), F.split("_name", "__")[1].alias("signal"), "value")


def _place_of(x: Column) -> Column:
    """A whole number that grows with a finite number: its sign and logarithm in steps of a 65536th. It needs no look at the data."""
    step = F.floor((F.ln(F.abs(x)) + 800.0) * 65_536.0) + 1
    return F.when(x == 0, F.lit(0).cast("long")).otherwise(F.signum(x).cast("long") * step)


def higher_quantile(df: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """The smallest value at or above the quantile's position (index ceil(q (n - 1))), exact, with its count.

    Values are counted once per (keys, value), so repeated values don't travel, and never all ordered: counts by narrow ranges
    of value say which range holds the position, and only its values are put in order. A key may hold all rows.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c")).withColumn("_range", _place_of(F.col(value).cast("double")))
    w = Window.partitionBy(*keys)
    ranges = counted.groupBy(*keys, "_range").agg(F.sum("_c").alias("_c"))
    ranges = ranges.withColumn("_upto", F.sum("_c").over(w.orderBy("_range"))).withColumn("n", F.sum("_c").over(w)).withColumn("_place", F.ceil(F.lit(float(q)) * (F.col("n") - 1)) + 1)
    target = ranges.where((F.col("_upto") >= F.col("_place")) & (F.col("_upto") - F.col("_c") < F.col("_place"))).select(*keys, "_range", "n", (F.col("_place") - (F.col("_upto") - F.col("_c"))).alias("_place"))
    inside = counted.join(target, [*keys, "_range"]).withColumn("_upto", F.sum("_c").over(w.orderBy(value)))
    return inside.where(F.col("_upto") >= F.col("_place")).groupBy(*keys).agg(F.min(value).alias("threshold"), F.first("n").alias("reference_rows"))


def fit_thresholds(long: DataFrame, keys: list[str], q: float, least: int = 1) -> DataFrame:
    """Thresholds of each group and pooled over all: group columns, channel, signal, threshold, reference_rows."""
    own = higher_quantile(long, [*keys, "channel", "signal"], "value", q)
    pooled = higher_quantile(long, ["channel", "signal"], "value", q)
    for k in keys:
        pooled = pooled.withColumn(k, F.lit("pooled"))
    own = own.select(*[F.col(k).cast("string").alias(k) for k in keys], "channel", "signal", "threshold", "reference_rows")
    return own.where(F.col("reference_rows") >= least).unionByName(pooled)


def with_fallback(df: DataFrame, table: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Looks up `value` by (keys, channel, signal); groups without an own row take the pooled one."""
    own = table.where(F.col(keys[0]) != "pooled").withColumnRenamed(value, "_own").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("channel").alias("_c"), F.col("signal").alias("_s"), "_own")
    pooled = table.where(F.col(keys[0]) == "pooled").select(F.col("channel").alias("_pc"), F.col("signal").alias("_ps"), F.col(value).alias("_pool"))
    on = (F.col("channel") == F.col("_c")) & (F.col("signal") == F.col("_s"))
    for k in keys:
        on = on & (F.col(k).cast("string") == F.col(f"_{k}"))
    out = df.join(own, on, "left").join(F.broadcast(pooled), (F.col("channel") == F.col("_pc")) & (F.col("signal") == F.col("_ps")), "left")
    return out.withColumn(value, F.coalesce("_own", "_pool")).withColumn("threshold_group", F.when(F.col("_own").isNotNull(), F.col(keys[0]).cast("string")).otherwise("pooled")).drop("_c", "_s", "_own", "_pc", "_ps", "_pool", *[f"_{k}" for k in keys])


def ratio(value: Column, threshold: Column) -> Column:
    """How many times the threshold; a zero threshold gives 2 or 0."""
    return F.when(threshold == 0, F.when(value > 0, 2.0).otherwise(0.0)).otherwise(value / F.when(threshold != 0, threshold))


def decide(scored: DataFrame, keys: list[str], time: str = "us", order: tuple[str, ...] = SIGNALS) -> DataFrame:
    """(keys, time, channel, signal, value, threshold) to one row per channel: score, alert (true, false, NULL = not scored), reasons."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("signal"))
    flag = F.col("value") > F.col("threshold")
    hit = F.when(flag, F.struct(rank.alias("r"), F.col("signal").alias("s")))
    out = scored.groupBy(*keys, time, "channel").agg(F.max(ratio(F.col("value"), F.col("threshold"))).alias("score"), F.max(flag).alias("alert"), F.array_sort(F.collect_list(hit)).alias("_h"))
    return out.withColumn("reason_codes", F.array_join("_h.s", "|")).drop("_h")


def decide_wide(df: DataFrame, spec: ObservationSpec, thresholds: DataFrame) -> DataFrame:
    """The decisions of `decide` (with the channel's `value`) from signals that stand side by side, and fitted thresholds
    (channel, signal, threshold).

    The thresholds are one row, whatever the data, so nothing is unpivoted or shuffled: the rows keep the signals' partitioning.
    """
    name = F.concat_ws("__", "channel", "signal")
    one = thresholds.agg(F.map_from_entries(F.collect_list(F.struct(name, F.col("threshold")))).alias("_limits"))
    d = df.crossJoin(F.broadcast(one))
    cells = []
    for c in spec.channels:
        x = {s: F.col(f"{c}__{s}") for s in SIGNALS}
        limit = {s: F.try_element_at("_limits", F.lit(f"{c}__{s}")) for s in SIGNALS}
        hits = F.filter(F.array(*[F.when(x[s] > limit[s], F.lit(s)) for s in SIGNALS]), lambda r: r.isNotNull())
        flags = F.array(*[x[s] > limit[s] for s in SIGNALS])
        alert = F.when(F.exists(flags, lambda f: f.isNotNull()), F.exists(flags, lambda f: F.coalesce(f, F.lit(False))))
        score = F.greatest(*[ratio(x[s], limit[s]) for s in SIGNALS])
        cells.append(F.struct(F.lit(c).alias("channel"), score.alias("score"), alert.alias("alert"), F.array_join(hits, "|").alias("reason_codes"), F.col(c).alias("value")))
    return d.select(*spec.keys, spec.time, F.explode(F.array(*cells)).alias("_c")).select(*spec.keys, spec.time, "_c.*")


def wide_decisions(df: DataFrame, spec: ObservationSpec, thresholds: dict[tuple[str, str], float]) -> DataFrame:
    """The same decision with all signals side by side: no shuffle, for a threshold map of fixed size."""
    scores, alerts, reasons = [], [], []
    for s in SIGNALS:
        for c in spec.channels:
            if (c, s) in thresholds:
                t = F.lit(float(thresholds[c, s]))
                x = F.col(f"{c}__{s}")
                scores.append(ratio(x, t))
                alerts.append(x > t)
                reasons.append(F.when(x > t, F.lit(f"{c}:{s}")))
    score = F.greatest(*scores, F.lit(None).cast("double")) if scores else F.lit(None)
    any_true = F.array_contains(F.array(*alerts), True)
    scored = F.coalesce(*alerts).isNotNull()
    return df.withColumn("anomaly_score", score).withColumn("alert", F.when(scored, F.coalesce(any_true, F.lit(False)))).withColumn("is_candidate", F.coalesce(any_true, F.lit(False))).withColumn("reason_codes", F.concat_ws("|", *reasons)).withColumn("scoring_status", F.when(scored, "scored_available_signals").otherwise("missing_observation"))


def explanations(df: DataFrame, spec: ObservationSpec, thresholds: dict[tuple[str, str], float]) -> DataFrame:
    """One row per signal over its threshold: channel, signal, value, threshold, ratio."""
    cells = [F.struct(F.lit(c).alias("channel"), F.lit(s).alias("signal"), F.col(f"{c}__{s}").alias("value"), F.lit(float(t)).alias("threshold")) for (c, s), t in thresholds.items()]
    rows = df.select(*spec.keys, spec.time, F.explode(F.array(*cells)).alias("x")).select(*spec.keys, spec.time, "x.*")
    return rows.where(F.col("value") > F.col("threshold")).withColumn("exceedance_ratio", ratio(F.col("value"), F.col("threshold")))


def live_decisions(df: DataFrame, spec: ObservationSpec, thresholds: dict[tuple[str, str], float], domains: dict[str, tuple[tuple[float, str], tuple[float, str]]]) -> DataFrame:
    """wide_decisions with physics alerts, severity and availability.

    domains: a channel's least and largest value and the alert's name below and above. Severity is high with a physics alert or
    a candidate of twice a threshold, review for other candidates, else info. Unreported slots and missing channels are
    facts of availability; nothing is filled.
    """
    d = wide_decisions(df, spec, thresholds)
    alerts = []
    for c, ((low, under), (high, over)) in domains.items():
        alerts += [F.when(F.col(c) < low, f"{c}:{under}"), F.when(F.col(c) > high, f"{c}:{over}")]
    slots = F.floor((F.col(spec.time) - F.lag(spec.time).over(seq.ordered(spec.keys, spec.time))) / spec.cadence) - 1
    d = d.withColumn("physics_alerts", F.concat_ws("|", *alerts)).withColumn("unreported_slots_before", F.greatest(F.coalesce(slots, F.lit(0)), F.lit(0)).cast("long"))
    severity = F.when((F.col("physics_alerts") != "") | (F.coalesce(F.col("anomaly_score") >= 2, F.lit(False)) & F.col("is_candidate")), "high").when(F.col("is_candidate"), "review").otherwise("info")
    return d.withColumn("severity", severity).withColumn("missing_channels", F.concat_ws("|", *[F.when(F.col(c).isNull(), c) for c in spec.channels]))


def candidate_events(decisions: DataFrame, keys: list[str], cadence: int, time: str = "us", ident: str = "id", kind: str = "candidate") -> DataFrame:
    """Contiguous alerts of a key as closed intervals: bounds, count, largest score, sorted distinct reasons, first and last id."""
    alerts = seq.gap_runs(decisions.where("alert"), cadence, keys, "_run", time)
    out = alerts.groupBy(*keys, "_run").agg(
        F.min(time).alias("start_us"), F.max(time).alias("end_us"), F.count("*").alias("observations"), F.max("score").alias("max_score"),
        F.array_join(F.array_sort(F.collect_set("reason_codes")), ",").alias("reasons"), F.min_by(ident, time).cast("string").alias("first_id"), F.max_by(ident, time).cast("string").alias("last_id"),
    )
    text = F.concat(F.lit(f'["{kind}"'), *[F.concat(F.lit(', "'), F.col(k).cast("string"), F.lit('"')) for k in keys], F.lit(', "'), F.col("first_id"), F.lit('", "'), F.col("last_id"), F.lit('"]'))
    return out.withColumn("event_id", F.concat(F.lit(f"{kind}-"), F.substring(F.sha2(text, 256), 1, 20))).drop("_run")


def background_windows(decisions: DataFrame, keys: list[str], cadence: int, rows: int, per_key: int, time: str = "us") -> DataFrame:
    """Up to per_key evenly spaced windows of `rows` contiguous rows that were scored and raised no alert."""
    quiet = seq.gap_runs(decisions.where("alert = false"), cadence, keys, "_run", time)
    w = Window.partitionBy(*keys, "_run").orderBy(time)
    cut = quiet.withColumn("_w", F.floor((F.row_number().over(w) - 1) / rows)).groupBy(*keys, "_run", "_w").agg(F.min(time).alias("start_us"), F.max(time).alias("end_us"), F.count("*").alias("observations")).where(F.col("observations") == rows)
    k = Window.partitionBy(*keys)
    cut = cut.withColumn("_i", F.row_number().over(k.orderBy("start_us")) - 1).withColumn("_n", F.count("*").over(k))
    take = F.least(F.col("_n"), F.lit(per_key))
    places = F.when(take == 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), take.cast("int") - 1), lambda i: F.floor(i * (F.col("_n") - 1) / (take - 1)).cast("long")))
    return cut.where(F.array_contains(places, F.col("_i").cast("long"))).drop("_run", "_w", "_i", "_n")


def review_join(decisions: DataFrame, reviews: DataFrame, keys: list[str], time: str = "us", how: str = "inner", bucket: int = 86_400_000_000) -> DataFrame:
    """Decisions within [start_us, end_us) of a review of the same keys: an equi-join on time buckets, then the exact bounds."""
    spread = reviews.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_us") / bucket), F.floor((F.greatest("end_us", F.col("start_us") + 1) - 1) / bucket))))
    spread = spread.select(*[F.col(k).alias(f"_{k}") for k in keys], "_b", *[c for c in reviews.columns if c not in keys])
    on = F.floor(F.col(time) / bucket) == F.col("_b")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    inside = on & (F.col(time) >= F.col("start_us")) & (F.col(time) < F.col("end_us"))
    out = decisions.join(spread, inside, how)
    return out if how in ("left_semi", "left_anti") else out.drop("_b", *[f"_{k}" for k in keys])


def evaluate_reviews(decisions: DataFrame, reviews: DataFrame, keys: list[str], time: str = "us") -> DataFrame:
    """Per review: scored rows, alert rows, detected, delay bounds in seconds from the onset interval."""
    hit = review_join(decisions, reviews, keys, time)
    out = hit.groupBy("review_id", "onset_earliest_us", "onset_latest_us").agg(F.count_if(F.col("alert").isNotNull()).alias("scored_rows"), F.count_if(F.col("alert")).alias("alert_rows"), F.min(F.when(F.col("alert"), F.col(time))).alias("first_alert_us"))
    out = reviews.select("review_id").join(out, "review_id", "left")
    return out.select("review_id", F.coalesce("scored_rows", F.lit(0)).alias("scored_rows"), F.coalesce("alert_rows", F.lit(0)).alias("alert_rows"), (F.coalesce("alert_rows", F.lit(0)) > 0).alias("detected"),
        ((F.col("first_alert_us") - F.col("onset_latest_us")) / 1e6).alias("delay_min_s"), ((F.col("first_alert_us") - F.col("onset_earliest_us")) / 1e6).alias("delay_max_s"))


def overlaps(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals [start_us, end_us) that reach into a later one of the same key."""
    before = F.max("end_us").over(Window.partitionBy(*keys).orderBy("start_us", "end_us").rowsBetween(Window.unboundedPreceding, -1))
    return intervals.withColumn("overlap", F.coalesce(before > F.col("start_us"), F.lit(False)))


def missing_intervals(df: DataFrame, cadence: int, keys: list[str], time: str = "us", rounding: str = "ceil") -> DataFrame:
    """Gaps between distinct times: last and next time and how many slots went unreported (ceil or floor of the step, less 1)."""
    d = df.select(*keys, time).distinct().withColumn("last_us", F.lag(time).over(seq.ordered(keys, time)))
    step = (F.col(time) - F.col("last_us")) / F.lit(float(cadence))
    slots = (F.ceil(step) if rounding == "ceil" else F.floor(step)) - 1
    return d.where((F.col(time) - F.col("last_us")) > cadence).select(*keys, "last_us", F.col(time).alias("next_us"), F.greatest(slots, F.lit(0)).cast("long").alias("slots"))


def segments(df: DataFrame, value: str, cadence: int, keys: list[str], time: str = "us") -> DataFrame:
    """Chart segments: a missing value, a gap or the first value after one opens a new segment; rows without value are left out."""
    w = seq.ordered(keys, time)
    fresh = ~(seq.contiguous(cadence, keys, time) & F.lag(value).over(w).isNotNull() & F.col(value).isNotNull())
    return seq.island(df, fresh, keys, "segment", time).where(F.col(value).isNotNull())
