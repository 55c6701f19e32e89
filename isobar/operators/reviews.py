"""Decisions and reviews as checked tables, reviewed-interval evaluation with exposure, shard-spanning runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobar.functions import seq
from isobar.operators.detect import overlaps, review_join

# Fixed values of a review: its states, and the kinds of evidence that may confirm one (quality codes and model output may not).
REVIEW_STATES = ("unknown", "confirmed_event", "reviewed_background")


def _blank(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) == ""


def _first(*reasons: tuple[Column, str]) -> Column:
    """The name of the first rule that a row breaks; NULL if it breaks none."""
    return F.coalesce(*[F.when(F.coalesce(broken, F.lit(False)), name) for broken, name in reasons])


def check_decisions(df: DataFrame, keys: list[str], time: str = "us", ident: str = "id", alert: str = "alert") -> DataFrame:
    """df with `reject_reason`: missing keys, times or ids, and repeats of (keys, time) or of (id, last key).

    A decision is true, false or NULL; a column of another type is refused as a whole, as text would turn into alarms.
    """
    if df.schema[alert].dataType.simpleString() != "boolean":
        raise TypeError(f"{alert} must be boolean")
    copies = lambda *names: F.count("*").over(Window.partitionBy(*names)) > 1
    empty = [(_blank(k), f"missing_{k}") for k in (*keys, ident)]
    return df.withColumn("reject_reason", _first(*empty, (F.col(time).isNull(), "missing_time"), (copies(*keys, time), "repeated_time"), (copies(ident, keys[-1]), "repeated_id")))


def check_reviews(reviews: DataFrame, keys: list[str], bases: tuple[str, ...]) -> DataFrame:
    """reviews (review_id, keys, start_us, end_us, review_status, reviewer, reviewed_at_us, evidence_basis, evidence_refs, event_id,
    onset_earliest_us, onset_latest_us) with `reject_reason`.

    evidence_refs is a JSON list of {url, sha256}. An accepted review (a confirmed event or reviewed background) needs a named
    reviewer, independent evidence and references with a URL and a full hash; accepted intervals of a key may not overlap, and
    an event counts once.
    """
    refs = F.from_json("evidence_refs", "array<struct<url: string, sha256: string>>")
    good = lambda r: F.coalesce(r["url"].rlike("^https?://") & r["sha256"].rlike("^[0-9a-fA-F]{64}$"), F.lit(False))
    accepted, event = F.col("review_status") != "unknown", F.col("review_status") == "confirmed_event"
    d = overlaps(reviews.withColumn("_accepted", F.coalesce(accepted, F.lit(False))), [*keys, "_accepted"])
    copies = lambda *names: F.count("*").over(Window.partitionBy(*names)) > 1
    reason = _first(
        (_blank("review_id"), "missing_review_id"), (copies("review_id"), "repeated_review_id"), (F.col("review_status").isNull() | ~F.col("review_status").isin(*REVIEW_STATES), "unknown_status"),
        *[(_blank(k), f"missing_{k}") for k in keys], (F.col("start_us").isNull() | F.col("end_us").isNull() | (F.col("end_us") <= F.col("start_us")), "empty_interval"),
        (accepted & _blank("reviewer"), "no_reviewer"), (accepted & F.col("reviewed_at_us").isNull(), "no_review_time"), (accepted & ~F.coalesce(F.col("evidence_basis").isin(*bases), F.lit(False)), "no_independent_evidence"),
        (accepted & (F.coalesce(F.size(refs), F.lit(0)) <= 0), "no_references"), (accepted & ~F.forall(refs, good), "bad_reference"),
        (event & _blank("event_id"), "no_event_id"), (event & ~F.coalesce((F.col("onset_earliest_us") <= F.col("onset_latest_us")) & (F.col("onset_latest_us") <= F.col("start_us")), F.lit(False)), "bad_onset"),
        (accepted & F.col("overlap"), "overlapping_interval"), (event & copies(*keys, "review_status", "event_id"), "repeated_event"),
    )
    return d.withColumn("reject_reason", reason).drop("_accepted", "overlap")


def background_results(decisions: DataFrame, reviews: DataFrame, keys: list[str], cadence: int, time: str = "us", split: str | None = None) -> DataFrame:
    """Per reviewed background interval: seconds, observed and scored rows, false alert rows and episodes, contiguous scored seconds.

    Exposure counts pairs of scored rows that follow each other by exactly one cadence in one split; an episode is a run of
    such neighbouring alerts.
    """
    hit = review_join(decisions, reviews, keys, time).withColumn("_split", F.col(split) if split else F.lit(0))
    scored = Window.partitionBy("review_id", F.col("alert").isNotNull()).orderBy(time)
    alarms = Window.partitionBy("review_id", F.coalesce("alert", F.lit(False))).orderBy(time)
    next_to = lambda w: F.coalesce((F.col(time) - F.lag(time).over(w) == cadence) & (F.col("_split") == F.lag("_split").over(w)), F.lit(False))
    hit = hit.withColumn("_pair", F.col("alert").isNotNull() & next_to(scored)).withColumn("_opens", F.coalesce("alert", F.lit(False)) & ~next_to(alarms))
    sums = hit.groupBy("review_id").agg(F.count("*").alias("observed_rows"), F.count("alert").alias("scored_rows"), F.count_if("alert").alias("false_alert_rows"), F.count_if("_opens").alias("false_alert_episodes"), (F.count_if("_pair") * (cadence / 1e6)).alias("contiguous_scored_seconds"))
    out = reviews.select("review_id", *keys, ((F.col("end_us") - F.col("start_us")) / 1e6).alias("reviewed_interval_seconds")).join(sums, "review_id", "left")
    return out.na.fill(0, ["observed_rows", "scored_rows", "false_alert_rows", "false_alert_episodes", "contiguous_scored_seconds"])


def reviewed_summary(events: DataFrame, background: DataFrame) -> DataFrame:
    """One row over reviewed intervals: recall, mean delay bounds, false alert rows, share, episodes, exposure, episodes per 24 hours."""
    e = events.agg(F.count("*").alias("confirmed_events"), F.count_if("detected").alias("detected_events"), F.count_if(F.col("scored_rows") == 0).alias("events_without_scored_rows"),
        F.avg(F.when(F.col("detected"), F.col("delay_min_s"))).alias("mean_delay_min_s"), F.avg(F.when(F.col("detected"), F.col("delay_max_s"))).alias("mean_delay_max_s"))
    b = background.agg(F.count("*").alias("background_intervals"), F.sum("scored_rows").alias("background_scored_rows"), F.sum("false_alert_rows").alias("false_alert_rows"), F.sum("false_alert_episodes").alias("false_alert_episodes"), F.sum("contiguous_scored_seconds").alias("exposure_s"))
    over = lambda a, n: a / F.when(n != 0, n)
    out = e.crossJoin(b).withColumn("event_recall", over(F.col("detected_events"), F.col("confirmed_events"))).withColumn("false_alert_fraction", over(F.col("false_alert_rows"), F.col("background_scored_rows")))
    return out.withColumn("episodes_per_24h", over(F.col("false_alert_episodes") * 86_400.0, F.col("exposure_s")))


def unknown_rows(decisions: DataFrame, reviews: DataFrame, keys: list[str], time: str = "us") -> DataFrame:
    """Rows and alerts inside and outside of accepted reviews; what is outside stays unknown, never normal."""
    inside = review_join(decisions, reviews.select(*keys, "start_us", "end_us"), keys, time, how="left_semi").agg(F.count("*").alias("reviewed_rows"), F.count_if("alert").alias("reviewed_alerts"))
    every = decisions.agg(F.count("*").alias("rows"), F.count_if("alert").alias("alerts"))
    return every.crossJoin(inside).select("rows", "reviewed_rows", (F.col("rows") - F.col("reviewed_rows")).alias("unknown_rows"), (F.col("alerts") - F.col("reviewed_alerts")).alias("unknown_alerts"))


def single_signal_baselines(long: DataFrame, thresholds: DataFrame, reviews: DataFrame, keys: list[str], time: str = "us") -> DataFrame:
    """Each signal as a detector of its own against the same reviewed events: events found, alert rows in and outside of them."""
    flags = long.join(F.broadcast(thresholds), ["channel", "signal"]).select(*keys, time, "signal", (F.col("value") > F.col("threshold")).alias("alert"))
    hit = review_join(flags, reviews, keys, time).where("alert").groupBy("signal").agg(F.count_distinct("review_id").alias("found"), F.count("*").alias("alerts_inside"))
    every = flags.groupBy("signal").agg(F.count("alert").alias("scored"), F.count_if("alert").alias("alerts"))
    return every.join(hit, "signal", "left").select("signal", "scored", "alerts", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("alerts_inside", F.lit(0)).alias("alerts_inside"))


def rolling_accepted(df: DataFrame, accepted: str, rows: int, cadence: int, keys: list[str], out: str, time: str = "us") -> DataFrame:
    """True where the last `rows` contiguous rows are all accepted; false otherwise, also where there are fewer."""
    d = seq.gap_runs(df, cadence, keys, "_run", time)
    f = Window.partitionBy(*keys, "_run").orderBy(time).rowsBetween(-(rows - 1), 0)
    return d.withColumn(out, (F.sum(F.coalesce(F.col(accepted), F.lit(False)).cast("int")).over(f) == rows)).drop("_run")


def blank_rows(df: DataFrame, flags: list[str], channels: list[str]) -> DataFrame:
    """All channels of a row are NULL where any of its flags holds."""
    bad = F.coalesce(F.greatest(*[F.coalesce(F.col(f), F.lit(False)) for f in flags], F.lit(False)), F.lit(False))
    return df.withColumns({c: F.when(~bad, F.col(c)) for c in channels})


def provider_agreement(df: DataFrame, accepted: str, rejected: str, alert: str = "alert", by: list[str] | None = None) -> DataFrame:
    """Confusion of alerts with the provider's quality marks over rows that it marked and that were scored."""
    a, bad = F.col(alert), F.coalesce(F.col(rejected), F.lit(False))
    known = df.where((F.coalesce(F.col(accepted), F.lit(False)) | bad) & a.isNotNull())
    counts = [F.count("*").alias("known"), F.count_if(a & bad).alias("rejected_alert"), F.count_if(~a & bad).alias("rejected_quiet"), F.count_if(a & ~bad).alias("accepted_alert"), F.count_if(~a & ~bad).alias("accepted_quiet")]
    return known.groupBy(*by).agg(*counts) if by else known.agg(*counts)


def lineage(df: DataFrame, ident: str, micros: int, keys: list[str], out: str, time: str = "us") -> DataFrame:
    """The id of the row exactly `micros` before: what a forecast was made from."""
    return df.withColumn(out, seq.exact_lag(ident, micros, keys, time))


def from_lineage(df: DataFrame, rows: DataFrame, context: str, ident: str, x: str, out: str) -> DataFrame:
    """The value of the row that a context id names: a persistence forecast rebuilt from ids alone."""
    return df.join(rows.select(F.col(ident).alias(context), F.col(x).alias(out)), context, "left")


def original_columns(df: DataFrame, derived: tuple[str, ...] = ("__", "scenario", "anomaly_", "is_candidate", "reason_codes", "scoring_status")) -> DataFrame:
    """Only the columns that came from the source: none whose name holds a mark of derivation."""
    return df.select(*[c for c in df.columns if not any(m in c for m in derived)])


def rolling_candidates(df: DataFrame, keys: list[str], rows: int = 1440, time: str = "us", alert: str = "alert") -> DataFrame:
    """Candidate rate over the last `rows` rows of a key, as a device with bounded memory sees it."""
    f = seq.ordered(keys, time).rowsBetween(-(rows - 1), 0)
    scored, hits = F.count(alert).over(f), F.sum(F.coalesce(F.col(alert), F.lit(False)).cast("int")).over(f)
    return df.withColumn("window_rows", F.count("*").over(f)).withColumn("window_scored", scored).withColumn("window_alerts", hits).withColumn("window_rate", hits / F.when(scored > 0, scored))


def experiment_summary(decisions: DataFrame, keys: list[str], alert: str = "alert", reasons: str = "reason_codes") -> DataFrame:
    """Per key: rows, scored, candidates, candidate share, and how often each signal was a reason (long: one row per signal, NULL for the totals)."""
    totals = decisions.groupBy(*keys).agg(F.count("*").alias("rows"), F.count(alert).alias("scored"), F.count_if(alert).alias("candidates"))
    token = F.explode(F.filter(F.split(reasons, "\\|"), lambda x: x != "")).alias("signal")
    signals = decisions.select(*keys, token).groupBy(*keys, "signal").agg(F.count("*").alias("candidates"))
    nothing = F.lit(None).cast("long")
    out = totals.select(*keys, F.lit(None).cast("string").alias("signal"), "rows", "scored", "candidates").unionByName(signals.select(*keys, "signal", nothing.alias("rows"), nothing.alias("scored"), "candidates"))
    return out.withColumn("candidate_share", F.col("candidates") / F.when(F.col("scored") > 0, F.col("scored")))


def replay_metrics(decisions: DataFrame, keys: list[str], cadence: int, time: str = "us", value: str = "v", prediction: str = "prediction") -> DataFrame:
    """One row: candidate rows, alert rows, gaps and missing values, forecast error (mean absolute and root mean square)."""
    w = seq.ordered(keys, time)
    d = decisions.withColumn("_gap", F.coalesce(F.col(time) - F.lag(time).over(w) > cadence, F.lit(False))).withColumn("_e", F.col(value) - F.col(prediction))
    return d.agg(F.count("*").alias("rows"), F.count("alert").alias("scored"), F.count_if("alert").alias("candidates"), F.count_if("_gap").alias("gaps"), F.count_if(F.col(value).isNull()).alias("missing"), F.count("_e").alias("forecasts"), F.avg(F.abs("_e")).alias("mae"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"))


def attributed_events(events: DataFrame, evidence: DataFrame, keys: list[str], limit: int = 300, time: str = "us") -> DataFrame:
    """The first `limit` events of each key by time with the signal that exceeded its threshold most inside them."""
    e = events.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("start_us"))).where(F.col("_r") <= limit).drop("_r")
    spans = e.select(*keys, "start_us", (F.col("end_us") + 1).alias("end_us"))
    hit = review_join(evidence, spans, keys, time)
    best = hit.groupBy(*keys, "start_us").agg(F.max_by("signal", F.struct("ratio", "signal")).alias("signal"), F.max("ratio").alias("peak"))
    return e.join(best, [*keys, "start_us"], "left")
