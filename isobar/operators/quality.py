"""Hourly path: grids and bounded interpolation, climatology, robust scaling, quality flags, robust channel scores, ensembles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobar.functions import seq

HOUR = 3_600_000_000


def thin(df: DataFrame, keys: list[str], bucket: int, time: str = "us", tie: str | None = None) -> DataFrame:
    """The first report of each clock bucket as it stands (never a mean)."""
    b = F.floor(F.col(time) / F.lit(bucket))
    w = Window.partitionBy(*keys, "_b").orderBy(time, *([tie] if tie else []))
    return df.withColumn("_b", b).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_b", "_r")


def hourly_grid(df: DataFrame, x: str, keys: list[str], limit: int = 6, strict_gap: bool = False, time: str = "us", step: int = HOUR) -> DataFrame:
    """Every hour between a group's first and last: the hour's median, missing mask, and linear interpolation of the first
    `limit` hours of a gap (with strict_gap: only of gaps no longer than that)."""
    hourly = df.withColumn("_h", F.floor(F.col(time) / step) * step).groupBy(*keys, "_h").agg(F.percentile(x, 0.5).alias("_m"))
    span = hourly.groupBy(*keys).agg(F.min("_h").alias("_lo"), F.max("_h").alias("_hi"))
    grid = span.select(*keys, F.explode(F.sequence("_lo", "_hi", F.lit(step).cast("long"))).alias("_h"))
    g = grid.join(hourly, [*keys, "_h"], "left")
    w = seq.ordered(keys, "_h")
    past, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("_m").isNotNull(), F.col("_h"))
    g = g.withColumn("_pv", F.last("_m", True).over(past)).withColumn("_pt", F.last(at, True).over(past)).withColumn("_nv", F.first("_m", True).over(ahead)).withColumn("_nt", F.first(at, True).over(ahead))
    depth = (F.col("_h") - F.col("_pt")) / step
    near = (depth <= limit) if not strict_gap else ((F.col("_nt") - F.col("_pt")) / step - 1 <= limit)
    line = F.col("_pv") + (F.col("_nv") - F.col("_pv")) * (F.col("_h") - F.col("_pt")) / F.when(F.col("_nt") != F.col("_pt"), F.col("_nt") - F.col("_pt"))
    filled = F.coalesce("_m", F.when(near & F.col("_nv").isNotNull(), line))
    return g.select(*keys, F.col("_h").alias(time), filled.alias(x), F.col("_m").isNull().cast("double").alias(f"{x}__was_missing"))


def climatology_fit(df: DataFrame, x: str, keys: list[str], by: list[Column]) -> DataFrame:
    """Median by (keys, calendar cell), with the group's overall median for cells not seen."""
    cells = [c.alias(f"cell{i}") for i, c in enumerate(by)]
    names = [f"cell{i}" for i in range(len(by))]
    fit = df.select(*keys, *cells, F.col(x).alias("_x")).groupBy(*keys, *names).agg(F.percentile("_x", 0.5).alias("normal"))
    whole = df.groupBy(*keys).agg(F.percentile(x, 0.5).alias("overall"))
    return fit.join(whole, keys)


def climatology_residual(df: DataFrame, fit: DataFrame, x: str, keys: list[str], by: list[Column]) -> DataFrame:
    names = [f"cell{i}" for i in range(len(by))]
    overall = fit.select(*keys, "overall").distinct()
    d = df
    for n, c in zip(names, by):
        d = d.withColumn(n, c)
    d = d.join(fit.drop("overall"), [*keys, *names], "left").join(overall, keys, "left")
    return d.withColumn(f"{x}__resid", F.col(x) - F.coalesce("normal", "overall")).drop("normal", "overall", *names)


def robust_scale_fit(df: DataFrame, x: str, keys: list[str]) -> DataFrame:
    """Median and max(IQR, std / 2, 0.001); (0, 1) for groups without values."""
    p = df.groupBy(*keys).agg(F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p"), F.stddev_samp(x).alias("s"))
    return p.select(*keys, F.coalesce(F.col("p")[1], F.lit(0.0)).alias("center"), F.when(F.col("p").isNull(), 1.0).otherwise(F.greatest(F.col("p")[2] - F.col("p")[0], 0.5 * F.coalesce("s", F.lit(0.0)), F.lit(1e-3))).alias("scale"))


def robust_scale(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Columns as (x - median) / max(IQR, std / 2, 0.001) of their group; columns of only 0 and 1, and empty ones, stay as they are."""
    parts = [f for c in columns for f in (F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"{c}__p"), F.stddev_samp(c).alias(f"{c}__s"), F.coalesce(F.min(F.col(c).isin(0.0, 1.0)), F.lit(True)).alias(f"{c}__b"))]
    d = df.join(df.groupBy(*keys).agg(*parts), keys)
    for c in columns:
        p = F.col(f"{c}__p")
        scale = F.greatest(p[2] - p[0], 0.5 * F.coalesce(F.col(f"{c}__s"), F.lit(0.0)), F.lit(1e-3))
        d = d.withColumn(c, F.when(F.col(f"{c}__b"), F.col(c)).otherwise((F.col(c) - p[1]) / scale))
    return d.drop(*[f"{c}__{x}" for c in columns for x in "psb"])


def time_partition(df: DataFrame, fraction: float, time: str = "us") -> DataFrame:
    """Adds `first`: whether a row's time lies before the cut at this fraction of the distinct times."""
    times = df.select(time).distinct()
    n = times.count()
    if n < 2:
        return df.withColumn("first", F.lit(True))
    place = min(n - 1, max(1, int(n * fraction)))
    cut = times.orderBy(time).limit(place + 1).agg(F.max(time)).first()[0]
    return df.withColumn("first", F.col(time) < F.lit(cut))


def prune_features(df: DataFrame, columns: list[str], coverage: float = 0.5, spread: float = 1e-3) -> DataFrame:
    """One pass over all columns: coverage, deviation and whether each is kept; the best covered is kept if none would be."""
    aggs = [f for c in columns for f in (F.count(c).alias(f"{c}__n"), F.stddev_samp(c).alias(f"{c}__s"))]
    one = df.agg(F.count("*").alias("_rows"), *aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(f"{c}__n") / F.when(F.col("_rows") > 0, F.col("_rows"))).alias("coverage"), F.col(f"{c}__s").alias("deviation")) for c in columns])
    out = one.select(F.explode(rows).alias("r")).select("r.*").withColumn("kept", (F.col("coverage") >= coverage) & (F.coalesce("deviation", F.lit(0.0)) >= spread))
    w = Window.partitionBy()
    first = F.row_number().over(Window.orderBy(F.desc("coverage"), "feature")) == 1
    return out.withColumn("kept", F.col("kept") | (~F.max("kept").over(w) & first))


def spike(df: DataFrame, x: str, keys: list[str], factor: float = 8.0, window: int = 72, least: int = 12, time: str = "us") -> DataFrame:
    """|second difference| over `factor` times the past median of |difference| (window rows, at least `least`; else all the past)."""
    w = seq.ordered(keys, time)
    d = df.withColumn("_d", F.col(x) - F.lag(x).over(w)).withColumn("_a", F.abs("_d"))
    recent, ever = w.rowsBetween(-window, -1), w.rowsBetween(Window.unboundedPreceding, -1)
    scale = F.coalesce(F.when(F.count("_a").over(recent) >= least, F.percentile("_a", 0.5).over(recent)), F.when(F.count("_a").over(ever) >= 2, F.percentile("_a", 0.5).over(ever)))
    d = d.withColumn("_s", F.greatest(scale, F.lit(1e-3))).withColumn("_dd", F.abs(F.col("_d") - F.lag("_d").over(w)))
    return d.withColumn(f"{x}__spike", F.coalesce(F.col("_dd") > factor * F.col("_s"), F.lit(False))).drop("_d", "_a", "_s", "_dd")


def step_flag(df: DataFrame, x: str, keys: list[str], limit: float, time: str = "us") -> DataFrame:
    return df.withColumn(f"{x}__step", F.coalesce(F.abs(F.col(x) - F.lag(x).over(seq.ordered(keys, time))) > limit, F.lit(False)))


def stuck_flag(df: DataFrame, x: str, keys: list[str], least: int = 24, time: str = "us") -> DataFrame:
    """True from the `least`-th equal report of a run on; a missing report ends the run."""
    w = seq.ordered(keys, time)
    d = df.withColumn("_eq", F.coalesce(F.col(x) == F.lag(x).over(w), F.lit(False)))
    d = seq.island(d, ~F.col("_eq"), keys, "_r", time)
    n = F.row_number().over(Window.partitionBy(*keys, "_r").orderBy(time))
    return d.withColumn(f"{x}__stuck", F.col(x).isNotNull() & (n >= least)).drop("_eq", "_r")


def zero_run_flag(df: DataFrame, x: str, keys: list[str], least: int = 3, eps: float = 1e-6, time: str = "us") -> DataFrame:
    d = seq.run_lengths(df, F.abs(F.col(x)) <= eps, keys, "_z", time)
    return d.withColumn(f"{x}__dropout", F.col("_z") >= least).drop("_z")


def qc_score(flags: dict[str, Column], hard: set[str]) -> tuple[Column, Column, Column]:
    """(any flag, any hard flag, mean of flags with hard ones weighing 2)."""
    values = {k: F.coalesce(c, F.lit(False)) for k, c in flags.items()}
    any_flag = hard_flag = F.lit(False)
    score, total = F.lit(0.0), 0.0
    for k, c in values.items():
        weight = 2.0 if k in hard else 1.0
        any_flag = any_flag | c
        hard_flag = hard_flag | c if k in hard else hard_flag
        score, total = score + F.when(c, weight).otherwise(0.0), total + weight
    return any_flag, hard_flag, score / total


def _robust_columns(df: DataFrame, x: str, resid: str, keys: list[str], time: str) -> DataFrame:
    """Steps, the deviation of 8 full rows and that of the residual over 168 rows (at least 24)."""
    w = seq.ordered(keys, time)
    d = df.withColumn("_d", F.abs(F.col(x) - F.lag(x).over(w))).withColumn("_s", seq.guarded(F.stddev_samp(x), x, w.rowsBetween(-7, 0), 8))
    return d.withColumn("_long", seq.guarded(F.stddev_samp(resid), resid, w.rowsBetween(-167, 0), 24))


def robust_fit(df: DataFrame, x: str, keys: list[str], resid: str | None = None, floor: float = 0.25, time: str = "us") -> DataFrame:
    """Per group: centre and spread of the residual, step scale, bounds of the short deviation, usual long deviation.

    Steps and deviations are learned on values (a stuck sensor stands still in its own units), levels on residuals. Groups
    with fewer than half of their values get no row.
    """
    resid = resid or x
    d = _robust_columns(df, x, resid, keys, time)
    centre = d.groupBy(*keys).agg(F.percentile(x, 0.5).alias("_raw"), F.percentile(resid, 0.5).alias("med"), (F.count(x) / F.count("*")).alias("_share"))
    d = d.join(centre.where("_share >= 0.5 and med is not null"), keys).withColumn("_a", F.abs(F.col(x) - F.col("_raw"))).withColumn("_b", F.abs(F.col(resid) - F.col("med")))
    fit = d.groupBy(*keys).agg(
        F.first("med").alias("med"), F.percentile("_a", 0.5).alias("_mad"), F.percentile("_b", F.array(F.lit(0.5), F.lit(0.95))).alias("_q"), F.percentile("_d", 0.5).alias("_step"),
        F.percentile("_s", F.array(F.lit(0.005), F.lit(0.995))).alias("_dev"), F.percentile("_long", 0.5).alias("_usual"),
    )
    step = F.coalesce(F.greatest(1.4826 * F.col("_step"), F.when(F.col("_step").isNotNull(), 1e-3)), F.lit(floor))
    sigma = F.greatest(1.4826 * F.col("_q")[0], F.col("_q")[1] / 3, F.lit(floor))
    high = F.when(F.col("_dev").isNull(), 1.0).otherwise(F.greatest(F.col("_dev")[1], 0.125 * 1.4826 * F.col("_mad"), 0.5 * step, F.lit(1e-6)))
    low = F.greatest(F.coalesce(F.col("_dev")[0], F.lit(1e-9)), F.lit(1e-9))
    usual = F.when(F.col("_usual").isNull(), sigma).otherwise(F.greatest("_usual", F.lit(1e-6)))
    return fit.select(*keys, "med", sigma.alias("sigma"), F.greatest(step, 0.25 * sigma, F.lit(0.5 * floor)).alias("sigma_d"), high.alias("std_hi"), F.greatest(0.5 * low, F.lit(1e-9)).alias("stuck"), usual.alias("std_long"))


def robust_channel_score(df: DataFrame, fit: DataFrame, x: str, keys: list[str], resid: str | None = None, time: str = "us") -> DataFrame:
    """The largest of level, step, stuckness, noisiness, clipping and gain scores; 0 where the value is missing.

    Stuckness: 3 to 7 with the run of rows whose deviation stays under its bound. Clipping: rows pinned to a rolling maximum of
    24 that has not moved for 6, as a share of 24 rows. Gain: the residual's long deviation against its usual one, either way,
    once 24 rows in a row were observed.
    """
    resid = resid or x
    w = seq.ordered(keys, time)
    d = _robust_columns(df, x, resid, keys, time).join(fit, keys)
    d = seq.run_lengths(d, F.col("_s") <= F.col("stuck"), keys, "_run", time)
    d = seq.run_lengths(d, F.col(resid).isNotNull(), keys, "_seen", time)
    level, step = F.abs(F.col(resid) - F.col("med")) / F.col("sigma"), F.col("_d") / F.col("sigma_d")
    still = F.when(F.col("_run") > 0, 3.0 + 4.0 * F.least(F.col("_run") / 48.0, F.lit(1.0)))
    noise = F.greatest(F.lit(0.0), F.col("_s") / F.col("std_hi") - 1.25)
    d = d.withColumn("_top", seq.guarded(F.max(x), x, w.rowsBetween(-23, 0), 24))
    d = d.withColumn("_move", F.abs(F.col("_top") - F.lag("_top").over(w)))
    eps = 1e-9 + 1e-3 * F.col("sigma")
    stale = seq.guarded(F.max("_move"), "_move", w.rowsBetween(-5, 0), 6) <= eps
    d = d.withColumn("_pin", F.coalesce((F.col("_top") - F.col(x) <= eps) & stale & (F.col("_s") > F.col("stuck")), F.lit(False)).cast("double"))
    share = F.coalesce(seq.guarded(F.avg("_pin"), "_pin", w.rowsBetween(-23, 0), 8), F.lit(0.0))
    clip = F.greatest((share - 0.20) / 0.15, F.lit(0.0)) * 2.0
    ratio = F.when(F.col("_seen") >= 24, F.col("_long") / F.col("std_long"))
    gain = F.greatest(F.greatest(ratio, 1.0 / F.greatest(ratio, F.lit(1e-9))) - 1.30, F.lit(0.0)) * 1.5
    zero = F.lit(0.0)
    parts = [F.coalesce(c, zero) for c in (level, step, still, noise, clip, F.when(ratio.isNotNull(), gain))]
    return d.withColumn(f"{x}__robust", F.when(F.col(x).isNull(), 0.0).otherwise(F.greatest(*parts))).drop("_d", "_s", "_long", "_run", "_seen", "_top", "_move", "_pin", *[c for c in fit.columns if c not in keys])


def pooled_fallback(groups: DataFrame, fit: DataFrame, keys: list[str]) -> DataFrame:
    """Every group's parameters; groups without a fit take the median of each parameter over the fitted groups."""
    names = [c for c in fit.columns if c not in keys]
    pooled = fit.agg(*[F.percentile(c, 0.5).alias(f"_{c}") for c in names])
    d = groups.select(*keys).distinct().join(fit.withColumn("_own", F.lit(True)), keys, "left").crossJoin(F.broadcast(pooled))
    return d.select(*keys, *[F.when(F.col("_own"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in names], F.coalesce("_own", F.lit(False)).alias("own"))


def normalise_fit(df: DataFrame, score: str, keys: list[str]) -> DataFrame:
    p = df.groupBy(*keys).agg(F.percentile(score, F.array(F.lit(0.5), F.lit(0.99))).alias("p"))
    return p.select(*keys, F.col("p")[0].alias("median"), F.greatest(F.col("p")[1] - F.col("p")[0], F.lit(1e-9)).alias("spread"))


def weighted_ensemble(parts: dict[str, tuple[Column, float]]) -> Column:
    """Weighted mean of component scores; a missing one counts 0 and an infinite one 1e6."""
    total = sum(w for _, w in parts.values())
    out = F.lit(0.0)
    for c, w in parts.values():
        out = out + w * F.when(c == F.lit(float("inf")), 1e6).otherwise(F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)))
    return out / total


def pattern_features(df: DataFrame, x: str, cadence: int, keys: list[str], deltas: tuple[int, ...] = (1, 5, 15, 60, 120), windows: tuple[int, ...] = (5, 30, 120), floor: float = 0.1, bounds: tuple[float, float] | None = None, longest: int = 180, time: str = "us") -> DataFrame:
    """What a bounded history tells about a value, inside contiguous runs.

    Missing mark and how far the value lies outside its bounds; differences; rows it has stood still or been missing (at most
    `longest`); mean, deviation, difference, z and coverage of the earlier rows of each window; the ratio of the shortest
    window's deviation to the longest's, and the difference of their means.
    """
    d = seq.gap_runs(df, cadence, keys, "_gap", time)
    own = [*keys, "_gap"]
    r = Window.partitionBy(*own).orderBy(time)
    d = d.withColumn(f"{x}__missing", F.col(x).isNull().cast("double"))
    if bounds:
        d = d.withColumn(f"{x}__range_excess", F.when(F.col(x).isNotNull(), F.greatest(bounds[0] - F.col(x), F.col(x) - bounds[1], F.lit(0.0))))
    for k in deltas:
        d = d.withColumn(f"{x}__delta{k}", F.col(x) - F.lag(x, k).over(r))
    d = seq.run_lengths(d.withColumn("_same", F.col(x) == F.lag(x).over(r)), F.col("_same"), own, "_n", time)
    d = d.withColumn(f"{x}__repeat", F.when(F.col(x).isNotNull(), F.least("_n", F.lit(longest)))).drop("_n", "_same")
    d = seq.run_lengths(d, F.col(x).isNull(), own, "_n", time)
    d = d.withColumn(f"{x}__absent", F.least("_n", F.lit(longest))).drop("_n")
    for k in windows:
        past = r.rowsBetween(-k, -1)
        least = max(2, k // 2)
        d = d.withColumn(f"{x}__mean{k}", seq.guarded(F.avg(x), x, past, least)).withColumn(f"{x}__std{k}", seq.guarded(F.stddev_pop(x), x, past, least))
        d = d.withColumn(f"{x}__deviation{k}", F.col(x) - F.col(f"{x}__mean{k}")).withColumn(f"{x}__z{k}", F.col(f"{x}__deviation{k}") / F.greatest(F.col(f"{x}__std{k}"), F.lit(floor))).withColumn(f"{x}__coverage{k}", F.count(x).over(past) / F.lit(float(k)))
    if len(windows) > 1:
        a, b = windows[0], windows[-1]
        d = d.withColumn(f"{x}__variability", F.col(f"{x}__std{a}") / F.greatest(F.col(f"{x}__std{b}"), F.lit(floor))).withColumn(f"{x}__mean_shift", F.col(f"{x}__mean{a}") - F.col(f"{x}__mean{b}"))
    return d.drop("_gap")


def guarded_corr(df: DataFrame, a: str, b: str, cadence: int, keys: list[str], window: int = 30, least: int = 15, time: str = "us", out: str = "corr") -> DataFrame:
    """Correlation of first differences over the last rows of a run, where there are enough of them and both vary."""
    d = seq.gap_runs(df, cadence, keys, "_run", time)
    r = Window.partitionBy(*keys, "_run").orderBy(time)
    d = d.withColumn("_a", F.col(a) - F.lag(a).over(r)).withColumn("_b", F.col(b) - F.lag(b).over(r))
    f = r.rowsBetween(-(window - 1), 0)
    ok = (F.count(F.col("_a") + F.col("_b")).over(f) >= least) & (F.max("_a").over(f) - F.min("_a").over(f) > 1e-8) & (F.max("_b").over(f) - F.min("_b").over(f) > 1e-8)
    return d.withColumn(out, F.when(ok, F.greatest(F.least(F.covar_pop("_a", "_b").over(f) / F.nullif(F.stddev_pop("_a").over(f) * F.stddev_pop("_b").over(f), F.lit(0.0)), F.lit(1.0)), F.lit(-1.0)))).drop("_run", "_a", "_b")
