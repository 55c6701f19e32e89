"""Peers, network consensus, corrections, health reports and deterministic scenarios."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobar.functions import physics, seq


def nearest_peers(stations: DataFrame, k: int = 4, radius_km: float = 500.0) -> DataFrame:
    """(station, lat, lon) -> station, peer, km, rank: the k nearest others within the radius.

    Stations lie in cells: bands of latitude as high as the radius, cut by longitude into cells at least as wide as the radius
    is there (one cell where a pole is near). A station meets the cells that its circle touches, so the catalogue is never
    joined with itself whole, and no peer within the radius is missed.
    """
    arc = radius_km / physics.EARTH_KM
    band_deg = max(1e-6, min(180.0, math.degrees(arc) * 1.0001))
    wide = lambda lat: F.when(F.abs(lat) + math.degrees(arc) >= 89.99, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(min(arc, math.pi / 2))) / F.cos(F.radians(lat)))))) * 1.0001
    edge = F.greatest(F.abs(F.col("_band") * band_deg), F.abs((F.col("_band") + 1) * band_deg))
    cells = F.greatest(F.lit(1.0), F.floor(360.0 / wide(F.least(edge, F.lit(90.0)))))
    east = F.pmod(F.col("lon") + 180.0, F.lit(360.0))
    s = stations.select("station", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).withColumn("_band", F.floor(F.col("lat") / band_deg)).withColumn("_east", east)
    home = s.withColumn("_cells", cells).withColumn("_cell", F.floor(F.col("_east") / (360.0 / F.col("_cells"))))
    home = home.select(F.col("station").alias("peer"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("_band").alias("_b"), F.col("_cell").alias("_c"))
    reach = s.withColumn("_reach", wide(F.col("lat"))).withColumn("_band", F.explode(F.array(F.col("_band") - 1, F.col("_band"), F.col("_band") + 1))).withColumn("_cells", cells).withColumn("_size", 360.0 / F.col("_cells"))
    low, high = F.floor((F.col("_east") - F.col("_reach")) / F.col("_size")), F.floor((F.col("_east") + F.col("_reach")) / F.col("_size"))
    touched = F.array_distinct(F.transform(F.sequence(low, F.least(high, low + F.col("_cells").cast("long"))), lambda c: F.pmod(c, F.col("_cells").cast("long"))))
    reach = reach.withColumn("_cell", F.explode(touched))
    d = reach.join(home, (F.col("_band") == F.col("_b")) & (F.col("_cell") == F.col("_c"))).where("station <> peer").withColumn("km", physics.haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))).where(F.col("km") <= radius_km)
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("station").orderBy(F.round("km", 6), "peer"))).where(F.col("rank") <= k).select("station", "peer", "km", "rank")


def buddy_scores(df: DataFrame, peers: DataFrame, x: str, time: str = "us", least_peers: int = 2) -> DataFrame:
    """|value - median of the peers' values at the same time|, divided by its robust spread per station."""
    right = df.select(F.col("station").alias("peer"), F.col(time).alias("_t"), F.col(x).alias("_x"))
    left = df.where(F.col(x).isNotNull()).join(peers.select("station", "peer"), "station")
    both = left.join(right, (left["peer"] == right["peer"]) & (F.col(time) == F.col("_t"))).where("_x is not null")
    med = both.groupBy("station", time, x).agg(F.percentile("_x", 0.5).alias("consensus"), F.count("*").alias("n_peers")).where(F.col("n_peers") >= least_peers)
    d = med.withColumn("deviation", F.abs(F.col(x) - F.col("consensus")))
    return d


def buddy_spread(deviations: DataFrame, least: int = 100) -> DataFrame:
    """Robust spread of each station's deviations: max(1.4826 MAD, q95 / 3, 0.001), for stations with enough of them."""
    med = deviations.groupBy("station").agg(F.percentile("deviation", 0.5).alias("_m"), F.count("*").alias("n")).where(F.col("n") >= least)
    d = deviations.join(med, "station")
    return d.groupBy("station").agg(F.greatest(1.4826 * F.percentile(F.abs(F.col("deviation") - F.col("_m")), 0.5), F.percentile("deviation", 0.95) / 3, F.lit(1e-3)).alias("spread"))


def scaled_buddy_scores(deviations: list[DataFrame], least: int = 100, time: str = "us") -> DataFrame:
    """Per station and time the largest over channels of deviation / spread; a station without a spread of its own takes the
    channel's median spread."""
    out = None
    for d in deviations:
        spread = buddy_spread(d, least)
        pooled = spread.agg(F.percentile("spread", 0.5).alias("_pooled"))
        one = d.join(spread, "station", "left").crossJoin(F.broadcast(pooled)).select("station", time, F.coalesce(F.col("deviation") / F.coalesce("spread", "_pooled"), F.lit(0.0)).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("station", time).agg(F.max("score").alias("score"))


def latest_snapshot(df: DataFrame, keys: list[str], x: str, time: str = "us") -> DataFrame:
    """The last non-missing value of each key and its time."""
    return df.where(F.col(x).isNotNull()).groupBy(*keys).agg(F.max_by(x, time).alias("latest"), F.max(time).alias("latest_us"))


def tail_statistics(df: DataFrame, key: str, x: str, rows: int = 30, time: str = "us", tie: str | None = None) -> DataFrame:
    """Median, deviation and range of the last `rows` values of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(time), *([F.desc(tie)] if tie else []))
    t = df.where(F.col(x).isNotNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= rows)
    return t.groupBy(key).agg(F.percentile(x, 0.5).alias("median"), F.stddev_pop(x).alias("deviation"), F.count("*").alias("n"))


def correction_proposals(df: DataFrame, key: str, x: str, rows: int = 30, time: str = "us", tie: str | None = None) -> DataFrame:
    """For each key's last value: the median of all other keys' recent values, accepted as stable when close to them.

    No key meets the others' values: leaving out one key's `rows` values moves the pool's median by no more places than that,
    so the places around the middle of the pool, of which there are about 4 x rows, hold every answer. Deviations are the
    pool's sums less the key's own.
    """
    w = Window.partitionBy(key).orderBy(F.desc(time), *([F.desc(tie)] if tie else []))
    pool = df.where(F.col(x).isNotNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= rows).select(key, F.col(x).cast("double").alias("x"), "_r")
    total = pool.agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")).first()
    n, margin = total["n"], 2 * rows + 2
    share, slice_, below = 0.0, pool, 0
    if n > 50 * margin:  # only the middle of a large pool is ordered
        share = 0.5 - margin / n - 0.002
        while share > 0:
            low, high = pool.agg(F.percentile_approx("x", [share, 1 - share], 10_000)).first()[0]
            slice_ = pool.where(F.col("x").between(low, high))
            below, inside = pool.where(F.col("x") < low).count(), slice_.count()
            if below <= n // 2 - margin and below + inside >= n // 2 + margin:
                break
            share, slice_, below = share - 0.05, pool, 0
    order = Window.orderBy("x", key, "_r")
    ranked = slice_.withColumn("_place", F.row_number().over(order) + below).where(F.col("_place").between(n // 2 - margin, n // 2 + margin))
    middle = ranked.agg(F.array_sort(F.collect_list(F.struct("_place", F.col(key).cast("string").alias("k"), "x"))).alias("_middle"))
    start = F.col("_middle")[0]["_place"]
    own = pool.groupBy(key).agg(F.max(F.when(F.col("_r") == 1, F.col("x"))).alias("value"), F.count("*").alias("m"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    inside = F.size(F.filter("_middle", lambda e: e["k"] == F.col(key).cast("string")))
    first = F.col("_middle")[0]
    lower = pool.crossJoin(F.broadcast(middle.select(first["x"].alias("_x0"), first["k"].alias("_k0")))).where("_x0 is not null")
    # a key's own values before the middle: smaller ones, and equal ones that the order puts first
    before = lower.where((F.col("x") < F.col("_x0")) | ((F.col("x") == F.col("_x0")) & (F.col(key).cast("string") < F.col("_k0")))).groupBy(key).agg(F.count("*").alias("_before"))
    d = own.join(before, key, "left").crossJoin(F.broadcast(middle)).withColumn("_left", F.lit(n) - F.col("m")).where(F.col("_left") > 0)
    rest = F.filter("_middle", lambda e: e["k"] != F.col(key).cast("string"))
    skipped = start - 1 - F.least(F.coalesce("_before", F.lit(0)), F.col("m") - inside)
    at = lambda place: F.get(F.transform(rest, lambda e: e["x"]), (place - skipped - 1).cast("int"))
    left = F.col("_left")
    proposal = (at(F.floor((left + 1) / 2)) + at(F.floor(left / 2) + 1)) / 2.0
    mean = (F.lit(total["s"]) - F.col("s")) / left
    deviation = F.sqrt(F.greatest((F.lit(total["q"]) - F.col("q")) / left - mean * mean, F.lit(0.0)))
    out = d.select(F.col(key).alias("target"), "value", proposal.alias("proposal"), deviation.alias("deviation"))
    return out.withColumn("stable", F.abs(F.col("value") - F.col("proposal")) < 0.3 * F.col("deviation") + 2)


def fuse_corrections(estimates: list[tuple[Column, Column]]) -> tuple[Column, Column]:
    """Inverse-variance mean of (estimate, variance) pairs and its confidence 1.5 / (1 + sigma), 0 to 1; missing ones are left out."""
    weights = [F.when(e.isNotNull() & v.isNotNull(), 1 / F.greatest(v, F.lit(1e-12))).otherwise(0.0) for e, v in estimates]
    total = sum(weights[1:], weights[0])
    mean = sum((F.coalesce(e, F.lit(0.0)) * w for (e, _), w in list(zip(estimates, weights))[1:]), F.coalesce(estimates[0][0], F.lit(0.0)) * weights[0])
    positive = F.when(total > 0, total)
    return mean / positive, physics.clip(1.5 / (1 + F.sqrt(1 / positive)), 0.0, 1.0)


def corrected_series(df: DataFrame, keys: list[str], normal: str, resid: str, normal_sigma: float, others: list[tuple[Column, float]], halflife: float = 12.0, time: str = "us") -> DataFrame:
    """Adds `corrected` and `confidence`: climatology plus the last trusted residual, which fades from a window's first row on by
    e^(-i / halflife) and adds its own doubt to the variance, fused with other estimates of known spread."""
    w = seq.ordered(keys, time)
    kept = F.coalesce(F.last(resid, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    d = df.withColumn("_keep", kept).withColumn("_i", F.row_number().over(w) - 1)
    first = (F.col(normal) + F.col("_keep") * F.exp(-F.col("_i") / halflife), F.lit(normal_sigma**2) + F.col("_keep") * F.col("_keep") * 0.05)
    mean, sure = fuse_corrections([first, *[(e, F.lit(s**2)) for e, s in others]])
    return d.withColumn("corrected", mean).withColumn("confidence", sure).drop("_keep", "_i")


def station_health(df: DataFrame, keys: list[str], time: str = "us", alert: str = "alert", value: str = "v", reasons: str | None = None) -> DataFrame:
    """Candidate rate and band, trend between the halves of the elapsed time, missing share, advisory."""
    span = df.groupBy(*keys).agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    d = df.join(span, keys).withColumn("_early", F.col(time) < F.col("_a") + (F.col("_b") - F.col("_a")) / 2)
    a, known = F.col(alert), F.col(alert).isNotNull()
    rate = lambda part: F.count_if(a & part) / F.nullif(F.count_if(known & part), F.lit(0))
    out = d.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_if(known).alias("scored"), F.count_if(a).alias("alerts"), rate(F.lit(True)).alias("rate"), rate(F.col("_early")).alias("early"), rate(~F.col("_early")).alias("late"), (F.count_if(F.col(value).isNull()) / F.count("*")).alias("missing"), ((F.max("_b") - F.max("_a")) / 60e6).alias("span_min"))
    out = out.withColumn("health", F.when(F.col("rate").isNull(), "unknown").when(F.col("rate") <= 0.02, "healthy").when(F.col("rate") <= 0.08, "watch").when(F.col("rate") <= 0.25, "degraded").otherwise("critical"))
    out = out.withColumn("trend", F.when(F.col("early").isNull() | F.col("late").isNull(), "unknown").when(F.col("late") > F.col("early") * 1.5 + 0.005, "worsening").when(F.col("early") > F.col("late") * 1.5 + 0.005, "improving").otherwise("stable"))
    adequate = (F.col("scored") >= 30) & (F.col("span_min") >= 60)
    coverage = F.col("scored") / F.nullif(F.col("rows"), F.lit(0))
    persistent = F.least("early", "late") > 0.02
    bad = F.col("health").isin("degraded", "critical")
    advisory = (
        F.when(~adequate, F.when((F.col("rows") > 0) & (F.col("scored") == 0), "insufficient_history:check_feed_now").when(F.col("alerts") > 0, "insufficient_history:review_candidates").otherwise("insufficient_history:collect_more_history"))
        .when((coverage < 0.5) | (F.col("missing") > 0.25), "insufficient_coverage:check_feed_now")
        .when(F.col("trend") == "worsening", "rising:review_now")
        .when(F.coalesce(persistent, F.lit(False)) | bad, F.concat(F.when(F.coalesce(persistent, F.lit(False)), "persistent").otherwise("elevated"), F.when(F.col("health") == "critical", ":review_now").otherwise(":next_service")))
        .when(F.col("alerts") > 0, "isolated:next_service")
        .otherwise("low:routine_observation")
    )
    return out.withColumn("advisory", advisory)


def dominant_reason(df: DataFrame, keys: list[str], reasons: str, time: str = "us") -> DataFrame:
    """The most frequent token of pipe-joined reason codes; the first seen wins ties."""
    t = df.where(F.col(reasons) != "").select(*keys, time, F.posexplode(F.split(reasons, "\\|")).alias("_p", "reason"))
    n = t.groupBy(*keys, "reason").agg(F.count("*").alias("n"), F.min(F.struct(time, "_p")).alias("_first"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "_first")
    return n.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*keys, "reason", "n")


def window_summary(df: DataFrame, keys: list[str], alert: str = "alert", value: str = "v") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("records"), F.count_if(F.col(alert)).alias("candidates"), F.count_if(F.col(alert).isNotNull()).alias("scored"), F.count_if(F.col(value).isNull()).alias("missing"))


def scenario(df: DataFrame, kind: str, x: str, start: int, duration: int, magnitude: float, keys: list[str], time: str = "us") -> DataFrame:
    """A deterministic spike, drift, stuck value or dropout on [start, start + duration); `changed` marks rows that differ."""
    inside = (F.col(time) >= start) & (F.col(time) < start + duration)
    live = F.when(inside & F.col(x).isNotNull(), F.col(time))
    first = F.min(live).over(Window.partitionBy(*keys))
    d = df.withColumn("_f", first)
    if kind == "spike":
        new = F.when(F.col(time) == F.col("_f"), F.col(x) + magnitude).otherwise(F.col(x))
    elif kind == "drift":
        new = F.when(inside, F.col(x) + magnitude * (F.col(time) - start) / F.lit(float(duration))).otherwise(F.col(x))
    elif kind == "stuck":
        latch = F.min_by(x, F.when(F.col(x).isNotNull() & inside, F.col(time))).over(Window.partitionBy(*keys))
        new = F.when(inside, latch).otherwise(F.col(x))
    elif kind == "dropout":
        new = F.when(~inside, F.col(x))
    else:
        new = F.col(x)
    d = d.withColumn("scenario", new)
    return d.withColumn("changed", ~F.col("scenario").eqNullSafe(F.col(x))).drop("_f")


def source_windows(df: DataFrame, keys: list[str], width: int, rows: int, time: str = "us") -> DataFrame:
    """Disjoint clock blocks that are complete."""
    b = (F.floor(F.col(time) / width) * width).alias("window_us")
    return df.groupBy(*keys, b).agg(F.count("*").alias("n")).where(F.col("n") >= rows)


def _in_buckets(events: DataFrame, bucket: int) -> DataFrame:
    """Closed intervals, once for each clock bucket that they touch."""
    return events.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_us") / bucket), F.floor(F.greatest("start_us", "end_us") / bucket))))


def paint_labels(df: DataFrame, events: DataFrame, keys: list[str], time: str = "us", bucket: int = 86_400_000_000) -> DataFrame:
    """1 where any closed interval of the key covers the row, with the last such event's kind (by event_order).

    Distinct times meet the intervals in time buckets; their labels then go to all rows of that time.
    """
    e = _in_buckets(events.select(*[F.col(k).alias(f"_{k}") for k in keys], "start_us", "end_us", "fault", "event_order"), bucket)
    on = (F.floor(F.col(time) / bucket) == F.col("_b")) & (F.col(time) >= F.col("start_us")) & (F.col(time) <= F.col("end_us"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    hit = df.select(*keys, time).distinct().join(e, on).groupBy(*keys, time).agg(F.max_by("fault", "event_order").alias("fault"))
    return df.join(hit.withColumn("label", F.lit(1)), [*keys, time], "left").withColumn("label", F.coalesce("label", F.lit(0))).select(*df.columns, "label", "fault")


def interval_hits(df: DataFrame, events: DataFrame, keys: list[str], p: str, time: str = "us", bucket: int = 86_400_000_000) -> DataFrame:
    """Per event: rows inside the closed interval and rows predicted there; rows and events meet in time buckets."""
    names = events.columns
    e = events.withColumn("_e", F.row_number().over(Window.partitionBy(*names).orderBy(*names)))  # repeated events are told apart
    d = df.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(time).alias("_t"), F.col(p).alias("_p"))
    on = (F.floor(F.col("_t") / bucket) == F.col("_b")) & (F.col("_t") >= F.col("start_us")) & (F.col("_t") <= F.col("end_us"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    sums = _in_buckets(e, bucket).join(d, on).groupBy(*names, "_e").agg(F.count("*").alias("rows"), F.count_if(F.col("_p") == 1).alias("hits"))
    return e.join(sums, [*names, "_e"], "left").select(*names, F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("hits", F.lit(0)).alias("hits"))


def watchdog(df: DataFrame, x: str, cadence: int, keys: list[str], step_limit: float, flat_seconds: float = 600.0, grace: int = 0, time: str = "us") -> DataFrame:
    """Constant-state rules in batch: step between adjacent rows, seconds a value has stood still, skipped slots."""
    w = seq.ordered(keys, time)
    gap = F.col(time) - F.lag(time).over(w)
    adjacent = F.coalesce(F.abs(gap - cadence) <= grace, F.lit(False))
    d = df.withColumn("_adj", adjacent).withColumn("skipped", F.coalesce(F.greatest(F.floor(gap / cadence) - 1, F.lit(0)), F.lit(0)).cast("long"))
    d = d.withColumn("step_alert", F.coalesce(F.col("_adj") & (F.abs(F.col(x) - F.lag(x).over(w)) > step_limit), F.lit(False)))
    d = seq.island(d, ~(F.col("_adj") & F.coalesce(F.col(x) == F.lag(x).over(w), F.lit(False))), keys, "_run", time)
    held = (F.col(time) - F.first(time).over(Window.partitionBy(*keys, "_run").orderBy(time))) / 1e6
    return d.withColumn("flat_seconds", F.when(F.col(x).isNotNull(), held)).withColumn("flat_alert", F.coalesce(F.col("flat_seconds") > flat_seconds, F.lit(False))).drop("_adj", "_run")
