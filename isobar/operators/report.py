"""Explanations, partitions, trends and window reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobar.functions import seq
from isobar.operators import detect, network


def scenario_partition(station: Column, ts: Column, held_out: list[str]) -> Column:
    """fit, selection, calibration, test_temporal or test_station by station and month of a year; NULL elsewhere."""
    month = F.month(ts)
    return F.when(station.isin(held_out), F.when(month == 2, "test_station")).otherwise(F.when(month == 2, "test_temporal").when(month <= 8, "fit").when(month <= 10, "selection").when(month <= 12, "calibration"))


def channel_attribution(df: DataFrame, keys: list[str], channel: str, z: str) -> DataFrame:
    """Each channel's share of the summed median |z| of a window."""
    m = df.groupBy(*keys, channel).agg(F.percentile(F.abs(z), 0.5).alias("median_z"))
    total = F.sum("median_z").over(Window.partitionBy(*keys))
    return m.withColumn("share", F.when(total > 0, F.col("median_z") / total).otherwise(0.0))


def component_support(df: DataFrame, keys: list[str], weights: dict[str, float]) -> DataFrame:
    """Mean score of each component times its weight, one row per component."""
    means = df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in weights])
    rows = F.array(*[F.struct(F.lit(c).alias("component"), (F.coalesce(F.col(c), F.lit(0.0)) * w).alias("support")) for c, w in weights.items()])
    return means.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def reason_sentence(channel: Column, share: Column, kind: Column) -> Column:
    return F.format_string("%s deviates (%.0f%% of the evidence), pattern: %s", channel, share * 100, kind)


def ablation(df: DataFrame, components: dict[str, float], y: str, threshold: float) -> DataFrame:
    """F1 of the weighted score with all components and with each one left out, in one pass."""
    cases: list[tuple[str, list[str]]] = [("none", list(components))] + [(c, [x for x in components if x != c]) for c in components]
    aggs = []
    for name, used in cases:
        total = sum(components[c] for c in used) or 1.0
        score = F.lit(0.0)
        for c in used:
            score = score + components[c] * F.coalesce(F.col(c), F.lit(0.0))
        hit = score / total >= threshold
        aggs += [F.count_if(hit & (F.col(y) == 1)).alias(f"{name}_tp"), F.count_if(hit).alias(f"{name}_n")]
    one = df.where(F.col(y).isNotNull()).agg(F.count_if(F.col(y) == 1).alias("_pos"), *aggs)
    rows = F.array(*[F.struct(F.lit(n).alias("left_out"), (2.0 * F.col(f"{n}_tp") / F.nullif((F.col(f"{n}_n") + F.col("_pos")).cast("double"), F.lit(0.0))).alias("f1")) for n, _ in cases])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def health_trend(df: DataFrame, key: str, score: str, threshold: float, time: str = "us", halflife: float = 72.0, days: int = 7, floor: float = 50.0) -> DataFrame:
    """Health index 100 exp(-clip(ewm / threshold - 1)) by day, its slope over the last days and the days until it meets `floor`."""
    d = seq.ewm(df.withColumn("_x", F.coalesce(F.col(score), F.lit(0.0))), "_x", halflife, [key], "_e", time)
    index = 100.0 * F.exp(-F.greatest(F.col("_e") / threshold - 1.0, F.lit(0.0)))
    daily = d.withColumn("_i", index).groupBy(key, F.floor(F.col(time) / 86_400_000_000).alias("day")).agg(F.avg("_i").alias("health"))
    last = F.max("day").over(Window.partitionBy(key))
    recent = daily.withColumn("_last", last).where(F.col("day") > F.col("_last") - days)
    out = recent.groupBy(key).agg(F.max_by("health", "day").alias("health"), seq.slope(F.col("health"), F.col("day").cast("double")).alias("slope"), F.count("*").alias("days"))
    return out.withColumn("days_left", F.when((F.col("slope") < -1e-6) & (F.col("days") >= 2), F.greatest((F.col("health") - floor) / -F.col("slope"), F.lit(0.0))))


def block_bootstrap(df: DataFrame, a: str, b: str, time: str = "us", block_days: int = 7, draws: int = 2000, seed: int = 0) -> DataFrame:
    """Mean paired difference a - b with a 95 % interval over draws of week blocks; rows are summed per block first."""
    block = F.floor(F.col(time) / (block_days * 86_400_000_000))
    per = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(block.alias("block")).agg(F.sum(F.col(a) - F.col(b)).alias("s"), F.count("*").alias("n"))
    blocks = per.count()
    if not blocks:
        return per.select(F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high")).limit(0)
    ranked = per.withColumn("r", F.row_number().over(Window.orderBy("block")) - 1)
    picks = df.sparkSession.range(draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(1), F.lit(blocks))).alias("k")).withColumn("r", F.pmod(F.xxhash64(F.lit(seed), "draw", "k"), F.lit(blocks)).cast("int"))
    means = picks.join(F.broadcast(ranked), "r").groupBy("draw").agg((F.sum("s") / F.sum("n")).alias("m"))
    return means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("p")).crossJoin(per.agg((F.sum("s") / F.sum("n")).alias("mean"))).select("mean", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))


class Dashboard:
    """Window queries over a scored table (g, us, v, signals, alert): what a service would answer, as DataFrames."""

    def __init__(self, scored: DataFrame, cadence: int, keys: list[str] | None = None):
        self.scored, self.cadence, self.keys = scored, cadence, keys or ["g"]

    def catalog(self) -> DataFrame:
        return self.scored.groupBy(*self.keys).agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))

    def _slice(self, group: str, start: int, end: int) -> DataFrame:
        return self.scored.where((F.col(self.keys[0]) == group) & F.col("us").between(start, end))

    def window(self, group: str, start: int, end: int) -> dict[str, DataFrame]:
        d = self._slice(group, start, end)
        return {"summary": network.window_summary(d, self.keys), "series": detect.segments(d, "v", self.cadence, self.keys), "gaps": detect.missing_intervals(d, self.cadence, self.keys), "candidates": d.where("alert").orderBy("us")}

    def events(self, group: str, limit: int = 100) -> DataFrame:
        return detect.candidate_events(self.scored.where(F.col(self.keys[0]) == group), self.keys, self.cadence, ident="us").orderBy(F.desc("max_score"), "start_us").limit(limit)

    def health(self, group: str, days: int = 7) -> DataFrame:
        d = self.scored.where(F.col(self.keys[0]) == group)
        last = d.agg(F.max("us")).first()[0] or 0
        return network.station_health(d.where(F.col("us") > last - days * 86_400_000_000), self.keys)

    def status(self) -> DataFrame:
        """What a health check answers: groups, rows, scored rows, the last time."""
        return self.scored.agg(F.count_distinct(*self.keys).alias("groups"), F.count("*").alias("rows"), F.count("alert").alias("scored"), F.max("us").alias("last_us"))

    def scenario(self, group: str, kind: str, start: int, duration: int, magnitude: float) -> dict[str, DataFrame]:
        """A deterministic scenario on a group's series: its rows, its chart points, and how many rows it changed."""
        d = network.scenario(self.scored.where(F.col(self.keys[0]) == group), kind, "v", start, duration, magnitude, self.keys)
        points = d.select("us", F.explode(F.array(F.struct(F.lit("original").alias("series"), F.col("v").alias("value")), F.struct(F.lit("scenario").alias("series"), F.col("scenario").alias("value")))).alias("p")).select("us", "p.*")
        return {"rows": d, "points": points.where("value is not null"), "summary": d.agg(F.count("*").alias("rows"), F.count_if("changed").alias("changed"))}
