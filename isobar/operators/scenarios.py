"""Synthetic interventions on source windows, repeatable from a seed by hashing, and their strict evaluation.

Everything random is drawn from SHA-256 of (seed, window, fault, variant, name), so a scenario is the same on any cluster.
No missing value is ever filled. `no_injection` means that nothing was changed, not that a row is known to be normal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The faults, and how long each lasts in rows (least, below).
FAULT_ROWS = {"spike": (1, 5), "bias": (30, 181), "drift": (90, 271), "stuck": (30, 241), "dropout": (10, 91), "noise_burst": (10, 91), "clipping": (45, 241), "scale_error": (45, 241), "sensor_swap": (30, 181)}


@dataclass(frozen=True)
class ScenarioSpec:
    """Channels with the bounds of a change's size and of a gain, the rows kept free before and after, and the clipping's past."""

    channels: tuple[str, ...]
    sizes: tuple[tuple[float, float], ...]
    gains: tuple[tuple[float, float], ...]
    rows: dict[str, tuple[int, int]]
    history: int = 180
    earliest: int = 15
    latest: int = 90
    tail: int = 120
    past: int = 120
    swap: tuple[int, int] = (0, 2)
    seed: int = 26073


def draw(spec: ScenarioSpec, fault: str, variant: int, name: str, *more: Column) -> Column:
    """A number in [0, 1) that belongs to the window and the name."""
    text = F.concat_ws("|", F.lit(str(spec.seed)), F.col("window_id"), F.lit(fault), F.lit(str(variant)), F.lit(name), *[m.cast("string") for m in more])
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("double") / float(16**12)


def windows(df: DataFrame, keys: list[str], width: int, rows: int, time: str = "us") -> DataFrame:
    """Rows of disjoint clock blocks that have all their `rows` rows: adds window_id and the row's number `i` from 0."""
    block = (F.floor(F.col(time) / width) * width).cast("long")
    d = df.withColumn("window_id", F.concat_ws(":", *keys, block.cast("string")))
    w = Window.partitionBy("window_id")
    return d.withColumn("_n", F.count("*").over(w)).where(F.col("_n") == rows).withColumn("i", F.row_number().over(w.orderBy(time)) - 1).drop("_n")


def generate(df: DataFrame, fault: str, spec: ScenarioSpec, variant: int = 0) -> DataFrame:
    """Windows (window_id, i, channels) with `scenario__<channel>`, `fault`, `modified` and the schedule (`start`, `stop`, `channel`).

    spike, bias: a shift. drift: a shift that grows as a power of the time. stuck: the value before the start. dropout: missing,
    with probability .3 in all channels. noise_burst: normal noise. clipping: held under (or over) a quantile of the past.
    scale_error: a gain or its inverse. sensor_swap: two channels exchanged where both are there.
    """
    if fault not in (*spec.rows, "no_injection"):
        raise ValueError(f"unknown fault {fault}")
    u = lambda name, *more: draw(spec, fault, variant, name, *more)
    w = Window.partitionBy("window_id")
    pick = lambda pairs, at: F.array(*[F.lit(float(p[at])) for p in pairs])[F.col("channel")]
    least, below = spec.rows.get(fault, (0, 1))
    d = df.withColumn("channel", F.floor(u("channel") * len(spec.channels)).cast("int")).withColumn("_rows", F.count("*").over(w))
    d = d.withColumn("start", (spec.history + spec.earliest + F.floor(u("start") * (spec.latest - spec.earliest))).cast("int"))
    d = d.withColumn("stop", F.least(F.col("_rows") - spec.tail, F.col("start") + (least + F.floor(u("rows") * (below - least))).cast("int")).cast("int"))
    low, high = pick(spec.sizes, 0), pick(spec.sizes, 1)
    d = d.withColumn("_size", (low + u("size") * (high - low)) * F.when(u("sign") < 0.5, -1.0).otherwise(1.0))
    i, inside = F.col("i"), (F.col("i") >= F.col("start")) & (F.col("i") < F.col("stop"))
    every = (u("all") < 0.3) if fault == "dropout" else F.lit(False)
    out = {}
    for n, c in enumerate(spec.channels):
        x, here = F.col(c).cast("double"), inside & ((F.col("channel") == n) | every)
        if fault in ("spike", "bias"):
            new = F.when(here, x + F.col("_size")).otherwise(x)
        elif fault == "drift":
            ramp = (i - F.col("start")) / F.greatest(F.col("stop") - F.col("start") - 1, F.lit(1))
            new = F.when(here, x + F.col("_size") * F.pow(ramp, 0.7 + u("power") * 1.3)).otherwise(x)
        elif fault == "stuck":
            before = F.max(F.when(i == F.col("start") - 1, x)).over(w)
            new = F.when(here & x.isNotNull() & before.isNotNull(), before).otherwise(x)
        elif fault == "dropout":
            new = F.when(~here, x)
        elif fault == "noise_burst":
            normal = F.sqrt(-2.0 * F.ln(1.0 - u("radius", i))) * F.cos(2 * 3.141592653589793 * u("angle", i))
            new = F.when(here, x + (0.25 + u("spread") * 0.4) * F.abs("_size") * normal).otherwise(x)
        elif fault == "clipping":
            past = F.when((i >= F.col("start") - spec.past) & (i < F.col("start")), x)
            upper = u("upper") < 0.5
            new = F.when(here, F.when(upper, F.least(x, F.percentile(past, 0.35).over(w))).otherwise(F.greatest(x, F.percentile(past, 0.65).over(w)))).otherwise(x)
            new = F.when(x.isNotNull(), new)
        elif fault == "scale_error":
            gain = pick(spec.gains, 0) + u("gain") * (pick(spec.gains, 1) - pick(spec.gains, 0))
            new = F.when(here, x * F.when(u("inverse") < 0.5, 1.0 / gain).otherwise(gain)).otherwise(x)
        elif fault == "sensor_swap" and n in spec.swap:
            other = F.col(spec.channels[spec.swap[1 - spec.swap.index(n)]]).cast("double")
            new = F.when(inside & x.isNotNull() & other.isNotNull(), other).otherwise(x)
        else:
            new = x
        out[f"scenario__{c}"] = new
    d = d.withColumns(out)
    changed = F.lit(False)
    for c in spec.channels:
        changed = changed | ~F.col(f"scenario__{c}").eqNullSafe(F.col(c).cast("double"))
    return d.withColumn("modified", changed).withColumn("fault", F.lit(fault)).withColumn("scenario_id", F.concat_ws("|", "window_id", F.lit(fault), F.lit(str(variant)))).withColumn("label", F.when(F.col("modified"), F.lit(fault)).otherwise("no_injection")).drop("_rows", "_size")


def generate_all(df: DataFrame, spec: ScenarioSpec, variant: int = 0) -> DataFrame:
    out = None
    for fault in (*spec.rows, "no_injection"):
        part = generate(df, fault, spec, variant)
        out = part if out is None else out.unionByName(part)
    return out


def event_log(scenarios: DataFrame, time: str = "us") -> DataFrame:
    """One row per scenario: schedule, first and last modified time, modified rows, whether anything was changed."""
    at = F.when(F.col("modified"), F.col(time))
    return scenarios.groupBy("scenario_id", "window_id", "fault").agg(F.min("start").alias("start"), F.min("stop").alias("stop"), F.min(at).alias("first_modified"), F.max(at).alias("last_modified"), F.count_if("modified").alias("modified_rows")).withColumn("applied", F.col("modified_rows") > 0)


def evaluate(scenarios: DataFrame, predicted: str = "predicted") -> DataFrame:
    """Per fault: modified rows and the share found, applied scenarios and the share found, median and p95 rows to the first hit,
    scenarios that changed nothing; for no_injection the share of rows flagged (row_recall)."""
    hit = F.coalesce(F.col(predicted), F.lit(False))
    at = lambda c: F.min(F.when(c, F.col("i")))
    per = scenarios.groupBy("scenario_id", "fault").agg(F.count("*").alias("rows"), F.count_if("modified").alias("changed"), F.count_if(F.col("modified") & hit).alias("hits"), F.count_if(hit).alias("flags"), (at(F.col("modified") & hit) - at(F.col("modified"))).alias("delay"))
    applied, clean = F.col("changed") > 0, F.col("fault") == "no_injection"
    out = per.groupBy("fault").agg(
        F.sum("changed").alias("modified_rows"), F.sum(F.when(clean, F.col("flags")).otherwise(F.col("hits"))).alias("_hits"), F.sum(F.when(clean, F.col("rows")).otherwise(F.col("changed"))).alias("_of"), F.count_if(applied).alias("events"),
        F.count_if(F.col("hits") > 0).alias("detected"), F.count_if(~applied).alias("not_applied"), F.percentile("delay", F.array(F.lit(0.5), F.lit(0.95))).alias("_d"),
    )
    over = lambda a, b: F.col(a) / F.when(F.col(b) > 0, F.col(b))
    return out.select("fault", "modified_rows", over("_hits", "_of").alias("row_recall"), "events", "detected", over("detected", "events").alias("event_recall"), F.col("_d")[0].alias("median_delay"), F.col("_d")[1].alias("p95_delay"), "not_applied")


def partition_rows(scenarios: DataFrame, split: str, fit: str = "fit", every: int = 3) -> DataFrame:
    """Rows for learning: every third row of the fit part, and all modified rows of spikes, which are too short to thin."""
    keep = (F.col(split) != fit) | (F.col("i") % every == 0) | (F.col("modified") & (F.col("fault") == "spike"))
    return scenarios.where(keep)


def feed(df: DataFrame, keys: list[str], warm_up: int = 180, offsets: tuple[int, ...] = (8, 12, 25), shift: float = 5.0, x: str = "v", time: str = "us") -> DataFrame:
    """A demonstration feed of each key: `warm_up` untouched rows, then one-row shifts at fixed offsets after them; `altered` marks these."""
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(time)) - 1
    d = df.withColumn("i", i).withColumn("altered", (F.col("i") - warm_up).isin(*offsets) & F.col(x).isNotNull())
    return d.withColumn("feed", F.when(F.col("altered"), F.col(x) + shift).otherwise(F.col(x))).withColumn("phase", F.when(F.col("i") < warm_up, "warm_up").otherwise("live"))


def export_rows(scenarios: DataFrame, channels: tuple[str, ...], time: str = "us") -> DataFrame:
    """What a scenario file holds: original columns, scenario columns, label and ids."""
    return scenarios.select("scenario_id", "window_id", time, "i", *channels, *[f"scenario__{c}" for c in channels], "label", "modified")


def write_scenarios(scenarios: DataFrame, path: str, channels: tuple[str, ...]) -> None:
    """One folder per fault, Parquet; refuses to overwrite."""
    export_rows(scenarios, channels).withColumn("fault", F.element_at(F.split("scenario_id", "\\|"), -2)).write.mode("errorifexists").partitionBy("fault").parquet(path)


def chart_points(scenarios: DataFrame, channel: str, time: str = "us") -> DataFrame:
    """Long points of a chart: original and scenario series of a channel."""
    return scenarios.select("scenario_id", time, F.explode(F.array(F.struct(F.lit("original").alias("series"), F.col(channel).cast("double").alias("value")), F.struct(F.lit("scenario").alias("series"), F.col(f"scenario__{channel}").alias("value")))).alias("p")).select("scenario_id", time, "p.*").where("value is not null")
