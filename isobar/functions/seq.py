"""Sequence expressions over keyed, time-ordered rows: exact-time lags, gap islands, guarded rolling statistics, folds.

Every window is partitioned by the group (plus an island id), so all expressions of a group share one exchange and one sort.
Missing values are NULL, never NaN, and no row is ever invented.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def clean(x: Column) -> Column:
    """NaN and infinities become NULL."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def ordered(keys: list[str], time: str = "us") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(time)


def exact_lag(x: str, micros: int, keys: list[str], time: str = "us") -> Column:
    """The value exactly `micros` before; NULL when there is no such row (never the nearest one)."""
    return F.first(F.col(x)).over(ordered(keys, time).rangeBetween(-micros, -micros))


def contiguous(cadence: int, keys: list[str], time: str = "us") -> Column:
    """True where the previous row of the group is exactly one cadence earlier."""
    return F.coalesce(F.col(time) - F.lag(time).over(ordered(keys, time)) == F.lit(cadence), F.lit(False))


def island(df: DataFrame, starts: Column, keys: list[str], out: str, time: str = "us") -> DataFrame:
    """Numbers runs: a row where `starts` holds opens a new one."""
    df = df.withColumn("_island", starts.cast("int"))
    return df.withColumn(out, F.sum("_island").over(ordered(keys, time).rowsBetween(Window.unboundedPreceding, 0))).drop("_island")


def gap_runs(df: DataFrame, cadence: int, keys: list[str], out: str = "run", time: str = "us") -> DataFrame:
    return island(df, ~contiguous(cadence, keys, time), keys, out, time)


def guarded(agg: Column, x: str, frame: WindowSpec, least: int) -> Column:
    """A rolling statistic that is NULL unless the frame holds `least` values."""
    return F.when(F.count(x).over(frame) >= least, agg.over(frame))


def slope(y: Column, x: Column) -> Column:
    """Least-squares slope as an aggregate; NULL where x does not vary (the built-in one divides by zero under ANSI rules)."""
    return F.covar_pop(y, x) / F.nullif(F.var_pop(F.when(y.isNotNull(), x)), F.lit(0.0))


def correlation(a: Column, b: Column) -> Column:
    """Correlation as an aggregate; NULL where either side does not vary."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b)), F.lit(0.0))


def flatline(df: DataFrame, x: str, cadence: int, keys: list[str], out: str, time: str = "us", accepted: str | None = None) -> DataFrame:
    """Steps that a value has stood still: 0 after a change, gap or missing value, NULL where missing.

    With `accepted`, out + `__ok` tells whether all rows of the run so far were accepted.
    """
    w = ordered(keys, time)
    same = F.coalesce((F.col(time) - F.lag(time).over(w) == cadence) & (F.col(x) == F.lag(x).over(w)), F.lit(False))
    df = island(df, ~same, keys, "_run", time)
    run = Window.partitionBy(*keys, "_run").orderBy(time)
    df = df.withColumn(out, F.when(F.col(x).isNotNull(), F.row_number().over(run) - 1).cast("long"))
    if accepted:
        ok = (F.coalesce(F.col(accepted), F.lit(False)) & F.col(x).isNotNull()).cast("int")
        df = df.withColumn("_ok", ok).withColumn(out + "__ok", F.min("_ok").over(run.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("_ok")
    return df.drop("_run")


def run_lengths(df: DataFrame, holds: Column, keys: list[str], out: str, time: str = "us") -> DataFrame:
    """Length so far of the run of rows where `holds` is true; 0 elsewhere."""
    df = df.withColumn("_h", F.coalesce(holds, F.lit(False)))
    w = ordered(keys, time)
    df = island(df, ~(F.col("_h") & F.coalesce(F.lag("_h").over(w), F.lit(False))), keys, "_r", time)
    return df.withColumn(out, F.when(F.col("_h"), F.row_number().over(Window.partitionBy(*keys, "_r").orderBy(time))).otherwise(0).cast("long")).drop("_h", "_r")


def ewm_last(history: str, halflife: float) -> Column:
    """Exponentially weighted mean (no bias adjustment) of an array column in order: a fold, in the JVM."""
    alpha = 1 - 0.5 ** (1 / halflife)
    return F.expr(f"aggregate(slice({history}, 2, greatest(size({history}) - 1, 0)), {history}[0], (a, x) -> {alpha!r}D * x + {1 - alpha!r}D * a)")


def ewm(df: DataFrame, x: str, halflife: float, keys: list[str], out: str, time: str = "us", adjust: bool = False) -> DataFrame:
    """Running ewm of a group in order of time; a missing value counts 0.

    level(i) = a x(i) + (1 - a) level(i - 1), from level(0) = x(0); with adjust, the weighted mean whose weights (1 - a)^k sum
    to 1 however short the past. One exchange and one pass: rows stream through in order and only the last level is held, so
    the time is linear and the memory the same for a group of any length.
    """
    alpha = 1 - 0.5 ** (1 / halflife)
    schema = StructType([*df.schema.fields, StructField(out, DoubleType())])

    def run(batches):
        import pyarrow as pa

        group, level, weight = None, 0.0, 0.0
        for batch in batches:
            found = []
            for key, value in zip(zip(*[batch.column(k).to_pylist() for k in keys]), batch.column(x).to_pylist()):
                value = 0.0 if value is None or value != value else float(value)
                if key != group:
                    group, level, weight = key, value, 1.0
                elif adjust:
                    weight = weight * (1 - alpha) + 1.0
                    level += (value - level) / weight
                else:
                    level = alpha * value + (1 - alpha) * level
                found.append(level)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, out])

    return df.repartition(*keys).sortWithinPartitions(*keys, time).mapInArrow(run, schema)
