"""python -m isobar.cli SERIES.csv OUT: decisions and candidate events for a CSV of group, timestamp and channels."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from isobar.operators import inference
from isobar.operators.detect import ObservationSpec


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("series")
    p.add_argument("out")
    p.add_argument("--channels", default="temperature_c,pressure_hpa,relative_humidity_pct")
    p.add_argument("--leading", type=int, default=720, help="rows of a group that give its thresholds")
    p.add_argument("--cadence-seconds", type=int, default=60)
    p.add_argument("--quantile", type=float, default=0.995)
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    raw = spark.read.option("header", True).csv(a.series)
    channels = tuple(c for c in a.channels.split(",") if c in raw.columns)
    if "group" not in raw.columns or "timestamp" not in raw.columns or not channels:
        raise SystemExit("the file needs the columns group and timestamp and at least one channel")
    df = raw.select(F.col("group").alias("g"), F.unix_micros(F.to_timestamp("timestamp")).alias("us"), *[F.col(c).try_cast("double").alias(c) for c in channels])
    spec = ObservationSpec(channels=channels, cadence=a.cadence_seconds * 1_000_000)
    decisions, events = inference.infer(df, spec, a.leading, a.quantile)
    decisions.write.mode("errorifexists").parquet(f"{a.out}/decisions")
    events.write.mode("errorifexists").option("header", True).csv(f"{a.out}/candidate_events")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
