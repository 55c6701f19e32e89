"""Scans: native daily station files, hourly station CSV, benchmark series with windows, packets; and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the native daily format: 0-based fields of value and quality code, and the mark of a missing reading.
DAILY_FIELDS = {"temperature_c": (38, 39), "relative_humidity_pct": (40, 41), "pressure_hpa": (46, 47)}
DAILY_COUNT, DAILY_MISSING = 48, -9999.9
# Fixed values of the hourly CSV: channel, column, missing token.
HOURLY_FIELDS = {"temperature_c": ("TMP", "9999"), "dew_point_c": ("DEW", "9999"), "sea_level_pressure_hpa": ("SLP", "99999")}
GOOD_CODES = ("0", "1", "4", "5", "9")
SUSPECT_CODES = ("2", "3", "6", "7")


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    """Native daily files: two header lines, then 48 white-space fields. One row per line with its file, line number and a
    reject reason (NULL for good rows); malformed lines are kept and named, never dropped."""
    files = spark.read.format("binaryFile").load(path)
    lines = files.select(F.col("path").alias("source_file"), F.sha2("content", 256).alias("raw_file_sha256"), F.posexplode(F.split(F.decode("content", "US-ASCII"), "\r?\n")).alias("line", "text"))
    rows = lines.where((F.col("line") >= 2) & (F.trim("text") != "")).withColumn("f", F.split(F.trim("text"), r"\s+"))
    number = lambda i: F.get("f", F.lit(i)).try_cast("double")
    whole = lambda i: F.get("f", F.lit(i)).try_cast("int")
    day = F.try_make_timestamp(whole(0), whole(2), whole(3), whole(4), whole(5), F.lit(0.0))
    out = rows.withColumn("ts", day)
    reason = (
        F.when(F.size("f") != DAILY_COUNT, "field_count").when(F.col("ts").isNull(), "calendar").when(F.dayofyear("ts") != whole(1), "day_of_year")
    )
    out = out.withColumn("reject_reason", reason)
    for name, (value, code) in DAILY_FIELDS.items():
        x = number(value)
        out = out.withColumn(f"{name}__raw_value", x).withColumn(name, F.when(F.col("reject_reason").isNull() & (x != DAILY_MISSING) & ~F.isnan(x), x))
        out = out.withColumn(f"{name}__raw_qc", whole(code)).withColumn(f"{name}__qc_accepted", F.when(F.col(name).isNotNull(), whole(code) == 0))
    return out.withColumn("raw_row_number", F.col("line") + 1).drop("f", "text", "line")


def archive_window(df: DataFrame, start: str, end: str, stations: list[str] | None = None, time: str = "ts") -> DataFrame:
    """Rows in [start, end) of some stations: predicates reach the partition columns and the Parquet scan."""
    out = df.where((F.col(time) >= F.lit(start).cast(df.schema[time].dataType)) & (F.col(time) < F.lit(end).cast(df.schema[time].dataType)))
    return out.where(F.col("station_id").isin(stations)) if stations else out


def write_archive(df: DataFrame, path: str, time: str = "ts") -> None:
    """Station by month Parquet (zstd), sorted by time inside files; refuses to overwrite."""
    d = df.withColumn("month", F.date_format(time, "yyyy-MM"))
    d.repartition("station_id", "month").sortWithinPartitions("station_id", "month", time).write.mode("errorifexists").option("compression", "zstd").partitionBy("station_id", "month").parquet(path)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def _token(column: str, i: int) -> Column:
    return F.trim(F.get(F.split(F.col(column), ","), F.lit(i)))


def read_hourly_csv(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Hourly station CSV, all columns as strings; `value,code` fields scaled by 10. strict: only whole numbers count.

    Good codes give the value; suspect codes leave the channel NULL and move the value to `__qc_value`.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    out = raw.withColumn("source_file", F.input_file_name()).withColumn("_i", F.monotonically_increasing_id())
    out = out.withColumn("source_row", F.row_number().over(Window.partitionBy("source_file").orderBy("_i"))).drop("_i")
    out = out.withColumn("ts", F.try_to_timestamp("DATE", F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    for name, (column, missing) in HOURLY_FIELDS.items():
        if column not in raw.columns:
            continue
        token, code = _token(column, 0), _token(column, 1)
        plain = token.rlike(r"^[+-]?\d+$") if strict else F.lit(True)
        value = F.when(plain & (F.regexp_replace(token, r"^[+-]", "") != missing), token.try_cast("double") / 10)
        out = out.withColumn(f"{name}__raw", F.col(column)).withColumn(name, F.when(code.isin(*GOOD_CODES), value)).withColumn(f"{name}__qc_value", F.when(code.isin(*SUSPECT_CODES), value)).withColumn(f"{name}__qc_anomaly", code.isin(*SUSPECT_CODES))
    return out


def qc_histogram(df: DataFrame, columns: list[str]) -> DataFrame:
    """How often each quality code occurs per column."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _token(c, 1).alias("code")) for c in columns])).alias("x")).select("x.*")
    return long.groupBy("column", "code").agg(F.count("*").alias("n"))


def read_benchmark_series(spark: SparkSession, csv_path: str, windows_path: str, name: str) -> DataFrame:
    """A (timestamp, value) series labelled 1 inside its anomaly windows, from a JSON file of name -> [[start, end], ...]."""
    series = spark.read.schema("timestamp timestamp, value double").option("header", True).csv(csv_path)
    body = spark.read.text(windows_path, wholetext=True)
    windows = body.select(F.explode(F.from_json("value", "map<string, array<array<string>>>")).alias("name", "w"))
    spans = windows.where(F.col("name") == name).select(F.explode("w").alias("w")).select(F.to_timestamp(F.col("w")[0]).alias("a"), F.to_timestamp(F.col("w")[1]).alias("b"))
    hit = series.join(F.broadcast(spans), (F.col("timestamp") >= F.col("a")) & (F.col("timestamp") <= F.col("b")), "left_semi").select("timestamp").distinct().withColumn("label", F.lit(1))
    return series.join(hit, "timestamp", "left").withColumn("label", F.coalesce("label", F.lit(0)))


def union_sources(parts: dict[str, DataFrame], role: str = "role") -> DataFrame:
    out = None
    for name, df in parts.items():
        df = df.withColumn(role, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


PACKET = "kind string, timestamp string, `group` string, temperature_c double, pressure_hpa double, relative_humidity_pct double"


def parse_packets(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON lines to packets with a reason where one is refused: bad JSON, NaN or infinity, unknown kind, no group or time."""
    p = F.from_json(value, PACKET)
    odd = F.col(value).rlike(r"(?<![\"\w])-?(NaN|Infinity)\b")
    d = lines.withColumn("p", p)
    reason = F.when(odd, "not_finite").when(F.get_json_object(value, "$").isNull(), "not_json").when(~F.coalesce(F.col("p.kind").isin("observation", "heartbeat"), F.lit(False)), "unknown_kind").when(F.coalesce(F.col("p.group"), F.lit("")) == "", "no_group").when(F.to_timestamp(F.try_to_timestamp("p.timestamp")).isNull(), "no_time")
    return d.select(F.col(value).alias("original"), "p.*", reason.alias("reject_reason"))


def admit(df: DataFrame, channels: list[str], time: str = "ts") -> DataFrame:
    """Adds reject_reason: ids must be non-empty, up to 256 characters and without a pipe, times on the minute, labels unknown."""
    reason = F.lit(None).cast("string")
    for c in ("station_id", "source"):
        x = F.coalesce(F.trim(c), F.lit(""))
        reason = F.coalesce(reason, F.when((x == "") | (F.length(c) > 256) | F.col(c).contains("|"), f"bad_{c}"))
    reason = F.coalesce(reason, F.when(F.col(time).isNull() | (F.date_trunc("minute", time) != F.col(time)), "bad_time"))
    if "label" in df.columns:
        reason = F.coalesce(reason, F.when(F.col("label").isNotNull(), "label_known"))
    out = df.withColumn("reject_reason", reason)
    for c in channels:
        x = F.col(c).cast("double")
        out = out.withColumn(c, F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x))
    return out.withColumn("group", F.concat_ws("|", "station_id", "source"))


def file_receipts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def frames_equal(a: DataFrame, b: DataFrame) -> bool:
    """Same rows with the same multiplicity."""
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def write_scored(df: DataFrame, path: str, events: DataFrame) -> None:
    df.write.mode("errorifexists").parquet(f"{path}/scored")
    events.write.mode("errorifexists").option("header", True).csv(f"{path}/candidate_events")
