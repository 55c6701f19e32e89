"""Walks over sharded archives, runs that cross shards, footers, manifests, bundles and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def with_context(df: DataFrame, shard: int, tail: int, time: str = "us") -> DataFrame:
    """Every row in its own shard (a clock block of `shard` microseconds) and, if within `tail` of its end, in the next one too.

    Adds `shard_us` and `is_context`. What looks back at most `tail` can then be computed shard by shard, in any number of
    tasks, and read off the rows that are not context.
    """
    own = (F.floor(F.col(time) / shard) * shard).cast("long")
    ahead = F.floor((F.col(time) + tail) / shard) * shard
    shards = F.sequence(own, ahead.cast("long"), F.lit(shard).cast("long"))
    return df.withColumn("shard_us", F.explode(shards)).withColumn("is_context", F.col("shard_us") != own)


def flatline_by_shard(df: DataFrame, x: str, cadence: int, keys: list[str], shard: int, out: str = "flat", time: str = "us") -> DataFrame:
    """How many steps a value has stood still, as over the whole series, but worked on shard by shard.

    Windows see one shard of one group only, so a hot group is many tasks. What a run carries over a border is found on a
    table of one row per shard: whether its first row goes on from the last row before it, whether one run fills it, and
    how long the run at its end is.
    """
    d = df.withColumn("_shard", (F.floor(F.col(time) / shard)).cast("long"))
    inside = Window.partitionBy(*keys, "_shard").orderBy(time)
    same = F.coalesce((F.col(time) - F.lag(time).over(inside) == cadence) & (F.col(x) == F.lag(x).over(inside)), F.lit(False))
    d = d.withColumn("_same", same)
    d = d.withColumn("_run", F.sum((~F.col("_same")).cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_shard", "_run").orderBy(time)) - 1)
    ends = d.groupBy(*keys, "_shard").agg(
        F.min_by(F.struct(F.col(time).alias("t"), F.col(x).alias("v")), time).alias("_first"), F.max_by(F.struct(F.col(time).alias("t"), F.col(x).alias("v")), time).alias("_last"),
        F.max_by("_n", time).alias("_tail"), (F.max("_run") == 1).alias("_one"),
    )
    o = Window.partitionBy(*keys).orderBy("_shard")
    before = F.lag("_last").over(o)
    goes_on = F.coalesce((F.col("_first.t") - before["t"] == cadence) & (F.col("_first.v") == before["v"]), F.lit(False))
    ends = ends.withColumn("_goes_on", goes_on).withColumn("_chain", F.sum((~(F.col("_goes_on") & F.col("_one"))).cast("int")).over(o.rowsBetween(Window.unboundedPreceding, 0)))
    held = F.sum(F.col("_tail") + 1).over(Window.partitionBy(*keys, "_chain").orderBy("_shard").rowsBetween(Window.unboundedPreceding, 0)) - 1  # steps that the run at a shard's end has stood
    ends = ends.withColumn("_held", held).withColumn("_carry", F.when(F.col("_goes_on"), F.lag("_held").over(o) + 1).otherwise(0))
    d = d.join(ends.select(*keys, "_shard", "_carry"), [*keys, "_shard"])
    steps = F.col("_n") + F.when(F.col("_run") == 1, F.col("_carry")).otherwise(0)
    return d.withColumn(out, F.when(F.col(x).isNotNull(), steps).cast("long")).drop("_shard", "_same", "_run", "_n", "_carry")


def footer_catalog(spark: SparkSession, path: str, column: str, by: list[str] | None = None) -> DataFrame:
    """Rows, least and largest value of a whole-number column, per partition value: from Parquet footers alone, no data page is read.

    Runs in a session of its own, with aggregates pushed to the scan; the plan shows PushedAggregation.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    session.conf.set("spark.sql.sources.useV1SourceList", "avro,csv,json,kafka,orc,text")
    df = session.read.parquet(path)
    aggs = [F.count("*").alias("n"), F.min(column).alias("least"), F.max(column).alias("largest")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """One row per Parquet file: bytes, rows, and the number of columns of the table."""
    df = spark.read.parquet(path)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).groupBy("path", "bytes").agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def check_manifest(manifest: DataFrame, receipts: DataFrame, root: str) -> DataFrame:
    """manifest (name, sha256) held against receipts (path, sha256) under a root: name, status.

    ok, changed, missing, unlisted, or escapes where a name is absolute or climbs out of the root.
    """
    name = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + root.rstrip("/").replace("file://", "") + "/", "")
    found = receipts.select(name.alias("name"), F.col("sha256").alias("_found"))
    escapes = F.col("name").rlike(r"(^/)|(^|/)\.\.(/|$)|^[A-Za-z]+:")
    d = manifest.select("name", F.col("sha256").alias("_listed")).join(found, "name", "full")
    status = F.when(F.col("_listed").isNotNull() & escapes, "escapes").when(F.col("_found").isNull(), "missing").when(F.col("_listed").isNull(), "unlisted").when(F.lower("_listed") != F.lower("_found"), "changed").otherwise("ok")
    return d.select("name", status.alias("status"))


def read_bundle(spark: SparkSession, path: str, name: str, schema: str | None = None) -> DataFrame:
    """The table `name` of a bundle folder: Parquet if it is there, else gzipped CSV with a header."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}.parquet")
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.parquet(f"{path}/{name}.parquet")
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(f"{path}/{name}.csv.gz")


def read_side_file(spark: SparkSession, path: str) -> DataFrame:
    """A JSON side file of a bundle, as one row."""
    return spark.read.option("multiLine", True).json(path)


def audit(df: DataFrame, keys: list[str], time: str, channels: dict[str, str], missing: str = "9999") -> DataFrame:
    """Per key: rows, repeated and unreadable times, and for each channel (name -> raw `value,code` column) how often it is there,
    marked missing, or malformed."""
    token = lambda c: F.trim(F.get(F.split(F.coalesce(F.col(c), F.lit("")), ","), F.lit(0)))
    counts = [F.count("*").alias("rows"), F.count_if(F.col(time).isNull()).alias("unreadable_times"), (F.count(time) - F.count_distinct(time)).alias("repeated_times")]
    for name, column in channels.items():
        t = token(column)
        gone = (t == "") | F.regexp_replace(t, "^[+-]", "").isin(missing, missing + "9")
        counts += [F.count_if(~gone & t.rlike(r"^[+-]?\d+$")).alias(f"{name}_present"), F.count_if(gone).alias(f"{name}_missing"), F.count_if(~gone & ~t.rlike(r"^[+-]?\d+$")).alias(f"{name}_malformed")]
    return df.groupBy(*keys).agg(*counts)


def replay_slice(df: DataFrame, start: int, end: int, most_rows: int = 360, longest: int = 6 * 3_600_000_000, time: str = "us") -> DataFrame:
    """The rows of [start, end) in order, for a replay: a span and a number of rows over the limits are refused, never cut."""
    if not 0 < end - start <= longest:
        raise ValueError("the span must be positive and within the limit")
    out = df.where((F.col(time) >= start) & (F.col(time) < end))
    if out.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    return out.orderBy(time)


def write_packets(df: DataFrame, path: str, kind: str = "observation") -> None:
    """Rows as JSON lines with their kind, missing values as null; refuses to overwrite."""
    df.select(F.to_json(F.struct(F.lit(kind).alias("kind"), *df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A table as CSV with a header; refuses to overwrite."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def shard_manifest(df: DataFrame, keys: list[str], columns: list[str], time: str = "us") -> DataFrame:
    """Per shard: rows, missing values of each column, first and last time, and a fingerprint of its rows that no order changes."""
    h = F.xxhash64(*keys, time, *columns)
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"{c}_missing") for c in columns], F.min(time).alias("first_us"), F.max(time).alias("last_us"), F.bit_xor(h).alias("fingerprint"), F.sum(F.pmod(h, F.lit(1_000_000_007))).alias("checksum"))
