"""Replays of stored observations through the streaming detector."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.plans import catalogue, modelling
from isobar.streaming.detector import detect_stream
from isobar.streaming.live import LiveSpec, admit_packets, live_stream


def _scratch(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/replay-{uuid.uuid4().hex}"


def _through(spark: SparkSession, frame: DataFrame, batches: int, transform) -> DataFrame:
    """Writes frame as time-ordered drops, streams them in as many micro-batches, returns what came out."""
    root = _scratch(spark)
    bounds = frame.agg(F.min("us").alias("a"), F.max("us").alias("b")).first()
    width = max(1, (bounds["b"] - bounds["a"]) // batches + 1) if bounds["a"] is not None else 1
    frame.withColumn("drop", F.floor((F.col("us") - (bounds["a"] or 0)) / width)).write.parquet(f"{root}/staged")
    staged = spark.read.parquet(f"{root}/staged")
    for i in range(batches):
        staged.where(F.col("drop") == i).drop("drop").write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(frame.schema).parquet(f"{root}/in")
        query = transform(stream).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"{root}/out")


def replay(spark: SparkSession, frame: DataFrame, cadence: int, batches: int = 3, **params) -> DataFrame:
    """frame (g, us, v) through the five-signal detector."""
    return _through(spark, frame.select("g", "us", "v"), batches, lambda s: detect_stream(s, cadence, **params))


def stream_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = replay(spark, catalogue.Tables(spark, sf_dir).hours().select("g", "us", "v"), catalogue.HOUR, near=1, far=24, sustained=6)
    return catalogue.r6(rows.select("g", "us", *[s for s in catalogue.detect.SIGNALS]), *catalogue.detect.SIGNALS)


def live_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live detector's decisions over micro-batches are those of the batch form."""
    spec = LiveSpec(cadence=catalogue.HOUR, near=1, far=24, sustained=6, history=25, thresholds=modelling._LIMITS, domains={"v": ((2.0, "physical_domain"), (98.0, "reporting_range"))})
    d = catalogue.Tables(spark, sf_dir).hours().select("g", F.lit("observation").alias("kind"), "us", F.col("us").cast("string").alias("id"), "v")
    rows = _through(spark, d, 3, lambda s: live_stream(s, spec)).where("kind = 'observation'")
    shape = "anomaly_score double, is_candidate boolean, scoring_status string, severity string, physics_alerts array<string>, unreported_slots_before long, missing_channels array<string>"
    out = rows.select("g", "us", F.from_json("payload", shape).alias("p")).select("g", "us", "p.*")
    return catalogue.r6(out.withColumn("physics_alerts", F.array_join("physics_alerts", "|")).withColumn("missing_channels", F.array_join("missing_channels", "|")), "anomaly_score")


PACKETS = f"""with {catalogue.USERS}, r as (select kind as g, us // {catalogue.HOUR} * {catalogue.HOUR} + case when id % 97 = 0 then 1 else 0 end as us, case when id % 53 = 0 then '' else cast(id as varchar) end as ident, v, id, us // {catalogue.DAY} - case when id % 41 = 0 then 3 else 0 end as packet from eu where k % 6 = 0),
 a as (select *, count(*) over (partition by packet) as n, max(us) over (partition by g order by packet range between unbounded preceding and 1 preceding) as earlier, count(*) over (partition by g, packet, us) > 1 and row_number() over (partition by g, packet, us order by us) > 1 as same from r),
 b as (select *, case when us % {catalogue.HOUR} <> 0 then 'misaligned' when ident = '' then 'missing_id' when n > 360 then 'too_many_rows' when same or coalesce(us <= earlier, false) then 'late_or_repeated' end as own from a)
 select packet, count(*) as rows, coalesce(min(own), 'accepted') as reason from b group by 1"""


def packet_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = catalogue.Tables(spark, sf_dir).users().where("k % 6 = 0")
    hour, i = F.lit(catalogue.HOUR), F.col("id")
    d = d.select(F.col("kind").alias("g"), (F.floor(F.col("us") / hour) * hour + F.when(i % 97 == 0, 1).otherwise(0)).alias("hour_us"), F.when(i % 53 == 0, "").otherwise(i.cast("string")).alias("ident"), "v", (F.floor(F.col("us") / catalogue.DAY) - F.when(i % 41 == 0, 3).otherwise(0)).alias("packet"))
    checked = admit_packets(d.withColumnRenamed("hour_us", "us"), "packet", ["g"], catalogue.HOUR, "ident")
    return checked.groupBy("packet").agg(F.count("*").alias("rows"), F.coalesce(F.min("reject_reason"), F.lit("accepted")).alias("reason"))


QUERIES = {"stream_parity": stream_parity, "live_parity": live_parity, "packet_admission": packet_admission}
ORACLES = {"stream_parity": catalogue.ORACLES["five_signals"], "live_parity": catalogue.ORACLES["live_decisions"], "packet_admission": PACKETS}
