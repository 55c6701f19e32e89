"""Evaluation: pointwise, point-adjusted and range-wise scores, ranking metrics, threshold sweeps, calibration.

Labels are 0, 1 or NULL (unknown). Unknown rows are left out of counts and break segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobar.functions import seq


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def prf(df: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 of predictions against known labels."""
    known = df.where(F.col(y).isNotNull())
    counts = [F.count_if((F.col(y) == 1) & (F.col(p) == 1)).alias("tp"), F.count_if((F.col(y) == 0) & (F.col(p) == 1)).alias("fp"), F.count_if((F.col(y) == 1) & (F.col(p) == 0)).alias("fn"), F.count_if((F.col(y) == 0) & (F.col(p) == 0)).alias("tn")]
    out = known.groupBy(*(by or [])).agg(*counts) if by else known.agg(*counts)
    out = out.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def label_segments(df: DataFrame, keys: list[str], order: str, y: str, out: str) -> DataFrame:
    """Numbers runs of equal known label; every row of unknown label is a run of its own."""
    w = Window.partitionBy(*keys).orderBy(order)
    same = F.coalesce(F.col(y) == F.lag(y).over(w), F.lit(False))
    return seq.island(df, ~same, keys, out, order)


def point_adjust(df: DataFrame, keys: list[str], order: str, y: str = "y", p: str = "p", out: str = "adjusted") -> DataFrame:
    """A hit anywhere in a true segment counts for all of its rows."""
    df = label_segments(df, keys, order, y, "_seg")
    return df.withColumn(out, F.when(F.col(y) == 1, F.max(p).over(Window.partitionBy(*keys, "_seg"))).otherwise(F.col(p))).drop("_seg")


def range_wise(df: DataFrame, keys: list[str], order: str, y: str = "y", p: str = "p") -> DataFrame:
    """Recall: share of true segments with a hit. Precision: mean over predicted segments of their share of true rows."""
    df = df.withColumn("_p", F.when(F.col(y).isNull(), 0).otherwise(F.col(p)))
    true = label_segments(df, keys, order, y, "_t").where(F.col(y) == 1).groupBy(*keys, "_t").agg(F.max("_p").alias("hit"))
    w = Window.partitionBy(*keys).orderBy(order)
    opens = ~F.coalesce((F.col("_p") == 1) & (F.lag("_p").over(w) == 1), F.lit(False))
    pred = seq.island(df, opens, keys, "_s", order).where("_p = 1").groupBy(*keys, "_s").agg(F.avg(F.col(y).cast("double")).alias("share"))
    both = true.agg(F.count("*").alias("true_segments"), F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)).alias("recall")).crossJoin(pred.agg(F.count("*").alias("predicted_segments"), F.coalesce(F.avg("share"), F.lit(0.0)).alias("precision")))
    return both.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def detection_latency(df: DataFrame, keys: list[str], order: str, y: str = "y", p: str = "p") -> DataFrame:
    """Mean rows from a true segment's start to its first hit, over detected segments."""
    d = label_segments(df, keys, order, y, "_s").where(F.col(y) == 1)
    d = d.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "_s").orderBy(order)) - 1)
    hit = d.groupBy(*keys, "_s").agg(F.min(F.when(F.col(p) == 1, F.col("_i"))).alias("first"))
    return hit.agg(F.count("*").alias("segments"), F.count("first").alias("detected"), F.avg("first").alias("mean_latency"))


def score_blocks(df: DataFrame, y: str = "y", score: str = "score", parts: int = 64) -> DataFrame:
    """Counts of both labels per distinct score with running totals from the highest score: the base of every exact sweep.

    Rows are counted per score first. The ordered pass is dealt over `parts` ranges of scores (bounds from approximate
    quantiles; they decide only the dealing), and each range starts from the totals of the ranges above it.
    """
    b = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count("*").alias("n"))
    found = b.agg(F.percentile_approx("score", [i / parts for i in range(1, parts)], 1000)).first()[0]
    bounds = F.array(*[F.lit(float(x)) for x in sorted(set(found or []))]).cast("array<double>")
    b = b.withColumn("_p", F.size(F.filter(bounds, lambda x: x <= F.col("score"))))
    ranges = b.groupBy("_p").agg(F.sum("pos").alias("_pos"), F.sum("n").alias("_n"))
    above, whole = Window.orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    zero = F.lit(0)
    ranges = ranges.select("_p", F.coalesce(F.sum("_pos").over(above), zero).alias("_tp"), F.coalesce(F.sum("_n").over(above), zero).alias("_pred"), F.sum("_pos").over(whole).alias("positives"), F.sum("_n").over(whole).alias("rows"))
    run = Window.partitionBy("_p").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("_itp", F.sum("pos").over(run)).withColumn("_ipred", F.sum("n").over(run)).join(F.broadcast(ranges), "_p")
    return b.select("score", "pos", "n", (F.col("_itp") + F.col("_tp")).alias("tp"), (F.col("_ipred") + F.col("_pred")).alias("predicted"), "positives", "rows")


def roc_auc(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Mann-Whitney with ties counted half; NULL unless both labels occur."""
    b = score_blocks(df, y, score)
    negatives_below = (F.col("rows") - F.col("positives")) - (F.col("predicted") - F.col("tp"))
    wins = F.sum(F.col("pos") * (negatives_below + (F.col("n") - F.col("pos")) / 2.0))
    pairs = F.max("positives") * (F.max("rows") - F.max("positives"))
    return b.agg((wins / F.when(pairs > 0, pairs)).alias("roc_auc"))


def average_precision(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Sum over distinct scores of the recall gained times the precision there."""
    b = score_blocks(df, y, score)
    return b.agg(F.sum(F.col("pos") / F.when(F.col("positives") > 0, F.col("positives")) * F.col("tp") / F.col("predicted")).alias("average_precision"))


def threshold_sweep(df: DataFrame, y: str = "y", score: str = "score", floor: float = 0.35) -> DataFrame:
    """The score threshold (>=) of the largest F1, halved where precision is under `floor`; ties go to the highest."""
    b = score_blocks(df, y, score)
    f1 = 2.0 * F.col("tp") / (F.col("predicted") + F.col("positives"))
    objective = f1 * F.when(F.col("tp") / F.col("predicted") < floor, 0.5).otherwise(1.0)
    best = F.max_by(F.struct("score", "tp", "predicted", "positives", f1.alias("f1")), F.struct(objective, "score"))
    return b.agg(best.alias("b")).select(F.col("b.score").alias("threshold"), F.col("b.tp").alias("tp"), F.col("b.predicted").alias("predicted"), F.col("b.positives").alias("positives"), F.col("b.f1").alias("f1"))


def background_capped_threshold(df: DataFrame, grid: list[float] | None = None, y: str = "y", score: str = "score", cap: float = 0.02, quantiles: tuple[float, ...] = (0.95, 0.98, 0.99, 0.995, 0.999), no_alarm: bool = True) -> DataFrame:
    """Of candidate thresholds, the best by (F1, recall, lower) among those that flag at most `cap` of the label-0 rows.

    Candidates are a grid (by default every hundredth of the score range from .05 to .99), quantiles of the scores, and an
    infinite threshold that flags nothing.
    """
    known = df.where(F.col(y).isNotNull()).select(y, score)
    lo, hi = F.min(score), F.max(score)
    fixed = [lo + (hi - lo) * F.lit(k / 100) for k in range(5, 100)] if grid is None else [F.lit(float(x)) for x in grid]
    drawn = [F.percentile(score, F.lit(q)) for q in quantiles]
    every = known.agg(F.array(*fixed, *drawn, *([F.lit(float("inf"))] if no_alarm else [])).alias("t"))
    flags = known.crossJoin(F.broadcast(every.select(F.explode(F.array_distinct("t")).alias("threshold")).where("threshold is not null")))
    hit = F.col(score) >= F.col("threshold")
    per = flags.groupBy("threshold").agg(F.count_if(hit & (F.col(y) == 1)).alias("tp"), F.count_if(hit & (F.col(y) == 0)).alias("fp"), F.count_if(F.col(y) == 1).alias("positives"), F.count_if(F.col(y) == 0).alias("negatives"))
    per = per.withColumn("f1", _ratio(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("positives"))).withColumn("recall", _ratio(1.0 * F.col("tp"), F.col("positives")))
    fit = per.where(F.col("fp") <= cap * F.col("negatives"))
    return fit.agg(F.max_by(F.struct("threshold", "f1", "recall"), F.struct("f1", "recall", -F.col("threshold"))).alias("b")).select("b.*")


def quantile_grid(df: DataFrame, quantiles: list[float], y: str = "y", score: str = "score", floor: float = 0.35) -> DataFrame:
    """F1 (halved under the precision floor) at each quantile of the scores."""
    known = df.where(F.col(y).isNotNull())
    grid = known.agg(F.percentile(score, F.array(*map(F.lit, quantiles))).alias("t")).select(F.posexplode("t").alias("i", "threshold"))
    hit = F.col(score) >= F.col("threshold")
    per = known.crossJoin(F.broadcast(grid)).groupBy("i", "threshold").agg(F.count_if(hit & (F.col(y) == 1)).alias("tp"), F.count_if(hit).alias("predicted"), F.count_if(F.col(y) == 1).alias("positives"))
    f1 = 2.0 * F.col("tp") / (F.col("predicted") + F.col("positives"))
    return per.withColumn("objective", f1 * F.when(_ratio(F.col("tp") * 1.0, F.col("predicted")) < floor, 0.5).otherwise(1.0))


def quantile_objective(df: DataFrame, keys: list[str], order: str, quantiles: list[float], strict: float = 0.7, floor: float = 0.35, y: str = "y", score: str = "score") -> DataFrame:
    """At each quantile of the scores: strict x F1 + (1 - strict) x point-adjusted F1, halved under the precision floor.

    Point-adjusted: a hit anywhere in a true segment counts for all of its rows. Segments are found once; per segment only its
    largest score is needed.
    """
    known = df.where(F.col(y).isNotNull() & F.col(score).isNotNull())
    grid = known.agg(F.percentile(score, F.array(*map(F.lit, quantiles))).alias("t")).select(F.posexplode("t").alias("i", "threshold"))
    true = label_segments(df, keys, order, y, "_seg").where(F.col(y) == 1).groupBy(*keys, "_seg").agg(F.count("*").alias("rows"), F.max(score).alias("top"))
    rows = known.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count("*").alias("n")).crossJoin(F.broadcast(grid))
    hit = F.col("s") >= F.col("threshold")
    per = rows.groupBy("i", "threshold").agg(F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("predicted"), F.sum("pos").alias("positives"))
    whole = true.crossJoin(F.broadcast(grid)).where(F.col("top") >= F.col("threshold")).groupBy("i").agg(F.sum("rows").alias("adjusted"))
    d = per.join(whole, "i", "left").withColumn("adjusted", F.coalesce("adjusted", F.lit(0)))
    f1 = _ratio(2.0 * F.col("tp"), F.col("predicted") + F.col("positives"))
    soft = _ratio(2.0 * F.col("adjusted"), F.col("adjusted") + (F.col("predicted") - F.col("tp")) + F.col("positives"))
    objective = (strict * f1 + (1 - strict) * soft) * F.when(_ratio(1.0 * F.col("tp"), F.col("predicted")) < floor, 0.5).otherwise(1.0)
    return d.select("i", "threshold", f1.alias("f1"), soft.alias("adjusted_f1"), objective.alias("objective"))


def quantile_threshold(df: DataFrame, score: str, q: float, keys: list[str]) -> DataFrame:
    """The q-quantile of each group's scores; where all scores are the same, the next larger number, so that none exceeds it."""
    one = df.where(F.col(score).isNotNull()).groupBy(*keys).agg(F.percentile(score, q).alias("t"), F.min(score).alias("lo"), F.max(score).alias("hi"), F.count("*").alias("n"))
    up = F.expr("cast(java_method('java.lang.Math', 'nextUp', hi) as double)")
    return one.select(*keys, F.when(F.col("lo") == F.col("hi"), up).otherwise(F.col("t")).alias("threshold"), "n")


def group_report(df: DataFrame, keys: list[str], order: str, y: str = "y", p: str = "p") -> DataFrame:
    """Strict and point-adjusted scores of every group and pooled over all (keys NULL); no event reaches over a group's end."""
    d = point_adjust(df, keys, order, y, p).where(F.col(y).isNotNull())
    c = lambda a, b, v: F.count_if((F.col(y) == a) & (F.col(v) == b))
    sums = d.groupBy(*keys).agg(F.count("*").alias("n"), c(1, 1, p).alias("tp"), c(0, 1, p).alias("fp"), c(1, 0, p).alias("fn"), c(1, 1, "adjusted").alias("atp"), c(1, 0, "adjusted").alias("afn"))
    own = sums.select(*[F.col(k).cast("string").alias(k) for k in keys], *sums.columns[len(keys) :])
    pooled = sums.agg(*[F.sum(x).alias(x) for x in sums.columns[len(keys) :]]).select(*[F.lit(None).cast("string").alias(k) for k in keys], *sums.columns[len(keys) :])
    out = own.unionByName(pooled)
    return out.select(*keys, "n", "tp", "fp", "fn", _ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), _ratio(2.0 * F.col("atp"), 2 * F.col("atp") + F.col("fp") + F.col("afn")).alias("adjusted_f1"))


def reliability(df: DataFrame, y: str = "y", p: str = "p", bins: int = 10) -> DataFrame:
    """Per bin of predicted probability: rows, mean prediction, observed share."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.where(F.col(y).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_probability"), F.avg(F.col(y).cast("double")).alias("observed"))


def brier_ece(df: DataFrame, y: str = "y", p: str = "p", bins: int = 10) -> DataFrame:
    known = df.where(F.col(y).isNotNull())
    parts = reliability(df, y, p, bins).agg((F.sum(F.col("n") * F.abs(F.col("mean_probability") - F.col("observed"))) / F.sum("n")).alias("ece"))
    return known.agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier")).crossJoin(parts)


def balanced_weights(df: DataFrame, group: str, y: str) -> DataFrame:
    """Weights that give every group, and within it every label, the same total; unknown labels weigh nothing."""
    counts = df.where(F.col(y).isNotNull()).groupBy(group, y).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(group)
    totals = counts.agg(F.sum("_n").alias("_all"), F.count_distinct(group).alias("_groups"))
    counts = counts.withColumn("_classes", F.count("*").over(w)).crossJoin(F.broadcast(totals))
    return counts.withColumn("weight", F.col("_all") / (F.col("_groups") * F.col("_classes") * F.col("_n"))).select(group, y, F.col("_n").alias("n"), "weight")


def forecast_metrics(df: DataFrame, group: str, actual: str, predicted: str) -> DataFrame:
    """Count, MAE and RMSE of each group and pooled (group NULL), with the mean of the groups' MAE."""
    error = F.col(actual) - F.col(predicted)
    d = df.where(error.isNotNull()).select(group, error.alias("e"))
    sums = d.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.abs("e")).alias("a"), F.sum(F.col("e") * F.col("e")).alias("s"))
    own = sums.select(F.col(group).cast("string").alias("grp"), "n", (F.col("a") / F.col("n")).alias("mae"), F.sqrt(F.col("s") / F.col("n")).alias("rmse"), F.lit(None).cast("double").alias("macro_mae"))
    pooled = sums.agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("s").alias("s"), F.avg(F.col("a") / F.col("n")).alias("macro_mae"))
    return own.unionByName(pooled.select(F.lit(None).cast("string").alias("grp"), "n", (F.col("a") / F.col("n")).alias("mae"), F.sqrt(F.col("s") / F.col("n")).alias("rmse"), "macro_mae"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def purged_partitions(df: DataFrame, keys: list[str], order: str, y: str, shares: tuple[float, float] = (0.6, 0.8), purge: int = 168 * 3_600_000_000) -> DataFrame:
    """fit / selection / calibration by rank of time; rows within `purge` before a boundary, and positive runs that cross one, go."""
    w = Window.partitionBy(*keys)
    d = df.withColumn("_r", F.row_number().over(w.orderBy(order))).withColumn("_n", F.count("*").over(w))
    part = F.when(F.col("_r") <= F.floor(F.col("_n") * shares[0]), "fit").when(F.col("_r") <= F.floor(F.col("_n") * shares[1]), "selection").otherwise("calibration")
    d = label_segments(d.withColumn("part", part), keys, order, y, "_seg")
    starts = [F.min(F.when(F.col("part") == p, F.col(order))).over(w) for p in ("selection", "calibration")]
    d = d.withColumn("_b1", starts[0]).withColumn("_b2", starts[1]).withColumn("_parts", F.size(F.collect_set("part").over(Window.partitionBy(*keys, "_seg"))))
    near = ((F.col("part") == "fit") & (F.col(order) >= F.col("_b1") - purge)) | ((F.col("part") == "selection") & (F.col(order) >= F.col("_b2") - purge))
    return d.where(~F.coalesce(near, F.lit(False)) & ~((F.col(y) == 1) & (F.col("_parts") > 1))).drop("_r", "_n", "_seg", "_b1", "_b2", "_parts")


def hashed_cap(df: DataFrame, keys: list[str], ident: str, cap: int, seed: int = 0) -> DataFrame:
    """At most `cap` rows of each key, those with the smallest hash of (id, seed): a repeatable sample."""
    h = F.sha2(F.concat(F.col(ident).cast("string"), F.lit(f":{seed}")), 256)
    return df.withColumn("_h", h).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))).where(F.col("_r") <= cap).drop("_h", "_r")


def balanced_cap(df: DataFrame, group: str, ident: str, cap: int, seed: int = 0) -> DataFrame:
    """`cap` rows dealt round-robin over the groups."""
    h = F.sha2(F.concat(F.col(ident).cast("string"), F.lit(f":{seed}")), 256)
    d = df.withColumn("_h", h).withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy("_h"))).where(F.col("_r") <= cap)
    return d.orderBy("_r", group).limit(cap).drop("_h", "_r")
