"""Fitted models: peaks-over-threshold, isolation forest, boosted forecasters, fault typing, calibration, bootstraps."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isobar.functions import seq


def gpd_fit(excess: np.ndarray) -> tuple[float, float]:
    """(shape, scale) of the generalised Pareto distribution by the profile likelihood of theta = shape / scale."""
    x = np.asarray(excess, float)
    mean, top = x.mean(), x.max()
    theta = np.concatenate([-(1 - 1e-6) / top * np.geomspace(1, 1e-4, 200), np.geomspace(1e-6 / mean, 50 / mean, 400)])
    shape = np.array([np.log1p(t * x).mean() for t in theta])
    with np.errstate(divide="ignore", invalid="ignore"):
        ll = np.where(shape / theta > 0, -np.log(shape / theta) - shape - 1, -np.inf)
    best = int(ll.argmax())
    if ll[best] <= -math.log(mean) - 1:
        return 0.0, float(mean)
    return float(shape[best]), float(shape[best] / theta[best])


def _gpd_grid(mean: float, top: float) -> np.ndarray:
    return np.concatenate([-(1 - 1e-6) / top * np.geomspace(1, 1e-4, 200), np.geomspace(1e-6 / mean, 50 / mean, 400)])


def pot_by_group(df: DataFrame, key: str, score: str, q_init: float = 0.98, risk: float = 1e-3) -> DataFrame:
    """Peaks-over-threshold quantile of each group; the 0.995 quantile with too few values or where the fit fails.

    The likelihood of a group's exceedances is profiled over a grid of theta = shape / scale: each grid value needs one sum of
    log(1 + theta x), so a tail of any length is summed where it lies, in slices dealt to many tasks, and only sums meet.
    A group whose values are all the same has the next larger number.
    """
    base = df.where(F.col(score).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.percentile(score, q_init).alias("t0"), F.percentile(score, 0.995).alias("plain"), F.min(score).alias("lo"), F.max(score).alias("hi"))
    top = df.join(base, key).where(F.col(score) > F.col("t0")).select(key, (F.col(score) - F.col("t0")).alias("x"))
    facts = top.groupBy(key).agg(F.count("*").alias("m"), F.avg("x").alias("mean"), F.max("x").alias("top"))
    kind = df.schema[key].dataType.simpleString()

    def sums(f: pd.DataFrame) -> pd.DataFrame:
        theta = _gpd_grid(float(f["mean"].iloc[0]), float(f["top"].iloc[0]))
        x = f["x"].to_numpy()
        total = np.zeros(len(theta))
        for i in range(0, len(x), 4096):
            total += np.log1p(theta[:, None] * x[None, i : i + 4096]).sum(axis=1)
        return pd.DataFrame({key: f[key].iloc[:1].to_numpy(), "sums": [total.tolist()]})

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        mean, top_x, m, n, t0 = (float(f[c].iloc[0]) for c in ("mean", "top", "m", "n", "t0"))
        theta, shape = _gpd_grid(mean, top_x), np.sum(np.stack(f["sums"].to_list()), axis=0) / m
        with np.errstate(divide="ignore", invalid="ignore"):
            ll = np.where(shape / theta > 0, -np.log(shape / theta) - shape - 1, -np.inf)
        best = int(ll.argmax())
        c, scale = (0.0, mean) if ll[best] <= -math.log(mean) - 1 else (float(shape[best]), float(shape[best] / theta[best]))
        ratio = n * risk / m
        v = t0 - scale * math.log(ratio) if abs(c) < 1e-9 else t0 + scale / c * (ratio ** (-c) - 1)
        return pd.DataFrame({key: f[key].iloc[:1].to_numpy(), "fitted": [v if math.isfinite(v) and v > t0 else None]})

    enough = facts.join(base.select(key, "n", "t0"), key).where("n >= 1000 and m >= 50")
    slices = top.join(enough.select(key, "mean", "top"), key).withColumn("_slice", F.pmod(F.xxhash64("x"), F.lit(64)))
    parts = slices.groupBy(key, "_slice").applyInPandas(lambda f: sums(f), f"{key} {kind}, sums array<double>")
    fitted = parts.join(enough, key).groupBy(key).applyInPandas(lambda f: fit(f), f"{key} {kind}, fitted double")
    up = F.expr("cast(java_method('java.lang.Math', 'nextUp', hi) as double)")
    out = base.join(facts.select(key, "m"), key, "left").join(fitted, key, "left")
    return out.select(key, "n", F.when(F.col("lo") == F.col("hi"), up).otherwise(F.coalesce("fitted", "plain")).alias("threshold"), F.coalesce("m", F.lit(0)).alias("exceedances"))


class IsolationForest:
    """Isolation trees on a bounded sample; scores are 2^(-mean depth / c(n)), shipped with the function that scores.

    A tree is four arrays over its nodes: feature, cut, the two next nodes (a leaf's are itself) and the path length a leaf
    stands for. It is grown a level at a time and walked for all rows at once.
    """

    def __init__(self, trees: int = 100, sample: int = 256, seed: int = 0):
        self.trees, self.sample, self.seed, self.roots = trees, sample, seed, []

    @staticmethod
    def _c(n):
        n = np.asarray(n, float)
        m = np.maximum(n - 1, 1.0)
        return np.where(n < 2, 0.0, 2 * (np.log(m) + 0.5772156649) - 2 * m / np.maximum(n, 1.0))

    def _levels(self, x: np.ndarray, limit: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        parts: list[tuple[np.ndarray, ...]] = []
        ends, made = np.array([len(x)]), 1  # x is ordered by node; a node's rows end here
        for depth in range(limit + 1):
            starts = np.r_[0, ends[:-1]]
            counts, first = ends - starts, made - len(ends)
            low, high = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)
            varies = high > low
            inner = varies.any(axis=1) & (depth < limit)
            feature = np.argmax(np.where(varies, rng.random(varies.shape), -1.0), axis=1)  # each open feature is as likely
            at = np.arange(len(ends))
            cut = np.where(inner, low[at, feature] + rng.random(len(ends)) * (high[at, feature] - low[at, feature]), 0.0)
            cut = np.where(inner & (cut <= low[at, feature]), high[at, feature], cut)  # both sides get a row
            kids = np.repeat(first + at, 2)
            kids[np.repeat(inner, 2)] = made + np.arange(2 * inner.sum())
            parts.append((feature.astype(np.int8), cut, kids.astype(np.int32), np.where(inner, 0.0, depth + self._c(counts)).astype(np.float32)))
            if not inner.any():
                break
            node = np.repeat(at, counts)
            x, node = x[inner[node]], node[inner[node]]
            right = x[np.arange(len(x)), feature[node]] >= cut[node]
            place = 2 * (np.cumsum(inner) - 1)[node] + right
            x, ends = x[np.argsort(place, kind="stable")], np.cumsum(np.bincount(place, minlength=2 * inner.sum()))
            made += len(ends)
        return tuple(np.concatenate(c) for c in zip(*parts))

    def tree(self, x: np.ndarray, number: int) -> tuple[np.ndarray, ...]:
        """The tree of that number on a sample of x: the same wherever it is grown."""
        n, rng = min(self.sample, len(x)), np.random.default_rng([self.seed, number])
        return self._levels(x[rng.choice(len(x), n, replace=False)], math.ceil(math.log2(max(2, n))), rng)

    def fit(self, x: np.ndarray) -> "IsolationForest":
        self.n = min(self.sample, len(x))
        self.roots = [self.tree(x, i) for i in range(self.trees)]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total, flat = np.zeros(len(x)), np.ascontiguousarray(x).ravel()
        for feature, cut, kids, length in self.roots:
            rows, node = np.arange(len(x)), np.zeros(len(x), np.int32)
            while len(rows):
                right = ~(flat[rows * x.shape[1] + feature[node]] < cut[node])
                after = kids[2 * node + right]
                done = after == node
                if done.any():
                    total[rows[done]] += length[node[done]]
                    rows, after = rows[~done], after[~done]
                node = after
        return 2.0 ** (-total / self.trees / max(float(self._c(self.n)), 1e-9))


def isolation_scores(df: DataFrame, features: list[str], ident: str, sample_rows: int = 20_000, **params) -> DataFrame:
    """df's ident with its isolation score; the forest is fitted on at most sample_rows rows, those of the smallest id hash.

    Trees are grown in tasks of their own and rows are dealt anew, so that neither waits for one core.
    """
    x = df.select(ident, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    fit = x.orderBy(F.xxhash64(ident), ident).limit(sample_rows).select(*features).toArrow()
    kind = df.schema[ident].dataType.simpleString()
    if not fit.num_rows:
        return x.select(ident, F.lit(None).cast("double").alias("score"))
    context, forest = df.sparkSession.sparkContext, IsolationForest(**params)
    seen = context.broadcast(np.stack([fit.column(c).to_numpy() for c in features], axis=1))
    forest.n = min(forest.sample, fit.num_rows)
    forest.roots = context.parallelize(range(forest.trees), min(forest.trees, 4 * context.defaultParallelism)).map(lambda i: forest.tree(seen.value, i)).collect()
    seen.destroy()
    shared = context.broadcast(forest)

    def run(frames):
        for f in frames:
            yield pd.DataFrame({ident: f[ident], "score": shared.value.score(f[features].to_numpy())})

    return x.repartition(4 * context.defaultParallelism, ident).mapInPandas(run, f"{ident} {kind}, score double")


def boosted_forecast(train: DataFrame, test: DataFrame, features: list[str], actual: str, baseline: str, iterations: int = 20) -> tuple[DataFrame, str]:
    """Gradient-boosted correction of a persistence forecast (absolute loss); kept only if its training MAE beats persistence."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    ready = lambda d: VectorAssembler(inputCols=features, outputCol="_x").transform(d.dropna(subset=[*features, actual, baseline])).withColumn("_y", F.col(actual) - F.col(baseline))
    model = GBTRegressor(featuresCol="_x", labelCol="_y", predictionCol="_p", lossType="absolute", maxIter=iterations, maxDepth=4, stepSize=0.1, seed=7).fit(fit := ready(train).persist())
    seen = model.transform(fit).agg(F.avg(F.abs(F.col("_y") - F.col("_p"))).alias("m"), F.avg(F.abs("_y")).alias("b")).first()
    fit.unpersist()
    out = model.transform(ready(test))
    chosen = "boosted" if seen["m"] < seen["b"] else "persistence"
    return out.withColumn("forecast", F.col(baseline) + (F.col("_p") if chosen == "boosted" else F.lit(0.0))).drop("_x", "_y", "_p"), chosen


def type_faults(train: DataFrame, test: DataFrame, features: list[str], label: str) -> DataFrame:
    """Random forest over signals: predicted class and its probability."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    prepare = VectorAssembler(inputCols=features, outputCol="_x")
    index = StringIndexer(inputCol=label, outputCol="_y", handleInvalid="skip").fit(train)
    model = RandomForestClassifier(featuresCol="_x", labelCol="_y", predictionCol="_p", numTrees=30, maxDepth=6, seed=7).fit(index.transform(prepare.transform(train.na.fill(0.0, features))))
    out = model.transform(prepare.transform(test.na.fill(0.0, features)))
    names = F.array(*[F.lit(x) for x in index.labels])
    return out.withColumn("predicted", names[F.col("_p").cast("int")]).withColumn("confidence", F.array_max(vector_to_array("probability"))).drop("_x", "_p", "rawPrediction", "probability")


def platt(df: DataFrame, score: str, y: str) -> tuple[float, float]:
    """(slope, intercept) of the logistic calibration of a score."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    m = LogisticRegression(featuresCol="_x", labelCol=y).fit(VectorAssembler(inputCols=[score], outputCol="_x").transform(df.where(F.col(y).isNotNull())))
    return float(m.coefficients[0]), float(m.intercept)


def group_bootstrap(df: DataFrame, group: str, y: str, p: str, draws: int = 500, seed: int = 0) -> DataFrame:
    """Mean and 95 % interval of pooled F1 over draws of whole groups with replacement.

    Rows are counted per group first; a group's weight in a draw is Poisson(1), from a hash of (group, draw, seed).
    """
    per = df.where(F.col(y).isNotNull()).groupBy(group).agg(F.count_if((F.col(y) == 1) & (F.col(p) == 1)).alias("tp"), F.count_if(F.col(y) != F.col(p)).alias("wrong"))
    u = F.pmod(F.xxhash64(F.lit(seed), group, "draw"), F.lit(1_000_003)) / 1_000_003.0
    bounds, acc = [], 0.0
    for k in range(8):
        acc += math.exp(-1) / math.factorial(k)
        bounds.append(acc)
    weight = sum((F.when(u > b, 1).otherwise(0) for b in bounds[1:]), F.when(u > bounds[0], 1).otherwise(0))
    d = per.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", weight)
    f = d.groupBy("draw").agg(F.sum(F.col("w") * F.col("tp")).alias("tp"), F.sum(F.col("w") * F.col("wrong")).alias("wrong"))
    f = f.withColumn("f1", F.when(2 * F.col("tp") + F.col("wrong") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("wrong"))).otherwise(0.0))
    return f.agg(F.avg("f1").alias("mean_f1"), F.percentile("f1", 0.025).alias("low"), F.percentile("f1", 0.975).alias("high"), F.count("*").alias("draws"))


def inject_faults(df: DataFrame, keys: list[str], x: str, rate: float = 0.02, length: int = 12, seed: int = 0, time: str = "us", swap: str | None = None) -> DataFrame:
    """Deterministic faults on hashed blocks of `length` rows: spike, bias, drift, stuck, dropout, noise, clipping and scale error, and
    with `swap` another column's shape in this one's units. Missing values stay missing.

    Adds `injected` (the new value), `fault`, `block` and `modified`.
    """
    w = Window.partitionBy(*keys).orderBy(time)
    d = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_b", F.floor(F.col("_i") / length))
    u = F.pmod(F.xxhash64(F.lit(seed), *keys, "_b"), F.lit(1_000_003)) / 1_000_003.0
    kinds = ["spike", "drift", "stuck", "dropout", "noise", "bias", "clipping", "scale_error", *(["sensor_swap"] if swap else [])]
    pick = F.array(*map(F.lit, kinds))[F.pmod(F.xxhash64(F.lit(seed + 1), *keys, "_b"), F.lit(len(kinds))).cast("int")]
    scale = df.groupBy(*keys).agg(F.greatest(F.stddev_samp(x), F.lit(1e-3)).alias("_s"), F.avg(x).alias("_m"), F.percentile(x, 0.65).alias("_top"), *([F.avg(swap).alias("_om"), F.greatest(F.stddev_samp(swap), F.lit(1e-9)).alias("_os")] if swap else []))
    d = d.withColumn("fault", F.when(u < rate, pick)).join(scale, keys)
    block = Window.partitionBy(*keys, "_b").orderBy(time)
    first = F.first(x, True).over(block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    place = (F.col("_i") % length) / float(length)
    wiggle = F.pmod(F.xxhash64(F.lit(seed + 2), *keys, "_i"), F.lit(2001)) / 1000.0 - 1
    new = (
        F.when((F.col("fault") == "spike") & (F.col("_i") % length == 0), F.col(x) + 6 * F.col("_s")).when(F.col("fault") == "drift", F.col(x) + 4 * F.col("_s") * place)
        .when((F.col("fault") == "stuck") & F.col(x).isNotNull(), first).when(F.col("fault") == "dropout", None).when(F.col("fault") == "noise", F.col(x) + 2 * F.col("_s") * wiggle)
        .when(F.col("fault") == "bias", F.col(x) + 3 * F.col("_s")).when((F.col("fault") == "clipping") & F.col(x).isNotNull(), F.least(F.col(x), F.col("_top"))).when(F.col("fault") == "scale_error", F.col("_m") + (F.col(x) - F.col("_m")) * 0.4)
        .when((F.col("fault") == "sensor_swap") & F.col(x).isNotNull(), F.coalesce((F.col(swap) - F.col("_om")) / F.col("_os") * F.col("_s") + F.col("_m"), F.col(x)) if swap else F.col(x)).otherwise(F.col(x))
    )
    return d.withColumn("injected", new).withColumn("modified", ~F.col("injected").eqNullSafe(F.col(x))).withColumnRenamed("_b", "block").drop("_i", "_s", "_m", "_top", "_om", "_os")


def injection_log(df: DataFrame, keys: list[str], time: str = "us") -> DataFrame:
    """One row per injected block that changed something: fault, first and last changed time, changed rows."""
    return df.where("modified").groupBy(*keys, "block", "fault").agg(F.min(time).alias("start_us"), F.max(time).alias("end_us"), F.count("*").alias("rows"))


def injection_report(clean: DataFrame, injected: DataFrame, keys: list[str], alert: str = "alert", physical: str | None = None) -> DataFrame:
    """Per fault: changed rows, the share that alerts, the share that alerts or breaks a physical rule; and (fault NULL) the alert
    rate of the untouched series."""
    hit = F.coalesce(F.col(alert), F.lit(False))
    both = hit | F.coalesce(F.col(physical), F.lit(False)) if physical else hit
    per = injected.where("modified").groupBy("fault").agg(F.count("*").alias("rows"), F.avg(hit.cast("double")).alias("row_recall"), F.avg(both.cast("double")).alias("combined_recall"))
    base = clean.agg(F.lit(None).cast("string").alias("fault"), F.count("*").alias("rows"), F.avg(hit.cast("double")).alias("row_recall"), F.avg(both.cast("double")).alias("combined_recall"))
    return per.unionByName(base)


def classify_event(events: DataFrame, reference: DataFrame, keys: list[str], x: str, time: str = "us", reference_keys: list[str] | None = None) -> DataFrame:
    """A rule ladder over an event's rows against reference rows of the same keys, or of `reference_keys` among them.

    In order: mostly missing is dropout; under 3 rows a spike; standing still over 6 rows stuck; nine tenths zeros dropout; a line
    of over 3 reference deviations drift; over 3 times the deviation noise; under 0.4 times it over 12 rows a scale error; a
    shift of 1.5 deviations bias; single large values spikes; pressed against the reference's upper end clipping; else complex.
    Without a reference the type is unknown.
    """
    ref = reference.groupBy(*(reference_keys or keys)).agg(F.percentile(x, 0.5).alias("_med"), F.percentile(x, 0.98).alias("_q98"), F.stddev_pop(x).alias("_std")).where("_med is not null")
    w = Window.partitionBy(*keys).orderBy(time)
    back, whole = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # before an event's first value that value is the next one; a frame that starts at each row would be read anew for every row
    d = events.withColumn("_f", F.coalesce(F.last(x, True).over(back), F.first(x, True).over(whole))).withColumn("_i", (F.row_number().over(w) - 1).cast("double"))
    d = d.withColumn("_step", F.abs(F.col("_f") - F.lag("_f").over(w))).join(ref, reference_keys or keys, "left")
    scale = F.when(F.col("_std") > 0, F.col("_std")).otherwise(1e-6)
    d = d.withColumn("_dev", (F.col("_f") - F.col("_med")) / scale)
    s = d.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.count(x).alias("seen"), F.max("_step").alias("step"), F.avg((F.col("_f") == 0).cast("double")).alias("zeros"), (F.stddev_pop("_f") / F.first(scale)).alias("ratio"), seq.slope(F.col("_dev"), F.col("_i")).alias("slope"),
        seq.correlation(F.col("_i"), F.col("_dev")).alias("line"), F.avg("_dev").alias("shift"), F.max(F.abs("_dev")).alias("far"), F.percentile(F.abs("_dev"), 0.99).alias("q99"), F.avg((F.col("_f") >= F.col("_q98")).cast("double")).alias("pressed"), F.first("_med").alias("_med"),
    )
    n = F.col("rows")
    no = F.lit(False)
    yes = lambda c: F.coalesce(c, no)
    kind = (
        F.when(F.col("_med").isNull(), "unknown").when(F.col("seen") < 0.5 * n, "dropout").when(n < 3, "spike").when(yes(F.col("step") < 1e-8) & (n >= 6), "stuck").when(yes(F.col("zeros") > 0.9), "dropout")
        .when((n >= 6) & yes(F.abs("slope") * n > 3) & yes(F.abs("line") > 0.85), "drift").when(yes(F.col("ratio") > 3.0), "noise_burst").when(yes(F.col("ratio") < 0.4) & (n >= 12), "scale_error")
        .when(yes(F.abs("shift") > 1.5) & yes(F.col("ratio") < 1.5), "bias").when(yes(F.col("far") > 4) & (n <= 6), "spike").when(yes(F.col("q99") > 3), "spike").when(yes(F.col("pressed") > 0.8) & yes(F.col("ratio") < 0.6), "clipping")
        .otherwise("complex")
    )
    return s.select(*keys, "rows", "seen", kind.alias("fault"))
