"""Choosing and calibrating models: forecasts by macro error, ensemble weights and thresholds, temperature, pattern classifiers.

Fits run in Spark ML or as sums over grids; the driver sees grids and chosen settings, never rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobar.functions import seq


def choose_forecast(selection: DataFrame, group: str, actual: str, candidates: list[str]) -> DataFrame:
    """Mean over groups of each candidate column's mean absolute error, on rows where all candidates are there; `chosen` marks the best."""
    rows = selection.dropna(subset=[actual, *candidates])
    per = rows.groupBy(group).agg(*[F.avg(F.abs(F.col(actual) - F.col(c))).alias(c) for c in candidates])
    one = per.agg(*[F.avg(c).alias(c) for c in candidates], F.count("*").alias("groups"))
    out = one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("candidate"), F.col(c).alias("macro_mae"), F.col("groups")) for i, c in enumerate(candidates)])).alias("r")).select("r.*")
    best = out.agg(F.min(F.struct("macro_mae", "i"))["i"].alias("_best"))
    return out.crossJoin(F.broadcast(best)).select("candidate", "macro_mae", "groups", (F.col("i") == F.col("_best")).alias("chosen"))


def forecast_candidates(train: DataFrame, rows: DataFrame, features: list[str], actual: str, baseline: str, seasonal: str, iterations: int = 100, shrink: float = 0.5) -> DataFrame:
    """rows with six forecasts: persistence, seasonal, median_change (persistence plus the training rows' median change), and boosted
    trees on the level, on the change (residual) and on the change halved (residual_shrunk)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    ready = VectorAssembler(inputCols=features, outputCol="_x")
    fit = ready.transform(train.dropna(subset=[*features, actual, baseline]).withColumn("_change", F.col(actual) - F.col(baseline))).persist()
    median = fit.agg(F.percentile("_change", 0.5)).first()[0] or 0.0
    out = ready.transform(rows.dropna(subset=[*features, baseline]))
    for label, name in ((actual, "level"), ("_change", "_residual")):
        model = GBTRegressor(featuresCol="_x", labelCol=label, predictionCol=name, lossType="absolute", maxIter=iterations, maxDepth=4, stepSize=0.1, seed=7).fit(fit)
        out = model.transform(out)
    fit.unpersist()
    out = out.withColumn("persistence", F.col(baseline)).withColumn("seasonal", F.col(seasonal)).withColumn("median_change", F.col(baseline) + median)
    return out.withColumn("residual", F.col(baseline) + F.col("_residual")).withColumn("residual_shrunk", F.col(baseline) + shrink * F.col("_residual")).drop("_x", "_residual")


def resolve_thresholds(groups: DataFrame, supervised: DataFrame, tail: DataFrame, key: str, pooled: Column, least_positive: int = 20, least_negative: int = 100) -> DataFrame:
    """Each group's threshold and where it is from: tuned on its labels if it has enough of both, else its own tail, else pooled."""
    own = supervised.where((F.col("positives") >= least_positive) & (F.col("negatives") >= least_negative)).select(key, F.col("threshold").alias("_own"))
    d = groups.select(key).distinct().join(own, key, "left").join(tail.select(key, F.col("threshold").alias("_tail")), key, "left")
    return d.select(key, F.coalesce("_own", "_tail", pooled).alias("threshold"), F.when(F.col("_own").isNotNull(), "labels").when(F.col("_tail").isNotNull(), "tail").otherwise("pooled").alias("source"))


def weight_candidates(parts: int, draws: int = 256, seed: int = 0) -> np.ndarray:
    """Equal weights, each part alone, each pair, and draws of a sparse and of a uniform Dirichlet distribution."""
    rng, eye = np.random.default_rng(seed), np.eye(parts)
    pairs = [(eye[i] + eye[j]) / 2 for i in range(parts) for j in range(i + 1, parts)]
    return np.vstack([np.full((1, parts), 1 / parts), eye, *([np.array(pairs)] if pairs else []), rng.dirichlet(np.full(parts, 0.35), draws), rng.dirichlet(np.ones(parts), draws)])


def best_f1(scores: np.ndarray, y: np.ndarray, floor: float = 0.35) -> float:
    """The largest F1 over all thresholds (>=), halved where precision is under the floor."""
    order = np.argsort(-scores, kind="stable")
    tp, n = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    last = np.append(np.diff(scores[order]) != 0, True)  # equal scores are taken together
    f1 = 2 * tp / (n + y.sum())
    return float(np.where(tp / n < floor, f1 / 2, f1)[last].max(initial=0.0))


def search_weights(df: DataFrame, group: str, parts: list[str], y: str, candidates: np.ndarray) -> tuple[dict[str, float], float]:
    """The candidate weights of the largest mean, over groups with both labels, of the group's best strict F1.

    A task holds one group's validation rows and tries all candidates; only objectives leave it.
    """
    kind = df.schema[group].dataType.simpleString()
    rows = df.where(F.col(y).isNotNull()).select(group, F.col(y).cast("double").alias("_y"), *[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in parts])

    def run(f: pd.DataFrame) -> pd.DataFrame:
        labels = f["_y"].to_numpy()
        if labels.min() == labels.max():
            return pd.DataFrame({group: f[group].iloc[:0], "objectives": pd.Series([], dtype=object)})
        x = f[parts].to_numpy()
        return pd.DataFrame({group: f[group].iloc[:1].to_numpy(), "objectives": [[best_f1(x @ w, labels) for w in candidates]]})

    per = rows.groupBy(group).applyInPandas(run, f"{group} {kind}, objectives array<double>")
    means = per.select(F.posexplode("objectives").alias("i", "o")).groupBy("i").agg(F.avg("o").alias("o"))
    best = means.agg(F.max_by("i", F.struct("o", -F.col("i"))).alias("i"), F.max("o").alias("o")).first()
    if best["i"] is None:
        return dict.fromkeys(parts, 1 / len(parts)), 0.0
    return dict(zip(parts, candidates[best["i"]].tolist())), float(best["o"])


def temperature_losses(df: DataFrame, probabilities: str, truth: str, temperatures: list[float]) -> DataFrame:
    """Mean negative log-likelihood of the true class (a position from 0) for each temperature, in one pass."""
    logs = F.transform(F.col(probabilities), lambda p: F.ln(F.greatest(p, F.lit(1e-12))))
    d = df.select(logs.alias("_l"), F.col(truth).cast("int").alias("_k")).withColumn("_top", F.array_max("_l"))
    parts = []
    for i, t in enumerate(temperatures):
        scaled = lambda v: (v - F.col("_top")) / t  # noqa: E731, B023
        total = F.aggregate(F.transform("_l", lambda v: F.exp(scaled(v))), F.lit(0.0), lambda a, v: a + v)  # noqa: B023
        parts.append(F.avg(F.ln(total) - scaled(F.get("_l", F.col("_k")))).alias(f"t{i}"))
    one = d.agg(*parts)
    return one.select(F.explode(F.array(*[F.struct(F.lit(float(t)).alias("temperature"), F.col(f"t{i}").alias("loss")) for i, t in enumerate(temperatures)])).alias("r")).select("r.*")


def fit_temperature(df: DataFrame, probabilities: str, truth: str, low: float = -2.0, high: float = 3.0, rounds: int = 4, points: int = 21) -> float:
    """The temperature of the least loss, e^low to e^high: a grid of its logarithm, narrowed round the best point; one pass a round."""
    for _ in range(rounds):
        grid = np.linspace(low, high, points)
        losses = {round(r["temperature"], 12): r["loss"] for r in temperature_losses(df, probabilities, truth, np.exp(grid).tolist()).collect()}
        best = int(np.argmin([losses[round(float(math.exp(g)), 12)] for g in grid]))
        low, high = grid[max(0, best - 1)], grid[min(points - 1, best + 1)]
    return float(math.exp((low + high) / 2))


def with_temperature(probabilities: str, t: float) -> Column:
    """Probabilities sharpened (t < 1) or softened (t > 1): p^(1/t), normalised."""
    raised = F.transform(F.col(probabilities), lambda p: F.pow(F.greatest(p, F.lit(1e-12)), F.lit(1 / t)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, v: a + v))


def calibrated_risk(risk: Column, slope: float, intercept: float) -> Column:
    """Logistic calibration on the logit of a risk."""
    p = F.least(F.greatest(risk, F.lit(1e-8)), F.lit(1 - 1e-8))
    return 1 / (1 + F.exp(-(slope * F.ln(p / (1 - p)) + intercept)))


class PatternModel:
    """Probabilities of classes, the first of which is the background; `family` says how they are learned.

    two_head: boosted trees tell change from background, a forest tells the types apart among changes, and a type's
    probability is the product. boosted: boosted trees for each class against the others, normalised. forest: one random forest.
    Rows weigh sqrt(all / rows of their class).
    """

    FAMILIES = ("two_head", "boosted", "forest")

    def __init__(self, features: list[str], label: str, background: str, family: str = "two_head", iterations: int = 20, trees: int = 60, seed: int = 7):
        if family not in self.FAMILIES:
            raise ValueError(f"family must be one of {self.FAMILIES}")
        self.features, self.label, self.background, self.family, self.iterations, self.trees, self.seed = features, label, background, family, iterations, trees, seed

    def _ready(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        return VectorAssembler(inputCols=[f"_f{i}" for i in range(len(self.features))], outputCol="_x").transform(df.withColumns({f"_f{i}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for i, c in enumerate(self.features)})).drop(*[f"_f{i}" for i in range(len(self.features))])

    def _boost(self, df: DataFrame, y: Column):
        from pyspark.ml.classification import GBTClassifier

        return GBTClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=self.iterations, maxDepth=4, stepSize=0.1, seed=self.seed).fit(df.withColumn("_y", y.cast("double")))

    def _forest(self, df: DataFrame, classes: list[str]):
        from pyspark.ml.classification import RandomForestClassifier

        y = F.array_position(F.array(*map(F.lit, classes)), F.col(self.label)) - 1
        return RandomForestClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", numTrees=self.trees, maxDepth=10, seed=self.seed).fit(df.withColumn("_y", y.cast("double")))

    def fit(self, df: DataFrame) -> "PatternModel":
        counts = {r[0]: r[1] for r in df.where(F.col(self.label).isNotNull()).groupBy(self.label).count().collect()}
        if self.background not in counts or len(counts) < 2:
            raise ValueError("both background and changed rows are required")
        self.classes = [self.background, *sorted(c for c in counts if c != self.background)]
        total = sum(counts.values())
        weight = F.create_map(*[F.lit(v) for c, n in counts.items() for v in (c, math.sqrt(total / n))])
        rows = self._ready(df.where(F.col(self.label).isNotNull())).withColumn("_w", F.element_at(weight, F.col(self.label)))
        changed = F.col(self.label) != self.background
        rows = rows.select(self.label, "_x", "_w").persist()  # read once for each tree
        if self.family == "two_head":
            self.models = [self._boost(rows, changed), self._forest(rows.where(changed), self.classes[1:])]
        elif self.family == "boosted":
            self.models = [self._boost(rows, F.col(self.label) == c) for c in self.classes]
        else:
            self.models = [self._forest(rows, self.classes)]
        rows.unpersist()
        return self

    def _apply(self, model, df: DataFrame, out: str) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        return model.transform(df).withColumn(out, vector_to_array("probability")).drop("rawPrediction", "probability", "prediction")

    def predict(self, df: DataFrame) -> DataFrame:
        """df with `probabilities` (by position of `classes`), `risk`, `pattern`, `pattern_confidence`, `fault_pattern`."""
        d = self._ready(df)
        if self.family == "two_head":
            d = self._apply(self.models[1], self._apply(self.models[0], d, "_change"), "_type")
            p = F.concat(F.array(F.col("_change")[0]), F.transform("_type", lambda x: x * F.col("_change")[1]))
        elif self.family == "boosted":
            for i, m in enumerate(self.models):
                d = self._apply(m, d, f"_p{i}")
            raw = F.array(*[F.col(f"_p{i}")[1] for i in range(len(self.models))])
            p = F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda a, v: a + v))
        else:
            d = self._apply(self.models[0], d, "_all")
            p = F.col("_all")
        d = d.withColumn("probabilities", p).drop("_x", "_change", "_type", "_all", *[f"_p{i}" for i in range(len(self.classes))])
        name = lambda a: F.array(*map(F.lit, self.classes))[(F.array_position(a, F.array_max(a)) - 1).cast("int")]
        others = F.transform("probabilities", lambda x, i: F.when(i == 0, -1.0).otherwise(x))
        return d.withColumn("risk", 1 - F.col("probabilities")[0]).withColumn("pattern", name(F.col("probabilities"))).withColumn("pattern_confidence", F.array_max("probabilities")).withColumn("fault_pattern", name(others))


def macro_f1(df: DataFrame, truth: str, predicted: str, classes: list[str]) -> DataFrame:
    """Mean over classes of F1; a class that neither occurs nor is predicted counts 0."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    each = []
    for c in classes:
        tp, wrong = F.sum(F.when((F.col("t") == c) & (F.col("p") == c), F.col("n")).otherwise(0)), F.sum(F.when((F.col("t") == c) != (F.col("p") == c), F.col("n")).otherwise(0))
        each.append(F.when(2 * tp + wrong > 0, 2.0 * tp / (2 * tp + wrong)).otherwise(0.0))
    return pairs.agg((sum(each[1:], each[0]) / float(len(each))).alias("macro_f1"))


def choose_family(fit: DataFrame, selection: DataFrame, features: list[str], label: str, background: str, families: tuple[str, ...] = PatternModel.FAMILIES, **params) -> tuple[PatternModel, list[dict]]:
    """The model family with the largest .6 x detection average precision + .4 x macro F1 of the types, and all trials."""
    from isobar.operators import evaluate

    trials, best = [], None
    fit, selection = fit.select(label, *features).persist(), selection.select(label, *features).persist()
    for family in families:
        model = PatternModel(features, label, background, family, **params).fit(fit)
        d = model.predict(selection).withColumn("_changed", (F.col(label) != background).cast("int")).select(label, "risk", "pattern", "_changed").persist()
        ap = evaluate.average_precision(d, "_changed", "risk").first()[0] or 0.0
        f1 = macro_f1(d, label, "pattern", model.classes[1:]).first()[0] or 0.0
        trials.append({"family": family, "average_precision": ap, "macro_f1": f1, "objective": 0.6 * ap + 0.4 * f1})
        d.unpersist()
        if best is None or trials[-1]["objective"] > best[0]:
            best = (trials[-1]["objective"], model)
    fit.unpersist()
    selection.unpersist()
    return best[1], trials


def permutation_importance(df: DataFrame, features: list[str], score, rows: int = 20_000, seed: int = 0) -> list[dict]:
    """How much score(DataFrame) falls when one feature's values are dealt anew among at most `rows` rows (those of the smallest hash)."""
    sample = df.withColumn("_h", F.xxhash64(F.lit(seed), *features)).orderBy("_h").limit(rows)
    base = sample.withColumn("_i", F.row_number().over(Window.orderBy("_h", *features))).persist()
    whole, out = score(base), []
    for c in features:
        other = base.select(F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed + 1), F.lit(c), "_i"), "_i")).alias("_i"), F.col(c).alias("_other"))
        out.append({"feature": c, "importance": whole - score(base.drop(c).join(other, "_i").withColumnRenamed("_other", c))})
    base.unpersist()
    return sorted(out, key=lambda r: (-r["importance"], r["feature"]))


def stacked_features(df: DataFrame, scores: list[str], keys: list[str], reference: DataFrame, flags: list[str]) -> DataFrame:
    """The stacker's inputs: scores normalised by the reference's median and q99 of their group, and flags as 0 and 1."""
    aggs = [F.percentile(c, F.array(F.lit(0.5), F.lit(0.99))).alias(f"_{c}") for c in scores]
    d = df.join(reference.groupBy(*keys).agg(*aggs), keys, "left")
    norm = lambda c: F.coalesce((F.col(c) - F.col(f"_{c}")[0]) / F.greatest(F.col(f"_{c}")[1] - F.col(f"_{c}")[0], F.lit(1e-9)), F.lit(0.0))
    return d.withColumns({f"{c}__norm": norm(c) for c in scores} | {f"{c}__flag": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in flags}).drop(*[f"_{c}" for c in scores])


def fit_stacker(train: DataFrame, selection: DataFrame, features: list[str], y: str, group: str, iterations: tuple[int, ...] = (10, 20, 40), seed: int = 7):
    """Boosted trees over stacked features; how many is chosen by the mean over groups of average precision on the selection rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    best = None
    for n in iterations:
        steps = [VectorAssembler(inputCols=features, outputCol="_x"), GBTClassifier(featuresCol="_x", labelCol=y, maxIter=n, maxDepth=4, stepSize=0.1, seed=seed)]
        model = Pipeline(stages=steps).fit(train.where(F.col(y).isNotNull()))
        value = _macro_average_precision(supervised_score(model, selection.where(F.col(y).isNotNull())), group, y, "probability")
        if best is None or value > best[1]:
            best = (model, value, n)
    return best


def supervised_score(model, df: DataFrame) -> DataFrame:
    """df with the fitted stacker's `probability` of label 1."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df.drop("probability"))
    return out.withColumn("probability", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "prediction")


def supervised_decision(df: DataFrame, thresholds: DataFrame, key: str) -> DataFrame:
    """probability held to the group's threshold (>=)."""
    return df.join(thresholds.select(key, "threshold"), key, "left").withColumn("alert", F.col("probability") >= F.col("threshold"))


def _macro_average_precision(df: DataFrame, group: str, y: str, score: str) -> float:
    b = df.groupBy(group, F.col(score).alias("s")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count("*").alias("n"))
    w = Window.partitionBy(group)
    run = w.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("tp", F.sum("pos").over(run)).withColumn("pred", F.sum("n").over(run)).withColumn("all", F.sum("pos").over(w)).where("all > 0")
    return b.groupBy(group).agg(F.sum(F.col("pos") / F.col("all") * F.col("tp") / F.col("pred")).alias("ap")).agg(F.avg("ap")).first()[0] or 0.0


def window_sample(df: DataFrame, keys: list[str], cadence: int, rows: int, stride: int, per_key: int, time: str = "us", block: str | None = None) -> DataFrame:
    """Starts of windows of `rows` contiguous rows, every `stride` rows of a run, balanced over keys: at most per_key of each, evenly spaced."""
    d = seq.gap_runs(df, cadence, keys, "_run", time)
    w = Window.partitionBy(*keys, "_run").orderBy(time)
    d = d.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "_run")))
    d = d.where((F.col("_i") % stride == 0) & (F.col("_i") + rows <= F.col("_n"))).select(*keys, F.col(time).alias("start_us"))
    k = Window.partitionBy(*keys)
    d = d.withColumn("_p", F.row_number().over(k.orderBy("start_us")) - 1).withColumn("_m", F.count("*").over(k))
    kept = F.floor((F.col("_p") + 1) * per_key / F.greatest(F.col("_m"), F.lit(per_key))) > F.floor(F.col("_p") * per_key / F.greatest(F.col("_m"), F.lit(per_key)))
    return d.where(kept | (F.col("_m") <= per_key)).select(*keys, "start_us")
