"""Quality by Bradley-Terry pairwise ranking.

Each text has a vector of form features (shares of character classes, word and line statistics, repetition). A preference
pair is a document of quality 1 over one of quality 0; P(first preferred) = sigmoid(u(first) - u(second)) with u linear in
the features and their squares, fitted by Newton steps on the logistic loss of feature differences with L2. Utilities are
then read as quantiles of the training utilities, scaled so that the training share of quality 0 falls on THRESHOLD: a text
is predicted good when its utility passes that score quantile.

All labelled documents take part. Their rows are dealt to small groups by hash, with about GROUP rows of the rarer label in
each, and every pair of a group is used: each row meets GROUP others or more and the pairs grow with the rows, not with their
square. Sums over pairs are made where the rows lie, a fixed number of floats for each task; the quantiles are counts of all
training utilities in BINS classes, so nothing gathers on the driver that grows with the rows.

Null and empty texts have the features of an empty text. A null doc_id has a null held_out. Repeated rows are
scored each. Extra columns are ignored. Without labels of both kinds every score is 0.5. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isobar.llm.common import bounded_ids, fold, materialize, read_table, release

#: The pairs that the L2 penalty of 1 is meant for; it grows with their number.
PAIRS = 40_000
#: Rows of the rarer label in a group of training rows; classes in which training utilities are counted.
GROUP, BINS = 16, 65_536
THRESHOLD = 0.3
_CLASS = np.full(256, 6, np.int64)  # 6: bytes of letters beyond ASCII
_CLASS[:128] = 5  # other signs
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("a") : ord("z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[ord(c) for c in ".,;:'\"-()"]] = 4
_SIGNS = [ord(c) for c in "!?#$%&*|<>=/_{}[]\\@~^+"]
FEATURES = 34


def features(text: bytes | None) -> np.ndarray:
    raw = np.frombuffer(text or b"", np.uint8)
    n = max(1, len(raw))
    counts = np.bincount(raw, minlength=256)
    classes = np.bincount(_CLASS, counts, 7) / n
    letters = max(1e-9, classes[1] + classes[2] + classes[6])
    signs = np.sort(counts[_SIGNS] / n)[::-1]
    words = (text or b"").split()
    m = max(1, len(words))
    distinct = len(set(words)) / m
    lines = (text or b"").split(b"\n")
    filled = [x for x in lines if x.strip()]
    k = max(1, len(filled))
    sentences = (text or b"").split(b". ")
    most = np.bincount(np.unique(np.fromiter(map(hash, words), np.int64, len(words)), return_inverse=True)[1]).max() / m if words else 0.0
    pairs = len(set(zip(words, words[1:]))) / max(1, len(words) - 1)
    ends = sum(x.rstrip().endswith((b".", b"!", b"?")) for x in filled) / k
    caps = sum(map(bytes.isupper, words)) / m
    alpha = sum(map(bytes.isalpha, words)) / m
    return np.array(
        [np.log1p(len(words)), classes[0], classes[1] / letters, classes[2], classes[3], classes[4], classes[5], classes[6], signs[0], signs[:3].sum(), signs.sum(), counts[33] / n, counts[124] / n, counts[35] / n, counts[37] / n, counts[38] / n,
         counts[36] / n, counts[42] / n, distinct, pairs, most, len(raw) / m / 10, np.log1p(k), len(set(filled)) / k, np.log1p(len(raw) / k), ends, caps, alpha, len(set(sentences)) / len(sentences), (counts > 0).sum() / 100,
         -(p := counts[counts > 0] / n) @ np.log(p) if len(raw) else 0.0, float(m < 8), float(m < 25), float(not words)]
    )


class Ranker:
    """Utility, and the score it is read as."""

    def __init__(self):
        self.mean, self.scale, self.beta = np.zeros(FEATURES), np.ones(FEATURES), np.zeros(2 * FEATURES)
        self.knots, self.values = np.array([0.0]), np.array([0.5])

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([z, z * z / 6], axis=1)

    def utility(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.utility(x), self.knots, self.values)

    def fit(self, x: np.ndarray, y: np.ndarray, share: float, pairs: int = PAIRS, l2: float = 1.0, seed: int = 4) -> "Ranker":
        """share: the share of label 0 among all labelled rows."""
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        rng, good, bad = np.random.default_rng(seed), np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        z = self.expand(x)
        d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(d @ self.beta, -30, 30)))
            gradient = d.T @ (p - 1) + l2 * self.beta
            hessian = (d * (p * (1 - p))[:, None]).T @ d + l2 * np.eye(len(self.beta))
            self.beta = self.beta - np.linalg.solve(hessian, gradient)
        u = self.utility(x)
        weight = np.where(y == 1, (1 - share) / len(good), share / len(bad))
        order = np.argsort(u, kind="stable")
        knots, first = np.unique(u[order], return_index=True)
        return self.read_as(knots, np.add.reduceat(weight[order], first), share)

    def read_as(self, knots: np.ndarray, weight: np.ndarray, share: float) -> "Ranker":
        """Utilities in order, their weights and the share of label 0: scores are mid-rank quantiles, `share` falls on THRESHOLD."""
        up = np.cumsum(weight)
        rank = (up - weight / 2) / up[-1]
        values = np.where(rank < share, rank / share * THRESHOLD, THRESHOLD + (rank - share) / (1 - share) * (1 - THRESHOLD))
        self.knots, self.values = knots, np.clip(values, 0, 1)
        return self


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)


def _vectors(batches):
    for batch in batches:
        rows = [features(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        flat = pa.array(np.concatenate([*rows, np.zeros(0)]))
        x = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * FEATURES), flat)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), batch.column("h"), x], names=["doc_id", "held_out", "h", "x"])


def vectors(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, h (a hash of the row) and its features x; written, as it is read several times."""
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), (fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.xxhash64(doc_id, "text").alias("h"), "text")
    return materialize(rows.mapInArrow(_vectors, "doc_id long, held_out boolean, h long, x array<double>"), "quality-vectors")


def _sums(rows: DataFrame, width: int, of) -> list[np.ndarray]:
    """What `of` makes of a task's batches, one array of `width` floats a task; tasks without rows give none."""

    def run(batches):
        got = of(b for b in batches if b.num_rows)
        if got is not None:
            yield pa.RecordBatch.from_arrays([pa.array([got.tolist()], pa.list_(pa.float64()))], names=["s"])

    out = [np.array(r[0]) for r in rows.mapInArrow(run, "s array<double>").collect()]
    assert all(len(r) == width for r in out)
    return out


def _moments(batches):
    """Rows of label 0 and 1, and the features' means and squared deviations."""
    n, total, mean, spread = np.zeros(2), 0, np.zeros(FEATURES), np.zeros(FEATURES)
    for batch in batches:
        x, m = _matrix(batch), batch.num_rows
        n += np.bincount(batch.column("label").to_numpy(), minlength=2)
        step = x.mean(axis=0) - mean
        spread += ((x - x.mean(axis=0)) ** 2).sum(axis=0) + step**2 * (total * m / (total + m))
        mean, total = mean + step * (m / (total + m)), total + m
    return np.concatenate([n, mean, spread]) if total else None


def _newton(model: Ranker):
    """Sums over all pairs of each group of rows, which come sorted by group: pairs, gradient and Hessian of the loss."""
    width = 2 * FEATURES

    def pairs(x: np.ndarray, y: np.ndarray, out: list) -> None:
        z = model.expand(x)
        good, bad = z[y == 1], z[y == 0]
        step = max(1, 8192 // max(1, len(bad)))
        for i in range(0, len(good) if len(bad) else 0, step):
            for j in range(0, len(bad), 8192):
                d = (good[i : i + step, None, :] - bad[None, j : j + 8192, :]).reshape(-1, width)
                p = 1 / (1 + np.exp(-np.clip(d @ model.beta, -30, 30)))
                out[0] += len(d)
                out[1] += d.T @ (p - 1)
                out[2] += (d * (p * (1 - p))[:, None]).T @ d

    def run(batches):
        out, rest = [0.0, np.zeros(width), np.zeros((width, width))], None
        for batch in batches:
            now = batch.column("g").to_numpy(), _matrix(batch), batch.column("label").to_numpy()
            g, x, y = now if rest is None else tuple(np.concatenate(c) for c in zip(rest, now))
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist()]
            for a, b in zip(cuts, cuts[1:]):
                pairs(x[a:b], y[a:b], out)
            rest = g[cuts[-1] :], x[cuts[-1] :], y[cuts[-1] :]
        if rest is None:
            return None
        pairs(rest[1], rest[2], out)
        return np.concatenate([[out[0]], out[1], out[2].ravel()])

    return run


def _bounds(model: Ranker):
    def run(batches):
        ends = [(u.min(), u.max()) for b in batches for u in [model.utility(_matrix(b))]]
        return np.array([min(a for a, _ in ends), max(b for _, b in ends)]) if ends else None

    return run


def _counted(model: Ranker, low: float, high: float):
    def run(batches):
        for batch in batches:
            u = model.utility(_matrix(batch))
            bins, at = np.unique(np.minimum((u - low) / max(high - low, 1e-300) * BINS, BINS - 1).astype(np.int64), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(np.bincount(at, minlength=len(bins))), pa.array(np.bincount(at, u, len(bins)))], names=["bin", "c", "u"])

    return run


def train(docs: DataFrame, labels: DataFrame, per_label: int | None = None) -> Ranker:
    """docs (doc_id, text), labels (doc_id, label 0/1). per_label: learn from at most so many ids of each label, by default from all."""
    return fit_all(vectors(docs), labels, per_label)


def fit_all(seen: DataFrame, labels: DataFrame, per_label: int | None = None, l2: float = 1.0) -> Ranker:
    """seen: what vectors() gives."""
    known = labels.where("label in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).distinct()
    if per_label is not None:
        known = seen.sparkSession.createDataFrame([(int(i), int(v)) for i, v in bounded_ids(known, per_label, "label")], "doc_id long, label int")
    rows = materialize(seen.join(known, "doc_id").select("label", "h", "x"), "quality-rows")
    n, total, mean, spread = np.zeros(2), 0.0, np.zeros(FEATURES), np.zeros(FEATURES)
    for part in _sums(rows, 2 + 2 * FEATURES, _moments):
        m, step = part[:2].sum(), part[2 : 2 + FEATURES] - mean
        spread += part[2 + FEATURES :] + step**2 * (total * m / (total + m))
        n, mean, total = n + part[:2], mean + step * (m / (total + m)), total + m
    if not n.all():
        release(rows)
        return Ranker()
    model = Ranker()
    model.mean, model.scale = mean, np.maximum(np.sqrt(spread / total), 1e-6)
    groups = max(1, int(n.min()) // GROUP)
    copy = F.row_number().over(Window.partitionBy("h", "label").orderBy("h"))  # equal rows are dealt to different groups
    dealt = rows.withColumn("g", F.pmod(F.xxhash64("h", "label", copy), F.lit(groups))).select("g", "label", "h", "x")
    dealt = materialize(dealt.repartition("g").sortWithinPartitions("g", "h"), "quality-groups")
    width = 2 * FEATURES
    for _ in range(12):
        found = np.sum(_sums(dealt, 1 + width + width * width, _newton(model)), axis=0)
        if not found[0]:
            break
        penalty = l2 * found[0] / PAIRS
        step = np.linalg.solve(found[1 + width :].reshape(width, width) + penalty * np.eye(width), found[1 : 1 + width] + penalty * model.beta)
        model.beta = model.beta - step
        if np.abs(step).max() < 1e-10:
            break
    ends = _sums(rows, 2, _bounds(model))
    low, high = min(e[0] for e in ends), max(e[1] for e in ends)
    counts = rows.mapInArrow(_counted(model, low, high), "bin long, c long, u double").groupBy("bin").agg(F.sum("c").alias("c"), F.sum("u").alias("u")).orderBy("bin").collect()
    release(rows, dealt)
    c = np.array([r.c for r in counts], float)
    return model.read_as(np.array([r.u for r in counts]) / c, c, n[0] / total)


def _scores(model: Ranker):
    def run(batches):
        for batch in batches:
            values = model.score(_matrix(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(values), pa.array((values >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def quality(docs: DataFrame, model: Ranker) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, score, predicted."""
    return scored(vectors(docs), model)


def scored(seen: DataFrame, model: Ranker) -> DataFrame:
    """The same from what vectors() gives."""
    return seen.mapInArrow(_scores(model), "doc_id long, held_out boolean, score double, predicted int")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    seen = vectors(read_table(spark, sf_dir, "documents"))
    labels = read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return scored(seen, fit_all(seen, labels.where(fold(F.col("doc_id"), 5) != 0)))
