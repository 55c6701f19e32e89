"""Toxicity with a factorisation machine over hashed terms.

A text's features are its distinct lower-cased terms, hashed. The machine scores w0 + sum w_i + sum_{i<j} <v_i, v_j>: the
factors v learn pairs of terms that mean more together than apart, such as an insult and the mention of a group, which
additive weights miss. It is fitted by AdaGrad on the logistic loss with L2 on a bounded sample: at most TRAIN_ROWS labelled
documents of each label (those with the smallest hash of doc_id; at most twice as many rows where ids repeat), whole texts.

Terms of the final machine: a first machine is fitted on all terms of at least MIN_DOCS training documents, with inputs scaled
to unit length, so that the score of a long text isn't the sum of thousands of accidental weights. The PAIR_TERMS terms to
which it gives the largest weights and factors for their frequency are taken, which finds terms that mean nothing apart and
much together, and all terms whose own frequency differs between the labels by MIN_Z standard errors or more.

Null or empty texts have no terms and get the score of the intercept. Conflicting labels of one doc_id are all used.
A null doc_id has a null held_out. Extra columns are ignored. Without labels of both kinds every score is the share of
label 1 (0 without labels). An empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import CACHE_WORDS, bounded_ids, fold, process_memory, read_table

BUCKETS = 2**22
TRAIN_ROWS = 6_000
MIN_DOCS, MIN_Z, PAIR_TERMS = 3, 3.0, 128
FACTORS = 8
_TERM = re.compile(r"\w+")


class Terms(dict):
    """term -> its number in the model (or bucket), remembered; terms the model leaves out give -1."""

    def __init__(self, numbers: dict[int, int] | None = None):
        self.numbers = numbers

    @classmethod
    def of_process(cls, numbers: dict[int, int]) -> "Terms":
        """The memory for a model's terms in this Python worker, which serves many tasks."""
        return process_memory(("terms", np.array(list(numbers), np.int64).tobytes()), lambda: cls(numbers))

    def __missing__(self, term: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        bucket = xxhash.xxh3_64_intdigest(term) % BUCKETS
        value = self[term] = bucket if self.numbers is None else self.numbers.get(bucket, -1)
        return value

    def of(self, text: str | None) -> list[int]:
        return sorted({self[t] for t in set(_TERM.findall(text.lower()))} - {-1}) if text else []


class Machine:
    def __init__(self, buckets: np.ndarray, base: float):
        n = len(buckets)
        self.numbers = {int(b): i for i, b in enumerate(buckets)}
        self.bias, self.w, self.v = float(base), np.zeros(n), np.random.default_rng(5).normal(0, 0.02, (n, FACTORS))

    def raw(self, ids: list[int]) -> float:
        if not ids:
            return self.bias
        v = self.v[ids]
        s = v.sum(axis=0)
        return self.bias + self.w[ids].sum() + 0.5 * float((s * s - (v * v).sum(axis=0)).sum())

    def score(self, ids: list[int]) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.raw(ids), -30, 30))))

    def fit(self, rows: list[list[int]], y: np.ndarray, epochs: int = 40, rate: float = 0.2, l2: float = 1e-5, batch: int = 128, seed: int = 9) -> "Machine":
        flat = np.array([i for r in rows for i in r], np.int64)
        start = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        rng = np.random.default_rng(seed)
        ones = y.sum()
        weight = np.where(y == 1, np.sqrt(max(1.0, (len(y) - ones) / max(1.0, ones))), 1.0)  # the rarer label counts more
        gw, gv, gb = np.full(self.w.shape, 1e-2), np.full(self.v.shape, 1e-2), 1e-2
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for b in range(0, len(order), batch):
                part = order[b : b + batch]
                ids = np.concatenate([flat[start[i] : start[i + 1]] for i in part]) if len(part) else flat[:0]
                doc = np.repeat(np.arange(len(part)), [start[i + 1] - start[i] for i in part])
                v = self.v[ids]
                s = np.zeros((len(part), FACTORS))
                np.add.at(s, doc, v)
                square = np.bincount(doc, (v * v).sum(axis=1), len(part))
                z = self.bias + np.bincount(doc, self.w[ids], len(part)) + 0.5 * ((s * s).sum(axis=1) - square)
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * weight[part] / len(part)
                gb += g.sum() ** 2
                self.bias -= rate * g.sum() / np.sqrt(gb)
                used, back = np.unique(ids, return_inverse=True)
                step = np.bincount(back, g[doc], len(used)) + l2 * self.w[used]
                gw[used] += step**2
                self.w[used] -= rate * step / np.sqrt(gw[used])
                pull = g[doc][:, None] * (s[doc] - v)
                step = np.stack([np.bincount(back, pull[:, f], len(used)) for f in range(FACTORS)], axis=1) + l2 * self.v[used]
                gv[used] += step**2
                self.v[used] -= rate * step / np.sqrt(gv[used])
        return self


def first_machine(rows: list[np.ndarray], y: np.ndarray, terms: int, epochs: int = 12, rate: float = 0.2, decay: float = 2e-4, batch: int = 64, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Weights and norms of the factors of a machine on unit-length inputs, fitted by AdaGrad with weight decay."""
    rng, ones = np.random.default_rng(seed), y.sum()
    weight = np.where(y == 1, np.sqrt(max(1.0, (len(y) - ones) / max(1.0, ones))), 1.0)
    w, v, bias = np.zeros(terms, np.float32), rng.normal(0, 0.02, (terms, FACTORS)).astype(np.float32), np.log(ones / (len(y) - ones))
    gw, gv, gb = np.full(terms, 1e-2, np.float32), np.full(terms, 1e-2, np.float32), 1e-2
    filled = np.array([i for i in rng.permutation(len(rows)) if len(rows[i])], np.int64)
    parts = []
    for at in range(0, len(filled), batch):  # what a batch touches is the same in each epoch
        part = filled[at : at + batch]
        sizes = np.array([len(rows[i]) for i in part])
        used, back = np.unique(np.concatenate([rows[i] for i in part]), return_inverse=True)
        order = np.argsort(back, kind="stable")
        parts.append((part, used, back, sizes, np.cumsum(sizes) - sizes, np.repeat(np.arange(len(part)), sizes), order, np.searchsorted(back[order], np.arange(len(used)))))
    for _ in range(epochs):
        for k in rng.permutation(len(parts)):
            part, used, back, sizes, start, doc, order, first = parts[k]
            scale = (1.0 / np.sqrt(sizes)).astype(np.float32)
            x = v[used][back] * scale[doc][:, None]
            s = np.add.reduceat(x, start, axis=0)
            z = bias + np.add.reduceat(w[used][back], start) * scale + 0.5 * ((s * s).sum(axis=1) - np.add.reduceat((x * x).sum(axis=1), start))
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * weight[part] / len(part)).astype(np.float32)
            gb += g.sum() ** 2
            bias -= rate * g.sum() / np.sqrt(gb)
            pull = (g * scale)[doc]
            step = np.add.reduceat(pull[order], first)
            gw[used] += step**2
            w[used] -= rate * step / np.sqrt(gw[used])
            step = np.add.reduceat((pull[:, None] * (s[doc] - x))[order], first, axis=0)
            gv[used] += (step**2).sum(axis=1)
            v[used] -= rate * step / np.sqrt(gv[used])[:, None]
            w *= np.float32(1 - rate * decay)
            v *= np.float32(1 - rate * decay)
    return w, np.sqrt((v * v).sum(axis=1))


def _term_lists(batches):
    terms = Terms()
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("h"), pa.array([terms.of(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))], names=["label", "h", "terms"])


def train(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_ROWS) -> Machine:
    """docs (doc_id, text), labels (doc_id, label 0/1)."""
    known = labels.where("label in (0, 1) and doc_id is not null")
    chosen = bounded_ids(known, per_label, "label")
    if not chosen:
        return Machine(np.zeros(0, np.int64), -30.0)
    spark = docs.sparkSession
    sample = spark.createDataFrame([(int(i), int(v)) for i, v in sorted(set(chosen))], "doc_id long, label int")
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    got = joined.select("label", F.xxhash64("doc_id", "text").alias("h"), "text").mapInArrow(_term_lists, "label int, h long, terms array<int>")
    got = got.orderBy("h").limit(2 * len(chosen)).toArrow()
    y = np.array(got.column("label").to_pylist(), float)
    rows = [np.array(t, np.int64) for t in got.column("terms").to_pylist()]
    order = sorted(range(len(rows)), key=lambda i: (y[i], len(rows[i]), rows[i].tobytes()))  # a row order that no task order changes
    y, rows = y[order], [rows[i] for i in order]
    if len(set(y.tolist())) < 2:
        return Machine(np.zeros(0, np.int64), 30.0 if len(y) and y[0] else -30.0)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    buckets = _chosen_terms(rows, y)
    model = Machine(buckets, np.log(share / (1 - share)))
    return model.fit([[model.numbers[i] for i in r.tolist() if i in model.numbers] for r in rows], y)


def _chosen_terms(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The buckets of the terms that the final machine knows."""
    buckets, at = np.unique(np.concatenate(rows), return_inverse=True)
    marks = np.repeat(y, [len(r) for r in rows])
    one, both = np.bincount(at, marks, len(buckets)), np.bincount(at, minlength=len(buckets))
    often = np.flatnonzero(both >= MIN_DOCS)
    if not len(often):
        return buckets[:0]
    number = np.full(len(buckets), -1, np.int64)
    number[often] = np.arange(len(often))
    parts = np.split(number[at], np.cumsum([len(r) for r in rows])[:-1])
    w, v = first_machine([p[p >= 0] for p in parts], y, len(often))
    one, both = one[often], both[often]
    n1, n0, p = y.sum(), len(y) - y.sum(), both / len(y)
    spread = np.sqrt(p * (1 - p))
    z = np.abs(one / n1 - (both - one) / n0) / np.maximum(spread * np.sqrt(1 / n1 + 1 / n0), 1e-9)
    keep = z >= MIN_Z
    keep[np.argsort(-(np.abs(w) + v) * spread, kind="stable")[:PAIR_TERMS]] = True
    return buckets[often[keep]]


def _scores(model: Machine):
    def run(batches):
        terms = Terms.of_process(model.numbers)
        for batch in batches:
            values = [model.score(terms.of(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(values, pa.float64()), pa.array([int(v >= 0.7) for v in values], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return run


def toxicity(docs: DataFrame, model: Machine) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, score, predicted."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    return rows.mapInArrow(_scores(model), "doc_id long, held_out boolean, score double, predicted int")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return toxicity(docs, train(docs, labels.where(fold(F.col("doc_id"), 3) != 1)))
