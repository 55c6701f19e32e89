"""Language identification with a linear-chain conditional random field.

Words (runs of letters by Unicode class, lower-cased) are labelled with languages. A run of more than LETTERS letters (a clause, in scripts
without spaces) is read whole, as pieces that overlap by two letters, each a word of its own. A word's features are its affixes, its character n-grams
and itself if the lexicon of the training words holds it; label-to-label transitions are learned with them by maximising the
conditional likelihood with forward-backward. Documents carry one language each, so training chains are spliced from spans
of several documents: the transitions then learn how code-switched text changes language. A document's answer is the
label with the largest mean posterior over all its words, its score that mean.

A document is one chain, whatever its length. It is worked on in pieces of PIECE words, all pieces of a batch together, one
step of small matrix products per word position: first each piece's transfer from its left to its right border, then, piece
after piece, what reaches the borders from both ends of the document, then the posteriors inside. With many labels, where a
transfer costs more than it saves, documents go through from end to end. A word's label scores are remembered, so
features are built once per word and worker. Each word has the label of its largest posterior; their counts are returned.

The training sample is bounded: TRAIN_DOCS documents of each language (those with the smallest hash of doc_id; at most twice as
many rows where ids repeat), SPANS spans of each; all languages are learned, however many, and batches and memories shrink as their number grows. Null or letterless texts give `und` with score 0. A null doc_id has a null held_out. Repeated rows are labelled
each. Extra columns are ignored. With no labelled row every text is `und`; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import CACHE_WORDS, bounded_ids, fold, process_memory, read_table

TRAIN_DOCS = 150
SPANS = 24
#: Words of a piece of a chain, and labels up to which pieces are worked on side by side.
PIECE, SIDE_BY_SIDE = 64, 24
FEATURES = 2**16
#: Labels up to which batches have their full size.
WIDE = 16
#: Letters of the longest word; longer runs of letters are read in pieces.
LETTERS = 24
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """The words of a text; pieces of a long run share two letters, so that each of its trigrams is in just one."""
    words = _WORD.findall(text.lower()) if text else []
    if not all(map(str.isalpha, words)):  # fractions, superscripts and the like are no letters
        words = [w for x in words for w in (_letters(x) if not x.isalpha() else (x,))]
    if words and max(map(len, words)) > LETTERS:
        words = [w[i : i + LETTERS] for w in words for i in range(0, max(1, len(w) - 2), LETTERS - 2)]
    return words


def _letters(run: str) -> list[str]:
    return "".join(c if c.isalpha() else " " for c in run).split()


def word_features(words: list[str], lexicon: dict[str, int]) -> np.ndarray:
    """(n, WIDTH) hashed features of each word of at most LETTERS letters: bigrams and trigrams of <word>, affixes of 1 to 3, itself if known; FEATURES pads."""
    n = len(words)
    size = np.fromiter(map(len, words), np.int64, n)
    text = "".join([f"<{w}>".ljust(LETTERS + 2, "\0") for w in words])
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(n, LETTERS + 2)
    at = np.arange(LETTERS + 2)
    tail = lambda k: np.take_along_axis(c, np.clip(size + 1 - k, 1, None)[:, None], axis=1)[:, 0]  # noqa: E731  k-th letter from the end

    def hashed(kind: int, *letters: np.ndarray) -> np.ndarray:
        h = np.full(letters[0].shape, kind, np.uint32)
        for x in letters:
            h = (h ^ x) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        return (h % np.uint32(FEATURES)).astype(np.int32)

    two = np.where(at[None, 1:] <= size[:, None] + 1, hashed(2, c[:, :-1], c[:, 1:]), FEATURES)
    three = np.where(at[None, 2:] <= size[:, None] + 1, hashed(3, c[:, :-2], c[:, 1:-1], c[:, 2:]), FEATURES)
    first = [hashed(10 + k, *[c[:, 1 + j] for j in range(k)]) for k in (1, 2, 3)]
    last = [hashed(20 + k, *[tail(j) for j in range(k, 0, -1)]) for k in (1, 2, 3)]
    own = np.fromiter((lexicon.get(w, FEATURES) for w in words), np.int32, n)
    return np.concatenate([two, three, np.stack([*first, *last, own], axis=1)], axis=1).astype(np.int32)


def forward_backward(scores: np.ndarray, mask: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """scores (T, N, K), mask (T, N) -> posteriors (T, N, K), expected transitions (K, K), log partition (N)."""
    steps, chains, labels = scores.shape
    top = scores.max(axis=2, keepdims=True)
    e = np.exp(scores - top)
    a, start = np.exp(trans), np.exp(first)
    alpha, scale = np.empty_like(e), np.ones((steps, chains))
    now = e[0] * start
    for t in range(steps):
        if t:
            step = (now @ a) * e[t]
            now = np.where(mask[t][:, None], step, now)
        total = now.sum(axis=1)
        now = now / total[:, None]
        scale[t] = total
        alpha[t] = now
    post, expected = np.empty_like(e), np.zeros((labels, labels))
    beta = np.ones((chains, labels))
    post[steps - 1] = alpha[steps - 1]
    for t in range(steps - 2, -1, -1):
        live = mask[t + 1][:, None]
        out = e[t + 1] * beta / scale[t + 1][:, None]
        expected += a * ((alpha[t] * live).T @ (out * live))
        beta = np.where(live, out @ a.T, beta)
        post[t] = alpha[t] * beta
    post = post / post.sum(axis=2, keepdims=True)
    log_z = (np.log(scale) * mask).sum(axis=0) + (top[:, :, 0] * mask).sum(axis=0)
    return post, expected, log_z


def _advance(now: np.ndarray, e: np.ndarray, live: np.ndarray, a: np.ndarray, inits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """One forward step of (N, K) weights, scaled to sum 1, and their scale; inits marks chains whose first word this is."""
    step = now @ a
    if inits is not None:
        step = np.where(inits, now, step)
    step *= e
    total = np.maximum(step.sum(axis=1), 1e-300)
    return np.where(live, step / total[:, None], now), np.where(live[:, 0], np.log(total), 0.0)


def chain_posteriors(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Label posteriors (n, K) of the words of many chains laid end to end; scores (n, K), lengths (chains)."""
    k = scores.shape[1]
    width = PIECE if k <= SIDE_BY_SIDE else max(1, int(lengths.max(initial=1)))
    pieces = -(-lengths // width)
    count = int(pieces.sum())
    out = np.zeros((len(scores), k))
    if not count:
        return out
    begin = np.concatenate([[0], np.cumsum(pieces)])[:-1]
    chain = np.repeat(np.arange(len(lengths)), pieces)
    number = np.arange(count) - begin[chain]
    inside = np.arange(width)[:, None] < np.minimum(lengths[chain] - number * width, width)[None, :]
    at = (np.concatenate([[0], np.cumsum(lengths)])[:-1][chain] + number * width)[None, :] + np.arange(width)[:, None]
    at = np.where(inside, at, 0)
    e = scores[at].astype(np.float64)
    e = np.exp(e - e.max(axis=2, keepdims=True))
    a, starts = np.exp(trans - trans.max()), (number == 0)[:, None]
    left = np.tile(np.exp(first - first.max()) / np.exp(first - first.max()).sum(), (count, 1))
    right = np.ones((count, k))
    if pieces.max() > 1:
        many = np.flatnonzero((pieces > 1)[chain])
        # the transfer of a piece: what a weight on each label at its left border becomes at its right border
        flow, scale = np.tile(np.eye(k), (len(many), 1)), np.zeros(len(many) * k)
        for t in range(width):
            live = np.repeat(inside[t, many], k)[:, None]
            flow, more = _advance(flow, np.repeat(e[t, many], k, axis=0), live, a, np.repeat(starts[many], k, axis=0) if t == 0 else None)
            scale += more
        flow, scale = flow.reshape(-1, k, k), scale.reshape(-1, k)
        place = np.full(count, -1)
        place[many] = np.arange(len(many))
        deepest = int(pieces.max())
        for c in range(1, deepest):
            here = np.flatnonzero(number == c)
            before = place[here - 1]
            w = np.log(np.maximum(left[here - 1], 1e-300)) + scale[before]
            w = np.exp(w - w.max(axis=1, keepdims=True))
            v = (w[:, None, :] @ flow[before])[:, 0]
            left[here] = v / v.sum(axis=1, keepdims=True)
        for c in range(deepest - 1, 0, -1):
            here = np.flatnonzero(number == c)
            own = place[here]
            v = (flow[own] @ right[here][:, :, None])[:, :, 0]
            w = np.log(np.maximum(v, 1e-300)) + scale[own]
            w = np.exp(w - w.max(axis=1, keepdims=True))
            right[here - 1] = w / w.sum(axis=1, keepdims=True)
    alpha = np.empty_like(e)
    now = left
    for t in range(width):
        now, _ = _advance(now, e[t], inside[t][:, None], a, starts if t == 0 else None)
        alpha[t] = now
    beta = right
    for t in range(width - 1, -1, -1):
        post = alpha[t] * beta
        here = inside[t]
        out[at[t, here]] = post[here] / np.maximum(post[here].sum(axis=1, keepdims=True), 1e-300)
        if t:
            back = (e[t] * beta) @ a.T
            back /= np.maximum(back.sum(axis=1, keepdims=True), 1e-300)
            beta = np.where(here[:, None], back, beta)
    return out


class Crf:
    def __init__(self, labels: list[str], lexicon: list[str]):
        self.labels = labels
        self.lexicon = {w: FEATURES + 1 + i for i, w in enumerate(lexicon)}
        k = len(labels)
        self._name: bytes | None = None
        self.weights, self.trans, self.first = np.zeros((FEATURES + 1 + len(lexicon), k), np.float32), np.zeros((k, k)), np.zeros(k)

    def name(self) -> bytes:
        """Tells models apart."""
        if self._name is None:
            self._name = hashlib.sha256(b"".join([repr(self.labels).encode(), self.weights.tobytes(), self.trans.tobytes(), self.first.tobytes()])).digest()
        return self._name

    def emissions(self, words: list[str]) -> np.ndarray:
        """Label scores of each word."""
        parts = [self.weights[word_features(words[i : i + 4096], self.lexicon)].sum(axis=1) for i in range(0, len(words), 4096)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.labels)), np.float32)

    def fit(self, chains: list[tuple[list[str], np.ndarray]], epochs: int = 5, rate: float = 0.15, l2: float = 1e-6, seed: int = 3) -> "Crf":
        """AdaGrad on the negative conditional log-likelihood; chains are (words, label numbers)."""
        words = sorted({w for c, _ in chains for w in c})
        number = {w: i for i, w in enumerate(words)}
        features = word_features(words, self.lexicon)
        k, rng = len(self.labels), np.random.default_rng(seed)
        seen, seen_t, seen_f = np.full(self.weights.shape, 1e-6), np.full((k, k), 1e-6), np.full(k, 1e-6)
        steps = max(len(c) for c, _ in chains)
        ids, gold, mask = np.zeros((len(chains), steps), int), np.zeros((len(chains), steps), int), np.zeros((len(chains), steps), bool)
        for i, (c, y) in enumerate(chains):
            ids[i, : len(c)], gold[i, : len(c)], mask[i, : len(c)] = [number[w] for w in c], y, True
        for _ in range(epochs):
            order = rng.permutation(len(chains))
            for b in range(0, len(order), 64):
                part = order[b : b + 64]
                live, y = mask[part].T, gold[part].T
                used, inverse = np.unique(ids[part].T, return_inverse=True)
                feats = features[used]
                scores = self.weights[feats].sum(axis=1)[inverse.reshape(steps, -1)]
                post, expected, _ = forward_backward(scores, live, self.trans, self.first)
                delta = (post - np.eye(k)[y]) * live[:, :, None] / len(part)
                touched, back = np.unique(feats, return_inverse=True)
                back = back.reshape(feats.shape)
                per_word = np.stack([np.bincount(inverse.ravel(), delta[:, :, j].ravel(), len(used)) for j in range(k)], axis=1)
                grad = np.stack([np.bincount(back.ravel(), np.repeat(per_word[:, j], feats.shape[1]), len(touched)) for j in range(k)], axis=1)
                grad += l2 * self.weights[touched]
                grad[touched == FEATURES] = 0.0  # padding
                seen[touched] += grad**2
                self.weights[touched] -= rate * grad / np.sqrt(seen[touched])
                real = np.zeros((k, k))
                np.add.at(real, (y[:-1][live[1:]], y[1:][live[1:]]), 1)
                g = (expected - real) / len(part) + l2 * self.trans
                seen_t += g**2
                self.trans -= rate * g / np.sqrt(seen_t)
                g = delta[0].sum(axis=0)
                seen_f += g**2
                self.first -= rate * g / np.sqrt(seen_f)
        return self


class Labeller:
    """Label scores of words, remembered; whole documents through forward-backward."""

    def __init__(self, model: Crf):
        self.model, self.known = model, {}
        self.room = max(4096, min(CACHE_WORDS, 2**24 // max(1, len(model.labels))))
        self.table = np.zeros((self.room, len(model.labels)), np.float32)

    @classmethod
    def of_process(cls, model: Crf) -> "Labeller":
        """The labeller of a model in this Python worker, which serves many tasks."""
        return process_memory(("labeller", model.name()), lambda: cls(model))

    def scores(self, texts: list[list[str]]) -> list[np.ndarray]:
        new = list(set().union(*texts).difference(self.known))
        if len(self.known) + len(new) > self.room:
            if len(texts) > 1:  # fewer texts at a time, with an empty memory
                middle = len(texts) // 2
                return self.scores(texts[:middle]) + self.scores(texts[middle:])
            self.known.clear()
            half = self.room // 2
            if len(texts[0]) > half:
                return [np.concatenate([self.scores([texts[0][i : i + half]])[0] for i in range(0, len(texts[0]), half)])]
            new = list(set(texts[0]))
        at = len(self.known)
        self.table[at : at + len(new)] = self.model.emissions(new)
        self.known.update(zip(new, range(at, at + len(new))))
        return [self.table[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))] for words in texts]

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[int]]]:
        """The language, its mean posterior and the words of each language, for each text."""
        k = len(self.model.labels)
        nothing = ("und", 0.0, [0] * k)
        if not k or not texts:
            return [nothing] * len(texts)
        emissions = self.scores([words_of(t) for t in texts])
        lengths = np.array([len(e) for e in emissions])
        post = chain_posteriors(np.concatenate(emissions), lengths, self.model.trans, self.model.first)
        owner, filled = np.repeat(np.arange(len(texts)), lengths), np.flatnonzero(lengths)
        words = np.bincount(owner * k + post.argmax(axis=1), minlength=len(texts) * k).reshape(-1, k) if len(post) else np.zeros((len(texts), k), int)
        out = [nothing] * len(texts)
        if len(filled):
            means = np.add.reduceat(post, np.concatenate([[0], np.cumsum(lengths[filled])])[:-1], axis=0) / lengths[filled][:, None]
            for i, mean in zip(filled.tolist(), means):
                best = int(mean.argmax())
                out[i] = (self.model.labels[best], float(min(1.0, mean[best])), words[i].tolist())
        return out


def train(docs: DataFrame, per_language: int = TRAIN_DOCS, seed: int = 11) -> Crf:
    """Fits the field on a bounded sample of docs (doc_id, text, lang) with a language."""
    chosen = bounded_ids(docs.where("lang is not null and doc_id is not null").select("doc_id", "lang"), per_language, "lang")
    rows = docs.where(F.col("doc_id").isin([i for i, _ in chosen])).where("lang is not null").select("doc_id", "text", "lang")
    rows = rows.orderBy(F.xxhash64("doc_id", "text")).limit(2 * len(chosen)).collect() if chosen else []
    by_label: dict[str, list[list[str]]] = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["lang"], r["text"] or "")):
        words = words_of(r["text"])
        if words:
            by_label.setdefault(r["lang"], []).append(words)
    labels, rng = sorted(by_label), np.random.default_rng(seed)
    counts: dict[str, int] = {}
    for texts in by_label.values():
        for words in texts:
            for w in set(words):
                counts[w] = counts.get(w, 0) + 1
    lexicon = sorted(w for w, n in counts.items() if n >= 3)
    spans = []
    for number, label in enumerate(labels):
        for words in by_label[label]:
            for _ in range(SPANS):
                size = int(rng.integers(4, 17))
                start = int(rng.integers(0, max(1, len(words) - size + 1)))
                spans.append((words[start : start + size], number))
    rng.shuffle(spans)
    chains = []
    while spans:
        words, y = [], []
        for _ in range(min(len(spans), int(rng.integers(1, 4)))):
            part, number = spans.pop()
            words += part
            y += [number] * len(part)
        chains.append((words, np.array(y)))
    model = Crf(labels, lexicon)
    return model.fit(chains) if chains else model


_FOUND = "lang_pred string, score double, words array<struct<lang: string, words: long>>"


def _predict(model: Crf, keep: bool, least: float):
    kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))

    def run(batches):
        labeller = Labeller.of_process(model)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            step = max(1, 256 * WIDE // max(WIDE, len(model.labels)))
            found = [x for i in range(0, len(texts), step) for x in labeller.label(texts[i : i + step])]
            if keep:
                yield batch.filter(pa.array([x[0] != "und" and x[1] >= least for x in found], pa.bool_()))
                continue
            words = [[{"lang": lang, "words": n} for lang, n in zip(model.labels, x[2]) if n] for x in found]
            made = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array(words, kind)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *made], names=["doc_id", "held_out", "lang_pred", "score", "words"])

    return run


def identify(docs: DataFrame, model: Crf) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, lang_pred, score, words (how many words each language has)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return rows.mapInArrow(_predict(model, False, 0.0), f"doc_id long, held_out boolean, {_FOUND}")


def recognised(docs: DataFrame, model: Crf, least: float) -> DataFrame:
    """The rows of docs, all columns, whose language has at least this score; rows are judged one by one and nothing is shuffled."""
    return docs.mapInArrow(_predict(model, True, least), docs.schema)


def learn_folds(docs: DataFrame) -> Crf:
    return train(docs.where(fold(F.col("doc_id"), 5) != 0))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, learn_folds(docs))
