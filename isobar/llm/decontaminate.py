"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

For a benchmark item of w words, every window of w words of a document has a BITS-bit SimHash over its 5-word shingles. The
n-th occurrence of a shingle in a window is an element of its own, so that the weighted similarity sum(min) / sum(max) of
two windows is the plain one of two sets of elements, however often a shingle repeats. A fingerprint is looked up in a
multi-index: BITS/8 blocks, each with a table of the items whose block lies within floor(RADIUS / blocks) bits; by the
pigeonhole principle no item within RADIUS is missed. Items found are then held to the distance itself, and those that
remain to the exact weighted-shingle similarity of the window and the item, at least 75 percent.

Only windows that hold a shingle of some item are fingerprinted: all other windows have similarity 0. RADIUS is 4.5 standard
deviations over the expected distance at similarity 0.75: of windows at exactly that similarity some 3 in a million lie
farther, of more similar ones fewer.

The benchmark is a stated query set. It is read in blocks of at most ITEM_BLOCK items, each block shipped to the tasks and
held against all documents; more items mean more passes, not a larger shipment.

Null or empty texts and items match nothing. A text shorter than an item is one window. Repeated rows are each reported.
Extra columns are ignored; with no documents or no items the result is empty.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import SQL_SHINGLES, SQL_WORDS, WordHash, mix64, read_table, shingle_hashes, word_hashes

BITS = 128
RADIUS = 42
ITEM_BLOCK = 10_000
_SEEDS = np.array([0x51, 0xA7], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xD6E8FEB86659FD93)
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def shingle_bits(shingles: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """(n, BITS) of -1 and 1: the random signs of the turn-th occurrences of shingles, turns from 0."""
    own = shingles + turns.astype(np.uint64) * _TURN
    words = np.stack([mix64(own + s) for s in _SEEDS], axis=1)
    bits = np.unpackbits(words.view(np.uint8).reshape(len(shingles), BITS // 8), axis=1)
    return bits.astype(np.int8) * 2 - 1


def simhashes(shingles: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints (bytes) of all runs of `width` shingles.

    A run that moves on by one loses the last occurrence of the shingle that leaves and gains the next one of that which enters.
    """
    n = len(shingles)
    _, kind = np.unique(shingles, return_inverse=True)
    if kind.max(initial=0) == n - 1:  # no shingle repeats
        enters = leaves = shingle_bits(shingles, np.zeros(n, np.int64))
    else:
        place = np.sort(kind * n + np.arange(n))  # by shingle, then position
        order = place % n
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        start = np.searchsorted(place, kind * n + np.maximum(np.arange(n) - width + 1, 0))
        end = np.searchsorted(place, kind * n + np.minimum(np.arange(n) + width, n))
        enters = shingle_bits(shingles, rank - start)  # occurrences in the window that ends here, before this one
        leaves = shingle_bits(shingles, end - rank - 1)  # occurrences in the window that starts here, after this one
    total = np.zeros((n - width + 1, BITS), np.int32)
    total[0] = enters[:width].sum(axis=0, dtype=np.int32)
    if n > width:
        np.cumsum(enters[width:].astype(np.int32) - leaves[: n - width], axis=0, out=total[1:])
        total[1:] += total[0]
    return np.packbits(total > 0, axis=1)


class Items:
    """A block of the benchmark: shingles, fingerprints and the multi-index."""

    def __init__(self, rows: list[tuple[int, bytes]], k: int):
        cache = WordHash()
        self.ids, self.sizes, self.shingles, prints = [], [], [], []
        for item, text in rows:
            words = word_hashes(text or b"", cache)
            s = shingle_hashes(words, k)
            if len(s):
                self.ids.append(item)
                self.sizes.append(len(words))
                self.shingles.append(s)
                prints.append(simhashes(s, len(s))[0])
        self.prints = np.array(prints, np.uint8).reshape(-1, BITS // 8)
        every = np.concatenate(self.shingles) if self.shingles else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(self.ids)), [len(s) for s in self.shingles])
        order = np.argsort(every, kind="stable")
        self.known, self.owner = every[order], owner[order]
        self.sieve = np.zeros(2**22, bool)
        self.sieve[(self.known >> np.uint64(42)).astype(np.int64)] = True
        near = _POPCOUNT[np.arange(256)[:, None] ^ np.arange(256)[None, :]] <= RADIUS // (BITS // 8)
        # index[b, value] = packed set of the items whose block b is near value
        self.index = np.stack([np.packbits(near[:, self.prints[:, b]], axis=1) for b in range(BITS // 8)])

    def counts(self, item: int) -> Counter:
        return Counter(self.shingles[item].tolist())

    def hits(self, shingles: np.ndarray) -> np.ndarray:
        """Positions whose shingle belongs to an item."""
        at = np.flatnonzero(self.sieve[(shingles >> np.uint64(42)).astype(np.int64)])
        if len(at):
            found = np.minimum(np.searchsorted(self.known, shingles[at]), len(self.known) - 1)
            at = at[self.known[found] == shingles[at]]
        return at

    def owners(self, values: np.ndarray) -> set[int]:
        low, high = np.searchsorted(self.known, values, "left"), np.searchsorted(self.known, values, "right")
        return {int(o) for a, b in zip(low, high) for o in self.owner[a:b]}

    def within(self, prints: np.ndarray) -> list[tuple[int, int, int]]:
        """(row of prints, item, distance) of all items within RADIUS, found through the multi-index."""
        packed = self.index[0][prints[:, 0]]
        for b in range(1, BITS // 8):
            packed = packed | self.index[b][prints[:, b]]
        rows, items = np.nonzero(np.unpackbits(packed, axis=1)[:, : len(self.ids)])
        distance = _POPCOUNT[prints[rows] ^ self.prints[items]].sum(axis=1)
        keep = distance <= RADIUS
        return list(zip(rows[keep].tolist(), items[keep].tolist(), distance[keep].tolist()))


def similarity_at_least(left: Counter, right: Counter, percent: int) -> float | None:
    both = sum(min(n, right[s]) for s, n in left.items() if s in right)
    either = sum(left.values()) + sum(right.values()) - both
    return both / either if 100 * both >= percent * either else None


def match(shingles: np.ndarray, n_words: int, items: Items, percent: int, k: int) -> list[tuple[int, float, int]]:
    """(item, similarity, first word) of the best window of a text for each item that reaches the threshold."""
    at = items.hits(shingles)
    best: dict[int, tuple[float, int]] = {}
    goals: dict[int, Counter] = {}
    if not len(at):
        return []
    widths = {}
    for o in items.owners(np.unique(shingles[at])):
        widths.setdefault(min(items.sizes[o], n_words), []).append(o)
    for words in widths:
        width = max(1, words - k + 1)
        last = len(shingles) - width
        starts = np.unique(np.clip((at[:, None] - np.arange(width)[None, :]).ravel(), 0, last))
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
            for head in range(0, len(run), 4096):
                a, b = int(run[head]), int(run[min(head + 4096, len(run)) - 1])
                prints = simhashes(shingles[a : b + width], width)
                found = sorted(items.within(prints), key=lambda x: (x[2], x[0]))
                for row, item, _ in found:
                    if min(items.sizes[item], n_words) != words:
                        continue
                    if item not in goals:
                        goals[item] = items.counts(item)
                    window = Counter(shingles[a + row : a + row + width].tolist())
                    value = similarity_at_least(window, goals[item], percent)
                    if value is not None and (item not in best or (-value, a + row) < (-best[item][0], best[item][1])):
                        best[item] = (value, a + row)
    return [(items.ids[i], v, s) for i, (v, s) in sorted(best.items())]


def _matches(items: Items, percent: int, k: int):
    def run(batches):
        cache = WordHash.of_process()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                words = word_hashes(text or b"", cache)
                if len(words):
                    rows += [(doc, *m) for m in match(shingle_hashes(words, k), len(words), items, percent, k)]
            doc_ids, item_ids, values, starts = list(zip(*rows)) or ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(item_ids, pa.int64()), pa.array(values, pa.float64()), pa.array(starts, pa.int64())], names=["doc_id", "item_id", "similarity", "first_word"])

    return run


def _blocks(benchmark: DataFrame, item_block: int, k: int):
    """The benchmark's items in blocks of bounded size."""
    queries = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text is not null").distinct()
    blocks = max(1, -(-queries.count() // item_block))
    for block in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        yield Items([(r[0], bytes(r[1])) for r in rows], k)


def contamination(docs: DataFrame, benchmark: DataFrame, percent: int = 75, k: int = 5, item_block: int = ITEM_BLOCK) -> DataFrame:
    """One row per (document, item) with a window at least `percent` similar: doc_id, item_id, similarity, first_word."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shape = "doc_id long, item_id long, similarity double, first_word long"
    parts = [docs.mapInArrow(_matches(items, percent, k), shape) for items in _blocks(benchmark, item_block, k)]
    return reduce(DataFrame.unionByName, parts)


def _clean(items: Items, percent: int, k: int):
    def run(batches):
        cache = WordHash.of_process()
        for batch in batches:
            keep = []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = word_hashes(text or b"", cache)
                keep.append(not len(words) or not match(shingle_hashes(words, k), len(words), items, percent, k))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def uncontaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 75, k: int = 5, item_block: int = ITEM_BLOCK) -> DataFrame:
    """The rows of docs, all columns, without a window that matches an item; rows are judged one by one and nothing is shuffled."""
    for items in _blocks(benchmark, item_block, k):
        docs = docs.mapInArrow(_clean(items, percent, k), docs.schema)
    return docs


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


#: Every window of an item's length that holds one of its shingles, compared on full counts; the best window of each pair.
ORACLE = f"""with d as (select doc_id, {SQL_WORDS} as w from documents), q as (select item_id, {SQL_WORDS} as w from benchmark where text is not null),
 ds as (select doc_id, len(w) as words, unnest({SQL_SHINGLES}) as x, unnest(range(0, greatest(1, len(w) - 4))) as pos from d where len(w) > 0), qs as (select item_id, len(w) as words, unnest({SQL_SHINGLES}) as x from q where len(w) > 0),
 qc as (select item_id, words, x, count(*) as c from qs group by 1, 2, 3), ql as (select item_id, sum(c) as total from qc group by 1),
 h as (select doc_id, item_id, ds.x, pos, c, greatest(1, least(qc.words, ds.words) - 4) as width, greatest(1, ds.words - 4) - greatest(1, least(qc.words, ds.words) - 4) as last from ds join qc on ds.x = qc.x),
 st as (select distinct doc_id, item_id, width, unnest(range(greatest(0, pos - width + 1), least(pos, last) + 1)) as p from h),
 g as (select st.doc_id, st.item_id, st.width, p, h.x, least(count(*), any_value(c)) as k from st join h on h.doc_id = st.doc_id and h.item_id = st.item_id and h.pos >= p and h.pos < p + st.width group by 1, 2, 3, 4, 5),
 b as (select g.doc_id, g.item_id, p, sum(k) as shared, any_value(width) + any_value(total) - sum(k) as either from g join ql using (item_id) group by 1, 2, 3),
 o as (select *, row_number() over (partition by doc_id, item_id order by shared / either::double desc, p) as rank from b where 100 * shared >= 75 * either)
 select doc_id, item_id, shared::double / either::double as similarity, p::bigint as first_word from o where rank = 1"""
