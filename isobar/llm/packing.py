"""Packing by shortest-pack-first over the length histogram.

Documents are tokenised (ids plus a separator id) and cut into pieces of at most MAX_TOKENS. The histogram of piece lengths
(MAX_TOKENS rows at most, whatever the corpus) goes to the driver, where lengths are placed longest first: each batch of
equal pieces goes to the open patterns with the most room left, splitting a pattern's count where needed, or opens new
ones. Pieces then find their place by rank: the r-th piece of a length belongs to the slot whose range of ranks holds r.
The slot table has at most a few slots per (pattern, distinct length); its size is checked against MAX_SLOTS and it is
joined instead of shipped when it is larger.

Tokenising is remembered per word for as long as the Python worker lives: a word is looked up, not merged again. New words
are cut into units (the runs of letters, digits and signs that the tokenizer itself cuts a text into) and merged together by
the vocabulary's own merges; words with characters outside a plain set are given to the tokenizer as they are. No token
spans white space, so the ids are its own.

Null and empty texts are one piece with the separator only. Equal rows are packed each. Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import gapless_rank, materialize, process_memory, read_table

MAX_TOKENS = 4096
SEPARATOR_ID = 2
MAX_SLOTS = 2_000_000
#: Words remembered per worker process (about 200 bytes each) before it starts afresh, and texts encoded at a time.
CACHE_WORDS = 600_000
STEP_TEXTS = 200


#: Characters whose reading by the tokenizer is plain: letters, digits and signs that its normaliser only lower-cases.
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff\u0153"
_ODD = re.compile(f"[^\\x20-\\x7e\\t\\n\\r{_LETTERS}\u00c0-\u00d6\u00d8-\u00de\u0152\u2018\u2019\u201c\u201d\u2013\u2014\u2026\u20ac\u00ab\u00bb\u00a1\u00bf]|<\\|")
_UNIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s{_LETTERS}0-9]+")


def _raw_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Ids:
    """The ids of texts, remembered by word (a run without white space) as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.known: dict[str, bytes] = {}  # a plain dict: sets subtract it quickly
        self.whole = Tokenizer.from_file(path)
        # the same merges in the same order for many words at a time: a NUL stands for a unit's end, and joins first
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, raw, end = model["vocab"], _raw_bytes(), model["end_of_word_suffix"]
        as_bytes = lambda token: bytes(raw[c] for c in token.removesuffix(end)) + b"\0" * token.endswith(end)
        order = {bytes([b]): vocabulary[c] for c, b in raw.items()} | {bytes([b, 0]): vocabulary[c + end] for c, b in raw.items()}
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            order.setdefault(as_bytes(left + right), vocabulary[left + right])
        self.numbers = np.array(list(order.values()), "<u4")
        self.line = list(order).index(b"\n")
        self.merger = tiktoken.Encoding("words", pat_str="[^\0\n]+\0|\n", mergeable_ranks={b: i for i, b in enumerate(order)}, special_tokens={})

    def learn(self, words: list[str]) -> None:
        odd = [w for w in words if not (w.isascii() and w.isprintable() and "<|" not in w) and _ODD.search(w)]
        for word, found in zip(odd, self.whole.encode_batch_fast(odd, add_special_tokens=False)):
            self.known[word] = np.asarray(found.ids, "<u4").tobytes()
        plain = words if not odd else list(set(words).difference(odd))
        if plain:
            marked = _UNIT.sub("\\g<0>\0", "\n".join(plain).lower())
            ranks = np.array(self.merger.encode_ordinary(marked + "\n"), np.int64)
            ends = np.flatnonzero(ranks == self.line).tolist()
            data, start = self.numbers[ranks].tobytes(), 0
            for word, stop in zip(plain, ends, strict=True):
                self.known[word] = data[4 * start : 4 * stop]
                start = stop + 1

    @staticmethod
    def words(text: str) -> list[str]:
        flat = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        if not flat.isprintable():  # a space of another kind, perhaps
            return [w for w in flat.split(" ") if w]
        return (flat.lower() if flat.isascii() and "<|" not in flat else flat).split()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The tokenizer's ids of each text."""
        words = [self.words(t) for t in texts]
        new = set().union(*words).difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            if len(texts) > 1:
                middle = len(texts) // 2
                return self.encode_all(texts[:middle]) + self.encode_all(texts[middle:])
            self.known.clear()
            if len(words[0]) > CACHE_WORDS // 2:
                return [b"".join([self.encode_all([" ".join(words[0][i : i + CACHE_WORDS // 2])])[0] for i in range(0, len(words[0]), CACHE_WORDS // 2)])]
            new = set(words[0])
        self.learn(list(new))
        return [b"".join(map(self.known.__getitem__, w)) for w in words]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def ids_of(path: str) -> Ids:
    """This process's tokenizer and memory: a Python worker serves many tasks and keeps what earlier ones learned."""
    return process_memory(("ids", path), lambda: Ids(path))


def _pieces(path: str, max_tokens: int, separator: int):
    def run(batches):
        ids, end = ids_of(path), np.asarray([separator], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            encoded = (x for i in range(0, len(texts), STEP_TEXTS) for x in ids.encode_all(texts[i : i + STEP_TEXTS]))
            for doc, found in zip(batch.column("doc_id").to_pylist(), encoded):
                found += end
                total = len(found) // 4
                for start in range(0, total, max_tokens):
                    part = found[4 * start : 4 * (start + max_tokens)]
                    rows.append((doc, start, len(part) // 4, zlib.crc32(part), total))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """length -> count into patterns: (how many packs, [(length, pieces of it), ...]); lengths longest first, shortest pack first."""
    open_packs: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}  # room left -> patterns
    room = capacity  # upper bound of the rooms in use
    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left = counts[length]
        while left:
            while room >= length and not open_packs.get(room):
                room -= 1
            if room >= length:
                packs, pattern = open_packs[room].pop()
                fits = room // length
                if fits > 1 and left >= packs * 2:
                    each = min(fits, left // packs)
                    used = packs
                else:
                    each, used = 1, min(packs, left)
                if used < packs:
                    open_packs[room].append((packs - used, pattern))
                left -= used * each
                open_packs.setdefault(room - each * length, []).append((used, [*pattern, (length, each)]))
            else:
                each = min(capacity // length, left)
                used = left // each
                left -= used * each
                rest = capacity - each * length
                open_packs.setdefault(rest, []).append((used, [(length, each)]))
                room = max(room, rest)
    return [p for packs in open_packs.values() for p in packs]


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> pd.DataFrame:
    """One row per (pattern, length): ranks [first_rank, first_rank + packs * each) of that length sit in packs from sequence."""
    rows, ranks, sequence = [], {}, 0
    for packs, pattern in patterns:
        at = 0
        for length, each in pattern:
            first = ranks.get(length, 0)
            rows.append((length, first, packs * each, each, sequence, at))
            ranks[length] = first + packs * each
            at += length * each
        sequence += packs
    out = pd.DataFrame(rows, columns=["length", "first_rank", "ranks", "each", "sequence", "at"], dtype="int64")
    return out.sort_values(["length", "first_rank"], ignore_index=True)


def _place(table: pd.DataFrame):
    columns = {c: table[c].to_numpy() for c in table.columns}
    shift = np.int64(1) << np.int64(44)
    keys = columns["length"] * shift + columns["first_rank"]

    def run(frames):
        for f in frames:
            slot = np.searchsorted(keys, f.length.to_numpy() * shift + f["rank"].to_numpy(), side="right") - 1
            inner = f["rank"].to_numpy() - columns["first_rank"][slot]
            each = columns["each"][slot]
            f["sequence_id"] = columns["sequence"][slot] + inner // each
            f["offset"] = columns["at"][slot] + (inner % each) * f.length.to_numpy()
            yield f.drop(columns="rank")

    return run


def pack(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, separator: int = SEPARATOR_ID) -> DataFrame:
    """docs (doc_id, text) -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    shape = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(tokenizer_path, max_tokens, separator), shape), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    table = slots(pack_histogram(counts, max_tokens))
    ranked = gapless_rank(pieces, "length", counts, ["doc_id", "start", "ids_crc32"], "rank")
    if len(table) <= MAX_SLOTS:
        return ranked.mapInPandas(_place(table), f"{shape}, sequence_id long, offset long")
    spread = docs.sparkSession.createDataFrame(table)
    inner = F.col("rank") - F.col("first_rank")
    joined = ranked.join(spread, "length").where((inner >= 0) & (inner < F.col("ranks")))
    return joined.select(*pieces.columns, (F.col("sequence") + F.expr("(rank - first_rank) div each")).alias("sequence_id"), (F.col("at") + inner % F.col("each") * F.col("length")).alias("offset"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), tokenizer_path())
