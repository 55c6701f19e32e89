"""Shared pieces: scratch tables, hold-out rule, word hashing, connected components, ranks without a global sort."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Label values that are sampled with a query each; more of them are ranked in one.
FEW_CLASSES = 16
#: Parts a class is dealt to before its rows are ranked, so that no task orders a whole class.
CLASS_PARTS = 64
#: A group is hot if it has more than this share (one in so many) of all rows.
HOT_SHARE = 400
#: Entries a worker keeps in a word cache before it starts afresh; bounds its memory whatever the vocabulary.
CACHE_WORDS = 400_000
#: The same for word hashes, which are cheap to make again.
HASH_WORDS = 100_000

_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """A folder of this session under spark.checkpoint.dir, which all executors share.

    Only where that setting is missing and Spark runs in one process (tests), a folder of our own is taken.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/checkpoints"
    key = f"{spark.sparkContext.applicationId}|{base}"
    if key not in _ROOTS:
        _ROOTS[key] = f"{base.rstrip('/')}/isobar-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _ROOTS[key])
    return _ROOTS[key]


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as a table in the shared scratch folder and reads it back: cuts lineage, survives lost executors."""
    path = f"{scratch_root(df.sparkSession)}/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes materialized tables that nothing will read again."""
    for t in tables:
        _remove(t.sparkSession, t.scratch_path)
    if tables:
        settle(tables[0].sparkSession)


def settle(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of finished steps: it does so when the driver's collector finds them unused."""
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where df has a column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def bounded_ids(candidates: DataFrame, per_class: int, label: str) -> list[tuple[int, object]]:
    """At most per_class ids of each label value, those with the smallest hash of the id: a repeatable sample.

    It grows with the label values only; every one of them is in it.
    """
    classes = [r[0] for r in candidates.where(F.col(label).isNotNull()).select(label).distinct().orderBy(label).limit(FEW_CLASSES + 1).collect()]
    if len(classes) > FEW_CLASSES:
        rows = candidates.where(F.col(label).isNotNull()).select(F.col("doc_id"), F.col(label).alias("_label"), F.xxhash64("doc_id").alias("_h"))
        for keys in (["_label", F.pmod("_h", F.lit(CLASS_PARTS))], ["_label"]):
            rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_h", "doc_id"))).where(F.col("_rank") <= per_class)
        return [(r[0], r[1]) for r in rows.orderBy("_label", "_rank").select("doc_id", "_label").collect()]
    out: list[tuple[int, object]] = []
    for value in classes:
        rows = candidates.where(F.col(label) == F.lit(value)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).select("doc_id").collect()
        out += [(r[0], value) for r in rows]
    return out


_MEMORY: dict[object, object] = {}


def process_memory(key: object, make: Callable[[], object]):
    """What this Python worker remembers under a key, made if it is not there. One thing at a time: a worker that goes on to
    another operator's tasks lets go of what the last one learned."""
    if key not in _MEMORY:
        if _MEMORY:
            _MEMORY.clear()
            give_back()
        _MEMORY[key] = make()
    return _MEMORY[key]


def give_back() -> None:
    """Returns freed memory to the system; allocators would keep it for this worker, which may idle long."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not glibc


class WordHash(dict):
    """word bytes -> 64-bit hash, remembered for up to HASH_WORDS words."""

    @classmethod
    def of_process(cls) -> "WordHash":
        """The memory of this Python worker, which serves many tasks."""
        return process_memory("words", cls)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HASH_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes(text: bytes, cache: WordHash) -> np.ndarray:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased (bytes.split and bytes.lower are ASCII-only)."""
    words = text.lower().split()
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """64-bit hash of each k-word shingle in order; fewer words give one shingle, none give none."""
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    out = words[: n - width + 1].copy()
    for j in range(1, width):
        out = mix64(out * _MUL + words[j : n - width + 1 + j])
    return mix64(out + np.uint64(width))


def connected_components(edges: DataFrame, tag: str) -> DataFrame:
    """(a, b) links -> (id, component): the smallest id reachable; only ids with a link appear.

    Alternating large-star and small-star steps; every step is two shuffles of integer pairs, pre-aggregated, and
    written to the shared folder, so nothing gathers on the driver and a lost executor costs one step.
    """

    def lowest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("a").agg(F.min("b").alias("m"))

    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{tag}-edges")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(lowest(both).withColumn("m", F.least("a", "m")), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, f"{tag}-large")
        small = large.join(lowest(large), "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(large.groupBy("a").agg(F.min("b").alias("b"))).distinct()
        small = materialize(small, f"{tag}-small")
        release(now, large)
        now = small
        ends = now.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty():
            break  # every id has one link, and that to an id without one
    roots = now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component")
    return roots.unionByName(roots.select(F.col("component").alias("id"), "component").distinct())


def gapless_rank(df: DataFrame, key: str, counts: dict[int, int], order: list[str], out: str, chunk: int = 500_000) -> DataFrame:
    """Adds a rank from 0 without gaps inside each value of a whole-number key; a value of any share is dealt to many tasks.

    counts: the rows of each value, all of them. A value's rows are dealt to buckets by hash, each of at most `chunk` rows and
    a HOT_SHARE-th of all, numbered inside (key, bucket) and shifted by the value's earlier buckets. Ranks follow (bucket, order).
    """
    spark, total = df.sparkSession, sum(counts.values())
    most = max(1, min(chunk, total // HOT_SHARE))
    deal = spark.createDataFrame([(int(k), -(-n // most)) for k, n in sorted(counts.items())], "_key long, _buckets long")
    spread = F.pmod(F.xxhash64(F.lit(29), *order), F.col("_buckets"))
    df = df.join(F.broadcast(deal), df[key].cast("long") == deal["_key"]).withColumn("_bucket", spread).drop("_key", "_buckets")
    sizes = df.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*order)) - F.lit(1)
    numbered = df.withColumn("_inner", inner.cast("long"))
    return numbered.join(shifts, [key, "_bucket"]).withColumn(out, F.col("_inner") + F.col("_shift")).drop("_bucket", "_inner", "_shift")


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], copies: str, total: int) -> DataFrame:
    """rows joined to the one row of their group; `copies` says how many rows a group has, `total` how many there are.

    Groups of more than a HOT_SHARE-th of all rows, of which there are fewer than HOT_SHARE, are broadcast, so that no group
    lands in one task; all others meet by key.
    """
    is_hot = F.col(copies) > F.lit(total // HOT_SHARE)
    hot = F.broadcast(groups.where(is_hot))
    cold = rows.join(F.broadcast(groups.where(is_hot).select(*keys)), keys, "left_anti").join(groups.where(~is_hot), keys)
    return rows.join(hot, keys).unionByName(cold)


#: DuckDB: the words of a text, and the shingles of five words (fewer words: the whole sequence) of a list w of words.
SQL_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"""
SQL_SHINGLES = "list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i + 4], ' '))"
