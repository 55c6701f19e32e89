"""Exact dedup by deterministic block naming.

Each text (runs of ASCII white space replaced by one space) is cut into fixed-size byte blocks. The distinct blocks are
sorted and get integer names; then the names of adjacent blocks are paired, the distinct pairs are sorted and named, and
so on until each document has one name. Two documents of the same number of blocks have the same final name exactly if
their texts are byte for byte the same: names come from comparing contents, a hash only decides the order of sorting.

Naming is one range exchange on (hash, row): copies of a hot block are dealt to many tasks. A task numbers the
runs of equal contents it sees; a run that spans tasks is brought to one name by a table of two rows or so per task.

Null and empty texts are the same (empty) text. A null doc_id takes no part in choosing the row that stays, unless the
group has no other; repeated rows of one doc_id count each in group_size and all are kept if they are the ones that stay.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import join_groups, materialize, read_table, release

BLOCK_BYTES = 8_192


def _name_runs(width: int):
    """Numbers runs of equal content in a sorted partition; content is the first `width` columns after the hash."""

    def run(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        count, last = 0, None
        edge: list[tuple] = []  # distinct contents of the partition's first hash and of its current hash
        first_hash, now_hash, first, current = None, None, {}, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i) for i in range(1 + width)]
            fresh = None
            for c in cols:
                changed = pc.not_equal(c.slice(1), c.slice(0, len(c) - 1))
                fresh = changed if fresh is None else pc.or_(fresh, changed)
            head = tuple(c[0].as_py() for c in cols)
            starts = [0] if head != last else []
            starts += (pc.indices_nonzero(fresh).to_numpy() + 1).tolist()
            ranks = pc.cumulative_sum(pa.concat_arrays([pa.array([int(head != last)], pa.int64()), fresh.cast(pa.int64())]))
            ranks = pc.add(ranks, count - 1)
            for i in starts:
                h = cols[0][i].as_py()
                if first_hash is None:
                    first_hash = h
                if h == first_hash:
                    first[tuple(c[i].as_py() for c in cols)] = ranks[i].as_py()
                if h != now_hash:
                    now_hash, current = h, {}
                current[tuple(c[i].as_py() for c in cols)] = ranks[i].as_py()
            count = ranks[-1].as_py() + 1
            last = tuple(c[-1].as_py() for c in cols)
            n = batch.num_rows
            none = [pa.nulls(n, c.type) for c in cols]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("pos"), batch.column("sha"), batch.column("total"), pa.array([pid] * n, pa.int32()), ranks, *none], names=["row", "doc_id", "pos", "sha", "total", "pid", "rank", "h", *[f"c{i}" for i in range(width)]])
        edge = list(({**first, **current}).items())
        if edge:
            n = len(edge)
            parts = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()), pa.array([pid] * n, pa.int32()), pa.array([r for _, r in edge], pa.int64())]
            parts += [pa.array([k[i] for k, _ in edge], c.type) for i, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays(parts, names=["row", "doc_id", "pos", "sha", "total", "pid", "rank", "h", *[f"c{i}" for i in range(width)]])

    return run


def _named(rows: DataFrame, contents: list[str], tag: str) -> tuple[DataFrame, DataFrame]:
    """rows (row, doc_id, pos, sha, total, *contents) -> (row, doc_id, pos, sha, total, name), equal contents having equal names;
    and the table that this reads."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    keyed = rows.select(F.xxhash64(*contents).alias("h"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(contents)], "row", "doc_id", "pos", "sha", "total")
    dealt = keyed.repartitionByRange(parts, "h", "row", "pos").sortWithinPartitions("h", *[f"c{i}" for i in range(len(contents))])
    shape = "row long, doc_id long, pos int, sha binary, total int, pid int, rank long, h long, " + ", ".join(f"c{i} {kinds[c]}" for i, c in enumerate(contents))
    seen = materialize(dealt.mapInArrow(_name_runs(len(contents)), shape), f"{tag}-runs")
    own = F.shiftleft(F.col("pid").cast("long"), 40) + F.col("rank")
    edges = seen.where("h is not null").withColumn("own", own)
    one = edges.groupBy("h", *[f"c{i}" for i in range(len(contents))]).agg(F.min("own").alias("name"), F.collect_list("own").alias("all")).where(F.size("all") > 1)
    moved = one.select("name", F.explode("all").alias("own"))
    return seen.where("h is null").withColumn("own", own).join(moved, "own", "left").select("row", "doc_id", "pos", "sha", "total", F.coalesce("name", "own").alias("name")), seen


def normalised(text) -> "F.Column":
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def block_identity(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (doc_id, text) -> one row per document: doc_id, sha (of the normalised text), level, name."""
    raw = normalised(F.col("text")).cast("binary")
    body = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), raw.alias("raw"))
    body = body.withColumn("total", F.greatest(F.lit(1), F.ceil(F.octet_length("raw") / F.lit(float(block_bytes)))).cast("int"))
    cut = F.expr(f"transform(sequence(0, total - 1), i -> struct(i as pos, substring(raw, i * {block_bytes} + 1, {block_bytes}) as block))")
    blocks = body.withColumn("sha", F.unhex(F.sha2("raw", 256))).select("row", "doc_id", "sha", "total", F.explode(cut).alias("b"))
    blocks = blocks.select("row", "doc_id", F.col("b.pos").alias("pos"), F.when(F.col("b.pos") == 0, F.col("sha")).alias("sha"), "total", F.col("b.block").alias("block"))
    level = 0
    names, runs = _named(blocks, ["block"], "blocks")
    names = materialize(names, "names0")
    release(runs)
    done = names.where("total = 1").select("doc_id", "sha", F.lit(0).alias("level"), "name")
    while True:
        more = names.where("total > 1")
        if more.isEmpty():
            return done
        level += 1
        half = F.expr("cast(shiftright(pos, 1) as int)")
        pairs = more.withColumn("side", F.col("pos") % 2).groupBy("row", half.alias("pos")).agg(
            F.max("doc_id").alias("doc_id"), F.max("sha").alias("sha"), F.expr("cast(max(shiftright(total + 1, 1)) as int)").alias("total"),
            F.max(F.when(F.col("side") == 0, F.col("name"))).alias("left_name"), F.coalesce(F.max(F.when(F.col("side") == 1, F.col("name"))), F.lit(-1)).alias("right_name"),
        )
        names, runs = _named(pairs, ["left_name", "right_name"], f"pairs{level}")
        names = materialize(names, f"names{level}")
        release(runs)
        done = done.unionByName(names.where("total = 1").select("doc_id", "sha", F.lit(level).alias("level"), "name"))


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    ids = materialize(block_identity(docs, block_bytes), "identities")
    groups = ids.groupBy("level", "name").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    named = join_groups(ids, materialize(groups, "identity-groups"), ["level", "name"], "group_size", ids.count())
    return named.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


ORACLE = """
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, sha256(norm) as text_sha256
from t window w as (partition by norm)
"""
