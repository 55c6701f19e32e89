"""K-d tree sharding: recursive splits at distributed weighted medians along the widest metadata dimension.

A document weighs its text's bytes plus ROW_BYTES. Its dimensions are its size, its id, and the ranks of its source and its
language among their distinct values, each scaled to whole numbers over the table's range; ties are ordered by a hash. A node
that must become k shards is split along the dimension in which its rows are spread widest, at the weighted quantile that
its halves' shards have room for, until every leaf is one shard of total / n_shards bytes. The law is `bytes`: shard sizes are
equal up to one small group at each cut.

Equal texts are a group: they share one point (the smallest id, source and language of the group) and so stay in one shard.
A group heavier than BIG of a shard would miss the cuts by too much: such groups, fewer than n_shards / BIG, are placed
whole before the tree is grown, the heaviest first into the shard with the most room, and the tree fills what room is left.
Only a group heavier than a shard is dealt over several, as few as hold it.

Finding a cut needs no sort: the weight is summed by (node, bin) over BINS bins of the node's range, the bin that holds the
cut is opened again, and so on; at most nodes x BINS sums reach the driver per step, whatever the input. Only built-in
DataFrame functions are used.

Null texts weigh ROW_BYTES and have the checksum of no bytes; null sources, languages and ids sort first. Repeated rows are
placed each. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobar.llm.common import gapless_rank, join_groups, materialize, read_table, release

ROW_BYTES = 8
BINS = 1024
SCALE = 2**28
TIE_BITS = 31
BIG = 1 / 50
#: Pieces for each shard that a group heavier than a shard needs.
PIECES = 64
DIMENSIONS = ["d_size", "d_doc", "d_source", "d_lang"]


def _ranks(groups: DataFrame, column: str) -> DataFrame:
    """value -> its rank among the distinct values of a column (nulls first) and how often it occurs; no task sorts them all."""
    values = groups.groupBy(column).agg(F.count("*").alias(f"n_{column}"))
    dealt = materialize(values.repartitionByRange(column).withColumn("part", F.spark_partition_id()), f"values-{column}")
    sizes, before = {r[0]: r[1] for r in dealt.groupBy("part").count().collect()}, {}
    for part in sorted(sizes):
        before[part] = sum(sizes[p] for p in before)
    at = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("part")) if before else F.lit(0)
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_first(column))) - 1
    return dealt.select(column, f"n_{column}", (at + rank).cast("long").alias(f"d_{column}"))


def _by_node(values: dict[int, int], default: int = 0) -> Column:
    """A column that gives each node its value."""
    return F.element_at(F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)]), F.col("node")) if values else F.lit(default)


def _descend(rows: DataFrame, cuts: list[tuple[int, str, int, int, int]]) -> DataFrame:
    """Moves rows of a node to its children: those whose key is over the cut go right."""
    node = F.col("node")
    step = node
    for parent, dim, cut, left, right in cuts:
        step = F.when(node == parent, F.when(_key(dim) > F.lit(cut), right).otherwise(left)).otherwise(step)
    return rows.withColumn("node", step)


def _key(dim: str) -> Column:
    return F.shiftleft(F.col(dim), TIE_BITS) + F.col("tie")


def _cut(rows: DataFrame, dims: dict[int, str], goals: dict[int, float], ranges: dict[int, tuple[int, int]]) -> dict[int, int]:
    """For each node the largest key of its left part: the key whose running weight comes closest to the goal."""
    low = {n: r[0] for n, r in ranges.items()}
    high = {n: r[1] for n, r in ranges.items()}
    before = dict.fromkeys(dims, 0)  # weight under the open range
    cuts: dict[int, int] = {}
    key = F.lit(None).cast("long")
    for n, d in dims.items():
        key = F.when(F.col("node") == n, _key(d)).otherwise(key)
    keyed = rows.where(F.col("node").isin(list(dims))).select("node", key.alias("key"), "size")
    while low:
        width = {n: max(1, -(-(high[n] - low[n] + 1) // BINS)) for n in low}
        inside = keyed.where(F.col("node").isin(list(low))).where((F.col("key") >= _by_node(low)) & (F.col("key") <= _by_node(high)))
        sums = inside.groupBy("node", F.floor((F.col("key") - _by_node(low)) / _by_node(width)).alias("bin")).agg(F.sum("size").alias("w"), F.min("key").alias("a"), F.max("key").alias("b"))
        per: dict[int, list] = {n: [] for n in low}
        for r in sums.collect():
            per[r["node"]].append((r["bin"], r["w"], r["a"], r["b"]))
        for n in list(low):
            total, bins = before[n], sorted(per[n])
            for i, (_, w, a, b) in enumerate(bins):
                if total + w >= goals[n] or i == len(bins) - 1:
                    if a == b or total + w == goals[n]:
                        under = bins[i - 1][3] if i else low[n] - 1
                        cuts[n] = b if abs(total + w - goals[n]) <= abs(goals[n] - total) else under
                        del low[n], high[n]
                    else:
                        before[n], low[n], high[n] = total, a, b
                    break
                total += w
    return cuts


def _place_big(pieces: list[tuple], n_shards: int, target: float) -> tuple[dict[tuple, int], list[float]]:
    """Groups (weight, *group, piece) into shards, the heaviest first where most room is; and the room that is left.

    A group's pieces stay together; those of a group that is heavier than a shard fill one shard after another.
    """
    groups: dict[tuple, list[tuple[int, int]]] = {}
    for weight, *group, piece in pieces:
        groups.setdefault(tuple(group), []).append((piece, weight))
    room, shard_of = [target] * n_shards, {}
    most = lambda: max(range(n_shards), key=lambda s: (room[s], -s))
    for group in sorted(groups, key=lambda g: (-sum(w for _, w in groups[g]), g)):
        shard = most()
        for piece, weight in sorted(groups[group]):
            if weight > room[shard] and len(groups[group]) > 1:
                shard = most()
            shard_of[*group, piece] = shard
            room[shard] -= weight
    return shard_of, [max(0.0, x) for x in room]


def kd_shards(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """docs (doc_id, text, source, lang) -> doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark, raw = docs.sparkSession, F.col("text").cast("binary")
    base = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(raw), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(raw, F.lit(b""))).alias("text_crc32"), F.xxhash64("text").alias("g1"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
    )
    base = materialize(base, "shard-base")
    whole = base.agg(F.count("*"), F.sum("size")).first()
    count, total = whole[0], whole[1] or 0
    target = total / n_shards
    key = ["g1", "text_crc32", "size"]
    groups = base.groupBy(*key).agg(F.count("*").alias("copies"), F.min("doc_id").alias("d_doc"), F.min("source").alias("source"), F.min("lang").alias("lang"))
    groups = materialize(groups, "shard-groups")

    heavy = F.col("copies") * F.col("size") > F.lit(BIG * target)
    big = groups.where(heavy).select(*key, F.ceil(F.col("copies") * F.col("size") / F.lit(max(target, 1.0))).cast("int").alias("parts"))
    big = big.withColumn("parts", F.when(F.col("parts") > 1, F.col("parts") * PIECES).otherwise(1))
    part = F.pmod(F.xxhash64(F.lit(1), "row"), F.col("parts")).cast("int").alias("part")
    of_big = base.join(F.broadcast(big), key).select("doc_id", *key, part)
    weights = [(r["w"], r["g1"], r["text_crc32"], r["size"], r["part"]) for r in of_big.groupBy(*key, "part").agg(F.sum("size").alias("w")).collect()]
    shard_of, room = _place_big(weights, n_shards, target)
    homes = spark.createDataFrame([(*name, shard) for name, shard in shard_of.items()], "g1 long, text_crc32 long, size long, part int, shard int")
    placed_big = of_big.join(F.broadcast(homes), [*key, "part"]).select("doc_id", "size", "text_crc32", "shard")

    small = groups.where(~heavy)
    for c in ("source", "lang"):
        ranks = _ranks(small, c)
        small = join_groups(small.withColumn("_null", F.col(c).isNull()).withColumn(c, F.coalesce(c, F.lit(""))), ranks.withColumn("_null", F.col(c).isNull()).withColumn(c, F.coalesce(c, F.lit(""))), [c, "_null"], f"n_{c}", count).drop("_null", c, f"n_{c}")
    small = materialize(small.withColumn("d_doc", F.coalesce("d_doc", F.lit(-1))), "shard-facts")
    rows = base.select("doc_id", *key).join(F.broadcast(big.select(*key)), key, "left_anti")
    rows = join_groups(rows, small, key, "copies", count).withColumn("d_size", F.col("size"))
    rows = rows.withColumn("tie", F.shiftrightunsigned(F.xxhash64(*key), 64 - TIE_BITS))
    rows = points = materialize(rows.select("doc_id", "size", "text_crc32", "tie", *DIMENSIONS), "shard-points")
    placed_big = materialize(placed_big, "shard-big")
    release(base, groups, small)
    span = rows.agg(*[f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("low", F.min), ("high", F.max))]).first()
    for d in DIMENSIONS:
        low, high = span[f"low_{d}"] or 0, span[f"high_{d}"] or 0
        rows = rows.withColumn(d, F.floor((F.col(d) - F.lit(low)).cast("double") / F.lit(float(max(1, high - low))) * F.lit(float(SCALE))).cast("long"))
    rows = materialize(rows.withColumn("node", F.lit(0)), "shard-level")
    release(points)

    shares, first, following = {0: n_shards}, {0: 0}, 1  # node -> shards it becomes, its first shard
    while any(k > 1 for k in shares.values()):
        split = [n for n, k in shares.items() if k > 1]
        facts = rows.where(F.col("node").isin(split)).groupBy("node").agg(F.sum("size").alias("w"), *[f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("low", F.min), ("high", F.max))])
        dims, goals, ranges = {}, {}, {}
        for r in facts.collect():
            n = r["node"]
            dims[n] = max(DIMENSIONS, key=lambda d: r[f"high_{d}"] - r[f"low_{d}"])
            left, right = sum(room[first[n] : first[n] + shares[n] // 2]), sum(room[first[n] + shares[n] // 2 : first[n] + shares[n]])
            goals[n] = r["w"] * (left / (left + right) if left + right > 0 else (shares[n] // 2) / shares[n])
            ranges[n] = (r[f"low_{dims[n]}"] << TIE_BITS, (r[f"high_{dims[n]}"] << TIE_BITS) + 2**TIE_BITS - 1)
        moves = []
        for n, cut in _cut(rows, dims, goals, ranges).items():
            left, right, following = following, following + 1, following + 2
            moves.append((n, dims[n], cut, left, right))
            shares[left], shares[right] = shares[n] // 2, shares[n] - shares[n] // 2
            first[left], first[right] = first[n], first[n] + shares[n] // 2
        for n in split:  # a node without rows is not split
            del shares[n]
        above, rows = rows, materialize(_descend(rows, moves), "shard-level")  # else the plan would double with each level
        release(above)
    leaf = {n: first[n] for n in shares}
    placed = materialize(rows.select("doc_id", "size", "text_crc32", _by_node(leaf).cast("int").alias("shard")).unionByName(placed_big), "shard-placed")
    release(rows, placed_big)
    counts = {r[0]: r[1] for r in placed.groupBy("shard").count().collect()}
    out = gapless_rank(placed, "shard", counts, ["doc_id", "size", "text_crc32"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_kd_sharding(spark, sf_dir: str) -> DataFrame:
    return kd_shards(read_table(spark, sf_dir, "documents"))
