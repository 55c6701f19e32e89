"""MinHash near-dedup with SetSketch registers.

A document's set is its distinct 5-word shingles. Its sketch has M registers K = floor(1 - log_B(x)), x the smallest of
exponentially distributed values (rate A) over the set: sketches of two sets merge by taking larger registers, and equal
registers are about as likely as the sets' Jaccard similarity. Registers are banded (R per band) to find candidates; the
joint likelihood of the counts of larger, smaller and equal registers, given both set sizes, estimates the similarity of a
candidate pair; links are then confirmed on the full sets.

How large groups are kept linear: equal sets are one representative; in each band bucket every member is first tried with
the smallest id that it shares a band with (a star), which joins a group of near copies by as many pairs as it has members.
Only then members that are still in different components are compared. In a bucket the members of its largest component meet
the others only, not each other, and the others meet among themselves, in blocks of BLOCK members dealt to many tasks: first
each member's most likely partner of a block is confirmed, then, between the components still apart, every pair whose
likelihood estimate can reach the threshold; these are first held against each other under cut hashes where the block is,
which loses no link, so little more than links leaves the task to be confirmed on full sets. No bucket is capped: every pair
that shares a band is either already connected or compared. A pair of similarity s shares no band with probability
(1 - s^R)^(M/R): 1.5e-6 at 0.75 with 50 bands of 5.

Tables written on the way are deleted as soon as nothing reads them any more.

Empty or null texts have an empty set: they are linked with nothing. A row with a null doc_id gets its set size and a null
component, and links nothing. Repeated rows of one doc_id are one document: they get the same component, and link what any of
their texts links. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import SQL_SHINGLES, SQL_WORDS, WordHash, connected_components, join_groups, materialize, mix64, read_table, release, settle, shingle_hashes, word_hashes

M, R = 250, 5
A, B, Q = 20.0, 1.001, 2**16 - 2
BLOCK = 4096
#: Partners of a document that are confirmed in one task.
FAN = 256
#: Texts of a batch that a worker holds beside it.
SLICE = 512
#: Sets of up to so many shingles are compared under 16 bits a shingle first, larger ones under 32.
NARROW = 4096
_rng = np.random.default_rng(20_240_501)
_MULT = (_rng.integers(0, 2**32, M, dtype=np.uint32) | np.uint32(1)).astype(np.uint32)
_ADD = _rng.integers(0, 2**32, M, dtype=np.uint32)


def shingle_set(text: bytes | None, cache: WordHash, k: int = 5) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text or b"", cache), k))


def registers(items: np.ndarray) -> np.ndarray:
    """M SetSketch registers (uint16) of a non-empty set of 64-bit hashes."""
    low = np.full(M, 2**32 - 1, np.uint32)
    x = (items ^ (items >> np.uint64(32))).astype(np.uint32)
    for start in range(0, len(x), 2048):
        part = x[start : start + 2048, None] * _MULT + _ADD
        np.minimum(low, part.min(axis=0), out=low)
    exponential = -np.log1p(-(low + 0.5) / 2**32) / A
    return np.clip(np.floor(1.0 - np.log(exponential) / np.log(B)), 0, Q + 1).astype(np.uint16)


def jaccard_mle(larger: np.ndarray, smaller: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Joint maximum likelihood of the similarity from register comparisons and the (known) set sizes, on a grid."""
    u = n_left / (n_left + n_right)
    v = 1.0 - u
    top = np.minimum(u / v, v / u)
    grid = np.linspace(0.0, 1.0, 65)[None, :] * top[:, None]
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)
    right, left = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
    same = M - larger - smaller
    tiny = 1e-12
    ll = larger[:, None] * np.log(right + tiny) + smaller[:, None] * np.log(left + tiny) + same[:, None] * np.log(np.clip(1 - right - left, tiny, None))
    return grid[np.arange(len(u)), ll.argmax(axis=1)]


def _compare(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (left > right).sum(axis=-1), (left < right).sum(axis=-1)


def _texts(batch: pa.RecordBatch):
    """A batch's texts one by one; of its texts only SLICE at a time are held as Python objects beside the batch."""
    for start in range(0, batch.num_rows, SLICE):
        yield from batch.column("text").slice(start, SLICE).cast(pa.binary()).to_pylist()


def _sketch(k: int):
    def run(batches):
        cache = WordHash.of_process()
        for batch in batches:
            sizes, prints, regs = [], [], []
            for text in _texts(batch):
                items = shingle_set(text, cache, k)
                sizes.append(len(items))
                prints.append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None)
                regs.append(registers(items).tobytes() if len(items) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(regs, pa.binary())], names=["id", "n", "print", "regs"])

    return run


def _band_keys(regs: np.ndarray) -> np.ndarray:
    """(rows, M) registers -> (rows, M / R) keys of the bands; a band's number is part of its key."""
    weights = np.random.default_rng(7).integers(0, 2**63, R, dtype=np.uint64) | np.uint64(1)
    count = M // R
    parts = regs.reshape(len(regs), count, R).astype(np.uint64)
    return mix64((parts * weights).sum(axis=2, dtype=np.uint64) + np.arange(count, dtype=np.uint64) * weights[0]).view(np.int64)


def _bands(batches):
    for batch in batches:
        rows = batch.num_rows
        if rows:
            keys = _band_keys(np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(rows, M))
            repeat = lambda c: pa.array(np.repeat(batch.column(c).to_numpy(), M // R))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), repeat("id"), repeat("n")], names=["band", "id", "n"])


def _shorts(k: int):
    def run(batches):
        cache = WordHash.of_process()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([_short(shingle_set(t, cache, k)) for t in _texts(batch)], pa.binary())], names=["id", "short"])

    return run


def _likely(slack: float, percent: int):
    def run(frames):
        for f in frames:
            if len(f):
                left = np.frombuffer(b"".join(f.a_regs), np.uint16).reshape(len(f), M)
                right = np.frombuffer(b"".join(f.b_regs), np.uint16).reshape(len(f), M)
                estimate = jaccard_mle(*_compare(left, right), f.a_n.to_numpy(float), f.b_n.to_numpy(float))
                yield f.loc[estimate >= percent / 100 - slack, ["a", "b"]]

    return run


def _confirm(percent: int, k: int):
    """Rows sorted by (a, salt), the text of a first, then those of its partners b -> pairs whose full sets reach the threshold."""

    def run(batches):
        cache, now, head = WordHash.of_process(), None, None
        for batch in batches:
            kept: list[tuple[int, int]] = []
            for a, salt, b, text in zip(batch.column("a").to_pylist(), batch.column("salt").to_pylist(), batch.column("b").to_pylist(), _texts(batch)):
                items = shingle_set(text, cache, k)
                if b is None:
                    now, head = (a, salt), items
                elif now == (a, salt) and _similar(head, items, percent):
                    kept.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in kept], pa.int64()), pa.array([x[1] for x in kept], pa.int64())], names=["a", "b"])

    return run


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _short(items: np.ndarray) -> bytes:
    """A set's hashes cut to 16 bits (32 for large sets), sorted."""
    kind = np.uint16 if len(items) <= NARROW else np.uint32
    return np.sort(items.astype(kind)).tobytes()


def _numbered(short: bytes, n: int, narrow: bool) -> np.ndarray:
    """Cut hashes as distinct numbers: the value and how often it came before."""
    v = np.frombuffer(short, np.uint16 if n <= NARROW else np.uint32)
    if narrow and n > NARROW:
        v = np.sort(v.astype(np.uint16))
    first = np.searchsorted(v, v, side="left")
    return v.astype(np.int64) * 2**20 + (np.arange(len(v)) - first)


def _block_pairs(slack: float, percent: int, best: bool):
    """Rows sorted by (band, among, low, high), a pair of blocks of a bucket each, into pairs of ids.

    A pair must be of different components, of sizes in ratio, and its likelihood estimate high enough; one that shares
    several bands is looked at in the first of them only. best: of each member only the pair of the highest estimate.
    Otherwise the members come with their sets under cut hashes. Cutting can only make sets more alike, so a pair whose
    cut sets stay under the threshold is none; the others leave the task and are confirmed on full sets.
    """
    least = percent / 100 - slack

    def pairs(t: pa.Table) -> list[tuple[int, int, float]]:
        side = t.column("side").to_numpy()
        regs = np.frombuffer(b"".join(t.column("regs").to_pylist()), np.uint16).reshape(len(side), M)
        ids, sizes, comp = t.column("id").to_numpy(), t.column("n").to_numpy(), t.column("component").to_numpy()
        short = None if best else t.column("short").to_pylist()
        number, out = int(np.flatnonzero(_band_keys(regs[:1])[0] == t.column("band")[0].as_py())[0]), []
        crossed = bool((side == 1).any())
        right = np.flatnonzero(side == 1) if crossed else np.arange(len(side))
        cut: dict[tuple[int, bool], np.ndarray] = {}

        def alike(i: int, j: int) -> bool:
            narrow = min(sizes[i], sizes[j]) <= NARROW
            for k in (i, j):
                if (k, narrow) not in cut:
                    cut[k, narrow] = _numbered(short[k], int(sizes[k]), narrow)
            return _similar(cut[i, narrow], cut[j, narrow], percent)

        for i in np.flatnonzero(side == 0):
            ok = (comp[right] != comp[i]) & (100 * np.minimum(sizes[right], sizes[i]) >= percent * np.maximum(sizes[right], sizes[i]))
            if not crossed and not best:
                ok &= right > i
            at = right[ok]
            if not len(at):
                continue
            same = regs[i] == regs[at]
            # the share of equal registers is the likelihood estimate's main part; well under the bound it can't reach it
            likely = same.sum(axis=1) >= (least - 0.05) * M
            at, same = at[likely], same[likely]
            at = at[same.reshape(len(at), M // R, R).all(axis=2).argmax(axis=1) == number]
            if not len(at):
                continue
            estimate = jaccard_mle(*_compare(regs[i], regs[at]), np.full(len(at), float(sizes[i])), sizes[at].astype(float))
            at, estimate = at[estimate >= least], estimate[estimate >= least]
            if best and len(at):
                at, estimate = at[[estimate.argmax()]], estimate[[estimate.argmax()]]
            out += [(int(ids[i]), int(ids[j]), float(e)) for j, e in zip(at, estimate) if best or alike(int(i), int(j))]
        return out

    def batch_of(rows: list[tuple[int, int, float]]) -> pa.RecordBatch:
        kinds = (("id", pa.int64()), ("other", pa.int64()), ("estimate", pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])

    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
            if not t.num_rows:
                continue
            key = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("band", "among", "low", "high")])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            found, start = [], 0
            for end in cuts:
                if end - start > 1:
                    found += pairs(t.slice(start, end - start))
                start = end
            rest = t.slice(start)
            yield batch_of(found)
        if rest is not None and rest.num_rows > 1:
            yield batch_of(pairs(rest))

    return run


def _verified(pairs: DataFrame, docs: DataFrame, percent: int, k: int, tag: str) -> DataFrame:
    """Pairs (a, b) of representatives whose full sets reach the threshold. A document's text is shipped once with up to FAN partners."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(float(FAN))).cast("int").alias("salts"))
    heads = salts.select("a", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt")).withColumn("b", F.lit(None).cast("long"))
    tails = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b")
    heads, tails = materialize(heads, f"{tag}-heads"), materialize(tails, f"{tag}-tails")  # written, so that Spark knows their size when it plans the joins with texts
    rows = docs.join(heads, F.col("doc_id") == F.col("a")).unionByName(docs.join(tails, F.col("doc_id") == F.col("b"))).select("a", "salt", "b", "text")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    out = materialize(rows.mapInArrow(_confirm(percent, k), "a long, b long"), f"{tag}-links")
    release(heads, tails)
    return out


def _open_rows(buckets: DataFrame, component: DataFrame, tag: str) -> DataFrame:
    """Members of buckets that hold several components, dealt to pairs of blocks: band, id, component, among, low, high, side.

    A bucket's largest component (side 1) meets the others (side 0); if these are of several components, they meet among
    themselves too.
    """
    placed = materialize(buckets.select("band", "id").join(component, "id", "left").withColumn("component", F.coalesce("component", "id")), f"{tag}-placed")
    per = placed.groupBy("band", "component").agg(F.count("*").alias("c"))
    mixed = per.groupBy("band").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.max("c").alias("main_c"), F.sum("c").alias("c"), F.count("*").alias("kinds")).where("kinds > 1")
    blocks = lambda c: F.ceil(c / F.lit(float(BLOCK))).cast("int")
    mixed = materialize(mixed.select("band", "main", "kinds", blocks(F.col("main_c")).alias("mains"), blocks(F.col("c") - F.col("main_c")).alias("others")), f"{tag}-mixed")
    rows = placed.join(mixed, "band").withColumn("is_main", F.col("component") == F.col("main"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    deal = """case when is_main then transform(sequence(0, others - 1), o -> struct(0 as among, block as low, o as high, 1 as side))
        else concat(transform(sequence(0, mains - 1), m -> struct(0 as among, m as low, block as high, 0 as side)),
          case when kinds > 2 then transform(sequence(0, others - 1), o -> struct(1 as among, least(block, o) as low, greatest(block, o) as high, if(block <= o, 0, 1) as side))
          else array() end) end"""
    out = materialize(rows.select("band", "id", "component", F.explode(F.expr(deal)).alias("x")).select("band", "id", "component", "x.*"), f"{tag}-open")
    release(placed, mixed)
    return out


def _components(docs: DataFrame, percent: int, k: int, slack: float) -> DataFrame:
    """docs (doc_id, text) of distinct ids -> id, n, component (of the smallest id); empty sets are alone."""
    sketches = materialize(docs.mapInArrow(_sketch(k), "id long, n long, print binary, regs binary"), "sketch")
    filled = sketches.where("n > 0")
    reps = materialize(filled.groupBy("print").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "reps")
    of_group = join_groups(filled.select("id", "n", "print"), reps, ["print"], "copies", filled.count()).select("id", "n", "rep")
    member = materialize(of_group.unionByName(sketches.where("n = 0").select("id", "n", F.col("id").alias("rep"))), "member")
    chosen = materialize(filled.join(reps.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "n", "regs"), "chosen")
    release(sketches, reps)

    banded = chosen.mapInArrow(_bands, "band long, id long, n long")
    hubs = banded.groupBy("band").agg(F.min(F.struct("id", "n")).alias("hub"), F.count("*").alias("c")).where("c > 1")
    hubs = materialize(hubs.select("band", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n")), "hubs")
    settle(docs.sparkSession)
    buckets = materialize(banded.join(hubs, "band"), "buckets")
    release(hubs)
    regs = lambda side: chosen.select(F.col("id").alias(side), F.col("n").alias(f"{side}_n"), F.col("regs").alias(f"{side}_regs"))

    star = buckets.where("id <> hub").where(100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")).groupBy(F.col("id").alias("b")).agg(F.min("hub").alias("a"))
    star = materialize(star.join(regs("a"), "a").join(regs("b"), "b").select("a", "b", "a_n", "b_n", "a_regs", "b_regs").mapInPandas(_likely(slack, percent), "a long, b long"), "star")
    settle(docs.sparkSession)
    links = [_verified(star, docs, percent, k, "star")]
    release(star)
    component = connected_components(links[0], "star")

    for best in (True, False):
        tag = "best" if best else "rest"
        rows = _open_rows(buckets, component, tag)
        if rows.isEmpty():
            release(rows, buckets)
            break
        facts = chosen
        if not best:
            release(buckets)
            wanted = materialize(rows.select(F.col("id").alias("doc_id")).distinct(), "wanted")
            shorts = materialize(docs.join(wanted, "doc_id", "left_semi").mapInArrow(_shorts(k), "id long, short binary"), "shorts")
            release(wanted)
            facts = facts.join(shorts, "id")
        order = ["band", "among", "low", "high"]
        dealt = rows.join(facts, "id").repartition(*order).sortWithinPartitions(*order)
        seen = dealt.mapInArrow(_block_pairs(slack, percent, best), "id long, other long, estimate double")
        if best:
            seen = seen.groupBy("id").agg(F.max_by("other", F.struct("estimate", -F.col("other"))).alias("other"))
        pairs = materialize(seen.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct(), f"{tag}-pairs")
        release(*([rows] if best else [rows, shorts]))
        found = _verified(pairs, docs, percent, k, tag)
        if not found.isEmpty():
            links.append(found)
            component = connected_components(reduce(DataFrame.unionByName, links), tag)
    component = materialize(component, "component")
    release(chosen, *links)
    return member.join(component.withColumnRenamed("id", "rep"), "rep", "left").select("id", "n", F.coalesce("component", "rep").alias("component"))


def rows_with_components(docs: DataFrame, percent: int = 75, k: int = 5, slack: float = 0.12) -> DataFrame:
    """The rows of docs (doc_id, text, ...) with a number of their own: all columns, `_row`, `_n` and `_component` (a row number)."""
    if set(docs.columns) & {"_row", "_n", "_component"}:
        raise ValueError("docs has a column of an output's name")
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = _components(rows.select(F.col("_row").alias("doc_id"), "text"), percent, k, slack)
    return rows.join(found.select(F.col("id").alias("_row"), F.col("n").alias("_n"), F.col("component").alias("_component")), "_row")


def distinct_ids(docs: DataFrame) -> bool:
    """Whether every row has a doc_id of its own."""
    r = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    return r[0] == r[1]


def near_duplicates(docs: DataFrame, percent: int = 75, k: int = 5, slack: float = 0.12) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, kept.

    slack: how far under the threshold an estimate may lie for the pair to be confirmed on full sets; 0.12 is 4.4
    standard deviations of the estimate with 250 registers.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if distinct_ids(docs):
        rows = _components(docs, percent, k, slack).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    else:  # rows are the nodes; rows of one id are linked, and a component is named by its smallest id
        named = materialize(rows_with_components(docs.where("doc_id is not null"), percent, k, slack).select("doc_id", "_n", "_component"), "named")
        each = named.select("doc_id", "_component").distinct()
        several = each.groupBy("doc_id").agg(F.min("_component").alias("a"), F.count("*").alias("c")).where("c > 1")
        same = each.join(several, "doc_id").select("a", F.col("_component").alias("b"))
        joined = connected_components(same, "same").select(F.col("id").alias("_component"), "component")
        named = materialize(named.join(joined, "_component", "left").select("doc_id", "_n", F.coalesce("component", "_component").alias("_component")), "joined")
        least = named.groupBy("_component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("copies"))
        rows = join_groups(named, materialize(least, "least"), ["_component"], "copies", named.count()).select("doc_id", F.col("_n").alias("n_shingles"), "component_id")
        lost = docs.where("doc_id is null").mapInArrow(_sketch(k), "id long, n long, print binary, regs binary")
        rows = rows.unionByName(lost.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))
    return rows.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


#: Every pair that shares a shingle, compared on full sets, and the closure of the links.
ORACLE = f"""with recursive d as (select doc_id, {SQL_WORDS} as w from documents), s as (select doc_id, case when len(w) > 0 then list_distinct({SQL_SHINGLES}) else [] end as sh from d),
 e as (select doc_id, unnest(sh) as x from s), n as (select doc_id, len(sh) as n from s), p as (select a.doc_id as a, b.doc_id as b, count(*) as c from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
 l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 75 * (na.n + nb.n - c)), u as (select a, b from l union all select b, a from l),
 r as (select doc_id as id, doc_id as b from n union select r.id, u.b from r join u on r.b = u.a), m as (select id, min(b) as component_id from r group by 1)
 select doc_id, n as n_shingles, component_id, doc_id = component_id as kept from n join m on id = doc_id"""
