"""The training-data operators against brute force, round trips and awkward inputs, on small fixtures."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isobar.llm import bt_quality, common, crf_language, decontaminate, exact_dedup, fm_toxicity, kd_sharding, line_dedup, packing, pii, queries, setsketch
from isobar.llm.common import connected_components, gapless_rank, join_groups


def docs(spark, rows, extra=False):
    full = [(*r, *("en", f"s{i % 3}")[len(r) - 2 :]) if len(r) < 4 else r for i, r in enumerate(rows)]
    d = spark.createDataFrame(full, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return d.withColumns({c: F.lit("clash") for c in ("n", "rep", "shard", "sequence_id", "score", "name", "level", "h", "id", "band", "size")}) if extra else d


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]) + str(rng.randrange(60)) for _ in range(n))


def near_rows():
    rng = random.Random(5)
    rows, i = [], 0
    for _ in range(12):
        base = words(rng, rng.randrange(30, 90)).split()
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = words(rng, 1)
            rows.append((i, " ".join(w)))
            i += 1
    return rows + [(i, rows[0][1].upper()), (i + 1, rows[0][1]), (i + 2, "a b"), (i + 3, "A  b"), (i + 4, ""), (i + 5, None), (i + 6, "")]


def brute_components(rows):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_against_brute_force(spark):
    rows = near_rows()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setsketch.near_duplicates(docs(spark, rows, extra=True)).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    rng = random.Random(3)
    a, b, c = (words(rng, 40) for _ in range(3))
    rows = [(9, a), (2, a + " x"), (2, b), (7, b), (7, b), (5, c), (5, ""), (None, c), (1, ""), (None, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in setsketch.near_duplicates(docs(spark, rows, extra=True)).collect()), key=str)
    n = [len(t.split()) - 4 for t in (a, a + " x", b, c)]
    want = [(9, n[0], 2, False), (2, n[1], 2, True), (2, n[2], 2, True), (7, n[2], 2, False), (7, n[2], 2, False), (5, n[3], 5, True), (5, 0, 5, True), (None, n[3], None, None), (1, 0, 1, True), (None, 0, None, None)]
    assert got == sorted(want, key=str)


def test_near_duplicates_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "FAN", 3)
    rng = random.Random(9)
    rows, i = [], 0
    for _ in range(3):  # families of copies that share two thirds: many buckets of several components
        base = words(rng, 60).split()
        for _ in range(4):
            head = base[:44] + words(rng, 16).split()
            for _ in range(10):
                w = list(head)
                w[rng.randrange(44, 60)] = words(rng, 1)
                rows.append((i, " ".join(w)))
                i += 1
    want = brute_components(rows)
    for block in (4096, 5):
        monkeypatch.setattr(setsketch, "BLOCK", block)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in setsketch.near_duplicates(docs(spark, rows)).collect()}
        assert got == want


def test_likelihood_estimate_is_close():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.9):
        both, a, b = (rng.integers(0, 2**63, k, dtype=np.uint64) for k in (int(800 * share), int(800 * (1 - share) / 2), int(800 * (1 - share) / 2)))
        x, y = np.r_[both, a], np.r_[both, b]
        rx, ry = setsketch.registers(x), setsketch.registers(y)
        assert (setsketch.registers(np.r_[both, a, b]) == np.maximum(rx, ry)).all()  # mergeable
        j = setsketch.jaccard_mle(np.array([(rx > ry).sum()]), np.array([(rx < ry).sum()]), np.array([float(len(x))]), np.array([float(len(y))]))[0]
        assert abs(j - len(both) / (len(both) + len(a) + len(b))) < 0.12


def test_connected_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long"), "t").collect()}
    assert got == {x: find(x) for x in root}


def test_exact_dedup(spark):
    rows = [(i, t) for i, t in enumerate(["a  b", "a b", "a\t\nb", "", None, "x" * 100_000, "x" * 99_999 + "y", "x" * 100_000, " a b"])]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs(spark, rows, extra=True), block_bytes=512).collect()}
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    for i, t in norm.items():
        same = [j for j in norm if norm[j] == t]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (min(same), len(same), i == min(same), hashlib.sha256(t.encode()).hexdigest())


def test_pack_round_trip(spark):
    rows = [(i, t) for i, (_, t) in enumerate(near_rows())] + [(500, "word " * 9000), (501, "Été «œuvre» 中文 <|endoftext|> don't 12a"), (502, None)]
    got = packing.pack(docs(spark, rows, extra=True), packing.tokenizer_path(), max_tokens=256).toPandas()
    tok = packing.Ids(packing.tokenizer_path()).whole
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    for r in got.itertuples():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.asarray(part, "<u4").tobytes())
    assert got.groupby("doc_id").length.sum().to_dict() == {i: len(x) for i, x in ids.items()}
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.offset.to_numpy() == np.r_[0, s.length.cumsum().to_numpy()[:-1]]).all() and s.length.sum() <= 256
    assert sorted(got.sequence_id.unique()) == list(range(got.sequence_id.nunique()))


@pytest.mark.parametrize("seed", range(20))
def test_pack_histogram_uses_each_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([8, 64, 4096])
    counts = {rng.randint(1, capacity): rng.randint(1, 60) for _ in range(rng.randint(1, 40))}
    patterns, used = packing.pack_histogram(counts, capacity), Counter()
    for packs, pattern in patterns:
        assert sum(a * b for a, b in pattern) <= capacity
        for length, each in pattern:
            used[length] += packs * each
    assert used == counts


def shard_rows():
    rng = random.Random(2)
    rows = [(i, words(rng, rng.randrange(1, 60)) if i % 3 else "hot text of a third of all rows " * 4, rng.choice(["en", "de", None]), rng.choice(["https://a.org/1", "https://a.org/2", "https://b.org", None, ""])) for i in range(900)]
    rows += [(2000 + i, "a text of a fifth of a shard " * 5, "en", "x") for i in range(8)] + [(1000, None, None, None), (1001, "", "en", "a"), (None, "no id", "en", "a"), (5, rows[5][1], "en", "a")]
    return rows


def test_sharding_against_a_walk_down_the_tree(spark):
    rows, n = shard_rows(), 8
    got = kd_sharding.kd_shards(docs(spark, rows, extra=True), n).toPandas()
    weight = lambda t: len((t or "").encode()) + kd_sharding.ROW_BYTES
    assert Counter(zip(got["size"], got.text_crc32)) == Counter((weight(t), zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    target = sum(weight(t) for _, t, *_ in rows) / n
    per = got.groupby("shard")["size"].sum()
    assert len(per) == n and per.max() - per.min() < 0.04 * target
    for _, s in got.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    groups: dict[str | None, list] = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    points, seen = [], {(s, c): set(x.shard) for (s, c), x in got.groupby(["size", "text_crc32"])}
    spread = {}
    for text, members in groups.items():
        w = weight(text) * len(members)
        shards = seen[weight(text), zlib.crc32((text or "").encode())] if text else set(got[got["size"] == kd_sharding.ROW_BYTES].shard)
        assert len(shards) <= -(-w // target) if text else len(shards) <= 2
        if w <= kd_sharding.BIG * target:
            low = lambda i: min((m[i] for m in members if m[i] is not None), default=None)  # noqa: E731, B023
            points.append([w, min(shards), weight(text), low(0) if low(0) is not None else -1, low(3), low(2)])
        spread[text] = len(shards)
    assert spread["hot text of a third of all rows " * 4] > 1 == spread["a text of a fifth of a shard " * 5]
    for column in (4, 5):
        values = sorted({p[column] for p in points}, key=lambda v: (v is not None, v))
        for p in points:
            p[column] = values.index(p[column])
    for column in (2, 3, 4, 5):
        low, high = min(p[column] for p in points), max(p[column] for p in points)
        for p in points:
            p[column] = int((p[column] - low) / max(1, high - low) * kd_sharding.SCALE)

    def walk(points, first, count):
        if count == 1 or not points:
            return
        width = [max(p[c] for p in points) - min(p[c] for p in points) for c in (2, 3, 4, 5)]
        dim, middle = 2 + width.index(max(width)), first + count // 2
        left, right = [p for p in points if p[1] < middle], [p for p in points if p[1] >= middle]
        assert not left or not right or max(p[dim] for p in left) <= min(p[dim] for p in right)
        walk(left, first, count // 2)
        walk(right, middle, count - count // 2)

    walk(points, 0, n)


def test_ranks_of_values(spark):
    d = spark.createDataFrame([(x,) for x in ["https://b", "https://a", None, "", "https://a", "é"]], "source string")
    assert sorted((r.d_source, r.source, r.n_source) for r in kd_sharding._ranks(d, "source").collect()) == [(0, None, 1), (1, "", 1), (2, "https://a", 2), (3, "https://b", 1), (4, "é", 1)]


def test_gapless_rank_with_many_buckets(spark):
    d = spark.range(1000).select("id", (F.col("id") % 3).alias("k"))
    d = d.unionByName(d.where("id < 10"))  # repeated rows
    got = gapless_rank(d, "k", {r[0]: r[1] for r in d.groupBy("k").count().collect()}, ["id"], "r", chunk=100).toPandas()
    assert len(got) == 1010
    for _, s in got.groupby("k"):
        assert sorted(s.r) == list(range(len(s)))


def test_join_groups_of_hot_and_cold_keys(spark):
    d = spark.range(4000).select("id", F.when(F.col("id") < 1500, 1).otherwise(F.col("id") % 700).alias("k"))
    groups = d.groupBy("k").agg(F.count("*").alias("c"))
    got = join_groups(d, groups, ["k"], "c", 4000)
    assert got.count() == 4000 and got.exceptAll(d.join(groups, "k").select(*got.columns)).isEmpty()
    assert join_groups(d.limit(0), groups.limit(0), ["k"], "c", 0).count() == 0


def test_line_dedup(spark):
    rows = [(i, f"Menu\nown line {i}\n\n Menu \nShared", "en", "site") for i in range(20)] + [(20, "Menu\nMenu", "en", "site"), (21, None, "en", "site"), (22, "Menu\nother", "en", "small"), (23, "Menu\nx", "en", None)]
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(docs(spark, rows)).collect()}
    assert got[3].text == "own line 3\n" and (got[3]._lines_in, got[3]._lines_out) == (4, 1)
    assert got[20].text == "Menu\nMenu" and got[21].text is None and got[22].text == "Menu\nother" and got[23].text == "Menu\nx"


def test_decontamination_against_brute_force(spark):
    rng = random.Random(8)
    items = [(i, words(rng, rng.randrange(8, 40))) for i in range(12)] + [(50, None), (51, ""), (52, "two words")]
    rows = []
    for i in range(60):
        w = words(rng, rng.randrange(20, 120)).split()
        if i % 3 == 0:
            part = items[rng.randrange(12)][1].split()
            for _ in range(rng.randrange(0, 3)):
                part[rng.randrange(len(part))] = "changed"
            at = rng.randrange(len(w))
            w[at:at] = part
        rows.append((i, " ".join(w).title() if i % 2 else "\n".join(w)))
    rows += [(90, None), (91, ""), (92, "Two WORDS")]
    want = set()
    shingle = lambda w: Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4)))
    for d, t in rows:
        w = (t or "").lower().split()
        for item, q in items:
            x = (q or "").lower().split()
            if not w or not x:
                continue
            n = min(len(x), len(w))
            goal = shingle(x)
            for s in range(len(w) - n + 1):
                a = shingle(w[s : s + n])
                both = sum((a & goal).values())
                if 100 * both >= 75 * (sum(a.values()) + sum(goal.values()) - both):
                    want.add((d, item))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(docs(spark, rows, extra=True), bench, item_block=5).collect()}
    assert want and got == want
    assert decontaminate.contamination(docs(spark, rows), bench.limit(0)).count() == 0


def test_pseudonyms(spark):
    rows = [(1, "call +1 (988) 555-2485, card 4785380592391139 or 4785 3805 9239 1139 not 4785380592391138"), (2, "at 152.143.123.131 not 999.1.1.1 mail Bos.t-42@mail8.example.com"), (3, "on 2024-02-29 not 2023-02-29"), (4, None), (5, ""), (6, "(988) 555-2485 on 2024-02-29 card 4785-3805-9239-1139 password=b7db7aa4a5fcc78305")]
    got = {r.doc_id: r for r in pii.pseudonymise(docs(spark, rows, extra=True), "k").collect()}
    digits = lambda x: re.sub(r"\D", "", x)
    one, six = got[1]._pii, got[6]._pii
    assert [x.kind for x in one] == ["phone", "card", "card"] and digits(one[1].value) == digits(one[2].value) == digits(six[2].value)
    assert digits(one[0].value)[-10:] == digits(six[0].value) and six[1].value == got[3]._pii[0].value
    assert sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits(one[1].value)))) % 10 == 0
    assert "4785380592391138" in got[1].text and "4785380592391139" not in got[1].text and "999.1.1.1" in got[2].text
    assert re.fullmatch(r"at [\d.]+ not 999.1.1.1 mail [A-Z][a-z]{2}\.[a-z]-\d\d@mail8.example.com", got[2].text) and "2023-02-29" in got[3].text
    assert got[4].text is None and got[5].text == ""
    assert re.fullmatch(r"password=[0-9a-f]{18}", got[6].text.split()[-1])


def test_pseudonyms_at_group_borders_and_of_any_case(spark):
    card, upper = "4111 1111 1111 1111", "9233A8EC5B7D0F4A"
    texts = [f"{card} 123", "4111111111111111 12/27", f"12 {card}", "4111-1111-1111-1111-123", f"{card} 555 223-4567", f"{card} 5500 0000 0000 0004", "411111 1111111111 77", f"{card} {card} " * 300]
    texts += [f'TOKEN = "{upper}"', f"Password={upper.title()}", "api_key: " + "0a" * 100, "secret=123456789012", "4111 1111 1111 1112 123", "5 4 3 2 1 " * 3000]
    texts += ["token=abcdefabcdef", "token=" + "9F" * 5000]
    got = {r.doc_id: r for r in pii.pseudonymise(docs(spark, list(enumerate(texts)), extra=True), "k").collect()}
    digits = lambda x: re.sub(r"\D", "", x)
    cards = [digits(x.value) for i in range(8) for x in got[i]._pii if x.kind == "card"]
    assert len(cards) == 8 + 600 and not any("4111111111111111" in digits(got[i].text) for i in range(8))
    assert len(set(cards)) == 2 and [x.kind for x in got[4]._pii] == ["card", "phone"]
    assert got[0].text.endswith(" 123") and got[1].text.endswith(" 12/27") and got[2].text.startswith("12 ") and got[6].text.endswith(" 77")
    for i, value in [(8, upper), (9, upper.title()), (10, "0a" * 100), (11, "123456789012"), (14, "abcdefabcdef"), (15, "9F" * 5000)]:
        assert [x.kind for x in got[i]._pii] == ["secret"] and value not in got[i].text and len(got[i].text) == len(texts[i])
    assert re.fullmatch(r'TOKEN = "\d{4}[A-F]\d[A-F]{2}\d[A-F]\d[A-F]\d[A-F]\d[A-F]"', got[8].text) and re.fullmatch("api_key: [0-9a-f]{200}", got[10].text)
    assert got[12].text == texts[12] and len(got[13].text) == len(texts[13])


def test_feistel_is_a_permutation(spark):
    e = pii.feistel_sql("array(cast(id div 10 as int), cast(id % 10 as int))", "array(7, 10)", "t", "k")
    got = [tuple(r[0]) for r in spark.range(70).select(F.expr(e)).collect()]
    assert len(set(got)) == 70 and all(a < 7 and b < 10 for a, b in got)
    other = [tuple(r[0]) for r in spark.range(70).select(F.expr(pii.feistel_sql("array(cast(id div 10 as int), cast(id % 10 as int))", "array(7, 10)", "t", "k2"))).collect()]
    assert got != other


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(3)
    s, trans, first = rng.normal(size=(4, 1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    post, expected, log_z = crf_language.forward_backward(s, np.ones((4, 1), bool), trans, first)
    total, want, moves = 0.0, np.zeros((4, 3)), np.zeros((3, 3))
    for path in np.ndindex(3, 3, 3, 3):
        w = np.exp(first[path[0]] + sum(s[t, 0, y] for t, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
        total += w
        for t, y in enumerate(path):
            want[t, y] += w
        for a, b in zip(path, path[1:]):
            moves[a, b] += w
    assert np.allclose(post[:, 0], want / total) and np.allclose(expected, moves / total) and np.isclose(log_z[0], np.log(total))


@pytest.mark.parametrize("labels", [3, 40])
def test_a_document_is_one_chain(labels):
    rng = np.random.default_rng(6)
    lengths = np.array([1, 0, 5, 64, 65, 128, 300, 0, 1000, 2])
    scores = rng.normal(0, 3, (lengths.sum(), labels)).astype(np.float32)
    trans, first = rng.normal(0, 2, (labels, labels)), rng.normal(0, 2, labels)
    got, at = crf_language.chain_posteriors(scores, lengths, trans, first), 0
    for n in lengths:
        if n:
            want, _, _ = crf_language.forward_backward(scores[at : at + n, None].astype(float), np.ones((n, 1), bool), trans, first)
            assert np.allclose(got[at : at + n], want[:, 0], atol=1e-9)
        at += n


def test_transitions_reach_over_pieces():
    model = crf_language.Crf(["a", "b"], [])
    model.trans = np.array([[0.0, -30.0], [-30.0, 0.0]])  # no change of language: the first word decides for all others
    model.first = np.array([4.0, 0.0])
    (label, score, words), = crf_language.Labeller(model).label([" ".join(["word"] * 500)])
    assert label == "a" and score > 0.98 and words == [500, 0]


def test_texts_without_letters_are_und(spark):
    model = crf_language.Crf(["a", "b"], [])
    texts = ["\u00bd \u00b2 \u2460", "\u2163 12", None, "", "_ 1 !", "x\u00b2y", "\u00bd z"]
    got = {r.doc_id: r for r in crf_language.identify(docs(spark, list(enumerate(texts))), model).collect()}
    assert [got[i].lang_pred for i in range(7)] == ["und"] * 5 + ["a"] * 2 and got[0].score == 0.0 and got[0].words == []
    assert got[5].words[0].words == 2 and crf_language.words_of(texts[5]) == ["x", "y"]
    kept = crf_language.recognised(docs(spark, [(7, "12345 !!!"), (7, "good words"), (None, ""), (None, "more words")], extra=True), model, 0.4)
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "more words"), (7, "good words")]


def test_language_on_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = crf_language.identify(d, crf_language.learn_folds(d)).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count() > 0


def test_sample_has_every_label(spark, monkeypatch):
    d = spark.range(3000).selectExpr("id as doc_id", "if(id < 2990, concat('l', id % 299), null) as lang", "cast('' as string) as text").withColumn("lang", F.when(F.col("doc_id") % 7 == 0, "zz").otherwise(F.col("lang")))
    got = common.bounded_ids(d, 5, "lang")
    assert {v for _, v in got} == {f"l{i}" for i in range(299)} | {"zz"} and max(Counter(v for _, v in got).values()) == 5
    few = d.where("lang in ('l1', 'l2', 'zz')")
    want = common.bounded_ids(few, 5, "lang")
    monkeypatch.setattr(common, "FEW_CLASSES", 1)
    assert common.bounded_ids(few, 5, "lang") == want and len(want) == 15
    model = crf_language.Crf([f"l{i}" for i in range(300)], [])
    model.weights[:, 7] = 1.0
    assert [x[0] for x in crf_language.Labeller(model).label(["some words here", "others " * 5000, ""])] == ["l7", "l7", "und"]


def test_language_reads_long_runs_of_letters():
    rng = np.random.default_rng(4)
    run = lambda letters, n: "".join(rng.choice(list(letters), n))
    model = crf_language.Crf(["a", "b"], [])
    chains = [(crf_language.words_of(run(x, 60)), y) for x, y in (("abcd", 0), ("wxyz", 1)) * 200]
    model.fit([(w, np.full(len(w), y)) for w, y in chains])
    text = run("abcd", 21) + run("wxyz", 2000) + run("abcd", 3)  # the ends speak for one language, nearly all of it for the other
    (label, score, _), (same, _, _) = crf_language.Labeller(model).label([text, run("abcd", 500)])
    assert (label, same) == ("b", "a") and score > 0.9
    whole = run("abcdefgh", 500)
    pieces = crf_language.words_of(whole)
    assert max(map(len, pieces)) <= crf_language.LETTERS and pieces[0] + "".join(p[2:] for p in pieces[1:]) == whole
    assert crf_language.words_of("A" * 24 + " b") == ["a" * 24, "b"] and crf_language.words_of(None) == []


def test_classifiers_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = bt_quality.op6_quality(spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    assert ((good.predicted == 1) == (good.quality == 1)).mean() > 0.9
    bad = fm_toxicity.op4_toxicity(spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    assert bad[bad.toxic == 1].score.mean() > bad[bad.toxic == 0].score.mean() + 0.2


def test_factors_learn_what_weights_cannot():
    rng = np.random.default_rng(0)
    rows = [sorted(set(rng.integers(0, 2, 1).tolist() + (2 + rng.integers(0, 2, 1)).tolist())) for _ in range(400)]
    y = np.array([float((0 in r) == (2 in r)) for r in rows])  # a pair decides, no single term does
    m = fm_toxicity.Machine(np.arange(4), 0.0).fit(rows, y, epochs=60, rate=0.3)
    assert np.mean([(m.score(r) > 0.5) == v for r, v in zip(rows, y)]) == 1.0


def test_toxicity_learns_pairs_that_mean_nothing_apart(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        text = [f"w{rng.randrange(200)}" for _ in range(15)] + [("insult", "flower")[a], ("people", "garden")[b]]
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(a == b)))
    known = spark.createDataFrame(labels[:1000], "doc_id long, label int")
    model = fm_toxicity.train(docs(spark, rows), known)
    terms = fm_toxicity.Terms(model.numbers)
    right = [(model.score(terms.of(rows[i][1])) > 0.5) == (labels[i][1] == 1) for i in range(1000, 1500)]
    assert np.mean(right) > 0.97
    got = {r.doc_id: r.score for r in fm_toxicity.toxicity(docs(spark, rows[1000:1100] + [(None, None), (-1, "")]), model).collect()}
    for i in range(1000, 1100):  # the sum over pairs, written out
        ids = terms.of(rows[i][1])
        z = model.bias + sum(model.w[j] for j in ids) + sum(float(model.v[j] @ model.v[k]) for j, k in combinations(ids, 2))
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9
    assert abs(got[None] - 1 / (1 + np.exp(-model.bias))) < 1e-9 and got[-1] == got[None]


def test_quality_ranks_pairs(spark):
    """The fitted utility orders preference pairs; the stated gradient of the pair loss is zero at the fit."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, bt_quality.FEATURES))
    y = (x[:, 0] - 0.5 * x[:, 3] + rng.normal(0, 0.3, 400) > 0).astype(int)
    m = bt_quality.Ranker().fit(x, y, float((y == 0).mean()), pairs=5000)
    u = m.utility(x)
    assert np.mean(u[y == 1][:, None] > u[y == 0][None, :]) > 0.95
    score = m.score(x)
    assert abs((score < bt_quality.THRESHOLD).mean() - (y == 0).mean()) < 0.02 and (np.diff(score[np.argsort(u)]) >= 0).all()
    pick = np.random.default_rng(4)
    z = m.expand(x)
    d = z[pick.choice(np.flatnonzero(y == 1), 5000)] - z[pick.choice(np.flatnonzero(y == 0), 5000)]
    gradient = d.T @ (1 / (1 + np.exp(-d @ m.beta)) - 1) + m.beta
    assert np.abs(gradient).max() < 1e-3


def test_samples_are_bounded_in_rows(spark):
    d = docs(spark, [(i % 4, f"text number {i} " * 5) for i in range(4000)])
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 0)], "doc_id long, label int")
    assert fm_toxicity.toxicity(d, fm_toxicity.train(d, labels, per_label=2)).count() == 4000
    assert bt_quality.quality(d, bt_quality.train(d, labels, per_label=2)).count() == 4000


def long_rows():
    rng = random.Random(12)
    return [(8, "long " * 30_000), (8, "long " * 30_000), (9, " ".join(f"w{rng.randrange(40)}" for _ in range(60_000)))]


CLASH = ("n", "rep", "shard", "sequence_id", "score", "name", "level", "h", "id", "band", "size", "_host", "_lines", "_kept", "_in", "_out", "_drop", "_site", "_found", "_made", "_cards", "_pattern", "_text", "_id", "component", "row", "words", "_label", "_drop_keys", "_own_host")


@pytest.mark.parametrize("case", ["odd", "empty"])
def test_awkward_tables(spark, case):
    """Null, empty and very long texts, null and repeated ids, columns of clashing names, tables without rows: the values."""
    rows = [] if case == "empty" else [(1, None), (2, ""), (3, "   \n "), (4, "one two"), (5, "one two"), (6, "12 !!"), (7, "x"), *long_rows(), (None, "no id here at all")]
    d = docs(spark, rows).withColumns({c: F.lit("clash") for c in CLASH})
    labels = spark.createDataFrame([(4, 1), (6, 0), (None, 1)], "doc_id long, label int")
    key = lambda r: str(r)
    of = lambda df, *names: sorted((tuple(r[n] for n in names) for r in df.collect()), key=key)
    want = lambda f: sorted((f(i, t) for i, t in rows), key=key)
    text = {i: t or "" for i, t in rows}

    model = crf_language.learn_folds(d)
    got = of(crf_language.identify(d, model), "doc_id", "held_out", "lang_pred")
    letters = lambda t: any(c.isalpha() for c in t or "")
    assert got == want(lambda i, t: (i, None if i is None else zlib.crc32(str(i).encode()) % 5 == 0, "en" if letters(t) else "und"))
    got = of(setsketch.near_duplicates(d), "doc_id", "n_shingles", "component_id", "kept")
    size = lambda t: len(set(zip(*[(t or "").split()[j:] for j in range(5)]))) if len((t or "").split()) >= 5 else int(bool((t or "").split()))
    first = {5: 4}
    assert got == want(lambda i, t: (i, size(t), None if i is None else first.get(i, i), None if i is None else i not in first))
    got = of(exact_dedup.exact_dedup(d), "doc_id", "keep_id", "group_size", "kept")
    groups = {1: (1, 2, True), 2: (1, 2, False), 4: (4, 2, True), 5: (4, 2, False), 8: (8, 2, True)}
    assert got == want(lambda i, t: (i, *groups.get(i, (i, 1, True))))
    got = of(kd_sharding.kd_shards(d), "doc_id", "size", "text_crc32")
    assert got == want(lambda i, t: (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())))
    toxic = fm_toxicity.train(d, labels)
    terms = fm_toxicity.Terms(toxic.numbers)
    got = of(fm_toxicity.toxicity(d, toxic), "doc_id", "held_out", "score", "predicted")
    score = lambda t: toxic.score(terms.of(t))
    assert got == want(lambda i, t: (i, None if i is None else zlib.crc32(str(i).encode()) % 3 == 1, score(t), int(score(t) >= 0.7)))
    ranker = bt_quality.train(d, labels)
    got = of(bt_quality.quality(d, ranker), "doc_id", "score", "predicted")
    value = lambda t: float(ranker.score(bt_quality.features((t or "").encode())[None])[0])
    assert [(x[0], round(x[1], 9), x[2]) for x in got] == want(lambda i, t: (i, round(value(t), 9), int(value(t) >= 0.3)))
    cleaned = line_dedup.drop_boilerplate(d)
    blank = lambda t: sum(bool(x.strip(" \t\r")) for x in (t or "").split("\n"))
    assert of(cleaned, "doc_id", "text", "_lines_in", "_lines_out") == want(lambda i, t: (i, t, blank(t), blank(t)))
    private = pii.pseudonymise(d, "key")
    assert of(private, "doc_id", "text", "_pii") == want(lambda i, t: (i, t, []))
    for out in (cleaned, private):
        assert set(out.columns) >= set(d.columns) and out.where(" and ".join(f"`{c}` = 'clash'" for c in CLASH)).count() == len(rows)
    tok = packing.ids_of(packing.tokenizer_path()).whole
    got = packing.pack(d, packing.tokenizer_path()).toPandas()
    total = sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert got.length.sum() == total and (not rows or got.groupby("sequence_id").length.sum().max() <= 4096)
    hits = decontaminate.contamination(d, spark.createDataFrame([(1, "one two"), (2, None), (3, "long " * 40)], "item_id long, text string"))
    assert of(hits, "doc_id", "item_id", "similarity") == ([(4, 1, 1.0), (5, 1, 1.0), (8, 3, 1.0), (8, 3, 1.0)] if rows else [])
    assert text or not rows


def test_line_ratio_ties(spark):
    """A line on exactly the ratio of pages stays; one on more goes."""
    rows = [(i, "own " + str(i) + ("\ntie" if i < 5 else "") + ("\nmore" if i < 6 else ""), "en", "site") for i in range(250)]
    got = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(docs(spark, rows), max_ratio=0.02).collect()}
    assert got[0] == "own 0\ntie" and got[5] == "own 5"


def test_language_ties_take_the_first_label():
    assert crf_language.Labeller(crf_language.Crf(["a", "b"], [])).label(["some words"]) == [("a", 0.5, [2, 0])]


def test_decontamination_of_repeated_shingles(spark):
    rng = random.Random(4)
    items, rows = [], []
    for i, n in enumerate((60, 120, 200, 300)):
        base = [f"u{rng.randrange(10**6)}" for _ in range(n)]
        same = ["again"] * int(n * 0.33)
        items.append((i, " ".join(base + same)))
        rows.append((i, " ".join(base + same[:-1] + ["b", "c"])))  # nearly the same
        changed = int(len(base + same) * 0.13)
        rows.append((10 + i, " ".join(base + same[: len(same) - changed] + [f"v{rng.randrange(10**6)}" for _ in range(changed)])))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contamination(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for d, t in rows:
        a, b = (Counter(zip(*[x.split()[j:] for j in range(5)])) for x in (t, items[d % 10][1]))
        both = sum((a & b).values())
        value = both / (sum(a.values()) + sum(b.values()) - both)
        assert ((d, d % 10) in got) == (value >= 0.75), (d, value)
    assert len(got) >= 4


@pytest.mark.parametrize("seed", range(3))
def test_sliding_fingerprints(seed):
    rng = np.random.default_rng(seed)
    for _ in range(20):
        n = int(rng.integers(2, 50))
        x, width = rng.integers(0, int(rng.integers(1, n + 1)), n).astype(np.uint64), int(rng.integers(1, n + 1))
        assert (decontaminate.simhashes(x, width) == np.concatenate([decontaminate.simhashes(x[i : i + width], width) for i in range(n - width + 1)])).all()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracles(spark, name):
    import duckdb

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(tuple(str(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got.toPandas()) == rows(want.df())


def test_pipeline_judges_rows(spark):
    """Null and repeated ids: a row's own text decides."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    text = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en' and n_chars between 300 and 2000").limit(4).collect()]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    d = docs(spark, [(1, text[0]), (1, "12345 !!!"), (1, ""), (None, text[1]), (None, "12 !"), (None, f"{text[2]} {item}"), (3, f"{text[2]} {item}"), (7, text[3]), (7, text[3]), (6, text[3]), (None, text[3])])
    spoken = corpus_pipeline.language(spark, d, sf)
    assert spoken.count() == 8 and spoken.columns == d.columns
    single = corpus_pipeline.near_dedup(spark, spoken, sf)
    assert sorted((str(r.doc_id), r.text == text[3]) for r in single.collect()) == [("1", False), ("3", False), ("6", True), ("None", False)]
    clean = corpus_pipeline.decontamination(spark, single, sf)
    assert sorted(str(r.doc_id) for r in clean.collect()) == ["1", "6", "None"]
    assert corpus_pipeline.decontamination(spark, d, sf).count() == 9


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    now = d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, now, sf), name)
        assert out.columns == d.columns and out.count() <= now.count()
        if name == "near_dedup":
            texts = [(r.doc_id, r.text) for r in now.collect()]
            want = {i for i, (_, c) in brute_components(texts).items() if i == c}
            assert {r.doc_id for r in out.collect()} == want
        now = out
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in now.collect()}
    assert now.count() > 0.7 * d.select("text").distinct().count()


def test_quality_learns_from_every_labelled_row(spark, monkeypatch):
    """Sums made in tasks are those over all pairs, and one labelled row more or less changes the fit, however many there are."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["alpha", "Beta!", "42", "gamma,", "DELTA"] if i % 3 else ["alpha", "gamma,", "beta"]) for _ in range(rng.randrange(3, 40))) for i in range(7000)]
    d = docs(spark, list(enumerate(texts)))
    label = [int(i % 3 == 0) if i % 11 else i % 2 for i in range(7000)]
    labels = spark.createDataFrame(list(enumerate(label)), "doc_id long, label int")
    seen = bt_quality.vectors(d)
    whole = bt_quality.fit_all(seen, labels)
    assert np.abs(whole.beta - bt_quality.fit_all(seen, labels.where("doc_id <> 6999")).beta).max() > 1e-9
    x, y = np.array([bt_quality.features(t.encode()) for t in texts[:300]]), np.array(label[:300])
    few = bt_quality.fit_all(seen, labels.where("doc_id < 300"), l2=2.0)
    assert np.allclose(few.mean, x.mean(axis=0)) and np.allclose(few.scale, np.maximum(x.std(axis=0), 1e-6))
    u = few.utility(x)
    assert (few.score(x) < bt_quality.THRESHOLD).sum() in range((1 - y).sum() - 2, (1 - y).sum() + 3) and (np.diff(few.score(x)[np.argsort(u)]) >= 0).all()
    monkeypatch.setattr(bt_quality, "GROUP", 1000)  # one group: all pairs
    few = bt_quality.fit_all(seen, labels.where("doc_id < 300"))
    z = few.expand(x)
    diff = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, 2 * bt_quality.FEATURES)
    gradient = diff.T @ (1 / (1 + np.exp(-diff @ few.beta)) - 1) + len(diff) / bt_quality.PAIRS * few.beta
    assert np.abs(gradient).max() < 1e-6


def test_worker_of_near_dedup_holds_little_at_a_time(monkeypatch):
    texts = [None if i % 7 == 0 else f"text {i}" for i in range(1300)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    got = setsketch._texts(batch)
    assert not isinstance(got, list) and list(got) == [None if t is None else t.encode() for t in texts]
    cache = common.WordHash()
    for i in range(common.HASH_WORDS + 1000):
        cache[b"%d" % i]
    assert len(cache) <= common.HASH_WORDS < common.CACHE_WORDS
    gone = []
    monkeypatch.setattr(common, "give_back", lambda: gone.append(1))
    monkeypatch.setattr(common, "_MEMORY", {})
    assert [common.process_memory(k, list) for k in ("a", "a", "b")] == [[], [], []] and gone == [1]
