"""Operators against brute force in pandas and plain Python, on small fixtures."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isobar.functions import seq
from isobar.operators import calibrate, detect, evaluate, models, network, quality, reviews, scenarios
from isobar.operators.detect import ObservationSpec
from isobar.sources import archive, readers

MIN = 60_000_000


def series(spark, values, g="a"):
    return spark.createDataFrame([(g, i * MIN, None if v is None else float(v)) for i, v in enumerate(values)], "g string, us long, v double")


@pytest.mark.parametrize("adjust", [False, True])
def test_ewm_is_the_running_mean(spark, adjust):
    rng = np.random.default_rng(1)
    x = rng.normal(size=5000)
    got = [r.e for r in seq.ewm(series(spark, x.tolist()), "v", 12.0, ["g"], "e", adjust=adjust).orderBy("us").collect()]
    assert np.allclose(got, pd.Series(x).ewm(halflife=12, adjust=adjust).mean())


def test_ewm_starts_anew_with_each_group(spark):
    d = series(spark, [1.0, 2.0], "a").unionByName(series(spark, [10.0, None], "b"))
    got = {(r.g, r.us): r.e for r in seq.ewm(d, "v", 1.0, ["g"], "e").collect()}
    assert got == {("a", 0): 1.0, ("a", MIN): 1.5, ("b", 0): 10.0, ("b", MIN): 5.0}


def test_robust_score_against_pandas(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(15, 2, 700)
    x[100:140] = 14.0  # stuck
    x[200:260] = np.minimum(x[200:260], 14.5)  # clipped
    x[300] = 60.0
    x[400:600] = 15 + (x[400:600] - 15) * 4  # gain
    x[650:655] = np.nan
    d = series(spark, [None if math.isnan(v) else v for v in x])
    fit = quality.robust_fit(d.where(F.col("us") < 100 * MIN), "v", ["g"]).first()
    s = pd.Series(x)
    ref = s[:100]
    steps, dev = ref.diff().abs().dropna(), ref.rolling(8, min_periods=8).std().dropna()
    mad = 1.4826 * (ref - ref.median()).abs().median()
    sd = max(1.4826 * steps.median(), 1e-3)
    sigma = max(mad, (ref - ref.median()).abs().quantile(0.95) / 3, 0.25)
    hi, stuck = max(dev.quantile(0.995), 0.125 * mad, 0.5 * sd, 1e-6), max(0.5 * max(dev.quantile(0.005), 1e-9), 1e-9)
    usual = ref.rolling(168, min_periods=24).std().dropna().median()
    assert np.allclose([fit.med, fit.sigma, fit.sigma_d, fit.std_hi, fit.stuck, fit.std_long], [ref.median(), sigma, max(sd, 0.25 * sigma, 0.125), hi, stuck, usual])
    r8, top = s.rolling(8, min_periods=8).std(), s.rolling(24, min_periods=24).max()
    flat = r8 <= stuck
    run = flat.astype(int).groupby((~flat).cumsum()).cumsum()
    eps = 1e-9 + 1e-3 * sigma
    pinned = ((top - s) <= eps) & (top.diff().abs().rolling(6, min_periods=6).max() <= eps) & (r8 > stuck)
    share = pinned.astype(float).rolling(24, min_periods=8).mean().fillna(0)
    seen = s.notna().astype(int).groupby(s.isna().cumsum()).cumsum()
    ratio = s.rolling(168, min_periods=24).std().where(seen >= 24) / usual
    ratio = np.maximum(ratio, 1 / np.maximum(ratio, 1e-9))
    parts = [(s - ref.median()).abs() / sigma, s.diff().abs() / max(sd, 0.25 * sigma, 0.125), np.where(flat, 3 + 4 * np.clip(run / 48, 0, 1), 0), (r8 / hi - 1.25).clip(lower=0), ((share - 0.2) / 0.15).clip(lower=0) * 2, (ratio - 1.3).clip(lower=0) * 1.5]
    want = np.where(s.notna(), np.max([np.nan_to_num(np.asarray(p, float)) for p in parts], axis=0), 0.0)
    fitted = quality.robust_fit(d.where(F.col("us") < 100 * MIN), "v", ["g"])
    got = [r.x for r in quality.robust_channel_score(d, fitted, "v", ["g"]).orderBy("us").select(F.col("v__robust").alias("x")).collect()]
    assert np.allclose(got, want, atol=1e-6)


def test_pattern_features_against_pandas(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(10, 3, 400), 1)
    x[50:60], x[200:230] = np.nan, 7.0
    d = quality.pattern_features(series(spark, [None if math.isnan(v) else v for v in x]), "v", MIN, ["g"], bounds=(5.0, 12.0)).orderBy("us").toPandas()
    s = pd.Series(x)
    past = s.shift(1)
    for k in (1, 5, 15, 60, 120):
        assert np.allclose(d[f"v__delta{k}"].astype(float), s - s.shift(k), equal_nan=True)
    for k in (5, 30, 120):
        roll = past.rolling(k, min_periods=max(2, k // 2))
        assert np.allclose(d[f"v__mean{k}"].astype(float), roll.mean(), equal_nan=True) and np.allclose(d[f"v__std{k}"].astype(float), roll.std(ddof=0), equal_nan=True, atol=1e-6)
    same = s.notna() & s.eq(past)
    assert np.allclose(d.v__repeat.astype(float), same.groupby((~same).cumsum()).cumsum().clip(upper=180).astype(float).where(s.notna()), equal_nan=True)
    gone = s.isna()
    assert (d.v__absent == gone.groupby((~gone).cumsum()).cumsum()).all()
    assert np.allclose(d.v__range_excess.astype(float), np.maximum(5 - s, np.maximum(s - 12, 0)), equal_nan=True)


@pytest.mark.parametrize("radius", [200.0, 900.0])
def test_peers_near_poles_and_the_date_line(spark, radius):
    rng = random.Random(2)
    points = [(i, rng.uniform(-89.5, 89.5), rng.uniform(-180, 180)) for i in range(150)] + [(200 + i, rng.uniform(84, 89.9), rng.uniform(-180, 180)) for i in range(20)] + [(300 + i, rng.uniform(-3, 3), (177 + rng.uniform(0, 6) + 180) % 360 - 180) for i in range(20)]

    def km(a, b):
        h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))

    want = {p[0]: [q[0] for q in sorted(points, key=lambda q: (km(p, q), q[0])) if q != p and km(p, q) <= radius][:4] for p in points}
    got: dict[int, list] = {p[0]: [] for p in points}
    for r in network.nearest_peers(spark.createDataFrame(points, "station long, lat double, lon double"), radius_km=radius).orderBy("station", "rank").collect():
        got[r.station].append(r.peer)
    assert got == want


@pytest.mark.parametrize("keys", [2, 7, 400])
def test_corrections_leave_the_own_values_out(spark, keys):
    rng = random.Random(keys)
    rows = [(f"s{k}", t, round(rng.gauss(10, 4), 0 if k % 2 else 3), k * 100 + t) for k in range(keys) for t in range(rng.randrange(1, 45))]
    got = {r.target: r for r in network.correction_proposals(spark.createDataFrame(rows, "k string, us long, v double, id long"), "k", "v", tie="id").collect()}
    tail = {k: [r[2] for r in sorted(rows, key=lambda r: -r[1]) if r[0] == k][:30] for k in {r[0] for r in rows}}
    assert set(got) == set(tail)
    for k in tail:
        others = [v for j, x in tail.items() if j != k for v in x]
        assert got[k].value == tail[k][0] and abs(got[k].proposal - np.median(others)) < 1e-9 and abs(got[k].deviation - np.std(others)) < 1e-6


def test_fault_ladder(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(20, 2, 60)
    cases = {
        "dropout": [None] * 8 + [20.0] * 2, "stuck": [21.0] * 8, "drift": [20 + i for i in range(12)], "noise_burst": (20 + rng.normal(0, 12, 30)).tolist(), "spike": [20.0, 60.0],
        "bias": (base[:10] + 6).tolist(), "scale_error": (20 + (base[:20] - 20) * 0.15).tolist(), "unknown": [1.0, 2.0, 3.0],
    }
    events = spark.createDataFrame([(k, i, None if v is None else float(v)) for k, x in cases.items() for i, v in enumerate(x)], "k string, us long, v double")
    reference = spark.createDataFrame([(k, i, float(v)) for k in cases if k != "unknown" for i, v in enumerate(base)], "k string, us long, v double")
    got = {r.k: r.fault for r in models.classify_event(events, reference, ["k"], "v").collect()}
    assert got == {k: k for k in cases}


def test_fused_corrections(spark):
    d = spark.createDataFrame([("a", 0, 10.0, 2.0, 14.0), ("a", 1, 10.0, None, None)], "g string, us long, normal double, resid double, far double")
    got = network.corrected_series(d, ["g"], "normal", "resid", 1.0, [(F.col("far"), 2.0)]).orderBy("us").collect()
    w1, w2 = 1 / (1 + 4 * 0.05), 1 / 4
    assert abs(got[0].corrected - (12 * w1 + 14 * w2) / (w1 + w2)) < 1e-9 and abs(got[0].confidence - min(1, 1.5 / (1 + (1 / (w1 + w2)) ** 0.5))) < 1e-9
    assert abs(got[1].corrected - (10 + 2 * math.exp(-1 / 12))) < 1e-9


def test_reviewed_background_and_checks(spark):
    rows = [(i, i in (5, 6, 20)) for i in range(30) if i != 12]
    d = spark.createDataFrame([("a|b", "v", i * MIN, alert, f"id{i}") for i, alert in rows] + [("a|b", "v", 40 * MIN, None, "id40")], "g string, channel string, us long, alert boolean, id string")
    r = spark.createDataFrame([("r1", "a|b", "v", 0, 25 * MIN)], "review_id string, g string, channel string, start_us long, end_us long")
    got = reviews.background_results(d, r, ["g", "channel"], MIN).first()
    assert (got.observed_rows, got.scored_rows, got.false_alert_rows, got.false_alert_episodes, got.contiguous_scored_seconds) == (24, 24, 3, 2, 22 * 60.0)
    assert reviews.check_decisions(d.unionByName(d.limit(1)), ["g", "channel"]).where("reject_reason = 'repeated_time'").count() == 2
    with pytest.raises(TypeError):
        reviews.check_decisions(d.withColumn("alert", F.col("alert").cast("string")), ["g", "channel"])


def test_provider_agreement_and_blanking(spark):
    d = spark.createDataFrame([(True, True, None), (False, None, True), (True, None, True), (None, True, None), (False, None, None)], "alert boolean, ok boolean, bad boolean")
    assert tuple(reviews.provider_agreement(d, "ok", "bad").first()) == (3, 1, 1, 1, 0)
    d = spark.createDataFrame([(True, False, 1.0), (False, None, 2.0)], "a boolean, b boolean, x double")
    assert [r.x for r in reviews.blank_rows(d, ["a", "b"], ["x"]).collect()] == [None, 2.0]


def test_best_f1_and_weight_search(spark):
    rng = np.random.default_rng(4)
    y = (rng.random(300) < 0.2).astype(float)
    s = np.round(y + rng.normal(0, 0.7, 300), 1)

    def at(t):
        p = s >= t
        tp = (p & (y == 1)).sum()
        f1 = 2 * tp / (p.sum() + y.sum())
        return f1 / 2 if tp / p.sum() < 0.35 else f1

    assert abs(calibrate.best_f1(s, y) - max(at(t) for t in np.unique(s))) < 1e-12
    d = spark.createDataFrame([("a" if i % 2 else "b", float(y[i]), float(s[i]), float(rng.normal())) for i in range(300)], "g string, y double, good double, noise double")
    weights, objective = calibrate.search_weights(d, "g", ["good", "noise"], "y", calibrate.weight_candidates(2, draws=32))
    assert weights["good"] > 0.7 and objective > 0.3


def test_temperature_fit(spark):
    rng = np.random.default_rng(8)
    logits = rng.normal(0, 2, (600, 3))
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    truth = [int(rng.choice(3, p=row)) for row in p]
    sharp = np.exp(logits * 2.5)
    sharp /= sharp.sum(axis=1, keepdims=True)  # over-confident by 2.5
    d = spark.createDataFrame([(row.tolist(), t) for row, t in zip(sharp, truth)], "p array<double>, t int")
    assert abs(calibrate.fit_temperature(d, "p", "t") - 2.5) < 0.5
    soft = d.select(calibrate.with_temperature("p", 2.5).alias("q")).first().q
    assert np.allclose(soft, p[0])


def test_quantile_threshold_of_constant_scores(spark):
    d = spark.createDataFrame([("a", 2.0)] * 5 + [("b", float(i)) for i in range(101)], "g string, s double")
    got = {r.g: r.threshold for r in evaluate.quantile_threshold(d, "s", 0.5, ["g"]).collect()}
    assert got == {"a": math.nextafter(2.0, 3.0), "b": 50.0}


def test_scenarios_never_fill_and_repeat(spark):
    spec = scenarios.ScenarioSpec(channels=("t", "p", "h"), sizes=((1.5, 10.0), (2.0, 15.0), (6.0, 35.0)), gains=((0.65, 0.9), (0.97, 0.985), (0.65, 0.9)), rows=scenarios.FAULT_ROWS)
    rng = np.random.default_rng(1)
    d = spark.createDataFrame([(f"w{w}", i, i * MIN, float(rng.normal(15, 2)) if i % 37 else None, float(rng.normal(1000, 3)), float(rng.uniform(20, 90))) for w in range(3) for i in range(720)], "window_id string, i long, us long, t double, p double, h double")
    for fault in (*scenarios.FAULT_ROWS, "no_injection"):
        out = scenarios.generate(d, fault, spec)
        assert out.where(" or ".join(f"({c} is null and scenario__{c} is not null)" for c in ("t", "p", "h"))).isEmpty()
        log = scenarios.event_log(out).collect()
        least, below = scenarios.FAULT_ROWS.get(fault, (0, 1))
        for r in log:
            assert 195 <= r.start < 270 and (fault == "no_injection" or least <= r.stop - r.start < below) and r.modified_rows <= max(0, r.stop - r.start)
        assert out.where("modified and (i < start or i >= stop)").isEmpty() and (fault == "no_injection") == (not any(r.applied for r in log))
        again = scenarios.generate(d.repartition(7), fault, spec)
        assert out.select("scenario_id", "i", "scenario__t").exceptAll(again.select("scenario_id", "i", "scenario__t")).isEmpty()


def test_injected_faults_and_their_log(spark):
    rng = np.random.default_rng(2)
    d = series(spark, [None if i % 50 == 7 else float(v) for i, v in enumerate(rng.normal(10, 2, 1200))]).withColumn("other", F.col("us") % 97 + 0.5)
    out = models.inject_faults(d, ["g"], "v", rate=0.9, length=12, swap="other")
    assert {r.fault for r in out.where("modified").select("fault").distinct().collect()} == {"spike", "drift", "stuck", "dropout", "noise", "bias", "clipping", "scale_error", "sensor_swap"}
    assert out.where("v is null and injected is not null").isEmpty()
    log = models.injection_log(out, ["g"])
    assert log.agg(F.sum("rows")).first()[0] == out.where("modified").count() and log.where("rows > 12").isEmpty()


def test_live_decisions(spark):
    d = series(spark, [20.0, 20.1, -300.0, None, 45.0])
    spec = ObservationSpec(horizons=(1, 2), lags=(0, 1), sustained=2)
    s = detect.live_decisions(detect.compute_signals(d, spec), spec, {("v", "abrupt_change"): 10.0}, {"v": ((-273.15, "physical_domain"), (100.0, "reporting_range"))}).orderBy("us").collect()
    assert [r.severity for r in s] == ["info", "info", "high", "info", "info"] and s[2].physics_alerts == "v:physical_domain" and s[3].missing_channels == "v" and s[3].scoring_status == "missing_observation"


def test_readers_of_series_packets_and_receipts(spark, tmp_path):
    (tmp_path / "s.csv").write_text("timestamp,value\n2024-01-01 00:00:00,1.0\n2024-01-01 00:05:00,9.0\n2024-01-01 00:10:00,1.5\n")
    (tmp_path / "w.json").write_text('{"x/s.csv": [["2024-01-01 00:04:00", "2024-01-01 00:06:00"]]}')
    got = readers.read_benchmark_series(spark, f"file://{tmp_path}/s.csv", f"file://{tmp_path}/w.json", "x/s.csv").orderBy("timestamp").collect()
    assert [r.label for r in got] == [0, 1, 0]
    receipts = readers.file_receipts(spark, f"file://{tmp_path}/s.csv").first()
    assert receipts.bytes == (tmp_path / "s.csv").stat().st_size
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, "k")], "x int, y string")
    u = readers.union_sources({"train": a, "test": b})
    assert sorted((r.x, r.y, r.role) for r in u.collect()) == [(1, None, "train"), (2, "k", "test")] and readers.frames_equal(a, a)
    d = spark.createDataFrame([("s", "src", "2024-01-01 00:00:00", 1.0), ("", "src", "2024-01-01 00:00:00", 1.0), ("s", "a|b", "2024-01-01 00:00:30", float("nan"))], "station_id string, source string, ts string, t double").withColumn("ts", F.to_timestamp("ts"))
    admitted = readers.admit(d, ["t"]).collect()
    assert [r.reject_reason for r in admitted] == [None, "bad_station_id", "bad_source"] and admitted[2].t is None


def test_flatline_over_shards(spark):
    rng = random.Random(3)
    x = [None if rng.random() < 0.05 else float(rng.random() < 0.15) for _ in range(400)] + [7.0] * 200
    d = series(spark, x).where("us % 7 <> 1 or us > 24000000000")
    want = seq.flatline(d, "v", MIN, ["g"], "flat").orderBy("us").select("us", "flat").collect()
    for shard in (3, 10, 64, 1000):
        assert archive.flatline_by_shard(d, "v", MIN, ["g"], shard * MIN).orderBy("us").select("us", "flat").collect() == want


def test_footers_manifests_bundles_and_audits(spark, tmp_path):
    d = series(spark, [1.0, None, 3.0]).unionByName(series(spark, [4.0], "b"))
    d.write.partitionBy("g").parquet(f"file://{tmp_path}/t.parquet")
    out = archive.footer_catalog(spark, f"file://{tmp_path}/t.parquet", "us", ["g"])
    assert "PushedAggregation: [COUNT" in out._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in out.collect()) == [("a", 3, 0, 2 * MIN), ("b", 1, 0, 0)]
    assert archive.inventory(spark, f"file://{tmp_path}/t.parquet").agg(F.sum("rows"), F.max("columns")).first()[:] == (4, 3)
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x.csv").write_text("a\n1\n")
    (tmp_path / "m" / "y.csv").write_text("a\n2\n")
    receipts = readers.file_receipts(spark, f"file://{tmp_path}/m")
    sha = {r.path.rsplit("/", 1)[1]: r.sha256 for r in receipts.collect()}
    manifest = spark.createDataFrame([("x.csv", sha["x.csv"].upper()), ("z.csv", "0" * 64), ("../y.csv", "0" * 64)], "name string, sha256 string")
    got = {r.name: r.status for r in archive.check_manifest(manifest, receipts, f"file://{tmp_path}/m").collect()}
    assert got == {"x.csv": "ok", "z.csv": "missing", "../y.csv": "escapes", "y.csv": "unlisted"}
    import gzip

    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write("k,v\na,1\n")
    assert archive.read_bundle(spark, f"file://{tmp_path}", "b", "k string, v int").collect()[0].v == 1
    assert archive.read_bundle(spark, f"file://{tmp_path}", "t").count() == 4
    (tmp_path / "side.json").write_text('{"groups": ["a"],\n "n": 2}')
    assert archive.read_side_file(spark, f"file://{tmp_path}/side.json").first().n == 2
    raw = spark.createDataFrame([("s", "t1", "+0215,1"), ("s", "t1", "9999,9"), ("s", None, "x2,1"), ("s", "t2", None)], "station string, ts string, TMP string")
    assert tuple(archive.audit(raw, ["station"], "ts", {"t": "TMP"}).first()) == ("s", 4, 1, 1, 1, 2, 1)
    archive.write_csv(raw, f"file://{tmp_path}/out")
    with pytest.raises(Exception, match="exists"):
        archive.write_csv(raw, f"file://{tmp_path}/out")
    a, b = archive.shard_manifest(d, ["g"], ["v"]), archive.shard_manifest(d.repartition(5), ["g"], ["v"])
    assert sorted(a.collect()) == sorted(b.collect())


def test_inference_from_a_file(spark, tmp_path):
    from isobar import cli

    rng = random.Random(1)
    lines = ["group,timestamp,temperature_c,other"] + [f"a|b,2024-01-01T{i // 60:02d}:{i % 60:02d}:00Z,{60 if i == 300 else 15 + rng.random()},x" for i in range(360)]
    (tmp_path / "in.csv").write_text("\n".join(lines))
    assert cli.main([f"file://{tmp_path}/in.csv", f"file://{tmp_path}/out", "--leading", "200"], spark) == 0
    events = spark.read.option("header", True).csv(f"file://{tmp_path}/out/candidate_events").collect()
    at = {(int(e.start_us) - 1704067200000000) // MIN for e in events}
    assert 300 in at and spark.read.parquet(f"file://{tmp_path}/out/decisions").count() == 160
    with pytest.raises(SystemExit):
        cli.main([f"file://{tmp_path}/in.csv", f"file://{tmp_path}/o2", "--channels", "none"], spark)


def test_dashboard(spark):
    from isobar.operators.report import Dashboard

    d = series(spark, [1.0, 2.0, None, 4.0]).withColumn("alert", F.col("v") > 3).withColumn("score", F.col("v")).withColumn("reason_codes", F.lit("x"))
    b = Dashboard(d, MIN)
    assert tuple(b.status().first()) == (1, 4, 3, 3 * MIN) and b.catalog().first().n == 4
    assert tuple(b.scenario("a", "spike", 0, 2 * MIN, 5.0)["summary"].first()) == (4, 1)
    w = b.window("a", 0, 3 * MIN)
    assert w["summary"].first().candidates == 1 and w["candidates"].count() == 1 and b.events("a").count() == 1 and b.health("a").count() == 1


@pytest.mark.parametrize("q", [0.0, 0.3, 0.98, 1.0])
def test_higher_quantile_of_all_kinds_of_values(spark, q):
    rng = np.random.default_rng(9)
    values = {"wide": rng.normal(0, 1, 300) * 10.0 ** rng.integers(-12, 12, 300), "narrow": 1000 + rng.normal(0, 1e-7, 300), "ties": rng.integers(-2, 3, 300).astype(float), "zero": np.zeros(20), "one": np.array([-3.5])}
    d = spark.createDataFrame([(k, float(v)) for k, x in values.items() for v in x] + [("wide", None)], "k string, x double")
    got = {r.k: (r.threshold, r.reference_rows) for r in detect.higher_quantile(d, ["k"], "x", q).collect()}
    assert got == {k: (float(np.quantile(x, q, method="higher")), len(x)) for k, x in values.items()}


def test_event_rules_read_no_frame_anew_for_every_row(spark):
    """A frame from each row to the end costs the square of an event's rows; missing first values are still the next one's."""
    rows = [("late", i, None if i < 4 else 5.0) for i in range(12)] + [("gone", i, None if i > 1 else 5.0) for i in range(12)] + [("runs", i, float(i % 7)) for i in range(12)]
    d = spark.createDataFrame(rows, "k string, us long, v double")
    got = models.classify_event(d, d.where("k = 'runs'").drop("k").crossJoin(d.select("k").distinct()), ["k"], "v")
    assert "currentrow$(), unboundedfollowing" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {r.k: (r.rows, r.seen, r.fault) for r in got.collect()} == {"late": (12, 8, "stuck"), "gone": (12, 2, "dropout"), "runs": (12, 12, "complex")}


def test_isolation_forest_of_full_size_is_grown_and_walked_in_arrays(spark):
    """300 trees on samples of 65,536 rows: grown in tasks, none a second long; paths are those of the trees' own cuts."""
    rng = np.random.default_rng(3)
    x = np.stack([np.round(rng.exponential(30, 20_000), 2), rng.integers(0, 100, 20_000).astype(float)], axis=1)
    x[:500] = x[0]  # a leaf of many equal rows
    forest = models.IsolationForest(trees=5, sample=65_536).fit(x)
    at = rng.integers(0, len(x), 200)
    depth = np.zeros(len(at))
    for feature, cut, kids, length in forest.roots:
        assert length.dtype == np.float32 and len(kids) == 2 * len(cut)
        for i, row in enumerate(x[at]):
            node = 0
            while kids[2 * node] != node:
                node = kids[2 * node + int(row[feature[node]] >= cut[node])]
            depth[i] += length[node]
    assert np.allclose(forest.score(x[at]), 2.0 ** (-depth / 5 / float(forest._c(forest.n))))
    d = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x[:3000])], "id long, a double, b double")
    got = {r.id: r.score for r in models.isolation_scores(d, ["a", "b"], "id", trees=7, sample=65_536).collect()}
    order = [r.id for r in d.orderBy(F.xxhash64("id"), "id").collect()]
    whole = models.IsolationForest(trees=7, sample=65_536).fit(x[order])
    assert len(got) == 3000 and np.allclose([got[i] for i in range(3000)], whole.score(x[:3000]))


def test_sampled_windows_are_contiguous_and_even(spark):
    """Starts every 4 rows of a run with 12 rows ahead in it, at most 10 of a key, as counted in plain Python."""
    rng = random.Random(9)
    kept = [(g, i, float(i)) for g in ("a", "b") for i in range(300) if g == "a" or rng.random() > 0.06]
    got = {(r.g, r.start_us) for r in calibrate.window_sample(spark.createDataFrame(kept, "g string, us long, v double"), ["g"], 1, 12, 4, 10).collect()}
    want = set()
    for g in ("a", "b"):
        at = {us for k, us, _ in kept if k == g}
        first = lambda us: us if us - 1 not in at else first(us - 1)
        starts = sorted(us for us in at if (us - first(us)) % 4 == 0 and all(us + i in at for i in range(12)))
        n = len(starts)
        want |= {(g, s) for p, s in enumerate(starts) if n <= 10 or (p + 1) * 10 // n > p * 10 // n}
    assert got == want and len([g for g, _ in got if g == "a"]) == 10
