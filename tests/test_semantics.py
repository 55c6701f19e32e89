"""Hand-computed vectors and metamorphic properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar.functions import physics, seq
from isobar.operators import detect, evaluate, models, network, quality
from isobar.operators.detect import ObservationSpec
from isobar.sources import readers
from isobar.streaming.detector import GroupDetector, Watchdog
from isobar.streaming.replay import replay

MIN = 60_000_000


def frame(spark, values, skip=(), g="a|b"):
    return spark.createDataFrame([(g, i * MIN, v) for i, v in enumerate(values) if i not in skip], "g string, us long, v double")


def col(df, name):
    return [r[0] for r in df.orderBy("us").select(name).collect()]


def test_flatline_gap_and_missing(spark):
    values = [7.0] * 12
    values[8] = None
    got = col(seq.flatline(frame(spark, values, {5}), "v", MIN, ["g"], "flat"), "flat")
    assert got == [0, 1, 2, 3, 4, 0, 1, None, 0, 1, 2]


def test_flatline_quality(spark):
    d = frame(spark, [7.0] * 6).withColumn("ok", F.col("us") != 3 * MIN)
    assert col(seq.flatline(d, "v", MIN, ["g"], "flat", accepted="ok"), "flat__ok") == [True] * 3 + [False] * 3


def test_sustained_null_after_gap(spark):
    d = detect.compute_signals(frame(spark, [float(i % 7) for i in range(300)], {250}), ObservationSpec())
    got = {r.us // MIN: r.x for r in d.select("us", F.col("v__sustained_deviation").alias("x")).collect()}
    assert all(got[i] is None for i in range(251, 280)) and got[280] is not None


def test_future_does_not_change_past(spark):
    ramp = [(i + 1) / 10 for i in range(250)]
    late = ramp[:200] + [9999.0] * 50
    pick = ["us", *[f"v__{s}" for s in detect.SIGNALS]]
    a, b = (detect.compute_signals(frame(spark, x), ObservationSpec()).select(*pick).where(F.col("us") < 200 * MIN) for x in (ramp, late))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_tri_state(spark):
    d = spark.createDataFrame([("g", i, "v", "abrupt_change", x, 1.0) for i, x in enumerate([1.0, 2.0, None])], "g string, us long, channel string, signal string, value double, threshold double")
    assert col(detect.decide(d, ["g"]), "alert") == [False, True, None]


def test_higher_quantile(spark):
    d = spark.createDataFrame([(float(i),) for i in range(100)], "x double").withColumn("k", F.lit(1))
    assert detect.higher_quantile(d, ["k"], "x", 0.5).first().threshold == float(np.quantile(np.arange(100.0), 0.5, method="higher"))


def test_higher_quantile_ties(spark):
    x = np.repeat([1.0, 2.0, 3.0], [50, 3, 47])
    d = spark.createDataFrame([(float(v),) for v in x], "x double").withColumn("k", F.lit(1))
    for q in (0.1, 0.49, 0.5, 0.52, 0.9, 1.0):
        assert detect.higher_quantile(d, ["k"], "x", q).first().threshold == float(np.quantile(x, q, method="higher"))


def test_candidate_events(spark):
    d = spark.createDataFrame([("g|s", "t", i * MIN, a, 1.0, "r", f"o{i}") for i, a in ((0, False), (1, True), (2, True), (3, False), (4, None), (6, True))], "g string, channel string, us long, alert boolean, score double, reason_codes string, id string")
    assert sorted(r.observations for r in detect.candidate_events(d, ["g", "channel"], MIN).collect()) == [1, 2]


def test_range_wise_and_latency(spark):
    y, p = [0, 1, 1, None, 1, 0, 0, 1], [0, 0, 1, 1, 0, 1, 0, 1]
    d = spark.createDataFrame([("g", i, a, b) for i, (a, b) in enumerate(zip(y, p))], "g string, o int, y int, p int")
    r = evaluate.range_wise(d, ["g"], "o").first()
    assert (r.true_segments, round(r.recall, 6), r.predicted_segments) == (3, round(2 / 3, 6), 3)
    assert evaluate.detection_latency(d, ["g"], "o").first().mean_latency == 0.5


@pytest.mark.parametrize("seed", range(3))
def test_sweep_and_auc_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    y, s = rng.integers(0, 2, 60), rng.integers(0, 12, 60) / 4
    d = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, score double")
    best = max(((2 * ((s >= t) & (y == 1)).sum() / ((s >= t).sum() + y.sum()) * (0.5 if y[s >= t].mean() < 0.35 else 1), t) for t in set(s)))
    assert evaluate.threshold_sweep(d).first().threshold == best[1]
    pairs = [(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
    assert math.isclose(evaluate.roc_auc(d).first().roc_auc, np.mean(pairs), abs_tol=1e-9)


def test_health_vector(spark):
    d = spark.createDataFrame([("g", i * MIN, a, v) for i, (a, v) in enumerate(zip([True, False, None, None, None], [1.0, 2.0, None, None, None]))], "g string, us long, alert boolean, v double")
    r = network.station_health(d, ["g"]).first()
    assert (r.rate, r.scored, round(r.missing, 6), r.health) == (0.5, 2, 0.6, "critical")


def test_missing_slots_rounding(spark):
    d = frame(spark, [1.0] * 2).unionByName(frame(spark, [1.0] * 6, {0, 1, 2, 3, 4}).withColumn("us", F.col("us") + 30_000_000))
    assert detect.missing_intervals(d, MIN, ["g"]).first().slots == 4
    assert detect.missing_intervals(d, MIN, ["g"], rounding="floor").first().slots == 3


def test_reviews_are_half_open(spark):
    d = spark.createDataFrame([("g", "c", i * MIN, i == 2) for i in range(6)], "g string, channel string, us long, alert boolean")
    r = spark.createDataFrame([("r1", "g", "c", 0, 2 * MIN, 0, MIN), ("r2", "g", "c", 2 * MIN, 3 * MIN, 0, MIN)], "review_id string, g string, channel string, start_us long, end_us long, onset_earliest_us long, onset_latest_us long")
    got = {x.review_id: (x.scored_rows, x.detected, x.delay_min_s, x.delay_max_s) for x in detect.evaluate_reviews(d, r, ["g", "channel"]).collect()}
    assert got == {"r1": (2, False, None, None), "r2": (1, True, 60.0, 120.0)}


def test_ewm_against_loop(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    alpha, now, want = 1 - 0.5 ** (1 / 3), None, []
    for v in x:
        now = v if now is None else alpha * v + (1 - alpha) * now
        want.append(now)
    got = col(seq.ewm(frame(spark, [float(v) for v in x]), "v", 3.0, ["g"], "e"), "e")
    assert np.allclose(got, want, atol=1e-12)


def test_stuck_and_zero_runs(spark):
    assert col(quality.stuck_flag(frame(spark, [20.0] * 26), "v", ["g"]), "v__stuck") == [False] * 23 + [True] * 3
    got = col(quality.stuck_flag(frame(spark, [20.0] * 5 + [None] + [20.0] * 4), "v", ["g"], 4), "v__stuck")
    assert [i for i, f in enumerate(got) if f] == [3, 4, 9]
    got = col(quality.zero_run_flag(frame(spark, [10.0, 0.0, 0.0, 0.0, 0.0, None, 0.0, 0.0, 0.0, 10.0]), "v", ["g"]), "v__dropout")
    assert [i for i, f in enumerate(got) if f] == [3, 4, 8]


def test_scenarios_leave_missing_alone(spark):
    d = frame(spark, [1.0, None, 3.0, 4.0, 5.0])
    assert col(network.scenario(d, "spike", "v", MIN, 3 * MIN, 10.0, ["g"]), "scenario") == [1.0, None, 13.0, 4.0, 5.0]
    assert col(network.scenario(d, "stuck", "v", 2 * MIN, 2 * MIN, 0.0, ["g"]), "scenario") == [1.0, None, 3.0, 3.0, 5.0]
    assert col(network.scenario(d, "dropout", "v", 2 * MIN, 2 * MIN, 0.0, ["g"]), "changed") == [False, False, True, True, False]


def test_stream_equals_batch_over_batches(spark):
    values = [20 + 5 * math.sin(i / 9) for i in range(120)]
    values[30:60] = [7.0] * 30
    values[70] = None
    d = frame(spark, values, {90, 91})
    spec = ObservationSpec(horizons=(1, 10), sustained=5)
    want = detect.compute_signals(d, spec).select("us", *[F.col(f"v__{s}").alias(s) for s in detect.SIGNALS]).toPandas().sort_values("us")
    got = replay(spark, d, MIN, batches=4, near=1, far=10, sustained=5).toPandas().sort_values("us")
    assert len(got) == len(want)
    for s in detect.SIGNALS:
        assert np.allclose(got[s].to_numpy(float), want[s].to_numpy(float), atol=1e-12, equal_nan=True), s


def test_packet_is_atomic():
    d = GroupDetector(MIN, 1, 10, 5)
    d.offer([(0, 1.0), (MIN, 2.0)])
    before = d.payload()
    assert {r[-1] for r in d.offer([(2 * MIN, 1.0), (MIN, 3.0)])} == {"rejected_late_or_duplicate"} and d.payload() == before
    assert d.overdue(5 * MIN) == 3


def test_watchdog():
    w = Watchdog(60, {"t": 5.0}, flat_s=120)
    assert w.ingest(0, {"t": 1.0})["alerts"] == []
    assert w.ingest(60, {"t": 9.0})["alerts"] == [("t", "step")]
    assert [w.ingest(60 * i, {"t": 9.0})["alerts"] for i in (2, 3, 4)] == [[], [], [("t", "flatline")]]
    assert w.ingest(600, {"t": 50.0}) == {"alerts": [], "skipped": 5}
    assert w.heartbeat(700)["overdue"]


def test_daily_scan(spark, tmp_path):
    def line(minute, t="21.5", q="0", n=48, doy="32"):
        f = ["2024", doy, "2", "1", "0", str(minute), "0.0", "50.0"] + ["1.0", "0"] * 20
        f[38], f[39], f[40], f[41], f[46], f[47] = t, q, "55.0", "0", "990.1", "0"
        return " ".join(f[:n])

    (tmp_path / "day.dat").write_text("\n".join([" Name", " 40 -88 200 m version 1", line(0), line(1, "-9999.9"), line(2, n=40), line(3, doy="33"), line(4, q="1")]) + "\n")
    got = readers.read_daily(spark, str(tmp_path)).orderBy("raw_row_number").collect()
    assert [r.temperature_c for r in got] == [21.5, None, None, None, 21.5]
    assert [r.reject_reason for r in got] == [None, None, "field_count", "day_of_year", None]
    assert [r.temperature_c__qc_accepted for r in got] == [True, None, None, None, False]
    assert [r.raw_row_number for r in got] == [3, 4, 5, 6, 7]


def test_hourly_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text('STATION,DATE,TMP,DEW,SLP,REM\nA,2024-01-01T01:00:00,"+0250,1","-0010,2","10132,1","two\nlines"\nA,2024-01-01T00:00:00,"+9999,9","x,1","99999,9",""\n')
    got = readers.read_hourly_csv(spark, str(tmp_path / "s.csv")).orderBy("source_row").collect()
    assert [r.temperature_c for r in got] == [25.0, None] and got[0].dew_point_c is None and got[0].dew_point_c__qc_value == -1.0
    assert got[0].sea_level_pressure_hpa == 1013.2 and [r.source_row for r in got] == [1, 2]


def test_packets(spark):
    lines = ['{"kind": "observation", "timestamp": "2024-01-01T00:00:00Z", "group": "a|b", "temperature_c": 1.5}', '{"kind": "observation", "group": "a|b", "temperature_c": NaN, "timestamp": "2024-01-01T00:00:00Z"}', "nope", '{"kind": "x", "group": "a", "timestamp": "2024-01-01T00:00:00Z"}']
    got = readers.parse_packets(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r.reject_reason for r in got] == [None, "not_finite", "not_json", "unknown_kind"]


def test_archive_round_trip(spark, tmp_path):
    d = spark.sql("select 'a' as station_id, timestamp'2024-01-31 23:59:00' + make_interval(0, 0, 0, 0, 0, id) as ts, id from range(3)")
    readers.write_archive(d, str(tmp_path / "x"))
    back = spark.read.parquet(str(tmp_path / "x"))
    assert readers.frames_equal(d, back.drop("month"))
    assert readers.archive_window(back, "2024-02-01", "2024-02-01 00:01:00").count() == 1


def test_gpd_and_pot(spark):
    rng = np.random.default_rng(0)
    shape, scale = models.gpd_fit(rng.pareto(5, 4000) * 5 * 0.2)
    assert abs(shape - 0.2) < 0.08 and abs(scale - 0.2) < 0.05
    x = rng.exponential(size=20_000)
    rows = [("tail", float(v)) for v in x] + [("same", 1.0)] * 2000 + [("few", float(i)) for i in range(100)]
    got = {r.k: r for r in models.pot_by_group(spark.createDataFrame(rows, "k string, s double"), "k", "s").collect()}
    assert abs(got["tail"].threshold - math.log(1000)) < 0.8 and got["tail"].exceedances == 400
    assert got["same"].threshold == math.nextafter(1.0, 2.0) and got["few"].threshold == np.quantile(np.arange(100.0), 0.995)
    whole = models.gpd_fit(np.sort(x)[np.sort(x) > np.quantile(x, 0.98)] - np.quantile(x, 0.98))
    want = np.quantile(x, 0.98) + whole[1] / whole[0] * ((20_000 * 1e-3 / 400) ** -whole[0] - 1)
    assert abs(got["tail"].threshold - want) < 1e-6  # summed in slices, as of the whole tail


def test_isolation_forest_finds_outlier():
    x = np.r_[np.random.default_rng(0).normal(size=(500, 2)), [[9.0, 9.0]]]
    assert models.IsolationForest(trees=50).fit(x).score(x).argmax() == 500


def test_dew_point_inverts(spark):
    r = spark.range(1).select(physics.humidity_from_dew_point(F.lit(20.0), physics.dew_point(F.lit(20.0), F.lit(55.0))).alias("rh")).first()
    assert abs(r.rh - 55.0) < 1e-9


def test_flagship_plan_has_one_exchange_before_thresholds(spark):
    from isobar.plans import catalogue

    d = detect.compute_signals(spark.createDataFrame([], "g string, us long, v double"), catalogue.SPEC)
    assert d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_capped_threshold_searches_between_grid_values_and_can_stay_silent(spark):
    d = spark.createDataFrame([(float(i), int(i >= 770)) for i in range(1000)], "score double, y int")
    best = evaluate.background_capped_threshold(d).first()
    assert 763 < best.threshold <= 770 and best.f1 > 0.98
    assert evaluate.background_capped_threshold(d, [100.0, 960.0]).first().threshold == 949.05  # a quantile
    high = d.withColumn("y", (F.col("score") < 500).cast("int"))
    silent = evaluate.background_capped_threshold(high, [0.0, 600.0], quantiles=()).first()
    assert silent.threshold == float("inf") and silent.f1 == 0.0
