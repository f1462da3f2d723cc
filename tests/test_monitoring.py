"""Acceptance behaviour of the monitoring engine and its streaming form."""

import json
import pickle
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import exprs as ex
from tidewatch.functions import kernels
from tidewatch.operators import alerts, detect, folds, history, ingest, models, routing
from tidewatch.plans import prediction
from tidewatch.plans.online import Monitor
from tidewatch.plans.prediction import Bounds, State, judge, predict_minute, predict_second
from tidewatch.plans.replay import replay
from tidewatch.schemas import POINT
from tidewatch.settings import DEFAULTS, Settings
from tidewatch.sources import points as src
from tidewatch.streaming import monitor

T = 1711180800


def points_of(spark, rows):
    """rows: (metric, ts, value, line, priority, type, tags)."""
    full = [(m, t, float(v), line, tags, p, k, "1s", True, False) for m, t, v, line, p, k, tags in rows]
    return spark.createDataFrame(full, POINT).withColumn("ingest_seq", F.monotonically_increasing_id())


@pytest.fixture(scope="module")
def replayed(spark):
    return replay(src.demo_points(spark), src.demo_registry(spark))


@pytest.fixture(scope="module")
def demo(replayed):
    return replayed.alerts.toPandas()


def test_demo_fires_and_recovers(demo):
    rate, count = demo[demo.metric_name == "payment.success_rate"], demo[demo.metric_name == "payment.long_tail_count"]
    fired = rate[(rate.status == "firing") & (rate.alert_level == "P0")]
    assert len(fired) and T + 720 <= fired.timestamp.min() <= T + 780
    assert (rate.status == "recovered").any() and (count.alert_type == "zero_rule").any()


def test_constant_series_is_quiet(spark):
    rows = points_of(spark, [("payment.success_rate", T + i, 0.962, "AA", "P0", "rate", {"force_ai": "true"}) for i in range(300)])
    assert replay(rows, src.demo_registry(spark)).alerts.count() == 0


def test_large_gap_is_not_trusted_and_small_gap_of_counts_is_zero(spark):
    far = ingest.fill_gaps(points_of(spark, [("a", T, 1, "AA", "P0", "rate", {}), ("a", T + 10, 2, "AA", "P0", "rate", {})])).orderBy("timestamp").collect()
    assert len(far) == 2 and not far[1].trusted and far[1].tags["missing_gap"] == "9"
    near = ingest.fill_gaps(points_of(spark, [("c", T, 8, "AA", "P0", "count", {}), ("c", T + 3, 14, "AA", "P0", "count", {})])).orderBy("timestamp").collect()
    assert [r.value for r in near] == [8.0, 0.0, 0.0, 14.0] and [r.is_interpolated for r in near] == [False, True, True, False]


def test_exact_clip_equals_a_loop(spark):
    rng = np.random.default_rng(3)
    v = rng.exponential(5, 200)
    v[::17] *= 60
    v[5::40] *= -1
    tail, want = [], []
    for x in v:
        new = x
        if len(tail) >= 20:
            new = min(max(x, 0.0), 10 * max(np.quantile(np.abs(tail[-600:]), 0.99), 1e-6))
        tail.append(new)
        want.append(new)
    got = ingest.clip_jumps(points_of(spark, [("a", T + i, x, "AA", "P0", "gauge", {}) for i, x in enumerate(v)])).orderBy("timestamp").toPandas().value
    assert np.allclose(got, want)


def test_last_duplicate_wins_and_strict_validation_fails(spark):
    rows = points_of(spark, [("a", T, 1, "AA", "P0", "rate", {}), ("a", T, 2, "AA", "P0", "rate", {})]).withColumn("ingest_seq", F.col("value").cast("long"))
    assert [r.value for r in ingest.deduplicate(rows).collect()] == [2.0]
    bad = points_of(spark, [("a", 0, 1, "AA", "P0", "rate", {})])
    with pytest.raises(Exception, match="invalid metric point"):
        ingest.validate(bad).collect()
    good, rejected = ingest.split_valid(bad)
    assert good.count() == 0 and rejected.count() == 1


def test_empty_input(spark):
    none = spark.createDataFrame([], POINT).withColumn("ingest_seq", F.lit(0).cast("long"))
    assert replay(none, src.demo_registry(spark)).alerts.count() == 0


def test_first_point_describes_an_unknown_metric(spark):
    rows = points_of(spark, [("a", T, 1, "AA", "P0", "rate", {"core_link": "false"}), ("a", T + 1, 1, "BB", "P3", "count", {"core_link": "true"})])
    (r,) = ingest.register(rows).collect()
    assert (r.business_line, r.priority, r.metric_type, r.core_link, r.force_ai) == ("AA", "P0", "rate", False, False)


def test_eligibility_is_throttled(spark):
    rows = points_of(spark, [("a", T + i, 0.9, "AA", "P1", "rate", {}) for i in range(30)])
    assert routing.eligibility_times(rows, ingest.register(rows)).count() == 1


def test_a_fold_after_a_join_by_its_key_deals_out_its_rows_itself(spark):
    """Else adaptive execution, which makes that join a broadcast, may read its rows where they lie: a metric's in several tasks."""
    rows = points_of(spark, [("a", T + i, 0.9, "AA", "P1", "rate", {}) for i in range(30)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a large table
    try:
        told = routing.eligibility_times(rows, ingest.register(rows))
        assert "REPARTITION_BY_COL" in told._jdf.queryExecution().executedPlan().toString()
        assert told.count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_kernels():
    x = np.arange(40.0) * 0.5 + 3
    x[10] = 500
    design, ridge, w, line = np.c_[np.ones(40), np.arange(1, 41)], 1e-4 * np.eye(2), np.ones(40), None
    for _ in range(51):  # the same equations by a general solver
        found = np.linalg.solve((design.T * w) @ design + ridge, design.T @ (w * x))
        if line is not None and np.allclose(found, line, atol=1e-6, rtol=1e-5):
            break
        line = found
        off = x - design @ line
        limit = 1.35 * max(1.4826 * np.median(np.abs(off - np.median(off))), off.std(), 1e-6)
        w = np.where(np.abs(off) > limit, limit / np.abs(off), 1.0)
    forecast, spread, intercept, slope = kernels.huber_forecast(x)
    assert np.allclose([intercept, slope, forecast], [*found, found @ [1, 41]], rtol=1e-4) and spread > 0
    assert kernels.huber_forecast([]) == (0.0, 0.0, 0.0, 0.0) and kernels.huber_forecast([4.0])[0] == 4.0
    assert kernels.kde_bounds([]) == (-3.0, 3.0)
    low, high = kernels.kde_bounds(np.random.default_rng(1).normal(size=2000))
    assert abs(low + 1.96) < 0.3 and abs(high - 1.96) < 0.3
    assert kernels.mann_kendall(range(10))[0] and kernels.mann_kendall([1, 2, 3]) == (False, 1.0)


def test_joint_lines_equal_a_plain_descent():
    rng = np.random.default_rng(8)
    n, x = 40, (np.arange(1.0, 41) - 20.5) / np.arange(1.0, 41).std()
    y = rng.normal(size=(100, n)) * rng.uniform(0.1, 3, (100, 1)) + rng.normal(size=(100, 1)) * 5 + rng.normal(size=(100, 1)) * x
    y[rng.random(y.shape) < 0.1] += 30
    got = kernels.joint_lines(y)

    def loss(b):  # of intercept, slope and the logarithm of the scale
        s, r = np.exp(b[:, 2:]), np.abs(y - b[:, :1] - b[:, 1:2] * x)
        return (s + np.where(r < 1.35 * s, r * r / s, 2 * 1.35 * r - 1.35**2 * s)).sum(axis=1) + 1e-4 * b[:, 1] ** 2

    b = np.c_[np.median(y, axis=1), np.zeros(100), np.zeros(100)]
    step, best = np.full((100, 3), 1.0), loss(b)
    while step.max() > 1e-9:  # a pattern search, coordinate by coordinate
        better = np.zeros((100, 3), bool)
        for k in range(3):
            for way in (1, -1):
                tried = b.copy()
                tried[:, k] += way * step[:, k]
                found = loss(tried)
                low = found < best
                b[low], best[low], better[low, k] = tried[low], found[low], True
        step = np.where(better, step * 1.3, step * 0.6)
    assert np.allclose(got[:, 2:], b[:, :2], atol=1e-4) and np.allclose(got[:, 0], b[:, 0] + b[:, 1] * (41 - 20.5) / np.arange(1.0, 41).std(), atol=1e-4)
    assert kernels.huber_forecast([1.0, 2.0, 3.0, 4.0], joint=True)[0] == pytest.approx(5, abs=1e-3)
    p, _, _ = predict_minute(State(), 3.0, [(float(v), 0.0, False) for v in range(10)], Settings(line_rule="joint"))
    assert p == pytest.approx(10, abs=1e-2)


def test_density_by_covariance_is_a_choice():
    z = np.random.default_rng(4).normal(size=500)
    plain, other = kernels.kde_bounds(z), kernels.kde_bounds(z, by_covariance=True)
    assert plain != other and np.allclose(plain, other, atol=0.2) and kernels.kde_bounds([2.0] * 30, by_covariance=True) == kernels.kde_bounds([2.0] * 30)
    s = State()
    s.bounds["peak"] = Bounds(list(z))
    judge(s, T, 0.95, 0.95, 0.94, 0.90, "1s", Settings(density_rule="covariance"))
    assert s.bounds["peak"].now == other


@pytest.mark.parametrize("repeats", [4, 6])
def test_periods_equal_a_loop(spark, repeats):
    rng, s = np.random.default_rng(repeats), Settings(periodic_week_lookback=repeats, minute_history_window=150)
    n = 400
    values = np.cumsum(rng.normal(size=n)) * 3 + np.arange(n) * 0.3
    flags = (np.arange(n) % 12 == 0) & (rng.random(n) < 0.55) | (rng.random(n) < 0.1)

    def looked(i):
        v, f = values[max(i - 150, 0) : i + 1].tolist(), flags[max(i - 150, 0) : i + 1].tolist()
        at = len(v) - 1
        for p in (12, 288):
            if len(v) < 10 or p > len(v) // (repeats + 1):
                continue
            hits, apart, wide = [], [], max(1, min(10, p // 10))
            for k in range(1, repeats + 1):
                if at - k * p > 0:
                    a, b = max(0, at - k * p - wide), min(at - 1, at - k * p + wide) + 1
                    hits.append(any(f[a:b]))
                    apart.append((v[at] - np.mean(v[a:b])) / max(np.std(v[a:b]), 1.0))
            if len(hits) >= 3:
                if np.mean(hits) >= 0.6:
                    return True
                if kernels.mann_kendall(apart)[0]:
                    return False
        return False

    want = [bool(flags[i]) and looked(i) for i in range(n)]
    df = spark.createDataFrame([("a", "5m", T + 300 * i, float(values[i]), bool(flags[i])) for i in range(n)], "metric_name string, granularity string, timestamp long, value double, flag boolean")
    assert [r.is_periodic for r in detect.periodic(df, s).orderBy("timestamp").collect()] == want and any(want)
    assert [bool(flags[i]) and detect.is_periodic(values[:i].tolist(), flags[:i].tolist(), values[i], "5m", s) for i in range(n)] == want


@pytest.mark.parametrize("width", [0.1, 0.4, 1.5])
def test_density_equals_the_sum_over_all_pairs(width):
    x = np.random.default_rng(2).standard_t(3, 3000)
    grid = np.linspace(x.min() - 3 * width, x.max() + 3 * width, 512)
    want = np.exp(-0.5 * ((grid[None] - x[:, None]) / width) ** 2).sum(axis=0)
    assert np.allclose(kernels._density(x, grid, width), want, rtol=1e-10, atol=1e-9)


def test_minutes_that_were_abnormal_count_as_predicted():
    tail = [(1.0, 1.0, False)] * 2 + [(5.0, 40.0, True)]
    assert predict_minute(State(), 3.0, tail)[0] == pytest.approx((1 + 1 + 40) / 3)


def test_second_prediction_moves_its_correction():
    s = State()
    p, low, high = predict_second(s, 1.2, 1.0, 0.0, 1.0)
    assert (p, low, high) == (1.0, 0.98, 1.02) and s.correction == pytest.approx(1.02) and s.second_sd == pytest.approx(0.029)


def test_bounds_are_learned_once_for_few_points():
    s = State()
    for i in range(10):
        judge(s, T + i, 0.95, 0.95, 0.94, 0.90, "1s", DEFAULTS)
    b: Bounds = s.bounds["peak"]
    assert b.now == (-3.0, 3.0) and b.dirty == 10 and len(b.z) == 10


def test_incident_states():
    i = alerts.Incident()
    assert alerts.advance(i, T, "P1", True) == ("firing", "P1", 0)
    assert alerts.advance(i, T + 10, "P1", True) is None
    assert alerts.advance(i, T + 300, "P1", True) == ("firing", "P1", 300)
    assert alerts.advance(i, T + 600, "P1", True) == ("escalated", "P0", 600)
    assert [alerts.advance(i, T + 700 + k, None, True) for k in range(3)] == [None, None, ("recovered", "P0", 702)]
    assert i == alerts.Incident()


def test_numbers_in_texts_round_as_doubles(spark):
    values = [18.0175, 30.5875, 140.3875, 0.0625, 0.1875, 2.5, -0.0004, -18.0175, 1234567.00049, 0.0]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(ex.fixed(F.col("v"), 3).alias("t")).collect()
    assert [r.t for r in got] == ["%.3f" % v for v in values]
    row = spark.createDataFrame([("AA", "m", 88.07, 16.0, 18.0175, 0.6125, 5)], "b string, m string, v double, p double, z double, c double, d long")
    text = row.select(ex.alert_message(*map(F.col, "bmvpzcd")).alias("t")).first().t
    assert text == "AA m abnormal: current=88.0700, predict=16.0000, z=18.017, confidence=%.3f, duration=5s" % 0.6125
    line = alerts.console_lines(row.selectExpr("'P0' alert_level", "m metric_name", "'firing' status", "v current_value", "p predict_value", "c confidence_score", "z z_score")).first().line
    assert line == "[P0] m firing value=88.0700 predict=16.0000 confidence=%.3f z=18.017" % 0.6125


def test_jsonl_and_registry(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text("\n".join([json.dumps({"metric_name": "a", "timestamp": T, "value": 1.5, "business_line": "AA"}), "", json.dumps({"metric_name": "b", "timestamp": T, "value": 2, "business_line": "BB", "tags": {"k": True}})]))
    rows = src.read_jsonl(spark, str(tmp_path / "p.jsonl")).orderBy("metric_name").collect()
    assert [(r.metric_name, r.priority, r.metric_type, r.trusted) for r in rows] == [("a", "P1", "gauge", True), ("b", "P1", "gauge", True)]
    (tmp_path / "bad.jsonl").write_text("{oops\n")
    with pytest.raises(Exception):
        src.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()
    good, rejected = src.read_jsonl_lenient(spark, str(tmp_path / "*.jsonl"))
    assert good.count() == 2 and rejected.count() == 1
    (tmp_path / "r.json").write_text(json.dumps([{"metric_name": "a"}]))
    (r,) = src.read_registry(spark, str(tmp_path / "r.json")).collect()
    assert (r.business_line, r.priority, r.metric_type, r.core_link, r.force_ai) == ("default", "P1", "gauge", True, False)


def test_history_store(spark, tmp_path):
    store = history.HistoryStore(spark, str(tmp_path / "h"))
    rows = lambda *tv: spark.createDataFrame([("a", "1s", t, float(v)) for t, v in tv], "metric_name string, granularity string, timestamp long, value double")
    store.append("series_points", rows((T, 1), (T + 500, 2)), 0)
    store.append("series_points", rows((T, 3)), 1)
    store.append("series_points", rows((T, 3)), 1)  # a retried batch
    assert [r.value for r in store.recent("series_points", "a", limit=5).collect()] == [3.0, 2.0]
    assert store.rewrite("series_points", lambda d: history.prune(d, T + 1), 2) == 1
    assert [r.timestamp for r in store.recent("series_points", "a").collect()] == [T + 500]


def test_questions_open_few_folders_and_retention_writes_nothing(spark, tmp_path):
    store = history.HistoryStore(spark, str(tmp_path / "h"))
    day = 86400
    rows = lambda m, *ts: spark.createDataFrame([(m, "1s", t, 1.0) for t in ts], "metric_name string, granularity string, timestamp long, value double")
    for batch, m in enumerate("abcdefgh"):
        store.append("series_points", rows(m, *(T + day * k for k in range(4)), T + 3 * day + 500), batch)
    asked = store.recent("series_points", "a", since=T + 2 * day)
    assert [r.timestamp for r in asked.collect()] == [T + 2 * day, T + 3 * day, T + 3 * day + 500]
    plan = asked._jdf.queryExecution().executedPlan().toString()
    filters = next(x for x in plan.splitlines() if "PartitionFilters" in x).split("PartitionFilters: [")[1].split("]")[0]
    assert "metric_bucket" in filters and "date" in filters and "metric_bucket#" in filters
    files = lambda: {str(p.relative_to(tmp_path)) for p in (tmp_path / "h").rglob("*.parquet")}
    before = files()
    assert store.retain(T + 3 * day + 100, 7) == 8 * 4
    after = files()
    assert after < before and len(after) == len([f for f in before if "date=2024-03-26" in f])
    assert [(r.metric_name, r.timestamp) for r in store.read("series_points").orderBy("metric_name").collect()] == [(m, T + 3 * day + 500) for m in "abcdefgh"]
    assert store.retain(T + 3 * day + 100, 7) == 0 and store.newest("series_points") == T + 3 * day + 500
    store.append("series_points", rows("a", T + 3 * day + 50, T + 3 * day + 600), 8)  # an old point that comes after doesn't count
    assert [r.timestamp for r in store.recent("series_points", "a", limit=9).collect()] == [T + 3 * day + 500, T + 3 * day + 600]


def test_model_versions(spark):
    p = spark.createDataFrame([("a", {"x": 1.0})], "metric_name string, params map<string,double>")
    q = spark.createDataFrame([("a", {"x": 2.0})], "metric_name string, params map<string,double>")
    versions = models.publish(p, "m", 10).unionByName(models.publish(q, "m", 20))
    assert models.active(versions).first().version == "m_20"
    assert models.active(models.rollback(versions, "m_10", 30)).first().params == {"x": 1.0}


def test_stream_buckets_and_zero_rule(spark, tmp_path):
    inp = tmp_path / "in"
    inp.mkdir()
    for n in range(3):
        rows = [{"metric_name": "c", "timestamp": T + n * 600 + i, "value": 10.0 if n < 2 else 0.0, "business_line": "AA", "priority": "P2", "metric_type": "count"} for i in range(600)]
        (inp / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))
    (inp / "9.json").write_text(json.dumps({"metric_name": "z", "timestamp": T + 9000, "value": 1, "business_line": "AA"}))
    store = history.HistoryStore(spark, str(tmp_path / "h"))
    buckets = monitor.stream_buckets(monitor.read_points(spark, str(inp), 1), 600)
    query = monitor.ZeroRuleMonitor(store, Settings()).start(buckets, str(tmp_path / "ck"))
    query.awaitTermination(120)
    assert query.exception() is None
    got = store.recent("anomalies", "c").collect()
    assert [(r.value, r.global_abnormal) for r in got] == [(6000.0, False), (6000.0, False), (0.0, True)]


def test_stream_incidents_equal_the_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = pd.DataFrame({"metric_name": np.repeat(["a", "b"], 200), "timestamp": np.tile(T + 60 * np.arange(200), 2), "level": rng.choice(["P0", "P1", "P2", None], 400, p=[0.1, 0.2, 0.1, 0.6]), "core_link": True})
    static = spark.createDataFrame(rows, "metric_name string, timestamp long, level string, core_link boolean")
    static.repartitionByRange(4, "timestamp").sortWithinPartitions("timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(static.schema).parquet(str(tmp_path / "in")).withColumn("event_time", F.timestamp_seconds("timestamp"))
    query = monitor.stream_incidents(stream).writeStream.format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    want = alerts.incidents(static.withColumns({"granularity": F.lit("1m"), "ingest_seq": F.lit(0)}))
    cols = ["metric_name", "timestamp", "status", "alert_level", "duration_sec"]
    assert {tuple(r) for r in spark.table("told").select(cols).collect()} == {tuple(r) for r in want.select(cols).collect()}


TOLD = ["metric_name", "timestamp", "granularity", "alert_level", "alert_type", "duration_sec", "message", "status"]


def told(alerts_):
    return sorted(tuple(r) for r in alerts_.select(TOLD).collect())


def test_batches_go_on_where_the_last_one_ended(spark, tmp_path, demo, replayed):
    """Two processes after one another, the second of which is run again, tell what one replay tells, and fill all tables."""
    points, got = src.demo_points(spark), []
    cuts = [0, T + 750, T + 10_000]
    for n in (0, 1, 1):
        part = points.where(F.col("timestamp").between(cuts[n], cuts[n + 1] - 1))
        monitor_ = Monitor(history.HistoryStore(spark, str(tmp_path / "h")), src.demo_registry(spark), cleanup_every=1)
        got.append(told(monitor_.process(part, n, flush=n == 1)))
    assert got[1] == got[2]
    got = got[0] + got[1]
    assert sorted(got) == sorted(tuple(r) for r in demo[TOLD].itertuples(index=False))
    store = history.HistoryStore(spark, str(tmp_path / "h"))
    whole = replayed
    assert store.read("raw_points").count() == points.count()
    key = ["metric_name", "granularity", "timestamp"]
    stored = {tuple(r[c] for c in key): (round(r.predict_value, 6), r.model_version) for r in store.read("predictions").collect()}
    assert stored == {tuple(r[c] for c in key): (round(r.predict_value, 6), r.model_version) for r in whole.judged.collect()}
    feature = store.read("predictions").where("granularity = '1s'").select("features.*").first().asDict()
    assert len(feature) == 11 and feature["business_unit"] == "AA" and feature["day_of_week"] == 5
    assert store.read("anomalies").count() == whole.judged.count() == store.read("series_points").count()


def test_idle_metrics_are_forgotten_and_old_points_dropped(spark, tmp_path):
    store = history.HistoryStore(spark, str(tmp_path / "h"))
    own = Monitor(store, settings=Settings(state_ttl_sec=50, data_retention_sec=80))
    at = lambda m, t: points_of(spark, [(m, t, 0.9, "AA", "P1", "rate", {"force_ai": "true"})])
    own.process(at("a", T), 0)
    own.process(at("b", T + 100), 1)
    assert {r.metric_name for r in store.read("states").collect()} == {"a", "b"}
    own.clean_up(1)
    assert {r.metric_name for r in store.read("states").collect()} == {"b"}
    assert [r.metric_name for r in store.read("raw_points").collect()] == ["b"]
    own.process(at("b", T + 101), 2)
    assert store.read("raw_points").count() == 2 and store.next_batch() == 3


def test_flush_closes_buckets_of_metrics_without_new_points(spark, tmp_path):
    store = history.HistoryStore(spark, str(tmp_path / "h"))
    own = Monitor(store)
    rows = lambda m, n: points_of(spark, [(m, T + i, 1.0, "AA", "P0", "count", {"core_link": "true"}) for i in range(n)])
    own.process(rows("a", 90), 0)
    own.process(rows("b", 5), 1)
    assert [(r.metric_name, r.value) for r in store.read("series_points").collect()] == [("a", 60.0)]
    own.process(rows("a", 1).limit(0), 2, flush=True)
    assert sorted((r.metric_name, r.value) for r in store.read("series_points").collect()) == [("a", 30.0), ("a", 60.0), ("b", 5.0)]
    assert own.process(rows("c", 1), 3, flush=True).count() == 0 and store.read("series_points").count() == 4


def test_stored_points_count_for_eligibility(spark, tmp_path):
    store = history.HistoryStore(spark, str(tmp_path / "h"))
    own = Monitor(store, settings=Settings(history_weeks_required=0))
    rows = lambda *tv: points_of(spark, [("a", t, v, "AA", "P1", "rate", {}) for t, v in tv])
    own.process(rows((T - 100, 0.91), (T - 50, 0.92)), 0)
    for name in ("states", "assessments"):
        store.rewrite(name, lambda d: d.limit(0), 0)
    own.process(rows((T, 0.93)), 1)
    (state,) = store.read("states").where("kind = 'eligibility'").collect()
    assert list(pickle.loads(state.state)["v"]) == [0.91, 0.92, 0.93]
    want = routing.assess(rows((T - 100, 0.91), (T - 50, 0.92), (T, 0.93)), ingest.register(rows((T, 0.93))), own.settings).first()
    assert [(r.since, r.eligible) for r in store.read("assessments").collect()] == [(T, want.eligible)]


def test_stream_of_points_equals_the_batch(spark, tmp_path, demo):
    """All modes as micro-batches; the last buckets stay open in a stream, so alerts of the time before them are compared."""
    inp, got = tmp_path / "in", []
    inp.mkdir()
    for n in range(2):
        part = src.demo_points(spark).where(F.col("timestamp").between(T + 900 * n, T + 900 * n + 899))
        (inp / f"{n}.json").write_text("\n".join(r.line for r in part.orderBy("ingest_seq").select(F.to_json(F.struct(*POINT.names)).alias("line")).collect()))
        time.sleep(1.1)
    own = Monitor(history.HistoryStore(spark, str(tmp_path / "h")), src.demo_registry(spark))
    query = own.start(monitor.read_points(spark, str(inp), 1), str(tmp_path / "ck"), lambda alerts_, n: got.extend(told(alerts_)))
    query.awaitTermination(300)
    assert query.exception() is None
    want = [tuple(r) for r in demo[TOLD].itertuples(index=False)]
    assert [a for a in sorted(got) if a[0].endswith("rate")] == [a for a in sorted(want) if a[0].endswith("rate")]
    assert set(got) <= set(want)


def test_states_expire_with_event_time(spark, tmp_path):
    """A timer that passes drops the incident of an idle metric: its next alert opens a new one."""
    rows = [("a", T, "P1"), ("b", T + 10_000, "P1"), ("b", T + 20_000, None), ("a", T + 30_000, "P1")]
    (tmp_path / "in").mkdir()
    for n, (m, t, level) in enumerate(rows):
        (tmp_path / "in" / f"{n}.json").write_text(json.dumps({"metric_name": m, "timestamp": t, "level": level, "core_link": True}))
        time.sleep(1.1)
    stream = spark.readStream.schema("metric_name string, timestamp long, level string, core_link boolean").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).withColumn("event_time", F.timestamp_seconds("timestamp"))
    query = monitor.stream_incidents(stream, Settings(state_ttl_sec=1000)).writeStream.format("memory").queryName("expired").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    assert {(r.metric_name, r.timestamp, r.status, r.duration_sec) for r in spark.table("expired").collect()} >= {("a", T, "firing", 0), ("a", T + 30_000, "firing", 0)}


def test_registry_is_read_named_and_cleared(spark):
    reg = ingest.register(points_of(spark, [("a", T, 1, "AA", "P0", "rate", {}), ("b", T, 1, "BB", "P3", "count", {})]))
    assert sorted(r.metric_name for r in ingest.registry_names(reg).collect()) == ["a", "b"]
    assert ingest.registry_entry(reg, "b").first().priority == "P3" and ingest.registry_entry(reg, "c").first() is None
    known = spark.createDataFrame([("a", T, True), ("b", T, False)], "metric_name string, since long, eligible boolean")
    assert [r.metric_name for r in ingest.clear_eligibility(known, "a").collect()] == ["b"] and ingest.clear_eligibility(known).count() == 0


@pytest.mark.parametrize("size", (7, 12, 1000))
def test_moving_windows_in_pieces_equal_a_loop(spark, size):
    rng = np.random.default_rng(5)
    rows = [(m, t, float(v)) for m, n in (("a", 61), ("b", 1), ("c", 24)) for t, v in enumerate(rng.normal(size=n))]
    df = spark.createDataFrame(rows, "m string, t long, v double").repartition(5)

    def compute(cols, first):
        return {"s": np.array([cols["v"][max(i - 5, 0) : i].sum() for i in range(first, len(cols["v"]))])}

    got = {(r.m, r.t): r.s for r in folds.moving(df, ["m"], ["t"], 5, ["v"], compute, "s double", size).collect()}
    assert len(got) == len(rows)
    for m in "abc":
        v = [x for n, _, x in rows if n == m]
        assert all(abs(got[m, t] - sum(v[max(t - 5, 0) : t])) < 1e-12 for t in range(len(v)))


def test_confidence_and_clipping_share_out_one_long_series(spark, monkeypatch):
    monkeypatch.setattr(folds.moving, "__defaults__", (400,))
    rng = np.random.default_rng(6)
    value, told = rng.exponential(50, 1500), rng.exponential(50, 1500)
    rows = [("a", "1s", t, t, float(v), float(p), 0.5, False, {}) for t, (v, p) in enumerate(zip(value, told, strict=True))]
    df = spark.createDataFrame(rows, "metric_name string, granularity string, timestamp long, ingest_seq long, value double, predict_value double, severity double, is_periodic boolean, tags map<string,string>")
    for made in (detect.confidence(df), ingest.clip_jumps_given_history(df), detect.local_detectors(df)):  # each was one task's work, with a frame looked through for every row
        assert made.select("timestamp", F.spark_partition_id().alias("n")).count() == 1500
        assert "_piece" in made._jdf.queryExecution().optimizedPlan().toString()
    parts = {r.timestamp: r.confidence_components for r in detect.confidence(df).collect()}
    limits = {r.timestamp: r.value for r in ingest.clip_jumps_given_history(df.withColumn("value", F.when(F.col("timestamp") % 50 == 49, 1e6).otherwise(F.col("value")))).collect()}
    jumps = np.where(np.arange(1500) % 50 == 49, 1e6, value)
    for t in (0, 1, 298, 299, 300, 399, 400, 699, 800, 1499):
        x, p = value[max(t - 299, 0) : t + 1], told[max(t - 299, 0) : t + 1]
        cv = x.std() / np.abs(x).mean() if len(x) > 1 else 0.0
        assert abs(parts[t].metric_reliability - min(max(1 - np.abs(x - p).mean() / max(np.abs(x).mean(), 1), 0), 1)) < 1e-12
        assert abs(parts[t].volatility_level - min(max(1 - min(cv, 1), 0), 1)) < 1e-12
        if t >= 20:
            most = 10 * max(np.quantile(np.abs(jumps[max(t - 600, 0) : t]), 0.99), 1e-6)
            assert abs(limits[t] - min(jumps[t], most)) < 1e-6


def test_aligned_history_equals_a_loop_in_one_exchange_of_points(spark):
    rng = np.random.default_rng(7)
    cal = lambda t: (t // 40 % 2, t // 20 % 2, t // 5 % 4, t % 5, False)
    slots = "weekday int, hour int, minute int, second int, isHoliday boolean"
    known = [("m", int(t), float(v), *map(int, cal(t)[:4]), False) for t, v in enumerate(rng.normal(size=400)) if t % 3]
    asks = [("m", int(t), *map(int, cal(t)[:4]), False) for t in (*range(0, 500, 7), 2000)] + [("other", 5, 0, 0, 0, 0, False)]
    raw, asked = spark.createDataFrame(known, f"metric_name string, timestamp long, value double, {slots}"), spark.createDataFrame(asks, f"metric_name string, timestamp long, {slots}")
    found = history.aligned_history(raw, asked, 3, 6)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan  # each question met each of its values in a row of its own
    got = {(r.metric_name, r.timestamp): r.aligned_values for r in found.collect()}
    assert len(got) == len(asks)
    for m, t, *slot in asks:
        own = [r[2] for r in known if r[0] == m and r[1] < t and list(r[3:]) == slot][-3:]
        same = [r[2] for r in known if r[0] == m and r[1] < t and r[6] == slot[3]][-6:]
        assert got[m, t] == (own or same)[::-1]


def test_minutes_fitted_ahead_equal_those_fitted_one_by_one(monkeypatch):
    rng, calls = np.random.default_rng(8), []
    rows = pd.DataFrame({"granularity": "1m", "timestamp": T + 60 * np.arange(2500), "value": rng.normal(50, 1, 2500), "mode": "minute_ai", "base_value": 0.0, "factor": 1.0, "local_score": (rng.random(2500) < 0.08) * 0.25})
    rows.loc[1400:1405, "value"] = 5000.0
    found = []
    monkeypatch.setattr(prediction, "huber_lines", lambda y, **k: calls.append(len(y)) or kernels.huber_lines(y, **k))
    for ahead in (True, False):
        state = State()
        known = rows.assign(**prediction.with_rolling(state, rows, DEFAULTS))
        state.ahead = state.ahead if ahead else {}
        found.append([prediction.predict_row(state, r, DEFAULTS) for r in known.itertuples(index=False)])
    for one, other in zip(*found, strict=True):
        assert all(abs(a - b) < 1e-6 * max(1, abs(b)) if isinstance(b, float) else a == b for a, b in zip(one, other, strict=True))
    assert any(r[-1] for r in found[0])
    assert 0 < len(calls) < 1600, len(calls)  # 1,310, where each of 2,495 minutes was a fit of its own
