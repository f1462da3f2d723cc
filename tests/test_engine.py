"""The streaming engine against the batch replay, and what keyed states do over time."""

import json
import time

from pyspark.sql import functions as F

from tidewatch.functions.exprs import route_seconds
from tidewatch.operators import ingest, routing
from tidewatch.operators.downsample import downsample
from tidewatch.operators.history import HistoryStore
from tidewatch.plans.replay import replay
from tidewatch.schemas import POINT, REGISTRY
from tidewatch.settings import Settings
from tidewatch.sources import points as src
from tidewatch.streaming import engine as eng
from tidewatch.streaming.monitor import SHARES, read_points, stream_buckets

T = 1711180800
TOLD = ["metric_name", "timestamp", "granularity", "alert_level", "alert_type", "duration_sec", "message", "status"]


def points_of(spark, rows):
    """rows: (metric, ts, value, line, priority, type, tags)."""
    full = [(m, t, float(v), line, tags, p, k, "1s", True, False) for m, t, v, line, p, k, tags in rows]
    return spark.createDataFrame(full, POINT).withColumn("ingest_seq", F.monotonically_increasing_id())


def lines_of(points):
    return [r.line for r in points.orderBy("ingest_seq").select(F.to_json(F.struct(*POINT.names)).alias("line")).collect()]


def run(spark, folder, batches, registry, out, settings=None, primed=None, name="alerts", checkpoint=None):
    """Write each batch as a file, run the query over all of them, and return the rows of its last stage."""
    inp = folder / f"in_{out}"
    inp.mkdir(exist_ok=True)
    for n, lines in enumerate(batches):
        (inp / f"{time.time_ns()}.json").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
        time.sleep(1.05)
    own = eng.Engine(registry, *src.empty_calendar(spark), **({"settings": settings} if settings else {}), primed=primed)
    points = read_points(spark, str(inp), 1)
    df = own.alerts(points) if name == "alerts" else own.judged(own.series(own.repaired(points))).drop("past")
    query = df.writeStream.format("memory").queryName(out).option("checkpointLocation", str(checkpoint or folder / f"ck_{out}")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return spark.table(out), query


def flush(metric, t):
    return {"metric_name": metric, "timestamp": t, "command": "flush"}


def test_stream_tells_what_the_replay_tells_with_no_bucket_left_out(spark, tmp_path):
    points, registry = src.demo_points(spark), src.demo_registry(spark)
    batches = [lines_of(points.where(F.col("timestamp").between(T + a, T + b - 1))) for a, b in ((0, 740), (740, 1205), (1205, 1800))]
    ends = [flush(m, T + 1800) for m in ("payment.success_rate", "payment.long_tail_count")]
    got, query = run(spark, tmp_path, [*batches, ends], registry, "told")
    want = replay(points, registry).alerts
    cols = ["metric_name", "timestamp", "granularity", "alert_level", "alert_type", "duration_sec", "message", "status"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"]) == 0


def point(metric, t, value=1.0, **more):
    return {"metric_name": metric, "timestamp": t, "value": value, "business_line": "AA", "priority": "P0", "metric_type": "count", **more}


def names_in(spark, checkpoint, kind, batch):
    return {name: {r.metric_name for r in df.collect()} for name, df in eng.states_of(spark, str(checkpoint), kind, batch).items()}


def test_timers_run_are_set_anew_and_clear_all_states(spark, tmp_path):
    s = Settings(state_ttl_sec=1000)
    forced = {"tags": {"force_ai": "true"}}
    batches = [
        [point("a", T + i, **forced) for i in range(30)] + [point("m", T + i) for i in range(70)],
        [point("a", T + 900, **forced)],
        [point("b", T + 1500)],  # the watermark passes the first timer of a and m: a has come again, m hasn't
        [point("b", T + 1600)],
        [point("b", T + 3000)],
        [point("b", T + 3001)],
        [point("m", T + 3002), point("m", T + 3061)],
    ]
    got, _ = run(spark, tmp_path, batches, spark.createDataFrame([], REGISTRY), "idle", s, name="judged")
    ck = tmp_path / "ck_idle"
    for kind in (eng.Repair, eng.Series, eng.Judge):
        first, before, after = (names_in(spark, ck, kind, n) for n in (0, 3, 5))
        assert "a" in first["seen"] and ("m" in first["seen"])
        assert all("m" not in x for x in before.values()) and "a" in before["seen"], kind
        assert all("a" not in x for x in after.values()), kind
    # m's open bucket of ten points has gone unsaid, and what comes starts anew.
    assert sorted((r.timestamp, r.value) for r in got.where("metric_name = 'm'").collect()) == [(T + 59, 60.0), (T + 3002, 1.0)]


def test_late_points_have_a_place(spark, tmp_path):
    """Within the lateness they are taken when they come, and close the open bucket; beyond it they are dropped."""
    batches = [
        [point("a", T + 57), point("a", T + 58), point("a", T + 61, 5.0)],
        [point("a", T + 59, 2.0)],  # fills nothing, closes the second bucket, opens the first one again
        [point("a", T + 62, 7.0)],  # the next gap is measured from 61
        [point("z", T + 200)],
        [point("z", T + 201)],  # a batch drops what was late for the batch before it
        [point("a", T + 190, 3.0), point("z", T + 202)],
    ]
    got, query = run(spark, tmp_path, [*batches, [flush("a", T + 202)]], spark.createDataFrame([], REGISTRY), "late", name="judged")
    rows = [(r.bucket, r.timestamp, r.value, r.bucket_size) for r in got.where("metric_name = 'a'").collect()]
    # 57 and 58; two fills and 61; 59 alone; 62 alone.
    assert sorted(rows) == [(T, T + 59, 2.0, 1), (T, T + 59, 2.0, 3), (T + 60, T + 61, 5.0, 2), (T + 60, T + 62, 7.0, 1)]
    assert sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"]) == 1


def test_tails_are_trimmed(spark, tmp_path):
    s = Settings(jump_clip_history_window=40, second_history_window=150, minute_history_window=5)
    rows = [point("a", T + i, float(i % 7), tags={"force_ai": "true"}) for i in range(700)] + [point("m", T + i, float(i % 5)) for i in range(700)]
    run(spark, tmp_path, [[r for r in rows if r["timestamp"] < T + 350], [r for r in rows if r["timestamp"] >= T + 350]], spark.createDataFrame([], REGISTRY), "trim", s, name="judged")
    held = lambda kind, name: {(r.metric_name, str(r[name][0]) if hasattr(r[name], "key") else ""): r[name] for r in eng.states_of(spark, str(tmp_path / "ck_trim"), kind)[name].collect()}
    assert all(len(x["size"]) == 40 for x in held(eng.Repair, "sizes").values())
    assert all(len(x["value"]) == 120 for x in held(eng.Series, "recent").values())
    assert all(len(x.value["value"]) <= 60 for x in held(eng.Series, "seconds").values())
    assert all(len(x.value["value"]) <= 60 for x in held(eng.Series, "tails").values())
    sizes = {k: (len(x.value["value"])) for k, x in held(eng.Judge, "rolling").items()}
    assert {n for (m, _), n in sizes.items() if m == "a"} == {150} and {n for (m, _), n in sizes.items() if m == "m"} == {5}
    assert max(len(x.value["flag"]) for x in held(eng.Judge, "judged").values()) <= 4000


def test_a_query_primed_from_stored_states_goes_on(spark, tmp_path):
    points, registry = src.demo_points(spark), src.demo_registry(spark)
    cut = T + 745  # inside the dip: an incident and a bucket are open
    first, _ = run(spark, tmp_path, [lines_of(points.where(F.col("timestamp") < cut))], registry, "before")
    eng.snapshot(spark, str(tmp_path / "ck_before"), str(tmp_path / "states"))
    again, _ = run(spark, tmp_path, [lines_of(points.where(F.col("timestamp") >= cut)), [flush("payment.success_rate", T + 1800), flush("payment.long_tail_count", T + 1800)]], registry, "after", primed=str(tmp_path / "states"))
    told = lambda df: [tuple(r) for r in df.select(TOLD).collect()]
    assert sorted(told(first) + told(again)) == sorted(told(replay(points, registry).alerts))


def test_a_started_stream_fills_the_tables(spark, tmp_path):
    points, registry, told = src.demo_points(spark, 800), src.demo_registry(spark), []
    inp = tmp_path / "in"
    inp.mkdir()
    (inp / "0.json").write_text("\n".join(lines_of(points)))
    time.sleep(1.05)
    (inp / "1.json").write_text(json.dumps(flush("payment.long_tail_count", T + 800)))
    store = HistoryStore(spark, str(tmp_path / "h"))
    own = eng.Engine(registry, *src.empty_calendar(spark))
    for query in (own.start(read_points(spark, str(inp), 1), str(tmp_path / "c1"), store, lambda df, n: told.extend(df.select(TOLD).collect())), own.keep(read_points(spark, str(inp), 1), str(tmp_path / "c2"), store)):
        query.awaitTermination(300)
        assert query.exception() is None
    whole = replay(points, registry)
    assert sorted(map(tuple, told)) == sorted(map(tuple, whole.alerts.select(TOLD).collect()))
    key = ["metric_name", "granularity", "timestamp"]
    rounded = lambda df, c: sorted((*(r[k] for k in key), round(r[c], 6)) for r in df.collect())
    assert rounded(store.read("predictions"), "predict_value") == rounded(whole.judged, "predict_value")
    assert rounded(store.read("anomalies"), "confidence_score") == rounded(whole.judged, "confidence_score")
    assert rounded(store.read("series_points"), "value") == rounded(whole.series, "value")
    assert store.read("raw_points").count() == points.count()


def test_assessments_come_as_commands(spark, tmp_path):
    """A metric becomes eligible in mid-stream: seconds from then on, and a flush closes its bucket under the mode it has by then."""
    rows = points_of(spark, [("a", T, 1, "AA", "P1", "rate", {}), ("f", T, 1, "AA", "P0", "rate", {"force_ai": "true"})])
    registry = spark.createDataFrame(ingest.register(rows).collect(), REGISTRY)
    history = points_of(spark, [("a", T - 1000 + i, 0.9, "AA", "P1", "rate", {}) for i in range(100)])
    none = spark.createDataFrame([], "metric_name string, since long, eligible boolean")
    s = Settings(history_weeks_required=0)
    (due,) = routing.assess_due(history, registry, none, T + 10, s).collect()
    want = routing.assess(history, registry.where("metric_name = 'a'"), s).first()
    assert (due.metric_name, due.command == "eligible") == ("a", want.eligible)
    known = spark.createDataFrame([("a", T, True)], none.schema)
    assert routing.assess_due(history, registry, known, T + 86400, s).count() == 0 and routing.assess_due(history.withColumn("timestamp", F.col("timestamp") + 600_000), registry, known, T + 604800, s).count() == 1
    batches = [[point("a", T + i, 0.9, priority="P1", metric_type="rate") for i in range(5)], [{"metric_name": "a", "timestamp": T + 5, "command": "eligible"}, point("a", T + 6, 0.9), flush("a", T + 7)]]
    got, _ = run(spark, tmp_path, batches, registry.where("metric_name = 'a'"), "modes", s, name="judged")
    # The open bucket's five seconds under the mode of the flush; the second between, filled; the last one.
    assert sorted((r.timestamp, r.mode, r.granularity) for r in got.collect()) == [(T + 4, "ai", "1s"), (T + 5, "ai", "1s"), (T + 6, "ai", "1s")]


def test_a_table_is_streamed_in_micro_batches_of_bounded_size(spark, tmp_path):
    """In order of time whatever the order of its rows, with the last ingested of a second, and no bucket forgotten in a gap between them."""
    rows = [(m, T + 7 * i + (10 * 86400 if i > 200 else 0), i % 11 + n, "AA", "P0", "count", {}) for m in "ab" for i in range(400) for n in range(1 + (i % 10 == 0))]
    points = points_of(spark, rows).checkpoint()
    ends = points.groupBy("metric_name").agg((F.max("timestamp") + 1).alias("timestamp")).withColumn("command", F.lit("flush"))
    stream = src.paced_stream(points.repartition(8, F.xxhash64("ingest_seq", F.lit(5))).unionByName(ends, allowMissingColumns=True), str(tmp_path / "stream"), 200)
    own = eng.Engine(ingest.register(points).checkpoint(), *src.empty_calendar(spark), Settings(max_missing_fill=0, jump_clip_multiplier=1e12, state_ttl_sec=10**10))
    cols = ["metric_name", "bucket", "timestamp", "bucket_size", "value"]
    query = own.series(own.repaired(stream)).select(cols).writeStream.format("memory").queryName("paced").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    sizes = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert sum(sizes) == len(rows) + 2 and len(sizes) == 5 and max(sizes) < 250
    want = downsample(ingest.deduplicate(points).withColumn("granularity_sec", F.lit(60))).select(cols)
    assert sorted(map(tuple, spark.table("paced").collect())) == sorted(map(tuple, want.collect()))


def test_streamed_buckets_equal_the_batch_with_few_states(spark, tmp_path):
    """Widths by metric; repeated points over micro-batches, of which the last ingested counts; states by shares of a metric, not by point or second of the week."""
    kinds = {"a": ("P0", "count"), "b": ("P1", "rate"), "c": ("P2", "latency"), "d": ("P3", "gauge")}
    rows = [(m, T + 97 * i - (4 if n == 2 else 0), (i * 7 % 31) / 8 + n, "AA", p, k, {}) for i in range(900) for m, (p, k) in kinds.items() for n in range(1 + 2 * (i % 10 == 0))]
    seq = {r: i for i, r in enumerate(sorted(range(len(rows)), key=lambda i: i * 7919 % len(rows)))}
    points = points_of(spark, rows).withColumn("event_time", F.timestamp_seconds("timestamp")).toPandas()
    points["ingest_seq"] = [seq[i] for i in range(len(rows))]
    points = points.sort_values("timestamp", kind="stable")
    points["tags"] = [{} for _ in rows]
    names = [*POINT.names, "ingest_seq"]
    table = spark.createDataFrame(points[names], f"{POINT.simpleString()[7:-1]},ingest_seq:bigint")
    for begin in range(0, len(rows), 1200):  # no cut within a second matters: a bucket's points are kept until it closes
        spark.createDataFrame(points[names].iloc[begin : begin + 1200], table.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.05)
    (end,) = spark.createDataFrame(points[names].iloc[-1:], table.schema).collect()
    spark.createDataFrame([end.asDict() | {"timestamp": end.timestamp + 3600}], table.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("event_time", F.timestamp_seconds("timestamp"))
    cols = ["metric_name", "bucket", "timestamp", "bucket_size", F.round("value", 6)]
    got = stream_buckets(stream, route_seconds(F.col("priority"))).select(cols)
    query = got.writeStream.format("memory").queryName("shared").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None and sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"]) == 0
    want = downsample(ingest.deduplicate(table).withColumn("granularity_sec", route_seconds(F.col("priority")))).select(cols)
    assert sorted(map(tuple, spark.table("shared").collect())) == sorted(map(tuple, want.collect()))
    assert max(op["numRowsUpdated"] for p in query.recentProgress for op in p["stateOperators"]) <= SHARES * len(kinds)


def test_a_micro_batch_has_several_files_and_small_ones_as_many(spark, tmp_path):
    """Most points lie in one second, so ranges of time are of unequal sizes; each micro-batch comes whole and in order."""
    at = F.when(F.col("id") < 40, F.col("id")).when(F.col("id") < 150_000, 50).otherwise(F.col("id") - 149_000)
    points = spark.range(170_000).select(F.lit("a").alias("metric_name"), (at + T).alias("timestamp"), F.col("id").alias("ingest_seq"))
    stream, got = src.paced_stream(points, str(tmp_path / "stream"), 100_000), {}

    def keep(df, n):
        got[n] = df.agg(F.count("*"), F.min("timestamp"), F.max("timestamp"), F.sum("ingest_seq")).first()

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(300)
    batches = [got[n] for n in sorted(got)]
    assert len(batches) == 2 and sum(b[0] for b in batches) == 170_000 and sum(b[3] for b in batches) == 170_000 * 169_999 // 2
    assert batches[0][2] < batches[1][1] and [len(list((tmp_path / "stream" / "files" / str(n)).glob("*.parquet"))) for n in (0, 1)] == [2, 2]
