"""One query per operator over the test tables, and its SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import exprs as ex
from tidewatch.functions.kernels import covariance_kde_of, huber_of, kde_of, mann_kendall_p
from tidewatch.operators import alerts, calendars, detect, features, history, ingest, models, routing
from tidewatch.operators.downsample import downsample
from tidewatch.operators.zero_rule import zero_rule
from tidewatch.plans.prediction import predict_and_judge
from tidewatch.plans.replay import replay
from tidewatch.schemas import POINT
from tidewatch.session import ensure_checkpoint_dir
from tidewatch.settings import DEFAULTS, MAX_Z_HISTORY, Settings
from tidewatch.sources.points import demo_points, demo_registry, empty_calendar, event_points, paced_stream, read_jsonl_lenient
from tidewatch.streaming import engine, monitor

#: Rows of a micro-batch of a query's stream, whose states lie in the state store and not in Python.
STREAM_ROWS = 2_000_000

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def r4(*names: str) -> list:
    return [F.round(n, 4).alias(n) for n in names]


def s4(*names: str) -> list:
    """As r4, off the exact halves that means of short decimals come to; the SQL adds the same."""
    return [F.round(F.col(n) + 0.0000137, 4).alias(n) for n in names]


def points(spark: SparkSession, d: str) -> DataFrame:
    return event_points(spark, d)


def deduped(spark: SparkSession, d: str) -> DataFrame:
    return ingest.deduplicate(points(spark, d))


PTS = """WITH pts AS (
  SELECT 'events.' || event_type AS metric_name, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp, value, event_id AS ingest_seq,
    CASE event_type WHEN 'error' THEN 'rate' WHEN 'purchase' THEN 'count' WHEN 'click' THEN 'ratio' WHEN 'view' THEN 'latency' ELSE 'gauge' END AS metric_type,
    CASE event_type WHEN 'error' THEN 'P0' WHEN 'purchase' THEN 'P0' WHEN 'click' THEN 'P1' WHEN 'view' THEN 'P2' ELSE 'P3' END AS priority,
    CASE event_type WHEN 'error' THEN 'AA' WHEN 'purchase' THEN 'AA' WHEN 'view' THEN 'CC' ELSE 'BB' END AS business_line,
    event_type IN ('error', 'purchase', 'click') AS core_link, event_type = 'error' AS force_ai
  FROM events WHERE event_type IN ('error', 'purchase', 'click', 'view', 'signup')),
ded AS (SELECT * FROM pts QUALIFY row_number() OVER (PARTITION BY metric_name, timestamp ORDER BY ingest_seq DESC) = 1)"""


# Ingest


@query("validate_points", PTS + """, v AS (SELECT metric_name, CASE WHEN ingest_seq % 97 = 0 THEN '  ' ELSE business_line END AS bl, CASE WHEN ingest_seq % 89 = 0 THEN 0 ELSE timestamp END AS t FROM pts)
SELECT metric_name, count(*) FILTER (trim(bl) <> '' AND t > 0) AS n_valid, count(*) FILTER (NOT (trim(bl) <> '' AND t > 0)) AS n_rejected FROM v GROUP BY metric_name""")  # fmt: skip
def _(spark, d):
    bad = points(spark, d).withColumns({"business_line": F.when(F.col("ingest_seq") % 97 == 0, "  ").otherwise(F.col("business_line")), "timestamp": F.when(F.col("ingest_seq") % 89 == 0, 0).otherwise(F.col("timestamp"))})
    return bad.groupBy("metric_name").agg(F.count_if(ingest.is_valid(bad)).alias("n_valid"), F.count_if(~ingest.is_valid(bad)).alias("n_rejected"))


@query("dedup_last_wins", PTS + " SELECT metric_name, timestamp, value, ingest_seq FROM ded")
def _(spark, d):
    return deduped(spark, d).select("metric_name", "timestamp", "value", "ingest_seq")


GAPS = PTS + """, g AS (SELECT *, timestamp - lag(timestamp) OVER w - 1 AS gap, lag(timestamp) OVER w AS pt, lag(value) OVER w AS pv FROM ded WINDOW w AS (PARTITION BY metric_name ORDER BY timestamp)),
filled AS (
  SELECT metric_name, timestamp, value, coalesce(gap <= 3, true) AS trusted, false AS is_interpolated, CASE WHEN gap > 3 THEN gap::VARCHAR END AS missing_gap FROM g
  UNION ALL SELECT metric_name, pt + i, CASE WHEN metric_type IN ('count', 'qps') THEN 0 ELSE pv + i * (value - pv) / (gap + 1) END, true, true, NULL FROM g, unnest(range(1, gap + 1)) AS u(i) WHERE gap BETWEEN 1 AND 3)"""


@query("gap_fill", GAPS + " SELECT metric_name, timestamp, round(value, 4) AS value, trusted, is_interpolated, missing_gap FROM filled")
def _(spark, d):
    return ingest.fill_gaps(deduped(spark, d)).select("metric_name", "timestamp", *r4("value"), "trusted", "is_interpolated", F.col("tags")["missing_gap"].alias("missing_gap"))


@query("large_gap_untrusted", GAPS + " SELECT metric_name, count(*) AS n, max(missing_gap::BIGINT) AS longest FROM filled WHERE NOT trusted GROUP BY metric_name")
def _(spark, d):
    return ingest.fill_gaps(deduped(spark, d)).where("not trusted").groupBy("metric_name").agg(F.count("*").alias("n"), F.max(F.col("tags")["missing_gap"].cast("long")).alias("longest"))


@query("jump_clip", PTS + """, s AS (SELECT metric_name, timestamp, CASE WHEN ingest_seq % 500 = 0 THEN value * 100 ELSE value END AS value FROM ded),
l AS (SELECT *, count(*) OVER w AS n, 10 * greatest(quantile_cont(abs(value), 0.99) OVER w, 1e-6) AS lim FROM s WINDOW w AS (PARTITION BY metric_name ORDER BY timestamp ROWS BETWEEN 600 PRECEDING AND 1 PRECEDING))
SELECT metric_name, timestamp, round(CASE WHEN n >= 20 THEN least(greatest(value, 0), lim) ELSE value END, 4) AS value, coalesce(abs(CASE WHEN n >= 20 THEN least(greatest(value, 0), lim) ELSE value END - value) > 1e-6, false) AS clipped FROM l""")  # fmt: skip
def _(spark, d):
    jumps = deduped(spark, d).withColumn("value", F.when(F.col("ingest_seq") % 500 == 0, F.col("value") * 100).otherwise(F.col("value")))
    return ingest.clip_jumps_given_history(jumps).select("metric_name", "timestamp", *r4("value"), "clipped")


def _recursive(sql: str) -> str:
    return sql.replace("WITH pts", "WITH RECURSIVE pts", 1)


@query("jump_clip_exact", _recursive(PTS) + """, s AS MATERIALIZED (SELECT metric_name, timestamp, CASE WHEN ingest_seq % 500 = 0 THEN value * 100 ELSE value END AS value, row_number() OVER (PARTITION BY metric_name ORDER BY timestamp) AS n FROM ded),
c AS (
  SELECT metric_name, n, timestamp, value AS raw, value, [value] AS tail FROM s WHERE n = 1
  UNION ALL SELECT metric_name, n, timestamp, raw, x, list_append(CASE WHEN len(tail) >= 600 THEN tail[2:] ELSE tail END, x) FROM (
    SELECT s.metric_name, s.n, s.timestamp, s.value AS raw, tail, CASE WHEN len(tail) >= 20 THEN least(greatest(s.value, 0), 10 * greatest(list_aggregate(list_transform(tail, lambda t: abs(t)), 'quantile_cont', 0.99), 1e-6)) ELSE s.value END AS x
    FROM c JOIN s ON s.metric_name = c.metric_name AND s.n = c.n + 1))
SELECT metric_name, timestamp, round(value, 4) AS value, abs(value - raw) > 1e-6 AS clipped FROM c""")  # fmt: skip
def _(spark, d):
    jumps = deduped(spark, d).withColumn("value", F.when(F.col("ingest_seq") % 500 == 0, F.col("value") * 100).otherwise(F.col("value")))
    return ingest.clip_jumps(jumps).select("metric_name", "timestamp", *r4("value"), "clipped")


REG = PTS + """, reg AS (SELECT metric_name, arg_min(business_line, (timestamp, ingest_seq)) AS business_line, arg_min(priority, (timestamp, ingest_seq)) AS priority,
  arg_min(metric_type, (timestamp, ingest_seq)) AS metric_type, bool_and(core_link) AS core_link, bool_and(force_ai) AS force_ai FROM pts GROUP BY metric_name)"""


@query("registry_autoregister", REG + " SELECT * FROM reg")
def _(spark, d):
    return ingest.register(points(spark, d)).drop("tags")


@query("registry_reload", REG + " SELECT metric_name, true AS eligible FROM reg WHERE metric_name <> 'events.view'")
def _(spark, d):
    reg = ingest.register(points(spark, d))
    return ingest.reload_registry(reg, reg.where("metric_name <> 'events.view'"), reg.select("metric_name", F.lit(True).alias("eligible")))[1]


# Eligibility and routing


@query("route_points", REG + """ SELECT metric_name, timestamp, CASE WHEN force_ai THEN 'ai' WHEN s >= 600 THEN 'zero_rule' ELSE 'minute_ai' END AS mode, CASE WHEN force_ai THEN 1 ELSE s END AS granularity_sec,
  CASE WHEN force_ai THEN '1s' ELSE (s // 60)::VARCHAR || 'm' END AS label FROM (SELECT ded.metric_name, timestamp, reg.force_ai, CASE reg.priority WHEN 'P0' THEN 60 WHEN 'P1' THEN 300 WHEN 'P2' THEN 600 ELSE 1800 END AS s FROM ded JOIN reg USING (metric_name))""")  # fmt: skip
def _(spark, d):
    reg = ingest.register(points(spark, d)).select("metric_name", "priority", "force_ai").withColumn("eligible", F.lit(False))
    return routing.route(deduped(spark, d).select("metric_name", "timestamp").join(reg, "metric_name")).select("metric_name", "timestamp", "mode", "granularity_sec", "label")


LAGS = "1440, 10080, 86400, 604800"
ELG = REG + """, o AS (SELECT *, timestamp - lag(timestamp) OVER w AS gap, """ + ", ".join(f"lag(value, {n}) OVER w AS l{n}" for n in (1440, 10080, 86400, 604800)) + """ FROM ded WINDOW w AS (PARTITION BY metric_name ORDER BY timestamp)),
gaps AS (SELECT metric_name, list_sort(list(gap))[count(gap) // 2 + 1] AS median_gap FROM o WHERE gap IS NOT NULL GROUP BY metric_name),
cor AS (SELECT metric_name, """ + ", ".join(f"CASE WHEN stddev_pop(value) FILTER (l{n} IS NOT NULL) > 1e-6 AND stddev_pop(l{n}) > 1e-6 THEN corr(value, l{n}) ELSE 0 END AS r{n}" for n in (1440, 10080, 86400, 604800)) + """ FROM o GROUP BY metric_name),
f AS (SELECT metric_name, count(*) AS n, max(timestamp) - min(timestamp) AS span, avg((value > 0)::INT) AS nonzero, CASE WHEN count(*) <= 1 OR avg(abs(value)) <= 1e-6 THEN 0 ELSE stddev_pop(value) / avg(abs(value)) END AS cv FROM ded GROUP BY metric_name)"""  # fmt: skip


@query("median_gap", ELG + " SELECT metric_name, median_gap FROM gaps")
def _(spark, d):
    return routing.median_gaps(deduped(spark, d))


@query("autocorr_lag", PTS + """, o AS (SELECT *, lag(value, 7) OVER w AS a, lag(value, 60) OVER w AS b FROM ded WINDOW w AS (PARTITION BY metric_name ORDER BY timestamp))
SELECT metric_name, round(corr(value, a), 4) AS r_7, round(corr(value, b), 4) AS r_60 FROM o GROUP BY metric_name""")  # fmt: skip
def _(spark, d):
    return routing.autocorrelations(deduped(spark, d), (7, 60)).select("metric_name", *r4("r_7", "r_60"))


@query("coefficient_of_variation", ELG + " SELECT metric_name, round(cv, 4) AS cv FROM f")
def _(spark, d):
    return deduped(spark, d).groupBy("metric_name").agg(F.round(ex.coefficient_of_variation(F.col("value")), 4).alias("cv"))


@query("eligibility_score", ELG + """ SELECT metric_name, eligible OR force_ai AS eligible, round(CASE WHEN force_ai THEN 1 ELSE score END, 4) AS score FROM (
  SELECT metric_name, force_ai, score, score >= 0.65 AS eligible FROM (SELECT reg.metric_name, force_ai, CASE WHEN n < 2 OR span < 4 * 604800 THEN 0 ELSE
    0.30 * CASE WHEN median_gap <= 1 THEN greatest(r86400, r604800, 0) ELSE greatest(r1440, r10080, 0) END + 0.25 * least(nonzero / 0.7, 1)
    + 0.20 * CASE priority WHEN 'P0' THEN 1 WHEN 'P1' THEN 0.8 WHEN 'P2' THEN 0.5 WHEN 'P3' THEN 0.3 ELSE 0.5 END + 0.25 * greatest(0, 1 - cv / 0.8) END AS score
  FROM reg JOIN f USING (metric_name) JOIN gaps USING (metric_name) JOIN cor USING (metric_name)))""")  # fmt: skip
def _(spark, d):
    return routing.assess(deduped(spark, d), ingest.register(points(spark, d))).select("metric_name", "eligible", *r4("score"))


def _lag_sql(n: int) -> str:
    x, y = f"v[{n + 1}:]", f"v[:len(v) - {n}]"
    spread = f"len(v) > {n} AND list_stddev_pop({x}) > 1e-6 AND list_stddev_pop({y}) > 1e-6"
    return f"CASE WHEN {spread} THEN (list_dot_product({x}, {y}) / len({x}) - list_avg({x}) * list_avg({y})) / (list_stddev_pop({x}) * list_stddev_pop({y})) ELSE 0 END"


@query("eligibility_throttled", _recursive(REG) + f""", known AS MATERIALIZED (SELECT metric_name, timestamp, value, reg.priority, reg.force_ai FROM ded JOIN reg USING (metric_name)),
told AS (
  SELECT metric_name, min(timestamp) AS since, any_value(force_ai) AS eligible, any_value(force_ai) AS forced FROM known GROUP BY metric_name
  UNION ALL SELECT metric_name, since, CASE WHEN len(v) < 2 OR t[-1] - t[1] < 4 * 604800 THEN false ELSE
      0.30 * CASE WHEN list_sort(list_transform(range(2, len(t) + 1), lambda i: t[i] - t[i - 1]))[(len(t) - 1) // 2 + 1] <= 1 THEN greatest({_lag_sql(86400)}, {_lag_sql(604800)}, 0) ELSE greatest({_lag_sql(1440)}, {_lag_sql(10080)}, 0) END
      + 0.25 * least(len(list_filter(v, lambda x: x > 0)) / len(v) / 0.7, 1) + 0.20 * CASE p WHEN 'P0' THEN 1 WHEN 'P1' THEN 0.8 WHEN 'P2' THEN 0.5 WHEN 'P3' THEN 0.3 ELSE 0.5 END
      + 0.25 * greatest(0, 1 - list_stddev_pop(v) / greatest(list_avg(list_transform(v, lambda x: abs(x))), 1e-6) / 0.8) >= 0.65 END, false
  FROM (SELECT h.metric_name, since, list(value ORDER BY h.timestamp) AS v, list(h.timestamp ORDER BY h.timestamp) AS t, any_value(h.priority) AS p FROM (
      SELECT told.metric_name, min(k.timestamp) AS since FROM told JOIN known k ON k.metric_name = told.metric_name AND k.timestamp >= told.since + CASE WHEN eligible THEN 604800 ELSE 86400 END WHERE NOT forced GROUP BY told.metric_name) n
    JOIN known h ON h.metric_name = n.metric_name AND h.timestamp BETWEEN n.since - 28 * 86400 AND n.since GROUP BY h.metric_name, since))
SELECT metric_name, since, eligible FROM told""")  # fmt: skip
def _(spark, d):
    return routing.eligibility_times(deduped(spark, d), ingest.register(points(spark, d)))


# Downsampling


def _buckets(seconds: str) -> str:
    return f"""SELECT metric_name, b AS bucket, max(timestamp) AS timestamp, count(*) AS bucket_size, round(CASE arg_min(metric_type, (timestamp, ingest_seq)) WHEN 'count' THEN sum(value) WHEN 'rate' THEN avg(value) WHEN 'ratio' THEN avg(value)
  WHEN 'latency' THEN quantile_cont(value, 0.95) ELSE arg_max(value, (timestamp, ingest_seq)) END, 4) AS value FROM (SELECT *, timestamp - timestamp % {seconds} AS b FROM ded) GROUP BY metric_name, b"""


def _down(seconds: int):
    def run(spark, d):
        return downsample(deduped(spark, d).withColumn("granularity_sec", F.lit(seconds))).select("metric_name", "bucket", "timestamp", "bucket_size", *r4("value"))

    return run


for _name, _sec in (("1m", 60), ("5m", 300), ("10m", 600), ("30m", 1800)):
    query(f"downsample_{_name}", PTS + " " + _buckets(str(_sec)))(_down(_sec))


@query("downsample_by_route", PTS + " " + _buckets("CASE priority WHEN 'P0' THEN 60 WHEN 'P1' THEN 300 WHEN 'P2' THEN 600 ELSE 1800 END"))
def _(spark, d):
    return downsample(deduped(spark, d).withColumn("granularity_sec", ex.route_seconds(F.col("priority")))).select("metric_name", "bucket", "timestamp", "bucket_size", *r4("value"))


@query("stream_buckets", PTS + " " + _buckets("CASE priority WHEN 'P0' THEN 60 WHEN 'P1' THEN 300 WHEN 'P2' THEN 600 ELSE 1800 END").replace("FROM ded) GROUP", "FROM ded WHERE metric_name <> 'events.error') GROUP"))
def _(spark, d):
    """The events as a stream, in buckets of each priority's width; forced metrics have none.

    One point comes once more, beyond the table's end: the watermark then passes all buckets but that one's own, which stays open.
    """
    folder, whole = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}", max(DEFAULTS.priority_route_seconds.values())
    forced = F.coalesce(F.lower(F.col("tags")["force_ai"]).isin("true", "1"), F.lit(False))
    known = routing.route(ingest.validate(points(spark, d)).withColumns({"force_ai": forced, "eligible": F.lit(False)})).where("mode <> 'ai'")
    rows = known.select("metric_name", "timestamp", "value", "business_line", "metric_type", "granularity_sec", "ingest_seq")
    end = rows.limit(1).withColumn("timestamp", F.lit((rows.agg(F.max("timestamp")).first()[0] or 0) + 2 * whole))
    engine.use_state_store(spark)
    stream = paced_stream(rows.unionByName(end), folder, STREAM_ROWS)
    closed = monitor.stream_buckets(stream, F.col("granularity_sec")).select("metric_name", "bucket", "timestamp", "bucket_size", *r4("value"))
    closed.writeStream.format("parquet").option("path", f"{folder}/closed").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(closed.schema).parquet(f"{folder}/closed")


# Calendar and features


def _calendar(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    days = spark.sql("SELECT * FROM VALUES (DATE'2024-01-01', true, false), (DATE'2024-01-15', false, true), (DATE'2024-01-20', true, true) AS t(date, is_holiday, is_hotspot)")
    spans = spark.sql("SELECT * FROM VALUES ('events.error', 1704400000L, 1704500000L), ('events.view', 1705000000L, 1705086400L), ('events.view', 1705050000L, 1705100000L) AS t(metric_name, start_ts, end_ts)")
    return days, spans


CAL = PTS + """, days AS (SELECT * FROM (VALUES (DATE '2024-01-01', true, false), (DATE '2024-01-15', false, true), (DATE '2024-01-20', true, true)) AS t(date, is_holiday, is_hotspot)),
spans AS (SELECT * FROM (VALUES ('events.error', 1704400000, 1704500000), ('events.view', 1705000000, 1705086400), ('events.view', 1705050000, 1705100000)) AS t(m, a, b)),
loc AS (SELECT *, make_timestamp((timestamp + 28800) * 1000000) AS lt FROM ded),
cal AS (SELECT loc.*, coalesce(is_holiday, false) AS "isHoliday", coalesce(is_hotspot, false) AS "isHotSpot", EXISTS (SELECT 1 FROM spans WHERE m = metric_name AND timestamp BETWEEN a AND b) AS "isRCA",
  (isodow(lt) - 1)::INT AS weekday, hour(lt)::INT AS hour, minute(lt)::INT AS minute, second(lt)::INT AS second FROM loc LEFT JOIN days ON days.date = lt::DATE)"""  # fmt: skip


def calendared(spark, d):
    return calendars.with_calendar(deduped(spark, d), *_calendar(spark))


@query("calendar_flags", CAL + ' SELECT metric_name, timestamp, "isHoliday", "isHotSpot", weekday, hour, minute, second FROM cal')
def _(spark, d):
    return calendared(spark, d).select("metric_name", "timestamp", "isHoliday", "isHotSpot", "weekday", "hour", "minute", "second")


@query("rca_interval_join", CAL + ' SELECT metric_name, timestamp FROM cal WHERE "isRCA"')
def _(spark, d):
    return calendared(spark, d).where("isRCA").select("metric_name", "timestamp")


@query("feature_factor", CAL + """ SELECT metric_name, timestamp, round(CASE WHEN "isHoliday" THEN 1.02::DOUBLE ELSE 1 END * CASE WHEN "isHotSpot" THEN 1.05 ELSE 1 END * CASE WHEN "isRCA" THEN 0.97 ELSE 1 END
  * CASE business_line WHEN 'AA' THEN 1.00 WHEN 'BB' THEN 1.02 WHEN 'CC' THEN 0.98 ELSE 1 END, 4) AS factor FROM cal""")  # fmt: skip
def _(spark, d):
    return calendared(spark, d).select("metric_name", "timestamp", F.round(ex.feature_factor(F.col("isHoliday"), F.col("isHotSpot"), F.col("isRCA"), F.col("business_line")), 4).alias("factor"))


ROLL = PTS + """, past AS (SELECT *, list(value) OVER (PARTITION BY metric_name ORDER BY timestamp RANGE BETWEEN 604800 PRECEDING AND 1 PRECEDING) AS p FROM ded),
ins AS (SELECT *, list_sort(CASE WHEN p IS NULL THEN [] WHEN len(p) > 4000 THEN p[len(p) - 3999:] ELSE p END) AS s FROM past),
roll AS (SELECT metric_name, timestamp, value, coalesce(list_avg(s), value) AS m, CASE WHEN len(s) > 1 THEN list_stddev_pop(s) ELSE 0 END AS sd, s FROM ins)"""


@query("rolling_features", ROLL + """ SELECT metric_name, timestamp, round(m + 0.0000137, 4) AS rolling_mean_7d, round(sd + 0.0000137, 4) AS rolling_std_7d,
  round(coalesce(list_aggregate(s, 'quantile_cont', 0.7), m) + 0.0000137, 4) AS rolling_p70_7d, round(coalesce(list_aggregate(s, 'quantile_cont', 0.3), m) + 0.0000137, 4) AS rolling_p30_7d FROM roll""")  # fmt: skip
def _(spark, d):
    return features.rolling_features(deduped(spark, d)).select("metric_name", "timestamp", *s4("rolling_mean_7d", "rolling_std_7d", "rolling_p70_7d", "rolling_p30_7d"))


@query("aligned_median", CAL + """ SELECT metric_name, timestamp, round(coalesce(quantile_cont(value, 0.5) OVER slot, quantile_cont(value, 0.5) OVER sec, avg(value) OVER rec, value) + 0.0000137, 4) AS base_value FROM cal
WINDOW slot AS (PARTITION BY metric_name, weekday, hour, minute, second, "isHoliday" ORDER BY timestamp ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING),
sec AS (PARTITION BY metric_name, second ORDER BY timestamp ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), rec AS (PARTITION BY metric_name ORDER BY timestamp ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING)""")  # fmt: skip
def _(spark, d):
    return features.aligned_baseline(calendared(spark, d)).select("metric_name", "timestamp", *s4("base_value"))


PRED = PTS + """, pred AS (SELECT *, greatest(coalesce(avg(value) OVER (PARTITION BY metric_name ORDER BY timestamp ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), value), 0) AS predict_value FROM ded)"""


def predicted(spark, d):
    return deduped(spark, d).withColumn("predict_value", F.greatest(F.coalesce(F.avg("value").over(ex.last_rows(6, "metric_name")), F.col("value")), F.lit(0.0)))


@query("residual_tail_mean", PRED + """, t AS (SELECT *, coalesce(avg(value - predict_value) OVER (PARTITION BY metric_name ORDER BY timestamp ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING), 0) AS m,
  0.2 * greatest(abs(coalesce(avg(value) OVER (PARTITION BY metric_name ORDER BY timestamp ROWS BETWEEN 600 PRECEDING AND 1 PRECEDING), value)), abs(value), 1e-3) AS b FROM pred)
SELECT metric_name, timestamp, round(least(greatest(m, -b), b) + 0.0000137, 4) AS "baseDayDiff" FROM t""")  # fmt: skip
def _(spark, d):
    level = F.coalesce(F.avg("value").over(ex.last_rows(600, "metric_name")), F.col("value"))
    return features.residual_tail_mean(predicted(spark, d).withColumn("rolling_mean_7d", level)).select("metric_name", "timestamp", *s4("baseDayDiff"))


@query("ewma_correction", PRED + """, r AS (SELECT metric_name, list(value / greatest(predict_value, 1e-6) ORDER BY timestamp) AS rates FROM pred GROUP BY metric_name)
SELECT metric_name, round(list_reduce(list_prepend(1.0::DOUBLE, rates), lambda a, x: least(greatest(0.9 * a + 0.1 * x, 0.5), 1.5)), 4) AS correction_rate FROM r""")  # fmt: skip
def _(spark, d):
    rates = predicted(spark, d).withColumn("rate", F.col("value") / F.greatest("predict_value", F.lit(1e-6)))
    return features.ewma_correction(rates).select("metric_name", *r4("correction_rate"))


SEASON = _recursive(CAL) + ROLL[len(PTS):] + """, base AS (SELECT metric_name, timestamp, coalesce(quantile_cont(value, 0.5) OVER slot, quantile_cont(value, 0.5) OVER sec, avg(value) OVER rec, value) AS b FROM cal
  WINDOW slot AS (PARTITION BY metric_name, weekday, hour, minute, second, "isHoliday" ORDER BY timestamp ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING),
  sec AS (PARTITION BY metric_name, second ORDER BY timestamp ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), rec AS (PARTITION BY metric_name ORDER BY timestamp ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING)),
rows_ AS MATERIALIZED (SELECT metric_name, timestamp, value AS x, b, 0.2 * greatest(abs(m), abs(value), 1e-3) AS most, row_number() OVER (PARTITION BY metric_name ORDER BY timestamp) AS n FROM base JOIN roll USING (metric_name, timestamp)),
sea AS (
  SELECT metric_name, 0::BIGINT AS n, 0::BIGINT AS timestamp, 1.0::DOUBLE AS correction, 0.01::DOUBLE AS sd, []::DOUBLE[] AS tail, 0.0::DOUBLE AS p, 0.0::DOUBLE AS lower, 0.0::DOUBLE AS upper, 0.0::DOUBLE AS diff FROM (SELECT DISTINCT metric_name FROM rows_)
  UNION ALL SELECT metric_name, n, timestamp, least(greatest(0.9 * correction + 0.1 * x / greatest(pre, 1e-6), 0.5), 1.5), greatest(0.9 * sd + 0.1 * abs(x - p), 0.001),
    list_append(CASE WHEN len(tail) >= 120 THEN tail[2:] ELSE tail END, x - p), p, greatest(p - 2 * sd, 0), p + 2 * sd, diff FROM (
    SELECT *, greatest(pre * correction, 1e-6) AS p FROM (SELECT *, greatest(b + diff, 0.5 * b, 1e-6) AS pre FROM (
      SELECT rows_.*, correction, sd, tail, least(greatest(coalesce(list_avg(tail), 0), -most), most) AS diff FROM sea JOIN rows_ ON rows_.metric_name = sea.metric_name AND rows_.n = sea.n + 1))))"""


@query("seasonal_predict", SEASON + ' SELECT metric_name, timestamp, round(p + 0.0000137, 4) AS predict_value, round(lower + 0.0000137, 4) AS predict_lower, round(upper + 0.0000137, 4) AS predict_upper, round(diff + 0.0000137, 4) AS "baseDayDiff" FROM sea WHERE n > 0')
def _(spark, d):
    series = features.aligned_baseline(calendared(spark, d)).withColumns({"mode": F.lit("ai"), "factor": F.lit(1.0), "local_score": F.lit(0.0)})
    slim = series.select("metric_name", "timestamp", "granularity", "value", "ingest_seq", "mode", "base_value", "factor", "local_score")
    return predict_and_judge(slim).select("metric_name", "timestamp", *s4("predict_value", "predict_lower", "predict_upper", "baseDayDiff"))


# Zero rule

ZERO = PTS + ", b AS (" + _buckets("CASE priority WHEN 'P2' THEN 600 ELSE 1800 END").replace("FROM ded)", "FROM ded WHERE priority IN ('P2', 'P3'))") + """),
z AS (SELECT metric_name, timestamp, value, greatest(coalesce(avg(value) OVER (PARTITION BY metric_name ORDER BY timestamp ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), value), 0) AS predict_value FROM b),
za AS (SELECT *, value <= 1e-6 OR (predict_value > 0 AND value / predict_value <= 0.1) AS abnormal FROM z)"""


def _slow(spark, d):
    own = deduped(spark, d).where("priority in ('P2', 'P3')").withColumn("granularity_sec", ex.route_seconds(F.col("priority")))
    return downsample(own).withColumn("value", F.round("value", 4))


@query("zero_rule_baseline", ZERO + " SELECT metric_name, timestamp, round(predict_value + 0.0000137, 4) AS predict_value FROM z")
def _(spark, d):
    return zero_rule(_slow(spark, d)).select("metric_name", "timestamp", *s4("predict_value"))


@query("zero_rule_anomaly", ZERO + """ SELECT metric_name, timestamp, round(value, 4) AS value, round(predict_value + 0.0000137, 4) AS predict_value, round(value - predict_value + 0.0000137, 4) AS z_score, 'down' AS direction,
  'zero_rule' AS label, 0.75::DOUBLE AS confidence_score, 'P2' AS alert_level FROM za WHERE abnormal""")  # fmt: skip
def zero_rule_anomaly(spark, d):
    judged = zero_rule(_slow(spark, d)).where("global_abnormal").withColumn("core_link", F.lit(False))
    return alerts.with_level(judged).select("metric_name", "timestamp", *r4("value"), *s4("predict_value", "z_score"), "direction", ex.alert_type(F.col("abnormal_labels")).alias("label"), "confidence_score", F.col("level").alias("alert_level"))


# Detection

def _huber_sql(of: str, rounds: int) -> str:
    """Reweighted ridge lines of the lists y of CTE ``of`` (id, y), a round per recursion."""
    sums = "a := list_sum(w) + 1e-4, b := list_dot_product(w, x), c := list_dot_product(w, x2) + 1e-4, p := list_dot_product(w, y), q := list_dot_product(w, xy)"
    line = "struct_pack(i := (z.c * z.p - z.b * z.q) / (z.a * z.c - z.b * z.b), s := (z.a * z.q - z.b * z.p) / (z.a * z.c - z.b * z.b))"
    off = "list_transform(range(1, len(y) + 1), lambda k: y[k] - l.i - l.s * k)"
    return f"""hub0 AS MATERIALIZED (SELECT id, y, list_transform(range(1, len(y) + 1), lambda k: k::DOUBLE) AS x, list_transform(range(1, len(y) + 1), lambda k: (k * k)::DOUBLE) AS x2, list_transform(range(1, len(y) + 1), lambda k: k * y[k]) AS xy FROM {of}),
hub AS (
  SELECT id, 0 AS r, {line} AS l, false AS done FROM (SELECT *, struct_pack({sums}) AS z FROM (SELECT *, list_transform(y, lambda v: 1.0::DOUBLE) AS w FROM hub0))
  UNION ALL SELECT id, r + 1, f, abs(f.i - l.i) <= 1e-6 + 1e-5 * abs(l.i) AND abs(f.s - l.s) <= 1e-6 + 1e-5 * abs(l.s) FROM (SELECT *, {line} AS f FROM (SELECT *, struct_pack({sums}) AS z FROM (
    SELECT *, list_transform(o, lambda v: CASE WHEN abs(v) > lim THEN lim / abs(v) ELSE 1 END) AS w FROM (SELECT *, 1.35 * greatest(1.4826 * list_median(list_transform(o, lambda v: abs(v - m))), sd, 1e-6) AS lim FROM (
      SELECT *, list_median(o) AS m, list_stddev_pop(o) AS sd FROM (SELECT hub.*, y, x, x2, xy, {off} AS o FROM hub JOIN hub0 USING (id) WHERE NOT done AND r < {rounds}))))))),
hubl AS (SELECT id, l.i + l.s * (len(y) + 1) AS forecast, greatest(list_stddev_pop({off}), 1e-6) AS deviation FROM (SELECT id, arg_max(l, r) AS l FROM hub GROUP BY id) JOIN hub0 USING (id))"""


LOCAL = PTS + """, p AS (SELECT *, list(value) OVER (PARTITION BY metric_name ORDER BY timestamp ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS w, list(value) OVER (PARTITION BY metric_name ORDER BY timestamp ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AS t FROM ded),
q AS (SELECT *, list_aggregate(w, 'quantile_cont', 0.25) AS q1, list_aggregate(w, 'quantile_cont', 0.5) AS med, list_aggregate(w, 'quantile_cont', 0.75) AS q3, list_avg(w) AS m, list_stddev_pop(w) AS sd, list_avg(t) AS tm, list_stddev_pop(t) AS tsd,
  list_transform(range(1, len(t) + 1), lambda i: list_append(t, value)[i + 1] - t[i]) AS df FROM p),
k AS (SELECT *, list_sum(list_transform(range(1, len(df)), lambda i: list_sum(list_transform(range(i + 1, len(df) + 1), lambda j: sign(df[j] - df[i]))))) AS s FROM q),
flags AS (SELECT metric_name, timestamp,
  coalesce(len(w) >= 8 AND abs(value - med) >= greatest(2 * sd, 0.005) AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)), false) AS boxplot,
  coalesce(len(w) >= 8 AND sd > 0 AND abs(value - m) >= greatest(2 * sd, 0.005) AND abs(value - m) > 3 * sd, false) AS n_sigma,
  coalesce(len(t) >= 6 AND abs((s - sign(s)) / sqrt(len(df) * (len(df) - 1) * (2 * len(df) + 5) / 18)) > 1.959963984540054 AND abs(value - tm) > greatest(2 * tsd, 0.005), false) AS trend FROM k)"""  # fmt: skip


@query("local_detectors", LOCAL + " SELECT * FROM flags")
def _(spark, d):
    return detect.local_detectors(deduped(spark, d)).select("metric_name", "timestamp", "boxplot", "n_sigma", "trend")


@query("local_score", _recursive(LOCAL) + """, reg30 AS (SELECT metric_name || timestamp AS id, metric_name, timestamp, value, list(value) OVER (PARTITION BY metric_name ORDER BY timestamp ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS y FROM ded),
long_ AS (SELECT id, y FROM reg30 WHERE len(y) >= 8), """ + _huber_sql("long_", 50) + """,
four AS (SELECT f.*, coalesce(abs(g.value - h.forecast) > greatest(3 * h.deviation, 0.01), false) AS robust_regression FROM flags f JOIN reg30 g USING (metric_name, timestamp) LEFT JOIN hubl h USING (id))
SELECT metric_name, timestamp, robust_regression, (robust_regression::INT + boxplot::INT + n_sigma::INT + trend::INT) / 4 AS local_score,
  concat_ws('+', CASE WHEN robust_regression THEN 'robust_regression' END, CASE WHEN boxplot THEN 'boxplot' END, CASE WHEN n_sigma THEN 'n_sigma' END, CASE WHEN trend THEN 'trend' END) AS labels FROM four""")  # fmt: skip
def _(spark, d):
    return detect.local_detectors(deduped(spark, d)).select("metric_name", "timestamp", "robust_regression", "local_score", F.array_join("local_labels", "+").alias("labels"))


SCORED = PRED + """, b AS (SELECT *, (value - predict_value) / greatest(sqrt(abs(predict_value)), 1e-6) AS z, -3.0::DOUBLE AS lo, 3.0::DOUBLE AS hi FROM pred),
sc AS (SELECT *, CASE WHEN z < lo THEN least(abs(z - lo) / (abs(lo) + 1e-6), 1) WHEN z > hi THEN least(abs(z - hi) / (abs(hi) + 1e-6), 1) ELSE least(abs(z - (lo + hi) / 2) / ((hi - lo) / 2), 1) END AS sev,
  CASE WHEN z < lo THEN 'down' WHEN z > hi THEN 'up' ELSE 'normal' END AS direction FROM b)"""


def scored(spark, d):
    return detect.scored(predicted(spark, d).withColumns({"lower_bound": F.lit(-3.0), "upper_bound": F.lit(3.0)}))


@query("z_score_severity", SCORED + " SELECT metric_name, timestamp, round(z, 4) AS z_score, round(sev, 4) AS severity FROM sc")
def _(spark, d):
    return scored(spark, d).select("metric_name", "timestamp", *r4("z_score", "severity"))


@query("segment", ROLL + """ SELECT metric_name, timestamp, CASE WHEN value >= coalesce(list_aggregate(s, 'quantile_cont', 0.7), m) THEN 'peak' WHEN value <= coalesce(list_aggregate(s, 'quantile_cont', 0.3), m) THEN 'valley' ELSE 'mid' END AS segment FROM roll""")
def _(spark, d):
    rolled = features.rolling_features(deduped(spark, d))
    return rolled.select("metric_name", "timestamp", ex.segment(F.col("value"), F.col("rolling_p70_7d"), F.col("rolling_p30_7d")).alias("segment"))


STREAK = SCORED + """, n AS (SELECT *, CASE WHEN lag(direction) OVER w IS DISTINCT FROM direction THEN 1 ELSE 0 END AS new FROM sc WINDOW w AS (PARTITION BY metric_name ORDER BY timestamp)),
run AS (SELECT *, sum(new) OVER (PARTITION BY metric_name ORDER BY timestamp) AS run FROM n),
st AS (SELECT *, CASE WHEN direction = 'normal' THEN 0 ELSE row_number() OVER (PARTITION BY metric_name, run ORDER BY timestamp) END AS streak FROM run)"""


@query("streaks", STREAK + " SELECT metric_name, timestamp, direction, streak, streak >= 3 AS global_abnormal FROM st")
def _(spark, d):
    return detect.streaks(scored(spark, d)).select("metric_name", "timestamp", "direction", F.col("streak").cast("long").alias("streak"), "global_abnormal")


CONF = SCORED + """, c AS (SELECT *, avg(abs(value)) OVER w AS size, avg(abs(value - predict_value)) OVER w AS err, stddev_pop(value) OVER w AS sd, count(*) OVER w AS n FROM sc
  WINDOW w AS (PARTITION BY metric_name ORDER BY timestamp ROWS BETWEEN 299 PRECEDING AND CURRENT ROW)),
cf AS (SELECT *, least(greatest(1 - err / greatest(size, 1), 0), 1) AS rel, least(greatest(1 - least(CASE WHEN n <= 1 OR size <= 1e-6 THEN 0 ELSE sd / size END, 1), 0), 1) AS vol FROM c)"""


@query("confidence", CONF + " SELECT metric_name, timestamp, round(rel, 4) AS reliability, round(vol, 4) AS volatility, round(0.25 * rel + 0.35 * sev + 0.20 * vol + 0.20, 4) AS confidence_score FROM cf")
def _(spark, d):
    graded = detect.confidence(scored(spark, d).withColumn("is_periodic", F.lit(False)))
    return graded.select("metric_name", "timestamp", F.round("confidence_components.metric_reliability", 4).alias("reliability"), F.round("confidence_components.volatility_level", 4).alias("volatility"), *r4("confidence_score"))


def _periodic_sql() -> str:
    frames, tests = [], []
    for p in (60, 300):
        tol = max(1, min(10, p // 10))
        for k in range(1, 5):
            frames.append(f"max(flag::INT) OVER (PARTITION BY metric_name ORDER BY timestamp ROWS BETWEEN {k * p + tol} PRECEDING AND {k * p - tol} PRECEDING) AS f{p}_{k}")
        there = [f"(i - {k * p} > 0)::INT" for k in range(1, 5)]
        hits = " + ".join(f"CASE WHEN i - {k * p} > 0 THEN coalesce(f{p}_{k}, 0) ELSE 0 END" for k in range(1, 5))
        seen = " + ".join(there)
        tests.append(f"({p} <= (i + 1) // 5 AND {seen} >= 3 AND ({hits}) / greatest({seen}, 1)::DOUBLE >= 0.6)")
    return f"""{PTS}, fl AS (SELECT metric_name, timestamp, value > 60 AS flag, row_number() OVER (PARTITION BY metric_name ORDER BY timestamp) - 1 AS j FROM ded),
w AS (SELECT *, least(j, 4000) AS i, {", ".join(frames)} FROM fl) SELECT metric_name, timestamp, flag AND i + 1 >= 10 AND ({" OR ".join(tests)}) AS is_periodic FROM w"""


@query("periodic_flags", _periodic_sql())
def _(spark, d):
    return detect.periodic(deduped(spark, d).withColumn("flag", F.col("value") > 60)).select("metric_name", "timestamp", "is_periodic")


KDE = ROLL + """, pr AS (SELECT metric_name, timestamp, greatest(coalesce(avg(value) OVER (PARTITION BY metric_name ORDER BY timestamp ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), value), 0) AS p FROM ded),
sg AS (SELECT metric_name, timestamp, (value - p) / greatest(sqrt(abs(p)), 1e-6) AS z, CASE WHEN p >= coalesce(list_aggregate(s, 'quantile_cont', 0.7), m) THEN 'peak' WHEN p <= coalesce(list_aggregate(s, 'quantile_cont', 0.3), m) THEN 'valley' ELSE 'mid' END AS segment
  FROM roll JOIN pr USING (metric_name, timestamp)),
zs AS (SELECT metric_name, segment, z FROM sg QUALIFY row_number() OVER (PARTITION BY metric_name, segment ORDER BY timestamp DESC) <= 5000),
st AS (SELECT metric_name, segment, count(*) AS n, quantile_cont(z, 0.025) AS ql, quantile_cont(z, 0.975) AS qh, greatest(1.06 * stddev_pop(z) * pow(count(*), -0.2), 0.1) AS h, min(z) AS lo, max(z) AS hi FROM zs GROUP BY ALL),
gr AS (SELECT st.*, i, lo - 3 * h + i * (hi - lo + 6 * h) / 511 AS g FROM st, range(512) AS r(i) WHERE n >= 20),
dn AS (SELECT metric_name, segment, i, g, sum(exp(-0.5 * pow((g - z) / h, 2))) AS d FROM gr JOIN zs USING (metric_name, segment) GROUP BY ALL),
sh AS (SELECT *, sum(d) OVER (PARTITION BY metric_name, segment ORDER BY i) / greatest(sum(d) OVER (PARTITION BY metric_name, segment), 1e-6) AS share FROM dn),
pt AS (SELECT *, lag(share) OVER w AS ps, lag(g) OVER w AS pg FROM sh WINDOW w AS (PARTITION BY metric_name, segment ORDER BY i)),
cut AS (SELECT metric_name, segment, arg_min(CASE WHEN ps IS NULL THEN g ELSE pg + (0.025 - ps) * (g - pg) / (share - ps) END, i) FILTER (WHERE share >= 0.025) AS kl, arg_min(CASE WHEN ps IS NULL THEN g ELSE pg + (0.975 - ps) * (g - pg) / (share - ps) END, i) FILTER (WHERE share >= 0.975) AS kh FROM pt GROUP BY ALL)"""


def _bounds(spark, d, of):
    """Bounds of each metric's segments by a density of the last scores."""
    rolled = features.rolling_features(scored(spark, d))
    segmented = rolled.withColumn("segment", ex.segment(F.col("predict_value"), F.col("rolling_p70_7d"), F.col("rolling_p30_7d")))
    last = features.recent(segmented, MAX_Z_HISTORY, ("metric_name", "segment"))
    found = last.groupBy("metric_name", "segment").agg(F.array_sort(F.collect_list("z_score")).alias("z")).select("metric_name", "segment", of("z").alias("k"))
    return found.select("metric_name", "segment", F.round("k.lower", 4).alias("lower"), F.round("k.upper", 4).alias("upper"))


KDE_TOLD = " SELECT metric_name, segment, round(CASE WHEN n < 20 THEN ql ELSE kl END, 4) AS lower, round(CASE WHEN n < 20 THEN qh ELSE kh END, 4) AS upper FROM st LEFT JOIN cut USING (metric_name, segment)"


@query("kde_bounds", KDE + KDE_TOLD)
def _(spark, d):
    return _bounds(spark, d, kde_of)


KDE_COVARIANCE = (
    KDE.replace("greatest(1.06 * stddev_pop(z) * pow(count(*), -0.2), 0.1) AS h", "stddev_samp(z) * pow(count(*), -0.2) AS h, stddev_pop(z) AS far")
    .replace("lo - 3 * h + i * (hi - lo + 6 * h) / 511 AS g FROM st, range(512)", "lo - 3 * far + i * (hi - lo + 6 * far) / 1023 AS g FROM st, range(1024)")
)


@query("kde_bounds_covariance", KDE_COVARIANCE + KDE_TOLD)
def _(spark, d):
    return _bounds(spark, d, covariance_kde_of)


@query("huber_forecast", _recursive(PTS) + """, past AS (SELECT metric_name || timestamp AS id, metric_name, timestamp, list(value) OVER (PARTITION BY metric_name ORDER BY timestamp ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS y FROM ded),
long_ AS (SELECT id, y FROM past WHERE len(y) >= 5), """ + _huber_sql("long_", 50) + " SELECT metric_name, timestamp, round(forecast, 4) AS forecast, round(deviation, 4) AS deviation FROM past JOIN hubl USING (id)")
def _(spark, d):
    past = deduped(spark, d).withColumn("past", F.collect_list("value").over(ex.last_rows(60, "metric_name"))).where(F.size("past") >= 5)
    return past.select("metric_name", "timestamp", huber_of("past").alias("f")).select("metric_name", "timestamp", F.round("f.forecast", 4).alias("forecast"), F.round("f.deviation", 4).alias("deviation"))


#: p is one minus the normal density's integral from -z to z, by Simpson's rule.
@query("mann_kendall_p", PTS + """, past AS (SELECT metric_name, timestamp, list(value) OVER (PARTITION BY metric_name ORDER BY timestamp ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AS x FROM ded),
k AS (SELECT *, len(x) AS n, list_sum(list_transform(range(1, len(x)), lambda i: list_sum(list_transform(range(i + 1, len(x) + 1), lambda j: sign(x[j] - x[i]))))) AS s FROM past WHERE len(x) >= 5),
z AS (SELECT *, abs(s - sign(s)) / sqrt(n * (n - 1) * (2 * n + 5) / 18) AS z FROM k),
p AS (SELECT z, 1 - 2 / sqrt(2 * pi()) * z / 600 * list_sum(list_transform(range(0, 201), lambda i: CASE WHEN i IN (0, 200) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5 * pow(z * i / 200, 2)))) AS p FROM (SELECT DISTINCT z FROM z))
SELECT metric_name, timestamp, round(p, 6) AS p FROM z JOIN p USING (z)""")  # fmt: skip
def _(spark, d):
    past = deduped(spark, d).withColumn("past", F.collect_list("value").over(ex.last_rows(15, "metric_name"))).where(F.size("past") >= 5)
    return past.select("metric_name", "timestamp", F.round(mann_kendall_p("past"), 6).alias("p"))


# Alerts

LEVEL = CONF.replace("FROM ded)", "FROM ded)", 1) + """, lv AS (SELECT cf.*, cf.core_link AS core, 0.25 * rel + 0.35 * sev + 0.20 * vol + 0.20 AS conf FROM cf),
al AS (SELECT *, CASE WHEN direction = 'normal' THEN NULL WHEN conf >= 0.6 AND core THEN 'P0' WHEN conf >= 0.4 AND core THEN 'P1' WHEN conf >= 0.6 THEN 'P1' WHEN conf >= 0.4 THEN 'P2' END AS level FROM lv)"""


def levelled(spark, d):
    graded = detect.confidence(scored(spark, d).withColumn("is_periodic", F.lit(False)))
    out = (F.col("z_score") < F.col("lower_bound")) | (F.col("z_score") > F.col("upper_bound"))
    flagged = graded.withColumns({"global_abnormal": out, "local_score": F.lit(0.0), "abnormal_labels": F.when(out, F.array(F.lit("global"))).otherwise(F.array().cast("array<string>")), "core_link": F.col("tags")["core_link"] == "true"})
    return alerts.with_level(flagged)


@query("alert_level", LEVEL + " SELECT metric_name, timestamp, level FROM al")
def _(spark, d):
    return levelled(spark, d).select("metric_name", "timestamp", "level")


@query("alert_message", LEVEL + """ SELECT metric_name, timestamp, printf('%s %s abnormal: current=%.4f, predict=%.4f, z=%.3f, confidence=%.3f, duration=%s', business_line, metric_name, value, predict_value, z, conf,
  CASE WHEN timestamp % 500 < 60 THEN (timestamp % 500)::VARCHAR || 's' ELSE (timestamp % 500 // 60)::VARCHAR || 'm' || (timestamp % 500 % 60)::VARCHAR || 's' END) AS message FROM al WHERE level IS NOT NULL""")  # fmt: skip
def _(spark, d):
    rows = levelled(spark, d).where("level is not null")
    text = ex.alert_message(F.col("business_line"), F.col("metric_name"), F.col("value"), F.col("predict_value"), F.col("z_score"), F.col("confidence_score"), F.col("timestamp") % 500)
    return rows.select("metric_name", "timestamp", text.alias("message"))


FSM = _recursive(LEVEL) + """, lv1 AS MATERIALIZED (SELECT metric_name, timestamp, level, core, row_number() OVER (PARTITION BY metric_name ORDER BY timestamp) AS n FROM al),
inc AS (
  SELECT metric_name, 0::BIGINT AS n, 0::BIGINT AS timestamp, NULL::BIGINT AS opened, 'P3' AS lvl, 0 AS normal, NULL::BIGINT AS emitted, NULL::VARCHAR AS status, NULL::VARCHAR AS alert_level, NULL::BIGINT AS duration_sec FROM (SELECT DISTINCT metric_name FROM lv1)
  UNION ALL SELECT metric_name, n, timestamp, CASE WHEN back THEN NULL ELSE o END, CASE WHEN back THEN 'P3' ELSE l END, CASE WHEN back THEN 0 ELSE nn END, CASE WHEN back THEN NULL WHEN told THEN timestamp ELSE emitted END,
    CASE WHEN back THEN 'recovered' WHEN told AND up THEN 'escalated' WHEN told THEN 'firing' END, CASE WHEN back OR told THEN l END, CASE WHEN back OR told THEN greatest(timestamp - o, 0) END
  FROM (SELECT *, level IS NULL AND nn >= 3 AS back, level IS NOT NULL AND (up OR emitted IS NULL OR timestamp - emitted >= 300) AS told FROM (
    SELECT lv1.metric_name, lv1.n, lv1.timestamp, lv1.level, inc.emitted, CASE WHEN level IS NOT NULL THEN 0 WHEN opened IS NULL THEN normal ELSE normal + 1 END AS nn, CASE WHEN level IS NOT NULL THEN coalesce(opened, lv1.timestamp) ELSE opened END AS o,
      coalesce(opened IS NOT NULL AND level IS NOT NULL AND (level < lvl OR (lvl = 'P1' AND core AND lv1.timestamp - opened >= 600)), false) AS up,
      CASE WHEN level IS NULL THEN lvl WHEN opened IS NULL THEN level WHEN level < lvl THEN level WHEN lvl = 'P1' AND core AND lv1.timestamp - opened >= 600 THEN 'P0' ELSE lvl END AS l
    FROM inc JOIN lv1 ON lv1.metric_name = inc.metric_name AND lv1.n = inc.n + 1)))"""


@query("incident_fsm", FSM + " SELECT metric_name, timestamp, status, alert_level, duration_sec FROM inc WHERE status IS NOT NULL")
def _(spark, d):
    told = alerts.incidents(levelled(spark, d))
    return told.select("metric_name", "timestamp", "status", "alert_level", "duration_sec")


# History


@query("recent_points", PTS + " SELECT metric_name, timestamp, value FROM ded QUALIFY row_number() OVER (PARTITION BY metric_name ORDER BY timestamp DESC) <= 120")
def _(spark, d):
    return features.recent(deduped(spark, d), 120, ("metric_name",)).select("metric_name", "timestamp", "value")


@query("recent_since", PTS + " SELECT metric_name, timestamp, value FROM ded WHERE timestamp >= 1706000000 QUALIFY row_number() OVER (PARTITION BY metric_name ORDER BY timestamp DESC) <= 50")
def _(spark, d):
    return features.recent(deduped(spark, d), 50, ("metric_name",), since=1706000000).select("metric_name", "timestamp", "value")


@query("prune_old", PTS + " SELECT metric_name, count(*) AS n, min(timestamp) AS first FROM ded WHERE timestamp >= 1705000000 GROUP BY metric_name")
def _(spark, d):
    return history.prune(deduped(spark, d), 1705000000).groupBy("metric_name").agg(F.count("*").alias("n"), F.min("timestamp").alias("first"))


@query("drop_metric", PTS + " SELECT metric_name, count(*) AS n FROM ded WHERE metric_name <> 'events.view' GROUP BY metric_name")
def _(spark, d):
    return history.drop_metric(deduped(spark, d), "events.view").groupBy("metric_name").agg(F.count("*").alias("n"))


@query("latest_upsert", PTS + " SELECT metric_name, timestamp, value FROM pts QUALIFY row_number() OVER (PARTITION BY metric_name, timestamp ORDER BY ingest_seq DESC) = 1")
def _(spark, d):
    return history.latest(points(spark, d), ("metric_name", "timestamp")).select("metric_name", "timestamp", "value")


@query("aligned_history", CAL + """ SELECT metric_name, timestamp, CASE WHEN count(value) OVER slot > 0 THEN count(value) OVER slot ELSE count(value) OVER sec END AS n, round(coalesce(sum(value) OVER slot, sum(value) OVER sec, 0), 4) AS total FROM cal
WINDOW slot AS (PARTITION BY metric_name, weekday, hour, minute, second, "isHoliday" ORDER BY timestamp ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING), sec AS (PARTITION BY metric_name, second ORDER BY timestamp ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)""")  # fmt: skip
def _(spark, d):
    cal = calendared(spark, d).select("metric_name", "timestamp", "value", "weekday", "hour", "minute", "second", "isHoliday")
    got = history.aligned_history(cal, cal.drop("value"))
    return got.select("metric_name", "timestamp", F.size("aligned_values").cast("long").alias("n"), F.round(F.aggregate("aligned_values", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


# Sources and whole plans


@query("demo_generator", """WITH i AS (SELECT range AS i FROM range(1800)) SELECT 'payment.success_rate' AS metric_name, 1711180800 + i AS timestamp, round(greatest(0.962 + 0.008 * sin(i / 45.0) + 0.002 * sin(i / 7.0) - CASE WHEN i BETWEEN 720 AND 779 THEN 0.14 ELSE 0 END, 0), 4) AS value FROM i
UNION ALL SELECT 'payment.long_tail_count', 1711180800 + i, round(CASE WHEN i >= 1200 THEN 0 ELSE 40 + 4 * sin(i / 30.0) END, 4) FROM i""")  # fmt: skip
def _(spark, d):
    return demo_points(spark).select("metric_name", "timestamp", *r4("value"))


@query("demo_replay")
def _(spark, d):
    return replay(demo_points(spark), demo_registry(spark)).alerts


@query("full_replay")
def full_replay(spark, d):
    return replay(points(spark, d)).alerts


@query("replay_anomalies")
def _(spark, d):
    return replay(points(spark, d)).judged.where("global_abnormal or local_score > 0").drop("confidence_components", "ingest_seq")


@query("console_lines")
def _(spark, d):
    return alerts.console_lines(replay(points(spark, d)).alerts)


# Stored history, model versions, lines of text


@query("stored_history", PTS + """, late AS (SELECT * FROM pts WHERE ingest_seq % 3 = 0), kept AS (
  SELECT metric_name, timestamp, value, 1 AS b, ingest_seq FROM late UNION ALL SELECT metric_name, timestamp, value / 2, 0, ingest_seq FROM pts),
one AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY metric_name, timestamp, b ORDER BY ingest_seq DESC) = 1),
newest AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY metric_name, timestamp ORDER BY b DESC) = 1)
SELECT metric_name, timestamp, round(value + 0.0000137, 4) AS value FROM newest WHERE timestamp >= (SELECT max(timestamp) - 1209600 FROM pts)""")
def _(spark, d):
    """Two batches of points in a store, the second of which corrects a third of the first, a retried one, and two weeks' retention."""
    store = history.HistoryStore(spark, f"{ensure_checkpoint_dir(spark)}/history-{uuid.uuid4().hex}")
    late = ingest.deduplicate(points(spark, d).where(F.col("ingest_seq") % 3 == 0))
    store.append("raw_points", deduped(spark, d).withColumn("value", F.col("value") / 2), 0)
    for _ in range(2):
        store.append("raw_points", late, 1)
    store.retain(store.newest("raw_points") - 1209600, 1)
    return store.read("raw_points").select("metric_name", "timestamp", *s4("value"))


@query("recent_rows", PTS + """, r AS (SELECT * FROM ded WHERE metric_name = 'events.view' ORDER BY timestamp DESC LIMIT 500)
SELECT metric_name, timestamp, round(value + 0.0000137, 4) AS value FROM r""")
def _(spark, d):
    """The last points of one metric, as a restarted process asks for them."""
    store = history.HistoryStore(spark, f"{ensure_checkpoint_dir(spark)}/history-{uuid.uuid4().hex}")
    store.append("raw_points", deduped(spark, d), 0)
    return store.recent("raw_points", "events.view", limit=500).select("metric_name", "timestamp", *s4("value"))


@query("model_versions", PTS + """, m AS (SELECT metric_name, round(avg(value) + 0.0000137, 4) AS level, round(stddev_pop(value) + 0.0000137, 4) AS spread FROM ded GROUP BY metric_name)
SELECT metric_name, CASE WHEN metric_name = 'events.view' THEN 'w_20' ELSE 'w_10' END AS version, CASE WHEN metric_name = 'events.view' THEN 20 ELSE 30 END::BIGINT AS published,
  CASE WHEN metric_name = 'events.view' THEN 2 * level ELSE level END AS level, spread FROM m""")
def _(spark, d):
    """Two published versions of every metric's level and spread, and a rollback to the first of all but one metric."""
    known = deduped(spark, d).groupBy("metric_name").agg(F.avg("value").alias("level"), F.stddev_pop("value").alias("spread")).select("metric_name", *s4("level", "spread"))
    params = lambda times: known.select("metric_name", F.create_map(F.lit("level"), times * F.col("level"), F.lit("spread"), F.col("spread")).alias("params"))
    versions = models.publish(params(1), "w", 10).unionByName(models.publish(params(2), "w", 20))
    rolled = models.rollback(versions.where("metric_name <> 'events.view'"), "w_10", 30).unionByName(versions.where("metric_name = 'events.view'"))
    return models.active(rolled).select("metric_name", "version", "published", F.col("params")["level"].alias("level"), F.col("params")["spread"].alias("spread"))


@query("lenient_lines", PTS + """ SELECT coalesce(metric_name, 'rejected') AS metric_name, count(*) AS n, round(coalesce(sum(value), 0), 2) AS total FROM (
  SELECT CASE WHEN ingest_seq % 7 <> 0 THEN metric_name END AS metric_name, CASE WHEN ingest_seq % 7 <> 0 THEN value END AS value FROM pts) GROUP BY ALL""")
def _(spark, d):
    """The points as JSON lines, each seventh of which is broken off, read leniently."""
    folder = f"{ensure_checkpoint_dir(spark)}/lines-{uuid.uuid4().hex}"
    line = F.to_json(F.struct(*POINT.names))
    points(spark, d).select(F.when(F.col("ingest_seq") % 7 == 0, F.substring_index(line, ",", 2)).otherwise(line).alias("value")).write.text(folder)
    good, rejected = read_jsonl_lenient(spark, folder)
    both = good.select("metric_name", "value").unionByName(rejected.select(F.lit("rejected").alias("metric_name"), F.lit(0.0).alias("value")))
    return both.groupBy("metric_name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("alert_texts", PTS + """, l AS (SELECT *, value > 80 AS g, list_filter(['boxplot', CASE WHEN value > 90 THEN 'trend' END], lambda x: x IS NOT NULL AND (x <> 'boxplot' OR value > 70)) AS ls FROM ded),
w AS (SELECT *, CASE WHEN g THEN list_concat(['global'], ls) ELSE ls END AS labels FROM l)
SELECT metric_name, timestamp, CASE WHEN len(labels) > 0 THEN array_to_string(labels, '+') ELSE 'global' END AS alert_type,
  business_line || ' ' || metric_name || ' abnormal: duration=' || CASE WHEN timestamp % 7200 < 60 THEN (timestamp % 7200) || 's' ELSE ((timestamp % 7200) // 60) || 'm' || (timestamp % 60) || 's' END AS message FROM w""")
def _(spark, d):
    """Types and messages of alerts for judged points."""
    labels = F.array_compact(F.array(F.when(F.col("value") > 70, "boxplot"), F.when(F.col("value") > 90, "trend")))
    rows = deduped(spark, d).withColumns({
        "global_abnormal": F.col("value") > 80, "local_labels": labels, "local_score": F.size(labels) / 4, "predict_value": F.lit(50.0), "lower_bound": F.lit(-3.0), "upper_bound": F.lit(3.0),
        "confidence_score": F.lit(0.5), "status": F.lit("firing"), "alert_level": F.lit("P1"), "duration_sec": F.col("timestamp") % 7200, "granularity": F.lit("1s"),
    })
    told = alerts.alert_rows(detect.graded(rows))
    return told.select("metric_name", "timestamp", "alert_type", F.regexp_replace("message", "current=.*, duration", "duration").alias("message"))
