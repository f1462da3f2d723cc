"""Monitoring as one streaming query: four keyed operators, with column expressions between them.

    points -> Repair -> calendar, route -> Series -> local detectors -> Judge -> zero rule, confidence, level -> Incidents

``Repair`` fills gaps and clips jumps, ``Series`` keeps seasonal baselines and open buckets, ``Judge`` predicts,
learns bounds and looks for periods, ``Incidents`` opens and closes incidents. What an operator remembers of a metric is
typed state that Spark keeps, checkpoints and moves: tails, trimmed to what the settings ask for, and a few numbers. A
micro-batch reads states of its own metrics and no stored history, so its time doesn't grow with the days behind it.

Idle metrics are forgotten. Each operator has one event-time timer a metric, ``state_ttl_sec`` after its newest
point; when it runs and newer points have come, it is set anew, else every state of the metric goes, open buckets
unsaid. A point that comes later than that finds nothing either, timer or no timer.

Order. Within a micro-batch a metric's points are taken by time, and of those with one time the last: by ``ingest_seq``
where the stream has it, else as they come. A micro-batch's rows of a metric are held in memory, so the source must pace
them (``paced_stream`` does for a table). Across batches:
a point more than LATENESS behind the newest that the stream had two batches ago is dropped by the watermark and counted
in the query's progress. One within it is taken when it comes: it is clipped and judged like any other, no gap is filled before it,
and the next gap is still measured from the newest point. In buckets, another bucket, an older one too, closes the
open one.

Commands are rows of the same stream without a value: ``flush`` closes a metric's open buckets, under the mode that the
metric has now; ``eligible`` and ``ineligible`` are results of assessments, which need weeks of history and are made
once a day or week by a batch over it (``assess_due``). Without one, a metric that isn't forced is not eligible.

Start. ``snapshot`` reads the states of a stopped query from its checkpoint into Parquet tables, a row for each value or
entry of a map, and ``Engine(primed=...)`` gives them to a new query as its initial states.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidewatch.functions.exprs import feature_factor, local_time
from tidewatch.operators import ingest, routing
from tidewatch.operators.alerts import Incident, advance, alert_rows, with_level
from tidewatch.operators.detect import confidence_of, detector_rows, detectors_of, graded, is_periodic
from tidewatch.operators.features import Tail
from tidewatch.operators.history import HistoryStore
from tidewatch.operators.zero_rule import rule_columns
from tidewatch.plans.prediction import ADDED, NAMES, Bounds, State, predict_row, with_rolling
from tidewatch.schemas import ANOMALY, POINT
from tidewatch.settings import ALIGNED_LIMIT, DEFAULTS, RECENT_LIMIT, SAME_SECOND_LIMIT, Settings

#: How long points may be late: the reordering that the monitored sources are known to do.
LATENESS = "5 seconds"
CONFIDENCE_ROWS = 300

FACTS = "registry_line string, registry_priority string, core_link boolean, force_ai boolean, eligible boolean"
CONTEXT = "isHoliday boolean, isHotSpot boolean, isRCA boolean, weekday int, hour int, minute int, second int"
REPAIRED = "metric_name string, timestamp long, value double, business_line string, tags map<string,string>, priority string, metric_type string, granularity string, trusted boolean, is_interpolated boolean, " + FACTS + ", command string, event_time timestamp"
SERIES = "metric_name string, timestamp long, value double, granularity string, mode string, base_value double, bucket long, bucket_size long, registry_line string, core_link boolean, past array<double>, event_time timestamp, " + CONTEXT
PERIODIC = "is_periodic boolean, mean_size double, mean_error double, variation double"
ALERTED = "status string, alert_level string, duration_sec long"


def _names(ddl: str) -> list[str]:
    return T.StructType.fromDDL(ddl).names


class Keyed(StatefulProcessor):
    """Rows of one metric in order of time, and states that go together once the metric is idle."""

    #: Kinds and schemas of the operator's states: ("value", value) or ("map", key, value).
    STATES: dict[str, tuple[str, ...]] = {}

    def __init__(self, settings: Settings, out: list[str]):
        self.settings, self.out = settings, out
        self.types = {name: [T.StructType.fromDDL(x) for x in schemas] for name, (_, *schemas) in self.all_states().items()}
        self.maps = {name for name, types in self.types.items() if len(types) == 2}

    @classmethod
    def all_states(cls) -> dict[str, tuple[str, ...]]:
        return {"seen": ("value", "at long"), **cls.STATES}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        make = {"value": handle.getValueState, "map": handle.getMapState}
        self.held = {name: make[kind](name, *schemas) for name, (kind, *schemas) in self.all_states().items()}

    def step(self, metric: str, rows: pd.DataFrame) -> list[tuple]:
        raise NotImplementedError

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows))
        got = got.sort_values([c for c in ("timestamp", "ingest_seq") if c in got], kind="stable")
        seen, newest = self.get("seen"), int(got["timestamp"].max())
        if seen and int(got["timestamp"].min()) - seen[0] >= self.settings.state_ttl_sec:
            self.forget()
        out = self.step(key[0], got)
        if not seen:
            self.handle.registerTimer((newest + self.settings.state_ttl_sec) * 1000)
        self.put("seen", (max(newest, seen[0]) if seen else newest,))
        yield pd.DataFrame(out, columns=self.out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        seen = self.get("seen")
        due = (seen[0] + self.settings.state_ttl_sec) * 1000 if seen else 0
        if due > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(due)
        else:
            self.forget()
        return iter([])

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        for row in initialState.to_dict("records"):
            name = row["state"]
            if name in self.maps:
                self.held[name].updateValue(*(_tuple(x, t) for x, t in zip(row[name].values(), self.types[name], strict=True)))
            else:
                self.put(name, _tuple(row[name], self.types[name][0]))
            if name == "seen":
                self.handle.registerTimer((self.get(name)[0] + self.settings.state_ttl_sec) * 1000)

    def forget(self) -> None:
        for state in self.held.values():
            state.clear()

    def get(self, name: str) -> tuple | None:
        return self.held[name].get() if self.held[name].exists() else None

    def put(self, name: str, value: tuple) -> None:
        self.held[name].update(value)

    def close(self) -> None:
        pass


def _tuple(struct: dict, kind: T.StructType) -> tuple:
    """A struct as pandas gives it, where a whole number beside a null has become a float, as the tuple that a state takes."""

    def typed(v: Any, of: T.DataType) -> Any:
        if isinstance(of, T.ArrayType):
            return [typed(x, of.elementType) for x in v]
        if v is None or v != v:
            return None
        return int(v) if isinstance(of, T.IntegralType) else bool(v) if isinstance(of, T.BooleanType) else v

    return tuple(typed(struct[f.name], f.dataType) for f in kind.fields)


def _list(x: Any) -> list:
    return [] if x is None else list(x)


class Repair(Keyed):
    """Points with the facts of their metric, gaps of a few seconds filled, and jumps clipped; commands pass."""

    STATES = {"last": ("value", "timestamp long, value double, business_line string, tags map<string,string>, priority string, metric_type string, granularity string"), "sizes": ("value", "size array<double>"), "facts": ("value", FACTS)}

    def step(self, metric: str, rows: pd.DataFrame) -> list[tuple]:
        s, out, last, facts = self.settings, [], self.get("last"), self.get("facts")
        held, tail = self.get("sizes"), ingest.Tail(s.jump_clip_history_window)
        for x in _list(held[0]) if held else []:
            tail.add(x)
        points = rows["command"].isna()
        rows = pd.concat([rows[points].drop_duplicates("timestamp", keep="last"), rows[~points]]).sort_values("timestamp", kind="stable")

        def put(t: int, value: float, of: tuple, trusted: bool, filled: bool, when: Any) -> tuple:
            new = tail.clip(value, s)
            line, tags, priority, kind, granularity = of
            if abs(new - value) > ingest.EPS:
                tags = dict(tags) | {"repaired_jump": "true", "raw_value": str(value)}
            else:
                new = value
            out.append((metric, t, new, line, dict(tags), priority, kind, granularity, trusted, filled, *facts, None, when))
            return t, new, line, dict(tags), priority, kind, granularity

        for r in rows.itertuples(index=False):
            t, command = int(r.timestamp), r.command if isinstance(r.command, str) else None
            if isinstance(r.registry_priority, str):  # what the registry says counts at once
                facts = (r.registry_line, r.registry_priority, bool(r.core_link), bool(r.force_ai), facts[4] if facts else False)
            if command is not None:
                if facts:
                    facts = (*facts[:4], {"eligible": True, "ineligible": False}.get(command, facts[4]))
                    out.append((metric, t, None, None, None, None, None, None, None, None, *facts, command, r.event_time))
                continue
            tags = dict(r.tags) if r.tags is not None else {}
            if not facts:
                flag = lambda k, d: str(tags[k]).lower() in ("true", "1") if k in tags else d
                facts = (r.business_line, r.priority, flag("core_link", True), flag("force_ai", False), False)
            gap, trusted = t - last[0] - 1 if last else 0, bool(r.trusted)
            if gap > s.max_missing_fill:
                trusted, tags = False, tags | {"missing_gap": str(gap)}
            elif gap > 0:
                begin, step = last, (r.value - last[1]) / (gap + 1)
                for k in range(1, gap + 1):
                    value = 0.0 if r.metric_type in ("count", "qps") else begin[1] + step * k
                    put(begin[0] + k, value, begin[2:], True, True, r.event_time)
            now = put(t, r.value, (r.business_line, tags, r.priority, r.metric_type, r.granularity), trusted, bool(r.is_interpolated), r.event_time)
            if last is None or t >= last[0]:
                last = now
        if last:
            self.put("last", last)
        if facts:
            self.put("facts", facts)
        self.put("sizes", (list(tail.values),))
        return out


class Series(Keyed):
    """Seconds with their seasonal baseline, and closed buckets, each with the last values of its series before it."""

    STATES = {
        "slots": ("map", "weekday int, hour int, minute int, holiday boolean", "second array<int>, value array<double>"),
        "seconds": ("map", "second int", "value array<double>"),
        "recent": ("value", "value array<double>"),
        "open": ("map", "granularity_sec int", "bucket long, n long, total double, metric_type string, parts array<double>, last double, timestamp long, " + CONTEXT),
        "tails": ("map", "granularity string", "value array<double>"),
    }

    def step(self, metric: str, rows: pd.DataFrame) -> list[tuple]:
        out, keep = [], detector_rows(self.settings)
        held = self.get("recent")
        recent = deque(_list(held[0]) if held else [], RECENT_LIMIT)
        loaded: dict[str, dict] = {name: {} for name in ("slots", "seconds", "open", "tails")}

        def load(name: str, key: tuple) -> list | None:
            """An entry of a map as lists, which are written back at the end."""
            if key not in loaded[name]:
                got = self.held[name].getValue(key) if self.held[name].containsKey(key) else None
                loaded[name][key] = None if got is None else [_list(x) if isinstance(x, (list, tuple, np.ndarray)) else x for x in got]
            return loaded[name][key]

        def base(slot: tuple, second: int, value: float) -> float:
            own, same = load("slots", slot), load("seconds", (second,))
            values = [v for s, v in zip(*own, strict=True) if s == second] if own else []
            if values or (same and same[0]):
                return float(np.median(values or same[0]))
            return sum(recent) / len(recent) if recent else value

        def remember(slot: tuple, second: int, value: float) -> None:
            own, same = load("slots", slot) or [[], []], load("seconds", (second,)) or [[]]
            own[0].append(second)
            own[1].append(value)
            if own[0].count(second) > ALIGNED_LIMIT:
                first = own[0].index(second)
                del own[0][first], own[1][first]
            same[0] = [*same[0], value][-SAME_SECOND_LIMIT:]
            loaded["slots"][slot], loaded["seconds"][(second,)] = own, same
            recent.append(value)

        def emit(t: int, value: float, label: str, mode: str, base_value: float, bucket: int | None, size: int | None, context: tuple, r: Any) -> None:
            tail = load("tails", (label,)) or [[]]
            out.append((metric, t, value, label, mode, base_value, bucket, size, r.registry_line, bool(r.core_link), list(tail[0]), r.event_time, *context))
            loaded["tails"][(label,)] = [[*tail[0], value][-keep:]]

        def close(seconds: int, r: Any, mode: str, label: str) -> None:
            bucket, n, total, kind, parts, last, t, *context = load("open", (seconds,))
            value = total if kind in ("count", "qps") else total / n if kind in ("rate", "ratio") else float(np.quantile(parts, 0.95)) if kind == "latency" else last
            holiday, _, _, weekday, hour, minute, second = context
            emit(t, value, label, mode, base((weekday, hour, minute, holiday), second, value) if mode == "ai" else value, bucket, n, tuple(context), r)

        for r in rows.itertuples(index=False):
            if isinstance(r.command, str):
                if r.command == "flush":
                    for key in [*self.held["open"].keys()] + list(loaded["open"]):
                        if load("open", tuple(key)) is not None:
                            close(key[0], r, r.mode, r.label)
                            loaded["open"][tuple(key)] = None
                continue
            context = (bool(r.isHoliday), bool(r.isHotSpot), bool(r.isRCA), int(r.weekday), int(r.hour), int(r.minute), int(r.second))
            slot, t, seconds = (context[3], context[4], context[5], context[0]), int(r.timestamp), int(r.granularity_sec)
            if r.mode == "ai":
                emit(t, r.value, r.label, "ai", base(slot, context[6], r.value), None, None, context, r)
            else:
                bucket, now = t - t % seconds, load("open", (seconds,))
                if now is not None and now[0] != bucket:
                    close(seconds, r, r.mode, r.label)
                    now = None
                now = now or [bucket, 0, 0.0, r.metric_type, [], 0.0, t]
                parts = [*now[4], r.value] if now[3] == "latency" else []
                loaded["open"][(seconds,)] = [bucket, now[1] + 1, now[2] + r.value, now[3], parts, r.value, t, *context]
            remember(slot, context[6], r.value)
        for name, entries in loaded.items():
            for key, value in entries.items():
                if value is not None:
                    self.held[name].updateValue(key, tuple(value))
                elif self.held[name].containsKey(key):
                    self.held[name].removeKey(key)
        self.put("recent", (list(recent),))
        return out


class Judge(Keyed):
    """Predictions, learned bounds and periodicity; what the zero rule judges passes."""

    STATES = {
        "model": ("value", "correction double, second_sd double, minute_sd double, up int, down int"),
        "bounds": ("map", "segment string", "z array<double>, low double, high double, dirty int, at long"),
        "rolling": ("map", "granularity string", "timestamp array<long>, value array<double>"),
        "judged": ("map", "granularity string", "actual array<double>, predicted array<double>, flag array<boolean>"),
    }

    def step(self, metric: str, rows: pd.DataFrame) -> list[tuple]:
        s, out = self.settings, []
        state = State(*self.get("model") or ())
        for name in state.bounds:
            if self.held["bounds"].containsKey((name,)):
                z, low, high, dirty, at = self.held["bounds"].getValue((name,))
                state.bounds[name] = Bounds(_list(z), None if low is None else (low, high), dirty, at)
        past: dict[str, deque] = {}
        passed = [None] * (len(NAMES) + 4)
        for label in rows.loc[rows["mode"] != "zero_rule", "granularity"].unique():
            most, limit = (s.second_history_window, s.anomaly_window) if label == "1s" else (s.minute_history_window,) * 2
            old = self.held["judged"].getValue((label,)) if self.held["judged"].containsKey((label,)) else ([], [], [])
            past[label] = deque(zip(*old, strict=True), max(limit, most, CONFIDENCE_ROWS))
            tail = self.held["rolling"].getValue((label,)) if self.held["rolling"].containsKey((label,)) else ((), ())
            state.series[label] = (Tail.of(label, s, *tail), deque(list(past[label])[-RECENT_LIMIT:], RECENT_LIMIT))
        modelled = rows[rows["mode"] != "zero_rule"]
        known = iter(modelled.assign(**with_rolling(state, modelled, s)).itertuples(index=False))
        for r in rows.itertuples(index=False):
            if r.mode == "zero_rule":
                out.append((*r, *passed))
                continue
            label, tail = r.granularity, state.series[r.granularity][1]
            found = predict_row(state, next(known), s)
            flag = tail[-1][2]
            own = past[label]
            periodic = flag and is_periodic([x[0] for x in own], [x[2] for x in own], r.value, label, s)
            own.append(tail[-1])
            last = np.array([x[:2] for x in list(own)[-CONFIDENCE_ROWS:]])
            size = float(np.abs(last[:, 0]).mean())
            error = float(np.abs(last[:, 0] - last[:, 1]).mean())
            variation = float(last[:, 0].std()) / size if len(last) > 1 and size > ingest.EPS else 0.0
            out.append((*r, *found, bool(periodic), size, error, variation))
        if past:
            self.put("model", (state.correction, state.second_sd, state.minute_sd, state.up, state.down))
        for name, b in state.bounds.items():
            if past and (b.z or b.now):
                self.held["bounds"].updateValue((name,), (b.z, *(b.now or (None, None)), b.dirty, b.at))
        for label, own in past.items():
            tail = state.series[label][0]
            self.held["rolling"].updateValue((label,), (tail.times.tolist(), tail.values.tolist()))
            self.held["judged"].updateValue((label,), tuple(map(list, zip(*own, strict=True))))
        return out


class Incidents(Keyed):
    """Rows with status, alert_level and duration_sec where their incident has something to tell, else null."""

    STATES = {"incident": ("value", "opened long, level string, normal int, emitted long")}

    def step(self, metric: str, rows: pd.DataFrame) -> list[tuple]:
        incident, out = Incident(*self.get("incident") or ()), []
        for r in rows.itertuples(index=False):
            level = r.level if isinstance(r.level, str) else None
            got = advance(incident, int(r.timestamp), level, bool(r.core_link), self.settings)
            out.append((*r, *(got or (None, None, None))))
        self.put("incident", (incident.opened, incident.level, incident.normal, incident.emitted))
        return out


def keyed(df: DataFrame, kind: type[Keyed], out: str, settings: Settings, primed: DataFrame | None = None) -> DataFrame:
    """df through a keyed operator of its metrics; primed: initial states, of which a row has one."""
    given = {"initialState": primed.groupBy("metric_name")} if primed is not None else {}
    return df.groupBy("metric_name").transformWithStateInPandas(kind(settings, _names(out)), out, "Append", "EventTime", eventTimeColumnName="event_time", **given)


OPERATORS = (Repair, Series, Judge, Incidents)
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Keyed operators need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def states_of(spark: SparkSession, checkpoint: str, kind: type[Keyed], batch: int | None = None) -> dict[str, DataFrame]:
    """metric_name and value (for maps: key and value) of each state of an operator, after a batch or the last one."""
    meta = spark.read.format("state-metadata").load(checkpoint).select("operatorId", "operatorProperties").distinct().collect()  # a row an operator
    has = lambda r: {v["stateName"] for v in json.loads(r["operatorProperties"])["stateVariables"]} >= set(kind.STATES)
    number = next(r["operatorId"] for r in meta if has(r))
    read = spark.read.format("statestore").option("operatorId", number)
    read = read if batch is None else read.option("batchId", batch)
    out = {}
    for name, (shape, *_) in kind.all_states().items():
        rows = read.option("stateVarName", name).load(checkpoint)
        entry = F.struct(F.col("user_map_key").alias("key"), F.col("user_map_value").alias("value")) if shape == "map" else F.col("value")
        out[name] = rows.select("key.metric_name", entry.alias(name))
    return out


def snapshot(spark: SparkSession, checkpoint: str, folder: str) -> None:
    """Write the states of a stopped query to Parquet tables, one an operator, for Engine(primed=folder)."""
    for kind in OPERATORS:
        rows = None
        for name, df in states_of(spark, checkpoint, kind).items():
            df = df.withColumn("state", F.lit(name))
            rows = df if rows is None else rows.unionByName(df, allowMissingColumns=True)
        rows.write.mode("overwrite").parquet(f"{folder}/{kind.__name__.lower()}")


def schema_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


class Engine:
    """The whole monitoring of a stream of points (POINT and event_time, and ``command`` where there are commands).

    registry, calendar and rca are tables beside the stream; a metric that the registry lacks is described by
    its first point. primed: folder of a ``snapshot``.
    """

    def __init__(self, registry: DataFrame, calendar: DataFrame, rca: DataFrame, settings: Settings = DEFAULTS, primed: str | None = None):
        self.registry, self.calendar, self.rca, self.settings, self.primed = registry, calendar, rca, settings, primed

    def _keyed(self, df: DataFrame, kind: type[Keyed], out: str) -> DataFrame:
        states = df.sparkSession.read.parquet(f"{self.primed}/{kind.__name__.lower()}") if self.primed else None
        return keyed(df, kind, out, self.settings, states)

    def repaired(self, points: DataFrame) -> DataFrame:
        facts = self.registry.select("metric_name", F.col("business_line").alias("registry_line"), F.col("priority").alias("registry_priority"), "core_link", "force_ai")
        command = F.col("command") if "command" in points.columns else F.lit(None).cast("string")
        sound = ingest.validate(points.withColumn("command", command), F.col("command").isNull())
        seq = [F.coalesce("ingest_seq", F.lit(2**63 - 1)).alias("ingest_seq")] if "ingest_seq" in points.columns else []
        late = sound.withWatermark("event_time", LATENESS).select(*POINT.names, "event_time", "command", *seq)
        return self._keyed(late.join(F.broadcast(facts), "metric_name", "left"), Repair, REPAIRED)

    def series(self, repaired: DataFrame) -> DataFrame:
        named = repaired.withColumn("priority", F.col("registry_priority"))
        return self._keyed(routing.route(self._dated(named), self.settings).drop("tags"), Series, SERIES)

    def _dated(self, df: DataFrame) -> DataFrame:
        """Calendar fields of each row; days and known causes are gathered by date and by metric."""
        local = local_time(F.col("timestamp"), self.settings.timezone)
        days = self.calendar.groupBy(F.col("date").alias("_date")).agg(F.bool_or("is_holiday").alias("isHoliday"), F.bool_or("is_hotspot").alias("isHotSpot"))
        spans = self.rca.groupBy("metric_name").agg(F.collect_list(F.struct("start_ts", "end_ts")).alias("_spans"))
        inside = F.exists("_spans", lambda s: F.col("timestamp").between(s["start_ts"], s["end_ts"]))
        dated = df.withColumns({"_date": F.to_date(local), "weekday": F.weekday(local), "hour": F.hour(local), "minute": F.minute(local), "second": F.second(local)})
        met = dated.join(F.broadcast(days), "_date", "left").join(F.broadcast(spans), "metric_name", "left").withColumn("isRCA", inside)
        return met.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("isHoliday", "isHotSpot", "isRCA")}).drop("_date", "_spans")

    def judged(self, series: DataFrame) -> DataFrame:
        s = self.settings
        factor = feature_factor(F.col("isHoliday"), F.col("isHotSpot"), F.col("isRCA"), F.col("registry_line"))
        local = detectors_of(series.withColumn("_past", F.col("past")), s).withColumn("factor", F.when(F.col("mode") == "ai", factor).otherwise(1.0))
        found = self._keyed(local, Judge, f"{schema_of(local)}, {ADDED}, {PERIODIC}")
        six = F.slice("past", -F.least(F.size("past"), F.lit(6)), 6)
        mean = F.when(F.size("past") > 0, F.aggregate(six, F.lit(0.0), lambda a, v: a + v) / F.size(six))
        whole = confidence_of(graded(found).withColumns({"_size": F.col("mean_size"), "_error": F.col("mean_error"), "_cv": F.col("variation")}))
        whole = whole.withColumn("model_version", F.when(F.col("mode") == "ai", "sec_v1").otherwise("min_v1")).drop("mean_size", "mean_error", "variation")
        rule = {c: F.when(F.col("mode") == "zero_rule", v).otherwise(F.col(c)) for c, v in rule_columns(mean, s).items()}
        bounds = {"predict_lower": F.when(F.col("mode") == "zero_rule", 0.0).otherwise(F.col("predict_lower")), "predict_upper": F.when(F.col("mode") == "zero_rule", rule_columns(mean, s)["predict_value"]).otherwise(F.col("predict_upper"))}
        return whole.withColumns(rule | bounds)

    def told(self, judged: DataFrame) -> DataFrame:
        """Judged rows, with what their incidents tell."""
        levelled = with_level(judged, self.settings).drop("past")
        return self._keyed(levelled, Incidents, f"{schema_of(levelled)}, {ALERTED}")

    def whole(self, points: DataFrame) -> DataFrame:
        """All judged rows of a stream, with what their incidents tell."""
        return self.told(self.judged(self.series(self.repaired(points))))

    def alerts(self, points: DataFrame) -> DataFrame:
        return _alerts(self.whole(points))

    def start(self, points: DataFrame, checkpoint: str, store: HistoryStore, tell: Callable[[DataFrame, int], None], available_now: bool = True) -> StreamingQuery:
        """Run the stream: series points, predictions and anomalies go to the store, tell(alerts, batch) gets each batch's alerts. A batch that is run again replaces what it wrote."""

        def write(rows: DataFrame, batch: int) -> None:
            rows.persist()
            store.append("series_points", rows.select("metric_name", "granularity", "timestamp", "value", "mode", "bucket"), batch)
            record = F.struct(
                "isHoliday", "isRCA", "isHotSpot", F.col("registry_line").alias("business_unit"), "baseDayDiff", F.col("hour").alias("hour_of_day"), F.col("weekday").alias("day_of_week"),
                "rolling_mean_7d", "rolling_std_7d", "rolling_p70_7d", "rolling_p30_7d",
            )
            known = rows.withColumns({"features": F.when(F.col("mode") != "zero_rule", record)})
            store.append("predictions", known.select("metric_name", "timestamp", "granularity", F.col("value").alias("actual_value"), "predict_value", F.col("predict_lower").alias("lower_bound"), F.col("predict_upper").alias("upper_bound"), "model_name", "model_version", "features"), batch)
            store.append("anomalies", rows.select(*ANOMALY.names), batch)
            tell(_alerts(rows), batch)
            rows.unpersist()

        use_state_store(store.spark)
        writer = self.whole(points).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def keep(self, points: DataFrame, checkpoint: str, store: HistoryStore, available_now: bool = True) -> StreamingQuery:
        """Run the repair alone and keep its points, which assessments are made of."""
        use_state_store(store.spark)
        rows = self.repaired(points).where("command is null").select(*POINT.names)
        writer = rows.writeStream.foreachBatch(lambda df, n: store.append("raw_points", df, n)).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def _alerts(told: DataFrame) -> DataFrame:
    return alert_rows(told.where("status is not null").withColumnRenamed("registry_line", "business_line"))
