"""Replay a file of points, or the demo, and print the alerts: python -m tidewatch [--input F] [--registry F] [--history D] [--json]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.alerts import console_lines
from tidewatch.operators.history import HistoryStore
from tidewatch.plans.online import Monitor
from tidewatch.plans.replay import replay
from tidewatch.sources import points as src


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidewatch")
    p.add_argument("--input")
    p.add_argument("--registry")
    p.add_argument("--json", action="store_true")
    p.add_argument("--history", help="folder of history tables: the replay goes on from them and adds to them")
    p.add_argument("--alerts", help="write the alerts as Parquet here instead of printing them")
    a = p.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    points = src.read_jsonl(spark, a.input) if a.input else src.demo_points(spark)
    registry = src.read_registry(spark, a.registry) if a.registry else src.demo_registry(spark)
    if a.history:
        store = HistoryStore(spark, a.history)
        alerts = Monitor(store, registry).process(points, store.next_batch(), flush=True)
    else:
        alerts = replay(points, registry).alerts
    if a.alerts:
        alerts.write.mode("overwrite").parquet(a.alerts)
        return 0
    alerts = alerts.orderBy("metric_name", "timestamp")
    lines = alerts.select(F.to_json(F.struct("*")).alias("line")) if a.json else console_lines(alerts)
    count = 0
    for row in lines.toLocalIterator():
        print(row["line"])
        count += 1
    print(f"alerts={count}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
