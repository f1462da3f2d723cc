"""History tables: typed Parquet by date and bucket of metrics, upserts by key, recent rows, retention and removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.exprs import local_time

#: Tables and their keys. Tables of points are laid out by date and by bucket of their metric; the others are small.
KEYS = {
    "raw_points": ("metric_name", "timestamp"),
    "series_points": ("metric_name", "granularity", "timestamp"),
    "predictions": ("metric_name", "granularity", "timestamp"),
    "anomalies": ("metric_name", "granularity", "timestamp"),
    "registry": ("metric_name",),
    "assessments": ("metric_name", "since"),
    "states": ("metric_name", "kind"),
}
POINTS = ("raw_points", "series_points", "predictions", "anomalies")
BUCKETS = 16
LAYOUT = ("batch", "date", "metric_bucket")


def bucket_of(metric: Column) -> Column:
    """The bucket of a metric's points; of a constant name the planner knows it, and reads no other folder."""
    return F.pmod(F.hash(metric), F.lit(BUCKETS))


def latest(df: DataFrame, keys: tuple[str, ...], version: str = "ingest_seq") -> DataFrame:
    """Of rows with one key the one of the highest version."""
    last = Window.partitionBy(*keys).orderBy(F.desc(version))
    return df.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def prune(df: DataFrame, cutoff: int) -> DataFrame:
    """Rows not older than cutoff."""
    return df.where(F.col("timestamp") >= cutoff)


def drop_metric(df: DataFrame, metric: str) -> DataFrame:
    return df.where(F.col("metric_name") != metric)


def aligned_history(raw: DataFrame, asked: DataFrame, limit: int = 28, fallback: int = 60) -> DataFrame:
    """asked (metric_name, timestamp, weekday, hour, minute, second, isHoliday) with aligned_values: earlier values at the same slot, else at the same second, newest first."""

    key = ["metric_name", "weekday", "hour", "minute", "second", "isHoliday"]
    both = raw.select("timestamp", "value", *key, F.lit(1).alias("_raw")).unionByName(asked.withColumn("_raw", F.lit(0)), allowMissingColumns=True)

    def values(rows: DataFrame, on: list[str], n: int, name: str) -> DataFrame:
        # A row's place is how many points its slot has up to it, so the last n points before a question are a range of places.
        slot = Window.partitionBy("metric_name", *on)
        placed = rows.withColumn("_place", F.sum("_raw").over(slot.orderBy("timestamp", "_raw").rowsBetween(Window.unboundedPreceding, 0)))
        held = F.collect_list(F.when(F.col("_raw") == 1, F.struct("value"))).over(slot.orderBy("_place").rangeBetween(1 - n, 0))
        return placed.withColumn(name, F.when(F.col("_raw") == 0, F.reverse(F.transform(held, lambda x: x["value"])))).drop("_place")

    # Slots lie within seconds, so both windows share the one exchange by second.
    dealt = both.repartition("metric_name", "second")
    found = values(values(dealt, key[1:], limit, "_slot"), ["second"], fallback, "_second").where("_raw = 0")
    either = F.when(F.size("_slot") > 0, F.col("_slot")).otherwise(F.col("_second"))
    return found.select(*asked.columns, either.alias("aligned_values"))


class HistoryStore:
    """Parquet tables under one path, appended by batch and read as their latest rows.

    An append carries its batch's number as version; a batch that is written again replaces its own
    files, so a retried micro-batch changes nothing. A rewrite goes to a new generation, which counts
    once its mark is there; only then the old one is removed, so a failure between loses nothing.
    Points of a batch lie in folders by local date and by bucket of their metric, so questions about a
    metric or a time open only those. Retention removes whole folders of dates and leaves a mark, from
    which on points count; it rewrites nothing.
    """

    def __init__(self, spark: SparkSession, path: str, timezone: str = "Asia/Shanghai"):
        self.spark, self.path, self.timezone = spark, path, timezone
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._files = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _generation(self, name: str) -> str:
        if name not in KEYS:
            raise ValueError(f"no table {name}")
        folder = self._at(name)
        found = [f.getPath().getName() for f in self._files.listStatus(folder)] if self._files.exists(folder) else []
        whole = [f for f in found if f.startswith("gen=") and self._files.exists(self._at(name, f, "_WHOLE"))]
        return max(whole, key=lambda f: int(f[4:]), default="gen=0")

    def append(self, name: str, rows: DataFrame, batch: int, generation: str | None = None) -> None:
        target = f"{self.path}/{name}/{generation or self._generation(name)}/batch={batch}"
        if name not in POINTS:
            rows.drop("batch").write.mode("overwrite").parquet(target)
            return
        # The date and bucket of a row are part of its file's path, and the batch above it is what a retry overwrites.
        placed = rows.drop(*LAYOUT).withColumns({"date": self._date(F.col("timestamp")), "metric_bucket": bucket_of(F.col("metric_name"))})
        placed.write.mode("overwrite").partitionBy("date", "metric_bucket").parquet(target)

    def _date(self, timestamp: Column) -> Column:
        return F.to_date(local_time(timestamp, self.timezone))

    def _names(self, *parts: str) -> list[str]:
        folder = self._at(*parts)
        return [f.getPath().getName() for f in self._files.listStatus(folder)] if self._files.exists(folder) else []

    def _since(self, name: str) -> int | None:
        """From when on points count, if retention has left a mark."""
        return max((int(f[7:]) for f in self._names(name, self._generation(name)) if f.startswith("_SINCE=")), default=None)

    def _batches(self, name: str) -> list[int]:
        now = self._generation(name)
        # A batch without a row has left a folder without data.
        return [int(f[6:]) for f in self._names(name, now) if f.startswith("batch=") and any(not x.startswith("_") for x in self._names(name, now, f))]

    def next_batch(self) -> int:
        """One more than the last batch of raw points."""
        return max(self._batches("raw_points"), default=-1) + 1

    def has(self, name: str) -> bool:
        return bool(self._batches(name))

    def _rows(self, name: str, since: int | None = None) -> DataFrame:
        """All rows that count, of points only those since a time."""
        base = f"{self.path}/{name}/{self._generation(name)}"
        rows = self.spark.read.option("basePath", base).parquet(*(f"{base}/batch={n}" for n in self._batches(name)))
        since = max((t for t in (since, self._since(name)) if t is not None), default=None) if name in POINTS else None
        return rows if since is None else rows.where((F.col("timestamp") >= since) & (F.col("date") >= self._date(F.lit(since))))

    def read(self, name: str, before: int | None = None, metrics: DataFrame | None = None, since: int | None = None) -> DataFrame:
        """The latest row of each key; of batches before a number, of some metrics, or of points since a time only, if these are given."""
        rows = self._rows(name, since)
        rows = rows if before is None else rows.where(F.col("batch") < before)
        if metrics is not None:
            named = metrics.select("metric_name", *([bucket_of(F.col("metric_name")).alias("metric_bucket")] if name in POINTS else []))
            rows = rows.join(named, named.columns, "left_semi")
        return latest(rows, KEYS[name], "batch").drop("metric_bucket")

    def newest(self, name: str) -> int | None:
        """The time of the newest point, from the last date that has one."""
        dates = [d[5:] for n in self._batches(name) for d in self._names(name, self._generation(name), f"batch={n}") if d.startswith("date=")]
        return self._rows(name).where(F.col("date") == F.lit(max(dates)).cast("date")).agg(F.max("timestamp").alias("t")).first()["t"] if dates else None

    def recent(self, name: str, metric: str, limit: int | None = None, since: int | None = None, granularity: str | None = None) -> DataFrame:
        """The latest rows of a metric in order of time; its bucket and the dates asked for are all that is read."""
        rows = self._rows(name, since).where(F.col("metric_name") == metric)
        rows = rows.where(F.col("metric_bucket") == bucket_of(F.lit(metric))).drop("metric_bucket") if name in POINTS else rows
        rows = latest(rows if granularity is None else rows.where(F.col("granularity") == granularity), KEYS[name], "batch")
        return rows.orderBy("timestamp") if limit is None else rows.orderBy(F.desc("timestamp")).limit(limit).orderBy("timestamp")

    def rewrite(self, name: str, keep, batch: int) -> int:
        """Replace a table by what keep(DataFrame) leaves of batches up to this number, as one batch; returns how many rows went."""
        now = self._generation(name)
        new = f"gen={int(now[4:]) + 1}"
        before = self.read(name, before=batch + 1)
        left = keep(before).drop(*LAYOUT).checkpoint()
        if kept := left.count():
            self.append(name, left, batch, new)
        gone = before.count() - kept
        self._files.create(self._at(name, new, "_WHOLE"), True).close()
        self._files.delete(self._at(name, now), True)
        return gone

    def retain(self, cutoff: int, batch: int) -> int:
        """Drop points older than cutoff, of batches up to this number, from all tables of points; returns how many went.

        Folders of dates that have passed are removed. Older points of the cutoff's own date stay in their
        files until the date has passed, but no longer count.
        """
        gone = 0
        for name in (n for n in POINTS if self.has(n)):
            day = self.spark.range(1).select(self._date(F.lit(cutoff)).cast("string").alias("d")).first()["d"]
            gone += latest(self._rows(name).where((F.col("date") <= F.lit(day).cast("date")) & (F.col("timestamp") < cutoff)), KEYS[name], "batch").count()
            now = self._generation(name)
            self._files.mkdirs(self._at(name, now))
            self._files.create(self._at(name, now, f"_SINCE={cutoff}"), True).close()
            for n in (n for n in self._batches(name) if n <= batch):
                for date in self._names(name, now, f"batch={n}"):
                    if date.startswith("date=") and date[5:] < day:
                        self._files.delete(self._at(name, now, f"batch={n}", date), True)
        return gone

    def forget_idle(self, now: int, ttl: int, batch: int) -> list[str]:
        """Drop the states and assessments of metrics without a point for ttl seconds; their points stay. Returns their names."""
        if not self.has("raw_points") or not self.has("states"):
            return []
        active = self._rows("raw_points", now - ttl + 1).select("metric_name").distinct()
        gone = self.read("states").select("metric_name").distinct().join(active, "metric_name", "left_anti").checkpoint()
        names = sorted(r["metric_name"] for r in gone.collect())  # one row for each metric that has just become idle
        if names:
            for name in ("states", "assessments"):
                self.rewrite(name, lambda d: d.join(gone, "metric_name", "left_anti"), batch)
        return names
