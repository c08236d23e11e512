"""Event-time operators that run alike on tables and streams, and keyed state."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import path_exists, ship


def _timed(events: DataFrame, ts: str, late: str | None) -> DataFrame:
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return e.withWatermark(ts, late) if late and e.isStreaming else e


def stamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def tumbling(events: DataFrame, keys: list[str], width: str = "1 day", ts: str = "ts", late: str | None = "1 hour") -> DataFrame:
    """Events by window and keys: start, keys, n. Rows later than ``late`` are dropped on a stream, none on a table."""
    d = _timed(events, ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))
    return d.select(stamp(F.col("window.start")).alias("start"), *keys, "n")


def sliding(events: DataFrame, keys: list[str], width: str, step: str, least: int, ts: str = "ts", late: str | None = "1 hour") -> DataFrame:
    """Windows of ``width`` every ``step`` in which a key has at least ``least`` events: bursts, limits."""
    d = _timed(events, ts, late).groupBy(F.window(ts, width, step), *keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return d.select(stamp(F.col("window.start")).alias("start"), *keys, "n")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", ts: str = "ts", late: str | None = "1 hour") -> DataFrame:
    """Runs of events of a key with no pause longer than ``gap``: start, end of the last event's gap, n."""
    d = _timed(events, ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return d.select(key, stamp(F.col("session_window.start")).alias("start"), stamp(F.col("session_window.end")).alias("end"), "n")


def fresh_only(items: DataFrame, key: str, ts: str = "published_at", keep: str = "30 days") -> DataFrame:
    """Each key once within ``keep``: state is forgotten when the watermark passes."""
    if items.isStreaming:
        return items.withWatermark(ts, keep).dropDuplicatesWithinWatermark([key])
    return items.dropDuplicates([key])


def failure_streaks(fetches: DataFrame, key: str = "source", failures: int = 3, within_s: int = 60, block_s: int = 300) -> DataFrame:
    """Keyed state over a stream of fetches (key, ts seconds as long, ok): failures in a row and when a block ends.

    ``failures`` failed fetches within ``within_s`` block a key for ``block_s`` seconds; a success resets
    it. State is a few numbers a key. Emits (key, consecutive, blocked_until) for each key of a batch.
    """
    ship(sys.modules[__name__])

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        run, recent, until = state.get if state.exists else (0, "", 0)
        times = [int(x) for x in recent.split(",") if x]
        rows = pd.concat(list(batches)).sort_values("ts")
        for ts, ok in zip(rows["ts"], rows["ok"], strict=True):
            if ok:
                run, times, until = 0, [], 0
                continue
            run += 1
            times = [t for t in times if ts - t <= within_s] + [int(ts)]
            if len(times) >= failures:
                until = int(ts) + block_s
        state.update((run, ",".join(map(str, times[-failures:])), until))
        yield pd.DataFrame({"key": [k[0]], "consecutive": [run], "blocked_until": [until]})

    kind = dict(fetches.dtypes)[key]
    d = fetches.select(F.col(key).alias("key"), "ts", "ok").groupBy("key")
    return d.applyInPandasWithState(step, f"key {kind}, consecutive int, blocked_until long", "run int, recent string, until long", "update", "NoTimeout")


def streaks_of(log: DataFrame, key: str = "source") -> DataFrame:
    """The same failures in a row for a finished log: failures after the last success."""
    last = log.where("ok").groupBy(key).agg(F.max("ts").alias("last_ok"))
    j = log.where("not ok").join(last, key, "left").where("last_ok is null or ts > last_ok")
    return j.groupBy(key).agg(F.count("*").alias("consecutive"))


def committed_epochs(spark, path: str) -> list[int]:
    """The epochs whose table below ``path`` is complete."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[6:]) for n in names if n.startswith("epoch=") and path_exists(spark, f"{path}/{n}/_SUCCESS"))


def merge_into(path: str, keys: list[str], order: str):
    """A ``foreachBatch`` sink that keeps the newest row of each key in a parquet table, one folder an epoch.

    A batch is merged with the newest complete epoch before it, however far back; a batch that is repeated replaces its own
    epoch. An epoch that cannot be read stops the query, so that history is never replaced in silence.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = [e for e in committed_epochs(spark, path) if e < epoch]
        rows = spark.read.parquet(f"{path}/epoch={before[-1]}").unionByName(batch) if before else batch
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        newest.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write
