"""Structured Streaming over event logs, and the batch forms of the same rules.

The windowed forms are extensions: the evaluation workflow itself only appends to logs and limits logins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
WORKER = "worker string, current string, queued array<string>, done array<string>"


def rate_limit(events: DataFrame, key: str, ts: str, seconds: int = 900, tries: int = 8) -> DataFrame:
    """Batch: how many events of the key fall within the last `seconds` of each, and whether that is more than `tries`."""
    w = Window.partitionBy(key).orderBy(F.unix_timestamp(ts)).rangeBetween(-seconds, 0)
    return events.withColumn("in_window", F.count("*").over(w)).withColumn("blocked", F.col("in_window") > tries)


def windowed_counts(events: DataFrame, key: str, ts: str = "ts", late: str = "15 minutes", length: str = "15 minutes", slide: str = "1 minute") -> DataFrame:
    """Stream or batch: events by key and sliding window; with a stream, later than `late` is dropped."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, length, slide), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def sessions(events: DataFrame, key: str, ts: str = "ts", late: str = "30 minutes", gap: str = "30 minutes") -> DataFrame:
    """Stream or batch: sessions of the key, ended by a gap."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n", "value")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of an append-only folder of JSON lines; a line cut short gives NULLs and is dropped."""
    return spark.readStream.schema(schema).option("mode", "PERMISSIVE").json(path).where(F.coalesce(*[F.col(c.split()[0]).cast("string") for c in schema.split(", ")]).isNotNull())


def append_results(rows: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] = lambda b: b) -> StreamingQuery:
    """Micro-batches, transformed, appended as Parquet under a folder for each batch: a batch run again replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def worker_states(events: DataFrame) -> DataFrame:
    """Stream: events (worker, kind enqueue|pop|finish, task) as each worker's state after each batch; enqueuing twice changes nothing."""
    import pandas as pd

    def step(key, batches, state):
        current, queued, done = state.get if state.exists else (None, [], [])
        queued, done = list(queued), list(done)
        for rows in batches:
            for kind, task in rows[["kind", "task"]].itertuples(index=False):
                if kind == "enqueue" and task not in queued and task != current and task not in done:
                    queued.append(task)
                elif kind == "pop" and current is None and queued:
                    current = queued.pop(0)
                elif kind == "finish" and current is not None:
                    done.append(current)
                    current = None
        state.update((current, queued, done))
        yield pd.DataFrame({"worker": [key[0]], "current": [current], "queued": [queued], "done": [done]})

    return events.groupBy("worker").applyInPandasWithState(step, WORKER, "current string, queued array<string>, done array<string>", "update", "NoTimeout")
