"""Runs that fall silent: a stateful stream with event-time timers notes each run whose end record does not come.

Needs the RocksDB state store: `use_state_store(spark)`.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

NOTES = "run {kind}, records long, last timestamp"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class SilentRuns(StatefulProcessor):
    """State of a run: its records so far, the time of the last and whether an end came, with one timer `wait_ms` after the last."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "records long, last long, ended boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        records, last, ended = self.seen.get() if self.seen.exists() else (0, None, False)
        for row in rows:
            records, ended = records + 1, ended or row.ended
            last = row.at if last is None else max(last, row.at)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.wait_ms)
        self.seen.update((records, last, ended))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        records, last, ended = self.seen.get()
        self.seen.clear()
        if not ended:
            yield Row(run=key[0], records=records, last=last)

    def close(self) -> None:
        pass


def partial_runs(records: DataFrame, run: str = "run", ts: str = "ts", kind: str = "type", end: str = "end", wait: int = 1_800, late: int = 600) -> DataFrame:
    """Stream: (run, records, last) of each run without an end record `wait` seconds (of event time) after its last record, once.

    An end record that comes in time cancels the note, whatever the order; so does any further record, until it too is `wait` seconds old. Records more than `late` seconds
    behind the newest are dropped, records without a run or a time are passed over. What a run leaves in state goes with its timer, ended or not.
    """
    at = F.col(ts)
    known = records.where(F.col(run).isNotNull() & at.isNotNull()).select(F.col(run).alias("run"), at.alias("ts"), F.unix_millis(at).alias("at"), F.coalesce(F.col(kind) == end, F.lit(False)).alias("ended"))
    watched = known.withWatermark("ts", f"{late} seconds").groupBy("run")
    schema = "run {}, records long, last long".format(known.schema["run"].dataType.simpleString())
    notes = watched.transformWithState(SilentRuns(wait * 1_000), schema, "append", "eventTime")
    return notes.withColumn("last", F.timestamp_millis("last"))
