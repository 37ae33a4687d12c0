"""Ordered logs: consecutive comparison, snapshots, loops, forward fill, blob references, token totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.operators.scan import prefix_sums


def consecutive(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Each row with the value of the row before it (`previous`) and whether it shrank."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("previous", F.lag(value).over(w)).withColumn("shrank", F.coalesce(F.col(value) < F.col("previous"), F.lit(False)))


def drop_repeated(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before (NULLs are equal), numbered from 1: cumulative snapshots without repeats."""
    w = Window.partitionBy(*by).orderBy(*order)
    changed = (F.row_number().over(w) == 1) | ~F.col(value).eqNullSafe(F.lag(value).over(w))
    return rows.withColumn("_changed", changed).where("_changed").drop("_changed").withColumn("n", F.row_number().over(w))


def loops(rows: DataFrame, by: list[str], order: list[str], call: str, failed: str, length: int = 3) -> DataFrame:
    """Rows that end a run of `length` identical calls that all failed: flag `looping`."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - length, 0)
    same = (F.count("*").over(w) == length) & (F.min(call).over(w) == F.max(call).over(w)) & (F.count(call).over(w) == length)
    return rows.withColumn("looping", same & (F.min(F.col(failed).cast("int")).over(w) == 1))


def forward_fill(rows: DataFrame, by: list[str], order: list[str], value: str, to: str) -> DataFrame:
    """The last known value up to each row."""
    return rows.withColumn(to, F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def blobs(rows: DataFrame, text: str, least: int = 2048) -> DataFrame:
    """(blob_id, content, chars, uses) of texts of `least` characters or more, once each: the first 16 hex digits of their SHA-256."""
    long = rows.where(F.length(text) >= least).select(F.substring(F.sha2(text, 256), 1, 16).alias("blob_id"), F.col(text).alias("content"))
    return long.groupBy("blob_id").agg(F.first("content").alias("content"), F.count("*").alias("uses")).withColumn("chars", F.length("content"))


def blob_refs(payload: str | Column) -> Column:
    """All blob ids that a JSON text refers to as {"$blob": id}."""
    return F.array_distinct(F.regexp_extract_all(payload, F.lit(r'"\$blob"\s*:\s*"([^"]+)"'), F.lit(1)))


def dangling(refs: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """References to what is not there."""
    return refs.join(known.select(key).distinct(), key, "left_anti")


def unexplained_shrinks(calls: DataFrame, evictions: DataFrame, by: list[str]) -> DataFrame:
    """Calls (by, step, size) smaller than the call before without an eviction (by, step) strictly between the two.

    Calls without a size say nothing about growth: they are passed over, and are no evictions. The last eviction before each call comes by forward fill over calls and evictions together: no range join.
    """
    marks = calls.select(*by, "step", "size", F.lit(False).alias("evicts")).unionByName(evictions.select(*by, "step", F.lit(None).cast(calls.schema["size"].dataType).alias("size"), F.lit(True).alias("evicts")))
    upto = Window.partitionBy(*by).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    seen = marks.withColumn("evicted_at", F.max(F.when(F.col("evicts"), F.col("step"))).over(upto)).where("NOT evicts AND size IS NOT NULL")
    w = Window.partitionBy(*by).orderBy("step")
    out = seen.withColumns({"previous": F.lag("size").over(w), "previous_step": F.lag("step").over(w)})
    return out.where((F.col("size") < F.col("previous")) & ~F.coalesce(F.col("evicted_at") > F.col("previous_step"), F.lit(False))).select(*by, "step", "previous", "size")


def without_end(records: DataFrame, by: list[str], kind: str = "type") -> DataFrame:
    """Runs that have no end record: they were cut off."""
    return records.groupBy(*by).agg(F.count_if(F.col(kind) == "end").alias("ends"), F.count("*").alias("records")).where("ends = 0").drop("ends")


def token_rollup(calls: DataFrame, by: str, prompt: str = "prompt_tokens", completion: str = "completion_tokens", chars: str = "chars", cost: str = "cost") -> DataFrame:
    """Sums by category with a total row (category NULL), and characters for each prompt token (0 where there are none)."""
    out = calls.rollup(by).agg(F.count("*").alias("calls"), F.sum(prompt).alias("prompt_tokens"), F.sum(completion).alias("completion_tokens"), F.sum(chars).alias("chars"), F.sum(cost).alias("cost"))
    return out.withColumn("chars_per_token", F.when(F.col("prompt_tokens") > 0, F.round(F.col("chars") / F.col("prompt_tokens"), 2)).otherwise(0.0))


def tool_counts(calls: DataFrame, by: list[str], tool: str) -> DataFrame:
    return calls.where(F.col(tool).isNotNull()).groupBy(*by, tool).agg(F.count("*").alias("n")).orderBy(*by, tool)


def usage_totals(turns: DataFrame, by: list[str], order: str, cumulative: bool, measures: list[str]) -> DataFrame:
    """Token totals of runs: sums over calls, or the last snapshot where counts are cumulative."""
    if cumulative:
        return turns.groupBy(*by).agg(*(F.max_by(m, order).alias(m) for m in measures), F.count("*").alias("turns"))
    return turns.groupBy(*by).agg(*(F.sum(m).alias(m) for m in measures), F.count("*").alias("turns"))


def reconcile(calls: DataFrame, telemetry: DataFrame, by: list[str], measure: str) -> DataFrame:
    """Runs whose calls' sum of `measure` is not what telemetry says; a side without the run counts 0."""
    a = calls.groupBy(*by).agg(F.sum(measure).alias("from_calls"))
    b = telemetry.groupBy(*by).agg(F.sum(measure).alias("from_telemetry"))
    both = a.join(b, by, "full_outer").fillna(0, ["from_calls", "from_telemetry"])
    return both.where("from_calls <> from_telemetry")


def numbered(rows: DataFrame, by: list[str], order: list[str], to: str = "step") -> DataFrame:
    """Rows numbered from 1 within their log, in `order` (which has to part them). A log may be of any size: numbers are running sums over ranges."""
    return prefix_sums(rows, by, order, {to: F.lit(1)})
