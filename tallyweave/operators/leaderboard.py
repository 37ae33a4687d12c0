"""Leaderboards: cells of cohort and task, zero-imputed means, rankings, difficulty buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.operators.quantiles import with_quantiles
from tallyweave.operators.selection import latest_clean_gradings, latest_valid_attempts, not_true
from tallyweave.sources.tables import one_row, small

#: Fixed values of the first benchmark version: weights of the three grades, and the floor of the mean's denominator.
WEIGHTS = {"accuracy": 0.50, "formula": 0.35, "format": 0.15}
EXPECTED_TASKS = 206


def cells(tasks: DataFrame, attempts: DataFrame, gradings: DataFrame, cohorts: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """A row for each cohort (label, agent, prompt_version) and task: the latest valid attempt, its latest clean grading, status and composite.

    One plan for all cohorts: attempts are reduced to the latest of each cohort and task before anything is joined.
    """
    live = tasks.where(not_true("deprecated"))
    roster = cohorts.select("cohort", "agent", "prompt_version")
    last = latest_valid_attempts(attempts.join(small(roster), ["agent", "prompt_version"]), ["cohort", "task_id"]).select("cohort", "task_id", "attempt_id", "minutes")
    clean = latest_clean_gradings(gradings).select("attempt_id", "grading_id", "accuracy", "formula", "format")
    total = F.round(sum(F.lit(w) * F.col(k) for k, w in weights.items()), 5)
    status = F.when(F.col("attempt_id").isNull(), "needs_attempt").when(F.col("grading_id").isNull(), "needs_grading").otherwise("complete")
    # Gradings join the attempts first: cells without an attempt have no attempt_id that could be a hot NULL key.
    graded = last.where("cohort IS NOT NULL").join(clean, "attempt_id", "left")
    # A task meets its attempts by its id alone, and the grid is made behind that join: a row for each cell would be sorted otherwise.
    shown = ["attempt_id", "minutes", "grading_id", "accuracy", "formula", "format"]
    by_task = graded.groupBy("task_id").agg(F.map_from_entries(F.collect_list(F.struct("cohort", F.struct(*shown).alias("x")))).alias("graded"))
    tasks_met = live.select("task_id", "task_name", "task_source", "difficulty").join(by_task, "task_id", "left").join(one_row(roster, "roster"))
    grid = tasks_met.select("task_id", "task_name", "task_source", "difficulty", "graded", F.inline("roster")).withColumn("x", F.try_element_at("graded", F.col("cohort"))).drop("graded")
    return grid.select("cohort", "task_id", "task_name", "task_source", "difficulty", "agent", "prompt_version", *(f"x.{c}" for c in shown)).withColumn("total", total).withColumn("status", status)


def summary(cell_rows: DataFrame, expected_tasks: int = EXPECTED_TASKS) -> DataFrame:
    """Per cohort: status counts, the zero-imputed mean over at least `expected_tasks` cells, and times over recorded ones only."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("complete", "needs_grading", "needs_attempt")]
    denominator = F.greatest(F.col("cells"), F.lit(expected_tasks))
    aggregates = [
        *counts, F.count("*").alias("cells"), F.count("total").alias("scored"), F.coalesce(F.sum("total"), F.lit(0.0)).alias("sum_total"),
        F.count("minutes").alias("timed"), F.round(F.avg("minutes"), 2).alias("mean_minutes"),
    ]
    out = with_quantiles(cell_rows, ["cohort"], "minutes", {"median_minutes": 0.5}, aggregates).withColumn("median_minutes", F.round("median_minutes", 2))
    return out.withColumn("imputed_zeros", denominator - F.col("scored")).withColumn("mean_total", F.round(F.col("sum_total") / denominator, 2)).drop("sum_total", "cells")


def ranking(summary_rows: DataFrame) -> DataFrame:
    """Cohorts by mean, best first, ties by name; every rank is used once. The summary is a row for each cohort, so one window over it is small."""
    w = Window.orderBy(F.desc("mean_total"), "cohort")
    return summary_rows.select(F.row_number().over(w).alias("rank"), "cohort", "mean_total", "scored", "imputed_zeros")


def difficulty_breakdown(cell_rows: DataFrame, order: list[str], digits: int = 1) -> DataFrame:
    """Per cohort and difficulty: cells, graded, means over all cells of the bucket, times over recorded ones. The missing tasks themselves are rows: see `missing_tasks`.

    Buckets are numbered by `order`; others come after, NULL as the text None.
    """
    complete = F.col("status") == "complete"
    mean = lambda c: F.round(F.coalesce(F.sum(F.when(complete, F.col(c))), F.lit(0.0)) / F.count("*"), digits).alias(c)
    known = F.array(*map(F.lit, order))
    at = F.when(F.col("difficulty").isin(order), F.array_position(known, F.col("difficulty"))).otherwise(len(order) + 1).cast("int")
    buckets = cell_rows.withColumn("ordinal", at).withColumn("difficulty", F.coalesce("difficulty", F.lit("None")))
    aggregates = [
        F.count("*").alias("n"), F.count_if(complete).alias("graded"), F.count_if(~complete).alias("missing"),
        mean("accuracy"), mean("formula"), mean("format"), mean("total"),
        F.count("minutes").alias("timed"), F.round(F.avg("minutes"), 2).alias("mean_minutes"),
    ]
    out = with_quantiles(buckets, ["cohort", "difficulty", "ordinal"], "minutes", {"median_minutes": 0.5}, aggregates)
    return out.withColumn("median_minutes", F.round("median_minutes", 2))


def missing_tasks(cell_rows: DataFrame) -> DataFrame:
    """(cohort, difficulty, task_id, status) of every cell that is not complete: rows, so that no bucket is gathered. NULL difficulties are the text None."""
    return cell_rows.where(F.col("status") != "complete").select("cohort", F.coalesce("difficulty", F.lit("None")).alias("difficulty"), "task_id", "status")
