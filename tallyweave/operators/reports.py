"""Reports of batches, runs and cohorts: totals, completion by model, groups of workers, and the structure of sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.operators import sheets
from tallyweave.operators.sheets import KEY
from tallyweave.sources.tables import one_row


def batch_totals(results: DataFrame, by: list[str]) -> DataFrame:
    """Per batch: workspaces, successful and failed (all that is no success, NULL too), and sums of iterations, tokens, cost and seconds (0 without any)."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    ok = F.coalesce(F.col("status") == "success", F.lit(False))
    return results.groupBy(*by).agg(F.count("*").alias("workspaces"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), *map(total, ("iterations", "tokens", "cost", "seconds")))


def batch_report(results: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """(by, place, line): the report of each batch as lines in order, the overview first (places under 0), then a section for each workspace, by its path. Lines are rows, so no report is one row."""
    number = lambda c: F.format_number(c, 0)
    money = lambda c: F.concat(F.lit("$"), F.format_string("%.4f", F.col(c).cast("double")))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    head = [
        text("# Batch Execution Summary: ", F.concat_ws(" ", *by)), text("**Total Duration**: ", F.format_string("%.2f seconds", F.col("seconds").cast("double"))), text("## Overview"),
        text("- **Total Workspaces**: ", F.col("workspaces").cast("string")), text("- **Successful**: ", F.col("successful").cast("string")), text("- **Failed**: ", F.col("failed").cast("string")),
        text("- **Total Iterations**: ", F.col("iterations").cast("string")), text("- **Total Tokens**: ", number("tokens")), text("- **Total Cost**: ", money("cost")), text("## Workspace Results"),
    ]
    one = [
        text("### ", F.when(F.col("status") == "success", "✅").otherwise("❌"), " ", F.coalesce("workspace", F.lit(""))), text("- **Status**: ", F.coalesce("status", F.lit("None"))), text("- **Iterations**: ", F.coalesce(F.col("iterations").cast("string"), F.lit("0"))),
        text("- **Tokens**: ", number(F.coalesce("tokens", F.lit(0)))), text("- **Cost**: ", F.coalesce(money("cost"), F.lit("$0.0000"))), text("- **Duration**: ", F.format_string("%.2fs", F.coalesce(F.col("seconds").cast("double"), F.lit(0.0)))),
        F.when(F.length("error") > 0, text("- **Error**: ", F.col("error"))),
    ]
    overview = totals.select(*by, F.lit("").alias("workspace"), F.posexplode(F.array(*head)).alias("place", "line")).withColumn("place", F.col("place") - len(head))
    sections = results.select(*by, F.coalesce("workspace", F.lit("")).alias("workspace"), F.posexplode(F.array_compact(F.array(*one))).alias("place", "line"))
    return overview.unionByName(sections)


def completion_matrix(tasks: DataFrame, agents: DataFrame, valid: DataFrame) -> DataFrame:
    """(agent, done, total, rate) of every agent: its tasks with a valid attempt (task_id, agent), of all tasks, in whole percent (halves to even, as Python's)."""
    total = tasks.select(F.count_distinct("task_id").alias("total"))
    done = valid.select("task_id", "agent").distinct().join(tasks.select("task_id").distinct(), "task_id", "left_semi").groupBy("agent").agg(F.count("*").alias("done"))
    # The total is one row.
    out = agents.select("agent").distinct().join(done, "agent", "left").join(F.broadcast(total)).fillna(0, ["done"])
    return out.withColumn("rate", F.when(F.col("total") > 0, F.bround(F.col("done") / F.col("total") * 100, 0).cast("int")))


def missing_with_reasons(tasks: DataFrame, agents: DataFrame, valid: DataFrame, invalid: DataFrame) -> DataFrame:
    """(agent, task_id, reasons) of every cell without a valid attempt: the different reasons of its invalid attempts (task_id, agent, attempt_id, reason), in the order they came up; none for no attempt."""
    grid = tasks.select("task_id").distinct().join(one_row(agents.select("agent").distinct(), "roster")).select("task_id", F.inline("roster"))
    # A row for each kind of reason: a cell's attempts are never gathered.
    first = invalid.groupBy("task_id", "agent", "reason").agg(F.min("attempt_id").alias("at"))
    reasons = first.groupBy("task_id", "agent").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "reason"))), lambda x: x["reason"]).alias("reasons"))
    return grid.join(valid.select("task_id", "agent").distinct(), ["task_id", "agent"], "left_anti").join(reasons, ["task_id", "agent"], "left").select("agent", "task_id", F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def run_summary(results: DataFrame) -> DataFrame:
    """One row: results, succeeded and failed (`success` unknown counts as failed)."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    return results.agg(F.count("*").alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))


def worker_cohorts(workers: DataFrame) -> DataFrame:
    """(agent, prompt_version, alias, place): reachable workers of each cohort, numbered by alias; workers without an agent are left out, an unknown version is the text None."""
    known = workers.where("reachable AND agent IS NOT NULL AND agent <> ''").select("agent", F.coalesce(F.col("prompt_version").cast("string"), F.lit("None")).alias("prompt_version"), "alias")
    return known.withColumn("place", F.row_number().over(Window.partitionBy("agent", "prompt_version").orderBy("alias")))


def structure(cells: DataFrame, blocks: DataFrame, share: float = 0.6, look: int = 3) -> tuple[DataFrame, DataFrame]:
    """Of every block (workbook, sheet, r1, c1, r2, c2): itself with its header row, and the columns of those that have one.

    The header is the first of a block's first `look` rows whose texts are `share` of its filled cells (rounded down, one at least). Columns: name, filled cells below the header, their
    commonest type (the one seen first on ties, `unknown` without any) and first three values. Cells meet blocks by blocks of rows."""
    box = ["r1", "c1", "r2", "c2"]
    numbered = blocks.select(*KEY, *box, F.struct(*box).alias("range_id"))
    inside = sheets.in_ranges(sheets.filled(cells), numbered)
    key = [*KEY, "range_id"]
    rows = inside.where(F.col("row") < F.col("range_id.r1") + look).groupBy(*key, "row").agg(F.count("*").alias("n"), F.count_if(F.col("v_type") == "string").alias("texts"))
    heads = rows.where(F.col("texts") >= F.greatest(F.lit(1), F.floor(F.lit(share) * F.col("n")))).groupBy(*key).agg(F.min("row").alias("header_row"))
    with_head = inside.join(heads, key).where(F.col("row") >= F.col("header_row"))
    below = F.col("row") > F.col("header_row")
    named = with_head.groupBy(*key, "header_row", "col").agg(F.max(F.when(~below, F.col("raw"))).alias("name"), F.count_if(below).alias("non_null"))
    kinds = with_head.where(below).groupBy(*key, "col", "v_type").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    kind = kinds.groupBy(*key, "col").agg(F.max_by("v_type", F.struct("n", -F.col("first"))).alias("type"))
    ranked = with_head.where(below).withColumn("__n", F.row_number().over(Window.partitionBy(*key, "col").orderBy("row", "raw"))).where(F.col("__n") <= 3)
    near = ranked.groupBy(*key, "col").agg(F.transform(F.sort_array(F.collect_list(F.struct("__n", "raw"))), lambda x: x["raw"]).alias("examples"))
    columns = named.join(kind, [*key, "col"], "left").join(near, [*key, "col"], "left").fillna("unknown", ["type"]).withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))
    told = numbered.join(heads, key, "left").select(*KEY, *box, "header_row")
    return told, columns.select(*KEY, "range_id.*", "header_row", "col", "name", "type", "non_null", "examples")
