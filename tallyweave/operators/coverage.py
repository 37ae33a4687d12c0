"""Coverage of grading plans, breakdowns along one or two axes, pivots, completion and invalidity counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.operators.leaderboard import WEIGHTS
from tallyweave.operators.selection import latest

KEYS = ["attempt_id", "judge_model", "agentic", "judge_version", "judge_prompt_version", "rubric_version", "reasoning"]


def match_plan(plan: DataFrame, gradings: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Plan rows with the newest grading that equals them in all keys (an empty reasoning equals none), grading_id NULL where there is none."""
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("reasoning", F.coalesce("reasoning", F.lit(""))) if "reasoning" in keys else df

    best = latest(keyed(gradings), keys, F.col("created_at"), F.col("grading_id"))
    return keyed(plan).join(best, keys, "left")


def coverage_state(mode: str = "judge_mode", keep_reduced: bool = False) -> Column:
    """unknown mode, missing grading, reduced context, or found."""
    reduced = F.coalesce(F.col("context_reduced"), F.lit(False)) & F.lit(not keep_reduced)
    return F.when(~F.coalesce(F.col(mode).isin("standard", "agentic"), F.lit(False)), "unknown").when(F.col("grading_id").isNull(), "missing").when(reduced, "context_reduced").otherwise("found")


def report(matched: DataFrame, by: list[str], weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Per group: expected rows and those of each state (column `state`), means over found rows only and their weighted total. The rows that are not found: `not_found`."""
    found = F.col("state") == "found"
    mean = lambda c: F.avg(F.when(found, F.col(c)))
    return matched.groupBy(*by).agg(
        F.count("*").alias("expected"),
        *(F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("found", "missing", "context_reduced", "unknown")),
        *(mean(c).alias(f"avg_{c}") for c in weights),
        sum(F.lit(w) * mean(c) for c, w in weights.items()).alias("total_score"),
    )


def not_found(matched: DataFrame, by: list[str]) -> DataFrame:
    """(by, state, attempt_id) of the rows that are not found: rows, so that no group is gathered."""
    return matched.where("state <> 'found'").select(*by, "state", "attempt_id")


def by_axes(rows: DataFrame, axes: list[list[str]], measures: list[Column]) -> DataFrame:
    """`measures` for each set of axes in one pass (grouping sets): columns axis, one column for each name, measures. NULL keys are `<unknown>`; an empty set of axes is the axis `overall`."""
    names = list(dict.fromkeys(a for group in axes for a in group))
    filled = rows.withColumns({a: F.coalesce(F.col(a).cast("string"), F.lit("<unknown>")) for a in names})
    label = F.concat_ws("+", *(F.when(F.grouping(a) == 0, F.lit(a)) for a in names))
    out = filled.groupingSets([[F.col(a) for a in group] for group in axes], *names).agg(F.when(label == "", "overall").otherwise(label).alias("axis"), *measures)
    return out.select("axis", *names, *(c for c in out.columns if c not in names and c != "axis"))


def score_pivot(rows: DataFrame, row: str, column: str, values: list[str], score: str) -> DataFrame:
    """One row for each `row`, one column for each of `values`: the text "mean (n)" or a dash. Given values spare a pass to find them."""
    cell = F.when(F.count(score) > 0, F.concat(F.format_string("%.1f", F.avg(score)), F.lit(" ("), F.count(score).cast("string"), F.lit(")"))).otherwise("-")
    return rows.groupBy(row).pivot(column, values).agg(cell).fillna("-")


def attempt_counts(attempts: DataFrame) -> DataFrame:
    """Attempts by agent and version with subtotals by agent and the total (NULL stands for all; `level` tells which)."""
    return attempts.rollup("agent", "prompt_version").agg(F.count("*").alias("n_attempts"), F.countDistinct("task_id").alias("n_tasks"), F.grouping_id().cast("int").alias("level"))


def completion(attempts: DataFrame, all_tasks: DataFrame, valid: Column) -> DataFrame:
    """By agent and version: distinct tasks with a valid attempt, and their share of all tasks."""
    total = all_tasks.select(F.countDistinct("task_id").alias("total"))
    done = attempts.where(valid).groupBy("agent", "prompt_version").agg(F.countDistinct("task_id").alias("tasks_done"))
    # The total is one row.
    return done.join(F.broadcast(total)).withColumn("rate", F.round(F.col("tasks_done") / F.col("total"), 4))


def invalid_counts(attempts: DataFrame, reason: Column) -> DataFrame:
    """Invalid attempts by agent and reason, most first."""
    return attempts.select("agent", reason.alias("reason")).where("reason IS NOT NULL").groupBy("agent", "reason").agg(F.count("*").alias("n")).orderBy("agent", F.desc("n"), "reason")


def plan_summary(plan: DataFrame) -> DataFrame:
    """One row: distinct agents, modes and version pairs of a plan."""
    return plan.agg(
        F.sort_array(F.collect_set("agent")).alias("agents"),
        F.count_if(F.col("judge_mode") == "standard").alias("n_standard"),
        F.count_if(F.col("judge_mode") == "agentic").alias("n_agentic"),
        F.count_if(~F.coalesce(F.col("judge_mode").isin("standard", "agentic"), F.lit(False))).alias("n_unknown"),
        F.count_distinct("judge_version", "judge_prompt_version").alias("n_version_pairs"),
    )


def primary_category(classification: str = "case_classification") -> Column:
    """The first key of greatest weight in involved_tasks, a JSON object of weights or a list of equal shares; NULL for neither."""
    as_map = F.from_json(F.get_json_object(classification, "$.involved_tasks"), "map<string,double>")
    as_list = F.from_json(F.get_json_object(classification, "$.involved_tasks"), "array<string>")
    entries = F.transform(F.map_entries(as_map), lambda e: F.struct(e["key"].alias("name"), F.coalesce(e["value"], F.lit(0.0)).alias("weight")))
    best = F.array_max(F.transform(entries, lambda e, i: F.struct(e["weight"].alias("w"), (-i).alias("p"), e["name"].alias("name"))))["name"]
    return F.coalesce(F.when(F.get_json_object(classification, "$.involved_tasks").startswith("{"), best), F.try_element_at(as_list, F.lit(1)))


def category_order(found: DataFrame, category: str = "category") -> DataFrame:
    """(category, n_tasks, place): categories by their distinct tasks, most first, ties by name. Rows without a category are left out; see `uncategorised`."""
    tasks = found.where(F.col(category).isNotNull()).groupBy(F.col(category).alias("category")).agg(F.count_distinct("task_id").alias("n_tasks"))
    return tasks.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_tasks"), "category")))  # a row for each category


def uncategorised(found: DataFrame, category: str = "category") -> DataFrame:
    return found.agg(F.count_if(F.col(category).isNull()).alias("n_uncategorised"))


def plan_counts(plan: DataFrame, missing: DataFrame, n_tasks: int, n_agents: int) -> DataFrame:
    """(kind, value, n) of a plan's report: rows by judge mode and by whether they are graded, missing cells by reason, and the cells expected."""
    mode = F.coalesce("judge_mode", F.lit("unknown"))
    modes = plan.groupBy(mode.alias("value")).agg(F.count("*").alias("n")).select(F.lit("judge_mode").alias("kind"), "value", "n")
    graded = plan.groupBy(F.when(F.col("graded"), "graded").otherwise("to_grade").alias("value")).agg(F.count("*").alias("n")).select(F.lit("graded").alias("kind"), "value", "n")
    reasons = missing.groupBy(F.col("reason").alias("value")).agg(F.count("*").alias("n")).select(F.lit("missing").alias("kind"), "value", "n")
    expected = plan.sparkSession.createDataFrame([("cells", "expected", n_tasks * n_agents)], "kind string, value string, n long")
    return modes.unionByName(graded).unionByName(reasons).unionByName(expected)
