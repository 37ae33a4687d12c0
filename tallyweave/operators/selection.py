"""Which attempts and gradings count: validity, latest rows, eligibility, queues, set algebra.

Each definition of "valid" and "latest" that the evaluation workflow uses is a function of its own; they differ on purpose.
Latest rows are one hash aggregate (max_by, with map-side combination) rather than a sort of each group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.sources.logs import file_refs
from tallyweave.sources.tables import one_row


def not_true(c: str | Column) -> Column:
    """NULL counts as false."""
    return ~F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))


def strictly_false(c: str) -> Column:
    """NULL rows are left out."""
    return F.col(c) == F.lit(False)


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Of each key the row whose `order` is greatest; `order` should end in a unique column. By aggregation, with all columns."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("best"))
    return best.select(*keys, "best.*").select(*rows.columns)


def latest_valid_attempts(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """The attempt with the greatest id that is neither failed nor deprecated (unknown counts as neither)."""
    return latest(attempts.where(not_true("failed") & not_true("deprecated")), keys, F.col("attempt_id"))


def file_names(files: str = "files") -> Column:
    """The names of the files of a JSON text of any known shape (text, list of texts, list of objects, object); none for null."""
    return F.filter(F.transform(file_refs(files), lambda x: x["name"]), lambda n: n.isNotNull())


def no_files(files: str = "files") -> Column:
    c = F.trim(files)
    return c.isNull() | c.isin("", "null", "[]", "{}")


def is_workbook(name: Column) -> Column:
    return F.lower(name).rlike(r"\.(xlsx|xlsm|xls)$")


def valid_attempts(attempts: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """Strict: failed and deprecated known to be false, files present. `versions` (agent, required) binds only the agents it lists."""
    rows = attempts.where(strictly_false("failed") & strictly_false("deprecated") & ~no_files())
    if versions is None:
        return rows
    return rows.join(versions, "agent", "left").where(F.col("required").isNull() | (F.col("prompt_version") == F.col("required"))).drop("required")


def invalid_reason() -> Column:
    """The first rule an attempt breaks, or null: it failed, it is deprecated, it has no files, no workbook, or several."""
    books = F.size(F.filter(file_names(), is_workbook))
    return (
        F.when(F.coalesce(F.col("failed"), F.lit(False)), "failed")
        .when(F.coalesce(F.col("deprecated"), F.lit(False)), "deprecated")
        .when(no_files(), "no files")
        .when(books == 0, "no workbook")
        .when(books > 1, "several workbooks")
    )


def latest_clean_gradings(gradings: DataFrame) -> DataFrame:
    """Of each attempt the grading with the greatest id that is neither failed nor deprecated."""
    return latest(gradings.where(not_true("failed") & not_true("deprecated")), ["attempt_id"], F.col("grading_id"))


def newest_gradings(gradings: DataFrame) -> DataFrame:
    """Of each attempt the grading created last (unknown times first, ties to the greater id), strictly clean ones only."""
    return latest(gradings.where(strictly_false("failed") & strictly_false("deprecated")), ["attempt_id"], F.col("created_at"), F.col("grading_id"))


def queue_rule(rows: DataFrame, keys: list[str], time: str, cutoff: Column, order: Column) -> DataFrame:
    """Of the rows before `cutoff` the last of each key, and all rows from `cutoff` on."""
    before = latest(rows.where(F.col(time) < cutoff), keys, F.col(time), order)
    return before.unionByName(rows.where(F.col(time) >= cutoff))


def eligible(tasks: DataFrame, attempts: DataFrame, agent: str, version: int) -> DataFrame:
    """Tasks not deprecated (unknown kept) without an attempt of this agent and version that neither failed nor is deprecated."""
    done = attempts.where((F.col("agent") == agent) & (F.col("prompt_version") == version) & not_true("failed") & not_true("deprecated"))
    return tasks.where(not_true("deprecated")).join(done.select("task_id"), "task_id", "left_anti")


def eligible_for_dispatch(tasks: DataFrame, attempts: DataFrame, agent: str, version: int) -> DataFrame:
    """As `eligible`, but tasks whose deprecation is unknown are left out."""
    return eligible(tasks.where(strictly_false("deprecated")), attempts, agent, version)


def backlog(eligible_tasks: DataFrame, in_flight: DataFrame) -> DataFrame:
    """One row: how many eligible tasks are in flight, unassigned, and in all."""
    flagged = eligible_tasks.select("task_id").join(in_flight.select("task_id").distinct().withColumn("busy", F.lit(1)), "task_id", "left")
    return flagged.agg(F.count("busy").alias("in_flight"), F.count_if(F.col("busy").isNull()).alias("unassigned"), F.count("*").alias("total"))


def in_flight_ids(states: DataFrame) -> DataFrame:
    """Ids of current and queued tasks of workers (current string, queued array<string>); what is no number is dropped."""
    every = states.select(F.explode(F.concat(F.array("current"), F.coalesce("queued", F.array().cast("array<string>")))).alias("id"))
    return every.select(F.expr("try_cast(id AS BIGINT)").alias("task_id")).where("task_id IS NOT NULL").distinct()


def selected(tasks: DataFrame, ids: list[int], sources: list[str], excluded: list[int]) -> DataFrame:
    """Tasks by id or by source, less the excluded; NULL sources match nothing."""
    chosen = tasks.where(F.coalesce(F.col("task_id").isin(ids) | F.col("task_source").isin(sources), F.lit(False)))
    return chosen.where(~F.col("task_id").isin(excluded))


def missing_cells(tasks: DataFrame, agents: DataFrame, attempts: DataFrame, required_version: int) -> DataFrame:
    """(task_id, agent, reason) of every task and agent without a valid attempt of the version, judged on the latest attempt.

    The grid is tasks times the short roster of agents, made by exploding the roster within each task.
    """
    grid = tasks.select("task_id").join(one_row(agents.select("agent").distinct(), "agents")).select("task_id", F.inline("agents"))
    last = latest(attempts.select("task_id", "agent", "attempt_id", "prompt_version", "failed", "deprecated", "files"), ["task_id", "agent"], F.col("attempt_id"))
    books = F.size(F.filter(file_names(), is_workbook))
    reason = (
        F.when(F.col("attempt_id").isNull(), "no_attempt")
        .when(F.coalesce(F.col("failed"), F.lit(False)), "failed")
        .when(F.coalesce(F.col("deprecated"), F.lit(False)), "deprecated")
        .when(no_files(), "empty")
        .when(books == 0, "no_xlsx")
        .when(F.col("prompt_version") != required_version, "version_mismatch")
    )
    return grid.join(last, ["task_id", "agent"], "left").select("task_id", "agent", reason.alias("reason")).where("reason IS NOT NULL")


def model_token(token: str) -> tuple[Column, Column]:
    """Name and version of `name@version`; the last @ counts, and without a number after it all is the name."""
    version = F.expr(f"try_cast(regexp_extract({token}, '^(.*)@([0-9]+)$', 2) AS INT)")
    name = F.when(version.isNotNull(), F.regexp_extract(token, "^(.*)@([0-9]+)$", 1)).otherwise(F.col(token))
    return name, version


def ranked_matches(candidates: DataFrame, key: str, priority: str, tie: str) -> DataFrame:
    """Of each key the candidate of least priority, ties to the greatest `tie`: a match with fallbacks."""
    return latest(candidates, [key], -F.col(priority), F.col(tie))


def first_seen(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Of each key the row that comes first. Rows of a key with the same position: one of them."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(F.col(position).isNotNull(), position)).alias("first"))
    return first.select(*keys, "first.*").select(*rows.columns)


def graded_attempts(gradings: DataFrame, attempts: DataFrame, tasks: DataFrame) -> DataFrame:
    """Gradings with the attempt and the task that they are of: (grading columns, agent, prompt_version, task_name, task_source). Those without either are left out.

    Attempts meet their tasks first, a row each; gradings then meet the attempts. All three may be large: no side is broadcast unless Spark finds it small."""
    known = attempts.select("attempt_id", "task_id", "agent", "prompt_version").join(tasks.select("task_id", "task_name", "task_source"), "task_id")
    return gradings.join(known.drop("task_id"), "attempt_id")


def results_of(results: DataFrame, attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results (attempt_id, …) with their attempt's task, agent and version, and the results that no attempt has."""
    known = attempts.select("attempt_id", "task_id", "agent", "prompt_version")
    return results.join(known, "attempt_id"), results.join(known, "attempt_id", "left_anti")


def tasks_by_name(wanted: DataFrame, tasks: DataFrame, normal: Column, name: str = "name") -> DataFrame:
    """wanted (name) with the task_id of the first match, NULL without any: live tasks by the normalised name, then by the name as it is, then any task in the opposite order.

    Live tasks are those known not to be deprecated. Of several tasks of one kind of match the least id counts. `normal` is the normalised name, a column of `wanted`."""
    names = wanted.select(F.col(name).alias("__name"), normal.alias("__normal")).distinct()
    tried = names.select("__name", F.posexplode(F.array("__normal", "__name")).alias("place", "task_name"))
    live = F.coalesce(F.col("deprecated") == F.lit(False), F.lit(False))
    rank = F.when(live, F.col("place")).otherwise(3 - F.col("place"))
    best = tried.join(tasks.select("task_id", "task_name", "deprecated"), "task_name").groupBy("__name").agg(F.min_by("task_id", F.struct(rank, "task_id")).alias("task_id"))
    return wanted.join(best, wanted[name] == best["__name"], "left").drop("__name")


def candidate_ids(listed: DataFrame, attempts: DataFrame, frontier: list[str]) -> DataFrame:
    """(attempt_id, corrected): the listed attempts (attempt_id, corrected) and those of the agents `frontier` that are not known to be deprecated, each once; corrected if any listing says so."""
    of_frontier = attempts.where(F.col("agent").isin(frontier) & not_true("deprecated")).select("attempt_id", F.lit(False).alias("corrected"))
    both = listed.select("attempt_id", F.coalesce("corrected", F.lit(False)).alias("corrected")).unionByName(of_frontier)
    return both.where(F.col("attempt_id").isNotNull()).groupBy("attempt_id").agg(F.max("corrected").alias("corrected"))
