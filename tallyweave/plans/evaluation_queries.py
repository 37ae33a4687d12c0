"""Queries over the evaluation tables: selection, leaderboards, coverage, statistics, budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.operators import budget, coverage, leaderboard, selection, stats
from tallyweave.sources.evaluation import evaluation, oracle_with
from tallyweave.sources.tables import small, table, written

QUERIES, ORACLE_SQL = {}, {}
DIFFICULTIES = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
EXPECTED = 206


def query(sql: str | None, *tables: str):
    """Registers a query with its SQL; the SQL's WITH clause is made from the evaluation tables it names."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            text = sql.strip()
            if tables:
                text = oracle_with(*tables) + (", " + text[4:].strip() if text.upper().startswith("WITH") else " " + text)
            ORACLE_SQL[f.__name__] = text
        return f

    return register


def cohorts(spark, sf_dir):
    """The roster: every agent and version that attempted anything. Written once, for it is counted before it is broadcast."""
    roster = written(evaluation(spark, sf_dir, "attempts").select("agent", "prompt_version").distinct(), "roster")
    return roster.withColumn("cohort", F.concat("agent", F.lit("@"), F.col("prompt_version").cast("string")))


def cells(spark, sf_dir):
    return leaderboard.cells(*(evaluation(spark, sf_dir, n) for n in ("tasks", "attempts", "gradings")), cohorts(spark, sf_dir))


CELLS = """WITH cohorts AS (SELECT DISTINCT agent, prompt_version, agent || '@' || prompt_version AS cohort FROM attempts),
last AS (SELECT c.cohort, a.task_id, max(a.attempt_id) AS attempt_id FROM attempts a JOIN cohorts c USING (agent, prompt_version)
         WHERE a.failed IS NOT TRUE AND a.deprecated IS NOT TRUE GROUP BY 1, 2),
clean AS (SELECT attempt_id, max(grading_id) AS grading_id FROM gradings WHERE failed IS NOT TRUE AND deprecated IS NOT TRUE GROUP BY 1),
cells AS (SELECT c.cohort, t.task_id, t.difficulty, l.attempt_id, a.minutes, k.grading_id, g.accuracy, g.formula, g.format,
            round(0.5 * g.accuracy + 0.35 * g.formula + 0.15 * g.format, 5) AS total,
            CASE WHEN l.attempt_id IS NULL THEN 'needs_attempt' WHEN k.grading_id IS NULL THEN 'needs_grading' ELSE 'complete' END AS status
          FROM tasks t CROSS JOIN cohorts c LEFT JOIN last l ON l.task_id = t.task_id AND l.cohort = c.cohort
          LEFT JOIN (SELECT attempt_id, task_id, max(minutes) AS minutes FROM attempts GROUP BY 1, 2) a ON a.attempt_id = l.attempt_id AND a.task_id = t.task_id
          LEFT JOIN clean k ON k.attempt_id = l.attempt_id LEFT JOIN gradings g ON g.grading_id = k.grading_id AND g.attempt_id = k.attempt_id
          WHERE t.deprecated IS NOT TRUE)"""
SUMMARY = f"""summary AS (SELECT cohort, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'needs_grading') AS needs_grading,
            count(*) FILTER (status = 'needs_attempt') AS needs_attempt, count(total) AS scored, greatest(count(*), {EXPECTED}) - count(total) AS imputed_zeros,
            round(coalesce(sum(total), 0) / greatest(count(*), {EXPECTED}), 2) AS mean_total, count(minutes) AS timed,
            round(avg(minutes), 2) AS mean_minutes, round(median(minutes), 2) AS median_minutes FROM cells GROUP BY cohort)"""


@query(f"{CELLS}, {SUMMARY} SELECT cohort, complete, needs_grading, needs_attempt, scored, imputed_zeros, mean_total, timed, mean_minutes, median_minutes FROM summary", "tasks", "attempts", "gradings")
def cohort_summary(spark, sf_dir):
    return leaderboard.summary(cells(spark, sf_dir), EXPECTED).select("cohort", "complete", "needs_grading", "needs_attempt", "scored", "imputed_zeros", "mean_total", "timed", "mean_minutes", "median_minutes")


@query(f"{CELLS}, {SUMMARY} SELECT CAST(row_number() OVER (ORDER BY mean_total DESC, cohort) AS INTEGER) AS rank, cohort, mean_total, scored, imputed_zeros FROM summary", "tasks", "attempts", "gradings")
def leaderboard_ranking(spark, sf_dir):
    return leaderboard.ranking(leaderboard.summary(cells(spark, sf_dir), EXPECTED))


@query(
    f"""{CELLS} SELECT cohort, coalesce(difficulty, 'None') AS difficulty, CAST(coalesce(list_position({DIFFICULTIES}, difficulty), 6) AS INTEGER) AS ordinal,
      count(*) AS n, count(*) FILTER (status = 'complete') AS graded, count(*) FILTER (status <> 'complete') AS missing,
      {", ".join(f"round(coalesce(sum(CASE WHEN status = 'complete' THEN {c} END), 0) / count(*), 5) AS {c}" for c in ("accuracy", "formula", "format", "total"))},
      count(minutes) AS timed, round(avg(minutes), 2) AS mean_minutes, round(median(minutes), 2) AS median_minutes
    FROM cells GROUP BY ALL""",
    "tasks", "attempts", "gradings",
)
def difficulty_breakdown(spark, sf_dir):
    return leaderboard.difficulty_breakdown(cells(spark, sf_dir), DIFFICULTIES, digits=5)  # sums in another order part at coarser ties


@query(f"{CELLS} SELECT cohort, coalesce(difficulty, 'None') AS difficulty, task_id, status FROM cells WHERE status <> 'complete'", "tasks", "attempts", "gradings")
def missing_tasks(spark, sf_dir):
    return leaderboard.missing_tasks(cells(spark, sf_dir))


@query("SELECT task_id, agent, prompt_version, max(attempt_id) AS attempt_id FROM attempts WHERE failed IS NOT TRUE AND deprecated IS NOT TRUE GROUP BY ALL", "attempts")
def latest_attempt_dedup(spark, sf_dir):
    a = evaluation(spark, sf_dir, "attempts").select("task_id", "agent", "prompt_version", "attempt_id", "failed", "deprecated")
    return selection.latest_valid_attempts(a, ["task_id", "agent", "prompt_version"]).select("task_id", "agent", "prompt_version", "attempt_id")


@query("SELECT task_id, agent, max(attempt_id) AS attempt_id, max_by(prompt_version, attempt_id) AS prompt_version FROM attempts WHERE failed IS NOT TRUE AND deprecated IS NOT TRUE GROUP BY ALL", "attempts")
def latest_per_task_model(spark, sf_dir):
    a = evaluation(spark, sf_dir, "attempts").select("task_id", "agent", "prompt_version", "attempt_id", "failed", "deprecated")
    return selection.latest_valid_attempts(a, ["task_id", "agent"]).select("task_id", "agent", "attempt_id", "prompt_version")


@query("SELECT attempt_id, max(grading_id) AS grading_id FROM gradings WHERE failed IS NOT TRUE AND deprecated IS NOT TRUE GROUP BY 1", "gradings")
def latest_grading_top1(spark, sf_dir):
    g = evaluation(spark, sf_dir, "gradings").select("attempt_id", "grading_id", "failed", "deprecated")
    return selection.latest_clean_gradings(g).select("attempt_id", "grading_id")


@query("SELECT attempt_id, arg_max(grading_id, (created_at, grading_id)) AS grading_id FROM gradings WHERE failed = false AND deprecated = false GROUP BY 1", "gradings")
def newest_grading(spark, sf_dir):
    g = evaluation(spark, sf_dir, "gradings").select("attempt_id", "grading_id", "created_at", "failed", "deprecated")
    return selection.newest_gradings(g).select("attempt_id", "grading_id")


VALID = "failed = false AND deprecated = false AND files IS NOT NULL AND files NOT IN ('', 'null', '[]', '{}')"
#: Names of workbooks in a text of any shape: extensions before a quote or at the end.
BOOKS = "len(regexp_extract_all(lower(coalesce(files, '')), '[.](xlsx|xlsm|xls)(\"|$)'))"
REASON = f"""CASE WHEN failed THEN 'failed' WHEN deprecated THEN 'deprecated' WHEN files IS NULL OR files IN ('', 'null', '[]', '{{}}') THEN 'no files'
  WHEN {BOOKS} = 0 THEN 'no workbook' WHEN {BOOKS} > 1 THEN 'several workbooks' END"""


@query(f"SELECT attempt_id, task_id, agent, prompt_version FROM attempts WHERE {VALID} AND (agent <> 'agent1' OR prompt_version = 1)", "attempts")
def valid_attempts_with_versions(spark, sf_dir):
    versions = spark.createDataFrame([("agent1", 1)], "agent string, required int")
    return selection.valid_attempts(evaluation(spark, sf_dir, "attempts"), small(versions)).select("attempt_id", "task_id", "agent", "prompt_version")


@query(f"SELECT agent, reason, count(*) AS n FROM (SELECT agent, {REASON} AS reason FROM attempts) r WHERE reason IS NOT NULL GROUP BY ALL", "attempts")
def invalid_reasons(spark, sf_dir):
    return coverage.invalid_counts(evaluation(spark, sf_dir, "attempts"), selection.invalid_reason())


@query(
    """SELECT task_id, task_source, difficulty FROM tasks t WHERE deprecated IS NOT TRUE AND NOT EXISTS (SELECT 1 FROM attempts a
       WHERE a.task_id = t.task_id AND agent = 'agent1' AND prompt_version = 1 AND failed IS NOT TRUE AND a.deprecated IS NOT TRUE)""",
    "tasks", "attempts",
)
def eligible_antijoin(spark, sf_dir):
    return selection.eligible(evaluation(spark, sf_dir, "tasks"), evaluation(spark, sf_dir, "attempts"), "agent1", 1).select("task_id", "task_source", "difficulty")


@query(
    """SELECT task_id FROM tasks t WHERE deprecated = false AND NOT EXISTS (SELECT 1 FROM attempts a
       WHERE a.task_id = t.task_id AND agent = 'agent2' AND prompt_version = 0 AND failed IS NOT TRUE AND a.deprecated IS NOT TRUE)""",
    "tasks", "attempts",
)
def eligible_for_dispatch(spark, sf_dir):
    return selection.eligible_for_dispatch(evaluation(spark, sf_dir, "tasks"), evaluation(spark, sf_dir, "attempts"), "agent2", 0).select("task_id")


@query(
    """WITH e AS (SELECT task_id FROM tasks t WHERE deprecated IS NOT TRUE AND NOT EXISTS (SELECT 1 FROM attempts a
       WHERE a.task_id = t.task_id AND agent = 'agent1' AND prompt_version = 1 AND failed IS NOT TRUE AND a.deprecated IS NOT TRUE))
       SELECT count(*) FILTER (task_id IN (SELECT user_id FROM events)) AS in_flight, count(*) FILTER (task_id NOT IN (SELECT user_id FROM events)) AS unassigned, count(*) AS total FROM e""",
    "tasks", "attempts",
)
def backlog_counts(spark, sf_dir):
    e = selection.eligible(evaluation(spark, sf_dir, "tasks"), evaluation(spark, sf_dir, "attempts"), "agent1", 1)
    return selection.backlog(e, table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id")))


@query("SELECT agent, count(*) AS trials FROM attempts WHERE created_at >= TIMESTAMP '1997-01-01' GROUP BY 1", "attempts")
def trial_counts(spark, sf_dir):
    return evaluation(spark, sf_dir, "attempts").where("created_at >= TIMESTAMP_NTZ '1997-01-01'").groupBy("agent").agg(F.count("*").alias("trials"))


@query("SELECT task_id FROM tasks WHERE (task_source = 'wsp' OR task_id IN (1, 2, 3, 7)) AND task_id NOT IN (3, 32)", "tasks")
def set_algebra(spark, sf_dir):
    return selection.selected(evaluation(spark, sf_dir, "tasks"), [1, 2, 3, 7], ["wsp"], [3, 32]).select("task_id")


@query(
    f"""WITH last AS (SELECT task_id, agent, max(attempt_id) AS attempt_id, arg_max((prompt_version, failed, deprecated, files), attempt_id) AS r FROM attempts GROUP BY 1, 2),
    seen AS (SELECT task_id, agent, attempt_id, r[1] AS prompt_version, r[2] AS failed, r[3] AS deprecated, r[4] AS files FROM last),
    grid AS (SELECT t.task_id, a.agent FROM tasks t CROSS JOIN (SELECT DISTINCT agent FROM attempts) a)
    SELECT task_id, agent, reason FROM (SELECT g.task_id, g.agent, CASE WHEN attempt_id IS NULL THEN 'no_attempt' WHEN failed THEN 'failed' WHEN deprecated THEN 'deprecated'
      WHEN files IS NULL OR files IN ('', 'null', '[]', '{{}}') THEN 'empty' WHEN {BOOKS} = 0 THEN 'no_xlsx' WHEN prompt_version <> 1 THEN 'version_mismatch' END AS reason
      FROM grid g LEFT JOIN seen s ON g.task_id = s.task_id AND g.agent = s.agent) x WHERE reason IS NOT NULL""".replace("arg_max((prompt_version, failed, deprecated, files), attempt_id)", "arg_max(struct_pack(a := prompt_version, b := failed, c := deprecated, d := files), attempt_id)").replace("r[1]", "r.a").replace("r[2]", "r.b").replace("r[3]", "r.c").replace("r[4]", "r.d"),
    "tasks", "attempts",
)
def missing_cell_grid(spark, sf_dir):
    a = evaluation(spark, sf_dir, "attempts")
    return selection.missing_cells(evaluation(spark, sf_dir, "tasks"), a.select("agent").distinct(), a, 1)


PLAN = """WITH planned AS (SELECT attempt_id, agent, prompt_version, CASE WHEN attempt_id % 9 = 0 THEN NULL WHEN attempt_id % 2 = 0 THEN 'agentic' ELSE 'standard' END AS judge_mode FROM attempts WHERE failed = false),
best AS (SELECT attempt_id, arg_max(struct_pack(id := grading_id, a := accuracy, f := formula, m := format, c := context_reduced), (created_at, grading_id)) AS g FROM gradings WHERE failed IS NOT TRUE AND accuracy IS NOT NULL GROUP BY 1),
matched AS (SELECT agent, prompt_version, p.attempt_id, g.a AS accuracy, g.f AS formula, g.m AS format, CASE WHEN judge_mode IS NULL THEN 'unknown' WHEN g.id IS NULL THEN 'missing' WHEN g.c THEN 'context_reduced' ELSE 'found' END AS state
            FROM planned p LEFT JOIN best b USING (attempt_id))"""


def matched_plan(spark, sf_dir):
    a = evaluation(spark, sf_dir, "attempts").where("failed = false")
    mode = F.when(F.col("attempt_id") % 9 == 0, None).when(F.col("attempt_id") % 2 == 0, "agentic").otherwise("standard")
    plan = a.select("attempt_id", "agent", "prompt_version", mode.alias("judge_mode"))
    g = evaluation(spark, sf_dir, "gradings").where(selection.not_true("failed") & F.col("accuracy").isNotNull())
    g = g.select("attempt_id", "grading_id", "created_at", "accuracy", "formula", "format", "context_reduced")
    return coverage.match_plan(plan, g, ["attempt_id"]).withColumn("state", coverage.coverage_state())


@query(
    PLAN + """ SELECT agent, prompt_version, count(*) AS expected, count(*) FILTER (state = 'found') AS n_found, count(*) FILTER (state = 'missing') AS n_missing,
      count(*) FILTER (state = 'context_reduced') AS n_context_reduced, count(*) FILTER (state = 'unknown') AS n_unknown,
      round(avg(CASE WHEN state = 'found' THEN accuracy END), 6) AS avg_accuracy, round(avg(CASE WHEN state = 'found' THEN formula END), 6) AS avg_formula, round(avg(CASE WHEN state = 'found' THEN format END), 6) AS avg_format,
      round(0.5 * avg(CASE WHEN state = 'found' THEN accuracy END) + 0.35 * avg(CASE WHEN state = 'found' THEN formula END) + 0.15 * avg(CASE WHEN state = 'found' THEN format END), 6) AS total_score FROM matched GROUP BY ALL""",
    "attempts", "gradings",
)
def coverage_report(spark, sf_dir):
    out = coverage.report(matched_plan(spark, sf_dir), ["agent", "prompt_version"])
    return out.withColumns({c: F.round(c, 6) for c in ("avg_accuracy", "avg_formula", "avg_format", "total_score")})


@query(PLAN + " SELECT agent, prompt_version, state, attempt_id FROM matched WHERE state <> 'found'", "attempts", "gradings")
def coverage_not_found(spark, sf_dir):
    return coverage.not_found(matched_plan(spark, sf_dir), ["agent", "prompt_version"])


AXES = [[], ["agent"], ["judge_mode"], ["prompt_version"], ["agent", "judge_mode"], ["agent", "prompt_version"]]


@query(
    PLAN.replace("SELECT agent, prompt_version, p.attempt_id", "SELECT coalesce(agent, '<unknown>') AS agent, CAST(prompt_version AS VARCHAR) AS prompt_version, coalesce(judge_mode, '<unknown>') AS judge_mode, p.attempt_id")
    + """ SELECT coalesce(nullif(concat_ws('+', CASE WHEN grouping(agent) = 0 THEN 'agent' END, CASE WHEN grouping(judge_mode) = 0 THEN 'judge_mode' END, CASE WHEN grouping(prompt_version) = 0 THEN 'prompt_version' END), ''), 'overall') AS axis,
      agent, judge_mode, prompt_version, count(*) AS n, count(*) FILTER (state = 'found') AS n_found, round(avg(CASE WHEN state = 'found' THEN accuracy END), 6) AS avg_accuracy
      FROM matched GROUP BY GROUPING SETS ((), (agent), (judge_mode), (prompt_version), (agent, judge_mode), (agent, prompt_version))""",
    "attempts", "gradings",
)
def performance_by_axes(spark, sf_dir):
    found = F.col("state") == "found"
    measures = [F.count("*").alias("n"), F.count_if(found).alias("n_found"), F.round(F.avg(F.when(found, F.col("accuracy"))), 6).alias("avg_accuracy")]
    return coverage.by_axes(matched_plan(spark, sf_dir), AXES, measures)


@query("SELECT difficulty, count(DISTINCT a.task_id) AS n_tasks, count(DISTINCT agent) AS n_agents FROM attempts a JOIN tasks t ON a.task_id = t.task_id GROUP BY 1", "tasks", "attempts")
def distinct_tasks(spark, sf_dir):
    a, t = evaluation(spark, sf_dir, "attempts").select("task_id", "agent"), evaluation(spark, sf_dir, "tasks").select("task_id", "difficulty")
    return a.join(t, "task_id").groupBy("difficulty").agg(F.countDistinct("task_id").alias("n_tasks"), F.countDistinct("agent").alias("n_agents"))


@query(
    "SELECT agent, " + ", ".join(f"""CASE WHEN count(minutes) FILTER (difficulty = '{d}') > 0 THEN count(minutes) FILTER (difficulty = '{d}') ELSE 0 END AS "{d}" """ for d in DIFFICULTIES) + " FROM attempts a JOIN tasks t ON a.task_id = t.task_id GROUP BY 1",
    "tasks", "attempts",
)
def difficulty_pivot(spark, sf_dir):
    a, t = evaluation(spark, sf_dir, "attempts").select("task_id", "agent", "minutes"), evaluation(spark, sf_dir, "tasks").select("task_id", "difficulty")
    return a.join(t, "task_id").groupBy("agent").pivot("difficulty", DIFFICULTIES).agg(F.count("minutes")).fillna(0)


@query(
    "SELECT agent, " + ", ".join(f"""CASE WHEN count(minutes) FILTER (difficulty = '{d}') > 0 THEN printf('%.1f', floor(avg(minutes) FILTER (difficulty = '{d}') * 10 + 0.5) / 10) || ' (' || count(minutes) FILTER (difficulty = '{d}') || ')' ELSE '-' END AS "{d}\"""" for d in DIFFICULTIES)
    + " FROM attempts JOIN tasks USING (task_id) GROUP BY agent",
    "tasks", "attempts",
)
def score_pivot(spark, sf_dir):
    a, t = evaluation(spark, sf_dir, "attempts").select("task_id", "agent", "minutes"), evaluation(spark, sf_dir, "tasks").select("task_id", "difficulty")
    return coverage.score_pivot(a.join(t, "task_id"), "agent", "difficulty", DIFFICULTIES, "minutes")


@query("SELECT agent, prompt_version, count(*) AS n_attempts, count(DISTINCT task_id) AS n_tasks, CAST(grouping(agent) * 2 + grouping(prompt_version) AS INTEGER) AS level FROM attempts GROUP BY ROLLUP (agent, prompt_version)", "attempts")
def attempt_counts_rollup(spark, sf_dir):
    return coverage.attempt_counts(evaluation(spark, sf_dir, "attempts"))


@query(f"SELECT agent, prompt_version, count(DISTINCT task_id) AS tasks_done, (SELECT count(*) FROM tasks) AS total, round(count(DISTINCT task_id) / (SELECT count(*) FROM tasks), 4) AS rate FROM attempts WHERE {VALID} GROUP BY ALL", "tasks", "attempts")
def completion_rate(spark, sf_dir):
    valid = selection.strictly_false("failed") & selection.strictly_false("deprecated") & ~selection.no_files()
    return coverage.completion(evaluation(spark, sf_dir, "attempts"), evaluation(spark, sf_dir, "tasks"), valid)


STATS = """SELECT agent, difficulty, count(minutes) AS n, round(avg(minutes), 6) AS mean, round(coalesce(stddev_samp(minutes) / sqrt(count(minutes)), 0), 6) AS sem, round(median(minutes), 8) AS median,
  round(quantile_cont(minutes, 0.25), 8) AS q25, round(quantile_cont(minutes, 0.75), 8) AS q75 FROM attempts a JOIN tasks t ON a.task_id = t.task_id WHERE minutes IS NOT NULL GROUP BY ALL"""


def minutes_of_tasks(spark, sf_dir):
    a, t = evaluation(spark, sf_dir, "attempts").select("task_id", "agent", "minutes"), evaluation(spark, sf_dir, "tasks").select("task_id", "difficulty")
    return a.where("minutes IS NOT NULL").join(t, "task_id")


def minute_stats(spark, sf_dir):
    return stats.stat_summary(minutes_of_tasks(spark, sf_dir), ["agent", "difficulty"], "minutes").withColumns({c: F.round(c, n) for c, n in (("mean", 6), ("sem", 6), ("median", 8), ("q25", 8), ("q75", 8))})


@query(STATS, "tasks", "attempts")
def stat_summary(spark, sf_dir):
    return minute_stats(spark, sf_dir)


@query(f"WITH s AS ({STATS}) SELECT agent, difficulty, round(median, 8) AS centre, round(greatest(median - q25, 0), 8) AS below, round(greatest(q75 - median, 0), 8) AS above FROM s", "tasks", "attempts")
def iqr_bars(spark, sf_dir):
    bars = stats.error_bars(minute_stats(spark, sf_dir), robust=True)
    return bars.select("agent", "difficulty", *(F.round(c, 8).alias(c) for c in ("centre", "below", "above")))


@query(f"WITH s AS ({STATS}) SELECT round(least(max(mean + sem) * 1.1, 100), 4) AS upper, round(min(CASE WHEN mean > 0 THEN mean END) / 2, 4) AS log_floor FROM s", "tasks", "attempts")
def axis_bounds(spark, sf_dir):
    means = stats.mean_summary(minutes_of_tasks(spark, sf_dir), ["agent", "difficulty"], "minutes").withColumns({c: F.round(c, 6) for c in ("mean", "sem")})
    b = stats.axis_bounds(stats.error_bars(means, robust=False))
    return b.select(F.round("upper", 4).alias("upper"), F.round("log_floor", 4).alias("log_floor"))


@query("SELECT source, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars, count(*) AS files FROM documents GROUP BY 1")
def char_totals(spark, sf_dir):
    return stats.char_totals(table(spark, sf_dir, "documents"), ["source"], "text")


@query("SELECT source, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars, count(*) AS files, coalesce(sum(length(text)), 0) > 120000 AS over FROM documents GROUP BY 1")
def over_limit(spark, sf_dir):
    return stats.over_limit(stats.char_totals(table(spark, sf_dir, "documents"), ["source"], "text"), 120_000)


@query(
    """WITH b AS (SELECT CAST(min(n_chars) AS DOUBLE) AS lo, CAST(max(n_chars) AS DOUBLE) AS hi FROM documents)
    SELECT CAST(CASE WHEN hi > lo THEN least(29, floor((n_chars - lo) / (hi - lo) * 30)) ELSE 0 END AS INTEGER) AS bin, count(*) AS n FROM documents CROSS JOIN b WHERE n_chars IS NOT NULL GROUP BY 1"""
)
def char_histogram(spark, sf_dir):
    return stats.histogram(table(spark, sf_dir, "documents"), "n_chars", 30)


LABELS = "CASE WHEN quality = 1 AND toxic = 1 THEN 'TP' WHEN quality = 1 AND toxic <> 1 THEN 'FP' WHEN quality <> 1 AND toxic <> 1 THEN 'TN' WHEN quality <> 1 AND toxic = 1 THEN 'FN' END"


@query(f"SELECT {LABELS} AS label, count(*) AS n FROM labels GROUP BY 1")
def confusion(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy(stats.confusion(F.col("quality") == 1, F.col("toxic") == 1).alias("label")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' UNION ALL SELECT l_orderkey, r.l, r.p, r.s, r.d FROM (SELECT l_orderkey, l_suppkey % 5 AS judge, arg_max(struct_pack(l := l_linenumber, p := l_partkey, s := l_suppkey, d := l_shipdate), (l_shipdate, l_partkey, l_suppkey, l_linenumber)) AS r FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01' GROUP BY 1, 2) x")
def queue_rule(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 5).alias("judge"), "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    out = selection.queue_rule(rows, ["l_orderkey", "judge"], "l_shipdate", F.expr("TIMESTAMP_NTZ '1997-01-01'"), F.struct("l_partkey", "l_suppkey", "l_linenumber"))
    return out.drop("judge")


@query("SELECT task_id, chars, CAST(chars - 150000 AS DOUBLE) AS delta FROM tasks WHERE abs(chars - 150000) <= 15000", "tasks")
def boundary_band(spark, sf_dir):
    return budget.boundary_band(evaluation(spark, sf_dir, "tasks").select("task_id", "chars"), "chars", 150_000)


@query(
    """WITH s AS (SELECT o_orderkey, o_totalprice AS sol, (SELECT 1) AS one FROM orders), a AS (SELECT l_orderkey, sum(l_extendedprice) AS att FROM lineitem GROUP BY 1)
    SELECT CASE WHEN att IS NULL THEN 'unknown' WHEN sol > 250000 OR att > greatest(120000, 300000 - sol) THEN 'agentic' ELSE 'standard' END AS mode, count(*) AS n
    FROM s LEFT JOIN a ON o_orderkey = l_orderkey GROUP BY 1"""
)
def budget_route(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_totalprice").alias("sol"))
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("task_id")).agg(F.sum("l_extendedprice").alias("att"))
    over = F.when(F.col("att").isNotNull(), budget.overflows(F.col("sol"), F.col("att"), 250_000, 120_000, 300_000))
    return s.join(a, "task_id", "left").groupBy(budget.judge_mode(over).alias("mode")).agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT source, doc_id, n_chars, least(n_chars, 400) AS short FROM documents),
    w AS (SELECT *, sum(n_chars) OVER (PARTITION BY source) - coalesce(sum(n_chars - short) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over FROM s)
    SELECT source, doc_id, left_over > 60000 AS summarised FROM w"""
)
def sheet_budget_running(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", F.least(F.col("n_chars"), F.lit(400)).alias("short"))
    return budget.summarised_sheets(s, ["source"], "n_chars", "short", "doc_id", 60_000).select("source", "doc_id", "summarised")


PRICES = [("AUTOMOBILE", 5.0, 15.0), ("BUILDING", 0.15, 0.6), ("MACHINERY", 30.0, 60.0)]


@query(
    """WITH p AS (SELECT * FROM (VALUES ('AUTOMOBILE', 5.0, 15.0), ('BUILDING', 0.15, 0.6), ('MACHINERY', 30.0, 60.0)) v(m, i, o))
    SELECT c_mktsegment AS model, count(*) AS calls, round(sum(c_custkey / 1e6 * coalesce(CAST(i AS DOUBLE), 10.0) + (c_nationkey * 10) / 1e6 * coalesce(CAST(o AS DOUBLE), 30.0)), 6) AS total_cost
    FROM customer LEFT JOIN p ON c_mktsegment = m GROUP BY 1"""
)
def cost_rollup(spark, sf_dir):
    usage = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("model"), F.col("c_custkey").alias("prompt_tokens"), (F.col("c_nationkey") * 10).alias("completion_tokens"))
    prices = spark.createDataFrame(PRICES, "model string, input_price double, output_price double")
    return budget.costs(usage, prices, (10.0, 30.0)).groupBy("model").agg(F.count("*").alias("calls"), F.round(F.sum("total_cost"), 6).alias("total_cost"))
