"""Queries over ordered rules, annotations, edits and files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyweave.functions import formulas
from tallyweave.operators import budget, coverage, rules, scoring, selection, sheets
from tallyweave.plans.log_queries import CELLS, line_cells
from tallyweave.sources import logs
from tallyweave.sources.tables import small, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return register


@query(
    """SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN l_partkey % 23 = 0 THEN 'infra_failure' WHEN l_shipdate < TIMESTAMP '1993-01-01' THEN 'timeout' WHEN l_returnflag = 'R' AND l_linenumber > 2 THEN 'needs_review' WHEN l_returnflag = 'R' THEN 'agent_failure'
      WHEN l_suppkey % 5 = 0 THEN 'agent_failure' WHEN l_tax = 0.01 THEN 'agent_failure' WHEN l_quantity < 10 THEN 'needs_review' ELSE 'success' END AS verdict FROM lineitem) v GROUP BY 1"""
)
def verdict_cascade(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_partkey") % 23 == 0, "down").alias("infra_error"), F.lit("").alias("transcript"), (F.col("l_shipdate") < F.expr("TIMESTAMP_NTZ '1993-01-01'")).alias("timed_out"), (F.col("l_returnflag") != "R").alias("has_solution"),
        F.when(F.col("l_linenumber") > 2, 1).otherwise(0).alias("other_workbooks"), (F.col("l_suppkey") % 5).alias("sheets"), (F.col("l_tax") == 0.01).alias("seeded"), F.col("l_quantity").alias("seconds"),
    )
    return line.groupBy(rules.verdict(10).alias("verdict")).agg(F.count("*").alias("n"))


@query(
    """SELECT CASE WHEN a LIKE 'claudecode\\_%' ESCAPE '\\' OR a LIKE 'codex\\_%' ESCAPE '\\' THEN 'Coding agent' WHEN a LIKE 'openpyxl%' THEN 'CLI/API' WHEN contains(a, 'excel_agent') THEN 'Excel add-in' ELSE 'GUI' END AS pipeline, count(*) AS n
    FROM (SELECT CASE c_nationkey % 4 WHEN 0 THEN 'codex_' WHEN 1 THEN 'openpyxl-' WHEN 2 THEN 'my_excel_agent' ELSE 'web' END || c_custkey AS a FROM customer) c GROUP BY 1"""
)
def pipeline_classes(spark, sf_dir):
    k = F.col("c_nationkey") % 4
    a = table(spark, sf_dir, "customer").select(F.concat(F.when(k == 0, "codex_").when(k == 1, "openpyxl-").when(k == 2, "my_excel_agent").otherwise("web"), F.col("c_custkey").cast("string")).alias("agent"))
    return a.groupBy(rules.pipeline_of("agent").alias("pipeline")).agg(F.count("*").alias("n"))


@query(
    """SELECT o_orderkey AS grading_id, coalesce(who, '') AS who FROM orders LEFT JOIN (SELECT l_orderkey, array_to_string(list_sort(list_distinct(list('judge' || (l_suppkey % 3)))), ',') AS who FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) a ON l_orderkey = o_orderkey
    WHERE contains(lower(o_orderpriority), 'high') AND who IS NULL ORDER BY o_orderkey LIMIT 500"""
)
def queue_browse(spark, sf_dir):
    notes = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("grading_id"), F.concat(F.lit("judge"), (F.col("l_suppkey") % 3).cast("string")).alias("annotator"))
    queue = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("grading_id"), "o_orderpriority")
    found = rules.browse(rules.annotators(notes, queue), contains={"o_orderpriority": "HIGH"}, reviewed=False)
    return found.select("grading_id", F.array_join("annotators", ",").alias("who"))


@query(
    """SELECT l_orderkey AS grading_id, array_to_string(list_sort(list_distinct(list('judge' || (l_suppkey % 3)))), ',') AS who FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1
    UNION ALL SELECT o_orderkey, '' FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F')"""
)
def annotator_sets(spark, sf_dir):
    notes = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("grading_id"), F.concat(F.lit("judge"), (F.col("l_suppkey") % 3).cast("string")).alias("annotator"))
    return rules.annotators(notes, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("grading_id"))).select("grading_id", F.array_join("annotators", ",").alias("who"))


@query("SELECT CAST(l_orderkey % 10 AS VARCHAR) AS workbook, l_linestatus AS sheet, CAST(l_orderkey AS INTEGER) AS row, CAST(l_linenumber AS INTEGER) AS col, arg_max(l_partkey, (l_shipdate, l_partkey, l_suppkey)) AS raw FROM lineitem GROUP BY 1, 2, 3, 4")
def resolved_edits(spark, sf_dir):
    edits = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 10).cast("string").alias("workbook"), F.col("l_linestatus").alias("sheet"), F.col("l_orderkey").cast("int").alias("row"), F.col("l_linenumber").cast("int").alias("col"), F.col("l_partkey").alias("raw"), F.struct("l_shipdate", "l_partkey", "l_suppkey").alias("seq"))
    return sheets.resolve_edits(edits)


@query(CELLS + " SELECT workbook, sheet, row_ AS row, col_ AS col, raw FROM cells WHERE row_ BETWEEN 5 AND 400 AND col_ BETWEEN 2 AND 3")
def read_range(spark, sf_dir):
    return sheets.read_range(sheets.filled(line_cells(spark, sf_dir)), 5, 2, 400, 3).select("workbook", "sheet", "row", "col", "raw")


@query(CELLS + " SELECT workbook, sheet, CAST(row_ // 256 AS INTEGER) AS segment, sha256(string_agg(chr(64 + col_) || row_ || ': ' || raw, chr(10) ORDER BY row_, col_)) AS grid FROM cells GROUP BY workbook, sheet, row_ // 256")
def rendered_grid(spark, sf_dir):
    return sheets.rendered(line_cells(spark, sf_dir)).withColumn("grid", F.sha2("grid", 256))


@query("SELECT p_partkey, CASE WHEN n > 26 THEN chr(CAST(64 + (n - 1) // 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + (n - 1) % 26 AS INTEGER)) AS letters, CAST(n AS INTEGER) AS number FROM (SELECT p_partkey, p_partkey % 702 + 1 AS n FROM part) p")
def column_addresses(spark, sf_dir):
    n = (F.col("p_partkey") % 702 + 1).cast("int")
    p = table(spark, sf_dir, "part").select("p_partkey", formulas.column_letters(n).alias("letters"))
    return p.withColumn("number", formulas.column_number("letters"))


@query(
    """SELECT n_regionkey AS task, arg_min(path, (length(name), name)) AS path FROM (SELECT n_regionkey, n_name || '.xlsx' AS name, 'golden/' || n_name || '.xlsx' AS path FROM nation) f GROUP BY 1"""
)
def golden_solution(spark, sf_dir):
    files = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("task"), F.concat(F.lit("golden/"), "n_name", F.lit(".xlsx")).alias("path"))
    return logs.golden_solution(files, "task", "path", ["golden", "final"])


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) e WHERE n = 1")
def first_seen(spark, sf_dir):
    return selection.first_seen(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id", "event_type"], "event_id")


@query("SELECT o_custkey, arg_min(o_orderkey, (CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, -o_orderkey)) AS best FROM orders GROUP BY 1")
def fallback_match(spark, sf_dir):
    s = F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("best"), F.when(s == "F", 0).when(s == "O", 1).otherwise(2).alias("priority"))
    return selection.ranked_matches(rows, "o_custkey", "priority", "best").select("o_custkey", "best")


@query(
    """SELECT nation, reason, n FROM (SELECT n_name AS nation, CASE WHEN c_acctbal < 0 THEN 'failed' WHEN c_acctbal < 1000 THEN 'empty' ELSE 'no_attempt' END AS reason, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) x"""
)
def reasons_by_priority(spark, sf_dir):
    reason = F.when(F.col("c_acctbal") < 0, "failed").when(F.col("c_acctbal") < 1000, "empty").otherwise("no_attempt")
    joined = table(spark, sf_dir, "customer").join(small(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    order = F.array(F.lit("no_attempt"), F.lit("failed"), F.lit("empty"))
    return joined.groupBy(F.col("n_name").alias("nation"), reason.alias("reason")).agg(F.count("*").alias("n")).orderBy(F.array_position(order, F.col("reason")), "nation")


@query(
    """WITH s AS (SELECT user_id, ts, value, CASE WHEN lag(ts) OVER w IS NULL OR epoch(ts) - epoch(lag(ts) OVER w) >= 1800 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
    SELECT user_id, count(*) AS sessions, max(c) AS longest FROM (SELECT user_id, k, count(*) AS c FROM n GROUP BY ALL) g GROUP BY 1"""
)
def event_sessions(spark, sf_dir):
    from tallyweave.streaming.jobs import sessions

    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions(e, "user_id").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("SELECT conv_id, turn, role, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING)::BIGINT AS context FROM conversations")
def running_context(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn", "text").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.sum(F.length("text")).over(w).alias("context"))


@query(
    """WITH m AS (SELECT user_id, event_id % 40 AS round, event_type AS tag, length(props) AS chars FROM events),
    q AS (SELECT DISTINCT user_id, CAST(user_id % 30 AS BIGINT) AS before_round FROM events)
    SELECT user_id, before_round AS request, min(round) AS first_round, max(round) AS last_round, count(DISTINCT round) AS n_rounds, count(*) AS n_messages, CAST(sum(chars) AS BIGINT) AS chars
    FROM m JOIN q USING (user_id) WHERE tag IN ('click', 'view') AND round > 0 AND round < before_round GROUP BY ALL"""
)
def evicted_rounds(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    messages = e.select("user_id", (F.col("event_id") % 40).alias("round"), F.col("event_type").alias("tag"), F.length("props").alias("chars"))
    asked = e.select("user_id", (F.col("user_id") % 30).alias("before_round")).distinct().withColumn("request", F.col("before_round"))
    return budget.evicted(messages, asked, ["user_id"], ("click", "view"))


@query(
    """WITH f AS (SELECT CASE WHEN l_suppkey % 7 <> 0 THEN l_returnflag END AS category, l_orderkey AS task_id FROM lineitem)
    SELECT category, count(DISTINCT task_id) AS n_tasks, CAST(row_number() OVER (ORDER BY count(DISTINCT task_id) DESC, category) AS INTEGER) AS place FROM f WHERE category IS NOT NULL GROUP BY category"""
)
def category_order(spark, sf_dir):
    return coverage.category_order(table(spark, sf_dir, "lineitem").select(F.when(F.col("l_suppkey") % 7 != 0, F.col("l_returnflag")).alias("category"), F.col("l_orderkey").alias("task_id")))


@query(
    """WITH p AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'agentic' WHEN 1 THEN 'standard' END AS mode, l_returnflag = 'R' AS graded FROM lineitem)
    SELECT 'judge_mode' AS kind, coalesce(mode, 'unknown') AS value, count(*) AS n FROM p GROUP BY 2
    UNION ALL SELECT 'graded', CASE WHEN graded THEN 'graded' ELSE 'to_grade' END, count(*) FROM p GROUP BY 2
    UNION ALL SELECT 'missing', o_orderstatus, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'cells', 'expected', 1200"""
)
def plan_report_counts(spark, sf_dir):
    mode = F.when(F.col("l_linenumber") % 3 == 0, "agentic").when(F.col("l_linenumber") % 3 == 1, "standard")
    plan = table(spark, sf_dir, "lineitem").select(mode.alias("judge_mode"), (F.col("l_returnflag") == "R").alias("graded"))
    return coverage.plan_counts(plan, table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("reason")), 300, 4)


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE n_name END AS name FROM part LEFT JOIN nation ON n_nationkey = p_size AND n_regionkey = p_partkey % 5 WHERE p_partkey % 4 <> 0
    UNION ALL SELECT p_partkey, NULL FROM part WHERE p_partkey % 4 = 0"""
)
def named_checks(spark, sf_dir):
    letters = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("category"), F.col("n_nationkey").alias("letter"), F.col("n_name").alias("name"))
    items = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 5).cast("int").alias("category"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_size")).alias("check"))
    return scoring.named_items(items, letters).select("p_partkey", "name")


@query("SELECT user_id, event_type, count(*) FILTER (value < 60) AS count, bool_or(value >= 60) AS success FROM events GROUP BY ALL HAVING count(*) FILTER (value < 60) > 0")
def parse_failure_summary(spark, sf_dir):
    return scoring.parse_outcomes(table(spark, sf_dir, "events").withColumn("parsed", F.col("value") >= 60), ["user_id", "event_type"])


@query("SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN c_acctbal WHEN c_nationkey % 3 = 1 THEN c_acctbal + 1 END AS score FROM customer")
def aliased_scores(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    scores = F.when(F.col("c_nationkey") % 3 == 0, F.create_map(F.lit("Formula"), "c_acctbal", F.lit("Formulas"), F.lit(0.0))).when(F.col("c_nationkey") % 3 == 1, F.create_map(F.lit("Formulas"), F.col("c_acctbal") + 1)).otherwise(F.create_map(F.lit("Other"), "c_acctbal"))
    return c.select("c_custkey", scoring.first_score(scores, "Formula", "Formulas").alias("score"))


@query(
    CELLS + """, box AS (SELECT workbook, sheet, max(row_) AS n_rows FROM cells GROUP BY ALL),
    q AS (SELECT CAST(s_suppkey AS INTEGER) AS request_id, CAST(s_suppkey % 11 AS VARCHAR) AS workbook, CASE WHEN s_suppkey % 2 = 0 THEN 'F' ELSE 'O' END AS sheet, CAST(s_suppkey * 30 AS INTEGER) AS r1,
      CAST(s_suppkey * 30 + (s_suppkey % 5) * 400 - 100 AS INTEGER) AS r2, CAST(1 + s_suppkey % 2 AS INTEGER) AS c1, CAST(1 + s_suppkey % 3 AS INTEGER) AS c2 FROM supplier),
    e AS (SELECT *, CASE WHEN r2 < r1 THEN 'rows' WHEN c2 < c1 THEN 'columns' WHEN (r2 - r1 + 1) * (c2 - c1 + 1) > 2500 THEN 'size' WHEN n_rows IS NULL THEN 'sheet' WHEN r1 > n_rows THEN 'start' END AS error FROM q LEFT JOIN box USING (workbook, sheet))
    SELECT request_id, CAST(CASE WHEN error IS NULL THEN least(r2, n_rows) ELSE r2 END AS INTEGER) AS r2, error FROM e"""
)
def range_requests(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    asked = s.select(
        key.cast("int").alias("request_id"), (key % 11).cast("string").alias("workbook"), F.when(key % 2 == 0, "F").otherwise("O").alias("sheet"), (key * 30).cast("int").alias("r1"),
        (key * 30 + (key % 5) * 400 - 100).cast("int").alias("r2"), (1 + key % 2).cast("int").alias("c1"), (1 + key % 3).cast("int").alias("c2"),
    )
    kinds = F.when(F.col("error").contains("row range"), "rows").when(F.col("error").contains("column range"), "columns").when(F.col("error").contains("requested range"), "size").when(F.col("error").contains("not found"), "sheet").when(F.col("error").contains("exceeds file"), "start")
    return sheets.requested_ranges(line_cells(spark, sf_dir), asked).select("request_id", "r2", kinds.alias("error"))


@query(
    """WITH m AS (SELECT DISTINCT 'brand-' || p_size || '-' || (p_partkey % 10) AS model, p_size, p_partkey % 10 AS k FROM part)
    SELECT model, CASE WHEN k < 3 THEN model WHEN k < 6 THEN 'house/brand-' || p_size || '.' || k END AS slug, CASE WHEN k < 6 THEN CAST(p_size AS DOUBLE) END AS price FROM m"""
)
def priced_models(spark, sf_dir):
    """Price lists that name some models as they are, some by provider and dotted version, and some not at all."""
    m = table(spark, sf_dir, "part").select("p_size", (F.col("p_partkey") % 10).alias("k")).distinct().withColumn("model", F.concat_ws("-", F.lit("brand"), F.col("p_size").cast("string"), F.col("k").cast("string")))
    dotted = F.concat(F.lit("house/brand-"), F.col("p_size").cast("string"), F.lit("."), F.col("k").cast("string"))
    prices = m.where("k < 6").select(F.when(F.col("k") < 3, F.col("model")).otherwise(dotted).alias("slug"), F.col("p_size").cast("double").alias("price"))
    return budget.priced(m.select("model"), prices, [("brand", "house")])
