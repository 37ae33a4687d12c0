"""Queries over logs, conversations, rubrics, formulas and sheets, seen in the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.functions import formulas, scalars
from tallyweave.functions.evaluation import evaluate
from tallyweave.operators import budget, scoring, sheets, stats, telemetry
from tallyweave.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return register


# --- conversations and events as logs -------------------------------------------------------------------------------


@query(
    """WITH t AS (SELECT conv_id, turn, length(text) AS chars, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, text) AS previous FROM conversations)
    SELECT conv_id, turn, chars, previous, coalesce(chars < previous, false) AS shrank FROM t"""
)
def turn_shrink(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").withColumn("chars", F.length("text"))
    return telemetry.consecutive(t, ["conv_id"], ["turn", "text"], "chars").select("conv_id", "turn", "chars", "previous", "shrank")


@query(
    """WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER w AS r, lag(event_type) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY r) AS INTEGER) AS n FROM e WHERE r = 1 OR event_type IS DISTINCT FROM p"""
)
def snapshot_dedup(spark, sf_dir):
    return telemetry.drop_repeated(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type", "n")


@query(
    """WITH e AS (SELECT user_id, event_id, event_type, value < 50 AS failed, ts FROM events)
    SELECT user_id, event_id, count(*) OVER w = 3 AND min(event_type) OVER w = max(event_type) OVER w AND min(failed::INT) OVER w = 1 AS looping
    FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""
)
def loop_detect(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("failed", F.col("value") < 50)
    return telemetry.loops(e, ["user_id"], ["ts", "event_id"], "event_type", "failed").select("user_id", "event_id", "looping")


@query(
    """WITH e AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN event_type END AS header FROM events)
    SELECT user_id, event_id, last_value(header IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS thread FROM e"""
)
def ffill_thread(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("header", F.when(F.col("event_id") % 4 == 0, F.col("event_type")))
    return telemetry.forward_fill(e, ["user_id"], ["ts", "event_id"], "header", "thread").select("user_id", "event_id", "thread")


@query("SELECT substr(sha256(text), 1, 16) AS blob_id, count(*) AS uses, CAST(any_value(length(text)) AS INTEGER) AS chars FROM documents WHERE length(text) >= 2048 GROUP BY 1")
def blob_dedup(spark, sf_dir):
    return telemetry.blobs(table(spark, sf_dir, "documents"), "text").select("blob_id", "uses", "chars")


@query("SELECT DISTINCT l_partkey AS partkey FROM lineitem EXCEPT SELECT p_partkey FROM part WHERE p_size < 40")
def dangling_refs(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("partkey")).distinct()
    return telemetry.dangling(refs, table(spark, sf_dir, "part").where("p_size < 40").select(F.col("p_partkey").alias("partkey")), "partkey")


@query(
    """WITH c AS (SELECT user_id, event_id AS step, value AS size, lag(value) OVER w AS previous, lag(event_id) OVER w AS previous_step FROM events WHERE event_type <> 'error' WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, step, previous, size FROM c WHERE size < previous AND NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'error' AND e.user_id = c.user_id AND e.event_id > previous_step AND e.event_id < step)"""
)
def unexplained_shrinks(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("step"), F.col("value").alias("size"), "event_type")
    return telemetry.unexplained_shrinks(e.where("event_type <> 'error'").drop("event_type"), e.where("event_type = 'error'").select("user_id", "step"), ["user_id"])


@query("SELECT conv_id, count(*) AS records FROM conversations GROUP BY 1 HAVING count(*) FILTER (role = 'assistant' AND turn >= 3) = 0")
def partial_runs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("type", F.when((F.col("role") == "assistant") & (F.col("turn") >= 3), "end").otherwise("call"))
    return telemetry.without_end(c, ["conv_id"])


@query(
    """SELECT event_type, count(*) AS calls, CAST(sum(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS prompt_tokens, CAST(sum(user_id) AS BIGINT) AS completion_tokens, CAST(sum(length(props)) AS BIGINT) AS chars, round(sum(value), 4) AS cost,
      CASE WHEN sum(CAST(props->>'k' AS BIGINT)) > 0 THEN round(sum(length(props)) / sum(CAST(props->>'k' AS BIGINT)), 2) ELSE 0 END AS chars_per_token FROM events GROUP BY ROLLUP (event_type)"""
)
def token_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("prompt_tokens"), F.col("user_id").alias("completion_tokens"), F.length("props").alias("chars"), F.col("value").alias("cost"))
    return telemetry.token_rollup(e, "event_type").withColumn("cost", F.round("cost", 4))


@query("SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY ALL")
def tool_counts(spark, sf_dir):
    return telemetry.tool_counts(table(spark, sf_dir, "events"), ["user_id"], "event_type")


@query("SELECT user_id, arg_max(value, event_id) AS value, arg_max(CAST(props->>'k' AS BIGINT), event_id) AS k, count(*) AS turns FROM events GROUP BY 1")
def usage_last_snapshot(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return telemetry.usage_totals(e, ["user_id"], "event_id", True, ["value", "k"])


@query(
    """WITH a AS (SELECT l_orderkey AS task, CAST(sum(l_quantity) AS DOUBLE) AS x FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS task, CAST(o_custkey AS DOUBLE) AS x FROM orders)
    SELECT coalesce(a.task, b.task) AS task, coalesce(a.x, 0) AS from_calls, coalesce(b.x, 0) AS from_telemetry FROM a FULL JOIN b ON a.task = b.task WHERE coalesce(a.x, 0) <> coalesce(b.x, 0)"""
)
def reconcile_totals(spark, sf_dir):
    calls = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task"), F.col("l_quantity").cast("double").alias("x"))
    seen = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task"), F.col("o_custkey").cast("double").alias("x"))
    return telemetry.reconcile(calls, seen, ["task"], "x")


@query(
    """SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 900 PRECEDING AND CURRENT ROW) AS in_window,
      count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 900 PRECEDING AND CURRENT ROW) > 8 AS blocked FROM (SELECT user_id, event_id, date_trunc('second', ts) AS ts FROM events) e"""
)
def sliding_rate_limit(spark, sf_dir):
    from tallyweave.streaming.jobs import rate_limit

    return rate_limit(table(spark, sf_dir, "events").withColumn("ts", F.date_trunc("second", F.col("ts").cast("timestamp"))), "user_id", "ts").select("user_id", "event_id", "in_window", "blocked")


@query(
    """WITH l AS (SELECT conv_id, turn, text, role, string_split(text, ' ') AS w FROM conversations), s AS (SELECT conv_id, sum(length(text)) AS chars, sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) AS user_chars FROM l GROUP BY 1)
    SELECT conv_id, CAST(chars AS BIGINT) AS chars, CASE WHEN user_chars / 4000.0 < 0.1 THEN 'low' WHEN user_chars / 4000.0 < 0.2 THEN 'early' WHEN user_chars / 4000.0 < 0.8 THEN 'working' ELSE 'critical' END AS tier FROM s"""
)
def context_pressure(spark, sf_dir):
    s = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars"), F.sum(F.when(F.col("role") == "user", F.length("text")).otherwise(0)).alias("used"))
    return s.select("conv_id", "chars", budget.pressure(F.col("used"), F.lit(4000.0)).alias("tier"))


# --- rubric scoring over order lines: an order is a judgement, ship modes of lines are checks ----------------------------------------------

CHECKS = [(c, f"check{n}", w) for c, ws in (("accuracy", (0.4, 0.3, 0.3)), ("formula", (0.5, 0.25, 0.25))) for n, w in enumerate(ws)]
CATEGORIES = [("accuracy", 0.6), ("formula", 0.4)]


def judged(spark, sf_dir):
    """(grading_id, category, items): an order's lines of odd and even parts are the items of two categories, a row each."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("grading_id"), F.when(F.col("l_partkey") % 2 == 1, "accuracy").otherwise("formula").alias("category"),
        F.array(F.struct(
            F.concat(F.lit("check"), (F.col("l_linenumber") % 4).cast("string")).alias("name"), F.lit("c").alias("check"), F.when(F.col("l_returnflag") == "R", "fail").otherwise("pass").alias("decision"), F.lit("s").alias("summary"),
            F.slice(F.array(*[F.lit("m")] * 6), F.lit(1), (F.col("l_suppkey") % 6).cast("int")).alias("mistakes"), F.when(F.col("l_suppkey") % 3 == 0, (F.col("l_suppkey") % 6).cast("int")).alias("total_mistakes"),
        )).alias("items"),
    )


def scored(spark, sf_dir):
    items = judged(spark, sf_dir)
    counted = scoring.counted(items)
    weights = spark.createDataFrame(CHECKS, "category string, name string, weight double")
    return items, counted, scoring.check_scores(items, counted, weights, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("grading_id")))


JUDGED = f"""WITH items AS (SELECT l_orderkey AS grading_id, CASE WHEN l_partkey % 2 = 1 THEN 'accuracy' ELSE 'formula' END AS category, 'check' || (l_linenumber % 4) AS name,
  CASE WHEN l_returnflag = 'R' AND l_suppkey % 6 = 0 THEN 5 ELSE l_suppkey % 6 END AS m, l_returnflag = 'R' AND l_suppkey % 6 = 0 AS bare,
  CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey % 6 END AS claimed FROM lineitem),
worst AS (SELECT grading_id, category, name, max(m) AS m, count(*) AS times FROM items GROUP BY ALL),
weights(category, name, weight) AS (VALUES {", ".join(f"('{c}', '{n}', CAST({w} AS DOUBLE))" for c, n, w in CHECKS)}),
checks AS (SELECT o_orderkey AS grading_id, w.category, w.name, weight, coalesce(m, 5) AS mistakes, greatest(0, 5 - coalesce(m, 5)) / 5 AS score, m IS NULL AS unscored, coalesce(times, 0) AS times
  FROM orders CROSS JOIN weights w LEFT JOIN worst x ON x.grading_id = o_orderkey AND x.category = w.category AND x.name = w.name),
categories AS (SELECT grading_id, category, sum(score * weight) AS weighted_sum, sum(weight) AS total_weight, sum(score * weight) / sum(weight) * 100 AS normalized, count(*) FILTER (unscored) AS n_unscored FROM checks GROUP BY ALL)"""


@query(JUDGED + " SELECT grading_id, round(sum(normalized * CASE category WHEN 'accuracy' THEN 0.6 ELSE 0.4 END), 6) AS total_score, CAST(sum(n_unscored) AS BIGINT) AS n_unscored FROM categories GROUP BY 1")
def rubric_scores(spark, sf_dir):
    weights = spark.createDataFrame(CATEGORIES, "category string, category_weight double")
    return scoring.total_scores(scoring.category_scores(scored(spark, sf_dir)[2]), weights).withColumn("total_score", F.round("total_score", 6))


@query(
    JUDGED + """ SELECT kind, category, count(*) AS n FROM (
      SELECT 'unscored_check' AS kind, category FROM checks WHERE unscored UNION ALL SELECT 'duplicate_judgement', category FROM checks WHERE times > 1
      UNION ALL SELECT 'mistake_count_mismatch', category FROM items WHERE claimed <> m UNION ALL SELECT 'fail_without_mistakes', category FROM items WHERE bare) w GROUP BY ALL"""
)
def scoring_warnings(spark, sf_dir):
    return scoring.warnings(*scored(spark, sf_dir)).groupBy("kind", "category").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS customer, CASE WHEN c_custkey % 702 < 26 THEN chr(CAST(65 + c_custkey % 702 AS INTEGER)) ELSE chr(CAST(64 + (c_custkey % 702) // 26 AS INTEGER)) || chr(CAST(65 + c_custkey % 26 AS INTEGER)) END AS letter FROM customer")
def check_letters(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), scoring.check_letter((F.col("c_custkey") % 702).cast("int")).alias("letter"))


@query("SELECT p_partkey AS part, p_brand AS brand FROM part p WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 47) l WHERE l_partkey = p_partkey)")
def pending_checks(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand"))
    return scoring.pending(parts, table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 47").select(F.col("l_partkey").alias("part")), ["part"])


@query(
    """WITH v AS (SELECT conv_id, turn, CASE WHEN role IS NULL OR role = 'system' THEN NULL ELSE role END AS decision, CASE WHEN length(text) < 40 THEN NULL ELSE text END AS summary FROM conversations)
    SELECT conv_id, turn, CAST((decision IS NULL)::INT + (summary IS NULL)::INT AS INTEGER) AS n_violations FROM v"""
)
def judgement_validation(spark, sf_dir):
    item = F.struct(F.lit("c").alias("check"), F.when(F.col("role") != "system", F.col("role")).alias("decision"), F.when(F.length("text") >= 40, F.col("text")).alias("summary"))
    return table(spark, sf_dir, "conversations").withColumn("items", F.array(item)).select("conv_id", "turn", F.size(scoring.violations()).alias("n_violations"))


@query(
    """WITH e AS (SELECT user_id, event_type AS letter, event_id AS step, CASE WHEN value >= 30 THEN 'record_check' ELSE 'append_mistake' END AS kind, CAST(props->>'k' AS VARCHAR) AS k FROM events),
    f AS (SELECT user_id, letter, min(step) AS first, arg_max(k, step) AS decision FROM e WHERE kind = 'record_check' GROUP BY ALL)
    SELECT f.user_id, f.letter, decision, (SELECT count(*) FROM e WHERE e.user_id = f.user_id AND e.letter = f.letter AND kind = 'append_mistake' AND step > first)::INTEGER AS n_mistakes FROM f"""
)
def scratchpad_fold(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("letter"), F.col("event_id").alias("step"), F.when(F.col("value") >= 30, "record_check").otherwise("append_mistake").alias("kind"), F.get_json_object("props", "$.k").alias("decision"))
    return scoring.fold_records(e.withColumn("mistake", F.col("decision")), ["user_id", "letter"]).select("user_id", "letter", "decision", F.size("mistakes").alias("n_mistakes"))


# --- formulas and sheets over parts and lines ----------------------------------------------------------------------------------

FORMULA = "concat('=SUM(A', CAST(p_size AS STRING), ':B', CAST(p_size + 3 AS STRING), ')*', CASE p_partkey % 5 WHEN 0 THEN 'VLOOK(C1' WHEN 1 THEN 'ROUND(Sheet2!B2,2)' WHEN 2 THEN concat('B', CAST(p_size + p_partkey % 7 AS STRING)) WHEN 3 THEN '(TAX_RATE+1)' ELSE '\"SUM(\"&IF(D1>2,1,0)' END)"
FORMULA_SQL = FORMULA.replace("AS STRING", "AS VARCHAR").replace('\\"', '"')


def part_formulas(spark, sf_dir):
    """Parts as formulas. They are dealt over tasks first: their file is small, what is done with a formula is not."""
    return table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition("p_partkey").selectExpr("p_partkey", f"{FORMULA} AS formula", "concat('B', CAST(p_size + 1 AS STRING)) AS cell")


@query(f"SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_replace(f, '\"[^\"]*\"', '', 'g'), '\\b([A-Z][A-Z0-9_.]*)\\s*\\(', 1))), ',') AS functions FROM (SELECT p_partkey, {FORMULA_SQL} AS f FROM part) p")
def formula_functions(spark, sf_dir):
    return part_formulas(spark, sf_dir).select("p_partkey", F.array_join(formulas.function_names("formula"), ",").alias("functions"))


@query(
    f"""WITH p AS (SELECT p_partkey, p_size, {FORMULA_SQL} AS f FROM part)
    SELECT p_partkey, CASE WHEN p_partkey % 5 = 2 AND p_partkey % 7 = 1 THEN TRUE ELSE p_size + 1 BETWEEN p_size AND p_size + 3 END AS circular,
      CAST(length(f) - length(replace(f, '(', '')) - (length(f) - length(replace(f, ')', ''))) AS INTEGER) AS paren_balance FROM p"""
)
def circular_and_balance(spark, sf_dir):
    f = part_formulas(spark, sf_dir)
    balance = (F.length("formula") - F.length(F.replace("formula", F.lit("("))) - (F.length("formula") - F.length(F.replace("formula", F.lit(")"))))).cast("int")
    return f.select("p_partkey", formulas.circular("cell", "formula").alias("circular"), balance.alias("paren_balance"))


@query("SELECT p_partkey % 5 AS kind, count(*) AS total, count(*) FILTER (p_partkey % 5 IN (1, 2, 3)) AS valid FROM part GROUP BY 1")
def formula_batch_totals(spark, sf_dir):
    wrong = F.size(formulas.errors("formula"))
    return part_formulas(spark, sf_dir).groupBy((F.col("p_partkey") % 5).alias("kind")).agg(F.count("*").alias("total"), F.count_if(wrong == 0).alias("valid"))


@query(
    f"""WITH p AS (SELECT p_partkey, p_partkey % 5 AS kind, p_partkey % 3 = 0 AS far, 'B' || (p_size + 1) AS own, p_partkey % 5 = 2 AND p_partkey % 7 = 1 AS plain, 'A' || p_size || ':B' || (p_size + 3) AS span FROM part)
    SELECT p_partkey, kind IN (1, 2, 3) AND far AS valid,
      concat_ws('|', CASE WHEN far THEN NULL WHEN kind = 1 AND own = 'B2' THEN 'Suggestion: Remove Sheet2!B2 from the formula or use a cell from a different worksheet (e.g., Assumptions!B2)' WHEN plain THEN 'Suggestion: Remove ' || own || ' from the formula or reference a different cell' ELSE 'Suggestion: Either exclude ' || own || ' from the range ' || span || ' or place the formula in a different cell' END,
      CASE WHEN kind = 3 THEN 'Potential undefined name ''TAX_RATE'' - ensure it''s defined or use cell reference instead' END) AS warnings, CASE WHEN kind = 3 THEN 'TAX_RATE' ELSE '' END AS names FROM p"""
)
def formula_warnings(spark, sf_dir):
    """A third of the formulas stand far from what they refer to, the others within it."""
    f = part_formulas(spark, sf_dir).withColumn("cell", F.when(F.col("p_partkey") % 3 == 0, "Z1").otherwise(F.col("cell")))
    v = f.withColumn("v", formulas.validation("formula", F.col("cell")))
    return v.select("p_partkey", "v.valid", F.array_join("v.warnings", "|").alias("warnings"), F.array_join("v.potential_names", ",").alias("names"))


def line_cells(spark, sf_dir, sheet=None):
    """Lines as cells: a workbook for each tenth order, a row for each order, a column for each line number; sheets by their line status, or named by an expression over workbook, status and row.

    Lines are shuffled once, by the row they lie in, before the last of a cell is picked: what is done row by row afterwards needs no other shuffle."""
    kind = F.when(F.col("l_partkey") % 3 == 0, "string").otherwise("number")
    raw = F.when(F.col("l_suppkey") % 9 == 0, "").when(F.col("l_partkey") % 3 == 0, F.col("l_returnflag")).otherwise(F.col("l_partkey").cast("string"))
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 10).cast("string").alias("workbook"), F.col("l_linestatus").alias("sheet"), F.col("l_orderkey").cast("int").alias("row"), F.col("l_linenumber").cast("int").alias("col"), raw.alias("raw"), kind.alias("v_type"), F.struct("l_partkey", "l_suppkey", "l_shipdate").alias("o"))
    if sheet is not None:
        rows = rows.withColumn("sheet", sheet)
    return rows.repartition("workbook", "sheet", "row").groupBy("workbook", "sheet", "row", "col").agg(F.max_by(F.struct("raw", "v_type"), "o").alias("x")).select("workbook", "sheet", "row", "col", "x.*")


CELLS = """WITH one AS (SELECT CAST(l_orderkey % 10 AS VARCHAR) AS workbook, l_linestatus AS sheet, CAST(l_orderkey AS INTEGER) AS row_, CAST(l_linenumber AS INTEGER) AS col_,
  arg_max(struct_pack(raw := CASE WHEN l_suppkey % 9 = 0 THEN '' WHEN l_partkey % 3 = 0 THEN l_returnflag ELSE CAST(l_partkey AS VARCHAR) END, t := CASE WHEN l_partkey % 3 = 0 THEN 'string' ELSE 'number' END), (l_partkey, l_suppkey, l_shipdate)) AS x FROM lineitem GROUP BY 1, 2, 3, 4),
cells AS (SELECT workbook, sheet, row_, col_, x.raw AS raw, x.t AS v_type FROM one WHERE x.raw <> '')"""


@query(CELLS + " SELECT workbook, sheet, min(row_) AS min_row, max(row_) AS max_row, min(col_) AS min_col, max(col_) AS max_col, count(*) AS n_cells FROM cells GROUP BY ALL")
def used_range(spark, sf_dir):
    return sheets.used_range(line_cells(spark, sf_dir))


@query(
    CELLS + """, box AS (SELECT workbook, sheet, min(row_) AS r1, min(col_) AS c1, max(col_) AS c2 FROM cells GROUP BY ALL),
    texts AS (SELECT workbook, sheet, row_, count(*) AS n FROM cells WHERE v_type = 'string' GROUP BY ALL)
    SELECT workbook, sheet, min(row_) AS header_row FROM texts JOIN box USING (workbook, sheet) WHERE row_ < r1 + 200 AND n >= greatest(1, floor(0.3 * (c2 - c1 + 1))) GROUP BY ALL"""
)
def header_detect(spark, sf_dir):
    return sheets.header_rows(line_cells(spark, sf_dir), 0.3, 200)


@query(
    CELLS + """, types AS (SELECT workbook, sheet, col_, v_type, count(*) AS n, min(row_) AS f FROM cells GROUP BY ALL),
    ex AS (SELECT workbook, sheet, col_, array_to_string(list(raw ORDER BY row_)[1:3], ',') AS examples FROM cells GROUP BY ALL)
    SELECT workbook, sheet, col_ AS col, arg_max(v_type, (n, -f)) AS type, CAST(sum(n) AS BIGINT) AS non_null, any_value(examples) AS examples FROM types JOIN ex USING (workbook, sheet, col_) GROUP BY ALL"""
)
def column_profile(spark, sf_dir):
    return sheets.column_profile(line_cells(spark, sf_dir)).withColumn("examples", F.array_join("examples", ","))


@query(CELLS + " SELECT workbook, sheet, row_ AS row, col_ AS col, raw FROM cells WHERE contains(lower(raw), '77') ORDER BY workbook, sheet, row_, col_ LIMIT 100")
def search_text(spark, sf_dir):
    return sheets.search(line_cells(spark, sf_dir), "77").select("workbook", "sheet", "row", "col", "raw")


@query(
    CELLS + """, ranges AS (SELECT CAST(s_suppkey AS INTEGER) AS range_id, CAST(s_suppkey % 10 AS VARCHAR) AS workbook, CASE WHEN s_suppkey % 2 = 0 THEN 'F' ELSE 'O' END AS sheet, CAST(s_suppkey * 20 AS INTEGER) AS r1, CAST(s_suppkey * 20 + 900 AS INTEGER) AS r2, 2 AS c1, 4 AS c2 FROM supplier)
    SELECT range_id, count(*) AS n FROM cells JOIN ranges USING (workbook, sheet) WHERE row_ BETWEEN r1 AND r2 AND col_ BETWEEN c1 AND c2 GROUP BY 1"""
)
def range_lookup(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    at = (F.col("s_suppkey") * 20).cast("int")
    ranges = s.select(F.col("s_suppkey").cast("int").alias("range_id"), (F.col("s_suppkey") % 10).cast("string").alias("workbook"), F.when(F.col("s_suppkey") % 2 == 0, "F").otherwise("O").alias("sheet"), at.alias("r1"), (at + 900).alias("r2"), F.lit(2).alias("c1"), F.lit(4).alias("c2"))
    return sheets.in_ranges(sheets.filled(line_cells(spark, sf_dir)), ranges).groupBy("range_id").agg(F.count("*").alias("n"))


@query(
    """WITH w AS (SELECT lang AS key, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 2)) AS word, 1 AS weight FROM documents
      UNION ALL SELECT 'benchmark', unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 2)), 3 FROM benchmark),
    s AS (SELECT * FROM w UNION ALL SELECT key, left(word, length(word) - 1), weight FROM w WHERE word LIKE '%s' AND length(word) > 3),
    t AS (SELECT key, word, CAST(sum(weight) AS BIGINT) AS weight FROM s GROUP BY ALL)
    SELECT key, word, weight FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY weight DESC, word) AS n FROM t) x WHERE n <= 60"""
)
def token_keywords(spark, sf_dir):
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").withColumn("key", F.lit("benchmark"))
    return sheets.keywords([(docs, "lang", "text", 1), (bench, "key", "text", 3)])


@query(
    # No two orders of a workbook have neighbouring keys (they differ by 10 or more), so its blocks are runs along one row.
    CELLS + """, runs AS (SELECT workbook, sheet, row_, col_, col_ - row_number() OVER (PARTITION BY workbook, sheet, row_ ORDER BY col_) AS run FROM cells)
    SELECT workbook, sheet, row_ AS r1, CAST(min(col_) AS INTEGER) AS c1, row_ AS r2, CAST(max(col_) AS INTEGER) AS c2 FROM runs GROUP BY workbook, sheet, row_, run"""
)
def contiguous_blocks(spark, sf_dir):
    return sheets.blocks(line_cells(spark, sf_dir))


@query(
    CELLS + """, n AS (SELECT workbook, sheet, row_, CAST(sum(CASE WHEN v_type = 'number' THEN CAST(raw AS BIGINT) END) AS BIGINT) AS total FROM cells GROUP BY ALL),
    v AS (SELECT workbook, sheet || '-' || (row_ // 1000) AS sheet, row_ AS "row", coalesce(total, 0) * 2 AS twice FROM n)
    SELECT workbook, sheet, "row", 10 AS col, CAST(twice AS VARCHAR) AS value FROM v
    UNION ALL SELECT workbook, sheet, "row", 11, CASE WHEN twice > 100000 THEN 'a=b' ELSE 'x<>y' END FROM v"""
)
def formula_evaluation(spark, sf_dir):
    """Two formulas beside each row, the second over the first; a sheet holds the orders of a thousand keys, so sheets do not grow with the table."""
    cells = line_cells(spark, sf_dir, F.concat_ws("-", "sheet", (F.col("row") / 1000).cast("int").cast("string"))).select("workbook", "sheet", "row", "col", "raw")
    made = lambda col, *raw: F.struct(F.lit(col).alias("col"), F.concat(*raw).alias("raw"))
    at = F.col("row").cast("string")
    return evaluate(sheets.behind_rows(cells, made(10, F.lit("=SUM(A"), at, F.lit(":G"), at, F.lit(")*2")), made(11, F.lit("=IF(J"), at, F.lit('>100000,"a=b","x<>y")'))))


# --- texts -------------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, length(regexp_replace(regexp_replace(replace(text, ' ', ','), ',{2,}', ',', 'g'), '(?m),+$', '', 'g')) AS cleaned FROM documents")
def clean_commas(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length(budget.clean_commas(F.replace("text", F.lit(" "), F.lit(",")))).cast("bigint").alias("cleaned"))


@query(
    """WITH l AS (SELECT page_id, string_split(regexp_replace(html, '\\n+$', ''), chr(10)) AS x, html FROM pages)
    SELECT page_id, CAST(length(CASE WHEN len(x) > 8 THEN array_to_string(list_concat(x[1:4], ['[Rows 5-' || (len(x) - 2) || ' redacted (' || (len(x) - 6) || ' rows)]'], x[-2:]), chr(10)) ELSE html END) AS BIGINT) AS chars FROM l"""
)
def row_redaction(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length(budget.redact_rows("html", 4, 2, 8)).cast("bigint").alias("chars"))


@query(None)
def shortened_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("name"), F.replace("text", F.lit(" "), F.lit(",")).alias("text"))
    return budget.shorten(docs, "source", 60_000).groupBy("source").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("files"))


@query(
    """SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, substr(sha256(c_name), 1, 16) AS blob_id, round(c_acctbal / 60, 4) AS minutes,
      CASE WHEN c_acctbal > 0 THEN TRUE ELSE FALSE END AS positive FROM customer"""
)
def scalar_functions(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.slug("c_name").alias("slug"), scalars.blob_id("c_name").alias("blob_id"), scalars.minutes(F.col("c_acctbal"), 4).alias("minutes"), (F.col("c_acctbal") > 0).alias("positive"))


@query("SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS mean, round(median(n_chars), 6) AS median FROM documents GROUP BY 1")
def text_length_stats(spark, sf_dir):
    d = stats.stat_summary(table(spark, sf_dir, "documents"), ["lang"], "n_chars")
    return d.select("lang", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))
