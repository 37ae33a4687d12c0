"""Queries over whole workbooks (candidates of tasks, texts in segments, checks of solutions) and reports over evaluation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.operators import candidates, grid, reports, selection, sheets, telemetry
from tallyweave.plans.log_queries import CELLS, line_cells
from tallyweave.sources.evaluation import evaluation, oracle_with
from tallyweave.sources.tables import table, written

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return register


def solution_cells(spark, sf_dir):
    """Lines as cells, with a formula behind each row of the sheets F; the sheets O are the unanswered questions."""
    named = F.when(F.col("sheet") == "O", F.concat(F.lit("Q"), "workbook")).otherwise(F.col("sheet"))
    cells = line_cells(spark, sf_dir, named).withColumn("cached", F.lit(None).cast("string"))
    row = F.col("row").cast("string")
    own = F.when(F.col("row") % 3 == 0, F.concat(F.lit("=A"), row, F.lit("+H"), row)).when(F.col("row") % 3 == 1, F.concat(F.lit("=F!H"), row)).otherwise(F.concat(F.lit("=SUM(A"), row, F.lit(":G"), row, F.lit(")")))
    made = F.struct(F.lit(8).alias("col"), own.alias("raw"), F.lit("number").alias("v_type"), F.when(F.col("row") % 2 == 0, row).alias("cached"))
    return sheets.behind_rows(cells, made, where=F.col("sheet") == "F")


SOLUTION = CELLS + """, named AS (SELECT workbook, CASE sheet WHEN 'O' THEN 'Q' || workbook ELSE sheet END AS sheet, row_, col_, raw, v_type, CAST(NULL AS VARCHAR) AS cached FROM cells),
f AS (SELECT DISTINCT workbook, sheet, row_, 8 AS col_, CASE row_ % 3 WHEN 0 THEN '=A' || row_ || '+H' || row_ WHEN 1 THEN '=F!H' || row_ ELSE '=SUM(A' || row_ || ':G' || row_ || ')' END AS raw, 'number' AS v_type, CASE WHEN row_ % 2 = 0 THEN CAST(row_ AS VARCHAR) END AS cached FROM named WHERE sheet = 'F'),
solution AS (SELECT * FROM named UNION ALL SELECT * FROM f)"""


@query(
    SOLUTION + """, texts AS (SELECT workbook, sheet, row_, '  ' || string_agg(chr(64 + col_) || row_ || ': ' || CASE WHEN raw LIKE '=%' THEN raw || ' ' || coalesce('[=' || cached || ']', '[formula]') WHEN v_type = 'number' THEN raw || ' [number]' ELSE '"' || raw || '" [text]' END, ' | ' ORDER BY col_) || chr(10) AS line FROM solution GROUP BY ALL)
    SELECT workbook, sheet, CAST(row_ // 256 AS INTEGER) AS segment, sha256(string_agg(line, '' ORDER BY row_)) AS text FROM texts GROUP BY ALL
    UNION ALL SELECT workbook, sheet, -1, sha256(chr(10) || '=== WORKSHEET: ' || sheet || ' ===' || chr(10) || 'Used Range: A1:' || chr(64 + max(col_)) || max(row_) || chr(10)) FROM solution GROUP BY workbook, sheet"""
)
def grid_segments(spark, sf_dir):
    return grid.segments(solution_cells(spark, sf_dir)).withColumn("text", F.sha2("text", 256))


@query(
    SOLUTION + """, n AS (SELECT workbook, count(DISTINCT sheet) AS worksheets, count(*) FILTER (raw LIKE '=%') AS formulas, count(*) FILTER (raw LIKE '=%' AND row_ % 3 < 2) AS self_references FROM solution GROUP BY 1)
    SELECT *, (SELECT count(DISTINCT sheet) FROM solution s WHERE s.workbook = n.workbook AND sheet LIKE 'Q%') AS unanswered FROM n"""
)
def solution_report(spark, sf_dir):
    cells = sheets.filled(solution_cells(spark, sf_dir))
    return grid.solution_report(cells.select("workbook", "sheet").distinct(), cells)


WORDS = "unnest(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: length(x) >= 2))"


@query(
    f"""WITH d AS (SELECT lang AS workbook, source AS sheet, doc_id, text FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL),
    plain AS (SELECT workbook, sheet, doc_id, {WORDS.format("text")} AS word, 1 AS weight FROM d UNION ALL SELECT DISTINCT workbook, sheet, NULL, {WORDS.format("sheet")}, 3 FROM (SELECT DISTINCT workbook, sheet FROM d) s),
    w AS (SELECT * FROM plain UNION ALL SELECT workbook, sheet, doc_id, left(word, length(word) - 1), weight FROM plain WHERE word LIKE '%s' AND length(word) > 3),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY workbook, sheet ORDER BY n DESC, word) - 1 AS place FROM (SELECT workbook, sheet, word, sum(weight) AS n FROM w GROUP BY ALL) x),
    k AS (SELECT workbook, sheet AS other, word, CAST(place // 20 AS INTEGER) AS block, place FROM ranked WHERE place < 60),
    h AS (SELECT workbook, other, block, place, word AS name, word FROM k UNION ALL SELECT workbook, other, block, place, word, left(word, length(word) - 1) FROM k WHERE word LIKE '%s' AND length(word) > 3),
    t AS (SELECT DISTINCT workbook, sheet, doc_id, word FROM w WHERE doc_id IS NOT NULL),
    others AS (SELECT t.workbook, t.sheet, doc_id, other, count(*) AS score, list_sort(list(word))[1:10] AS matched FROM t JOIN k USING (workbook, word) WHERE other <> t.sheet GROUP BY ALL),
    hits AS (SELECT t.workbook, t.sheet, doc_id, other, block, count(DISTINCT word) AS n FROM t JOIN h USING (workbook, word) GROUP BY ALL),
    best AS (SELECT workbook, sheet, doc_id, other, max(n) AS n, arg_max(block, n * 100 - block) AS block FROM hits GROUP BY ALL),
    found AS (SELECT workbook, sheet, doc_id, other, score, matched, FALSE AS own FROM others UNION ALL SELECT workbook, sheet, doc_id, other, n, NULL, TRUE FROM best WHERE other = sheet),
    top AS (SELECT *, CAST(row_number() OVER (PARTITION BY workbook, sheet, doc_id ORDER BY score DESC, own, other) AS INTEGER) AS rank FROM found QUALIFY rank <= 5),
    shown AS (SELECT workbook, sheet, doc_id, other, block, list(name ORDER BY place)[1:6] AS names FROM (SELECT DISTINCT t.workbook, t.sheet, t.doc_id, h.other, h.block, name, place FROM t JOIN h USING (workbook, word) JOIN best b ON b.workbook = t.workbook AND b.sheet = t.sheet AND b.doc_id = t.doc_id AND b.other = h.other AND b.block = h.block) x GROUP BY ALL)
    SELECT p.workbook, p.sheet, p.doc_id, rank, p.other AS candidate, CAST(score AS INTEGER) AS score, array_to_string(matched, ',') AS matched, b.block, array_to_string(names, ',') AS header_matches
    FROM top p LEFT JOIN best b USING (workbook, sheet, doc_id, other) LEFT JOIN shown s ON s.workbook = p.workbook AND s.sheet = p.sheet AND s.doc_id = p.doc_id AND s.other = p.other AND s.block = b.block"""
)
def task_candidates(spark, sf_dir):
    """Every document as a task text of the sheet that is its source, in the workbook that is its language; a sheet's sixty keywords, twenty by twenty, are the headers of its blocks."""
    docs = table(spark, sf_dir, "documents").where("lang IS NOT NULL AND source IS NOT NULL").select(F.col("lang").alias("workbook"), F.col("source").alias("sheet"), "doc_id", "text")
    key = docs.withColumn("key", F.to_json(F.struct("workbook", "sheet")))
    titles = key.select("key", "sheet").distinct()
    heaviest = written(sheets.keywords([(key, "key", "text", 1), (titles, "key", "sheet", 3)]), "keywords")
    listed = heaviest.groupBy("key").agg(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("minus"), "word"))).alias("words")).select("key", F.posexplode("words").alias("place", "x"))
    words = listed.select(F.from_json("key", "workbook string, sheet string").alias("k"), "place", F.col("x.word").alias("word")).select("k.*", "place", "word")
    headers = words.select("workbook", "sheet", (F.col("place") / 20).cast("int").alias("block"), "place", F.col("word").alias("name"))
    out = candidates.task_candidates(docs, words, headers, "doc_id")
    return out.withColumns({c: F.array_join(c, ",") for c in ("matched", "header_matches")})


@query(
    CELLS + """, ranges AS (SELECT CAST(s_suppkey AS INTEGER) AS range_id, CAST(s_suppkey % 10 AS VARCHAR) AS workbook, CASE WHEN s_suppkey % 2 = 0 THEN 'F' ELSE 'O' END AS sheet, CAST(s_suppkey * 20 AS INTEGER) AS r1, CAST(s_suppkey * 20 + 900 AS INTEGER) AS r2, CAST(2 + s_suppkey % 3 AS INTEGER) AS c1, CAST(3 + s_suppkey % 3 AS INTEGER) AS c2 FROM supplier),
    hit AS (SELECT workbook, sheet, row_, col_, min(range_id) AS range_id FROM cells JOIN ranges USING (workbook, sheet) WHERE row_ BETWEEN r1 AND r2 AND col_ BETWEEN c1 AND c2 GROUP BY ALL)
    SELECT c.workbook, c.sheet, c.row_ AS row, c.col_ AS col, h.range_id, chr(64 + c1) || r1 || ':' || chr(64 + c2) || r2 AS merged, c.row_ = r1 AND c.col_ = c1 AS is_shown
    FROM cells c LEFT JOIN hit h USING (workbook, sheet, row_, col_) LEFT JOIN ranges r ON r.range_id = h.range_id"""
)
def merged_cells(spark, sf_dir):
    k = F.col("s_suppkey").cast("int")
    ranges = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 10).cast("string").alias("workbook"), F.when(k % 2 == 0, "F").otherwise("O").alias("sheet"), k.alias("range_id"), (k * 20).alias("r1"), (2 + k % 3).alias("c1"), (k * 20 + 900).alias("r2"), (3 + k % 3).alias("c2"))
    return sheets.with_merged(sheets.filled(line_cells(spark, sf_dir)), ranges).drop("raw", "v_type")


VALID = "a.failed IS NOT TRUE AND a.deprecated IS NOT TRUE"


@query(
    oracle_with("tasks", "attempts") + f""", done AS (SELECT a.agent, count(DISTINCT a.task_id) AS done FROM attempts a WHERE {VALID} AND a.task_id IN (SELECT task_id FROM tasks) GROUP BY 1)
    SELECT r.agent, coalesce(done, 0) AS done, t.total, CAST(round_even(coalesce(done, 0) / t.total * 100, 0) AS INTEGER) AS rate FROM (SELECT DISTINCT agent FROM attempts) r LEFT JOIN done USING (agent), (SELECT count(DISTINCT task_id) AS total FROM tasks) t"""
)
def completion_matrix(spark, sf_dir):
    tasks, attempts = evaluation(spark, sf_dir, "tasks"), evaluation(spark, sf_dir, "attempts")
    return reports.completion_matrix(tasks, attempts, attempts.where(selection.not_true("failed") & selection.not_true("deprecated")))


@query(
    oracle_with("tasks", "attempts") + f""", bad AS (SELECT task_id, agent, CASE WHEN failed THEN 'failed' ELSE 'deprecated' END AS reason, min(attempt_id) AS first_at FROM attempts a WHERE NOT ({VALID}) GROUP BY 1, 2, 3),
    reasons AS (SELECT task_id, agent, string_agg(reason, ', ' ORDER BY first_at, reason) AS reasons FROM bad GROUP BY 1, 2)
    SELECT r.agent, t.task_id, coalesce(reasons, '') AS reasons FROM (SELECT DISTINCT task_id FROM tasks) t CROSS JOIN (SELECT DISTINCT agent FROM attempts) r LEFT JOIN reasons USING (task_id, agent)
    WHERE NOT EXISTS (SELECT 1 FROM attempts a WHERE a.task_id = t.task_id AND a.agent = r.agent AND {VALID})"""
)
def missing_with_reasons(spark, sf_dir):
    tasks, attempts = evaluation(spark, sf_dir, "tasks"), evaluation(spark, sf_dir, "attempts")
    valid = selection.not_true("failed") & selection.not_true("deprecated")
    invalid = attempts.where(~valid).withColumn("reason", F.when(F.col("failed"), "failed").otherwise("deprecated"))
    return reports.missing_with_reasons(tasks, attempts, attempts.where(valid), invalid).withColumn("reasons", F.array_join("reasons", ", "))


@query(
    oracle_with("tasks", "attempts", "gradings") + """ SELECT agent, prompt_version, task_source, count(*) AS n, round(avg(accuracy), 6) AS accuracy, count(DISTINCT task_name) AS n_tasks
    FROM gradings g JOIN attempts a USING (attempt_id) JOIN tasks t ON t.task_id = a.task_id GROUP BY ALL"""
)
def graded_attempts(spark, sf_dir):
    rows = selection.graded_attempts(*(evaluation(spark, sf_dir, n) for n in ("gradings", "attempts", "tasks")))
    return rows.groupBy("agent", "prompt_version", "task_source").agg(F.count("*").alias("n"), F.round(F.avg("accuracy"), 6).alias("accuracy"), F.count_distinct("task_name").alias("n_tasks"))


BATCHES = "SELECT source AS batch, CAST(doc_id AS VARCHAR) AS workspace, CASE WHEN lang IS NULL THEN 'error' ELSE 'success' END AS status, n_chars % 7 AS iterations, n_chars AS tokens, n_chars // 100 AS cents, n_chars % 60 AS seconds, CASE WHEN lang IS NULL THEN 'no language' END AS error FROM documents"


def batches(spark, sf_dir):
    d, n = table(spark, sf_dir, "documents"), F.col("n_chars")
    return d.select(F.col("source").alias("batch"), F.col("doc_id").cast("string").alias("workspace"), F.when(F.col("lang").isNull(), "error").otherwise("success").alias("status"), (n % 7).alias("iterations"), n.alias("tokens"), F.floor(n / 100).alias("cost"), (n % 60).alias("seconds"), F.when(F.col("lang").isNull(), "no language").alias("error"))


@query(
    f"""SELECT batch, count(*) AS workspaces, count(*) FILTER (status = 'success') AS successful, count(*) FILTER (status <> 'success') AS failed, coalesce(CAST(sum(iterations) AS BIGINT), 0) AS iterations, coalesce(CAST(sum(tokens) AS BIGINT), 0) AS tokens, coalesce(CAST(sum(cents) AS BIGINT), 0) AS cost, coalesce(CAST(sum(seconds) AS BIGINT), 0) AS seconds
    FROM ({BATCHES}) b GROUP BY 1"""
)
def batch_totals(spark, sf_dir):
    return reports.batch_totals(batches(spark, sf_dir), ["batch"])


@query(
    f"""WITH b AS ({BATCHES}), lines AS (SELECT batch, workspace, unnest(list_filter(['### ' || CASE WHEN status = 'success' THEN '✅' ELSE '❌' END || ' ' || workspace, '- **Status**: ' || status, '- **Iterations**: ' || coalesce(iterations, 0), '- **Tokens**: ' || format('{{:,}}', coalesce(tokens, 0)),
      '- **Cost**: ' || printf('$%.4f', CAST(coalesce(cents, 0) AS DOUBLE)), '- **Duration**: ' || printf('%.2fs', CAST(coalesce(seconds, 0) AS DOUBLE)), '- **Error**: ' || error], lambda x: x IS NOT NULL)) AS line FROM b)
    SELECT batch, line, count(*) AS n FROM lines GROUP BY ALL"""
)
def batch_report(spark, sf_dir):
    """The lines of the workspaces' sections and how often each batch has them."""
    rows = batches(spark, sf_dir)
    return reports.batch_report(rows, reports.batch_totals(rows, ["batch"]), ["batch"]).where("place >= 0").groupBy("batch", "line").agg(F.count("*").alias("n"))


@query(
    SOLUTION + """ SELECT workbook, sheet, min(row_) AS min_row, max(row_) AS max_row, CAST(min(col_) AS INTEGER) AS min_col, CAST(max(col_) AS INTEGER) AS max_col, count(*) AS n_cells, count(*) FILTER (raw LIKE '=%') AS n_formulas,
      chr(CAST(64 + min(col_) AS INTEGER)) || min(row_) || ':' || chr(CAST(64 + max(col_) AS INTEGER)) || max(row_) AS used_range FROM solution GROUP BY workbook, sheet"""
)
def sheet_info(spark, sf_dir):
    return sheets.sheet_info(solution_cells(spark, sf_dir))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events")
def numbered_steps(spark, sf_dir):
    return telemetry.numbered(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")
