"""Operators that no SQL row proves, on small tables with NULLs, ties and repeats."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import evaluation, formulas, scalars
from tallyweave.operators import budget, coverage, rules, scoring, selection, sheets, telemetry
from tallyweave.sources import logs, sinks


def test_files_of_any_shape_and_workbooks_of_any_kind(spark):
    files = ["a/b.XLSM", '["x/y.xls", "n.txt"]', '[{"filename": "f.xlsx", "url": "u"}, {"name": "g.pdf"}]', '{"name": "n.xlsb"}', None, "null", "[]"]
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(files)], "i int, files string")
    got = rows.orderBy("i").select(selection.file_names(), F.size(F.filter(selection.file_names(), selection.is_workbook)).alias("books")).collect()
    assert [r[0] for r in got] == [["b.XLSM"], ["y.xls", "n.txt"], ["f.xlsx", "g.pdf"], ["n.xlsb"], [], [], []]
    assert [r.books for r in got] == [1, 1, 1, 0, 0, 0, 0]


def test_formula_validation(spark):
    rows = [("=SUM(A1:A3)", "B1", "S"), ("=B1+1", "B1", "S"), ("=S!B1+1", "B1", "S"), ("=T!B1+1", "B1", "S"), ("=SUM(A1:C3)", "B2", "S"), ("=SUMPMT(A1)", "B1", None), ("=TAX*[2", "B1", None), ("SUM(A1)", "B1", None), ("=", "B1", None), (None, "B1", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, f string, c string, s string")
    v = [r.v for r in df.orderBy("i").select(formulas.validation("f", F.col("c"), F.col("s")).alias("v")).collect()]
    assert v[0].valid and v[0].warnings == [] and v[0].functions_used == ["SUM"]
    assert v[1].errors == ["CIRCULAR REFERENCE DETECTED: Cell B1 references itself directly in formula"] and v[1].warnings == ["Suggestion: Remove B1 from the formula or reference a different cell"]
    assert v[2].errors == ["CIRCULAR REFERENCE DETECTED: Cell S!B1 references itself via S!B1"] and v[3].valid
    assert v[4].errors == ["CIRCULAR REFERENCE DETECTED: Cell B2 is within range A1:C3 referenced in its own formula"]
    assert v[5].errors == ["Invalid function 'SUMPMT': Use CUMIPMT for cumulative interest, or PMT for payment amount"]
    assert v[6].errors == ["Unbalanced brackets: 1 extra opening"] and v[6].potential_names == ["TAX"] and "'TAX'" in v[6].warnings[0]
    assert v[7].errors == ["Formula must start with '='"] and v[7].warnings == [] and v[8].errors == ["Formula is empty (only '=')"]


def test_evaluation_of_texts_chains_and_loops(spark):
    cells = [(1, 1, "5"), (2, 1, '="x=y"'), (3, 1, '=IF(A1=5,"a<>b^c","=")'), (4, 1, "=A5+1"), (5, 1, "=A4+1"), (6, 1, "=SUM(A1:A5)"), (7, 1, '=A2="x=y"'), (8, 1, "=A9*2"), (9, 1, "=A1^2")]
    cells += [(r, 2, "1" if r == 1 else f"=B{r - 1}+1") for r in range(1, 3_001)]
    expected = {(2, 1): "x=y", (3, 1): "a<>b^c", (4, 1): None, (5, 1): None, (6, 1): None, (7, 1): "True", (8, 1): "50", (9, 1): "25", (3_000, 2): "3000"}
    for order in (cells, cells[::-1]):
        df = spark.createDataFrame([("w", "s", *c) for c in order], "workbook string, sheet string, row int, col int, raw string")
        got = {(r.row, r.col): r.value for r in evaluation.evaluate(df).collect()}
        assert {k: got[k] for k in expected} == expected


def test_sizeless_calls_are_no_evictions(spark):
    calls = spark.createDataFrame([("r", 1, 9), ("r", 2, None), ("r", 3, 5), ("r", 5, 2)], "run string, step int, size int")
    evictions = spark.createDataFrame([("r", 4)], "run string, step int")
    assert [(r.step, r.previous) for r in telemetry.unexplained_shrinks(calls, evictions, ["run"]).collect()] == [(3, 9)]


def test_json_udfs_in_spark(spark):
    df = spark.createDataFrame([('x ```json\n{"a": 1}\n```',), ("{a: 'b',}",), ('{"a": 1}{"b": 2}',), (None,), ("none",)], "t string")
    got = df.select(scalars.json_of("t"), scalars.repaired_json("t"), scalars.json_objects("t")).collect()
    assert json.loads(got[0][0]) == {"a": 1} and json.loads(got[1][1]) == {"a": "b"} and [json.loads(x) for x in got[2][2]] == [{"a": 1}, {"b": 2}]
    assert (got[3][0], got[3][1], got[3][2]) == (None, None, []) and got[4][0] is None
    shown = spark.createDataFrame([(1234.5, "#,##0.0"), (0.5, "0%"), (None, "0"), (1.0, None)], "x double, f string").select(scalars.rendered_number("x", "f").alias("s")).collect()
    assert [r.s for r in shown][:2] == ["1,234.5", "50%"] and shown[2].s is None


def test_scalars_without_rows_of_their_own(spark):
    r = spark.range(1).select(
        scalars.database_name(F.lit("postgresql://u:p@h:5432/db?x=1")).alias("db"), scalars.has_secret(F.lit("key sk-proj-abcdefgh12")).alias("secret"), scalars.first_workbook(F.array(F.lit("a.txt"), F.lit("B.XLSX"))).alias("book"),
        scalars.sse_events(F.lit("event: ping\ndata: {}\nevent: done\n")).alias("sse"), scalars.most_output_tokens(F.lit('{"output_tokens": 5}{"output_tokens": 70}')).alias("tokens"),
        scalars.overflow_message(F.lit("The prompt is too long: 9 > 8")).alias("over"), scalars.percent(F.lit(1), F.lit(8)).alias("pct"), scalars.percent(F.lit(1), F.lit(0)).alias("none"),
        F.array(*(scalars.value_type(F.lit(x)) for x in ("null", "true", "-1.5e3", "x"))).alias("types"),
    ).first()
    assert r.secret and r.book == "B.XLSX" and r.sse == ["ping", "done"] and r.tokens == 70 and r.over and (r.pct, r.none) == ("12.5%", "-") and r.types == ["null", "bool", "number", "string"]
    assert "db" in r.db


def test_letters_names_and_reasons(spark):
    rubric = spark.createDataFrame([("c", i, f"n{i}") for i in range(28)] + [("d", 5, "only")], "category string, position int, name string")
    letters = scoring.lettered(rubric)
    got = {(r.category, r.position): r.letter for r in letters.collect()}
    assert (got["c", 0], got["c", 25], got["c", 26], got["c", 27], got["d", 5]) == ("A", "Z", "AA", "AB", "A")
    items = spark.createDataFrame([("c", "B"), ("c", "ZZ"), ("d", None)], "category string, check string")
    assert {(r.category, r.check, r.name) for r in scoring.named_items(items, letters).collect()} == {("c", "B", "n1"), ("c", "ZZ", None), ("d", None, None)}
    tries = spark.createDataFrame([("k", False), ("k", True), ("l", False), ("l", None), ("m", True)], "key string, parsed boolean")
    assert {(r.key, r["count"], r.success) for r in scoring.parse_outcomes(tries, ["key"]).collect()} == {("k", 1, True), ("l", 2, False)}
    scores = spark.range(1).select(F.create_map(F.lit("Formulas"), F.lit(3.0)).alias("m"))
    assert scores.select(scoring.first_score("m", "Formula", "Formulas").alias("a"), scoring.first_score("m", "Format").alias("b")).first() == (3.0, None)
    results = spark.createDataFrame([(True, 0, False, 0), (False, 2, False, 0), (False, 0, True, 1)], "success boolean, parse_failures int, scores_missing boolean, n_warnings int")
    rows = sinks.grading_rows(results).collect()
    assert [r.failed for r in rows] == [r.failed_reason is not None for r in rows] and not rows[0].failed and rows[1].failed and rows[2].failed


def test_budgets_without_rows_of_their_own(spark):
    r = spark.createDataFrame([(10_000,), (500,)], "total int").select(budget.budget_split(F.col("total")).alias("s")).collect()
    assert all(x.s is not None for x in r)
    assert spark.range(1).select(budget.chars_per_token(F.lit(10), F.lit(4)).alias("a"), budget.chars_per_token(F.lit(10), F.lit(0)).alias("b")).first() == (2.5, 2.5)
    messages = spark.createDataFrame([("a", 0, "tool_result", 5), ("a", 1, "tool_result", 7), ("a", 1, "model_tool_call", 1), ("a", 2, "user", 9), ("a", 3, "tool_result", 4)], "run string, round int, tag string, chars int")
    asked = spark.createDataFrame([("a", 1, 3), ("a", 2, 9), ("a", 3, 1)], "run string, request int, before_round int")
    got = {r.request: (r.first_round, r.last_round, r.n_rounds, r.n_messages, r.chars) for r in budget.evicted(messages, asked, ["run"]).collect()}
    assert got == {1: (1, 1, 1, 2, 8), 2: (1, 3, 2, 3, 12)}
    models = spark.createDataFrame([("brand-x-4-8",), ("other/m-1-2",), ("new",), (None,)], "model string")
    slugs = [r.s for r in models.select(budget.model_slugs("model", [("brand", "house"), ("n", "nn")]).alias("s")).collect()]
    assert slugs == [["brand-x-4-8", "brand-x-4.8", "house/brand-x-4-8", "house/brand-x-4.8"], ["other/m-1-2", "other/m-1.2"], ["new", "nn/new"], []]


def test_ranges_that_are_clamped_or_refused(spark):
    cells = spark.createDataFrame([("w", "s", r, c, "x") for r in range(1, 11) for c in (1, 2)], "workbook string, sheet string, row int, col int, raw string")
    asked = [(1, "s", 2, 1, 99, 2), (2, "s", 5, 1, 4, 2), (3, "s", 1, 3, 2, 2), (4, "s", 1, 1, 3_000, 2), (5, "t", 1, 1, 2, 2), (6, "s", 11, 1, 12, 1), (7, "s", None, 1, 2, 1), (8, "s", 0, 1, 2, 1)]
    rows = {r.request_id: r for r in sheets.requested_ranges(cells, spark.createDataFrame([(a[0], "w", *a[1:]) for a in asked], "request_id int, workbook string, sheet string, r1 int, c1 int, r2 int, c2 int")).collect()}
    assert rows[1].error is None and rows[1].r2 == 10 and rows[2].error.startswith("Error: Invalid row range 5-4.") and rows[3].error.startswith("Error: Invalid column range C-B.")
    assert "6000 cells (3000 rows x 2 cols), which exceeds the 2500-cell" in rows[4].error and "not found" in rows[5].error and rows[6].error == "Error: start_row 11 exceeds file row count (10)."
    assert "required" in rows[7].error and "Invalid row range 0-2" in rows[8].error
    looks = spark.createDataFrame([(" ", None, None), ("x", None, None), (None, "FFFF0000", None), (None, "00000000", "00000000")], "raw string, font_rgb string, fill_rgb string")
    assert [r.s for r in looks.select(sheets.shows_something().alias("s")).collect()] == [False, True, True, False]


def test_blocks_of_many_bands(spark):
    cells = [(r, c) for r in (1, 2, 3, 10, 11, 20) for c in (1, 2, 4)] + [(11, 3), (21, 9)]
    df = spark.createDataFrame([("w", s, r, c, "x") for s in "ab" for r, c in cells], "workbook string, sheet string, row int, col int, raw string")

    def plain():
        have, seen, out = set(cells), set(), []
        for r, c in sorted(have):
            if (r, c) not in seen:
                c2 = next(k for k in range(c, 99) if (r, k + 1) not in have)
                r2 = next(k for k in range(r, 99) if not all((k + 1, x) in have for x in range(c, c2 + 1)))
                seen |= {(i, k) for i in range(r, r2 + 1) for k in range(c, c2 + 1)}
                out.append((r, c, r2, c2))
        return out

    assert sorted(tuple(r)[1:] for r in sheets.blocks(df).collect()) == sorted((s, *b) for s in "ab" for b in plain())


def test_rubric_texts(spark):
    text = "intro\n==========\nTHE FACTS\n==========\nFirst check\n Says what\n it is.\n Good: all\n well\n Bad: none\n----------\nSecond\nDesc\nGood: g\nBad: b\n==========\nSTYLE\n==========\nThird\nD\nGood: g\nBad: b\n"
    rubric = rules.parsed_rubric(text, {"THE FACTS": "Facts", "STYLE": "Style"})
    assert rubric["Facts"][0] == {"name": "First check", "description": "Says what it is.", "good": "all well", "bad": "none"} and [c["name"] for c in rubric["Style"]] == ["Third"]
    weights = rules.uniform_weights({k: [c["name"] for c in v] for k, v in rubric.items()})
    assert weights == [("Facts", "First check", 0.5), ("Facts", "Second", 0.5), ("Style", "Third", 1.0)]
    for broken in (text.replace("STYLE", "OTHER"), text.replace("Bad: b", "Bed: b")):
        with pytest.raises(ValueError):
            rules.parsed_rubric(broken, {"THE FACTS": "Facts", "STYLE": "Style"})
    assert rules.next_id(spark.range(5), "id") == 5 and rules.next_id(spark.range(0), "id") == 1


def test_plan_counts_and_categories(spark):
    plan = spark.createDataFrame([("agentic", True), ("standard", False), (None, None)], "judge_mode string, graded boolean")
    missing = spark.createDataFrame([("no_attempt",), ("no_attempt",)], "reason string")
    assert {tuple(r) for r in coverage.plan_counts(plan, missing, 3, 2).collect()} == {("judge_mode", "agentic", 1), ("judge_mode", "standard", 1), ("judge_mode", "unknown", 1), ("graded", "graded", 1), ("graded", "to_grade", 2), ("missing", "no_attempt", 2), ("cells", "expected", 6)}
    found = spark.createDataFrame([("b", 1), ("b", 1), ("a", 2), ("c", 3), ("c", 4), (None, 5)], "category string, task_id int")
    assert [(r.category, r.n_tasks) for r in coverage.category_order(found).orderBy("place").collect()] == [("c", 2), ("a", 1), ("b", 1)]
    assert coverage.uncategorised(found).first().n_uncategorised == 1


def test_sources_and_sinks_without_rows_of_their_own(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_text('x,"a,b\nc",z\n1,2\n')
    (tmp_path / "csv" / "b.csv").write_bytes(b"\xff\xfe\x00bad")
    assert {r.file: (r.rows, r.cols) for r in logs.csv_dims(spark, str(tmp_path / "csv")).collect()} == {"a.csv": (2, 3), "b.csv": (None, None)}
    (tmp_path / "r.json").write_text(json.dumps({"rows": [{"model_label": "m", "d": "x", "v": "1.5"}, {"model_label": "m", "d": "x", "v": "bad"}, {"model_label": "no", "d": "x", "v": "2"}, {"model_label": "m", "d": None, "v": "3"}]}))
    assert [tuple(r) for r in logs.result_rows(spark, str(tmp_path / "r.json"), ["m"], "v", "d").collect()] == [("m", "x", 1.5)]
    (tmp_path / "tasks").mkdir()
    (tmp_path / "tasks" / "a.yaml").write_text("tasks:\n- {id: 1, name: n, files: [f]}\n- {id: 2, skip: true}\n")
    (tmp_path / "tasks" / "b.yml").write_text("{id: 3, name: m}\n")
    tasks = logs.yaml_tasks(spark, str(tmp_path / "tasks"))
    assert {(r.task_id, r.task_source, len(r.files)) for r in tasks.collect()} == {("1", "local", 1), ("3", "local", 0)} and [r.task_id for r in logs.with_files(tasks).collect()] == ["1"]
    files = spark.createDataFrame([(1, n) for n in ("a.txt", "a.pdf", "Question.pdf", "Answer key.pdf", "notes.txt")] + [(2, "Question.pdf")], "task int, name string")
    assert {(r.task, r.name) for r in logs.context_files(files, "task", "name").collect()} == {(1, "a.pdf"), (1, "Answer key.pdf"), (1, "notes.txt"), (2, "Question.pdf")}
    rows = spark.createDataFrame([(1, "x", "t")], "task_id int, task_source string, v string")
    sinks.attempts(rows, str(tmp_path / "attempts"))
    sinks.attempts(rows, str(tmp_path / "attempts"))
    assert spark.read.parquet(str(tmp_path / "attempts")).where("task_source = 'x'").count() == 2
    sinks.ndjson(rows, str(tmp_path / "nd"), True)
    text = b"".join(gzip.decompress(part.read_bytes()) for part in (tmp_path / "nd").glob("*.gz"))
    assert json.loads(text) == {"task_id": 1, "task_source": "x", "v": "t"}
    grid = spark.createDataFrame([(1,), (2,)], "task_id int")
    sinks.score_matrix(spark.createDataFrame([(1, 0.5)], "task_id int, score double"), grid, ["task_id"], str(tmp_path / "matrix"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "matrix")).where("value <> 'task_id,score'").collect()) == ["1,0.5", "2,"]
    lines = spark.createDataFrame([("f", 1, "[t-1] a"), ("f", 2, "b"), ("f", 3, "[t-2] c"), ("f", 4, "d")], "file string, line_no int, value string")
    sinks.log_by_thread(lines, str(tmp_path / "threads"))
    assert {(r.thread, r.line_no) for r in spark.read.parquet(str(tmp_path / "threads")).collect()} == {("t-1", 1), ("t-1", 2), ("t-2", 3), ("t-2", 4)}
    sinks.report_yaml(rows, str(tmp_path / "r.yaml"))
    assert "task_source: x" in (tmp_path / "r.yaml").read_text()
    with pytest.raises(ValueError):
        sinks.report_yaml(rows.union(rows), str(tmp_path / "r.yaml"), most=1)


def test_ranges_are_one_argument_of_and_and_or(spark):
    cells = [(1, 1, "0"), (2, 1, "0"), (3, 1, "=AND(A1:A2)"), (4, 1, "=OR(A1:A2,0)"), (5, 1, "=AND(A1,1)"), (6, 1, "=OR(A1,A2)"), (7, 1, "=AND(1,2)"), (8, 1, "=OR(0,3)")]
    df = spark.createDataFrame([("w", "s", *c) for c in cells], "workbook string, sheet string, row int, col int, raw string")
    assert {r.row: r.value for r in evaluation.evaluate(df).collect()} == {3: "True", 4: "True", 5: "False", 6: "False", 7: "True", 8: "True"}
