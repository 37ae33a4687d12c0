"""Ordered rules: the first that holds decides."""

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import rules


def test_verdicts(spark):
    names = "infra_error string, transcript string, timed_out boolean, has_solution boolean, other_workbooks int, sheets int, seeded boolean, seconds double"
    rows = [
        ("docker died", "", True, True, 0, 3, False, 900.0), (None, "... Credit balance is too LOW", False, False, 0, None, False, 9.0), (None, "billing", False, True, 0, 2, False, 900.0),
        (None, None, True, False, 0, None, False, 900.0), (None, "", False, False, 1, None, False, 900.0), (None, "", False, False, 0, None, False, 900.0),
        (None, "", False, True, 0, None, False, 900.0), (None, "", False, True, 0, 2, True, 900.0), (None, "", False, True, 0, 2, False, 5.0),
    ]
    got = [r[0] for r in spark.createDataFrame(rows, names).select(rules.verdict(60)).collect()]
    assert got == ["infra_failure", "infra_failure", "success", "timeout", "needs_review", "agent_failure", "agent_failure", "agent_failure", "needs_review"]


def test_names_and_floors(spark):
    df = spark.createDataFrame([("codex_x", 0, "answers_A", '{"scoring_warnings": {"unscored_checks": {}}}'), ("openpyxl", 3, "model_B", '{"scoring_warnings": {"unscored_checks": {"X": ["q"]}}}'), ("my_excel_agent", 9, "C", "not json"), ("other", None, None, None)], "agent string, code int, sheet string, scored string")
    got = df.select(rules.pipeline_of("agent"), rules.status_of("code"), rules.graded_sheet_name("sheet"), rules.usable("scored")).collect()
    assert [r[0] for r in got] == ["Coding agent", "CLI/API", "Excel add-in", "GUI"]
    assert [r[1] for r in got] == ["success", "no_tasks", "failed", "failed"]
    assert [r[2] for r in got] == ["A", "B", "_nograde_C", None]
    assert [r[3] for r in got] == [True, False, False, False]
    failed = spark.createDataFrame([(True, "Max iterations reached"), (True, "crash"), (None, None)], "f boolean, r string").select(rules.counts_as_failure(F.col("f"), F.col("r"))).collect()
    assert [r[0] for r in failed] == [False, True, False]


def test_formula_gate(spark):
    names = ["A1+B2", "=TODO", "1,000", '"text"', "Other!B1+1", "=NOPE(1)", "=A1+", "=SUM(Data!A1:A3)", "=C9+1"]
    df = spark.createDataFrame([(f,) for f in names], "f string")
    got = df.select(rules.formula_gate("f", F.lit("Data"), F.array(F.lit("Data"), F.lit("My Sheet")), F.lit("C9"))).collect()
    assert [r[0] for r in got] == [None, "placeholder", "constant", "text", "missing sheet", "invalid", "trailing operator", None, "invalid"]


def test_text_in_arithmetic(spark):
    cells = spark.createDataFrame([("w", "s", 1, 1, "label", "string"), ("w", "s", 2, 1, "5", "number"), ("w", "s", 3, 1, "=A1*2", "number"), ("w", "s", 4, 1, "=A2*2", "number")], "workbook string, sheet string, row int, col int, raw string, v_type string")
    assert [(r.row, r.ref) for r in rules.text_in_arithmetic(cells, cells).collect()] == [(3, "A1")]


def test_queue(spark):
    queue = spark.createDataFrame([(1, "Alpha"), (2, "beta"), (3, "alphabet")], "grading_id int, agent string")
    notes = spark.createDataFrame([(1, "y"), (1, "x"), (1, "x")], "grading_id int, annotator string")
    full = rules.annotators(notes, queue)
    assert [(r.grading_id, r.annotators) for r in rules.browse(full, contains={"agent": "ALPHA"}).collect()] == [(1, ["x", "y"]), (3, [])]
    assert [r.grading_id for r in rules.browse(full, reviewed=False, limit=1).collect()] == [2]


def test_texts():
    assert rules.render("a {{ x }} {\"k\": 1}{{y}}", {"x": 1}, {"y"}) == 'a 1 {"k": 1}'
    with pytest.raises(KeyError):
        rules.render("{{ z }}", {})
    assert rules.uniform_weights({"X": ["p", "q", "r"]}) == [("X", "p", 0.3333), ("X", "q", 0.3333), ("X", "r", 0.3333)]
