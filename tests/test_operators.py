"""NULLs, ties and repeated rows in small tables; scoring as a whole; files in and out; streams."""

import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import evaluation, formats, formulas, scalars
from tallyweave.operators import budget, coverage, leaderboard, scoring, selection, sheets, stats, telemetry
from tallyweave.sources import logs, sinks, xlsx
from tallyweave.streaming import jobs


def attempts(spark):
    rows = [
        (1, 10, "a", 1, False, False, 5.0, '["x.xlsx"]'), (2, 10, "a", 1, None, None, None, '["x.XLSX", "y.xlsx"]'), (3, 10, "a", 1, True, False, 1.0, '["x.xlsx"]'),
        (4, 11, "a", 1, False, True, 2.0, "[]"), (5, 11, "b", 2, False, False, 3.0, "null"), (6, 12, "b", 2, False, False, None, '["notes.txt"]'), (7, 12, "b", 1, False, False, 4.0, "{}"), (8, 13, "b", 2, False, False, 4.0, None),
    ]
    return spark.createDataFrame(rows, "attempt_id long, task_id long, agent string, prompt_version int, failed boolean, deprecated boolean, minutes double, files string")


def tasks(spark):
    return spark.createDataFrame([(10, "t10", "fmwc", "EASY", False), (11, "t11", "wsp", None, None), (12, "t12", None, "HARD", True), (13, "t13", "wsp", "ODD", False)], "task_id long, task_name string, task_source string, difficulty string, deprecated boolean")


def gradings(spark):
    t = dt.datetime(2025, 1, 1)
    rows = [(100, 2, 80.0, 60.0, 40.0, False, False, t), (101, 2, 90.0, 60.0, 40.0, None, None, None), (102, 2, 10.0, 10.0, 10.0, True, False, t), (103, 5, None, 1.0, 1.0, False, False, t)]
    return spark.createDataFrame(rows, "grading_id long, attempt_id long, accuracy double, formula double, format double, failed boolean, deprecated boolean, created_at timestamp")


def test_latest_and_valid(spark):
    a = attempts(spark)
    assert {(r.task_id, r.agent): r.attempt_id for r in selection.latest_valid_attempts(a, ["task_id", "agent"]).collect()} == {(10, "a"): 2, (11, "b"): 5, (12, "b"): 7, (13, "b"): 8}
    assert [r.attempt_id for r in selection.valid_attempts(a).orderBy("attempt_id").collect()] == [1, 6]
    assert {r.attempt_id: r.reason for r in a.select("attempt_id", selection.invalid_reason().alias("reason")).collect()} == {1: None, 2: "several workbooks", 3: "failed", 4: "deprecated", 5: "no files", 6: "no workbook", 7: "no files", 8: "no files"}
    clean = {r.attempt_id: r.grading_id for r in selection.latest_clean_gradings(gradings(spark)).collect()}
    assert clean == {2: 101, 5: 103}
    assert {r.attempt_id: r.grading_id for r in selection.newest_gradings(gradings(spark)).collect()} == {2: 100, 5: 103}
    assert selection.latest(a.limit(0), ["task_id"], F.col("attempt_id")).collect() == []


def test_eligibility_and_backlog(spark):
    t, a = tasks(spark), attempts(spark)
    e = selection.eligible(t, a, "a", 1)
    assert {r.task_id for r in e.collect()} == {11, 13}
    assert {r.task_id for r in selection.eligible_for_dispatch(t, a, "a", 1).collect()} == {13}
    states = spark.createDataFrame([("11", ["12", "x"]), (None, None)], "current string, queued array<string>")
    busy = selection.in_flight_ids(states)
    assert {r.task_id for r in busy.collect()} == {11, 12}
    assert tuple(selection.backlog(e, busy).first()) == (1, 1, 2)
    assert {r.task_id for r in selection.selected(t, [12], ["wsp"], [13]).collect()} == {11, 12}
    missing = {(r.task_id, r.agent): r.reason for r in selection.missing_cells(t, a.select("agent").distinct(), a, 1).collect()}
    assert missing[10, "a"] == "failed" and missing[13, "a"] == "no_attempt" and missing[11, "b"] == "empty" and (10, "b") in missing
    name, version = selection.model_token("m")
    got = spark.createDataFrame([("a@b@12",), ("plain",), ("x@y",)], "m string").select(name.alias("n"), version.alias("v")).collect()
    assert [tuple(r) for r in got] == [("a@b", 12), ("plain", None), ("x@y", None)]


def test_leaderboard(spark):
    cohorts = spark.createDataFrame([("A", "a", 1), ("B", "b", 2), ("C", "c", 1)], "cohort string, agent string, prompt_version int")
    cells = leaderboard.cells(tasks(spark), attempts(spark), gradings(spark), cohorts)
    assert cells.count() == 9
    rows = {r.cohort: r for r in leaderboard.summary(cells, 3).collect()}
    assert (rows["A"].complete, rows["A"].scored, rows["A"].imputed_zeros, rows["A"].mean_total, rows["A"].timed, rows["A"].mean_minutes) == (1, 1, 2, 24.0, 0, None)
    assert (rows["B"].complete, rows["B"].scored, rows["B"].mean_total, rows["B"].timed) == (1, 0, 0.0, 2)
    assert leaderboard.summary(cells, 206).where("cohort = 'A'").first().imputed_zeros == 205
    assert [(r.rank, r.cohort) for r in leaderboard.ranking(leaderboard.summary(cells, 3)).orderBy("rank").collect()] == [(1, "A"), (2, "B"), (3, "C")]
    d = {(r.cohort, r.difficulty): r for r in leaderboard.difficulty_breakdown(cells, ["EASY", "HARD"]).collect()}
    assert d["A", "EASY"].total == 72.0 and d["A", "None"].ordinal == 3


def test_cells_are_made_behind_the_join_of_tasks(spark):
    cohorts = spark.createDataFrame([("A", "a", 1), ("B", "b", 2), (None, "c", 1), ("A", "x", 9)], "cohort string, agent string, prompt_version int")
    cells = leaderboard.cells(tasks(spark), attempts(spark), gradings(spark), cohorts)
    got = [(r.cohort, r.agent, r.task_id, r.status) for r in cells.collect()]
    own = {(r.cohort, r.task_id): r.status for r in leaderboard.cells(tasks(spark), attempts(spark), gradings(spark), cohorts.limit(2)).collect()}
    # A cohort that stands twice in the roster has its cells twice, one without a name has no attempts.
    assert sorted(got, key=repr) == sorted([(c, a, t, own.get((c, t), "needs_attempt")) for c, a in (("A", "a"), ("B", "b"), (None, "c"), ("A", "x")) for t in {t for _, t in own}], key=repr)
    plan = cells._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "hashpartitioning(cohort" not in plan.split("Generate inline")[0] and "SortMergeJoin [cohort" not in plan and "Join [cohort" not in plan


def rubric(spark):
    return spark.createDataFrame([("X", "p", 0.5), ("X", "q", 0.5), ("Y", "r", 1.0)], "category string, name string, weight double")


def score(spark, judgement, max_mistakes=5):
    j = spark.createDataFrame([(1, json.dumps(judgement))], "grading_id long, judgement string")
    items = scoring.judgement_items(j)
    counted = scoring.counted(items, max_mistakes=max_mistakes)
    checks = scoring.check_scores(items, counted, rubric(spark), j, max_mistakes=max_mistakes)
    weights = spark.createDataFrame([("X", 0.7), ("Y", 0.3)], "category string, category_weight double")
    total = scoring.total_scores(scoring.category_scores(checks), weights).first()
    return (total.total_score if total else None), sorted((r.kind, r.category, r.name) for r in scoring.warnings(items, counted, checks).collect())


def test_rubric_scores(spark):
    ok = lambda n: {"name": n, "check": "c", "decision": "pass", "summary": "s", "mistakes": []}
    total, warned = score(spark, {"X": [ok("p"), ok("q")], "Y": [ok("r")]})
    assert total == pytest.approx(100) and warned == []
    total, warned = score(spark, {"X": [ok("p"), ok("q") | {"decision": " FAIL "}], "Y": [ok("r")]})
    assert total == pytest.approx(65) and warned == [("fail_without_mistakes", "X", "q")]
    total, warned = score(spark, {"X": [ok("p"), ok("p") | {"mistakes": ["a"], "total_mistakes": 2}], "Y": []})
    assert total == pytest.approx(0.7 * 40)
    assert warned == [("duplicate_judgement", "X", "p"), ("empty_category", "Y", None), ("mistake_count_mismatch", "X", "p"), ("unscored_check", "X", "q"), ("unscored_check", "Y", "r")]
    total, _ = score(spark, {"X": "no list", "Y": [ok("r")]})
    assert total == pytest.approx(30)  # a category without a list has no score at all
    problems = {(r.problem, r.category) for r in scoring.rubric_problems(rubric(spark), spark.createDataFrame([("X", "p"), ("Z", "new")], "category string, name string")).collect()}
    assert problems == {("not in rubric", "X"), ("not in rubric", "Y"), ("without weight", "Z")}


def test_check_scores_shuffle_by_key_in_parts_that_stay_small(spark, monkeypatch):
    monkeypatch.setattr(scoring, "MOST_KEYS", 10)
    keys = spark.range(95).select(F.col("id").alias("grading_id"))
    items = spark.createDataFrame([(i, "X", [("p", "c", "pass", "s", ["m"] * (i % 4), None)]) for i in range(60) for _ in range(1 + i % 2)] + [(7, "Y", None), (8, "Z", None), (200, "X", [])], f"grading_id long, category string, items array<{scoring.ITEM}>")
    checks = scoring.check_scores(items, scoring.counted(items), rubric(spark), keys)
    got = {(r.grading_id, r.name): (r.mistakes, r.score, r.unscored, r.times) for r in checks.collect()}
    want = {(i, c): (i % 4, (5 - i % 4) / 5, False, 1 + i % 2) if c == "p" and i < 60 else (5, 0.0, True, 0) for i in range(95) for c in "pqr" if (i, c) != (7, "r")}
    assert got == want
    plan = checks._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("hashpartitioning(grading_id") == plan.count("hashpartitioning") == 2 and plan.count("REPARTITION_BY_NUM") == 2
    assert plan.count(", 10), REPARTITION_BY_NUM") == 2


def test_letters_and_primary_category(spark):
    got = spark.createDataFrame([(n,) for n in (0, 25, 26, 27, 35, 51, 52, 701, 702)], "n int").select(scoring.check_letter("n")).collect()
    assert [r[0] for r in got] == ["A", "Z", "AA", "AB", "AJ", "AZ", "BA", "ZZ", "AAA"]
    rows = ['{"involved_tasks": {"a": 1, "b": 3, "c": 3}}', '{"involved_tasks": ["z", "y"]}', '{"involved_tasks": {}}', "{}", None]
    got = spark.createDataFrame([(r,) for r in rows], "case_classification string").select(coverage.primary_category()).collect()
    assert [r[0] for r in got] == ["b", "z", None, None, None]


def test_fold_records(spark):
    e = spark.createDataFrame([(1, "append_mistake", None, "early"), (2, "record_check", "pass", None), (4, "append_mistake", None, "b"), (3, "append_mistake", None, "a"), (5, "record_check", "fail", None)], "step int, kind string, decision string, mistake string").withColumn("letter", F.lit("A"))
    assert [tuple(r) for r in scoring.fold_records(e, ["letter"]).collect()] == [("A", "fail", ["a", "b"])]


def test_statistics(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 7.0), ("b", None)], "k string, v double")
    got = {r.k: r for r in stats.stat_summary(rows, ["k"], "v").collect()}
    assert got["b"].sem == 0.0 and got["a"].median == 2.0 and got["a"].q25 == 1.5 and got["a"].q75 == 3.0
    assert [tuple(r) for r in stats.histogram(rows, "v", 3).orderBy("bin").collect()] == [(0, 2), (1, 1), (2, 1)]
    labels = spark.createDataFrame([(True, True), (True, False), (False, False), (False, True), (None, True)], "j boolean, h boolean").select(stats.confusion("j", "h")).collect()
    assert [r[0] for r in labels] == ["TP", "FP", "TN", "FN", None]


def test_budgets(spark):
    text = "\n".join(f"r{i}" for i in range(120)) + "\n\n"
    wide = ",".join(str(i) for i in range(100))
    r = spark.createDataFrame([(text, wide, "a,,,b,,\nc,")], "t string, w string, c string").select(budget.redact_rows("t"), budget.redact_columns("w"), budget.clean_commas("c")).first()
    lines = r[0].split("\n")
    assert len(lines) == 101 and lines[60] == "[Rows 61-80 redacted (20 rows)]" and lines[61] == "r80"
    assert r[0] == budget._rows(text) and r[1] == budget._columns(wide)
    assert r[1].split(",")[50] == "[Columns 51-75 redacted]" and r[2] == "a,b\nc"
    files = spark.createDataFrame([("d", "a", text), ("d", "b", "small"), ("e", "c", None)], "dir string, name string, text string")
    got = {r.name: r.text for r in budget.shorten(files, "dir", 300).collect()}
    assert got["b"] == "small" and got["a"] == budget._rows(text) and got["c"] == ""
    assert list(budget.least_loaded([("x", 1), ("y", 0)], [1, 2, 3])) == [(1, "y"), (2, "x"), (3, "y")]
    routed = spark.createDataFrame([(1, 1), (200, 1), (1, 900), (None, 1)], "s int, a int").select(budget.judge_mode(budget.overflows(F.col("s"), F.col("a"), 100, 500, 600))).collect()
    assert [x[0] for x in routed] == ["standard", "agentic", "agentic", "unknown"]
    usage = spark.createDataFrame([("m", 1_000_000, 500_000), ("new", 1_000_000, 0)], "model string, prompt_tokens long, completion_tokens long")
    prices = spark.createDataFrame([("m", 2.0, 4.0)], "model string, input_price double, output_price double")
    assert {r.model: r.total_cost for r in budget.costs(usage, prices, (10.0, 30.0)).collect()} == {"m": 4.0, "new": 10.0}


def test_shortening_sends_only_the_largest_files_to_python(spark):
    rows = [("d", f"f{i:02d}", "\n".join(["x,y"] * (7 * i % 41 * 9)) or None) for i in range(41)] + [("e", "a", ",".join("z" * 200)), (None, "n", "tiny"), (None, "m", None)]
    files = spark.createDataFrame(rows, "dir string, name string, text string")
    for target in (0, 19_000, 25_000, 10**9):
        want = {}
        for d in ("d", "e", None):
            own, cut = {n: t or "" for x, n, t in sorted(rows, key=lambda r: r[1]) if x == d}, {"rows": set(), "columns": set()}
            for step in budget.SOLUTION_STEPS:
                left = [n for n in own if n not in cut[step] and own[n]]
                if sum(map(len, own.values())) >= target and left:
                    n = max(left, key=lambda k: len(own[k]))
                    short = (budget._rows if step == "rows" else budget._columns)(own[n])
                    if short != own[n]:
                        cut[step].add(n)
                        own[n] = short
            want |= {(d, n): t for n, t in own.items()}
        out = budget.shorten(files, "dir", target)
        got = [((r.dir, r.name), r.text) for r in out.collect()]
        assert len(got) == len(rows) and dict(got) == want
    assert "WindowGroupLimit" in out._jdf.queryExecution().toString()


def test_telemetry(spark):
    calls = spark.createDataFrame([("r", 1, 10), ("r", 3, 5), ("r", 5, 4), ("r", 7, 9)], "run string, step int, size int")
    evicted = spark.createDataFrame([("r", 2)], "run string, step int")
    assert [(r.step, r.previous) for r in telemetry.unexplained_shrinks(calls, evicted, ["run"]).collect()] == [(5, 5)]
    seen = spark.createDataFrame([("r", 1, 3), ("r", 2, 3), ("r", 3, None), ("r", 4, None), ("r", 5, 3)], "run string, step int, total int")
    assert [(r.step, r.n) for r in telemetry.drop_repeated(seen, ["run"], ["step"], "total").orderBy("step").collect()] == [(1, 1), (3, 2), (5, 3)]
    loop = spark.createDataFrame([("r", i, c, f) for i, (c, f) in enumerate([("a", True)] * 3 + [("b", True)] * 2 + [("b", False)])], "run string, step int, call string, failed boolean")
    assert [r.step for r in telemetry.loops(loop, ["run"], ["step"], "call", "failed").where("looping").collect()] == [2]
    refs = spark.createDataFrame([('{"$blob": "ab"} {"$blob":"cd"} {"$blob": "ab"}',)], "p string").select(telemetry.blob_refs("p")).first()[0]
    assert refs == ["ab", "cd"]
    total = telemetry.usage_totals(spark.createDataFrame([("x", 1, 5), ("x", 2, 9)], "run string, n int, out int"), ["run"], "n", True, ["out"]).first()
    assert (total.out, total.turns) == (9, 2)


def test_formulas(spark):
    rows = [("=SUM(A1:B2)+1", "C1"), ("=B1+1", "B1"), ("=VLOOK(A1)", "C1"), ("=SUM((A1)", "C1"), ("SUM(A1)", "C1"), ("=", "C1"), ('="SUM("&A1', "C1"), ("=SUM(A1:C3)", "B2"), ("='My Sheet'!B2*S2!A1:A3", "B2"), ("=TAX_RATE*2", "C1")]
    df = spark.createDataFrame(rows, "f string, c string")
    got = df.select(F.size(formulas.errors("f", F.col("c"))), formulas.circular("c", "f"), formulas.cell_refs("f"), formulas.potential_names("f")).collect()
    assert [r[0] for r in got] == [0, 1, 1, 1, 1, 1, 1, 1, 1, 0]  # parentheses are counted in texts too
    assert [r[1] for r in got] == [False, True, False, False, False, False, False, True, True, False]
    assert got[8][2] == ["My Sheet!B2", "S2!A1:A3"] and got[9][3] == ["TAX_RATE"]
    assert {"SUM", "BIN2HEX", "QUARTILE.EXC", "ISODD"} <= set(formulas.FUNCTION_NAMES)


def test_evaluation(spark):
    cells = [("A", 1, "10"), ("A", 2, "20"), ("A", 3, "=A1+A2"), ("B", 1, "=SUM(A1:A3)"), ("C", 1, "=A1*A2"), ("D", 1, "=IF(A1>5,2^3,0)"), ("E", 1, "=E1+1"), ("F", 1, "=NOPE(1)"), ("G", 1, "=AVERAGE(H1:H2)"), ("I", 1, '=COUNTA(A1:A3)+ROUND(2.675,2)')]
    df = spark.createDataFrame([("w", "s", r, ord(c) - 64, raw) for c, r, raw in cells], "workbook string, sheet string, row int, col int, raw string")
    got = {(r.col, r.row): r.value for r in evaluation.evaluate(df).collect()}
    assert got == {(1, 3): "30", (2, 1): "60", (3, 1): "200", (4, 1): "8", (5, 1): None, (6, 1): None, (7, 1): None, (9, 1): "5.67"}
    deep = spark.createDataFrame([("w", "s", 1, 1, "1")] + [("w", "s", n, 1, f"=A{n - 1}+1") for n in range(2, 52)], "workbook string, sheet string, row int, col int, raw string")
    assert evaluation.evaluate(deep).where("row = 51").first().value == "51"


def test_scalars(spark):
    shown = [(0.125, "0.00", "0.13"), (-1234.5, "#,##0.0", "-1,234.5"), (0.256, "0%", "26%"), (-5.0, '0.0;(0.0);"zero"', "(5.0)"), (0.0, '0.0;(0.0);"zero"', "zero"), (7.0, "$0.00", "$7.00"), (1.0, "General", None), (1.0, "yyyy-mm-dd", None), (3.0, "00#", "03")]
    for value, number_format, want in shown[:-1]:
        assert scalars.render_number(value, number_format) == want, (value, number_format)
    assert json.loads(scalars.extract_json('text ```json\n{"a": [1]}\n``` more')) == {"a": [1]} and scalars.extract_json("none") is None
    assert json.loads(scalars.repair_json("```\n{a: 'b', c: True, // note\n d: [1,2,],}\n```")) == {"a": "b", "c": True, "d": [1, 2]}
    assert [json.loads(x) for x in scalars.split_objects('{"a": "}"}{"b": {"c": 1}} x {bad {"d": 2}')] == [{"a": "}"}, {"b": {"c": 1}}, {"d": 2}]
    df = spark.createDataFrame([(2.675, 2, "ff0000", "s3://b/k/x.csv", "Ab, C!")], "x double, n int, rgb string, uri string, t string")
    r = df.select(scalars.python_round("x", "n"), F.round("x", 2), formats.colour_name("rgb"), scalars.s3_parts("uri"), scalars.slug("t")).first()
    assert (r[0], r[1], r[2], tuple(r[3]), r[4]) == (2.67, 2.68, "bright_red (ff0000)", ("b", "k/x.csv"), "ab-c")


def workbook(path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="In put" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AA1"><v>2.5</v></c></row><row r="3"><c r="A3"><f>AA1*2</f><v>5</v></c></row></sheetData></worksheet>')


def test_workbooks(spark, tmp_path):
    workbook(tmp_path / "book.xlsx")
    (tmp_path / "~$book.xlsx").write_bytes(b"lock")
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    cells = xlsx.read(spark, str(tmp_path))
    got = {(r.row, r.col): (r.raw, r.cached, r.v_type) for r in cells.collect()}
    assert got == {(1, 1): ("Name", "Name", "string"), (1, 27): ("2.5", "2.5", "number"), (3, 1): ("=AA1*2", "5", "number")}
    assert [(r.workbook, r.error.split(":")[0]) for r in xlsx.broken(spark, str(tmp_path)).collect()] == [("bad.xlsx", "BadZipFile")]
    assert evaluation.evaluate(cells).first().value == "5.0"
    assert xlsx.to_csv_text(cells).first().csv == "Name,2.5\n5,"
    assert [r.csv for r in xlsx.to_csv_text(cells, 2).orderBy("segment").collect()] == ["Name,2.5", "5,"]
    box = sheets.used_range(cells).first()
    assert (box.min_row, box.max_row, box.min_col, box.max_col) == (1, 3, 1, 27)
    assert {(r.ref_sheet, r.ref) for r in sheets.formula_refs(cells).collect()} == {("In put", "AA1")}


def test_sheet_blocks(spark):
    cells = [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (5, 5)]
    df = spark.createDataFrame([("w", "s", r, c, "x", "string") for r, c in cells] + [("w", "s", 9, 9, "", "string")], "workbook string, sheet string, row int, col int, raw string, v_type string")
    assert sorted(tuple(r)[2:] for r in sheets.blocks(df).collect()) == [(1, 1, 2, 2), (3, 1, 3, 1), (5, 5, 5, 5)]
    assert sheets.header_rows(df).count() == 0 and sheets.header_rows(df, 0.4).first().header_row == 1


def test_logs_and_sinks(spark, tmp_path):
    (tmp_path / "run.jsonl").write_text('{"type": "call", "step": 1, "usage": {"prompt_tokens": 5, "completion_tokens": 2}}\n\n{bad\n{"type": "end", "step": 2}\n')
    records, bad = logs.trajectory(spark, str(tmp_path / "run.jsonl"))
    assert {r.type for r in records.collect()} == {"call", "end"} and [r.value for r in bad.collect()] == ["{bad"]
    (tmp_path / "plan.yaml").write_text("- 7: {judge_model: m, judge_mode: agentic, judge_version: 1, judge_prompt_version: 7.0, rubric_version: 6, attempt_additional_info: {task_id: 3, agent_model_name: a, prompt_version: 2}}\n")
    assert logs.plan_rows(spark, str(tmp_path / "plan.yaml")).first().attempt_id == 7
    (tmp_path / "empty.yaml").write_text("[]")
    with pytest.raises(ValueError):
        logs.plan_rows(spark, str(tmp_path / "empty.yaml"))
    refs = ["a/b.xlsx", '["x/y.xlsx"]', '[{"filename": "f", "url": "u"}]', '{"name": "n", "path": "p"}', None, "null"]
    got = spark.createDataFrame([(r,) for r in refs], "r string").select(logs.file_refs("r")).collect()
    assert [[tuple(x) for x in r[0]] for r in got] == [[("b.xlsx", "a/b.xlsx")], [("y.xlsx", "x/y.xlsx")], [("f", "u")], [("n", "p")], [], []]
    assert logs.config({"a": {"b": 1, "c": "${env:NO_SUCH_NAME:-z}"}}, {"a": {"b": 2}}) == {"a": {"b": 2, "c": "z"}}
    rows = spark.createDataFrame([(1, 0.123456, True, None)], "id int, x double, ok boolean, t string")
    sinks.coverage_csv(rows, str(tmp_path / "csv"))
    assert spark.read.text(str(tmp_path / "csv")).where("value LIKE '1,%'").first().value.startswith("1,0.1235,1,")
    new = sinks.upsert(rows, rows.withColumn("x", F.lit(9.0)), ["id"])
    assert new.first().x == 9.0
    sinks.run_manifest(rows, str(tmp_path / "runs"), "r1")
    sinks.run_manifest(rows.union(rows), str(tmp_path / "runs"), "r1")
    assert spark.read.json(str(tmp_path / "runs/r1")).count() == 1


def test_streams(spark, tmp_path):
    times = [0, 60, 120, 4000, 40_000]
    lines = [json.dumps({"event_id": i, "ts": dt.datetime.fromtimestamp(1_700_000_000 + t, dt.UTC).strftime("%Y-%m-%dT%H:%M:%S"), "user_id": 1, "event_type": "login", "value": 1.0}) for i, t in enumerate(times)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(lines) + '\n{"event_id": 9, "ts"')
    stream = jobs.read_log(spark, str(tmp_path / "in"), jobs.EVENTS).where("ts IS NOT NULL")
    q = jobs.sessions(stream, "user_id").writeStream.format("memory").queryName("sessions_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = jobs.sessions(spark.read.schema(jobs.EVENTS).json(str(tmp_path / "in")).where("ts IS NOT NULL"), "user_id")
    assert sorted(map(tuple, spark.table("sessions_out").collect())) == sorted(map(tuple, batch.orderBy("start").limit(2).collect()))  # the last session is still open
    q = jobs.append_results(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    limited = jobs.rate_limit(spark.read.schema(jobs.EVENTS).json(str(tmp_path / "in")).where("ts IS NOT NULL"), "user_id", "ts", 900, 2)
    assert [r.event_id for r in limited.where("blocked").collect()] == [2]


def test_worker_states(spark, tmp_path):
    (tmp_path / "w").mkdir()
    steps = [("enqueue", "t1"), ("enqueue", "t1"), ("enqueue", "t2"), ("pop", None), ("pop", None), ("finish", None), ("enqueue", "t1")]
    (tmp_path / "w/a.json").write_text("\n".join(json.dumps({"worker": "w1", "kind": k, "task": t}) for k, t in steps))
    events = spark.readStream.schema("worker string, kind string, task string").json(str(tmp_path / "w"))
    q = jobs.worker_states(events).writeStream.format("memory").queryName("workers_out").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("workers_out").collect()] == [("w1", None, ["t2"], ["t1"])]
