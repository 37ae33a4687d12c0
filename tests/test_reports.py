"""Reports, joins by name and small columns, with NULLs, ties and empty tables."""

import datetime as dt
import itertools

from pyspark.sql import functions as F

from tallyweave.functions import scalars
from tallyweave.operators import budget, coverage, reports, rules, selection, sheets, telemetry
from tallyweave.sources import logs


def test_batches_and_runs(spark):
    rows = [("b", "w1", "success", 3, 1_234, 0.5, 2.0, None), ("b", "w2", "error", None, None, None, None, "broke"), ("b", "w3", None, 1, 1, 1.0, 1.0, ""), (None, "x", "success", 1, 1, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "batch string, workspace string, status string, iterations long, tokens long, cost double, seconds double, error string")
    totals = reports.batch_totals(df, ["batch"])
    assert {tuple(r) for r in totals.collect()} == {("b", 3, 1, 2, 4, 1_235, 1.5, 3.0), (None, 1, 1, 0, 1, 1, 1.0, 1.0)}
    lines = [r.line for r in reports.batch_report(df, totals, ["batch"]).where("batch = 'b'").orderBy("workspace", "place").collect()]
    assert lines[0] == "# Batch Execution Summary: b" and lines[7:9] == ["- **Total Tokens**: 1,235", "- **Total Cost**: $1.5000"]
    assert lines[10:18] == ["### ✅ w1", "- **Status**: success", "- **Iterations**: 3", "- **Tokens**: 1,234", "- **Cost**: $0.5000", "- **Duration**: 2.00s", "### ❌ w2", "- **Status**: error"]
    assert "- **Error**: broke" in lines and sum("Error" in x for x in lines) == 1
    assert reports.batch_totals(df.limit(0), ["batch"]).collect() == []
    ran = spark.createDataFrame([(True,), (False,), (None,)], "success boolean")
    assert [tuple(r) for r in reports.run_summary(ran).collect()] == [(3, 1, 2)] and [tuple(r) for r in reports.run_summary(ran.limit(0)).collect()] == [(0, 0, 0)]


def test_completion_and_reasons(spark):
    tasks = spark.createDataFrame([(i,) for i in (1, 2, 3, 3)], "task_id int")
    agents = spark.createDataFrame([("a",), ("b",), ("a",)], "agent string")
    valid = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (9, "b")], "task_id int, agent string")
    invalid = spark.createDataFrame([(3, "a", 5, "late"), (3, "a", 4, "empty"), (3, "a", 6, "late"), (1, "b", 1, "failed")], "task_id int, agent string, attempt_id int, reason string")
    assert {tuple(r) for r in reports.completion_matrix(tasks, agents, valid).collect()} == {("a", 2, 3, 67), ("b", 0, 3, 0)}
    got = {(r.agent, r.task_id): r.reasons for r in reports.missing_with_reasons(tasks, agents, valid, invalid).collect()}
    assert got == {("a", 3): ["empty", "late"], ("b", 1): ["failed"], ("b", 2): [], ("b", 3): []}
    assert [r.rate for r in reports.completion_matrix(tasks.limit(0), agents, valid).collect()] == [None, None]
    workers = spark.createDataFrame([("w2", "m", 1, True), ("w1", "m", 1, True), ("w3", "m", None, True), ("w4", "", 1, True), ("w5", None, 1, True), ("w6", "m", 1, False)], "alias string, agent string, prompt_version int, reachable boolean")
    assert sorted(map(tuple, reports.worker_cohorts(workers).collect())) == [("m", "1", "w1", 1), ("m", "1", "w2", 2), ("m", "None", "w3", 1)]


def test_joins_of_results_and_names(spark):
    tasks = spark.createDataFrame([(1, "a_b", False), (2, "a b", False), (3, "old", True), (4, "x_y", True), (5, "x y", None), (7, "c_d", False), (6, "c_d", False)], "task_id int, task_name string, deprecated boolean")
    wanted = spark.createDataFrame([("a b",), ("a_b",), ("old",), ("x y",), ("none",), (None,), ("c d",), ("a b",)], "name string")
    got = selection.tasks_by_name(wanted, tasks, F.replace(F.col("name"), F.lit(" "), F.lit("_"))).collect()
    assert sorted(((r.name, r.task_id) for r in got), key=repr) == sorted([("a b", 1), ("a b", 1), ("a_b", 1), ("old", 3), ("x y", 5), ("none", None), (None, None), ("c d", 6)], key=repr)
    attempts = spark.createDataFrame([(10, 1, "m", 1), (11, 99, "m", 1)], "attempt_id int, task_id int, agent string, prompt_version int")
    named = tasks.withColumn("task_source", F.lit("s"))
    gradings = spark.createDataFrame([(100, 10), (101, 11), (102, None)], "grading_id int, attempt_id int")
    assert [(r.grading_id, r.task_name, r.agent) for r in selection.graded_attempts(gradings, attempts, named).collect()] == [(100, "a_b", "m")]
    found, lost = selection.results_of(gradings, attempts)
    assert {r.grading_id for r in found.collect()} == {100, 101} and {r.grading_id for r in lost.collect()} == {102}
    rows = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("k", 1, "a"), (None, 3, "c"), (None, None, "n")], "k string, at int, v string")
    assert {(r.k, r.at) for r in selection.first_seen(rows, ["k"], "at").collect()} == {("k", 1), (None, None)}


def brute_structure(cells, boxes):
    have = {(r, c): (raw, t) for _, _, r, c, raw, t in cells if raw}
    heads, columns = {}, {}
    for box in boxes:
        r1, c1, r2, c2 = box
        head = None
        for r in range(r1, min(r1 + 3, r2 + 1)):
            own = [have[r, c][1] for c in range(c1, c2 + 1) if (r, c) in have]
            if own and own.count("string") >= max(1, int(0.6 * len(own))):
                head = r
                break
        heads[box] = head
        for c in range(c1, c2 + 1) if head else ():
            below = [have[r, c] for r in range(head + 1, r2 + 1) if (r, c) in have]
            if (head, c) in have or below:
                kinds = [t for _, t in below]
                columns[box, c] = (have.get((head, c), (None,))[0], max(dict.fromkeys(kinds), key=kinds.count) if kinds else "unknown", len(below), [x for x, _ in below][:3])
    return heads, columns


def test_structure_of_sheets(spark):
    kinds = itertools.cycle(["string", "number", "number", "string", "bool"])
    cells = [("w", "s", r, c, f"v{r}.{c}" if (r * c) % 7 else None, "string" if r == 2 else next(kinds)) for r in range(1, 30) for c in range(1, 7)] + [("w", "s", 20, 20, "1", "number")]
    boxes = [(1, 1, 9, 3), (2, 4, 29, 6), (15, 1, 29, 3), (20, 20, 20, 20)]
    df = spark.createDataFrame(cells, "workbook string, sheet string, row int, col int, raw string, v_type string")
    told, columns = reports.structure(df, spark.createDataFrame([("w", "s", *b) for b in boxes], "workbook string, sheet string, r1 int, c1 int, r2 int, c2 int"))
    heads, want = brute_structure(cells, boxes)
    assert {tuple(r)[2:6]: r.header_row for r in told.collect()} == heads
    assert {(tuple(r)[2:6], r.col): (r.name, r.type, r.non_null, r.examples) for r in columns.collect()} == want
    assert columns.where("workbook = 'x'").collect() == []


def test_small_columns(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 1, 31, 23, 59, 59, 250_000), dt.datetime(2025, 2, 1), "s3://old/k/old/x", '{"a": {"b": 1, "c": null, "d": {"e": "x"}}, "F": [1, 2]}')], "a timestamp, b timestamp, uri string, config string")
    r = df.select(scalars.run_stamp("a"), scalars.elapsed_seconds("a", "b"), scalars.moved_bucket("uri", "old", "new"), scalars.moved_bucket("uri", "k", "new"), scalars.flattened_json("config")).first()
    assert tuple(r) == ("20250131T235959Z", 0.75, "s3://new/k/old/x", "s3://old/k/old/x", {"A_B": "1", "A_D_E": "x", "F": "[1, 2]"})
    shown = spark.createDataFrame([(0.9,), (59.0,), (65.0,), (3_600.0,), (7_385.0,), (None,)], "s double").select(scalars.duration_text("s").alias("t")).collect()
    assert [x.t for x in shown] == ["0s", "59s", "1m05s", "1h00m", "2h03m", None]
    odd = spark.createDataFrame([(None,), ("[1]",), ("{bad",), ("{}",)], "t string").select(scalars.flattened_json("t").alias("m")).collect()
    assert [x.m for x in odd] == [None, None, None, {}]
    url = spark.createDataFrame([("postgres://u:p@h:5/db?x=1",), ("postgresql://h/other",), ("none",), (None,)], "u string").select(scalars.database_name("u").alias("d")).collect()
    assert [x.d for x in url] == ["db", "other", "", None]


def test_budgets_and_estimates(spark):
    rows = spark.createDataFrame([(100_000,), (100,), (0,), (None,)], "total long")
    got = [tuple(r.s) if r.s else None for r in rows.select(budget.budget_split(F.col("total")).alias("s")).collect()]
    floor = got[2][0]
    assert got[0] == (25_000, 45_000, 30_000) and got[2] == (floor,) * 3 and got[1] == (max(25, floor), max(45, floor), max(30, floor))
    sizes = spark.createDataFrame([("A.PDF", 101), ("b.xlsx", 101), ("c.txt", 101), (None, 4), ("d.pdf", None)], "n string, s long").select(budget.estimated_tokens(F.col("n"), F.col("s")).alias("t")).collect()
    assert [x.t for x in sizes] == [25, 16, 0, 0, None]
    content = "content array<struct<content:string,parts:array<struct<text:string,image_url:string>>>>"
    messages = spark.createDataFrame([([("abc", None), (None, [("de", None), (None, "http"), (None, None)])],), ([],)], content).select(budget.message_size("content").alias("m")).collect()
    assert [tuple(x.m) for x in messages] == [(5, 9), (0, 0)]


def test_plan_summary(spark):
    plan = spark.createDataFrame([("a", "standard", 1, "7"), ("b", "agentic", 1, "7"), ("a", None, 2, "7"), (None, "odd", 1, None)], "agent string, judge_mode string, judge_version int, judge_prompt_version string")
    assert tuple(coverage.plan_summary(plan).first()) == (["a", "b"], 1, 1, 2, 2)
    assert tuple(coverage.plan_summary(plan.limit(0)).first()) == ([], 0, 0, 0, 0)


def test_task_like_texts_and_mentions(spark):
    texts = spark.createDataFrame([("w", "s1", "What is the total?"), ("w", "s1", "see Data and Inputs"), ("w", "Data", "data only, then inputs"), ("w", "s1", None), ("x", "s", "none")], "workbook string, sheet string, text string")
    names = spark.createDataFrame([("w", "Data"), ("w", "Inputs"), ("w", "s1")], "workbook string, sheet string")
    assert [r.t for r in texts.select(sheets.task_like("text", [r"\?$", "(?i)^see "]).alias("t")).collect()] == [True, True, False, None, False]
    assert sorted(((r.text, r.mentions) for r in sheets.sheet_mentions(texts, names, "text").collect()), key=repr) == sorted([("What is the total?", None), ("see Data and Inputs", "Data"), ("data only, then inputs", "Inputs"), (None, None), ("none", None)], key=repr)
    said = spark.createDataFrame([("A1", "5", "=B1", "0%"), ("A2", None, None, "General"), ("A3", "", None, None)], "a string, v string, f string, n string").select(sheets.enhanced(*map(F.col, "avfn")).alias("s")).collect()
    assert [x.s for x in said] == ["[A1]5|FORMULA:=B1|FORMAT:0%", "[A2]", "[A3]"]


def test_small_rules(spark):
    rows = spark.createDataFrame([(11_999, 3), (12_000, 2), (12_000, 3), (None, 3), (50_000, None), (1, None)], "size long, n int")
    assert [r.b for r in rows.select(rules.below_quality_floor(F.col("size"), F.col("n")).alias("b")).collect()] == [True, True, False, None, None, True]
    cells = spark.createDataFrame([("Notes",), ("notes",), ("Data",), (None,)], "sheet string")
    assert [r.sheet for r in rules.without_sheets(cells, ["NOTES"]).collect()] == ["Data"] and rules.without_sheets(cells, []).count() == 4
    work = spark.createDataFrame([(10, 2, 60.0), (10, 3, 60.0), (10, 4, 80.0), (10, 10, 9.0), (10, 5, 0.0), (10, None, 1.0)], "total int, done int, elapsed double")
    eta = lambda workers: [r.e for r in work.select(rules.remaining_seconds(F.col("total"), F.col("done"), F.col("elapsed"), workers).alias("e")).collect()]
    assert eta(1) == [None, 140.0, 120.0, 0.0, None, None] and eta(4) == [None, None, 120.0, 0.0, None, None]


def brute_shortened(files, target, steps):
    """One directory, step by step: the largest file that the step's axis has not cut (ties by name)."""
    texts, cut = dict(files), {"rows": set(), "columns": set()}
    for step in steps:
        if sum(map(len, texts.values())) < target:
            break
        left = sorted((n for n in texts if n not in cut[step] and texts[n]), key=lambda n: (-len(texts[n]), n))
        if left:
            lines = texts[left[0]].rstrip("\n").split("\n") if step == "rows" else texts[left[0]].split("\n")
            if step == "rows" and len(lines) > 100:
                new = "\n".join([*lines[:60], f"[Rows 61-{len(lines) - 40} redacted ({len(lines) - 100} rows)]", *lines[-40:]])
            elif step == "columns":
                gone = f"[Columns 51-{max(len(x.split(',')) for x in lines) - 25} redacted]"
                new = "\n".join(x if len(x.split(",")) <= 75 or (x.startswith("[") and "redacted" in x) else ",".join([*x.split(",")[:50], gone, *x.split(",")[-25:]]) for x in lines)
            else:
                new = texts[left[0]]
            if new != texts[left[0]]:
                cut[step].add(left[0])
                texts[left[0]] = new
    return texts


def test_shortened_sources_of_the_whole_table(spark, sf_dir):
    """The registered query against the rule on every document, and the same on files of many rows."""
    from tallyweave.plans import registry

    rows = [(r.source, f"{r.doc_id:012d}", (r.text or "").replace(" ", ",")) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {}
    for source in {r[0] for r in rows}:
        want[source] = brute_shortened([(n, t) for s, n, t in rows if s == source], 60_000, budget.SOLUTION_STEPS)
    got = {r.source: (r.chars, r.files) for r in registry.QUERIES["shortened_sources"](spark, sf_dir).collect()}
    assert got == {s: (sum(map(len, t.values())), len(t)) for s, t in want.items()}
    made = [(d, f"f{k:02d}", "\n".join(",".join(str(k * c) for c in range(20 + 9 * k)) for _ in range(30 * k))) for d in ("a", "b", None) for k in range(1, 9)]
    df = spark.createDataFrame(made, "dir string, name string, text string")
    for target in (0, 50_000, 10**9):
        out = {(r.dir, r.name): r.text for r in budget.shorten(df, "dir", target).collect()}
        assert out == {(d, n): t for d in ("a", "b", None) for n, t in brute_shortened([(n, t) for x, n, t in made if x == d], target, budget.SOLUTION_STEPS).items()}


def test_cells_by_address_ids_and_steps(spark, tmp_path):
    cells = spark.createDataFrame([("w", "s", 1, 1, "=B1", "number"), ("w", "s", 2, 30, "x", "string"), ("w", "s", 9, 9, "", "string"), ("w", "e", 1, 1, None, "string")], "workbook string, sheet string, row int, col int, raw string, v_type string")
    assert [tuple(r) for r in sheets.sheet_info(cells).collect()] == [("w", "s", 1, 2, 1, 30, 2, 1, "A1:AD2")] and sheets.sheet_info(cells.limit(0)).collect() == []
    wanted = spark.createDataFrame([("w", "s", 1, 1), ("w", "s", 2, 30), ("w", "s", 7, 7), ("w", None, 1, 1)], "workbook string, sheet string, row int, col int")
    assert sorted((tuple(r)[2:] for r in sheets.formulas_at(cells, wanted).collect()), key=repr) == sorted([(1, 1, "=B1", "=B1", "number"), (2, 30, None, "x", "string"), (7, 7, None, None, None), (1, 1, None, None, None)], key=repr)
    listed = spark.createDataFrame([(1, True), (1, None), (2, False), (None, True)], "attempt_id int, corrected boolean")
    attempts = spark.createDataFrame([(2, "m", False), (3, "m", None), (4, "m", True), (5, "x", False), (6, None, False)], "attempt_id int, agent string, deprecated boolean")
    assert sorted(map(tuple, selection.candidate_ids(listed, attempts, ["m"]).collect())) == [(1, True), (2, False), (3, False)]
    log = spark.createDataFrame([("a", i % 7, i) for i in range(50)] + [(None, 1, 99)], "run string, ts int, id int")
    want = {i: k for k, i in enumerate(sorted(range(50), key=lambda i: (i % 7, i)), 1)} | {99: 1}
    assert {r.id: r.step for r in telemetry.numbered(log, ["run"], ["ts", "id"]).collect()} == want
    for name in ("w1/a.xlsx", "w1/Solution.xlsx", "w1/b.pdf", "w1/c.txt", "w2/d.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    assert sorted(map(tuple, logs.workspace_files(spark, str(tmp_path)).collect())) == [("w1", "a.xlsx", "excel", 5), ("w1", "b.pdf", "pdf", 5), ("w2", "d.pdf", "pdf", 5)]
