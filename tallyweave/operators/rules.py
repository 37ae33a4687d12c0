"""Ordered rules over attempts, outputs, sheets and formulas, as columns; and small driver-side texts (templates, rubrics)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import formulas

# Texts that tell a provider's refusal, exit codes of a run, words that mark a formula as a stand-in.
INFRA_SIGNATURES = ["invalid x-api-key", "authentication_error", "invalid api key", "incorrect api key", "credit balance is too low", "insufficient_quota", "billing", "401 unauthorized"]
EXIT_STATUS = {0: "success", 2: "config_error", 3: "no_tasks", 4: "env_blocked"}
PLACEHOLDERS = ["placeholder", "Placeholder", "PLACEHOLDER", "TODO", "FIXME", "TEMP"]
QUALITY_MIN_BYTES, QUALITY_MIN_SHEETS = 12_000, 3
NOGRADE = "_nograde_"


def status_of(code: str) -> Column:
    """A run's status by exit code; all others failed."""
    pairs = F.create_map(*[F.lit(x) for kv in EXIT_STATUS.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.col(code)), F.lit("failed"))


def refused(text: str | Column, tail: int = 20_000) -> Column:
    """Whether the end of a transcript tells of a provider's refusal."""
    c = F.lower(F.right(F.col(text) if isinstance(text, str) else text, F.lit(tail)))
    out = F.lit(False)
    for s in INFRA_SIGNATURES:
        out = out | c.contains(s)
    return F.coalesce(out, F.lit(False))


def verdict(junk_seconds: int) -> Column:
    """The first rule that holds, over infra_error, transcript, timed_out, has_solution, other_workbooks, sheets (NULL: unreadable), seeded (same bytes as an input) and seconds."""
    return (
        F.when(F.coalesce(F.col("infra_error"), F.lit("")) != "", "infra_failure")
        .when(refused("transcript") & ~F.col("has_solution"), "infra_failure")
        .when(F.col("timed_out"), "timeout")
        .when(~F.col("has_solution") & (F.col("other_workbooks") > 0), "needs_review")
        .when(~F.col("has_solution"), "agent_failure")
        .when(F.coalesce(F.col("sheets"), F.lit(0)) == 0, "agent_failure")
        .when(F.col("seeded"), "agent_failure")
        .when(F.col("seconds") < junk_seconds, "needs_review")
        .otherwise("success")
    )


def below_quality_floor(size: Column, n_sheets: Column) -> Column:
    return (size < QUALITY_MIN_BYTES) | (n_sheets < QUALITY_MIN_SHEETS)


def counts_as_failure(failed: Column, reason: Column) -> Column:
    """Running out of iterations is no failure."""
    return F.coalesce(failed, F.lit(False)) & ~F.coalesce(reason.startswith("Max iterations"), F.lit(False))


def pipeline_of(agent: str | Column) -> Column:
    a = F.col(agent) if isinstance(agent, str) else agent
    return F.when(a.startswith("claudecode_") | a.startswith("codex_"), "Coding agent").when(a.startswith("openpyxl"), "CLI/API").when(a.contains("excel_agent"), "Excel add-in").otherwise("GUI")


def usable(scored_results: str) -> Column:
    """Whether scored results, a JSON object, have no unscored checks; unreadable ones are not usable."""
    whole = F.from_json(scored_results, "map<string,string>")
    unscored = F.from_json(F.get_json_object(scored_results, "$.scoring_warnings.unscored_checks"), "map<string,string>")
    return F.coalesce(whole.isNotNull() & (F.coalesce(F.size(F.coalesce(unscored, F.create_map().cast("map<string,string>"))), F.lit(0)) == 0), F.lit(False))


def browse(queue: DataFrame, equal: dict[str, str] | None = None, contains: dict[str, str] | None = None, reviewed: bool | None = None, limit: int = 500) -> DataFrame:
    """The first rows of a review queue (grading_id, annotators array<string>, …) that match all filters."""
    out = queue
    for c, v in (equal or {}).items():
        out = out.where(F.col(c) == v)
    for c, v in (contains or {}).items():
        out = out.where(F.lower(c).contains(v.lower()))
    if reviewed is not None:
        out = out.where((F.size("annotators") > 0) == F.lit(reviewed))
    return out.orderBy("grading_id").limit(limit)


def annotators(annotations: DataFrame, queue: DataFrame) -> DataFrame:
    """The queue with the sorted set of those who annotated each grading."""
    who = annotations.groupBy("grading_id").agg(F.sort_array(F.collect_set("annotator")).alias("annotators"))
    return queue.join(who, "grading_id", "left").withColumn("annotators", F.coalesce("annotators", F.array().cast("array<string>")))


def graded_sheet_name(name: str | Column) -> Column:
    """Sheets of answers and models lose their prefix, others are marked as not to be graded."""
    c = F.col(name) if isinstance(name, str) else name
    return F.when(c.startswith("answers_"), F.substring(c, F.lit(9), F.length(c))).when(c.startswith("model_"), F.substring(c, F.lit(7), F.length(c))).otherwise(F.concat(F.lit(NOGRADE), c))


def without_sheets(cells: DataFrame, ignored: list[str]) -> DataFrame:
    return cells.where(~F.lower("sheet").isin([s.lower() for s in ignored])) if ignored else cells


def formula_gate(formula: str, sheet: Column, sheets: Column, cell: Column) -> Column:
    """Why a formula (with or without =) may not be set, or NULL: the first of stand-in, constant, text, missing sheet, invalid, trailing operator."""
    raw = F.col(formula)
    f = F.when(raw.startswith("="), raw).otherwise(F.concat(F.lit("="), raw))
    body = F.trim(F.substring(f, F.lit(2), F.length(f)))
    stand_in = F.lit(False)
    for p in PLACEHOLDERS:
        stand_in = stand_in | body.contains(p)
    quoted = body.rlike("^\".*\"$") | body.rlike("^'.*'$")
    named = F.transform(F.regexp_extract_all(f, F.lit(r"('[^']+'|[A-Za-z_][A-Za-z0-9_]*)!"), F.lit(1)), lambda x: F.regexp_replace(x, "'", ""))
    return (
        F.when(stand_in, "placeholder")
        .when(F.replace(body, F.lit(","), F.lit("")).try_cast("double").isNotNull(), "constant")
        .when(quoted, "text")
        .when(~F.array_contains(sheets, sheet), "no such sheet")
        .when(F.size(F.array_except(named, sheets)) > 0, "missing sheet")
        .when(F.size(formulas.errors(f, cell, sheet)) > 0, "invalid")
        .when(F.rtrim(f).rlike(r"[-+*/=><,]$"), "trailing operator")
    )


def text_in_arithmetic(formula_cells: DataFrame, cells: DataFrame) -> DataFrame:
    """(workbook, sheet, row, col, ref) of formulas that use a cell of text next to an operator (three characters either side), plain references of the same sheet."""
    refs = formula_cells.where(F.col("raw").startswith("=")).select("workbook", "sheet", "row", "col", "raw", F.explode(F.array_distinct(F.regexp_extract_all("raw", F.lit(r"[A-Z]+[0-9]+(?![A-Z0-9])"), F.lit(0)))).alias("ref"))
    at = F.instr(F.col("raw"), F.col("ref"))
    begin = F.greatest(F.lit(1), at - 3)
    near = F.substring(F.col("raw"), begin, at - begin + F.length("ref") + 3)
    refs = refs.where(near.rlike(r"[-*/+^()]")).withColumn("position", formulas.cell_position("ref"))
    texts = cells.where((F.col("v_type") == "string") & ~F.col("raw").startswith("=")).select("workbook", "sheet", F.col("row").alias("r"), F.col("col").alias("c"))
    joined = refs.select("workbook", "sheet", "row", "col", "ref", F.col("position.row").alias("r"), F.col("position.col").alias("c")).join(texts, ["workbook", "sheet", "r", "c"], "left_semi")
    return joined.select("workbook", "sheet", "row", "col", "ref")


def remaining_seconds(total: Column, completed: Column, elapsed: Column, workers: int) -> Column:
    """An estimate once every worker, and three tasks at least, are through; NULL before."""
    return F.when((completed >= max(3, workers)) & (elapsed > 0), (total - completed) * elapsed / completed)


def render(template: str, values: dict, nullable: set[str] = frozenset()) -> str:
    """{{ name }} filled in; a name without a value is an error, unless it may be empty."""

    def one(m: re.Match) -> str:
        if m[1] in nullable and values.get(m[1]) is None:
            return ""
        return str(values[m[1]])

    return re.sub(r"\{\{\s*(\w+)\s*\}\}", one, template)


def uniform_weights(rubric: dict[str, list[str]]) -> list[tuple[str, str, float]]:
    """(category, check, weight): within a category all checks weigh the same, to four digits."""
    return [(category, check, round(1 / len(checks), 4)) for category, checks in rubric.items() for check in checks]


def next_id(rows: DataFrame, id_col: str) -> int:
    """One more than the greatest id; 1 for none."""
    return (rows.agg(F.max(id_col)).first()[0] or 0) + 1


def parsed_rubric(text: str, names: dict[str, str]) -> dict[str, list[dict[str, str]]]:
    """The checks of a rubric's text by category: name, description, good, bad.

    The text has sections under a header between two lines of `=`, and in them blocks between lines of `-`: a name, a description, and what
    follows `Good:` and `Bad:`. `names` maps headers to categories. Unknown headers, blocks of another form and empty sections are errors.
    """
    out: dict[str, list[dict[str, str]]] = {}
    lines = text.splitlines()
    rule = lambda k, c: 0 <= k < len(lines) and len(lines[k]) >= 10 and set(lines[k]) == {c}
    heads = [k for k in range(len(lines)) if rule(k - 1, "=") and rule(k + 1, "=") and lines[k].strip()]
    for head, end in zip(heads, [*(h - 1 for h in heads[1:]), len(lines)], strict=True):
        title = lines[head].strip()
        if title not in names:
            raise ValueError(f"unknown rubric section {title!r}")
        blocks, block = [], []
        for k in range(head + 2, end):
            if rule(k, "-"):
                blocks.append(block)
                block = []
            else:
                block.append(lines[k].strip())
        checks = [_rubric_check(b) for b in [*blocks, block] if any(b)]
        if not checks:
            raise ValueError(f"no checks in rubric section {title!r}")
        out[names[title]] = checks
    return out


def _rubric_check(lines: list[str]) -> dict[str, str]:
    lines = [x for x in lines if x]
    good = next((k for k, x in enumerate(lines) if x.startswith("Good:")), None)
    bad = next((k for k, x in enumerate(lines) if x.startswith("Bad:") and good is not None and k > good), None)
    if bad is None or good < 2:
        raise ValueError(f"not a check: {' '.join(lines)[:100]}")
    flat = lambda a, b, cut=0: " ".join(" ".join(lines[a:b])[cut:].split())
    return {"name": flat(0, 1), "description": flat(1, good), "good": flat(good, bad, 5), "bad": flat(bad, len(lines), 4)}
