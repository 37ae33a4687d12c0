"""Trajectories, transcripts, plans, task lists and result files."""

from __future__ import annotations

import csv
import io
import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One superset of all kinds of trajectory records; `type` tells them apart.
TRAJECTORY = "type string, step int, ts double, category string, model string, id string, chars long, content string, request string, response string, usage struct<prompt_tokens:long,completion_tokens:long>, latency_ms double, error string, tool string, pending array<string>"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of the lines of text files, packed or not, numbered from 1, however Spark splits the files.

    A scan counts its rows as it reads them. Where each split begins in that count, and how many lines the splits before it hold, are a row for each
    split, so that lines are numbered without being ordered."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
    splits = lines.groupBy("__path", "__block").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    earlier = Window.partitionBy("__path").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("__path", "__block", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first") + 1).alias("__add"))
    return lines.join(offsets, ["__path", "__block"]).select(F.regexp_extract("__path", "([^/]+)$", 1).alias("file"), (F.col("__at") + F.col("__add")).alias("line_no"), "value")


def trajectory(spark: SparkSession, path: str, schema: str = TRAJECTORY) -> tuple[DataFrame, DataFrame]:
    """(records, bad lines with file, number and text) of JSON lines, packed or not. Blank lines are skipped, but counted."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    parsed = lines.withColumn("record", F.from_json("value", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.where("record._corrupt IS NULL").select("file", "record.*").drop("_corrupt"), parsed.where("record._corrupt IS NOT NULL").select("file", "line_no", "value")


def transcript(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; bad ones are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def plan_rows(spark: SparkSession, path: str) -> DataFrame:
    """A plan, a YAML list of {attempt_id: {…}}, as rows; entries with another shape and empty plans are errors. Plans are small and read by the driver."""
    import yaml

    entries = yaml.safe_load(Path(path).read_text()) or []
    if not entries:
        raise ValueError(f"{path} holds no plan")
    rows = []
    for n, entry in enumerate(entries):
        if not isinstance(entry, dict) or len(entry) != 1:
            raise ValueError(f"entry {n} of {path} is no single attempt")
        ((attempt, info),) = entry.items()
        more = info.get("attempt_additional_info") or {}
        rows.append((int(attempt), info.get("judge_model"), info.get("judge_mode"), info.get("judge_version"), str(info.get("judge_prompt_version")), str(info.get("rubric_version")), more.get("task_id"), more.get("agent_model_name"), more.get("prompt_version")))
    return spark.createDataFrame(rows, "attempt_id long, judge_model string, judge_mode string, judge_version int, judge_prompt_version string, rubric_version string, task_id long, agent string, prompt_version int")


def yaml_tasks(spark: SparkSession, path: str, default_source: str = "local") -> DataFrame:
    """Tasks of a YAML file or a folder of them: a task each or a list under `tasks`; those marked skip are left out."""
    import yaml

    files = sorted(Path(path).glob("*.y*ml")) if os.path.isdir(path) else [Path(path)]
    rows = []
    for f in files:
        data = yaml.safe_load(f.read_text()) or {}
        for t in data.get("tasks", [data]):
            if not t.get("skip"):
                rows.append((str(t.get("id")), t.get("name"), t.get("source", default_source), list(t.get("files") or [])))
    return spark.createDataFrame(rows, "task_id string, task_name string, task_source string, files array<string>")


def with_files(tasks: DataFrame, files: str = "files") -> DataFrame:
    return tasks.where(F.size(files) > 0)


def file_refs(column: str):
    """File references of any of the known JSON shapes (text, list of texts, list of objects, object) as array<struct<name, source>>."""
    objects = "array<struct<name:string,filename:string,url:string,path:string>>"
    c = F.trim(column)
    named = lambda a: F.transform(a, lambda x: F.struct(F.coalesce(x["name"], x["filename"]).alias("name"), F.coalesce(x["url"], x["path"]).alias("source")))
    plain = lambda a: F.transform(a, lambda x: F.struct(F.regexp_extract(x, "([^/]+)$", 1).alias("name"), x.alias("source")))
    return (
        F.when(c.isNull() | c.isin("", "null"), F.array().cast("array<struct<name:string,source:string>>"))
        .when(c.rlike(r"^\[\s*\{"), named(F.from_json(c, objects)))
        .when(c.startswith("["), plain(F.from_json(c, "array<string>")))
        .when(c.startswith("{"), named(F.from_json(F.concat(F.lit("["), c, F.lit("]")), objects)))
        .otherwise(plain(F.array(F.regexp_replace(c, '^"|"$', ""))))
    )


def golden_solution(files: DataFrame, by: str, path: str, folders: list[str]) -> DataFrame:
    """Of each task the file to compare with: by folder, earlier ones first, then the shortest name, then the name itself."""
    at = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, folders)), F.regexp_extract(path, "([^/]+)/[^/]+$", 1)), F.lit(0)), F.lit(len(folders) + 1))
    name = F.regexp_extract(path, "([^/]+)$", 1)
    return files.groupBy(by).agg(F.min_by(path, F.struct(at, F.length(name), name)).alias(path))


def context_files(files: DataFrame, by: str, name: str) -> DataFrame:
    """Context files of a task: a text with a PDF of the same stem gives way to it, and PDFs of questions alone to a PDF of answers."""
    from pyspark.sql import Window

    task, stem = Window.partitionBy(by), Window.partitionBy(by, "_stem")
    lower = F.lower(name)
    pdf = lower.endswith(".pdf")
    rows = files.withColumn("_stem", F.regexp_replace(lower, r"\.[^.]+$", ""))
    rows = rows.withColumn("_pdf", F.max(pdf.cast("int")).over(stem)).withColumn("_answer", F.max((pdf & lower.contains("answer")).cast("int")).over(task))
    keep = ~(lower.endswith(".txt") & (F.col("_pdf") == 1)) & ~(pdf & lower.contains("question") & ~lower.contains("answer") & (F.col("_answer") == 1))
    return rows.where(keep).drop("_stem", "_pdf", "_answer")


def csv_dims(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, cols) of CSV files: their records and the most fields of one; both NULL for a file that can't be read as text. An empty file has no row."""
    import pandas as pd

    def measure(batches):
        for batch in batches:
            out = []
            for name, content in zip(batch["file"], batch["content"], strict=True):
                try:
                    sizes = [len(r) for r in csv.reader(io.StringIO(content.decode("utf-8"), newline=""))]
                    out.append((name, len(sizes), max(sizes, default=0)))
                except (UnicodeDecodeError, csv.Error):
                    out.append((name, None, None))
            yield pd.DataFrame(out, columns=["file", "rows", "cols"]).astype({"rows": "Int64", "cols": "Int64"})

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "content")
    return files.mapInPandas(measure, "file string, rows long, cols long")


NAME = re.compile(r"[A-Za-z_]\w*")


def jdbc(spark: SparkSession, url: str, table: str, columns: list[str], id_col: str, ids: list | None = None, equal: dict | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, quote: str = '"', **options: str) -> DataFrame:
    """Columns of a table of a database: of the rows with one of `ids` (None: all) that hold the values of `equal` (None: NULL).

    The database filters: values go to it as literals that Spark escapes, never as text of the query. Names must be plain ones, and the table's are quoted by `quote`.
    With `bounds` of a whole-number id the table is read in `parts` ranges at a time; rows outside the bounds are in the first and last."""
    for name in (*table.split("."), *columns, id_col, *(equal or {})):
        if not NAME.fullmatch(name):
            raise ValueError(f"{name!r} is no plain name")
    options |= dict(zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), map(str, (id_col, *bounds, parts)), strict=True)) if bounds else {}
    rows = spark.read.format("jdbc").options(url=url, dbtable=".".join(f"{quote}{part}{quote}" for part in table.split(".")), **options).load()
    if ids is not None:
        rows = rows.where(F.col(id_col).isin(ids) if ids else F.lit(False))
    for name, value in (equal or {}).items():
        rows = rows.where(F.col(name).isNull() if value is None else F.col(name) == value)
    return rows.select(*columns)


def workspace_files(spark: SparkSession, path: str) -> DataFrame:
    """(workspace, file, kind, bytes) of the workbooks (but solution.xlsx) and PDFs that stand in the folders under a path; files are listed, not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"))
    named = files.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("workspace"), F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "bytes")
    kind = F.when(F.col("file").endswith(".pdf"), "pdf").when(F.col("file").endswith(".xlsx") & (F.lower("file") != "solution.xlsx"), "excel")
    return named.withColumn("kind", kind).where("kind IS NOT NULL").select("workspace", "file", "kind", "bytes")


def config(defaults: dict, own: dict) -> dict:
    """`own` laid over `defaults`, dict by dict, with ${env:NAME:-default} filled in."""

    def fill(value):
        if isinstance(value, dict):
            return {k: fill(v) for k, v in value.items()}
        if isinstance(value, list):
            return [fill(v) for v in value]
        return re.sub(r"\$\{env:(\w+)(?::-([^}]*))?\}", lambda m: os.environ.get(m[1], m[2] or ""), value) if isinstance(value, str) else value

    def merge(a: dict, b: dict) -> dict:
        return a | {k: merge(a[k], v) if isinstance(a.get(k), dict) and isinstance(v, dict) else v for k, v in b.items()}

    return fill(merge(defaults, own))


def result_rows(spark: SparkSession, path: str, labels: list[str], value: str, group: str) -> DataFrame:
    """(label, group, value double) of the `rows` of JSON result files: of the given labels, with a group and a value that is a number."""
    rows = spark.read.option("multiLine", "true").json(path).select(F.explode("rows").alias("r")).select("r.*")
    out = rows.select(F.col("model_label").alias("label"), F.col(group).cast("string").alias("group"), F.col(value).cast("string").try_cast("double").alias("value"))
    return out.where(F.col("label").isin(labels) & F.col("group").isNotNull() & F.col("value").isNotNull())
