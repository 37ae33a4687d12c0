"""Where results go: partitioned Parquet, JSON and CSV files, upserts, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attempts(rows: DataFrame, path: str) -> None:
    """Attempts appended under task_source=…/task_id=…."""
    rows.write.mode("append").partitionBy("task_source", "task_id").parquet(path)


def ndjson(rows: DataFrame, path: str, compressed: bool = False) -> None:
    rows.write.mode("append").option("compression", "gzip" if compressed else "none").json(path)


def run_manifest(rows: DataFrame, path: str, stamp: str) -> None:
    """A folder for each run; a run that is there stays as it is."""
    rows.write.mode("ignore").json(f"{path}/{stamp}")


def coverage_csv(rows: DataFrame, path: str) -> None:
    """Numbers with four decimals, booleans as 0 and 1, NULLs blank."""
    shown = [F.format_string("%.4f", c) if t == "double" else F.col(c).cast("int") if t == "boolean" else F.col(c) for c, t in rows.dtypes]
    rows.select(*(F.when(F.col(c).isNotNull(), s).alias(c) for c, s in zip(rows.columns, shown, strict=True))).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def score_matrix(scores: DataFrame, grid: DataFrame, keys: list[str], path: str) -> None:
    """Every cell of the grid with its scores, blanks where there are none."""
    grid.join(scores, keys, "left").write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`old` with the rows of `new` in place of those with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def grading_rows(results: DataFrame) -> DataFrame:
    """Results with failed and failed_reason as stored with a grading."""
    from tallyweave.operators.scoring import failure_reason

    out = results.withColumn("failed_reason", failure_reason())
    return out.withColumn("failed", F.col("failed_reason").isNotNull())


def log_by_thread(lines: DataFrame, path: str, pattern: str = r"\[([\w-]+)\]") -> None:
    """Lines (file, line_no, value) in a folder for each thread; lines without a header belong to the last one seen."""
    from tallyweave.operators.telemetry import forward_fill

    header = F.nullif(F.regexp_extract("value", pattern, 1), F.lit(""))
    forward_fill(lines.withColumn("header", header), ["file"], ["line_no"], "header", "thread").drop("header").write.mode("overwrite").partitionBy("thread").parquet(path)


def report_yaml(rows: DataFrame, path: str, most: int = 100_000) -> None:
    """A small result as YAML; larger ones are an error, not cut."""
    import yaml

    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows are no report")
    with open(path, "w") as f:
        yaml.safe_dump([r.asDict(recursive=True) for r in found], f, sort_keys=False)
