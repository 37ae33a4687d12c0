"""Parquet tables of a scale-factor directory, and tables that a plan writes on its way."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a side may have to be broadcast.
SMALL = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of `sf_dir`, read lazily; columns and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(rows: DataFrame, most: int = SMALL) -> DataFrame:
    """`rows` to be broadcast where they are `most` at most; else as they are, and the join shuffles."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def one_row(rows: DataFrame, name: str, most: int = SMALL) -> DataFrame:
    """All of `rows` as one array of structs, to meet every row of another table; more than `most` are an error, not a broadcast."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows are no {name}")
    return F.broadcast(rows.agg(F.collect_list(F.struct(*rows.columns)).alias(name)))


_own: list[str] = []


def written(rows: DataFrame, label: str) -> DataFrame:
    """`rows` as a Parquet table of the shared folder (spark.checkpoint.dir): computed once, the same for all that read it, and safe from lost executors."""
    spark = rows.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:  # one machine, one process: any folder is shared
            _own.append(f"file://{tempfile.mkdtemp(prefix='tallyweave-')}")
        root = _own[0]
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """The condition that all keys are equal, NULLs too; true without keys."""
    met = F.lit(True)
    for k in keys:
        met = met & left[k].eqNullSafe(right[k])
    return met
