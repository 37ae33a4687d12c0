"""Tables that appear whole or not at all: a data source writer whose commit is one atomic step, and whose first writer wins.

Tasks write Parquet files into a folder of their run. Once all have succeeded, the driver writes a manifest of the files and makes it the
table's marker, which only one run can; readers go by the marker. Files of failed tasks, lost attempts and later writers are in no manifest, and are removed (`tidy` removes those of tasks that outlived their run).
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tallyweave.operators import telemetry

MARKER = "published.json"


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{os.path.abspath(uri)}")


def once_more[T](work: Callable[[], T], pause: float = 0.2) -> T:
    """What `work` gives; after an OSError (a lost connection) it is tried once again."""
    try:
        return work()
    except FileExistsError:
        raise
    except OSError:
        time.sleep(pause)
        return work()


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


def claim(fs: pafs.FileSystem, staged: str, marker: str) -> bool:
    """Make a staged file the marker, in one step that fails where there is one: a link on local disks, a rename elsewhere (which never replaces a file on HDFS)."""
    if isinstance(fs, pafs.LocalFileSystem):
        try:
            os.link(staged, marker)
        except FileExistsError:
            return False
        return True
    if fs.get_file_info(marker).type != pafs.FileType.NotFound:
        return False
    try:
        fs.move(staged, marker)
    except OSError:
        if fs.get_file_info(marker).type == pafs.FileType.NotFound:
            raise
        return False
    return True


class Publisher(DataSourceArrowWriter):
    def __init__(self, path: str, run: str, strict: bool):
        self.path, self.run, self.strict = path.rstrip("/"), run, strict

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = store(self.path)
        task = TaskContext.get()
        folder, name, rows, out = f"{root}/runs/{self.run}", f"part-{task.partitionId():06d}-{task.taskAttemptId()}.parquet", 0, None
        for batch in iterator:
            if out is None:
                once_more(lambda: fs.create_dir(folder, recursive=True))
                out = once_more(lambda: pq.ParquetWriter(f"{folder}/{name}", batch.schema, filesystem=fs, compression="zstd"))
            out.write_batch(batch)
            rows += batch.num_rows
        if out is not None:
            out.close()
        return Written(f"runs/{self.run}/{name}" if out is not None else None, rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        done = [m for m in messages if m is not None]
        manifest = json.dumps({"run": self.run, "rows": sum(m.rows for m in done), "files": [m.file for m in done if m.file]})
        fs, root = store(self.path)
        staged = f"{root}/runs/{self.run}.json"

        def stage() -> None:
            fs.create_dir(f"{root}/runs", recursive=True)
            with fs.open_output_stream(staged) as f:
                f.write(manifest.encode())

        once_more(stage)
        won = once_more(lambda: claim(fs, staged, f"{root}/{MARKER}"))
        if fs.get_file_info(staged).type != pafs.FileType.NotFound:
            fs.delete_file(staged)
        if not won:
            self.abort(messages)
            if self.strict:
                raise FileExistsError(f"{self.path} is published already")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = store(self.path)
        if fs.get_file_info(f"{root}/runs/{self.run}").type != pafs.FileType.NotFound:
            once_more(lambda: fs.delete_dir(f"{root}/runs/{self.run}"))


class Published(DataSource):
    """df.write.format("published").mode("append").option("path", …).save(); option `strict` makes a later writer fail instead of leaving the table as it is."""

    @classmethod
    def name(cls) -> str:
        return "published"

    def writer(self, schema: StructType, overwrite: bool) -> Publisher:
        if overwrite:
            raise ValueError("a published table is never overwritten")
        return Publisher(self.options["path"], uuid.uuid4().hex, self.options.get("strict", "false").lower() == "true")


def publish(rows: DataFrame, path: str, strict: bool = False) -> None:
    """Write `rows` as the table at `path` if nothing is published there yet; else leave what is there (`strict`: raise)."""
    spark = rows.sparkSession
    spark.dataSource.register(Published)
    spark.createDataFrame([], "x int")  # makes the session this thread's active one: by that Spark finds what is registered
    rows.write.format("published").mode("append").option("strict", str(strict)).option("path", path).save()


def tidy(path: str) -> None:
    """Remove what runs left that were given up while tasks still wrote. Not while anyone writes."""
    fs, root = store(path)
    kept = None
    if fs.get_file_info(f"{root}/{MARKER}").type != pafs.FileType.NotFound:
        with fs.open_input_stream(f"{root}/{MARKER}") as f:
            kept = json.loads(f.read())["run"]
    for x in fs.get_file_info(pafs.FileSelector(f"{root}/runs", allow_not_found=True)):
        if x.base_name != kept:
            (fs.delete_file if x.is_file else fs.delete_dir)(x.path)


def published(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The table at `path`; an error where nothing is published. A table without rows is empty, not missing."""
    root = path.rstrip("/")
    manifest = json.loads(spark.read.text(f"{root}/{MARKER}", wholetext=True).first()[0])
    if not manifest["files"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{root}/{f}" for f in manifest["files"]))


def publish_trajectory(records: DataFrame, path: str, text: str, least: int = 2048) -> bool:
    """Records as packed JSON lines, with texts of `least` characters or more once each in a table beside them; whether this writer was the first.

    A long text is replaced by {"$blob": id}. Both outputs are written, every reference is looked up in what was written, and only then do they appear, both at once."""
    spark, root, run = records.sparkSession, path.rstrip("/"), uuid.uuid4().hex
    folder = f"{root}/runs/{run}"
    found = telemetry.blobs(records, text, least)
    found.write.option("compression", "gzip").json(f"{folder}/blobs")
    ref = F.to_json(F.struct(F.substring(F.sha2(text, 256), 1, 16).alias("$blob")))
    records.withColumn(text, F.when(F.length(text) >= least, ref).otherwise(F.col(text))).write.option("compression", "gzip").json(f"{folder}/records")
    fs, local = store(path)
    rows = spark.read.schema(records.schema).json(f"{folder}/records")
    refs = rows.where(F.col(text).startswith('{"$blob"')).select(F.explode(telemetry.blob_refs(text)).alias("blob_id"))
    won = False
    try:
        if lost := telemetry.dangling(refs, spark.read.schema("blob_id string").json(f"{folder}/blobs"), "blob_id").limit(1).count():
            raise ValueError(f"{lost} reference or more has no blob")
        staged = f"{local}/runs/{run}.json"
        with fs.open_output_stream(staged) as f:
            f.write(json.dumps({"run": run}).encode())
        won = once_more(lambda: claim(fs, staged, f"{local}/{MARKER}"))
        if fs.get_file_info(staged).type != pafs.FileType.NotFound:
            fs.delete_file(staged)
    finally:
        if not won:
            fs.delete_dir(f"{local}/runs/{run}")
    return won


def published_trajectory(spark: SparkSession, path: str, schema: str | StructType, text: str) -> DataFrame:
    """The records at `path` with their texts whole."""
    root = path.rstrip("/")
    folder = f"{root}/runs/{json.loads(spark.read.text(f'{root}/{MARKER}', wholetext=True).first()[0])['run']}"
    rows = spark.read.schema(schema).json(f"{folder}/records")
    blobs = spark.read.schema("blob_id string, content string").json(f"{folder}/blobs").withColumnsRenamed({"blob_id": "__blob", "content": "__content"})
    ref = F.when(F.col(text).startswith('{"$blob"'), F.get_json_object(text, "$['$blob']"))
    return rows.withColumn("__blob", ref).join(blobs, "__blob", "left").withColumn(text, F.coalesce("__content", text)).drop("__blob", "__content").select(*rows.columns)
