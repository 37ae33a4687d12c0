"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir. Without one nothing can be written that all would see."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:  # one machine, one process: any folder is shared
        _own_dir.append(f"file://{tempfile.mkdtemp(prefix='tallyweave-')}")
    return _own_dir[0]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """`df` written to the shared folder and read back: its lineage ends there, and lost executors cost no earlier stage."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key with more than one in HOT_PARTS of the rows is hot; so there are fewer hot keys than that, whatever the input.
HOT_PARTS = 1_000


def hot_keys(counts: DataFrame, key: str, n: str, total: int | None = None) -> DataFrame:
    """(key, parts) of the hot keys of `counts` (key, n rows), each key standing there once; HOT_PARTS rows at most. `total`, if known: the rows, or more."""
    total = (counts.agg(F.sum(n)).first()[0] or 0) if total is None else total
    return counts.where(F.col(n) > max(1, total // HOT_PARTS)).select(key, F.ceil(F.col(n) * HOT_PARTS / F.lit(max(total, 1))).cast("int").alias("__parts"))


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """left JOIN right USING (key), with the rows of a hot key of `left` dealt over several tasks. A hot key's rows of `right` go to each of them."""
    hot = F.broadcast(hot)  # bounded, see hot_keys
    dealt = left.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    every = right.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return dealt.join(every.hint("merge"), [key, "__salt"], how).drop("__salt")


def held_out(id_col: str, parts: int, left_out: int):
    """True for rows whose crc32 of the id, as text, leaves `left_out` on division by `parts`; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == left_out, F.lit(False))


def utf8(texts) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes one after the other, and where each begins (one more entry marks the end). Null: empty."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(b) for b in raw], out=ends[1:])
    return np.frombuffer(b"".join(raw), dtype=np.uint8), ends


def in_chunks(texts, limit: int):
    """(begin, end) ranges of rows whose texts together stay near `limit` characters, so that one batch never needs unbounded memory."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if size and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (xor-shift, multiply), for hashing."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def give_back() -> None:
    """Return to the system what freed arrays leave in the allocators: a worker lives on beside the stages that follow."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


def map_texts(docs: DataFrame, work, columns: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = 16_000_000) -> DataFrame:
    """A row (id, *columns) for each row of `docs`, without a shuffle.

    `work()` is called once in a task and gives a function from a list of texts (None for null) to a dict of columns,
    each as long as the list. Texts come in runs of about `chunk` characters. Ids pass through untouched, nulls too.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [c.name for c in StructType.fromDDL(columns)]

    def run(batches):
        own = work()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in in_chunks(texts, chunk):
                got = own(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), *(pa.array(got[n], fields[n]) for n in names)], ["id", *names])
        give_back()

    fields = {f.name: f.type for f in to_arrow_schema(StructType.fromDDL(columns))}
    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, f"id {id_type}, {columns}").withColumnRenamed("id", id_col)


MULTIPLIER = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
_BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: dict[str, np.ndarray] = {}


def powers(name: str, base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1 modulo 2 ** 64; a worker keeps the longest so far."""
    if len(_powers.get(name, ())) < n:
        steps = np.full(n, base, dtype=np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers[name][:n]


def span_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span data[begin:end]; equal bytes give equal hashes wherever they stand."""
    if not len(begins):
        return np.zeros(0, dtype=np.uint64)
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODES[data] * powers("up", MULTIPLIER, max(n, 1)), out=sums[1:])
    return mix64((sums[ends] - sums[begins]) * powers("down", INVERSE, n + 1)[begins] + (ends - begins).astype(np.uint64))


def runs(inside: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begins, ends) of the maximal runs of True in `inside`; a run never crosses a position of `breaks`."""
    if not len(inside):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    edge = np.ones(len(inside), dtype=bool)
    edge[1:] = ~inside[:-1]
    edge[breaks[breaks < len(inside)]] = True
    last = np.ones(len(inside), dtype=bool)
    last[:-1] = edge[1:] | ~inside[1:]
    return np.flatnonzero(inside & edge), np.flatnonzero(inside & last) + 1


def words(data: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begins, ends, document) of the words of a batch: the maximal runs of bytes above the space, split at documents' ends."""
    begins, ends = runs(data > 32, doc_ends[:-1])
    return begins, ends, np.searchsorted(doc_ends, begins, side="right") - 1


def per_doc(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of `values` by document."""
    return np.bincount(owner, weights=values, minlength=n)
