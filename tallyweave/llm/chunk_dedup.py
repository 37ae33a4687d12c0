"""Substring dedup by content-defined chunks.

A gear rolling hash over the last 32 bytes ends a chunk wherever its low bits are zero, so an insertion moves only the
ends near it. A chunk is shared where the same bytes (by a 128-bit digest) are a chunk of a document with a smaller id;
repeats within one document are not. Consecutive shared chunks are removed where together they have RUN bytes or more, or
are the whole text: a stray phrase or ending that documents have in common stays. The chunks left, in order, are the kept text.

Null texts count as empty; an empty text has no chunk. Rows with a null id take no part: they keep all of their text and
take nothing from others. Rows that share an id are cut apart but never remove each other's chunks. Texts of any length are cut whole.
Ties: of equal chunks the smallest id keeps its own. A chunk that very many documents hold is dealt over several tasks. An empty table gives no rows; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import hot_keys, in_chunks, materialize, mix64, salted_join

#: Low bits of the rolling hash that end a chunk when zero, and the sizes in bytes between which chunks stay (a text may be smaller).
MASK, LEAST, MOST = np.uint32(31), 16, 256
#: Bytes of consecutive shared chunks that are removed at least.
RUN = 50
GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
AT_ONCE = 4_000_000


def gear_hash(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of it and the 31 bytes before: sum of GEAR[byte] << distance, modulo 2 ** 32. By doubling spans."""
    h = GEAR[data]
    for span in (1, 2, 4, 8, 16):
        longer = h.copy()
        longer[span:] += h[:-span] << np.uint32(span)
        h = longer
    return h


def cut(data: np.ndarray) -> list[int]:
    """Where the chunks of one text end."""
    n, out, last = len(data), [], 0
    for c in (np.flatnonzero((gear_hash(data) & MASK) == 0) + 1).tolist():
        while c - last > MOST:
            last += MOST
            out.append(last)
        if c - last >= LEAST:
            out.append(c)
            last = c
    while n - last > MOST:
        last += MOST
        out.append(last)
    if last < n:
        if out and n - last < LEAST:
            # Too short for a chunk: it joins the one before, which gives up its own end where both are too long for one.
            out.pop()
            if n - (out[-1] if out else 0) > MOST:
                out.append(n - LEAST)
        out.append(n)
    return out


def chunks(raw: bytes) -> list[tuple[int, int, bytes]]:
    """(begin, end, digest) of each chunk of a text's bytes."""
    begin, out = 0, []
    for end in cut(np.frombuffer(raw, dtype=np.uint8)):
        out.append((begin, end, hashlib.blake2b(raw[begin:end], digest_size=16).digest()))
        begin = end
    return out


def removed(parts: list[tuple[int, int, bytes]], shared: dict) -> list[bool]:
    """Which of a text's chunks are in runs of shared ones of RUN bytes or more, or of the whole text."""
    out, k = [False] * len(parts), 0
    while k < len(parts):
        if parts[k][2] not in shared:
            k += 1
            continue
        begin = k
        while k < len(parts) and parts[k][2] in shared:
            k += 1
        if parts[k - 1][1] - parts[begin][0] >= RUN or k - begin == len(parts):
            out[begin:k] = [True] * (k - begin)
    return out


def chunk_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest): each document's distinct chunks."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in in_chunks(texts, AT_ONCE):
                at, digests = [], []
                for i in range(a, b):
                    if texts[i]:
                        own = {d for _, _, d in chunks(texts[i].encode("utf-8", "surrogatepass"))}
                        at += [i] * len(own)
                        digests += own
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), pa.array(digests, pa.binary())], ["id", "digest"])

    return docs.where(F.col(id_col).isNotNull()).selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, f"id {id_type}, digest binary")


def shared_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, shared array<binary>, firsts array<id>): for each document that repeats chunks of smaller ids, those chunks and beside each the smallest id that holds it."""
    rows = chunk_rows(docs, id_col, text_col)
    shared = rows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")).where("first < last").select("digest", "first", "n")
    shared = materialize(shared, "shared")
    found = salted_join(rows, shared.drop("n"), "digest", hot_keys(shared, "digest", "n")).where("first < id").groupBy("id").agg(F.collect_set(F.struct("digest", "first")).alias("found"))
    return found.select("id", F.col("found.digest").alias("shared"), F.col("found.first").alias("firsts"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_chunks, n_removed_chunks, n_removed, kept binary, repeats_of array<id>) of every row."""
    found = shared_digests(docs, id_col, text_col)
    id_type = docs.schema[id_col].dataType.simpleString()
    joined = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").join(found, "id", "left").select("id", "text", "shared", "firsts")

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in in_chunks(texts, AT_ONCE):
                rows = []
                for text, digests, firsts in zip(texts[a:b], batch.column("shared").slice(a, b - a).to_pylist(), batch.column("firsts").slice(a, b - a).to_pylist(), strict=True):
                    raw = text.encode("utf-8", "surrogatepass") if text else b""
                    parts = chunks(raw)
                    shared = dict(zip(digests, firsts, strict=True)) if digests else {}
                    gone = removed(parts, shared)
                    kept = b"".join([raw[x:y] for (x, y, _), out in zip(parts, gone, strict=True) if not out]) if any(gone) else raw
                    of = sorted({shared[d] for (_, _, d), out in zip(parts, gone, strict=True) if out})
                    rows.append((len(raw), len(parts), sum(gone), len(raw) - len(kept), kept, of))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary()), pa.array(columns[5], batch.column("firsts").type)],
                    ["id", "n_bytes", "n_chunks", "n_removed_chunks", "n_removed", "kept", "repeats_of"],
                )

    schema = f"id {id_type}, n_bytes long, n_chunks long, n_removed_chunks long, n_removed long, kept binary, repeats_of array<{id_type}>"
    return joined.mapInArrow(run, schema).withColumnRenamed("id", id_col)
