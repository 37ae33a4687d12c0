"""Approximate nearest neighbours by a permutation index.

Pivots are a sample of the vectors; their number grows with the vectors (from LEAST_PIVOTS to MOST_PIVOTS), so that the list of a pivot
holds about LIST of them. Every vector is represented by the order of its NEAREST pivots and posted, with that order, in the
inverted files of the POSTED nearest. A query visits the files of its VISITED nearest pivots alone. There the vectors
are ranked by the footrule distance between their order and the query's (a pivot that only one of both ranks
counts as ranked after the last by the other); the part RERANKED of smallest footrule, RERANKED_LEAST at least, is ranked
again by the exact distance. The best of all visited files are the result. What a query reads does not grow with the table below LIST * MOST_PIVOTS / POSTED vectors.

Copies of a vector are one entry with the k + 1 smallest ids, which are all that any result can hold; a list of more than LIST entries is dealt
into several. So neither a hot vector nor a hot pivot gathers in one task.

An id stands for the set of its vectors: repeated rows count once, and the distance of two ids whose rows differ is that of their nearest
vectors. So a result names an id once, and never the query's own. Ties go to the smaller id. Vectors that are null,
zero, or hold null or non-finite components, rows with a null id, and vectors whose length is not that of most (ties: the shorter) take no part. An
empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import materialize

LEAST_PIVOTS, MOST_PIVOTS, LIST = 128, 65_536, 8_192
#: Bytes of all pivots, which every task holds (a bound of MOST_PIVOTS for long vectors), and pivots that a batch of vectors is compared with at a time.
PIVOT_BYTES, PIVOTS_AT_ONCE = 128_000_000, 4_096
#: Pivots that represent a vector, those in whose files it is posted, those that a query visits.
NEAREST, POSTED, VISITED = 64, 8, 24
#: The part of a list that is ranked by exact distances, and how many of it at least.
RERANKED, RERANKED_LEAST = 0.2, 64


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>) of the rows that take part, each pair once."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(fine & F.exists("v", lambda x: x != 0)).distinct()


def orders(v: np.ndarray, pivots: np.ndarray, most: int, at_once: int = PIVOTS_AT_ONCE) -> np.ndarray:
    """Each row's nearest pivots, nearest first, ties by number. Pivots are compared `at_once` at a time, and only the nearest so far are kept and sorted."""
    far, near = np.zeros((len(v), 0)), np.zeros((len(v), 0), dtype=np.int64)
    for a in range(0, len(pivots), at_once):
        part = pivots[a : a + at_once]
        square = np.square(v).sum(1)[:, None] - 2 * v @ part.T + np.square(part).sum(1)[None, :]
        far = np.concatenate([far, square], axis=1)
        near = np.concatenate([near, np.broadcast_to(np.arange(a, a + len(part)), square.shape)], axis=1)
        if far.shape[1] > most:
            kept = np.sort(np.argpartition(far, most - 1, axis=1)[:, :most], axis=1)  # in order of numbers
            far, near = np.take_along_axis(far, kept, axis=1), np.take_along_axis(near, kept, axis=1)
    return np.take_along_axis(near, np.argsort(far, axis=1, kind="stable"), axis=1)


def with_orders(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """`rows` (.., v) with the column `near`: the NEAREST pivots of v, nearest first."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2_000):
                part = batch.slice(a, 2_000)
                near = orders(np.stack(part.column("v").to_numpy(zero_copy_only=False)), pivots, NEAREST)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near.shape[1]), pa.int32()), pa.array(near.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "near"])

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{columns}, near array<int>")


def footrule_saved(orders_: np.ndarray, query: np.ndarray, n_pivots: int) -> np.ndarray:
    """How much smaller each row's footrule distance to `query` is than that of an order without a common pivot."""
    k = orders_.shape[1]
    rank = np.full(n_pivots, k, dtype=np.int32)
    rank[query] = np.arange(k)
    theirs, own = rank[orders_], np.arange(k)[None, :]
    return np.where(theirs < k, 2 * k - theirs - own - np.abs(theirs - own), 0).sum(1)


def search(entries: pd.DataFrame, asked: pd.DataFrame, n_pivots: int, k: int) -> pd.DataFrame:
    """(query, mark, vec_id, score): the k nearest ids found in one list for each query that visits it."""
    found = []
    if len(entries) and len(asked):
        vectors, near = np.stack(entries["v"].to_list()), np.stack(entries["near"].to_list())
        least = np.array([ids[0] for ids in entries["ids"]])
        most = min(len(entries), max(RERANKED_LEAST, int(np.ceil(RERANKED * len(entries)))))
        for query, mark, v, own in zip(asked["query"], asked["mark"], asked["v"], asked["near"], strict=True):
            rows = np.lexsort((least, -footrule_saved(near, own, n_pivots)))[:most]
            far = np.sqrt(np.square(vectors[rows] - v).sum(1))
            best = np.lexsort((least[rows], far))[:k]  # ids of equal distance beyond the k-th entry are not smaller
            pairs = sorted((far[j], i) for j in best for i in entries["ids"].iloc[rows[j]])
            seen: set[int] = set()
            for score, i in pairs:
                if i not in seen and len(seen) < k:
                    seen.add(i)
                    found.append((query, mark, i, score))
    return pd.DataFrame(found, columns=["query", "mark", "vec_id", "score"]).astype({"query": "int64", "mark": "int64", "vec_id": "int64", "score": "float64"})


def best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """`found` with each vec_id once and the k of smallest (score, vec_id) of each group, and their `rank`."""
    once = found.groupBy(*by, "vec_id").agg(F.min("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("score", "vec_id"))).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of the k nearest ids found for each query id; its own is left out."""
    index, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    common = index.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, asked = index.where(F.size("v") == common["d"]), asked.where(F.size("v") == common["d"])
    copies = index.withColumn("copy", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("copy") <= k + 1)
    entries = materialize(copies.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "entries")
    size = entries.count()
    n_pivots = max(LEAST_PIVOTS, min(MOST_PIVOTS, PIVOT_BYTES // (8 * common["d"]), -(-size * POSTED // LIST)))
    pivots = np.array([r["v"] for r in entries.orderBy(F.xxhash64("v", F.lit("pivot")), "v").limit(n_pivots).select("v").collect()])
    posted = materialize(with_orders(entries, pivots), "posted")
    lists = posted.select(F.explode(F.slice("near", 1, POSTED)).alias("pivot")).groupBy("pivot").count().select("pivot", F.ceil(F.col("count") / LIST).cast("int").alias("parts"))
    lists = F.broadcast(materialize(lists, "lists"))  # a row for each pivot, MOST_PIVOTS at most
    left = posted.withColumn("pivot", F.explode(F.slice("near", 1, POSTED))).join(lists, "pivot").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
    # Queries of equal vectors search once; `query` and `mark` name the vector.
    marked = asked.withColumn("mark", F.xxhash64("v"))
    searched = marked.groupBy("v", "mark").agg(F.min("id").alias("query"))
    visits = with_orders(searched, pivots).withColumn("pivot", F.explode(F.slice("near", 1, VISITED))).join(lists, "pivot").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left, right = left.select("pivot", "part", "ids", "v", "near"), visits.select("pivot", "part", "query", "mark", "v", "near")
    n = len(pivots)
    found = left.groupBy("pivot", "part").cogroup(right.groupBy("pivot", "part")).applyInPandas(lambda a, b: search(a, b, n, k + 1), "query long, mark long, vec_id long, score double")
    ranked = materialize(best(found, ["query", "mark"], k + 1).drop("rank"), "found")
    members = marked.join(searched.select("v", "query"), "v").select("id", "query", "mark")
    mine = members.join(ranked, ["query", "mark"]).where(F.col("id") != F.col("vec_id")).select(F.col("id").alias("query_id"), "vec_id", "score")
    return best(mine, ["query_id"], k).select("query_id", "rank", "vec_id", "score")
