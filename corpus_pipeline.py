"""A corpus pipeline: each stage calls one operator, keeps the columns of documents (but the last), and is written before the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import byte_bpe, mixing, ngram_join, quality, suffix_dedup
from tallyweave.llm.common import materialize, table

#: Documents are rejected that are under the quantile of the score and whose likelihood of good quality is under this.
LEAST_QUALITY = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Bradley-Terry ranking, fitted on the labelled ones, holds good. Rows with a null id are judged like any other.

    The threshold is the quantile of the score that parts off the share of bad documents among the labelled ones; a document under it stays
    all the same where its likelihood is not low, so that a corpus better than its labels loses nothing good.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    marked = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), F.col("text"))
    scored = quality.ranked(marked, model, id_col="row")
    return scored.where(F.col("above") | (F.col("score") >= LEAST_QUALITY)).select("row.*")


def text_digest(text: str = "text"):
    """A 128-bit digest of a text; null has none of its own but the empty bytes."""
    return F.coalesce(F.unhex(F.md5(text)), F.lit(b""))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: the one with the smallest id and, of that id, the smallest text digest.

    Rows that share an id but not a text are classed one by one; of rows that share both, the least by all columns stays. Rows with a null id are kept.
    """
    keyed = docs.where("doc_id IS NOT NULL").withColumn("__near", F.struct("doc_id", text_digest().alias("digest")))
    kept = ngram_join.join(keyed, id_col="__near").where("class_id = __near").select("__near")
    one = keyed.join(kept, "__near", "left_semi").groupBy("__near").agg(F.min(F.struct(*(F.col(c) for c in docs.columns))).alias("__row"))
    return one.select("__row.*").unionByName(docs.where("doc_id IS NULL"))


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the text that the suffix-array dedup leaves; bytes cut within a character are dropped with it. Texts that are lost whole go.

    Rows keep their other columns through the operator, so nothing is joined again; a null id never has text removed, a null text stays null.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    cut = suffix_dedup.dedup(docs.withColumn("__null", F.col("text").isNull()), carry=(*others, "__null"))
    whole = F.col("kept").cast("string")
    left = F.when(F.col("n_removed") > 0, F.replace(F.make_valid_utf8(whole), F.lit("\ufffd"), F.lit(""))).otherwise(whole)
    rows = cut.select("doc_id", F.col("n_removed").alias("__removed"), F.when(~F.col(f"carry.c{len(others)}"), left).alias("text"), *(F.col(f"carry.c{i}").alias(c) for i, c in enumerate(others)))
    kept = rows.where((F.col("__removed") == 0) | (F.length(F.trim("text")) > 0)).drop("__removed")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by raked probabilities. Null languages, sources and topics are values of their own; an id that stands twice is drawn alike, rows with a null id too; ties cannot arise, for a row is kept by its own draw alone."""
    return mixing.sample(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of the documents left, a row each: null texts have no tokens, repeated rows and null ids are coded like any other."""
    coded = byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, chunk=250_000, remembered=100_000, pieces_at_once=10_000)
    return coded.drop("decoded")


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", suffix_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE", tokens_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE_SQL = {"pipeline": None}
