"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tallyweave.llm import alignment, byte_bpe, chunk_dedup, fim, langid, media, mixing, neighbours, ngram_join, quality, suffix_dedup, token_files, toxicity
from tallyweave.llm.common import held_out, table


def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.query_digest(suffix_dedup.dedup(table(spark, sf_dir, "documents")))


def op2_media_columns(spark, sf_dir):
    return media.query_feature(media.media_columns(table(spark, sf_dir, "documents")))


def op3_ngram_join(spark, sf_dir):
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op4_mixing(spark, sf_dir):
    decided = mixing.decide(table(spark, sf_dir, "documents"))
    return decided.select("doc_id", "mix.topic", "mix.n_tokens", F.round("mix.probability", 6).alias("probability"), "mix.kept", F.round("mix.gap", 6).alias("gap"))


def op5_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = toxicity.train(docs, labels.where(~held_out("doc_id", 4, 2)))
    scored = toxicity.scores(docs, machine)
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "margin", "n_sentences")


def op6_permutation_index(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op7_language_mixture(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out("doc_id", 4, 2)))
    found = langid.predict(docs, model)
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "languages", "proportions")


def op8_quality_ranking(spark, sf_dir):
    """`predicted` goes by the score alone; the pipeline rejects a document only if it is under the quantile (not `above_quantile`) and under 0.3 as well."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(~held_out("doc_id", 5, 0)))
    scored = quality.ranked(docs, model)
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "rank_score", F.col("above").alias("above_quantile"))


def op9_chunk_dedup(spark, sf_dir):
    cut = chunk_dedup.dedup(table(spark, sf_dir, "documents"))
    return cut.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op10_byte_bpe(spark, sf_dir):
    return byte_bpe.encode_decode(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, arrays=False
    )


def op11_fill_in_middle(spark, sf_dir):
    return fim.query_digest(fim.transform(table(spark, sf_dir, "documents")))


def op12_token_alignment(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_token_files(spark, sf_dir):
    return token_files.read(token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")), arrays=False)


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_media_columns": op2_media_columns,
    "op3_ngram_join": op3_ngram_join,
    "op4_mixing": op4_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_permutation_index": op6_permutation_index,
    "op7_language_mixture": op7_language_mixture,
    "op8_quality_ranking": op8_quality_ranking,
    "op9_chunk_dedup": op9_chunk_dedup,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_token_alignment": op12_token_alignment,
    "op13_token_files": op13_token_files,
}
ORACLE_SQL = {"op4_mixing": mixing.decide_sql()}
