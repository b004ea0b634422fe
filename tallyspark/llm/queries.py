"""The registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import table
from tallyspark.llm.oracle import ORACLE  # noqa: F401 - read beside QUERIES


def op1_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyspark.llm.cotraining import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyspark.llm.chat import prefix_tree, read_back

    planted = spark.createDataFrame([(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")],
                                    "conv_id long, turn long, role string, text string")
    return read_back(*prefix_tree(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)))


def op3_nb_ngram_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyspark.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyspark.llm.suffix_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyspark.llm.topk import exact_topk

    return exact_topk(table(spark, sf_dir, "embeddings"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyspark.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyspark.llm.ngram_join import ngram_jaccard_components

    return ngram_jaccard_components(table(spark, sf_dir, "documents"))


def op8_block_matrix_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyspark.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyspark.llm.bpe import decode, encode

    # A record here is a whole text as words: fewer of them in a batch, so that a task holds less.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    coded = decode(encode(table(spark, sf_dir, "documents")))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyspark.llm.warc import warc_round_trip

    return warc_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyspark.llm.divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyspark.llm.pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyspark.llm.conversation_trie import ordered_turns, prefix_trie, rebuilt

    return prefix_trie(rebuilt(ordered_turns(table(spark, sf_dir, "conversations"))))


QUERIES = {f.__name__: f for f in (op1_cotrained_quality, op2_chat_prefix_tree, op3_nb_ngram_toxicity, op4_suffix_array_dedup, op5_exact_topk,
                                   op6_best_fit_packing, op7_ngram_jaccard_join, op8_block_matrix_ann, op9_byte_bpe, op10_warc_round_trip,
                                   op11_source_divergence, op12_personal_data, op13_conversation_trie)}
