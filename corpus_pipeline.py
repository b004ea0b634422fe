"""The corpus pipeline: documents -> packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and is written as Parquet and read
again.  Documents predicted toxic go, then those of low quality; of each group of near copies one stays (of the
least id); of every repeated passage one copy stays; what is left is packed.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import Scratch, table, unclashed
from tallyspark.llm.cotraining import without_low_quality
from tallyspark.llm.ngram_join import ngram_jaccard_components
from tallyspark.llm.packing import pack_documents
from tallyspark.llm.suffix_dedup import cut_repeats, repeated_passages
from tallyspark.llm.toxicity import without_toxic


READ = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of a batch that a stage hands to a task, so that the tasks of one executor together hold little text.
BATCH = 1 << 22


def _small_batches(spark: SparkSession) -> None:
    """From now on, as the caller runs what a stage returns."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def _filter(stage):
    """A stage over frames whose other columns may clash with those it reads, by case: it sees unambiguous names."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _small_batches(spark)
        have = {c.lower() for c in docs.columns}
        plain, names = unclashed(docs, *[c for c in READ if c in have])
        return stage(spark, plain, sf_dir).toDF(*names)

    return run


@_filter
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


@_filter
def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_low_quality(docs, table(spark, sf_dir, "labels"))


@_filter
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a null id, and rows without words, link with nothing and stay.

    Where ids repeat, rows are what links: each gets a key in the order of the ids, so of a group of near copies one
    row of the least id stays, and a row that links with nothing stays beside others of its id.
    """
    known, key = docs.where("doc_id is not null"), "doc_id"
    if not known.groupBy("doc_id").count().where("count > 1").isEmpty():
        key = next(c for c in ("_row", *(f"_row{i}" for i in range(len(docs.columns)))) if c not in docs.columns)
        # Saved, so that every later read sees the same keys.
        known = Scratch(spark, "near-copies").save(known.orderBy("doc_id", "text").withColumn(key, F.monotonically_increasing_id()), "rows")
    found = ngram_jaccard_components(known.select(key, "text"), key)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias(key))
    return known.join(kept, key, "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))


@_filter
def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cut_repeats(docs, repeated_passages(docs.select("doc_id", "text")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_copies", drop_near_copies),
    ("repeated_passages", cut_repeated_passages),
    ("packing", pack),
]

#: No stage but the third could be written in SQL; the whole is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
