"""The corpus pipeline: language, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), docs being the last stage's result as written and
read again, and works on all its rows. All but the last return the columns of documents.

Results for odd rows: a null text, or one without a letter, has no language and goes in the
first stage; so does a text of no learned language, however long; empty and very long texts
with letters are judged whole. Documents without a label are scored for toxicity like others.
Rows that repeat are copies, of which the near-duplicate stage keeps one; rows that share an
id but not a text are judged each by its own text; a row with a null id is never dropped as
a copy, as it can't be named. Extra columns, whatever their names, pass through all but the
last stage. Every stage gives an empty table for an empty one. The tables of the stages
stay in the shared folder under `pipeline-<id>` until someone removes them.

The near-duplicate stage has Spark remove an action's shuffle files when the action is over, as
its many small steps would else fill the disk until a garbage collection of the driver.
The stages set the session's rows in an Arrow batch to `TEXTS_AT_ONCE`: rows are whole texts
here, and a batch of 10,000 of them is held several times over, by the JVM and by Python. A
stage's result is read after the stage returns, so the settings stay; `run` puts them back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pivotloom.llm import language_id, packing, simhash_dedup, toxicity
from pivotloom.llm.common import ARROW_ROWS, TEXTS_AT_ONCE, ensure_checkpoint_dir
from pivotloom.llm.queries import TOKENIZERS, table

#: Shuffle files of an action go when it is over.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _small_batches(spark: SparkSession) -> None:
    if not 0 < int(spark.conf.get(ARROW_ROWS)) <= TEXTS_AT_ONCE:
        spark.conf.set(ARROW_ROWS, TEXTS_AT_ONCE)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language isn't rejected; the model learns from the stage's own input."""
    _small_batches(spark)
    return language_id.keep_identified(docs, language_id.train(docs))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under one half."""
    _small_batches(spark)
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id (then fingerprint).

    Documents link as in op6, and where five-word shingles have a Jaccard of 0.8 or more.
    """
    _small_batches(spark)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    return simhash_dedup.keep_one(docs, classes_of=simhash_dedup.near_copies)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, placed in sequences."""
    _small_batches(spark)
    return packing.pack_documents(docs, TOKENIZERS("word_bpe_49k.json"))


STAGES = [
    ("language", language_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: Trained models and ids of a tokenizer can't be stated in SQL; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet in the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), {k: spark.conf.get(k, None) for k in (ARROW_ROWS, SHUFFLE_CLEANUP)}
    try:
        for name, stage in STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return docs
