"""A corpus pipeline: toxicity, exact and near duplicates, benchmark contamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.  A stage
judges every row that its predecessor kept, by itself: rows with a null ``doc_id`` or one that others have too are
documents like all others.  Null ids come before all others, and rows that share an id are ordered by a hash of their texts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common, decontaminate, exact_dedup, near_dedup, packing, toxicity


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a key ``_row`` in the order of doc_id, unique and not null: doc_id itself if it is so, else a number."""
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        return docs.withColumn("_row", F.col("doc_id"))
    order = (F.col("doc_id"), F.xxhash64("text"))  # so that an id of many rows is dealt to many tasks
    rows = docs.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return common.cut(rows.withColumn("_row", F.monotonically_increasing_id()))


def _without(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The numbered rows that ``verdicts`` (_row, kept) keeps, without their numbers."""
    dropped = common.cut(verdicts.where("NOT kept").select("_row"))
    return rows.join(common.maybe_broadcast(dropped), "_row", "left_anti").drop("_row")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go.  The model learns from the labelled rows that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return docs.where(toxicity.scorer(spark, model)(F.col("text")) < 0.5)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    rows = _numbered(docs)
    return _without(rows, exact_dedup.exact_dedup(rows, key="_row"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    rows = _numbered(docs)
    return _without(rows, near_dedup.near_dedup(rows, key="_row"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    rows = _numbered(docs)
    found = decontaminate.find_contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="_row")
    return _without(rows, found.select("_row", (F.size("runs") == 0).alias("kept")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' pieces and their places in the sequences."""
    paths = map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
    return packing.best_fit_packing(docs, *paths, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL has neither the tokenizer nor the learned lexicon; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each one's result written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
