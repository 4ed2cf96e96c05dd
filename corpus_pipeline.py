"""The corpus pipeline: toxicity filter, near-duplicate removal, secret redaction, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and reread as the next one's docs. All but the last
keep the columns of documents.

Edge cases follow the operators: null and empty texts are kept (not toxic, no shingles,
nothing to redact, packed as the end id alone); of repeated rows one stays; documents with
null ids stay unless they are copies; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sylvan.llm import ngram_join, packing, secret_scan, toxicity
from sylvan.llm.common import Staged, doc_text, prepare


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the cut; the model is learned from labels of these documents."""
    prepare(spark)
    model = toxicity.learn(doc_text(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays: that of the smallest id; texts without words all stay."""
    return ngram_join.keep_one(docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; found secrets are replaced in its text and n_chars counts the new text."""
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences along the curve."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [("toxicity", toxicity_filter), ("near duplicates", near_duplicate_removal), ("secrets", secret_redaction), ("packing", pack_sequences)]

#: The learned stages have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = Staged(docs, name.replace(" ", "-")).df
    return docs
