"""A training-data pipeline over `documents`: each stage works on all that the stage before kept, written as Parquet.

language_id predicts each document's language, which becomes its `lang` where it has none, and drops documents in which none
can be told (null texts and texts without a letter); where no document at all has a `lang` there is nothing to learn from, so
those with a letter stay as they are. near_duplicates keeps
of each group of documents that five-word shingles link at 0.8 or more the one with the smallest id; decontamination drops
documents that hold a ten-word window of a benchmark item; pii puts surrogates for personal data and secrets, and n_chars is
the new text's length; packing returns the pieces of all documents in sequences of 2,048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jsonloom.llm import decontaminate, jaccard, language, packing, pii
from jsonloom.llm.common import deleted, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fitted(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language.identified(docs, model, pred="__lang", score="__score").where("__lang <> 'und'")
    return found.withColumn("lang", F.coalesce("lang", "__lang")).drop("__lang", "__score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = written(jaccard.copies(docs), "copies")
    gone = F.broadcast(gone) if gone.count() <= jaccard.BROADCAST_IDS else gone
    return docs.join(gone, "doc_id", "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.anonymised(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", personal_data), ("packing", best_fit)]
#: SQL has no classifier, surrogates or tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
            if before is not None:
                deleted(before)
            before = docs
    return docs
