"""The corpus pipeline: toxicity, quality, near duplicates, duplicate passages, packing.

Defined results: a null or empty text is scored as one without evidence and, if kept, stays to the end, where
it is packed as its end id alone; it links with nothing and loses nothing. A row without doc_id is never a
near copy and loses no passage. Rows that repeat a doc_id are one document to the near-copy stage, which keeps
or drops them together; every other stage treats each row by itself. Of texts that tie as near copies the
smallest doc_id stays. Very long texts are read whole in every stage. An empty table gives an empty result of
the same columns, and other columns of documents, whatever their names, are carried up to the packing stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heightline.llm import jaccard_join, packing, quality, substring_dedup, toxicity
from heightline.staging import clear, document_batches, mark, staged


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity operator rejects."""
    document_batches(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("predicted = 0").select(docs.columns)


def without_junk(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects."""
    document_batches(spark)
    net = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, net).where("predicted = 1").select(docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group that links connect."""
    document_batches(spark)
    return jaccard_join.one_of_each(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words and more that a document with a smaller id has, from the texts; n_chars follows."""
    document_batches(spark)
    cut = substring_dedup.without_duplicates(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all remaining documents into sequences; one row a piece."""
    document_batches(spark)
    return packing.pack(docs, public_tokenizers.path(packing.VOCABULARY)).select(*packing.COLUMNS)


STAGES = [
    ("toxicity", without_toxic),
    ("quality_classifier", without_junk),
    ("ngram_jaccard_join", without_near_copies),
    ("substring_dedup", without_repeated_passages),
    ("packing", packed),
]

#: Learned stages can't be expressed in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written in the shared folder and read again by the next.

    What a stage and its operators staged is deleted as soon as the stage is written, and so is the stage before it; only the
    last stage's input, and what its result still reads, stay for the caller.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark(spark)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        clear(spark, (docs,), before)
    return STAGES[-1][1](spark, docs, sf_dir)
