"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.  In each
of them null ids, null and empty texts, repeated rows, long texts and empty tables have the
result that the operator's docstring states; columns beyond those of documents go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, line_dedup, near_dedup, packing, quality
from tidemark.llm.common import materialise, small, small_batches
from tidemark.llm.queries import table, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier, fitted on the labelled ones, scores 0.3 or more."""
    model = quality.train(quality.training_rows(docs, table(spark, sf_dir, "labels"), "quality", F.lit(False)))
    return quality.score(docs, model).filter("score >= 0.3").select(COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops recurring line templates; a document goes only if nothing else was in it."""
    small_batches(spark)
    found = line_dedup.drop_recurring_lines(docs)
    changed = F.col("n_dropped") > 0
    return found.filter(~changed | (F.trim("text") != "")).withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group (five-word shingles, similarity 0.8).

    Rows with null ids or without words stay; repeated rows of a kept id stay as they are.
    The ids to drop are broadcast if there are few; beyond, the texts are shuffled once.
    """
    small_batches(spark)
    gone = materialise(near_dedup.near_duplicates(docs).filter("not kept").select("doc_id").distinct())
    return docs.join(small(gone, gone.count(), near_dedup.BROADCAST_ROWS), "doc_id", "left_anti").select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold ten consecutive words of a benchmark item."""
    return decontam.find_contamination(docs, table(spark, sf_dir, "benchmark")).filter(F.size("hits") == 0).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of at most 4096."""
    small_batches(spark)
    return packing.pack_documents(docs, tokenizer_path(), 4096)


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The stages need trained models, clustering and a tokenizer, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
