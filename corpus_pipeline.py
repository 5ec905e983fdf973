"""A corpus pipeline of five operators: documents in, packed training sequences out.

Every stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.llm.ngram_join import join_components
from paperweave.llm.packing import pack_documents
from paperweave.llm.repeats import remove_repeats
from paperweave.llm.scratch import cut, drop, small
from paperweave.llm.secrets import redact
from paperweave.llm.toxicity import score_documents

#: Rows of a batch between Spark and Python, where the session has Spark's own default: texts are long, and an executor holds a batch several times over. The pipeline owns the session it runs in; the
#: operators leave the setting alone.
ROWS_OF_A_BATCH = 2000
#: Words of a passage that, if repeated, is removed from all documents but the first.
PASSAGE_WORDS = 40


def _modest(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(ROWS_OF_A_BATCH))


def _aside(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """docs with all columns but doc_id and text under names that no operator uses, and the columns that bring the old names back."""
    names = [c if c in ("doc_id", "text") else f"own_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. The model learns from labels of documents that are still there. Null and empty texts, null doc_ids and repeated rows are scored like
    others, very long texts whole; columns named like the scores stay as they are; an empty table gives no rows."""
    _modest(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    own, back = _aside(docs)
    return score_documents(own, labels).filter(F.col("predicted") == 0).select(*back)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of 0.8 on five-word shingles, the one with the least
    doc_id stays. Documents without a doc_id stay; rows that share one stay or go together, and so do null, empty and blank texts, which resemble nothing. Very long texts are compared by all their shingles. An empty table gives no rows."""
    _modest(spark)
    found = join_components(docs, n=5, percent=80)
    gone = cut(found.filter("component_id <> doc_id").select("doc_id").distinct())
    drop(found)
    return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE_WORDS and more words stay only in the document with the least doc_id. A document of which
    nothing is left goes; null, empty and blank texts stay. Rows with a null doc_id neither lose nor cause anything, rows that share a doc_id are one document;
    columns named like the operator's stay as they are; very long texts are cut out whole, in a bucket of their own if need be; an empty table gives no rows."""
    _modest(spark)
    own, back = _aside(docs)
    kept = remove_repeats(own, words=PASSAGE_WORDS).filter("n_words = 0 or n_removed < n_words")
    kept = kept.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))
    out = kept.select(*back, F.col("n_removed").alias("_removed"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, with null and empty texts as they are and other columns untouched but n_chars. Repeated rows are cleaned alike, very long texts are scanned whole; an empty table gives no rows."""
    _modest(spark)
    return redact(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, with their sequence and offset. Null and empty texts are a piece of the end id; repeated rows are packed one by one; very
    long texts are cut; other columns than doc_id and text, whatever their names, are left out; an empty table gives no rows."""
    _modest(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("repeats", repeats), ("secrets", secrets), ("packing", packing)]

#: No SQL expresses the stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
