"""The corpus pipeline: each stage takes the documents that its predecessor kept.

quality classifier, n-gram Jaccard join, benchmark decontamination, secret scan, SentencePiece encoding. Every stage but the
last returns the columns of documents. Stages are written to the shared folder and read again, so a lost executor repeats
tasks of one stage only.

Defined cases, for every stage: a null or empty text is judged like any other (the classifier scores it, it is no duplicate,
holds no benchmark item, no secret and no pieces); a null id is an id of its own; repeated rows are one duplicate group, of
which one row stays; ties between ids go to the least id; texts of any length are read whole; extra columns, whatever their
names, stay as they are up to the last stage; an empty table gives an empty table of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomlens.llm import decontaminate, jaccard, pieces, quality, secrets
from bomlens.llm.common import stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier does not reject."""
    return quality.without_rejected(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of every group linked by shingle overlap."""
    return jaccard.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking secrets masked character by character."""
    return secrets.without_live_secrets(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids) of every document."""
    encoded = pieces.encode(docs, pieces.PieceTable())
    return encoded.select(F.col("id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_pieces"), "ids")


STAGES = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("secret_scan", mask_secrets),
    ("sentencepiece", encode_pieces),
]

#: A trained classifier and the pieces of a model file are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
