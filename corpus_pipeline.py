"""A training corpus from raw documents, stage by stage.

Each stage works on all documents that the one before it kept, written as
Parquet in the shared folder and read again.  Texts are read whole, however long; all
columns pass through under their names; an empty table stays one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackforge.llm.decontaminate import clean_documents
from trackforge.llm.langid import keep_identified
from trackforge.llm.minhash import keep_one_of_each
from trackforge.llm.packing import pack_documents
from trackforge.llm.secrets import redact_secrets
from trackforge.llm.shared import pin, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not recognised go, and with them null, empty and
    letterless texts; a null id or language changes nothing, and repeated rows stay or
    go together."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, 0.8): the one with
    the smallest id, once if its row is repeated.  Texts without words, and rows without
    an id, stay; different texts under one id are judged apart."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, each of repeated rows; null
    and empty texts stay."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blanked out of the texts; every row stays, null texts as null."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as token pieces in sequences of 2048.  Null and empty texts are a piece
    of one token, repeated rows are packed one by one, and of pieces of equal length
    those with smaller ids come first within their counter."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: tokenising, training and banding have no SQL form; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
