"""A corpus pipeline over the documents table: every stage works on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A stage's rows
are read from tables that it left in the shared folder, so whoever calls one alone removes them when the rows are written, as run does.

Nulls and ties in the stages: documents without a text, or with an empty one, fail the quality rules; a null id is kept
and comes last where ids are ordered; of rows that repeat an id each is judged by its own text; long texts are taken
whole; columns beside those of documents pass through all stages but the last, whatever their names; an empty table
passes as such. Line dedup can leave an empty text, and one document of all empty ones stays.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm import decontam, line_dedup, near_copies, quality, sentencepiece_codec
from matchlake.llm._common import materialize, remove, shared_dir, written_below

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, their number and whether they decode to the text."""
    both = sentencepiece_codec.round_trip(docs, ["doc_id", "lang", "source"])
    return both.select("_row.*", "ids", F.size("ids").cast("long").alias("n_ids"), "round_trip")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", encoding),
]

#: SQL expresses neither the fingerprints' hash nor the encoding; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. What a stage left in the shared folder, and the rows it was given, go as soon as its own rows are written."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        with written_below(f"{folder}/work{i}"):
            made = stage(spark, docs, sf_dir)
        with written_below(f"{folder}/rows{i}"):
            docs = materialize(made, "stage")
        remove(spark, f"{folder}/work{i}")
        if i:
            remove(spark, f"{folder}/rows{i - 1}")
    return docs
