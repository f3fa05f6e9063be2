"""The corpus pipeline: five stages over ``documents``, each written as Parquet and
read again as the next one's input.

Every stage but the last returns the columns it was given; a stage that changes
``text`` also renews ``n_chars`` where that column exists. The last one returns
``doc_id``, the piece ids of the text, their number and whether they decode to
the text. Null texts, repeated rows and clashing column names are handled as the
operators' modules say; an empty table gives empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlog.llm import decontaminate, langid, linededup, sentencepiece_fst, simhash
from packetlog.session import delete_path, scratch_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the given documents teach; the rest goes."""
    return langid.keep_known(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are like an earlier line."""
    rows = linededup.dedup_lines(docs)
    for field in docs.schema.fields:
        if field.name == "n_chars":
            rows = rows.withColumn("n_chars", F.length("text").cast(field.dataType))
    return rows.select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest id."""
    return simhash.drop_near_duplicates(docs, simhash.SHINGLE, simhash.MAX_BITS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text."""
    import public_tokenizers

    return sentencepiece_fst.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = scratch_path(spark, "pipeline", uuid.uuid4().hex)
    for k, (_, stage) in enumerate(STAGES):
        path = f"{root}/stage{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:  # nobody reads the stage before any more
            delete_path(spark, f"{root}/stage{k - 1}")
    return docs


#: No SQL: language profiles, SimHash and BPE can't be expressed in it.
ORACLE_SQL = None
