"""Corpus pipeline: quality rules, near duplicates, repeated substrings, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table that is written and read
again as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinframe.llm import near, packing, private, quality, suffixes
from basinframe.llm.common import table
from basinframe.session import materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the fixed rules or are mostly boilerplate lines."""
    labels = table(spark, sf_dir, "labels")
    return quality.keep_good(docs, quality.train_line_model(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group linked by 5-word shingles at 0.8, that of the least id."""
    return near.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated 200-byte substrings; what is left of a cut character goes too."""
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*rest).alias("_row"), "text")
    cut = suffixes.remove_repeats(rows, id_col="_row", as_text=True).select("_row.*", F.col("kept").alias("text"))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Generalise personal data and the terms that reveal it."""
    masked = private.sanitise(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into training sequences, with their ids."""
    path = public_tokenizers.path
    return packing.pack(docs, path("byte_bpe_50k.json"), with_ids=True, ranks=path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("private", mask_private),
    ("packing", pack_sequences),
]

#: Trained labels, signatures, suffix arrays and tokenizers are not SQL; tests compare
#: the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
