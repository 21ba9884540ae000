"""The corpus pipeline: five stages over `documents`, each written and read again as the next one's input.

Every stage but the last returns the columns of documents. What it decides takes effect: rejected texts, near copies and
contaminated texts go, secrets are masked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.lineage import cut
from keyweave.llm.decontamination import find_benchmark
from keyweave.llm.ngram_join import one_of_each_group
from keyweave.llm.piece_encoding import encode_and_decode
from keyweave.llm.quality_rules import apply_quality_rules
from keyweave.llm.queries import tokenizer_file
from keyweave.llm.secrets import mask_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts that the quality rules keep."""
    return apply_quality_rules(docs).where("kept").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near copies."""
    return one_of_each_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts without a passage of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_benchmark(docs, benchmark).where("NOT contaminated").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets masked, and their new lengths."""
    return mask_secrets(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the pieces of each text, how many there are, and whether they decode to the text."""
    encoded = encode_and_decode(docs.select("doc_id", "lang", "source", "text"), tokenizer_file())
    return encoded.select("doc_id", "lang", "source", "ids", (F.size("ids").cast("long")).alias("n_tokens"), (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontaminate),
    ("secret scans", secrets),
    ("SentencePiece encoding and decoding", pieces),
]

#: SQL can't express the encoding; the tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
