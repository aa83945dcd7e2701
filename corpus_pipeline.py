"""A pipeline from raw documents to packed training sequences, out of five of the ten operators."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from samerow.llm import exact_dedup, jaccard, packing, quality, secrets
from samerow.llm.queries import END_ID, tokenizer_file
from samerow.session import delete_folder, save_alone


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules do not find bad, of any length; those without a word go.

    A null text has no word. Repeated rows are judged alike. An empty table stays empty.
    """
    judged = quality.judge(docs)
    return exact_dedup.drop_rows(docs, judged.filter(~F.col("sound") | (F.col("n_words") == 0)))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest id; a null text is an empty one.

    Of rows that repeat, ids included, one stays. An empty table stays empty.
    """
    found = exact_dedup.exact_dedup(docs, keep="max")
    return exact_dedup.drop_rows(docs, found.filter(~F.col("kept")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with similar sets of five-word shingles, the one with the smallest id.

    Texts without words, null ones too, are like no other and stay. Null ids come first. An empty table stays empty.
    """
    found = jaccard.near_duplicates(docs, similarity=jaccard.Similarity(n=5, part=80))
    return exact_dedup.drop_rows(docs, jaccard.surplus_rows(found))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret. A null text stays null, and so does its length."""
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences of 1024 tokens.

    A null or empty text is one piece, its end. Rows that repeat are packed each. An empty table gives no piece.
    """
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), END_ID).drop("ids")


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]

# The stages use hashes, tokenizers and searches that SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each stored as Parquet before the next.

    Tables that a stage stored on its way, and its input, are deleted once its result is stored.
    """
    docs, before = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs, path = save_alone(spark, partial(stage, spark, docs, sf_dir))
        if before is not None:
            delete_folder(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
