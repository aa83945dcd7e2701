"""Occurrences per key, and what follows from the numbers alone.

Every aggregate here combines inside the scan tasks first, so a key that holds a third of all rows reaches
the shuffle as one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def count_by_file(rows: DataFrame) -> DataFrame:
    """``key, path, file, n``: occurrences of every key in every file."""
    return rows.groupBy("key", "path", "file").agg(F.count("*").alias("n"))


def count_keys(counts: DataFrame) -> DataFrame:
    """``key, n_files, n_rows`` from the counts per file."""
    return counts.groupBy("key").agg(F.count("*").alias("n_files"), F.sum("n").alias("n_rows"))


def duplicates(totals: DataFrame, min_rows: int = 2, scope: str | None = None) -> DataFrame:
    """Keys that occur at least ``min_rows`` times; ``scope`` restricts to ``cross`` or ``within``."""
    found = totals.filter(F.col("n_rows") >= min_rows)
    if scope is None:
        return found
    return classify(found).filter(F.col("scope") == scope).select(*totals.columns)


def classify(totals: DataFrame) -> DataFrame:
    """Add ``scope``: ``cross`` for a key in several files, else ``within``."""
    return totals.withColumn("scope", F.when(F.col("n_files") > 1, "cross").otherwise("within"))


def dup_summary(totals: DataFrame) -> DataFrame:
    """Number of duplicate keys, and how many of them are in several files."""
    return duplicates(totals).agg(
        F.count("*").alias("n_keys"), F.count_if(F.col("n_files") > 1).alias("n_cross_keys")
    )


def within_surplus(counts: DataFrame) -> DataFrame:
    """Per file, the rows beyond the first of each key inside that file."""
    return counts.groupBy("path", "file").agg(F.sum(F.col("n") - 1).alias("surplus"))
