"""Line and deletion statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def line_counts(blocks: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``path, file, n_lines``: lines per file without the header, blank ones included.

    ``blocks`` is an ``index_blocks`` result; ``files`` (``list_inputs``) adds the files without any line.
    """
    counts = blocks.groupBy("path", "file").agg(F.sum("n").alias("n"))
    if files is not None:
        counts = files.select("path", "file").join(counts.select("path", "n"), "path", "left")
    return counts.select("path", "file", F.greatest(F.coalesce("n", F.lit(0)) - 1, F.lit(0)).alias("n_lines"))


def input_totals(files: DataFrame) -> DataFrame:
    """Number and bytes of the input files, and the largest one; ``files`` is a ``list_inputs`` result."""
    order = F.struct(-F.col("size"), F.col("file"), F.col("path"))
    return files.agg(
        F.count("*").alias("n_files"),
        F.coalesce(F.sum("size"), F.lit(0).cast("long")).alias("total_size"),
        F.min_by("file", order).alias("largest_file"),
        F.max("size").alias("largest_size"),
    )


def deletion_stats(entries: DataFrame) -> DataFrame:
    """``path, file, n_keys, n_cross_deleted, n_within_deleted`` of every file with duplicate keys.

    A key loses all its rows in the files it does not stay in, and all but one in the file it stays in. So the
    numbers follow from the report entries, without another look at the rows.
    """
    n = F.col("n")
    return entries.groupBy("path", "file").agg(
        F.count("*").alias("n_keys"),
        F.sum(F.when(F.col("is_first"), 0).otherwise(n)).alias("n_cross_deleted"),
        F.sum(F.when(F.col("is_first"), n - 1).otherwise(0)).alias("n_within_deleted"),
    )


def deletion_totals(stats: DataFrame) -> DataFrame:
    """Deleted rows in all, and the files that lost any, by cause."""
    cross, within, none = F.col("n_cross_deleted"), F.col("n_within_deleted"), F.lit(0).cast("long")
    return stats.agg(
        F.coalesce(F.sum(cross), none).alias("n_cross_deleted"),
        F.count_if(cross > 0).alias("n_cross_files"),
        F.coalesce(F.sum(within), none).alias("n_within_deleted"),
        F.count_if(within > 0).alias("n_within_files"),
        F.coalesce(F.sum(cross + within), none).alias("n_deleted"),
    )


def run_summary(counts: DataFrame, stats: DataFrame) -> DataFrame:
    """Lines before, deleted lines and lines after, from ``line_counts`` and ``deletion_stats``."""
    none = F.lit(0).cast("long")
    before = counts.select(F.col("n_lines").alias("n_before"), none.alias("n_deleted"))
    deleted = stats.select(
        none.alias("n_before"), (F.col("n_cross_deleted") + F.col("n_within_deleted")).alias("n_deleted")
    )
    return (
        before.unionByName(deleted)
        .agg(
            F.coalesce(F.sum("n_before"), none).alias("n_before"),
            F.coalesce(F.sum("n_deleted"), none).alias("n_deleted"),
        )
        .withColumn("n_after", F.col("n_before") - F.col("n_deleted"))
    )
