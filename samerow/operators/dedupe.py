"""Choosing survivors and labelling the other rows.

File order is by name, then full path; inside a file by position. A key stays once, at its first row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from samerow.operators.bitmaps import is_broadcast, key_filter, may_be_in
from samerow.operators.skew import ROWS_PER_SALT, join_on_key, key_hash
from samerow.session import save

KEPT, CROSS_DELETED, WITHIN_DELETED = "kept", "cross_deleted", "within_deleted"


def _first_per(rows: DataFrame, partition: list[str | Column], order: list[str]) -> DataFrame:
    # Spark limits each group inside the scan tasks too, so a hot key is one row per task when it is shuffled.
    rank = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") == 1).drop("rank")


def dedupe_all(rows: DataFrame) -> DataFrame:
    """One row per key: the first in the file with the smallest name."""
    return _first_per(rows, [key_hash(), "key"], ["file", "path", "block", "pos"])


def dedupe_within(rows: DataFrame) -> DataFrame:
    """The first row of each key inside each file."""
    return _first_per(rows, [key_hash(), "key", "path"], ["block", "pos"])


def dedupe_cross_only(rows: DataFrame, summary: DataFrame, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Drop rows outside the file a key stays in, but keep repeats inside that file."""
    fates = row_fate(rows, summary, rows_per_salt)
    return fates.filter(F.col("fate") != CROSS_DELETED).drop("keep_file", "fate")


def keep_file(counts: DataFrame) -> DataFrame:
    """``key, keep_file, keep_path``: the file each key stays in, from a ``count_by_file`` result."""
    smallest = F.min(F.struct("file", "path")).alias("smallest")
    return (
        counts.filter(F.col("n") > 0)  # always so; else the optimizer drops the counting and sorts all rows instead
        .groupBy(key_hash(), "key")
        .agg(smallest)
        .select("key", F.col("smallest.file").alias("keep_file"), F.col("smallest.path").alias("keep_path"))
    )


def row_fate(rows: DataFrame, summary: DataFrame, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Add ``keep_file`` and ``fate`` (kept, cross_deleted or within_deleted) to every row.

    ``summary`` is the stored ``key_summary`` of the same rows. No window: a row is kept if it is the first
    row of its key, which the summary names, or if its key is no duplicate. Rows without a key are kept.
    """
    keep = summary.select("key", "n_rows", "keep_file", "keep_path", "keep_block", "keep_pos")
    is_first = (F.col("block") == F.col("keep_block")) & (F.col("pos") == F.col("keep_pos"))
    fate = (
        F.when(F.col("keep_path").isNull(), KEPT)
        .when(F.col("path") != F.col("keep_path"), CROSS_DELETED)
        .when(is_first, KEPT)
        .otherwise(WITHIN_DELETED)
    )
    joined = join_on_key(rows, keep, "left", rows_per_salt=rows_per_salt)
    return joined.select(
        *rows.columns, F.coalesce("keep_file", "file").alias("keep_file"), fate.alias("fate")
    )


def duplicate_rows(rows: DataFrame, keys: DataFrame, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """The rows whose key is in ``keys``, a stored frame with ``key`` and ``n_rows``.

    If ``keys`` is too large to be broadcast itself, a bitmap of its hashes is, and rows of other keys are left out
    before the shuffle.
    """
    some = rows if is_broadcast(keys) else may_be_in(rows, key_filter(keys, ["key"]), ["key"])
    return join_on_key(some, keys.select("key", "n_rows"), "left_semi", rows_per_salt=rows_per_salt)


def deletion_candidates(rows: DataFrame, totals: DataFrame, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """The rows of keys that are in several files; ``totals`` is a stored ``count_keys`` result."""
    return duplicate_rows(rows, totals.filter(F.col("n_files") > 1), rows_per_salt)


def rows_by_prefix(rows: DataFrame, prefixes: DataFrame, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """The rows whose displayed prefix is in ``prefixes``, a stored ``cross_prefixes`` result."""
    return join_on_key(rows, prefixes, "left_semi", on="prefix", rows_per_salt=rows_per_salt)


def remove_rows(rows: DataFrame, removal: DataFrame, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Drop every row whose stripped text is listed for its file in ``removal`` (``path, line``)."""
    listed = save(removal.groupBy("path", "line").agg(F.count("*").alias("n_rows")))
    return join_on_key(rows, listed, "left_anti", on=["path", "line"], rows_per_salt=rows_per_salt)
