"""Duplicate keys with their files, in three steps from the rows to the report entries.

The report stays in long form, one row per key and file, until it is written. A key that occurs in most files
is then many rows that any number of tasks can sort and print, never one huge list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from samerow.operators.ranks import ranked
from samerow.operators.skew import ROWS_PER_SALT, join_on_key, key_hash
from samerow.session import save


def key_files(rows: DataFrame, min_rows: int = 2) -> DataFrame:
    """``key, path, file, n, block, pos, n_rows, n_files, keep_*`` of every duplicate key and file.

    ``n`` rows of the key are in the file, the first at ``block, pos``; ``n_rows`` and ``n_files`` are of the whole key,
    and ``keep_file, keep_path, keep_block, keep_pos`` place its first row. One pass over the rows: numbers are
    added up by hash in the scan tasks, so a hot key is one row per task and file when it is shuffled, and no
    row is sorted. ``pos`` must grow along a file, over its blocks too.

    Totals are added up from the counts by file, first in the tasks that made these; so a key in very many files is
    one row per task again. In the join of the totals with the counts adaptive execution splits it.
    """
    counts = rows.groupBy(key_hash(), "key", "path", "file").agg(
        F.count("*").alias("n"), F.min("block").alias("block"), F.min("pos").alias("pos")
    )
    first = F.min(F.struct("file", "path", "block", "pos"))
    totals = counts.groupBy("key_hash", "key").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_files"), first.alias("first"))
    # By another hash than the totals are grouped by: both sides come out of a shuffle of their own then, and only
    # of such ones does adaptive execution split a hot partition.
    dups = totals.drop("key_hash").filter(F.col("n_rows") >= min_rows)
    placed = counts.withColumn("spread", F.hash("key")).join(dups.withColumn("spread", F.hash("key")), ["spread", "key"])
    return placed.select(
        "key",
        "path",
        "file",
        "n",
        "block",
        "pos",
        "n_rows",
        "n_files",
        *[F.col(f"first.{c}").alias(f"keep_{c}") for c in ("file", "path", "block", "pos")],
    )


def key_summary(found: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per duplicate key: ``n_rows, n_files``, its first row in file order, and that row's prefix.

    ``found`` is the stored ``key_files`` result of the same rows. The first row is the one deduplication keeps.
    Prefixes are looked up for first rows only.
    """
    first = found.filter(F.col("path") == F.col("keep_path"))
    return rows.select("path", "block", "pos", "prefix").join(
        first.drop("file", "n"), ["path", "block", "pos"]
    ).select("key", "n_rows", "n_files", "keep_file", "keep_path", "keep_block", "keep_pos", "prefix")


def report_entries(found: DataFrame, summary: DataFrame, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """``prefix, key, scope, n_rows, path, file, n, is_first`` of every duplicate key and file.

    ``found`` is a ``key_files`` result and ``summary`` the stored ``key_summary`` of it. A key is ``within``
    if one file holds all its rows. ``is_first`` marks one file per key, the one with its first row.
    """
    keys = summary.select("key", "n_files", "prefix")
    entries = found.select("key", "path", "file", "n", "pos", "n_rows", "keep_path")
    joined = join_on_key(entries, keys, "inner", weight="n_files", rows_per_salt=rows_per_salt)
    return joined.select(
        "prefix",
        "key",
        F.when(F.col("n") < F.col("n_rows"), "cross").otherwise("within").alias("scope"),
        "n_rows",
        "path",
        "file",
        "n",
        (F.col("path") == F.col("keep_path")).alias("is_first"),
    )


def surplus_rows(
    rows: DataFrame,
    found: DataFrame,
    mode: str = "all",
    rows_per_salt: int = ROWS_PER_SALT,
    places: Sequence[str] = ("path", "block", "pos"),
) -> DataFrame:
    """``path, block, pos``, or other ``places``, of the rows a deletion drops.

    ``found`` is the stored ``key_files`` result of ``rows``. ``all`` keeps the first row of a key, ``cross`` all rows in
    the file of the first, ``within`` the first row in each file.
    """
    first_in_file = F.col("pos") == F.col("first_pos")
    in_keep_file = F.col("path") == F.col("keep_path")
    kept = {"all": in_keep_file & first_in_file, "cross": in_keep_file, "within": first_in_file}[mode]
    keys = found.select("key", "path", "n", F.col("pos").alias("first_pos"), "keep_path")
    located = rows.select(*dict.fromkeys(["key", "path", "block", "pos", *places]))
    joined = join_on_key(located, keys, "inner", on=["key", "path"], weight="n", rows_per_salt=rows_per_salt)
    return joined.filter(~kept).select(*places)


def cross_prefixes(entries: DataFrame) -> DataFrame:
    """``prefix, n_rows``: displayed prefixes of keys in several files, with the rows of these keys."""
    cross = entries.filter((F.col("scope") == "cross") & F.col("is_first"))
    return cross.groupBy("prefix").agg(F.sum("n_rows").alias("n_rows"))


def distinct_prefixes(entries: DataFrame) -> DataFrame:
    """``prefix, path, file``: the files of all keys that share a displayed prefix, merged."""
    return entries.select("prefix", "path", "file").distinct()


def file_lists(counts: DataFrame, totals: DataFrame, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """``key, place, path, file, n``: the files of every duplicate key, numbered from 1 in the order of their names.

    ``totals`` holds the duplicate keys with ``n_files``. The list is in long form, one row per key and file, so a
    key in very many files is many rows and never one.
    """
    found = join_on_key(counts, totals.select("key", "n_files"), "inner", weight="n_files", rows_per_salt=rows_per_salt)
    placed = save(ranked(found.select("key", "path", "file", "n", "n_files"), [key_hash(), "key", "file", "path"]))
    # A key's files have consecutive places in the order of all.
    first = placed.groupBy("key").agg(F.min("rank").alias("first"), F.first("n_files").alias("n_files"))
    numbered = join_on_key(placed.drop("n_files"), first, "inner", weight="n_files", rows_per_salt=rows_per_salt)
    place = (F.col("rank") - F.col("first") + 1).alias("place")
    return numbered.select("key", place, "path", "file", "n")
