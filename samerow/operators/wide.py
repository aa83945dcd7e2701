"""Duplicates by keys too wide to be moved: whole texts, documents, long records.

Rows are grouped by a digest of the key, and only digests and places are shuffled. A digest is no proof, so the
keys of all rows whose digest repeats are compared as they are, combined in the scan tasks: one row per task
and different key. Rows with a digest of their own never leave their task with the key.

Should two keys have one digest, the rows of that digest are told apart by digest and key together, and everything
is done again with these.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from samerow.functions import key_id
from samerow.operators.bitmaps import is_broadcast, key_filter, may_be_in, without, words
from samerow.operators.entries import key_files, key_summary, report_entries, surplus_rows
from samerow.operators.skew import ROWS_PER_SALT, join_on_key
from samerow.session import save

Digest = Callable[[Column], Column]


@dataclass(frozen=True)
class WideKeys:
    """``rows`` with the ids of their keys as ``key``, the stored ``key_files`` of these rows, and the key of each
    id that repeats: ``key, wide_key``, stored."""

    rows: DataFrame
    found: DataFrame
    texts: DataFrame


def wide_key_files(rows: DataFrame, min_rows: int = 2, digest: Digest = key_id) -> WideKeys:
    """``key_files`` for wide keys. ``digest`` makes a binary digest, always of one length, of a key."""
    ids = rows.withColumnRenamed("key", "wide_key").withColumn("key", digest(F.col("wide_key").cast("string")))
    while True:
        found = save(key_files(ids.drop("wide_key"), min_rows))
        texts = _texts(ids, found)
        shared = texts.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("key")
        if shared.isEmpty():
            return WideKeys(ids.drop("wide_key"), found, texts)
        # A longer id than any digest; nothing but the key itself can stand behind it.
        marked = ids.join(shared.withColumn("shared", F.lit(True)), "key", "left")
        both = F.concat("key", F.lit(b"\0"), F.col("wide_key").cast("string").cast("binary"))
        ids = marked.withColumn("key", F.when(F.col("shared"), both).otherwise(F.col("key"))).drop("shared")


def _texts(ids: DataFrame, found: DataFrame) -> DataFrame:
    """Store ``key, wide_key``: all different keys behind each id of ``found``."""
    first = found.filter(F.col("path") == F.col("keep_path")).select("key")
    rows = ids.select("key", "wide_key")
    # Either way rows with a digest of their own are left out where they are read.
    some = rows.join(first, "key", "left_semi") if is_broadcast(found) else may_be_in(rows, key_filter(first, ["key"]), ["key"])
    # Always true, but it keeps the counting and with it the order: combined in the scan tasks, then joined.
    keys = some.groupBy("key", "wide_key").agg(F.count("*").alias("n")).filter(F.col("n") > 0)
    return save(keys.join(first, "key", "left_semi").select("key", "wide_key"))


def wide_entries(rows: DataFrame, digest: Digest = key_id, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """``report_entries`` of rows with wide keys; ``key`` is the key itself."""
    wide = wide_key_files(rows, digest=digest)
    summary = save(key_summary(wide.found, wide.rows))
    entries = report_entries(wide.found, summary, rows_per_salt)
    known = wide.texts.join(summary.select("key", "n_files"), "key")
    joined = join_on_key(entries, known, "inner", weight="n_files", rows_per_salt=rows_per_salt)
    return joined.select(*[F.col("wide_key").alias("key") if c == "key" else F.col(c) for c in entries.columns])


def dedupe_wide(rows: DataFrame, digest: Digest = key_id, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """``dedupe_all`` of rows with wide keys: the first row of each key, in the file with the smallest name.

    Rows are written or used where they are read: what goes to the tasks is a bitmap of the rows to leave out.
    ``rows`` must come in one order from scan to scan, as stored tables and files do.
    """
    placed = rows.withColumn("at", F.monotonically_increasing_id())
    wide = wide_key_files(placed, digest=digest)
    surplus = surplus_rows(wide.rows, wide.found, "all", rows_per_salt, places=["at"])
    return without(placed, words(surplus, "at"), "at").drop("at")
