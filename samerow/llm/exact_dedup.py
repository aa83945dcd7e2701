"""Exact deduplication as a tree of merges of digest runs. DataFrame operations only.

Every input partition makes a run: one row per distinct text in it, with the smallest (or largest) identifier
and the number of rows. Runs are then merged in rounds. A run's number is written in base ``fan_in``; in round r
the runs whose numbers differ only in digit r meet, and each entry moves to the run whose digit r is that of
its digest. After the last round a run's number is a prefix of its digests, so equal texts have met, and no
run ever held more than its share: a text that a third of the rows repeat enters each round as one row per run.

The minimum of a struct makes Spark sort and merge on both sides of each exchange, so runs stay sorted.

Texts are taken as equal when SHA-256, length in bytes and a second, independent hash all agree, and this triple
is compared at every level. Only digests are shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from samerow.operators.bitmaps import without, words
from samerow.session import pin_splits, save, shuffle_partitions

FAN_IN = 16
DIGEST = ["sha", "n_bytes", "check"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store ``row, id, sha, n_bytes, check`` of every row; ``row`` is its position in ``docs``."""
    pin_splits(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return save(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("id"),
            F.unhex(F.sha2(text, 256)).alias("sha"),
            F.octet_length(text).alias("n_bytes"),
            F.xxhash64(text).alias("check"),
        )
    )


def merge_runs(runs: DataFrame, keep: str = "min", fan_in: int = FAN_IN) -> DataFrame:
    """``sha, n_bytes, check, keep, n_rows``: one row per distinct text from a ``digests`` table.

    ``keep`` is a struct ``(id, row)`` of the row that stays; null ids count as smallest.
    """
    best = F.min if keep == "min" else F.max
    rounds = max(1, math.ceil(math.log(max(2, shuffle_partitions(runs.sparkSession)), fan_in)))
    n_runs = fan_in**rounds
    address = F.pmod(F.col("check"), F.lit(n_runs))
    level = runs.select(
        # The partition of the original row names the run it starts in.
        F.pmod(F.shiftright("row", 33), F.lit(n_runs)).alias("run"),
        *DIGEST,
        F.struct("id", "row").alias("keep"),
        F.lit(1).cast("long").alias("n_rows"),
    )
    for r in range(rounds):
        low = fan_in**r
        here = F.floor(F.col("run") / low) % fan_in
        there = F.floor(address / low) % fan_in
        level = (
            level.withColumn("run", F.col("run") + (there - here) * low)
            .groupBy("run", *DIGEST)
            .agg(best("keep").alias("keep"), F.sum("n_rows").alias("n_rows"))
        )
    return level.select(*DIGEST, "keep", "n_rows")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fan_in: int = FAN_IN
) -> DataFrame:
    """One row per row of ``docs``: ``row, id, keep_id, group_size, kept, text_sha256``.

    ``keep`` chooses which of equal texts stays: the row with the smallest (``min``) or largest (``max``) id.
    A null text is the empty text. Rows that share id and text are one group like any other, and the first or
    last of them in input order stays. Null ids count as smaller than all others. An empty table gives an
    empty result. Other columns of ``docs`` are not looked at, whatever their names.
    """
    rows = digests(docs, id_col, text_col)
    groups = merge_runs(rows, keep, fan_in).filter(F.col("n_rows") > 1)
    # Left join on the digest: adaptive execution splits the partition of a hot group on the left side.
    found = rows.join(groups, DIGEST, "left")
    alone = F.col("n_rows").isNull()
    return found.select(
        "row",
        "id",
        F.when(alone, F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("n_rows", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep.row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the positions in ``dropped`` (``row``), as counted by ``digests`` on the same frame.

    ``docs`` must be a stored table, whose rows keep their positions from scan to scan. The positions go to the tasks
    that read the rows as a bitmap, so no row is moved. Columns of ``docs`` keep their names, whatever they are.
    """
    place = "row"
    while place in docs.columns:
        place += "_"
    placed = docs.select("*", F.monotonically_increasing_id().alias(place))
    return without(placed, words(dropped.select("row"), "row"), place).select(*docs.columns)
