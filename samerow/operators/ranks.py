"""Gapless numbers over all rows without one task ever seeing them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from samerow.session import save

# monotonically_increasing_id keeps the partition above this many bits and the row inside it below.
ROW_BITS = 33


def ranked(df: DataFrame, order: Sequence[str | Column], name: str = "rank", layout: bool = False) -> DataFrame:
    """Add ``name``: the place of each row, from 0, in the order of ``order`` over the whole frame.

    The rows are range-partitioned, sorted inside each partition and stored; a row's place is then its place
    in the partition plus the rows of earlier partitions, a table of one row per partition. Rows that are
    equal in ``order`` are spread over partitions by their input position, so a value that a third of the rows
    share is no single task's work. Nulls come first.

    With ``layout``, ``part`` and ``offset`` say which range a row lies in and which split of its file. Rows of a split
    are read by one task in their order, and the splits by these two are in the order of all rows.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*keys, F.col("_tie"))
        .sortWithinPartitions(*keys, F.col("_tie"))
        .drop("_tie")
        .withColumn("_at", F.monotonically_increasing_id())
    )
    stored = save(placed)
    if layout:
        where = F.col("_metadata")["file_block_start"]
        stored = stored.select("*", F.shiftright("_at", ROW_BITS).alias("part"), where.alias("offset"))
    block = F.shiftright("_at", ROW_BITS)
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stored.groupBy(block.alias("_block")).agg(F.count("*").alias("_n"))
    before = save(sizes.select("_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
    within = F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (
        stored.withColumn("_block", block)
        .join(F.broadcast(before), "_block")  # one row per partition of the stored table
        .withColumn(name, F.col("_before") + within)
        .drop("_at", "_block", "_before")
    )
