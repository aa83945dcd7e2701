"""Line numbers and first-N-lines without sorting a whole file in one task, and without moving a line.

A file is a sequence of blocks, its splits in the scan. Lines are counted per block, the small table of block
counts is summed up along each file, and a line's number is its place in its block plus the lines before that
block. That table has one row per split, fewer than the scan itself keeps on the driver, and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from samerow.functions import is_blank, strip_py
from samerow.operators.ranks import ROW_BITS
from samerow.session import save

# Fixed value: the length assumed for a file without any line.
DEFAULT_LENGTH = 150.0


def index_blocks(lines: DataFrame) -> DataFrame:
    """``path, file, block, start, n``: first position and number of lines of every block.

    A stored table of one row per block. Headers, line counts and line numbers all come from it.
    """
    return save(
        lines.groupBy("path", "file", "block").agg(F.min("pos").alias("start"), F.count("*").alias("n"))
    )


def _offsets(blocks: DataFrame) -> DataFrame:
    """``path, block, start, before``: ``before`` is the number of lines in earlier blocks of the file."""
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("path", "block", "start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))


def _split(pos: str) -> list[Column]:
    """Two numbers that name a split: the scan task, and a hash that tells its splits apart."""
    return [F.shiftright(pos, ROW_BITS).alias("task"), F.xxhash64("path", "block").alias("split")]


def _at_their_block(lines: DataFrame, offsets: DataFrame) -> DataFrame:
    """``lines`` with ``start`` and ``before`` of their block; lines of other blocks are left out."""
    known = offsets.select(*_split("start"), "start", "before")
    return lines.select("*", *_split("pos")).join(F.broadcast(known), ["task", "split"]).drop("task", "split")


def line_numbers(lines: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Add ``line_no``, counted from 1 in each file. Positions inside a block must be consecutive."""
    offsets = save(_offsets(index_blocks(lines) if blocks is None else blocks))
    number = F.col("before") + F.col("pos") - F.col("start") + 1
    return _at_their_block(lines, offsets).select(*lines.columns, number.alias("line_no"))


def avg_line_length(lines: DataFrame, files: DataFrame, limit: int | None = None) -> DataFrame:
    """Per file of ``files``, the mean stripped length of its non-blank lines, or of the first ``limit`` of them.

    ``lines`` are without headers. The mean of all needs no order and is added up in the scan tasks.
    """
    texts = lines.filter(~is_blank(F.col("value"))).select(
        "path", "file", "block", "pos", F.length(strip_py(F.col("value"))).alias("length")
    )
    if limit is not None:
        # Only the blocks that begin inside the sample are looked at again.
        starts = save(_offsets(index_blocks(texts)).filter(F.col("before") < limit))
        place = F.row_number().over(Window.partitionBy("path", "block").orderBy("pos"))
        texts = _at_their_block(texts, starts).withColumn("place", F.col("before") + place).filter(F.col("place") <= limit)
    means = texts.groupBy("path").agg(F.avg("length").alias("avg_len"))
    return files.select("path", "file").join(means, "path", "left").select(
        "path", "file", F.coalesce("avg_len", F.lit(DEFAULT_LENGTH)).alias("avg_len")
    )
