"""Sets of numbers as bitmaps that are sent to every task, so that rows are tested where they are read.

A bitmap is a table of words: 64 neighbouring numbers are one row, their common part and a bit for each. Joining it
takes one lookup of a whole number per row, and dense sets need less than a byte per number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from samerow.operators.ranks import ROW_BITS
from samerow.session import input_size, save

# Rows of a bitmap that are broadcast at once: with the hash table around them less than 300 MB.
BROADCAST_WORDS = 4_000_000
WORD_BITS = 6
# Buckets per key of a filter by hashes; of the keys it does not hold it lets one in so many through.
BUCKETS_PER_KEY = 8


def words(numbers: DataFrame, number: str = "pos") -> DataFrame:
    """Store the bitmap of the column ``number``: ``word, bits``. Numbers may repeat; null ones are left out."""
    bit = F.expr(f"shiftleft(1L, cast({number} & 63 as int))")
    some = numbers.filter(F.col(number).isNotNull())
    return save(some.groupBy(F.shiftright(number, WORD_BITS).alias("word")).agg(F.bit_or(bit).alias("bits")))


def _marked(rows: DataFrame, bitmap: DataFrame, number: Column, how: str, sent: bool) -> tuple[DataFrame, Column]:
    """``rows`` with their word of the bitmap, and whether their bit is set in it: null without a word."""
    word, bits, own = (name + "_" * (1 + max(map(len, rows.columns))) for name in ("word", "bits", "number"))  # no column's name
    known = bitmap.select(F.col("word").alias(word), F.col("bits").alias(bits))
    numbered = rows.withColumn(own, number)
    joined = numbered.join(F.broadcast(known) if sent else known, F.shiftright(own, WORD_BITS) == F.col(word), how)
    return joined, F.expr(f"shiftright({bits}, cast({own} & 63 as int)) & 1 = 1")


def without(rows: DataFrame, bitmap: DataFrame, number: str = "pos", fits: bool = False) -> DataFrame:
    """``rows`` whose ``number`` is not in the stored ``bitmap``.

    Up to ``BROADCAST_WORDS`` rows of it are broadcast and no row is moved; a larger one is joined as the planner
    likes. A part cut off by ``in_rounds`` always ``fits``.
    """
    sent = fits or bitmap.count() <= BROADCAST_WORDS
    joined, held = _marked(rows, bitmap, F.col(number), "left", sent)
    return joined.filter(~F.coalesce(held, F.lit(False))).select(*rows.columns)


def only(rows: DataFrame, bitmap: DataFrame, number: str = "pos") -> DataFrame:
    """``rows`` whose ``number`` is in the stored ``bitmap``, which is broadcast or joined as in ``without``."""
    joined, held = _marked(rows, bitmap, F.col(number), "inner", bitmap.count() <= BROADCAST_WORDS)
    return joined.filter(held).select(*rows.columns)


def in_rounds(bitmap: DataFrame, first: int, end: int) -> list[tuple[int, int]]:
    """The scan tasks from ``first`` to ``end`` in ranges with at most ``BROADCAST_WORDS`` rows of the bitmap each.

    A single task is never cut: it reads one split, whose bitmap is small. The driver sees one number per task.
    """
    inside = part(bitmap, first, end)
    sizes = inside.groupBy(_task("word", WORD_BITS).alias("task")).agg(F.count("*").alias("n")).orderBy("task").collect()
    starts, held = [first], 0
    for row in sizes:
        if held and held + row["n"] > BROADCAST_WORDS:
            starts.append(row["task"])
            held = 0
        held += row["n"]
    return list(zip(starts, [*starts[1:], end]))


def part(bitmap: DataFrame, first: int, end: int) -> DataFrame:
    """The rows of a bitmap of scan positions that belong to the tasks of a range."""
    return bitmap.filter(_task("word", WORD_BITS).between(first, end - 1))


def in_tasks(first: int, end: int, number: str = "pos") -> Column:
    """Does the scan position belong to the tasks of a range?"""
    return _task(number, 0).between(first, end - 1)


def _task(number: str, bits: int) -> Column:
    return F.shiftright(number, ROW_BITS - bits)


def is_broadcast(table: DataFrame) -> bool:
    """Is a stored table, all of it, so small that the planner broadcasts it in a join by itself?"""
    limit = table.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return input_size(table) <= limit


def key_filter(keys: DataFrame, on: list[str]) -> tuple[DataFrame, int] | None:
    """A bitmap of the hashes of ``keys``, a stored table, and its number of buckets; None if it had no use.

    There are ``BUCKETS_PER_KEY`` buckets per key, fewer if that is too much to broadcast; with less than one per
    key and bucket hardly any row would be held back.
    """
    n_keys = keys.count()
    buckets = 1 << WORD_BITS
    while buckets < n_keys * BUCKETS_PER_KEY and buckets < BROADCAST_WORDS << WORD_BITS:
        buckets *= 2
    if buckets < n_keys:
        return None
    return words(keys.select(_bucket(on, buckets).alias("bucket")), "bucket"), buckets


def _bucket(on: list[str], buckets: int) -> Column:
    # Not the hash that rows are shuffled by: its partitions would have their own buckets only.
    return F.pmod(F.xxhash64(F.lit("bucket"), *on), F.lit(buckets))


def may_be_in(rows: DataFrame, held: tuple[DataFrame, int] | None, on: list[str]) -> DataFrame:
    """``rows`` but for those whose key is certainly not among the keys of a ``key_filter``; nothing is shuffled."""
    if held is None:
        return rows
    bitmap, buckets = held
    joined, may = _marked(rows, bitmap, _bucket(on, buckets), "inner", True)
    return joined.filter(may).select(*rows.columns)
