"""Any table as a frame of rows with a key, so that the operators run on parquet as on text files."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from samerow.functions import DELIMITER, N_FIELDS, PREFIX_LEN, is_blank, key_fields, line_prefix, strip_py
from samerow.session import save, shuffle_partitions


def split_lines(df: DataFrame, file: Column, text: Column) -> DataFrame:
    """One row per line of a text column; ``file`` names the source and the line index is the position."""
    name = file.cast("string")
    return df.select(name.alias("path"), name.alias("file"), F.posexplode(F.split(text, "\n")).alias("i", "value")).select(
        "path", "file", F.lit(0).cast("long").alias("block"), F.col("i").cast("long").alias("pos"), "value"
    )


def rows_from_lines(
    lines: DataFrame,
    delimiter: str = DELIMITER,
    n_fields: int = N_FIELDS,
    prefix_len: int = PREFIX_LEN,
    drop_empty_keys: bool = False,
) -> DataFrame:
    """Key the non-blank lines of ``split_lines`` or ``chunked`` by their first fields."""
    line = F.col("line")
    rows = (
        lines.filter(~is_blank(F.col("value")))
        .withColumn("line", strip_py(F.col("value")))
        .withColumn("key", key_fields(line, delimiter, n_fields))
        .withColumn("prefix", line_prefix(line, prefix_len))
    )
    return rows.filter(F.col("key") != "") if drop_empty_keys else rows


def rows_from_table(
    df: DataFrame, file: Column, order: Column, key_cols: list[str], line: Column, prefix_len: int = PREFIX_LEN
) -> DataFrame:
    """Key table rows by columns. A row with a null key column has no key and takes no part.

    ``order`` must be a whole number that is unique inside a file. Several key columns form a struct, which
    compares column by column, so no separator can mix up two keys.
    """
    present = reduce(and_, [F.col(c).isNotNull() for c in key_cols])
    name = file.cast("string")
    return df.filter(present).select(
        name.alias("path"),
        name.alias("file"),
        F.lit(0).cast("long").alias("block"),
        order.cast("long").alias("pos"),
        line.alias("line"),
        (F.col(key_cols[0]) if len(key_cols) == 1 else F.struct(*key_cols)).alias("key"),
        line_prefix(line, prefix_len).alias("prefix"),
    )


def drop_first_rows(lines: DataFrame) -> DataFrame:
    """Leave out the header, the first row of every file, for lines made by ``split_lines``."""
    return lines.filter(F.col("pos") > 0)


def chunked(lines: DataFrame, *order: str) -> DataFrame:
    """Give lines of few big files a ``block`` and a ``pos`` by sorting them over all tasks.

    The sort ranges over file and order columns, which must tell all lines apart, so a file that holds most rows is
    spread over many blocks. What is sorted and stored are these columns with their places, since block numbers
    must not change when a task is run again; the lines find their places by them.
    """
    columns = ["path", *order]
    placed = save(
        lines.select(*columns)
        .repartitionByRange(shuffle_partitions(lines.sparkSession), *columns)
        .sortWithinPartitions(*columns)
        .withColumn("block", F.spark_partition_id().cast("long"))
        .withColumn("pos", F.monotonically_increasing_id())
    )
    return lines.join(placed, columns)
