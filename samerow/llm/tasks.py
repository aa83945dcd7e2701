"""Small helpers of the operators that run Python in Spark tasks on Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

import samerow

# Text handled at once in a task; bounds memory whatever the number of rows in a batch. The arrays that numpy makes of
# a slice take some 30 times its bytes.
SLICE_BYTES = 2 << 20


def ship(spark: SparkSession) -> None:
    """Let the Python workers import this package from where the driver has it.

    On a cluster the package is installed on every node or sent along with the job, and this changes nothing.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(samerow.__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system: Spark keeps a Python worker for later tasks, which may need less."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The texts of a batch as one array with 64-bit offsets; a null is the empty text."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()), "")


def slices(batch: pa.RecordBatch, name: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of at most ``limit`` bytes of text; a longer text is a piece of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_pylist()
    first = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += n
    if first < batch.num_rows:
        yield batch.slice(first)
