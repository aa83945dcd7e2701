"""The state of the input files when a job began, to find out whether one was changed while it ran.

A job reads its files several times, and places taken from one pass serve in the next. A file that is written to
in between would lose wrong lines. So the size and the time of change of every file are stored before the first
pass, and compared with a new listing after the last one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from samerow.session import LISTING_TASKS, save
from samerow.sources.files import FILE_PATTERN, matching_files


def snapshot(spark: SparkSession, path: str, pattern: str = FILE_PATTERN, recursive: bool = False) -> DataFrame:
    """Store ``path, size, modified`` of every file with any content that ``read_lines`` would read now."""
    return save(_listed(spark, path, pattern, recursive))


def _listed(spark: SparkSession, path: str, pattern: str, recursive: bool) -> DataFrame:
    meta = F.col("_metadata")
    listed = matching_files(spark, "binaryFile", path, pattern, recursive).select(
        meta["file_path"].alias("path"),
        meta["file_size"].alias("size"),
        meta["file_modification_time"].alias("modified"),
    )
    # A split has a few files, of which only names are read: not a task and a stored file for each.
    return listed.coalesce(LISTING_TASKS * spark.sparkContext.defaultParallelism)


def changed_files(
    spark: SparkSession, before: DataFrame, path: str, pattern: str = FILE_PATTERN, recursive: bool = False
) -> DataFrame:
    """``path`` of the files of a ``snapshot`` that are gone now, or have another size or time of change.

    Files that came later are not looked at: no pass of the job reads them.
    """
    return changed_since(before, _listed(spark, path, pattern, recursive))


def changed_since(before: DataFrame, now: DataFrame) -> DataFrame:
    """``changed_files`` between two snapshots."""
    now = now.withColumnsRenamed({"size": "size_now", "modified": "modified_now"})
    same = (F.col("size") == F.col("size_now")) & (F.col("modified") == F.col("modified_now"))
    return before.join(now, "path", "left").filter(~F.coalesce(same, F.lit(False))).select("path")


def require_unchanged(
    spark: SparkSession, before: DataFrame, path: str, pattern: str = FILE_PATTERN, recursive: bool = False
) -> None:
    """Fail if a file of the ``snapshot`` has changed."""
    require_same(before, _listed(spark, path, pattern, recursive))


def require_same(before: DataFrame, now: DataFrame) -> None:
    """Fail if a file of the snapshot ``before`` is another in ``now``."""
    changed = changed_since(before, now).orderBy("path").first()
    if changed is not None:
        raise RuntimeError(f"{changed['path']} was changed while the job read it")
