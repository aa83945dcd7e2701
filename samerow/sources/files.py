"""Folders of delimited text files as frames of lines.

Line frames have ``path, file, block, pos, value, scan``: the full path, the file name, the byte offset of the
split, a number that grows inside a split, the decoded text, and the number of the scan. ``(path, block, pos)`` orders
the lines of a file without a shuffle.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from samerow.functions import (
    DELIMITER,
    N_FIELDS,
    PREFIX_LEN,
    decode_ignore,
    is_blank,
    key_fields,
    line_prefix,
    strip_py,
)
from samerow.operators.ranks import ROW_BITS
from samerow.session import input_size, listing, pin_splits

# The default file pattern, and the suffixes the oldest release took.
FILE_PATTERN = "*.csv"
LINE_SUFFIXES = "*.{csv,CSV,txt,TXT}"

# Bytes of the files that one scan reads. A folder with more is read by several scans.
SCAN_BYTES = 64 << 30
# A scan has at most this many tasks, in bits; the number of the scan stands above them in a position.
TASK_BITS = 20
LINES = "path string, file string, block bigint, pos bigint, value string, scan int"


def read_lines(
    spark: SparkSession, path: str, pattern: str = FILE_PATTERN, recursive: bool = False
) -> DataFrame:
    """One row per physical line of every file below ``path`` whose name matches ``pattern``.

    ``path`` is taken literally. ``pattern`` may name folders below it (``2024/*.csv``, ``*/part?.csv``); ``**/`` in front
    or ``recursive`` looks into all of them. The text source ends lines at LF, CR LF and lone CR. Files are
    split, so one big file is read in parallel. Spark leaves out names that begin with ``.`` or ``_``; if one
    matches, that is an error.
    """
    first, *more = line_scans(spark, path, pattern, recursive)
    return reduce(DataFrame.unionByName, more, first)


def line_scans(
    spark: SparkSession, path: str, pattern: str = FILE_PATTERN, recursive: bool = False, scan_bytes: int = SCAN_BYTES
) -> list[DataFrame]:
    """``read_lines`` in parts: whole files of at most ``scan_bytes`` together, or one file, for each.

    A line has the same ``pos`` in its part as in the union of all, and ``scan`` is the number of the part. So work on
    the whole can be followed by a job per part, for which Spark reads no other file: a filter on ``scan`` will do.
    """
    pin_splits(spark)
    whole = matching_files(spark, "text", path, pattern, recursive)
    if input_size(whole) <= scan_bytes:
        return [_lines(whole, 0)]
    return scans_of(spark, list_inputs(spark, path, pattern, recursive), scan_bytes)


def scans_of(spark: SparkSession, files: DataFrame, scan_bytes: int = SCAN_BYTES) -> list[DataFrame]:
    """``line_scans`` of the files in a table of ``path, size``; their names pass through the driver, as for any scan."""
    pin_splits(spark)
    scans, names, held = [], [], 0
    files = files.filter("size > 0").orderBy("path")
    for row in files.select(percent_decoded(F.col("path")).alias("path"), "size").toLocalIterator():
        if names and held + row["size"] > scan_bytes:
            scans.append(names)
            names, held = [], 0
        names.append(_literal(row["path"]))
        held += row["size"]
    scans = [each for each in [*scans, names] if each]
    if not scans:
        return [spark.createDataFrame([], LINES)]
    with listing(spark):
        return [_lines(spark.read.text(each), i) for i, each in enumerate(scans)]


def _lines(files: DataFrame, scan: int) -> DataFrame:
    meta = F.col("_metadata")
    return files.select(
        meta["file_path"].alias("path"),
        percent_decoded(meta["file_name"]).alias("file"),
        meta["file_block_start"].alias("block"),
        (F.monotonically_increasing_id() + F.lit(scan << (ROW_BITS + TASK_BITS))).alias("pos"),
        decode_ignore(F.col("value")).alias("value"),
        F.lit(scan).alias("scan"),
    )


def _literal(path: str) -> str:
    """A path in which no character has a meaning for globs."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def matching_files(spark: SparkSession, source: str, path: str, pattern: str, recursive: bool) -> DataFrame:
    """A scan of the matching files and nothing else: Spark never gets a folder to infer partitions from."""
    with listing(spark):
        return _matching_files(spark, source, path, pattern, recursive)


def _matching_files(spark: SparkSession, source: str, path: str, pattern: str, recursive: bool) -> DataFrame:
    folder = _literal(path.rstrip("/"))
    if pattern.startswith("**/"):
        recursive, pattern = True, pattern[3:]
    if recursive and "/" in pattern:
        raise ValueError("a pattern for all folders is one on file names")
    _refuse_hidden(spark, folder, pattern, recursive)
    everywhere = spark.read.format(source).option("recursiveFileLookup", "true")
    if recursive:
        return everywhere.option("pathGlobFilter", pattern).load(folder)
    found = _glob(spark, f"{folder}/{pattern}")
    files = [s for s in found if s.isFile()] if any(s.isDirectory() for s in found) else found
    if not len(files):
        return everywhere.option("pathGlobFilter", "\x01").load(folder)  # no name is that
    if files is found:
        return spark.read.format(source).load(f"{folder}/{pattern}")
    # A folder has a name like the files wanted: name these.
    names = [_literal(s.getPath().toString()) for s in files]
    return spark.read.format(source).load(names)


def _glob(spark: SparkSession, pattern: str, names: str = "*"):
    """Statuses of the paths that match, with a name that matches ``names`` too, still in the JVM."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(pattern)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target, hadoop.GlobFilter(names))
    return found or []


def _refuse_hidden(spark: SparkSession, folder: str, pattern: str, recursive: bool) -> None:
    parent, _, name = pattern.rpartition("/")
    level = f"{folder}/{parent}" if parent else folder
    checks = []
    # The names of a level are looked at while the next level is looked for.
    with ThreadPoolExecutor() as pool:
        while True:
            # A file system may keep a hidden checksum file per file; such names are sorted out in the JVM.
            checks.append(pool.submit(_glob, spark, f"{level}/[._]*", name))
            if not recursive or not len(_glob(spark, f"{level}/*/*")):
                break
            level += "/*"
    for check in checks:
        for status in check.result():
            if status.isFile():
                raise ValueError(f"Spark does not read hidden files, but {status.getPath()} matches {pattern}")


def percent_decoded(col: Column) -> Column:
    """Spark gives paths and names as in URIs; undo that where it changed anything."""
    return F.when(F.contains(col, F.lit("%")), F.url_decode(F.replace(col, F.lit("+"), F.lit("%2B")))).otherwise(col)


def list_inputs(
    spark: SparkSession, path: str, pattern: str = FILE_PATTERN, recursive: bool = False
) -> DataFrame:
    """``path, file, size`` of the files ``read_lines`` reads, empty ones too.

    File scans leave empty files out, so the names come from the listing the JVM has made for the scan.
    """
    files = matching_files(spark, "binaryFile", path, pattern, recursive)
    meta = F.col("_metadata")
    sizes = files.select(meta["file_path"].alias("path"), meta["file_size"].alias("size"))
    listed = spark._jvm.java.util.Collections.singletonList(files._jdf.inputFiles())
    session = spark._jsparkSession
    listing = DataFrame(session.createDataset(listed, session.implicits().newStringArrayEncoder()).toDF(), spark)
    names = listing.select(F.explode("value").alias("path")).select(
        F.regexp_replace("path", "^file:///", "file:/").alias("path")
    )
    return names.join(sizes, "path", "left").select(
        "path",
        percent_decoded(F.substring_index("path", "/", -1)).alias("file"),
        F.coalesce("size", F.lit(0)).cast("long").alias("size"),
    )


def mark_headers(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Add ``is_header``, ``line`` (the stripped text) and ``is_blank``.

    The header is the first line of the block at offset 0; ``blocks`` is the ``index_blocks`` result of the same
    lines. Only the positions of the headers are joined: one number per file, of which the scan itself keeps
    more on the driver, so they are broadcast and no line is moved.
    """
    headers = blocks.filter(F.col("block") == 0).select(F.col("start").alias("header_pos"))
    return lines.join(F.broadcast(headers), F.col("pos") == F.col("header_pos"), "left").select(
        *lines.columns,
        F.col("header_pos").isNotNull().alias("is_header"),
        strip_py(F.col("value")).alias("line"),
        is_blank(F.col("value")).alias("is_blank"),
    )


def key_lines(marked: DataFrame, **options) -> DataFrame:
    """All lines with ``key`` and ``prefix``. Headers and blank lines have no key."""
    takes_part, columns = _key_columns(**options)
    return marked.withColumns({**columns, "key": F.when(takes_part, columns["key"])})


def keyed(marked: DataFrame, **options) -> DataFrame:
    """The rows that take part in detection, those of ``key_lines`` with a key."""
    takes_part, columns = _key_columns(**options)
    return marked.filter(takes_part).withColumns(columns)


def _key_columns(
    delimiter: str = DELIMITER,
    n_fields: int = N_FIELDS,
    prefix_len: int = PREFIX_LEN,
    drop_empty_keys: bool = False,
    tabs_to_spaces: bool = False,
) -> tuple[Column, dict[str, Column]]:
    line = F.col("line")
    key = key_fields(line, delimiter, n_fields)
    takes_part = ~F.col("is_header") & ~F.col("is_blank")
    if drop_empty_keys:
        takes_part &= key != ""
    return takes_part, {"key": key, "prefix": line_prefix(line, prefix_len, tabs_to_spaces)}
