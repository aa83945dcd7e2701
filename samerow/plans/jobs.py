"""The two jobs: report the duplicates of a folder, and write cleaned copies of its files."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from samerow.functions import DELIMITER, N_FIELDS, PREFIX_LEN
from samerow.operators import (
    ENGLISH,
    Labels,
    annotate_entries,
    deletion_stats,
    index_blocks,
    input_totals,
    key_files,
    key_summary,
    line_counts,
    render_report,
    report_entries,
    run_summary,
    surplus_rows,
    unlisted_files,
)
from samerow.session import delete_folder, input_size, job_folder, job_settings, save
from samerow.sources import keyed, line_scans, list_inputs, mark_headers, require_unchanged, rewrite, snapshot
from samerow.sources.files import FILE_PATTERN


@dataclass(frozen=True)
class Options:
    pattern: str = FILE_PATTERN
    recursive: bool = False
    delimiter: str = DELIMITER
    n_fields: int = N_FIELDS
    prefix_len: int = PREFIX_LEN
    drop_empty_keys: bool = False
    tabs_to_spaces: bool = False
    cross_only: bool = False  # report keys in several files only
    labels: Labels = ENGLISH

    def keys(self) -> dict:
        names = ("delimiter", "n_fields", "prefix_len", "drop_empty_keys", "tabs_to_spaces")
        return {name: getattr(self, name) for name in names}


class _Stored:
    """A result whose tables lie in a folder of its own; close it, or leave its ``with`` block, to delete them."""

    def close(self) -> None:
        delete_folder(self.spark, self.folder)

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        self.close()


@dataclass(frozen=True)
class Found(_Stored):
    """``found``, ``summary`` and ``entries`` are stored tables of the duplicates only; ``listed`` are the reported entries."""

    rows: DataFrame
    found: DataFrame
    summary: DataFrame
    entries: DataFrame
    listed: DataFrame
    text: DataFrame
    spark: SparkSession
    folder: str


@dataclass(frozen=True)
class Cleaned(_Stored):
    stats: DataFrame
    summary: DataFrame
    text: DataFrame
    spark: SparkSession
    folder: str


def find_in_rows(rows: DataFrame, options: Options = Options()) -> Found:
    """Duplicates of any keyed rows, from files or tables.

    All rows are read twice: to count keys by file, and to look up the prefixes of first rows. Everything after
    that works on stored tables of duplicates.
    """
    spark = rows.sparkSession
    with job_settings(spark, input_size(rows)), job_folder(spark) as folder:
        return _find(rows, options, folder)


def find_duplicates(spark: SparkSession, path: str, options: Options = Options()) -> Found:
    """Duplicates of the text files below ``path``. Fails if one of them is changed meanwhile."""
    files = list_inputs(spark, path, options.pattern, options.recursive)
    with job_settings(spark, input_totals(files).first()["total_size"]), job_folder(spark) as folder:
        before = snapshot(spark, path, options.pattern, options.recursive)
        marked, _, _ = _scan(spark, path, options)
        found = _find(keyed(marked, **options.keys()), options, folder)
        require_unchanged(spark, before, path, options.pattern, options.recursive)
        return found


def clean(
    spark: SparkSession, path: str, out_dir: str, mode: str = "all", options: Options = Options()
) -> Cleaned:
    """Write copies of the files below ``path`` without their duplicates to the new folder ``out_dir``.

    ``mode`` is ``all`` (one row per key), ``cross`` (a key stays in one file, repeats there too) or
    ``within`` (the first row of a key in each file). If an input file is changed meanwhile, the job fails and
    leaves no output.
    """
    if mode not in ("all", "cross", "within"):
        raise ValueError(f"mode must be all, cross or within, not {mode!r}")
    files = list_inputs(spark, path, options.pattern, options.recursive)
    with job_settings(spark, input_totals(files).first()["total_size"]), job_folder(spark) as folder:
        before = snapshot(spark, path, options.pattern, options.recursive)
        marked, blocks, n_scans = _scan(spark, path, options)
        found = _find(keyed(marked, **options.keys()), options, folder)
        surplus = save(surplus_rows(found.rows, found.found, mode))
        require_unchanged(spark, before, path, options.pattern, options.recursive)
        rewrite(marked, out_dir, root=path, surplus=surplus, n_scans=n_scans)
        try:
            require_unchanged(spark, before, path, options.pattern, options.recursive)
        except RuntimeError:
            delete_folder(spark, out_dir)
            raise

        stats = deletion_stats(found.entries)
        none = F.lit(0).cast("long")
        if mode == "within":
            surplus = found.entries.groupBy("path", "file").agg(
                F.count("*").alias("n_keys"), F.sum(F.col("n") - 1).alias("n_within_deleted")
            )
            stats = surplus.withColumn("n_cross_deleted", none)
        elif mode == "cross":
            stats = stats.withColumn("n_within_deleted", none)
        stats = save(stats)
        shown = annotate_entries(found.listed, stats, options.labels, cross_only=mode == "cross")
        everything = save(shown.unionByName(unlisted_files(shown, stats, options.labels)))
        summary = save(run_summary(line_counts(blocks, files), stats))
        return Cleaned(stats, summary, render_report(everything, options.labels), spark, folder)


def _scan(spark: SparkSession, path: str, options: Options) -> tuple[DataFrame, DataFrame, int]:
    scans = line_scans(spark, path, options.pattern, options.recursive)
    lines = reduce(DataFrame.unionByName, scans)
    blocks = index_blocks(lines)
    return mark_headers(lines, blocks), blocks, len(scans)


def _find(rows: DataFrame, options: Options, folder: str) -> Found:
    found = save(key_files(rows))
    summary = save(key_summary(found, rows))
    entries = save(report_entries(found, summary))
    listed = entries.filter(F.col("scope") == "cross") if options.cross_only else entries
    text = render_report(listed, options.labels)
    return Found(rows, found, summary, entries, listed, text, rows.sparkSession, folder)
