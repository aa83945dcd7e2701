"""The text report: a prefix line per duplicate key, then one line per file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from samerow.operators.ranks import ranked
from samerow.operators.skew import join_on_key


@dataclass(frozen=True)
class Labels:
    """Wording of a report; ``{file}`` and ``{n}`` stand for a file name and a number of rows."""

    within: str
    empty: str
    deleted: str
    unlisted: str


# The line that opens a file entry, and the wording in both languages.
ITEM = "    - "
ENGLISH = Labels(
    within="(Within-file duplicates) {file}",
    empty="No duplicates found.",
    deleted="{file} -> Deleted {n} rows",
    unlisted="(Within-file duplicates only - {file})",
)
HUNGARIAN = Labels(
    within="(Fájlon belüli duplikátumok) {file}",
    empty="Nem található duplikátum.",
    deleted="{file} -> Törölve {n} sor",
    unlisted="(Csak fájlon belüli duplikátumok - {file})",
)


def _fill(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def annotate_entries(
    entries: DataFrame, stats: DataFrame, labels: Labels = ENGLISH, cross_only: bool = False
) -> DataFrame:
    """Add ``shown``, the file name followed by the rows deleted from that file, if any.

    The number is of the whole file: rows deleted in favour of other files for a key in several files, rows
    deleted as repeats for a key in one. With ``cross_only`` repeats were not deleted, and it is the first for
    every entry. ``stats`` is a stored ``deletion_stats`` result.
    """
    n = F.col("n_cross_deleted")
    if not cross_only:
        n = F.when(F.col("scope") == "cross", n).otherwise(F.col("n_within_deleted"))
    shown = F.when(n > 0, _fill(labels.deleted, n=n, file=F.col("file"))).otherwise(F.col("file"))
    joined = join_on_key(entries, stats.drop("file"), "left", on="path", weight="n_keys")
    return joined.select(*entries.columns, shown.alias("shown"))


def unlisted_files(entries: DataFrame, stats: DataFrame, labels: Labels = ENGLISH) -> DataFrame:
    """Entries for files that lost repeated rows but are named by no entry."""
    lost = stats.filter(F.col("n_within_deleted") > 0).join(entries.select("path").distinct(), "path", "left_anti")
    return lost.select(
        _fill(labels.unlisted, file=F.col("file")).alias("prefix"),
        F.lit(None).cast(entries.schema["key"].dataType).alias("key"),
        F.lit("within").alias("scope"),
        F.col("n_within_deleted").alias("n_rows"),
        "path",
        "file",
        F.col("n_within_deleted").alias("n"),
        F.lit(True).alias("is_first"),
        _fill(labels.deleted, n=F.col("n_within_deleted"), file=F.col("file")).alias("shown"),
    )


def render_report(entries: DataFrame, labels: Labels = ENGLISH) -> DataFrame:
    """``prefix, key, seq, file, text``: the lines of the report; ordered by the first four they make it up.

    Without entries the report is one fixed sentence.
    """
    shown = F.col("shown") if "shown" in entries.columns else F.col("file")
    item = F.when(F.col("scope") == "within", _fill(labels.within, file=shown)).otherwise(shown)
    heading = F.struct(F.lit(0).alias("seq"), F.col("prefix").alias("text"))
    line = F.struct(F.lit(1).alias("seq"), F.concat(F.lit(ITEM), item).alias("text"))
    text = entries.select(
        "prefix", "key", "file", F.explode(F.when(F.col("is_first"), F.array(heading, line)).otherwise(F.array(line))).alias("l")
    ).select("prefix", "key", "l.seq", "file", "l.text")
    return text.unionByName(_empty_report(entries, labels))


def number_report(text: DataFrame) -> DataFrame:
    """Add ``line_no``, from 1, to the lines of a report; the sort ranges over all tasks.

    The sorted lines are stored, and ``part, offset`` say where, so that ``write_report`` need not sort them again.
    """
    numbered = ranked(text, ["prefix", "key", "seq", "file"], "line_no", layout=True)
    return numbered.withColumn("line_no", F.col("line_no") + 1)


def _empty_report(entries: DataFrame, labels: Labels) -> DataFrame:
    entry_count = entries.limit(1).agg(F.count("*").alias("n"))
    return entry_count.filter(F.col("n") == 0).select(
        F.lit("").alias("prefix"),
        F.lit(None).cast(entries.schema["key"].dataType).alias("key"),
        F.lit(0).alias("seq"),
        F.lit("").alias("file"),
        F.lit(labels.empty).alias("text"),
    )
