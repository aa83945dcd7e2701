"""Text output: cleaned copies of the input files, and reports."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, functions as F

from samerow.operators.bitmaps import in_rounds, in_tasks, part, without, words
from samerow.sources.files import TASK_BITS, percent_decoded, read_lines

# Fixed value, options of a writer of very many files: Spark's default for local folders adds a hidden checksum file to each
# file, and starts a process for its mode. Other file systems do neither and take no notice.
WITHOUT_CHECKSUMS = {
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
}
# Wide enough for any offset, so that folders in name order are in file order.
BLOCK_DIGITS = 19


def rewrite(
    lines: DataFrame,
    out_dir: str,
    root: str | None = None,
    surplus: DataFrame | None = None,
    n_scans: int = 1,
    options: dict[str, str] | None = None,
) -> None:
    """Write ``lines`` without the ``surplus`` to ``out_dir``, headers and blank ones too; inputs are left untouched.

    ``lines`` are in scan order, as ``read_lines`` and columns added to it leave them. ``surplus`` is a table
    with the ``pos`` of the lines to leave out. Output is one folder ``source=<path below root>/block=<offset>`` per
    split of an input file. Its lines keep their order, and the blocks in name order make up the file.

    Lines are written by the task that reads them, whatever the surplus: its positions become a bitmap that goes to
    all tasks. ``n_scans`` is the number of ``line_scans`` behind ``lines``; each is written by a job of its own, or by
    several if its bitmap is too large to be sent at once. ``options`` go to the writer.
    """
    source = F.col("path")
    if root is not None:
        folder = "/" + quote(root.split(":", 1)[-1].strip("/"), safe="/=+,!$&'()*:;@") + "/"
        source = F.when(F.instr(source, folder) == 0, source).otherwise(
            F.substring(source, F.instr(source, folder) + len(folder), F.length(source))
        )
    bitmap = None if surplus is None else words(surplus)
    written = False
    for scan in range(n_scans):
        first, end = scan << TASK_BITS, (scan + 1) << TASK_BITS
        here = lines if n_scans == 1 else lines.filter(F.col("scan") == scan)
        rounds = [(first, end)] if bitmap is None else in_rounds(bitmap, first, end)
        for a, b in rounds:
            some = here if len(rounds) == 1 else here.filter(in_tasks(a, b))
            if bitmap is not None:
                some = without(some, bitmap if len(rounds) == n_scans == 1 else part(bitmap, a, b), fits=True)
            # Not nullable, so that the writer keeps the order of the sort.
            placed = some.select(
                F.coalesce(percent_decoded(source), F.lit("")).alias("source"),
                F.coalesce(F.lpad(F.col("block").cast("string"), BLOCK_DIGITS, "0"), F.lit("")).alias("block"),
                "pos",
                "value",
            )
            ordered = placed.sortWithinPartitions("source", "block", "pos").select("source", "block", "value")
            writer = ordered.write.mode("append" if written else "error").options(**(options or {}))
            writer.partitionBy("source", "block").text(out_dir)
            written = True


def read_rewritten(spark: SparkSession, out_dir: str) -> DataFrame:
    """The lines ``rewrite`` wrote, with the source in ``path`` and ``file``, ordered as line frames are."""
    lines = read_lines(spark, out_dir, "*.txt", recursive=True)
    source = percent_decoded(percent_decoded(F.regexp_extract("path", "/source=([^/]+)/", 1)))
    old_block = F.regexp_extract("path", r"/block=(\d+)/", 1).cast("long").alias("old")
    block = F.struct(old_block, F.col("block").alias("new")).alias("block")
    return lines.select(source.alias("path"), source.alias("file"), block, "pos", "value")


def write_report(text: DataFrame, out_dir: str) -> None:
    """Write report lines in order; the parts in name order make up the report.

    A ``number_report`` result is written as it is stored, by the tasks that read it: one folder per range and split.
    """
    if not {"part", "offset", "line_no"} <= set(text.columns):
        text.orderBy("prefix", "key", "seq", "file").select("text").write.text(out_dir)
        return
    folders = [F.coalesce(F.lpad(F.col(c).cast("string"), BLOCK_DIGITS, "0"), F.lit("")).alias(c) for c in ("part", "offset")]
    lines = text.select(*folders, "line_no", "text").sortWithinPartitions("part", "offset", "line_no")
    lines.select("part", "offset", "text").write.partitionBy("part", "offset").text(out_dir)
