"""Duplicates among files that arrive over time, without reading the old ones again.

The state is a table of counts: one row per key and file, with the first row of the key there. Counts of different
files never have to be added up, so new files are added by appending theirs. The table is bucketed by the hash of
the key, and totals over old and new files are taken bucket by bucket, without a shuffle.

A batch of files counts from the moment its files are listed in the state; rows of a batch that failed before are
passed over.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from samerow.operators import index_blocks, render_report
from samerow.operators.skew import key_hash
from samerow.plans.jobs import Options
from samerow.session import delete_folder, job_folder, job_settings
from samerow.sources import keyed, mark_headers, require_unchanged, snapshot
from samerow.sources.files import scans_of
from samerow.sources.snapshot import require_same

COUNTS = (
    "key_hash bigint, key string, path string, file string, n bigint, first struct<block: bigint, pos: bigint, prefix: string>, "
    "batch string"
)
FILES = "path string, size bigint, modified timestamp, batch string"


class KeyState:
    """The counts of all files added so far, in a folder of its own that all executors share. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, options: Options = Options(), buckets: int = 64):
        """Open the state in ``folder``, or begin one. Options and number of buckets must be those it was begun with."""
        self.spark, self.folder, self.options, self.buckets = spark, folder.rstrip("/"), options, buckets
        self._settle()

    def _settle(self) -> None:
        described = f"{self.options.keys()} buckets={self.buckets}"
        path = f"{self.folder}/options"
        if self._exists(path):
            known = self.spark.read.text(path).first()["value"]
            if known != described:
                raise ValueError(f"the state was begun with {known}, not with {described}")
        else:
            self.spark.createDataFrame([(described,)], "value string").coalesce(1).write.text(path)

    def _exists(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def files(self) -> DataFrame:
        """``path, size, modified, batch`` of the files that were added."""
        path = f"{self.folder}/files"
        if not self._exists(path):
            return self.spark.createDataFrame([], FILES)
        return self.spark.read.schema(FILES).parquet(path)

    def add(self, path: str) -> int:
        """Add the files below ``path`` that are not in the state yet, and return their number.

        Old files are listed, never read. One that has another size or time of change than when it was added is an
        error, and so is a new one that is changed while it is read.
        """
        o, spark = self.options, self.spark
        with job_folder(spark) as scratch:
            # One listing before the lines are read, and one after.
            now = snapshot(spark, path, o.pattern, o.recursive)
            with job_settings(spark, now.agg(F.sum("size").alias("size")).first()["size"] or 0):
                known = self.files()
                require_same(now.select("path").join(known, "path").select("path", "size", "modified"), now)
                new = now.join(known.select("path"), "path", "left_anti")
                lines = reduce(DataFrame.unionByName, scans_of(spark, new))
                marked = mark_headers(lines, index_blocks(lines))
                batch = uuid.uuid4().hex
                counts = _counts(keyed(marked, **o.keys())).withColumn("batch", F.lit(batch))
                self._append(counts.repartition(self.buckets, "key_hash"))
                require_unchanged(spark, new, path, o.pattern, o.recursive)
                n_new = new.count()
                if n_new:
                    new.withColumn("batch", F.lit(batch)).coalesce(1).write.mode("append").parquet(f"{self.folder}/files")
                delete_folder(spark, scratch)
                return n_new

    def _append(self, counts: DataFrame) -> None:
        counts.select("key_hash", "key", "path", "file", "n", "first", "batch").write.insertInto(self._table())

    def _table(self) -> str:
        """The bucketed table over the folder, declared for this session."""
        name = f"samerow_state_{uuid.uuid5(uuid.NAMESPACE_URL, self.folder).hex}"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({COUNTS}) USING parquet CLUSTERED BY (key_hash) INTO {self.buckets} BUCKETS"
            f" LOCATION '{self.folder}/counts'"
        )
        self.spark.catalog.refreshTable(name)
        return name

    def close(self) -> None:
        """Take the table out of the session's catalog; the folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table()}")

    def entries(self, min_rows: int = 2) -> DataFrame:
        """``report_entries`` over all files of the state. A key's rows are in one bucket, and no row leaves its own."""
        batches = self.files().select("batch").distinct()
        counts = self.spark.table(self._table()).join(F.broadcast(batches), "batch", "left_semi")  # a row per add
        of_key = Window.partitionBy("key_hash", "key")
        least = F.min(F.struct("file", "path", "first")).over(of_key).alias("least")
        totals = counts.select("*", F.sum("n").over(of_key).alias("n_rows"), least).filter(F.col("n_rows") >= min_rows)
        return totals.select(
            F.col("least.first.prefix").alias("prefix"),
            "key",
            F.when(F.col("n") < F.col("n_rows"), "cross").otherwise("within").alias("scope"),
            "n_rows",
            "path",
            "file",
            "n",
            (F.col("path") == F.col("least.path")).alias("is_first"),
        )

    def report(self) -> DataFrame:
        """The lines of the report over all files, for ``write_report``."""
        found = self.entries()
        listed = found.filter(F.col("scope") == "cross") if self.options.cross_only else found
        return render_report(listed, self.options.labels)


def _counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(key_hash(), "key", "path", "file").agg(
        F.count("*").alias("n"), F.min(F.struct("block", "pos", "prefix")).alias("first")
    )
