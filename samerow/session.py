"""Session settings the jobs rely on, and the shared folder for tables written between two passes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


# Input bytes per shuffle partition before adaptive execution joins small ones.
PARTITION_BYTES = 128 * 1024 * 1024

_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_SPLITS = "spark.sql.files.minPartitionNum"
_OPEN_COST = "spark.sql.files.openCostInBytes"
# Fixed value: bytes of text that take about as long as to open a file.
OPEN_BYTES = 128 * 1024
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
# Fixed value: tasks per core that list the folders of a scan.
LISTING_TASKS = 4
# forceOptimizeSkewedJoin: skewed joins are split also where that costs one more shuffle.
_OPTIONS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}
# The number of partitions last set here, per application.
_wanted: dict[str, str] = {}
_folder: ContextVar[str | None] = ContextVar("job folder", default=None)


def configure(spark: SparkSession, input_bytes: int = 0) -> SparkSession:
    """Switch on adaptive execution with skew-join splitting, and size shuffles for an input of that many bytes.

    Shuffles of large inputs start with enough partitions for each to fit into memory; adaptive execution joins
    those that turn out small. The next call with a small input takes that back.
    """
    for name, value in _OPTIONS.items():
        spark.conf.set(name, value)
    application = spark.sparkContext.applicationId
    ours = _wanted.pop(application, None)
    if ours is not None and spark.conf.get(_INITIAL, None) == ours:
        spark.conf.unset(_INITIAL)
    wanted = -(-input_bytes // PARTITION_BYTES)
    if wanted > shuffle_partitions(spark):
        spark.conf.set(_INITIAL, str(wanted))
        _wanted[application] = str(wanted)
    return spark


@contextmanager
def job_settings(spark: SparkSession, input_bytes: int = 0) -> Iterator[None]:
    """``configure`` and ``pin_splits`` for the time of a job; then every option is as it was."""
    before = {name: spark.conf.get(name, None) for name in [*_OPTIONS, _INITIAL, _SPLITS]}
    try:
        configure(spark, input_bytes)
        pin_splits(spark)
        yield
    finally:
        _wanted.pop(spark.sparkContext.applicationId, None)
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def input_size(df: DataFrame) -> int:
    """Bytes that the scans below ``df`` read, from the statistics of the plan; unknown sizes count as none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get(_INITIAL, None) or spark.conf.get("spark.sql.shuffle.partitions"))


def pin_splits(spark: SparkSession) -> None:
    """Keep file splits the same for every scan of this session.

    Spark derives the split size from the cores it has at planning time. With dynamic allocation that can
    differ between two scans of one job, and row positions taken from both would not match.
    """
    if spark.conf.get(_SPLITS, None) is None:
        spark.conf.set(_SPLITS, str(spark.sparkContext.defaultParallelism))


def pack_small_files(spark: SparkSession) -> None:
    """Let the tasks of this session's scans grow with the bytes they read, not with the number of files.

    Spark counts 4 MB for every file, so that a task reads a few small ones only, and the shuffle after it has a block
    for each of these tasks and each of its partitions. A lower cost that is set already is left as it is. Row positions
    depend on this: call it before the first scan of a folder. Jobs don't, since their rows can be read after them.
    """
    if spark._jsparkSession.sessionState().conf().filesOpenCostInBytes() > OPEN_BYTES:
        spark.conf.set(_OPEN_COST, str(OPEN_BYTES))


@contextmanager
def listing(spark: SparkSession) -> Iterator[None]:
    """List the folders of a scan by a few tasks per core while the block lasts.

    Spark's own limit is 10,000 tasks, so nearly every folder gets one, and to start it takes far longer than the listing.
    """
    before = spark.conf.get(_LISTING, None)
    wanted = min(int(spark.conf.get(_LISTING)), LISTING_TASKS * spark.sparkContext.defaultParallelism)
    spark.conf.set(_LISTING, str(wanted))
    try:
        yield
    finally:
        spark.conf.unset(_LISTING) if before is None else spark.conf.set(_LISTING, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which the driver and every executor can reach."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return base.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the shared one, inside the folder of the current job if there is one."""
    return f"{_folder.get() or shared_folder(spark)}/samerow-{uuid.uuid4().hex}"


@contextmanager
def job_folder(spark: SparkSession) -> Iterator[str]:
    """A folder for all tables that are stored until the block ends. They stay, unless the block fails."""
    path = f"{shared_folder(spark)}/samerow-job-{uuid.uuid4().hex}"
    token = _folder.set(path)
    try:
        yield path
    except BaseException:
        delete_folder(spark, path)
        raise
    finally:
        _folder.reset(token)


def delete_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def save(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later steps then start from stored files instead of repeating the scans behind ``df``, an executor loss
    costs no recomputation, and the planner knows the real size when it picks a join strategy.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def save_alone(spark: SparkSession, build: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """``save`` what ``build`` makes, and delete the tables it stored on the way; also the folder of the result."""
    path = scratch_dir(spark)
    with job_folder(spark) as folder:
        df = build()
        df.write.parquet(path)
    delete_folder(spark, folder)
    return spark.read.schema(df.schema).parquet(path), path
