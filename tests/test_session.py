import pytest

from samerow.session import (
    LISTING_TASKS,
    PARTITION_BYTES,
    configure,
    input_size,
    job_settings,
    pin_splits,
    save,
    scratch_dir,
    shuffle_partitions,
)
from samerow.sources import list_inputs
from samerow.sources.files import scans_of


@pytest.fixture
def keep_options(spark):
    names = ["adaptive.coalescePartitions.initialPartitionNum", "files.minPartitionNum"]
    before = {n: spark.conf.get("spark.sql." + n, None) for n in names}
    yield
    for name, value in before.items():
        spark.conf.unset("spark.sql." + name) if value is None else spark.conf.set("spark.sql." + name, value)


def test_shuffles_follow_the_input(spark, keep_options):
    configure(spark)
    assert shuffle_partitions(spark) == 8
    configure(spark, 7 * PARTITION_BYTES)
    assert shuffle_partitions(spark) == 8
    configure(spark, 100 * 10**12)
    assert shuffle_partitions(spark) == -(-100 * 10**12 // PARTITION_BYTES)
    configure(spark, PARTITION_BYTES)
    assert shuffle_partitions(spark) == 8
    assert spark.conf.get("spark.sql.adaptive.forceOptimizeSkewedJoin") == "true"
    with job_settings(spark, 5000 * PARTITION_BYTES):
        assert shuffle_partitions(spark) == 5000
    assert shuffle_partitions(spark) == 8


def test_input_size_is_that_of_the_scans(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    size = input_size(table)
    assert size == sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    assert input_size(table.crossJoin(table)) == 2 * size


def test_splits_are_pinned_once(spark, keep_options):
    spark.conf.unset("spark.sql.files.minPartitionNum")
    pin_splits(spark)
    assert spark.conf.get("spark.sql.files.minPartitionNum") == str(spark.sparkContext.defaultParallelism)
    spark.conf.set("spark.sql.files.minPartitionNum", "3")
    pin_splits(spark)
    assert spark.conf.get("spark.sql.files.minPartitionNum") == "3"


def test_tables_are_stored_below_the_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert scratch_dir(spark).startswith(base) and scratch_dir(spark) != scratch_dir(spark)
    df = spark.range(5).selectExpr("id", "struct(id AS a, 'x' AS b) AS s", "cast(null AS string) AS t")
    stored = save(df)
    assert stored.schema.simpleString() == df.schema.simpleString()
    assert sorted(stored.collect()) == sorted(df.collect())
    assert all(base.removeprefix("file:") in f for f in stored.inputFiles())


def test_a_cluster_must_name_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(Session())


@pytest.mark.parametrize("own", [None, "3"])
def test_many_folders_are_listed_by_few_tasks(spark, tmp_path, conf, own):
    for i in range(150):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "a.csv").write_text("h\nk\n")
    name = "sources.parallelPartitionDiscovery.parallelism"
    if own:
        conf(**{name.replace(".", "__"): own})
    context = spark.sparkContext
    most = int(own or LISTING_TASKS * context.defaultParallelism)
    context.setJobGroup(f"listing {own}", "")
    try:
        assert list_inputs(spark, str(tmp_path), recursive=True).count() == 150
        listed = list_inputs(spark, str(tmp_path), recursive=True)
        assert len(scans_of(spark, listed)) == 1
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    status = context.statusTracker()
    jobs = sorted(status.getJobIdsForGroup(f"listing {own}"))
    tasks = [status.getStageInfo(s).numTasks for j in jobs for s in status.getJobInfo(j).stageIds if status.getStageInfo(s)]
    assert tasks[0] == most  # the first job lists
    assert max(tasks) < 150
    assert spark.conf.get("spark.sql." + name, None) == own
