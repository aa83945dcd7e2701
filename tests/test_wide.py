"""Wide keys by digest, bitmaps, hash filters, and keys in very many files."""

import random
import re

import pytest
from pyspark.sql import functions as F

from samerow.operators import bitmaps, dedupe_all, duplicate_rows, file_lists, key_files, key_summary, report_entries, surplus_rows
from samerow.operators.bitmaps import key_filter, may_be_in, without, words
from samerow.operators.wide import dedupe_wide, wide_entries, wide_key_files
from samerow.session import configure, save

ROWS = "path string, file string, block bigint, pos bigint, line string, key string, prefix string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def text_rows(spark, seed, n=400, partitions=7):
    rnd = random.Random(seed)
    texts = ["", "é" * 30, "long " * 400] + [f"text {i} " * 20 for i in range(60)]
    data = []
    for i in range(n):
        text = "hot" * 500 if i % 3 == 0 else rnd.choice(texts) if i % 3 == 1 else f"only {i}"
        f = f"f{rnd.randrange(9)}"
        data.append((f, f, 0, i, text, text, text[:47]))
    return save(spark.createDataFrame(data, ROWS).repartition(partitions))


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# 4 bits and 0 bits of a digest: nearly all, and all, keys that repeat collide.
DIGESTS = {
    "whole": None,
    "short": lambda c: F.substring(F.unhex(F.sha2(c, 256)), 1, 1),
    "constant": lambda c: F.lit(b"same"),
}


@pytest.mark.parametrize("kind", DIGESTS)
def test_wide_keys_give_the_same_report_and_rows(spark, kind):
    rows = text_rows(spark, 3)
    options = {} if DIGESTS[kind] is None else {"digest": DIGESTS[kind]}
    found = save(key_files(rows))
    expected = report_entries(found, save(key_summary(found, rows)))
    columns = ["prefix", "key", "scope", "n_rows", "path", "file", "n", "is_first"]
    assert tuples(wide_entries(rows, **options), *columns) == tuples(expected, *columns)
    places = ["path", "pos", "key", "line"]
    assert tuples(dedupe_wide(rows, **options), *places) == tuples(dedupe_all(rows), *places)
    wide = wide_key_files(rows, **options)
    assert tuples(wide.texts, "wide_key") == sorted({(r["key"],) for r in found.select("key").collect()}, key=repr)


def test_no_key_alone_is_shuffled(spark, conf):
    conf(autoBroadcastJoinThreshold="-1", adaptive__autoBroadcastJoinThreshold="-1")
    rows = text_rows(spark, 4)
    wide = wide_key_files(rows)
    # All that is left to do for the surviving rows is in the tasks that read them.
    left = dedupe_wide(rows)
    text = plan(left)
    assert not re.search(r"Exchange (hash|range|Round)", text) and "BroadcastHashJoin" in text
    seen = plan(key_files(wide.rows))
    scans = re.findall(r"Exchange hashpartitioning.*", seen)
    assert scans and not re.search("wide_key|line#|prefix#", seen[seen.rindex("Exchange hashpartitioning") :].split("Scan")[0])


def test_rows_with_keys_of_their_own_are_held_back(spark, conf, capsys):
    """Unique rows do not reach the shuffle of the verification or of the duplicate rows."""
    conf(autoBroadcastJoinThreshold="-1", adaptive__autoBroadcastJoinThreshold="-1", adaptive__coalescePartitions__enabled="false")
    n = 20_000
    rows = save(
        spark.range(0, n, 1, 4).select(
            F.when(F.col("id") % 100 == 0, F.lit("twice")).otherwise(F.col("id").cast("string")).alias("key"),
            F.lit("f").alias("path"), F.lit("f").alias("file"), F.lit(0).cast("long").alias("block"), F.col("id").alias("pos"),
        )
    )
    keys = save(key_files(rows).select("key", "n_rows").distinct())
    found = duplicate_rows(rows, keys)
    assert found.count() == n // 100
    found.collect()
    found.explain("formatted")
    final = capsys.readouterr().out.split("Initial Plan")[0]
    shuffled = [float(x) for x in re.findall(r"ShuffleQueryStage.*rowCount=([\d.E+]+)", final)]
    assert shuffled and max(shuffled) < n / 10


def test_duplicate_rows_are_the_same_without_the_filter(spark, conf, monkeypatch):
    rows = text_rows(spark, 5)
    keys = save(key_files(rows).select("key", "n_rows").distinct())
    one = tuples(duplicate_rows(rows, keys), "path", "pos")
    conf(autoBroadcastJoinThreshold="-1", adaptive__autoBroadcastJoinThreshold="-1")
    two = tuples(duplicate_rows(rows, keys), "path", "pos")
    monkeypatch.setattr(bitmaps, "BROADCAST_WORDS", 0)
    three = tuples(duplicate_rows(rows, keys), "path", "pos")
    assert one == two == three and one


def test_bitmap_of_positions(spark):
    rnd = random.Random(2)
    numbers = [rnd.randrange(1 << 45) for _ in range(300)] + [0, 63, 64, 127, (1 << 62) + 5]
    marked = set(rnd.sample(numbers, 150)) | {63, (1 << 62) + 5}
    rows = spark.createDataFrame([(n, "x") for n in numbers], "pos bigint, word string")
    bitmap = words(spark.createDataFrame([(n,) for n in [*marked, 63, None]], "pos bigint"))
    left = without(rows, bitmap)
    assert left.columns == ["pos", "word"] and sorted(r["pos"] for r in left.collect()) == sorted(n for n in numbers if n not in marked)
    assert without(rows, bitmap.limit(0)).count() == len(numbers)


def test_rounds_cover_every_task_once(spark, monkeypatch):
    numbers = [(t << 33) + i * 64 for t, n in {0: 3, 2: 5, 3: 1, 7: 9, 9: 2}.items() for i in range(n)]
    bitmap = words(spark.createDataFrame([(n,) for n in numbers], "pos bigint"))
    assert bitmaps.in_rounds(bitmap, 0, 16) == [(0, 16)]
    monkeypatch.setattr(bitmaps, "BROADCAST_WORDS", 6)
    rounds = bitmaps.in_rounds(bitmap, 0, 16)
    assert rounds == [(0, 2), (2, 7), (7, 9), (9, 16)]
    assert sum(bitmaps.part(bitmap, a, b).count() for a, b in rounds) == len(numbers)


def test_key_filter_lets_all_keys_and_few_others_through(spark, monkeypatch):
    keys = save(spark.range(0, 3000, 3).select(F.col("id").cast("string").alias("key")))
    rows = spark.range(3000).select(F.col("id").cast("string").alias("key"))
    some = may_be_in(rows, key_filter(keys, ["key"]), ["key"])
    got = {int(r["key"]) for r in some.collect()}
    assert set(range(0, 3000, 3)) <= got and len(got) < 1300 and some.columns == ["key"]
    monkeypatch.setattr(bitmaps, "BROADCAST_WORDS", 1)
    assert key_filter(keys, ["key"]) is None and may_be_in(rows, None, ["key"]).count() == 3000


# ---- a key in very many files ---------------------------------------------------------------------------


def many_files(spark, n_files):
    """One key in every file, and a key of its own in each."""
    name = F.concat(F.lit("f"), F.lpad((F.col("id") % n_files).cast("string"), 6, "0"))
    return spark.range(0, 2 * n_files, 1, 8).select(
        F.when(F.col("id") < n_files, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key"),
        name.alias("path"), name.alias("file"), F.lit(0).cast("long").alias("block"), F.col("id").alias("pos"),
        F.lit("p").alias("prefix"), F.lit("l").alias("line"),
    )


def test_a_key_in_200_000_files_is_the_work_of_many_tasks(spark, conf):
    conf(
        autoBroadcastJoinThreshold="-1", adaptive__autoBroadcastJoinThreshold="-1", adaptive__coalescePartitions__enabled="false",
        shuffle__partitions="40", adaptive__skewJoin__skewedPartitionThresholdInBytes="100k", adaptive__advisoryPartitionSizeInBytes="100k",
    )
    n = 200_000
    rows = many_files(spark, n)
    configure(spark)
    found = key_files(rows)
    sizes = save(found.withColumn("task", F.spark_partition_id())).groupBy("task").count().collect()
    assert sum(r["count"] for r in sizes) == n and max(r["count"] for r in sizes) < n / 8
    assert "Window" not in plan(found)
    counts = save(rows.groupBy("key", "path", "file").agg(F.count("*").alias("n")))
    totals = save(counts.groupBy("key").agg(F.count("*").alias("n_files")).filter("n_files > 1"))
    lists = file_lists(counts, totals, rows_per_salt=2_000)
    assert not re.search(r"Window \[.*key", plan(lists))
    sizes = lists.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < n / 8
    wrong = lists.filter(F.col("place") != F.substring("file", 2, 6).cast("long") + 1)
    assert lists.count() == n and wrong.count() == 0


def test_surplus_by_other_places(spark):
    rows = text_rows(spark, 6)
    found = save(key_files(rows))
    assert tuples(surplus_rows(rows, found), "path", "pos") == tuples(surplus_rows(rows, found, places=["pos", "path"]), "path", "pos")
