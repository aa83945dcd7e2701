"""Every registered query against its SQL on the smallest tables, and the plans behind the main ones."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry_points
from samerow.plans import oracle, queries as registry

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()
SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(registry.queries()) == set(oracle.oracle_sql())
    assert set(registry.queries()) <= set(entry_points.queries())
    assert set(oracle.oracle_sql()) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cursor = duck.execute(oracle.oracle_sql()[name])
    types = {d[0]: str(d[1]) for d in cursor.description}
    assert {f.name: SQL_TYPES[f.dataType.simpleString()] for f in df.schema} == types
    columns = sorted(types)
    place = [list(types).index(c) for c in columns]
    expected = sorted((tuple(row[i] for i in place) for row in cursor.fetchall()), key=repr)
    assert sorted((tuple(row[c] for c in columns) for row in df.collect()), key=repr) == expected
    assert expected


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["prefix", "key", "scope", "n_rows", "file", "n"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_no_python_and_no_cross_join(spark, name):
    text = plan(registry.queries()[name](spark, SF))
    assert not re.search("Python|Arrow|CartesianProduct|NestedLoop", text)


@pytest.mark.parametrize("name", ["dedupe_all", "dedupe_within"])
def test_groups_are_limited_before_the_shuffle(spark, name):
    text = plan(registry.queries()[name](spark, SF))
    assert text.count("Exchange hashpartitioning") == 1
    assert re.search(r"Final.*Exchange.*Partial", text, re.DOTALL)


@pytest.mark.parametrize("name, shuffles", [("key_file_counts_lineitem", 1), ("key_totals_lineitem", 2)])
def test_counting_is_combined_in_the_scan_tasks(spark, name, shuffles):
    text = plan(registry.queries()[name](spark, SF))
    assert text.count("Exchange") == shuffles
    assert "SortAggregate" not in text and "partial_count" in text
    (schema,) = re.findall("ReadSchema: (.*)", text)
    assert "l_quantity" not in schema and "l_shipdate" not in schema


def test_rows_join_the_stored_duplicates_without_a_hint(spark, conf):
    queries = registry.queries()
    small = plan(queries["row_fate"](spark, SF))
    # Rows stay where they are; what is shuffled are the hashes of hot keys.
    assert "BroadcastHashJoin" in small and "SortMergeJoin" not in small
    assert set(re.findall(r"Exchange hashpartitioning\((\w+)#", small)) == {"key_hash"}
    conf(autoBroadcastJoinThreshold="1000")
    assert "SortMergeJoin" in plan(queries["row_fate"](spark, SF))


def test_a_hot_key_is_combined_before_the_shuffle(spark, capsys):
    """A key on a third of all rows reaches the shuffle as one row per scan task and file."""
    from pyspark.sql import functions as F

    from samerow.operators import key_files

    n, tasks = 60_000, 6
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 5))
    rows = spark.range(0, n, 1, tasks).select(
        key.alias("key"),
        F.lit("f").alias("path"),
        F.lit("f").alias("file"),
        F.lit(0).cast("long").alias("block"),
        F.col("id").alias("pos"),
        key.alias("prefix"),
    )
    found = key_files(rows)
    hot = found.filter("key = 'hot'").collect()
    assert [(r["n"], r["n_rows"], r["n_files"], r["pos"]) for r in hot] == [(n // 3, n // 3, 1, 0)]
    found.collect()
    found.explain("formatted")
    final = capsys.readouterr().out.split("Initial Plan")[0]
    # Rows are counted by hash; what is sorted afterwards are the counts.
    made, _ = final.split("ReusedExchange", 1)  # the counts are made once
    tree = made[: made.index("Range")]
    below = tree[tree.rindex("- Exchange") :]
    assert "HashAggregate" in below and "SortAggregate" not in below
    shuffled = re.findall(r"ShuffleQueryStage.*rowCount=([\d.E+]+)", final)
    assert shuffled and max(map(float, shuffled)) <= 6 * tasks


@pytest.mark.parametrize("name", ["dup_report", "keep_file", "key_file_counts"])
def test_no_row_is_sorted_to_be_counted(spark, name):
    from samerow.operators import key_files
    from samerow.plans.queries import document_rows

    text = plan(key_files(document_rows(spark, SF)) if name == "dup_report" else registry.queries()[name](spark, SF))
    below = text[text.rindex("Exchange hashpartitioning") :]
    assert "HashAggregate" in below and "Sort" not in below


def _scans(text, of):
    return len(re.findall(rf"Scan {of}", text))


@pytest.mark.parametrize("name", ["row_fate", "remove_rows", "duplicate_rows"])
def test_rows_are_evaluated_once_in_a_join(spark, conf, name):
    conf(autoBroadcastJoinThreshold="-1", adaptive__autoBroadcastJoinThreshold="-1")
    text = plan(registry.queries()[name](spark, SF))
    assert text.count("posexplode") == 1


@pytest.mark.parametrize("name", ["skip_header", "skip_header_rows", "read_lines"])
def test_lines_are_not_moved_for_headers_and_numbers(spark, conf, name):
    conf(autoBroadcastJoinThreshold="-1", adaptive__autoBroadcastJoinThreshold="-1")
    text = plan(registry.queries()[name](spark, SF))
    assert "Exchange hashpartitioning" not in text and "SortMergeJoin" not in text
