"""Random small inputs against the plain model, with every join strategy."""

import random

import pytest
from pyspark.sql import functions as F

from samerow.operators import (
    avg_line_length,
    classify,
    count_by_file,
    count_keys,
    cross_prefixes,
    dedupe_all,
    dedupe_cross_only,
    dedupe_within,
    deletion_candidates,
    deletion_stats,
    deletion_totals,
    distinct_prefixes,
    dup_summary,
    duplicate_rows,
    duplicates,
    file_lists,
    keep_file,
    key_files,
    key_summary,
    line_numbers,
    remove_rows,
    render_report,
    report_entries,
    row_fate,
    rows_by_prefix,
    surplus_rows,
    unlisted_files,
    within_surplus,
)
from samerow.operators import skew
from samerow.operators.skew import join_on_key
from samerow.session import save
from samerow.sources import chunked, rows_from_lines, rows_from_table
from tests import model


def random_files(seed, n_files=6, hot=0.0):
    rng = random.Random(seed)
    keys = ["", "k0", "k1", "k1 ", "K1", "é", "long" * 12] + [f"u{i}" for i in range(30)]
    files = {}
    for f in range(n_files):
        lines = []
        for _ in range(rng.randint(0, 40)):
            key = "hot" if rng.random() < hot else rng.choice(keys)
            lines.append(rng.choice(["", " ", "\t"]) + rng.choice(["", f"{key};{rng.randint(0, 1)};tail{rng.random()}"]))
        files[f"f{rng.randint(0, 99)}-{f}"] = lines
    return files


def as_rows(spark, files, n=2, prefix_len=47):
    data = [(f, f, 0, i, v) for f, lines in files.items() for i, v in enumerate(lines)]
    lines = spark.createDataFrame(data, "path string, file string, block long, pos long, value string")
    return rows_from_lines(lines.repartition(5), ";", n, prefix_len)


def tuples(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.fixture(params=["broadcast", "shuffle", "salted"])
def strategy(request, conf):
    """Join by broadcast, by shuffle, and with repeated keys split by salts."""
    if request.param != "broadcast":
        conf(autoBroadcastJoinThreshold="-1", adaptive__autoBroadcastJoinThreshold="-1")
    return 1 if request.param == "salted" else 1_000_000


@pytest.mark.parametrize("seed", [1, 2])
def test_report_fates_and_survivors(spark, strategy, seed):
    files = random_files(seed, hot=0.35)
    expected = model.keyed(files, n=2, header=False)
    rows = as_rows(spark, files)
    found = save(key_files(rows))
    summary = save(key_summary(found, rows))

    entries = save(report_entries(found, summary, strategy))
    wanted = model.entries(expected)
    assert sorted(tuples(entries, "prefix", "key", "scope", "n_rows", "file", "n")) == sorted(wanted)
    firsts = entries.groupBy("key").agg(F.count_if("is_first").alias("c"))
    assert {c for (c,) in tuples(firsts, "c")} == {1}

    fate = model.fates(expected)
    got = tuples(row_fate(rows, summary, strategy), "file", "pos", "fate")
    assert sorted(got) == sorted((f, i, v) for (f, i), v in fate.items())
    kept = sorted(k for k, v in fate.items() if v == "kept")
    assert sorted(tuples(dedupe_all(rows), "file", "pos")) == kept
    assert len(kept) == len({r[3] for r in expected})

    not_cross = sorted(k for k, v in fate.items() if v != "cross_deleted")
    assert sorted(tuples(dedupe_cross_only(rows, summary, strategy), "file", "pos")) == not_cross

    first_in_file = {}
    for f, i, _, key in expected:
        first_in_file.setdefault((f, key), (f, i))
    assert sorted(tuples(dedupe_within(rows), "file", "pos")) == sorted(first_in_file.values())

    for mode, stay in (("all", kept), ("cross", not_cross), ("within", sorted(first_in_file.values()))):
        gone = tuples(surplus_rows(rows, found, mode, strategy), "path", "pos")
        assert sorted(gone) == sorted({(f, i) for f, i, _, _ in expected} - set(stay))

    # Deleting once more changes nothing.
    again = dedupe_all(dedupe_all(rows))
    assert sorted(tuples(again, "file", "pos")) == kept

    in_dups = sorted((f, i) for f, i, _, k in expected if k in {e[1] for e in wanted})
    assert sorted(tuples(duplicate_rows(rows, summary, strategy), "file", "pos")) == in_dups
    crossing = {e[1] for e in wanted if e[2] == "cross"}
    totals = save(duplicates(count_keys(count_by_file(rows))))
    got = tuples(deletion_candidates(rows, totals, strategy), "file", "pos")
    assert sorted(got) == sorted((f, i) for f, i, _, k in expected if k in crossing)

    prefixes = {e[0] for e in wanted if e[2] == "cross"}
    got = tuples(rows_by_prefix(rows, save(cross_prefixes(entries)), strategy), "file", "pos")
    assert sorted(got) == sorted((f, i) for f, i, line, _ in expected if line[:47] in prefixes)

    gone = row_fate(rows, summary, strategy).filter(F.col("fate") == "cross_deleted").select("path", "line")
    listed = {(f, line) for f, i, line, _ in expected if fate[f, i] == "cross_deleted"}
    got = tuples(remove_rows(rows, gone, strategy), "file", "pos")
    assert sorted(got) == sorted((f, i) for f, i, line, _ in expected if (f, line) not in listed)

    text = render_report(entries).orderBy("prefix", "key", "seq", "file")
    assert [t for (t,) in tuples(text, "text")] == model.report(wanted)

    lost = {}
    for (f, _), v in fate.items():
        lost.setdefault(f, [0, 0])
        if v != "kept":
            lost[f][v == "within_deleted"] += 1
    stats = deletion_stats(entries)
    got = {f: [c, w] for f, c, w in tuples(stats, "file", "n_cross_deleted", "n_within_deleted")}
    assert got == {f: lost[f] for f in got}
    assert all(v == [0, 0] for f, v in lost.items() if f not in got)
    (total,) = deletion_totals(stats).collect()
    assert total["n_deleted"] == sum(map(sum, lost.values()))
    assert total["n_cross_files"] == sum(1 for v in lost.values() if v[0])


@pytest.mark.parametrize("seed", [5])
def test_counts(spark, seed):
    files = random_files(seed)
    expected = model.keyed(files, n=2, header=False)
    rows = as_rows(spark, files)
    counts = count_by_file(rows)
    per_file = {}
    for f, _, _, key in expected:
        per_file[key, f] = per_file.get((key, f), 0) + 1
    assert sorted(tuples(counts, "key", "file", "n")) == sorted((*k, n) for k, n in per_file.items())
    totals = count_keys(counts)
    found = {e[1]: e[2] for e in model.entries(expected)}
    assert dict(tuples(classify(duplicates(totals)), "key", "scope")) == found
    crossing = sorted(k for k, s in found.items() if s == "cross")
    assert sorted(k for (k,) in tuples(duplicates(totals, scope="cross"), "key")) == crossing
    assert tuples(dup_summary(totals), "n_keys", "n_cross_keys") == [(len(found), len(crossing))]
    surplus = dict(tuples(within_surplus(counts), "file", "surplus"))
    assert surplus == {
        f: sum(n - 1 for (_, g), n in per_file.items() if g == f) for f in {f for _, f in per_file}
    }
    smallest = {key: min(f for k, f in per_file if k == key) for key, _ in per_file}
    assert dict(tuples(keep_file(counts), "key", "keep_file")) == smallest
    assert {k for (k,) in tuples(duplicates(totals, min_rows=3), "key")} == {
        k for k in found if sum(n for (j, _), n in per_file.items() if j == k) >= 3
    }


def test_prefix_shared_by_two_keys(spark):
    files = {"a": ["same;1;x", "same;1;y", "same;2;x"], "b": ["same;2;z", "other;1;q"]}
    rows = as_rows(spark, files, prefix_len=4)
    found = save(key_files(rows))
    entries = save(report_entries(found, save(key_summary(found, rows))))
    assert entries.select("key").distinct().count() == 2
    assert sorted(tuples(distinct_prefixes(entries), "prefix", "file")) == [("same", "a"), ("same", "b")]


def test_file_lists_are_in_order_of_names(spark):
    files = {f"f{i:02}": ["everywhere;1;x", f"own{i};1;x", "everywhere;1;y"] for i in range(40)}
    rows = as_rows(spark, files)
    counts = save(count_by_file(rows))
    totals = save(duplicates(count_keys(counts)))
    for rows_per_salt in (1_000_000, 10):
        listed = file_lists(counts, totals, rows_per_salt)
        expected = [("everywhere;1", i + 1, f, 2) for i, f in enumerate(sorted(files))]
        assert sorted(tuples(listed, "key", "place", "file", "n")) == expected


def test_join_splits_a_hot_key(spark, conf):
    conf(autoBroadcastJoinThreshold="-1", adaptive__enabled="false")
    data = [("f", "f", 0, i, "hot" if i % 3 == 0 else f"k{i}") for i in range(30_000)]
    rows = spark.createDataFrame(data, "path string, file string, block long, pos long, key string")
    keys = save(rows.groupBy("key").agg(F.count("*").alias("n_rows")))

    def largest_task(rows_per_salt):
        joined = join_on_key(rows, keys, "inner", rows_per_salt=rows_per_salt)
        assert joined.count() == 30_000
        sizes = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
        return max(r["count"] for r in sizes)

    assert largest_task(1_000_000) > 10_000
    assert largest_task(500) < 6_000


def test_any_number_of_hot_keys_is_split(spark, conf):
    conf(autoBroadcastJoinThreshold="-1", adaptive__enabled="false")
    rows = spark.range(0, 60_000, 1, 4).selectExpr(
        "'f' as path", "'f' as file", "0L as block", "id as pos", "concat('k', id % 1500) as key"
    )
    keys = save(rows.groupBy("key").agg(F.count("*").alias("n_rows")))
    joined = join_on_key(rows, keys, "inner", rows_per_salt=5)
    assert joined.count() == 60_000
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(sizes) < 1.5 * min(sizes)


def test_keys_of_one_hash_are_told_apart(spark, conf, monkeypatch):
    """Also if all keys had the same hash, they are compared as keys."""
    from samerow.operators import entries

    conf(autoBroadcastJoinThreshold="-1", adaptive__autoBroadcastJoinThreshold="-1")
    same = lambda *key: F.lit(7).cast("long").alias("key_hash")
    for module in (skew, entries):
        monkeypatch.setattr(module, "key_hash", same)
    files = random_files(9, hot=0.3)
    expected = model.keyed(files, n=2, header=False)
    rows = as_rows(spark, files)
    summary = save(key_summary(save(key_files(rows)), rows))
    for rows_per_salt in (1, 1_000_000):
        got = tuples(row_fate(rows, summary, rows_per_salt), "file", "pos", "fate")
        assert sorted(got) == sorted((f, i, v) for (f, i), v in model.fates(expected).items())


def test_table_keys(spark):
    data = [(1, "a", "x;y", "z"), (2, "a", "x", "y;z"), (3, "b", "x;y", "z"), (4, "b", None, "z"), (5, "b", None, "z")]
    df = spark.createDataFrame(data, "id long, src string, k1 string, k2 string")
    rows = rows_from_table(df, F.col("src"), F.col("id"), ["k1", "k2"], F.concat_ws(";", "k1", "k2"))
    found = tuples(duplicates(count_keys(count_by_file(rows))), "key.k1", "key.k2", "n_files", "n_rows")
    assert found == [("x;y", "z", 2, 2)]


def test_line_numbers_and_sample_in_a_big_file(spark):
    data = [("big" if i % 10 else f"small{i % 3}", i, " x" * (i % 7)) for i in range(3000)]
    df = spark.createDataFrame(data, "path string, i long, value string").withColumn("file", F.col("path"))
    lines = chunked(df.repartition(7), "i")
    assert lines.filter(F.col("path") == "big").select("block").distinct().count() > 3
    expected, counter, sample = {}, {}, {}
    for path, i, value in data:
        counter[path] = counter.get(path, 0) + 1
        expected[path, i] = counter[path]
        if value.strip():
            sample.setdefault(path, []).append(len(value.strip()))
    got = {(p, i): n for p, i, n in tuples(line_numbers(lines), "path", "i", "line_no")}
    assert got == expected
    files = spark.createDataFrame([(p, p) for p in [*counter, "none"]], "path string, file string")
    for limit in (1, 50, 700, None):
        means = dict(tuples(avg_line_length(lines, files, limit), "file", "avg_len"))
        want = {p: sum(v[:limit]) / len(v[:limit]) for p, v in sample.items()}
        assert means == pytest.approx({**want, "none": 150.0})


def test_unlisted_files(spark):
    files = {"a": ["k;1;x", "k;1;y", "k;1;z"], "b": ["m;1;x"], "c": ["m;1;x", "n;1", "n;1"]}
    rows = as_rows(spark, files)
    found = save(key_files(rows))
    entries = save(report_entries(found, save(key_summary(found, rows))))
    cross = entries.filter(F.col("scope") == "cross")
    stats = deletion_stats(entries)
    assert tuples(unlisted_files(cross, stats), "prefix", "shown") == [
        ("(Within-file duplicates only - a)", "a -> Deleted 2 rows")
    ]
    assert unlisted_files(entries, stats).count() == 0
