"""Changed files, scans in parts, the stored report, and the state that files are added to."""

import os
import re
import sys
import time

import pytest
from pyspark.sql import functions as F

from samerow import Options, clean, find_duplicates
from samerow.operators import bitmaps, index_blocks, number_report
from samerow.plans import jobs
from samerow.plans.state import KeyState
from samerow.session import LISTING_TASKS, save
from samerow.sources import changed_files, keyed, line_scans, list_inputs, mark_headers, read_lines, rewrite, snapshot, write_report
from samerow.sources import files as text_files
from tests.test_files import put, report_of, written

FILES = {f"{c}.csv": "h\n" + "".join(f"{k % 13};x;{c}{k}\n" for k in range(i, 40 + i)) for i, c in enumerate("abcde")}
ONE = Options(n_fields=1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- files that change ----------------------------------------------------------------------------------


def test_changed_files_are_found(spark, tmp_path):
    put(tmp_path, **FILES)
    before = snapshot(spark, str(tmp_path))
    assert changed_files(spark, before, str(tmp_path)).count() == 0
    (tmp_path / "a.csv").write_text("h\n")  # another size
    os.utime(tmp_path / "b.csv", (1, 1))  # another time
    (tmp_path / "c.csv").unlink()
    (tmp_path / "new.csv").write_text("h\nk\n")
    changed = [os.path.basename(r["path"]) for r in changed_files(spark, before, str(tmp_path)).collect()]
    assert sorted(changed) == ["a.csv", "b.csv", "c.csv"]


@pytest.mark.parametrize("when", ["between", "at the end"])
def test_a_file_that_changes_fails_the_job(spark, tmp_path, monkeypatch, when):
    put(tmp_path / "in", **FILES)

    def touching(step):
        def run(*args, **options):
            out = step(*args, **options)
            with open(tmp_path / "in" / "b.csv", "a") as f:
                f.write("late\n")
            return out

        return run

    name = "surplus_rows" if when == "between" else "rewrite"
    monkeypatch.setattr(jobs, name, touching(getattr(jobs, name)))
    with pytest.raises(RuntimeError, match="b.csv was changed"):
        clean(spark, str(tmp_path / "in"), str(tmp_path / "out"), options=ONE)
    assert not (tmp_path / "out").exists()
    monkeypatch.undo()
    monkeypatch.setattr(jobs, "key_summary", touching(jobs.key_summary))
    with pytest.raises(RuntimeError, match="b.csv was changed"):
        find_duplicates(spark, str(tmp_path / "in"), ONE)


# ---- scans in parts and surplus bitmaps -----------------------------------------------------------------


def test_scans_in_parts_are_the_whole(spark, tmp_path):
    put(tmp_path / "in", **FILES, **{"name with 100%+ü [x].csv": "h\nq;1\n", "empty.csv": ""})
    whole = read_lines(spark, str(tmp_path / "in"))
    parts = line_scans(spark, str(tmp_path / "in"), scan_bytes=600)
    assert len(parts) > 2
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    values = lambda df: sorted(map(tuple, df.select("path", "file", "block", "value").collect()))
    assert values(union) == values(whole)
    positions = {(r["path"], r["block"], r["value"]): r["pos"] for r in union.collect()}
    assert len(set(positions.values())) == union.count()
    for i, p in enumerate(parts):
        assert {positions[r["path"], r["block"], r["value"]] == r["pos"] and r["scan"] == i for r in p.collect()} == {True}
        # A filter on the number of the scan leaves no other file to read.
        alone = plan(union.filter(F.col("scan") == i))
        assert alone.count("FileScan text") == 1


@pytest.mark.parametrize("limit", [1, 4_000_000])
@pytest.mark.parametrize("scan_bytes", [300, 1 << 30])
def test_clean_in_parts_and_rounds(spark, tmp_path, conf, monkeypatch, limit, scan_bytes):
    conf(autoBroadcastJoinThreshold="-1", adaptive__autoBroadcastJoinThreshold="-1", files__maxPartitionBytes="200", files__openCostInBytes="0", files__minPartitionNum="1")
    put(tmp_path / "in", **FILES)
    with clean(spark, str(tmp_path / "in"), str(tmp_path / "plain"), options=ONE):
        pass
    monkeypatch.setattr(bitmaps, "BROADCAST_WORDS", limit)
    monkeypatch.setattr(text_files, "SCAN_BYTES", scan_bytes)
    monkeypatch.setattr(jobs, "line_scans", lambda *a: line_scans(*a, scan_bytes=scan_bytes))
    with clean(spark, str(tmp_path / "in"), str(tmp_path / "out"), options=ONE):
        pass
    lines = FILES["a.csv"].splitlines(keepends=True)
    assert written(tmp_path / "out") == written(tmp_path / "plain")
    assert written(tmp_path / "out")["a.csv"] == "".join(lines[:14]) and written(tmp_path / "out")["e.csv"] == "h\n"


def test_rows_that_stay_are_not_shuffled(spark, tmp_path, conf, monkeypatch):
    """Whatever the surplus, the job that writes has no exchange but that of the bitmap."""
    from pyspark.sql import DataFrameWriter

    conf(autoBroadcastJoinThreshold="-1", adaptive__autoBroadcastJoinThreshold="-1")
    put(tmp_path / "in", **FILES)
    lines = read_lines(spark, str(tmp_path / "in"))
    plans = []
    text = DataFrameWriter.text
    monkeypatch.setattr(DataFrameWriter, "text", lambda self, *a, **o: (plans.append(plan(self._df)), text(self, *a, **o)))
    rewrite(lines, str(tmp_path / "out"), surplus=save(lines.filter("value not like 'h%'").select("pos")))
    assert len(plans) == 1 and "BroadcastHashJoin" in plans[0]
    assert not re.search(r"Exchange (hash|range|Round)", plans[0])
    assert set(written(tmp_path / "out").values()) == {"h\n"}


# ---- the report, sorted once ----------------------------------------------------------------------------


@pytest.mark.parametrize("split", ["300", "134217728"])
def test_a_numbered_report_is_written_as_it_is_stored(spark, tmp_path, conf, split):
    conf(files__maxPartitionBytes=split, files__openCostInBytes="0")
    put(tmp_path / "in", **FILES)
    with find_duplicates(spark, str(tmp_path / "in"), ONE) as found:
        numbered = number_report(found.text)
        text = report_of(found.text, tmp_path / "sorted")
        ordered = numbered.sortWithinPartitions("line_no")
        assert not re.search(r"Exchange (range|hash)", plan(ordered))
        write_report(numbered, str(tmp_path / "stored"))
    parts = sorted((tmp_path / "stored").glob("part=*/offset=*/part-*"), key=lambda p: (p.parent.parent.name, p.parent.name, p.name))
    assert "".join(p.read_text() for p in parts) == text and text.count("\n") > 13
    assert [r["text"] for r in numbered.orderBy("line_no").collect()] == text.splitlines()


# ---- files added over time ------------------------------------------------------------------------------


def report(spark, folder, text):
    return report_of(text, folder)


def test_files_added_over_time_give_the_full_report(spark, tmp_path):
    names = sorted(FILES)
    state = KeyState(spark, str(tmp_path / "state"), ONE, buckets=4)
    added = []
    for i, upto in enumerate((2, 2, 4, 5)):
        put(tmp_path / "in", **{n: FILES[n] for n in names[:upto]})
        for n in added:
            os.utime(tmp_path / "in" / n, (1000, 1000))
        for n in names[:upto]:
            os.utime(tmp_path / "in" / n, (1000, 1000))
        assert state.add(str(tmp_path / "in")) == upto - len(added)
        added = names[:upto]
        with find_duplicates(spark, str(tmp_path / "in"), ONE) as found:
            full = report(spark, tmp_path / f"full{i}", found.text)
        assert report(spark, tmp_path / f"state{i}", state.report()) == full
    again = KeyState(spark, str(tmp_path / "state"), ONE, buckets=4)
    assert again.files().count() == 5 and report(spark, tmp_path / "again", again.report()) == full
    state.close()


def test_the_state_is_read_without_the_files_and_without_a_shuffle(spark, tmp_path, conf):
    conf(autoBroadcastJoinThreshold="-1", adaptive__autoBroadcastJoinThreshold="-1")
    put(tmp_path / "in", **FILES)
    state = KeyState(spark, str(tmp_path / "state"), ONE, buckets=4)
    state.add(str(tmp_path / "in"))
    text = plan(state.entries())
    assert "Exchange hashpartitioning" not in text.split("BroadcastExchange")[0] and "Bucketed: true" in text
    assert "FileScan text" not in text and "FileScan parquet" in text
    state.close()


def test_only_new_files_are_read(spark, tmp_path, monkeypatch):
    put(tmp_path / "in", **{"a.csv": FILES["a.csv"], "b.csv": FILES["b.csv"]})
    state = KeyState(spark, str(tmp_path / "state"), ONE, buckets=4)
    assert state.add(str(tmp_path / "in")) == 2
    put(tmp_path / "in", **{"c.csv": FILES["c.csv"]})
    read = []
    from samerow.plans import state as module

    real = module.scans_of
    monkeypatch.setattr(module, "scans_of", lambda *a: [read.extend(x.inputFiles()) or x for x in real(*a)])
    assert state.add(str(tmp_path / "in")) == 1 and [os.path.basename(x) for x in read] == ["c.csv"]
    assert state.add(str(tmp_path / "in")) == 0
    time.sleep(0.01)
    (tmp_path / "in" / "a.csv").write_text("h\nother;1\n")
    with pytest.raises(RuntimeError, match="a.csv was changed"):
        state.add(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="begun with"):
        KeyState(spark, str(tmp_path / "state"), Options(n_fields=2), buckets=4)
    state.close()


def test_a_batch_that_failed_does_not_count(spark, tmp_path, monkeypatch):
    put(tmp_path / "in", **{"a.csv": FILES["a.csv"]})
    state = KeyState(spark, str(tmp_path / "state"), ONE, buckets=4)
    append = KeyState._append

    def fails(self, counts):
        append(self, counts)
        raise OSError("lost")

    monkeypatch.setattr(KeyState, "_append", fails)
    with pytest.raises(OSError):
        state.add(str(tmp_path / "in"))
    monkeypatch.undo()
    assert state.entries().count() == 0 and state.add(str(tmp_path / "in")) == 1
    assert {(r["n"], r["n_rows"]) for r in state.entries().collect()} <= {(3, 3), (4, 4)}
    state.close()


def test_a_snapshot_is_stored_by_few_tasks(spark, tmp_path, conf):
    put(tmp_path, **{f"f{i}.csv": "h\nk\n" for i in range(100)})
    conf(files__maxPartitionBytes="4")
    stored = snapshot(spark, str(tmp_path))
    assert stored.count() == 100 and len(stored.inputFiles()) <= LISTING_TASKS * spark.sparkContext.defaultParallelism


def test_an_addition_lists_its_folder_twice(spark, tmp_path, monkeypatch):
    put(tmp_path / "in", **FILES)
    seen = []

    def listing(*args):
        seen.append(args)
        return matching(*args)

    matching = text_files.matching_files
    for module in (text_files, sys.modules["samerow.sources.snapshot"]):  # the package has a function of that name
        monkeypatch.setattr(module, "matching_files", listing)
    state = KeyState(spark, str(tmp_path / "state"), ONE, buckets=2)
    assert state.add(str(tmp_path / "in")) == len(FILES)
    assert len(seen) == 2
    assert state.add(str(tmp_path / "in")) == 0
    assert len(seen) == 4
    state.close()
