"""Text files on disk: the edge cases of scanning, and both jobs."""

import random
import re
import threading
from pathlib import Path
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from samerow import Options, clean, find_duplicates
from samerow.operators import HUNGARIAN, index_blocks, line_counts, line_numbers, numbering, run_summary
from samerow.plans import queries as registry
from samerow.session import pack_small_files, shared_folder
from samerow.sources import LINE_SUFFIXES, WITHOUT_CHECKSUMS, keyed, list_inputs, mark_headers, read_lines, read_rewritten, rewrite, write_report
from samerow.sources import files as text_files
from tests import model


def put(folder: Path, **files):
    for name, content in files.items():
        target = folder / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content if isinstance(content, bytes) else content.encode())


def python_lines(path: Path):
    """Lines as the text mode of Python gives them, without their ends."""
    with path.open(encoding="utf-8", errors="ignore") as f:
        return [line[:-1] if line.endswith("\n") else line for line in f]


def ordered(lines, *columns):
    return [tuple(r) for r in lines.orderBy("path", "block", "pos").select(*columns).collect()]


def marked_lines(lines, **options):
    return mark_headers(lines, index_blocks(lines), **options)


def written(folder: Path):
    """Text of every source, its blocks put together in name order."""
    parts = {}
    for p in sorted(folder.glob("source=*/block=*/part-*")):
        source = unquote(p.parent.parent.name[len("source=") :])
        parts[source] = parts.get(source, "") + p.read_text(encoding="utf-8")
    return parts


EDGE = {
    "blank_header.csv": b"\nq;1\r\nq;2\rq;3\n\n \t\nlast",
    "header_only.csv": b"h;h\n",
    "empty.csv": b"",
    "bad_utf8.csv": b"head\nab\xff\xfec;z\n\xef\xbf\xbd\xc3;y\n\xc2\xa0\xe3\x80\x80pad;1\x1f\n\xe2\x80\xa8x\xc2\x85y\n",
    "tabs.csv": "h\na\tb;c\n",
    "long.csv": "h\n" + "é\U0001f600" * 40 + ";x\n",
    "name with 100%+ü.csv": "h\nk;1\nk;1\n",
}


def test_lines_are_those_python_reads(spark, tmp_path):
    put(tmp_path, **EDGE)
    lines = marked_lines(read_lines(spark, str(tmp_path)))
    got = {}
    for name, value, line, header, blank in ordered(lines, "file", "value", "line", "is_header", "is_blank"):
        got.setdefault(name, []).append(value)
        assert line == value.strip()
        assert blank == (not value.strip())
        assert header == (len(got[name]) == 1)
    assert got == {n: python_lines(tmp_path / n) for n in EDGE if EDGE[n]}


def test_listing_and_patterns(spark, tmp_path):
    put(tmp_path, **EDGE)
    put(tmp_path, **{"E.CSV": "h\nx\n", "n.txt": "h\nx\n", "o.TXT": "h\nx\n", ".hid.log": "h\nx\n", "sub/a.csv": "h\nx\n"})
    files = {r["file"]: r["size"] for r in list_inputs(spark, str(tmp_path)).collect()}
    assert files == {n: len(c if isinstance(c, bytes) else c.encode()) for n, c in EDGE.items()}
    names = lambda df: {r["file"] for r in df.select("file").distinct().collect()}
    every = set(files) - {"empty.csv"}
    assert names(read_lines(spark, str(tmp_path))) == every
    assert names(read_lines(spark, str(tmp_path), recursive=True)) == every | {"a.csv"}
    assert names(read_lines(spark, str(tmp_path), LINE_SUFFIXES)) == every | {"E.CSV", "n.txt", "o.TXT"}
    assert names(read_lines(spark, str(tmp_path), "*_utf8*")) == {"bad_utf8.csv"}
    assert read_lines(spark, str(tmp_path), "*.none").count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_lines(spark, str(tmp_path / "missing")).count()


def test_line_counts_and_lines_of_empty_files(spark, tmp_path):
    put(tmp_path, **EDGE)
    counts = line_counts(index_blocks(read_lines(spark, str(tmp_path))), list_inputs(spark, str(tmp_path)))
    got = {r["file"]: r["n_lines"] for r in counts.collect()}
    assert got == {n: max(len(python_lines(tmp_path / n)) - 1, 0) for n in EDGE}


def test_headers_without_broadcast_by_size(spark, tmp_path, conf):
    conf(autoBroadcastJoinThreshold="-1", adaptive__autoBroadcastJoinThreshold="-1")
    put(tmp_path, **EDGE)
    headers = marked_lines(read_lines(spark, str(tmp_path))).filter("is_header").select("file", "value").collect()
    assert {tuple(h) for h in headers} == {(n, python_lines(tmp_path / n)[0]) for n in EDGE if EDGE[n]}


LAID_OUT = {"top.csv": "h\nk\nk\n", "year=2024/a.csv": "h\nk\n", "year=2024/b.csv": "h\nm\n"}


@pytest.mark.parametrize("recursive", [False, True])
def test_no_file_is_lost_beside_folders_of_partitions(spark, tmp_path, recursive):
    put(tmp_path / "in", **LAID_OUT)
    wanted = {n: t for n, t in LAID_OUT.items() if recursive or "/" not in n}
    folder = str(tmp_path / "in")
    lines = read_lines(spark, folder, recursive=recursive)
    assert lines.count() == sum(t.count("\n") for t in wanted.values())
    assert {r["file"] for r in list_inputs(spark, folder, recursive=recursive).collect()} == {Path(n).name for n in wanted}
    with find_duplicates(spark, folder, Options(recursive=recursive)) as found:
        assert [r["n_rows"] for r in found.summary.collect()] == [3 if recursive else 2]
    with clean(spark, folder, str(tmp_path / "out"), options=Options(recursive=recursive)) as result:
        (total,) = result.summary.collect()
        assert total["n_before"] == sum(t.count("\n") - 1 for t in wanted.values())
    assert written(tmp_path / "out") == ({"top.csv": "h\n", "year=2024/a.csv": "h\nk\n", "year=2024/b.csv": "h\nm\n"} if recursive else {"top.csv": "h\nk\n"})


def test_only_folders_of_partitions(spark, tmp_path):
    put(tmp_path, **{"year=2024/a.csv": "h\nk\n"})
    assert read_lines(spark, str(tmp_path)).count() == 0
    assert list_inputs(spark, str(tmp_path)).count() == 0


def test_folder_names_are_literal_and_patterns_may_name_folders(spark, tmp_path):
    put(tmp_path / "in[3]{a,b}", **{"a.csv": "h\n", "sub/b.csv": "h\n", "sub/c1.csv": "h\n", "2024/d1.csv": "h\n", "x.csv/e.csv": "h\n"})
    folder = str(tmp_path / "in[3]{a,b}")
    names = lambda *a, **k: sorted(r["file"] for r in read_lines(spark, folder, *a, **k).select("file").distinct().collect())
    assert names() == ["a.csv"]
    assert names("sub/*.csv") == ["b.csv", "c1.csv"]
    assert names("*/?1.csv") == ["c1.csv", "d1.csv"]
    assert names("**/*.csv") == names(recursive=True) == ["a.csv", "b.csv", "c1.csv", "d1.csv", "e.csv"]
    with pytest.raises(ValueError, match="file names"):
        names("sub/*.csv", recursive=True)


def test_hidden_files_that_match_are_refused(spark, tmp_path):
    put(tmp_path, **{"a.csv": "h\n", "_b.txt": "h\n", "sub/.c.log": "h\n", "sub/_d.csv": "h\n"})
    assert read_lines(spark, str(tmp_path)).count() == 1
    for pattern, recursive, name in (("*.txt", False, "_b.txt"), ("*.log", True, ".c.log"), ("sub/*.csv", False, "_d.csv")):
        with pytest.raises(ValueError, match=name):
            read_lines(spark, str(tmp_path), pattern, recursive)


def test_jobs_leave_no_tables_and_no_settings(spark, tmp_path, conf):
    put(tmp_path / "in", **{"a.csv": "h\nk\nk\n"})
    shared = Path(shared_folder(spark).removeprefix("file:"))
    stored = set(shared.iterdir())
    options = ("spark.sql.files.minPartitionNum", "spark.sql.adaptive.forceOptimizeSkewedJoin")
    before = {k: spark.conf.get(k, None) for k in options}
    with find_duplicates(spark, str(tmp_path / "in")) as found:
        assert found.entries.count() == 1 and set(shared.iterdir()) > stored
    with clean(spark, str(tmp_path / "in"), str(tmp_path / "out")) as result:
        assert result.summary.count() == 1
    assert set(shared.iterdir()) == stored
    assert before == {k: spark.conf.get(k, None) for k in options}


def test_a_large_surplus_moves_lines_once(spark, tmp_path, conf):
    conf(autoBroadcastJoinThreshold="-1", adaptive__autoBroadcastJoinThreshold="-1", files__maxPartitionBytes="4096", files__openCostInBytes="0", files__minPartitionNum="1")
    lines = ["header"] + [f"{i % 700};x;{i}" for i in range(5000)]
    put(tmp_path / "in", **{"a.csv": "\n".join(lines) + "\n", "b.csv": "\n".join(lines[:300]) + "\n"})
    clean(spark, str(tmp_path / "in"), str(tmp_path / "out"), options=Options(n_fields=1)).close()
    assert written(tmp_path / "out") == {"a.csv": "\n".join(lines[:701]) + "\n", "b.csv": "header\n"}


@pytest.mark.parametrize("split", ["4096", "134217728"])
def test_split_size_changes_nothing(spark, tmp_path, conf, split):
    conf(files__maxPartitionBytes=split, files__openCostInBytes="0", files__minPartitionNum="1")
    rng = random.Random(3)
    big = ["header"] + [f"{rng.randint(0, 9000)};x;{i}" if rng.random() < 0.95 else "" for i in range(30_000)]
    small = ["header"] + [f"{rng.randint(0, 9000)};x;{i}" for i in range(300)]
    files = {"big.csv": big, "small.csv": small}
    put(tmp_path / "in", **{n: "\n".join(v) + "\n" for n, v in files.items()})
    lines = read_lines(spark, str(tmp_path / "in"))
    assert (lines.rdd.getNumPartitions() > 50) == (split == "4096")
    numbered = line_numbers(marked_lines(lines))
    got = numbered.select("file", "line_no", "value", "is_header").collect()
    assert len(got) == sum(map(len, files.values()))
    assert all(files[r["file"]][r["line_no"] - 1] == r["value"] for r in got)
    assert all(r["is_header"] == (r["line_no"] == 1) for r in got)

    fate = model.fates(model.keyed(files, n=1))
    result = clean(spark, str(tmp_path / "in"), str(tmp_path / "out"), options=Options(n_fields=1))
    expected = {n: "".join(v + "\n" for v in lines) for n, lines in model.cleaned(files, fate).items()}
    assert written(tmp_path / "out") == expected
    n_deleted = sum(v != "kept" for v in fate.values())
    (total,) = result.summary.collect()
    assert total.asDict() == {"n_before": 30_300, "n_deleted": n_deleted, "n_after": 30_300 - n_deleted}


JOB = {
    "a.csv": "h\nA;1;x\nA;1;y\nB;1;x\n\nC;1;x\n",
    "b.csv": "h\nB;1;z\nB;1;z\nC;1;other tail\nD;1;x\nD;1;x\n",
    "c.csv": "h\n  D;1;x  \nE;1;x\n",
}
# By hand: A is within a; B, C, D cross. a keeps B, C; b keeps D.
JOB_REPORT = """A;1;x
    - (Within-file duplicates) a.csv
B;1;x
    - a.csv
    - b.csv
C;1;x
    - a.csv
    - b.csv
D;1;x
    - b.csv
    - c.csv
"""
JOB_CLEANED = {
    "a.csv": "h\nA;1;x\nB;1;x\n\nC;1;x\n",
    "b.csv": "h\nD;1;x\n",
    "c.csv": "h\nE;1;x\n",
}
JOB_AFTER = """A;1;x
    - (Within-file duplicates) a.csv -> Deleted 1 rows
B;1;x
    - a.csv
    - b.csv -> Deleted 3 rows
C;1;x
    - a.csv
    - b.csv -> Deleted 3 rows
D;1;x
    - b.csv -> Deleted 3 rows
    - c.csv -> Deleted 1 rows
"""
TWO = Options(n_fields=2)


def report_of(text, folder: Path):
    write_report(text, str(folder))
    return "".join(p.read_text(encoding="utf-8") for p in sorted(folder.glob("part-*")))


def test_report_job(spark, tmp_path):
    put(tmp_path / "in", **JOB)
    found = find_duplicates(spark, str(tmp_path / "in"), TWO)
    assert report_of(found.text, tmp_path / "report") == JOB_REPORT


def test_report_of_keys_in_several_files_only(spark, tmp_path):
    put(tmp_path / "in", **JOB)
    found = find_duplicates(spark, str(tmp_path / "in"), Options(n_fields=2, cross_only=True))
    assert report_of(found.text, tmp_path / "report") == JOB_REPORT.split("a.csv\n", 1)[1]


def test_report_without_duplicates(spark, tmp_path):
    put(tmp_path / "in", **{"a.csv": "h\nA\nB\n", "b.csv": "h\nh\n"})
    for labels, sentence in ((Options().labels, "No duplicates found.\n"), (HUNGARIAN, "Nem található duplikátum.\n")):
        found = find_duplicates(spark, str(tmp_path / "in"), Options(labels=labels))
        assert report_of(found.text, tmp_path / sentence[:3]) == sentence
    none = find_duplicates(spark, str(tmp_path / "in"), Options(pattern="*.none"))
    assert [r["text"] for r in none.text.collect()] == ["No duplicates found."]


def test_clean_job(spark, tmp_path):
    put(tmp_path / "in", **JOB)
    before = {p.name: p.read_bytes() for p in (tmp_path / "in").iterdir()}
    result = clean(spark, str(tmp_path / "in"), str(tmp_path / "out"), options=TWO)
    assert written(tmp_path / "out") == JOB_CLEANED
    assert report_of(result.text, tmp_path / "report") == JOB_AFTER
    (total,) = result.summary.collect()
    assert total.asDict() == {"n_before": 12, "n_deleted": 6, "n_after": 6}
    assert before == {p.name: p.read_bytes() for p in (tmp_path / "in").iterdir()}
    lines = line_numbers(read_rewritten(spark, str(tmp_path / "out")))
    got = [tuple(r) for r in lines.orderBy("file", "line_no").select("file", "value").collect()]
    assert got == [(n, v) for n, t in JOB_CLEANED.items() for v in t.splitlines()]


def test_clean_job_modes(spark, tmp_path):
    put(tmp_path / "in", **JOB)
    cross = clean(spark, str(tmp_path / "in"), str(tmp_path / "cross"), "cross", TWO)
    assert written(tmp_path / "cross") == {
        "a.csv": JOB["a.csv"],
        "b.csv": "h\nD;1;x\nD;1;x\n",
        "c.csv": "h\nE;1;x\n",
    }
    assert [r["text"] for r in cross.text.orderBy("prefix", "key", "seq", "file").collect()] == [
        re.sub(r"a.csv -> Deleted 1 rows", "a.csv", line) for line in JOB_AFTER.splitlines()
    ]
    within = clean(spark, str(tmp_path / "in"), str(tmp_path / "within"), "within", TWO)
    assert written(tmp_path / "within") == {
        "a.csv": "h\nA;1;x\nB;1;x\n\nC;1;x\n",
        "b.csv": "h\nB;1;z\nC;1;other tail\nD;1;x\n",
        "c.csv": JOB["c.csv"],
    }
    (total,) = within.summary.collect()
    assert total["n_deleted"] == 3
    with pytest.raises(ValueError):
        clean(spark, str(tmp_path / "in"), str(tmp_path / "x"), "other")


def test_same_name_in_two_folders(spark, tmp_path):
    put(tmp_path / "in", **{"a.csv": "h\nk;1\n", "sub/a.csv": "h\nk;1\nm;1\n", "sub 2%/a.csv": "h\nm;1\n"})
    options = Options(n_fields=2, recursive=True)
    found = find_duplicates(spark, str(tmp_path / "in"), options)
    assert {(r["key"], r["scope"]) for r in found.entries.collect()} == {("k;1", "cross"), ("m;1", "cross")}
    clean(spark, str(tmp_path / "in"), str(tmp_path / "out"), options=options)
    expected = {"a.csv": "h\nk;1\n", "sub/a.csv": "h\n", "sub 2%/a.csv": "h\nm;1\n"}
    assert written(tmp_path / "out") == expected
    back = read_rewritten(spark, str(tmp_path / "out")).collect()
    assert sorted((r["file"], r["value"]) for r in back) == sorted(
        (name, line) for name, text in expected.items() for line in text.splitlines()
    )


def test_clean_without_files(spark, tmp_path):
    put(tmp_path / "in", **{"a.csv": "h\nk\nk\n"})
    result = clean(spark, str(tmp_path / "in"), str(tmp_path / "out"), options=Options(pattern="*.none"))
    assert written(tmp_path / "out") == {}
    (total,) = result.summary.collect()
    assert total.asDict() == {"n_before": 0, "n_deleted": 0, "n_after": 0}
    assert [r["text"] for r in result.text.collect()] == ["No duplicates found."]


def test_file_that_only_has_repeats_of_its_own(spark, tmp_path):
    """With a report of keys in several files only, its deletions get an entry of their own."""
    put(tmp_path / "in", **{"a.csv": "h\nk\nk\n", "b.csv": "h\nm\n", "c.csv": "h\nm\n"})
    result = clean(spark, str(tmp_path / "in"), str(tmp_path / "out"), options=Options(cross_only=True))
    assert report_of(result.text, tmp_path / "report") == (
        "(Within-file duplicates only - a.csv)\n"
        "    - (Within-file duplicates) a.csv -> Deleted 1 rows\n"
        "m\n    - b.csv\n    - c.csv -> Deleted 1 rows\n"
    )


def test_empty_keys(spark, tmp_path):
    put(tmp_path / "in", **{"a.csv": "h\n;x\n;y\nk;1\n"})
    kept = find_duplicates(spark, str(tmp_path / "in"), Options(n_fields=1))
    assert [r["key"] for r in kept.entries.collect()] == [""]
    dropped = find_duplicates(spark, str(tmp_path / "in"), Options(n_fields=1, drop_empty_keys=True))
    assert dropped.entries.count() == 0


def test_report_in_the_layout_of_real_exports(spark, tmp_path):
    """Six quoted key fields of 46 characters: the default prefix shows the key and one delimiter."""

    def row(number, tail):
        return f'"207";"XA";"9B77";"1999";"{number:010}";"{number % 1000:06}";{tail}\n'

    put(
        tmp_path / "in",
        **{
            "EXPORT_2024_A.csv": "head\n" + row(1, "p") + row(2, "q") + row(2, "r") + row(5, "s"),
            "EXPORT_2024_B.csv": "head\n" + row(1, "other") + row(3, "q"),
            "EXPORT_2025_C.csv": "head\n" + row(1, "third") + row(4, "q"),
        },
    )
    found = find_duplicates(spark, str(tmp_path / "in"), Options(labels=HUNGARIAN))
    one, two = row(1, "").strip(), row(2, "").strip()
    assert len(one) == 47
    assert report_of(found.text, tmp_path / "report") == (
        f"{one}\n    - EXPORT_2024_A.csv\n    - EXPORT_2024_B.csv\n    - EXPORT_2025_C.csv\n"
        f"{two}\n    - (Fájlon belüli duplikátumok) EXPORT_2024_A.csv\n"
    )


def test_tabs_in_prefix(spark, tmp_path):
    put(tmp_path / "in", **{"a.csv": "h\na\tb;1;x\na\tb;1;y\n"})
    for spaces, shown in ((False, "a\tb;1;x"), (True, "a b;1;x")):
        found = find_duplicates(spark, str(tmp_path / "in"), Options(n_fields=2, tabs_to_spaces=spaces))
        assert [r["prefix"] for r in found.entries.collect()] == [shown]


def test_summary_of_lines_with_blank_ones(spark, tmp_path):
    put(tmp_path / "in", **EDGE)
    marked = marked_lines(read_lines(spark, str(tmp_path / "in")))
    rows = keyed(marked, n_fields=1)
    assert rows.filter(F.col("line") == "").count() == 0
    none = spark.createDataFrame([], "n_cross_deleted long, n_within_deleted long")
    (total,) = run_summary(line_counts(index_blocks(marked)), none).collect()
    n = sum(max(len(python_lines(tmp_path / "in" / name)) - 1, 0) for name in EDGE)
    assert total.asDict() == {"n_before": n, "n_deleted": 0, "n_after": n}


def test_hidden_names_are_sorted_out_where_they_are_listed(spark, tmp_path):
    """The hidden files that a writer keeps beside the others do not come to the driver's Python."""
    names = {f"d{i}/{name}": "" for i in range(20) for name in ("a.csv", ".a.csv.tmp", "_b.txt")}
    put(tmp_path, **names)
    found = text_files._glob(spark, f"{tmp_path}/*/[._]*", "*.{txt,TXT}")
    assert [s.getPath().getName() for s in found] == 20 * ["_b.txt"]
    assert len(text_files._glob(spark, f"{tmp_path}/*/[._]*")) == 40
    assert list_inputs(spark, str(tmp_path), recursive=True).count() == 20


def test_document_files(spark, tmp_path, monkeypatch):
    """A text file for each source and range, and the decoys whole in a file per scan task."""
    rows = [(i, f"text {i}\nend", f"s{i % 4}" if i % 9 else None) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    docs.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(registry, "DOCS_PER_FILE", 10)
    folder = Path(registry.document_folder(spark, str(tmp_path)).removeprefix("file:"))
    name = {i: f"{source}-{i // 10}" if source else f"{i // 10}" for i, _, source in rows}
    texts = {p.parent.name.removeprefix("name="): p.read_text() for p in folder.rglob("*.txt")}
    assert len(list(folder.rglob("*.txt"))) == len(texts) == len(set(name.values()))
    assert texts == {n: "".join(f"{text}\n" for i, text, _ in rows if name[i] == n) for n in texts}
    decoys = list(folder.rglob("*.json"))
    assert 0 < len(decoys) <= 2
    known = spark.read.json(str(folder), recursiveFileLookup=True, pathGlobFilter="*.json")
    assert {r["doc_id"]: r["name"] for r in known.collect()} == name


def test_headers_are_skipped_with_one_count_of_lines(spark, monkeypatch):
    counted = []

    def counting(lines):
        counted.append(lines)
        return index_blocks(lines)

    monkeypatch.setattr(registry, "index_blocks", counting)
    monkeypatch.setattr(numbering, "index_blocks", counting)
    assert registry.q_skip_header(spark, "/root/testdata/sf0.001").count() > 0
    assert len(counted) == 1


def many_documents(spark, tmp_path, monkeypatch):
    """A table of 400 documents whose derived folder has a file for each ten of a source."""
    rows = [(i, f"head {i}\nsame line\nline {i}", f"s{i % 4}") for i in range(400)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(registry, "DOCS_PER_FILE", 10)
    return str(tmp_path)


def test_small_files_share_a_task(spark, tmp_path, monkeypatch, conf):
    conf(files__maxPartitionBytes=str(8 << 20), files__openCostInBytes=str(4 << 20))
    sf = many_documents(spark, tmp_path, monkeypatch)
    lines = registry.folder_lines(spark, sf)
    assert lines.select("path").distinct().count() == 160
    assert lines.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism + 1
    listed = list_inputs(spark, registry.document_folder(spark, sf), "*.txt", recursive=True)
    assert listed.count() == 160


def test_a_lower_cost_of_files_is_left(spark, conf):
    conf(files__openCostInBytes="7")
    pack_small_files(spark)
    assert spark.conf.get("spark.sql.files.openCostInBytes") == "7"


def test_no_checksum_file_beside_each_derived_file(spark, tmp_path, monkeypatch, conf):
    conf(files__openCostInBytes=str(4 << 20))
    folder = Path(registry.document_folder(spark, many_documents(spark, tmp_path, monkeypatch)).removeprefix("file:"))
    assert len(list(folder.glob("name=*/*.txt"))) == 160 and not list(folder.glob("name=*/.*"))


def test_rewritten_files_with_and_without_checksums(spark, tmp_path):
    put(tmp_path / "in", **JOB)
    lines = marked_lines(read_lines(spark, str(tmp_path / "in")))
    for name, options in (("with", None), ("without", WITHOUT_CHECKSUMS)):
        rewrite(lines, str(tmp_path / name), root=str(tmp_path / "in"), options=options)
        assert written(tmp_path / name) == JOB
        assert len(list((tmp_path / name).rglob(".*.txt.crc"))) == (len(JOB) if options is None else 0)
        back = line_numbers(read_rewritten(spark, str(tmp_path / name))).orderBy("file", "line_no")
        assert [r["value"] for r in back.collect()] == [v for _, text in sorted(JOB.items()) for v in text.splitlines()]


def test_hidden_names_are_looked_for_beside_deeper_levels(spark, tmp_path, monkeypatch):
    put(tmp_path, **{"a/b/c.csv": "h\n"})
    by, glob = {}, text_files._glob

    def watched(spark, pattern, *names):
        by.setdefault(pattern.endswith("[._]*"), set()).add(threading.get_ident())
        return glob(spark, pattern, *names)

    monkeypatch.setattr(text_files, "_glob", watched)
    assert read_lines(spark, str(tmp_path), recursive=True).count() == 1
    assert by[False] == {threading.get_ident()} and threading.get_ident() not in by[True]
