"""The operators as queries over the test tables, one entry per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from samerow.functions import decode_ignore, is_blank, key_digest, key_fields, line_prefix, strip_py
from samerow.operators import (
    annotate_entries,
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
    index_blocks,
    input_totals,
    keep_file,
    key_files,
    key_summary,
    line_counts,
    line_numbers,
    number_report,
    remove_rows,
    render_report,
    report_entries,
    row_fate,
    rows_by_prefix,
    run_summary,
    surplus_rows,
    unlisted_files,
    within_surplus,
)
from samerow.operators.dedupe import CROSS_DELETED, KEPT
from samerow.operators.wide import dedupe_wide, wide_entries
from samerow.plans.jobs import Options
from samerow.plans.state import KeyState
from samerow.session import configure, input_size, pack_small_files, save, scratch_dir, shuffle_partitions
from samerow.sources import (
    LINE_SUFFIXES,
    WITHOUT_CHECKSUMS,
    chunked,
    drop_first_rows,
    key_lines,
    keyed,
    list_inputs,
    mark_headers,
    read_lines,
    read_rewritten,
    rewrite,
    rows_from_lines,
    rows_from_table,
    split_lines,
)

# Documents per derived text file and source: files stay small however many documents there are.
DOCS_PER_FILE = 1_000

TEXT_ARGS = {"delimiter": " ", "n_fields": 6}


# ---- tables as rows -------------------------------------------------------------------------------------


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{sf}/{name}.parquet")
    configure(spark, input_size(table))
    return table


def document_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every document is a file, every line of its text a row."""
    return split_lines(_table(spark, sf, "documents"), F.col("doc_id"), F.col("text"))


def document_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rows_from_lines(document_lines(spark, sf), **TEXT_ARGS)


def language_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every language is a file, few big ones; its lines come in order of document and line."""
    lines = _table(spark, sf, "documents").select(
        F.col("lang").alias("path"),
        F.col("lang").alias("file"),
        "doc_id",
        F.posexplode(F.split("text", "\n")).alias("i", "value"),
    )
    return chunked(lines, "doc_id", "i")


def text_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every source is a file, every document a row, its whole text the key."""
    docs = _table(spark, sf, "documents")
    return rows_from_table(docs, F.col("source"), F.col("doc_id"), ["text"], F.col("text"))


def order_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every priority is a file, every order a delimited line; customer and status are the key."""
    value = F.concat_ws(";", "o_custkey", "o_orderstatus", "o_orderkey")
    lines = _table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("path"),
        F.col("o_orderpriority").alias("file"),
        F.lit(0).cast("long").alias("block"),
        F.col("o_orderkey").alias("pos"),
        value.alias("value"),
    )
    return rows_from_lines(lines, ";", 2)


def event_rows(spark: SparkSession, sf: str, period: Column) -> DataFrame:
    """Events of a day or month are a file; user and type are the key."""
    line = F.concat_ws(";", "user_id", "event_type")
    return rows_from_table(
        _table(spark, sf, "events"), period, F.col("event_id"), ["user_id", "event_type"], line
    )


def lineitem_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every return flag is a file; part, supplier and status are the key. For counts: rows have no order."""
    return rows_from_table(
        _table(spark, sf, "lineitem"),
        F.col("l_returnflag"),
        F.col("l_orderkey"),
        ["l_partkey", "l_suppkey", "l_linestatus"],
        F.concat_ws(";", "l_partkey", "l_suppkey", "l_linestatus"),
    )


def day() -> Column:
    return F.date_format("ts", "yyyy-MM-dd")


def month() -> Column:
    return F.date_format("ts", "yyyy-MM")


# ---- text files derived from the documents --------------------------------------------------------------

_folders: dict[tuple[str, str], str] = {}


def document_folder(spark: SparkSession, sf: str) -> str:
    """Write the documents as text files, one per source and range of ids, and return the folder.

    Next to the folders of ``.txt`` files lie ``.json`` ones, which the file patterns must leave out: one per task that
    reads the documents, since making a file costs more than writing its rows.
    """
    pack_small_files(spark)
    known = (spark.sparkContext.applicationId, sf)
    if known not in _folders:
        folder = scratch_dir(spark)
        name = F.concat_ws("-", "source", F.expr(f"doc_id div {DOCS_PER_FILE}"))
        docs = _table(spark, sf, "documents").select(name.alias("name"), "doc_id", "text")
        # With a number, partitions stay apart: they take their time by files, not by bytes.
        placed = docs.repartition(shuffle_partitions(spark), "name").sortWithinPartitions("name", "doc_id")
        placed.select("name", "text").write.options(**WITHOUT_CHECKSUMS).partitionBy("name").text(folder)
        docs.select("name", "doc_id").write.mode("append").json(folder)
        _folders[known] = folder
    return _folders[known]


def mixed_endings(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of text files in which documents end their lines in one of the three ways."""
    pack_small_files(spark)
    folder = scratch_dir(spark)
    # A last empty line would make one end of line out of two.
    end = F.when(F.endswith("text", F.lit("\n")), "\n").otherwise(
        F.element_at(F.array(F.lit("\n"), F.lit("\r\n"), F.lit("\r")), (F.col("doc_id") % 3 + 1).cast("int"))
    )
    name = F.concat_ws("-", "source", F.expr(f"doc_id div {DOCS_PER_FILE}"))
    docs = _table(spark, sf, "documents").select(
        name.alias("name"), "doc_id", F.replace("text", F.lit("\n"), end).alias("text")
    )
    placed = docs.repartition("name").sortWithinPartitions("name", "doc_id")
    placed.select("name", "text").write.options(**WITHOUT_CHECKSUMS).partitionBy("name").text(folder)
    return _named(read_lines(spark, folder, "*.txt", recursive=True))


def _named(df: DataFrame) -> DataFrame:
    """Spark picks the file names, so the folder's name stands for the file."""
    name = F.regexp_extract("path", "/name=([^/]+)/", 1)
    return df.withColumns({"path": name, "file": name})


def folder_lines(spark: SparkSession, sf: str) -> DataFrame:
    return read_lines(spark, document_folder(spark, sf), "*.txt", recursive=True)


def marked_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = folder_lines(spark, sf)
    return _named(mark_headers(lines, index_blocks(lines)))


# ---- shared steps ---------------------------------------------------------------------------------------


def _found(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    found = save(key_files(rows))
    return found, save(key_summary(found, rows))


def _entries(rows: DataFrame) -> DataFrame:
    return report_entries(*_found(rows))


def _summary(rows: DataFrame) -> DataFrame:
    return _found(rows)[1]


def _report(rows: DataFrame) -> DataFrame:
    return _entries(rows).select("prefix", "key", "scope", "n_rows", "file", "n")


def _totals(rows: DataFrame) -> DataFrame:
    return count_keys(count_by_file(rows))


def _fates(rows: DataFrame) -> DataFrame:
    return row_fate(rows, _summary(rows))


def _flat(df: DataFrame, *columns: str) -> DataFrame:
    """Key columns side by side instead of a struct."""
    return df.select("key.*", *columns)


# ---- queries --------------------------------------------------------------------------------------------


def q_read_lines(spark, sf):
    return line_numbers(_named(folder_lines(spark, sf))).select("file", "line_no", "value")


def q_read_lines_endings(spark, sf):
    return line_numbers(mixed_endings(spark, sf)).select("file", "line_no", "value")


def q_read_lines_suffix(spark, sf):
    lines = read_lines(spark, document_folder(spark, sf), LINE_SUFFIXES, recursive=True)
    return _named(lines).groupBy("file").agg(F.count("*").alias("n"))


def q_list_inputs(spark, sf):
    files = list_inputs(spark, document_folder(spark, sf), "*.txt", recursive=True)
    return _named(files).select("file", "size")


def q_inputs_by_size(spark, sf):
    files = list_inputs(spark, document_folder(spark, sf), "*.txt", recursive=True)
    return _named(files).orderBy("size", "file").select("size", "file")


def q_input_totals(spark, sf):
    return input_totals(_named(list_inputs(spark, document_folder(spark, sf), "*.txt", recursive=True)))


def q_decode_ignore(spark, sf):
    # Put bytes that are never valid UTF-8 behind every blank; what is left must be the text itself.
    damaged = F.replace(F.col("text"), F.lit(" "), F.expr("cast(X'20FFC3FE' AS string)"))
    return _table(spark, sf, "documents").select("doc_id", decode_ignore(damaged).alias("text"))


def q_skip_header(spark, sf):
    lines = folder_lines(spark, sf)
    blocks = index_blocks(lines)
    numbered = line_numbers(mark_headers(lines, blocks), blocks)
    return _named(numbered).filter(~F.col("is_header")).select("file", "line_no", "value")


def q_skip_header_rows(spark, sf):
    return drop_first_rows(document_lines(spark, sf)).select("file", "pos", "value")


def q_strip_lines(spark, sf):
    return document_lines(spark, sf).select("file", "pos", strip_py(F.col("value")).alias("line"))


def q_key_fields(spark, sf):
    return document_rows(spark, sf).select("file", "pos", "key")


def q_key_fields_overlapping(spark, sf):
    line = strip_py(F.col("value"))
    return document_lines(spark, sf).select("file", "pos", key_fields(line, "ee", 2).alias("key"))


def q_key_digest(spark, sf):
    return document_rows(spark, sf).select("file", "pos", key_digest(F.col("key")).alias("digest"))


def q_line_prefix(spark, sf):
    return document_rows(spark, sf).select("file", "pos", "prefix")


def q_prefix_tabs(spark, sf):
    line = F.concat_ws("\t", "o_orderstatus", "o_orderpriority", "o_custkey", "o_orderkey")
    return _table(spark, sf, "orders").select(
        "o_orderkey", line_prefix(line, 12, tabs_to_spaces=True).alias("prefix")
    )


def q_non_blank(spark, sf):
    return document_lines(spark, sf).filter(~is_blank(F.col("value"))).select("file", "pos", "value")


def q_non_empty_key(spark, sf):
    rows = rows_from_lines(document_lines(spark, sf), "T", 1, drop_empty_keys=True)
    return rows.select("file", "pos", "key")


def q_table_dups(spark, sf):
    return _flat(duplicates(_totals(lineitem_rows(spark, sf))), "n_files", "n_rows")


def q_key_file_counts(spark, sf):
    return count_by_file(document_rows(spark, sf)).select("key", "file", "n")


def q_key_file_counts_lineitem(spark, sf):
    return _flat(count_by_file(lineitem_rows(spark, sf)), "file", "n")


def q_key_totals(spark, sf):
    return _totals(document_rows(spark, sf))


def q_key_totals_lineitem(spark, sf):
    return _flat(_totals(lineitem_rows(spark, sf)), "n_files", "n_rows")


def q_duplicate_keys(spark, sf):
    return duplicates(_totals(document_rows(spark, sf)))


def q_dup_scope(spark, sf):
    return classify(duplicates(_totals(document_rows(spark, sf))))


def q_dup_scope_lineitem(spark, sf):
    return _flat(classify(duplicates(_totals(lineitem_rows(spark, sf)))), "n_files", "n_rows", "scope")


def q_cross_only(spark, sf):
    return duplicates(_totals(document_rows(spark, sf)), scope="cross")


def _file_lists(spark, sf):
    counts = save(count_by_file(document_rows(spark, sf)))
    return file_lists(counts, save(duplicates(count_keys(counts))))


def q_dup_files(spark, sf):
    return _file_lists(spark, sf).select("key", "place", "file")


def q_dup_file_map(spark, sf):
    return _file_lists(spark, sf).select("key", "file", "n")


def q_first_prefix(spark, sf):
    return _summary(document_rows(spark, sf)).select("key", "n_rows", "prefix")


def q_dup_report(spark, sf):
    return _report(document_rows(spark, sf))


def q_dup_report_texts(spark, sf):
    return wide_entries(text_rows(spark, sf)).select("prefix", "key", "scope", "n_rows", "file", "n")


def q_dup_report_orders(spark, sf):
    return _report(order_rows(spark, sf))


def q_dup_report_events_day(spark, sf):
    return _flat(_entries(event_rows(spark, sf, day())), "prefix", "scope", "n_rows", "file", "n")


def q_dup_report_events_month(spark, sf):
    return _flat(_entries(event_rows(spark, sf, month())), "prefix", "scope", "n_rows", "file", "n")


def q_report_by_prefix(spark, sf):
    return distinct_prefixes(_entries(document_rows(spark, sf))).select("prefix", "file")


def q_union_scopes(spark, sf):
    found = save(classify(duplicates(_totals(document_rows(spark, sf)))))
    cross, within = (found.filter(F.col("scope") == s) for s in ("cross", "within"))
    return cross.unionByName(within)


def q_dup_summary(spark, sf):
    return dup_summary(_totals(document_rows(spark, sf)))


def q_dup_summary_lineitem(spark, sf):
    return dup_summary(_totals(lineitem_rows(spark, sf)))


def q_line_counts(spark, sf):
    folder = document_folder(spark, sf)
    files = list_inputs(spark, folder, "*.txt", recursive=True)
    return _named(line_counts(index_blocks(folder_lines(spark, sf)), files)).select("file", "n_lines")


def q_within_surplus(spark, sf):
    return within_surplus(count_by_file(document_rows(spark, sf))).select("file", "surplus")


def q_within_surplus_lineitem(spark, sf):
    return within_surplus(count_by_file(lineitem_rows(spark, sf))).select("file", "surplus")


def _avg_line_length(spark, sf, limit=None):
    lines = marked_lines(spark, sf).filter(~F.col("is_header"))
    files = _named(list_inputs(spark, document_folder(spark, sf), "*.txt", recursive=True))
    return avg_line_length(lines, files, limit).select("file", F.round("avg_len", 4).alias("avg_len"))


def q_avg_line_length(spark, sf):
    return _avg_line_length(spark, sf)


def q_avg_line_length_sample(spark, sf):
    return _avg_line_length(spark, sf, limit=100)


def q_deletion_stats(spark, sf):
    return deletion_stats(_entries(document_rows(spark, sf))).drop("path")


def q_deletion_totals(spark, sf):
    return deletion_totals(deletion_stats(_entries(document_rows(spark, sf))))


def q_run_summary(spark, sf):
    lines = marked_lines(spark, sf)
    return run_summary(line_counts(index_blocks(lines)), deletion_stats(_entries(keyed(lines, **TEXT_ARGS))))


def q_duplicate_rows(spark, sf):
    rows = document_rows(spark, sf)
    return duplicate_rows(rows, save(duplicates(_totals(rows)))).select("file", "pos", "line")


def q_rows_by_prefix(spark, sf):
    rows = document_rows(spark, sf)
    return rows_by_prefix(rows, save(cross_prefixes(_entries(rows)))).select("file", "pos", "line")


def q_deletion_candidates(spark, sf):
    rows = document_rows(spark, sf)
    return deletion_candidates(rows, save(duplicates(_totals(rows)))).select("file", "pos", "line")


def q_remove_rows(spark, sf):
    rows = document_rows(spark, sf)
    removal = _fates(rows).filter(F.col("fate") == CROSS_DELETED).select("path", "line")
    return remove_rows(rows, removal).select("file", "pos", "line")


def q_dedupe_within(spark, sf):
    return dedupe_within(document_rows(spark, sf)).select("file", "pos", "line")


def q_dedupe_within_orders(spark, sf):
    return dedupe_within(order_rows(spark, sf)).select("file", "pos", "line")


def q_keep_file(spark, sf):
    return keep_file(count_by_file(document_rows(spark, sf))).select("key", "keep_file")


def q_dedupe_cross_only(spark, sf):
    rows = document_rows(spark, sf)
    return dedupe_cross_only(rows, _summary(rows)).select("file", "pos", "line")


def q_dedupe_all(spark, sf):
    return dedupe_all(document_rows(spark, sf)).select("file", "pos", "line")


def q_dedupe_all_orders(spark, sf):
    return dedupe_all(order_rows(spark, sf)).select("file", "pos", "line")


def q_dedupe_all_texts(spark, sf):
    return dedupe_wide(text_rows(spark, sf)).select("file", "pos", "line")


def q_row_fate(spark, sf):
    return _fates(document_rows(spark, sf)).select("file", "pos", "keep_file", "fate")


def q_row_fate_orders(spark, sf):
    return _fates(order_rows(spark, sf)).select("file", "pos", "keep_file", "fate")


def q_line_numbers(spark, sf):
    return line_numbers(language_lines(spark, sf)).select("file", "line_no", "value")


def q_report_text(spark, sf):
    return render_report(save(_entries(document_rows(spark, sf))))


def q_report_lines(spark, sf):
    return number_report(render_report(save(_entries(document_rows(spark, sf))))).select("line_no", "text")


def q_report_empty(spark, sf):
    orders = _table(spark, sf, "orders")
    unique = rows_from_table(
        orders, F.col("o_orderpriority"), F.col("o_orderkey"), ["o_orderkey"], F.col("o_orderkey").cast("string")
    )
    return render_report(save(_entries(unique))).select("text")


def q_report_after_delete(spark, sf):
    entries = save(_entries(document_rows(spark, sf)))
    return render_report(annotate_entries(entries, save(deletion_stats(entries))))


def q_unlisted_files(spark, sf):
    entries = save(_entries(document_rows(spark, sf)))
    listed = entries.filter(F.col("scope") == "cross")
    return unlisted_files(listed, deletion_stats(entries)).select("prefix", "file", "n", "shown")


def q_cleaned_rows(spark, sf):
    lines = key_lines(line_numbers(marked_lines(spark, sf)), **TEXT_ARGS)
    fates = row_fate(lines, _summary(keyed(lines, **TEXT_ARGS)))
    return fates.filter(F.col("fate") == KEPT).select("file", "line_no", "value")


def q_rewrite_files(spark, sf):
    lines = marked_lines(spark, sf)
    rows = keyed(lines, **TEXT_ARGS)
    out = scratch_dir(spark)
    rewrite(lines, out, surplus=save(surplus_rows(rows, save(key_files(rows)))), options=WITHOUT_CHECKSUMS)
    return line_numbers(read_rewritten(spark, out)).select("file", "line_no", "value")


def q_state_report(spark, sf):
    """The files of some sources are added first and all others later, which reads only these."""
    folder = document_folder(spark, sf)
    options = Options(pattern="*.txt", recursive=True, **TEXT_ARGS)
    state = KeyState(spark, scratch_dir(spark), options, buckets=shuffle_partitions(spark))
    for source in ("name=src0-0", "name=src1-0", ""):
        state.add(f"{folder}/{source}")
    found = state.entries()
    # Spark picks the file names, so the first file of a key, whose prefix is shown, is any.
    return _named(found).select("key", "scope", "n_rows", "file", "n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name[2:]: f for name, f in globals().items() if name.startswith("q_")}
