"""The same queries as plain SQL, written apart from the Spark code, to check its results against."""

from __future__ import annotations

# Fixed value: the characters that count as white space at the ends of a line.
WHITESPACE = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288])
)

# ---- tables as rows -------------------------------------------------------------------------------------

DOC_LINES = """
lines AS (
  SELECT CAST(doc_id AS VARCHAR) AS file, i - 1 AS pos, value
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS value,
               generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"""

DOC_ROWS = f"""{DOC_LINES},
stripped AS (SELECT file, pos, value, trim(value, '{WHITESPACE}') AS line FROM lines),
keyed AS (
  SELECT *, array_to_string(string_split(line, ' ')[1:6], ' ') AS key, left(line, 47) AS prefix
  FROM stripped WHERE line <> '')"""

LANG_LINES = """
lines AS (
  SELECT lang AS file, value, row_number() OVER (PARTITION BY lang ORDER BY doc_id, i) AS line_no
  FROM (SELECT lang, doc_id, unnest(string_split(text, chr(10))) AS value,
               generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"""

ORDER_ROWS = """
keyed AS (
  SELECT o_orderpriority AS file, o_orderkey AS pos,
         concat_ws(';', o_custkey, o_orderstatus, o_orderkey) AS line,
         concat_ws(';', o_custkey, o_orderstatus) AS key,
         left(concat_ws(';', o_custkey, o_orderstatus, o_orderkey), 47) AS prefix
  FROM orders)"""

TEXT_ROWS = """
keyed AS (
  SELECT source AS file, doc_id AS pos, text AS line, text AS key, left(text, 47) AS prefix
  FROM documents WHERE text IS NOT NULL)"""

LINEITEM_COUNTS = """
counts AS (
  SELECT l_partkey, l_suppkey, l_linestatus, l_returnflag AS file, count(*) AS n
  FROM lineitem GROUP BY ALL),
totals AS (
  SELECT l_partkey, l_suppkey, l_linestatus, count(*) AS n_files, CAST(sum(n) AS BIGINT) AS n_rows
  FROM counts GROUP BY ALL)"""

FOLDER_LINES = f"""
lines AS (
  SELECT source || '-' || CAST(doc_id // 1000 AS VARCHAR) AS file, value,
         row_number() OVER (PARTITION BY source, doc_id // 1000 ORDER BY doc_id, i) AS line_no
  FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS value,
               generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
stripped AS (SELECT *, line_no AS pos, trim(value, '{WHITESPACE}') AS line FROM lines),
keyed AS (
  SELECT *, array_to_string(string_split(line, ' ')[1:6], ' ') AS key
  FROM stripped WHERE line <> '' AND line_no > 1)"""

# ---- steps on rows --------------------------------------------------------------------------------------

COUNTS = """
counts AS (SELECT key, file, count(*) AS n FROM keyed GROUP BY key, file),
totals AS (SELECT key, count(*) AS n_files, CAST(sum(n) AS BIGINT) AS n_rows FROM counts GROUP BY key),
dups AS (SELECT *, CASE WHEN n_files > 1 THEN 'cross' ELSE 'within' END AS scope FROM totals WHERE n_rows > 1)"""

ENTRIES = f"""{COUNTS},
firsts AS (
  SELECT key, prefix, file AS keep_file FROM keyed
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY file, pos) = 1),
entries AS (
  SELECT f.prefix, d.key, d.scope, d.n_rows, c.file, c.n, c.file = f.keep_file AS is_first
  FROM dups d JOIN firsts f USING (key) JOIN counts c USING (key))"""

FATES = """
ranked AS (
  SELECT *, min(file) OVER (PARTITION BY key) AS keep_file,
         row_number() OVER (PARTITION BY file, key ORDER BY pos) AS rn FROM keyed),
fates AS (
  SELECT *, CASE WHEN file <> keep_file THEN 'cross_deleted' WHEN rn > 1 THEN 'within_deleted'
                 ELSE 'kept' END AS fate FROM ranked)"""

STATS = f"""{FATES},
stats AS (
  SELECT file, count(DISTINCT key) AS n_keys, count(*) FILTER (fate = 'cross_deleted') AS n_cross_deleted,
         count(*) FILTER (fate = 'within_deleted') AS n_within_deleted
  FROM fates WHERE key IN (SELECT key FROM keyed GROUP BY key HAVING count(*) > 1) GROUP BY file)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def _event_report(period: str) -> str:
    return f"""
WITH keyed AS (
  SELECT strftime(ts, '{period}') AS file, event_id AS pos, user_id, event_type,
         concat_ws(';', user_id, event_type) AS key, left(concat_ws(';', user_id, event_type), 47) AS prefix
  FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL),
{ENTRIES}
SELECT DISTINCT k.user_id, k.event_type, e.prefix, e.scope, e.n_rows, e.file, e.n
FROM entries e JOIN keyed k USING (key)"""


_REPORT = "SELECT prefix, key, scope, n_rows, file, n FROM entries"

_TEXT = """
SELECT prefix, key, CAST(0 AS INTEGER) AS seq, file, prefix AS text FROM entries WHERE is_first
UNION ALL
SELECT prefix, key, CAST(1 AS INTEGER) AS seq, file,
       '    - ' || CASE WHEN scope = 'within' THEN '(Within-file duplicates) ' ELSE '' END || shown AS text
FROM {source}"""


def oracle_sql() -> dict[str, str]:
    docs, orders, texts = _with(DOC_ROWS), _with(ORDER_ROWS), _with(TEXT_ROWS)
    lineitem, folder = _with(LINEITEM_COUNTS), _with(FOLDER_LINES)
    rows = "SELECT file, pos, line"
    first_of_key = "QUALIFY row_number() OVER (PARTITION BY key ORDER BY file, pos) = 1"
    first_in_file = "QUALIFY row_number() OVER (PARTITION BY file, key ORDER BY pos) = 1"
    kept_lines = f"""{folder}, {FATES},
kept AS (
  SELECT file, line_no, value FROM fates WHERE fate = 'kept'
  UNION ALL SELECT file, line_no, value FROM stripped WHERE line = '' OR line_no = 1)"""
    annotated = """shown AS (
  SELECT e.*, CASE WHEN e.scope = 'cross' THEN s.n_cross_deleted ELSE s.n_within_deleted END AS gone,
         CASE WHEN gone > 0 THEN e.file || ' -> Deleted ' || gone || ' rows' ELSE e.file END AS shown
  FROM entries e LEFT JOIN stats s USING (file))"""
    return {
        "read_lines": f"{folder} SELECT file, line_no, value FROM lines",
        "read_lines_endings": f"{folder} SELECT file, line_no, value FROM lines",
        "read_lines_suffix": f"{folder} SELECT file, count(*) AS n FROM lines GROUP BY file",
        "list_inputs": f"{folder} SELECT file, CAST(sum(strlen(value) + 1) AS BIGINT) AS size FROM lines GROUP BY file",
        "inputs_by_size": f"""{folder} SELECT file, CAST(sum(strlen(value) + 1) AS BIGINT) AS size
            FROM lines GROUP BY file ORDER BY size, file""",
        "input_totals": f"""{folder}, sizes AS (
              SELECT file, CAST(sum(strlen(value) + 1) AS BIGINT) AS size FROM lines GROUP BY file)
            SELECT count(*) AS n_files, CAST(sum(size) AS BIGINT) AS total_size,
                   arg_min(file, (-size, file)) AS largest_file, max(size) AS largest_size FROM sizes""",
        "decode_ignore": "SELECT doc_id, text FROM documents",
        "skip_header": f"{folder} SELECT file, line_no, value FROM lines WHERE line_no > 1",
        "skip_header_rows": f"{docs} SELECT file, pos, value FROM lines WHERE pos > 0",
        "strip_lines": f"{docs} SELECT file, pos, line FROM stripped",
        "key_fields": f"{docs} SELECT file, pos, key FROM keyed",
        "key_fields_overlapping": f"""{docs} SELECT file, pos,
            array_to_string(string_split(line, 'ee')[1:2], 'ee') AS key FROM stripped""",
        "key_digest": f"{docs} SELECT file, pos, sha256(key) AS digest FROM keyed",
        "line_prefix": f"{docs} SELECT file, pos, prefix FROM keyed",
        "prefix_tabs": """SELECT o_orderkey, replace(left(concat_ws(chr(9), o_orderstatus, o_orderpriority,
            o_custkey, o_orderkey), 12), chr(9), ' ') AS prefix FROM orders""",
        "non_blank": f"{docs} SELECT file, pos, value FROM keyed",
        "non_empty_key": f"""{docs} SELECT file, pos, string_split(line, 'T')[1] AS key FROM keyed
            WHERE string_split(line, 'T')[1] <> ''""",
        "table_dups": f"{lineitem} SELECT * FROM totals WHERE n_rows > 1",
        "key_file_counts": f"{docs}, {COUNTS} SELECT key, file, n FROM counts",
        "key_file_counts_lineitem": f"{lineitem} SELECT * FROM counts",
        "key_totals": f"{docs}, {COUNTS} SELECT key, n_files, n_rows FROM totals",
        "key_totals_lineitem": f"{lineitem} SELECT * FROM totals",
        "duplicate_keys": f"{docs}, {COUNTS} SELECT key, n_files, n_rows FROM dups",
        "dup_scope": f"{docs}, {COUNTS} SELECT key, n_files, n_rows, scope FROM dups",
        "dup_scope_lineitem": f"""{lineitem} SELECT *, CASE WHEN n_files > 1 THEN 'cross' ELSE 'within' END AS scope
            FROM totals WHERE n_rows > 1""",
        "cross_only": f"{docs}, {COUNTS} SELECT key, n_files, n_rows FROM totals WHERE n_files > 1",
        "dup_files": f"""{docs}, {COUNTS} SELECT key, file,
            row_number() OVER (PARTITION BY key ORDER BY file) AS place
            FROM counts WHERE key IN (SELECT key FROM dups)""",
        "dup_file_map": f"{docs}, {COUNTS} SELECT key, file, n FROM counts WHERE key IN (SELECT key FROM dups)",
        "first_prefix": f"""{docs} SELECT key, count(*) AS n_rows, arg_min(prefix, (file, pos)) AS prefix
            FROM keyed GROUP BY key HAVING count(*) > 1""",
        "dup_report": f"{docs}, {ENTRIES} {_REPORT}",
        "dup_report_texts": f"{texts}, {ENTRIES} {_REPORT}",
        "dup_report_orders": f"{orders}, {ENTRIES} {_REPORT}",
        "dup_report_events_day": _event_report("%Y-%m-%d"),
        "dup_report_events_month": _event_report("%Y-%m"),
        "state_report": f"{folder}, {COUNTS} SELECT key, scope, n_rows, file, n FROM dups JOIN counts USING (key)",
        "report_by_prefix": f"{docs}, {ENTRIES} SELECT DISTINCT prefix, file FROM entries",
        "union_scopes": f"{docs}, {COUNTS} SELECT key, n_files, n_rows, scope FROM dups",
        "dup_summary": f"""{docs}, {COUNTS} SELECT count(*) AS n_keys,
            count(*) FILTER (n_files > 1) AS n_cross_keys FROM dups""",
        "dup_summary_lineitem": f"""{lineitem} SELECT count(*) AS n_keys,
            count(*) FILTER (n_files > 1) AS n_cross_keys FROM totals WHERE n_rows > 1""",
        "line_counts": f"{folder} SELECT file, greatest(count(*) - 1, 0) AS n_lines FROM lines GROUP BY file",
        "within_surplus": f"{docs} SELECT file, count(*) - count(DISTINCT key) AS surplus FROM keyed GROUP BY file",
        "within_surplus_lineitem": """SELECT l_returnflag AS file,
            count(*) - count(DISTINCT (l_partkey, l_suppkey, l_linestatus)) AS surplus
            FROM lineitem GROUP BY l_returnflag""",
        "avg_line_length": f"""{folder}
            SELECT file, round(coalesce(avg(length(line)) FILTER (line <> '' AND line_no > 1), 150.0), 4) AS avg_len
            FROM stripped GROUP BY file""",
        "avg_line_length_sample": f"""{folder}, texts AS (
              SELECT file, length(line) AS len, row_number() OVER (PARTITION BY file ORDER BY line_no) AS rn
              FROM stripped WHERE line <> '' AND line_no > 1)
            SELECT l.file, round(coalesce(avg(len), 150.0), 4) AS avg_len
            FROM (SELECT DISTINCT file FROM lines) l LEFT JOIN texts t ON t.file = l.file AND rn <= 100
            GROUP BY l.file""",
        "deletion_stats": f"{docs}, {STATS} SELECT * FROM stats",
        "deletion_totals": f"""{docs}, {STATS} SELECT
            CAST(sum(n_cross_deleted) AS BIGINT) AS n_cross_deleted,
            count(*) FILTER (n_cross_deleted > 0) AS n_cross_files,
            CAST(sum(n_within_deleted) AS BIGINT) AS n_within_deleted,
            count(*) FILTER (n_within_deleted > 0) AS n_within_files,
            CAST(sum(n_cross_deleted + n_within_deleted) AS BIGINT) AS n_deleted FROM stats""",
        "run_summary": f"""{folder}, {FATES}, numbers AS (SELECT
              (SELECT count(*) FROM lines WHERE line_no > 1) AS n_before,
              (SELECT count(*) FROM fates WHERE fate <> 'kept') AS n_deleted)
            SELECT n_before, n_deleted, n_before - n_deleted AS n_after FROM numbers""",
        "duplicate_rows": f"{docs}, {COUNTS} {rows} FROM keyed WHERE key IN (SELECT key FROM dups)",
        "rows_by_prefix": f"""{docs}, {ENTRIES} {rows} FROM keyed
            WHERE prefix IN (SELECT prefix FROM entries WHERE scope = 'cross')""",
        "deletion_candidates": f"""{docs}, {COUNTS} {rows} FROM keyed
            WHERE key IN (SELECT key FROM totals WHERE n_files > 1)""",
        "remove_rows": f"""{docs}, {FATES} {rows} FROM keyed
            WHERE (file, line) NOT IN (SELECT (file, line) FROM fates WHERE fate = 'cross_deleted')""",
        "dedupe_within": f"{docs} {rows} FROM keyed {first_in_file}",
        "dedupe_within_orders": f"{orders} {rows} FROM keyed {first_in_file}",
        "keep_file": f"{docs} SELECT key, min(file) AS keep_file FROM keyed GROUP BY key",
        "dedupe_cross_only": f"{docs}, {FATES} {rows} FROM fates WHERE file = keep_file",
        "dedupe_all": f"{docs} {rows} FROM keyed {first_of_key}",
        "dedupe_all_orders": f"{orders} {rows} FROM keyed {first_of_key}",
        "dedupe_all_texts": f"{texts} {rows} FROM keyed {first_of_key}",
        "row_fate": f"{docs}, {FATES} SELECT file, pos, keep_file, fate FROM fates",
        "row_fate_orders": f"{orders}, {FATES} SELECT file, pos, keep_file, fate FROM fates",
        "line_numbers": f"{_with(LANG_LINES)} SELECT file, line_no, value FROM lines",
        "report_text": f"{docs}, {ENTRIES} {_TEXT.format(source='(SELECT *, file AS shown FROM entries)')}",
        "report_lines": f"""{docs}, {ENTRIES}, report AS (
            {_TEXT.format(source='(SELECT *, file AS shown FROM entries)')})
            SELECT row_number() OVER (ORDER BY prefix, key, seq, file) AS line_no, text FROM report""",
        "report_empty": """SELECT CASE WHEN max(n) > 1 THEN 'duplicates' ELSE 'No duplicates found.' END AS text
            FROM (SELECT o_orderkey, count(*) AS n FROM orders GROUP BY o_orderkey)""",
        "report_after_delete": f"{docs}, {ENTRIES}, {STATS}, {annotated} {_TEXT.format(source='shown')}",
        "unlisted_files": f"""{docs}, {ENTRIES}, {STATS}
            SELECT '(Within-file duplicates only - ' || file || ')' AS prefix, file, n_within_deleted AS n,
                   file || ' -> Deleted ' || n_within_deleted || ' rows' AS shown
            FROM stats WHERE n_within_deleted > 0
              AND file NOT IN (SELECT file FROM entries WHERE scope = 'cross')""",
        "cleaned_rows": f"{kept_lines} SELECT file, line_no, value FROM kept",
        "rewrite_files": f"""{kept_lines} SELECT file, value,
            row_number() OVER (PARTITION BY file ORDER BY line_no) AS line_no FROM kept""",
    }
