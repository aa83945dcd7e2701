from samerow.sources.files import LINE_SUFFIXES, key_lines, keyed, line_scans, list_inputs, mark_headers, read_lines
from samerow.sources.sinks import WITHOUT_CHECKSUMS, read_rewritten, rewrite, write_report
from samerow.sources.snapshot import changed_files, require_unchanged, snapshot
from samerow.sources.tables import chunked, drop_first_rows, rows_from_lines, rows_from_table, split_lines

__all__ = [
    "LINE_SUFFIXES",
    "WITHOUT_CHECKSUMS",
    "changed_files",
    "chunked",
    "drop_first_rows",
    "key_lines",
    "keyed",
    "line_scans",
    "list_inputs",
    "mark_headers",
    "read_lines",
    "read_rewritten",
    "require_unchanged",
    "rewrite",
    "rows_from_lines",
    "rows_from_table",
    "snapshot",
    "split_lines",
    "write_report",
]
