from samerow.operators.counts import (
    classify,
    count_by_file,
    count_keys,
    dup_summary,
    duplicates,
    within_surplus,
)
from samerow.operators.dedupe import (
    dedupe_all,
    dedupe_cross_only,
    dedupe_within,
    deletion_candidates,
    duplicate_rows,
    keep_file,
    remove_rows,
    row_fate,
    rows_by_prefix,
)
from samerow.operators.entries import (
    cross_prefixes,
    distinct_prefixes,
    file_lists,
    key_files,
    key_summary,
    report_entries,
    surplus_rows,
)
from samerow.operators.numbering import avg_line_length, index_blocks, line_numbers
from samerow.operators.report import (
    ENGLISH,
    HUNGARIAN,
    Labels,
    annotate_entries,
    number_report,
    render_report,
    unlisted_files,
)
from samerow.operators.skew import join_on_key
from samerow.operators.stats import deletion_stats, deletion_totals, input_totals, line_counts, run_summary

__all__ = [
    "ENGLISH",
    "HUNGARIAN",
    "Labels",
    "annotate_entries",
    "avg_line_length",
    "classify",
    "count_by_file",
    "count_keys",
    "cross_prefixes",
    "dedupe_all",
    "dedupe_cross_only",
    "dedupe_within",
    "deletion_candidates",
    "deletion_stats",
    "deletion_totals",
    "distinct_prefixes",
    "dup_summary",
    "duplicate_rows",
    "duplicates",
    "file_lists",
    "index_blocks",
    "input_totals",
    "join_on_key",
    "keep_file",
    "key_files",
    "key_summary",
    "line_counts",
    "line_numbers",
    "number_report",
    "remove_rows",
    "render_report",
    "report_entries",
    "row_fate",
    "rows_by_prefix",
    "run_summary",
    "surplus_rows",
    "unlisted_files",
    "within_surplus",
]
