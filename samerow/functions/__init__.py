from samerow.functions.text import (
    DELIMITER,
    N_FIELDS,
    PREFIX_LEN,
    WHITESPACE,
    decode_ignore,
    is_blank,
    key_digest,
    key_fields,
    key_id,
    line_prefix,
    strip_py,
)

__all__ = [
    "DELIMITER",
    "N_FIELDS",
    "PREFIX_LEN",
    "WHITESPACE",
    "decode_ignore",
    "is_blank",
    "key_digest",
    "key_fields",
    "key_id",
    "line_prefix",
    "strip_py",
]
