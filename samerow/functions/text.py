"""Column expressions on text lines. All of them are native and run in whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The defaults of the command-line options.
DELIMITER = ";"
N_FIELDS = 6
PREFIX_LEN = 47

# The code points Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

_REPLACEMENT = "\ufffd"
_ESCAPE = "\ue000"


def _solid_ascii(col: Column, position: int) -> Column:
    """Is the byte at ``position`` an ASCII character other than whitespace? False for an empty string."""
    byte = F.substring(col.cast("binary"), position, 1)
    return (byte > F.lit(b"\x20")) & (byte < F.lit(b"\x80"))


def strip_py(col: Column) -> Column:
    """Remove leading and trailing Unicode whitespace, as Python's ``str.strip`` does.

    Trimming a set of characters looks at every character of a line, so lines that need none skip it.
    """
    clean = _solid_ascii(col, 1) & _solid_ascii(col, -1)
    return F.when(clean, col).otherwise(F.btrim(col, F.lit(WHITESPACE)))


def is_blank(col: Column) -> Column:
    """True for a line of whitespace only."""
    return ~_solid_ascii(col, 1) & (F.ltrim(col, F.lit(WHITESPACE)) == "")


def decode_ignore(col: Column) -> Column:
    """Drop the bytes that are not valid UTF-8 and keep everything else.

    ``make_valid_utf8`` puts U+FFFD where bad bytes were. A U+FFFD that is really in the data is escaped
    first, so that only the inserted ones are removed. Valid strings skip all of this.
    """
    escaped = F.replace(
        F.replace(col, F.lit(_ESCAPE), F.lit(_ESCAPE + "0")), F.lit(_REPLACEMENT), F.lit(_ESCAPE + "1")
    )
    cleaned = F.replace(F.make_valid_utf8(escaped), F.lit(_REPLACEMENT), F.lit(""))
    unescaped = F.replace(
        F.replace(cleaned, F.lit(_ESCAPE + "1"), F.lit(_REPLACEMENT)), F.lit(_ESCAPE + "0"), F.lit(_ESCAPE)
    )
    return F.when(F.is_valid_utf8(col), col).otherwise(unescaped)


def key_fields(col: Column, delimiter: str = DELIMITER, n: int = N_FIELDS) -> Column:
    """The first ``n`` fields of a line; the whole line if it has fewer. Fields are not trimmed."""
    if n < 1:
        raise ValueError(f"number of key fields must be at least 1, not {n}")
    if not delimiter:
        raise ValueError("the delimiter must not be empty")
    if not _overlaps_itself(delimiter):
        return F.substring_index(col, delimiter, n)
    # substring_index also counts overlapping matches ("aa" twice in "aaa"), a split does not.
    pattern = "".join(c if c.isalnum() else "\\" + c for c in delimiter)
    return F.array_join(F.slice(F.split(col, pattern, n + 1), 1, n), delimiter)


def _overlaps_itself(delimiter: str) -> bool:
    return any(delimiter[:i] == delimiter[-i:] for i in range(1, len(delimiter)))


def line_prefix(col: Column, length: int = PREFIX_LEN, tabs_to_spaces: bool = False) -> Column:
    """The part of a line that reports show, counted in code points."""
    if length < 1:
        raise ValueError(f"prefix length must be at least 1, not {length}")
    shown = F.substring(col, 1, length)
    return F.replace(shown, F.lit("\t"), F.lit(" ")) if tabs_to_spaces else shown


def key_digest(col: Column) -> Column:
    """SHA-256 of a key in hex, for handing very wide keys around. Detection compares whole keys or verifies them."""
    return F.sha2(col, 256)


def key_id(col: Column) -> Column:
    """The same as 32 bytes: what wide keys are grouped by before they are compared."""
    return F.unhex(key_digest(col))
