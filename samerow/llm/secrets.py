"""Secret scans with a trigram index.

Every text matching a rule must hold certain trigrams; which ones is derived from the rule's pattern as a formula
of AND and OR. A task indexes the texts of a slice: for each trigram that some rule asks for, the sorted rows
holding it. A rule's formula is answered by intersecting and uniting these postings, and only the rows found are
searched with the pattern. A rule whose matches need no trigram searches all rows. The index lives with its slice
of the input, so nothing is shuffled and every text is read once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from samerow.llm.tasks import map_batches, slices, text_column

try:  # the parser behind the standard library's re
    from re import _constants as sre, _parser as parser
except ImportError:  # pragma: no cover
    import sre_constants as sre
    import sre_parse as parser


@dataclass(frozen=True)
class Rule:
    """A pattern, and the least length of ``group`` for a match to count. Letters fold in ASCII only."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    fold: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.fold else 0))


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
# Formats of well-known keys and credentials.
MORE = (
    # The whole key: its head, and what keys are made of, white space (also spelled out), headers, long runs of base64,
    # then either short rests of it and the END line of the same label, or one such rest that is a whole line.
    Rule(
        "private_key",
        r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----"
        r"(?:(?:\s|\\[nrt])++(?:[A-Z][A-Za-z0-9-]*:\x20[^\n\\]*+|[A-Za-z0-9+/=]{24,}+))*+"
        r"(?:(?:(?:\s|\\[nrt])++[A-Za-z0-9+/=]{1,23}+){0,3}+(?:\s|\\[nrt])*+-----END \1-----|\s++[A-Za-z0-9+/=]{1,23}+(?=[\x20\t\r]*+(?:\n|\Z)))?+",
    ),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("url_login", r"[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/:@]+@"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9_.=-]{20,}", fold=True),
)

# A formula: None is always true, a string is a trigram, and tuples are ("and", ...) or ("or", ...).
Formula = None | str | tuple


def conjunction(parts: list[Formula]) -> Formula:
    parts = [p for p in dict.fromkeys(parts) if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def alternative(parts: list[Formula]) -> Formula:
    """An alternative without a trigram of its own makes the whole always true."""
    if None in parts:
        return None
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", *parts)


def trigrams(text: str) -> Formula:
    """All trigrams of a literal, folded to lower case as the index is."""
    raw = text.encode().lower()
    return conjunction([raw[i : i + 3].decode("latin-1") for i in range(len(raw) - 2)])


def formula(pattern: str, fold: bool = False) -> Formula:
    """Trigrams that any text matching ``pattern`` must hold.

    A run of literal characters asks for all its trigrams. A choice asks for those of one of its branches, each by
    itself. A choice, what may be absent, and one of several characters end a run.
    """
    return _formula(parser.parse(pattern, re.ASCII | (re.IGNORECASE if fold else 0)))


def _formula(tokens) -> Formula:
    parts: list[Formula] = []
    run = ""

    def close() -> None:
        nonlocal run
        parts.append(trigrams(run))
        run = ""

    for op, arg in tokens:
        if op is sre.LITERAL:
            run += chr(arg)
        elif op is sre.SUBPATTERN:
            close()
            parts.append(_formula(arg[3]))
        elif op is sre.BRANCH:
            close()
            parts.append(alternative([_formula(b) for b in arg[1]]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            close()
            if arg[0] > 0:
                parts.append(_formula(arg[2]))
        elif op is sre.ATOMIC_GROUP:
            close()
            parts.append(_formula(arg))
        elif op is not sre.AT:  # a place takes no character; all else is some unknown character
            close()
    close()
    return conjunction(parts)


def needed(f: Formula) -> set[str]:
    if f is None:
        return set()
    return {f} if isinstance(f, str) else set().union(*map(needed, f[1:]))


class Index:
    """Postings of the trigrams that rules ask for, over one array of texts, with ASCII letters folded."""

    def __init__(self, texts: pa.Array, wanted: list[str]):
        self.n = len(texts)
        self.at = {t: i for i, t in enumerate(wanted)}
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + self.n + 1]
        first, last = int(offsets[0]), int(offsets[-1])
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[first:last]
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
        low = fold[data].astype(np.uint32)
        number = np.zeros(1 << 24, np.uint16)
        for t, i in self.at.items():
            raw = t.encode("latin-1")
            number[raw[0] << 16 | raw[1] << 8 | raw[2]] = i + 1
        found = number[low[:-2] << 16 | low[1:-1] << 8 | low[2:]] if len(low) > 2 else np.zeros(0, np.uint16)
        places = np.flatnonzero(found)
        which = found[places].astype(np.int64) - 1
        row = np.searchsorted(offsets - first, places, "right") - 1
        inside = places + 3 <= offsets[row + 1] - first  # not over the end of a text
        cells = np.unique(which[inside] * self.n + row[inside])
        cuts = np.searchsorted(cells, np.arange(len(wanted) + 1) * self.n)
        self.postings = [cells[a:b] - i * self.n for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]

    def rows(self, f: Formula) -> np.ndarray:
        """Sorted rows that satisfy a formula."""
        if f is None:
            return np.arange(self.n)
        if isinstance(f, str):
            return self.postings[self.at[f]]
        parts = [self.rows(p) for p in f[1:]]
        if f[0] == "or":
            return reduce(np.union1d, parts)
        return reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), sorted(parts, key=len))


Span = tuple[int, int, int]


class Scanner:
    """All rules over one array of texts after another."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.patterns = [r.compiled() for r in rules]
        self.formulas = [formula(r.pattern, r.fold) for r in rules]
        self.wanted = sorted(set().union(*map(needed, self.formulas)))

    def candidates(self, texts: pa.Array) -> list[np.ndarray]:
        """Per rule the sorted rows that its pattern must be tried on."""
        index = Index(texts, self.wanted)
        return [index.rows(f) for f in self.formulas]

    def spans(self, texts: pa.Array) -> dict[int, list[Span]]:
        """``(start, rule, end)`` in code points of every row with a finding, in order."""
        found: dict[int, list[Span]] = {}
        for i, (rule, rows) in enumerate(zip(self.rules, self.candidates(texts))):
            search = self.patterns[i].finditer
            for row in rows.tolist():
                for m in search(texts[row].as_py()):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found.setdefault(row, []).append((m.start(), i, m.end()))
        return {row: sorted(spans) for row, spans in found.items()}


def redact(text: str, spans: list[Span], mark: str) -> str:
    """``text`` with every stretch covered by spans replaced by ``mark``."""
    out, at = [], 0
    for start, _, end in spans:
        if start > at or not out:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def written(spans: list[Span], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[i].kind}:{start}:{end}" for start, i, end in spans)


def map_findings(df: DataFrame, text_col: str, rules: tuple[Rule, ...], emit: Callable, schema: str) -> DataFrame:
    """Scan the whole texts of ``df``; ``emit(batch, texts, spans)`` makes the output batch of each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for each in batches:
            for b in slices(each, text_col):
                texts = text_column(b, text_col)
                yield emit(b, texts, scanner.spans(texts))

    return map_batches(df, run, schema)


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE
) -> DataFrame:
    """``doc_id, n_<kind> of every base rule, base_sha256, spans, n_spans`` of every row.

    Matches of one rule are leftmost and do not overlap; those of different rules may. ``spans`` lists
    ``kind:start:end`` by start, then rule order; ``base_sha256`` is the digest of that list for the base rules
    alone. A null or empty text has no findings. Rows that repeat are scanned like others. Other columns are not
    read.
    """
    rules = (*base, *more)
    names = [f"n_{r.kind}" for r in base]

    def emit(b: pa.RecordBatch, texts: pa.Array, found: dict[int, list[Span]]) -> pa.RecordBatch:
        nothing = hashlib.sha256(b"").hexdigest()
        n = len(texts)
        counts = np.zeros((len(rules), n), np.int64)
        digests, spans = [nothing] * n, [""] * n
        for row, own in found.items():
            for _, i, _ in own:
                counts[i, row] += 1
            of_base = [s for s in own if s[1] < len(base)]
            digests[row] = hashlib.sha256(written(of_base, rules).encode()).hexdigest()
            spans[row] = written(own, rules)
        columns = [pa.array(c) for c in counts[: len(base)]]
        arrays = [b.column(0), *columns, pa.array(digests), pa.array(spans), pa.array(counts.sum(axis=0))]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", *names, "base_sha256", "spans", "n_spans"])

    rows = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text")
    counted = ", ".join(f"{n} bigint" for n in names)
    return map_findings(rows, "text", rules, emit, f"doc_id bigint, {counted}, base_sha256 string, spans string, n_spans bigint")


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", rules: tuple[Rule, ...] = (*BASE, *MORE)) -> DataFrame:
    """``docs`` with every finding in ``text_col`` replaced by ``mark``; null texts stay null, all rows stay."""

    def emit(b: pa.RecordBatch, texts: pa.Array, found: dict[int, list[Span]]) -> pa.RecordBatch:
        at = b.schema.get_field_index(text_col)
        if found:
            out = b.column(at).to_pylist()
            for row, own in found.items():
                out[row] = redact(out[row], own, mark)
            return b.set_column(at, b.schema.field(at), pa.array(out, b.schema.field(at).type))
        return b

    return map_findings(docs, text_col, rules, emit, docs.schema)
