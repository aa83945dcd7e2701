"""Plain models of the operators for single texts and small tables."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def id_bytes(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def crc(ids):
    return zlib.crc32(id_bytes(ids))


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def measures(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    threes = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(threes)
    covered = {i + k for i, t in enumerate(threes) if counts[t] > 1 for k in range(3)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def grams(text, n):
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)}


def linked(a, b, part, whole=100):
    both = len(a & b)
    return both > 0 and whole * both >= part * (len(a) + len(b) - both)


def component_ids(rows, n=4, part=85):
    """Smallest id reachable, for ``(id, text)`` rows, by comparing all pairs."""
    sets = [grams(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if min(len(sets[i]), len(sets[j])) * 100 >= part * max(len(sets[i]), len(sets[j])) and linked(sets[i], sets[j], part):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = root(i)
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    return [(doc, len(sets[i]), least.get(root(i), doc) if sets[i] else doc) for i, (doc, _) in enumerate(rows)]


ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def base_spans(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans)


def base_written(spans):
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
