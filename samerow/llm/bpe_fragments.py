"""BPE encoding by forced boundaries, and decoding.

A merge always makes a vocabulary token, so two neighbouring symbols that stand next to each other in no token
are never merged across: the text may be cut there before any merge is tried. A word falls into fragments at
these pairs; fragments are encoded on their own, each distinct one once per worker, and their ids put together.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from samerow.llm.tasks import map_batches, slices, text_column
from samerow.llm.tokens import LONGEST, Memory, join_pieces, visible_bytes

ENCODED = "doc_id bigint, n_tokens bigint, ids array<int>, decoded string, ids_sha256 string, decoded_sha256 string"
_FINAL_SIGMA = "Σ"
# Bytes of fragments that a Python worker remembers.
FRAGMENT_BYTES = 32 << 20


class FragmentBpe:
    """Encoder and decoder of a tokenizer file with word-end BPE behind a split pattern.

    Understood are the normalizers NFC, replacing white space by a space, and lower case; a split by a pattern
    whose matches are the words; the byte-level alphabet; and no decoder. Other files are refused.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        model, pre = j["model"], (j["pre_tokenizer"] or {}).get("pretokenizers", [])
        steps = [n["type"] for n in (j["normalizer"] or {}).get("normalizers", [])]
        known = (
            model["type"] == "BPE"
            and not any(model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            and steps == ["NFC", "Replace", "Lowercase"]
            and [p["type"] for p in pre] == ["Split", "ByteLevel"]
            and pre[0]["invert"] and pre[0]["behavior"] == "Removed"
            and not pre[1]["use_regex"] and not pre[1]["add_prefix_space"]
            and j["decoder"] is None and j["post_processor"] is None
        )
        if not known:
            raise ValueError("this tokenizer file has parts that are not supported")
        self.ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        self.words = regex.compile(pre[0]["pattern"]["Regex"])
        special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.special = special
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.visible = visible_bytes()
        self.tokens = {i: t for t, i in {**self.ids, **special}.items()}
        self.neighbours = self._neighbours()
        self.fragments: dict[tuple[str, bool], tuple[int, ...]] = {}
        self.held = 0  # bytes of the fragments remembered
        self.memory = Memory(self._pieces)
        self.token_text = np.array([self.tokens.get(i, "") for i in range(max(self.tokens) + 1)], dtype=object)

    def _neighbours(self) -> set[str]:
        """Pairs of symbols that stand side by side in some token; a word's last symbol carries the end mark."""
        pairs = set()
        for token in self.ids:
            body = token.removesuffix(self.end) if self.end else token
            pairs.update(body[i : i + 2] for i in range(len(body) - 1))
            if len(body) > 1 and body != token:
                pairs.add(body[-2:] + self.end)
        return pairs

    def fragments_of(self, word: str) -> list[tuple[str, bool]]:
        """The fragments of a word in the byte alphabet; true marks the one at its end."""
        out, first, last = [], 0, len(word) - 1
        for i in range(last):
            pair = word[i : i + 2] + (self.end if i + 1 == last else "")
            if pair not in self.neighbours:
                out.append((word[first : i + 1], False))
                first = i + 1
        out.append((word[first:], True))
        return out

    def _merge(self, fragment: str, at_end: bool) -> tuple[int, ...]:
        """Merge the pair of lowest rank, the leftmost of equal ones, until none is left to merge.

        The parts are a linked list and the pairs a heap, so a fragment of n symbols takes n log n steps. A heap
        entry counts only if both its parts still stand as they did.
        """
        parts: list[str | None] = list(fragment)
        if at_end:
            parts[-1] += self.end
        ranks, n = self.ranks, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        heapify(heap)
        while heap:
            _, i, (left, right) = heappop(heap)
            j = after[i]
            if j >= n or parts[i] != left or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (pair := (parts[a], parts[b])) in ranks:
                    heappush(heap, (ranks[pair], a, pair))
        return tuple(self.ids[p] for p in parts if p is not None)

    def word(self, word: str) -> list[int]:
        """Ids of a word in the byte alphabet."""
        out: list[int] = []
        known = self.fragments
        for fragment in self.fragments_of(word):
            if (ids := known.get(fragment)) is None:
                ids = self._merge(*fragment)
                if len(fragment[0]) <= LONGEST:
                    self.held += 300 + 40 * len(ids)  # with what Python adds
                    if self.held > FRAGMENT_BYTES:
                        known.clear()
                        self.held = 0
                    known[fragment] = ids
            out += ids
        return out

    def _piece(self, text: str) -> list[int]:
        parts = self.cut_special.split(text) if self.cut_special and "<|" in text else [text]
        out: list[int] = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
            # Lower case goes character by character: a final sigma has no form of its own here.
            part = part.lower() if _FINAL_SIGMA not in part else "".join(c.lower() for c in part)
            for w in self.words.findall(part):
                out += self.word(w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.visible))
        return out

    def _pieces(self, texts: list[str]) -> list[bytes]:
        return [array("I", self._piece(t)).tobytes() for t in texts]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts`` in a row, and the number of ids of each. No word spans a space."""
        return join_pieces(texts, self.memory, "")

    def decode(self, ids: np.ndarray) -> str:
        """The tokens, special ones included, with a space between any two."""
        return " ".join(self.token_text[ids].tolist())


_encoders: dict[str, FragmentBpe] = {}


def fragment_bpe(path: str) -> FragmentBpe:
    """The encoder of a file, kept by the Python worker from task to task."""
    if path not in _encoders:
        _encoders[path] = FragmentBpe(path)
    return _encoders[path]


def encode_decode(
    docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = True
) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded, ids_sha256, decoded_sha256`` of every whole text.

    ``keep=False`` leaves ``ids`` and ``decoded`` null and only gives their digests: of the ids as little-endian
    unsigned 32-bit integers, of the decoded text in UTF-8. A null or empty text has no ids and decodes to the
    empty text. Rows that repeat are encoded like others. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = fragment_bpe(tokenizer_file)
        for each in batches:
            for b in slices(each):
                ids, counts = bpe.encode(text_column(b))
                ends = np.cumsum(counts)
                id_sha, text_sha, decoded = [], [], []
                for first, end in zip((ends - counts).tolist(), ends.tolist()):
                    own = ids[first:end]
                    text = bpe.decode(own)
                    id_sha.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                    text_sha.append(hashlib.sha256(text.encode()).hexdigest())
                    decoded.append(text if keep else None)
                lists = pa.nulls(len(counts), pa.list_(pa.int32()))
                if keep:
                    lists = pa.ListArray.from_arrays(
                        pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32))
                    )
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(counts), lists, pa.array(decoded, pa.string()), pa.array(id_sha), pa.array(text_sha)],
                    ["doc_id", "n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"],
                )

    rows = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text")
    return map_batches(rows, run, ENCODED)
