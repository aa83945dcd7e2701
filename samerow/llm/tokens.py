"""Encoding whole texts with a tokenizer file, fast: every distinct word of a task is encoded once.

A byte-level tokenizer cuts before each space that a visible character follows, so text between two such cuts
is encoded alike wherever it stands. A batch of texts is cut at its spaces by Arrow, distinct pieces are found
by hashing, the tokenizer library encodes those not seen yet, and numpy puts the ids of all texts together.
Texts in which a space has white space on both sides, where cuts depend on what follows, and texts that spell
out a special token go through the library whole.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

# Bytes that a Python worker remembers of words and their ids; then it starts again. Longer words, in characters, are
# not remembered at all.
REMEMBERED = 48 << 20
LONGEST = 64
_BLANK = r"[\x00-\x20\x7f-\x{a0}\x{180e}\x{200b}-\x{200d}\x{feff}\p{Z}]"
_UNSAFE = f"{_BLANK} ({_BLANK}|$)"

_STOPS = ".,!?;:"


def visible_bytes() -> dict[int, int]:
    """The byte-level alphabet: bytes without a visible character of their own get one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in plain]
    return {b: 0x100 + i for i, b in enumerate(hidden)}


_VISIBLE = visible_bytes()
# The character of each byte in the byte-level alphabet; a line break stays, to part texts.
_ALPHABET = np.array([b if b == 0x0A else _VISIBLE.get(b, b) for b in range(256)], "<u4")


class Memory:
    """The ids of words seen before, in a few arrays: 24 bytes a word and four for each of its ids.

    A word is known by 128 bits of its hash, of which the first 64 are sorted and searched.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], size: int | None = None):
        self.encode, self.size = encode, size or REMEMBERED
        self._forget()

    def _forget(self) -> None:
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def held(self) -> int:
        return 24 * len(self.key) + 4 * self.used

    def find(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and for each word where its own begin in it and how many they are. Valid until the next call."""
        if self.held() > self.size:
            self._forget()
        key, check, start, count, known = self._search(words)
        missing = np.flatnonzero(~known)
        if len(missing):
            self._learn(words, missing, key, check, start, count)
        return self.pool, start, count

    def recall(self, words: list[str]) -> dict[str, bytes]:
        """The ids of those ``words`` that are remembered; no others are encoded."""
        _, _, start, count, known = self._search(words)
        return {
            words[i]: self.pool[a : a + n].tobytes()
            for i, a, n in zip(np.flatnonzero(known).tolist(), start[known].tolist(), count[known].tolist())
        }

    def _search(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Both halves of the hash of each word, where its ids are and how many, and whether it is known."""
        digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in words]), np.uint64).reshape(-1, 2)
        key, check = np.ascontiguousarray(digests[:, 0]), digests[:, 1]
        at = np.searchsorted(self.key, key)
        inside = np.minimum(at, max(len(self.key) - 1, 0))
        known = (self.key[inside] == key) & (self.check[inside] == check) if len(self.key) else np.zeros(len(key), bool)
        start, count = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        start[known], count[known] = self.start[inside[known]], self.count[inside[known]]
        return key, check, start, count, known

    def _learn(self, words: list[str], missing: np.ndarray, key, check, start, count) -> None:
        ids = self.encode([words[i] for i in missing.tolist()])
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        short = np.fromiter((len(words[i]) <= LONGEST for i in missing.tolist()), bool, len(ids))
        # Long words go last, where the next call overwrites them.
        order = np.argsort(~short, kind="stable")
        joined = np.frombuffer(b"".join([ids[i] for i in order.tolist()]), np.uint32)
        if self.used + len(joined) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used // 2 + 2 * len(joined), np.uint32)])
        self.pool[self.used : self.used + len(joined)] = joined
        first = np.zeros(len(n), np.int64)
        first[order] = self.used + np.cumsum(n[order]) - n[order]
        start[missing], count[missing] = first, n
        keep = missing[short]
        _, one = np.unique(key[keep], return_index=True)  # sorted, and each word once
        keep = keep[one]
        place = np.searchsorted(self.key, key[keep])
        fresh = (place == len(self.key)) | (self.key[np.minimum(place, max(len(self.key) - 1, 0))] != key[keep]) if len(self.key) else np.ones(len(keep), bool)
        keep, place = keep[fresh], place[fresh]
        self.key, self.check = np.insert(self.key, place, key[keep]), np.insert(self.check, place, check[keep])
        self.start = np.insert(self.start, place, start[keep].astype(np.int32))
        self.count = np.insert(self.count, place, count[keep].astype(np.int32))
        self.used += int(n[short].sum())


def join_pieces(texts: pa.Array, memory: Memory, space: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all ``texts`` in a row, and the number of ids of each.

    Texts are cut at single spaces; ``space`` is put back before all pieces of a text but the first.
    """
    if not len(texts):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    parts = pc.split_pattern(texts, " ")
    offsets = parts.offsets.to_numpy()
    flat = parts.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    encoded = flat.dictionary_encode()
    index = encoded.indices.to_numpy().astype(np.int64)
    words = encoded.dictionary.to_numpy(zero_copy_only=False).tolist()  # far faster than to_pylist
    if space:
        firsts = flat.take(pa.array(offsets[:-1])).to_pylist()
        index[offsets[:-1]] = len(words) + np.arange(len(firsts))
        words = [space + w for w in words] + firsts
    pool, word_start, word_n = memory.find(words)
    piece_n = word_n[index]
    ends = np.cumsum(piece_n)
    total = int(ends[-1])
    shift = word_start[index] - (ends - piece_n)
    out = pool[np.repeat(shift, piece_n) + np.arange(total)]
    upto = np.concatenate([[0], ends])
    return out, upto[offsets[1:]] - upto[offsets[:-1]]


class ByteEncoder:
    """The library's ids, ``add_special_tokens=False``, of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        pre = described["pre_tokenizer"] or {}
        if described["normalizer"] or pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("a byte-level tokenizer without normalizer or prefix space is needed")
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t["content"] for t in described["added_tokens"]]
        self.memory = Memory(self._words)

    def _words(self, words: list[str]) -> list[bytes]:
        """Pieces of letters, with a space before or punctuation behind, go straight to the library's BPE model.

        Their pre-tokens are plain: the letters with their space, and the punctuation. All others go through
        the whole tokenizer.
        """
        letters = [w.rstrip(_STOPS) for w in words]
        plain = [(x[1:] if x[:1] == " " else x).isalpha() for x in letters]
        # A word with punctuation behind has often been seen without.
        seen = self.memory.recall(list({x for x, w, p in zip(letters, words, plain) if p and len(x) < len(w)}))
        new = list({x for x, p in zip(letters, plain) if p and x not in seen})
        seen |= zip(new, self._model(new))
        ends = list({w[len(x) :] for x, w, p in zip(letters, words, plain) if p})
        stops = dict(zip(ends, self._model(ends)))
        out = [seen[x] + stops[w[len(x) :]] if p else b"" for x, w, p in zip(letters, words, plain)]
        rest = [i for i, p in enumerate(plain) if not p]
        for i, ids in zip(rest, self._library([words[i] for i in rest])):
            out[i] = ids
        return out

    def _model(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that are one pre-token each, or empty; none has a line break."""
        raw = _ALPHABET[np.frombuffer("\n".join(texts).encode(), np.uint8)].tobytes().decode("utf-32-le")
        tokenize = self.tokenizer.model.tokenize
        return [array("I", [t.id for t in tokenize(x)]).tobytes() for x in raw.split("\n")]

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts`` in a row, and the number of ids of each."""
        whole = pc.match_substring_regex(texts, _UNSAFE)
        for token in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, token))
        if not pc.any(whole).as_py():
            return join_pieces(texts, self.memory, " ")
        ids, counts = join_pieces(texts.filter(pc.invert(whole)), self.memory, " ")
        slow = [np.frombuffer(x, np.uint32) for x in self._library(texts.filter(whole).to_pylist())]
        ends = np.cumsum(counts)
        fast = iter(np.split(ids, ends[:-1]) if len(counts) else [])
        rest = iter(slow)
        each = [next(rest) if w else next(fast) for w in whole.to_pylist()]
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)


_encoders: dict[str, ByteEncoder] = {}


def byte_encoder(path: str) -> ByteEncoder:
    """The encoder of a file, kept by the Python worker from task to task."""
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after the ids of each text."""
    out = np.insert(ids, np.cumsum(counts), end_id).astype(np.uint32, copy=False)
    return out, counts + 1
