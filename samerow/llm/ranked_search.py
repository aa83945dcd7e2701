"""Ranked lexical search by best-first splitting of document intervals.

A first pass over the documents keeps of each only what queries ask for: the numbers of the query terms it holds, how
often, and how many terms it has. Counts over all documents come from that table, and a second pass searches it.

A task of the second pass takes documents in slices and inverts each slice: one posting list per term, the impacts of
its documents, and over each list a sparse table that answers in two lookups which posting of a range has the largest
impact. No document of an interval scores more than the sum of the answers of all query terms. The search begins with
the whole slice, takes the intervals with the largest sums, scores the document at the largest impact of each and
splits the interval there; intervals whose sum is below the k-th best score so far are given up. Scores found in
earlier slices of a task count, so most of a later slice is given up as a whole.

Documents that agree in all that a score depends on have one score, so of more than k in a slice only the k first by
id are searched; no other could be among the k best.

Queries are taken in blocks with a bounded number of bytes of terms, the only thing that is sent to all tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from samerow.llm.tasks import map_batches, slices, text_column
from samerow.session import save

# Bytes of query texts in a block: bounds what is sent to every task.
BLOCK_BYTES = 4 << 20
# Text at once in the first pass, and postings and documents at once in the second.
TEXT_BYTES = 2 << 20
SLICE_POSTINGS = 400_000
SLICE_DOCS = 1 << 15
# Term and interval pairs looked up at once.
LOOKUPS = 1 << 16

# ASCII characters of terms, of which capitals are folded. All other bytes are parts of letters.
_TERM = np.arange(256, dtype=np.uint8)
_TERM[[b for b in range(128) if not chr(b).isalnum()]] = 0x20
_TERM[65:91] += 32

VECTORS = "doc_id bigint, n bigint, terms array<int>, counts array<int>"
HITS = "item int, doc_id bigint, score bigint"


def split_terms(texts: pa.Array) -> pa.Array:
    """Terms of all texts, as lists that hold empty strings too."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    folded = pa.LargeStringArray.from_buffers(
        len(texts), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(_TERM[raw].tobytes())
    )
    return pc.split_pattern(folded, " ")


def terms_of(text: str) -> list[str]:
    return [t for t in split_terms(pa.array([text], pa.large_string()))[0].as_py() if t]


@dataclass(frozen=True)
class Queries:
    """A block of queries: ``numbers`` of the terms, and for each query its terms and how often it asks for each."""

    ids: list
    numbers: dict[str, int]
    terms: list[np.ndarray]
    times: list[np.ndarray]


def query_blocks(queries: DataFrame, id_col: str, text_col: str, limit: int = BLOCK_BYTES) -> Iterator[Queries]:
    """All queries, in blocks of at most ``limit`` bytes of text or one query; a null text has no terms."""
    rows = queries.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids, texts, held = [], [], 0
    for row in rows.toLocalIterator():
        n = len(row["text"].encode())
        if texts and held + n > limit:
            yield _block(ids, texts)
            ids, texts, held = [], [], 0
        ids.append(row["id"])
        texts.append(row["text"])
        held += n
    if texts:
        yield _block(ids, texts)


def _block(ids: list, texts: list[str]) -> Queries:
    numbers: dict[str, int] = {}
    terms, times = [], []
    for text in texts:
        asked = Counter(terms_of(text))
        terms.append(np.array([numbers.setdefault(t, len(numbers)) for t in asked], np.int64))
        times.append(np.array(list(asked.values()), np.int64))
    return Queries(ids, numbers, terms, times)


def term_vectors(docs: DataFrame, numbers: dict[str, int], id_col: str, text_col: str) -> DataFrame:
    """Store ``doc_id, n, terms, counts`` of every row with a term: all its terms, and the numbered ones it holds."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for each in batches:
            for b in slices(each, limit=TEXT_BYTES):
                lists = split_terms(text_column(b))
                cuts = lists.offsets.to_numpy()
                encoded = lists.values.dictionary_encode()
                words = encoded.dictionary.to_pylist()
                # Terms that no query asks for become -1, empty strings -2.
                number = np.fromiter((known.get(w, -1) if w else -2 for w in words), np.int64, len(words))
                of = number[encoded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
                n = _per_list((of > -2).astype(np.int64), cuts)
                row = np.repeat(np.arange(len(n)), np.diff(cuts))
                asked = of >= 0
                cell, count = np.unique(row[asked] * len(known) + of[asked], return_counts=True)
                holder = cell // max(len(known), 1)
                some = n > 0
                upto = np.searchsorted(holder, np.arange(len(n) + 1))
                counts, terms = (pa.array(x.astype(np.int32)) for x in (count, cell % max(len(known), 1)))
                offsets = pa.array(upto.astype(np.int32))
                out = pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        pa.array(n),
                        pa.ListArray.from_arrays(offsets, terms),
                        pa.ListArray.from_arrays(offsets, counts),
                    ],
                    ["doc_id", "n", "terms", "counts"],
                )
                yield out.filter(pa.array(some))

    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return save(map_batches(wanted, run, VECTORS))


def _per_list(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(values)])
    return upto[cuts[1:]] - upto[cuts[:-1]]


@dataclass(frozen=True)
class Counts:
    """Documents with a term, their terms, and the weight of each numbered term."""

    n_docs: int
    n_terms: int
    weights: np.ndarray

    def impacts(self, terms: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What a term that stands ``tf`` times among ``n`` terms adds to a score."""
        m = 25 + (75 * n * self.n_docs) // self.n_terms
        return self.weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def corpus_counts(vectors: DataFrame, n_numbers: int) -> Counts:
    """From the stored vectors; the driver sees one number per query term of a block."""
    total = vectors.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    held = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    df = np.zeros(n_numbers, np.int64)
    for row in held.toLocalIterator():
        df[row["term"]] = row["df"]
    n = total["docs"]
    weights = np.floor(1000 * np.log((2.0 * n + 2) / (2.0 * df + 1))).astype(np.int64)
    return Counts(n, total["terms"], weights)


class Postings:
    """The inverted slice: one list after the other, sorted by term and document, under one packed sparse table."""

    def __init__(self, row: np.ndarray, term: np.ndarray, impact: np.ndarray, n_rows: int):
        self.n_rows = n_rows
        order = np.argsort(term * n_rows + row, kind="stable")
        self.row, self.impact = row[order], impact[order]
        self.key = term[order] * n_rows + self.row
        longest = int(np.bincount(term).max()) if len(term) else 0
        # Row k holds for each posting the place of the largest impact among it and the 2 ** k - 1 after it.
        best = np.arange(len(self.row), dtype=np.int32)
        self.table = [best]
        for k in range(max(longest, 1).bit_length() - 1):
            a, b = self.table[k][: -(1 << k)], self.table[k][1 << k :]
            wider = self.table[k].copy()
            wider[: len(a)] = np.where(self.impact[b] > self.impact[a], b, a)
            self.table.append(wider)
        self.flat = np.concatenate(self.table)

    def at(self, terms: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Place of the first posting of each term at or after each row: a matrix, intervals by terms."""
        return np.searchsorted(self.key, terms[None, :] * self.n_rows + row[:, None])

    def largest(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place of the largest impact in each range of one list; -1 for an empty range."""
        size = end - first
        some = size > 0
        k = np.frexp(np.maximum(size, 1).astype(np.float64))[1].astype(np.int64) - 1
        base = k * len(self.row)
        a = self.flat[np.where(some, base + first, 0)]
        b = self.flat[np.where(some, base + end - (1 << k), 0)]
        return np.where(some, np.where(self.impact[b] > self.impact[a], b, a), -1)


class Best:
    """The k best documents of one query so far: larger scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """A document must reach this score."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        fit = score >= self.least
        if fit.any():
            score, doc = np.concatenate([self.score, score[fit]]), np.concatenate([self.doc, doc[fit]])
            order = np.lexsort((doc, -score))[: self.k]
            self.score, self.doc = score[order], doc[order]


def search(postings: Postings, doc: np.ndarray, terms: np.ndarray, times: np.ndarray, best: Best) -> int:
    """Put the documents of a slice that are among the best of a query into ``best``; returns how many were scored."""
    if not postings.n_rows or not len(terms) or not len(postings.row):
        return 0
    batch = max(1, LOOKUPS // len(terms))
    first, end = (postings.at(terms, np.array([r])) for r in (0, postings.n_rows))
    bound, split = _bounds(postings, first, end, times)
    open_ = [(first, end, bound, split)]
    scored, width = 0, 1
    while True:
        first, end, bound, split = (np.concatenate(x) for x in zip(*open_))
        alive = bound >= best.least
        first, end, bound, split = first[alive], end[alive], bound[alive], split[alive]
        if not len(bound):
            return scored
        # The best ones now, twice as many each time; the others wait.
        width = min(2 * width, batch)
        chosen = np.argsort(-bound, kind="stable")[:width]
        rest = np.ones(len(bound), bool)
        rest[chosen] = False
        row = postings.row[split[chosen]]
        left_end, right_first = postings.at(terms, row), postings.at(terms, row + 1)
        held = right_first > left_end
        at = np.where(held, left_end, 0)
        score = (np.where(held, postings.impact[at], 0) * times).sum(axis=1)
        best.add(score, doc[row])
        scored += len(row)
        open_ = [(first[rest], end[rest], bound[rest], split[rest])]
        for a, b in ((first[chosen], left_end), (right_first, end[chosen])):
            bound_, split_ = _bounds(postings, a, b, times)
            some = bound_ >= best.least
            open_.append((a[some], b[some], bound_[some], split_[some]))


def _bounds(postings: Postings, first: np.ndarray, end: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each interval the sum of the largest impacts of all terms, and the place of the largest summand."""
    place = postings.largest(first, end)
    part = np.where(place >= 0, postings.impact[np.maximum(place, 0)], 0) * times
    most = part.argmax(axis=1)
    return part.sum(axis=1), np.take_along_axis(place, most[:, None], 1)[:, 0]


def searched(vectors: DataFrame, queries: Queries, counts: Counts, k: int) -> DataFrame:
    """``item, doc_id, score``: the k best documents per task and query of a block; ``item`` is its place there."""
    shared = vectors.sparkSession.sparkContext.broadcast((queries.terms, queries.times, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, times, known = shared.value
        best = [Best(k) for _ in terms]
        for each in batches:
            for b in _bounded(each):
                doc, postings = _inverted(b, known, k)
                for q, found in enumerate(best):
                    search(postings, doc, terms[q], times[q], found)
        item = np.repeat(np.arange(len(best), dtype=np.int32), [len(x.score) for x in best])
        score, doc = (np.concatenate([np.zeros(0, np.int64), *parts]) for parts in zip(*[(x.score, x.doc) for x in best]))
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc), pa.array(score)], ["item", "doc_id", "score"])

    return map_batches(vectors, run, HITS)


def _bounded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
    block = np.maximum(np.cumsum(sizes) // SLICE_POSTINGS, np.arange(len(sizes)) // SLICE_DOCS)
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _inverted(batch: pa.RecordBatch, counts: Counts, k: int) -> tuple[np.ndarray, Postings]:
    """Ids of the slice's documents and their postings, similar documents side by side."""
    ids = batch.column(0)
    null = ids.is_null().to_numpy(zero_copy_only=False)
    doc = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
    n = batch.column(1).to_numpy()
    lists = batch.column(2)
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    term = lists.flatten().to_numpy().astype(np.int64)
    tf = batch.column(3).flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(n)), size)
    # Two numbers stand for all that a score depends on. Equal rows become neighbours, by id; the rarest term
    # goes first, so documents about one thing are neighbours too and intervals tell little about others.
    mixed = (term * 0x9E3779B97F4A7C1 + tf * 0x2545F4914F6CDD1D) * 0x5851F42D4C957F2D
    mixed ^= mixed >> 29
    cuts = np.concatenate([[0], np.cumsum(size)])
    one = _per_list(mixed * 0x27BB2EE687B0B0FD, cuts)
    two = _per_list((mixed ^ (mixed >> 31)) * 0x14057B7EF767814F, cuts)
    rarity = counts.weights[term] if len(term) else np.zeros(0, np.int64)
    rank = np.zeros(len(n), np.int64)
    np.maximum.at(rank, row, rarity << 32 | term)
    order = np.lexsort((doc, two, one, n, rank))
    same = np.ones(len(order), bool)
    for x in (n, one, two):
        same &= np.append(False, x[order][1:] == x[order][:-1])
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    kept = order[(np.arange(len(order)) - start < k) & ~null[order] & (size[order] > 0)]
    place = np.full(len(n), -1, np.int64)
    place[kept] = np.arange(len(kept))
    here = place[row] >= 0
    impact = counts.impacts(term[here], tf[here], n[row[here]])
    useful = impact > 0
    return doc[kept], Postings(place[row[here]][useful], term[here][useful], impact[useful], len(kept))


def rank_documents(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_id_col: str = "item_id",
    query_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents with the highest scores above 0 for each query.

    Terms are runs of ASCII letters and digits and all other characters beyond ASCII; only A to Z are folded. A term
    that a query repeats counts each time. Documents with equal scores are ranked by id.

    A null or empty text has no terms: as a document it counts nowhere, as a query it finds nothing. Rows of
    documents that repeat are documents of their own, ranked one after the other; one with a null id counts in all
    statistics but is never returned. Queries that repeat, or share an id, are answered each. Empty tables give
    an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    kind = queries.schema[query_id_col].dataType.simpleString()
    found = []
    for block in query_blocks(queries, query_id_col, query_text_col, block_bytes):
        if not block.numbers:
            continue
        vectors = term_vectors(docs, block.numbers, id_col, text_col)
        counts = corpus_counts(vectors, len(block.numbers))
        if not counts.n_terms:
            continue
        hits = searched(vectors, block, counts, k)
        best = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        top = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        asked = spark.createDataFrame(list(enumerate(block.ids)), f"item int, item_id {kind}")
        found.append(save(top.join(asked, "item").select("item_id", "rank", "doc_id", "score")))
    if not found:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
