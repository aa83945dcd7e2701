"""Best-fit packing of token sequences by bin completion with branch and bound.

Documents longer than a sequence are cut into full pieces, of which the first takes the rest. Full pieces fill
a sequence each; all others are packed by their lengths. Only the number of pieces per length matters, a table
of fewer rows than a sequence has tokens, so the search runs on that table however many documents there are:
the largest length left is completed by an undominated filling, and that pattern is used as often as the
counts allow. Waste beyond what the best solution so far could save cuts a branch off; best-fit decreasing
gives the first solution, and later branches begin where sequences of the best one are not full. Each piece then finds its sequence by its rank among the pieces of its length.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from samerow.llm.tasks import map_batches, slices, text_column
from samerow.llm.tokens import byte_encoder, with_end
from samerow.session import save

SEQUENCE = 1024
# Rounds in which a part of the solution is packed anew, the part of its full sequences that is, and how often a
# level leaves its first filling for one of the next few. They bound effort, never what is packed.
ROUNDS, PART, STRAY, NEXT = 100, 0.05, 0.1, 3
# Steps to list the fillings of one sequence.
STEPS = 20_000

PIECES = (
    "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, block bigint, rank bigint, ids array<int>"
)


def sums(lengths: list[int], room: int) -> int:
    """Bit r is set if some lengths, each as often as one likes, add up to r."""
    reach, every = 1, (1 << (room + 1)) - 1
    for x in lengths:
        step = x
        while step <= room and (more := (reach | reach << step) & every) != reach:
            reach, step = more, 2 * step
    return reach


def exact(target: int, lengths: list[int], counts: list[int], reach: int, effort: list[int]) -> Iterator[list[int]]:
    """All choices of ``lengths``, in that order of preference, that add up to ``target``, one after the other.

    ``effort`` holds the steps left; without any the listing ends.
    """
    for i, a in enumerate(lengths):
        for k in range(min(counts[a], target // a), 0, -1):
            rest = target - k * a
            effort[0] -= 1
            if effort[0] < 0:
                return
            if not rest:
                yield [a] * k
            elif reach >> rest & 1:
                for tail in exact(rest, lengths[i + 1 :], counts, reach, effort):
                    yield [a] * k + tail


def fillings(room: int, counts: list[int], top: int, small_first: bool = False) -> Iterator[tuple[int, list[int]]]:
    """All undominated fillings of ``room`` with available lengths up to ``top``: ``(waste, lengths)``, least waste first.

    They are listed as they are asked for. A filling is dominated when one of its lengths, or two of them together,
    could be replaced by an available length that is larger and still fits, or when one more would fit. After
    ``STEPS`` steps the listing ends with the filling of the largest lengths that fit.
    """
    top = min(top, room)
    lengths = [x for x in range(1, top + 1) if counts[x]]
    if not lengths:
        yield room, []
        return
    reach, effort = sums(lengths, room), [STEPS]
    ordered = lengths if small_first else lengths[::-1]
    for waste in range(room - lengths[0] + 1):
        if reach >> (room - waste) & 1:
            for chosen in exact(room - waste, ordered, counts, reach, effort):
                if not waste or not _dominated(waste, chosen, counts, top):
                    yield waste, chosen
        if effort[0] < 0:
            break
    greedy, left = [], room
    for x in reversed(lengths):
        k = min(counts[x], left // x)
        greedy += [x] * k
        left -= k * x
    yield left, greedy


def _dominated(waste: int, chosen: list[int], counts: list[int], top: int) -> bool:
    used = Counter(chosen)

    def spare(first: int, end: int) -> bool:
        return any(counts[x] > used[x] for x in range(first, min(end, top) + 1))

    if spare(1, waste):
        return True
    for i, a in enumerate(chosen):
        if spare(a + 1, a + waste) or any(spare(a + b, a + b + waste) for b in chosen[i + 1 :]):
            return True
    return False


Pattern = tuple[int, tuple[int, ...]]


def best_fit(counts: list[int], size: int) -> list[Pattern]:
    """Best-fit decreasing on counts: ``(times, lengths)`` per pattern.

    Each piece, the largest first, goes where it leaves the least room. Bins with one content are one entry, and
    pieces of one length fill one such bin after the other.
    """
    bins: dict[int, list[Pattern]] = {}  # by room left
    for x in range(size, 0, -1):
        n = counts[x]
        for room in sorted(r for r in bins if r >= x):
            found, bins[room] = bins.pop(room), []
            for times, held in found:
                each = room // x
                full = min(times, n // each)
                rest = (n - full * each) if full < times else 0
                n -= full * each + rest
                for t, k in ((full, each), (1 if rest else 0, rest), (times - full - (rest > 0), 0)):
                    if t:
                        bins.setdefault(room - k * x, []).append((t, held + (x,) * k))
        if n:
            each = size // x
            for t, k in ((n // each, each), (1 if n % each else 0, n % each)):
                if t:
                    bins.setdefault(size - k * x, []).append((t, (x,) * k))
    return [p for found in bins.values() for p in found]


def _use(left: list[int], chosen: list[int]) -> Pattern:
    need = Counter(chosen)
    times = min(left[x] // n for x, n in need.items())
    for x, n in need.items():
        left[x] -= times * n
    return times, tuple(chosen)


def dive(counts: list[int], size: int, waste: int, stray: float, small_first: bool, choose: random.Random) -> list[Pattern] | None:
    """One way down the tree of completions, or None when more than ``waste`` is lost.

    The largest length left is completed by the first undominated filling, at some levels by one of the next that
    lose no more, and the pattern is used as often as the counts allow.
    """
    left, out, top = list(counts), [], size
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return out
        left[top] -= 1
        skip = choose.randint(1, NEXT) if choose.random() < stray else 0
        best: tuple[int, list[int]] | None = None
        for found in islice(fillings(size - top, left, top, small_first), skip + 1):
            if best is None or found[0] <= best[0]:
                best = found
        left[top] += 1
        pattern = _use(left, [top, *best[1]])
        waste -= pattern[0] * best[0]
        if waste < 0:
            return None
        out.append(pattern)


def complete_bins(counts: list[int], size: int, rounds: int = ROUNDS) -> list[Pattern]:
    """Patterns ``(times, lengths)`` that use every counted length, in as few sequences as the search finds.

    ``counts[x]`` is the number of pieces of length x. Best-fit decreasing is the first solution, and a dive without
    detours, which is where bin completion begins, the second. Then branches are tried where they can still gain: of
    the best solution all sequences with waste and some full ones are taken apart, and their pieces are completed
    anew on a path that strays at some levels. A path ends when its waste leaves no way to be as good as what it is
    to replace, and the search when the bound of the total length is met.
    """
    total = sum(x * n for x, n in enumerate(counts))
    bound = -(-total // size)
    choose = random.Random(1)

    def used(patterns: list[Pattern]) -> int:
        return sum(t for t, _ in patterns)

    best = best_fit(counts, size)
    for stray in (0.0, 0.0, STRAY, STRAY):
        found = dive(counts, size, used(best) * size - total, stray, stray > 0, choose)
        if found is not None and used(found) < used(best):
            best = found
    fewest = used(best)
    for _ in range(rounds):
        if fewest <= bound:
            break
        apart = [sum(held) < size or choose.random() < PART for _, held in best]
        old = [p for p, a in zip(best, apart) if a]
        some = [0] * (size + 1)
        for times, held in old:
            for x in held:
                some[x] += times
        room = used(old) * size - sum(x * n for x, n in enumerate(some))
        found = dive(some, size, room, STRAY, choose.random() < 0.5, choose)
        if found is not None and used(found) <= used(old):
            best = [p for p, a in zip(best, apart) if not a] + found
            fewest += used(found) - used(old)
    return best


def assignment(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int, int]]:
    """Rank intervals ``(length, first, end, per_bin, bin, place, offset)``.

    Pieces of ``length`` with ranks from ``first`` to before ``end`` fill bins from ``bin`` on, ``per_bin`` in each,
    beginning at ``offset``.
    """
    taken: Counter = Counter()
    rows, bins = [], 0
    for times, chosen in patterns:
        offset = 0
        for length, n in sorted(Counter(chosen).items(), reverse=True):
            rows.append((length, taken[length], taken[length] + times * n, n, bins, 0, offset))
            taken[length] += times * n
            offset += n * length
        bins += times
    return rows


def cut_pieces(
    docs: DataFrame,
    tokenizer_file: str,
    end_id: int,
    size: int = SEQUENCE,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """Store the pieces of all documents: ``doc_id, piece, start, length, ids_crc32, block, rank, ids``.

    ``block`` is the task that made a piece and ``rank`` counts the pieces of one length in it. ``ids`` is null
    unless asked for.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(tokenizer_file)
        block = TaskContext.get().partitionId()
        ranks = np.zeros(size + 1, np.int64)
        for each in batches:
            for b in slices(each):
                ids, counts = with_end(*encoder.encode(text_column(b)), end_id)
                n_pieces = -(-counts // size)
                doc = np.repeat(np.arange(len(counts)), n_pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                first = counts - (n_pieces - 1) * size
                length = np.where(piece == 0, first[doc], size)
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * size)
                at = np.cumsum(length) - length
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * s : 4 * (s + n)]) for s, n in zip(at.tolist(), length.tolist())]
                # Rank inside the block: pieces before it of the same length, in earlier slices and in this one.
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                group = np.searchsorted(ordered, ordered)
                rank = np.empty(len(length), np.int64)
                rank[order] = ranks[ordered] + np.arange(len(ordered)) - group
                ranks += np.bincount(length, minlength=size + 1)
                out = pa.nulls(len(length), pa.list_(pa.int32()))
                if keep_ids:
                    ends = pa.array(np.append(at, len(ids)), pa.int32())
                    out = pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(doc)),
                        pa.array(piece, pa.int32()),
                        pa.array(start),
                        pa.array(length),
                        pa.array(crcs, pa.int64()),
                        pa.array(np.full(len(length), block)),
                        pa.array(rank),
                        out,
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "block", "rank", "ids"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return save(map_batches(rows, cut, PIECES))


def pack(pieces: DataFrame, size: int = SEQUENCE, rounds: int = ROUNDS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a ``cut_pieces`` table; drops ``block`` and ``rank``."""
    counted = pieces.groupBy("length", "block").agg(F.count("*").alias("n"))
    counted = save(counted)
    lengths = counted.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``size`` rows
    counts = [0] * (size + 1)
    for r in lengths:
        counts[r["length"]] = r["n"]
    rows = assignment(complete_bins(counts, size, rounds))
    names = ["_length", "_first", "_end", "_per_bin", "_bin", "_place", "_offset"]
    columns = list(zip(*rows)) or [()] * len(names)
    intervals = pieces.sparkSession.createDataFrame(pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)}))
    earlier = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("length", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    placed = pieces.join(before, ["length", "block"]).withColumn("_rank", F.col("_before") + F.col("rank"))
    inside = (F.col("length") == F.col("_length")) & F.col("_rank").between(F.col("_first"), F.col("_end") - 1)
    nth = F.col("_rank") - F.col("_first")
    return placed.join(F.broadcast(intervals), inside).select(  # a few patterns per length
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        "ids",
        (F.col("_bin") + F.floor(nth / F.col("_per_bin"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + (nth % F.col("_per_bin")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(
    docs: DataFrame,
    tokenizer_file: str,
    end_id: int,
    size: int = SEQUENCE,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
    rounds: int = ROUNDS,
) -> DataFrame:
    """Pack whole documents, each ended by ``end_id``, into sequences of at most ``size`` tokens.

    One row per piece: ``doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset``. Only documents longer
    than ``size`` are cut, into pieces of ``size`` of which the first takes the rest. A null or empty text is one
    piece, its end id. Null and repeated ids are documents like others. An empty table gives an empty result.
    Other columns are not read.
    """
    return pack(cut_pieces(docs, tokenizer_file, end_id, size, id_col, text_col, keep_ids), size, rounds)
