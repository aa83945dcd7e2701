"""N-gram Jaccard join by parity sketches.

A text's set are the hashes of its word n-grams. Each gram toggles one bit of a sketch, so the sketches of two
sets differ in at most as many bits as the sets have grams not shared, and so do any parts the sketch is split
into: at most d of its bands can differ for two sets that must not differ in more than d grams. With more than d
bands, linked sets agree in some band. Sets are compared inside classes of similar size, for which d is known.

A band's bits are kept as one number: the exclusive or of a random word per bit. A set leaves out its emptiest
bands, as many as the bound for its own size leaves spare; a linked pair still agrees in a band both kept. Sets
that share a band are joined, and the full sets of a pair decide.

Links inside one component need not all be found. In a first round each set is verified against one set of each
of its bands, the one that shares most bands with others; in a group of near copies that is the text they come
from. In a second round all pairs of sets that share a band but are still in different components are compared by
a short sketch of the whole set, bits against bits; only pairs whose Hamming distance allows a link go on to be
verified. Both rounds together miss no link between components.

Long sets fill the short sketch, so they have a wide one too, with a bit per gram or more. The pairs that the short
sketch lets through are compared by it before their texts are fetched: texts are moved for few pairs but the linked ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from samerow.llm.components import components
from samerow.llm.tasks import map_batches, slices, text_column
from samerow.operators.bitmaps import only, words
from samerow.session import pin_splits, save

# The white space that ends a word, and letters folded to lower case.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0x20
_FOLD[65:91] += 32

# Words of 64 bits in the sketch of a whole set.
SKETCH = 16
SKETCH_WORDS = [f"s{i}" for i in range(SKETCH)]
SETS = "row bigint, doc_id bigint, node bigint, other bigint, n_shingles bigint, wide binary, " + ", ".join(f"{w} bigint" for w in SKETCH_WORDS)
KEYS = "key bigint, node bigint"


@dataclass(frozen=True)
class Similarity:
    """Linked are sets with ``whole * intersection >= part * union``, of grams of ``n`` words."""

    n: int = 4
    part: int = 85
    whole: int = 100
    seed: int = 1

    def __post_init__(self):
        if not (self.n >= 1 and 0 < self.part <= self.whole):
            raise ValueError("n must be positive and part at most whole")

    def differing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Grams that linked sets of sizes ``a`` and ``b`` can hold one without the other, at most."""
        return (self.whole - self.part) * (a + b) // (self.whole + self.part)

    def classes(self, largest: int) -> np.ndarray:
        """First size of each size class up to beyond ``largest``; linked sizes lie in one or two neighbours."""
        firsts = [1]
        while firsts[-1] <= largest:
            step = -(-firsts[-1] * self.whole**2 // self.part**2)
            firsts.append(max(firsts[-1] + 1, step))
        return np.array([*firsts, max(firsts[-1] + 1, -(-firsts[-1] * self.whole**2 // self.part**2))], np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers in which every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_sets(texts: pa.Array, similarity: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct gram hashes of all texts in a row, and the size of each text's set."""
    n_texts = len(texts)
    if not n_texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n_texts + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    folded = pa.LargeStringArray.from_buffers(
        n_texts, pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(_FOLD[raw].tobytes())
    )
    parts = pc.split_pattern(folded, " ")
    cuts = parts.offsets.to_numpy()
    encoded = parts.values.dictionary_encode()
    index = encoded.indices.to_numpy()
    words = encoded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, similarity.seed) for w in words), np.uint64, len(words))
    empty = words.index("") if "" in words else -1
    real = index != empty
    upto = np.concatenate([[0], np.cumsum(real)])[cuts]
    n_words = np.diff(upto)
    words_of = hashes[index[real]]
    # A text of fewer than n words has one gram, all of them; other lengths get other multipliers.
    n = similarity.n
    n_grams = np.where(n_words >= n, n_words - n + 1, np.minimum(n_words, 1))
    first = np.repeat(upto[:-1], n_grams) + _places(n_grams)
    length = np.repeat(np.minimum(n_words, n), n_grams)
    grams = np.zeros(len(first), np.uint64)
    for k in range(n):
        inside = k < length
        factor = mix(length[inside].astype(np.uint64) + np.uint64(similarity.seed << 32 | k << 16))
        grams[inside] = mix(grams[inside] + words_of[first[inside] + k] * (factor | np.uint64(1)))
    ends = np.cumsum(n_grams)
    out, sizes = [], np.zeros(n_texts, np.int64)
    for i, (a, b) in enumerate(zip((ends - n_grams).tolist(), ends.tolist())):
        own = np.unique(grams[a:b])
        sizes[i] = len(own)
        out.append(own)
    return np.concatenate(out), sizes


def _places(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of ``counts``, in a row."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def set_numbers(grams: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent numbers of each set; texts with one set get the same ones."""
    ends = np.cumsum(sizes)
    one, two = (_sums(mix(grams ^ np.uint64(salt)), ends, sizes).view(np.int64) for salt in (0x1234567, 0x89ABCDEF))
    return one, two


def _sums(values: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return mix(total[ends] - total[ends - sizes])


def sketches(grams: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The words of each set's sketch: every gram toggles one of its bits."""
    bits = 64 * SKETCH
    bit = _bits(grams, bits)
    ends = np.cumsum(sizes)
    found = np.zeros((len(sizes), SKETCH), np.int64)
    for first in range(0, len(sizes), 1024):  # a byte per bit and set is held for so many sets
        some = sizes[first : first + 1024]
        cells = np.repeat(np.arange(len(some)) * bits, some) + bit[ends[first] - sizes[first] : ends[first + len(some) - 1]]
        odd = (np.bincount(cells, minlength=len(some) * bits) & 1).astype(np.uint8)
        found[first : first + 1024] = np.packbits(odd).view(np.int64).reshape(len(some), SKETCH)
    return [np.ascontiguousarray(found[:, i]) for i in range(SKETCH)]


def _bits(grams: np.ndarray, bits: int) -> np.ndarray:
    """The bit that each gram toggles in a sketch of ``bits``, a power of two."""
    return (mix(grams ^ np.uint64(0x2545F491)) & np.uint64(bits - 1)).astype(np.int64)


def wide_sketches(grams: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    """A sketch with a bit per gram or more for each set too large for the short one, none for others."""
    found: list[bytes | None] = [None] * len(sizes)
    ends = np.cumsum(sizes)
    for i in np.flatnonzero(sizes > 64 * SKETCH).tolist():
        bits = 1 << (int(sizes[i]) - 1).bit_length()
        odd = np.bincount(_bits(grams[ends[i] - sizes[i] : ends[i]], bits), minlength=bits) & 1
        found[i] = np.packbits(odd.astype(np.uint8)).tobytes()
    return found


def differing_bits(one: bytes, two: bytes) -> int:
    """Bits that differ in two wide sketches; the larger is folded, which gives the smaller sketch of the same set."""
    n = min(len(one), len(two)) // 8
    a, b = (np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, n), axis=0) for x in (one, two))
    return int(np.bitwise_count(a ^ b).sum())


def band_keys(grams: np.ndarray, sizes: np.ndarray, similarity: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the kept bands of all sets, and the number of the set that each belongs to."""
    firsts = similarity.classes(int(sizes.max(initial=0)))
    own = np.searchsorted(firsts, sizes, "right") - 1
    some = sizes > 0
    # In its own class, and in the next one if that has sets it could be linked with.
    reaches = similarity.whole * sizes >= similarity.part * firsts[np.minimum(own + 1, len(firsts) - 1)]
    keys, sets = [], []
    for up, member in ((0, some), (1, some & reaches)):
        chosen = np.flatnonzero(member)
        if not len(chosen):
            continue
        size, group = sizes[chosen], own[chosen] + up
        most = firsts[group + 1] - 1
        worst = similarity.differing(most, most)
        spare = np.where(worst > 0, worst // 10 + 1, 0)
        bands = worst + 1 + 2 * spare
        partner = np.minimum(most, size * similarity.whole // similarity.part)
        dropped = (bands - 1 - similarity.differing(size, partner)) // 2
        mine = np.repeat(member, sizes)
        own_grams = grams[mine]
        of = np.repeat(np.arange(len(chosen)), size)
        # High bits choose the band, a mix of all is the word that the gram toggles.
        band = ((own_grams >> np.uint64(32)) * bands[of].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        base = np.cumsum(bands) - bands
        cell = base[of] + band
        order = np.argsort(cell, kind="stable")
        ordered = cell[order]
        start = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, int)
        word = np.zeros(int(bands.sum()), np.uint64)
        held = np.zeros(len(word), np.int64)
        word[ordered[start]] = np.bitwise_xor.reduceat(mix(own_grams ^ np.uint64(0x5DEECE66D))[order], start)
        held[ordered[start]] = np.diff(np.append(start, len(ordered)))
        doc = np.repeat(np.arange(len(chosen)), bands)
        place = _places(bands)
        by_load = np.lexsort((held, doc))
        kept = by_load[place >= dropped[doc]]  # by_load keeps sets in order, so places count its ranks too
        salt = mix((group[doc[kept]] << 32 | place[kept]).astype(np.uint64))
        keys.append(mix(word[kept] ^ salt))
        sets.append(chosen[doc[kept]])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys).view(np.int64), np.concatenate(sets)


def number_sets(docs: DataFrame, id_col: str, text_col: str, similarity: Similarity) -> DataFrame:
    """Store ``row, doc_id, node, other, n_shingles`` and sketches of every row.

    ``node`` and ``other`` are null without words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for each in batches:
            for b in slices(each):
                grams, sizes = gram_sets(text_column(b), similarity)
                node, other = set_numbers(grams, sizes)
                none = sizes == 0
                arrays = [b.column(0), b.column(1), pa.array(node, mask=none), pa.array(other, mask=none), pa.array(sizes)]
                arrays += [pa.array(wide_sketches(grams, sizes), pa.binary()), *map(pa.array, sketches(grams, sizes))]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "node", "other", "n_shingles", "wide", *SKETCH_WORDS])

    pin_splits(docs.sparkSession)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")
    )
    return save(map_batches(rows, run, SETS))


def shared_bands(docs: DataFrame, text_col: str, similarity: Similarity) -> DataFrame:
    """Store ``key, node, lead`` of all bands that more than one set has.

    ``lead`` is that set of the band which has most company in all its bands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # sets of this task: copies are sent on once
        for each in batches:
            for b in slices(each):
                grams, sizes = gram_sets(text_column(b), similarity)
                node, _ = set_numbers(grams, sizes)
                new = np.zeros(len(node), bool)
                for i, x in enumerate(node.tolist()):
                    if x not in seen:
                        seen.add(x)
                        new[i] = True
                keys, sets = band_keys(grams[np.repeat(new, sizes)], sizes[new], similarity)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(node[new][sets])], ["key", "node"])

    keyed = map_batches(docs.select(F.col(text_col).alias("text")), run, KEYS)
    same = Window.partitionBy("key")
    ends = keyed.select("key", "node", F.min("node").over(same).alias("least"), F.max("node").over(same).alias("most"))
    shared = save(ends.filter(F.col("least") < F.col("most")).select("key", "node").distinct())
    company = shared.groupBy("key").agg(F.count("*").alias("n"))
    known = shared.join(company, "key").groupBy("node").agg(F.sum("n").alias("known"))
    leads = shared.join(known, "node").groupBy("key").agg(F.max(F.struct("known", "node"))["node"].alias("lead"))
    return save(shared.join(leads, "key"))


def known_sets(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Store the first row of each set in ``nodes``, with its size and sketches."""
    first = sets.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("row").alias("row"))
    return save(sets.join(first, ["node", "row"]).select("node", "row", "n_shingles", "wide", *SKETCH_WORDS))


def within_reach(pairs: DataFrame, known: DataFrame, similarity: Similarity) -> DataFrame:
    """Store the ``pairs`` (``a, b``) whose wide sketches leave room for a link; without them a pair stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [
                one is None or two is None or differing_bits(one, two) <= similarity.differing(n_one, n_two)
                for n_one, one, n_two, two in zip(*(b.column(i).to_pylist() for i in range(2, 6)))
            ]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])

    one, two = (
        known.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("wide").alias(f"wide_{x}")) for x in "ab"
    )
    joined = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "n_a", "wide_a", "n_b", "wide_b")
    return save(map_batches(joined, run, "a bigint, b bigint"))


def set_texts(docs: DataFrame, text_col: str, known: DataFrame, pairs: DataFrame) -> DataFrame:
    """Store ``node, text`` of one row of ``docs`` for each set in ``pairs``. No other text is moved."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    rows = save(known.select("node", "row").join(ends, "node", "left_semi"))
    placed = docs.select(F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    return save(only(placed, words(rows, "row"), "row").join(rows, "row").select("node", "text"))


def verified(pairs: DataFrame, texts: DataFrame, similarity: Similarity) -> DataFrame:
    """Store the ``pairs`` (``a, b``) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None  # rows come sorted by b, whose set is then made once
        for each in batches:
            for b in slices(each, "text_a"):
                grams, sizes = gram_sets(text_column(b, "text_a"), similarity)
                if (set_numbers(grams, sizes)[0] != b.column(0).to_numpy()).any():
                    raise RuntimeError("rows changed their places between two scans: store the documents first")
                ends = np.cumsum(sizes).tolist()
                keep = []
                for i, (other, end, size) in enumerate(zip(b.column(1).to_pylist(), ends, sizes.tolist())):
                    if other != last:
                        last, last_set = other, gram_sets(pa.array([b.column(3)[i].as_py() or ""], pa.large_string()), similarity)[0]
                    both = len(np.intersect1d(grams[end - size : end], last_set, assume_unique=True))
                    either = size + len(last_set) - both
                    keep.append(both > 0 and similarity.whole * both >= similarity.part * either)
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])

    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    return save(map_batches(joined, run, "a bigint, b bigint"))


def _end(known: DataFrame, end: str) -> DataFrame:
    """Size and sketch of the sets at one end of a pair, with names of that end."""
    return known.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ["n_shingles", *SKETCH_WORDS]])


def _may_link(similarity: Similarity):
    """Sizes and sketches of a pair leave room for a link: no more bits differ than grams may."""
    a, b = F.col("n_shingles_a"), F.col("n_shingles_b")
    near = F.least(a, b) * similarity.whole >= F.greatest(a, b) * similarity.part
    differing = reduce(add, [F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in SKETCH_WORDS])
    return near & (differing * (similarity.whole + similarity.part) <= (a + b) * (similarity.whole - similarity.part))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: Similarity = Similarity()
) -> DataFrame:
    """One row per row of ``docs``: ``row, doc_id, n_shingles, component, component_id``.

    ``component_id`` is the smallest ``doc_id`` that links lead to, the own one included; ``component`` numbers the
    components apart from ids and is null for a text without words; ``row`` is the position in ``docs``.

    A null text, and one without words, is empty, linked with nothing and alone in its component. A text of fewer words than a gram has one gram, all its words. Texts with one set are linked whatever their
    number; null ids count only where no other is there. An empty table gives an empty result. Columns of
    ``docs`` other than the two named are not read. ``docs`` must be a stored table, whose rows keep their
    places from scan to scan; the operator fails if they don't.
    """
    sets = number_sets(docs, id_col, text_col, similarity)
    clash = sets.groupBy("node").agg(F.min("other").alias("a"), F.max("other").alias("b")).filter("a <> b")
    if not clash.isEmpty():  # two sets with one 64-bit number: number them anew
        again = Similarity(similarity.n, similarity.part, similarity.whole, similarity.seed + 1)
        return near_duplicates(docs, id_col, text_col, again)
    bands = shared_bands(docs, text_col, similarity)
    known = known_sets(sets, bands.select("node").distinct())
    star = bands.filter("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
    star = save(star.join(_end(known, "a"), "a").join(_end(known, "b"), "b").filter(_may_link(similarity)).select("a", "b"))
    near = within_reach(star, known, similarity)
    links = verified(near, set_texts(docs, text_col, known, near), similarity)
    found = save(components(links))

    part = F.coalesce("component", "node")
    labelled = bands.join(found, "node", "left").select("key", "node", part.alias("part"))
    mixed = labelled.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p <> q")
    unmerged = save(labelled.join(mixed.select("key"), "key"))
    one = unmerged.select("key", F.col("node").alias("a"), F.col("part").alias("part_a")).join(_end(known, "a"), "a")
    two = unmerged.select("key", F.col("node").alias("b"), F.col("part").alias("part_b")).join(_end(known, "b"), "b")
    apart = (one["key"] == two["key"]) & (F.col("part_a") < F.col("part_b")) & _may_link(similarity)
    rest = one.join(two, apart).select("a", "b").distinct()
    tried = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = within_reach(rest.join(tried, ["a", "b"], "left_anti"), known, similarity)
    more = verified(near, set_texts(docs, text_col, known, near), similarity)
    whole = save(components(links.unionByName(more)))

    # The component of a set, then the smallest document id in it.
    of = sets.join(whole, "node", "left").select(
        "row", "doc_id", "n_shingles", "node", F.coalesce("component", "node").alias("component")
    )
    least = of.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    shared = least.filter(F.col("n") > 1).drop("n")
    return of.join(shared, "component", "left").select(
        "row", "doc_id", "n_shingles", "component", F.coalesce("least", "doc_id").alias("component_id")
    )


def surplus_rows(found: DataFrame) -> DataFrame:
    """``row`` of every row of a ``near_duplicates`` result but the one with the smallest id in its component."""
    first = found.filter(F.col("component").isNotNull()).groupBy("component").agg(
        F.min(F.struct("doc_id", "row"))["row"].alias("keep"), F.count("*").alias("n")
    )
    several = first.filter(F.col("n") > 1).select("component", "keep")
    return found.join(several, "component").filter(F.col("row") != F.col("keep")).select("row")
