"""A prefix trie over conversations, as double-array tries of shards that are merged where they meet.

A conversation is the sequence of its turns' digests, and conversations are sorted by these sequences over all tasks.
A shard is a run of that order, bounded in turns, so conversations with a common beginning lie in one shard or in
neighbours. A task numbers the distinct turns of a shard densely, packs the shard's trie into BASE and CHECK arrays
(the child of state s by turn t is state BASE[s] + t if CHECK names s there), walks all conversations through it at
once, turn by turn, and adds up its nodes.

Two neighbouring shards share the nodes on the common beginning of the last conversation of the one and the first of
the next, and no others. So all nodes off the first and the last path of a shard are final. Those on the two paths
are added up over all shards, and what neighbours counted twice is taken off: for each pair one row per shared node,
with the shared children, leaves and tokens below it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from samerow.llm.tasks import map_batches
from samerow.session import save

# Bytes of a turn's digest in a path.
WIDTH = 16
# Turns of a shard; a longer conversation is a shard of its own.
SHARD_TURNS = 100_000
# Characters of a row that lists ends of paths, for nodes that several shards share.
PIECE = 4096

SHARDS = (
    "kind int, shard bigint, key binary, parent_key binary, conv_id bigint, parent_conv_id bigint, depth bigint, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, ends string, place bigint, "
    "path binary, lengths array<bigint>, last_path binary"
)
MEETINGS = "key binary, dup_children bigint, dup_leaves bigint, dup_saved bigint"
NODE, SHARED, ENDS, EDGE = 0, 1, 2, 3


def sequences(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``conv_id, turns``: each conversation's turns in order, as structs of ``digest`` (hex) and ``length``.

    Turns are ordered by number, null first; those with one number by role, then digest. A null role or text is
    empty. Rows that repeat are turns of their own. Rows without a conversation are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        role.alias("role"),
        F.left(F.sha2(whole, 256), F.lit(2 * WIDTH)).alias("digest"),
        F.length(text).cast("long").alias("length"),
    )
    rows = turns.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), turn.alias("t"))
    # Structs compare field by field, and a null turn is smaller than any other.
    ordered = F.sort_array(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["digest"], t["length"])).alias("turns"))


class DoubleArray:
    """A trie over sequences of numbers below ``n_codes``, packed into BASE and CHECK."""

    def __init__(self, parent: np.ndarray, code: np.ndarray, n_codes: int):
        """From the nodes of a trie, parents first: the number of each node's parent and its code; node 0 is the root."""
        self.n_codes = n_codes
        n = len(parent)
        size = 2 * (n + n_codes) + 2
        self.base = np.zeros(size, np.int64)
        self.check = np.full(size, -1, np.int64)
        self.state = np.zeros(n, np.int64)
        self.check[0] = 0
        free = 1
        order = np.lexsort((code[1:], parent[1:])) + 1
        parents, starts = np.unique(parent[order], return_index=True)
        ends = np.append(starts[1:], len(order))
        for p, a, b in zip(parents.tolist(), starts.tolist(), ends.tolist()):
            children = order[a:b]
            codes = code[children]
            while self.check[free] >= 0:
                free += 1
            base = self._place(codes, free)
            places = base + codes
            self._grow(int(places[-1]) + n_codes + 2)
            self.base[self.state[p]] = base
            self.check[places] = self.state[p]
            self.state[children] = places

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _place(self, codes: np.ndarray, free: int) -> int:
        """The first base from a free cell on at which the cells of all ``codes`` are free; it may be negative."""
        span = int(codes[-1] - codes[0])
        start = free
        while True:
            self._grow(start + span + 4098)
            cells = np.flatnonzero(self.check[start : start + 4096] < 0) + start
            fit = np.ones(len(cells), bool)
            for c in (codes[1:] - codes[0]).tolist()[:64]:
                fit &= self.check[cells + c] < 0
            for cell in cells[fit].tolist():
                if (self.check[cell + codes - codes[0]] < 0).all():
                    return cell - int(codes[0])
            start += 4096

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The states that ``code`` leads to; -1 where there is none."""
        to = self.base[state] + code
        inside = (to > 0) & (to < len(self.check))
        to = np.where(inside, to, 0)
        return np.where(inside & (self.check[to] == state), to, -1)


class Shard:
    """Conversations in the order of their paths, as a double-array trie with the numbers of its nodes."""

    def __init__(self, conv: np.ndarray, paths: list[bytes], lengths: list[np.ndarray]):
        self.conv, self.paths = conv, paths
        self.size = np.array([len(p) // WIDTH for p in paths], np.int64)
        n = len(paths)
        first = np.cumsum(self.size) - self.size
        words = np.frombuffer(b"".join(paths) or bytes(WIDTH), ">u8").reshape(-1, WIDTH // 8)[: self.size.sum()]
        self.code = np.unique(words, axis=0, return_inverse=True)[1].reshape(-1).astype(np.int64)
        self.first = first
        length = np.concatenate([np.zeros(0, np.int64), *lengths])
        # A turn makes a node unless the conversation before went the same way as far as this.
        conv_of = np.repeat(np.arange(n), self.size)
        depth_of = np.arange(len(self.code)) - first[conv_of]
        before = np.maximum(conv_of - 1, 0)
        there = (conv_of > 0) & (depth_of < self.size[before])
        same = there & (self.code == self.code[np.where(there, first[before] + depth_of, 0)])
        strays = np.where(same, np.iinfo(np.int64).max, depth_of)
        common = np.minimum(np.minimum.reduceat(strays, first[self.size > 0]) if len(strays) else np.zeros(0, np.int64), self.size[self.size > 0])
        shared = np.zeros(n, np.int64)
        shared[self.size > 0] = common
        new = depth_of >= shared[conv_of]
        self.code_of_node = np.append(0, self.code[new])
        self.length = np.append(0, length[new])
        self.depth = np.append(0, depth_of[new] + 1)
        # The parent of a new node is the one before it, or a node of the path of an earlier conversation.
        number = np.where(new, np.cumsum(new), 0)
        on_path: list[int] = []
        parent = [0]
        for i in range(n):
            del on_path[int(shared[i]) :]
            for x in number[first[i] + int(shared[i]) : first[i] + int(self.size[i])].tolist():
                parent.append(on_path[-1] if on_path else 0)
                on_path.append(x)
        self.parent = np.array(parent, np.int64)
        self.trie = DoubleArray(self.parent, self.code_of_node, int(self.code.max()) + 1 if len(self.code) else 1)
        self._walk()

    def _walk(self) -> None:
        """Take all conversations through the arrays, one turn at a time, and add up the nodes they pass."""
        n_nodes = len(self.parent)
        node_of = np.full(len(self.trie.check), -1, np.int64)
        node_of[self.trie.state] = np.arange(n_nodes)
        self.members = np.zeros(n_nodes, np.int64)
        self.least = np.full(n_nodes, np.iinfo(np.int64).max)
        self.end = np.zeros(len(self.conv), np.int64)
        state = np.zeros(len(self.conv), np.int64)
        going = np.arange(len(self.conv))
        depth = 0
        while len(going):
            node = node_of[state[going]]
            np.add.at(self.members, node, 1)
            np.minimum.at(self.least, node, self.conv[going])
            self.end[going] = node
            going = going[self.size[going] > depth]
            state[going] = self.trie.step(state[going], self.code[self.first[going] + depth])
            depth += 1
        self.children = np.bincount(self.parent[1:], minlength=n_nodes)
        self.leaves = (self.children == 0).astype(np.int64)
        self.saved = (self.members - 1) * self.length
        # Deeper nodes first: what is below a node is added up before it goes to the parent.
        by_depth = np.argsort(-self.depth, kind="stable")
        cuts = np.flatnonzero(np.diff(self.depth[by_depth])) + 1
        for level in np.split(by_depth, cuts):
            level = level[level > 0]
            np.add.at(self.leaves, self.parent[level], self.leaves[level])
            np.add.at(self.saved, self.parent[level], self.saved[level])

    def path_nodes(self, i: int) -> list[int]:
        """Nodes from the root to the end of conversation ``i``."""
        out = [int(self.end[i])]
        while out[-1]:
            out.append(int(self.parent[out[-1]]))
        return out[::-1]


def path_keys(path: bytes) -> list[bytes]:
    """A key for each beginning of a path, the empty one first."""
    out = [b"\0" * WIDTH]
    for at in range(0, len(path), WIDTH):
        out.append(hashlib.blake2b(out[-1] + path[at : at + WIDTH], digest_size=WIDTH).digest())
    return out


def _ends_hash(convs: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, convs)).encode()).hexdigest()


def shard_rows(number: int, conv: list[int], paths: list[bytes], lengths: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Final nodes, nodes that other shards may share, the ends at those, and the first and last path."""
    s = Shard(np.array(conv, np.int64), paths, lengths)
    n = len(s.parent)
    key: list[bytes | None] = [None] * n
    for i in (0, len(paths) - 1):
        for node, name in zip(s.path_nodes(i), path_keys(paths[i])):
            key[node] = name
    edge = np.array([k is not None for k in key])
    ends: dict[int, list[int]] = {}
    for node, c in zip(s.end.tolist(), conv):
        ends.setdefault(node, []).append(c)
    none = _ends_hash([])
    parent_edge = edge[s.parent]
    columns = {
        "kind": np.where(edge, SHARED, NODE).astype(np.int32),
        "shard": np.full(n, number, np.int64),
        "key": pa.array(key, pa.binary()),
        "parent_key": pa.array([key[p] if i else None for i, p in enumerate(s.parent.tolist())], pa.binary()),
        "conv_id": s.least,
        "parent_conv_id": pa.array(s.least[s.parent], mask=parent_edge | (np.arange(n) == 0)),
        "depth": s.depth,
        "n_convs": s.members,
        "n_children": s.children,
        "n_leaves": s.leaves,
        "saved_tokens": s.saved,
        "ends_sha256": pa.array([None if e else _ends_hash(ends[i]) if i in ends else none for i, e in enumerate(edge.tolist())], pa.string()),
    }
    yield _batch(columns, n)
    pieces = []
    for node in np.flatnonzero(edge).tolist():
        # As far as possible several ids are one row; the text of the rows in order is that of all ids.
        for place, c in enumerate(_pieces(ends.get(node, []))):
            pieces.append((key[node], c, place))
    if pieces:
        names, texts, places = zip(*pieces)
        yield _batch({"kind": np.full(len(names), ENDS, np.int32), "shard": np.full(len(names), number, np.int64),
                      "key": pa.array(names, pa.binary()), "ends": pa.array(texts), "place": np.array(places, np.int64)}, len(names))
    yield _batch({"kind": np.array([EDGE], np.int32), "shard": np.array([number], np.int64), "path": pa.array([paths[0]], pa.binary()),
                  "lengths": pa.array([lengths[0].tolist()], pa.list_(pa.int64())), "last_path": pa.array([paths[-1]], pa.binary())}, 1)


def _pieces(convs: list[int]) -> Iterator[str]:
    held, size = [], 0
    for c in convs:
        held.append(str(c))
        size += len(held[-1]) + 1
        if size >= PIECE:
            yield ",".join(held)
            held, size = [], 0
    if held:
        yield ",".join(held)


_TYPES = pa.schema([
    ("kind", pa.int32()), ("shard", pa.int64()), ("key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()),
    ("parent_conv_id", pa.int64()), ("depth", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("ends", pa.string()),
    ("place", pa.int64()), ("path", pa.binary()), ("lengths", pa.list_(pa.int64())), ("last_path", pa.binary()),
])


def _batch(columns: dict, n: int) -> pa.RecordBatch:
    arrays = [pa.array(columns[f.name]).cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in _TYPES]
    return pa.RecordBatch.from_arrays(arrays, schema=_TYPES)


def _shards(rows: DataFrame, shard_turns: int) -> DataFrame:
    """Store the rows of all shards of sorted ``conv_id, path, lengths`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, paths, lengths, held, number = [], [], [], 0, None
        for b in batches:
            for at, c, p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                n = len(p) // WIDTH
                if conv and held + n > shard_turns:
                    yield from shard_rows(number, conv, paths, lengths)
                    conv, paths, lengths, held = [], [], [], 0
                if not conv:
                    number = at
                conv.append(c)
                paths.append(p)
                lengths.append(x.values.to_numpy().astype(np.int64))
                held += n + 1
        if conv:
            yield from shard_rows(number, conv, paths, lengths)

    placed = rows.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    numbered = placed.select(F.monotonically_increasing_id().alias("at"), "conv_id", "path", "lengths")
    return save(map_batches(numbered, run, SHARDS))


def _meetings(found: DataFrame) -> DataFrame:
    """Store what pairs of neighbouring shards counted twice, per shared node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for last, path, lengths in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                p = 0
                while p < min(len(last), len(path)) // WIDTH and last[p * WIDTH : (p + 1) * WIDTH] == path[p * WIDTH : (p + 1) * WIDTH]:
                    p += 1
                keys = path_keys(path[: p * WIDTH])
                below = np.cumsum(np.append(0, lengths[:p])[::-1])[::-1].astype(np.int64)
                leaf = int(len(last) == p * WIDTH)  # the node where they part is a leaf of the shard before, not of both
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array([1] * p + [0], pa.int64()), pa.array([leaf] * (p + 1), pa.int64()), pa.array(below)],
                    ["key", "dup_children", "dup_leaves", "dup_saved"],
                )

    edges = found.filter(F.col("kind") == EDGE)
    before = F.lag("last_path").over(Window.orderBy("shard"))  # one row per shard
    pairs = edges.select(before.alias("before"), "path", "lengths").filter("before is not null")
    return save(map_batches(pairs, run, MEETINGS))


def _joined_ends(found: DataFrame) -> DataFrame:
    """``key, ends``: the hash of the ids that end at each shared node, read in order and never held together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], ["key", "ends"])

        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if name != key:
                    if digest is not None:
                        yield out()
                    key, digest = name, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(text.encode())
        if digest is not None:
            yield out()

    rows = found.filter(F.col("kind") == ENDS).repartition("key").sortWithinPartitions("key", "shard", "place")
    return map_batches(rows.select("key", "ends"), run, "key binary, ends string")


def conversation_trie(paths: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie over ``paths``, a ``sequences`` result or one made from it.

    ``conv_id`` is the smallest member, ``depth`` the number of turns, ``parent_conv_id`` the parent's ``conv_id`` (null
    for the root), ``n_convs`` the members, ``n_children`` and ``n_leaves`` the children and the childless nodes in the
    subtree, ``saved_tokens`` the sum over the subtree of the code points of each node's last text for all members
    but one, ``ends_sha256`` the digest of the ids of members that end here, in order and joined by commas.

    A conversation without turns ends at the root. ``conv_id`` must be unique and not null, as ``sequences`` makes it.
    An empty table has no nodes, not even a root. Turns are told apart by 128 bits of SHA-256 over role and text.
    A conversation is one row of 24 bytes a turn; shards hold ``shard_turns`` turns or one conversation.
    """
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    rows = save(paths.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["length"]).alias("lengths")))
    found = _shards(rows, shard_turns)
    twice = _meetings(found).groupBy("key").agg(*[F.sum(c).alias(c) for c in ("dup_children", "dup_leaves", "dup_saved")])
    sums = found.filter(F.col("kind") == SHARED).groupBy("key").agg(
        F.first("parent_key").alias("parent_key"),
        F.first("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    none = F.lit(0).cast("long")
    shared = save(
        sums.join(twice, "key", "left")
        .join(_joined_ends(found), "key", "left")
        .select(
            "key",
            "parent_key",
            "depth",
            "conv_id",
            "n_convs",
            (F.col("n_children") - F.coalesce("dup_children", none)).alias("n_children"),
            (F.col("n_leaves") - F.coalesce("dup_leaves", none)).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("dup_saved", none)).alias("saved_tokens"),
            F.coalesce("ends", F.lit(_ends_hash([]))).alias("ends_sha256"),
        )
    )
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    of_shard = found.filter(F.col("kind") == NODE).select("parent_key", *names)
    everything = of_shard.unionByName(shared.drop("key").withColumn("parent_conv_id", F.lit(None).cast("long")))
    # Only nodes below a shared one look their parent up.
    parents = shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("known"))
    looked_up = everything.filter("parent_key is not null").join(parents, "parent_key").withColumn("parent_conv_id", F.col("known"))
    return everything.filter("parent_key is null").select(*names).unionByName(looked_up.select(*names))
