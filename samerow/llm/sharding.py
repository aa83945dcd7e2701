"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points of a ring, and a row belongs to the first point at or after its own position. A
shard takes its rows up to a bound; the rows beyond continue clockwise to the next shard that has room. The
bounds add up to the number of rows (with ``slack`` 0), so shard sizes differ by at most one row.

Where rows go is decided on counts: the ring has a fixed number of arcs, one row count per arc is all the driver
sees, and the plan is a list of rank intervals per arc. Rows find their interval by their rank in the arc.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from samerow.operators.ranks import ranked

RING_SLOTS = 1 << 16
POINTS_PER_SHARD = 128


def ring(n_shards: int, points: int = POINTS_PER_SHARD, slots: int = RING_SLOTS) -> list[tuple[int, int]]:
    """``(slot, shard)`` of every virtual node, by slot. A shard's points don't depend on the other shards."""
    if n_shards < 1 or points < 1 or n_shards * points > slots // 2:
        raise ValueError("the ring needs at least one point per shard and twice as many slots as points")
    taken: dict[int, int] = {}
    for point in range(points):
        for shard in range(n_shards):
            at = int.from_bytes(hashlib.blake2b(f"{shard}:{point}".encode(), digest_size=8).digest(), "big") % slots
            while at in taken:
                at = (at + 1) % slots
            taken[at] = shard
    return sorted(taken.items())


def plan(counts: list[int], owners: list[int], n_shards: int, slack: float = 0.0) -> list[tuple[int, int, int, int, int]]:
    """Rank intervals ``(arc, first, end, shard, slot)`` for arcs with ``counts`` rows, in ring order.

    First every shard takes rows of its own arcs up to its bound, then the rest of each arc walks clockwise.
    ``slot`` is the place of the interval's first row in its shard.
    """
    total = sum(counts)
    base, extra = divmod(total, n_shards)
    room = [base + (s < extra) for s in range(n_shards)]
    if slack:
        room = [int((1 + slack) * total / n_shards) + 1] * n_shards
    used = [0] * n_shards
    intervals, overflow = [], []

    def place(arc: int, first: int, end: int, shard: int) -> int:
        n = min(end - first, room[shard] - used[shard])
        if n > 0:
            intervals.append((arc, first, first + n, shard, used[shard]))
            used[shard] += n
        return first + max(n, 0)

    for arc, n in enumerate(counts):
        first = place(arc, 0, n, owners[arc])
        if first < n:
            overflow.append((arc, first, n))
    for arc, first, n in overflow:
        step = arc
        while first < n:
            step = (step + 1) % len(owners)
            first = place(arc, first, n, owners[step])
    return intervals


def shard(
    docs: DataFrame,
    n_shards: int,
    id_col: str = "doc_id",
    points: int = POINTS_PER_SHARD,
    slack: float = 0.0,
    slots: int = RING_SLOTS,
) -> DataFrame:
    """Add ``shard`` and ``slot`` (gapless from 0 in each shard) to the rows of ``docs``.

    The position on the ring is a hash of ``id_col``. Null ids share one position, as do rows that repeat an
    id; however many they are, what a shard can't take goes on to the next. With fewer rows than shards some
    shards stay empty; an empty table gives an empty result. Columns of ``docs`` called ``shard`` or ``slot``
    are replaced.
    """
    spark = docs.sparkSession
    nodes = ring(n_shards, points, slots)
    arcs = _arc_of_slots(spark, nodes, slots)
    keyed = (
        docs.drop("shard", "slot")
        .withColumn("_hash", F.xxhash64(F.col(id_col)))
        .withColumn("_slot", F.pmod("_hash", F.lit(slots)).cast("int"))
        .join(F.broadcast(arcs), "_slot")  # as many rows as the ring has slots
    )
    placed = ranked(keyed, ["_arc", "_slot", "_hash", id_col], "_rank")
    counts = {r["_arc"]: r["n"] for r in placed.groupBy("_arc").agg(F.count("*").alias("n")).collect()}
    sizes = [counts.get(a, 0) for a in range(len(nodes))]
    found = plan(sizes, [s for _, s in nodes], n_shards, slack)
    starts = [0]
    for n in sizes:
        starts.append(starts[-1] + n)
    names = ["_arc", "_first", "_end", "shard", "_base"]
    columns = list(zip(*[(a, f + starts[a], e + starts[a], s, b) for a, f, e, s, b in found])) or [()] * 5
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    table = pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, types)})
    # At most one interval per arc and one more per shard that fills up.
    intervals = F.broadcast(spark.createDataFrame(table))
    inside = (placed["_arc"] == intervals["_arc"]) & F.col("_rank").between(F.col("_first"), F.col("_end") - 1)
    return (
        placed.join(intervals, inside)
        .withColumn("slot", F.col("_base") + F.col("_rank") - F.col("_first"))
        .drop("_arc", "_slot", "_hash", "_rank", "_first", "_end", "_base")
    )


def _arc_of_slots(spark: SparkSession, nodes: list[tuple[int, int]], slots: int) -> DataFrame:
    """``_slot, _arc``: the first virtual node at or after every slot, round the ring."""
    arcs, arc = [], 0
    for slot in range(slots):
        while arc < len(nodes) and nodes[arc][0] < slot:
            arc += 1
        arcs.append(arc % len(nodes))
    return spark.createDataFrame(pa.table({"_slot": pa.array(range(slots), pa.int32()), "_arc": pa.array(arcs, pa.int32())}))
