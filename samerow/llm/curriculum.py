"""Mixing sources to target weights along a curriculum. DataFrame operations only.

Every source has a weight that changes over training time, a schedule of straight pieces over 0 to 1. Its integral is
the source's share of all words, and the part integrated up to a time is what the source has delivered by then: its
cumulative demand. A source delivers its documents in a fixed random order, again from the first when it runs out, so
each copy of a document lies at a known place of that demand; inverting the demand gives the time at which it is
due. A range sort by time over all tasks is the training order.

Places in the demand are running totals of words. Rows are sorted by ranges, totalled inside each range, and the
totals of the ranges are added up per source, so a source with most of the documents is many ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from samerow.operators.ranks import ROW_BITS, ranked
from samerow.session import pin_splits, save

# Times from 0 to 1 and the weight at each; straight lines between.
Schedule = Sequence[tuple[float, float]]

# Fixed value: the white space that ends a word.
SPACE = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def pieces(schedule: Schedule) -> list[tuple[float, float, float, float, float, float]]:
    """``(start, length, weight at start, weight at end, area before, area)`` of each piece with any area."""
    times, weights = zip(*schedule)
    if times[0] != 0 or times[-1] != 1 or any(a >= b for a, b in zip(times, times[1:])) or min(weights) < 0:
        raise ValueError("a schedule goes from time 0 to time 1 in growing times, with weights of at least 0")
    out, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        area = (w0 + w1) / 2 * (t1 - t0)
        if area > 0:
            out.append((float(t0), float(t1 - t0), float(w0), float(w1), before, area))
        before += area
    return out


def weight(schedule: Schedule) -> float:
    """The integral of a schedule."""
    found = pieces(schedule)
    return found[-1][4] + found[-1][5] if found else 0.0


def due(schedule: Schedule, delivered: Column) -> Column:
    """The time by which a source has delivered this fraction of its demand."""
    found = pieces(schedule)
    if not found:
        return F.lit(None).cast("double")
    x = delivered * F.lit(weight(schedule))
    out = None
    for start, length, w0, w1, before, area in found:
        # w0 u + (w1 - w0) u^2 / 2 = rest; this form of the root holds for a level piece too.
        rest = F.greatest(x - F.lit(before), F.lit(0.0)) / F.lit(length)
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * (w1 - w0)) * rest, F.lit(0.0)))
        time = F.when(rest <= 0, F.lit(start)).otherwise(
            F.lit(start) + F.least(F.lit(2.0) * rest / (F.lit(w0) + root), F.lit(1.0)) * F.lit(length)
        )
        inside = x < F.lit(before + area)
        out = F.when(inside, time) if out is None else out.when(inside, time)
        last = time
    return out.otherwise(last)


def measured(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 1
) -> DataFrame:
    """Store ``row, doc_id, source, size, at`` of every row: its position, words, and place in random order."""
    pin_splits(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    marks = F.translate(F.regexp_replace(text, WORD, "w"), SPACE, "")
    ident = F.col(id_col)
    return save(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            ident.alias("doc_id"),
            F.col(source_col).alias("source"),
            F.length(marks).cast("long").alias("size"),
            F.left(F.md5(F.concat(F.lit(f"{seed}:"), ident.cast("string"))), F.lit(16)).alias("at"),
        )
    )


def _running(rows: DataFrame, group: list[str], order: list[Column], measures: dict[str, str]) -> DataFrame:
    """Add for each ``name: column`` the total of the column over the rows before, inside each ``group``, in ``order``."""
    keys = [*[F.col(c) for c in group], *order]
    placed = save(
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_block", F.shiftright("_at", ROW_BITS))
    earlier_rows = Window.partitionBy("_block", *group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    earlier_blocks = Window.partitionBy(*[f"_{c}" for c in group]).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    sums = placed.groupBy(F.col("_block").alias("_b"), *[F.col(c).alias(f"_{c}") for c in group]).agg(
        *[F.sum(c).alias(f"_n_{name}") for name, c in measures.items()]
    )
    before = sums.select(
        "_b",
        *[f"_{c}" for c in group],
        *[F.coalesce(F.sum(f"_n_{name}").over(earlier_blocks), none).alias(f"_n_{name}") for name in measures],
    )
    same = F.col("_block") == F.col("_b")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    inside = [F.coalesce(F.sum(c).over(earlier_rows), none).alias(f"_i_{name}") for name, c in measures.items()]
    totals = [(F.col(f"_n_{name}") + F.col(f"_i_{name}")).alias(name) for name in measures]
    return placed.select("*", *inside).join(before, same).select(*rows.columns, *totals)


def targets(sized: DataFrame, schedules: Sequence[Schedule], max_repeats: int = 3) -> DataFrame:
    """Store ``source, source_size, cycle, target`` of each source, from a ``measured`` table.

    Sources in the order of their code points, null last, take the ``schedules`` in turn (``cycle`` is the number of
    theirs) and share the words of all documents by the integrals. No target is above ``max_repeats`` times the
    source's words: in the order of that limit by weight, a source is at its limit as long as an equal share of what
    is left would pass it, and the others share the rest by weight.
    """
    weights = [weight(s) for s in schedules]
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = ranked(sums, [F.col("source").asc_nulls_last()], "number")
    cycle = (F.col("number") % len(weights)).cast("int")
    weighed = save(
        numbered.select(
            "source",
            "source_size",
            "number",
            cycle.alias("cycle"),
            F.element_at(F.array(*[F.lit(w) for w in weights]), cycle + 1).alias("weight"),
            (F.col("source_size") * max_repeats).cast("double").alias("most"),
        )
    )
    total, all_weights = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    total, all_weights = float(total or 0), float(all_weights or 0)
    some = weighed.filter("weight > 0")
    ratio = [(F.col("most") / F.col("weight")), F.col("number")]
    at = _running(some, [], ratio, {"most_before": "most", "weight_before": "weight"})
    full = F.col("most") * (F.lit(all_weights) - F.col("weight_before")) <= (F.lit(total) - F.col("most_before")) * F.col("weight")
    marked = save(at.withColumn("full", full))
    held, held_weight = marked.filter("full").agg(F.sum("most"), F.sum("weight")).first()
    rest, rest_weight = total - (held or 0.0), all_weights - (held_weight or 0.0)
    share = F.lit(rest) * F.col("weight") / F.lit(rest_weight or 1.0)
    named = ["source", "source_size", "cycle"]
    found = marked.select(*named, F.when(F.col("full"), F.col("most")).otherwise(share).alias("target"))
    return save(found.unionByName(weighed.filter("weight <= 0").select(*named, F.lit(0.0).alias("target"))))


def training_order(sized: DataFrame, goals: DataFrame, schedules: Sequence[Schedule]) -> DataFrame:
    """Store ``row, doc_id, copy, words, time, place``: all copies of documents in training order.

    ``copy`` counts from 0, ``time`` is from 0 to 1, ``place`` is gapless from 0. A source delivers the whole part of
    its target and not a word more: of the copy at which it ends, ``words`` are taken. A document without words is
    not delivered.
    """
    same = F.col("source").eqNullSafe(F.col("_source"))
    joined = sized.filter("size > 0").join(goals.withColumnRenamed("source", "_source"), same).drop("_source")
    offset = _running(joined, ["source"], [F.col(c) for c in ("at", "doc_id", "size", "row")], {"offset": "size"})
    quota = F.floor("target")
    passes = F.ceil((quota - F.col("offset")) / F.col("source_size"))
    each = offset.filter(quota > F.col("offset")).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), passes - 1)))
    first = F.col("copy") * F.col("source_size") + F.col("offset")
    taken = each.withColumn("first", first).withColumn("words", F.least("size", quota - F.col("first")))
    middle = (F.lit(2) * F.col("first") + F.col("words")) / (F.lit(2.0) * F.col("target"))
    time = F.lit(None).cast("double")
    for i, schedule in enumerate(schedules):
        time = F.when(F.col("cycle") == i, due(schedule, middle)).otherwise(time)
    timed = taken.select("row", "doc_id", "at", "copy", "words", time.alias("time"))
    order = ["time", "at", "doc_id", "copy", "words", "row"]
    return save(ranked(timed, order, "place").drop("at"))


def mix(
    docs: DataFrame,
    schedules: Sequence[Schedule],
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    max_repeats: int = 3,
    seed: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs``: a row per document, and the copies in ``training_order``.

    Documents have ``row, doc_id, size, source_size, target, taken, n_copies, first_time, first_place``: their words,
    those of their source, the words the source is to deliver, the words of this document that the mix takes,
    repeats counted, and its first place in the training order (null if it has none).

    A null text is empty, and a document without words is never taken. A null source is a source of its own and the
    last one. Null ids are ordered first. Documents that repeat, ids included, are documents of their own; their
    order among themselves changes no column. If all texts are empty, all targets are 0; an empty table gives
    empty results. Other columns of ``docs`` are not read. Results depend on the rows alone, not on their order or
    partitions, except ``row``.
    """
    sized = measured(docs, id_col, source_col, text_col, seed)
    goals = targets(sized, schedules, max_repeats)
    order = training_order(sized, goals, schedules)
    of_row = order.groupBy("row").agg(
        F.sum("words").alias("taken"),
        F.count("*").alias("n_copies"),
        F.min("time").alias("first_time"),
        F.min("place").alias("first_place"),
    )
    same = F.col("source").eqNullSafe(F.col("_source"))
    known = sized.join(goals.withColumnRenamed("source", "_source"), same)
    none = F.lit(0).cast("long")
    documents = known.join(of_row, "row", "left").select(
        "row",
        "doc_id",
        "size",
        "source_size",
        "target",
        F.coalesce("taken", none).alias("taken"),
        F.coalesce("n_copies", none).alias("n_copies"),
        "first_time",
        "first_place",
    )
    return documents, order
