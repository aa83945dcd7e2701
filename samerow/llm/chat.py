"""Chat formatting from every participant's point of view. DataFrame operations only.

For each participant of a dialogue the whole dialogue is rendered once, with that speaker as the assistant and
all others as named users; only the assistant's words are trained on. The rendering stays in long form, one row
per participant and turn, with the place of each turn in the rendered text, so a dialogue of any length is rows
for many tasks and never one string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from samerow.operators.ranks import ranked

OPEN, BREAK, CLOSE = "<|", "|>\n", "<|end|>\n"


def rotate(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    speaker_col: str = "role",
    text_col: str = "text",
    system: str = "system",
) -> DataFrame:
    """``conv_id, perspective, turn, role, name, rendered, start, end, mask_start, mask_end``.

    One row per participant of a dialogue and turn. Turns of ``system`` keep their role in every rendering and
    make no perspective. ``start`` and ``end`` place ``rendered`` in the whole text of the perspective, and
    ``mask_start`` to ``mask_end`` are the code points trained on: an assistant turn's text with its end mark,
    empty for all others.

    Rows with a null id form one dialogue. A null speaker is a user without a name and has no perspective. A
    null turn comes first, a null text is empty, and turns with one number follow by speaker and text; rows
    that repeat are turns of their own. A dialogue without participants has no rendering.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.col(speaker_col).alias("speaker"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    is_system = F.coalesce(F.col("speaker") == system, F.lit(False))
    # Combined in the scan tasks: one row per dialogue and speaker, however long the dialogue.
    people = (
        rows.filter(F.col("speaker").isNotNull() & ~is_system)
        .groupBy(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective"))
        .agg(F.lit(1).alias("one"))
        .drop("one")
    )
    each = rows.join(people, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    mine = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    role = F.when(is_system, F.lit(system)).when(mine, F.lit("assistant")).otherwise(F.lit("user"))
    name = F.when(~is_system & ~mine, F.col("speaker"))
    head = F.concat(F.lit(OPEN), role, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit(BREAK))
    each = each.select(
        "conv_id", "perspective", "turn", "speaker", "text", role.alias("role"), name.alias("name"),
        F.length(head).cast("long").alias("n_head"), F.concat(head, "text", F.lit(CLOSE)).alias("rendered"),
    )
    placed = _running_length(each, ["conv_id", "perspective"], ["turn", "speaker", "text"])
    end = F.col("start") + F.length("rendered")
    trained = F.col("role") == "assistant"
    return placed.select(
        "conv_id",
        "perspective",
        "turn",
        "role",
        "name",
        "rendered",
        "start",
        end.alias("end"),
        F.when(trained, F.col("start") + F.col("n_head")).otherwise(end).alias("mask_start"),
        # The line break after the end mark is not trained on.
        F.when(trained, end - 1).otherwise(end).alias("mask_end"),
    )


def _running_length(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Add ``start``: the length of all ``rendered`` before a row in its group.

    Rows get a global place first. Lengths are summed up inside cells of consecutive places, and the few cells
    of a group are summed up along it, so a long group is the work of many tasks.
    """
    cell_rows = 4096
    placed = ranked(rows, [*group, *order], "_rank").withColumn("_cell", F.floor(F.col("_rank") / cell_rows))
    place = Window.partitionBy(*group, "_cell").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)

    def so_far(c: Column, window) -> Column:
        return F.coalesce(F.sum(c).over(window), F.lit(0).cast("long"))

    cells = placed.groupBy(*group, "_cell").agg(F.sum(F.length("rendered")).alias("_n"))
    cells = cells.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("_cell").alias("_c"), so_far(F.col("_n"), along).alias("_before"))
    same = (F.col("_cell") == F.col("_c")) & F.col(group[0]).eqNullSafe(F.col(f"_{group[0]}"))
    for c in group[1:]:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    inside = placed.withColumn("_inside", so_far(F.length("rendered"), place))
    return inside.join(cells, same).withColumn("start", F.col("_before") + F.col("_inside")).select(*rows.columns, "start")
