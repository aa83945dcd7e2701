"""Joins that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Rows of one key that a join task takes; a key with more is spread over several tasks.
ROWS_PER_SALT = 1_000_000


def key_hash(*key: str) -> Column:
    """Goes before the key in grouping, window and join columns.

    Keys often begin alike. Sorting by a number first settles nearly every comparison without reading them;
    the key itself stays in the columns, so two keys with one hash are still told apart.
    """
    return F.xxhash64(*(key or ("key",))).alias("key_hash")


def join_on_key(
    rows: DataFrame,
    keys: DataFrame,
    how: str,
    on: str | list[str] = "key",
    weight: str = "n_rows",
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Join ``rows`` with ``keys``, which has one row per key and, in ``weight``, its number of rows in ``rows``.

    ``keys`` should be a stored table (``session.save``): the planner then broadcasts it if its files are below
    the broadcast threshold. Otherwise both sides are shuffled, and the rows of a key with more than
    ``rows_per_salt`` are split by a salt from their position, while its row in ``keys`` is repeated once per
    salt. Only the hashes of such keys are broadcast, at most one for every ``rows_per_salt`` rows there are.
    Rows without a key are spread by position. ``rows`` is evaluated once; no row is lost or doubled.
    """
    on = [on] if isinstance(on, str) else on
    position = F.xxhash64(*[c for c in ("path", "block", "pos", "key") if c in rows.columns])
    left = rows.withColumn("key_hash", F.when(F.col(on[0]).isNotNull(), key_hash(*on)).otherwise(position))
    right = keys.select("*", key_hash(*on))
    # Two keys may share a hash. Both sides look the salts up by hash, so the larger number serves both.
    hot = F.broadcast(
        right.filter(F.col(weight) > rows_per_salt)
        .groupBy("key_hash")
        .agg(F.max(F.ceil(F.col(weight) / rows_per_salt)).alias("salts"))
    )
    spread = F.coalesce(F.pmod(position, F.col("salts")), F.lit(0).cast("long"))
    each = F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1).cast("long")) - 1)
    left = left.join(hot, "key_hash", "left").withColumn("salt", spread).drop("salts")
    right = right.join(hot, "key_hash", "left").withColumn("salt", F.explode(each)).drop("salts")
    return left.join(right, ["key_hash", *on, "salt"], how).drop("salt", "key_hash")
