"""Joins that hold when one key has a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one key that a single task may take, whatever the total.
ROWS_PER_TASK = 1_000_000
# A key is hot only if it has more than one part in HOT_PARTS of all rows, so fewer than HOT_PARTS keys can be.
HOT_PARTS = 4096


def hot_keys(counts: DataFrame, on: Sequence[str], count: str, rows_per_task: int, parts: int = HOT_PARTS) -> DataFrame:
    """``on, _salts`` for the keys that need several tasks: all keys with more rows than a task takes.

    A task takes ``rows_per_task`` rows, or one part in ``parts`` of the total where that is more: as the counts
    add up to the total, fewer than ``parts`` keys can be above it, and none is left out.
    """
    total = F.broadcast(counts.agg(F.sum(count).alias("_total")))
    most = F.greatest(F.lit(float(rows_per_task)), F.col("_total") / parts)
    return (
        counts.join(total, F.col("_total") > rows_per_task)
        .where(F.col(count) > most)
        .select(*on, F.ceil(F.col(count) / most).cast("int").alias("_salts"))
    )


def lookup(
    facts: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    salt_by: Sequence[str],
    how: str = "left",
    count: str | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Join many ``facts`` to ``dim``, which has at most one row per key.

    Without ``count`` it is a plain join: where ``dim`` is a stored table, both inputs come straight
    from a shuffle and the adaptive planner splits a hot key at run time, without counting first.

    Where ``dim`` is an aggregate on the join key that is not possible, but its counts come for
    nothing: ``count`` names its column with the number of facts of the key, or an upper bound of it, and is
    dropped. The rows of a hot key go to one of ``_salts`` tasks each, chosen from their ``salt_by``
    columns, and the one ``dim`` row of that key is repeated for each. The broadcast part has fewer than ``HOT_PARTS`` rows.
    """
    on = list(on)
    if count is None:
        return facts.join(dim, on, how)
    hot = F.broadcast(hot_keys(dim, on, count, rows_per_task))
    dim = dim.drop(count)
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    left = (
        facts.join(hot, on, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*salt_by), salts).cast("int"))
        .drop("_salts")
    )
    right = (
        dim.join(hot, on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    return left.join(right, [*on, "_salt"], how).drop("_salt")
