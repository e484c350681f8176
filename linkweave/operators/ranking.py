"""Row numbers and running totals without a window over a whole group.

A window puts each group, or with no group the whole table, into one task. Here the rows are
range-partitioned by group and order, so a large group is cut into pieces by its order columns; the
pieces are counted or summed, and each gets the total of the pieces before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkweave.session import stage

POSITION = "_position"
PIECE = "_piece"
_PIECE_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def lay_out(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` cut into sorted pieces, with ``_position`` and ``_piece``.

    ``group`` and ``order`` together must be unique. The rows are written out, so every later pass
    sees the same cuts: range boundaries come from a sample and would differ in a second run.
    """
    keys = [*(F.col(g) for g in group), *order]
    placed = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn(POSITION, F.monotonically_increasing_id())
    )
    return stage(placed, "pieces").withColumn(PIECE, F.shiftright(F.col(POSITION), _PIECE_BITS))


def _before(group: Sequence[str]):
    """Earlier pieces of the same group: at most as many rows as there are pieces."""
    return Window.partitionBy(*group).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)


def _add_shift(placed: DataFrame, shifts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Join the per-piece values. With no group there is one row per piece, few enough to broadcast."""
    keys = [PIECE, *group]
    shifts = shifts.select(*(F.col(k).alias(f"_of_{k}") for k in keys), "_shift")
    if not group:
        shifts = F.broadcast(shifts)
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_of_{key}"))
    return placed.join(shifts, condition).drop(*(f"_of_{k}" for k in keys))


def number_rows(
    df: DataFrame, order: Sequence[Column], name: str, group: Sequence[str] = ()
) -> DataFrame:
    """Add ``name``: 1, 2, 3 … in ``order``, within each ``group``."""
    placed = lay_out(df, group, order)
    pieces = placed.groupBy(PIECE, *group).agg(
        F.min(POSITION).alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    earlier = F.coalesce(F.sum("_rows").over(_before(group)), F.lit(0))
    shifts = pieces.withColumn("_shift", earlier - F.col("_first") + 1).drop("_first", "_rows")
    return (
        _add_shift(placed, shifts, group)
        .withColumn(name, (F.col(POSITION) + F.col("_shift")).cast("bigint"))
        .drop(POSITION, PIECE, "_shift")
    )


def running_total(
    df: DataFrame, value: str, order: Sequence[Column], name: str, group: Sequence[str]
) -> DataFrame:
    """Add ``name``: the sum of ``value`` up to and including the row, in ``order`` within ``group``."""
    placed = lay_out(df, group, order)
    pieces = placed.groupBy(PIECE, *group).agg(F.sum(value).alias("_sum"))
    shifts = pieces.withColumn(
        "_shift", F.coalesce(F.sum("_sum").over(_before(group)), F.lit(0))
    ).drop("_sum")
    # one task of this window holds a group's rows of one piece, never the whole group
    within = (
        Window.partitionBy(PIECE, *group)
        .orderBy(POSITION)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        _add_shift(placed.withColumn("_within", F.sum(value).over(within)), shifts, group)
        .withColumn(name, (F.col("_within") + F.col("_shift")).cast("bigint"))
        .drop(POSITION, PIECE, "_shift", "_within")
    )
