"""What the corpus operators share: a narrow view of the documents, words, and joins to per-document tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.session import prepare, stage

# A table is broadcast only when it has been written, counted and found to be at most this large.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 8 << 20
# Rows per Arrow batch: long texts must not pile up in one worker.
ARROW_ROWS = 400
# The columns of a table of documents.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def session(spark: SparkSession) -> SparkSession:
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def view(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id, text, text_hash`` and the columns named in ``more``; nothing else of ``docs`` is read,
    so extra columns cannot clash. ``doc_id`` with ``text_hash`` tells rows of one id apart."""
    session(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
        *(F.col(name) for name in more),
    )


KEY = ("doc_id", "text_hash")


def fits_broadcast(table: DataFrame, row_bytes: int = 40) -> bool:
    """Whether a staged table is small enough to be sent to every executor."""
    bound = min(BROADCAST_ROWS, BROADCAST_BYTES // row_bytes)
    return table.limit(bound + 1).count() <= bound


def attach(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", row_bytes: int = 40, may_broadcast: bool = True
) -> DataFrame:
    """Join ``left`` to the staged table ``right`` on ``on``, nulls matching nulls.

    ``right`` is broadcast if it has been counted and is small (and ``may_broadcast``). Otherwise both sides are shuffled
    as they are, so that the adaptive planner can split a hot key.
    """
    names = [f"on_{i}__" for i in range(len(on))]
    other = right
    for name, column in zip(names, on):
        other = other.withColumnRenamed(column, name)
    condition = None
    for name, column in zip(names, on):
        same = left[column].eqNullSafe(other[name])
        condition = same if condition is None else condition & same
    if may_broadcast and fits_broadcast(right, row_bytes):
        other = F.broadcast(other)
    return left.join(other, condition, how).drop(*names)


def most_frequent(table: DataFrame, count: str, limit: int) -> DataFrame:
    """The rows of a staged table with the greatest counts, at most ``limit``: all from a count on that
    is found from a histogram of logarithms. No task sorts or gathers the rows. Which rows go in does not depend on ties."""
    level = F.floor(F.log(F.col(count).cast("double")) * 10)
    histogram = table.where(F.col(count) > 0).groupBy(level.alias("level")).count().collect()
    least, held = None, 0
    for row in sorted(histogram, reverse=True):
        held += row["count"]
        if held > limit:
            break
        least = row.level
    return table.where((F.col(count) > 0) & (level >= least)) if least is not None else table.where(F.lit(False))


def held_out(modulus: int, remainder: int):
    """Whether a document is kept from training. A document without an id is never trained on."""
    code = F.crc32(F.col("doc_id").cast("string"))
    return F.coalesce(code % modulus == remainder, F.lit(True))


__all__ = ["DOCUMENT", "KEY", "attach", "fits_broadcast", "held_out", "load", "most_frequent", "session", "stage", "view"]
