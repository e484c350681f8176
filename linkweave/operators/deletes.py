"""Soft deletes: only the owner's links, repeats and unknown ids change nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.functions.text import clean_delete_id, deleted_flag
from linkweave.operators.ranking import number_rows
from linkweave.operators.shorten import arrival
from linkweave.operators.skew import ROWS_PER_TASK, lookup


def clean_deletes(requests: DataFrame) -> DataFrame:
    """``req_id, ts, user_id, pos, short_id`` of every id of every request (column ``ids``)."""
    named = F.transform(
        "ids", lambda entry, pos: F.struct(pos.alias("pos"), clean_delete_id(entry).alias("short_id"))
    )
    # cleaned and filtered inside the array: a filter on rows would clean each id a second time
    kept = F.filter(named, lambda item: item["short_id"].isNotNull())
    return requests.select("req_id", "ts", "user_id", F.inline(kept))


def group_deletes(deletes: DataFrame) -> DataFrame:
    """Each user's delete buffer in order of arrival: ``user_id, seq, short_id``.

    One row per id instead of one list per user, which has no bound.
    """
    order = [F.col("ts"), F.col("req_id"), F.col("pos")]
    return number_rows(deletes, order, "seq", ["user_id"]).select("user_id", "seq", "short_id")


def tombstones(deletes: DataFrame) -> DataFrame:
    """Distinct ``short_id, user_id`` to delete; copies are dropped before the shuffle."""
    return deletes.select("short_id", "user_id").distinct()


def timed_tombstones(deletes: DataFrame) -> DataFrame:
    """``short_id, user_id, ts``: the time of the last delete of each pair. A delete without a time counts as one that comes last."""
    known = F.col("ts").cast("timestamp_ntz") if "ts" in deletes.columns else F.lit(None).cast("timestamp_ntz")
    at = F.coalesce(known, F.lit("9999-12-31").cast("timestamp_ntz"))
    return deletes.groupBy("short_id", "user_id").agg(F.max(at).alias("ts"))


def apply_timed_deletes(links: DataFrame, marks: DataFrame) -> DataFrame:
    """``links`` with ``is_deleted`` set where the owner's delete came at or after ``created_at``.

    A delete before its link existed named an unknown id and does nothing. Marks are ``short_id, user_id, ts``.
    """
    last = marks.groupBy("short_id", "user_id").agg(F.max("ts").alias("_last"))
    born = F.coalesce(F.col("created_at").cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz"))
    flag = deleted_flag(F.col("is_deleted")) | F.coalesce(F.col("_last") >= born, F.lit(False))
    return (
        links.join(last, ["short_id", "user_id"], "left")
        .withColumn("is_deleted", flag)
        .select(*links.columns)
    )


def delete_match(links: DataFrame, deletes: DataFrame) -> DataFrame:
    """Links that the deletes hit."""
    return links.join(tombstones(deletes), ["short_id", "user_id"], "left_semi")


def apply_deletes(links: DataFrame, deletes: DataFrame) -> DataFrame:
    """``links`` with ``is_deleted`` set where a delete hits; nothing else changes."""
    marks = tombstones(deletes).withColumn("_hit", F.lit(True))
    flag = deleted_flag(F.col("is_deleted")) | F.col("_hit").isNotNull()
    return (
        links.join(marks, ["short_id", "user_id"], "left")
        .withColumn("is_deleted", flag)
        .select(*links.columns)
    )


def delete_times(links: DataFrame, deletes: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``short_id, _deleted`` with the arrival of the first delete that hits each link.

    ``links`` has ``_created``; a delete that came before its link does nothing.
    """
    at = arrival(F.col("ts"), F.col("req_id"))
    hits = deletes.select("short_id", "user_id", at.alias("_at"))
    owned = links.select("short_id", "user_id", "_created")
    return (
        lookup(hits, owned, ["short_id", "user_id"], ["_at"], "inner", None, rows_per_task)
        .where(F.col("_at") > F.col("_created"))
        .groupBy("short_id")
        .agg(F.min("_at").alias("_deleted"))
    )
