"""Surrogate keys over loads: the serial number of a link table that grows load by load."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.operators.shorten import assign_link_ids
from linkweave.session import scratch_scope
from linkweave.sources.files import numbered, put_new, read_text


class IdLedger:
    """Loads of numbered rows with a durable high-water mark after each.

    Load N's ids follow those of load N-1. A mark is a small file that is renamed into place once the load's rows are written and
    is never replaced, so a crash before it leaves the next id where it was, and a load with a mark is complete: when it is
    offered again, it is compared with what was written and left alone. Other rows under its number are refused, as their ids would
    run into those of the next load. Loads are numbered from 0 without gaps; one writer.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _mark(self, load: int) -> dict:
        return json.loads(read_text(self.spark, f"{self.path}/marks/{load:012d}.json"))

    def high_water(self) -> int:
        """The last id that was given out."""
        loads = numbered(self.spark, f"{self.path}/marks")
        return self._mark(loads[-1])["last"] if loads else 0

    def append(self, rows: DataFrame, order: list[Column], load: int) -> tuple[int, int]:
        """Number ``rows`` in ``order`` (which must be unique), write them as load ``load`` and return the first and the last id.

        The ids take two passes over the load, its range pieces and their counts; no task holds the whole load.
        An empty load is written as such, and its last id is one less than its first.
        """
        done = numbered(self.spark, f"{self.path}/marks")
        if load < 0 or load > len(done):
            raise ValueError(f"load {load} has no load before it; the next is {len(done)}")
        if load < len(done):
            held = self._mark(load)
            if _digest(rows, rows.columns) != (held["last"] - held["first"] + 1, held["digest"]):
                raise ValueError(f"load {load} was written with other rows")
            return held["first"], held["last"]
        start = self._mark(load - 1)["last"] if load else 0
        folder = f"{self.path}/rows/load={load}"
        with scratch_scope(rows.sparkSession):
            made = assign_link_ids(rows, order, start)
            made.write.mode("overwrite").parquet(folder)
        # of what is there, not of a second evaluation of the rows
        n, digest = _digest(self.spark.read.schema(made.schema).parquet(folder), rows.columns)
        put_new(self.spark, f"{self.path}/marks/{load:012d}.json", json.dumps({"first": start + 1, "last": start + n, "digest": digest}))
        return start + 1, start + n

    def read(self, schema: str) -> DataFrame:
        """The rows of all loads that have a mark, with ``link_id`` and ``load``; ``schema`` names the rows' own columns."""
        rows = self.spark.read.schema(f"{schema}, link_id long, load long").parquet(f"{self.path}/rows")
        loads = len(numbered(self.spark, f"{self.path}/marks"))
        return rows.where(F.col("load") < loads)


def _digest(rows: DataFrame, columns: list[str]) -> tuple[int, str]:
    """The number of rows, and a sum over their hashes that does not depend on their order."""
    code = F.xxhash64(*(F.col(c) for c in sorted(columns))).cast("decimal(38,0)")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(code), F.lit(0))).first()
    return n, str(total)
