"""Link stores: read the current table, add a load of links, add a load of tombstones.

A store keeps two append-only parts and never changes a file. Each load has a number and is written
as a folder of its own, so writing a load again replaces exactly that load. Use one writer, with one
sequence of numbers, per store.

Tombstones keep the time of the delete: one that came before its link was made does nothing,
whatever the order in which the two loads were written.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.operators.deletes import apply_deletes, apply_timed_deletes, timed_tombstones, tombstones
from linkweave.operators.lookup import live_links
from linkweave.operators.shorten import matching
from linkweave.session import stage
from linkweave.sources.readers import read_links, read_links_table
from linkweave.sources.writers import append_links, rewrite_links, write_links_table

_MARK = "short_id string, user_id string"
_TOMBSTONE = f"{_MARK}, ts timestamp_ntz"
_LINK = (
    "short_id string, original_url string, user_id string, is_deleted boolean, "
    "created_at timestamp_ntz, updated_at timestamp_ntz"
)


class LinkStore(Protocol):
    """What a storage backend offers. Implement it to plug in another one."""

    def read(self, before: int | None = None) -> DataFrame: ...

    def read_for(self, key: str, wanted: DataFrame) -> DataFrame: ...

    def append(self, links: DataFrame, load_id: int) -> None: ...

    def tombstone(self, deletes: DataFrame, load_id: int) -> None: ...


def _wanted(wanted: DataFrame, key: str) -> DataFrame:
    """The distinct keys, written: they are asked for twice, and as a stored table a hot one can be split."""
    return stage(wanted.select(key).distinct(), "wanted")


def _read_loads(spark: SparkSession, path: str, schema: str, before: int | None) -> DataFrame:
    try:
        rows = spark.read.schema(schema + ", load long").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    if before is not None:
        rows = rows.where(F.col("load") < before)
    return rows.drop("load")


class ParquetStore:
    """Links and tombstones as parquet, one folder per load; old loads are pruned by folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def links(self, before: int | None = None) -> DataFrame:
        """Links as they were appended, without deletes."""
        return _read_loads(self.spark, f"{self.path}/links", _LINK, before)

    def index(self, before: int | None = None) -> DataFrame:
        """``original_url, short_id`` of all links."""
        return self.links(before).select("original_url", "short_id")

    def tombstones(self, before: int | None = None) -> DataFrame:
        return _read_loads(self.spark, f"{self.path}/tombstones", _TOMBSTONE, before)

    def read(self, before: int | None = None) -> DataFrame:
        return apply_timed_deletes(self.links(before), self.tombstones(before))

    def read_for(self, key: str, wanted: DataFrame) -> DataFrame:
        """The current links whose ``key`` (``short_id``, ``user_id`` or ``original_url``) is in ``wanted``.

        Links and tombstones are narrowed down to the keys before they meet, so that a few clicks do not join the whole store.
        """
        keys = _wanted(wanted, key)
        links = matching(self.links(), keys, key)
        if key == "original_url":
            links = stage(links, "links")
            return apply_timed_deletes(links, matching(self.tombstones(), links, "short_id"))
        return apply_timed_deletes(links, matching(self.tombstones(), keys, key))

    def append(self, links: DataFrame, load_id: int) -> None:
        names = [c.split(" ")[0] for c in _LINK.split(", ")]
        links.select(*names).write.mode("overwrite").parquet(f"{self.path}/links/load={load_id}")

    def tombstone(self, deletes: DataFrame, load_id: int) -> None:
        timed_tombstones(deletes).write.mode("overwrite").parquet(f"{self.path}/tombstones/load={load_id}")

    def compact(self, target: str) -> ParquetStore:
        """A new store with one load: the current table, deleted links kept with their flag."""
        fresh = ParquetStore(self.spark, target)
        fresh.append(self.read(), 0)
        return fresh


class NdjsonStore:
    """The same over an NDJSON folder; the last line of an id wins.

    Its lines have no times, so a delete acts on the links that are there when it is written.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, before: int | None = None) -> DataFrame:
        links = read_links(self.spark, f"{self.path}/links")
        if before is not None:
            raise ValueError("an NDJSON store keeps no load numbers in its rows")
        marks = _read_loads(self.spark, f"{self.path}/tombstones", _MARK, None)
        return apply_deletes(links, marks)

    def read_for(self, key: str, wanted: DataFrame) -> DataFrame:
        return matching(self.read(), _wanted(wanted, key), key)

    def append(self, links: DataFrame, load_id: int) -> None:
        append_links(links, f"{self.path}/links", load_id)

    def tombstone(self, deletes: DataFrame, load_id: int) -> None:
        present = read_links(self.spark, f"{self.path}/links").select("short_id", "user_id")
        marks = tombstones(deletes).join(present, ["short_id", "user_id"], "left_semi")
        marks.write.mode("overwrite").parquet(f"{self.path}/tombstones/load={load_id}")

    def compact(self, target: str) -> NdjsonStore:
        rewrite_links(self.read(), f"{target}/links/load={0:012d}")
        return NdjsonStore(self.spark, target)


class JdbcStore:
    """The same over a database: a link table and a tombstone table, both insert-only.

    A load that is written again is inserted again: the unique keys of the link table refuse it, and
    repeated tombstones change nothing. ``bounds`` and ``partitions`` split the read of the link table only.
    """

    def __init__(self, spark: SparkSession, url: str, table: str = "urls", bounds=None, partitions: int = 64, **options):
        self.spark, self.url, self.table, self.options = spark, url, table, options
        self.split = {"bounds": bounds, "partitions": partitions}

    def read(self, before: int | None = None) -> DataFrame:
        if before is not None:
            raise ValueError("a database table keeps no load numbers in its rows")
        marks = read_links_table(self.spark, self.url, f"{self.table}_tombstones", **self.options)
        links = read_links_table(self.spark, self.url, self.table, **self.split, **self.options)
        return apply_timed_deletes(links, marks)

    def read_for(self, key: str, wanted: DataFrame) -> DataFrame:
        return matching(self.read(), _wanted(wanted, key), key)

    def append(self, links: DataFrame, load_id: int) -> None:
        write_links_table(links, self.url, self.table, **self.options)

    def tombstone(self, deletes: DataFrame, load_id: int) -> None:
        rows = timed_tombstones(deletes)
        options = {k: str(v) for k, v in self.options.items()}
        rows.write.format("jdbc").options(url=self.url, dbtable=f"{self.table}_tombstones", **options).mode(
            "append"
        ).save()


def store_user_urls(store: LinkStore, user_id: str) -> DataFrame:
    """Live links of one user in any store; the user filter reaches the scan."""
    return live_links(store.read().where(F.col("user_id") == user_id))
