"""A link store of bucketed tables with versions.

Links lie bucketed and sorted by ``short_id``, the index from URL to id by ``original_url``, tombstones by ``short_id``, all in the same
number of buckets. So joins with the store shuffle the other side only, deletes meet their links in place, and a look-up of
a few keys opens only their buckets and, as these are sorted, only their pages.

Each load is a segment that is written once and never changed. A version is a manifest, a small file that lists its
segments; it is written beside and renamed into place, which fails if the version is there already. What a manifest does not name does
not exist: a crash between data and manifest leaves no trace but files that ``clean`` removes. Readers follow
the newest version, or stay on the one that ``at`` pins.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.functions.text import deleted_flag
from linkweave.operators.deletes import timed_tombstones
from linkweave.operators.shorten import matching
from linkweave.session import stage
from linkweave.sources.files import file_system, numbered, put_new, read_text

LINKS, URLS, MARKS = "links", "urls", "tombstones"
_COLUMNS = {
    LINKS: "short_id string, original_url string, user_id string, is_deleted boolean, created_at timestamp_ntz, updated_at timestamp_ntz",
    URLS: "original_url string, short_id string",
    MARKS: "short_id string, user_id string, ts timestamp_ntz",
}
_KEY = {LINKS: "short_id", URLS: "original_url", MARKS: "short_id"}
# Up to so many wanted keys become a filter, which opens only their buckets and pages; more are joined.
FEW_KEYS = 200
# Rows of a page: the least that a look-up reads.
PAGE_ROWS = 2000
# How often a load is offered again after another writer was first. The data are written once.
TRIES = 20


class LostRace(RuntimeError):
    """Another writer committed the version that this one was made for."""


@dataclass(frozen=True)
class Manifest:
    """``segments``: name, kind and load of each. Loads up to ``merged`` have been compacted and cannot be written again."""

    version: int
    buckets: int
    merged: int = -1
    segments: list[dict] = field(default_factory=list)

    def named(self, kind: str, before: int | None = None) -> list[str]:
        return [s["name"] for s in self.segments if s["kind"] == kind and (before is None or s["load"] < before)]

    def without(self, kinds: tuple[str, ...], load: int) -> list[dict]:
        return [s for s in self.segments if not (s["kind"] in kinds and s["load"] == load)]


class VersionedStore:
    """``LinkStore`` over bucketed segments. ``buckets`` counts for a new store only: choose it so that a bucket of all links fits a task.

    Loads are numbered from 0 on; a load that is written again replaces itself, so a micro-batch may run twice.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, page_rows: int = PAGE_ROWS, version: int | None = None):
        self.spark, self.path, self.page_rows, self.pinned = spark, path.rstrip("/"), page_rows, version
        if not self._versions():
            try:
                self._commit(Manifest(0, buckets))
            except LostRace:
                pass  # another writer made the same store

    # --- versions

    def _versions(self) -> list[int]:
        return numbered(self.spark, f"{self.path}/versions")

    def latest(self) -> int:
        return self._versions()[-1]

    def at(self, version: int) -> VersionedStore:
        """The store as it was then."""
        return VersionedStore(self.spark, self.path, page_rows=self.page_rows, version=version)

    def manifest(self) -> Manifest:
        version = self.latest() if self.pinned is None else self.pinned
        return Manifest(**json.loads(read_text(self.spark, f"{self.path}/versions/{version:012d}.json")))

    def _commit(self, manifest: Manifest) -> None:
        """Put the manifest into place, unless the version is there already."""
        try:
            put_new(self.spark, f"{self.path}/versions/{manifest.version:012d}.json", json.dumps(manifest.__dict__))
        except FileExistsError as error:
            raise LostRace(f"version {manifest.version} is there already") from error

    def _offer(self, change, tries: int) -> int:
        """Commit ``change`` of the newest manifest, again on the next one where another writer was first."""
        if self.pinned is not None:
            raise ValueError("a pinned version is read-only")
        for left in range(tries - 1, -1, -1):
            made = change(self.manifest())
            try:
                self._commit(made)
                return made.version
            except LostRace:
                if not left:
                    raise
        raise ValueError("at least one try")

    # --- segments

    def _write(self, kind: str, rows: DataFrame, load: int) -> dict:
        """A new segment; no version names it yet."""
        buckets, key = self.manifest().buckets, _KEY[kind]
        name, table = uuid.uuid4().hex, f"linkweave_load_{uuid.uuid4().hex}"
        columns = [c.split(" ")[0] for c in _COLUMNS[kind].split(", ")]
        writer = rows.select(*columns, _bucket(key, buckets).alias("bucket")).repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key)
        writer.option("parquet.page.row.count.limit", str(self.page_rows)).option("path", f"{self.path}/{kind}/seg={name}").saveAsTable(table)
        rows.sparkSession.sql(f"drop table {table}")  # the files stay
        return {"name": name, "kind": kind, "load": load}

    def _table(self, kind: str, before: int | None = None, wanted: Column | None = None) -> DataFrame:
        """The segments of the version as one bucketed table; only they are registered, so no folder is listed."""
        manifest = self.manifest()
        names = manifest.named(kind)
        table = f"linkweave_{kind}_{uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex}_{manifest.version}"
        if not self.spark.catalog.tableExists(table):
            key = _KEY[kind]
            self.spark.sql(
                f"create table {table} ({_COLUMNS[kind]}, bucket int, seg string) using parquet partitioned by (seg) "
                f"clustered by ({key}) sorted by ({key}) into {manifest.buckets} buckets location '{self.path}/{kind}'"
            )
            if names:
                parts = " ".join(f"partition (seg = '{n}') location '{self.path}/{kind}/seg={n}'" for n in names)
                self.spark.sql(f"alter table {table} add if not exists {parts}")
        rows = self.spark.table(table)
        if before is not None:
            if before <= manifest.merged:
                raise ValueError(f"loads up to {manifest.merged} have been merged; load {before} cannot be run again")
            rows = rows.where(F.col("seg").isin(manifest.named(kind, before)) if manifest.named(kind, before) else F.lit(False))
        return (rows if wanted is None else rows.where(wanted)).drop("bucket", "seg")

    def _only(self, kind: str, keys: DataFrame, key: str) -> DataFrame:
        """Rows whose key is among the staged distinct ``keys``.

        Few keys become a filter. Each key comes with its bucket: in the pages of other buckets it would lie between least and greatest as well.
        """
        own = key == _KEY[kind]
        place = _bucket(key, self.manifest().buckets) if own else F.lit(None).cast("int")
        few = keys.where(F.col(key).isNotNull()).select(key, place).limit(FEW_KEYS + 1).collect()
        if len(few) > FEW_KEYS:
            return matching(self._table(kind), keys, key)
        tests = [(F.col(key) == F.lit(v)) & (F.col("bucket") == F.lit(b)) if own else F.col(key) == F.lit(v) for v, b in few]
        return self._table(kind, wanted=_any_of(tests))

    # --- reading

    def links(self, before: int | None = None) -> DataFrame:
        """Links as they were appended, without deletes."""
        return self._table(LINKS, before)

    def index(self, before: int | None = None) -> DataFrame:
        """``original_url, short_id`` of all links."""
        return self._table(URLS, before)

    def tombstones(self, before: int | None = None) -> DataFrame:
        return self._table(MARKS, before)

    def read(self, before: int | None = None) -> DataFrame:
        return _with_deletes(self.links(before), self.tombstones(before))

    def read_for(self, key: str, wanted: DataFrame) -> DataFrame:
        """The current links whose ``key`` (``short_id``, ``user_id`` or ``original_url``) is in ``wanted``."""
        if key == "original_url":
            ids = stage(self._only(URLS, stage(wanted.select(key).distinct(), "wanted"), key).select("short_id"), "ids")
            return self.read_for("short_id", ids)
        keys = stage(wanted.select(key).distinct(), "wanted")
        found = _with_deletes(self._only(LINKS, keys, key), self._only(MARKS, keys, key))
        # written, so that a later join of many rows with one hot key is between two shuffles, which are split at run time
        return stage(found, "found")

    # --- writing

    def append(self, links: DataFrame, load_id: int, tries: int = TRIES) -> int:
        """Add a load of links; returns the version that has it."""
        if not links.isStreaming:
            links = stage(links, "load")  # written twice, under two keys
        fresh = [self._write(LINKS, links, load_id), self._write(URLS, links, load_id)]
        return self._offer(lambda m: _added(m, (LINKS, URLS), load_id, fresh), tries)

    def tombstone(self, deletes: DataFrame, load_id: int, tries: int = TRIES) -> int:
        """Add a load of deletes. Those that name a link of somebody else are left out, as they never act: an id keeps its owner."""
        marks = stage(timed_tombstones(deletes), "marks")
        owners = matching(self.links().select("short_id", F.col("user_id").alias("owner")), marks.select("short_id").distinct(), "short_id")
        marks = marks.join(owners, "short_id", "left").where("owner is null or owner = user_id").drop("owner")
        fresh = [self._write(MARKS, marks, load_id)]
        return self._offer(lambda m: _added(m, (MARKS,), load_id, fresh), tries)

    def compact(self, before: int | None = None, tries: int = TRIES) -> int:
        """A new version in which the loads before ``before`` are one, deleted links kept with their flag. Returns its number.

        By default all loads but the newest are merged, as a stream may have to run that one again. Loads that other writers add meanwhile
        stay as they are. Deletes of ids that no merged link has are kept. Readers of older versions are not touched.
        """
        old = self.manifest()
        before = max((s["load"] for s in old.segments), default=0) if before is None else before
        gone = {s["name"] for s in old.segments if s["load"] < before}
        if not gone:
            return old.version
        here = self.at(old.version)
        links = stage(_with_deletes(here.links(before), here.tombstones(before)), "merged")
        marks = here.tombstones(before).join(links.select("short_id"), "short_id", "left_anti")
        load = before - 1
        fresh = [self._write(LINKS, links, load), self._write(URLS, links, load), self._write(MARKS, marks, load)]

        def change(newest: Manifest) -> Manifest:
            if not gone <= {s["name"] for s in newest.segments}:
                raise LostRace("another writer has merged or rewritten a load meanwhile")
            kept = [s for s in newest.segments if s["name"] not in gone]
            return Manifest(newest.version + 1, newest.buckets, max(newest.merged, load), kept + fresh)

        return self._offer(change, tries)

    def clean(self, keep: int = 2, grace_seconds: float = 3600.0) -> list[str]:
        """Remove the versions before the last ``keep`` and the segments that no kept version names, unless younger than
        ``grace_seconds``: a writer may be about to commit them. Returns the segments' names."""
        versions = self._versions()
        named = {s["name"] for v in versions[-keep:] for s in self.at(v).manifest().segments}
        now = self.spark._jvm.java.lang.System.currentTimeMillis()
        for version in versions[:-keep]:
            fs, place = file_system(self.spark, f"{self.path}/versions/{version:012d}.json")
            fs.delete(place, False)
        removed = []
        for kind in (LINKS, URLS, MARKS):
            fs, folder = file_system(self.spark, f"{self.path}/{kind}")
            for status in fs.listStatus(folder) if fs.exists(folder) else ():
                name = status.getPath().getName().removeprefix("seg=")
                if name not in named and now - status.getModificationTime() >= 1000 * grace_seconds:
                    fs.delete(status.getPath(), True)
                    removed.append(name)
        return removed


def _added(newest: Manifest, kinds: tuple[str, ...], load: int, fresh: list[dict]) -> Manifest:
    if load <= newest.merged:
        raise ValueError(f"loads up to {newest.merged} have been merged; load {load} cannot be written again")
    return Manifest(newest.version + 1, newest.buckets, newest.merged, newest.without(kinds, load) + fresh)


def _bucket(key: str, buckets: int) -> Column:
    """The bucket that Spark puts a key into."""
    return F.pmod(F.hash(key), F.lit(buckets)).cast("int")


def _any_of(tests: list[Column]) -> Column:
    """Any of the tests, as a balanced tree: a list of values would reach the scan as a range only."""
    tests = tests or [F.lit(False)]
    while len(tests) > 1:
        tests = [reduce(lambda a, b: a | b, tests[i : i + 2]) for i in range(0, len(tests), 2)]
    return tests[0]


def _with_deletes(links: DataFrame, marks: DataFrame) -> DataFrame:
    """``links`` with the deletes applied, in place: both are partitioned by ``short_id``. As an equality of owners would
    ask for a partitioning by owner as well, it is written as a range."""
    last = marks.groupBy("short_id", "user_id").agg(F.max("ts").alias("_last"))
    last = last.select(F.col("short_id").alias("_id"), F.col("user_id").alias("_by"), "_last")
    owner = F.col("user_id").between(F.col("_by"), F.col("_by"))
    born = F.coalesce(F.col("created_at"), F.lit("0001-01-01").cast("timestamp_ntz"))
    flag = deleted_flag(F.col("is_deleted")) | F.coalesce(F.col("_last") >= born, F.lit(False))
    return links.join(last, (F.col("short_id") == F.col("_id")) & owner, "left").withColumn("is_deleted", flag).select(*links.columns)
