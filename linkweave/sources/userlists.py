"""Each user's live links, newest first, kept up to date load by load."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.functions.text import deleted_flag
from linkweave.operators.ranking import number_rows, running_total
from linkweave.session import scratch_scope, stage
from linkweave.sources.files import numbered, put_new
from linkweave.sources.stores import LinkStore

PAGE = "day"
_LISTS = "user_id string, page timestamp_ntz, place long, short_id string, original_url string, created_at timestamp_ntz, load long"
_COUNTS = "user_id string, page timestamp_ntz, n long, load long"
_KEYS = ["user_id", "page"]


class UserLists:
    """A view of a link store: counts and lists of live links by user.

    A list is cut into pages by the time of its links (``page``: a unit of ``date_trunc``). A load rewrites the pages it touches and
    no other: a user with a third of all links costs the pages that got a link or lost one, not the whole list. A page's place
    in the list follows from the counts of newer pages when the list is read, so a new page moves nothing.

    A load counts once its mark has been renamed into place, one with a mark is left alone when it is offered again, and
    so a micro-batch may run twice. Loads are numbered from 0 without gaps; one writer. Links without a time
    come last; links without an owner are in no list.
    """

    def __init__(self, spark: SparkSession, path: str, page: str = PAGE):
        self.spark, self.path, self.page = spark, path.rstrip("/"), page

    def _loads(self) -> list[int]:
        return numbered(self.spark, f"{self.path}/marks")

    def _read(self, kind: str, schema: str, loads: list[int]) -> DataFrame:
        folder = f"{self.path}/{kind}"
        if not loads:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", folder).parquet(*(f"{folder}/load={n}" for n in loads))

    def _pages(self, wanted: DataFrame | None = None, on: list[str] = _KEYS) -> DataFrame:
        """``user_id, page, n, load``: where each page was last written, staged."""
        counts = self._read("counts", _COUNTS, self._loads())
        if wanted is not None:
            counts = counts.join(wanted.select(*on), on, "left_semi")
        newest = counts.groupBy(*_KEYS).agg(F.max(F.struct("load", "n")).alias("_last"))
        return stage(newest.select(*_KEYS, "_last.n", "_last.load"), "pages")

    def _rows(self, pages: DataFrame) -> DataFrame:
        """The links on staged ``pages``; only loads that wrote one of them are opened."""
        filled = pages.where("n > 0")
        loads = sorted(r.load for r in filled.select("load").distinct().collect())
        return self._read("lists", _LISTS, loads).join(filled.drop("n"), [*_KEYS, "load"])

    def update(self, store: LinkStore, links: DataFrame, deletes: DataFrame, load: int) -> None:
        """Bring the view up to date with a load that ``store`` has: its ``links`` and ``deletes`` name the ids to look at.

        Their state comes from the store, so deletes before their link, by others and repeated ones mean here what they mean there.
        """
        done = self._loads()
        if load < 0 or load > len(done):
            raise ValueError(f"load {load} has no load before it; the next is {len(done)}")
        if load < len(done):
            return
        with scratch_scope(self.spark):
            ids = stage(links.select("short_id").unionByName(deletes.select("short_id")).distinct(), "ids")
            now = store.read_for("short_id", ids).where("user_id is not null")
            start = F.date_trunc(self.page, F.coalesce("created_at", F.lit("0001-01-01").cast("timestamp_ntz"))).cast("timestamp_ntz")
            now = stage(
                now.select("user_id", start.alias("page"), "short_id", "original_url", "created_at", deleted_flag(F.col("is_deleted")).alias("gone")), "now"
            )
            touched = stage(now.select(*_KEYS).distinct(), "touched")
            kept = self._rows(self._pages(touched)).join(now.select("short_id"), "short_id", "left_anti")
            columns = [*_KEYS, "short_id", "original_url", "created_at"]
            rows = stage(kept.select(*columns).unionByName(now.where("not gone").select(*columns)), "rows")
            placed = number_rows(rows, [F.desc("created_at"), F.asc("short_id")], "place", _KEYS)
            placed = placed.repartitionByRange(*_KEYS, "place").sortWithinPartitions(*_KEYS, "place")
            placed.write.mode("overwrite").parquet(f"{self.path}/lists/load={load}")
            # a page that lost its last link has a count of none
            held = rows.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n"))
            counts = touched.join(held, _KEYS, "left").select(*_KEYS, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
            counts.write.mode("overwrite").parquet(f"{self.path}/counts/load={load}")
        put_new(self.spark, f"{self.path}/marks/{load:012d}.json", json.dumps({"page": self.page}))

    def counts(self, users: DataFrame | None = None) -> DataFrame:
        """``user_id, n_links`` of the users that ever had a link, or of those among ``users``."""
        return self._pages(users, ["user_id"]).groupBy("user_id").agg(F.sum("n").alias("n_links"))

    def lists(self, users: DataFrame | None = None) -> DataFrame:
        """``user_id, pos, short_id, original_url, created_at``: live links newest first from ``pos`` 1 on, of all users or of those among ``users``."""
        pages = self._pages(users, ["user_id"])
        upto = running_total(pages.where("n > 0"), "n", [F.desc("page")], "upto", ["user_id"])
        shift = stage(upto.select(*_KEYS, "n", "load", (F.col("upto") - F.col("n")).alias("before")), "shift")
        columns = ["user_id", (F.col("before") + F.col("place")).alias("pos"), "short_id", "original_url", "created_at"]
        return self._rows(shift).select(*columns)
