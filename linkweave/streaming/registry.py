"""Shortening with the link table as keyed state: a stream that reads its store once, when it first starts."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from linkweave.constants import CONFLICT, CREATED, FAILED
from linkweave.functions.ids import short_id
from linkweave.operators.shorten import arrival, arrival_parts, as_one, assign_ids, new_links
from linkweave.operators.skew import lookup
from linkweave.session import stage
from linkweave.sources.stores import LinkStore
from linkweave.streaming.jobs import AVAILABLE_NOW, start_batches

_ASKED = "first_id string, original_url string, micros long, number long, n long"
_ANSWERS = "original_url string, short_id string, fresh boolean, micros long, number long, n long"
_MOVED = "original_url string, short_id string, batch long"


def _reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first request of each URL in each Arrow batch, with their number. A hot URL reaches its key's task as a row a batch."""
    for frame in frames:
        frame = frame.sort_values(["micros", "number"])
        first = frame.drop_duplicates("original_url")
        yield first.assign(n=first["original_url"].map(frame["original_url"].value_counts()))


class IdRegistry(StatefulProcessor):
    """State of one id: the URLs that have it as their first choice with the ids they got, and the URL that holds it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.links = handle.getMapState("links", "original_url string", "short_id string")
        self.holder = handle.getValueState("holder", "original_url string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for url, link, own in zip(initialState["original_url"], initialState["short_id"], initialState["own"]):
            if own:
                self.links.updateValue((url,), (link,))
            if link == key[0]:
                self.holder.update((url,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = {}  # by URL; more than one only where first choices collide
        for frame in rows:
            for url, micros, number, n in zip(frame["original_url"], frame["micros"], frame["number"], frame["n"]):
                at, before = asked.get(url, ((micros, number), 0))
                asked[url] = (min(at, (micros, number)), before + n)
        made = []
        for url, (at, n) in sorted(asked.items(), key=lambda item: item[1][0]):
            link, fresh = None, False
            if self.links.containsKey((url,)):
                link = self.links.getValue((url,))[0]
            elif not self.holder.exists():
                link, fresh = key[0], True
                self.links.updateValue((url,), (link,))
                self.holder.update((url,))
            made.append((url, link, fresh, *at, n))
        yield pd.DataFrame(made, columns=["original_url", "short_id", "fresh", "micros", "number", "n"])

    def close(self) -> None:
        pass


def _seed(store: LinkStore, id_options: Mapping) -> DataFrame:
    """The store as initial state: every link under the first choice of its URL, and under the id it has where that is another one."""
    links = store.index() if hasattr(store, "index") else store.read()
    links = links.select("original_url", "short_id")
    first = short_id(F.col("original_url"), 0, **id_options)
    own = links.select(first.alias("first_id"), "original_url", "short_id", F.lit(True).alias("own"))
    elsewhere = links.select(F.col("short_id").alias("first_id"), "original_url", "short_id", F.lit(False).alias("own"))
    return own.unionByName(elsewhere.where(F.col("short_id") != first))


def _moved(spark: SparkSession, path: str, before: int) -> DataFrame:
    """Links that did not get the first choice of their URL, from the micro-batches before ``before``: a few among billions."""
    try:
        return spark.read.schema(_MOVED).parquet(path).where(F.col("batch") < before).drop("batch")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MOVED).drop("batch")


def answers_of(requests: DataFrame, store: LinkStore, **id_options) -> DataFrame:
    """Stream of ``original_url, short_id, fresh, micros, number, n``: one row for each URL of a micro-batch.

    ``short_id`` is null where a URL is new and another one holds its first choice. ``micros, number`` are the first arrival. State
    is kept under the first choice of id, so that a URL and those that collide with it meet in one key; it is seeded from ``store`` when the
    stream first starts. Keys are even, as ids are hashes, and a hot URL has been reduced before them.
    """
    micros, number = arrival_parts(F.col("ts"), F.col("req_id"))
    first = short_id(F.col("original_url"), 0, **id_options)
    rows = requests.where("original_url is not null").select(first.alias("first_id"), "original_url", micros.alias("micros"), number.alias("number"))
    return (
        rows.mapInPandas(_reduce, _ASKED)
        .groupBy("first_id")
        .transformWithStateInPandas(
            IdRegistry(), outputStructType=_ANSWERS, outputMode="append", timeMode="none", initialState=_seed(store, id_options).groupBy("first_id")
        )
    )


def stream_shorten_state(
    requests: DataFrame, store: LinkStore, outcomes: str, checkpoint: str, trigger: Mapping = AVAILABLE_NOW, **id_options
) -> StreamingQuery:
    """``stream_shorten`` in ``unique`` mode with the links in keyed state. Outcomes go to ``outcomes``, links to ``store``.

    Requests and the answers for their URLs come in one micro-batch and are joined there. Nobody else may add links to the store while
    the stream or its checkpoint is in use. Only where first choices of ids collide, which hardly ever happens, are the
    store's ids asked; the links that got another id stand in ``<outcomes>_moved`` and overrule the state. A request without a URL
    gets status 500. Start it from ``buffer.state_session``.
    """
    columns = requests.columns
    answers = answers_of(requests, store, **id_options)
    both = requests.select(F.struct(*columns).alias("request"), F.lit(None).cast(f"struct<{_ANSWERS.replace(' ', ':').replace(',:', ',')}>").alias("answer"))
    both = both.unionByName(answers.select(F.struct("*").alias("answer")), allowMissingColumns=True)
    moved_path = f"{outcomes}_moved"

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = stage(batch, "batch")  # once: a second evaluation would run the state again
        asked = batch.where("answer is not null").select("answer.*").withColumn("_arrival", as_one(F.col("micros"), F.col("number")))
        moved = _moved(spark, moved_path, batch_id)
        held = moved.select("short_id", F.col("original_url").alias("_holder"))
        asked = asked.join(moved.withColumnRenamed("short_id", "_moved"), "original_url", "left").join(held, "short_id", "left")
        taken = F.col("_holder").isNotNull() & (F.col("_holder") != F.col("original_url"))
        known = F.coalesce(F.col("_moved"), F.when(~taken, F.col("short_id")))
        fresh = F.col("fresh") & F.col("_moved").isNull()
        asked = stage(asked.select("original_url", known.alias("short_id"), fresh.alias("fresh"), "_arrival", "n"), "asked")
        open_ = asked.where("short_id is null")
        settled = asked.where("short_id is not null")
        if not open_.isEmpty():
            stored = store.read(before=batch_id).select("short_id").unionByName(settled.where("fresh").select("short_id"))
            placed = stage(assign_ids(open_.drop("short_id"), "original_url", "_arrival", stored, **id_options).withColumn("fresh", F.lit(True)), "placed")
            placed.where("short_id is not null").select("original_url", "short_id").write.mode("overwrite").parquet(f"{moved_path}/batch={batch_id}")
            settled = settled.unionByName(placed.select(*settled.columns))
        settled = stage(settled, "answers")
        rows = batch.where("request is not null").select("request.*")
        found = lookup(rows, settled, ["original_url"], ["req_id"], "left", "n")
        first = F.col("fresh") & (arrival(F.col("ts"), F.col("req_id")) == F.col("_arrival"))
        status = F.when(F.col("short_id").isNull(), FAILED).when(first, CREATED).otherwise(CONFLICT)
        path = f"{outcomes}/batch={batch_id}"
        found.select(*columns, "short_id", status.cast("int").alias("status")).write.mode("overwrite").parquet(path)
        store.append(new_links(spark.read.parquet(path)), batch_id)

    return start_batches(both, work, checkpoint, trigger)
