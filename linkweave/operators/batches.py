"""Batch requests: many URLs in one request, saved all or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkweave.constants import BAD_REQUEST, CREATED, FAILED, ID_CHARSET, ID_LENGTH
from linkweave.functions.ids import short_id
from linkweave.functions.text import is_blank
from linkweave.operators.shorten import assign_ids, matching
from linkweave.operators.skew import ROWS_PER_TASK, lookup
from linkweave.session import scratch_path, stage


def valid_batch(items: DataFrame) -> DataFrame:
    """``batch_id, status`` of each batch: one blank URL or correlation id makes it a 400.

    An empty batch has no items; ``empty_batches`` adds those.
    """
    return _judged(items).drop("_n")


def _judged(items: DataFrame) -> DataFrame:
    bad = is_blank(F.col("original_url")) | is_blank(F.col("correlation_id"))
    return items.groupBy("batch_id").agg(
        F.when(F.bool_or(bad), BAD_REQUEST).otherwise(CREATED).cast("int").alias("status"),
        F.count(F.lit(1)).alias("_n"),
    )


def empty_batches(batches: DataFrame, items: DataFrame) -> DataFrame:
    """``batch_id, status`` of the batches that came without items."""
    with_items = items.select("batch_id").distinct()
    return batches.join(with_items, "batch_id", "left_anti").select(
        "batch_id", F.lit(BAD_REQUEST).alias("status")
    )


def accepted_items(items: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Items of the valid batches."""
    good = _judged(items).where(F.col("status") == CREATED).drop("status")
    return lookup(items, good, ["batch_id"], ["pos"], "left_semi", "_n", rows_per_task)


def batch_unique_ids(
    items: DataFrame, attempt: int = 0, charset: str = ID_CHARSET, length: int = ID_LENGTH
) -> DataFrame:
    """Ids that several rows of one batch would get in this attempt: ``batch_id, short_id, n``."""
    candidate = short_id(_item_key(), attempt, charset, length)
    return (
        items.select("batch_id", candidate.alias("short_id"))
        .groupBy("batch_id", "short_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )


def _item_key():
    return F.concat_ws(":", F.col("batch_id"), F.col("pos"))


def batch_save(items: DataFrame, links: DataFrame | None = None, **id_options) -> DataFrame:
    """Append mode: every item of a valid batch becomes a link, repeated URLs too.

    Returns the items with ``short_id``.
    """
    rows = accepted_items(items).withColumn("_key", _item_key())
    return assign_ids(rows, "_key", "_key", links, **id_options).drop("_key")


def batch_save_append(items: DataFrame, links: DataFrame | None = None, **id_options) -> DataFrame:
    """Append mode: every item with the ``status`` of its batch (201, 400) or, where it got no free id, 500."""
    judged = stage(_judged(items), "judged")
    marked = stage(lookup(items, judged, ["batch_id"], ["pos"], "left", "_n"), "marked")
    rows = marked.where(F.col("status") == CREATED).withColumn("_key", _item_key())
    saved = assign_ids(rows, "_key", "_key", links, **id_options).drop("_key")
    saved = saved.withColumn("status", F.when(F.col("short_id").isNull(), FAILED).otherwise(F.col("status")).cast("int"))
    others = marked.where(F.col("status") != CREATED).withColumn("short_id", F.lit(None).cast("string"))
    return saved.unionByName(others)


def decide_batches(
    items: DataFrame, links: DataFrame | None = None, rows_per_task: int = ROWS_PER_TASK, claims: DataFrame | None = None
) -> DataFrame:
    """Unique mode: ``batch_id, accepted`` for batches taken in ``batch_id`` order.

    A batch is accepted when it repeats no URL and holds none of the store or of an earlier accepted
    batch; a refused batch blocks nobody. ``claims`` (``original_url, claimed``, one row per URL) are single requests that come
    between the batches: whatever became of them, their URL is stored from the place ``claimed`` in the order of ``batch_id`` on, so
    a later batch that holds it is refused. Batches are decided in rounds:

    * a batch that comes first for all URLs that it shares with open batches is accepted;
    * a batch whose only earlier open holder, for all its URLs, is one batch is the opposite of that one. Such
      batches point to it; each round a pointer takes over the pointer of its target, so a chain of n batches
      is settled in about log2(n) rounds;
    * whoever shares a URL with an accepted batch is refused.

    The earliest open batch is always decided, so the rounds end. Only URLs that several open batches hold are kept, so
    the work shrinks with each round. Every step is a join or an aggregate over staged tables; verdicts
    are written per round into one folder, and a round reads only those of the one before: whoever pointed to a batch
    that was decided earlier was settled then.
    """
    spark = items.sparkSession
    per_url = items.groupBy("batch_id", "original_url").agg(F.count(F.lit(1)).alias("_copies"))
    flawed = F.col("_copies") > 1
    if links is not None or claims is not None:
        per_url = stage(per_url, "per_url")
    if links is not None:
        stored = stage(matching(links.select("original_url"), per_url, "original_url").distinct(), "stored")
        per_url = lookup(per_url, stored.withColumn("_stored", F.lit(True)), ["original_url"], ["batch_id"])
        flawed = flawed | F.col("_stored").isNotNull()
    if claims is not None:
        claimed = stage(matching(claims.select("original_url", "claimed"), per_url, "original_url"), "claimed")
        per_url = lookup(per_url, claimed, ["original_url"], ["batch_id"])
        flawed = flawed | F.coalesce(F.col("claimed") < F.col("batch_id"), F.lit(False))
    pairs = stage(per_url.select("batch_id", "original_url", flawed.alias("_flawed")), "pairs")
    clean = stage(pairs.groupBy("batch_id").agg((~F.bool_or("_flawed")).alias("_clean"), F.count(F.lit(1)).alias("_n")), "clean")
    kept = clean.where("_clean").drop("_clean")
    pairs = lookup(pairs.drop("_flawed"), kept, ["batch_id"], ["original_url"], "left_semi", "_n", rows_per_task)
    no_batch = F.lit(None).cast(items.schema["batch_id"].dataType)
    waiting = kept.select("batch_id", no_batch.alias("_to"), F.lit(True).alias("_odd"))
    folder = scratch_path(spark, "verdicts")
    refused = clean.where("not _clean").select("batch_id", F.lit(False).alias("accepted"), no_batch.alias("_to"), F.lit(True).alias("_odd"))
    refused.write.parquet(f"{folder}/round=0")
    last, rounds = refused.limit(0), 0
    while not waiting.isEmpty():
        rounds += 1
        state, pairs = _round(waiting, stage(pairs, "open"), last.select("batch_id", "accepted"))
        state.write.parquet(f"{folder}/round={rounds}")
        state = spark.read.schema(refused.schema).parquet(f"{folder}/round={rounds}")
        last = state.where("accepted is not null")
        waiting = state.where("accepted is null").drop("accepted")
        pairs = pairs.join(waiting.select("batch_id"), "batch_id", "left_semi")
    written = spark.read.schema(refused.schema).parquet(folder)
    return written.where("accepted is not null").select("batch_id", "accepted")


def _round(waiting: DataFrame, pairs: DataFrame, last: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``batch_id, accepted, _to, _odd`` of the ``waiting`` batches, null where one stays open, and the ``pairs`` whose URL another of them has.

    ``_to`` is a batch that this one depends on alone, ``_odd`` whether it is its opposite. ``last``: verdicts of the round before.
    """
    # the first two holders of each URL; the limit is taken before the shuffle, so a hot URL costs two rows per task
    rank = F.row_number().over(Window.partitionBy("original_url").orderBy("batch_id"))
    two = pairs.withColumn("_rank", rank).where("_rank <= 2")
    holders = two.groupBy("original_url").agg(F.min("batch_id").alias("_first"), F.max("batch_id").alias("_second"))
    holders = stage(holders.where("_first < _second"), "holders")
    shared = stage(pairs.join(holders, "original_url"), "shared")
    first, second = F.col("batch_id") == F.col("_first"), F.col("batch_id") == F.col("_second")
    parent = F.when(second, F.col("_first"))
    facts = shared.groupBy("batch_id").agg(
        F.bool_and(first).alias("_wins"), F.bool_and(first | second).alias("_simple"),
        F.min(parent).alias("_low"), F.max(parent).alias("_high"),
    )
    depends = F.when(F.col("_simple") & (F.col("_low") == F.col("_high")), F.col("_low"))
    # a batch that shares no URL any more wins; a pointer that there is already stays
    wins = F.coalesce("_wins", F.lit(True))
    facts = waiting.join(facts.select("batch_id", "_wins", depends.alias("_new")), "batch_id", "left").select(
        "batch_id", wins.alias("_wins"), F.when(~wins, F.coalesce("_to", "_new")).alias("_to"),
        F.when(F.col("_to").isNotNull(), F.col("_odd")).otherwise(True).alias("_odd"),
    )
    facts = stage(facts, "facts")
    target = facts.select(F.col("batch_id").alias("_to"), F.col("_to").alias("_next"), F.col("_odd").alias("_next_odd"))
    odd = F.when(F.col("_next").isNotNull(), F.col("_odd") != F.col("_next_odd")).otherwise(F.col("_odd"))
    jumped = facts.join(target, "_to", "left").select("batch_id", "_wins", F.coalesce("_next", "_to").alias("_to"), odd.alias("_odd"))
    # what the target came to, in this round or the one before
    known = facts.where("_wins").select("batch_id", F.lit(True).alias("accepted")).unionByName(last)
    known = known.select(F.col("batch_id").alias("_to"), F.col("accepted").alias("_was"))
    accepted = F.when(F.col("_wins"), True).when(F.col("_was").isNotNull(), F.col("_was") != F.col("_odd"))
    settled = jumped.join(known, "_to", "left").select("batch_id", accepted.alias("accepted"), "_to", "_odd")
    taken = stage(shared.join(settled.where("accepted").select("batch_id"), "batch_id", "left_semi").select("original_url").distinct(), "taken")
    beaten = shared.join(taken, "original_url", "left_semi").select("batch_id").distinct().withColumn("_beaten", F.lit(True))
    state = settled.join(beaten, "batch_id", "left")
    verdict = F.coalesce("accepted", F.when(F.col("_beaten"), False))
    return state.select("batch_id", verdict.alias("accepted"), "_to", "_odd"), shared.select("batch_id", "original_url")


def batch_save_unique(
    items: DataFrame, links: DataFrame | None = None, rows_per_task: int = ROWS_PER_TASK, index: DataFrame | None = None, **id_options
) -> DataFrame:
    """Unique mode: every item with the ``status`` of its batch (201, 400, 500) and, for 201, its
    ``short_id``. ``index``: as in ``shorten_unique``."""
    judged = stage(_judged(items), "judged")
    good = judged.where(F.col("status") == CREATED).drop("status")
    valid = lookup(items, good, ["batch_id"], ["pos"], "left_semi", "_n", rows_per_task)
    verdicts = decide_batches(valid.select("batch_id", "original_url"), links if index is None else index, rows_per_task)
    code = F.when(F.col("status") == BAD_REQUEST, BAD_REQUEST).when(F.col("accepted"), CREATED).otherwise(FAILED)
    status = judged.join(verdicts, "batch_id", "left").select("batch_id", "_n", code.cast("int").alias("status"))
    marked = stage(lookup(items, status, ["batch_id"], ["pos"], "left", "_n", rows_per_task), "marked")
    # an accepted batch holds no URL twice and shares none, so its URLs are unique
    saved = assign_ids(marked.where(F.col("status") == CREATED), "original_url", "original_url", links, **id_options)
    others = marked.where(F.col("status") != CREATED).withColumn("short_id", F.lit(None).cast("string"))
    return saved.unionByName(others)
