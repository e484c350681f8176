"""The service's requests as bulk jobs, from raw requests to responses, audit events and the store.

``requests`` has ``req_id, ts, token, body`` and, for shorten requests, ``kind``: ``text`` or
``json``. Each job answers all requests of one route. A job that is run again with the same load
number writes the same links, ids and users again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.constants import BAD_REQUEST, CREATED, FAILED, OK
from linkweave.functions.text import join_path
from linkweave.functions.tokens import authenticate, derived_user_id
from linkweave.operators import batches, deletes, lookup, responses, shorten
from linkweave.operators.skew import lookup as spread_join
from linkweave.session import stage
from linkweave.sources.readers import decode_batch_bodies, decode_url_bodies
from linkweave.sources.stores import ParquetStore
from linkweave.sources.versions import VersionedStore

Store = ParquetStore | VersionedStore

UNIQUE, APPEND = "unique", "append"


@dataclass
class Answers:
    """``responses``: ``req_id, status`` and what the route returns. ``audit``: events. ``lists``:
    the links of each user who asked for them."""

    responses: DataFrame
    audit: DataFrame | None = None
    lists: DataFrame | None = None


def identify(requests: DataFrame, key: str) -> DataFrame:
    """Add ``user_id`` and ``new_token``, which is null for a user who came with a valid token."""
    who = authenticate(F.col("token"), key, derived_user_id(F.col("req_id"), key))
    return (
        requests.withColumn("_who", who)
        .withColumn("user_id", F.col("_who.user_id"))
        .withColumn("new_token", F.when(F.col("_who.reissued"), F.col("_who.token")))
        .drop("_who", "token")
    )


def shorten_job(
    requests: DataFrame, store: Store, load_id: int, base: str, key: str, mode: str = UNIQUE
) -> Answers:
    """POST of one URL, as text or as a JSON object. ``mode`` is ``unique`` or ``append``."""
    known = identify(requests, key)
    texts = known.where(F.col("kind") == responses.TEXT).withColumn("url", F.col("body"))
    objects = decode_url_bodies(known.where(F.col("kind") == responses.JSON)).drop("status")
    asked = stage(responses.valid_shorten(texts.unionByName(objects).drop("body")), "asked")
    valid = asked.where("valid").drop("valid", "url")
    links = store.links(before=load_id)
    if mode == UNIQUE:
        outcomes = stage(shorten.shorten_unique(valid, links, index=store.index(before=load_id)), "outcomes")
    else:
        outcomes = stage(shorten.shorten_append(valid, links), "outcomes")
    store.append(shorten.new_links(outcomes), load_id)
    no_text = F.lit(None).cast("string")
    refused = asked.where("not valid").select(
        "req_id", F.lit(BAD_REQUEST).alias("status"), no_text.alias("content_type"), no_text.alias("body"), "new_token"
    )
    answered = responses.shorten_response(outcomes, base, ["new_token"])
    return Answers(answered.unionByName(refused), responses.shorten_events(outcomes))


def follow_job(requests: DataFrame, store: Store, key: str) -> Answers:
    """GET of a short id (column ``short_id``)."""
    asked = stage(identify(requests, key), "asked")
    outcomes = stage(lookup.resolve(asked, store.read_for("short_id", asked)), "outcomes")
    return Answers(outcomes.select("req_id", "status", "location", "new_token"), responses.follow_events(outcomes))


def list_job(requests: DataFrame, store: Store, base: str, key: str) -> Answers:
    """GET of the user's links. The links are in ``lists`` once per user, not once per request."""
    asked = stage(identify(requests, key).select("req_id", "user_id", "new_token"), "asked")
    links = stage(store.read_for("user_id", asked), "links")  # the store is read once
    status = lookup.user_has_links(asked, links).drop("n_links")
    answered = spread_join(asked, stage(status, "status"), ["user_id"], ["req_id"]).select("req_id", "user_id", "status", "new_token")
    lists = lookup.user_urls(asked, links, base).where(F.col("status") == OK).drop("status")
    return Answers(answered, lists=lists)


def delete_job(requests: DataFrame, store: Store, load_id: int, key: str) -> Answers:
    """DELETE of a list of ids; the tombstones are written before the job ends."""
    asked = responses.valid_delete(identify(requests, key).withColumn("valid", F.lit(True)))
    store.tombstone(deletes.clean_deletes(asked.where("ids is not null")), load_id)
    return Answers(asked.select("req_id", "status", "new_token"))


def batch_job(requests: DataFrame, store: Store, load_id: int, base: str, key: str, mode: str = UNIQUE) -> Answers:
    """POST of a list of URLs, all or nothing. The requests act in the order of ``req_id``; in ``append`` mode every valid batch is saved.

    The answer of a saved batch is one row per item, in order of ``pos``.
    """
    known = identify(requests, key)
    items = stage(decode_batch_bodies(known.withColumnRenamed("req_id", "batch_id")).drop("body"), "items")
    good = items.where("status is null").drop("status")
    if mode == UNIQUE:
        saved = stage(batches.batch_save_unique(good, store.links(before=load_id), index=store.index(before=load_id)), "saved")
    else:
        saved = stage(batches.batch_save_append(good, store.links(before=load_id)), "saved")
    created = saved.where(F.col("status") == CREATED)
    store.append(shorten.new_links(created), load_id)
    rows = created.select(
        F.col("batch_id").alias("req_id"), "status", "pos", "correlation_id",
        join_path(base, F.col("short_id")).alias("short_url"), "new_token",
    )
    unreadable = items.where("status is not null").select(F.col("batch_id").alias("req_id"), "status", "new_token")
    failed = saved.where(F.col("status").isin(BAD_REQUEST, FAILED)).select(
        F.col("batch_id").alias("req_id"), "status", "new_token"
    )
    bare = unreadable.unionByName(failed.distinct())
    return Answers(rows.unionByName(bare, allowMissingColumns=True))
