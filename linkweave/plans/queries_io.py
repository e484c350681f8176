"""Queries for sources, sinks, stores and streams. Each writes to a fresh scratch folder and reads back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from linkweave import schemas
from linkweave.functions.ids import short_id
from linkweave.functions.json import decode_line
from linkweave.functions.tokens import sign_token
from linkweave.operators import flush, lookup, responses, shorten
from linkweave.plans import fixtures as fx
from linkweave.plans import service
from linkweave.plans.catalog import ORACLES, query
from linkweave.plans.fixtures import sql, sql_id
from linkweave.plans.queries_scalar import SQL_EVENT
from linkweave.plans.queries_table import (
    audit_events,
    click_outcomes,
    current_links,
    ids_to_delete,
    shorten_outcomes,
)
from linkweave.session import scratch_path
from linkweave.sources import backend, keybook, ledger, readers, stores, userlists, versions, writers
from linkweave.streaming import buffer, intake, jobs, registry

_LINE = ["uuid", "short_id", "original_url", "user_id", "is_deleted"]
_SQL_LINE = "select '' as uuid, short_id, original_url, user_id, is_deleted"


def _write_in_order(rows, path, *order):
    """Text lines in ``order`` over all files of the folder."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.text(path)


def _link_lines(spark, sf_dir):
    """All requests with a ``line`` of one of these shapes: whole, cut off, empty, null, wrongly
    typed, repeated key, text behind the value, keys in upper case."""
    fields = F.struct(
        F.concat(F.lit("x"), F.col("req_id").cast("string")).alias("uuid"),
        short_id(F.col("original_url")).alias("short_url"),
        "original_url",
        "user_id",
        (F.col("req_id") % 2 == 0).alias("is_deleted"),
    )
    whole = F.to_json(fields)
    upper = F
    for name in ("uuid", "short_url", "original_url", "user_id", "is_deleted"):
        upper = F.replace(whole if upper is F else upper, F.lit(f'"{name}":'), F.lit(f'"{name.upper()}":'))
    shape = F.col("k") % 10
    line = (
        F.when(shape == 0, F.substring(whole, F.lit(1), F.length(whole) - 5))
        .when(shape == 1, "")
        .when(shape == 2, "null")
        .when(shape == 3, F.regexp_replace(whole, '"is_deleted":(true|false)', '"is_deleted":"no"'))
        .when(shape == 4, F.replace(whole, F.lit('{"uuid"'), F.lit('{"short_url":"old","uuid"')))
        .when(shape == 5, F.concat(whole, F.lit(" tail")))
        .when(shape == 6, upper)
        .otherwise(whole)
    )
    return fx.requests(spark, sf_dir).withColumn("line", line)


_SQL_DECODED = f"""
  select req_id, ts, case when k % 10 = 2 then '' else 'x' || req_id end as uuid,
         case when k % 10 = 2 then '' else {sql_id("original_url")} end as short_id,
         case when k % 10 = 2 then '' else original_url end as original_url,
         case when k % 10 = 2 then '' else user_id end as user_id, k % 10 <> 2 and req_id % 2 = 0 as is_deleted
  from (select *, case k % 10 when 0 then 'cut off' when 1 then 'empty' when 3 then 'wrong type' when 5 then 'tail' end as fault
        from requests)
  where fault is null"""


@query("decode_link_json", sql(f"""
select r.req_id, d.req_id is not null as decoded, d.uuid, d.short_id, d.original_url, d.user_id, d.is_deleted
from requests r left join ({_SQL_DECODED}) d on d.req_id = r.req_id"""))
def decode_link_json(spark, sf_dir):
    link = decode_line(F.col("line"), schemas.LINK_LINE)
    rows = _link_lines(spark, sf_dir).select("req_id", link.alias("link"))
    return rows.select(
        "req_id",
        F.col("link").isNotNull().alias("decoded"),
        "link.uuid",
        F.col("link.short_url").alias("short_id"),
        "link.original_url",
        "link.user_id",
        "link.is_deleted",
    )


@query("read_links", sql(f"""
select arg_max(uuid, (ts, req_id)) as uuid, short_id, arg_max(original_url, (ts, req_id)) as original_url,
       arg_max(user_id, (ts, req_id)) as user_id, arg_max(is_deleted, (ts, req_id)) as is_deleted
from ({_SQL_DECODED}) group by short_id"""))
def read_links(spark, sf_dir):
    path = scratch_path(spark, "link_lines")
    _write_in_order(_link_lines(spark, sf_dir), path, "ts", "req_id")
    return readers.read_links(spark, path).select(*_LINE)


@query("read_requests", sql("""
select 'text' as kind, cast(null as int) as pos, cast(null as varchar) as correlation_id, original_url as url,
       cast(null as int) as status from signups
union all
select 'json', null, null,
       case k % 5 when 0 then original_url when 1 then '' when 4 then original_url end,
       cast(case when k % 5 in (2, 3) then 400 end as int) from requests where event_type = 'purchase'
union all
select 'batch', cast(p as int), 'c' || p, 'https://o.example/' || case p when 0 then o_custkey else o_orderkey end, null
from orders, (values (0), (1)) v(p)"""))
def read_requests(spark, sf_dir):
    """Gzip bodies of three routes: text, JSON object of several shapes, JSON array."""
    root = scratch_path(spark, "bodies")

    def bodies(rows, kind, body):
        rows.select(body).write.option("compression", "gzip").text(f"{root}/{kind}")
        return readers.read_bodies(spark, f"{root}/{kind}")

    signups = fx.shorten_requests(spark, sf_dir, "signup")
    texts = bodies(signups, "text", F.concat(F.lit("\t "), F.col("original_url"), F.lit(" 　")))
    whole = F.to_json(F.struct(F.col("original_url").alias("url")))
    shape = F.col("k") % 5
    json_body = (
        F.when(shape == 0, whole)
        .when(shape == 1, "null")
        .when(shape == 2, '{"url": 5}')
        .when(shape == 3, '{"url"')
        .otherwise(F.concat(whole, F.lit(" ignored")))
    )
    purchases = fx.requests(spark, sf_dir).where("event_type = 'purchase'")
    objects = readers.decode_url_bodies(bodies(purchases, "json", json_body))
    orders = fx.table(spark, sf_dir, "orders")
    items = F.array(
        *(
            F.struct(
                F.lit(f"c{i}").alias("correlation_id"),
                F.concat(F.lit("https://o.example/"), F.col(key).cast("string")).alias("original_url"),
            )
            for i, key in enumerate(("o_custkey", "o_orderkey"))
        )
    )
    batch = readers.decode_batch_bodies(bodies(orders, "batch", F.to_json(items)))
    none = F.lit(None)
    plain = texts.select(
        F.lit("text").alias("kind"),
        none.cast("int").alias("pos"),
        none.cast("string").alias("correlation_id"),
        responses.stored_url(F.lit("text"), F.col("body")).alias("url"),
        none.cast("int").alias("status"),
    )
    single = objects.select(
        F.lit("json").alias("kind"), none.cast("int").alias("pos"), none.cast("string").alias("correlation_id"), "url", "status"
    )
    many = batch.select(F.lit("batch").alias("kind"), "pos", "correlation_id", F.col("original_url").alias("url"), "status")
    return plain.unionByName(single).unionByName(many)


@query("read_audit", sql("select ts, action, user_id, url from audit"))
def read_audit(spark, sf_dir):
    path = scratch_path(spark, "audit")
    writers.append_audit(audit_events(spark, sf_dir), path, 0)
    return readers.read_audit(spark, path)


@query("read_request_log", sql("""
select '/' || short_id as uri, 'GET' as method, req_id / 1000.0::double as duration, status, cast(0 as bigint) as size from resolved"""))
def read_request_log(spark, sf_dir):
    path = scratch_path(spark, "request_log")
    click_outcomes(spark, sf_dir).select(
        F.concat(F.lit("/"), F.col("short_id")).alias("uri"),
        F.lit("GET").alias("method"),
        (F.col("req_id") / 1000.0).alias("duration"),
        "status",
        F.lit(0).cast("bigint").alias("size"),
    ).write.json(path)
    return readers.read_request_log(spark, path)


@query("append_links", sql("""
select short_id, original_url, user_id, is_deleted, cast(36 as int) as uuid_chars from append_links"""))
def append_links(spark, sf_dir):
    """Two loads, the first written twice."""
    path = scratch_path(spark, "appended")
    links = fx.append_links(spark, sf_dir)
    early, late = links.where("created_at < timestamp_ntz '2024-01-15'"), links.where("created_at >= timestamp_ntz '2024-01-15'")
    for load_id, part in ((1, early), (2, late), (1, early)):
        writers.append_links(part, path, load_id)
    return readers.read_links(spark, path).select(*_LINE[1:], F.length("uuid").alias("uuid_chars"))


@query("rewrite_links", sql(f"{_SQL_LINE} from deleted_links"))
def rewrite_links(spark, sf_dir):
    path = scratch_path(spark, "rewritten")
    writers.rewrite_links(current_links(spark, sf_dir), path)
    return readers.read_links(spark, path).select(*_LINE)


@query("append_audit", sql(f"select {SQL_EVENT} as line from audit"))
def append_audit(spark, sf_dir):
    path = scratch_path(spark, "audit")
    events = audit_events(spark, sf_dir)
    # the first load runs twice
    for load_id, action in ((0, "shorten"), (1, "follow"), (0, "shorten")):
        writers.append_audit(events.where(F.col("action") == action), path, load_id)
    return spark.read.text(path, recursiveFileLookup=True).withColumnRenamed("value", "line")


def _endpoint(payload: str) -> int:
    """An audit endpoint that is sometimes out of service."""
    return 503 if len(payload) % 7 == 0 else 202


@query("post_audit", sql(f"""
select payload, cast(case when length(payload) % 7 = 0 then 503 else 202 end as int) as http_status, length(payload) % 7 <> 0 as delivered
from (select {SQL_EVENT} as payload from audit)"""))
def post_audit(spark, sf_dir):
    return writers.post_audit(audit_events(spark, sf_dir), _endpoint).select("payload", "http_status", "delivered")


def _unsteady(first_try: bool):
    """An endpoint that, on the first try, refuses some events and breaks off on others."""

    def send(payload: str) -> int:
        if first_try and len(payload) % 5 == 0:
            raise ValueError("bad status line")
        return 503 if first_try and len(payload) % 7 == 0 else 202

    return send


@query("http_sink", sql(f"""
select payload, count(*) as delivered from (select {SQL_EVENT} as payload from audit) group by payload"""))
def http_sink(spark, sf_dir):
    """Events by HTTP from a stream; those that fail at first arrive with the next micro-batch or at the end."""
    out = scratch_path(spark, "posted")
    _in_slices(
        spark,
        _events_with_time(spark, sf_dir),
        "events",
        lambda stream, checkpoint: jobs.stream_audit_fanout(
            _as_events(stream), {"http": jobs.http_sink(out, _unsteady(True))}, checkpoint
        ),
    )
    writers.post_pending(spark, out, _unsteady(False), 1_000_000)
    sent = spark.read.parquet(out).where("delivered")
    return sent.groupBy("payload").agg(F.count(F.lit(1)).alias("delivered"))


@query("write_responses", sql(f"""
select req_id, status, case when kind = 'text' then 'text/plain' else 'application/json' end as content_type,
       case when kind = 'text' then '{fx.BASE}/' || short_id else '{{"result":"{fx.BASE}/' || short_id || '"}}' end as body,
       case when kind = 'json' and status = 201 and req_id % 3 <> 0 then 'gzip' else 'identity' end as encoding
from outcomes"""))
def write_responses(spark, sf_dir):
    path = scratch_path(spark, "responses")
    answers = responses.shorten_response(shorten_outcomes(spark, sf_dir), fx.BASE)
    writers.write_responses(answers.withColumn("accepts_gzip", F.col("req_id") % 3 != 0), path)
    return readers.read_responses(spark, path)


@query("upgrade_schema", sql("""
select link_id, cast(null as varchar) as uuid, short_id, original_url, user_id, false as is_deleted, created_at, updated_at from links"""))
def upgrade_schema(spark, sf_dir):
    return writers.upgrade_schema(fx.links(spark, sf_dir).drop("is_deleted"))


@query("downgrade_schema", sql("select link_id, short_id, original_url, user_id, created_at, updated_at from deleted_links"))
def downgrade_schema(spark, sf_dir):
    return writers.downgrade_schema(current_links(spark, sf_dir))


# --- streams -------------------------------------------------------------------------------------

# ends of the first two of three parts
_CUTS = ("2024-01-11", "2024-01-21")


def _in_slices(spark, rows, label, run):
    """Feed ``rows`` to a streaming job in three parts by time, restarting it from its checkpoint
    after each. ``run`` starts the job on a stream."""
    root = scratch_path(spark, label)
    early, middle = (F.col("ts") < F.lit(cut).cast("timestamp_ntz") for cut in _CUTS)
    for number, part in enumerate((early, middle & ~early, ~middle)):
        rows.where(part).write.parquet(f"{root}/in/slice={number}")
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        started = run(stream, f"{root}/checkpoint")
        for stream_query in started.values() if isinstance(started, dict) else [started]:
            stream_query.awaitTermination()


@query("stream_shorten", sql("select req_id, short_id, status from outcomes"))
def stream_shorten(spark, sf_dir):
    out = scratch_path(spark, "shortened")
    store = stores.ParquetStore(spark, f"{out}/store")
    _in_slices(
        spark,
        fx.shorten_requests(spark, sf_dir),
        "requests",
        lambda stream, checkpoint: jobs.stream_shorten(stream, store, f"{out}/outcomes", checkpoint),
    )
    return spark.read.parquet(f"{out}/outcomes").select("req_id", "short_id", "status")


def _flushed(spark, sf_dir):
    """``short_id, user_id`` of the batches that the delete buffers flush; busy users have several buffers."""
    session = buffer.state_session(fx.prepare(spark))
    root = scratch_path(spark, "buffer")
    rows = ids_to_delete(spark, sf_dir).select("req_id", "ts", "user_id", F.array("short_id").alias("ids"))
    rows.write.parquet(f"{root}/in")
    tasks = session.readStream.schema(rows.schema).parquet(f"{root}/in")
    lanes = buffer.lanes_of(session.read.parquet(f"{root}/in"), tasks_per_lane=3)
    flushes = buffer.stream_deletes(tasks, threshold=10, tick_ms=10, lanes=lanes)
    jobs.run_until_idle(
        flushes.writeStream.format("parquet")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/checkpoint")
        .outputMode("append")
    )
    return buffer.flushed_ids(spark.read.schema(buffer.FLUSHES).parquet(f"{root}/out"))


@query("stream_deletes", sql("select user_id, short_id, count(*) as n from deletes group by all"))
def stream_deletes(spark, sf_dir):
    """Every id leaves its user's buffer once, by a full batch or by the tick."""
    flushed = _flushed(spark, sf_dir)
    return flushed.groupBy("user_id", "short_id").agg(F.count(F.lit(1)).alias("n"))


def _store(spark, sf_dir, label):
    store = stores.ParquetStore(spark, scratch_path(spark, label))
    store.append(fx.links(spark, sf_dir), 0)
    return store


@query("stream_delete_apply", sql("select short_id, original_url, user_id, is_deleted from timed_links"))
def stream_delete_apply(spark, sf_dir):
    store = _store(spark, sf_dir, "store")
    _in_slices(
        spark,
        ids_to_delete(spark, sf_dir),
        "deletes",
        lambda stream, checkpoint: jobs.stream_delete_apply(stream, store, checkpoint),
    )
    return store.read().select("short_id", "original_url", "user_id", "is_deleted")


@query("stream_flush_apply", sql("select short_id, original_url, user_id, is_deleted from deleted_links"))
def stream_flush_apply(spark, sf_dir):
    """From delete tasks through the buffers to the store. A flushed batch has no time of its own: it acts when it is applied."""
    store = _store(spark, sf_dir, "store")
    flushed = _flushed(spark, sf_dir)
    jobs.stream_delete_apply(_as_stream(spark, flushed), store, scratch_path(spark, "applied")).awaitTermination()
    return store.read().select("short_id", "original_url", "user_id", "is_deleted")


def _as_stream(spark, rows):
    path = scratch_path(spark, "stream")
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


@query("stream_resolve", sql("select req_id, status, location from timed_resolved"))
def stream_resolve(spark, sf_dir):
    store = _store(spark, sf_dir, "store")
    store.tombstone(ids_to_delete(spark, sf_dir), 0)
    out = scratch_path(spark, "resolved")
    _in_slices(
        spark,
        fx.clicks(spark, sf_dir),
        "clicks",
        lambda stream, checkpoint: jobs.stream_resolve(stream, store, out, checkpoint),
    )
    return spark.read.parquet(out).select("req_id", "status", "location")


def _events_with_time(spark, sf_dir):
    return audit_events(spark, sf_dir).withColumnRenamed("ts", "seconds").withColumn(
        "ts", F.timestamp_seconds("seconds").cast("timestamp_ntz")
    )


def _as_events(stream):
    return stream.drop("ts").withColumnRenamed("seconds", "ts")


@query("stream_audit_fanout", sql("""
select s.sink, a.ts, a.action, a.user_id, a.url from audit a, (values ('first'), ('second')) s(sink)"""))
def stream_audit_fanout(spark, sf_dir):
    out = scratch_path(spark, "sinks")
    sinks = {name: jobs.file_sink(f"{out}/{name}") for name in ("first", "second")}
    _in_slices(
        spark,
        _events_with_time(spark, sf_dir),
        "events",
        lambda stream, checkpoint: jobs.stream_audit_fanout(_as_events(stream), sinks, checkpoint),
    )
    parts = [
        readers.read_audit(spark, f"{out}/{name}").select(F.lit(name).alias("sink"), "ts", "action", "user_id", "url")
        for name in sinks
    ]
    return parts[0].unionByName(parts[1])


@query("sink_callback", sql("select action, url, count(*) as n from audit group by all"))
def sink_callback(spark, sf_dir):
    """A sink of the user's own: counts per URL instead of the events."""
    out = scratch_path(spark, "callback")

    def count_urls(batch, batch_id):
        counts = batch.groupBy("action", "url").agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    _in_slices(
        spark,
        _events_with_time(spark, sf_dir),
        "events",
        lambda stream, checkpoint: jobs.stream_audit_fanout(_as_events(stream), {"counts": count_urls}, checkpoint),
    )
    return spark.read.parquet(out).groupBy("action", "url").agg(F.sum("n").alias("n"))


_SQL_TICKS = """
select time_bucket(interval 1 hour, ts) as window_start, time_bucket(interval 1 hour, ts) + interval 1 hour as window_end,
       user_id, count(*) as n_ids"""


@query("tumbling_deletes", sql(f"{_SQL_TICKS}, min(req_id) as first_req, max(req_id) as last_req from deletes group by all"))
def tumbling_deletes(spark, sf_dir):
    return flush.tumbling_deletes(ids_to_delete(spark, sf_dir), "1 hour")


@query("flush_window", sql("""
select req_id, short_id, time_bucket(interval 1 hour, ts) as window_start, time_bucket(interval 1 hour, ts) + interval 1 hour as window_end
from deletes"""))
def flush_window(spark, sf_dir):
    labelled = flush.flush_window(ids_to_delete(spark, sf_dir), "1 hour")
    return labelled.select("req_id", "short_id", "window_start", "window_end")


@query("link_store", sql("""
select 'parquet' as store, short_id, original_url, user_id, is_deleted from timed_links
union all select 'ndjson', short_id, original_url, user_id, is_deleted from deleted_links"""))
def link_store(spark, sf_dir):
    """The same work on two kinds of store: append, tombstone, compact, read. NDJSON lines have no times."""
    links, marks = fx.links(spark, sf_dir), ids_to_delete(spark, sf_dir)
    parts = []
    for name, kind in (("parquet", stores.ParquetStore), ("ndjson", stores.NdjsonStore)):
        path = scratch_path(spark, name)
        store = kind(spark, f"{path}/first")
        store.append(links, 0)
        store.tombstone(marks, 1)
        current = store.compact(f"{path}/second").read()
        parts.append(current.select(F.lit(name).alias("store"), "short_id", "original_url", "user_id", "is_deleted"))
    return parts[0].unionByName(parts[1])


def _bucketed(spark, links, label):
    store = versions.VersionedStore(spark, scratch_path(spark, label), buckets=8)
    store.append(links, 0)
    return store


@query("resolve_bucketed", sql("select req_id, short_id, status, location from timed_resolved"))
def resolve_bucketed(spark, sf_dir):
    store = _bucketed(spark, fx.links(spark, sf_dir), "bucketed")
    store.tombstone(ids_to_delete(spark, sf_dir), 0)
    clicks = fx.clicks(spark, sf_dir)
    return lookup.resolve(clicks, store.read_for("short_id", clicks)).select("req_id", "short_id", "status", "location")


@query("shorten_bucketed", ORACLES["shorten_conflicts"])
def shorten_bucketed(spark, sf_dir):
    store = _bucketed(spark, fx.links(spark, sf_dir, "signup"), "bucketed")
    coming = fx.shorten_requests(spark, sf_dir, "purchase")
    return shorten.shorten_unique(coming, store.links(), index=store.index()).select("req_id", "short_id", "status")


@query("store_versions", sql("""
, later as (select * from links where original_url not in (select original_url from store)),
full_table as (
  select short_id, original_url, user_id, false as is_deleted, created_at from store
  union all select short_id, original_url, user_id, false, created_at from later),
marked as (
  select l.* replace (exists (select 1 from deletes d where d.short_id = l.short_id and d.user_id = l.user_id and d.ts >= l.created_at) as is_deleted)
  from full_table l)
select 'first' as version, short_id, original_url, user_id, false as is_deleted from store
union all select 'both', short_id, original_url, user_id, false from full_table
union all select name, short_id, original_url, user_id, is_deleted from marked, (values ('deleted'), ('compacted'), ('read before')) as t(name)""").replace(
    "\n, later", ", later", 1))
def store_versions(spark, sf_dir):
    """A store is appended to, deleted from, compacted and cleaned while readers stay on their versions."""
    signups, everything = fx.links(spark, sf_dir, "signup"), fx.links(spark, sf_dir)
    store = _bucketed(spark, signups, "versions")
    first = store.at(store.latest())
    # a purchase that came before the signup of its URL does not change who had it first in this store
    store.append(everything.join(signups.select("original_url"), "original_url", "left_anti"), 1)
    both = store.at(store.latest())
    store.tombstone(ids_to_delete(spark, sf_dir), 2)
    deleted = store.at(store.latest())
    before = deleted.read()  # planned now, run after the compaction
    store.compact(before=3)
    store.append(everything.limit(0), 3)
    store.clean(keep=6)
    named = {"first": first.read(), "both": both.read(), "deleted": deleted.read(), "read before": before, "compacted": store.read()}
    parts = [frame.select(F.lit(name).alias("version"), "short_id", "original_url", "user_id", "is_deleted") for name, frame in named.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


class _Compacting(versions.VersionedStore):
    """Merges all earlier loads after each new one."""

    def append(self, links, load_id, **options):
        super().append(links, load_id, **options)
        return self.compact(before=load_id)


@query("stream_compaction", ORACLES["stream_shorten"])
def stream_compaction(spark, sf_dir):
    """Shorten a stream into a bucketed store that is compacted between its micro-batches."""
    out = scratch_path(spark, "compaction")
    store = _Compacting(spark, f"{out}/store", buckets=4)
    requests_ = fx.shorten_requests(spark, sf_dir)
    _in_slices(spark, requests_, "requests", lambda stream, checkpoint: jobs.stream_shorten(stream, store, f"{out}/outcomes", checkpoint))
    return spark.read.parquet(f"{out}/outcomes").select("req_id", "short_id", "status")


@query("shorten_job", sql(f"""
select req_id, cast(case when k = 99 then 400 else status end as int) as status,
       case when k <> 99 then case when kind = 'text' then '{fx.BASE}/' || short_id
                                   else '{{"result":"{fx.BASE}/' || short_id || '"}}' end end as body,
       req_id % 4 = 0 as reissued
from (select r.req_id, r.k, case when r.event_type = 'signup' then 'text' else 'json' end as kind,
             {sql_id("r.original_url")} as short_id,
             case when f.req_id = r.req_id then 201 else 409 end as status
      from requests r left join (
        select original_url, arg_min(req_id, (ts, req_id)) as req_id
        from requests where event_type in ('signup', 'purchase') and k <> 99 group by original_url) f
      on f.original_url = r.original_url
      where r.event_type in ('signup', 'purchase'))"""))
def shorten_job(spark, sf_dir):
    """Both shorten routes from raw requests to responses; some users come without a token."""
    url = F.when(F.col("k") == 99, F.lit(" ")).otherwise(F.col("original_url"))
    signed = sign_token(F.col("user_id"), fx.TOKEN_KEY)
    raw = fx.requests(spark, sf_dir).where(F.col("event_type").isin(*fx.SHORTEN_TYPES)).select(
        "req_id",
        "ts",
        F.when(F.col("req_id") % 4 != 0, signed).alias("token"),
        F.when(F.col("event_type") == "signup", "text").otherwise("json").alias("kind"),
        F.when(F.col("event_type") == "signup", F.concat(F.lit(" "), url)).otherwise(F.to_json(F.struct(url.alias("url")))).alias("body"),
    )
    store = stores.ParquetStore(spark, scratch_path(spark, "store"))
    answers = service.shorten_job(raw, store, 0, fx.BASE, fx.TOKEN_KEY).responses
    return answers.select("req_id", "status", "body", F.col("new_token").isNotNull().alias("reissued"))


@query("store_early_deletes", sql("select short_id, original_url, user_id, is_deleted from timed_links"))
def store_early_deletes(spark, sf_dir):
    """All deletes are written before all links; only those that came after their link act."""
    store = stores.ParquetStore(spark, scratch_path(spark, "store"))
    store.tombstone(ids_to_delete(spark, sf_dir), 0)
    store.append(fx.links(spark, sf_dir), 1)
    return store.read().select("short_id", "original_url", "user_id", "is_deleted")


# --- routes: from raw requests to answers. Every fourth user comes without a token ------------------


def _signed():
    return F.when(F.col("req_id") % 4 != 0, sign_token(F.col("user_id"), fx.TOKEN_KEY)).alias("token")


def _full_store(spark, sf_dir):
    store = _store(spark, sf_dir, "store")
    store.tombstone(ids_to_delete(spark, sf_dir), 0)
    return store


@query("shorten_job_append", sql(f"""
select req_id, cast(201 as int) as status, '{fx.BASE}/' || {sql_id("cast(req_id as varchar)")} as body, req_id % 4 = 0 as reissued
from signups"""))
def shorten_job_append(spark, sf_dir):
    raw = fx.shorten_requests(spark, sf_dir, "signup").select(
        "req_id", "ts", _signed(), F.lit("text").alias("kind"), F.col("original_url").alias("body")
    )
    store = stores.ParquetStore(spark, scratch_path(spark, "store"))
    answers = service.shorten_job(raw, store, 0, fx.BASE, fx.TOKEN_KEY, service.APPEND).responses
    return answers.select("req_id", "status", "body", F.col("new_token").isNotNull().alias("reissued"))


@query("follow_job", sql("select req_id, status, location, req_id % 4 = 0 as reissued from timed_resolved"))
def follow_job(spark, sf_dir):
    raw = fx.clicks(spark, sf_dir).select("req_id", "ts", _signed(), "short_id")
    answers = service.follow_job(raw, _full_store(spark, sf_dir), fx.TOKEN_KEY).responses
    return answers.select("req_id", "status", "location", F.col("new_token").isNotNull().alias("reissued"))


@query("list_job", sql(f"""
, asked as (select req_id, case when req_id % 4 <> 0 then user_id end as user_id from clicks),
lists as (select user_id, row_number() over (partition by user_id order by created_at desc, short_id) as pos, short_id, original_url
          from timed_links where not is_deleted and user_id in (select user_id from asked where user_id is not null))
select 'answer' as part, req_id, cast(case when l.user_id is null then 204 else 200 end as int) as status,
       cast(null as varchar) as user_id, cast(null as bigint) as pos, cast(null as varchar) as short_url, cast(null as varchar) as original_url
from asked a left join (select distinct user_id from lists) l on l.user_id = a.user_id
union all
select 'list', null, null, user_id, pos, '{fx.BASE}/' || short_id, original_url from lists"""))
def list_job(spark, sf_dir):
    raw = fx.clicks(spark, sf_dir).select("req_id", "ts", "user_id", _signed())
    found = service.list_job(raw.drop("user_id"), _full_store(spark, sf_dir), fx.BASE, fx.TOKEN_KEY)
    answers = found.responses.select(F.lit("answer").alias("part"), "req_id", "status")
    lists = found.lists.select(F.lit("list").alias("part"), "user_id", "pos", "short_url", "original_url")
    return answers.unionByName(lists, allowMissingColumns=True)


@query("delete_job", sql("""
select 'answer' as part, req_id, cast(202 as int) as status, cast(null as varchar) as short_id, cast(null as boolean) as is_deleted from deletes
union all
select 'link', null, null, l.short_id, exists (
  select 1 from deletes d where d.req_id % 4 <> 0 and d.short_id = l.short_id and d.user_id = l.user_id and d.ts >= l.created_at)
from links l"""))
def delete_job(spark, sf_dir):
    raw = fx.delete_requests(spark, sf_dir).select("req_id", "ts", _signed(), F.to_json("ids").alias("body"))
    store = _store(spark, sf_dir, "store")
    found = service.delete_job(raw, store, 0, fx.TOKEN_KEY).responses
    answers = found.select(F.lit("answer").alias("part"), "req_id", "status")
    links = store.read().select(F.lit("link").alias("part"), "short_id", "is_deleted")
    return answers.unionByName(links, allowMissingColumns=True)


@query("batch_job", sql(f"""
select i.batch_id as req_id, s.status, i.pos, i.correlation_id, '{fx.BASE}/' || {sql_id("(i.batch_id || ':' || i.new_pos)")} as short_url
from (select *, cast(row_number() over (partition by batch_id order by pos) - 1 as int) as new_pos from batch_items) i
join batch_status s on s.batch_id = i.batch_id where s.status = 201
union all select batch_id, status, null, null, null from batch_status where status <> 201""").replace("i.pos, i.correlation_id", "i.new_pos as pos, i.correlation_id"))
def batch_job(spark, sf_dir):
    """Batches of raw JSON bodies in append mode."""
    item = F.struct("pos", "correlation_id", "original_url")
    bodies = fx.batch_items(spark, sf_dir).groupBy("batch_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    body = F.to_json(F.transform("items", lambda x: F.struct(x["correlation_id"].alias("correlation_id"), x["original_url"].alias("original_url"))))
    raw = bodies.select(F.col("batch_id").alias("req_id"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("string").alias("token"), body.alias("body"))
    store = stores.ParquetStore(spark, scratch_path(spark, "store"))
    answers = service.batch_job(raw, store, 0, fx.BASE, fx.TOKEN_KEY, service.APPEND).responses
    return answers.select("req_id", "status", "pos", "correlation_id", "short_url")


@query("stream_tumbling_deletes", sql("""
select time_bucket(interval 1 hour, ts) as window_start, user_id, count(*) as n_ids from deletes
where time_bucket(interval 1 hour, ts) + interval 1 hour <= (select max(ts) from deletes) group by all"""))
def stream_tumbling_deletes(spark, sf_dir):
    """Ticks that are over: the watermark, without lateness here, has passed their end."""
    out = scratch_path(spark, "ticks")
    _in_slices(
        spark,
        ids_to_delete(spark, sf_dir),
        "ticking",
        lambda stream, checkpoint: jobs.stream_tumbling_deletes(
            stream.withColumn("ts", F.col("ts").cast("timestamp")), "1 hour", "0 seconds", out, checkpoint
        ),
    )
    return spark.read.parquet(out).select(F.col("start").cast("timestamp_ntz").alias("window_start"), "user_id", "n_ids")


def _in_text_slices(spark, rows, label, run):
    """``_in_slices`` for rows with a ``line``: gzip text, in three parts by time."""
    root = scratch_path(spark, label)
    early, middle = (F.col("ts") < F.lit(cut).cast("timestamp_ntz") for cut in _CUTS)
    for number, part in enumerate((early, middle & ~early, ~middle)):
        rows.where(part).select("line").write.option("compression", "gzip").text(f"{root}/in/slice={number}")
        run(intake.body_stream(spark, f"{root}/in"), f"{root}/checkpoint").awaitTermination()


# Every request as a JSON body: whole, cut off, a URL of a wrong type, null, blank, text behind the value, no JSON at all.
_SQL_BODY = """
select req_id, case k % 8 when 0 then '{"url"' when 1 then '{"url":5,"id":' || req_id || '}' when 2 then 'null'
         when 3 then '{"url":" "}' when 4 then 'not json ' || req_id end as refused,
       case k % 8 when 0 then 'syntax' when 1 then 'type' when 2 then 'blank' when 3 then 'blank' when 4 then 'syntax' end as reason,
       original_url || '?' || req_id as url
from requests"""


@query("stream_requests", sql(f"""
select case when reason is null then url end as url, case when reason is not null then refused end as body, reason, count(*) as n
from ({_SQL_BODY}) group by all"""))
def stream_requests(spark, sf_dir):
    """Bodies of the JSON route as a stream: accepted URLs, and rejected bodies with the reason."""
    url = F.concat("original_url", F.lit("?"), F.col("req_id").cast("string"))
    whole = F.to_json(F.struct(url.alias("url")))
    shape = F.col("k") % 8
    number = F.col("req_id").cast("string")
    line = (
        F.when(shape == 0, '{"url"')
        .when(shape == 1, F.concat(F.lit('{"url":5,"id":'), number, F.lit("}")))
        .when(shape == 2, "null")
        .when(shape == 3, '{"url":" "}')
        .when(shape == 4, F.concat(F.lit("not json "), number))
        .when(shape == 5, F.concat(whole, F.lit(" tail")))
        .otherwise(whole)
    )
    out = scratch_path(spark, "intake")
    rows = fx.requests(spark, sf_dir).withColumn("line", line)
    _in_text_slices(spark, rows, "raw", lambda stream, checkpoint: intake.stream_intake(stream, intake.OBJECT, out, checkpoint))
    nothing = F.lit(None).cast("string")
    taken = intake.accepted(spark, out, intake.OBJECT).select(F.col("value").alias("url"), nothing.alias("body"), nothing.alias("reason"))
    refused = intake.rejected(spark, out, intake.OBJECT).select(nothing.alias("url"), "body", "reason")
    return taken.unionByName(refused).groupBy("url", "body", "reason").agg(F.count(F.lit(1)).alias("n"))


_SQL_EVENTS = """
select req_id, cast(floor(epoch(ts)) as bigint) as ts, event_type as action, case when k % 9 <> 3 then user_id else '' end as user_id,
       original_url as url, case k % 9 when 0 then 'syntax' when 1 then 'type' when 2 then 'type' when 8 then 'syntax' end as reason
from requests"""


@query("stream_audit_source", sql(f"""
select case when reason is null then ts end as ts, case when reason is null then action end as action,
       case when reason is null then user_id end as user_id, case when reason is null then url end as url, reason, count(*) as n
from ({_SQL_EVENTS}) group by all"""))
def stream_audit_source(spark, sf_dir):
    """Audit lines as a stream. Cut off, with a time that is a fraction or text, without a user, with a second value behind the first."""
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    shape = F.col("k") % 9

    def event(ts):
        user = F.when(shape != 3, F.col("user_id"))
        return F.to_json(F.struct(ts.alias("ts"), F.col("event_type").alias("action"), user.alias("user_id"), F.col("original_url").alias("url")))

    whole = event(seconds)
    line = (
        F.when(shape == 0, F.substring(whole, F.lit(1), F.length(whole) - 3))
        .when(shape == 1, event(seconds + F.lit(0.5)))
        .when(shape == 2, event(seconds.cast("string")))
        .when(shape == 8, F.concat(whole, F.lit(" {}")))
        .otherwise(whole)
    )
    out = scratch_path(spark, "intake")
    rows = fx.requests(spark, sf_dir).withColumn("line", line)
    _in_text_slices(spark, rows, "raw", lambda stream, checkpoint: intake.stream_intake(stream, intake.AUDIT, out, checkpoint))
    taken = intake.accepted(spark, out, intake.AUDIT).drop("batch", "place").withColumn("reason", F.lit(None).cast("string"))
    refused = intake.rejected(spark, out, intake.AUDIT).select("reason")
    columns = ["ts", "action", "user_id", "url", "reason"]
    return taken.unionByName(refused, allowMissingColumns=True).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


@query("assign_ids_loads", """
select row_number() over (order by o_orderkey % 10, o_orderdate, o_orderkey) as link_id, cast(o_orderkey % 10 as bigint) as load, o_orderkey
from orders""")
def assign_ids_loads(spark, sf_dir):
    """All orders numbered in ten loads, one of which is offered twice."""
    book = ledger.IdLedger(spark, scratch_path(spark, "ledger"))
    orders = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    order = [F.col("o_orderdate"), F.col("o_orderkey")]
    for load in (0, 1, 2, 3, 4, 3, 5, 6, 7, 8, 9):
        book.append(orders.where(F.col("o_orderkey") % 10 == load), order, load)
    return book.read("o_orderkey long").select("link_id", "load", "o_orderkey")


@query("resolve_source", sql("""
select c.req_id, cast(case when l.short_id is null then 404 else 307 end as int) as status, l.original_url as location
from clicks c left join links l on l.short_id = c.short_id"""))
def resolve_source(spark, sf_dir):
    """All clicks against a folder of links that Spark reads through a registered backend."""
    path = scratch_path(spark, "folder")
    fx.links(spark, sf_dir).repartition(4, "short_id").sortWithinPartitions("short_id").write.parquet(path)
    backend.register(spark, "link_folder", backend.FolderBackend)
    found = backend.read_for(spark, "link_folder", "short_id", fx.clicks(spark, sf_dir), path=path)
    return lookup.resolve(fx.clicks(spark, sf_dir), found).select("req_id", "status", "location")


# A key of every shorten request: the requests of a URL fall on 40 keys.
_LOADS = 6


@query("check_unique_loads", sql(f"""
, per_load as (
  select original_url || '?' || req_id % 40 as key, cast(req_id % {_LOADS} as bigint) as load, count(*) as k from shorten_requests group by all),
upto as (select key, load, cast(sum(k) over (partition by key order by load) as bigint) as n from per_load)
select load, 'url unique' as constraint, key, n from upto where n > 1""").replace("\n, per_load", ", per_load", 1))
def check_unique_loads(spark, sf_dir):
    """The unique constraint checked load by load against the keys of the loads before; two loads are offered twice, all but one merged midway."""
    url = F.concat("original_url", F.lit("?"), (F.col("req_id") % 40).cast("string"))
    rows = fx.shorten_requests(spark, sf_dir).select((F.col("req_id") % _LOADS).alias("load"), url.alias("url"))
    path = scratch_path(spark, "keybook")
    book = keybook.KeyBook(spark, f"{path}/book", "url")
    for load in range(_LOADS):
        keybook.check_load(book, rows.where(F.col("load") == load), load, f"{path}/violations")
        if load in (1, 4):
            keybook.check_load(book, rows.where(F.col("load") == load), load, f"{path}/violations")
        if load == 3:
            book.merge()
    found = spark.read.schema("constraint string, key string, n long, load long").parquet(f"{path}/violations")
    return found.select("load", "constraint", "key", "n")


@query("user_lists_loads", sql("""
select 'list' as part, user_id, row_number() over (partition by user_id order by created_at desc, short_id) as n, short_id
from timed_links where not is_deleted
union all select 'count', user_id, count(*) filter (not is_deleted), null from timed_links group by user_id"""))
def user_lists_loads(spark, sf_dir):
    """Counts and lists by user, kept up to date over loads of links and deletes; many deletes come loads before or after their link."""
    path = scratch_path(spark, "view")
    store = versions.VersionedStore(spark, f"{path}/store", buckets=4)
    view = userlists.UserLists(spark, f"{path}/view")
    links, marks = fx.links(spark, sf_dir), ids_to_delete(spark, sf_dir)
    for load in range(4):
        coming = links.where(F.col("link_id") % 4 == load)
        deleted = marks.where(F.pmod(F.hash("short_id", "ts"), F.lit(4)) == load)
        store.append(coming, load)
        store.tombstone(deleted, load)
        view.update(store, coming, deleted, load)
    lists = view.lists().select(F.lit("list").alias("part"), "user_id", F.col("pos").alias("n"), "short_id")
    counts = view.counts().select(F.lit("count").alias("part"), "user_id", F.col("n_links").alias("n"), F.lit(None).cast("string").alias("short_id"))
    return lists.unionByName(counts)


@query("stream_shorten_state", ORACLES["stream_shorten"])
def stream_shorten_state(spark, sf_dir):
    """The link table as keyed state, restarted from its checkpoint twice."""
    session = buffer.state_session(fx.prepare(spark))
    out = scratch_path(spark, "registry")
    store = stores.ParquetStore(session, f"{out}/store")
    _in_slices(
        session,
        fx.shorten_requests(session, sf_dir),
        "requests",
        lambda stream, checkpoint: registry.stream_shorten_state(stream, store, f"{out}/outcomes", checkpoint),
    )
    return spark.read.parquet(f"{out}/outcomes").select("req_id", "short_id", "status")
