"""Queries for the table operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkweave.functions.ids import short_id
from linkweave.operators import batches, checks, deletes, flush, lookup, responses, shorten
from linkweave.plans import fixtures as fx
from linkweave.plans.catalog import query
from linkweave.plans.fixtures import sql, sql_id
from linkweave.plans.replay import replay as run_replay
from linkweave.plans.replay import replay_batches as run_replay_batches
from linkweave.plans.routes import route_class as classify
from linkweave.session import stage


def order_of(ts="ts", req_id="req_id"):
    return shorten.arrival(F.col(ts), F.col(req_id))


def ids_to_delete(spark, sf_dir):
    return deletes.clean_deletes(fx.delete_requests(spark, sf_dir))


def current_links(spark, sf_dir):
    return deletes.apply_deletes(fx.links(spark, sf_dir), ids_to_delete(spark, sf_dir))


def shorten_outcomes(spark, sf_dir):
    return shorten.shorten_unique(fx.shorten_requests(spark, sf_dir))


def click_outcomes(spark, sf_dir):
    return lookup.resolve(fx.clicks(spark, sf_dir), current_links(spark, sf_dir))


def audit_events(spark, sf_dir):
    return responses.audit_projection(shorten_outcomes(spark, sf_dir), click_outcomes(spark, sf_dir))


# --- joins ---------------------------------------------------------------------------------------


@query("resolve", sql("select req_id, status, location from resolved"))
def resolve(spark, sf_dir):
    return click_outcomes(spark, sf_dir).select("req_id", "status", "location")


@query("find_by_original", sql("""
select r.req_id, r.original_url, i.short_id from requests r left join (
  select original_url, arg_max(short_id, (created_at, link_id)) as short_id from append_links group by original_url) i
on i.original_url = r.original_url"""))
def find_by_original(spark, sf_dir):
    index = shorten.original_index(fx.append_links(spark, sf_dir), order_of("created_at", "link_id"))
    asked = fx.requests(spark, sf_dir).select("req_id", "original_url")
    return lookup.find_by_original(asked, index).select("req_id", "original_url", "short_id")


@query("shorten_conflicts", sql("""
select p.req_id, coalesce(s.short_id, l.short_id) as short_id,
       cast(case when s.short_id is null and p.req_id = f.req_id then 201 else 409 end as int) as status
from purchases p left join store s on s.original_url = p.original_url
join links l on l.original_url = p.original_url
join (select original_url, arg_min(req_id, (ts, req_id)) as req_id from purchases group by original_url) f
  on f.original_url = p.original_url"""))
def shorten_conflicts(spark, sf_dir):
    stored = fx.links(spark, sf_dir, "signup")
    coming = fx.shorten_requests(spark, sf_dir, "purchase")
    return shorten.shorten_unique(coming, stored).select("req_id", "short_id", "status")


@query("shorten_repeated_log", sql("""
select p.req_id, l.short_id, cast(case when p.req_id = l.link_id then 201 else 409 end as int) as status, l.link_id is not null as linked
from shorten_requests p join links l on l.original_url = p.original_url, (values (0), (1)) twice(copy)"""))
def shorten_repeated_log(spark, sf_dir):
    """Every request is there twice; its links are still one per URL, so each outcome meets one."""
    log = fx.shorten_requests(spark, sf_dir)
    outcomes = stage(shorten.shorten_unique(log.unionByName(log)), "outcomes")
    made = shorten.new_links(outcomes).select("short_id", F.lit(True).alias("linked"))
    return outcomes.join(made, "short_id", "left").select("req_id", "short_id", "status", F.coalesce("linked", F.lit(False)).alias("linked"))


@query("shorten_append", sql(f"""
select req_id, {sql_id("cast(req_id as varchar)")} as short_id, cast(201 as int) as status from shorten_requests"""))
def shorten_append(spark, sf_dir):
    return shorten.shorten_append(fx.shorten_requests(spark, sf_dir)).select("req_id", "short_id", "status")


def _sql_attempts(length: int) -> str:
    """The five attempts at ids of so few characters that many are taken: round by round, first by key wins."""
    parts = ["todo0 as (select original_url || '#' || req_id as key from requests union all select url || '#p' || page_id from pages)"]
    for k in range(5):
        earlier = " union all ".join(f"select id from won{i}" for i in range(k)) or "select null where false"
        parts.append(
            f"try{k} as (select key, {sql_id('key', k, length)} as id from todo{k}), won{k} as (select key, id from (select key, id, "
            f"row_number() over (partition by id order by key) as place from try{k}) where place = 1 and id not in ({earlier}))"
        )
        parts.append(f"todo{k + 1} as (select key from todo{k} where key not in (select key from won{k}))")
    union = " union all ".join(f"select key, id as short_id, {k} as attempt from won{k}" for k in range(5))
    return f", {', '.join(parts)} select key, short_id from ({union}) union all select key, null from todo5"


@query("assign_ids_collisions", sql("select 1 from requests").replace("select 1 from requests", _sql_attempts(2)))
def assign_ids_collisions(spark, sf_dir):
    """Ids of two characters, fewer than there are keys: all five attempts are made, and the rest get none."""
    events = fx.requests(spark, sf_dir).select(F.concat_ws("#", "original_url", F.col("req_id").cast("string")).alias("key"))
    pages = fx.table(spark, sf_dir, "pages").select(F.concat(F.col("url"), F.lit("#p"), F.col("page_id").cast("string")).alias("key"))
    return shorten.assign_ids(events.unionByName(pages), "key", "key", length=2).select("key", "short_id")


@query("user_urls", sql(f"""
select u.user_id, cast(case when l.short_id is null then 204 else 200 end as int) as status,
       case when l.short_id is not null then
         row_number() over (partition by u.user_id order by l.created_at desc, l.link_id desc) end as pos,
       '{fx.BASE}/' || l.short_id as short_url, l.original_url
from (select 'u' || c_custkey as user_id from customer) u
left join (select * from deleted_links where not is_deleted) l on l.user_id = u.user_id"""))
def user_urls(spark, sf_dir):
    users = fx.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("user_id")
    )
    return lookup.user_urls(users, current_links(spark, sf_dir), fx.BASE)


@query("id_collisions", sql("""
select p.req_id, l.short_id from purchases p join links l on l.original_url = p.original_url
where l.short_id in (select short_id from store)"""))
def id_collisions(spark, sf_dir):
    candidates = fx.shorten_requests(spark, sf_dir, "purchase").select(
        "req_id", short_id(F.col("original_url")).alias("short_id")
    )
    return shorten.id_collisions(candidates, fx.links(spark, sf_dir, "signup")).select("req_id", "short_id")


@query("delete_match", sql("select short_id, user_id, original_url from deleted_links where is_deleted"))
def delete_match(spark, sf_dir):
    hit = deletes.delete_match(fx.links(spark, sf_dir), ids_to_delete(spark, sf_dir))
    return hit.select("short_id", "user_id", "original_url")


# --- aggregations --------------------------------------------------------------------------------


@query("latest_by_id", sql(f"""
select {sql_id("original_url")} as short_id, arg_max(req_id, (ts, req_id)) as req_id,
       arg_max(user_id, (ts, req_id)) as user_id, original_url
from shorten_requests group by original_url"""))
def latest_by_id(spark, sf_dir):
    lines = fx.shorten_requests(spark, sf_dir).select(
        short_id(F.col("original_url")).alias("short_id"), "req_id", "ts", "user_id", "original_url"
    )
    return shorten.latest_by_id(lines, order_of()).select("short_id", "req_id", "user_id", "original_url")


@query("original_index", sql("""
select original_url, arg_max(short_id, (created_at, link_id)) as short_id from append_links group by original_url"""))
def original_index(spark, sf_dir):
    return shorten.original_index(fx.append_links(spark, sf_dir), order_of("created_at", "link_id"))


@query("first_by_original", sql("""
select original_url, arg_min(req_id, (ts, req_id)) as req_id, arg_min(user_id, (ts, req_id)) as user_id,
       count(*) as n_requests
from shorten_requests group by original_url"""))
def first_by_original(spark, sf_dir):
    first = shorten.first_by_original(fx.shorten_requests(spark, sf_dir))
    return first.select("original_url", "req_id", "user_id", "n_requests")


@query("group_deletes", sql("""
select user_id, row_number() over (partition by user_id order by ts, req_id) as seq, short_id from deletes"""))
def group_deletes(spark, sf_dir):
    return deletes.group_deletes(ids_to_delete(spark, sf_dir))


@query("batch_unique_ids", sql("""
select batch_id, substr('abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789',
         cast(('0x' || substr(sha256(batch_id || ':' || pos || ':0'), 1, 15))::BIGINT % 62 as int) + 1, 1) as short_id,
       count(*) as n
from batch_items group by all having count(*) > 1"""))
def batch_unique_ids(spark, sf_dir):
    return batches.batch_unique_ids(fx.batch_items(spark, sf_dir), length=1)


@query("user_has_links", sql("""
select u.user_id, count(l.short_id) as n_links, cast(case when count(l.short_id) = 0 then 204 else 200 end as int) as status
from (select 'u' || c_custkey as user_id from customer) u
left join (select * from deleted_links where not is_deleted) l on l.user_id = u.user_id group by u.user_id"""))
def user_has_links(spark, sf_dir):
    users = fx.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("user_id")
    )
    return lookup.user_has_links(users, current_links(spark, sf_dir))


# --- order ---------------------------------------------------------------------------------------


@query("assign_link_ids", """
select row_number() over (order by o_orderdate, o_orderkey) as link_id, o_orderkey from orders""")
def assign_link_ids(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return shorten.assign_link_ids(orders, [F.col("o_orderdate"), F.col("o_orderkey")]).select("link_id", "o_orderkey")


@query("delete_batches", """
with recursive tasks as (
  select o_orderkey as req_id, o_orderpriority as user_id, n_ids,
         row_number() over (partition by o_orderpriority order by o_orderdate, o_orderkey) as i
  from orders join (select l_orderkey, count(*) as n_ids from lineitem group by l_orderkey) on l_orderkey = o_orderkey),
steps as (
  select user_id, 0::bigint as i, 0::bigint as req_id, 0::bigint as n_ids, 0::bigint as level, 0::bigint as next_no, 0::bigint as batch_no
  from (select distinct user_id from tasks)
  union all
  select t.user_id, t.i, t.req_id, t.n_ids, case when s.level + t.n_ids >= 100 then 0 else s.level + t.n_ids end,
         case when s.level + t.n_ids >= 100 then s.next_no + 1 else s.next_no end, s.next_no
  from steps s join tasks t on t.user_id = s.user_id and t.i = s.i + 1)
select user_id, req_id, n_ids, batch_no from steps where i > 0""")
def delete_batches(spark, sf_dir):
    return flush.delete_batches(fx.delete_tasks(spark, sf_dir)).select("user_id", "req_id", "n_ids", "batch_no")


@query("even_delete_batches", sql("""
select user_id, seq, (seq - 1) // 10 as batch_no, short_id from (
  select user_id, row_number() over (partition by user_id order by ts, req_id) as seq, short_id from deletes)"""))
def even_delete_batches(spark, sf_dir):
    buffer = deletes.group_deletes(ids_to_delete(spark, sf_dir))
    return flush.even_batches(buffer, 10).select("user_id", "seq", "batch_no", "short_id")


@query("order_by_created", sql("""
select user_id, row_number() over (partition by user_id order by created_at desc, link_id desc) as pos, short_id
from deleted_links where not is_deleted"""))
def order_by_created(spark, sf_dir):
    return lookup.order_by_created(current_links(spark, sf_dir)).select("user_id", "pos", "short_id")


@query("point_limit", sql("""
select short_id, original_url, user_id from links where original_url = 'https://shop.example/g0/1' limit 1"""))
def point_limit(spark, sf_dir):
    found = lookup.point_lookup(fx.links(spark, sf_dir), "original_url", "https://shop.example/g0/1")
    return found.select("short_id", "original_url", "user_id")


@query("scan_links", sql("select link_id, short_id, original_url, user_id, is_deleted, created_at from deleted_links"))
def scan_links(spark, sf_dir):
    columns = ["link_id", "short_id", "original_url", "user_id", "is_deleted", "created_at"]
    return lookup.scan_links(current_links(spark, sf_dir)).select(*columns)


# --- whole-table changes -------------------------------------------------------------------------


@query("batch_save", sql(f"""
select i.batch_id, i.pos, i.original_url, {sql_id("(i.batch_id || ':' || i.pos)")} as short_id
from batch_items i join batch_status s on s.batch_id = i.batch_id where s.status = 201"""))
def batch_save(spark, sf_dir):
    return batches.batch_save(fx.batch_items(spark, sf_dir)).select("batch_id", "pos", "original_url", "short_id")


@query("batch_save_unique", sql(f"""
, listed as (
  select i.batch_id, list(original_url) as urls, row_number() over (order by i.batch_id) as i
  from batch_items i join batch_status s on s.batch_id = i.batch_id where s.status = 201 group by i.batch_id),
steps as (
  select 0::bigint as i, 0::bigint as batch_id, []::varchar[] as taken, false as ok
  union all
  select b.i, b.batch_id, case when free then list_concat(s.taken, b.urls) else s.taken end, free
  from steps s join listed b on b.i = s.i + 1,
       lateral (select len(list_distinct(b.urls)) = len(b.urls) and not list_has_any(s.taken, b.urls) as free))
select b.batch_id, b.pos, cast(case when v.status = 400 then 400 when s.ok then 201 else 500 end as int) as status,
       case when s.ok then {sql_id("original_url")} end as short_id
from batch_items b join batch_status v on v.batch_id = b.batch_id
left join (select batch_id, ok from steps where i > 0) s on s.batch_id = b.batch_id""").replace(
    "with ", "with recursive ", 1).replace("\n, listed", ", listed", 1))
def batch_save_unique(spark, sf_dir):
    return batches.batch_save_unique(fx.batch_items(spark, sf_dir)).select("batch_id", "pos", "status", "short_id")


@query("apply_deletes", sql("select short_id, user_id, original_url, is_deleted, updated_at from deleted_links"))
def apply_deletes(spark, sf_dir):
    return current_links(spark, sf_dir).select("short_id", "user_id", "original_url", "is_deleted", "updated_at")


# --- constraints ---------------------------------------------------------------------------------


def _lines(spark, sf_dir):
    return fx.shorten_requests(spark, sf_dir).select(
        "req_id", short_id(F.col("original_url")).alias("short_id"), "original_url", "user_id"
    )


@query("check_unique_short_id", sql(f"""
select 'short_id unique' as constraint, {sql_id("original_url")} as key, count(*) as n
from shorten_requests group by original_url having count(*) > 1"""))
def check_unique_short_id(spark, sf_dir):
    return checks.check_unique(_lines(spark, sf_dir), "short_id")


@query("check_unique_original_url", sql("""
select 'original_url unique' as constraint, original_url as key, count(*) as n
from shorten_requests group by original_url having count(*) > 1"""))
def check_unique_original_url(spark, sf_dir):
    return checks.check_unique(_lines(spark, sf_dir), "original_url")


@query("check_not_null", sql("""
select 'original_url not null' as constraint, cast(req_id as varchar) as key from resolved where location is null
union all
select 'user_id not null', cast(req_id as varchar) from resolved where status = 410"""))
def check_not_null(spark, sf_dir):
    owner = F.when(F.col("status") != 410, F.col("user_id"))
    rows = click_outcomes(spark, sf_dir).select("req_id", "short_id", F.col("location").alias("original_url"), owner.alias("user_id"))
    return checks.check_not_null(rows, "req_id")


@query("check_length", """
select 'user_id length' as constraint, cast(doc_id as varchar) as key from documents where length(text) > 255
union all
select 'short_id length', cast(doc_id as varchar) from documents where length(source || text) > 255""")
def check_length(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "documents").select(
        "doc_id", F.concat("source", "text").alias("short_id"), F.col("text").alias("user_id")
    )
    return checks.check_length(rows, "doc_id")


# --- requests and responses ----------------------------------------------------------------------


@query("user_urls_projection", sql(f"""
select '{fx.BASE}/' || short_id as short_url, original_url from links"""))
def user_urls_projection(spark, sf_dir):
    return responses.user_urls_projection(fx.links(spark, sf_dir), fx.BASE)


@query("batch_response", sql(f"""
select i.batch_id, i.pos, i.correlation_id, '{fx.BASE}/' || i.short_id as short_url,
       '{{"correlation_id":"' || i.correlation_id || '","short_url":"{fx.BASE}/' || i.short_id || '"}}' as item
from (select *, {sql_id("(batch_id || ':' || pos)")} as short_id from batch_items) i
join batch_status s on s.batch_id = i.batch_id where s.status = 201"""))
def batch_response(spark, sf_dir):
    return responses.batch_response(batches.batch_save(fx.batch_items(spark, sf_dir)), fx.BASE)


@query("shorten_response", sql(f"""
select req_id, status, case when kind = 'text' then 'text/plain' else 'application/json' end as content_type,
       case when kind = 'text' then '{fx.BASE}/' || short_id else '{{"result":"{fx.BASE}/' || short_id || '"}}' end as body
from outcomes"""))
def shorten_response(spark, sf_dir):
    return responses.shorten_response(shorten_outcomes(spark, sf_dir), fx.BASE)


@query("audit_projection", sql("select ts, action, user_id, url from audit"))
def audit_projection(spark, sf_dir):
    return audit_events(spark, sf_dir)


@query("by_user", sql("""
select short_id, original_url, user_id from deleted_links where user_id = 'u1' and not is_deleted"""))
def by_user(spark, sf_dir):
    return lookup.by_user(current_links(spark, sf_dir), "u1").select("short_id", "original_url", "user_id")


@query("valid_shorten", sql("""
select 'd' || doc_id as id, nullif(trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), '') as original_url,
       trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') <> '' as valid from documents
union all
select 'o' || correlation_id, case when trim(original_url) <> '' then original_url end, trim(original_url) <> '' from batch_items"""))
def valid_shorten(spark, sf_dir):
    documents = fx.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"),
        F.lit("text").alias("kind"),
        F.col("text").alias("url"),
    )
    items = fx.batch_items(spark, sf_dir).select(
        F.concat(F.lit("o"), F.col("correlation_id")).alias("id"),
        F.lit("json").alias("kind"),
        F.col("original_url").alias("url"),
    )
    return responses.valid_shorten(documents.unionByName(items)).select("id", "original_url", "valid")


@query("valid_batch", sql("select batch_id, status from batch_status"))
def valid_batch(spark, sf_dir):
    return batches.valid_batch(fx.batch_items(spark, sf_dir))


@query("accepted_items", sql("""
select i.batch_id, i.pos, i.original_url from batch_items i join batch_status s on s.batch_id = i.batch_id
where s.status = 201"""))
def accepted_items(spark, sf_dir):
    return batches.accepted_items(fx.batch_items(spark, sf_dir)).select("batch_id", "pos", "original_url")


@query("valid_delete", sql("""
select req_id, cast(case when k % 10 = 9 or k % 10 = 8 then 401 when k % 6 = 0 then 202 else 400 end as int) as status,
       cast(case when k % 10 < 8 and k % 6 = 0 then 2 end as int) as n_ids
from requests"""))
def valid_delete(spark, sf_dir):
    link = short_id(F.col("original_url"))
    shape = F.col("k") % 6
    body = (
        F.when(shape == 0, F.to_json(F.array(link, F.lit("other"))))
        .when(shape == 1, "[]")
        .when(shape == 2, "null")
        .when(shape == 3, F.concat(F.lit('["'), link))
        .when(shape == 4, '["a", 5]')
        .otherwise('{"ids": ["a"]}')
    )
    rows = fx.requests(spark, sf_dir).select(
        "req_id",
        body.alias("body"),
        (F.col("k") % 10 != 9).alias("valid"),
        F.when(F.col("k") % 10 != 8, F.col("user_id")).otherwise("").alias("user_id"),
    )
    return responses.valid_delete(rows).select("req_id", "status", F.nullif(F.size("ids"), F.lit(-1)).alias("n_ids"))


# --- request log ---------------------------------------------------------------------------------


def request_log(spark, sf_dir):
    """All events as one ordered log."""
    link = short_id(F.col("original_url"))
    kind = (
        F.when(F.col("event_type") == "signup", "text")
        .when(F.col("event_type") == "purchase", "json")
        .when(F.col("event_type") == "view", "follow")
        .when(F.col("event_type") == "click", "list")
        .otherwise("delete")
    )
    return fx.requests(spark, sf_dir).select(
        "req_id",
        "ts",
        "user_id",
        kind.alias("kind"),
        F.when(F.col("k") == 99, F.lit(" ")).otherwise(F.col("original_url")).alias("url"),
        link.alias("short_id"),
        F.when(F.col("k") % 50 == 49, F.array().cast("array<string>")).otherwise(F.array(link)).alias("ids"),
    )


@query("replay", sql(f"""
, lives as (
  select l.short_id, l.user_id, (l.created_at, l.link_id) as born,
         min((d.ts, d.req_id)) filter (where d.req_id is not null) as gone
  from (select arg_min(req_id, (ts, req_id)) as link_id, min(ts) as created_at, {sql_id("original_url")} as short_id,
               arg_min(user_id, (ts, req_id)) as user_id, original_url
        from requests where event_type in ('signup', 'purchase') and k <> 99 group by original_url) l
  left join (select * from requests where event_type = 'error' and k % 50 <> 49) d
    on d.original_url = l.original_url and d.user_id = l.user_id and (d.ts, d.req_id) > (l.created_at, l.link_id)
  group by all),
log as (select *, {sql_id("original_url")} as short_id, (ts, req_id) as at from requests),
live as (
  select g.req_id, count(v.short_id) as n from log g
  left join lives v on v.user_id = g.user_id and v.born < g.at and (v.gone is null or v.gone > g.at)
  where g.event_type = 'click' group by g.req_id)
select g.req_id,
       case when event_type in ('signup', 'purchase') then 'POST' when event_type = 'error' then 'DELETE' else 'GET' end as method,
       case event_type when 'signup' then '/' when 'purchase' then '/api/shorten' when 'view' then '/' || g.short_id
            else '/api/user/urls' end as uri,
       cast(case when event_type in ('signup', 'purchase') then
                   case when k = 99 then 400 when v.born = g.at then 201 else 409 end
                 when event_type = 'view' then
                   case when v.born is null or v.born > g.at then 404 when v.gone < g.at then 410 else 307 end
                 when event_type = 'click' then case when n > 0 then 200 else 204 end
                 else case when k % 50 = 49 then 400 else 202 end end as int) as status
from log g left join lives v on v.short_id = g.short_id left join live on live.req_id = g.req_id""").replace(
    "\n, lives", ", lives", 1))
def replay(spark, sf_dir):
    return run_replay(request_log(spark, sf_dir))


def mixed_log(spark, sf_dir):
    """All events, and all orders as batches of five: each batch comes right after the event that has its number, by the same user,
    and asks for URLs that the user's neighbours ask for as well, and for some of its own."""
    events = request_log(spark, sf_dir)
    group = F.expr("cast(substr(user_id, 2) as bigint) div 10")
    key = F.col("o_orderkey")
    shop = F.concat(F.lit("https://shop.example/g"), F.col("grp").cast("string"), F.lit("/"), (key * 7 % 100).cast("string"))
    own = F.concat(F.lit("https://o.example/"), F.col("o_custkey").cast("string"))
    orders = fx.table(spark, sf_dir, "orders").withColumn("n", F.expr("o_orderkey div 5"))
    rows = orders.join(events.select(F.col("req_id").alias("n"), "ts", "user_id", group.alias("grp")), "n").select(
        (F.col("n") + 1_000_000_000).alias("req_id"), "ts", "user_id", F.expr("o_orderkey % 5").alias("pos"),
        F.struct(
            F.when(key % 211 == 0, " ").otherwise(key.cast("string")).alias("correlation_id"),
            F.when(key % 97 == 0, " ").when(key % 4 < 2, own).otherwise(shop).alias("original_url"),
        ).alias("item"),
    )
    items = F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"])
    batches_ = rows.groupBy("req_id", "ts", "user_id").agg(items.alias("items")).withColumn("kind", F.lit("batch"))
    return events.unionByName(batches_, allowMissingColumns=True)


@query("replay_batches", sql(f"""
, posts as (
  select e.ts, 1000000000 + o_orderkey // 5 as req_id, e.user_id, case when o_orderkey % 211 = 0 then ' ' else 'c' end as correlation_id,
         case when o_orderkey % 97 = 0 then ' ' when o_orderkey % 4 < 2 then 'https://o.example/' || o_custkey
              else 'https://shop.example/g' || (cast(substr(e.user_id, 2) as bigint) // 10) || '/' || (o_orderkey * 7 % 100) end as original_url
  from orders join requests e on e.req_id = o_orderkey // 5),
claims as (select original_url, min((ts, req_id)) as claimed from requests where event_type in ('signup', 'purchase') and k <> 99 group by original_url),
posted as (
  select p.ts, p.req_id, p.user_id, bool_or(p.original_url = ' ' or correlation_id = ' ') as bad, list(p.original_url) as urls,
         coalesce(bool_or(c.claimed < (p.ts, p.req_id)), false) as late
  from posts p left join claims c using (original_url) group by all),
listed as (select *, row_number() over (order by ts, req_id) as i from posted where not bad),
steps as (
  select 0::bigint as i, 0::bigint as req_id, []::varchar[] as taken, false as ok
  union all
  select b.i, b.req_id, case when free then list_concat(s.taken, b.urls) else s.taken end, free
  from steps s join listed b on b.i = s.i + 1,
       lateral (select not late and len(list_distinct(b.urls)) = len(b.urls) and not list_has_any(s.taken, b.urls) as free)),
asked as (
  select ts, req_id, user_id, original_url from requests where event_type in ('signup', 'purchase') and k <> 99
  union all
  select ts, req_id, user_id, unnest(urls) from posted where req_id in (select req_id from steps where ok)),
lives as (
  select {sql_id("l.original_url")} as short_id, l.user_id, l.born, min((d.ts, d.req_id)) filter (where d.req_id is not null) as gone
  from (select original_url, min((ts, req_id)) as born, arg_min(user_id, (ts, req_id)) as user_id from asked group by original_url) l
  left join (select * from requests where event_type = 'error' and k % 50 <> 49) d
    on d.original_url = l.original_url and d.user_id = l.user_id and (d.ts, d.req_id) > l.born
  group by all),
log as (select *, {sql_id("original_url")} as short_id, (ts, req_id) as at from requests),
live as (
  select g.req_id, count(v.short_id) as n from log g
  left join lives v on v.user_id = g.user_id and v.born < g.at and (v.gone is null or v.gone > g.at)
  where g.event_type = 'click' group by g.req_id)
select g.req_id,
       case when event_type in ('signup', 'purchase') then 'POST' when event_type = 'error' then 'DELETE' else 'GET' end as method,
       case event_type when 'signup' then '/' when 'purchase' then '/api/shorten' when 'view' then '/' || g.short_id
            else '/api/user/urls' end as uri,
       cast(case when event_type in ('signup', 'purchase') then
                   case when k = 99 then 400 when v.born = g.at then 201 else 409 end
                 when event_type = 'view' then
                   case when v.born is null or v.born > g.at then 404 when v.gone < g.at then 410 else 307 end
                 when event_type = 'click' then case when n > 0 then 200 else 204 end
                 else case when k % 50 = 49 then 400 else 202 end end as int) as status
from log g left join lives v on v.short_id = g.short_id left join live on live.req_id = g.req_id
union all
select req_id, 'POST', '/api/shorten/batch',
       cast(case when bad then 400 when req_id in (select req_id from steps where ok) then 201 else 500 end as int) from posted""").replace(
    "with ", "with recursive ", 1).replace("\n, posts", ", posts", 1))
def replay_batches(spark, sf_dir):
    return run_replay_batches(mixed_log(spark, sf_dir))


_METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")
_PATHS = ("/", "/api/shorten", "/api/shorten/batch", "/api/user/urls", "/ping", "/some/path", "/api", "/a/", "/api/user/urls/x")


@query("route_class", sql(f"""
, pairs as (
  select req_id, ['GET', 'POST', 'PUT', 'DELETE', 'PATCH', 'HEAD', 'OPTIONS'][k % 7 + 1] as method,
         case when k // 7 % 10 = 9 then '/' || {sql_id("original_url")} else
           ['/', '/api/shorten', '/api/shorten/batch', '/api/user/urls', '/ping', '/some/path', '/api', '/a/', '/api/user/urls/x'][k // 7 % 10 + 1]
         end as path
  from requests),
routes as (
  select *, path in ('/', '/api/shorten', '/api/shorten/batch', '/api/user/urls') or (path not like '%/%/%' and path <> '/') as known,
         case when method = 'POST' and path = '/' then 'shorten_text' when method = 'POST' and path = '/api/shorten' then 'shorten_json'
              when method = 'POST' and path = '/api/shorten/batch' then 'shorten_batch' when method = 'GET' and path = '/api/user/urls' then 'list'
              when method = 'DELETE' and path = '/api/user/urls' then 'delete' when method = 'GET' and path = '/ping' then 'ping'
              when method = 'GET' and path not like '%/%/%' and path <> '/' then 'follow' end as route
  from pairs)
select req_id, method, path, route, cast(case when route is null then case when known then 405 else 404 end end as int) as status
from routes""").replace("\n, pairs", ", pairs", 1))
def route_class(spark, sf_dir):
    paths = F.array(*(F.lit(p) for p in _PATHS), F.concat(F.lit("/"), short_id(F.col("original_url"))))
    methods = F.array(*(F.lit(m) for m in _METHODS))
    rows = fx.requests(spark, sf_dir).select(
        "req_id",
        F.get(methods, F.col("k") % 7).alias("method"),
        F.get(paths, F.expr("cast(k div 7 as int)") % 10).alias("path"),
    )
    return classify(rows)
