"""The driver's tables seen as link data, once for Spark and once as SQL.

Every event is a request: signup and purchase shorten a URL (text and JSON route), view and click
follow one, error deletes one. Ten neighbouring users share a set of URLs, so the same URL is asked
for by several users, most deletes name a link of somebody else, and some ids were never given out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.constants import ID_CHARSET, ID_LENGTH
from linkweave.functions.ids import short_id
from linkweave.operators.shorten import first_by_original
from linkweave.session import prepare

BASE = "http://localhost:8080"
TOKEN_KEY = "linkweave: a key for made-up users"
SHORTEN_TYPES = ("signup", "purchase")
FOLLOW_TYPES = ("view", "click")
DELETE_TYPE = "error"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as requests: ``req_id, ts, event_type, user_id, k, original_url``."""
    k = F.regexp_extract("props", "[0-9]+", 0)
    group = F.expr("cast(user_id div 10 as string)")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("req_id"),
        "ts",
        "event_type",
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"),
        k.cast("int").alias("k"),
        F.concat(F.lit("https://shop.example/g"), group, F.lit("/"), k).alias("original_url"),
    )


def _of_type(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    return requests(spark, sf_dir).where(F.col("event_type").isin(*types))


def shorten_requests(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "text").otherwise("json")
    return _of_type(spark, sf_dir, *(types or SHORTEN_TYPES)).select(
        "req_id", "ts", "user_id", "original_url", kind.alias("kind")
    )


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_type(spark, sf_dir, *FOLLOW_TYPES).select(
        "req_id", "ts", "user_id", short_id(F.col("original_url")).alias("short_id")
    )


def delete_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One id per request, every other one given as a full URL."""
    link = short_id(F.col("original_url"))
    entry = F.when(F.col("req_id") % 2 == 0, F.concat(F.lit(BASE + "/"), link, F.lit("?x=1"))).otherwise(link)
    return _of_type(spark, sf_dir, DELETE_TYPE).select("req_id", "ts", "user_id", F.array(entry).alias("ids"))


def links_of(rows: DataFrame) -> DataFrame:
    """Links of shorten requests in ``unique`` mode; ``link_id`` is the request that made the link."""
    return first_by_original(rows).select(
        F.col("req_id").alias("link_id"),
        short_id(F.col("original_url")).alias("short_id"),
        "original_url",
        "user_id",
        F.lit(False).alias("is_deleted"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
    )


def links(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    return links_of(shorten_requests(spark, sf_dir, *types))


def append_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links in ``append`` mode: one per shorten request, its id made from the request id."""
    return shorten_requests(spark, sf_dir).select(
        F.col("req_id").alias("link_id"),
        short_id(F.col("req_id").cast("string")).alias("short_id"),
        "original_url",
        "user_id",
        F.lit(False).alias("is_deleted"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
    )


def batch_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as batch items, five to a batch; some URLs are blank."""
    url = F.concat_ws("/", F.lit("https://o.example"), F.col("o_custkey").cast("string"), F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select(
        F.expr("o_orderkey div 5").alias("batch_id"),
        F.expr("cast(o_orderkey % 5 as int)").alias("pos"),
        F.col("o_orderkey").cast("string").alias("correlation_id"),
        F.when(F.col("o_orderkey") % 97 == 0, F.lit(" ")).otherwise(url).alias("original_url"),
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a token: ``c_custkey, c_name, token``; some changed, without a dot or missing."""
    from linkweave.functions.tokens import sign_token

    good = sign_token(F.col("c_name"), TOKEN_KEY)
    key = F.col("c_custkey")
    token = (
        F.when(key % 7 == 0, F.lit(None).cast("string"))
        .when(key % 11 == 0, F.replace(good, F.lit("."), F.lit("")))
        .when(key % 5 == 0, F.concat(good, F.lit("0")))
        .otherwise(good)
    )
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", token.alias("token"))


def dsns(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    password = F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit(":pw"), key))
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.concat(
            F.lit("postgres://user"), key, password, F.lit("@db"), F.col("s_nationkey").cast("string"), F.lit(":5432/app")
        ).alias("dsn"),
    )


def delete_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as delete tasks of the user named by their priority, one id per line of the order."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_ids"))
    orders = table(spark, sf_dir, "orders")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey).select(
        F.col("o_orderkey").alias("req_id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("ts"),
        F.col("o_orderpriority").alias("user_id"),
        "n_ids",
    )


def shorten_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a shorten request for the page of its part."""
    ident = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return table(spark, sf_dir, "lineitem").select(
        F.shiftrightunsigned(ident, 1).alias("req_id"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
        F.concat(F.lit("u"), F.col("l_suppkey").cast("string")).alias("user_id"),
        F.concat(F.lit("https://shop.example/p/"), F.col("l_partkey").cast("string")).alias("original_url"),
    )


# --- the same in SQL ------------------------------------------------------------------------------


def sql_id(key: str, attempt: int = 0, length: int = ID_LENGTH) -> str:
    """Short id of a text expression."""
    number = f"('0x' || substr(sha256({key} || ':{attempt}'), 1, 15))::BIGINT"
    base = len(ID_CHARSET)
    digits = (f"substr('{ID_CHARSET}', cast(({number} // {base**i}) % {base} as int) + 1, 1)" for i in range(length))
    return "(" + " || ".join(digits) + ")"


def _first(source: str) -> str:
    return f"""
  select arg_min(req_id, (ts, req_id)) as link_id, {sql_id("original_url")} as short_id, original_url,
         arg_min(user_id, (ts, req_id)) as user_id, false as is_deleted, min(ts) as created_at, min(ts) as updated_at
  from {source} group by original_url"""


SQL_VIEWS = {
    "requests": """
  select event_id as req_id, ts, event_type, 'u' || user_id as user_id,
         cast(regexp_extract(props, '[0-9]+') as int) as k,
         'https://shop.example/g' || (user_id // 10) || '/' || regexp_extract(props, '[0-9]+') as original_url
  from events""",
    "shorten_requests": """
  select req_id, ts, user_id, original_url, case when event_type = 'signup' then 'text' else 'json' end as kind
  from requests where event_type in ('signup', 'purchase')""",
    "signups": "select * from shorten_requests where kind = 'text'",
    "purchases": "select * from shorten_requests where kind = 'json'",
    "clicks": f"""
  select req_id, ts, user_id, {sql_id("original_url")} as short_id
  from requests where event_type in ('view', 'click')""",
    "deletes": f"""
  select req_id, ts, user_id, {sql_id("original_url")} as short_id,
         case when req_id % 2 = 0 then '{BASE}/' || {sql_id("original_url")} || '?x=1'
              else {sql_id("original_url")} end as entry
  from requests where event_type = 'error'""",
    "links": _first("shorten_requests"),
    "store": _first("signups"),
    "append_links": f"""
  select req_id as link_id, {sql_id("cast(req_id as varchar)")} as short_id, original_url, user_id,
         false as is_deleted, ts as created_at, ts as updated_at
  from shorten_requests""",
    "deleted_links": """
  select l.* exclude (is_deleted), exists (
           select 1 from deletes d where d.short_id = l.short_id and d.user_id = l.user_id) as is_deleted
  from links l""",
    "timed_links": """
  select l.* exclude (is_deleted), exists (
           select 1 from deletes d where d.short_id = l.short_id and d.user_id = l.user_id and d.ts >= l.created_at) as is_deleted
  from links l""",
    "timed_resolved": """
  select c.req_id, c.ts, c.user_id, c.short_id,
         cast(case when l.short_id is null then 404 when l.is_deleted then 410 else 307 end as int) as status,
         case when not l.is_deleted then l.original_url end as location
  from clicks c left join timed_links l on l.short_id = c.short_id""",
    "resolved": """
  select c.req_id, c.ts, c.user_id, c.short_id,
         cast(case when l.short_id is null then 404 when l.is_deleted then 410 else 307 end as int) as status,
         case when not l.is_deleted then l.original_url end as location
  from clicks c left join deleted_links l on l.short_id = c.short_id""",
    "outcomes": """
  select r.req_id, r.ts, r.user_id, r.original_url, r.kind, l.short_id,
         cast(case when l.link_id = r.req_id then 201 else 409 end as int) as status
  from shorten_requests r join links l on l.original_url = r.original_url""",
    "audit": """
  select cast(floor(epoch(ts)) as bigint) as ts, 'shorten' as action, user_id, original_url as url
  from outcomes where status = 201
  union all
  select cast(floor(epoch(ts)) as bigint), 'follow', user_id, location from resolved where status = 307""",
    "batch_items": """
  select o_orderkey // 5 as batch_id, cast(o_orderkey % 5 as int) as pos,
         cast(o_orderkey as varchar) as correlation_id,
         case when o_orderkey % 97 = 0 then ' '
              else 'https://o.example/' || o_custkey || '/' || o_orderpriority end as original_url
  from orders""",
    "batch_status": """
  select batch_id, cast(case when bool_or(trim(original_url) = '' or trim(correlation_id) = '') then 400
                             else 201 end as int) as status
  from batch_items group by batch_id""",
}


def sql(body: str) -> str:
    """``body`` with the views it needs in front."""
    needed: list[str] = []

    def need(text: str) -> None:
        words = set(text.replace("(", " ").replace(")", " ").replace(",", " ").split())
        for name in SQL_VIEWS:
            if name in words and name not in needed:
                need(SQL_VIEWS[name])
                needed.append(name)

    need(body)
    if not needed:
        return body
    views = ",\n".join(f"{name} as ({SQL_VIEWS[name]})" for name in needed)
    return f"with {views}\n{body.strip()}"
