"""Queries for the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkweave.constants import WHITE_SPACE
from linkweave.functions import ids, text, tokens
from linkweave.functions.json import encode_event
from linkweave.operators.deletes import clean_deletes, tombstones
from linkweave.plans import fixtures as fx
from linkweave.plans.catalog import query
from linkweave.plans.fixtures import sql, sql_id

_KEY = fx.TOKEN_KEY
_INNER, _OUTER = ("".join(f"\\x{b:02X}" for b in pad) for pad in tokens.hmac_pads(_KEY))
_SPACES = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)


def sql_sign(user: str) -> str:
    inner = f"sha256('{_INNER}'::blob || encode({user}))"
    return f"sha256('{_OUTER}'::blob || unhex({inner}))"


_SQL_TOKENS = f"""
  select c_custkey, c_name, c_name || '.' || {sql_sign("c_name")} as good from customer"""
_SQL_TAMPERED = f"""
  select c_custkey, c_name, good, case when c_custkey % 7 = 0 then null when c_custkey % 11 = 0 then replace(good, '.', '')
         when c_custkey % 5 = 0 then good || '0' else good end as token from ({_SQL_TOKENS}) t"""
_SQL_VERIFIED = f"select *, coalesce(token = good, false) as valid from ({_SQL_TAMPERED}) u"


@query("short_id", f"""
select page_id, {sql_id("url")} as short_id,
       {sql_id("url").replace("|| ':0'", "|| ':1'")} as second_try
from pages""")
def short_id(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select(
        "page_id",
        ids.short_id(F.col("url")).alias("short_id"),
        ids.short_id(F.col("url"), 1).alias("second_try"),
    )


@query("link_uuid", "select page_id, true as version_4 from pages")
def link_uuid(spark, sf_dir):
    shape = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    rows = fx.table(spark, sf_dir, "pages").select("page_id", ids.link_uuid().alias("uuid"))
    return rows.select("page_id", F.rlike("uuid", F.lit(shape)).alias("version_4"))


@query("user_id", "select c_custkey, true as is_hex, cast(32 as int) as n_digits from customer")
def user_id(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "customer").select("c_custkey", ids.new_user_id().alias("user"))
    return rows.select(
        "c_custkey", F.rlike("user", F.lit("^[0-9a-f]+$")).alias("is_hex"), F.length("user").alias("n_digits")
    )


@query("sign_token", f"select c_custkey, good as token from ({_SQL_TOKENS}) t")
def sign_token(spark, sf_dir):
    return fx.table(spark, sf_dir, "customer").select(
        "c_custkey", tokens.sign_token(F.col("c_name"), _KEY).alias("token")
    )


@query("verify_token", f"""
select c_custkey, case when valid then c_name else '' end as user_id, valid from ({_SQL_VERIFIED}) v""")
def verify_token(spark, sf_dir):
    checked = tokens.verify_token(F.col("token"), _KEY)
    return fx.tokens(spark, sf_dir).select("c_custkey", checked.alias("t")).select("c_custkey", "t.user_id", "t.valid")


@query("authenticate", f"""
select c_custkey, case when valid then c_name end as known_user, true as valid, not valid as reissued
from ({_SQL_VERIFIED}) v""")
def authenticate(spark, sf_dir):
    rows = fx.tokens(spark, sf_dir).withColumn("fresh", ids.new_user_id())
    seen = rows.select("c_custkey", tokens.authenticate(F.col("token"), _KEY, F.col("fresh")).alias("a"))
    return seen.select(
        "c_custkey", F.when(~F.col("a.reissued"), F.col("a.user_id")).alias("known_user"), "a.valid", "a.reissued"
    )


@query("unicode_trim", f"""
select 'd' || doc_id as id, trim(text, {_SPACES}) as trimmed from documents
union all
select 'c' || conv_id || '/' || turn, trim(chr(12288) || text || chr(8195), {_SPACES}) from conversations""")
def unicode_trim(spark, sf_dir):
    documents = fx.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"),
        text.unicode_trim(F.col("text")).alias("trimmed"),
    )
    padded = F.concat(F.lit("　"), F.col("text"), F.lit(" "))
    turns = fx.table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("id"),
        text.unicode_trim(padded).alias("trimmed"),
    )
    return documents.unionByName(turns)


@query("join_path", sql(f"""
select req_id, '{fx.BASE}/' || {sql_id("original_url")} as short_url from requests"""))
def join_path(spark, sf_dir):
    link = ids.short_id(F.col("original_url"))
    return fx.requests(spark, sf_dir).select("req_id", text.join_path(fx.BASE + "/", link).alias("short_url"))


SQL_EVENT = """'{"ts":' || ts || ',"action":"' || action || '","user_id":"' || user_id || '","url":"' || url || '"}'"""


@query("encode_json", sql(f"select {SQL_EVENT} as line from audit"))
def encode_json(spark, sf_dir):
    from linkweave.plans.queries_table import audit_events

    line = encode_event(F.col("ts"), F.col("action"), F.col("user_id"), F.col("url"))
    return audit_events(spark, sf_dir).select(line.alias("line"))


@query("clean_delete_id", sql(f"""
select req_id, short_id, 'path' as kind from deletes
union all
select page_id, nullif(regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '^/', ''), ''), 'page' from pages"""))
def clean_delete_id(spark, sf_dir):
    entries = fx.delete_requests(spark, sf_dir).select("req_id", F.explode("ids").alias("entry"), F.lit("path").alias("kind"))
    pages = fx.table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("req_id"), F.col("url").alias("entry"), F.lit("page").alias("kind")
    )
    return entries.unionByName(pages).select("req_id", text.clean_delete_id(F.col("entry")).alias("short_id"), "kind")


@query("mask_password", """
select s_suppkey, 'postgres://user' || s_suppkey || ':***@db' || s_nationkey || ':5432/app' as dsn from supplier""")
def mask_password(spark, sf_dir):
    return fx.dsns(spark, sf_dir).select("s_suppkey", text.mask_password(F.col("dsn")).alias("dsn"))


@query("event_time", "select event_id, cast(floor(epoch(ts)) as bigint) as seconds from events")
def event_time(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").select("event_id", text.event_time(F.col("ts")).alias("seconds"))


@query("coalesce_deleted", sql("select short_id, is_deleted from deleted_links"))
def coalesce_deleted(spark, sf_dir):
    hit = tombstones(clean_deletes(fx.delete_requests(spark, sf_dir))).withColumn("flag", F.lit(True))
    marked = fx.links(spark, sf_dir).drop("is_deleted").join(hit, ["short_id", "user_id"], "left")
    return marked.select("short_id", text.deleted_flag(F.col("flag")).alias("is_deleted"))


_TYPES = {"signup": "text/plain", "purchase": "application/json; charset=utf-8", "view": "text/html", "click": None}


@query("content_type_compressible", """
select event_id, coalesce(event_type in ('purchase', 'view'), false) as compressible from events""")
def content_type_compressible(spark, sf_dir):
    kind = F
    for event_type, content_type in _TYPES.items():
        kind = kind.when(F.col("event_type") == event_type, F.lit(content_type).cast("string"))
    kind = kind.otherwise("application/octet-stream")
    return fx.table(spark, sf_dir, "events").select("event_id", text.compressible(kind).alias("compressible"))
