"""Explicit schemas; nothing is inferred at run time."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def _schema(columns: str) -> T.StructType:
    """Schema from ``name type, …``; unlike the DDL parser it needs no running session."""
    pairs = (column.strip().split(" ") for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


LINKS = _schema(
    "link_id long, uuid string, short_id string, original_url string, user_id string, "
    "is_deleted boolean, created_at timestamp_ntz, updated_at timestamp_ntz"
)
# One link per NDJSON line. The file calls the id short_url; it is renamed at this edge only.
LINK_LINE = _schema(
    "uuid string, short_url string, original_url string, user_id string, is_deleted boolean"
)
REQUESTS = _schema("req_id long, ts timestamp_ntz, user_id string, original_url string")
CLICKS = _schema("req_id long, ts timestamp_ntz, user_id string, short_id string")
DELETES = _schema("req_id long, ts timestamp_ntz, user_id string, ids array<string>")
BATCH_ITEMS = _schema("batch_id long, pos int, correlation_id string, original_url string")
URL_BODY = _schema("url string")
BATCH_ITEM = _schema("correlation_id string, original_url string")
AUDIT = _schema("ts long, action string, user_id string, url string")
REQUEST_LOG = _schema("uri string, method string, duration double, status int, size long")
