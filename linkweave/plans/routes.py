"""Which handler a request reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.constants import METHOD_NOT_ALLOWED, NOT_FOUND

# Method, path, route name.
ROUTES = (
    ("POST", "/", "shorten_text"),
    ("POST", "/api/shorten", "shorten_json"),
    ("POST", "/api/shorten/batch", "shorten_batch"),
    ("GET", "/api/user/urls", "list"),
    ("DELETE", "/api/user/urls", "delete"),
    ("GET", "/ping", "ping"),
)
# GET of a single path segment that is none of the above
FOLLOW = "follow"
_ONE_SEGMENT = r"^/[^/]+$"


def route(method: Column, path: Column) -> Column:
    """Route name; null when there is none."""
    chosen = F
    for verb, fixed, name in ROUTES:
        chosen = chosen.when((method == verb) & (path == fixed), name)
    return chosen.when((method == "GET") & F.rlike(path, F.lit(_ONE_SEGMENT)), FOLLOW)


def route_class(requests: DataFrame) -> DataFrame:
    """Add ``route`` and, for a request without one, ``status``: 405 when the path is known for
    another method, else 404."""
    known = F.col("path").isin([path for _, path, _ in ROUTES]) | F.rlike(F.col("path"), F.lit(_ONE_SEGMENT))
    name = route(F.col("method"), F.col("path"))
    status = F.when(F.col("route").isNull(), F.when(known, METHOD_NOT_ALLOWED).otherwise(NOT_FOUND))
    return requests.withColumn("route", name).withColumn("status", status.cast("int"))
