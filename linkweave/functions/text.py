"""Text, URL and time helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkweave.constants import COMPRESSIBLE, WHITE_SPACE

# user info, host (a name or a bracketed address) and port of a URL
_AUTHORITY = (
    r"(?:[A-Za-z0-9\-._~!$&'()*+,;=:%@]*@)?"
    r"(?:\[[^\]@]*\]|[^\x00-\x20\x7f\\^`{|}%@:\[\]/?#]*)(?::[0-9]*)?"
)
# a readable http URL: no control character, no broken escape in the fragment; group 1 is the path
# without one leading slash
_HTTP_URL = (
    r"(?s)^(?![^#]*#.*%(?![0-9A-Fa-f]{2}))https?://" + _AUTHORITY + r"(?:/([^?#\x00-\x1f\x7f]*))?"
    r"(?:\?[^#\x00-\x1f\x7f]*)?(?:#.*)?$"
)
# what makes a connection string unreadable: a control character before the fragment, a broken escape
_CONTROL = r"^[^#]*[\x00-\x1f\x7f]"
_BAD_ESCAPE = r"^[^?]*%(?![0-9A-Fa-f]{2})"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*://"


def unicode_trim(text: Column) -> Column:
    """Strip every Unicode white space from both ends, not only U+0020."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def is_blank(text: Column) -> Column:
    return F.coalesce(unicode_trim(text) == "", F.lit(True))


def join_path(base: str, short_id: Column) -> Column:
    """Public URL of an id."""
    return F.concat(F.lit(base.rstrip("/") + "/"), short_id)


def clean_delete_id(entry: Column) -> Column:
    """The id meant by one entry of a delete request; null when the entry is dropped.

    A full http or https URL stands for its decoded path without one leading slash. Its host is not
    compared with ours. Everything else is taken as it is.
    """
    path = F.regexp_extract(entry, _HTTP_URL, 1)
    # in a path a plus sign is a plus sign, not a space
    short = F.nullif(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), F.lit(""))
    is_url = entry.startswith("http://") | entry.startswith("https://")
    return F.when(is_url, short).otherwise(entry)


def mask_password(dsn: Column) -> Column:
    """Connection string that is safe to log.

    A user without a password gets the mask as well; what is not a URL at all is hidden whole.
    """
    authority = F.regexp_extract(dsn, _SCHEME + "([^/?#]*)", 1)
    unreadable = (
        F.rlike(dsn, F.lit(_CONTROL))
        | F.rlike(dsn, F.lit(_BAD_ESCAPE))
        | dsn.startswith(":")
        | ~F.rlike(authority, F.lit(f"^{_AUTHORITY}$"))
    )
    masked = F.regexp_replace(dsn, "(" + _SCHEME + ")([^:/?#@]*)(?::[^/?#]*)?@", "$1$2:***@")
    return F.when(unreadable, F.lit("***")).otherwise(masked)


def event_time(ts: Column) -> Column:
    """Unix seconds. Time comes with the data, so a re-run gives the same events."""
    return F.unix_seconds(ts.cast("timestamp"))


def deleted_flag(is_deleted: Column) -> Column:
    """A missing flag means: not deleted."""
    return F.coalesce(is_deleted, F.lit(False))


def compressible(content_type: Column) -> Column:
    first, second = COMPRESSIBLE
    return F.coalesce(content_type.contains(first) | content_type.contains(second), F.lit(False))
