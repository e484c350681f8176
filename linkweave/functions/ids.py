"""Short ids, link uuids and user ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkweave.constants import ID_CHARSET, ID_LENGTH


def short_id(
    key: Column, attempt: Column | int = 0, charset: str = ID_CHARSET, length: int = ID_LENGTH
) -> Column:
    """Id of ``key``: the lowest ``length`` digits of a 60-bit hash, lowest first.

    A pure function of key and attempt, so a retried task gives the same id; a random id would not.
    """
    attempt = F.lit(attempt) if isinstance(attempt, int) else attempt
    digest = F.sha2(F.concat(key, F.lit(":"), attempt.cast("string")), 256)
    number = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    base = len(charset)
    letters = F.split(F.lit(",".join(charset)), ",")
    digits = []
    for i in range(length):
        rest = number if i == 0 else F.call_function("div", number, F.lit(base**i).cast("bigint"))
        digits.append(F.get(letters, (rest % F.lit(base)).cast("int")))
    return F.concat(*digits)


def random_short_id(length: int = ID_LENGTH) -> Column:
    """Random id. Write the rows out before using it twice: a recomputation gives another value."""
    return F.randstr(F.lit(length))


def link_uuid() -> Column:
    """Version 4 UUID; same caution as ``random_short_id``."""
    return F.uuid()


def new_user_id() -> Column:
    """32 hex digits. Of its 128 bits 122 are random, as it comes from a UUID."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))
