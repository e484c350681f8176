"""Signed user tokens: ``user id . hex(HMAC-SHA256(key, user id))``."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def hmac_pads(key: str) -> tuple[bytes, bytes]:
    """Inner and outer key block of HMAC (RFC 2104) for SHA-256."""
    raw = key.encode()
    if len(raw) > _BLOCK:
        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)


def signature(user_id: Column, key: str) -> Column:
    inner, outer = hmac_pads(key)
    inner_hash = F.sha2(F.concat(F.lit(inner), F.encode(user_id, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(inner_hash)), 256)


def sign_token(user_id: Column, key: str) -> Column:
    return F.concat(user_id, F.lit("."), signature(user_id, key))


def verify_token(token: Column, key: str) -> Column:
    """``struct(user_id, valid)``; the user is empty when the token is not valid.

    The user id ends at the first dot and neither part may be empty.
    """
    dot = F.instr(token, ".")
    user = F.substring(token, F.lit(1), dot - 1)
    given = F.substring(token, dot + 1, F.length(token))
    valid = F.coalesce((dot > 1) & (dot < F.length(token)) & (given == signature(user, key)), F.lit(False))
    return F.struct(F.when(valid, user).otherwise("").alias("user_id"), valid.alias("valid"))


def derived_user_id(seed: Column, key: str) -> Column:
    """32 hex digits that follow from ``seed`` and cannot be guessed without the key.

    For new users in jobs that may be run again; ``seed`` must be unique, such as a request id.
    """
    return F.substring(signature(F.concat(F.lit("new user "), seed.cast("string")), key), 1, 32)


def authenticate(token: Column, key: str, fresh_user: Column) -> Column:
    """``struct(user_id, token, valid, reissued)``.

    A missing or invalid token is replaced by one for ``fresh_user`` and counts as valid from then on.
    ``fresh_user`` is used several times: give a ``derived_user_id``, or a column that holds random
    ids already, not the random expression itself.
    """
    checked = verify_token(token, key)
    good = checked["valid"]
    user = F.when(good, checked["user_id"]).otherwise(fresh_user)
    return F.struct(
        user.alias("user_id"),
        F.when(good, token).otherwise(sign_token(fresh_user, key)).alias("token"),
        F.lit(True).alias("valid"),
        (~good).alias("reissued"),
    )
