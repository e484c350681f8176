"""Strict JSON decoding and encoding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated one time however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _typed(value: Column) -> Column:
    """A variant with the name of its type; ``OBJECT`` and ``ARRAY`` are followed by details."""
    return F.struct(F.schema_of_variant(value).alias("kind"), value.alias("value"))


# The variant's name of each type a field may have, and its value when it is absent.
_ZEROS = {T.BooleanType: ("BOOLEAN", False), T.StringType: ("STRING", ""), T.LongType: ("BIGINT", 0)}


def _field(entries: Column, name: str, data_type: T.DataType) -> Column:
    """``struct(value, fits)`` of one object field; an absent or null field has the zero value.

    The exact key is preferred, then a key that differs in case only.
    """
    loose = F.map_values(F.map_filter(entries, lambda key, _: F.lower(key) == name))
    raw = F.coalesce(F.try_element_at(entries, F.lit(name)), F.try_element_at(loose, F.lit(-1)))
    want, zero = _ZEROS[type(data_type)]

    def decode(field: Column) -> Column:
        absent = field["value"].isNull() | (field["kind"] == "VOID")
        value = F.try_variant_get(field["value"], "$", data_type.simpleString())
        return F.struct(
            F.when(absent, F.lit(zero).cast(data_type)).otherwise(value).alias("value"), (absent | (field["kind"] == want)).alias("fits")
        )

    return _once(_typed(raw), decode)


def _decode_object(value: Column, schema: T.StructType) -> Column:
    """Struct of ``schema`` from a variant, null when the value does not fit. ``null`` fits: it
    leaves every field at its zero value."""

    def build(fields: Column) -> Column:
        fits = F.lit(True)
        for field in schema:
            fits = fits & fields[field.name]["fits"]
        return F.when(fits, F.struct(*(fields[field.name]["value"].alias(field.name) for field in schema)))

    def decode(typed: Column) -> Column:
        readable = typed["kind"].startswith("OBJECT") | (typed["kind"] == "VOID")
        entries = F.coalesce(
            F.try_variant_get(typed["value"], "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")
        )
        fields = _once(
            entries, lambda e: F.struct(*(_field(e, field.name, field.dataType).alias(field.name) for field in schema))
        )
        return F.when(readable, _once(fields, build))

    return _once(_typed(value), decode)


def decode_line(line: Column, schema: T.StructType) -> Column:
    """One NDJSON line that must hold exactly one value; null when it does not decode.

    The brackets make trailing text a syntax error instead of ignoring it.
    """
    text = F.concat(F.lit("["), line, F.lit("]"))
    values = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
    return _once(values, lambda v: F.when(F.size(v) == 1, _decode_object(F.get(v, F.lit(0)), schema)))


def decode_body(body: Column, schema: T.StructType) -> Column:
    """Request body holding an object; text after the first value is ignored."""
    return _decode_object(F.try_parse_json(body), schema)


def _decode_string(value: Column) -> Column:
    return _once(
        _typed(value),
        lambda typed: F.when(typed["kind"] == "VOID", "").when(
            typed["kind"] == "STRING", F.try_variant_get(typed["value"], "$", "string")
        ),
    )


def decode_array_body(body: Column, element: T.DataType) -> Column:
    """Request body holding an array of objects or strings; null when any element does not fit.

    A bare ``null`` gives an empty array.
    """

    def decode(typed: Column) -> Column:
        items = F.try_variant_get(typed["value"], "$", "array<variant>")
        if isinstance(element, T.StructType):
            decoded = F.transform(items, lambda item: _decode_object(item, element))
        else:
            decoded = F.transform(items, _decode_string)
        whole = _once(decoded, lambda all_: F.when(~F.exists(all_, lambda item: item.isNull()), all_))
        empty = F.array().cast(T.ArrayType(element))
        return F.when(typed["kind"] == "VOID", empty).when(typed["kind"].startswith("ARRAY"), whole)

    return _once(_typed(F.try_parse_json(body)), decode)


def encode_event(ts: Column, action: Column, user_id: Column, url: Column) -> Column:
    """JSON text of an audit event; an empty user is left out."""
    return F.to_json(
        F.struct(
            ts.alias("ts"),
            action.alias("action"),
            F.nullif(user_id, F.lit("")).alias("user_id"),
            url.alias("url"),
        )
    )
