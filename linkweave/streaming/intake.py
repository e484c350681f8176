"""Streams of raw request bodies and audit lines, decoded strictly; what does not decode is kept with reason and place.

A micro-batch makes one table, accepted and rejected rows side by side in a folder each. One write job commits both, and
micro-batch N writes folder N only: a batch that runs again replaces both outputs, so no line is in both, in neither or there twice.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from linkweave import schemas
from linkweave.functions.json import decode_array_body, decode_body, decode_line
from linkweave.functions.text import is_blank, unicode_trim
from linkweave.streaming.jobs import AVAILABLE_NOW, Sink, start_batches

TEXT, OBJECT, BATCH, DELETE, AUDIT = "text", "json", "batch", "delete", "audit"
SYNTAX, TYPE, BLANK, EMPTY = "syntax", "type", "blank", "empty"

# Where a line was found. Files that Spark cannot split, as gzip files, are one block.
PLACE = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("block_start", T.LongType()), T.StructField("block_length", T.LongType()),
])

_VALUES = {
    TEXT: T.StringType(),
    OBJECT: T.StringType(),
    BATCH: T.ArrayType(schemas.BATCH_ITEM),
    DELETE: T.ArrayType(T.StringType()),
    AUDIT: schemas.AUDIT,
}


def body_stream(spark: SparkSession, path: str, whole: bool = False, **options) -> DataFrame:
    """``body, place`` of the files that come to a folder, one row per line or, with ``whole``, per file. Gzip files are unpacked.

    ``options`` go to the source, such as ``maxFilesPerTrigger``.
    """
    source = spark.readStream.option("recursiveFileLookup", "true").options(**options)
    return _placed(source.text(path, wholetext=whole))


def bodies_of(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """The same rows from a folder as it is now, as a plain table."""
    return _placed(spark.read.option("recursiveFileLookup", "true").text(path, wholetext=whole))


def _placed(lines: DataFrame) -> DataFrame:
    at = ("file_path", "file", "string"), ("file_block_start", "block_start", "long"), ("file_block_length", "block_length", "long")
    place = F.struct(*(F.col(f"_metadata.{name}").cast(kind).alias(alias) for name, alias, kind in at))
    return lines.select(F.col("value").alias("body"), place.alias("place"))


def _judged(kind: str, body: Column) -> tuple[Column, Column]:
    """The decoded value, and why it is refused though it decodes (or null)."""
    if kind == TEXT:
        return unicode_trim(body), F.when(is_blank(body), BLANK)
    if kind == AUDIT:
        return decode_line(body, schemas.AUDIT), F.lit(None).cast("string")
    if kind == OBJECT:
        url = decode_body(body, schemas.URL_BODY)["url"]
        return url, F.when(is_blank(F.col("_value")), BLANK)
    if kind not in (BATCH, DELETE):
        raise ValueError(f"no such kind of body: {kind}")
    items = decode_array_body(body, schemas.BATCH_ITEM if kind == BATCH else T.StringType())
    refused = F.when(F.size("_value") == 0, EMPTY)
    if kind == BATCH:
        blank = F.exists("_value", lambda item: is_blank(item["original_url"]) | is_blank(item["correlation_id"]))
        refused = refused.when(blank, BLANK)
    return items, refused


def judge(bodies: DataFrame, kind: str) -> DataFrame:
    """``bodies`` with ``accepted``, ``value`` (what was decoded; null if refused) and ``reason`` (null if accepted).

    ``syntax``: no JSON; ``type``: JSON that does not fit; ``empty``: an array without elements; ``blank``: a URL, or an item's
    URL or correlation id, of white space only. A null body of a JSON kind is ``syntax``, of a text ``blank``.
    Text behind the first value of a request body is ignored; an audit line must hold exactly one value.
    """
    value, refused = _judged(kind, F.col("body"))
    text = F.concat(F.lit("["), F.col("body"), F.lit("]")) if kind == AUDIT else F.col("body")
    undecoded = F.when(F.try_parse_json(text).isNull(), SYNTAX).otherwise(TYPE)
    reason = refused if kind == TEXT else F.when(F.col("_value").isNull(), undecoded).otherwise(refused)
    return (
        bodies.withColumn("_value", value)
        .withColumn("reason", reason)
        .withColumn("accepted", F.col("reason").isNull())
        .withColumn("value", F.when(F.col("accepted"), F.col("_value")))
        .drop("_value")
    )


def intake(kind: str, target: str) -> Sink:
    """A sink that judges each micro-batch of ``body_stream`` and writes both outputs to ``target``. Accepted rows drop their body."""

    def work(batch: DataFrame, batch_id: int) -> None:
        rows = judge(batch, kind).withColumn("body", F.when(~F.col("accepted"), F.col("body")))
        rows.select("place", "body", "value", "reason", "accepted").write.mode("overwrite").partitionBy("accepted").parquet(f"{target}/batch={batch_id}")

    return work


def stream_intake(bodies: DataFrame, kind: str, target: str, checkpoint: str, trigger: Mapping = AVAILABLE_NOW) -> StreamingQuery:
    """Decode a stream of bodies of one ``kind`` into ``target``; read it with ``accepted`` and ``rejected``."""
    return start_batches(bodies, intake(kind, target), checkpoint, trigger)


def _written(spark: SparkSession, target: str, kind: str) -> DataFrame:
    schema = T.StructType([
        T.StructField("place", PLACE), T.StructField("body", T.StringType()), T.StructField("value", _VALUES[kind]),
        T.StructField("reason", T.StringType()), T.StructField("accepted", T.BooleanType()), T.StructField("batch", T.LongType()),
    ])
    return spark.read.schema(schema).parquet(target)


def accepted(spark: SparkSession, target: str, kind: str) -> DataFrame:
    """``batch, place, value``; a struct's fields come as columns of their own. The folders of rejects are not opened."""
    value = "value.*" if isinstance(_VALUES[kind], T.StructType) else "value"
    return _written(spark, target, kind).where("accepted").select("batch", "place", value)


def rejected(spark: SparkSession, target: str, kind: str) -> DataFrame:
    """``batch, place, body, reason``."""
    return _written(spark, target, kind).where(~F.col("accepted")).select("batch", "place", "body", "reason")
