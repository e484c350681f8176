"""Sources."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave import schemas
from linkweave.constants import BAD_REQUEST
from linkweave.functions.json import decode_array_body, decode_body, decode_line
from linkweave.operators.shorten import latest_by_id


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def read_link_lines(spark: SparkSession, path: str) -> DataFrame:
    """Decoded lines of an NDJSON link file or folder, with ``line_order``.

    Lines that do not decode are skipped; a missing path is an empty table. Files count in path
    order; within a file, parts count by offset and lines by their place in the part. A row number
    alone would not do: large files are read in several parts, and in any order.
    """
    try:
        lines = spark.read.option("recursiveFileLookup", "true").text(path)
    except AnalysisException as error:
        if not _missing(error):
            raise
        lines = spark.createDataFrame([], "value string, _metadata struct<file_path:string,file_block_start:bigint>")
    return (
        lines.select(
            decode_line(F.col("value"), schemas.LINK_LINE).alias("_link"),
            F.struct(
                F.col("_metadata.file_path").alias("path"),
                F.col("_metadata.file_block_start").alias("part"),
                F.monotonically_increasing_id().alias("line"),
            ).alias("line_order"),
        )
        .where(F.col("_link").isNotNull())
        .select(
            "_link.uuid",
            F.col("_link.short_url").alias("short_id"),
            "_link.original_url",
            "_link.user_id",
            "_link.is_deleted",
            "line_order",
        )
    )


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """The link table in a file or folder: the last line of each id, with its ``line_order``."""
    return latest_by_id(read_link_lines(spark, path), F.col("line_order"))


def links_table_options(
    url: str, table: str = "urls", bounds: tuple[int, int] | None = None, partitions: int = 64, **options
) -> dict[str, str]:
    """JDBC options. With ``bounds`` of ``id`` the table is read by many tasks, each its own range."""
    result = {"url": url, "dbtable": table, "fetchsize": "10000", **{k: str(v) for k, v in options.items()}}
    if bounds is not None:
        low, high = bounds
        result |= {
            "partitionColumn": "id",
            "lowerBound": str(low),
            "upperBound": str(high),
            "numPartitions": str(partitions),
        }
    return result


def read_links_table(spark: SparkSession, url: str, table: str = "urls", **options) -> DataFrame:
    """The link table of a database; filters on ids and users are pushed to it."""
    rows = spark.read.format("jdbc").options(**links_table_options(url, table, **options)).load()
    return rows.withColumnRenamed("id", "link_id")


def read_bodies(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Request bodies, one per line or, with ``whole``, one per file. Gzip files are unpacked."""
    return spark.read.text(path, wholetext=whole).withColumnRenamed("value", "body")


def decode_url_bodies(bodies: DataFrame) -> DataFrame:
    """JSON bodies of single shorten requests: add ``url`` and ``status`` (400 or null)."""
    decoded = decode_body(F.col("body"), schemas.URL_BODY)
    return bodies.withColumn("_d", decoded).select(
        *bodies.columns,
        F.col("_d.url").alias("url"),
        F.when(F.col("_d").isNull(), BAD_REQUEST).cast("int").alias("status"),
    )


def decode_batch_bodies(bodies: DataFrame) -> DataFrame:
    """JSON bodies of batch requests, one row per item: add ``pos, correlation_id, original_url``.

    A body that is no array of items, or an empty one, is a single row with ``status`` 400.
    """
    items = bodies.withColumn("_items", decode_array_body(F.col("body"), schemas.BATCH_ITEM))
    return items.select(*bodies.columns, F.posexplode_outer("_items").alias("pos", "_item")).select(
        *bodies.columns,
        "pos",
        "_item.correlation_id",
        "_item.original_url",
        F.when(F.col("_item").isNull(), BAD_REQUEST).cast("int").alias("status"),
    )


def decode_delete_bodies(bodies: DataFrame) -> DataFrame:
    """JSON bodies of delete requests: add ``ids``; null when the body is no array of strings."""
    return bodies.withColumn("ids", decode_array_body(F.col("body"), T.StringType()))


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit events of all loads in a folder."""
    return spark.read.schema(schemas.AUDIT).option("recursiveFileLookup", "true").json(path)


def read_request_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.REQUEST_LOG).json(path)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_responses`` wrote; ``encoding`` tells gzip from identity."""
    schema = "req_id long, status int, content_type string, body string, encoding string"
    return spark.read.schema(schema).json(path)
