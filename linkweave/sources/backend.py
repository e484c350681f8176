"""Storage of the user's own as a Spark source: ``spark.read.format(name)`` over any backend that hands out Arrow batches.

Equalities and lists on ``short_id``, ``original_url`` and ``user_id`` are pushed to the backend, which may use them to leave out
parts or pages. It need not: rows that it returns besides are dropped in the same task.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping
from typing import Any, Protocol

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from linkweave import schemas
from linkweave.operators.shorten import matching
from linkweave.session import stage

KEYS = ("short_id", "original_url", "user_id")
LINKS = StructType([field for field in schemas.LINKS if field.name not in ("link_id", "uuid")])
# Up to so many wanted keys are pushed as a list; more are joined.
FEW_KEYS = 200
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

Wanted = Mapping[str, frozenset[str]]


class Backend(Protocol):
    """What a user writes. It is built from the read's options, on the driver and again in every task."""

    def __init__(self, options: Mapping[str, str]): ...

    def parts(self, wanted: Wanted) -> Iterable[Any]:
        """What is read by one task each, as values that can be pickled. ``wanted`` has the values of each key that was asked for."""

    def read(self, part: Any, wanted: Wanted) -> Iterator[pa.RecordBatch]:
        """The rows of a part, in batches that fit a task. Missing columns are null."""


class FolderBackend:
    """Parquet files below ``path``, one task each; Arrow leaves out the row groups that cannot hold a wanted key."""

    def __init__(self, options: Mapping[str, str]):
        # Hadoop writes a local path as file:/a, Arrow wants file:///a
        self.files, self.path = FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", options["path"]))
        self.rows = int(options.get("batchrows", "10000"))

    def parts(self, wanted: Wanted) -> list[str]:
        return sorted(pyarrow.dataset.dataset(self.path, format="parquet", filesystem=self.files).files)

    def read(self, part: str, wanted: Wanted) -> Iterator[pa.RecordBatch]:
        test = None
        for name, values in wanted.items():
            one = pc.field(name).isin(sorted(values))
            test = one if test is None else test & one
        rows = pyarrow.dataset.dataset(part, format="parquet", filesystem=self.files)
        columns = [name for name in LINKS.names if name in rows.schema.names]
        yield from rows.to_batches(columns=columns, filter=test, batch_size=self.rows, batch_readahead=1, fragment_readahead=1)


class _Reader(DataSourceReader):
    def __init__(self, backend: type[Backend], options: Mapping[str, str], schema: StructType):
        self.backend, self.options, self.schema = backend, dict(options), schema
        self.wanted: dict[str, frozenset[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Keep what is wanted of each key; several tests of one key leave the values that pass all. The rest goes back to Spark."""
        for one in filters:
            name = one.attribute[0] if isinstance(one, (EqualTo, In)) and len(one.attribute) == 1 else None
            if name not in KEYS or name not in self.schema.names:
                yield one
                continue
            values = one.value if isinstance(one, In) else (one.value,)
            found = frozenset(v for v in values if v is not None)
            self.wanted[name] = self.wanted[name] & found if name in self.wanted else found

    def partitions(self) -> list[InputPartition]:
        if any(not values for values in self.wanted.values()):
            return []
        return [InputPartition(part) for part in self.backend(self.options).parts(self.wanted)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no part at all
            return
        shape = to_arrow_schema(self.schema)
        for batch in self.backend(self.options).read(partition.value, self.wanted):
            present = set(batch.schema.names)
            for name, values in self.wanted.items():
                if name in present:
                    batch = batch.filter(pc.fill_null(pc.is_in(batch.column(name), pa.array(sorted(values), batch.schema.field(name).type)), False))
                else:
                    batch = batch.slice(0, 0)  # a null key is none of those wanted
            if batch.num_rows:
                columns = [batch.column(f.name).cast(f.type) if f.name in present else pa.nulls(batch.num_rows, f.type) for f in shape]
                yield pa.RecordBatch.from_arrays(columns, schema=shape)


def link_source(format_name: str, backend: type[Backend]) -> type[DataSource]:
    """A data source that reads links through ``backend``."""

    class LinkSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return format_name

        def schema(self) -> StructType:
            return LINKS

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(backend, self.options, schema)

    return LinkSource


def register(spark: SparkSession, format_name: str, backend: type[Backend]) -> None:
    """Make ``spark.read.format(format_name)`` read through ``backend``."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(link_source(format_name, backend))


def read_source(spark: SparkSession, format_name: str, **options: str) -> DataFrame:
    return spark.read.format(format_name).options(**options).load()


def read_for(spark: SparkSession, format_name: str, key: str, wanted: DataFrame, **options: str) -> DataFrame:
    """The links whose ``key`` is among the values of ``wanted``: few are pushed to the backend, many are joined."""
    keys = stage(wanted.select(key).where(F.col(key).isNotNull()).distinct(), "wanted")
    few = [row[0] for row in keys.limit(FEW_KEYS + 1).collect()]
    links = read_source(spark, format_name, **options)
    return links.where(F.col(key).isin(few)) if len(few) <= FEW_KEYS else matching(links, keys, key)
