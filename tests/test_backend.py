import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkweave.sources import backend

DAY = dt.datetime(2024, 1, 1)


def shelves_of_a_user():
    class Shelves:
        """A user's backend: made-up rows on as many shelves as an option says; the first letter of an id tells its shelf."""

        def __init__(self, options):
            self.shelves = int(options["shelves"])

        def parts(self, wanted):
            ids = wanted.get("short_id")
            return [i for i in range(self.shelves) if ids is None or any(v.startswith(chr(97 + i)) for v in ids)]

        def read(self, part, wanted):
            for half in range(2):
                ids = [f"{chr(97 + part)}{i}" for i in range(half * 5, half * 5 + 5)]
                yield pa.RecordBatch.from_pydict({"user_id": [f"u{i % 3}" if i else None for i in range(5)], "short_id": ids, "is_deleted": [False] * 5})

    return Shelves  # of no module, so it travels to the tasks as it is


@pytest.fixture
def shelves(spark):
    backend.register(spark, "shelves", shelves_of_a_user())
    return backend.read_source(spark, "shelves", shelves="4")


def tasks(rows):
    return rows.rdd.getNumPartitions()


def test_all_rows_and_missing_columns(shelves):
    rows = shelves.collect()
    assert shelves.schema == backend.LINKS and tasks(shelves) == 4
    assert sorted(r.short_id for r in rows) == sorted(f"{c}{i}" for c in "abcd" for i in range(10))
    assert all(r.original_url is None and r.created_at is None for r in rows)


def test_filters_are_pushed(spark, shelves):
    one = shelves.where("short_id = 'b3'")
    assert [r.short_id for r in one.collect()] == ["b3"] and tasks(one) == 1
    assert "PushedFilters: [EqualTo(short_id,b3)]" in one._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    many = shelves.where(F.col("short_id").isin("a1", "c2", "zz") & (F.col("user_id") == "u1"))
    assert sorted(r.short_id for r in many.collect()) == ["a1"] and tasks(many) == 2
    # a null is never wanted, two tests that exclude each other leave no part, other tests go back to Spark
    assert shelves.where("user_id = 'u1'").count() == 8 * 2
    assert shelves.where("short_id = 'a1' and short_id in ('b1', 'c1')").count() == 0
    assert shelves.where("short_id > 'd7' and is_deleted = false").count() == 2
    assert shelves.where("short_id = 'a1' or user_id = 'u2'").count() == 8 + 1
    assert shelves.where("original_url = 'x'").count() == 0


def test_few_keys_are_pushed_and_many_joined(spark, shelves, monkeypatch):
    keys = [f"{c}{i}" for c in "abz" for i in (0, 7)]
    wanted = spark.createDataFrame([(k,) for k in keys * 2 + [None]], "short_id string")
    few = backend.read_for(spark, "shelves", "short_id", wanted, shelves="4")
    monkeypatch.setattr(backend, "FEW_KEYS", 2)
    many = backend.read_for(spark, "shelves", "short_id", wanted, shelves="4")
    assert tasks(few) == 2
    for rows in (few, many):
        assert sorted(r.short_id for r in rows.collect()) == ["a0", "a7", "b0", "b7"]


def test_folder(spark, tmp_path):
    rows = [(f"s{i:04d}", f"o{i}", f"u{i % 5}", i % 2 == 0, DAY, None) for i in range(1000)]
    links = spark.createDataFrame(rows, backend.LINKS)
    links.repartitionByRange(4, "short_id").sortWithinPartitions("short_id").withColumn("extra", F.lit(1)).write.mode("overwrite").parquet(str(tmp_path))
    backend.register(spark, "link_folder", backend.FolderBackend)
    for path in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}"):
        read = backend.read_source(spark, "link_folder", path=path, batchRows="100")
        assert sorted(tuple(r) for r in read.collect()) == sorted(rows)
        assert sorted(tuple(r) for r in read.where("user_id = 'u3' and is_deleted").collect()) == [r for r in rows if r[2] == "u3" and r[3]]
        assert [r.original_url for r in read.where("short_id = 's0500'").collect()] == ["o500"]
