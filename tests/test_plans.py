"""What reaches the scan, and what does not shuffle."""

import datetime as dt
import re

from pyspark.sql import functions as F

from linkweave.operators import deletes, flush, lookup
from linkweave.operators.skew import HOT_PARTS, hot_keys
from linkweave.sources import stores

DAY = dt.datetime(2024, 1, 1)


def plan(frame, run=False):
    if run:
        frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


def store(spark, tmp_path):
    made = stores.ParquetStore(spark, str(tmp_path))
    rows = [(f"s{i}", f"o{i}", f"u{i % 3}", False, DAY, DAY) for i in range(9)]
    links = spark.createDataFrame(rows, "short_id string, original_url string, user_id string, is_deleted boolean, created_at timestamp_ntz, updated_at timestamp_ntz")
    made.append(links, 0)
    made.tombstone(links.where("user_id = 'u0'"), 1)
    return made


def test_filters_reach_the_scan(spark, tmp_path):
    links = store(spark, tmp_path)
    assert "EqualTo(short_id,s1)" in plan(lookup.point_lookup(links.links(), "short_id", "s1"))
    text = plan(stores.store_user_urls(links, "u1"))
    assert text.count("EqualTo(user_id,u1)") == 2  # links and tombstones
    assert re.search(r"PartitionFilters: \[[^\]]*load[^\]]* < 1", plan(links.links(before=1)))


def test_only_needed_columns_are_read(spark, tmp_path):
    links = store(spark, tmp_path)
    clicks = spark.createDataFrame([(1, "s1")], "req_id long, short_id string")
    text = plan(lookup.resolve(clicks, links.links()).select("req_id", "status"))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert schemas and all("original_url" not in s and "created_at" not in s for s in schemas)


def test_clicks_are_read_once(spark, tmp_path):
    links = store(spark, tmp_path)
    spark.createDataFrame([(i, f"s{i}") for i in range(9)], "req_id long, short_id string").write.parquet(f"{tmp_path}/clicks")
    clicks = spark.read.parquet(f"{tmp_path}/clicks")
    final = plan(lookup.resolve(clicks, links.links()), run=True).split("Initial Plan")[0]
    assert len(re.findall(r"ReadSchema: struct<req_id:", final)) == 1


def test_every_hot_key_is_split(spark):
    counts = spark.range(5000).select(F.col("id").alias("key"), F.when(F.col("id") < 1500, 1000).otherwise(1).cast("long").alias("n"))
    hot = hot_keys(counts, ["key"], "n", 100)
    rows = {r.key: r._salts for r in hot.collect()}
    assert rows == {k: 3 for k in range(1500)}  # one part in 4096 of 1,503,500 rows is 367
    even = hot_keys(counts.where("n = 1"), ["key"], "n", 0, parts=3500)
    assert even.count() == 0 and HOT_PARTS > 1500


def test_labels_need_no_shuffle_and_counts_are_combined_first(spark):
    rows = spark.range(10).select(
        F.col("id").alias("req_id"), F.lit(DAY).cast("timestamp_ntz").alias("ts"), F.lit("u").alias("user_id"), F.lit("s").alias("short_id")
    )
    assert "Exchange" not in plan(flush.flush_window(rows, "1 second"))
    assert "partial_count" in plan(flush.tumbling_deletes(rows, "1 second"))
    marks = plan(deletes.tombstones(rows))
    assert marks.count("HashAggregate") == 2 and marks.count("Exchange") == 1
