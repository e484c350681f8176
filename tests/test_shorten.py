import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from test_functions import expected_id

from linkweave.operators import shorten
from linkweave.operators.lookup import resolve

REQUEST = "req_id long, ts timestamp_ntz, user_id string, original_url string"
LINK = "short_id string, original_url string, user_id string, is_deleted boolean"
DAY = dt.datetime(2024, 1, 1)


def make_requests(n, n_urls, seed=1, hot_share=0.0):
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        url = 0 if pick.random() < hot_share else pick.randrange(n_urls)
        # many equal times: the request id decides
        rows.append((i, DAY + dt.timedelta(seconds=pick.randrange(n // 3)), f"u{pick.randrange(5)}", f"https://x.example/{url}"))
    pick.shuffle(rows)
    return rows


def sequential(rows, stored):
    """Status and id of each request, one after the other, ids without collisions."""
    known = {url: short for short, url in stored}
    out = {}
    for req_id, _, _, url in sorted(rows, key=lambda r: (r[1], r[0])):
        out[req_id] = (409 if url in known else 201, known.setdefault(url, expected_id(url, 0)))
    return out


@pytest.mark.parametrize("rows_per_task", [7, 1_000_000])
def test_unique_mode_equals_a_sequential_pass(spark, rows_per_task):
    rows = make_requests(400, 60, hot_share=0.35)
    stored = [("kept0001", "https://x.example/0"), ("kept0002", "https://x.example/7")]
    links = spark.createDataFrame([(s, u, "owner", True) for s, u in stored], LINK)
    got = shorten.shorten_unique(spark.createDataFrame(rows, REQUEST), links, rows_per_task=rows_per_task)
    assert {r.req_id: (r.status, r.short_id) for r in got.collect()} == sequential(rows, stored)


def test_hot_url_is_spread(spark):
    from linkweave.operators.skew import lookup

    rows = make_requests(300, 50, hot_share=0.4)
    facts = spark.createDataFrame(rows, REQUEST)
    dim = facts.groupBy("original_url").agg(F.count(F.lit(1)).alias("n"), F.min("req_id").alias("low"))
    joined = lookup(facts, dim, ["original_url"], ["req_id"], "left", "n", rows_per_task=10)
    hot = "https://x.example/0"
    tasks = joined.withColumn("task", F.spark_partition_id()).where(F.col("original_url") == hot)
    assert tasks.select("task").distinct().count() > 1
    plain = facts.join(dim.drop("n"), "original_url", "left").select(sorted(joined.columns))
    assert joined.select(sorted(joined.columns)).exceptAll(plain).isEmpty()
    assert joined.count() == 300
    uncounted = lookup(facts, dim.drop("n"), ["original_url"], ["req_id"], rows_per_task=10)
    assert uncounted.select(sorted(joined.columns)).exceptAll(plain).isEmpty()


def rounds(keys, taken, charset, length, attempts):
    """The rounds of ``assign_ids`` on (key, order) pairs."""
    taken, open_keys, out = set(taken), dict(keys), {}
    for attempt in range(attempts):
        first = {}
        for key, order in sorted(open_keys.items(), key=lambda item: item[1]):
            first.setdefault(expected_id(key, attempt, charset, length), key)
        for short, key in first.items():
            if short not in taken:
                taken.add(short)
                out[key] = short
                del open_keys[key]
    return out | dict.fromkeys(open_keys)


def test_collisions_take_rounds_and_then_fail(spark):
    keys = [(f"k{i}", i) for i in range(40)]
    stored = spark.createDataFrame([("aa",), ("ab",)], "short_id string")
    rows = spark.createDataFrame(keys, "key string, at int")
    got = shorten.assign_ids(rows, "key", "at", stored, charset="abcdef", length=2)
    got = {r.key: r.short_id for r in got.collect()}
    assert got == rounds(keys, {"aa", "ab"}, "abcdef", 2, 5)
    given = [v for v in got.values() if v is not None]
    assert len(set(given)) == len(given) and {"aa", "ab"}.isdisjoint(given)
    assert None in got.values()


def test_requests_without_a_free_id_fail(spark):
    rows = [(i, DAY, "u", f"https://x.example/{i % 4}") for i in range(8)]
    got = shorten.shorten_unique(spark.createDataFrame(rows, REQUEST), charset="a", length=1).collect()
    assert sorted(r.status for r in got) == [201, 409] + [500] * 6
    append = shorten.shorten_append(spark.createDataFrame(rows, REQUEST), charset="a", length=1).collect()
    assert sorted(r.status for r in append) == [201] + [500] * 7


def test_id_collisions(spark):
    candidates = spark.createDataFrame([(i, "hot" if i % 3 else f"s{i}") for i in range(30)], "req_id long, short_id string")
    stored = spark.createDataFrame([("hot",), ("s3",), ("zz",)], "short_id string")
    for rows_per_task in (4, 1_000_000):
        got = shorten.id_collisions(candidates, stored, rows_per_task=rows_per_task)
        assert sorted(r.req_id for r in got.collect()) == sorted([3, *(i for i in range(30) if i % 3)])


def test_append_mode_makes_a_link_per_request(spark):
    rows = make_requests(50, 5)
    got = shorten.shorten_append(spark.createDataFrame(rows, REQUEST))
    assert {r.status for r in got.collect()} == {201}
    assert got.select("short_id").distinct().count() == 50
    links = shorten.new_links(got).withColumn("link_id", F.lit(0).cast("long"))
    clicks = got.select("req_id", "short_id")
    visited = resolve(clicks, links).join(got.select("req_id", "original_url"), "req_id")
    assert visited.where("status <> 307 or location <> original_url").isEmpty()


def test_latest_and_first(spark):
    rows = make_requests(120, 10)
    frame = spark.createDataFrame(rows, REQUEST).withColumn("short_id", F.col("original_url"))
    order = shorten.arrival(F.col("ts"), F.col("req_id"))
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    last, first = {r[3]: r[0] for r in ordered}, {r[3]: r[0] for r in reversed(ordered)}
    assert {r.original_url: r.req_id for r in shorten.latest_by_id(frame, order).collect()} == last
    assert {r.original_url: r.req_id for r in shorten.first_by_original(frame).collect()} == first
    index = shorten.original_index(frame.withColumn("short_id", F.col("req_id").cast("string")), order)
    assert {r.original_url: int(r.short_id) for r in index.collect()} == last


def test_a_repeated_log_makes_one_link_per_url(spark):
    rows = make_requests(40, 7)
    log = spark.createDataFrame(rows + rows + [(900, None, "u1", "only-untimed"), (901, None, "u2", "only-untimed")], REQUEST)
    got = shorten.shorten_unique(log)
    links = shorten.new_links(got)
    assert links.count() == links.select("short_id").distinct().count() == links.select("original_url").distinct().count() == 8
    untimed = {r.req_id: r.status for r in got.where("ts is null").collect()}
    assert untimed == {900: 201, 901: 409}


def test_arrival_orders_by_time_then_id(spark):
    values = [(dt.datetime(1969, 12, 31), -(2**63)), (dt.datetime(1969, 12, 31), 9 * 10**18), (dt.datetime(1969, 12, 31, 0, 0, 0, 1), -9 * 10**18), (dt.datetime(1970, 1, 1), 0), (DAY, 2**63 - 1), (DAY + dt.timedelta(microseconds=1), 0)]
    frame = spark.createDataFrame(values, "ts timestamp_ntz, req_id long")
    got = [r.a for r in frame.select("ts", "req_id", shorten.arrival(F.col("ts"), F.col("req_id")).alias("a")).orderBy("ts", "req_id").collect()]
    assert got == sorted(got) and len(set(got)) == 6
