"""Shortening with keyed state: equal to the batch operator, also where ids collide, with a filled store and over restarts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from linkweave.operators.shorten import new_links, shorten_unique
from linkweave.sources.stores import ParquetStore
from linkweave.streaming import buffer, registry

START = dt.datetime(2024, 1, 1)
REQUEST = "req_id long, ts timestamp_ntz, user_id string, original_url string"
LINK = "short_id string, original_url string, user_id string, is_deleted boolean, created_at timestamp_ntz, updated_at timestamp_ntz"


@pytest.fixture
def session(spark):
    made = buffer.state_session(spark)
    made.conf.set("spark.sql.shuffle.partitions", "2")
    return made


def requests(session, rows):
    return session.createDataFrame([(i, START + dt.timedelta(seconds=s), f"u{i % 3}", url) for i, s, url in rows], REQUEST)


def result(frame):
    return sorted((r.req_id, r.short_id, r.status) for r in frame.select("req_id", "short_id", "status").collect())


def run(session, root, slices, store, **options):
    for number, rows in enumerate(slices):
        rows.coalesce(1).write.mode("overwrite").parquet(f"{root}/in/slice={number}")
        stream = session.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        registry.stream_shorten_state(stream, store, f"{root}/out", f"{root}/checkpoint", **options).awaitTermination()
    return result(session.read.parquet(f"{root}/out"))


def sequential(session, slices, links, **options):
    """Each slice by the batch operator, on the links of those before."""
    made = []
    for rows in slices:
        outcome = shorten_unique(rows, links, **options)
        made += result(outcome)
        links = session.createDataFrame(links.unionByName(new_links(outcome)).collect(), LINK)
    return sorted(made), links


def test_collisions_a_filled_store_and_restarts(session, tmp_path, monkeypatch):
    # 36 ids for some 30 URLs: most first choices collide, some URLs get none
    options = {"charset": "abcdef", "length": 2}
    slices = [requests(session, [(100 * n + i, (7 * i) % 11, f"o{(i * i + 5 * n) % 31}") for i in range(30)]) for n in range(3)]
    at = START - dt.timedelta(days=1)
    held = session.createDataFrame([("aa", "o1", "x", False, at, at), ("zz", "o4", "x", True, at, at), ("ab", "other", "x", False, at, at)], LINK)
    store = ParquetStore(session, str(tmp_path / "store"))
    store.append(held, -1)
    starts, seed = [], registry._seed

    def once(*arguments):
        starts.append(seed(*arguments))
        # after the first start a row of it that is read ends the stream
        return starts[0] if len(starts) == 1 else starts[-1].withColumn("own", F.raise_error(F.lit("read again")).cast("boolean"))

    monkeypatch.setattr(registry, "_seed", once)
    got = run(session, str(tmp_path), slices, store, **options)
    want, links = sequential(session, slices, held, **options)
    assert got == want and len(starts) == 3
    assert {r.original_url: r.short_id for r in store.read().collect()} == {r.original_url: r.short_id for r in links.collect()}
    assert {s for *_, s in got} >= {201, 409} and session.read.parquet(f"{tmp_path}/out_moved").count() > 0


def test_copies_nulls_and_one_hot_url(session, tmp_path):
    rows = [(i, i % 5, "hot") for i in range(1, 200)] + [(7, 2, "hot"), (300, 0, "é\n"), (301, 0, ""), (302, 1, None)]
    slices = [requests(session, rows), requests(session, rows[:50] + [(400, 9, "new")]).withColumn("ts", F.when(F.col("req_id") != 3, F.col("ts")))]
    store = ParquetStore(session, str(tmp_path / "store"))
    got = run(session, str(tmp_path), slices, store)
    assert [r[2] for r in got if r[0] == 302] == [500]
    want, _ = sequential(session, [s.where("original_url is not null") for s in slices], session.createDataFrame([], LINK))
    assert [r for r in got if r[0] != 302] == want


def test_a_hot_url_is_reduced_before_the_state():
    import pandas as pd

    frame = pd.DataFrame({"first_id": ["x", "y", "x"], "original_url": ["o", "p", "o"], "micros": [5, 1, 4], "number": [1, 2, 3]})
    (made,) = registry._reduce(iter([frame]))
    assert made.sort_values("first_id").values.tolist() == [["x", "o", 4, 3, 2], ["y", "p", 1, 2, 1]]
