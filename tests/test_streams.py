import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_shorten import REQUEST, make_requests, sequential

from linkweave import schemas
from linkweave.session import scratch_path
from linkweave.sources import readers, stores
from linkweave.streaming import buffer, jobs

DAY = dt.datetime(2024, 1, 1)


def feed(spark, schema, folder):
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder)


@pytest.mark.parametrize("parts", [1, 3])
def test_shorten_gives_the_same_table_however_it_is_cut(spark, tmp_path, parts):
    rows = sorted(make_requests(150, 20, hot_share=0.3), key=lambda r: (r[1], r[0]))
    schema = spark.createDataFrame([], REQUEST).schema
    store, out = stores.ParquetStore(spark, str(tmp_path / "store")), str(tmp_path / "out")

    def run():
        stream = feed(spark, schema, str(tmp_path / "in"))
        jobs.stream_shorten(stream, store, out, str(tmp_path / "cp")).awaitTermination()

    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).write.parquet(str(tmp_path / "in" / f"p{i}"))
        run()
    run()  # nothing new: nothing happens
    outcomes = spark.read.parquet(out)
    assert {r.req_id: (r.status, r.short_id) for r in outcomes.collect()} == sequential(rows, [])
    assert outcomes.count() == len(rows)
    assert store.links().count() == len({r[3] for r in rows})
    # what the micro-batches staged is gone
    staged = Path(scratch_path(spark, "x").removeprefix("file:")).parent
    assert not list(staged.glob("scope-*"))


def test_a_micro_batch_that_runs_again_gives_the_same_outcomes(spark, tmp_path):
    rows = make_requests(60, 10)
    schema = spark.createDataFrame([], REQUEST).schema
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    store, out = stores.ParquetStore(spark, str(tmp_path / "store")), str(tmp_path / "out")
    # a lost checkpoint makes batch 0 run a second time over its own links
    for checkpoint in ("first", "second"):
        stream = feed(spark, schema, str(tmp_path / "in"))
        jobs.stream_shorten(stream, store, out, str(tmp_path / checkpoint)).awaitTermination()
    got = {r.req_id: (r.status, r.short_id) for r in spark.read.parquet(out).collect()}
    assert got == sequential(rows, [])
    assert store.links().count() == len({r[3] for r in rows})


def test_deletes_and_clicks(spark, tmp_path):
    store = stores.ParquetStore(spark, str(tmp_path / "store"))
    links = [(f"s{i}", f"o{i}", "u", False, DAY, DAY) for i in range(4)]
    store.append(
        spark.createDataFrame(links, "short_id string, original_url string, user_id string, is_deleted boolean, created_at timestamp_ntz, updated_at timestamp_ntz"), 0
    )
    clicks = spark.createDataFrame([(1, "s0"), (2, "s1"), (3, "zz")], "req_id long, short_id string")
    clicks.write.parquet(str(tmp_path / "clicks" / "a"))
    marks = spark.createDataFrame([("s1", "u"), ("s2", "other")], "short_id string, user_id string")
    marks.write.parquet(str(tmp_path / "deletes"))
    out = str(tmp_path / "out")

    def visit():
        jobs.stream_resolve(feed(spark, clicks.schema, str(tmp_path / "clicks")), store, out, str(tmp_path / "cp")).awaitTermination()

    visit()
    jobs.stream_delete_apply(feed(spark, marks.schema, str(tmp_path / "deletes")), store, str(tmp_path / "cpd")).awaitTermination()
    clicks.withColumn("req_id", F.col("req_id") + 10).write.parquet(str(tmp_path / "clicks" / "b"))
    visit()
    got = {r.req_id: r.status for r in spark.read.parquet(out).collect()}
    assert got == {1: 307, 2: 307, 3: 404, 11: 307, 12: 410, 13: 404}


def test_a_failing_sink_does_not_stop_the_others(spark, tmp_path):
    events = spark.createDataFrame([(1, "shorten", "u", "a"), (2, "follow", "", "a")], schemas.AUDIT)
    events.write.parquet(str(tmp_path / "in"))
    calls = []

    def flaky(batch, batch_id):
        calls.append(batch_id)
        if len(calls) == 1:
            raise ConnectionError("down")
        batch.write.mode("overwrite").parquet(str(tmp_path / "flaky"))

    def run():
        stream = feed(spark, events.schema, str(tmp_path / "in"))
        sinks = {"flaky": flaky, "file": jobs.file_sink(str(tmp_path / "file"))}
        return jobs.stream_audit_fanout(stream, sinks, str(tmp_path / "cp"))

    started = run()
    started["file"].awaitTermination()
    with pytest.raises(Exception, match="down"):
        started["flaky"].awaitTermination()
    assert readers.read_audit(spark, str(tmp_path / "file")).count() == 2
    for query in run().values():
        query.awaitTermination()
    assert calls == [0, 0]
    assert spark.read.parquet(str(tmp_path / "flaky")).count() == 2
    assert readers.read_audit(spark, str(tmp_path / "file")).count() == 2


@pytest.mark.parametrize("lanes", [1, 3])
def test_delete_buffer_flushes_when_full_and_by_the_tick(spark, tmp_path, lanes):
    sizes = [4, 7, 1, 9, 10, 3]
    tasks = [(i, DAY, "u1", [f"a{i}_{j}" for j in range(s)]) for i, s in enumerate(sizes)] + [(99, DAY, "u2", ["b"])]
    frame = spark.createDataFrame(tasks, schemas.DELETES)
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    session = buffer.state_session(spark)
    flushes = buffer.stream_deletes(feed(session, frame.schema, str(tmp_path / "in")), threshold=10, tick_ms=10, lanes=lanes)
    writer = flushes.writeStream.format("parquet").option("path", str(tmp_path / "out"))
    jobs.run_until_idle(writer.option("checkpointLocation", str(tmp_path / "cp")).outputMode("append"))
    got = spark.read.schema(buffer.FLUSHES).parquet(str(tmp_path / "out"))
    ids = sorted((r.user_id, r.short_id) for r in buffer.flushed_ids(got).collect())
    assert ids == sorted((user, i) for _, _, user, task in tasks for i in task)
    assert got.where("reason = 'full' and size(ids) < 10").isEmpty()
    assert got.where("reason = 'tick' and size(ids) >= 10").isEmpty()
    if lanes == 1:
        sizes = sorted((r.user_id, r.reason, len(r.ids)) for r in got.collect())
        assert sizes == [("u1", "full", 10), ("u1", "full", 10), ("u1", "full", 11), ("u1", "tick", 3), ("u2", "tick", 1)]


def test_tumbling_stream_writes_closed_ticks(spark, tmp_path):
    rows = [(1, DAY, "u", "a"), (2, DAY + dt.timedelta(seconds=5), "u", "b"), (3, DAY + dt.timedelta(minutes=5), "u", "c")]
    frame = spark.createDataFrame([(i, t, u, s) for i, t, u, s in rows], "req_id long, ts timestamp, user_id string, short_id string")
    frame.write.parquet(str(tmp_path / "in"))
    stream = feed(spark, frame.schema, str(tmp_path / "in"))
    jobs.stream_tumbling_deletes(stream, "1 minute", "1 minute", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.user_id, r.n_ids) for r in got] == [("u", 2)]
