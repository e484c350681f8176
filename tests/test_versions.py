"""Bucketed tables with versions: what is shuffled and read, races, crashes, compaction."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from linkweave.operators import lookup, shorten
from linkweave.sources import versions
from linkweave.sources.versions import LostRace, VersionedStore

DAY = dt.datetime(2024, 1, 1)
LINK = "short_id string, original_url string, user_id string, is_deleted boolean, created_at timestamp_ntz, updated_at timestamp_ntz"


def links(spark, *numbers, at=DAY):
    return spark.createDataFrame([(f"s{i}", f"o{i}", f"u{i % 3}", False, at, at) for i in numbers], LINK)


def marks(spark, *rows, at=DAY):
    return spark.createDataFrame([(i, u, at) for i, u in rows], "short_id string, user_id string, ts timestamp_ntz")


def content(frame):
    return sorted((r.short_id, r.is_deleted) for r in frame.collect())


@pytest.fixture
def store(spark, tmp_path):
    return VersionedStore(spark, str(tmp_path / "store"), buckets=4)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_nothing_above_the_store_is_shuffled(spark, store, no_broadcast):
    store.append(links(spark, *range(300)), 0)
    store.append(links(spark, *range(300, 400)), 1)
    store.tombstone(marks(spark, ("s1", "u1"), ("s2", "u0"), ("s301", "u1")), 2)
    clicks = spark.createDataFrame([(i, f"s{i}") for i in range(500)], "req_id long, short_id string")
    resolved = lookup.resolve(clicks, store.read())
    outcomes = resolved.collect()
    assert {r.req_id: r.status for r in outcomes} == {i: 404 if i >= 400 else 410 if i in (1, 301) else 307 for i in range(500)}
    final = resolved._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("Exchange") == 1 and "hashpartitioning(short_id" in final and final.count("Bucketed: true") == 2
    # the same for requests by URL: only they are shuffled on the way to the index
    requests = spark.createDataFrame([(i, DAY, "u", f"o{i}") for i in range(390, 410)], "req_id long, ts timestamp_ntz, user_id string, original_url string")
    urls = requests.groupBy("original_url").agg(F.min("req_id").alias("first"))
    hits = urls.join(shorten.matching(store.index(), urls, "original_url"), "original_url", "left")
    assert hits.where("short_id is null").count() == 10
    hits.collect()
    final = hits._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    exchanges = re.findall(r"Exchange hashpartitioning\((\w+)#\d+, (\d+)\)", final)
    assert exchanges and all(e == ("original_url", "4") for e in exchanges)  # never one over the index itself
    above = final.splitlines()
    scan = next(i for i, line in enumerate(above) if "FileScan" in line and "linkweave_urls" in line)
    indent = len(above[scan]) - len(above[scan].lstrip(" :+-*()0123456789"))
    path = []
    for line in reversed(above[:scan]):
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if depth < indent:
            path.append(line)
            indent = depth
    assert not any("Exchange" in line for line in path)


def scanned(frame):
    """Rows that the scans of a run plan gave out."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    leaves = plan.finalPhysicalPlan().collectLeaves() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan.collectLeaves()
    leaves = [leaves.apply(i) for i in range(leaves.size())]
    return sum(leaf.metrics().apply("numOutputRows").value() for leaf in leaves if leaf.metrics().contains("numOutputRows"))


def test_a_look_up_of_few_keys_reads_few_rows(spark, tmp_path):
    rows, wanted = 240_000, 100
    store = VersionedStore(spark, str(tmp_path / "big"), buckets=8, page_rows=100)
    store.append(spark.range(rows).selectExpr("concat('s', id) as short_id", "concat('o', id) as original_url", "'u' as user_id", "false as is_deleted", "timestamp_ntz'2024-01-01' as created_at", "timestamp_ntz'2024-01-01' as updated_at"), 0)
    ids = [f"s{i * 2397 % rows}" for i in range(wanted)]
    keys = spark.createDataFrame([(i,) for i in ids], "short_id string")
    found = store._only(versions.LINKS, keys, "short_id")
    assert scanned(found) < 0.05 * rows and found.count() == wanted
    one = store.links().where(F.col("short_id") == "s77")
    assert scanned(one) <= 200 and one.count() == 1
    asked = spark.createDataFrame([(i,) for i in ids * 3] + [(None,)], "short_id string")
    assert store.read_for("short_id", asked).count() == wanted
    assert store.read_for("original_url", asked.selectExpr("replace(short_id, 's', 'o') as original_url")).count() == wanted
    many = spark.range(300).selectExpr("concat('s', id * 3) as short_id")
    assert store.read_for("short_id", many).count() == 300
    assert store.read_for("user_id", spark.createDataFrame([("u",)], "user_id string")).count() == rows


def test_a_load_written_again_replaces_itself(spark, store):
    store.append(links(spark, 1, 2), 0)
    store.append(links(spark, 3), 1)
    store.append(links(spark, 4), 1)
    assert content(store.read()) == [("s1", False), ("s2", False), ("s4", False)]
    assert content(store.read(before=1)) == [("s1", False), ("s2", False)]
    assert {r.short_id for r in store.index(before=2).collect()} == {"s1", "s2", "s4"}


def test_a_lost_race(spark, store, monkeypatch):
    store.append(links(spark, 1), 0)
    late = VersionedStore(spark, store.path)
    stale = late.manifest()
    store.append(links(spark, 2), 1)
    real = VersionedStore.manifest
    answers = iter([stale, stale])  # the bucket count, then what the change is made of
    monkeypatch.setattr(late, "manifest", lambda: next(answers, None) or real(late))
    with pytest.raises(LostRace):
        late._offer(lambda m: versions._added(m, ("links",), 2, []), tries=1)
    answers = iter([real(late), stale, stale, stale])
    late.append(links(spark, 3), 2)  # offered again on the newest version, without writing the data again
    assert content(VersionedStore(spark, store.path).read()) == [("s1", False), ("s2", False), ("s3", False)]


def test_a_crash_before_the_manifest_leaves_no_trace(spark, store, monkeypatch):
    store.append(links(spark, 1), 0)
    version = store.latest()
    with monkeypatch.context() as patch:
        patch.setattr(VersionedStore, "_commit", lambda self, manifest: (_ for _ in ()).throw(OSError("lost")))
        for write in (lambda: store.append(links(spark, 2), 1), lambda: store.tombstone(marks(spark, ("s1", "u1")), 1)):
            with pytest.raises(OSError):
                write()
    assert store.latest() == version and content(store.read()) == [("s1", False)]
    assert store.clean(grace_seconds=3600) == []  # a writer may still be at it
    assert len(store.clean(grace_seconds=0)) == 3
    assert content(store.read()) == [("s1", False)]
    store.append(links(spark, 2), 1)
    assert content(store.read()) == [("s1", False), ("s2", False)]


def test_compaction_adds_a_version(spark, store):
    store.append(links(spark, 1, 2, 3), 0)
    store.tombstone(marks(spark, ("s1", "u1"), ("s2", "u0"), ("s9", "u0")), 1)  # s2 is not u0's; s9 does not exist yet
    store.append(links(spark, 4), 2)
    old = store.at(store.latest())
    planned = old.read()
    store.compact()
    wanted = [("s1", True), ("s2", False), ("s3", False), ("s4", False)]
    assert content(store.read()) == content(old.read()) == content(planned) == wanted
    assert len(store.manifest().named("links")) == 2 and store.compact(before=2) and content(store.read()) == wanted
    # the newest load may run again, merged ones may not
    store.append(links(spark, 4, 5), 2)
    with pytest.raises(ValueError):
        store.append(links(spark, 7), 1)
    with pytest.raises(ValueError):
        store.links(before=1)
    # a delete that came before the load of its link, kept through the compaction
    store.append(links(spark, 9, at=DAY - dt.timedelta(days=1)), 3)
    assert content(store.read())[-1] == ("s9", True)
    store.clean(keep=1, grace_seconds=0)
    assert content(store.read()) == [("s1", True), ("s2", False), ("s3", False), ("s4", False), ("s5", False), ("s9", True)]


def test_a_compaction_that_lost_its_loads(spark, store, monkeypatch):
    store.append(links(spark, 1), 0)
    store.append(links(spark, 2), 1)
    write = store._write

    def meanwhile(kind, rows, load):
        monkeypatch.setattr(store, "_write", write)
        VersionedStore(spark, store.path).append(links(spark, 7), 0)  # another writer runs load 0 again
        return write(kind, rows, load)

    monkeypatch.setattr(store, "_write", meanwhile)
    with pytest.raises(LostRace):
        store.compact()
    assert content(store.read()) == [("s2", False), ("s7", False)]


def test_an_empty_store(spark, store):
    assert store.read().collect() == [] and store.index().collect() == [] and store.compact() == 0
    assert store.read_for("short_id", spark.createDataFrame([("x",)], "short_id string")).collect() == []
    store.append(links(spark), 0)
    store.tombstone(marks(spark), 0)
    assert store.read().collect() == []
    with pytest.raises(ValueError):
        store.at(0).append(links(spark, 1), 5)
