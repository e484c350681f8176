import datetime as dt
import gzip
import http.client
import io
import json
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from linkweave import schemas
from linkweave.operators import responses
from linkweave.session import drop_scratch, scratch_path, scratch_root, scratch_scope, stage
from linkweave.sources import readers, stores, writers

DAY = dt.datetime(2024, 1, 1)


def link_frame(spark, rows):
    full = [(s, o, u, d, DAY, DAY) for s, o, u, d in rows]
    return spark.createDataFrame(
        full, "short_id string, original_url string, user_id string, is_deleted boolean, created_at timestamp_ntz, updated_at timestamp_ntz"
    )


def as_rows(frame):
    return sorted((r.short_id, r.original_url, r.user_id, r.is_deleted) for r in frame.collect())


def test_read_links(spark, tmp_path):
    lines = ['{"short_url":"a","original_url":"o1"}', "broken", "", '{"short_url":"b","original_url":"o1"}', '{"short_url":"a","original_url":"o2"}']
    (tmp_path / "part-00000").write_text("\n".join(lines) + "\n")
    (tmp_path / "part-00001").write_text('{"short_url":"b","original_url":"o3","is_deleted":true}\n')
    assert as_rows(readers.read_links(spark, str(tmp_path))) == [("a", "o2", "", False), ("b", "o3", "", True)]
    assert readers.read_links(spark, str(tmp_path / "missing")).isEmpty()


def test_line_order_holds_when_a_file_is_read_in_parts(spark, tmp_path):
    path = tmp_path / "links.json"
    n = 3000
    path.write_text("".join(f'{{"short_url":"k{i % 100:05d}","original_url":"v{i}","user_id":"u1"}}\n' for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        lines = readers.read_link_lines(spark, str(path))
        assert lines.rdd.getNumPartitions() > 4
        got = {r.short_id: r.original_url for r in readers.read_links(spark, str(path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {f"k{i:05d}": f"v{n - 100 + i}" for i in range(100)}


def test_gzip_bodies(spark, tmp_path):
    with gzip.open(tmp_path / "b.gz", "wt") as out:
        out.write('{"url": "https://example.org/"}\n{"url": "   "}\n[]\n')
    got = readers.decode_url_bodies(readers.read_bodies(spark, str(tmp_path))).collect()
    assert [(r.url, r.status) for r in got] == [("https://example.org/", None), ("   ", None), (None, 400)]
    (tmp_path / "whole").mkdir()
    (tmp_path / "whole" / "one.txt").write_text(" \nhttps://example.org/\n")
    body = readers.read_bodies(spark, str(tmp_path / "whole"), whole=True)
    assert body.select(responses.stored_url(F.lit("text"), F.col("body"))).first()[0] == "https://example.org/"


def test_batch_and_delete_bodies(spark):
    bodies = ['[{"correlation_id":"1","original_url":"a"},{"correlation_id":"2","original_url":"b"}]', "[]", "x"]
    frame = spark.createDataFrame([(b,) for b in bodies], "body string")
    got = [(r.pos, r.correlation_id, r.original_url, r.status) for r in readers.decode_batch_bodies(frame).collect()]
    assert sorted(got, key=str) == sorted([(0, "1", "a", None), (1, "2", "b", None), (None, None, None, 400), (None, None, None, 400)], key=str)
    deletes = spark.createDataFrame([('["a"]',), ("{}",)], "body string")
    assert [r.ids for r in readers.decode_delete_bodies(deletes).collect()] == [["a"], None]


def test_audit_file(spark, tmp_path):
    events = [(1700000000, "shorten", "u1", "https://example.com/a"), (42, "follow", "", "https://b.example/")]
    frame = spark.createDataFrame(events, schemas.AUDIT)
    path = str(tmp_path / "audit")
    for load_id in (0, 1, 0):  # a load that runs again replaces its events
        writers.append_audit(frame, path, load_id)
    assert sorted({r.value for r in spark.read.text(path).collect()}) == [
        '{"ts":1700000000,"action":"shorten","user_id":"u1","url":"https://example.com/a"}',
        '{"ts":42,"action":"follow","url":"https://b.example/"}',
    ]
    assert readers.read_audit(spark, path).count() == 4


def test_post_audit_goes_on_after_a_failure(spark):
    events = spark.createDataFrame([(i, "follow", "u", f"o{i}") for i in range(6)], schemas.AUDIT)

    def send(payload):
        number = json.loads(payload)["ts"]
        if number == 3:
            raise http.client.BadStatusLine("x")
        return 500 if number == 4 else 204

    got = writers.post_audit(events, send).collect()
    assert {json.loads(r.payload)["ts"]: r.error for r in got if r.error} == {3: "BadStatusLine"}
    assert sorted((json.loads(r.payload)["ts"], r.http_status, r.delivered) for r in got) == [
        (0, 204, True), (1, 204, True), (2, 204, True), (3, None, False), (4, 500, False), (5, 204, True),
    ]


def test_http_sender(monkeypatch):
    seen = []

    class Answer(io.BytesIO):
        status = 202

    def urlopen(request, timeout):
        seen.append((request.full_url, request.get_method(), request.data, request.headers["Content-type"], timeout))
        if request.data == b"bad":
            raise urllib.error.HTTPError(request.full_url, 503, "down", {}, None)
        return Answer()

    monkeypatch.setattr(urllib.request, "urlopen", urlopen)
    send = writers.http_sender("http://audit.example/in")
    assert [send("{}"), send("bad")] == [202, 503]
    assert seen[0] == ("http://audit.example/in", "POST", b"{}", "application/json", 10.0)


def test_responses_are_compressed_only_where_allowed(spark, tmp_path):
    rows = [
        (1, 201, "application/json", "{}", True, "gzip"), (2, 201, "application/json", "{}", False, "identity"),
        (3, 409, "application/json", "{}", True, "identity"), (4, 201, "text/plain", "a", True, "identity"),
        (5, 200, "text/html; charset=utf-8", "<p>", True, "gzip"), (6, 204, None, None, True, "identity"),
    ]
    frame = spark.createDataFrame(rows, "req_id long, status int, content_type string, body string, accepts_gzip boolean, want string")
    path = str(tmp_path / "out")
    writers.write_responses(frame.drop("want"), path)
    got = {r.req_id: r.encoding for r in readers.read_responses(spark, path).collect()}
    assert got == {r[0]: r[5] for r in rows}
    names = [p.name for p in (tmp_path / "out" / "encoding=gzip").glob("part-*")]
    assert names and all(n.endswith(".json.gz") for n in names)


def test_schema_steps(spark):
    old = spark.createDataFrame([(1, "a", "o", "u")], "link_id int, short_id string, original_url string, user_id string")
    new = writers.upgrade_schema(old)
    assert [f.name for f in new.schema] == [f.name for f in schemas.LINKS]
    assert new.first().is_deleted is False and new.first().link_id == 1
    flagged = writers.upgrade_schema(old.withColumn("is_deleted", F.lit(None).cast("boolean")))
    assert flagged.first().is_deleted is False
    assert "is_deleted" not in writers.downgrade_schema(new).columns


def test_links_table_options():
    options = readers.links_table_options("jdbc:x", bounds=(1, 1000), partitions=8, user="u")
    assert options["partitionColumn"] == "id" and options["numPartitions"] == "8" and options["user"] == "u"
    assert "partitionColumn" not in readers.links_table_options("jdbc:x")


def test_a_delete_before_its_link_does_nothing(spark, tmp_path):
    store = stores.ParquetStore(spark, str(tmp_path))
    hour = dt.timedelta(hours=1)
    marks = [("early", "u", DAY - hour), ("late", "u", DAY + hour), ("late", "u", DAY - hour), ("other", "v", DAY + hour)]
    store.tombstone(spark.createDataFrame(marks, "short_id string, user_id string, ts timestamp_ntz"), 0)
    links = [(s, f"o{s}", "u", False, DAY, DAY) for s in ("early", "late", "other")]
    schema = "short_id string, original_url string, user_id string, is_deleted boolean, created_at timestamp_ntz, updated_at timestamp_ntz"
    store.append(spark.createDataFrame(links, schema), 1)
    assert {r.short_id: r.is_deleted for r in store.read().collect()} == {"early": False, "late": True, "other": False}
    asked = spark.createDataFrame([("late",), ("zz",), ("late",)], "short_id string")
    assert [tuple(r)[::3] for r in store.read_for("short_id", asked).select("short_id", "user_id", "created_at", "is_deleted").collect()] == [("late", True)]
    urls = spark.createDataFrame([("oearly",)], "original_url string")
    assert [r.is_deleted for r in store.read_for("original_url", urls).collect()] == [False]


@pytest.mark.parametrize("kind", [stores.ParquetStore, stores.NdjsonStore])
def test_stores(spark, tmp_path, kind):
    store = kind(spark, str(tmp_path / "s"))
    assert store.read().isEmpty()
    store.append(link_frame(spark, [("a", "o1", "u", False)]), 0)
    store.append(link_frame(spark, [("b", "o2", "u", False), ("c", "o3", "v", False)]), 1)
    store.append(link_frame(spark, [("b", "o2", "u", False), ("c", "o3", "v", False)]), 1)
    marks = spark.createDataFrame([("b", "u"), ("c", "u"), ("x", "u")], "short_id string, user_id string")
    for _ in range(2):
        store.tombstone(marks, 2)
    want = [("a", "o1", "u", False), ("b", "o2", "u", True), ("c", "o3", "v", False)]
    assert as_rows(store.read()) == want
    assert as_rows(store.compact(str(tmp_path / "t")).read()) == want
    assert {r.short_id for r in stores.store_user_urls(store, "u").collect()} == {"a"}


def test_parquet_store_reads_a_past_state(spark, tmp_path):
    store = stores.ParquetStore(spark, str(tmp_path))
    for load in range(3):
        store.append(link_frame(spark, [(f"s{load}", f"o{load}", "u", False)]), load)
    assert {r.short_id for r in store.read(before=2).collect()} == {"s0", "s1"}


def test_rewrite_never_overwrites(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    writers.rewrite_links(link_frame(spark, [("a", "o", "u", True)]), path)
    assert as_rows(readers.read_links(spark, path)) == [("a", "o", "u", True)]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        writers.rewrite_links(link_frame(spark, []), path)


def test_scratch_folder(spark):
    root = scratch_root(spark)
    assert scratch_path(spark, "x").startswith(root) and scratch_path(spark, "x") != scratch_path(spark, "x")
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or root == configured.rstrip("/")
    frame = spark.createDataFrame([(1, DAY)], "a int, t timestamp_ntz")
    assert stage(frame, "x").schema == frame.schema and stage(frame, "x").collect() == frame.collect()


def test_staged_data_is_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("linkweave.session.scratch_root", lambda _: str(tmp_path))

    def folders():
        return {p.parent.name.split("-")[0] + "/" + p.name.split("-")[0] for p in tmp_path.glob("linkweave/*/**/[a-z]*-*") if p.is_dir()}

    kept = stage(spark.range(3), "kept")
    with scratch_scope(spark):
        stage(spark.range(3), "inner")
        assert any("inner" in f for f in folders())
    assert not any("inner" in f or "scope" in f for f in folders()) and kept.count() == 3
    drop_scratch(spark)
    assert not folders()


class _Session:
    """Just enough of a session without spark.checkpoint.dir."""

    def __init__(self, master):
        self.master, self.folder = master, None
        self.conf = self.sparkContext = self

    def get(self, name, default=None):
        return default

    def getConf(self):
        return self

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_only_a_local_session_may_use_a_folder_of_its_own(monkeypatch, tmp_path):
    monkeypatch.setattr("tempfile.mkdtemp", lambda prefix: str(tmp_path / prefix))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(_Session("spark://host:7077"))
    local = _Session("local[2]")
    assert scratch_root(local) == scratch_root(local) == str(tmp_path / "linkweave-")


class _Cluster:
    """The real session under the name of a cluster's master."""

    def __init__(self, spark, rows=None, **settings):
        self._spark, self._rows, self.conf = spark, rows, self
        self._settings = {"spark.master": "spark://host:7077", "spark.app.id": f"app-{id(self)}"} | settings

    def get(self, name, *default):
        return self._settings[name] if name in self._settings or not default else default[0]

    def range(self, *bounds):
        return self._spark.range(*bounds) if self._rows is None else self._spark.range(self._rows)

    @property
    def read(self):
        return self._spark.read

    @property
    def sparkContext(self):
        class Context(_Session):
            def getConf(self):
                return {}

        return Context("spark://host:7077")


def test_a_mounted_folder_of_a_cluster_is_shared(spark, tmp_path):
    folder = f"file://{tmp_path}"
    assert scratch_root(_Cluster(spark, **{"spark.checkpoint.dir": folder})) == folder
    assert scratch_path(_Cluster(spark, **{"spark.checkpoint.dir": folder}), "x").startswith(folder + "/linkweave/app-")
    assert scratch_root(_Cluster(spark, **{"spark.sql.warehouse.dir": folder})) == folder


def test_a_folder_that_loses_rows_is_refused(spark, tmp_path):
    with pytest.raises(RuntimeError, match="do not share"):
        scratch_root(_Cluster(spark, rows=3, **{"spark.checkpoint.dir": f"file://{tmp_path}"}))


def test_a_local_cluster_is_a_cluster(spark, monkeypatch, tmp_path):
    monkeypatch.setattr("tempfile.mkdtemp", lambda prefix: str(tmp_path / prefix))
    master = "local-cluster[3,2,3000]"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(_Session(master))
    with pytest.raises(RuntimeError, match="do not share"):
        scratch_root(_Cluster(spark, rows=3, **{"spark.master": master, "spark.checkpoint.dir": f"file://{tmp_path}/lost"}))
    folder = f"file://{tmp_path}/kept"
    assert scratch_root(_Cluster(spark, **{"spark.master": master, "spark.checkpoint.dir": folder})) == folder
