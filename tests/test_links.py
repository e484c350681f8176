import datetime as dt

from pyspark.sql import functions as F

from linkweave.operators import checks, deletes, lookup, responses
from linkweave.plans.routes import route_class

DAY = dt.datetime(2024, 1, 1)
LINK = "link_id long, short_id string, original_url string, user_id string, is_deleted boolean, created_at timestamp_ntz, updated_at timestamp_ntz"


def links(spark):
    rows = [
        (1, "a", "https://one.example", "u1", None, DAY, DAY),
        (2, "b", "https://two.example", "u1", False, DAY + dt.timedelta(days=1), DAY),
        (3, "c", "https://three.example", "u1", True, DAY, DAY),
        (4, "d", "https://four.example", "u2", False, DAY, DAY),
        (5, "e", "https://five.example", "u1", False, DAY + dt.timedelta(days=1), DAY),
    ]
    return spark.createDataFrame(rows, LINK)


def test_resolve(spark):
    clicks = spark.createDataFrame([(1, "a"), (2, "c"), (3, "nonexistent"), (4, ""), (5, None), (6, "a")], "req_id long, short_id string")
    one = (307, "https://one.example")
    for rows_per_task in (1, 1_000_000):
        out = lookup.resolve(clicks, links(spark), rows_per_task=rows_per_task)
        got = {r.req_id: (r.status, r.location) for r in out.collect()}
        assert got == {1: one, 2: (410, None), 3: (404, None), 4: (400, None), 5: (400, None), 6: one}


def test_user_lists(spark):
    users = spark.createDataFrame([("u1",), ("u2",), ("u3",), ("",), ("u1",)], "user_id string")
    rows = lookup.user_urls(users, links(spark), "http://localhost:8080/").collect()
    got = sorted((r.user_id, r.status, r.pos, r.short_url and r.short_url[-1]) for r in rows if r.pos)
    assert got == [("u1", 200, 1, "e"), ("u1", 200, 2, "b"), ("u1", 200, 3, "a"), ("u2", 200, 1, "d")]
    assert sorted((r.user_id, r.status) for r in rows if not r.pos) == [("", 401), ("u3", 204)]
    counts = {r.user_id: (r.n_links, r.status) for r in lookup.user_has_links(users, links(spark)).collect()}
    assert counts["u1"] == (3, 200) and counts["u3"] == (0, 204)
    assert {r.short_id for r in lookup.by_user(links(spark), "u1").collect()} == {"a", "b", "e"}
    assert [r.link_id for r in lookup.scan_links(links(spark)).collect()] == [5, 2, 4, 3, 1]
    assert lookup.point_lookup(links(spark), "short_id", "c").count() == 1


def test_deletes_are_checked_against_the_owner(spark):
    asked = [
        (1, DAY, "u1", ["a", "http://localhost:8080/b?x=1", "http://localhost:8080/", "unknown"]),
        (2, DAY, "u1", ["a", "d"]),
        (3, DAY, "u3", ["e"]),
    ]
    requests = spark.createDataFrame(asked, "req_id long, ts timestamp_ntz, user_id string, ids array<string>")
    marks = deletes.clean_deletes(requests)
    assert sorted((r.req_id, r.pos, r.short_id) for r in marks.collect()) == [
        (1, 0, "a"), (1, 1, "b"), (1, 3, "unknown"), (2, 0, "a"), (2, 1, "d"), (3, 0, "e"),
    ]
    once = deletes.apply_deletes(links(spark), marks)
    flags = {r.short_id: r.is_deleted for r in once.collect()}
    assert flags == {"a": True, "b": True, "c": True, "d": False, "e": False}
    twice = deletes.apply_deletes(once, marks.orderBy(F.desc("req_id")))
    assert twice.exceptAll(once).isEmpty() and once.columns == links(spark).columns
    assert {r.short_id for r in deletes.delete_match(links(spark), marks).collect()} == {"a", "b"}
    buffer = [(r.user_id, r.seq, r.short_id) for r in deletes.group_deletes(marks).orderBy("user_id", "seq").collect()]
    assert buffer == [("u1", 1, "a"), ("u1", 2, "b"), ("u1", 3, "unknown"), ("u1", 4, "a"), ("u1", 5, "d"), ("u3", 1, "e")]


def test_constraints(spark):
    rows = [(1, "a", "o1", "u"), (2, "a", "o2", None), (3, "b", "o2", "u" * 256), (4, None, None, "u")]
    table = spark.createDataFrame(rows, "link_id long, short_id string, original_url string, user_id string")
    got = sorted(tuple(r) for r in checks.check_links(table, "link_id").collect())
    assert got == sorted([
        ("short_id unique", "a"), ("original_url unique", "o2"), ("user_id not null", "2"),
        ("short_id not null", "4"), ("original_url not null", "4"), ("user_id length", "3"),
    ])
    assert checks.check_links(links(spark), "link_id").isEmpty()


def test_blank_urls_are_refused(spark):
    cases = [
        ("json", "https://example.org/", "https://example.org/"), ("json", "   \n\t   ", None), ("json", "", None),
        ("json", " a ", " a "), ("text", " a　", "a"), ("text", "   \n\t   ", None), ("text", None, None),
    ]
    rows = spark.createDataFrame([(i, k, u) for i, (k, u, _) in enumerate(cases)], "i int, kind string, url string")
    got = responses.valid_shorten(rows).orderBy("i").collect()
    assert [(r.valid, r.original_url) for r in got] == [(want is not None, want) for _, _, want in cases]


def test_delete_request_status(spark):
    cases = [
        ('["a"]', "u", True, 202), ('["a"]', "u", False, 401), ('["a"]', "", True, 401), ("[]", "u", True, 400),
        ("null", "u", True, 400), ("{bad", "u", True, 400), ('["a",5]', "u", True, 400), (None, "u", True, 400), ("[]", "u", None, 401),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, body string, user_id string, valid boolean, want int")
    got = responses.valid_delete(rows).orderBy("i").collect()
    assert [r.status for r in got] == [r.want for r in got]
    assert [r.ids for r in got if r.ids is not None] == [["a"]]


def test_responses_and_audit(spark):
    rows = [(1, DAY, "u", "o1", "text", "abc", 201), (2, DAY, "u", "o1", "json", "abc", 409), (3, DAY, "u", "o2", "json", None, 500)]
    outcomes = spark.createDataFrame(rows, "req_id long, ts timestamp_ntz, user_id string, original_url string, kind string, short_id string, status int")
    got = [tuple(r) for r in responses.shorten_response(outcomes, "http://b").orderBy("req_id").collect()]
    assert got == [
        (1, 201, "text/plain", "http://b/abc"), (2, 409, "application/json", '{"result":"http://b/abc"}'), (3, 500, None, None),
    ]
    visits = spark.createDataFrame([(DAY, "v", 307, "o1"), (DAY, "v", 404, None)], "ts timestamp_ntz, user_id string, status int, location string")
    events = sorted(tuple(r) for r in responses.audit_projection(outcomes, visits).collect())
    assert events == [(1704067200, "follow", "v", "o1"), (1704067200, "shorten", "u", "o1")]


def test_routes(spark):
    cases = [
        ("POST", "/", "shorten_text", None), ("POST", "/api/shorten", "shorten_json", None), ("POST", "/api/shorten/batch", "shorten_batch", None),
        ("GET", "/api/user/urls", "list", None), ("DELETE", "/api/user/urls", "delete", None), ("GET", "/ping", "ping", None),
        ("GET", "/abc", "follow", None), ("POST", "/some/path", None, 404), ("GET", "/some/nested/path", None, 404), ("GET", "/", None, 405),
        ("POST", "/abc", None, 405), ("DELETE", "/ping", None, 405), ("GET", "/abc/", None, 404),
    ] + [(verb, "/api/shorten", None, 405) for verb in ("GET", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")]
    rows = spark.createDataFrame([(i, m, p) for i, (m, p, _, _) in enumerate(cases)], "i int, method string, path string")
    got = [(r.method, r.path, r.route, r.status) for r in route_class(rows).orderBy("i").collect()]
    assert got == cases
