import datetime as dt
import json

from pyspark.sql import functions as F
from test_functions import KEY, expected_id

from linkweave.functions.tokens import sign_token, verify_token
from linkweave.plans import service
from linkweave.sources.stores import ParquetStore

DAY = dt.datetime(2024, 1, 1)
BASE = "http://localhost:8080"
REQUEST = "req_id long, ts timestamp_ntz, token string, kind string, body string"


def token(spark, user):
    return spark.range(1).select(sign_token(F.lit(user), KEY)).first()[0]


def test_the_routes_work_together(spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path))
    alice, bob = token(spark, "alice"), token(spark, "bob")
    one, two = "https://one.example", "https://two.example"
    rows = [
        (1, DAY, alice, "text", f"  {one}\n"), (2, DAY, bob, "json", json.dumps({"url": one})), (3, DAY, bob, "json", json.dumps({"url": two})),
        (4, DAY, None, "text", " \t"), (5, DAY, "bad.token", "json", '{"url":5}'), (6, DAY, None, "text", "https://three.example"),
    ]
    requests = spark.createDataFrame(rows, REQUEST)
    for _ in range(2):  # the same load again gives the same answers and the same table
        answers = service.shorten_job(requests, store, 0, BASE, KEY)
        got = {r.req_id: r for r in answers.responses.collect()}
        assert {i: r.status for i, r in got.items()} == {1: 201, 2: 409, 3: 201, 4: 400, 5: 400, 6: 201}
        assert got[1].body == f"{BASE}/{expected_id(one, 0)}"
        assert json.loads(got[2].body) == {"result": got[1].body}
        assert [got[i].new_token is None for i in range(1, 7)] == [True, True, True, False, False, False]
        assert sorted(r.url for r in answers.audit.collect()) == [one, "https://three.example", two]
        assert store.read().count() == 3
    third = got[6].new_token
    assert spark.range(1).select(verify_token(F.lit(third), KEY)["valid"]).first()[0]

    batch = [
        (10, DAY, alice, None, json.dumps([{"correlation_id": "1", "original_url": "https://b1.example"}, {"correlation_id": "2", "original_url": "https://b2.example"}])),
        (11, DAY, bob, None, json.dumps([{"correlation_id": "1", "original_url": one}])),
        (12, DAY, bob, None, json.dumps([{"correlation_id": " ", "original_url": "https://b3.example"}])),
        (13, DAY, bob, None, "[]"), (14, DAY, bob, None, "{"),
    ]
    answers = service.batch_job(spark.createDataFrame(batch, REQUEST), store, 1, BASE, KEY)
    got = sorted((r.req_id, r.status, r.pos, r.short_url) for r in answers.responses.collect() if r.pos is not None)
    assert got == [(10, 201, 0, f"{BASE}/{expected_id('https://b1.example', 0)}"), (10, 201, 1, f"{BASE}/{expected_id('https://b2.example', 0)}")]
    assert sorted((r.req_id, r.status) for r in answers.responses.collect() if r.pos is None) == [(11, 500), (12, 400), (13, 400), (14, 400)]

    removals = [
        (20, DAY, alice, None, json.dumps([expected_id(one, 0), f"{BASE}/{expected_id(two, 0)}"])),
        (21, DAY, bob, None, "[]"), (22, DAY, None, None, json.dumps(["x"])),
    ]
    answers = service.delete_job(spark.createDataFrame(removals, REQUEST), store, 2, KEY)
    assert {r.req_id: r.status for r in answers.responses.collect()} == {20: 202, 21: 400, 22: 202}

    visits = [(30, DAY, bob, expected_id(one, 0)), (31, DAY, bob, expected_id(two, 0)), (32, DAY, bob, "nonexistent"), (33, DAY, bob, "")]
    answers = service.follow_job(spark.createDataFrame(visits, "req_id long, ts timestamp_ntz, token string, short_id string"), store, KEY)
    assert {r.req_id: (r.status, r.location) for r in answers.responses.collect()} == {30: (410, None), 31: (307, two), 32: (404, None), 33: (400, None)}
    assert [(r.action, r.user_id, r.url) for r in answers.audit.collect()] == [("follow", "bob", two)]

    asks = [(40, DAY, alice), (41, DAY, bob), (42, DAY, bob), (43, DAY, token(spark, "carol"))]
    answers = service.list_job(spark.createDataFrame(asks, "req_id long, ts timestamp_ntz, token string"), store, BASE, KEY)
    assert {r.req_id: r.status for r in answers.responses.collect()} == {40: 200, 41: 200, 42: 200, 43: 204}
    lists = sorted((r.user_id, r.original_url) for r in answers.lists.collect())
    assert lists == [("alice", "https://b1.example"), ("alice", "https://b2.example"), ("bob", two)]
