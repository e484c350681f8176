import datetime as dt
import random

import pytest
from test_functions import expected_id

from linkweave.operators import batches
from linkweave.plans.replay import replay, replay_batches

LOG = "req_id long, ts timestamp_ntz, user_id string, kind string, url string, short_id string, ids array<string>"
DAY = dt.datetime(2024, 1, 1)


def make_log(n, seed):
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        kind = pick.choice(["text", "json", "follow", "list", "delete", "delete"])
        user = "hot" if pick.random() < 0.5 else f"u{pick.randrange(4)}"
        url = " " if pick.random() < 0.05 else f"https://x.example/{pick.randrange(15)}"
        ids = [expected_id(f"https://x.example/{pick.randrange(15)}", 0) for _ in range(pick.randrange(4))]
        short = "" if pick.random() < 0.05 else expected_id(url, 0)
        rows.append((i, DAY + dt.timedelta(seconds=pick.randrange(n)), user, kind, url, short, ids))
    return rows


def sequential(rows):
    links, out = {}, {}
    for req_id, _, user, kind, url, short, ids in sorted(rows, key=lambda r: (r[1], r[0])):
        if kind in ("text", "json"):
            if not url.strip():
                status = 400
            elif expected_id(url, 0) in links:
                status = 409
            else:
                status, links[expected_id(url, 0)] = 201, [user, False]
            out[req_id] = ("POST", "/" if kind == "text" else "/api/shorten", status)
        elif kind == "follow":
            status = 400 if not short else 404 if short not in links else 410 if links[short][1] else 307
            out[req_id] = ("GET", "/" + short, status)
        elif kind == "list":
            live = any(owner == user and not gone for owner, gone in links.values())
            out[req_id] = ("GET", "/api/user/urls", 200 if live else 204)
        else:
            for short_id in ids:
                if short_id in links and links[short_id][0] == user:
                    links[short_id][1] = True
            out[req_id] = ("DELETE", "/api/user/urls", 202 if ids else 400)
    return out


@pytest.mark.parametrize(("seed", "rows_per_task"), [(1, 1_000_000), (2, 5)])
def test_replay_equals_a_sequential_pass(spark, seed, rows_per_task):
    rows = make_log(300, seed)
    got = replay(spark.createDataFrame(rows, LOG), rows_per_task)
    assert {r.req_id: (r.method, r.uri, r.status) for r in got.collect()} == sequential(rows)


MIXED = LOG + ", items array<struct<correlation_id: string, original_url: string>>"


def make_mixed_log(n, seed):
    pick = random.Random(seed)
    rows = []
    for row in make_log(n, seed):
        items = None
        if pick.random() < 0.4:
            row = (*row[:3], "batch", *row[4:])
            size = pick.choice([0, 1, 1, 2, 3])
            items = [(f"c{i}" if pick.random() < 0.97 else " ", f"https://x.example/{pick.randrange(40)}") for i in range(size)]
            items = None if size == 0 and pick.random() < 0.5 else items
        rows.append((*row, items))
    return rows + [r for r in rows if r[3] in ("batch", "text")][:3]  # copies of requests


def mixed_pass(rows):
    """Every request once, in order; the outcomes of the other routes are those of ``sequential`` over the links made so far."""
    taken, links, out = set(), {}, {}
    for req_id, _, user, kind, url, short, ids, items in sorted(set((*r[:6], tuple(r[6]), tuple(r[7] or ())) for r in rows), key=lambda r: (r[1], r[0])):
        if kind == "batch":
            urls = [u for _, u in items or ()]
            if not urls or any(not c.strip() or not u.strip() for c, u in items):
                status = 400
            elif len(set(urls)) < len(urls) or taken & set(urls):
                status = 500
            else:
                status = 201
                taken |= set(urls)
                links.update({expected_id(u, 0): [user, False] for u in urls})
            out[req_id] = ("POST", "/api/shorten/batch", status)
        elif kind in ("text", "json"):
            status = 400 if not url.strip() else 409 if url in taken else 201
            if status == 201:
                taken.add(url)
                links[expected_id(url, 0)] = [user, False]
            out[req_id] = ("POST", "/" if kind == "text" else "/api/shorten", status)
        elif kind == "follow":
            out[req_id] = ("GET", "/" + short, 400 if not short else 404 if short not in links else 410 if links[short][1] else 307)
        elif kind == "list":
            out[req_id] = ("GET", "/api/user/urls", 200 if any(o == user and not gone for o, gone in links.values()) else 204)
        else:
            for i in ids:
                if i in links and links[i][0] == user:
                    links[i][1] = True
            out[req_id] = ("DELETE", "/api/user/urls", 202 if ids else 400)
    return out


@pytest.mark.parametrize(("seed", "rows_per_task"), [(3, 1_000_000), (4, 5)])
def test_batches_and_single_requests_equal_a_sequential_pass(spark, seed, rows_per_task):
    rows = make_mixed_log(260, seed)
    got = replay_batches(spark.createDataFrame(rows, MIXED), rows_per_task).collect()
    assert len(got) == len(rows)
    assert {r.req_id: (r.method, r.uri, r.status) for r in got} == mixed_pass(rows)


def test_a_chain_of_batches_with_a_single_request_in_its_middle(spark, monkeypatch):
    """Each batch shares a URL with the next. The single request takes a URL from the batch after it, so parity starts anew there."""
    rounds = []
    inner = batches._round
    monkeypatch.setattr(batches, "_round", lambda *a: rounds.append(1) or inner(*a))
    log = spark.range(5000).selectExpr(
        "id * 2 as req_id", "timestamp_ntz'2024-01-01' as ts", "'u' as user_id", "'batch' as kind", "null as url", "null as short_id",
        "cast(null as array<string>) as ids", "transform(sequence(id, id + 1), x -> struct('c' as correlation_id, concat('u', x) as original_url)) as items",
    )
    single = spark.createDataFrame([(3999, DAY, "v", "json", "u2001", None, None, None)], MIXED)
    got = {r.req_id: r.status for r in replay_batches(log.unionByName(single)).collect()}
    assert got.pop(3999) == 201
    # batch 1999 is refused as 1998 was saved, 2000 holds u2001 and is refused; 2001 holds it too
    wanted = {2 * i: 201 if (i < 2000 and i % 2 == 0) or (i > 2001 and i % 2 == 0) else 500 for i in range(5000)}
    assert got == wanted and len(rounds) < 20


def test_ids_that_run_out_fail_the_whole_batch(spark):
    rows = [(1, DAY, "u", "json", "a", None, None, None), (2, DAY, "u", "batch", None, None, None, [("c", "b"), ("d", "e")]), (3, DAY, "u", "json", "e", None, None, None)]
    got = {r.req_id: r.status for r in replay_batches(spark.createDataFrame(rows, MIXED), charset="x", length=1).collect()}
    assert got == {1: 201, 2: 500, 3: 500}


def test_replay_of_an_empty_log(spark):
    assert replay_batches(spark.createDataFrame([], MIXED)).collect() == []
