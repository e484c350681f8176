import random

import pytest

from linkweave.operators import batches

ITEM = "batch_id long, pos int, correlation_id string, original_url string"
LINK = "short_id string, original_url string"


def sequential(items, stored=()):
    taken, verdicts, by_batch = set(stored), {}, {}
    for batch_id, _, _, url in items:
        by_batch.setdefault(batch_id, []).append(url)
    for batch_id, urls in sorted(by_batch.items()):
        verdicts[batch_id] = len(set(urls)) == len(urls) and taken.isdisjoint(urls)
        if verdicts[batch_id]:
            taken.update(urls)
    return verdicts


def random_items(seed, n_batches, n_urls, hot=0.0):
    pick = random.Random(seed)
    return [
        (b, pos, f"c{pos}", "hot" if pick.random() < hot else f"u{pick.randrange(n_urls)}")
        for b in range(n_batches)
        for pos in range(pick.randint(1, 4))
    ]


@pytest.mark.parametrize("options,seed,urls", [({}, 3, 90), ({"rows_per_task": 5}, 3, 90), ({}, 11, 25), ({}, 12, 200)])
def test_decisions_equal_a_sequential_pass(spark, options, seed, urls):
    items = random_items(seed, 60, urls, hot=0.15)
    links = spark.createDataFrame([("s", "u1"), ("t", "u2")], LINK)
    got = batches.decide_batches(spark.createDataFrame(items, ITEM), links, **options)
    assert {r.batch_id: r.accepted for r in got.collect()} == sequential(items, {"u1", "u2"})


def test_long_chain_of_batches(spark, monkeypatch):
    """Each batch shares a URL with the next: every second one is accepted, in rounds that grow with the logarithm."""
    rounds = []
    inner = batches._round
    monkeypatch.setattr(batches, "_round", lambda *a: rounds.append(1) or inner(*a))
    chain = spark.range(5000).selectExpr("id as batch_id", "explode(array('u' || id, 'u' || (id + 1))) as original_url")
    odd = spark.createDataFrame([(10_000, "u0"), (10_000, "x"), (10_001, "x"), (10_002, "x"), (10_002, "y"), (10_003, "y")], "batch_id long, original_url string")
    got = {r.batch_id: r.accepted for r in batches.decide_batches(chain.union(odd)).collect()}
    wanted = {b: b % 2 == 0 for b in range(5000)} | {10_000: False, 10_001: True, 10_002: False, 10_003: True}
    assert got == wanted and len(rounds) < 30


def test_one_blank_row_refuses_the_batch(spark):
    items = [(1, 0, "1", "https://one.example"), (1, 1, "2", "https://two.example"), (2, 0, "1", "a"), (2, 1, " \t", "b"), (3, 0, "1", "　"), (4, 0, None, "a")]
    frame = spark.createDataFrame(items, ITEM)
    assert {r.batch_id: r.status for r in batches.valid_batch(frame).collect()} == {1: 201, 2: 400, 3: 400, 4: 400}
    asked = spark.createDataFrame([(1,), (9,)], "batch_id long")
    assert [tuple(r) for r in batches.empty_batches(asked, frame).collect()] == [(9, 400)]
    assert {r.batch_id for r in batches.accepted_items(frame, rows_per_task=1).collect()} == {1}


def test_save_unique(spark):
    items = random_items(5, 30, 40) + [(99, 0, "1", " ")]
    got = batches.batch_save_unique(spark.createDataFrame(items, ITEM), rows_per_task=6).collect()
    verdicts = sequential([i for i in items if i[3].strip()])
    assert len(got) == len(items)
    for row in got:
        status = 400 if row.batch_id == 99 else 201 if verdicts[row.batch_id] else 500
        assert row.status == status and (row.short_id is not None) == (status == 201)
    given = [r.short_id for r in got if r.short_id]
    assert len(given) == len(set(given))


def test_save_append_and_id_collisions(spark):
    items = random_items(7, 20, 5)
    got = batches.batch_save(spark.createDataFrame(items, ITEM)).collect()
    assert len(got) == len(items) and len({r.short_id for r in got}) == len(items)
    clashes = batches.batch_unique_ids(spark.createDataFrame(items, ITEM), charset="ab", length=1)
    assert clashes.where("n < 2").isEmpty() and not clashes.isEmpty()
