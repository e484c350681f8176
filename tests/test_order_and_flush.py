import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from linkweave.operators import flush, ranking

ROW = "id int, g string, v int"


def rows_with_hot_group(n=400):
    pick = random.Random(2)
    rows = [(i, None if pick.random() < 0.1 else "hot" if pick.random() < 0.5 else f"g{pick.randrange(8)}", pick.randint(-3, 3)) for i in range(n)]
    pick.shuffle(rows)
    return rows


def test_numbers_over_several_pieces(spark):
    rows = rows_with_hot_group()
    frame = spark.createDataFrame(rows, ROW)
    placed = ranking.lay_out(frame, ["g"], [F.col("id")])
    assert placed.where("g = 'hot'").select(ranking.PIECE).distinct().count() > 1
    seen, want = {}, {}
    for i, g, _ in sorted(rows):
        seen[g] = seen.get(g, 0) + 1
        want[i] = seen[g]
    got = ranking.number_rows(frame, [F.col("id")], "n", ["g"])
    assert {r.id: r.n for r in got.collect()} == want
    whole = ranking.number_rows(frame, [F.desc("id")], "n")
    assert {r.id: r.n for r in whole.collect()} == {i: len(rows) - i for i, _, _ in rows}


def test_running_total_over_several_pieces(spark):
    rows = rows_with_hot_group()
    total, want = {}, {}
    for i, g, v in sorted(rows):
        total[g] = total.get(g, 0) + v
        want[i] = total[g]
    got = ranking.running_total(spark.createDataFrame(rows, ROW), "v", [F.col("id")], "t", ["g"])
    assert {r.id: r.t for r in got.collect()} == want


def sequential(tasks, threshold):
    level, number, out = {}, {}, {}
    for req_id, _, user, size in sorted(tasks, key=lambda t: (t[1], t[0])):
        out[req_id] = number.setdefault(user, 0)
        level[user] = level.get(user, 0) + size
        if level[user] >= threshold:
            level[user] = 0
            number[user] += 1
    return out


TASK = "req_id long, ts timestamp_ntz, user_id string, n_ids int"
DAY = dt.datetime(2024, 1, 1)


def test_flush_after_the_task_that_fills_the_buffer(spark):
    sizes = [40, 70, 10, 95, 100, 3]
    tasks = [(i, DAY, "u", s) for i, s in enumerate(sizes)]
    got = flush.delete_batches(spark.createDataFrame(tasks, TASK))
    assert [r.batch_no for r in got.orderBy("req_id").collect()] == [0, 0, 1, 1, 2, 3]


@pytest.mark.parametrize("threshold", [1, 7, 100])
def test_flush_of_a_hot_user(spark, threshold):
    pick = random.Random(threshold)
    tasks = [
        (i, DAY + dt.timedelta(seconds=pick.randrange(200)), "hot" if pick.random() < 0.6 else f"u{pick.randrange(5)}", pick.choice([0, 1, 1, 2, 30, 120]))
        for i in range(500)
    ]
    got = flush.delete_batches(spark.createDataFrame(tasks, TASK), threshold)
    assert {r.req_id: r.batch_no for r in got.collect()} == sequential(tasks, threshold)


def test_even_batches_and_windows(spark):
    buffer = spark.createDataFrame([(i,) for i in range(1, 12)], "seq long")
    assert [r.batch_no for r in flush.even_batches(buffer, 5).orderBy("seq").collect()] == [0] * 5 + [1] * 5 + [2]
    rows = [(1, DAY, "u", "a"), (2, DAY + dt.timedelta(milliseconds=9), "u", "b"), (3, DAY + dt.timedelta(milliseconds=10), "u", "a")]
    deletes = spark.createDataFrame(rows, "req_id long, ts timestamp_ntz, user_id string, short_id string")
    got = flush.tumbling_deletes(deletes, "10 milliseconds").orderBy("window_start").collect()
    assert [(r.n_ids, r.first_req, r.last_req) for r in got] == [(2, 1, 2), (1, 3, 3)]
    labels = flush.flush_window(deletes, "10 milliseconds")
    assert labels.select("window_start").distinct().count() == 2 and labels.count() == 3
