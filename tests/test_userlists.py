"""Counts and lists by user, load by load: equal to recomputation, only touched pages rewritten."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from linkweave.operators import lookup
from linkweave.sources import userlists
from linkweave.sources.stores import ParquetStore
from linkweave.sources.userlists import UserLists
from test_versions import DAY, LINK, marks


def day(n):
    return DAY + dt.timedelta(days=n)


def made(spark, rows):
    return spark.createDataFrame([(i, f"o{i}", user, False, at, at) for i, user, at in rows], LINK)


def listed(view, users=None):
    return sorted((r.user_id, r.pos, r.short_id) for r in view.lists(users).collect())


def recomputed(store):
    rows = lookup.order_by_created(store.read().where("user_id is not null"))
    return sorted((r.user_id, r.pos, r.short_id) for r in rows.collect())


def test_ten_loads_are_equal_to_recomputation(spark, tmp_path):
    draw = random.Random(3)
    store = ParquetStore(spark, str(tmp_path / "store"))
    view = UserLists(spark, str(tmp_path / "view"))
    known, number = [], 0
    for load in range(10):
        rows = []
        for _ in range(draw.randrange(0, 12)):
            number += 1
            user = draw.choice(["hot", "hot", "u1", "u2", None])
            rows.append((f"s{number}", user, draw.choice([None, day(draw.randrange(4)), day(2)])))
        known += rows
        gone = [(i, draw.choice([u or "x", "u1"]), day(3)) for i, u, _ in draw.sample(known, min(4, len(known)))]
        gone.append((f"s{number + 3}", "hot", day(9)))  # before its link, if there is ever one
        links = made(spark, rows)
        deletes = spark.createDataFrame(gone, "short_id string, user_id string, ts timestamp_ntz")
        store.append(links, load)
        store.tombstone(deletes, load)
        for _ in range(2 if load in (0, 5) else 1):
            view.update(store, links, deletes, load)
    assert listed(view) == recomputed(store)
    counts = {r.user_id: r.n_links for r in view.counts().collect()}
    want = {r.user_id: r.n_links for r in lookup.user_has_links(store.read().where("user_id is not null"), store.read()).collect()}
    assert counts == want
    some = spark.createDataFrame([("u2",), ("u2",), ("nobody",), (None,)], "user_id string")
    assert listed(view, some) == [r for r in recomputed(store) if r[0] == "u2"]
    assert [r.user_id for r in view.counts(some).collect()] == ["u2"]


def test_a_load_rewrites_the_pages_it_touches(spark, tmp_path):
    store, view = ParquetStore(spark, str(tmp_path / "store")), UserLists(spark, str(tmp_path / "view"))
    first = made(spark, [(f"s{n}", "hot" if n < 300 else f"u{n}", day(n % 30)) for n in range(400)])
    none = marks(spark)
    store.append(first, 0)
    view.update(store, first, none, 0)
    second = made(spark, [("new", "hot", day(40))])
    deletes = marks(spark, ("s7", "hot"), ("s8", "u1"), ("s399", "u399"), at=day(50))  # s8 is not u1's
    store.append(second, 1)
    store.tombstone(deletes, 1)
    view.update(store, second, deletes, 1)
    written = spark.read.parquet(str(tmp_path / "view/lists/load=1"))
    # ids that a delete names are looked at, whoever asked: the pages of s7, s8 and the new link, each of ten links at most
    assert {(r.user_id, r.page) for r in written.collect()} == {("hot", day(7)), ("hot", day(8)), ("hot", day(40))}
    assert written.count() == 9 + 10 + 1
    assert listed(view) == recomputed(store)
    hot = [i for u, _, i in listed(view) if u == "hot"]
    assert hot[0] == "new" and "s7" not in hot and "s8" in hot
    # the last link went: a count of none, and no row in any list
    assert {r.user_id: r.n_links for r in view.counts().collect()}["u399"] == 0


def test_other_units_repeats_and_gaps(spark, tmp_path, monkeypatch):
    store, view = ParquetStore(spark, str(tmp_path / "store")), UserLists(spark, str(tmp_path / "view"), page="year")
    assert listed(view) == [] and view.counts().collect() == []
    links = made(spark, [("a", "u", day(0)), ("b", "u", day(0)), ("c", "u", None), ("d", "u", day(400))])
    store.append(links, 0)
    with pytest.raises(ValueError, match="the next is 0"):
        view.update(store, links, marks(spark), 1)
    with monkeypatch.context() as patch:
        patch.setattr(userlists, "put_new", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            view.update(store, links, marks(spark), 0)
    assert listed(view) == []
    view.update(store, links.unionByName(links), marks(spark), 0)
    view.update(store, links.where(F.lit(False)), marks(spark), 1)
    assert listed(view) == [("u", 1, "d"), ("u", 2, "a"), ("u", 3, "b"), ("u", 4, "c")]
