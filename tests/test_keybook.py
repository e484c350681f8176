"""Unique constraints checked load by load: the same rows as a check of the whole table, few rows read."""

import random

import pytest
from pyspark.sql import functions as F

from linkweave.operators.checks import check_unique
from linkweave.sources import keybook
from linkweave.sources.keybook import KeyBook, check_load
from test_versions import scanned


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "k string").repartition(3)


def found(frame):
    return sorted(tuple(r) for r in frame.select("constraint", "key", "n").collect())


def whole_check(spark, loads, last):
    """A check of all loads up to ``last``, for the keys that the last one has."""
    own = set(loads[last])
    rows = check_unique(keys(spark, [k for load in loads[: last + 1] for k in load]), "k")
    return sorted(tuple(r) for r in rows.collect() if r.key in own)


@pytest.mark.parametrize("size", [10, 300, 9000])
def test_violations_are_those_of_the_whole_table(spark, tmp_path, size):
    draw = random.Random(size)
    loads = [[f"k{draw.randrange(4 * size)}" for _ in range(size)] + ["hot"] * (size // 3) + [None, "", "é\n"] for _ in range(4)]
    loads.insert(2, [])
    book = KeyBook(spark, str(tmp_path), "k")
    for n, load in enumerate(loads):
        book.add(keys(spark, load), n)
        assert found(book.violations(n)) == whole_check(spark, loads, n)
        if n == 3:
            book.merge()
            book.merge()
            assert found(book.violations(n)) == whole_check(spark, loads, n)
    with pytest.raises(ValueError, match="have been merged"):
        book.violations(1)


def test_only_possible_hits_are_read(spark, tmp_path):
    rows = 200_000
    book = KeyBook(spark, str(tmp_path), "k", page_rows=100)
    for load in range(2):
        book.add(spark.range(load * rows, (load + 1) * rows).selectExpr("concat('k', id) as k"), load)
    coming = spark.range(5 * rows, 5 * rows + 10_000).selectExpr("concat('k', id) as k")
    book.add(coming.unionByName(keys(spark, ["k17", f"k{rows + 5}"])), 2)
    # a key that is not there seems to be in one filter of 400
    assert 2 <= book.possible(2).count() < 10_002 * 2 / 100
    assert found(book.violations(2)) == [("k unique", "k17", 2), ("k unique", f"k{rows + 5}", 2)]
    # the stored keys and the staged hits that the exact look-up reads, of 400,000
    assert scanned(book.earlier(2)) < 0.06 * 2 * rows


def test_a_segment_without_a_possible_hit_is_not_opened(spark, tmp_path, monkeypatch):
    book = KeyBook(spark, str(tmp_path), "k")
    for load, values in enumerate((["a", "b"], ["c"], ["d"], ["c", "x"])):
        book.add(keys(spark, values), load)
    opened = []
    read = book._read
    monkeypatch.setattr(book, "_read", lambda kind, schema, segments: opened.append((kind, len(segments))) or read(kind, schema, segments))
    assert found(book.violations(3)) == [("k unique", "c", 2)]
    assert opened.count(("counts", 1)) == 3 and ("counts", 3) not in opened  # the load's own keys twice, and load 1


def test_many_hits_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keybook, "FEW_HITS", 5)
    book = KeyBook(spark, str(tmp_path), "k")
    loads = [[f"k{i}" for i in range(100)], [f"k{i}" for i in range(0, 200, 2)]]
    for n, load in enumerate(loads):
        book.add(keys(spark, load), n)
    assert found(book.violations(1)) == whole_check(spark, loads, 1) and book.violations(1).count() == 50


def test_repeated_loads_gaps_and_crashes(spark, tmp_path, monkeypatch):
    book = KeyBook(spark, str(tmp_path / "book"), "k")
    with pytest.raises(ValueError, match="the next is 0"):
        book.add(keys(spark, ["a"]), 1)
    book.add(keys(spark, ["a", "b", "b"]), 0)
    for other in (["a", "b"], ["a", "b", "c"]):
        with pytest.raises(ValueError, match="other keys"):
            book.add(keys(spark, other), 0)
    with monkeypatch.context() as patch:
        patch.setattr(keybook, "put_new", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            book.add(keys(spark, ["a"]), 1)
    for _ in range(2):  # a micro-batch that runs again
        out = check_load(KeyBook(spark, str(tmp_path / "book"), "k"), keys(spark, ["b", "c"]), 1, str(tmp_path / "out"))
        assert found(out) == [("k unique", "b", 3)]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_rows_of_another_column_type(spark, tmp_path):
    book = KeyBook(spark, str(tmp_path), "k")
    for load in range(2):
        book.add(spark.range(3).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("n"), F.lit(2).alias("code"), F.lit("x").alias("key")), load)
    assert [n for *_, n in found(book.violations(1))] == [2, 2, 2]
