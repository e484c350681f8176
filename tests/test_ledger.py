import pytest
from pyspark.sql import functions as F

from linkweave.sources import ledger


def append(book, rows, number):
    return book.append(rows, [F.col("at"), F.col("k")], number)


def load(spark, keys):
    return spark.createDataFrame([(k, f"t{k % 4}") for k in keys], "k long, at string").repartition(3)


def numbers(book):
    return [(r.link_id, r.load, r.k) for r in sorted(book.read("k long, at string").collect(), key=lambda r: r.link_id)]


def sequential(loads):
    rows = [(n, k) for n, keys in enumerate(loads) for k in sorted(keys, key=lambda k: (f"t{k % 4}", k))]
    return [(i + 1, n, k) for i, (n, k) in enumerate(rows)]


def test_loads_continue_each_other_and_a_repeated_one_keeps_its_ids(spark, tmp_path):
    loads = [range(10 * n, 10 * n + size) for n, size in enumerate((7, 1, 0, 9, 4))]
    book = ledger.IdLedger(spark, str(tmp_path))
    assert book.high_water() == 0
    for n, keys in enumerate(loads):
        first, last = append(book, load(spark, keys), n)
        assert last - first + 1 == len(keys) and book.high_water() == last
        assert append(ledger.IdLedger(spark, str(tmp_path)), load(spark, reversed(keys)), n) == (first, last)
    assert append(book, load(spark, loads[1]), 1) == (8, 8)
    assert numbers(book) == sequential(loads)


def test_other_rows_and_gaps_are_refused(spark, tmp_path):
    book = ledger.IdLedger(spark, str(tmp_path))
    with pytest.raises(ValueError, match="the next is 0"):
        append(book, load(spark, [1]), 1)
    append(book, load(spark, [1, 2]), 0)
    for keys in ([1], [1, 3], [1, 2, 2]):
        with pytest.raises(ValueError, match="other rows"):
            append(book, load(spark, keys), 0)
    assert numbers(book) == sequential([[1, 2]])


def test_a_crash_before_the_mark_leaves_the_next_id_where_it_was(spark, tmp_path, monkeypatch):
    book = ledger.IdLedger(spark, str(tmp_path))
    append(book, load(spark, range(3)), 0)

    def crash(*_):
        raise OSError("down")

    with monkeypatch.context() as patch:
        patch.setattr(ledger, "put_new", crash)
        with pytest.raises(OSError):
            append(book, load(spark, range(10, 20)), 1)
    assert book.high_water() == 3 and numbers(book) == sequential([range(3)])
    # the next try may hold other rows: nobody has seen the first ones
    assert append(book, load(spark, range(10, 14)), 1) == (4, 7)
    assert numbers(book) == sequential([range(3), range(10, 14)])


def test_an_empty_ledger_reads_as_an_empty_table(spark, tmp_path):
    book = ledger.IdLedger(spark, str(tmp_path))
    append(book, load(spark, []), 0)
    assert numbers(book) == [] and book.high_water() == 0
