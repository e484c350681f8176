"""Ranked lexical search against a plain pass."""

import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from linkweave.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(docs, items):
    """Rows of (item_id, rank, doc_id, score) by the contract's formula."""
    asked = collections.defaultdict(collections.Counter)
    for item, text in set(items):
        asked[item].update(terms(text))
    counted = [(d, collections.Counter(terms(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in counted]
    n_docs, n_terms = sum(1 for n in sizes if n), sum(sizes)
    df = collections.Counter(t for _, c in counted for t in c)
    out = set()
    for item, query in asked.items():
        scored = []
        for (doc, c), n in zip(counted, sizes):
            score = 0
            for t, times in query.items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * w * ((1000000000 * c[t]) // (1000 * c[t] + 12 * (75 + (25 * n * n_docs) // n_terms)))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out |= {(item, i, row[3], -row[0]) for i, row in enumerate(sorted(scored)[:20], 1)}
    return out


def found(docs, items):
    rows = lexical.search(docs, items).collect()
    assert len({(r.item_id, r["rank"]) for r in rows}) == len(rows)
    return {(r.item_id, r["rank"], r.doc_id, r.score) for r in rows}


@pytest.mark.parametrize("limits", [{}, {"BLOCK_PAIRS": 90, "CELLS": 300}, {"BLOCK_TERMS": 60}])
def test_ranks_and_scores(spark, small, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(lexical, name, value)
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = plain([(r.doc_id, r.text) for r in small.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert found(small, items) == want and len(want) > 100


def test_blocks_are_bounded_and_whole(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_PAIRS", 4)
    items = spark.createDataFrame([(i, " ".join(f"t{i}x{j}" for j in range(n))) for i, n in enumerate((2, 2, 7, 1, 3, 1))], "item_id long, text string")
    made = list(lexical.blocks(lexical.item_terms(items)))
    assert [{i for i, _, _ in b} for b in made] == [{0, 1}, {2}, {3, 4}, {5}]
    assert sum(map(len, made)) == 16


def test_odd_rows(spark, odd, nothing):
    rows = [(1, "own3 OWN3 own4."), (1, "own3 OWN3 own4."), (1, "x"), (2, None), (3, ""), (None, "one"), (4, "nowhere at all"), (5, "ß 東京 É É"), (6, "own")]
    items = spark.createDataFrame(rows, "item_id long, text string").withColumn("doc_id", F.lit(7)).withColumn("term", F.lit("clash"))
    want = plain([(r.doc_id, r.text) for r in odd.collect()], rows)
    assert found(odd, items) == want
    assert {r[0] for r in want} == {None, 1, 5} and any(r[2] is None for r in want)
    assert found(nothing, items) == set() and found(odd, items.limit(0)) == set()


def test_more_than_twenty_equal_documents(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(50, 0, -1)] + [(99, "else")], "doc_id long, text string").repartition(7)
    items = spark.createDataFrame([(1, "same"), (2, "else same")], "item_id long, text string")
    got = found(docs, items)
    assert [r[2] for r in sorted(got) if r[0] == 1] == list(range(1, 21))
    assert [r[2] for r in sorted(got) if r[0] == 2] == [99, *range(1, 20)]
