"""Ranked lexical search: an Aho-Corasick automaton of all item terms counts them in the text itself; there is no document index."""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkweave.llm.common import session, stage

# Terms are runs of ASCII letters and digits and of all other characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOP = 20
# Items are searched in blocks of at most so many distinct terms and (item, term) pairs, which bounds what is
# sent to a worker; a single item with more is a block of its own. Each block scans all documents.
BLOCK_TERMS, BLOCK_PAIRS = 200_000, 2_000_000
# Entries of a worker's score table and additions to it in one step.
CELLS = 2_000_000
# The best documents of an item are merged in so many groups first, then in one of at most SALTS * TOP rows.
SALTS = 64

# Bytes to bytes: A-Z to a-z, all that separates terms to a space. UTF-8 bytes from 0x80 on belong to terms.
GUARDED = bytes(
    ord(LOWER[UPPER.index(chr(b))]) if chr(b) in UPPER else b if b >= 0x80 or chr(b) in LOWER or chr(b) in "0123456789" else 0x20 for b in range(256)
)
_automaton: tuple[object, ahocorasick.Automaton] | None = None


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term, repeats``, and a null term for items without any. Rows of one id are one item of all their different texts."""
    low = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), low.alias("low"), F.col("text").cast("string").alias("text")).distinct()
    terms = rows.select("item_id", F.explode(F.regexp_extract_all("low", F.lit(TERM), F.lit(0))).alias("term"))
    return terms.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("repeats"))


def blocks(pairs: DataFrame) -> Iterator[list[tuple[int | None, str, int]]]:
    """The items' terms, whole items together, streamed to the driver in blocks of a bounded size."""
    block: list[tuple[int | None, str, int]] = []
    terms: set[str] = set()
    item: list[tuple[int | None, str, int]] = []

    def full() -> bool:
        return bool(block) and (len(block) + len(item) > BLOCK_PAIRS or len(terms | {t for _, t, _ in item}) > BLOCK_TERMS)

    for row in pairs.orderBy("item_id", "term").toLocalIterator():
        if item and item[0][0] != row.item_id:
            if full():
                yield block
                block, terms = [], set()
            block += item
            terms |= {t for _, t, _ in item}
            item = []
        item.append((row.item_id, row.term, row.repeats))
    if full():
        yield block
        block = []
    if block or item:
        yield block + item


def automaton(key: object, terms: list[str]) -> ahocorasick.Automaton:
    """Every term with a guard on either side, so that it is only found whole. One per worker and block."""
    global _automaton
    if _automaton is None or _automaton[0] != key:
        made = ahocorasick.Automaton()
        for number, term in enumerate(terms):
            made.add_word(f" {term} ", number)
        if terms:
            made.make_automaton()
        _automaton = (key, made)
    return _automaton[1]


def count_terms(text: str | None, found_by: ahocorasick.Automaton) -> tuple[int, Counter]:
    """The number of terms of a whole text, and how often each item term occurs in it."""
    guarded = b" " + (text or "").encode().translate(GUARDED) + b" "
    blank = np.frombuffer(guarded, np.uint8) == 0x20
    n = int(np.count_nonzero(blank[:-1] & ~blank[1:]))
    return n, Counter(map(itemgetter(1), found_by.iter(guarded.decode()))) if n else Counter()


HITS = "doc_id long, n long, terms array<int>, tfs array<int>"


def scan(docs: DataFrame, terms: list[str], key: str) -> DataFrame:
    """``doc_id, n, terms, tfs`` of each document: its number of terms, and the item terms in it with their counts. Staged."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_by = automaton(key, sent.value)
        if not sent.value:
            return
        for batch in batches:
            counted = [count_terms(t.as_py(), found_by) for t in batch.column("text")]
            ends = np.cumsum([0, *(len(c) for _, c in counted)]).astype(np.int32)
            numbers = np.fromiter((t for _, c in counted for t in c), np.int32, ends[-1])
            tfs = np.fromiter((v for _, c in counted for v in c.values()), np.int32, ends[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([n for n, _ in counted], pa.int64()), pa.ListArray.from_arrays(ends, numbers), pa.ListArray.from_arrays(ends, tfs)],
                names=["doc_id", "n", "terms", "tfs"],
            )

    return stage(docs.mapInArrow(run, HITS), "hits")


class Best:
    """The TOP documents of each item among those seen: by score, then by id, null last."""

    def __init__(self, items: int):
        self.least = np.ones(items, np.int64)
        self.kept = self.fresh = (np.empty(0, np.int64),) * 4
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, absent: np.ndarray) -> None:
        """``scores``: documents by items."""
        row, item = np.nonzero(scores >= self.least[None, :])
        if len(row):
            self.waiting.append((item, scores[row, item], ids[row], absent[row]))
            self.rows += len(row)
        if self.rows > 4 * TOP * len(self.least) + 10_000:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        item, score, ids, absent = (np.concatenate(x) for x in zip(self.kept, *self.waiting))
        order = np.lexsort((ids, absent, -score, item))
        item, score, ids, absent = item[order], score[order], ids[order], absent[order]
        first = np.r_[0, np.flatnonzero(item[1:] != item[:-1]) + 1] if len(item) else np.empty(0, np.int64)
        place = np.arange(len(item)) - np.repeat(first, np.diff(np.r_[first, len(item)]))
        here = place < TOP
        self.least[item[place == TOP - 1]] = score[place == TOP - 1]
        self.kept, self.waiting, self.rows = (item[here], score[here], ids[here], absent[here]), [], 0
        return self.kept


def _parts(sizes: np.ndarray, items: int) -> Iterator[tuple[int, int]]:
    """Cut documents into runs with a bounded number of scores and of additions to them."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and (held + size > CELLS or (i - start + 1) * items > CELLS):
            yield start, i
            start, held = i, 0
        held += size
    if len(sizes) > start:
        yield start, len(sizes)


def rank_block(spark: SparkSession, hits: DataFrame, block: list[tuple[int | None, str, int]], terms: list[str]) -> DataFrame:
    """``item_id, doc_id, score``: of each task the best documents for each item of the block."""
    whole = hits.agg(F.count_if(F.col("n") > 0).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    n_docs, n_terms = int(whole.n), int(whole.l)
    df = np.zeros(len(terms), np.int64)
    for row in hits.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most one row a term of the block
        df[row.t] = row["count"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    number = {t: i for i, t in enumerate(terms)}
    names = list(dict.fromkeys(i for i, _, _ in block))
    place = {i: p for p, i in enumerate(names)}
    of_term = np.array([number[t] for _, t, _ in block], np.int64)
    order = np.argsort(of_term, kind="stable")
    of_item = np.array([place[i] for i, _, _ in block], np.int32)[order]
    repeats = np.array([r for _, _, r in block], np.int64)[order]
    starts = np.searchsorted(of_term[order], np.arange(len(terms) + 1))
    sent = spark.sparkContext.broadcast((weight, starts, of_item, repeats, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, starts, of_item, repeats, names = sent.value
        best = Best(len(names))
        for batch in batches:
            ids = batch.column("doc_id")
            absent = np.asarray(ids.is_null().to_numpy(zero_copy_only=False), np.int64)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            m = np.array([75 + 25 * n * n_docs // n_terms if n_terms else 75 for n in batch.column("n").to_pylist()], np.int64)
            lists = batch.column("terms")
            ends = np.asarray(lists.offsets, np.int64) - lists.offsets[0].as_py()
            t = lists.flatten().to_numpy(zero_copy_only=False)
            tf = batch.column("tfs").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(m)), np.diff(ends))
            gain = weight[t] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
            fan = starts[t + 1] - starts[t]
            sums = np.r_[0, np.cumsum(fan)]
            for a, b in _parts(sums[ends[1:]] - sums[ends[:-1]], len(names)):
                here = slice(ends[a], ends[b])
                many = fan[here]
                at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[t[here]], many)
                cell = np.repeat(doc[here] - a, many) * len(names) + of_item[at]
                scores = np.zeros((b - a) * len(names), np.int64)
                np.add.at(scores, cell, np.repeat(gain[here], many) * repeats[at])
                best.add(scores.reshape(b - a, len(names)), ids[a:b], absent[a:b])
        item, score, ids, absent = best.settle()
        for a in range(0, len(item), 10_000):
            part = slice(a, a + 10_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in item[part]], pa.int64()), pa.array(ids[part], mask=absent[part].astype(bool)), pa.array(score[part])],
                names=["item_id", "doc_id", "score"],
            )

    return hits.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, rank, doc_id, score``: the 20 best documents of each item with a score above 0, equal scores by ascending id.

    Only ``doc_id, text`` of ``docs`` and ``item_id, text`` of ``items`` are read. A null text has no term; each row of ``docs``
    is a document of its own, so a repeated row is ranked as often as it occurs; a null ``doc_id`` comes last among equals.
    Rows of one ``item_id`` (null is an id) are one item with the terms of all their different texts. Items without terms, or whose
    terms no document holds, have no row; so have all items of an empty table of documents.
    """
    spark = session(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pairs = stage(item_terms(items), "item_terms")
    found = None
    for block in blocks(pairs):
        terms = sorted({t for _, t, _ in block})
        hits = scan(texts, terms, uuid.uuid4().hex)
        ranked = stage(best_of(rank_block(spark, hits, block, terms)), "ranked")
        found = ranked if found is None else found.unionByName(ranked)
    return found if found is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def best_of(rows: DataFrame) -> DataFrame:
    """The TOP rows of each item. Each task sends at most TOP of an item; they meet in SALTS groups first."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).where(f"rank <= {TOP}")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(f"rank <= {TOP}")
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


ORACLE = rf"""
with terms as (
  select doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) as term from documents),
asked as (
  select item_id, term, count(*)::bigint as repeats from (
    select item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) as term from (select distinct item_id, text from benchmark))
  group by all),
sizes as (select doc_id, count(*)::bigint as n from terms group by all),
whole as (select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from sizes),
tfs as (select doc_id, term, count(*)::bigint as tf from terms where term in (select term from asked) group by all),
weights as (
  select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tfs cross join whole group by term, n_docs),
gains as (
  select doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) as gain
  from tfs join weights using (term) join sizes using (doc_id) cross join whole),
scores as (select item_id, doc_id, sum(repeats * gain)::bigint as score from asked join gains using (term) group by all having sum(repeats * gain) > 0)
select item_id, rank::int as rank, doc_id, score from (
  select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores) where rank <= {TOP}
"""
