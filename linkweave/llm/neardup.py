"""Near duplicates: b-bit MinHash signatures, bands for candidates, exact links, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkweave.llm.common import attach, session, stage, view

# 128 minima in 32 bands of 4: a pair at similarity 0.8 shares no band with probability (1 - 0.8^4)^32 < 5e-8.
HASHES, BANDS, BITS = 128, 32, 2
PERCENT = 80
# A pair is left out before the exact check only if so few of its low bits agree that a pair at the
# threshold would do so with a probability under this.
MISS = 1e-9
# Members of one group that are compared with all its others in one round.
REPRESENTATIVES = 256
# A hot band is met in several orders, so that its members do not hang on one document.
ORDERS = 4
# Words whose hashes a worker keeps; the frequent ones come first.
CACHE_WORDS = 100_000

_random = np.random.Generator(np.random.Philox(20240229))
MULTIPLY = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
ADD = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value


_hashes = WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles of ``size`` words, A-Z lower-cased; the
    whole sequence is one shingle if it is shorter, and a text without words has none."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    size = min(size, n)
    made = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        made = made * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - size + 1 + i]
    return np.unique(_mixed(made))


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions over a set."""
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 8192):
        part = short[None, at : at + 8192] * MULTIPLY[:, None] + ADD[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of the minima in four longs, 32 minima each."""
    x = least.astype(np.uint64) + (np.arange(HASHES, dtype=np.uint64) << np.uint64(32))
    low = (_mixed(x) & np.uint64((1 << BITS) - 1)).reshape(4, 32)
    return np.bitwise_or.reduce(low << (np.arange(32, dtype=np.uint64) * np.uint64(BITS)), axis=1).view(np.int64)


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, HASHES // BANDS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(rows.shape[1]):
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return key.view(np.int64)


SKETCH = "doc_id long, text_hash long, n_shingles long, set_key binary, s0 long, s1 long, s2 long, s3 long, bands array<long>"


def _sketcher(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, signs, bands = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles(text, size)
                counts.append(len(found))
                if not len(found):
                    keys.append(None), signs.append([None] * 4), bands.append([])
                    continue
                least = minima(found)
                keys.append(xxhash.xxh3_128_digest(found.tobytes()))
                signs.append(packed(least).tolist())
                bands.append(band_keys(least))
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(counts, pa.int64()), pa.array(keys, pa.binary())]
            columns += [pa.array([s[i] for s in signs], pa.int64()) for i in range(4)]
            columns.append(pa.array(bands, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "set_key", "s0", "s1", "s2", "s3", "bands"])

    return run


def _set_maker(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, size).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "members"])

    return run


SIGNATURE = ("s0", "s1", "s2", "s3")


def agreeing(a: str, b: str) -> Column:
    """How many of the minima agree in their low bits, by counting bits of the packed signatures."""
    differ = None
    for s in SIGNATURE:
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        count = F.bit_count(x)
        differ = count if differ is None else differ + count
    return F.lit(HASHES) - differ


def similarity(agree: Column) -> Column:
    """The estimated similarity: agreement by chance of the low bits is taken off."""
    chance = 2.0**-BITS
    return (agree / F.lit(float(HASHES)) - chance) / (1 - chance)


def least_agreement(percent: int) -> int:
    """The agreement that a pair at the threshold falls below with a probability under MISS."""
    import math

    p = percent / 100 + (1 - percent / 100) * 2.0**-BITS
    below = 0.0
    for k in range(HASHES + 1):
        below += math.comb(HASHES, k) * p**k * (1 - p) ** (HASHES - k)
        if below > MISS:
            return k
    return HASHES


def _labels(edges: DataFrame) -> DataFrame:
    """``node, label`` for the nodes of the staged edges ``a, b``: the smallest node of each component.

    Each round takes the least label among neighbours, then the label of the label; labels reach the
    end of a path in a number of rounds that grows with its logarithm. Rounds are written, not kept in lineage.
    """
    both = stage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        # a label passes on what its neighbours know: hook the old label below the new one
        hooks = labels.join(near, F.col("node") == F.col("a")).groupBy(F.col("label").alias("root")).agg(F.min("near").alias("low"))
        hooks = stage(hooks, "hooks")  # a written side lets the planner split a large component
        step = labels.join(hooks, F.col("label") == F.col("root")).select("node", "label", F.least("label", "low").alias("to"))
        jump = step.select(F.col("node").alias("at"), F.col("to").alias("next"))
        step = step.join(jump, F.col("to") == F.col("at"), "left")
        new = stage(step.select("node", F.col("label").alias("old"), F.least("to", F.coalesce("next", "to")).alias("label")), "labels")
        changed = not new.where("old <> label").isEmpty()
        labels = new.select("node", "label")
        if not changed:
            return labels


def _bands(sketch: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``bucket, id`` for the class representatives in bands with two or more of them, and ``id, n_shingles, s0 … s3`` of these, staged."""
    first = classes.select("set_key", F.col("class_id").alias("doc_id"))
    heads = sketch.join(first, ["set_key", "doc_id"]).withColumnRenamed("doc_id", "id")
    heads = stage(heads.dropDuplicates(["id", "set_key"]), "heads")
    spread = heads.select("id", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    shared = stage(shared.select("bucket"), "buckets")
    members = stage(spread.join(shared, "bucket").distinct(), "members")
    ids = stage(members.select("id").distinct(), "ids")
    return members, stage(heads.select("id", "n_shingles", *SIGNATURE).join(ids, "id"), "signs")


def _pairs(near: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Of the pairs ``a < b`` those that sizes and estimated similarity do not rule out."""
    x, y = signs.alias("x"), signs.alias("y")
    small, large = F.least("x.n_shingles", "y.n_shingles"), F.greatest("x.n_shingles", "y.n_shingles")
    joined = near.join(x, F.col("a") == F.col("x.id")).join(y, F.col("b") == F.col("y.id"))
    enough = similarity(agreeing("x", "y")) >= similarity(F.lit(least_agreement(percent)))
    return joined.where((100 * small >= percent * large) & enough).select("a", "b")


def _ordered(one: str, two: str) -> list[Column]:
    return [F.least(one, two).alias("a"), F.greatest(one, two).alias("b")]


def _prefixes(sets: DataFrame, ids: DataFrame, percent: int) -> DataFrame:
    """``bucket, id, pos, n``: of each document in ``ids`` the rarest shingles, so many that two sets that are similar
    enough have one of them in common, with their places in the order and the size of the set. Any order of the shingles will do
    for that; with the rare ones first, documents that only share a passage do not meet."""
    chosen = stage(sets.join(ids, "id"), "chosen")
    each = chosen.select("id", F.explode("members").alias("bucket"))
    often = stage(each.groupBy("bucket").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "often")
    # a shingle that only one document has meets nobody, but takes its place in the prefix
    ranked = each.join(often, "bucket").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("often", "bucket"))).alias("shared"))
    sizes = chosen.select("id", F.size("members").alias("n"))
    ranked = ranked.join(sizes, "id")
    length = F.col("n") - F.ceil(F.col("n") * percent / 100.0) + 1
    alone = F.col("n") - F.size("shared")
    left = F.greatest(length - alone, F.lit(0)).cast("int")
    each = ranked.select("id", "n", alone.alias("alone"), F.posexplode(F.slice("shared", F.lit(1), left)).alias("at", "x"))
    return each.select(F.col("x.bucket").alias("bucket"), "id", (F.col("alone") + F.col("at")).alias("pos"), "n")


def _may_reach(one: str, two: str, percent: int) -> Column:
    """Whether two sets whose first common shingle stands at these places can be similar enough: what follows bounds what they share."""
    rest = F.least(F.col(f"{one}.n") - F.col(f"{one}.pos"), F.col(f"{two}.n") - F.col(f"{two}.pos"))
    return (100 + percent) * rest >= percent * (F.col(f"{one}.n") + F.col(f"{two}.n"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    one = sets.select(F.col("id").alias("a"), F.col("members").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("members").alias("y"))
    joined = pairs.join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("x", "y"))
    return joined.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b").distinct()


def components(docs: DataFrame, shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``; links are exact.

    Documents with the same set form a class. Classes that share a band are candidates. Each band first
    compares all with one member. Documents of bands that then still hold several components meet again by
    their rarest shingles, of which any two similar sets share one, if sizes and places allow a link; as long as such a group holds several components, up to
    REPRESENTATIVES of its members outside the largest are compared with all members of other
    components, and leave the group. So no group lists all its pairs, and no pair of a band in different components is
    left out. Pairs that the packed low bits do not rule out are confirmed on the full sets.

    A null, empty or blank text has no shingles and is linked with nothing. A row without an id has
    no component and is kept. Repeated rows of an id get the same verdict; rows of one id with
    different texts are judged each by its text. An empty table gives an empty result.
    """
    return _verdicts(docs, shingle, percent).drop("text_hash")


def _verdicts(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``components`` with the ``text_hash`` that tells rows of one id apart."""
    session(docs.sparkSession)
    sketch = stage(view(docs).select("doc_id", "text_hash", "text").mapInArrow(_sketcher(shingle), SKETCH), "sketch")
    texts = view(docs).select("doc_id", "text")
    named = sketch.where("doc_id is not null and n_shingles > 0")
    classes = stage(named.groupBy("set_key").agg(F.min("doc_id").alias("class_id")), "classes")
    members, signs = _bands(named, classes)

    # one member of each band, chosen in one of a few orders
    order = F.xxhash64("id", F.pmod("bucket", F.lit(ORDERS)))
    chosen = members.groupBy("bucket").agg(F.min_by("id", F.struct(order, "id")).alias("head"))
    star = members.join(stage(chosen, "heads"), "bucket").where("id <> head").select(*_ordered("id", "head")).distinct()
    tested = stage(_pairs(stage(star, "star"), signs, percent), "pairs")
    # the full sets of the documents that may have a link or are in a band with several components
    component = None
    sets = _sets(texts, stage(tested.select("a").union(tested.select("b")).toDF("id").distinct(), "asked"), shingle)
    component = _labels(stage(_confirmed(tested, sets, percent), "edges"))

    open_bands = _mixed_groups(members, component)
    ids = stage(open_bands.select("id").distinct(), "open")
    sets = _sets(texts, ids, shingle)
    groups = _prefixes(sets, ids, percent)
    alive = stage(groups, "groups")
    while True:
        known = _mixed_groups(alive, component)
        sizes = known.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("size"))
        largest = sizes.groupBy("bucket").agg(F.max(F.struct("size", "component")).alias("top"))
        sizes = sizes.join(largest, "bucket").select("bucket", "component", "size", (F.col("component") == F.col("top.component")).alias("is_top"))
        known = stage(known.join(stage(sizes, "sizes"), ["bucket", "component"]), "known")
        if known.isEmpty():
            break
        rank = F.row_number().over(Window.partitionBy("bucket").orderBy("size", "component", "id"))
        outside = known.where("not is_top").withColumn("rank", rank).where(F.col("rank") <= REPRESENTATIVES)
        outside = stage(outside.select("bucket", "component", "id", "pos", "n"), "outside")
        one, two = known.alias("m"), outside.alias("h")
        apart = (F.col("m.bucket") == F.col("h.bucket")) & (F.col("m.component") != F.col("h.component"))
        near = one.join(two, apart & _may_reach("m", "h", percent)).select(*_ordered("m.id", "h.id")).distinct()
        near = stage(near.join(tested, ["a", "b"], "left_anti"), "near")
        fresh = stage(_pairs(near, signs, percent), "pairs")
        found = _confirmed(fresh, sets, percent)
        tested = tested.union(fresh)
        # contract: edges between components, then the label of the label
        of = component.select("node", "label")
        found = found.join(of.toDF("a", "la"), "a", "left").join(of.toDF("b", "lb"), "b", "left")
        joins = stage(found.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b").distinct(), "joins")
        if not joins.isEmpty():
            above = _labels(joins).toDF("label", "root")
            both = component.join(above, "label", "full").select(F.coalesce("node", "label").alias("node"), F.coalesce("root", "label").alias("label"))
            component = stage(both, "component")
        alive = known.join(outside.select("bucket", "id"), ["bucket", "id"], "left_anti").select("bucket", "id", "pos", "n")

    named_classes = classes.join(component, F.col("class_id") == F.col("node"), "left")
    table = stage(named_classes.select("set_key", F.coalesce("label", "class_id").alias("component")), "table")
    rows = sketch.select("doc_id", "text_hash", "n_shingles", "set_key").alias("s").join(table.alias("t"), F.col("s.set_key") == F.col("t.set_key"), "left")
    return rows.select(
        F.col("s.doc_id").alias("doc_id"),
        "text_hash",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == F.coalesce("component", "doc_id"))).alias("kept"),
    )


def _sets(texts: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """``id, members`` (the full set) of the documents in the staged ``ids``, staged."""
    rows = attach(texts.withColumnRenamed("doc_id", "id"), ids, ["id"], "left_semi", row_bytes=16)
    return stage(rows.dropDuplicates(["id", "text"]).mapInArrow(_set_maker(shingle), "id long, members array<long>"), "sets")


def _mixed_groups(groups: DataFrame, component: DataFrame) -> DataFrame:
    """The groups that hold several components, with the ``component`` of each ``id``."""
    known = groups.join(component.select(F.col("node").alias("id"), "label"), "id", "left")
    known = stage(known.withColumn("component", F.coalesce("label", "id")).drop("label"), "labelled")
    mixed = known.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return known.join(stage(mixed.select("bucket"), "mixed"), "bucket")


def deduplicated(docs: DataFrame, shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that represent their component, each text of an id by its own verdict; of rows that repeat an id with its
    text one stays. Rows without an id, or without a word, all stay."""
    judged = _verdicts(docs, shingle, percent).where("doc_id is not null and n_shingles > 0")
    marks = judged.groupBy("doc_id", "text_hash").agg(F.bool_and("kept").alias("kept__"), F.count(F.lit(1)).alias("rows__"))
    marks = stage(marks.where("not kept__ or rows__ > 1"), "marks").withColumnRenamed("text_hash", "hash__")
    rows = docs.withColumn("hash__", F.xxhash64(F.col("text").cast("string")))
    rows = attach(rows, marks, ["doc_id", "hash__"], row_bytes=32).where(F.coalesce("kept__", F.lit(True)))
    once = rows.where("rows__ > 1").dropDuplicates(["doc_id", "hash__"])  # few texts are shuffled here
    return rows.where("rows__ is null").unionByName(once).select(*docs.columns)


def oracle(shingle: int = 2, percent: int = PERCENT) -> str:
    """All pairs by shared shingles, and components by reachability. For small tables."""
    nexts = "".join(f", lead(w, {i}) over p as w{i}" for i in range(1, shingle))
    joined = " || ' ' || ".join(["w", *(f"w{i}" for i in range(1, shingle))])
    return rf"""
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
word as (select doc_id, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as w from words where len(ws) >= {shingle}),
win as (select doc_id, w{nexts} from word window p as (partition by doc_id order by i)),
sh as (select distinct doc_id, {joined} as s from win where w{shingle - 1} is not null
  union all select doc_id, array_to_string(ws, ' ') from words where len(ws) between 1 and {shingle - 1}),
n as (select doc_id, count(*) as n from sh group by 1),
common as (select x.doc_id as a, y.doc_id as b, count(*) as c from sh x join sh y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2),
edge as (select a, b from common join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= {percent} * (na.n + nb.n - c)),
both_ways as (select a, b from edge union all select b, a from edge),
reach as (select doc_id as a, doc_id as b from documents union select r.a, e.b from reach r join both_ways e on r.b = e.a),
low as (select a as doc_id, min(b) as component_id from reach group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept
from documents d left join n using (doc_id) left join low using (doc_id)
"""
