"""Language-model scores: unigram base scores and a hierarchical Pitman-Yor model of the corpus."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkweave.llm.common import KEY, held_out, most_frequent, session, stage, view
from linkweave.session import unstage

# Words sent to every executor with their counts, and those of them whose bigrams are in the table that is sent with the model.
# Every word has a restaurant of its own; the bigrams of the others are joined by shuffle.
DICTIONARY, CONTEXTS = 131_072, 4_096
DISCOUNT, STRENGTH = 0.75, 5.0
ROOT_DISCOUNT, ROOT_STRENGTH = 0.6, 1.0
SWEEPS, BURN_IN = 5, 2
SEED = 20240229
# Customers seated one by one; later ones in blocks that grow by a quarter, at one probability each.
SINGLY = 64
FLUSH = 150_000
# Bigrams seated at a time.
SEATED = 100_000
# Bigrams beyond the model's own table that a task combines before they are shuffled.
COMBINED = 2_000_000


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


# --- counting


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of training texts, combined until FLUSH distinct words are held."""
    held: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        words = [w.decode() for w in held]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "c"])

    for batch in batches:
        for text in batch.column("text").to_pylist():
            held.update(tokens(text))
        if len(held) > FLUSH:
            yield out()
            held.clear()
    if held:
        yield out()


def word_counts(training: DataFrame) -> DataFrame:
    """``word, c`` of all training texts, staged; white space parts words, so none is empty."""
    counted = training.select("text").mapInArrow(_count_words, "word string, c long")
    return stage(counted.groupBy("word").agg(F.sum("c").alias("c")), "word_counts")


# --- the model


def uniform(key: np.ndarray, sweep: int, step: int) -> np.ndarray:
    """Numbers in (0, 1) from a hash of the key, so that a task that runs again draws the same."""
    x = key.astype(np.uint64) + np.uint64(SEED + 0x9E3779B9 * (sweep * 1009 + step + 1))
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53), (32, 0x9E3779B97F4A7C15)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52)


def tables(c: np.ndarray, strength: np.ndarray, discount: float, key: np.ndarray, sweep: int) -> np.ndarray:
    """How many tables ``c`` customers of one dish take in a Chinese restaurant, drawn for each entry.

    The first customer opens a table. After k customers at t tables the next opens one with
    probability ``strength / (strength + k - discount * t)``: strength is the weight of a new table of this dish, (theta +
    discount * all tables) * the parent's probability, with the other dishes' tables as they are. Customers beyond SINGLY
    are seated in blocks in which that probability stays; the new tables of a block are drawn from the
    normal distribution with the binomial's mean and variance.
    """
    order = np.argsort(-c, kind="stable")
    c, strength, key = c[order], strength[order], key[order]
    t = np.minimum(c, 1).astype(np.float64)
    seated, live, step = 1, int((c > 1).sum()), 0
    while live:
        size = 1 if seated < SINGLY else seated // 4
        block = np.minimum(c[:live] - seated, size)
        weight = np.maximum(strength[:live], 1e-12)
        p = weight / (weight + np.maximum(seated - discount * t[:live], 1e-9))
        u = uniform(key[:live], sweep, 2 * step)
        if size == 1:
            t[:live] += u < p
        else:
            normal = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * uniform(key[:live], sweep, 2 * step + 1))
            t[:live] += np.clip(np.rint(block * p + normal * np.sqrt(block * p * (1 - p))), 0, block)
        seated += size
        step += 1
        live = int(np.searchsorted(-c[:live], -seated))
    drawn = np.empty(len(c), np.int64)
    drawn[order] = t.astype(np.int64)
    return drawn


@dataclass
class Model:
    """What a task needs to score a text. Numbers of words: the most frequent first, as many as have a row in ``own``; then one for a
    word that was never seen, one for the end, and the rest of the dictionary. Words outside have negative numbers, from a hash."""

    counts: dict[bytes, tuple[int, float]]  # word: (number, count) for the dictionary
    words: int  # tokens of training
    kinds: int  # their distinct words
    seen: np.ndarray  # by number: how often it was a context
    own: np.ndarray  # context x dish of the first numbers: the bigram's own share of the probability, averaged over the samples; 0 if it was not seen
    back: np.ndarray  # numbers x samples: the weight of the parent
    parent: np.ndarray  # numbers x samples: the parent's probability of a dish

    def __getstate__(self) -> dict:
        """The bigrams that were seen are sent, 8 bytes each, and not the gaps of the table."""
        return self.__dict__ | {"own": (self.classes, self.pair_key.astype(np.int32), self.pair_p)}

    def __setstate__(self, state: dict) -> None:
        size, key, p = state["own"]
        own = np.zeros((size, size), np.float32)
        own.ravel()[key] = p
        self.__dict__.update(state, own=own)

    @property
    def classes(self) -> int:
        return len(self.own)

    @property
    def pair_key(self) -> np.ndarray:
        """Sorted context * classes + dish of the bigrams that were seen."""
        return np.flatnonzero(self.own)

    @property
    def pair_p(self) -> np.ndarray:
        return self.own.ravel()[self.pair_key]

    def transitions(self, classes: np.ndarray) -> float:
        """The log10 probability of a sequence of classes after the text's start, which is the end's class."""
        return self.steps(np.concatenate([[self.classes - 1], classes[:-1]]), classes)

    def steps(self, before: np.ndarray, after: np.ndarray) -> float:
        """The log10 probability of steps between classes."""
        p = (self.back[before] * self.parent[after]).mean(axis=1) + self.own[before, after]
        return float(np.log10(p).sum())


class Numbers(dict):
    """Numbers of words; those outside the dictionary get a negative one of 63 bits of a hash."""

    def __missing__(self, word: bytes) -> int:
        return outside(word)


def outside(word: bytes) -> int:
    return -1 - (int.from_bytes(blake2b(word, digest_size=8).digest(), "little") >> 1)


def steps_of(words: list[bytes], numbers: Numbers, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context and dish of each token and the end, and whether both are classes of the model's own table, which the end closes."""
    dish = np.array([*map(numbers.__getitem__, words), end], np.int64)
    context = np.concatenate([[end], dish[:-1]])
    return context, dish, (np.minimum(context, dish) >= 0) & (np.maximum(context, dish) <= end)


def _pair_counter(words: dict[bytes, int], end: int):
    """Counts of adjacent words in training texts. Those of the model's own table are combined until FLUSH are held,
    others until COMBINED have come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[int] = Counter()
        others: list[np.ndarray] = []
        numbers, size = Numbers(words), end + 1

        def out(context: np.ndarray, dish: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (context, dish, c)], ["context", "dish", "c"])

        def own() -> pa.RecordBatch:
            keys = np.fromiter(held.keys(), np.int64, len(held))
            return out(keys // size, keys % size, np.fromiter(held.values(), np.int64, len(held)))

        def rest() -> pa.RecordBatch:
            pairs = np.concatenate(others, axis=1)
            pairs = pairs[:, np.lexsort(pairs)]
            first = np.flatnonzero(np.concatenate([[True], (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)]))
            return out(*pairs[:, first], np.diff(np.append(first, pairs.shape[1])))

        waiting = 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                context, dish, inner = steps_of(tokens(text), numbers, end)
                held.update((context[inner] * size + dish[inner]).tolist())
                others.append(np.stack([context[~inner], dish[~inner]]))
                waiting += others[-1].shape[1]
            if len(held) > FLUSH:
                yield own()
                held.clear()
            if waiting > COMBINED:
                yield rest()
                others.clear()
                waiting = 0
        if held:
            yield own()
        if waiting:
            yield rest()

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of about SEATED rows at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def out() -> dict[str, np.ndarray]:
        table = pa.Table.from_batches(held)
        return {name: table.column(name).to_numpy() for name in table.column_names}

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= SEATED:
            yield out()
            held.clear()
            rows = 0
    if rows:
        yield out()


def _put(columns: dict[str, np.ndarray], names: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "double": pa.float64()}
    named = [n.split() for n in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n].astype(kinds[k].to_pandas_dtype()), kinds[k]) for n, k in named], [n for n, _ in named])


@dataclass
class Root:
    """The shared parent: its customers are the tables of the contexts, its base is uniform over ``kinds`` dishes."""

    kinds: float
    customers: float
    opened: float  # its tables

    @property
    def base(self) -> float:
        return (ROOT_STRENGTH + ROOT_DISCOUNT * self.opened) / self.kinds

    def tables(self, customers: np.ndarray, key: np.ndarray, sweep: int) -> np.ndarray:
        """A new draw of the tables of each dish."""
        return tables(customers.astype(np.int64), np.full(len(customers), self.base), ROOT_DISCOUNT, key, sweep)

    def p(self, customers: np.ndarray, t: np.ndarray) -> np.ndarray:
        return (np.maximum(customers - ROOT_DISCOUNT * t, 0) + self.base) / (self.customers + ROOT_STRENGTH)


def _seat(sweep: int, root: Root, parent: np.ndarray, totals: np.ndarray, schema: str):
    """One Gibbs sweep over a share of the bigrams: the customers of each dish in each context sit down again. After the burn-in
    their tables are added to ``kept`` and noted. Outside words come with their numbers, others are in ``parent`` and ``totals``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _gathered(batches):
            total, p = totals[np.maximum(x["context"], 0)], parent[np.maximum(x["dish"], 0)]
            if "total" in x:
                total = np.where(x["context"] < 0, x["total"], total)
                p = np.where(x["dish"] < 0, root.p(x["customers"], x["opened"]), p)
            key = x["context"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + x["dish"].astype(np.uint64)
            t = tables(x["c"], (STRENGTH + DISCOUNT * total) * p, DISCOUNT, key, sweep)
            x |= {"t": t, "kept": x["kept"] + t if sweep > BURN_IN else x["kept"], f"t{sweep}": t}
            yield _put(x, schema)

    return run


def _open(sweep: int, root: Root, schema: str):
    """The parent's tables of outside dishes with ``customers``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _gathered(batches):
            x["opened"] = np.where(x["dish"] < 0, root.tables(x["customers"], x["dish"], sweep), 0)
            yield _put(x, schema)

    return run


def _shares(seen: np.ndarray):
    """The own share of each bigram, packed: places in the table of contexts and dishes, and shares, 8 bytes a bigram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _gathered(batches):
            share = x["over"] / (STRENGTH + seen[x["context"]])
            key = x["context"].astype(np.int32) * np.int32(len(seen)) + x["dish"].astype(np.int32)
            columns = [pa.array([v.tobytes()], pa.binary()) for v in (key, share.astype(np.float32))]
            yield pa.RecordBatch.from_arrays(columns, ["keys", "shares"])

    return run


def _sums(pairs: DataFrame, by: str, what, size: int) -> np.ndarray:
    """Sums by number for the dictionary, at most DICTIONARY + 2."""
    sums = np.zeros(size)
    table = pairs.where(F.col(by) >= 0).groupBy(by).agg(F.sum(what).cast("double").alias("x")).toArrow()
    sums[table[by].to_numpy()] = table["x"].to_numpy()
    return sums


def _over(name: str) -> F.Column:
    """What a number of outside words is spread by: the word itself, or for one of the dictionary the pair, which meets none."""
    return F.when(F.col(name) < 0, F.col(name)).otherwise(F.xxhash64("context", "dish").bitwiseAND((1 << 62) - 1))


def _numbered_outside(numbers):
    """Numbers and counts of the words that are not in the dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = numbers.value
        for batch in batches:
            kept = [(outside(w.encode()), c) for w, c in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist()) if w.encode() not in listed]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in kept], pa.int64()) for i in (0, 1)], ["dish", "c"])

    return run


PAIR = "context long, dish long, c long, t long, kept long"
SAMPLES = range(BURN_IN + 1, SWEEPS + 1)
NOTED = ", ".join(f"t{s} long" for s in SAMPLES)
OUTER = f"{PAIR}, {NOTED}, first long, last long, shared long"
MOVED = f"{OUTER}, total long, customers long, opened long"


def train(training: DataFrame, counts: DataFrame) -> tuple[Model, tuple[DataFrame, DataFrame]]:
    """The model from all training texts and their staged word counts; the staged tables of outside words (``dish, c``, and
    ``back``, ``parent`` of each sample) and of bigrams that are not in the model's own table (``context, dish, over``).

    Every word has a restaurant and is a dish of its own. Bigrams of words are counted over the whole corpus by shuffle. Those of the
    CONTEXTS most frequent words and the end are a table with a float for each pair, 67 MB, which comes to the driver packed, a partition
    at a time; all others stay a table of Spark. In each sweep the executors draw the seating of all context restaurants
    given the shared parent; the tables of each dish are the customers from which the parent is drawn again. A bigram that
    was seen once has one table, so only the others sit down again. Totals of the dictionary's words are arrays, those of outside words
    are summed by shuffle. Predictive probabilities are averaged over the sweeps after the burn-in.
    """
    spark = training.sparkSession
    sizes = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    texts = training.count()
    listed = most_frequent(counts, "c", DICTIONARY).select("word", "c").toArrow()
    top = sorted(zip(listed["word"].to_pylist(), listed["c"].to_pylist()), key=lambda r: (-r[1], r[0]))
    rare = min(CONTEXTS, len(top))
    end, size = rare + 1, len(top) + 2
    known = {w.encode(): (i if i < rare else i + 2, float(c)) for i, (w, c) in enumerate(top)}
    numbers = {w: i for w, (i, _) in known.items()}
    seen = np.zeros(size)
    for i, c in known.values():
        seen[i] = c
    seen[end] = texts

    pairs = training.mapInArrow(_pair_counter(numbers, end), "context long, dish long, c long")
    pairs = stage(pairs.groupBy("context", "dish").agg(F.sum("c").alias("c")), "pairs")
    once = F.when(F.col("c") == 1, 1).otherwise(0)
    first, last = _sums(pairs, "context", once, size), _sums(pairs, "dish", once, size)
    n_once = pairs.where("c = 1").count()
    # Outside words: how many bigrams that were seen once they begin and end.
    words = counts.mapInArrow(_numbered_outside(spark.sparkContext.broadcast(numbers)), "dish long, c long")
    begun = pairs.where("context < 0 and c = 1").groupBy(F.col("context").alias("dish")).agg(F.count(F.lit(1)).alias("first"))
    ended = pairs.where("dish < 0 and c = 1").groupBy("dish").agg(F.count(F.lit(1)).alias("last"))
    words = words.join(begun, "dish", "left").join(ended, "dish", "left").na.fill(0, ["first", "last"])

    fresh = pairs.where("c > 1").withColumns({"t": F.lit(1).cast("long"), "kept": F.lit(0).cast("long")})
    both = (F.col("context") >= 0) & (F.col("dish") >= 0)
    inner = stage(fresh.where(both), "inner")
    outer = fresh.where(~both).withColumns({f"t{s}": F.lit(0).cast("long") for s in SAMPLES})
    shared = outer.where("dish < 0").groupBy("dish").agg(F.count(F.lit(1)).alias("shared"))
    words = stage(words.join(shared, "dish", "left").na.fill(0, ["shared"]), "outside")
    begins = words.select(F.col("dish").alias("u"), "first")
    ends = words.select(F.col("dish").alias("w"), "last", "shared")
    outer = outer.withColumns({"by_u": _over("context"), "by_w": _over("dish")})
    outer = outer.join(begins, F.col("by_u") == F.col("u"), "left").join(ends, F.col("by_w") == F.col("w"), "left").na.fill(0, ["first", "last", "shared"])
    still = words.where("shared = 0").select("dish", F.col("last").alias("customers"))

    def moved(rows: DataFrame, root: Root, sweep: int) -> DataFrame:
        """``rows`` with the totals of their outside words, staged."""
        for name, by, start in (("total", "context", "first"), ("customers", "dish", "last")):
            rows = rows.withColumn("by", _over(by)).withColumn(name, F.col(start) + F.sum("t").over(Window.partitionBy("by"))).drop("by")
        return stage(rows.withColumn("opened", F.lit(0).cast("long")).select(*names).mapInArrow(_open(sweep, root, MOVED), MOVED), "outer")

    def state(root: Root, sweep: int) -> tuple[Root, np.ndarray, np.ndarray]:
        """The parent drawn from the tables of ``inner`` and ``outer``, its probabilities and the totals of the dictionary's words."""
        tables_of = inner.select("context", "dish", "t").union(outer.select("context", "dish", "t"))
        totals, customers = first + _sums(tables_of, "context", "t", size), last + _sums(tables_of, "dish", "t", size)
        t = root.tables(customers, np.arange(size), sweep)
        of_moved = outer.where("shared > 0").agg(F.coalesce(F.sum(F.col("opened") / F.col("shared")), F.lit(0.0))).first()[0]
        of_still = still.withColumn("opened", F.lit(0).cast("long")).mapInArrow(_open(sweep, root, "opened long"), "opened long")
        opened = t.sum() + round(of_moved) + of_still.agg(F.coalesce(F.sum("opened"), F.lit(0))).first()[0]
        n = n_once + tables_of.agg(F.coalesce(F.sum("t"), F.lit(0))).first()[0]
        drawn = Root(root.kinds, float(n), float(opened))
        return drawn, drawn.p(customers, t), totals

    names = [x.split()[0] for x in MOVED.split(", ")]
    root = Root(float(sizes.v + 2), 0.0, float(sizes.v + (texts > 0)))
    outer = moved(outer, root, 0)
    root, parent, totals = state(root, 0)
    draws, backs, parents = [], [], []
    for sweep in range(1, SWEEPS + 1):
        earlier = inner, outer
        inner = stage(inner.mapInArrow(_seat(sweep, root, parent, totals, PAIR), PAIR), "inner")
        outer = moved(outer.mapInArrow(_seat(sweep, root, parent, totals, OUTER), OUTER), root, sweep)
        for seating in earlier:
            unstage(seating)
        before = root
        root, parent, totals = state(root, sweep)
        if sweep > BURN_IN:
            draws.append((before, root))
            backs.append((STRENGTH + DISCOUNT * totals) / (STRENGTH + seen))
            parents.append(parent)

    over = F.greatest(F.col("c") - DISCOUNT * F.col("kept") / len(SAMPLES), F.lit(0.0)).alias("over")
    seated = inner.select("context", "dish", over).union(outer.select("context", "dish", over))
    seated = seated.union(pairs.where("c = 1").select("context", "dish", F.lit(1 - DISCOUNT).alias("over")))
    classes = (F.least("context", "dish") >= 0) & (F.greatest("context", "dish") <= end)
    own = np.zeros((end + 1, end + 1), np.float32)
    packed = stage(seated.where(classes).mapInArrow(_shares(seen[: end + 1]), "keys binary, shares binary"), "shares")
    for r in packed.toLocalIterator():
        own.ravel()[np.frombuffer(r["keys"], np.int32)] = np.frombuffer(r["shares"], np.float32)
    model = Model(known, sizes.n + texts, sizes.v + (texts > 0), seen, own, np.stack(backs, 1), np.stack(parents, 1))
    return model, (_sampled(words, outer, draws), seated.where(~classes))


def _sampled(words: DataFrame, outer: DataFrame, draws: list[tuple[Root, Root]]) -> DataFrame:
    """``dish, c, b0, p0, ...`` of the outside words, staged: the weight of the parent and the parent's probability in each sample."""
    sums = {}
    for by in ("context", "dish"):
        some = outer.where(F.col(by) < 0).groupBy(F.col(by).alias("dish"))
        sums[by] = some.agg(*(F.sum(f"t{s}").alias(f"{by}{s}") for s in SAMPLES))
    table = words.join(sums["context"], "dish", "left").join(sums["dish"], "dish", "left").na.fill(0)
    schema = "dish long, c long, " + ", ".join(f"b{i} double, p{i} double" for i in range(len(draws)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _gathered(batches):
            for i, (s, (before, root)) in enumerate(zip(SAMPLES, draws)):
                customers = x["last"] + x[f"dish{s}"]
                x[f"p{i}"] = root.p(customers, before.tables(customers, x["dish"], s))
                x[f"b{i}"] = (STRENGTH + DISCOUNT * (x["first"] + x[f"context{s}"])) / (STRENGTH + x["c"])
            yield _put(x, schema)

    return stage(table.mapInArrow(run, schema), "outside_sampled")


# --- scoring

PARTIAL = "doc_id long, text_hash long, held_out boolean, n_tokens long, n_known long, base double, path double"


def _scorer(model, texts: int):
    """Everything but the steps that are not in the model's own table and the counts of outside words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        end = m.classes - 1
        numbers = Numbers({w: i for w, (i, _) in m.counts.items()})
        logs = np.log10(m.seen + 0.5) - math.log10(m.words + 0.5 * (m.kinds + 1))
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for text in batch.column("text").to_pylist():
                words = tokens(text)
                context, dish, inner = steps_of(words, numbers, end)
                listed = dish[dish >= 0]
                columns[0].append(len(words) + 1)
                columns[1].append(len(listed) - (texts == 0))
                columns[2].append(float(logs[listed].sum()))
                columns[3].append(m.steps(context[inner], dish[inner]))
            made = [pa.array(v, k) for v, k in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
            names = [*KEY, "held_out", "n_tokens", "n_known", "base", "path"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names[:3]] + made, names)

    return run


STEP = "text_hash long, context long, dish long"


def _steps(words, end: int, inner: bool):
    """The steps that are not in the model's own table: those between words of the dictionary, or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(words.value)
        for batch in batches:
            held: list[np.ndarray] = [np.zeros((3, 0), np.int64)]
            for text, key in zip(batch.column("text").to_pylist(), batch.column("text_hash").to_pylist()):
                context, dish, own = steps_of(tokens(text), numbers, end)
                some = np.flatnonzero(~own & ((np.minimum(context, dish) >= 0) == inner))
                held.append(np.stack([np.full(len(some), key or 0), context[some], dish[some]]))
            yield _put(dict(zip(("text_hash", "context", "dish"), np.concatenate(held, axis=1))), STEP)

    return run


REST = "text_hash long, known long, rest_base double, rest_path double"


def _finish(model, samples: int):
    """Sums by text, within a share of the steps, of the logarithms of the steps that came out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        never = m.classes - 2
        below = math.log10(m.words + 0.5 * (m.kinds + 1))
        for x in _gathered(batches):
            context, dish = x["context"], x["dish"]
            u, w = np.maximum(context, 0), np.maximum(dish, 0)
            seen, p = m.seen[u], np.zeros(len(u))
            back, parent = m.back[u], m.parent[w]
            if "c" in x:
                seen, c = np.where(context < 0, np.nan_to_num(x["u_c"]), seen), np.nan_to_num(x["c"].astype(float))
            else:
                c = np.zeros(len(u))
            for i in range(samples):
                b, q = back[:, i], parent[:, i]
                if "c" in x:
                    b = np.where(context < 0, np.where(np.isnan(x[f"b{i}"]), 1.0, x[f"b{i}"]), b)
                    q = np.where(dish < 0, np.where(np.isnan(x[f"p{i}"]), m.parent[never, i], x[f"p{i}"]), q)
                p += b * q / samples
            p += np.nan_to_num(x["over"]) / (STRENGTH + seen)
            rows, at = np.unique(x["text_hash"], return_inverse=True)
            out = dish < 0
            yield _put({
                "text_hash": rows, "known": np.bincount(at, out & (c > 0)), "rest_path": np.bincount(at, np.log10(p)),
                "rest_base": np.bincount(at, np.where(out, np.log10(c + 0.5) - below, 0.0)),
            }, REST)

    return run


def score(docs: DataFrame, test: tuple[int, int] = (5, 1)) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity`` for every row of ``docs``.

    Training texts are those of rows that are not held out (crc32(doc_id) mod ``test[0]`` equal to ``test[1]``, or no id). A null
    text is empty: its one token is the end. Counts cover all training texts; words outside the dictionary and bigrams
    outside the model's own table are joined to their counts and tables by shuffle, so both may grow without bound. ``score`` is the
    log10 probability of the text under the Pitman-Yor model, ``perplexity`` 10^(-score / n_tokens).
    Repeated rows teach each and get equal scores; without training texts every token has the floor's probability.
    """
    spark = session(docs.sparkSession).sparkContext
    texts = view(docs).withColumn("held_out", held_out(*test))
    training = texts.where(~F.col("held_out")).select("text")
    counts = word_counts(training)
    found, (words, pairs) = train(training, counts)
    n_texts = training.count()
    model = spark.broadcast(found)
    numbers = spark.broadcast({w: i for w, (i, _) in found.counts.items()})
    partial = stage(texts.mapInArrow(_scorer(model, n_texts), PARTIAL), "partial")
    samples, finish = len(SAMPLES), _finish(model, len(SAMPLES))

    def steps(inner: bool) -> DataFrame:
        """The steps that are not in the model's own table, with what their bigrams have over their tables."""
        those = (F.least("context", "dish") >= 0) == F.lit(inner)
        made = texts.select("text", "text_hash").mapInArrow(_steps(numbers, found.classes - 1, inner), STEP)
        return made.join(pairs.where(those), ["context", "dish"], "left")

    begins = words.select(F.col("dish").alias("u"), F.col("c").cast("double").alias("u_c"), *(f"b{i}" for i in range(samples)))
    ends = words.select(F.col("dish").alias("w"), F.col("c").cast("double").alias("c"), *(f"p{i}" for i in range(samples)))
    outer = steps(False).withColumns({"by_u": _over("context"), "by_w": _over("dish")})
    outer = outer.join(begins, F.col("by_u") == F.col("u"), "left").join(ends, F.col("by_w") == F.col("w"), "left").drop("u", "w", "by_u", "by_w")
    rest = steps(True).mapInArrow(finish, REST).union(outer.mapInArrow(finish, REST)).groupBy("text_hash").agg(
        F.sum("known").alias("known"), F.sum("rest_base").alias("rest_base"), F.sum("rest_path").alias("rest_path")
    )
    # Equal texts have given the same steps, so each has its share of the sums.
    copies = partial.groupBy("text_hash").agg(F.count(F.lit(1)).alias("copies"))
    rest = rest.join(copies, "text_hash").select("text_hash", *((F.col(n) / F.col("copies")).alias(n) for n in ("known", "rest_base", "rest_path")))
    rows = partial.join(rest, "text_hash", "left")
    total = F.col("path") + F.coalesce("rest_path", F.lit(0.0))
    return rows.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(found.words).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest_base", F.lit(0.0))).alias("base_score"),
        total.alias("score"),
        F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"),
    )
