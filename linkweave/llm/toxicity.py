"""Toxicity: a Kneser-Ney model for each class; their length-normalised log-likelihoods are compared."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm.common import held_out, session, stage, view

# The models learn from FIT_DOCS labelled documents of each class on average, chosen by a hash, or from all if there are fewer. Of
# these one text in CALIBRATE is kept to fit the curve from log-likelihoods to a score.
FIT_DOCS, CALIBRATE = 4000, 4
# A text is as toxic as its passages: lengths, in words, of those whose likelihoods are compared beside the whole text's.
PASSAGES = (1, 2, 4)
THRESHOLD = 0.7
# ASCII other than letters and digits parts words; other bytes stay.
FOLD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(FOLD).split()


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct runs of three words per class in a batch; a text starts after two empty words."""
    for batch in batches:
        found: set[tuple[int, bytes, bytes, bytes]] = set()
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = words_of(text)
            found.update((toxic, *run) for run in zip([b"", b"", *words], [b"", *words], words))
        runs = list(found)
        columns = [pa.array([r[0] for r in runs], pa.int32())]
        columns += [pa.array([r[i].decode() for r in runs], pa.string()) for i in (1, 2, 3)]
        yield pa.RecordBatch.from_arrays(columns, ["toxic", "far", "before", "word"])


@dataclass
class KneserNey:
    """Bigram models of two classes over one vocabulary. A bigram backs off to the class's words, and these to
    the continuation counts (before how many different words a word occurs after) of both classes together."""

    number: dict[bytes, int]
    word_p: np.ndarray  # words + 1 (unknown) x 2 classes: probabilities of words
    pair_key: np.ndarray  # sorted keys before * (words + 1) + word
    pair_p: np.ndarray  # pairs x 2: the discounted shares of a bigram
    back: np.ndarray  # words + 1 x 2: the weight of the backoff after a word
    curve: np.ndarray = field(default_factory=lambda: np.zeros(len(PASSAGES) + 3))

    def probabilities(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The chance of each word after the word before it, in both classes."""
        p = self.word_p[ids] * self.back[before]
        key = before * (len(self.number) + 1) + ids
        at = np.searchsorted(self.pair_key, key)
        at[at == len(self.pair_key)] = 0
        if len(self.pair_key):
            hit = self.pair_key[at] == key
            p[hit] += self.pair_p[at[hit]]
        return p

    def features(self, text: str | None) -> tuple[float, ...]:
        """Toxic minus ordinary log-likelihood, each divided by the number of words: of the passages of each length in PASSAGES that
        have most of it, of the whole text by words, and of the whole text by bigrams."""
        words = words_of(text)
        n = len(words)
        if not n:
            return (0.0,) * (len(PASSAGES) + 2)
        unknown = len(self.number)
        get = self.number.get
        ids = np.fromiter((get(w, unknown) for w in words), np.int64, n)
        gain = np.log(self.word_p[ids, 1] / self.word_p[ids, 0])
        sums = np.concatenate([[0.0], np.cumsum(gain)])
        best = [float((sums[k:] - sums[:-k]).max()) / k for k in (min(k, n) for k in PASSAGES)]
        p = self.probabilities(np.concatenate([[unknown], ids[:-1]]), ids)
        return (*best, float(sums[-1]) / n, float(np.log(p[:, 1] / p[:, 0]).mean()))

    def score(self, found: np.ndarray) -> np.ndarray:
        z = found @ self.curve[:-1] + self.curve[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def discounts(histogram: dict[int, int]) -> np.ndarray:
    """What counts of 0, 1, 2, and 3 or more give up, from the numbers of counts of 1 to 4: modified Kneser-Ney. Where one of them is missing, 3/4."""
    n1, n2, n3, n4 = (histogram.get(i, 0) for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return np.array([0.0, 0.75, 0.75, 0.75])
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(min(max(d, 0.05), i + 0.95) for i, d in enumerate(found))])


def _given_up(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return d[np.minimum(counts, 3).astype(np.int64)]


def estimate(words: pa.Table, pairs: pa.Table) -> KneserNey:
    """The models from the tables ``word, kinds, k0, k1`` and ``before, word, k0, k1``, of all words and bigrams of the sample.

    All counts are continuation counts: after how many different words a word, or a bigram, occurs. A
    text that repeats itself or is copied adds nothing to them. What the discounts take goes to the level below, so each context's
    probabilities add up to one; the lowest level is shared by the classes and has one place for all words that were not seen.
    """
    number = {w.encode(): i for i, w in enumerate(words.column("word").to_pylist())}
    unknown = len(number)
    whole = lambda table, c: table.column(c).to_numpy().astype(np.float64)
    shared = np.append(whole(words, "kinds"), 0.0) + 1
    shared /= shared.sum()
    ids = lambda c: np.array([number.get(w.encode(), unknown) for w in pairs.column(c).to_pylist()], np.int64)
    first = ids("before")  # the start of a text is no word: it stands in the place of the unknown one
    key = first * (unknown + 1) + ids("word")
    order = np.argsort(key)
    key, first = key[order], first[order]
    word_p, share, back = np.empty((unknown + 1, 2)), np.empty((len(key), 2)), np.ones((unknown + 1, 2))
    histogram = lambda counts: dict(zip(*(x.tolist() for x in np.unique(counts, return_counts=True))))
    for c in range(2):
        kinds = whole(words, f"k{c}")
        lost = _given_up(kinds, discounts(histogram(kinds)))
        total = max(kinds.sum(), 1.0)
        left = lost.sum() / total if kinds.sum() else 1.0
        word_p[:, c] = np.append((kinds - lost) / total, 0.0) + left * shared
        counts = whole(pairs, f"k{c}")[order]
        lost = _given_up(counts, discounts(histogram(counts)))
        of_first, lost_first = (np.bincount(first, x, unknown + 1) for x in (counts, lost))
        share[:, c] = (counts - lost) / np.maximum(of_first[first], 1)
        seen = of_first > 0
        back[seen, c] = lost_first[seen] / of_first[seen]
    return KneserNey(number, word_p, key, share, back)


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, with a little shrinkage; features are scaled inside."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    z = np.hstack([x / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        pull = z.T @ (p - y) + 0.01 * len(y) / 100 * w
        bend = (z * (p * (1 - p))[:, None]).T @ z + (0.01 * len(y) / 100 + 1e-6) * np.eye(z.shape[1])
        w -= np.linalg.solve(bend, pull)
    return np.concatenate([w[:-1] / scale, w[-1:]])


def fit(sample: DataFrame) -> KneserNey:
    """Learn from the staged sample ``text, toxic, spare``. Words and bigrams are counted on the executors; all of the
    sample's reach the driver, a few numbers each, so they are bounded as the sample is."""
    runs = sample.where("not spare").select("text", "toxic").mapInArrow(_counter, "toxic int, far string, before string, word string")
    of = lambda c: F.count_if(F.col("toxic") == c).cast("int")
    pairs = stage(runs.distinct().groupBy("before", "word").agg(of(0).alias("k0"), of(1).alias("k1")), "pairs")
    some = lambda c: F.count_if(F.col(c) > 0).cast("int")
    words = pairs.groupBy("word").agg(F.count(F.lit(1)).cast("int").alias("kinds"), some("k0").alias("k0"), some("k1").alias("k1"))
    model = estimate(words.toArrow().sort_by("word"), pairs.toArrow())
    names = [f"f{i}" for i in range(len(PASSAGES) + 2)]
    spare = sample.where("spare").select("text", "toxic").mapInArrow(_featurer(model, names), "toxic int, " + ", ".join(f"{n} double" for n in names))
    spare = spare.orderBy(*names, "toxic").collect()
    if spare and len({r.toxic for r in spare}) == 2:
        model.curve = _curve(np.array([r[1:] for r in spare]), np.array([float(r.toxic) for r in spare]))
    else:
        model.curve = np.array([1.0, *[0.0] * (len(PASSAGES) + 1), -3.0])
    return model


def _featurer(model: KneserNey, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.features(t) for t in batch.column("text").to_pylist()]
            columns = [batch.column("toxic"), *(pa.array([f[i] for f in found], pa.float64()) for i in range(len(names)))]
            yield pa.RecordBatch.from_arrays(columns, ["toxic", *names])

    return run


def score(docs: DataFrame, labels: DataFrame, test: tuple[int, int] = (3, 1), fit_docs: int = FIT_DOCS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    The models learn from ``fit_docs`` labelled documents of each class on average, those whose ids have the least hashes, or from all if
    there are fewer.
    Labels teach only through rows that are not held out (crc32(doc_id) mod ``test[0]`` equal to ``test[1]``, or no id);
    a null label teaches nothing, of several labels of an id the greatest counts. Scores use whole texts and nothing else;
    a null, empty or wordless text gets the score of no evidence. Without labels of both classes the scores rest on
    the words alone. Repeated rows get equal results; an empty table gives an empty result.
    """
    spark = session(docs.sparkSession).sparkContext
    texts = view(docs).withColumn("held_out", held_out(*test))
    marked = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marked = marked.agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where("toxic in (0, 1)").where(~held_out(*test))
    marked = stage(marked, "marked")
    sizes = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    # a document is taken if its hash, as a number from 0 to 1, lies below the share of its class that is wanted
    at = F.xxhash64("doc_id").cast("double") / F.lit(2.0**64) + 0.5
    share = F.element_at(F.lit([fit_docs / max(sizes.get(c, 1), 1) for c in (0, 1)]), F.col("toxic") + 1)
    chosen = stage(marked.where(at < share), "chosen")
    # about two times fit_docs rows
    taught = texts.where(~F.col("held_out")).join(F.broadcast(chosen), "doc_id")
    taught = taught.select("text", "toxic", (F.pmod("text_hash", F.lit(CALIBRATE)) == 0).alias("spare"))
    model = spark.broadcast(fit(stage(taught.repartition("text"), "sample")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([model.value.features(t) for t in batch.column("text").to_pylist()]).reshape(-1, len(PASSAGES) + 2)
            scores = model.value.score(found)
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())]
            columns.append(pa.array((scores >= THRESHOLD).astype(np.int32)))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    return texts.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
