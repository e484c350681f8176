"""Language identification: the family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm.common import fits_broadcast, held_out, session, stage, view

# ISO 639-1 codes by branch. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt rm ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "turkic": "az kk ky tk tr tt ug uz",
    "uralic": "et fi hu",
    "indic": "bn gu hi mr ne pa si ur",
    "semitic": "am ar he mt",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

# The classifier is fitted on about this many distinct texts of each language, whole ones, chosen by hash.
# FIT_TOTAL bounds the texts of all languages together in the same way.
FIT_ROWS, FIT_TOTAL = 1500, 6000
BUCKETS = 1 << 12
EPOCHS, REGULAR = 12, 1e-4
UNKNOWN = "und"

LETTER = re.compile(r"[^\W\d_]")
# ASCII that is not a letter becomes a space; other bytes stay.
FOLD = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def features(text: str) -> np.ndarray:
    """Square roots of the counts of hashed byte trigrams of the letters, scaled to length 1."""
    folded = b" " + b" ".join(text.lower().encode().translate(FOLD).split()) + b" "
    a = np.frombuffer(folded, np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(BUCKETS, np.float32)
    codes = ((a[:-2] << 16) | (a[1:-1] << 8) | a[2:]) * np.uint32(2654435761)
    x = np.sqrt(np.bincount(codes >> np.uint32(20), minlength=BUCKETS).astype(np.float32))
    return x / np.sqrt((x * x).sum())


@dataclass
class Machines:
    """One-versus-one separators between ``labels``: votes decide, the sum of margins breaks ties."""

    labels: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray  # buckets x pairs
    bias: np.ndarray

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The label's number for each row, and a confidence from 0 to 1."""
        if len(self.labels) == 1:
            return np.zeros(len(x), int), np.ones(len(x))
        margin = x @ self.weights + self.bias
        votes = np.zeros((len(x), len(self.labels)))
        soft = np.zeros_like(votes)
        for k, (i, j) in enumerate(self.pairs):
            p = 1 / (1 + np.exp(-np.clip(3 * margin[:, k], -30, 30)))
            votes[:, i] += p > 0.5
            votes[:, j] += p <= 0.5
            soft[:, i] += p
            soft[:, j] += 1 - p
        best = (votes + soft / (2 * len(self.labels))).argmax(axis=1)
        return best, soft[np.arange(len(x)), best] / (len(self.labels) - 1)


def separate(x: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, float]:
    """A linear support vector machine by stochastic subgradients of the hinge loss, classes weighted alike."""
    share = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())) * len(sign)
    order = np.random.Generator(np.random.Philox(7))
    w, bias = np.zeros(x.shape[1]), 0.0
    mean, mean_bias = np.zeros_like(w), 0.0
    step, kept = 0, 0
    for epoch in range(EPOCHS):
        for at in np.array_split(order.permutation(len(x)), max(1, len(x) // 32)):
            step += 1
            rate = 1 / (REGULAR * (step + 100))
            part = x[at]
            inside = sign[at] * (part @ w + bias) < 1
            push = share[at] * sign[at] * inside * (min(rate, 50.0) / len(at))
            w = (1 - rate * REGULAR) * w + push @ part
            bias += 0.1 * push.sum()
            if epoch >= EPOCHS // 2:
                mean += w
                mean_bias += bias
                kept += 1
    return (mean / max(1, kept)).astype(np.float32), mean_bias / max(1, kept)


def machines(x: np.ndarray, names: list[str]) -> Machines:
    labels = sorted(set(names))
    number = np.array([labels.index(n) for n in names])
    pairs = list(itertools.combinations(range(len(labels)), 2))
    fitted = []
    for i, j in pairs:
        own = (number == i) | (number == j)
        fitted.append(separate(x[own], np.where(number[own] == i, 1.0, -1.0)))
    weights = np.stack([w for w, _ in fitted], axis=1) if fitted else np.zeros((BUCKETS, 0), np.float32)
    return Machines(labels, pairs, weights, np.array([b for _, b in fitted]))


@dataclass
class Model:
    families: Machines
    members: list[Machines]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language and a score from 0 to 1 for each text; ``und`` and 0 without a letter or a model."""
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        rows = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        if not rows or not self.members:
            return names, scores
        x = np.stack([features(texts[i]) for i in rows])
        family, sure = self.families.decide(x)
        for f, own in enumerate(self.members):
            at = np.flatnonzero(family == f)
            if len(at):
                best, score = own.decide(x[at])
                for k, b, s in zip(at, best, score):
                    names[rows[k]], scores[rows[k]] = own.labels[b], float(min(1.0, sure[k] * s))
        return names, scores


def chosen(docs: DataFrame, rows: int) -> DataFrame:
    """``lang, text_hash, text``: each language's distinct texts whose hash lies in a share of the range of hashes. The share is that
    in which ``rows`` of them are expected, so copies count once, and no task sorts or gathers a language."""
    sizes = docs.groupBy("lang").agg(F.count_distinct("text_hash").alias("n_texts"))
    shares = stage(sizes.select(F.col("lang").alias("of"), (F.lit(float(rows)) / F.col("n_texts")).alias("share")), "shares")
    if not fits_broadcast(shares):
        raise ValueError("more languages than a table of them may have")
    place = F.shiftrightunsigned("text_hash", 11) / F.lit(float(1 << 53))
    near = docs.join(F.broadcast(shares), (F.col("lang") == F.col("of")) & (place < F.col("share")))
    return near.groupBy("lang", "text_hash").agg(F.min("text").alias("text"))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of the texts that have a letter, without the zeros."""
    for batch in batches:
        made = []
        for lang, code, text in zip(*(batch.column(name).to_pylist() for name in ("lang", "text_hash", "text"))):
            if LETTER.search(text):
                x = features(text)
                at = np.flatnonzero(x)
                made.append((lang, code, at.astype(np.uint16).tobytes(), x[at].tobytes()))
        kinds = pa.string(), pa.int64(), pa.binary(), pa.binary()
        columns = zip(*made) if made else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["lang", "text_hash", "places", "weights"])


def fit(docs: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fit on about ``rows`` distinct texts of each language, FIT_TOTAL in all, of ``docs`` (text, text_hash, lang). Only the features
    of this bounded sample reach the driver, 6 bytes for each bucket that a text fills. Null texts and languages teach nothing."""
    usable = docs.where("lang is not null and length(text) > 0").select("lang", "text", "text_hash")
    languages = usable.agg(F.count_distinct("lang")).first()[0]
    rows = max(1, min(rows, FIT_TOTAL // max(1, languages)))
    kinds = "lang string, text_hash long, places binary, weights binary"
    sample = sorted(chosen(usable, rows).mapInArrow(_sparse, kinds).collect(), key=lambda r: (r.lang, r.text_hash))
    if not sample:
        return Model(Machines([], [], np.zeros((BUCKETS, 0), np.float32), np.zeros(0)), [])
    x = np.zeros((len(sample), BUCKETS), np.float32)
    for line, r in zip(x, sample):
        line[np.frombuffer(r.places, np.uint16)] = np.frombuffer(r.weights, np.float32)
    langs = [r.lang for r in sample]
    of = [FAMILY.get(name, f"only {name}") for name in langs]
    families = machines(x, of)
    members = []
    for family in families.labels:
        own = np.array([f == family for f in of])
        members.append(machines(x[own], [n for n, o in zip(langs, own) if o]))
    return Model(families, members)


def identify(docs: DataFrame, test: tuple[int, int] = (5, 0), rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``.

    The model learns from text and language of the rows that are not held out; held out are those with
    crc32(doc_id) mod ``test[0]`` equal to ``test[1]`` and those without an id. Predictions use whole
    texts and nothing else. ``und`` with score 0 for a null text, a text without a letter, and everything if there is nothing to
    learn from. Repeated rows teach once and get equal results; an empty table gives an empty result.
    """
    spark = session(docs.sparkSession).sparkContext
    texts = view(docs, "lang").withColumn("held_out", held_out(*test))
    model = spark.broadcast(fit(texts.where(~F.col("held_out")), rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = model.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return texts.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
