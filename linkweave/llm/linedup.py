"""Line dedup: winnowed fingerprints of line hashes find runs of lines that occurred before."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm.common import KEY, attach, session, stage, view

# A repeated run counts from MIN_WORDS words on; a fingerprint is the hash of a run of GRAM_WORDS.
MIN_WORDS, GRAM_WORDS = 50, 20
# A line ends at a line feed, or at white space after the end of a sentence: passages are often pasted into a line.
LINE_END = re.compile(r"[.!?][\x20\t\r]+\n?|\n")


def cut(text: str | None) -> list[str]:
    """The text in pieces, one per line; they join to the text again."""
    text = text or ""
    ends = [0, *(m.end() for m in LINE_END.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(ends, ends[1:]) if a < b]


@dataclass
class Lines:
    """The lines with a word of several texts, one text after the other. Runs of lines are pairs of places (start, stop)."""

    sizes: np.ndarray  # lines of each text
    hashes: np.ndarray  # A-Z lower-cased, white space folded
    counts: np.ndarray  # words
    begins: np.ndarray  # the line in its text, in characters
    ends: np.ndarray

    @staticmethod
    def of(texts: list[str | None]) -> Lines:
        sizes, hashes, counts, begins, ends = [], [], [], [], []
        for text in texts:
            at, found = 0, 0
            for piece in cut(text):
                words = piece.encode().lower().split()
                if words:
                    hashes.append(xxhash.xxh64_intdigest(b" ".join(words)))
                    counts.append(len(words))
                    begins.append(at)
                    ends.append(at + len(piece))
                    found += 1
                at += len(piece)
            sizes.append(found)
        numbers = [np.array(x, np.int64) for x in (sizes, counts, begins, ends)]
        return Lines(numbers[0], np.array(hashes, np.uint64), *numbers[1:])

    def __post_init__(self) -> None:
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])  # first line of each text
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.words = np.concatenate([[0], np.cumsum(self.counts)])
        n = len(self.hashes)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hashes * powers(STEP, n), dtype=np.uint64)])

    def shortest(self, least: int) -> np.ndarray:
        """For each line the end of the shortest run from it on with ``least`` words; past its text's end there is none: -1."""
        n = len(self.hashes)
        end = np.searchsorted(self.words, self.words[:n] + least)
        return np.where(end <= self.first[self.owner + 1], end, -1)

    def shortest_back(self, least: int) -> np.ndarray:
        """For each line the start of the shortest run up to and with it that has ``least`` words, or -1."""
        start = np.searchsorted(self.words, self.words[1:] - least, side="right") - 1
        return np.where(start >= self.first[self.owner], start, -1)

    def run_hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of runs of lines, the same wherever the run stands: a polynomial moved to the run's start, then mixed."""
        x = (self.sums[stop] - self.sums[start]) * powers(BACK, len(self.hashes))[start] + (stop - start).astype(np.uint64)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))).view(np.int64)

    def windows(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The shortest runs with ``least`` words, from each line on and back from each line, once each, in order."""
        stop, start = self.shortest(least), self.shortest_back(least)
        n = np.int64(len(self.hashes) + 1)
        on = np.flatnonzero(stop >= 0)
        back = np.flatnonzero(start >= 0)
        both = np.unique(np.concatenate([on * n + stop[on], start[back] * n + back + 1]))
        return both // n, both % n

    def fingerprints(self, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Winnowing: places and hashes of the grams chosen, and the ends of all grams. A gram is the shortest run from a line on
        with ``gram`` words; of the grams inside each window from a line on the least is chosen, the rightmost of equals.

        Any run with ``least`` words that two places share holds a window of the same lines in both, so both choose the same gram.
        """
        ends = self.shortest(gram)
        valid = np.flatnonzero(ends >= 0)
        value = np.full(len(ends), np.iinfo(np.int64).max)
        value[valid] = self.run_hash(valid, ends[valid])
        stop = self.shortest(least)
        start = np.flatnonzero(stop >= 0)
        if not len(start):
            return start, value[start], ends
        # the last gram that ends inside the window: the text's grams stand in order, and so do their ends
        last = valid[np.searchsorted(ends[valid], stop[start], side="right") - 1]
        # least value of start ... last by two overlapping powers of two
        width = last - start + 1
        best = np.arange(len(ends))
        chosen = np.empty(len(start), np.int64)
        size = 1
        while True:
            own = (width >= size) & (width < 2 * size)
            a, b = best[start[own]], best[last[own] - size + 1]
            chosen[own] = np.where((value[b] < value[a]) | ((value[b] == value[a]) & (b > a)), b, a)
            if (width < 2 * size).all():
                break
            a, b = best[:-size], best[size:]
            best = np.append(np.where(value[b] <= value[a], b, a), best[len(best) - size :])
            size *= 2
        chosen = np.unique(chosen)
        return chosen, value[chosen], ends


STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n - 1) modulo 2^64, kept for the next call."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, 1024)
        known = np.full(size, base, np.uint64)
        known[0] = 1
        _powers[base] = known = np.cumprod(known, dtype=np.uint64)
    return known[:n]


UNITS = (
    "doc_id long, text_hash long, hashes array<long>, counts array<int>, begins array<int>, ends array<int>, prints array<long>"
)


def _lists(sizes: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def _reader(min_words: int, gram_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = Lines.of(batch.column("text").to_pylist())
            chosen, values, _ = lines.fingerprints(min_words, gram_words)
            each = np.bincount(lines.owner[chosen], minlength=len(lines.sizes))
            columns = [batch.column("doc_id"), batch.column("text_hash")]
            columns.append(_lists(lines.sizes, lines.hashes.view(np.int64), pa.int64()))
            columns += [_lists(lines.sizes, x, pa.int32()) for x in (lines.counts, lines.begins, lines.ends)]
            columns.append(_lists(each, values, pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, [*KEY, "hashes", "counts", "begins", "ends", "prints"])

    return run


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False)


def _lines_in(batch: pa.RecordBatch) -> Lines:
    sizes = batch.column("hashes").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    hashes = _flat(batch, "hashes").astype(np.int64).view(np.uint64)
    return Lines(sizes, hashes, *(_flat(batch, name).astype(np.int64) for name in ("counts", "begins", "ends")))


def _windower(min_words: int, gram_words: int):
    """Windows that hold a repeated fingerprint: the places that extend a match, line by line to both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = _lines_in(batch)
            chosen, values, ends = lines.fingerprints(min_words, gram_words)
            hits = np.append(chosen[np.isin(values, _flat(batch, "again"))], len(ends))
            start, stop = lines.windows(min_words)
            follows = hits[np.searchsorted(hits, start)]
            held = follows < len(ends)
            held[held] = ends[follows[held]] <= stop[held]
            start, stop = start[held], stop[held]
            owner = lines.owner[start]
            keys = [batch.column(k).take(pa.array(owner)) for k in KEY]
            first = lines.first[owner]
            made = [pa.array(lines.run_hash(start, stop)), pa.array(start - first, pa.int32()), pa.array(stop - first, pa.int32())]
            yield pa.RecordBatch.from_arrays([*keys, *made], [*KEY, "run", "start", "stop"])

    return run


def _editor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of each text that stay, in characters, and how much goes."""
    for batch in batches:
        lines = _lines_in(batch)
        removed_lines, removed_words, keeps = [], [], []
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            at, end = int(lines.first[i]), int(lines.first[i + 1])
            gone = np.zeros(end - at + 1, np.int64)
            for x in spans:
                gone[x["start"]] += 1
                gone[x["stop"]] -= 1
            dropped = np.cumsum(gone)[:-1] > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[False], dropped, [False]]).astype(np.int8)))
            places, keep = 0, []
            for start, stop in zip(edges[::2], edges[1::2]):
                keep.append({"start": places, "stop": int(lines.begins[at + start])})
                places = int(lines.ends[at + stop - 1])
            keep.append({"start": places, "stop": (1 << 31) - 1})
            keeps.append([k for k in keep if k["start"] < k["stop"]])
            removed_lines.append(int(dropped.sum()))
            removed_words.append(int(lines.counts[at:end][dropped].sum()))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        columns = [batch.column(k) for k in KEY] + [pa.array(removed_lines, pa.int64()), pa.array(removed_words, pa.int64()), pa.array(keeps, kind)]
        yield pa.RecordBatch.from_arrays(columns, [*KEY, "n_removed_lines", "n_removed_words", "keep"])


EDITS = "doc_id long, text_hash long, n_removed_lines long, n_removed_words long, keep array<struct<start:int,stop:int>>"


def edits(docs: DataFrame, min_words: int = MIN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """``doc_id, text_hash, n_removed_lines, n_removed_words, keep`` of the texts that lose
    some, staged: later repeats of runs that occurred before. ``keep`` lists the stretches of characters that stay.

    Texts come in the order of id and text hash (a null id first), lines in the order of the text; a
    run that overlaps its own first occurrence is not a repeat. Rows that agree in id and text are one.
    Fingerprints decide which texts and lines can repeat; their windows are then compared by the
    hash of all their lines. Every step is a count or a least value per hash, combined before the
    shuffle, or a join to a staged table, so a passage in a third of all documents meets in no task. Texts
    are read once here: from then on only the hashes of their lines move.
    """
    session(docs.sparkSession)
    units = stage(view(docs).mapInArrow(_reader(min_words, gram_words), UNITS), "lines")
    spread = units.select(*KEY, F.explode("prints").alias("print"))
    again = stage(spread.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("print"), "again")
    hit = spread.join(again, "print").groupBy(*KEY).agg(F.collect_set("print").alias("again"))
    found = attach(units.drop("prints"), stage(hit, "hits"), KEY, "inner", may_broadcast=False)
    runs = stage(found.mapInArrow(_windower(min_words, gram_words), "doc_id long, text_hash long, run long, start int, stop int"), "runs")
    first = runs.groupBy("run").agg(F.min(F.struct(*KEY, "start", "stop")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = runs.join(stage(first.select("run", "first"), "first"), "run")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    later = later.where(~same | (F.col("start") >= F.col("first.stop")))
    spans = stage(later.groupBy(*KEY).agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "spans")
    single = units.drop("prints").dropDuplicates([*KEY])
    return stage(attach(single, spans, KEY, "inner", may_broadcast=False).mapInArrow(_editor, EDITS), "edits")


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """``docs`` with later repeated runs cut out of ``text``, and ``n_removed_lines``, ``n_removed_words``.

    Blank lines inside a run go with it. A null text stays null, an empty one empty. Rows that agree in id and text are the same place, so
    they get the same text; a row of another id with the same text is a repeat. Columns of ``docs`` with the names of the
    two counts are replaced.
    """
    table = edits(docs, min_words, gram_words)
    own = docs.drop("n_removed_lines", "n_removed_words", "keep", "text_hash")
    rows = own.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text_hash", F.xxhash64("text"))
    rows = attach(rows, table, KEY, may_broadcast=False).drop("text_hash")
    kept = F.transform("keep", lambda k: F.substring("text", k["start"] + 1, k["stop"] - k["start"]))
    text = F.when(F.col("keep").isNull(), F.col("text")).otherwise(F.array_join(kept, ""))
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_removed_lines", "n_removed_words")]
    return rows.select(*(text.alias(c) if c == "text" else c for c in own.columns), *counts)
