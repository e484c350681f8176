"""Benchmark decontamination: latent semantic retrieval of passages, then subsequence and answer checks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm.common import attach, session, stage, view

# Terms are hashed words. A passage is two neighbouring blocks of BLOCK words, so items up to BLOCK words
# lie whole in one; longer items are cut into parts of PART words, each a query of its own.
TERMS, BLOCK, PART = 1 << 16, 32, 48
# The space has the terms of the benchmark and the MORE most frequent others; other terms only add to the length of a
# passage. It has RANK directions, found from all passages of the corpus and all benchmark parts, in POWER passes over their products.
MORE, RANK, OVERSAMPLE, POWER = 1024, 240, 16, 2
# A space is shared by at most RANK + OVERSAMPLE parts, which have at most OWN terms (or it is one part's); a larger benchmark is sought
# in several spaces. A part of whose length its space holds less than HELD is sought by its words.
OWN, HELD = 4096, 0.6
# Terms in more than this share of all blocks weigh nothing: they say little and would take most of the time.
COMMON = 0.02
# A part of which such terms would hold more than this share, if they weighed by their frequency alone, is not sought in the space
# but by its words, so that an item does not hide by being frequent itself. So many of these parts are counted together.
LOST, TOGETHER = 0.25, 256
# Tasks that multiply the terms of all passages. A task gathers about ENTRIES weighted terms and adds their products to the upper half of a
# matrix of columns x columns in bands of BAND columns, so that it writes to a small part of it at a time; the tasks' bands are summed one by one.
TASKS, BAND, ENTRIES = 16, 64, 1 << 18
# Cosine of a passage and a benchmark part that makes a candidate, see `recall` in the tests.
COSINE = 0.35
# Shares of the part's words that must follow in order: alone, or with the answer there.
VERBATIM, PARAPHRASE, ANSWER = 0.7, 0.5, 0.6
# A benchmark item is at most this long to be sent out; SHORT words or fewer must be there in full and in sequence.
SHORT = 8
SEED = 20240229
FOLD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_STEP, _MIX = 0x9E3779B97F4A7C15 | 1, np.uint64(0xC4CEB9FE1A85EC53)


def _folded(text: str | None) -> bytes:
    return (text or "").encode().lower().translate(FOLD)


def words_of(text: str | None) -> list[bytes]:
    return _folded(text).split()


def _powers(n: int) -> np.ndarray:
    steps = np.full(n, _STEP, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps)


_known_powers = _powers(64)


def _terms(folded: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The term of each word of folded text, a polynomial hash of its bytes, and where the word starts. All words at once, none is cut out."""
    global _known_powers
    codes = np.frombuffer(folded, np.uint8)
    inside = codes != 32
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.empty(0, np.int64), starts
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    if (longest := int(sizes.max())) > len(_known_powers):
        _known_powers = _powers(longest)
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    sums = np.add.reduceat(codes[inside].astype(np.uint64) * _known_powers[place], first)
    sums = (sums ^ (sums >> np.uint64(31))) * _MIX
    return ((sums >> np.uint64(40)) & np.uint64(TERMS - 1)).astype(np.int64), starts


def term_ids(words: list[bytes]) -> np.ndarray:
    return _terms(b" ".join(words))[0]


# --- the corpus's document frequencies


def _laid_out(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The terms of all texts, one after the other; the block of each term; the first
    block of each text and, last, the number of blocks. No block holds words of two texts."""
    folded = [_folded(t) for t in texts]
    ids, starts = _terms(b" ".join(folded))
    offsets = np.cumsum([0, *(len(f) + 1 for f in folded)])
    sizes = np.diff(np.searchsorted(starts, offsets))
    first = np.concatenate([[0], np.cumsum(-(-sizes // BLOCK))])
    inside = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return ids, np.repeat(first[:-1], sizes) + inside // BLOCK, first


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of each text, 2 bytes a term."""
    for batch in batches:
        folded = [_folded(t) for t in batch.column("text").to_pylist()]
        ids, starts = _terms(b" ".join(folded))
        ends = np.searchsorted(starts, np.cumsum([0, *(len(f) + 1 for f in folded)])) * 2
        held = ids.astype("<u2").tobytes()
        terms = [held[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.binary())], ["terms"])


def numbered(texts: DataFrame) -> DataFrame:
    """``terms`` of every text, staged: the words are cut and hashed once for the frequencies and all spaces."""
    return stage(texts.select("text").mapInArrow(_numbered, "terms binary"), "terms")


def _cut_up(batch: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The terms of all texts of a batch, and the stretch of ``words`` words that each stands in; the number of stretches."""
    held = batch.column("terms").to_pylist()
    ids = np.frombuffer(b"".join(held), "<u2").astype(np.int64)
    sizes = np.array([len(h) // 2 for h in held], np.int64)
    first = np.concatenate([[0], np.cumsum(-(-sizes // words))])
    inside = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return ids, np.repeat(first[:-1], sizes) + inside // words, int(first[-1])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many blocks each term occurs; the row of term -1 is the number of blocks."""
    total = np.zeros(TERMS, np.int64)
    blocks = 0
    for batch in batches:
        ids, block, n = _cut_up(batch, BLOCK)
        keys = np.sort(block * TERMS + ids)
        total += np.bincount(keys[np.diff(keys, prepend=-1) > 0] % TERMS, minlength=TERMS)
        blocks += n
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *seen], pa.int32()), pa.array([blocks, *total[seen]], pa.int64())], ["term", "n"])


def inverse_frequencies(terms: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Inverse document frequencies of all TERMS terms over all blocks of the corpus: with 0 for common terms, and as they are."""
    found = terms.mapInArrow(_frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    terms, numbers = found["term"].to_numpy(), found["n"].to_numpy()
    counts = np.zeros(TERMS)
    counts[terms[terms >= 0]] = numbers[terms >= 0]
    blocks = float(numbers[terms < 0].sum())
    whole = np.log((blocks + 1) / (counts + 1)) + 1
    return np.where(counts > max(COMMON * blocks, 20), 0.0, whole), whole


def lost_share(ids: np.ndarray, idf: np.ndarray, whole: np.ndarray) -> float:
    """The share of a part's squared length that its common terms would hold."""
    terms, counts = np.unique(ids, return_counts=True)
    x = (counts * whole[terms]) ** 2
    return float(x[idf[terms] == 0].sum() / x.sum())


# --- the latent space


@dataclass
class Part:
    item_id: int
    words: list[bytes]
    answer: list[bytes]


def parts_of(item_id: int, text: str, answer: str | None) -> list[Part]:
    """An item in parts of PART words at most, of about equal length; each has all words of a given answer. Without an answer
    column the answer is the part's words of the item's last sentence, as questions end in what is asked for."""
    words = words_of(text)
    if not words:
        return []
    given = answer is not None
    if not given:
        answer = (text or "").strip().rstrip(".!?").replace("?", ".").replace("!", ".").rsplit(".", 1)[-1]
    wanted = words_of(answer)
    n = -(-len(words) // PART)
    cuts = [len(words) * i // n for i in range(n + 1)]
    return [Part(item_id, words[a:b], [w for w in wanted if given or w in set(words[a:b])]) for a, b in zip(cuts, cuts[1:])]


def _product(rows: Iterator[np.ndarray], basis: np.ndarray, weights: np.ndarray, column: np.ndarray) -> np.ndarray:
    """The sum of x (x . basis) over rows x: weighted term counts of length 1, columns of the space only."""
    total = np.zeros(basis.shape, np.float64)
    for ids in rows:
        terms, counts = np.unique(ids, return_counts=True)
        x = counts * weights[terms]
        x = x / max(np.sqrt((x * x).sum()), 1e-9)
        inside = column[terms] >= 0
        at, x = column[terms[inside]], x[inside]
        total[at] += x[:, None] * (x @ basis[at])
    return total


def _products(idf: np.ndarray, column: np.ndarray, size: int):
    """The upper half of the sum of x^T x over the passages x of a share of the texts, in bands of columns as places and sums; the band -1 has
    the number of passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, passages = [np.zeros((min(BAND, size - low), size - low), np.float32) for low in range(0, size, BAND)], 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            ids, passage, n = _cut_up(batch, 2 * BLOCK)
            keys = np.sort(passage * TERMS + ids)
            starts = np.flatnonzero(np.diff(keys, prepend=-1) > 0)
            at, terms = keys[starts] // TERMS, keys[starts] % TERMS
            x = np.diff(starts, append=len(keys)) * idf[terms]
            x /= np.maximum(np.sqrt(np.bincount(at, x * x, n)), 1e-9)[at]
            inside = np.flatnonzero((column[terms] >= 0) & (x > 0))
            held.append((at[inside] + passages, column[terms[inside]], x[inside]))
            passages += n
            if sum(len(h[0]) for h in held) >= ENTRIES:
                _multiply(*map(np.concatenate, zip(*held)), total)
                held.clear()
        if held:
            _multiply(*map(np.concatenate, zip(*held)), total)
        yield from _bands(-1, np.array([passages], np.float64)).to_batches()
        for low, band in zip(range(0, size, BAND), total):
            yield from _bands(low, band.ravel()).to_batches()

    return run


def _multiply(at: np.ndarray, where: np.ndarray, x: np.ndarray, total: list[np.ndarray]) -> None:
    """Adds the products of the entries ``x`` of each passage ``at``, which ascends, to the bands of ``total``; a band begins at its own first column."""
    size = sum(map(len, total))
    order = np.argsort(at * size + where)
    where, x = where[order], x[order]
    later = np.searchsorted(at, at, side="right") - np.arange(len(at))  # entries of the passage from this one on
    order = np.argsort(where, kind="stable")
    edges = np.searchsorted(where[order], np.arange(0, size + BAND, BAND))
    for low, a, b, band in zip(range(0, size, BAND), edges, edges[1:], total):
        times = later[order[a:b]]
        left = np.repeat(order[a:b], times)
        right = left + np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
        places = (where[left] - low) * (size - low) + where[right] - low
        band += np.bincount(places, x[left] * x[right], band.size).reshape(band.shape)


BANDS = "at int, places binary, sums binary"


def _bands(at: int, band: np.ndarray) -> pa.Table:
    """One row of BANDS with what is not zero: a place and a sum of 4 bytes each. The number of passages keeps its 8 bytes."""
    places = np.flatnonzero(band)
    columns = [pa.array([at], pa.int32()), pa.array([places.astype(np.int32).tobytes()], pa.binary())]
    columns.append(pa.array([band[places].astype(_sum_type(at)).tobytes()], pa.binary()))
    return pa.Table.from_arrays(columns, ["at", "places", "sums"])


def _sum_type(at: int) -> type:
    return np.float64 if at < 0 else np.float32


def _adder(size: int):
    def add(rows: pa.Table) -> pa.Table:
        at = rows.column("at")[0].as_py()
        total = np.zeros(BAND * (size - max(0, at)) + 1)
        for places, sums in zip(rows.column("places"), rows.column("sums")):
            total[np.frombuffer(places.as_py(), np.int32)] += np.frombuffer(sums.as_py(), _sum_type(at))
        return _bands(at, total)

    return add


def products(terms: DataFrame, idf: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, int]:
    """The upper half of A^T A for the TF-IDF rows A of all passages of the corpus, laid end to end, and their number."""
    size = int(column.max()) + 1
    half, passages = np.zeros((size, size), np.float32), 0
    made = terms.coalesce(TASKS).mapInArrow(_products(idf, column, size), BANDS)
    for r in made.groupBy("at").applyInArrow(_adder(size), BANDS).toLocalIterator():
        places, sums = np.frombuffer(r.places, np.int32), np.frombuffer(r.sums, _sum_type(r["at"]))
        if r["at"] < 0:
            passages = int(sums.sum())
        else:
            half[r["at"] + places // (size - r["at"]), r["at"] + places % (size - r["at"])] = sums
    return half, passages


def latent_space(terms: DataFrame, parts: list[np.ndarray], idf: np.ndarray, column: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Columns x rank: the leading right singular vectors of the TF-IDF matrix of all passages of the corpus and
    the benchmark's parts, by the randomised range finder with power passes.

    The executors sum A^T A in bands of columns among them, in one pass over the corpus; the driver gets the sum, band by band: at most
    OWN + MORE columns, whatever the corpus. The benchmark's parts weigh as much as the corpus, as it is their space in which passages are sought.
    """
    size = int(column.max()) + 1
    wide = min(rank + OVERSAMPLE, size)
    random = np.random.Generator(np.random.Philox(SEED))
    basis = np.linalg.qr(random.standard_normal((size, wide)))[0].astype(np.float32)
    half, passages = products(terms, idf, column)
    weight = max(1, passages) / max(1, len(parts))
    product = np.zeros((size, wide))
    for _ in range(POWER + 1):
        product = weight * _product(iter(parts), basis, idf, column)
        product += half @ basis + half.T @ basis - half.diagonal()[:, None] * basis
        last, basis = basis, np.linalg.qr(product)[0].astype(np.float32)
    small = basis.T @ product @ (last.T @ basis)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return (basis @ vectors[:, np.argsort(-values)[:rank]]).astype(np.float32)


# --- search


def common_subsequence(part: list[bytes], words: list[bytes]) -> int:
    """Length of the longest common subsequence."""
    number = {w: i for i, w in enumerate(dict.fromkeys(part))}
    return _in_order([number[w] for w in part], [number[w] for w in words if w in number])


def _in_order(part: list[int], words: list[int]) -> int:
    """The same for numbers that the part has, a word of the text per step, all of the part's words at once in one integer."""
    masks = [0] * (max(part, default=-1) + 1)
    for i, w in enumerate(part):
        masks[w] |= 1 << i
    full = (1 << len(part)) - 1
    row = full
    for w in words:
        hit = row & masks[w]
        row = ((row + hit) | (row - hit)) & full
    return len(part) - row.bit_count()


def least_words(n: int) -> int:
    """How many words of a part of ``n`` must follow in order for any verdict but the clean one."""
    return n if n <= SHORT else int(np.ceil(PARAPHRASE * n))


def _bounds(ids: np.ndarray, kinds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of a text in which a part of ``n`` words is looked for, and how many words each shares with it, each
    word as often as in both. ``ids``: numbers below ``len(kinds)`` for the part's words, ``kinds`` how often it has them."""
    seen = np.zeros((len(ids) + 1, len(kinds) + 1), np.int16)
    seen[np.arange(1, len(ids) + 1), ids] = 1
    seen = np.cumsum(seen, axis=0, dtype=np.int16)[:, :-1]
    starts = np.arange(0, max(1, len(ids) - n + 1), max(1, n // 5))
    ends = np.minimum(len(ids), starts + n + n // 2)
    return starts, ends, np.minimum(seen[ends] - seen[starts], kinds).sum(axis=1)


def may_leak(part: np.ndarray, counts: np.ndarray, n: int, terms: np.ndarray) -> bool:
    """Whether some stretch of the text has enough of the part's words, by their terms alone: words that share a term only add to the bound.
    ``part``: the sorted distinct terms of its ``n`` words, with their ``counts``."""
    ids = np.searchsorted(part, terms)
    ids[ids == len(part)] = 0
    ids[part[ids] != terms] = len(part)
    return bool(_bounds(ids, counts, n)[2].max() >= least_words(n))


def tightest(part: list[bytes], words: list[bytes], least: int) -> int:
    """How many of the part's words follow in order within a stretch of one and a half times its length, at most; 0 if it is fewer than ``least``.

    A stretch cannot have more words in order than it shares with the part, each as often as in both. Stretches go by that
    bound, and those that cannot reach ``least`` or the best so far are left out; the result is the same.
    """
    number = {w: i for i, w in enumerate(dict.fromkeys(part))}
    coded = [number[w] for w in part]
    n, kinds = len(part), len(number)
    ids = np.fromiter((number.get(w, kinds) for w in words), np.int64, len(words))
    starts, ends, bounds = _bounds(ids, np.bincount(coded, minlength=kinds), n)
    best = least - 1
    for i in np.argsort(-bounds, kind="stable"):
        if bounds[i] <= best:
            break
        stretch = ids[starts[i] : ends[i]]
        best = max(best, _in_order(coded, stretch[stretch < kinds].tolist()))
        if best == n:
            break
    return best if best >= least else 0


def leaks(part: Part, words: list[bytes]) -> tuple[float, float, bool]:
    """Share of the part's words in order (0 where it is too small to matter), share of the answer's words there, and the verdict."""
    there = set(words)
    n = len(part.words)
    if sum(w in there for w in part.words) < PARAPHRASE * n:
        return 0.0, 0.0, False
    share = tightest(part.words, words, least_words(n)) / n
    answer = sum(w in there for w in part.answer) / len(part.answer) if part.answer else 0.0
    if n <= SHORT:
        return share, answer, share == 1.0
    return share, answer, share >= VERBATIM or (share >= PARAPHRASE and bool(part.answer) and answer >= ANSWER)


@dataclass
class Presence:
    """Parts that are sought by their words: all passages in which enough of the words stand to pass `leaks`."""

    numbers: np.ndarray  # of the parts
    column: np.ndarray  # of each term, -1 outside these parts
    times: np.ndarray  # columns x parts: how often the part has the term
    least: np.ndarray  # words that must be there

    @staticmethod
    def of(numbers: np.ndarray, ids: list[np.ndarray]) -> Presence:
        terms = np.unique(np.concatenate([ids[j] for j in numbers]))
        column = np.full(TERMS, -1, np.int32)
        column[terms] = np.arange(len(terms))
        times = np.zeros((len(terms), len(numbers)), np.int16)
        for k, j in enumerate(numbers):
            np.add.at(times[:, k], column[ids[j]], 1)
        sizes = np.array([len(ids[j]) for j in numbers])
        return Presence(numbers, column, times, np.where(sizes <= SHORT, sizes, np.ceil(PARAPHRASE * sizes)).astype(np.int16))

    def candidates(self, ids: np.ndarray, block: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Rows (block, part): the words are counted from the block before to the second one after, as `leaks` looks at them."""
        columns = self.column[ids]
        places = np.flatnonzero(columns >= 0)
        at, columns, width = block[places], columns[places], len(self.times)
        owner = np.searchsorted(first, at, side="right") - 1
        keys = []
        for own in (at - 2, at - 1, at, at + 1):
            inside = (own >= first[owner]) & (own < first[owner + 1])
            keys.append(own[inside] * width + columns[inside])
        keys = np.unique(np.concatenate(keys))
        found, starts = np.unique(keys // width, return_index=True)
        pairs = [np.empty((0, 2), np.int64)]
        for low in range(0, len(found), 1024):  # bounds the gathered rows
            end = starts[low + 1024] if low + 1024 < len(found) else len(keys)
            rows = self.times[keys[starts[low] : end] % width]
            enough = np.argwhere(np.add.reduceat(rows, starts[low : low + 1024] - starts[low], axis=0, dtype=np.int16) >= self.least)
            pairs.append(np.stack([found[low + enough[:, 0]], self.numbers[enough[:, 1]]], axis=1))
        return np.concatenate(pairs)


def _summed(table: np.ndarray, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each stretch of ``rows`` the sum of these rows of the table: the first of all stretches, then the second of those that have one, and so on."""
    sums = np.zeros((len(starts), table.shape[1]), np.float32)
    order = np.argsort(starts - ends, kind="stable")
    for low in range(0, len(order), 256):  # so that the sums stay in the processor's cache
        own = order[low : low + 256]
        first, sizes = starts[own], ends[own] - starts[own]
        held = np.zeros((len(own), table.shape[1]), np.float32)
        for step in range(int(sizes[0])):
            live = int(np.searchsorted(-sizes, -step))
            held[:live] += table[rows[first[:live] + step]]
        sums[own] = held
    return sums


@dataclass
class Space:
    numbers: np.ndarray  # of the parts
    idf: np.ndarray
    column: np.ndarray  # of each term, -1 outside the space
    near: np.ndarray  # columns x parts: what a word adds to the product with the part, through the space
    cosine: float

    def candidates(self, ids: np.ndarray, block: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Rows (block, part) of passages near a part: a block with the next one. Lengths are those before the
        projection, so that text outside the space lowers the cosine. The last block of a text also stands alone.

        A passage whose words would be too far off even if each stood by the part that it is nearest to is left out unread; none of them is a candidate.
        """
        blocks = int(first[-1])
        squares = np.bincount(block, self.idf[ids] ** 2, blocks)
        least = self.cosine * np.sqrt(np.maximum(squares + np.append(squares[1:], 0), 1e-9)).astype(np.float32)
        columns = self.column[ids]
        places = np.flatnonzero(columns >= 0)
        at, columns = block[places], columns[places]
        most = np.bincount(at, np.maximum(self.near.max(axis=1, initial=0), 0)[columns], blocks + 1)
        open_ = np.flatnonzero(most[:-1] + most[1:] >= 0.999 * least)
        edges = np.searchsorted(at, np.arange(blocks + 2))
        pairs = [np.empty((0, 2), np.int64)]
        for low in range(0, len(open_), 4096):  # bounds the sums
            passage = open_[low : low + 4096]
            needed = np.union1d(passage, passage + 1)
            sums = _summed(self.near, columns, edges[needed], edges[needed + 1])
            sums = sums[np.searchsorted(needed, passage)] + sums[np.searchsorted(needed, passage + 1)]
            found = np.argwhere(sums >= least[passage][:, None])
            pairs.append(np.stack([passage[found[:, 0]], self.numbers[found[:, 1]]], axis=1))
        return np.concatenate(pairs)


@dataclass
class Searcher:
    parts: list[Part]
    ways: list[Space | Presence]
    terms: list[tuple[np.ndarray, np.ndarray]]  # the distinct terms of each part with their counts

    def __post_init__(self) -> None:
        """The same as one sorted list of part * TERMS + term, and how many words each part must have in common with a text."""
        empty = [np.empty(0, np.int64)]
        self.keys = np.concatenate([j * TERMS + terms for j, (terms, _) in enumerate(self.terms)] or empty)
        self.times = np.concatenate([counts for _, counts in self.terms] or empty)
        self.least = np.array([least_words(len(p.words)) for p in self.parts])
        self.known = np.zeros(TERMS, bool)
        self.known[self.keys % TERMS] = True

    def enough(self, ids: np.ndarray, part: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which of the stretches ``low`` to ``high`` share enough words with their part, each word as often as in both, wherever they stand."""
        places = np.flatnonzero(self.known[ids])
        starts = np.searchsorted(places, low)
        sizes = np.searchsorted(places, high) - starts
        shared = np.zeros(len(part), np.int64)
        for a in range(0, len(part), 4096):  # bounds the words that are laid out
            n = sizes[a : a + 4096]
            pair = np.repeat(np.arange(a, a + len(n)), n)
            word = ids[places[np.arange(len(pair)) + np.repeat(starts[a : a + 4096] - np.cumsum(n) + n, n)]]
            wanted = part[pair] * TERMS + word
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            hits = np.flatnonzero(self.keys[at] == wanted)
            keys = np.sort(pair[hits] * len(self.keys) + at[hits])
            runs = np.flatnonzero(np.diff(keys, prepend=-1) > 0)
            pair, at = keys[runs] // len(self.keys), keys[runs] % len(self.keys)
            shared += np.bincount(pair, np.minimum(np.diff(runs, append=len(keys)), self.times[at]), len(part)).astype(np.int64)
        return shared >= self.least[part]

    def search(self, texts: list[str | None]) -> list[list[tuple[int, float, float, int, int]]]:
        """For each text (item, share, answer, first word, last word) of the passages that leak, the best one for each item."""
        ids, block, first = _laid_out(texts)
        words: dict[int, list[bytes]] = {}  # of the texts with candidates only
        found: list[dict[int, tuple[int, float, float, int, int]]] = [{} for _ in texts]
        if self.parts and len(ids):
            pairs = np.unique(np.concatenate([way.candidates(ids, block, first) for way in self.ways]), axis=0)
            owners = np.searchsorted(first, pairs[:, 0], side="right") - 1
            edges = np.searchsorted(block, first)  # of the texts, in words
            own = pairs[:, 0] - first[owners]
            starts, ends = np.maximum(0, (own - 1) * BLOCK), np.minimum(edges[owners + 1] - edges[owners], (own + 3) * BLOCK)
            left = np.flatnonzero(self.enough(ids, pairs[:, 1], edges[owners] + starts, edges[owners] + ends))
            for j, i, start, end in zip(*(x[left].tolist() for x in (pairs[:, 1], owners, starts, ends))):
                part, best = self.parts[j], found[i]
                if not may_leak(*self.terms[j], len(part.words), ids[edges[i] + start : edges[i] + end]):
                    continue
                if i not in words:
                    words[i] = words_of(texts[i])
                share, answer, leak = leaks(part, words[i][start:end])
                if leak and (part.item_id not in best or best[part.item_id][1] < share):
                    best[part.item_id] = (part.item_id, share, answer, start, end)
        return [list(f.values()) for f in found]


def searcher(texts: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> Searcher:
    """Document frequencies of the whole corpus, the latent space, and the benchmark folded into it.

    The benchmark is a stated query set; it is collected, so it must fit the driver.
    """
    names = ["item_id", "text"] + (["answer"] if "answer" in benchmark.columns else [])
    parts = []
    for r in benchmark.select(*names).where("item_id is not null and text is not null").dropDuplicates().orderBy("item_id", "text").collect():
        parts += parts_of(r.item_id, r.text, r.answer if "answer" in names else None)
    terms = numbered(texts)
    idf, whole = inverse_frequencies(terms)
    ids = [term_ids(p.words) for p in parts]
    by_words = np.array([lost_share(x, idf, whole) > LOST for x in ids], bool)
    ways: list[Space | Presence] = []
    for numbers in shared_out(ids):
        way, held = space_of(numbers, ids, idf, terms, cosine)
        ways.append(way)
        by_words[numbers] |= held < HELD
    left = np.flatnonzero(by_words)
    ways += [Presence.of(left[at : at + TOGETHER], ids) for at in range(0, len(left), TOGETHER)]
    return Searcher(parts, ways, [np.unique(x, return_counts=True) for x in ids])


def shared_out(ids: list[np.ndarray]) -> list[np.ndarray]:
    """The numbers of the parts of each space, in about equal shares; a share whose parts have more than OWN terms is halved."""
    open_, done = np.array_split(np.arange(len(ids)), max(1, -(-len(ids) // (RANK + OVERSAMPLE)))), []
    while open_:
        numbers = open_.pop(0)
        if len(numbers) > 1 and len(np.unique(np.concatenate([ids[j] for j in numbers]))) > OWN:
            open_ = [*np.array_split(numbers, 2), *open_]
        else:
            done.append(numbers)
    return done


def space_of(numbers: np.ndarray, ids: list[np.ndarray], idf: np.ndarray, corpus: DataFrame, cosine: float) -> tuple[Space, np.ndarray]:
    """The latent space of some parts, with these folded into it, and how much of each part's length it holds."""
    ids = [ids[j] for j in numbers]
    own = np.unique(np.concatenate(ids)) if ids else np.empty(0, np.int64)
    own = own[idf[own] > 0]
    others = np.setdiff1d(np.flatnonzero(idf > 0), own)
    others = others[np.argsort(idf[others], kind="stable")][:MORE]
    column = np.full(TERMS, -1, np.int64)
    chosen = np.concatenate([own, others])
    column[chosen] = np.arange(len(chosen))
    space = latent_space(corpus, ids, idf, column, min(RANK, max(8, 2 * len(ids))))
    weighted = space * idf[chosen][:, None]
    queries = np.zeros((space.shape[1], len(ids)), np.float32)
    for j, terms in enumerate(ids):
        terms, counts = np.unique(terms[idf[terms] > 0], return_counts=True)
        if len(terms):
            queries[:, j] = counts @ weighted[column[terms]] / np.sqrt(((counts * idf[terms]) ** 2).sum())
    # a part that the space holds little of is sought with its direction scaled up, at most twofold
    held = np.sqrt((queries**2).sum(axis=0))
    queries /= np.maximum(held, 0.5)
    near = weighted.astype(np.float32) @ queries
    return Space(numbers, idf.astype(np.float32), column, near, cosine), held


FOUND = "doc_id long, text_hash long, item_id long, lcs_share double, answer_share double, first_word long, last_word long"


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``doc_id, text_hash, item_id, lcs_share, answer_share, first_word, last_word``: a row per document and benchmark item found in it.

    All passages of all texts are searched; a document without a finding has no row. Null, empty and
    blank texts and items hold nothing. Repeated rows give repeated findings; an empty table on either
    side gives an empty result. One narrow pass for term counts, one for the search; no text is shuffled.
    """
    spark = session(docs.sparkSession).sparkContext
    texts = view(docs)
    model = spark.broadcast(searcher(texts, benchmark, cosine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = model.value
        for batch in batches:
            ids, hashes = batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist()
            rows = []
            for doc_id, text_hash, found in zip(ids, hashes, finder.search(batch.column("text").to_pylist())):
                rows += [(doc_id, text_hash, *f) for f in found]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
            names = ["doc_id", "text_hash", "item_id", "lcs_share", "answer_share", "first_word", "last_word"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return texts.mapInArrow(run, FOUND)


def clean(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item was found."""
    found = stage(contaminated(docs, benchmark, cosine).select("doc_id", "text_hash").distinct(), "contaminated")
    rows = docs.withColumn("text_hash", F.xxhash64("text"))
    return attach(rows, found, ["doc_id", "text_hash"], "left_anti").select(*docs.columns)
