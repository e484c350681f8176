"""Quality rules: text measures, and lines that too many documents of one host share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm.common import attach, fits_broadcast, session, stage, view

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
# A line is frequent on a host if more than LINE_DOCS documents with different texts hold it, however large the host is.
LINE_DOCS = 10
# A document is depleted if less than this share of its words stays.
LEAST_LEFT = 1 / 3

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
BASE = f"doc_id long, text_hash long, host string, {MEASURES}, lines array<long>, line_words array<int>"


def line_key(line: bytes) -> int:
    """Hash of a line after lower-casing A-Z and folding white space, as a signed long."""
    return xxhash.xxh64_intdigest(b" ".join(line.lower().split())) - (1 << 63)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
    if len(names) == n:
        return 0
    pairs = ids[:-1] * len(names) + ids[1:]
    pairs = np.unique(pairs, return_inverse=True)[1]
    triples = pairs[:-1] * len(names) + ids[2:]
    _, place, count = np.unique(triples, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[place] > 1)
    covered = np.zeros(n, bool)
    for step in range(3):
        covered[starts + step] = True
    return int(covered.sum())


def lines_of(data: bytes) -> tuple[dict[int, int], int]:
    """The hashes of the lines that have a word, with their words; how many of these lines repeat an earlier one."""
    lines: dict[int, int] = {}
    seen: set[bytes] = set()
    repeats = 0
    for line in data.split(b"\n"):
        count = len(line.split())
        if not count:
            continue
        repeats += line in seen
        seen.add(line)
        key = line_key(line)
        lines[key] = lines.get(key, 0) + count
    return lines, repeats


def measure(text: str | None) -> tuple[tuple[int, ...], list[int], list[int]]:
    data = (text or "").encode()
    words = data.split()
    lines, repeats = lines_of(data)
    spaces = len(data) - len(data.translate(None, SPACE))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    numbers = (len(words), len(text or "") - spaces, symbols, repeats, repeated_words(words))
    return numbers, list(lines), list(lines.values())


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(t) for t in batch.column("text").to_pylist()]
        numbers = [pa.array([r[0][i] for r in rows], pa.int64()) for i in range(5)]
        columns = [batch.column("doc_id"), batch.column("text_hash"), batch.column("host"), *numbers]
        columns += [pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.int32()))]
        names = ["doc_id", "text_hash", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words"]
        yield pa.RecordBatch.from_arrays(columns, names)


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """The measures and line hashes of every row, staged with a row number of its own."""
    narrow = view(docs, host).withColumnRenamed(host, "host")
    base = narrow.withColumn("host", F.col("host").cast("string")).mapInArrow(_measure, BASE)
    return stage(base.withColumn("row", F.monotonically_increasing_id()), "measured")


def frequent_lines(base: DataFrame, line_docs: int = LINE_DOCS) -> DataFrame:
    """``host, line`` above the limit, staged. Copies of one text count as one document, so a group of
    copies does not turn its own lines into boilerplate. Counting distinct texts spreads a hot line by text first."""
    lines = base.select("host", "text_hash", F.explode("lines").alias("line"))
    counts = lines.groupBy("host", "line").agg(F.count_distinct("text_hash").alias("docs"))
    return stage(counts.where(F.col("docs") > line_docs).select("host", "line"), "frequent")


def judge(base: DataFrame, frequent: DataFrame, least_left: float = LEAST_LEFT) -> DataFrame:
    """``base`` with ``removed_lines`` (hashes, null if none), ``removed_words``, ``base_failed``, ``depleted`` and ``kept``."""
    lines = base.select("row", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("x"))
    lines = lines.select("row", "host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    removed = attach(lines, frequent, ["host", "line"], "inner")
    removed = removed.groupBy("row").agg(F.sum("words").alias("removed_words"), F.collect_list("line").alias("removed_lines"))
    removed = stage(removed, "removed")
    judged = attach(base.drop("lines", "line_words"), removed, ["row"], row_bytes=100)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    gone = F.coalesce("removed_words", F.lit(0)).cast("long")
    depleted = (F.col("n_words") - gone) < least_left * F.col("n_words")
    return (
        judged.withColumn("removed_words", gone)
        .withColumn("base_failed", failed)
        .withColumn("depleted", depleted)
        .withColumn("kept", ~failed & ~depleted)
    )


def quality(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the measures, ``base_failed``, ``kept``, ``removed_words``, ``depleted``.

    A null text has no words (so it fails), a null host is a host of its own, repeated rows get a row
    each with equal verdicts, and an empty table gives an empty result. Only ``doc_id``, ``text`` and the host are read.
    """
    session(docs.sparkSession)
    base = measured(docs, host)
    judged = judge(base, frequent_lines(base, line_docs))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words", "depleted"
    )


def _without(text: str, gone: set[int]) -> str:
    return "\n".join(x for x in text.split("\n") if not x.strip() or line_key(x.encode()) not in gone)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for i, drop in enumerate(batch.column("removed_lines").to_pylist()):
            if drop:
                texts[i] = _without(texts[i], set(drop))
        at = batch.schema.get_field_index("text")
        kept = batch.set_column(at, "text", pa.array(texts, pa.string()))
        yield kept.drop_columns(["removed_lines"])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = [list(lines_of((t or "").encode())[0]) for t in batch.column("text").to_pylist()]
        columns = [batch.column("text_hash"), batch.column("host"), pa.array(lines, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["text_hash", "host", "lines"])


def passed(text: str | None, gone: set[int], least_left: float = LEAST_LEFT) -> str | None:
    """The text without the lines ``gone``; none if the rules of `judge` reject it."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if n < MIN_WORDS or 100 * repeated_words(words) > MAX_REPEAT_PERCENT * n:
        return None
    removed = sum(count for key, count in lines_of(data)[0].items() if key in gone) if gone else 0
    if n - removed < least_left * n:
        return None
    return _without(text, gone) if removed else text


def _passing(frequent):
    """The rows that pass, without the lines that are frequent on their host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on_host, none = frequent.value, set()
        for batch in batches:
            hosts = batch.column("host__").to_pylist()
            texts = [passed(t, on_host.get(h, none)) for t, h in zip(batch.column("text").to_pylist(), hosts)]
            at = batch.schema.get_field_index("text")
            rows = batch.set_column(at, "text", pa.array(texts, pa.string())).drop_columns(["host__"])
            yield rows.filter(pa.array([t is not None for t in texts], pa.bool_()))

    return run


def clean(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, without their frequent lines; ``n_chars`` is brought up to date.

    If the frequent lines are few enough to be sent out, one pass over the texts judges and cuts them, and no text is shuffled. Otherwise
    verdicts go back to the rows by id, text and host, so rows that agree in these share them.
    """
    narrow = view(docs, host).withColumnRenamed(host, "host").withColumn("host", F.col("host").cast("string"))
    frequent = frequent_lines(narrow.mapInArrow(_lines, "text_hash long, host string, lines array<long>"))
    if fits_broadcast(frequent):
        on_host: dict[str | None, set[int]] = {}
        for r in frequent.collect():
            on_host.setdefault(r.host, set()).add(r.line)
        sent = docs.sparkSession.sparkContext.broadcast(on_host)
        cut = docs.withColumn("host__", F.col(host).cast("string")).mapInArrow(_passing(sent), docs.schema)
    else:
        cut = _joined(docs, host, frequent).mapInArrow(_cut, docs.schema)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def _joined(docs: DataFrame, host: str, frequent: DataFrame) -> DataFrame:
    """The rows that are kept, with their ``removed_lines``."""
    judged = judge(measured(docs, host), frequent)
    changed = judged.where("not kept or removed_words > 0").select("doc_id", "text_hash", "host", "kept", "removed_lines")
    changed = stage(changed.dropDuplicates(["doc_id", "text_hash", "host"]), "verdicts").withColumnRenamed("host", "host__")
    rows = docs.withColumn("text_hash", F.xxhash64("text")).withColumn("host__", F.col(host).cast("string"))
    rows = attach(rows, changed, ["doc_id", "text_hash", "host__"], row_bytes=100).where(F.coalesce("kept", F.lit(True)))
    return rows.drop("text_hash", "host__", "kept")


ORACLE = rf"""
with base as (select doc_id, coalesce(text, '') as text, source, md5(coalesce(text, '')) as h from documents),
words as (select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from base),
word as (select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as w from words),
win as (select doc_id, i, w as a, lead(w, 1) over p as b, lead(w, 2) over p as c from word window p as (partition by doc_id order by i)),
hot as (select doc_id, a, b, c from win where c is not null group by all having count(*) > 1),
cover as (select distinct win.doc_id, i + k as i from win join hot using (doc_id, a, b, c) cross join range(0, 3) t(k)),
repeats as (select doc_id, count(*) as n from cover group by 1),
line as (select doc_id, source, h, unnest(string_split(text, chr(10))) as l from base),
said as (select doc_id, source, h, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) as n,
  regexp_replace(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), '^ | $', '', 'g') as k from line),
full_line as (select * from said where n > 0),
dup as (select doc_id, count(*) - count(distinct l) as n from full_line group by 1),
often as (select source, k from full_line group by source, k having count(distinct h) > {LINE_DOCS}),
gone as (select f.doc_id, sum(n) as n from full_line f join often o on f.source is not distinct from o.source and f.k = o.k group by 1),
m as (select b.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(dup.n, 0)::bigint as n_dup_lines,
  coalesce(repeats.n, 0)::bigint as n_repeat_words, coalesce(gone.n, 0)::bigint as removed_words
  from base b join words using (doc_id) left join dup using (doc_id) left join repeats using (doc_id) left join gone using (doc_id)),
v as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed,
  n_words - removed_words < {LEAST_LEFT!r}::double * n_words as depleted from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not depleted as kept, removed_words, depleted from v
"""
