"""Unique constraints of a table that grows load by load: a load is checked without reading the table again."""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.session import scratch_scope, stage
from linkweave.sources.files import numbered, put_new, read_text

# A row of a filter: so many 64-bit words, in each of which a key sets one bit. With 16 keys a row, one absent key in 400 seems to be there.
WORDS, KEYS_PER_ROW = 4, 16
# The least filter has 2 ** LEAST_BITS rows (those without a key are not written), so that the keys of a large load do not all ask one row of a small one.
LEAST_BITS = 10
# Up to so many possible hits become a filter of the scan, which opens only their pages; more are joined.
FEW_HITS = 200
PAGE_ROWS = 2000

_COUNTS = "code long, key string, n long"
_FILTER = "block long, " + ", ".join(f"w{i} long" for i in range(WORDS))


class KeyBook:
    """The keys of a unique column, load by load, each load with a Bloom filter of its own.

    A load's keys are reduced to distinct ones with their number, and written in the order of their hashes. Its filter is a table: a hash
    picks the row, further bits of a second hash set a bit in each of the row's words, so filters of any size are built and asked by a shuffle on
    the row, and none is sent anywhere whole. Of the earlier keys only those are read that a filter says may be there, from the loads whose filter says so.

    A load counts once its mark has been renamed into place; a crash before it leaves nothing. A load offered again is compared with what was written, and
    left alone if it is the same. Loads are numbered from 0 without gaps; one writer. Null keys break no unique constraint
    and are left out; an empty string is a key.
    """

    def __init__(self, spark: SparkSession, path: str, column: str, page_rows: int = PAGE_ROWS):
        self.spark, self.path, self.column, self.page_rows = spark, path.rstrip("/"), column, page_rows

    # --- what is there

    def _note(self, kind: str, load: int) -> dict:
        return json.loads(read_text(self.spark, f"{self.path}/{kind}/{load:012d}.json"))

    def _segments(self, before: int) -> list[dict]:
        """The newest merged segment and the loads after it, all before ``before``."""
        merged = numbered(self.spark, f"{self.path}/merged")
        if merged and before <= merged[-1]:
            raise ValueError(f"loads up to {merged[-1]} have been merged; load {before} cannot be told from them")
        kept = [self._note("merged", merged[-1])] if merged else []
        start = merged[-1] + 1 if merged else 0
        return kept + [self._note("marks", n) for n in numbered(self.spark, f"{self.path}/marks") if start <= n < before]

    def _read(self, kind: str, schema: str, segments: list[dict]) -> DataFrame:
        folder = f"{self.path}/{kind}"
        reader = self.spark.read.schema(f"{schema}, seg string").option("basePath", folder)
        if not segments:
            return self.spark.createDataFrame([], f"{schema}, seg string")
        return reader.parquet(*(f"{folder}/seg={s['name']}" for s in segments))

    # --- writing

    def _write(self, counts: DataFrame) -> dict:
        """A new segment; no mark names it yet."""
        name = uuid.uuid4().hex
        folder = f"{self.path}/counts/seg={name}"
        ordered = counts.select("code", "key", "n").repartitionByRange("code", "key").sortWithinPartitions("code", "key")
        ordered.write.option("parquet.page.row.count.limit", str(self.page_rows)).parquet(folder)
        written = self.spark.read.schema(_COUNTS).parquet(folder)
        digest = F.coalesce(F.sum(F.xxhash64("key", "n").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
        n, total = written.agg(F.count(F.lit(1)), digest).first()
        bits = max(LEAST_BITS, math.ceil(math.log2(max(n, 1) / KEYS_PER_ROW)))
        masks = written.select(_block(F.lit(bits)).alias("block"), *(_bit(i).alias(f"w{i}") for i in range(WORDS)))
        rows = masks.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))
        rows.write.parquet(f"{self.path}/filters/seg={name}")
        return {"name": name, "bits": bits, "n": n, "digest": str(total)}

    def add(self, rows: DataFrame, load: int) -> None:
        """Write the keys of a load. ``rows`` may hold a key any number of times; copies are counted before the shuffle."""
        done = numbered(self.spark, f"{self.path}/marks")
        if load < 0 or load > len(done):
            raise ValueError(f"load {load} has no load before it; the next is {len(done)}")
        key = F.col(self.column)
        counts = rows.where(key.isNotNull()).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).withColumn("code", F.xxhash64("key"))
        made = self._write(counts)
        if load < len(done):
            held = self._note("marks", load)
            if (held["n"], held["digest"]) != (made["n"], made["digest"]):
                raise ValueError(f"load {load} was written with other keys")
            return  # the copy just written has no mark and does not exist
        put_new(self.spark, f"{self.path}/marks/{load:012d}.json", json.dumps(made))

    def merge(self) -> None:
        """Make one segment of all loads but the newest, so that a check asks fewer filters. The newest may still be checked."""
        last = len(numbered(self.spark, f"{self.path}/marks")) - 2
        if last < 0 or numbered(self.spark, f"{self.path}/merged")[-1:] == [last]:
            return
        counts = self._read("counts", _COUNTS, self._segments(last + 1)).groupBy("code", "key").agg(F.sum("n").alias("n"))
        put_new(self.spark, f"{self.path}/merged/{last:012d}.json", json.dumps(self._write(counts)))

    # --- checking

    def possible(self, load: int) -> DataFrame:
        """``seg, code, key``: keys of the load that the filter of an earlier segment may hold, staged."""
        earlier = self._segments(load)
        fresh = self._read("counts", _COUNTS, [self._note("marks", load)]).drop("seg", "n")
        sizes = sorted({s["bits"] for s in earlier})
        size_of = F.create_map(*(F.lit(x) for s in earlier for x in (s["name"], s["bits"]))) if earlier else F.lit(None)
        if not earlier:
            return stage(fresh.limit(0).select(F.lit("").alias("seg"), "code", "key"), "possible")
        # one row for each size of filter in use; filters of a size share their rows' numbers
        asked = fresh.withColumn("bits", F.explode(F.array(*(F.lit(b) for b in sizes))))
        asked = asked.select("code", "key", "bits", _block(F.col("bits")).alias("block"), *(_bit(i).alias(f"b{i}") for i in range(WORDS)))
        filters = self._read("filters", _FILTER, earlier).withColumn("bits", size_of[F.col("seg")])
        held = F.lit(True)
        for i in range(WORDS):
            held = held & (F.col(f"w{i}").bitwiseAND(F.col(f"b{i}")) == F.col(f"b{i}"))
        return stage(asked.join(filters, ["bits", "block"]).where(held).select("seg", "code", "key"), "possible")

    def earlier(self, load: int) -> DataFrame:
        """``code, key, n`` of the possible hits that earlier segments really have; only segments with a possible hit are opened."""
        possible = self.possible(load)
        hit = {r.seg for r in possible.select("seg").distinct().collect()}  # names of segments, not keys
        segments = [s for s in self._segments(load) if s["name"] in hit]
        stored = self._read("counts", _COUNTS, segments)
        few = possible.select("seg", "code").distinct().limit(FEW_HITS + 1).collect()
        if len(few) <= FEW_HITS:
            wanted = [F.col("code") == F.lit(r.code) for r in few] or [F.lit(False)]
            while len(wanted) > 1:  # a balanced tree of equalities: a list would reach the scan as one range
                wanted = [a | b for a, b in zip(wanted[::2], wanted[1::2])] + wanted[len(wanted) // 2 * 2 :]
            stored = stored.where(wanted[0])
        return stored.join(possible, ["seg", "code", "key"], "left_semi").groupBy("code", "key").agg(F.sum("n").alias("n"))

    def violations(self, load: int) -> DataFrame:
        """``constraint, key, n``: the load's keys that stand in all loads up to it more than once, with their number.

        The same rows as a check of the whole table gives for the keys of this load.
        """
        fresh = self._read("counts", _COUNTS, [self._note("marks", load)]).drop("seg")
        before = self.earlier(load).withColumnRenamed("n", "before")
        n = F.col("n") + F.coalesce("before", F.lit(0))
        found = fresh.join(before, ["code", "key"], "left").select(F.lit(f"{self.column} unique").alias("constraint"), "key", n.alias("n"))
        return found.where("n > 1")


def check_load(book: KeyBook, rows: DataFrame, load: int, target: str) -> DataFrame:
    """Add a load to the book and write its violations to folder ``load=N`` of ``target``, which a second run replaces; for a micro-batch."""
    with scratch_scope(rows.sparkSession):
        book.add(rows, load)
        found = book.violations(load)
        found.write.mode("overwrite").parquet(f"{target}/load={load}")
    return rows.sparkSession.read.schema(found.schema).parquet(f"{target}/load={load}")


def _block(bits: Column) -> Column:
    """The row of a filter with 2 ** ``bits`` rows: the upper bits of the hash."""
    return F.call_function("shiftrightunsigned", F.col("code"), (F.lit(64) - bits).cast("int"))


def _bit(word: int) -> Column:
    """The bit of a key in word ``word``: six bits of a second hash."""
    place = F.shiftright(F.xxhash64("key", F.lit(word)), 20).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)
