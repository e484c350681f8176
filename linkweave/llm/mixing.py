"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.llm.common import attach, session, stage

SEED = 20240229
# exp(-rate) must stay a normal double; a larger rate is the sum of several draws.
RATE_PER_DRAW = 500.0


def uniform(seed: int, draw: Column | int) -> Column:
    """A number in [0, 1) with 52 bits from a hash of the seed, the draw and the document's id.
    Rows without an id are told apart by their text."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text")), F.lit(""))
    draw = draw if isinstance(draw, Column) else F.lit(draw)
    digits = F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), draw.cast("string"), name), 256), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson(rate: Column, u: Column) -> Column:
    """The smallest k with ``u`` below the distribution function: inversion. The steps reach 12
    standard deviations and 40 beyond the mean, where no double below 1 is left."""
    first = F.struct(F.lit(0).cast("long").alias("k"), F.exp(-rate).alias("p"), F.exp(-rate).alias("c"))
    steps = F.sequence(F.lit(1), F.ceil(rate + 12 * F.sqrt(rate)).cast("int") + 40)

    def step(at: Column, i: Column) -> Column:
        p = at["p"] * rate / i
        return F.when(u < at["c"], at).otherwise(F.struct(i.cast("long").alias("k"), p.alias("p"), (at["c"] + p).alias("c")))

    return F.aggregate(steps, first, step, lambda at: at["k"])


def rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, total: float | None = None) -> DataFrame:
    """``source, rate``: how often a document of the source is to occur on average, so that the sources
    have their ``weights`` in an expected ``total`` of documents. Default: equal weights, as many
    documents as there are. A source that ``weights`` leaves out has rate 0; null is a source of its own.
    """
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    if weights is not None:
        rows = [(name, float(weight)) for name, weight in weights.items()]
        listed = docs.sparkSession.createDataFrame(rows, "listed string, weight double")
        sizes = sizes.join(listed, F.col("source").eqNullSafe(F.col("listed")), "left").fillna({"weight": 0.0})
    else:
        sizes = sizes.withColumn("weight", F.lit(1.0))
    sizes = stage(sizes.select("source", "rows", "weight"), "sizes")
    whole = sizes.agg(
        F.sum("weight").alias("weights"), F.sum(F.when(F.col("weight") > 0, F.col("rows")).otherwise(0)).cast("double").alias("found")
    ).select("weights", (F.lit(float(total)) if total is not None else F.col("found")).alias("wanted"))
    # one row beside the sources
    return sizes.join(F.broadcast(whole), F.col("weights") > 0, "left").select(
        "source", F.coalesce(F.col("wanted") * F.col("weight") / (F.col("weights") * F.col("rows")), F.lit(0.0)).alias("rate")
    )


def mix(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    total: float | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Repeat each document a Poisson number of times with its source's rate as mean, and shuffle all.

    Returns the columns of ``docs`` with ``n_copies`` and ``copy`` (1 to n_copies); clashing columns of
    ``docs`` are replaced. The draw depends on the seed and the id alone, so a task that runs again
    gives the same rows; rows with one id share their draw, rows without an id draw by their text.
    Rows go to a partition and a place in it by a hash of id, text and copy. An empty table stays
    empty; a null or empty text is a text like any other.
    """
    session(docs.sparkSession)
    docs = docs.drop("n_copies", "copy", "rate__", "place__")
    table = stage(rates(docs.select("source"), weights, total).withColumnRenamed("rate", "rate__"), "rates")
    rated = attach(docs, table, ["source"])
    parts = F.greatest(F.ceil(F.col("rate__") / RATE_PER_DRAW), F.lit(1)).cast("int")
    draws = F.transform(F.sequence(F.lit(1), parts), lambda i: poisson(F.col("rate__") / parts, uniform(seed, i)))
    counted = rated.withColumn("n_copies", F.aggregate(draws, F.lit(0).cast("long"), lambda a, b: a + b)).where("n_copies > 0")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))))
    placed = copies.withColumn("place__", F.xxhash64(F.lit(seed), "doc_id", "text", "copy"))
    return placed.repartition("place__").sortWithinPartitions("place__").drop("rate__", "place__")


ORACLE = f"""
with sizes as (select source, count(*) as n_rows from documents group by source),
whole as (select count(*)::double as weights, sum(n_rows)::double as wanted from sizes),
rated as (
  select d.*, wanted * 1.0::double / (weights * n_rows) as rate,
    ('0x' || substr(sha256(concat_ws(':', '{SEED}', '1', coalesce(d.doc_id::varchar, md5(d.text), ''))), 1, 13))::bigint::double
      / {1 << 52}::double as u
  from documents d join sizes s on d.source is not distinct from s.source cross join whole),
steps as (
  with recursive r(rate, i, p, c) as (
    select distinct rate, 0, exp(-rate), exp(-rate) from rated
    union all select rate, i + 1, p * rate / (i + 1), c + p * rate / (i + 1) from r
    where i < ceil(rate + 12 * sqrt(rate)) + 40)
  select * from r),
counted as (
  select doc_id, text, lang, source, n_chars, (select count(*) from steps s where s.rate = rated.rate and s.c <= rated.u) as n_copies from rated)
select doc_id, text, lang, source, n_chars, n_copies::bigint as n_copies, unnest(range(1, n_copies + 1))::bigint as copy from counted where n_copies > 0
"""
