"""Table constraints, reported as rows ``constraint, key, n``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.constants import MAX_KEY_CHARS

REQUIRED = ("short_id", "original_url", "user_id")
LIMITED = ("short_id", "user_id")


def check_unique(links: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once. Copies are counted before the shuffle."""
    return (
        links.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("key"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.lit(f"{column} unique").alias("constraint"), "key", "n")
    )


def _violations(links: DataFrame, key: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """One pass over the table: a row for every broken rule of every row."""
    broken = F.filter(
        F.array(*(F.when(rule, F.lit(name)) for name, rule in rules)), lambda name: name.isNotNull()
    )
    return links.select(F.explode(broken).alias("constraint"), F.col(key).cast("string").alias("key"))


def check_not_null(links: DataFrame, key: str, columns=REQUIRED) -> DataFrame:
    return _violations(links, key, [(f"{c} not null", F.col(c).isNull()) for c in columns])


def check_length(links: DataFrame, key: str, columns=LIMITED, limit: int = MAX_KEY_CHARS) -> DataFrame:
    return _violations(links, key, [(f"{c} length", F.char_length(c) > limit) for c in columns])


def check_links(links: DataFrame, key: str, unique_url: bool = True) -> DataFrame:
    """All constraints of the link table: ``constraint, key``."""
    parts = [check_unique(links, "short_id").select("constraint", "key")]
    if unique_url:
        parts.append(check_unique(links, "original_url").select("constraint", "key"))
    parts += [check_not_null(links, key), check_length(links, key)]
    return reduce(DataFrame.unionByName, parts)
