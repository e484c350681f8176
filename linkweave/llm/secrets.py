"""Secret scans: a trigram inverted index narrows the documents, DataFrame functions verify them."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkweave.llm.common import KEY, attach, stage, view


@dataclass(frozen=True)
class Rule:
    """``pattern`` is read alike by Java and Python. A match counts if its ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# A run of 24 or more is what `[0-9a-f]+` finds with 24 or more characters, as runs are maximal; so for `access`.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# Public formats of widely used credentials, beyond the three base kinds.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + MORE

# --- Boolean trigram queries: a set of clauses, each a set of trigrams; one clause must be there in full.
Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])
MOST_STRINGS, MOST_CLAUSES, CLASS_SIZE = 16, 64, 8


def _either(a: Query, b: Query) -> Query:
    clauses = a | b
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MOST_CLAUSES:  # leaving one out only makes more candidates
        return a if len(a) <= len(b) else b
    made: Query = frozenset()
    for x, y in itertools.product(a, b):
        made = _either(made, frozenset([x | y]))
    return made


def _spelled(strings: set[str]) -> Query:
    made: Query = frozenset()
    for s in strings:
        made = _either(made, frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]))
    return made


def _choices(node) -> set[str] | None:
    """The strings that one node stands for, if they are few."""
    kind, value = node
    if kind is op.LITERAL:
        return {chr(value).lower()}
    if kind is op.IN:
        letters: set[str] = set()
        for what, v in value:
            if what is op.LITERAL:
                letters.add(chr(v).lower())
            elif what is op.RANGE and v[1] - v[0] < CLASS_SIZE:
                letters |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None
        return letters if len(letters) <= CLASS_SIZE else None
    if kind is op.SUBPATTERN:
        return _strings(value[3])
    if kind is op.BRANCH:
        parts = [_strings(p) for p in value[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[1] == 1:
        once = _strings(value[2])
        return None if once is None else once | ({""} if value[0] == 0 else set())
    return None


def _strings(nodes) -> set[str] | None:
    made = {""}
    for node in nodes:
        more = _choices(node)
        if more is None or len(made) * len(more) > MOST_STRINGS:
            return None
        made = {a + b for a in made for b in more}
    return made


def _derive(nodes) -> Query:
    found, run = ANY, {""}
    for node in nodes:
        kind, value = node
        more = _choices(node)
        if more is not None and len(run) * len(more) <= MOST_STRINGS:
            run = {a + b for a in run for b in more}
            continue
        found, run = _both(found, _spelled(run)), {""}
        if more is not None:
            run = more
        elif kind is op.SUBPATTERN:
            found = _both(found, _derive(value[3]))
        elif kind is op.BRANCH:
            part: Query = frozenset()
            for p in value[1]:
                part = _either(part, _derive(p))
            found = _both(found, part)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
            found = _both(found, _derive(value[2]))
    return _both(found, _spelled(run))


def trigram_query(pattern: str) -> Query:
    """The clauses of lower-case trigrams of which every text that matches has one in full. ``ANY``
    (one empty clause) if no trigram is mandatory."""
    return _derive(_parser.parse(pattern))


def mandatory(rules: Sequence[Rule]) -> tuple[dict[str, Query], list[Rule]]:
    """The queries of the rules that have one, and the rules that must scan."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    return {k: q for k, q in queries.items() if frozenset() not in q}, [r for r in rules if frozenset() in queries[r.kind]]


def build_index(docs: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """Postings ``trigram, doc_id, text_hash`` of whole texts for the trigrams that rules ask for;
    postings of other trigrams would never be read. One pass, no shuffle."""
    low = docs.select(*KEY, F.lower("text").alias("low"))
    there = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    return low.select(*KEY, F.explode(there).alias("trigram"))


def candidates(spark: SparkSession, postings: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """Intersect postings: ``doc_id, text_hash, kinds`` for the rules with a clause whose trigrams are all there.

    The clauses come from the rules alone, so they are a small broadcast table; postings shuffle by
    document, after one bit per trigram has been combined per map task. No posting list meets in one task.
    """
    terms = [
        F.struct(F.lit(t).alias("trigram"), F.lit(kind).alias("kind"), F.lit(c).alias("clause"), F.lit(1 << i).cast("decimal(38,0)").cast("long").alias("bit"), F.lit((1 << len(clause)) - 1).cast("long").alias("all_bits"))
        for kind, query in queries.items()
        for c, clause in enumerate(sorted(query, key=sorted))
        for i, t in enumerate(sorted(clause)[:60])  # fewer terms only admit more candidates
    ]
    wanted = spark.range(1).select(F.explode(F.array(*terms)).alias("t")).select("t.*")
    wanted = wanted.withColumn("all_bits", F.least("all_bits", F.lit((1 << 60) - 1)))
    seen = postings.join(F.broadcast(wanted), "trigram").groupBy(*KEY, "kind", "clause", "all_bits").agg(F.bit_or("bit").alias("bits"))
    return seen.where("bits = all_bits").groupBy(*KEY).agg(F.collect_set("kind").alias("kinds"))


def _pieces(rule: Rule, number: int, enabled: Column) -> Column:
    """The matches of a rule in ``text`` as (kind, i, gap before it, its length, its value's length)."""
    pattern = F.lit(rule.pattern)
    zipped = F.arrays_zip(
        F.split("text", rule.pattern, -1).alias("gap"),
        F.regexp_extract_all("text", pattern, F.lit(0)).alias("hit"),
        F.regexp_extract_all("text", pattern, F.lit(rule.group)).alias("value"),
    )
    rows = F.transform(
        zipped,
        lambda x, i: F.struct(
            F.lit(number).alias("kind_no"), i.alias("i"), F.length(x["gap"]).cast("long").alias("gap"),
            F.length(x["hit"]).cast("long").alias("hit"), F.length(x["value"]).alias("value"),
        ),
    )
    return F.when(enabled & F.col("text").rlike(rule.pattern), F.filter(rows, lambda x: x["hit"].isNotNull()))


def spans(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per match: ``doc_id, text_hash, kind_no, kind, start, end`` in code points, end exclusive.

    Matches are leftmost and do not overlap within a kind; those with a short value are dropped after
    that. Rules with a trigram query run on the documents that the index gives, the others on all.
    """
    spark = docs.sparkSession
    docs = view(docs)
    queries, _ = mandatory(rules)
    trigrams = sorted({t for q in queries.values() for clause in q for t in clause})
    rows = docs.withColumn("kinds", F.array().cast("array<string>"))
    if trigrams:
        found = stage(candidates(spark, build_index(docs, trigrams), queries), "candidates")
        rows = attach(docs, found, KEY, row_bytes=64)
    parts = []
    for number, rule in enumerate(rules):
        asked = F.array_contains("kinds", rule.kind) if rule.kind in queries else F.lit(True)
        parts.append(F.coalesce(_pieces(rule, number, asked), F.array().cast("array<struct<kind_no:int,i:int,gap:bigint,hit:bigint,value:int>>")))
    hits = rows.select(*KEY, F.explode(F.concat(*parts)).alias("x")).select(*KEY, "x.*").distinct()  # repeated rows give their matches once
    order = Window.partitionBy(*KEY, "kind_no").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = hits.withColumn("end", F.sum(F.col("gap") + F.col("hit")).over(order))
    least = F.element_at(F.array(*(F.lit(r.least) for r in rules)), F.col("kind_no") + 1)
    kind = F.element_at(F.array(*(F.lit(r.kind) for r in rules)), F.col("kind_no") + 1)
    return placed.where(F.col("value") >= least).select(*KEY, "kind_no", kind.alias("kind"), (F.col("end") - F.col("hit")).alias("start"), "end")


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, matches per base kind, ``base_sha256`` of the base spans and all ``spans``.

    A null text is empty. Repeated rows get the same result each; rows of one id with other texts get
    their own. An empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
    """
    found = spans(docs, rules)
    base = len(BASE)
    listed = F.sort_array(F.collect_list(F.struct("start", "kind_no", F.concat_ws(":", "kind", "start", "end").alias("said"))))
    per_doc = found.groupBy(*KEY).agg(
        *(F.count_if(F.col("kind_no") == i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)), listed.alias("all")
    )
    text_of = lambda items: F.array_join(F.transform(items, lambda x: x["said"]), ",")
    per_doc = per_doc.select(
        *KEY, *(f"n_{r.kind}" for r in BASE),
        text_of(F.filter("all", lambda x: x["kind_no"] < base)).alias("base"), text_of(F.col("all")).alias("spans"),
    )
    rows = attach(view(docs).select(*KEY), stage(per_doc, "spans"), KEY, row_bytes=200)
    return rows.select(
        "doc_id",
        *(F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in BASE),
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def _oracle() -> str:
    parts = []
    for number, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(
            f"select doc_id, {number} as kind_no, '{rule.kind}' as kind, {rule.least} as least, "
            f"unnest(range(1, len(hits) + 1)) as i, unnest(hits) as hit, unnest(groups) as val, "
            f"unnest(gaps[1:len(hits)]) as gap from (select doc_id, string_split_regex(text, '{pattern}') as gaps, "
            f"regexp_extract_all(text, '{pattern}', 0) as hits, regexp_extract_all(text, '{pattern}', {rule.group}) as groups "
            f"from documents where regexp_matches(text, '{pattern}'))"
        )
    union = " union all ".join(parts)
    return f"""
with pieces as ({union}),
placed as (select *, sum(length(gap) + length(hit)) over (partition by doc_id, kind_no order by i) as stop from pieces),
kept as (select doc_id, kind_no, kind, (stop - length(hit))::bigint as start, stop::bigint as stop from placed where length(val) >= least),
said as (select doc_id, count(*) filter (kind_no = 0) as a, count(*) filter (kind_no = 1) as b, count(*) filter (kind_no = 2) as c,
  coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, kind_no) filter (kind_no < 3), '') as base,
  string_agg(kind || ':' || start || ':' || stop, ',' order by start, kind_no) as spans from kept group by doc_id)
select d.doc_id, coalesce(a, 0)::bigint as n_assign, coalesce(b, 0)::bigint as n_access, coalesce(c, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join said using (doc_id)
"""


ORACLE = _oracle()
