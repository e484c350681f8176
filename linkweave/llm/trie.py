"""Prefix trie of rebuilt conversations, with subtree totals by parallel tree contraction."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkweave.llm.common import session, stage
from linkweave.operators.ranking import PIECE, POSITION, lay_out, number_rows
from linkweave.operators.skew import lookup

# Conversations are rebuilt on the first of every so many, with fewer than HEADS of its turns.
FAMILY, HEADS = 100, 6
# Ids are joined into strings of about so many bytes before they are hashed.
CHUNK_BYTES = 1 << 16
# What is summed over a subtree, and what waits on the edge above a node for the same sums.
TOTALS = ("n_leaves", "saved_tokens")
EDGES = tuple(f"edge_{t}" for t in TOTALS)


def _node(depth: Column, one: Column, two: Column) -> Column:
    """The name of a prefix: 128 bits of its depth and of two sums over its turns."""
    one, two = one.cast("decimal(38,0)"), two.cast("decimal(38,0)")
    return F.struct(F.xxhash64(depth, one, two).alias("a"), F.xxhash64(two, one, depth, F.lit(1)).alias("b"))


def _root() -> Column:
    return _node(F.lit(0).cast("long"), F.lit(0), F.lit(0))


def _family() -> Column:
    return F.col("conv_id") - F.col("conv_id") % FAMILY


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, depth, one, two, tokens`` of each rebuilt turn, with two hashes of its place, role and text; and
    ``conv_id, length`` of each rebuilt conversation.

    Texts are reduced to hashes and lengths first; only those are shuffled.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.xxhash64(F.lit(1), role, text).alias("u"), F.xxhash64(F.lit(2), role, text).alias("v"), F.length(text).cast("long").alias("tokens"),
    )
    numbered = number_rows(turns, [F.asc_nulls_first("turn"), F.asc("role"), F.asc("u"), F.asc("v")], "pos", ["conv_id"])
    placed = stage(numbered.select("conv_id", "pos", "u", "v", "tokens", _family().alias("family")), "placed")
    taken = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("long")
    convs = stage(placed.groupBy("conv_id", "family").agg(F.count(F.lit(1)).alias("n")).withColumn("taken", taken), "convs")
    first = F.max(F.when(F.col("conv_id") == F.col("family"), F.col("n")))
    families = stage(convs.groupBy("family").agg(F.coalesce(first, F.lit(0)).alias("there"), F.sum("n").alias("rows")), "families")

    # a family has at most FAMILY conversations on either side of zero, and fewer than HEADS turns to share
    heads = placed.where((F.col("conv_id") == F.col("family")) & (F.col("pos") < HEADS)).select("family", "pos", "u", "v", "tokens")
    shared = convs.join(heads, "family").where("pos <= taken").select("conv_id", F.col("pos").alias("depth"), "u", "v", "tokens")
    own = lookup(placed.withColumn("taken", taken).where("pos > taken"), families, ["family"], ["conv_id", "pos"], "inner", "rows")
    own = own.select("conv_id", (F.col("pos") - F.col("taken") + F.least("taken", "there")).alias("depth"), "u", "v", "tokens")
    rows = shared.unionByName(own).select(
        "conv_id", "depth", "tokens", *(F.xxhash64(F.lit(i), "depth", "u", "v").cast("decimal(20,0)").alias(name) for i, name in enumerate(("one", "two")))
    )
    length = F.least("taken", "there") + F.greatest(F.col("n") - F.col("taken"), F.lit(0))
    return rows, stage(convs.join(families.drop("rows"), "family").select("conv_id", length.cast("long").alias("length")), "lengths")


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, tokens, node, parent``: every prefix of every conversation, by running sums over its pieces."""
    pieces = lay_out(turns, ["conv_id"], [F.col("depth")])
    sums = pieces.groupBy("conv_id", PIECE).agg(F.sum("one").alias("s1"), F.sum("two").alias("s2"))
    before = Window.partitionBy("conv_id").orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)  # one row a piece
    shifts = sums.select("conv_id", PIECE, *(F.coalesce(F.sum(s).over(before).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).alias(s) for s in ("s1", "s2")))
    within = Window.partitionBy("conv_id", PIECE).orderBy(POSITION).rowsBetween(Window.unboundedPreceding, 0)
    running = pieces.withColumn("r1", F.sum("one").over(within)).withColumn("r2", F.sum("two").over(within))
    joined = running.join(shifts, ["conv_id", PIECE])
    one, two = F.col("s1") + F.col("r1"), F.col("s2") + F.col("r2")
    return stage(
        joined.select(
            "conv_id", "depth", "tokens", _node(F.col("depth"), one, two).alias("node"),
            _node(F.col("depth") - 1, one - F.col("one"), two - F.col("two")).alias("parent"),
        ),
        "prefixes",
    )


def trie_nodes(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """``node, parent, depth, conv_id, n_convs, tokens, n_children`` of each node, the root included. Staged."""
    inner = rows.groupBy("node").agg(
        F.struct(F.min("parent.a").alias("a"), F.min("parent.b").alias("b")).alias("parent"),  # the same in all rows
        F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("tokens").alias("tokens"),
    )
    top = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    top = top.select(
        _root().alias("node"), F.lit(None).cast("struct<a:bigint,b:bigint>").alias("parent"), F.lit(0).cast("long").alias("depth"),
        "conv_id", "n_convs", F.lit(0).cast("long").alias("tokens"),
    )
    nodes = stage(inner.unionByName(top), "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    return stage(nodes.join(children, "node", "left").fillna({"n_children": 0}), "trie")


def _chains(state: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Compress: each node with one child, the root apart, points to that child; pointers double until they reach the
    end of their chain. Returns ``node, end`` with the totals from the node down to before the end, and the chains' tops with ``end``.

    Only pointers that are still on their way move on. At any time no two of them have the same target.
    """
    unary = state.where("n = 1 and parent is not null")
    if unary.isEmpty():
        return None
    below = state.select(F.col("node").alias("end"), *(F.col(e).alias(f"of_{e}") for e in EDGES), (F.col("n") != 1).alias("there"))
    step = unary.join(below, F.col("only") == F.col("end")).select(
        "node", "end", "there", *((F.col(t) + F.col(f"of_edge_{t}")).alias(t) for t in TOTALS)
    )
    step = first = stage(step, "chain")
    arrived = [step.where("there").drop("there")]
    while not (moving := step.where("not there").drop("there")).isEmpty():
        targets = moving.withColumn("there", F.lit(False))
        for part in arrived:
            targets = targets.unionByName(part.withColumn("there", F.lit(True)))
        targets = targets.select(F.col("node").alias("end"), F.col("end").alias("next"), "there", *(F.col(t).alias(f"of_{t}") for t in TOTALS))
        moved = moving.join(targets, "end").select("node", F.col("next").alias("end"), "there", *((F.col(t) + F.col(f"of_{t}")).alias(t) for t in TOTALS))
        step = stage(moved, "chain")
        arrived.append(step.where("there").drop("there"))
    whole = arrived[0]
    for part in arrived[1:]:
        whole = whole.unionByName(part)
    inner = first.where("not there").select(F.col("end").alias("node"))
    return whole, whole.join(inner, "node", "left_anti")


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """``node`` and its own numbers (``TOTALS``) summed over its subtree, for staged ``node, parent`` and ``TOTALS``.

    Chains of nodes with one child are compressed, then all leaves are raked into their parents, until the root is
    left; each time at least half of the nodes go, as all others have two children by then. A raked leaf's total is known at once; nodes of chains
    get theirs in reverse order, from the total at the end of their chain. Every step is a join on unique keys or a sum, so a
    parent with a third of all nodes below it is no single task's work.
    """
    live = nodes.select("node", "parent", *TOTALS, *(F.lit(0).cast("long").alias(e) for e in EDGES))
    known: list[DataFrame] = []
    chains: list[DataFrame] = []
    while True:
        kids = live.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(
            F.count(F.lit(1)).alias("n"), F.struct(F.min("node.a").alias("a"), F.min("node.b").alias("b")).alias("only")
        )  # ``only`` is the child where there is one
        state = stage(live.join(kids, "node", "left").fillna({"n": 0}), "live")
        rest = state.where("n != 1 or parent is null").drop("only")
        if (found := _chains(state)) is not None:
            whole, tops = found
            chains.append(whole)
            lifted = tops.join(state.select("node", "parent", *EDGES), "node").select(
                F.col("end").alias("node"), F.col("parent").alias("up"), *((F.col(t) + F.col(f"edge_{t}")).alias(f"new_{t}") for t in TOTALS)
            )
            rest = stage(
                rest.join(lifted, "node", "left").select(
                    "node", F.coalesce("up", "parent").alias("parent"), *TOTALS, *(F.coalesce(f"new_{t}", f"edge_{t}").alias(f"edge_{t}") for t in TOTALS), "n"
                ),
                "rest",
            )
        leaves = rest.where("n = 0 and parent is not null")
        known.append(leaves.select("node", *TOTALS))
        gains = leaves.groupBy(F.col("parent").alias("node")).agg(*(F.sum(F.col(t) + F.col(f"edge_{t}")).alias(f"new_{t}") for t in TOTALS))
        inner = rest.where("n > 0 or parent is null").join(gains, "node", "left")
        live = stage(inner.select("node", "parent", *((F.col(t) + F.coalesce(f"new_{t}", F.lit(0))).alias(t) for t in TOTALS), *EDGES), "inner")
        if live.where("parent is not null").isEmpty():
            break
    totals = live.select("node", *TOTALS)
    for part in known:
        totals = totals.unionByName(part)
    for chain in reversed(chains):
        fans = chain.groupBy(F.col("end")).agg(F.count(F.lit(1)).alias("rows"))
        ends = stage(fans.join(totals.select(F.col("node").alias("end"), *(F.col(t).alias(f"of_{t}") for t in TOTALS)), "end"), "ends")
        grown = lookup(chain, ends, ["end"], ["node"], "inner", "rows")
        totals = totals.unionByName(stage(grown.select("node", *((F.col(t) + F.col(f"of_{t}")).alias(t) for t in TOTALS)), "totals"))
    return totals


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``a, b, conv_id`` to ``a, b, first, ids``: neighbours of one node joined by commas."""
    key, ids, size = None, [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"a": [key[0]], "b": [key[1]], "first": [int(ids[0])], "ids": [",".join(ids)]})

    for batch in batches:
        for a, b, conv in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "conv_id"))):
            if ids and (key != (a, b) or size > CHUNK_BYTES):
                yield out()
                ids, size = [], 0
            key = (a, b)
            ids.append(str(conv))
            size += len(ids[-1]) + 1
    if ids:
        yield out()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings in order to ``a, b, ends_sha256``; one running hash, never a whole list."""
    key, running = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"a": [key[0]], "b": [key[1]], "ends_sha256": [running.hexdigest()]})

    for batch in batches:
        for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids"))):
            if key == (a, b):
                running.update(b",")
            else:
                if key is not None:
                    yield out()
                key, running = (a, b), hashlib.sha256()
            running.update(ids.encode())
    if key is not None:
        yield out()


def end_hashes(ends: DataFrame) -> DataFrame:
    """``node, ends_sha256`` from ``node, conv_id`` of the conversations that end there.

    The ids are sorted in pieces by range, joined within them, and the few long strings of a node hashed one after the other:
    a hash over a list cannot be split further, but no task holds the list.
    """
    order = ["a", "b", "conv_id"]
    pieces = ends.select("node.a", "node.b", "conv_id").repartitionByRange(*order).sortWithinPartitions(*order)
    strings = pieces.mapInArrow(_joined, "a long, b long, first long, ids string")
    dealt = strings.repartition("a", "b").sortWithinPartitions("a", "b", "first")
    return dealt.mapInArrow(_hashed, "a long, b long, ends_sha256 string").select(F.struct("a", "b").alias("node"), "ends_sha256")


def build(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``.

    Only ``conv_id, turn, role, text`` are read. Turns go by ``turn``, null first; equal turns by role, then by a hash of role and text, so
    repeated rows are repeated turns. A null role or text is empty. Rows without a ``conv_id`` belong to no conversation and are left out;
    an empty table has no node, not even the root. Prefixes are told apart by 128-bit hashes.
    """
    spark = session(conversations.sparkSession)
    turns, lengths = rebuilt_turns(conversations)
    rows = prefixes(turns)
    nodes = trie_nodes(rows, lengths)
    if nodes.isEmpty():
        return _nothing(spark)
    own = nodes.select("node", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("tokens")).alias("saved_tokens"))
    totals = subtree_totals(own)
    last = rows.select("conv_id", F.col("depth").alias("length"), "node").join(lengths, ["conv_id", "length"]).select("node", "conv_id")
    bare = lengths.where("length = 0").select(_root().alias("node"), "conv_id")
    ends = end_hashes(last.unionByName(bare))
    parents = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("rows"))
    named = lookup(nodes, parents, ["parent"], ["node"], "left", "rows")
    return named.join(totals, "node").join(ends, "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def _nothing(spark: SparkSession) -> DataFrame:
    counts = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens".split()
    return spark.createDataFrame([], ", ".join(f"{c} long" for c in counts) + ", ends_sha256 string")


ORACLE = f"""
with steps as (
  select list(list_reduce(list_prepend(i::ubigint, [0, 0, 0, 0, 0, 0, 0, 0]::ubigint[]),
    lambda c, x: case when c % 2 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) order by i) as codes from range(256) t(i)),
seqs as (
  select conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, ''))
    order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as s from conversations where conv_id is not null group by conv_id),
coded as (
  select conv_id, s, (xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::ubigint)),
    lambda c, x: xor(c >> 8, codes[(xor(c & 255, x))::int + 1])), 4294967295::ubigint) % {HEADS})::bigint as h from seqs cross join steps),
rebuilt as (
  select c.conv_id, case when b.s is null then [] else b.s[1:h] end || c.s[h + 1:] as s
  from coded c left join seqs b on b.conv_id = c.conv_id - c.conv_id % {FAMILY}),
prefixes as (select conv_id, d, s[1:d] as p, len(s) as n from (select conv_id, s, unnest(range(0, len(s) + 1)) as d from rebuilt)),
nodes as (
  select p, d, min(conv_id) as conv_id, count(*) as n_convs, any_value(case when d = 0 then 0 else length(p[d].t) end) as tokens,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = d), '')) as ends_sha256 from prefixes group by p, d),
children as (select p[1:d - 1] as p, count(*) as n from nodes where d > 0 group by 1),
own as (select nodes.*, coalesce(children.n, 0) as n_children from nodes left join children on nodes.p = children.p),
above as (select n_children, n_convs, tokens, p[1:u] as p from (select *, unnest(range(0, d + 1)) as u from own)),
totals as (select p, sum((n_children = 0)::bigint)::bigint as n_leaves, sum((n_convs - 1) * tokens)::bigint as saved_tokens from above group by p)
select o.conv_id, o.d::bigint as depth, up.conv_id as parent_conv_id, o.n_convs::bigint as n_convs, o.n_children::bigint as n_children,
  n_leaves, saved_tokens, o.ends_sha256
from own o join totals on totals.p = o.p left join nodes up on o.d > 0 and up.p = o.p[1:o.d - 1]
"""
