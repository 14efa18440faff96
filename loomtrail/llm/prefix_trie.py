"""The prefix trie of conversations, by hashes of fixed-length blocks of turns.

1. Every conversation's turns, in order, are cut into blocks of ``BLOCK`` turns. The digests of its blocks, summed up along the
   conversation (each hashed with its place, 128 bits in all), name every beginning of whole blocks. Conversations that
   share a beginning share its name, so they are grouped by counting, block by block.
2. Where all conversations behind a beginning go on with the same block, its turns are nodes with the same members, and
   one of them stands for all. Only where different blocks follow are turn boundaries refined: the different blocks,
   not the conversations, are cut into turns, and counts of equal beginnings added up.
3. A node belongs to its smallest member. The nodes of one conversation are the end of its path, so sums over a
   subtree are sums over its members of what they own, less what the node's own conversation has above it.
   No step walks the levels of the trie.
4. Ids of conversations that end at a node are sorted by a range shuffle, written in chunks of at most ``CHUNK_IDS`` and
   hashed chunk after chunk, so no task holds the ids of a node.

A conversation may hold most of the turns, or most conversations be equal or begin alike: running sums are split by ranges,
joins per conversation by blocks, and nodes with very many children are joined by broadcast, of which there are at most
1 in ``HOT_CHILDREN`` nodes.

Results on edge cases: a null role or text is empty; turns without a number come first, equal numbers in the
order of role and digest; repeated rows are turns of their own; rows without ``conv_id`` belong to no conversation and
are left out; a conversation without turns is a member of the root; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrail.llm.counted_join import counted_join
from loomtrail.llm.running_sums import running_sums
from loomtrail.llm.text_native import words
from loomtrail.scale import stage

BLOCK = 4
#: Blocks of one conversation that a join sees under one key.
SPAN = 1 << 14
HOT_CHILDREN = 100_000
CHUNK_IDS = 50_000

_NODE = ["n1", "n2"]
_SUMS = ["s1", "s2", "s3", "s4"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place from 1, two 64-bit digests of role and text, and the words of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"),
        F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), role, text).alias("h2"),
        F.size(words(text)).cast("long").alias("words"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("h1").asc(), F.col("h2").asc()]
    placed = running_sums(turns, "conv_id", order, {"place": F.lit(1).cast("long")})
    return placed.select("conv_id", "place", "h1", "h2", "words")


def _both(*parts: Column) -> tuple[Column, Column]:
    return F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)


def _name(blocks: Column, sums: list[Column], names: list[str]) -> list[Column]:
    """Of a beginning of so many blocks with these sums of digests."""
    return [c.alias(n) for c, n in zip(_both(blocks, *sums), names)]


def _root() -> list[Column]:
    return _name(F.lit(0).cast("long"), [F.lit(0).cast("long")] * 4, _NODE)


def _blocks(turns: DataFrame) -> DataFrame:
    """Per conversation and block: its turns, and the names of the beginnings before (p) and behind it (a)."""
    turn = F.struct("place", "h1", "h2", "words")
    cut = turns.groupBy("conv_id", F.expr(f"(place - 1) div {BLOCK}").alias("block")).agg(
        F.sort_array(F.collect_list(turn)).alias("turns")
    )
    one, two = _both(F.col("block"), F.col("turns.h1"), F.col("turns.h2"))
    half = (1 << 32) - 1
    values = [one.bitwiseAND(half), F.shiftrightunsigned(one, 32), two.bitwiseAND(half), F.shiftrightunsigned(two, 32)]
    own = cut.select("*", *[v.alias(f"o{s}") for v, s in zip(values, _SUMS)])
    summed = running_sums(own, "conv_id", [F.col("block").asc()], {s: F.col(f"o{s}") for s in _SUMS})
    return summed.select(
        "conv_id", "block", "turns",
        *_name(F.col("block"), [F.col(s) - F.col(f"o{s}") for s in _SUMS], ["p1", "p2"]),
        *_name(F.col("block") + 1, [F.col(s) for s in _SUMS], ["a1", "a2"]),
    )


def _node(j: Column, names: list[str]) -> list[Column]:
    """The node behind the first j turns of a block."""
    begin = [F.slice(F.col("turns"), 1, F.greatest(j, F.lit(1)))[h] for h in ("h1", "h2")]
    inside = _both(F.col("p1"), F.col("p2"), j, *begin)
    return [
        F.when(j == 0, p).when(j == BLOCK, a).otherwise(h).alias(n)
        for p, a, h, n in zip((F.col("p1"), F.col("p2")), (F.col("a1"), F.col("a2")), inside, names)
    ]


def _turn_nodes(distinct: DataFrame) -> DataFrame:
    """A row per turn of different blocks: its node and that node's parent."""
    j = F.col("j")
    return distinct.withColumn("j", F.explode(F.sequence(F.lit(1), F.size("turns")))).select(
        *distinct.columns, *_node(j, _NODE), *_node(j - 1, ["up1", "up2"]),
        (F.col("block") * BLOCK + j).alias("depth"), F.get("turns", j - 1)["words"].alias("words"),
    ).drop("turns")


def _id_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (node, conv_id) to rows of a node and consecutive ids as text."""
    node: tuple | None = None
    ids: list[int] = []

    def given(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=[*_NODE, "first", "ids"])

    for batch in batches:
        out = []
        for n1, n2, conv_id in zip(*(c.to_pylist() for c in batch.columns)):
            if (n1, n2) != node or len(ids) == CHUNK_IDS:
                if ids:
                    out.append((*node, ids[0], ",".join(map(str, ids))))
                node, ids = (n1, n2), []
            ids.append(conv_id)
        if out:
            yield given(out)
    if ids:
        yield given([(*node, ids[0], ",".join(map(str, ids)))])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks to the digest of each node's ids."""
    node, state = None, None

    def given(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=[*_NODE, "ends_sha256"])

    for batch in batches:
        out = []
        for n1, n2, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if (n1, n2) != node:
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (n1, n2), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if out:
            yield given(out)
    if node:
        yield given([(*node, state.hexdigest())])


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids (n1, n2, conv_id) of each node, ascending and joined by commas."""
    order = [*_NODE, "conv_id"]
    sorted_ids = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    chunks = sorted_ids.mapInArrow(_id_chunks, "n1 long, n2 long, first long, ids string")
    by_node = chunks.repartition(*_NODE).sortWithinPartitions(*_NODE, "first")
    return by_node.select(*_NODE, "ids").mapInArrow(_digests, "n1 long, n2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, ids: DataFrame, hot_children: int = HOT_CHILDREN) -> DataFrame:
    """One row per node of the trie.

    ``turns``: conv_id, place (1, 2, ... without gaps), h1, h2, words as ``ordered_turns`` gives. ``ids``: every ``conv_id``
    once, those without turns too. Result: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.
    """
    ids = stage(ids.select("conv_id"), "trie-conversations")
    blocks = stage(_blocks(turns), "trie-blocks")
    key = ["p1", "p2", "a1", "a2"]
    members = blocks.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"),
        F.first("block").alias("block"), F.first("turns").alias("turns"),
    )
    members = stage(members, "trie-members")
    lone = members.groupBy("p1", "p2").agg(
        F.count(F.lit(1)).alias("siblings"), F.max("a1").alias("a1"), F.max("a2").alias("a2")
    ).where("siblings = 1")
    members = members.join(lone, key, "left").withColumn("lone", F.col("siblings").isNotNull()).drop("siblings")
    turn_nodes = stage(_turn_nodes(members), "trie-turns")
    columns = [*_NODE, F.col("n").alias("n_convs"), F.col("least").alias("conv_id"), "depth", "words", "up1", "up2"]
    nodes = turn_nodes.where("lone").select(*columns)
    # Only where different blocks follow may several of them share a node.
    nodes = nodes.unionByName(turn_nodes.where("not lone").select(*columns).groupBy(*_NODE).agg(
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"),
        *[F.first(c).alias(c) for c in ("depth", "words", "up1", "up2")],
    ))
    zero = F.lit(0).cast("long")
    every = ids.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = every.select(*_root(), "n_convs", "conv_id", zero.alias("depth"), zero.alias("words"),
                        F.lit(None).cast("long").alias("up1"), F.lit(None).cast("long").alias("up2"))
    nodes = stage(nodes.unionByName(root), "trie-nodes")

    children = nodes.where("depth > 0").groupBy(F.col("up1").alias("n1"), F.col("up2").alias("n2")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    nodes = nodes.join(children, _NODE, "left").withColumn("n_children", F.coalesce("n_children", zero))
    saving = (F.col("n_convs") - 1) * F.col("words")
    leaf = (F.col("n_children") == 0).cast("long")
    nodes = stage(
        running_sums(nodes.select("*", saving.alias("saving"), leaf.alias("leaf")), "conv_id", [F.col("depth").asc()],
                     {"owned": F.col("saving")}),
        "trie-counted",
    )

    owned = nodes.groupBy("conv_id").agg(
        F.sum("saving").alias("all_saving"), F.sum("leaf").alias("all_leaves"), F.max("depth").alias("depth")
    )
    span = F.expr(f"block div {SPAN}").cast("long")
    spans = owned.withColumn("span", F.explode(F.sequence(zero, F.expr(f"depth div {BLOCK} div {SPAN}"))))
    carried = blocks.select("conv_id", span.alias("span"), *key).join(spans, ["conv_id", "span"]).groupBy(*key).agg(
        F.sum("all_saving").alias("all_saving"), F.sum("all_leaves").alias("all_leaves")
    )
    totals = [F.sum(c).alias(c) for c in ("all_saving", "all_leaves")]
    below = turn_nodes.select("lone", *key, *_NODE).join(carried, key).select("lone", *_NODE, "all_saving", "all_leaves")
    below = (
        below.where("lone").drop("lone")
        .unionByName(below.where("not lone").groupBy(*_NODE).agg(*totals))
        .unionByName(owned.agg(*totals).select(*_root(), "all_saving", "all_leaves"))
    )

    # The last block of a conversation holds its last turn.
    last = blocks.groupBy("conv_id").agg(F.max("block").alias("block"))
    with_turns = blocks.join(last, ["conv_id", "block"]).select(*_node(F.size("turns"), _NODE), "conv_id")
    without = ids.join(last.select("conv_id"), "conv_id", "left_anti").select(*_root(), "conv_id")
    digests = end_digests(with_turns.unionByName(without))

    parents = nodes.where("n_children > 0").select(
        F.col("n1").alias("up1"), F.col("n2").alias("up2"), F.col("conv_id").alias("parent_conv_id"),
        F.col("n_children").alias("n_own"),
    )
    named = counted_join(nodes, parents, ["up1", "up2"], "n_own", "left", hot_children)
    found = named.join(below, _NODE, "left").join(digests, _NODE, "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        F.col("all_leaves").alias("n_leaves"),
        (F.col("all_saving") - F.col("owned") + F.col("saving")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
