"""Operator 11: the prefix trie of rebuilt conversations, by collapsing whole sequences.

Turns are numbered within their conversation, and every conversation is rebuilt from a head that it shares with
others and its own rest. Equal rebuilt conversations collapse into one weighted sequence with the list of
conversations that end there. Only one conversation of each sequence goes on: its prefixes, weighted, add up to
the nodes of the trie. Sequences that are proper prefixes of others fall away by an anti-join with the inner
nodes; the rest are the leaves.

A node is known by its depth and 128 bits: two exclusive-ors of the hashes of (depth, role, text) along the way,
so prefixes of any length are running aggregates and texts move only once, to be put in order.

Sums over subtrees need no tree walk. A node's smallest member is the conversation of one of its sequences, and
the nodes with one smallest member form the end of that sequence's path. So a sequence carries the sum of
its own end, a node adds up its sequences, and what stands above it on its own end is taken off again.

Nothing gathers a whole conversation: positions come from key ranges, and running aggregates go by segments of
depths with one carried row each. Lists of ends are written in pieces and hashed as a stream.

Null role and text are empty, and a null turn comes first. Turns with one number stand by role, then text; equal
rows are turns of their own. Rows without conv_id take no part. A table without conversations has no nodes,
not even a root. Other columns do not matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flatwork.functions.coerce import col
from flatwork.llm.common import look_up, partitions, stored

#: Depths of a conversation that one task works on at a time.
SEGMENT = 4096
#: log2 of the ids in a piece of a list of ends.
PIECE_BITS = 12
NODE = ["depth", "p1", "p2"]
EMPTY = hashlib.sha256(b"").hexdigest()


def shared_turns(conv_id: Column, modulus: int = 9) -> Column:
    """How many turns a conversation takes from the head of its group: crc32 of its decimal id."""
    return F.crc32(conv_id.cast("string").cast("binary")) % modulus


def positions(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, place in the whole table, two hashes, bytes of text), and a row for each conversation
    with the place of its first turn and its number of turns."""
    empty = lambda c: F.coalesce(col(c), F.lit(""))
    rows = conversations.where(col(conv_id).isNotNull()).select(
        col(conv_id).alias("conv_id"), col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text")
    )
    order = ["conv_id", "turn", "role", "text"]
    row = F.monotonically_increasing_id()
    placed = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    placed = stored(
        placed.select(
            "conv_id",
            F.shiftright(row, 33).alias("range"),
            row.bitwiseAND(F.lit((1 << 33) - 1)).alias("at"),
            F.xxhash64("role", "text").alias("t1"),
            F.xxhash64(F.lit(1), "role", "text").alias("t2"),
            F.octet_length("text").cast("long").alias("bytes"),
        )
    )
    # One row for each range.
    ranges = placed.groupBy("range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    ranges = ranges.select("range", F.coalesce(before, F.lit(0)).alias("before"))
    placed = placed.join(F.broadcast(ranges), "range").select("conv_id", (F.col("before") + F.col("at")).alias("place"), "t1", "t2", "bytes")
    convs = placed.groupBy("conv_id").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    return placed, stored(convs)


def rebuilt(
    conversations: DataFrame,
    group: int = 5,
    modulus: int = 9,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """The turns of rebuilt conversations: conv_id, depth, hashes l1 and l2, bytes; depth 0 is an empty row that
    every conversation has.

    Conversation c starts with the first h turns of conversation c - c % group (the remainder has the sign
    of c), where h = crc32(c) % modulus, and goes on with its own turns after its first h.
    """
    placed, convs = positions(conversations, conv_id, turn, role, text)
    base = F.col("conv_id") - F.col("conv_id") % group
    heads = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    known = convs.withColumns({"base": base, "h": shared_turns(F.col("conv_id"), modulus)}).join(heads, "base", "left")
    known = stored(known.withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0)))))
    numbered = look_up(placed, known, ["conv_id"], "n").withColumn("p", F.col("place") - F.col("first") + 1)
    own = numbered.where("p > h").select("conv_id", (F.col("p") - F.col("h") + F.col("k")).alias("depth"), "t1", "t2", "bytes")
    # A head has modulus - 1 turns at most, and at most 2 * group - 1 conversations take it.
    head = numbered.where(F.col("p") < modulus).select(F.col("conv_id").alias("base"), F.col("p").alias("depth"), "t1", "t2", "bytes")
    taken = head.join(known.where("k > 0").select("base", "conv_id", "k"), "base").where("depth <= k")
    none = F.lit(0).cast("long")
    roots = known.select("conv_id", none.alias("depth"), none.alias("t1"), none.alias("t2"), none.alias("bytes"))
    turns = own.unionByName(taken.select(own.columns)).unionByName(roots)
    lane = lambda *c: F.when(F.col("depth") > 0, F.xxhash64("depth", *c)).otherwise(none)
    return turns.select("conv_id", "depth", lane("t1", "t2").alias("l1"), lane("t2", "t1").alias("l2"), "bytes")


def running(df: DataFrame, values: dict[str, str], how) -> DataFrame:
    """Add, for each name and column of `values`, `how` over its conversation's rows up to and including this depth."""
    cut = df.withColumn("segment", F.floor(F.col("depth") / SEGMENT))
    inside = W.partitionBy("conv_id", "segment").orderBy("depth").rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = W.partitionBy("conv_id").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    sums = cut.groupBy("conv_id", "segment").agg(*[how(c).alias(f"__{n}") for n, c in values.items()])
    carried = sums.select("conv_id", "segment", *[how(f"__{n}").over(earlier).alias(f"__{n}") for n in values]).where("segment > 0")
    placed = cut.withColumns({n: how(c).over(inside) for n, c in values.items()}).join(carried, ["conv_id", "segment"], "left")
    none = F.lit(0).cast("long")
    both = (lambda a, b: a.bitwiseXOR(b)) if how is F.bit_xor else (lambda a, b: a + b)
    return placed.withColumns({n: both(F.col(n), F.coalesce(f"__{n}", none)) for n in values}).drop("segment", *[f"__{n}" for n in values])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's pieces, which come in order."""
    node, made = None, hashlib.sha256()

    def row(node, made) -> pa.RecordBatch:
        arrays = [pa.array([v], pa.int64()) for v in node]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([made.hexdigest()])], [*NODE, "ends"])

    for batch in batches:
        done = {name: [] for name in [*NODE, "ends"]}
        for *key, _, ids in zip(*[c.to_pylist() for c in batch.columns]):
            if key != node:
                if node is not None:
                    for name, v in zip(done, [*node, made.hexdigest()]):
                        done[name].append(v)
                node, made = key, hashlib.sha256(ids.encode())
            else:
                made.update(b"," + ids.encode())
        if done["ends"]:
            kinds = [pa.int64()] * len(NODE) + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(done.values(), kinds)], list(done))
    if node is not None:
        yield row(node, made)


def end_hashes(whole: DataFrame) -> DataFrame:
    """For each node where conversations end: SHA-256 of their decimal ids, ascending and comma-joined."""
    parts = partitions(whole.sparkSession)
    order = [*NODE, "conv_id"]
    placed = whole.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    piece = placed.withColumn("piece", F.shiftright(F.monotonically_increasing_id(), PIECE_BITS))
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string"))
    # A piece holds 4,096 ids at most.
    pieces = piece.groupBy(*NODE, "piece").agg(F.concat_ws(",", ids).alias("ids"))
    pieces = pieces.repartition(parts, *NODE).sortWithinPartitions(*NODE, "piece")
    return pieces.mapInArrow(_streamed, "depth long, p1 long, p2 long, ends string")


def trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations (see `rebuilt`): conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    turns = stored(turns)
    # Whole sequences: equal ones collapse, with their weight and the conversations that end there.
    whole = stored(
        turns.groupBy("conv_id").agg(F.max("depth").alias("depth"), F.bit_xor("l1").alias("p1"), F.bit_xor("l2").alias("p2"))
    )
    sequences = whole.groupBy(*NODE).agg(F.count("*").alias("weight"), F.min("conv_id").alias("conv_id"))
    sequences = stored(sequences.select("conv_id", *NODE, "weight", (F.col("depth") + 1).alias("n")))
    one = look_up(turns, sequences.select("conv_id", "weight", "n"), ["conv_id"], "n")
    prefixes = running(one, {"p1": "l1", "p2": "l2"}, F.bit_xor)
    parent = lambda p, l: F.col(p).bitwiseXOR(F.col(l))
    prefixes = stored(
        prefixes.select("conv_id", *NODE, parent("p1", "l1").alias("q1"), parent("p2", "l2").alias("q2"), "bytes", "weight", "n")
    )
    nodes = stored(
        prefixes.groupBy(*NODE).agg(
            F.sum("weight").alias("n_convs"),
            F.min("conv_id").alias("conv_id"),
            F.min("q1").alias("q1"),
            F.min("q2").alias("q2"),
            F.max("bytes").alias("bytes"),
            F.max("n").alias("n"),
        )
    )
    # Sequences that are proper prefixes go; the others end in leaves.
    inner = nodes.where(F.col("n") - 1 > F.col("depth")).select(*NODE)
    leaves = sequences.join(inner, NODE, "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))

    # What a node saves, along the path of its smallest member.
    ends = running(nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("bytes")), {"upto": "own"}, F.sum)
    nodes = stored(ends.withColumn("above", F.col("upto") - F.col("own")).drop("n", "bytes", "upto"))
    saved = nodes.groupBy("conv_id").agg(F.sum("own").alias("saved"))
    none = F.lit(0).cast("long")
    values = sequences.select("conv_id", "n").join(leaves, "conv_id", "left").join(saved, "conv_id", "left")
    values = stored(values.select("conv_id", F.coalesce("leaf", none).alias("n_leaves"), F.coalesce("saved", none).alias("saved"), "n"))
    of_sequences = look_up(prefixes.select("conv_id", *NODE), values, ["conv_id"], "n")

    # Everything that adds up by node.
    blank = lambda **kinds: [F.lit(None).cast(t).alias(c) for c, t in kinds.items()]
    added = of_sequences.select(*NODE, "n_leaves", "saved", *blank(n_children="long", ends="string"))
    children = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
    children = children.select(*NODE, *blank(n_leaves="long", saved="long"), F.lit(1).cast("long").alias("n_children"), *blank(ends="string"))
    added = added.unionByName(children).unionByName(end_hashes(whole).select(*NODE, *blank(n_leaves="long", saved="long", n_children="long"), "ends"))
    added = added.groupBy(*NODE).agg(
        F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved").alias("saved"),
        F.coalesce(F.sum("n_children"), none).alias("n_children"),
        F.coalesce(F.max("ends"), F.lit(EMPTY)).alias("ends_sha256"),
    )
    full = nodes.join(added, NODE).withColumn("saved_tokens", F.col("saved") - F.col("above"))
    full = stored(full.select(*NODE, "q1", "q2", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))

    parents = full.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"),
        F.col("p1").alias("q1"),
        F.col("p2").alias("q2"),
        F.col("conv_id").alias("parent_conv_id"),
        F.col("n_children").alias("same"),
    )
    below = look_up(full.where("depth > 0"), parents, ["depth", "q1", "q2"], "same")
    root = full.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast(full.schema["conv_id"].dataType))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return below.select(columns).unionByName(root.select(columns))
