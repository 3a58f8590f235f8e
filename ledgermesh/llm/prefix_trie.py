"""The trie of conversation prefixes, with sums over subtrees by heavy paths.

A node is a distinct sequence of first turns (role, text); the root is the empty
one.  A turn is a digest from the scan on, so no text is shuffled.  A prefix is
named by the sums of four numbers of 32 bits that a hash of place and turn gives;
the sums run along a conversation, in blocks of ``BLOCK`` turns and totals of
blocks, so that a conversation of any length meets in no single task.

Each node's heavy child is the one with most members (ties: the smaller member),
so a light child has at most half of its parent's, and a way to the root has at
most log2(conversations) light edges.  The ways of heavy children are paths, each
named by the first conversation of its last node: that conversation's nodes from
the last light one on are the path.  Paths are taken by the number of light edges
above them, the largest first: suffix sums along a path (in blocks again) give
the sums of its subtrees, and the sum of its first node goes to the parent, which
lies on a path of one light edge less.

Turns go by turn, null first, then by role, then by the digest of role and text;
null roles and texts are empty.  Rows without a conversation id belong to no
conversation.  Rows that repeat are turns of their own.  Without a row there is
no node.  Only id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written
from .mixing import running, words

#: Places of a conversation, or of a path, that one task sums up.
BLOCK = 65_536
NAME = [f"p{i}" for i in range(4)]
#: Ids of a piece of a node's list.
PIECE = 4_096


class Trie(NamedTuple):
    """nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens.

    ends: (conv_id, depth, member) of each conversation at the node of all its turns.
    """

    nodes: DataFrame
    ends: DataFrame


def turns_of(convs: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, digest, n_words) of every row with a conversation id; pos: its place there, from 0."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = convs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), digest.alias("digest"), words(F.col(text_col)).alias("n_words"))
    nth = written(running(rows, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")], nth=F.lit(1).cast("long")), "trie-turns")
    first = nth.groupBy("conv_id").agg(F.min("nth").alias("first"))
    return written(nth.join(first, "conv_id").select("conv_id", (F.col("nth") - F.col("first")).alias("pos"), "digest", "n_words"), "trie-places")


def shared_starts(turns: DataFrame, every: int, heads: Column) -> DataFrame:
    """turns rebuilt: a conversation c begins with the first ``heads`` turns of conversation c - c % every, then come its own behind its first ``heads``."""
    base = F.col("conv_id") - F.col("conv_id") % every
    convs = turns.select("conv_id").distinct().select("conv_id", base.alias("base"), heads.cast("long").alias("h"))
    # a base gives its first turns to at most ``every`` conversations on each side of 0
    starts = turns.where("conv_id % {0} = 0".format(every)).select(F.col("conv_id").alias("base"), "pos", "digest", "n_words")
    starts = convs.join(starts, "base").where("pos < h").select("conv_id", "pos", "digest", "n_words")
    starts = written(starts, "trie-starts")
    have = starts.groupBy("conv_id").agg(F.count(F.lit(1)).alias("have"))
    own = turns.withColumn("h", heads.cast("long")).where("pos >= h").join(have, "conv_id", "left")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.coalesce("have", F.lit(0))).alias("pos"), "digest", "n_words")
    return starts.unionByName(own)


def block_sums(df: DataFrame, key: str, pos: str, cols: list[str], suffix: bool = False) -> DataFrame:
    """df with each of cols summed over the rows of a key up to a row's pos, or from it on."""
    d = df.withColumn("_block", F.floor(F.col(pos) / BLOCK))
    sign = -1 if suffix else 1
    along = Window.partitionBy(key, "_block").orderBy(sign * F.col(pos)).rowsBetween(Window.unboundedPreceding, 0)
    # totals of the blocks of long keys: a row for each BLOCK places
    totals = d.groupBy(key, "_block").agg(*[F.sum(c).alias(f"_{c}") for c in cols])
    longer = F.max("_block").over(Window.partitionBy(key)) - F.min("_block").over(Window.partitionBy(key))
    before = Window.partitionBy(key).orderBy(sign * F.col("_block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_long", longer).where("_long > 0").select(key, "_block", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in cols])
    summed = d.select("*", *[F.sum(c).over(along).alias(f"_sum_{c}") for c in cols]).join(totals, [key, "_block"], "left")
    return summed.select(*[(F.col(f"_sum_{c}") + F.coalesce(f"_{c}", F.lit(0))).alias(c) if c in cols else F.col(c) for c in df.columns])


def prefix_trie(turns: DataFrame, convs: DataFrame | None = None) -> Trie:
    """The trie of turns (conv_id, pos, digest, n_words); convs: (conv_id) of all conversations, those without turns included."""
    convs = written((convs if convs is not None else turns).select("conv_id").distinct(), "trie-convs")
    named = F.sha2(F.concat(F.col("pos").cast("string"), F.lit(":"), "digest"), 256)
    part = [F.conv(F.substring("own", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    t = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "n_words", named.alias("own"))
    t = t.select("conv_id", "depth", "n_words", *[p.alias(c) for p, c in zip(part, NAME)], *[p.alias(f"own_{c}") for p, c in zip(part, NAME)])
    rows = written(block_sums(t, "conv_id", "depth", NAME).select("*", *[(F.col(c) - F.col(f"own_{c}")).alias(f"up_{c}") for c in NAME]), "trie-rows")
    up = [f"up_{c}" for c in NAME]
    nodes = rows.groupBy("depth", *NAME).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("n_words").alias("n_words"), *[F.first(c).alias(c) for c in up])
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in NAME], "conv_id", "n_convs", F.lit(0).cast("long").alias("n_words"), *[F.lit(None).cast("long").alias(c) for c in up])
    nodes = written(nodes.unionByName(root), "trie-nodes")

    # heavy children; a parent's children are merged before they meet
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), *[F.col(u).alias(c) for u, c in zip(up, NAME)])
    below = below.agg(F.count(F.lit(1)).alias("n_children"), F.max(F.struct("n_convs", (-F.col("conv_id")).alias("less"))).alias("heavy"))
    parents = nodes.join(below, ["depth", *NAME], "left").select("depth", *NAME, "conv_id", "n_convs", "n_words", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), (-F.col("heavy.less")).alias("heavy"), *up)
    parents = written(parents, "trie-parents")
    above = parents.select((F.col("depth") + 1).alias("depth"), *[F.col(c).alias(u) for u, c in zip(up, NAME)], F.col("conv_id").alias("parent_conv_id"), F.col("heavy").alias("heavy_of_parent"))
    placed = parents.join(above, ["depth", *up], "left").select("depth", *NAME, "conv_id", "n_convs", "n_words", "n_children", "parent_conv_id", F.coalesce(F.col("heavy_of_parent") == F.col("conv_id"), F.lit(False)).alias("is_heavy"))
    placed = written(placed, "trie-placed")
    discard(nodes, parents)

    # the nodes of each leaf's first conversation, and the last node of every conversation
    leaves = placed.where("n_children = 0").select("conv_id", F.col("depth").alias("leaf_depth"))
    size = convs.join(rows.groupBy("conv_id").agg(F.max("depth").alias("last")), "conv_id", "left").select("conv_id", F.coalesce("last", F.lit(0)).alias("last"))
    about = size.join(leaves, (size["conv_id"] == leaves["conv_id"]) & (F.col("last") == F.col("leaf_depth")), "left").select(size["conv_id"], "last", F.col("leaf_depth").isNotNull().alias("leaf"))
    about = written(about, "trie-about")
    wanted = rows.select("conv_id", "depth", *NAME).join(about, "conv_id").where("leaf or depth = last")
    wanted = wanted.unionByName(about.where("leaf or last = 0").select("conv_id", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in NAME], "last", "leaf"))
    node = placed.select("depth", *NAME, F.col("conv_id").alias("node"), "is_heavy")
    wanted = written(wanted.join(node, ["depth", *NAME]).select(F.col("conv_id").alias("conv"), "depth", "node", "is_heavy", "last", "leaf"), "trie-ways")
    ends = wanted.where("depth = last").select(F.col("node").alias("conv_id"), "depth", F.col("conv").alias("member"))
    heads = wanted.where("leaf and not is_heavy").groupBy("conv").agg(F.max("depth").alias("head"), (F.count(F.lit(1)) - 1).alias("level"))
    path = wanted.where("leaf").join(heads, "conv").where("depth >= head").select("conv", "depth", F.col("node").alias("conv_id"), "head", "level")
    saved = ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved_tokens")
    values = placed.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("n_children") == 0).cast("long").alias("n_leaves"), saved)
    path = written(path.join(values, ["conv_id", "depth"]), "trie-paths")
    top = path.agg(F.max("level")).first()[0]

    done, light = [], None
    for level in range(top if top is not None else -1, -1, -1):
        now = path.where(F.col("level") == level)
        if light is not None:
            now = now.join(light, ["conv_id", "depth"], "left").select(*[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) if c in ("n_leaves", "saved_tokens") else F.col(c) for c in path.columns])
        now = written(block_sums(now, "conv", "depth", ["n_leaves", "saved_tokens"], suffix=True), "trie-level")
        done.append(now)
        light = now.where("depth = head and depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
        light = light.agg(*[F.sum(c).alias(f"more_{c}") for c in ("n_leaves", "saved_tokens")])
    whole = done[0] if done else path
    for d in done[1:]:
        whole = whole.unionByName(d)
    return Trie(whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), ends)


def joined_sha256(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256): SHA-256 of the comma-joined members of each node, ascending.

    Members are sorted over ranges and joined to pieces of ``PIECE``; a task reads the
    pieces of a node one after the other, so it holds one of them at a time.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held, made = None, [], []

        def close():
            made.append((*node, held[0], ",".join(map(str, held))))

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["conv_id", "depth", "first", "ids"])
            made.clear()
            return batch

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:2] != node or len(held) >= PIECE:
                    if held:
                        close()
                        if len(made) >= 1_000:
                            yield out()
                    node, held = row[:2], []
                held.append(row[2])
        if held:
            close()
        if made:
            yield out()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, made = None, None, []

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.int64(), pa.int64(), pa.string()))], ["conv_id", "depth", "ends_sha256"])
            made.clear()
            return batch

        for batch in batches:
            for conv, depth, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if (conv, depth) != node:
                    if node:
                        made.append((*node, state.hexdigest()))
                        if len(made) >= 10_000:
                            yield out()
                    node, state = (conv, depth), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if node:
            made.append((*node, state.hexdigest()))
        if made:
            yield out()

    order = ["conv_id", "depth", "member"]
    parts = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "conv_id long, depth long, first long, ids string")
    parts = written(parts, "trie-pieces")
    return parts.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(digests, "conv_id long, depth long, ends_sha256 string")
