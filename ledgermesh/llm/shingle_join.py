"""Exact similarity join on 5-word shingles by a grouped prefix join.

1. A global order of shingles: hash order, but the ``frequent`` most frequent
   ones last, by count.  Any order gives right results; this one keeps what many
   documents share out of the prefixes.  The table of frequent shingles is of a
   fixed size.
2. A document of n shingles can link only to one that shares a shingle of its
   prefix, its first n - ceil(0.75 n) + 1.  Documents with equal sets fall
   together, and sets with equal prefixes and sizes form one group.
3. Groups that share a prefix shingle are filtered by size and by what their
   positions leave possible, then expanded to their members and verified on
   whole sets.  The members of a group meet its least one.  Groups first meet
   the least group of a shingle only, then in ``rounds`` turns another group of
   a shingle that still has several components, one try for each: their number
   is linear.
4. What is left stays in groups, by component: members of two groups that lie in
   different components are a candidate at the first shingle their prefixes share.  What they share
   lies at or behind it in both, so that shingle must be early enough in both
   sets (few of the shingles that many documents share are), and a shingle
   before which both have a common one is passed over.  Inside a group of
   several components the prefix is deepened: its members share all of it, so
   of the rest they must share one of the first n - ceil(6 n / 7) + 1 behind it.
   Candidates are expanded to members of different components and verified.
   Pairs inside a component can't change it, so no link is lost between
   components.

Null text counts as empty; an empty document is linked with nothing.  Rows that
repeat a doc_id get the component of the one with the least set hash; a row
without a doc_id gets null and links with nothing.  Only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, ids_only, written
from .memory import tidy
from .shingles import shingle_sets

PROFILE = "doc_id long, n int, set_key binary, group_key binary, prefix array<long>"
#: Shingles in memory at once while counting.
CHUNK = 1_000_000


def _int64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)), _int64(flat))


def frequent_shingles(docs: DataFrame, most: int, least: int = 8) -> np.ndarray:
    """The ``most`` shingles with the greatest counts, as (hash, count) columns; a table of bounded size.

    Tasks leave out what they saw once in CHUNK shingles, so counts may be low:
    they serve for an order only.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            value, n = np.unique(np.concatenate(held), return_counts=True)
            often = n > 1
            return pa.RecordBatch.from_arrays([_int64(value[often]), pa.array(n[often].astype(np.int64))], ["token", "n"])

        for batch in batches:
            for s in shingle_sets(batch.column(0).to_pylist()):
                held.append(s)
                size += len(s)
                if size >= CHUNK:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    counts = docs.select("text").mapInArrow(tidy(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "token").limit(most).toArrow()
    token, n = top.column("token").to_numpy().astype(np.int64).view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(token)
    return np.column_stack([token[order], n[order].astype(np.uint64)]) if len(token) else np.zeros((0, 2), np.uint64)


def in_order(s: np.ndarray, often: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` of a sorted set, in the global order."""
    if len(often):
        at = np.minimum(np.searchsorted(often[:, 0], s), len(often) - 1)
        known = often[at, 0] == s
        rare = s[~known]
        if len(rare) >= most:
            return rare[:most]
        late = np.lexsort((s[known], often[at[known], 1]))
        return np.concatenate([rare, s[known][late]])[:most]
    return s[:most]


def prefix_of(s: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first n - ceil(3 n / 4) + 1 of a sorted set, in the global order."""
    return in_order(s, often, len(s) // 4 + 1)


def profiles(docs: DataFrame, often: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                some = batch.slice(i, 512)
                sets = list(shingle_sets(some.column(1).to_pylist()))
                prefixes = [prefix_of(s, shared.value) if len(s) else s for s in sets]
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                groups = [hashlib.blake2b(p.tobytes() + len(s).to_bytes(8, "little"), digest_size=16).digest() for s, p in zip(sets, prefixes)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(keys, pa.binary()), pa.array(groups, pa.binary()), _lists(prefixes)], ["doc_id", "n", "set_key", "group_key", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(tidy(make), PROFILE)


def sets_of(docs: DataFrame) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                some = batch.slice(i, 512)
                yield pa.RecordBatch.from_arrays([some.column(0), _lists(list(shingle_sets(some.column(1).to_pylist())))], ["id", "s"])

    return docs.select("doc_id", "text").mapInArrow(tidy(make), "id long, s array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable, for every id of edges (a, b), by alternating large and small stars."""
    e = written(edges.select("a", "b").where("a <> b").distinct(), "stars")
    before, large = None, None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a <> b").distinct(), "stars")
        # every edge points down: a > b
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.withColumnRenamed("m", "b"))
        last, e = e, written(small.where("a <> b").distinct(), "stars")
        discard(last, large)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        before = now


def _possible(na: Column, nb: Column, overlap: Column) -> Column:
    """Whether 100 * overlap >= 75 * union can hold: 7 * overlap >= 3 * (na + nb)."""
    return 7 * overlap >= 3 * (na + nb)


def _linked(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, verified on whole sets."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "join-ids")
    sets = written(sets_of(ids_only(docs, ids, "doc_id")), "join-sets")
    left, right = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    links = written(both.where(_possible(F.size("sa"), F.size("sb"), F.size(F.array_intersect("sa", "sb")))).select("a", "b"), "join-links")
    discard(ids, sets)
    return links


def _room(pa: Column, pb: Column, na: Column, nb: Column) -> Column:
    """Most that two sets can share which meet at these positions of the common order."""
    return F.least(pa, pb) + F.least(na - pa, nb - pb)


def _reach(k: Column, pa: Column, pb: Column, na: Column, nb: Column) -> Column:
    """Most that two sets can share whose prefixes share k, at these positions at most.

    Of the two prefixes one ends first in the common order.  What the sets share
    up to there is in both prefixes, so k counts it; the rest lies behind the
    prefix that ends first, and behind the last shared position of the other.
    """
    behind = lambda n: n - (F.floor(n / 4) + 1)
    return k + F.greatest(F.least(behind(na), nb - pb - 1), F.least(behind(nb), na - pa - 1))


#: Earlier shingles of a group that are looked at to pass over a pair that met before.
BEFORE = 4


def _open(spots: DataFrame, at: DataFrame) -> DataFrame:
    """token, pos, gid, n, component, rep, before of the shingles whose groups lie in several components.

    at: gid, id, component.  The members of a group that lie in one component go
    together, named by their least id, rep; before: the group's last few of these
    shingles before this one.
    """
    parts = at.groupBy("gid", "component").agg(F.min("id").alias("rep"))
    every = spots.select("token", "gid", "pos", "n").join(parts, "gid")
    several = every.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("token")
    before = F.collect_list("token").over(Window.partitionBy("gid", "component").orderBy("pos").rowsBetween(-BEFORE, -1))
    return written(every.join(several, "token").withColumn("before", before), "join-open")


def _shared(groups: DataFrame, mixed: DataFrame) -> DataFrame:
    """The pairs of groups (g, h, ...) whose prefixes share enough: all they share in different components is in mixed."""
    lists = written(mixed.groupBy("gid").agg(F.first("n").alias("n"), F.collect_set("token").alias("s")), "join-lists")
    of = lambda g, c: lists.select(F.col("gid").alias(g), F.col("n").alias(f"n{c}"), F.col("s").alias(f"s{c}"))
    both = groups.join(of("g", "a"), "g").join(of("h", "b"), "h")
    behind = lambda n: F.col(n) - (F.floor(F.col(n) / 4) + 1)
    # what the sets share is in both prefixes, or behind the prefix that ends first in the common order
    most = F.size(F.array_intersect("sa", "sb")) + F.greatest(behind("na"), behind("nb"))
    return both.where(_possible(F.col("na"), F.col("nb"), most)).select(*groups.columns)


def _inside(at: DataFrame, docs: DataFrame, often: np.ndarray) -> DataFrame:
    """Pairs (a, b) of one group and different components that share a shingle of the deepened prefix; at: gid, id, component."""
    several = at.groupBy("gid").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("gid")
    some = written(at.join(several, "gid"), "join-inside")
    if some.isEmpty():
        return some.select(F.col("id").alias("a"), F.col("id").alias("b"))
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                sets = list(shingle_sets(part.column(1).to_pylist()))
                # 7 * overlap >= 6 n leaves n // 7 shingles that are not shared
                behind = [in_order(s, shared.value, len(s) // 4 + 1 + len(s) // 7 + 1)[len(s) // 4 + 1 :] for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int32()), _lists(behind)], ["id", "n", "behind"])

    texts = ids_only(docs, some.select(F.col("id").alias("doc_id")), "doc_id").select("doc_id", "text")
    spots = texts.mapInArrow(tidy(deeper), "id long, n int, behind array<long>").select("id", "n", F.posexplode("behind").alias("pos", "token")).distinct()
    spots = written(spots.join(some, "id"), "join-inside-spots")
    x, y = spots.alias("x"), spots.alias("y")
    late = F.greatest("x.pos", "y.pos")
    same = (F.col("x.gid") == F.col("y.gid")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.id") > F.col("y.id")) & (F.col("x.component") != F.col("y.component"))
    return x.join(y, same & (late <= F.floor(F.col("x.n") / 7))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def _merged(part: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links; part holds the ids that have any."""
    of = lambda c: part.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    joined = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    whole = components(joined).select(F.col("id").alias("component"), F.col("component").alias("final"))
    fresh = links.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(part, "id", "left_anti").select("id", F.col("id").alias("component"))
    return written(part.unionByName(fresh).join(whole, "component", "left").select("id", F.coalesce("final", "component").alias("component")), "join-part")


def near_duplicates(docs: DataFrame, frequent: int = 200_000, rounds: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = docs.where("doc_id is not null")
    often = frequent_shingles(named, frequent)
    d = written(profiles(named, often), "join-profiles")
    full = d.where("n > 0")
    # of rows that repeat a doc_id one stands for it; equal sets are one node, named by its least doc_id
    rows = written(full.groupBy("doc_id").agg(F.min(F.struct("set_key", "group_key", "n")).alias("r")).select("doc_id", "r.*"), "join-rows")
    every = written(d.select("doc_id", "n"), "join-every")
    nodes = written(rows.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("group_key").alias("group_key")), "join-nodes")
    groups = written(nodes.groupBy("group_key").agg(F.min("id").alias("gid")), "join-groups")
    members = written(nodes.join(groups, "group_key").select("gid", "id", "n"), "join-members")
    # only the rows that stand for a group go on: what drops out is named rather than what stays, to leave the prefixes in place
    key = ["doc_id", "group_key"]
    others = written(full.select(*key).distinct().join(groups.withColumnRenamed("gid", "doc_id"), key, "left_anti"), "join-others")
    spots = ids_only(full, others, key, "left_anti").select(F.col("doc_id").alias("gid"), F.posexplode("prefix").alias("pos", "token"))
    # a shingle stays if several nodes may share it, be they of one group: the other members of a group have met its least one only
    plural = members.where("id <> gid").select("gid", F.lit(True).alias("plural")).distinct()
    met = ids_only(spots, plural, "gid", "left").groupBy("token").agg(F.min("gid").alias("pivot"), (F.count(F.lit(1)) + F.count("plural")).alias("k")).where("k > 1").select("token", "pivot")
    met = written(met, "join-met")
    with_pivot = written(spots.join(met, "token"), "join-met-spots")
    sizes = members.where("id = gid").select("gid", "n")
    spots = written(with_pivot.join(sizes, "gid"), "join-spots")
    discard(d, met, with_pivot)

    # each group against the least group of each of its shingles
    a, b = spots.alias("a"), spots.where("gid = pivot").alias("b")
    near = a.join(b, "token").where("a.gid <> b.gid").groupBy(F.col("a.gid").alias("g"), F.col("b.gid").alias("h")).agg(F.count(F.lit(1)).alias("k"), F.max("a.pos").alias("pa"), F.max("b.pos").alias("pb"), F.first("a.n").alias("na"), F.first("b.n").alias("nb"))
    # a group is tried against the one it shares most with; k leaves out what has another least group, so the rounds below see to the others
    near = near.where(_possible(F.col("na"), F.col("nb"), _reach(*map(F.col, ("k", "pa", "pb", "na", "nb")))))
    near = near.groupBy("g").agg(F.max(F.struct("k", "h"))["h"].alias("h"))
    star = near.join(members.withColumnRenamed("gid", "g"), "g").select(F.col("id").alias("a"), F.col("h").alias("b"))
    star = written(star.unionByName(members.where("id <> gid").select(F.col("id").alias("a"), F.col("gid").alias("b"))).distinct(), "join-star")
    part = components(_linked(star, named))
    discard(star)

    def placed(part: DataFrame) -> DataFrame:
        return written(members.join(part, "id", "left").select("gid", "id", F.coalesce("component", "id").alias("component")), "join-at")

    # rounds against another group of each shingle whose groups are not in one component yet
    for turn in range(rounds):
        at = placed(part)
        mixed = _open(spots, at)
        pivot = mixed.groupBy("token").agg(F.min(F.struct(F.xxhash64("gid", F.lit(turn)), "component", "rep", "n", "pos")).alias("p"))
        tried = mixed.join(pivot, "token").where("component <> p.component").where(_possible(F.col("n"), F.col("p.n"), _room(F.col("pos"), F.col("p.pos"), F.col("n"), F.col("p.n"))))
        tried = tried.groupBy("gid", "component", "n", F.col("p.rep").alias("b"), F.col("p.n").alias("nb")).agg(F.count(F.lit(1)).alias("k"), F.max("pos").alias("pa"), F.max("p.pos").alias("pb"))
        # what is not tried here is left to the end
        tried = tried.where(_possible(F.col("n"), F.col("nb"), _reach(*map(F.col, ("k", "pa", "pb", "n", "nb"))))).groupBy("gid", "component").agg(F.max(F.struct("k", "b"))["b"].alias("b"))
        tried = written(tried.join(at, ["gid", "component"]).select(F.col("id").alias("a"), "b"), "join-round")
        links = _linked(tried, named)
        part = _merged(part, links)
        done = links.isEmpty()
        discard(mixed, at, tried)
        if done:
            break

    # what is left: pairs of groups at the first shingle they share, and pairs of members of one group
    at = placed(part)
    mixed = _open(spots, at)
    x, y = mixed.alias("x"), mixed.alias("y")
    early = _possible(F.col("x.n"), F.col("y.n"), F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")))
    first = ~F.arrays_overlap("x.before", "y.before")
    groups = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.gid") > F.col("y.gid")) & (F.col("x.component") != F.col("y.component")) & early & first)
    groups = groups.select(F.col("x.gid").alias("g"), F.col("x.component").alias("ca"), F.col("y.gid").alias("h"), F.col("y.component").alias("cb")).distinct()
    of = lambda g, i, c: at.select(F.col("gid").alias(g), F.col("id").alias(i), F.col("component").alias(c))
    rest = _shared(groups, mixed).join(of("g", "a", "ca"), ["g", "ca"]).join(of("h", "b", "cb"), ["h", "cb"]).select("a", "b")
    rest = written(rest.unionByName(_inside(at, named, often)).distinct(), "join-rest")
    if not rest.isEmpty():
        part = _merged(part, _linked(rest, named))
    discard(mixed, at, rest)

    of_set = nodes.select("set_key", "id").join(part, "id", "left").select("set_key", F.coalesce("component", "id").alias("component"))
    of_doc = rows.select("doc_id", "set_key").join(of_set, "set_key").select("doc_id", "component")
    out = every.join(of_doc, "doc_id", "left")
    out = out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    nameless = profiles(docs.where("doc_id is null"), np.zeros((0, 2), np.uint64))
    return out.unionByName(nameless.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))
