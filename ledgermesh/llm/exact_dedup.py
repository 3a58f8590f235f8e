"""Exact deduplication by Grace hashing.

Texts are equal when they are identical after each run of white space becomes
one space.  Each scan task first merges its own copies, so a text that fills a
third of the corpus leaves each task once for each ``MEMBERS`` copies.  The
merged records are shuffled by content hash; a task deals its records to spill
files by further bits of the hash, again and again, until what a file holds
fits a table with open addressing that compares complete contents.

Null counts as empty text.  Of equal texts the row with the smallest doc_id
stays (null ids last); of rows that repeat both doc_id and text one stays.
Only the id and the text are read, so other columns don't matter.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS

MEMBERS = 1024
FANOUT_BITS = 4
PARTIAL = "hash long, content string, ids array<long>"
GROUPS = "ids array<long>, keep_id long, group_size long, first boolean, text_sha256 string"

Record = tuple[int, bytes, list]


class ContentTable:
    """Open addressing with linear probing; an entry matches only if its complete content does."""

    def __init__(self):
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def entry(self, h: int, content: bytes) -> int:
        mask = len(self.slots) - 1
        i = h & mask
        while (e := self.slots[i]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e
            i = i + 1 & mask
        self.slots[i] = e = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content) + 200
        if 2 * len(self.hashes) > len(self.slots):
            self._grow()
        return e

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for e, h in enumerate(self.hashes):
            i = h & mask
            while self.slots[i] >= 0:
                i = i + 1 & mask
            self.slots[i] = e


def _replay(file) -> Iterator:
    file.seek(0)
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def grace(records: Iterator[Record], budget: int, level: int = 0) -> Iterator[tuple]:
    """Group records by complete content, holding ``budget`` bytes of contents at once.

    Yields (content, ids, smallest id of the group, its size, whether the one that stays is in ids).
    """
    table, log = ContentTable(), tempfile.SpooledTemporaryFile(max_size=1 << 22)
    for h, content, ids in records:
        pickle.dump((table.entry(h, content), ids), log)
        if table.bytes > budget and FANOUT_BITS * level < 60:
            files = [tempfile.SpooledTemporaryFile(max_size=1 << 20) for _ in range(1 << FANOUT_BITS)]

            def spill(record: Record):
                pickle.dump(record, files[record[0] >> FANOUT_BITS * level & (1 << FANOUT_BITS) - 1])

            for e, ids in _replay(log):
                spill((table.hashes[e], table.contents[e], ids))
            del table, log
            for record in records:
                spill(record)
            for file in files:
                yield from grace(_replay(file), budget, level + 1)
                file.close()
            return
    least: list = [None] * len(table.hashes)
    size = [0] * len(table.hashes)
    for e, ids in _replay(log):
        size[e] += len(ids)
        known = [x for x in ids if x is not None]
        if known and (least[e] is None or min(known) < least[e]):
            least[e] = min(known)
    todo = [True] * len(table.hashes)
    for e, ids in _replay(log):
        first = todo[e] and (least[e] is None or least[e] in ids)
        todo[e] = todo[e] and not first
        yield table.contents[e], ids, least[e], size[e], first
    log.close()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 96 << 20) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    budget: bytes of distinct content that a task holds in its table.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, members = ContentTable(), []

        def out(entries):
            for i in range(0, len(entries), 256):
                some = entries[i : i + 256]
                yield pa.RecordBatch.from_arrays([pa.array([table.hashes[e] for e in some], pa.int64()), pa.array([table.contents[e].decode() for e in some], pa.string()), pa.array([members[e] for e in some], pa.list_(pa.int64()))], ["hash", "content", "ids"])

        for batch in batches:
            for doc, text, h in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                e = table.entry(h, text.encode())
                if e == len(members):
                    members.append([])
                members[e].append(doc)
                if len(members[e]) >= MEMBERS:
                    yield from out([e])
                    members[e] = []
                if table.bytes > budget:
                    yield from out([e for e in range(len(members)) if members[e]])
                    table, members = ContentTable(), []
        yield from out([e for e in range(len(members)) if members[e]])

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []

        def out():
            cols = list(zip(*rows, strict=True))
            types = [pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["ids", "keep_id", "group_size", "first", "text_sha256"])

        records = ((h, c.encode(), ids) for b in batches for h, c, ids in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
        for content, ids, least, size, first in grace(records, budget):
            rows.append((ids, least, size, first, hashlib.sha256(content).hexdigest()))
            if len(rows) >= 1000:
                yield out()
                rows.clear()
        if rows:
            yield out()

    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), f"{WS}+", " ")
    merged = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("h", F.xxhash64("text")).mapInArrow(merge, PARTIAL)
    groups = merged.repartition("hash").mapInArrow(resolve, GROUPS)
    # lists of one hot text lie together: spread them before they become rows
    rows = groups.hint("rebalance").select("*", F.posexplode("ids").alias("pos", "doc_id"))
    at = F.coalesce(F.expr("array_position(ids, keep_id)"), F.lit(1)) - 1
    return rows.select("doc_id", "keep_id", "group_size", (F.col("first") & (F.col("pos") == at)).alias("kept"), "text_sha256")
