"""Removal of repeated byte strings: prefix doubling over the positions that can repeat.

A byte is removed if a string of ``length`` bytes that covers it also starts
anywhere else in the corpus, in the same document or another; strings may
overlap and never cross documents.

Doubling ranks positions by the string of k bytes that starts there, sorts pairs
(rank of p, rank of p + k), gives them new ranks for 2 k, and drops a position
once its rank is unique.  A round over all positions of a corpus sorts 24 bytes
or more for each byte of text, so what can't repeat, or surely does, is settled
first by content, and the rest is doubled:

1. Every window of ``length`` bytes has a least hash of its ``GRAM``-byte
   strings.  Neighbouring windows mostly share that string: a segment is a run of
   them, about 1 in 170 bytes.  Equal windows have equal least strings, so
   segments whose string no other has drop out.
2. Segments are compared by all of their content.  Where another has the same,
   every window of the segment repeats, and it is settled.
3. Of each content one segment stays; where a least string has several of these,
   they are cut to runs of at most ``STEP`` windows, by the distance to the first
   place of their least string, which equal windows have in common.  Runs whose
   windows share a string with no other run drop out, and a run whose whole
   content is not unique is settled.
4. The windows of the other runs lie where repeats end.  These are doubled: for
   k = 64, 128, 256 Spark sorts the pairs of the rank of p for k bytes and the
   name of what follows up to 2 k (``length`` at last), numbers the pairs that
   occur more than once in their order, and leaves out windows whose pair is
   unique.  Windows left after the last round repeat.

Names are polynomials of contents modulo 2 ** 64, which slide fast but give some
pairs of contents the same value whatever the base: they only leave things out.
Where equal names settle that bytes go, the proof must be equal too, 64 bits of a
hash of another kind over the same bytes.  Equal contents
meet by a shuffle in which partial counts are merged first; tables of names that
repeat are written before rows are joined to them, so that Spark can split a
name that very many rows have.

Null text counts as empty; texts shorter than ``length`` stay whole.  Rows that
repeat are documents of their own, so they repeat each other.  Only id and text
are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, ids_only, written
from .shingles import _SEED, mixed, powers

GRAM = 64
STEP = 16
KEY = ["k1", "k2"]
SEGMENTS = "k1 long, k2 long, first int, last int, gram long, name long, proof long, again boolean"
RUNS = "core long, name long, proof long, k1 long, k2 long, first int, last int, open boolean"
#: Parts of a window that a round of doubling adds; the last ends with the window.
PARTS = (0, 64, 128, 256)
WINDOWS = "k1 long, k2 long, pos int, open boolean, proof long, " + ", ".join(f"h{k} long" for k in PARTS)
_VALUE = _SEED.integers(1, 2**63, 256, dtype=np.uint64)


def _sums(a: np.ndarray) -> np.ndarray:
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_VALUE[a] * powers(len(a) + 1)[0][: len(a)], out=total[1:])
    return total


def _proofs(a: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    raw, digest = memoryview(a), xxhash.xxh3_64_intdigest
    return np.array([digest(raw[s:e]) for s, e in zip(start.tolist(), end.tolist())], np.uint64)


def _hashes(total: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
    """Hashes of the strings between prefix sums."""
    back = powers(len(total))[1]
    return (total[end] - total[start]) * back[start]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, in about log2(width) passes."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def segments_of(a: np.ndarray, length: int, seen: np.ndarray):
    """(first, last, gram, name, proof, again) of the segments of a text; again: its gram occurs more than once here.

    seen: 65,536 False values, left so.
    """
    total, n = _sums(a), len(a)
    grams = _hashes(total, slice(0, n - GRAM + 1), slice(GRAM, n + 1))
    rank = sliding_min(grams, length - GRAM + 1)
    first = np.concatenate([[0], np.flatnonzero(rank[1:] != rank[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [len(rank) - 1]])
    gram = rank[first]
    name = mixed(_hashes(total, first, last + length) + (last - first).astype(np.uint64))
    proof = _proofs(a, first, last + length)
    low = np.uint64(0xFFFF)
    seen[gram & low] = True
    at = grams[seen[grams & low]]
    seen[gram & low] = False
    value, count = np.unique(at, return_counts=True)
    again = count[np.searchsorted(value, gram)] > 1
    return first.astype(np.int32), last.astype(np.int32), gram, name, proof, again


def runs_of(a: np.ndarray, parts: list[tuple[int, int, bool]], length: int):
    """(core, name, proof, first, last, open) of the runs of some segments (first, last, open) of a text."""
    total, n = _sums(a), len(a)
    grams = _hashes(total, slice(0, n - GRAM + 1), slice(GRAM, n + 1))
    reach = length - GRAM + 1
    first, last, place, flag = [], [], [], []
    for f, e, is_open in parts:
        window = grams[f : f + reach]
        spots = f + np.flatnonzero(grams[f : e + reach] == window.min())
        pos = np.arange(f, e + 1)
        spot = spots[np.searchsorted(spots, pos)]
        cut = np.flatnonzero((np.diff(spot) != 0) | (np.diff((spot - pos) // STEP) != 0)) + 1
        first.append(pos[np.concatenate([[0], cut])])
        last.append(pos[np.concatenate([cut - 1, [len(pos) - 1]])])
        place.append(spot[np.concatenate([[0], cut])])
        flag += [is_open] * (len(cut) + 1)
    first, last, place = (np.concatenate(x) for x in (first, last, place))
    far = (place - first) // STEP * STEP  # least distance of the full run
    core = mixed(_hashes(total, place - far, place - far - STEP + 1 + length)) + far.astype(np.uint64)
    shape = ((place - first) * 1024 + (place - last)).astype(np.uint64)
    name = mixed(_hashes(total, first, last + length)) + mixed(shape)
    proof = _proofs(a, first, last + length)
    return mixed(core), mixed(name), proof, first.astype(np.int32), last.astype(np.int32), np.array(flag)


def window_parts(a: np.ndarray, first: list[int], last: list[int], length: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Positions of the windows of some segments, their proofs and the names of their parts."""
    total = _sums(a)
    pos = np.concatenate([np.arange(f, e + 1) for f, e in zip(first, last)])
    ends = [min(k, length) for k in (*PARTS[1:], length)]
    parts = [mixed(_hashes(total, pos + min(k, length), pos + end)) for k, end in zip(PARTS, ends)]
    return pos, _proofs(a, pos, pos + length), parts


def doubled(windows: DataFrame) -> DataFrame:
    """(k1, k2, pos) of the open windows that repeat, by rounds of sorting pairs of ranks."""
    left, held = windows.withColumn("rank", F.lit(0).cast("long")), windows
    for k in PARTS:
        pair = ["rank", f"h{k}", *(["proof"] if k == PARTS[-1] else [])]
        # pairs that occur more than once, an open window among them, in their order
        more = left.groupBy(*pair).agg(F.count(F.lit(1)).alias("c"), F.max("open").alias("open")).where("c > 1 and open").select(*pair)
        more = written(more, "suffix-pairs")
        ranks = more.repartitionByRange(*pair).sortWithinPartitions(*pair).withColumn("next", F.monotonically_increasing_id())
        ranks = written(ranks, "suffix-ranks")
        left = written(ids_only(left, ranks, pair, "inner").drop("rank", f"h{k}").withColumnRenamed("next", "rank"), "suffix-left")
        discard(more, ranks, held)
        held = left
    return left.where("open").select(*KEY, "pos")


def _int64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def repeated_windows(docs: DataFrame, length: int) -> DataFrame:
    """(k1, k2, first, last): runs of window starts that repeat; docs has k1, k2 and text."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 16, bool)
        for batch in batches:
            held, size = [], 0

            def out():
                sizes = [len(h[2]) for h in held]
                keys = [pa.array(np.repeat([h[i] for h in held], sizes)) for i in (0, 1)]
                first, last, gram, name, proof, again = (np.concatenate([h[i] for h in held]) for i in range(2, 8))
                return pa.RecordBatch.from_arrays([*keys, pa.array(first), pa.array(last), _int64(gram), _int64(name), _int64(proof), pa.array(again)], ["k1", "k2", "first", "last", "gram", "name", "proof", "again"])

            for k1, k2, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                a = np.frombuffer(text.encode(), np.uint8)
                if len(a) >= length:
                    held.append((k1, k2, *segments_of(a, length, seen)))
                    size += len(held[-1][2])
                    if size >= 20_000:
                        yield out()
                        held, size = [], 0
            if held:
                yield out()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, text, parts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                core, name, proof, first, last, flags = runs_of(np.frombuffer(text.encode(), np.uint8), [(p["first"], p["last"], p["open"]) for p in parts], length)
                n = len(core)
                yield pa.RecordBatch.from_arrays([_int64(core), _int64(name), _int64(proof), pa.array(np.full(n, k1)), pa.array(np.full(n, k2)), pa.array(first), pa.array(last), pa.array(flags)], ["core", "name", "proof", "k1", "k2", "first", "last", "open"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, text, parts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                first, last, is_open = zip(*((p["first"], p["last"], p["open"]) for p in parts))
                pos, proof, names = window_parts(np.frombuffer(text.encode(), np.uint8), first, last, length)
                flags = np.repeat(is_open, [e - f + 1 for f, e in zip(first, last)])
                n = len(pos)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k1)), pa.array(np.full(n, k2)), pa.array(pos.astype(np.int32)), pa.array(flags), _int64(proof), *map(_int64, names)], ["k1", "k2", "pos", "open", "proof", *(f"h{k}" for k in PARTS)])

    def in_texts(parts: DataFrame, work, schema: str, name: str) -> DataFrame:
        """Apply work to the texts that parts (k1, k2, first, last, open) lie in, with the list of a text's parts."""
        lists = written(parts.groupBy(*KEY).agg(F.collect_list(F.struct("first", "last", "open")).alias("parts")), f"{name}-parts")
        some = ids_only(long_ones.select(*KEY, "text"), lists.select(*KEY), KEY).dropDuplicates(KEY)
        return written(some.join(lists, KEY).select(*KEY, "text", "parts").mapInArrow(work, schema), name)

    long_ones = docs.where(F.octet_length("text") >= length)
    segs = written(long_ones.select(*KEY, "text").mapInArrow(segments, SEGMENTS), "suffix-segments")
    alive = written(segs.groupBy("gram").agg(F.count(F.lit(1)).alias("c"), F.max("again").alias("again")).where("c > 1 or again").select("gram"), "suffix-grams")
    every, segs = segs, written(ids_only(segs, alive, "gram"), "suffix-alive")
    discard(every, alive)
    same = ["gram", "name", "proof"]
    names = segs.groupBy(*same).agg(F.count(F.lit(1)).alias("c"), F.max("again").alias("again"), F.min(F.struct(*KEY, "first", "last")).alias("one"))
    names = written(names, "suffix-names")
    settled = ids_only(segs, written(names.where("c > 1").select(*same), "suffix-equal"), same).select(*KEY, "first", "last")
    several = names.groupBy("gram").agg(F.count(F.lit(1)).alias("k"), F.max("again").alias("again")).where("k > 1 or again").select("gram")
    kept = ids_only(names, written(several, "suffix-several"), "gram").select("one.*", (F.col("c") == 1).alias("open"))

    cut = in_texts(kept, runs, RUNS, "suffix-cut")
    shared = written(cut.groupBy("core").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("core"), "suffix-cores")
    every, cut = cut, written(ids_only(cut, shared, "core"), "suffix-shared")
    discard(every, shared)
    same = ["core", "name", "proof"]
    whole = cut.groupBy(*same).agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(*KEY, "first", "last", "open")).alias("one"))
    whole = written(whole, "suffix-whole")
    settled_runs = ids_only(cut.where("open"), written(whole.where("c > 1").select(*same), "suffix-equal"), same).select(*KEY, "first", "last")
    several = written(whole.groupBy("core").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("core"), "suffix-several")
    ends = ids_only(whole, several, "core").select("one.k1", "one.k2", "one.first", "one.last", (F.col("one.open") & (F.col("c") == 1)).alias("open"))

    single = doubled(in_texts(ends, windows, WINDOWS, "suffix-windows")).select(*KEY, F.col("pos").alias("first"), F.col("pos").alias("last"))
    return settled.unionByName(settled_runs).unionByName(single)


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (start and end of each maximal removed run, in bytes), kept (the other bytes) and n_chars_kept (characters whose first byte is kept) of every row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                some = batch.slice(i, 64)
                spans, kept, sizes, chars = [], [], [], []
                for text, runs in zip(some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True):
                    a = np.frombuffer(text.encode(), np.uint8)
                    step = np.zeros(len(a) + 1, np.int64)
                    np.add.at(step, [r["first"] for r in runs], 1)
                    np.add.at(step, [r["last"] + length for r in runs], -1)
                    gone = np.cumsum(step)[:-1] > 0
                    edge = np.flatnonzero(np.diff(gone, prepend=False, append=False)).tolist()
                    spans.append([{"start": s, "end": e} for s, e in zip(edge[::2], edge[1::2])])
                    kept.append(a[~gone].tobytes())
                    chars.append(int(np.count_nonzero((a[~gone] & 0xC0) != 0x80)))
                    sizes.append(len(a))
                span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()), pa.array(chars, pa.int64())], ["doc_id", "n_bytes", "spans", "kept", "n_chars_kept"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("k1"), F.xxhash64("doc_id", "text").alias("k2"), "text")
    runs = written(repeated_windows(d, length), "suffix-runs")
    runs = written(runs.distinct().groupBy(*KEY).agg(F.collect_list(F.struct("first", "last")).alias("runs")), "suffix-cuts")
    schema = "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary, n_chars_kept long"
    touched = ids_only(d, runs.select(*KEY), KEY).join(runs, KEY).select("doc_id", "text", "runs").mapInArrow(cut, schema)
    none = F.array().cast("array<struct<start:int,end:int>>")
    whole = ids_only(d, runs.select(*KEY), KEY, "left_anti").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("spans"), F.col("text").cast("binary").alias("kept"), F.char_length("text").cast("long").alias("n_chars_kept"))
    return touched.unionByName(whole)
