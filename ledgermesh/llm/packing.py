"""Mixture-controlled packing by deficit round-robin over source queues.

Documents are dealt to partitions by a hash of their id, so each partition
holds every source.  A partition is cut into segments of about ``segment_ids``
ids.  In a segment every source has a queue.  Each window adds a quantum to the
deficit of each source, its target proportion of the window, and takes from
each queue what its deficit allows, cutting documents at the quantum; room that
is left, because a queue has run out or by rounding, goes to the queues with the
largest deficits.  Deficits carry from window to window; what the segments
before, across partitions, leave owing follows from their totals by prefix sums
and is paid off evenly over the windows of a segment.  So a window misses its proportions only where a segment has less
of a source than its target.  ``targets`` gives weights of sources; without it
the target proportions are those of the whole corpus, since every id is packed
once.  A source that ``targets`` doesn't name has no quantum and fills what room
is left.  Only the last window of a segment is padded.

Null texts count as empty; an empty text has its end id alone; null is a source
of its own; rows that repeat a doc_id are packed each.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, written
from .memory import tidy

SEGMENTS = "part int, seq int, doc_ids array<long>, sources array<string>, sizes array<long>, image binary, width int"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def takes(have: np.ndarray, due: np.ndarray, share: np.ndarray, window: int) -> np.ndarray:
    """Ids that each window takes from each queue (windows x sources).

    have: ids of each queue; due: ids owed to each before the first window, paid
    off evenly over all windows; share: target proportions.
    """
    left, share, total = have.astype(np.int64).tolist(), [float(x) for x in share], int(have.sum())
    windows = -(-total // window)
    pay = [float(d) / max(1, windows) for d in due]
    deficit, out, open_, rate = [0.0] * len(left), [], [], []
    for _ in range(windows):
        if any(not left[i] for i in open_) or not open_:
            # the quanta of the queues that have ids, brought to a window in the target proportions
            open_ = [i for i, n in enumerate(left) if n]
            weight = [share[i] for i in open_] if any(share[i] > 0 for i in open_) else [1.0] * len(open_)
            quantum = [share[i] * window + pay[i] for i in open_]
            lack = (window - sum(quantum) - sum(deficit[i] for i in open_) / max(1, windows - len(out))) / sum(weight)
            quantum = [max(0.0, q + lack * w) for q, w in zip(quantum, weight)]
            whole = sum(quantum)
            rate = [q * window / whole for q in quantum] if whole > 0 else [window / len(open_)] * len(open_)
        room, take = min(window, total), [0] * len(left)
        for i, r in zip(open_, rate):
            deficit[i] += r
            take[i] = min(left[i], max(0, int(deficit[i])))
        rest = room - sum(take)
        while rest:
            # ids that rounding leaves, that a queue lacks, or that the last window has no room for: by deficit, one each or evenly
            able = sorted((i for i in open_ if (take[i] < left[i] if rest > 0 else take[i])), key=lambda i: (take[i] - deficit[i]) * (1 if rest > 0 else -1))
            each, step = max(1, abs(rest) // len(able)), 1 if rest > 0 else -1
            for i in able:
                n = min(each, abs(rest), left[i] - take[i] if step > 0 else take[i])
                take[i] += step * n
                rest -= step * n
        for i in open_:
            left[i] -= take[i]
            deficit[i] -= take[i]
        total -= room
        out.append(take)
    return np.array(out, np.int64).reshape(-1, len(have))


def fill_windows(queue: np.ndarray, sizes: np.ndarray, due: np.ndarray, share: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Document index, start, length, window number and offset of each piece; queue: the number of each document's queue."""
    taken = takes(np.bincount(queue, sizes, len(share)).astype(np.int64), due, share, window)
    base = np.cumsum(taken, axis=1) - taken
    parts = []
    for k in np.unique(queue):
        docs = np.flatnonzero(queue == k)
        doc_end, take_end = np.cumsum(sizes[docs]), np.cumsum(taken[:, k])
        end = np.union1d(doc_end, take_end)
        end = end[end > 0]
        start = np.concatenate([[0], end[:-1]])
        doc, number = np.searchsorted(doc_end, start, side="right"), np.searchsorted(take_end, start, side="right")
        parts.append((docs[doc], start - (doc_end - sizes[docs])[doc], end - start, number, base[number, k] + start - (take_end - taken[:, k])[number]))
    return tuple(np.concatenate(c) for c in zip(*parts))


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = 2048, segment_ids: int = 4_000_000, targets: dict[str | None, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Pack whole documents into sequences of at most ``window`` tokens; one row per piece."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .tokens import TextEncoder

        part, enc, seq = TaskContext.get().partitionId(), TextEncoder(tokenizer), 0
        end = np.array([end_id], enc.dtype)
        names, sources, sizes, held, total = [], [], [], [], 0

        def flush():
            nonlocal seq, names, sources, sizes, held, total
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([names], pa.list_(pa.int64())), pa.array([sources], pa.list_(pa.string())), pa.array([sizes], pa.list_(pa.int64())), pa.array([np.concatenate(held).tobytes()], pa.binary()), pa.array([enc.dtype.itemsize], pa.int32())], ["part", "seq", "doc_ids", "sources", "sizes", "image", "width"])
            seq, names, sources, sizes, held, total = seq + 1, [], [], [], [], 0
            return row

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                for doc, source, ids in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), enc.encode(some.column(2).to_pylist()), strict=True):
                    names.append(doc)
                    sources.append(source)
                    sizes.append(len(ids) + 1)
                    held += [ids, end]
                    total += len(ids) + 1
                    if total >= segment_ids:
                        yield flush()
        if names:
            yield flush()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes, names = np.array(row["sizes"], np.int64), [c["source"] for c in row["carry"]]
                number = {n: i for i, n in enumerate(names)}
                queue = np.array([number[n] for n in row["sources"]])
                ids = np.frombuffer(row["image"], f"<u{row['width']}").astype("<u4").data.cast("B")
                due, share = (np.array([c[k] for c in row["carry"]], float) for k in ("due", "share"))
                doc, start, length, window_no, offset = fill_windows(queue, sizes, due, share, window)
                first = (np.cumsum(sizes) - sizes)[doc] + start
                crc = [zlib.crc32(ids[a:b]) for a, b in zip((4 * first).tolist(), (4 * (first + length)).tolist())]
                doc_id = pa.array(row["doc_ids"], pa.int64()).take(pa.array(doc))
                source = pa.array(names, pa.string()).take(pa.array(queue[doc]))
                cols = [doc_id, pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(sizes[doc]), pa.array(row["first_sequence"] + window_no), pa.array(offset), source]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text")).repartition("doc_id")
    held = written(dealt.mapInArrow(tidy(segments), SEGMENTS), "packing")
    carry = written(_carry(held, window, targets), "packing-carry")
    small = carry.agg(F.coalesce(F.sum(F.size("carry")), F.lit(0))).first()[0] <= BROADCAST_IDS
    return held.join(F.broadcast(carry) if small else carry, ["part", "seq"]).mapInArrow(tidy(pieces), PIECES)


def _carry(held: DataFrame, window: int, targets: dict[str | None, float] | None) -> DataFrame:
    """For each segment: its first sequence number, and each of its sources' share and tokens due at its start."""
    one = held.select("part", "seq", F.explode(F.arrays_zip("sources", "sizes")).alias("d"))
    got = one.groupBy("part", "seq", F.col("d.sources").alias("source")).agg(F.sum("d.sizes").alias("n"))
    got = written(got, "packing-got")
    up_to_seq = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    up_to_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    # totals of all sources: prefix sums over the segments of a partition, and over partitions (a setting bounds them)
    seg = got.groupBy("part", "seq").agg(F.sum("n").alias("n")).withColumn("windows", F.ceil(F.col("n") / window))
    parts = seg.groupBy("part").agg(F.sum("n").alias("n"), F.sum("windows").alias("windows"))
    parts = parts.select("part", zero(F.sum("n").over(up_to_part)).alias("n0"), zero(F.sum("windows").over(up_to_part)).alias("w0"))
    seg = seg.select("part", "seq", zero(F.sum("n").over(up_to_seq)).alias("n1"), zero(F.sum("windows").over(up_to_seq)).alias("w1")).join(parts, "part")
    seg = seg.select("part", "seq", (F.col("n0") + F.col("n1")).alias("all_before"), (F.col("w0") + F.col("w1")).alias("first_sequence"))
    # the same for each source
    of_part = got.groupBy("part", "source").agg(F.sum("n").alias("n"))
    of_part = of_part.select("part", "source", zero(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("s0"))
    own = got.select("part", "seq", "source", zero(F.sum("n").over(Window.partitionBy("part", "source").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))).alias("s1"))
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    own = own.alias("a").join(of_part.alias("b"), (F.col("a.part") == F.col("b.part")) & same).select("a.part", "a.seq", "a.source", (F.col("s0") + F.col("s1")).alias("got_before"))
    whole = got.groupBy("source").agg(F.sum("n").alias("n"))
    if targets is not None:
        weight = F.lit(0.0)
        for source, w in targets.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(float(w))).otherwise(weight)
        whole = whole.withColumn("n", weight)
    # one row meets the sources
    whole = whole.crossJoin(whole.agg(F.sum("n").alias("all"))).select("source", F.coalesce(F.try_divide("n", "all"), F.lit(0.0)).cast("double").alias("share"))
    own = own.alias("a").join(whole.alias("b"), same).select("part", "seq", "a.source", "share", "got_before").join(seg, ["part", "seq"])
    due = F.col("share") * F.col("all_before") - F.col("got_before")
    return own.groupBy("part", "seq").agg(F.first("first_sequence").alias("first_sequence"), F.collect_list(F.struct("source", "share", due.alias("due"))).alias("carry"))
