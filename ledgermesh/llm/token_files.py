"""Token-id files: a concatenated id array with Elias-Fano document boundaries.

A shard image is, little-endian: magic ``LMT1``, id width in bytes (u1), low-bit
count l (u1), two zero bytes, number of documents n (u4), number of ids (u8),
length of the low part and of the high part in bytes (u8 each), the low bits of
the n + 1 boundaries packed most significant bit first, their high bits in
unary, one u4 of select directory for each ``SAMPLE`` boundaries, and the ids.
Boundaries take about l + 2 bits each; no 64-bit table of them is stored.
``read_token_files`` needs every boundary and decodes those of an image in bulk;
``EliasFano.select`` finds a single one through the directory.

Documents are range-partitioned by doc_id, so images in (part, seq) order hold
ascending doc_ids (null first).  Each image is a row of a Parquet table in a
folder that all executors share, since Spark alone knows every cluster's store.
Null texts count as empty; an empty text has its end id alone; rows that repeat
a doc_id each get an entry; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

MAGIC, SAMPLE = b"LMT1", 64
SHARDS = "part int, seq int, base long, n_ids long, doc_ids array<long>, image binary"
ENTRIES = "part int, doc_id long, local long, n_tokens long, ids_crc32 long"


class EliasFano:
    """A non-decreasing sequence of n values from 0 to u in n * (2 + log2(u / n)) bits or so."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, directory: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.directory = n, low_bits, low, high, directory

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n, u = len(v), int(v[-1]) if len(v) else 0
        low_bits = max(0, (u // max(n, 1)).bit_length() - 1)
        shifts = np.arange(low_bits - 1, -1, -1, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel())
        at = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        bits[at] = 1
        return cls(n, low_bits, low, np.packbits(bits), at[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """The i-th value, from the directory and a scan of a few bytes."""
        at = int(self.directory[i // SAMPLE])
        left, byte = i % SAMPLE, at // 8
        skip = at % 8
        while True:
            ones = np.flatnonzero(np.unpackbits(self.high[byte : byte + 32])[skip:])
            if left < len(ones):
                at = byte * 8 + skip + int(ones[left])
                break
            left, byte, skip = left - len(ones), byte + 32, 0
        first = i * self.low_bits
        raw = np.unpackbits(self.low[first // 8 : (first + self.low_bits + 7) // 8])[first % 8 :][: self.low_bits]
        return (at - i) << self.low_bits | int("0" + "".join(map(str, raw)), 2)

    def all(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(self.high))[: self.n]
        bits = np.unpackbits(self.low)[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.int64)
        low = bits @ (1 << np.arange(self.low_bits - 1, -1, -1, dtype=np.int64))
        return (at - np.arange(self.n)) << self.low_bits | low


def to_image(docs: list[np.ndarray], dtype: np.dtype) -> bytes:
    ids = np.concatenate(docs) if docs else np.zeros(0, dtype)
    ef = EliasFano.of(np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64))
    head = MAGIC + bytes([dtype.itemsize, ef.low_bits, 0, 0]) + len(docs).to_bytes(4, "little")
    sizes = [len(ids), len(ef.low), len(ef.high)]
    return head + b"".join(x.to_bytes(8, "little") for x in sizes) + ef.low.tobytes() + ef.high.tobytes() + ef.directory.tobytes() + ids.tobytes()


def from_image(image: bytes) -> tuple[EliasFano, np.ndarray]:
    """Boundaries and ids of an image."""
    if image[:4] != MAGIC:
        raise ValueError("not a shard image")
    n = int.from_bytes(image[8:12], "little")
    n_ids, n_low, n_high = (int.from_bytes(image[i : i + 8], "little") for i in (12, 20, 28))
    at = 36
    low = np.frombuffer(image, np.uint8, n_low, at)
    high = np.frombuffer(image, np.uint8, n_high, at + n_low)
    at += n_low + n_high
    directory = np.frombuffer(image, "<u4", -(-(n + 1) // SAMPLE), at)
    ids = np.frombuffer(image, f"<u{image[4]}", n_ids, at + 4 * len(directory))
    return EliasFano(n + 1, image[5], low, high, directory), ids


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = 4_000_000) -> DataFrame:
    """Tokenise whole texts in ascending id order and write them as shard images; returns the table of shards.

    shard_ids: an image ends with the document that reaches this many ids.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .tokens import TextEncoder

        part, enc, seq, base = TaskContext.get().partitionId(), TextEncoder(tokenizer), 0, 0
        end = np.array([end_id], enc.dtype)
        names, held, size = [], [], 0

        def flush():
            nonlocal seq, base, names, held, size
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([base]), pa.array([size]), pa.array([names], pa.list_(pa.int64())), pa.array([to_image(held, enc.dtype)], pa.binary())], ["part", "seq", "base", "n_ids", "doc_ids", "image"])
            seq, base, names, held, size = seq + 1, base + size, [], [], 0
            return row

        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                some = batch.slice(i, 2048)
                for doc, ids in zip(some.column(0).to_pylist(), enc.encode(some.column(1).to_pylist()), strict=True):
                    names.append(doc)
                    held.append(np.concatenate([ids, end]))
                    size += len(ids) + 1
                    if size >= shard_ids:
                        yield flush()
        if names:
            yield flush()

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return written(ordered.mapInArrow(shards, SHARDS), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """One row per document of the images: doc_id, start, n_tokens, ids_crc32 of its ids as little-endian u4."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base, names, image in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ef, ids = from_image(image)
                at, wide = ef.all(), ids.astype("<u4").data.cast("B")
                crc = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(crc), pa.int32()), pa.array(names, pa.int64()), pa.array(at[:-1] + base), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["part", "doc_id", "local", "n_tokens", "ids_crc32"])

    # a row for each range partition, whose number is a setting: that bounds the window and the broadcast
    from pyspark.sql import Window

    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    docs = files.select("part", "base", "doc_ids", "image").mapInArrow(entries, ENTRIES)
    return docs.join(F.broadcast(totals), "part").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
