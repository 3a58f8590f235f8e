"""Exact top-k inner-product search with vector-approximation files.

Every dimension is cut into ``2 ** bits`` equal cells between its least and
greatest value over all rows.  A vector file holds the cell numbers of up to
``vector_block`` vectors, one byte for each dimension; the exact vectors stay in
a table of their own.  Files are dealt to groups and blocks of queries to sets of
a few; a task takes a set and a group, and each block of the set scans the
group's files one after the other.  So tasks are more, not longer, where queries
or vectors are more.

The product of a query with the corner of a vector's cell bounds the score: it
is at most that plus what positive components of the query add over a cell, and
at least that plus what negative ones take away, two constants of the query.  So
one product of cell numbers gives both bounds, and a scan keeps the vectors
whose upper bound reaches the k-th greatest lower bound so far.  Then exact
vectors are read in the order of the bounds: the k best of each query first;
their k-th exact score leaves out what can't reach it; then the rest is read.

A vector that many rows repeat is in a file once for each of its k + 1 smallest
ids only: no other can be among the k best, as a query leaves out its own id.

Vectors that are null or hold null or non-finite components take no part; ties
go to the smaller id; a query meets every row but those with its own id.  Where
queries repeat an id, the one with the least vector counts.
Vectors of another length than the most common one take no part either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FILES = "ids binary, cells binary"
BLOCKS = "block long, q_ids binary, q_exact binary"
BOUNDS = "query_id long, id long, low double, high double"
SCORES = "query_id long, id long, score long"


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, v): floor(scale * x) of each component as double; rows that take no part are gone."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(~bad, v).alias("v")).where("v is not null and id is not null and size(v) > 0")
    return ok.select("id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, bits: int = 8, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding", query_block: int = 1024, vector_block: int = 8192, group_files: int = 64, set_blocks: int = 8) -> DataFrame:
    """For each row of queries (same columns) its k greatest scores: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    v, q = quantised(vectors, id_col, vec_col, scale), quantised(queries, id_col, vec_col, scale)
    # two numbers for each dimension reach the driver
    usual = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if usual is None:
        return v.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score")).limit(0)
    dim = usual["d"]
    v, q = v.where(F.size("v") == dim), q.where(F.size("v") == dim)
    ends = v.agg(*[f(F.col("v")[i]).alias(f"{n}{i}") for n, f in (("a", F.min), ("b", F.max)) for i in range(dim)]).first()
    low, high = np.array(ends[:dim]), np.array(ends[dim:])
    step = np.maximum((high - low) / (1 << bits), 1e-9)

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, m in _blocks(batches, vector_block, dim):
            cells = np.clip((m - low) / step, 0, (1 << bits) - 1).astype(np.uint8)
            # of equal vectors the k + 1 smallest ids
            order = np.lexsort((ids, *m.T))
            fresh = np.concatenate([[True], (m[order][1:] != m[order][:-1]).any(axis=1)])
            nth = np.arange(len(order)) - np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
            stay = np.sort(order[nth <= k])
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids[stay], cells[stay])], ["ids", "cells"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for n, (ids, m) in enumerate(_blocks(batches, query_block, dim)):
            yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + n]), pa.array([ids.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], ["block", "q_ids", "q_exact"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            for block, q_ids, q_exact, ids, cells in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if block != now:
                    if held:
                        yield held.bounds()
                    now, held = block, _Scan(np.frombuffer(q_ids, "<i8"), np.frombuffer(q_exact, "<f8").reshape(-1, dim), low, step, k)
                held.add(np.frombuffer(ids, "<i8"), np.frombuffer(cells, np.uint8).reshape(-1, dim))
        if held:
            yield held.bounds()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.array(batch.column(i).flatten().to_numpy()).reshape(-1, dim) for i in (2, 3))
            if len(a) and np.abs(a).max() * np.abs(b).max() * dim >= 2**53:
                score = [max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(r, s)))) for r, s in zip(a, b)]
            else:
                score = np.einsum("ij,ij->i", a, b).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.int64())], ["query_id", "id", "score"])

    # where queries repeat an id, one vector stands for it
    q = written(q.groupBy("id").agg(F.min("v").alias("v")), "vectors-queries")
    v = written(v, "vectors-exact")
    asked = written(q.mapInArrow(packed, BLOCKS), "vectors-asked")
    files = written(v.mapInArrow(stored, FILES).withColumn("file", F.monotonically_increasing_id()), "vectors-files")
    n = files.count()
    groups = max(1, -(-n // group_files), min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    files = files.withColumn("group", F.pmod(F.xxhash64("file"), F.lit(groups)))
    sets = max(1, -(-asked.count() // set_blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    everywhere = asked.withColumn("set", F.pmod(F.xxhash64("block"), F.lit(sets))).withColumn("group", every(groups))
    bounds = written(everywhere.join(files.withColumn("set", every(sets)).hint("merge"), ["set", "group"]).select("block", "q_ids", "q_exact", "ids", "cells").mapInArrow(scan, BOUNDS).groupBy("query_id", "id").agg(F.max("low").alias("low"), F.max("high").alias("high")), "vectors-bounds")

    def exact(pairs: DataFrame) -> DataFrame:
        both = pairs.select("query_id", "id").join(v, "id").join(q.select(F.col("id").alias("query_id"), F.col("v").alias("w")), "query_id")
        return both.select("query_id", "id", "v", "w").mapInArrow(scored, SCORES)

    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("low"), "id"))
    bar = bounds.withColumn("nth", nth).where(F.col("nth") <= k)
    least = written(bar.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("low")), "vectors-bar")
    left = bounds.join(least.where(F.col("n") == k).select("query_id", F.col("low").alias("bar")), "query_id", "left").where("bar is null or high >= bar").drop("bar")
    left = written(left.withColumn("nth", nth), "vectors-left")
    first = written(exact(left.where(F.col("nth") <= k)), "vectors-first")
    sure = first.groupBy("query_id").agg(F.min("score").alias("sure"))
    rest = left.where(F.col("nth") > k).join(sure, "query_id").where(F.col("high") >= F.col("sure"))
    hits = first.unionByName(exact(rest))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.select("query_id", F.row_number().over(best).alias("rank"), F.col("id").alias("vec_id"), "score").where(F.col("rank") <= k)


def _blocks(batches: Iterator[pa.RecordBatch], most: int, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of at most ``most`` rows (id, v)."""
    ids, rows, size = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            some = batch.slice(at, most)
            ids.append(some.column(0).to_numpy())
            rows.append(np.array(some.column(1).flatten().to_numpy()).reshape(-1, dim))
            size += some.num_rows
            while size >= most:
                i, m = np.concatenate(ids), np.concatenate(rows)
                yield i[:most].astype("<i8"), m[:most].astype("<f8")
                ids, rows, size = [i[most:]], [m[most:]], size - most
    if size:
        yield np.concatenate(ids).astype("<i8"), np.concatenate(rows).astype("<f8")


class _Scan:
    """Bounds of a block of queries over the files of a group."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, low: np.ndarray, step: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.corner, self.weights = q @ low, q * step
        self.up, self.down = np.maximum(self.weights, 0).sum(axis=1), np.minimum(self.weights, 0).sum(axis=1)
        # what the sums of floating-point numbers may be off by
        self.slack = 1e-9 * (np.abs(q) @ np.abs(low) + 256 * np.abs(self.weights).sum(axis=1)) + 1e-6
        self.best = np.full((len(ids), k), -np.inf)
        self.order = np.argsort(ids)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def reach(self) -> np.ndarray:
        """Products below it can't be among the k best."""
        return self.best.min(axis=1) - (self.up - self.down) - 2 * self.slack

    def add(self, ids: np.ndarray, cells: np.ndarray) -> None:
        product = self.weights @ cells.T.astype(float)
        # a query leaves out its own id
        at = self.order[np.minimum(np.searchsorted(self.ids, ids, sorter=self.order), len(self.ids) - 1)]
        own = np.flatnonzero(self.ids[at] == ids)
        product[at[own], own] = -np.inf
        top = product if product.shape[1] <= self.k else np.partition(product, -self.k, axis=1)[:, -self.k :]
        self.best = np.sort(np.concatenate([self.best, top], axis=1), axis=1)[:, -self.k :]
        row, col = np.nonzero((product >= self.reach()[:, None]) & np.isfinite(product))
        self.found.append((row, ids[col], product[row, col]))

    def bounds(self) -> pa.RecordBatch:
        row, ids, product = (np.concatenate(c) for c in zip(*self.found))
        stay = product >= self.reach()[row]
        row, ids, base = row[stay], ids[stay], (product[stay] + self.corner[row[stay]])
        cols = [self.ids[row], ids, base + self.down[row] - self.slack[row], base + self.up[row] + self.slack[row]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "id", "low", "high"])
