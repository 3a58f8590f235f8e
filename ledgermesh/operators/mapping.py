"""Row labels to ontology concepts: glossary, then nearest concept centroid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import normalize_label

TOP, GAP = 0.85, 0.08


def glossary_match(rows: DataFrame, glossary: DataFrame, size_limit: int = 1_000_000) -> DataFrame:
    """Left join on the normalised (label, parent); the glossary is broadcast only below size_limit rows."""
    keyed = rows.withColumn("label_key", normalize_label(F.col("label"))).withColumn("parent_key", F.coalesce(normalize_label(F.col("parent")), F.lit("")))
    g = glossary.select(normalize_label(F.col("label")).alias("label_key"), F.coalesce(normalize_label(F.col("parent")), F.lit("")).alias("parent_key"), "concept").dropDuplicates(["label_key", "parent_key"])
    small = g.limit(size_limit + 1).count() <= size_limit
    return keyed.join(F.broadcast(g) if small else g, ["label_key", "parent_key"], "left")


def guard_gmv(label_key: Column, concept: Column) -> Column:
    """gmv never is revenue, and is its own concept where nothing maps it."""
    return F.when((label_key == "gmv") & (concept.isNull() | (concept == "pnl.revenue")), "pnl.gmv").otherwise(concept)


def centroids(vectors: DataFrame, concept: str, vector: str) -> DataFrame:
    """(concept, v): mean vector of each concept, by partial sums of each dimension."""
    one = vectors.select(F.col(concept).alias("concept"), F.posexplode(F.col(vector)).alias("pos", "x"))
    mean = one.groupBy("concept", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy("concept").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("v"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


#: Rows and centroids of a block.
BLOCK = 2_000


def nearest_concepts(rows: DataFrame, concepts: DataFrame, row_id: str, vector: str, best: int = 5) -> DataFrame:
    """row_id, concept, score, second, ranked: the best concepts of each row by cosine, ties by name; ranked has the first ``best``.

    Rows and centroids are packed in blocks, and each block of rows meets each
    block of centroids in one matrix product.  The usual ontology is one block,
    which travels to the rows; of several the best are merged.  A vector that is
    null, of zeros or of another length than the centroids has no concept.
    """
    kind, named = rows.schema[row_id].dataType.simpleString(), concepts.schema["concept"].dataType.simpleString()
    names_and = lambda c, v: f"ids array<{c}>, {v} binary, d int"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1)
            sizes = np.array([len(x) if x is not None else 0 for x in v.to_pylist()])
            for d in np.unique(sizes[sizes > 0]):
                at = pa.array(np.flatnonzero(sizes == d))
                ids, m = batch.column(0).take(at), np.array(v.take(at).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, d)
                length = np.linalg.norm(m, axis=1)
                good = np.flatnonzero(np.isfinite(length) & (length > 0))
                for i in range(0, len(good), BLOCK):
                    some = good[i : i + BLOCK]
                    lists = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), ids.take(pa.array(some)))
                    yield pa.RecordBatch.from_arrays([lists, pa.array([(m[some] / length[some, None]).tobytes()], pa.binary()), pa.array([int(d)], pa.int32())], ["ids", "m", "d"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, y = (np.frombuffer(row[k]).reshape(-1, row["d"]) for k in ("m", "c"))
                names = row["names"]
                order = np.array(sorted(range(len(names)), key=names.__getitem__))
                s = x @ y[order].T
                top = np.argsort(-s, axis=1, kind="stable")[:, :best]
                found = [[{"score": float(s[i, k]), "concept": names[order[k]]} for k in t] for i, t in enumerate(top)]
                pairs = pa.list_(pa.struct([("score", pa.float64()), ("concept", batch.schema.field("names").type.value_type)]))
                ids = pa.array(row["ids"], batch.schema.field("ids").type.value_type)
                yield pa.RecordBatch.from_arrays([ids, pa.array(found, pairs)], ["_id", "ranked"])

    doubles = lambda df, i, v: df.select(i, F.col(v).cast("array<double>").alias("v"))
    left = doubles(rows, row_id, vector).mapInArrow(pack, names_and(kind, "m"))
    n = concepts.count()
    parts = max(1, -(-n // BLOCK))
    right = doubles(concepts, "concept", "v").repartition(parts).mapInArrow(pack, names_and(named, "m")).select(F.col("ids").alias("names"), F.col("m").alias("c"), "d")
    if parts == 1:
        both = left.join(F.broadcast(right), "d")
    else:
        # each block of rows meets each block of centroids, dealt by both over all tasks
        deals, every = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        both = left.withColumn("deal", F.pmod(F.xxhash64("m"), F.lit(deals)).cast("int")).withColumn("part", every(parts))
        both = both.join(right.withColumn("part", F.pmod(F.xxhash64("c"), F.lit(parts)).cast("int")).withColumn("deal", every(deals)), ["d", "part", "deal"])
    out = both.select("ids", "m", "names", "c", "d").mapInArrow(score, f"_id {kind}, ranked array<struct<score:double,concept:{named}>>")
    order = lambda x, y: F.when(x["score"] > y["score"], -1).when(x["score"] < y["score"], 1).when(x["concept"] < y["concept"], -1).otherwise(1)
    out = out.groupBy("_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ranked")), order), 1, best).alias("ranked"))
    first = lambda n, c: F.try_element_at("ranked", F.lit(n))[c]
    return out.select(F.col("_id").alias(row_id), first(1, "concept").alias("concept"), first(1, "score").alias("score"), first(2, "score").alias("second"), "ranked")


def confident(score: Column, second: Column, top: float = TOP) -> Column:
    return (score >= top) & (second.isNull() | (score - second >= GAP))


def questions(rows: DataFrame, book: str = "book") -> DataFrame:
    """A numbered question for each unmapped row, in row order."""
    nth = F.row_number().over(Window.partitionBy(book).orderBy("row"))
    return rows.where("concept is null").withColumn("question_id", F.format_string("q_%03d", nth))


def cascade(rows: DataFrame, *sources: tuple[str, str]) -> DataFrame:
    """rows with concept and source: the first of the columns (name, column) that maps a row, else source question.

    The columns hold what the glossary, the rules, the nearest centroid and any
    other source say, null where they say nothing; gmv is never taken for revenue.
    """
    kept = [F.when(guard_gmv(F.col("label_key"), F.col(c)) == F.col(c), F.col(c)) for _, c in sources]
    concept = guard_gmv(F.col("label_key"), F.coalesce(*kept))
    source = F.coalesce(*[F.when(k.isNotNull(), name) for (name, _), k in zip(sources, kept)], F.when(concept.isNotNull(), "rule"), F.lit("question"))
    return rows.withColumn("source", source).withColumn("concept", concept)
