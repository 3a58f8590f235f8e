"""Mixing sources to target weights by weighted fair queueing.

Sources share a budget by weight; no source gets more than ``repeats`` times
its size, and the excess is shared again by weight.  Each document comes up to
``repeats`` times.  A copy's virtual finish time is the tokens of its source up
to and with it, in a shuffled order, over the target of the source; half of the
copy's own tokens are left out of it, so that the cut rounds to the nearest
document instead of always leaving the last one out.  All copies are sorted by
virtual time over ranges, and the sequence is cut where its running sum reaches
the budget.  Then ``evened`` times each source gets or loses one copy of the
document that brings it nearest to its target, which matters where a source is
a few documents only.

Running sums are made in two steps, so that no source and no list of sources
meets in one task: sums within a task's range, or within (source, salt) buckets
of the shuffled order, plus the totals of what comes before.  The number of
buckets grows with the rows.

Null text has size 0; null is a source of its own (last); documents of size 0
are taken 0 words; rows that repeat a doc_id are told apart by nothing else
than their place among equals, so each gets its own line.  An empty table gives
an empty mix.  Only id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, written

#: Rows of a bucket of the shuffled order, about.
BUCKET_ROWS = 20_000


def words(text: Column) -> Column:
    """Number of runs of characters that are no white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def running(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """df with the running sums, up to and with each row, of a global sort by ranges; order tells all rows apart."""
    dealt = df.select("*", *[c.alias(n) for n, c in sums.items()]).repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt = written(dealt, "running")
    # a row for each range
    totals = dealt.groupBy("_range").agg(*[F.sum(n).alias(f"_{n}") for n in sums])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums])
    upto = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(totals), "_range")
    for n in sums:
        out = out.withColumn(n, F.col(f"_{n}") + F.sum(n).over(upto))
    return out.drop("_range", *[f"_{n}" for n in sums])


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, repeats: int = 3) -> DataFrame:
    """(source, source_size, target, weight) from (source, source_size), one row per source.

    Weights repeat over the sources by code point, null last.  Water filling: in
    the order of cap over weight, a source stays at its cap while the level that
    the rest could have is not below it.
    """
    by_name = F.col("source").asc_nulls_last()
    w = running(sizes, [by_name], nth=F.lit(1).cast("long"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("nth") - 1) % len(weights) + 1).cast("int")).cast("double")
    w = w.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(repeats)).alias("cap"))
    w = w.withColumn("ratio", F.col("cap") / F.col("weight"))
    w = written(running(w, [F.col("ratio"), by_name], caps=F.col("cap"), weights=F.col("weight")), "mixing-caps")
    whole = w.agg(F.sum("source_size").alias("all_sizes"), F.sum("weight").alias("all_weights"))
    rest = F.col("all_weights") - F.col("weights") + F.col("weight")
    w = w.crossJoin(F.broadcast(whole)).withColumn("level", (F.col("all_sizes") * share - F.col("caps") + F.col("cap")) / rest)
    # the first source that is not capped sets the level of all that follow
    first = w.agg(F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", F.col("source").isNull().alias("last"), "source", "level")))["level"].alias("common"))
    w = w.drop("level").crossJoin(F.broadcast(first))
    return w.select("source", "source_size", F.least("cap", F.coalesce("common", F.lit(float("inf"))) * F.col("weight")).alias("target"), "weight")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, repeats: int = 3, evened: int = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target (both of its source), taken, source."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"))
    d = written(d.withColumn("key", F.xxhash64("doc_id", F.lit(seed))), "mixing")
    bits = max(4, (d.count() // BUCKET_ROWS).bit_length())
    d = d.withColumn("salt", F.shiftrightunsigned("key", 64 - bits))
    buckets = written(d.groupBy("source", "salt").agg(F.sum("size").alias("n")), "mixing-buckets")
    goal = written(targets(buckets.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, repeats), "mixing-targets")
    earlier = Window.partitionBy("source").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    start = buckets.select("source", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    start = start.alias("a").join(goal.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "salt", "before", "source_size", "target")
    # the order within a bucket: the hash, then what tells rows apart
    order = Window.partitionBy("source", "salt").orderBy("key", "doc_id", "size")
    d = d.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(order))
    d = d.alias("d").join(start.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.salt") == F.col("s.salt")))
    d = d.select("doc_id", "d.source", "key", "nth", "size", "source_size", "target", (F.col("before") + F.col("upto")).alias("upto"))
    d = written(d, "mixing-order")

    def place(copy: Column) -> Column:
        """Where a copy of a document stands in the sequence; no two copies stand at one place."""
        time = (copy * F.col("source_size") + F.col("upto") - F.col("size") / 2) / F.col("target")
        return F.struct(time.alias("time"), F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none"), F.col("key").alias("key"), F.col("nth").alias("nth"), copy.cast("int").alias("copy"))

    every = F.sequence(F.lit(0), F.lit(repeats - 1))
    copies = d.where("size > 0").withColumn("c", F.explode(every)).select(place(F.col("c")).alias("place"), "size")
    budget = goal.agg(F.sum("target").alias("t")).first()["t"] or 0.0
    # the last copy of the sequence whose middle is within the budget
    cut = running(copies, [F.col("place")], spent=F.col("size")).where(F.col("spent") - F.col("size") / 2 <= budget).agg(F.max("place").alias("cut"))
    n = F.size(F.filter(every, lambda c: F.coalesce(place(c) <= F.col("cut"), F.lit(False))))
    out = written(d.crossJoin(F.broadcast(cut)).withColumn("n", F.when(F.col("size") > 0, n).otherwise(0)), "mixing-copies")
    for _ in range(evened):
        out = written(_evened(out, repeats), "mixing-copies")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n")).cast("long").alias("taken"), "source")


def _evened(d: DataFrame, repeats: int) -> DataFrame:
    """d with one copy more, or less, of the document of each source that brings it nearest to its target."""
    got = written(d.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("n"))).alias("gap")), "mixing-gaps")
    small = got.count() <= BROADCAST_IDS // 4
    d = d.alias("d").join((F.broadcast(got) if small else got).alias("g"), F.col("d.source").eqNullSafe(F.col("g.source"))).drop(F.col("g.source"))
    can = F.when(F.col("gap") > 0, F.col("n") < repeats).otherwise(F.col("n") > 0) & (F.col("size") > 0)
    after = F.abs(F.abs("gap") - F.col("size"))
    best = d.groupBy("source").agg(F.min(F.when(can & (after < F.abs("gap")), F.struct(after, "key", "nth"))).alias("best"))
    best = best.where("best is not null").select(F.col("source").alias("s"), F.col("best.key").alias("k"), F.col("best.nth").alias("t"))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("key") == F.col("k")) & (F.col("nth") == F.col("t"))
    out = d.join(F.broadcast(best) if small else best, same, "left")
    return out.withColumn("n", F.when(F.col("k").isNotNull(), F.col("n") + F.sign("gap").cast("int")).otherwise(F.col("n"))).drop("s", "k", "t", "gap")
