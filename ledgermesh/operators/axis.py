"""Period-aligned views of long facts.

Facts have book, concept, period_key, role and value, and where a workbook says
where they come from, block_id, ord (place of the row in the book), article_role
and col.  A line has a fact for every column of its block's axis, null where
there is no number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Roles of the periods that roll forward, and of those that are looked at one by one.
PERIODS = ("historical", "stub", "forecast")
SNAPSHOTS = (*PERIODS, "scenario")


def column_of(concept: str) -> str:
    return concept.replace(".", "_")


def role_rank(role: Column) -> Column:
    """Which column of a period counts: historical before stub before forecast before others."""
    return F.when(role == "historical", 0).when(role == "stub", 1).when(role == "forecast", 2).otherwise(9)


def aligned(facts: DataFrame, concepts: list[str], keys: tuple[str, ...] = ("book", "period_key", "role")) -> DataFrame:
    """One row per key with a column and a has_ flag per concept, by one grouped aggregation for any number of concepts.

    The flag tells "no cell on the axis" from "a cell without a number".
    """
    of = lambda c: F.col("concept") == c
    cols = [F.max(F.when(of(c), F.col("value"))).alias(column_of(c)) for c in concepts]
    flags = [F.coalesce(F.bool_or(of(c)), F.lit(False)).alias(f"has_{column_of(c)}") for c in concepts]
    return facts.where(F.col("concept").isin(concepts)).groupBy(*keys).agg(*cols, *flags)


def axes(facts: DataFrame, views: dict[str, tuple[list[str], tuple[str, ...]]]) -> DataFrame:
    """One row per book, block and period, with a struct of the lines of each view.

    views: name to (concepts, period roles).  Of the columns of a period the one
    with the best role counts, and of the lines of a concept in a block the first
    with role output, else the first.  A view holds four structs with a field for
    each concept: ``own``, the line of the block, and ``top``, the line that stands
    for the concept in the whole book, are null where the period is not on the
    line's axis, else (v: value); ``inside`` and ``anywhere`` tell whether the
    block and the book have the concept at all.
    """
    blocks = "block_id" in facts.columns
    facts = facts.select("book", "concept", "period_key", "role", "value", *[F.col(c) if c in facts.columns else F.lit(d).alias(c) for c, d in (("block_id", ""), ("ord", 0), ("article_role", ""), ("col", 0))])
    fields = [(name, c, column_of(c), roles) for name, (concepts, roles) in views.items() for c in concepts]
    facts = facts.where(F.col("concept").isin(sorted({f[1] for f in fields})))
    line = F.struct((F.coalesce("article_role", F.lit("")) != "output").alias("inner"), "ord", "block_id")
    best = F.struct(line.alias("line"), role_rank(F.col("role")).alias("rank"), "col")
    picks = [F.min_by(F.struct(F.col("value").alias("v"), line.alias("line")), F.when((F.col("concept") == c) & F.col("role").isin(*roles), best)).alias(f"{n}__{k}") for n, c, k, roles in fields]
    wide = facts.groupBy("book", "block_id", "period_key").agg(*picks)
    lone = lambda x: F.when(x.isNotNull(), F.struct(x["v"].alias("v")))
    book, block, at = Window.partitionBy("book"), Window.partitionBy("book", "block_id"), Window.partitionBy("book", "period_key")
    names = [f"{n}__{k}" for n, _, k, _ in fields]
    wide = wide.select("*", *[F.min(F.col(x)["line"]).over(book).alias(f"{x}__line") for x in names])
    if blocks:
        tops = [F.max(F.when(F.col(x)["line"] == F.col(f"{x}__line"), F.col(x))).over(at).alias(f"{x}__top") for x in names]
        inside = [F.max(F.col(x).isNotNull()).over(block).alias(f"{x}__in") for x in names]
        wide = wide.select("*", *tops).select("*", *inside)
    else:
        wide = wide.select("*", *[F.col(x).alias(f"{x}__top") for x in names], *[F.col(f"{x}__line").isNotNull().alias(f"{x}__in") for x in names])
    out = []
    for name, (concepts, _) in views.items():
        of = lambda f, concepts=concepts, name=name: F.struct(*[f(f"{name}__{column_of(c)}").alias(column_of(c)) for c in concepts])
        parts = (("own", lambda x: lone(F.col(x))), ("top", lambda x: lone(F.col(f"{x}__top"))), ("inside", lambda x: F.col(f"{x}__in")), ("anywhere", lambda x: F.col(f"{x}__line").isNotNull()))
        out.append(F.struct(*[of(f).alias(k) for k, f in parts]).alias(name))
    return wide.select("book", "block_id", "period_key", *out)


def previous(valid: Column, value: Column, book: str = "book", order: str = "period_key") -> Column:
    """The value of the last earlier row of the book where valid holds."""
    w = Window.partitionBy(book).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(valid, value), ignorenulls=True).over(w)
