"""Year slots from finer periods: balances take their last value, flows add up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def year_rollup(monthly: DataFrame) -> DataFrame:
    """book, concept, period_key (year), role (of the last month), value from facts with keys YYYY-MM.

    Rates and ratios add up too, as flows do; months without a number are left out.
    """
    known = F.when(F.col("value").isNotNull(), F.struct("period_key", "value"))
    last, flow = F.max(known)["value"], F.sum("value")
    out = monthly.groupBy("book", "concept", F.col("period_key").substr(1, 4).alias("year")).agg(last.alias("last"), flow.alias("flow"), F.max(F.struct("period_key", "role"))["role"].alias("role"))
    return out.select("book", "concept", F.col("year").alias("period_key"), "role", F.when(F.col("concept").startswith("bs."), F.col("last")).otherwise(F.col("flow")).alias("value"))


def year_lines(facts: DataFrame) -> DataFrame:
    """book, concept, period_key (year), kind, role, value, refs from facts with keys YYYY, YYYY-MM and YYYYQn.

    A year of its own counts (kind y), else its months (m), else its quarters if
    all four are there (q).  Of months and quarters balances take the last number
    and flows add up, numbers that are missing left out; a year without any number
    has none.  refs: the cells (ref, where facts have it) that the amount comes from.
    """
    key = F.col("period_key")
    ref = (F.col("ref") if "ref" in facts.columns else F.lit(None)).cast("string")
    kinds = {"y": r"^\d{4}$", "m": r"^\d{4}-\d\d$", "q": r"^\d{4}Q[1-4]$"}
    aggs = []
    for k, pattern in kinds.items():
        on = key.rlike(pattern)
        known = on & F.col("value").isNotNull()
        aggs += [
            F.count_if(on).alias(f"{k}_there"), F.count_distinct(F.when(on, key)).alias(f"{k}_keys"), F.sum(F.when(on, F.col("value"))).alias(f"{k}_sum"),
            F.max(F.when(known, F.struct("period_key", "value", ref.alias("ref")))).alias(f"{k}_last"), F.max(F.when(on, F.struct("period_key", "role")))["role"].alias(f"{k}_role"),
            F.collect_list(F.when(on if k == "y" else known, F.struct("period_key", ref.alias("ref")))).alias(f"{k}_refs"),
        ]
    g = facts.groupBy("book", "concept", key.substr(1, 4).alias("year")).agg(*aggs)
    balance = F.col("concept").startswith("bs.")
    every = lambda k: F.filter(F.transform(F.array_sort(f"{k}_refs"), lambda x: x["ref"]), lambda x: x.isNotNull())
    last = lambda k: F.filter(F.array(F.col(f"{k}_last")["ref"]), lambda x: x.isNotNull())
    amount = lambda k: F.struct(F.lit(k).alias("kind"), F.col(f"{k}_role").alias("role"), F.when(balance, F.col(f"{k}_last")["value"]).otherwise(F.col(f"{k}_sum")).alias("value"), F.when(balance, last(k)).otherwise(every(k)).alias("refs"))
    own = F.struct(F.lit("y").alias("kind"), F.col("y_role").alias("role"), F.col("y_last")["value"].alias("value"), every("y").alias("refs"))
    of = F.when(F.col("y_there") > 0, own).when(F.col("m_there") > 0, amount("m")).when(F.col("q_keys") == 4, amount("q"))
    return g.select("book", "concept", F.col("year").alias("period_key"), of.alias("a")).where("a is not null").select("book", "concept", "period_key", "a.*")


def year_amounts(facts: DataFrame) -> DataFrame:
    """book, concept, period_key (year), role, value as ``year_lines`` gives them."""
    return year_lines(facts).select("book", "concept", "period_key", "role", "value")
