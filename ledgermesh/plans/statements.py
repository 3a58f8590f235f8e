"""Statement facts derived from the star-schema tables.

A book is a nation of customers, a period a year (or month) of shipping; up to
1999 periods are historical, then forecast.  Base measures are exact decimal
sums, concepts fixed expressions of them, with planted breaks in some books.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Concept: expression over rev, gross, qty, tax of the period, their running sums (.._c), and book.
CONCEPTS = {
    "pnl.revenue": "rev",
    "pnl.volume": "qty",
    "pnl.price": "CASE WHEN book % 6 = 1 THEN rev / qty * 1.05e0 ELSE rev / qty END",
    "pnl.cogs": "gross * 6e-1",
    "pnl.gross_profit": "CASE WHEN book % 5 = 0 THEN rev - gross * 6e-1 + rev * 2e-2 ELSE rev - gross * 6e-1 END",
    "pnl.opex": "gross * 15e-2",
    "pnl.ebitda": "CASE WHEN book % 7 = 0 THEN rev - gross * 7e-1 ELSE rev - gross * 6e-1 - gross * 15e-2 END",
    "pnl.da": "rev * 5e-2",
    "cf.da": "CASE WHEN book % 8 = 3 THEN rev * -6e-2 ELSE rev * -5e-2 END",
    "pnl.ebit": "CASE WHEN book % 9 = 2 THEN rev * 2e-1 ELSE rev - gross * 6e-1 - gross * 15e-2 - rev * 5e-2 END",
    "pnl.interest": "CASE WHEN book % 4 = 1 THEN rev * 9e-2 ELSE rev * 2e-2 END",
    "pnl.tax": "tax",
    "pnl.net_income": "CASE WHEN book % 11 = 4 THEN rev * -1e-1 ELSE rev * 12e-2 END",
    "cf.cfo": "rev * 14e-2",
    "cf.capex": "gross * -4e-2",
    "cf.fcf": "CASE WHEN book % 6 = 2 THEN rev * 1e-1 - qty * 9e2 ELSE rev * 1e-1 END",
    "cf.dividends": "CASE WHEN book % 3 = 0 THEN rev * 3e-2 ELSE 0e0 END",
    "cf.drawdown": "rev * 4e-2",
    "cf.repayment": "rev * 2e-2",
    "bs.cash": "CASE WHEN book % 12 = 7 THEN rev_c * 9e-2 WHEN book % 6 = 2 THEN rev_c * 1e-1 - qty_c * 9e2 ELSE rev_c * 1e-1 END",
    "bs.retained_earnings": "CASE WHEN book % 3 = 0 THEN rev_c * 9e-2 ELSE rev_c * 12e-2 END",
    "bs.debt": "CASE WHEN book % 10 = 6 THEN rev_c * 5e-2 ELSE rev_c * 2e-2 END",
    "bs.ppe": "CASE WHEN book % 9 = 5 THEN gross_c * 4e-2 - rev_c * 3e-2 ELSE gross_c * 4e-2 - rev_c * 5e-2 END",
    "bs.equity": "rev_c * 12e-2 + 1000000e0",
    "bs.liabilities": "rev_c * 3e-2",
    "bs.assets_total": "CASE WHEN book % 7 = 3 THEN rev_c * 16e-2 + 1000000e0 ELSE rev_c * 15e-2 + 1000000e0 END",
    "bs.ar": "rev * 2e-1 + qty * 5e2",
    "bs.inventory": "gross * 1e-1",
    "bs.ap": "gross * 8e-2",
    "ops.headcount": "qty * 1e-1",
    "pnl.tax_rate": "25e-2",
    "pnl.interest_rate": "8e-2",
    "cov.dscr": "rev / gross + (book % 5) * 1e-1 - 2e-1",
    "covenant.headroom": "rev * 1e-2 - (book % 4) * 1e5",
}


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, month, rev, gross, qty, tax: exact sums, one row a book and month; years are sums of them.

    Lines meet their orders first and are summed by book and month, so that all
    but partial sums of few groups stays in place.
    """
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    dec = lambda c: F.col(c).cast("decimal(18,2)")
    net = dec("l_extendedprice") * (F.lit(1).cast("decimal(5,2)") - F.col("l_discount").cast("decimal(5,2)"))
    lines = t("lineitem").select("l_orderkey", F.date_format("l_shipdate", "yyyy-MM").alias("month"), net.alias("rev"), dec("l_extendedprice").alias("gross"), dec("l_quantity").alias("qty"), (net * F.col("l_tax").cast("decimal(5,2)")).alias("tax"))
    books = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", F.col("c_nationkey").alias("book")), F.col("o_custkey") == F.col("c_custkey"))
    return lines.join(books, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("book", "month").agg(*[F.sum(c).alias(c) for c in NAMES])


NAMES = ("rev", "gross", "qty", "tax")


def base(spark: SparkSession, sf_dir: str, monthly: bool = False, sums: DataFrame | None = None) -> DataFrame:
    """book, period_key, role, rev, gross, qty, tax and running sums: one row per book and period; sums: months, where they are there already."""
    sums = months(spark, sf_dir) if sums is None else sums
    key = F.col("month") if monthly else F.col("month").substr(1, 4)
    sums = sums.groupBy("book", key.alias("period_key")).agg(*[F.sum(c).alias(c) for c in NAMES])
    upto = Window.partitionBy("book").orderBy("period_key").rowsBetween(Window.unboundedPreceding, 0)
    return sums.select("book", "period_key", F.when(F.col("period_key").substr(1, 4) <= "1999", "historical").otherwise("forecast").alias("role"), *[F.col(c).cast("double").alias(c) for c in NAMES], *[F.sum(c).over(upto).cast("double").alias(f"{c}_c") for c in NAMES])


def facts(spark: SparkSession, sf_dir: str, concepts: list[str] | None = None, monthly: bool = False, sums: DataFrame | None = None) -> DataFrame:
    """Long facts: book, concept, period_key, role, value."""
    names = concepts or list(CONCEPTS)
    rows = F.array(*[F.struct(F.lit(c).alias("concept"), F.expr(CONCEPTS[c]).cast("double").alias("value")) for c in names])
    return base(spark, sf_dir, monthly, sums).select("book", "period_key", "role", F.inline(rows))


def base_sql(monthly: bool = False) -> str:
    key = "strftime(l_shipdate, '%Y-%m')" if monthly else "strftime(l_shipdate, '%Y')"
    net = "CAST(l_extendedprice AS DECIMAL(18,2)) * (CAST(1 AS DECIMAL(5,2)) - CAST(l_discount AS DECIMAL(5,2)))"
    sums = {"rev": f"sum(CAST({net} AS DECIMAL(24,4)))", "gross": "sum(CAST(l_extendedprice AS DECIMAL(18,2)))", "qty": "sum(CAST(l_quantity AS DECIMAL(18,2)))", "tax": f"sum(CAST({net} AS DECIMAL(24,4)) * CAST(l_tax AS DECIMAL(5,2)))"}
    one = ", ".join(f"{v} AS {k}" for k, v in sums.items())
    two = ", ".join(f"CAST({k} AS DOUBLE) AS {k}, CAST(sum({k}) OVER (PARTITION BY book ORDER BY period_key) AS DOUBLE) AS {k}_c" for k in sums)
    return f"""base0 AS (SELECT c_nationkey AS book, {key} AS period_key, {one} FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
    base AS (SELECT book, period_key, CASE WHEN substr(period_key, 1, 4) <= '1999' THEN 'historical' ELSE 'forecast' END AS role, {two} FROM base0)"""


def wide_sql(concepts: list[str], monthly: bool = False) -> str:
    """CTEs base and wide: one column per concept, dots as underscores."""
    cols = ", ".join(f"CAST({CONCEPTS[c]} AS DOUBLE) AS {c.replace('.', '_')}" for c in concepts)
    return f"{base_sql(monthly)}, wide AS (SELECT book, period_key, role, {cols} FROM base)"
