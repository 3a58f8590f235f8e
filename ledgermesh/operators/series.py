"""Formula drift along a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import as_number

MAJORITY = 0.70


def trim_edges(points: DataFrame, row: tuple[str, ...], pos: str = "pos") -> DataFrame:
    """Without leading and trailing points that have no template and an empty or zero value."""
    by = Window.partitionBy(*row)
    full = F.col("template").isNotNull() | (F.col("value").isNotNull() & (F.col("value") != 0))
    first, last = F.min(F.when(full, F.col(pos))).over(by), F.max(F.when(full, F.col(pos))).over(by)
    return points.withColumn("first", first).withColumn("last", last).where(F.col(pos).between(F.col("first"), F.col("last"))).drop("first", "last")


#: Fixed value: what an R1C1 reference of a template looks like.
REFERENCE = r"R(?:\[-?\d+\]|\d+)?C(?:\[-?\d+\]|\d+)?"
ROW = ("workbook_id", "sheet", "block_id", "row")


def points(rows: DataFrame, headers: DataFrame, cells: DataFrame) -> DataFrame:
    """A point for each line that is no check row and each column of its block's axis; empty where there is no cell.

    rows: workbook_id, sheet, block_id, row, check_row; headers: workbook_id,
    sheet, block_id, col, role; cells: compiled cells with cached_value.  Columns
    at the first and last forecast column of a block are edges.
    """
    block = Window.partitionBy("workbook_id", "sheet", "block_id")
    forecast = F.when(F.col("role") == "forecast", F.col("col"))
    axis = headers.withColumn("edge_period", F.coalesce(F.col("col").isin(F.min(forecast).over(block), F.max(forecast).over(block)), F.lit(False)))
    every = rows.where(~F.coalesce("check_row", F.lit(False))).select(*ROW).join(axis.select("workbook_id", "sheet", "block_id", "col", "role", "edge_period"), ["workbook_id", "sheet", "block_id"])
    on = ["workbook_id", "sheet", "row", "col"]
    # cells grow behind the compiler, which the planner can't see: never to all tasks
    return every.join(cells.select(*on, "template", "formula_raw", "cached_value", "numbers", "sheets").hint("merge"), on, "left")


def drift(points: DataFrame) -> DataFrame:
    """Points off their row's majority template, with what differs: workbook_id, sheet, block_id, row, col, role, kind, edge_period.

    Leading and trailing points without a formula and a value are left out, then
    the majority must have 70 % of what remains.  A point without a template is a
    value_instead_of_formula; else the first of these that differs counts: the
    sheets it reads (source_sheet_change), numbers but 0 and 1 (literal_in_ast),
    the references (ref_shift), anything else (template_change).
    """
    number = as_number(F.col("cached_value").cast("string"))
    blank = F.trim(F.coalesce(F.col("cached_value").cast("string"), F.lit(""))) == ""
    empty = (F.coalesce("formula_raw", F.lit("")) == "") & (blank | F.coalesce(number == 0, F.lit(False)))
    row = Window.partitionBy(*ROW)
    full = F.when(~empty, F.col("col"))
    p = points.select("*", F.min(full).over(row).alias("_first"), F.max(full).over(row).alias("_last"), F.nullif("template", F.lit("")).alias("_t"))
    p = p.where(F.col("col").between(F.col("_first"), F.col("_last")))
    p = p.withColumn("_n", F.count("_t").over(Window.partitionBy(*ROW, "_t"))).withColumn("_size", F.count(F.lit(1)).over(row))
    plain = F.array_sort(F.array_distinct(F.filter("numbers", lambda x: ~x.isin(0.0, 1.0, -1.0))))
    facts = F.struct(F.col("_n"), F.col("_t"), F.array_sort(F.array_distinct("sheets")).alias("sheets"), plain.alias("numbers"), F.regexp_extract_all("_t", F.lit(REFERENCE), F.lit(0)).alias("refs"))
    p = p.withColumn("_own", facts).withColumn("_major", F.max(F.when(F.col("_t").isNotNull() & (F.col("_n") >= MAJORITY * F.col("_size")), facts)).over(row))
    differs = lambda c: ~F.col(f"_own.{c}").eqNullSafe(F.col(f"_major.{c}"))
    kind = F.when(F.col("_t").isNull(), "value_instead_of_formula").when(differs("sheets"), "source_sheet_change").when(differs("numbers"), "literal_in_ast").when(differs("refs"), "ref_shift").otherwise("template_change")
    off = p.where("_major is not null").where(~F.col("_t").eqNullSafe(F.col("_major._t")))
    return off.select(*ROW, "col", "role", kind.alias("kind"), "edge_period")


def outliers(points: DataFrame, row: tuple[str, ...]) -> DataFrame:
    """Points off the template that at least 70 % of the row's trimmed points share; value cells count in the length."""
    counts = points.groupBy(*row, "template").agg(F.count(F.lit(1)).alias("n"))
    size = F.sum("n").over(Window.partitionBy(*row))
    major = counts.withColumn("size", size).where(F.col("template").isNotNull() & (F.col("n") >= F.lit(MAJORITY) * F.col("size"))).select(*row, F.col("template").alias("majority"))
    off = points.join(major, list(row)).where(F.col("template").isNull() | (F.col("template") != F.col("majority")))
    return off.withColumn("kind", F.when(F.col("template").isNull(), "value_instead_of_formula").otherwise("template_change"))
