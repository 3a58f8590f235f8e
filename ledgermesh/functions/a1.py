"""Cell addresses as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most cells that a range edge expands to; rows and columns of a sheet (fixed values).
RANGE_CAP, ROWS, COLS = 2000, 1_048_576, 16_384


def col_to_index(letters: Column) -> Column:
    """A -> 1, Z -> 26, AA -> 27; null where it isn't letters."""
    up = F.upper(letters)
    value = F.aggregate(F.split(up, ""), F.lit(0), lambda acc, c: acc * 26 + F.ascii(c) - 64)
    return F.when(up.rlike("^[A-Z]+$"), value)


def index_to_col(index: Column) -> Column:
    """1 -> A, 27 -> AA, up to three letters; below 1 counts as 1."""
    n = F.greatest(index, F.lit(1))
    letter = lambda k: F.char((k % 26 + 65).cast("int"))
    two, three = F.floor((n - 1) / 26).cast("int") - 1, F.floor((n - 703) / 676).cast("int")
    return F.concat(F.when(n > 702, letter(three)).otherwise(""), F.when(n > 26, letter(two)).otherwise(""), letter(n - 1))


def address_row(addr: Column) -> Column:
    return F.regexp_extract(addr, r"^\$?[A-Za-z]{1,3}\$?(\d+)$", 1).try_cast("int")


def address_col(addr: Column) -> Column:
    return col_to_index(F.nullif(F.regexp_extract(addr, r"^\$?([A-Za-z]{1,3})\$?\d+$", 1), F.lit("")))


def address(row: Column, col: Column) -> Column:
    return F.concat(index_to_col(col), row.cast("string"))


def sheet_of(ref: Column, default: Column) -> Column:
    """Sheet of 'My Sheet'!A1 or Sheet!A1; the default where none is named."""
    quoted = F.regexp_replace(F.regexp_extract(ref, "^'((?:[^']|'')+)'!", 1), "''", "'")
    plain = F.regexp_extract(ref, r"^([^'!]+)!", 1)
    return F.when(quoted != "", quoted).when(plain != "", plain).otherwise(default)


def body_of(ref: Column) -> Column:
    return F.regexp_replace(ref, r"^('(?:[^']|'')+'|[^'!]+)!", "")


def range_boxes(bodies: Column) -> Column:
    """(r1, c1, r2, c2) of each of an array of A1, A1:B2, A:C or 1:3; corners in order; null where it is no range.

    Each step is a lambda's argument to the next, so nothing is worked out twice.
    """
    bare = lambda c: F.regexp_replace(c, r"\$", "")
    number = lambda c: bare(c).try_cast("int")
    both = lambda e, pattern: e["one"].rlike(pattern) & e["two"].rlike(pattern)

    def corners(e: Column) -> Column:
        def box(r1, c1, r2, c2):
            return F.struct(r1.alias("r1"), c1.alias("c1"), r2.alias("r2"), c2.alias("c2"))

        one, two = e["one"], e["two"]
        return (
            F.when(both(e, r"^\$?[A-Za-z]{1,3}\$?\d+$"), box(address_row(one), address_col(one), address_row(two), address_col(two)))
            .when(both(e, r"^\$?[A-Za-z]{1,3}$"), box(F.lit(1), col_to_index(bare(one)), F.lit(ROWS), col_to_index(bare(two))))
            .when(both(e, r"^\$?\d+$"), box(number(one), F.lit(1), number(two), F.lit(COLS)))
        )

    ends = F.transform(bodies, lambda b: F.struct(F.split_part(b, F.lit(":"), F.lit(1)).alias("one"), F.nullif(F.split_part(b, F.lit(":"), F.lit(2)), F.lit("")).alias("two")))
    ends = F.transform(ends, lambda e: F.struct(e["one"].alias("one"), F.coalesce(e["two"], e["one"]).alias("two")))
    ordered = lambda b: F.struct(F.least(b["r1"], b["r2"]).alias("r1"), F.least(b["c1"], b["c2"]).alias("c1"), F.greatest(b["r1"], b["r2"]).alias("r2"), F.greatest(b["c1"], b["c2"]).alias("c2"))
    return F.transform(F.transform(ends, corners), lambda b: F.when(b.isNotNull(), ordered(b)))


def range_box(body: Column) -> Column:
    return F.get(range_boxes(F.array(body)), F.lit(0))


def box_size(box: Column) -> Column:
    return (box["r2"] - box["r1"] + 1).cast("long") * (box["c2"] - box["c1"] + 1)


def capped_rows(box: Column, i: Column, cap: int = RANGE_CAP) -> Column:
    """How many rows of the i-th column (from 0) of a box are among its first ``cap`` cells, row-major."""
    width, height = box["c2"] - box["c1"] + 1, box["r2"] - box["r1"] + 1
    whole = F.least(height, F.floor(F.lit(cap) / width)).cast("int")
    return whole + F.when((height > whole) & (i < F.lit(cap) - whole * width), 1).otherwise(0)


def explode_range(df: DataFrame, body: Column, cap: int = RANGE_CAP) -> DataFrame:
    """df with a row for each of the first ``cap`` cells of a range, row-major: cell, and truncated.

    The box is a column of its own below the explode, so it is worked out once a range.
    """
    boxed = df.withColumn("_box", range_box(body)).where("_box is not null").withColumn("_size", box_size(F.col("_box")))
    i = F.explode(F.sequence(F.lit(0).cast("long"), F.least("_size", F.lit(cap).cast("long")) - 1))
    each = boxed.withColumn("_i", i)
    width = F.col("_box.c2") - F.col("_box.c1") + 1
    cell = address((F.col("_box.r1") + F.floor(F.col("_i") / width)).cast("long"), (F.col("_box.c1") + F.col("_i") % width).cast("int"))
    return each.withColumn("cell", cell).withColumn("truncated", F.col("_size") > cap).drop("_box", "_size", "_i")


def uses_semicolon(formula: Column) -> Column:
    """Whether a semicolon stands outside of quoted text."""
    return F.coalesce(F.regexp_replace(formula, '"[^"]*"', "").contains(";"), F.lit(False))


#: A quoted text or sheet name, or a cell reference that no name or call continues.
_TOKEN = re.compile(r"""("(?:[^"]|"")*"|'(?:[^']|'')*')|(?<![\w.$])(\$?)([A-Za-z]{1,3})(\$?)(\d+)(?![\w(.])""")


def _letters(n: int) -> str:
    out = ""
    n = max(1, n)
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def _number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


def shifted(formula: str, columns: int, rows: int) -> str:
    """Move the relative references of a formula, at the edge to the first row or column; quoted text, sheet names and absolute parts stay."""

    def move(m: re.Match) -> str:
        if m[1]:
            return m[1]
        col = m[3] if m[2] else _letters(_number(m[3]) + columns)
        row = m[5] if m[4] else str(max(1, int(m[5]) + rows))
        return f"{m[2]}{col}{m[4]}{row}"

    return _TOKEN.sub(move, formula)


def shift_formula(formula: Column, columns: Column, rows: Column) -> Column:
    @F.pandas_udf("string")
    def shift(f: pd.Series, dc: pd.Series, dr: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else shifted(a, int(b), int(c)) for a, b, c in zip(f, dc, dr)])

    return shift(formula, columns, rows)
