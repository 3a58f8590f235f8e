"""Numbers as workbooks carry them: text that is parsed on use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The error texts of spreadsheet cells.
ERRORS = ("#REF!", "#VALUE!", "#DIV/0!", "#NAME?", "#N/A", "#NUM!", "#NULL!", "#GETTING_DATA!")
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def as_number(text: Column) -> Column:
    """Text to double: blanks dropped, a comma is a decimal point; errors and other text give null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), "[ \u00a0]", ""), ",", ".")
    return F.when(bare.rlike(_NUMBER), bare.try_cast("double"))


def as_rate(value: Column) -> Column:
    """Percent points to a fraction: above 1 in absolute value they are divided by 100."""
    return F.when(F.abs(value) > 1, value / 100).otherwise(value)


def tolerance(*amounts: Column) -> Column:
    """max(1, one thousandth of the greatest absolute amount)."""
    sizes = [F.abs(a) for a in amounts]
    top = sizes[0] if len(sizes) == 1 else F.greatest(*sizes)
    return F.greatest(F.lit(1.0), top * 0.001)


def differs(got: Column, want: Column, *amounts: Column) -> Column:
    return F.abs(got - want) > tolerance(*amounts)


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)
