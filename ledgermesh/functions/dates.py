"""Spreadsheet date formats and serial numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_date_format(code: Column) -> Column:
    """Whether a number format shows a date: y or d, or m without h or s, outside of escapes, brackets and quotes."""
    bare = F.lower(F.regexp_replace(code, r'\\.|\[[^\]]*\]|"[^"]*"', ""))
    return F.coalesce(bare.rlike("[yd]") | (bare.contains("m") & ~bare.rlike("[hs]")), F.lit(False))


def serial_to_date(serial: Column, date1904: Column | bool = False) -> Column:
    """Day of a serial number; the 1900 system has a 60th day that no calendar has: null."""
    day = F.floor(serial).cast("int")
    is_1904 = F.lit(date1904) if isinstance(date1904, bool) else date1904
    early, late = F.date_add(F.lit("1899-12-31").cast("date"), day), F.date_add(F.lit("1899-12-30").cast("date"), day)
    by_1900 = F.when((day >= 1) & (day < 60), early).when((day > 60) & (day < 2_958_466), late)
    by_1904 = F.when((day >= 0) & (day < 2_957_004), F.date_add(F.lit("1904-01-01").cast("date"), day))
    return F.when(is_1904, by_1904).otherwise(by_1900)


def display_text(value: Column, number: Column, code: Column, date1904: Column | bool = False) -> Column:
    """What a reader sees: dd.MM.yyyy where the format shows a date, else the stored text."""
    day = serial_to_date(number, date1904)
    return F.when(is_date_format(code) & day.isNotNull(), F.date_format(day, "dd.MM.yyyy")).otherwise(value)
