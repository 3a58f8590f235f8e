"""Row labels: normal form and the role of an article."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_label(label: Column) -> Column:
    """Without bracketed parts, blanks collapsed, lower case."""
    bare = F.regexp_replace(label, r"\([^)]*\)|（[^）]*）", " ")
    return F.lower(F.trim(F.regexp_replace(bare, r"(?U)\s+", " ")))


def article_role(label: Column, check_row: Column, has_formula: Column) -> Column:
    """check, output, actual_adjustment, assumption, database_like (no formula in the row) or calculation."""
    low = normalize_label(label)
    # fixed values: the words of each role
    return (
        F.when(check_row, "check")
        .when(low.rlike(r"итого|total|всего"), "output")
        .when(low.rlike(r"корректир|adjustment|plug"), "actual_adjustment")
        .when(low.rlike(r"ставк|assumption|допущен|(?U)\brate\b"), "assumption")
        .when(~has_formula, "database_like")
        .otherwise("calculation")
    )
