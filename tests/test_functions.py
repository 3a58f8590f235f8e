from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgermesh.functions import a1, dates, periods


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_headers(spark):
    cases = {
        "2025": ("2025", "historical"), "2025E": ("2025", "forecast"), "FY 2025": ("2025", "historical"), "1 кв. 2025": ("2025Q1", "historical"), "Q1 2025": ("2025Q1", "historical"),
        "янв.25": ("2025-01", "historical"), "Jan-25": ("2025-01", "historical"), "2025-01": ("2025-01", "historical"), "2025-01-31": ("2025-01-31", "historical"), "01.07.2022": ("2022-07-01", "historical"),
        "2 024": ("2024", "historical"), "2024 факт": ("2024", "historical"), "2024 план": ("2024", "forecast"), "план": ("plan", "forecast"), "итого": ("total", "total"), "stub": ("stub", "stub"), "Base": ("base", "scenario"),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "x string").select("x", periods.classify_header(F.col("x")).alias("h")).collect()
    assert {r["x"]: tuple(r["h"]) for r in rows} == cases
    assert one(spark, "Revenue", periods.classify_header) is None


def test_range_of_2499_cells_is_cut_at_2000(spark):
    df = spark.createDataFrame([("B2:B2500",), ("B2:A1",)], "r string")
    rows = a1.explode_range(df, F.col("r")).groupBy("r").agg(F.collect_list("cell").alias("c"), F.max("truncated").alias("t")).collect()
    got = {r["r"]: (len(r["c"]), r["t"]) for r in rows}
    assert got == {"B2:B2500": (2000, True), "B2:A1": (4, False)}


def test_serials(spark):
    df = spark.createDataFrame([(1.0,), (59.0,), (60.0,), (61.0,), (45292.0,)], "s double")
    assert [str(r[0]) for r in df.select(dates.serial_to_date(F.col("s"))).collect()] == ["1900-01-01", "1900-02-28", "None", "1900-03-01", "2024-01-01"]
    assert one(spark, "dd/mm/yyyy", dates.is_date_format) and not one(spark, 'h:mm "day"', dates.is_date_format)


@settings(max_examples=200)
@given(st.integers(1, 16000), st.integers(1, 100000), st.integers(0, 300), st.integers(0, 300))
def test_shift_and_back(col, row, dc, dr):
    f = f'=SUM({a1._letters(col)}{row},$B${row})&"A1"'
    assert a1.shifted(a1.shifted(f, dc, dr), -dc, -dr) == f


def test_dated_headers_with_suffixes_and_words(spark):
    from ledgermesh.functions.periods import classify_header

    want = {
        "2025-03E": ("2025-03", "forecast"), "2025-03A": ("2025-03", "historical"), "2024-12-31F": ("2024-12-31", "forecast"), "5.6.24": ("2024-06-05", "historical"), "05/06/2024P": ("2024-06-05", "forecast"),
        "Mar 2025E": ("2025-03", "forecast"), "мар-25": ("2025-03", "historical"), "1 кв. 2025 план": ("2025Q1", "forecast"), "Mar 2025 actual": ("2025-03", "historical"), "2 024 факт": ("2024", "historical"),
        "base case plan": (None, None), "Итого": ("total", "total"), "2025E actual": ("2025", "historical"),
    }
    df = spark.createDataFrame([(k,) for k in want], "t string")
    got = {r["t"]: (r["h"] and r["h"]["period_key"], r["h"] and r["h"]["role"]) for r in df.select("t", classify_header(df["t"]).alias("h")).collect()}
    assert got == want
