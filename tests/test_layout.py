"""Layout of sheets: bands, axes, blocks and lines, each case as cells in and blocks out."""

import random

import pytest
from pyspark.sql import functions as F

from ledgermesh.functions import periods
from ledgermesh.operators import layout

SCHEMA = "book string, sheet string, row int, col int, cached_value string, number_format string, hidden boolean"


def sheet(text, name="P&L", book="b", hidden=(), dates=()):
    """Cells from lines of '|'-separated values; a line number may stand before a colon."""
    out, row = [], 0
    for line in text.strip("\n").split("\n"):
        number, _, rest = line.partition(":")
        row = int(number) if number.strip().isdigit() and rest else row + 1
        values = (rest if number.strip().isdigit() and rest else line).split("|")
        for col, v in enumerate(values, 1):
            if v.strip():
                out.append((book, name, row, col, v.strip("·").rstrip() if v.startswith("·") else v.strip(), "mm-dd-yy" if row in dates else None, col in hidden))
    return out


CASES = {
    "two axes": (sheet("1:Item|2023|2024E\n2:Revenue|100|110\n10:Item|1 кв. 2025|2 кв. 2025\n11:Revenue|20|30"), {
        "P&L!r1": (["2 2023 historical", "3 2024 forecast"], ["Revenue"]), "P&L!r10": (["2 2025Q1 historical", "3 2025Q2 historical"], ["Revenue"])}),
    "hidden column": (sheet("Secret|Item|2023|2024E\nhidden-label|Revenue|1|2", hidden={1}), {"P&L!r1": (["3 2023 historical", "4 2024 forecast"], ["Revenue"])}),
    "checks": (sheet("Item|2023|2024E\nRevenue|100|110\nПроверка баланса|0|0"), {"P&L!r1": (["2 2023 historical", "3 2024 forecast"], ["Revenue", "Проверка баланса?"])}),
    "months": (sheet("Item|янв.25|фев.25\nCash|100|90"), {"P&L!r1": (["2 2025-01 historical", "3 2025-02 historical"], ["Cash"])}),
    "fact and plan": (sheet("Item|2024 факт|2024 план\nRevenue|100|80"), {"P&L!r1": (["2 2024 historical", "3 2024 forecast"], ["Revenue"])}),
    "dates, years and quarters": (sheet("4:|01.07.2022|01.10.2022|01.01.2023|01.04.2023\n6:|2022|2022|2023|2023\n7:Квартал|3|4|1|2\n8:Revenue|10|11|12|13"), {
        "P&L!r7": (["2 2022Q3 historical", "3 2022Q4 historical", "4 2023Q1 historical", "5 2023Q2 historical"], ["Revenue"])}),
    "banner of a second block": (sheet("1:|01.07.2022|01.10.2022\n2:|2022|2022\n3:Квартал|3|4\n4:Revenue|10|11\n10:Прогноз\n11:|2026|2026\n12:|1 кв.|2 кв.\n13:Revenue|20|21"), {
        "P&L!r3": (["2 2022Q3 historical", "3 2022Q4 historical"], ["Revenue"]), "P&L!r12": (["2 2026Q1 forecast", "3 2026Q2 forecast"], ["Revenue"])}),
    "fact under a banner": (sheet("Прогноз\n|2025|2026|2026|2026\n|4 кв.|1 кв.|2 кв.|3 кв.\n|факт\n№|1|2|3|4\nRevenue|10|20|30|40"), {
        "P&L!r4": (["2 2025Q4 historical", "3 2026Q1 forecast", "4 2026Q2 forecast", "5 2026Q3 forecast"], ["Revenue"])}),
    "years go right": (sheet("Прогноз\n|2026||2027\n|1 кв.|2 кв.|3 кв.|4 кв.\nRevenue|1|2|3|4"), {
        "P&L!r3": (["2 2026Q1 forecast", "3 2026Q2 forecast", "4 2027Q3 forecast", "5 2027Q4 forecast"], ["Revenue"])}),
    "ends of periods": (sheet("Начало периода|01.01.2024|01.04.2024\nКонец периода|31.03.2024|30.06.2024\nCash|8|9"), {"P&L!r2": (["2 2024Q1 historical", "3 2024Q2 historical"], ["Cash"])}),
    "serials with a format": (sheet("Item|44743|44835\nRevenue|1|2", dates={1}), {"P&L!r1": (["2 2022Q3 historical", "3 2022Q4 historical"], ["Revenue"])}),
    "serials without": (sheet("Item|44743|44835\nRevenue|1|2"), {}),
    "one year only": (sheet("Item|2024\nRevenue|1"), {}),
    "months by number": (sheet("Год|2024|||2025\nМесяц|11|12|1|2\nCash|5|6|7|8"), {"P&L!r2": (["2 2024-11 historical", "3 2024-12 historical", "4 2024-01 historical", "5 2025-02 historical"], ["Cash"])}),
    "total and factor columns": (sheet("Item|2023|2024E|Итого|0,5\nRevenue|1|2|3|4"), {"P&L!r1": (["2 2023 historical", "3 2024 forecast", "4 total total"], ["Revenue"])}),
    "years again": (sheet("Item|2023|2024|2025\n|2023|2031|2025\nRevenue|1|2|3"), {
        "P&L!r1": (["2 2023 historical", "3 2024 historical", "4 2025 historical"], []), "P&L!r2": (["2 2023 historical", "3 2031 historical", "4 2025 historical"], ["Revenue"])}),
    "years that disagree": (sheet("Начало периода|31.12.2023|31.03.2024|2025\nКонец периода|31.03.2024|30.06.2024\nИтого за|2024|2023|2025\nCash|1|2|3"), {"P&L!r3": (["2 2024-03 historical", "4 2025 historical"], ["Cash"])}),
    "marks reach to the next mark": (sheet("|факт||план\n|2023||2024|\n|1 кв.|2 кв.|1 кв.|2 кв.\nRevenue|1|2|3|4"), {
        "P&L!r3": (["2 2023Q1 historical", "3 2023Q2 historical", "4 2024Q1 forecast", "5 2024Q2 historical"], ["Revenue"])}),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(name, *c[1:]) for name, (cells, _) in CASES.items() for c in cells]
    got = layout.detect_layout(spark.createDataFrame(rows, SCHEMA))
    headers, lines = got.headers.collect(), got.rows.collect()
    out = {}
    for h in sorted(headers, key=lambda h: h["col"]):
        out.setdefault(h["book"], {}).setdefault(h["block_id"], ([], []))[0].append(f"{h['col']} {h['period_key']} {h['role']}")
    for r in sorted(lines, key=lambda r: r["row"]):
        out[r["book"]][r["block_id"]][1].append(r["label"] + ("?" if r["check_row"] else ""))
    return out


@pytest.mark.parametrize("name", CASES)
def test_blocks(found, name):
    assert found.get(name, {}) == CASES[name][1]


def test_label_column_and_header_texts(spark):
    rows = sheet("Secret|Item|2023|2024E\nhidden-label|Revenue|1|2", hidden={1})
    got = layout.detect_layout(spark.createDataFrame(rows, SCHEMA))
    assert [(r["label"], r["label_col"], r["hidden"]) for r in got.rows.collect()] == [("Revenue", 2, False)]
    assert sorted(r["header_text"] for r in got.headers.collect()) == ["2023", "2024E"]
    empty = layout.detect_layout(spark.createDataFrame([], SCHEMA))
    assert empty.headers.count() == empty.rows.count() == 0


def test_parents_equal_brute_force(spark):
    r = random.Random(1)
    rows = [(b, i, r.randint(0, 5)) for b in range(6) for i in range(120) if r.random() < 0.9]
    got = {(x["block_id"], x["row"]): x["parent_row"] for x in layout.parents(spark.createDataFrame(rows, "block_id int, row int, indent int"), ["block_id"]).collect()}
    want = {(b, i): max((j for c, j, m in rows if c == b and j < i and m < n), default=None) for b, i, n in rows}
    assert got == want


def test_atoms(spark):
    cases = {
        "2024Ф": ("full", "2024", "historical"), "3024-1-5": (None, None, None), "2024-02-30": (None, None, None), "0,5": ("noise", None, None), "план": ("role_marker", None, "forecast"), "3 кв": ("quarter_token", None, None),
        "Q2": ("quarter_token", None, None), "7": (None, None, None), "31.12.24П": ("full", "2024-12-31", "forecast"), "2024 факт план": ("full", "2024", "forecast"), "сентябрь 2025": ("full", "2025-09", "historical"), "2024.0": ("full", "2024", "historical"),
        "Q1 2025E": ("full", "2025Q1", "forecast"), "2 кв 2025": ("full", "2025Q2", "historical"), "марш 25": ("full", "2025-03", "historical"), "foo 25": (None, None, None), "stub план": ("full", "stub", "forecast"), "29.02.2024": ("full", "2024-02-29", "historical"), "29.02.2023": (None, None, None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", periods.header_atom(F.col("t")).alias("a"))
    got = {r["t"]: ((r["a"] or {})["kind"], r["a"]["period_key"], r["a"]["role"]) if r["a"] else (None, None, None) for r in df.collect()}
    assert got == cases
