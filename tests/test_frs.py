import pytest

from ledgermesh.operators.frs import frs_candidates, frs_matrix

FACT = "book string, concept string, period_key string, role string, value double"


def matrix(spark, lines, months=()):
    return {(r["book"], r["control_id"]): r for r in frs_matrix(spark.createDataFrame(lines, FACT), spark.createDataFrame(list(months), FACT)).collect()}


def test_plan_against_fact_working_capital_and_coverage(spark):
    line = lambda book, concept, *values: [(book, concept, y, role, v) for y, role, v in values]
    h, f = "historical", "forecast"
    rows = line("a", "pnl.revenue", ("2024", h, 100.0), ("2025", h, 100.0), ("2025", f, 115.0), ("2026", f, 101.0))
    rows += line("a", "bs.ar", ("2024", h, 10.0), ("2025", h, 10.0), ("2026", f, 11.0)) + line("a", "bs.ap", ("2024", h, 5.0), ("2025", h, 5.0), ("2026", f, 5.0))
    rows += line("a", "pnl.ebitda", ("2025", h, 50.0), ("2026", f, 52.0)) + line("a", "pnl.interest", ("2025", h, -10.0), ("2026", f, -10.0)) + line("a", "cov.llcr", ("2026", f, 0.9), ("2027", f, 1.4))
    # b: a fact near its plan, then a fall of the forecast; one line of working capital only
    rows += line("b", "pnl.revenue", ("2024", h, 100.0), ("2024", f, 104.0), ("2025", f, 85.0)) + line("b", "bs.ar", ("2024", h, 10.0), ("2025", f, 9.0))
    rows += line("b", "pnl.ebitda", ("2024", h, 12.0), ("2025", f, 12.0)) + line("b", "pnl.interest", ("2024", h, 10.0), ("2025", f, 9.0))
    got = matrix(spark, rows, [("a", "bs.cash", "2026-01", f, 5.0), ("a", "bs.cash", "2026-02", f, -1.0)])
    at = lambda book, control: (got[book, control]["status"], got[book, control]["period_key"], got[book, control]["metric"])
    assert at("a", "F01") == ("flagged", "2025", pytest.approx(0.15)) and at("b", "F01") == ("flagged", "2025", pytest.approx(-0.15))
    # receivables grow by as much as revenue does
    assert at("a", "F05") == ("flagged", "2026", 1.0) and at("b", "F05")[0] == "not_applicable"
    assert at("a", "F07") == ("flagged", "2026", 0.9) and at("b", "F07") == ("flagged", "2024", 1.2)
    # cash is a line of months only; nothing tells of covenants
    assert at("a", "F08") == ("flagged", "2026-02", 1.0) and at("b", "F08")[0] == "not_applicable" and at("a", "F14")[0] == "insufficient"
    assert {(b, c) for b, c in got} == {(b, f"F{i:02d}") for b in "ab" for i in range(1, 15)}
    found = frs_candidates(frs_matrix(spark.createDataFrame(rows, FACT), spark.createDataFrame([], FACT)))
    assert {(r["book"], r["detector"]) for r in found.collect()} >= {("a", "frs.F01"), ("a", "frs.F07"), ("b", "frs.F07")}
