import pytest

from ledgermesh.operators.identities import check_identities

#: Broken and balanced vectors: identity, {concept: values by period}, whether it is violated.
CASES = [
    ("I1", {"bs.assets_total": [100], "bs.equity": [40], "bs.liabilities": [50]}, 1),
    ("I1", {"bs.assets_total": [100], "bs.equity": [40], "bs.liabilities": [60]}, 0),
    ("I3a", {"bs.cash": [100, 130], "cf.fcf": [0, 10]}, 1),
    ("I3a", {"bs.cash": [100, 130], "cf.fcf": [0, 10], "fx.cash": [0, 20]}, 0),
    ("I3b", {"bs.retained_earnings": [100, 125], "pnl.net_income": [0, 20], "cf.dividends": [0, 10], "bs.re_adj": [0, 15]}, 0),
    ("I3b", {"bs.retained_earnings": [100, 140], "pnl.net_income": [0, 20], "cf.dividends": [0, 10], "bs.re_adj": [0, 15]}, 1),
    ("I3b", {"bs.retained_earnings": [100, 140], "pnl.net_income": [0, 20], "cf.dividends": [0, None]}, 0),
    ("I4", {"pnl.volume": [10], "pnl.price": [95], "pnl.revenue": [1020]}, 1),
    ("I5", {"pnl.revenue": [100], "pnl.cogs": [40], "pnl.gross_profit": [50]}, 1),
    ("I6", {"pnl.revenue": [100], "pnl.cogs": [40], "pnl.opex": [30], "pnl.ebitda": [30]}, 0),
    ("I7", {"pnl.ebitda": [50], "pnl.da": [10], "pnl.ebit": [30]}, 1),
    ("I8", {"pnl.da": [10], "cf.da": [-10]}, 0),
    ("I8b", {"bs.ppe": [100, 90], "cf.capex": [0, 20], "pnl.da": [0, 10]}, 1),
    ("I10", {"bs.debt": [100, 130], "cf.drawdown": [0, 50], "cf.repayment": [0, 20]}, 0),
    ("I11", {"bs.debt": [100, 100], "pnl.interest": [0, 12], "pnl.interest_rate": [12, 12]}, 0),
    ("I11", {"bs.debt": [100, 100], "pnl.interest": [0, 7], "pnl.interest_rate": [0.12, 0.12]}, 1),
    ("I12", {"pnl.tax": [25], "pnl.net_income": [75], "pnl.tax_rate": [25]}, 0),
    ("I13", {"bs.equity": [100, 120], "pnl.net_income": [0, 20], "cf.dividends": [0, 10]}, 1),
    ("I13", {"bs.equity": [100, 125], "pnl.net_income": [0, 20], "cf.dividends": [0, 10], "cf.equity_issue": [0, 15]}, 0),
    ("I9", {"pnl.net_income": [10, 10], "pnl.da": [2, 2], "bs.ar": [50, 60], "cf.cfo": [20, 20]}, 1),
    ("I9", {"pnl.net_income": [10, 10], "pnl.da": [2, 2], "bs.ar": [50, 60], "cf.cfo": [20, 2]}, 0),
]


@pytest.fixture(scope="module")
def violated(spark):
    """(case, identity) of all violations, each case a book of its own."""
    rows = [(str(n), c, str(2023 + i), "historical", None if v is None else float(v)) for n, (_, lines, _) in enumerate(CASES) for c, values in lines.items() for i, v in enumerate(values)]
    facts = spark.createDataFrame(rows, "book string, concept string, period_key string, role string, value double")
    return [(int(r["book"]), r["identity_id"]) for r in check_identities(facts).collect()]


@pytest.mark.parametrize("n", range(len(CASES)))
def test_identity_vectors(violated, n):
    assert violated.count((n, CASES[n][0])) == CASES[n][2]


LINE = "book string, block_id string, ord int, article_role string, concept string, period_key string, role string, col int, value double"


def line(book, block, ord_, role, concept, *columns):
    """Facts of a line from (period_key, role, value) of its columns."""
    return [(book, block, ord_, role, concept, key, period, 2 + n, float(v)) for n, (key, period, v) in enumerate(columns)]


def balance(book, block, ord_, assets, equity, liabilities, key="2023", role="historical"):
    lines = (("bs.assets_total", assets), ("bs.equity", equity), ("bs.liabilities", liabilities))
    return [f for n, (c, v) in enumerate(lines) for f in line(book, block, ord_ + n, "calculation", c, (key, role, v))]


def found_in(spark, rows, identity):
    got = check_identities(spark.createDataFrame(rows, LINE)).where(f"identity_id = '{identity}'").collect()
    return sorted((r["book"], r["scope"] or "", r["period_key"]) for r in got)


def test_blocks_are_looked_at_one_by_one(spark):
    rows = balance("b", "BS|1", 1, 100, 40, 60) + balance("b", "BS|2", 11, 100, 40, 50) + balance("c", "BS|1", 1, 100, 40, 60)
    assert found_in(spark, rows, "I1") == [("b", "BS|2", "2023")]


def test_lines_of_several_blocks_meet_by_the_output_line(spark):
    h = "historical"
    rows = line("b", "P|1", 1, "calculation", "pnl.revenue", ("2023", h, 90)) + line("b", "P|1", 2, "output", "pnl.revenue", ("2023", h, 100))
    rows += line("b", "P|2", 3, "calculation", "pnl.cogs", ("2023", h, 40)) + line("b", "P|2", 4, "calculation", "pnl.gross_profit", ("2023", h, 60))
    assert found_in(spark, rows, "I5") == []
    broken = rows[:2] + rows[2:3] + line("b", "P|2", 4, "calculation", "pnl.gross_profit", ("2023", h, 50))
    assert found_in(spark, broken, "I5") == [("b", "", "2023")]


def test_scenarios_count_for_balances_and_not_for_changes(spark):
    rows = balance("b", "BS|1", 1, 100, 40, 50, "base", "scenario")
    assert found_in(spark, rows, "I1") == [("b", "BS|1", "base")]
    cash = line("b", "C|1", 1, "calculation", "bs.cash", ("2023", "historical", 100), ("2024", "scenario", 500)) + line("b", "C|1", 2, "calculation", "cf.fcf", ("2023", "historical", 0), ("2024", "scenario", 10))
    assert found_in(spark, cash, "I3a") == []
    assert found_in(spark, [(*r[:6], "forecast" if r[6] == "scenario" else r[6], *r[7:]) for r in cash], "I3a") == [("b", "C|1", "2024")]


def test_of_the_columns_of_a_period_the_fact_counts(spark):
    h, p = "historical", "forecast"
    rows = line("b", "P|1", 1, "calculation", "pnl.revenue", ("2023", h, 100), ("2023", p, 300)) + line("b", "P|1", 2, "calculation", "pnl.cogs", ("2023", h, 40), ("2023", p, 90))
    rows += line("b", "P|1", 3, "calculation", "pnl.gross_profit", ("2023", h, 60), ("2023", p, 999))
    assert found_in(spark, rows, "I5") == []
