"""Credit controls in full: status, level, confidence, cause, figures and cells of small books."""

import pytest
from pyspark.sql import functions as F

from ledgermesh.operators import credit

H, P = "historical", "forecast"


def lines(book, **concepts):
    """Facts of a book from concept=[values of 2023 (historical), 2024, 2025, ...] or a dict of keys; cells are concept@key."""
    out = []
    for concept, values in concepts.items():
        c = concept.replace("_", ".", 1)
        items = values.items() if isinstance(values, dict) else [(str(2023 + i), v) for i, v in enumerate(values)]
        out += [(book, c, k, H if k[:4] <= "2023" else P, None if v is None else float(v), f"{c}@{k}") for k, v in items]
    return out


MONTHS = [f"2024-{m:02d}" for m in range(1, 7)]
BOOKS = (
    lines("loss", pnl_ebitda=[10, -1, -2])
    + lines("loss broken by a year", pnl_ebitda=[10, -1, 5, -2], pnl_net_income=[1, -1, -1, -1])
    + lines("fcf", pnl_net_income=[10, 12, 14], cf_fcf=[5, -2, -3], pnl_ebitda=[1, 1, 1])
    + lines("derived", pnl_net_income=[10, 12, 14], cf_cfo=[9, 8, 8], cf_capex=[-1, -12, -14])
    + lines("no cash flow", pnl_net_income=[10, 12, 14])
    + lines("apart", pnl_net_income=[10, 12, 14], cf_cfo=[5, 6, 7], cf_fcf=[4, 3, 5], bs_ar=[1, 9, 30], bs_ap=[1, 1, 2])
    + lines("dry", bs_cash=dict(zip(MONTHS, (100, 50, -5))), covenant_headroom=[10, -2, 5])
    + lines("plug", bs_cash=dict(zip(MONTHS, (100, 100, 100))), cf_drawdown=dict(zip(MONTHS, (10, 20, 15))))
    + lines("wet", bs_cash=dict(zip(MONTHS, (100, 90, 80))), bs_debt=[100, 216], pnl_ebitda=[58, 108], pnl_interest=[8, -12])
    + lines("dividends", cf_dividends=[0, 5, 5], cf_fcf=[4, -10, -8], cf_drawdown=[0, 20, 20])
    + lines("own dividends", cf_dividends=[0, 5, 5], cf_fcf=[4, -10, -8])
    + lines("room", bs_cash=[80, 40, 60], covenant_headroom=[10, -2, 5])
    + lines("monthly loss", pnl_ebitda={f"{y}-{m:02d}": -1 for y in (2024, 2025) for m in (1, 2)})
)
FACT = "book string, concept string, period_key string, role string, value double, ref string"


@pytest.fixture(scope="module")
def found(spark):
    broken = spark.createDataFrame([("dividends", "I13"), ("fcf", "I1")], "book string, identity_id string")
    return {(r["book"], r["control_id"]): r for r in credit.controls_in_full(spark.createDataFrame(BOOKS, FACT), broken).collect()}


@pytest.mark.parametrize(
    ("book", "control", "status", "priority", "confidence", "cause", "keys"),
    [
        ("loss", "F03", "flagged", "medium", "high", "", ["2024", "2025"]), ("loss broken by a year", "F03", "clear", None, "high", "", []), ("fcf", "F03", "clear", None, "high", "", []), ("room", "F03", "not_applicable", None, None, "", []),
        ("monthly loss", "F03", "flagged", "medium", "medium", "", ["2024", "2025"]),
        ("fcf", "F04", "flagged", "medium", "high", "ops", ["2024", "2025"]), ("derived", "F04", "flagged", "medium", "medium", "capex", ["2024", "2025"]), ("no cash flow", "F04", "insufficient", None, None, "", []), ("apart", "F04", "flagged", "medium", "high", "wc_ar", []),
        ("dry", "F08", "flagged", "high", "high", "", ["2024-03"]), ("plug", "F08", "flagged", "medium", "high", "cash_plug", ["2024-01"]), ("wet", "F08", "clear", None, "high", "", ["2024-03"]), ("room", "F08", "insufficient", None, None, "", []),
        ("dividends", "F13", "flagged", "high", "low", "", ["2024"]), ("own dividends", "F13", "flagged", "medium", "high", "", ["2024"]),
        ("room", "F14", "flagged", "high", "high", "", ["2024"]), ("wet", "F14", "insufficient", None, None, "", []), ("loss", "F14", "not_applicable", None, None, "", []),
    ],
)
def test_controls(found, book, control, status, priority, confidence, cause, keys):
    r = found[book, control]
    assert (r["status"], r["priority"], r["confidence"], r["cause"], r["period_keys"]) == (status, priority, confidence, cause, keys)


def test_figures_and_cells(found):
    assert found["loss", "F03"]["cell_refs"] == ["pnl.ebitda@2024", "pnl.ebitda@2025"]
    assert found["monthly loss", "F03"]["cell_refs"] == [f"pnl.ebitda@{y}-{m:02d}" for y in (2024, 2025) for m in (1, 2)]
    assert found["fcf", "F04"]["metrics"] == {"ni": 12.0, "fcf": -2.0}
    assert found["derived", "F04"]["metrics"] == {"ni": 12.0, "cfo": 8.0, "accruals": 4.0, "fcf": -4.0}
    assert found["derived", "F04"]["cell_refs"][:3] == ["pnl.net_income@2024", "cf.cfo@2024", "cf.capex@2024"]
    assert found["dry", "F08"]["metrics"] == {"min_cash": -5.0, "runway": 2.0, "cash_plug": 0.0} and found["dry", "F08"]["cell_refs"] == ["bs.cash@2024-03"]
    assert found["plug", "F08"]["cell_refs"][3:] == [f"cf.drawdown@{m}" for m in MONTHS[:3]]
    assert found["dividends", "F13"]["metrics"] == {"fcff": -10.0, "fcfe": 10.0}
    assert found["room", "F14"]["metrics"] == {"min_cash": 40.0, "min_headroom": -2.0} and found["room", "F14"]["cell_refs"] == ["covenant.headroom@2024"]
    assert found["wet", "F14"]["metrics"] == {"min_cash": 80.0, "nd_ebitda": 100 / 58, "icr": 7.25}
    # the cash of a year is that of its last month
    assert (216 - 80) / 108 < 100 / 58 and found["dry", "F14"]["confidence"] == "medium"
    assert {c for _, c in found} == set(credit.CLASSES) and len(found) == 5 * 13


def test_no_facts_and_facts_without_cells(spark):
    assert credit.controls_in_full(spark.createDataFrame([], FACT)).count() == 0
    bare = spark.createDataFrame(BOOKS, FACT).where("book = 'loss'").drop("ref")
    got = credit.controls_in_full(bare).where(F.col("control_id") == "F03").first()
    assert got["status"] == "flagged" and got["cell_refs"] == []


def test_numbers_as_text(spark):
    from ledgermesh.operators.messages import figure_text

    cases = [(0.0, "number", "0"), (-1234567.0, "number", "−1 234 567"), (1234.5, "number", "1 234.5"), (0.126, "number", "0.13"), (0.256, "share", "25.6%"), (1.5, "ratio", "1.5x"), (1.0, "flag", "yes"), (100.0, "number", "100")]
    df = spark.createDataFrame([(x, k) for x, k, _ in cases], "x double, k string").select(figure_text(F.col("x"), F.col("k")).alias("t"))
    assert [r["t"] for r in df.collect()] == [t for *_, t in cases]


def test_texts_of_controls_and_findings(spark):
    from ledgermesh.operators import messages

    results = credit.controls_in_full(spark.createDataFrame(BOOKS, FACT).where("book in ('derived', 'room', 'wet')"))
    screen = messages.risk_screen(results, credit.NEEDS)
    got = {(r["book"], r["control_id"]): r for r in screen.collect()}
    assert got["derived", "F04"]["key_fact"] == "net income 12; operating cash flow 8; accruals 4; free cash flow −4." and got["derived", "F04"]["cause"] == "investment takes the cash"
    assert got["room", "F14"]["status_reason"] == "The threshold is broken; the cells are listed (covenant.headroom@2024)."
    assert got["room", "F03"]["status_reason"] == "A line that the control needs is not mapped (pnl.ebitda)." and got["room", "F03"]["key_fact"] == "There is no figure."
    assert [(r["book"], r["control_id"]) for r in messages.positives(screen).collect()] == [("wet", "F08")]
    found = spark.createDataFrame([("b", "f_001", "identity.I1", ["S!A1", "S!B2"], []), ("b", "f_002", "agg_range_gap", [], ["pnl.cogs"]), ("b", "f_003", "new kind", [], [])], "book string, id string, detector string, cell_refs array<string>, metrics array<string>")
    cards = {r["id"]: (r["title"], r["evidence"]) for r in messages.cards(found).collect()}
    assert cards["f_001"] == ("An accounting identity does not hold", "Detector identity.I1; cells S!A1, S!B2; lines —.")
    assert cards["f_002"][0] == "A total misses or repeats lines" and cards["f_003"] == ("Finding", "Detector new kind; cells —; lines —.")
