from ledgermesh.operators.lineage import lineage_paths, trace_lineage

#: A small plan: the price feeds two products, both feed the total, the total feeds tax and cash.
EDGES = [("Plan!D4", "Prices!B2"), ("Plan!D5", "Prices!B2"), ("Plan!D6", "Plan!D4"), ("Plan!D6", "Plan!D5"), ("Plan!D9", "Plan!D6"), ("Cash!D2", "Plan!D9"), ("Cash!D3", "Cash!D2")]
ROWS = [("Plan", 6, "pnl.gross_profit", "output"), ("Plan", 9, "pnl.tax", "calculation"), ("Cash", 2, "cf.cfo", "output"), ("Cash", 3, "bs.cash", "output")]


def test_a_price_reaches_all_outputs_behind_it(spark):
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    rows = spark.createDataFrame(ROWS, "sheet string, row int, concept_id string, article_role string")
    found = spark.createDataFrame([(10, ["Prices!B2"], None), (11, ["Plan!D9"], -40.5), (12, ["Cash!D3", "Cash!D3"], None), (13, [None], None), (14, ["Notes!A1"], None)], "candidate long, cell_refs array<string>, delta double")
    got = {r["candidate"]: r for r in trace_lineage(found, edges, rows, spark.createDataFrame([("Cash!D2",)], "src string")).collect()}
    assert (got[10]["affected_metrics"], got[10]["n_path"], got[10]["truncated"], got[10]["complete"]) == (["bs.cash", "cf.cfo", "pnl.gross_profit"], 7, True, False)
    assert (got[11]["impact_kind"], float(got[11]["impact"]), got[11]["affected_metrics"]) == ("numeric", -40.5, ["bs.cash", "cf.cfo"])
    assert (got[12]["n_path"], got[12]["n_outputs"], got[12]["impact_kind"], got[12]["truncated"]) == (1, 1, "direction", False)
    assert (got[13]["n_path"], got[13]["complete"], got[14]["n_path"], got[14]["n_outputs"]) == (0, True, 1, 0)
    ends = lineage_paths(found, edges, rows).where("candidate = 11").collect()
    assert {(r["ref"], r["concept_id"]) for r in ends} == {("Plan!D9", None), ("Cash!D2", "cf.cfo"), ("Cash!D3", "bs.cash")}
    assert trace_lineage(found.limit(0), edges, rows).count() == 0
