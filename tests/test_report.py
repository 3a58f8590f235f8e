import os
import time

from ledgermesh.operators import detectors, mapping, report
from ledgermesh.sources import store
from ledgermesh.streaming import intake

SCHEMA = "book string, ord int, detector string, severity string, cell_refs array<string>, tags array<string>, metrics array<string>, outputs array<string>, path array<string>, cols array<int>"


def found(spark, rows):
    c = spark.createDataFrame(rows, SCHEMA)
    return report.findings(c, c.selectExpr("book", "explode(cell_refs) ref").where("ref not like 'Gone%'"))


def test_combinations_use_a_finding_once(spark):
    f = found(spark, [
        ("b", 1, "literal_in_ast", "warning", ["P!C4"], [], ["pnl.ebitda"], [], [], [3]),
        ("b", 2, "literal_in_ast", "warning", ["P!D4"], ["hist_manual_adjustment"], ["pnl.ebitda"], [], [], [4]),
        ("b", 3, "frs.F02", "risk", ["P!C9"], [], ["pnl.ebitda"], [], [], [3]),
        ("b", 4, "identity.I1", "error", ["B!C1"], [], [], [], [], [5]),
        ("b", 5, "frs.F08", "risk", ["B!C2"], [], [], [], [], [6]),
        ("b", 6, "external_link", "warning", ["X!A1"], [], [], [], [], []),
        ("b", 7, "hidden_input", "warning", ["H!A1"], [], [], [], ["X!A1"], []),
        ("b", 8, "unused_cell", "risk", ["U!A1"], [], [], [], [], []),
        ("b", 9, "excel_error", "error", ["Gone!A1"], [], [], [], [], []),
        ("b", 10, "frs.F01", "risk", None, [], [], [], [], []),
    ])
    got = report.conclusions(f).orderBy("nth").collect()
    assert [(r["kind"], r["title"], r["finding_ids"], r["severity"]) for r in got] == [
        ("combo", "hardcoded_ebitda", ["f_001", "F02"], "warning"),
        ("combo", "external_assumption", ["f_004", "f_005"], "warning"),
        ("trust", "literal_in_ast", ["f_002"], "warning"),
        ("trust", "identity.I1", ["f_003"], "error"),
        ("dynamics", "frs.F08", ["F08"], "risk"),
    ]
    none = spark.createDataFrame([], "book string, control_id string, status string")
    issues = spark.createDataFrame([("b", "F08", "high", 1), ("c", "F07", "high", 1), ("d", "F01", "low", 1)], "book string, id string, priority string, ord int")
    v = {r["book"]: r for r in report.verdict(f, none, issues, f.limit(0).select("book")).collect()}
    assert (v["b"]["ready_for_credit"], v["b"]["headline"], v["c"]["headline"], v["c"]["blockers"]) == (False, "f_003", "F07", ["F07"])
    assert (v["d"]["ready_for_credit"], v["d"]["headline"], v["d"]["status"]) == (None, None, "succeeded")
    assert report.conclusions(f.limit(0)).count() == 0


def test_glossary_ontology_catalogue_and_cascade(spark, tmp_path):
    (tmp_path / "o.yaml").write_text("concepts:\n  - id: pnl.revenue\n    labels: [Revenue, \"Net sales\"]\n  - id: bs.cash\n    labels: [Cash]\n")
    assert {tuple(r) for r in store.ontology(spark, str(tmp_path / "o.yaml")).collect()} == {("pnl.revenue", "Revenue"), ("pnl.revenue", "Net sales"), ("bs.cash", "Cash")}
    old = store.load_glossary(spark, str(tmp_path / "none"))
    rows = spark.createDataFrame([("P", 2, " Turnover", None), ("P", 3, "GMV", None)], "sheet string, row int, label string, parent_label string")
    asked = spark.createDataFrame([("q_001", "P", 2), ("q_002", "P", 3)], "question_id string, sheet string, row int")
    said = spark.createDataFrame([("q_001", "bs.cash", 1), ("q_001", "pnl.revenue", 2), ("q_002", "", 3), ("q_009", "x", 4)], "question_id string, concept_id string, ord int")
    store.save_glossary(store.merge_answers(old, asked, said, rows), str(tmp_path / "g"))
    g = store.load_glossary(spark, str(tmp_path / "g"))
    assert [tuple(r) for r in g.collect()] == [("turnover", "", "pnl.revenue")]
    matched = mapping.glossary_match(rows.withColumnRenamed("parent_label", "parent"), g).withColumnRenamed("concept", "a").withColumn("b", mapping.F.lit("pnl.revenue"))
    got = {r["label_key"]: (r["concept"], r["source"]) for r in mapping.cascade(matched, ("glossary", "a"), ("embed", "b")).collect()}
    assert got == {"turnover": ("pnl.revenue", "glossary"), "gmv": ("pnl.gmv", "rule")}
    store.open_catalogue(spark, str(tmp_path / "session"))
    assert spark.sql("select count(*) n from edges join cells using (workbook_id)").first()["n"] == 0


def test_intake_takes_each_content_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.xlsx").write_bytes(b"one")
    (inbox / "b.xlsx").write_bytes(b"one")
    (inbox / "c.txt").write_bytes(b"two")
    run = lambda: intake.audit_stream(intake.arrivals(spark, str(inbox)), lambda df: df.select("audit_id"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    time.sleep(1)
    (inbox / "d.xlsx").write_bytes(b"two")
    (inbox / "e.xlsx").write_bytes(b"one")
    run()
    assert spark.read.parquet(str(tmp_path / "out")).select("audit_id").distinct().count() == spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_intake_takes_old_files_and_none_twice(spark, tmp_path):
    inbox = tmp_path / "old"
    inbox.mkdir()
    put = lambda name, content, days: ((inbox / name).write_bytes(content), os.utime(inbox / name, (2_000_000_000 - 86_400 * days,) * 2))
    run = lambda: intake.audit_stream(intake.arrivals(spark, str(inbox)), lambda df: df.select("audit_id", "path"), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    put("new.xlsx", b"new", 0)
    run()
    put("five.xlsx", b"five", 5)
    put("nine.xlsx", b"nine", 9)
    put("again.xlsx", b"new", -40)
    run()
    put("year.xlsx", b"year", 400)
    put("five-again.xlsx", b"five", -80)
    run()
    got = sorted(r["path"].rpartition("/")[2] for r in spark.read.parquet(str(tmp_path / "o")).collect())
    assert got == ["five.xlsx", "new.xlsx", "nine.xlsx", "year.xlsx"]


def test_circles_are_meant_by_concept_not_by_part_of_its_name(spark):
    groups = spark.createDataFrame([("w", "S!A1", "S!A1"), ("v", "S!A1", "S!A1"), ("u", "S!A1", "S!A1")], "workbook_id string, node string, component string")
    rows = spark.createDataFrame([("w", "S", 1, "pnl.interest_rate", "Rate"), ("v", "S", 1, "pnl.interest", "x"), ("u", "S", 1, None, "Cash sweep")], "workbook_id string, sheet string, row int, concept_id string, label string")
    assert {r["workbook_id"]: r["severity"] for r in detectors.circular(groups, rows).collect()} == {"w": "error", "v": "warning", "u": "warning"}


def test_ontology_in_every_spelling(spark, tmp_path):
    (tmp_path / "o.yaml").write_text("""# concepts
concepts:
  - id: pnl.revenue
    labels: [Revenue, "Sales, net", 'Owner''s sales', Выручка]
    note: "labels of a kind"
  - id: "bs.cash"   # quoted
    labels:
      - Cash
      # a remark
      - "Cash: at hand"
      - 'Bank''s'
    parent: bs
  - id: cf.fcf
    labels: []
  - id: 'x.y'
    labels: [
      One,
      Two words
    ]
""", encoding="utf-8")
    got = sorted(tuple(r) for r in store.ontology(spark, str(tmp_path / "o.yaml")).collect())
    assert got == sorted([("pnl.revenue", "Revenue"), ("pnl.revenue", "Sales, net"), ("pnl.revenue", "Owner's sales"), ("pnl.revenue", "Выручка"), ("bs.cash", "Cash"), ("bs.cash", "Cash: at hand"), ("bs.cash", "Bank's"), ("x.y", "One"), ("x.y", "Two words")])
