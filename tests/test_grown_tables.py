"""Queries on tables made to show what only larger tables show."""

import duckdb
from conftest import plain

from ledgermesh.plans.catalogue import ORACLE_SQL, QUERIES


def equal(spark, folder, name, **tables):
    """The query and its SQL over tables given as SELECTs; returns the query's DataFrame."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"copy ({sql}) to '{folder}/{t}.parquet' (format parquet)")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, str(folder))
    result = con.execute(ORACLE_SQL[name])
    at = [[d[0] for d in result.description].index(c) for c in df.columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=str)
    assert sorted((tuple(map(plain, r)) for r in df.collect()), key=str) == want and want
    return df


def test_pairs_of_ranges_beyond_the_cap(spark, tmp_path):
    # rows beyond 2,000 are those of part numbers beyond 50,000
    equal(spark, tmp_path, "formula_graph_pairs", part="select 7 * i + 1 as p_partkey from range(7000, 7300) r(i)")


def test_nodes_of_ranges_whole(spark, tmp_path):
    df = equal(spark, tmp_path, "formula_graph_nodes", part="select 7 * i + 1 as p_partkey from range(7000, 7300) r(i)")
    # a book's 12 formulas are 7 rows apart and read A1 to their own row, and B1; seven of them reach row 2,001
    got = {(r["workbook_id"], r["node"]): (r["n_reads"], r["n_read_by"]) for r in df.collect()}
    last = 7 * 7299 + 1
    book, row = str(last % 25), last // 25 + 1
    assert got[book, f"S!C{row}"] == (row + 1, 0) and got[book, f"S!A{row}"] == (0, 1) and got[book, "S!A1"] == (0, 12) and got[book, "S!A2001"] == (0, 7)


def test_a_range_is_expanded_once(spark, tmp_path):
    df = equal(spark, tmp_path, "range_expand_cap", part="select i as p_partkey, CAST(i % 3 * 9 AS INTEGER) as p_size from range(900) r(i)")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [ref" in plan[plan.index("Generate explode(") :]


#: Orders of three nations in every month, in months with gaps and in one month.
MONTHS = "select i as o_custkey, timestamp '1995-01-01' + to_months(CAST(m AS INTEGER)) as o_orderdate, 10.5 as o_totalprice from range(3) r(i) cross join range(30) s(m) where i = 0 or i = 1 and m in (0, 1, 2, 9, 10, 29) or i = 2 and m = 4"
NATIONS = "select i as c_custkey, i as c_nationkey from range(3) r(i)"


def test_grain_of_uneven_months(spark, tmp_path):
    equal(spark, tmp_path, "grain_infer_apply", orders=MONTHS, customer=NATIONS)


def test_axes_of_uneven_quarters(spark, tmp_path):
    from ledgermesh.operators import layout
    from ledgermesh.plans.layout_queries import quarter_sheets

    # a single quarter is no axis
    equal(spark, tmp_path, "layout_axes", orders=f"select * from ({MONTHS}) where o_custkey < 2", customer=NATIONS)
    # the layout itself: even dates become quarters, uneven ones months
    headers = layout.detect_layout(quarter_sheets(spark, str(tmp_path))).headers.where("block_id = 'CF!r12'").orderBy("book", "col").collect()
    keys = [[r["period_key"] for r in headers if r["book"] == b] for b in ("0", "1")]
    assert keys == [["1995Q1", "1995Q2", "1995Q3", "1995Q4", "1996Q1", "1996Q2", "1996Q3", "1996Q4", "1997Q1", "1997Q2"], ["1995-01", "1995-10", "1997-04"]]


def test_tasks_follow_the_table(spark):
    from ledgermesh.operators.staging import stage
    from ledgermesh.plans.registry import tasks_for

    rows = spark.range(1000)
    assert tasks_for(rows, 100) == 10 and tasks_for(rows, 10_000) == spark.sparkContext.defaultParallelism
    before = spark.conf.get("spark.sql.shuffle.partitions")
    staged = stage(rows.selectExpr("id % 500 as k").groupBy("k").count(), tasks_for(rows, 100))
    assert len(staged.inputFiles()) == 10 and staged.count() == 500
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
