"""Queries from the bytes of workbooks on: statements are written as xlsx files by tasks, read back and audited."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from ..functions import a1
from ..operators import audit, identities
from ..operators.staging import stage
from ..sources import workbook
from . import statements as st
from .registry import query

_KIND = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"
_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _relations(*found: tuple[str, str, str]) -> str:
    inner = "".join(f'<Relationship Id="{i}" Type="{_KIND}{kind}" Target="{to}"/>' for i, kind, to in found)
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{inner}</Relationships>'


def _xlsx(cells: list[tuple[int, str, str | None, str | None]]) -> bytes:
    """A workbook of one sheet, from (row, addr, value, formula) in order of rows."""
    rows: dict[int, list[str]] = {}
    for row, addr, value, formula in cells:
        if formula:
            rows.setdefault(row, []).append(f'<c r="{addr}"><f>{escape(formula)}</f><v>{escape(value or "")}</v></c>')
        else:
            rows.setdefault(row, []).append(f'<c r="{addr}" t="inlineStr"><is><t xml:space="preserve">{escape(value or "")}</t></is></c>')
    data = "".join(f'<row r="{r}">{"".join(cs)}</row>' for r, cs in sorted(rows.items()))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("_rels/.rels", _relations(("a", "officeDocument", "xl/workbook.xml")))
        z.writestr("xl/workbook.xml", f'<workbook {_MAIN}><sheets><sheet name="Model" sheetId="1" r:id="s"/></sheets><definedNames><definedName name="first_cell">Model!$B$2</definedName></definedNames></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", _relations(("s", "worksheet", "worksheets/sheet1.xml")))
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {_MAIN}><sheetData>{data}</sheetData></worksheet>")
    return out.getvalue()


def _files(spark, sf_dir):
    """(path, content): a book of each nation, its years as columns, its concepts as lines; behind them a line that refers to the name of a cell, with an error in each fourth book."""
    f = st.facts(spark, sf_dir)
    order = F.array_position(F.array(*map(F.lit, st.CONCEPTS)), F.col("concept")) + 1
    year = F.col("period_key").cast("int")
    col = year - 1990
    at = lambda row, c: F.concat(a1.index_to_col(c.cast("int")), row.cast("string"))
    cells = lambda df, row, c, value, formula=None: df.select("book", row.cast("int").alias("row"), at(row.cast("int"), c).alias("addr"), c.cast("int").alias("col"), value.cast("string").alias("value"), (F.lit(None) if formula is None else formula).cast("string").alias("formula"))
    # an amount like 1930.0 would be a year: amounts have an exponent
    text = F.col("value").cast("string")
    amount = F.when(text.contains("E"), text).otherwise(F.concat(text, F.lit("E0")))
    heads = f.select("book", "period_key", "role").distinct()
    lines, books = f.select("book", "concept").distinct(), f.select("book").distinct()
    last, one = F.lit(len(st.CONCEPTS) + 2), F.lit(1)
    every = (
        cells(heads, one, F.col("period_key").cast("int") - 1990, F.concat("period_key", F.when(F.col("role") == "forecast", "E").otherwise("")))
        .unionByName(cells(lines, order, one, F.concat(F.lit("Line of "), "concept"))).unionByName(cells(f, order, col, amount))
        .unionByName(cells(books, last, one, F.lit("Index"))).unionByName(cells(heads, last, F.col("period_key").cast("int") - 1990, F.when(F.expr("book % 4 = 0 and period_key = '1996'"), "#DIV/0!").otherwise("1"), F.lit("first_cell*1")))
    )

    def write(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["row", "col"]).astype(object).where(lambda x: x.notna(), None)
        return pd.DataFrame([(f"{key[0]}", _xlsx(list(frame[["row", "addr", "value", "formula"]].itertuples(index=False, name=None))))], columns=["path", "content"])

    whole = every.groupBy("book").applyInPandas(write, "path string, content binary")
    # a file that is no archive, and one of no bytes
    return whole.unionByName(spark.createDataFrame([("torn", b"PK no archive"), ("bare", b"")], "path string, content binary"))


def _glossary(spark):
    """What the lines of these books are called."""
    return spark.createDataFrame([(f"Line of {c}", None, c) for c in st.CONCEPTS], "label string, parent string, concept string")


_IDENTITIES = " UNION ALL ".join(f"SELECT book, identity_id, period_key FROM ({identities.identity_sql(i, st.wide_sql, st.CONCEPTS)})" for i in identities.IDENTITIES)


@query(f"""WITH years AS (SELECT DISTINCT c_nationkey AS book, strftime(l_shipdate, '%Y') AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
    SELECT CAST(book AS VARCHAR) AS book, 'identity.' || identity_id AS detector, 'error' AS severity, period_key, count(*) AS n FROM ({_IDENTITIES}) GROUP BY 1, 2, 3, 4
    UNION ALL SELECT CAST(book AS VARCHAR), 'excel_error', 'error', NULL, 1 FROM years WHERE y = '1996' AND book % 4 = 0
    UNION ALL SELECT 'torn', 'unreadable', 'error', NULL, 1 UNION ALL SELECT 'bare', 'unreadable', 'error', NULL, 1""")
def workbook_audit(spark, sf_dir):
    """From the bytes of workbooks to findings: identities, errors of cells, and files that can't be read."""
    b = workbook.tables(stage(workbook.scan(stage(_files(spark, sf_dir)))))
    m = audit.audit(b, _glossary(spark))
    wanted = F.col("detector").startswith("identity.") | F.col("detector").isin("excel_error", "unreadable")
    return m.where(wanted).groupBy("book", "detector", "severity", "period_key").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH y AS (SELECT DISTINCT c_nationkey AS book, year(l_shipdate) - 1990 AS col FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
    SELECT CAST(book AS VARCHAR) AS book, 'Model!' || chr(CAST(64 + col AS INTEGER)) || '%d' AS src, 'ref' AS own, 'Model!B2' AS dst FROM y""" % (len(st.CONCEPTS) + 2))
def workbook_names(spark, sf_dir):
    """Cells that a formula reaches through a defined name."""
    b = workbook.tables(stage(workbook.scan(stage(_files(spark, sf_dir)))))
    return audit.names.name_edges(b.cells, b.names).select("book", "src", F.lit("ref").alias("own"), "dst")
