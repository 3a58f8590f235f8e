"""The audit of workbooks, from their tables to the candidates of a report.

Cells are compiled and laid out, lines are mapped by a glossary, and facts (a
number of a mapped line in a period) go to the identities and credit controls,
cells, formulas and edges to the other detectors.  What several detectors read is
staged once.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import article_role
from ..functions.numeric import as_number
from ..sources.workbook import Books, book_flags
from . import credit, detectors, formulas, graph, identities, layout, mapping, names, series
from .axis import role_rank
from .staging import stage


class Model(NamedTuple):
    """What the detectors read of the books, staged.

    cells: compiled cells with workbook_id, ref, ord.  edges: workbook_id, src, kind, dst, unresolved, ord (of src).
    headers, lines: as the layout gives them, lines with concept_id, article_role and parent_label.  facts: book,
    block_id, ord, article_role, concept, period_key, role, col, value, ref.  books: workbook_id and what a book says of itself.
    """

    cells: DataFrame
    edges: DataFrame
    headers: DataFrame
    lines: DataFrame
    facts: DataFrame
    books: DataFrame


def read_model(b: Books, glossary: DataFrame) -> Model:
    """The model of all books without a fault; glossary: label, parent, concept."""
    cells = b.cells.join(b.errors.select("book").distinct(), "book", "left_anti")
    about = stage(b.books.join(book_flags(cells, b.books.select("book", "paths")), "book", "left"))
    scan = F.row_number().over(Window.partitionBy("book").orderBy("sheet", "row", "col"))
    cells = cells.join(about.select("book", "locale", "date1904"), "book").withColumn("ord", scan).withColumn("ref", F.concat_ws("!", "sheet", "addr"))
    compiled = stage(formulas.compile_cells(cells, F.col("locale") == "ru").withColumn("workbook_id", F.col("book")))
    edges = formulas.edges_of(compiled, "book").unionByName(names.name_edges(compiled, b.names))
    edges = stage(edges.join(compiled.select("book", F.col("ref").alias("src"), "ord"), ["book", "src"], "left").withColumnRenamed("book", "workbook_id"))

    found = layout.detect_layout(compiled)
    headers, rows = stage(found.headers), stage(found.rows)
    parent = rows.select("book", "sheet", "block_id", F.col("row").alias("parent_row"), F.col("label").alias("parent"))
    has_formula = compiled.where("formula_raw is not null").select("book", "sheet", "row").distinct().withColumn("has_formula", F.lit(True))
    rows = rows.join(parent, ["book", "sheet", "block_id", "parent_row"], "left").join(has_formula, ["book", "sheet", "row"], "left")
    mapped = mapping.glossary_match(rows, glossary)
    # a label under a parent that the glossary doesn't know may be known by itself
    alone = mapping.glossary_match(mapped.where("concept is null").select("book", "sheet", "block_id", "row", "label", F.lit(None).cast("string").alias("parent")), glossary).where("concept is not null")
    both = mapped.join(alone.select("book", "sheet", "block_id", "row", F.col("concept").alias("own")), ["book", "sheet", "block_id", "row"], "left")
    concept = mapping.guard_gmv(F.col("label_key"), F.coalesce("concept", "own"))
    role = article_role(F.col("label"), F.col("check_row"), F.coalesce("has_formula", F.lit(False)))
    keep = ["book", "sheet", "block_id", "row", "label", F.col("parent").alias("parent_label"), "check_row", role.alias("article_role"), concept.alias("concept_id")]
    lines = stage(both.select(*keep).withColumn("workbook_id", F.col("book")))

    at = ["book", "sheet", "block_id"]
    points = lines.where("concept_id is not null").join(headers.select(*at, "col", "role", "period_key"), at)
    values = compiled.select("book", "sheet", "row", "col", as_number(F.col("cached_value")).alias("value"), "ref")
    points = points.join(values, ["book", "sheet", "row", "col"], "left")
    order = F.dense_rank().over(Window.partitionBy("book").orderBy("sheet", "row"))
    facts = points.select("book", F.concat_ws("|", "sheet", "block_id").alias("block_id"), order.alias("ord"), "article_role", F.col("concept_id").alias("concept"), "period_key", "role", "col", "value", "ref")
    return Model(compiled, edges, headers.withColumn("workbook_id", F.col("book")), lines, stage(facts), about.withColumn("workbook_id", F.col("book")))


CANDIDATE = ("book", "detector", "severity", "cell_refs", "tags", "period_key")


def _candidates(found: DataFrame, book: Column, detector: Column | str, severity: Column | str, refs: Column, tags: Column | None = None, period: Column | None = None) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    none = F.array().cast("array<string>")
    return found.select(book.alias("book"), lit(detector).alias("detector"), lit(severity).alias("severity"), refs.cast("array<string>").alias("cell_refs"), (tags if tags is not None else none).alias("tags"), (period if period is not None else F.lit(None).cast("string")).alias("period_key"))


def one_line(facts: DataFrame) -> DataFrame:
    """facts of the line that stands for a concept in its book (an output, or else the first), one column for a period and role."""
    first = F.row_number().over(Window.partitionBy("book", "concept", "period_key", "role").orderBy("col"))
    line = F.struct((F.coalesce("article_role", F.lit("")) != "output").alias("inner"), "ord")
    top = facts.withColumn("_line", line).withColumn("_top", F.min("_line").over(Window.partitionBy("book", "concept"))).where("_line = _top")
    return top.withColumn("_nth", first).where("_nth = 1").drop("_line", "_top", "_nth")


def identity_candidates(m: Model) -> DataFrame:
    """Violated identities with the cells of their lines in the period."""
    broken = identities.check_identities(m.facts.drop("ref"))
    lines = dict.fromkeys((i.id, c) for i in identities.IDENTITIES for c in i.lines)
    named = m.facts.sparkSession.createDataFrame(list(lines), "identity_id string, concept string")
    cells = broken.select("book", "identity_id", "period_key").distinct().join(F.broadcast(named), "identity_id").join(m.facts.select("book", "concept", "period_key", "ref"), ["book", "concept", "period_key"])
    refs = cells.groupBy("book", "identity_id", "period_key").agg(F.array_sort(F.collect_set("ref")).alias("refs"))
    hit = broken.select("book", "identity_id", "period_key").distinct().join(refs, ["book", "identity_id", "period_key"], "left")
    return _candidates(hit, F.col("book"), F.concat(F.lit("identity."), "identity_id"), "error", F.coalesce("refs", F.array().cast("array<string>")), period=F.col("period_key"))


def cell_candidates(m: Model) -> DataFrame:
    """Candidates of single cells, formulas, edges and books."""
    w, ref = F.col("workbook_id"), F.concat_ws("!", "sheet", "addr")
    drift = detectors.series_candidates(series.drift(series.points(m.lines, m.headers, m.cells)))
    address = m.cells.select("workbook_id", "sheet", "row", "col", "ref")
    circles = graph.circular_in_books(graph_pairs(m).withColumnRenamed("workbook_id", "book")).withColumnRenamed("book", "workbook_id")
    outside = detectors.external_links(m.edges, m.books.select("workbook_id", "externals", "first_ref"))
    reading = m.edges.where("dst is not null")
    parts = [
        _candidates(detectors.excel_errors(m.cells), w, "excel_error", "error", F.array(ref)), _candidates(detectors.error_masking(m.cells), w, "error_masking", "warning", F.array(ref)),
        _candidates(detectors.unresolved_dynamic(m.edges), w, "unresolved_dynamic", "risk", F.array("ref")), _candidates(outside, w, "external_link", "risk", F.array("ref")),
        _candidates(detectors.macros(m.books), w, "xlm_or_vba", "risk", F.array("ref")),
        _candidates(drift.join(address, ["workbook_id", "sheet", "row", "col"], "left"), w, F.col("detector"), F.col("severity"), F.array("ref"), F.col("tags")),
        _candidates(detectors.circular(circles, m.lines), w, "circular", F.col("severity"), F.col("cell_refs"), F.col("tags")),
        _candidates(detectors.unused_in_books(m.cells, reading, m.lines), w, "unused_cell", "risk", F.array("ref")), _candidates(detectors.hidden_in_books(m.cells, reading, m.lines), w, "hidden_input", "warning", F.array("ref")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def graph_pairs(m: Model) -> DataFrame:
    """workbook_id, src, dst of what cells read, cell by cell."""
    node = lambda c: F.to_json(F.struct(F.col("workbook_id").alias("w"), F.col(c).alias("r")))
    e = m.edges.where("dst is not null and kind in ('ref', 'cross_sheet', 'range')").select("workbook_id", "src", "kind", "dst")
    pairs = graph.range_edges(e.select(node("src").alias("src"), "kind", "dst"))
    at = F.from_json("src", "w string, r string")
    return pairs.select(at["w"].alias("workbook_id"), at["r"].alias("src"), "dst")


def credit_candidates(m: Model, broken: DataFrame) -> DataFrame:
    """Flagged credit controls as risks; broken: book, identity_id."""
    # a period's fact comes before its plan
    line = one_line(m.facts)
    first = F.row_number().over(Window.partitionBy("book", "concept", "period_key").orderBy(role_rank(F.col("role")), "col"))
    found = credit.controls_in_full(line.withColumn("_nth", first).where("_nth = 1").select("book", "concept", "period_key", "role", "value", "ref"), broken)
    period = F.try_element_at("period_keys", F.lit(1))
    return _candidates(found.where("status = 'flagged'"), F.col("book"), F.concat(F.lit("frs."), "control_id"), "risk", F.col("cell_refs"), period=period)


def audit(b: Books, glossary: DataFrame) -> DataFrame:
    """CANDIDATE rows of all books, and a row with detector ``unreadable`` for each book with a fault."""
    m = read_model(b, glossary)
    equal = stage(identity_candidates(m))
    broken = equal.select("book", F.substring_index("detector", ".", -1).alias("identity_id"))
    faults = _candidates(b.errors, F.col("book"), "unreadable", "error", F.array(), tags=F.array("error"))
    found = equal.unionByName(cell_candidates(m)).unionByName(credit_candidates(m, broken))
    return detectors.freeze_severity(found).select(*CANDIDATE).unionByName(faults.select(*CANDIDATE))
