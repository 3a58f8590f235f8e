"""Detectors over long facts (book, sheet, concept, period_key, role, value) and over cells."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import a1
from ..functions.numeric import ERRORS, as_number, as_rate, tolerance
from ..functions.periods import scenario_of
from .axis import aligned, previous
from .graph import reach
from .staging import stage

EPS = 1e-9
GROWTH = 0.10
#: Concepts that must move with volume, by the suffix of their detector.
WITH_VOLUME = {"ap": "bs.ap", "capex": "cf.capex", "cogs": "pnl.cogs", "headcount": "ops.headcount", "wc": "bs.ar", "inventory": "bs.inventory"}


def excel_errors(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("cached_value").isin(*ERRORS)).select("workbook_id", "sheet", "addr", F.lit("excel_error").alias("detector"), F.lit("error").alias("severity"))


def error_masking(compiled: DataFrame) -> DataFrame:
    """Formulas with IFERROR or IFNA whose value is no error."""
    masks = F.arrays_overlap("funcs", F.array(F.lit("IFERROR"), F.lit("IFNA")))
    shown = F.coalesce(F.col("cached_value").isin(*ERRORS), F.lit(False))
    return compiled.where(masks & ~shown).select("workbook_id", "sheet", "addr", F.lit("error_masking").alias("detector"), F.lit("warning").alias("severity"))


#: Concepts and words that make a circular reference likely to be meant.
MEANT_CONCEPTS = ("pnl.interest", "pnl.tax", "bs.debt")
MEANT_LABELS = ("interest", "tax", "sweep", "процент", "налог")


def circular(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """One candidate a circular group: workbook_id, cell_refs, size, tags, severity.

    groups: workbook_id, node (sheet!address), component; rows: workbook_id,
    sheet, row, concept_id, label.
    """
    sheet, row = F.regexp_extract("node", "^(.*)!", 1), F.regexp_extract("node", r"(\d+)$", 1).cast("int")
    meant = F.coalesce(F.col("concept_id").isin(*MEANT_CONCEPTS), F.lit(False)) | F.coalesce(F.lower("label").rlike("|".join(MEANT_LABELS)), F.lit(False))
    known = groups.withColumn("sheet", sheet).withColumn("row", row).join(rows.select("workbook_id", "sheet", "row", meant.alias("meant")), ["workbook_id", "sheet", "row"], "left")
    out = known.groupBy("workbook_id", "component").agg(F.array_sort(F.collect_set("node")).alias("cell_refs"), F.coalesce(F.bool_or("meant"), F.lit(False)).alias("meant"))
    tags = F.when(F.col("meant"), F.array(F.lit("likely_intentional"))).otherwise(F.array().cast("array<string>"))
    return out.select("workbook_id", "cell_refs", F.size("cell_refs").alias("size"), tags.alias("tags"), F.when(F.col("meant"), "warning").otherwise("error").alias("severity"))


def unresolved_dynamic(edges: DataFrame) -> DataFrame:
    return edges.where("kind = 'dynamic' and unresolved").select("workbook_id", F.col("src").alias("ref"))


def external_links(edges: DataFrame, books: DataFrame) -> DataFrame:
    """One candidate a workbook with external edges or declared externals: workbook_id, ref, externals.

    edges have the order of their cell as ord; books: workbook_id, externals, first_ref.
    """
    first = edges.where("kind = 'external'").groupBy("workbook_id").agg(F.min(F.struct("ord", "src"))["src"].alias("src"))
    both = books.join(first, "workbook_id", "full").where("src is not null or size(externals) > 0")
    return both.select("workbook_id", F.coalesce("src", "first_ref", F.lit("Workbook")).alias("ref"), F.coalesce("externals", F.array().cast("array<string>")).alias("externals"))


def macros(books: DataFrame) -> DataFrame:
    """Workbooks with VBA or old macro sheets."""
    return books.where("has_vba or has_xlm").select("workbook_id", F.coalesce("first_ref", F.lit("Workbook")).alias("ref"), "has_vba", "has_xlm")


#: Detectors of the kinds of drift.
DRIFT = {"template_change": "pattern_break", "ref_shift": "pattern_break", "source_sheet_change": "source_switch"}


def series_candidates(drift: DataFrame) -> DataFrame:
    """Drift as candidates: detector, and tags for the edges of the forecast and for manual figures of the past."""
    detector = F.coalesce(F.create_map(*[F.lit(x) for pair in DRIFT.items() for x in pair])[F.col("kind")], F.col("kind"))
    past = (F.col("role") == "historical") & F.col("kind").isin("value_instead_of_formula", "literal_in_ast")
    tags = F.filter(F.array(F.when(F.col("edge_period"), F.lit("edge_period")), F.when(past, F.lit("hist_manual_adjustment"))), lambda t: t.isNotNull())
    return drift.select("workbook_id", "sheet", "block_id", "row", "col", detector.alias("detector"), tags.alias("tags"), F.lit("warning").alias("severity"))


def scenario_switch(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Workbooks whose mapped lines read from different scenario sheets: workbook_id, scenarios, cell_refs.

    rows: workbook_id, sheet, row, concept_id; edges: workbook_id, src, dst.  A
    line counts if its cells read from one scenario sheet only, and if it isn't on
    one itself.
    """
    scenario = scenario_of
    e = edges.where("dst is not null").select("workbook_id", F.regexp_extract("src", "^(.*)!", 1).alias("sheet"), F.regexp_extract("src", r"(\d+)$", 1).cast("int").alias("row"), "src", scenario(F.regexp_extract("dst", "^(.*)!", 1)).alias("key"))
    mapped = rows.where("concept_id is not null").where(scenario(F.col("sheet")).isNull()).select("workbook_id", "sheet", "row").distinct()
    lines = mapped.join(e, ["workbook_id", "sheet", "row"]).groupBy("workbook_id", "sheet", "row").agg(F.collect_set("key").alias("keys"), F.collect_set("src").alias("refs")).where("size(keys) = 1")
    out = lines.groupBy("workbook_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("scenarios"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs")))).alias("cell_refs"))
    return out.where("size(scenarios) >= 2")


def sum_cells(compiled: DataFrame, rows: DataFrame) -> DataFrame:
    """Totals in a block, as range_gaps takes them: workbook_id, sheet, block_id, addr, row, col, check_row, boxes (of its own sheet)."""
    sums = compiled.where("size(sum_ranges) > 0").join(rows.select("workbook_id", "sheet", "block_id", "row", "check_row"), ["workbook_id", "sheet", "row"])
    own = F.filter("sum_ranges", lambda r: a1.sheet_of(r, F.lit("")) == F.col("sheet"))
    return sums.select("workbook_id", "sheet", "block_id", "addr", "row", "col", "check_row", own.alias("ranges")).withColumn("boxes", a1.range_boxes(F.transform("ranges", a1.body_of)))


def covered_leaves(sums: DataFrame) -> DataFrame:
    """What double_counts takes: workbook_id, sheet, col, first, last, totals: rows of a column, no totals among them, and how many of its totals' ranges cover them.

    A range counts whole and stays a run of rows, however long: down a column the
    totals change where runs start and end only.
    """
    on = ["workbook_id", "sheet", "col"]
    run = lambda first, last, here: F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"), F.lit(here).alias("here"))
    own = F.filter("boxes", lambda b: (b["c1"] <= F.col("col")) & (F.col("col") <= b["c2"]))
    # the cell of a total is a run too; a column's runs lie together for all that follows
    both = F.concat(F.transform(own, lambda b: run(b["r1"], b["r2"], 0)), F.array(run(F.col("row"), F.col("row"), 1)))
    runs = sums.where(~F.coalesce("check_row", F.lit(False))).select(*on, "row", both.alias("runs")).repartition(*on).select(*on, F.col("row").alias("total"), F.inline("runs"))
    above = Window.partitionBy(*on, "total", "here").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest("first", F.max("last").over(above) + 1)
    runs = runs.withColumn("first", fresh).where(F.col("first") <= F.col("last"))
    end = lambda row, by: F.struct(row.alias("row"), (by * (1 - F.col("here"))).alias("totals"), (by * F.col("here")).alias("here"))
    ends = runs.select(*on, F.inline(F.array(end(F.col("first"), F.lit(1)), end(F.col("last") + 1, F.lit(-1)))))
    steps = ends.groupBy(*on, "row").agg(F.sum("totals").alias("totals"), F.sum("here").alias("here"))
    down = Window.partitionBy(*on).orderBy("row")
    spans = steps.select(*on, F.col("row").alias("first"), (F.lead("row").over(down) - 1).alias("last"), F.sum("totals").over(down).alias("totals"), F.sum("here").over(down).alias("here"))
    return spans.where("totals > 0 and here = 0").drop("here")


def _pairs(facts: DataFrame, concepts: tuple[str, ...]):
    a, b = facts.where(F.col("concept").isin(*concepts)).alias("a"), facts.where(F.col("concept").isin(*concepts)).alias("b")
    same = (F.col("a.book") == F.col("b.book")) & (F.col("a.concept") == F.col("b.concept")) & (F.col("a.period_key") == F.col("b.period_key"))
    # any two lines, of one sheet or of two
    order = ["ord"] if "ord" in facts.columns else ["sheet"]
    return a.join(b, same & (F.struct(*[f"a.{c}" for c in order]) < F.struct(*[f"b.{c}" for c in order]))).select("a.book", "a.concept", "a.period_key", F.col("a.value").alias("x"), F.col("b.value").alias("y"))


def conflicting_rates(facts: DataFrame) -> DataFrame:
    """Tax and interest rates of one period that differ between sheets, percent points and fractions alike."""
    p = _pairs(facts, ("pnl.tax_rate", "pnl.interest_rate"))
    return p.where(F.abs(as_rate(F.col("x")) - as_rate(F.col("y"))) > 1e-6)


def conflicting_fx(facts: DataFrame) -> DataFrame:
    return _pairs(facts, ("fx.rate",)).where(F.abs(F.col("x") - F.col("y")) > 1e-6)


def scale_mismatches(facts: DataFrame, concepts: tuple[str, ...]) -> DataFrame:
    """Amounts of one concept and period about a thousand or a million times apart (within 10 %)."""
    p = _pairs(facts, concepts).where("x <> 0 and y <> 0")
    ratio = F.greatest(F.abs("x"), F.abs("y")) / F.least(F.abs("x"), F.abs("y"))
    return p.where((F.abs(ratio / 1000 - 1) <= 0.1) | (F.abs(ratio / 1_000_000 - 1) <= 0.1)).withColumn("ratio", ratio)


def below_breakeven(facts: DataFrame) -> DataFrame:
    """|Q| |P| - |COGS| short of |OPEX| by more than the tolerance."""
    w = aligned(facts, ["pnl.volume", "pnl.price", "pnl.cogs", "pnl.opex"])
    margin = F.abs("pnl_volume") * F.abs("pnl_price") - F.abs("pnl_cogs")
    opex = F.abs("pnl_opex")
    return w.where(margin + tolerance(margin, opex) < opex).select("book", "period_key", (margin - opex).alias("delta"))


def irr_below_wacc(facts: DataFrame) -> DataFrame:
    w = aligned(facts, ["val.irr", "val.wacc"])
    return w.where(as_rate(F.col("val_irr")) + EPS < as_rate(F.col("val_wacc"))).select("book", "period_key", F.col("val_irr").alias("irr"), F.col("val_wacc").alias("wacc"))


def negative_npv(facts: DataFrame) -> DataFrame:
    return facts.where((F.col("concept") == "val.npv") & (F.col("value") < 0)).select("book", "period_key", F.col("value").alias("npv"))


def volume_without(facts: DataFrame, other: str) -> DataFrame:
    """Forecast periods whose volume grows by 10 % or more over the previous aligned one while the other line stays."""
    w = aligned(facts, ["pnl.volume", other])
    c = other.replace(".", "_")
    ok = F.col("pnl_volume").isNotNull() & F.col(c).isNotNull()
    w = w.select("book", "period_key", "role", "pnl_volume", c, previous(ok, F.col("pnl_volume")).alias("v0"), previous(ok, F.col(c)).alias("c0"))
    grown = F.try_divide(F.abs("pnl_volume"), F.abs("v0")) - 1
    flat = F.abs(F.col(c)) - F.abs("c0") <= tolerance(F.col(c), F.col("c0"))
    return w.where((F.col("role") == "forecast") & (grown >= GROWTH - EPS) & flat).select("book", "period_key", grown.alias("growth"), (F.abs(F.col(c)) - F.abs("c0")).alias("moved"))


def stress_rate_unchanged(facts: DataFrame) -> DataFrame:
    """Stress against base scenario columns: revenue falls by more than max(1, 1 % of base) and the rate doesn't rise."""
    w = aligned(facts, ["pnl.revenue", "pnl.interest_rate"], ("book", "period_key", "role"))
    b, s = w.where("period_key = 'base'").alias("b"), w.where("period_key = 'stress'").alias("s")
    fell = F.abs("b.pnl_revenue") - F.abs("s.pnl_revenue")
    hit = (fell > F.greatest(F.lit(1.0), 0.01 * F.abs("b.pnl_revenue"))) & (as_rate(F.col("s.pnl_interest_rate")) <= as_rate(F.col("b.pnl_interest_rate")) + EPS)
    return b.join(s, F.col("b.book") == F.col("s.book")).where(hit).select("b.book", fell.alias("fell"))


def range_gaps(sums: DataFrame, rows: DataFrame) -> DataFrame:
    """Article cells of a block that a total's ranges leave out.

    sums: workbook_id, sheet, block_id, addr, row, col and boxes (array of r1, c1, r2, c2);
    rows: workbook_id, sheet, block_id, row, check_row.  A total meets the list of
    its block's rows, which a sheet bounds.
    """
    on = ["workbook_id", "sheet", "block_id"]
    r = rows.where(~F.col("check_row")).groupBy(*on).agg(F.array_sort(F.collect_set("row")).alias("articles"))
    inside = lambda article: F.exists("boxes", lambda b: (b["c1"] <= F.col("col")) & (F.col("col") <= b["c2"]) & (b["r1"] <= article) & (article <= b["r2"]))
    missing = F.filter("articles", lambda article: (article != F.col("row")) & ~inside(article))
    return sums.join(r, on).select(*on, "addr", missing.alias("missing")).where("size(missing) > 0")


def double_counts(covered: DataFrame) -> DataFrame:
    """workbook_id, sheet, col, leaf, totals of the leaves that two or more totals of the same sheet and column cover, from covered_leaves."""
    on = ["workbook_id", "sheet", "col"]
    rows = covered.where("totals > 1").select(*on, F.explode(F.sequence("first", "last")).alias("row"), "totals")
    return rows.select(*on, a1.address(F.col("row"), F.col("col")).alias("leaf"), "totals")


def unused_cells(cells: DataFrame, reached: DataFrame, cap: int = 50) -> DataFrame:
    """The first ``cap`` value cells of a workbook, in scan order, that no output reaches (the cap is the feature)."""
    rest = cells.where("formula_raw is null and cached_value is not null").join(reached, ["workbook_id", "ref"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("workbook_id").orderBy("ord"))
    return rest.withColumn("nth", nth).where(F.col("nth") <= cap).drop("nth")


def hidden_inputs(cells: DataFrame, reached: DataFrame) -> DataFrame:
    return cells.where("hidden").join(reached, ["workbook_id", "ref"], "left_semi")


#: Concepts whose lines are outputs whatever their role, and the ending of others.
OUTPUT_CONCEPTS, OUTPUT_ENDING = ("pnl.ebitda", "pnl.net_income", "pnl.ebit"), "_total"


def _has_value(cells: DataFrame) -> Column:
    return F.col("formula_raw").isNotNull() | as_number(F.col("cached_value")).isNotNull()


def output_cells(cells: DataFrame, lines: DataFrame) -> DataFrame:
    """workbook_id, ref, hidden of the output cells of a book: on each output line its formulas, or its values where it has none.

    cells: workbook_id, sheet, row, ref, formula_raw, cached_value, hidden; lines:
    workbook_id, sheet, row, article_role, concept_id.
    """
    concept = F.coalesce("concept_id", F.lit(""))
    some = lines.where((F.coalesce("article_role", F.lit("")) == "output") | concept.endswith(OUTPUT_ENDING) | concept.isin(*OUTPUT_CONCEPTS)).select("workbook_id", "sheet", "row").distinct()
    on = cells.join(some, ["workbook_id", "sheet", "row"]).where(_has_value(cells))
    has_formula = F.max(F.col("formula_raw").isNotNull()).over(Window.partitionBy("workbook_id", "sheet", "row"))
    return on.withColumn("_some", has_formula).where("not _some or formula_raw is not null").select("workbook_id", "ref", F.coalesce("hidden", F.lit(False)).alias("hidden"))


def _in_books(edges: DataFrame, starts: DataFrame, most_edges: int = 5_000_000) -> DataFrame:
    """(workbook_id, ref) of all that the starts (workbook_id, ref) of a book read, by its own edges (workbook_id, src, dst); starts included.

    A book is walked in one task, so a chain of formulas costs no rounds, and only
    its edges are shuffled, once; books of more than ``most_edges`` go through
    reach together.
    """
    kind = starts.schema["workbook_id"].dataType
    edges = edges.where("dst is not null").select("workbook_id", "src", "dst")
    large = stage(edges.groupBy("workbook_id").count().where(F.col("count") > most_edges).select("workbook_id"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, to, found = None, {}, []
        books, refs = [], []

        def close() -> None:
            seen, open_ = set(found), list(found)
            while open_:
                for ref in to.get(open_.pop(), ()):
                    if ref not in seen:
                        seen.add(ref)
                        open_.append(ref)
            books.extend([book] * len(seen))
            refs.extend(seen)

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(books, at), pa.array(refs, pa.string())], ["workbook_id", "ref"])
            books.clear()
            refs.clear()
            return batch

        at = None
        for batch in batches:
            at = batch.schema.field("workbook_id").type
            for k, src, dst in zip(*(batch.column(c).to_pylist() for c in ("workbook_id", "src", "dst")), strict=True):
                if k != book:
                    close()
                    book, to, found = k, {}, []
                if dst is None:
                    found.append(src)
                else:
                    to.setdefault(src, []).append(dst)
            if len(refs) > 10_000:
                yield out()
        if at is not None:
            close()
            yield out()

    # a start is an edge to nowhere
    both = edges.unionByName(starts.select("workbook_id", F.col("ref").alias("src"), F.lit(None).cast("string").alias("dst"))).where("workbook_id is not null and src is not null")
    near = both if large.isEmpty() else both.join(F.broadcast(large), "workbook_id", "left_anti")
    near = near.repartition("workbook_id").sortWithinPartitions("workbook_id").mapInArrow(walk, f"workbook_id {kind.simpleString()}, ref string")
    if large.isEmpty():
        return near
    node = lambda c: F.to_json(F.struct(F.col("workbook_id").cast("string").alias("w"), F.col(c).alias("r")))
    of = lambda df: df.join(F.broadcast(large), "workbook_id", "left_semi")
    seen = reach(of(edges).select(node("src").alias("src"), node("dst").alias("dst")), of(starts).select(F.lit(0).alias("source"), node("ref").alias("node")), True)
    at = F.from_json("node", "w string, r string")
    return near.unionByName(seen.select(at["w"].cast(kind).alias("workbook_id"), at["r"].alias("ref")).distinct())


def unused_in_books(cells: DataFrame, edges: DataFrame, lines: DataFrame, cap: int = 50) -> DataFrame:
    """workbook_id, ref of the first ``cap`` cells with a value or formula, in scan order (ord), that no output of their book reads; books without outputs have none."""
    outputs = output_cells(cells, lines).select("workbook_id", "ref")
    rest = cells.where(_has_value(cells)).join(outputs.select("workbook_id").distinct(), "workbook_id", "left_semi").join(_in_books(edges, outputs), ["workbook_id", "ref"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("workbook_id").orderBy("ord"))
    return rest.withColumn("nth", nth).where(F.col("nth") <= cap).select("workbook_id", "ref")


def hidden_in_books(cells: DataFrame, edges: DataFrame, lines: DataFrame) -> DataFrame:
    """workbook_id, ref of hidden cells that an output which isn't hidden reads."""
    outputs = output_cells(cells, lines).where("not hidden").select("workbook_id", "ref")
    return cells.where("hidden").select("workbook_id", "ref").join(_in_books(edges, outputs), ["workbook_id", "ref"], "left_semi")


def dedup_candidates(candidates: DataFrame) -> DataFrame:
    """First candidate (by ord) of each detector and set of references."""
    key = F.array_sort(F.array_distinct("cell_refs"))
    first = Window.partitionBy("book", "detector", key).orderBy("ord")
    return candidates.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def freeze_severity(candidates: DataFrame) -> DataFrame:
    """Errors with a mitigating tag become warnings."""
    mild = F.arrays_overlap("tags", F.array(*map(F.lit, ("likely_intentional", "edge_period", "hist_manual_adjustment"))))
    return candidates.withColumn("severity", F.when(mild & (F.col("severity") == "error"), "warning").otherwise(F.col("severity")))
