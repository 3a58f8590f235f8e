"""Texts of a report: templates with typed slots, joined to findings and controls.

Templates are tables, so that a report can be had in any language: the ones here
are defaults.  A slot {name} takes a text of the row; figures are written by
their kind: share as percent, ratio with an x, flag as yes or no, anything else
as a number with spaces between thousands and two decimals at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (control, what it checks, what a hit may mean, what to do next); '' serves controls without an entry.
CONTROLS = (
    ("F03", "Forecast years in a row with a loss.", "Losses that go on have to be financed.", "Look at the measures that should end them."),
    ("F04", "Profit against operating and free cash flow.", "Profit that brings no cash strains liquidity.", "Go from profit to cash, step by step."),
    ("F08", "Least cash, when it runs out, and cash held up by new debt.", "Without cash there is a need for financing.", "Look at monthly cash and at limits."),
    ("F13", "Dividends against free cash flow and new debt.", "Dividends may be paid with debt.", "Hold the dividend policy against cash flows."),
    ("F14", "Headroom of covenants and least cash.", "Without headroom a covenant may break.", "Hold the headroom against the contract."),
    ("", "Figures of this control.", "Depends on what the control finds.", "Look at the cells it reads."),
)
#: (status, why it is so).
STATUSES = (
    ("flagged", "The threshold is broken; the cells are listed ({cells})."), ("clear", "The threshold holds on the data there is."),
    ("insufficient", "The control applies, but a period or a line is missing."), ("not_applicable", "A line that the control needs is not mapped ({need})."),
)
#: (figure, its name, its kind), in the order they are told.
FIGURES = (
    ("ni", "net income", "number"), ("cfo", "operating cash flow", "number"), ("accruals", "accruals", "number"), ("fcf", "free cash flow", "number"), ("fcff", "free cash flow to the firm", "number"), ("fcfe", "free cash flow to equity", "number"),
    ("min_headroom", "least headroom", "number"), ("min_cash", "least cash", "number"), ("runway", "periods with cash", "number"), ("cash_plug", "cash plug", "flag"), ("nd_ebitda", "net debt to EBITDA", "ratio"), ("icr", "interest cover", "ratio"), ("margin", "margin", "share"),
)
#: (cause, in words).
CAUSES = (("ops", "profit does not become operating cash"), ("wc_ar", "receivables grow"), ("wc_ap", "payables move against cash"), ("capex", "investment takes the cash"), ("dividends", "dividends take the cash"), ("cash_plug", "drawings hold the cash up"))
#: (what a detector's name begins with, its title); the longest that fits counts.
TITLES = (
    ("", "Finding"), ("identity.", "An accounting identity does not hold"), ("frs.", "A credit control is flagged"), ("excel_error", "A cell shows an error"), ("error_masking", "An error may be hidden"), ("circular", "Cells depend on themselves"), ("external_link", "The book reads another file"),
    ("pattern_break", "A formula leaves its row's pattern"), ("value_instead_of_formula", "A number stands where a formula should"), ("literal_in_ast", "A number is written into a formula"), ("hidden_input", "A hidden cell feeds a result"), ("unused_cell", "A cell feeds no result"), ("agg_", "A total misses or repeats lines"),
)


def number_text(x: Column) -> Column:
    size = F.abs(x)
    whole = F.when(size == F.floor(size), F.format_number(size, 0)).otherwise(F.regexp_replace(F.format_number(size, 2), r"\.?0+$", ""))
    return F.when(x == 0, "0").otherwise(F.concat(F.when(x < 0, "−").otherwise(""), F.replace(whole, F.lit(","), F.lit(" "))))


def figure_text(x: Column, kind: Column) -> Column:
    by_kind = F.when(kind == "share", F.concat(number_text(x * 100), F.lit("%"))).when(kind == "ratio", F.concat(number_text(x), F.lit("x"))).when(kind == "flag", F.when(x != 0, "yes").otherwise("no"))
    return F.coalesce(by_kind, number_text(x))


def filled(template: Column, **slots: Column) -> Column:
    """The template with its slots; a slot without a text is left empty."""
    out = template
    for name, text in slots.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), F.coalesce(text.cast("string"), F.lit("")))
    return out


def _table(spark: SparkSession, rows: tuple, schema: str) -> DataFrame:
    """A template table, known to be small."""
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def key_facts(results: DataFrame, figures: tuple = FIGURES) -> DataFrame:
    """book, control_id, key_fact: the figures of a control in their order; figures without a name come last, by their own."""
    spark = results.sparkSession
    names = _table(spark, tuple((n, *f) for n, f in enumerate(figures)), "place int, figure string, label string, kind string")
    each = results.select("book", "control_id", F.explode("metrics").alias("figure", "x")).where("x is not null").join(names, "figure", "left")
    said = F.concat_ws(" ", F.coalesce("label", F.replace("figure", F.lit("_"), F.lit(" "))), figure_text(F.col("x"), F.coalesce("kind", F.lit("number"))))
    parts = each.groupBy("book", "control_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("place", F.lit(1 << 20)).alias("place"), "figure", said.alias("text")))).alias("parts"))
    return parts.select("book", "control_id", F.concat(F.array_join("parts.text", "; "), F.lit(".")).alias("key_fact"))


def risk_screen(results: DataFrame, needs: dict[str, str], controls: tuple = CONTROLS, statuses: tuple = STATUSES, figures: tuple = FIGURES, causes: tuple = CAUSES) -> DataFrame:
    """book, control_id, status, checks, status_reason, key_fact, cause, impact, next_step, cell_refs of each result (as ``credit`` gives them)."""
    spark = results.sparkSession
    told = _table(spark, controls, "about string, checks string, impact string, next_step string")
    reasons, words = _table(spark, statuses, "status string, reason string"), _table(spark, causes, "cause string, cause_text string")
    known = F.array(*[F.lit(c[0]) for c in controls if c[0]])
    need = F.element_at(F.create_map(*[F.lit(x) for kv in needs.items() for x in kv]), F.col("control_id"))
    r = results.withColumn("about", F.when(F.array_contains(known, F.col("control_id")), F.col("control_id")).otherwise("")).join(told, "about", "left").join(reasons, "status", "left").join(words, "cause", "left")
    r = r.join(key_facts(results, figures), ["book", "control_id"], "left")
    silent = F.when(F.col("status") == "clear", "No signal in the figures.").otherwise("There is no figure.")
    return r.select(
        "book", "control_id", "status", "checks", filled(F.col("reason"), cells=F.array_join("cell_refs", ", "), need=need).alias("status_reason"), F.coalesce("key_fact", silent).alias("key_fact"),
        F.coalesce("cause_text", F.col("cause")).alias("cause"), "impact", "next_step", "cell_refs",
    )


def cards(found: DataFrame, titles: tuple = TITLES, evidence: str = "Detector {detector}; cells {cells}; lines {metrics}.", advice: str = "Look at these cells. The file was not changed.") -> DataFrame:
    """book, id, title, evidence, recommendation of each finding."""
    d = F.col("detector")
    title = F.lit(dict(titles).get("", "Finding"))
    # the longest beginning is asked first
    for start, text in sorted((t for t in titles if t[0]), key=lambda t: len(t[0])):
        title = F.when(d.startswith(start), text).otherwise(title)
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("—")
    return found.select("book", "id", title.alias("title"), filled(F.lit(evidence), detector=d, cells=listed("cell_refs"), metrics=listed("metrics")).alias("evidence"), F.lit(advice).alias("recommendation"))


def positives(screen: DataFrame) -> DataFrame:
    """book, control_id, text: what speaks for a book, by the controls that are clear and have figures."""
    return screen.where("status = 'clear'").where(F.col("key_fact") != "No signal in the figures.").select("book", "control_id", F.concat_ws(" ", "checks", "key_fact").alias("text"))
