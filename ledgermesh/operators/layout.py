"""Layout of sheets: from cells to header bands, period axes, blocks and their lines.

1. Each cell becomes its shown text and what that tells as a header (an atom).
2. Lines are classed by aggregates over their cells: which layers of a header they
   hold (dates, years, quarters, months, fact and plan, start and end of a period).
3. A band is a run of header lines.  Whether a line joins it depends on the lines
   already in it, so the lines of a sheet pass a small state machine in their
   order; a sheet has a million lines at most, and a line comes without its texts.
4. A band's columns are composed by ordered aggregates, years are carried to the
   right by a window, fact and plan marks reach to the next mark of their line,
   and the keys of an axis are brought to one grain.
5. The lines from a band to the next are its block.  A line's parent is the
   nearest line above with a smaller indent.

cells: book, sheet, row, col, cached_value, number_format, hidden, and date1904
where books have it.  A block needs two columns of the calendar at least.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import display_text
from ..functions.numeric import as_number
from ..functions.periods import CALENDAR_KEY, apply_grain, header_atom, infer_grain, normalize_header
from .staging import discard, stage

#: The words of lines that number columns, check sums, or tell what a header line holds.
INDEX_LABEL = r"(?iu)^(№|n|no|#)$"
CHECK_LABEL = r"(?iu)check|проверк|контроль|tie[- ]?out|plug\b|сход[ия]|должен"
QUARTER_LABEL, MONTH_LABEL = r"(?iu)квартал|quarter", r"(?iu)месяц|month"
START_LABEL, END_LABEL = r"(?iuU)начал[оа]\s+период|start\s+of\s+period|period\s+start", r"(?iuU)конец\s+период|end\s+of\s+period|period\s+end"
#: Layers of a line, as bits.
DATE, YEAR, QUARTER, MONTH, ROLE, BOUNDS = 1, 2, 4, 8, 16, 32
AT = ["book", "sheet"]
TIMED = ("historical", "forecast", "stub")


class Layout(NamedTuple):
    """headers: book, sheet, block_id, header_row, col, role, header_text, period_key.

    rows: book, sheet, block_id, row, label, label_col, indent, parent_row, check_row, hidden.
    """

    headers: DataFrame
    rows: DataFrame


def shown(cells: DataFrame) -> DataFrame:
    """book, sheet, row, col, hidden, text (null where blank), is_number, atom of each cell."""
    value, date1904 = F.col("cached_value"), F.coalesce(F.col("date1904"), F.lit(False)) if "date1904" in cells.columns else False
    text = display_text(value, as_number(value), F.col("number_format"), date1904)
    c = cells.select(*AT, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.coalesce(F.col("hidden"), F.lit(False)).alias("hidden"), F.when(F.trim(F.regexp_replace(text, r"(?U)\s", "")) != "", text).alias("text"))
    # most cells hold amounts: a plain number that is no year, no factor and not small tells nothing
    number = as_number(F.col("text"))
    tells = ~F.coalesce((F.abs(number) > 12) & ~number.between(1900, 2099.99), F.lit(False))
    return c.withColumn("is_number", F.coalesce(number.isNotNull(), F.lit(False))).withColumn("atom", F.when(F.col("text").isNotNull() & tells, header_atom(F.col("text"))))


def _is_header(atom: Column) -> Column:
    """Whether a cell is a header by itself; quarters without a year and plain numbers aren't."""
    return F.coalesce(atom["kind"].isin("full", "role_marker"), F.lit(False))


def line_classes(cells: DataFrame) -> DataFrame:
    """A row for each line of ``shown`` cells: what the band scan and the blocks need of it."""
    atom, kind = F.col("atom"), F.col("atom.kind")
    has = F.col("text").isNotNull()
    year_like = F.coalesce(F.col("atom.number").isNotNull() & (as_number(F.col("text")) == F.floor(as_number(F.col("text")))), F.lit(False))
    plain = has & ~_is_header(atom)
    is_label = has & ~F.col("hidden") & ~F.col("is_number") & (kind.isNull() | (kind == "role_marker"))
    count = lambda c: F.count(F.when(c, 1))
    whole = F.col("is_number") & (as_number(F.col("text")) == F.floor(as_number(F.col("text"))))
    found = cells.groupBy(*AT, "row").agg(
        count(has).alias("n_texts"),
        F.min_by(F.when(is_label, F.col("text")), F.when(is_label, F.col("col"))).alias("label"),
        count((kind == "full") & F.col("atom.period_key").rlike(CALENDAR_KEY)).alias("n_calendar"),
        count(kind == "role_marker").alias("n_marks"),
        count((kind == "full") & F.col("atom.day").isNotNull()).alias("n_dates"),
        count((kind == "full") & F.col("atom.year").isNotNull() & F.col("atom.quarter").isNull() & F.col("atom.month").isNull()).alias("n_years"),
        count(F.col("atom.quarter").isNotNull()).alias("n_quarters"),
        count(F.col("atom.month").isNotNull() & F.col("atom.day").isNull()).alias("n_months"),
        count(year_like & F.col("atom.number").between(1, 4)).alias("n_to_4"),
        count(year_like & F.col("atom.number").between(5, 12)).alias("n_to_12"),
        F.array_sort(F.collect_list(F.when(plain & whole, F.struct("col", as_number(F.col("text")).alias("n"))))).alias("numbers"),
        F.coalesce(F.bool_or(plain & F.col("is_number") & ~whole), F.lit(False)).alias("has_fraction"),
        F.collect_set(F.when(kind == "role_marker", F.col("col"))).alias("mark_cols"),
        F.collect_set(F.when(kind.isin("full", "quarter_token"), F.col("col"))).alias("calendar_cols"),
        # what names a block's labels: the first column with a word, or else the first that is seen
        F.min(F.when(plain & ~F.col("hidden") & ~F.col("is_number"), F.col("col"))).alias("word_col"),
        F.min(F.when(~F.col("hidden"), F.col("col"))).alias("seen_col"),
    )
    label = normalize_header(F.col("label"))
    says = lambda words: F.coalesce(label.rlike(words), F.lit(False))
    found = found.withColumns({"by_quarter": says(QUARTER_LABEL), "by_month": says(MONTH_LABEL), "is_start": says(START_LABEL), "is_end": says(END_LABEL)})
    quarters = F.col("n_quarters") + F.when(F.col("by_quarter"), F.col("n_to_4")).otherwise(0)
    months = F.col("n_months") + F.when(F.col("by_month"), F.col("n_to_12") + F.when(F.col("by_quarter"), 0).otherwise(F.col("n_to_4"))).otherwise(0)
    bit = lambda c, b: F.when(c, b).otherwise(0)
    layers = bit(F.col("n_dates") > 0, DATE) + bit(F.col("n_years") > 0, YEAR) + bit(quarters >= 2, QUARTER) + bit(months >= 2, MONTH) + bit(F.col("n_marks") > 0, ROLE) + bit(F.col("is_start") | F.col("is_end"), BOUNDS)
    counts_up = F.forall(F.transform("numbers", lambda x, i: x["n"] == i + 1), lambda ok: ok)
    counter = (F.col("label").isNull() | F.coalesce(F.trim("label").rlike(INDEX_LABEL), F.lit(False))) & ~F.col("has_fraction") & (F.size("numbers") >= 2) & counts_up
    return found.select(
        *AT, "row", (F.col("n_texts") == 0).alias("empty"), (F.col("n_calendar") >= 2).alias("starts"), counter.alias("counter"), layers.alias("layers"), "mark_cols", "calendar_cols",
        "word_col", "seen_col", "by_quarter", "by_month", "is_start", "is_end",
    )


_SCANNED = "book string, sheet string, row int, header_row int, in_band boolean"


def _scan(lines: list[dict]) -> Iterator[tuple[int, int, bool]]:
    """(row, last row of the band it belongs to, whether it is in the band) of the lines of a sheet, given in their order."""
    bands: list[list[int]] = []
    band: list[int] | None = None
    layers, columns, waiting = 0, set(), []

    def joins(line: dict) -> bool:
        if not line["layers"]:
            return False
        if line["layers"] == ROLE and layers & (DATE | YEAR | QUARTER | MONTH):
            return not line["mark_cols"] or bool(columns.intersection(line["mark_cols"]))
        anew = layers & line["layers"] & (YEAR | DATE) and line["starts"]
        return not anew or bool((layers | line["layers"]) & BOUNDS)

    def take(line: dict) -> None:
        nonlocal layers
        band.append(line["row"])
        layers |= line["layers"]
        columns.update(line["calendar_cols"])

    for line in lines:
        if line["empty"]:
            continue
        if band is not None and not line["counter"]:
            if joins(line):
                take(line)
                waiting = []
                continue
            band = None
        if band is None and line["starts"]:
            # marks of fact or plan right above belong to it
            band, layers, columns = [], 0, set()
            bands.append(band)
            for above in [*waiting, line]:
                take(above)
            waiting = []
        else:
            waiting = [*waiting, line] if line["layers"] == ROLE else []
    at, inside = -1, {row for b in bands for row in b}
    for line in lines:
        while at + 1 < len(bands) and line["row"] >= bands[at + 1][0]:
            at += 1
        if at >= 0:
            yield line["row"], bands[at][-1], line["row"] in inside


def bands(lines: DataFrame) -> DataFrame:
    """book, sheet, row, header_row (the last line of its band), in_band of every line from a sheet's first band on."""

    def scan(key: tuple, table: pa.Table) -> pa.Table:
        found = list(_scan(table.sort_by("row").to_pylist()))
        row, header, inside = zip(*found) if found else ((), (), ())
        book, sheet = (pa.array([k.as_py()] * len(found), pa.string()) for k in key)
        return pa.table([book, sheet, pa.array(row, pa.int32()), pa.array(header, pa.int32()), pa.array(inside, pa.bool_())], ["book", "sheet", "row", "header_row", "in_band"])

    some = lines.select(F.col("book").cast("string").alias("book"), "sheet", "row", "empty", "starts", "counter", "layers", "mark_cols", "calendar_cols")
    return some.groupBy("book", "sheet").applyInArrow(scan, _SCANNED)


BLOCK = [*AT, "header_row"]


def composed(cells: DataFrame, lines: DataFrame, scanned: DataFrame, tasks: int | None = None) -> DataFrame:
    """BLOCK, col, header_text, period_key, role of the composed columns of each band, before the grain is known."""
    inside = scanned.where("in_band").join(lines.select(*AT, "row", "by_quarter", "by_month", "is_start", "is_end"), [*AT, "row"])
    of_band = Window.partitionBy(*BLOCK)
    over = lambda c: F.max(c).over(of_band)
    inside = inside.select(*BLOCK, "row", over("by_quarter").alias("quarters"), over("by_month").alias("months"), (over("is_start") & over("is_end")).alias("by_end"), "is_start")
    c = cells.where("text is not null").join(inside, [*AT, "row"])
    skipped, number = F.col("by_end") & F.col("is_start"), F.col("atom.number")
    as_quarter, as_month = number.between(1, 4), number.between(1, 12)
    quarter = F.coalesce(F.col("atom.quarter"), F.when(F.col("quarters") & as_quarter, number))
    month = F.coalesce(F.col("atom.month"), F.when(F.col("months") & as_month & ~(F.col("quarters") & as_quarter), number))
    c = c.select(*BLOCK, "row", "col", "text", skipped.alias("skipped"), F.col("atom.kind").alias("kind"), F.col("atom.role").alias("role"), F.col("atom.period_key").alias("key"), F.col("atom.explicit").alias("explicit"), F.col("atom.year").alias("year"), quarter.alias("quarter"), month.alias("month"), F.col("atom.day").alias("day"), (F.col("atom.kind").isin("full", "quarter_token") | number.isNotNull()).alias("dated"))
    first = lambda value, when: F.min_by(F.when(when, value), F.when(when, F.col("row")))
    used = ~F.col("skipped")
    full = used & (F.col("kind") == "full")
    by_row = F.array_sort(F.collect_list(F.when(used & F.col("kind").isNotNull(), F.struct("row", "text"))))
    cols = c.groupBy(*BLOCK, "col").agg(
        F.collect_set(F.when(used, F.col("year"))).alias("years"),
        first(F.struct("key", "role"), full & (F.col("key").isin("total", "stub") | (F.col("role") == "scenario"))).alias("structural"),
        first(F.col("key"), full & F.col("day").isNotNull()).alias("date"),
        first(F.col("quarter"), used & F.col("quarter").isNotNull()).alias("quarter"),
        first(F.col("month"), used & F.col("month").isNotNull() & F.col("day").isNull()).alias("month"),
        first(F.col("key"), full & F.col("key").rlike(CALENDAR_KEY)).alias("full"),
        first(F.col("role"), used & F.coalesce("explicit", F.lit(False)) & F.col("role").isin(*TIMED)).alias("said"),
        F.coalesce(F.bool_or(used & (full | F.col("quarter").isNotNull() | F.col("month").isNotNull())), F.lit(False)).alias("temporal"),
        F.coalesce(F.bool_or(used & F.col("dated")), F.lit(False)).alias("calendar"),
        F.array_join(F.array_distinct(F.transform(by_row, lambda x: x["text"])), " ").alias("header_text"),
        # marks count on every line of the band
        F.collect_list(F.when((F.col("kind") == "role_marker") & F.col("role").isin("historical", "forecast"), F.struct("row", "role"))).alias("marks"),
    )
    staged = stage(cols, tasks)
    cols = _with_marks(staged)
    alone = (F.size("years") == 1) & F.col("structural").isNull() & F.col("temporal")
    carried = F.last(F.when(alone, F.col("years")[0]), True).over(Window.partitionBy(*BLOCK).orderBy("col").rowsBetween(Window.unboundedPreceding, -1))
    cols = cols.withColumn("year", F.coalesce(F.try_element_at("years", F.lit(1)), carried))
    dated = F.concat("year", F.lit("-"), F.lpad(F.col("month").cast("string"), 2, "0"))
    key = (
        F.when(F.size("years") > 1, None).when(F.col("structural").isNotNull(), F.col("structural.key")).when(~F.col("temporal"), None).when(F.col("date").isNotNull(), F.col("date"))
        .when(F.col("year").isNotNull() & F.col("quarter").isNotNull(), F.concat("year", F.lit("Q"), F.col("quarter").cast("string"))).when(F.col("year").isNotNull() & F.col("month").isNotNull(), dated).otherwise(F.coalesce("full", "year"))
    )
    role = F.coalesce("said", "marked", "structural.role", F.lit("historical"))
    out = stage(cols.select(*BLOCK, "col", "header_text", key.alias("period_key"), role.alias("role")).where("period_key is not null"), tasks)
    discard(staged)
    return out


def _with_marks(cols: DataFrame) -> DataFrame:
    """cols with marked: the role that marks of fact or plan give to a column.

    A mark at a dated column is for that column; another reaches to the next mark of
    its line, and to all columns that nothing else marks where its line has no other.
    Of several lines the last that reaches a column counts, of lone marks the first.
    """
    marks = cols.select(*BLOCK, F.col("col").alias("mark_col"), F.col("calendar").alias("at_date"), F.inline("marks"))
    alone = Window.partitionBy(*BLOCK, "row")
    marks = marks.withColumn("lone", (F.count(F.lit(1)).over(alone) == 1) & ~F.col("at_date"))
    lines = marks.select(*BLOCK, "row").distinct()
    spots = cols.select(*BLOCK, "col").join(lines, BLOCK)
    here = marks.select(*BLOCK, "row", F.col("mark_col").alias("col"), F.struct("mark_col", "at_date", F.col("role").alias("role")).alias("mark"))
    upto = Window.partitionBy(*BLOCK, "row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    spots = spots.join(here, [*BLOCK, "row", "col"], "left").withColumn("mark", F.last("mark", True).over(upto))
    reached = spots.where((F.col("mark.mark_col") == F.col("col")) | ~F.col("mark.at_date")).groupBy(*BLOCK, "col").agg(F.max_by("mark.role", "row").alias("reached"))
    lone = marks.where("lone").groupBy(*BLOCK).agg(F.min_by("role", "row").alias("everywhere"))
    return cols.join(reached, [*BLOCK, "col"], "left").join(lone, BLOCK, "left").withColumn("marked", F.coalesce("reached", "everywhere")).drop("marks", "reached", "everywhere")


def parents(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, row, indent, ...) with parent_row: the nearest row above in its group of keys with a smaller indent."""

    def climb(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        open_, found = [], []
        for row, indent in zip(table.column("row").to_pylist(), table.column("indent").to_pylist()):
            while open_ and open_[-1][1] >= indent:
                open_.pop()
            found.append(open_[-1][0] if open_ else None)
            open_.append((row, indent))
        return table.drop_columns(["indent"]).append_column("parent_row", pa.array(found, pa.int32()))

    some = rows.select(*keys, F.col("row").cast("int").alias("row"), "indent")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in some.select(*keys, "row").schema)
    return rows.join(some.groupBy(*keys).applyInArrow(climb, f"{kinds}, parent_row int"), [*keys, "row"])


def detect_layout(cells: DataFrame, tasks: int | None = None) -> Layout:
    """Axes and lines of all blocks of all sheets; steps on the way shuffle to ``tasks`` tasks where that is given."""
    c = stage(shown(cells.withColumn("book", F.col("book").cast("string"))), tasks)
    lines = stage(line_classes(c), tasks)
    scanned = stage(bands(lines), tasks)
    axis = composed(c, lines, scanned, tasks)
    grain = axis.groupBy(*BLOCK).agg(infer_grain(F.collect_list("period_key")).alias("grain"))
    axis = axis.join(grain, BLOCK).withColumn("period_key", apply_grain(F.col("period_key"), F.col("grain")))
    timed = F.col("role").isin(*TIMED) & ~F.col("period_key").isin("actual", "plan", "total", "stub")
    real = axis.groupBy(*BLOCK).agg(F.count(F.when(timed, 1)).alias("n")).where("n >= 2").select(*BLOCK)
    name = F.concat("sheet", F.lit("!r"), F.col("header_row").cast("string")).alias("block_id")
    headers = axis.join(real, BLOCK).select(*AT, name, "header_row", "col", "role", "header_text", "period_key")

    body = scanned.join(real, BLOCK).join(lines.select(*AT, "row", "empty", "counter", "word_col", "seen_col"), [*AT, "row"])
    of_block = Window.partitionBy(*BLOCK)
    label_col = F.coalesce(F.min("word_col").over(of_block), F.min("seen_col").over(of_block), F.lit(1))
    body = body.withColumn("label_col", label_col).where("not in_band and not empty and not counter").select(*BLOCK, "row", "label_col")
    labels = c.where("text is not null").select(*AT, "row", F.col("col").alias("label_col"), "text", "hidden")
    rows = body.join(labels, [*AT, "row", "label_col"])
    indent = F.length("text") - F.length(F.regexp_replace("text", r"^[ \t]+", ""))
    strip = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    rows = rows.select(*AT, name, "row", strip.alias("label"), "label_col", indent.alias("indent"), F.col("text").rlike(CHECK_LABEL).alias("check_row"), "hidden")
    return Layout(headers, parents(rows, [*AT, "block_id"]).select(*AT, "block_id", "row", "label", "label_col", "indent", "parent_row", "check_row", "hidden"))
