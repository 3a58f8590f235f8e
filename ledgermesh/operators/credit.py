"""Credit controls with all that a report shows of them: level, confidence, cause, figures and cells.

``frs.frs_matrix`` tells of all fourteen controls whether they are flagged.  Here
losses (F03), cash behind profit (F04), liquidity (F08), dividends (F13) and
headroom (F14) are worked out in full from facts of any grain: amounts of years
come with the cells they are made of, and each control is one grouped aggregation
over its slots, with the slot before from a window.

facts: book, concept, period_key, role, value, and ref (the cell) where known; a
line for each concept of a book.  Results: book, control_id, status, confidence,
class_name, priority and cause (of flagged ones), period_keys, metrics, cell_refs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .axis import column_of
from .rollup import year_lines
from .staging import stage

#: Share of the mean that flat cash keeps to, the classes of controls, and the causes of F04 in their order.
CASH_FLAT = 0.01
CLASSES = {"F03": "assumptions", "F04": "cash_conversion", "F08": "liquidity", "F13": "dividend_policy", "F14": "leverage"}
CAUSES = ("ops", "wc_ar", "wc_ap", "capex", "dividends")
#: What a broken identity does to the confidence of controls, and the order of confidence.
CAPPED_BY = {"I1": ("F06", "F08"), "I3a": ("F04", "F08"), "I3b": ("F13",), "I13": ("F13",)}
CONFIDENCE = ("low", "medium", "high")
YEARLY = ("pnl.ebitda", "pnl.net_income", "pnl.interest", "cf.fcf", "cf.cfo", "cf.capex", "cf.dividends", "cf.drawdown", "cf.repayment", "bs.ar", "bs.ap", "bs.debt", "bs.cash")
NEEDS = {"F03": "pnl.ebitda", "F04": "pnl.net_income", "F08": "bs.cash", "F13": "cf.dividends", "F14": "bs.cash"}
RESULT = ("book", "control_id", "status", "confidence", "class_name", "priority", "cause", "period_keys", "metrics", "cell_refs")


def _years(facts: DataFrame) -> DataFrame:
    """A row for each book and year with a struct (kind, role, value, refs) for each concept, null where the year is no slot of its line, and has_ flags for the book."""
    lines = year_lines(facts.where(F.col("concept").isin(*YEARLY)))
    # months make years only where a line has no years of another kind
    other = F.max((F.col("kind") != "m").cast("int")).over(Window.partitionBy("book", "concept")) == 1
    lines = lines.withColumn("other", other).where("kind <> 'm' or not other")
    of = lambda c: F.max(F.when(F.col("concept") == c, F.struct("kind", "role", "value", "refs"))).alias(column_of(c))
    wide = lines.groupBy("book", "period_key").agg(*[of(c) for c in YEARLY])
    book = Window.partitionBy("book")
    return wide.select("*", *[F.max(F.col(column_of(c)).isNotNull()).over(book).alias(f"has_{column_of(c)}") for c in YEARLY])


def _refs(*lines: Column) -> Column:
    return F.concat(*[F.coalesce(x["refs"], F.array().cast("array<string>")) for x in lines])


def _first_ref(line: Column) -> Column:
    return F.slice(F.coalesce(line["refs"], F.array().cast("array<string>")), 1, 1)


def _joined(lists: Column) -> Column:
    """The distinct references of a list of (period_key, refs), in their order."""
    return F.array_distinct(F.flatten(F.transform(F.array_sort(lists), lambda x: x["refs"])))


def _result(grouped: DataFrame, control: str, flagged: Column, refs: Column, metrics: dict[str, Column], keys: Column | None = None, priority: Column | str = "medium", confidence: Column | str = "high", cause: Column | str = "", insufficient: Column | None = None, monthly: Column | None = None) -> DataFrame:
    """RESULT of one control from a row a book."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    lacks = F.lit(False) if insufficient is None else F.coalesce(insufficient, F.lit(False))
    hit = F.coalesce(flagged, F.lit(False)) & ~lacks
    known = F.map_filter(F.create_map(*[x for k, v in metrics.items() for x in (F.lit(k), v.cast("double"))]), lambda _, v: v.isNotNull())
    sure = lit(confidence) if monthly is None else F.when(F.coalesce(monthly, F.lit(False)) & (lit(confidence) == "high"), "medium").otherwise(lit(confidence))
    none = F.array().cast("array<string>")
    return grouped.select(
        "book", F.lit(control).alias("control_id"), F.when(lacks, "insufficient").when(hit, "flagged").otherwise("clear").alias("status"), F.when(~lacks, sure).alias("confidence"), F.lit(CLASSES[control]).alias("class_name"),
        F.when(hit, lit(priority)).alias("priority"), F.when(hit, lit(cause)).otherwise("").alias("cause"), F.coalesce(keys if keys is not None else none, none).alias("period_keys"), known.alias("metrics"), F.when(hit, F.coalesce(refs, none)).otherwise(none).alias("cell_refs"),
    )


def losses(years: DataFrame) -> DataFrame:
    """two forecast years in a row with a negative EBITDA, or net income where a book has no line of it."""
    y = years.withColumn("line", F.when(F.col("has_pnl_ebitda"), F.col("pnl_ebitda")).otherwise(F.col("pnl_net_income"))).where("line is not null")
    red = F.coalesce((F.col("line.role") == "forecast") & (F.col("line.value") < 0), F.lit(False))
    slots = Window.partitionBy("book").orderBy("period_key")
    y = y.withColumn("red", red).withColumn("now", F.struct("period_key", F.col("line.refs").alias("refs"))).withColumns({"red0": F.lag("red").over(slots), "then": F.lag("now").over(slots)})
    g = y.groupBy("book").agg(F.min(F.when(F.col("red") & F.col("red0"), F.struct(F.col("period_key").alias("key"), F.array("then", "now").alias("run")))).alias("hit"), F.bool_and(F.col("line.kind") == "m").alias("monthly"))
    keys = F.when(F.col("hit").isNotNull(), F.transform(F.col("hit.run"), lambda x: x["period_key"]))
    return _result(g, "F03", F.col("hit").isNotNull(), _joined(F.col("hit.run")), {}, keys, monthly=F.col("monthly"))


def _with_fcf(years: DataFrame) -> DataFrame:
    """years with fcf (value, refs) and fcf_source: the line itself, or cash from operations and investments together."""
    both = F.struct((F.col("cf_cfo.value") + F.col("cf_capex.value")).alias("value"), _refs(F.col("cf_cfo"), F.col("cf_capex")).alias("refs"))
    derived = F.when(F.col("cf_cfo.value").isNotNull() & F.col("cf_capex.value").isNotNull(), both)
    mapped = F.when(F.col("cf_fcf").isNotNull(), F.struct(F.col("cf_fcf.value").alias("value"), F.col("cf_fcf.refs").alias("refs")))
    source = F.when(F.col("has_cf_fcf"), "mapped").when(F.col("has_cf_cfo") & F.col("has_cf_capex"), "derived").otherwise("missing")
    return years.withColumn("fcf_source", source).withColumn("fcf", F.when(source == "mapped", mapped).when(source == "derived", derived))


def cash_behind_profit(years: DataFrame) -> DataFrame:
    """profit without cash in two forecast years, or operating cash up while free cash goes down; the cause is the strongest of five sums over these years."""
    y = _with_fcf(years).where("pnl_net_income is not null")
    slots = Window.partitionBy("book").orderBy("period_key")
    ni, cfo, fcf = F.col("pnl_net_income.value"), F.col("cf_cfo.value"), F.col("fcf.value")
    red = F.coalesce((F.col("pnl_net_income.role") == "forecast") & (ni >= 0) & (fcf < 0), F.lit(False))
    apart = F.coalesce((cfo > F.lag(cfo).over(slots)) & (fcf < F.lag(fcf).over(slots)), F.lit(False))
    grown = lambda c: F.greatest(F.lit(0.0), F.col(f"{c}.value") - F.lag(F.col(f"{c}.value")).over(slots))
    refs = F.struct("period_key", F.concat(_refs(F.col("pnl_net_income")), F.coalesce(F.col("fcf.refs"), F.array().cast("array<string>")), _first_ref(F.col("cf_cfo"))).alias("refs"))
    y = y.select(
        "book", "period_key", "fcf_source", "has_cf_cfo", red.alias("red"), apart.alias("apart"), refs.alias("refs"), ni.alias("ni"), cfo.alias("cfo"), fcf.alias("fcf"), F.col("pnl_net_income.kind").alias("kind"),
        F.greatest(F.lit(0.0), ni - cfo).alias("ops"), grown("bs_ar").alias("wc_ar"), grown("bs_ap").alias("wc_ap"), F.greatest(F.lit(0.0), -F.col("cf_capex.value")).alias("capex"), F.greatest(F.lit(0.0), F.col("cf_dividends.value")).alias("dividends"),
    )
    point = F.struct("period_key", "ni", F.when(F.col("has_cf_cfo"), F.col("cfo")).alias("cfo"), "fcf")
    scores = [F.struct(F.coalesce(F.sum(F.when(F.col("red"), F.col(c))), F.lit(0.0)).alias("of_red"), F.coalesce(F.sum(c), F.lit(0.0)).alias("of_all")).alias(f"s_{c}") for c in CAUSES]
    g = y.groupBy("book").agg(
        F.first("fcf_source").alias("fcf_source"), F.count_if("red").alias("n"), F.array_sort(F.collect_list(F.when(F.col("red"), F.col("period_key")))).alias("keys"), F.collect_list(F.when(F.col("red"), F.col("refs"))).alias("red_refs"),
        F.min(F.when(F.col("apart"), F.col("refs"))).alias("apart"), F.min(F.when(F.col("red"), point)).alias("first"), F.max(point).alias("last"), F.bool_and(F.col("kind") == "m").alias("monthly"), *scores,
    )
    of = lambda c: F.when(F.col("n") > 0, F.col(f"s_{c}.of_red")).otherwise(F.col(f"s_{c}.of_all"))
    # of equal sums the first counts, and operations where there are none
    strongest = F.array_max(F.array(*[F.struct(of(c).alias("sum"), F.lit(-i).alias("place"), F.lit(c).alias("cause")) for i, c in enumerate(CAUSES)]))
    at = F.coalesce("first", "last")
    more = F.when(F.col("apart").isNotNull(), F.array("apart")).otherwise(F.array().cast("array<struct<period_key:string,refs:array<string>>>"))
    cells = F.array_distinct(F.concat(_joined(F.col("red_refs")), _joined(more)))
    metrics = {"ni": at["ni"], "cfo": at["cfo"], "accruals": at["ni"] - at["cfo"], "fcf": at["fcf"]}
    sure = F.when(F.col("fcf_source") == "derived", "medium").otherwise("high")
    return _result(g, "F04", (F.col("n") >= 2) | F.col("apart").isNotNull(), cells, metrics, F.col("keys"), confidence=sure, cause=strongest["cause"], insufficient=F.col("fcf_source") == "missing", monthly=F.col("monthly"))


def liquidity(facts: DataFrame) -> DataFrame:
    """months without cash and how long it lasts, or cash that stays flat by drawing debt."""
    ref = (F.col("ref") if "ref" in facts.columns else F.lit(None)).cast("string")
    m = facts.where(F.col("concept").isin("bs.cash", "cf.drawdown") & F.col("period_key").rlike(r"^\d{4}-\d\d$")).select("book", "concept", "period_key", "value", ref.alias("ref"))
    of = lambda c: F.max(F.when(F.col("concept") == c, F.struct("value", "ref")))
    w = m.groupBy("book", "period_key").agg(of("bs.cash").alias("cash"), of("cf.drawdown").alias("draw")).where("cash.value is not null")
    # whole years first, so that no book's months meet in one task
    w = w.withColumn("nth", F.row_number().over(Window.partitionBy("book").orderBy("period_key")) - 1)
    dry, drawn = F.col("cash.value") < 0, F.coalesce(F.col("draw.value") > 0, F.lit(False))
    cell = lambda c: F.struct("period_key", F.filter(F.array(f"{c}.ref"), lambda x: x.isNotNull()).alias("refs"))
    g = w.groupBy("book").agg(
        F.min(F.struct(F.col("cash.value").alias("v"), "period_key", F.col("cash.ref").alias("ref"))).alias("least"), F.max("cash.value").alias("most"), F.avg("cash.value").alias("mean"), F.min(F.when(dry, F.col("nth"))).alias("runway"),
        F.collect_list(F.when(dry, cell("cash"))).alias("dry"), F.collect_list(cell("cash")).alias("all"), F.collect_list(F.when(drawn, cell("draw"))).alias("drawn"),
    )
    plug = (F.col("most") - F.col("least.v") <= F.greatest(F.lit(1.0), CASH_FLAT * F.abs("mean"))) & (F.size("drawn") > 0)
    runs_dry = F.size("dry") > 0
    cells = F.when(runs_dry, _joined(F.col("dry"))).otherwise(F.array_distinct(F.concat(_joined(F.col("all")), _joined(F.col("drawn")))))
    metrics = {"min_cash": F.col("least.v"), "runway": F.col("runway"), "cash_plug": plug.cast("int")}
    return _result(g, "F08", runs_dry | plug, cells, metrics, F.array("least.period_key"), F.when(runs_dry, "high").otherwise("medium"), cause=F.when(runs_dry, "").otherwise("cash_plug"))


def dividends(years: DataFrame) -> DataFrame:
    """the first year that pays dividends out of a negative free cash flow; high where debt grows for it."""
    y = _with_fcf(years).where("cf_dividends is not null")
    draw, repay = F.col("cf_drawdown"), F.col("cf_repayment")
    net = F.when(draw["value"].isNotNull() | repay["value"].isNotNull(), F.coalesce(draw["value"], F.lit(0.0)) - F.coalesce(repay["value"], F.lit(0.0)))
    hit = (F.col("cf_dividends.value") > 0) & (F.col("fcf.value") < 0)
    refs = F.array_distinct(F.concat(_refs(F.col("cf_dividends"), F.col("fcf")), _first_ref(draw), _first_ref(repay)))
    g = y.groupBy("book").agg(F.first("fcf_source").alias("source"), F.min(F.when(hit, F.struct("period_key", F.col("fcf.value").alias("fcff"), net.alias("net"), refs.alias("refs")))).alias("hit"), F.bool_and(F.col("cf_dividends.kind") == "m").alias("monthly"))
    metrics = {"fcff": F.col("hit.fcff"), "fcfe": F.col("hit.fcff") + F.col("hit.net")}
    return _result(g, "F13", F.col("hit").isNotNull(), F.col("hit.refs"), metrics, F.when(F.col("hit").isNotNull(), F.array("hit.period_key")), F.when(F.col("hit.net") > 0, "high").otherwise("medium"), insufficient=F.col("source") == "missing", monthly=F.col("monthly"))


def headroom(facts: DataFrame, years: DataFrame) -> DataFrame:
    """covenant headroom at or below zero, months before years; with the least cash, the greatest net debt to EBITDA and the least coverage of interest."""
    ref = (F.col("ref") if "ref" in facts.columns else F.lit(None)).cast("string")
    some = facts.where(F.col("concept").isin("bs.cash", "covenant.headroom") & F.col("period_key").rlike(r"^\d{4}(-\d\d)?$"))
    some = some.select("book", "concept", "period_key", "value", ref.alias("ref"), F.contains("period_key", F.lit("-")).alias("month"))
    own = some.withColumn("months", F.max("month").over(Window.partitionBy("book", "concept"))).where("month = months and value is not null")
    cash, room = F.col("concept") == "bs.cash", F.col("concept") == "covenant.headroom"
    point = F.struct(F.col("value").alias("v"), "period_key")
    g = own.groupBy("book").agg(F.min(F.when(cash, F.col("value"))).alias("cash"), F.min(F.when(room, point)).alias("room"), F.collect_list(F.when(room & (F.col("value") <= 0), F.struct("period_key", F.filter(F.array("ref"), lambda x: x.isNotNull()).alias("refs")))).alias("below"))
    e = F.col("pnl_ebitda.value")
    leverage = F.when((e > 0) & F.col("bs_debt.value").isNotNull(), (F.col("bs_debt.value") - F.coalesce(F.col("bs_cash.value"), F.lit(0.0))) / e)
    y = years.groupBy("book").agg(F.max(leverage).alias("nd_ebitda"), F.min(F.try_divide(e, F.abs(F.col("pnl_interest.value")))).alias("icr"), F.bool_and(F.when(F.col("bs_cash").isNotNull(), F.col("bs_cash.kind") == "m")).alias("monthly"))
    both = g.join(y, "book", "left")
    metrics = {"min_cash": F.col("cash"), "nd_ebitda": F.col("nd_ebitda"), "icr": F.col("icr"), "min_headroom": F.col("room.v")}
    return _result(both, "F14", F.col("room.v") <= 0, _joined(F.col("below")), metrics, F.when(F.col("room").isNotNull(), F.array("room.period_key")), "high", insufficient=F.col("room").isNull(), monthly=F.col("monthly"))


def _capped(results: DataFrame, broken: DataFrame) -> DataFrame:
    """results with low confidence where an identity that a control rests on is broken; broken: book, identity_id."""
    pairs = F.array(*[F.struct(F.lit(i).alias("identity_id"), F.lit(c).alias("control_id")) for i, controls in CAPPED_BY.items() for c in controls])
    named = results.sparkSession.range(1).select(F.inline(pairs))
    hit = broken.select("book", "identity_id").distinct().join(F.broadcast(named), "identity_id").select("book", "control_id").distinct().withColumn("capped", F.lit(True))
    out = results.join(hit, ["book", "control_id"], "left")
    return out.withColumn("confidence", F.when(F.col("capped") & F.col("confidence").isNotNull(), "low").otherwise(F.col("confidence"))).select(*RESULT)


def controls_in_full(facts: DataFrame, broken: DataFrame | None = None) -> DataFrame:
    """RESULT of the five controls for every book; not_applicable where the line that a control is about isn't there."""
    facts = stage(facts)
    years = stage(_years(facts))
    parts: list[Callable[[], DataFrame]] = [lambda: losses(years), lambda: cash_behind_profit(years), lambda: liquidity(facts), lambda: dividends(years), lambda: headroom(facts, years)]
    found = parts[0]()
    for p in parts[1:]:
        found = found.unionByName(p())
    have = facts.groupBy("book").agg(F.collect_set("concept").alias("have"))
    needs = F.array(*[F.struct(F.lit(c).alias("control_id"), F.lit(n).alias("need"), F.lit(CLASSES[c]).alias("class_name")) for c, n in NEEDS.items()])
    every = have.select("book", "have", F.inline(needs)).withColumn("there", F.array_contains("have", F.col("need")))
    # a line without a slot of the right grain tells too little
    out = every.join(found.drop("class_name"), ["book", "control_id"], "left")
    none = F.array().cast("array<string>")
    out = out.select(
        "book", "control_id", F.when(~F.col("there"), "not_applicable").otherwise(F.coalesce("status", F.lit("insufficient"))).alias("status"), F.when(F.col("there"), F.col("confidence")).alias("confidence"), "class_name",
        F.when(F.col("there"), F.col("priority")).alias("priority"), F.when(F.col("there"), F.coalesce("cause", F.lit(""))).otherwise("").alias("cause"), F.when(F.col("there"), F.coalesce("period_keys", none)).otherwise(none).alias("period_keys"),
        F.when(F.col("there"), F.coalesce("metrics", F.create_map().cast("map<string,double>"))).otherwise(F.create_map().cast("map<string,double>")).alias("metrics"), F.when(F.col("there"), F.coalesce("cell_refs", none)).otherwise(none).alias("cell_refs"),
    )
    return out if broken is None else _capped(out, broken)
