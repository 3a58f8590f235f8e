"""Fourteen credit-risk controls per book, as window columns and one grouped aggregation over yearly slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .axis import aligned, role_rank

#: Thresholds of the controls.
PLAN_GAP = DROP = 0.10
CLIFF = LIFT = 0.15
MARGIN_DROP = 0.05
LEVERAGE, LEVERAGE_JUMP = 4.0, 1.0
COVERAGE, COVERAGE_HIGH = 1.5, 1.0
DAYS = 15.0
AR_SHARE = 0.3
REPAYMENT_SHARE = 0.30
GROWTH = 0.20

CONTROLS = {
    "F01": ("pnl.revenue",),
    "F02": ("pnl.revenue", "pnl.ebitda"),
    "F03": ("pnl.ebitda",),
    "F04": ("pnl.net_income", "cf.fcf", "cf.cfo"),
    "F05": ("pnl.revenue", "bs.ar"),
    "F06": ("bs.debt", "bs.cash", "pnl.ebitda"),
    "F07": ("pnl.ebitda", "pnl.interest"),
    "F08": ("bs.cash",),
    "F09": ("cf.repayment",),
    "F10": ("pnl.interest",),
    "F11": ("pnl.revenue",),
    "F12": ("pnl.revenue", "cf.fcf"),
    "F13": ("cf.dividends", "cf.fcf"),
    "F14": ("bs.cash",),
}
YEARLY = ("pnl.revenue", "pnl.ebitda", "pnl.net_income", "cf.fcf", "cf.cfo", "pnl.cogs", "bs.ar", "bs.inventory", "bs.ap", "bs.debt", "bs.cash", "pnl.interest", "cf.dividends", "cf.drawdown", "cf.repayment", "cov.dscr", "cov.llcr", "cov.plcr", "covenant.headroom", "fx.rate")
#: Of these at least two must be there for F05.
WORKING_CAPITAL = ("bs.ar", "bs.inventory", "bs.ap")
MONTHLY = ("bs.cash", "cf.repayment", "cf.drawdown")


def _slots() -> WindowSpec:
    return Window.partitionBy("book").orderBy("period_key")


def _before() -> WindowSpec:
    return _slots().rowsBetween(Window.unboundedPreceding, -1)


def _first(hit: Column, metric: Column) -> Column:
    """The first slot where hit holds: (period_key, metric)."""
    return F.min(F.when(hit, F.struct("period_key", metric.alias("metric"))))


def _last_known(c: Column) -> Column:
    return F.last(c, ignorenulls=True).over(_before())


def yearly_flags(yearly: DataFrame) -> DataFrame:
    """book and a struct (period_key, metric) for each control, null where it isn't flagged."""
    w = aligned(yearly, list(YEARLY))
    # a period may have a plan and a fact: they are held against each other, and the fact counts for all else
    period = Window.partitionBy("book", "period_key")
    of_role = lambda role: F.max(F.when(F.col("role") == role, F.col("pnl_revenue"))).over(period)
    w = w.select("*", (F.try_divide(of_role("forecast"), of_role("historical")) - 1).alias("gap"), F.row_number().over(period.orderBy(role_rank(F.col("role")), "role")).alias("nth")).where("nth = 1")
    r, e = F.col("pnl_revenue"), F.col("pnl_ebitda")
    forecast, lag = F.col("role") == "forecast", lambda c: F.lag(c).over(_slots())
    w = w.withColumn("prev_role", lag("role")).withColumn("yoy", F.try_divide(r, lag("pnl_revenue")) - 1)
    w = w.withColumn("prev_yoy", _last_known(F.col("yoy"))).withColumn("e0", lag("pnl_ebitda")).withColumn("m", F.try_divide(e, r))
    w = w.withColumn("m0", lag("m")).withColumn("e_yoy", F.when(F.col("e0") != 0, e / F.col("e0") - 1))
    for days, stock, flow in (("dso", "bs_ar", r), ("dio", "bs_inventory", F.col("pnl_cogs")), ("dpo", "bs_ap", F.col("pnl_cogs"))):
        w = w.withColumn(days, F.try_divide(F.col(stock), flow) * 365)
        w = w.withColumn(f"{days}_lift", F.col(days) - F.last(F.when(F.col("role") == "historical", F.col(days)), ignorenulls=True).over(_before()))
    w = w.withColumn("ar_up", F.col("bs_ar") - lag("bs_ar")).withColumn("r_up", r - lag("pnl_revenue"))
    w = w.withColumn("leverage", F.when(e > 0, (F.col("bs_debt") - F.coalesce("bs_cash", F.lit(0.0))) / e)).withColumn("leverage0", _last_known(F.col("leverage")))
    w = w.withColumn("icr", F.try_divide(e, F.abs("pnl_interest"))).withColumn("fcf0", lag("cf_fcf")).withColumn("cfo0", lag("cf_cfo"))
    drop, cliff = F.col("yoy") <= -DROP, (F.col("prev_role") == "historical") & (F.abs(F.col("yoy") - F.col("prev_yoy")) >= CLIFF)
    e_drop, m_drop = F.col("e_yoy") <= -DROP, F.col("m0") - F.col("m") >= MARGIN_DROP
    coverage = F.least("cov_dscr", "cov_llcr", "cov_plcr")
    lifted = F.greatest("dso_lift", "dio_lift", "dpo_lift")
    red = forecast & (F.col("pnl_net_income") >= 0) & (F.col("cf_fcf") < 0)
    apart = (F.col("cf_cfo") > F.col("cfo0")) & (F.col("cf_fcf") < F.col("fcf0"))
    ends = lambda f, c: f(F.when(forecast, F.struct("period_key", F.col(c).alias("v"))))["v"]
    g = w.groupBy("book").agg(
        _first(F.abs("gap") >= PLAN_GAP, F.col("gap")).alias("plan"),
        _first(forecast & (drop | cliff), F.col("yoy")).alias("fall"),
        _first(forecast & (e_drop | m_drop), F.when(e_drop, F.col("e_yoy")).otherwise(F.col("m0") - F.col("m"))).alias("F02"),
        _first(forecast & (F.col("prev_role") == "forecast") & (e < 0) & (F.col("e0") < 0), e).alias("F03"),
        F.count_if(red).alias("reds"),
        _first(red, F.col("cf_fcf")).alias("red"),
        _first(apart, F.col("cf_fcf")).alias("apart"),
        _first(forecast & (lifted >= DAYS), lifted).alias("days"),
        _first((F.col("r_up") > 0) & (F.col("ar_up") > F.col("r_up") * AR_SHARE), F.col("ar_up") / F.col("r_up")).alias("ar"),
        _first((F.col("leverage") >= LEVERAGE) | (F.col("leverage") - F.col("leverage0") >= LEVERAGE_JUMP), F.col("leverage")).alias("F06"),
        F.min(F.when(F.col("icr").isNotNull(), F.struct("icr", "period_key"))).alias("icr"),
        F.min(F.when(coverage.isNotNull(), F.struct(coverage.alias("least"), "period_key"))).alias("cover"),
        F.max(F.when(F.col("has_fx_rate"), F.col("period_key"))).alias("fx"),
        (F.avg(F.when(forecast, F.col("yoy"))) - F.avg(F.when(F.col("role") == "historical", F.col("yoy")))).alias("lift"),
        ends(F.min, "pnl_revenue").alias("r_first"),
        ends(F.max, "pnl_revenue").alias("r_last"),
        ends(F.min, "cf_fcf").alias("f_first"),
        ends(F.max, "cf_fcf").alias("f_last"),
        F.max(F.when(forecast, F.struct("period_key", F.col("fcf0").alias("v"))))["v"].alias("f_last0"),
        F.count_if(forecast).alias("n_forecast"),
        F.max(F.when(forecast, F.col("period_key"))).alias("end"),
        _first((F.col("cf_dividends") > 0) & (F.col("cf_fcf") < 0), F.coalesce(F.col("cf_drawdown") - F.col("cf_repayment"), F.lit(0.0))).alias("F13"),
        F.min(F.when(F.col("covenant_headroom").isNotNull(), F.struct("covenant_headroom", "period_key"))).alias("headroom"),
    )
    s = lambda key, metric: F.struct(key.alias("period_key"), metric.alias("metric"))
    r_up = F.try_divide(F.col("r_last"), F.col("r_first")) - 1
    f_up = F.when(F.col("f_first") != 0, (F.col("f_last") - F.col("f_first")) / F.abs("f_first"))
    turns = (F.col("f_first") >= 0) & (F.col("f_last") < 0) & (F.col("f_last0") < 0)
    return g.select(
        "book", F.coalesce("plan", "fall").alias("F01"), "F02", "F03",
        F.when(F.col("reds") >= 2, F.col("red")).otherwise(F.col("apart")).alias("F04"),
        F.coalesce("days", "ar").alias("F05"), "F06",
        F.when(F.col("cover.least") < COVERAGE_HIGH, s(F.col("cover.period_key"), F.col("cover.least"))).when(F.col("icr.icr") < COVERAGE, s(F.col("icr.period_key"), F.col("icr.icr"))).alias("F07"),
        F.when(F.col("lift") >= LIFT, s(F.col("end"), F.col("lift"))).alias("F11"),
        F.when((F.col("n_forecast") >= 2) & (r_up >= GROWTH) & ((f_up <= -GROWTH) | turns), s(F.col("end"), r_up)).alias("F12"), "F13",
        F.when(F.col("headroom.covenant_headroom") <= 0, s(F.col("headroom.period_key"), F.col("headroom.covenant_headroom"))).alias("F14"),
        F.col("fx").isNotNull().alias("has_fx"), (F.col("headroom").isNotNull()).alias("has_headroom"),
    )


def monthly_flags(monthly: DataFrame) -> DataFrame:
    """book, F08 (first month without cash, months before it) and F09 (year of the greatest repayments, its share)."""
    w = aligned(monthly, list(MONTHLY))
    w = w.withColumn("nth", F.count("bs_cash").over(_before()))
    pay = F.when((F.col("role") == "forecast") & (F.col("cf_repayment") > 0), F.col("cf_repayment"))
    years = w.groupBy("book", F.col("period_key").substr(1, 4).alias("year")).agg(
        F.sum(pay).alias("paid"), F.min(F.when(F.col("bs_cash") < 0, F.struct("period_key", F.col("nth").cast("double").alias("metric")))).alias("dry"),
        F.min("bs_cash").alias("least"), F.max("bs_cash").alias("most"), F.sum("bs_cash").alias("cash"), F.count("bs_cash").alias("n"), F.sum("cf_drawdown").alias("drawn"),
    )
    g = years.groupBy("book").agg(F.min("dry").alias("dry"), F.max(F.when(F.col("paid") > 0, F.struct("paid", (-F.col("year").cast("int")).alias("y")))).alias("top"), F.sum("paid").alias("paid"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("cash").alias("cash"), F.sum("n").alias("n"), F.sum("drawn").alias("drawn"))
    flat = F.col("most") - F.col("least") <= F.greatest(F.lit(1.0), 0.01 * F.abs(F.col("cash") / F.col("n")))
    share = F.col("top.paid") / F.col("paid")
    return g.select("book", F.coalesce(F.col("dry"), F.when(flat & (F.col("drawn") > 0), F.struct(F.lit("").alias("period_key"), F.col("drawn").alias("metric")))).alias("F08"), F.when(share >= REPAYMENT_SHARE, F.struct((-F.col("top.y")).cast("string").alias("period_key"), share.alias("metric"))).alias("F09"))


def frs_matrix(yearly: DataFrame, monthly: DataFrame) -> DataFrame:
    """Always one row per book and control: book, control_id, status, period_key, metric (rounded to 6 places).

    status: flagged, clear, insufficient (what would tell is not mapped) or not_applicable (a needed concept is not mapped).
    """
    # a line of months only is there as well
    have = yearly.select("book", "concept").unionByName(monthly.select("book", "concept")).groupBy("book").agg(F.collect_set("concept").alias("have"))
    flags = yearly_flags(yearly).join(monthly_flags(monthly), "book", "full").join(have, "book", "left")
    rows = []
    for control, needs in CONTROLS.items():
        known = F.coalesce("have", F.array().cast("array<string>"))
        missing = F.size(F.array_except(F.array(*map(F.lit, needs)), known)) > 0
        if control == "F05":
            missing = missing | (F.size(F.array_intersect(F.array(*map(F.lit, WORKING_CAPITAL)), known)) < 2)
        flag = F.lit(None).cast("struct<period_key:string,metric:double>") if control == "F10" else F.col(control)
        lacks = {"F10": ~F.coalesce("has_fx", F.lit(False)), "F14": ~F.coalesce("has_headroom", F.lit(False))}.get(control, F.lit(False))
        status = F.when(missing, "not_applicable").when(lacks, "insufficient").when(flag.isNotNull(), "flagged").otherwise("clear")
        show = ~missing & flag.isNotNull()
        rows.append(F.struct(F.lit(control).alias("control_id"), status.alias("status"), F.when(show, flag["period_key"]).alias("period_key"), F.when(show, F.round(flag["metric"], 6)).alias("metric")))
    return flags.select("book", F.inline(F.array(*rows)))


def frs_candidates(matrix: DataFrame) -> DataFrame:
    """Flagged controls as risk candidates."""
    return matrix.where("status = 'flagged'").select("book", F.concat(F.lit("frs."), "control_id").alias("detector"), F.lit("risk").alias("severity"), "period_key", "metric")
