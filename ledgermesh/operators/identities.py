"""Accounting identities over aligned facts: one aggregation, one window and one explode for all of them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import tolerance
from .axis import PERIODS, SNAPSHOTS, axes, column_of


@dataclass(frozen=True)
class Identity:
    """got = want within max(1, 0.1 % of the base amounts).

    needs: concepts that a block, or else the book, must have; slots: those whose
    common periods are looked at (by default the needed ones); flows: optional
    lines (absent, or the period not on their axis: 0; without a number there:
    the period is skipped); joined: optional lines that narrow the slots where
    they exist; stocks: optional balances whose change counts (absent: 0; either
    period not on their axis or without a number: skipped); some: at least one of
    these must exist; unless: concepts of which the book may have none.
    Expressions name concepts with underscores, the previous slot as
    prev_<concept> and changes as change_<concept>.  Identities that look back
    leave scenarios out.
    """

    id: str
    needs: tuple[str, ...]
    got: str
    want: str
    base: tuple[str, ...]
    flows: tuple[str, ...] = ()
    lagged: tuple[str, ...] = ()
    monthly_rate: bool = False
    slots: tuple[str, ...] = ()
    joined: tuple[str, ...] = ()
    stocks: tuple[str, ...] = ()
    some: tuple[str, ...] = ()
    unless: tuple[str, ...] = ()
    instead_of: str = ""

    @property
    def view(self) -> str:
        return "roll" if self.lagged or self.stocks else "snap"

    @property
    def lines(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*self.needs, *self.flows, *self.joined, *self.stocks)))


#: What finances: with one of these in the book, cash can't be derived from operating cash and investment alone.
FINANCING = ("cf.drawdown", "cf.repayment", "cf.dividends", "cf.equity_issue")
IDENTITIES = (
    Identity("I1", ("bs.assets_total", "bs.equity", "bs.liabilities"), "bs_assets_total", "bs_equity + bs_liabilities", ("bs_assets_total",)),
    Identity("I3a", ("bs.cash", "cf.fcf"), "bs_cash", "prev_bs_cash + cf_fcf + fx_cash", ("prev_bs_cash", "bs_cash"), lagged=("bs.cash",), joined=("fx.cash",)),
    Identity("I3a", ("bs.cash", "cf.cfo", "cf.capex"), "bs_cash", "prev_bs_cash + cf_cfo + cf_capex + fx_cash", ("prev_bs_cash", "bs_cash"), lagged=("bs.cash",), joined=("fx.cash",), unless=FINANCING, instead_of="cf.fcf"),
    Identity("I3b", ("bs.retained_earnings", "pnl.net_income"), "bs_retained_earnings", "prev_bs_retained_earnings + pnl_net_income - cf_dividends + bs_re_adj", ("prev_bs_retained_earnings", "bs_retained_earnings"), ("cf.dividends", "bs.re_adj"), ("bs.retained_earnings",)),
    Identity("I4", ("pnl.revenue", "pnl.volume", "pnl.price"), "abs(pnl_revenue)", "abs(pnl_volume) * abs(pnl_price)", ("pnl_revenue", "abs(pnl_volume) * abs(pnl_price)")),
    Identity("I5", ("pnl.gross_profit", "pnl.revenue", "pnl.cogs"), "pnl_gross_profit", "pnl_revenue - pnl_cogs", ("pnl_gross_profit", "pnl_revenue")),
    Identity("I6", ("pnl.ebitda", "pnl.revenue", "pnl.cogs", "pnl.opex"), "pnl_ebitda", "pnl_revenue - pnl_cogs - pnl_opex", ("pnl_ebitda", "pnl_revenue")),
    Identity("I7", ("pnl.ebit", "pnl.ebitda", "pnl.da"), "pnl_ebit", "pnl_ebitda - pnl_da", ("pnl_ebit", "pnl_ebitda")),
    Identity("I8", ("pnl.da", "cf.da"), "abs(pnl_da)", "abs(cf_da)", ("pnl_da", "cf_da")),
    Identity("I8b", ("bs.ppe",), "bs_ppe", "prev_bs_ppe + abs(cf_capex) - abs(pnl_da) + fx_ppe", ("prev_bs_ppe", "bs_ppe"), ("cf.capex", "pnl.da", "fx.ppe"), ("bs.ppe",), some=("cf.capex", "pnl.da")),
    Identity("I9", ("pnl.net_income", "cf.cfo"), "cf_cfo", "pnl_net_income + pnl_da - change_bs_ar - change_bs_inventory + change_bs_ap", ("cf_cfo", "pnl_net_income"), ("pnl.da",), stocks=("bs.ar", "bs.inventory", "bs.ap"), some=("pnl.da", "bs.ar", "bs.inventory", "bs.ap")),
    Identity("I10", ("bs.debt",), "bs_debt", "prev_bs_debt + cf_drawdown - cf_repayment + fx_debt", ("prev_bs_debt", "bs_debt"), ("cf.drawdown", "cf.repayment", "fx.debt"), ("bs.debt",), some=("cf.drawdown", "cf.repayment")),
    Identity("I11", ("bs.debt", "pnl.interest", "pnl.interest_rate"), "abs(pnl_interest)", "abs(pnl_interest_rate * (abs(prev_bs_debt) + abs(bs_debt)) / 2e0)", ("pnl_interest", "pnl_interest_rate * (abs(prev_bs_debt) + abs(bs_debt)) / 2e0"), (), ("bs.debt",), True),
    Identity("I12", ("pnl.tax", "pnl.net_income", "pnl.tax_rate"), "abs(pnl_tax + pnl_deferred_tax)", "abs(pnl_tax_rate * (abs(pnl_net_income) + abs(pnl_tax + pnl_deferred_tax)))", ("abs(pnl_tax + pnl_deferred_tax)", "abs(pnl_tax_rate * (abs(pnl_net_income) + abs(pnl_tax + pnl_deferred_tax)))"), ("pnl.deferred_tax",)),
    Identity("I13", ("bs.equity", "pnl.net_income", "cf.dividends"), "bs_equity", "prev_bs_equity + pnl_net_income - cf_dividends + cf_equity_issue + fx_equity", ("prev_bs_equity", "bs_equity"), ("cf.dividends", "cf.equity_issue", "fx.equity"), ("bs.equity",), slots=("bs.equity", "pnl.net_income")),
)
RATES = ("pnl.interest_rate", "pnl.tax_rate")


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _scopes(wide: DataFrame, identities: tuple[Identity, ...], blocks: bool) -> DataFrame:
    """A row per scope and period: each block, and the book as a whole; x_<view> has the lines, fit_<n> tells which identities a scope serves."""
    have = [(lambda where, i=i: _all(F.col(i.view)[where][column_of(c)] for c in i.needs)) for i in identities]
    book = Window.partitionBy("book")
    wide = wide.select("*", *[F.max(h("inside")).over(book).alias(f"served_{n}") for n, h in enumerate(have)])
    views = {i.view: None for i in identities}

    def scope(rows: DataFrame, label: Column, whole: bool) -> DataFrame:
        fits = []
        for n, (i, h) in enumerate(zip(identities, have)):
            fit = ~F.col(f"served_{n}") & h("anywhere") if whole else h("inside")
            if i.some:
                fit = fit & reduce(lambda a, b: a | b, [F.col(i.view)["anywhere"][column_of(c)] for c in i.some])
            for c in i.unless:
                fit = fit & ~F.col(i.view)["anywhere"][column_of(c)]
            if i.instead_of:
                # the identity that this one stands in for serves neither a block nor the book
                other = next(m for m, o in enumerate(identities) if o.id == i.id and i.instead_of in o.needs)
                fit = fit & ~F.col(f"served_{other}") & ~have[other]("anywhere")
            fits.append(fit.alias(f"fit_{n}"))
        lines = []
        for v in views:
            names = rows.schema[v].dataType["own"].dataType.names
            pick = [(F.col(v)["top"][k] if whole else F.when(F.col(v)["inside"][k], F.col(v)["own"][k]).otherwise(F.col(v)["top"][k])).alias(k) for k in names]
            lines += [F.struct(*pick).alias(f"x_{v}"), F.col(v)["anywhere"].alias(f"any_{v}")]
        return rows.select("book", label.alias("scope"), "period_key", *fits, *lines)

    if not blocks:
        return scope(wide, F.lit(""), False)
    first = F.row_number().over(Window.partitionBy("book", "period_key").orderBy("block_id"))
    return scope(wide, F.col("block_id"), False).unionByName(scope(wide.withColumn("nth", first).where("nth = 1"), F.lit(None).cast("string"), True))


def check_identities(facts: DataFrame, identities: tuple[Identity, ...] = IDENTITIES) -> DataFrame:
    """book, identity_id, period_key, got, want, delta, scope of every violated period.

    scope is the block, or null where the lines of the whole book are looked at
    because no block has all of the needed ones.
    """
    blocks = "block_id" in facts.columns
    concepts = lambda v: list(dict.fromkeys(c for i in identities if i.view == v for c in (*i.lines, *i.some, *i.unless)))
    views = {v: (concepts(v), roles) for v, roles in (("snap", SNAPSHOTS), ("roll", PERIODS)) if concepts(v)}
    rate = F.col("concept").isin(*RATES) & (F.abs("value") > 1)
    wide = _scopes(axes(facts.withColumn("value", F.when(rate, F.col("value") / 100).otherwise(F.col("value"))), views), identities, blocks)
    before = Window.partitionBy("book", "scope").orderBy("period_key").rowsBetween(Window.unboundedPreceding, -1)

    def on_axis(i: Identity) -> Column:
        x, known = F.col(f"x_{i.view}"), F.col(f"any_{i.view}")
        narrow = [x[column_of(c)].isNotNull() | ~known[column_of(c)] for c in i.joined]
        return _all([x[column_of(c)].isNotNull() for c in (i.slots or i.needs)] + narrow)

    wide = wide.select("*", *[F.last(F.when(on_axis(i), F.col("x_roll")), ignorenulls=True).over(before).alias(f"was_{n}") for n, i in enumerate(identities) if i.view == "roll"])
    found = []
    for n, i in enumerate(identities):
        x, known = F.col(f"x_{i.view}"), F.col(f"any_{i.view}")
        was = F.col(f"was_{n}") if i.view == "roll" else None
        values, told = {}, [F.col(f"fit_{n}"), on_axis(i)]
        for c in (c for c in (*i.needs, *i.flows, *i.joined) if c not in i.stocks):
            k = column_of(c)
            if c in i.flows or c in i.joined:
                values[k] = F.when(x[k].isNull(), F.lit(0.0)).otherwise(x[k]["v"])
            else:
                values[k] = x[k]["v"]
        for c in i.lagged:
            values[f"prev_{column_of(c)}"] = was[column_of(c)]["v"]
        for c in i.stocks:
            k = column_of(c)
            values[f"change_{k}"] = F.when(~known[k], F.lit(0.0)).otherwise(x[k]["v"] - was[k]["v"])
        if i.stocks:
            told.append(was.isNotNull())
        row = F.struct(*[v.cast("double").alias(k) for k, v in values.items()])
        found.append(F.when(_all(told + [v.isNotNull() for v in values.values()]), row).alias(f"row_{n}"))
    wide = wide.select("book", "scope", "period_key", *found)
    results = []
    for n, i in enumerate(identities):
        fields = set(wide.schema[f"row_{n}"].dataType.names)

        def bound(text: str, n=n, fields=fields) -> Column:
            return F.expr("".join(f"`row_{n}`.{w}" if w in fields else w for w in _words(text)))

        got, want = bound(i.got), bound(i.want)
        base = list(map(bound, i.base))
        if i.monthly_rate:
            year = F.when(F.col("period_key").rlike(r"^\d{4}-\d\d$"), 12.0).otherwise(1.0)
            want, base[-1] = want / year, base[-1] / year
        bad = F.abs(got - want) > tolerance(*base)
        results.append(F.when(bad, F.struct(F.lit(i.id).alias("identity_id"), got.alias("got"), want.alias("want"), (got - want).alias("delta"))))
    found = wide.select("book", "scope", "period_key", F.explode(F.filter(F.array(*results), lambda x: x.isNotNull())).alias("v"))
    return found.select("book", "v.identity_id", "period_key", "v.got", "v.want", "v.delta", "scope")


def _words(text: str) -> list[str]:
    import re

    return re.findall(r"[A-Za-z_]\w*|\d+e\d+|\W|\d+", text)


def identity_sql(i: Identity, wide_sql, known: dict) -> str:
    """The same identity as a join-and-lag SQL query over the statement tables, which have all needed lines in one block."""
    if any(c not in known for c in i.needs) or any(c in known for c in i.unless) or (i.instead_of and i.instead_of in known):
        return "SELECT CAST(0 AS INTEGER) AS book, '' AS identity_id, '' AS period_key, 0e0 AS got, 0e0 AS want, 0e0 AS delta WHERE false"
    present = [c for c in i.lines if c in known]
    absent = {column_of(c) for c in i.lines if c not in known}
    lag = "".join(f", lag({column_of(c)}) OVER (PARTITION BY book ORDER BY period_key) AS prev_{column_of(c)}" for c in i.lagged)
    lag += "".join(f", {column_of(c)} - lag({column_of(c)}) OVER (PARTITION BY book ORDER BY period_key) AS change_{column_of(c)}" for c in i.stocks if c in known)
    zero = lambda t: "".join("0e0" if w in absent else w for w in _words(t))
    base = ", ".join(f"abs({zero(b)})" for b in i.base)
    return f"""WITH {wide_sql(present)}, lagged AS (SELECT *{lag} FROM wide), v AS (SELECT book, period_key, {zero(i.got)} AS got, {zero(i.want)} AS want, greatest({base}) AS size FROM lagged)
    SELECT book, '{i.id}' AS identity_id, period_key, got, want, got - want AS delta FROM v WHERE abs(got - want) > greatest(1e0, size * 1e-3)"""


def cross_sheet(facts: DataFrame) -> DataFrame:
    """Closing balances of one concept on two sheets that differ: book, concept, period_key, sheet pair, values."""
    a, b = facts.alias("a"), facts.alias("b")
    same = (F.col("a.book") == F.col("b.book")) & (F.col("a.concept") == F.col("b.concept")) & (F.col("a.period_key") == F.col("b.period_key")) & (F.col("a.sheet") < F.col("b.sheet"))
    pairs = a.join(b, same)
    bad = F.abs(F.col("a.value") - F.col("b.value")) > tolerance(F.col("a.value"), F.col("b.value"))
    return pairs.where(bad).select("a.book", "a.concept", "a.period_key", F.col("a.sheet").alias("sheet_a"), F.col("b.sheet").alias("sheet_b"), F.col("a.value").alias("value_a"), F.col("b.value").alias("value_b"))


#: What is asked where lines are missing: identity, the lines asked for, and when (lines that must be there, lines of which none may be).
QUESTIONS = (
    ("I1", ("bs.assets_total", "bs.equity", "bs.liabilities"), (), ()),
    ("I3a", ("bs.cash",), (), ()),
    ("I3b", ("bs.retained_earnings", "pnl.net_income"), (), ()),
    ("I13", ("bs.equity",), ("cf.dividends",), ()),
    ("I13", ("pnl.net_income",), ("cf.dividends", "bs.equity"), ()),
    ("I4", ("pnl.price",), ("pnl.revenue", "pnl.volume"), ()),
    ("I4", ("pnl.volume",), ("pnl.revenue", "pnl.price"), ()),
    ("I4", ("pnl.revenue",), ("pnl.volume", "pnl.price"), ()),
    ("I5", ("pnl.gross_profit", "pnl.revenue", "pnl.cogs"), (), ()),
    ("I7", ("pnl.ebit", "pnl.ebitda", "pnl.da"), (), ()),
    ("I9", ("pnl.net_income", "cf.cfo"), (), ()),
    ("I9", ("pnl.da", "bs.ar", "bs.inventory", "bs.ap"), ("pnl.net_income", "cf.cfo"), ("pnl.da", "bs.ar", "bs.inventory", "bs.ap")),
    ("I10", ("bs.debt",), (), ()),
    ("I10", ("cf.drawdown", "cf.repayment"), ("bs.debt",), ("cf.drawdown", "cf.repayment")),
    ("I11", ("pnl.interest", "bs.debt", "pnl.interest_rate"), (), ()),
    ("I12", ("pnl.tax", "pnl.net_income", "pnl.tax_rate"), (), ()),
    ("I8", ("cf.da",), ("pnl.da",), ()),
    ("I8", ("pnl.da",), ("cf.da",), ()),
    ("I8b", ("cf.capex", "pnl.da"), ("bs.ppe",), ("cf.capex", "pnl.da")),
    ("I8b", ("bs.ppe",), ("cf.capex",), ()),
    ("I8b", ("bs.ppe",), ("pnl.da",), ("cf.capex",)),
)


def missing_concepts(facts: DataFrame) -> DataFrame:
    """Identity-gap questions: book, identity_id, missing (the lines asked for that the book lacks)."""
    have = facts.groupBy("book").agg(F.collect_set("concept").alias("have"))
    has = lambda c: F.array_contains("have", c)
    gaps = []
    for name, asked, there, none in QUESTIONS:
        when = _all([has(c) for c in there] + [~has(c) for c in none])
        missing = F.array_except(F.array(*map(F.lit, asked)), "have")
        gaps.append(F.when(when & (F.size(missing) > 0), F.struct(F.lit(name).alias("identity_id"), missing.alias("missing"))))
    out = have.select("book", F.explode(F.filter(F.array(*gaps), lambda g: g.isNotNull())).alias("g"))
    return out.select("book", "g.identity_id", F.array_join(F.array_sort("g.missing"), ",").alias("missing"))
