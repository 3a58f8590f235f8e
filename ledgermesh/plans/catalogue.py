"""All registered queries of the audit engine on the star-schema tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import a1, dates, labels, numeric, periods
from ..operators import credit, detectors, frs, graph, identities, lineage, mapping, messages, report, rollup, series
from . import formula_queries, layout_queries, workbook_queries  # noqa: F401  they register their queries
from . import statements as st
from .registry import ORACLE_SQL, QUERIES, dealt, query  # noqa: F401
from .registry import table as _t

# --- identities

_COLUMNS = ("book", "identity_id", "period_key", "got", "want", "delta")
for _id in dict.fromkeys(i.id for i in identities.IDENTITIES):

    def _identity(spark, sf_dir, id=_id):
        some = tuple(i for i in identities.IDENTITIES if i.id == id)
        concepts = [c for c in st.CONCEPTS if any(c in (*i.lines, *i.some, *i.unless) for i in some)]
        return identities.check_identities(st.facts(spark, sf_dir, concepts), some).select(*_COLUMNS)

    query(" UNION ALL ".join(f"SELECT * FROM ({identities.identity_sql(i, st.wide_sql, st.CONCEPTS)})" for i in identities.IDENTITIES if i.id == _id), f"identity_{_id.lower()}")(_identity)


@query(" UNION ALL ".join(f"SELECT * FROM ({identities.identity_sql(i, st.wide_sql, st.CONCEPTS)})" for i in identities.IDENTITIES))
def identities_all(spark, sf_dir):
    return identities.check_identities(st.facts(spark, sf_dir)).select(*_COLUMNS)


@query(f"""WITH {st.wide_sql(['pnl.revenue'], True)} SELECT book, identity_id, missing FROM (SELECT DISTINCT book FROM wide) CROSS JOIN (VALUES ('I1', 'bs.assets_total,bs.equity,bs.liabilities'), ('I3a', 'bs.cash'),
    ('I3b', 'bs.retained_earnings,pnl.net_income'), ('I5', 'pnl.cogs,pnl.gross_profit'), ('I7', 'pnl.da,pnl.ebit,pnl.ebitda'), ('I9', 'cf.cfo,pnl.net_income'), ('I10', 'bs.debt'), ('I11', 'bs.debt,pnl.interest,pnl.interest_rate'), ('I12', 'pnl.net_income,pnl.tax,pnl.tax_rate')) t(identity_id, missing)""")
def identity_gaps(spark, sf_dir):
    return identities.missing_concepts(st.facts(spark, sf_dir, ["pnl.revenue"]))


def _two_sheets(spark, sf_dir, concepts, factor):
    """Facts on sheets main and copy; the copy of some books is off by a factor."""
    f = st.facts(spark, sf_dir, concepts).withColumn("sheet", F.lit("main"))
    return f.unionByName(f.withColumn("sheet", F.lit("copy")).withColumn("value", F.when(F.expr("book % 4 = 0"), F.col("value") * factor).otherwise(F.col("value"))))


def _sheets_sql(concept, factor, where, cols):
    c = concept.replace(".", "_")
    return f"WITH {st.wide_sql([concept])}, p AS (SELECT book, period_key, CASE WHEN book % 4 = 0 THEN {c} * {factor} ELSE {c} END AS x, {c} AS y FROM wide) SELECT {cols} FROM p WHERE {where}"


@query(_sheets_sql("bs.cash", "11e-1", "abs(x - y) > greatest(1e0, 1e-3 * greatest(abs(x), abs(y)))", "book, 'bs.cash' AS concept, period_key, 'copy' AS sheet_a, 'main' AS sheet_b, x AS value_a, y AS value_b"))
def identity_cross_sheet(spark, sf_dir):
    return identities.cross_sheet(_two_sheets(spark, sf_dir, ["bs.cash"], 1.1))


@query(_sheets_sql("pnl.tax_rate", "11e-1", "abs(x - y) > 1e-6", "book, 'pnl.tax_rate' AS concept, period_key, x, y"))
def detector_conflicting_rate(spark, sf_dir):
    return detectors.conflicting_rates(_two_sheets(spark, sf_dir, ["pnl.tax_rate"], 1.1))


@query(_sheets_sql("pnl.price", "1001e-3", "abs(x - y) > 1e-6", "book, 'fx.rate' AS concept, period_key, x, y"))
def detector_conflicting_fx(spark, sf_dir):
    f = _two_sheets(spark, sf_dir, ["pnl.price"], 1.001)
    return detectors.conflicting_fx(f.withColumn("concept", F.lit("fx.rate")))


@query(_sheets_sql("pnl.opex", "1e3", "y <> 0 AND abs(greatest(abs(x), abs(y)) / least(abs(x), abs(y)) / 1e3 - 1e0) <= 1e-1", "book, 'pnl.opex' AS concept, period_key, x, y, greatest(abs(x), abs(y)) / least(abs(x), abs(y)) AS ratio"))
def detector_scale_mismatch(spark, sf_dir):
    return detectors.scale_mismatches(_two_sheets(spark, sf_dir, ["pnl.opex"], 1000.0), ("pnl.opex",))


# --- detectors on aligned facts


@query(f"WITH {st.wide_sql(['pnl.volume', 'pnl.price', 'pnl.cogs'])}, m AS (SELECT *, abs(pnl_volume) * abs(pnl_price) - abs(pnl_cogs) AS margin, abs(pnl_cogs) * 7e-1 AS opex FROM wide) SELECT book, period_key, margin - opex AS delta FROM m WHERE margin + greatest(1e0, 1e-3 * greatest(abs(margin), opex)) < opex")
def detector_below_breakeven(spark, sf_dir):
    f = st.facts(spark, sf_dir, ["pnl.volume", "pnl.price", "pnl.cogs"])
    opex = f.where("concept = 'pnl.cogs'").withColumn("concept", F.lit("pnl.opex")).withColumn("value", F.abs("value") * 0.7)
    return detectors.below_breakeven(f.unionByName(opex))


for _name, _concept in (("cogs", "pnl.cogs"), ("capex", "cf.capex"), ("inventory", "bs.inventory"), ("ap", "bs.ap"), ("headcount", "ops.headcount"), ("wc", "bs.ar")):

    def _volume(spark, sf_dir, concept=_concept):
        f = st.facts(spark, sf_dir, ["pnl.volume", concept])
        # the other line of every second book stays put
        still = F.when((F.col("concept") == concept) & (F.col("book") % 2 == 0), F.lit(1000.0)).otherwise(F.col("value"))
        return detectors.volume_without(f.withColumn("value", still), concept)

    _c = _concept.replace(".", "_")
    query(f"""WITH {st.wide_sql(['pnl.volume', _concept])}, s AS (SELECT book, period_key, role, pnl_volume AS v, CASE WHEN book % 2 = 0 THEN 1000e0 ELSE {_c} END AS c FROM wide),
        l AS (SELECT *, lag(v) OVER w AS v0, lag(c) OVER w AS c0 FROM s WINDOW w AS (PARTITION BY book ORDER BY period_key))
        SELECT book, period_key, abs(v) / abs(v0) - 1 AS growth, abs(c) - abs(c0) AS moved FROM l WHERE role = 'forecast' AND abs(v) / abs(v0) - 1 >= 1e-1 - 1e-9 AND abs(c) - abs(c0) <= greatest(1e0, 1e-3 * greatest(abs(c), abs(c0)))""", f"detector_volume_without_{_name}")(_volume)


@query(f"WITH {st.wide_sql(['pnl.interest_rate', 'cov.dscr'])} SELECT book, period_key, pnl_interest_rate AS irr, cov_dscr / 1e1 AS wacc FROM wide WHERE pnl_interest_rate + 1e-9 < cov_dscr / 1e1")
def detector_irr_below_wacc(spark, sf_dir):
    f = st.facts(spark, sf_dir, ["pnl.interest_rate", "cov.dscr"])
    irr = F.col("concept") == "pnl.interest_rate"
    return detectors.irr_below_wacc(f.select("book", "period_key", "role", F.when(irr, "val.irr").otherwise("val.wacc").alias("concept"), F.when(irr, F.col("value")).otherwise(F.col("value") / 10).alias("value")))


@query(f"WITH {st.wide_sql(['covenant.headroom'])} SELECT book, period_key, covenant_headroom AS npv FROM wide WHERE covenant_headroom < 0")
def detector_negative_npv(spark, sf_dir):
    return detectors.negative_npv(st.facts(spark, sf_dir, ["covenant.headroom"]).withColumn("concept", F.lit("val.npv")))


@query(f"""WITH {st.wide_sql(['pnl.revenue', 'pnl.interest_rate'])}, b AS (SELECT book, pnl_revenue AS r FROM wide WHERE period_key = '1996'), s AS (SELECT book, pnl_revenue AS r FROM wide WHERE period_key = '1997')
    SELECT b.book, abs(b.r) - abs(s.r) AS fell FROM b JOIN s USING (book) WHERE abs(b.r) - abs(s.r) > greatest(1e0, 1e-2 * abs(b.r))""")
def detector_stress_rate(spark, sf_dir):
    f = st.facts(spark, sf_dir, ["pnl.revenue", "pnl.interest_rate"]).where("period_key in ('1996', '1997')")
    return detectors.stress_rate_unchanged(f.withColumn("period_key", F.when(F.col("period_key") == "1996", "base").otherwise("stress")).withColumn("role", F.lit("scenario")))


# --- credit controls


def _matrix(spark, sf_dir):
    # a row a book and month, read for the years and for the months
    sums = graph.stage(st.months(spark, sf_dir))
    yearly = st.facts(spark, sf_dir, [c for c in frs.YEARLY if c in st.CONCEPTS], sums=sums)
    return frs.frs_matrix(yearly, st.facts(spark, sf_dir, list(frs.MONTHLY), monthly=True, sums=sums))


def _matrix_sql() -> str:
    yearly = [c for c in frs.YEARLY if c in st.CONCEPTS]
    month = st.wide_sql(list(frs.MONTHLY), True)
    for old, new in (("base0", "mbase0"), ("base AS", "mbase AS"), ("FROM base)", "FROM mbase)"), ("wide AS", "mwide AS")):
        month = month.replace(old, new)
    month = month.replace("FROM mmbase0", "FROM mbase0").replace("mmbase0", "mbase0")
    first = lambda name, hit, metric: f"{name} AS (SELECT book, min(period_key) AS k, arg_min({metric}, period_key) AS m FROM y4 WHERE {hit} GROUP BY book)"
    return f"""WITH {st.wide_sql(yearly)}, {month},
    y1 AS (SELECT *, pnl_revenue / nullif(lag(pnl_revenue) OVER w, 0) - 1 AS yoy, pnl_ebitda / nullif(pnl_revenue, 0) AS mg, lag(role) OVER w AS role0, lag(pnl_ebitda) OVER w AS e0,
        bs_ar / nullif(pnl_revenue, 0) * 365 AS dso, bs_inventory / nullif(pnl_cogs, 0) * 365 AS dio, bs_ap / nullif(pnl_cogs, 0) * 365 AS dpo,
        bs_ar - lag(bs_ar) OVER w AS ar_up, pnl_revenue - lag(pnl_revenue) OVER w AS r_up, CASE WHEN pnl_ebitda > 0 THEN (bs_debt - bs_cash) / pnl_ebitda END AS lev,
        pnl_ebitda / nullif(abs(pnl_interest), 0) AS icr, lag(cf_fcf) OVER w AS fcf0, lag(cf_cfo) OVER w AS cfo0 FROM wide WINDOW w AS (PARTITION BY book ORDER BY period_key)),
    y2 AS (SELECT *, lag(yoy) OVER w AS yoy0, lag(mg) OVER w AS mg0, last_value(lev IGNORE NULLS) OVER (PARTITION BY book ORDER BY period_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lev0 FROM y1 WINDOW w AS (PARTITION BY book ORDER BY period_key)),
    hist AS (SELECT book, arg_max(dso, period_key) AS dso_h, arg_max(dio, period_key) AS dio_h, arg_max(dpo, period_key) AS dpo_h, avg(yoy) AS yoy_h FROM y1 WHERE role = 'historical' GROUP BY book),
    fc AS (SELECT book, avg(yoy) AS yoy_f, max(period_key) AS k, count(*) AS n, arg_min(pnl_revenue, period_key) AS r1, arg_max(pnl_revenue, period_key) AS r2, arg_min(cf_fcf, period_key) AS f1, arg_max(cf_fcf, period_key) AS f2, arg_max(fcf0, period_key) AS f20 FROM y1 WHERE role = 'forecast' GROUP BY book),
    y4 AS (SELECT y2.*, greatest(dso - dso_h, dio - dio_h, dpo - dpo_h) AS lift FROM y2 LEFT JOIN hist USING (book)),
    {first('f01', "role = 'forecast' AND (yoy <= -1e-1 OR (role0 = 'historical' AND abs(yoy - yoy0) >= 15e-2))", 'yoy')},
    {first('f02', "role = 'forecast' AND (pnl_ebitda / nullif(e0, 0) - 1 <= -1e-1 OR mg0 - mg >= 5e-2)", 'CASE WHEN pnl_ebitda / nullif(e0, 0) - 1 <= -1e-1 THEN pnl_ebitda / e0 - 1 ELSE mg0 - mg END')},
    {first('f03', "role = 'forecast' AND role0 = 'forecast' AND pnl_ebitda < 0 AND e0 < 0", 'pnl_ebitda')},
    red AS (SELECT book, min(period_key) AS k, arg_min(cf_fcf, period_key) AS m FROM y4 WHERE role = 'forecast' AND pnl_net_income >= 0 AND cf_fcf < 0 GROUP BY book HAVING count(*) >= 2),
    {first('apart', 'cf_cfo > cfo0 AND cf_fcf < fcf0', 'cf_fcf')},
    {first('days', "role = 'forecast' AND lift >= 15", 'lift')},
    {first('ar', 'r_up > 0 AND ar_up > r_up * 3e-1', 'ar_up / r_up')},
    {first('f06', 'lev >= 4 OR lev - lev0 >= 1', 'lev')},
    icr AS (SELECT book, arg_min(period_key, icr) AS k, min(icr) AS m FROM y4 GROUP BY book HAVING min(icr) < 15e-1),
    dscr AS (SELECT book, arg_min(period_key, cov_dscr) AS k, min(cov_dscr) AS m FROM y4 GROUP BY book HAVING min(cov_dscr) < 1),
    {first('f13', 'cf_dividends > 0 AND cf_fcf < 0', 'cf_drawdown - cf_repayment')},
    f14 AS (SELECT book, arg_min(period_key, covenant_headroom) AS k, min(covenant_headroom) AS m FROM y4 GROUP BY book HAVING min(covenant_headroom) <= 0),
    m1 AS (SELECT *, count(bs_cash) OVER (PARTITION BY book ORDER BY period_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nth FROM mwide),
    f08 AS (SELECT book, min(period_key) AS k, CAST(arg_min(nth, period_key) AS DOUBLE) AS m FROM m1 WHERE bs_cash < 0 GROUP BY book),
    pay AS (SELECT book, substr(period_key, 1, 4) AS k, sum(cf_repayment) AS p FROM m1 WHERE role = 'forecast' AND cf_repayment > 0 GROUP BY 1, 2),
    f09 AS (SELECT book, arg_max(k, p) AS k, max(p) / sum(p) AS m FROM pay GROUP BY book HAVING max(p) / sum(p) >= 3e-1),
    flags AS (SELECT book, 'F01' AS c, k, m FROM f01 UNION ALL SELECT book, 'F02', k, m FROM f02 UNION ALL SELECT book, 'F03', k, m FROM f03
        UNION ALL SELECT book, 'F04', k, m FROM red UNION ALL SELECT book, 'F04', k, m FROM apart WHERE book NOT IN (SELECT book FROM red)
        UNION ALL SELECT book, 'F05', k, m FROM days UNION ALL SELECT book, 'F05', k, m FROM ar WHERE book NOT IN (SELECT book FROM days)
        UNION ALL SELECT book, 'F06', k, m FROM f06 UNION ALL SELECT book, 'F07', k, m FROM dscr UNION ALL SELECT book, 'F07', k, m FROM icr WHERE book NOT IN (SELECT book FROM dscr)
        UNION ALL SELECT book, 'F08', k, m FROM f08 UNION ALL SELECT book, 'F09', k, m FROM f09
        UNION ALL SELECT book, 'F11', k, yoy_f - yoy_h FROM fc JOIN hist USING (book) WHERE yoy_f - yoy_h >= 15e-2
        UNION ALL SELECT book, 'F12', k, r2 / r1 - 1 FROM fc WHERE n >= 2 AND r2 / r1 - 1 >= 2e-1 AND ((f1 <> 0 AND (f2 - f1) / abs(f1) <= -2e-1) OR (f1 >= 0 AND f2 < 0 AND f20 < 0))
        UNION ALL SELECT book, 'F13', k, m FROM f13 UNION ALL SELECT book, 'F14', k, m FROM f14),
    ids AS (SELECT book, 'F' || lpad(CAST(i AS VARCHAR), 2, '0') AS c FROM (SELECT DISTINCT book FROM wide) CROSS JOIN range(1, 15) r(i))
    SELECT ids.book, ids.c AS control_id, CASE WHEN ids.c = 'F10' THEN 'insufficient' WHEN flags.c IS NOT NULL THEN 'flagged' ELSE 'clear' END AS status, k AS period_key, round(m, 6) AS metric FROM ids LEFT JOIN flags ON ids.book = flags.book AND ids.c = flags.c"""


_FULL = ("pnl.ebitda", "pnl.net_income", "pnl.interest", "cf.fcf", "cf.cfo", "cf.capex", "cf.dividends", "cf.repayment", "cf.drawdown", "bs.ar", "bs.ap", "bs.debt", "bs.cash", "covenant.headroom")


def _full_sql() -> str:
    month = st.wide_sql(["bs.cash", "cf.drawdown"], True)
    for old, new in (("base0", "mbase0"), ("base AS", "mbase AS"), ("FROM base)", "FROM mbase)"), ("wide AS", "mwide AS")):
        month = month.replace(old, new)
    month = month.replace("FROM mmbase0", "FROM mbase0").replace("mmbase0", "mbase0")
    return f"""WITH {st.wide_sql(list(_FULL))}, {month},
    y AS (SELECT *, role = 'forecast' AND pnl_net_income >= 0 AND cf_fcf < 0 AS red, cf_cfo > lag(cf_cfo) OVER w AND cf_fcf < lag(cf_fcf) OVER w AS apart, role = 'forecast' AND pnl_ebitda < 0 AND lag(role) OVER w = 'forecast' AND lag(pnl_ebitda) OVER w < 0 AS loss,
        lag(period_key) OVER w AS k0, greatest(0, bs_ar - lag(bs_ar) OVER w) AS ar_up, greatest(0, bs_ap - lag(bs_ap) OVER w) AS ap_up FROM wide WINDOW w AS (PARTITION BY book ORDER BY period_key)),
    f03 AS (SELECT book, 'F03' AS c, count(*) FILTER (loss) > 0 AS flag, 'medium' AS priority, 'high' AS confidence, '' AS cause, coalesce(arg_min(k0, period_key) FILTER (loss), '') AS k, NULL::DOUBLE AS metric, 2 AS n FROM y GROUP BY book),
    r AS (SELECT *, count(*) FILTER (red) OVER (PARTITION BY book) AS reds, min(period_key) FILTER (apart) OVER (PARTITION BY book) AS ak FROM y),
    sc AS (SELECT book, any_value(reds) AS reds, any_value(ak) AS ak, coalesce(min(period_key) FILTER (red), '') AS k, coalesce(arg_min(cf_fcf, period_key) FILTER (red), arg_max(cf_fcf, period_key)) AS metric,
        sum(greatest(0, pnl_net_income - cf_cfo)) FILTER (red OR reds = 0) AS ops, coalesce(sum(ar_up) FILTER (red OR reds = 0), 0) AS wc_ar, coalesce(sum(ap_up) FILTER (red OR reds = 0), 0) AS wc_ap, sum(greatest(0, -cf_capex)) FILTER (red OR reds = 0) AS capex, sum(greatest(0, cf_dividends)) FILTER (red OR reds = 0) AS dividends,
        count(*) FILTER (red OR period_key = ak) AS cells FROM r GROUP BY book),
    f04 AS (SELECT book, 'F04' AS c, reds >= 2 OR ak IS NOT NULL AS flag, 'medium' AS priority, 'high' AS confidence, CASE greatest(ops, wc_ar, wc_ap, capex, dividends) WHEN ops THEN 'ops' WHEN wc_ar THEN 'wc_ar' WHEN wc_ap THEN 'wc_ap' WHEN capex THEN 'capex' ELSE 'dividends' END AS cause, k, metric, 3 * cells AS n FROM sc),
    m AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY period_key) - 1 AS nth FROM mwide),
    f08 AS (SELECT book, 'F08' AS c, min(bs_cash) < 0 OR (max(bs_cash) - min(bs_cash) <= greatest(1, 1e-2 * abs(avg(bs_cash))) AND max(cf_drawdown) > 0) AS flag, CASE WHEN min(bs_cash) < 0 THEN 'high' ELSE 'medium' END AS priority, 'high' AS confidence, CASE WHEN min(bs_cash) < 0 THEN '' ELSE 'cash_plug' END AS cause,
        arg_min(period_key, (bs_cash, period_key)) AS k, CAST(min(nth) FILTER (bs_cash < 0) AS DOUBLE) AS metric, CASE WHEN min(bs_cash) < 0 THEN count(*) FILTER (bs_cash < 0) ELSE count(*) + count(*) FILTER (cf_drawdown > 0) END AS n FROM m GROUP BY book),
    d AS (SELECT book, min(period_key) AS k FROM y WHERE cf_dividends > 0 AND cf_fcf < 0 GROUP BY book),
    f13 AS (SELECT b.book, 'F13' AS c, d.k IS NOT NULL AS flag, CASE WHEN cf_drawdown - cf_repayment > 0 THEN 'high' ELSE 'medium' END AS priority, 'high' AS confidence, '' AS cause, coalesce(d.k, '') AS k, cf_fcf + cf_drawdown - cf_repayment AS metric, 4 AS n
        FROM (SELECT DISTINCT book FROM y) b LEFT JOIN d USING (book) LEFT JOIN y ON y.book = b.book AND y.period_key = d.k),
    f14 AS (SELECT book, 'F14' AS c, min(covenant_headroom) <= 0 AS flag, 'high' AS priority, 'medium' AS confidence, '' AS cause, arg_min(period_key, (covenant_headroom, period_key)) AS k, max(CASE WHEN pnl_ebitda > 0 THEN (bs_debt - bs_cash) / pnl_ebitda END) AS metric, count(*) FILTER (covenant_headroom <= 0) AS n FROM y GROUP BY book),
    a AS (SELECT * FROM f03 UNION ALL SELECT * FROM f04 UNION ALL SELECT * FROM f08 UNION ALL SELECT * FROM f13 UNION ALL SELECT * FROM f14)
    SELECT book, c AS control_id, CASE WHEN flag THEN 'flagged' ELSE 'clear' END AS status, CASE WHEN flag THEN priority END AS priority, confidence, CASE WHEN flag THEN cause ELSE '' END AS cause, k AS first_key, round(metric, 2) AS metric, CASE WHEN flag THEN n ELSE 0 END AS n_refs FROM a"""


def _in_full(spark, sf_dir):
    """Results on years of all lines, but for cash and drawdown, which are months."""
    sums = graph.stage(st.months(spark, sf_dir))
    monthly = ["bs.cash", "cf.drawdown"]
    f = st.facts(spark, sf_dir, [c for c in _FULL if c not in monthly], sums=sums).unionByName(st.facts(spark, sf_dir, monthly, monthly=True, sums=sums))
    return credit.controls_in_full(f.withColumn("ref", F.concat_ws("!", "concept", "period_key")))


@query(f"""SELECT book, control_id, status, CASE control_id {' '.join(f"WHEN '{c[0]}' THEN '{c[2]}'" for c in messages.CONTROLS if c[0])} END AS impact, CASE WHEN status = 'clear' THEN 'The threshold holds on the data there is.' ELSE 'flagged' END AS reason,
    CASE cause {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in messages.CAUSES)} ELSE '' END AS cause, n_refs FROM ({_full_sql()})""")
def report_risk_screen(spark, sf_dir):
    screen = messages.risk_screen(_in_full(spark, sf_dir), credit.NEEDS)
    return screen.select("book", "control_id", "status", "impact", F.when(F.col("status") == "clear", F.col("status_reason")).otherwise(F.col("status")).alias("reason"), "cause", F.size("cell_refs").cast("long").alias("n_refs"))


@query(_full_sql())
def frs_in_full(spark, sf_dir):
    out = _in_full(spark, sf_dir)
    of = {"F04": "fcf", "F08": "runway", "F13": "fcfe", "F14": "nd_ebitda"}
    metric = F.element_at(F.create_map(*[F.lit(x) for kv in of.items() for x in kv]), F.col("control_id"))
    value = F.when(F.col("control_id") != "F03", F.round(F.try_element_at("metrics", metric), 2))
    return out.select("book", "control_id", "status", "priority", "confidence", "cause", F.coalesce(F.try_element_at("period_keys", F.lit(1)), F.lit("")).alias("first_key"), value.alias("metric"), F.size("cell_refs").cast("long").alias("n_refs"))


query(_matrix_sql(), "frs_matrix")(_matrix)
for _c in frs.CONTROLS:
    query(f"SELECT * FROM ({_matrix_sql()}) WHERE control_id = '{_c}'", f"frs_{_c.lower()}")(lambda spark, sf_dir, c=_c: _matrix(spark, sf_dir).where(F.col("control_id") == c))


@query(f"WITH {st.wide_sql(['pnl.revenue', 'bs.inventory'], True)} SELECT book, 'pnl.revenue' AS concept, substr(period_key, 1, 4) AS period_key, max(role) AS role, round(sum(pnl_revenue), 4) AS value FROM wide GROUP BY 1, 2, 3 UNION ALL SELECT book, 'bs.inventory', substr(period_key, 1, 4), max(role), round(arg_max(bs_inventory, period_key), 4) FROM wide GROUP BY 1, 2, 3")
def year_rollup_stock_flow(spark, sf_dir):
    return rollup.year_rollup(st.facts(spark, sf_dir, ["pnl.revenue", "bs.inventory"], monthly=True)).withColumn("value", F.round("value", 4))


_AMOUNTS = f"""WITH {st.wide_sql(['pnl.revenue', 'bs.inventory'], True)}, l AS (SELECT book, period_key AS k, role, unnest([('pnl.revenue', pnl_revenue), ('bs.inventory', bs_inventory)]) AS c FROM wide), f AS (SELECT book, c[1] AS concept, k, role, c[2] AS v, substr(k, 1, 4) AS y, (CAST(substr(k, 6, 2) AS INTEGER) + 2) // 3 AS q FROM l),
    q AS (SELECT book, concept, y, q, max(role) AS role, CASE WHEN concept = 'bs.inventory' THEN arg_max(v, k) ELSE sum(v) END AS v FROM f GROUP BY 1, 2, 3, 4),
    a AS (SELECT book, concept, y, max(role) AS role, CASE WHEN concept = 'bs.inventory' THEN arg_max(v, k) ELSE sum(v) END + CASE WHEN book % 3 = 2 THEN 1 ELSE 0 END AS v FROM f WHERE book % 3 <> 1 GROUP BY 1, 2, 3
        UNION ALL SELECT book, concept, y, max(role), CASE WHEN concept = 'bs.inventory' THEN arg_max(v, q) ELSE sum(v) END FROM q WHERE book % 3 = 1 GROUP BY 1, 2, 3 HAVING count(*) = 4)
    SELECT book, concept, y AS period_key, role, round(v, 4) AS value FROM a"""


@query(_AMOUNTS)
def year_amounts(spark, sf_dir):
    """Books have months, quarters, or years of their own (a unit more) besides months."""
    f = st.facts(spark, sf_dir, ["pnl.revenue", "bs.inventory"], monthly=True)
    k = F.col("period_key")
    quarter = F.concat(k.substr(1, 4), F.lit("Q"), F.ceil(k.substr(6, 2).cast("int") / 3).cast("string"))
    q = f.where("book % 3 = 1").groupBy("book", "concept", quarter.alias("period_key")).agg(F.max("role").alias("role"), F.when(F.col("concept") == "bs.inventory", F.max_by("value", "period_key")).otherwise(F.sum("value")).alias("value"))
    y = rollup.year_rollup(f.where("book % 3 = 2")).withColumn("value", F.col("value") + 1)
    every = f.where("book % 3 <> 1").unionByName(q).unionByName(y)
    return rollup.year_amounts(every).withColumn("value", F.round("value", 4))


# --- addresses, dates, periods, labels


@query("SELECT p_partkey AS n, CASE WHEN n > 702 THEN chr(CAST(65 + (n - 703) // 676 AS INTEGER)) ELSE '' END || CASE WHEN n > 26 THEN chr(CAST(65 + ((n - 1) // 26 - 1) % 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + (n - 1) % 26 AS INTEGER)) AS letters, CAST(n AS INTEGER) AS back, CAST(p_size AS INTEGER) AS row_back FROM (SELECT p_partkey, p_partkey % 16384 + 1 AS n, p_size FROM part)".replace("p_partkey AS n,", "n,"))
def a1_address_roundtrip(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select((F.col("p_partkey") % 16384 + 1).alias("n"), "p_size")
    addr = a1.address(F.col("p_size"), F.col("n"))
    return p.select("n", a1.index_to_col(F.col("n")).alias("letters"), a1.address_col(addr).alias("back"), a1.address_row(addr).alias("row_back"))


@query("""WITH b AS (SELECT p_partkey AS k, 2 + p_size % 20 AS c2, 1 + p_partkey % 150 AS r2 FROM part)
    SELECT k, least(2000, c2 * r2) AS cells, 'A1' AS first_cell, chr(CAST(65 + (least(2000, c2 * r2) - 1) % c2 AS INTEGER)) || CAST(1 + (least(2000, c2 * r2) - 1) // c2 AS VARCHAR) AS last_cell, c2 * r2 > 2000 AS truncated FROM b""")
def range_expand_cap(spark, sf_dir):
    ref = F.concat(F.lit("A1:"), a1.index_to_col(2 + F.col("p_size") % 20), (1 + F.col("p_partkey") % 150).cast("string"))
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), ref.alias("ref"))
    # each distinct range is expanded once, its cells are never more than the cap
    cells = a1.explode_range(dealt(p.select("ref").distinct(), 500, "ref"), F.col("ref")).withColumn("place", F.struct(F.regexp_extract("cell", r"\d+", 0).cast("int").alias("r"), F.length("cell"), "cell"))
    known = cells.groupBy("ref").agg(F.count(F.lit(1)).alias("cells"), F.min("place")["cell"].alias("first_cell"), F.max("place")["cell"].alias("last_cell"), F.bool_or("truncated").alias("truncated"))
    return p.join(known, "ref").select("k", "cells", "first_cell", "last_cell", "truncated")


@query("SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS shown, CAST(o_orderdate AS DATE) AS day FROM orders")
def excel_serial_to_date(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    serial = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date")).cast("double")
    return o.select("o_orderkey", dates.display_text(serial.cast("string"), serial, F.lit("dd/mm/yyyy")).alias("shown"), dates.serial_to_date(serial).alias("day"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y') WHEN 2 THEN strftime(o_orderdate, '%Y') || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) WHEN 3 THEN strftime(o_orderdate, '%Y-%m') WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m') END AS period_key,
    CASE WHEN o_orderkey % 6 = 1 THEN 'forecast' ELSE 'historical' END AS role FROM orders""")
def header_classify(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    d = F.col("o_orderdate")
    kind = F.col("o_orderkey") % 6
    text = (
        F.when(kind == 0, F.concat(F.lit("FY "), F.date_format(d, "yyyy"))).when(kind == 1, F.concat(F.date_format(d, "yyyy"), F.lit("E")))
        .when(kind == 2, F.concat(F.quarter(d).cast("string"), F.lit(" кв. "), F.date_format(d, "yyyy"))).when(kind == 3, F.date_format(d, "yyyy-MM"))
        .when(kind == 4, F.date_format(d, "dd.MM.yyyy")).otherwise(F.concat(F.date_format(d, "MMM"), F.lit("-"), F.date_format(d, "yy")))
    )
    # two-digit years are read as 20xx: the sample spells them out
    text = F.when(kind == 5, F.concat(F.date_format(d, "MMM"), F.lit(" "), F.date_format(d, "yyyy"))).otherwise(text)
    h = periods.classify_header(text)
    return o.select("o_orderkey", h["period_key"].alias("period_key"), h["role"].alias("role"))


@query("""WITH k AS (SELECT DISTINCT c_nationkey AS book, strftime(o_orderdate, '%Y-%m') AS k FROM orders JOIN customer ON o_custkey = c_custkey),
    s AS (SELECT book, k, CAST(substr(k, 1, 4) AS INTEGER) * 12 + CAST(substr(k, 6, 2) AS INTEGER) AS m FROM k), d AS (SELECT book, m - lag(m) OVER (PARTITION BY book ORDER BY m) AS d FROM s),
    g AS (SELECT book, max(d) - min(d) AS spread, list_sort(list(d) FILTER (d IS NOT NULL))[len(list(d) FILTER (d IS NOT NULL)) // 2 + 1] AS mid FROM d GROUP BY book),
    r AS (SELECT book, coalesce(CASE WHEN spread <= 1 AND mid <= 1 THEN 'month' WHEN spread <= 1 AND mid BETWEEN 2 AND 4 THEN 'quarter' WHEN spread <= 1 AND mid BETWEEN 11 AND 13 THEN 'year' END, 'month') AS grain FROM g)
    SELECT book, grain, count(DISTINCT k) AS keys FROM r JOIN k USING (book) GROUP BY 1, 2""")
def grain_infer_apply(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    keys = o.select(F.col("c_nationkey").alias("book"), F.date_format("o_orderdate", "yyyy-MM-dd").substr(1, 7).alias("k")).distinct()
    g = keys.groupBy("book").agg(F.collect_list("k").alias("ks"))
    # uneven steps have no grain; the query calls them months
    g = g.select("book", F.coalesce(periods.infer_grain(F.col("ks")), F.lit("month")).alias("grain"), "ks")
    return g.select("book", "grain", F.size(F.array_distinct(F.transform("ks", lambda k: periods.apply_grain(k, F.col("grain"))))).cast("long").alias("keys"))


@query(r"SELECT p_partkey, lower(trim(regexp_replace(p_type, '\s+', ' ', 'g'))) AS label_key, lower(p_brand) AS concept FROM part")
def label_normalize_glossary(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    rows = p.select("p_partkey", F.concat(F.lit("  "), F.col("p_type"), F.lit(" (note)")).alias("label"), F.col("p_brand").alias("parent"))
    glossary = p.select(F.upper("p_type").alias("label"), F.col("p_brand").alias("parent"), F.lower("p_brand").alias("concept")).distinct()
    return mapping.glossary_match(rows, glossary).select("p_partkey", "label_key", "concept")


@query("SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'check' WHEN 1 THEN 'output' WHEN 2 THEN 'actual_adjustment' WHEN 3 THEN 'database_like' ELSE 'calculation' END AS role FROM nation")
def article_role(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    k = F.col("n_nationkey") % 5
    label = F.concat("n_name", F.when(k == 1, " Total").when(k == 2, " adjustment").otherwise(""))
    return n.select("n_nationkey", labels.article_role(label, k == 0, k == 4).alias("role"))


@query("SELECT l_orderkey, l_linenumber, l_quantity AS number, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS parsed FROM lineitem")
def number_parse(spark, sf_dir):
    x = _t(spark, sf_dir, "lineitem")
    text = F.when(F.col("l_linenumber") == 7, "#N/A").otherwise(F.concat(F.lit(" "), F.regexp_replace(F.col("l_quantity").cast("string"), r"\.", ","), F.lit(" ")))
    return x.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("number"), numeric.as_number(text).alias("parsed"))


# --- series


@query("""WITH p AS (SELECT user_id, event_id, CASE WHEN event_id % 10 < 8 THEN 'view' ELSE event_type END AS t FROM events), c AS (SELECT user_id, t, count(*) AS n FROM p GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS size FROM c)
    SELECT p.user_id, p.event_id, m.t AS majority, CASE WHEN p.t = 'error' THEN 'value_instead_of_formula' ELSE 'template_change' END AS kind FROM p JOIN (SELECT * FROM m WHERE t <> 'error' AND n >= 7e-1 * size) m USING (user_id) WHERE p.t <> m.t""")
def series_majority_outliers(spark, sf_dir):
    # eight of ten events of a user are views: a majority, and what is off it
    kind = F.when(F.col("event_id") % 10 < 8, "view").otherwise(F.col("event_type"))
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", F.when(kind != "error", kind).alias("template"))
    return series.outliers(e, ("user_id",)).select("user_id", "event_id", "majority", "kind")


@query("""WITH p AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN value ELSE 0 END AS v FROM events), f AS (SELECT *, min(CASE WHEN v <> 0 THEN event_id END) OVER (PARTITION BY user_id) AS a, max(CASE WHEN v <> 0 THEN event_id END) OVER (PARTITION BY user_id) AS b FROM p)
    SELECT user_id, event_id FROM f WHERE event_id BETWEEN a AND b""")
def trim_zero_edges(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"), F.lit(None).cast("string").alias("template"), F.when(F.col("event_id") % 3 == 0, F.col("value")).otherwise(0.0).alias("value"))
    return series.trim_edges(e, ("user_id",)).select("user_id", F.col("pos").alias("event_id"))


# --- nearest concepts

_KNN = """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), u AS (SELECT label, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM e), c AS (SELECT label, i, avg(x) AS x FROM u GROUP BY 1, 2), g AS (SELECT label, list(x ORDER BY i) AS v FROM c GROUP BY 1),
    s AS (SELECT e.vec_id, g.label, list_cosine_similarity(e.v, g.v) AS s FROM e CROSS JOIN g), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS k, lead(s) OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS s2 FROM s)"""


@query(_KNN + " SELECT vec_id, label AS concept, round(s, 6) AS score, round(s2, 6) AS second FROM r WHERE k = 1")
def concept_centroid_knn(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    out = mapping.nearest_concepts(e, mapping.centroids(e, "label", "embedding"), "vec_id", "embedding")
    return out.select("vec_id", "concept", F.round("score", 6).alias("score"), F.round("second", 6).alias("second"))


@query(_KNN + " SELECT vec_id, label AS concept FROM r WHERE k = 1 AND s >= 4e-1 AND s - s2 >= 8e-2")
def knn_confident_match(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    out = mapping.nearest_concepts(e, mapping.centroids(e, "label", "embedding"), "vec_id", "embedding")
    return out.where(mapping.confident(F.col("score"), F.col("second"), top=0.4)).select("vec_id", "concept")


# --- graphs


def _edges(spark, sf_dir):
    o, c, n = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "nation")
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    e1 = o.select(name("o", "o_orderkey").alias("src"), name("c", "o_custkey").alias("dst"))
    return e1.unionByName(c.select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst"))).unionByName(n.select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst")))


_EDGES = "e AS (SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"


@query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT DISTINCT src AS source, src AS node FROM e WHERE src LIKE 'o%' UNION SELECT r.source, e.dst FROM r JOIN e ON e.src = r.node) SELECT source, node FROM r")
def reach_forward(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return graph.reach(e, e.where("src like 'o%'").select(F.col("src").alias("source"), F.col("src").alias("node")))


@query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT 'r' || r_regionkey AS source, 'r' || r_regionkey AS node FROM region UNION SELECT r.source, e.src FROM r JOIN e ON e.dst = r.node) SELECT source, count(*) AS nodes FROM r GROUP BY 1")
def reach_reverse_multi(spark, sf_dir):
    starts = _t(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("source"))
    return graph.reverse_reach(_edges(spark, sf_dir), starts.withColumn("node", F.col("source"))).groupBy("source").agg(F.count(F.lit(1)).alias("nodes"))


@query("""WITH RECURSIVE e AS (SELECT 'orders!A' || (o_orderkey + 1) AS src, 'customer!A' || (o_custkey + 1) AS dst FROM orders UNION ALL SELECT 'customer!A' || (c_custkey + 1), 'nation!A' || (c_nationkey + 1) FROM customer),
    r AS (SELECT n_nationkey AS candidate, 'nation!A' || (n_nationkey + 1) AS ref FROM nation UNION SELECT r.candidate, e.src FROM r JOIN e ON e.dst = r.ref),
    p AS (SELECT r.candidate, r.ref, o_orderpriority AS concept FROM r LEFT JOIN orders ON ref = 'orders!A' || (o_orderkey + 1) AND o_orderstatus = 'F')
    SELECT candidate, count(*) AS n_path, count(concept) AS n_outputs, coalesce(string_agg(DISTINCT concept, ',' ORDER BY concept), '') AS affected_metrics,
           CASE WHEN candidate % 2 = 0 THEN 'numeric' ELSE 'direction' END AS impact_kind, bool_or(ref LIKE 'customer!A%7') AS truncated FROM p GROUP BY candidate""")
def lineage_outputs(spark, sf_dir):
    """Nations are the findings, their customers and orders depend on them; finished orders are output rows; sheet rows count from 1."""
    o, c, n = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "nation")
    cell = lambda sheet, row: F.concat(F.lit(f"{sheet}!A"), row.cast("string"))
    edges = o.select(cell("orders", o["o_orderkey"] + 1).alias("src"), cell("customer", o["o_custkey"] + 1).alias("dst"))
    edges = edges.unionByName(c.select(cell("customer", c["c_custkey"] + 1).alias("src"), cell("nation", c["c_nationkey"] + 1).alias("dst")))
    rows = o.select(F.lit("orders").alias("sheet"), (F.col("o_orderkey") + 1).alias("row"), F.col("o_orderpriority").alias("concept_id"), F.when(F.col("o_orderstatus") == "F", "output").otherwise("calculation").alias("article_role"))
    found = n.select(F.col("n_nationkey").alias("candidate"), F.array(cell("nation", n["n_nationkey"] + 1)).alias("cell_refs"), F.when(F.expr("n_nationkey % 2 = 0"), F.col("n_nationkey").cast("double")).alias("delta"))
    cut = edges.select("src").where("src like 'customer!A%7'")
    out = lineage.trace_lineage(found, edges, rows, cut)
    return out.select("candidate", "n_path", "n_outputs", F.array_join("affected_metrics", ",").alias("affected_metrics"), "impact_kind", "truncated")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS src, CASE p_partkey % 10 WHEN 9 THEN p_partkey - 3 WHEN 5 THEN p_partkey - 5 ELSE p_partkey + 1 END AS dst FROM part), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst)
    SELECT a.src AS node, min(b.src) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY 1""")
def scc_groups(spark, sf_dir):
    k = F.col("p_partkey")
    return graph.circular_groups(_t(spark, sf_dir, "part").select(k.alias("src"), F.when(k % 10 == 9, k - 3).when(k % 10 == 5, k - 5).otherwise(k + 1).alias("dst")))


# --- candidates, report, control plane


def _candidates(spark, sf_dir):
    x = _t(spark, sf_dir, "lineitem")
    tags = F.when(F.col("l_returnflag") == "R", F.array(F.lit("edge_period"))).otherwise(F.array().cast("array<string>"))
    return x.select(F.col("l_suppkey").alias("book"), F.col("l_shipmode" if "l_shipmode" in x.columns else "l_linestatus").alias("detector"), F.array(F.col("l_partkey").cast("string"), (F.col("l_partkey") % 7).cast("string")).alias("cell_refs"), tags.alias("tags"), F.lit("error").alias("severity"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))


@query("SELECT book, detector, min(ord) AS ord FROM (SELECT l_suppkey AS book, l_linestatus AS detector, l_partkey, l_orderkey * 10 + l_linenumber AS ord FROM lineitem) GROUP BY book, detector, l_partkey")
def candidate_dedup(spark, sf_dir):
    return detectors.dedup_candidates(_candidates(spark, sf_dir)).select("book", "detector", "ord")


@query("SELECT l_orderkey * 10 + l_linenumber AS ord, CASE WHEN l_returnflag = 'R' THEN 'warning' ELSE 'error' END AS severity FROM lineitem")
def severity_freeze(spark, sf_dir):
    return detectors.freeze_severity(_candidates(spark, sf_dir)).select("ord", "severity")


# --- report: orders are candidates of the books of their customers


_DETECTORS = ("identity.I1", "excel_error", "unused_cell", "frs.F03", "circular", "external_link", "literal_in_ast")


def _report(spark, sf_dir):
    k, kind = F.col("o_orderkey"), F.col("o_orderkey") % 7
    detector = F.element_at(F.array(*map(F.lit, _DETECTORS)), (kind + 1).cast("int"))
    severity = F.when(kind.isin(0, 1), "error").when(kind.isin(4, 5, 6), "warning").otherwise("risk")
    out = F.concat(F.lit("O!B"), F.col("o_custkey").cast("string"))
    c = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).alias("book"), k.alias("ord"), detector.alias("detector"), severity.alias("severity"), F.array(F.concat(F.lit("S!A"), k.cast("string"))).alias("cell_refs"), F.array(out).alias("outputs"), F.when(kind == 6, F.array(F.lit("pnl.ebitda"))).alias("metrics"))
    refs = c.where("ord % 3 <> 0").select("book", F.col("cell_refs")[0].alias("ref"))
    return report.findings(c, refs)


_REPORT = f"""d AS (SELECT o_custkey % 25 AS book, o_orderkey AS ord, o_custkey AS cust, ({list(_DETECTORS)})[o_orderkey % 7 + 1] AS detector, CASE WHEN o_orderkey % 7 < 2 THEN 'error' WHEN o_orderkey % 7 > 3 THEN 'warning' ELSE 'risk' END AS severity FROM orders WHERE o_orderkey % 3 <> 0),
    f AS (SELECT *, detector = 'frs.F03' AS frs, CASE WHEN detector = 'frs.F03' THEN 'F03' ELSE format('f_{{:03d}}', row_number() OVER (PARTITION BY book, detector = 'frs.F03' ORDER BY ord)) END AS id FROM d)"""


@query(f"WITH {_REPORT} SELECT book, ord, id, detector, severity FROM f")
def report_findings(spark, sf_dir):
    return _report(spark, sf_dir).select("book", "ord", "id", "detector", "severity")


@query(f"WITH {_REPORT} SELECT a.book, a.id, string_agg(b.id, ',' ORDER BY b.id) AS related_ids FROM f a JOIN f b ON a.book = b.book AND a.cust = b.cust AND a.id <> b.id WHERE NOT a.frs AND NOT b.frs GROUP BY 1, 2")
def report_related(spark, sf_dir):
    return report.related(_report(spark, sf_dir)).select("book", "id", F.array_join("related_ids", ",").alias("related_ids"))


@query(f"""WITH {_REPORT}, x AS (SELECT DISTINCT a.book, unnest([a.ord, b.ord]) AS ord FROM f a JOIN f b ON a.book = b.book AND a.cust = b.cust WHERE b.detector = 'external_link' AND a.detector NOT IN ('external_link', 'unused_cell')),
    g AS (SELECT f.book, 'combo' AS kind, 'external_assumption' AS title, 2 AS k, f.ord FROM f JOIN x USING (book, ord) UNION ALL SELECT book, CASE WHEN frs THEN 'dynamics' ELSE 'trust' END, detector, CASE WHEN frs THEN 4 ELSE 3 END, ord FROM f WHERE detector <> 'unused_cell' AND (book, ord) NOT IN (SELECT (book, ord) FROM x)),
    c AS (SELECT book, kind, title, k, min(ord) AS first, count(*) AS findings FROM g GROUP BY 1, 2, 3, 4), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY book ORDER BY k, first) AS INTEGER) AS nth FROM c) SELECT book, nth, kind, title, findings FROM n WHERE nth <= 8""")
def report_conclusions(spark, sf_dir):
    return report.conclusions(_report(spark, sf_dir)).select("book", "nth", "kind", "title", F.size("finding_ids").cast("long").alias("findings"))


@query(f"WITH {_REPORT} SELECT book, detector AS kind, count(DISTINCT cust) AS questions FROM f WHERE severity = 'error' GROUP BY 1, 2")
def report_questions(spark, sf_dir):
    q = _report(spark, sf_dir).where("severity = 'error'").select("book", "ord", F.col("detector").alias("kind"), F.col("outputs").alias("cell_refs"), F.col("id").alias("prompt"))
    return report.merged_questions(q, q.where("ord % 2 = 0")).groupBy("book", "kind").agg(F.count(F.lit(1)).alias("questions"))


@query(f"""WITH {_REPORT}, b AS (SELECT book, bool_or(detector IN ('identity.I1', 'excel_error')) AS broken, arg_min(id, ord) FILTER (severity = 'error') AS err FROM f WHERE NOT frs GROUP BY 1),
    i AS (SELECT book, arg_min(id || '@' || ord, ord) FILTER (ord % 4 = 0) AS iss FROM f WHERE frs GROUP BY 1), k AS (SELECT DISTINCT book FROM f)
    SELECT book, CASE WHEN broken OR iss IS NOT NULL THEN false END AS ready_for_credit, CASE WHEN book % 2 = 0 THEN 'needs_input' ELSE 'succeeded' END AS status, coalesce(err, iss) AS headline FROM k LEFT JOIN b USING (book) LEFT JOIN i USING (book)""")
def report_verdict(spark, sf_dir):
    found = _report(spark, sf_dir)
    matrix = found.select("book", F.lit("F03").alias("control_id"), F.lit("flagged").alias("status")).distinct()
    issues = found.where("frs").select("book", F.concat_ws("@", "id", "ord").alias("id"), F.when(F.col("ord") % 4 == 0, "high").otherwise("low").alias("priority"), "ord")
    return report.verdict(found, matrix, issues, found.where("book % 2 = 0").select("book").distinct()).select("book", "ready_for_credit", "status", "headline")


@query(f"""WITH {_REPORT} SELECT book, id, ord, CASE detector WHEN 'identity.I1' THEN 'An accounting identity does not hold' WHEN 'excel_error' THEN 'A cell shows an error' WHEN 'unused_cell' THEN 'A cell feeds no result' WHEN 'frs.F03' THEN 'A credit control is flagged' WHEN 'circular' THEN 'Cells depend on themselves'
    WHEN 'external_link' THEN 'The book reads another file' ELSE 'A number is written into a formula' END AS title, 'Detector ' || detector || '; cells S!A' || ord || '; lines ' || CASE WHEN detector = 'literal_in_ast' THEN 'pnl.ebitda' ELSE '—' END || '.' AS evidence FROM f""")
def report_cards(spark, sf_dir):
    found = _report(spark, sf_dir).withColumn("id", F.concat_ws("@", "id", "ord"))
    c = messages.cards(found)
    return c.select("book", F.substring_index("id", "@", 1).alias("id"), F.substring_index("id", "@", -1).cast("long").alias("ord"), "title", "evidence")


@query("""WITH i AS (SELECT o_orderkey, o_custkey % 25 AS book, CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS priority, o_orderkey % 5 = 0 AS bare FROM orders)
    SELECT book, o_orderkey, priority FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, o_orderkey) AS n FROM i) WHERE n <= 20 AND NOT bare""")
def report_top_issues(spark, sf_dir):
    k = F.col("o_orderkey")
    refs = F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("S!A"), k.cast("string"))))
    priority = F.element_at(F.array(*map(F.lit, report.PRIORITIES)), (k % 3 + 1).cast("int"))
    issues = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).alias("book"), k.alias("ord"), "o_orderkey", priority.alias("priority"), refs.alias("cell_refs"))
    return report.top_issues(issues).select("book", "o_orderkey", "priority")


@query("""WITH i AS (SELECT o_orderkey, o_custkey % 25 AS book, o_orderpriority, o_totalprice FROM orders) SELECT book, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY o_orderpriority, o_orderkey) AS n FROM i) WHERE n <= 20""")
def topn_issues(spark, sf_dir):
    i = _t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 25).alias("book"), "o_orderpriority")
    nth = F.row_number().over(Window.partitionBy("book").orderBy("o_orderpriority", "o_orderkey"))
    return i.withColumn("n", nth).where("n <= 20").select("book", "o_orderkey")


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT book, detector, count(*) AS n FROM (SELECT book, 'identity.' || identity_id AS detector FROM ({identities.identity_sql(i, st.wide_sql, st.CONCEPTS)})) GROUP BY 1, 2)" for i in identities.IDENTITIES))
def conclusions_grouped(spark, sf_dir):
    v = identities.check_identities(st.facts(spark, sf_dir))
    return v.groupBy("book", F.concat(F.lit("identity."), "identity_id").alias("detector")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH m AS ({_matrix_sql()}) SELECT book, count(*) FILTER (status = 'flagged') AS flagged, CASE WHEN bool_or(status = 'flagged' AND control_id IN ('F07', 'F08', 'F13', 'F14')) THEN false END AS ready_for_credit FROM m GROUP BY book")
def verdict(spark, sf_dir):
    high = (F.col("status") == "flagged") & F.col("control_id").isin("F07", "F08", "F13", "F14")
    return _matrix(spark, sf_dir).groupBy("book").agg(F.count_if(F.col("status") == "flagged").alias("flagged"), F.when(F.bool_or(high), False).alias("ready_for_credit"))


@query("SELECT user_id, count(DISTINCT event_id) AS events FROM events GROUP BY 1")
def job_idempotent_dedup(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", "event_id")
    return e.unionByName(e).dropDuplicates(["user_id", "event_id"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("events"))


@query("SELECT c_custkey, sha256(c_mktsegment || ':' || sha256(c_name)) AS audit_id FROM customer")
def audit_id_hash(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", F.sha2(F.concat_ws(":", "c_mktsegment", F.sha2("c_name", 256)), 256).alias("audit_id"))
