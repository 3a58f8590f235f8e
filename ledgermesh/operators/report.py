"""The report of an audit: findings, related findings, conclusions, questions and the verdict, per book.

Candidates have book, ord (their order), detector, severity, cell_refs, tags,
metrics and outputs (what they affect downstream), path (all that depends on
them) and cols (period columns); arrays may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

#: Conclusions and issues of a report, and which detectors join in which conclusion.
MAX_CONCLUSIONS, MAX_ISSUES = 8, 20
SKIPPED = ("unused_cell", "xlm_or_vba")
HARDCODED = ("literal_in_ast", "value_instead_of_formula", "pattern_break")
TRUST = (
    "identity.I1", "identity.I3a", "identity.I3b", "identity.I4", "identity.I5", "identity.I6", "identity.I7", "identity.I9", "identity.I10", "identity.I11", "identity.I12", "identity.I13", "identity.I8", "identity.I8b",
    "excel_error", "error_masking", "circular", "agg_range_gap", "agg_double_count", "scenario_switch", "stress_rate_unchanged", "conflicting_rate", "conflicting_fx", "scale_mismatch", "hidden_input", "external_link",
)
SEVERITIES = ("error", "warning", "risk")
PRIORITIES = ("high", "medium", "low")
LISTS = {"tags": "string", "metrics": "string", "outputs": "string", "path": "string", "cols": "int"}


def _rank(c: Column, order: tuple[str, ...]) -> Column:
    """Place in an order, 9 for what it lacks."""
    at = F.array_position(F.array(*map(F.lit, order)), c)
    return F.when(at > 0, at - 1).otherwise(9)


def _meet(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def findings(candidates: DataFrame, refs: DataFrame) -> DataFrame:
    """Candidates with a reference to a cell that there is (refs: book, ref), with an id.

    Integrity findings are numbered f_001, f_002, ... in the order of a book; a
    credit control is its own id.
    """
    lists = [(F.coalesce(F.col(c), F.array().cast(f"array<{t}>")) if c in candidates.columns else F.array().cast(f"array<{t}>")).alias(c) for c, t in LISTS.items()]
    c = candidates.select("book", "ord", "detector", "severity", "cell_refs", *lists)
    real = c.select("book", "ord", F.explode("cell_refs").alias("ref")).join(refs.select("book", "ref"), ["book", "ref"], "left_semi").select("book", "ord").distinct()
    kept = c.join(real, ["book", "ord"], "left_semi").withColumn("frs", F.col("detector").startswith("frs."))
    nth = F.row_number().over(Window.partitionBy("book", "frs").orderBy("ord"))
    return kept.withColumn("id", F.when(F.col("frs"), F.substring("detector", 5, 100)).otherwise(F.format_string("f_%03d", nth)))


def related(found: DataFrame) -> DataFrame:
    """book, id, related_ids: the integrity findings that share an output with each."""
    each = found.where("not frs").select("book", "id", F.explode("outputs").alias("output"))
    together = each.groupBy("book", "output").agg(F.collect_set("id").alias("ids"))
    out = each.join(together, ["book", "output"]).groupBy("book", "id").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    return out.select("book", "id", F.array_sort(F.array_remove("ids", F.col("id"))).alias("related_ids")).where("size(related_ids) > 0")


def _marked(**lists: str) -> Column:
    """The entries of several lists as one, each with the name of its kind."""
    named = lambda kind: lambda x: F.concat(F.lit(f"{kind}:"), x)
    parts = [F.transform(c, named(kind)) for kind, c in lists.items()]
    return F.array_distinct(F.concat(*parts)) if parts else F.array(F.lit(""))


def _combination(found: DataFrame, title: str, left: Column, right: Column, fits: Column, of_left: Column, of_right: Column) -> DataFrame:
    """book, ord, title of the findings that a rule joins: those of both sides that have an entry in common and fit."""
    side = lambda where, entries, name: found.where(where).withColumn("entry", F.explode(entries)).alias(name)
    pairs = side(left, of_left, "l").join(side(right, of_right, "r"), (F.col("l.book") == F.col("r.book")) & (F.col("l.entry") == F.col("r.entry"))).where(fits)
    return pairs.select(F.col("l.book").alias("book"), F.explode(F.array("l.ord", "r.ord")).alias("ord")).distinct().withColumn("title", F.lit(title))


def conclusions(found: DataFrame) -> DataFrame:
    """book, nth, kind, title, finding_ids, cell_refs, severity: at most eight a book (the cap is the feature).

    First what explains each other: hard-coded figures behind a fall of EBITDA, a
    broken balance behind a lack of cash, an external link behind anything it
    reaches.  A finding serves one conclusion.  Then what shakes the trust in the
    figures, and the credit controls, by detector in the order of first findings.
    """
    d = F.col("detector")
    same_period = (F.size("l.cols") == 0) | (F.size("r.cols") == 0) | _meet(F.col("l.cols"), F.col("r.cols"))
    touch, nothing = _marked(metric="metrics", output="outputs"), _marked()
    rules = (
        ("hardcoded_ebitda", d.isin(*HARDCODED) & ~F.array_contains("tags", "hist_manual_adjustment"), d == "frs.F02", same_period, touch, touch),
        ("balance_and_cash", d == "identity.I1", d == "frs.F08", same_period, nothing, nothing),
        ("external_assumption", ~d.isin("external_link", *SKIPPED), d == "external_link", F.lit(True), _marked(metric="metrics", output="outputs", cell="path"), _marked(metric="metrics", output="outputs", cell="cell_refs")),
    )
    found = stage(found)
    rest, parts = found, []
    for n, (title, *rule) in enumerate(rules):
        picked = stage(_combination(rest, title, *rule))
        parts.append(rest.join(picked, ["book", "ord"]).withColumn("kind", F.lit("combo")).withColumn("rank", F.lit(n)))
        rest = rest.join(picked.select("book", "ord"), ["book", "ord"], "left_anti")
    trust = d.isin(*TRUST) | (d.isin(*HARDCODED) & (F.size("metrics") > 0))
    kind = F.when(trust, "trust").when(F.col("frs"), "dynamics")
    parts.append(rest.where(~d.isin(*SKIPPED)).withColumn("title", d).withColumn("kind", kind).where("kind is not null").withColumn("rank", F.when(F.col("kind") == "trust", 3).otherwise(4)))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    worst = F.min(F.struct(_rank(F.col("severity"), SEVERITIES).alias("k"), F.col("severity").alias("s")))["s"]
    groups = every.groupBy("book", "rank", "kind", "title").agg(F.min("ord").alias("first"), F.array_sort(F.collect_list(F.struct("ord", "id", "cell_refs"))).alias("rows"), worst.alias("severity"))
    nth = F.row_number().over(Window.partitionBy("book").orderBy("rank", "first"))
    return groups.select("book", nth.alias("nth"), "kind", "title", F.col("rows.id").alias("finding_ids"), F.array_distinct(F.flatten("rows.cell_refs")).alias("cell_refs"), "severity").where(F.col("nth") <= MAX_CONCLUSIONS)


def top_issues(issues: DataFrame, most: int = MAX_ISSUES) -> DataFrame:
    """The first issues of a book by priority, of those with references (the limit is the feature); issues: book, ord, priority, cell_refs."""
    nth = F.row_number().over(Window.partitionBy("book").orderBy(_rank(F.col("priority"), PRIORITIES), "ord"))
    return issues.withColumn("nth", nth).where(F.col("nth") <= most).where("size(cell_refs) > 0")


def merged_questions(*sources: DataFrame) -> DataFrame:
    """Questions (book, kind, cell_refs, prompt) of several sources, in their order; of those of one kind and set of references the first."""
    every = None
    for n, s in enumerate(sources):
        s = s.select("book", "kind", "cell_refs", "prompt", F.lit(n).alias("source"), F.col("ord") if "ord" in s.columns else F.lit(0).alias("ord"))
        every = s if every is None else every.unionByName(s)
    first = Window.partitionBy("book", "kind", F.array_sort(F.array_distinct("cell_refs"))).orderBy("source", "ord", "prompt")
    return every.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def verdict(found: DataFrame, matrix: DataFrame, issues: DataFrame, questions: DataFrame) -> DataFrame:
    """One row a book: ready_for_credit (false or null, never true), status, headline, blockers, flagged and uncovered controls.

    matrix: book, control_id, status; issues: book, id, priority, ord; headline is
    the first error, else the first high issue, else null.
    """
    error = F.col("severity") == "error"
    broken = (F.col("detector").startswith("identity.") & error) | (F.col("detector") == "excel_error")
    a = found.where("not frs").groupBy("book").agg(F.bool_or(broken).alias("broken"), F.min(F.when(error, F.struct("ord", "id")))["id"].alias("error"))
    high = F.when(F.col("priority") == "high", F.struct("ord", "id"))
    b = issues.groupBy("book").agg(F.min(high)["id"].alias("issue"), F.array_sort(F.collect_list(high)).alias("blockers"))
    of = lambda *status: F.array_sort(F.collect_list(F.when(F.col("status").isin(*status), F.col("control_id"))))
    c = matrix.groupBy("book").agg(of("flagged").alias("flagged"), of("insufficient", "not_applicable").alias("uncovered"))
    q = questions.groupBy("book").agg(F.count(F.lit(1)).alias("questions"))
    out = c.join(a, "book", "full").join(b, "book", "full").join(q, "book", "full")
    bad = F.coalesce("broken", F.lit(False)) | F.col("issue").isNotNull()
    return out.select(
        "book", F.when(bad, F.lit(False)).alias("ready_for_credit"), F.when(F.col("questions") > 0, "needs_input").otherwise("succeeded").alias("status"), F.coalesce("error", "issue").alias("headline"),
        F.coalesce(F.col("blockers.id"), F.array().cast("array<string>")).alias("blockers"), "flagged", "uncovered",
    )
