"""Quality classification with hierarchical empirical Bayes over hosts and paths.

A logistic regression on a few figures of the whole text (fitted on at most
``fit_rows`` labelled rows, drawn by hash) gives each document a probability of
being good.  Grouped sums of these give every host a posterior that is shrunk
toward the global mean, and every path one that is shrunk toward its host's; the
strength of each shrinkage is estimated by moments from the spread between the
groups.  A document's posterior log odds are its own plus the difference of its
path's from the global mean, times ``site_weight``.

Null text counts as empty; null hosts and paths are groups of their own; a
label is 0 or 1 and the greatest of an id's labels counts; without labels of
both values the classifier gives every document the share of good labels (0.5
without any).  Rows that repeat are judged each.  Columns other than those
named are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, written

FEATURES = ("log_length", "upper", "marks", "odd_marks", "digits", "word_length", "bars", "bangs", "fresh_words", "fresh_lines")


def features(text: Column) -> dict[str, Column]:
    """Figures of a text, each about 0 to 3, from built-in functions."""
    n = F.greatest(F.char_length(text), F.lit(1)).cast("double")
    left = lambda pattern: F.char_length(F.regexp_replace(text, pattern, ""))
    words = F.split(text, r"[\x20\x09-\x0D]+")
    lines = F.split(text, "\n")
    size = F.size(words).cast("double")
    return {
        "log_length": F.log1p(n) / 4,
        "upper": 1 - left(r"\p{Lu}+") / n,
        "marks": 10 * (1 - left(r"\p{Punct}+") / n),
        "odd_marks": 10 * (1 - left(r"[#$%&*<>{}\[\]\\^~_=+]+") / n),
        "digits": 10 * (1 - left(r"\p{Nd}+") / n),
        "word_length": n / size / 6,
        "bars": F.least(10 * (F.size(F.split(text, r"\|")) - 1) / size, F.lit(5.0)),
        "bangs": F.least(10 * (F.size(F.split(text, "!")) - 1) / size, F.lit(5.0)),
        "fresh_words": F.size(F.array_distinct(words)) / size,
        "fresh_lines": F.size(F.array_distinct(lines)) / F.size(lines),
    }


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the intercept last) by iteratively reweighted least squares."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _shrunk(sums: Column, n: Column, prior: Column, strength: Column) -> Column:
    return (strength * prior + sums) / (strength + n)


def _strength(groups: DataFrame, mean: float) -> float:
    """Prior observations of a group, from the spread of the group means beyond chance (1 to 10,000)."""
    r = groups.where("n > 1").agg(
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)).alias("between"), F.sum(F.col("v")).alias("within"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"), F.sum(F.col("n") * F.col("n")).alias("n2")
    ).first()
    if not r["n"] or r["groups"] < 2:
        return 100.0
    within = r["within"] / max(1, r["n"] - r["groups"])
    between = max(1e-9, (r["between"] - (r["groups"] - 1) * within) / max(1e-9, r["n"] - r["n2"] / r["n"]))
    return float(min(10_000.0, max(1.0, mean * (1 - mean) / between)))


def classify_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, fit_rows: int = 20_000, site_weight: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, p_doc, p_host, p_path, p_good, keep (p_good of 0.5 or more), host, path of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), *[c.cast("double").alias(k) for k, c in features(text).items()])
    d = written(d, "quality-features")
    y = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("double").alias("y"))
    share = min(1.0, fit_rows / max(1, y.count()))
    draw = F.xxhash64("doc_id", F.lit(5))
    y = y.where(F.pmod(draw, F.lit(1 << 20)) < share * (1 << 20)).orderBy(draw, "doc_id").limit(fit_rows)
    fit = d.join(F.broadcast(y), "doc_id").select(*FEATURES, "y").toArrow()  # at most fit_rows rows
    x = np.column_stack([fit.column(c).to_numpy() for c in FEATURES]) if fit.num_rows else np.zeros((0, len(FEATURES)))
    target = fit.column("y").to_numpy()
    if len(set(target.tolist())) == 2:
        w = logistic(x, target)
    else:
        base = min(0.99, max(0.01, float(target.mean()))) if len(target) else 0.5
        w = np.array([0.0] * len(FEATURES) + [np.log(base / (1 - base))])
    z = sum((F.col(c) * float(a) for c, a in zip(FEATURES, w)), F.lit(float(w[-1])))
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-12.0), F.least(F.lit(12.0), z))))
    d = d.select("doc_id", "host", "path", p.alias("p"))

    paths = written(d.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count(F.lit(1)).alias("n"), F.sum(F.col("p") * F.col("p")).alias("pp")), "quality-paths")
    spread = F.greatest(F.lit(0.0), F.col("pp") - F.col("s") * F.col("s") / F.col("n")).alias("v")
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("pp").alias("pp"))
    whole = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    mean = min(0.999, max(0.001, whole["s"] / whole["n"])) if whole["n"] else 0.5
    of_host = _strength(hosts.select("s", "n", spread), mean)
    of_path = _strength(paths.select("s", "n", spread), mean)
    hosts = hosts.select("host", _shrunk(F.col("s"), F.col("n"), F.lit(mean), F.lit(of_host)).alias("p_host"))
    paths = paths.alias("a").join(hosts.alias("b"), F.col("a.host").eqNullSafe(F.col("b.host"))).select("a.host", "path", "p_host", _shrunk(F.col("s"), F.col("n"), F.col("p_host"), F.lit(of_path)).alias("p_path"))
    paths = written(paths, "quality-sites")
    small = paths.count() <= BROADCAST_IDS // 10
    out = d.alias("a").join((F.broadcast(paths) if small else paths).alias("b"), F.col("a.host").eqNullSafe(F.col("b.host")) & F.col("a.path").eqNullSafe(F.col("b.path")))
    odds = lambda c: F.log(c / (1 - c))
    joint = odds(F.col("p")) + site_weight * (odds(F.col("p_path")) - float(np.log(mean / (1 - mean))))
    good = 1 / (1 + F.exp(-joint))
    return out.select("doc_id", F.col("p").alias("p_doc"), "p_host", "p_path", good.alias("p_good"), (good >= 0.5).alias("keep"), "a.host", "a.path")
