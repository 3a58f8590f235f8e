"""Defined names of workbooks: what they stand for, and the edges that formulas have through them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import a1
from .formulas import compile_cells, edges_of
from .graph import circular_groups, reach
from .staging import stage

#: Quoted text and sheet names; a word that no call, sheet or cell reference is.
_QUOTED, _WORD = r"""("(?:[^"]|"")*"|'(?:[^']|'')*')""", r"(?U)(?<![\w.$!\]])([\p{L}_\\][\w.]*)(?![\w.]*[(!])"


def words_of(formula: Column) -> Column:
    """The words of a formula that may be names, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.regexp_replace(formula, _QUOTED, ""), F.lit(_WORD), F.lit(1)), F.lower))


def _of(names: DataFrame) -> DataFrame:
    """book, name in lower case, formula; of names that a book repeats the first in order of formula."""
    return names.groupBy("book", F.lower("name").alias("name")).agg(F.min("formula_raw").alias("formula_raw"))


def _uses(names: DataFrame) -> DataFrame:
    """(book, name, used): names that the formula of a name has."""
    used = names.select("book", "name", F.explode(words_of(F.col("formula_raw"))).alias("used"))
    return used.join(names.select("book", F.col("name").alias("used")), ["book", "used"])


def _node(name: str) -> Column:
    return F.to_json(F.struct(F.col("book").cast("string").alias("b"), F.col(name).alias("n")))


def circular_names(names: DataFrame) -> DataFrame:
    """(book, name) of names that stand for themselves, in the end."""
    uses = _uses(stage(_of(names)))
    node = F.from_json("node", "b string, n string")
    return circular_groups(uses.select(_node("name").alias("src"), _node("used").alias("dst"))).select(node["b"].alias("book"), node["n"].alias("name"))


def name_targets(names: DataFrame) -> DataFrame:
    """(book, name, kind, dst): the cells and ranges that a name stands for, by itself or by the names it uses; a circle ends where it began."""
    n = stage(_of(names))
    # the formula of a name belongs to no cell: its references are absolute
    cells = n.select("book", "name", F.lit("").alias("sheet"), F.lit(1).alias("row"), F.lit(1).alias("col"), "formula_raw")
    own = compile_cells(cells).select("book", "name", F.explode("edges").alias("e")).where("e.dst is not null").select("book", "name", "e.kind", "e.dst")
    kind = F.when(F.col("kind") == "ref", "cross_sheet").otherwise(F.col("kind"))
    own = stage(own.select("book", "name", kind.alias("kind"), "dst"))
    uses = _uses(n)
    far = reach(uses.select(_node("name").alias("src"), _node("used").alias("dst")), uses.select(_node("name").alias("source"), _node("name").alias("node")).distinct())
    parts = lambda c: F.from_json(c, "b string, n string")
    far = far.where("source <> node").select(parts("source")["b"].alias("b"), parts("source")["n"].alias("user"), parts("node")["n"].alias("name"))
    through = far.join(own, (F.col("b") == own["book"].cast("string")) & (far["name"] == own["name"])).select(own["book"], F.col("user").alias("name"), "kind", "dst")
    return own.unionByName(through).distinct()


def name_edges(cells: DataFrame, names: DataFrame) -> DataFrame:
    """book, src, kind, dst, unresolved of the edges that formulas (book, sheet, row, col, formula_raw) have through names."""
    src = F.concat("sheet", F.lit("!"), a1.address(F.col("row"), F.col("col")))
    used = cells.where("formula_raw is not null").select("book", src.alias("src"), F.explode(words_of(F.col("formula_raw"))).alias("name"))
    return used.join(name_targets(names), ["book", "name"]).select("book", "src", "kind", "dst", F.lit(False).alias("unresolved")).distinct()


def all_edges(compiled: DataFrame, names: DataFrame) -> DataFrame:
    """The edges of compiled cells (book, ...), those through names included."""
    return edges_of(compiled, "book").unionByName(name_edges(compiled, names))
