"""Reachability and cycles of cell graphs by semi-naive joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import a1
from .staging import discard, stage


def reach(edges: DataFrame, starts: DataFrame, strangers: bool = False) -> DataFrame:
    """(source, node) for all nodes reachable from the starts, many sources at once; a start reaches itself.

    edges: src, dst; starts: source, node.  Starts that no edge names are left
    out, or reach themselves where strangers is true.
    """
    given = edges.select("src", "dst").distinct()
    edges = stage(given.where("src <> dst"))
    starts = starts.select("source", "node").distinct()
    if not strangers:
        starts = starts.join(given.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "node", "left_semi").select("source", "node")
    # what is seen is the union of the fronts: each node is written once
    seen = front = stage(starts)
    while True:
        step = front.join(edges, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node")).distinct()
        front = stage(step.join(seen, ["source", "node"], "left_anti"))
        if front.isEmpty():
            discard(front, edges)
            return seen
        seen = seen.unionByName(front)


def reverse_reach(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """The same against the direction of the edges; a start that no edge names reaches itself."""
    return reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), starts, True)


def circular_groups(edges: DataFrame) -> DataFrame:
    """(node, component): strongly connected components of two or more nodes, and nodes with an edge to themselves.

    Nodes without an edge in or out are trimmed again and again; then each round
    colours nodes with the least node that reaches them, and what reaches that
    node backward within its colour is its component.
    """
    edges = edges.select("src", "dst").distinct()
    loops = edges.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    left = stage(edges.where("src <> dst"))
    found = None
    while True:
        while True:
            trimmed = stage(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            before, now = left.count(), trimmed.count()
            discard(left)
            left = trimmed
            if now == before:
                break
        if now == 0:
            break
        colour = stage(left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct().withColumn("colour", F.col("node")))
        while True:
            pushed = left.join(colour, F.col("src") == F.col("node")).groupBy("dst").agg(F.min("colour").alias("m"))
            new = stage(colour.join(pushed, F.col("node") == F.col("dst"), "left").select("node", F.least("colour", F.coalesce("m", "colour")).alias("colour"), (F.col("m") < F.col("colour")).alias("changed")))
            moved = not new.where("changed").isEmpty()
            discard(colour)
            colour = new.select("node", "colour")
            colour._staged_at = new._staged_at
            if not moved:
                break
        inside = left.join(colour.select(F.col("node").alias("src"), "colour"), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("c2")), "dst").where("colour = c2").select("src", "dst", "colour")
        back = reverse_reach(inside, colour.where("node = colour").select(F.col("node").alias("source"), "node"))
        part = stage(back.select("node", F.col("source").alias("component")))
        found = part if found is None else found.unionByName(part)
        gone, last = part.select("node"), left
        left = stage(left.join(gone, F.col("src") == F.col("node"), "left_anti").join(gone, F.col("dst") == F.col("node"), "left_anti"))
        discard(last, colour)
    if found is None:
        return loops
    sizes = found.groupBy("component").count().where("count > 1").select("component")
    groups = found.join(sizes, "component").select("node", "component")
    return groups.unionByName(loops.join(groups, "node", "left_anti"))


def range_edges(edges: DataFrame) -> DataFrame:
    """Graph pairs (src, dst, truncated) of edges (src, kind, dst): ranges expanded to at most 2,000 cells, row-major."""
    points = edges.where(F.col("kind").isin("ref", "cross_sheet")).select("src", "dst", F.lit(False).alias("truncated"))
    ranges = a1.explode_range(edges.where("kind = 'range'").select("src", "dst"), a1.body_of(F.col("dst")))
    cells = ranges.select("src", F.concat(a1.sheet_of(F.col("dst"), F.lit("")), F.lit("!"), "cell").alias("dst"), "truncated")
    return points.unionByName(cells).groupBy("src", "dst").agg(F.bool_or("truncated").alias("truncated"))


def read_runs(edges: DataFrame, book: str = "workbook_id", cap: int | None = a1.RANGE_CAP) -> DataFrame:
    """book, src, sheet, col, first, last: what the edges (book, src, kind, dst) of a cell read, as runs of rows of one column, no cell twice.

    Ranges count whole where cap is None, else with their first ``cap`` cells,
    row-major, as in range_edges.  A run stands for all its cells, so ranges
    aren't expanded.  A target that is no address of a sheet is a run of its own:
    its name as the sheet, at column 0.
    """
    body = F.regexp_extract("dst", "([^!]*)$", 1)
    e = edges.where(F.col("kind").isin("ref", "cross_sheet", "range"))
    # a box comes out of an explode, behind which nothing works it out again
    e = e.select(book, "src", "kind", "dst", body.alias("_body"), F.explode_outer(F.array(a1.range_box(body))).alias("_box")).select("*", "_box.*")
    named = (F.col("kind") != "range") & ~F.coalesce(a1.address(F.col("r1"), F.col("c1")) == F.col("_body"), F.lit(False))
    e = e.withColumn("_named", named).where("_named or _box is not null")
    width = F.when(F.col("_named"), 1).otherwise(F.col("c2") - F.col("c1") + 1)
    columns = e.select(book, "src", "dst", "_named", "_box", "r1", "r2", "c1", F.explode(F.sequence(F.lit(0), (width if cap is None else F.least(width, F.lit(cap))) - 1)).alias("_i"))
    last = F.col("r2") if cap is None else F.col("r1") + a1.capped_rows(F.col("_box"), F.col("_i"), cap) - 1
    at = lambda name, cell: F.when(F.col("_named"), name).otherwise(cell)
    runs = columns.select(book, "src", at(F.col("dst"), F.regexp_extract("dst", "^(.*)!", 1)).alias("sheet"), at(F.lit(0), F.col("c1") + F.col("_i")).alias("col"), at(F.lit(0), F.col("r1")).alias("first"), at(F.lit(0), last).alias("last"))
    above = Window.partitionBy(book, "src", "sheet", "col").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest("first", F.max("last").over(above) + 1)
    return runs.withColumn("first", fresh).where(F.col("first") <= F.col("last"))


def reads(runs: DataFrame, book: str = "workbook_id") -> DataFrame:
    """book, src, cells: how many cells a cell reads, from read_runs."""
    return runs.groupBy(book, "src").agg(F.sum((F.col("last") - F.col("first") + 1).cast("long")).alias("cells"))


def nodes(runs: DataFrame, cells: DataFrame, book: str = "workbook_id") -> DataFrame:
    """book, node, n_reads, n_read_by of every cell (book, ref) and every cell that reads or is read in read_runs, those without an edge included.

    Down a column the readers change where runs start and end only: what lies
    between is written out once, however many read it.
    """
    ends = runs.select(book, "sheet", "col", F.inline(F.array(F.struct(F.col("first").alias("row"), F.lit(1).alias("by")), F.struct((F.col("last") + 1).alias("row"), F.lit(-1).alias("by")))))
    steps = ends.groupBy(book, "sheet", "col", "row").agg(F.sum("by").alias("by")).where("by <> 0")
    down = Window.partitionBy(book, "sheet", "col").orderBy("row")
    spans = steps.select(book, "sheet", "col", "row", F.sum("by").over(down).alias("in"), F.lead("row").over(down).alias("to")).where("`in` > 0")
    read = spans.select(book, "sheet", "col", "in", F.explode(F.sequence("row", F.col("to") - 1)).alias("row"))
    name = F.when(F.col("col") == 0, F.col("sheet")).otherwise(F.concat("sheet", F.lit("!"), a1.address(F.col("row"), F.col("col"))))
    zero = F.lit(0).cast("long")
    every = (
        reads(runs, book).select(book, F.col("src").alias("node"), F.col("cells").alias("out"), zero.alias("in")).unionByName(read.select(book, name.alias("node"), zero.alias("out"), "in"))
        .unionByName(cells.select(book, F.col("ref").alias("node"), zero.alias("out"), zero.alias("in")))
    )
    return every.groupBy(book, "node").agg(F.sum("out").alias("n_reads"), F.sum("in").alias("n_read_by"))


def strong_components(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's strongly connected component, by one depth-first walk (nodes are 0 to n - 1)."""
    order = np.argsort(src, kind="stable")
    to, first = dst[order].tolist(), np.searchsorted(src[order], np.arange(n + 1)).tolist()
    at, low, out = [0] * n, [0] * n, np.full(n, -1, np.int64)
    stack, count = [], 0
    for root in range(n):
        if at[root]:
            continue
        path = [(root, first[root])]
        count += 1
        at[root] = low[root] = count
        stack.append(root)
        while path:
            node, edge = path[-1]
            if edge < first[node + 1]:
                path[-1] = (node, edge + 1)
                other = to[edge]
                if not at[other]:
                    count += 1
                    at[other] = low[other] = count
                    stack.append(other)
                    path.append((other, first[other]))
                elif out[other] < 0:
                    low[node] = min(low[node], at[other])
                continue
            path.pop()
            if path:
                low[path[-1][0]] = min(low[path[-1][0]], low[node])
            if low[node] == at[node]:
                start = len(stack) - 1
                while stack[start] != node:
                    start -= 1
                members = stack[start:]
                del stack[start:]
                out[members] = min(members)
    return out


def circular_in_books(edges: DataFrame, most_edges: int = 5_000_000) -> DataFrame:
    """(book, node, component) as circular_groups gives them, for edges (book, src, dst) that stay inside a book.

    A book is one task, so a chain of formulas costs no rounds; books of more
    than ``most_edges`` go through circular_groups together.
    """
    edges = stage(edges.select("book", "src", "dst").distinct())
    kind = edges.schema["book"].dataType.simpleString()
    large = stage(edges.groupBy("book").count().where(F.col("count") > most_edges).select("book"))

    def groups(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names, codes = np.unique(np.concatenate([pdf["src"], pdf["dst"]]).astype(str), return_inverse=True)
        src, dst = codes[: len(pdf)], codes[len(pdf) :]
        part = strong_components(src, dst, len(names))
        size = np.bincount(part, minlength=len(names))
        looped = np.zeros(len(names), bool)
        looped[src[src == dst]] = True
        keep = (size[part] > 1) | looped
        return pd.DataFrame({"book": key[0], "node": names[keep], "component": names[part[keep]]})

    found = edges.join(F.broadcast(large), "book", "left_anti").groupBy("book").applyInPandas(groups, f"book {kind}, node string, component string")
    if large.isEmpty():
        return found
    rest = edges.join(F.broadcast(large), "book", "left_semi")
    tag = lambda c: F.concat(F.col("book").cast("string"), F.lit("\x00"), F.col(c))
    far = circular_groups(rest.select(tag("src").alias("src"), tag("dst").alias("dst")))
    part = lambda c, i: F.split_part(F.col(c), F.lit("\x00"), F.lit(i))
    return found.unionByName(far.select(part("node", 1).cast(kind).alias("book"), part("node", 2).alias("node"), part("component", 2).alias("component")))
