"""Which outputs and metrics a finding touches: reverse reach of its cells, joined to the mapped rows.

Paths stay rows (candidate, ref), since a cell near the inputs may reach a whole
book; what is collected per candidate is bounded by the number of concepts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import reverse_reach, stage

#: Sheet and row of a cell reference; other references have no row.
_CELL = r"^([^!]*)!\$?[A-Za-z]{1,3}\$?([1-9][0-9]*)$"


def lineage_paths(candidates: DataFrame, edges: DataFrame, mapping: DataFrame, truncated_sources: DataFrame | None = None) -> DataFrame:
    """(candidate, ref, concept_id, truncated): all cells that depend on a candidate's cells, its own among them.

    candidates: candidate, cell_refs; edges: src, dst (src reads dst); mapping:
    sheet, row, concept_id, article_role; truncated_sources: src.  concept_id is
    that of an output row and null elsewhere.  Null references are left out; of
    several output concepts of one row the least counts.
    """
    starts = candidates.select(F.col("candidate").alias("source"), F.explode("cell_refs").alias("node")).where("node is not null")
    path = reverse_reach(edges, starts).select(F.col("source").alias("candidate"), F.col("node").alias("ref"))
    path = path.select("*", F.regexp_extract("ref", _CELL, 1).alias("sheet"), F.expr(f"try_cast(regexp_extract(ref, r'{_CELL}', 2) as long)").alias("row"))
    outputs = mapping.where("article_role = 'output' and concept_id is not null").groupBy("sheet", F.col("row").cast("long").alias("row")).agg(F.min("concept_id").alias("concept_id"))
    path = path.join(outputs, ["sheet", "row"], "left")
    if truncated_sources is None:
        return path.select("candidate", "ref", "concept_id", F.lit(False).alias("truncated"))
    cut = truncated_sources.select(F.col("src").alias("ref"), F.lit(True).alias("cut")).distinct()
    return path.join(cut, "ref", "left").select("candidate", "ref", "concept_id", F.coalesce("cut", F.lit(False)).alias("truncated"))


def lineage_items(candidates: DataFrame, paths: DataFrame) -> DataFrame:
    """A row for each candidate: n_path, n_outputs, affected_metrics (sorted), impact_kind, impact, truncated, complete.

    A candidate with a delta has a numeric impact, any other the direction
    ``downstream``.  One without cells has an empty path and is complete.
    """
    per = paths.groupBy("candidate").agg(
        F.count(F.lit(1)).alias("n_path"), F.count("concept_id").alias("n_outputs"), F.sort_array(F.collect_set("concept_id")).alias("affected_metrics"), F.bool_or("truncated").alias("truncated")
    )
    out = candidates.select("candidate", "delta").join(per, "candidate", "left")
    cut, numeric = F.coalesce("truncated", F.lit(False)), F.col("delta").isNotNull()
    return out.select(
        "candidate", F.coalesce("n_path", F.lit(0).cast("long")).alias("n_path"), F.coalesce("n_outputs", F.lit(0).cast("long")).alias("n_outputs"),
        F.coalesce("affected_metrics", F.array().cast("array<string>")).alias("affected_metrics"),
        F.when(numeric, "numeric").otherwise("direction").alias("impact_kind"), F.when(numeric, F.col("delta").cast("string")).otherwise("downstream").alias("impact"),
        cut.alias("truncated"), (~cut).alias("complete"),
    )


def trace_lineage(candidates: DataFrame, edges: DataFrame, mapping: DataFrame, truncated_sources: DataFrame | None = None) -> DataFrame:
    """lineage_items over lineage_paths; the paths are written once, as they are the larger."""
    return lineage_items(candidates, stage(lineage_paths(candidates, edges, mapping, truncated_sources)))
