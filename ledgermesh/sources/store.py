"""What an audit keeps between runs: the ontology, glossaries of answers, and the catalogue of its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import normalize_label

#: The tables of a session and what an empty one holds.
TABLES = {
    "cells": "workbook_id string, sheet string, addr string, row int, col int, formula_raw string, cached_value string, template string",
    "edges": "workbook_id string, src string, kind string, dst string, unresolved boolean",
    "series_outliers": "workbook_id string, sheet string, block_id string, row int, col int, kind string, edge_period boolean",
    "axis_headers": "workbook_id string, sheet string, block_id string, col int, period_key string, role string",
    "layout_rows": "workbook_id string, sheet string, block_id string, row int, label string, parent_label string, check_row boolean",
}
GLOSSARY = "label string, parent string, concept string"


def open_catalogue(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Temporary views of the five tables under a folder; a table that isn't there yet is an empty view."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    views = {}
    for name, schema in TABLES.items():
        there = files.exists(path(f"{folder}/{name}"))
        views[name] = spark.read.parquet(f"{folder}/{name}") if there else spark.createDataFrame([], schema)
        views[name].createOrReplaceTempView(name)
    return views


#: An entry of an ontology file up to the next one; its id; its labels in brackets, or a line each.
_ENTRY = r"(?ms)^[ \t]*-[ \t]*id:[ \t]*(.*?)(?=^[ \t]*-[ \t]*id:|\z)"
_ID = r"^(?:\"([^\"\n]*)\"|'([^'\n]*)'|([^\s#]+))"
_INLINE, _BLOCK = r"(?s)\blabels:[ \t]*\[((?:\"[^\"]*\"|'(?:[^']|'')*'|[^\]\"'])*)\]", r"\blabels:[ \t]*(?:#[^\n]*)?\n((?:[ \t]*(?:-[ \t]+[^\n]*|#[^\n]*)?\n?)+)"
_ITEM = r"\"([^\"]*)\"|'((?:[^']|'')*)'|([^,\"'\s][^,\"'\n]*)"
_LINE = r"(?m)^[ \t]*-[ \t]+(?:\"([^\"\n]*)\"|'((?:[^'\n]|'')*)'|([^\"'\n#][^\n#]*))"


def ontology(spark: SparkSession, path: str) -> DataFrame:
    """(concept, label) of an ontology file, a row a label.

    Entries begin with ``- id: x`` and have ``labels:`` in brackets or as a list,
    ids and labels bare or quoted; what else an entry has is passed over.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("t"))
    entry = text.select(F.explode(F.regexp_extract_all(F.concat("t", F.lit("\n")), F.lit(_ENTRY), F.lit(1))).alias("e"))
    some = lambda c, pattern: F.concat(*[F.regexp_extract(c, pattern, i) for i in (1, 2, 3)])
    inline, block = F.regexp_extract("e", _INLINE, 1), F.regexp_extract("e", _BLOCK, 1)
    items = lambda c, pattern: F.zip_with(F.zip_with(*[F.regexp_extract_all(c, F.lit(pattern), F.lit(i)) for i in (1, 2)], lambda a, b: F.concat(a, F.replace(b, F.lit("''"), F.lit("'")))), F.regexp_extract_all(c, F.lit(pattern), F.lit(3)), lambda a, b: F.concat(a, b))
    labels = F.when(inline != "", items(inline, _ITEM)).otherwise(items(block, _LINE))
    each = entry.select(some(F.col("e"), _ID).alias("concept"), F.explode(labels).alias("label"))
    return each.select("concept", F.trim("label").alias("label")).where("label <> '' and concept <> ''")


def load_glossary(spark: SparkSession, path: str) -> DataFrame:
    """label, parent, concept of a saved glossary; empty where there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p):
        return spark.createDataFrame([], GLOSSARY)
    return spark.read.schema(GLOSSARY).json(path)


def merge_answers(glossary: DataFrame, questions: DataFrame, answers: DataFrame, rows: DataFrame) -> DataFrame:
    """The glossary with the answers of a run, which come before older entries; keys are normalised, sorted by key.

    questions: question_id, sheet, row; answers: question_id, concept_id, ord (the
    last answer to a label counts); rows: sheet, row, label, parent_label.
    """
    said = answers.where("coalesce(concept_id, '') <> ''").join(questions, "question_id").join(rows, ["sheet", "row"])
    key = lambda label, parent: [normalize_label(F.col(label)).alias("label"), F.coalesce(normalize_label(F.col(parent)), F.lit("")).alias("parent")]
    fresh = said.select(*key("label", "parent_label"), F.col("concept_id").alias("concept"), F.col("ord").cast("long").alias("ord"))
    both = fresh.unionByName(glossary.select(*key("label", "parent"), "concept", F.lit(-1).cast("long").alias("ord")))
    last = Window.partitionBy("label", "parent").orderBy(F.desc("ord"), "concept")
    return both.withColumn("nth", F.row_number().over(last)).where("nth = 1").select("label", "parent", "concept").orderBy("label", "parent")


def save_glossary(glossary: DataFrame, path: str) -> None:
    """Write a glossary to a new folder; a run never overwrites what it reads."""
    glossary.write.mode("errorifexists").json(path)
