"""Corpus pipeline over ``documents``: each stage works on all its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of
docs; the last returns the packed pieces.  ``run`` writes each stage's result as
Parquet in the shared folder and reads it for the next.  Null ids and texts,
repeated rows and empty tables have the results that the operators define.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermesh.llm.common import WS, ids_only, table, written
from ledgermesh.llm.exact_dedup import exact_dedup
from ledgermesh.llm.language_id import identify, train
from ledgermesh.llm.mixing import mix
from ledgermesh.llm.packing import pack
from ledgermesh.llm.queries import BYTE_TOKENIZER
from ledgermesh.llm.shingle_join import near_duplicates

#: Least share of a text that its strongest language must have.
LEAST_SCORE = 0.25


def with_keys(docs: DataFrame) -> DataFrame:
    """docs with _row, which names a row by its id and text: the id itself, or a hash of both where rows share the id or have none."""
    again = written(docs.groupBy("doc_id").count().where("doc_id is not null and count > 1").select("doc_id"), "stage-shared-ids")
    marked = ids_only(docs, again.withColumn("_shared", F.lit(True)), "doc_id", "left")
    return marked.withColumn("_row", F.when(F.col("doc_id").isNull() | F.col("_shared"), F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")).otherwise(F.col("doc_id"))).drop("_shared").select(*docs.columns, "_row")


def once(keyed: DataFrame, names: list[str]) -> DataFrame:
    """keyed with one of the rows that agree in names and text; only rows that agree in names are shuffled."""
    again = written(keyed.groupBy(*names).count().where("count > 1").select(*names), "stage-again")
    return ids_only(keyed, again, names, "left_anti").unionByName(ids_only(keyed, again, names).dropDuplicates([*names, "text"]))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or without a language that has LEAST_SCORE of them, go."""
    keyed = with_keys(docs)
    found = identify(keyed, train(docs), id_col="_row")
    gone = found.where((F.col("lang_pred") == "und") | (F.col("score") < LEAST_SCORE)).select(F.col("doc_id").alias("_row")).distinct()
    return ids_only(keyed, written(gone, "stage-language"), "_row", "left_anti").drop("_row")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays, rows without one last."""
    key = [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none")]
    names = ["_id", "_none", "_sha"]
    verdict = exact_dedup(docs).select(*key, F.col("text_sha256").alias("_sha"), "kept").groupBy(*names).agg(F.max("kept").alias("kept"))
    gone = written(verdict.where("not kept").select(*names), "stage-exact")
    sha = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), f"{WS}+", " "), 256)
    keyed = written(docs.select("*", *key, sha.alias("_sha")), "stage-keyed")
    kept = ids_only(keyed, gone, names, "left_anti")
    again = written(kept.groupBy(*names).count().where("count > 1").select(*names), "stage-again")
    return ids_only(kept, again, names, "left_anti").unionByName(ids_only(kept, again, names).dropDuplicates(names)).drop(*names)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays, rows without one last; rows of one doc_id and several texts are documents each."""
    keyed = with_keys(docs)
    near = written(near_duplicates(keyed, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id").distinct(), "stage-near-rows")
    both = near.join(keyed.select("_row", "doc_id"), "_row")
    first = both.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("first"))
    gone = written(near.select("_row").join(first.select(F.col("first").alias("_row")), "_row", "left_anti"), "stage-near")
    return once(ids_only(keyed, gone, "_row", "left_anti"), ["_row"]).drop("_row")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes as often as the mix takes it; documents it does not take, and those without words, go.

    Rows equal in id and text share what the mix takes of them evenly, rounded.
    """
    keyed = with_keys(docs)
    taken = mix(keyed, id_col="_row").where("taken > 0").groupBy(F.col("doc_id").alias("_row")).agg(F.sum(F.col("taken") / F.col("size")).alias("n"))
    rows = keyed.groupBy("_row").count()
    copies = written(taken.join(rows, "_row").select("_row", F.round(F.col("n") / F.col("count")).cast("int").alias("_copies")).where("_copies > 0"), "stage-mixing")
    out = ids_only(keyed, copies, "_row", "inner").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return out.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path(BYTE_TOKENIZER), end_id=1, window=2048)


STAGES = [("language_id", language_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: The language stage is a statistical model and the packing depends on a tokenizer: no SQL expresses them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
