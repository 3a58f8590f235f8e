"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Matches the white space that every contract of this subpackage names.
WS = r"[\x20\x09-\x0D]"
#: Rows up to which a list of 8-byte ids may be broadcast; beyond it the same join shuffles.
BROADCAST_IDS = 1_000_000

_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder of this machine serves a local master;
    on a cluster that would lose what other machines write, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _fallback:
        _fallback["dir"] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _fallback["dir"]


#: While a table is written the shuffle files of its query go as soon as the query is over, and Python workers get whole texts in smaller batches.
_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of df: write it to a table in the shared folder and read that.

    The shuffle files that made the table are removed at once: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    try:
        for k, v in _SETTINGS.items():
            spark.conf.set(k, v)
        # a new plan under the settings; df itself may have been planned without them
        df.select("*").write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made and that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written_to)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def ids_only(df: DataFrame, ids: DataFrame, on: str | list[str], how: str = "left_semi", most: int = BROADCAST_IDS) -> DataFrame:
    """df joined to a table of ids: broadcast behind a count of the ids (fewer where a row of them is wide), else shuffled."""
    most = most // len(ids.columns)
    small = ids.limit(most + 1).count() <= most
    return df.join(F.broadcast(ids) if small else ids, on, how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
