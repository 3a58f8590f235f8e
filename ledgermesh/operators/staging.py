"""Tables between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame

_own: dict[str, str] = {}


def stage(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Cut lineage: a table in the folder of spark.checkpoint.dir; where that is unset, a local master gets a temporary one.

    Shuffles on the way have ``tasks`` tasks where that is given: a number that
    follows the input keeps a task's share, and so its memory, the same.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="spark-"))
    path = f"{base.rstrip('/')}/stage-{uuid.uuid4().hex}"
    settings = {"spark.sql.shuffle.partitions": str(tasks), "spark.sql.adaptive.coalescePartitions.enabled": "false"} if tasks else {}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        # a new plan under the settings
        df.select("*").write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``stage`` made and that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._staged_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
