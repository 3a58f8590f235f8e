"""Intake of workbooks as a stream: each content is audited once, and what was taken in is never lost or taken twice.

A folder is the queue, the checkpoint of the query its acknowledgement: a file
that a failed batch had read comes again with it.  What was taken in is known by
its content for as long as the checkpoint lives (32 bytes of state a content, in
the state store), whatever time a file bears: copied files may be of any age.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


#: Age up to which files are looked at; the source's own bound of a week would pass over copies of old files.
ANY_AGE = "36500d"


def arrivals(spark: SparkSession, folder: str, suffix: str = "*.xlsx", files_at_a_time: int = 100) -> DataFrame:
    """Stream of audit_id (hash of the content), path, modified, content; of equal contents the first counts."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", suffix).option("maxFilesPerTrigger", files_at_a_time).option("maxFileAge", ANY_AGE).load(folder)
    return raw.select(F.sha2("content", 256).alias("audit_id"), "path", F.col("modificationTime").alias("modified"), "content").dropDuplicates(["audit_id"])


def audit_stream(source: DataFrame, audit: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run an audit over each batch of arrivals; a batch writes a folder of its own, so a repeated one replaces itself."""

    def batch(new: DataFrame, number: int) -> None:
        audit(new).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
