"""New question files as they come, with a checkpoint in place of markers for each question."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def each_new_file(spark: SparkSession, path: str, schema: StructType | str, checkpoint: str, job: Callable[[DataFrame, int], None], files: int = 100) -> StreamingQuery:
    """Runs ``job`` over batches of up to ``files`` JSON-lines files that have not been seen, then stops. The batch number makes a repeated batch known."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)
    return rows.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
