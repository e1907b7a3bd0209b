"""A folder of diffs as a stream. Every diff stands alone, so there is no state and no watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """``diff_id, source, raw`` of files as they arrive."""
    files = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder, wholetext=True)
    return files.select(F.xxhash64(F.input_file_name()).alias("diff_id"), F.input_file_name().alias("source"), F.col("value").alias("raw"))


def write_stream(diffs: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Apply a per-diff operator and append its rows as Parquet, once for every file."""
    return operator(diffs).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
