"""Incremental processing: a ledger of processed and failed files, and a file stream that keeps it by checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_states(ledger: DataFrame) -> DataFrame:
    """(file_path, state) by the latest entry of (file_path, state, at); success outweighs a failure of the same time."""
    order = F.struct("at", F.when(F.col("state") == "processed", 1).otherwise(0))
    return ledger.groupBy("file_path").agg(F.max_by("state", order).alias("state"))


def to_process(files: DataFrame, ledger: DataFrame, include_failed: bool = False, only_failed: bool = False) -> DataFrame:
    """Files that are not processed yet; failed ones only if asked for, or only those."""
    states = latest_states(ledger)
    if only_failed:
        return files.join(states.where("state = 'failed'"), "file_path", "left_semi")
    done = states if not include_failed else states.where("state = 'processed'")
    return files.join(done, "file_path", "left_anti")


def stream_pages(spark: SparkSession, directory: str, out_dir: str, checkpoint_dir: str, extract: Callable[[DataFrame], DataFrame], files_per_batch: int = 1000) -> StreamingQuery:
    """Extract the *.html files of a directory as they come and append them as a table; every file is taken once.

    Processes what is there and stops (available-now); run again, only new files are read.
    """
    pages = (
        spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.html").option("maxFilesPerTrigger", files_per_batch).schema("value string").load(directory)
        .select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("html"))
    )
    return extract(pages).writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
