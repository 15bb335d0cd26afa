"""Writers of tables, samples, reports and snapshots."""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmloom.session import mounted, ship_package
from filmloom.sources.readers import FRONTIER_COLUMNS

# The columns of a sample, in their order.
SAMPLE_COLUMNS = (
    "title", "rt_year", "genres", "director", "cast", "tomatometer", "audience_score", "wiki_title", "wiki_year", "wiki_directors", "wiki_starring", "wiki_languages", "wiki_countries",
    "wiki_runtime_minutes", "wiki_budget", "wiki_box_office", "join_confidence",
)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def flat_list(c: Column, separator: str = "|") -> Column:
    """An array as one string; NULL gives ''."""
    return F.concat_ws(separator, F.coalesce(c, F.array().cast("array<string>")))


def sample_rows(joined: DataFrame, n: int = 300) -> DataFrame:
    """The first n rows by (file_path, wiki_page_id) of the sample's columns that exist, arrays as strings."""
    kinds = dict(joined.dtypes)
    top = joined.orderBy("file_path", "wiki_page_id").limit(n)
    return top.select(*[(flat_list(F.col(f"`{c}`")) if kinds[c].startswith("array") else F.col(f"`{c}`")).alias(c) for c in SAMPLE_COLUMNS if c in kinds])


def write_sample(joined: DataFrame, path: str, n: int = 300) -> None:
    sample_rows(joined, n).coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def write_frontier(frontier: DataFrame, path: str) -> None:
    """A snapshot of the frontier as CSV, in the place of the one before; times with their zone, white space kept."""
    times = {c: F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX") for c in ("discovered_at", "crawled_at")}
    out = frontier.withColumns(times).select(*FRONTIER_COLUMNS).write.mode("overwrite").option("header", True)
    out.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("escape", '"').csv(path)


def write_json_batches(df: DataFrame, path: str, rows_per_file: int = 1000) -> None:
    df.write.mode("append").option("maxRecordsPerFile", rows_per_file).json(path)


def _files_below(folder: str, used: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Values, each to a file; their number. The folder of a task gets its name when all are there, so that of two attempts one
    counts. It is the one of that name in `used`, where one is left, whose files are written over."""

    def run(batches):
        task, n = TaskContext.get(), 0
        name = f"part-{task.partitionId():05d}"
        own, done = os.path.join(folder, f"_attempt-{task.taskAttemptId()}"), os.path.join(folder, name)
        try:
            os.rename(os.path.join(used or own, name), own)
        except FileNotFoundError:
            os.makedirs(own)
        for b in batches:
            for page in b.column(0).to_pylist():
                with open(os.open(os.path.join(own, f"{n:08d}.txt"), os.O_WRONLY | os.O_CREAT, 0o666), "wb") as f:
                    f.write((page or b"") + b"\n")
                    f.truncate()
                n += 1
        for left in sorted(os.listdir(own))[n:]:
            os.remove(os.path.join(own, left))
        try:
            os.rename(own, done)
        except OSError:
            if not os.path.isdir(done):
                raise
            shutil.rmtree(own)
        yield pa.record_batch([pa.array([n], pa.int64())], ["n"])

    return run


def write_pages(pages: DataFrame, path: str, used: str | None = None) -> None:
    """Each html, with the end of a line, a file of its own: *.txt in folders below path. On a mounted file system the tasks write
    them: Spark's own writer starts processes there to set the modes of files and keeps a checksum file beside each. used: a folder of pages written so that
    nobody needs any more; its files are written over and move, because ext4 is slow to make files where many were just deleted."""
    spark = pages.sparkSession
    folders = mounted(spark, path)
    if not folders:
        pages.select("html").write.option("maxRecordsPerFile", 1).text(path)
        return
    ship_package(spark)
    os.makedirs(folders[0])
    pages.select(F.col("html").cast("binary")).mapInArrow(_files_below(folders[0], used and mounted(spark, used)[0]), "n long").agg(F.sum("n")).collect()


def metadata_rows(pages: DataFrame) -> DataFrame:
    """All columns with lists as strings, every row (not only a last batch's)."""
    return pages.select(*[(flat_list(F.col(f"`{c}`")) if k.startswith("array") else F.col(f"`{c}`")).alias(c) for c, k in pages.dtypes])


def write_metadata_csv(pages: DataFrame, path: str) -> None:
    metadata_rows(pages).write.mode("overwrite").option("header", True).csv(path)


def list_items(pages: DataFrame, column: str) -> DataFrame:
    """(file_path, item): one row per item of a list column. NULL and empty lists give none."""
    return pages.select("file_path", F.explode(f"`{column}`").alias("item"))


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    """Each section of a statistics report as JSON below path."""
    for name, df in sections.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
