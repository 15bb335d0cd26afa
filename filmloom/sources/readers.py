"""Readers of pages, metadata and frontier files, each with an explicit schema."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filmloom.functions.text import first_nonempty, match_first
from filmloom.session import mounted, ship_package

PAGE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("file_path", "page_type", "url", "title", "description")]
    + [T.StructField("extraction_timestamp", T.DoubleType()), T.StructField("tomatometer", T.IntegerType()), T.StructField("audience_score", T.IntegerType()), T.StructField("rating", T.StringType())]
    + [T.StructField("genres", T.ArrayType(T.StringType())), T.StructField("release_date", T.StringType()), T.StructField("runtime", T.StringType()), T.StructField("director", T.StringType())]
    + [T.StructField("cast", T.ArrayType(T.StringType())), T.StructField("synopsis", T.StringType())]
)
FRONTIER = "url string, normalized_url string, status string, depth int, discovered_at timestamp, crawled_at timestamp, retry_count int, file_path string, response_code int, error_message string"
FRONTIER_COLUMNS = tuple(c.split()[0] for c in FRONTIER.split(", "))


# Files and bytes in a batch of names or pages; what Spark's own reader leaves out; names that it takes as they are
# (others may be compressed); characters that stand for themselves in the path of a URI.
NAMES, BYTES = 5_000, 4_000_000
HIDDEN = re.compile(rb"_(?!.*=)|\.|.*\._COPYING_\Z", re.S)
PLAIN_NAME = re.compile(r"\.(html?|txt)\Z")
QUOTED = re.compile(r"[^A-Za-z0-9_\-!.~'()*:@&=+$,;/]")


def _uri(path: bytes) -> str:
    """A path as `_metadata.file_path` gives it."""
    quoted = lambda m: m[0] if m[0] > "\x7f" and unicodedata.category(m[0]) not in ("Zs", "Zl", "Zp", "Cc") else quote(m[0])
    return "file:" + QUOTED.sub(quoted, path.decode(errors="replace"))


def _names(recursive: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Folders to the files in them: (path, file_path, name)."""

    def batch(paths: list[bytes]) -> pa.RecordBatch:
        name = pa.array([os.path.basename(p).decode(errors="replace") for p in paths], pa.string())
        return pa.record_batch([pa.array(paths, pa.binary()), pa.array([_uri(p) for p in paths], pa.string()), name], ["path", "file_path", "name"])

    def run(batches):
        folders, paths = [os.fsencode(f) for b in batches for f in b.column(0).to_pylist()], []
        while folders:
            with os.scandir(folders.pop()) as entries:
                for e in entries:
                    if HIDDEN.match(e.name):
                        continue
                    if e.is_dir():
                        if recursive or b"=" in e.name:
                            folders.append(e.path)
                    elif e.is_file():
                        paths.append(e.path)
                    if len(paths) == NAMES:
                        yield batch(paths)
                        paths = []
        yield batch(paths)

    return run


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, file_path) to (file_path, html), the bytes of each file."""
    pages = lambda names, read: pa.record_batch([pa.array(names, pa.string()), pa.array(read, pa.binary())], ["file_path", "html"])
    for b in batches:
        names, read, size = [], [], 0
        for path, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            with open(path, "rb", buffering=0) as f:
                page = f.readall()
            if page:
                names.append(name)
                read.append(page)
                size += len(page)
            if size >= BYTES:
                yield pages(names, read)
                names, read, size = [], [], 0
        yield pages(names, read)


def read_html(spark: SparkSession, directory: str, recursive: bool = False, pattern: str = "*.html") -> DataFrame:
    """(file_path, html) of the files of a directory whose name fits the pattern, one file a row.

    On a mounted file system a task lists the names and others, as many as spark.sql.shuffle.partitions, read them: Spark's own
    reader holds all names in the driver and takes four small files or so a task. An empty file gives no row, as there.
    """
    folders = mounted(spark, directory) if PLAIN_NAME.search(pattern) else None
    if not folders or not all(os.path.isdir(f) for f in folders):
        reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
        return reader.text(directory, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("html"))
    ship_package(spark)
    fits = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()
    names = spark.createDataFrame([(f,) for f in folders], "folder string").mapInArrow(_names(recursive), "path binary, file_path string, name string")
    dealt = names.where(F.col("name").rlike(rf"(?s)\A(?:{fits})\z")).select("path", "file_path").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return dealt.mapInArrow(_contents, "file_path string, html binary").select("file_path", F.col("html").cast("string").alias("html"))


def read_metadata(spark: SparkSession, path: str, pattern: str = "*.jsonl", max_documents: int | None = None) -> DataFrame:
    """Pages of JSON-lines files. Blank and malformed lines are skipped; of rows with one file_path the last in file
    order stays; a row without one gets a `doc_<hash>` id. max_documents keeps the first by id (an ordered limit)."""
    rows = spark.read.schema(PAGE).option("mode", "DROPMALFORMED").option("pathGlobFilter", pattern).json(path)
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    keyed = rows.select(F.coalesce("file_path", F.concat(F.lit("doc_"), F.xxhash64(row).cast("string"))).alias("doc_id"), row.alias("row"), at.alias("at"))
    out = keyed.groupBy("doc_id").agg(F.max_by("row", "at").alias("row")).select("doc_id", "row.*")
    return out.orderBy("doc_id").limit(max_documents) if max_documents else out


def read_frontier(spark: SparkSession, path: str) -> DataFrame:
    """The frontier of a CSV file, typed; of rows with one normalized_url the last stays."""
    rows = spark.read.schema(FRONTIER).option("header", True).option("escape", '"').csv(path)
    row = F.struct(*[F.col(c) for c in rows.columns])
    return rows.withColumn("__at", F.monotonically_increasing_id()).groupBy("normalized_url").agg(F.max_by(row, F.col("__at")).alias("r")).select("r.*")


def folder_megabytes(spark: SparkSession, directory: str) -> DataFrame:
    """One row: size_mb of all files below a directory (0 for an empty one); contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory).select("length")
    return files.agg((F.coalesce(F.sum("length"), F.lit(0)) / 1048576).alias("size_mb"))


def dump_links(html: Column, pattern: str) -> Column:
    """Sorted distinct link targets of a listing page that match a pattern, entities decoded."""
    found = F.transform(F.regexp_extract_all(html, F.lit(r'href="([^"]+)"'), 1), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.rlike(pattern))))


# Parts of the names of files that are no root page of a film or of a series.
MOVIE_PARTS = ("cast_and_crew", "reviews", "photos", "clips", "videos", "news")
SERIES_PARTS = ("episodes", "episode", "season", "cast_and_crew", "reviews", "_s0", "_s1", "_s2", "_s3", "_s4", "_s5", "_s6", "_s7", "_s8", "_s9")


def is_root_page(file_path: Column, html: Column | None, site: str, host: str, media: str = "all") -> Column:
    """Whether a file is the root page of a film or series, by its name or, given html, by the canonical URL in its
    first 64 Ki characters (by name where there is none). media: movie, tv or all."""
    name = F.lower(F.substring_index(F.translate(file_path, "\\", "/"), "/", -1))
    none_of = lambda bits: ~name.rlike("|".join(bits))
    ends = name.endswith(".html")
    movie_name = ends & name.startswith(f"{site}_m_") & none_of(MOVIE_PARTS)
    tv_name = ends & (name.startswith(f"{site}_tv_") | name.startswith(f"{site}_series_")) & none_of(SERIES_PARTS)
    pick = {"movie": lambda m, t: m, "tv": lambda m, t: t, "all": lambda m, t: m | t}[media]
    if html is None:
        return pick(movie_name, tv_name)
    head = F.substring(html, 1, 65536)
    found = first_nonempty(match_first(head, r'(?i)<link\s+rel="canonical"\s+href="([^"]+)"'), match_first(head, r'(?i)<meta\s+property="og:url"\s+content="([^"]+)"'), match_first(head, r'(?i)"url"\s*:\s*"([^"]+)"'))
    canonical = F.regexp_replace(F.lower(found), r"[?#].*$", "")
    site_root = r"^(?:https?:)?//(?:www\.)?" + host.replace(".", r"\.")
    movie, tv = canonical.rlike(site_root + r"/m/[^/]+/?$"), canonical.rlike(site_root + r"/(?:tv|series)/[^/]+/?$")
    return F.when(canonical == "", pick(movie_name, tv_name)).otherwise(pick(movie, tv))
