"""Consolidation of a store of many small files into few evenly sized ones.

Steps: freeze a manifest of the store, bin-pack it by size with first-fit
decreasing, rewrite one file per bin, verify row counts and checksums of what
was written against what was planned, and commit by a rename.

The bins span directories. First-fit decreasing is sequential, so the manifest
is dealt by path hash into shards of a bounded number of files; every shard is
packed on its own. A directory that holds a third of all files is thereby spread
over all shards. Within a shard the capacity is lowered as long as the number of
bins stays, which makes the bins even.
"""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filmloom.session import cut

TARGET_BYTES = 128 * 1024 * 1024
SHARD_FILES = 20_000
SMALL_FILE_BYTES = 32_768
MIN_DIR_FILES = 20


def canonical_path(path: Column) -> Column:
    """The path from `data/` on: no outer blanks, single `/`, no `.` or `..`. NULL and blank give NULL.

    A path without a `data` segment keeps all its segments.
    """
    p = F.regexp_replace(F.translate(path, "\\", "/"), r"(?U)^\s+|\s+$", "")
    p = F.regexp_replace(p, r"^[A-Za-z][A-Za-z0-9+.-]*://", "/")
    parts = F.filter(F.split(p, "/"), lambda s: (s != "") & (s != "."))
    resolved = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
            F.concat(acc, F.array(s))
        ),
    )
    tidy = F.when(p.rlike(r"(^|/)\.\.?(/|$)|//|^/|/$"), F.array_join(resolved, "/")).otherwise(p)
    return F.nullif(F.regexp_replace(tidy, r"^.*?(?:^|/)(?=data/)", ""), F.lit(""))


def freeze_manifest(stored: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """One row per distinct stored file: path, store_dir, n_bytes, checksum, named.

    `named` tells whether a row of `urls` names the file. A file listed twice
    counts once, with its latest listing. Rows without a path are dropped.
    The result is written to the shared folder: later listings do not change it.
    """
    listing = (
        stored.select(canonical_path(F.col("file_path")).alias("path"), "n_bytes", "checksum", "modified_at")
        .where("path IS NOT NULL")
        .groupBy("path")
        .agg(F.max(F.struct("modified_at", "n_bytes", "checksum")).alias("last"))
        .select("path", "last.n_bytes", "last.checksum")
    )
    if urls is None:
        listing = listing.withColumn("named", F.lit(True))
    else:
        # Distinct on both sides before the join: a hub page that holds a tenth of the rows is one row here.
        names = (
            urls.where("file_path IS NOT NULL AND file_path <> ''")
            .select("file_path")
            .distinct()
            .select(canonical_path(F.col("file_path")).alias("path"))
            .where("path IS NOT NULL")
            .distinct()
            .withColumn("named", F.lit(True))
        )
        listing = listing.join(names, "path", "left").withColumn("named", F.coalesce("named", F.lit(False)))
    return cut(listing.withColumn("store_dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)))


def _first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """Bin of each size (given in decreasing order) and the number of bins; a larger size has a bin to itself.

    A tournament tree over the bins' free space finds the first bin that fits in O(log n).
    """
    width = 1
    while width < max(1, len(sizes)):
        width *= 2
    free = [capacity] * (2 * width)
    placed, bins = [], 0
    for size in sizes:
        need = min(size, capacity)
        node = 1
        while node < width:
            node *= 2
            if free[node] < need:
                node += 1
        placed.append(node - width)
        bins = max(bins, node - width + 1)
        free[node] -= need
        node //= 2
        while node:
            free[node] = max(free[2 * node], free[2 * node + 1])
            node //= 2
    return placed, bins


def pack_even(sizes: list[int], target: int) -> list[int]:
    """First-fit decreasing at `target`, then at the smallest capacity that needs no more bins.

    Sizes must come in decreasing order.
    """
    placed, bins = _first_fit_decreasing(sizes, target)
    low, high = max([1, *[s for s in sizes if s <= target], -(-sum(min(s, target) for s in sizes) // max(1, bins))]), target
    for _ in range(6):
        if high - low <= target // 100:
            break
        middle = (low + high) // 2
        tried, n = _first_fit_decreasing(sizes, middle)
        # a size between the lowered capacity and the target would count as less than it is: low excludes that
        if n <= bins:
            placed, high = tried, middle
        else:
            low = middle
    return placed


def plan_bins(manifest: DataFrame, target_bytes: int = TARGET_BYTES, shard_files: int = SHARD_FILES) -> DataFrame:
    """The manifest with `bin_id` and `bin_files`, how many files share the bin: every file in exactly one bin, no bin of two
    or more files above target_bytes.

    A missing or negative size counts as 0; a file above the target has a bin to itself. An empty manifest gives
    an empty plan. Shards are sized by count, so a task never holds more than a bounded number of files.
    """
    files = manifest.count()
    shards = max(1, -(-files // shard_files))

    def pack(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "path"], ascending=[False, True], kind="stable")
        local = pd.Series(pack_even(pdf["size"].tolist(), target_bytes), dtype="int64")
        return pd.DataFrame({"path": pdf["path"].to_numpy(), "bin_id": [f"{keys[0]:06d}-{b:06d}" for b in local], "bin_files": local.groupby(local).transform("size").to_numpy()})

    sized = manifest.select(
        "path", F.greatest(F.coalesce("n_bytes", F.lit(0)), F.lit(0)).alias("size"), F.pmod(F.xxhash64("path"), F.lit(shards)).alias("shard")
    )
    placed = sized.groupBy("shard").applyInPandas(pack, "path string, bin_id string, bin_files long")
    return manifest.join(placed, "path")


def small_file_dirs(plan: DataFrame, min_files: int = MIN_DIR_FILES, small_bytes: int = SMALL_FILE_BYTES) -> DataFrame:
    """Directories that the plan consolidates: some named file of them shares its bin with others. Of those, the ones with
    at least min_files named files whose mean size is below small_bytes, with their files, bins and share of a bin
    (n_parts, the number of files they are worth after the rewrite)."""
    return (
        plan.where("named")
        .groupBy("store_dir")
        .agg(
            F.count("*").alias("n_files"),
            F.avg("n_bytes").alias("mean_bytes"),
            F.count_if(F.col("bin_files") > 1).alias("n_consolidated"),
            F.sum(F.lit(1.0) / F.col("bin_files")).alias("n_parts"),
        )
        .where("n_consolidated > 0")
        .where((F.col("n_files") >= min_files) & (F.col("mean_bytes") < small_bytes))
    )


def one_record_per_file(records: DataFrame, path_col: str = "file_path") -> DataFrame:
    """One row per canonical path: exact duplicates once; of differing rows the one with most values, then by hash.

    Rows without a path are dropped. Hot paths are pre-aggregated map-side by max_by.
    """
    names = records.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    filled = sum((F.col(f"`{c}`").isNotNull().cast("int") for c in names), F.lit(0))
    return (
        records.select(row.alias("r"), filled.alias("filled"), canonical_path(F.col(f"`{path_col}`")).alias("__path"))
        .where("__path IS NOT NULL")
        .groupBy("__path")
        .agg(F.max_by("r", F.struct("filled", F.xxhash64("r"))).alias("__row"))
    )


def _digest(columns: list[str], only: Column | None = None) -> Column:
    """An order-free checksum of a group of rows (of those where `only` holds): the sum of 64-bit row hashes, exact as a
    decimal."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in columns]).cast("decimal(38,0)")
    return F.sum(row if only is None else F.when(only, row)).cast("string")


def _rename(spark: SparkSession, source: str, target: str) -> None:
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fs = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"cannot rename {source} to {target}")


def _put_text(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def rewrite(plan: DataFrame, records: DataFrame, out_dir: str, path_col: str = "file_path", allow_missing: bool = True) -> DataFrame:
    """Write the record of every planned file into one file per bin under out_dir and return a report per bin.

    Report: bin_id, n_files, n_bytes (of the pages), n_records, n_missing (files without a record), checksum, verified.
    Every row keeps its file's listed size and checksum (`file_bytes`, `file_checksum`; `record_...` where a record has such
    a column). The rows go to a staging folder and are read back; bin by bin, count and checksum of the contents are held
    against the planned rows, and the paths, sizes and checksums of the files against the frozen plan itself, so that a
    file that was lost, doubled or paired with another's listing on the way is found. Only then the folder is renamed to
    `snapshot-<id>` and a `_COMMITTED-<id>` marker is put beside it: a reader that goes by the markers never sees a part.
    A mismatch, or a file without record unless allow_missing, removes the staging folder and raises.
    """
    spark = plan.sparkSession
    snapshot = uuid.uuid4().hex[:12]
    staging, final = f"{out_dir}/_staging-{snapshot}", f"{out_dir}/snapshot-{snapshot}"
    own = ("bin_id", "__path", "__has", "file_bytes", "file_checksum")
    fields = {f.name: f"record_{f.name}" if f.name in own else f.name for f in records.schema.fields}
    kept = one_record_per_file(records, path_col)
    joined = plan.select("bin_id", F.col("path").alias("__path"), F.col("n_bytes").alias("file_bytes"), F.col("checksum").alias("file_checksum")).join(kept, "__path", "left")
    flat = joined.select("bin_id", "__path", "file_bytes", "file_checksum", F.col("__row").isNotNull().alias("__has"), *[F.col(f"__row.`{name}`").alias(kept_as) for name, kept_as in fields.items()])
    flat = cut(flat.repartition("bin_id"))  # one task per bin, and what is verified is what is written
    names, listed = ["__path", *fields.values()], ["__path", "file_bytes", "file_checksum"]
    planned = flat.groupBy("bin_id").agg(F.count_if("__has").alias("n_records"), _digest(names, F.col("__has")).alias("checksum"), _digest(listed, ~F.col("__has")).alias("missing_listing"))
    frozen = plan.groupBy("bin_id").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"), _digest(["path", "n_bytes", "checksum"]).alias("listing"))
    flat.where("__has").drop("__has").write.partitionBy("bin_id").parquet(staging)
    read = spark.read.schema(flat.drop("__has").schema).parquet(staging)
    got = read.groupBy("bin_id").agg(F.count("*").alias("got_records"), _digest(names).alias("got_checksum"), _digest(listed).alias("got_listing"))
    zero = F.lit(0).cast("decimal(38,0)")
    sum_of = lambda *c: sum((F.coalesce(F.col(x).cast("decimal(38,0)"), zero) for x in c), zero)
    same_rows = (F.coalesce("got_records", F.lit(0)) == F.col("n_records")) & F.col("got_checksum").eqNullSafe(F.col("checksum"))
    same_files = sum_of("got_listing", "missing_listing") == sum_of("listing")
    report = cut(
        frozen.join(planned, "bin_id", "full").join(got, "bin_id", "full").select(
            "bin_id",
            "n_files",
            "n_bytes",
            "n_records",
            (F.col("n_files") - F.col("n_records")).alias("n_missing"),
            "checksum",
            F.coalesce(same_rows & same_files, F.lit(False)).alias("verified"),
        )
    )
    bad = report.where("NOT verified").limit(5).collect()
    lost = [] if allow_missing else report.where("n_missing > 0").limit(5).collect()
    if bad or lost:
        _delete(spark, staging)
        raise ValueError(f"rewritten bins differ from the plan: {[r.bin_id for r in bad]}" if bad else f"files without a record in bins {[r.bin_id for r in lost]}")
    _rename(spark, staging, final)
    _put_text(spark, f"{out_dir}/_tmp-{snapshot}", json.dumps({"snapshot": snapshot, "path": final}))
    _rename(spark, f"{out_dir}/_tmp-{snapshot}", f"{out_dir}/_COMMITTED-{snapshot}")
    return report
