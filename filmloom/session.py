"""Session settings, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def get_session(app: str = "filmloom", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the defaults the operators are written for (AQE on, UTC)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever the session was started from."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="filmloom-"), "filmloom.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(base, name)
                    z.write(path, os.path.join("filmloom", os.path.relpath(path, root)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local session (tests, one machine) gets a
    folder of its own; a cluster has no folder that would do, and that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        if not spark.sparkContext.getCheckpointDir():  # set on the session only
            spark.sparkContext.setCheckpointDir(found)
        return found
    found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="filmloom-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder, so that a lost executor costs no recomputation of its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _staged_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/filmloom-staged/{spark.sparkContext.applicationId}"


def staged_path(spark: SparkSession, name: str = "table") -> str:
    """A new path in the shared folder that drop_staged() will remove."""
    return f"{_staged_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write df as a columnar table in the shared folder and read it from there: a lineage cut that later steps can
    read by column. Removed with the session's other staged tables by drop_staged()."""
    path = staged_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Delete all staged tables and checkpoints of this application; results that still read from them must have been
    written."""
    for folder in (_staged_root(spark), spark.sparkContext.getCheckpointDir()):  # the latter is this application's own
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if folder == _staged_root(spark):
            files.delete(path, True)
        else:
            for part in files.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, "rdd-*")) or []:
                files.delete(part.getPath(), True)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a staged folder whose rows have been written elsewhere."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def mounted(spark: SparkSession, path: str) -> list[str] | None:
    """The folders that a path or glob names, or the path itself where nothing is there, if the file system is a mounted one
    (scheme file), whose files a task may open itself; else, and where one is a file, None."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getUri().getScheme() != "file":
        return None
    found = list(files.globStatus(p) or [])
    plain = [s.getPath().toUri().getPath() for s in found] or [files.makeQualified(p).toUri().getPath()]
    return plain if all(s.isDirectory() for s in found) else None


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table of a data directory, pruned to the columns named."""
    ship_package(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[f"`{c}`" for c in columns]) if columns else df
