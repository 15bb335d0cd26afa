"""Pages as files: many small ones in few tasks, names and bytes as Spark's own reader gives them, files written once and deleted."""

from __future__ import annotations

import glob
import os

from pyspark.sql import functions as F

from filmloom.plans import extended
from filmloom.sources import readers, writers


def test_small_files_share_tasks(spark, tmp_path):
    for k in range(64):
        (tmp_path / f"{k}.html").write_text(f"<b>{k}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    try:
        pages = readers.read_html(spark, str(tmp_path))
        assert pages.rdd.getNumPartitions() <= 4  # four files of 4 MB a task, before
        assert sorted(r.html for r in pages.collect()) == sorted(f"<b>{k}" for k in range(64))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_names_as_spark_reads_them(spark, tmp_path):
    names = ("a b.html", "ü%20é.html", "q?x#y.html", "[z]{1}.html", "_h.html", ".h.html", "x.html._COPYING_", "n b.html", "w^|`\"<>\\t.html", "d;e=f&g.html", "~!$'()*+,@.html", "x.htm", "empty.html")
    (tmp_path / "sub" / "_no").mkdir(parents=True)
    for n in (*names, "sub/k.html", "sub/_no/k.html"):
        (tmp_path / n).write_bytes(b"" if n == "empty.html" else b"\xff<b>\n" + n.encode())
    os.symlink(tmp_path / "gone", tmp_path / "broken.html")
    for recursive in (False, True):
        for pattern in ("*.html", "[!a]*.html", "?.htm", "*k.html"):
            own = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).text(str(tmp_path), wholetext=True)
            want = sorted(own.select(F.col("_metadata.file_path"), F.hex("value")).collect())
            assert sorted(readers.read_html(spark, str(tmp_path), recursive, pattern).select("file_path", F.hex("html")).collect()) == want


def test_pages_are_written_once(spark, tmp_path):
    texts = [*(f"<p>é{k}\n" for k in range(20)), "", None]
    pages = spark.createDataFrame([(t,) for t in texts], "html string").repartition(3)
    writers.write_pages(pages, str(tmp_path / "out"))
    files = glob.glob(f"{tmp_path}/out/part-*/*", include_hidden=True)
    assert len(files) == len(texts) and all(f.endswith(".txt") for f in files)
    (tmp_path / "out" / "_attempt-7").mkdir()  # of a task that broke off
    (tmp_path / "out" / "_attempt-7" / "0.txt").write_text("x")
    got = readers.read_html(spark, str(tmp_path / "out"), recursive=True, pattern="*.txt").collect()
    assert sorted(r.html for r in got) == sorted((t or "") + "\n" for t in texts)


def test_pages_are_written_over(spark, tmp_path):
    of = lambda *texts: spark.createDataFrame([(t,) for t in texts], "html string").coalesce(1)
    first, second = str(tmp_path / "1"), str(tmp_path / "2")
    writers.write_pages(of("long page", "b", "c"), first)
    writers.write_pages(of("x", "longer than b"), second, first)
    assert sorted(r.html for r in readers.read_html(spark, second, True, "*.txt").collect()) == ["longer than b\n", "x\n"]
    assert not glob.glob(f"{first}/**/*.txt", recursive=True)


def test_scan_in_turns_leaves_no_files(spark, tiny, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(extended, "staged_path", lambda spark, name: made.append(str(tmp_path / f"{name}{len(made)}")) or made[-1])
    once = sorted(extended.html_scan(spark, tiny).collect())
    monkeypatch.setattr(extended, "PAGES_A_PART", 10, raising=False)
    monkeypatch.setattr(extended, "PARTS_A_TURN", 2, raising=False)
    assert sorted(extended.html_scan(spark, tiny).collect()) == once and once
    assert sum("files" in m for m in made) > 2
    assert not glob.glob(f"{tmp_path}/**/*.txt", recursive=True)
