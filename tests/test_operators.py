"""Linkage, index, search, frontier, reports and ledger on small tables."""

from __future__ import annotations

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from filmloom.functions import html
from filmloom.operators import frontier, index, linking, reports, search
from filmloom.sources import readers, writers
from filmloom.streaming import ledger

RT = "file_path string, page_type string, title string, title_norm string, rt_year bigint, tomatometer bigint, audience_score bigint, url string"
WIKI = "wiki_page_id string, wiki_title string, wiki_title_norm string, wiki_year int"


def test_linkage(spark):
    rt = spark.createDataFrame(
        [(f"f{i}", "movie", t, t, y, 1, 1, "u") for i, (t, y) in enumerate([("alpha", 1999), ("alpha", None), ("alpha", 2005), ("big red dog", 2001), ("big red dogs", 2001), ("", 1999)])] + [("g", "critic", "alpha", "alpha", 1999, 1, 1, "u")], RT
    )
    wiki = spark.createDataFrame([("1", "Alpha", "alpha", 1999), ("2", "Big", "big redd dog", 2001), ("3", "Big", "big yellow dog", 2001), ("4", "Я", "", 1999)], WIKI)
    got = {(r.file_path, r.wiki_page_id, r.join_confidence) for r in linking.all_links(rt, wiki).collect()}
    assert got == {("f0", "1", 2), ("f1", "1", 1), ("f3", "2", 2)}
    assert linking.exact_links(rt, wiki, match_empty_titles=True).where("file_path = 'f5'").count() == 1
    report = linking.link_report(rt, wiki, linking.all_links(rt, wiki)).collect()[0]
    assert (report.rt_pages, report.wiki_pages, report.linked_wiki_pages, report.links) == (6, 4, 2, 3)
    assert linking.all_links(rt.limit(0), wiki.limit(0)).count() == 0


DOCS = "doc_id string, title string, synopsis string, genres array<string>, page_type string"


def test_weights(spark):
    docs = spark.createDataFrame([("d", "dog dog cat", "dog", None, "movie"), ("e", None, None, [], "tv")], DOCS)
    postings, lengths = index.build(docs)
    assert {(r.term, r.doc_id): r.wtf for r in postings.collect()} == {("dog", "d"): 5.0, ("cat", "d"): 3.0}
    assert {r.doc_id: r.dl for r in lengths.collect()} == {"d": 4, "e": 0}


@pytest.mark.parametrize(("df", "want"), [(3, (math.log(10 / 3), math.log(7.5 / 3.5), math.log(1 + 7.5 / 3.5), math.log(1 + 10 / 4))), (8, (math.log(10 / 8), 0, math.log(1 + 2.5 / 8.5), math.log(1 + 10 / 9))), (10, (0, 0, math.log(1 + 0.5 / 10.5), math.log(1 + 10 / 11))), (0, (0, 0, 0, 0))])
def test_idf(spark, df, want):
    row = spark.range(1).select(*[index.idf(m, F.lit(10), F.lit(df), F.lit(10)).alias(m) for m in index.METHODS]).collect()[0]
    assert row == pytest.approx(want)


def test_search_and_upsert(spark):
    docs = spark.createDataFrame([("a", "red fox", "fox den", ["Drama"], "movie"), ("b", "red hen", "fox", [], "tv"), ("c", "blue", "sea", [], "tv"), ("d", "sky", "", [], "tv"), ("e", "tree", "", [], "tv")], DOCS)
    p, n = index.build(docs)
    assert [r.doc_id for r in index.search(p, n, "fox", bm25=True).collect()] == ["a", "b"]
    assert [r.doc_id for r in index.search(p, n, "fox", only=docs.where("page_type = 'tv'")).collect()] == ["b"]
    assert index.search(p, n, "the of").count() == 0
    p2, n2 = index.upsert(p, n, docs.where("doc_id = 'a'").withColumn("title", F.lit("green owl")))
    assert {r.doc_id for r in index.search(p2, n2, "owl").collect()} == {"a"} and n2.count() == 5
    assert index.compare(p, n, "fox").count() == 10


def test_saved_index(spark, tmp_path):
    """A saved index searches as the one in hand; appended documents are found, replaced ones only as they are now."""
    docs = spark.createDataFrame([(f"d{i}", f"word{i % 7} fox", "den" if i % 2 else None, [], "tv") for i in range(40)], DOCS)
    path = str(tmp_path / "index")
    with pytest.raises(ValueError):
        index.load(spark, path)
    p, n = index.build(docs)
    assert index.save(p, n, path) == 1
    rows = lambda pair, q, **o: [tuple(r) for r in index.search(*pair, q, **o).collect()]
    assert rows(index.load(spark, path), "fox word3 den", bm25=True) == rows((p, n), "fox word3 den", bm25=True)
    change = spark.createDataFrame([("d1", "green owl", None, [], "tv"), ("new", "owl nest", None, [], "tv")], DOCS)
    assert index.append(change, path) == 2
    loaded, wanted = index.load(spark, path), index.upsert(p, n, change)
    for q in ("owl", "fox", "word1 den"):
        for m in index.METHODS:
            assert rows(loaded, q, method=m, k=None) and sorted(rows(loaded, q, method=m, k=None)) == sorted(rows(wanted, q, method=m, k=None))
    assert index.statistics(*loaded).collect() == index.statistics(*wanted).collect()
    hits = index.with_documents(index.search(*loaded, "owl"), change.select("doc_id", "title")).collect()
    assert {(r.doc_id, r.title) for r in hits} == {("d1", "green owl"), ("new", "owl nest")}
    plan = index.load(spark, path)[0].where(F.col("term").isin(["owl"]))._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan or "EqualTo(term" in plan
    assert index.save(p, n, path) == 3 and index.statistics(*index.load(spark, path)).collect() == index.statistics(p, n).collect()
    # every method of one pass as by itself
    both = {(r.method, r.doc_id, r.score) for r in index.compare(p, n, "fox den word2").collect()}
    assert both == {(m, d, s) for m in ("bm25", *index.METHODS) for d, s in rows((p, n), "fox den word2", method=m if m != "bm25" else "standard", bm25=m == "bm25", k=5)}


FULL = "doc_id string, file_path string, page_type string, url string, title string, synopsis string, genres array<string>, wiki_title string, director string, cast array<string>, release_year int, tomatometer bigint, audience_score bigint, runtime_minutes int, join_confidence int, genres_text string"


def test_query_language(spark):
    rows = [(k, k, "movie", "", t, s, ["Drama"], None, "Ann", ["Bo"], y, 50, 50, None, 2, "Drama") for k, t, s, y in (("a", "The Red House", "old house red", 1990), ("b", "House Red", "a barn", 2000), ("c", "Blue Horse", "", 2010), ("d", None, None, None))]
    docs = spark.createDataFrame(rows, FULL)
    ids = lambda q, w=None: [r.doc_id for r in search.search(docs, q, w).collect()]
    assert set(ids("house")) == {"a", "b"} and ids('"red house"') == ["a"] and ids("house -barn") == ["a"]
    assert ids("+house +barn") == ["b"] and ids("hors~1 -house") == ["c"] and ids("title:blue") == ["c"] and set(ids("ho*")) == {"a", "b", "c"}
    assert ids("house", search.passes(years=(1995, 2020))) == ["b"] and ids("") == [] and ids("house AND barn") == ["b"] and ids("house NOT barn") == ["a"]
    assert set(ids("h?use")) == {"a", "b"} and ids("b*e") == ["c"] and set(ids("title:[blue TO house]")) == {"a", "b", "c"} and ids("title:{blue TO horse]") == ["c"] and ids("title:[red TO *]") and ids("title:{house TO reda}")
    assert set(ids("(red OR blue) AND (horse OR barn)")) == {"b", "c"} and ids("+(red blue) -(barn old)") == ["c"] and ids("title:(blue horse)") == ["c"] and ids("()") == [] and set(ids("(house")) == {"a", "b"}
    assert ids("house (barn)^9") == ["b", "a"] and ids("(+house +(barn OR nothing))") == ["b"]
    with pytest.raises(ValueError):
        search.parse_query("nofield:x")
    with pytest.raises(ValueError):
        search.parse_query("(" * 60 + "x")


URLS = "url string, normalized_url string, status string, depth int, discovered_at timestamp_ntz, crawled_at timestamp_ntz, retry_count int, file_path string, response_code int, error_message string"


def test_frontier(spark):
    t = datetime(2024, 1, 1)
    f = spark.createDataFrame([("q", "q", "queued", 0, t, None, 0, None, None, None), ("r", "r", "queued", 0, t, None, 1, None, None, None), ("f", "f", "failed", 0, t, t, 0, None, 500, "x"), ("c", "c", "crawled", 0, t, t, 0, "p", 200, None)], URLS)
    assert {r.url: r.status for r in frontier.recover(f, 1).collect()} == {"q": "discovered", "r": "queued", "f": "failed", "c": "crawled"}
    d = spark.createDataFrame([("b", "b", "discovered", 1, t, None, 0, None, None, None), ("a", "a", "discovered", 1, t, None, 0, None, None, None), ("z", "z", "discovered", 0, t, None, 0, None, None, None)], URLS)
    assert [r.url for r in frontier.next_batch(d, 2).collect()] == ["z", "a"]
    assert {r.normalized_url for r in frontier.latest(f.unionByName(f).unionByName(d)).collect()} == set("qrfcbaz")
    found = spark.createDataFrame([("http://www.e.com/a/", 2, t), ("https://e.com/a", 1, t), (None, 1, t)], "url string, depth int, discovered_at timestamp_ntz")
    new = frontier.insert_new(d, found).collect()
    assert [(r.normalized_url, r.depth) for r in new] == [("https://e.com/a", 1)]
    assert frontier.latest(f.limit(0)).count() == 0 and frontier.figures(f.limit(0)).collect()[0].total == 0


def test_rate_window_across_hours(spark):
    """Windows that reach into the hour before are whole: against counting one by one."""
    import random

    rng = random.Random(3)
    times = [(k, k % 2, 1_700_000_000 + rng.randrange(3 * 3600)) for k in range(300)]
    e = spark.createDataFrame(times, "id int, u int, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: (r.last_minute, r.last_hour) for r in frontier.rate_windows(e, ["u"], "ts", 10, 1500).collect()}
    for k, u, s in times:
        assert got[k] == tuple(sum(1 for _, v, t in times if v == u and 0 < s - t < w) for w in (60, 3600))


def test_known(spark):
    f = spark.createDataFrame([("https://e.com/a",)], "normalized_url string")
    urls = spark.createDataFrame([("http://www.e.com/a/",), ("https://e.com/b",), (None,)], "url string")
    assert {r.url: r.is_known for r in frontier.known(f, urls).collect()} == {"http://www.e.com/a/": True, "https://e.com/b": False, None: False}


def test_rate_window(spark):
    e = spark.createDataFrame([(k, 1, datetime(2024, 1, 1, 0, 0, s)) for k, s in enumerate((0, 0, 30, 59))] + [(9, 1, datetime(2024, 1, 1, 0, 1, 0))], "id int, u int, ts timestamp")
    got = {r.id: (r.last_minute, r.must_wait) for r in frontier.rate_windows(e, ["u"], "ts", 10, 1500).collect()}
    assert got[0][0] == 0 and got[2][0] == 2 and got[9][0] == 2 and not any(w for _, w in got.values())


def test_reports(spark):
    s = "file_path string, page_type string, title string, url string, description string, synopsis string, tomatometer bigint, audience_score bigint, genres array<string>, cast array<string>"
    p = spark.createDataFrame([("a", "movie", "", "u", None, None, 0, None, [], None), ("b", None, "t", None, "two words", "", 50, 60, ["x"], ["y"])], s)
    assert {(r.file_path, r.issue) for r in reports.issues(p).collect()} == {("a", "missing_title"), ("a", "missing_scores"), ("a", "missing_genres"), ("a", "missing_description"), ("b", "missing_url")}
    assert {r.field: r.percent for r in reports.completeness(p).collect()}["title"] == 50.0
    assert reports.token_counts(p).collect()[0].total_tokens == 2
    by_vocabulary = reports.token_counts(p.withColumn("synopsis", F.lit("unbelievably so")), "/opt/tokenizers/byte_bpe_50k.tiktoken").collect()[0]
    assert by_vocabulary.description_tokens == 2 and by_vocabulary.synopsis_tokens > 4
    assert reports.completeness(p.limit(0)).collect()[0].percent is None
    assert writers.metadata_rows(p).where("file_path = 'a'").collect()[0].cast == ""


def test_ledger_and_stream(spark, tmp_path):
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "file_path string")
    log = spark.createDataFrame([("a", "processed", 1), ("b", "failed", 1), ("b", "failed", 2), ("c", "failed", 1), ("c", "processed", 2)], "file_path string, state string, at int")
    assert [r.file_path for r in ledger.to_process(files, log).collect()] == []
    assert [r.file_path for r in ledger.to_process(files, log, include_failed=True).collect()] == ["b"]
    assert [r.file_path for r in ledger.to_process(files, log, only_failed=True).collect()] == ["b"]
    src = tmp_path / "in"
    src.mkdir()
    extract = lambda df: html.extract_pages(df, "site").select("file_path", "title", "page_type")
    for k, want in ((1, 1), (2, 2)):
        (src / f"site_m_{k}.html").write_text(f"<title>T{k} | S</title>")
        ledger.stream_pages(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp"), extract).awaitTermination(60)
        assert spark.read.parquet(str(tmp_path / "out")).count() == want


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"file_path":"a","title":"x"}\n\nnot json\n{"file_path":"a","title":"y"}\n{"title":"z"}\n')
    got = readers.read_metadata(spark, str(tmp_path)).collect()
    assert sorted((r.title or "") for r in got) == ["y", "z"]
    (tmp_path / "u.csv").write_text("url,normalized_url,status,depth,discovered_at,crawled_at,retry_count,file_path,response_code,error_message\na,k,queued,1,,,0,,,\nb,k,crawled,1,,,0,,200,\n")
    assert [r.status for r in readers.read_frontier(spark, str(tmp_path / "u.csv")).collect()] == ["crawled"]
    (tmp_path / "p.html").write_text("<b>")
    assert readers.read_html(spark, str(tmp_path)).collect()[0].html == "<b>"
    assert readers.folder_megabytes(spark, str(tmp_path)).collect()[0].size_mb > 0
    df = spark.createDataFrame([("a", "b", ["x", "y"], None)], "file_path string, wiki_page_id string, genres array<string>, cast array<string>")
    writers.write_sample(df, str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).collect()[0].genres == "x|y"
