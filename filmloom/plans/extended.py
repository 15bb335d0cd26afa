"""Queries over pages in other markup, round trips through files, the saved index and multi-field search, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filmloom.functions import html as H
from filmloom.functions import text as X
from filmloom.operators import frontier as R
from filmloom.operators import index as I
from filmloom.operators import linking as L
from filmloom.operators import reports as S
from filmloom.operators import search as Q
from filmloom.plans import catalogue as C
from filmloom.session import drop_path, load, stage, staged_path
from filmloom.sources import readers, wiki_dump, writers
from filmloom.streaming import ledger

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register a function under its name, with the SQL that tells the same."""

    def wrap(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return wrap


def _cat(*parts) -> Column:
    """Parts of a page one after the other; a part that is NULL is not there."""
    return F.concat(*[F.coalesce(F.lit(p) if isinstance(p, str) else p, F.lit("")) for p in parts])


def _if(value: Column, *parts) -> Column:
    """The parts, where a value is told."""
    return F.when(F.coalesce(value.cast("string"), F.lit("")) != "", _cat(*parts))


clean = lambda x: C.SQL_CLEAN.format(x=x)
SQL_URL_TYPE = "CASE WHEN contains(lower(url), '/m/') THEN 'movie' WHEN contains(lower(url), '/tv/') OR contains(lower(url), '/series/') THEN 'tv' WHEN contains(lower(url), '/celebrity/') THEN 'celebrity' WHEN contains(lower(url), '/critic') THEN 'critic' ELSE 'unknown' END"
PAGE_COLUMNS = ("file_path", "page_type", "url", "title", "release_date", "director", "cast", "genres", "tomatometer", "audience_score", "synopsis", "description", "rating", "runtime", "has_bad_json")


def _extracted(pages: DataFrame) -> DataFrame:
    out = H.extract_pages(pages, C.SITE).withColumns({"cast": F.array_join(F.array_sort("cast"), "|"), "genres": F.array_join("genres", "|")})
    return out.select(*PAGE_COLUMNS).distinct()


SQL_ISLANDS = f"""
WITH c AS (SELECT DISTINCT * FROM rt), m AS (SELECT *, page_type IN ('movie', 'tv') AS media FROM c)
SELECT 'pages/' || CASE page_type WHEN 'celebrity' THEN 'celebrity' WHEN 'critic' THEN 'critics' ELSE 'x' END || '/' || md5(file_path) || '.html' AS file_path, page_type, {clean('url')} AS url, CASE WHEN media THEN {clean('title')} ELSE '' END AS title,
 CASE WHEN media THEN coalesce(CAST(rt_year AS VARCHAR), '') END AS release_date, CASE WHEN media THEN {clean('director')} END AS director,
 CASE WHEN media THEN array_to_string(list_sort(list_distinct(list_filter(list_transform(coalesce("cast", []), lambda x: trim(replace(x, '<', ''))), lambda x: x <> ''))), '|') END AS "cast",
 CASE WHEN media THEN array_to_string(coalesce(genres, []), '|') END AS genres, CASE WHEN media THEN coalesce(tomatometer, 0) END AS tomatometer, CASE WHEN media THEN coalesce(audience_score, 0) END AS audience_score,
 CASE WHEN media THEN {clean("coalesce(nullif(synopsis, ''), description)")} END AS synopsis, trim(coalesce(description, '')) AS description,
 CASE WHEN media THEN CASE WHEN regexp_matches(rating, '^(G|PG|PG-13|R|NC-17|TV-(Y7-FV|Y7|Y|G|PG|14|MA))$') THEN rating ELSE '' END END AS rating, CASE WHEN media THEN coalesce(runtime, '') END AS runtime, FALSE AS has_bad_json FROM m"""


@query(SQL_ISLANDS)
def html_islands(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose facts stand in a hero island that must be repaired, in an @graph behind a broken script, in slots and in
    person tags; their type by mediatype, by the graph or by the path."""
    rt = load(spark, d, "rt").distinct()
    media = F.col("page_type").isin("movie", "tv")
    hero = F.to_json(F.struct(F.struct(F.col("title"), F.array("rating", F.col("rt_year").cast("string"), "runtime").alias("metadataProps"), F.col("genres").alias("metadataGenres")).alias("content")))
    kind = F.when(F.col("page_type") == "movie", "Film").when(F.col("page_type") == "tv", "TVSeries").otherwise("Person")
    person = F.when(F.col("director").isNotNull(), F.array(F.struct(F.col("director").alias("name")), F.struct(F.col("director").alias("name"))))
    thing = F.struct(kind.alias("@type"), F.col("url"), F.when(media, person).alias("director"), F.when(media, F.struct(F.col("tomatometer").alias("ratingValue"))).alias("aggregateRating"))
    graph = F.to_json(F.struct(F.lit("x").alias("@context"), F.array(thing).alias("@graph")))
    cast = F.array_join(F.transform("cast", lambda n: F.concat(F.lit('<a data-qa="person-name" href="#">'), F.replace(n, F.lit("<"), F.lit("")), F.lit("</a>"))), "\n")
    page = _cat(
        '<html><meta property="og:description" content="', F.col("description"), '">', F.when(F.col("page_type") == "movie", '<div mediatype="Movie"></div>'),
        F.when(media, _cat('<script id="media-hero-json" type="application/json"> <b>', F.replace(hero, F.lit('"'), F.lit("&quot;")), "</b></script>")),
        '<script type="application/ld+json">{"@type": </script><script type="application/ld+json">', graph, "</script>",
        _if(F.col("audience_score"), '<rt-text class="x" slot="audienceScore"> ', F.col("audience_score").cast("string"), "% </rt-text>"),
        _if(F.col("synopsis"), '<div class="y" slot="description"><rt-text class="z">', F.col("synopsis"), "</rt-text></div>"), cast,
    )
    folder = F.when(F.col("page_type") == "celebrity", "celebrity").when(F.col("page_type") == "critic", "critics").otherwise("x")
    return _extracted(rt.select(F.concat(F.lit("pages/"), folder, F.lit("/"), F.md5("file_path"), F.lit(".html")).alias("file_path"), page.alias("html")))


SQL_TAGS = f"""
WITH c AS (SELECT DISTINCT * FROM rt), t AS (SELECT * EXCLUDE page_type, {SQL_URL_TYPE} AS page_type FROM c), m AS (SELECT *, page_type IN ('movie', 'tv') AS media FROM t)
SELECT 'x/' || md5(file_path) AS file_path, page_type, {clean('url')} AS url, {clean('title')} AS title, CASE WHEN media THEN {clean("replace(release_date, '<', '')")} END AS release_date, CASE WHEN media THEN {clean('director')} END AS director,
 CASE WHEN media THEN array_to_string(list_sort(list_distinct(list_filter(list_transform(coalesce("cast", []), lambda x: {clean('x')}), lambda x: x <> ''))), '|') END AS "cast",
 CASE WHEN media THEN coalesce(genres[1], '') END AS genres, CASE WHEN media THEN coalesce(tomatometer, 0) END AS tomatometer, CASE WHEN media THEN coalesce(audience_score, 0) END AS audience_score,
 CASE WHEN media THEN {clean('description')} END AS synopsis, trim(coalesce(description, '')) AS description, CASE WHEN media THEN coalesce(rating, '') END AS rating, CASE WHEN media THEN coalesce(runtime, '') END AS runtime, length(title) % 7 = 0 AS has_bad_json FROM m"""


@query(SQL_TAGS)
def html_tags(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose facts stand in og: tags, <time>, labelled details, slots, nested lists of objects; some with a hero island
    that cannot be repaired."""
    rt = load(spark, d, "rt").distinct()
    detail = lambda label, v: _if(v, "<dt><rt-text>", label, '</rt-text> </dt> <dd class="q"> <rt-text class="w" data-qa="item-value">', v, "</rt-text></dd>")
    film = F.struct(
        F.lit("TVSeries").alias("@type"), F.col("genres")[0].alias("genre"), F.lower(F.replace(F.col("rating"), F.lit("G-13"), F.lit("G13"))).alias("contentRating"),
        F.when(F.col("director").isNotNull(), F.struct(F.col("director").alias("name"))).alias("director"), F.transform("cast", lambda n: F.struct(n.alias("name"))).alias("actor"),
    )
    card = F.to_json(F.struct(F.struct(F.lit("N/A").alias("score")).alias("criticsScore"), F.struct(F.col("audience_score").cast("string").alias("score")).alias("audienceScore")))
    odd = F.length("title") % 2 == 1
    good = F.length("title") % 7 != 0
    page = _cat(
        '<html><meta property="og:url" content="', F.col("url"), '"><meta name="description" content="', F.col("description"), '">', F.when(odd, _cat("<sr-text> ", F.col("title"), "\n</sr-text>")).otherwise(_cat('<meta property="og:title" content="', F.col("title"), '">')),
        _if(F.col("tomatometer"), '<rt-text slot="criticsScore" size="1">', F.col("tomatometer").cast("string"), "</rt-text>"), _if(F.col("runtime"), '<time class="t" datetime="PT', F.upper(F.replace(F.col("runtime"), F.lit(" "), F.lit(""))), '">'),
        detail("Release Date (Theaters)", F.when(odd, F.replace(F.col("release_date"), F.lit("<"), F.lit("")))), detail("Release Date", F.when(~odd, F.replace(F.col("release_date"), F.lit("<"), F.lit("")))), detail("Runtime", F.lit("1h 1m")),
        F.when(good, _cat('<script id="media-scorecard-json">', card, "</script>")).otherwise(_cat('<script id="media-hero-json">{"content": oh</script><rt-text slot="audienceScore">', F.coalesce(F.col("audience_score"), F.lit(0)).cast("string"), "</rt-text>")),
        '<script data-x type="application/ld+json">[{"@type":"Thing"},[', F.to_json(film), "]]</script>",
    )
    return _extracted(rt.select(F.concat(F.lit("x/"), F.md5("file_path")).alias("file_path"), page.alias("html")))


# ---- encyclopedia

_PLAIN = r"[^\p{L}\p{N} .-]+"
SQL_PLAIN = "trim(regexp_replace(regexp_replace({x}, '[^\\p{{L}}\\p{{N}} .-]+', ' ', 'g'), ' +', ' ', 'g'))"


def sql_plain_list(c: str) -> str:
    """Names without marks; the name of the list template, where a value holds it, is no part of an item."""
    one = f"trim(regexp_replace({SQL_PLAIN.format(x='x')}, '\\bplain *list\\b *', '', 'gi'))"
    return f"array_to_string(list_sort(list_distinct(list_filter(list_transform(coalesce({c}, []), lambda x: {one}), lambda x: x <> ''))), '|')"


@query(
    "SELECT DISTINCT wiki_page_id, wiki_title, CASE WHEN wiki_year BETWEEN 1900 AND 2099 THEN wiki_year END AS wiki_year, "
    + ", ".join(f"{sql_plain_list(c)} AS {c}" for c in ("wiki_directors", "wiki_starring", "wiki_languages", "wiki_countries"))
    + ", CASE WHEN wiki_year BETWEEN 1900 AND 2099 THEN CAST(wiki_year AS VARCHAR) || ' (premiere)' ELSE '(premiere)' END AS wiki_released_raw, wiki_runtime_minutes,"
    " 'US$ ' || coalesce(wiki_runtime_minutes, 7) || ' million' AS wiki_budget, 'about ' || coalesce(wiki_runtime_minutes, 7) || ' crore' AS wiki_box_office FROM wiki"
)
def wiki_markup(spark: SparkSession, d: str) -> DataFrame:
    """Infoboxes with nested templates, links, references, entities and other spellings of the parameters, among pages that
    are no films' (talk pages, redirects, pages without infobox)."""
    w = load(spark, d, "wiki").distinct()
    names = lambda c: F.filter(F.transform(c, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, _PLAIN, " "), " +", " "))), lambda x: x != "")
    wrapped = lambda c, a, z, sep: F.array_join(F.transform(names(c), lambda x: F.concat(F.lit(a), x, F.lit(z))), sep)
    year = F.when(F.col("wiki_year").between(1900, 2099), F.concat(F.lit("{{Film date|"), F.col("wiki_year").cast("string"), F.lit("|6|5}}")))
    minutes = F.col("wiki_runtime_minutes").cast("string")
    text = _cat(
        "{{Infobox film\n| directors = {{Plainlist|\n* ", wrapped("wiki_directors", "[[Q (person)|", ']]<ref name="q" />', "\n* "), "\n}}\n| starring = {{ubl|", wrapped("wiki_starring", "{{nowrap|[[", "]]}}", "|"),
        "}}\n|language = ", wrapped("wiki_languages", "", "<!-- x --><ref>a, b</ref>", ", "), "\n| country= ", wrapped("wiki_countries", "", "", "; "), "\n| released = ", year, " (premiere)\n",
        _if(minutes, "| running time = {{Running time|", minutes, " minutes|abroad}}\n"), "| budget = US$&nbsp;", F.coalesce(minutes, F.lit("7")), '<br/>million<ref group="x">[[n]]</ref>\n| gross = [[Box|about ', F.coalesce(minutes, F.lit("7")), "]] crore\n}}\nA film.\n",
    )
    films = w.select(F.col("wiki_page_id").alias("page_id"), F.col("wiki_title").alias("title"), text.alias("text"))
    other = films.select("page_id", F.concat(F.lit("Talk:"), "title").alias("title"), "text").unionByName(films.select("page_id", "title", F.concat(F.lit("#REDIRECT [[x]]\n"), "text").alias("text")))
    other = other.unionByName(films.select("page_id", "title", F.lit("No infobox here.").alias("text"))).unionByName(films.select("page_id", F.lit(None).cast("string").alias("title"), "text"))
    out = wiki_dump.film_records(films.unionByName(other))
    lists = {c: F.array_join(F.array_sort(c), "|") for c in ("wiki_directors", "wiki_starring", "wiki_languages", "wiki_countries")}
    return out.withColumns(lists).select("wiki_page_id", "wiki_title", "wiki_year", *lists, "wiki_released_raw", "wiki_runtime_minutes", "wiki_budget", "wiki_box_office").distinct()


@query("SELECT DISTINCT wiki_page_id, wiki_runtime_minutes FROM wiki")
def dump_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Pages written as a compressed XML dump, read back and parsed."""
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = _cat("  <page>\n    <title>", escaped(F.col("title")), "</title>\n    <ns>0</ns>\n    <id>", F.col("page_id"), "</id>\n    <revision><id>1</id><text bytes=\"9\">", escaped(F.col("text")), "</text></revision>\n  </page>")
    path = staged_path(spark, "dump")
    C.wiki_pages_of(spark, d).select(page.alias("value")).write.option("compression", "bzip2").text(path)
    return wiki_dump.film_records(wiki_dump.read_pages(spark, path)).select("wiki_page_id", "wiki_runtime_minutes").distinct()


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def token_stats_bpe(spark: SparkSession, d: str) -> DataFrame:
    """Token counts by a public vocabulary, which SQL has not."""
    return S.token_counts(load(spark, d, "rt", "description", "synopsis"), VOCABULARY)


QUERIES["token_stats_bpe"] = token_stats_bpe

# ---- files

# Pages in a staged part, and parts whose pages are files at one time (65,536, or 0.27 GB of disk in blocks of 4 KB).
PAGES_A_PART, PARTS_A_TURN = 4096, 16
SQL_ONE_PAGE = "d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY tomatometer DESC NULLS LAST, audience_score DESC NULLS LAST) AS rn FROM rt WHERE file_path IS NOT NULL) WHERE rn = 1)"


def _one_page(spark: SparkSession, d: str) -> DataFrame:
    return I.documents_of(load(spark, d, "rt")).withColumnRenamed("doc_id", "file_path")


@query(f"WITH {SQL_ONE_PAGE} SELECT file_path AS doc_id, file_path, page_type, title, tomatometer, array_to_string(coalesce(genres, []), '|') AS genres, rating FROM d")
def metadata_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Pages written as JSON lines in batches and read back, beside lines that are blank or no JSON."""
    path = staged_path(spark, "metadata")
    writers.write_json_batches(_one_page(spark, d), path, 500)
    spark.createDataFrame([("",), ("not json",)], "value string").coalesce(1).write.mode("append").text(path)
    return readers.read_metadata(spark, path, "part-*").select("doc_id", "file_path", "page_type", "title", "tomatometer", F.array_join(F.coalesce("genres", F.array().cast("array<string>")), "|").alias("genres"), "rating")


@query(f"WITH {C.SQL_LATEST} SELECT normalized_url, url, status, depth, coalesce(retry_count, 0) AS retry_count, coalesce(file_path, '') AS file_path, response_code, epoch_us(discovered_at) AS discovered_us FROM l")
def frontier_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The frontier written as a CSV snapshot and read back."""
    path = staged_path(spark, "frontier")
    out = R.latest(load(spark, d, "urls"))
    writers.write_frontier(out, path)
    back = readers.read_frontier(spark, path)
    return back.select("normalized_url", "url", "status", "depth", F.coalesce("retry_count", F.lit(0)).alias("retry_count"), F.coalesce("file_path", F.lit("")).alias("file_path"), "response_code", F.unix_micros("discovered_at").alias("discovered_us"))


@query(f"WITH {SQL_ONE_PAGE} SELECT {clean('url')} AS url, {clean('title')} AS title FROM d")
def html_scan(spark: SparkSession, d: str) -> DataFrame:
    """Pages written one to a file, scanned as whole files and extracted; in turns, each over the files of the one before,
    because a file takes a block of disk however short it is."""
    pages, out = staged_path(spark, "pages"), staged_path(spark, "scanned")
    C.pages_of(spark, d, _one_page(spark, d)).select("html").write.option("maxRecordsPerFile", PAGES_A_PART).parquet(pages)
    parts = sorted(f"{pages}/{f.rsplit('/', 1)[-1]}" for f in spark.read.schema("html string").parquet(pages).inputFiles())
    used = None
    for k in range(0, len(parts), PARTS_A_TURN):
        path = staged_path(spark, "files")
        writers.write_pages(spark.read.schema("html string").parquet(*parts[k : k + PARTS_A_TURN]), path, used)
        if used:
            drop_path(spark, used)
        H.extract_pages(readers.read_html(spark, path, recursive=True, pattern="*.txt"), C.SITE).select("url", "title").write.mode("append").parquet(out)
        used = path
    drop_path(spark, used)
    drop_path(spark, pages)
    return spark.read.schema("url string, title string").parquet(out)


@query("SELECT coalesce(page_type, 'unknown') AS page_type, count(*) AS n FROM rt GROUP BY 1")
def report_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = staged_path(spark, "report")
    pages = load(spark, d, "rt", *S.COMPLETE_FIELDS, "page_type")
    writers.write_report({"page_types": S.page_types(pages), "completeness": S.completeness(pages)}, path)
    return spark.read.schema("page_type string, n long").json(f"{path}/page_types")


@query("SELECT wiki_page_id, wiki_title, wiki_year FROM wiki")
def table_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = staged_path(spark, "snapshot")
    for _ in range(2):  # the second takes the place of the first
        writers.write_table(load(spark, d, "wiki"), path)
    return spark.read.parquet(path).select("wiki_page_id", "wiki_title", "wiki_year")


@query("SELECT file_path, array_to_string(list_sort(list_distinct([url || '?a&b', url])), ' ') AS links FROM (SELECT DISTINCT file_path, url FROM rt WHERE url IS NOT NULL)")
def dump_listing(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "rt", "file_path", "url").where("url IS NOT NULL").distinct()
    page = _cat('<a href="', F.col("url"), '">x</a><a href="', F.col("url"), '?a&amp;b">y</a><a href="', F.col("url"), '">z</a><a href="../up">up</a>')
    return rows.select("file_path", F.array_join(readers.dump_links(page, "(?i)^https?://"), " ").alias("links"))


SQL_CANONICAL = "regexp_replace(lower(trim(coalesce(url, ''))), '[?#].*$', '')"


@query(
    f"WITH c AS (SELECT DISTINCT file_path, {SQL_CANONICAL} AS u, lower(regexp_extract(file_path, '([^/]*)$', 1)) AS n FROM rt) SELECT DISTINCT file_path, CASE WHEN u = '' THEN ends_with(n, '.html') AND starts_with(n, '{C.SITE}_m_') AND NOT regexp_matches(n, '{'|'.join(readers.MOVIE_PARTS)}')"
    f" ELSE regexp_matches(u, '^(https?:)?//(www\\.)?{C.HOST.replace('.', chr(92) + '.')}/m/[^/]+/?$') END AS is_root FROM c"
)
def root_pages_by_url(spark: SparkSession, d: str) -> DataFrame:
    pages = C.pages_of(spark, d)
    return pages.select("file_path", readers.is_root_page(F.col("file_path"), F.col("html"), C.SITE, C.HOST, "movie").alias("is_root")).distinct()


@query("SELECT file_path, page_type FROM (SELECT DISTINCT file_path, page_type FROM rt) ORDER BY md5('7:' || file_path), file_path LIMIT 20")
def page_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.seeded_sample(load(spark, d, "rt", "file_path", "page_type").distinct(), "file_path", 20)


@query("SELECT DISTINCT file_path, array_to_string(\"cast\"[1:6], ', ') || CASE WHEN len(\"cast\") > 6 THEN ' +' || (len(\"cast\") - 6) || ' more' ELSE '' END AS shown FROM rt WHERE \"cast\" IS NOT NULL")
def cast_preview(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "rt", "file_path", "cast").where("`cast` IS NOT NULL").select("file_path", X.preview_list(F.col("cast")).alias("shown")).distinct()


# ---- frontier

SQL_PATH = "regexp_extract(link, '^https://[^/?#]*([^?#]*)', 1)"


@query(f"""
WITH p AS (SELECT DISTINCT url FROM rt WHERE url IS NOT NULL), l AS (SELECT url AS link FROM p UNION ALL SELECT regexp_extract(url, '(?i)^(https?://[^/?#]*[^?#]*)', 1) || '?ref=nav' FROM p UNION ALL SELECT regexp_extract(url, '(?i)^(https?://[^/?#]*)', 1) || '/m/next_one/' FROM p
 UNION ALL SELECT regexp_extract(url, '(?i)^(https?://[^/?#]*/(?:[^?#]*/)?)', 1) || 'more/list?page=2&utm_source=z' FROM p), n AS (SELECT DISTINCT {C.SQL_NORMAL_URL.format(x='link')} AS link FROM l)
SELECT link AS url, 2 AS depth, TIMESTAMP '2024-01-01' AS discovered_at FROM n WHERE regexp_extract(link, '^https://([^/?#]*)', 1) IN ('{"','".join(C.HOSTS)}') AND contains({SQL_PATH}, '/m/')
 AND NOT regexp_matches({SQL_PATH}, '{"|".join(C.U.EXCLUDED_PATHS)}') AND regexp_matches({SQL_PATH}, '/[^/.]*([^/.]\\.(html|htm|php|jsp|asp))?$')""")
def discovered_links(spark: SparkSession, d: str) -> DataFrame:
    pages = C.pages_of(spark, d).withColumns({"depth": F.lit(1), "at": F.lit("2024-01-01").cast("timestamp_ntz")})
    return R.discovered_links(pages, C.HOSTS)


@query(f"WITH {C.SQL_LATEST}, k AS (SELECT normalized_url FROM l WHERE status = 'crawled') SELECT DISTINCT url, {C.SQL_NORMAL_URL.format(x='url')} AS normalized_url, {C.SQL_NORMAL_URL.format(x='url')} IN (SELECT normalized_url FROM k) AS is_known FROM urls WHERE url IS NOT NULL")
def frontier_known(spark: SparkSession, d: str) -> DataFrame:
    crawled = R.latest(load(spark, d, "urls")).where("status = 'crawled'")
    return R.known(crawled, load(spark, d, "urls", "url").where("url IS NOT NULL").distinct())


@query("""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN response_code = 404 THEN 'not_found' WHEN response_code = 429 THEN 'rate_limited' WHEN response_code = 403 THEN 'forbidden' WHEN response_code BETWEEN 400 AND 499 THEN 'client_error'
 WHEN response_code >= 500 THEN 'server_error' WHEN response_code IS NULL AND error_message IS NOT NULL THEN 'network' WHEN depth = 1 THEN 'not_html' WHEN depth = 2 THEN 'blocked' ELSE 'ok' END AS kind FROM urls) GROUP BY 1""")
def page_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes by content type and by what a blocking page says (pages of depth 1 are images, those of depth 2 blocked)."""
    u = load(spark, d, "urls", "response_code", "error_message", "retry_count", "depth")
    kind = F.when(F.col("depth") == 1, "image/png").otherwise("text/html; charset=utf-8")
    body = F.when(F.col("depth") == 2, "<p>Access Denied</p>").otherwise("<p>A film.</p>")
    return u.select(R.outcome(F.col("response_code"), F.col("error_message"), kind, body, F.col("retry_count")).alias("o")).groupBy("o.kind").agg(F.count("*").alias("n"))


@query(f"""WITH s AS (SELECT file_path, max_by(status, (crawled_at, status = 'crawled')) AS state FROM urls WHERE coalesce(file_path, '') <> '' AND status IN ('crawled', 'failed') AND crawled_at IS NOT NULL GROUP BY 1), f AS (SELECT DISTINCT file_path FROM stored_files)
SELECT 'with failed' AS mode, count(*) AS n FROM f WHERE file_path NOT IN (SELECT file_path FROM s WHERE state = 'crawled') UNION ALL SELECT 'failed only', count(*) FROM f WHERE file_path IN (SELECT file_path FROM s WHERE state = 'failed')""")
def files_by_mode(spark: SparkSession, d: str) -> DataFrame:
    u = load(spark, d, "urls", "file_path", "status", "crawled_at").where("file_path <> '' AND status IN ('crawled', 'failed') AND crawled_at IS NOT NULL")
    states = stage(u.select("file_path", F.when(F.col("status") == "crawled", "processed").otherwise("failed").alias("state"), F.col("crawled_at").alias("at")))
    files = load(spark, d, "stored_files", "file_path").distinct()
    counted = lambda mode, df: df.agg(F.lit(mode).alias("mode"), F.count("*").alias("n"))
    return counted("with failed", ledger.to_process(files, states, include_failed=True)).unionByName(counted("failed only", ledger.to_process(files, states, only_failed=True)))


# ---- index

SQL_STATS = "n AS documents, (SELECT sum(dl) FROM len) AS tokens, round(avgdl, 6) AS avg_length, (SELECT count(*) FROM fr) AS terms, (SELECT count(*) FROM post) AS postings FROM cs"


def _pages_to_index(spark: SparkSession, d: str) -> DataFrame:
    return stage(I.documents_of(load(spark, d, "rt", "file_path", "tomatometer", "audience_score", "page_type", *I.FIELDS)))


@query(f"WITH {C.SQL_INDEX} SELECT {SQL_STATS}")
def index_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = staged_path(spark, "index")
    I.save(*I.build(_pages_to_index(spark, d)), path)
    return I.statistics(*I.load(spark, path))


@query(f"WITH {C.SQL_INDEX} SELECT {SQL_STATS}")
def index_append(spark: SparkSession, d: str) -> DataFrame:
    """Films under another title, then everything but films, then the films as they are, each appended to the saved index."""
    path = staged_path(spark, "index")
    docs = _pages_to_index(spark, d)
    films = docs.where("page_type = 'movie'")
    for part in (films.withColumn("title", F.lit("placeholder of a title")), docs.where("page_type IS DISTINCT FROM 'movie'"), films):
        I.append(part, path)
    return I.statistics(*I.load(spark, path))


@query(f"WITH {C.SQL_INDEX} SELECT s.doc_id, s.score, docs.title, docs.page_type, docs.director FROM ({C.sql_search('standard', True)}) AS s JOIN docs USING (doc_id)")
def search_saved(spark: SparkSession, d: str) -> DataFrame:
    """Search over the index in the shared folder, with the documents of its hits."""
    pages = I.documents_of(load(spark, d, "rt", "file_path", "tomatometer", "audience_score", "title", "page_type", "director"))
    hits = I.search(*C._index(spark, d), C.QUERY, bm25=True)
    return I.with_documents(hits, pages).select("doc_id", "score", "title", "page_type", "director")


# ---- multi-field search

_TIES = "title NULLS FIRST, tomatometer NULLS FIRST, audience_score NULLS FIRST, wiki_runtime_minutes NULLS FIRST, wiki_year NULLS FIRST"
_AGREE = "(rt_year IS NULL OR wiki_year IS NULL OR rt_year = wiki_year)"
_CONFIDENCE = "CASE WHEN rt_year IS NOT NULL AND wiki_year IS NOT NULL THEN 2 ELSE 1 END AS join_confidence"
SQL_LINKED = f"""m AS (SELECT * FROM rt WHERE page_type IN ('movie', 'tv')), e AS (SELECT m.*, wiki.*, 0 AS edits, {_CONFIDENCE} FROM m JOIN wiki ON title_norm = wiki_title_norm AND title_norm <> '' AND {_AGREE}),
 c AS (SELECT u.*, wiki.*, levenshtein(title_norm, wiki_title_norm) AS edits, {_CONFIDENCE} FROM (SELECT * FROM m WHERE file_path NOT IN (SELECT file_path FROM e) AND title_norm <> '') AS u JOIN wiki
 ON string_split(title_norm, ' ')[1] = string_split(wiki_title_norm, ' ')[1] AND string_split(title_norm, ' ')[-1] = string_split(wiki_title_norm, ' ')[-1] AND wiki_title_norm <> '' AND {_AGREE}),
 f AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY edits, wiki_page_id, wiki_title, {_TIES}) AS rn FROM c WHERE edits <= 3) WHERE rn = 1),
 a AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY file_path, wiki_page_id ORDER BY join_confidence DESC, edits, wiki_title, {_TIES}) AS rn FROM (SELECT * FROM e UNION ALL SELECT * FROM f)) WHERE rn = 1)"""


def sql_docs(least: int | None = None) -> str:
    """The search documents, as build_documents makes them."""
    kept = "a" if least is None else f"(SELECT * FROM a WHERE join_confidence IS NULL OR join_confidence >= {least})"
    return f"""{SQL_LINKED}, k AS (SELECT * FROM {kept}), b AS (SELECT coalesce(file_path, wiki_page_id, url) AS doc_id, file_path, page_type, url, title, synopsis, genres, wiki_title, coalesce(nullif(director, ''), array_to_string(wiki_directors, ', '), '') AS director,
 CASE WHEN len("cast") > 0 THEN "cast" ELSE wiki_starring END AS "cast", coalesce(CAST(rt_year AS INT), wiki_year) AS release_year, tomatometer, audience_score, wiki_runtime_minutes AS runtime_minutes, join_confidence FROM k
 UNION ALL SELECT coalesce(file_path, url), file_path, page_type, url, title, synopsis, genres, NULL, coalesce(director, ''), "cast", CAST(rt_year AS INT), tomatometer, audience_score, NULL, NULL FROM m WHERE file_path IS NOT NULL AND file_path NOT IN (SELECT file_path FROM k)),
 docs AS (SELECT *, array_to_string(genres, ' ') AS genres_text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(join_confidence, -1) DESC, coalesce(wiki_title, '') DESC, coalesce(tomatometer, -1) DESC, coalesce(audience_score, -1) DESC,
 coalesce(runtime_minutes, -1) DESC, coalesce(release_year, -1) DESC, coalesce(title, '') DESC, coalesce(url, '') DESC) AS rn FROM b) WHERE rn = 1)"""


def sql_words(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"


SQL_FIELD_TOKENS = (
    "tw AS (" + " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, {sql_words(f'array_to_string({chr(34)}{f}{chr(34)}, chr(32))' if f == 'cast' else f)} AS w FROM docs" for f in Q.BOOSTS)
    + "), tok AS (SELECT doc_id, field, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM tw)"
)
_ALL = sum(Q.BOOSTS.values())


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows) + ")"


def sql_multi(groups: list[str], least: int | None = None, where: str = "TRUE", columns: str = "doc_id, title, score, release_year, tomatometer", needed: str = "TRUE") -> str:
    """The best ten documents; groups: SELECTs of (doc_id, field, key, tf, weight), each with frequencies of its own."""
    scored = " UNION ALL ".join(
        f"SELECT g.doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + {Q.K1} * (1 - {Q.B} + {Q.B} * dl / avgdl)) * weight AS part FROM ({g}) AS g JOIN (SELECT field, key, count(DISTINCT doc_id) AS df FROM ({g}) GROUP BY 1, 2) USING (field, key) JOIN st USING (field) JOIN fl USING (doc_id, field)" for g in groups
    )
    return f"""WITH {sql_docs(least)}, {SQL_FIELD_TOKENS}, fl AS (SELECT doc_id, field, count(*) AS dl FROM tok GROUP BY 1, 2), st AS (SELECT field, count(*) AS n, avg(dl) AS avgdl FROM fl GROUP BY 1),
 tot AS (SELECT doc_id, round(sum(part), 6) AS score FROM ({scored}) GROUP BY 1) SELECT {columns} FROM tot JOIN docs USING (doc_id) WHERE {needed} AND {where} ORDER BY score DESC, doc_id LIMIT 10"""


def sql_terms(words: dict[str, int]) -> str:
    rows = [(w, f, b * k) for w, k in words.items() for f, b in Q.BOOSTS.items()]
    return f"SELECT doc_id, field, term AS key, count(*) AS tf, any_value(wt) AS weight FROM tok JOIN {_values(rows)} AS v(term, field, wt) USING (term, field) GROUP BY 1, 2, 3"


SQL_BOOST = "CASE field " + " ".join(f"WHEN '{f}' THEN {b}" for f, b in Q.BOOSTS.items()) + " END"


def sql_phrase(one: str, two: str) -> str:
    return f"SELECT x.doc_id, x.field, '{one} {two}' AS key, count(*) AS tf FROM tok AS x JOIN tok AS y ON x.doc_id = y.doc_id AND x.field = y.field AND y.pos = x.pos + 1 WHERE x.term = '{one}' AND y.term = '{two}' GROUP BY 1, 2"


@query(sql_multi([sql_terms(dict.fromkeys(C.QUERY.lower().split(), 1))]))
def search_multifield(spark: SparkSession, d: str) -> DataFrame:
    return C._multi(C.search_documents(spark, d), C.QUERY).select("doc_id", "title", "score", "release_year", "tomatometer")


@query(
    sql_multi(
        [sql_terms({"lighthouse": 1, "drama": 1}), f"SELECT doc_id, field, 'gener' AS key, count(*) AS tf, {SQL_BOOST} AS weight FROM tok WHERE starts_with(term, 'gener') GROUP BY 1, 2"], 2,
        "page_type = 'movie' AND release_year BETWEEN 1950 AND 2020 AND tomatometer BETWEEN 40 AND 100 AND join_confidence BETWEEN 2 AND 10",
        needed=f"doc_id IN (SELECT doc_id FROM tok WHERE term = 'drama') AND doc_id NOT IN (SELECT doc_id FROM ({sql_phrase('old', 'verrano')}))",
    )
)
def search_filtered(spark: SparkSession, d: str) -> DataFrame:
    where = Q.passes(page_type="movie", years=(1950, 2020), min_tomatometer=40, min_confidence=2)
    return C._multi(C.search_documents(spark, d, 2), 'lighthouse +drama -"old verrano" gener*', where).select("doc_id", "title", "score", "release_year", "tomatometer")


@query(
    sql_multi(
        [f"SELECT doc_id, field, 'harbor' AS key, count(*) AS tf, {_ALL} AS weight FROM tok WHERE term = 'harbor' AND field = 'title' GROUP BY 1, 2", f"SELECT *, 2.0 * {SQL_BOOST} AS weight FROM ({sql_phrase('the', 'lighthouse')})",
         f"SELECT doc_id, field, term AS key, count(*) AS tf, {SQL_BOOST} AS weight FROM tok WHERE levenshtein(term, 'lighthose') <= 1 GROUP BY 1, 2, 3"], columns="doc_id, title, score",
    )
)
def search_syntax(spark: SparkSession, d: str) -> DataFrame:
    return C._multi(C.search_documents(spark, d), '"the lighthouse"^2 title:harbor lighthose~1').select("doc_id", "title", "score")


@query(
    sql_multi(
        [f"SELECT doc_id, field, 'har TO harz' AS key, count(*) AS tf, {_ALL} AS weight FROM tok WHERE term >= 'har' AND term < 'harz' AND field = 'title' GROUP BY 1, 2", f"SELECT doc_id, field, 'l?ght*' AS key, count(*) AS tf, {SQL_BOOST} AS weight FROM tok WHERE regexp_matches(term, '^l.ght.*$') GROUP BY 1, 2",
         f"SELECT doc_id, field, 'b*' AS key, count(*) AS tf, 3.0 * {SQL_BOOST} AS weight FROM tok WHERE regexp_matches(term, '^br.dge$') GROUP BY 1, 2"],
        columns="doc_id, title, score", needed="doc_id NOT IN (SELECT doc_id FROM tok WHERE term = 'comedy')",
    )
)
def search_groups(spark: SparkSession, d: str) -> DataFrame:
    return C._multi(C.search_documents(spark, d), "title:[har TO harz} (l?ght* (br?dge)^3) -(comedy)").select("doc_id", "title", "score")


@query(f"WITH {sql_docs(2)} SELECT doc_id, wiki_title, director, release_year, tomatometer, runtime_minutes, join_confidence FROM docs")
def search_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents at a confidence of 2: pages whose links fall below it come back as pages of their own."""
    return C.search_documents(spark, d, 2).select("doc_id", "wiki_title", "director", "release_year", "tomatometer", "runtime_minutes", "join_confidence")


@query(f"WITH {sql_docs()} SELECT doc_id, join_confidence FROM docs ORDER BY join_confidence IS NULL, doc_id LIMIT 100")
def search_documents_most(spark: SparkSession, d: str) -> DataFrame:
    rt, wiki = load(spark, d, "rt"), load(spark, d, "wiki")
    return Q.build_documents(L.all_links(rt, wiki), L.media_pages(rt), max_documents=100).select("doc_id", "join_confidence")


@query(f"SELECT DISTINCT title, array_to_string({sql_words('title')}, ' ') AS words FROM rt WHERE title IS NOT NULL")
def field_analysis(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "rt", "title").where("title IS NOT NULL").distinct().withColumn("words", F.array_join(Q.analyse(F.col("title")), " "))


_SAMPLE = ", ".join(f"array_to_string(coalesce({chr(34)}{c}{chr(34)}, []), '|') AS {chr(34)}{c}{chr(34)}" if c in ("genres", "cast", "wiki_directors", "wiki_starring", "wiki_languages", "wiki_countries") else c for c in writers.SAMPLE_COLUMNS)


@query(f"WITH {SQL_LINKED} SELECT {_SAMPLE} FROM a ORDER BY file_path, wiki_page_id LIMIT 300")
def csv_sample(spark: SparkSession, d: str) -> DataFrame:
    return writers.sample_rows(L.all_links(load(spark, d, "rt"), load(spark, d, "wiki")))
