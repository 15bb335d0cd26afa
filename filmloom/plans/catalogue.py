"""Queries of the page, linkage, search, frontier and report operators, with the SQL that checks them."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filmloom.functions import html as H
from filmloom.functions import text as X
from filmloom.functions import url as U
from filmloom.operators import frontier as R
from filmloom.operators import index as I
from filmloom.operators import linking as L
from filmloom.operators import reports as S
from filmloom.operators import search as Q
from filmloom.sources import readers, wiki_dump, writers
from filmloom.session import load, shared_dir, stage
from filmloom.streaming import ledger

SITE, HOST = "reelbarn_example", "reelbarn.example"
HOSTS = (HOST, *[f"{c}.{HOST}" for c in ("uk", "de", "fr", "au")])
QUERY = "The Hungry Lighthouse of old Verrano"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if SQL can tell the same."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return wrap


# ---- text and URLs

SQL_CLEAN = """trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '&nbsp;', ' ', 'gi'), '&amp;', '&', 'gi'), '&quot;', '"', 'gi'), '&#39;|&apos;', '''', 'gi'), '[\\s\\x{{a0}}]+', ' ', 'g'))"""
SQL_NORMAL_URL = """'https://' || regexp_replace(lower(regexp_extract(trim({x}), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://([^/?#]*))?', 1)), '^www\\.', '')
 || coalesce(nullif(regexp_replace(regexp_replace(regexp_extract(trim({x}), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', ''), '/+$', ''), ''), '/')
 || coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract(trim({x}), '^[^?#]*[?]([^#]*)', 1), '&'), lambda p: not regexp_matches(lower(p), 'utm_|ref=|source=|campaign=|medium=')), '&'), ''), '')"""
SQL_TITLE = """regexp_replace(trim(regexp_replace({roman}, '[^a-z0-9]+', ' ', 'g')), '^(the|a|an) +', '')"""


def sql_title(x: str) -> str:
    t = f"regexp_replace(regexp_replace(strip_accents(replace(lower(trim(coalesce({x}, ''))), '&', ' and ')), '\\s*\\((?:\\d{{4}}\\s*)?film\\)\\s*$', ''), '\\s*\\([^)]*\\)\\s*$', '')"
    for old, new in X.NUMERALS.items():
        t = f"replace({t}, '{old}', '{new}')"
    return SQL_TITLE.format(roman=t)


@query(f"SELECT DISTINCT url, {SQL_NORMAL_URL.format(x='url')} AS normal FROM urls WHERE url IS NOT NULL")
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "urls", "url").where("url IS NOT NULL").distinct().withColumn("normal", U.normalize(F.col("url")))


@query(
    "SELECT DISTINCT normalized_url, substr(regexp_replace(regexp_replace(normalized_url, '^https?://', ''), '[^a-zA-Z0-9]', '_', 'g'), 1, 100) || '_' || substr(md5(normalized_url), 1, 12) || '.html' AS file_name"
    " FROM urls WHERE normalized_url IS NOT NULL"
)
def url_filename(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "urls", "normalized_url").where("normalized_url IS NOT NULL").distinct().withColumn("file_name", U.file_name(F.col("normalized_url")))


@query(
    "SELECT DISTINCT normalized_url, regexp_replace(regexp_extract(normalized_url, '^https://([^/?#]*)', 1), '^www\\.', '') IN ('" + "','".join(HOSTS) + "')"
    " AND contains(regexp_extract(normalized_url, '^https://[^/?#]*([^?#]*)', 1), '/m/')"
    " AND NOT regexp_matches(regexp_extract(normalized_url, '^https://[^/?#]*([^?#]*)', 1), '" + "|".join(U.EXCLUDED_PATHS) + "')"
    " AND regexp_matches(regexp_extract(normalized_url, '^https://[^/?#]*([^?#]*)', 1), '/[^/.]*([^/.]\\.(html|htm|php|jsp|asp))?$') AS is_content FROM urls WHERE normalized_url IS NOT NULL"
)
def url_valid(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "urls", "normalized_url").where("normalized_url IS NOT NULL").distinct().withColumn("is_content", U.is_content(F.col("normalized_url"), HOSTS))


@query(f"SELECT DISTINCT doc_id, md5({SQL_CLEAN.format(x='text')}) AS digest FROM documents WHERE text IS NOT NULL")
def entity_clean(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", F.md5(X.clean_entities(F.col("text"))).alias("digest")).distinct()


@query(f"WITH t AS (SELECT title FROM rt UNION SELECT wiki_title FROM wiki) SELECT title, {sql_title('title')} AS norm FROM t WHERE title IS NOT NULL")
def title_normalize(spark: SparkSession, d: str) -> DataFrame:
    both = load(spark, d, "rt", "title").unionByName(load(spark, d, "wiki", "wiki_title").withColumnRenamed("wiki_title", "title"))
    return both.where("title IS NOT NULL").distinct().withColumn("norm", X.normalize_title(F.col("title")))


@query("SELECT DISTINCT release_date, TRY_CAST(nullif(regexp_extract(release_date, '\\b((?:19|20)[0-9]{2})\\b', 1), '') AS INT) AS year FROM rt WHERE release_date IS NOT NULL")
def year_in_text(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "rt", "release_date").where("release_date IS NOT NULL").distinct().withColumn("year", X.year_from_text(F.col("release_date")))


@query(
    "SELECT event_id, CASE WHEN TRY_CAST(regexp_extract(props->>'k', '(\\d+)', 1) AS INT) BETWEEN 0 AND 100 THEN TRY_CAST(regexp_extract(props->>'k', '(\\d+)', 1) AS INT)"
    " WHEN TRY_CAST(regexp_extract(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), '(\\d+)', 1) AS INT) BETWEEN 0 AND 100 THEN TRY_CAST(regexp_extract(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), '(\\d+)', 1) AS INT) END AS score FROM events"
)
def score_coerce(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events", "event_id", "props", "value")
    v = F.try_parse_json("props")
    return e.select("event_id", X.bounded_score(F.try_variant_get(v, "$.k", "string"), F.floor("value").cast("string")).alias("score"))


@query("SELECT DISTINCT coalesce(rating, '') AS rating FROM rt")
def rating_norm(spark: SparkSession, d: str) -> DataFrame:
    loose = F.lower(F.replace(F.col("rating"), F.lit("G-13"), F.lit("G13")))
    return load(spark, d, "rt", "rating").select(X.normalize_rating(loose).alias("rating")).distinct()


@query("""SELECT DISTINCT CASE WHEN runtime IS NULL THEN '' ELSE CASE WHEN h > 0 THEN h || 'h ' || m || 'm' ELSE m || 'm' END END AS runtime FROM (SELECT runtime, t // 60 AS h, t % 60 AS m FROM (SELECT runtime,
 coalesce(TRY_CAST(regexp_extract(runtime, '^(\\d+)h', 1) AS INT), 0) * 60 + coalesce(TRY_CAST(regexp_extract(runtime, '^(?:\\d+h ?)?(\\d+)m', 1) AS INT), 0) AS t FROM rt))""")
def duration_format(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "rt", "runtime")
    iso = F.concat(F.lit("PT"), F.upper(F.replace(F.col("runtime"), F.lit(" "), F.lit(""))))
    return rows.select(X.hours_minutes(X.iso_minutes(iso)).alias("runtime")).distinct()


@query(
    "SELECT doc_id, CASE WHEN trim(regexp_replace(text, '[\\s\\x{a0}]+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '[\\s\\x{a0}]+', ' ', 'g')), ' ')) END AS n,"
    " CASE WHEN length(text) > 220 THEN substr(text, 1, 217) || '...' ELSE text END AS preview FROM documents WHERE text IS NOT NULL"
)
def text_preview(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", X.whitespace_tokens(F.col("text")).alias("n"), X.preview(F.col("text")).alias("preview"))


# ---- pages

def pages_of(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    """Pages written from the rows of rt (or those given), in the markup the extractor reads: (file_path, html)."""
    rt = load(spark, d, "rt").distinct() if rows is None else rows
    media = F.col("page_type").isin("movie", "tv")
    kind = F.when(F.col("page_type") == "movie", "Movie").when(F.col("page_type") == "tv", "TVSeries")
    person = lambda c: F.transform(c, lambda n: F.struct(n.alias("name")))
    core = F.to_json(
        F.struct(
            kind.alias("@type"), F.col("title").alias("name"), F.col("genres").alias("genre"), F.col("rating").alias("contentRating"), F.col("release_date").alias("dateCreated"),
            person(F.when(F.col("director").isNotNull(), F.array("director"))).alias("director"), person(F.col("cast")).alias("actor"),
            F.concat(F.lit("PT"), F.upper(F.replace(F.col("runtime"), F.lit(" "), F.lit("")))).alias("duration"),
        )
    )
    card = F.to_json(F.struct(F.struct(F.col("tomatometer").cast("string").alias("score")).alias("criticsScore"), F.struct(F.col("audience_score").cast("string").alias("score")).alias("audienceScore"), F.col("synopsis").alias("description")))
    told = F.coalesce(F.replace(F.col("description"), F.lit('"'), F.lit("&quot;")), F.lit(""))
    page = F.concat(
        F.lit('<html><link rel="canonical" href="'), F.coalesce("url", F.lit("")), F.lit('"><meta name="description" content="'), told, F.lit('">'), F.lit("<title>"), F.coalesce("title", F.lit("")), F.lit(" | Reelbarn</title>"),
        F.lit('<a href="?ref=nav">x</a><a href=\'/m/next_one/\'>y</a><div data-url="more/list?page=2&utm_source=z"></div><a href="#top">z</a><a href="x.pdf">w</a>'),
        F.when(media, F.concat(F.lit('<script id="media-scorecard-json" type="application/json">'), card, F.lit('</script><script type="application/ld+json">'), core, F.lit("</script>"))).otherwise(""),
    )
    return rt.select("file_path", "url", page.alias("html"))


def _joined(c: str) -> Column:
    return F.array_join(F.col(f"`{c}`"), "|").alias(c)


@query(f"""
WITH c AS (SELECT DISTINCT * FROM rt), m AS (SELECT *, page_type IN ('movie', 'tv') AS media FROM c)
SELECT file_path, page_type, {SQL_CLEAN.format(x='url')} AS url, {SQL_CLEAN.format(x='title')} AS title,
 CASE WHEN media THEN {SQL_CLEAN.format(x='release_date')} END AS release_date, CASE WHEN media THEN {SQL_CLEAN.format(x='director')} END AS director,
 CASE WHEN media THEN array_to_string(list_slice(list_filter(coalesce("cast", []), lambda x: trim(x) <> ''), 1, 20), '|') END AS "cast",
 CASE WHEN media THEN array_to_string(coalesce(genres, []), '|') END AS genres, CASE WHEN media THEN coalesce(tomatometer, 0) END AS tomatometer, CASE WHEN media THEN coalesce(audience_score, 0) END AS audience_score,
 CASE WHEN media THEN {SQL_CLEAN.format(x="coalesce(nullif(synopsis, ''), replace(description, chr(34), '&quot;'))")} END AS synopsis, trim(replace(coalesce(description, ''), chr(34), '&quot;')) AS description,
 CASE WHEN media THEN coalesce(rating, '') END AS rating, CASE WHEN media THEN coalesce(runtime, '') END AS runtime FROM m""")
def html_extract(spark: SparkSession, d: str) -> DataFrame:
    out = H.extract_pages(pages_of(spark, d), SITE)
    return out.select("file_path", "page_type", "url", "title", "release_date", "director", _joined("cast"), _joined("genres"), "tomatometer", "audience_score", "synopsis", "description", "rating", "runtime").distinct()


@query("SELECT DISTINCT file_path, page_type FROM rt")
def page_class(spark: SparkSession, d: str) -> DataFrame:
    pages = pages_of(spark, d)
    return pages.select("file_path", H.page_type(F.col("file_path"), F.col("html"), F.lit(None).cast("variant"), SITE).alias("page_type")).distinct()


@query(f"""
WITH p AS (SELECT DISTINCT url FROM rt WHERE regexp_matches(url, '^https?://[^/?#]+/')), l AS (
 SELECT url, url AS link FROM p UNION ALL SELECT url, regexp_extract(url, '^(https?://[^/?#]*[^?#]*)', 1) || '?ref=nav' FROM p UNION ALL SELECT url, regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/m/next_one/' FROM p
 UNION ALL SELECT url, regexp_extract(url, '^(https?://[^/?#]*/(?:[^?#]*/)?)', 1) || 'more/list?page=2&utm_source=z' FROM p)
SELECT DISTINCT url, {SQL_NORMAL_URL.format(x='link')} AS link FROM l""")
def link_extract(spark: SparkSession, d: str) -> DataFrame:
    pages = pages_of(spark, d).where(F.col("url").rlike("^https?://[^/?#]+/"))
    return pages.select("url", F.explode(U.links(F.col("html"), F.col("url"))).alias("link")).distinct()


@query(f"""
WITH c AS (SELECT DISTINCT file_path, lower(regexp_extract(file_path, '([^/]*)$', 1)) AS n FROM rt)
SELECT file_path, (starts_with(n, '{SITE}_m_') AND NOT regexp_matches(n, '{"|".join(readers.MOVIE_PARTS)}')) OR ((starts_with(n, '{SITE}_tv_') OR starts_with(n, '{SITE}_series_'))
 AND NOT regexp_matches(n, '{"|".join(readers.SERIES_PARTS)}')) AS is_root FROM c""")
def root_pages(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "rt", "file_path").distinct().select("file_path", readers.is_root_page(F.col("file_path"), None, SITE, HOST).alias("is_root"))


# ---- encyclopedia

def wiki_pages_of(spark: SparkSession, d: str) -> DataFrame:
    """Pages with an infobox written from the rows of wiki: (page_id, title, text)."""
    w = load(spark, d, "wiki").distinct()
    lst = lambda c: F.concat(F.lit("{{Plainlist|\n* "), F.array_join(F.col(c), "\n* "), F.lit("\n}}"))
    line = lambda name, v: F.concat(F.lit(f"| {name} = "), F.coalesce(v, F.lit("")), F.lit("\n"))
    text = F.concat(
        F.lit("{{Infobox film\n"), line("director", lst("wiki_directors")), line("starring", lst("wiki_starring")), line("released", F.col("wiki_released_raw")),
        line("runtime", F.concat(F.col("wiki_runtime_minutes").cast("string"), F.lit(" minutes"))), line("country", lst("wiki_countries")), line("language", lst("wiki_languages")), line("budget", F.col("wiki_budget")),
        line("box office", F.col("wiki_box_office")), F.lit("}}\nA film.\n"),
    )
    return w.select(F.col("wiki_page_id").alias("page_id"), F.col("wiki_title").alias("title"), text.alias("text"))


@query()
def wiki_infobox(spark: SparkSession, d: str) -> DataFrame:
    out = wiki_dump.film_records(wiki_pages_of(spark, d))
    return out.select("wiki_page_id", "wiki_title", "wiki_title_norm", "wiki_year", *[_joined(c) for c in ("wiki_directors", "wiki_starring", "wiki_languages", "wiki_countries")], "wiki_released_raw", "wiki_runtime_minutes", "wiki_budget", "wiki_box_office")


@query("SELECT DISTINCT wiki_page_id, wiki_runtime_minutes FROM wiki")
def wiki_runtime(spark: SparkSession, d: str) -> DataFrame:
    return wiki_dump.film_records(wiki_pages_of(spark, d)).select("wiki_page_id", "wiki_runtime_minutes").distinct()


@query(f"SELECT DISTINCT redirect_page_id, redirect_title, {sql_title('redirect_title')} AS redirect_title_norm, target_title, {sql_title('target_title')} AS target_title_norm FROM redirect")
def wiki_redirects(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "redirect", "redirect_page_id", "redirect_title", "target_title").distinct()
    pages = r.select(F.col("redirect_page_id").alias("page_id"), F.col("redirect_title").alias("title"), F.concat(F.lit("#REDIRECT [["), "target_title", F.lit("]]")).alias("text"))
    return wiki_dump.redirect_records(pages)


SQL_ALIAS = """
WITH a AS (SELECT DISTINCT redirect_title, redirect_title_norm, target_title_norm FROM redirect WHERE target_title_norm <> ''), b AS (
 SELECT wiki_page_id, wiki_title, wiki_title_norm, wiki_year, 0 AS alias FROM wiki
 UNION ALL SELECT wiki_page_id, redirect_title, redirect_title_norm, wiki_year, 1 FROM a JOIN wiki ON target_title_norm = wiki_title_norm),
 r AS (SELECT *, row_number() OVER (PARTITION BY wiki_title_norm, wiki_year ORDER BY alias, wiki_page_id, wiki_title) AS rn FROM b)
SELECT wiki_page_id, wiki_title, wiki_title_norm, wiki_year FROM r WHERE rn = 1"""


@query(SQL_ALIAS)
def alias_union(spark: SparkSession, d: str) -> DataFrame:
    return wiki_dump.with_aliases(load(spark, d, "wiki"), load(spark, d, "redirect")).select("wiki_page_id", "wiki_title", "wiki_title_norm", "wiki_year")


@query(
    "SELECT count(*) AS films, " + ", ".join(f"count(*) FILTER (len(coalesce({c}, [])) > 0) AS {c}" for c in ("wiki_directors", "wiki_starring", "wiki_languages", "wiki_countries"))
    + ", count(wiki_runtime_minutes) AS wiki_runtime_minutes, count(*) FILTER (trim(coalesce(wiki_budget, '')) <> '') AS wiki_budget, count(*) FILTER (trim(coalesce(wiki_box_office, '')) <> '') AS wiki_box_office FROM wiki"
)
def wiki_coverage(spark: SparkSession, d: str) -> DataFrame:
    return L.coverage(load(spark, d, "wiki"))


# ---- linkage

RT_KEYS = ("file_path", "page_type", "title", "title_norm", "rt_year", "tomatometer", "audience_score")
WIKI_KEYS = ("wiki_page_id", "wiki_title", "wiki_title_norm", "wiki_year")
SQL_EXACT = """m AS (SELECT * FROM rt WHERE page_type IN ('movie', 'tv')),
 e AS (SELECT file_path, wiki_page_id, 0 AS edits, CASE WHEN rt_year IS NOT NULL AND wiki_year IS NOT NULL THEN 2 ELSE 1 END AS join_confidence
 FROM m JOIN wiki ON title_norm = wiki_title_norm AND title_norm <> '' AND (rt_year IS NULL OR wiki_year IS NULL OR rt_year = wiki_year))"""
SQL_FUZZY = SQL_EXACT + """, u AS (SELECT * FROM m WHERE file_path NOT IN (SELECT file_path FROM e) AND title_norm <> ''),
 c AS (SELECT file_path, wiki_page_id, wiki_title, levenshtein(title_norm, wiki_title_norm) AS edits, CASE WHEN rt_year IS NOT NULL AND wiki_year IS NOT NULL THEN 2 ELSE 1 END AS join_confidence
 FROM u JOIN wiki ON string_split(title_norm, ' ')[1] = string_split(wiki_title_norm, ' ')[1] AND string_split(title_norm, ' ')[-1] = string_split(wiki_title_norm, ' ')[-1]
 AND wiki_title_norm <> '' AND (rt_year IS NULL OR wiki_year IS NULL OR rt_year = wiki_year)),
 f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY edits, wiki_page_id, wiki_title) AS rn FROM c WHERE edits <= 3) WHERE rn = 1),
 a AS (SELECT file_path, wiki_page_id, join_confidence FROM (SELECT *, row_number() OVER (PARTITION BY file_path, wiki_page_id ORDER BY join_confidence DESC, edits) AS rn FROM
 (SELECT file_path, wiki_page_id, edits, join_confidence FROM e UNION ALL SELECT file_path, wiki_page_id, edits, join_confidence FROM f)) WHERE rn = 1)"""


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return load(spark, d, "rt", *RT_KEYS), load(spark, d, "wiki", *WIKI_KEYS)


@query(f"WITH {SQL_EXACT} SELECT DISTINCT file_path, wiki_page_id, join_confidence FROM e")
def exact_link(spark: SparkSession, d: str) -> DataFrame:
    return L.exact_links(*_sides(spark, d)).select("file_path", "wiki_page_id", "join_confidence").distinct()


@query(f"WITH {SQL_EXACT} SELECT DISTINCT file_path FROM m WHERE file_path NOT IN (SELECT file_path FROM e)")
def unmatched(spark: SparkSession, d: str) -> DataFrame:
    rt, wiki = _sides(spark, d)
    return L.unmatched(rt, L.exact_links(rt, wiki)).select("file_path").distinct()


@query(f"WITH {SQL_FUZZY} SELECT file_path, wiki_page_id, edits, join_confidence FROM f")
def fuzzy_link(spark: SparkSession, d: str) -> DataFrame:
    rt, wiki = _sides(spark, d)
    return L.fuzzy_links(L.unmatched(rt, L.exact_links(rt, wiki)), wiki).select("file_path", "wiki_page_id", "edits", "join_confidence")


@query(f"WITH {SQL_FUZZY} SELECT file_path, wiki_page_id, join_confidence FROM a")
def link_all(spark: SparkSession, d: str) -> DataFrame:
    return L.all_links(*_sides(spark, d)).select("file_path", "wiki_page_id", "join_confidence")


@query(
    f"WITH {SQL_FUZZY} SELECT (SELECT count(DISTINCT file_path) FROM m) AS rt_pages, (SELECT count(DISTINCT wiki_page_id) FROM wiki) AS wiki_pages, (SELECT count(DISTINCT wiki_page_id) FROM a) AS linked_wiki_pages, (SELECT count(*) FROM a) AS links"
)
def link_report(spark: SparkSession, d: str) -> DataFrame:
    rt, wiki = _sides(spark, d)
    return L.link_report(rt, wiki, L.all_links(rt, wiki))


@query(f"WITH {SQL_FUZZY} SELECT join_confidence, count(*) AS n, CASE join_confidence WHEN 2 THEN 'title+year' ELSE 'title only' END AS label FROM a GROUP BY 1")
def confidence_counts(spark: SparkSession, d: str) -> DataFrame:
    return L.confidence_counts(L.all_links(*_sides(spark, d)))


@query("SELECT file_path, unnest(genres) AS item FROM rt WHERE genres IS NOT NULL")
def list_items(spark: SparkSession, d: str) -> DataFrame:
    return writers.list_items(load(spark, d, "rt", "file_path", "genres"), "genres")


@query("SELECT file_path, title, array_to_string(coalesce(genres, []), '|') AS genres, array_to_string(coalesce(\"cast\", []), '|') AS \"cast\", rating FROM rt")
def metadata_csv(spark: SparkSession, d: str) -> DataFrame:
    return writers.metadata_rows(load(spark, d, "rt", "file_path", "title", "genres", "cast", "rating"))


# ---- index

STOPS = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
SHORTS = ", ".join(f"'{w}'" for w in X.SHORT_TOKENS)


def sql_tokens(x: str) -> str:
    words = f"list_filter(regexp_split_to_array(trim(regexp_replace(lower(strip_accents({x})), '[^\\p{{L}}\\p{{N}}_\\s-]', ' ', 'g')), '\\s+'), lambda w: w <> '')"
    glued = f"list_transform({words}, lambda w: CASE WHEN contains(w, '-') AND len(list_filter(string_split(w, '-'), lambda p: regexp_matches(p, '^\\p{{L}}+$'))) > 0 AND length(replace(w, '-', '')) BETWEEN 1 AND 4 THEN replace(w, '-', '') ELSE w END)"
    return f"list_filter({glued}, lambda w: w NOT IN ({STOPS}) AND (length(w) > 2 OR w IN ({SHORTS})))"


def _field(f: str) -> str:
    return f"array_to_string({chr(34)}{f}{chr(34)}, ' ')" if f in ("genres", "cast") else f"CAST({f} AS VARCHAR)"


SQL_INDEX = (
    "docs AS (SELECT * FROM (SELECT *, file_path AS doc_id, row_number() OVER (PARTITION BY file_path ORDER BY tomatometer DESC NULLS LAST, audience_score DESC NULLS LAST) AS rn FROM rt WHERE file_path IS NOT NULL) WHERE rn = 1), tok AS ("
    + " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, {w} AS weight, unnest({sql_tokens(_field(f))}) AS term FROM docs WHERE {chr(34)}{f}{chr(34)} IS NOT NULL" for f, w in I.FIELDS.items())
    + "), per AS (SELECT doc_id, field, term, any_value(weight) AS weight, count(*) AS n FROM tok GROUP BY 1, 2, 3), post AS (SELECT term, doc_id, CAST(sum(weight) AS DOUBLE) AS wtf FROM per GROUP BY 1, 2),"
    " len AS (SELECT docs.doc_id, count(term) AS dl FROM docs LEFT JOIN tok USING (doc_id) GROUP BY 1), cs AS (SELECT count(*) AS n, greatest(sum(dl), 1) / count(*) AS avgdl FROM len), fr AS (SELECT term, count(*) AS df FROM post GROUP BY 1), mx AS (SELECT max(df) AS max_df FROM fr)"
)
SQL_IDF = {
    "standard": "ln(n / df)", "probabilistic": "greatest(0.0, ln((n - df + 0.5) / (df + 0.5)))", "smooth": "ln(1.0 + (n - df + 0.5) / (df + 0.5))", "max": "ln(1.0 + max_df / (df + 1.0))",
}


def sql_search(method: str, bm25: bool = False, k: int = 10, where: str = "TRUE", q: str = QUERY) -> str:
    idf = SQL_IDF["probabilistic" if bm25 else method]
    part = f"{idf} * (wtf * 2.5) / (wtf + 1.5 * (0.25 + 0.75 * (greatest(1, dl) / avgdl)))" if bm25 else f"wtf * {idf}"
    return (
        f"SELECT doc_id, round(sum(({part}) * times), 6) AS score FROM post JOIN (SELECT term, count(*) AS times FROM (SELECT unnest({sql_tokens(chr(39) + q + chr(39))}) AS term) GROUP BY 1) USING (term) JOIN fr USING (term), cs, mx, len"
        f" WHERE len.doc_id = post.doc_id AND {where} GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT {k}"
    ).replace("SELECT doc_id, round", "SELECT post.doc_id AS doc_id, round").replace("GROUP BY doc_id ORDER", "GROUP BY post.doc_id ORDER")


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The index of all pages, from the shared folder: written once per state of the table's files, read by every query."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    table = fs_path(f"{d}/rt.parquet")
    listed = table.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(table)
    state = hashlib.md5("\n".join(sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in listed)).encode()).hexdigest()
    path = f"{shared_dir(spark)}/filmloom-index/{spark.sparkContext.applicationId}/{state}"
    try:
        return I.load(spark, path)
    except ValueError:
        I.append(stage(I.documents_of(load(spark, d, "rt", "file_path", "tomatometer", "audience_score", *I.FIELDS))), path)
        return I.load(spark, path)


def _register_searches() -> None:
    def make(method: str, bm25: bool):
        return lambda spark, d: I.search(*_index(spark, d), QUERY, method, bm25)

    for m in I.METHODS:
        QUERIES[f"tfidf_{m}"] = make(m, False)
        ORACLES[f"tfidf_{m}"] = f"WITH {SQL_INDEX} {sql_search(m)}"
    QUERIES["bm25_topk"] = make("standard", True)
    ORACLES["bm25_topk"] = f"WITH {SQL_INDEX} {sql_search('standard', True)}"


_register_searches()


@query(f"WITH {SQL_INDEX} {sql_search('standard', True, where='post.doc_id IN (SELECT doc_id FROM docs WHERE page_type = ' + chr(39) + 'tv' + chr(39) + ')')}")
def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    series = load(spark, d, "rt", "file_path", "page_type").where("page_type = 'tv'").select(F.col("file_path").alias("doc_id"))
    return I.search(*_index(spark, d), QUERY, bm25=True, only=series)


@query(
    f"WITH {SQL_INDEX} SELECT 'bm25' AS method, * FROM ({sql_search('standard', True, 5)})" + "".join(f" UNION ALL SELECT '{m}', * FROM ({sql_search(m, False, 5)})" for m in I.METHODS)
)
def compare_methods(spark: SparkSession, d: str) -> DataFrame:
    return I.compare(*_index(spark, d), QUERY)


TERMS = ("lighthouse", "drama", "nosuchterm")


@query(
    f"WITH {SQL_INDEX}, t AS (SELECT unnest([{', '.join(chr(39) + t + chr(39) for t in TERMS)}]) AS term), j AS (SELECT term, coalesce(df, 0) AS df, n, max_df FROM t LEFT JOIN fr USING (term), cs, mx) SELECT term, df, n, "
    + ", ".join(f"CASE WHEN df > 0 THEN round({SQL_IDF[m].replace('/ df', '/ nullif(df, 0)')}, 6) ELSE 0.0 END AS idf_{m}" for m in I.METHODS) + " FROM j"
)
def term_analysis(spark: SparkSession, d: str) -> DataFrame:
    return I.analyse(*_index(spark, d), list(TERMS))


@query(f"WITH {SQL_INDEX} SELECT n AS documents, (SELECT sum(dl) FROM len) AS tokens, round(avgdl, 6) AS avg_length, (SELECT count(*) FROM fr) AS terms, (SELECT count(*) FROM post) AS postings FROM cs")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return I.statistics(*_index(spark, d))


@query(f"WITH {SQL_INDEX} SELECT df, count(*) AS n_terms FROM fr GROUP BY 1")
def df_histogram(spark: SparkSession, d: str) -> DataFrame:
    return I.frequency_histogram(_index(spark, d)[0])


@query(f"WITH {SQL_INDEX} SELECT term, CAST(floor(round(sum(wtf), 6)) AS BIGINT) AS weight FROM post GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_terms(spark: SparkSession, d: str) -> DataFrame:
    return I.top_terms(_index(spark, d)[0])


@query(f"WITH {SQL_INDEX} SELECT term, doc_id, round(wtf, 6) AS wtf FROM post")
def postings(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d)[0].select("term", "doc_id", F.round("wtf", 6).alias("wtf"))


@query(f"WITH {SQL_INDEX} SELECT n AS documents, (SELECT sum(dl) FROM len) AS tokens, round(avgdl, 6) AS avg_length, (SELECT count(*) FROM fr) AS terms, (SELECT count(*) FROM post) AS postings FROM cs")
def index_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Films get another title, then their own again: the index is as if built once."""
    docs = stage(I.documents_of(load(spark, d, "rt", "file_path", "tomatometer", "audience_score", "page_type", *I.FIELDS)))
    films = docs.where("page_type = 'movie'")
    changed = I.upsert(*_index(spark, d), films.withColumn("title", F.lit("placeholder of a title")))
    return I.statistics(*I.upsert(*changed, films))


# ---- multi-field search

def search_documents(spark: SparkSession, d: str, min_confidence: int | None = None) -> DataFrame:
    rt, wiki = load(spark, d, "rt"), load(spark, d, "wiki")
    return stage(Q.build_documents(L.all_links(rt, wiki), L.media_pages(rt), min_confidence))


def _multi(docs: DataFrame, text: str, where: Column | None = None) -> DataFrame:
    return Q.search(docs, text, where, tokens=stage(Q.field_tokens(docs)))


# ---- frontier

SQL_LATEST = """l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY normalized_url ORDER BY CASE status WHEN 'crawled' THEN 5 WHEN 'failed' THEN 4 WHEN 'queued' THEN 2 WHEN 'discovered' THEN 1 ELSE 0 END DESC,
 coalesce(crawled_at, TIMESTAMP '1970-01-01') DESC, coalesce(discovered_at, TIMESTAMP '1970-01-01') DESC, coalesce(retry_count, 0) DESC, coalesce(depth, 0), coalesce(url, '') DESC, coalesce(file_path, '') DESC,
 coalesce(response_code, 0) DESC, coalesce(error_message, '') DESC) AS rn FROM urls WHERE normalized_url IS NOT NULL) WHERE rn = 1)"""


def _frontier(spark: SparkSession, d: str) -> DataFrame:
    """The frontier as a table: most queries read it more than once."""
    return stage(R.latest(load(spark, d, "urls")))


@query(f"WITH {SQL_LATEST} SELECT normalized_url, url, status, depth, discovered_at, crawled_at, retry_count, file_path, response_code, error_message FROM l")
def frontier_latest(spark: SparkSession, d: str) -> DataFrame:
    return _frontier(spark, d)


@query(f"WITH {SQL_LATEST} SELECT normalized_url, url, depth FROM l WHERE status = 'discovered' ORDER BY depth, url, normalized_url LIMIT 50")
def frontier_next(spark: SparkSession, d: str) -> DataFrame:
    return R.next_batch(_frontier(spark, d), 50).select("normalized_url", "url", "depth")


@query(f"""WITH {SQL_LATEST}, n AS (SELECT normalized_url FROM l WHERE status = 'discovered' ORDER BY depth, url, normalized_url LIMIT 50)
SELECT CASE WHEN normalized_url IN (SELECT normalized_url FROM n) THEN 'queued' ELSE status END AS status, count(*) AS n FROM l GROUP BY 1""")
def frontier_queue(spark: SparkSession, d: str) -> DataFrame:
    f = _frontier(spark, d)
    return R.mark_queued(f, R.next_batch(f, 50)).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH {SQL_LATEST}, k AS (SELECT normalized_url FROM l WHERE status <> 'discovered'), f AS (SELECT {SQL_NORMAL_URL.format(x='url')} AS nu, url, depth, discovered_at FROM urls WHERE url IS NOT NULL),
 o AS (SELECT *, row_number() OVER (PARTITION BY nu ORDER BY discovered_at, depth, url) AS rn FROM f)
SELECT url, nu AS normalized_url, 'discovered' AS status, depth, discovered_at, 0 AS retry_count FROM o WHERE rn = 1 AND nu NOT IN (SELECT normalized_url FROM k)""")
def frontier_insert(spark: SparkSession, d: str) -> DataFrame:
    return R.insert_new(_frontier(spark, d).where("status <> 'discovered'"), load(spark, d, "urls", "url", "depth", "discovered_at"))


@query(f"""WITH {SQL_LATEST} SELECT CASE WHEN status IN ('queued', 'failed') AND crawled_at IS NULL AND coalesce(retry_count, 0) < 3 THEN 'discovered' ELSE status END AS status, count(*) AS n FROM l GROUP BY 1""")
def frontier_recover(spark: SparkSession, d: str) -> DataFrame:
    return R.recover(_frontier(spark, d), 3).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH {SQL_LATEST}, q AS (SELECT *, status = 'queued' AS hit, depth % 2 = 0 AS ok FROM l)
SELECT normalized_url, CASE WHEN hit AND ok THEN 'crawled' WHEN hit THEN 'failed' ELSE status END AS status, retry_count + CASE WHEN hit AND NOT ok THEN 1 ELSE 0 END AS retry_count,
 CASE WHEN hit THEN TIMESTAMP '2024-01-01' ELSE crawled_at END AS crawled_at, CASE WHEN hit AND ok THEN 200 WHEN hit THEN 500 ELSE response_code END AS response_code FROM q""")
def frontier_outcomes(spark: SparkSession, d: str) -> DataFrame:
    f = _frontier(spark, d)
    ok = F.col("depth") % 2 == 0
    out = f.where("status = 'queued'").select(
        "normalized_url", ok.alias("ok"), F.lit("2024-01-01").cast("timestamp_ntz").alias("at"), F.lit("x.html").alias("file_path"), F.when(ok, 200).otherwise(500).alias("response_code"), F.when(~ok, "failed").alias("error_message")
    )
    return R.apply_outcomes(f, out).select("normalized_url", "status", "retry_count", "crawled_at", "response_code")


@query(
    f"WITH {SQL_LATEST} SELECT " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in R.STATUSES)
    + ", count(*) AS total, count(*) FILTER (coalesce(file_path, '') <> '') AS files_saved, coalesce(sum(retry_count), 0) AS retries, count(*) FILTER (response_code = 429) AS rate_limited FROM l"
)
def crawl_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.figures(_frontier(spark, d))


@query(f"WITH {SQL_LATEST}, c AS (SELECT count(*) FILTER (status = 'crawled') AS crawled FROM l) SELECT crawled, round(crawled * 100.0 / 1000000, 4) AS percent, round(crawled / 24.0, 4) AS per_hour, CASE WHEN crawled > 0 THEN round((1000000 - crawled) * 24.0 / crawled, 4) END AS hours_left FROM c")
def crawl_progress(spark: SparkSession, d: str) -> DataFrame:
    return R.progress(_frontier(spark, d), 1_000_000, 24.0)


@query(f"WITH {SQL_LATEST} SELECT '1' AS id, TIMESTAMP '2024-01-01' AS checkpoint_time, count(*) FILTER (status = 'crawled') AS urls_crawled, count(*) FILTER (status = 'discovered') AS urls_queued, count(*) AS total_urls FROM l")
def crawl_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    return R.checkpoint_row(_frontier(spark, d), F.lit("2024-01-01").cast("timestamp_ntz"))


@query("""SELECT CASE WHEN response_code = 404 THEN 'not_found' WHEN response_code = 429 THEN 'rate_limited' WHEN response_code = 403 THEN 'forbidden' WHEN response_code BETWEEN 400 AND 499 THEN 'client_error'
 WHEN response_code >= 500 THEN 'server_error' WHEN response_code IS NULL AND error_message IS NOT NULL THEN 'network' ELSE 'ok' END AS kind, count(*) AS n,
 sum(CASE WHEN response_code = 429 THEN pow(2.0, coalesce(retry_count, 0)) * 60 WHEN response_code IS NULL AND error_message IS NOT NULL THEN pow(2.0, coalesce(retry_count, 0)) * 30 ELSE 0 END) AS wait_seconds FROM urls GROUP BY 1""")
def fetch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    u = load(spark, d, "urls", "response_code", "error_message", "retry_count")
    none = F.lit(None).cast("string")
    o = R.outcome(F.col("response_code"), F.col("error_message"), none, none, F.col("retry_count"))
    return u.select(o.alias("o")).groupBy("o.kind").agg(F.count("*").alias("n"), F.sum("o.wait_seconds").alias("wait_seconds"))


@query("""SELECT event_id, last_minute, last_hour, last_minute >= 30 OR last_hour >= 1500 AS must_wait FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND 1 PRECEDING) AS last_minute,
 count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND 1 PRECEDING) AS last_hour FROM events)""")
def rate_window(spark: SparkSession, d: str) -> DataFrame:
    return R.rate_windows(load(spark, d, "events", "event_id", "user_id", "ts"), ["user_id"], "ts", 30, 1500).select("event_id", "last_minute", "last_hour", "must_wait")


@query(f"WITH {SQL_LATEST}, s AS (SELECT file_path, max_by(status, (crawled_at, status = 'crawled')) AS state FROM urls WHERE coalesce(file_path, '') <> '' AND status IN ('crawled', 'failed') AND crawled_at IS NOT NULL GROUP BY 1) SELECT DISTINCT file_path FROM stored_files WHERE file_path NOT IN (SELECT file_path FROM s)")
def files_to_process(spark: SparkSession, d: str) -> DataFrame:
    u = load(spark, d, "urls", "file_path", "status", "crawled_at").where("file_path <> '' AND status IN ('crawled', 'failed') AND crawled_at IS NOT NULL")
    states = u.select("file_path", F.when(F.col("status") == "crawled", "processed").otherwise("failed").alias("state"), F.col("crawled_at").alias("at"))
    return ledger.to_process(load(spark, d, "stored_files", "file_path").distinct(), states)


# ---- reports

def sql_told(c: str) -> str:
    q = f'"{c}"'
    return f"coalesce(len({q}) > 0, FALSE)" if c in ("genres", "cast") else f"coalesce({q} > 0, FALSE)" if c in ("tomatometer", "audience_score") else f"coalesce({q} <> '', FALSE)"


@query("SELECT coalesce(page_type, 'unknown') AS page_type, count(*) AS n FROM rt GROUP BY 1")
def page_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.page_types(load(spark, d, "rt", "page_type"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER ({sql_told(c)}) AS n_told, round(count(*) FILTER ({sql_told(c)}) * 100.0 / count(*), 2) AS percent FROM rt" for c in S.COMPLETE_FIELDS))
def field_completeness(spark: SparkSession, d: str) -> DataFrame:
    return S.completeness(load(spark, d, "rt", *S.COMPLETE_FIELDS))


@query(" UNION ALL ".join(f"SELECT '{c}' AS score, count(*) AS n, round(avg({c}), 2) AS average FROM rt WHERE page_type IN ('movie', 'tv') AND {c} > 0" for c in ("tomatometer", "audience_score")))
def score_stats(spark: SparkSession, d: str) -> DataFrame:
    return S.scores(load(spark, d, "rt", "page_type", "tomatometer", "audience_score"))


def sql_words(c: str) -> str:
    t = f"trim(regexp_replace(coalesce({c}, ''), '[\\s\\x{{a0}}]+', ' ', 'g'))"
    return f"sum(CASE WHEN {t} = '' THEN 0 ELSE len(string_split({t}, ' ')) END)"


@query(f"WITH s AS (SELECT {sql_words('description')} AS description_tokens, {sql_words('synopsis')} AS synopsis_tokens, count(*) AS n FROM rt) SELECT description_tokens, synopsis_tokens, description_tokens + synopsis_tokens AS total_tokens, round((description_tokens + synopsis_tokens) / n, 2) AS tokens_per_page FROM s")
def token_stats(spark: SparkSession, d: str) -> DataFrame:
    return S.token_counts(load(spark, d, "rt", "description", "synopsis"))


SQL_ISSUES = " UNION ALL ".join(
    f"SELECT file_path, '{name}' AS issue FROM rt WHERE {rule}"
    for name, rule in {
        "missing_title": f"NOT {sql_told('title')}", "missing_url": f"NOT {sql_told('url')}", "missing_scores": f"page_type IN ('movie', 'tv') AND NOT {sql_told('tomatometer')} AND NOT {sql_told('audience_score')}",
        "missing_genres": f"page_type IN ('movie', 'tv') AND NOT {sql_told('genres')}", "missing_description": f"page_type IN ('movie', 'tv') AND NOT {sql_told('description')} AND NOT {sql_told('synopsis')}",
    }.items()
)


@query(SQL_ISSUES)
def validation_issues(spark: SparkSession, d: str) -> DataFrame:
    return S.issues(load(spark, d, "rt"))


@query(f"SELECT issue, count(*) AS n FROM ({SQL_ISSUES}) GROUP BY 1")
def issue_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.issue_counts(load(spark, d, "rt"))


