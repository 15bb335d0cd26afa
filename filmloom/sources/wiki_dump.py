"""Reading of encyclopedia dumps (plain or bz2 XML): pages, film records, redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filmloom.functions import wikitext
from filmloom.functions.text import normalize_title

# Prefixes of titles that are no articles.
NAMESPACES = ("Talk", "User", "User talk", "Wikipedia", "Wikipedia talk", "File", "File talk", "MediaWiki", "Template", "Template talk", "Help", "Category", "Category talk", "Portal", "Draft", "Module", "Book", "TimedText", "Special", "Media")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, title, text) per page. The dump is read as text parted at </page>, which splits within a bz2 file and
    loses no page at a split; the text stays entity-escaped."""
    raw = spark.read.option("lineSep", "</page>").text(path).where(F.col("value").contains("<page>"))
    body = F.regexp_extract("value", r"(?s)<page>(.*)\z", 1)
    return raw.select(body.alias("page")).select(
        F.nullif(F.regexp_extract("page", r"<id>(\d+)</id>", 1), F.lit("")).alias("page_id"),
        F.nullif(F.regexp_extract("page", r"<title>(.*?)</title>", 1), F.lit("")).alias("title"),
        F.regexp_extract("page", r"(?s)<text[^>]*>(.*)</text>", 1).alias("text"),
    )


def is_article(title: Column, drop_all_colons: bool = False) -> Column:
    """Whether a title is an article's. Only known namespaces are left out, or, if asked, every title with a colon."""
    if drop_all_colons:
        return ~title.contains(":")
    return ~F.substring_index(title, ":", 1).isin(*NAMESPACES) | ~title.contains(":")


def film_records(pages: DataFrame, drop_all_colons: bool = False) -> DataFrame:
    """Films of (page_id, title, text) in the wiki schema. Pages without title, redirects, and pages without a film
    infobox or any field of one are left out."""
    kept = pages.where(F.col("title").isNotNull() & is_article(F.col("title"), drop_all_colons) & ~F.col("text").rlike(r"(?i)\A#REDIRECT\s+\[\["))
    films = kept.where(F.col("text").rlike(r"(?i)\{\{\s*infobox film")).withColumn("film", wikitext.film_attributes(F.col("text"))).where("film.director IS NOT NULL")
    return films.select(
        F.col("page_id").alias("wiki_page_id"),
        F.col("title").alias("wiki_title"),
        normalize_title(F.col("title")).alias("wiki_title_norm"),
        F.col("film.year").alias("wiki_year"),
        F.col("film.director").alias("wiki_directors"),
        F.col("film.starring").alias("wiki_starring"),
        F.col("film.language").alias("wiki_languages"),
        F.col("film.country").alias("wiki_countries"),
        F.col("film.released").alias("wiki_released_raw"),
        F.col("film.runtime_minutes").alias("wiki_runtime_minutes"),
        F.col("film.budget").alias("wiki_budget"),
        F.col("film.box_office").alias("wiki_box_office"),
    )


def redirect_records(pages: DataFrame, drop_all_colons: bool = False) -> DataFrame:
    """Redirects of (page_id, title, text): their title and their target's, as written and normalised."""
    target = F.regexp_extract("text", r"(?i)#REDIRECT\s+\[\[([^\]]+)\]\]", 1)
    found = pages.where(F.col("title").isNotNull() & is_article(F.col("title"), drop_all_colons)).withColumn("target", target).where("target <> ''")
    return found.select(
        F.col("page_id").alias("redirect_page_id"),
        F.col("title").alias("redirect_title"),
        normalize_title(F.col("title")).alias("redirect_title_norm"),
        F.col("target").alias("target_title"),
        normalize_title(F.col("target")).alias("target_title_norm"),
    )


def with_aliases(wiki: DataFrame, redirect: DataFrame) -> DataFrame:
    """Films under their own titles and under those of the redirects to them, once per (title_norm, year).

    Of rows with equal title and year an own title comes before an alias, then the least page id and title. Redirects to
    an empty normalised title are not followed: it is no title of its own.
    """
    others = [c for c in wiki.columns if c not in ("wiki_title", "wiki_title_norm")]
    alias = (
        redirect.where("target_title_norm <> ''")
        .select("redirect_title", "redirect_title_norm", "target_title_norm")
        .distinct()
        .join(wiki, F.col("target_title_norm") == F.col("wiki_title_norm"))
        .select(*others, F.col("redirect_title").alias("wiki_title"), F.col("redirect_title_norm").alias("wiki_title_norm"), F.lit(1).alias("is_alias"))
    )
    both = wiki.withColumn("is_alias", F.lit(0)).unionByName(alias)
    # an aggregate and no window: a title of very many films is combined before the shuffle
    text = lambda c: F.coalesce(c, F.lit(""))
    row, order = F.struct(*[F.col(f"`{c}`") for c in wiki.columns]), F.struct("is_alias", text("wiki_page_id"), text("wiki_title"), F.xxhash64(*[F.col(f"`{c}`") for c in wiki.columns]))
    return both.groupBy("wiki_title_norm", "wiki_year").agg(F.min_by(row, order).alias("r")).select("r.*")
