"""Exact and blocked fuzzy linkage of pages to films by title and year, with its reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from filmloom.session import stage

MAX_EDITS = 3
PARTS = 4


def media_pages(rt: DataFrame) -> DataFrame:
    return rt.where(F.col("page_type").isin("movie", "tv"))


def years_agree(a: Column, b: Column) -> Column:
    """Equal, or unknown on either side."""
    return a.isNull() | b.isNull() | (a == b)


def _confidence() -> Column:
    """2 where title and year agree, 1 where a year is unknown."""
    return F.when(F.col("rt_year").isNotNull() & F.col("wiki_year").isNotNull(), 2).otherwise(1)


def exact_links(rt: DataFrame, wiki: DataFrame, match_empty_titles: bool = False) -> DataFrame:
    """All pairs with equal normalised titles and agreeing years. '' is no title, unless match_empty_titles."""
    pages = media_pages(rt)
    if not match_empty_titles:
        pages = pages.where("title_norm <> ''")
    return pages.join(wiki, (F.col("title_norm") == F.col("wiki_title_norm")) & years_agree(F.col("rt_year"), F.col("wiki_year"))).withColumn("join_confidence", _confidence())


def unmatched(rt: DataFrame, links: DataFrame) -> DataFrame:
    return media_pages(rt).join(links.select("file_path").distinct(), "file_path", "left_anti")


def _ends(title: Column) -> tuple[Column, Column]:
    words = F.split(title, " ")
    return F.element_at(words, 1), F.element_at(words, -1)


def _ties(links: DataFrame) -> list[str]:
    """What decides between repeated rows of a page or film, of the columns there are."""
    return [c for c in ("title", "tomatometer", "audience_score", "wiki_runtime_minutes", "wiki_year") if c in links.columns]


def fuzzy_links(rt: DataFrame, wiki: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """For each page the film with the fewest edits (at most max_edits) among those with the same first and last word and
    agreeing years; ties by page id, then title. Titles without a word are left out."""
    left = rt.where("title_norm <> ''").withColumns(dict(zip(("l_head", "l_tail"), _ends(F.col("title_norm")), strict=True)))
    right = wiki.where("wiki_title_norm <> ''").withColumns(dict(zip(("r_head", "r_tail"), _ends(F.col("wiki_title_norm")), strict=True)))
    # the films under a common pair of words are dealt into parts, and a page meets each part
    right = right.withColumn("r_part", F.pmod(F.xxhash64("wiki_page_id", "wiki_title"), F.lit(PARTS)).cast("int"))
    left = left.withColumn("l_part", F.explode(F.array(*[F.lit(k) for k in range(PARTS)])))
    on = (F.col("l_head") == F.col("r_head")) & (F.col("l_tail") == F.col("r_tail")) & (F.col("l_part") == F.col("r_part")) & years_agree(F.col("rt_year"), F.col("wiki_year"))
    # lengths first: they tell most pairs apart without an edit distance
    near = left.join(right, on & (F.abs(F.length("title_norm") - F.length("wiki_title_norm")) <= max_edits)).withColumn("edits", F.levenshtein("title_norm", "wiki_title_norm", max_edits))
    near = near.where("edits >= 0")  # -1: more edits than asked for
    w = Window.partitionBy("file_path").orderBy("edits", "wiki_page_id", "wiki_title", *_ties(near))
    best = near.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "l_head", "l_tail", "r_head", "r_tail", "l_part", "r_part")
    return best.withColumn("join_confidence", _confidence())


def all_links(rt: DataFrame, wiki: DataFrame) -> DataFrame:
    """Exact links, and fuzzy ones of the pages without any; once per (file_path, wiki_page_id), the surer one first."""
    exact = stage(exact_links(rt, wiki))
    fuzzy = fuzzy_links(unmatched(rt, exact), wiki)
    both = exact.withColumn("edits", F.lit(0)).unionByName(fuzzy)
    w = Window.partitionBy("file_path", "wiki_page_id").orderBy(F.desc("join_confidence"), "edits", "wiki_title", *_ties(both))
    return both.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def link_report(rt: DataFrame, wiki: DataFrame, links: DataFrame) -> DataFrame:
    """One row: distinct pages, films, linked films (a NULL id counts once) and links."""
    def n(c: str) -> Column:
        return F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))

    a = media_pages(rt).agg(F.coalesce(n("file_path"), F.lit(0)).alias("rt_pages"))
    b = wiki.agg(F.coalesce(n("wiki_page_id"), F.lit(0)).alias("wiki_pages"))
    c = links.agg(F.coalesce(n("wiki_page_id"), F.lit(0)).alias("linked_wiki_pages"), F.count("*").alias("links"))
    return a.join(b).join(c)  # one row each


def confidence_counts(links: DataFrame) -> DataFrame:
    label = F.when(F.col("join_confidence") == 2, "title+year").when(F.col("join_confidence") == 1, "title only")
    return links.groupBy("join_confidence").agg(F.count("*").alias("n")).withColumn("label", label)


def coverage(wiki: DataFrame) -> DataFrame:
    """One row: films, and how many have each attribute."""
    full = lambda c: F.count_if(F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0).alias(c)
    told = lambda c: F.count_if(F.trim(F.coalesce(F.col(c), F.lit(""))) != "").alias(c)
    return wiki.agg(
        F.count("*").alias("films"), *[full(c) for c in ("wiki_directors", "wiki_starring", "wiki_languages", "wiki_countries")],
        F.count("wiki_runtime_minutes").alias("wiki_runtime_minutes"), told("wiki_budget"), told("wiki_box_office"),
    )
