"""Queries of the corpus operators (problems 3 and 6 to 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filmloom.llm import linkage, markup, mixing, names, packing, truncation
from filmloom.session import load


def _marked(spark: SparkSession, d: str) -> DataFrame:
    """Every value of the fields that hold markup: rec_table, rec_key, field_name, item_pos, value."""
    wiki = load(spark, d, "wiki", "wiki_page_id", "wiki_released_raw", "wiki_budget", "wiki_starring")
    fields = F.array(
        F.struct(F.lit("wiki_released_raw").alias("f"), F.array("wiki_released_raw").alias("v")),
        F.struct(F.lit("wiki_budget").alias("f"), F.array("wiki_budget").alias("v")),
        F.struct(F.lit("wiki_starring").alias("f"), F.col("wiki_starring").alias("v")),
    )
    short = wiki.select(F.lit("wiki").alias("rec_table"), F.col("wiki_page_id").alias("rec_key"), F.explode(fields).alias("x"))
    short = short.select("rec_table", "rec_key", F.col("x.f").alias("field_name"), F.posexplode("x.v").alias("item_pos", "value")).where("value IS NOT NULL")
    long = load(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL").select(
        F.lit("documents").alias("rec_table"), F.col("doc_id").cast("string").alias("rec_key"), F.lit("text").alias("field_name"), F.lit(0).alias("item_pos"), F.col("text").alias("value")
    )
    return short.unionByName(long)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.convert(_marked(spark, d)).where("size(kinds) > 0").select("rec_table", "rec_key", "field_name").distinct()


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    found = markup.convert(_marked(spark, d)).select("rec_table", "rec_key", "field_name", "item_pos", "clean", F.array_join("kinds", ",").alias("kinds"))
    return found.dropDuplicates(["rec_table", "rec_key", "field_name", "item_pos"])


def _people(spark: SparkSession, d: str) -> DataFrame:
    rt = load(spark, d, "rt", "cast", "title_norm")
    wiki = load(spark, d, "wiki", "wiki_starring", "wiki_directors", "wiki_title_norm")
    columns = [F.col("cast"), F.col("wiki_starring"), F.col("wiki_directors")]
    return names.link_spellings(names.bare_names(columns, [F.col("title_norm"), F.col("wiki_title_norm"), F.col("wiki_title_norm")], [rt, wiki, wiki]))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return names.spelling_pairs(_people(spark, d))


def p6_people(spark: SparkSession, d: str) -> DataFrame:
    return _people(spark, d)


def _film_links(spark: SparkSession, d: str) -> DataFrame:
    rt = load(spark, d, "rt", "file_path", "page_type", "title", "rt_year", "release_date", "director", "cast", "runtime").where("page_type = 'movie'")
    wiki = load(spark, d, "wiki", "wiki_page_id", "wiki_title", "wiki_title_norm", "wiki_year", "wiki_released_raw", "wiki_directors", "wiki_starring", "wiki_runtime_minutes")
    redirect = load(spark, d, "redirect", "redirect_title", "target_title", "target_title_norm")
    return linkage.best_matches(linkage.link(rt, wiki, redirect))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _film_links(spark, d).select("file_path", "wiki_page_id")


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    return _film_links(spark, d)


def _cut_texts(spark: SparkSession, d: str) -> DataFrame:
    return truncation.detect(load(spark, d, "documents", "doc_id", "text", "lang", "source"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _cut_texts(spark, d).where("is_cut").select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(_cut_texts(spark, d))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(load(spark, d, "documents", "doc_id", "text"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).where("n_pieces > 1").select("doc_id").distinct()


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_packed(spark, d))


def _shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(load(spark, d, "documents", "doc_id", "text", "source"), load(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _shares(spark, d).where("NOT within_reach").select("source")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _shares(spark, d)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(load(spark, d, "documents", "doc_id", "text", "source"), load(spark, d, "mix_targets")).drop("text_id")


QUERIES = {f.__name__: f for f in (p3_found, p3_clean, p6_found, p6_people, p7_found, p7_matches, p8_found, p8_containers, p8_fill, p9_found, p9_shares, p9_mix, p10_found, p10_rates)}
ORACLES: dict[str, str] = {}
