"""Queries of the general data-preparation operators (problems 1, 2, 4 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filmloom.operators import compaction, multivalue, timestamps, units
from filmloom.session import load, staged_path


def _store_plan(spark: SparkSession, d: str) -> DataFrame:
    manifest = compaction.freeze_manifest(load(spark, d, "stored_files"), load(spark, d, "urls", "file_path"))
    return compaction.plan_bins(manifest)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return compaction.small_file_dirs(_store_plan(spark, d)).select("store_dir")


def p1_compact(spark: SparkSession, d: str) -> DataFrame:
    # below the folder of staged tables, so that drop_staged removes the copy as well
    return compaction.rewrite(_store_plan(spark, d), load(spark, d, "rt"), staged_path(spark, "compacted"))


def _amounts(spark: SparkSession, d: str) -> DataFrame:
    wiki = load(spark, d, "wiki", "wiki_page_id", "wiki_budget", "wiki_box_office")
    return units.convert(wiki, load(spark, d, "fx_rates"), "wiki_page_id", ("wiki_budget", "wiki_box_office")).withColumnRenamed("key", "wiki_page_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return units.other_units(_amounts(spark, d)).select("wiki_page_id", "field_name").distinct()


def p2_amounts(spark: SparkSession, d: str) -> DataFrame:
    return _amounts(spark, d)


def _instants(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:www\.)?([^/:?#]+)", 1)
    rt = load(spark, d, "rt", "file_path", "url", "title_norm", "release_date").select(
        F.lit("rt").alias("rec_table"), F.col("file_path").alias("rec_key"), host.alias("source"), F.col("title_norm").alias("subject"), F.col("release_date").alias("value")
    )
    wiki = load(spark, d, "wiki", "wiki_page_id", "wiki_title_norm", "wiki_released_raw").select(
        F.lit("wiki").alias("rec_table"), F.col("wiki_page_id").alias("rec_key"), F.lit("wiki").alias("source"), F.col("wiki_title_norm").alias("subject"), F.col("wiki_released_raw").alias("value")
    )
    declared = load(spark, d, "site_zones").withColumnRenamed("host", "source")
    parsed = timestamps.parse(rt.unionByName(wiki), declared)
    # when the page of a zone-less time was fetched; a stored file's name tells its page, however the path is spelled
    name = lambda c: F.substring_index(F.trim(F.translate(c, "\\", "/")), "/", -1)
    asked = timestamps.open_readings(parsed).where("rec_table = 'rt'").select("rec_table", "rec_key", name(F.col("rec_key")).alias("name")).distinct()
    fetched = load(spark, d, "urls", "file_path", "crawled_at").where("crawled_at IS NOT NULL AND file_path <> ''").select(name(F.col("file_path")).alias("name"), F.col("crawled_at").cast("timestamp_ntz").alias("at"))
    ingested = fetched.join(asked, "name").select("rec_table", "rec_key", "at").distinct()
    return timestamps.normalise(parsed, timestamps.choose_zones(parsed, declared, ingested))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.not_in_form(_instants(spark, d))


def p4_instants(spark: SparkSession, d: str) -> DataFrame:
    return _instants(spark, d).distinct()


def _values(spark: SparkSession, d: str) -> DataFrame:
    rt = load(spark, d, "rt", "file_path", "director").select(
        F.lit("rt").alias("rec_table"), F.col("file_path").alias("rec_key"), F.lit("director").alias("field_name"), F.array("director").alias("elements")
    )
    wiki = load(spark, d, "wiki", "wiki_page_id", "wiki_countries", "wiki_languages")
    for c in ("wiki_countries", "wiki_languages"):
        rt = rt.unionByName(wiki.select(F.lit("wiki").alias("rec_table"), F.col("wiki_page_id").alias("rec_key"), F.lit(c).alias("field_name"), F.col(c).alias("elements")))
    return multivalue.one_row_per_value(multivalue.split(multivalue.field_elements(rt)))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _values(spark, d).where("is_packed").select("rec_table", "rec_key", "field_name", "value_pos")


def p5_values(spark: SparkSession, d: str) -> DataFrame:
    return _values(spark, d).select("rec_table", "rec_key", "field_name", "value_pos", "value")


QUERIES = {f.__name__: f for f in (p1_found, p1_compact, p2_found, p2_amounts, p4_found, p4_instants, p5_found, p5_values)}

_SQL_PATH = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_extract(regexp_replace(trim(replace({x}, chr(92), '/')), '^[A-Za-z][A-Za-z0-9+.-]*://', '/'), '^(?:.*?/)?(data/.*)$', 1), '/(?:[.]?/)+', '/', 'g'), '[^/]+/[.][.]/', ''), '[^/]+/[.][.]/', '')"
)
ORACLES: dict[str, str] = {
    "p1_found": f"""
WITH s AS (SELECT {_SQL_PATH.format(x='file_path')} AS path, max(modified_at) AS at, max_by(n_bytes, (modified_at, n_bytes)) AS n_bytes FROM stored_files WHERE file_path IS NOT NULL GROUP BY 1),
 u AS (SELECT DISTINCT {_SQL_PATH.format(x='file_path')} AS path FROM urls WHERE file_path <> '')
SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS store_dir FROM s JOIN u USING (path) WHERE path <> '' GROUP BY 1 HAVING count(*) >= 20 AND avg(n_bytes) < 32768""",
}
