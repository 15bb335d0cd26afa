"""Statistics and validation of extracted pages. Partial sums merge by themselves in Spark's two-step aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmloom.functions.bpe import token_count
from filmloom.functions.text import whitespace_tokens

COMPLETE_FIELDS = ("title", "url", "description", "tomatometer", "audience_score", "genres", "cast")


def _told(df: DataFrame, c: str) -> Column:
    kind = dict(df.dtypes)[c]
    col = F.col(f"`{c}`")
    if kind.startswith("array"):
        return F.coalesce(F.size(col) > 0, F.lit(False))
    if kind == "string":
        return F.coalesce(col != "", F.lit(False))
    return F.coalesce(col > 0, F.lit(False))


def page_types(pages: DataFrame) -> DataFrame:
    return pages.groupBy(F.coalesce("page_type", F.lit("unknown")).alias("page_type")).agg(F.count("*").alias("n"))


def completeness(pages: DataFrame) -> DataFrame:
    """(field, n_told, percent) of the fields; one pass over the pages. No rows for an empty table's percent but NULL."""
    one = pages.agg(F.count("*").alias("total"), *[F.count_if(_told(pages, c)).alias(c) for c in COMPLETE_FIELDS])
    rows = one.select("total", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").alias("n_told")) for c in COMPLETE_FIELDS])).alias("x"))
    return rows.select("x.field", "x.n_told", F.when(F.col("total") > 0, F.round(F.col("x.n_told") * 100.0 / F.col("total"), 2)).alias("percent"))


def scores(pages: DataFrame) -> DataFrame:
    """(score, n, average) of the scores above 0 of films and series."""
    media = pages.where(F.col("page_type").isin("movie", "tv"))
    rows = media.select(F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).alias("v")) for s in ("tomatometer", "audience_score")])).alias("x"))
    return rows.where("x.v > 0").groupBy("x.score").agg(F.count("*").alias("n"), F.round(F.avg("x.v"), 2).alias("average"))


def token_counts(pages: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row: tokens of descriptions and synopses by the vocabulary of a rank file (words where none is given), in all, and
    per page."""
    size = lambda c: token_count(F.col(c), vocabulary) if vocabulary else whitespace_tokens(F.col(c))
    sized = pages.select(size("description").alias("d"), size("synopsis").alias("s"))
    return sized.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("description_tokens"), F.coalesce(F.sum("s"), F.lit(0)).alias("synopsis_tokens"), F.count("*").alias("n")).select(
        "description_tokens", "synopsis_tokens", (F.col("description_tokens") + F.col("synopsis_tokens")).alias("total_tokens"),
        F.when(F.col("n") > 0, F.round((F.col("description_tokens") + F.col("synopsis_tokens")) / F.col("n"), 2)).otherwise(0.0).alias("tokens_per_page"),
    )


def issues(pages: DataFrame) -> DataFrame:
    """(file_path, issue): what each page lacks; media rules for films and series only."""
    media = F.col("page_type").isin("movie", "tv")
    no = lambda c: ~_told(pages, c)
    rules = {
        "missing_title": no("title"),
        "missing_url": no("url"),
        "missing_scores": media & no("tomatometer") & no("audience_score"),
        "missing_genres": media & no("genres"),
        "missing_description": media & no("description") & no("synopsis"),
    }
    found = F.filter(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return pages.select("file_path", F.explode(found).alias("issue"))


def issue_counts(pages: DataFrame) -> DataFrame:
    return issues(pages).groupBy("issue").agg(F.count("*").alias("n"))


def seeded_sample(pages: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """n rows in an order that depends on the key and a seed only (a sample that can be drawn again)."""
    return pages.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key))), key).limit(n)
