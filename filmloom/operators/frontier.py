"""The crawl frontier as a table: its transitions, selections and figures. No page is fetched here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from filmloom.functions import url as U

# The states of a page, and what only a blocking page says.
STATUSES = ("discovered", "queued", "crawled", "failed")
BLOCKING_MARKS = ("captcha", "access denied", "bot detected", "cloudflare")


def latest(urls: DataFrame) -> DataFrame:
    """One row per normalized_url: the furthest state (crawled, failed, queued, discovered), then the latest times, most
    tries, least depth, and the greatest of the texts.

    max_by aggregates map-side, so a page found very many times is no hot group. Rows without a key are dropped.
    """
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status")), F.lit(0))
    done = F.when(F.col("status") == "crawled", 5).when(F.col("status") == "failed", 4).otherwise(rank)
    row = F.struct(*[F.col(f"`{c}`") for c in urls.columns])
    start = F.lit("1970-01-01").cast(dict(urls.dtypes)["crawled_at"])
    text = lambda c: F.coalesce(c, F.lit(""))
    number = lambda c: F.coalesce(c, F.lit(0))
    order = F.struct(
        done, F.coalesce("crawled_at", start), F.coalesce("discovered_at", start), number("retry_count"), -number(F.col("depth")), text("url"), text("file_path"), number("response_code"), text("error_message")
    )
    return urls.where("normalized_url IS NOT NULL").groupBy("normalized_url").agg(F.max_by(row, order).alias("r")).select("r.*")


def insert_new(frontier: DataFrame, found: DataFrame) -> DataFrame:
    """found (url, depth, discovered_at) rows whose normal form the frontier lacks, as discovered; of one form the
    earliest, then least depth and url."""
    keyed = found.where("url IS NOT NULL").withColumn("normalized_url", U.normalize(F.col("url")))
    first = keyed.groupBy("normalized_url").agg(F.min_by(F.struct("url", "depth", "discovered_at"), F.struct("discovered_at", "depth", "url")).alias("f"))
    new = first.join(frontier.select("normalized_url").distinct(), "normalized_url", "left_anti")
    return new.select("f.url", "normalized_url", F.lit("discovered").alias("status"), "f.depth", "f.discovered_at", F.lit(0).alias("retry_count"))


def known(frontier: DataFrame, urls: DataFrame) -> DataFrame:
    """urls (url) with their normal form and whether the frontier has it. NULL urls are not known."""
    asked = urls.select("url", U.normalize(F.col("url")).alias("normalized_url"))
    keys = frontier.select("normalized_url", F.lit(True).alias("__hit")).distinct()
    return asked.join(keys, "normalized_url", "left").select("url", "normalized_url", F.coalesce("__hit", F.lit(False)).alias("is_known"))


def next_batch(frontier: DataFrame, n: int) -> DataFrame:
    """The n discovered rows of least depth, then url (of the normal form where urls agree)."""
    return frontier.where("status = 'discovered'").orderBy("depth", "url", "normalized_url").limit(n)


def mark_queued(frontier: DataFrame, batch: DataFrame) -> DataFrame:
    keys = batch.select("normalized_url", F.lit(True).alias("__hit")).distinct()
    return frontier.join(keys, "normalized_url", "left").withColumn("status", F.when(F.col("__hit"), "queued").otherwise(F.col("status"))).drop("__hit")


def apply_outcomes(frontier: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The frontier after outcomes (normalized_url, ok, at, file_path, response_code, error_message), at most one per key.

    Success and failure both stamp crawled_at; a failure counts one more try.
    """
    o = outcomes.select("normalized_url", *[F.col(c).alias(f"o_{c}") for c in ("ok", "at", "file_path", "response_code", "error_message")])
    hit = F.col("o_ok").isNotNull()
    out = frontier.join(o, "normalized_url", "left").withColumns(
        {
            "status": F.when(F.col("o_ok"), "crawled").when(hit, "failed").otherwise(F.col("status")),
            "crawled_at": F.when(hit, F.col("o_at")).otherwise(F.col("crawled_at")),
            "retry_count": F.col("retry_count") + F.when(hit & ~F.col("o_ok"), 1).otherwise(0),
            "file_path": F.when(F.col("o_ok"), F.col("o_file_path")).otherwise(F.col("file_path")),
            "response_code": F.when(hit, F.col("o_response_code")).otherwise(F.col("response_code")),
            "error_message": F.when(hit & ~F.col("o_ok"), F.col("o_error_message")).otherwise(F.col("error_message")),
        }
    )
    return out.select(frontier.columns)


def recover(frontier: DataFrame, max_retries: int) -> DataFrame:
    """Queued or failed rows that were never fetched and have tries left become discovered again. (A failure stamps
    crawled_at, so failed rows normally stay.)"""
    again = F.col("status").isin("queued", "failed") & F.col("crawled_at").isNull() & (F.coalesce("retry_count", F.lit(0)) < max_retries)
    return frontier.withColumn("status", F.when(again, "discovered").otherwise(F.col("status")))


def figures(frontier: DataFrame) -> DataFrame:
    """One row: rows by status, their total, files saved, tries, replies 429."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return frontier.agg(
        *counts,
        F.count_if(F.col("status").isin(*STATUSES)).alias("total"),
        F.count_if(F.coalesce("file_path", F.lit("")) != "").alias("files_saved"),
        F.coalesce(F.sum("retry_count"), F.lit(0)).alias("retries"),
        F.count_if(F.col("response_code") == 429).alias("rate_limited"),
    )


def progress(frontier: DataFrame, target: int, hours: float) -> DataFrame:
    """One row: share of the target reached in %, pages per hour, hours left at that pace (NULL before the first page)."""
    n = F.count_if(F.col("status") == "crawled")
    return frontier.agg(n.alias("crawled")).select(
        "crawled", F.round(F.col("crawled") * 100.0 / target, 4).alias("percent"), F.round(F.col("crawled") / hours, 4).alias("per_hour"),
        F.when(F.col("crawled") > 0, F.round((target - F.col("crawled")) * hours / F.col("crawled"), 4)).alias("hours_left"),
    )


def checkpoint_row(frontier: DataFrame, at: Column) -> DataFrame:
    """The single checkpoint row; what it calls queued is the number of discovered rows."""
    return frontier.agg(F.count_if(F.col("status") == "crawled").alias("urls_crawled"), F.count_if(F.col("status") == "discovered").alias("urls_queued"), F.count("*").alias("total_urls")).select(
        F.lit("1").alias("id"), at.alias("checkpoint_time"), "urls_crawled", "urls_queued", "total_urls"
    )


def outcome(response_code: Column, error: Column, content_type: Column, body: Column, tries: Column) -> Column:
    """Struct (kind, wait_seconds) of a fetch: ok, not_found, rate_limited, forbidden, client_error, server_error, not_html,
    blocked, network."""
    wait = lambda seconds: F.pow(F.lit(2.0), F.coalesce(tries, F.lit(0))) * seconds
    page = F.lower(F.coalesce(body, F.lit("")))
    blocked = page.rlike("|".join(BLOCKING_MARKS))
    kind = (
        F.when(response_code == 404, "not_found")
        .when(response_code == 429, "rate_limited")
        .when(response_code == 403, "forbidden")
        .when(response_code.between(400, 499), "client_error")
        .when(response_code >= 500, "server_error")
        .when(response_code.isNull() & error.isNotNull(), "network")
        .when(~F.coalesce(content_type, F.lit("text/html")).contains("text/html"), "not_html")
        .when(blocked, "blocked")
        .otherwise("ok")
    )
    return F.struct(kind.alias("kind"), F.when(kind == "rate_limited", wait(60)).when(kind == "network", wait(30)).otherwise(0.0).alias("wait_seconds"))


def discovered_links(pages: DataFrame, hosts: tuple[str, ...]) -> DataFrame:
    """(url, depth, discovered_at) of the content links of fetched pages (url, html, depth, at): one deeper than their own
    page. A link found on several pages keeps its least depth."""
    rows = pages.select(F.explode(U.links(F.col("html"), F.col("url"))).alias("link"), "depth", "at")
    return rows.where(U.is_content(F.col("link"), hosts)).groupBy(F.col("link").alias("url")).agg((F.min("depth") + 1).alias("depth"), F.min("at").alias("discovered_at"))


def rate_windows(events: DataFrame, key: list[str], ts: str, per_minute: int, per_hour: int, errors: Column | None = None) -> DataFrame:
    """events with the number of earlier ones in the last 60 and 3600 seconds (the ends not counted) and whether a limit is
    reached. Limits shrink with recent errors above two, to no less than 10 and 100.

    A key's events are parted by the hour, each part with the events of the hour before it carried over (as times only):
    no window holds all events of a key, and every frame is whole.
    """
    hour = 3_600_000_000
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    told = events.withColumns({"__us": micros, "__part": F.floor(micros / hour), "__own": F.lit(True)})
    empty = [F.lit(None).cast(t).alias(c) for c, t in events.dtypes if c not in key]
    carried = told.select(*key, *empty, "__us", (F.col("__part") + 1).alias("__part"), F.lit(False).alias("__own")).select(told.columns)
    w = lambda seconds: Window.partitionBy(*key, "__part").orderBy("__us").rangeBetween(-(seconds * 1_000_000 - 1), -1)
    e = F.coalesce(errors, F.lit(0)) if errors is not None else F.lit(0)
    factor = 1 + F.greatest(F.lit(0), e - 2) * 0.3
    out = told.unionByName(carried).withColumns({"last_minute": F.count("*").over(w(60)), "last_hour": F.count("*").over(w(3600))}).where("__own")
    limit = lambda most, least: F.greatest(F.lit(least), F.floor(most / factor))
    return out.withColumn("must_wait", (F.col("last_minute") >= limit(per_minute, 10)) | (F.col("last_hour") >= limit(per_hour, 100))).drop("__us", "__part", "__own")
