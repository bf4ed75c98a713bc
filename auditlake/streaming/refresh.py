"""Page facts kept fresh from a stream of responses.

Page rules need one page at a time, so they run on the stream itself; checks across pages are computed anew
over the facts table, which each batch updates by URL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.html import MAX_BODY_BYTES, extract_pages
from auditlake.functions.urls import url_key
from auditlake.operators import rules
from auditlake.sources.responses import SCHEMA, text_of


def responses_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA + ", seen_at timestamp").parquet(path)


def page_stream(responses: DataFrame) -> DataFrame:
    """Parsed pages of a stream (or table) of responses, with status; only what is not html is left out.

    A body over the limit is a failed fetch, as in a crawl: its row has status 0 and what an empty document gives.
    """
    html = responses.filter((F.col("status") > 0) & F.contains(F.lower(F.coalesce("content_type", F.lit("text/html"))), F.lit("html")))
    fits = F.coalesce(F.octet_length("body"), F.lit(0)) <= MAX_BODY_BYTES
    rows = html.select(F.xxhash64("url").alias("page_idx"), "url", "seen_at", F.when(fits, F.col("status")).otherwise(0).alias("status"), F.when(fits, text_of(F.col("body"))).alias("html"))
    return extract_pages(rows).withColumn("url_key", url_key(F.col("url")))


def issue_stream(responses: DataFrame) -> DataFrame:
    """Page rules over the pages that were fetched, and fetch_failed for those over the limit."""
    pages = page_stream(responses)
    failed = pages.filter("status = 0").select("page_idx", "url", F.lit(rules.FETCH).alias("stage"), F.lit(0).cast("long").alias("seq"), F.lit("fetch_failed").alias("code"), F.lit("error").alias("severity"), F.lit("The page could not be fetched.").alias("message"))
    return rules.page_issues(pages.filter("status > 0")).unionByName(failed)


def latest(pages: DataFrame) -> DataFrame:
    """The newest fact of each page."""
    return pages.groupBy("url_key").agg(F.max_by(F.struct(*[c for c in pages.columns if c != "url_key"]), "seen_at").alias("p")).select("url_key", "p.*")


def issue_rate(issues: DataFrame, at: str = "seen_at", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Issues by code and time window, with a watermark that lets state go."""
    return issues.withWatermark(at, late).groupBy(F.window(at, window), "code").agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", "code", "n")


def keep_fresh(responses: DataFrame, facts_path: str, checkpoint: str):
    """Appends each batch's parsed pages, tagged with the batch, so that a batch run twice is written once."""

    def write(batch: DataFrame, number: int) -> None:
        page_stream(batch).drop("visible_text", "fingerprint_text").write.mode("overwrite").parquet(f"{facts_path}/batch={number}")

    return responses.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
