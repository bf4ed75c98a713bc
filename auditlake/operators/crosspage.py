"""Checks across pages: duplicates, canonical targets, sitemap coverage, orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import text as tx
from auditlake.operators.links import page_index
from auditlake.operators.rules import CANONICAL, CONTENT, DESCRIPTIONS, ORPHANS, SITEMAP, TITLES, explode_issues, found


def duplicate_groups(pages: DataFrame, key: Column) -> DataFrame:
    """dup_key, n, multilingual, shared_canonical of each key that more than one page has (null keys do not count).

    Only counts and extremes are gathered: a title that all pages share costs one row a task.
    """
    base = F.nullif(tx.language_base(F.coalesce(F.col("lang"), F.lit(""))), F.lit(""))
    g = pages.select(key.alias("dup_key"), base.alias("base"), "canonical_key").filter("dup_key is not null").groupBy("dup_key")
    g = g.agg(F.count(F.lit(1)).alias("n"), F.min("base").alias("b0"), F.max("base").alias("b1"), F.count("canonical_key").alias("nc"), F.min("canonical_key").alias("c0"), F.max("canonical_key").alias("c1"))
    return g.filter("n > 1").select("dup_key", "n", F.coalesce(F.col("b0") < F.col("b1"), F.lit(False)).alias("multilingual"), ((F.col("nc") == F.col("n")) & (F.col("c0") == F.col("c1"))).alias("shared_canonical"))


def title_key(column: str) -> Column:
    return F.nullif(F.lower(F.trim(F.col(column))), F.lit(""))


def hash_key() -> Column:
    return F.when((F.col("status") >= 200) & (F.col("status") < 300) & ~tx.is_noindex(F.col("robots"), F.col("x_robots")), F.col("content_hash"))


def duplicate_issues(pages: DataFrame) -> DataFrame:
    def of(kind: str, stage: int, key: Column, severity) -> DataFrame:
        keyed = pages.select("page_idx", "url", key.alias("dup_key"))
        both = keyed.join(duplicate_groups(pages, key), "dup_key")
        return explode_issues(both, stage, [found(F.lit(True), F.when(F.col("multilingual"), f"{kind}_duplicate_multilingual").otherwise(f"{kind}_duplicate"), severity, F.col("n"), f" pages have the same {kind}.")])

    lit = F.lit
    return (
        of("title", TITLES, title_key("title"), F.when(F.col("multilingual"), "info").otherwise("warning"))
        .unionByName(of("description", DESCRIPTIONS, title_key("description"), lit("warning")))
        .unionByName(of("content", CONTENT, hash_key(), F.when(F.col("shared_canonical"), "info").otherwise("warning")))
    )


def canonical_issues(pages: DataFrame) -> DataFrame:
    """What a page's canonical target is: in error, noindex, or itself canonicalised elsewhere. The page itself is no target."""
    t = page_index(pages, "status", "robots", "x_robots", "canonical_key")
    t = t.select(F.col("url_key").alias("canonical_key"), F.col("status").alias("t_status"), F.col("robots").alias("t_robots"), F.col("x_robots").alias("t_x"), F.col("canonical_key").alias("t_canonical"))
    both = pages.filter("canonical_key is not null and canonical_key <> url_key").join(t, "canonical_key")
    return explode_issues(
        both,
        CANONICAL,
        [
            found(F.col("t_status") >= 400, "canonical_target_error", "error", "The canonical URL answers with status ", F.col("t_status"), "."),
            found(tx.is_noindex(F.col("t_robots"), F.col("t_x")), "canonical_target_noindex", "warning", "The canonical URL is noindex."),
            found(F.col("t_canonical") != F.col("canonical_key"), "canonical_chain", "warning", "The canonical URL names another one: ", F.col("t_canonical"), "."),
        ],
    )


def sitemap_targets(sitemap: DataFrame, redirects: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per sitemap key (pos, url_key, url): eff, redirected, final_url, and the page it ends at (null if not audited)."""
    once = sitemap.groupBy("url_key").agg(F.min(F.struct("pos", "url")).alias("s")).select("url_key", "s.pos", F.col("s.url").alias("sitemap_url"))
    r = redirects.select(F.col("from_key").alias("url_key"), "final_key", "final_url")
    t = once.join(r, "url_key", "left").withColumn("eff", F.coalesce("final_key", "url_key")).withColumn("redirected", F.col("final_url").isNotNull())
    index = page_index(pages, "url", "robots", "x_robots", "canonical_key").withColumnRenamed("url_key", "eff")
    return t.join(index, "eff", "left")


def sitemap_issues(targets: DataFrame) -> DataFrame:
    hit = targets.filter("page_idx is not null")
    out = explode_issues(
        hit.withColumn("at", F.col("pos")),
        SITEMAP,
        [
            found(F.col("redirected"), "sitemap_url_redirect", "warning", "The sitemap's URL ", F.col("sitemap_url"), " redirects to ", F.col("final_url"), "."),
            found(tx.is_noindex(F.col("robots"), F.col("x_robots")), "sitemap_noindex", "warning", "The sitemap lists a noindex page."),
            found(F.col("canonical_key") != F.col("eff"), "sitemap_noncanonical", "warning", "The sitemap lists a page whose canonical URL is ", F.col("canonical_key"), "."),
        ],
        ("page_idx", "url", "at"),
    )
    # two sitemap URLs can end at one page: the same finding counts once there
    return out.groupBy("page_idx", "url", "stage", "code", "severity", "message").agg(F.min(F.col("at") * 10 + F.col("seq")).alias("seq")).select("page_idx", "url", "stage", "seq", "code", "severity", "message")


def coverage(targets: DataFrame) -> DataFrame:
    """One row: sitemap_urls, audited, redirected, percent (null without a sitemap), complete."""
    c = targets.agg(F.count(F.lit(1)).alias("sitemap_urls"), F.count("page_idx").alias("audited"), F.count_if("redirected").alias("redirected"))
    total = F.col("sitemap_urls")
    return c.withColumn("percent", F.when(total > 0, F.round(F.col("audited") / total * 100, 1))).withColumn("complete", (total > 0) & (F.col("audited") == total))


def orphans(targets: DataFrame, metrics: DataFrame, first_page: int = 0) -> DataFrame:
    """Sitemap pages that nothing links to. Only with complete coverage and more than one page; never the first page."""
    ready = coverage(targets).select("complete")
    pages = metrics.agg(F.count(F.lit(1)).alias("pages"))
    listed = targets.filter(F.col("page_idx").isNotNull() & (F.col("page_idx") != first_page) & ~tx.is_noindex(F.col("robots"), F.col("x_robots"))).select("page_idx", "url").distinct()
    alone = listed.join(metrics.filter("incoming = 0").select("page_idx"), "page_idx", "left_semi")
    gate = F.broadcast(ready.crossJoin(pages))  # one row by one row
    return alone.crossJoin(gate).filter("complete and pages > 1").select("page_idx", "url")


def orphan_issues(targets: DataFrame, metrics: DataFrame) -> DataFrame:
    return explode_issues(orphans(targets, metrics), ORPHANS, [found(F.lit(True), "orphan_candidate", "warning", "No audited page links to this page of the sitemap.")])
