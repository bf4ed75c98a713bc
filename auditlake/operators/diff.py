"""Comparison of two audits: issues, pages, progress, launch readiness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import urls


def page_key(path_aware: bool, url: str = "url") -> Column:
    return urls.path_key(F.col(url)) if path_aware else F.col(url)


def issue_map(issues: DataFrame, path_aware: bool = False, by_message: bool = False) -> DataFrame:
    """issue_key, url, scope, code, severity, message: per page and code (or message) the last issue, expected ones left out.

    Site issues have a null page_idx.
    """
    message = F.trim(F.coalesce("message", "code", F.lit("")))
    what = message if by_message else F.coalesce(F.nullif("code", F.lit("")), F.nullif("message", F.lit("")), F.lit("unknown"))
    site = F.col("page_idx").isNull()
    key = F.concat(F.when(site, F.lit("site")).otherwise(page_key(path_aware)), F.lit("|"), what)
    kept = issues.filter(~F.coalesce(F.col("expected"), F.lit(False)))
    kept = kept.filter(message != "") if by_message else kept
    place = F.struct(F.coalesce("page_idx", F.lit(-1)).alias("page_idx"), "stage", "seq")
    g = kept.withColumn("issue_key", key).withColumn("scope", F.when(site, "Site").otherwise("Page"))
    return g.groupBy("issue_key").agg(F.max_by(F.struct("url", "scope", "code", "severity", "message"), place).alias("i")).select("issue_key", "i.*")


def diff_issues(previous: DataFrame, current: DataFrame, path_aware: bool = False, by_message: bool = False) -> DataFrame:
    """issue_key, change (new, fixed, changed), before and after of each; equal ones are left out. One full outer join."""
    a, b = (issue_map(x, path_aware, by_message) for x in (previous, current))
    cols = ["url", "scope", "code", "severity", "message"]
    a = a.select("issue_key", F.struct(*cols).alias("before"))
    b = b.select("issue_key", F.struct(*cols).alias("after"))
    text = lambda c: F.coalesce(c, F.lit(""))
    change = (
        F.when(F.col("before").isNull(), "new")
        .when(F.col("after").isNull(), "fixed")
        .when((text(F.col("before.severity")) != text(F.col("after.severity"))) | (text(F.col("before.message")) != text(F.col("after.message"))), "changed")
    )
    return a.join(b, "issue_key", "full").withColumn("change", change).filter("change is not null")


def diff_pages(previous: DataFrame, current: DataFrame, path_aware: bool = False) -> DataFrame:
    """key, change (new, removed, changed), url, previous_url, fields (what changed, joined by commas)."""
    last = lambda df: df.withColumn("key", page_key(path_aware)).groupBy("key").agg(F.max_by(F.struct("url", "indexability", "canonical", "title", "description", "h1"), "page_idx").alias("p"))
    both = last(previous).withColumnRenamed("p", "a").join(last(current).withColumnRenamed("p", "b"), "key", "full")
    text = lambda c: F.coalesce(c, F.lit(""))
    canonical = lambda c: F.when(c.isNull() | (c == ""), F.lit("")).otherwise(urls.path_key(c) if path_aware else c)
    differs = [
        *([] if path_aware else [("indexability", text(F.col("a.indexability")) != text(F.col("b.indexability")))]),
        ("canonical", canonical(F.col("a.canonical")) != canonical(F.col("b.canonical"))),
        *[(f, text(F.col(f"a.{f}")) != text(F.col(f"b.{f}"))) for f in ("title", "description")],
        ("h1", F.array_join(F.coalesce("a.h1", F.array().cast("array<string>")), " | ") != F.array_join(F.coalesce("b.h1", F.array().cast("array<string>")), " | ")),
    ]
    fields = F.array_join(F.array_compact(F.array(*[F.when(c, n) for n, c in differs])), ",")
    change = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "removed").when(fields != "", "changed")
    return both.withColumn("change", change).filter("change is not null").select("key", "change", F.coalesce("b.url", "a.url").alias("url"), F.col("a.url").alias("previous_url"), F.when(F.col("change") == "changed", fields).alias("fields"))


def progress(previous: DataFrame, current: DataFrame, previous_pages: DataFrame, current_pages: DataFrame) -> DataFrame:
    """issue_key, state (fixed, introduced, remaining): site issues, and issues of pages that both audits have."""
    shared = previous_pages.select("url").distinct().join(current_pages.select("url").distinct(), "url", "left_semi")
    a = issue_map(previous).select("issue_key", F.col("url").alias("url_a"), F.col("scope").alias("scope_a"))
    b = issue_map(current).select("issue_key", F.col("url").alias("url_b"), F.col("scope").alias("scope_b"))
    both = a.join(b, "issue_key", "full").withColumn("url", F.coalesce("url_b", "url_a")).withColumn("scope", F.coalesce("scope_b", "scope_a"))
    state = F.when(F.col("scope_b").isNull(), "fixed").when(F.col("scope_a").isNull(), "introduced").otherwise("remaining")
    both = both.withColumn("state", state).join(shared.withColumn("_shared", F.lit(True)), "url", "left")
    return both.filter((F.col("scope") == "Site") | F.col("_shared")).select("issue_key", "state", "scope")


def launch_readiness(issue_changes: DataFrame, page_changes: DataFrame, current_issues: DataFrame, current_pages: DataFrame, coverage: DataFrame) -> DataFrame:
    """Eight rows check_no, check_name, value, verdict (good, review, bad) for a staging audit against the live one.

    Every measure is a scalar aggregate; the rows are put together from single-row tables.
    """
    unexpected = current_issues.filter(~F.coalesce(F.col("expected"), F.lit(False)))
    drift = F.exists(F.split("fields", ","), lambda f: f.isin("title", "description", "h1"))
    measures = [
        ("sitemap_coverage", coverage.agg(F.max("percent").cast("double").alias("v")), "review"),
        ("sitemap_noindex", unexpected.filter("code = 'sitemap_noindex'").agg(F.count_distinct("page_idx").cast("double").alias("v")), "bad"),
        ("robots_blocked", current_pages.agg(F.count_if(~F.coalesce(F.col("robots_allowed"), F.lit(True))).cast("double").alias("v")), "bad"),
        ("origin_warnings", current_issues.filter("page_idx is null and code in ('origin_variant_direct_200', 'canonical_origin_conflict')").agg(F.count(F.lit(1)).cast("double").alias("v")), "review"),
        ("missing_paths", page_changes.agg(F.count_if(F.col("change") == "removed").cast("double").alias("v")), "review"),
        ("metadata_drift", page_changes.filter("change = 'changed'").agg(F.count_if(drift).cast("double").alias("v")), "review"),
        ("new_errors", issue_changes.agg(F.count_if((F.col("change") == "new") & (F.col("after.severity") == "error")).cast("double").alias("v")), "bad"),
        ("new_warnings", issue_changes.agg(F.count_if((F.col("change") == "new") & (F.col("after.severity") == "warning")).cast("double").alias("v")), "review"),
    ]
    rows = []
    for k, (name, df, fault) in enumerate(measures, 1):
        good = F.col("v") == (100.0 if name == "sitemap_coverage" else 0.0)
        rows.append(df.select(F.lit(k).alias("check_no"), F.lit(name).alias("check_name"), F.col("v").alias("value"), F.when(good, "good").otherwise(fault).alias("verdict")))
    return reduce(DataFrame.unionByName, rows)
