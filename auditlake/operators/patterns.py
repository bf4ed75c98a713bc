"""Repeated problems and tallies over issues (page_idx, url, stage, seq, code, severity, message, expected)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.operators.rules import rank

#: Categories by the codes' beginnings; the first that fits counts, else "technical".
CATEGORIES = (
    ("metadata", "title_", "description_"),
    ("social", "og_", "twitter_", "social_"),
    ("multilingual", "hreflang_", "html_lang_"),
    ("canonical", "canonical_"),
    ("structured-data", "jsonld_"),
    ("internal-links", "internal_link_", "broken_internal_", "mixed_scheme_"),
    ("images", "image_"),
    ("indexability", "robots_", "x_robots_"),
)
TEMPLATED = ("metadata", "social", "multilingual", "structured-data", "images")
#: Where to look first when a finding of the category repeats.
PLACES = {
    "metadata": "the template of the head",
    "social": "the preview tags",
    "multilingual": "the language switch",
    "canonical": "how canonical URLs are built",
    "structured-data": "what writes the JSON-LD",
    "internal-links": "menus and shared links",
    "images": "the image component",
    "indexability": "the robots settings",
    "technical": "the server and what runs on it",
}


def category(code: Column) -> Column:
    out = None
    for name, *starts in CATEGORIES:
        hit = F.lit(False)
        for s in starts:
            hit = hit | F.startswith(code, F.lit(s))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("technical")


def humanize(code: Column) -> Column:
    return F.initcap(F.replace(code, F.lit("_"), F.lit(" ")))


def patterns(issues: DataFrame, pages: DataFrame, limit: int | None = 20) -> DataFrame:
    """Codes of one severity on two URLs or more: code, title, severity, category, scope, urls, occurrences, example_message, likely_root_cause, first_seen.

    Order: severity, URLs, first seen; the limit is the report's. One row per code is gathered, whatever the
    number of issues; the example is the first that is not blank.
    """
    place = F.struct("page_idx", "stage", "seq")
    message = F.trim(F.coalesce(F.col("message"), F.lit("")))
    g = issues.filter(~F.coalesce(F.col("expected"), F.lit(False))).groupBy("severity", "code")
    g = g.agg(F.count_distinct(F.nullif("url", F.lit(""))).alias("urls"), F.count(F.lit(1)).alias("occurrences"), F.min(place).alias("first"), F.min(F.when(message != "", F.struct(place.alias("at"), message.alias("m")))).alias("example"))
    total = F.broadcast(pages.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("_pages")))  # one row
    g = g.filter("urls > 1").crossJoin(total).withColumn("category", category(F.col("code")))
    scope = F.when((F.col("urls") >= 3) & (F.col("urls") / F.col("_pages") >= 0.5) & F.col("category").isin(*TEMPLATED), "likely-template").when((F.col("urls") == F.col("_pages")) & (F.col("_pages") > 1), "sitewide").otherwise("repeated")
    place_to_look = F.element_at(F.create_map(*[F.lit(x) for kv in PLACES.items() for x in kv]), F.col("category"))
    cause = F.concat(F.when(F.col("scope") == "likely-template", "At least half of the pages have it. ").otherwise(""), F.lit("Look first at "), place_to_look, F.lit("."))
    out = g.withColumn("scope", scope).select(
        "code", humanize(F.col("code")).alias("title"), "severity", "category", "scope", "urls", "occurrences", F.coalesce("example.m", F.lit("")).alias("example_message"),
        cause.alias("likely_root_cause"), F.col("first.page_idx").alias("first_seen"), "first",
    )
    order = [rank(F.col("severity")).desc(), F.col("urls").desc(), F.col("first")]
    return (out.orderBy(*order).limit(limit) if limit else out).drop("first")


def severity_counts(issues: DataFrame) -> DataFrame:
    """One row: errors, warnings, infos, without the expected ones."""
    counted = issues.filter(~F.coalesce(F.col("expected"), F.lit(False)))
    return counted.agg(*[F.count_if(F.col("severity") == s).alias(n) for s, n in (("error", "errors"), ("warning", "warnings"), ("info", "infos"))])


#: Findings that a protected staging site is meant to have.
EXPECTED = ("robots_noindex", "x_robots_noindex", "sitemap_noindex", "robots_txt_blocked", "hreflang_target_noindex", "canonical_target_noindex")
EXPECTED_ELSEWHERE = ("canonical_other", "sitemap_noncanonical", "hreflang_target_canonical_other")


def staging_context(issues: DataFrame, pages: DataFrame) -> DataFrame:
    """Issues as a staging audit reports them: what protection causes is expected, and only information.

    Canonical findings are expected where the page's canonical lies at another origin (cross_origin).
    """
    cross = pages.select("page_idx", F.col("cross_origin").alias("_cross"))
    both = issues.join(cross, "page_idx", "left")
    expected = F.col("code").isin(*EXPECTED) | (F.col("code").isin(*EXPECTED_ELSEWHERE) & F.coalesce(F.col("_cross"), F.lit(False)))
    return both.withColumn("expected", expected).withColumn("severity", F.when(expected, "info").otherwise(F.col("severity"))).drop("_cross")


def staging_protection(pages: DataFrame) -> DataFrame:
    """One row: protected (noindex or blocked by robots.txt), unprotected (of the 2xx pages), status."""
    from auditlake.functions import text as tx

    ok = (F.col("status") >= 200) & (F.col("status") < 300)
    held = tx.is_noindex(F.col("robots"), F.col("x_robots")) | ~F.coalesce(F.col("robots_allowed"), F.lit(True))
    n = pages.agg(F.count_if(held).alias("protected"), F.count_if(ok & ~held).alias("unprotected"))
    status = F.when(F.col("unprotected") > 0, F.when(F.col("protected") > 0, "partial").otherwise("unprotected")).when(F.col("protected") > 0, "protected").otherwise("unknown")
    return n.withColumn("status", status)
