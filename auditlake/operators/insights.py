"""What to do first: priorities, link opportunities, repeated metadata, filters of a report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import text as tx


def priorities(issues: DataFrame, pages: DataFrame) -> DataFrame:
    """priority (0 fix first, 1 improve, 2 review), code, urls, example. pages: page_idx, indexability, robots, x_robots."""
    p = pages.select("page_idx", (F.col("indexability") == "indexable").alias("indexed"), (tx.mentions_noindex(F.col("robots")) | tx.mentions_noindex(F.col("x_robots"))).alias("held"))
    both = issues.filter(~F.coalesce(F.col("expected"), F.lit(False))).join(p, "page_idx")
    meta = F.col("code").rlike("^(title_|description_|canonical_missing)")
    level = F.when(F.col("held") & meta, 2).when((F.col("severity") == "error") & ~F.col("held"), 0).when(F.col("indexed") & (F.col("severity") == "warning"), 1).otherwise(2)
    place = F.struct("page_idx", "stage", "seq")
    return both.withColumn("priority", level).groupBy("priority", "code").agg(F.count_distinct("url").alias("urls"), F.min_by("message", place).alias("example"))


def top_priorities(found: DataFrame, per_level: int = 12) -> DataFrame:
    """The report's groups: most URLs first within each priority."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("priority").orderBy(F.col("urls").desc(), "code")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= per_level)


def eligible(pages: DataFrame) -> DataFrame:
    return pages.filter("indexability = 'indexable' and status >= 200 and status < 300")


def opportunities(pages: DataFrame) -> DataFrame:
    """opportunity, page_idx, url. pages: status, indexability, in_sitemap, incoming, contextual_incoming, depth."""
    e = eligible(pages)
    kinds = [
        ("few-inbound", F.col("in_sitemap") & (F.col("incoming") <= 1)),
        ("deep", F.col("depth") >= 4),
        ("no-contextual", F.col("in_sitemap") & (F.col("contextual_incoming") == 0)),
        ("not-in-sitemap", ~F.col("in_sitemap") & (F.col("incoming") > 0)),
    ]
    return e.select("page_idx", "url", F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in kinds]))).alias("opportunity"))


def no_contextual_inbound(pages: DataFrame) -> DataFrame:
    return pages.filter("indexability = 'indexable' and in_sitemap and depth > 0 and contextual_incoming = 0")


def metadata_groups(pages: DataFrame) -> DataFrame:
    """field, text_key, pages, multilingual (by whole lang), example: values that several eligible pages share."""

    def of(field: str) -> DataFrame:
        value = tx.clean(F.coalesce(F.col(field), F.lit("")))
        lang = F.nullif(F.lower(F.coalesce("lang", F.lit(""))), F.lit(""))
        g = eligible(pages).withColumn("text_key", F.lower(value)).filter("text_key <> ''").withColumn("_l", lang).groupBy("text_key")
        g = g.agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.min("_l") < F.max("_l"), F.lit(False)).alias("multilingual"), F.min_by(field, "page_idx").alias("example"))
        return g.filter("pages > 1").select(F.lit(field).alias("field"), "text_key", "pages", "multilingual", "example")

    return reduce(DataFrame.unionByName, map(of, ("title", "description")))


def filter_pages(pages: DataFrame, issues: DataFrame, severity: str = "all", text: str = "") -> DataFrame:
    """Pages of a report by an issue's severity (or `expected`) and by a text in any of the fields shown."""
    i = issues.groupBy("page_idx").agg(F.collect_set("severity").alias("_s"), F.max(F.coalesce("expected", F.lit(False))).alias("_e"), F.array_join(F.collect_set(F.concat_ws(" ", "code", "message")), " ").alias("_m"))
    both = pages.join(i, "page_idx", "left")
    ok: Column = F.lit(True)
    if severity == "expected":
        ok = F.coalesce(F.col("_e"), F.lit(False))
    elif severity != "all":
        ok = F.coalesce(F.array_contains("_s", severity), F.lit(False))
    shown = [c for c in ("url", "title", "description", "lang", "canonical", "discovery", "hreflang_text") if c in pages.columns]
    hay = F.lower(F.concat_ws(" ", *shown, "_m"))
    return both.filter(ok & F.contains(hay, F.lit(text.strip().lower()))).drop("_s", "_e", "_m")


#: Fixed names: the drill-downs of a report, one filter each over page metrics.
DRILLDOWNS = {
    "errors": "errors > 0",
    "warnings": "warnings > 0",
    "infos": "infos > 0",
    "noindex": "noindex",
    "robots-blocked": "not robots_allowed",
    "indexable": "indexability = 'indexable'",
    "not-indexable": "indexability = 'not-indexable'",
    "canonicalized": "indexability = 'canonicalized'",
    "host-alias": "indexability = 'host-alias'",
    "failed": "status = 0",
    "http-errors": "status >= 400",
    "orphans": "in_sitemap and incoming = 0",
    "deep": "depth >= 4",
    "unreachable": "depth is null",
    "outside-sitemap": "not in_sitemap",
    "duplicates": "duplicate",
}


def page_metrics(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """`pages` with what the drill-downs ask for: errors, warnings, infos (without expected findings), noindex, duplicate."""
    counted = issues.filter(~F.coalesce("expected", F.lit(False))).groupBy("page_idx")
    n = counted.agg(*[F.count_if(F.col("severity") == s).alias(c) for s, c in (("error", "errors"), ("warning", "warnings"), ("info", "infos"))], F.max(F.col("code").rlike("^(title|description|content)_duplicate")).alias("duplicate"))
    both = pages.join(n, "page_idx", "left")
    return both.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("errors", "warnings", "infos")} | {"duplicate": F.coalesce("duplicate", F.lit(False)), "noindex": tx.is_noindex(F.col("robots"), F.col("x_robots"))})


def drill_down(metrics: DataFrame, metric: str) -> DataFrame:
    """Pages (see page_metrics) that a drill-down shows."""
    return metrics.filter(F.expr(DRILLDOWNS[metric]))


def drill_down_counts(metrics: DataFrame) -> DataFrame:
    """metric, pages of all drill-downs that show a page, in one pass."""
    held = F.array_compact(F.array(*[F.when(F.expr(c), m) for m, c in DRILLDOWNS.items()]))
    return metrics.select(F.explode(held).alias("metric")).groupBy("metric").agg(F.count(F.lit(1)).alias("pages"))


def largest_groups(groups: DataFrame, most: int = 20) -> DataFrame:
    """The groups that a report shows (see metadata_groups): the largest first; `most` is the report's limit."""
    return groups.orderBy(F.col("pages").desc(), F.col("field").desc(), "text_key").limit(most)


def coverage_cards(pages: DataFrame, sitemap_targets: DataFrame) -> DataFrame:
    """One row: audited pages, sitemap URLs checked and unvisited, pages outside the sitemap, failed, found via links."""
    p = pages.agg(F.count(F.lit(1)).alias("audited"), F.count_if(~F.col("in_sitemap")).alias("outside_sitemap"), F.count_if(F.col("status") == 0).alias("failed"), F.count_if(F.col("incoming") > 0).alias("via_links"))
    s = sitemap_targets.agg(F.count("page_idx").alias("checked"), F.count_if(F.col("page_idx").isNull()).alias("unvisited"))
    return p.crossJoin(s)  # one row by one row
