"""Reports as files: compressed JSON archives, CSV exports and their way back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed names: record types of the CSV export and the columns that a re-import needs.
RECORD_TYPES = ("site", "pattern", "origin-variant", "redirect", "link-check", "page")
ISSUE_JOIN = " | "
#: Fixed names: the columns of a CSV export, in their order.
COLUMNS = (
    "Record type", "Audit generated at", "Engine version", "Environment", "URL", "Requested URL", "Status", "Lang", "Detected lang", "Language confidence",
    "Title", "Meta description", "Canonical", "Indexability", "Indexability reason", "Expected staging finding", "Discovery sources", "Discovery details",
    "Robots", "X-Robots-Tag", "Robots.txt allowed", "Redirect final URL", "Redirect chain", "Link check final URL", "Link check error",
    "Pattern code", "Pattern scope", "Pattern category", "Pattern root cause", "Origin relation", "Origin final URL",
    "Input origin", "Audit seed URL", "Preferred origin", "Preferred origin source", "Canonical origin confidence",
    "Robots.txt matched rule", "Redirect hops", "Incoming internal links", "Outgoing internal links", "Contextual incoming links",
    "Contextual outgoing links", "Crawl depth", "Internal links to redirects", "In sitemap", "H1 count", "H1 text", "H2 count",
    "Word count", "Image count", "Images missing alt", "Images empty alt", "Hreflang codes", "Hreflang targets", "Hreflang sources",
    "OG title", "OG description", "OG image", "OG URL", "OG image status", "OG image content type", "OG image width", "OG image height",
    "Twitter card", "Twitter title", "Twitter description", "Twitter image", "Twitter image status", "Twitter image content type",
    "Twitter image width", "Twitter image height", "JSON-LD blocks", "JSON-LD parseable", "JSON-LD syntax invalid",
    "JSON-LD types", "JSON-LD semantic findings", "Content hash", "Content hash status",
    "Error count", "Warning count", "Info count", "Sitemaps parsed", "Sitemap URLs discovered", "Sitemap coverage %",
    "Summary indexable pages", "Summary noindex pages", "Summary robots blocked pages", "Summary redirects", "Summary redirect chains",
    "Summary orphan candidates", "Summary duplicate groups", "Summary links to redirects", "Summary mixed-scheme links",
    "Summary link targets checked", "Summary social images checked", "Summary social images discovered", "Summary contextual links", "Summary max crawl depth", "Summary host alias pages",
    "Summary staging protected pages", "Summary staging unprotected pages", "Summary expected staging findings", "Environment status", "Summary patterns", "Issues",
)


def report(summary: DataFrame, pages: DataFrame, issues: DataFrame) -> DataFrame:
    """One JSON text per page and one for the summary: record, json. A report of any size stays distributed."""
    per_page = issues.groupBy("page_idx").agg(F.sort_array(F.collect_list(F.struct("stage", "seq", "code", "severity", "message"))).alias("issues"))
    joined = pages.join(per_page, "page_idx", "left")
    return summary.select(F.lit("summary").alias("record"), F.to_json(F.struct("*")).alias("json")).unionByName(joined.select(F.lit("page").alias("record"), F.to_json(F.struct(*joined.columns)).alias("json")))


def write_json(df: DataFrame, path: str) -> None:
    df.write.option("compression", "gzip").json(path)


def read_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return spark.read.option("multiLine", multi_line).json(path)


def pretty(row: Column) -> Column:
    return F.to_json(row, {"pretty": "true"})


def file_name(url: Column, at: Column, extension: str) -> Column:
    """seo-audit-<host>-<time>.<extension>, with anything odd in the host made a dash."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^https?://([^/?#:]*)", 1)), r"[^a-z0-9.\-]+", "-")
    return F.concat(F.lit("seo-audit-"), F.when(host == "", "site").otherwise(host), F.lit("-"), F.date_format(at, "yyyyMMdd-HHmmss"), F.lit(f".{extension}"))


def issue_text(issues: DataFrame) -> DataFrame:
    """page_idx and its issues as `severity: message`, in order, joined for one CSV cell."""
    kind = F.when(F.coalesce("expected", F.lit(False)), "expected").otherwise(F.col("severity"))
    g = issues.groupBy("page_idx").agg(
        F.sort_array(F.collect_list(F.struct("stage", "seq", F.concat(kind, F.lit(": "), F.col("message")).alias("t")))).alias("l"),
        *[F.count_if((F.col("severity") == s) & ~F.coalesce("expected", F.lit(False))).alias(n) for s, n in (("error", "Error count"), ("warning", "Warning count"), ("info", "Info count"))],
    )
    return g.select("page_idx", F.array_join(F.transform("l", lambda x: x["t"]), ISSUE_JOIN).alias("Issues"), "Error count", "Warning count", "Info count")


def csv_rows(**records: DataFrame) -> DataFrame:
    """The records of an export, one table per type (site, pattern, origin_variant, redirect, link_check, page), as one.

    The tables name the columns they fill; the export has all COLUMNS, empty where a record has nothing to say.
    """
    unknown = [k for k in records if k.replace("_", "-") not in RECORD_TYPES]
    if unknown:
        raise ValueError(f"no record type {unknown[0]}")
    for k, df in records.items():
        if odd := [c for c in df.columns if c not in COLUMNS]:
            raise ValueError(f"no column {odd[0]} in an export ({k})")
    filled = lambda df: [F.col(f"`{c}`").cast("string").alias(c) if c in df.columns else F.lit("").alias(c) for c in COLUMNS[1:]]
    return reduce(DataFrame.unionByName, [df.select(F.lit(k.replace("_", "-")).alias(COLUMNS[0]), *filled(df)) for k, df in records.items()])


def write_csv(rows: DataFrame, path: str) -> None:
    rows.na.fill("").write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """An export's records. Raises without the columns `Record type` and `URL`; a byte order mark is passed over."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "").csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    if not {"Record type", "URL"} <= set(df.columns):
        raise ValueError("not an audit export: it lacks the columns Record type and URL")
    return df


def imported_issues(records: DataFrame) -> DataFrame:
    """url, seq, severity, message, expected of the Issues cells of page records."""
    each = records.filter(F.col("Record type") == "page").select(F.col("URL").alias("url"), F.posexplode(F.split("Issues", r" \| ")).alias("seq", "part"))
    kind = F.lower(F.regexp_extract("part", r"(?i)^(error|warning|info|expected): ", 1))
    return each.withColumn("severity", kind).filter("severity <> ''").select("url", "seq", "severity", F.regexp_replace("part", r"^[A-Za-z]+: ", "").alias("message"), (F.col("severity") == "expected").alias("expected"))


def archive(spark: SparkSession, df: DataFrame, path: str, runs: DataFrame, runs_path: str) -> None:
    """Writes a report and then the runs table that names it; where the second write fails the report is deleted."""
    write_json(df, path)
    try:
        runs.write.mode("append").parquet(runs_path)
    except Exception:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        raise
