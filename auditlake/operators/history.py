"""Runs over time: admission, expiry, listing, the latest pair of a site. `now` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.functions import urls

ACTIVE_LIMIT = 5
KEEP_DAYS = 7


def site_key() -> Column:
    return F.concat_ws("|", F.regexp_replace(urls.host(F.col("url")), r"^www\.", ""), "environment")


def latest_pairs(runs: DataFrame, now: Column) -> DataFrame:
    """site_key, current_id, previous_id of sites with two completed runs that have not expired.

    Two rows per site survive a rank that Spark prunes before the shuffle, so a site with many runs stays small.
    """
    w = Window.partitionBy("site_key").orderBy(F.col("created_at").desc(), F.col("id").desc())
    kept = runs.filter((F.col("status") == "completed") & (F.col("expires_at") > now)).withColumn("site_key", site_key())
    two = kept.withColumn("rn", F.row_number().over(w)).filter("rn <= 2")
    return two.groupBy("site_key").agg(F.max(F.when(F.col("rn") == 1, F.col("id"))).alias("current_id"), F.max(F.when(F.col("rn") == 2, F.col("id"))).alias("previous_id")).filter("previous_id is not null")


def listing(runs: DataFrame, now: Column, domain: str = "", page: int = 1, per_page: int = 30) -> DataFrame:
    """Completed runs whose URL holds the text, the newest first, one page of them."""
    kept = runs.filter((F.col("status") == "completed") & (F.col("expires_at") > now))
    if domain.strip():
        kept = kept.filter(F.contains(F.lower("url"), F.lit(domain.strip()[:150].lower())))
    return kept.orderBy(F.col("created_at").desc(), F.col("id").desc()).offset((page - 1) * per_page).limit(per_page)


def active(runs: DataFrame, now: Column) -> DataFrame:
    """One row: active runs (queued or running, not expired), and whether another is admitted."""
    n = runs.filter(F.col("status").isin("queued", "running") & (F.col("expires_at") > now)).agg(F.count(F.lit(1)).alias("active"))
    return n.withColumn("admits", F.col("active") < ACTIVE_LIMIT)


def validate(requests: DataFrame, most_pages: int = 1000) -> DataFrame:
    """`requests` (url, max_pages, environment) with `url` as it would be audited and `faults`, empty where a request is valid.

    Without a page limit 25 pages are audited, without an environment the live one. `most_pages` is 100 for audits that a caller waits for.
    """
    url = F.trim(F.coalesce("url", F.lit("")))
    faults = F.array_compact(
        F.array(
            F.when(url == "", "url required"),
            F.when(F.length("url") > 2048, "url too long"),
            F.when(~F.coalesce("max_pages", F.lit(25)).between(1, most_pages), "max_pages out of range"),
            F.when(~F.coalesce("environment", F.lit("live")).isin("live", "staging"), "environment unknown"),
        )
    )
    return requests.withColumns({"faults": faults, "url": F.when(url.rlike(r"(?i)^https?://"), url).otherwise(F.concat(F.lit("https://"), url))})


UUID = r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"


def saved(runs: DataFrame, audit_id: str, previous_id: str | None, now: Column) -> DataFrame:
    """place (current or previous) and the completed runs of a link to a saved audit; ids of another shape than a UUID find nothing."""
    wanted = [(i, place) for i, place in ((audit_id, "current"), (previous_id, "previous")) if i]
    both = runs.sparkSession.createDataFrame(wanted, "_id string, place string").filter(F.col("_id").rlike(UUID))
    return runs.join(F.broadcast(both), runs["id"] == both["_id"]).filter((F.col("status") == "completed") & (F.col("expires_at") > now)).drop("_id")  # two rows


def admit(runs: DataFrame, run_id: str, url: str, environment: str, max_pages: int, now: Column) -> DataFrame:
    """`runs` with a queued run added, if fewer than five are active."""
    asked = validate(runs.sparkSession.createDataFrame([(url, max_pages, environment)], "url string, max_pages int, environment string")).head()
    if asked.faults:
        raise ValueError(", ".join(asked.faults))
    url = asked.url
    new = active(runs, now).filter("admits").select(
        F.lit(run_id).alias("id"), F.lit(url).alias("url"), F.lit(environment).alias("environment"), F.lit(max_pages).alias("max_pages"), F.lit(0).alias("pages_done"), F.lit("queued").alias("status"),
        F.lit(None).cast("string").alias("error"), (now + F.expr(f"interval {KEEP_DAYS} days")).alias("expires_at"), now.alias("created_at"), now.alias("updated_at"),
    )
    return runs.unionByName(new.select(*[F.col(c).cast(runs.schema[c].dataType) for c in runs.columns]))


def advance(runs: DataFrame, run_id: str, status: str, now: Column, pages_done: int | None = None, error: str | None = None) -> DataFrame:
    """The state machine queued -> running -> completed or failed; other moves change nothing."""
    allowed = {"running": ("queued",), "completed": ("running",), "failed": ("queued", "running")}[status]
    hit = (F.col("id") == run_id) & F.col("status").isin(*allowed)
    out = runs.withColumn("_hit", hit)
    return out.withColumns(
        {
            "status": F.when(F.col("_hit"), status).otherwise(F.col("status")),
            "pages_done": F.when(F.col("_hit") & F.lit(pages_done is not None), F.lit(pages_done or 0)).otherwise(F.col("pages_done")),
            "error": F.when(F.col("_hit"), F.lit(error)).otherwise(F.col("error")),
            "updated_at": F.when(F.col("_hit"), now).otherwise(F.col("updated_at")),
        }
    ).drop("_hit")


def split_expired(runs: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Runs to keep, and runs to prune with their archives."""
    return runs.filter(F.col("expires_at") > now), runs.filter(F.col("expires_at") <= now)


def prune(runs: DataFrame, now: Column, archive: str = "archive_path") -> DataFrame:
    """The runs to keep; the archives of the others are deleted first, so that a run never names one that is gone half-way.

    Paths reach the driver one partition at a time, and any file system that Spark knows can hold them.
    """
    kept, gone = split_expired(runs, now)
    spark = runs.sparkSession
    for row in gone.filter(F.col(archive).isNotNull()).select(archive).distinct().toLocalIterator():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(row[0])
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return kept
