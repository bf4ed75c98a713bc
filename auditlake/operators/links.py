"""Internal links: degrees, redirects, broken targets, unvisited targets, click depth.

Relations: pages (page_idx, url_key, status), links (page_idx, url_key of the source as src, pos, href, dst,
contextual), redirects (from_key, final_key, final_url, hops). Links are shuffled by their target once; the
redirect table joins by broadcast where its size allows and by key else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions import urls
from auditlake.operators.rules import LINKS, found
from auditlake.scratch import Scratch, shared_dir

MOST_TARGETS = 50


def page_index(pages: DataFrame, *columns: str) -> DataFrame:
    """One page per key; of several, the last one."""
    return pages.groupBy("url_key").agg(F.max_by(F.struct("page_idx", *columns), "page_idx").alias("p")).select("url_key", "p.*")


def effective(links: DataFrame, redirects: DataFrame) -> DataFrame:
    """Adds eff, the key that a link ends at, and hops (null if it does not redirect)."""
    r = redirects.select(F.col("from_key").alias("_from"), F.col("final_key").alias("_final"), F.col("final_url").alias("final_url"), F.col("hops").alias("hops"))
    return links.join(r, links["dst"] == F.col("_from"), "left").withColumn("eff", F.coalesce("_final", "dst")).drop("_from", "_final")


def degrees(pages: DataFrame, effective_links: DataFrame) -> DataFrame:
    """page_idx, incoming, outgoing, contextual_incoming, contextual_outgoing of every page.

    Per source a target counts once, and a link to the page itself counts like any other.
    """
    once = effective_links.groupBy("page_idx", "eff").agg(F.max(F.col("contextual").cast("int")).alias("c"))
    index = page_index(pages).select(F.col("url_key").alias("eff"), F.col("page_idx").alias("target"))
    out = once.groupBy("page_idx").agg(F.count(F.lit(1)).alias("outgoing"), F.sum("c").alias("contextual_outgoing"))
    into = once.groupBy("eff").agg(F.count(F.lit(1)).alias("incoming"), F.sum("c").alias("contextual_incoming")).join(index, "eff")
    into = into.select(F.col("target").alias("page_idx"), "incoming", "contextual_incoming")
    names = ["incoming", "outgoing", "contextual_incoming", "contextual_outgoing"]
    return pages.select("page_idx").join(out, "page_idx", "left").join(into, "page_idx", "left").select("page_idx", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names])


def broken(effective_links: DataFrame, pages: DataFrame, checks: DataFrame) -> DataFrame:
    """page_idx, href, status of links whose target, an audited page or else a checked URL, answers 400 or more."""
    p = page_index(pages, "status").select(F.col("url_key").alias("eff"), F.col("status").alias("page_status"))
    c = checks.select(F.col("url_key").alias("eff"), F.col("status").alias("check_status"))
    both = effective_links.join(p, "eff", "left").join(c, "eff", "left")
    status = F.when(F.col("page_status") >= 400, F.col("page_status")).when(F.col("check_status") >= 400, F.col("check_status"))
    return both.withColumn("status", status).filter("status is not null").select("page_idx", "href", "eff", F.col("status").cast("int").alias("status")).distinct()


def mixed_scheme(links: DataFrame, pages: DataFrame) -> DataFrame:
    """page_idx and the number of distinct links to the page's own host at another scheme or port."""
    own = pages.select("page_idx", F.col("url_key").alias("own"))
    both = links.join(own, "page_idx").filter((urls.host(F.col("href")) == urls.host(F.col("own"))) & (urls.origin(F.col("href")) != urls.origin(F.col("own"))))
    return both.groupBy("page_idx").agg(F.count_distinct("href").alias("mixed"))


def candidates(links: DataFrame, pages: DataFrame, redirects: DataFrame, origin: str) -> DataFrame:
    """url_key, at, href of all same-origin targets that are neither pages nor redirects: at is the place of the first, href the spelling of the last."""
    l = links.filter(urls.origin(F.col("href")) == origin).select(F.col("dst").alias("url_key"), "href", "page_idx", "pos")  # noqa: E741
    l = l.join(pages.select("url_key"), "url_key", "left_anti").join(redirects.select(F.col("from_key").alias("url_key")), "url_key", "left_anti")  # noqa: E741
    at = F.struct("page_idx", "pos")
    return l.groupBy("url_key").agg(F.min(at).alias("at"), F.max_by("href", at).alias("href"))


def uncrawled(links: DataFrame, pages: DataFrame, redirects: DataFrame, origin: str, limit: int = MOST_TARGETS) -> DataFrame:
    """pos, url_key, href: same-origin targets that are neither pages nor redirects; place of the first, spelling of the last.

    The limit is the report's: a top-k by position, without a global sort of all rows.
    """
    return candidates(links, pages, redirects, origin).orderBy("at").limit(limit).select(F.col("at.page_idx").alias("page_idx"), F.col("at.pos").alias("pos"), "url_key", "href")


def link_issues(pages: DataFrame, effective_links: DataFrame, checks: DataFrame) -> DataFrame:
    """Per page: links to redirects and to chains, mixed schemes, broken links, with the number of targets of each."""
    red = effective_links.filter("hops is not null").groupBy("page_idx").agg(F.count_distinct("dst").alias("redirecting"), F.count_distinct(F.when(F.col("hops") > 1, F.col("dst"))).alias("chains"))
    bad = broken(effective_links, pages, checks).groupBy("page_idx").agg(F.count_distinct("href").alias("broken"))
    both = pages.select("page_idx", "url").join(red, "page_idx", "left").join(mixed_scheme(effective_links, pages), "page_idx", "left").join(bad, "page_idx", "left")
    from auditlake.operators.rules import explode_issues

    return explode_issues(
        both,
        LINKS,
        [
            found(F.col("redirecting") > 0, "internal_link_to_redirect", "warning", F.col("redirecting"), " links go to redirects."),
            found(F.col("chains") > 0, "internal_link_redirect_chain", "warning", F.col("chains"), " links go to chains of redirects."),
            found(F.col("mixed") > 0, "mixed_scheme_internal_link", "warning", F.col("mixed"), " links go to another scheme or port of the host."),
            found(F.col("broken") > 0, "broken_internal_link", "error", F.col("broken"), " links are broken."),
        ],
    )


def crawl_depth(edges: DataFrame, root: int) -> DataFrame:
    """page_idx, depth: the fewest clicks from the root over edges (src, dst). Pages out of reach are not in it.

    Breadth first, until a round finds nothing new: each joins the frontier with the edges and drops what has been
    seen. What a round finds is a table in the shared folder, so a lost executor costs that round at most, and the
    planner knows how small a frontier is: the edges, written once, are then read where they lie and not shuffled.
    Rounds equal the depth of the site, not its size.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "depth")
    edges = scratch.keep(edges.select("src", "dst").distinct().filter("src <> dst"))
    seen = spark.createDataFrame([(root, 0)], "page_idx long, depth int")
    frontier, depth = seen, 0
    while True:
        depth += 1
        new = edges.join(frontier.select(F.col("page_idx").alias("src")), "src").select(F.col("dst").alias("page_idx")).distinct().join(seen, "page_idx", "left_anti")
        frontier = scratch.keep(new.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            scratch.drop(edges, frontier)
            return seen
        seen = seen.unionByName(frontier)


def checkpointed(spark) -> None:
    """Lets checkpoint() write to the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def follow_redirects(hops: DataFrame, most: int = 5) -> DataFrame:
    """from_key, final_key, hops, complete: redirects (from_key, to_key) followed to their end, in `most` joins at most.

    A chain of `most` hops or more is not complete: its last allowed request still redirects.
    """
    step = hops.select(F.col("from_key").alias("_f"), F.col("to_key").alias("_t"))
    out = hops.select("from_key", F.col("to_key").alias("final_key"), F.lit(1).alias("hops"))
    for _ in range(most - 1):
        out = out.join(step, out["final_key"] == step["_f"], "left").select("from_key", F.coalesce("_t", "final_key").alias("final_key"), (F.col("hops") + F.col("_t").isNotNull().cast("int")).alias("hops"))
    return out.withColumn("complete", F.col("hops") < most)
