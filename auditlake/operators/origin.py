"""Origins: which one the canonicals prefer, and what the others answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions import urls

LEAST_VOTES, LEAST_SHARE = 2, 0.8


def preference(pages: DataFrame, by: str = "site") -> DataFrame:
    """Per site (`by`, with crawl_origin and canonical): origin, source, confidence, votes.

    Canonicals of the crawl origin's host family vote; the winner, the first seen on a tie, needs two votes
    and 80 % of them, else the crawl origin stays.
    """
    vote = pages.filter(F.col("canonical").isNotNull() & urls.same_family(F.col("crawl_origin"), F.col("canonical"))).select(by, "page_idx", urls.origin(F.col("canonical")).alias("o"))
    per = vote.groupBy(by, "o").agg(F.count(F.lit(1)).alias("n"), F.min("page_idx").alias("first"))
    best = per.groupBy(by).agg(F.max(F.struct("n", (-F.col("first")).alias("first"), "o")).alias("top"), F.sum("n").alias("total"))
    base = pages.groupBy(by).agg(F.min("crawl_origin").alias("crawl_origin"))
    share = F.col("top.n") / F.col("total")
    wins = (F.col("top.n") >= LEAST_VOTES) & (share >= LEAST_SHARE)
    both = base.join(best, by, "left")
    return both.select(by, F.when(wins, F.col("top.o")).otherwise(F.col("crawl_origin")).alias("origin"), F.when(wins, "sitewide-canonical").otherwise("crawl-origin").alias("source"), F.when(wins, F.round(share, 3)).alias("confidence"), F.coalesce("total", F.lit(0)).alias("votes"))


def variants(sites: DataFrame) -> DataFrame:
    """pos, url of the origins to probe for (start_url, preferred_origin): preferred, start, other scheme, with or without www."""
    p, s = F.col("preferred_origin"), F.col("start_url")
    scheme, host = urls.scheme(p), urls.host(p)
    port = F.regexp_extract(p, r"(:[0-9]+)$", 1)
    other = F.when(scheme == "https", "http").otherwise("https")
    bare = F.when(F.startswith(host, F.lit("www.")), F.regexp_replace(host, r"^www\.", "")).otherwise(F.concat(F.lit("www."), host))
    url = lambda sc, h: F.concat(sc, F.lit("://"), h, port, F.lit("/"))
    address = host.rlike(r"^([0-9.]+|\[.*\])$")
    all_ = F.array(url(scheme, host), url(urls.scheme(s), urls.host(s)), url(other, host), F.when(~address, url(scheme, bare)), F.when(~address, url(other, bare)))
    return sites.select("*", F.posexplode(F.array_distinct(F.array_compact(all_))).alias("pos", "url"))


def inspect(sites: DataFrame, responses: DataFrame) -> DataFrame:
    """Variants with status, final_url, redirects and relation; responses: url, status, final_url, hops (after redirects)."""
    r = responses.select(F.col("url").alias("_u"), F.col("status"), "final_url", F.col("hops").alias("redirects"))
    v = variants(sites)
    v = v.join(r, v["url"] == F.col("_u"), "left").drop("_u")
    pref, final = urls.origin(F.col("url")) == F.col("preferred_origin"), urls.origin(F.col("final_url")) == F.col("preferred_origin")
    relation = (
        F.when(F.col("status").isNull() | (F.col("status") == 0), "unreachable")
        .when(pref, "preferred")
        .when(final & (F.col("redirects") > 0), "redirects-to-preferred")
        .when((F.col("status") >= 200) & (F.col("status") < 300), "direct-nonpreferred")
        .otherwise("other")
    )
    return v.withColumn("relation", relation).withColumn("status", F.coalesce("status", F.lit(0)))


def variant_issues(inspected: DataFrame) -> DataFrame:
    """One origin_variant_direct_200 per preferred origin that others serve without a redirect, naming three of them."""
    g = inspected.filter("relation = 'direct-nonpreferred'").groupBy("preferred_origin").agg(F.sort_array(F.collect_list(F.struct("pos", urls.origin(F.col("url")).alias("o")))).alias("l"))
    names = F.array_distinct(F.transform("l", lambda x: x["o"]))
    more = F.when(F.size(names) > 3, F.concat(F.lit(" +"), (F.size(names) - 3).cast("string"), F.lit(" more"))).otherwise("")
    return g.select("preferred_origin", F.lit("origin_variant_direct_200").alias("code"), F.lit("warning").alias("severity"), F.concat(F.size(names).cast("string"), F.lit(" other origins answer without a redirect: "), F.array_join(F.slice(names, 1, 3), ", "), more).alias("message"))
