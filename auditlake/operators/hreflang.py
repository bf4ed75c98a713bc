"""Hreflang: merging declarations, target checks, reciprocity, conflicts.

Declarations are rows (page_idx, pos, lang, href, href_key, source) of pages (page_idx, url, url_key, status,
lang, robots, x_robots, canonical_key).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions import text as tx
from auditlake.functions import urls
from auditlake.operators.links import page_index
from auditlake.operators.rules import CANONICAL, RELATIONS, explode_issues, found


def merge(declarations: DataFrame) -> DataFrame:
    """One declaration per page, language and target key, first spelling and place; sources joined by + as first seen."""
    at = F.struct("pos", "href", "source")
    g = declarations.groupBy("page_idx", "lang", "href_key").agg(F.min(at).alias("first"), F.sort_array(F.collect_list(F.struct("pos", "source"))).alias("all"))
    return g.select("page_idx", F.col("first.pos").alias("pos"), "lang", F.col("first.href").alias("href"), "href_key", F.array_join(F.array_distinct(F.transform("all", lambda x: x["source"])), "+").alias("source"))


def codes(declarations: DataFrame) -> DataFrame:
    """One row: the distinct codes that are declared, in order."""
    return declarations.select(F.lower("lang").alias("lang")).distinct().agg(F.array_join(F.sort_array(F.collect_list("lang")), ",").alias("hreflang_codes"))


def _targets(pages: DataFrame, prefix: str = "t_") -> DataFrame:
    t = page_index(pages, "status", "robots", "x_robots", "canonical_key", "lang")
    return t.select(*[F.col(c).alias(prefix + c) for c in t.columns])


def target_issues(pages: DataFrame, declarations: DataFrame) -> DataFrame:
    """Per declaration of another audited page: its error (which ends the checks), noindex, canonical, language, reciprocity.

    A page that could not be fetched passes the error check and is then not reciprocal: it declares nothing.
    """
    t = _targets(pages)
    d = declarations.join(pages.select("page_idx", "url", "url_key"), "page_idx").filter("href_key <> url_key")
    d = d.join(t, d["href_key"] == t["t_url_key"])
    back = declarations.select(F.col("page_idx").alias("t_page_idx"), F.col("href_key").alias("url_key"), F.lit(True).alias("back")).distinct()
    d = d.join(back, ["t_page_idx", "url_key"], "left")
    ok = ~(F.col("t_status") >= 400)
    c = F.col
    return explode_issues(
        d,
        CANONICAL,
        [
            found(~ok, "hreflang_target_error", "error", "The alternate ", c("href"), " answers with status ", c("t_status"), "."),
            found(ok & tx.is_noindex(c("t_robots"), c("t_x_robots")), "hreflang_target_noindex", "warning", "The alternate ", c("href"), " is noindex."),
            found(ok & (c("t_canonical_key") != c("t_url_key")), "hreflang_target_canonical_other", "warning", "The alternate ", c("href"), " names another canonical URL."),
            found(ok & (c("lang") != "x-default") & (tx.language_base(c("t_lang")) != tx.language_base(c("lang"))), "hreflang_target_lang_mismatch", "info", "The alternate ", c("href"), " is in ", c("t_lang"), ", declared as ", c("lang"), "."),
            found(ok & c("back").isNull(), "hreflang_not_reciprocal", "warning", "The alternate ", c("href"), " does not point back."),
        ],
    ).dropDuplicates(["page_idx", "code", "message"])


def conflicts(declarations: DataFrame) -> DataFrame:
    """page_idx, lang, targets: languages that a page declares with more than one target."""
    g = declarations.groupBy("page_idx", "lang").agg(F.count_distinct(urls.hreflang_key(F.col("href"))).alias("targets"))
    return g.filter("targets > 1")


def relations(pages: DataFrame, declarations: DataFrame) -> DataFrame:
    """One row per declaration of another URL, by the relation key: audited, missing_reciprocal, non_indexable, canonical_conflict."""
    keyed = pages.withColumn("rel_key", urls.hreflang_key(F.col("url"))).withColumn("canonical_rel", urls.hreflang_key(F.col("canonical_key")))
    t = keyed.filter("rel_key is not null").groupBy("rel_key").agg(F.max_by(F.struct("page_idx", "status", "robots", "x_robots", "robots_allowed", "canonical_rel"), "page_idx").alias("t"))
    d = declarations.withColumn("target", urls.hreflang_key(F.col("href"))).filter("lang <> 'x-default' and target is not null")
    d = d.join(keyed.select("page_idx", "rel_key", "url"), "page_idx").filter("target <> rel_key").join(t.withColumnRenamed("rel_key", "target"), "target", "left")
    back = declarations.select(F.col("page_idx").alias("_page"), urls.hreflang_key(F.col("href")).alias("rel_key"), F.lit(True).alias("back")).distinct()
    d = d.join(back, (d["t.page_idx"] == back["_page"]) & (d["rel_key"] == back["rel_key"]), "left").drop(back["rel_key"])
    audited = F.col("t").isNotNull()
    bad = (F.col("t.status") < 200) | (F.col("t.status") >= 300) | tx.mentions_noindex(F.col("t.robots")) | tx.mentions_noindex(F.col("t.x_robots")) | ~F.coalesce(F.col("t.robots_allowed"), F.lit(True))
    return d.select(
        "page_idx", "url", "pos", "lang", "href", audited.alias("audited"), (audited & F.col("back").isNull()).alias("missing_reciprocal"), F.coalesce(audited & bad, F.lit(False)).alias("non_indexable"),
        F.coalesce(F.col("t.canonical_rel") != F.col("target"), F.lit(False)).alias("canonical_conflict"),
    )


def relation_counts(pages: DataFrame, declarations: DataFrame) -> DataFrame:
    """One row: checked, missing_reciprocal, non_indexable_targets, canonical_conflicts, unverified_targets, conflicting_declarations."""
    n = relations(pages, declarations).agg(
        F.count_if("audited").alias("checked"), F.count_if("missing_reciprocal").alias("missing_reciprocal"), F.count_if("non_indexable").alias("non_indexable_targets"),
        F.count_if("canonical_conflict").alias("canonical_conflicts"), F.count_if(~F.col("audited")).alias("unverified_targets"),
    )
    return n.crossJoin(conflicts(declarations).agg(F.count(F.lit(1)).alias("conflicting_declarations")))  # one row by one row


def relation_issues(pages: DataFrame, declarations: DataFrame) -> DataFrame:
    c = F.col
    each = explode_issues(
        relations(pages, declarations),
        RELATIONS,
        [
            found(c("missing_reciprocal"), "hreflang_missing_reciprocal", "warning", "The alternate ", c("href"), " does not declare this page."),
            found(c("non_indexable"), "hreflang_nonindexable_target", "warning", "The alternate ", c("href"), " cannot be indexed."),
            found(c("canonical_conflict"), "hreflang_target_canonical_conflict", "warning", "The alternate ", c("href"), " names another canonical URL."),
        ],
    ).dropDuplicates(["page_idx", "code", "message"])
    both = conflicts(declarations).join(pages.select("page_idx", "url"), "page_idx")
    return each.unionByName(explode_issues(both, RELATIONS, [found(F.lit(True), "hreflang_conflicting_targets", "warning", "The language ", c("lang"), " has ", c("targets"), " targets.")]))


def from_http(pages: DataFrame) -> DataFrame:
    """page_idx, pos, lang, href of the alternates in Link headers (page_idx, url, link_header)."""
    each = pages.select("page_idx", "url", F.posexplode(F.regexp_extract_all("link_header", F.lit(r"<([^>]*)>((?:\s*;\s*[^,;=]+(?:=(?:\"[^\"]*\"|[^,;]*))?)*)"), F.lit(0))).alias("pos", "part"))
    rel = F.lower(F.regexp_extract("part", r"(?i);\s*rel\s*=\s*\"?([^\";,]*)\"?", 1))
    lang = F.lower(F.trim(F.regexp_extract("part", r"(?i);\s*hreflang\s*=\s*\"?([^\";,]*)\"?", 1)))
    href = urls.resolved(F.col("url"), F.regexp_extract("part", r"<([^>]*)>", 1))
    out = each.filter(F.array_contains(F.split(rel, r"\s+"), "alternate")).select("page_idx", F.col("pos").cast("long").alias("pos"), lang.alias("lang"), href.alias("href"))
    return out.filter("lang <> '' and href is not null").withColumn("source", F.lit("http-header"))
