"""Page and fetch rules: one predicate Column and one message per code, evaluated in a single projection.

Issues are rows (page_idx, url, stage, seq, code, severity, message). stage and seq keep the order in which an
audit finds things; examples, last-wins comparisons and reports depend on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import text as tx

PAGE, FETCH, SOCIAL, TITLES, DESCRIPTIONS, CONTENT, LINKS, CANONICAL, SITEMAP, ORPHANS, RELATIONS = range(1, 12)
SEVERITY_RANK = {"error": 3, "warning": 2, "info": 1}


def rank(severity: Column) -> Column:
    return F.when(severity == "error", 3).when(severity == "warning", 2).when(severity == "info", 1).otherwise(0)


def found(when: Column, code: str | Column, severity: str | Column, *message) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    text = F.concat(*[F.coalesce(lit(m).cast("string"), F.lit("")) for m in message])
    return F.when(when, F.struct(lit(code).alias("code"), lit(severity).alias("severity"), text.alias("message")))


def explode_issues(df: DataFrame, stage: int, checks: list[Column], keys: tuple[str, ...] = ("page_idx", "url")) -> DataFrame:
    """The checks that hold, as rows in the checks' order; a code and message counts once per page."""
    each = df.select(*keys, F.posexplode(F.array_compact(F.array(*checks))).alias("seq", "i"))
    return each.select(*keys, F.lit(stage).alias("stage"), F.col("seq").cast("long").alias("seq"), "i.code", "i.severity", "i.message")


def title_checks(title: Column) -> list[Column]:
    n = F.char_length(title)
    return [
        found(n == 0, "title_missing", "error", "The page has no title."),
        found((n > 0) & (n < 20), "title_short", "info", "The title has ", n, " characters."),
        found(n > 60, "title_long", "info", "The title has ", n, " characters."),
    ]


def description_checks(description: Column) -> list[Column]:
    n = F.char_length(description)
    return [
        found(n == 0, "description_missing", "warning", "The page has no meta description."),
        found((n > 0) & (n < 70), "description_short", "info", "The meta description has ", n, " characters."),
        found(n > 160, "description_long", "info", "The meta description has ", n, " characters."),
    ]


def page_checks() -> list[Column]:
    """Rules over what functions.html.extract_pages gives, in an audit's order, but for JSON-LD and hreflang."""
    c = F.col
    return [
        *title_checks(c("title")),
        *description_checks(c("description")),
        found(c("canonical_count") == 0, "canonical_missing", "warning", "The page names no canonical URL."),
        found(c("canonical_count") > 1, "canonical_multiple", "error", "The page has ", c("canonical_count"), " canonical tags."),
        found((c("canonical_count") > 0) & (c("canonical_raw") != "") & c("canonical").isNull(), "canonical_invalid", "error", "The canonical URL is not valid."),
        found(c("canonical") != c("url_key"), "canonical_other", "info", "The canonical URL is another one: ", c("canonical"), "."),
        found(c("lang").isNull(), "html_lang_missing", "warning", "The html element has no lang."),
        found(tx.language_base(c("lang")) != c("detected_lang"), "html_lang_content_mismatch", "warning", "lang is ", c("lang"), ", but the text reads like ", c("detected_lang"), "."),
        found(tx.page_directive(c("robots"), "noindex"), "robots_noindex", "info", "Meta robots says noindex."),
        found(c("h1_count") == 0, "h1_missing", "info", "The page has no H1."),
        found(c("h1_count") > 1, "h1_multiple", "info", "The page has ", c("h1_count"), " H1 headings."),
        found(c("images_missing_alt") > 0, "image_alt_missing", "warning", c("images_missing_alt"), " images have no alt text."),
        found((c("word_count") > 0) & (c("word_count") < 50), "content_thin", "info", "The page shows ", c("word_count"), " words."),
        found(c("og_title").isNull(), "og_title_missing", "info", "There is no og:title."),
        found(c("og_description").isNull(), "og_description_missing", "info", "There is no og:description."),
        found(c("og_image").isNull(), "og_image_missing", "info", "There is no valid og:image."),
        found(c("twitter_card").isNull(), "twitter_card_missing", "info", "There is no twitter:card."),
        found(c("jsonld_invalid") > 0, "jsonld_invalid", "error", c("jsonld_invalid"), " JSON-LD blocks cannot be parsed."),
    ]


def hreflang_checks(hreflangs: Column, url_key: Column, lang: Column) -> Column:
    """Array of findings about a page's own declarations: repeated and odd codes, no self-reference, another language."""
    codes = F.transform(hreflangs, lambda h: h["lang"])
    each = F.flatten(
        F.transform(
            hreflangs,
            lambda h, i: F.array(
                found(F.array_contains(F.slice(codes, F.lit(1), i), h["lang"]), "hreflang_duplicate_code", "warning", "The hreflang code ", h["lang"], " occurs more than once."),
                found(~tx.valid_hreflang(h["lang"]), "hreflang_code_suspicious", "warning", "The hreflang code ", h["lang"], " is not a known one."),
            ),
        )
    )
    own = F.filter(hreflangs, lambda h: h["href"] == url_key)
    own_lang = F.element_at(F.filter(own, lambda h: h["lang"] != "x-default"), -1)["lang"]
    own_lang = F.when(F.size(F.filter(own, lambda h: h["lang"] != "x-default")) > 0, own_lang)
    rest = F.array(
        found((F.size(hreflangs) > 0) & (F.size(own) == 0), "hreflang_self_missing", "warning", "The hreflang set does not name the page itself."),
        found(tx.language_base(own_lang) != tx.language_base(lang), "html_lang_hreflang_mismatch", "info", "lang is ", lang, ", the page's own hreflang is ", own_lang, "."),
    )
    return F.array_distinct(F.array_compact(F.concat(F.coalesce(each, F.array().cast("array<struct<code:string,severity:string,message:string>>")), rest)))


def page_issues(pages: DataFrame) -> DataFrame:
    """Issues of parsed pages (page_idx, url, url_key and the columns of extract_pages)."""
    kind = "array<struct<code:string,severity:string,message:string>>"
    checks = F.concat(F.array_compact(F.array(*page_checks())).cast(kind), F.coalesce("jsonld_issues", F.array().cast(kind)).cast(kind), hreflang_checks(F.col("hreflangs"), F.col("url_key"), F.col("lang")).cast(kind))
    each = pages.select("page_idx", "url", F.posexplode(F.array_distinct(checks)).alias("seq", "i"))
    return each.select("page_idx", "url", F.lit(PAGE).alias("stage"), F.col("seq").cast("long").alias("seq"), "i.code", "i.severity", "i.message")


def fetch_issues(pages: DataFrame) -> DataFrame:
    """Issues of the fetch: status, robots_allowed, chain (array of from, status, to), x_robots."""
    c, hops = F.col, F.coalesce(F.size("chain"), F.lit(0))
    return explode_issues(
        pages,
        FETCH,
        [
            found(c("status") == 0, "fetch_failed", "error", "The page could not be fetched."),
            found(~c("robots_allowed"), "robots_txt_blocked", "warning", "robots.txt blocks the page."),
            found(hops > 1, "redirect_chain", "warning", "The page is behind ", hops, " redirects."),
            found((hops == 1) & F.get("chain", F.lit(0))["status"].isin(302, 303, 307), "temporary_redirect", "info", "The page is behind a temporary redirect."),
            found(tx.site_directive(c("x_robots"), "noindex"), "x_robots_noindex", "info", "X-Robots-Tag says noindex."),
            found(c("status") >= 400, "http_error", "error", "The page answers with status ", c("status"), "."),
            found((c("status") >= 300) & (c("status") < 400), "http_redirect", "warning", "The page still answers with status ", c("status"), "."),
        ],
    )


def indexability(pages: DataFrame, preferred_origin: str) -> DataFrame:
    """Adds indexability and reason; the first that holds counts. robots.txt has no part in it. Needs url_key, canonical_key."""
    from auditlake.functions import urls

    c = F.col
    other = c("canonical").isNotNull() & (c("canonical_key") != c("url_key"))
    alias = F.coalesce(urls.host_alias(c("url_key"), c("canonical_key"), F.lit(preferred_origin)), F.lit(False))
    status = (
        F.when(c("status") == 0, "unknown")
        .when((c("status") < 200) | (c("status") >= 300), "not-indexable")
        .when(tx.site_directive(c("robots"), "noindex") | tx.site_directive(c("x_robots"), "noindex"), "not-indexable")
        .when(c("canonical").isNotNull() & c("canonical_key").isNull(), "unknown")
        .when(other & alias, "host-alias")
        .when(other, "canonicalized")
        .otherwise("indexable")
    )
    reason = (
        F.when(c("status") == 0, "not fetched")
        .when((c("status") < 200) | (c("status") >= 300), F.concat(F.lit("status "), c("status").cast("string")))
        .when(tx.site_directive(c("robots"), "noindex"), "meta robots")
        .when(tx.site_directive(c("x_robots"), "noindex"), "X-Robots-Tag")
        .when(c("canonical").isNotNull() & c("canonical_key").isNull(), "canonical not valid")
        .when(other & alias, "preferred host")
        .when(other, "canonical elsewhere")
        .otherwise("nothing against it")
    )
    return pages.withColumn("indexability", status).withColumn("reason", reason)
