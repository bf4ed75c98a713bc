"""All queries of the audit engine by name, with the SQL that gives the same rows in DuckDB.

The Spark side calls the operators; the SQL is written on its own, from the rules, over the same derived
relations. Results hold scalars only: arrays are joined to text after sorting, counts are BIGINT.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions import text as tx
from auditlake.functions import urls
from auditlake.functions.html import extract_pages
from auditlake.operators import crosspage, diff, history, hreflang, insights, links, origin, patterns, robots, rules, sitemap, social
from auditlake.plans import crawl
from auditlake.plans import derived as d
from auditlake.sources import reports

ROOT = "https://site.example"
NOW = "2024-01-20 00:00:00"
TITLE = "coalesce(regexp_extract({h}, '<title>([^<]*)</title>', 1), '')"


def _t(spark, sf, name):
    return d.table(spark, sf, name)


def _pages(spark, sf):
    return d.derive(spark, sf, d.PAGES)


def parsed_pages(spark: SparkSession, sf_dir: str, digest: bool = False) -> DataFrame:
    """Parsed rows of all `pages`, whatever their length; html is read and parsed once, and the text columns are pruned where nobody asks for them."""
    p = _t(spark, sf_dir, "pages").select(F.col("page_id").alias("page_idx"), "url", "html")
    return extract_pages(p, digest).withColumn("url_key", urls.url_key(F.col("url")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which problems repeat across the pages, and do they look like a template's?"""
    pages = parsed_pages(spark, sf_dir)
    issues = rules.page_issues(pages).withColumn("expected", F.lit(False))
    return patterns.patterns(issues, _t(spark, sf_dir, "pages"))


def page_title_rules(spark, sf):
    p = parsed_pages(spark, sf).select("page_idx", "url", "title")
    return rules.explode_issues(p, rules.PAGE, rules.title_checks(F.col("title"))).select("page_idx", "code", "severity", "message")


def page_lang_tally(spark, sf):
    return parsed_pages(spark, sf).groupBy(F.lower("lang").alias("lang")).agg(F.count(F.lit(1)).alias("pages"))


def page_facts(spark, sf):
    c = F.col
    return parsed_pages(spark, sf).select("page_idx", "title", "lang", "h1_count", "images_total", "jsonld_scripts", "canonical_count", F.size("links").cast("long").alias("links"), F.sha2("title", 256).alias("title_hash"), c("word_count"))


def page_issue_counts(spark, sf):
    return rules.page_issues(parsed_pages(spark, sf)).groupBy("code", "severity").agg(F.count(F.lit(1)).alias("pages"))


def visible_word_count(spark, sf):
    """Words that a page shows, and a digest of its text without headings, which content hashes are taken of."""
    return parsed_pages(spark, sf, digest=True).select("page_idx", "word_count", "fingerprint_words", "text_sha256")


def _rich(spark, sf):
    return extract_pages(d.derive(spark, sf, d.RICH))


def html_extract(spark, sf):
    """All scalar facts of documents whose contents are known by rule."""
    joined = lambda c: F.array_join(c, "|")
    return _rich(spark, sf).select(
        "page_idx", "title", "description", "robots", "lang", "canonical", "canonical_raw", F.col("canonical_count").cast("long"), F.col("h1_count").cast("long"), joined("h1").alias("h1"), F.col("h2_count").cast("long"),
        *[F.col(c).cast("long") for c in ("images_total", "images_missing_alt", "images_empty_alt", "jsonld_scripts", "jsonld_parseable", "jsonld_invalid")], joined("jsonld_types").alias("jsonld_types"),
        "og_title", "og_description", "og_image", "og_url", "twitter_card", "twitter_title", "twitter_description", "twitter_image", "word_count", "detected_lang", F.size("links").cast("long").alias("links"),
    )


def html_links(spark, sf):
    return _rich(spark, sf).select("page_idx", F.inline("link_details"))


def html_hreflangs(spark, sf):
    return _rich(spark, sf).select("page_idx", F.posexplode("hreflangs").alias("pos", "h")).select("page_idx", F.col("pos").cast("long"), "h.lang", "h.href", "h.source")


def html_rule_issues(spark, sf):
    """Page rules over documents whose faults are known by rule."""
    return rules.page_issues(_rich(spark, sf)).select("page_idx", "code", "severity")


def jsonld_findings(spark, sf):
    return _rich(spark, sf).select("page_idx", F.inline("jsonld_issues")).select("page_idx", "code", "severity")


def http_link_hreflangs(spark, sf):
    return hreflang.from_http(d.derive(spark, sf, d.LINK_HEADERS)).select("page_idx", "pos", "lang", "href", "source")


def sitemap_parse(spark, sf):
    return sitemap.parse(d.derive(spark, sf, d.SITEMAP_BODIES))


def sitemap_locations(spark, sf):
    """Distinct locations of all sitemaps, as a crawl takes them over, in fair order."""
    found = sitemap.parse(d.derive(spark, sf, d.SITEMAP_BODIES)).filter("kind = 'urlset'")
    return sitemap.locations(found.withColumn("pos", F.regexp_extract("url", r"(\d+)", 1).cast("long") * 10 + F.col("pos")))


def _image_pages(spark, sf):
    return _rich(spark, sf).select("page_idx", "url", "og_image", "twitter_image")


def social_images(spark, sf):
    return social.image_issues(_image_pages(spark, sf), d.derive(spark, sf, d.IMAGE_ANSWERS)).select("page_idx", "code", "severity", "message")


def social_image_coverage(spark, sf):
    """Distinct social images of the pages, and how many of them a report checks."""
    p = _image_pages(spark, sf)
    found, wanted = social.discovered(p).agg(F.count(F.lit(1)).alias("discovered")), social.wanted(p).agg(F.count(F.lit(1)).alias("checked"), F.min("url").alias("first_url"))
    return found.crossJoin(wanted)  # one row by one row


def url_normalize(spark, sf):
    p = _t(spark, sf, "pages").select("page_id", "url").withColumn("url_key", urls.url_key(F.col("url")))
    return p.select("page_id", "url_key", urls.origin(F.col("url_key")).alias("origin"))


def url_dedup(spark, sf):
    p = _t(spark, sf, "pages").select(F.col("page_id").alias("page_idx"), urls.url_key(F.col("url")).alias("url_key"))
    return links.page_index(p).select("url_key", "page_idx")


def locale_interleave(spark, sf):
    s = sitemap.interleave(_t(spark, sf, "pages").select(F.col("page_id").alias("pos"), "url"))
    return s.select("pos", "locale", F.col("turn").cast("long").alias("turn"), "first_pos")


def duplicate_titles(spark, sf):
    return crosspage.duplicate_groups(_pages(spark, sf), crosspage.title_key("title")).select(F.col("dup_key").alias("title"), "n", "multilingual")


def duplicate_issues(spark, sf):
    return crosspage.duplicate_issues(_pages(spark, sf)).select("page_idx", "code", "severity", "message")


def content_hash_groups(spark, sf):
    p = _t(spark, sf, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("content_hash")).filter("content_hash is not null")
    return p.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


def doc_word_count(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", tx.word_count(F.col("text")).alias("words"))


def language_detect(spark, sf):
    return tx.detect_language(_t(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", "detected_lang", "confidence")


def lang_mismatch(spark, sf):
    p = tx.detect_language(_t(spark, sf, "documents").select("doc_id", "lang", "text"), "text")
    return p.filter(tx.language_base(F.col("lang")) != F.col("detected_lang")).select("doc_id", "lang", "detected_lang")


ROBOTS = {
    0: "# all\nUser-agent: *\nDisallow: /en/1\nAllow: /en/10\n\nUser-agent: Googlebot\nUser-agent: other\nDisallow: /de/\nAllow: /de/*5$\nDisallow:",
    1: "Disallow: /lost\nUser-agent: google\nDisallow:\n\nUser-agent: *\nDisallow: /*?page=\nDisallow: /fr/8*0$\nAllow: /fr/",
    2: "user-agent: *\nallow: /es\ndisallow: /es\nDisallow: /en/*.html # comment\n",
}


def _robots(spark):
    return spark.createDataFrame([(str(k), v) for k, v in ROBOTS.items()], "site string, body string")


def robots_parse(spark, sf):
    g = robots.parse(_robots(spark)).withColumn("agents", F.array_join("agents", ","))
    each = g.select("site", "group_id", "agents", F.explode_outer("rules").alias("r"))
    return each.select("site", "group_id", "agents", F.col("r.directive").alias("directive"), F.col("r.pattern").alias("pattern"))


def robots_decision(spark, sf):
    p = _t(spark, sf, "pages").select("page_id", urls.url_key(F.col("url")).alias("url"), (F.col("page_id") % 3).cast("string").alias("site"))
    return robots.decide(p, robots.rules_for(robots.parse(_robots(spark)), "Googlebot")).select("page_id", "robots_allowed", "matched_directive", "matched_rule")


def hreflang_code_validity(spark, sf):
    return d.derive(spark, sf, d.CODES).select("page_idx", "code", tx.valid_hreflang(F.col("code")).alias("valid"))


def _effective(spark, sf):
    return links.effective(d.derive(spark, sf, d.LINKS), d.derive(spark, sf, d.REDIRECTS))


def link_degree(spark, sf):
    return links.degrees(_pages(spark, sf), _effective(spark, sf)).select("page_idx", "incoming", "outgoing")


def contextual_links(spark, sf):
    return links.degrees(_pages(spark, sf), _effective(spark, sf)).select("page_idx", "contextual_incoming", "contextual_outgoing")


def links_to_redirects(spark, sf):
    e = _effective(spark, sf).filter("hops is not null")
    return e.groupBy("page_idx").agg(F.count_distinct("dst").alias("redirecting"), F.count_distinct(F.when(F.col("hops") > 1, F.col("dst"))).alias("chains"))


def broken_links(spark, sf):
    return links.broken(_effective(spark, sf), _pages(spark, sf), d.derive(spark, sf, d.CHECKS)).select("page_idx", "href", "status")


def link_issues(spark, sf):
    return links.link_issues(_pages(spark, sf), _effective(spark, sf), d.derive(spark, sf, d.CHECKS)).select("page_idx", "code", "severity", "message")


def uncrawled_targets(spark, sf):
    u = links.uncrawled(d.derive(spark, sf, d.LINKS), _pages(spark, sf), d.derive(spark, sf, d.REDIRECTS), ROOT)
    return u.select("page_idx", "pos", "url_key", "href")


def _edges(spark, sf):
    e = _effective(spark, sf)
    p = links.page_index(_pages(spark, sf)).select(F.col("url_key").alias("eff"), F.col("page_idx").alias("dst"))
    return e.select(F.col("page_idx").alias("src"), "eff").join(p, "eff").select("src", "dst")


def crawl_depth(spark, sf):
    return links.crawl_depth(_edges(spark, sf), 0).select("page_idx", F.col("depth").cast("long").alias("depth"))


def redirect_chains(spark, sf):
    r = links.follow_redirects(d.derive(spark, sf, d.REDIRECT_HOPS))
    return r.select("from_key", "final_key", F.col("hops").cast("long").alias("hops"), "complete")


def canonical_checks(spark, sf):
    return crosspage.canonical_issues(_pages(spark, sf)).select("page_idx", "code", "severity", "message")


def hreflang_reciprocity(spark, sf):
    return hreflang.target_issues(_pages(spark, sf), d.derive(spark, sf, d.HREFLANGS)).select("page_idx", "code", "severity", "message")


def hreflang_relations(spark, sf):
    return hreflang.relation_issues(_pages(spark, sf), d.derive(spark, sf, d.HREFLANGS)).select("page_idx", "code", "severity", "message")


def hreflang_counts(spark, sf):
    return hreflang.relation_counts(_pages(spark, sf), d.derive(spark, sf, d.HREFLANGS))


def hreflang_conflicts(spark, sf):
    return hreflang.conflicts(d.derive(spark, sf, d.HREFLANGS))


def hreflang_merge(spark, sf):
    h = d.derive(spark, sf, d.HREFLANGS)
    more = h.filter("pos < 2").withColumns({"pos": F.col("pos") + 20, "source": F.lit("http-header")}).unionByName(h.filter("pos > 0").withColumns({"pos": F.col("pos") + 40, "source": F.lit("sitemap")}))
    return hreflang.merge(h.unionByName(more)).select("page_idx", "pos", "lang", "href", "source")


def _targets(spark, sf, full=False):
    return crosspage.sitemap_targets(d.derive(spark, sf, d.FULL_SITEMAP if full else d.SITEMAP), d.derive(spark, sf, d.REDIRECTS), _pages(spark, sf))


def sitemap_coverage(spark, sf):
    return crosspage.coverage(_targets(spark, sf))


def sitemap_issues(spark, sf):
    return crosspage.sitemap_issues(_targets(spark, sf)).select("page_idx", "code", "severity", "message")


def orphans(spark, sf):
    return crosspage.orphans(_targets(spark, sf, True), links.degrees(_pages(spark, sf), _effective(spark, sf))).select("page_idx", "url")


def indexability(spark, sf):
    return rules.indexability(_pages(spark, sf), "https://www.site.example").select("page_idx", "indexability", "reason")


def fetch_issues(spark, sf):
    r = d.derive(spark, sf, d.REDIRECTS)
    hop = F.struct(F.col("from_key").alias("from"), F.when(F.col("hops") == 1, 302).otherwise(301).alias("status"), F.col("final_key").alias("to"))
    chain = r.select(F.col("final_key").alias("url_key"), F.array_repeat(hop, F.col("hops").cast("int")).alias("chain"), "hops").groupBy("url_key").agg(F.min_by("chain", "hops").alias("chain"))
    return rules.fetch_issues(_pages(spark, sf).join(chain, "url_key", "left")).select("page_idx", "code", "severity", "message")


def origin_preference(spark, sf):
    p = _t(spark, sf, "pages").select(F.col("page_id").alias("page_idx"), F.col("url").alias("canonical"))
    p = p.withColumn("site", urls.host_family(F.col("canonical")))
    first = p.groupBy("site").agg(F.min_by("canonical", "page_idx").alias("f")).select("site", urls.origin(F.col("f")).alias("crawl_origin"))
    return origin.preference(p.join(first, "site"))


def mixed_scheme(spark, sf):
    p = _t(spark, sf, "pages").select(F.col("page_id").alias("page_idx"), F.col("url").alias("url_key"))
    l = p.select(F.explode(F.array(F.col("page_idx"), F.col("page_idx") + 1, F.col("page_idx") + 2)).alias("page_idx"), F.col("url_key").alias("href"))  # noqa: E741
    return links.mixed_scheme(l, p)


def _issues(spark, sf):
    return d.derive(spark, sf, d.ISSUES)


def issue_patterns(spark, sf):
    return patterns.patterns(_issues(spark, sf), _pages(spark, sf))


def severity_summary(spark, sf):
    p = _pages(spark, sf).agg(F.count(F.lit(1)).alias("pages"), F.count_if(tx.is_noindex(F.col("robots"), F.col("x_robots"))).alias("noindex"), F.count_if(~F.col("robots_allowed")).alias("robots_blocked"))
    return patterns.severity_counts(_issues(spark, sf)).crossJoin(p)  # one row by one row


def staging_context(spark, sf):
    p = _pages(spark, sf).select("page_idx", F.coalesce(urls.origin(F.col("canonical")) != urls.origin(F.col("url")), F.lit(False)).alias("cross_origin"))
    return patterns.staging_context(_issues(spark, sf).drop("expected"), p).select("page_idx", "code", "severity", "expected")


def staging_protection(spark, sf):
    return patterns.staging_protection(_pages(spark, sf))


def _metrics(spark, sf):
    p = rules.indexability(_pages(spark, sf), ROOT)
    p = p.join(links.degrees(_pages(spark, sf), _effective(spark, sf)), "page_idx")
    return p.join(links.crawl_depth(_edges(spark, sf), 0), "page_idx", "left")


def priority_buckets(spark, sf):
    return insights.priorities(_issues(spark, sf), rules.indexability(_pages(spark, sf), ROOT)).select(F.col("priority").cast("long").alias("priority"), "code", "urls", "example")


def opportunities(spark, sf):
    return insights.opportunities(_metrics(spark, sf)).select("opportunity", "page_idx")


def metadata_groups(spark, sf):
    return insights.metadata_groups(rules.indexability(_pages(spark, sf), ROOT))


def audit_diff_issues(spark, sf):
    x = diff.diff_issues(d.derive(spark, sf, d.PREVIOUS_ISSUES), d.derive(spark, sf, d.CURRENT_ISSUES))
    return x.select("issue_key", "change", F.col("before.severity").alias("severity_before"), F.col("after.severity").alias("severity_after"))


def audit_diff_pages(spark, sf):
    return diff.diff_pages(d.derive(spark, sf, d.PREVIOUS_PAGES), d.derive(spark, sf, d.CURRENT_PAGES))


def audit_progress(spark, sf):
    return diff.progress(*[d.derive(spark, sf, x) for x in (d.PREVIOUS_ISSUES, d.CURRENT_ISSUES, d.PREVIOUS_PAGES, d.CURRENT_PAGES)])


def launch_readiness(spark, sf):
    a, b, p, q = (d.derive(spark, sf, x) for x in (d.PREVIOUS_ISSUES, d.CURRENT_ISSUES, d.PREVIOUS_PAGES, d.CURRENT_PAGES))
    out = diff.launch_readiness(diff.diff_issues(a, b, True), diff.diff_pages(p, q, True), b, q, crosspage.coverage(_targets(spark, sf)))
    return out.withColumn("check_no", F.col("check_no").cast("long"))


def _now():
    return F.lit(NOW).cast("timestamp")


def history_latest_pairs(spark, sf):
    return history.latest_pairs(d.derive(spark, sf, d.RUNS), _now())


def history_active_runs(spark, sf):
    return history.active(d.derive(spark, sf, d.RUNS), _now())


def history_prune(spark, sf):
    return history.split_expired(d.derive(spark, sf, d.RUNS), _now())[1].groupBy("environment").agg(F.count(F.lit(1)).alias("pruned"))


def history_listing(spark, sf):
    return history.listing(d.derive(spark, sf, d.RUNS), _now(), " SITE1 ", 2).select("id", "url", "environment", "max_pages")


def content_hash_status(spark, sf):
    return parsed_pages(spark, sf).groupBy("content_hash_status").agg(F.count(F.lit(1)).alias("pages"))


def robots_counts(spark, sf):
    return robots.counts(robots.parse(_robots(spark)))


def hreflang_codes(spark, sf):
    return hreflang.codes(d.derive(spark, sf, d.HREFLANGS))


def _page_metrics(spark, sf):
    p = _metrics(spark, sf)
    return insights.page_metrics(p, _issues(spark, sf).unionByName(crosspage.duplicate_issues(_pages(spark, sf)).withColumn("expected", F.lit(False)).select(*_issues(spark, sf).columns)))


def drill_downs(spark, sf):
    return insights.drill_down_counts(_page_metrics(spark, sf))


def coverage_cards(spark, sf):
    return insights.coverage_cards(_metrics(spark, sf), _targets(spark, sf))


def report_filter(spark, sf):
    """Pages with an error that a search for `/p/1` finds, in any field or message."""
    return insights.filter_pages(_pages(spark, sf), _issues(spark, sf), "error", " /P/1").select("page_idx", "url")


def metadata_top(spark, sf):
    return insights.largest_groups(metadata_groups(spark, sf))


def top_priorities(spark, sf):
    return insights.top_priorities(priority_buckets(spark, sf), 3).select("priority", "code", "urls", F.col("place").cast("long").alias("place"))


def discovery_labels(spark, sf):
    """How the pages were found: the start, the sitemap, links from other pages."""
    p = _pages(spark, sf).withColumn("requested_url", F.col("url_key"))
    of = d.derive(spark, sf, d.LINKS).join(p.select("page_idx", F.col("url_key").alias("source")), "page_idx").select(F.col("dst").alias("url_key"), F.lit("internal-link").alias("kind"), "source")
    start = p.filter("page_idx = 0").select("url_key", F.lit("start").alias("kind"), F.lit(None).cast("string").alias("source"))
    listed = d.derive(spark, sf, d.SITEMAP).select("url_key", F.lit("sitemap").alias("kind"), F.lit(None).cast("string").alias("source"))
    found = crawl.discovery_of(p, of.unionByName(start).unionByName(listed))
    return found.select("page_idx", "kind", F.col("place").cast("long").alias("place"), "n", "label", F.array_join("sources", ",").alias("sources"))


def _sites(spark, sf):
    return d.derive(spark, sf, d.SITES)


def origin_variants(spark, sf):
    return origin.variants(_sites(spark, sf)).select("site", F.col("pos").cast("long").alias("pos"), "url")


def origin_probe(spark, sf):
    return origin.inspect(_sites(spark, sf), d.derive(spark, sf, d.ORIGIN_ANSWERS)).select("site", "url", F.col("status").cast("long").alias("status"), "relation")


def image_sizes(spark, sf):
    """Width and height from the first bytes of PNG and GIF files, and none from other bytes."""
    return d.derive(spark, sf, d.IMAGE_HEADS).withColumn("size", social.dimensions("head")).select("page_idx", F.col("size.width").cast("long").alias("width"), F.col("size.height").cast("long").alias("height"))


def link_resolution(spark, sf):
    return d.derive(spark, sf, d.HREFS).select("page_idx", urls.resolved(F.col("base"), F.col("href")).alias("resolved"))


def public_targets(spark, sf):
    return d.derive(spark, sf, d.TARGETS).select("page_idx", urls.public_target(F.col("url")).alias("public"))


def request_validation(spark, sf):
    return history.validate(d.derive(spark, sf, d.REQUESTS)).select("page_idx", "url", F.array_join("faults", ",").alias("faults"))


def _export(spark, sf):
    p = _pages(spark, sf).join(reports.issue_text(_issues(spark, sf)), "page_idx", "left")
    page = p.select(F.col("url").alias("URL"), F.col("status").alias("Status"), F.col("title").alias("Title"), "Issues", "Error count", "Warning count", "Info count")
    redirect = d.derive(spark, sf, d.REDIRECTS).select(F.col("from_key").alias("URL"), F.col("final_url").alias("Redirect final URL"), F.col("hops").alias("Redirect hops"))
    return reports.csv_rows(page=page, redirect=redirect)


def csv_export(spark, sf):
    """Records of an export by type, with what their cells hold."""
    filled = sum((F.coalesce(F.col(f"`{c}`"), F.lit("")) != "").cast("long") for c in reports.COLUMNS)
    return _export(spark, sf).select(F.col("Record type").alias("record"), "URL", F.coalesce("Issues", F.lit("")).alias("issues"), F.coalesce("Error count", F.lit("")).alias("errors"), filled.alias("cells"))


def csv_import(spark, sf):
    """The issues that come back from an export's cells."""
    return reports.imported_issues(_export(spark, sf)).select("url", F.col("seq").cast("long").alias("seq"), "severity", "message", "expected")


_QUERIES = [
    visible_word_count, html_extract, html_links, html_hreflangs, html_rule_issues, jsonld_findings, http_link_hreflangs, sitemap_parse, sitemap_locations, social_images, social_image_coverage,
    page_title_rules, page_lang_tally, page_facts, page_issue_counts, url_normalize, url_dedup, locale_interleave, duplicate_titles, duplicate_issues, content_hash_groups, doc_word_count, language_detect,
    lang_mismatch, robots_parse, robots_decision, hreflang_code_validity, link_degree, contextual_links, links_to_redirects, broken_links, link_issues, uncrawled_targets, crawl_depth, redirect_chains,
    canonical_checks, hreflang_reciprocity, hreflang_relations, hreflang_counts, hreflang_conflicts, hreflang_merge, sitemap_coverage, sitemap_issues, orphans, indexability, fetch_issues, origin_preference,
    mixed_scheme, issue_patterns, severity_summary, staging_context, staging_protection, priority_buckets, opportunities, metadata_groups, audit_diff_issues, audit_diff_pages, audit_progress, launch_readiness,
    history_latest_pairs, history_active_runs, history_prune, history_listing,
    content_hash_status, robots_counts, hreflang_codes, drill_downs, coverage_cards, report_filter, metadata_top, top_priorities, discovery_labels, origin_variants, origin_probe, image_sizes, link_resolution, public_targets,
    request_validation, csv_export, csv_import,
]


def queries() -> dict:
    return {f.__name__: partial(f) for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    from auditlake.plans import oracle

    return oracle.sql()
