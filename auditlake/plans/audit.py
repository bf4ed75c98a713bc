"""A whole audit: crawl, checks, indexability, environment, patterns, summary, as lazy DataFrames."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions import text as tx
from auditlake.functions import urls
from auditlake.functions.html import MAX_BODY_BYTES
from auditlake.functions.urls import normalize
from auditlake.operators import crosspage, hreflang, links, origin, patterns, robots, rules, social
from auditlake.plans import crawl as cr
from auditlake.scratch import Scratch
from auditlake.sources import reports
from auditlake.sources.responses import lookup


class Audit:
    """Audit(spark, responses, start_url, max_pages, environment): pages(), issues(), site_issues(), patterns(), summary()."""

    def __init__(self, spark: SparkSession, responses: DataFrame, start_url: str, max_pages: int = 25, environment: str = "live", progress=None):
        if environment not in ("live", "staging"):
            raise ValueError("environment is live or staging")
        self.spark, self.responses, self.environment = spark, responses, environment
        self.crawl = cr.crawl(spark, responses, start_url, max_pages, progress)
        self.scratch = Scratch(spark, "audit")
        # what many checks read is written once: their plans stay small, and so does what a lost executor costs
        made = cr.relations(spark, self.crawl)
        self.rel = made | {k: self.scratch.keep(made[k]) for k in ("pages", "documents", "links")}

    @cached_property
    def candidates(self) -> DataFrame:
        """Link targets beyond the crawl."""
        return links.candidates(self.rel["links"], self.rel["pages"], self.rel["redirects"], self.crawl.origin)

    @cached_property
    def followed(self) -> dict[str, dict]:
        """The first of the candidates, by URL: the last response, without its body, final_url and chain."""
        urls = [r.href for r in self.candidates.orderBy("at").limit(links.MOST_TARGETS).select("href").collect()]  # fifty at most
        return cr.Responses(self.spark, self.responses).follow(urls)

    @cached_property
    def redirects(self) -> DataFrame:
        """Redirects of the crawl and those that the checks of link targets met; of both, the latter."""
        met = {normalize(h["from"]): (normalize(r["final_url"]), len(r["chain"])) for r in self.followed.values() if r["status"] for h in r["chain"]}
        new = self.spark.createDataFrame([(k, final, final, n) for k, (final, n) in met.items()], "from_key string, final_key string, final_url string, hops int")
        return self.rel["redirects"].join(new, "from_key", "left_anti").unionByName(new)

    @cached_property
    def effective(self) -> DataFrame:
        same = self.rel["links"].filter(urls.origin(F.col("href")) == self.crawl.origin)
        mixed = self.rel["links"].filter((urls.host(F.col("href")) == urls.host(F.lit(self.crawl.origin))) & (urls.origin(F.col("href")) != self.crawl.origin))
        return self.scratch.keep(links.effective(same.unionByName(mixed), self.redirects))

    @cached_property
    def checks(self) -> DataFrame:
        """What link targets beyond the crawl answer, redirects followed: url, url_key it ends at, status (0 where it cannot be reached)."""
        ends = {normalize(r["final_url"] if r["status"] else u): (u, r["status"]) for u, r in self.followed.items()}
        return self.spark.createDataFrame([(u, k, s) for k, (u, s) in ends.items()], "url string, url_key string, status int")

    @cached_property
    def targets(self) -> DataFrame:
        return self.scratch.keep(crosspage.sitemap_targets(self.rel["sitemap"], self.redirects, self.rel["pages"]))

    @cached_property
    def metrics(self) -> DataFrame:
        index = links.page_index(self.rel["pages"]).select(F.col("url_key").alias("eff"), F.col("page_idx").alias("dst"))
        edges = self.effective.select(F.col("page_idx").alias("src"), "eff").join(index, "eff").select("src", "dst")
        return self.scratch.keep(links.degrees(self.rel["pages"], self.effective).join(links.crawl_depth(edges, 0), "page_idx", "left"))

    @cached_property
    def preferred(self) -> dict:
        p = self.rel["pages"].withColumns({"site": F.lit("site"), "crawl_origin": F.lit(self.crawl.origin)})
        row = origin.preference(p).head()
        return row.asDict() if row else {"origin": self.crawl.origin, "source": "crawl-origin", "confidence": None}

    def pages(self) -> DataFrame:
        return self._pages

    @cached_property
    def _pages(self) -> DataFrame:
        p = rules.indexability(self.rel["pages"], self.preferred["origin"])
        listed = self.targets.filter("page_idx is not null").select("page_idx", F.lit(True).alias("in_sitemap")).distinct()
        return self.scratch.keep(p.join(self.metrics, "page_idx", "left").join(listed, "page_idx", "left").withColumn("in_sitemap", F.coalesce("in_sitemap", F.lit(False))))

    @cached_property
    def parsed(self) -> DataFrame:
        """Parsed rows of the pages that gave a document, with the hreflangs as merged by the crawl."""
        out = self.rel["documents"].drop("hreflangs", "requested_url")
        h = self.rel["hreflangs"].groupBy("page_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "lang", "href", "source"))), lambda x: F.struct(x["lang"].alias("lang"), x["href"].alias("href"), x["source"].alias("source"))).alias("hreflangs"))
        return self.scratch.keep(out.join(h, "page_idx", "left").withColumn("hreflangs", F.coalesce("hreflangs", F.array().cast("array<struct<lang:string,href:string,source:string>>"))))

    @cached_property
    def images(self) -> DataFrame:
        """What the social images answer, redirects not followed, with the pictures' size: url, status, content_type, width, height."""
        reached = F.col("error").isNull() & urls.public_target("url")
        got = lookup(social.wanted(self.parsed, social.MOST_IMAGES), self.responses).withColumns({"status": F.when(reached, F.col("status")).otherwise(0), "content_type": F.when(reached, F.col("content_type"))})
        got = got.withColumn("size", F.when(F.lower("content_type").startswith("image/") & (F.octet_length("body") <= MAX_BODY_BYTES), social.dimensions("body")))
        return self.scratch.keep(got.select("url", "status", "content_type", "size.width", "size.height"))

    @cached_property
    def _issues(self) -> DataFrame:
        pages = self.rel["pages"]
        hashes = self.parsed.select("page_idx", "content_hash")
        full = pages.join(hashes, "page_idx", "left")
        fetched = pages.withColumn("status", F.when(F.col("error").isNull(), F.col("status")).otherwise(0))  # a body over the limit is a failed fetch, whatever its status
        parts = [
            rules.page_issues(self.parsed), rules.fetch_issues(fetched), social.image_issues(self.parsed, self.images), crosspage.duplicate_issues(full), links.link_issues(pages, self.effective, self.checks), crosspage.canonical_issues(pages),
            hreflang.target_issues(pages, self.rel["hreflangs"]), crosspage.sitemap_issues(self.targets), crosspage.orphan_issues(self.targets, self.metrics), hreflang.relation_issues(pages, self.rel["hreflangs"]),
        ]
        out = reduce(DataFrame.unionByName, parts).dropDuplicates(["page_idx", "code", "message"])
        return self.scratch.keep(out)

    def issues(self) -> DataFrame:
        out = self._issues
        if self.environment == "live":
            return out.withColumn("expected", F.lit(False))
        cross = self.rel["pages"].select("page_idx", F.coalesce(urls.origin(F.col("canonical_key")) != urls.origin(F.col("url_key")), F.lit(False)).alias("cross_origin"))
        return patterns.staging_context(out, cross)

    @cached_property
    def origins(self) -> DataFrame:
        site = self.spark.createDataFrame([(self.crawl.start_url, self.preferred["origin"])], "start_url string, preferred_origin string")
        probe = [r.url for r in origin.variants(site).select("url").collect()]  # five at most
        got = cr.Responses(self.spark, self.responses).follow(probe)
        answers = self.spark.createDataFrame([(u, r["status"], r["final_url"], len(r["chain"])) for u, r in got.items()], "url string, status int, final_url string, hops int")
        return origin.inspect(site, answers)

    def coverage(self) -> DataFrame:
        return crosspage.coverage(self.targets)

    def site_issues(self) -> DataFrame:
        """code, severity, message of findings about the site as a whole; a message where a limit cut a check short."""
        out = self.spark.createDataFrame(self.crawl.site_issues, "code string, severity string")
        limited: list[tuple[str, str, str]] = []
        cov = self.coverage()
        out = out.unionByName(cov.filter("sitemap_urls > 0 and not complete").select(F.lit("crawl_coverage_partial").alias("code"), F.lit("info").alias("severity")))
        out = out.unionByName(cov.filter("redirected > 0").select(F.lit("sitemap_redirects").alias("code"), F.lit("warning").alias("severity")))
        out = out.unionByName(origin.variant_issues(self.origins).select("code", "severity"))
        if self.preferred["origin"] != self.crawl.origin:
            out = out.unionByName(self.spark.createDataFrame([("canonical_origin_conflict", "warning")], "code string, severity string"))
        if (n := self.candidates.count()) > links.MOST_TARGETS:
            limited.append(("link_target_check_limited", "info", f"{links.MOST_TARGETS} of {n} link targets beyond the crawl were checked."))
        n = social.discovered(self.parsed).count()
        if n > social.MOST_IMAGES:
            limited.append(("social_image_check_limited", "info", f"{social.MOST_IMAGES} of {n} social images were checked."))
        if self.environment == "staging":
            out = out.unionByName(self.protection().filter("unprotected > 0").select(F.lit("staging_unprotected_pages").alias("code"), F.lit("warning").alias("severity")))
        return out.unionByName(self.spark.createDataFrame(limited, "code string, severity string, message string"), allowMissingColumns=True)

    def protection(self) -> DataFrame:
        return patterns.staging_protection(self.rel["pages"])

    def patterns(self) -> DataFrame:
        return patterns.patterns(self.issues(), self.rel["pages"])

    @cached_property
    def image_coverage(self) -> DataFrame:
        """One row: social images that the pages name, and those of them that were checked."""
        found = social.discovered(self.parsed).agg(F.count(F.lit(1)).alias("social_images_discovered"))
        return found.crossJoin(self.images.agg(F.count(F.lit(1)).alias("social_images_checked")))  # one row by one row

    @cached_property
    def robots(self) -> DataFrame:
        """One row: groups and rules of robots.txt."""
        body = self.spark.createDataFrame([("site", self.crawl.robots_body)], "site string, body string")
        return robots.counts(robots.parse(body)).agg(F.coalesce(F.sum("groups"), F.lit(0)).alias("robots_groups"), F.coalesce(F.sum("rules"), F.lit(0)).alias("robots_rules"))

    def summary(self) -> DataFrame:
        """One row of counts over pages, issues, links, images, the sitemap and the environment."""
        p, i = self.pages(), self.issues()
        by_state = p.agg(
            F.count(F.lit(1)).alias("pages"), F.count_if(F.col("indexability") == "indexable").alias("indexable"), F.count_if(F.col("indexability") == "host-alias").alias("host_alias"),
            F.count_if(tx.is_noindex(F.col("robots"), F.col("x_robots"))).alias("noindex"), F.count_if(~F.col("robots_allowed")).alias("robots_blocked"), F.max("depth").alias("max_depth"),
            F.array_join(F.sort_array(F.collect_set(F.lower("lang"))), ",").alias("languages"), F.sum("contextual_outgoing").alias("contextual_links"),
        )
        n = i.agg(
            F.count_if(F.col("code") == "orphan_candidate").alias("orphans"), F.count_if("expected").alias("expected_findings"),
            F.count_distinct(F.when(F.col("code").startswith("content_duplicate"), F.col("message"))).alias("duplicate_content"),
        )
        codes = hreflang.codes(self.rel["hreflangs"])
        r = self.redirects.agg(F.count(F.lit(1)).alias("redirects"), F.count_if(F.col("hops") > 1).alias("redirect_chains"))
        e = self.effective.agg(F.count_if(F.col("hops").isNotNull()).alias("links_to_redirects"))
        m = links.mixed_scheme(self.effective, self.rel["pages"]).agg(F.coalesce(F.sum("mixed"), F.lit(0)).alias("mixed_scheme_links"))
        held = self.protection().select(F.col("protected").alias("staging_protected"), F.col("unprotected").alias("staging_unprotected"), F.col("status").alias("protection"))
        sizes = self.spark.range(1).select(F.lit(self.site_issues().count()).alias("site_issues"), F.lit(len(self.followed)).alias("link_targets_checked"), F.lit(self.patterns().count()).alias("patterns"))
        parts = [patterns.severity_counts(i), by_state, n, codes, r, e, m, self.coverage(), self.image_coverage, self.robots, held, sizes]
        return reduce(DataFrame.crossJoin, parts)  # every part is one row

    def export(self, generated_at: str) -> DataFrame:
        """The records of a CSV export (see sources.reports): the site, patterns, origins, redirects, link checks, pages."""
        q = lambda **names: [F.col(c).alias(n.replace("_", " ") if n[0].isupper() else n) for n, c in names.items()]
        c, p = F.col, self.pages().alias("p")
        at = {"Audit generated at": F.lit(generated_at), "Environment": F.lit(self.environment)}
        said = self.parsed.select(
            "page_idx", *q(H1_count="h1_count", H2_count="h2_count", Word_count="word_count", Image_count="images_total", Images_missing_alt="images_missing_alt", Images_empty_alt="images_empty_alt", OG_title="og_title", OG_description="og_description", OG_image="og_image",
                OG_URL="og_url", Twitter_card="twitter_card", Twitter_title="twitter_title", Twitter_description="twitter_description", Twitter_image="twitter_image", Content_hash="content_hash", Content_hash_status="content_hash_status",
                Detected_lang="detected_lang", Language_confidence="confidence"),
            c("jsonld_scripts").alias("JSON-LD blocks"), c("jsonld_parseable").alias("JSON-LD parseable"), c("jsonld_invalid").alias("JSON-LD syntax invalid"), F.array_join("jsonld_types", " | ").alias("JSON-LD types"), F.array_join("h1", " | ").alias("H1 text"),
            F.array_join(F.transform("jsonld_issues", lambda x: x["message"]), " | ").alias("JSON-LD semantic findings"), *[F.array_join(F.transform("hreflangs", lambda h: h[f]), " | ").alias(n) for f, n in (("lang", "Hreflang codes"), ("href", "Hreflang targets"), ("source", "Hreflang sources"))],
        )
        found = cr.discovery_of(self.rel["pages"], self.rel["discovery"]).groupBy("page_idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "label"))), lambda x: x["label"]), " | ").alias("Discovery sources"))
        pages = p.join(said, "page_idx", "left").join(reports.issue_text(self.issues()), "page_idx", "left").join(found, "page_idx", "left")
        own = q(URL="url", Requested_URL="requested_url", Status="status", Lang="lang", Title="title", Meta_description="description", Canonical="canonical", Indexability="indexability", Indexability_reason="reason", Robots="robots", Incoming_internal_links="incoming",
            Outgoing_internal_links="outgoing", Contextual_incoming_links="contextual_incoming", Contextual_outgoing_links="contextual_outgoing", Crawl_depth="depth", In_sitemap="in_sitemap")
        own += [c("x_robots").alias("X-Robots-Tag"), c("robots_allowed").alias("Robots.txt allowed"), c("matched_rule").alias("Robots.txt matched rule"), F.size("chain").alias("Redirect hops")]
        kept = [x for x in [*said.columns, "Issues", "Error count", "Warning count", "Info count", "Discovery sources"] if x != "page_idx"]
        s = self.summary()
        site = s.select(
            F.lit(self.crawl.start_url).alias("URL"), F.lit(cr.origin_of(self.crawl.start_url)).alias("Input origin"), F.lit(self.crawl.seed_url).alias("Audit seed URL"), F.lit(self.preferred["origin"]).alias("Preferred origin"),
            F.lit(self.preferred["source"]).alias("Preferred origin source"), F.lit(self.preferred["confidence"]).alias("Canonical origin confidence"), c("sitemap_urls").alias("Sitemap URLs discovered"), c("percent").alias("Sitemap coverage %"),
            c("protection").alias("Environment status"), c("errors").alias("Error count"), c("warnings").alias("Warning count"), c("infos").alias("Info count"),
            *[c(x).alias(f"Summary {n}") for x, n in (("indexable", "indexable pages"), ("noindex", "noindex pages"), ("robots_blocked", "robots blocked pages"), ("redirects", "redirects"), ("redirect_chains", "redirect chains"), ("orphans", "orphan candidates"),
                ("duplicate_content", "duplicate groups"), ("links_to_redirects", "links to redirects"), ("mixed_scheme_links", "mixed-scheme links"), ("link_targets_checked", "link targets checked"), ("social_images_checked", "social images checked"),
                ("social_images_discovered", "social images discovered"), ("contextual_links", "contextual links"), ("max_depth", "max crawl depth"), ("host_alias", "host alias pages"), ("staging_protected", "staging protected pages"),
                ("staging_unprotected", "staging unprotected pages"), ("expected_findings", "expected staging findings"), ("patterns", "patterns"))],
        )
        records = {
            "site": site,
            "pattern": self.patterns().select(c("code").alias("Pattern code"), c("scope").alias("Pattern scope"), c("category").alias("Pattern category"), c("likely_root_cause").alias("Pattern root cause")),
            "origin_variant": self.origins.select(c("url").alias("URL"), c("status").alias("Status"), c("relation").alias("Origin relation"), c("final_url").alias("Origin final URL"), c("redirects").alias("Redirect hops")),
            "redirect": self.redirects.select(c("from_key").alias("URL"), c("final_url").alias("Redirect final URL"), c("hops").alias("Redirect hops")),
            "link_check": self.checks.select(c("url").alias("URL"), c("status").alias("Status"), c("url_key").alias("Link check final URL")),
            "page": pages.select(*own, *[c(f"`{x}`") for x in kept]),
        }
        return reports.csv_rows(**{k: df.withColumns(at) for k, df in records.items()})
