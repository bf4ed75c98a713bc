"""Audit operators on small relations with known answers."""

from pyspark.sql import functions as F

from auditlake.operators import crosspage, diff, history, hreflang, insights, links, origin, patterns, robots, rules, sitemap, social
from auditlake.sources import reports

PAGE = "page_idx long, url string, url_key string, status int, robots string, x_robots string, canonical string, canonical_key string, lang string, title string, description string, content_hash string, robots_allowed boolean"


def page(i, **over):
    u = over.pop("url", f"https://e.example/{i}")
    base = dict(url=u, url_key=u, status=200, robots=None, x_robots=None, canonical=u, canonical_key=u, lang="en", title=f"t{i}", description=f"d{i}", content_hash=None, robots_allowed=True)
    if "canonical" in over:
        base["canonical_key"] = over["canonical"]
    return (i, *(base | over).values())


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), PAGE)


def decisions(spark, body, urls, agent="Googlebot"):
    b = spark.createDataFrame([("s", body)], "site string, body string")
    u = spark.createDataFrame([("s", f"https://e.example{x}", x) for x in urls], "site string, url string, path string")
    return {r.path: (r.robots_allowed, r.matched_rule) for r in robots.decide(u, robots.rules_for(robots.parse(b), agent)).collect()}


def test_robots_of_the_named_agent_alone_count(spark):
    body = "User-agent: Googlebot\nDisallow: /cellar\nAllow: /cellar/wine\n\nUser-agent: *\nAllow: /attic/window\nDisallow: /attic\n"
    paths = ["/attic/box", "/cellar", "/cellar/wine/red", "/garden"]
    assert [v[0] for v in decisions(spark, body, paths).values()] == [True, False, True, True]
    assert [v[0] for v in decisions(spark, body, paths, "otherbot").values()] == [False, True, True, True]


def test_robots_longest_pattern_wins(spark):
    body = "User-agent: *\nDisallow: /shop/*sort=\nDisallow: /shop/a*z$\nAllow: /shop/a\nAllow: /*.csv$\n"
    got = decisions(spark, body, ["/shop/list?sort=up", "/shop/abz", "/shop/abzy", "/shop/x.csv", "/shop/a?sort=1", "/p(1)+[2]"])
    assert got == {
        "/shop/list?sort=up": (False, "/shop/*sort="), "/shop/abz": (False, "/shop/a*z$"), "/shop/abzy": (True, "/shop/a"),
        "/shop/x.csv": (True, "/*.csv$"), "/shop/a?sort=1": (False, "/shop/*sort="), "/p(1)+[2]": (True, None),
    }


def test_robots_odd_bodies(spark):
    body = "Allow: /early\r\nDisallow: /early\r\nUser-agent: googleb # the start of a name\r\nDisallow:\r\nSitemap: x\r\nUser-agent: *\r\nDisallow: /late # why\r\n"
    assert decisions(spark, body, ["/early", "/late", "/late/r"]) == {"/early": (True, None), "/late": (False, "/late"), "/late/r": (False, "/late")}  # an empty Disallow alone falls back to *
    assert decisions(spark, "# nothing", ["/"]) == {"/": (True, None)}
    assert decisions(spark, "User-agent: *\nDisallow: /tie\nAllow: /tie", ["/tie?x"]) == {"/tie?x": (True, "/tie")}


def declarations(spark, *rows):
    return spark.createDataFrame([(i, k, lang, href, href, "html") for k, (i, lang, href) in enumerate(rows)], "page_idx long, pos long, lang string, href string, href_key string, source string")


def test_hreflang_relations(spark):
    e, s = "https://e.example/0", "https://e.example/1"
    p = pages(spark, page(0), page(1))
    ok = declarations(spark, (0, "en", e), (0, "es", s), (0, "de", "https://e.example/de"), (1, "es", s), (1, "en", e))
    c = hreflang.relation_counts(p, ok).head()
    assert (c.missing_reciprocal, c.unverified_targets, c.conflicting_declarations) == (0, 1, 0) and hreflang.relation_issues(p, ok).count() == 0
    p = pages(spark, page(0), page(1, robots="noindex", canonical=e))
    c = hreflang.relation_counts(p, declarations(spark, (0, "en", e), (0, "es", s))).head()
    assert (c.missing_reciprocal, c.non_indexable_targets, c.canonical_conflicts) == (1, 1, 1)
    c = hreflang.relation_counts(p, declarations(spark, (0, "es", "https://e.example/a"), (0, "es", "https://e.example/b"))).head()
    assert (c.conflicting_declarations, c.unverified_targets) == (1, 2)
    codes = {r.code for r in hreflang.target_issues(p, declarations(spark, (0, "es", s))).collect()}
    assert codes == {"hreflang_target_noindex", "hreflang_target_canonical_other", "hreflang_target_lang_mismatch", "hreflang_not_reciprocal"}
    failed = pages(spark, page(0), page(1, status=404, robots="noindex"), page(2, status=0, lang="es"))
    got = {(r.code, r.message) for r in hreflang.target_issues(failed, declarations(spark, (0, "es", s), (0, "es", "https://e.example/2"))).collect()}
    assert {c for c, _ in got} == {"hreflang_target_error", "hreflang_not_reciprocal"}


def test_hreflang_merge_and_link_header(spark):
    d = spark.createDataFrame([(0, 1, "en", "/a", "k", "sitemap"), (0, 2, "en", "/A", "k", "http-header"), (0, 3, "de", "/d", "k", "sitemap"), (0, 4, "en", "/a", "k", "sitemap")], "page_idx long, pos long, lang string, href string, href_key string, source string")
    assert {(r.lang, r.href, r.source) for r in hreflang.merge(d).collect()} == {("en", "/a", "sitemap+http-header"), ("de", "/d", "sitemap")}
    h = spark.createDataFrame([(0, "https://e.example/", '<https://e.example/de?utm_x=1>; rel="alternate"; hreflang="DE", </en>; rel=alternate; hreflang=en, </c>; rel="canonical", </x>; rel=alternate'), (1, "https://e.example/", None)], "page_idx long, url string, link_header string")
    assert sorted((r.lang, r.href) for r in hreflang.from_http(h).collect()) == [("de", "https://e.example/de"), ("en", "https://e.example/en")]


def test_links_redirects_depth_and_orphans(spark):
    p = pages(spark, *[page(i) for i in range(5)])
    u = lambda i: f"https://e.example/{i}"
    rows = [(0, 0, u(1), u(1), True), (0, 1, u(9), u(9), False), (1, 0, u(2), u(2), True), (2, 0, u(2), u(2), True), (3, 0, u(3), u(3), False), (2, 1, u("gone"), u("gone"), False), (2, 2, "http://e.example/1", u(1), False)]
    ln = spark.createDataFrame(rows, "page_idx long, pos long, href string, dst string, contextual boolean")
    red = spark.createDataFrame([(u(9), u(2), u(2), 2)], "from_key string, final_key string, final_url string, hops int")
    checks = spark.createDataFrame([(u("gone"), 410)], "url_key string, status int")
    e = links.effective(ln, red)
    m = {r.page_idx: (r.incoming, r.outgoing) for r in links.degrees(p, e).collect()}
    assert m == {0: (0, 2), 1: (2, 1), 2: (3, 3), 3: (1, 1), 4: (0, 0)}
    codes = {(r.page_idx, r.code) for r in links.link_issues(p, e, checks).collect()}
    assert codes == {(0, "internal_link_to_redirect"), (0, "internal_link_redirect_chain"), (2, "broken_internal_link"), (2, "mixed_scheme_internal_link")}
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 1), (3, 3), (0, 2)], "src long, dst long")
    assert {r.page_idx: r.depth for r in links.crawl_depth(edges, 0).collect()} == {0: 0, 1: 1, 2: 1}
    assert [(r.url_key, r.href) for r in links.uncrawled(ln, p, red, "https://e.example").collect()] == [(u("gone"), u("gone"))]
    sm = spark.createDataFrame([(i, u(i), u(i)) for i in range(5)], "pos long, url string, url_key string")
    t = crosspage.sitemap_targets(sm, red, p)
    assert crosspage.coverage(t).head().complete and [r.page_idx for r in crosspage.orphans(t, links.degrees(p, e)).collect()] == [4]  # a self-link saves page 3
    partial = crosspage.sitemap_targets(sm.unionByName(spark.createDataFrame([(9, u("z"), u("z"))], sm.schema)), red, p)
    assert crosspage.coverage(partial).head().percent == 83.3 and crosspage.orphans(partial, links.degrees(p, e)).count() == 0


def test_redirects_end_or_give_up(spark):
    hops = spark.createDataFrame([(f"a{k}", f"a{k + 1}") for k in range(4)] + [(f"b{k}", f"b{k + 1}") for k in range(6)] + [("c", "c")], "from_key string, to_key string")
    got = {r.from_key: (r.final_key, r.hops, r.complete) for r in links.follow_redirects(hops).collect()}
    assert got["a0"] == ("a4", 4, True) and got["a3"] == ("a4", 1, True) and not got["b0"][2] and not got["c"][2]


def test_duplicates_and_canonicals(spark):
    p = pages(spark, page(0, title=" Same "), page(1, title="same", lang="de-AT", content_hash="h", canonical="https://e.example/0"), page(2, title="x", content_hash="h", canonical="https://e.example/0"), page(3, title="x", content_hash="h", robots="noindex"), page(4, title="", status=404))
    got = {(r.page_idx, r.code, r.severity) for r in crosspage.duplicate_issues(p).collect()}
    assert got == {(0, "title_duplicate_multilingual", "info"), (1, "title_duplicate_multilingual", "info"), (2, "title_duplicate", "warning"), (3, "title_duplicate", "warning"), (1, "content_duplicate_multilingual", "info"), (2, "content_duplicate_multilingual", "info")}
    p = pages(spark, page(0, canonical="https://e.example/1"), page(1, canonical="https://e.example/2", robots="noindex"), page(2, status=500, canonical=None))
    got = {(r.page_idx, r.code) for r in crosspage.canonical_issues(p).collect()}
    assert got == {(0, "canonical_target_noindex"), (0, "canonical_chain"), (1, "canonical_target_error")}


def test_indexability_in_order(spark):
    p = pages(spark, page(0, status=0, robots="noindex"), page(1, status=404), page(2, x_robots="googlebot: noindex"), page(3, canonical="https://www.e.example/3"), page(4, canonical="https://e.example/1"), page(5, canonical=None))
    got = {r.page_idx: r.indexability for r in rules.indexability(p, "https://www.e.example").collect()}
    assert got == {0: "unknown", 1: "not-indexable", 2: "not-indexable", 3: "host-alias", 4: "canonicalized", 5: "indexable"}


ISSUE = "page_idx long, url string, stage int, seq long, code string, severity string, message string, expected boolean"


def issues(spark, *rows):
    return spark.createDataFrame([(i, f"https://e.example/{i}" if i is not None else "https://e.example", 1, k, code, sev, msg, exp) for k, (i, code, sev, msg, exp) in enumerate(rows)], ISSUE)


def test_patterns(spark):
    p = pages(spark, *[page(i) for i in range(4)])
    got = patterns.patterns(issues(spark, *[(i, "description_missing", "warning", "m", False) for i in range(4)], (0, "canonical_missing", "warning", "m", False), (0, "http_error", "error", " ", False), (1, "http_error", "error", "second", False)), p).collect()
    assert [(r.code, r.urls, r.scope) for r in got] == [("http_error", 2, "repeated"), ("description_missing", 4, "likely-template")]
    assert got[0].example_message == "second" and got[1].likely_root_cause.startswith("At least half of the pages have it. Look first at ") and got[1].title == "Description Missing"


def test_staging(spark):
    i = issues(spark, (0, "robots_noindex", "info", "m", False), (0, "sitemap_noindex", "warning", "m", False), (0, "canonical_other", "info", "m", False), (1, "title_missing", "error", "m", False)).drop("expected")
    cross = spark.createDataFrame([(0, True), (1, False)], "page_idx long, cross_origin boolean")
    got = {r.code: (r.severity, r.expected) for r in patterns.staging_context(i, cross).collect()}
    assert got == {"robots_noindex": ("info", True), "sitemap_noindex": ("info", True), "canonical_other": ("info", True), "title_missing": ("error", False)}
    states = [patterns.staging_protection(pages(spark, *x)).head().status for x in ([page(0, robots="noindex")], [page(0)], [page(0), page(1, robots_allowed=False)], [page(0, status=404)])]
    assert states == ["protected", "unprotected", "partial", "unknown"]


def test_origins(spark):
    p = spark.createDataFrame([("s", k, f"https://{'www.' if k else ''}e.example/{k}", "https://e.example") for k in range(5)] + [("s", 9, "https://other.example/", "https://e.example"), ("t", 0, "https://t.example/", "http://t.example")], "site string, page_idx long, canonical string, crawl_origin string")
    got = {r.site: (r.origin, r.source, r.confidence) for r in origin.preference(p).collect()}
    assert got == {"s": ("https://www.e.example", "sitewide-canonical", 0.8), "t": ("http://t.example", "crawl-origin", None)}
    sites = spark.createDataFrame([("http://e.example/x", "https://e.example")], "start_url string, preferred_origin string")
    r = lambda *rows: spark.createDataFrame(list(rows), "url string, status int, final_url string, hops int")
    moved = origin.inspect(sites, r(("https://e.example/", 200, "https://e.example/", 0), ("http://e.example/", 200, "https://e.example/", 1)))
    assert {x.url: x.relation for x in moved.collect()} == {"https://e.example/": "preferred", "http://e.example/": "redirects-to-preferred", "https://www.e.example/": "unreachable", "http://www.e.example/": "unreachable"}
    assert origin.variant_issues(moved).count() == 0
    direct = origin.inspect(sites, r(("https://e.example/", 200, "https://e.example/", 0), ("http://e.example/", 200, "http://e.example/", 0)))
    assert [x.code for x in origin.variant_issues(direct).collect()] == ["origin_variant_direct_200"]


def test_sitemaps(spark):
    body = b'<?xml version="1.0"?><x:urlset xmlns:x="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:h="http://www.w3.org/1999/xhtml"><x:url><x:loc> /en/a?utm_source=1 </x:loc><h:link rel="alternate" hreflang="DE" href="/de/a"/></x:url><x:url><x:loc>https://e.example/en/a</x:loc></x:url><x:url><x:loc>/de/a</x:loc></x:url><x:url/></x:urlset>'
    import gzip

    df = spark.createDataFrame([("https://e.example/s.xml.gz", gzip.compress(body)), ("https://e.example/t.xml.gz", body), ("https://e.example/bad", b"<urlset><url>"), ("https://e.example/none", None), ("https://e.example/i", b"<sitemapindex><sitemap><loc>/s.xml</loc></sitemap></sitemapindex>")], "url string, body binary")
    got = sitemap.parse(df)
    assert {r.url.rpartition("/")[2]: r.kind for r in got.collect()} == {"s.xml.gz": "urlset", "t.xml.gz": "urlset", "bad": "invalid", "none": "invalid", "i": "index"}
    one = got.filter("url = 'https://e.example/s.xml.gz'")
    assert sorted((r.pos, r.url_key, r.url) for r in sitemap.locations(one).collect()) == [(0, "https://e.example/en/a", "https://e.example/en/a"), (2, "https://e.example/de/a", "/de/a")]
    assert [(r.lang, r.href) for r in one.filter("lang is not null").collect()] == [("de", "https://e.example/de/a")]
    seeds = spark.createDataFrame(list(enumerate(f"https://e.example/{x}" for x in ("en/1", "en/2", "x", "de/1", "en/3", "de-AT/1"))), "pos long, url string")
    assert [r.pos for r in sitemap.interleave(seeds).orderBy("turn", "first_pos").collect()] == [0, 2, 3, 5, 1, 4]


def test_social_images(spark):
    png = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR\x00\x00\x00\x03\x00\x00\x00\x02"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x05\x00\x07" + b"\x00" * 8
    gif = b"GIF89a\x09\x00\x08\x00"
    df = spark.createDataFrame([(0, png), (1, jpeg), (2, gif), (3, b"no"), (4, None)], "k int, b binary").select("k", social.dimensions("b").alias("d"))
    assert {r.k: (r.d.width, r.d.height) for r in df.collect()} == {0: (3, 2), 1: (7, 5), 2: (9, 8), 3: (None, None), 4: (None, None)}
    p = spark.createDataFrame([(0, "u0", "a", "b"), (1, "u1", "c", None), (2, "u2", "d", "e")], "page_idx long, url string, og_image string, twitter_image string")
    i = spark.createDataFrame([("a", 0, None), ("b", 404, "image/png"), ("c", 301, None), ("d", 200, "text/html"), ("e", 200, "image/png")], "url string, status int, content_type string")
    assert sorted((r.page_idx, r.code) for r in social.image_issues(p, i).collect()) == [(0, "social_image_http_error"), (0, "social_image_unreachable"), (1, "social_image_redirect"), (2, "social_image_content_type")]
    assert [r.url for r in social.wanted(p, 3).collect()] == ["a", "b", "c"]


def test_diff_progress_and_history(spark):
    a = issues(spark, (0, "x", "error", "m", False), (0, "x", "error", "last", False), (1, "y", "info", "m", False), (2, "z", "info", "m", True), (None, "s", "warning", "m", False))
    b = issues(spark, (0, "x", "warning", "last", False), (3, "new", "error", "m", False), (2, "z", "info", "m", False))
    got = {(r.issue_key.rpartition("/")[2], r.change) for r in diff.diff_issues(a, b).collect()}
    assert got == {("0|x", "changed"), ("1|y", "fixed"), ("3|new", "new"), ("2|z", "new"), ("site|s", "fixed")}
    shared = spark.createDataFrame([(f"https://e.example/{i}",) for i in (0, 1, 2)], "url string")
    got = {(r.issue_key.rpartition("/")[2], r.state) for r in diff.progress(a, b, shared, shared).collect()}
    assert got == {("0|x", "remaining"), ("1|y", "fixed"), ("2|z", "introduced"), ("site|s", "fixed")}
    row = lambda i, url, **k: (i, url, *({"indexability": "indexable", "canonical": None, "title": "t", "description": "d", "h1": ["h"]} | k).values())
    schema = "page_idx long, url string, indexability string, canonical string, title string, description string, h1 array<string>"
    p = spark.createDataFrame([row(0, "https://stage.e.example/a/"), row(1, "https://stage.e.example/b"), row(2, "https://stage.e.example/c", canonical="https://stage.e.example/c/")], schema)
    q = spark.createDataFrame([row(0, "https://e.example/a", title="T", h1=None), row(1, "https://e.example/new"), row(2, "https://e.example/c", canonical="https://e.example/c", indexability="unknown")], schema)
    got = {(r.key, r.change, r.fields) for r in diff.diff_pages(p, q, True).collect()}
    assert got == {("/a", "changed", "title,h1"), ("/b", "removed", None), ("/new", "new", None)}
    runs = spark.createDataFrame(
        [(str(k), u, env, 10, 0, "completed", None, f"2024-11-{d:02d} 00:00:00", f"2024-10-{d:02d} 00:00:00", None) for k, (u, env, d) in enumerate([("https://example.com/", "live", 20), ("https://www.example.com/sub/", "live", 21), ("https://example.com/", "live", 22), ("https://stage.example.com/", "staging", 22)], 1)],
        "id string, url string, environment string, max_pages int, pages_done int, status string, error string, expires_at string, created_at string, updated_at string",
    ).withColumns({c: F.col(c).cast("timestamp") for c in ("expires_at", "created_at", "updated_at")})
    now = F.lit("2024-10-25 00:00:00").cast("timestamp")
    assert [(r.current_id, r.previous_id) for r in history.latest_pairs(runs, now).collect()] == [("3", "2")]
    more = history.admit(runs, "5", "https://n.example/", "live", 5, now)
    assert more.count() == 5 and history.active(more, now).head().active == 1
    done = history.advance(history.advance(more, "5", "running", now), "5", "completed", now, 4)
    assert done.filter("id = '5'").head().status == "completed" and history.advance(done, "5", "running", now).filter("id = '5'").head().status == "completed"
    keep, gone = history.split_expired(runs, F.lit("2024-11-21 00:00:00").cast("timestamp"))
    assert {r.id for r in keep.collect()} == {"3", "4"} and gone.count() == 2


def test_insights(spark):
    p = pages(spark, page(0), page(1, robots="noindex"), page(2)).withColumn("indexability", F.when(F.col("page_idx") == 1, "not-indexable").otherwise("indexable"))
    i = issues(spark, (0, "http_error", "error", "m", False), (1, "title_missing", "error", "m", False), (2, "description_missing", "warning", "a", False), (0, "description_missing", "warning", "b", False), (2, "x", "info", "m", True))
    got = {(r.priority, r.code, r.urls) for r in insights.priorities(i, p).collect()}
    assert got == {(0, "http_error", 1), (2, "title_missing", 1), (1, "description_missing", 2)}
    assert {r.page_idx for r in insights.filter_pages(p, i, "error").collect()} == {0, 1} and insights.filter_pages(p, i, "expected").count() == 1 and insights.filter_pages(p, i, "all", "HTTP_err").count() == 1


def test_report_files(spark, tmp_path):
    p = pages(spark, page(0, title='a "quoted", title\nin two lines'), page(1))
    i = issues(spark, (0, "x", "error", "first", False), (0, "y", "info", "second: part", True), (1, "z", "warning", "third", False))
    rows = reports.csv_rows(site=spark.createDataFrame([("https://e.example", "live")], "URL string, Environment string"), page=p.select("page_idx", F.col("url").alias("URL"), F.col("title").alias("Title")).join(reports.issue_text(i), "page_idx").drop("page_idx"))
    reports.write_csv(rows, f"{tmp_path}/csv")
    back = reports.read_csv(spark, f"{tmp_path}/csv")
    assert back.count() == 3 and back.filter("URL = 'https://e.example/0'").head().Title == 'a "quoted", title\nin two lines'
    assert {(r.severity, r.message, r.expected) for r in reports.imported_issues(back).collect()} == {("error", "first", False), ("expected", "second: part", True), ("warning", "third", False)}
    reports.write_json(reports.report(spark.createDataFrame([(2,)], "pages int"), p, i), f"{tmp_path}/json")
    assert reports.read_json(spark, f"{tmp_path}/json").filter("record = 'page'").count() == 2
    name = spark.range(1).select(reports.file_name(F.lit("https://E.example:8080/x"), F.lit("2024-01-02 03:04:05").cast("timestamp"), "csv").alias("n")).head().n
    assert name == "seo-audit-e.example-20240102-030405.csv"


def test_page_queries_read_pages_of_any_length(spark, tmp_path):
    from auditlake.plans import catalog

    page = lambda title, text: f'<html lang="en"><head><title>{title}</title></head><body><main><h1>h</h1><p>{text}</p></main></body></html>'
    rows = [(0, "https://1.1.1.1" + "/", page("A short page of good length", "text")), (1, "https://1.1.1.1" + "/long", page("x", "word " * 600_000))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    q = {k: catalog.queries()[k](spark, str(tmp_path)).collect() for k in ("page_title_rules", "page_lang_tally", "page_facts", "page_issue_counts")}
    assert [(r.page_idx, r.code) for r in q["page_title_rules"]] == [(1, "title_short")] and [(r.lang, r.pages) for r in q["page_lang_tally"]] == [("en", 2)]
    assert {r.page_idx: r.word_count for r in q["page_facts"]} == {0: 2, 1: 600_001} and {r.code: r.pages for r in q["page_issue_counts"]}["canonical_missing"] == 2


def cut_pages(spark, path):
    """Titles that are cut within a character reference."""
    page = lambda title: f'<!DOCTYPE html><html lang="en"><head><title>{title}</title></head><body><nav><a href="/a">a</a></nav><article><h1>{title}</h1><p>some text&amp;&amp; and more</p></article></body></html>'
    titles = ["One of two&amp;&amp;&amp", "&quot;Said&quot", "this &lt;&lt", "those &gt;&gt", "that&amp;&am", "whole &amp;", "&amp;lt; &amp;quot"]
    spark.createDataFrame([(k, f"https://e.example/{k}", page(t)) for k, t in enumerate(titles)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")


def answers_of_sql(name, path):
    import duckdb

    from auditlake.plans import catalog

    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{path}/pages.parquet/*.parquet')")
    return sorted(con.execute(catalog.oracle_sql()[name]).fetchall())


def test_page_facts_of_cut_references(spark, tmp_path):
    from auditlake.plans import catalog

    cut_pages(spark, tmp_path)
    got = sorted(tuple(r) for r in catalog.queries()["page_facts"](spark, str(tmp_path)).collect())
    assert [r[1] for r in got] == ["One of two&&&amp", '"Said&quot', "this <&lt", "those >&gt", "that&&am", "whole &", "&lt; &quot"]
    assert got == answers_of_sql("page_facts", tmp_path)


def test_visible_words_of_cut_references(spark, tmp_path):
    from auditlake.plans import catalog

    cut_pages(spark, tmp_path)
    got = sorted(tuple(r) for r in catalog.queries()["visible_word_count"](spark, str(tmp_path)).collect())
    assert [r[1:3] for r in got] == [(8, 4), (6, 4), (6, 4), (6, 4), (6, 4), (5, 4), (6, 4)]
    assert got == answers_of_sql("visible_word_count", tmp_path)


def test_digests_keep_white_space_that_is_no_blank(spark, tmp_path):
    """The SQL's digest leaves out blanks, tabs and line ends only: no-break and wide spaces and control characters are text."""
    from auditlake.plans import catalog

    texts = ["plain text", "no\u00a0break", "\u3000wide \u2003\u2028", "\x0b\x1c\x85", "<p>\u00a0</p>one", " \t\r\n\f", "plain\t\r\n\ftext", "<h2>\u00a0out</h2>plain text"]
    page = lambda text: f"<html><head><title>t</title></head><body><article><h1>\u00a0t</h1><p>{text}<p> \u00a0 </article></body></html>"
    spark.createDataFrame([(k, f"https://e.example/{k}", page(t)) for k, t in enumerate(texts)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in catalog.queries()["visible_word_count"](spark, str(tmp_path)).collect())
    assert [r[1:3] for r in got] == [(3, 2), (3, 2), (2, 1), (1, 0), (2, 1), (1, 0), (3, 2), (4, 2)]
    assert got[0][3] == got[6][3] == got[7][3] and len({r[3] for r in got}) == 6
    assert got == answers_of_sql("visible_word_count", tmp_path)


def test_click_depth_has_no_limit(spark):
    """A path of 16 pages, with a shorter way to one of them, a cycle, and pages out of reach."""
    edges = spark.createDataFrame([(k, k + 1) for k in range(16)] + [(16, 0), (0, 10), (5, 5), (70, 71), (0, 1)], "src long, dst long")
    got = {r.page_idx: r.depth for r in links.crawl_depth(edges, 0).collect()}
    assert got == {k: min(k, k - 9 if k >= 10 else k) for k in range(17)}
    assert [tuple(r) for r in links.crawl_depth(edges.limit(0), 3).collect()] == [(3, 0)]


def test_runs_are_pruned_with_their_archives_and_loaded_by_id(spark, tmp_path):
    ids = [f"0000000{k}-0000-4000-8000-00000000000{k}" for k in range(4)]
    for k in range(4):
        (tmp_path / f"a{k}").mkdir()
        (tmp_path / f"a{k}" / "part.json").write_text("{}")
    runs = spark.createDataFrame([(ids[k], "completed" if k != 2 else "failed", f"2024-01-0{k + 1} 00:00:00", str(tmp_path / f"a{k}")) for k in range(4)], "id string, status string, expires_at string, archive_path string")
    runs = runs.withColumn("expires_at", F.col("expires_at").cast("timestamp"))
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    assert sorted(r.id for r in history.prune(runs, now).collect()) == ids[1:] and [(tmp_path / f"a{k}").exists() for k in range(4)] == [False, True, True, True]
    found = lambda a, b: {(r.place, r.id) for r in history.saved(runs, a, b, now).collect()}
    assert found(ids[3], ids[1]) == {("current", ids[3]), ("previous", ids[1])}
    assert found(ids[2], None) == found("1 or 1", ids[0]) == set()
