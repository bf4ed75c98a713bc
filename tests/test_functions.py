"""URL keys, text measures, page parsing, page rules."""

import pytest
from pyspark.sql import functions as F

from auditlake.functions import text as tx
from auditlake.functions import urls
from auditlake.functions.html import extract_pages, parse_page
from auditlake.operators import rules


@pytest.mark.parametrize(("url", "base", "key"), [
    ("https://Example.com/page?utm_source=test&id=7#section", None, "https://example.com/page?id=7"), ("https://example.com", None, "https://example.com/"), ("../other/", "https://example.com/en/page/", "https://example.com/en/other/"),
    ("https://e.example:443/a", None, "https://e.example/a"), ("http://e.example:8080/a", None, "http://e.example:8080/a"), ("https://e.example/?a=1&a=2&b.c=3&f", None, "https://e.example/?a=2&b_c=3&f="),
    ("https://e.example/?q=a+b%20c", None, "https://e.example/?q=a%20b%20c"), ("https://e.example/?x[]=1&x[]=2&y[k]=3", None, "https://e.example/?x%5B0%5D=1&x%5B1%5D=2&y%5Bk%5D=3"), ("ftp://e.example/", None, None), ("/only/path", None, None), ("https://", None, None), (None, None, None),
])
def test_crawl_keys(url, base, key):
    assert urls.normalize(url, base) == key


def test_crawl_keys_ignore_the_order_of_parameters():
    assert urls.normalize("https://e.example/p?b=2&a=1") == urls.normalize("https://e.example/p?a=1&b=2")


def test_links_that_are_none():
    assert [urls.resolve("https://e.example/", h) for h in ("", None, "mailto:a@b", "TEL:1", "javascript:x", "data:,")] == [None] * 6


def test_public_targets():
    good = ["https://example.com/", "http://1.1.1.1/"]
    bad = ["http://localhost/", "http://a.internal/", "http://10.0.0.1/", "http://127.0.0.1/", "http://[::1]/", "http://user:pw@example.com/", "nonsense", None]
    assert all(map(urls.is_public, good)) and not any(map(urls.is_public, bad))


def test_url_columns(spark):
    df = spark.createDataFrame([("https://WWW.E.example:443/a//?q=1",), ("http://e.example:8080",), ("not a url",), (None,)], "u string")
    c = F.col("u")
    got = df.select(urls.origin(c), urls.host_family(c), urls.path_key(c), urls.hreflang_key(c)).collect()
    assert tuple(got[0]) == ("https://www.e.example", "e.example", "/a?q=1", "https://www.e.example:443/a//?q=1")
    assert tuple(got[1]) == ("http://e.example:8080", "e.example", "/", "http://e.example:8080/")
    assert got[2][2] == "not a url" and got[2][3] is None and got[3][3] is None


def test_text_measures(spark):
    df = spark.createDataFrame([("It's a well-known\xa0fact: naïve  2nd’s.",), ("",), (None,)], "t string")
    got = df.select(tx.word_count(F.col("t")), tx.clean(F.col("t")), tx.normalized(F.col("t"))).collect()
    assert tuple(got[0]) == (6, "It's a well-known fact: naïve 2nd’s.", "it s a well known fact naïve 2nd s")
    assert tuple(got[1]) == (0, "", "") and tuple(got[2]) == (None, None, None)


def test_directives_split_differently(spark):
    df = spark.createDataFrame([("noindex, follow",), ("googlebot:noindex",), ("x-noindex",), (None,)], "v string")
    got = df.select(tx.page_directive(F.col("v"), "noindex"), tx.site_directive(F.col("v"), "noindex"), tx.mentions_noindex(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [(True, True, True), (False, True, True), (False, False, True), (False, False, False)]


def test_hreflang_codes(spark):
    codes = {"en": True, "EN-us": True, "x-default": True, "zh-hans": True, "zh-Hant-TW": True, "es-419": False, "xx": False, "en-xx": False, "zh-hans-xx": False, "": False, "de-hans": False}
    df = spark.createDataFrame([(k,) for k in codes], "c string").select("c", tx.valid_hreflang(F.col("c")).alias("v"))
    assert {r.c: r.v for r in df.collect()} == codes


def test_language_detection(spark):
    es = "la casa de los niños y el perro que en la calle para con una amiga por el camino es más grande que un coche del pueblo " * 4
    df = spark.createDataFrame([(1, es), (2, "la casa"), (3, "zz " * 100), (4, None)], "k int, t string")
    got = {r.k: (r.detected_lang, r.confidence) for r in tx.detect_language(df, "t").collect()}
    assert got[1][0] == "es" and got[1][1] >= 0.39 and got[2] == (None, 0.0) and got[3] == (None, 0.0) and got[4] == (None, 0.0)


HEAD = '<html lang="en"><head><title>{t}</title><meta name="Description" content="{d}"><meta name=robots content="noindex,follow"><link rel="Canonical" href="/self?utm_source=x"></head><body>{b}</body></html>'


def test_page_with_typical_faults(spark):
    links = "".join(f'<link rel="alternate" hreflang="{c}" href="/{c}">' for c in ("en", "zh-Hans", "es-419"))
    html = HEAD.format(t="t" * 61, d="d" * 170, b="<main><h1>One</h1><img src=x><img alt='' src=y><p>Some words here</p></main>").replace("</head>", links + "</head>")
    df = spark.createDataFrame([(0, "https://e.example/self", html)], "page_idx long, url string, html string")
    p = extract_pages(df).withColumn("url_key", urls.url_key(F.col("url")))
    row = p.head()
    assert (row.h1_count, row.images_missing_alt, row.images_empty_alt, row.canonical, row.word_count) == (1, 1, 1, "https://e.example/self", 4)
    found = {(r.code, r.severity) for r in rules.page_issues(p).collect()}
    assert {("title_long", "info"), ("description_long", "info"), ("robots_noindex", "info"), ("image_alt_missing", "warning"), ("hreflang_code_suspicious", "warning"), ("content_thin", "info"), ("hreflang_self_missing", "warning")} <= found
    assert not {"canonical_other", "canonical_missing", "h1_missing"} & {c for c, _ in found}


def test_visible_text_and_links():
    page = parse_page("https://e.example/", """<body><nav><a href="/n">Nav <b>link</b></a></nav><main><h1>Projects I build,<br>improve and grow.</h1><p>Text<script>no</script> with <a href="in?utm_a=1">a link</a></p>
      <a href="/x.PDF">file</a><a href="mailto:a@b">m</a></main><article>other</article><footer><a href="/n">Nav link again</a></footer></body>""")
    assert page["h1"] == ["Projects I build, improve and grow."] and page["visible_text"] == "Projects I build, improve and grow. Text with a link file m" and page["fingerprint_text"] == "Text with a link file m"
    assert page["links"] == ["https://e.example/n", "https://e.example/in"]
    assert [(d["href"], d["text"], d["location"]) for d in page["link_details"]] == [("https://e.example/n", "Nav link", "navigation"), ("https://e.example/in", "a link", "contextual"), ("https://e.example/n", "Nav link again", "footer")]


def test_json_ld():
    block = '<script type="application/ld+json">{}</script>'
    page = parse_page("https://e.example/", block.format('{"@context":"https://schema.org","@graph":[{"@type":"WebSite","publisher":{"@id":"#p"}},{"@type":["Person"]}]}') + block.format('{"@context":"x","@type":"Product","name":"n"}') + block.format('{"@type":"BreadcrumbList"}') + block.format(" ") + block.format("{bad"))
    assert (page["jsonld_scripts"], page["jsonld_parseable"], page["jsonld_invalid"]) == (5, 3, 2) and page["jsonld_types"] == ["BreadcrumbList", "Person", "Product", "WebSite"]
    assert [i["code"] for i in page["jsonld_issues"]] == ["jsonld_product_offer_rating_missing", "jsonld_context_missing", "jsonld_breadcrumb_items_missing"]
    assert [i["code"] for i in parse_page("https://e.example/", block.format('{"@context":"x","name":"n"}'))["jsonld_issues"]] == ["jsonld_type_missing"]


def test_references_have_semicolons():
    page = parse_page("https://e.example/", """<title>R&amp;D &lt;&quot;&amp;amp; &eacute;&#38;&#x26 &amp</title><meta name=description content="a&amp;b &copy&amp"><main><h1>x&amp;&amp</h1><p>\ue000 &#xE001; &ampere &copy2 &fake; &am&lt</p>
      <a href="/x?a=1&copy=2&amp;lt=3">y</a></main><script type="application/ld+json">{"@context": "x", "@type": "A&amp &amp; \ue000"}</script>""")
    assert page["title"] == 'R&D <"&amp; é&& &amp' and page["description"] == "a&b &copy&amp" and page["h1"] == ["x&&amp"]
    assert page["visible_text"] == "x&&amp \ue000 \ue001 &ampere &copy2 &fake; &am&lt y" and page["jsonld_types"] == ["A&amp &amp; \ue000"]
    assert page["links"] == ["https://e.example/x?a=1&copy=2&lt=3"]


def test_empty_and_broken_pages():
    for html in ("", "<", "<title", "plain text", "<p><b>open", "<!-- open", "<a href='/x'>" * 2000):
        assert parse_page("https://e.example/", html)["h1_count"] == 0


def test_deep_and_unclosed_pages_parse_in_proportion():
    import time

    began = time.process_time()
    deep = parse_page("https://e.example/", "<main>" + "<div>x" * 100_000 + "</b>" * 100_000 + "<a href=/y>y" * 20_000)
    assert len(deep["visible_text"]) > 200_000 and deep["links"] == ["https://e.example/y"]
    assert time.process_time() - began < 30
    odd = parse_page("https://e.example/", "<body><h1>a<h1>b<nav><a href=/n>n</nav>c</h1><main><h2>d</h2>e<main>f</main></main>g<article>h</article>")
    assert odd["h1"] == ["bnc", "abncdefgh"] and odd["link_details"][0]["location"] == "navigation"
    assert odd["visible_text"] == "d e f" and odd["fingerprint_text"] == ""  # all of it lies in the heading that stays open


def test_url_keys_that_need_no_call(spark):
    given = ["http://a.example/", "https://a-b.example/x/y;p=1,2:3@4!$&'()*+=~_.-", "https://a.example//x/../y/.", "https://A.example/", "https://a.example", "https://a.example/%7Ex", "https://a.example/x?b=2&a=1#f", " https://a.example/x ", "https://a.example:443/", "https://a.example/\u00e9", "https://a.example/x\n", "ftp://a.example/", "https:///x", "https://1.2.3.4/", "", None]
    df = spark.createDataFrame([(u,) for u in given], "u string")
    assert [r.k for r in df.select(urls.url_key(F.col("u")).alias("k")).collect()] == [urls.normalize(u) for u in given]
