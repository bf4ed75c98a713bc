"""DuckDB SQL for the queries that read documents: expected facts by residue for made documents, text functions for `pages`."""

from __future__ import annotations

SITE = "'https://site.example/p/' || {}"
_AT = SITE.format("i")
_NEXT = SITE.format("(i + 1)")

#: What derived.RICH puts into document i, field by field.
_FACTS = f"""with n as (select page_id as i from pages),
t as (select i, case i % 12 when 5 then '' when 7 then '' when 1 then 'Tiny & ' || i when 2 then repeat('long words ', 7) || i else 'A page title of usual length ' || i end as title,
  case i % 10 when 0 then '' when 1 then 'Short.' when 2 then trim(repeat('far too long ', 14)) else repeat('a fitting line ', 6) || i end as description,
  case when i % 13 = 4 then 'NoIndex, follow' end as robots, case when i % 9 = 4 then null else ['en', 'de-AT', 'fr', 'es'][i % 4 + 1] end as lang,
  case when i % 23 in (2, 5, 6) then null when i % 23 between 7 and 9 then {_NEXT} else {_AT} end as canonical,
  case when i % 23 = 2 then null when i % 23 = 3 then '/p/' || i when i % 23 = 5 then '' when i % 23 = 6 then 'javascript:void(0)' when i % 23 between 7 and 9 then '' || (i + 1) else '?utm_source=x#top' end as canonical_raw,
  case i % 23 when 2 then 0 when 3 then 2 else 1 end::bigint as canonical_count, case i % 6 when 0 then 0 when 1 then 2 else 1 end::bigint as h1_count,
  case i % 6 when 0 then '' when 1 then 'First|Second ' || i else 'Heading no ' || i end as h1, (i % 4)::bigint as h2_count,
  (i % 7)::bigint as images_total, ((i % 7 > 1)::int + (i % 7 > 4)::int)::bigint as images_missing_alt, ((i % 7 > 2)::int + (i % 7 > 5)::int)::bigint as images_empty_alt,
  case i % 9 when 0 then 0 when 7 then 2 else 1 end::bigint as jsonld_scripts, (i % 9 > 1)::int::bigint as jsonld_parseable, (i % 9 in (1, 7))::int::bigint as jsonld_invalid,
  ['', '', 'Product', 'Offer|Product', 'BreadcrumbList', 'Person', '', 'Organization|Thing|WebSite', 'Event|Place'][i % 9 + 1] as jsonld_types,
  case i % 8 when 0 then null when 1 then 'Only a title' else 'T ' || i end as og_title, case when i % 8 > 1 then 'D' end as og_description,
  case when i % 8 > 1 then 'https://site.example/img/' || i % 40 || '.png' end as og_image, case when i % 8 > 1 then 'https://site.example/og' end as og_url,
  case when i % 6 < 3 then 'summary' end as twitter_card, case when i % 6 < 3 then 'TT' end as twitter_title, null::varchar as twitter_description, case when i % 6 < 3 then 'https://site.example/img/t' || i % 30 || '.png' end as twitter_image,
  ((i % 6 > 0)::int * 3 + i % 4 + case i % 3 when 0 then 20 else 70 end + 3)::bigint as word_count, case i % 3 when 1 then 'en' when 2 then 'de' end as detected_lang,
  (4 - (i in (0, 1))::int)::bigint as links from n)"""

_HREFLANGS = f"""h as (
  select i, 0 as pos, 'en' as lang, {_AT} as href from n where i % 5 in (0, 1) union all select i, 1, 'de', {_NEXT} from n where i % 5 = 0 union all select i, 2, 'x-default', 'https://site.example/p/0' from n where i % 5 = 0
  union all select i, 1, 'en', {SITE.format("(i + 2)")} from n where i % 5 = 1 union all select i, 2, 'xx', {SITE.format("(i + 3)")} from n where i % 5 = 1
  union all select i, 0, 'de', {_NEXT} from n where i % 5 = 2)"""

#: Findings about JSON-LD by the kind of script that a document has.
_JSONLD = """
  select i as page_idx, 'jsonld_product_name_missing' as code, 'warning' as severity from n where i % 9 = 2 union all select i, 'jsonld_product_offer_rating_missing', 'warning' from n where i % 9 = 2
  union all select i, 'jsonld_breadcrumb_items_missing', 'warning' from n where i % 9 = 4 union all select i, 'jsonld_context_missing', 'info' from n where i % 9 in (5, 8) union all select i, 'jsonld_type_missing', 'info' from n where i % 9 = 6"""

#: Rule, severity, condition over the facts.
_RULES = (
    ("title_missing", "error", "title = ''"), ("title_short", "info", "length(title) between 1 and 19"), ("title_long", "info", "length(title) > 60"),
    ("description_missing", "warning", "description = ''"), ("description_short", "info", "length(description) between 1 and 69"), ("description_long", "info", "length(description) > 160"),
    ("canonical_missing", "warning", "i % 23 = 2"), ("canonical_multiple", "error", "i % 23 = 3"), ("canonical_invalid", "error", "i % 23 = 6"), ("canonical_other", "info", "i % 23 between 7 and 9"),
    ("html_lang_missing", "warning", "lang is null"), ("html_lang_content_mismatch", "warning", "lang[:2] <> detected_lang"), ("robots_noindex", "info", "robots is not null"),
    ("h1_missing", "info", "i % 6 = 0"), ("h1_multiple", "info", "i % 6 = 1"), ("image_alt_missing", "warning", "images_missing_alt > 0"), ("content_thin", "info", "word_count < 50"),
    ("og_title_missing", "info", "og_title is null"), ("og_description_missing", "info", "og_description is null"), ("og_image_missing", "info", "og_image is null"), ("twitter_card_missing", "info", "twitter_card is null"),
    ("jsonld_invalid", "error", "jsonld_invalid > 0"), ("hreflang_duplicate_code", "warning", "i % 5 = 1"), ("hreflang_code_suspicious", "warning", "i % 5 = 1"), ("hreflang_self_missing", "warning", "i % 5 = 2"),
    ("html_lang_hreflang_mismatch", "info", "i % 5 < 2 and lang[:2] <> 'en'"),
)

#: Visible text of the real pages: that of the article, whose only hidden parts are marks.
_ENTITIES = "replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
_STRIPPED = _ENTITIES.format(x="regexp_replace({x}, '<[^>]*>', ' ', 'g')")
_WORD = r"'[\p{L}\p{N}]+(?:[''’\-][\p{L}\p{N}]+)*'"
_TITLE = _ENTITIES.format(x="trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g'))")
_SEEN = f"""v as (
  select page_id, html, {_STRIPPED.format(x="article")} as shown, {_STRIPPED.format(x="regexp_replace(article, '(?s)<h[1-6]>.*?</h[1-6]>', ' ', 'g')")} as plain
  from (select page_id, html, regexp_extract(html, '(?s)<article[^>]*>(.*)</article>', 1) as article from pages)),
w as (select *, len(regexp_extract_all(shown, {_WORD}))::bigint as word_count, len(regexp_extract_all(plain, {_WORD}))::bigint as fingerprint_words from v)"""
_NO_PAGE = r"'(?i)\.(jpg|jpeg|png|gif|webp|svg|avif|ico|pdf|zip|rar|7z|gz|mp4|mp3|wav|mov|avi|webm|css|js|mjs|xml|json|txt|woff2?|ttf|eot)($|\?)'"


def sql(language) -> dict[str, str]:
    """`language`: the SQL that gives `lang` (doc_id, detected_lang) of a relation (doc_id, text)."""
    answers = "a as (select x.j, x.t, 'https://site.example/img/' || case when t = 1 then 't' else '' end || j || '.png' as url from (select i as j, unnest([0, 1]) as t from n where i < 40) x where t = 0 or j < 30)"
    said = """case j % 5 when 1 then ' answers with status 404: ' when 2 then ' redirects: ' when 3 then ' cannot be reached: ' else ' is not an image: ' end"""
    images = "g as (select i, 0 as k, og_image as url from t where og_image is not null union all select i, 1, twitter_image from t where twitter_image is not null)"
    page_rules = [
        ("title_missing", "error", "length(title) = 0"), ("title_short", "info", "length(title) between 1 and 19"), ("title_long", "info", "length(title) > 60"), ("description_missing", "warning", "true"), ("canonical_missing", "warning", "true"),
        ("html_lang_missing", "warning", "coalesce(lang, '') = ''"), ("html_lang_content_mismatch", "warning", "lower(split_part(lang, '-', 1)) <> detected_lang"), ("h1_missing", "info", "h1 = 0"), ("h1_multiple", "info", "h1 > 1"),
        ("content_thin", "info", "word_count between 1 and 49"), ("og_title_missing", "info", "true"), ("og_description_missing", "info", "true"), ("og_image_missing", "info", "true"), ("twitter_card_missing", "info", "true"),
    ]
    facts = f"""pf as (select page_id, {_TITLE} as title, regexp_extract(html, '<html lang="([^"]*)"', 1) as lang, len(regexp_extract_all(html, '<h1>')) as h1, word_count from w)"""
    return {
        "html_extract": f"{_FACTS} select i as page_idx, * exclude i from t",
        "html_links": f"""with n as (select page_id as i from pages) select i as page_idx, {_NEXT} as href, 'Next »' as text, 'navigation' as location from n
          union all select i, 'https://elsewhere.example/?a=1&b=2', 'Else', 'navigation' from n union all select i, {SITE.format("(2 * i)")}, 'twice', 'contextual' from n union all select i, 'https://site.example/p/0', 'Home', 'footer' from n""",
        "html_hreflangs": f"with n as (select page_id as i from pages), {_HREFLANGS} select i as page_idx, pos::bigint as pos, lang, href, 'html' as source from h",
        "html_rule_issues": f"{_FACTS} " + " union all ".join(f"select i as page_idx, '{code}' as code, '{severity}' as severity from t where {when}" for code, severity, when in _RULES) + f" union all {_JSONLD}",
        "jsonld_findings": f"with n as (select page_id as i from pages) {_JSONLD}",
        "http_link_hreflangs": f"""with n as (select page_id as i from pages) select i as page_idx, 0::bigint as pos, 'en' as lang, {_AT} as href, 'http-header' as source from n where i % 5 = 1
          union all select i, 1, 'de', {_NEXT}, 'http-header' from n where i % 5 = 1 union all select i, 0, 'fr', 'https://site.example/a', 'http-header' from n where i % 5 = 3
          union all select i, 1, 'x-default', 'https://site.example/c', 'http-header' from n where i % 5 = 4""",
        "sitemap_parse": f"""with n as (select page_id as i, 'https://site.example/sitemaps/' || page_id || '.xml' as url from pages)
          select url, 'index' as kind, 0::bigint as pos, 'https://site.example/sitemaps/' || (i + 1) || '.xml' as loc, 'https://site.example/sitemaps/' || (i + 1) || '.xml' as loc_key, null::varchar as lang, null::varchar as href from n where i % 7 = 0
          union all select url, 'invalid', null, null, null, null, null from n where i % 7 in (1, 2) union all select url, 'urlset', null, null, null, null, null from n where i % 7 = 3
          union all select url, 'urlset', 0, '/p/' || i, {_AT}, null, null from n where i % 7 = 4 union all select url, 'urlset', 0, '/p/' || i, {_AT}, 'de', {_NEXT} from n where i % 7 = 4
          union all select url, 'urlset', 0, {_AT} || '?utm_source=s', {_AT}, null, null from n where i % 7 > 4 union all select url, 'urlset', 3, '/p/' || (i + 2), {SITE.format("(i + 2)")}, null, null from n where i % 7 > 4""",
        "sitemap_locations": f"""with n as (select page_id as i from pages), l as (select i * 10 as pos, case when i % 7 = 4 then '/p/' || i else {_AT} || '?utm_source=s' end as loc, {_AT} as url_key from n where i % 7 >= 4
          union all select i * 10 + 3, '/p/' || (i + 2), {SITE.format("(i + 2)")} from n where i % 7 > 4) select url_key, min(pos)::bigint as pos, arg_max(loc, pos) as url from l group by 1""",
        "social_images": f"""{_FACTS}, {answers}, {images}, m as (select i as page_idx, j, case k when 0 then 'og:image' else 'twitter:image' end || {said} || url as message from g join a using (url) where j % 5 > 0)
          select page_idx, case j % 5 when 1 then 'social_image_http_error' when 2 then 'social_image_redirect' when 3 then 'social_image_unreachable' else 'social_image_content_type' end as code, case j % 5 when 2 then 'info' else 'warning' end as severity, message from m""",
        "social_image_coverage": f"""{_FACTS}, {images}, u as (select url, min((i, k)) as place from g group by 1), c as (select url from u order by place limit 75)
          select (select count(*) from u) as discovered, (select count(*) from c) as checked, (select min(url) from c) as first_url""",
        "visible_word_count": f"with {_SEEN} select page_id as page_idx, word_count, fingerprint_words, sha256(regexp_replace(plain, '\\s+', '', 'g')) as text_sha256 from w",
        "content_hash_status": f"with {_SEEN} select case when fingerprint_words >= 80 then 'available' else 'not generated (' || fingerprint_words || ' fingerprint words; minimum 80)' end as content_hash_status, count(*) as pages from w group by 1",
        "page_facts": f"""with {_SEEN}, f as (select *, {_TITLE} as title from w)
          select page_id as page_idx, title, nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') as lang, len(regexp_extract_all(html, '<h1>'))::int as h1_count, len(regexp_extract_all(html, '<img'))::int as images_total, 0 as jsonld_scripts, 0 as canonical_count,
            len(list_distinct(list_filter(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda x: not regexp_matches(x, {_NO_PAGE}))))::bigint as links, sha256(title) as title_hash, word_count from f""",
        "page_issue_counts": f"with {_SEEN}, {facts}, txt as (select page_id as doc_id, shown as text from w), {language('txt').strip()}, k as (select pf.*, detected_lang from pf join lang on page_id = doc_id), j as ("
        + " union all ".join(f"select '{code}' as code, '{severity}' as severity from k where {when}" for code, severity, when in page_rules)
        + ") select code, severity, count(*) as pages from j group by 1, 2",
    }
