"""Site relations derived from the `pages` table by integer arithmetic on page_id.

The table has neither statuses nor link targets nor alternates that meet, so audits over it would be
trivial. The same SQL text gives these relations in Spark and, for the oracle, in DuckDB: it keeps to what
both understand. Page 0 is the root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

URL = "concat('https://site.example/p/', cast({} as string))"

BASE = f"""
select page_id as page_idx, {URL.format("page_id")} as url, {URL.format("page_id")} as url_key, n,
       case when page_id % 19 = 7 then 404 when page_id % 41 = 3 then 503 when page_id % 53 = 9 then 0 else 200 end as status,
       case when page_id % 13 = 4 then 'noindex,follow' end as robots,
       case when page_id % 29 = 8 then 'googlebot: noindex' end as x_robots,
       page_id % 37 <> 6 as robots_allowed,
       case when page_id % 23 = 2 then null
            when page_id % 43 = 5 then concat('https://www.site.example/p/', cast(page_id as string))
            when page_id % 7 = 3 then {URL.format("(page_id * 3 + 1) % n")}
            else {URL.format("page_id")} end as canonical,
       regexp_extract(html, '<html lang="([^"]*)"', 1) as lang,
       regexp_extract(html, '<title>([^<]*)</title>', 1) as title,
       case when page_id % 6 = 0 then '' when page_id % 6 = 1 then concat('About part ', cast(page_id % 10 as string)) else concat('Page ', cast(page_id as string), ' of the site') end as description,
       case when page_id % 5 = 4 then concat('hash ', cast(page_id % 30 as string)) else concat('own ', cast(page_id as string)) end as content_hash,
       page_id % 5 <> 2 as in_sitemap
from {{pages}} cross join (select count(*) as n from {{pages}}) t
"""

PAGES = f"select *, canonical as canonical_key from ({BASE}) b"

LINK_IDS = """
select src, dst, min(k) as pos from (
  select page_id as src, page_id * 3 + k as dst, k from {pages} cross join (values (1), (2), (3)) v(k) where (page_id * 3 + k) % 10 <> 0
  union all select page_id, cast(floor(page_id / 5) as bigint), 4 from {pages} where page_id % 4 = 0
  union all select page_id, page_id, 5 from {pages} where page_id % 17 = 0
) l where dst < (select count(*) from {pages}) group by src, dst
"""

LINKS = f"""
select src as page_idx, pos, case when (src + dst) % 11 = 0 then concat('http://site.example/p/', cast(dst as string)) else {URL.format("dst")} end as href,
       {URL.format("dst")} as dst, (src + dst) % 4 <> 0 as contextual
from ({LINK_IDS}) x
union all
select page_id, cast(6 as bigint), concat('https://site.example/gone/', cast(page_id % 40 as string)), concat('https://site.example/gone/', cast(page_id % 40 as string)), true
from {{pages}} where page_id % 3 = 1
"""

REDIRECT_HOPS = f"""
select {URL.format("page_id")} as from_key, {URL.format("page_id + 1")} as to_key from {{pages}} where page_id % 11 = 5 and page_id + 1 < (select count(*) from {{pages}})
union all
select {URL.format("page_id")}, {URL.format("page_id + 2")} from {{pages}} where page_id % 22 = 6 and page_id + 2 < (select count(*) from {{pages}})
"""

REDIRECTS = f"""
select a.from_key, coalesce(b.to_key, a.to_key) as final_key, coalesce(b.to_key, a.to_key) as final_url, case when b.to_key is null then 1 else 2 end as hops
from ({REDIRECT_HOPS}) a left join ({REDIRECT_HOPS}) b on a.to_key = b.from_key
"""

CHECKS = """
select distinct concat('https://site.example/gone/', cast(page_id % 40 as string)) as url_key, case when page_id % 40 % 3 = 0 then 404 when page_id % 40 % 3 = 1 then 410 else 200 end as status
from {pages} where page_id % 3 = 1
"""

HREFLANGS = f"""
select s.page_id as page_idx, cast(d.page_id % 4 as bigint) as pos, case d.page_id % 4 when 0 then 'en' when 1 then 'de' when 2 then 'fr' else 'es' end as lang,
       {URL.format("d.page_id")} as href, {URL.format("d.page_id")} as href_key, 'html' as source
from {{pages}} s join {{pages}} d on floor(s.page_id / 4) = floor(d.page_id / 4) where (s.page_id + d.page_id) % 9 <> 1
union all
select page_id, cast(9 as bigint), 'de', {URL.format("page_id + 40")}, {URL.format("page_id + 40")}, 'http-header' from {{pages}} where page_id % 31 = 5
"""

SITEMAP = f"select page_id as pos, {URL.format('page_id')} as url, {URL.format('page_id')} as url_key from {{pages}} where page_id % 5 <> 2"
FULL_SITEMAP = f"select page_id as pos, {URL.format('page_id')} as url, {URL.format('page_id')} as url_key from {{pages}}"

CODES = """
select page_id as page_idx,
       concat(concat(chr(cast(97 + page_id % 26 as int)), chr(cast(97 + cast(floor(page_id / 26) as bigint) % 26 as int))),
              case page_id % 7 when 1 then '-us' when 2 then '-xx' when 3 then '-hans' else '' end) as code from {pages}
union all select page_id, case page_id % 4 when 0 then 'zh-hans' when 1 then 'zh-hant-tw' when 2 then 'x-default' else 'zh-hans-xx' end from {pages} where page_id % 10 = 0
"""

ISSUES = """
select page_idx, url, 1 as stage, cast(0 as bigint) as seq, 'title_short' as code, 'info' as severity, concat('The title has ', cast(length(title) as string), ' characters.') as message, false as expected from ({page}) a where length(title) < 30
union all select page_idx, url, 1, cast(1 as bigint), 'description_missing', 'warning', 'The page has no meta description.', false from ({page}) a where description = ''
union all select page_idx, url, 1, cast(2 as bigint), 'canonical_other', 'info', 'The canonical URL is another one.', false from ({page}) a where canonical <> url
union all select page_idx, url, 1, cast(3 as bigint), 'robots_noindex', 'info', 'Meta robots says noindex.', false from ({page}) a where robots is not null
union all select page_idx, url, 2, cast(0 as bigint), 'http_error', 'error', concat('The page answers with status ', cast(status as string), '.'), false from ({page}) a where status >= 400
union all select page_idx, url, 2, cast(1 as bigint), 'fetch_failed', 'error', 'The page could not be fetched.', false from ({page}) a where status = 0
union all select page_idx, url, 1, cast(4 as bigint), 'og_title_missing', 'info', 'There is no og:title.', false from ({page}) a
union all select page_idx, url, 7, cast(0 as bigint), 'broken_internal_link', 'error', 'A link is broken.', page_idx % 2 = 0 from ({page}) a where page_idx % 12 = 5
"""
ISSUES = ISSUES.replace("{page}", PAGES)

#: Documents made by rule, so that what they say is known without parsing them: the SQL of their queries counts residues, not tags.
_JSONLD = "translate('{}', '<>', concat(chr(123), chr(125)))"  # braces mean parameters in these texts
_SCRIPT = """concat('<script type="application/ld+json">', {}, '</script>')"""


def _ld(body: str) -> str:
    return _SCRIPT.format(_JSONLD.format(body))


RICH = f"""
select page_id as page_idx, {URL.format("page_id")} as url, {URL.format("page_id")} as url_key, concat(
  case when page_id % 9 = 4 then '<html><head>' else concat('<html lang="', case page_id % 4 when 0 then 'en' when 1 then 'de-AT' when 2 then 'fr' else ' es ' end, '"><head>') end,
  case page_id % 12 when 5 then '' when 7 then '<title> </title>' when 1 then concat('<TITLE>Tiny &amp; ', cast(page_id as string), '</TITLE>')
    when 2 then concat('<title>', repeat('long words ', 7), cast(page_id as string), '</title><title>second</title>') else concat('<title>A page title of usual  length ', cast(page_id as string), chr(10), '</title>') end,
  case page_id % 10 when 0 then '' when 1 then '<meta name="Description" content=" Short. ">' when 2 then concat('<meta name="description" content="', repeat('far too long ', 14), '">')
    else concat('<meta content="', repeat('a fitting line ', 6), cast(page_id as string), '" name="description">') end,
  case when page_id % 13 = 4 then '<meta name="robots" content="NoIndex, follow">' else '' end,
  case when page_id % 23 = 2 then '' when page_id % 23 = 3 then concat('<link rel="canonical" href="/p/', cast(page_id as string), '"><link rel="canonical" href="/other">')
    when page_id % 23 = 5 then '<link rel="canonical" href="">' when page_id % 23 = 6 then '<link rel="canonical" href="javascript:void(0)">'
    when page_id % 23 between 7 and 9 then concat('<link rel="nofollow Canonical" href="', cast(page_id + 1 as string), '">') else concat('<link rel="canonical" href="?utm_source=x#top">') end,
  case page_id % 5 when 0 then concat('<link rel="alternate" hreflang="EN" href=""><link rel="alternate" hreflang="en" href="/p/', cast(page_id as string), '"><link rel="alternate" hreflang="de" href="/p/', cast(page_id + 1 as string), '"><link rel="alternate" hreflang="x-default" href="/p/0">')
    when 1 then concat('<link rel="alternate" hreflang="en" href="', cast(page_id as string), '"><link rel="alternate" hreflang="en" href="/p/', cast(page_id + 2 as string), '"><link rel="alternate" hreflang="xx" href="/p/', cast(page_id + 3 as string), '">')
    when 2 then concat('<link rel="alternate" hreflang="de" href="/p/', cast(page_id + 1 as string), '">') else '<link rel="alternate" href="/feed">' end,
  case page_id % 8 when 0 then '' when 1 then '<meta property="og:title" content="Only a title">'
    else concat('<meta property="og:title" content="T ', cast(page_id as string), '"><meta property="og:description" content="D"><meta property="og:image" content="/img/', cast(page_id % 40 as string), '.png"><meta property="og:url" content="/og">') end,
  case when page_id % 6 < 3 then concat('<meta name="twitter:card" content="summary"><meta name="twitter:title" content="TT"><meta name="twitter:image" content="/img/t', cast(page_id % 30 as string), '.png">') else '' end,
  case page_id % 9 when 1 then {_ld('<"a":')} when 2 then {_ld('<"@context":"https://schema.org","@type":"Product","sku":"1">')} when 3 then {_ld('<"@context":"https://schema.org","@type":"Product","name":"n","offers":<"@type":"Offer">>')}
    when 4 then {_ld('<"@context":"https://schema.org","@type":"BreadcrumbList">')} when 5 then {_ld('<"@type":"Person","name":"n">')} when 6 then {_ld('<"@context":"https://schema.org","name":"n">')}
    when 7 then concat({_ld('<"@context":"https://schema.org","@graph":[<"@type":"Organization">,<"@type":["WebSite","Thing"]>]>')}, {_ld('[1,')}) when 8 then {_ld('[<"@context":"https://schema.org","@type":"Event">,<"@type":"Place">]')} else '' end,
  '</head><body><nav><a href="/p/', cast(page_id + 1 as string), '">Next &raquo;</a><a href="https://elsewhere.example/?b=2&amp;a=1">Else</a><a href="mailto:a@b.example">Mail</a></nav><main>',
  case page_id % 6 when 0 then '' when 1 then concat('<h1>First</h1><h1>Second <b>', cast(page_id as string), '</b></h1>') else concat('<h1> Heading <b>no</b> ', cast(page_id as string), '</h1>') end,
  repeat('<h2>Part</h2>', cast(page_id % 4 as int)), '<script>var hidden = 1;</script><style>b</style><p>',
  case page_id % 3 when 0 then repeat('some words ', 10) when 1 then repeat('the and to of in is for on with that ', 7) else repeat('der die das und ist zu den von mit von ', 7) end,
  '<a href="', cast(page_id * 2 as string), '#part">twice</a> <a href="/p/', cast(page_id * 2 as string), '">again</a> <a href="/file.pdf">file</a></p>',
  case when page_id % 7 > 0 then '<img src="/0.png" alt="x">' else '' end, case when page_id % 7 > 1 then '<img src="/1.png">' else '' end, case when page_id % 7 > 2 then '<img src="/2.png" alt=" ">' else '' end,
  case when page_id % 7 > 3 then '<img src="/3.png" alt="x">' else '' end, case when page_id % 7 > 4 then '<img src="/4.png">' else '' end, case when page_id % 7 > 5 then '<img src="/5.png" alt="">' else '' end,
  '</main><footer>Small print <a href="/p/0">Home</a></footer></body></html>') as html
from {{pages}}
"""

LINK_HEADERS = f"""
select page_id as page_idx, {URL.format("page_id")} as url,
  case page_id % 5 when 0 then null when 1 then concat('</p/', cast(page_id as string), '>; rel="alternate"; hreflang="EN", <https://site.example/p/', cast(page_id + 1 as string), '?utm_medium=x>; rel=alternate; hreflang=de')
    when 2 then '</style.css>; rel="preload"; as="style"' when 3 then '</a>; hreflang="fr"; rel="alternate nofollow", </b>; rel="alternate"' else concat('<', cast(page_id + 2 as string), '>; rel="canonical", </c>; rel="Alternate"; hreflang="x-default"') end as link_header
from {{pages}}
"""

SITEMAP_BODIES = f"""
select concat('https://site.example/sitemaps/', cast(page_id as string), '.xml') as url, cast(case page_id % 7
  when 0 then concat('<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>https://site.example/sitemaps/', cast(page_id + 1 as string), '.xml</loc></sitemap></sitemapindex>')
  when 1 then '<urlset><url><loc>broken' when 2 then '<feed><url><loc>https://site.example/</loc></url></feed>' when 3 then '<urlset></urlset>'
  when 4 then concat('<urlset xmlns:xhtml="http://www.w3.org/1999/xhtml"><url><loc> /p/', cast(page_id as string), ' </loc><xhtml:link rel="alternate" hreflang="DE" href="/p/', cast(page_id + 1 as string), '"/><xhtml:link rel="stylesheet" hreflang="fr" href="/x"/></url></urlset>')
  else concat('<?xml version="1.0"?><urlset><url><loc>https://site.example/p/', cast(page_id as string), '?utm_source=s</loc></url><url><lastmod>2024-01-01</lastmod></url><url><loc>mailto:x@y.example</loc></url><url><loc>/p/', cast(page_id + 2 as string), '</loc></url></urlset>') end as {{binary}}) as body
from {{pages}}
"""

IMAGE_ANSWERS = """
select concat(concat('https://site.example/img/', case when k.t = 1 then 't' else '' end), concat(cast(n.page_id as string), '.png')) as url,
  case n.page_id % 5 when 0 then 200 when 1 then 404 when 2 then 301 when 3 then 0 else 200 end as status, case when n.page_id % 5 = 4 then 'text/html' when n.page_id % 5 = 3 then null else 'Image/PNG' end as content_type
from (select page_id from {pages} where page_id < 40) n cross join (values (0), (1)) k(t) where k.t = 0 or n.page_id < 30
"""

SITES = """
select page_id as site, concat(case when page_id % 2 = 0 then 'https' else 'http' end, '://', case when page_id % 3 = 0 then 'www.' else '' end, case when page_id % 7 = 5 then '8.8.8.8' else concat('s', cast(page_id as string), '.example') end, '/start') as start_url,
  concat(case when page_id % 5 < 4 then 'https' else 'http' end, '://', case when page_id % 4 = 0 and page_id % 7 <> 5 then 'www.' else '' end, case when page_id % 7 = 5 then '8.8.8.8' else concat('s', cast(page_id as string), '.example') end) as preferred_origin
from {pages}
"""

ORIGIN_ANSWERS = """
select concat(x.scheme, '://', x.www, 's', cast(page_id as string), '.example/') as url, case when page_id % 6 = 1 then 0 when page_id % 6 = 2 then 404 else 200 end as status,
  concat(case when page_id % 6 < 4 then 'https' else x.scheme end, '://', case when page_id % 6 < 4 then '' else x.www end, 's', cast(page_id as string), '.example/') as final_url,
  case when page_id % 6 < 4 and concat(x.scheme, x.www) <> 'https' then 1 else 0 end as hops
from {pages} cross join (values ('https', ''), ('http', ''), ('https', 'www.'), ('http', 'www.')) x(scheme, www) where page_id % 11 > 0
"""

IMAGE_HEADS = """
select page_id as page_idx, case page_id % 3 when 0 then unhex(concat('89504E470D0A1A0A0000000D49484452', lpad(hex(page_id + 1), 8, '0'), lpad(hex(page_id * 2 + 3), 8, '0')))
  when 1 then unhex(concat('474946383961', lpad(hex(page_id % 200 + 1), 2, '0'), '01', '0A00')) else unhex('FFD8FF') end as head from {pages}
"""

HREFS = """
select page_id as page_idx, concat('https://site.example/a/b', cast(page_id as string)) as base,
  case page_id % 12 when 0 then '/x' when 1 then '?q=1' when 2 then '#part' when 3 then '../up' when 4 then '//other.example/y' when 5 then 'mailto:a@b.example' when 6 then 'HTTP://UP.example:80/Z' when 7 then ' ' when 8 then 'c?b=2&a=1&utm_campaign=x'
    when 9 then 'ftp://site.example/' when 10 then 'http://site.example:8080' else 'javascript:void(0)' end as href from {pages}
"""

TARGETS = """
select page_id as page_idx, case page_id % 12 when 0 then 'https://site.example/' when 1 then concat('http://10.0.0.', cast(page_id % 250 as string), '/') when 2 then 'http://127.0.0.1/' when 3 then 'https://8.8.8.8/' when 4 then 'http://[::1]/' when 5 then 'https://user:pass@site.example/'
  when 6 then 'http://localhost/' when 7 then 'https://printer.local/' when 8 then concat('http://192.168.1.', cast(page_id % 250 as string)) when 9 then 'ftp://site.example/' when 10 then 'http://169.254.1.1/' else 'https://sub.site.example:8443/x' end as url from {pages}
"""

REQUESTS = """
select page_id as page_idx, case page_id % 7 when 0 then 'site.example' when 1 then ' HTTPS://Site.example/ ' when 2 then '' when 3 then repeat('a', 2049) when 4 then null else 'http://site.example' end as url,
  cast(case page_id % 5 when 0 then null when 1 then 0 when 2 then 1001 else page_id % 1000 + 1 end as int) as max_pages, case page_id % 4 when 0 then null when 1 then 'staging' when 2 then 'test' else 'live' end as environment from {pages}
"""

#: Two audits of one site: what the second one lost, gained and changed follows from the residues.
PREVIOUS_PAGES = f"select page_idx, url, status, robots_allowed, case when page_idx % 8 = 1 then 'not-indexable' else 'indexable' end as indexability, canonical, title, description, array(title) as h1 from ({PAGES}) p where page_idx % 10 <> 1"
CURRENT_PAGES = f"""select page_idx, url, status, robots_allowed, case when page_idx % 16 = 1 then 'not-indexable' else 'indexable' end as indexability,
  case when page_idx % 14 = 2 then null else canonical end as canonical, case when page_idx % 15 = 3 then concat(title, '!') else title end as title,
  case when page_idx % 18 = 4 then 'new' else description end as description, array(case when page_idx % 15 = 8 then 'other' else title end) as h1
  from ({PAGES}) p where page_idx % 10 <> 6"""
PREVIOUS_ISSUES = f"select * from ({ISSUES}) i where page_idx % 10 <> 1 and not (code = 'description_missing' and page_idx % 4 = 2)"
CURRENT_ISSUES = f"""select page_idx, url, stage, seq, code, case when code = 'http_error' and page_idx % 2 = 0 then 'warning' else severity end as severity, message, expected
  from ({ISSUES}) i where page_idx % 10 <> 6 and not (code = 'og_title_missing' and page_idx % 3 = 0)
  union all select cast(null as bigint), 'https://site.example', 9, cast(0 as bigint), 'canonical_origin_conflict', 'warning', 'Canonicals prefer another origin.', false"""

RUNS = """
select concat('run-', cast(event_id as string)) as id, concat('https://', case when user_id % 3 = 0 then 'www.' else '' end, 'site', cast(user_id as string), '.example/', cast(event_id % 5 as string)) as url,
       case when event_type in ('error', 'view') then 'staging' else 'live' end as environment, cast(event_id % 1000 + 1 as int) as max_pages,
       case event_id % 9 when 0 then 'queued' when 1 then 'running' when 2 then 'failed' else 'completed' end as status,
       ts as created_at, ts + interval '7' day as expires_at
from {events}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A relation of this module as a DataFrame over the tables in `sf_dir`."""
    names = {n: table(spark, sf_dir, n) for n in ("pages", "events") if "{" + n + "}" in sql}
    return spark.sql(sql.replace("{binary}", "binary"), **names)


def duck(sql: str) -> str:
    return sql.format(pages="pages", events="events", binary="blob").replace("array(", "list_value(")
