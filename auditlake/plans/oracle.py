"""DuckDB SQL for the catalog's queries, written from the rules over the tables and the derived relations."""

from __future__ import annotations

from auditlake.functions.text import LANGUAGES, STOPWORDS, countries
from auditlake.plans import derived as d
from auditlake.plans import oracle_pages


def _noindex(*columns: str) -> str:
    return "(" + " or ".join(rf"list_contains(regexp_split_to_array(lower(coalesce({c}, '')), '[\s,;:]+'), 'noindex')" for c in columns) + ")"


def _list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_RELATIONS = {
    "pg": d.PAGES, "lk": d.LINKS, "rd": d.REDIRECTS, "hop": d.REDIRECT_HOPS, "ck": d.CHECKS, "hr": d.HREFLANGS, "sm": d.SITEMAP, "fs": d.FULL_SITEMAP, "cd": d.CODES, "iss": d.ISSUES,
    "pp": d.PREVIOUS_PAGES, "cp": d.CURRENT_PAGES, "pi": d.PREVIOUS_ISSUES, "ci": d.CURRENT_ISSUES, "runs": d.RUNS,
}

_ENTITIES = "replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
_TITLE = _ENTITIES.format(x="trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g'))")
_EFF = "eff as (select lk.*, coalesce(rd.final_key, lk.dst) as eff, rd.hops from lk left join rd on lk.dst = rd.from_key)"
_DEGREE = """
once as (select page_idx, eff, max(contextual::int) as c from eff group by all),
outs as (select page_idx, count(*) as outgoing, sum(c) as contextual_outgoing from once group by 1),
ins as (select pg.page_idx, count(*) as incoming, sum(c) as contextual_incoming from once join pg on once.eff = pg.url_key group by 1),
deg as (select pg.page_idx, coalesce(incoming, 0)::bigint as incoming, coalesce(outgoing, 0)::bigint as outgoing, coalesce(contextual_incoming, 0)::bigint as contextual_incoming, coalesce(contextual_outgoing, 0)::bigint as contextual_outgoing
        from pg left join ins using (page_idx) left join outs using (page_idx))"""
_DEPTH = """
edge as (select distinct eff.page_idx as src, pg.page_idx as dst from eff join pg on eff.eff = pg.url_key),
walk(page_idx, depth) as (select 0::bigint, 0 union select edge.dst, walk.depth + 1 from walk join edge on edge.src = walk.page_idx where walk.depth < (select count(*) from pg)),
dep as (select page_idx, min(depth)::bigint as depth from walk group by 1)"""


def _family(url: str) -> str:
    return f"regexp_replace(lower(regexp_extract({url}, '^https?://([^/?#:]*)', 1)), '^www\\.', '')"


def _index(preferred: str) -> str:
    alias = f"{_family('url')} = {_family('canonical')} and lower(regexp_extract(canonical, '^(https?://[^/?#]*)', 1)) = '{preferred}' and regexp_extract(url, '^https?://[^/]*(.*)', 1) = regexp_extract(canonical, '^https?://[^/]*(.*)', 1)"
    return f"""ix as (select *, case when status = 0 then 'unknown' when status not between 200 and 299 then 'not-indexable' when {_noindex("robots", "x_robots")} then 'not-indexable'
      when canonical <> url and ({alias}) then 'host-alias' when canonical <> url then 'canonicalized' else 'indexable' end as indexability,
      case when status = 0 then 'not fetched' when status not between 200 and 299 then 'status ' || status when {_noindex("robots")} then 'meta robots' when {_noindex("x_robots")} then 'X-Robots-Tag'
      when canonical <> url and ({alias}) then 'preferred host' when canonical <> url then 'canonical elsewhere' else 'nothing against it' end as reason from pg)"""


_SITEMAP = """tg as (
  select s.*, coalesce(rd.final_key, s.url_key) as eff, rd.final_url, pg.page_idx, pg.url as page_url, pg.robots, pg.x_robots, pg.canonical
  from {s} s left join rd on s.url_key = rd.from_key left join pg on coalesce(rd.final_key, s.url_key) = pg.url_key)"""

_WORDS = r"regexp_extract_all(lower(text), '\p{L}+')"


def _language(source: str) -> str:
    scores = ", ".join(
        f"{{'s': {' + '.join(f"least(5, coalesce(list_aggregate(list_transform(w, lambda y: (y = '{x}')::int), 'sum'), 0))" for x in words.split())}, 'r': {-k}, 'l': '{lang}'}}" for k, (lang, words) in enumerate(STOPWORDS.items())
    )
    known = sorted({w for s in STOPWORDS.values() for w in s.split()})
    return f"""
a as (select *, {_WORDS} as all_words from {source}),
b as (select * exclude all_words, len(all_words) as n, list_filter(all_words, lambda x: list_contains([{", ".join(f"'{w}'" for w in known)}], x)) as w from a),
c as (select *, list_reverse_sort([{scores}]) as s from b),
e as (select *, s[1].s as top, s[2].s as second, list_aggregate(list_transform(s, lambda x: x.s), 'sum') as total from c),
f as (select *, case when total > 0 then top / total else 0.0 end as share from e),
lang as (select doc_id, case when n >= 60 and top >= 8 and not (second > 0 and top < second * 1.6) and share >= 0.39 then s[1].l end as detected_lang,
         case when n >= 60 then round(share, 3) else 0.0 end as confidence from f)"""


def _hkey(url: str) -> str:
    return url  # the derived addresses have this form already


def _diff_map(rel: str, path: bool) -> str:
    key = "case when page_idx is null then 'site' else " + ("regexp_extract(url, '^https?://[^/]*(.*)', 1)" if path else "url") + " end || '|' || code"
    return f"(select {key} as issue_key, arg_max(severity, (coalesce(page_idx, -1), stage, seq)) as severity, arg_max(message, (coalesce(page_idx, -1), stage, seq)) as message, arg_max(url, (coalesce(page_idx, -1), stage, seq)) as url, max(page_idx) as page_idx from {rel} where not expected group by 1)"


def _page_diff(path: bool) -> str:
    key = "regexp_extract(url, '^https?://[^/]*(.*)', 1)" if path else "url"
    canon = "coalesce(regexp_extract({c}, '^https?://[^/]*(.*)', 1), '')" if path else "coalesce({c}, '')"
    parts = ([] if path else ["case when a.indexability <> b.indexability then 'indexability' end"]) + [
        f"case when {canon.format(c='a.canonical')} <> {canon.format(c='b.canonical')} then 'canonical' end", "case when coalesce(a.title, '') <> coalesce(b.title, '') then 'title' end",
        "case when coalesce(a.description, '') <> coalesce(b.description, '') then 'description' end", "case when array_to_string(a.h1, ' | ') <> array_to_string(b.h1, ' | ') then 'h1' end",
    ]
    return f"""dp as (select coalesce(a.k, b.k) as key, a.url as previous_url, coalesce(b.url, a.url) as url, a.k is null as is_new, b.k is null as is_gone, concat_ws(',', {", ".join(parts)}) as fields
      from (select *, {key} as k from pp) a full join (select *, {key} as k from cp) b on a.k = b.k),
    dpc as (select key, case when is_new then 'new' when is_gone then 'removed' else 'changed' end as change, url, previous_url, case when is_new or is_gone then null else fields end as fields from dp where is_new or is_gone or fields <> '')"""


_CATEGORY = """case when regexp_matches(code, '^(title_|description_)') then 'metadata' when regexp_matches(code, '^(og_|twitter_|social_)') then 'social' when regexp_matches(code, '^(hreflang_|html_lang_)') then 'multilingual'
 when code like 'canonical\\_%' escape '\\' then 'canonical' when code like 'jsonld\\_%' escape '\\' then 'structured-data' when regexp_matches(code, '^(internal_link_|broken_internal_|mixed_scheme_)') then 'internal-links'
 when code like 'image\\_%' escape '\\' then 'images' when regexp_matches(code, '^(x_)?robots_') then 'indexability' else 'technical' end"""


def _issue(*checks: tuple[str, str, str, str], source: str) -> str:
    return " union all ".join(f"select page_idx, '{code}' as code, {sev if sev.startswith('case') else repr(sev)} as severity, {msg} as message from {source} where {cond}" for code, sev, msg, cond in checks)


def sql() -> dict[str, str]:
    from auditlake.operators.patterns import PLACES
    from auditlake.plans.catalog import NOW, ROBOTS

    q: dict[str, str] = {}
    key = r"""lower(regexp_extract(url, '^(https?://[^/?#]*)', 1)) || case when regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) = '' then '/' else regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) end
      || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' and not starts_with(lower(x), 'utm_'))), '&'), ''), '')"""
    q["page_title_rules"] = f"""with t as (select page_id as page_idx, {_TITLE} as title from pages)
      select page_idx, 'title_missing' as code, 'error' as severity, 'The page has no title.' as message from t where length(title) = 0
      union all select page_idx, 'title_short', 'info', 'The title has ' || length(title) || ' characters.' from t where length(title) between 1 and 19
      union all select page_idx, 'title_long', 'info', 'The title has ' || length(title) || ' characters.' from t where length(title) > 60"""
    q["page_lang_tally"] = "select lower(regexp_extract(html, '<html lang=\"([^\"]*)\"', 1)) as lang, count(*) as pages from pages group by 1"
    q["url_normalize"] = f"select page_id, {key} as url_key, lower(regexp_extract(url, '^(https?://[^/?#]*)', 1)) as origin from pages"
    q["url_dedup"] = f"select {key} as url_key, max(page_id) as page_idx from pages group by 1"
    q["locale_interleave"] = r"""with l as (select page_id as pos, coalesce(nullif(lower(regexp_extract(url, '^https?://[^/]*/([a-zA-Z]{2}(?:-[a-zA-Z]{2})?)(?:[/?#]|$)', 1)), ''), '_default') as locale from pages)
      select pos, locale, row_number() over (partition by locale order by pos) as turn, min(pos) over (partition by locale) as first_pos from l"""
    q["duplicate_titles"] = "select lower(trim(title)) as title, count(*) as n, count(distinct nullif(lower(split_part(lang, '-', 1)), '')) > 1 as multilingual from pg where trim(title) <> '' group by 1 having count(*) > 1"
    q["duplicate_issues"] = f"""{{with}}, k as (
        select 'title' as kind, page_idx, lower(trim(title)) as dk, lang, canonical from pg where trim(title) <> ''
        union all select 'description', page_idx, lower(trim(description)), lang, canonical from pg where trim(description) <> ''
        union all select 'content', page_idx, content_hash, lang, canonical from pg where status between 200 and 299 and not {_noindex("robots", "x_robots")}),
      g as (select kind, dk, count(*) as n, count(distinct nullif(lower(split_part(lang, '-', 1)), '')) > 1 as multi, count(canonical) = count(*) and count(distinct canonical) = 1 as shared from k group by 1, 2 having count(*) > 1)
      select page_idx, kind || '_duplicate' || case when multi then '_multilingual' else '' end as code,
        case when kind = 'title' and multi then 'info' when kind = 'content' and shared then 'info' else 'warning' end as severity, n || ' pages have the same ' || kind || '.' as message from k join g using (kind, dk)"""
    q["content_hash_groups"] = r"""with w as (select doc_id, text, len(regexp_extract_all(text, '[\p{L}\p{N}]+(?:[''’\-][\p{L}\p{N}]+)*')) as n from documents),
      h as (select doc_id, sha256(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'))) as content_hash from w where n >= 80)
      select content_hash, count(*) as n, min(doc_id) as first_doc from h group by 1 having count(*) > 1"""
    q["doc_word_count"] = r"select doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}]+(?:[''’\-][\p{L}\p{N}]+)*'))::bigint as words from documents"
    q["language_detect"] = f"with {_language('documents')} select * from lang"
    q["lang_mismatch"] = f"with {_language('documents')} select doc_id, documents.lang, detected_lang from lang join documents using (doc_id) where lower(split_part(documents.lang, '-', 1)) <> detected_lang"
    bodies = " union all ".join(f"select '{k}' as site, '{v}' as body".replace("\n", "' || chr(10) || '") for k, v in ROBOTS.items())
    lines = rf"""rb as ({bodies}), ln as (select site, generate_subscripts(string_split(body, chr(10)), 1) as pos, unnest(string_split(body, chr(10))) as raw from rb),
      cl as (select site, pos, trim(regexp_replace(raw, '\s*#.*$', '')) as line from ln),
      fd as (select site, pos, lower(trim(split_part(line, ':', 1))) as field, trim(regexp_replace(line, '^[^:]*:', '')) as value from cl where contains(line, ':')),
      ok as (select *, field = 'user-agent' and coalesce(lag(field) over (partition by site order by pos) <> 'user-agent', true) as opens from fd where field in ('user-agent', 'allow', 'disallow')),
      gr as (select *, sum(opens::int) over (partition by site order by pos) as group_id from ok),
      ag as (select site, group_id, list(lower(value) order by pos) as agents from gr where field = 'user-agent' group by 1, 2),
      ru as (select site, group_id, pos, field as directive, value as pattern from gr where field <> 'user-agent' and not (field = 'disallow' and value = ''))"""
    q["robots_parse"] = f"with {lines} select site, group_id::bigint as group_id, array_to_string(agents, ',') as agents, directive, pattern from ag left join ru using (site, group_id)"
    q["robots_decision"] = rf"""with {lines},
      kd as (select site, group_id, case when len(list_filter(agents, lambda a: a <> '*' and starts_with('googlebot', a))) > 0 then 2 when list_contains(agents, '*') then 1 end as kind from ag),
      rk as (select ru.*, kind, max(kind) over (partition by site) as best from ru join kd using (site, group_id) where kind is not null),
      rx as (select *, '^' || regexp_replace(regexp_replace(regexp_replace(pattern, '\$$', ''), '([.\[\]{{}}()+?^$|\\])', '\\\1', 'g'), '\*+', '.*', 'g') || case when ends_with(pattern, '$') then '$' else '' end as re from rk where kind = best and pattern <> ''),
      p as (select page_id, (page_id % 3)::varchar as site, {key} as u from pages),
      m as (select p.page_id, rx.* from p join rx using (site) where regexp_matches(regexp_replace(p.u, '^https?://[^/]*', ''), re)),
      b as (select page_id, arg_max(directive, (length(replace(pattern, '$', '')), directive = 'allow', -pos)) as directive, arg_max(pattern, (length(replace(pattern, '$', '')), directive = 'allow', -pos)) as pattern from m group by 1)
      select p.page_id, coalesce(directive = 'allow', true) as robots_allowed, directive as matched_directive, pattern as matched_rule from p left join b using (page_id)"""
    langs, lands = _list(LANGUAGES), _list(countries())
    q["hreflang_code_validity"] = f"""select page_idx, code, code = 'x-default' or (split_part(code, '-', 1) in {langs} and (
        length(code) - length(replace(code, '-', '')) = 0
        or (length(code) - length(replace(code, '-', '')) = 1 and ((split_part(code, '-', 1) = 'zh' and split_part(code, '-', 2) in ('hans', 'hant')) or split_part(code, '-', 2) in {lands}))
        or (length(code) - length(replace(code, '-', '')) = 2 and split_part(code, '-', 1) = 'zh' and split_part(code, '-', 2) in ('hans', 'hant') and split_part(code, '-', 3) in {lands}))) as valid from cd"""
    q["link_degree"] = f"{{with}}, {_EFF}, {_DEGREE} select page_idx, incoming, outgoing from deg"
    q["contextual_links"] = f"{{with}}, {_EFF}, {_DEGREE} select page_idx, contextual_incoming, contextual_outgoing from deg"
    q["links_to_redirects"] = f"{{with}}, {_EFF} select page_idx, count(distinct dst) as redirecting, count(distinct case when hops > 1 then dst end) as chains from eff where hops is not null group by 1"
    broken = "bad as (select distinct eff.page_idx, href, case when pg.status >= 400 then pg.status else ck.status end as status from eff left join pg on eff.eff = pg.url_key left join ck on eff.eff = ck.url_key where pg.status >= 400 or ck.status >= 400)"
    q["broken_links"] = f"{{with}}, {_EFF}, {broken} select page_idx, href, status::int as status from bad"
    q["link_issues"] = f"""{{with}}, {_EFF}, {broken},
      r as (select page_idx, count(distinct dst) as n, count(distinct case when hops > 1 then dst end) as c from eff where hops is not null group by 1),
      m as (select page_idx, count(distinct href) as n from eff where starts_with(href, 'http:') group by 1), b as (select page_idx, count(distinct href) as n from bad group by 1)
      select page_idx, 'internal_link_to_redirect' as code, 'warning' as severity, n || ' links go to redirects.' as message from r
      union all select page_idx, 'internal_link_redirect_chain', 'warning', c || ' links go to chains of redirects.' from r where c > 0
      union all select page_idx, 'mixed_scheme_internal_link', 'warning', n || ' links go to another scheme or port of the host.' from m
      union all select page_idx, 'broken_internal_link', 'error', n || ' links are broken.' from b"""
    q["uncrawled_targets"] = """{with}, u as (select * from lk where starts_with(href, 'https:') and dst not in (select url_key from pg) and dst not in (select from_key from rd))
      select min((page_idx, pos))[1] as page_idx, min((page_idx, pos))[2] as pos, dst as url_key, arg_max(href, (page_idx, pos)) as href from u group by dst order by min((page_idx, pos)) limit 50"""
    q["crawl_depth"] = f"{{with recursive}}, {_EFF}, {_DEPTH} select * from dep"
    q["redirect_chains"] = """{with recursive}, f(from_key, cur, hops) as (select from_key, to_key, 1 from hop union all select f.from_key, hop.to_key, f.hops + 1 from f join hop on f.cur = hop.from_key where f.hops < 5)
      select from_key, arg_max(cur, hops) as final_key, max(hops)::bigint as hops, max(hops) < 5 as complete from f group by 1"""
    q["canonical_checks"] = f"""{{with}}, j as (select a.page_idx, b.status, b.robots, b.x_robots, b.canonical as c2, a.canonical from pg a join pg b on a.canonical = b.url_key where a.canonical <> a.url_key)
      select page_idx, 'canonical_target_error' as code, 'error' as severity, 'The canonical URL answers with status ' || status || '.' as message from j where status >= 400
      union all select page_idx, 'canonical_target_noindex', 'warning', 'The canonical URL is noindex.' from j where {_noindex("robots", "x_robots")}
      union all select page_idx, 'canonical_chain', 'warning', 'The canonical URL names another one: ' || c2 || '.' from j where c2 <> canonical"""
    q["hreflang_reciprocity"] = f"""{{with}}, j as (select hr.page_idx, hr.href, hr.lang as declared, p.url_key as own, t.* exclude (page_idx) , t.page_idx as tp from hr join pg p using (page_idx) join pg t on hr.href_key = t.url_key where hr.href_key <> p.url_key),
      k as (select j.*, exists (select 1 from hr h where h.page_idx = j.tp and h.href_key = j.own) as back, status >= 400 as err from j)
      select distinct * from (
      select page_idx, 'hreflang_target_error' as code, 'error' as severity, 'The alternate ' || href || ' answers with status ' || status || '.' as message from k where err
      union all select page_idx, 'hreflang_target_noindex', 'warning', 'The alternate ' || href || ' is noindex.' from k where not err and {_noindex("robots", "x_robots")}
      union all select page_idx, 'hreflang_target_canonical_other', 'warning', 'The alternate ' || href || ' names another canonical URL.' from k where not err and canonical <> url_key
      union all select page_idx, 'hreflang_target_lang_mismatch', 'info', 'The alternate ' || href || ' is in ' || lang || ', declared as ' || declared || '.' from k where not err and lower(lang) <> lower(declared)
      union all select page_idx, 'hreflang_not_reciprocal', 'warning', 'The alternate ' || href || ' does not point back.' from k where not err and not back)"""
    rel = """rel as (select hr.page_idx, hr.href, hr.lang, t.page_idx is not null as audited,
        t.page_idx is not null and not exists (select 1 from hr h where h.page_idx = t.page_idx and h.href = p.url) as lost,
        coalesce(t.status not between 200 and 299 or contains(lower(coalesce(t.robots, '')), 'noindex') or contains(lower(coalesce(t.x_robots, '')), 'noindex') or not t.robots_allowed, false) as bad,
        coalesce(t.canonical <> hr.href, false) as conflict
      from hr join pg p using (page_idx) left join pg t on hr.href = t.url where hr.href <> p.url),
      con as (select page_idx, lang, count(distinct href) as targets from hr group by 1, 2 having count(distinct href) > 1)"""
    q["hreflang_relations"] = f"""{{with}}, {rel} select distinct * from (
      select page_idx, 'hreflang_missing_reciprocal' as code, 'warning' as severity, 'The alternate ' || href || ' does not declare this page.' as message from rel where lost
      union all select page_idx, 'hreflang_nonindexable_target', 'warning', 'The alternate ' || href || ' cannot be indexed.' from rel where bad
      union all select page_idx, 'hreflang_target_canonical_conflict', 'warning', 'The alternate ' || href || ' names another canonical URL.' from rel where conflict)
      union all select page_idx, 'hreflang_conflicting_targets', 'warning', 'The language ' || lang || ' has ' || targets || ' targets.' from con"""
    q["hreflang_counts"] = f"""{{with}}, {rel} select count(*) filter (where audited) as checked, count(*) filter (where lost) as missing_reciprocal, count(*) filter (where bad) as non_indexable_targets,
      count(*) filter (where conflict) as canonical_conflicts, count(*) filter (where not audited) as unverified_targets, (select count(*) from con) as conflicting_declarations from rel"""
    q["hreflang_conflicts"] = "select page_idx, lang, count(distinct href) as targets from hr group by 1, 2 having count(distinct href) > 1"
    q["hreflang_merge"] = """{with}, a as (select page_idx, pos, lang, href, source from hr union all select page_idx, pos + 20, lang, href, 'http-header' from hr where pos < 2 union all select page_idx, pos + 40, lang, href, 'sitemap' from hr where pos > 0),
      s as (select page_idx, lang, href, source, min(pos) as pos from a group by all)
      select page_idx, min(pos) as pos, lang, href, string_agg(source, '+' order by pos) as source from s group by page_idx, lang, href"""
    tg, full = _SITEMAP.format(s="sm"), _SITEMAP.format(s="fs")
    cover = "cov as (select count(*) as sitemap_urls, count(page_idx) as audited, count(final_url) as redirected, case when count(*) > 0 then round(count(page_idx) / count(*) * 100, 1) end as percent, count(*) > 0 and count(*) = count(page_idx) as complete from tg)"
    q["sitemap_coverage"] = f"{{with}}, {tg}, {cover} select * from cov"
    q["sitemap_issues"] = f"""{{with}}, {tg} select distinct * from (
      select page_idx, 'sitemap_url_redirect' as code, 'warning' as severity, 'The sitemap''s URL ' || url || ' redirects to ' || final_url || '.' as message from tg where page_idx is not null and final_url is not null
      union all select page_idx, 'sitemap_noindex', 'warning', 'The sitemap lists a noindex page.' from tg where page_idx is not null and {_noindex("robots", "x_robots")}
      union all select page_idx, 'sitemap_noncanonical', 'warning', 'The sitemap lists a page whose canonical URL is ' || canonical || '.' from tg where canonical <> eff)"""
    q["orphans"] = f"""{{with}}, {_EFF}, {_DEGREE}, {full}, {cover}
      select distinct tg.page_idx, page_url as url from tg join deg using (page_idx), cov where complete and (select count(*) from pg) > 1 and page_idx <> 0 and not {_noindex("robots", "x_robots")} and incoming = 0"""
    q["indexability"] = f"{{with}}, {_index('https://www.site.example')} select page_idx, indexability, reason from ix"
    q["fetch_issues"] = f"""{{with}}, h as (select final_key as url_key, min(hops) as hops from rd group by 1), j as (select pg.*, coalesce(hops, 0) as hops from pg left join h using (url_key))
      {_issue(("fetch_failed", "error", "'The page could not be fetched.'", "status = 0"), ("robots_txt_blocked", "warning", "'robots.txt blocks the page.'", "not robots_allowed"), ("redirect_chain", "warning", "'The page is behind ' || hops || ' redirects.'", "hops > 1"), ("temporary_redirect", "info", "'The page is behind a temporary redirect.'", "hops = 1"), ("x_robots_noindex", "info", "'X-Robots-Tag says noindex.'", _noindex("x_robots")), ("http_error", "error", "'The page answers with status ' || status || '.'", "status >= 400"), source="j")}"""
    q["origin_preference"] = f"""with p as (select page_id, lower(regexp_extract(url, '^(https?://[^/?#]*)', 1)) as o, {_family("url")} as site from pages),
      b as (select site, arg_min(o, page_id) as crawl_origin, count(*) as votes from p group by 1), v as (select site, o, count(*) as n, min(page_id) as f from p group by 1, 2),
      t as (select site, arg_max(o, (n, -f)) as o, max(n) as n from v group by 1)
      select site, case when n >= 2 and n / votes >= 0.8 then o else crawl_origin end as origin, case when n >= 2 and n / votes >= 0.8 then 'sitewide-canonical' else 'crawl-origin' end as source,
        case when n >= 2 and n / votes >= 0.8 then round(n / votes, 3) end as confidence, votes from b join t using (site)"""
    q["mixed_scheme"] = """with l as (select unnest([page_id, page_id + 1, page_id + 2]) as page_idx, url as href from pages),
      o as (select page_idx, href, lower(regexp_extract(href, '^https?://([^/?#]*)', 1)) as h, lower(regexp_extract(href, '^(https?)', 1)) as s from l),
      p as (select page_id as page_idx, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) as h, lower(regexp_extract(url, '^(https?)', 1)) as s from pages)
      select o.page_idx, count(distinct href) as mixed from o join p using (page_idx) where o.h = p.h and o.s <> p.s group by 1"""
    places = " ".join(f"when '{k}' then '{v}'" for k, v in PLACES.items())
    q["issue_patterns"] = f"""{{with}}, g as (select severity, code, count(distinct url) as urls, count(*) as occurrences, min((page_idx, stage, seq)) as f, arg_min(message, (page_idx, stage, seq)) as example_message from iss where not expected group by 1, 2),
      h as (select *, {_CATEGORY} as category, (select count(*) from pg) as n from g where urls > 1),
      s as (select *, case when urls >= 3 and urls / n >= 0.5 and category in ('metadata', 'social', 'multilingual', 'structured-data', 'images') then 'likely-template' when urls = n and n > 1 then 'sitewide' else 'repeated' end as scope from h)
      select code, array_to_string(list_transform(string_split(code, '_'), lambda x: upper(x[1]) || x[2:]), ' ') as title, severity, category, scope, urls, occurrences, example_message,
        case when scope = 'likely-template' then 'At least half of the pages have it. ' else '' end || 'Look first at ' || case category {places} end || '.' as likely_root_cause, f[1] as first_seen
      from s order by case severity when 'error' then 3 when 'warning' then 2 else 1 end desc, urls desc, f limit 20"""
    q["severity_summary"] = f"""{{with}} select count(*) filter (where severity = 'error') as errors, count(*) filter (where severity = 'warning') as warnings, count(*) filter (where severity = 'info') as infos,
      (select count(*) from pg) as pages, (select count(*) from pg where {_noindex("robots", "x_robots")}) as noindex, (select count(*) from pg where not robots_allowed) as robots_blocked from iss where not expected"""
    q["staging_context"] = """{with}, c as (select page_idx, coalesce(regexp_extract(canonical, '^(https?://[^/]*)', 1) <> regexp_extract(url, '^(https?://[^/]*)', 1), false) as x from pg),
      e as (select iss.*, code in ('robots_noindex', 'x_robots_noindex', 'robots_txt_blocked', 'sitemap_noindex', 'canonical_target_noindex', 'hreflang_target_noindex') or (x and code in ('canonical_other', 'sitemap_noncanonical', 'hreflang_target_canonical_other')) as ex from iss join c using (page_idx))
      select page_idx, code, case when ex then 'info' else severity end as severity, ex as expected from e"""
    held = f"({_noindex('robots', 'x_robots')} or not robots_allowed)"
    q["staging_protection"] = f"""{{with}}, n as (select count(*) filter (where {held}) as protected, count(*) filter (where status between 200 and 299 and not {held}) as unprotected from pg)
      select *, case when unprotected > 0 then case when protected > 0 then 'partial' else 'unprotected' end when protected > 0 then 'protected' else 'unknown' end as status from n"""
    q["priority_buckets"] = f"""{{with}}, {_index("https://site.example")}, j as (select iss.*, indexability = 'indexable' as ok, contains(lower(coalesce(robots, '') || ' ' || coalesce(x_robots, '')), 'noindex') as held from iss join ix using (page_idx) where not expected),
      p as (select *, case when held and regexp_matches(code, '^(title_|description_|canonical_missing)') then 2 when severity = 'error' and not held then 0 when ok and severity = 'warning' then 1 else 2 end as priority from j)
      select priority::bigint as priority, code, count(distinct url) as urls, arg_min(message, (page_idx, stage, seq)) as example from p group by 1, 2"""
    q["opportunities"] = f"""{{with recursive}}, {_EFF}, {_DEGREE}, {_DEPTH}, {_index("https://site.example")}, m as (select ix.*, deg.* exclude page_idx, depth from ix join deg using (page_idx) left join dep using (page_idx) where indexability = 'indexable' and status between 200 and 299)
      select 'few-inbound' as opportunity, page_idx from m where in_sitemap and incoming <= 1 union all select 'deep', page_idx from m where depth >= 4
      union all select 'no-contextual', page_idx from m where in_sitemap and contextual_incoming = 0 union all select 'not-in-sitemap', page_idx from m where not in_sitemap and incoming > 0"""
    group = "select '{f}' as field, lower(trim(regexp_replace({f}, '\\s+', ' ', 'g'))) as text_key, count(*) as pages, count(distinct nullif(lower(lang), '')) > 1 as multilingual, arg_min({f}, page_idx) as example from ix where indexability = 'indexable' and trim({f}) <> '' group by 2 having count(*) > 1"
    q["metadata_groups"] = f"{{with}}, {_index('https://site.example')} {group.replace('{f}', 'title')} union all {group.replace('{f}', 'description')}"
    changes = lambda path: f"""x as (select coalesce(a.issue_key, b.issue_key) as issue_key, case when a.issue_key is null then 'new' when b.issue_key is null then 'fixed' else 'changed' end as change, a.severity as severity_before, b.severity as severity_after
      from {_diff_map("pi", path)} a full join {_diff_map("ci", path)} b on a.issue_key = b.issue_key where a.issue_key is null or b.issue_key is null or a.severity <> b.severity or a.message <> b.message)"""  # noqa: E731
    q["audit_diff_issues"] = f"{{with}}, {changes(False)} select * from x"
    q["audit_diff_pages"] = f"{{with}}, {_page_diff(False)} select * from dpc"
    q["audit_progress"] = f"""{{with}}, y as (select coalesce(a.issue_key, b.issue_key) as issue_key, case when a.issue_key is null then 'introduced' when b.issue_key is null then 'fixed' else 'remaining' end as state, coalesce(b.url, a.url) as url,
        case when coalesce(a.page_idx, b.page_idx) is null then 'Site' else 'Page' end as scope from {_diff_map("pi", False)} a full join {_diff_map("ci", False)} b on a.issue_key = b.issue_key)
      select issue_key, state, scope from y where scope = 'Site' or (url in (select url from pp) and url in (select url from cp))"""
    q["launch_readiness"] = f"""{{with}}, {changes(True)}, {_page_diff(True)}, {tg}, {cover}, v as (
        select 1 as check_no, 'sitemap_coverage' as check_name, (select percent from cov) as value, 'review' as fault
        union all select 2, 'sitemap_noindex', (select count(distinct page_idx) from ci where code = 'sitemap_noindex' and not expected), 'bad'
        union all select 3, 'robots_blocked', (select count(*) from cp where not robots_allowed), 'bad'
        union all select 4, 'origin_warnings', (select count(*) from ci where page_idx is null and code in ('origin_variant_direct_200', 'canonical_origin_conflict')), 'review'
        union all select 5, 'missing_paths', (select count(*) from dpc where change = 'removed'), 'review'
        union all select 6, 'metadata_drift', (select count(*) from dpc where change = 'changed' and regexp_matches(fields, '(^|,)(title|description|h1)(,|$)')), 'review'
        union all select 7, 'new_errors', (select count(*) from x where change = 'new' and severity_after = 'error'), 'bad'
        union all select 8, 'new_warnings', (select count(*) from x where change = 'new' and severity_after = 'warning'), 'review')
      select check_no::bigint as check_no, check_name, value::double as value, case when value = case when check_no = 1 then 100 else 0 end then 'good' else fault end as verdict from v"""
    live = f"expires_at > timestamp '{NOW}'"
    q["history_latest_pairs"] = f"""{{with}}, k as (select {_family("url")} || '|' || environment as site_key, id, row_number() over (partition by {_family("url")} || '|' || environment order by created_at desc, id desc) as rn from runs where status = 'completed' and {live})
      select site_key, max(case when rn = 1 then id end) as current_id, max(case when rn = 2 then id end) as previous_id from k where rn <= 2 group by 1 having count(*) = 2"""
    q["history_active_runs"] = f"{{with}} select count(*) as active, count(*) < 5 as admits from runs where status in ('queued', 'running') and {live}"
    q["history_prune"] = f"{{with}} select environment, count(*) as pruned from runs where expires_at <= timestamp '{NOW}' group by 1"
    q["history_listing"] = f"{{with}} select id, url, environment, max_pages from runs where status = 'completed' and {live} and contains(lower(url), 'site1') order by created_at desc, id desc limit 30 offset 30"

    robots_known = {"0": (2, 4), "1": (2, 3), "2": (1, 3)}  # counted in catalog.ROBOTS by hand; empty patterns are no rules
    q["robots_counts"] = "select * from (values " + ", ".join(f"('{k}', {g}::bigint, {r}::bigint)" for k, (g, r) in robots_known.items()) + ") v(site, groups, rules)"
    q["hreflang_codes"] = "{with} select string_agg(lang, ',' order by lang) as hreflang_codes from (select distinct lower(lang) as lang from hr) x"
    q["metadata_top"] = f"{q['metadata_groups']}".rstrip() + " order by pages desc, field desc, text_key limit 20"
    q["top_priorities"] = f"{{with}}, x as ({q['priority_buckets'].replace('{with}', 'with _ as (select 1)')}) select priority, code, urls, place from (select *, row_number() over (partition by priority order by urls desc, code) as place from x) y where place <= 3"
    q["report_filter"] = """{with}, m as (select page_idx, string_agg(code || ' ' || message, ' ') as said, bool_or(severity = 'error') as err from iss group by 1)
      select pg.page_idx, pg.url from pg join m using (page_idx) where err and contains(lower(concat_ws(' ', pg.url, title, description, lang, canonical, said)), '/p/1')"""
    q["discovery_labels"] = """{with}, f as (select lk.dst as url_key, 'internal-link' as kind, pg.url_key as source from lk join pg using (page_idx) union all select url_key, 'start', null from pg where page_idx = 0 union all select url_key, 'sitemap', null from sm),
      g as (select pg.page_idx, kind, count(distinct coalesce(source, '')) as n, coalesce(string_agg(distinct source, ',' order by source), '') as sources from f join pg using (url_key) group by 1, 2)
      select page_idx, kind, case kind when 'start' then 1 when 'sitemap' then 2 else 3 end::bigint as place, n, replace(kind, '-', ' ') || case when n > 1 then 's (' || n || ')' else '' end as label, sources from g"""
    drill = {
        "errors": "errors > 0", "warnings": "warnings > 0", "infos": "infos > 0", "noindex": _noindex("robots", "x_robots"), "robots-blocked": "not robots_allowed", "indexable": "indexability = 'indexable'", "not-indexable": "indexability = 'not-indexable'",
        "canonicalized": "indexability = 'canonicalized'", "host-alias": "indexability = 'host-alias'", "failed": "status = 0", "http-errors": "status >= 400", "orphans": "in_sitemap and incoming = 0", "deep": "depth >= 4", "unreachable": "depth is null",
        "outside-sitemap": "not in_sitemap", "duplicates": "dup",
    }
    q["drill_downs"] = f"""{{with recursive}}, {_EFF}, {_DEGREE}, {_DEPTH}, {_index("https://site.example")}, dups as ({q["duplicate_issues"].replace("{with}", "with _ as (select 1)")}),
      e as (select page_idx, severity, false as dup from iss where not expected union all select page_idx, severity, true from dups),
      n as (select page_idx, count(*) filter (severity = 'error') as errors, count(*) filter (severity = 'warning') as warnings, count(*) filter (severity = 'info') as infos, bool_or(dup) as dup from e group by 1),
      m as (select ix.*, incoming, depth, coalesce(errors, 0) as errors, coalesce(warnings, 0) as warnings, coalesce(infos, 0) as infos, coalesce(dup, false) as dup from ix join deg using (page_idx) left join dep using (page_idx) left join n using (page_idx))
      """ + " union all ".join(f"select '{k}' as metric, count(*) as pages from m where {c} having count(*) > 0" for k, c in drill.items())
    q["coverage_cards"] = f"""{{with}}, {_EFF}, {_DEGREE}, {_SITEMAP.format(s="sm")}, p as (select count(*) as audited, count(*) filter (not in_sitemap) as outside_sitemap, count(*) filter (status = 0) as failed, count(*) filter (incoming > 0) as via_links from pg join deg using (page_idx))
      select p.*, (select count(page_idx) from tg) as checked, (select count(*) from tg where page_idx is null) as unvisited from p"""
    site, pref = "'s' || i || '.example'", "case when i % 4 = 0 then 'www.' else '' end"
    q["origin_variants"] = f"""with n as (select page_id as i, i % 7 = 5 as num, case when i % 5 < 4 then 'https' else 'http' end as sc, case when i % 2 = 0 then 'https' else 'http' end as ssc from pages),
      h as (select *, case when num then '8.8.8.8' else {pref} || {site} end as ph, case when i % 3 = 0 then 'www.' else '' end || case when num then '8.8.8.8' else {site} end as sh, case when sc = 'https' then 'http' else 'https' end as oc from n),
      l as (select *, case when starts_with(ph, 'www.') then substr(ph, 5) else 'www.' || ph end as bare from h),
      v as (select i, unnest([sc || '://' || ph, ssc || '://' || sh, oc || '://' || ph, case when not num then sc || '://' || bare end, case when not num then oc || '://' || bare end]) as o, unnest([1, 2, 3, 4, 5]) as k from l),
      f as (select i, o || '/' as url, min(k) as k from v where o is not null group by 1, 2)
      select i as site, row_number() over (partition by i order by k) - 1 as pos, url from f"""
    q["origin_probe"] = f"""with v as ({q["origin_variants"]}), p as (select page_id as i, case when i % 5 < 4 then 'https' else 'http' end || '://' || case when i % 7 = 5 then '8.8.8.8' else {pref} || {site} end as preferred from pages),
      a as (select page_id as i, sc || '://' || www || 's' || page_id || '.example/' as url, case when page_id % 6 = 1 then 0 when page_id % 6 = 2 then 404 else 200 end as status,
        case when page_id % 6 < 4 then 'https://s' || page_id || '.example' else sc || '://' || www || 's' || page_id || '.example' end as ends, page_id % 6 < 4 and sc || www <> 'https' as hop
        from pages, (values ('https', ''), ('http', ''), ('https', 'www.'), ('http', 'www.')) x(sc, www) where page_id % 11 > 0)
      select v.site, v.url, coalesce(status, 0)::bigint as status, case when coalesce(status, 0) = 0 then 'unreachable' when v.url = preferred || '/' then 'preferred' when ends = preferred and hop then 'redirects-to-preferred'
        when status between 200 and 299 then 'direct-nonpreferred' else 'other' end as relation from v join p on v.site = p.i left join a on a.url = v.url"""
    q["image_sizes"] = "select page_id as page_idx, case page_id % 3 when 0 then page_id + 1 when 1 then page_id % 200 + 257 end::bigint as width, case page_id % 3 when 0 then page_id * 2 + 3 when 1 then 10 end::bigint as height from pages"
    q["link_resolution"] = """select page_id as page_idx, ['https://site.example/x', 'https://site.example/a/b' || page_id || '?q=1', 'https://site.example/a/b' || page_id, 'https://site.example/up', 'https://other.example/y', null, 'http://up.example/Z', null,
        'https://site.example/a/c?a=1&b=2', null, 'http://site.example:8080/', null][page_id % 12 + 1] as resolved from pages"""
    q["public_targets"] = "select page_id as page_idx, page_id % 12 in (0, 3, 11) as public from pages"
    q["request_validation"] = """with r as (select page_id as i, ['site.example', 'HTTPS://Site.example/', '', repeat('a', 2049), '', 'http://site.example', 'http://site.example'][page_id % 7 + 1] as url from pages)
      select i as page_idx, case when lower(url) like 'http://%' or lower(url) like 'https://%' then url else 'https://' || url end as url,
        concat_ws(',', case when i % 7 in (2, 4) then 'url required' end, case when i % 7 = 3 then 'url too long' end, case when i % 5 in (1, 2) then 'max_pages out of range' end, case when i % 4 = 2 then 'environment unknown' end) as faults from r"""
    cell = "string_agg(case when expected then 'expected' else severity end || ': ' || message, ' | ' order by stage, seq)"
    q["csv_export"] = f"""{{with}}, c as (select page_idx, {cell} as issues, count(*) filter (severity = 'error' and not expected) as errors, 3 as counts from iss group by 1)
      select 'page' as record, url, coalesce(issues, '') as issues, coalesce(errors::varchar, '') as errors, (3 + (title <> '')::int + case when issues is null then 0 else 4 end)::bigint as cells from pg left join c using (page_idx)
      union all select 'redirect', from_key, '', '', 4 from rd"""
    q["csv_export"] = q["csv_export"].replace(", url, coalesce", ', url as "URL", coalesce', 1)
    q["csv_import"] = """{with} select url, row_number() over (partition by page_idx order by stage, seq) - 1 as seq, case when expected then 'expected' else severity end as severity, message, expected from iss"""

    out = {}
    for name, text in q.items():
        body = text.replace("{with recursive}", "").replace("{with}", "")
        import re

        used = [k for k in _RELATIONS if re.search(rf"\b{k}\b", body)] if "{with" in text or not text.lstrip().startswith("with") else []
        ctes = ", ".join(f"{k} as ({d.duck(_RELATIONS[k])})" for k in used)
        if not used:
            out[name] = text
        elif "{with recursive}" in text:
            out[name] = f"with recursive {ctes}{body}"
        elif "{with}" in text:
            out[name] = f"with {ctes}{body}"
        else:
            out[name] = f"with {ctes} {body}"
    return out | oracle_pages.sql(_language)
