"""URL keys. Three rules that must not be merged: crawl keys, hreflang keys and path keys."""

from __future__ import annotations

import functools
import ipaddress
import re
from urllib.parse import quote, unquote_to_bytes, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tracking parameters that a crawl key leaves out, besides all that begin with utm_.
TRACKING = ("fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid")
#: Addresses of these schemes are no links, and files of these kinds are no pages.
NO_LINK = re.compile(r"^(?:mailto:|tel:|javascript:|data:)", re.I)
NO_PAGE = r"(?i)\.(?:jpg|jpeg|png|gif|webp|svg|avif|ico|pdf|zip|rar|7z|gz|mp4|mp3|wav|mov|avi|webm|css|js|mjs|xml|json|txt|woff2?|ttf|eot)(?:$|\?)"
PRIVATE_HOSTS = (".localhost", ".local", ".internal", ".home.arpa")

_KEEP_PATH = "!$&'()*+,;=:@/%-._~"


def _decoded(text: str) -> str:
    return unquote_to_bytes(text.replace("+", " ")).decode("utf-8", "surrogateescape")


def _order(a: str, b: str) -> int:
    """Order of parameters: numbers by value, anything else as text."""
    x, y = (int(a), int(b)) if a.isdigit() and b.isdigit() else (a, b)
    return (x > y) - (x < y)


def parameters(query: str) -> dict[str, object]:
    """A query string as form data: of repeated names the last counts, names lose dots and spaces, a[k] nests."""
    out: dict[str, object] = {}
    for piece in query.split("&"):
        if not piece:
            continue
        name, _, value = piece.partition("=")
        name, value = _decoded(name).lstrip(" "), _decoded(value)
        head, bracket, rest = name.partition("[")
        head = re.sub(r"[. ]", "_", head)
        if not head:
            continue
        if not bracket or "]" not in rest:
            out[re.sub(r"[. ]", "_", head + bracket + rest) if bracket else head] = value
            continue
        at = out[head] if isinstance(out.get(head), dict) else out.setdefault(head, {}) if head not in out else out.__setitem__(head, {}) or out[head]
        keys = re.findall(r"\[([^\]]*)\]", bracket + rest)
        for k, key in enumerate(keys):
            if key == "":
                key = str(1 + max((int(x) for x in at if x.isdigit()), default=-1))
            if k == len(keys) - 1:
                at[key] = value
            else:
                at = at[key] if isinstance(at.get(key), dict) else at.__setitem__(key, {}) or at[key]
    return out


def _pairs(prefix: str, value: object):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _pairs(f"{prefix}[{k}]", v)
    else:
        yield prefix, value


def _encoded(text: str) -> str:
    return quote(text.encode("utf-8", "surrogateescape"), safe="-._~")


def normalize(url: str | None, base: str | None = None) -> str | None:
    """Crawl key of a URL, resolved against `base`; None where it is not a http(s) address with a host."""
    if url is None:
        return None
    try:
        url = url.strip(" \t\n\r\0\x0b")
        if base is not None:
            url = urljoin(base, url)
        p = urlsplit(url)
        host, port, scheme = p.hostname, p.port, p.scheme.lower()
    except ValueError:
        return None
    if scheme not in ("http", "https") or not host:
        return None
    host = f"[{host}]" if ":" in host else host.lower()
    user = p.netloc.rpartition("@")[0]
    port = None if port == (443 if scheme == "https" else 80) else port
    kept = {k: v for k, v in parameters(p.query).items() if not k.lower().startswith("utm_") and k.lower() not in TRACKING}
    query = "&".join(f"{_encoded(n)}={_encoded(v)}" for k in sorted(kept, key=functools.cmp_to_key(_order)) for n, v in _pairs(k, kept[k]))
    path = quote(p.path or "/", safe=_KEEP_PATH)
    return f"{scheme}://{user + '@' if user else ''}{host}{f':{port}' if port is not None else ''}{path}{'?' + query if query else ''}"


def resolve(base: str | None, href: str | None) -> str | None:
    """Crawl key of a link; None for empty ones, mail, phone, script and data addresses, and invalid URLs."""
    href = (href or "").strip(" \t\n\r\0\x0b")
    if base is None or not href or NO_LINK.match(href):
        return None
    return normalize(href, base)


def is_public(url: str | None) -> bool:
    """No credentials, no local name, and no private or reserved literal address. Names are not looked up here."""
    key = normalize(url)
    if key is None or "@" in urlsplit(key).netloc:
        return False
    host = urlsplit(key).hostname or ""
    if host == "localhost" or host.endswith(PRIVATE_HOSTS):
        return False
    try:
        ip = ipaddress.ip_address(host)
    except ValueError:
        return True
    return ip.is_global and not ip.is_multicast


@F.pandas_udf(T.StringType())
def _normalized(url: pd.Series) -> pd.Series:
    return url.map(normalize, na_action="ignore")


#: Addresses that are their own key: lower-case host, no port, no query, and a path of characters that need no escape.
_OWN_KEY = r"^https?://[a-z0-9.\-]+/[A-Za-z0-9!$&'()*+,;=:@/._~\-]*\z"


def url_key(url: Column) -> Column:
    """Crawl key of a URL. Those that are their own key stay in the JVM; only the others are worth a call."""
    own = url.rlike(_OWN_KEY)
    return F.when(own, url).otherwise(_normalized(F.when(~own, url)))


@F.pandas_udf(T.StringType())
def resolved(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([resolve(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


@F.pandas_udf(T.BooleanType())
def public_target(url: pd.Series) -> pd.Series:
    return url.map(is_public).astype(bool)


_PORT = r"^[A-Za-z]+://[^/?#]*?(:[0-9]+)?(?:[/?#]|$)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def host(url: Column) -> Column:
    """Without port and credentials, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


def origin(url: Column) -> Column:
    """scheme://host, with the port unless it is the scheme's own."""
    port = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:]*)(:[0-9]+)", 1)
    own = ((scheme(url) == "https") & (port == ":443")) | ((scheme(url) == "http") & (port == ":80"))
    return F.concat(scheme(url), F.lit("://"), host(url), F.when(own, F.lit("")).otherwise(port))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def host_family(url: Column) -> Column:
    """The host without one www. in front; an address stays as it is."""
    h = host(url)
    return F.when(h.rlike(r"^([0-9.]+|\[.*\])$"), h).otherwise(F.regexp_replace(h, r"^www\.", ""))


def same_family(a: Column, b: Column) -> Column:
    return (host(a) != "") & (host(b) != "") & (host_family(a) == host_family(b))


def host_alias(page: Column, canonical: Column, preferred: Column) -> Column:
    """The canonical names the same path and query at the preferred origin of the page's host family. Both are crawl keys."""
    return same_family(page, canonical) & (origin(canonical) == preferred) & (path(page) == path(canonical)) & (query(page) == query(canonical))


def hreflang_key(url: Column) -> Column:
    """Key of hreflang relations: port, path and query stay as written; null if not http(s)."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*?((?::[0-9]+)?(?:[/?][^#]*)?)(?:#.*)?$", 1)
    return F.when(scheme(url).isin("http", "https") & (host(url) != ""), F.concat(scheme(url), F.lit("://"), host(url), F.when(rest.rlike(r"^(:[0-9]+)?$"), F.concat(rest, F.lit("/"))).otherwise(rest)))


def path_key(url: Column) -> Column:
    """Key of staging-to-live comparisons: path without slashes at its end, and query."""
    p = F.when(path(url) == "", F.lit("/")).otherwise(path(url))
    p = F.when(F.length(p) > 1, F.regexp_replace(p, "/+$", "")).otherwise(p)
    return F.when(host(url) == "", F.coalesce(url, F.lit(""))).otherwise(F.concat(p, F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise(F.lit(""))))


def locale(url: Column) -> Column:
    """The first path segment if it looks like a locale, else _default."""
    found = F.lower(F.regexp_extract(path(url), r"(?i)^/([a-z]{2}(?:-[a-z]{2})?)(?:/|$)", 1))
    return F.when(found == "", F.lit("_default")).otherwise(found)
