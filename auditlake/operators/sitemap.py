"""Sitemaps: parsing, distinct locations, fair order."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.functions import urls
from auditlake.functions.urls import normalize, resolve

MAX_BYTES = 5_000_000
PARSED = "url string, kind string, pos long, loc string, loc_key string, lang string, href string"


def _local(tag) -> str:
    return str(tag).rpartition("}")[2].lower()


def parse_sitemap(url: str, body: bytes | None) -> tuple[str, list[tuple]]:
    """Kind (index, urlset, too-large, invalid) and rows (pos, loc, key, lang, href): one per location, then one per alternate."""
    body = body or b""
    if urlsplit(url).path.lower().endswith(".gz"):
        try:
            body = gzip.decompress(body)
        except (OSError, EOFError, zlib.error):
            pass  # as captured
    if len(body) > MAX_BYTES:
        return "too-large", []
    if b"<!ENTITY" in body:
        return "invalid", []
    try:
        root = ElementTree.fromstring(body)
    except ElementTree.ParseError:
        return "invalid", []
    kind = {"sitemapindex": "index", "urlset": "urlset"}.get(_local(root.tag))
    if kind is None:
        return "invalid", []
    rows = []
    for pos, entry in enumerate(e for e in root if _local(e.tag) in ("url", "sitemap")):
        loc = next(("".join(c.itertext()).strip() for c in entry if _local(c.tag) == "loc"), "")
        key = resolve(url, loc)
        if key is None:
            continue
        rows.append((pos, loc, key, None, None))
        for c in entry:
            rel = (c.get("rel") or "").lower().split()
            lang, href = (c.get("hreflang") or "").strip().lower(), normalize(c.get("href") or "", url) if c.get("href") else None
            if _local(c.tag) == "link" and "alternate" in rel and lang and href:
                rows.append((pos, loc, key, lang, href))
    return kind, rows


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["url", "kind", "pos", "loc", "loc_key", "lang", "href"]
    schema = pa.schema([("url", pa.string()), ("kind", pa.string()), ("pos", pa.int64()), *[(n, pa.string()) for n in names[3:]]])
    for b in batches:
        out = []
        for url, body in zip(b.column("url").to_pylist(), b.column("body").to_pylist(), strict=True):
            kind, rows = parse_sitemap(url or "", body)
            out += [dict(zip(names, (url, kind, *r), strict=True)) for r in rows or [(None,) * 5]]
        yield from pa.Table.from_pylist(out, schema).combine_chunks().to_batches()


def parse(bodies: DataFrame) -> DataFrame:
    """Locations and alternates of sitemap bodies (url, body): one row each, one row without them where there are none."""
    return bodies.select("url", F.col("body").cast("binary").alias("body")).mapInArrow(_run, PARSED)


def locations(parsed: DataFrame) -> DataFrame:
    """pos, url_key, url: distinct by key, the first place and the last spelling."""
    l = parsed.filter("loc is not null and lang is null")  # noqa: E741
    return l.groupBy(F.col("loc_key").alias("url_key")).agg(F.min("pos").alias("pos"), F.max_by("loc", "pos").alias("url"))


def interleave(seeds: DataFrame) -> DataFrame:
    """Adds turn and order_key for (pos, url): round robin over locales, first seen first, order kept within a locale.

    Sort by (turn, first_pos). The window runs per locale folder; its first place is a partial minimum.
    """
    each = seeds.withColumn("locale", urls.locale(F.col("url")))
    w = Window.partitionBy("locale").orderBy("pos")
    return each.withColumn("turn", F.row_number().over(w)).withColumn("first_pos", F.min("pos").over(Window.partitionBy("locale")))
