"""Captured responses: the table that every audit reads, a data source over capture files, and a live fetcher."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "url string, status int, location string, content_type string, link_header string, x_robots_tag string, body binary, error string"
USER_AGENT = "auditlake/0.1 (+site audit)"
CONNECT_SECONDS, PAGE_SECONDS, CHECK_SECONDS, CONCURRENCY = 3, 8, 5, 6
HTML_ACCEPT = "text/html,application/xhtml+xml;q=0.9,*/*;q=0.5"


def read(spark: SparkSession, path: str) -> DataFrame:
    """A response table kept as Parquet."""
    return spark.read.schema(SCHEMA).parquet(path)


class _Lines(InputPartition):
    def __init__(self, lines: list[str]):
        super().__init__(len(lines))
        self.lines = lines


class _Reader(DataSourceReader):
    """Rows of inline captures, for fixtures: option `rows` is a JSON list, `partitions` how it is dealt out."""

    def __init__(self, options: dict):
        self.rows, self.n = json.loads(options.get("rows", "[]")), int(options.get("partitions", "1"))

    def partitions(self) -> list[InputPartition]:
        return [_Lines([json.dumps(r) for r in self.rows[k :: self.n]]) for k in range(self.n)]

    def read(self, partition: _Lines) -> Iterator[tuple]:
        for line in partition.lines:
            r = json.loads(line)
            body = base64.b64decode(r["body_base64"]) if "body_base64" in r else (r.get("body") or "").encode()
            yield (r["url"], r.get("status", 200), r.get("location"), r.get("content_type", "text/html"), r.get("link_header"), r.get("x_robots_tag"), body, r.get("error"))


class ResponseSource(DataSource):
    """spark.dataSource.register(ResponseSource); spark.read.format("responses").option("rows", json).load()"""

    @classmethod
    def name(cls) -> str:
        return "responses"

    def schema(self) -> StructType | str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def lookup(frontier: DataFrame, responses: DataFrame) -> DataFrame:
    """The frontier's URLs with what was captured of each; what was not captured counts as an empty 404."""
    r = responses.withColumnRenamed("url", "_url")
    both = frontier.join(r, frontier["url"] == r["_url"], "left")
    missing = F.col("_url").isNull()
    return both.withColumns({c: F.when(missing, F.lit(x)).otherwise(F.col(c)) for c, x in NOT_CAPTURED.items() if c in r.columns}).drop("_url")


NOT_CAPTURED = {"status": 404, "content_type": "text/html", "body": b""}


def among(responses: DataFrame, urls: list[str]) -> DataFrame:
    """What was captured of a list of URLs that the driver holds: a filter that reaches the files, so one scan and no shuffle."""
    return responses.filter(F.col("url").isin(urls))


def text_of(body) -> Column:
    """A body as text: UTF-8, with a replacement mark for what is not."""
    return F.make_valid_utf8(body.cast("string"))


def fetch(frontier: DataFrame, seconds: int = PAGE_SECONDS, accept: str = HTML_ACCEPT, image_bytes: int | None = None) -> DataFrame:
    """Fetches a frontier (url) into response rows. Redirects are not followed; only public targets are asked.

    Each partition keeps six requests under way; repartition the frontier to set how many run in all.
    """
    from auditlake.functions.urls import is_public

    def one(url: str) -> tuple:
        import socket
        import urllib.error
        import urllib.request

        class Stay(urllib.request.HTTPRedirectHandler):
            def redirect_request(self, *a, **k):
                return None

        if not is_public(url):
            return url, 0, None, None, None, None, b"", "not a public target"
        headers = {"User-Agent": USER_AGENT, "Accept": accept} | ({"Range": f"bytes=0-{image_bytes - 1}"} if image_bytes else {})
        try:
            from urllib.parse import urlsplit

            for info in socket.getaddrinfo(urlsplit(url).hostname, None):
                if not is_public(f"http://[{info[4][0]}]/" if ":" in info[4][0] else f"http://{info[4][0]}/"):
                    return url, 0, None, None, None, None, b"", "not a public address"
            try:
                r = urllib.request.build_opener(Stay).open(urllib.request.Request(url, headers=headers), timeout=seconds)
            except urllib.error.HTTPError as answer:
                r = answer
            h = r.headers
            return url, r.status, h.get("Location"), h.get("Content-Type"), h.get("Link"), h.get("X-Robots-Tag"), r.read(image_bytes or 5_000_001), None
        except Exception as fault:  # a target that cannot be reached is a result
            return url, 0, None, None, None, None, b"", str(fault)[:300]

    def run(batches):
        from concurrent.futures import ThreadPoolExecutor

        import pandas as pd

        with ThreadPoolExecutor(CONCURRENCY) as pool:
            for b in batches:
                yield pd.DataFrame(list(pool.map(one, b["url"])), columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return frontier.select("url").mapInPandas(run, SCHEMA)
