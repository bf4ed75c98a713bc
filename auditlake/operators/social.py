"""Social images: what the addresses in og:image and twitter:image answer, and the pictures' size."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.operators.rules import SOCIAL, explode_issues, found

MOST_IMAGES = 75
_SIZE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])


def image_size(head: bytes | None) -> tuple[int | None, int | None]:
    """Width and height from the first bytes of a PNG, GIF, JPEG or WebP file."""
    b = bytes(head or b"")
    try:
        if b[:8] == b"\x89PNG\r\n\x1a\n" and b[12:16] == b"IHDR":
            return struct.unpack(">II", b[16:24])
        if b[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack("<HH", b[6:10])
        if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
            if b[12:16] == b"VP8 ":
                w, h = struct.unpack("<HH", b[26:30])
                return w & 0x3FFF, h & 0x3FFF
            if b[12:16] == b"VP8L":
                n = struct.unpack("<I", b[21:25])[0]
                return (n & 0x3FFF) + 1, (n >> 14 & 0x3FFF) + 1
            if b[12:16] == b"VP8X":
                return int.from_bytes(b[24:27], "little") + 1, int.from_bytes(b[27:30], "little") + 1
        if b[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(b):
                if b[at] != 0xFF:
                    at += 1
                    continue
                mark = b[at + 1]
                if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", b[at + 5 : at + 9])
                    return w, h
                at += 2 if 0xD0 <= mark <= 0xD9 or mark in (0x01, 0xFF) else 2 + struct.unpack(">H", b[at + 2 : at + 4])[0]
    except (struct.error, IndexError):
        pass
    return None, None


@F.pandas_udf(_SIZE)
def dimensions(head: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([image_size(h) for h in head], columns=["width", "height"]).astype("Int32")


def discovered(pages: DataFrame) -> DataFrame:
    """url, at: the distinct og and twitter images, and the place of the first mention."""
    each = pages.select("page_idx", F.posexplode(F.array("og_image", "twitter_image")).alias("k", "url")).filter("url is not null")
    return each.groupBy("url").agg(F.min(F.struct("page_idx", "k")).alias("at"))


def wanted(pages: DataFrame, most: int = MOST_IMAGES) -> DataFrame:
    """url: distinct og and twitter images in page order, `most` of them (the report's limit)."""
    return discovered(pages).orderBy("at").limit(most).select("url")


def image_issues(pages: DataFrame, images: DataFrame) -> DataFrame:
    """Per page, for og:image and then twitter:image, the first that holds. images: url, status, content_type."""
    each = pages.select("page_idx", "url", F.posexplode(F.array("og_image", "twitter_image")).alias("k", "image")).filter("image is not null")
    i = images.select(F.col("url").alias("image"), "status", "content_type")
    c = F.col
    both = each.join(i, "image")
    kind = F.when(c("k") == 0, "og:image").otherwise("twitter:image")
    ok = (c("status") > 0) & (c("status") < 300)
    out = explode_issues(
        both,
        SOCIAL,
        [
            found(c("status") == 0, "social_image_unreachable", "warning", kind, " cannot be reached: ", c("image")),
            found(c("status") >= 400, "social_image_http_error", "warning", kind, " answers with status ", c("status"), ": ", c("image")),
            found((c("status") >= 300) & (c("status") < 400), "social_image_redirect", "info", kind, " redirects: ", c("image")),
            found(ok & ~F.startswith(F.lower(F.coalesce(c("content_type"), F.lit(""))), F.lit("image/")), "social_image_content_type", "warning", kind, " is not an image: ", c("image")),
        ],
        ("page_idx", "url", "k"),
    )
    return out.withColumn("seq", c("k").cast("long")).drop("k")
