"""Resolution of WARC not-modified revisits.

A revisit record says that a resource had not changed; what it stands for is the latest earlier full response
of the same canonical URL. Captures are range-partitioned by (URL, time), so that the captures of a URL that
holds a third of all records spread over many tasks, and sorted there. One pass over a partition keeps a
single row in hand, the last full response. What a partition's first URL needs from the partitions before
comes from one summary row per partition. Bodies never move: records carry digests and headers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.llm._tables import Scratch, table

#: Header fields that a 304 response may update (RFC 9110, section 15.4.5, and Last-Modified).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
_REPLY = "struct<record_id:bigint,etag:string,last_modified:string,headers:map<string,string>,digest:string>"


def canonical_url(url: Column) -> Column:
    """Without scheme, leading www., default port, fragment, utm_ parameters and a slash at the end; host in lower case."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(u, "^(?i:https?)://(?i:www\\.)?([^/?]*)", 1))
    host = F.regexp_replace(host, ":(80|443)$", "")
    rest = F.regexp_replace(u, "^(?i:https?)://[^/?]*", "")
    rest = F.regexp_replace(F.regexp_replace(rest, "([?&])utm_[^&]*", "$1"), "[?&]+$", "")
    rest = F.regexp_replace(F.regexp_replace(rest, "\\?&+", "?"), "&&+", "&")
    return F.nullif(F.concat(host, F.regexp_replace(rest, "/$", "")), F.lit(""))


def _last_full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted captures in, revisits out with the last full response before them; at the end one row that sums up.

    open: the partition has shown no full response of that URL so far, an earlier partition may have.
    """
    part, held, first_url = TaskContext.get().partitionId(), None, None
    for b in batches:
        if not b.num_rows:
            continue
        own = b.num_rows
        first_url = b.column("canonical")[0].as_py() if first_url is None else first_url
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        skip = b.num_rows - own
        url, full = b.column("canonical"), b.column("full").to_numpy(zero_copy_only=False)
        same = np.asarray(pa.compute.equal(url.slice(1), url.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False), bool)
        run = np.concatenate([[0], np.maximum.accumulate(np.where(same, 0, np.arange(1, b.num_rows)))]) if b.num_rows > 1 else np.zeros(1, np.int64)
        last = np.maximum.accumulate(np.where(full, np.arange(b.num_rows), -1))
        found = np.where(last >= run, last, -1)
        rows = np.flatnonzero(~full & (np.arange(b.num_rows) >= skip))
        match = pa.array(np.maximum(found[rows], 0), mask=found[rows] < 0)
        is_first = np.asarray(pa.compute.equal(url, pa.scalar(first_url)).to_numpy(zero_copy_only=False), bool)
        yield _rows(part, b.take(pa.array(rows)), b.column("reply").take(match), pa.array(is_first[rows] & (found[rows] < 0)), False)
        held = b.slice(found[-1], 1) if found[-1] >= 0 else None
    if held is not None:
        yield _rows(part, held, held.column("reply"), pa.array([False]), True)


def _rows(part: int, b: pa.RecordBatch, found, open_, sums: bool) -> pa.RecordBatch:
    n = b.num_rows
    names = ["canonical", "ts", "reply"]
    return pa.record_batch([*[b.column(c) for c in names], found, open_, pa.array([sums] * n), pa.array([part] * n, pa.int32())], names=[*names, "found", "open", "sums", "part"])


def resolve_revisits(captures: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per revisit: record_id, canonical, ts, refers_to, outcome, headers (merged), digest (of what it refers to).

    captures: record_id, url, ts, kind (response or revisit), status, etag, last_modified, headers, digest; other
    columns are not looked at. Full responses are those of status 200. Earlier means a smaller ts; of responses
    at one ts the largest record_id counts as the latest. outcome: `resolved` if the revisit's etag equals the
    response's (W/ aside) or, where it has none, its last_modified does; `unvalidated` if it has neither;
    `mismatch` if the one it has differs; `orphan` without an earlier response, which includes revisits with no
    URL or time. Only `resolved` and `unvalidated` rows refer to anything. Merged headers are the response's,
    overlaid with those of the revisit that a 304 may update. Repeated revisits are resolved each; null
    headers count as none. Empty in, empty out.
    """
    spark = captures.sparkSession
    scratch = Scratch(spark, "revisits")
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    headers = F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>"))
    rows = captures.select(
        canonical_url(F.col("url")).alias("canonical"), F.col("ts").cast("long").alias("ts"), ((F.col("kind") == "response") & (F.col("status") == 200)).alias("full"), "kind",
        F.struct(F.col("record_id").cast("long").alias("record_id"), "etag", "last_modified", headers.alias("headers"), "digest").cast(_REPLY).alias("reply"),
    ).filter("full or kind = 'revisit'")
    rows = rows.withColumn("full", F.coalesce("full", F.lit(False)))
    placed = rows.filter("canonical is not null and ts is not null").select("canonical", "ts", "full", "reply")
    order = ["canonical", "ts", "full", F.col("reply.record_id")]
    schema = f"canonical string, ts bigint, reply {_REPLY}, found {_REPLY}, open boolean, sums boolean, part int"
    seen = scratch.keep(placed.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_last_full, schema))
    # one row per partition and URL at its end: the last response before a partition is the latest of these
    sums = seen.filter("sums").select(F.col("canonical").alias("_url"), F.col("part").alias("_part"), F.col("found").alias("_found"), F.lit(False).alias("_asks"))
    waiting = seen.filter("open and not sums").select(F.col("canonical").alias("_url"), F.col("part").alias("_part")).distinct()
    waiting = waiting.select("_url", "_part", F.lit(None).cast(_REPLY).alias("_found"), F.lit(True).alias("_asks"))
    earlier = Window.partitionBy("_url").orderBy("_part").rangeBetween(Window.unboundedPreceding, -1)
    before = sums.unionByName(waiting).withColumn("_carry", F.last("_found", True).over(earlier))
    before = scratch.keep(before.filter("_asks and _carry is not null").select("_url", "_part", "_carry"))
    late = seen.filter("not sums")
    joined = late.join(before, late["open"] & (late["canonical"] == before["_url"]) & (late["part"] == before["_part"]), "left")
    joined = joined.select("canonical", "ts", "reply", F.coalesce("found", "_carry").alias("found"))
    lost = rows.filter("not full and (canonical is null or ts is null)").select("canonical", "ts", "reply", F.lit(None).cast(_REPLY).alias("found"))
    all_ = joined.unionByName(lost)
    bare = lambda c: F.regexp_replace(c, "^W/", "")
    outcome = (
        F.when(F.col("found").isNull(), "orphan")
        .when(F.col("reply.etag").isNotNull(), F.when(F.coalesce(bare(F.col("reply.etag")) == bare(F.col("found.etag")), F.lit(False)), "resolved").otherwise("mismatch"))
        .when(F.col("reply.last_modified").isNotNull(), F.when(F.coalesce(F.col("reply.last_modified") == F.col("found.last_modified"), F.lit(False)), "resolved").otherwise("mismatch"))
        .otherwise("unvalidated")
    )
    fresh = F.map_filter("reply.headers", lambda k, _: F.lower(k).isin(*PERMITTED))
    kept = F.map_filter("found.headers", lambda k, _: ~F.array_contains(F.transform(F.map_keys(fresh), F.lower), F.lower(k)))
    good = F.col("outcome").isin("resolved", "unvalidated")
    return all_.withColumn("outcome", outcome).select(
        F.col("reply.record_id").alias("record_id"), "canonical", "ts", F.when(good, F.col("found.record_id")).alias("refers_to"), "outcome",
        F.when(good, F.map_concat(kept, fresh)).alias("headers"), F.when(good, F.col("found.digest")).alias("digest"),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """A capture log of `pages`: each page and its host's front page, fetched and then revisited, with known flaws."""
    i, u = F.col("page_id"), F.col("url")
    ts, tag, text = i * 10 + (i % 97) * 1000, F.md5(F.col("html").cast("binary")), lambda x: x.cast("string")
    home = F.concat(F.regexp_extract(u, "^(https?://[^/?#]+)", 1), F.lit("/"))
    null = F.lit(None).cast("string")
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))

    def capture(k, url, at, kind, etag, modified, digest, *headers):
        pairs = [F.lit(x) if isinstance(x, str) else x for x in headers]
        return F.struct((i * 5 + k).alias("record_id"), url.alias("url"), at.alias("ts"), F.lit(kind).alias("kind"), F.lit(200 if kind == "response" else 304).alias("status"), etag.alias("etag"), modified.alias("last_modified"), F.create_map(*pairs).alias("headers"), digest.alias("digest"))

    modified = F.concat(F.lit("day "), text(i % 50))
    other = F.concat(F.regexp_replace(F.regexp_replace(u, "^https?", "https"), "#.*$", ""), F.lit("#again"))
    etag = F.when(i % 7 == 3, null).when(i % 5 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), quoted(tag)))
    again = F.when((i % 7 == 3) & (i % 2 == 0), modified).when((i % 7 == 3) & (i % 3 == 0), F.lit("never"))
    version = lambda x: quoted(F.concat(F.lit("home-"), text(F.floor(x / 10))))
    records = [
        capture(0, u, ts, "response", quoted(tag), modified, tag, "content-type", "text/html", "cache-control", "max-age=60", "date", text(ts), "server", "s1"),
        capture(1, other, ts + 3600, "revisit", etag, again, null, "Cache-Control", "max-age=120", "Date", text(ts + 3600), "Content-Type", "text/plain", "Set-Cookie", "a=1"),
        capture(2, home, i * 10, "response", version(i), null, version(i), "content-type", "text/html", "date", text(i * 10)),
        capture(3, home, i * 10 + 5, "revisit", version(i - i % 3), null, null, "date", text(i * 10 + 5), "vary", "accept"),
        F.when(i % 9 == 4, capture(4, u, ts - 1, "revisit", quoted(tag), null, null, "date", text(ts - 1))),
    ]
    return pages.select(F.explode(F.array(*records)).alias("c")).filter("c is not null").select("c.*")


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(captures_of(table(spark, sf_dir, "pages")))
    merged = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(F.lower(e["key"]), F.lit(": "), e["value"]))), "\n")
    return out.withColumn("headers", merged)


_CANON = r"""
nullif(regexp_replace(lower(regexp_extract(regexp_replace(trim({u}), '#.*$', ''), '^(?i:https?)://(?i:www\.)?([^/?]*)', 1)), ':(80|443)$', '')
  || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({u}), '#.*$', ''),
     '^(?i:https?)://[^/?]*', ''), '([?&])utm_[^&]*', '\1', 'g'), '[?&]+$', ''), '\?&+', '?', 'g'), '&&+', '&', 'g'), '/$', ''), '')
"""
ORACLE_SQL = rf"""
WITH p AS (
  SELECT page_id AS i, url AS u, page_id * 10 + (page_id % 97) * 1000 AS ts, md5(html) AS tag, 'day ' || (page_id % 50) AS modified,
         regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/' AS home FROM pages),
c AS (
  SELECT i * 5 AS record_id, u AS url, ts, true AS is_full, '"' || tag || '"' AS etag, modified AS last_modified, tag AS digest FROM p
  UNION ALL
  SELECT i * 5 + 1, regexp_replace(regexp_replace(u, '^https?', 'https'), '#.*$', '') || '#again', ts + 3600, false,
         CASE WHEN i % 7 = 3 THEN NULL WHEN i % 5 = 0 THEN '"other"' ELSE 'W/"' || tag || '"' END,
         CASE WHEN i % 7 = 3 AND i % 2 = 0 THEN modified WHEN i % 7 = 3 AND i % 3 = 0 THEN 'never' END, NULL FROM p
  UNION ALL
  SELECT i * 5 + 2, home, i * 10, true, '"home-' || (i // 10) || '"', NULL, '"home-' || (i // 10) || '"' FROM p
  UNION ALL
  SELECT i * 5 + 3, home, i * 10 + 5, false, '"home-' || ((i - i % 3) // 10) || '"', NULL, NULL FROM p
  UNION ALL
  SELECT i * 5 + 4, u, ts - 1, false, '"' || tag || '"', NULL, NULL FROM p WHERE i % 9 = 4),
k AS (SELECT *, {_CANON.format(u="url")} AS canonical FROM c),
m AS (
  SELECT v.record_id, v.canonical, v.ts, v.etag, v.last_modified,
         arg_max(struct_pack(r := r.record_id, e := r.etag, l := r.last_modified, d := r.digest, t := r.ts), (r.ts, r.record_id)) AS f
  FROM k v LEFT JOIN k r ON v.canonical = r.canonical AND r.is_full AND r.ts < v.ts
  WHERE NOT v.is_full GROUP BY ALL),
o AS (
  SELECT *, CASE WHEN f.r IS NULL THEN 'orphan'
                 WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') IS NOT DISTINCT FROM regexp_replace(f.e, '^W/', '') THEN 'resolved' ELSE 'mismatch' END
                 WHEN last_modified IS NOT NULL THEN CASE WHEN last_modified IS NOT DISTINCT FROM f.l THEN 'resolved' ELSE 'mismatch' END
                 ELSE 'unvalidated' END AS outcome FROM m)
SELECT record_id, canonical, ts, outcome,
       CASE WHEN outcome IN ('resolved', 'unvalidated') THEN f.r END AS refers_to,
       CASE WHEN outcome IN ('resolved', 'unvalidated') THEN f.d END AS digest,
       CASE WHEN outcome NOT IN ('resolved', 'unvalidated') THEN NULL
            ELSE concat_ws(chr(10), CASE WHEN record_id % 5 = 1 THEN 'cache-control: max-age=120' WHEN f.r % 5 = 0 THEN 'cache-control: max-age=60' END,
                           'content-type: text/html', 'date: ' || ts, CASE WHEN f.r % 5 = 0 THEN 'server: s1' END, CASE WHEN record_id % 5 = 3 THEN 'vary: accept' END) END AS headers
FROM o
"""
