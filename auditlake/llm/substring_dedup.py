"""Substring dedup: Relative Lempel-Ziv parsing of every document against the corpus's first occurrences.

The reference is made of blocks, one a document: the windows of 50 words that occur there for the first time
(smallest doc_id, then text key, then position). So each window of the corpus lies in the reference once, at
one (block, offset), and the longest factor of 50 words or more that begins with a given window is unique: it
runs on as long as the next window lies in the same block at the next offset. The parse of a document goes
from left to right; at the first window that a block of a smaller doc_id holds it takes that longest factor.
At the factor's end the windows astride the boundary, which begin inside the factor and end behind it, are
looked up one by one like all that follow, so a factor of another block may overlap the one before. The words
of the factors are the duplicate spans.

The index of the reference is spread over the cluster by content. Texts are cut at anchors: of the 16-word
grams in a window the one with the smallest hash. Equal windows choose equal anchors, wherever they stand; the
windows that share an anchor form one phrase of 50 to 84 words, one in about 18 words.

1. Phrases are indexed once each with the place of the first. A phrase whose anchor no other phrase has is in
   the reference as a whole, so one lookup extends a factor over all its windows.
2. Where different phrases share an anchor their windows, once for each distinct phrase, are indexed with
   their first places and looked up one by one.
3. What a phrase finds is one row for each diagonal: block, offset of the phrase's start in it, and the
   windows on it as bits. A document's rows meet in its parse.

Hashes of windows have 128 bits. All groups are reduced with partial sums, never gathered; looked-up rows
are joined with tables that hold one row per key, read back from files, so that adaptive execution splits
the rows of a hot passage over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm._tables import Scratch, table, text_key
from auditlake.llm._words import LANES, NOT_SPACE, Slice, Words, find_words, signed, slices, window_starts, word_hashes

WINDOW = 50
ANCHOR = 16


def _window_sums(s: Slice, w: Words) -> list[np.ndarray]:
    return [lane.sums(1, word_hashes(s.data, w, lane)) for lane in LANES]


def _leftmost_smallest(h: np.ndarray, width: int) -> np.ndarray:
    """For each i the place of the smallest of h[i : i + width], the leftmost if equal; by doubling."""
    at, have = np.arange(len(h)), 1
    while have < width:
        step = min(have, width - have)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(h[b] < h[a], b, a)
        have += step
    return at


def _phrases(s: Slice, window: int, anchor: int) -> dict[str, np.ndarray]:
    """text (number in the slice), at (first window, from the text's first word), n (windows), block, a, b (digest)."""
    w = find_words(s, NOT_SPACE)
    starts = window_starts(w, window)
    if not len(starts):
        return {k: np.zeros(0, np.int64) for k in ("text", "at", "n", "block", "a", "b")}
    sums = _window_sums(s, w)
    grams = np.arange(len(w.start) - anchor + 1)
    h = LANES[0].runs(1, sums[0], grams, grams + anchor)
    chosen = _leftmost_smallest(h, window - anchor + 1)[starts]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(chosen) != 0) | (np.diff(starts) != 1)]))
    n = np.diff(np.append(new, len(starts)))
    first = starts[new]
    a, b = (lane.runs(1, x, first, first + n + window - 1) for lane, x in zip(LANES, sums, strict=True))
    text = w.text[first]
    return {"text": text, "at": first - w.upto[text], "n": n, "block": signed(h[chosen[new]]), "a": signed(a), "b": signed(b)}


def _cut_phrases(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column("text")):
                p = _phrases(s, window, anchor)
                rows = pa.array(p["text"] + s.first)
                yield pa.record_batch(
                    [b.column("doc_id").take(rows), b.column("key").take(rows), pa.array(p["at"].astype(np.int32)), pa.array(p["n"].astype(np.int16)), *[pa.array(p[k]) for k in ("block", "a", "b")]],
                    names=["doc_id", "key", "at", "n", "block", "a", "b"],
                )

    return run


def _windows_of(window: int):
    """Digests and places of the windows of each text's listed phrases: at is the first, n how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = b.column("phrases").to_pylist()
            for s in slices(b.column("text")):
                w = find_words(s, NOT_SPACE)
                sums = _window_sums(s, w)
                rows, first, n, pa_, pb = [], [], [], [], []
                for t in range(s.first, s.last):
                    for p in asked[t]:
                        rows.append(t)
                        first.append(w.upto[t - s.first] + p["at"])
                        n.append(p["n"])
                        pa_.append(p["a"])
                        pb.append(p["b"])
                n = np.array(n, np.int64)
                offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = np.repeat(np.array(first, np.int64), n) + offset
                digests = [signed(lane.runs(1, x, start, start + window)) for lane, x in zip(LANES, sums, strict=True)]
                rows = np.repeat(np.array(rows, np.int64), n)
                yield pa.record_batch(
                    [b.column("doc_id").take(pa.array(rows)), b.column("key").take(pa.array(rows)), pa.array(start - w.upto[rows - s.first]), pa.array(np.repeat(np.array(pa_, np.int64), n)), pa.array(np.repeat(np.array(pb, np.int64), n)), pa.array(offset), *map(pa.array, digests)],
                    names=["doc_id", "key", "at", "a", "b", "offset", "wa", "wb"],
                )

    return run


def _lookups(found: dict[str, list[int]]) -> tuple[np.ndarray, ...]:
    """Of a text's windows that an earlier block holds, by position: position, block, the block's key, offset."""
    bits, at = np.array(found["bits"], np.int64), np.array(found["at"], np.int64)
    row, k = np.nonzero((bits[:, None] >> np.arange(62)) & 1)
    pos, block, key, offset = at[row] + k, np.array(found["block"], np.int64)[row], np.array(found["block_key"], np.int64)[row], np.array(found["shift"], np.int64)[row] + k
    order = np.argsort(pos, kind="stable")
    return pos[order], block[order], key[order], offset[order]


def _parse(pos: np.ndarray, block: np.ndarray, key: np.ndarray, offset: np.ndarray, window: int) -> np.ndarray:
    """Factors start, length, block, offset of the greedy parse over a text's lookups.

    A factor begins at the first window behind the last one's windows and takes in the next window as long as
    that is the next one of both text and block. All windows are looked up, those astride a factor's end too.
    """
    ends = np.flatnonzero((np.diff(pos) != 1) | (np.diff(offset) != 1) | (np.diff(block) != 0) | (np.diff(key) != 0))
    first, last = np.append(0, ends + 1), np.append(ends, len(pos) - 1)
    return np.stack([pos[first], last - first + window, block[first], offset[first]], 1)


def _spans(factors: np.ndarray) -> list[int]:
    """Words that the factors cover, as start, end, start, end, ...; factors that touch or overlap are one span."""
    start, end = factors[:, 0], np.maximum.accumulate(factors[:, 0] + factors[:, 1])
    new = np.flatnonzero(start[1:] > end[:-1])
    return np.stack([start[np.append(0, new + 1)], end[np.append(new, len(end) - 1)]], 1).ravel().tolist()


def _kept(words: list[bytes], spans: list[int]) -> list[bytes]:
    gone = np.zeros(len(words), bool)
    for start, end in zip(spans[::2], spans[1::2], strict=True):
        gone[start:end] = True
    return [x for x, g in zip(words, gone.tolist(), strict=True) if not g]


_DIAGONAL = "struct<block: bigint, block_key: bigint, shift: bigint, bits: bigint>"
_FACTOR = "struct<start: bigint, length: bigint, block: bigint, offset: bigint>"


def _remove(window: int):
    names = ("start", "length", "block", "offset")
    factor = pa.list_(pa.struct([(n, pa.int64()) for n in names]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, found = b.column("text").cast(pa.binary()).to_pylist(), b.column("found").to_pylist()
            n_words, factors, spans, kept = [], [], [], []
            for text, own in zip(texts, found, strict=True):
                words = (text or b"").split()  # the white space of bytes.split() is \x20 and \x09-\x0D
                f = _parse(*_lookups(own), window) if own else np.zeros((0, 4), np.int64)
                n_words.append(len(words))
                factors.append([dict(zip(names, row, strict=True)) for row in f.tolist()])
                spans.append(_spans(f) if own else [])
                kept.append(b" ".join(_kept(words, spans[-1]) if own else words))
            yield pa.record_batch(
                [b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(factors, factor), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "factors", "spans", "kept_text"],
            )

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """One row per input row: doc_id, n_words, factors, spans (word positions start, end, ...), kept_text.

    A factor is (start, length, block, offset) in words: `length` words from `start` on are those of document
    `block` from `offset` on. A word goes if a window of `window` words that covers it also starts in a
    document with a smaller doc_id, whatever becomes of that one. Words are [^\\x20\\x09-\\x0D]+; the kept ones
    are joined by one space. Null and short texts keep all they have. Rows that share a doc_id do not count as
    earlier than each other. A null doc_id counts as the largest (2^63 - 1), so nothing is removed on account
    of its text. Empty in, empty out.
    """
    if not anchor < window or window - anchor + 1 > 62:
        raise ValueError("the anchor is shorter than the window, by 61 words at most")
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    given = F.col("doc_id").cast("long")
    rows = docs.select(given.alias("given"), F.coalesce(given, F.lit((1 << 63) - 1)).alias("doc_id"), text_key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))
    phrases = scratch.keep(rows.select("doc_id", "key", "text").mapInArrow(_cut_phrases(window, anchor), "doc_id long, key long, at int, n short, block long, a long, b long"))
    place = F.struct("doc_id", "key", "at")
    index = scratch.keep(phrases.groupBy("block", "a", "b").agg(F.min(place).alias("first"), F.max("doc_id").alias("last"), F.first("n").alias("n")))
    shared = scratch.keep(index.groupBy("block").agg(F.count(F.lit(1)).alias("k"), F.min("first.doc_id").alias("lo"), F.max("last").alias("hi")).filter("k > 1 and lo < hi").select("block"))
    asked = index.join(shared, "block", "left_semi").groupBy(F.col("first.doc_id").alias("_d"), F.col("first.key").alias("_k")).agg(F.collect_list(F.struct(F.col("first.at").alias("at"), "n", "a", "b")).alias("phrases"))
    asked = scratch.keep(asked)
    edges = rows.join(asked, (rows["doc_id"] == asked["_d"]) & (rows["key"] == asked["_k"])).select("doc_id", "key", "text", "phrases")
    windows = scratch.keep(edges.mapInArrow(_windows_of(window), "doc_id long, key long, at long, a long, b long, offset long, wa long, wb long"))
    first = scratch.keep(windows.groupBy("wa", "wb").agg(F.min(place).alias("first"), F.max(place).alias("end")).filter("first < end").select("wa", "wb", "first"))
    # windows whose first place is in another phrase, one row for each phrase and diagonal
    away = windows.join(first, ["wa", "wb"]).filter(F.col("first") < place)
    away = away.groupBy("a", "b", F.col("first.doc_id").alias("block_id"), F.col("first.key").alias("block_key"), (F.col("first.at") - F.col("offset")).alias("shift")).agg(F.bit_or(F.expr("shiftleft(1L, cast(offset as int))")).alias("bits"))
    away = scratch.keep(away.groupBy("a", "b").agg(F.bit_or("bits").alias("elsewhere"), F.collect_list(F.struct(F.col("block_id").alias("block"), "block_key", "shift", "bits")).alias("away")))
    own = F.struct(F.col("first.doc_id").alias("block"), F.col("first.key").alias("block_key"), F.col("first.at").cast("long").alias("shift"), F.expr("(shiftleft(1L, cast(n as int)) - 1L) & ~coalesce(elsewhere, 0L)").alias("bits"))
    diagonals = index.join(away, ["a", "b"], "left").filter("away is not null or first.doc_id < last")
    diagonals = scratch.keep(diagonals.select(F.col("block").alias("anchor"), "a", "b", F.concat(F.array(own), F.coalesce("away", F.array().cast(f"array<{_DIAGONAL}>"))).alias("diagonals")))
    matches = phrases.withColumnRenamed("block", "anchor").join(diagonals, ["anchor", "a", "b"]).select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "at", F.inline("diagonals")).filter("block < _d and bits <> 0")
    # without anchor, a and b the grouping has an exchange of its own, and the join before it can be split where a phrase is hot
    matches = matches.groupBy("_d", "_k").agg(F.collect_set(F.struct("at", "block", "block_key", "shift", "bits")).alias("m"))
    matches = scratch.keep(matches.select("_d", "_k", F.struct(*[F.col(f"m.{c}").alias(c) for c in ("at", "block", "block_key", "shift", "bits")]).alias("found")))
    scratch.drop(phrases, index, shared, asked, windows, first, away, diagonals)
    out = rows.join(matches, (rows["doc_id"] == matches["_d"]) & (rows["key"] == matches["_k"]), "left").select(F.col("given").alias("doc_id"), "text", "found")
    return out.mapInArrow(_remove(window), f"doc_id long, n_words long, factors array<{_FACTOR}>, spans array<bigint>, kept_text string")


def n_removed(spans):
    """Words in the spans, which do not overlap."""
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda acc, x: acc + x)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", n_removed(F.col("spans")).alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (
  SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT md5(g) AS h, min(doc_id) AS lo, max(doc_id) AS hi FROM x GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT x.doc_id, x.i FROM x JOIN f ON md5(x.g) = f.h WHERE f.lo < x.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM hit),
n AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(w, lambda y, i: NOT coalesce(list_contains(ps, i), false)), ' ')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id)
"""
