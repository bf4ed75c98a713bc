"""Benchmark decontamination with a broadcast hash set of normalised n-grams.

The benchmark's windows of 8 words go to all executors as one sorted array of hashes; each text's windows
are hashed in the same way, looked up, and every hit is compared word by word with the item before it
counts. The benchmark is a query set of its own size, which does not grow with the corpus. It is cut into
blocks of at most `block_words` words, which bounds what is broadcast at once; with more than one block the
texts are scanned once a block and the positions of all blocks are merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm._tables import Scratch, table, text_key
from auditlake.llm._words import ALNUM, LANES, LOWER, Slice, Words, find_words, slices, window_starts, word_hashes

WINDOW = 8
BLOCK_WORDS = 2_000_000


def _lowered(s: Slice) -> Slice:
    s.data = LOWER[s.data]
    return s


class Block:
    """Windows of some items: for each length its sorted hashes, the item and the first word of each window."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.ids = [i for i, _ in items]
        self.data, self.start, self.end, self.by_length = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), {}
        texts = pa.array([t for _, t in items], pa.string())
        found: dict[int, list] = {}
        at = word = 0
        for s in map(_lowered, slices(texts)):
            w = find_words(s, ALNUM)
            h = word_hashes(s.data, w, LANES[0])
            sums = LANES[0].sums(1, h)
            size = np.diff(w.upto)
            for n in sorted({window} | set(size[(size > 0) & (size < window)].tolist())):
                j = window_starts(w, n)
                j = j if n == window else j[size[w.text[j]] == n]
                found.setdefault(n, []).append((LANES[0].runs(1, sums, j, j + n), w.text[j] + s.first, j + word))
            self.data = np.append(self.data, s.data)
            self.start, self.end = np.append(self.start, w.start + at), np.append(self.end, w.end + at)
            at, word = at + len(s.data), word + len(w.start)
        for n, parts in found.items():
            h, item, first = (np.concatenate([p[k] for p in parts]) for k in range(3))
            order = np.argsort(h, kind="stable")
            if len(order):
                self.by_length[n] = h[order], item[order], first[order]

    def occurrences(self, s: Slice, w: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, first words in the slice, items) of all windows that occur, each verified byte by byte."""
        sums = LANES[0].sums(1, word_hashes(s.data, w, LANES[0]))
        for n, (known, item, first) in self.by_length.items():
            j = window_starts(w, n)
            h = LANES[0].runs(1, sums, j, j + n)
            lo = np.searchsorted(known, h, side="left")
            hit = np.flatnonzero((lo < len(known)) & (known[np.minimum(lo, len(known) - 1)] == h))
            if not len(hit):
                continue
            j, lo = j[hit], lo[hit]
            many = np.searchsorted(known, h[hit], side="right") - lo
            who = np.repeat(np.arange(len(j)), many)
            entry = np.repeat(lo, many) + np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
            same = np.fromiter((self._same(s, w, a, b, n) for a, b in zip(j[who].tolist(), first[entry].tolist(), strict=True)), bool, len(who))
            yield n, j[who[same]], item[entry[same]]

    def _same(self, s: Slice, w: Words, a: int, b: int, n: int) -> bool:
        for k in range(n):
            x, y = s.data[w.start[a + k] : w.end[a + k]], self.data[self.start[b + k] : self.end[b + k]]
            if len(x) != len(y) or not np.array_equal(x, y):
                return False
        return True


@lru_cache(2)
def _block(items: tuple, window: int) -> Block:
    return Block(list(items), window)


def _scan(shared, window: int):
    """Per text: its words, the hit words as runs (start, end), and the items that occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _block(shared.value, window)
        for b in batches:
            n_words, runs, items = [], [], []
            for s in map(_lowered, slices(b.column("text"))):
                w = find_words(s, ALNUM)
                size = np.diff(w.upto)
                edge, seen = np.zeros(len(w.start) + 1, np.int64), {}
                for n, j, item in block.occurrences(s, w):
                    np.add.at(edge, j, 1)
                    np.add.at(edge, j + n, -1)
                    for t, i in zip(w.text[j].tolist(), item.tolist(), strict=True):
                        seen.setdefault(t, set()).add(i)
                hit = np.cumsum(edge[:-1]) > 0
                n_words += size.tolist()
                for t in range(len(size)):
                    if t not in seen:
                        runs.append([])
                        items.append([])
                        continue
                    own = np.flatnonzero(np.diff(np.concatenate([[False], hit[w.upto[t] : w.upto[t + 1]], [False]]).astype(np.int8)))
                    runs.append(own.tolist())
                    items.append(sorted({block.ids[i] for i in seen[t]} - {None}))
            yield pa.record_batch(
                [b.column("doc_id"), b.column("key"), pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                names=["doc_id", "key", "n_words", "runs", "items"],
            )

    return run


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[tuple]:
    """Rows with a null text have no windows. One block is in the driver's memory at a time."""
    block, words = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).dropna(subset="t").toLocalIterator():
        n = len(r.t) // 2 + 1
        if block and words + n > block_words:
            yield tuple(block)
            block, words = [], 0
        block.append((r.i, r.t))
        words += n
    yield tuple(block)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per input row: doc_id, key, n_words, n_hit, runs (word positions start, end, ...), items (sorted).

    Null and empty texts have no words and no hits; an item shorter than the window counts as one window,
    one without words as none; items that share a text all count. The words of an item with a null id are hit
    like any, but it has no id to list and is not counted. With an empty benchmark nothing is hit.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id"), text_key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))
    schema = rows.select("doc_id", "key").withColumns({"n_words": F.lit(0).cast("long"), "runs": F.array(F.lit(0).cast("long")), "items": F.array(F.lit(""))}).schema
    scans = [rows.mapInArrow(_scan(spark.sparkContext.broadcast(b), window), schema) for b in _blocks(benchmark, block_words)]
    if len(scans) > 1:
        scratch = Scratch(spark, "decontaminate")
        parts = [scratch.keep(s) for s in scans]
        hits = parts[0].filter("size(runs) > 0")
        for p in parts[1:]:
            hits = hits.unionByName(p.filter("size(runs) > 0"))
        merged = hits.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        merged = scratch.keep(merged.mapInArrow(_merge_runs, merged.schema))
        base = parts[0].select("doc_id", "key", "n_words")
        m = merged.select(F.col("doc_id").alias("__doc"), F.col("key").alias("__key"), "runs", "items")
        found = base.join(m, base["doc_id"].eqNullSafe(m["__doc"]) & (base["key"] == m["__key"]), "left").select(
            "doc_id", "key", "n_words", F.coalesce("runs", F.array().cast("array<bigint>")).alias("runs"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
        )
    else:
        found = scans[0]
    hit = F.aggregate(F.sequence(F.lit(0), F.greatest(F.size("runs") / 2 - 1, F.lit(0)).cast("int")), F.lit(0).cast("long"), lambda a, i: a + F.coalesce(F.try_element_at("runs", 2 * i + 2) - F.try_element_at("runs", 2 * i + 1), F.lit(0)))
    return found.withColumn("n_hit", hit)


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for runs in b.column("runs").to_pylist():
            merged: list[int] = []
            for start, end in sorted(zip(runs[::2], runs[1::2], strict=True)):
                if merged and start <= merged[-1]:
                    merged[-1] = max(merged[-1], end)
                else:
                    merged += [start, end]
            out.append(merged)
        yield pa.record_batch([pa.array(out, b.schema.field(n).type) if n == "runs" else b.column(n) for n in b.schema.names], names=b.schema.names)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the hit words; each removed span leaves one space."""
    for b in batches:
        out = []
        for text, runs in zip(b.column("text").to_pylist(), b.column("__runs").to_pylist(), strict=True):
            if runs:
                raw = text.encode()
                s = next(iter(slices(pa.array([text], pa.string()))))
                w = find_words(_lowered(s), ALNUM)
                parts, at = [], 0
                for start, end in zip(runs[::2], runs[1::2], strict=True):
                    parts.append(raw[at : w.start[start]])
                    at = w.end[end - 1]
                text = b" ".join([p.strip() for p in [*parts, raw[at:]]]).strip().decode()
            out.append(text)
        yield pa.record_batch([pa.array(out, b.schema.field(n).type) if n == "text" else b.column(n) for n in b.schema.names], names=b.schema.names)


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_items: int = 2, spans: bool = True) -> DataFrame:
    """`docs` without documents that hold windows of `min_items` items or more.

    With `spans`, hit words of the others are cut out of their texts, n_chars (if there is such a column) is
    set anew for these, and a text of nothing else goes; without, they stay as they are. Other rows are not
    changed. Repeated rows fare alike.
    """
    found = find_contamination(docs, benchmark).filter("n_hit > 0").dropDuplicates(["doc_id", "key"])
    found = Scratch(docs.sparkSession, "decontaminate").keep(
        found.select(F.col("doc_id").alias("__doc"), F.col("key").alias("__key"), F.col("runs").alias("__runs"), F.size("items").alias("__n"), (F.col("n_hit") == F.col("n_words")).alias("__all"))
    )
    keyed = docs.withColumn("__text_key", text_key(F.col("text")))
    both = keyed.join(found, keyed["doc_id"].eqNullSafe(found["__doc"]) & (keyed["__text_key"] == found["__key"]), "left").filter(F.coalesce(F.col("__n"), F.lit(0)) < min_items)
    names = docs.columns
    if not spans:
        return both.select(*names)
    both = both.filter(~F.coalesce(F.col("__all"), F.lit(False))).select(*names, "__runs")
    cut = both.mapInArrow(_cut, both.schema)
    if "n_chars" in names:
        cut = cut.withColumn("n_chars", F.when(F.col("__runs").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return cut.select(*names)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated")
    )


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LIST = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_LIST} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 8) AS n, array_to_string(w[i : i + least(len(w), 8) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM bw),
d AS (SELECT doc_id, {_LIST} AS w FROM documents),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM h GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
