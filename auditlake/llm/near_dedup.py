"""Near duplicates by BagMinHash: bags of five-word shingles, banded signatures, verified multiset overlap.

Weights are the shingles' counts. Each (shingle, dyadic weight interval) is a Poisson process whose rate is
the interval's width and whose points carry a time, a register and a level within the interval. The process
of the topmost interval, which a weight may cover only in part, is thinned: points above the weight are passed
over, less than half of them, which leaves the process of the part that is covered. A register holds its
earliest point, so two bags agree in a register with a chance equal to their weighted Jaccard similarity.
Points are drawn only up to the time by which all registers are filled.

Bags that are equal are one vertex. Bands of registers put vertices into buckets. Within a bucket no pairs
are listed: one pivot is compared with the members, and the verified links are closed to components. Buckets
that then lie in one component are done. In the others the vertices outside the largest component look for
all their partners by an exact prefix join over rare shingles first, however large the bucket is. So each
link between members of a bucket is either verified or implied. Where that join meets two bags, 512 bits of
each bound their difference from below; only what they leave open is a pair, and only pairs move bags.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm._graph import components
from auditlake.llm._tables import Scratch, table, text_key
from auditlake.llm._words import LANES, LOWER, NOT_SPACE, U, Slice, find_words, mix, signed, slices, window_starts, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 5
BANDS_PER_DOUBLING = 16  # of bag sizes, in the prefix join
EPSILON = 1e-9
SKETCH = 8  # words of 64 bits
GOLD = U(0x9E3779B97F4A7C15)


def shingles(s: Slice, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and hashes of all shingles, one for a text of fewer than n words but one or more."""
    s.data = LOWER[s.data]
    w = find_words(s, NOT_SPACE)
    size = np.diff(w.upto)
    sums = LANES[0].sums(1, word_hashes(s.data, w, LANES[0]))
    first = window_starts(w, n)
    short = np.flatnonzero((size > 0) & (size < n))
    first, length = np.append(first, w.upto[short]), np.append(np.full(len(first), n), size[short])
    return np.append(w.text[first[: len(first) - len(short)]] if len(first) else first, short), LANES[0].runs(1, sums, first, first + length)


def bags(s: Slice, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text numbers, hashes and counts of the distinct shingles, by text and hash."""
    text, h = shingles(s, n)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(text) != 0) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
    return text[new], h[new], np.diff(np.append(new, len(h)))


def bag_minhash(text: np.ndarray, h: np.ndarray, count: np.ndarray, n_texts: int, m: int) -> np.ndarray:
    """Registers (n_texts x m) of the ids of the earliest points. Rows of texts without shingles are 0."""
    weight = np.bincount(text, count, n_texts)
    horizon = m / np.maximum(weight, 1) * (np.log(m) + 3)
    out, todo = np.zeros((n_texts, m), U), np.flatnonzero(weight > 0)
    intervals = 1 + np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)
    who = np.repeat(np.arange(len(h)), intervals)
    level = np.arange(len(who)) - np.repeat(np.cumsum(intervals) - intervals, intervals)
    width = np.where(level == 0, 1, 1 << np.maximum(level - 1, 0)).astype(np.int64)
    base = np.where(level == 0, 0, width)
    process, of, most = mix(h[who] + (level.astype(U) + U(1)) * U(0xD1B54A32D192ED03)), text[who], count[who]
    while len(todo):
        mine = np.isin(of, todo) if len(todo) < n_texts else slice(None)
        sig, time = np.zeros(n_texts * m, U), np.full(n_texts * m, np.inf)
        p = [x[mine] for x in (process, of, width, base, most)]
        many = p[2] * horizon[p[1]] > 12
        for rows, block in ((~many, 1), (many, 64)):
            _draw(*[x[rows] for x in p], horizon, m, block, time, sig)
        filled = np.isfinite(time.reshape(n_texts, m)).all(1)
        done = todo[filled[todo]]
        out[done] = sig.reshape(n_texts, m)[done]
        todo = todo[~filled[todo]]
        horizon[todo] *= 2
    return out


def _draw(process, of, width, base, most, horizon, m: int, block: int, time: np.ndarray, sig: np.ndarray) -> None:
    """Draws points in order of time, `block` at once from each process, as long as they come before the horizon."""
    x, k = np.zeros(len(process)), 0
    with np.errstate(over="ignore"):
        while len(process):
            point = mix(process[:, None] + np.arange(k + 1, k + 1 + block, dtype=U)[None, :] * GOLD)
            gap = -np.log(((point >> U(11)).astype(np.float64) + 1) * 2.0**-53) / width[:, None]
            gap[:, 0] += x
            at = np.cumsum(gap, axis=1)
            r = mix(point ^ U(0xA0761D6478BD642F))
            ok = (at <= horizon[of][:, None]) & (base[:, None] + (r & (width[:, None] - 1).astype(U)).astype(np.int64) < most[:, None])
            i, j = np.nonzero(ok)
            slot = of[i] * m + (((r[i, j] >> U(32)) * U(m)) >> U(32)).astype(np.int64)
            t = at[i, j]
            np.minimum.at(time, slot, t)
            first = time[slot] == t
            sig[slot[first]] = point[i, j][first]
            live = at[:, -1] <= horizon[of]
            process, of, width, base, most, x = process[live], of[live], width[live], base[live], most[live], at[live, -1]
            k += block


def _signatures(n: int, bands: int, rows: int):
    """Per text the size and digest of its bag, and a hash of each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, bands + 1, dtype=U) * GOLD)
        for b in batches:
            for s in slices(b.column("text"), 1 << 19):
                size = s.last - s.first
                text, h, count = bags(s, n)
                weight = np.bincount(text, count, size).astype(np.int64)
                digest = []
                for c in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
                    total = np.concatenate([[U(0)], np.cumsum(mix(mix(h ^ U(c)) + count.astype(U)))])
                    upto = np.searchsorted(text, np.arange(size + 1))
                    digest.append(signed(total[upto[1:]] - total[upto[:-1]]))
                sig = bag_minhash(text, h, count, size, bands * rows).reshape(size, bands, rows)
                key = np.broadcast_to(salt, (size, bands)).copy()
                for r in range(rows):
                    key = mix(key * GOLD + sig[:, :, r])
                key[weight == 0] = 0
                own = b.slice(s.first, size)
                band = pa.FixedSizeListArray.from_arrays(pa.array(signed(key).ravel()), bands).cast(pa.list_(pa.int64()))
                yield pa.record_batch([own.column("doc_id"), own.column("key"), pa.array(weight), *map(pa.array, digest), band], names=["doc_id", "key", "n", "a", "b", "bands"])

    return run


def _bag_items(n: int):
    """Per text its bag as a set, the i-th occurrence of a shingle being an item of its own, and the set's parities.

    Each item turns over one of the sketch's bits. The items that two sets share turn over the same bits, so the
    bits in which their sketches differ are no more than the items in which the sets do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column("text")):
                size = s.last - s.first
                text, h, count = bags(s, n)
                nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                items = mix(np.repeat(h, count) + nth.astype(U) * GOLD)
                upto = np.searchsorted(np.repeat(text, count), np.arange(size + 1))
                lists = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(signed(items)))
                bit, sketch = mix(items ^ GOLD) % U(64 * SKETCH), np.zeros(size * SKETCH, U)
                np.bitwise_xor.at(sketch, np.repeat(text, count) * SKETCH + (bit >> U(6)).astype(np.int64), U(1) << (bit & U(63)))
                sketches = pa.ListArray.from_arrays(pa.array(np.arange(0, size * SKETCH + 1, SKETCH, dtype=np.int32)), pa.array(signed(sketch)))
                yield pa.record_batch([b.slice(s.first, size).column("v"), lists, sketches], names=["v", "items", "sketch"])

    return run


def _verified(pairs: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) at or above the similarity. Only one bag a pair is shuffled: the pivot's comes last.

    Merge joins at every size: a small side today is no promise for a larger corpus, and hot pivots are split.
    """
    left, right = items.select(F.col("v"), F.col("items").alias("_b")), items.select(F.col("v").alias("u"), F.col("items").alias("_a"))
    both = pairs.hint("merge").join(left, "v").hint("merge").join(right, "u")
    same = F.size(F.array_intersect("_a", "_b"))
    return both.filter(same >= similarity * (F.size("_a") + F.size("_b") - same)).select("u", "v")


def _stars(buckets: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (u, v) of each bucket's pivot with its members. buckets: bucket, v, count.

    The pivot is the member that shares most buckets with most others: of the copies of one text the least
    changed, to which the rest are likeliest linked. It tends to be the same one in all of their buckets.
    """
    reach = buckets.groupBy("v").agg(F.sum("count").alias("reach"))
    best = F.max(F.struct("reach", (-F.col("v")).alias("order")))
    pivots = scratch.keep(buckets.join(reach, "v").groupBy("bucket").agg((-best["order"]).alias("u")))
    return buckets.join(pivots.hint("merge"), "bucket").filter("u <> v").select("u", "v").distinct()


def _ordered_prefixes(bags_: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """v, label, outside, n, sketch and prefix: the bag's rarest items, as many as a link can do without plus one.

    Bags that overlap in o items have one in common among the n - o + 1 first items of either, whatever the
    order, as long as it is the same for all. With the rarest first, what many bags share comes last.
    """
    each = scratch.keep(bags_.select("v", F.explode("items").alias("item")))
    often = scratch.keep(each.groupBy("item").agg(F.count(F.lit(1)).alias("often")))
    sorted_ = each.join(often.hint("merge"), "item").groupBy("v").agg(F.sort_array(F.collect_list(F.struct("often", "item"))).alias("l"))
    sorted_ = sorted_.join(bags_.select("v", "label", "outside", "sketch", F.size("items").alias("n")).hint("merge"), "v")
    short = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - EPSILON) + 1
    out = scratch.keep(sorted_.select("v", "label", "outside", F.col("n").cast("long").alias("n"), "sketch", F.transform(F.slice("l", F.lit(1), short.cast("int")), lambda x: x["item"]).alias("prefix")))
    scratch.drop(each, often)
    return out


def _remaining(prefixes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) of an outside vertex with any vertex of another label that can still be linked: none is missed.

    The overlap that a link of sizes n and m takes is share * (n + m), so the two prefixes are shorter the larger
    the partner is. Items are met together with a band of the partner's size, and the exact lengths decide. Then
    the sketches do: a link's bags differ in n + m - 2 * overlap items at most. All that is within the join, so what
    leaves it is little more than the links; families of texts in which few are linked cost it time, not rows.
    """
    share = F.lit(similarity / (1 + similarity))
    band = lambda n: F.floor(F.lit(BANDS_PER_DOUBLING) * F.log2(n))
    least, most = F.ceil(F.lit(similarity) * F.col("n") - EPSILON), F.floor(F.col("n") / F.lit(similarity) + EPSILON)
    a = prefixes.filter("outside").select("v", "label", "n", "sketch", "prefix", least.alias("least"), F.explode(F.sequence(band(least), band(most))).alias("band"))
    smallest = F.greatest(F.col("least"), F.ceil(F.pow(F.lit(2.0), F.col("band") / F.lit(BANDS_PER_DOUBLING)) - EPSILON))
    length = F.least(F.col("n") - F.ceil(share * (F.col("n") + smallest) - EPSILON) + 1, F.size("prefix"))
    a = a.withColumn("length", length).filter("length > 0").select(F.col("v").alias("u"), F.col("label").alias("_label"), F.col("n").alias("_n"), F.col("sketch").alias("_sketch"), "band", F.posexplode(F.slice("prefix", F.lit(1), F.col("length").cast("int"))).alias("_at", "item"))
    b = prefixes.select("v", "label", "n", "sketch", band(F.col("n")).alias("band"), F.posexplode("prefix").alias("at", "item"))
    overlap = F.ceil(share * (F.col("n") + F.col("_n")) - EPSILON)
    differ = sum((F.bit_count(F.get("sketch", F.lit(k)).bitwiseXOR(F.get("_sketch", F.lit(k)))) for k in range(SKETCH)), F.lit(0))
    near = differ <= F.col("n") + F.col("_n") - 2 * overlap
    both = a.join(b, ["item", "band"]).filter((F.col("u") != F.col("v")) & (F.col("label") != F.col("_label")) & (F.col("_at") <= F.col("_n") - overlap) & (F.col("at") <= F.col("n") - overlap) & near)
    return both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _closed(buckets: DataFrame, items: DataFrame, similarity: float, scratch: Scratch) -> DataFrame | None:
    """v, component over all links that buckets (bucket, v, count) can show; None if there is no link.

    After the stars a bucket is settled if it lies in one component. In any other, each pair of components
    has a vertex outside the bucket's largest component, so the links of these vertices are all that can be
    missing; they are found by an exact prefix join, whose size follows the number of such vertices.
    """
    stars = scratch.keep(_stars(buckets, scratch))
    found = scratch.keep(_verified(stars, items, similarity))
    labels = None if found.isEmpty() else components(found, scratch)
    members = buckets.withColumn("label", F.col("v")) if labels is None else buckets.join(labels.hint("merge"), "v", "left").select("bucket", "v", F.coalesce("component", "v").alias("label"))
    members = scratch.keep(members.select("bucket", "v", "label"))
    parts = scratch.keep(members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k")))
    unsettled = scratch.keep(parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("k", "label")).alias("top")).filter("parts > 1").select("bucket", F.col("top.label").alias("top")))
    left = members.join(unsettled.hint("merge"), "bucket").groupBy("v").agg(F.min("label").alias("label"), F.max(F.col("label") != F.col("top")).alias("outside"))
    bags_ = scratch.keep(items.join(scratch.keep(left).hint("merge"), "v"))
    scratch.drop(members, parts, unsettled)
    prefixes = _ordered_prefixes(bags_, similarity, scratch)
    pairs = _remaining(prefixes, similarity)
    pairs = scratch.keep(pairs.join(stars.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), ["u", "v"], "left_anti"))
    scratch.drop(bags_, prefixes, stars)
    more = scratch.keep(_verified(pairs, items, similarity))
    scratch.drop(pairs)
    if more.isEmpty():
        return labels
    # labels stand for the links before: a vertex is linked with its component
    return components(more if labels is None else more.unionByName(labels.select(F.col("component").alias("u"), "v")), scratch)


def near_duplicates(docs: DataFrame, n: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, key, class_id, class_size, kept.

    Bags are of n-word shingles of the A-Z-lower-cased words [^\\x20\\x09-\\x0D]+ with their counts; a text of
    fewer words has one shingle. Documents are linked at a weighted Jaccard similarity of `similarity` or
    more, and classes are the connected components. class_id is the class's smallest doc_id, whose document
    stays (null comes last; of rows that share it the one with the smallest text key, and repeated rows all).
    Null texts and texts without words are not linked to anything. Empty in, empty out.
    With 32 bands of 5 rows two bags at the threshold share no bucket in 3 of a million cases.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))
    sig = scratch.keep(texts.mapInArrow(_signatures(n, bands, rows), "doc_id long, key long, n long, a long, b long, bands array<bigint>"))
    place = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "key")
    vertices = sig.filter("n > 0").groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("size"), F.first("bands").alias("bands"))
    vertices = scratch.keep(vertices.withColumn("v", F.monotonically_increasing_id()))
    each = vertices.select("v", F.explode("bands").alias("bucket"))
    shared = scratch.keep(each.groupBy("bucket").count().filter("count > 1"))
    buckets = scratch.keep(each.join(shared.hint("merge"), "bucket"))
    needed = scratch.keep(buckets.select("v").distinct().join(vertices, "v").select("v", F.col("first.doc_id").alias("_d"), F.col("first.key").alias("_k")))
    bag = texts.join(needed.hint("merge"), texts["doc_id"].eqNullSafe(needed["_d"]) & (texts["key"] == needed["_k"])).select("v", "text")
    items = scratch.keep(bag.mapInArrow(_bag_items(n), "v long, items array<bigint>, sketch array<bigint>").dropDuplicates(["v"]))
    labels = _closed(buckets, items, similarity, scratch)
    if labels is None:
        labels = spark.createDataFrame([], "v long, component long")
    named = scratch.keep(vertices.join(labels, "v", "left").select("a", "b", "first", "size", F.coalesce("component", "v").alias("component")))
    heads = scratch.keep(named.groupBy("component").agg(F.min("first").alias("head"), F.sum("size").alias("class_size")))
    named = scratch.keep(named.join(heads, "component").select("a", "b", "head", "class_size"))
    scratch.drop(shared, buckets, needed, items, vertices, heads)
    linked = sig.filter("n > 0").join(named, ["a", "b"]).select("doc_id", "key", F.col("head.doc_id").alias("class_id"), "class_size", (F.col("head") == place).alias("kept"))
    alone = sig.filter("n = 0").select("doc_id", "key", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns; of repeated rows, one."""
    stay = near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("__doc"), F.col("key").alias("__key"))
    stay = Scratch(docs.sparkSession, "near").keep(stay)
    out = docs.withColumn("__text_key", text_key(F.col("text")))
    out = out.join(stay, out["doc_id"].cast("long").eqNullSafe(stay["__doc"]) & (out["__text_key"] == stay["__key"]), "left_semi")
    if not stay.groupBy("__doc", "__key").count().filter("count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "__text_key"])
    return out.drop("__text_key")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")
