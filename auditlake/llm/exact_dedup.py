"""Exact duplicates by MSD radix partitioning.

Each round splits every group by its texts' next bytes, the digit. Only counts and the largest row number
of each (group, digit) are gathered, with partial sums before the shuffle, so a group of any size costs one
row a task. Groups of one leave at once; a group whose texts have ended is a class of equal texts. Digits
grow sixteenfold from round to round, so a text of n bytes is done after log16(n) rounds, and each of its
bytes is compared once: equality rests on the bytes themselves, no digest is involved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm._tables import Scratch, table, text_key

FIRST_DIGIT = 128
DIGIT_GROWTH = 16


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lower-cases A-Z only; bytes.lower() leaves all bytes over 0x7F as they are."""
    for b in batches:
        texts = [(t or b"").lower() for t in b.column("text").cast(pa.binary()).to_pylist()]
        yield pa.record_batch(
            [b.column("doc_id"), b.column("key"), b.column("row"), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(np.fromiter(map(len, texts), np.int64, len(texts))), pa.array(texts, pa.binary())],
            names=["doc_id", "key", "row", "text_sha256", "left", "rest"],
        )


def _classes(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per input row: doc_id, key (of the text), keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    todo = scratch.keep(rows.mapInArrow(_normalise, "doc_id long, key long, row long, text_sha256 string, left long, rest binary")).withColumn("group", F.lit(0).cast("long"))
    digit, done = FIRST_DIGIT, []
    while True:
        cut = todo.withColumn("digit", F.substring("rest", 1, digit)).withColumn("ends", F.col("left") <= digit)
        groups = scratch.keep(cut.groupBy("group", "digit", "ends").agg(F.max("row").alias("next"), F.count(F.lit(1)).alias("size")))
        split = cut.join(groups, ["group", "digit", "ends"]).select(
            "doc_id", "key", "row", "text_sha256", F.col("next").alias("group"), "size", (F.col("ends") | (F.col("size") == 1)).alias("final"), (F.col("left") - digit).alias("left"),
            F.when(~F.col("ends") & (F.col("size") > 1), F.expr(f"substring(rest, {digit + 1})")).alias("rest"),
        )
        split = scratch.keep(split)
        done.append(split.filter("final").select("doc_id", "key", "row", "text_sha256", "group", "size"))
        more = split.filter("not final").select("doc_id", "key", "row", "text_sha256", "left", "rest", "group")
        if more.isEmpty():
            break
        todo, digit = more, digit * DIGIT_GROWTH
    members = done[0]
    for d in done[1:]:
        members = members.unionByName(d)
    copies = members.filter("size > 1")
    keepers = scratch.keep(copies.groupBy("group").agg(F.max(F.struct("doc_id", "row")).alias("keep")))
    single = members.filter("size = 1").select("doc_id", "key", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return single.unionByName(
        copies.join(keepers, "group").select("doc_id", "key", F.col("keep.doc_id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("keep.row") == F.col("row")).alias("kept"), "text_sha256")
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so null and empty texts
    are one group. The row with the largest doc_id stays (a null doc_id is the smallest); of rows that
    share that doc_id too, exactly one stays. Other columns of the input are not looked at. An empty input
    gives an empty result.
    """
    return _classes(docs, Scratch(docs.sparkSession, "exact")).drop("key")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay (see exact_groups), with all their columns.

    Texts are read where they lie; only rows that are repeated with their doc_id, of which one stays, are shuffled.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    classes = scratch.keep(_classes(docs, scratch).select(F.col("doc_id").alias("__doc"), F.col("key").alias("__key"), "kept", (F.col("group_size") > 1).alias("copied")))
    repeated = scratch.keep(classes.filter("copied").groupBy("__doc", "__key").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")).filter("n > 1"))
    stay = classes.filter("kept").select("__doc", "__key")
    keyed = docs.withColumn("__text_key", text_key(F.col("text")))
    among = lambda some: keyed.join(some, keyed["doc_id"].cast("long").eqNullSafe(some["__doc"]) & (keyed["__text_key"] == some["__key"]), "left_semi")
    if repeated.isEmpty():
        return among(stay).drop("__text_key")
    one = among(repeated.filter("kept")).dropDuplicates(["doc_id", "__text_key"])
    single = stay.join(repeated.select(F.col("__doc").alias("_d"), F.col("__key").alias("_k")), F.col("__doc").eqNullSafe(F.col("_d")) & (F.col("__key") == F.col("_k")), "left_anti")
    return among(scratch.keep(single)).unionByName(one).drop("__text_key")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
