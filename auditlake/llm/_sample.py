"""Bounded samples of labelled rows to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, folds: int, out: int) -> Column:
    """True for rows that are kept from fitting; rows without an id never are."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == out, F.lit(False))


def sample_texts(docs: DataFrame, labelled: DataFrame, slots: int, characters: int, labels: int = 256) -> list[tuple]:
    """(label, text) of at most `slots` documents of each label, the same in every run.

    labelled: doc_id, label. Only documents with a letter, figure or mark of text count. Ids are hashed into
    slots and the smallest hash of a slot is taken: partial minima, whatever the number of rows of a label. Of
    a longer text `characters` characters are taken, from a place that the id's hash chooses; of rows that
    share an id, the smallest text. Of more than `labels` labels those with most documents are learned. So at
    most slots * labels * characters characters reach the driver, whatever the tables hold.
    """
    draw = lambda: F.xxhash64(F.col("doc_id"), F.lit("sample"))
    texts = docs.filter(F.col("doc_id").isNotNull() & F.col("text").rlike(r"\S"))
    ids = labelled.filter("doc_id is not null and label is not null").select("label", draw().alias("draw")).join(texts.select(draw().alias("draw")), "draw", "left_semi")
    taken = ids.groupBy("label", F.pmod("draw", F.lit(slots)).alias("slot")).agg(F.min("draw").alias("draw"), F.count(F.lit(1)).alias("n"))
    common = taken.groupBy("label").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "label").limit(labels).select("label")
    taken = F.broadcast(taken.join(F.broadcast(common), "label").select("label", "draw"))  # bounded by slots and labels
    start = (F.pmod(F.xxhash64("draw"), F.greatest(F.length("text") - characters, F.lit(0)) + 1) + 1).cast("int")
    piece = texts.select(draw().alias("draw"), F.col("text").cast("string").alias("text")).select("draw", F.substring("text", start, F.lit(characters)).alias("text"))
    rows = piece.join(taken, "draw").groupBy("label", "draw").agg(F.min("text").alias("text")).collect()
    return [(r.label, r.text) for r in sorted(rows, key=lambda r: (r.draw, str(r.label), r.text))]
