"""Compression classifier: two zstandard dictionaries, one of good and one of bad text.

A text is compressed in short blocks with each dictionary; how much smaller it gets with the good one, per
byte, says which kind of text it resembles. A logistic curve over that difference alone, fitted on texts the
dictionaries have not seen, makes it a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm._sample import held_out, sample_texts
from auditlake.llm._tables import table, text_key

SLOTS = 2000  # labelled texts of each class that a model is fitted on, at most
CHARACTERS = 100_000  # of each of them, at most
DICTIONARY_BYTES = 112_640
BLOCK_BYTES = 256
LEVEL = 3
THRESHOLD = 0.7


class Model:
    """dictionaries: (good, bad), or None where a class has no text; then `prior`, the share of good ones, is the score."""

    def __init__(self, dictionaries: tuple[bytes, bytes] | None, rise: float, height: float, prior: float):
        self.dictionaries, self.rise, self.height, self.prior = dictionaries, rise, height, prior


@lru_cache(4)
def _compressors(dictionaries: tuple[bytes, bytes]) -> list:
    out = []
    for raw in dictionaries:
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def differences(dictionaries: tuple[bytes, bytes], texts: list[bytes]) -> np.ndarray:
    """Bytes that a text takes more with the bad dictionary than with the good one, per byte; each text is taken whole, block by block."""
    good, bad = _compressors(dictionaries)
    out = np.zeros(len(texts))
    for k, t in enumerate(texts):
        more = 0
        for i in range(0, len(t), BLOCK_BYTES):
            block = t[i : i + BLOCK_BYTES]
            more += len(bad.compress(block)) - len(good.compress(block))
        out[k] = more / max(len(t), 1)
    return out


def score_texts(model: Model, texts: list[bytes]) -> np.ndarray:
    if model.dictionaries is None:
        out = np.full(len(texts), model.prior)
    else:
        out = 1 / (1 + np.exp(-np.clip(model.rise * differences(model.dictionaries, texts) + model.height, -50, 50)))
    out[[not t.strip() for t in texts]] = 0.0
    return out


def _dictionary(texts: list[bytes]) -> bytes:
    pieces = [t[i : i + BLOCK_BYTES] for t in texts for i in range(0, len(t), BLOCK_BYTES)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text for its trainer: the text itself can serve
        return b"\n".join(pieces)[-DICTIONARY_BYTES:].ljust(8)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Rise and height of the curve, with a slight pull towards none, so that well parted classes do not make it a step."""
    centre, spread = x.mean(), x.std() + 1e-9
    a, w, pull = np.column_stack([np.ones(len(x)), (x - centre) / spread]), np.zeros(2), 0.05
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        w += np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + pull * np.eye(2), a.T @ (y - p) - pull * w)
    rise = max(float(w[1] / spread), 0.0)
    return rise, float(w[0] - rise * centre)


def fit(labelled: list[tuple[int, str]]) -> Model:
    """labelled: (1 good or 0 bad, text). Three of four texts of a class make its dictionary, the fourth ones the curve; a single text makes both."""
    by = {y: [t.encode() for label, t in labelled if label == y and t.strip()] for y in (1, 0)}
    n = {y: len(t) for y, t in by.items()}
    prior = n[1] / (n[0] + n[1]) if n[0] + n[1] else 0.5
    if not min(n.values()):
        return Model(None, 0.0, 0.0, prior)
    made = tuple(_dictionary([t for k, t in enumerate(by[y]) if k % 4 or n[y] == 1]) for y in (1, 0))
    rest = {y: by[y][::4] for y in (1, 0)}
    x = differences(made, rest[1] + rest[0])
    return Model(made, *_logistic(x, np.repeat([1.0, 0.0], [len(rest[1]), len(rest[0])])), prior)


def fit_on(docs: DataFrame, labels: DataFrame, slots: int = SLOTS, characters: int = CHARACTERS) -> Model:
    """Learns from rows whose crc32(doc_id) mod 4 is not 2, from at most `slots` texts of each class and `characters` of each text.

    The sample keeps the classes' sizes only up to the bound; the share of good rows among all labelled ones
    then moves the curve, so that scores stay probabilities.
    """
    rows = labels.filter(~held_out(F.col("doc_id"), 4, 2) & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("label"))
    model = fit(sample_texts(docs, rows, slots, characters))
    count = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if model.dictionaries is not None:
        model.height += float(np.log(count[1] / count[0]) - np.log(model.prior / (1 - model.prior)))
    return model


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.record_batch([pa.array(score_texts(shared.value, texts)) if n == "score" else b.column(n) for n in [*b.schema.names[:-1], "score"]], names=[*b.schema.names[:-1], "score"])

    return run


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, key and score of every row, 0 to 1. Null and blank texts score 0: there is nothing good in them.

    Without labelled texts of both classes all others score the share of good ones among those labelled, 0.5 if there are none.
    """
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))
    schema = rows.select("doc_id", "key", F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` whose score reaches the threshold, with all their columns. Scoring needs no shuffle.

    Null and blank texts score 0 and go. Where the labels know no text of one of the two classes, as where they are
    empty, there is no classifier, and nothing is rejected.
    """
    model = fit_on(docs, labels)
    if model.dictionaries is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield b.filter(pa.array(score_texts(shared.value, texts) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_on(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
