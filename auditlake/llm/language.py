"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of five-letter sequences over lower-cased letters and word gaps. Counts lie in
arrays sorted by the hash of the sequence. The sequences that any language has seen are put in one such
array with their log probability in every language; sequences new to all fall back on the models' lower
orders. The language with the lowest cross-entropy per letter wins. How far it is ahead, and how usual its
entropy is for a text of that length, become a score. Its curve is fitted on texts that the models have not
seen, each once as it is and once with its own language left out, which is what a text of an unknown language
looks like. A text that scores under 0.5 is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm._sample import held_out, sample_texts
from auditlake.llm._tables import table, text_key
from auditlake.llm._words import U, mix

ORDER = 5
SLOTS = 400  # texts of each language that the models are fitted on, at most
CHARACTERS = 100_000  # of each of them, at most
LANGUAGES = 256  # learned, at most: those with most texts
UNKNOWN = 0.1  # share of texts in other languages that the score's curve assumes
UNDETERMINED = "und"
BLOCK_LETTERS = 1 << 19
_BASE = U(0x9E3779B97F4A7C15)
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def encode(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all texts, one 32 for each gap; the places to predict, and the text of each of these places.

    Before each text stand order - 1 gaps, so that every place has its full context.
    """
    low = [t.lower() for t in texts]
    gap = "\x00" * order
    points = np.frombuffer((gap + gap.join(low) + gap).encode("utf-32-le", "replace"), np.uint32)
    size = np.fromiter(map(len, low), np.int64, len(low))
    text = np.repeat(np.arange(len(low)), size + order)
    text = np.concatenate([text, np.full(order, max(len(low) - 1, 0))]) if len(low) else np.zeros(order, np.int64)
    pad = np.zeros(len(points), bool)
    first = np.concatenate([[0], np.cumsum(size + order)])
    pad[(first[:, None] + np.arange(order)[None, :]).ravel()] = True
    letter = _is_letter()[points]
    keep = letter | pad
    keep[1:] |= letter[:-1] & ~letter[1:]
    out = np.where(letter, points, 32).astype(U)[keep]
    places = np.flatnonzero(~pad[keep])
    return out, places, text[keep][places]


def gram(codes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n codes that end at each place."""
    h = np.full(len(at), n, U)
    for k in range(n - 1, -1, -1):
        h = (h + codes[at - k]) * _BASE
    return mix(h)


def _find(sorted_hashes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i = np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)
    return i, sorted_hashes[i] == h


class KneserNey:
    """Counts of one language. orders[n - 1]: hashes and counts of n-grams, hashes, sums and kinds of contexts, discount."""

    def __init__(self, codes: np.ndarray, places: np.ndarray, order: int, alphabet: int):
        self.order, self.alphabet, self.orders = order, alphabet, []
        at = places
        h = gram(codes, at, order)
        for n in range(order, 0, -1):
            h, where, count = np.unique(h, return_index=True, return_counts=True)
            at = at[where]
            context = gram(codes, at - 1, n - 1)
            ch, inverse = np.unique(context, return_inverse=True)
            n1, n2 = (count == 1).sum(), (count == 2).sum()
            discount = float(np.clip(n1 / max(n1 + 2 * n2, 1), 0.1, 0.95))
            self.orders.insert(0, (h, count.astype(np.float64), ch, np.bincount(inverse, count), np.bincount(inverse).astype(np.float64), discount))
            if n > 1:
                h = gram(codes, at, n - 1)  # a lower order counts the kinds of sequences it ends: one for each seen above

    def probability(self, grams: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        p = np.full(len(grams[0]), 1.0 / self.alphabet)
        for (h, count, ch, total, kinds, discount), g, c in zip(self.orders, grams, contexts, strict=True):
            i, seen = _find(h, g)
            j, known = _find(ch, c)
            own = np.where(seen, np.maximum(count[i] - discount, 0), 0)
            p = np.where(known, (own + discount * kinds[j] * p) / total[j], p)
        return p


class Model:
    def __init__(self, languages: list[str], models: list[KneserNey], order: int):
        self.languages, self.models, self.order = languages, models, order
        self.table, self.logs, self.radix = np.zeros(0, U), np.zeros((0, len(languages)), np.float32), np.zeros(2, np.int64)
        self.bits, self.usual, self.curve = 1, np.zeros((len(languages), 3)), START

    def index(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Log probabilities, in every language, of all sequences that any language has seen."""
        hashes, grams, contexts = [], [[] for _ in range(self.order)], [[] for _ in range(self.order)]
        for codes, places in parts:
            h, where = np.unique(gram(codes, places, self.order), return_index=True)
            hashes.append(h)
            for n in range(self.order):
                grams[n].append(gram(codes, places[where], n + 1))
                contexts[n].append(gram(codes, places[where] - 1, n))
        self.table, first = np.unique(np.concatenate(hashes), return_index=True)
        grams, contexts = ([np.concatenate(x)[first] for x in y] for y in (grams, contexts))
        self.logs = np.stack([np.log(m.probability(grams, contexts)) for m in self.models], 1).astype(np.float32)
        self.bits = max(1, int(np.log2(len(self.table))))
        self.radix = np.searchsorted(self.table >> U(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=U))

    def _lookup(self, h: np.ndarray) -> np.ndarray:
        """Index in the table or -1: the hash's upper bits name a short stretch of the sorted array."""
        top = (h >> U(64 - self.bits)).astype(np.int64)
        at, end = self.radix[top], self.radix[top + 1]
        out, left = np.full(len(h), -1), np.flatnonzero(at < end)
        while len(left):
            hit = self.table[at[left]] == h[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per place of each text in each language, and the number of letters and gaps."""
        codes, places, text = encode(texts, self.order)
        h = gram(codes, places, self.order)
        i = self._lookup(h)
        new = np.flatnonzero(i < 0)
        extra = np.zeros((0, len(self.languages)), np.float32)
        if len(new):
            _, where, back = np.unique(h[new], return_index=True, return_inverse=True)
            at = places[new[where]]
            grams, contexts = [gram(codes, at, n + 1) for n in range(self.order)], [gram(codes, at - 1, n) for n in range(self.order)]
            extra = np.stack([np.log(m.probability(grams, contexts)) for m in self.models], 1).astype(np.float32)
            i[new] = len(self.logs) + back
        logs, count = np.concatenate([self.logs, extra]), np.bincount(text, minlength=len(texts))
        total = np.stack([np.bincount(text, logs[i, k], len(texts)) for k in range(len(self.languages))], 1)
        return -total / np.maximum(count, 1)[:, None], count

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the text is rejected; texts without a letter are undetermined, score 0."""
        texts = [t or "" for t in texts]
        lang, score, rejected = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if not self.languages:
            return lang, score, rejected
        at = 0
        while at < len(texts):
            last, size = at, 0
            while last < len(texts) and (last == at or size + len(texts[last]) <= BLOCK_LETTERS):
                size += len(texts[last])
                last += 1
            entropy, count = self.entropies(texts[at:last])
            best, p = entropy.argmin(1), self._scores(entropy, count)
            for k in range(last - at):
                if any(map(str.isalpha, texts[at + k])):
                    lang[at + k], score[at + k], rejected[at + k] = self.languages[best[k]], p[k], p[k] < 0.5
            at = last
        return lang, score, rejected

    def _scores(self, entropy: np.ndarray, count: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_signs(entropy, count, self.usual) @ self.curve, -50, 50)))


START = np.array([0.0, 1.0, 0.0, -1.0])


def _signs(entropy: np.ndarray, count: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """What the score goes by: 1, the lead in nats over the whole text and a place, and how far the best language's entropy is
    over its usual one, in deviations of a text of that length. usual: a language's mean, variance of a place, variance of a text."""
    best = entropy.argmin(1)
    two = np.sort(entropy, 1)[:, :2]
    lead = two[:, 1] - two[:, 0] if entropy.shape[1] > 1 else np.ones(len(entropy))
    mean, place, text = usual[best].T
    over = (two[:, 0] - mean) / np.sqrt(place / np.maximum(count, 1) + text + 1e-6)
    return np.column_stack([np.ones(len(entropy)), np.log1p(lead * count), lead, np.clip(over, -3, 30)])


def _fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression, drawn to START where texts are few."""
    w, pull = START.copy(), 0.1
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        w = w + np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), x.T @ (weight * (y - p)) - pull * (w - START))
    return w


def fit(labelled: list[tuple[str, str]], order: int = ORDER) -> Model:
    """Three of four texts of a language make its model; the fourth ones set the score's curve and the limits."""
    languages = sorted({lang for lang, _ in labelled})
    by = {lang: [t for x, t in labelled if x == lang] for lang in languages}
    parts = {lang: encode([t for k, t in enumerate(by[lang]) if k % 4 or len(by[lang]) < 4], order)[:2] for lang in languages}
    languages = [lang for lang in languages if len(parts[lang][1])]
    alphabet = len(np.unique(np.concatenate([parts[lang][0] for lang in languages]))) + 1 if languages else 1
    model = Model(languages, [KneserNey(*parts[lang], order, alphabet) for lang in languages], order)
    if not languages:
        return model
    model.index([parts[lang] for lang in languages])
    # whole texts and their first words: short texts are harder, and the curve has to know
    rest = [(x, piece) for x, t in ((x, t) for x in languages for t in by[x][::4]) for piece in (t, t[:60], t[:20], t[:8]) if any(map(str.isalpha, piece))]
    entropy, count = model.entropies([t for _, t in rest])
    own = np.array([languages.index(x) for x, _ in rest])
    whole = np.array([len(t) > 60 for _, t in rest])
    for k in range(len(languages)):
        h, n = entropy[own == k, k], count[own == k].astype(float)
        if len(h):
            long = h[whole[own == k]] if whole[own == k].any() else h
            model.usual[k] = long.mean(), ((h - long.mean()) ** 2 * n).mean(), long.var()
    right = (entropy.argmin(1) == own).astype(float)
    x, y, weight = _signs(entropy, count, model.usual), right, np.ones(len(rest))
    if len(languages) > 1:  # the same texts, as if their language were not known
        for k in range(len(languages)):
            others = np.delete(np.arange(len(languages)), k)
            part = _signs(entropy[own == k][:, others], count[own == k], model.usual[others])
            x, y = np.concatenate([x, part]), np.append(y, np.zeros(len(part)))
            weight = np.append(weight, np.full(len(part), UNKNOWN / (1 - UNKNOWN)))
    model.curve = _fit_curve(x, y, weight)
    return model


def fit_on(docs: DataFrame, slots: int = SLOTS, characters: int = CHARACTERS, languages: int = LANGUAGES) -> Model:
    """Learns from text and lang of rows with a lang whose crc32(doc_id) mod 3 is not 1: at most `slots` texts of a language, of
    each at most `characters`, and of `languages` languages at most, those with most texts."""
    rows = docs.filter(~held_out(F.col("doc_id"), 3, 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return fit(sample_texts(docs, rows.select("doc_id", F.col("lang").cast("string").alias("label")), slots, characters, languages))


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, rejected = shared.value.predict(b.column("text").to_pylist())
            yield pa.record_batch([b.column("doc_id"), b.column("key"), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "key", "lang_pred", "score", "rejected"])

    return run


def identify_language(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, key, lang_pred, score, rejected of every row; null and letterless texts: und, 0.0, true.

    The score is how likely lang_pred is right; texts of a language that was not learned score low. A rejected
    text (score under 0.5) still has its most likely language in lang_pred. Without any labelled row all are und.
    """
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))
    schema = rows.select("doc_id", "key", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")).schema
    return rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), schema)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify_language(docs, fit_on(docs))
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score", "rejected")
