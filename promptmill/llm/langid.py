"""Language identification: averaged hashed subword embeddings under a linear softmax.

The model is fitted in numpy on a bounded sample of labelled rows, whose subword counts are
made in tasks; prediction is a map over all rows and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptmill.llm.batches import list_array, text_slices, texts_of

# Lengths of subwords in bytes; a word's borders count as one blank each.
ORDERS = (2, 3, 4)
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
WIDTH = 16
# Labelled rows the model is fitted on, per language. Every fourth of them calibrates.
SAMPLE_PER_LANGUAGE = 300
EPOCHS, RATE, SEED = 6, 2.0, 17
# Share of the calibration rows that may be rejected, and the score above which nothing is. One clean
# word can score below a half.
REJECTED_SHARE, CERTAIN = 0.001, 0.35
UNDETERMINED = "und"
# Positions handled at once, so that memory does not grow with a text.
WINDOW = 1 << 19

_BLANK = 0x20
_LETTERS = np.array([b if b >= 0x80 or chr(b).isalpha() else _BLANK for b in range(256)], np.uint8)


@dataclass(frozen=True)
class LanguageModel:
    """``gains[bucket]`` is what a subword adds to each language; the last row, for none, is zero."""

    languages: tuple[str, ...]
    gains: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def scores(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Calibrated probabilities from summed gains and subword counts."""
        logits = (sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
        grown = np.exp(logits - logits.max(axis=1, keepdims=True))
        return grown / grown.sum(axis=1, keepdims=True)


def _windows(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """The buckets of every subword of every order, window by window.

    Yields the buckets of one order in a window (``BUCKETS`` where no subword begins), which
    of them count, the first text of the window, and where each text of it begins.
    """
    lowered = [t.lower().encode() for t in texts]
    text = _LETTERS[np.frombuffer(b" " + b" ".join(lowered) + b" " * max(ORDERS), np.uint8)]
    sizes = np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for low in range(0, int(starts[-1]), WINDOW):
        high = min(low + WINDOW, int(starts[-1]))
        first = int(np.searchsorted(starts, low, side="right")) - 1
        last = int(np.searchsorted(starts, high, side="left"))
        begins = np.maximum(starts[first:last], low) - low
        part = text[low : high + max(ORDERS) - 1].astype(np.uint32)
        inside = part != _BLANK
        size = high - low
        code, whole = part[:size].copy(), np.ones(size, bool)
        for order in range(2, max(ORDERS) + 1):
            if order > 2:
                whole &= inside[order - 2 : order - 2 + size]
            code += part[order - 1 : order - 1 + size] << np.uint32(8 * (order - 1))
            if order in ORDERS:
                # A blank at both ends of two bytes is no subword.
                valid = whole if order > 2 else inside[:size] | inside[1 : size + 1]
                mixed = (code * np.uint32(2654435761 + 2 * order)) >> np.uint32(32 - BUCKET_BITS)
                yield np.where(valid, mixed, BUCKETS).astype(np.int32), valid, first, begins


def subword_counts(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's buckets and how often they occur."""
    totals = [np.zeros(BUCKETS + 1, np.int64) for _ in texts]
    for buckets, _, first, begins in _windows(texts):
        for offset, part in enumerate(np.split(buckets, begins[1:])):
            totals[first + offset] += np.bincount(part, minlength=BUCKETS + 1)
    return [(np.flatnonzero(t[:BUCKETS]), t[:BUCKETS][t[:BUCKETS] > 0]) for t in totals]


def _sums(texts: list[str], gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sums, counts = np.zeros((len(texts), gains.shape[1])), np.zeros(len(texts), np.int64)
    for buckets, valid, first, begins in _windows(texts):
        rows = slice(first, first + begins.size)
        for language in range(gains.shape[1]):
            sums[rows, language] += np.add.reduceat(gains[:, language].take(buckets), begins)
        counts[rows] += np.add.reduceat(valid, begins, dtype=np.int64)
    return sums, counts


def remainder(identifier: Column, modulus: int = 4) -> Column:
    """crc32 of the id as text, modulo; a null id counts as an empty text."""
    return F.crc32(F.coalesce(identifier.cast("string"), F.lit("")).cast("binary")) % modulus


def sample_counts(
    labelled: DataFrame, id_column: str, text_column: str, label_column: str, per_language: int
) -> DataFrame:
    """``id, label, buckets, counts`` of at most ``per_language`` rows of each language.

    Rows are picked by a hash of their id, reading ids and labels only.
    """
    ident, text, label = (F.col(f"`{c}`") for c in (id_column, text_column, label_column))
    rows = labelled.select(ident.cast("string").alias("id"), text.alias("text"), label.alias("label")).filter(
        "id IS NOT NULL AND label IS NOT NULL"
    )
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id"))
    placed = rows.select("id", "label", place.alias("place"))
    chosen = placed.filter(F.col("place") <= per_language).select("id", "label").distinct()
    # At most per_language rows per language.
    texts = rows.join(F.broadcast(chosen), ["id", "label"]).groupBy("id", "label").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                found = subword_counts(texts_of(part, "text"))
                sizes = np.array([len(b) for b, _ in found])
                buckets, counts = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        part.column("label"),
                        list_array(pa.array(buckets, pa.int32()), sizes),
                        list_array(pa.array(counts, pa.int64()), sizes),
                    ],
                    ["id", "label", "buckets", "counts"],
                )

    return texts.mapInArrow(count, "id string, label string, buckets array<int>, counts array<bigint>")


def train(
    labelled: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "lang",
    per_language: int = SAMPLE_PER_LANGUAGE,
) -> LanguageModel:
    """Fit a model on at most ``per_language`` rows of each label.

    Plain stochastic gradient descent over single texts, in a seeded order, with a falling
    rate. Rows without a label, text or id teach nothing; no labelled rows give a model
    without languages, which determines nothing.
    """
    rows = sorted(
        (r for r in sample_counts(labelled, id_column, text_column, label_column, per_language).collect() if r["buckets"]),
        key=lambda r: (r["label"], r["id"]),
    )
    languages = tuple(sorted({r["label"] for r in rows}))
    texts = [
        (np.array(r["buckets"]), np.array(r["counts"], float) / sum(r["counts"]), languages.index(r["label"])) for r in rows
    ]
    fitted, held = [t for n, t in enumerate(texts) if n % 4], texts[::4]
    if len({t[2] for t in fitted}) < len(languages):
        fitted = texts
    chance = np.random.default_rng(SEED)
    inner = chance.normal(0, 1 / WIDTH, (BUCKETS, WIDTH))
    outer, bias = np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    steps, step = max(1, EPOCHS * len(fitted)), 0
    for _ in range(EPOCHS):
        for n in chance.permutation(len(fitted)):
            buckets, shares, language = fitted[n]
            rate = RATE * (1 - step / steps)
            step += 1
            picked = inner[buckets]
            mean = shares @ picked
            error = _softmax(mean @ outer + bias)
            error[language] -= 1
            back = outer @ error
            outer -= rate * np.outer(mean, error)
            bias -= rate * 0.1 * error
            # A text's rows share its gradient; scaling by the largest share keeps rare subwords moving.
            inner[buckets] = picked - rate * np.outer(shares / shares.max(), back)
    gains = np.zeros((BUCKETS + 1, len(languages)), np.float32)
    gains[:BUCKETS] = inner @ outer
    if not languages:
        return LanguageModel((), gains, bias, 1.0, 0.0)
    logits = np.array([shares @ gains[buckets] + bias for buckets, shares, _ in held])
    truth = np.array([language for _, _, language in held])
    temperature = min(np.geomspace(0.05, 20, 60), key=lambda t: _loss(logits / t, truth))
    best = np.array([_softmax(row / temperature).max() for row in logits])
    reject_below = min(CERTAIN, float(np.quantile(best, REJECTED_SHARE)))
    return LanguageModel(languages, gains, bias, float(temperature), reject_below)


def _softmax(logits: np.ndarray) -> np.ndarray:
    grown = np.exp(logits - logits.max())
    return grown / grown.sum()


def _loss(logits: np.ndarray, truth: np.ndarray) -> float:
    """Cross entropy against targets short of certainty by what ``truth.size`` right rows leave open."""
    top = logits.max(axis=1, keepdims=True)
    surprise = np.log(np.exp(logits - top).sum(axis=1, keepdims=True)) + top - logits
    target = np.full(logits.shape, 1 / (truth.size + 2) / max(1, logits.shape[1] - 1))
    target[np.arange(truth.size), truth] = (truth.size + 1) / (truth.size + 2)
    return float((target * surprise).sum(axis=1).mean())


def identify(docs: DataFrame, model: LanguageModel, text_column: str = "text") -> DataFrame:
    """All columns, then ``_language, _score, _accepted`` (replacing columns of those
    names): one row per input row, a map.

    The language is the likeliest the model knows, the score its calibrated probability. A
    null text, and one without any letter, is ``und`` with score 0 and is not accepted; nor
    is a text whose score lies below the model's limit. Only the text is read to decide.
    """
    docs = docs.drop("_language", "_score", "_accepted")
    letter = regex.compile(r"\p{L}")
    schema = T.StructType(list(docs.schema.fields)).add("_language", "string").add("_score", "double").add("_accepted", "boolean")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_column):
                texts = texts_of(part, text_column)
                known = np.array([bool(model.languages) and letter.search(t) is not None for t in texts])
                best, score = np.zeros(len(texts), int), np.zeros(len(texts))
                if model.languages:
                    odds = model.scores(*_sums(texts, model.gains))
                    best, score = odds.argmax(axis=1), np.where(known, odds.max(axis=1), 0.0)
                names = [model.languages[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.array(names, pa.string()),
                        pa.array(score),
                        pa.array(known & (score >= model.reject_below)),
                    ],
                    [*part.schema.names, "_language", "_score", "_accepted"],
                )

    return docs.mapInArrow(predict, schema)
