"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the hashed character n-grams of a text's distinct words, word ends included. For every
n-gram seen in enough training texts, r = log of its smoothed share in toxic texts over its share in
the others; logistic regression is trained on counts times r. A text's score adds up over its
distinct words, so each distinct word of a slice is scored once.

Training reads a bounded sample (``rows_per_class`` texts of each label, of at most ``text_bytes``
bytes, smallest hashes of the id first); slope and intercept are then calibrated on a quarter of it
that the weights have not seen, weighed to the label shares of all training rows. Scoring reads every whole text. Only the text enters a score.

Defined results: null and empty texts have the score of the intercept alone; with one label only,
or none, every score is the share of toxic labels (0 without labels); rows with null labels or ids
are no training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalweave.llm.batches import (
    Texts,
    coded,
    lean,
    mix64,
    offsets_of,
    ragged_index,
    spans_array,
    text_slices,
    texts_of,
    words_of,
)
from evalweave.session import stage


#: Bytes of training text whose n-grams are held at once.
PART_BYTES = 128 << 10


@dataclass(frozen=True)
class Training:
    rows_per_class: int = 2000
    text_bytes: int = 32_768
    bits: int = 18
    shortest: int = 3
    longest: int = 6
    least_texts: int = 4
    least_ratio: float = 1.0
    ridge: float = 1.0
    steps: int = 80


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    intercept: float
    settings: Training


def word_grams(values: pa.Array, settings: Training) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each word between its end marks, one word after another, and their bounds."""
    words = values.cast(pa.large_string())
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    joined = "\x02" + "\x03\x02".join(words.to_pylist()) + "\x03" if len(words) else ""
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    word_end = np.repeat(offsets_of(size)[1:], size)
    owner = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(points))
    hashed = np.zeros(len(points), np.uint64)
    buckets, owners = [], []
    for n in range(1, settings.longest + 1):
        place = place[place + n <= word_end[place]]
        hashed = hashed[: len(place)] if n == 1 else hashed[place]
        full = np.zeros(len(points), np.uint64)
        full[place] = mix64(hashed * np.uint64(0x9E3779B97F4A7C15) + points[place + n - 1] + np.uint64(n))
        hashed = full
        if n >= settings.shortest:
            buckets.append((full[place] >> np.uint64(64 - settings.bits)).astype(np.int32))
            owners.append(owner[place])
    bucket, own = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return bucket[order], offsets_of(np.bincount(own, minlength=len(size)))


def distinct_words(texts: Texts) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text, word code) of the distinct words of each text, and the words."""
    data, starts, ends, first = words_of(texts, fold_case=True)
    codes, values = coded(spans_array(data, starts, ends))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pairs = np.unique(text * max(len(values), 1) + codes)
    return pairs // max(len(values), 1), pairs % max(len(values), 1), values


def scores(texts: Texts, model: Model) -> np.ndarray:
    text, code, values = distinct_words(texts)
    buckets, bounds = word_grams(values, model.settings) if len(values) else (np.zeros(0, np.int32), np.zeros(1, np.int64))
    by_word = segment_sums_float(model.weights[buckets], bounds)
    total = np.bincount(text, weights=by_word[code], minlength=len(texts.bounds) - 1)
    return 1 / (1 + np.exp(-np.clip(total + model.intercept, -30, 30)))


def segment_sums_float(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _parts(texts: Texts, settings: Training) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, n-gram, distinct words that hold it), some texts at a time to bound the memory."""
    size, begin, count = 1 << settings.bits, 0, len(texts.bounds) - 1
    while begin < count:
        end = int(np.searchsorted(texts.bounds, texts.bounds[begin] + PART_BYTES, side="right")) - 1
        end = min(max(end, begin + 1), count)
        bounds = texts.bounds[begin : end + 1]
        text, code, values = distinct_words(Texts(texts.data[bounds[0] : bounds[-1]], bounds - bounds[0]))
        if len(values):
            buckets, grams = word_grams(values, settings)
            sizes = np.diff(grams)[code]
            gram = buckets[ragged_index(grams[code], sizes)].astype(np.int64)
            pairs, counts = np.unique(np.repeat(text, sizes) * size + gram, return_counts=True)
            yield begin + pairs // size, pairs % size, counts
        begin = end


def fit(texts: Texts, toxic: np.ndarray, share: float, settings: Training) -> Model:
    """The classifier of the sample; ``share`` is that of toxic rows among all training rows."""
    size = 1 << settings.bits
    if not len(toxic) or toxic.min() == toxic.max():
        share = float(np.clip(share, 1e-9, 1 - 1e-9))
        return Model(np.zeros(size), float(np.log(share / (1 - share))), settings)
    p, q, seen = np.ones(size), np.ones(size), np.zeros(size, np.int64)
    for row, gram, _ in _parts(texts, settings):
        own = np.bincount(gram, minlength=size)
        toxic_own = np.bincount(gram[toxic[row] == 1], minlength=size)
        p += toxic_own
        q += own - toxic_own
        seen += own
    seen = seen >= settings.least_texts
    ratio = np.where(seen, np.log(p / (toxic == 1).sum()) - np.log(q / (toxic != 1).sum()), 0.0)
    ratio[np.abs(ratio) < settings.least_ratio] = 0
    found = [
        (row[telling].astype(np.int32), gram[telling].astype(np.int32), counts[telling].astype(np.float32))
        for row, gram, counts in _parts(texts, settings)
        for telling in [ratio[gram] != 0]
    ]
    row, gram, counts = (np.concatenate(c) for c in zip(*found, strict=True))
    value = counts * ratio[gram]
    # Every fourth text is kept from the weights; they set slope and intercept.
    aside = np.arange(len(toxic)) % 4 == 3
    fitted = ~aside[row]
    label = toxic.astype(float)
    use = np.where(aside, 0.0, 1.0)
    weights, intercept = _logistic(row[fitted], gram[fitted], value[fitted], label, use, size, settings)
    margin = np.bincount(row, weights=value * weights[gram], minlength=len(toxic)) + intercept
    share, sampled = float(np.clip(share, 1e-6, 1 - 1e-6)), float(toxic.mean())
    weigh = np.where(toxic == 1, share / sampled, (1 - share) / (1 - sampled))
    slope, shift = _calibrated(margin[aside], label[aside], weigh[aside])
    return Model(weights * ratio * slope, intercept * slope + shift, settings)


def _calibrated(margin: np.ndarray, label: np.ndarray, weigh: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make ``slope * margin + shift`` the log-odds, by damped Newton steps."""
    if not len(label) or label.min() == label.max():
        return 1.0, 0.0
    columns = np.stack([margin, np.ones_like(margin)], axis=1)
    both = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(columns @ both, -30, 30)))
        gradient = columns.T @ (weigh * (p - label)) + 1e-2 * (both - [1, 0])
        curve = (columns * (weigh * p * (1 - p))[:, None]).T @ columns + 1e-2 * np.eye(2)
        both = both - np.clip(np.linalg.solve(curve, gradient), -2, 2)
    return (float(both[0]), float(both[1])) if both[0] > 0 else (1.0, 0.0)


def _logistic(row, gram, value, label, use, size, settings) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression by accelerated gradient steps of a safe length."""
    weights, intercept = np.zeros(size), 0.0
    ahead, ahead_intercept = weights, intercept
    squares = np.bincount(row, weights=value * value, minlength=len(label)) + 1
    step = 4.0 / (np.mean(squares) * len(label) ** 0.5 + settings.ridge) / len(label) ** 0.5
    for k in range(settings.steps):
        margin = np.bincount(row, weights=value * ahead[gram], minlength=len(label)) + ahead_intercept
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label) * use
        gradient = np.bincount(gram, weights=value * error[row], minlength=size) + settings.ridge * ahead
        moved, moved_intercept = ahead - step * gradient, ahead_intercept - step * error.sum()
        pace = k / (k + 3)
        ahead = moved + pace * (moved - weights)
        ahead_intercept = moved_intercept + pace * (moved_intercept - intercept)
        weights, intercept = moved, moved_intercept
    return weights, intercept


def train(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, settings: Training = Training()
) -> Model:
    """Fits on the bounded sample of documents that ``labels`` (key, 0/1 label) marks.

    The sample is drawn from narrow rows, so only the texts of the sample (at most twice
    ``rows_per_class`` ids, hence a bounded broadcast) are ever joined.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    narrow = rows.select("id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
    marks = labels.select(F.col(key).alias("id"), F.col(label).alias("label"))
    marked = narrow.join(marks.filter("id is not null and label in (0, 1)"), "id")
    counted = marked.agg(F.count("label").alias("n"), F.sum("label").alias("toxic")).first()
    share = (counted["toxic"] or 0) / max(counted["n"], 1)
    short = marked.filter(F.col("bytes") <= settings.text_bytes).select("id", "label").distinct()
    order = F.xxhash64(F.col("id").cast("string"))
    parts = [short.filter(F.col("label") == k).orderBy(order).limit(settings.rows_per_class) for k in (0, 1)]
    chosen = stage(parts[0].unionByName(parts[1]), "toxic-sample")
    fits = F.coalesce(F.octet_length("text"), F.lit(0)) <= settings.text_bytes
    texts = rows.filter(fits).join(F.broadcast(chosen), "id")
    sample = texts.groupBy("id", "label").agg(F.max("text").alias("text")).select("text", "label").toArrow()
    column = sample.column("text").combine_chunks()
    column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    toxic = sample.column("label").to_numpy().astype(np.int64)
    return fit(texts_of(column), toxic, share, settings)


def with_score(df: DataFrame, text: str, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and ``score`` of every row. The model (2 MB) travels as a broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    plain = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("text"))
    schema = T.StructType([*plain.schema.fields[:-1], T.StructField("score", T.DoubleType())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text"):
            found = pa.array(scores(texts, shared.value), pa.float64())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], found], names=schema.names)

    return plain.mapInArrow(run, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def held_out(key: Column) -> Column:
    """Rows that no training may see: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))
