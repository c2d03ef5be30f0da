"""Quality classifier: naive Bayes support vector machine over n-gram indicators.

Features are indicators of hashed word n-grams and of byte trigrams of a text.
Each is scaled by the log of the ratio of its smoothed shares in the two classes.
A linear model with hinge loss is then fitted by dual coordinate descent, and a
logistic curve maps margins to 0..1; it is fitted on rows that neither the ratios
nor the descent saw.  Fitting takes a bounded sample of labelled rows: those with the
smallest hashes of their ids, `max_rows` of them, and fewer if their texts are so long
that they have more than `max_indicators` features together.  Scoring reads every
text whole.

Edge cases: a null or empty text has no features and gets the score of the
intercept.  Labels that are null, and labelled ids without a document, are not
learned from; an id that is labelled several times, or that several documents
have, counts each time, in the order of the label and the features.  Without
training rows of both classes every score is the share of label 1, or 0.5
without any.  Extra columns are ignored by `score` and kept by `with_scores`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.llm import text as kernel
from tessera.llm.common import bounded_batches, fold, persisted

#: Hash buckets of features; the model has a weight for each.
BUCKETS = 1 << 18
#: Added to a row's squared length, so that a few features of a short text don't weigh as much as many.
RIDGE = 20.0


@dataclass(frozen=True)
class Settings:
    word_ngrams: tuple[int, ...] = (1, 2)
    char_ngrams: tuple[int, ...] = (3,)
    repeat_ngram: int = 3
    #: Labelled rows that the model is fitted on at most, and the share of them kept for the logistic curve.
    max_rows: int = 6000
    #: Features of these rows together at most, for the driver's memory; the first row counts whatever it has.
    max_indicators: int = 12_000_000
    curve_share: float = 0.25
    smoothing: float = 1.0
    cost: float = 1.0
    epochs: int = 12
    threshold: float = 0.7


@dataclass(frozen=True)
class Model:
    scaled: np.ndarray  # by bucket: log-count ratio times fitted weight, and the ratio's square
    bias: float
    slope: float
    shift: float


def indicators(raw: np.ndarray, offsets: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text of a slice, and each text's offsets into them."""
    mapped, starts, ends, at = kernel.spans(raw, offsets, kernel.SPACE_WORDS)
    words = kernel.hashes(mapped, starts, ends)
    count = len(offsets) - 1
    codes = []
    text = np.repeat(np.arange(count), np.diff(at))
    for n in settings.word_ngrams:
        got, whole = kernel.grams(words, at, n)
        codes.append((text[whole] << 18) | (got[whole] & np.uint64(BUCKETS - 1)).astype(np.int64))
    # Which of the latest words repeat the one before, as an n-gram of its own alphabet.
    again = np.zeros(len(words), np.int64)
    again[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    runs = again.copy()
    for i in range(1, settings.repeat_ngram):
        runs[i:] |= np.where(text[i:] == text[:-i], again[:-i] << i, 0)
    codes.append((text[runs > 0] << 18) | (kernel.mix(runs[runs > 0].astype(np.uint64)) & np.uint64(BUCKETS - 1)).astype(np.int64))
    small = raw.astype(np.uint32)
    for n in settings.char_ngrams:
        if len(raw) < n:
            continue
        m = len(raw) - n + 1
        got = np.zeros(m, np.uint32)
        for i in range(n):
            got = got * np.uint32(0x01000193) + small[i : i + m]
        got = (got * np.uint32(0x9E3779B1)) >> np.uint32(14)
        of = np.repeat(np.arange(count), np.diff(offsets))
        whole = np.arange(m) + n <= offsets[1:][of[:m]]
        codes.append((of[:m][whole] << 18) | got[whole].astype(np.int64))
    codes = np.unique(np.concatenate([np.zeros(0, np.int64), *codes]))
    return codes & (BUCKETS - 1), np.searchsorted(codes, np.arange(count + 1) << 18)


def _sample(docs: DataFrame, labels: DataFrame, settings: Settings, label_col: str, folds: int, held_out: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, offsets and buckets of at most max_rows labelled rows and max_indicators buckets: the rows with the smallest hashes of their ids."""
    own = labels.select(F.col("doc_id").alias("__l"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    own = own.where(fold(F.col("__l"), folds) != held_out).orderBy(F.xxhash64("__l"), "__l", "label").limit(settings.max_rows)
    # The ids are max_rows at most, so they may be broadcast whatever the tables hold.
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("text")).join(F.broadcast(own), F.col("id") == F.col("__l")).select("text", F.xxhash64("id").alias("h"), "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, raw, offsets in kernel.slices(batch.column(0)):
                got, at = indicators(raw, offsets, settings)
                yield pa.RecordBatch.from_arrays([batch.column(1)[first:end], batch.column(2)[first:end], kernel.lists(got.astype(np.int32), at, pa.int32())], names=["h", "label", "got"])

    hashed = persisted(rows.mapInArrow(kernel.lean(run), "h long, label int, got array<int>").withColumn("key", F.xxhash64("got")), "labelled")
    order = ["h", "label", "key"]
    sizes = hashed.select(*order, F.size("got").alias("n")).orderBy(*order).limit(settings.max_rows).toArrow()
    admitted = max(1, int(np.searchsorted(np.cumsum(np.asarray(sizes.column(3), np.int64)), settings.max_indicators, side="right"))) if sizes.num_rows else 0
    if not admitted:
        return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int32)
    last = [sizes.column(c)[min(admitted, sizes.num_rows) - 1].as_py() for c in range(3)]
    own = hashed.where(F.struct(*order) <= F.struct(*(F.lit(x).cast(hashed.schema[c].dataType).alias(c) for c, x in zip(order, last, strict=True))))
    table = own.orderBy(*order).limit(admitted).select(*order, "got").toArrow().sort_by([(c, "ascending") for c in order])
    listed = table.column(3).combine_chunks()
    return np.asarray(table.column(1)), np.concatenate([[0], np.cumsum(np.asarray(listed.value_lengths()))]).astype(np.int64), np.asarray(listed.flatten())


def ratios(at: np.ndarray, got: np.ndarray, label: np.ndarray, settings: Settings) -> np.ndarray:
    """By bucket: log of the ratio of its smoothed shares in the rows of label 1 and in those of label 0."""
    of = np.repeat(label, np.diff(at))
    counts = [np.bincount(got[of == c], minlength=BUCKETS) + settings.smoothing for c in (0, 1)]
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def descend(at: np.ndarray, got: np.ndarray, scale: np.ndarray, label: np.ndarray, settings: Settings) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for hinge loss on rows of scaled indicators; weights and bias.

    A row is divided by its length, short rows by a little more: see RIDGE.
    """
    n = len(label)
    sign = np.where(label == 1, 1.0, -1.0)
    rows, square = [], np.ones(n)
    for i in range(n):
        cols = got[at[i] : at[i + 1]]
        vals = scale[cols]
        vals = vals / np.sqrt((vals * vals).sum() + RIDGE)
        rows.append((cols, vals))
        square[i] += vals @ vals  # 1 is the bias
    weights, bias, dual = np.zeros(BUCKETS), 0.0, np.zeros(n)
    rng = np.random.default_rng(17)
    for _ in range(settings.epochs):
        for i in rng.permutation(n):
            cols, vals = rows[i]
            slack = sign[i] * (weights[cols] @ vals + bias) - 1
            new = min(max(dual[i] - slack / square[i], 0.0), settings.cost)
            if new != dual[i]:
                step = (new - dual[i]) * sign[i]
                weights[cols] += step * vals
                bias += step
                dual[i] = new
    return weights, bias


def _curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the margins, by Newton's method."""
    if len(set(label.tolist())) < 2:
        return 4.0, 0.0
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    pos, neg = (label == 1).sum(), (label == 0).sum()
    y = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.array([2.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w + np.linalg.solve(h, x.T @ (y - p) - 1e-3 * w)
    return float(max(w[0], 0.1)), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, label_col: str = "quality", folds: int = 4, held_out: int = 2) -> Model:
    settings = settings or Settings()
    label, at, got = _sample(docs, labels, settings, label_col, folds, held_out)
    rows_of = np.bincount(label, minlength=2)[:2]
    if not rows_of.all():
        p = np.clip(rows_of[1] / rows_of.sum(), 1e-3, 1 - 1e-3) if rows_of.sum() else 0.5
        return Model(np.zeros((BUCKETS, 2), np.float32), 0.0, 1.0, float(np.log(p / (1 - p))))
    n = max(1, int(len(label) * (1 - settings.curve_share)))
    ratio = ratios(at[: n + 1], got[: at[n]], label[:n], settings)
    weights, bias = descend(at[: n + 1], got, ratio, label[:n], settings)
    scaled = np.stack([ratio * weights, ratio * ratio], axis=1).astype(np.float32)
    slope, shift = _curve(margins(got[at[n] :], at[n:] - at[n], scaled, bias), label[n:])
    return Model(scaled, bias, slope, shift)


def margins(got: np.ndarray, at: np.ndarray, scaled: np.ndarray, bias: float) -> np.ndarray:
    """Of each text: the product of its scaled row and the weights, plus the bias."""
    count = len(at) - 1
    of = np.repeat(np.arange(count), np.diff(at))
    dot, norm = (np.bincount(of, scaled[got, i], count) for i in (0, 1))
    return dot / np.sqrt(norm + RIDGE) + bias


def with_scores(docs: DataFrame, model: Model, settings: Settings | None = None, text_col: str = "text") -> DataFrame:
    """All columns of docs and score, which replaces a column of that name."""
    settings = settings or Settings()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size, see BUCKETS
    names = [c for c in bounded_batches(docs).columns if c != "score"]
    own = docs.select(*names, F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores = [np.zeros(0)]
            for _, _, raw, offsets in kernel.slices(batch.column(len(names))):
                margin = margins(*indicators(raw, offsets, settings), m.scaled, m.bias)
                scores.append(1 / (1 + np.exp(-np.clip(m.slope * margin + m.shift, -30, 30))))
            score = pa.array(np.concatenate(scores))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), score], names=[*names, "score"])

    return own.mapInArrow(kernel.lean(run), StructType([*(docs.schema[c] for c in names), StructField("score", DoubleType())]))


def accepted(docs: DataFrame, model: Model, settings: Settings | None = None, text_col: str = "text") -> DataFrame:
    """The rows of docs, with their own columns, whose score is at least the threshold."""
    settings = settings or Settings()
    own = docs.columns
    named = docs.withColumnRenamed("score", "__own_score") if "score" in own else docs
    scored = with_scores(named, model, settings, text_col).where(F.col("score") >= settings.threshold)
    return scored.select(*(F.col("__own_score" if c == "score" else c).alias(c) for c in own))
