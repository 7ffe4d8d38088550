"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes
log-count ratios (a logistic regression on r * x, where x says whether a text has the n-gram and r is
the log ratio of its smoothed rates among toxic and other texts).

N-grams are hashed. A bounded sample of labelled rows is counted on the executors, the n-grams that tell
the classes apart best become features, and the regression is fitted on one bit for each of them.

Defined results: null and empty texts have no n-grams and score like the intercept; with labels of one
kind only, or none, every score is the smoothed share of toxic labels; a document with several labels
takes the largest; rows with a null id or label teach nothing; equal rows get equal results; only the
named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import bounded_sample, limit_batches, slices, with_scores, written

SIZES = (3, 4, 5, 6)
BUCKET_BITS = 20
#: Labelled rows of each class, and features, that the classifier is fitted on, at most.
ROWS_PER_CLASS, FEATURES = 10_000, 4096
LEAST_TEXTS, SMOOTHING, L2, EPOCHS, RATE, MINIBATCH, SEED = 3, 1.0, 1e-4, 40, 0.02, 256, 11
_BLOCK = 1 << 14
_ROWS = 256

_classes: list[np.ndarray] = []


def _shape() -> np.ndarray:
    """For each code point its letter or digit, or the space that all others count as."""
    if not _classes:
        _classes.append(np.fromiter((c if chr(c).isalnum() else 32 for c in range(0x110000)), np.uint32, 0x110000))
    return _classes[0]


def ngrams(texts: list[str]):
    """For each n-gram size the buckets and the text numbers of all n-grams of the texts."""
    lowered = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.fromiter(map(len, lowered), np.int64, len(lowered)))
    codes = _shape()[codes]
    hashed = np.zeros(len(codes), np.uint32)
    for k in range(max(SIZES)):
        n = len(codes) - k
        if n <= 0:
            return
        hashed = (hashed[:n] ^ (codes[k:] + np.uint32(k))) * np.uint32(0x9E3779B1)
        hashed ^= hashed >> np.uint32(15)
        if k + 1 in SIZES:
            inside = doc[:n] == doc[k:]
            yield (hashed[inside] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKET_BITS), doc[:n][inside]


def _rows(texts: pa.Array):
    listed = texts.to_pylist()
    for at in range(0, len(listed), _ROWS):
        yield [t or "" for t in listed[at : at + _ROWS]]


@dataclass(frozen=True)
class Classifier:
    """The feature number of each bucket (-1: none), the weight of each feature, and the intercept."""

    feature: np.ndarray
    weight: np.ndarray
    intercept: float

    def present(self, texts: list[str]) -> np.ndarray:
        """For each text and feature whether the text has it."""
        out = np.zeros((len(texts), len(self.weight)), bool)
        for buckets, doc in ngrams(texts):
            number = self.feature[buckets]
            hit = np.flatnonzero(number >= 0)
            out[doc[hit], number[hit]] = True
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        total = self.present(texts).astype(np.float32) @ self.weight.astype(np.float32) + self.intercept
        return 1 / (1 + np.exp(-np.clip(total.astype(np.float64), -50, 50)))


def _counted(sample: DataFrame) -> DataFrame:
    """(block, toxic, other): of each task, in how many texts of either class each bucket of the block occurs."""

    def run(batches):
        counts = np.zeros((2, 1 << BUCKET_BITS), np.int32)
        for batch in batches:
            for part in slices(batch, "text"):
                toxic = part.column("label").to_pylist()
                for text, label in zip(part.column("text").to_pylist(), toxic, strict=True):
                    found = [b for b, _ in ngrams([text or ""])]
                    if found:
                        counts[label, np.unique(np.concatenate(found))] += 1
        blocks = range(0, counts.shape[1], _BLOCK)
        yield pa.RecordBatch.from_pydict(
            {"block": pa.array(blocks, pa.int64()), "toxic": [counts[1, b : b + _BLOCK].tobytes() for b in blocks], "other": [counts[0, b : b + _BLOCK].tobytes() for b in blocks]}
        )

    return sample.mapInArrow(run, "block long, toxic binary, other binary")


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows_per_class: int = ROWS_PER_CLASS, features: int = FEATURES
) -> Classifier:
    """A classifier fitted on about rows_per_class labelled texts of each class at most."""
    spark = docs.sparkSession
    limit_batches(spark)
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    all_rows = {r.label: r["count"] for r in marked.groupBy("label").count().collect()}
    chosen = F.broadcast(bounded_sample(marked, rows_per_class, key="id", by="label"))
    sample = written(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id").repartition(8, "id"), "toxicity-sample")
    rows = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    nothing = np.full(1 << BUCKET_BITS, -1, np.int16)
    if len(rows) < 2:
        toxic, other = all_rows.get(1, 0), all_rows.get(0, 0)
        return Classifier(nothing, np.zeros(1), float(np.log((toxic + 1) / (other + 1))))

    def ratios(pdf: pd.DataFrame) -> pd.DataFrame:
        p = np.sum([np.frombuffer(x, np.int32) for x in pdf.toxic], axis=0, dtype=np.int64)
        q = np.sum([np.frombuffer(x, np.int32) for x in pdf.other], axis=0, dtype=np.int64)
        some = np.flatnonzero(p + q >= LEAST_TEXTS)
        p, q = p[some], q[some]
        rate_p, rate_q = (p + SMOOTHING) / (rows[1] + 2 * SMOOTHING), (q + SMOOTHING) / (rows[0] + 2 * SMOOTHING)
        both = (p + q + SMOOTHING) / (rows[1] + rows[0] + 2 * SMOOTHING)
        # The likelihood gain of separate rates, both ways.
        gain = rows[1] * (rate_p * np.log(rate_p / both) + (1 - rate_p).clip(1e-9) * np.log(((1 - rate_p) / (1 - both)).clip(1e-9)))
        gain += rows[0] * (rate_q * np.log(rate_q / both) + (1 - rate_q).clip(1e-9) * np.log(((1 - rate_q) / (1 - both)).clip(1e-9)))
        return pd.DataFrame({"bucket": some + int(pdf.block.iloc[0]), "ratio": np.log(rate_p / rate_q), "gain": gain})

    table = _counted(sample).groupBy("block").applyInPandas(ratios, "bucket long, ratio double, gain double")
    best = table.orderBy(F.desc("gain"), "bucket").limit(features).collect()
    feature = nothing.copy()
    feature[[r.bucket for r in best]] = np.arange(len(best))
    ratio = np.array([r.ratio for r in best])
    bare = Classifier(feature, ratio, 0.0)
    shipped = spark.sparkContext.broadcast(bare)

    def bits(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                packed = [row.tobytes() for texts in _rows(part.column("text")) for row in np.packbits(shipped.value.present(texts), axis=1)]
                yield pa.RecordBatch.from_arrays([part.column("id").cast(pa.string()), part.column("label"), pa.array(packed, pa.binary())], ["id", "label", "bits"])

    got = sample.mapInArrow(bits, "id string, label int, bits binary").orderBy("id", "label", "bits").collect()
    x = np.frombuffer(b"".join(r.bits for r in got), np.uint8).reshape(len(got), -1)
    y = np.array([r.label for r in got], np.float32)
    weight, intercept = _regression(x, y, ratio.astype(np.float32))
    # The sample's share of toxic texts may differ from that of all labelled rows.
    intercept += np.log(all_rows[1] / all_rows[0]) - np.log(rows[1] / rows[0])
    return Classifier(feature, weight * ratio, float(intercept))


def _regression(packed: np.ndarray, y: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the scaled features and the intercept, by Adam with the weights' squares as penalty."""
    rng = np.random.default_rng(SEED)
    w = np.zeros(len(ratio) + 1, np.float32)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), MINIBATCH):
            own = order[at : at + MINIBATCH]
            x = np.unpackbits(packed[own], axis=1, count=len(ratio)).astype(np.float32) * ratio
            error = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -50, 50))) - y[own]
            g = np.append(x.T @ error / len(own) + L2 * w[:-1], error.mean())
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= RATE * (1 - epoch / EPOCHS) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1].astype(np.float64), float(w[-1])


def score(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, F.Column] | None = None) -> DataFrame:
    """(id, extra columns, score) of each row; score is the probability that the text is toxic."""
    shipped = docs.sparkSession.sparkContext.broadcast(classifier)

    def judge():
        return lambda texts: [np.concatenate([shipped.value.scores(own) for own in _rows(texts)])]

    return with_scores(docs, id_col, text_col, judge, [("score", pa.float64())], extra)
