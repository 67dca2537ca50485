"""Operator 3: quality classifier by regularised quadratic discriminant analysis.

Method: transformed statistics of a document's characters, words and repetitions; one Gaussian for each label with a
covariance shrunk towards the pooled variances; a score from the difference of the two log densities (Mahalanobis
distances by cached Cholesky factors). Means and covariances come from sums over all labelled training rows: Spark adds
them up, and the driver gets a fixed number of values.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm import common, shingles, worker

_CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:'\"()-?", b"!", b"|", bytes(range(128, 256))), 1):
    _CLASS[list(_chars)] = _k  # 0: other symbols
_UPPER_LATIN = re.compile(r"[À-ÖØ-Þ]")
NAMES = ("bytes", "words", "upper", "symbols", "punctuation", "exclaims", "bars", "digits", "blanks", "lines", "word_length", "word_spread", "equal_neighbours", "distinct_words", "distinct_pairs", "commonest", "entropy")


def statistics(text: str | None) -> list[float]:
    """The values named in NAMES, transformed to be closer to normal; an empty or null text has those of no words."""
    raw = (text or "").encode(errors="surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    n = max(1, len(data))
    counts = np.bincount(data, minlength=256)
    low, up, digit, blank, line, punct, shout, bar, wide = (np.bincount(_CLASS, counts, 10)[1:]).tolist()
    other = counts[_CLASS == 0].sum()
    up += len(_UPPER_LATIN.findall(text)) if wide and text else 0
    h, start = shingles.word_hashes(raw) if len(data) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    m = max(1, len(h))
    ordered = np.sort(h)
    edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
    with np.errstate(over="ignore"):
        pairs = np.sort(h[1:] * np.uint64(3) + h[:-1])
    lengths = np.diff(np.append(start, len(data))) - 1 if len(h) else np.zeros(1)
    p = counts[counts > 0] / n
    share = lambda x, of=n: float(np.sqrt(x / of))
    return [
        float(np.log1p(len(data))),
        float(np.log1p(len(h))),
        share(up, max(1.0, up + low + wide / 2)),
        share(other),
        share(punct),
        share(shout),
        share(bar),
        share(digit),
        share(blank),
        share(line),
        float(np.log1p(np.mean(lengths))),
        float(np.log1p(np.std(lengths))),
        share((h[1:] == h[:-1]).sum(), m),
        (len(edge) - 1) / m / (1 + np.log(m)) * 5,
        float((1 + (pairs[1:] != pairs[:-1]).sum()) / max(1, len(pairs))) if len(pairs) else 1.0,
        share(np.diff(edge).max() if len(h) else 0, m),
        float(-(p * np.log2(p)).sum()) if len(data) else 0.0,
    ]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def statistics_of(texts: pa.Array) -> pa.Array:
    worker.enter("quality")
    return pa.array([statistics(t.as_py()) for t in texts], pa.list_(pa.float64()))


@dataclass(frozen=True)
class Model:
    """prior, mean and inverse Cholesky factor of each label; both None where a label has no training row."""

    parts: tuple[tuple[float, np.ndarray, np.ndarray] | None, ...]

    def differences(self, x: np.ndarray) -> np.ndarray:
        """log density of label 1 less that of label 0, priors included; without both labels, in favour of the one."""
        if None in self.parts:
            return np.full(len(x), -np.inf if self.parts[1] is None and self.parts[0] is not None else np.inf)
        out = []
        for prior, mean, inverse in self.parts:
            z = (x - mean) @ inverse.T
            out.append(np.log(prior) + np.log(np.diag(inverse)).sum() - 0.5 * (z**2).sum(axis=1))
        return out[1] - out[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The differences on a scale from 0 to 1, 0.5 at 0, that keeps their order far from 0 as well."""
        return 0.5 + np.arctan(self.differences(x) / 4) / np.pi


def training_rows(ids: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(ids.cast("string").cast("binary")), F.lit(3)) != 1, F.lit(False))


def fit(features: DataFrame, labels: DataFrame, shrinkage: float = 0.1) -> Model:
    """features: doc_id, x; labels: doc_id, quality. Rows of labels without id or label count for nothing, of several
    for one document the smallest label holds."""
    d = len(NAMES)
    labels = labels.select("doc_id", F.col("quality").alias("label")).filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    rows = features.filter(training_rows(F.col("doc_id"))).join(labels, "doc_id").select("label", "x")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            y = np.asarray(batch.column(0).to_pylist())
            x = np.asarray(batch.column(1).to_pylist()).reshape(-1, d)
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        n = total.size
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) // (n // 2), pa.int32()), pa.array(np.arange(n) % (n // 2), pa.int32()), pa.array(total.ravel())], names=["label", "k", "v"])

    total = np.zeros((2, 1 + d + d * d))
    for r in rows.mapInArrow(sums, "label int, k int, v double").groupBy("label", "k").agg(F.sum("v").alias("v")).collect():
        total[r.label, r.k] = r.v
    n = total[:, 0]
    means = total[:, 1 : 1 + d] / np.maximum(n, 1)[:, None]
    spreads = [total[k, 1 + d :].reshape(d, d) - n[k] * np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = np.diag(np.maximum(np.diag(spreads[0] + spreads[1]) / max(1, n.sum() - 2), 1e-4))
    parts = []
    for k in (0, 1):
        if n[k] == 0:
            parts.append(None)
            continue
        covariance = (1 - shrinkage) * spreads[k] / max(1, n[k] - 1) + shrinkage * pooled
        parts.append((n[k] / n.sum(), means[k], np.linalg.inv(np.linalg.cholesky(covariance))))
    return Model(tuple(parts))


def score_of(model: Model, statistics: str) -> Column:
    @F.arrow_udf(T.DoubleType())
    def score(column: pa.Array) -> pa.Array:
        return pa.array(model.scores(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))), pa.float64())

    return score(F.col(statistics))


def classified(docs: DataFrame, labels: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Model]:
    """doc_id, held_out, score and predicted for every row of docs, and the model behind it.

    Labels are learned from rows whose crc32 of the id as text leaves another remainder than 1 by 3. A null or empty
    text gets a score as any other. A null id is held out (its remainder isn't known). Repeated rows weigh in as often
    as they stand. Without any label every score is 1, with one label only that label's end of the scale. Other columns
    aren't read. The statistics are written to folder, so that texts are read once.
    """
    features = docs.select(F.col(id_col).alias("doc_id"), statistics_of(F.col(text_col)).alias("x"))
    features = common.written(features, f"{folder}/statistics")
    model = fit(features, labels)
    out = features.select("doc_id", (~training_rows(F.col("doc_id"))).alias("held_out"), score_of(model, "x").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")), model


def of_good_quality(docs: DataFrame, labels: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all their columns, that the classifier fitted to docs and labels doesn't reject.

    Nulls, repeats, missing labels and empty tables count as in classified. The rows are written to folder with their
    statistics, so that texts are read once for the fit and the scores.
    """
    name = common.free_name(docs, "statistics")
    rows = common.written(docs.withColumn(name, statistics_of(F.col(text_col))), f"{folder}/rows-and-statistics")
    model = fit(rows.select(F.col(id_col).alias("doc_id"), F.col(name).alias("x")), labels)
    return rows.filter(score_of(model, name) >= 0.5).select(*docs.columns)
