"""Quality classifier by positive-unlabelled learning.

Trusted positives are training-fold documents that every label calls good; unlabelled text is the whole
training fold. A linear model on shape features of the whole text minimises the non-negative unbiased
risk with the logistic loss,
    prior * mean_P loss(g) + max(0, mean_U loss(-g) - prior * mean_P loss(-g)),
by damped Newton steps; a step that would make the second term negative is halved, so the estimate of
the negative part never falls below zero. Sums over all rows come from one small job for each step and
one row of fixed size for each task. The class prior is estimated first: the smallest ratio of
unlabelled to positive mass above a threshold of a positive-against-unlabelled score.

Defined cases: null and empty texts have the features of an empty text and get a score like others;
labels of null are ignored; without any positive every score is the prior 0.5; repeated rows and null
ids are scored (ids only decide folds and labels; null ids are in no fold's training). Very long texts
count whole, a slice of texts being held at a time; texts with equal features tie at equal scores.
Hashed shares of character trigrams and word pairs as further features were tried and made held-out
labels worse, so they are left out (figures in the README).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _LOWER, distinct_by_row, materialize, read, slices, span_hashes, text_bytes, word_spans

STEPS, RIDGE, BINS = 14, 1e-4, 2000


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[[ord(c) for c in chars]] = 1
    return table


_SENTENCE = ".,;:?!'\"()-"
_SYMBOL = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in _SENTENCE)
_TABLES = {
    "char": np.concatenate([np.ones(128, np.int64), np.zeros(64, np.int64), np.ones(64, np.int64)]),
    "upper": _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "digit": _class("0123456789"),
    "symbol": _class(_SYMBOL),
    "sentence": _class(".,;:?"),
    "loud": _class("!"),
}
_LETTERS = np.concatenate([_class("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")[:192], np.ones(64, np.int64)])
N_FEATURES = 15


def features(part: pa.RecordBatch) -> np.ndarray:
    """One row of N_FEATURES numbers for each text; all are shares, means or logarithms of the whole text."""
    data, offsets = text_bytes(part.column("text"))
    n_rows = part.num_rows

    def total(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[data])])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    count = {k: total(t) for k, t in _TABLES.items()}
    letters = total(_LETTERS)
    chars = np.maximum(count["char"], 1)
    starts, ends, first = word_spans(data, offsets)
    rows = np.repeat(np.arange(n_rows), np.diff(first))
    n_words = np.maximum(np.diff(first), 1)
    hashes = span_hashes(_LOWER[data], starts, ends)
    by_row = lambda x: np.bincount(rows, weights=x, minlength=n_rows)
    again = np.zeros(len(rows))
    again[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    own, _ = distinct_by_row(rows, hashes)
    size = (ends - starts).astype(float)
    mean = by_row(size) / n_words
    odd_end = (_TABLES["symbol"] + _TABLES["loud"])[data[ends - 1]] if len(ends) else np.zeros(0)
    newline = np.flatnonzero(data == 10)
    line_starts = np.concatenate([offsets[:-1], newline + 1])
    line_rows = np.concatenate([np.arange(n_rows), np.searchsorted(offsets, newline, "right") - 1])
    order = np.lexsort((line_starts, line_rows))
    line_starts, line_rows = line_starts[order], line_rows[order]
    line_ends = np.append(line_starts[1:], len(data))
    last = np.append(line_rows[1:] != line_rows[:-1], True)
    line_ends = np.where(last, offsets[line_rows + 1], line_ends - 1)
    n_lines = np.bincount(line_rows, minlength=n_rows)
    own_lines, _ = distinct_by_row(line_rows, span_hashes(data, line_starts, line_ends))
    stop = np.zeros(len(line_starts))
    filled = line_ends > line_starts
    stop[filled] = _class(".?!")[data[line_ends[filled] - 1]]
    return np.stack(
        [
            letters / chars, count["upper"] / np.maximum(letters, 1), count["digit"] / chars, np.sqrt(count["symbol"] / chars), count["sentence"] / chars, np.sqrt(count["loud"] / chars),
            np.sqrt(by_row(again) / n_words), np.bincount(own, minlength=n_rows) / n_words, np.log1p(np.diff(first)), np.log1p(mean), np.log1p(np.sqrt(np.maximum(by_row(size**2) / n_words - mean**2, 0))),
            by_row(odd_end) / n_words, 1 - np.bincount(own_lines, minlength=n_rows) / n_lines, np.bincount(line_rows, weights=stop, minlength=n_rows) / n_lines, np.log1p(n_lines),
        ],
        axis=1,
    )


def _featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        x = features(part)
        offsets = pa.array(np.arange(part.num_rows + 1) * N_FEATURES, pa.int32())
        yield pa.record_batch([part.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["doc_id", "x"])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("x")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), N_FEATURES)


def _total(rows: DataFrame, function) -> np.ndarray:
    """Sum over all rows of function(features with a 1 in front, is_positive): one vector for each task, one in the end."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = 0
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([np.ones(batch.num_rows), _matrix(batch)])
                out = out + function(x, batch.column("positive").to_numpy(zero_copy_only=False).astype(bool))
        if not np.isscalar(out):
            yield pa.record_batch([pa.array([out.tolist()])], ["v"])

    found = rows.select("x", "positive").mapInArrow(run, "v array<double>").select(F.posexplode("v")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
    out = np.zeros(len(found))
    for r in found:
        out[r.pos] = r.s
    return out


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, prior: float):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def margin(self, x: np.ndarray) -> np.ndarray:
        """x has a column of ones in front."""
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(np.column_stack([np.ones(len(x)), x])), -40, 40)))


def _moments(z: np.ndarray, positive: np.ndarray) -> np.ndarray:
    return np.concatenate([[positive.sum(), len(z)], z[positive].sum(axis=0), z.sum(axis=0), (z**2).sum(axis=0)])


def _risk(model: Model):
    """Sums for a Newton step: losses, gradient and Hessian of the unlabelled part."""

    def run(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        z = (x - model.mean) / model.scale
        g = z @ model.weights
        p = 1 / (1 + np.exp(-np.clip(g, -40, 40)))
        return np.concatenate([[np.logaddexp(0, g).sum(), np.logaddexp(0, g[positive]).sum(), np.logaddexp(0, -g[positive]).sum()], p @ z, ((z * (p * (1 - p))[:, None]).T @ z).ravel()])

    return run


def _fit(rows: DataFrame, mean, scale, positive_mean, n_p: float, n_u: float, prior: float) -> Model:
    """Minimises the non-negative risk; prior 0 stands for plain positive-against-unlabelled regression."""
    d = N_FEATURES + 1
    model = Model(mean, scale, np.zeros(d), prior or 0.5)
    share = prior or n_p / n_u

    def measured(w: np.ndarray):
        model.weights = w
        s = _total(rows, _risk(model))
        negative = s[0] / n_u - share * s[1] / n_p
        risk = share * s[2] / n_p + max(0.0, negative) + RIDGE / 2 * w @ w
        return risk, negative, s[3 : 3 + d] / n_u - share * positive_mean + RIDGE * w, s[3 + d :].reshape(d, d) / n_u + RIDGE * np.eye(d)

    w = np.zeros(d)
    risk, _, gradient, hessian = measured(w)
    for _ in range(STEPS):
        step, size = np.linalg.solve(hessian, gradient), 1.0
        for _ in range(6):
            tried = measured(w - size * step)
            if tried[0] < risk and (tried[1] >= 0 or not prior):
                break
            size /= 2
        else:
            break
        gained = risk - tried[0]
        w, (risk, _, gradient, hessian) = w - size * step, tried
        if gained < 1e-4:
            break
    model.weights = w
    return model


def _prior(rows: DataFrame, model: Model, n_p: float, n_u: float) -> float:
    """The smallest ratio of unlabelled to positive mass above a threshold, with two standard errors of slack."""
    edges = np.linspace(-20, 20, BINS + 1)[1:-1]

    def run(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        at = np.searchsorted(edges, model.margin(x))
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at[positive], minlength=BINS)]).astype(float)

    s = _total(rows, run)
    u, p = np.cumsum(s[:BINS][::-1]) / n_u, np.cumsum(s[BINS:][::-1]) / n_p
    held = p >= 0.2
    slack = 2 * np.sqrt(p[held] * (1 - p[held]) / n_p + u[held] * (1 - u[held]) / n_u)
    best = np.argmin((u[held] + slack) / p[held])
    return float(np.clip(u[held][best] / p[held][best], n_p / n_u, 0.999))


def train(featured: DataFrame, labels: DataFrame) -> Model | None:
    """featured: doc_id and x of the training fold. labels: doc_id and quality."""
    good = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id", F.lit(True).alias("positive"))
    rows = materialize(featured.join(good, "doc_id", "left").select("x", F.coalesce("positive", F.lit(False)).alias("positive")), "fold")
    d = N_FEATURES + 1
    s = _total(rows, _moments)
    if not len(s) or not s[0]:
        return None
    n_p, n_u = s[0], s[1]
    mean = s[2 + d : 2 + 2 * d] / n_u
    scale = np.sqrt(np.maximum(s[2 + 2 * d :] / n_u - mean**2, 1e-12))
    mean[0], scale[0] = 0, 1
    positive_mean = (s[2 : 2 + d] / n_p - mean) / scale
    first = _fit(rows, mean, scale, positive_mean, n_p, n_u, 0)
    return _fit(rows, mean, scale, positive_mean, n_p, n_u, _prior(rows, first, n_p, n_u))


def score_quality(docs: DataFrame, labels: DataFrame, in_training) -> DataFrame:
    """(doc_id, score, predicted) of every row; `in_training` is a Column over doc_id that picks the fold to learn from."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    featured = materialize(own.mapInArrow(_featured, "doc_id long, x array<double>"), "features")
    model = featured.sparkSession.sparkContext.broadcast(train(featured.filter(in_training), labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.value.score(_matrix(batch)) if model.value else np.full(batch.num_rows, 0.5)
            yield pa.record_batch([batch.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return featured.mapInArrow(run, "doc_id long, score double, predicted int")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string")) % 3
    found = score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), remainder != 1)
    return found.select("doc_id", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"), "score", "predicted")
