"""Quality classifier: Bradley-Terry pairwise ranking.

Every text gets a vector of surface features. Preference pairs (a document
labelled good is preferred to one labelled bad) train a linear score by
logistic loss on feature differences; the score's cut is a quantile of the
training scores. Only the text enters the score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from basketry.llm.common import lean, shingle_hashes, text_of, text_slices, word_bounds, word_hashes

FEATURES = ("words", "word_len", "upper", "digits", "bangs", "pipes", "symbols", "stops", "other", "newlines", "long_words",
            "word_repeats", "bigram_repeats", "trigram_repeats", "echoes", "line_repeats", "upper_words", "symbol_words")

_CLASS = np.full(256, 8, np.uint8)  # other printable ASCII
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!", b"|", b"#*$%&<>", b".,;:?'\"()-", b"\n")):
    _CLASS[list(_chars)] = _k
_CLASS[[32, 9, 11, 12, 13]] = 9
_CLASS[128:192] = 10  # continuation bytes
_CLASS[192:] = 1  # a letter beyond ASCII, as a rule


def _repeat_share(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Per row, the share of items that repeat an earlier item of the row."""
    total = np.bincount(rows, minlength=n).astype(float)
    if len(rows) == 0:
        return total
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    again = np.zeros(len(r), bool)
    again[1:] = (r[1:] == r[:-1]) & (h[1:] == h[:-1])
    return np.bincount(r[again], minlength=n) / np.maximum(total, 1)


def slice_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, len(FEATURES)) of one slice; an empty text is all zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    if len(data) == 0:
        return out
    kind = _CLASS[data]
    # upper-case Latin-1 letters: C3 followed by 80..9E
    caps = np.zeros(len(data), bool)
    caps[:-1] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    kind = np.where(caps, 0, kind)
    row_of = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(row_of * 11 + kind, minlength=n * 11).reshape(n, 11).astype(float)
    chars = np.maximum(counts.sum(1) - counts[:, 10], 1)
    letters = np.maximum(counts[:, 0] + counts[:, 1], 1)
    starts, ends, rows = word_bounds(data, offsets)
    words = np.bincount(rows, minlength=n).astype(float)
    w1 = np.maximum(words, 1)
    h = word_hashes(data, starts, ends)
    size = ends - starts
    out[:, 0] = np.log1p(words)
    out[:, 1] = np.log1p(np.bincount(rows, weights=size, minlength=n) / w1)
    out[:, 2] = np.sqrt(counts[:, 0] / letters)
    for j, k in ((3, 2), (4, 3), (5, 4), (6, 5), (7, 6), (8, 8), (9, 7)):
        out[:, j] = np.sqrt(counts[:, k] / chars)
    out[:, 10] = np.sqrt(np.bincount(rows[size > 25], minlength=n) / w1)
    out[:, 11] = _repeat_share(rows, h, n)
    for j, k in ((12, 2), (13, 3)):
        if len(h) >= k:
            g, r = shingle_hashes(h, k), rows[:len(h) - k + 1]
            whole = r == rows[k - 1:]
            out[:, j] = _repeat_share(r[whole], g[whole], n)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
    out[:, 14] = np.sqrt(np.bincount(rows[same], minlength=n) / w1)
    # lines are words of a text whose only separator is \n
    lines = np.where(data == 10, 32, np.where(data == 32, 1, data)).astype(np.uint8)
    ls, le, lr = word_bounds(lines, offsets)
    out[:, 15] = _repeat_share(lr, word_hashes(lines, ls, le), n)
    upper_at, symbol_at = np.concatenate(([0], np.cumsum(kind == 0))), np.concatenate(([0], np.cumsum((kind == 5) | (kind == 4) | (kind == 3))))
    up, sy = upper_at[ends] - upper_at[starts], symbol_at[ends] - symbol_at[starts]
    out[:, 16] = np.bincount(rows[(up * 2 > size) & (size > 1)], minlength=n) / w1
    out[:, 17] = np.bincount(rows[sy > 0], minlength=n) / w1
    return out


def batch_features(batch: pa.RecordBatch, column: str) -> np.ndarray:
    parts = [slice_features(data, offsets) for _, _, data, offsets in text_slices(batch, column)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.latent(x) - self.cut, -30, 30)))


def bradley_terry(good: np.ndarray, bad: np.ndarray, pairs_per: int = 8, ridge: float = 1e-2, steps: int = 60, seed: int = 7) -> np.ndarray:
    """Weights that minimise mean log(1 + exp(-w.(good - bad))) + ridge |w|^2 / 2
    over preference pairs, by Newton's method. Every document of the larger
    class stands in ``pairs_per`` pairs."""
    rng = np.random.default_rng(seed)
    n = max(len(good), len(bad)) * pairs_per
    d = good[rng.permutation(n) % len(good)] - bad[rng.permutation(n) % len(bad)]
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -35, 35)))
        grad = ridge * w - d.T @ p / n
        hess = (d * (p * (1 - p))[:, None]).T @ d / n + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def quantile_cut(scores: np.ndarray, y: np.ndarray) -> float:
    """The cut at the quantile of ``scores`` with the fewest training errors
    (the middle one of equally good cuts)."""
    order = np.argsort(scores, kind="stable")
    s, t = scores[order], y[order]
    errors = np.concatenate(([0], np.cumsum(t == 1))) + np.concatenate((np.cumsum((t == 0)[::-1])[::-1], [0]))
    edges = np.concatenate(([s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]))
    real = np.concatenate(([True], s[1:] > s[:-1], [True]))  # no cut between ties
    best = np.flatnonzero(real & (errors == errors[real].min()))
    return float(edges[best[len(best) // 2]])


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """One class or no rows: a flat model, which keeps everything."""
    flat = Model(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(len(FEATURES)), 0.0)
    if len(x) == 0 or (y == 1).all() or (y == 0).all():
        return flat
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = np.clip((x - mean) / scale, -8, 8)
    w = bradley_terry(z[y == 1], z[y == 0])
    return Model(mean, scale, w, quantile_cut(z @ w, y))


def _features(batches):
    for b in batches:
        x = batch_features(b, "__text")
        cols = [b.column("id"), b.column("y"), *[pa.array(x[:, j]) for j in range(len(FEATURES))]]
        yield pa.RecordBatch.from_arrays(cols, ["id", "y", *FEATURES])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        trainable: Column | None = None, max_labelled: int = 20_000) -> Model:
    """Fits on at most ``max_labelled`` labelled rows, the first by the MD5 of
    their id, so the sample does not depend on partitioning.

    ``trainable`` (over the labels' columns) restricts the labels used. An id
    labelled several times takes its smallest label, an id that several rows
    carry its smallest text; null ids and null labels are ignored.
    """
    use = labels if trainable is None else labels.filter(trainable)
    truth = (use.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).filter("id is not null and y is not null")
             .groupBy("id").agg(F.min("y").cast("int").alias("y")))
    chosen = truth.withColumn("_h", F.md5(F.col("id").cast("string").cast("binary"))).orderBy("_h").limit(max_labelled).drop("_h")
    texts = docs.select(F.col(id_col).alias("id"), text_of(docs, text_col).alias("__text"))
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("__text").alias("__text"))
    shape = StructType([*rows.select("id", "y").schema, *[StructField(f, DoubleType()) for f in FEATURES]])
    got = rows.mapInArrow(lean(_features), shape).orderBy("id").toPandas()
    return train(got[list(FEATURES)].to_numpy(float), got["y"].to_numpy())


def score(docs: DataFrame, model: Model, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """``keep`` columns and ``score``, one row per row (null text as empty)."""
    base = docs.select(*[c.alias(k) for k, c in keep.items()], text_of(docs, text_col).alias("__text"))
    names = list(keep)

    def run(batches):
        for b in batches:
            s = model.score(batch_features(b, "__text"))
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in names], pa.array(s)], [*names, "score"])

    return base.mapInArrow(lean(run), StructType([*base.drop("__text").schema.fields, StructField("score", DoubleType())]))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, fold: int = 1, max_labelled: int = 20_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Labels of ids whose crc32 modulo ``folds`` is ``fold`` are never learnt.
    Empty and null texts are scored like any other. Without labels of both
    classes every score is 0.5 (predicted 1).
    """
    def out_of_fold(c):
        return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds == fold

    model = fit(docs, labels, id_col, text_col, trainable=~out_of_fold(F.col(id_col)), max_labelled=max_labelled)
    out = score(docs, model, {"doc_id": F.col(id_col), "held_out": out_of_fold(F.col(id_col))}, text_col)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
