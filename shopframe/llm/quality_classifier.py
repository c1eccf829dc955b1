"""Quality classifier by co-training.

Two classifiers see different views of a document: its text content, and the
metadata of its page (language, source, size and layout).  In every round
each view scores all unlabelled documents, and those it is sure of (a
probability of ``SURE``) are labelled rows of the other view's next fit.  At
the end both views are calibrated on labelled rows kept back, combined by a
logistic regression of their calibrated log-odds, and all documents are scored.

The labelled rows are a bounded sample, at most ``per_class`` of each class,
chosen by a hash of the id.  The unlabelled documents are all of them, at every
size: a Newton step of a fit sums gradient and second derivatives over them in
Spark, and a few thousand sums come to the driver.  Pseudo-labelled rows weigh
as much together as the labelled ones, half of it for each class, so that the
say of the labels does not drift with the number of documents; calibration
brings the prior back.

Defined cases: null and empty texts have zero content features; null
metadata is a value of its own; rows whose id or label is null are not
learned from; without labels of both classes every score is ``1.0`` (nothing
is rejected); repeated rows get equal scores; an empty table gives an empty
result.  Other columns pass through ``keep_good`` untouched.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_rows, stored
from .toxicity import fit_logistic

PUNCTUATION = [c for c in range(33, 127) if not chr(c).isalnum()]
BUCKETS = 32
CALIBRATION_FOLD = 5  # one labelled row in so many is kept back
SURE = 0.95
#: Bounds of a standardised feature, and of a weight's move in a Newton step.
FAR, MOST_MOVE = 8.0, 0.5
#: Scores below it are rejected: low, as a clean document lost costs more than
#: a poor one kept.
THRESHOLD = 0.2


def content_view(text: str | None) -> list[float]:
    """Features of the words and signs of a text; none of its size."""
    words = (text or "").split()
    if not words:
        return [0.0] * (len(PUNCTUATION) + 8)
    n = len(words)
    raw = np.bincount(np.frombuffer(" ".join(words).encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)
    chars = int(raw.sum())
    lines = [x for x in text.split("\n") if x.strip()]
    signs = np.log1p(100.0 * raw[PUNCTUATION] / n)
    return [
        *signs.tolist(),
        sum(map(str.isupper, words)) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        len(set(words)) / n,
        min(1.0, len(set(words)) / math.sqrt(n) / 10),
        1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(chars / n),
        float(raw[48:58].sum()) / chars,
        float(raw[65:91].sum()) / chars,
    ]


def metadata_view(text: str | None, lang: str | None, source: str | None) -> list[float]:
    """Language, source, size and layout."""
    text = text or ""
    lines = text.count("\n") + 1
    hashed = [0.0] * (2 * BUCKETS)
    hashed[zlib.crc32(f"{lang}".encode()) % BUCKETS] = 1.0
    hashed[BUCKETS + zlib.crc32(f"{source}".encode()) % BUCKETS] = 1.0
    size = math.log1p(len(text))
    return [size, size * size / 10, math.log1p(lines), math.log1p(len(text) / lines), *hashed]


class View:
    """A logistic regression over standardised features, with calibration."""

    RIDGE = 2.0

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean = x.mean(axis=0)
        self.scale = np.maximum(x.std(axis=0), 1e-3)
        self.x, self.y = self.standard(x), y
        self.weights = fit_logistic(self.x[:, :-1], y, ridge=self.RIDGE)
        self.a, self.b = 1.0, 0.0

    def standard(self, x: np.ndarray) -> np.ndarray:
        """Standardised features and a one; what the labelled rows hardly have
        must not outweigh all else in others."""
        return np.hstack([np.clip((x - self.mean) / self.scale, -FAR, FAR), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.standard(x) @ self.weights, -30, 30)

    def step(self, more: list[tuple[float, np.ndarray, np.ndarray]]) -> float:
        """One Newton step over the labelled rows and, per class, pseudo-labelled
        ones: their number, gradient and second derivatives.  Returns the
        largest move of a weight."""
        p = sigmoid(self.x @ self.weights)
        penalty = self.RIDGE * np.eye(len(self.weights))
        penalty[-1, -1] = 1e-6
        second = (self.x * (p * (1 - p))[:, None]).T @ self.x + penalty
        first = self.x.T @ (self.y - p) - penalty @ self.weights
        if all(n for n, _, _ in more):
            for label, (n, gradient, curvature) in enumerate(more):
                weight = len(self.y) / 2 / n
                first, second = first + weight * gradient, second + weight * curvature
        move = np.linalg.solve(second, first)
        move *= min(1.0, MOST_MOVE / max(np.abs(move).max(), 1e-12))  # far from the solution, steps overshoot
        self.weights = self.weights + move
        return float(np.abs(move).max())

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        self.a, self.b = fit_logistic(self.raw(x)[:, None], y, ridge=0.1)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.a * self.raw(x) + self.b, -20, 20)


def sigmoid(v):
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def pseudo_sums(data: list[np.ndarray], views: list[View], sure: list[np.ndarray]) -> np.ndarray:
    """Of each view, for the rows that the other is sure are of class 0, then
    1: number, gradient, second derivatives, one after another.  ``sure`` are
    the weights with which the views judge."""
    x = [v.standard(d) for v, d in zip(views, data)]
    out = []
    for taker, giver in ((0, 1), (1, 0)):
        given = sigmoid(x[giver] @ sure[giver])
        for label, mask in ((0, given <= 1 - SURE), (1, given >= SURE)):
            rows = x[taker][mask]
            p = sigmoid(rows @ views[taker].weights)
            out += [[float(len(rows))], rows.T @ (label - p), ((rows * (p * (1 - p))[:, None]).T @ rows).ravel()]
    return np.concatenate(out)


def co_train(pool: DataFrame, views: list[View], rounds: int, steps: int) -> None:
    """Fits the views further, on their labelled rows and on the rows of
    ``pool`` (``c``: content, ``m``: metadata features) of which the other view
    was sure at the beginning of the round."""
    for _ in range(rounds):
        sure = [v.weights.copy() for v in views]
        for _ in range(steps):
            now = list(views)

            def run(batches):
                total = None
                for b in batches:
                    if b.num_rows:
                        one = pseudo_sums([_matrix(b.column(0)), _matrix(b.column(1))], now, sure)
                        total = one if total is None else total + one
                if total is not None:
                    place = np.arange(len(total), dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total)], names=["place", "value"])

            # as many rows as sums, whatever the number of documents
            sums = pool.select("c", "m").mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
            if not sums:
                return
            flat = np.zeros(len(sums))
            flat[[r["place"] for r in sums]] = [r["value"] for r in sums]
            at, moved = 0, 0.0
            for view in views:
                d, more = len(view.weights), []
                for _ in (0, 1):
                    more.append((flat[at], flat[at + 1:at + 1 + d], flat[at + 1 + d:at + 1 + d + d * d].reshape(d, d)))
                    at += 1 + d + d * d
                moved = max(moved, view.step(more))
            if moved < 0.01:
                break


class Model:
    """Both calibrated views and the weights that combine them."""

    def __init__(self, text: View, meta: View, weights: np.ndarray):
        self.text, self.meta, self.weights = text, meta, weights

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.log_odds(text), self.meta.log_odds(meta)
        return sigmoid(a), sigmoid(b), sigmoid(self.weights[0] * a + self.weights[1] * b + self.weights[2])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000, rounds: int = 3, steps: int = 3) -> Model | None:
    """The model; None without labels of both classes."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("label")).where(
        "_id is not null and label in (0, 1)"
    ).dropDuplicates(["_id"])
    order = [F.xxhash64("_id"), F.col("_id")]
    chosen = known.where("label = 0").orderBy(*order).limit(per_class)
    chosen = chosen.unionByName(known.where("label = 1").orderBy(*order).limit(per_class))
    texts = docs.select(
        F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string")
    )
    # at most 2 * per_class rows of two numbers: bounded, so broadcast
    sample = texts.join(F.broadcast(chosen), "_id")

    def make():
        return lambda i, text, lang, source, label: (i, label, content_view(text), metadata_view(text, lang, source))

    rows = sorted(map_rows(
        sample.select("_id", "text", "lang", "source", "label"), "id long, label int, c array<double>, m array<double>", make
    ).collect())
    if len({r["label"] for r in rows}) < 2:
        return None
    back = np.array([zlib.crc32(str(r["id"]).encode()) % CALIBRATION_FOLD == 0 for r in rows])
    y = np.array([r["label"] for r in rows], dtype=float)
    if min(len(set(y[back])), len(set(y[~back]))) < 2:
        back = np.zeros(len(y), bool)  # too few rows to keep any back
    c, m = np.array([r["c"] for r in rows]), np.array([r["m"] for r in rows])

    def features():
        return lambda i, text, lang, source: (i, content_view(text), metadata_view(text, lang, source))

    # the features, not the texts, meet the labels; one plan at every size
    pool = map_rows(texts, "_id long, c array<double>, m array<double>", features)
    pool = stored(pool.join(known.select("_id").hint("merge"), "_id", "left_anti").select("c", "m"), "unlabelled")
    views = [View(c[~back], y[~back]), View(m[~back], y[~back])]
    co_train(pool, views, rounds, steps)
    text, meta = views
    check = back if back.any() else ~back
    text.calibrate(c[check], y[check])
    meta.calibrate(m[check], y[check])
    both = np.column_stack([text.log_odds(c[check]), meta.log_odds(m[check])])
    return Model(text, meta, fit_logistic(both, y[check], ridge=0.5))


def _scores(model: Model | None, text: list, lang: list, source: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if model is None or not text:
        one = np.ones(len(text))
        return one, one, one
    return model.score(np.array([content_view(t) for t in text]), np.array([metadata_view(*x) for x in zip(text, lang, source)]))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **settings) -> DataFrame:
    """Per document ``doc_id``, the calibrated scores of both views, the
    combined ``score`` and ``kept``."""
    bounded_batches(docs.sparkSession)
    model = fit(docs, labels, **settings)

    def run(batches):
        for b in batches:
            a, m, s = _scores(model, *(b.column(i).to_pylist() for i in (1, 2, 3)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(a), pa.array(m), pa.array(s), pa.array(s >= threshold)],
                names=["doc_id", "text_score", "metadata_score", "score", "kept"],
            )

    return docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string")
    ).mapInArrow(run, "doc_id long, text_score double, metadata_score double, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **settings) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns; no
    shuffle."""
    bounded_batches(docs.sparkSession)
    model = fit(docs, labels, **settings)
    at = [docs.columns.index(c) for c in ("text", "lang", "source")]

    def run(batches):
        for b in batches:
            _, _, s = _scores(model, *(b.column(i).to_pylist() for i in at))
            yield b.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)
