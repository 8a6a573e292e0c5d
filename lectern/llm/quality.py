"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

Statistics of the whole text are standardised, clipped and lifted by random Fourier features, which
approximate a Gaussian kernel. Every partition of the labelled rows sums its part of the normal
equations, once for each of ``FOLDS`` folds; the sums have a fixed size, whatever the corpus, and at
most ``fit_tasks`` of them reach the driver, which solves the ridge system. Rows are then scored by
the models that did not see their fold, and a histogram of these scores (``BINS`` bins) is made
monotone by pooling adjacent violators, which turns raw scores into probabilities.

No statistic depends on labels, language, source or id. All labelled rows outside the held-out fifth
(crc32 of the id as text, modulo 5, is 0) are used.

Defined cases: a null text counts as empty; empty texts are scored like others; several labels of one
doc_id count as their mean; labels without a document, null labels and null ids are not learnt from;
without any usable label every score is 0.5; repeated rows get equal scores; an empty table gives an
empty result; other columns are ignored by ``scores`` and kept by ``keep_good``.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise

FOLDS = 4
BINS = 500
STATISTICS = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "longest_word", "distinct_words", "commonest_word", "adjacent_repeats",
    "capitalised_words", "log_line_words", "distinct_lines", "line_share", "upper", "lower", "digits", "beyond_ascii", "sentence_marks", "commas",
    "exclamations", "bars", "symbols", "brackets", "byte_entropy", "compressed",
)
_SYMBOLS = list(b"*$%&#@^~_=+")
_BRACKETS = list(b"()[]{}<>/\\\"';:")


def statistics(text: str | None) -> list[float]:
    """The STATISTICS of a whole text."""
    raw = (text or "").encode("utf-8", "replace")
    n = len(raw)
    if not n:
        return [0.0] * len(STATISTICS)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    nw = max(1, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    parts = raw.split(b"\n")
    share = hist[hist > 0] / n
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), float(size.mean()), float(np.log1p(size.std())), float(np.log1p(size.max())),
        len(counts) / nw, max(counts.values(), default=0) / nw, sum(map(bytes.__eq__, words, words[1:])) / nw,
        sum(1 for w in words if 65 <= w[0] <= 90) / nw, float(np.log1p(nw / len(parts))), len(set(parts)) / len(parts), len(parts) / nw,
        hist[65:91].sum() / n, hist[97:123].sum() / n, hist[48:58].sum() / n, hist[128:].sum() / n, (hist[46] + hist[63]) / n, hist[44] / n,
        hist[33] / n, hist[124] / n, hist[_SYMBOLS].sum() / n, hist[_BRACKETS].sum() / n, float(-(share * np.log2(share)).sum()),
        len(zlib.compress(raw, 1)) / n,
    ]


@dataclass
class Model:
    """Everything that turns statistics into a score; its size does not depend on the corpus."""

    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    shift: np.ndarray
    weights: np.ndarray  # one column for each fold left out, then one for all folds
    raw: np.ndarray  # ascending raw scores ...
    probability: np.ndarray  # ... and what they are calibrated to

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        waves = np.sqrt(2 / len(self.shift)) * np.cos(z @ self.directions + self.shift)
        return np.hstack([np.ones((len(x), 1)), z, waves])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        if not len(self.raw):
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.lift(x) @ self.weights[:, -1], self.raw, self.probability), 0, 1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def document_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, stats): the statistics of every row."""

    def batches(it):
        for b in it:
            x = pa.array([statistics(t.as_py()) for t in b.column(1)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), x], ["doc_id", "stats"])

    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(batches, "doc_id long, stats array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _pooled(weight: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Least-squares increasing fit of positive / weight, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for w, p in zip(weight, positive):
        blocks.append([w, p, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            for i in range(3):
                blocks[-1][i] += last[i]
    return np.concatenate([np.full(int(k), p / w) for w, p, k in blocks])


def fit(stats: DataFrame, labels: DataFrame, waves: int = 160, ridge: float = 1e-3, fit_tasks: int = 12, seed: int = 7) -> Model:
    """stats: (doc_id, stats); labels: (doc_id, quality). Learns from rows outside the held-out fifth."""
    d = len(STATISTICS)
    per = labels.filter("quality is not null").groupBy(F.col("doc_id").alias("l_id")).agg(F.avg(F.col("quality").cast("double")).alias("y"))
    train = stats.join(per, F.col("doc_id") == F.col("l_id")).filter(~held_out(F.col("doc_id")))
    train = materialise(train.select("stats", "y", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % (FOLDS + 1) - 1).cast("int").alias("fold")), "labelled")
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(d, waves)) / np.sqrt(d)
    shift = rng.uniform(0, 2 * np.pi, waves)
    sums = train.select(F.col("y"), *(F.col("stats")[i].alias(f"s{i}") for i in range(d))).agg(
        F.count("*").alias("n"), F.sum("y").alias("y"), *(f(F.col(f"s{i}")).alias(f"{k}{i}") for i in range(d) for k, f in (("m", F.avg), ("d", F.stddev_pop)))
    ).first()
    if not sums["n"]:
        return Model(np.zeros(d), np.ones(d), directions, shift, np.zeros((1 + d + waves, 1)), np.zeros(0), np.zeros(0))
    spread = np.array([sums[f"d{i}"] for i in range(d)])
    model = Model(np.array([sums[f"m{i}"] for i in range(d)]), np.where(spread > 1e-9, spread, 1.0), directions, shift, np.zeros(0), np.zeros(0), np.zeros(0))
    size = 1 + d + waves

    def equations(it):
        total = np.zeros((FOLDS, size, size + 1))
        for b in it:
            phi, y, fold = model.lift(_matrix(b.column(0))), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            for k in range(FOLDS):
                if len(own := phi[fold == k]):
                    total[k] += own.T @ np.hstack([own, y[fold == k, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = train.repartition(fit_tasks).mapInArrow(equations, "sums binary").collect()  # at most fit_tasks rows of one size
    folds = sum(np.frombuffer(r["sums"]).reshape(FOLDS, size, size + 1) for r in parts)
    whole = folds.sum(axis=0)
    penalty = np.diag([1e-9, *[ridge] * (size - 1)]) * max(1.0, whole[0, 0])

    def solve(m: np.ndarray) -> np.ndarray:
        return np.linalg.lstsq(m[:, :-1] + penalty, m[:, -1], rcond=None)[0]

    model.weights = np.stack([*(solve(whole - f) for f in folds), solve(whole)], axis=1)

    def raw_scores(it):
        hist = np.zeros((BINS, 2))
        for b in it:
            x, y, fold = _matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            if len(x):
                raw = (model.lift(x) @ model.weights)[np.arange(len(x)), fold]
                at = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
                np.add.at(hist, (at, 0), 1)
                np.add.at(hist, (at, 1), y)
        used = np.flatnonzero(hist[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(hist[used, 0]), pa.array(hist[used, 1])], ["bin", "n", "y"])

    bins = train.mapInArrow(raw_scores, "bin long, n double, y double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).collect()
    bins = sorted((r["bin"], r["n"], r["y"]) for r in bins)  # at most BINS rows
    at, n, y = (np.array(c, float) for c in zip(*bins))
    model.raw, model.probability = (at + 0.5) / BINS * 2 - 0.5, _pooled(n, y)
    return model


def scores(stats: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of stats."""

    def batches(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(b.column(1))) if b.num_rows else [], pa.float64())], ["doc_id", "score"])

    scored = stats.select("doc_id", "stats").mapInArrow(batches, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs that the model does not reject, in one pass and without a shuffle."""
    at = docs.columns.index(text)

    def batches(it):
        for b in it:
            x = np.array([statistics(t.as_py()) for t in b.column(at)], float).reshape(-1, len(STATISTICS))
            yield b.filter(pa.array(model.score(x) >= threshold))

    return bounded_batches(docs).mapInArrow(batches, docs.schema)


def query(spark, sf_dir):
    from .common import table

    stats = materialise(document_statistics(table(spark, sf_dir, "documents")), "statistics")
    return scores(stats, fit(stats, table(spark, sf_dir, "labels")))
