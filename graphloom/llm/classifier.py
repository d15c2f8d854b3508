"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of whole texts are standardised and mapped to cosines whose inner products approximate a Gaussian kernel.
Normal equations are summed a partition at a time and added up over the cluster; only their sums, whose size the
number of features sets, reach the driver. A score is the ridge value of a document, calibrated by isotonic regression of
the labels on values that come from models which have not seen them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_columns, map_texts, settle

#: Bytes by class: a-z, A-Z, digits, blanks, ASCII marks, all above ASCII.
CLASSES = np.zeros(256, dtype=np.int64)
CLASSES[65:91], CLASSES[48:58], CLASSES[[9, 10, 11, 12, 13, 32]] = 1, 2, 3
CLASSES[128:] = 5
CLASSES[[b for b in range(33, 127) if not chr(b).isalnum()]] = 4
SENTENCE_ENDS = [ord(c) for c in ".!?"]

NAMES = (
    "words", "mean_word", "spread_word", "longest_word", "upper", "digits", "blanks", "marks", "wide", "entropy", "mark_entropy", "sentence",
    "lines", "repeated_lines", "distinct_words", "top_word", "repeated_pairs", "marked_words", "capital_words", "short_words",
)


def statistics(text: str | None) -> list[float]:
    """The numbers NAMES of a whole text. Null and empty texts have zeros."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    shares = np.bincount(CLASSES, weights=counts, minlength=6) / len(raw)
    p = counts[counts > 0] / len(raw)
    marks = counts[CLASSES == 4]
    m = marks[marks > 0] / max(1, marks.sum())
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    n = len(words)
    found = Counter(words)
    pairs = len(set(pairwise(words)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ends = int(counts[SENTENCE_ENDS].sum())
    alone = sum(k for w, k in found.items() if not w[-1:].isalnum() and w[-1] < 128)
    capital = sum(k for w, k in found.items() if w[:1].isupper())
    return [
        np.log1p(n), np.log1p(sizes.mean()), np.log1p(sizes.std()), np.log1p(sizes.max()), *np.sqrt(shares[1:]), float(-(p * np.log2(p)).sum()), float(-(m * np.log2(m)).sum()), np.log1p(n / (ends + 1)),
        np.log1p(n / len(lines)), np.sqrt(1 - len(set(lines)) / len(lines)), np.log(len(found) / n), np.sqrt(max(found.values()) / n), np.sqrt(1 - pairs / max(1, n - 1)), np.sqrt(alone / n), np.sqrt(capital / n), np.sqrt((sizes <= 2).mean()),
    ]


def document_statistics(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with _x, the statistics of the whole text."""
    kept = kept_columns(df, keep if keep is not None else [c for c in df.columns if c != text], "_x")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([statistics(x.as_py()) for x in batch.column(batch.num_columns - 1)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*batch.schema.names[:-1], "_x"])

    return map_texts(df, text, kept, work, "_x array<double>")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class FourierMap:
    """1 and cosines of random directions of the standardised statistics.

    sqrt(2 / features) cos(w x + b), w from a normal distribution of deviation 1 / width, has as inner products a Gaussian
    kernel of that width, but for an error of about 1 / sqrt(features).
    """

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int, width: float, seed: int):
        made = np.random.default_rng(seed)
        self.mean, self.scale = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.directions = made.normal(size=(len(mean), features)) / width
        self.shifts = made.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        phi = np.sqrt(2 / len(self.shifts)) * np.cos(z @ self.directions + self.shifts)
        return np.hstack([np.ones((len(x), 1)), phi])


def isotonic(points: list[tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending (value, weight, mean label) pooled until means ascend: the values at which a mean begins or ends, and the means."""
    pools: list[list[float]] = []  # first value, last value, weight, sum
    for value, weight, mean in sorted(points):
        pools.append([value, value, weight, weight * mean])
        while len(pools) > 1 and pools[-2][3] * pools[-1][2] >= pools[-1][3] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    # A constant stays just inside 0 and 1 by the weight it rests on.
    return np.array([v for p in pools for v in p[:2]]), np.array([m for p in pools for m in [(p[3] + 0.5) / (p[2] + 1)] * 2])


def normal_sums(rows: DataFrame, mapped: FourierMap, folds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums a fold of phi phi', phi y and 1, from rows (_x, label, fold).

    Each partition sums its rows; the sums travel a matrix row at a time and are added up by row over the cluster, so the
    driver gets folds matrices, however many rows and partitions there are.
    """
    size, width = len(mapped.shifts) + 1, len(mapped.mean)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((folds, size, size + 2))
        for batch in batches:
            if batch.num_rows:
                phi, y, fold = mapped(matrix(batch.column(0), width)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
                for k in np.unique(fold):
                    own = phi[fold == k]
                    sums[k, :, :size] += own.T @ own
                    sums[k, :, size] += own.T @ y[fold == k]
                    sums[k, 0, size + 1] += len(own)
        for k in range(folds):
            if sums[k, 0, size + 1]:
                yield given(np.arange(size) + k * size, sums[k])

    def given(at: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(list(found), pa.list_(pa.float64()))], names=["at", "sums"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, row in zip(batch.column(0).to_pylist(), matrix(batch.column(1), size + 2), strict=True):
                held[at] = held[at] + row if at in held else row.copy()
        if held:
            yield given(np.array(list(held)), np.array(list(held.values())))

    out = np.zeros((folds, size, size + 2))
    summed = rows.select("_x", "label", "fold").mapInArrow(partial, "at long, sums array<double>").repartition("at").mapInArrow(total, "at long, sums array<double>")
    for row in summed.toArrow().to_pylist():
        out[divmod(row["at"], size)] = row["sums"]
    return out[:, :, :size], out[:, :, size], out[:, 0, size + 1]


def score_quality(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", features: int = 256, width: float = 2.0, ridges: tuple[float, ...] = (1e-3, 1e-2, 1e-1, 1.0), folds: int = 4, seed: int = 7, steps: int = 4096
) -> DataFrame:
    """docs but for the text, with _score from 0 to 1: how likely the label is 1. labels: key and label (0 or 1) of some documents.

    Every row of labels that has a label and names a document teaches, as often as both are there. `width` is a multiple of
    the square root of the number of statistics. Of `ridges` that with the least squared error on rows outside the fold
    is taken, and its values on such rows, rounded to 1 / steps of their range from -1 to 2, are calibrated: the driver gets
    3 * steps points at most. Empty and null texts are scored like others, equal texts equally; without any label all scores
    are 0.5, with labels of one class near that class. Other columns stay, but for one named _score.
    """
    rows = settle(document_statistics(docs, text, [c for c in docs.columns if c not in (text, "_score")]))
    taught = labels.where(F.col("label").isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col("label").cast("double").alias("label"))
    fold = F.pmod(F.xxhash64(F.col(key)), F.lit(folds)).cast("int").alias("fold")
    taught = settle(rows.join(taught, F.col(key) == F.col("_key")).select("_x", "label", fold))
    size = len(NAMES)
    sums = taught.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("_x")[i]).alias(f"s{i}") for i in range(size)], *[F.sum(F.col("_x")[i] * F.col("_x")[i]).alias(f"q{i}") for i in range(size)]).first()
    n = sums["n"]
    others = [F.col(f"`{c}`") for c in rows.columns if c != "_x"]
    if not n:
        return rows.select(*others, F.lit(0.5).alias("_score"))
    mean = np.array([sums[f"s{i}"] for i in range(size)]) / n
    deviation = np.sqrt(np.maximum(np.array([sums[f"q{i}"] for i in range(size)]) / n - mean**2, 0))
    mapped = FourierMap(mean, deviation, features, width * np.sqrt(size), seed)
    a, b, counts = normal_sums(taught, mapped, folds)

    def solved(a: np.ndarray, b: np.ndarray, n: float, ridge: float) -> np.ndarray:
        penalty = np.full(len(b), ridge * max(n, 1) / features)
        penalty[0] = 1e-9  # the constant
        return np.linalg.solve(a + np.diag(penalty), b)

    outside = np.array([[solved(a.sum(0) - a[k], b.sum(0) - b[k], n - counts[k], r) for r in ridges] for k in range(folds)])

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                phi, fold = mapped(matrix(batch.column(0), size)), batch.column(2).to_numpy()
                found = np.einsum("nf,nrf->nr", phi, outside[fold])
                grid = np.clip(np.rint(found * steps), -steps, 2 * steps).astype(np.int64)
                for r in range(len(ridges)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(phi), r)), pa.array(grid[:, r]), batch.column(1)], names=["ridge", "at", "label"])

    points = taught.mapInArrow(values, "ridge long, at long, label double").groupBy("ridge", "at").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("sum")).collect()
    error = {r: sum(p["n"] * (p["at"] / steps) ** 2 - 2 * p["sum"] * p["at"] / steps for p in points if p["ridge"] == r) for r in range(len(ridges))}
    best = min(error, key=lambda r: (error[r], r))
    at, means = isotonic([(p["at"] / steps, p["n"], p["sum"] / p["n"]) for p in points if p["ridge"] == best])
    weights = solved(a.sum(0), b.sum(0), n, ridges[best])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(batch.num_columns - 1)
                # Each row on its own: a row's last bits don't hang on its batch, so equal texts score equally.
                found = np.array([float((mapped(row[None, :]) * weights).sum()) for row in matrix(x, size)])
                score = np.clip(np.interp(np.round(found, 9), at, means), 0.0, 1.0)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.round(score, 9))], names=[*batch.schema.names[:-1], "_score"])

    kept = rows.select(*others)
    return rows.select(*others, "_x").mapInArrow(scored, kept.withColumn("_score", F.lit(0.0)).schema)
