"""Document quality from random Fourier features over text statistics, ridge regression and isotonic calibration.

1. Each text becomes a short vector of statistics (one pass, written once to the shared folder; the texts are not read again).
2. Statistics, scaled by the mean and deviation of the labelled rows, are mapped to cos(x W + b) with fixed random W, b: inner
   products of these features approximate a Gaussian kernel.
3. Every partition of labelled rows adds up its part of the normal equations; Spark sums the parts row by row of the matrix.
   The driver gets one matrix of fixed size and solves the ridge system.
4. Raw scores of labelled rows that the fit did not see are counted on a fixed grid; pooling adjacent violators over the grid
   gives the calibration.

All labelled rows of the learning folds take part. Texts of null or without words have defined statistics (zeros) and get a
score as any other. Labels other than 0 and 1 are ignored. Without labelled rows, or with one class only, all scores equal the share of
label 1 (0.5 without rows). Repeated documents are scored each; a repeated label counts each time. Clashing extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfence.llm.common import fold, lean, slices, stored

STATISTICS = (
    "log_words", "word_length", "word_length_spread", "upper", "digits", "symbols", "punctuation", "pipes", "other_bytes", "distinct_words", "top_word",
    "same_as_before", "repeated_lines", "words_per_line", "byte_entropy", "capital_words",
)
#: Bytes counted as symbols and as punctuation.
SYMBOLS, PUNCTUATION = b"#*$%&<>@^~=+_\\{}[]", b".,;:!?'\"()-/"
#: Grid of raw scores for the calibration: from -1 to 2 in this many steps.
GRID = 600


def statistics(text: str) -> list[float]:
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(data)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.int32, n)
    share = count[count > 0] / size
    lines = [x for x in data.split(b"\n") if x.strip()]
    seen = Counter(words)
    of = lambda chars: count[list(chars)].sum() / size
    return [
        math.log(n), float(lengths.mean()), float(lengths.std()), count[65:91].sum() / size, count[48:58].sum() / size, of(SYMBOLS), of(PUNCTUATION), count[124] / size,
        count[128:].sum() / size, len(seen) / n, max(seen.values()) / n, sum(map(bytes.__eq__, words, words[1:])) / n, 1 - len(set(lines)) / len(lines), math.log(n / len(lines)),
        float(-(share * np.log2(share)).sum()), sum(map(bytes.isupper, words)) / n,
    ]


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, stats (array of float) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, len(texts)), pa.array([statistics(t or "") for t in texts], pa.list_(pa.float32()))], ["doc_id", "stats"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(run), f"doc_id {kind}, stats array<float>")


class FourierRidge:
    """Fitted model: plain arrays that travel with the tasks."""

    def __init__(self, mean, spread, width: int, seed: int, gamma: float):
        r = np.random.default_rng(seed)
        self.mean, self.spread = np.asarray(mean, float), np.asarray(spread, float)
        self.w = r.normal(size=(len(self.mean), width)) * math.sqrt(2 * gamma)
        self.b = r.uniform(0, 2 * math.pi, width)
        self.beta: np.ndarray | None = None
        self.at, self.value = np.array([0.0]), np.array([0.5])

    def features(self, stats) -> np.ndarray:
        x = np.clip((np.asarray(stats, float).reshape(-1, len(self.mean)) - self.mean) / self.spread, -5, 5)
        return np.hstack([np.cos(x @ self.w + self.b) * math.sqrt(2 / len(self.b)), np.ones((len(x), 1))])

    def raw(self, stats) -> np.ndarray:
        return self.features(stats) @ self.beta

    def score(self, stats) -> np.ndarray:
        if self.beta is None:
            return np.full(len(stats), self.value[0])
        return np.interp(self.raw(stats), self.at, self.value)


def pooled(at, ones, total) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression: pool neighbouring grid points until the shares rise."""
    blocks: list[list[float]] = []
    for x, y, n in zip(at, ones, total):
        blocks.append([x, x, y, n])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, hi, y1, n1 = blocks.pop()
            blocks[-1][1:] = [hi, blocks[-1][2] + y1, blocks[-1][3] + n1]
    xs = [v for lo, hi, _, _ in blocks for v in (lo, hi)]
    ys = [(y + 0.5) / (n + 1) if len(blocks) == 1 else y / n for _, _, y, n in blocks for _ in (0, 1)]
    return np.array(xs), np.array(ys)


def fit(rows: DataFrame, width: int = 256, ridge: float = 1e-3, gamma: float = 1 / 32, seed: int = 17) -> FourierRidge:
    """``rows``: stats, label (0/1), calibrate (boolean). Rows marked ``calibrate`` shape the calibration, the others the fit."""
    learn = rows.where(~F.col("calibrate"))
    moments = learn.select(array_to_vector("stats").alias("v"), "label").groupBy(F.lit("all")).agg(
        Summarizer.mean(F.col("v")).alias("mean"), Summarizer.std(F.col("v")).alias("std"), F.count("*").alias("n"), F.sum("label").alias("ones")).first()  # None without rows
    if moments is None or moments["ones"] in (0, moments["n"]):
        model = FourierRidge(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)), 1, seed, gamma)
        model.value = np.array([moments["ones"] / moments["n"] if moments else 0.5])
        return model
    n = moments["n"]
    spread = np.asarray(moments["std"].toArray())
    model = FourierRidge(moments["mean"].toArray(), np.where(spread > 1e-9, spread, 1.0), width, seed, gamma)
    side = width + 1

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((side, side + 1))
        for batch in batches:
            z = model.features(np.array(batch.column("stats").to_pylist(), dtype=float))
            total[:, :side] += z.T @ z
            total[:, side] += z.T @ np.array(batch.column("label").to_pylist(), dtype=float)
        yield pa.RecordBatch.from_arrays([pa.array(range(side), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["at", "line"])

    lines = learn.select("stats", "label").mapInArrow(parts, "at int, line array<double>")
    sums = lines.groupBy("at").agg(vector_to_array(Summarizer.sum(array_to_vector("line"))).alias("line")).collect()  # width + 1 rows
    system = np.zeros((side, side + 1))
    for r in sums:
        system[r["at"]] = r["line"]
    penalty = np.full(side, ridge * n)
    penalty[-1] = 0.0
    model.beta = np.linalg.solve(system[:, :side] + np.diag(penalty), system[:, side])

    def grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = model.raw(np.array(batch.column("stats").to_pylist(), dtype=float))
                bins = np.clip(np.rint((raw + 1) / 3 * GRID), 0, GRID).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column("label").cast(pa.int64())], ["bin", "label"])

    counts = rows.where("calibrate").select("stats", "label").mapInArrow(grid, "bin int, label bigint").groupBy("bin").agg(F.sum("label").alias("ones"), F.count("*").alias("n")).orderBy("bin").collect()
    if counts:
        model.at, model.value = pooled([c["bin"] / GRID * 3 - 1 for c in counts], [c["ones"] for c in counts], [c["n"] for c in counts])
    else:
        model.at, model.value = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score(stats: DataFrame, model: FourierRidge) -> DataFrame:
    """doc_id, score of rows (doc_id, stats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(np.array(batch.column("stats").to_pylist(), dtype=float)))], ["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(lean(run), f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def learned(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, FourierRidge]:
    """Statistics of all ``docs``, and the model: folds 2 to 4 fit the ridge, fold 1 the calibration; labels of fold 0 are never read."""
    stats = stored(text_statistics(docs), "quality-statistics")
    known = labels.where("quality in (0, 1)").select(F.col("doc_id"), F.col("quality").cast("int").alias("label")).where(fold(F.col("doc_id")) != 0)
    return stats, fit(stats.join(known, "doc_id").select("stats", "label", (fold(F.col("doc_id")) == 1).alias("calibrate")))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out (fold 0), score, predicted of every document; labels are (doc_id, quality)."""
    stats, model = learned(docs, labels)
    return score(stats, model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns; no shuffle of texts."""
    _, model = learned(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch.column("text")):
                good = model.score(np.array([statistics(t or "") for t in texts])) >= threshold
                yield batch.slice(start, len(texts)).filter(pa.array(good))

    return docs.mapInArrow(lean(run), docs.schema)
