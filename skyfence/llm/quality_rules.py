"""Quality verdicts: counted rules, then a hashed n-gram logistic regression against a fixed threshold.

Word 1-2-grams and character 1-3-grams are hashed into a fixed number of weights; a text's value is the mean weight of its
n-grams. The model is fitted on a bounded sample of labelled rows (``per_class`` of each label, those with the smallest hash of
the id) in one task, Platt-calibrated on rows of that sample that the fit did not see, and scored in Arrow batches without
any shuffle. Sampled rows weigh as many labelled rows as they stand for, in the fit and in the calibration, so that a
probability and the threshold mean the same whatever the size of the table.

Rows: a text of null or without words has no words, fails the base rule and has probability 0. Repeated rows give repeated
results. Without both labels in the sample there is no verdict: whatever passes the base rule is kept. Extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfence.llm.common import lean, slices

#: Weights for character n-grams, and as many for word n-grams.
BUCKETS = 1 << 16
MIX = np.uint32(0x9E3779B1)
SYMBOL = re.compile(r"[#*$%&|<>]")


def codes_of(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Each word's number within its text, and the words by number."""
    kinds = list(dict.fromkeys(words))
    number = dict(zip(kinds, range(len(kinds))))
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words)), kinds


def windows(codes: np.ndarray, kinds: int) -> np.ndarray:
    """A number for each 3-word window, equal for equal windows."""
    pair = codes[:-2] * kinds + codes[1:-1]
    if kinds >= 1 << 20:  # keep the product within 64 bits
        pair = np.unique(pair, return_inverse=True)[1]
    return pair * kinds + codes[2:]


def repeated_words(codes: np.ndarray, kinds: int) -> int:
    """Words inside 3-word windows that are found at least twice."""
    if len(codes) < 4:
        return 0
    key = windows(codes, kinds)
    _, where, times = np.unique(key, return_inverse=True, return_counts=True)
    twice = times[where] > 1
    inside = np.zeros(len(codes), bool)
    for k in range(3):
        inside[k : k + len(twice)] |= twice
    return int(inside.sum())


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def hashed(text: str, codes: np.ndarray, kinds: list[bytes]) -> np.ndarray:
    """Weight numbers of all n-grams of a text: characters in the lower half, words in the upper."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = np.fromiter(map(zlib.crc32, kinds), np.uint32, len(kinds))[codes]
    two = c[:-1] * np.uint32(31) + c[1:] + np.uint32(0x51ED27)
    three = two[:-1] * np.uint32(131) + c[2:]
    grams = np.concatenate([c, two, three])
    words = np.concatenate([h, h[:-1] * np.uint32(31) + h[1:]])
    low, high = (grams * MIX) >> np.uint32(16), (words * MIX) >> np.uint32(16)
    return np.concatenate([low.astype(np.int32), high.astype(np.int32) + BUCKETS])


class NgramModel:
    def __init__(self, weights: np.ndarray, slope: float, shift: float):
        self.weights, self.slope, self.shift = weights, slope, shift

    def probability(self, grams: np.ndarray) -> float:
        value = float(self.weights[grams].mean(dtype=np.float64)) if len(grams) else 0.0
        return float(1 / (1 + np.exp(-np.clip(self.slope * value + self.shift, -40, 40))))


def train(grams: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, unseen: np.ndarray, steps: int = 120, rate: float = 2.0, decay: float = 1e-5, weight: np.ndarray | None = None) -> NgramModel:
    """Full-batch logistic regression by Adam steps on (distinct n-grams, shares) of each row; then two parameters of calibration on the ``unseen`` rows. ``weight``: rows that each row stands for."""
    weight = np.ones(len(grams)) if weight is None else weight
    learn = [i for i in range(len(grams)) if not unseen[i]]
    row = np.concatenate([np.full(len(grams[i][0]), k, np.int32) for k, i in enumerate(learn)])
    col = np.concatenate([grams[i][0] for i in learn])
    value = np.concatenate([grams[i][1] for i in learn])
    y, share = label[learn].astype(float), weight[learn] / weight[learn].sum()
    w, m, v, b = np.zeros(2 * BUCKETS), np.zeros(2 * BUCKETS), np.zeros(2 * BUCKETS), 0.0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=w[col] * value, minlength=len(learn)) + b, -40, 40)))
        g = np.bincount(col, weights=((p - y) * share)[row] * value, minlength=2 * BUCKETS) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        b -= 0.5 * ((p - y) * share).sum()
    model = NgramModel(w.astype(np.float32), 1.0, b)
    held = [i for i in range(len(grams)) if unseen[i]]
    if len(set(label[held].tolist())) == 2:
        x, z = np.array([float(model.weights[grams[i][0]] @ grams[i][1]) for i in held]), label[held].astype(float)
        z = np.where(z > 0, (z.sum() + 1) / (z.sum() + 2), 1 / (len(z) - z.sum() + 2))
        share = weight[held] / weight[held].sum()
        centre = share @ x
        scale = np.sqrt(share @ (x - centre) ** 2) or 1.0
        a, s = 1.0, 0.0
        u = (x - centre) / scale
        for _ in range(300):
            d = 1 / (1 + np.exp(-np.clip(a * u + s, -40, 40))) - z
            a, s = a - 0.5 * (share @ (d * u) + 1e-4 * a), s - 0.5 * (share @ d)
        model.slope, model.shift = a / scale, s - a * centre / scale
    return model


def fit_on_sample(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> NgramModel | None:
    """At most ``per_class`` labelled documents of each label; one task turns their whole texts into a model of fixed size.

    A sampled row weighs (labelled rows of its label) / (those of them in the sample), counted over all of ``labels``.
    """
    at = F.xxhash64(F.lit("rules"), "doc_id")
    known = labels.where("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("label")).dropDuplicates(["doc_id"])
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    weight = {k: max(1.0, counts.get(k, 0) / per_class) for k in (0, 1)}
    chosen = [known.where(F.col("label") == k).orderBy(at, "doc_id").limit(per_class).withColumn("weight", F.lit(weight[k])) for k in (0, 1)]
    sample = chosen[0].unionByName(chosen[1]).withColumn("unseen", F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(4)) == 0)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")  # 2 x per_class rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, label, unseen, weights = [], [], [], []
        for batch in batches:
            for start, texts in slices(batch.column("text")):
                for text in texts:
                    codes, kinds = codes_of((text or "").encode("utf-8", "surrogatepass").split())
                    kept, count = np.unique(hashed(text or "", codes, kinds), return_counts=True)
                    grams.append((kept.astype(np.int32), (count / max(1, count.sum())).astype(np.float32)))
            label += batch.column("label").to_pylist()
            unseen += batch.column("unseen").to_pylist()
            weights += batch.column("weight").to_pylist()
        if len(set(label)) == 2 and len({y for y, u in zip(label, unseen) if not u}) == 2:
            model = train(grams, np.array(label), np.array(unseen), weight=np.array(weights))
            yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()]), pa.array([model.slope]), pa.array([model.shift])], ["weights", "slope", "shift"])

    got = rows.repartition(1).sortWithinPartitions("doc_id").mapInArrow(lean(run), "weights binary, slope double, shift double").collect()
    return NgramModel(np.frombuffer(bytes(got[0]["weights"]), np.float32), got[0]["slope"], got[0]["shift"]) if got else None


def verdict(text: str, model: NgramModel | None, threshold: float, least_words: int, most_repeated: int) -> tuple:
    words = text.encode("utf-8", "surrogatepass").split()
    codes, kinds = codes_of(words)
    n, again = len(words), repeated_words(codes, len(kinds))
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    failed = n < least_words or 100 * again > most_repeated * n
    p = None if model is None else model.probability(hashed(text, codes, kinds)) if n else 0.0
    return n, chars, len(SYMBOL.findall(text)), repeated_lines(text), again, failed, p, not failed and (p is None or p >= threshold)


def judge(docs: DataFrame, model: NgramModel | None, threshold: float = 0.5, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """doc_id, the counts, base_failed, probability (null without a model), kept."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 x BUCKETS weights
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"]
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch.column("text")):
                rows = [verdict(t or "", sent.value, threshold, least_words, most_repeated) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(texts)), *map(pa.array, zip(*rows), kinds)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        lean(run), f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, probability double, kept boolean")


def kept_documents(docs: DataFrame, model: NgramModel | None, threshold: float = 0.5, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, in the same pass."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch.column("text")):
                good = [verdict(t or "", sent.value, threshold, least_words, most_repeated)[-1] for t in texts]
                yield batch.slice(start, len(texts)).filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
