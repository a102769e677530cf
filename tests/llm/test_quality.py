"""Classifier and rules: counts against brute force, verdicts on held-out labels, and odd rows."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from skyfence.llm.quality_model import STATISTICS, classify, pooled, statistics
from skyfence.llm.quality_rules import BUCKETS, MIX, fit_on_sample, judge

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("aeiou") + r.choice("lmnrst") for _ in range(r.randint(1, 4)))
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        words = [word() for _ in range(r.randint(55, 160))]
        rows.append((i, " ".join(w.upper() + "!!" if bad else w for w in words)))
        if i % 3:
            labels.append((i, int(not bad), 0))
    rows += [(1000, None), (1001, ""), (1002, "\n\t "), (None, "la la"), (3, rows[3][1]), (1003, "word " * 30_000), (1004, "É﻿ #|<>& ñ")]
    labels += [(2000, 1, 0), (1001, None, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as stats", "1 as label", "2 as score"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), rows


def test_statistics():
    assert statistics("") == statistics(" \n") == [0.0] * len(STATISTICS)
    assert len(statistics("A b\nc")) == len(STATISTICS) and np.isfinite(statistics("\x00|" * 5000)).all()


def test_pooled_rises():
    x, y = pooled([0, 1, 2, 3, 4], [1, 0, 3, 2, 5], [2, 4, 4, 4, 5])
    assert (np.diff(y) >= 0).all() and (np.diff(x) >= 0).all() and y[0] == 1 / 6 and y[-1] == 1


def test_classifier(labelled):
    docs, labels, rows = labelled
    got = classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in got)
    judged = [r for r in got if r.doc_id is not None and r.doc_id < 600]
    assert np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in judged]) > 0.98


def test_classifier_never_reads_the_held_out_labels(spark, labelled):
    docs, labels, _ = labelled
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality")
    a, b = ({r.doc_id: r.score for r in classify(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_scores_against_a_plain_solution(spark):
    """Ridge by least squares over stacked rows, calibration by the min-max form of isotonic regression."""
    r = random.Random(8)
    rows = [(i, " ".join("".join(r.choice("aeiou lmnrst|A7") for _ in range(r.randint(1, 9))) for _ in range(r.randint(0, 60)))) for i in range(400)]
    labels = [(i, int((len(t) > 150) != (r.random() < 0.25))) for i, t in rows] + [(7, 1), (8, 5), (9, None), (9999, 1)]
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    stats = {i: np.float32(statistics(t)).astype(float) for i, t in rows}
    known = [(i, y) for i, y in labels if y in (0, 1) and i in stats]
    x = np.array([stats[i] for i, _ in known if fold(i) > 1])
    y = np.array([y for i, y in known if fold(i) > 1], float)
    mean, spread = x.mean(0), x.std(0, ddof=1)
    spread[spread <= 1e-9] = 1
    seed = np.random.default_rng(17)
    w, b = seed.normal(size=(x.shape[1], 256)) * math.sqrt(2 / 32), seed.uniform(0, 2 * math.pi, 256)
    map_ = lambda v: np.append(np.cos(np.clip((v - mean) / spread, -5, 5) @ w + b) * math.sqrt(2 / 256), 1.0)
    z = np.array([map_(v) for v in x])
    damp = np.sqrt(1e-3 * len(x)) * np.eye(257)[:256]
    beta = np.linalg.lstsq(np.vstack([z, damp]), np.append(y, np.zeros(256)), rcond=None)[0]
    raw = {i: float(map_(v) @ beta) for i, v in stats.items()}
    cells = {}
    for i, label in known:
        if fold(i) == 1:
            at = min(600, max(0, round((raw[i] + 1) / 3 * 600)))
            n = cells.setdefault(at, [0, 0])
            n[0], n[1] = n[0] + label, n[1] + 1
    bins = sorted(cells)
    share = lambda j, k: sum(cells[c][0] for c in bins[j : k + 1]) / sum(cells[c][1] for c in bins[j : k + 1])
    value = [max(min(share(j, k) for k in range(i, len(bins))) for j in range(i + 1)) for i in range(len(bins))]
    got = classify(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()
    want = {i: np.interp(v, [c / 600 * 3 - 1 for c in bins], value) for i, v in raw.items()}
    assert len(set(value)) > 2 and {g.doc_id: g.score for g in got} == pytest.approx(want, abs=1e-6)


def test_without_labels(labelled):
    docs, labels, rows = labelled
    assert {r.score for r in classify(docs, labels.limit(0)).collect()} == {0.5}
    assert classify(docs.limit(0), labels).count() == 0
    assert fit_on_sample(docs, labels.limit(0)) is None and fit_on_sample(docs, labels.where("quality = 1")) is None
    assert all(r.kept == (not r.base_failed) and r.probability is None for r in judge(docs, None).collect())


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    again = {i + k for p in at.values() if len(p) > 1 for i in p for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(again), n < 50 or 100 * len(again) > 50 * n


def test_rules(spark, labelled):
    docs, labels, rows = labelled
    r = random.Random(9)
    more = [(3000 + i, "".join(r.choice(["a ", "b ", "c ", "a b c ", "\n", "x\n", " ", "é# ", "\t"]) for _ in range(r.randint(0, 90)))) for i in range(150)]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    got = judge(docs, fit_on_sample(docs, labels)).collect()
    texts = {}
    for i, t in rows + more:
        texts[i] = t
    assert len(got) == len(rows) + len(more)
    for x in got:
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == brute(texts[x.doc_id]), x
        assert x.kept == (not x.base_failed and x.probability >= 0.5)
    judged = [x for x in got if x.doc_id is not None and x.doc_id < 600 and not x.base_failed]
    assert np.mean([x.kept == (x.doc_id % 4 != 0) for x in judged]) > 0.98


def test_sample_keeps_the_balance_of_labels(spark):
    """Texts that say nothing about their label have the share of good labels as probability, whatever ``per_class`` is."""
    r = random.Random(11)
    rows = [(i, " ".join(r.choice(["lo", "mi", "ra", "tu", "se"]) for _ in range(80))) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 8 != 0)) for i in range(800)], "doc_id bigint, quality int")
    for per_class in (60, 1500):
        p = [x.probability for x in judge(docs, fit_on_sample(docs, labels, per_class)).collect()]
        assert abs(np.mean(p) - 7 / 8) < 0.08, (per_class, np.mean(p))


def test_probability_against_plain_sums(spark, labelled):
    docs, labels, rows = labelled
    model = fit_on_sample(docs, labels)
    word = 2**32

    def plain(text):
        text = text or ""
        c, words = list(map(ord, text)), [zlib.crc32(w) for w in text.encode().split()]
        two = [(a * 31 + b + 0x51ED27) % word for a, b in zip(c, c[1:])]
        chars = c + two + [(t * 131 + b) % word for t, b in zip(two, c[2:])]
        grams = [(g * int(MIX) % word >> 16) for g in chars] + [(g * int(MIX) % word >> 16) + BUCKETS for g in words + [(a * 31 + b) % word for a, b in zip(words, words[1:])]]
        value = sum(float(model.weights[g]) for g in grams) / len(grams) if words else None
        return 0.0 if value is None else 1 / (1 + math.exp(-min(40, max(-40, model.slope * value + model.shift))))

    want = {}
    for i, t in rows:
        want[i] = plain(t)
    got = judge(docs, model).collect()
    assert {x.doc_id: x.probability for x in got} == pytest.approx(want, rel=1e-6, abs=1e-9)
