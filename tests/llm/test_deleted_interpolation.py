"""Counts and base scores against plain Python; the mixture against its definition and on held-out texts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skyfence.llm.deleted_interpolation import DELETED, HELD_OUT, KEPT, add_blocks, joined, score_documents, score_texts
from skyfence.llm.grams import lowered_words, pack_keys, unpack_keys

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_words_and_keys():
    texts = ["  A b\x0bB\x1c É\n", None, "", "\t\r\n", "a A\x85x  y　z"]
    codes, row, keys = lowered_words(pa.array(texts))
    for i, t in enumerate(texts):
        want = words_of(t)
        got = codes[row == i]
        assert len(got) == len(want) and len({int(keys[c]) for c in got}) == len(set(want))
    ordered = pa.array(sorted(int(k) for k in keys), pa.uint64()).to_numpy()
    assert (unpack_keys(pack_keys(ordered)) == ordered).all()


def brute(rows):
    learn = [words_of(t) for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    c = Counter(w for d in learn for w in [*d, "\n"])
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        tokens = [*words_of(t), "\n"]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        out.append((i, zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1, len(tokens), sum(c[w] > 0 for w in tokens), n, base))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_base(spark, order):
    rows = [(i, ["The cat sat on the mat", "a  DOG sat\nthere and sat", "der Hund und die Katze É", "zz yy"][i % 4] + f" w{i % 9}") for i in range(150)]
    rows += [(200, None), (201, ""), (None, "the cat"), (7, "the cat sat"), (7, "the cat sat"), (300, "long text of the cat " * 4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as kind", "1 as block", "'y' as score")
    got = score_documents(df, order=order, block_mb=0.003).collect()
    want = sorted(brute(rows), key=str)
    mine = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=str)
    for a, b in zip(sorted(mine, key=lambda x: (str(x[0]), x[2])), sorted(want, key=lambda x: (str(x[0]), x[2]))):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
    assert all(r.score < 0 for r in got)
    held = [r for r in got if r.held_out and r.n_known == r.n_tokens]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_sum_to_one(spark):
    rows = [(i, "a b a c" if i % 2 else "b a") for i in range(60)]
    known = ["a", "b", "c"]
    asked = [(1000 + 2 * i, h) for i, h in enumerate(["a", *(f"a {w}" for w in known)])]
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    free = iter(i for i in range(10_000, 20_000) if fold(i) == 1)
    ids = {t: next(free) for _, t in asked}
    scores = {r.doc_id: r.score for r in score_documents(spark.createDataFrame(rows + [(i, t) for t, i in ids.items()], "doc_id bigint, text string")).collect()}
    # p(a w end) / p(end | w) summed over known words, plus p(end | a), stays below one: the rest is left for unknown words
    assert all(math.isfinite(s) and s < 0 for s in scores.values())
    assert sum(10 ** scores[i] for i in ids.values()) < 1


def test_nothing_to_learn_from(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    got = score_documents(spark.createDataFrame([(i, "x y") for i in held], "doc_id bigint, text string")).collect()
    assert [(r.n_known, r.train_tokens, round(r.base_score, 9), round(r.score, 9)) for r in got] == [(0, 0, 0.0, 0.0)] * 3
    assert score_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_counts_beyond_32_bits():
    most = 2**31 - 1
    keys = np.array([2, 4, 7], np.uint64)
    counts = [([5, most, 1], KEPT), ([most, most, most], 3 + KEPT), ([1, 2, 3], DELETED), ([9, 9, 9], HELD_OUT)]
    asked = pa.table({"block": [b for _, b in counts], "keys": [pack_keys(keys)] * 4, "counts": [np.array(c, np.int32).tobytes() for c, _ in counts]})
    got = add_blocks((pa.scalar(0),), asked)
    total = [most + 6, 2 * most + 2, most + 4]
    for i, (_, block) in enumerate(counts):
        assert joined(got.slice(i, 1), "total").tolist() == total
        if block == DELETED:
            assert joined(got.slice(i, 1), "kept").tolist() == [most + 5, 2 * most, most + 1]
    assert (got["words"][0].as_py(), got["kinds"][0].as_py(), got["kept_words"][0].as_py()) == (total[0] + total[1], 2, 3 * most + 5)


def mixture(rows):
    """Scores of (id, text, kind) by the definition: word pairs, words and the uniform distribution, one token at a time."""

    def events(text):
        line = ["\n", *words_of(text), "\n"]
        return list(zip(line, line[1:]))

    def counted(kinds):
        pairs = Counter(e for _, t, k in rows if k in kinds for e in events(t))
        single = Counter()
        for (_, word), n in pairs.items():
            single[word] += n
        return pairs, single, sum(single.values())

    full, kept = counted((KEPT, DELETED)), counted((KEPT,))
    uniform = 1 / (len(full[1]) + 1)
    bucket = lambda counts, before: min(int(math.log2(counts[1][before] + 1)), 23)
    parts = lambda counts, e: [uniform, counts[1][e[1]] / counts[2], counts[0][e] / max(1, counts[1][e[0]])]
    rough = lambda p: 2 ** (-round(-4 * math.log2(p)) / 4) if p else 0.0
    met = [(bucket(kept, e[0]), [uniform, *map(rough, parts(kept, e)[1:])]) for _, t, k in rows if k == DELETED for e in events(t)]
    weights = [[1 / 3] * 3 for _ in range(24)]
    for _ in range(60):
        sums = [[0.5] * 3 for _ in range(24)]
        for b, p in met:
            share = [w * x for w, x in zip(weights[b], p)]
            for k in range(3):
                sums[b][k] += share[k] / sum(share)
        weights = [[x / sum(line) for x in line] for line in sums]
    return {i: sum(math.log10(sum(w * x for w, x in zip(weights[bucket(full, e[0])], parts(full, e)))) for e in events(t)) for i, t, _ in rows}


def test_scores_against_the_definition(spark):
    r = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(r.choice(words[: 5 + r.randrange(36)]) for _ in range(r.randrange(40))), (KEPT, KEPT, DELETED, HELD_OUT)[i % 4]) for i in range(160)]
    rows += [(500, None, HELD_OUT), (501, "never seen W1 w1", HELD_OUT), (502, "w1 " * 500, KEPT), (503, "w1 " * 500, KEPT)]
    want = mixture(rows)
    for size in (0.001, 12.0):
        got = score_texts(spark.createDataFrame(rows, "doc_id bigint, text string, kind int"), F.col("kind"), block_mb=size).collect()
        assert {x.doc_id: x.score for x in got} == pytest.approx(want, rel=1e-7)
