"""Collocations against a plain count of everything, and double arrays against plain dictionaries."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from skyfence.llm import collocations as C
from skyfence.llm.word_tries import DoubleArray

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top, absorbed=80):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    cand = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, g), a in cand.items():
        score, k = min((2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k) for k in range(1, len(g)))
        longer = [b for (other, h), b in cand.items() if other == lang and len(h) > len(g) and any(h[i:i + len(g)] == g for i in range(len(h)))]
        if not any(100 * b >= absorbed * a for b in longer):
            out.append((lang, -score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    rows, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            rows.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(rows)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "'x' as phrase", "1 as rank", "2 as key", "'y' as word")
    return sorted(map(tuple, C.collocations(df, **kw).collect()))


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    vocabulary = ["a", "B", "b", "the", "The", "ÄB", "äb", "日本", "x y", "c\x1cd", "\x00"]
    rows = []
    for _ in range(120):
        parts = (r.choice(vocabulary) + r.choice([" ", " ", " ", "\t ", ", ", ". ", "\n", "\r\n", "\x0b", "!"]) for _ in range(r.randint(0, 60)))
        rows.append((r.choice([None, "", "".join(parts), "".join(parts)]), r.choice([None, "und", "en", "de", "odd\nname"])))
    rows += [("the b the b the b " * 500, "en")] * 2
    assert run(spark, rows, least=4, top=15) == brute(rows, 4, 15)


def test_small_shards_and_rounds(spark, monkeypatch):
    r = random.Random(7)
    rows = [(" ".join(r.choice("abcdefgh") for _ in range(200)), r.choice(["en", "fr"])) for _ in range(20)]
    monkeypatch.setattr(C, "SHARD", 40)
    monkeypatch.setattr(C, "ROUND_BYTES", 9000)
    assert run(spark, rows, least=5, top=400) == brute(rows, 5, 400)


def test_nothing(spark):
    assert run(spark, [(None, None), ("", "en"), ("only once here", "en")]) == []
    df = spark.createDataFrame([], "text string, lang string")
    assert C.collocations(df).count() == 0


def test_ties_by_bytes(spark):
    rows = [("zé q. \U0001F600 q. ￮ q. a q.", "en")] * 3
    got = run(spark, rows, least=3)
    assert [x[2] for x in got] == sorted((x[2] for x in got), key=str.encode) and got == brute(rows, 3, 2000)


@pytest.mark.parametrize("seed", range(8))
def test_double_array(seed):
    r = random.Random(seed)
    vocabulary = [b"w%d" % i for i in range(r.randint(1, 60))]
    phrases = [list(p) for p in {tuple(r.choice(vocabulary) for _ in range(r.randint(1, 4))) for _ in range(r.randint(0, 500))}]
    trie = DoubleArray.of(phrases)
    slots, trie = trie.slots, DoubleArray.unpack(trie.pack())
    words = [*vocabulary, b"other"]
    codes, pieces = np.array([r.randrange(len(words)) for _ in range(3000)]), np.cumsum([r.random() < 0.1 for _ in range(3000)])
    want = Counter(tuple(words[c] for c in codes[i:i + k]) for k in range(1, 5) for i in range(3001 - k) if pieces[i + k - 1] == pieces[i])
    got = trie.counts(pa.array(words, pa.large_binary()), codes, pieces)
    assert [want[tuple(p)] for p in phrases] == got[slots].tolist()


def test_sequences_that_share_a_key():
    key, words = np.array([5, 5, 5, 7, 7], np.uint64), [np.array([1, 1, 2, 3, 3]), np.array([4, 4, 4, 4, 4])]
    assert sorted(zip(*(w[C.one_of_each(key, words)].tolist() for w in words))) == [(1, 4), (2, 4), (3, 4)]
    assert sorted(C.one_of_each(key, [np.array([1, 1, 1, 3, 3])]).tolist()) == [0, 3]


def test_walks_from_given_places():
    trie = DoubleArray.of([[b"a", b"b"], [b"a", b"b", b"c"], [b"b", b"c"]])
    words, codes, pieces = pa.array([b"a", b"b", b"c", b"d"], pa.large_binary()), np.array([0, 1, 2, 1, 2, 3, 0, 1]), np.array([0, 0, 0, 1, 1, 2, 3, 3])
    got = trie.counts(words, codes, pieces, np.array([0, 3, 5, 6]), np.array([5, 7, 9, 11]))
    assert got[trie.slots].tolist() == [16, 5, 7]


def test_texts_are_read_as_often_for_many_tries(spark, monkeypatch):
    """However many tries there are: three passes over the texts for words, keys and candidates, and one that counts."""
    r = random.Random(8)
    rows = [(" ".join(r.choice("abcdefgh") for _ in range(200)), r.choice(["en", "fr"])) for _ in range(20)]
    monkeypatch.setattr(C, "SHARD", 20)
    monkeypatch.setattr(C, "ROUND_BYTES", 2000)
    read = spark.sparkContext.accumulator(0)

    def noted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(rows, "text string, lang string").mapInArrow(noted, "text string, lang string")
    monkeypatch.setattr(C, "stored", lambda df, name: df.localCheckpoint())
    got = C.phrase_counts(df, 5).localCheckpoint()
    assert got.count() > 100 and read.value == 4 * len(rows)
