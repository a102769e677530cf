"""Spelling variants against comparing all words, and node numbers against a plain trie."""

import random
import re
import zlib
from collections import Counter

import pytest

from skyfence.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, damaged, shortest, least):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % damaged == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= shortest and c >= least}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(n):
    out, form = {}, {}
    for w in n:
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = len(others)
    rows = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n[w], out[w], n[form[w]] if form[w] else None))
    return sorted(rows)


def got(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


@pytest.mark.parametrize("seed,part", [(1, 50_000), (2, 7), (3, 40)])
def test_against_all_pairs(spark, seed, part):
    r = random.Random(seed)
    words = ["".join(r.choice("aabÀé÷") for _ in range(r.randint(1, 7))) for _ in range(250)]
    rows = [(r.choice([None, 1, 2, 77, 10**15]), r.choice([None, "", "12 ; ", *["".join(r.choice(words).upper() if r.random() < 0.1 else r.choice(words) + r.choice([" ", "\n", "1", "Ā", "日", "-"]) for _ in range(r.randint(1, 120)))] * 9])) for _ in range(60)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as word", "1 as n", "2 as place")
    want = counted(rows, 5, 3, 2)
    assert len(want) > 100 and got(spelling.spelling_groups(df, damaged=5, shortest=3, least=2, part=part)) == brute(want)


def test_ties_chains_and_long_words(spark):
    long = "é" * 3000
    n = {"aaaaa": 1, "aaaab": 2, "aaabb": 4, "aabbb": 8, "abbbb": 16, "bbbbb": 32, "aaaaaa": 2, "ccccc": 5, "ccccd": 5, "cccce": 5, long: 3, long[1:]: 9, "x" + long: 1}
    df = spark.createDataFrame(list(n.items()), "word string, n bigint")
    for part in (1, 4, 100):
        assert got(spelling.grouped_words(df, part)) == brute(n)


def test_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "1234 ...")], "doc_id bigint, text string")
    assert spelling.spelling_groups(df).count() == 0
    assert spelling.spelling_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_numbers_of_parts_agree(seed):
    r = random.Random(seed)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(1, 9))) for _ in range(60)})
    cuts = sorted(r.sample(range(1, len(words)), r.randint(0, min(12, len(words) - 1))))
    parts = [words[a:b] for a, b in zip([0, *cuts], [*cuts, len(words)])]
    known = spelling.borders([(3 * i, p[0], p[-1]) for i, p in enumerate(parts)])
    numbers = {}
    for i, p in enumerate(parts):
        nodes = spelling.Nodes(3 * i, *known[3 * i])
        for w in p:
            for k, number in enumerate(list(nodes.of(w))):
                assert numbers.setdefault(w[:k], number) == number
    assert len(set(numbers.values())) == len(numbers)
