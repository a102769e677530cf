"""Groups against comparing all pairs."""

import math
import random
import re

import numpy as np
import pytest

from skyfence.llm import jaccard_join, links
from skyfence.llm.jaccard_join import FEW, Sketches, jaccard_groups, may_reach, meetings, one_of_each, part_sums, sketch_links, sketches, tree_links

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(rows, size):
    out = []
    for _, t in rows:
        w = [x.lower() for x in WORD.findall(t or "")]
        out.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    return out


def brute(rows, size=3, per_cent=90):
    sets, root = sets_of(rows, size), {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, _) in enumerate(rows):
        for y, (j, _) in enumerate(rows[:x]):
            if sets[x] and sets[y] and i is not None and j is not None and 100 * len(sets[x] & sets[y]) >= per_cent * len(sets[x] | sets[y]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted(((i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets)), key=str)


def corpus(seed, n=220):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghijklmnop") + r.choice("xyzuvw") + r.choice("123456")
    passage = [word() for _ in range(40)]
    rows, base = [], [[word() for _ in range(r.randint(1, 90))] for _ in range(25)]
    for i in range(n):
        t = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            k = r.randrange(len(t) + 1)
            t[k : k + r.randint(0, 1)] = [word()] * r.randint(0, 1)
        if r.random() < 0.2:
            t += passage
        rows.append((i * 3 + 1, " ".join(x.upper() if r.random() < 0.1 else x for x in t)))
    chain = [word() for _ in range(60)]
    for i in range(30):  # each near the one before, the ends far apart
        chain[i * 2] = word()
        rows.append((5000 - i, " ".join(chain)))
    return rows + [(2, None), (3, ""), (5, " \t\n"), (6, "solo"), (8, "SOLO"), (9, "two words"), (11, "two words"), (None, "two words"), (12, "a b c " * 500), (14, "a b c " * 700)]


@pytest.mark.parametrize("seed,block", [(1, 2000), (2, 7)])
def test_groups(spark, seed, block):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as n", "'x' as low", "2 as rep", "3 as root")
    got = sorted((tuple(r) for r in jaccard_groups(df, block=block).collect()), key=str)
    assert got == brute(rows)
    if block == 2000:
        one = one_of_each(df)
        assert one.columns == df.columns
        assert sorted(r.doc_id for r in one.where("doc_id is not null").collect()) == sorted({g for _, _, g in got if g is not None})


def test_other_threshold_and_repeats(spark):
    rows = corpus(5, 80)
    df = spark.createDataFrame(rows + rows[:20], "doc_id bigint, text string")
    got = sorted({tuple(r) for r in jaccard_groups(df, size=2, per_cent=70).collect()}, key=str)
    assert got == sorted(set(brute(rows, 2, 70)), key=str)


def test_empty(spark):
    assert jaccard_groups(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_tree(seed):
    r = random.Random(seed)
    base = [set(r.sample(range(400), r.randint(1, 60))) for _ in range(8)]
    sets = []
    for _ in range(150):
        s = set(r.choice(base))
        for _ in range(r.randint(0, 5)):
            s ^= {r.randrange(400)}
        sets.append(np.array(sorted(s or {1})))
    for per_cent in (60, 80, 90):
        def groups(links):
            root = list(range(len(sets)))

            def find(i):
                while root[i] != i:
                    i = root[i]
                return i

            for a, b in links:
                root[find(a)] = find(b)
            best = {}
            for i in range(len(sets)):
                best.setdefault(find(i), i)
            return [best[find(i)] for i in range(len(sets))]

        every = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(set(sets[i]) & set(sets[j])) >= per_cent * len(set(sets[i]) | set(sets[j]))]
        assert groups(tree_links(sets, per_cent)) == groups(every)


def test_one_id_with_two_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, "x"), (1, b, "x"), (2, a, "y"), (3, b + " more", "z"), (3, c, "z"), (3, c, "z"), (4, c + " more", "z"), (5, "", "e"), (5, "", "e"), (5, None, "e"), (6, "", "e"), (None, a, "n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, `a.b` string").selectExpr("*", "1 as text_hash", "2 as _id", "3 as root", "4 as `c d`")
    got = one_of_each(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, a), (1, b), (3, c), (5, ""), (6, ""), (None, a)], key=str)
    groups = sorted({(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups(df).collect()}, key=str)
    assert groups == sorted([(1, 58, 1), (2, 58, 1), (3, 59, 1), (3, 58, 3), (4, 59, 3), (5, 0, 5), (6, 0, 6), (None, 58, None)], key=str)


def test_text_ids(spark):
    df = spark.createDataFrame([("b", "one two three four"), ("a", "One two three four"), ("c", "x y z")], "doc_id string, text string")
    assert sorted(tuple(r) for r in jaccard_groups(df).collect()) == [("a", 2, "a"), ("b", 2, "a"), ("c", 1, "c")]


@pytest.mark.parametrize("parts", [1, 7])
def test_components_end_with_stars(spark, monkeypatch, parts):
    kept = []
    monkeypatch.setattr(links, "stored", lambda df, name: kept.append(df.localCheckpoint()) or kept[-1])
    found = lambda edges: (kept.clear(), {tuple(r) for r in links.components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(parts)).collect()})[1]
    star = [(i, -5) for i in range(40)] + [(7, 7), (-5, 3), (3, -5)]
    assert found(star) == {(i, -5) for i in range(40)} and len(kept) == 1  # no round is run only to see that nothing changes
    chain = [(i, i + 1) for i in range(300)] + [(1000 + i, 1001 + i) for i in range(20)]
    random.Random(3).shuffle(chain)
    assert found(chain) == {(i, 0) for i in range(1, 301)} | {(1000 + i, 1000) for i in range(1, 21)} and (parts > 1 or len(kept) == 1)
    assert found([(4, 4)]) == set()


def pairs_of_sets(seed, per_cent):
    """Pairs of sets of random keys: just within the threshold, or by one key not."""
    r = np.random.default_rng(seed)
    for n in [*range(2, 40), 150, 900, 4000]:
        for m in {n, math.floor(n * 100 / per_cent), r.integers(n, math.floor(n * 100 / per_cent) + 1)}:
            least = -(-per_cent * (n + m) // (100 + per_cent))
            for both in {min(n, least), max(0, least - 1)}:
                k = r.integers(0, 2**64, n + m - both, dtype=np.uint64)
                yield both >= least and least <= n, np.sort(k[:n]), np.sort(k[n - both :])


@pytest.mark.parametrize("per_cent", [60, 80, 90])
def test_parts_and_sketches_miss_nothing(per_cent):
    """Sets within the threshold have a part's sum in common, and their sketches say so as well; sets without anything in common part."""
    for seed in range(3):
        within, first, second = zip(*pairs_of_sets(seed, per_cent))
        sides = []
        for sets in (first, second):
            counts, keys = np.array([len(x) for x in sets]), np.concatenate(sets)
            own, total = part_sums(counts, keys, per_cent)
            sides.append((counts, [set(total[own == i].tolist()) for i in range(len(sets))], Sketches(sketches(counts, keys))))
        (n, x, a), (m, y, b) = sides
        maybe = may_reach(a, b, n, m, per_cent)
        for i, real in enumerate(within):
            assert not real or (maybe[i] and (x[i] & y[i] or set(first[i]) == set(second[i])))
        order = np.argsort(n, kind="stable")
        assert may_reach(a, a, n[order], n[order], per_cent).all()
    counts = np.full(50, 200)
    far = Sketches(sketches(counts, np.random.default_rng(9).integers(0, 2**64, 10_000, dtype=np.uint64)))
    apart = may_reach(Sketches(sketches(counts, np.random.default_rng(8).integers(0, 2**64, 10_000, dtype=np.uint64))), far, counts, counts, 80)
    assert not apart.any()


def test_sketch_links_connect_all_near_pairs():
    r = random.Random(4)
    base = [{r.randrange(2**64) for _ in range(r.choice([6, 60, 70, 130, 600]))} for _ in range(30)]
    sets = [np.array(sorted({x for x in r.choice(base) if r.random() > 0.02} | {r.randrange(2**64) for _ in range(r.randint(0, 2))}), np.uint64) for _ in range(200)]
    counts = np.array([len(s) for s in sets])
    links_ = sketch_links(counts, sketches(counts, np.concatenate(sets)), 80)
    assert len(links_) == len({frozenset(x) for x in links_}) < len(sets)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links_:
        assert find(a) != find(b)  # each link connects what was apart
        root[find(a)] = find(b)
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            assert 180 * both < 80 * (counts[i] + counts[j]) or find(i) == find(j)


def test_meetings(spark):
    """Few sets of a part in pairs, many with the smallest, over batches of rows and with repeated rows."""
    few = [(1, x) for x in range(FEW)] + [(1, 3)] * 5
    many = [(2, x) for x in range(100, 100 + 5 * FEW)] + [(2, 107)] * 50
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "7")
    try:
        got = {tuple(r) for r in meetings(spark.createDataFrame(few + many + [(i, 900 + i) for i in range(3, 40)], "part bigint, rep bigint")).collect()}
    finally:
        spark.conf.set(limit, before)
    assert {(a, b) for a, b, part in got if part is None and b < 100} == {(a, b) for b in range(FEW) for a in range(b)}
    assert {(100, x) for x in range(101, 100 + 5 * FEW)} <= {(a, b) for a, b, part in got if part == 2} and all(b < 900 for _, b, _ in got)
    assert all(a // 100 == b // 100 for a, b, _ in got)


def test_shared_phrases_do_not_open_texts(spark, monkeypatch):
    """Texts whose every shingle occurs elsewhere, but that are unlike each other, are not read again and join no groups."""
    r = random.Random(11)
    passages = [[f"w{i}x{k}" for k in range(20)] for i in range(40)]
    rows = [(i, " ".join(w for p in r.sample(passages, 4) for w in p)) for i in range(400)]
    rows += [(1000 + i, t + " more") for i, t in rows[:5]]
    kept = {}
    monkeypatch.setattr(jaccard_join, "stored", lambda df, name: kept.setdefault(name, df.localCheckpoint()))
    got = sorted((tuple(x) for x in jaccard_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    assert got == brute(rows)
    assert 10 <= kept["open-keys"].count() <= 40


@pytest.mark.parametrize("block", [2000, 5])
def test_crowds(spark, monkeypatch, block):
    """A common passage brings many texts together at its parts; only pairs that are alike form groups, however many blocks there are."""
    r = random.Random(12)
    word = lambda: r.choice("abcdefghijklmnop") + str(r.randrange(1000))
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join(passage + [word() for _ in range(r.randint(12, 30))])) for i in range(300)]
    rows += [(400 + i, t + " " + word()) for i, t in rows[100:140]]
    kept = {}
    monkeypatch.setattr(jaccard_join, "stored", lambda df, name: kept.setdefault(name, df.localCheckpoint()))
    got = sorted((tuple(x) for x in jaccard_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), block=block).collect()), key=str)
    assert got == brute(rows)
    assert kept["met-crowds"].count() > 0 and kept["open-keys"].count() <= 120
