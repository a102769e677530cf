"""The walk against its definition step by step, order and wrap-around against Python, likeness against planted edits."""

import hashlib
import random

import numpy as np

from skyfence.llm.edit_fingerprints import SLOTS, STRIDE, Embedding, edited, fingerprint_documents, hexed, likeness, near_groups, scrambled

E = Embedding()


def plain(text):
    """One walk, one step at a time."""
    kinds = (scrambled(np.array([ord(c) for c in text], np.uint64) + np.uint64(77)) % np.uint64(63)).tolist()
    records = dict(zip(E.records, E.slots))
    out, at, step, bits = np.zeros(SLOTS, np.uint8), 0, 0, []
    while at < len(text):
        if step % STRIDE == 0:
            bits = E.bits(step).tolist()
        if step in records:
            mixed = scrambled(np.array([ord(text[at])], np.uint64) * np.uint64(0x100000001B3) + np.uint64(step))
            out[records[step]] = scrambled(mixed + records[step].astype(np.uint64)) & np.uint64(15)
        at += bits[step % STRIDE] >> kinds[at] & 1
        step += 1
    return out


def words(r, n):
    return " ".join("".join(r.choice("abcdefghiklmnoprstuvwé") for _ in range(r.randint(2, 9))) for _ in range(n))


def test_walk():
    r = random.Random(1)
    texts = ["", "a", "é𝔘", "aaaa", *[words(r, r.randint(1, 300)) for _ in range(30)], words(r, 3000), words(r, 2500)]
    got = E.values(texts)
    for t, g in zip(texts, got):
        assert (plain(t) == g).all()
    assert (E.values(texts[-3:]) == got[-3:]).all()
    assert E.values([]).shape == (0, SLOTS)


def test_likeness():
    r = random.Random(2)
    base = [words(r, 400) for _ in range(20)]
    few = [t[:100] + "x" + t[100:900] + t[905:] for t in base]
    v, w = E.values(base), E.values(few)
    assert np.median(likeness(v, w)) > 0.85  # two walks that part meet again soon, though not always
    assert likeness(v, E.values([edited(a, b) for a, b in zip(base, base[1:] + base[:1])])).mean() > 0.65
    assert likeness(v[:-1], v[1:]).max() < 0.3 < likeness(v, w).min()
    assert (likeness(v, v) == 1).all()


def test_rows(spark):
    r = random.Random(3)
    rows = [(r.randint(-10**15, 10**15), words(r, r.randint(0, 60))) for _ in range(300)] + [(None, "first of all"), (5, "twice"), (5, "twice"), (6, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).selectExpr("*", "'x' as part", "1 as extra", "'y' as fingerprint")
    for per_range in (10, 10**6):
        got = {}
        for x in fingerprint_documents(df, rows_per_range=per_range).collect():
            got.setdefault(x.doc_id, []).append(x)
        assert sum(map(len, got.values())) == len(rows)
        order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0))
        for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
            want = hashlib.sha256(edited(t, n).encode()).hexdigest()
            x = next(x for x in got[i] if x.edited_sha256 == want)
            own, new, following = E.values([t, edited(t, n), n])
            assert x.n_chars == len(t) and x.fingerprint == hexed(own[None])[0] and x.edited_fingerprint == hexed(new[None])[0]
            assert x.near_edited == likeness(own, new) and (i == 5 or x.near_next == likeness(own, following))
    assert fingerprint_documents(df.limit(0)).count() == 0
    assert fingerprint_documents(df.where("doc_id = 6")).count() == 1


def test_near_groups(spark):
    r = random.Random(4)
    base = [words(r, 150) for _ in range(12)]
    rows = []
    for k, t in enumerate(base):
        rows += [(100 * k + 1, t), (100 * k + 2, t), (100 * k + 3, t[:300] + "zq" + t[300:]), (100 * k + 4, t[:500] + t[503:])]
    df = spark.createDataFrame(rows + [(5000, None), (5001, "")], "doc_id bigint, text string")
    for block in (2000, 2):
        got = {x.doc_id: x.component_id for x in near_groups(df, block=block).collect()}
        assert all(got[100 * k + j] == 100 * k + 1 for k in range(12) for j in (1, 2)) and got[5001] == 5000
        assert sum(got[100 * k + j] == 100 * k + 1 for k in range(12) for j in (3, 4)) > 15  # the others' walks stay apart for long
        assert all(v // 100 == k // 100 for k, v in got.items())
