"""Targets against step-by-step resharing, and what the mix may and may not take."""

import pytest

from skyfence.llm.mixing import mix, mixed_documents, source_targets


def reshared(sizes):
    """Share by weight; whoever is above the cap stops there and the rest share again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        open_ = [n for n in names if n not in capped]
        level = (total - sum(capped.values())) / sum(weight[n] for n in open_)
        over = [n for n in open_ if weight[n] * level >= 3 * sizes[n]]
        if not over or len(over) == len(open_):
            return {n: float(capped.get(n, min(weight[n] * level, 3 * sizes[n]))) for n in names}
        capped |= {n: 3 * sizes[n] for n in over}


CASES = [{"a": 10}, {"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 1, "c": 5, None: 40}, {"a": 0, "b": 7}, {"z": 3, "Z": 900, "é": 2, "x": 100, None: 0}]


@pytest.mark.parametrize("sizes", CASES)
def test_targets(spark, sizes):
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size bigint")
    got = {r.source: r.target for r in source_targets(df).collect()}
    assert got == pytest.approx(reshared(sizes))
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", "word " * (i % 50)) for i in range(900)] + [(1000, None, "a b c"), (1001, None, None), (None, "hot", ""), (7, "hot", "word"), (7, "hot", "word")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").selectExpr("*", "1 as size", "2 as key", "3 as target", "4 as `range`")
    got = mix(df, rows_per_range=20).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert r["size"] == 0 or (0 <= r.taken <= 3 * r["size"] and r.taken % r["size"] == 0)
        by.setdefault(r.source, []).append(r)
    for group in by.values():
        assert abs(sum(r.taken for r in group) - group[0].target) <= max(r["size"] for r in group) / 2 + 1e-6
        times = {r.epochs for r in group if r["size"]}
        assert max(times, default=0) - min(times, default=0) <= 1  # complete epochs come first
    assert sorted(map(str, mix(df, rows_per_range=10**9).collect())) == sorted(map(str, got))
    out = mixed_documents(df)
    assert out.columns == df.columns
    assert out.count() == sum(r.epochs for r in got)


def test_empty(spark):
    assert mix(spark.createDataFrame([], "doc_id bigint, source string, text string")).count() == 0


def test_rows_kept_whole(spark):
    """Columns with clashing or dotted names, null and repeated ids, one id with several texts."""
    rows = [(1, "a", "one two three " * 30, 1)] * 5 + [(1, "a", "other words here " * 20, 2), (None, "a", "no id " * 40, 3), (None, "a", "no id " * 40, 4), (None, None, "neither " * 60, 5), (2, "b", "x " * 900, 6), (3, "b", None, 7), (4, "c", "z " * 10, 8), (None, "a", "long " * 60_000, 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string, extra int").selectExpr("*", "1 as _id", "2 as _source", "3 as _size", "4 as _epochs", "5 as `a.b`", "6 as `row`", "7 as times", "8 as `all`", "9 as `of`")
    got = mix(df, rows_per_range=3).collect()
    assert len(got) == len(rows)
    for parts in (3, 5000):
        out = mixed_documents(df, rows_per_range=parts)
        assert out.columns == df.columns
        taken = {}
        for r in out.collect():
            taken[r.doc_id, r.source, r.text] = taken.get((r.doc_id, r.source, r.text), 0) + len(r.text.split())
        want = {}
        for r in got:
            want[r.doc_id, r.source] = want.get((r.doc_id, r.source), 0) + r.taken
        have = {}
        for (i, source, _), n in taken.items():
            have[i, source] = have.get((i, source), 0) + n
        assert have == {k: n for k, n in want.items() if n}
        assert sorted(map(str, mixed_documents(df, rows_per_range=parts).collect())) == sorted(map(str, out.collect()))


def test_equal_rows_are_one_row_with_a_count(spark):
    rows = [(7, "a", "same words " * 10)] * 400 + [(i, "b", "word " * 30) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = [r.epochs for r in mix(df, rows_per_range=50).collect() if r.doc_id == 7 and r.source == "a"]
    assert len(got) == 400 and abs(sum(got) * 20 - next(r.target for r in mix(df).collect() if r.source == "a")) <= 10
    assert mixed_documents(df).where("doc_id = 7 and source = 'a'").count() == sum(got)
