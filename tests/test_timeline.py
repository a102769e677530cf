"""The shared primitives against plain Python, on random and on hostile inputs."""

import random

import pytest
from pyspark.sql import functions as F

from skyfence.operators.timeline import cooldown, episodes, running, slot_of, trailing


def rows(seed, n=400, span=5000, keys=3):
    r = random.Random(seed)
    # The first key holds most rows.
    return [(i, "hot" if r.random() < 0.6 else f"k{r.randrange(keys)}", r.randrange(span), r.choice("abcdef") if r.random() < 0.8 else None, r.random() < 0.05) for i in range(n)]


DDL = "event_id bigint, k string, t_us bigint, v string, f boolean"


def brute_cooldown(data, cool, forced=False):
    kept, last = [], {}
    for e, k, t, _, f in sorted(data, key=lambda x: (x[2], x[0])):
        if k not in last or t - last[k] >= cool or (forced and f):
            last[k] = t
            kept.append(e)
    return sorted(kept)


@pytest.mark.parametrize("cool", [1, 7, 60, 900, 20000])
@pytest.mark.parametrize("forced", [False, True])
def test_cooldown(spark, cool, forced):
    data = rows(cool)
    for slices in (1, 8, 64):
        out = cooldown(spark.createDataFrame(data, DDL), ["k"], cool, forced="f" if forced else None, slices=slices)
        assert sorted(r.event_id for r in out.collect()) == brute_cooldown(data, cool, forced)


def test_cooldown_regular_train(spark):
    """Evenly spaced candidates never merge their chains: the worst case for the summaries."""
    data = [(i, "hot", i, "a", False) for i in range(2000)]
    out = cooldown(spark.createDataFrame(data, DDL), ["k"], 37, slices=2)
    assert sorted(r.event_id for r in out.collect()) == brute_cooldown(data, 37)


def test_cooldown_keeps_rows_without_key(spark):
    data = [(1, None, 5, "a", False), (2, None, 6, "a", False), (3, "x", 5, "a", False)]
    out = cooldown(spark.createDataFrame(data, DDL), ["k"], 10)
    assert sorted(r.event_id for r in out.collect()) == [1, 3]


def test_cooldown_length_per_key(spark):
    data = [(i, k, t, "a", False) for i, (k, t) in enumerate([("a", 0), ("a", 6), ("b", 0), ("b", 6)])]
    df = spark.createDataFrame(data, DDL).withColumn("c", F.when(F.col("k") == "a", 5).otherwise(10))
    assert sorted(r.event_id for r in cooldown(df, ["k"], "c").collect()) == [0, 1, 2]


@pytest.mark.parametrize("width", [1, 50, 700])
def test_trailing(spark, width):
    data = rows(width)
    out = trailing(spark.createDataFrame(data, DDL), ["k"], width, {"n": None, "m": F.col("f")}, {"d": "v"}, slots_per_width=2)
    got = {r.event_id: (r.n, r.m, r.d) for r in out.collect()}
    assert len(got) == len(data)
    for e, k, t, _, _ in data:
        near = [x for x in data if x[1] == k and t - width <= x[2] <= t]
        assert got[e] == (len(near), sum(x[4] for x in near), len({x[3] for x in near if x[3]}))


def test_trailing_backwards(spark):
    data = rows(5)
    df = spark.createDataFrame(data, DDL).withColumn("b", -F.col("t_us"))
    got = {r.event_id: r.n for r in trailing(df, ["k"], 100, {"n": None}, t="b").collect()}
    for e, k, t, _, _ in data:
        assert got[e] == sum(1 for x in data if x[1] == k and t <= x[2] <= t + 100)


@pytest.mark.parametrize("inclusive", [False, True])
def test_running(spark, inclusive):
    data = rows(11)
    spec = {"s": ("sum", F.col("t_us")), "c": ("count", F.col("v")), "x": ("max", F.col("t_us")), "l": ("last", F.col("v")), "a": ("first", F.col("v"))}
    got = {r.event_id: r for r in running(spark.createDataFrame(data, DDL), ["k"], spec, inclusive=inclusive, slice_us=300).collect()}
    ordered = sorted(data, key=lambda x: (x[2], x[0]))
    for i, (e, k, t, v, _) in enumerate(ordered):
        before = [x for x in ordered[: i + inclusive] if x[1] == k]
        values = [x[3] for x in before if x[3]]
        r = got[e]
        assert r.s == (sum(x[2] for x in before) if before else None)
        assert r.c == len(values)
        assert r.l == (values[-1] if values else None) and r.a == (values[0] if values else None)


def test_episodes(spark):
    data = rows(3, n=80, span=9000)
    df = spark.createDataFrame(data, DDL)
    got = {r.event_id: r.episode for r in df.withColumn("_slot", slot_of("t_us", 60)).join(episodes(df, ["k"], 60), ["k", "_slot"]).collect()}
    last, start = {}, {}
    for e, k, t, _, _ in sorted(data, key=lambda x: (x[2], x[0])):
        if k not in last or t - last[k] > 60:
            start[k] = t
        last[k] = t
        assert got[e] == start[k]


def test_order_and_partitioning_do_not_matter(spark):
    data = rows(21)
    shuffled = data[:]
    random.Random(1).shuffle(shuffled)
    a = cooldown(trailing(spark.createDataFrame(data, DDL), ["k"], 80, {"n": None}).filter("n > 2"), ["k"], 100)
    b = cooldown(trailing(spark.createDataFrame(shuffled, DDL).repartition(7), ["k"], 80, {"n": None}).filter("n > 2"), ["k"], 100)
    assert sorted(a.collect()) == sorted(b.collect())


@pytest.mark.parametrize("cool", [1, 7, 60, 900])
def test_thin_equals_cooldown(spark, cool):
    from skyfence.operators.timeline import thin

    data = rows(cool + 100)
    assert sorted(r.event_id for r in thin(spark.createDataFrame(data, DDL), ["k"], cool).collect()) == brute_cooldown(data, cool)


def test_slice_summary_holds_little_more_than_its_instants():
    import tracemalloc

    import numpy as np

    from skyfence.operators.timeline import _exit_steps

    n = 300_000
    ts, ones = np.arange(n, dtype=np.int64) * 1000, np.ones(n, bool)
    tracemalloc.start()
    bounds, exits = _exit_steps(ts, ones, ~ones, 40_000_000, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * n
    assert len(bounds) == len(exits) and exits[0] == 280_000_000 and bounds[-1] == 40_000_000


def test_wardrive_files_hold_thousands_of_frames(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from skyfence.plans import QUERIES, ingest

    spark.range(3000).select(
        F.col("id").alias("event_id"), F.timestamp_micros(F.lit(ingest.BASE) + F.col("id") * 1_000_000).alias("ts"), (F.col("id") % 50).alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 3}').alias("props"),
    ).write.parquet(f"{tmp_path}/events.parquet")
    made, path = ingest.shared_dir, []
    monkeypatch.setattr(ingest, "shared_dir", lambda *a: path.append(made(*a)) or path[-1])
    rows = QUERIES["s07_read_wardrive"](spark, str(tmp_path)).collect()
    assert sum(r["sightings"] for r in rows) == 3000
    assert spark.read.text(path[0], wholetext=True).count() <= 4
