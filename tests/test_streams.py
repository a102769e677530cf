"""State of the keyed streams: what a micro-batch reads, and what is remembered for how long."""

import os
import random
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyfence.operators import detectors as D
from skyfence.streaming import stateful as ST
from skyfence.streaming.windowed import to_parquet

S = 1_000_000
BASE = 1_704_067_200_000_000
AP, STA = "AA:BB:CC:00:00:01", "AA:BB:CC:00:00:02"


class Held:
    """A state of the handle, in memory; counts what is read."""

    def __init__(self):
        self.held, self.reads = {}, 0

    def updateValue(self, key, value):
        self.held[key] = value

    def getValue(self, key):
        self.reads += 1
        return self.held[key]

    def removeKey(self, key):
        del self.held[key]

    def keys(self):
        return list(self.held)

    def get(self):
        return self.held.get("value")

    def update(self, value):
        self.held["value"] = value

    def clear(self):
        self.held.clear()


class Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getMapState(self, name, *_):
        return self.states.setdefault(name, Held())

    getValueState = getMapState

    def registerTimer(self, ms):
        self.timers.add(ms)


class Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def stepper(idle_us=60 * S):
    p = ST.InOrder(lambda memory, t, rows: [(t, len(rows))], [("t_us", "bigint"), ("event_id", "bigint")], "t bigint, n bigint", idle_us, 0)
    p.init(Handle())
    return p


def test_waiting_rows_are_not_read_before_their_time():
    p, n = stepper(), 200_000
    order = list(range(n))
    random.Random(1).shuffle(order)
    for at in range(0, n, 50_000):
        part = order[at:at + 50_000]
        list(p.handleInputRows(("k",), iter([pd.DataFrame({"t_us": [i * 1000 for i in part], "event_id": part})]), Mark(0)))
    blocks = p.handle.states["blocks"]
    assert blocks.reads == 0 and len(blocks.held) == n / ST.BLOCK
    out = [r for pdf in p.handleExpiredTimer(("k",), Mark(1000), None) for r in pdf.itertuples(index=False)]
    assert [r.t for r in out] == [i * 1000 for i in range(1000)] and blocks.reads <= 8  # four batches, blocks of 1000
    seen, mark = len(out), 1000
    while blocks.held:
        mark += 20_000
        seen += sum(len(pdf) for pdf in p.handleExpiredTimer(("k",), Mark(mark), None))
    assert seen == n
    assert p.handle.states["memory"].held and not list(p.handleExpiredTimer(("k",), Mark(10**9), None)) and not p.handle.states["memory"].held


def replayed(spark, frames, stream, files=1):
    """A stream's alerts over frames that come in ``files`` shuffled parts, then a closing frame far ahead."""
    path = tempfile.mkdtemp()
    for i in range(files):
        frames.filter(F.pmod("event_id", F.lit(files)) == i).coalesce(1).write.mode("append").parquet(f"{path}/in")
    frames.limit(1).withColumns({"t_us": F.lit(10**13), "event_id": F.lit(-1).cast("bigint"), "bssid": F.lit("closing")}).coalesce(1).write.mode("append").parquet(f"{path}/in")
    rows = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/in")
    alerts = stream(ST.event_time(rows, BASE, "1 hour"), base_us=BASE)
    to_parquet(alerts, f"{path}/out", f"{path}/ck").awaitTermination()
    return spark.read.schema(alerts.schema).parquet(f"{path}/out")


@pytest.mark.parametrize("files", [1, 3])
def test_reinstallation_long_after_the_handshake(spark, make, files):
    def message(t, m):
        return {"t": t, "frame_type": "eapol", "bssid": AP, "eapol_message": m, "src_addr": AP if m in (1, 3) else STA, "dst_addr": STA if m in (1, 3) else AP}

    frames = make([message(1 + m / 10, m) for m in (1, 2, 3, 4)] + [message(304, 3)])
    columns = ["t_us", "severity", "attack_subtype", "m3_count"]
    want = sorted(map(tuple, D.krack(frames).select(*columns).collect()))
    assert [r[1] for r in want] == ["CRITICAL"]
    assert sorted(map(tuple, replayed(spark, frames, ST.krack_stream, files).select(*columns).collect())) == want


@pytest.mark.parametrize("files", [1, 4])
def test_twins_whatever_the_order(spark, make, files):
    from test_detectors import twins

    frames = make(twins("DE:AD:BE", "Open") + [r | {"t": r["t"] + 400, "ssid": "Other"} for r in twins()])
    columns = ["t_us", "severity", "ssid", "original", "bssid", "score", "confidence", "duplicate_count"]
    want = sorted(map(tuple, D.evil_twin(frames).select(*columns).collect()))
    assert len(want) == 2
    assert sorted(map(tuple, replayed(spark, frames, ST.evil_twin_stream, files).select(*columns).collect())) == want


def test_full_profile_has_streaming_forms():
    from skyfence.operators.detector_set import PROFILES

    assert set(PROFILES["full_wids"]) <= set(ST.STREAMS)


def test_one_timer_and_one_reading_however_much_waits():
    p, n = stepper(), 50_000
    list(p.handleInputRows(("k",), iter([pd.DataFrame({"t_us": [i * 1000 for i in range(n)], "event_id": range(n)})]), Mark(0)))
    assert len(p.handle.timers) == 1
    out = [r for pdf in p.handleExpiredTimer(("k",), Mark(10**6), None) for r in pdf.itertuples(index=False)]
    assert [r.t for r in out] == [i * 1000 for i in range(n)] and p.handle.states["blocks"].reads == n / ST.BLOCK


def test_a_span_of_many_files_loses_no_frame(spark, tmp_path):
    from skyfence.plans import QUERIES

    e = spark.range(2400).select(
        F.col("id").alias("event_id"), F.timestamp_micros(F.lit(BASE) + F.col("id") * 400 * S).alias("ts"), (F.col("id") * 7 % 50).alias("user_id"),
        F.lit("view").alias("event_type"), (F.col("id") % 40).cast("double").alias("value"), F.format_string('{"k": %d}', F.col("id") % 100).alias("props"),
    )
    for i in range(20):  # each file holds rows of all times
        e.filter(F.col("event_id") % 20 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")  # a file a partition
    try:
        got = QUERIES["st_d11_apply_rules"](spark, str(tmp_path)).select("event_id", "rule_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    want = QUERIES["d11_apply_rules"](spark, str(tmp_path)).select("event_id", "rule_id").collect()
    assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_state_tasks_follow_the_cores(spark, make, tmp_path):
    make([{"t": i, "frame_type": "deauth", "bssid": AP, "dst_addr": STA} for i in range(100)]).coalesce(1).write.parquet(f"{tmp_path}/in")
    given, name, cores = spark.conf.get("spark.sql.shuffle.partitions"), "spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism

    def begun(at, partitions, **options):
        rows = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
        spark.conf.set(name, str(partitions))
        try:
            q = to_parquet(ST.deauth_flood_stream(ST.event_time(rows, BASE)), f"{tmp_path}/{at}", f"{tmp_path}/{at}_ck", **options)
            assert spark.conf.get(name) == str(partitions)
            q.awaitTermination()
        finally:
            spark.conf.set(name, given)
        return {s["numShufflePartitions"] for p in q.recentProgress for s in p["stateOperators"]}

    assert begun("many", 4 * cores) == {cores}
    assert begun("few", 1) == {1}
    assert begun("own", 1, tasks=2) == {2}


@pytest.mark.parametrize("files", [3, 30])
def test_micro_batches_do_not_grow_with_files(spark, tmp_path, files):
    from skyfence.plans import stream as PS

    e = spark.range(3000).select(
        F.col("id").alias("event_id"), F.timestamp_micros(F.lit(BASE) + F.col("id") * 400 * S).alias("ts"), (F.col("id") * 7 % 50).alias("user_id"),
        F.lit("view").alias("event_type"), (F.col("id") % 40).cast("double").alias("value"), F.format_string('{"k": %d}', F.col("id") % 100).alias("props"),
    )
    e.repartition(files, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")  # a file a partition
    try:
        rows, path = PS.replay(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    q = to_parquet(rows.select("event_id"), f"{path}/out", f"{path}/ck")
    q.awaitTermination()
    assert spark.read.parquet(f"{path}/out").filter("event_id >= 0").count() == 3000
    assert len([n for n in os.listdir(f"{path}/ck/offsets") if n.isdigit()]) <= 5
