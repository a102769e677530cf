"""Tables kept on disk: buckets of networks by version, retention by partitions."""

import glob
import os
import tempfile

from pyspark.sql import functions as F

from skyfence.sources import networks, sinks

DDL = "bssid string, ssid string, channel int, rssi bigint, encryption string, vendor string, wps boolean, handshake_captured boolean, risk_score bigint, t_us bigint"


def sightings(spark, aps, t):
    return spark.createDataFrame([(f"AP{a}", "net", 1, -50 - a, "WPA2", "v", a % 2 == 0, False, 10, t) for a in aps], DDL)


def files(path):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}


def rows(df):
    return sorted(map(tuple, df.select("bssid", "first_seen", "last_seen", "beacon_count").collect()))


def test_batches_rewrite_their_buckets_only(spark):
    path = tempfile.mkdtemp()
    assert len(networks.merge_batch(sightings(spark, range(40), 1), 0, path, 8)) == 8
    first = files(path)
    touched = networks.merge_batch(sightings(spark, [3], 2), 1, path, 8)
    second = files(path)
    assert len(touched) == 1 and set(first.items()) <= set(second.items())
    assert {p for p in second if p not in first} == set(glob.glob(f"{path}/data/v=1/bucket={touched[0]}/*.parquet"))
    got = {r[0]: r[1:] for r in rows(networks.read_networks(spark, path))}
    assert len(got) == 40 and got["AP3"] == (1, 2, 2) and got["AP4"] == (1, 1, 1)
    assert {r[3] for r in rows(networks.read_networks(spark, path, back=1))} == {1}


def test_a_batch_tried_again_changes_nothing(spark):
    path = tempfile.mkdtemp()
    networks.merge_batch(sightings(spark, range(9), 1), 0, path, 4)
    networks.merge_batch(sightings(spark, range(9), 2), 1, path, 4)
    before, want = files(path), rows(networks.read_networks(spark, path))
    assert networks.merge_batch(sightings(spark, range(9), 2), 1, path, 4) == [] and networks.merge_batch(sightings(spark, range(9), 1), 0, path, 4) == []
    assert files(path) == before and rows(networks.read_networks(spark, path)) == want


def test_a_batch_lost_before_its_manifest_is_made_again(spark, monkeypatch):
    path = tempfile.mkdtemp()
    networks.merge_batch(sightings(spark, range(9), 1), 0, path, 4)
    with monkeypatch.context() as m:
        m.setattr(networks.Files, "put", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        try:
            networks.merge_batch(sightings(spark, range(9), 2), 1, path, 4)
        except OSError:
            pass
    assert {r[3] for r in rows(networks.read_networks(spark, path))} == {1}
    networks.merge_batch(sightings(spark, range(9), 2), 1, path, 4)
    assert {r[3] for r in rows(networks.read_networks(spark, path))} == {2}


def test_two_versions_stay(spark):
    path = tempfile.mkdtemp()
    networks.merge_batch(sightings(spark, range(30), 0), 0, path, 4)
    for n in range(1, 6):
        networks.merge_batch(sightings(spark, [n], n), n, path, 4)
    assert sorted(os.path.basename(p) for p in glob.glob(f"{path}/manifest/[0-9]*.json")) == ["4.json", "5.json"]
    named = {f"v={v}/bucket={b}" for n in (4, 5) for b, v in networks._manifest(networks.Files(spark, path), n)["current"].items()}
    assert {os.path.relpath(p, f"{path}/data") for p in glob.glob(f"{path}/data/v=*/bucket=*")} == named
    assert sum(r[3] for r in rows(networks.read_networks(spark, path))) == 35
    assert networks.merge_batch(sightings(spark, [], 9), 6, path) == [] and networks.read_networks(spark, path).count() == 30


def stored(spark, column):
    day = sinks.DAY_US
    df = spark.range(0, 40).select(F.col("id"), (F.col("id") * day + day // 2).alias(column), F.when(F.col("id") % 3 == 0, sinks.RETENTION["alerts"][2][1]).otherwise("open").alias("status"))
    path = tempfile.mkdtemp() + "/t"
    df.withColumn("event_date", F.to_date(F.timestamp_micros(column))).repartition("event_date").write.partitionBy("event_date").parquet(path)
    return path


def parts(path):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/event_date=*/*.parquet")}


def test_old_dates_go_unread_and_young_ones_stay(spark):
    path = stored(spark, "ingested_us")
    before = parts(path)
    for p in before:  # nothing may read what is only deleted
        if p.split("event_date=")[1] < "1970-01-10":
            with open(p, "wb") as f:
                f.write(b"no parquet")
    got = sinks.prune_table(spark, path, "telemetry", int(39.75 * sinks.DAY_US))
    assert got["dropped"] == [f"1970-01-0{d}" for d in range(1, 10)] and got["rewritten"] == ["1970-01-10"]
    after = parts(path)
    young = {p: t for p, t in before.items() if p.split("event_date=")[1] > "1970-01-11"}
    assert young.items() <= after.items() and len(young) == 30 and {r["id"] for r in spark.read.parquet(path).collect()} == set(range(10, 40))


def test_open_rows_never_go(spark):
    path = stored(spark, "created_us")
    before = parts(path)
    got = sinks.prune_table(spark, path, "alerts", 20 * sinks.DAY_US, days=0)
    assert got["dropped"] == [] and len(got["rewritten"]) == 20 and len(got["left"]) == 20
    young = {p: t for p, t in before.items() if p.split("event_date=")[1] >= "1970-01-21"}
    assert young.items() <= parts(path).items()
    assert {r["id"] for r in spark.read.parquet(path).collect()} == {i for i in range(40) if i % 3 or i >= 20}
    assert sinks.prune_table(spark, path, "alerts", 0)["rewritten"] == []
