"""Rules, scoring, privacy, geolocation, captures and table jobs on small inputs."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from skyfence.operators import baselines as B
from skyfence.operators import evaluation as E
from skyfence.operators import geo as G
from skyfence.operators import matching as M
from skyfence.operators import normalise as N
from skyfence.operators import rules as R
from skyfence.operators import scoring as SC
from skyfence.operators import summaries as A
from skyfence.operators import triage as T
from skyfence.operators.tracks import smooth_tracks
from skyfence.sources import captures, ingest, sinks


def test_rule_null_semantics(spark):
    df = spark.createDataFrame([(1, 5, "abc", (True,)), (2, None, None, None)], "id int, n int, s string, c struct<w:boolean>")
    hit = lambda field, op, value=None: [r.h for r in df.orderBy("id").select(R.condition(df.schema, {"field": field, "op": op, "value": value}).alias("h")).collect()]
    assert hit("n", "ne", 0) == [True, True]
    assert hit("n", "not_in", [5]) == [False, True]
    assert hit("n", "in", [5, 6]) == [True, False]
    assert hit("s", "eq", None) == [False, True]
    assert hit("n", ">=", 5) == [True, False]
    assert hit("n", ">", "x") == [False, False]
    assert hit("s", "contains", "b") == [True, False]
    assert hit("s", "regex", "(?i)^A") == [True, False]
    assert hit("c.w", "eq", True) == [True, False]
    assert hit("c.w", "exists", True) == [True, False]
    assert hit("gone", "exists", False) == [True, True]
    assert hit("gone", "eq", None) == [True, True]
    assert hit("gone.deep", "ne", 0) == [True, True]
    assert hit("n", "like", 5) == [False, False]
    assert [r.h for r in df.select(R.matches(df.schema, {"conditions": []}).alias("h")).collect()] == [False, False]


def test_packaged_rules(spark):
    assert len(R.CORE_RULES) == 10 and len(R.DEFAULT_RULES) == 8
    df = spark.createDataFrame([(1, 0, "s1", "auth", None), (2, 1, "s1", "beacon", None)], "event_id bigint, t_us bigint, sensor_id string, frame_type string, ssid string")
    got = {(r.event_id, r.rule_id) for r in R.apply_rules(df, R.as_rules(R.DEFAULT_RULES), cool=False).collect()}
    assert got == {(1, "WIDS-007")}


def test_findings_score(spark):
    df = spark.createDataFrame([(0.9, 100.0), (0.61, 100.0), (0.60, 100.0), (2.0, 31.0), (0.3, 100.0)], "confidence_raw double, impact double")
    assert [(r.risk_score, r.severity) for r in SC.score_findings(df).collect()] == [
        (90.0, "critical"), (61.0, "high"), (60.0, "medium"), (31.0, "medium"), (30.0, "low"),
    ]


def test_risk_score_trusted_and_weak(spark):
    df = spark.createDataFrame(
        [("Home", "a", "WPA2", -60, "Cisco"), ("Free WiFi", "b", "OPEN", -40, "Unknown"), (None, "c", "WPA3", -90, "Apple")],
        "ssid string, bssid string, encryption string, signal int, vendor string",
    )
    allow = spark.createDataFrame([("Home",)], "name string")
    got = {r.bssid: r for r in SC.score_networks(df, allowlist=allow).collect()}
    assert (got["a"].risk_score, got["a"].risk_level) == (0, "Trusted")
    assert got["b"].risk_score > got["c"].risk_score
    assert got["b"].contributing_factors == ["Weak Encryption (OPEN)", "Suspicious SSID Pattern"]


def test_privacy(spark):
    df = spark.createDataFrame([("aa-bb-cc-11-22-33", "Cafe"), ("", "x")], "bssid string, ssid string")
    part = [r.bssid for r in N.pseudonymise(df, "oui").collect()]
    assert part == ["AA:BB:CC:00:00:00", ""]
    full = N.pseudonymise(df, "unknown mode", "salt", "mask").collect()
    assert full[0].bssid.count(":") == 5 and not full[0].bssid.startswith("AA:BB:CC") and full[0].ssid == "****"
    assert N.pseudonymise(df, "full", "other").first().bssid != full[0].bssid


def test_trilateration_finds_the_planted_target(spark):
    target, sensors = (8.0, 6.0), [("s0", 0.0, 0.0), ("s1", 20.0, 0.0), ("s2", 10.0, 17.0)]
    n, level = G.ENVIRONMENTS["indoor_los"]
    from math import hypot, log10

    rows = [("ap", s, level - 10 * n * log10(hypot(target[0] - x, target[1] - y)), 2412, 0, x, y) for s, x, y in sensors]
    df = spark.createDataFrame(rows, "bssid string, sensor_id string, rssi_dbm double, frequency_mhz int, t_us bigint, x double, y double")
    got = G.trilaterate(df).first()
    assert (got.x_m, got.y_m) == pytest.approx(target, abs=1e-6) and got.error_radius_m < 1e-6 and got.confidence == pytest.approx(0.6)
    two = G.positions(df.filter("sensor_id <> 's2'")).first()
    assert two.method == "strongest_rssi" and (two.x_m, two.y_m) == (0.0, 0.0)
    line = df.withColumn("y", F.lit(0.0))
    assert G.positions(line).first().method == "strongest_rssi"


def test_distance_inverse(spark):
    row = spark.range(1).select(G.distance_m(G.rssi_at(F.lit(12.5), F.lit(5180)), F.lit(5180)).alias("d")).first()
    assert row.d == pytest.approx(12.5)


def test_smoothing_starts_at_the_measurement_and_calms(spark):
    rows = [("ap", i * 1_000_000, float(i) + (0.5 if i % 2 else -0.5), 0.0) for i in range(30)]
    got = smooth_tracks(spark.createDataFrame(rows, "bssid string, t_us bigint, x_m double, y_m double")).orderBy("t_us").collect()
    assert got[0].x_s == rows[0][2] and abs(got[-1].x_s - 29) < 0.5 and got[-1].vx == pytest.approx(1, abs=0.3)
    assert got[-1].uncertainty < got[1].uncertainty


def test_smoothing_in_slices_against_single_steps(spark):
    import numpy as np

    def one_by_one(rows):
        out, before = [], None
        for _, t, x, y in rows:
            if before is None:
                s, cov = np.array([x, y, 0.0, 0.0]), np.eye(4) * 10.0
            else:
                move = np.eye(4)
                move[0, 2] = move[1, 3] = (t - before) / 1e6
                s, cov = move @ s, move @ cov @ move.T + np.eye(4) * 0.1
                gain = cov[:, :2] @ np.linalg.inv(cov[:2, :2] + np.eye(2))
                s, cov = s + gain @ (np.array([x, y]) - s[:2]), cov - gain @ cov[:2, :]
            out.append((*s, cov[0, 0] ** 0.5 if before is None else (2 * cov[0, 0]) ** 0.5))
            before = t
        return out

    r = random.Random(3)
    rows = [(a, r.randrange(10**9), r.random() * 50, r.random() * 50) for a, n in (("hot", 400), ("few", 7), ("one", 1)) for _ in range(n)]
    rows += [rows[5], rows[5][:2] + (1.0, 2.0), ("few", 10**12, 3.0, 4.0)]  # a repeated row, one of the same time, a long gap
    odd = [(None, 1, 1.0, 1.0), ("hot", None, 1.0, 1.0), ("hot", 5, None, 1.0)]
    df = spark.createDataFrame(rows + odd, "bssid string, t_us bigint, x_m double, y_m double").withColumn("extra", F.lit(1))
    want = {a: one_by_one(sorted(x for x in rows if x[0] == a)) for a in ("hot", "few", "one")}
    for slice_rows in (1, 3, 16, 4096):
        got = {}
        for g in smooth_tracks(df, slice_rows).collect():
            got.setdefault(g.bssid, []).append(g)
        assert {a: len(v) for a, v in got.items()} == {a: len(v) for a, v in want.items()}
        for a, v in got.items():
            mine = np.array(sorted([(g.t_us, g.x_m, g.y_m, g.x_s, g.y_s, g.vx, g.vy, g.uncertainty) for g in v]))[:, 3:]
            there = np.array([w for _, w in sorted(zip([x[1:] for x in sorted(x for x in rows if x[0] == a)], want[a]), key=lambda p: p[0])])
            assert np.allclose(np.sort(mine, axis=0), np.sort(there, axis=0), rtol=1e-7, atol=1e-7), (a, slice_rows)
    assert smooth_tracks(df.limit(0)).count() == 0


def test_heatmap_fill_is_nearest(spark):
    cells = spark.createDataFrame([(0, 0, -30.0), (9, 4, -60.0)], "cell_x int, cell_y int, rssi_dbm double")
    got = {(r.cell_x, r.cell_y): (r.rssi_dbm, r.distance2) for r in G.fill_heatmap(cells, 5, 5, 0.5).collect()}
    assert len(got) == 100
    for (x, y), (v, d2) in got.items():
        a, b = x * x + y * y, (x - 9) ** 2 + (y - 4) ** 2
        assert d2 == min(a, b) and (a == b or v == (-30.0 if a < b else -60.0))


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.85])
def test_similar_names_against_all_pairs(spark, threshold):
    import random

    r = random.Random(2)
    base = ["corporate-wifi", "guest-network-lobby", "netgear_5g", "ab", "linksys"]
    names = set(base)
    for name in base * 12:
        s = list(name)
        for _ in range(r.randrange(1, 4)):
            p = r.randrange(len(s) + 1)
            op = r.randrange(3)
            if op == 0:
                s.insert(p, r.choice("abcxyz"))
            elif s and p < len(s):
                s[p : p + 1] = [] if op == 1 else [r.choice("abcxyz")]
        names.add("".join(s) or "z")

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i, *row[1:]] if False else [i] + [0] * len(b) if False else _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        return new

    want = {(a, b) for a in names for b in names if a < b and 1.0 - edits(a, b) / max(len(a), len(b)) >= threshold}
    got = M.similar_ssids(spark.createDataFrame([(n,) for n in names], "ssid string"), threshold).collect()
    assert {(x.ssid_a, x.ssid_b) for x in got} == want and len(got) == len(want)


def record(t, body):
    return struct.pack("<IIII", t, 5, len(body), len(body)) + body


def tap(rssi=-42):
    return struct.pack("<BBHI", 0, 0, 15, 0x2E) + bytes([0, 2]) + struct.pack("<HH", 2437, 0xA0) + struct.pack("b", rssi)


def frame(sub, body, kind=0, flags=0):
    mac = lambda n: bytes([2, 0, 0, 0, 0, n])
    return struct.pack("<HH", (sub << 4) | (kind << 2) | flags, 0) + mac(1) + mac(2) + mac(3) + struct.pack("<H", (77 << 4) | 3) + body


def test_capture_file(spark, tmp_path):
    rsn = struct.pack("<H", 1) + bytes.fromhex("000fac04") + struct.pack("<H", 1) + bytes.fromhex("000fac04") + struct.pack("<H", 1) + bytes.fromhex("000fac08") + struct.pack("<H", 0xC0)
    tags = b"\x00\x04Cafe\x03\x01\x06" + bytes([48, len(rsn)]) + rsn + bytes([45, 2, 0, 0]) + bytes([221, 4]) + bytes.fromhex("0050f204")
    beacon = frame(8, b"\0" * 8 + struct.pack("<HH", 100, 0x11) + tags)
    head = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 127)
    content = head + record(10, tap() + beacon) + record(11, tap(-80) + frame(12, struct.pack("<H", 7))) + record(12, tap() + frame(8, b"\x01\x02\x03\x00data", 2, 0x4000)) + record(13, b"\x01\x02")
    (tmp_path / "a.pcap").write_bytes(content + b"\x01\x02\x03")
    got = captures.read_captures(spark, str(tmp_path)).orderBy("frame_no").collect()
    assert [r.frame_type for r in got] == ["beacon", "deauth", "data", None]
    b = got[0]
    assert (b.ssid, b.channel, b.beacon_interval, b.rssi_dbm, b.seq_num, b.fragment_num, b.t_us) == ("Cafe", 6, 100, -42, 77, 3, 10_000_005)
    assert b.privacy and b.ess and b.ht and b.wps and b.pmf_capable and b.pmf_required and b.rsn_akm == ["000fac08"]
    assert got[1].reason_code == 7 and got[1].rssi_dbm == -80
    assert got[2].wep_iv == "010203" and got[3].parse_error


def test_validation_kinds(spark):
    alerts = spark.createDataFrame([("x", "HIGH", "t", 50.0), ("x", "urgent", "t", 101.0)], "alert_type string, severity string, title string, risk_score double")
    good, bad = ingest.validate(alerts, "alert")
    assert good.count() == 1 and bad.first().reject_reasons == ["severity", "risk_score"]
    beats = spark.createDataFrame([("s", "online"), ("s", "asleep")], "sensor_id string, status string")
    assert ingest.validate(beats, "heartbeat")[1].first().reject_reasons == ["status"]


def test_stream_batch_dedup(spark, tmp_path):
    rows = spark.createDataFrame([("s", f"b{i % 3}", i) for i in range(9)], "sensor_id string, batch_id string, n int")
    rows.select("*", F.timestamp_seconds("n").alias("received_at")).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = ingest.dedup_batches(src, watermark="1 hour").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_collapse_thousand(make):
    rows = [{"t": i / 1000, "frame_type": "deauth", "bssid": "AA", "rssi_dbm": -i % 50 - 30} for i in range(1000)]
    got = A.collapse_events(make(rows)).collect()
    assert len(got) == 1 and got[0].agg_count == 1000 and A.compression(A.collapse_events(make(rows))).first().compression_ratio == 0.999


def test_baseline_merge_equals_whole(make):
    rows = [{"t": i, "ssid": f"n{i % 3}", "security": "WPA2", "channel": 1 + i % 4, "rssi_dbm": -40 - i % 20} for i in range(200)]
    df = make(rows).withColumn("site_id", F.lit("hq"))
    whole = B.build_site_baseline(df)
    merged = B.merge_baseline(B.build_site_baseline(df.filter("t_us < 50000000")), B.build_site_baseline(df.filter("t_us >= 50000000")))
    key = lambda d: sorted((r.network_key, r.sample_count, r.rssi_min, r.rssi_max, r.rssi_sum, tuple(sorted(r.channels.items()))) for r in d.collect())
    assert key(whole) == key(merged)


def test_triage_suppress_escalate_recur(spark):
    s = 1_000_000
    data = [(1, 0, 50.0), (2, 10 * s, 50.0), (3, 20 * s, 80.0), (4, 30 * s, 80.0), (5, 3621 * s, 10.0)]
    df = spark.createDataFrame([(e, t, r, "d", "k", ["X"]) for e, t, r in data], "event_id bigint, t_us bigint, risk_score double, detector_id string, entity_key string, reason_codes array<string>")
    got = T.triage(df).orderBy("event_id").collect()
    assert [(r.event_id, r.emit_reason) for r in got] == [(1, "new"), (3, "escalated"), (5, "recurring")]


def test_prune_keeps_open_alerts(spark):
    day = sinks.DAY_US
    df = spark.createDataFrame([(1, 0, "open"), (2, 0, "resolved"), (3, 399 * day, "resolved")], "id int, created_us bigint, status string")
    assert sorted(r.id for r in sinks.prune(df, "alerts", 400 * day).collect()) == [1, 3]


def test_set_recall_empty(spark):
    none = spark.createDataFrame([], "bssid string")
    got = E.set_recall(none, none).first()
    assert (got.precision, got.recall, got.f1_score) == (0.0, 0.0, 0.0)


def test_risk_model_separates(spark):
    rows = [(float(i % 2), float(i % 7), "HIGH" if i % 2 else "LOW") for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, label string")
    model, mean, _ = E.train_risk_model(df, ["a", "b"], max_iter=50)
    assert mean == 1.0
    got = {r.label: r.score for r in E.predict_risk(df, model, ["a", "b"]).select("label", "score").distinct().groupBy("label").agg(F.max("score").alias("score")).collect()}
    assert got["HIGH"] > got["LOW"]


def test_anomaly_model_flags_the_odd_row(spark):
    rows = [(i / 100, i / 100, 0.5) for i in range(100)]
    feats = ["a", "b", "c"]
    model = E.fit_anomaly(spark.createDataFrame(rows, "a double, b double, c double"), feats, k=1)
    got = E.score_anomaly(spark.createDataFrame([*rows, (0.0, 1.0, 0.5)], "a double, b double, c double"), model)
    assert [r.is_anomaly for r in got.collect()] == [False] * 100 + [True]


def test_recent_takes_what_is_asked(spark):
    from skyfence.operators import summaries as A

    df = spark.range(3000).selectExpr("id as event_id", "id * 10 as t_us")
    rows = A.recent(df, 2500).collect()
    assert len(rows) == 2500 and rows[0].event_id == 2999


def test_current_networks_loses_none(spark):
    from skyfence.operators import summaries as A

    df = spark.range(5000).selectExpr("id as event_id", "id as t_us", "cast(case when id < 3 then id else 7 end as string) as bssid")
    assert {r.bssid for r in A.current_networks(df).collect()} == {"0", "1", "2", "7"}
    assert {r.bssid for r in A.current_networks(df, n=10).collect()} == {"7"}


def test_similar_names_of_any_length(spark):
    long = "conference-room-" * 40
    names = [long, long[:300] + "X" + long[301:], long[:200] + long[203:], "a" * 33, "a" * 32 + "b", "a" * 10]
    got = {(r.ssid_a, r.ssid_b) for r in M.similar_ssids(spark.createDataFrame([(n,) for n in names], "ssid string")).collect()}
    assert got == {tuple(sorted(p)) for p in ((names[0], names[1]), (names[0], names[2]), (names[1], names[2]), (names[3], names[4]))}


def test_paging_rules(spark):
    from skyfence.operators import summaries as A

    m = 60_000_000
    mixed = [("scan", "HIGH" if i % 2 else "LOW", k * m + i * 1_000_000) for k in range(12) for i in range(12)]  # 6 + 6 a minute
    early = [("deauth_flood", "LOW", 10_000_000)]
    pages = A.alert_pages(spark.createDataFrame(mixed + early, "alert_type string, severity string, t_us bigint")).collect()
    deauth = sorted(r.eval_us for r in pages if r.rule == "deauth_flood")
    assert deauth == [30_000_000, 60_000_000, 90_000_000, 120_000_000]
    rate = sorted(r.eval_us for r in pages if r.rule == "high_rate")
    # more than fifty in five minutes from minute 4.5 on (five minutes held), until less than five minutes of alerts are left in the window
    assert rate and {r.alert_type for r in pages if r.rule == "high_rate"} == {"scan"}
    counts = {e: sum(e - 5 * m <= t < e for _, _, t in mixed) for e in range(0, 20 * m, m // 2)}
    assert rate == [e for e in counts if all(counts.get(e - k * m // 2, 0) > 50 for k in range(11))]


def test_heatmap_border(spark):
    df = spark.createDataFrame([(-0.4, -0.4, -50), (0.1, 0.1, -60), (60.0, 1.0, -70)], "x double, y double, rssi_dbm bigint")
    assert [(r.cell_x, r.cell_y, r.samples) for r in G.heatmap(df).collect()] == [(0, 0, 1)]
    assert tuple(G.off_map(df).first()) == (2, 3)


def test_candidate_weights_do_not_depend_on_partitions(spark):
    from skyfence.operators.evaluation import candidate_weights

    rows = [tuple(r) for r in candidate_weights(spark, 20).orderBy("candidate").collect()]
    assert rows == [tuple(r) for r in candidate_weights(spark, 20).repartition(3).orderBy("candidate").collect()]
    assert all(abs(sum(r[1:]) - 1) < 0.03 for r in rows)


def test_unknown_profile(spark):
    from skyfence.operators.detector_set import run_detectors

    with pytest.raises(ValueError):
        run_detectors(spark.range(1), "full_wid")


def test_risk_model_learns_and_does_not_depend_on_layout(spark):
    from skyfence.operators import evaluation as E

    rows = [(float(i % 10), float(i % 7), "HIGH" if i % 10 + (i % 7) / 10 > 5 else "LOW") for i in range(600)]
    df = spark.createDataFrame(rows, "a double, b double, label string")
    model, mean, spread = E.train_risk_model(df, ["a", "b"], max_iter=50)
    assert mean > 0.95 and E.train_risk_model(df.repartition(7), ["a", "b"], max_iter=50)[1:] == (mean, spread)
    got = E.predict_risk(df, model, ["a", "b"]).collect()
    assert sum((r.probability > 0.5) == (r.label == "HIGH") for r in got) > 580 and all(abs(r.score - 100 * r.probability) <= 1 for r in got)


def test_anomaly_axes(spark):
    from skyfence.operators import evaluation as E

    rows = [(float(i % 9), 2.0 * (i % 9), 1.0) for i in range(90)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    model = E.fit_anomaly(df, ["a", "b", "c"], k=1)
    odd = spark.createDataFrame([(4.0, 8.0, 1.0), (4.0, 1.0, 1.0)], "a double, b double, c double")
    assert [r.is_anomaly for r in E.score_anomaly(odd, model).orderBy(F.col("b").desc()).collect()] == [False, True]


def test_scratch_folders_go(spark, tmp_path):
    import os

    from skyfence import session

    before, session._made[:] = list(session._made), []
    path = session.shared_dir(spark, "gone")
    spark.range(3).write.parquet(path)
    assert os.path.isdir(path) and session.drop_scratch(spark) == 1 and not os.path.exists(path)
    session._made[:] = before


def test_risk_model_as_a_plain_solution(spark):
    import numpy as np

    from skyfence.operators import evaluation as E

    r = np.random.default_rng(5)
    a, b = r.normal(size=800).round(1), r.integers(0, 5, 800).astype(float)
    y = r.random(800) < 1 / (1 + np.exp(-(0.7 * a - 0.5 * b + 0.6)))
    df = spark.createDataFrame([(float(p), float(q), "HIGH" if v else "LOW", i) for i, (p, q, v) in enumerate(zip(a, b, y))], "a double, b double, label string, id int")
    model, mean, spread = E.train_risk_model(df, ["a", "b"], key="id")
    x, w = np.stack([a, b, np.ones(800)], axis=1), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    assert np.allclose([*model["coefficients"], model["intercept"]], w, atol=1e-3)
    z = x @ w
    area = np.mean([(z[y][:, None] > z[~y]).mean() + (z[y][:, None] == z[~y]).mean() / 2])
    assert abs(mean - area) < 0.03 and 0 < spread < 0.1


def test_rules_from_files(spark, tmp_path):
    import json

    from skyfence.operators import rules as R

    rules = R.as_rules(R.CORE_RULES)
    for i, part in enumerate((rules[:2], rules[2:])):
        (tmp_path / f"{i}.json").write_text(json.dumps({"rules": part}, indent=1))
    want = json.loads(json.dumps(rules))
    assert R.load_rules(str(tmp_path), spark) == want and R.load_rules(str(tmp_path / "0.json")) == want[:2]


def test_clients_in_rows(spark, make):
    from skyfence.operators import summaries as A

    frames = make([{"t": i, "frame_type": "data", "bssid": "A", "src_addr": f"S{i % 3}", "dst_addr": ["A", "FF:FF:FF:FF:FF:FF", f"S{i % 3}"][i % 3]} for i in range(9)])
    got = sorted(map(tuple, A.network_clients(frames).collect()))
    assert got == [("A", f"S{k}", 3, k * 10**6, (k + 6) * 10**6) for k in range(3)]


def test_cut_records_by_column():
    tap = bytes.fromhex("00000f002e0000000002" + "8509" + "a000" + "c4")
    mac = bytes(range(22))
    cuts = captures.Cuts()
    before = captures._tap.cache_info()
    for i, raw in enumerate([
        tap + b"\x80\x08" + mac + bytes(12) + b"\x00\x02ab\x03\x01\x06" + b"\xdd\x09cut", tap + b"\x40\x00" + mac, tap + b"\xb4\x00" + mac[:14], tap + b"\x08\x00" + mac[:10], b"\x01" * 30, b"",
    ]):
        cuts.add("f", i, 10 * i, raw)
    after = captures._tap.cache_info()
    rows = cuts.batch().to_pylist()
    assert after.hits + after.misses - before.hits - before.misses == 4 and after.misses - before.misses <= 1  # one header read for all that begin alike
    assert [r["elements"] for r in rows] == [[{"kind": 0, "body": b"ab"}, {"kind": 3, "body": b"\x06"}], [], [], None, None, None]
    assert [r["parse_error"] for r in rows] == [None, None, None, "short 802.11 header", "bad radiotap header", "bad radiotap header"]
    assert [(r["rssi_dbm"], r["frequency_mhz"]) for r in rows] == [(-60, 2437)] * 4 + [(None, None)] * 2
    assert [(r["frame_no"], r["t_us"], r["header"], r["body"]) for r in rows[1:3]] == [(1, 10, b"\x40\x00" + mac, b""), (2, 20, b"\xb4\x00" + mac[:14], b"")]
    assert captures.Cuts().SCHEMA == cuts.batch().schema
