"""Detector behaviour on hand-made frames."""

import random

from pyspark.sql import functions as F

from skyfence.operators import detectors as D
from skyfence.operators import triage as T
from skyfence.operators.detector_set import LITE, PROFILES, run_detectors

AP, STA, ALL = "AA:BB:CC:00:00:01", "02:00:00:00:00:01", "FF:FF:FF:FF:FF:FF"


def eapol(msgs, t0=0.0):
    return [
        {"t": t0 + i, "frame_type": "eapol", "bssid": AP, "eapol_message": m, "src_addr": AP if m in (1, 3) else STA, "dst_addr": STA if m in (1, 3) else AP}
        for i, m in enumerate(msgs)
    ]


def test_deauth_flood_default_limits(make):
    rows = [{"t": i / 100, "frame_type": "deauth", "bssid": AP, "dst_addr": ALL} for i in range(100)]
    rows += [{"t": 70 + i / 200, "frame_type": "deauth", "bssid": AP, "dst_addr": ALL} for i in range(150)]
    rows += [{"t": i, "frame_type": "deauth", "bssid": AP, "dst_addr": STA} for i in range(30)]
    got = D.deauth_flood(make(rows)).orderBy("t_us").collect()
    assert [(r.frame_count, r.severity) for r in got] == [(20, "MEDIUM"), (20, "MEDIUM")]
    assert got[0].reason_codes == ["DEAUTH_FLOOD", "RATE_10_PER_SEC", "BROADCAST_TARGET"]


def test_disassoc_many_clients_escalate(make):
    rows = [{"t": i / 50, "frame_type": "disassoc", "bssid": AP, "dst_addr": f"02:00:00:00:00:0{i % 4}"} for i in range(400)]
    got = D.disassoc_flood(make(rows)).collect()
    assert len(got) == 4 and {r.severity for r in got} == {"HIGH"} and {r.unique_clients for r in got} == {4}


def test_beacon_flood(make):
    rows = [{"t": i / 10, "frame_type": "beacon", "bssid": f"DE:AD:BE:00:00:{i:02X}", "ssid": f"fake{i:03d}"} for i in range(120)]
    got = D.beacon_flood(make(rows)).collect()
    assert len(got) == 1 and got[0].unique_bssids == 20 and got[0].severity == "HIGH"
    assert len(got[0].sample_ssids.split(",")) == 10


def test_krack(make):
    assert D.krack(make(eapol([1, 2, 3, 4]))).count() == 0
    replay = D.krack(make(eapol([1, 2, 3, 4, 3]))).collect()
    assert [(r.severity, r.attack_subtype) for r in replay] == [("CRITICAL", "m3_replay_after_m4")]
    many = D.krack(make(eapol([1, 2, 3, 3, 3]))).collect()
    assert [(r.severity, r.m3_count) for r in many] == [("HIGH", 3)]
    assert D.krack(make(eapol([1, 2, 3, 4, 1, 2, 3]))).count() == 0


def test_pmkid(make):
    assert D.pmkid(make(eapol([1, 2] * 20))).count() == 0
    orphans = [r | {"t": i / 10} for i, r in enumerate(eapol([1] * 20))]
    got = D.pmkid(make(orphans)).collect()
    assert [(r.severity, r.orphaned_m1) for r in got] == [("HIGH", 15)]
    one = [{"t": i / 100, "frame_type": "auth", "bssid": AP, "src_addr": STA} for i in range(60)]
    assert D.pmkid(make(one)).count() == 0
    many = [{"t": i / 100, "frame_type": "auth", "bssid": AP, "src_addr": f"02:00:00:00:00:{i:02X}"} for i in range(60)]
    assert [r.reason_codes for r in D.pmkid(make(many)).collect()] == [["AUTH_FLOOD_RANDOM_MAC"]]
    both = many + [r | {"t": 0.6 + i / 100} for i, r in enumerate(eapol([1] * 16))]
    assert [r.severity for r in D.pmkid(make(both), cooldown_s=0 or 1).orderBy("t_us").collect()][-1] in ("HIGH", "CRITICAL")


def test_pending_m1_against_a_queue(spark):
    from skyfence.operators.handshake import pending_m1

    r = random.Random(4)
    data = [(i, r.randrange(4000) * 1000, "hot" if r.random() < 0.7 else "b", r.choice([1, 1, 2, 3, None])) for i in range(500)]
    df = spark.createDataFrame(data, "event_id bigint, t_us bigint, bssid string, eapol_message int")
    many = [{x.event_id: x.orphaned_m1 for x in pending_m1(df, 60_000, pack=pack).collect()} for pack in (3, 512)]
    plans = pending_m1(df, 60_000)._jdf.queryExecution().toString()
    assert "Pandas" not in plans and "Arrow" not in plans
    queue = {}
    for e, t, b, m in sorted(data, key=lambda x: (x[1], x[0])):
        q = [x for x in queue.get(b, []) if x >= t - 60_000]
        if m == 1:
            q.append(t)
        elif m == 2:
            q = q[1:]
        queue[b] = q
        assert [got[e] for got in many] == [len(q)] * 2, e


def test_wep(make):
    ad = {"t": 0, "frame_type": "beacon", "bssid": AP, "privacy": True, "security": "WEP"}
    data = [{"t": 1 + i, "frame_type": "data", "bssid": AP, "wep_iv": "abcdef", "frame_len": 500} for i in range(6)]
    got = D.wep_attacks(make([ad, *data])).collect()
    assert sorted(r.hit_count for r in got) == [5, 6] and {r.severity for r in got} == {"CRITICAL"}
    assert D.wep_attacks(make(data)).count() == 0
    small = [{"t": 1 + i / 100, "frame_type": "data", "bssid": AP, "wep_iv": f"{i:06x}", "frame_len": 90} for i in range(80)]
    assert [r.attack_subtype for r in D.wep_attacks(make([ad, *small])).collect()] == ["packet_injection"]


def twins(foreign="Other", security="WPA2"):
    rows = []
    for i in range(0, 100, 5):
        base = {"frame_type": "beacon", "ssid": "Corp", "beacon_interval": 100, "pmf": False, "wps": False}
        rows.append(base | {"t": i, "bssid": AP, "vendor_oui": "AA:BB:CC", "rssi_dbm": -70, "security": "WPA2"})
        if i >= 20:
            rows.append(base | {"t": i + 1, "bssid": "DE:AD:BE:00:00:01", "vendor_oui": foreign, "rssi_dbm": -40, "security": security})
    return rows


def test_evil_twin(make):
    got = D.evil_twin(make(twins("DE:AD:BE", "Open"))).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.original, r.bssid) == (AP, "DE:AD:BE:00:00:01")
    assert {"DUPLICATE_SSID", "VENDOR_MISMATCH", "SECURITY_MISMATCH", "STRONGER_SIGNAL", "NEW_AP"} <= set(r.reason_codes)
    assert r.score == 20 + int(30 * 15 / 20) + 15 + 15 + 5 and r.severity == "HIGH"


def test_single_ap_is_no_twin(make):
    assert D.evil_twin(make([r for r in twins() if r["bssid"] == AP])).count() == 0


def test_karma_and_wardriver_escalate(make):
    ads = [{"t": i, "frame_type": "probe_resp", "bssid": AP, "ssid": f"n{i}"} for i in range(12)]
    assert sorted((r.t_us, r.name_count, r.severity) for r in D.karma(make(ads), escalate=True).collect()) == [(2_000_000, 3, "HIGH"), (4_000_000, 5, "CRITICAL")]
    probes = [{"t": i, "frame_type": "probe_req", "src_addr": STA, "ssid": f"n{i}"} for i in range(30)]
    got = D.wardriver(make(probes), escalate=True).collect()
    assert sorted((r.name_count, r.severity, r.names.count(",") + 1) for r in got) == [(5, "MEDIUM", 5), (10, "HIGH", 10), (15, "CRITICAL", 15)]


def test_karma_and_wardriver_once_per_episode(make):
    ads = [{"t": i, "frame_type": "probe_resp", "bssid": AP, "ssid": f"n{i}"} for i in range(6)]
    later = [r | {"t": r["t"] + 500} for r in ads]
    assert [r.severity for r in D.karma(make(ads + later)).collect()] == ["HIGH", "HIGH"]
    probes = [{"t": i, "frame_type": "probe_req", "src_addr": STA, "ssid": f"n{i}"} for i in range(12)]
    got = D.wardriver(make(probes)).collect()
    assert [(r.attacker, r.name_count, r.severity) for r in got] == [(STA, 5, "MEDIUM")]
    assert D.wardriver(make(probes), ssids=10).collect()[0].severity == "HIGH"


def test_jamming(make):
    rows = [{"t": i / 20, "frame_type": "rts" if i < 60 else "data", "retry": i % 20 != 0, "channel": 6, "rssi_dbm": -70} for i in range(100)]
    got = D.jamming(make(rows)).collect()
    assert [(r.score, r.severity, r.rts_cts_count, r.avg_rssi) for r in got] == [(70, "HIGH", 60, -70.0)]
    assert D.jamming(make(rows[:15])).count() == 0


def test_bursts_do_not_overlap(make):
    rows = [{"t": i / 20, "frame_type": "deauth", "bssid": AP} for i in range(60)]
    got = D.deauth_bursts(make(rows)).orderBy("t_us").collect()
    assert [r.t_us for r in got] == [0, 1_050_000, 2_100_000]


def test_chains(make, spark):
    ddl = "sensor_id string, t_us bigint, event_id bigint, alert_type string, severity string, bssid string, attacker string"
    s = 1_000_000
    data = [
        ("s1", 0, 1, "deauth_flood", "HIGH", AP, None), ("s1", 100 * s, 2, "evil_twin", "CRITICAL", AP, STA),
        ("s1", 399 * s, 3, "karma", "HIGH", AP, None), ("s1", 700 * s, 4, "karma", "HIGH", AP, None), ("s2", 10 * s, 5, "karma", "HIGH", AP, None),
    ]
    got = T.exploit_chains(spark.createDataFrame(data, ddl)).orderBy("t_us").collect()
    assert [(r.event_id, r.alerts, r.severity, r.alert_types) for r in got] == [
        (2, 2, "CRITICAL", "deauth_flood>evil_twin"), (3, 3, "CRITICAL", "deauth_flood>evil_twin>karma"),
    ]


def test_profiles(make):
    assert len(PROFILES["lite_realtime"]) == 7 and len(PROFILES["full_wids"]) == 11
    rows = [{"t": i / 100, "frame_type": "deauth", "bssid": AP, "dst_addr": ALL, "security": "WPA2", "rssi_dbm": -60, "ssid": "x", "beacon_interval": 100} for i in range(60)]
    out = run_detectors(make(rows))
    got = {r.alert_type: r.n for r in out.groupBy("alert_type").agg(F.count("*").alias("n")).collect()}
    assert got["deauth_flood"] == 1 and set(got) <= {"deauth_flood", "rule_match"}
    assert LITE[-1] == "rules"
