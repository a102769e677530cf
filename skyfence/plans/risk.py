"""Feature, scoring, rule, audit, evaluation and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyfence.frames import load_frames
from skyfence.operators import evaluation as E
from skyfence.operators import rules as R
from skyfence.operators import scoring as SC
from skyfence.operators.normalise import enrich_vendor
from skyfence.plans.base import ORACLES, fold_ctes, query, with_frames
from skyfence.plans.ingest import VENDOR_CASE
from skyfence.plans.views import NET, networks

S = 1_000_000


def scored_input(frames):
    """Frames as network records: encryption names, vendor, default-looking names for some."""
    e = F.col("event_id")
    out = enrich_vendor(frames)
    return out.select(
        "event_id", "t_us", "bssid", "sensor_id", "channel", "wps", F.col("wps").alias("wps_enabled"), "vendor",
        F.when(e % 5 == 0, "Free Guest").when(e % 5 == 1, F.lit(None)).when(e % 5 == 2, "Default").otherwise(F.col("ssid")).alias("ssid"),
        F.when((F.col("security") == "WPA2") & (e % 2 == 0), "WPA2-TKIP").otherwise(F.col("security")).alias("encryption"),
        F.col("rssi_dbm").alias("signal"), (F.coalesce(F.col("beacon_interval"), F.lit(100)) * 1024).alias("beacon_interval"),
        F.when(F.col("privacy"), "ESS").otherwise("IBSSX").alias("capabilities"), F.col("pmf").alias("handshake_captured"),
        F.col("t_us").alias("first_seen"), F.when(e % 3 == 0, F.col("t_us")).otherwise(F.col("t_us") + 1).alias("last_seen"),
    )


FEAT = f"""rec as (select event_id, bssid, channel, wps, {VENDOR_CASE} as vendor, pmf, privacy, event_id % 3 = 0 as fresh,
    case event_id % 5 when 0 then 'Free Guest' when 1 then null when 2 then 'Default' else ssid end as ssid,
    case when security = 'WPA2' and event_id % 2 = 0 then 'WPA2-TKIP' else security end as encryption, rssi_dbm as signal, coalesce(beacon_interval, 100) * 1024 as bi from frames),
feat as (select *, case when encryption = 'WPA3' then 0e0 when encryption = 'WPA2-TKIP' then 4e-1 when encryption = 'WPA2' then 2e-1 when encryption = 'WPA' then 5e-1 when encryption = 'WEP' then 9e-1 else 1e0 end as enc_score,
    least(greatest((signal + 1e2) / 5e1, 0e0), 1e0) as rssi_norm, case vendor when 'Unknown' then 5e-1 when 'Cisco' then 0e0 else 3e-1 end as vendor_trust,
    case when event_id % 5 in (0, 2) then 1e0 else 0e0 end as ssid_suspicious, case when ssid is null then 1e0 else 0e0 end as ssid_hidden,
    case when wps then 1e0 else 0e0 end as wps_flag, case when channel in (1, 6, 11) then 0e0 else 1e-1 end as channel_unusual,
    case when abs(bi - 102400) > 1000 then 1e0 else 0e0 end as beacon_anomaly, case when fresh then 5e-1 else 0e0 end as temporal_new,
    case when privacy then 0e0 else 3e-1 end + case when wps then 2e-1 else 0e0 end as privacy_concern from rec)"""
BASE = "enc_score * 4e-1 + rssi_norm * 1e-1 + ssid_suspicious * 1e-1 + ssid_hidden * 0e0 + vendor_trust * 5e-2 + channel_unusual * 0e0 + beacon_anomaly * 0e0 + wps_flag * 2e-1 + temporal_new * 0e0 + case when pmf then 1e0 else 0e0 end * 15e-2 + privacy_concern * 5e-2"
SCORED = FEAT + f""",
sc as (select *, coalesce(ssid = 'Default' or bssid like '00:22%', false) as known, case when event_id % 4 = 0 then 3e-1 else 0e0 end as dev, {BASE} as base from feat),
rs as (select *, known and dev = 0 as trusted, case when known and dev = 0 then 0 else greatest(0, least(100, cast(trunc(least(1e0, base + dev) * case when known then 1e0 else 5e-1 end * 100) as int))) end as risk_score from sc)"""


@query("f01_network_features", with_frames("""
select event_id, enc_score, round(rssi_norm, 9) as rssi_norm, vendor_trust, ssid_suspicious, ssid_hidden, wps_flag, channel_unusual, beacon_anomaly, temporal_new, round(privacy_concern, 9) as privacy_concern from feat""", FEAT))
def f01(spark, sf):
    out = SC.network_features(scored_input(load_frames(spark, sf))).select("event_id", *SC.FEATURES)
    return out.withColumns({"rssi_norm": F.round("rssi_norm", 9), "privacy_concern": F.round("privacy_concern", 9)})


def _scored(spark, sf):
    rec = scored_input(load_frames(spark, sf)).withColumn("deviation", F.when(F.col("event_id") % 4 == 0, 0.3).otherwise(0.0))
    allow = rec.filter("bssid like '00:22%'").select(F.col("bssid").alias("name")).union(spark.range(1).select(F.lit("Default").alias("name")))
    return SC.score_networks(rec, allowlist=allow, deviation="deviation")


DEVIATING = """
fv as (select *, case when event_id % 17 = 0 then 'ZZ:ZZ:ZZ' else vendor_oui end as vo, coalesce(rssi_dbm, -100) as r, row_number() over (partition by sensor_id order by t_us, event_id) as nth from frames where bssid is not null),
pv as (select *, count(*) over w as prior_n, avg(r) over w as a, sqrt(greatest(avg(r * r) over w - (avg(r) over w) * (avg(r) over w), 0)) as sd, first_value(case when vo <> '' then lower(vo) end ignore nulls) over w as kv
  from fv window w as (partition by bssid order by t_us, event_id rows between unbounded preceding and 1 preceding)),
dz as (select event_id, (r - a) / greatest(sd, 5e0) as z, prior_n, coalesce(vo <> '' and not starts_with(kv, lower(vo)) and not starts_with(lower(vo), kv), false) as odd from pv where prior_n >= 5 and nth % 2 = 0),
dv as (select event_id, odd, least(1e0, odd::int + case when prior_n >= 10 and z > 12e-1 then least(1e0, (z - 12e-1) / 2 + 5e-1) else 0e0 end) as d from dz),
"""


@query("b02_deviation_alerts", with_frames("""
select event_id, odd as vendor_mismatch, round(d, 6) as score, risk_score, case when risk_score > 70 then 'HIGH' else 'MEDIUM' end as severity from rs where d > 0""",
    DEVIATING + SCORED.replace("case when event_id % 4 = 0 then 3e-1 else 0e0 end as dev", "d as dev").replace(" as base from feat)", " as base from feat join dv using (event_id))")))
def b02_alerts(spark, sf):
    from skyfence.operators import baselines as B

    frames = load_frames(spark, sf)
    odd = frames.withColumn("vendor_oui", F.when(F.col("event_id") % 17 == 0, "ZZ:ZZ:ZZ").otherwise(F.col("vendor_oui")))
    rec = scored_input(frames)
    allow = rec.filter("bssid like '00:22%'").select(F.col("bssid").alias("name")).union(spark.range(1).select(F.lit("Default").alias("name")))
    out = B.alerts_of_deviations(rec, B.bssid_deviation(odd, 5, 10, sigma=1.2, every=2), allow)
    return out.select("event_id", "vendor_mismatch", F.round("score", 6).alias("score"), "risk_score", "severity")


@query("f02_score_networks", with_frames("""
select event_id, risk_score, case when trusted then 'Trusted' when risk_score >= 70 then 'High' when risk_score >= 40 then 'Medium' else 'Low' end as risk_level,
  case when trusted then 1e0 else least(1e0, round((cast(enc_score <> 5e-1 as int) + cast(rssi_norm <> 5e-1 as int) + cast(vendor_trust <> 5e-1 as int) + cast(temporal_new <> 5e-1 as int) + cast(privacy_concern <> 5e-1 as int) + 5) / 5e0, 2)) end as confidence,
  case when trusted then '' else concat_ws('|', case when enc_score > 5e-1 then 'Weak Encryption (' || encryption || ')' end, case when ssid_suspicious > 5e-1 then 'Suspicious SSID Pattern' end, case when beacon_anomaly > 5e-1 then 'Beacon Anomaly Detected' end) end as factors,
  case when not trusted then round(enc_score * 4e-1 * 100, 1) end as encryption_points
from rs""", SCORED))
def f02(spark, sf):
    out = _scored(spark, sf)
    enc = F.filter("explain", lambda e: e["weight"] == "encryption")
    return out.select("event_id", "risk_score", "risk_level", "confidence", F.array_join("contributing_factors", "|").alias("factors"), F.get(enc, F.lit(0))["points"].alias("encryption_points"))


@query("f03_ml_features", with_frames("""
select event_id, cast(rssi_dbm as double) as rssi_dbm, cast(channel as double) as channel, case when privacy then 0e0 else 1e0 end as enc_open, 0e0 as enc_wep,
  case when privacy and not pmf then 1e0 else 0e0 end as enc_wpa2, case when privacy and pmf then 1e0 else 0e0 end as enc_wpa3,
  case when coalesce(ssid, '') = '' then 1e0 else 0e0 end as is_hidden, case when wps then 1e0 else 0e0 end as wps_enabled from frames"""))
def f03(spark, sf):
    return SC.ml_features(load_frames(spark, sf)).select("event_id", *SC.ML_FEATURES)


def findings(frames, *also):
    """Findings with confidence from the level and a reason from the frame type."""
    t = F.col("frame_type")
    reason = F.when(t == "deauth", F.array(F.lit("DEAUTH_FLOOD"))).when(t == "beacon", F.array(F.lit("SSID_SPOOFING"))).when(
        t == "auth", F.array(F.lit("SECURITY_DOWNGRADE"))).otherwise(F.array().cast("array<string>"))
    return frames.select(
        "event_id", "t_us", "sensor_id", "bssid", F.concat(F.lit("det-"), t).alias("detector_id"), F.concat(F.lit("ap|"), "bssid").alias("entity_key"),
        ((F.col("rssi_dbm") + 110) / 80.0).alias("confidence_raw"), reason.alias("reason_codes"), *also,
    )


FIND = """fd as (select event_id, t_us, sensor_id, bssid, 'det-' || frame_type as detector_id, 'ap|' || bssid as entity_key, (rssi_dbm + 110) / 8e1 as confidence_raw,
  case frame_type when 'deauth' then 'DEAUTH_FLOOD' when 'beacon' then 'SSID_SPOOFING' when 'auth' then 'SECURITY_DOWNGRADE' end as reason,
  case frame_type when 'beacon' then 9e1 when 'auth' then 4e1 else 5e1 end as impact from frames),
fs as (select *, least(1e0, confidence_raw) * impact as risk_score from fd),
fx as (select *, case when risk_score > 80 then 'critical' when risk_score > 60 then 'high' when risk_score > 30 then 'medium' else 'low' end as severity,
  sha256(detector_id || '|' || entity_key || '|' || coalesce(reason, 'UNKNOWN')) as fingerprint from fs)"""


@query("f04_score_findings", with_frames("select event_id, impact, round(risk_score, 9) as risk_score, severity from fx", FIND))
def f04(spark, sf):
    return SC.score_findings(findings(load_frames(spark, sf))).select("event_id", "impact", F.round("risk_score", 9).alias("risk_score"), "severity")


@query("f05_recommend", with_frames("""
select event_id, (case when encryption = 'Open' or enc_score > 8e-1 then 1 when encryption = 'WPA' then 1 else 0 end) + cast(wps as int) + cast(ssid_suspicious > 0 as int)
  + cast(rssi_norm > 9e-1 and risk_score > 70 as int) + cast(risk_score > 50 as int) as advice_count,
  case when encryption = 'Open' or enc_score > 8e-1 then 'Critical: open network, use a VPN for all traffic' when encryption = 'WPA' then 'Medium: WPA1 is deprecated, upgrade to WPA2'
    when wps then 'Hardening: disable WPS' when ssid_suspicious > 0 then 'Hardening: change the default network name'
    when rssi_norm > 9e-1 and risk_score > 70 then 'Physical: high-risk access point close by' when risk_score > 80 then 'Action: full security audit of this network' when risk_score > 50 then 'Action: monitor for suspicious clients' end as first_advice
from rs""", SCORED))
def f05(spark, sf):
    out = SC.recommend(_scored(spark, sf))
    return out.select("event_id", F.size("recommendations").alias("advice_count"), F.get("recommendations", F.lit(0)).alias("first_advice"))


RULE_SQL = {
    "WIDS-001": "security = 'Open'", "WIDS-002": "security like '%WEP%'", "WIDS-003": "wps",
    "WIDS-004": "security = 'Open' and regexp_matches(coalesce(name, ''), '(?i)(free|guest|xfinity|starbucks|mcdonalds|airport|hotel)')",
    "WIDS-005": "rssi_dbm >= -30", "WIDS-006": "name is null", "WIDS-007": "regexp_matches(coalesce(name, ''), '^(linksys|netgear|dlink|tplink|asus|belkin|default|setup|router)[_-]?')",
    "WIDS-008": "regexp_matches(bssid, '^[0-9A-Fa-f][26AaEe]:')", "WIDS-009": "security in ('WPA2', 'WPA3') and not pmf",
    "WIDS-010": "beacon_interval is null or beacon_interval not in (100, 102, 103)",
}
RULE_COOL = {r[0]: r[7] for r in R.CORE_RULES}


def ruled(frames):
    e = F.col("event_id")
    return frames.withColumns({
        "ssid": F.when(e % 6 == 0, "hotel lobby").when(e % 6 == 1, "linksys_7").otherwise(F.col("ssid")),
        "capabilities": F.struct("wps", "pmf", "privacy"), "beacon_interval_ms": F.col("beacon_interval"),
    }).drop("wps", "pmf")


NAMED = "nm as (select *, case event_id % 6 when 0 then 'hotel lobby' when 1 then 'linksys_7' else ssid end as name from frames)"


@query("d11_rule_matches", with_frames(" union all ".join(f"select event_id, '{k}' as rule_id from nm where {v}" for k, v in RULE_SQL.items()), NAMED))
def d11(spark, sf):
    return R.apply_rules(ruled(load_frames(spark, sf)), cool=False).select("event_id", "rule_id")


@query("d11_rules_from_file", ORACLES["d11_rule_matches"])
def d11_file(spark, sf):
    import json

    from skyfence.session import shared_dir

    path = shared_dir(spark, "rules")
    text = json.dumps({"rules": R.as_rules(R.CORE_RULES)})
    spark.range(1).select(F.lit(text).alias("value")).write.text(path)
    return R.apply_rules(ruled(load_frames(spark, sf)), R.load_rules(path, spark), cool=False).select("event_id", "rule_id")


@query("d11_apply_rules", with_frames("select event_id, t_us, sensor_id, rule_id from kept", NAMED + ",\n" + """
hit as (""" + " union all ".join(f"select event_id, t_us, sensor_id, '{k}' as rule_id, {RULE_COOL[k] * S // 60} as cool from nm where {v}" for k, v in RULE_SQL.items()) + """),
fold as (select sensor_id, rule_id, cool, min(t_us) as t from hit group by all
  union all select f.sensor_id, f.rule_id, f.cool, min(h.t_us) from fold f join hit h on h.sensor_id = f.sensor_id and h.rule_id = f.rule_id and h.t_us >= f.t + f.cool group by f.sensor_id, f.rule_id, f.cool, f.t),
kept as (select h.* from hit h join fold f on h.sensor_id = f.sensor_id and h.rule_id = f.rule_id and h.t_us = f.t)""", recursive=True))
def d11b(spark, sf):
    rules = [r | {"cooldown_seconds": r["cooldown_seconds"] / 60} for r in R.as_rules(R.CORE_RULES)]
    return R.apply_rules(ruled(load_frames(spark, sf)), rules).select("event_id", "t_us", "sensor_id", "rule_id")


def audited(frames):
    s = F.col("security")
    return networks(frames).select(
        "bssid", "ssid", "channel", "security", "privacy", "wps",
        F.when(s == "WPA", F.array(F.lit("TKIP"))).when(s.isin("WPA2", "WPA3"), F.array(F.lit("CCMP"))).otherwise(F.array().cast("array<string>")).alias("pairwise"),
        F.when(s == "WPA3", F.array(F.lit("802.1X"))).otherwise(F.array(F.lit("PSK"))).alias("akm"),
    )


@query("d17_audit_home", with_frames("""
select bssid, 'HOME-001' as finding_id, case when security in ('Open', 'WEP') then 'Critical' else 'High' end as severity, case when security in ('Open', 'WEP') then 90 else 70 end as score from net where not privacy or security = 'WPA'
union all select bssid, 'HOME-002', 'High', 70 from net where wps
union all select bssid, 'HOME-004', 'Low', 10 from net where coalesce(ssid, '') = ''
union all select bssid, 'HOME-008', 'Low', 10 from net n where (select count(*) from net m where m.channel = n.channel) > 1
union all select bssid, 'WIFI-001', 'High', 70 from net where security = 'Open'
union all select bssid, 'WIFI-002', 'Critical', 90 from net where security = 'WEP'""", NET))
def d17(spark, sf):
    return R.audit(audited(load_frames(spark, sf)), "home").select("bssid", "finding_id", "severity", "score")


@query("d17_audit_sme", with_frames("""
select bssid, 'SME-001' as finding_id from net where security <> 'WPA3'
union all select bssid, 'SME-003' from net where security = 'WPA'
union all select bssid, 'SME-004' from net n where (select count(distinct bssid) from net m where m.ssid = n.ssid) > 1
union all select bssid, 'SME-005' from net where bssid not like '00:22%'
union all select bssid, 'WIFI-001' from net where security = 'Open' union all select bssid, 'WIFI-002' from net where security = 'WEP'""", NET))
def d17b(spark, sf):
    nets = audited(load_frames(spark, sf))
    return R.audit(nets, "sme", nets.filter("bssid like '00:22%'")).select("bssid", "finding_id")


@query("d17_evidence", with_frames("""
select bssid, 'HOME-001' as finding_id, 'Open' as status, concat_ws('; ', case when not privacy then 'Open network: ' || coalesce(ssid, '') end, case when security = 'WPA' then 'TKIP cipher: [''TKIP'']' end) as evidence_summary from net where not privacy or security = 'WPA'
union all select bssid, 'HOME-002', 'Open', 'WPS enabled in beacon' from net where wps
union all select bssid, 'HOME-004', 'Open', 'Hidden SSID broadcast' from net where coalesce(ssid, '') = ''
union all select bssid, 'HOME-008', 'Open', 'Other networks on channel ' || channel from net n where (select count(*) from net m where m.channel = n.channel) > 1
union all select bssid, 'WIFI-001', 'Open', 'Security: Open' from net where security = 'Open'
union all select bssid, 'WIFI-002', 'Open', 'Security: WEP' from net where security = 'WEP'
union all select bssid, 'SME-001', 'Open', 'Key management: PSK' from net where security <> 'WPA3'
union all select bssid, 'SME-003', 'Open', 'TKIP cipher: [''TKIP'']' from net where security = 'WPA'
union all select bssid, 'SME-004', 'Open', 'Other senders of the name ' || ssid from net n where (select count(distinct bssid) from net m where m.ssid = n.ssid) > 1
union all select bssid, 'SME-005', 'Open', 'Not in the inventory: ' || bssid from net where bssid not like '00:22%'""", NET))
def d17c(spark, sf):
    """Findings of both checklists with their evidence; the encryption policies, which both hold, once."""
    nets = audited(load_frames(spark, sf))
    sme = R.audit(nets, "sme", nets.filter("bssid like '00:22%'")).filter("finding_id like 'SME%'")
    return R.audit(nets, "home").unionByName(sme).select("bssid", "finding_id", "status", "evidence_summary")


@query("e01_set_recall", with_frames("""
select tp as true_positives, fp as false_positives, fn as false_negatives, round(tp / cast(tp + fp as double), 4) as precision, round(tp / cast(tp + fn as double), 4) as recall,
  round(2 * tp / cast(2 * tp + fp + fn as double), 4) as f1_score,
  (select string_agg(x, ',' order by x) from (select x from (select distinct bssid as x from t except select distinct bssid from f) order by x limit 10)) as missed_sample,
  (select string_agg(x, ',' order by x) from (select x from (select distinct bssid as x from f except select distinct bssid from t) order by x limit 10)) as extra_sample
from (select (select count(*) from (select bssid from t intersect select bssid from f)) as tp, (select count(*) from (select bssid from f except select bssid from t)) as fp,
        (select count(*) from (select bssid from t except select bssid from f)) as fn)""",
    "t as (select distinct bssid from frames where bssid not like '%0'), f as (select distinct bssid from frames where vendor_oui <> '14:CF:E2')"))
def e01(spark, sf):
    f = load_frames(spark, sf)
    return E.set_recall(f.filter("bssid not like '%0'").select("bssid"), f.filter("vendor_oui <> '14:CF:E2'").select("bssid"))


@query("e02_confusion", with_frames("""
select sensor_id, n as total_samples, tp as true_positives, fp as false_positives, tn as true_negatives, fn as false_negatives, round(tp / cast(tp + fp as double), 4) as precision,
  round(tp / cast(tp + fn as double), 4) as recall, round(2 * tp / cast(2 * tp + fp + fn as double), 4) as f1_score, round(fp / cast(fp + tn as double), 4) as false_positive_rate, round((tp + tn) / cast(n as double), 4) as accuracy
from (select sensor_id, count(*) as n, count(*) filter (y and z) as tp, count(*) filter (not y and z) as fp, count(*) filter (not y and not z) as tn, count(*) filter (y and not z) as fn
  from (select sensor_id, frame_type in ('deauth', 'disassoc') as y, rssi_dbm > -60 as z from frames) group by all)"""))
def e02(spark, sf):
    f = load_frames(spark, sf).select("sensor_id", F.col("frame_type").isin("deauth", "disassoc").alias("y"), (F.col("rssi_dbm") > -60).alias("z"))
    return E.confusion(f, "y", "z", ("sensor_id",))


@query("e02_mttd", with_frames("""
select attack_id, a.bssid, start_us, min(f.t_us) as first_alert, (min(f.t_us) - start_us) / 1e6 as detect_s
from (select event_id as attack_id, bssid, t_us as start_us from frames where frame_type = 'rts') a
left join (select bssid, t_us from frames where frame_type = 'deauth') f on f.bssid = a.bssid and f.t_us between start_us and start_us + 60000000 group by attack_id, a.bssid, start_us"""))
def e02b(spark, sf):
    f = load_frames(spark, sf)
    attacks = f.filter("frame_type = 'rts'").select(F.col("event_id").alias("attack_id"), "bssid", F.col("t_us").alias("start_us"), (F.col("t_us") + 60 * S).alias("end_us"))
    return E.mttd(f.filter("frame_type = 'deauth'"), attacks).select("attack_id", "bssid", "start_us", "first_alert", "detect_s")


CANDIDATES = [
    {"encryption": a / 100, "rssi_norm": b / 100, "vendor_risk": 0.05, "ssid_suspicion": 0.1, "wps_flag": (85 - a - b) / 100}
    for a in (20, 40, 60, 80) for b in (0, 5)
]
CAND_SQL = " union all ".join(
    f"select {i} as candidate, {c['encryption']}::double as we, {c['rssi_norm']}::double as wr, {c['wps_flag']}::double as ww" for i, c in enumerate(CANDIDATES)
)


@query("e03_weight_metrics", with_frames("""
select candidate, tp, fp, fn, tn, round(case when 2 * tp + fp + fn > 0 then 2 * tp / cast(2 * tp + fp + fn as double) else 0 end, 9) as f1_score
from (select candidate, count(*) filter (y and z) as tp, count(*) filter (not y and z) as fp, count(*) filter (y and not z) as fn, count(*) filter (not y and not z) as tn
  from (select candidate, event_id % 5 = 0 as y, cast(trunc(least(1e0, enc_score * we + rssi_norm * wr + ssid_suspicious * 1e-1 + ssid_hidden * 0e0 + vendor_trust * 5e-2 + channel_unusual * 0e0 + beacon_anomaly * 0e0 + wps_flag * ww + temporal_new * 0e0 + privacy_concern * 5e-2) * 5e-1 * 100) as int) >= 30 as z from feat, cand) group by candidate)""",
    FEAT + f",\ncand as ({CAND_SQL})"))
def e03(spark, sf):
    rec = scored_input(load_frames(spark, sf)).withColumn("malicious", F.col("event_id") % 5 == 0)
    return E.weight_metrics(rec, CANDIDATES, 30).select("candidate", "tp", "fp", "fn", "tn", F.round("f1_score", 9).alias("f1_score"))


KEYS = ("encryption", "rssi_norm", "vendor_risk", "ssid_suspicion", "wps_flag")
DRAWN = ", ".join(f"-ln((('0x' || substr(md5('42/' || i || '/{k}'), 1, 12))::bigint::double + 0.5e0) / 281474976710656e0) as {k}" for k in KEYS)


@query("e03_tune_weights", with_frames("""
select candidate, p as "precision", r as recall, case when p + r > 0 then 2 * p * r / (p + r) else 0e0 end as f1_score
from (select candidate, case when tp + fp > 0 then tp / cast(tp + fp as double) else 0e0 end as p, case when tp + fn > 0 then tp / cast(tp + fn as double) else 0e0 end as r
  from (select candidate, count(*) filter (y and z) as tp, count(*) filter (not y and z) as fp, count(*) filter (y and not z) as fn
    from (select candidate, event_id % 5 = 0 as y, cast(trunc(least(1e0, enc_score * w1 + rssi_norm * w2 + ssid_suspicious * w4 + ssid_hidden * 0e0 + vendor_trust * w3 + channel_unusual * 0e0 + beacon_anomaly * 0e0 + wps_flag * w5 + temporal_new * 0e0 + privacy_concern * 5e-2) * 5e-1 * 100) as int) >= 30 as z from feat, cand) group by candidate))
order by f1_score desc, candidate limit 1""", FEAT + f""",
drawn as (select i, {DRAWN} from range(50) r(i)),
cand as (select i as candidate, round(encryption / t, 2) as w1, round(rssi_norm / t, 2) as w2, round(vendor_risk / t, 2) as w3, round(ssid_suspicion / t, 2) as w4, round(wps_flag / t, 2) as w5
  from (select *, 0e0 + encryption + rssi_norm + vendor_risk + ssid_suspicion + wps_flag as t from drawn))"""))
def e03b(spark, sf):
    rec = scored_input(load_frames(spark, sf)).withColumn("malicious", F.col("event_id") % 5 == 0)
    vectors = [r.asDict() for r in E.candidate_weights(spark, 50).drop("candidate").collect()]
    return E.tune_weights(rec, vectors, 30).select("candidate", "precision", "recall", "f1_score")


@query("e04_risk_model")
def e04(spark, sf):
    rows = SC.ml_features(load_frames(spark, sf)).withColumn("label", F.when(F.col("security").isin("Open", "WEP") & (F.col("event_id") % 10 > 0), "HIGH").otherwise("LOW"))
    model, mean, spread = E.train_risk_model(rows, SC.ML_FEATURES, key="event_id")
    out = E.predict_risk(rows, model, SC.ML_FEATURES)
    return out.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("probability"), 3).alias("mean_probability")).withColumn("auc_cv", F.lit(mean)).withColumn("auc_std", F.lit(spread))


RISK = {"features": list(SC.ML_FEATURES), "coefficients": [0.02, -0.03, 2.5, 1.5, -0.75, -1.25, 0.5, 0.25], "intercept": 0.4}


@query("e04_risk_scores", with_frames("""
select event_id, cast(trunc(p * 100) as int) as score, round(p, 3) as probability from (select event_id, 1 / (1 + exp(-(4e-1 + 2e-2 * rssi_dbm - 3e-2 * channel
  + 25e-1 * cast(not privacy as int) - 75e-2 * cast(privacy and not pmf as int) - 125e-2 * cast(privacy and pmf as int)
  + 5e-1 * cast(coalesce(ssid, '') = '' as int) + 25e-2 * cast(wps as int)))) as p from frames)"""))
def e04_scores(spark, sf):
    return E.predict_risk(SC.ml_features(load_frames(spark, sf)), RISK).select("event_id", "score", "probability")


AXES = {"mean": [i / 20 for i in range(len(SC.FEATURES))], "axes": [[((i * 7 + j * 3) % 5 - 2) / 5 for j in range(2)] for i in range(len(SC.FEATURES))], "features": list(SC.FEATURES)}
_X = [f"({f} - {m!r}::double)" for f, m in zip(AXES["features"], AXES["mean"])]
_H = [" + ".join(f"{x} * {a[j]!r}::double" for x, a in zip(_X, AXES["axes"])) for j in range(2)]
_LOSS = " + ".join(f"power({x} - (h0 * {a[0]!r}::double + h1 * {a[1]!r}::double), 2)" for x, a in zip(_X, AXES["axes"]))


@query("e05_anomaly_scores", with_frames(f"""
select event_id, round(loss, 9) as anomaly_loss, loss > 2e-1 as is_anomaly from (select event_id, ({_LOSS}) / {len(SC.FEATURES)} as loss from (select *, {_H[0]} as h0, {_H[1]} as h1 from feat))""", FEAT))
def e05_scores(spark, sf):
    feats = SC.network_features(scored_input(load_frames(spark, sf)))
    return E.score_anomaly(feats, AXES, 0.2).select("event_id", F.round("anomaly_loss", 9).alias("anomaly_loss"), "is_anomaly")


@query("e05_anomaly_model")
def e05(spark, sf):
    feats = SC.network_features(scored_input(load_frames(spark, sf)))
    model = E.fit_anomaly(feats.filter(F.col("encryption").startswith("WPA")))
    scored = E.score_anomaly(feats, model)
    risk = SC.score_networks(scored.drop(*SC.FEATURES), anomaly="is_anomaly")
    return risk.groupBy("encryption", "is_anomaly").agg(F.count("*").alias("n"), F.max("risk_score").alias("max_risk"))
