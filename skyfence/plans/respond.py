"""Triage, chain, report, profile and geolocation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyfence.frames import duck_frames, load_frames
from skyfence.operators import detector_set as DS
from skyfence.operators import geo as G
from skyfence.operators import rules as R
from skyfence.operators import scoring as SC
from skyfence.operators import tracks as TR
from skyfence.operators import triage as T
from skyfence.plans import detect  # noqa: F401  (its SQL is reused)
from skyfence.plans.base import ORACLES, fold_ctes, query, with_frames
from skyfence.plans.risk import FIND, RULE_COOL, RULE_SQL, audited, findings
from skyfence.plans.ingest import captured
from skyfence.plans.views import NET, simple_alerts
from skyfence.session import shared_dir

S = 1_000_000


def scored_findings(spark, sf):
    return SC.score_findings(findings(load_frames(spark, sf)))


@query("t01_fingerprint", with_frames("select event_id, fingerprint from fx", FIND))
def t01(spark, sf):
    return T.with_fingerprint(findings(load_frames(spark, sf))).select("event_id", "fingerprint")


@query("t02_triage", with_frames("""
select event_id, fingerprint, case when before is null then 'new' when risk_score > before then 'escalated' else 'recurring' end as emit_reason from em where emitted""", FIND + """,
o as (select *, row_number() over (partition by fingerprint order by t_us, event_id) as rn,
  max(risk_score) over (partition by fingerprint order by t_us, event_id rows between unbounded preceding and 1 preceding) as before from fx),
em as (select event_id, fingerprint, rn, before, risk_score, true as emitted, t_us as last from o where rn = 1
  union all select o.event_id, o.fingerprint, o.rn, o.before, o.risk_score, o.risk_score > o.before or o.t_us - em.last >= 300000000,
    case when o.risk_score > o.before or o.t_us - em.last >= 300000000 then o.t_us else em.last end from em join o on o.fingerprint = em.fingerprint and o.rn = em.rn + 1)""", recursive=True))
def t02(spark, sf):
    return T.triage(scored_findings(spark, sf), 300).select("event_id", "fingerprint", "emit_reason")


ALERTS = """al as (select event_id, t_us, sensor_id, bssid, dst_addr as attacker, frame_type || '_flood' as alert_type, case when rssi_dbm > -50 then 'HIGH' else 'LOW' end as severity, frame_type || ' seen' as title
  from frames where frame_type in ('deauth', 'disassoc'))"""


@query("t03_suppress_duplicates", with_frames("select event_id, t_us, alert_type, severity, bssid from kept", ALERTS + ",\n" + fold_ctes("select * from al", "alert_type, severity, bssid, title", 600 * S), recursive=True))
def t03(spark, sf):
    return T.suppress_duplicates(simple_alerts(load_frames(spark, sf))).select("event_id", "t_us", "alert_type", "severity", "bssid")


@query("t04_event_states", with_frames("""
select fingerprint, min(t_us) as first_seen, max(t_us) as last_seen, count(*) as count, round(max(risk_score), 9) as max_risk_score,
  arg_max(severity, (risk_score, -t_us, -event_id)) as max_severity from fx group by fingerprint""", FIND))
def t04(spark, sf):
    return T.event_states(scored_findings(spark, sf)).withColumn("max_risk_score", F.round("max_risk_score", 9))


@query("t05_report_summary", with_frames("""
select count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'high') as high, count(*) filter (severity = 'medium') as medium, count(*) filter (severity = 'low') as low,
  0 as info, count(*) as findings, count(distinct sensor_id) as sensors, count(distinct bssid) as networks from fx""", FIND))
def t05(spark, sf):
    f = load_frames(spark, sf)
    return T.report_summary(SC.score_findings(findings(f)), f)


@query("t06_action_plan", with_frames("""
select * from (values ('802.1X Enterprise Authentication', 'Critical', 'Within 4 weeks'), ('Duplicate SSID Detected', 'Critical', 'Immediate'), ('WEP Encryption Detected', 'Critical', 'Immediate'),
  ('TKIP Cipher Enabled', 'High', 'Within 3 days'), ('Open Network Detected', 'High', 'Immediate'), ('Unknown BSSID in Zone', 'High', 'Within 3 days')) v(title, priority, due)
where (title <> 'WEP Encryption Detected' or exists (select 1 from net where security = 'WEP')) and (title <> 'TKIP Cipher Enabled' or exists (select 1 from net where security = 'WPA'))
  and (title <> 'Open Network Detected' or exists (select 1 from net where security = 'Open')) and (title <> 'Duplicate SSID Detected' or exists (select 1 from net group by ssid having count(*) > 1 and ssid is not null))""", NET))
def t06(spark, sf):
    nets = audited(load_frames(spark, sf))
    return T.action_plan(R.audit(nets, "sme", nets.filter("bssid like '00:22%'"))).select("title", "priority", "due")


@query("d12_exploit_chains", with_frames("""
select sensor_id, t_us, event_id, hit['first'] as chain_start, hit['event'] as chain_event, hit['n'] as alerts, case when hit['crit'] then 'CRITICAL' else 'HIGH' end as severity,
  hit['bssid'] as target_bssid, hit['attacker'] as attacker from ch where hit is not null""", ALERTS.replace("'HIGH' else 'LOW'", "'CRITICAL' else 'LOW'") + """,
o as (select *, row_number() over (partition by sensor_id order by t_us, event_id) as rn from al),
ch as (
  select sensor_id, rn, t_us, event_id, [{'bssid': bssid, 'attacker': attacker, 'first': t_us, 'last': t_us, 'event': event_id, 'n': 1, 'crit': severity = 'CRITICAL'}] as live,
    cast(null as struct(bssid varchar, attacker varchar, "first" bigint, "last" bigint, "event" bigint, n int, crit boolean)) as hit from o where rn = 1
  union all
  select s.sensor_id, s.rn, s.t_us, s.event_id,
    case when s.pos is null then list_append(s.alive, {'bssid': s.bssid, 'attacker': s.attacker, 'first': s.t_us, 'last': s.t_us, 'event': s.event_id, 'n': 1, 'crit': s.severity = 'CRITICAL'})
      else list_concat(list_concat(s.alive[:s.pos - 1], [{'bssid': s.alive[s.pos]['bssid'], 'attacker': s.alive[s.pos]['attacker'], 'first': s.alive[s.pos]['first'], 'last': s.t_us, 'event': s.alive[s.pos]['event'], 'n': s.alive[s.pos]['n'] + 1, 'crit': s.alive[s.pos]['crit'] or s.severity = 'CRITICAL'}]), s.alive[s.pos + 1:]) end,
    case when s.pos is not null then {'bssid': s.alive[s.pos]['bssid'], 'attacker': s.alive[s.pos]['attacker'], 'first': s.alive[s.pos]['first'], 'last': s.t_us, 'event': s.alive[s.pos]['event'], 'n': s.alive[s.pos]['n'] + 1, 'crit': s.alive[s.pos]['crit'] or s.severity = 'CRITICAL'} end
  from (select a.*, list_position(list_transform(a.alive, lambda c: c['bssid'] = a.bssid or c['attacker'] = a.attacker), true) as pos
        from (select o.*, list_filter(ch.live, lambda c: c['last'] > o.t_us - 20000000) as alive from ch join o on o.sensor_id = ch.sensor_id and o.rn = ch.rn + 1) a) s)""", recursive=True))
def d12(spark, sf):
    alerts = simple_alerts(load_frames(spark, sf)).withColumn("severity", F.when(F.col("severity") == "HIGH", "CRITICAL").otherwise("LOW"))
    return T.exploit_chains(alerts, 20).select("sensor_id", "t_us", "event_id", "chain_start", "chain_event", "alerts", "severity", "target_bssid", "attacker")


@query("d12_entity_chains", with_frames("""
select sensor_id, bssid, min(t_us) as episode, count(*) as alerts, max(t_us) as last_seen, string_agg(distinct alert_type, ',' order by alert_type) as alert_types
from (select *, sum(fresh) over (partition by sensor_id, bssid order by t_us, event_id rows unbounded preceding) as ep
  from (select *, case when t_us - lag(t_us) over (partition by sensor_id, bssid order by t_us, event_id) <= 100000000 then 0 else 1 end as fresh from al))
group by sensor_id, bssid, ep having count(*) > 1""", ALERTS))
def d12b(spark, sf):
    out = T.entity_chains(simple_alerts(load_frames(spark, sf)), 100)
    return out.select("sensor_id", "bssid", "episode", "alerts", "last_seen", F.array_join("alert_types", ",").alias("alert_types"))


SCALED = {
    "deauth_flood": {"rate": 3 / 60, "window_s": 60}, "disassoc_flood": {"rate": 2 / 300, "window_s": 300}, "beacon_flood": {"ssids": 8},
    "krack": {"window_s": 300}, "pmkid": {"m1_limit": 2, "m1_window_s": 120, "auth_limit": 3, "auth_window_s": 120, "min_sources": 2},
    "wep_iv": {"iv_limit": 2, "inject_limit": 3, "window_s": 600, "rearm": 10}, "jamming": {"window_s": 60, "min_frames": 10, "rts_limit": 0, "high": 30},
}


# Plain frames have no capability struct and no beacon_interval_ms: rules on them see missing values.
PLAIN_RULES = {k: v for k, v in RULE_SQL.items() if k not in ("WIDS-003", "WIDS-009", "WIDS-010")} | {"WIDS-010": "true"}
RULE_LEVEL = {r[0]: r[2].upper() for r in R.CORE_RULES}
PLAIN_RULE_SQL = with_frames("select severity, h.t_us from hit h join fold f on h.sensor_id = f.sensor_id and h.rule_id = f.rule_id and h.t_us = f.t", """
nm as (select *, ssid as name from frames),
hit as (""" + " union all ".join(f"select t_us, sensor_id, '{k}' as rule_id, '{RULE_LEVEL[k]}' as severity, {RULE_COOL[k] * S} as cool from nm where {v}" for k, v in PLAIN_RULES.items()) + """),
fold as (select sensor_id, rule_id, cool, min(t_us) as t from hit group by all
  union all select f.sensor_id, f.rule_id, f.cool, min(h.t_us) from fold f join hit h on h.sensor_id = f.sensor_id and h.rule_id = f.rule_id and h.t_us >= f.t + f.cool group by f.sensor_id, f.rule_id, f.cool, f.t)""", recursive=True)
PARTS = {
    "deauth_flood": "d01_deauth_flood", "disassoc_flood": "d02_disassoc_flood", "beacon_flood": "d03_beacon_flood", "krack_attack": "d04_krack",
    "pmkid_harvesting": "d05_pmkid", "wep_attack": "d06_wep_attacks", "evil_twin": "d07_evil_twin", "karma_attack": "d08_karma", "wardrive_detected": "d10_wardriver",
}


@query("d18_run_detectors", "select alert_type, severity, count(*) as alerts, min(t_us) as first_us, max(t_us) as last_us from ("
    + " union all ".join(f"select '{kind}' as alert_type, severity, t_us from ({ORACLES[name]})" for kind, name in PARTS.items())
    + f" union all select 'jamming_detected', 'HIGH', t_us from ({ORACLES['d09_jamming']}) union all select 'rule_match', severity, t_us from ({PLAIN_RULE_SQL})) group by alert_type, severity")
def d18(spark, sf):
    out = DS.run_detectors(load_frames(spark, sf), "full_wids", SCALED)
    return out.groupBy("alert_type", "severity").agg(F.count("*").alias("alerts"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"))


# The rules' SQL over what a capture holds of each frame.
PLAIN = f"frames as ({duck_frames()})"
CAPTURED_FRAMES = ORACLES["s06_capture_frames"].split(PLAIN, 1)[1].replace("from frames", "from frames0")
CAPTURED_RULE_SQL = PLAIN_RULE_SQL.replace(PLAIN, f"{PLAIN.replace('frames as', 'frames0 as', 1)},\nframes as ({CAPTURED_FRAMES})")
LIVE_PARTS = {k: v for k, v in PARTS.items() if v.split("_")[0] in ("d01", "d02", "d03", "d04", "d05", "d06")}


@query("p01_captures_to_alerts", "select alert_type, severity, count(*) as alerts, min(t_us) as first_us, max(t_us) as last_us from ("
    + " union all ".join(f"select '{kind}' as alert_type, severity, t_us from ({ORACLES[name]})" for kind, name in LIVE_PARTS.items())
    + f" union all select 'rule_match', severity, t_us from ({CAPTURED_RULE_SQL})) group by alert_type, severity")
def p01(spark, sf):
    """Capture files to a written frame table, laid out by frame type, to the live profile's alerts."""
    path = shared_dir(spark, "captured")
    captured(spark, sf).write.partitionBy("frame_type").parquet(path)
    out = DS.run_detectors(spark.read.parquet(path), "lite_realtime", {k: v for k, v in SCALED.items() if k in DS.LITE})
    return out.groupBy("alert_type", "severity").agg(F.count("*").alias("alerts"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"))


@query("d18_own_detector", with_frames("select 'loud_probe' as alert_type, 'LOW' as severity, sensor_id, event_id from frames where frame_type = 'probe_req' and rssi_dbm > -35"))
def d18b(spark, sf):
    def loud(frames, level=-35):
        return frames.filter(F.col("rssi_dbm") > level).select(F.lit("loud_probe").alias("alert_type"), F.lit("LOW").alias("severity"), "sensor_id", "event_id", "t_us")

    return DS.run_detectors(load_frames(spark, sf), ["loud_probe"], more={"loud_probe": (loud, ("probe_req",), ())}).select("alert_type", "severity", "sensor_id", "event_id")


PLACES = [("sensor-0", 0.0, 0.0), ("sensor-1", 20.0, 0.0), ("sensor-2", 10.0, 17.3), ("sensor-3", 20.0, 20.0)]
ORIGIN = (10.776889, 106.700806)
PLACE_SQL = " union all ".join(f"select '{s}' as sensor_id, {x}::double as x, {y}::double as y" for s, x, y in PLACES)


def places(spark):
    return spark.createDataFrame(PLACES, "sensor_id string, x double, y double")


def readings(spark, sf, window_s=300):
    return G.latest_readings(load_frames(spark, sf), places(spark), window_s=window_s)


READ = f"""pl as ({PLACE_SQL}),
lr as (select bssid, sensor_id, cast(rssi_dbm as double) as rssi, frequency_mhz, t_us, x, y from frames join pl using (sensor_id)
  qualify row_number() over (partition by bssid, sensor_id order by t_us desc, event_id desc) = 1),
rd as (select *, greatest(1e-1, least(power(1e1, (-42e0 + case when frequency_mhz > 5000 then -3e0 else 0e0 end - rssi) / 22e0), 1e3)) as d
  from lr qualify t_us >= max(t_us) over (partition by bssid) - 300000000),
fo as (select *, first_value(x) over w as x0, first_value(y) over w as y0, first_value(d) over w as d0, count(*) over (partition by bssid) as n from rd window w as (partition by bssid order by sensor_id)),
su as (select bssid, min(n) as n, sum(4 * (x0 - x) * (x0 - x)) as aa, sum(4 * (x0 - x) * (y0 - y)) as ab, sum(4 * (y0 - y) * (y0 - y)) as bb,
  sum(2 * (x0 - x) * (d * d - d0 * d0 - x * x - y * y + x0 * x0 + y0 * y0)) as ar, sum(2 * (y0 - y) * (d * d - d0 * d0 - x * x - y * y + x0 * x0 + y0 * y0)) as br from fo where n >= 3 group by bssid),
so as (select bssid, n, (bb * ar - ab * br) / (aa * bb - ab * ab) as px, (aa * br - ab * ar) / (aa * bb - ab * ab) as py from su where abs(aa * bb - ab * ab) > 1e-9),
tr as (select bssid, min(px) as px, min(py) as py, sqrt(avg(power(sqrt(power(px - x, 2) + power(py - y, 2)) - d, 2))) as err, min(so.n) as n from rd join so using (bssid) group by bssid),
st as (select bssid, arg_max(x, (rssi, sensor_id)) as sx, arg_max(y, (rssi, sensor_id)) as sy, (greatest(-9e1, least(-3e1, max(rssi))) + 9e1) / 6e1 as r, count(*) as n from rd group by bssid)"""


@query("g01_distance", with_frames("""
select event_id, round(greatest(1e-1, least(power(1e1, (-42e0 + case when frequency_mhz > 5000 then -3e0 else 0e0 end - rssi_dbm) / 22e0), 1e3)), 6) as distance_m from frames"""))
def g01(spark, sf):
    return G.with_distance(load_frames(spark, sf)).select("event_id", F.round("distance_m", 6).alias("distance_m"))


@query("g02_latest_readings", with_frames("select bssid, sensor_id, rssi as rssi_dbm, frequency_mhz, t_us from rd", READ))
def g02(spark, sf):
    return readings(spark, sf).select("bssid", "sensor_id", "rssi_dbm", "frequency_mhz", "t_us")


@query("g02_clock_drift", with_frames("""
select sensor_id, count(*) as samples, round(avg((event_id % 90 - 40) / 1e3), 6) as mean_ms, max(abs((event_id % 90 - 40) / 1e3)) as max_abs_ms from frames group by sensor_id"""))
def g02b(spark, sf):
    return G.clock_drift(load_frames(spark, sf).select("sensor_id", (F.col("event_id") % 90 - 40).alias("offset_us"))).withColumn("mean_ms", F.round("mean_ms", 6))


@query("g03_trilaterate", with_frames("""
select bssid, round(px, 3) as x_m, round(py, 3) as y_m, round(err, 3) as error_radius_m, n as sensors, round(greatest(0e0, least(1e0, 1 - err / 1e1)) * least(1e0, n / 5e0), 4) as confidence from tr""", READ))
def g03(spark, sf):
    out = G.trilaterate(readings(spark, sf))
    return out.select("bssid", *[F.round(c, 3).alias(c) for c in ("x_m", "y_m", "error_radius_m")], "sensors", F.round("confidence", 4).alias("confidence"))


@query("g04_strongest_sensor", with_frames("""
select bssid, sx as x_m, sy as y_m, round(2e-1 + r * 45e-2, 6) as confidence, round(8 + (1 - r) * 2e1, 6) as error_radius_m, n as sensors from st""", READ))
def g04(spark, sf):
    out = G.strongest_sensor(readings(spark, sf))
    return out.select("bssid", "x_m", "y_m", F.round("confidence", 6).alias("confidence"), F.round("error_radius_m", 6).alias("error_radius_m"), "sensors")


@query("g05_positions", with_frames(f"""
select bssid, case when px is not null then 'trilateration' else 'strongest_rssi' end as method, round(coalesce(px, sx), 3) as x_m, round(coalesce(py, sy), 3) as y_m,
  round({ORIGIN[0]}::double + degrees(coalesce(py, sy) / 6378137e0), 6) as lat, round({ORIGIN[1]}::double + degrees(coalesce(px, sx) / (6378137e0 * cos(radians({ORIGIN[0]}::double)))), 6) as lon
from st left join tr using (bssid)""", READ))
def g05(spark, sf):
    out = G.positions(readings(spark, sf), ORIGIN)
    return out.select("bssid", "method", "x_m", "y_m", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


# The filter, one measurement after another.
FILTER = """f as (select bssid, rn, t_us, x as px, y as py, 0e0 as vx, 0e0 as vy, 10e0 as a, 0e0 as b, 10e0 as c from z where rn = 1
  union all
  select bssid, rn, t_us, px + dt * vx + k1 * (x - px - dt * vx), py + dt * vy + k1 * (y - py - dt * vy), vx + k2 * (x - px - dt * vx), vy + k2 * (y - py - dt * vy),
    a1 - k1 * a1, b1 - k1 * b1, c1 - k2 * b1
  from (select *, a1 / (a1 + 1) as k1, b1 / (a1 + 1) as k2 from (
    select z.bssid, z.rn, z.t_us, z.x, z.y, px, py, vx, vy, (z.t_us - f.t_us) / 1e6 as dt,
      a + 2 * ((z.t_us - f.t_us) / 1e6) * b + ((z.t_us - f.t_us) / 1e6) * ((z.t_us - f.t_us) / 1e6) * c + 1e-1 as a1, b + ((z.t_us - f.t_us) / 1e6) * c as b1, c + 1e-1 as c1
    from f join z on z.bssid = f.bssid and z.rn = f.rn + 1)))"""
STEP_READ = READ.replace("from frames join", "from (select * replace (concat(bssid, '#', t_us // 120000000) as bssid) from frames where bssid is not null) join").replace("- 300000000", "- 120000000")


@query("g06_smooth_tracks", with_frames("""
select f.bssid, f.t_us, round(z.x, 5) as x_m, round(z.y, 5) as y_m, round(px, 5) as x_s, round(py, 5) as y_s, round(vx, 5) as vx, round(vy, 5) as vy, round(case when f.rn = 1 then sqrt(10e0) else sqrt(2 * a) end, 5) as uncertainty
from f join z using (bssid, rn)""", STEP_READ + """,
z0 as (select split_part(bssid, '#', 1) as bssid, (split_part(bssid, '#', 2)::bigint + 1) * 120000000 as t_us, coalesce(px, sx) as x, coalesce(py, sy) as y from st left join tr using (bssid)),
z as (select *, row_number() over (partition by bssid order by t_us) as rn from z0),
""" + FILTER, recursive=True))
def g06(spark, sf):
    track = G.position_track(load_frames(spark, sf), places(spark), 120)
    out = TR.smooth_tracks(track, slice_rows=4)  # addresses have few positions here; several slices each
    return out.select("bssid", "t_us", *[F.round(c, 5).alias(c) for c in ("x_m", "y_m", "x_s", "y_s", "vx", "vy", "uncertainty")])


@query("g06_filter_steps", with_frames("""
select bssid, t_us, round(px, 6) as x_s, round(py, 6) as y_s, round(vx, 6) as vx, round(vy, 6) as vy, round(case when rn = 1 then sqrt(10e0) else sqrt(2 * a) end, 6) as uncertainty from f""", """
z as (select bssid, t_us, avg(rssi_dbm) / 10 as x, avg(channel)::double as y, row_number() over (partition by bssid order by t_us) as rn from frames where frame_type = 'probe_resp' group by bssid, t_us),
""" + FILTER, recursive=True))
def g06_steps(spark, sf):
    seen = load_frames(spark, sf).filter("frame_type = 'probe_resp'").groupBy("bssid", "t_us").agg((F.avg("rssi_dbm") / 10).alias("x_m"), F.avg("channel").alias("y_m"))
    return TR.smooth_tracks(seen).select("bssid", "t_us", *[F.round(c, 6).alias(c) for c in ("x_s", "y_s", "vx", "vy", "uncertainty")])


def points(frames):
    """Readings scattered over the map."""
    return frames.select(((F.col("event_id") * 37) % 520 / 10.0 - 1).alias("x"), ((F.col("event_id") * 91) % 510 / 10.0).alias("y"), "rssi_dbm")


HEAT = """pt as (select (event_id * 37) % 520 / 1e1 - 1 as x, (event_id * 91) % 510 / 1e1 as y, rssi_dbm from frames),
hm as (select cast(floor(x / 5e-1) as int) as cell_x, cast(floor(y / 5e-1) as int) as cell_y, avg(rssi_dbm) as v, count(*) as samples from pt
  where floor(x / 5e-1) between 0 and 99 and floor(y / 5e-1) between 0 and 99 group by all)"""


@query("g07_heatmap", with_frames("select cell_x, cell_y, round(v, 6) as rssi_dbm, samples from hm", HEAT))
def g07(spark, sf):
    return G.heatmap(points(load_frames(spark, sf))).withColumn("rssi_dbm", F.round("rssi_dbm", 6))


@query("g07_off_map", with_frames("select count(*) filter (x < 0 or y < 0 or x >= 50 or y >= 50) as off_map, count(*) as points from pt", HEAT))
def g07_off(spark, sf):
    return G.off_map(points(load_frames(spark, sf)))


@query("g07_fill_heatmap", with_frames("""
select gx as cell_x, gy as cell_y, round(arg_min(v, row((gx - cell_x) * (gx - cell_x) + (gy - cell_y) * (gy - cell_y), cell_y, cell_x)), 6) as rssi_dbm, min((gx - cell_x) * (gx - cell_x) + (gy - cell_y) * (gy - cell_y)) as distance2
from hm, (select cast(i as int) as gx from range(100) r(i)), (select cast(j as int) as gy from range(100) s(j)) group by gx, gy""", HEAT))
def g07b(spark, sf):
    """The whole map, level of the nearest measured cell and its squared distance."""
    cells = G.heatmap(points(load_frames(spark, sf)))
    return G.fill_heatmap(cells).select("cell_x", "cell_y", F.round("rssi_dbm", 6).alias("rssi_dbm"), "distance2")


@query("s14_export_heatmap", with_frames("select cell_x, cell_y, round(v, 6) as rssi_dbm, samples from hm", HEAT))
def s14_heatmap(spark, sf):
    from skyfence.sources import sinks

    path = shared_dir(spark, "heatmap")
    sinks.export_json(G.heatmap(points(load_frames(spark, sf))), path)
    return spark.read.schema("cell_x int, cell_y int, rssi_dbm double, samples bigint").json(path).withColumn("rssi_dbm", F.round("rssi_dbm", 6))
