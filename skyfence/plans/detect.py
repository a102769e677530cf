"""Detector queries over the frames projection, with thresholds scaled to its density."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyfence.frames import load_frames
from skyfence.operators import detectors as D
from skyfence.plans.base import fold_ctes, query, with_frames

S = 1_000_000


def flat(df, *cols):
    """Scalar view of an alert table: reason codes as text."""
    have = [F.array_join("reason_codes", "|").alias("reasons")] if "reasons" in cols else []
    return df.select(*[c for c in cols if c != "reasons"], *have)


def _flood_sql(kind: str, window_s: int, need: int, cool: int, entry: bool = False) -> str:
    rate = repr(need / window_s)
    cand = f"""select * from (
      select event_id, t_us, sensor_id, bssid, dst_addr as client,
        count(*) over (partition by bssid, dst_addr order by t_us range between {window_s * S} preceding and current row) as frame_count
      from frames where frame_type = '{kind}') where frame_count >= {need}"""
    body = f"""select '{kind}_flood' as alert_type,
      case when frame_count >= {need * 5} then 'CRITICAL' when frame_count >= {need * 2} then 'HIGH' else 'MEDIUM' end as severity,
      sensor_id, bssid, client, event_id, t_us, frame_count, frame_count / cast({window_s} as double) as rate_per_sec,
      client = 'FF:FF:FF:FF:FF:FF' as is_broadcast,
      '{kind.upper()}_FLOOD|RATE_' || cast(cast(floor(frame_count / cast({window_s} as double)) as bigint) as varchar) || '_PER_SEC|' ||
        case when client = 'FF:FF:FF:FF:FF:FF' then 'BROADCAST_TARGET' else 'TARGETED_CLIENT' end as reasons
    from kept"""
    return with_frames(body, fold_ctes(cand, "bssid, client", cool * S), recursive=True)


D02_COLS = ["severity", "sensor_id", "bssid", "client", "event_id", "t_us", "frame_count", "rate_per_sec", "unique_clients", "is_broadcast"]
D03_COLS = ["severity", "sensor_id", "event_id", "t_us", "unique_ssids", "unique_bssids", "oui_count", "beacon_count", "beacon_rate", "sample_ssids"]
D04_COLS = ["severity", "sensor_id", "bssid", "client", "event_id", "t_us", "attack_subtype", "m1_count", "m2_count", "m3_count", "m4_count"]
D06_COLS = ["severity", "sensor_id", "bssid", "event_id", "t_us", "attack_subtype", "wep_iv", "hit_count"]
D05_COLS = ["severity", "sensor_id", "bssid", "event_id", "t_us", "orphaned_m1", "auth_count", "unique_sources", "reasons"]
D08_COLS = ["severity", "bssid", "sensor_id", "event_id", "t_us", "name_count", "names", "duration_s"]
D10_COLS = ["severity", "src_addr", "sensor_id", "event_id", "t_us", "name_count", "names", "duration_s"]
D09_COLS = ["severity", "sensor_id", "channel", "t_us", "event_id", "score", "total_frames", "retry_rate", "rts_cts_count"]
D01_COLS = ["alert_type", "severity", "sensor_id", "bssid", "client", "event_id", "t_us", "frame_count", "rate_per_sec", "is_broadcast", "reasons"]


@query("d01_deauth_flood", _flood_sql("deauth", 60, 3, 60))
def d01(spark, sf):
    return flat(D.deauth_flood(load_frames(spark, sf), 3 / 60, 60, 60), *D01_COLS)


@query("d01_deauth_flood_wide", _flood_sql("deauth", 120, 2, 60))
def d01_wide(spark, sf):
    return flat(D.deauth_flood(load_frames(spark, sf), 2 / 120, 120, 60), *D01_COLS)


@query("d02_disassoc_flood", with_frames("""
select case when frame_count >= 10 or (unique_clients >= 3 and frame_count >= 4) then 'CRITICAL'
            when frame_count >= 4 or unique_clients >= 3 then 'HIGH' else 'MEDIUM' end as severity,
  sensor_id, bssid, client, event_id, t_us, frame_count, frame_count / cast(300 as double) as rate_per_sec, unique_clients, client = 'FF:FF:FF:FF:FF:FF' as is_broadcast
from kept""", """
d as (select event_id, t_us, sensor_id, bssid, dst_addr as client from frames where frame_type = 'disassoc'),
c as (select a.event_id, count(distinct b.client) as unique_clients
      from d a join d b on a.bssid = b.bssid and b.t_us between a.t_us - 300000000 and a.t_us group by a.event_id),
""" + fold_ctes("""select * from (
  select d.*, c.unique_clients, count(*) over (partition by bssid, client order by t_us range between 300000000 preceding and current row) as frame_count
  from d join c using (event_id)) where frame_count >= 2""", "bssid, client", 60 * S), recursive=True))
def d02(spark, sf):
    return D.disassoc_flood(load_frames(spark, sf), 2 / 300, 300, 60).select(*D02_COLS)


@query("d03_beacon_flood", with_frames("""
select case when unique_ssids >= 40 and unique_bssids >= 10 then 'CRITICAL'
            when unique_ssids >= 16 or unique_bssids >= 10 then 'HIGH' else 'MEDIUM' end as severity,
  k.sensor_id, k.event_id, k.t_us, unique_ssids, unique_bssids, oui_count, beacon_count,
  round(beacon_count / cast(30 as double), 1) as beacon_rate,
  (select string_agg(ssid, ',' order by ssid) from (
     select distinct ssid from frames f where f.frame_type = 'beacon' and f.ssid is not null and f.sensor_id = k.sensor_id
       and f.t_us between k.t_us - 30000000 and k.t_us order by ssid limit 10)) as sample_ssids
from kept k""", fold_ctes("""select * from (
  select a.event_id, a.t_us, a.sensor_id, count(distinct b.ssid) as unique_ssids, count(distinct b.bssid) as unique_bssids,
    count(distinct b.vendor_oui) as oui_count, count(*) as beacon_count
  from frames a join frames b on a.sensor_id = b.sensor_id and b.t_us between a.t_us - 30000000 and a.t_us
  where a.frame_type = 'beacon' and b.frame_type = 'beacon' group by all)
  where unique_ssids >= 8 or unique_bssids >= 20""", "sensor_id", 120 * S), recursive=True))
def d03(spark, sf):
    return D.beacon_flood(load_frames(spark, sf), 8, 10, 30, 120).select(*D03_COLS)


@query("d04_krack", with_frames("""
select case when replay or m3_count >= 6 then 'CRITICAL' else 'HIGH' end as severity, sensor_id, bssid, client, event_id, t_us,
  case when replay then 'm3_replay_after_m4' else 'excessive_m3_retransmission' end as attack_subtype,
  m1_count, m2_count, m3_count, m4_count
from kept""", """
talk as (select event_id, t_us, sensor_id, bssid, eapol_message as msg,
           case when eapol_message in (1, 3) then dst_addr else src_addr end as client
         from frames where eapol_message is not null),
hs as (select *, sum(cast(msg = 1 as int)) over (partition by bssid, client order by t_us, event_id) as handshake from talk),
st as (select *,
    coalesce(max(cast(msg = 4 as int)) over (partition by bssid, client, handshake order by t_us, event_id rows between unbounded preceding and 1 preceding), 0) = 1 as replay,
    count(*) filter (msg = 1) over w as m1_count, count(*) filter (msg = 2) over w as m2_count,
    count(*) filter (msg = 3) over w as m3_count, count(*) filter (msg = 4) over w as m4_count
  from hs window w as (partition by bssid, client order by t_us range between 300000000 preceding and current row)),
""" + fold_ctes("select * from st where msg = 3 and (replay or m3_count >= 3)", "bssid, client", 120 * S), recursive=True))
def d04(spark, sf):
    return D.krack(load_frames(spark, sf), 3, 300, 120).select(*D04_COLS)


@query("d05_pmkid", with_frames("""
select case when m1_flood and auth_flood then 'CRITICAL' else 'HIGH' end as severity, sensor_id, bssid, event_id, t_us,
  orphaned_m1, auth_count, unique_sources,
  concat_ws('|', case when m1_flood then 'EAPOL_M1_FLOOD' end, case when auth_flood then 'AUTH_FLOOD_RANDOM_MAC' end) as reasons
from kept""", """
talk as (select event_id, t_us, sensor_id, bssid, eapol_message as msg, case when frame_type in ('auth', 'assoc_req') then src_addr end as source,
           row_number() over (partition by bssid order by t_us, event_id) as rn
         from frames where frame_type in ('auth', 'assoc_req') or eapol_message is not null),
au as (select a.event_id, count(b.source) as auth_count, count(distinct b.source) as unique_sources
       from talk a join talk b on a.bssid = b.bssid and b.t_us between a.t_us - 120000000 and a.t_us group by a.event_id),
q as (
  select bssid, rn, event_id, case when msg = 1 then [t_us] else cast([] as bigint[]) end as waiting from talk where rn = 1
  union all
  select t.bssid, t.rn, t.event_id,
    case when t.msg = 1 then list_append(list_filter(q.waiting, lambda x: x >= t.t_us - 120000000), t.t_us)
         when t.msg = 2 then list_filter(q.waiting, lambda x: x >= t.t_us - 120000000)[2:]
         else list_filter(q.waiting, lambda x: x >= t.t_us - 120000000) end
  from q join talk t on t.bssid = q.bssid and t.rn = q.rn + 1),
ev as (select t.*, len(q.waiting) as orphaned_m1, au.auth_count, au.unique_sources,
         len(q.waiting) >= 2 as m1_flood, au.auth_count >= 3 and au.unique_sources >= 2 as auth_flood
       from talk t join q using (event_id) join au using (event_id)),
""" + fold_ctes("select * from ev where coalesce(msg, 0) <> 2 and (m1_flood or auth_flood)", "bssid", 60 * S), recursive=True))
def d05(spark, sf):
    df = D.pmkid(load_frames(spark, sf), 2, 120, 3, 120, 2, 60)
    return flat(df, *D05_COLS)


@query("d06_wep_attacks", with_frames("""
select case when reuse then 'CRITICAL' else 'HIGH' end as severity, sensor_id, bssid, event_id, t_us,
  case when reuse then 'iv_collision' else 'packet_injection' end as attack_subtype,
  case when reuse then wep_iv end as wep_iv, case when reuse then nth else 3 end as hit_count
from sm where reuse or (small and smalls % 13 = 3)""", """
w as (select *, last_value(case when frame_type in ('beacon', 'probe_resp') then privacy and security = 'WEP' end ignore nulls)
        over (partition by bssid order by t_us, event_id rows between unbounded preceding and 1 preceding) as is_wep
      from frames where frame_type in ('beacon', 'probe_resp', 'data')),
iv as (select *, (t_us - t_us % 600000000) // 600000000 as win,
         count(*) over (partition by bssid, (t_us - t_us % 600000000) // 600000000, wep_iv order by t_us, event_id rows unbounded preceding) as nth
       from w where frame_type = 'data' and is_wep),
fl as (select *, nth >= 2 as reuse, nth < 2 and frame_len between 1 and 150 as small from iv),
sm as (select *, sum(cast(small as int)) over (partition by bssid, win order by t_us, event_id rows unbounded preceding) as smalls from fl)"""))
def d06(spark, sf):
    return D.wep_attacks(load_frames(spark, sf), 2, 3, 150, 600, rearm=10).select(*D06_COLS)


@query("d07_evil_twin", with_frames("""
select case when score >= 80 then 'CRITICAL' when score >= 60 then 'HIGH' else 'MEDIUM' end as severity,
  sensor_id, ssid, original, bssid, t_us, score, round(rssi_delta, 6) as rssi_delta, duplicate_count,
  (cast(rssi_delta > 0 as int) + cast(vendor as int) + cast(sec as int) + cast(fresh as int) + cast(diff as int)) / 5e0 as confidence,
  concat_ws('|', 'DUPLICATE_SSID', case when rssi_delta > 0 then 'STRONGER_SIGNAL' end, case when vendor then 'VENDOR_MISMATCH' end,
    case when sec then 'SECURITY_MISMATCH' end, case when fresh then 'NEW_AP' end, case when shaky then 'BEACON_JITTER' end,
    case when diff then 'IE_FINGERPRINT_DIFF' end) as reasons
from done""", """
ads as (select *, min(t_us) over (partition by sensor_id, ssid, bssid) as first_us
        from frames where frame_type in ('beacon', 'probe_resp') and ssid <> ''),
ends as (select ads.*, ((t_us - t_us % 30000000) // 30000000 + s.i + 1) * 30000000 as att from ads, range(4) s(i)),
ap as (select sensor_id, ssid, att, bssid, count(*) as n, min(first_us) as first_us, avg(rssi_dbm) as rssi,
         coalesce(round(stddev_samp(beacon_interval), 9), 0) as jitter, min(vendor_oui) as oui, min(security) as security, min(wps) as wps, min(pmf) as pmf,
         count(*) over (partition by sensor_id, ssid, att) as duplicate_count
       from ends group by sensor_id, ssid, att, bssid),
pr as (select o.sensor_id, o.ssid, o.att as t_us, o.bssid as original, s.bssid, o.duplicate_count,
         s.rssi - o.rssi as gain, abs(s.jitter - o.jitter) as shake, o.oui <> s.oui as vendor, o.security <> s.security as sec,
         o.att - s.first_us < 600000000 as fresh, o.wps <> s.wps or o.pmf <> s.pmf as diff
       from ap o join ap s on o.sensor_id = s.sensor_id and o.ssid = s.ssid and o.att = s.att and o.bssid <> s.bssid
       where o.n > s.n or (o.n = s.n and (o.first_us < s.first_us or (o.first_us = s.first_us and o.bssid < s.bssid)))),
sc as (select *, shake > 10 as shaky, case when gain >= 15 then gain else 0 end as rssi_delta,
         20 + case when gain >= 15 then cast(trunc(30 * least(1e0, (gain - 15) / 20e0)) as bigint) else 0 end
         + case when vendor then 15 else 0 end + case when sec then 15 else 0 end
         + case when shake > 10 then cast(trunc(10 * least(1e0, shake / 50e0)) as bigint) else 0 end
         + case when fresh then 5 else 0 end as now_score
       from pr),
ok as (select *, min(t_us) over w as since, max(now_score) over w as score from sc where now_score >= 40
       window w as (partition by sensor_id, ssid, original, bssid order by t_us rows unbounded preceding)),
done as (select * from ok where t_us - since >= 30000000 or (t_us = since and now_score >= 90)
         qualify row_number() over (partition by sensor_id, ssid, original, bssid order by t_us) = 1)"""))
def d07(spark, sf):
    df = D.evil_twin(load_frames(spark, sf)).withColumn("rssi_delta", F.round("rssi_delta", 6))
    return flat(df, "severity", "sensor_id", "ssid", "original", "bssid", "t_us", "score", "rssi_delta", "duplicate_count", "confidence", "reasons")


def _episode_sql(key: str, where: str, limits: dict[int, str], idle_s: int = 60) -> str:
    level = " ".join(f"when nth = {n} then '{severity}'" for n, severity in limits.items())
    return with_frames(f"""
select case {level} end as severity, {key}, sensor_id, event_id, t_us, nth as name_count,
  (select string_agg(f.ssid, ',' order by f.ssid) from named f where f.{key} = named.{key} and f.episode = named.episode and f.nth <= named.nth) as names,
  round((t_us - began) / 1e6, 1) as duration_s
from named where nth in ({", ".join(map(str, limits))})""", f"""
r as (select *, case when t_us - lag(t_us) over (partition by {key} order by t_us, event_id) <= {idle_s}000000 then 0 else 1 end as fresh from frames where {where}),
e as (select *, sum(fresh) over (partition by {key} order by t_us, event_id rows unbounded preceding) as episode from r),
b as (select *, min(t_us) over (partition by {key}, episode) as began from e),
firsts as (select * from b where ssid is not null
  qualify row_number() over (partition by {key}, episode, ssid order by t_us, event_id) = 1),
named as (select *, row_number() over (partition by {key}, episode order by t_us, event_id) as nth from firsts)""")


@query("d08_karma", _episode_sql("bssid", "frame_type in ('beacon', 'probe_resp') and ssid is not null and ssid not in ('', '<Hidden>')", {3: "HIGH"}))
def d08(spark, sf):
    return D.karma(load_frames(spark, sf)).select(*D08_COLS)


@query("d08_episode_names", with_frames("select bssid, began as episode, count(distinct case when ssid not in ('', '<Hidden>') then ssid end) as names from b group by all", """
r as (select *, case when t_us - lag(t_us) over (partition by bssid order by t_us, event_id) <= 60000000 then 0 else 1 end as fresh from frames),
e as (select *, sum(fresh) over (partition by bssid order by t_us, event_id rows unbounded preceding) as number from r),
b as (select *, min(t_us) over (partition by bssid, number) as began from e)"""))
def d08_extent(spark, sf):
    return D.episode_names(load_frames(spark, sf), "bssid")


@query("d10_wardriver", _episode_sql("src_addr", "frame_type = 'probe_req'", {5: "MEDIUM"}))
def d10(spark, sf):
    return D.wardriver(load_frames(spark, sf)).withColumnRenamed("attacker", "src_addr").select(*D10_COLS)


KARMA_STEPS = {"ssids": 2, "critical": 4, "idle_s": 300, "escalate": True}
PROBE_STEPS = {"ssids": 3, "high": 4, "critical": 6, "idle_s": 300, "escalate": True}


@query("d08_karma_steps", _episode_sql("bssid", "frame_type in ('beacon', 'probe_resp') and ssid is not null and ssid not in ('', '<Hidden>')", {2: "HIGH", 4: "CRITICAL"}, 300))
def d08_steps(spark, sf):
    return D.karma(load_frames(spark, sf), **KARMA_STEPS).select(*D08_COLS)


@query("d10_wardriver_steps", _episode_sql("src_addr", "frame_type = 'probe_req'", {3: "MEDIUM", 4: "HIGH", 6: "CRITICAL"}, 300))
def d10_steps(spark, sf):
    return D.wardriver(load_frames(spark, sf), **PROBE_STEPS).withColumnRenamed("attacker", "src_addr").select(*D10_COLS)


@query("d09_jamming", with_frames("""
select case when score >= 50 then 'CRITICAL' else 'HIGH' end as severity, sensor_id, channel, t_us, event_id, score, total_frames,
  retries / total_frames as retry_rate, rts_cts_count, round(avg_rssi, 6) as avg_rssi
from (select *, case when retries / total_frames > 4e-1 then cast(trunc(40 * least(1e0, (retries / total_frames - 4e-1) / 5e-1)) as bigint) else 0 end
        + case when rts_cts_count > 0 then 30 else 0 end as score
  from (select sensor_id, channel, win, max(t_us) as t_us, arg_max(event_id, (t_us, event_id)) as event_id, count(*) as total_frames, cast(count(*) filter (retry) as double) as retries,
          count(*) filter (frame_type in ('rts', 'cts')) as rts_cts_count, avg(rssi_dbm) filter (rn <= 5) as avg_rssi
        from (select *, row_number() over (partition by sensor_id, channel, win order by t_us desc, event_id desc) as rn
              from (select *, (t_us - t_us % 60000000) // 60000000 as win from frames))
        group by all having count(*) >= 10))
where score >= 30"""))
def d09(spark, sf):
    df = D.jamming(load_frames(spark, sf), 60, 10, 0.4, 0, high=30, critical=50, samples=5)
    return df.select(*D09_COLS, F.round("avg_rssi", 6).alias("avg_rssi"))


@query("d15_deauth_bursts", with_frames("""
select sensor_id, bssid, attacker, client, event_id, t_us, frame_count from kept""", fold_ctes("""select * from (
  select event_id, t_us, sensor_id, bssid, src_addr as attacker, dst_addr as client,
    count(*) over (partition by sensor_id order by t_us range between current row and 60000000 following) as frame_count
  from frames where frame_type = 'deauth') where frame_count >= 5""", "sensor_id", 60 * S + 1), recursive=True))
def d15(spark, sf):
    return D.deauth_bursts(load_frames(spark, sf), 5, 60).select("sensor_id", "bssid", "attacker", "client", "event_id", "t_us", "frame_count")
