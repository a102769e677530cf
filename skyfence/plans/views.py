"""Summary, baseline and inventory queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyfence.frames import load_frames
from skyfence.operators import baselines as B
from skyfence.operators import matching as M
from skyfence.operators import summaries as A
from skyfence.plans.base import query, with_frames

S = 1_000_000
NOW = 2_592 * S


def networks(frames):
    """One row per access point, as a network table."""
    return frames.groupBy("bssid").agg(
        F.max("ssid").alias("ssid"), F.min("security").alias("security"), F.min("security").alias("encryption"), F.avg("rssi_dbm").alias("rssi_avg"),
        F.max("rssi_dbm").alias("rssi"), F.max_by("channel", F.struct("t_us", "event_id")).alias("channel"), F.min("t_us").alias("first_seen"),
        F.max("t_us").alias("last_seen"), F.min("vendor_oui").alias("vendor_oui"), F.bool_or("wps").alias("wps"), F.bool_or("pmf").alias("pmf"), F.bool_or("privacy").alias("privacy"),
    )


NET = """net as (select bssid, max(ssid) as ssid, min(security) as security, min(security) as encryption, avg(rssi_dbm) as rssi_avg, max(rssi_dbm) as rssi,
  arg_max(channel, (t_us, event_id)) as channel, min(t_us) as first_seen, max(t_us) as last_seen, min(vendor_oui) as vendor_oui, bool_or(wps) as wps, bool_or(pmf) as pmf, bool_or(privacy) as privacy
  from frames group by bssid)"""
GPS = """sight as (select event_id, t_us, bssid, ssid, security, rssi_dbm, case when event_id % 6 <> 0 then 10 + (event_id % 100) / 1e3 end as lat,
  case when event_id % 6 <> 0 then 106 + (event_id % 37) / 1e3 end as lon from frames where frame_type = 'beacon')"""


def sightings(frames):
    e = F.col("event_id")
    return frames.filter("frame_type = 'beacon'").select(
        "event_id", "t_us", "bssid", "ssid", "security", "rssi_dbm",
        F.when(e % 6 != 0, 10 + (e % 100) / 1000.0).alias("lat"), F.when(e % 6 != 0, 106 + (e % 37) / 1000.0).alias("lon"),
    )


@query("a01_recent", with_frames("select event_id, t_us, bssid, rssi_dbm from frames where sensor_id = 'sensor-1' order by t_us desc, event_id desc limit 50"))
def a01(spark, sf):
    return A.recent(load_frames(spark, sf), 50, sensor_id="sensor-1").select("event_id", "t_us", "bssid", "rssi_dbm")


@query("a02_network_stats", with_frames("""
select bssid, min(t_us) as first_seen, max(t_us) as last_seen, count(*) as frame_count, count(*) filter (frame_type = 'beacon') as beacon_count,
  count(*) filter (frame_type = 'probe_req') as probe_count, min(rssi_dbm) as rssi_min, max(rssi_dbm) as rssi_max, round(avg(rssi_dbm), 6) as rssi_avg,
  arg_max(ssid, (t_us, event_id)) filter (ssid is not null) as ssid, max(cl.clients) as clients
from frames left join (select bssid as cb, string_agg(distinct c, ',' order by c) as clients from (
    select bssid, unnest([src_addr, dst_addr]) as c from frames) where c <> bssid and c <> 'FF:FF:FF:FF:FF:FF' group by bssid) cl on cl.cb = bssid
group by bssid"""))
def a02(spark, sf):
    out = A.network_stats(load_frames(spark, sf))
    return out.withColumn("rssi_avg", F.round("rssi_avg", 6)).withColumn("clients", F.array_join("associated_clients", ",")).drop("associated_clients")


@query("a02_network_clients", with_frames("""
select bssid, c as client, count(*) as frames, min(t_us) as first_seen, max(t_us) as last_seen
from (select distinct event_id, bssid, t_us, unnest([src_addr, dst_addr]) as c from frames) where c <> bssid and c <> 'FF:FF:FF:FF:FF:FF' group by bssid, c"""))
def a02_clients(spark, sf):
    return A.network_clients(load_frames(spark, sf))


@query("a03_current_networks", with_frames("""
select bssid, event_id, t_us as last_seen, rssi_dbm, case when bssid like '%0' then 1e0 when event_id % 6 <> 0 then 10e0 end as lat
from frames qualify row_number() over (partition by bssid order by t_us desc, event_id desc) = 1"""))
def a03(spark, sf):
    f = load_frames(spark, sf).withColumn("gps_lat", F.when(F.col("event_id") % 6 != 0, 10.0))
    pos = f.select("bssid").distinct().filter("bssid like '%0'").select("bssid", F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))
    return A.current_networks(f, pos).select("bssid", "event_id", "last_seen", "rssi_dbm", "lat")


@query("a04_collapse_events", with_frames("""
select frame_type as event_type, bssid as address, (t_us - t_us % 60000000) // 60000000 as window_no, arg_min(event_id, (t_us, event_id)) as sample_event_id,
  arg_max(rssi_dbm, (t_us, event_id)) as rssi_dbm, arg_max(channel, (t_us, event_id)) as channel, arg_max(ssid, (t_us, event_id)) filter (ssid is not null) as ssid,
  arg_max(sensor_id, (t_us, event_id)) as sensor_id, count(*) as agg_count, round(count(*) / greatest((max(t_us) - min(t_us)) / 1e6, 1e-3), 2) as agg_rate_per_sec,
  min(t_us) as agg_first_seen, max(t_us) as agg_last_seen
from frames group by all"""))
def a04(spark, sf):
    return A.collapse_events(load_frames(spark, sf), 60)


@query("a04_compression", with_frames("""
select sum(n) as total_ingested, sum(n) - count(*) as total_collapsed, round((sum(n) - count(*)) / sum(n), 3) as compression_ratio
from (select count(*) as n from frames group by frame_type, bssid, (t_us - t_us % 60000000) // 60000000)"""))
def a04b(spark, sf):
    return A.compression(A.collapse_events(load_frames(spark, sf), 60))


@query("a05_deauth_counts", with_frames("""
select (t_us - t_us % 60000000) // 60000000 as window_no, src_addr, count(*) as deauth_count from frames where frame_type = 'deauth' group by all"""))
def a05(spark, sf):
    return A.deauth_counts(load_frames(spark, sf))


@query("a06_security_mix", with_frames("""
select case when security = 'WPA3' then 'WPA3' when security = 'WPA2' then 'WPA2' when security = 'WEP' then 'WEP' else 'OPEN' end as security_class, count(*) as networks from net group by all""", NET))
def a06(spark, sf):
    return A.security_mix(networks(load_frames(spark, sf)))


@query("a06_map_class", with_frames("""
select bssid, 'WPA' as sec_type from net where security like 'WPA%'""", NET))
def a06b(spark, sf):
    return A.map_class(networks(load_frames(spark, sf)), "WPA").select("bssid", "sec_type")


@query("a07_channel_histogram", with_frames("select channel, count(*) as networks from net group by channel", NET))
def a07(spark, sf):
    return A.channel_histogram(networks(load_frames(spark, sf)))


@query("a07_rssi_distribution", with_frames("""
select count(*) as n, min(rssi_dbm) as lowest, max(rssi_dbm) as highest, round(avg(rssi_dbm), 6) as mean, quantile_cont(rssi_dbm, 25e-2) as q1,
  quantile_cont(rssi_dbm, 5e-1) as median, quantile_cont(rssi_dbm, 75e-2) as q3 from frames where rssi_dbm between -100 and 0"""))
def a07b(spark, sf):
    return A.rssi_distribution(load_frames(spark, sf), "rssi_dbm").withColumn("mean", F.round("mean", 6))


@query("a07_discovery_rate", with_frames("""
select minute, count(net.bssid) as discovered from range(-17, 44) r(minute)
left join net on (first_seen - first_seen % 60000000) // 60000000 = minute and first_seen <= 2592000000 group by minute""", NET))
def a07c(spark, sf):
    return A.discovery_rate(networks(load_frames(spark, sf)), NOW)


@query("a07_risk_density", with_frames("""
select cast(floor(lat / 1e-2) as bigint) as lat_cell, cast(floor(lon / 1e-2) as bigint) as lon_cell, sum(rssi_dbm + 100) as risk, count(*) as networks
from sight where lat is not null group by all""", GPS))
def a07d(spark, sf):
    return A.risk_density(sightings(load_frames(spark, sf)).withColumn("risk_score", F.col("rssi_dbm") + 100), 0.01)


@query("a08_wardrive_summary", with_frames("""
select count(*) as total_sightings, count(distinct bssid) as unique_networks, count(lat) as gps_points,
  arg_max(printf('%.5f, %.5f', lat, lon), (t_us, event_id)) filter (lat is not null) as latest_fix,
  count(*) filter (security in ('Open', 'WPA')) as open_sightings, count(*) filter (security = 'WEP') as wep_sightings,
  count(*) filter (security = 'WPA2') as wpa2_sightings, count(*) filter (security = 'WPA3') as wpa3_sightings from sight""", GPS))
def a08(spark, sf):
    return A.wardrive_summary(sightings(load_frames(spark, sf)))


@query("a08_first_sightings", with_frames("""
select event_id, bssid, row_number() over (partition by bssid order by t_us, event_id) = 1 as is_new from sight""", GPS))
def a08b(spark, sf):
    return A.first_sightings(sightings(load_frames(spark, sf))).select("event_id", "bssid", "is_new")


@query("a08_newest", with_frames("select event_id, bssid, t_us from sight order by t_us desc, event_id desc limit 10", GPS))
def a08c(spark, sf):
    return A.newest_sightings(sightings(load_frames(spark, sf))).select("event_id", "bssid", "t_us")


@query("a09_client_list", with_frames("""
select src_addr as mac, min(t_us) as first_seen, string_agg(distinct ssid, ',' order by ssid) as probed from frames where frame_type = 'probe_req' group by src_addr"""))
def a09(spark, sf):
    out = A.client_list(load_frames(spark, sf))
    return out.select("mac", "first_seen", F.array_join("probed_ssids", ",").alias("probed"))


@query("a10_sensor_status", with_frames("""
select coalesce(h.sensor_id, b.sensor_id) as sensor_id, greatest(h.t, b.t) as last_seen, last_batch, metrics,
  case when 2900000000 - greatest(h.t, b.t) > 310000000 then 'offline' else coalesce(h.status, 'online') end as status
from (select sensor_id, max(t_us) as t, arg_max(case when event_id % 3 = 0 then 'degraded' else 'online' end, t_us) as status, arg_max(rssi_dbm, t_us) as metrics
      from frames where frame_type = 'beacon' and sensor_id <> 'sensor-3' group by sensor_id) h
full join (select sensor_id, max(t_us) as t, arg_max(event_id // 100, t_us) as last_batch from frames where sensor_id <> 'sensor-0' group by sensor_id) b on h.sensor_id = b.sensor_id"""))
def a10(spark, sf):
    f = load_frames(spark, sf)
    hb = f.filter("frame_type = 'beacon' and sensor_id <> 'sensor-3'").select(
        "sensor_id", "t_us", F.when(F.col("event_id") % 3 == 0, "degraded").otherwise("online").alias("status"), F.col("rssi_dbm").alias("metrics")
    )
    tb = f.filter("sensor_id <> 'sensor-0'").select("sensor_id", "t_us", F.expr("event_id div 100").alias("batch_id"))
    return A.sensor_status(hb, tb, 2900 * S, 310)


SIMPLE = """simple as (select t_us, case frame_type when 'deauth' then 'deauth_flood' when 'auth' then 'evil_twin' else 'disassoc_flood' end as alert_type, case when rssi_dbm > -50 then 'HIGH' else 'LOW' end as severity
  from frames where frame_type in ('deauth', 'disassoc', 'auth'))"""


def paging_alerts(frames):
    t = F.col("frame_type")
    kind = F.when(t == "deauth", "deauth_flood").when(t == "auth", "evil_twin").otherwise("disassoc_flood")
    return frames.filter(t.isin("deauth", "disassoc", "auth")).select("t_us", kind.alias("alert_type"), F.when(F.col("rssi_dbm") > -50, "HIGH").otherwise("LOW").alias("severity"))


@query("a11_alert_counts", with_frames("select alert_type, severity, t_us // 300000000 as window_no, count(*) as alerts from simple group by all", SIMPLE))
def a11(spark, sf):
    return A.alert_counts(paging_alerts(load_frames(spark, sf)))


@query("a11_alert_pages", with_frames("""
select 'evil_twin' as rule, alert_type, e as eval_us, count(*) as alerts from simple, evals where alert_type = 'evil_twin' and t_us >= e - 300000000 and t_us < e group by all
union all select 'deauth_flood', alert_type, e, count(*) from simple, evals where alert_type = 'deauth_flood' and t_us >= e - 120000000 and t_us < e group by all
union all select 'high_rate', r.alert_type, r.e, r.n from rates r
where n > 50 and (select count(*) from rates p where p.alert_type = r.alert_type and p.n > 50 and p.e between r.e - 300000000 and r.e) = 11""", SIMPLE + """,
evals as (select (t.k + d) * 30000000 as e from (select distinct t_us // 30000000 as k from simple) t, range(1, 11) r(d) group by e),
rates as (select alert_type, e, count(*) as n from simple, evals where t_us >= e - 300000000 and t_us < e group by all)"""))
def a11_pages(spark, sf):
    return A.alert_pages(paging_alerts(load_frames(spark, sf)))


def simple_alerts(frames, *more):
    t = F.col("frame_type")
    return frames.filter(t.isin("deauth", "disassoc")).select(
        "event_id", "t_us", "sensor_id", "bssid", F.col("dst_addr").alias("attacker"), F.when(t == "deauth", "deauth_flood").otherwise("disassoc_flood").alias("alert_type"),
        F.when(F.col("rssi_dbm") > -50, "HIGH").otherwise("LOW").alias("severity"), F.concat(t, F.lit(" seen")).alias("title"), *more,
    )


@query("a11_alerts_per_hour", with_frames("""
select (t_us - t_us % 3600000000) // 3600000000 as hour_no, count(*) as alerts from frames where frame_type in ('deauth', 'disassoc') group by all"""))
def a11b(spark, sf):
    return A.alerts_per_hour(simple_alerts(load_frames(spark, sf)))


@query("a12_data_quality", with_frames("""
select count(distinct bssid) as ap_count, count(distinct ssid) as ssid_count, count(*) filter (ssid is null) as hidden_networks, count(*) as total_readings,
  count(*) filter (rssi between -100 and -10) as valid_readings, 1e2 as validity_rate, round(avg(rssi), 2) as avg_rssi, min(rssi) as min_rssi, max(rssi) as max_rssi,
  count(*) as total_networks, count(*) as identified, 1e2 as identification_rate from net""", NET))
def a12(spark, sf):
    return A.data_quality(networks(load_frames(spark, sf)))


@query("a12_encryption_breakdown", with_frames("select encryption, count(*) as networks from net group by all", NET))
def a12b(spark, sf):
    return A.encryption_breakdown(networks(load_frames(spark, sf)))


@query("a12_capture_loss", with_frames("""
select count(*) as truth_frames, count(*) filter (rssi_dbm > -80) as captured_frames, round((count(*) - count(*) filter (rssi_dbm > -80)) / count(*) * 100, 2) as loss_percent from frames"""))
def a12c(spark, sf):
    f = load_frames(spark, sf)
    return A.capture_loss(f, f.filter("rssi_dbm > -80"))


def sited(frames):
    return frames.withColumn("site_id", F.concat(F.lit("site-"), (F.col("event_id") % 3).cast("string")))


SITE = """base as (select 'site-' || (event_id % 3) as site_id, ssid || '|' || security as network_key, * from frames where ssid is not null),
prof as (select site_id, network_key, min(rssi_dbm) as rssi_min, max(rssi_dbm) as rssi_max, sum(rssi_dbm) as rssi_sum, count(rssi_dbm) as rssi_count, count(*) as sample_count,
  min(t_us) as first_seen, max(t_us) as last_seen from base where t_us < {cut} group by all),
chan as (select site_id, network_key, string_agg(channel || '=' || n, ',' order by cast(channel as varchar)) as channels from (
  select site_id, network_key, channel, count(*) as n from base where t_us < {cut} group by all) group by all)"""


def _chan_text(c="channels"):
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")


@query("b01_site_baseline", with_frames("""
select *, 2592000000 - first_seen > 600000000 and sample_count > 5 as warmed_up from prof join chan using (site_id, network_key)""", SITE.format(cut=10**15)))
def b01(spark, sf):
    f = sited(load_frames(spark, sf))
    merged = B.merge_baseline(B.build_site_baseline(f.filter("t_us < 1000000000")), B.build_site_baseline(f.filter("t_us >= 1000000000")))
    return B.warmed_up(merged, NOW, 600, 5).withColumn("channels", _chan_text())


@query("b02_bssid_deviation", with_frames("""
select event_id, bssid, rssi_dbm, prior_n, round(a, 6) as avg_rssi, round((rssi_dbm - a) / greatest(sd, 5e0), 6) as z_score,
  round(least(1e0, ((rssi_dbm - a) / greatest(sd, 5e0) - 12e-1) / 2 + 5e-1), 6) as score
from (select *, count(*) over w as prior_n, avg(rssi_dbm) over w as a, sqrt(greatest(avg(rssi_dbm * rssi_dbm) over w - (avg(rssi_dbm) over w) * (avg(rssi_dbm) over w), 0)) as sd
  from frames window w as (partition by bssid order by t_us, event_id rows between unbounded preceding and 1 preceding))
where prior_n >= 10 and (rssi_dbm - a) / greatest(sd, 5e0) > 12e-1"""))
def b02(spark, sf):
    out = B.bssid_deviation(load_frames(spark, sf), 5, 10, sigma=1.2)
    return out.select("event_id", "bssid", "rssi_dbm", "prior_n", F.round("avg_rssi", 6).alias("avg_rssi"), F.round("z_score", 6).alias("z_score"), F.round("score", 6).alias("score"))


@query("b03_timeseries_baseline", with_frames("""
select event_id, bssid, observations, 'rssi_anomaly' as anomaly, round((rssi_dbm - m) / sd, 6) as z_score from frames join p using (bssid)
where t_us >= 864000000 and observations >= 5 and abs((rssi_dbm - m) / sd) > 15e-1
union all select event_id, bssid, observations, 'new_channel', null from frames join p using (bssid)
where t_us >= 864000000 and observations >= 5 and not list_contains(chans, channel)""", """
p as (select bssid, count(*) as observations, avg(rssi_dbm) as m, list(distinct channel) as chans,
  case when avg(rssi_dbm * rssi_dbm) - avg(rssi_dbm) * avg(rssi_dbm) > 0 then sqrt(avg(rssi_dbm * rssi_dbm) - avg(rssi_dbm) * avg(rssi_dbm)) else 1e0 end as sd
  from frames where t_us < 864000000 group by bssid)"""))
def b03(spark, sf):
    out = B.timeseries_baseline(load_frames(spark, sf), 0, 864, 5, 1.5)
    return out.select("event_id", "bssid", "observations", "anomaly", F.round("z_score", 6).alias("z_score"))


@query("b03_hourly_profile", with_frames("""
select bssid, count(*) as observations, round(avg(beacon_interval), 6) as beacon_mean, count(*) filter (t_us * 1000 // 3600000000 % 24 = 5) as hour_5 from (select * from frames where t_us * 1000 < 864000000000) group by bssid"""))
def b03b(spark, sf):
    f = load_frames(spark, sf).withColumn("t_us", F.col("t_us") * 1000)
    return B.learned_profile(f, 0, 864_000).select("bssid", "observations", F.round("beacon_mean", 6).alias("beacon_mean"), F.get("hourly_activity", F.lit(5)).alias("hour_5"))


@query("b03_learning_status", with_frames("""
select false as is_learning, 1e2 as progress_pct, count(distinct bssid) as networks_tracked, count(*) as total_observations from frames"""))
def b03c(spark, sf):
    return B.learning_status(load_frames(spark, sf), 0, NOW, 864)


@query("d13_policy_findings", with_frames("""
select event_id, case security when 'Open' then 'policy_open_net' else 'policy_wep_net' end as detector_id, 'policy|' || coalesce(ssid, '') || '|' || bssid as entity_key,
  'SECURITY_DOWNGRADE' as reason, 1e0 as confidence_raw from frames where security in ('Open', 'WEP')"""))
def d13(spark, sf):
    return B.policy_findings(load_frames(spark, sf)).select("event_id", "detector_id", "entity_key", F.array_join("reason_codes", "|").alias("reason"), "confidence_raw")


@query("d14_rogue_ap", with_frames("""
select event_id, 'rogue_channel_dev' as detector_id, 'rogue|' || ssid || '|' || bssid as entity_key, 8e-1 as confidence_raw from base join prof using (site_id, network_key)
where base.t_us >= 300000000 and not exists (select 1 from base o where o.t_us < 300000000 and o.site_id = base.site_id and o.network_key = base.network_key and o.channel = base.channel)
union all select event_id, 'rogue_rssi_spike', 'rogue|' || ssid || '|' || bssid, 6e-1 from base join prof using (site_id, network_key)
where base.t_us >= 300000000 and base.rssi_dbm > prof.rssi_max + 15""", SITE.format(cut=300 * S)))
def d14(spark, sf):
    f = sited(load_frames(spark, sf))
    base = B.build_site_baseline(f.filter("t_us < 300000000"))
    return B.rogue_ap(f.filter("t_us >= 300000000"), base).select("event_id", "detector_id", "entity_key", "confidence_raw")


@query("d16_inventory_mismatch", with_frames("""
select distinct ssid, bssid from frames where frame_type in ('beacon', 'probe_resp') and ssid in (select ssid from inv) and (ssid, bssid) not in (select ssid, bssid from inv)""",
    "inv as (select 'net-' || (c_custkey % 20) as ssid, '00:22:6B:' || lpad(hex(c_custkey // 65536), 2, '0') || ':' || lpad(hex(c_custkey // 256 % 256), 2, '0') || ':' || lpad(hex(c_custkey % 256), 2, '0') as bssid from customer)"))
def d16(spark, sf):
    key = F.col("c_custkey")
    byte = lambda shift: F.lpad(F.hex(F.shiftright(key, shift) % 256), 2, "0")
    inv = spark.read.parquet(f"{sf}/customer.parquet").select(
        F.concat(F.lit("net-"), (key % 20).cast("string")).alias("ssid"), F.concat_ws(":", F.lit("00:22:6B"), byte(16), byte(8), byte(0)).alias("bssid")
    )
    return M.inventory_mismatch(load_frames(spark, sf), inv)


@query("d16_similar_ssids", """
with w as (select distinct regexp_replace(p_name, '[^a-z0-9]', '', 'g') || (p_size % 7) as ssid from part)
select a.ssid as ssid_a, b.ssid as ssid_b, round(1 - levenshtein(a.ssid, b.ssid) / cast(greatest(length(a.ssid), length(b.ssid)) as double), 6) as similarity
from w a join w b on a.ssid < b.ssid where 1 - levenshtein(a.ssid, b.ssid) / cast(greatest(length(a.ssid), length(b.ssid)) as double) >= 85e-2""")
def d16b(spark, sf):
    names = spark.read.parquet(f"{sf}/part.parquet").select(
        F.concat(F.regexp_replace("p_name", "[^a-z0-9]", ""), (F.col("p_size") % 7).cast("string")).alias("ssid")
    )
    return M.similar_ssids(names).withColumn("similarity", F.round("similarity", 6))


@query("d16_similar_network_names", with_frames("""
select a.ssid as ssid_a, b.ssid as ssid_b, round(1 - levenshtein(a.ssid, b.ssid) / cast(greatest(length(a.ssid), length(b.ssid)) as double), 6) as similarity
from n a join n b on a.ssid < b.ssid where 1 - levenshtein(a.ssid, b.ssid) / cast(greatest(length(a.ssid), length(b.ssid)) as double) >= 8e-1""", "n as (select distinct ssid from frames where ssid is not null)"))
def d16c(spark, sf):
    return M.similar_ssids(load_frames(spark, sf), 0.8).withColumn("similarity", F.round("similarity", 6))
