"""Source, sink and clean-up queries. File sources read files Spark first writes from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyfence.frames import load_frames
from skyfence.operators import normalise as N
from skyfence.operators.alerts import normalise_alerts
from skyfence.plans.base import fold_ctes, query, with_frames
from skyfence.session import shared_dir
from skyfence.sources import captures, imports, ingest, sinks

S = 1_000_000
BASE = 1_704_067_200_000_000  # 2024-01-01T00:00:00Z in microseconds
# Frames whose documents share a file that is read whole: a few megabytes, so that opening files is not the work.
PER_FILE = 20_000
DAY = 86_400_000_000


def iso(t="t_us"):
    return F.date_format(F.timestamp_micros(F.col(t) + F.lit(BASE)), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def batch_documents(frames):
    """Telemetry documents of 200 frame ids per sensor, some items without a time."""
    item = F.struct(
        "bssid", "ssid", "channel", "rssi_dbm", "frequency_mhz", "security",
        F.struct("privacy", "wps", "pmf").alias("capabilities"), "vendor_oui",
        F.when(F.col("event_id") % 7 != 0, iso()).alias("timestamp"), "frame_type",
        F.col("src_addr").alias("mac_src"), F.col("event_id").alias("sequence_id"),
    )
    block = F.expr("event_id div 200")
    return frames.groupBy("sensor_id", block.alias("_b")).agg(F.sort_array(F.collect_list(F.struct("event_id", item.alias("i")))).alias("_i"), F.max("t_us").alias("t_us")).select(
        F.concat_ws(":", "sensor_id", F.col("_b").cast("string")).alias("batch_id"), "sensor_id", iso().alias("timestamp_utc"),
        F.col("_b").alias("sequence_number"), iso().alias("received_at"), F.transform("_i", lambda x: x["i"]).alias("items"),
    )


@query("s01_read_telemetry", with_frames(f"""
select sensor_id || ':' || cast(event_id // 200 as varchar) as batch_id, sensor_id, event_id // 200 as sequence_number,
  event_id as sequence_id, case when event_id % 7 = 0 then cast({BASE} as bigint) else {BASE} + t_us end as ts_us,
  bssid, ssid, channel, rssi_dbm, frame_type, privacy
from frames"""))
def s01(spark, sf):
    path = shared_dir(spark, "batches")
    docs = batch_documents(load_frames(spark, sf))
    docs.select(F.to_json(F.struct("*")).alias("value")).write.option("compression", "gzip").text(path)
    rows = ingest.read_telemetry(spark, path, now=F.timestamp_micros(F.lit(BASE)))
    return rows.select(
        "batch_id", "sensor_id", "sequence_number", "sequence_id", F.unix_micros("ts").alias("ts_us"), "bssid", "ssid",
        "channel", "rssi_dbm", "frame_type", "capabilities.privacy",
    )


def damaged(frames):
    """Frames with some fields broken on purpose."""
    e = F.col("event_id")
    return frames.withColumns({
        "bssid": F.when(e % 11 == 0, F.replace("bssid", F.lit(":"), F.lit("-"))).otherwise(F.col("bssid")),
        "rssi_dbm": F.when(e % 13 == 0, 20).when(e % 17 == 0, F.lit(None)).otherwise(F.col("rssi_dbm")),
        "channel": F.when(e % 19 == 0, 200).otherwise(F.col("channel")),
        "frequency_mhz": F.when(e % 23 == 0, 900).when(e % 29 == 0, F.lit(None)).otherwise(F.col("frequency_mhz")),
        "frame_type": F.when(e % 31 == 0, "bogus").otherwise(F.col("frame_type")),
    })


@query("s02_validate", with_frames("""
select event_id, concat_ws('|', case when event_id % 11 = 0 then 'bssid' end,
  case when event_id % 13 = 0 or event_id % 17 = 0 then 'rssi_dbm' end, case when event_id % 19 = 0 then 'channel' end,
  case when event_id % 23 = 0 then 'frequency_mhz' end, case when event_id % 31 = 0 then 'frame_type' end) as reject_reasons,
  (event_id % 11 <> 0 and event_id % 13 <> 0 and event_id % 17 <> 0 and event_id % 19 <> 0 and event_id % 23 <> 0 and event_id % 31 <> 0) as accepted
from frames"""))
def s02(spark, sf):
    good, bad = ingest.validate(damaged(load_frames(spark, sf)))
    return good.select("event_id", F.lit("").alias("reject_reasons"), F.lit(True).alias("accepted")).unionByName(
        bad.select("event_id", F.array_join("reject_reasons", "|").alias("reject_reasons"), F.lit(False).alias("accepted"))
    )


@query("s03_dedup_batches", with_frames("""
select sensor_id, cast(event_id // 12 as bigint) as batch_id, min(t_us) as received_us, arg_min(event_id, t_us) as event_id, count(*) - 1 as duplicates
from frames group by sensor_id, event_id // 12"""))
def s03(spark, sf):
    uploads = load_frames(spark, sf).select("sensor_id", F.expr("event_id div 12").alias("batch_id"), F.col("t_us").alias("received_us"), "event_id")
    return ingest.dedup_batches(uploads, "received_us")


@query("s04_audit_sequence", with_frames("""
select sensor_id, event_id, sequence_number, last_accepted, coalesce(sequence_number <= last_accepted, false) as replayed,
  abs(received_us - sent_us) > 5000000 as drifted
from (select *, max(sequence_number) over (partition by sensor_id order by received_us, sequence_number rows between unbounded preceding and 1 preceding) as last_accepted
  from (select sensor_id, event_id, t_us as received_us, t_us - (rssi_dbm * 100000) as sent_us,
          event_id - case when event_id % 5 = 0 then 40 else 0 end as sequence_number from frames))"""))
def s04(spark, sf):
    f = load_frames(spark, sf)
    uploads = f.select(
        "sensor_id", "event_id", F.col("t_us").alias("received_us"), (F.col("t_us") - F.col("rssi_dbm") * 100000).alias("sent_us"),
        (F.col("event_id") - F.when(F.col("event_id") % 5 == 0, 40).otherwise(0)).alias("sequence_number"),
    )
    return ingest.audit_upload_sequence(uploads, 5.0).select("sensor_id", "event_id", "sequence_number", "last_accepted", "replayed", "drifted")


def _array(name, value):
    return F.when(value.isNotNull(), F.array(value.cast("string"))).alias(name)


@query("s05_read_tshark", with_frames("""
select upper(bssid) as bssid, coalesce(ssid, '<Hidden>') as ssid, case when event_id % 9 = 0 then -100 else rssi_dbm end as rssi,
  case when event_id % 10 = 0 then 0 else channel end as channel, eapol_message is not null as handshake_captured, count(*) as n
from frames where event_id % 8 <> 0 group by all"""))
def s05(spark, sf):
    path = shared_dir(spark, "tshark")
    e = F.col("event_id")
    layers = F.struct(
        _array("wlan.bssid", F.when(e % 8 != 0, F.lower("bssid"))), _array("wlan.ssid", F.col("ssid")),
        _array("radiotap.dbm_antsignal", F.when(e % 9 != 0, F.col("rssi_dbm"))),
        _array("wlan.ds.current_channel", F.when(e % 10 != 0, F.col("channel"))),
        _array("eapol.keydes.type", F.col("eapol_message")),
    )
    packets = load_frames(spark, sf).select(F.expr(f"event_id div {PER_FILE}").alias("b"), F.struct(F.struct(layers.alias("layers")).alias("_source")).alias("p"))
    packets.groupBy("b").agg(F.to_json(F.collect_list("p")).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return imports.read_tshark(spark, path).groupBy("bssid", "ssid", "rssi", "channel", "handshake_captured").agg(F.count("*").alias("n"))


def capture_bytes(frames, per_file: int = 200):
    """All frames as capture file contents, built with SQL byte expressions; a folder per sensor."""
    le = lambda c, n: F.concat(*[F.substring(F.lpad(F.hex(c), 2 * n, "0"), 2 * n - 1 - 2 * i, 2) for i in range(n)])
    c, t = F.col, F.col("frame_type")
    raw_mac = lambda m: F.replace(m, F.lit(":"), F.lit(""))
    kind = F.when(t.isin("data", "eapol"), 2).when(t == "rts", 1).otherwise(0)
    sub = F.when(t == "beacon", 8).when(t == "probe_resp", 5).when(t == "probe_req", 4).when(t.isin("auth", "rts"), 11).when(t == "disassoc", 10).when(t == "deauth", 12).when(t == "eapol", 8).otherwise(0)
    flags = F.when(c("retry"), 0x0800).otherwise(0) + F.when(c("wep_iv").isNotNull(), 0x4000).otherwise(0)
    control = le((sub * 16 + kind * 4 + flags).cast("bigint"), 2)
    name = F.coalesce(c("ssid"), F.lit(""))
    rsn = F.concat(F.lit("30140100000FAC040100000FAC040100000FAC02"), F.when(c("pmf"), "C000").otherwise("0000"))
    secured = F.when(c("security").isin("WPA2", "WPA3"), rsn).when(c("security") == "WPA", "DD040050F201").otherwise("")
    tags = F.concat(F.lit("00"), F.lpad(F.hex(F.length(name)), 2, "0"), F.hex(F.encode(name, "utf-8")), F.lit("0301"), F.lpad(F.hex(c("channel")), 2, "0"))
    caps = (F.lit(1) + F.when(c("privacy"), 16).otherwise(0)).cast("bigint")
    fixed = F.concat(F.lit("0000000000000000"), le(F.coalesce(c("beacon_interval"), F.lit(100)), 2), le(caps, 2))
    keys = F.get(F.array(*[F.lit(x) for x in ("008A", "010A", "13CA", "030A")]), (c("eapol_message") - 1).cast("int"))
    body = F.when(t.isin("beacon", "probe_resp"), F.concat(fixed, tags, secured, F.when(c("wps"), "DD040050F204").otherwise(""))).when(t == "probe_req", tags)
    body = body.when(t == "auth", F.lit("000001000000")).when(t.isin("deauth", "disassoc"), F.lit("0700")).when(t == "eapol", F.concat(F.lit("0000AAAA03000000888E0203005F02"), keys))
    body = body.when(t == "data", F.concat("wep_iv", F.lit("00"), F.repeat(F.lit("00"), (c("frame_len") - 43).cast("int")))).otherwise("")
    tap = F.concat(F.lit("00000f002e0000000002"), le(c("frequency_mhz").cast("bigint"), 2), F.lit("a000"), F.lpad(F.hex(c("rssi_dbm") + 256), 2, "0"))
    third = F.when(t != "rts", F.concat(raw_mac("bssid"), le(c("seq_num") * 16, 2))).otherwise("")
    frame = F.concat(tap, control, F.lit("0000"), raw_mac("dst_addr"), raw_mac("src_addr"), third, body)
    size = F.expr("cast(length(_hex) / 2 as bigint)")
    recs = frames.withColumn("_hex", frame).select(
        "sensor_id", F.expr(f"event_id div {per_file}").alias("_file"), "event_id",
        F.concat(le(F.expr("t_us div 1000000"), 4), le(F.col("t_us") % S, 4), le(size, 4), le(size, 4), F.col("_hex")).alias("rec"),
    )
    head = "D4C3B2A1020004000000000000000000FFFF00007F000000"
    return recs.groupBy("sensor_id", "_file").agg(F.sort_array(F.collect_list(F.struct("event_id", "rec"))).alias("r")).select(
        F.concat("sensor_id", F.lit("/capture-"), F.col("_file").cast("string"), F.lit(".pcap")).alias("path"),
        F.unhex(F.concat(F.lit(head), F.array_join(F.transform("r", lambda x: x["rec"]), ""))).alias("content"),
    )


@query("s06_decode_captures", with_frames("""
select t_us, case frame_type when 'eapol' then 'data' else frame_type end as frame_type, case when frame_type <> 'rts' then bssid end as bssid, src_addr, dst_addr,
  case when frame_type <> 'rts' then seq_num end as seq_num, retry, rssi_dbm, frequency_mhz,
  case when frame_type in ('beacon', 'probe_resp', 'probe_req') then coalesce(ssid, '') end as ssid,
  case when frame_type in ('beacon', 'probe_resp', 'probe_req') then channel end as channel,
  case when frame_type in ('beacon', 'probe_resp') then coalesce(beacon_interval, 100) end as beacon_interval,
  case when frame_type in ('beacon', 'probe_resp') then privacy when wep_iv is not null then true end as privacy,
  case when frame_type in ('deauth', 'disassoc') then 7 end as reason_code, eapol_message, wep_iv,
  case when frame_type in ('beacon', 'probe_resp') then concat_ws('|', 'SSID', 'DS', case when security in ('WPA2', 'WPA3') then 'RSN' when security = 'WPA' then 'WPA' end, case when wps then 'WPS' end)
       when frame_type = 'probe_req' then 'SSID|DS' end as ies
from frames"""))
def s06(spark, sf):
    return captures.decode_captures(capture_bytes(load_frames(spark, sf))).select(
        "t_us", "frame_type", "bssid", "src_addr", "dst_addr", "seq_num", "retry", "rssi_dbm", "frequency_mhz", "ssid", "channel", "beacon_interval", "privacy", "reason_code", "eapol_message", "wep_iv",
        F.array_join("ies_present", "|").alias("ies"),
    )


def captured(spark, sf):
    decoded = captures.decode_captures(capture_bytes(load_frames(spark, sf)))
    return captures.capture_frames(decoded, F.substring_index("path", "/", 1))


@query("s06_capture_frames", with_frames("""
select t_us, sensor_id, frame_type, case when frame_type <> 'rts' then bssid end as bssid, case when frame_type <> 'rts' then vendor_oui end as vendor_oui,
  case when frame_type in ('beacon', 'probe_resp', 'probe_req') then coalesce(ssid, '') end as ssid, src_addr, dst_addr, channel, frequency_mhz, rssi_dbm,
  case when frame_type in ('beacon', 'probe_resp') then security end as security, case when frame_type in ('beacon', 'probe_resp') then privacy when wep_iv is not null then true end as privacy,
  wps and frame_type in ('beacon', 'probe_resp') as wps, pmf and frame_type in ('beacon', 'probe_resp') as pmf, case when frame_type <> 'rts' then seq_num end as seq_num, retry,
  eapol_message, wep_iv, case when frame_type = 'data' then frame_len end as frame_len, case when frame_type in ('beacon', 'probe_resp') then coalesce(beacon_interval, 100) end as beacon_interval
from frames"""))
def s06_frames(spark, sf):
    return captured(spark, sf).drop("event_id", "ies_present").withColumn("frame_len", F.when(F.col("frame_type") == "data", F.col("frame_len")))


@query("s07_read_wardrive", with_frames("""
select sensor_id, bssid, count(*) as sightings, count(*) filter (event_id % 6 <> 0) as fixes, max(t_us) as last_us,
  min(case when event_id % 6 <> 0 then 10 + (event_id % 100) / 1e3 end) as min_lat
from frames where frame_type = 'beacon' group by all"""))
def s07(spark, sf):
    path = shared_dir(spark, "wardrive")
    e = F.col("event_id")
    sight = F.struct(
        iso().alias("timestamp"), "bssid", "ssid", "rssi_dbm", "channel", "security",
        F.when(e % 6 != 0, F.struct((F.lit(10) + (e % 100) / 1000).cast("string").alias("lat"), F.lit("106.5").alias("lon"))).alias("gps"),
    )
    load_frames(spark, sf).filter("frame_type = 'beacon'").groupBy("sensor_id", F.expr(f"event_id div {PER_FILE}").alias("b")).agg(
        F.collect_list(sight).alias("sightings")
    ).select(F.to_json(F.struct("sensor_id", "sightings")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    rows = imports.read_wardrive(spark, path)
    return rows.groupBy("sensor_id", "bssid").agg(
        F.count("*").alias("sightings"), F.count_if("has_fix").alias("fixes"),
        (F.unix_micros(F.max("ts")) - F.lit(BASE)).alias("last_us"), F.min("lat").alias("min_lat"),
    )


@query("s08_read_airodump", with_frames("select distinct bssid from frames"))
def s08(spark, sf):
    path = shared_dir(spark, "airodump")
    f = load_frames(spark, sf)
    block = F.expr(f"event_id div {PER_FILE}").alias("b")
    aps = f.groupBy(block).agg(F.array_join(F.collect_set(F.concat(F.lower("bssid"), F.lit(", 2024-01-01, 6"))), "\r\n").alias("a"))
    stations = f.groupBy(block).agg(F.array_join(F.collect_set(F.concat("src_addr", F.lit(", 2024-01-01"))), "\r\n").alias("s"))
    text = F.concat(F.lit("\r\nBSSID, First time seen, channel\r\n"), "a", F.lit("\r\nshort, row\r\n\r\nStation MAC, First time seen\r\n"), "s")
    aps.join(stations, "b").select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return imports.read_airodump(spark, path)


@query("s09_read_labelled", with_frames("""
select event_id, bssid, rssi_dbm, case when frame_type = 'deauth' then 'deauth_flood' else 'benign' end as label, rssi_dbm / 1e1 as f_rssi_zscore, privacy
from frames"""))
def s09(spark, sf):
    path = shared_dir(spark, "labelled")
    rec = F.struct(
        F.col("event_id").cast("string").alias("id"), "bssid", "rssi_dbm", F.struct("privacy", "wps", "pmf").alias("capabilities"),
        F.when(F.col("frame_type") == "deauth", "deauth_flood").otherwise("benign").alias("label"),
        F.struct((F.col("rssi_dbm") / 10).alias("rssi_zscore")).alias("features"),
    )
    load_frames(spark, sf).groupBy(F.expr(f"event_id div {PER_FILE}")).agg(F.to_json(F.struct(F.collect_list(rec).alias("records"))).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return imports.read_labelled(spark, path).select(F.col("id").cast("bigint").alias("event_id"), "bssid", "rssi_dbm", "label", "f_rssi_zscore", "capabilities.privacy")


def sightings(frames):
    return frames.filter("ssid is not null").select(
        "bssid", "ssid", "channel", F.col("rssi_dbm").alias("rssi"), F.col("security").alias("encryption"),
        F.col("vendor_oui").alias("vendor"), "wps", F.col("pmf").alias("handshake_captured"),
        (F.col("rssi_dbm") + 100).alias("risk_score"), "t_us", "event_id",
    )


@query("s10_upsert_networks", with_frames("""
select bssid, ssid, arg_min(channel, t_us) as channel, min(security) as encryption, arg_max(rssi_dbm, t_us) as rssi, arg_max(rssi_dbm, t_us) + 100 as risk_score,
  max(cast(wps as int)) as wps, max(cast(pmf as int)) as handshake_captured, count(*) as beacon_count, min(t_us) as first_seen, max(t_us) as last_seen
from frames where ssid is not null group by bssid, ssid"""))
def s10(spark, sf):
    s = sightings(load_frames(spark, sf))
    old = sinks.upsert_networks(None, s.filter("event_id % 2 = 0"))
    return sinks.upsert_networks(old, s.filter("event_id % 2 = 1")).drop("vendor")


@query("s11_append_events", with_frames("""
select 'probe' as event_type, 'LOW' as severity, src_addr as sender, bssid, event_id, t_us from frames where frame_type = 'probe_req'"""))
def s11(spark, sf):
    path = shared_dir(spark, "events")
    alerts = load_frames(spark, sf).filter("frame_type = 'probe_req'").select(
        F.lit("probe").alias("alert_type"), F.lit("LOW").alias("severity"), F.col("src_addr").alias("attacker"), "bssid", "event_id", "t_us"
    )
    sinks.append_events(alerts, path)
    got = spark.read.parquet(path)
    return got.select("event_type", "severity", "sender", "bssid", F.get_json_object("details", "$.event_id").cast("bigint").alias("event_id"), "t_us")


@query("s12_siem_feed", with_frames("""
select event_id, t_us, bssid, strftime(make_timestamp(t_us), '%Y-%m-%dT%H:%M:%S.%fZ') as stamp
from frames where frame_type = 'deauth' and t_us > 1000000000"""))
def s12(spark, sf):
    alerts = load_frames(spark, sf).filter("frame_type = 'deauth'").select("event_id", "t_us", "bssid")
    feed = sinks.siem_feed(alerts, 1000 * S)
    return feed.select("event_id", "t_us", F.get_json_object("document", "$.bssid").alias("bssid"), F.get_json_object("document", "$['@timestamp']").alias("stamp"))


@query("s12_siem_splunk", with_frames("""
select event_id, t_us, bssid, t_us / 1e6 as sent from frames where frame_type = 'disassoc'"""))
def s12b(spark, sf):
    alerts = load_frames(spark, sf).filter("frame_type = 'disassoc'").select("event_id", "t_us", "bssid")
    feed = sinks.siem_feed(alerts, -1, "splunk")
    g = lambda p: F.get_json_object("document", p)
    return feed.select("event_id", "t_us", g("$.event.bssid").alias("bssid"), g("$.time").cast("double").alias("sent"))


@query("s13_prune", f"""
with o as (select o_orderkey, o_orderstatus, epoch_us(o_orderdate) as t from orders), m as (select max(t) as now from o)
select 'telemetry' as table_name, count(*) filter (t < now - 30 * {DAY}) as dropped, count(*) filter (not t < now - 30 * {DAY}) as kept from o, m
union all select 'jobs', count(*) filter (o_orderstatus = 'F' and t < now - 7 * {DAY}), count(*) filter (not (o_orderstatus = 'F' and t < now - 7 * {DAY})) from o, m
union all select 'audit', count(*) filter (t < now - 90 * {DAY}), count(*) filter (not t < now - 90 * {DAY}) from o, m
union all select 'alerts', count(*) filter (o_orderstatus = 'F' and t < now - 365 * {DAY}), count(*) filter (not (o_orderstatus = 'F' and t < now - 365 * {DAY})) from o, m""")
def s13(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    t = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    now = o.agg(F.max(t).alias("m")).first()["m"]  # one number
    done = F.when(F.col("o_orderstatus") == "F", F.lit("yes"))
    out = None
    for table, (_, column, only) in sinks.RETENTION.items():
        rows = o.select(t.alias(column), F.when(done.isNotNull(), only[1] if only else "x").otherwise("open").alias("status"))
        one = sinks.prune_counts(rows, table, now)
        out = one if out is None else out.unionByName(one)
    return out


@query("s13_prune_table", f"""
with o as (select o_orderkey, o_custkey, o_totalprice, case when o_orderstatus = 'F' then 'resolved' else 'open' end as status, epoch_us(o_orderdate) as t from orders),
m as (select max(t) as now from o)
select 'telemetry' as table_name, o_orderkey, o_custkey, o_totalprice, status, t from o, m where not t < now - 400 * {DAY}
union all select 'alerts', o_orderkey, o_custkey, o_totalprice, status, t from o, m where not (status = 'resolved' and t < now - 365 * {DAY})""")
def s13_table(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    t = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    now = o.agg(F.max(t).alias("m")).first()["m"]  # one number
    rows = o.select("o_orderkey", "o_custkey", "o_totalprice", F.when(F.col("o_orderstatus") == "F", "resolved").otherwise("open").alias("status"), t.alias("t"))
    out = None
    for name, days in (("telemetry", 400), ("alerts", 365)):
        path = shared_dir(spark, "stored")
        stored = rows.withColumn(sinks.RETENTION[name][1], F.col("t")).withColumn("event_date", F.date_trunc("month", F.timestamp_micros("t")).cast("date"))
        stored.repartition("event_date").write.partitionBy("event_date").parquet(path)
        sinks.prune_table(spark, path, name, now, days, period="month")
        kept = spark.read.schema(stored.schema).parquet(path).select(F.lit(name).alias("table_name"), *rows.columns)
        out = kept if out is None else out.unionByName(kept)
    return out


@query("s14_export_features", with_frames("""
select t_us, sensor_id, frame_type as label, cast(rssi_dbm as double) as rssi_dbm, cast(channel as double) as channel, case when privacy then 0e0 else 1e0 end as enc_open,
  0e0 as enc_wep, case when privacy and not pmf then 1e0 else 0e0 end as enc_wpa2, case when privacy and pmf then 1e0 else 0e0 end as enc_wpa3,
  case when coalesce(ssid, '') = '' then 1e0 else 0e0 end as is_hidden, case when wps then 1e0 else 0e0 end as wps_enabled
from frames"""))
def s14(spark, sf):
    from skyfence.operators.scoring import ml_features

    path = shared_dir(spark, "features")
    f = ml_features(load_frames(spark, sf)).select("*", F.col("t_us").alias("timestamp"), F.col("frame_type").alias("label"))
    sinks.export_features(f, path)
    ddl = "t_us bigint, sensor_id string, label string, " + ", ".join(f"{c} double" for c in sinks.FEATURES)
    return spark.read.schema(ddl).option("header", True).option("enforceSchema", True).csv(path)


@query("s14_export_telemetry", with_frames(f"""
select cast(make_timestamp({BASE} + t_us * 1000) as date) as event_date, sensor_id, count(*) as n, min(t_us) as lo, max(t_us) as hi from frames group by all"""))
def s14b(spark, sf):
    path = shared_dir(spark, "lake")
    f = load_frames(spark, sf)
    sinks.export_telemetry(f.withColumn("t_us", F.col("t_us") * 1000), path, BASE)
    return spark.read.parquet(path).groupBy("event_date", "sensor_id").agg(
        F.count("*").alias("n"), F.expr("min(t_us) div 1000").alias("lo"), F.expr("max(t_us) div 1000").alias("hi")
    )


@query("n01_canonicalise", with_frames(f"""
select event_id, bssid, ssid, case when event_id % 5 = 4 then {BASE} + event_id else {BASE} + t_us end as ts_us from frames"""))
def n01(spark, sf):
    e, c = F.col("event_id"), F.col
    bare = F.replace("bssid", F.lit(":"), F.lit(""))
    forms = F.when(e % 5 == 0, F.lower(F.replace("bssid", F.lit(":"), F.lit("-")))).when(e % 5 == 1, bare).when(
        e % 5 == 2, F.concat_ws(".", F.substring(bare, 1, 4), F.substring(bare, 5, 4), F.substring(bare, 9, 4))
    ).otherwise(F.lower("bssid"))
    naive = F.date_format(F.timestamp_micros(c("t_us") + BASE), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    epoch = ((c("t_us") + F.lit(BASE)).cast("decimal(20,0)") / 1000000).cast("decimal(20,6)").cast("string")
    messy = load_frames(spark, sf).select(
        "event_id", forms.alias("bssid"), F.concat(F.substring("ssid", 1, 2), F.lit("\x00"), F.substring("ssid", 3, 40)).alias("ssid"),
        F.when(e % 5 == 0, iso()).when(e % 5 == 1, F.lit("not a time")).alias("timestamp_utc"),
        F.when(e % 5 == 1, naive).when(e % 5 == 2, epoch).when(e % 5 == 3, F.concat(naive, F.lit("+00:00"))).alias("timestamp"),
        F.timestamp_micros(F.lit(BASE) + e).cast("string").alias("ingested_at"),
    )
    return N.canonicalise(messy).select("event_id", "bssid", "ssid", F.unix_micros("ts").alias("ts_us"))


@query("n02_pseudonymise", with_frames("""
select event_id, substr(bssid, 1, 8) || ':00:00:00' as bssid_oui,
  upper(regexp_replace(substr(sha256('pepper' || bssid), 1, 12), '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6')) as bssid_full,
  substr(sha256('pepper' || bssid), 1, 16) as bssid_hash, repeat('*', length(coalesce(ssid, ''))) as ssid_mask
from frames"""))
def n02(spark, sf):
    f = load_frames(spark, sf).select("event_id", "bssid", "ssid")
    part = N.pseudonymise(f, "oui", "pepper").select("event_id", F.col("bssid").alias("bssid_oui"))
    full = N.pseudonymise(f, "full", "pepper", "mask").select("event_id", F.col("bssid").alias("bssid_full"), "bssid_hash", F.col("ssid").alias("ssid_mask"))
    return part.join(full, "event_id")


VENDOR_CASE = """case vendor_oui when '00:22:6B' then 'Cisco' when '00:1F:33' then 'Netgear' when '14:CF:E2' then 'Apple'
  when '00:21:5D' then 'Intel' when '00:E0:4C' then 'Realtek' else 'Unknown' end"""


@query("n03_enrich_vendor", with_frames(f"""
select event_id, bssid, {VENDOR_CASE} as vendor, case vendor_oui when '00:22:6B' then 0e0 when '00:1F:33' then 3e-1 else 5e-1 end as vendor_risk from frames"""))
def n03(spark, sf):
    return N.enrich_vendor(load_frames(spark, sf)).select("event_id", "bssid", "vendor", "vendor_risk")


@query("n03_vendor_join", with_frames("""
select event_id, coalesce(n_name, 'Unknown') as vendor from frames
left join (select n_name, case n_nationkey when 0 then '00:22:6B' when 1 then '00:1F:33' when 2 then '14:CF:E2' when 3 then '00:21:5D' else 'FE:00:' || lpad(hex(n_nationkey), 2, '0') end as oui from nation) on oui = vendor_oui"""))
def n03b(spark, sf):
    f = load_frames(spark, sf)
    key = F.col("n_nationkey")
    oui = F.when(key == 0, "00:22:6B").when(key == 1, "00:1F:33").when(key == 2, "14:CF:E2").when(key == 3, "00:21:5D").otherwise(F.concat(F.lit("FE:00:"), F.lpad(F.hex(key), 2, "0")))
    dim = spark.read.parquet(f"{sf}/nation.parquet").select(oui.alias("oui"), F.col("n_name").alias("vendor"))
    return N.enrich_vendor(f, dim).select("event_id", "vendor")


@query("n04_enrich_radio", with_frames("""
select event_id, frequency_mhz as channel_mhz, channel as mhz_channel, case frame_type when 'data' then 'data' when 'eapol' then 'data' when 'rts' then 'control' else 'management' end as type_name,
  case frame_type when 'eapol' then 'qos_data' else frame_type end as subtype_name,
  case when event_id % 4 = 0 then 'unknown (99)' when event_id % 4 = 1 then 'unspecified' when event_id % 4 = 2 then 'prev_auth_not_valid' else 'deauth_leaving' end as reason_name,
  case event_id % 5 when 0 then 'use_group' when 1 then 'wep40' when 2 then 'tkip' when 3 then 'reserved' else 'ccmp' end as cipher_name,
  case event_id % 5 when 0 then 'unknown' when 1 then '8021x' when 2 then 'psk' when 3 then 'ft_8021x' else 'ft_psk' end as akm_name
from frames"""))
def n04(spark, sf):
    t = F.col("frame_type")
    sub = F.when(t == "beacon", 8).when(t == "probe_resp", 5).when(t == "probe_req", 4).when(t == "auth", 11).when(t == "disassoc", 10).when(t == "deauth", 12).when(t == "rts", 11).when(t == "eapol", 8).when(t == "data", 0)
    e = F.col("event_id")
    coded = load_frames(spark, sf).withColumns({
        "subtype_code": sub, "type_code": F.when(t == "rts", 1).when(t.isin("data", "eapol"), 2).otherwise(0),
        "reason_code": F.when(e % 4 == 0, 99).otherwise((e % 4).cast("int")), "cipher_code": (e % 5).cast("int"), "akm_code": (e % 5).cast("int"),
    })
    return N.enrich_radio(coded).select("event_id", "channel_mhz", "mhz_channel", "type_name", "subtype_name", "reason_name", "cipher_name", "akm_name")


@query("n05_classify_security", with_frames("""
select event_id, case security when 'WPA3' then 'WPA3' when 'WPA2' then 'WPA2' when 'WPA' then 'WPA' when 'WEP' then 'WEP' else 'OPEN' end as live_class,
  case when security = 'Open' then 'OPEN' else security end as twin_class,
  case when security in ('WPA3', 'WPA2') then security when security = 'Open' then 'Open' else 'WEP' end as audit_class
from frames"""))
def n05(spark, sf):
    s = F.col("security")
    caps = load_frames(spark, sf).select(
        "event_id", "privacy", "pmf", s.isin("WPA2", "WPA3").alias("has_rsn"), (s == "WPA").alias("has_wpa"),
        F.when(s == "WPA3", F.array(F.lit("SAE"))).when(s == "WPA2", F.array(F.lit("PSK"))).alias("akm"),
        (s == "WPA3").alias("wpa3"), (s == "WPA2").alias("wpa2"),
    )
    out = N.classify_security(caps, "live", "live_class")
    out = N.classify_security(out, "twin", "twin_class")
    return N.classify_security(out, "audit", "audit_class").select("event_id", "live_class", "twin_class", "audit_class")


@query("n06_dedup_frames", with_frames("""
select event_id, t_us, bssid, frame_type from kept
union all select event_id, t_us, bssid, frame_type from frames where frame_type in ('deauth', 'disassoc')""", fold_ctes("""
select event_id, t_us, bssid, event_id % 2 as seq, frame_type, coalesce(ssid, '') as name from frames where frame_type not in ('deauth', 'disassoc')""",
    "bssid, seq, frame_type, name", 5 * S), recursive=True))
def n06(spark, sf):
    f = load_frames(spark, sf).withColumn("seq_num", F.col("event_id") % 2)
    return N.dedup_frames(f).select("event_id", "t_us", "bssid", "frame_type")


@query("n07_normalise_alerts", with_frames("""
select 'unknown' as alert_type, 'MEDIUM' as severity, 'Alert: unknown' as title, '' as description, 'unknown' as sensor_id, event_id, cast(rssi_dbm as varchar) as level from frames where frame_type = 'rts'
union all select 'wps', 'LOW', 'WPS on', 'seen', sensor_id, event_id, null from frames where wps"""))
def n07(spark, sf):
    f = load_frames(spark, sf)
    a = f.filter("frame_type = 'rts'").select("event_id", "t_us", "rssi_dbm")
    b = f.filter("wps").select(F.lit("wps").alias("alert_type"), F.lit("low").alias("severity"), F.lit("WPS on").alias("title"), F.lit("seen").alias("description"), "sensor_id", "event_id", "t_us")
    out = normalise_alerts(a, b)
    return out.select("alert_type", "severity", "title", "description", "sensor_id", "event_id", F.get_json_object("evidence", "$.rssi_dbm").alias("level"))
