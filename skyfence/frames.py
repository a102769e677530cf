"""The canonical frame table and its projection over an ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

US = 1_000_000

FRAMES_DDL = (
    "event_id bigint, t_us bigint, sensor_id string, frame_type string, bssid string, "
    "vendor_oui string, ssid string, src_addr string, dst_addr string, channel int, "
    "frequency_mhz int, rssi_dbm bigint, security string, privacy boolean, wps boolean, "
    "pmf boolean, seq_num bigint, retry boolean, eapol_message bigint, wep_iv string, "
    "frame_len bigint, beacon_interval bigint"
)

# One text for Spark and for the SQL oracle; only {epoch_us} differs between the engines.
FRAMES_SQL = """
with e0 as (
  select event_id, user_id, event_type, value, {epoch_us} - 1704067200000000 as us0,
         cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k
  from {events}),
e1 as (
  select *, cast((us0 - us0 % 1000) / 1000 as bigint) as t_us, user_id % 50 as b,
         user_id % 12 as st, cast(floor(value) as bigint) as v
  from e0),
e2 as (
  select *, case b % 6 when 0 then '00:22:6B' when 1 then '00:1F:33' when 2 then '14:CF:E2'
                       when 3 then '00:21:5D' when 4 then '00:E0:4C' else 'DE:AD:BE' end as vendor_oui,
         cast((b - b % 3) / 3 as bigint) % 5 as sec,
         case when event_type = 'view' then 'beacon'
              when event_type = 'click' then 'probe_req'
              when event_type = 'purchase' and k < 50 then 'probe_resp'
              when event_type = 'purchase' then 'data'
              when event_type = 'signup' and k < 60 then 'eapol'
              when event_type = 'signup' then 'auth'
              when event_type = 'error' and k < 60 then 'deauth'
              when event_type = 'error' and k < 80 then 'disassoc'
              else 'rts' end as frame_type
  from e1),
e3 as (
  select *, concat(vendor_oui, ':00:00:', lpad(hex(b), 2, '0')) as bssid,
         concat('02:00:00:00:00:', lpad(hex(st), 2, '0')) as station
  from e2)
select event_id, t_us, concat('sensor-', cast(event_id % 4 as varchar(20))) as sensor_id, frame_type, bssid, vendor_oui,
  case when frame_type = 'probe_req' then concat('net-', cast(k % 20 as varchar(20)))
       when frame_type not in ('beacon', 'probe_resp') or k % 25 = 0 then null
       when b % 10 = 9 then concat('net-', cast(k % 7 as varchar(20)))
       else concat('net-', cast(b % 20 as varchar(20))) end as ssid,
  case when frame_type = 'eapol' and k % 4 in (0, 2) then bssid when frame_type in ('beacon', 'probe_resp', 'deauth', 'disassoc') then bssid else station end as src_addr,
  case when frame_type = 'eapol' and k % 4 in (1, 3) then bssid when frame_type in ('beacon', 'probe_req') or k % 3 = 0 then 'FF:FF:FF:FF:FF:FF' else station end as dst_addr,
  case k % 5 when 0 then 1 when 1 then 6 when 2 then 11 when 3 then 36 else 44 end as channel,
  case k % 5 when 0 then 2412 when 1 then 2437 when 2 then 2462 when 3 then 5180 else 5220 end as frequency_mhz,
  -30 - v % 60 as rssi_dbm,
  case sec when 0 then 'Open' when 1 then 'WEP' when 2 then 'WPA' when 3 then 'WPA2' else 'WPA3' end as security,
  sec <> 0 as privacy, b % 4 = 0 as wps, sec = 4 as pmf, event_id % 4096 as seq_num, k % 3 = 0 as retry,
  case when frame_type = 'eapol' then 1 + k % 4 end as eapol_message,
  case when frame_type = 'data' then lpad(hex(k % 8), 6, '0') end as wep_iv,
  case when frame_type = 'data' then 60 + v % 200 end as frame_len,
  case when frame_type = 'beacon' then 100 + (case when b % 7 = 0 then v % 40 else 0 end) end as beacon_interval
from e3
"""

SPARK_EPOCH = "unix_micros(cast(ts as timestamp))"
DUCK_EPOCH = "epoch_us(ts)"


def frames_from_events(events: DataFrame) -> DataFrame:
    """Project an ``events`` table onto frames (time compressed a thousandfold)."""
    text = FRAMES_SQL.format(epoch_us=SPARK_EPOCH, events="{events}")
    return events.sparkSession.sql(text, events=events)


def load_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def duck_frames() -> str:
    """The same projection for the SQL oracle, as a parenthesised subquery body."""
    return FRAMES_SQL.format(epoch_us=DUCK_EPOCH, events="events")
