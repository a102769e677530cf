"""Readers for files made by other capture tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TSHARK_DDL = (
    "_source struct<layers: struct<`wlan.bssid`: array<string>, `wlan.ssid`: array<string>, "
    "`radiotap.dbm_antsignal`: array<string>, `wlan.ds.current_channel`: array<string>, `eapol.keydes.type`: array<string>>>"
)
WARDRIVE_DDL = (
    "sensor_id string, start_time string, end_time string, total_sightings bigint, unique_networks bigint, "
    "sightings array<struct<timestamp:string,bssid:string,ssid:string,rssi_dbm:int,channel:int,security:string,"
    "gps:struct<lat:string,lon:string>,sensor_id:string>>"
)
LABELLED_DDL = (
    "records array<struct<id:string,timestamp_utc:string,sensor_id:string,bssid:string,ssid:string,channel:int,"
    "frequency_mhz:int,rssi_dbm:int,vendor_oui:string,encryption:string,"
    "capabilities:struct<privacy:boolean,wps:boolean,pmf:boolean,ess:boolean>,beacon_interval:int,ie_count:int,"
    "vendor_ie_count:int,label:string,label_confidence:double,label_source:string,label_notes:string,"
    "features:struct<rssi_zscore:double,duplicate_ssid_count:int,vendor_mismatch:boolean,security_mismatch:boolean,"
    "beacon_jitter:double,is_new_appearance:boolean,ie_anomaly_score:double>>>"
)


def read_tshark(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``tshark -T json`` dumps (a JSON array per file, or one object per line)."""
    docs = spark.read.schema(TSHARK_DDL).option("multiLine", True).json(path)
    first = lambda name: F.try_element_at(F.col(f"_source.layers.`{name}`"), F.lit(1))
    return docs.select(
        F.upper(first("wlan.bssid")).alias("bssid"),
        F.coalesce(first("wlan.ssid"), F.lit("<Hidden>")).alias("ssid"),
        F.coalesce(first("radiotap.dbm_antsignal").cast("int"), F.lit(-100)).alias("rssi"),
        F.coalesce(first("wlan.ds.current_channel").cast("int"), F.lit(0)).alias("channel"),
        F.col("_source.layers.`eapol.keydes.type`").isNotNull().alias("handshake_captured"),
    ).filter(F.col("bssid").isNotNull() & (F.col("bssid") != ""))


def read_wardrive(spark: SparkSession, path: str) -> DataFrame:
    """One row per sighting of each session file; ``has_fix`` tells whether both coordinates are numbers."""
    docs = spark.read.schema(WARDRIVE_DDL).option("multiLine", True).json(path)
    rows = docs.select(F.col("sensor_id").alias("session_sensor"), F.posexplode("sightings").alias("position", "s"))
    lat, lon = F.col("s.gps.lat").try_cast("double"), F.col("s.gps.lon").try_cast("double")
    return rows.select(
        "session_sensor", "position", F.try_to_timestamp(F.col("s.timestamp")).alias("ts"), "s.bssid", "s.ssid",
        "s.rssi_dbm", "s.channel", "s.security", lat.alias("lat"), lon.alias("lon"),
        (lat.isNotNull() & lon.isNotNull()).alias("has_fix"), F.coalesce("s.sensor_id", "session_sensor").alias("sensor_id"),
    )


def read_airodump(spark: SparkSession, path: str) -> DataFrame:
    """Distinct access point addresses of two-section CSV files (stations follow a ``Station MAC`` header)."""
    files = spark.read.text(path, wholetext=True)
    upper = F.split(F.col("value"), "Station MAC", 2)[0]
    body = F.split(upper, "BSSID", 2)
    lines = files.filter(F.size(body) > 1).select(F.explode(F.split(body[1], "\r?\n")).alias("line"))
    ap = lines.select(F.upper(F.trim(F.split("line", ",")[0])).alias("bssid"))
    return ap.filter((F.length("bssid") == 17) & (F.length(F.regexp_replace("bssid", "[^:]", "")) == 5)).distinct()


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Labelled records with their feature struct flattened to ``f_<name>`` columns."""
    docs = spark.read.schema(LABELLED_DDL).option("multiLine", True).json(path)
    rows = docs.select(F.explode("records").alias("r")).select("r.*")
    feats = rows.schema["features"].dataType.names
    return rows.select(*[c for c in rows.columns if c != "features"], *[F.col(f"features.{f}").alias(f"f_{f}") for f in feats])
