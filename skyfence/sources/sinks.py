"""Tables and files written out: upserts, appends, feeds, retention, exports."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def upsert_networks(current: DataFrame | None, updates: DataFrame) -> DataFrame:
    """Merge sightings into the (bssid, ssid) table.

    The latest sighting gives rssi, last seen and risk; beacon counts add up; WPS and handshake
    stay set once seen; the first sighting's descriptive columns and first_seen stay.
    ``updates`` columns: bssid, ssid, channel, rssi, encryption, vendor, wps, handshake_captured, risk_score, t_us.
    """
    facts = ["channel", "encryption", "vendor"]
    latest = ["rssi", "risk_score"]
    fresh = updates.select(
        "bssid", "ssid", *facts, *latest, F.col("wps").cast("int").alias("wps"),
        F.col("handshake_captured").cast("int").alias("handshake_captured"),
        F.lit(1).cast("bigint").alias("beacon_count"), F.col("t_us").alias("first_seen"), F.col("t_us").alias("last_seen"),
    )
    both = fresh if current is None else fresh.unionByName(current.select(*fresh.columns))
    merged = both.groupBy("bssid", "ssid").agg(
        F.min(F.struct("first_seen", *facts)).alias("_first"),
        F.max(F.struct("last_seen", *latest)).alias("_last"),
        F.max("wps").alias("wps"), F.max("handshake_captured").alias("handshake_captured"),
        F.sum("beacon_count").alias("beacon_count"),
    )
    return merged.select("bssid", "ssid", "_first.*", "_last.*", "wps", "handshake_captured", "beacon_count")


def security_events(alerts: DataFrame) -> DataFrame:
    """Event rows with the whole alert as JSON."""
    pick = lambda n: F.col(n) if n in alerts.columns else F.lit(None).cast("string")
    return alerts.select(
        F.col("alert_type").alias("event_type"), "severity", pick("attacker").alias("sender"), pick("client").alias("target"),
        "bssid", F.to_json(F.struct(*alerts.columns)).alias("details"), "t_us",
    )


def append_events(alerts: DataFrame, path: str) -> None:
    out = security_events(alerts).withColumn("event_date", F.to_date(F.timestamp_micros("t_us")))
    out.write.mode("append").partitionBy("event_date").parquet(path)


def siem_feed(alerts: DataFrame, cursor_us: int, shape: str = "elastic", t: str = "t_us") -> DataFrame:
    """Documents of the alerts after the cursor, oldest first. Its largest ``t_us`` is the next cursor."""
    new = alerts.filter(F.col(t) > cursor_us)
    stamp = F.date_format(F.timestamp_micros(t), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    body = F.struct(*alerts.columns)
    if shape == "elastic":
        doc = F.to_json(F.struct(*alerts.columns, stamp.alias("@timestamp")))
    elif shape == "splunk":
        doc = F.to_json(F.struct(body.alias("event"), F.lit("wids:alert").alias("sourcetype"), (F.col(t) / 1e6).alias("time")))
    else:
        raise ValueError(f"unknown shape {shape!r}")
    ties = [c for c in ("event_id",) if c in alerts.columns]
    return new.select(F.col(t), *ties, doc.alias("document")).orderBy(t, *ties)


# Days kept, time column, and what may be dropped at all.
RETENTION = {
    "telemetry": (30, "ingested_us", None),
    "jobs": (7, "received_us", ("status", "done")),
    "audit": (90, "t_us", None),
    "alerts": (365, "created_us", ("status", "resolved")),
}


def expired(table: str, now_us: int, days: int | None = None) -> Column:
    keep, column, only = RETENTION[table]
    old = F.col(column) < F.lit(now_us - (keep if days is None else days) * DAY_US)
    return F.coalesce(old & (F.col(only[0]) == only[1]) if only else old, F.lit(False))


def prune(df: DataFrame, table: str, now_us: int, days: int | None = None) -> DataFrame:
    """Rows that stay."""
    return df.filter(~expired(table, now_us, days))


def prune_counts(df: DataFrame, table: str, now_us: int, days: int | None = None) -> DataFrame:
    gone = expired(table, now_us, days)
    return df.agg(F.count_if(gone).alias("dropped"), F.count_if(~gone).alias("kept")).select(F.lit(table).alias("table_name"), "dropped", "kept")


def prune_table(spark: SparkSession, path: str, table: str, now_us: int, days: int | None = None, period: str = "day") -> dict[str, list[str]]:
    """Prune a table stored by ``event_date`` in place; the dates dropped, rewritten and left.

    ``event_date`` is the first day of the ``period`` (day or month) that the table's time column lies in. Periods wholly behind
    the limit are deleted without being read where every old row may go; where only some may (open alerts stay), and in the period
    that the limit falls into, the rows that stay are written anew. Younger periods are not touched.
    """
    from skyfence.session import shared_dir
    from skyfence.sources.networks import Files

    keep, _, only = RETENTION[table]
    limit = datetime(1970, 1, 1) + timedelta(microseconds=now_us - (keep if days is None else days) * DAY_US)

    def end(day: str) -> datetime:
        begin = datetime.fromisoformat(day)
        return begin + timedelta(days=1) if period == "day" else (begin.replace(day=1) + timedelta(days=32)).replace(day=1)

    files = Files(spark, path)
    dates = sorted(n[11:] for n in files.names("") if n.startswith("event_date=") and n[11:12].isdigit())
    old = [d for d in dates if datetime.fromisoformat(d) < limit]
    dropped = [d for d in old if only is None and end(d) <= limit]
    rewritten = [d for d in old if d not in set(dropped)]
    for d in dropped:
        files.drop(f"event_date={d}")
    if rewritten:
        rows = spark.read.parquet(path).where(F.col("event_date").cast("string").isin(rewritten))
        draft = shared_dir(spark, "prune")
        prune(rows, table, now_us, days).write.partitionBy("event_date").parquet(draft)
        stay = {n[11:] for n in Files(spark, draft).names("") if n.startswith("event_date=")}
        if stay:
            rows = spark.read.schema(rows.schema).option("basePath", draft).parquet(draft)
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path)
        for d in set(rewritten) - stay:
            files.drop(f"event_date={d}")
        Files(spark, draft).drop("")
    return {"dropped": dropped, "rewritten": rewritten, "left": dates[len(old):]}


FEATURES = ["rssi_dbm", "channel", "enc_open", "enc_wep", "enc_wpa2", "enc_wpa3", "is_hidden", "wps_enabled"]


def export_features(features: DataFrame, path: str) -> None:
    """Model input as CSV: time, sensor, label and the eight features."""
    features.select("timestamp", "sensor_id", "label", *FEATURES).write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    """Report or heatmap rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def export_telemetry(frames: DataFrame, path: str, base_us: int = 0) -> None:
    """Telemetry laid out for pruning: by date, inside a file by sensor and newest first.

    Rows are dealt by ranges of (date, sensor, time), so a busy date or sensor fills several files of about one size.
    """
    dated = frames.withColumn("event_date", F.to_date(F.timestamp_micros(F.col("t_us") + F.lit(base_us))))
    (
        dated.repartitionByRange("event_date", "sensor_id", "t_us").sortWithinPartitions("event_date", "sensor_id", F.col("t_us").desc())
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path)
    )
