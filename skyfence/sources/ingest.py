"""Telemetry batches: read, validate, de-duplicate, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyfence.functions.mac import MAC_REGEX, parse_time
from skyfence.operators.timeline import US, running

BATCH_DDL = (
    "batch_id string, sensor_id string, timestamp_utc string, sequence_number bigint, received_at string, "
    "items array<struct<bssid:string,ssid:string,channel:int,rssi_dbm:int,frequency_mhz:int,security:string,"
    "capabilities:struct<privacy:boolean,wps:boolean,pmf:boolean>,vendor_oui:string,timestamp:string,"
    "frame_type:string,mac_src:string,sequence_id:bigint>>"
)
# Accepted enumerations.
FRAME_TYPES = [
    "beacon", "probe_req", "probe_resp", "auth", "deauth", "assoc_req", "assoc_resp", "disassoc", "data", "eapol",
    "rts", "cts", "ack", "action", "other",
]
ALERT_SEVERITY = "(?i)^(Critical|High|Medium|Low|Info)$"
SENSOR_STATUS = "^(online|degraded|offline)$"


def read_telemetry(spark: SparkSession, path: str, streaming: bool = False, now: Column | None = None) -> DataFrame:
    """One typed row per item of each ``{batch_id, sensor_id, items[]}`` document (gzip is transparent).

    The item's own JSON travels along; an item without a time takes the ingest time.
    """
    reader = spark.readStream if streaming else spark.read
    docs = reader.schema(BATCH_DDL).json(path)
    now = F.current_timestamp() if now is None else now
    rows = docs.withColumn("ingested_at", now).select(
        "batch_id", "sensor_id", "timestamp_utc", "sequence_number", "ingested_at", F.explode("items").alias("item")
    )
    return rows.select(
        "batch_id", "sensor_id", "sequence_number",
        F.coalesce(parse_time("item.timestamp"), F.col("ingested_at")).alias("ts"),
        "item.*", F.to_json("item").alias("raw"), "ingested_at",
    ).drop("timestamp")


def _telemetry_checks(have: set[str]) -> dict[str, Column]:
    c = F.col
    checks = {
        "bssid": ~F.coalesce(c("bssid").rlike(MAC_REGEX), F.lit(False)),
        "rssi_dbm": ~F.coalesce(c("rssi_dbm").between(-120, 0), F.lit(False)),
        "channel": ~F.coalesce(c("channel").between(0, 173), F.lit(False)),
        "mac_src": ~F.coalesce(c("mac_src").rlike(MAC_REGEX), F.lit(True)),
        "frequency_mhz": ~F.coalesce(c("frequency_mhz").between(2400, 6000), F.lit(True)),
        "frame_type": ~F.coalesce(c("frame_type").isin(FRAME_TYPES), F.lit(False)),
    }
    return {n: bad for n, bad in checks.items() if n in have}


def _alert_checks(have: set[str]) -> dict[str, Column]:
    c = F.col
    checks = {
        "alert_type": c("alert_type").isNull() | (F.length("alert_type") > 50),
        "severity": ~F.coalesce(c("severity").rlike(ALERT_SEVERITY), F.lit(False)),
        "title": c("title").isNull() | (F.length("title") > 200),
        "risk_score": ~F.coalesce(c("risk_score").between(0, 100), F.lit(True)),
        "confidence": ~F.coalesce(c("confidence").between(0, 1), F.lit(True)),
        "impact": ~F.coalesce(c("impact").between(0, 100), F.lit(True)),
    }
    return {n: bad for n, bad in checks.items() if n in have}


def _heartbeat_checks(have: set[str]) -> dict[str, Column]:
    return {
        "sensor_id": F.col("sensor_id").isNull(),
        "status": ~F.coalesce(F.col("status").rlike(SENSOR_STATUS), F.lit("status" not in have)),
    }


def with_reasons(df: DataFrame, kind: str = "telemetry") -> DataFrame:
    """Add ``reject_reasons``: names of the fields that break the contract."""
    make = {"telemetry": _telemetry_checks, "alert": _alert_checks, "heartbeat": _heartbeat_checks}[kind]
    checks = make(set(df.columns))
    return df.withColumn("reject_reasons", F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, bad in checks.items()])))


def validate(df: DataFrame, kind: str = "telemetry") -> tuple[DataFrame, DataFrame]:
    """Split into good rows and quarantined rows with their reasons."""
    judged = with_reasons(df, kind)
    return judged.filter(F.size("reject_reasons") == 0).drop("reject_reasons"), judged.filter(F.size("reject_reasons") > 0)


def dedup_batches(df: DataFrame, received: str = "received_at", watermark: str | None = None) -> DataFrame:
    """First arrival per (sensor, batch) with the number of repeats dropped.

    The batch form aggregates, so a batch id repeated without bound never meets in one task.
    With ``watermark`` the frame may be a stream; repeats inside the watermark are dropped.
    """
    keys = ["sensor_id", "batch_id"]
    if watermark:
        return df.withWatermark(received, watermark).dropDuplicatesWithinWatermark(keys)
    rest = [c for c in df.columns if c not in keys]
    first = F.min(F.struct(received, *[c for c in rest if c != received])).alias("_f")
    out = df.groupBy(*keys).agg(first, (F.count("*") - 1).alias("duplicates"))
    return out.select(*keys, *[F.col(f"_f.{c}").alias(c) for c in rest], "duplicates")


def audit_upload_sequence(batches: DataFrame, drift_s: float = 300.0) -> DataFrame:
    """Flag replayed sequence numbers and clock drift per upload.

    A number is accepted only above all accepted before it, so the last accepted one equals the
    running maximum of everything before. Columns: sensor_id, sequence_number, received_us, sent_us.
    """
    prior = running(
        batches, ["sensor_id"], {"last_accepted": ("max", F.col("sequence_number"))}, t="received_us", tie="sequence_number"
    )
    return prior.withColumns({
        "replayed": F.coalesce(F.col("sequence_number") <= F.col("last_accepted"), F.lit(False)),
        "drifted": F.abs(F.col("received_us") - F.col("sent_us")) > F.lit(int(drift_s * US)),
    })
