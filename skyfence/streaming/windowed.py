"""Window aggregates over streams, and stream sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skyfence.operators.detectors import jamming_alert
from skyfence.operators.summaries import event_key
from skyfence.operators.timeline import US

SHUFFLE = "spark.sql.shuffle.partitions"


def _window_no(window_s: int, base_us: int):
    return F.call_function("div", F.unix_micros("window.start") - F.lit(base_us), F.lit(window_s * US).cast("bigint")).alias("window_no")


def collapse_events_stream(frames: DataFrame, window_s: int = 5, base_us: int = 0) -> DataFrame:
    """One row per (type, address) and window once the watermark passes it."""
    order = F.struct("t_us", "event_id")
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    span = F.greatest((F.max("t_us") - F.min("t_us")) / F.lit(US), F.lit(0.001))
    out = frames.groupBy(
        F.window("ts", f"{window_s} seconds"), F.coalesce("frame_type", F.lit("unknown")).alias("event_type"), event_key().alias("address")
    ).agg(
        F.min(order).getField("event_id").alias("sample_event_id"), newest("rssi_dbm"), newest("channel"), newest("ssid"), newest("sensor_id"),
        F.count("*").alias("agg_count"), F.round(F.count("*") / span, 2).alias("agg_rate_per_sec"),
        F.min("t_us").alias("agg_first_seen"), F.max("t_us").alias("agg_last_seen"),
    )
    return out.select("event_type", "address", _window_no(window_s, base_us), *out.columns[3:])


def deauth_counts_stream(frames: DataFrame, window_s: int = 60, base_us: int = 0) -> DataFrame:
    hits = frames.filter("frame_type = 'deauth'").groupBy(F.window("ts", f"{window_s} seconds"), "src_addr").agg(F.count("*").alias("deauth_count"))
    return hits.select(_window_no(window_s, base_us), "src_addr", "deauth_count")


def jamming_stream(
    frames: DataFrame, window_s: int = 10, min_frames: int = 20, retry_limit: float = 0.4, rts_limit: int = 50, high: int = 60,
    critical: int = 80, weight_loss: int = 40, weight_congestion: int = 30, samples: int = 100,
) -> DataFrame:
    """Interval score per (sensor, channel), the alerts of the batch form.

    The state of an open interval holds the levels of its frames, of which the last ``samples`` are averaged when it closes.
    """
    level = F.when(F.col("rssi_dbm").isNotNull(), F.struct("t_us", "event_id", "rssi_dbm"))
    per = frames.groupBy(F.window("ts", f"{window_s} seconds"), "sensor_id", "channel").agg(
        F.count("*").alias("total_frames"), F.count_if("retry").alias("_retries"), F.count_if(F.col("frame_type").isin("rts", "cts")).alias("rts_cts_count"),
        F.max(F.struct("t_us", "event_id")).alias("_last"), F.collect_list(level).alias("_levels"),
    ).filter(F.col("total_frames") >= min_frames)
    newest = F.slice(F.sort_array("_levels", asc=False), 1, samples)
    mean = F.when(F.size("_levels") > 0, F.aggregate(newest, F.lit(0.0), lambda a, x: a + x["rssi_dbm"]) / F.size(newest))
    share = F.col("_retries") / F.col("total_frames")
    loss = F.when(share > retry_limit, (F.lit(weight_loss) * F.least(F.lit(1.0), (share - retry_limit) / 0.5)).cast("int")).otherwise(0)
    scored = per.withColumn("score", (loss + F.when(F.col("rts_cts_count") > rts_limit, weight_congestion).otherwise(0)).cast("bigint"))
    hits = scored.filter(F.col("score") >= high).select("sensor_id", "channel", "_last.*", "score", "total_frames", share.alias("retry_rate"), "rts_cts_count", mean.alias("avg_rssi"))
    return jamming_alert(hits, critical)


def to_parquet(df: DataFrame, path: str, checkpoint: str, once: bool = True, partition: str | None = None, tasks: int = 0) -> StreamingQuery:
    """Append a stream to Parquet; the checkpoint makes replays exactly-once.

    A state task costs about half a second in every micro-batch, however little it holds, so a stream begins with as many of them as
    there are cores, at most ``spark.sql.shuffle.partitions``, or with ``tasks``; a checkpoint keeps the number it began with.
    """
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.partitionBy(partition) if partition else writer
    spark = df.sparkSession
    given = spark.conf.get(SHUFFLE)
    spark.conf.set(SHUFFLE, str(tasks or min(int(given), spark.sparkContext.defaultParallelism)))
    try:
        return (writer.trigger(availableNow=True) if once else writer).start()  # the stream copies the session's settings here
    finally:
        spark.conf.set(SHUFFLE, given)


def siem_stream(alerts: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Continuous document feed as JSON lines; the checkpoint takes the place of a cursor."""
    stamp = F.date_format(F.timestamp_micros("t_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("@timestamp")
    docs = alerts.select(F.to_json(F.struct(*alerts.columns, stamp)).alias("value"))
    writer = docs.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def upsert_stream(sightings: DataFrame, path: str, checkpoint: str, once: bool = True, buckets: int = 64) -> StreamingQuery:
    """Keep the (bssid, ssid) network table current: each micro-batch rewrites the buckets of access points it touches.

    Batches are committed by number (``sources.networks``), so a retried batch is not counted twice. Read it by ``read_networks``.
    """
    from skyfence.sources.networks import merge_batch

    def merge(batch: DataFrame, number: int) -> None:
        merge_batch(batch, number, path, buckets)

    writer = sightings.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
