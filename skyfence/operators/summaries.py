"""Summary views over telemetry, alerts, networks, sightings and sensors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfence.operators.timeline import US, slot_of


def recent(df: DataFrame, n: int, t: str = "t_us", tie: str = "event_id", **equals) -> DataFrame:
    """The newest ``n`` rows, newest first, optionally only rows whose columns equal the given values."""
    for column, value in equals.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df.orderBy(F.col(t).desc(), F.col(tie).desc()).limit(max(1, n))


def network_stats(frames: DataFrame) -> DataFrame:
    """Per access point: span, frame counts, signal range, associated clients."""
    ap = F.col("bssid")
    client = lambda c: F.when((F.col(c) != ap) & (F.col(c) != "FF:FF:FF:FF:FF:FF"), F.col(c))
    rows = frames.filter(ap.isNotNull())
    stats = rows.groupBy("bssid").agg(
        F.min("t_us").alias("first_seen"), F.max("t_us").alias("last_seen"), F.count("*").alias("frame_count"),
        F.count_if(F.col("frame_type") == "beacon").alias("beacon_count"),
        F.count_if(F.col("frame_type") == "probe_req").alias("probe_count"),
        F.min("rssi_dbm").alias("rssi_min"), F.max("rssi_dbm").alias("rssi_max"), F.avg("rssi_dbm").alias("rssi_avg"),
        F.max_by("ssid", F.when(F.col("ssid").isNotNull(), F.struct("t_us", "event_id"))).alias("ssid"),
    )
    clients = (
        rows.select("bssid", F.explode(F.array_compact(F.array(client("src_addr"), client("dst_addr")))).alias("client"))
        .distinct().groupBy("bssid").agg(F.array_sort(F.collect_list("client")).alias("associated_clients"))
    )
    return stats.join(clients, "bssid", "left")


def network_clients(frames: DataFrame) -> DataFrame:
    """One row per access point and station heard with it: bssid, client, frames, first_seen, last_seen.

    The long form of ``network_stats``'s client list, for access points with any number of stations.
    """
    ap = F.col("bssid")
    client = lambda c: F.when((F.col(c) != ap) & (F.col(c) != "FF:FF:FF:FF:FF:FF"), F.col(c))
    both = F.array_distinct(F.array_compact(F.array(client("src_addr"), client("dst_addr"))))
    rows = frames.filter(ap.isNotNull()).select("bssid", "t_us", F.explode(both).alias("client"))
    return rows.groupBy("bssid", "client").agg(F.count("*").alias("frames"), F.min("t_us").alias("first_seen"), F.max("t_us").alias("last_seen"))


def current_networks(frames: DataFrame, positions: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """Latest record per access point, with estimated coordinates where known; with ``n``, only among the newest n frames.

    ``frames`` may carry gps_lat / gps_lon; an estimate (lat, lon of ``positions``) overrides them.
    """
    top = frames.filter(F.col("bssid").isNotNull())
    top = top if n is None else recent(top, n)
    rest = [c for c in top.columns if c != "bssid"]
    latest = top.groupBy("bssid").agg(F.max_by(F.struct(*rest), F.struct("t_us", "event_id")).alias("r"))
    out = latest.select("bssid", "r.*", F.col("r.t_us").alias("last_seen"))
    for column in ("gps_lat", "gps_lon"):
        if column not in out.columns:
            out = out.withColumn(column, F.lit(None).cast("double"))
    if positions is None:
        return out.withColumnsRenamed({"gps_lat": "lat", "gps_lon": "lon"})
    est = positions.select("bssid", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    return out.join(est, "bssid", "left").select(
        *[c for c in out.columns if c not in ("gps_lat", "gps_lon")],
        F.coalesce("_lat", "gps_lat").alias("lat"), F.coalesce("_lon", "gps_lon").alias("lon"),
    )


def event_key() -> Column:
    full = lambda c: F.when(F.col(c) != "", F.col(c))
    return F.coalesce(full("bssid"), full("src_addr"), F.lit("unknown"))


def collapse_events(frames: DataFrame, window_s: int = 5) -> DataFrame:
    """One row per (type, address) and window: sample, latest values, count and rate.

    Every part is a mergeable aggregate, so map-side combining collapses floods before the shuffle.
    """
    order = F.struct("t_us", "event_id")
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    count = F.count("*")
    span = F.greatest((F.max("t_us") - F.min("t_us")) / F.lit(US), F.lit(0.001))
    return frames.groupBy(
        F.coalesce("frame_type", F.lit("unknown")).alias("event_type"), event_key().alias("address"),
        slot_of("t_us", window_s * US).alias("window_no"),
    ).agg(
        F.min(F.struct("t_us", "event_id")).getField("event_id").alias("sample_event_id"),
        newest("rssi_dbm"), newest("channel"), newest("ssid"), newest("sensor_id"),
        count.alias("agg_count"), F.round(count / span, 2).alias("agg_rate_per_sec"),
        F.min("t_us").alias("agg_first_seen"), F.max("t_us").alias("agg_last_seen"),
    )


def compression(collapsed: DataFrame) -> DataFrame:
    n, groups = F.sum("agg_count"), F.count("*")
    return collapsed.agg(
        n.alias("total_ingested"), (n - groups).alias("total_collapsed"),
        F.when(n > 0, F.round((n - groups) / n, 3)).otherwise(0.0).alias("compression_ratio"),
    )


def deauth_counts(frames: DataFrame, window_s: int = 60) -> DataFrame:
    return frames.filter(F.col("frame_type") == "deauth").groupBy(
        slot_of("t_us", window_s * US).alias("window_no"), "src_addr"
    ).agg(F.count("*").alias("deauth_count"))


def security_bucket(col: str = "security") -> Column:
    s = F.upper(F.coalesce(F.col(col), F.lit("OPEN")))
    return F.when(s.contains("WPA3"), "WPA3").when(s.contains("WPA2"), "WPA2").when(s.contains("WEP"), "WEP").otherwise("OPEN")


def security_mix(networks: DataFrame) -> DataFrame:
    return networks.groupBy(security_bucket().alias("security_class")).agg(F.count("*").alias("networks"))


def map_class(networks: DataFrame, only: str | None = None) -> DataFrame:
    """Map colour class per network: OPEN, WEP or WPA; optional security filter."""
    s = F.upper(F.coalesce(F.col("security"), F.lit("")))
    if only in ("OPEN", "WEP", "WPA"):
        networks = networks.filter(s.contains(only))
    return networks.withColumn("sec_type", F.when(s.contains("OPEN"), "OPEN").when(s.contains("WEP"), "WEP").otherwise("WPA"))


def channel_histogram(networks: DataFrame) -> DataFrame:
    return networks.filter(F.col("channel") > 0).groupBy("channel").agg(F.count("*").alias("networks"))


def rssi_distribution(networks: DataFrame, col: str = "rssi_avg") -> DataFrame:
    """Quartiles and mean of valid levels (-100..0), exact.

    Levels are counted, first by hundredths (at most 10,001), which tells how many lie below each; ranks inside a hundredth
    come from its own distinct levels. No task orders all levels.
    """
    v = F.col("v")
    levels = networks.select(F.col(col).alias("v")).filter(v.between(-100, 0)).groupBy("v").agg(F.count("*").alias("n")).withColumn("cell", F.floor(v * 100))
    every = Window.orderBy("cell")
    cells = levels.groupBy("cell").agg(F.sum("n").alias("in_cell"))
    cells = cells.select("cell", (F.sum("in_cell").over(every) - F.col("in_cell")).alias("below"), F.sum("in_cell").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    ranked = levels.join(cells, "cell").withColumn("end", F.col("below") + F.sum("n").over(Window.partitionBy("cell").orderBy("v")))
    at = lambda rank: F.max(F.when((F.col("end") - F.col("n") <= rank) & (rank < F.col("end")), v))
    parts = {}
    for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        rank = (F.col("total") - 1) * p
        parts |= {f"{name}_lo": at(F.floor(rank)), f"{name}_hi": at(F.ceil(rank)), f"{name}_w": F.max(rank - F.floor(rank))}
    out = ranked.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("v").alias("lowest"), F.max("v").alias("highest"), (F.sum(v * F.col("n")) / F.sum("n")).alias("mean"), *[c.alias(k) for k, c in parts.items()],
    )
    quartile = lambda q: (F.col(f"{q}_lo") * (1 - F.col(f"{q}_w")) + F.col(f"{q}_hi") * F.col(f"{q}_w")).alias(q)
    return out.select("n", "lowest", "highest", "mean", quartile("q1"), quartile("median"), quartile("q3"))


def discovery_rate(networks: DataFrame, now_us: int, minutes: int = 60, t: str = "first_seen") -> DataFrame:
    """Networks first seen in each of the last minutes, zeros included."""
    last = now_us // (60 * US)
    spark = networks.sparkSession
    grid = spark.range(last - minutes, last + 1).select(F.col("id").alias("minute"))
    counts = networks.filter(F.col(t).between((last - minutes) * 60 * US, now_us)).groupBy(
        slot_of(t, 60 * US).alias("minute")
    ).agg(F.count("*").alias("n"))
    return grid.join(counts, "minute", "left").select("minute", F.coalesce("n", F.lit(0)).alias("discovered"))


def risk_density(networks: DataFrame, cell_deg: float = 0.001) -> DataFrame:
    """Summed risk per coordinate cell."""
    cell = lambda c: F.floor(F.col(c) / F.lit(cell_deg)).cast("bigint")
    return networks.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).groupBy(
        cell("lat").alias("lat_cell"), cell("lon").alias("lon_cell")
    ).agg(F.sum("risk_score").alias("risk"), F.count("*").alias("networks"))


def wardrive_summary(sightings: DataFrame) -> DataFrame:
    """Totals of a survey: sightings, networks, fixes, latest fix, per-security counts."""
    fix = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    order = F.struct("t_us", "event_id")
    sec = security_bucket()
    label = F.format_string("%.5f, %.5f", F.col("lat"), F.col("lon"))
    return sightings.agg(
        F.count("*").alias("total_sightings"), F.count_distinct("bssid").alias("unique_networks"),
        F.count_if(fix).alias("gps_points"),
        F.coalesce(F.max_by(label, F.when(fix, order)), F.lit("No GPS fix")).alias("latest_fix"),
        *[F.count_if(sec == s).alias(f"{s.lower()}_sightings") for s in ("OPEN", "WEP", "WPA2", "WPA3")],
    )


def first_sightings(sightings: DataFrame) -> DataFrame:
    """Sightings with a flag on the first one of each network (found by a mergeable aggregate)."""
    first = sightings.groupBy("bssid").agg(F.min(F.struct("t_us", "event_id")).alias("_first"))
    return sightings.join(first, "bssid").withColumn("is_new", F.struct("t_us", "event_id") == F.col("_first")).drop("_first")


def newest_sightings(sightings: DataFrame, n: int = 10) -> DataFrame:
    return recent(sightings, n)


def client_list(frames: DataFrame) -> DataFrame:
    """Probing stations: first seen and the distinct names they asked for."""
    probes = frames.filter((F.col("frame_type") == "probe_req") & F.col("src_addr").isNotNull())
    return (
        probes.groupBy(F.upper("src_addr").alias("mac"), "ssid").agg(F.min("t_us").alias("t"))
        .groupBy("mac").agg(
            F.min("t").alias("first_seen"),
            F.array_sort(F.collect_list(F.when(F.col("ssid") != "", F.col("ssid")))).alias("probed_ssids"),
        )
    )


def sensor_status(heartbeats: DataFrame, batches: DataFrame, now_us: int, offline_s: int = 300) -> DataFrame:
    """Latest heartbeat and batch per sensor; silent sensors count as offline."""
    hb = heartbeats.groupBy("sensor_id").agg(
        F.max_by(F.struct("status", "metrics"), "t_us").alias("h"), F.max("t_us").alias("_hb")
    )
    tb = batches.groupBy("sensor_id").agg(F.max_by("batch_id", "t_us").alias("last_batch"), F.max("t_us").alias("_tb"))
    seen = F.greatest("_hb", "_tb")
    return hb.join(tb, "sensor_id", "full").select(
        "sensor_id", seen.alias("last_seen"), F.col("h.metrics").alias("metrics"), "last_batch",
        F.when(F.lit(now_us) - seen > offline_s * US, "offline").otherwise(F.coalesce("h.status", F.lit("online"))).alias("status"),
    )


def alert_counts(alerts: DataFrame, window_s: int = 300) -> DataFrame:
    """Alerts per type, severity and aligned window. ``alerts`` needs alert_type, severity, t_us."""
    return alerts.groupBy("alert_type", "severity", slot_of("t_us", window_s * US).alias("window_no")).agg(F.count("*").alias("alerts"))


# Paging rules (name, alert type or any, window in seconds, alerts to be exceeded in it, seconds it must hold).
# The rate rule is taken by its description, ten a minute on average over five minutes.
PAGES = [("evil_twin", "evil_twin", 300, 0, 0), ("deauth_flood", "deauth_flood", 120, 0, 0), ("high_rate", None, 300, 50, 300)]


def alert_pages(alerts: DataFrame, step_s: int = 30) -> DataFrame:
    """rule, alert_type, eval_us, alerts: every evaluation, each ``step_s``, at which a paging rule fires.

    At an evaluation a rule looks at the alerts of its window before that instant, all severities together; a rule that must hold
    fires when it was met at every evaluation over that time. Alerts are counted by step first, so a busy type sends one row
    per step to each of its window's evaluations, however many alerts there are.
    """
    step = step_s * US
    panes = alerts.groupBy("alert_type", slot_of("t_us", step).alias("pane")).agg(F.count("*").alias("n"))
    rules = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.lit(of).cast("string").alias("of"), F.lit(width // step_s).alias("panes"), F.lit(over).alias("over"), F.lit(hold // step_s).alias("hold"))
        for name, of, width, over, hold in PAGES
    ])
    met = panes.select("*", F.inline(rules)).filter(F.col("of").isNull() | (F.col("of") == F.col("alert_type")))
    met = met.select("rule", "alert_type", "over", "hold", "n", F.explode(F.sequence(F.col("pane") + 1, F.col("pane") + F.col("panes"))).alias("at"))
    met = met.groupBy("rule", "alert_type", "over", "hold", "at").agg(F.sum("n").alias("alerts")).filter(F.col("alerts") > F.col("over"))
    held = Window.partitionBy("rule", "alert_type").orderBy("at")
    since = F.max(F.when(F.coalesce(F.col("at") - F.lag("at").over(held), F.lit(2)) > 1, F.col("at"))).over(held.rowsBetween(Window.unboundedPreceding, 0))
    return met.withColumn("since", since).filter(F.col("at") - F.col("since") >= F.col("hold")).select("rule", "alert_type", (F.col("at") * F.lit(step)).alias("eval_us"), "alerts")


def alerts_per_hour(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(slot_of("t_us", 3600 * US).alias("hour_no")).agg(F.count("*").alias("alerts"))


def data_quality(networks: DataFrame) -> DataFrame:
    """Coverage, signal validity and encryption identification of a network table (bssid, ssid, rssi, encryption)."""
    rssi = F.when(F.col("rssi") != 0, F.col("rssi"))
    ok = F.when(rssi.between(-100, -10), rssi)
    ssid = F.coalesce(F.col("ssid"), F.lit(""))
    known = F.coalesce(F.col("encryption").rlike("Open|WEP|WPA"), F.lit(False))
    total = F.count("*")
    rate = lambda part, whole: F.when(whole > 0, F.round(part / whole * 100, 2)).otherwise(0.0)
    return networks.agg(
        F.count_distinct(F.upper("bssid")).alias("ap_count"),
        F.count_distinct(F.when(~ssid.isin("", "<Hidden>"), ssid)).alias("ssid_count"),
        F.count_if(ssid.isin("", "<Hidden>")).alias("hidden_networks"),
        F.count(rssi).alias("total_readings"), F.count(ok).alias("valid_readings"),
        rate(F.count(ok), F.count(rssi)).alias("validity_rate"), F.coalesce(F.round(F.avg(ok), 2), F.lit(0.0)).alias("avg_rssi"),
        F.coalesce(F.min(ok), F.lit(0)).alias("min_rssi"), F.coalesce(F.max(ok), F.lit(0)).alias("max_rssi"),
        total.alias("total_networks"), F.count_if(known).alias("identified"), rate(F.count_if(known), total).alias("identification_rate"),
    )


def encryption_breakdown(networks: DataFrame) -> DataFrame:
    return networks.groupBy(F.coalesce("encryption", F.lit("Unknown")).alias("encryption")).agg(F.count("*").alias("networks"))


def capture_loss(truth: DataFrame, got: DataFrame) -> DataFrame:
    """Share of ground-truth frames missing from another capture."""
    both = truth.select(F.lit(1).alias("t")).unionByName(got.select(F.lit(0).alias("t")))
    counts = both.agg(F.count_if(F.col("t") == 1).alias("truth_frames"), F.count_if(F.col("t") == 0).alias("captured_frames"))
    lost = F.greatest(F.lit(0.0), (F.col("truth_frames") - F.col("captured_frames")) / F.col("truth_frames"))
    return counts.select(
        "truth_frames", "captured_frames",
        F.when(F.col("truth_frames") > 0, F.round(lost * 100, 2)).otherwise(0.0).alias("loss_percent"),
    )
