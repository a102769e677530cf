"""Behaviour baselines and the findings drawn from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyfence.operators.timeline import US, running

PROFILE = ["site_id", "network_key"]


def site_counts(df: DataFrame) -> DataFrame:
    """Mergeable base of the site baseline: one row per (site, network, channel)."""
    rows = df.filter(F.col("ssid").isNotNull() & (F.col("ssid") != ""))
    key = F.concat_ws("|", "ssid", F.coalesce("security", F.lit("None")))
    return rows.groupBy("site_id", key.alias("network_key"), F.coalesce(F.col("channel").cast("string"), F.lit("unknown")).alias("channel")).agg(
        F.count("*").alias("n"), F.min("rssi_dbm").alias("rssi_min"), F.max("rssi_dbm").alias("rssi_max"),
        F.sum("rssi_dbm").alias("rssi_sum"), F.count("rssi_dbm").alias("rssi_count"), F.min("t_us").alias("first_seen"), F.max("t_us").alias("last_seen"),
    )


def _fold(counts: DataFrame) -> DataFrame:
    channels = F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "n"))))
    return counts.groupBy(*PROFILE).agg(
        channels.alias("channels"), F.min("rssi_min").alias("rssi_min"), F.max("rssi_max").alias("rssi_max"),
        F.sum("rssi_sum").alias("rssi_sum"), F.sum("rssi_count").alias("rssi_count"), F.sum("n").alias("sample_count"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )


def build_site_baseline(df: DataFrame) -> DataFrame:
    """Profile per (site, ``ssid|security``): channel counts, signal range, samples, span."""
    return _fold(site_counts(df))


def merge_baseline(a: DataFrame, b: DataFrame) -> DataFrame:
    """Combine two profile tables as if built from both inputs."""
    both = a.unionByName(b)
    span = both.groupBy(*PROFILE).agg(
        F.min("rssi_min").alias("rssi_min"), F.max("rssi_max").alias("rssi_max"), F.sum("rssi_sum").alias("rssi_sum"),
        F.sum("rssi_count").alias("rssi_count"), F.sum("sample_count").alias("sample_count"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )
    chans = both.select(*PROFILE, F.explode("channels").alias("channel", "n")).groupBy(*PROFILE, "channel").agg(F.sum("n").alias("n"))
    chans = chans.groupBy(*PROFILE).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "n")))).alias("channels"))
    return chans.join(span, PROFILE).select(*a.columns)


def warmed_up(profiles: DataFrame, now_us: int, min_age_s: float = 3 * 86400, min_samples: int = 100) -> DataFrame:
    old = F.lit(now_us) - F.col("first_seen") > F.lit(int(min_age_s * US))
    return profiles.withColumn("warmed_up", old & (F.col("sample_count") > min_samples))


def rogue_ap(df: DataFrame, baselines: DataFrame, rssi_margin: int = 15, require_warm: bool = False) -> DataFrame:
    """Findings of records that break their site's profile: unknown channel, or far stronger signal."""
    base = baselines.filter("warmed_up") if require_warm else baselines
    base = base.select(*PROFILE, "channels", F.col("rssi_max").alias("baseline_max"))
    rows = df.filter(F.col("ssid").isNotNull() & (F.col("ssid") != "")).withColumn(
        "network_key", F.concat_ws("|", "ssid", F.coalesce("security", F.lit("None")))
    ).join(base, PROFILE)
    odd = F.coalesce(~F.map_contains_key("channels", F.col("channel").cast("string")), F.lit(False))
    loud = F.coalesce(F.col("rssi_dbm") > F.col("baseline_max") + rssi_margin, F.lit(False))
    found = F.array_compact(F.array(
        F.when(odd, F.struct(F.lit("rogue_channel_dev").alias("detector_id"), F.lit(0.8).alias("confidence_raw"), F.array(F.lit("CHANNEL_MISMATCH")).alias("reason_codes"))),
        F.when(loud, F.struct(F.lit("rogue_rssi_spike").alias("detector_id"), F.lit(0.6).alias("confidence_raw"), F.array(F.lit("RSSI_ANOMALY")).alias("reason_codes"))),
    ))
    keep = [c for c in df.columns]
    return rows.select(*keep, "baseline_max", F.inline(found)).withColumn("entity_key", F.concat_ws("|", F.lit("rogue"), "ssid", "bssid"))


def policy_findings(df: DataFrame) -> DataFrame:
    """Findings for open and WEP networks (certain, so confidence 1)."""
    s = F.coalesce(F.col("security"), F.lit("Open"))
    hit = lambda cond, name, want: F.when(cond, F.struct(
        F.lit(name).alias("detector_id"), F.lit(1.0).alias("confidence_raw"), F.array(F.lit("SECURITY_DOWNGRADE")).alias("reason_codes"), F.lit(want).alias("expected")
    ))
    found = F.array_compact(F.array(hit(s == "Open", "policy_open_net", "Encrypted"), hit(F.upper(s).contains("WEP"), "policy_wep_net", "WPA2/3")))
    key = F.concat(F.lit("policy|"), F.coalesce("ssid", F.lit("")), F.lit("|"), F.coalesce("bssid", F.lit("")))
    return df.select("*", F.inline(found)).withColumn("entity_key", key)


def bssid_deviation(
    frames: DataFrame, min_prior: int = 5, min_signal: int = 10, sigma: float = 3.0, min_std: float = 5.0, every: int = 1
) -> DataFrame:
    """Each frame against everything heard before from its address: vendor change, sudden strength.

    ``every=10`` keeps the reference's sampling of every tenth frame per sensor.
    """
    rssi = F.coalesce(F.col("rssi_dbm"), F.lit(-100)).cast("bigint")
    rows = frames.filter(F.col("bssid").isNotNull()).select("event_id", "t_us", "sensor_id", "bssid", "ssid", "vendor_oui", rssi.alias("rssi_dbm"))
    rows = running(rows, ["bssid"], {
        "prior_n": ("count", F.col("rssi_dbm")), "_s": ("sum", F.col("rssi_dbm")), "_q": ("sum", F.col("rssi_dbm") * F.col("rssi_dbm")),
        "known_vendor": ("first", F.when(F.col("vendor_oui") != "", F.col("vendor_oui"))),
    })
    if every > 1:
        rows = running(rows, ["sensor_id"], {"_nth": ("count", F.lit(1))}, inclusive=True).filter(F.col("_nth") % every == 0).drop("_nth")
    avg = F.col("_s") / F.col("prior_n")
    std = F.sqrt(F.greatest(F.col("_q") / F.col("prior_n") - avg * avg, F.lit(0.0)))
    a, b = F.lower("known_vendor"), F.lower("vendor_oui")
    vendor = F.coalesce(~(a.startswith(b) | b.startswith(a)) & (F.col("vendor_oui") != ""), F.lit(False))
    z = (F.col("rssi_dbm") - avg) / F.greatest(std, F.lit(min_std))
    loud = (F.col("prior_n") >= min_signal) & (z > sigma)
    signal = F.when(loud, F.least(F.lit(1.0), (z - sigma) / 2.0 + 0.5)).otherwise(0.0)
    out = rows.filter(F.col("prior_n") >= min_prior).select(
        "event_id", "t_us", "sensor_id", "bssid", "ssid", "rssi_dbm", "prior_n", avg.alias("avg_rssi"), z.alias("z_score"),
        vendor.alias("vendor_mismatch"), F.least(F.lit(1.0), F.when(vendor, 1.0).otherwise(0.0) + signal).alias("score"),
    )
    return out.filter(F.col("score") > 0)


def deviation_alerts(scored: DataFrame) -> DataFrame:
    """Severity from the risk score computed with the deviation."""
    return scored.filter(F.col("score") > 0).withColumn("severity", F.when(F.col("risk_score") > 70, "HIGH").otherwise("MEDIUM"))


def alerts_of_deviations(records: DataFrame, deviations: DataFrame, allowlist: DataFrame | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """From deviating frames over the risk score to alerts: ``records`` are the frames as network records, which meet by event_id."""
    from skyfence.operators.scoring import score_networks

    met = records.join(deviations.select("event_id", "score", "vendor_mismatch", "z_score"), "event_id")
    return deviation_alerts(score_networks(met, weights, allowlist, deviation="score"))


def timeseries_baseline(
    df: DataFrame, start_us: int, learn_s: float = 72 * 3600, min_obs: int = 100, z_limit: float = 2.5
) -> DataFrame:
    """Anomalies after a learning period, against the period's profile: signal level, unseen channel."""
    end = start_us + int(learn_s * US)
    known = learned_profile(df, start_us, learn_s)
    later = df.filter((F.col("t_us") >= end) & F.col("bssid").isNotNull())
    rows = later.join(known.filter(F.col("observations") >= min_obs), "bssid")
    z = (F.col("rssi_dbm") - F.col("rssi_mean")) / F.col("rssi_std")
    found = F.array_compact(F.array(
        F.when(F.abs(z) > z_limit, F.struct(F.lit("rssi_anomaly").alias("anomaly"), F.col("rssi_mean").alias("expected"), F.col("rssi_dbm").cast("double").alias("actual"), z.alias("z_score"))),
        F.when(~F.array_contains("channels_seen", F.col("channel")), F.struct(F.lit("new_channel").alias("anomaly"), F.lit(None).cast("double").alias("expected"), F.col("channel").cast("double").alias("actual"), F.lit(None).cast("double").alias("z_score"))),
    ))
    return rows.select("event_id", "t_us", "bssid", "observations", F.inline(found))


def learned_profile(df: DataFrame, start_us: int, learn_s: float) -> DataFrame:
    """Per address over the learning period: signal mean/spread, channels, beacon mean, hourly activity."""
    end = start_us + int(learn_s * US)
    rows = df.filter((F.col("t_us") >= start_us) & (F.col("t_us") < end) & F.col("bssid").isNotNull())
    n, s, q = F.count("*"), F.sum("rssi_dbm"), F.sum(F.col("rssi_dbm") * F.col("rssi_dbm"))
    hour = F.expr(f"pmod(t_us div {3600 * US}L, 24)")
    out = rows.groupBy("bssid").agg(
        n.alias("observations"), F.min("t_us").alias("first_seen"), F.max("t_us").alias("last_seen"),
        (s / n).alias("rssi_mean"), (q / n - (s / n) * (s / n)).alias("_var"), F.min("rssi_dbm").alias("rssi_min"), F.max("rssi_dbm").alias("rssi_max"),
        F.array_sort(F.collect_set("channel")).alias("channels_seen"), F.avg("beacon_interval").alias("beacon_mean"),
        F.array(*[F.count_if(hour == h) for h in range(24)]).alias("hourly_activity"),
    )
    return out.withColumn("rssi_std", F.when(F.col("_var") > 0, F.sqrt("_var")).otherwise(1.0)).drop("_var")


def learning_status(df: DataFrame, start_us: int, now_us: int, learn_s: float = 72 * 3600) -> DataFrame:
    elapsed = (now_us - start_us) / US
    return df.agg(F.count_distinct("bssid").alias("networks_tracked"), F.count("*").alias("total_observations")).select(
        F.lit(elapsed < learn_s).alias("is_learning"), F.lit(min(100.0, elapsed / learn_s * 100)).alias("progress_pct"), "networks_tracked", "total_observations"
    )
