"""Network features, explainable risk, findings score, recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
SUSPICIOUS_SSID = ["free", "guest", "public", "open", "linksys", "netgear", "default", "test"]
TRUSTED_VENDORS = ["cisco", "aruba", "juniper", "fortinet", "meraki", "ruckus"]
FEATURES = [
    "enc_score", "rssi_norm", "vendor_trust", "ssid_suspicious", "ssid_hidden", "wps_flag", "channel_unusual",
    "beacon_anomaly", "temporal_new", "privacy_concern",
]
WEIGHTS = {
    "encryption": 0.40, "rssi_norm": 0.10, "beacon_anomaly": 0.0, "vendor_risk": 0.05, "ssid_suspicion": 0.10,
    "wps_flag": 0.20, "channel_crowd": 0.0, "hidden_ssid": 0.0, "temporal": 0.0, "traffic": 0.15,
}
WEIGHT_FEATURE = {
    "encryption": "enc_score", "rssi_norm": "rssi_norm", "ssid_suspicion": "ssid_suspicious", "hidden_ssid": "ssid_hidden",
    "vendor_risk": "vendor_trust", "channel_crowd": "channel_unusual", "beacon_anomaly": "beacon_anomaly",
    "wps_flag": "wps_flag", "temporal": "temporal_new", "privacy_flags": "privacy_concern",
}
ORDER = [
    "encryption", "rssi_norm", "ssid_suspicion", "hidden_ssid", "vendor_risk", "channel_crowd", "beacon_anomaly",
    "wps_flag", "temporal", "traffic", "privacy_flags",
]
ML_FEATURES = ["rssi_dbm", "channel", "enc_open", "enc_wep", "enc_wpa2", "enc_wpa3", "is_hidden", "wps_enabled"]


def _col(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def network_features(df: DataFrame) -> DataFrame:
    """Ten features in 0..1 from encryption, signal, vendor, ssid, channel, beacon_interval, first_seen, last_seen, capabilities, wps."""
    enc = F.upper(F.coalesce(_col(df, "encryption", "string"), F.lit("OPEN")))
    has = lambda s: enc.contains(s)
    signal = F.coalesce(_col(df, "signal", "string").try_cast("double"), F.lit(-100.0))
    vendor = F.lower(F.coalesce(_col(df, "vendor", "string"), F.lit("")))
    ssid = F.coalesce(_col(df, "ssid", "string"), F.lit(""))
    ch = F.coalesce(_col(df, "channel", "string").try_cast("int"), F.lit(0))
    bi = _col(df, "beacon_interval", "string").try_cast("double")
    wps = F.coalesce(_col(df, "wps_enabled", "boolean"), F.lit(False))
    wps_any = wps | F.coalesce(_col(df, "wps", "boolean"), F.lit(False))
    first, last = _col(df, "first_seen", "string"), _col(df, "last_seen", "string")
    caps = F.coalesce(_col(df, "capabilities", "string"), F.lit(""))
    one = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    return df.withColumns({
        "enc_score": F.when(has("WPA3"), 0.0).when(has("TKIP"), 0.4).when(has("WPA2"), 0.2).when(has("WPA"), 0.5).when(has("WEP"), 0.9).otherwise(1.0),
        "rssi_norm": F.least(F.greatest((signal + 100.0) / 50.0, F.lit(0.0)), F.lit(1.0)),
        "vendor_trust": F.when(vendor.isin("", "unknown"), 0.5).when(vendor.rlike("|".join(TRUSTED_VENDORS)), 0.0).otherwise(0.3),
        "ssid_suspicious": one(F.lower(ssid).rlike("|".join(SUSPICIOUS_SSID))),
        "ssid_hidden": one(ssid.isin("", "<hidden>")),
        "wps_flag": one(wps_any),
        "channel_unusual": F.when(ch.isin(1, 6, 11), 0.0).when(ch.between(1, 14), 0.3).when(ch > 14, 0.1).otherwise(0.5),
        "beacon_anomaly": one(F.coalesce((bi != 0) & (F.abs(bi - 102400) > 1000), F.lit(False))),
        "temporal_new": F.when(first.isNotNull() & (first != "") & (first == last), 0.5).otherwise(0.0),
        "privacy_concern": F.least(F.when(caps.contains("ESS"), 0.0).otherwise(0.3) + F.when(wps, 0.2).otherwise(0.0), F.lit(1.0)),
    })


def score_networks(
    df: DataFrame, weights: dict[str, float] | None = None, allowlist: DataFrame | None = None,
    deviation: str | None = None, anomaly: str | None = None, low: int = 40, medium: int = 70,
) -> DataFrame:
    """Risk score, level, confidence, per-weight explanation and plain-language factors.

    ``allowlist`` has one column ``name`` holding network names or addresses of any number; it is
    joined without a broadcast hint. ``deviation`` and ``anomaly`` name columns of ``df``.
    """
    w = WEIGHTS if weights is None else weights
    scored = network_features(df)
    if allowlist is not None:
        # Two passes keep each an equality join, which Spark can shuffle and split at any size.
        known = allowlist.select(F.col("name")).distinct()
        for column in ("ssid", "bssid"):
            scored = scored.join(known.select(F.col("name").alias(column), F.lit(True).alias(f"_k_{column}")), column, "left")
        is_known = F.coalesce("_k_ssid", "_k_bssid", F.lit(False))
    else:
        is_known = F.lit(False)
    dev = F.coalesce(F.col(deviation).cast("double"), F.lit(0.0)) if deviation else F.lit(0.0)
    handshake = F.when(F.coalesce(_col(df, "handshake_captured", "boolean"), F.lit(False)), 1.0).otherwise(0.0)
    base = None
    for key in ORDER:
        factor = w.get(key, 0.05 if key == "privacy_flags" else 0)
        term = (handshake if key == "traffic" else F.col(WEIGHT_FEATURE[key])) * F.lit(float(factor))
        base = term if base is None else base + term
    impact = F.when(is_known, 1.0).otherwise(0.5)
    raw = F.least(F.lit(1.0), base + dev) * impact * 100
    if anomaly:
        raw = F.when(F.col(anomaly), F.least(F.lit(100.0), raw + 20)).otherwise(raw)
    scored = scored.withColumn("_trusted", is_known & (dev == 0))
    score = F.when(F.col("_trusted"), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), raw.cast("int"))))
    scored = scored.withColumn("risk_score", score)
    filled = sum((F.when(F.col(f) != 0.5, 1).otherwise(0) for f in FEATURES), F.lit(0))
    if anomaly:
        filled = filled + F.when(F.col(anomaly), 1).otherwise(0)
    parts = [
        F.struct(F.lit(k).alias("weight"), F.bround(F.col(WEIGHT_FEATURE[k]) * F.lit(float(v)) * 100, 1).alias("points"))
        for k, v in w.items() if k in WEIGHT_FEATURE
    ]
    shown = _col(df, "encryption", "string")
    return scored.withColumns({
        "risk_level": F.when(F.col("_trusted"), "Trusted").when(F.col("risk_score") >= medium, "High").when(F.col("risk_score") >= low, "Medium").otherwise("Low"),
        "confidence": F.when(F.col("_trusted"), 1.0).otherwise(F.least(F.lit(1.0), F.bround(filled / 5.0, 2))),
        "explain": F.when(~F.col("_trusted"), F.array(*parts)),
        "contributing_factors": F.when(F.col("_trusted"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(
            F.when(F.col("enc_score") > 0.5, F.concat(F.lit("Weak Encryption ("), F.coalesce(shown, F.lit("None")), F.lit(")"))),
            F.when(F.col("ssid_suspicious") > 0.5, "Suspicious SSID Pattern"),
            F.when(F.col("beacon_anomaly") > 0.5, "Beacon Anomaly Detected"),
        ))),
    }).drop("_trusted", "_k_ssid", "_k_bssid")


def ml_features(df: DataFrame) -> DataFrame:
    """Eight model inputs from telemetry; overwrites rssi_dbm and channel as doubles."""
    yes = lambda n: F.coalesce(_col(df, n, "boolean"), F.lit(False))
    one = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    return df.withColumns({
        "rssi_dbm": F.coalesce(_col(df, "rssi_dbm", "double"), F.lit(-100.0)),
        "channel": F.coalesce(_col(df, "channel", "double"), F.lit(0.0)),
        "enc_open": one(~yes("privacy")), "enc_wep": F.lit(0.0),
        "enc_wpa2": one(yes("privacy") & ~yes("pmf")), "enc_wpa3": one(yes("privacy") & yes("pmf")),
        "is_hidden": one(F.coalesce(_col(df, "ssid", "string"), F.lit("")) == ""), "wps_enabled": one(yes("wps")),
    })


# Category of each reason code.
REASON_CATEGORY = {
    "SSID_SPOOFING": "threat", "SECURITY_DOWNGRADE": "configuration", "CHANNEL_MISMATCH": "signal",
    "RSSI_ANOMALY": "signal", "DEAUTH_FLOOD": "behavior", "UNKNOWN_DEVICE": "behavior",
}


def score_findings(df: DataFrame) -> DataFrame:
    """Risk = confidence x impact, severity by strict limits; impact by the first reason's category.

    Reads confidence_raw and reason_codes, or an explicit ``impact`` column.
    """
    from skyfence.functions.radio import lookup

    if "impact" not in df.columns:
        kind = F.coalesce(lookup(REASON_CATEGORY, F.get("reason_codes", F.lit(0))), F.lit(""))
        df = df.withColumn("impact", F.when(kind == "threat", 90.0).when(kind == "configuration", 40.0).otherwise(50.0))
    clamp = lambda c, hi: F.greatest(F.lit(0.0), F.least(F.lit(hi), F.col(c).cast("double")))
    df = df.withColumn("risk_score", clamp("confidence_raw", 1.0) * clamp("impact", 100.0))
    s = F.col("risk_score")
    return df.withColumn("severity", F.when(s > 80, "critical").when(s > 60, "high").when(s > 30, "medium").otherwise("low"))


def recommend(scored: DataFrame) -> DataFrame:
    """Advice per scored network, most urgent first."""
    enc = F.upper(F.coalesce(_col(scored, "encryption", "string"), F.lit("Unknown")))
    twin = F.coalesce(_col(scored, "is_evil_twin", "boolean"), F.lit(False))
    wps = F.coalesce(_col(scored, "wps_enabled", "boolean"), F.lit(False))
    default_name = F.coalesce(_col(scored, "ssid", "string").contains("Default"), F.lit(False)) | (F.col("ssid_suspicious") > 0.5)
    score = F.col("risk_score")
    advice = F.array_compact(F.array(
        F.when(twin, "CRITICAL: evil twin, disconnect and verify the access point address"),
        F.when(enc.contains("OPEN") | (F.col("enc_score") > 0.8), "Critical: open network, use a VPN for all traffic")
        .when(enc.contains("WEP"), "High: WEP is broken, upgrade to WPA2 or WPA3")
        .when(enc.contains("WPA") & ~enc.contains("WPA2") & ~enc.contains("WPA3"), "Medium: WPA1 is deprecated, upgrade to WPA2"),
        F.when(wps, "Hardening: disable WPS"),
        F.when(default_name, "Hardening: change the default network name"),
        F.when((F.col("rssi_norm") > 0.9) & (score > 70), "Physical: high-risk access point close by"),
        F.when(score > 80, "Action: full security audit of this network").when(score > 50, "Action: monitor for suspicious clients"),
    ))
    return scored.withColumn("recommendations", advice)
