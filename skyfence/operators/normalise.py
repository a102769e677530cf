"""Clean-up, privacy and enrichment jobs over a telemetry table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfence.functions import mac, radio
from skyfence.operators.timeline import US, thin

# Vendor prefixes.
VENDORS = {
    "00:00:0C": "Cisco", "00:01:42": "Cisco", "00:0C:29": "VMware", "00:0C:41": "Cisco-Linksys", "00:0E:35": "Intel",
    "00:0F:B5": "Netgear", "00:14:BF": "Linksys", "00:17:C4": "Netgear", "00:18:E7": "Cameo", "00:1A:2B": "Ayecom",
    "00:1B:21": "Intel", "00:1B:63": "Apple", "00:1C:B3": "Apple", "00:1E:58": "D-Link", "00:1F:33": "Netgear",
    "00:1F:3A": "Hon Hai", "00:21:5D": "Intel", "00:22:6B": "Cisco", "00:23:69": "Cisco", "00:24:B2": "Netgear",
    "00:24:D4": "FREEBOX", "00:25:00": "Apple", "00:25:9C": "Cisco", "00:26:5A": "D-Link", "00:27:0E": "Intel",
    "00:50:F2": "Microsoft", "00:E0:4C": "Realtek", "08:00:27": "PCS", "14:91:82": "TP-Link", "14:CF:E2": "Apple",
    "18:D6:C7": "TP-Link", "18:E8:29": "Apple", "1C:1B:0D": "Apple", "1C:7E:E5": "D-Link", "20:AA:4B": "Cisco-Linksys",
    "24:0A:C4": "Espressif", "28:CF:E9": "Apple", "30:AE:A4": "Espressif", "3C:15:C2": "Apple", "3C:D9:2B": "HP",
    "40:16:7E": "ASUSTek", "40:6C:8F": "Apple", "44:D8:84": "Apple", "48:45:20": "Intel", "50:C7:BF": "TP-Link",
    "58:6D:8F": "Cisco-Linksys", "5C:F9:38": "Apple", "60:03:08": "Apple", "60:A4:4C": "ASUSTek", "64:A5:C3": "Apple",
    "68:A8:6D": "Apple", "68:B6:B3": "Netgear", "70:73:CB": "Apple", "70:85:C2": "ASRock", "74:DA:38": "Edimax",
    "78:8A:20": "Ubiquiti", "78:CA:39": "Apple", "7C:D1:C3": "Apple", "80:2A:A8": "Ubiquiti", "80:86:F2": "Intel",
    "84:38:35": "Apple", "84:D4:7E": "Aruba", "88:15:44": "Cisco", "88:E9:FE": "Apple", "8C:85:90": "Apple",
    "94:10:3E": "Belkin", "9C:04:EB": "Apple", "A4:08:F5": "Apple", "A4:5E:60": "Apple", "AC:22:0B": "ASUSTek",
    "AC:84:C6": "TP-Link", "AC:BC:32": "Apple", "B0:39:56": "Netgear", "B0:C0:90": "Chicony", "B8:27:EB": "Raspberry Pi",
    "BC:83:85": "Microsoft", "C0:C1:C0": "Cisco-Linksys", "C8:6F:1D": "Apple", "C8:D7:19": "Cisco-Linksys",
    "CC:32:E5": "TP-Link", "D0:23:DB": "Apple", "D4:3D:7E": "Micro-Star", "DC:A6:32": "Raspberry Pi", "DC:A9:04": "Apple",
    "E0:B9:A5": "Apple", "E4:C6:3D": "Apple", "E4:F4:C6": "Netgear", "E8:DE:27": "TP-Link", "F0:18:98": "Apple",
    "F0:9F:C2": "Ubiquiti", "F4:5C:89": "Apple", "F4:F2:6D": "TP-Link", "F8:1E:DF": "Apple", "FC:E9:98": "Apple",
}
TRUSTED = ["cisco", "aruba", "juniper", "fortinet", "meraki", "ruckus", "ubiquiti", "hp", "arista"]
CONSUMER = ["tp-link", "netgear", "linksys", "d-link", "asus", "belkin", "edimax", "tenda", "zyxel"]


def canonicalise(
    df: DataFrame, macs: tuple[str, ...] = ("bssid",), times: tuple[str, ...] = ("timestamp_utc", "timestamp", "ingested_at")
) -> DataFrame:
    """Canonical addresses, NUL-free names, and ``ts`` from the first readable time column."""
    cols = {m: mac.canonical_mac(m) for m in macs}
    if "ssid" in df.columns:
        cols["ssid"] = mac.clean_ssid("ssid")
    found = [mac.parse_time(t) for t in times if t in df.columns]
    if found:
        cols["ts"] = F.coalesce(*found)
    return df.withColumns(cols)


def pseudonymise(
    df: DataFrame, mode: str = "full", salt: str = "", ssid_mode: str | None = None,
    macs: tuple[str, ...] = ("bssid", "src_addr", "dst_addr"),
) -> DataFrame:
    """Replace every listed address in place and add a 16-digit ``<name>_hash``; optionally mask the name."""
    macs = tuple(m for m in macs if m in df.columns)
    cols = {f"{m}_hash": mac.mac_hash(m, salt) for m in macs}
    cols |= {m: mac.pseudonym(m, mode, salt) for m in macs}
    if ssid_mode and "ssid" in df.columns:
        cols["ssid"] = mac.masked_ssid("ssid", ssid_mode, salt)
    return df.withColumns(cols)


def builtin_vendors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(VENDORS.items()), "oui string, vendor string")


def enrich_vendor(df: DataFrame, oui_dim: DataFrame | None = None, bssid: str = "bssid") -> DataFrame:
    """Vendor by address prefix and its risk. A registry table of any size may be given.

    The built-in prefixes are literals. A given table is joined without a hint, so Spark
    broadcasts it only while its measured size is below the session's threshold.
    """
    keyed = df.withColumn("_oui", mac.oui(bssid))
    if oui_dim is None:
        out = keyed.withColumn("vendor", radio.lookup(VENDORS, F.col("_oui"), F.lit("Unknown")))
    else:
        dim = oui_dim.select(F.col("oui").alias("_oui"), "vendor").dropDuplicates(["_oui"])
        out = keyed.join(dim, "_oui", "left").withColumn("vendor", F.coalesce("vendor", F.lit("Unknown")))
    return out.drop("_oui").withColumn("vendor_risk", vendor_risk(F.col("vendor")))


def vendor_risk(vendor: Column) -> Column:
    v = F.lower(vendor)
    return F.when(v.rlike("|".join(TRUSTED)), 0.0).when(v.rlike("|".join(CONSUMER)), 0.3).otherwise(0.5)


def enrich_radio(df: DataFrame) -> DataFrame:
    """Add dictionary names for whichever code columns the table has."""
    c = F.col
    makers = {
        "channel_mhz": (["channel"], lambda: radio.channel_to_mhz(c("channel"))),
        "mhz_channel": (["frequency_mhz"], lambda: radio.mhz_to_channel(c("frequency_mhz"))),
        "type_name": (["type_code"], lambda: radio.frame_type_name(c("type_code"))),
        "subtype_name": (["type_code", "subtype_code"], lambda: radio.subtype_name(c("type_code"), c("subtype_code"))),
        "reason_name": (["reason_code"], lambda: radio.reason_name(c("reason_code"))),
        "cipher_name": (["cipher_code"], lambda: radio.cipher_name(c("cipher_code"))),
        "akm_name": (["akm_code"], lambda: radio.akm_name(c("akm_code"))),
    }
    return df.withColumns({n: make() for n, (need, make) in makers.items() if set(need) <= set(df.columns)})


def classify_security(df: DataFrame, variant: str = "live", out: str = "security_class") -> DataFrame:
    """Security name from capability columns.

    ``live``: a given ``security`` wins, then RSN with PMF, RSN, WPA, privacy bit.
    ``twin``: no privacy bit is open; an SAE key suite means WPA3. ``audit``: capability flags only.
    Columns read: security, has_rsn, has_wpa, privacy, pmf, akm (array), wpa3, wpa2.
    """
    yes = lambda n: F.coalesce(F.col(n).cast("boolean"), F.lit(False)) if n in df.columns else F.lit(False)
    if variant == "live":
        seen = F.when(yes("has_rsn") & yes("pmf"), "WPA3").when(yes("has_rsn"), "WPA2").when(yes("has_wpa"), "WPA").when(yes("privacy"), "WEP").otherwise("OPEN")
        given = F.when(F.col("security") != "", F.col("security")) if "security" in df.columns else F.lit(None)
        return df.withColumn(out, F.coalesce(given, seen))
    if variant == "twin":
        sae = F.coalesce(F.exists("akm", lambda a: a.contains("SAE")), F.lit(False)) if "akm" in df.columns else F.lit(False)
        return df.withColumn(
            out, F.when(~yes("privacy"), "OPEN").when(sae, "WPA3").when(yes("has_rsn"), "WPA2").when(yes("has_wpa"), "WPA").otherwise("WEP")
        )
    if variant == "audit":
        return df.withColumn(out, F.when(yes("wpa3"), "WPA3").when(yes("wpa2"), "WPA2").when(yes("privacy"), "WEP").otherwise("Open"))
    raise ValueError(f"unknown variant {variant!r}")


def dedup_frames(frames: DataFrame, window_s: float = 5.0) -> DataFrame:
    """Drop repeats of (bssid, sequence, type, name) within the window of the last kept one.

    Deauthentication and disassociation frames always pass: their repetition is the signal.
    """
    exempt = F.coalesce(F.col("frame_type").isin("deauth", "disassoc"), F.lit(False))
    kept = thin(frames.filter(~exempt), ["bssid", "seq_num", "frame_type", "ssid"], int(window_s * US))
    return kept.unionByName(frames.filter(exempt))
