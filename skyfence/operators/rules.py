"""Declarative rules compiled to column expressions, and network checklists."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfence.operators.timeline import US, cooldown

# The packaged rule set (id, name, severity, conditions, technique, technique name, tactic, cooldown).
CORE_RULES = [
    ("WIDS-001", "Open Network Detected", "high", [("security", "eq", "Open")], "T1557", "Adversary-in-the-Middle", "Credential Access", 3600),
    ("WIDS-002", "WEP Encryption Detected", "critical", [("security", "contains", "WEP")], "T1040", "Network Sniffing", "Credential Access", 3600),
    ("WIDS-003", "WPS Enabled", "medium", [("capabilities.wps", "eq", True)], "T1110", "Brute Force", "Credential Access", 3600),
    ("WIDS-004", "Suspicious Open Network SSID", "high", [("security", "eq", "Open"), ("ssid", "regex", "(?i)(free|guest|xfinity|starbucks|mcdonalds|airport|hotel)")], "T1557.002", "ARP Cache Poisoning", "Credential Access", 1800),
    ("WIDS-005", "Unusually Strong Signal", "low", [("rssi_dbm", ">=", -30)], "T1200", "Hardware Additions", "Initial Access", 900),
    ("WIDS-006", "Hidden SSID Network", "info", [("ssid", "eq", None)], "T1071", "Application Layer Protocol", "Command and Control", 7200),
    ("WIDS-007", "Default Router SSID", "low", [("ssid", "regex", "^(linksys|netgear|dlink|tplink|asus|belkin|default|setup|router)[_-]?")], "T1078", "Valid Accounts", "Persistence", 7200),
    ("WIDS-008", "Locally Administered MAC", "medium", [("bssid", "regex", "^[0-9A-Fa-f][26AaEe]:")], "T1036", "Masquerading", "Defense Evasion", 1800),
    ("WIDS-009", "PMF Not Enabled", "low", [("security", "regex", "WPA[23]"), ("capabilities.pmf", "eq", False)], "T1499", "Endpoint Denial of Service", "Impact", 7200),
    ("WIDS-010", "Non-Standard Beacon Interval", "info", [("beacon_interval_ms", "not_in", [100, 102, 103])], "T1071", "Application Layer Protocol", "Command and Control", 3600),
]
# The built-in default set.
DEFAULT_RULES = [
    ("WIDS-001", "Open Network Detected", "high", [("security", "eq", "Open")], "T1557", "Adversary-in-the-Middle", "Credential Access", 3600),
    ("WIDS-002", "WEP Encryption Detected", "critical", [("security", "contains", "WEP")], "T1040", "Network Sniffing", "Credential Access", 3600),
    ("WIDS-003", "WPS Enabled", "medium", [("capabilities.wps", "eq", True)], "T1110", "Brute Force", "Credential Access", 3600),
    ("WIDS-004", "Suspicious SSID Pattern", "medium", [("ssid", "regex", "(?i)(free|guest|xfinity|starbucks)")], "T1557.002", "ARP Cache Poisoning", "Credential Access", 1800),
    ("WIDS-005", "Unusually Strong Signal", "low", [("rssi_dbm", ">=", -30)], "T1200", "Hardware Additions", "Initial Access", 900),
    ("WIDS-006", "Fragmentation Attack Detected", "medium", [("fragment_num", ">", 0)], "T1030", "Data Transfer Size Limits", "Command and Control", 600),
    ("WIDS-007", "Potential Password Spraying", "high", [("frame_type", "in", ["auth", "assoc_resp"]), ("ies.status_code", "ne", 0)], "T1110.003", "Brute Force: Password Spraying", "Credential Access", 300),
    ("WIDS-008", "Unsecured Protocol in Use", "medium", [("frame_type", "eq", "data"), ("protocol", "in", ["TELNET", "FTP", "HTTP"])], "T1040", "Network Sniffing", "Credential Access", 1800),
]


def as_rules(rows: list[tuple]) -> list[dict]:
    names = ("rule_id", "name", "severity", "conditions", "mitre_technique_id", "mitre_technique_name", "mitre_tactic", "cooldown_seconds")
    out = [dict(zip(names, r)) for r in rows]
    for rule in out:
        rule["conditions"] = [dict(zip(("field", "op", "value"), c)) for c in rule["conditions"]]
    return out


def load_rules(path: str, spark: SparkSession | None = None) -> list[dict]:
    """Rules from a JSON file ``{"rules": [...]}``; with ``spark`` from any address that Spark reads, a folder of such files included."""
    if spark is None:
        with open(path) as f:
            return json.load(f)["rules"]
    files = spark.read.text(path, wholetext=True).orderBy(F.input_file_name()).collect()  # a rule set is a few kilobytes
    return [rule for f in files for rule in json.loads(f["value"])["rules"]]


def field_of(schema: T.StructType, dotted: str | None) -> tuple[Column, T.DataType | None]:
    """Column of a dotted path; a path the table does not have is a null of no type."""
    here: Any = schema
    col = None
    for part in (dotted or "").split("."):
        if isinstance(here, T.StructType) and part in here.names:
            col = F.col(f"`{part}`") if col is None else col.getField(part)
            here = here[part].dataType
        elif isinstance(here, T.MapType):
            col, here = F.try_element_at(col, F.lit(part)), here.valueType
        else:
            return F.lit(None), None
    return col, here


def _comparable(kind: T.DataType | None, value: Any) -> bool:
    if kind is None:
        return False
    if isinstance(value, bool):
        return isinstance(kind, (T.BooleanType, T.NumericType))
    if isinstance(value, (int, float)):
        return isinstance(kind, (T.NumericType, T.BooleanType))
    return isinstance(value, str) and isinstance(kind, T.StringType)


def condition(schema: T.StructType, cond: dict) -> Column:
    """One condition with the null rules of a dictionary lookup: never null itself.

    A missing value equals only null, is unequal to everything else and outside every list;
    ordering, ``contains`` and ``regex`` on a missing value are false.
    """
    col, kind = field_of(schema, cond.get("field"))
    op, value = cond.get("op", "eq"), cond.get("value")
    known = kind is not None and not isinstance(kind, T.NullType)
    one = lambda v: F.lit(int(v)) if isinstance(v, bool) and isinstance(kind, T.NumericType) else F.lit(v)
    base = col.cast("int") if isinstance(kind, T.BooleanType) and not isinstance(value, (bool, str, list, type(None))) else col
    false = F.lit(False)

    def equals(v: Any) -> Column:
        if v is None:
            return col.isNull() if known else F.lit(True)
        return F.coalesce(base == one(v), false) if _comparable(kind, v) else false

    if op in ("eq", "=="):
        return equals(value)
    if op in ("ne", "!="):
        return ~equals(value)
    if op in ("in", "not_in"):
        any_of = false
        for v in value if isinstance(value, list) else []:
            any_of = any_of | equals(v)
        return any_of if op == "in" else ~any_of
    if op == "exists":
        there = col.isNotNull() if known else false
        return there if value else ~there
    order = {"gt": "__gt__", ">": "__gt__", "gte": "__ge__", ">=": "__ge__", "lt": "__lt__", "<": "__lt__", "lte": "__le__", "<=": "__le__"}
    if op in order:
        return F.coalesce(getattr(base, order[op])(one(value)), false) if _comparable(kind, value) else false
    if op == "contains" and known:
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.array_contains(col, value), false)
        return F.coalesce(col.contains(value), false) if isinstance(kind, T.StringType) and value != "" else F.coalesce(F.length(col) > 0, false) if isinstance(kind, T.StringType) else false
    if op == "regex" and known:
        text = col.cast("string")
        full = (text != "") if isinstance(kind, T.StringType) else (col.cast("double") != 0)
        return F.coalesce(full & text.rlike(value), false)
    return false


def matches(schema: T.StructType, rule: dict) -> Column:
    """All conditions; a rule without conditions never matches."""
    out = None
    for cond in rule.get("conditions") or []:
        test = condition(schema, cond)
        out = test if out is None else out & test
    return F.lit(False) if out is None else out


def live_rules(rules: list[dict] | None) -> list[dict]:
    rules = as_rules(CORE_RULES) if rules is None else rules
    return [r for r in rules if r.get("enabled", True)] or [{"rule_id": "", "name": "", "conditions": []}]


def cooldown_us(rule: dict) -> int:
    return max(1, int(rule.get("cooldown_seconds", 300) * US))


def rule_hits(df: DataFrame, live: list[dict], *more: str) -> DataFrame:
    """event_id, t_us, sensor_id, bssid, ssid, rule_no (and ``more`` columns) for every match, in one pass and without state."""
    # Rows carry a small rule number until the cooldown has picked the few that stay.
    hits = F.array_compact(F.array(*[F.when(matches(df.schema, r), F.lit(i)) for i, r in enumerate(live)]))
    pick = lambda n: F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n)
    return df.select("event_id", "t_us", "sensor_id", pick("bssid"), pick("ssid"), *more, F.explode(hits).alias("rule_no"))


def apply_rules(df: DataFrame, rules: list[dict] | None = None, cool: bool = True) -> DataFrame:
    """Alerts of all rules in one pass over the table, then one cooldown per (sensor, rule)."""
    live = live_rules(rules)
    fired = rule_hits(df, live)
    if cool:
        waits = F.array(*[F.lit(cooldown_us(r)).cast("bigint") for r in live])
        fired = cooldown(fired.withColumn("cooldown_us", F.get(waits, "rule_no")), ["sensor_id", "rule_no"], "cooldown_us")
    return named_rules(fired, live)


def named_rules(fired: DataFrame, live: list[dict]) -> DataFrame:
    facts = F.array(*[F.struct(
        F.lit(r["rule_id"]).alias("rule_id"), F.lit(r["name"]).alias("title"), F.lit(r.get("severity", "medium").upper()).alias("severity"),
        F.lit(r.get("mitre_technique_id", "")).alias("mitre_attack"), F.lit(r.get("mitre_tactic", "")).alias("mitre_tactic"),
    ) for r in live])
    named = fired.withColumn("_f", F.get(facts, "rule_no"))
    return named.select("event_id", "t_us", "sensor_id", "bssid", "ssid", "_f.*", F.lit("rule_match").alias("alert_type"))


# Checklist entries (id, title, severity, score, test, timeline), with a remediation in own words.
HOME = [
    ("HOME-001", "Encryption Type Check", None, None, "open_or_tkip", "Immediate", "Switch the network to WPA3, or WPA2 with AES; a device that only knows WEP has to go."),
    ("HOME-002", "WPS Enabled", "High", 70, "wps", "24-72h", "Turn WPS off on the access point."),
    ("HOME-004", "Hidden SSID", "Low", 10, "hidden", "Optional", "Hiding the name protects nothing, so it may as well be shown."),
    ("HOME-008", "Channel Overlap", "Low", 10, "channel_overlap", "1-4 weeks", "Move to the least used of the channels 1, 6 and 11, or let the access point choose."),
]
SME = [
    ("SME-001", "802.1X Enterprise Authentication", "Critical", 90, "no_8021x", "1-4 weeks", "Replace the shared key by 802.1X against a RADIUS server, best with client certificates."),
    ("SME-003", "TKIP Cipher Enabled", "High", 70, "tkip", "24-72h", "Allow AES only and drop TKIP."),
    ("SME-004", "Duplicate SSID Detected", "Critical", 90, "duplicate_ssid", "Immediate", "Find the second sender on site and watch the name with an alert."),
    ("SME-005", "Unknown BSSID in Zone", "High", 70, "not_in_inventory", "24-72h", "Find the device; cut it off if nobody answers for it."),
]
BUILT_IN = [
    ("WIFI-001", "Open Network Detected", "High", 70, "open", "Immediate", "Require WPA2 or WPA3."),
    ("WIFI-002", "WEP Encryption Detected", "Critical", 90, "wep", "Immediate", "Replace WEP by WPA2 or WPA3."),
]
ENCRYPTION_SEVERITY = {"open": "Critical", "wep": "Critical", "wpa": "High", "wpa2_tkip": "High", "wpa2_ccmp": "Low", "wpa3": "Low"}
SEVERITY_SCORE = {"Critical": 90, "High": 70, "Medium": 40, "Low": 10}


def audit(networks: DataFrame, checklist: str = "home", inventory: DataFrame | None = None) -> DataFrame:
    """Findings per network for the home or sme checklist plus the built-in encryption policies, each with what was seen of the network.

    ``networks``: bssid, ssid, channel, security, privacy, wps, pairwise (array), akm (array).
    ``inventory``: known bssids of any number, joined by equality without a hint.
    """
    from skyfence.functions.radio import lookup

    entries = {"home": HOME, "sme": SME}[checklist] + BUILT_IN
    tests = {e[4] for e in entries}
    rows = networks
    if "channel_overlap" in tests:
        busy = networks.filter("channel > 0").groupBy("channel").agg((F.count("*") > 1).alias("_overlap"))
        rows = rows.join(busy, "channel", "left")
    if "duplicate_ssid" in tests:
        twins = networks.filter("ssid <> ''").groupBy("ssid").agg((F.count_distinct("bssid") > 1).alias("_twin"))
        rows = rows.join(twins, "ssid", "left")
    if "not_in_inventory" in tests and inventory is not None:
        rows = rows.join(inventory.select("bssid", F.lit(True).alias("_listed")).distinct(), "bssid", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    tkip = no(F.exists("pairwise", lambda p: p.contains("TKIP")))
    is_open = no(~F.col("privacy"))
    test = {
        "open_or_tkip": is_open | tkip, "tkip": tkip, "wps": no(F.col("wps")), "hidden": F.coalesce("ssid", F.lit("")) == "",
        "channel_overlap": no(F.col("_overlap")) if "_overlap" in rows.columns else F.lit(False),
        "duplicate_ssid": no(F.col("_twin")) if "_twin" in rows.columns else F.lit(False),
        "not_in_inventory": ~no(F.col("_listed")) if "_listed" in rows.columns else F.lit(False),
        "no_8021x": ~no(F.exists("akm", lambda a: a.contains("802.1X"))),
        "open": no(F.upper("security") == "OPEN"), "wep": no(F.upper("security").contains("WEP")),
    }
    # What was seen of the network, by test. The wording of the first four.
    saw_open, saw_tkip = F.when(is_open, F.concat(F.lit("Open network: "), F.coalesce("ssid", F.lit("")))), F.when(tkip, F.concat(F.lit("TKIP cipher: ['"), F.array_join("pairwise", "', '"), F.lit("']")))
    said = F.concat(F.lit("Security: "), F.coalesce("security", F.lit("")))
    evidence = {
        "open_or_tkip": [saw_open, saw_tkip], "tkip": [saw_tkip], "wps": [F.lit("WPS enabled in beacon")], "hidden": [F.lit("Hidden SSID broadcast")],
        "channel_overlap": [F.concat(F.lit("Other networks on channel "), F.col("channel").cast("string"))], "duplicate_ssid": [F.concat(F.lit("Other senders of the name "), F.col("ssid"))],
        "not_in_inventory": [F.concat(F.lit("Not in the inventory: "), F.col("bssid"))], "no_8021x": [F.concat(F.lit("Key management: "), F.coalesce(F.array_join("akm", ", "), F.lit("")))],
        "open": [said], "wep": [said],
    }
    mapped = lookup(ENCRYPTION_SEVERITY, F.lower("security"), F.lit("Medium"))
    hits = []
    for rid, title, severity, score, name, due, fix in entries:
        level = mapped if severity is None else F.lit(severity)
        points = lookup(SEVERITY_SCORE, mapped, F.lit(40)) if score is None else F.lit(score)
        hits.append(F.when(test[name], F.struct(
            F.lit(rid).alias("finding_id"), F.lit(title).alias("title"), level.alias("severity"), points.cast("int").alias("score"),
            F.lit(due).alias("timeline"), F.lit(fix).alias("remediation"), F.lit("Open").alias("status"), F.array_compact(F.array(*evidence[name])).alias("evidence"),
            F.lit(fix[:80]).alias("remediation_summary"),
        )))
    found = rows.select(*networks.columns, F.inline(F.array_compact(F.array(*hits))))
    return found.withColumn("evidence_summary", F.array_join("evidence", "; "))
