"""From findings and alerts to what a person sees: suppression, state, chains, reports."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyfence.operators.alerts import severity_rank
from skyfence.operators.timeline import US, cooldown, episodes, running, slot_of


def with_fingerprint(findings: DataFrame) -> DataFrame:
    """SHA-256 over detector, entity and first reason (``UNKNOWN`` where there is none)."""
    reason = F.coalesce(F.get("reason_codes", F.lit(0)), F.lit("UNKNOWN"))
    raw = F.concat(F.coalesce("detector_id", F.lit("")), F.lit("|"), F.coalesce("entity_key", F.lit("")), F.lit("|"), reason)
    return findings.withColumn("fingerprint", F.sha2(raw, 256))


def triage(findings: DataFrame, suppress_s: float = 3600.0) -> DataFrame:
    """Findings to emit: new ones, ones riskier than all before, and ones after the quiet period.

    Needs detector_id, entity_key, reason_codes, risk_score, t_us, event_id. Escalations are known
    from a running maximum alone; the quiet period is the cooldown fold restarted by them.
    """
    rows = with_fingerprint(findings)
    rows = running(rows, ["fingerprint"], {"_max_before": ("max", F.col("risk_score"))})
    rows = rows.withColumn("_forced", F.coalesce(F.col("risk_score") > F.col("_max_before"), F.lit(False)))
    rows = rows.withColumn("emit_reason", F.when(F.col("_max_before").isNull(), "new").when(F.col("_forced"), "escalated").otherwise("recurring"))
    return cooldown(rows, ["fingerprint"], int(suppress_s * US), forced="_forced").drop("_max_before", "_forced")


def suppress_duplicates(alerts: DataFrame, quiet_s: float = 600.0) -> DataFrame:
    """At most one alert per (type, severity, address, title) in the quiet period after the last one sent."""
    return cooldown(alerts, ["alert_type", "severity", "bssid", "title"], int(quiet_s * US))


def event_states(findings: DataFrame) -> DataFrame:
    """State per fingerprint: span, count, highest risk and the severity it first came with."""
    return with_fingerprint(findings).groupBy("fingerprint").agg(
        F.min("t_us").alias("first_seen"), F.max("t_us").alias("last_seen"), F.count("*").alias("count"),
        F.max("risk_score").alias("max_risk_score"),
        F.max_by("severity", F.struct("risk_score", -F.col("t_us"), -F.col("event_id"))).alias("max_severity"),
    )


def report_summary(findings: DataFrame, networks: DataFrame | None = None) -> DataFrame:
    """Counts per severity with the totals a report opens with."""
    level = F.lower("severity")
    out = findings.agg(
        *[F.count_if(level == s).alias(s) for s in ("critical", "high", "medium", "low", "info")],
        F.count("*").alias("findings"), F.count_distinct("sensor_id").alias("sensors"),
    )
    if networks is None:
        return out
    one = networks.agg(F.count_distinct("bssid").alias("networks")).withColumn("_one", F.lit(1))
    return out.withColumn("_one", F.lit(1)).join(one, "_one").drop("_one")  # one row each


def ordered_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy(severity_rank("severity").desc(), "t_us", "event_id")


def action_plan(findings: DataFrame, n: int = 10) -> DataFrame:
    """The most severe distinct titles with what to do and by when."""
    rank = severity_rank("severity")
    due = F.when(F.col("timeline") == "Immediate", "Immediate").when(F.col("timeline") == "24-72h", "Within 3 days").when(
        F.col("timeline") == "1-4 weeks", "Within 4 weeks"
    ).otherwise("TBD")
    # Equal titles collapse in a mergeable aggregate: the most severe, then the smallest text.
    best = findings.groupBy("title").agg(F.min(F.struct(-rank, F.col("severity"), F.coalesce("remediation", "title").alias("task"), due.alias("due"))).alias("b"))
    return best.select("title", F.col("b.severity").alias("priority"), "b.task", "b.due").orderBy(
        severity_rank("priority").desc(), "title"
    ).limit(n)


CHAIN_DDL = (
    "sensor_id string, t_us bigint, event_id bigint, chain_start bigint, chain_event bigint, alerts bigint, severity string, "
    "alert_types string, target_bssid string, attacker string, duration_s double"
)


def no_chains() -> dict:
    """Live chains of one sensor, in plain values that a stream can keep as its state."""
    return {"made": 0, "by": {}, "chains": {}}


def join_chain(held: dict, gap_us: int, t_us: int, event_id: int, alert_type: str, severity: str, bssid: str | None, attacker: str | None) -> dict | None:
    """The chain that an alert continues, or None where it begins one.

    No two live chains share a target or an attacker: the later one would have joined the earlier, so a lookup by each key finds
    every match.
    """
    keys = [f"{kind}:{value}" for kind, value in (("bssid", bssid), ("attacker", attacker)) if value]
    found = [c for c in (held["chains"].get(held["by"].get(k)) for k in keys) if c and c["last"] > t_us - gap_us]
    chain = min(found, key=lambda c: c["no"]) if found else None
    if chain is None:
        held["made"] += 1
        chain = {"no": held["made"], "bssid": bssid, "attacker": attacker, "first": t_us, "event": event_id, "n": 0, "types": [], "critical": False}
        held["chains"][str(chain["no"])] = chain
        held["by"].update(dict.fromkeys(keys, str(chain["no"])))
    chain["last"] = t_us
    chain["n"] += 1
    chain["critical"] |= severity == "CRITICAL"
    if alert_type not in chain["types"]:
        chain["types"].append(alert_type)
    if not found and held["made"] % 1000 == 0:
        held["chains"] = {no: c for no, c in held["chains"].items() if c["last"] > t_us - gap_us}
        held["by"] = {k: no for k, no in held["by"].items() if no in held["chains"]}
    return chain if found else None


def chain_row(sensor_id: str, t_us: int, event_id: int, chain: dict) -> tuple:
    return (
        sensor_id, t_us, event_id, chain["first"], chain["event"], chain["n"], "CRITICAL" if chain["critical"] else "HIGH",
        ">".join(chain["types"]), chain["bssid"], chain["attacker"], round((t_us - chain["first"]) / US, 1),
    )


def exploit_chains(alerts: DataFrame, gap_s: float = 300.0) -> DataFrame:
    """Alerts of one sensor that share a target or an attacker, chained while no older than the gap.

    ``alert_types`` lists the kinds in order of first appearance, so a chain of any length stays small.
    Matching by either key depends on arrival order. A sensor's history falls apart wherever it is
    silent for the gap, so the unit of work is one busy spell; within it rows stream in time order
    and only live chains are held.
    """
    gap_us = int(gap_s * US)
    rows = alerts.select(
        F.coalesce("sensor_id", F.lit("")).alias("sensor_id"), "t_us", "event_id", "alert_type", "severity", "bssid", "attacker"
    )
    spells = episodes(rows, ["sensor_id"], gap_us - 1)
    rows = rows.withColumn("_slot", slot_of("t_us", gap_us - 1)).join(spells, ["sensor_id", "_slot"]).drop("_slot")
    parts = rows.repartition("sensor_id", "episode").sortWithinPartitions("sensor_id", "episode", "t_us", "event_id", "alert_type")

    def walk(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spell, live = None, no_chains()
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if (row.sensor_id, row.episode) != spell:
                    spell, live = (row.sensor_id, row.episode), no_chains()
                chain = join_chain(live, gap_us, row.t_us, row.event_id, row.alert_type, row.severity, row.bssid, row.attacker)
                if chain:
                    out.append(chain_row(row.sensor_id, row.t_us, row.event_id, chain))
            yield pd.DataFrame(out, columns=[c.strip().split(" ")[0] for c in CHAIN_DDL.split(",")])

    return parts.mapInPandas(walk, CHAIN_DDL)


def entity_chains(alerts: DataFrame, gap_s: float = 300.0) -> DataFrame:
    """The common case of one key: spells of alerts per (sensor, target), as plain aggregates."""
    gap_us = int(gap_s * US)
    rows = alerts.filter(F.col("bssid").isNotNull()).withColumn("_slot", slot_of("t_us", gap_us))
    keyed = rows.join(episodes(rows, ["sensor_id", "bssid"], gap_us), ["sensor_id", "bssid", "_slot"])
    return keyed.groupBy("sensor_id", "bssid", "episode").agg(
        F.count("*").alias("alerts"), F.max("t_us").alias("last_seen"), F.array_sort(F.collect_set("alert_type")).alias("alert_types"),
        F.when(F.bool_or(F.col("severity") == "CRITICAL"), "CRITICAL").otherwise("HIGH").alias("severity"),
    ).filter(F.col("alerts") > 1)
