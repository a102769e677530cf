"""One alert schema for every detector."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMMON = {
    "alert_type": "string",
    "severity": "string",
    "title": "string",
    "description": "string",
    "bssid": "string",
    "ssid": "string",
    "attacker": "string",
    "sensor_id": "string",
    "event_id": "bigint",
    "t_us": "bigint",
    "mitre_attack": "string",
    "reason_codes": "array<string>",
}

# Severities, weakest first.
SEVERITIES = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]


def severity_rank(col: str | Column) -> Column:
    """1 for INFO up to 5 for CRITICAL, 0 for anything else."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.upper(col)), F.lit(0))


def tiers(*rules: tuple[Column, str], default: str) -> Column:
    """First severity whose condition holds."""
    out = None
    for cond, name in rules:
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(default)


def as_alert(
    df: DataFrame,
    alert_type: str,
    severity: Column | str,
    title: Column | str,
    mitre: str,
    evidence: list[str],
    reasons: Column | None = None,
    **given: Column,
) -> DataFrame:
    """Common alert columns first, then the detector's own evidence columns."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    made = {
        "alert_type": F.lit(alert_type),
        "severity": lit(severity),
        "title": lit(title),
        "mitre_attack": F.lit(mitre),
        "reason_codes": reasons if reasons is not None else F.array(F.lit(alert_type.upper())),
        **given,
    }
    cols = []
    for name, kind in COMMON.items():
        if name in made:
            cols.append(made[name].cast(kind).alias(name))
        elif name in df.columns:
            cols.append(F.col(name).cast(kind).alias(name))
        else:
            cols.append(F.lit(None).cast(kind).alias(name))
    return df.select(*cols, *evidence)


def normalise_alerts(*dfs: DataFrame) -> DataFrame:
    """Bring any alert tables to one schema; columns outside it travel as JSON evidence.

    Defaults: type ``unknown``, severity ``MEDIUM``, a title made from the type, empty
    description, sensor ``unknown``.
    """

    def one(df: DataFrame) -> DataFrame:
        have = set(df.columns)
        extra = [c for c in df.columns if c not in COMMON and c != "evidence"]
        get = lambda n: F.col(n).cast(COMMON[n]) if n in have else F.lit(None).cast(COMMON[n])
        kind = F.coalesce(get("alert_type"), F.lit("unknown"))
        cols = {n: get(n) for n in COMMON}
        cols["alert_type"] = kind
        cols["severity"] = F.upper(F.coalesce(get("severity"), F.lit("MEDIUM")))
        cols["title"] = F.coalesce(get("title"), F.concat(F.lit("Alert: "), kind))
        cols["description"] = F.coalesce(get("description"), F.lit(""))
        cols["sensor_id"] = F.coalesce(get("sensor_id"), F.lit("unknown"))
        if "evidence" in have:
            proof = F.col("evidence").cast("string")
        elif extra:
            proof = F.to_json(F.struct(*extra))
        else:
            proof = F.lit("{}")
        return df.select(*[c.alias(n) for n, c in cols.items()], proof.alias("evidence"))

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [one(d) for d in dfs])
