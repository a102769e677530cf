"""Named detector profiles and the registration point for own detectors."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfence.operators import detectors as D
from skyfence.operators.alerts import normalise_alerts
from skyfence.operators.rules import apply_rules

Detector = Callable[..., DataFrame]

REGISTRY: dict[str, tuple[Detector, tuple[str, ...] | None, tuple[str, ...]]] = {}


def register(name: str, fn: Detector, frame_types: tuple[str, ...] | None = None, required: tuple[str, ...] = ()) -> None:
    """Add a detector ``fn(frames, **config) -> alerts``.

    Only frames of the given types with all required fields reach it; the filter is part of its
    plan, so Spark pushes it to the scan.
    """
    REGISTRY[name] = (fn, frame_types, required)


register("deauth_flood", D.deauth_flood, ("deauth",), ("bssid",))
register("disassoc_flood", D.disassoc_flood, ("disassoc",), ("bssid",))
register("beacon_flood", D.beacon_flood, ("beacon",), ("bssid",))
register("krack", D.krack, None, ("bssid", "eapol_message"))
register("pmkid", D.pmkid, ("auth", "assoc_req", "eapol"), ("bssid",))
register("wep_iv", D.wep_attacks, ("beacon", "probe_resp", "data"), ("bssid",))
register("evil_twin", D.evil_twin, ("beacon", "probe_resp"), ("bssid", "ssid"))
register("karma", D.karma, ("beacon", "probe_resp"), ("bssid",))
register("jamming", D.jamming)
register("wardrive", D.wardriver, ("probe_req",), ("src_addr",))
register("rules", apply_rules)

LITE = ["deauth_flood", "disassoc_flood", "beacon_flood", "krack", "pmkid", "wep_iv", "rules"]
FULL = [*LITE[:-1], "evil_twin", "karma", "jamming", "wardrive", "rules"]
PROFILES = {"lite_realtime": LITE, "full_wids": FULL, "audit_offline": FULL}


def run_detectors(frames: DataFrame, profile: str | list[str] = "lite_realtime", overrides: dict[str, dict[str, Any]] | None = None, more: dict[str, tuple] | None = None) -> DataFrame:
    """Alerts of every detector of a profile, or of those named, in one schema.

    ``more``: detectors of this call alone, as ``register`` takes them: name to (function, frame types, columns required).
    """
    if isinstance(profile, str) and profile not in PROFILES:
        raise ValueError(f"no profile {profile!r}; there are {sorted(PROFILES)}")
    overrides, known = overrides or {}, {**REGISTRY, **(more or {})}
    out = []
    for name in PROFILES[profile] if isinstance(profile, str) else profile:
        fn, types, required = known[name]
        keep = [F.col("frame_type").isin(*types)] if types else []
        keep += [F.col(c).isNotNull() for c in required]
        rows = frames.filter(reduce(lambda a, b: a & b, keep)) if keep else frames
        out.append(fn(rows, **overrides.get(name, {})))
    return normalise_alerts(*out)
