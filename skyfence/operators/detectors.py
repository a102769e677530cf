"""Frame detectors: floods, handshake abuse, spoofing, jamming, scanning.

Each takes the frame table and returns alerts. Time is event time; state is keyed as the
docstring says. Thresholds are keyword arguments with the usual defaults.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyfence.operators.alerts import as_alert, tiers
from skyfence.operators.timeline import US, cooldown, episodes, running, slot_of, trailing
from skyfence.session import shared_dir

BROADCAST = "FF:FF:FF:FF:FF:FF"


def _rate_reasons(code: str):
    return F.array(
        F.lit(code),
        F.concat(F.lit("RATE_"), F.col("rate_per_sec").cast("bigint").cast("string"), F.lit("_PER_SEC")),
        F.when(F.col("is_broadcast"), "BROADCAST_TARGET").otherwise("TARGETED_CLIENT"),
    )


def deauth_flood(
    frames: DataFrame, rate: float = 10.0, window_s: float = 2.0, cooldown_s: float = 60.0
) -> DataFrame:
    """Deauthentication flood per (bssid, client): trailing rate, severity by multiple of the limit."""
    hits = frames.filter((F.col("frame_type") == "deauth") & F.col("bssid").isNotNull()).select(
        "event_id", "t_us", "sensor_id", "bssid", F.coalesce("dst_addr", F.lit(BROADCAST)).alias("client")
    )
    seen = trailing(hits, ["bssid", "client"], int(window_s * US), {"frame_count": None})
    seen = seen.withColumn("rate_per_sec", F.col("frame_count") / F.lit(window_s))
    return deauth_alert(cooldown(seen.filter(F.col("rate_per_sec") >= rate), ["bssid", "client"], int(cooldown_s * US)), rate)


def deauth_alert(hits: DataFrame, rate: float) -> DataFrame:
    """Alerts from evidence rows; the streaming form makes the same rows."""
    out = hits.withColumn("is_broadcast", F.upper("client") == BROADCAST)
    r = F.col("rate_per_sec")
    return as_alert(
        out, "deauth_flood", tiers((r >= rate * 5, "CRITICAL"), (r >= rate * 2, "HIGH"), default="MEDIUM"),
        "Deauthentication flood", "T1499.001", ["client", "frame_count", "rate_per_sec", "is_broadcast"],
        _rate_reasons("DEAUTH_FLOOD"),
    )


def disassoc_flood(
    frames: DataFrame, rate: float = 10.0, window_s: float = 5.0, cooldown_s: float = 60.0, min_clients: int = 3
) -> DataFrame:
    """Disassociation flood per (bssid, client); many clients of the access point within the window raise the severity."""
    hits = frames.filter((F.col("frame_type") == "disassoc") & F.col("bssid").isNotNull()).select(
        "event_id", "t_us", "sensor_id", "bssid", F.coalesce("dst_addr", F.lit(BROADCAST)).alias("client")
    )
    known = trailing(hits, ["bssid"], int(window_s * US), {}, {"unique_clients": "client"})
    seen = trailing(known, ["bssid", "client"], int(window_s * US), {"frame_count": None})
    seen = seen.withColumn("rate_per_sec", F.col("frame_count") / F.lit(window_s))
    return disassoc_alert(cooldown(seen.filter(F.col("rate_per_sec") >= rate), ["bssid", "client"], int(cooldown_s * US)), rate, min_clients)


def disassoc_alert(hits: DataFrame, rate: float, min_clients: int) -> DataFrame:
    out = hits.withColumn("is_broadcast", F.upper("client") == BROADCAST)
    r, many = F.col("rate_per_sec"), F.col("unique_clients") >= min_clients
    return as_alert(
        out, "disassoc_flood",
        tiers((r >= rate * 5, "CRITICAL"), (many & (r >= rate * 2), "CRITICAL"), (r >= rate * 2, "HIGH"), (many, "HIGH"), default="MEDIUM"),
        "Disassociation flood", "T1499.001", ["client", "frame_count", "rate_per_sec", "unique_clients", "is_broadcast"],
        _rate_reasons("DISASSOC_FLOOD"),
    )


def beacon_flood(
    frames: DataFrame, ssids: int = 50, bssids: int = 10, window_s: int = 30, cooldown_s: int = 120, sample: int = 10
) -> DataFrame:
    """Fake-AP flood per sensor: distinct SSIDs or BSSIDs in the trailing window; ``sample`` names are shown as evidence."""
    width = window_s * US
    beacons = frames.filter((F.col("frame_type") == "beacon") & F.col("bssid").isNotNull()).select(
        "event_id", "t_us", "sensor_id",
        F.when(F.col("ssid") != "", F.col("ssid")).alias("name"),
        F.upper("bssid").alias("ap"),
        F.upper(F.substring("bssid", 1, 8)).alias("oui"),
    )
    seen = trailing(
        beacons, ["sensor_id"], width, {"beacon_count": None},
        {"unique_ssids": "name", "unique_bssids": "ap", "oui_count": "oui"},
    )
    n, m = F.col("unique_ssids"), F.col("unique_bssids")
    out = cooldown(
        seen.filter((n >= ssids) | (m >= bssids * 2)).drop("name", "ap", "oui"), ["sensor_id"], cooldown_s * US
    )
    # Sample names: an alert's window touches two slots; match on slots, then on time.
    spots = out.select("sensor_id", F.col("event_id").alias("_a"), F.col("t_us").alias("_at"))
    spots = spots.withColumn("_slot", F.explode(F.sequence(slot_of(F.col("_at") - width, width), slot_of("_at", width))))
    names = (
        beacons.filter(F.col("name").isNotNull()).withColumn("_slot", slot_of("t_us", width))
        .join(spots, ["sensor_id", "_slot"])
        .filter(F.col("t_us").between(F.col("_at") - width, F.col("_at")))
        .select("_a", "name").distinct()
    )
    rank = F.row_number().over(Window.partitionBy("_a").orderBy("name"))
    names = names.withColumn("_r", rank).filter(F.col("_r") <= sample)
    names = names.groupBy("_a").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("sample_ssids"))
    return beacon_alert(out.join(names, out["event_id"] == names["_a"], "left"), ssids, bssids, window_s)


def beacon_alert(hits: DataFrame, ssids: int, bssids: int, window_s: int) -> DataFrame:
    out = hits.withColumn("beacon_rate", F.bround(F.col("beacon_count") / window_s, 1))
    n, m = F.col("unique_ssids"), F.col("unique_bssids")
    severity = tiers(
        ((n >= ssids * 5) & (m >= bssids), "CRITICAL"), ((n >= ssids * 2) | (m >= bssids), "HIGH"), default="MEDIUM"
    )
    return as_alert(
        out, "beacon_flood", severity,
        F.concat(F.lit("Beacon flood: "), n.cast("string"), F.lit(" network names")), "T1498.001",
        ["unique_ssids", "unique_bssids", "oui_count", "beacon_count", "beacon_rate", "sample_ssids"],
    )


def krack(
    frames: DataFrame, m3_limit: int = 3, window_s: int = 30, cooldown_s: int = 120, replay_alert: bool = True
) -> DataFrame:
    """Key reinstallation per (bssid, client): message 3 after message 4, or too many message 3."""
    msg = F.col("eapol_message")
    talk = frames.filter(F.col("eapol_message").isNotNull() & F.col("bssid").isNotNull()).select(
        "event_id", "t_us", "sensor_id", "bssid", msg.cast("int").alias("eapol_message"),
        F.when(msg.isin(1, 3), F.col("dst_addr")).otherwise(F.col("src_addr")).alias("client"),
    ).filter(F.col("client").isNotNull())
    talk = running(talk, ["bssid", "client"], {"_turn": ("last", F.when(msg.isin(1, 4), msg))})
    talk = trailing(talk, ["bssid", "client"], window_s * US, {f"m{i}_count": msg == i for i in (1, 2, 3, 4)})
    done = F.coalesce(F.col("_turn") == 4, F.lit(False))
    replay = done & F.lit(replay_alert)
    hits = talk.filter((msg == 3) & (replay | (F.col("m3_count") >= m3_limit))).select(
        "*", done.alias("m4_completed"),
        F.when(replay, "m3_replay_after_m4").otherwise("excessive_m3_retransmission").alias("attack_subtype"),
    )
    return krack_alert(cooldown(hits, ["bssid", "client"], cooldown_s * US), m3_limit)


def krack_alert(out: DataFrame, m3_limit: int) -> DataFrame:
    severity = tiers(
        (F.col("attack_subtype") == "m3_replay_after_m4", "CRITICAL"), (F.col("m3_count") >= m3_limit * 2, "CRITICAL"),
        default="HIGH",
    )
    return as_alert(
        out, "krack_attack", severity, "Key reinstallation attack", "T1557.002",
        ["client", "attack_subtype", "m1_count", "m2_count", "m3_count", "m4_count", "m4_completed"],
    )


def pmkid(
    frames: DataFrame, m1_limit: int = 15, m1_window_s: int = 10, auth_limit: int = 50, auth_window_s: int = 5,
    min_sources: int = 5, cooldown_s: int = 60,
) -> DataFrame:
    """PMKID harvesting per bssid: unanswered message 1 and authentication floods."""
    from skyfence.operators.handshake import pending_m1

    eapol = F.col("eapol_message")
    is_auth = F.col("frame_type").isin("auth", "assoc_req")
    talk = frames.filter(F.col("bssid").isNotNull() & (is_auth | eapol.isNotNull())).select(
        "event_id", "t_us", "sensor_id", "bssid", eapol.cast("int").alias("eapol_message"),
        F.when(is_auth, F.col("src_addr")).alias("source"), (is_auth & F.col("src_addr").isNotNull()).alias("is_auth"),
    )
    talk = pending_m1(talk, m1_window_s * US)
    talk = trailing(talk, ["bssid"], auth_window_s * US, {"auth_count": F.col("is_auth")}, {"unique_sources": "source"})
    by_m1 = F.col("orphaned_m1") >= m1_limit
    by_auth = (F.col("auth_count") >= auth_limit) & (F.col("unique_sources") >= min_sources)
    hits = talk.filter(~(F.coalesce(F.col("eapol_message"), F.lit(0)) == 2) & (by_m1 | by_auth)).select(
        "event_id", "t_us", "sensor_id", "bssid", "orphaned_m1", "auth_count", "unique_sources",
        by_m1.alias("m1_flood"), by_auth.alias("auth_flood"),
    )
    path = shared_dir(frames.sparkSession, "pmkid")
    hits.write.parquet(path)  # few rows at the end of a long plan, which the cooldown reads three times
    hits = frames.sparkSession.read.schema(hits.schema).parquet(path)
    return pmkid_alert(cooldown(hits, ["bssid"], cooldown_s * US))


def pmkid_alert(out: DataFrame) -> DataFrame:
    reasons = F.array_compact(
        F.array(F.when(F.col("m1_flood"), "EAPOL_M1_FLOOD"), F.when(F.col("auth_flood"), "AUTH_FLOOD_RANDOM_MAC"))
    )
    return as_alert(
        out, "pmkid_harvesting", tiers((F.col("m1_flood") & F.col("auth_flood"), "CRITICAL"), default="HIGH"),
        "PMKID harvesting", "T1110.002", ["orphaned_m1", "auth_count", "unique_sources"], reasons,
    )


def wep_attacks(
    frames: DataFrame, iv_limit: int = 5, inject_limit: int = 50, small_len: int = 150, window_s: int = 60,
    rearm: int = 1000,
) -> DataFrame:
    """IV reuse and small-packet injection on WEP networks, per aligned window.

    A network is WEP while its latest beacon says privacy without RSN/WPA. After an injection
    alert the counter has to climb ``rearm + inject_limit`` frames again.
    """
    ad = F.col("frame_type").isin("beacon", "probe_resp")
    data = F.col("frame_type") == "data"
    wep = F.col("privacy") & ~F.col("security").isin("WPA", "WPA2", "WPA3")
    rows = frames.filter((ad | data) & F.col("bssid").isNotNull()).select(
        "event_id", "t_us", "sensor_id", "bssid", "frame_type", "wep_iv", "frame_len", F.when(ad, wep).alias("_wep")
    )
    rows = running(rows, ["bssid"], {"_is_wep": ("last", F.col("_wep"))})
    rows = rows.filter(data & F.col("_is_wep")).withColumn("_win", slot_of("t_us", window_s * US))
    upto = lambda *k: Window.partitionBy("bssid", "_win", *k).orderBy("t_us", "event_id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    rows = rows.repartition("bssid", "_win")
    rows = rows.withColumn("_nth", F.when(F.col("wep_iv").isNotNull(), F.count("*").over(upto("wep_iv"))).otherwise(0))
    reuse = F.col("_nth") >= iv_limit
    small = ~reuse & F.coalesce(F.col("frame_len").between(1, small_len), F.lit(False))
    rows = rows.withColumn("_small", small).withColumn("_smalls", F.sum(F.col("_small").cast("int")).over(upto()))
    cycle = rearm + inject_limit
    flood = F.col("_small") & (F.pmod(F.col("_smalls"), F.lit(cycle)) == inject_limit % cycle)
    out = rows.filter(reuse | flood).select(
        "event_id", "t_us", "sensor_id", "bssid",
        F.when(reuse, "iv_collision").otherwise("packet_injection").alias("attack_subtype"),
        F.when(reuse, F.col("wep_iv")).alias("wep_iv"),
        F.when(reuse, F.col("_nth")).otherwise(inject_limit).cast("bigint").alias("hit_count"),
    )
    return wep_alert(out)


def wep_alert(out: DataFrame) -> DataFrame:
    return as_alert(
        out, "wep_attack", tiers((F.col("attack_subtype") == "iv_collision", "CRITICAL"), default="HIGH"),
        "WEP attack", "T1600.001", ["attack_subtype", "wep_iv", "hit_count"],
        F.array(F.upper("attack_subtype")),
    )


def _nth_name(frames: DataFrame, key: str, gap_us: int, limits: list[int]) -> DataFrame:
    """The sightings that bring a key's distinct names to each of ``limits`` within an activity episode.

    ``names`` are those up to that sighting; ``episode_names`` has the extent of whole episodes.
    """
    sighted = frames.groupBy(key, slot_of("t_us", gap_us).alias("_slot"), "name").agg(
        F.min(F.struct("t_us", "event_id", "sensor_id")).alias("_first")
    )
    first = (
        sighted.join(episodes(frames, [key], gap_us), [key, "_slot"])
        .filter(F.col("name").isNotNull())
        .groupBy(key, "episode", "name").agg(F.min("_first").alias("_first"))
    )
    rank = F.row_number().over(Window.partitionBy(key, "episode").orderBy("_first"))
    ranked = first.withColumn("_n", rank).filter(F.col("_n") <= max(limits))
    known = ranked.groupBy(key, "episode").agg(F.array_sort(F.collect_list(F.struct("_n", "_first", "name"))).alias("_known"))
    reached = known.withColumn("_nth", F.explode(F.array(*[F.lit(n) for n in limits]))).filter(F.col("_nth") <= F.size("_known"))
    names = F.array_sort(F.transform(F.slice("_known", 1, F.col("_nth")), lambda x: x["name"]))
    return (
        reached.select(key, "episode", F.element_at("_known", F.col("_nth"))["_first"].alias("_hit"), F.col("_nth").cast("bigint").alias("name_count"), F.array_join(names, ",").alias("names"))
        .select(key, "episode", "_hit.*", "name_count", "names")
        .withColumn("duration_s", F.bround((F.col("t_us") - F.col("episode")) / F.lit(US), 1))
    )


def name_limits(first: int, higher: list[int], escalate: bool) -> list[int]:
    """The first limit, and if wanted the higher ones beyond it."""
    return [first, *sorted({n for n in higher if n > first and escalate})]


def episode_names(frames: DataFrame, key: str, idle_s: int = 60) -> DataFrame:
    """How many distinct names each activity episode of a key had in all: key, episode (its begin), names. ``frames``: key, t_us, ssid."""
    rows = frames.filter(F.col(key).isNotNull()).select(key, "t_us", F.when(~F.col("ssid").isin("", "<Hidden>"), F.col("ssid")).alias("name"))
    slots = rows.select(key, slot_of("t_us", idle_s * US).alias("_slot"), "name").distinct()
    return slots.join(episodes(rows, [key], idle_s * US), [key, "_slot"]).groupBy(key, "episode").agg(F.count_distinct("name").alias("names"))


def karma(frames: DataFrame, ssids: int = 3, critical: int = 5, idle_s: int = 60, escalate: bool = False) -> DataFrame:
    """One AP answering for several network names, once per activity episode of the AP.

    With ``escalate`` an episode that goes on to ``critical`` names raises a second alert there.
    """
    ads = frames.filter(
        F.col("frame_type").isin("beacon", "probe_resp") & F.col("bssid").isNotNull()
        & F.col("ssid").isNotNull() & ~F.col("ssid").isin("", "<Hidden>")
    ).select("event_id", "t_us", "sensor_id", "bssid", F.col("ssid").alias("name"))
    return karma_alert(_nth_name(ads, "bssid", idle_s * US, name_limits(ssids, [critical], escalate)), critical)


def karma_alert(out: DataFrame, critical: int) -> DataFrame:
    return as_alert(
        out, "karma_attack", tiers((F.col("name_count") >= critical, "CRITICAL"), default="HIGH"),
        "Karma / rogue access point", "T1557.002", ["name_count", "names", "duration_s"],
    )


def wardriver(
    frames: DataFrame, ssids: int = 5, high: int = 10, critical: int = 15, idle_s: int = 60, escalate: bool = False
) -> DataFrame:
    """A station probing for many network names, once per activity episode of the station.

    With ``escalate`` an episode raises a further alert where it reaches ``high`` and ``critical`` names.
    """
    probes = frames.filter((F.col("frame_type") == "probe_req") & F.col("src_addr").isNotNull()).select(
        "event_id", "t_us", "sensor_id", F.col("src_addr").alias("attacker"),
        F.when(F.col("ssid") != "", F.col("ssid")).alias("name"),
    )
    return wardriver_alert(_nth_name(probes, "attacker", idle_s * US, name_limits(ssids, [high, critical], escalate)), high, critical)


def wardriver_alert(out: DataFrame, high: int, critical: int) -> DataFrame:
    n = F.col("name_count")
    return as_alert(
        out, "wardrive_detected", tiers((n >= critical, "CRITICAL"), (n >= high, "HIGH"), default="MEDIUM"),
        "Active wardriving", "T1595.002", ["name_count", "names", "duration_s"],
    )


def jamming(
    frames: DataFrame, window_s: int = 10, min_frames: int = 20, retry_limit: float = 0.4, rts_limit: int = 50,
    high: int = 60, critical: int = 80, weight_loss: int = 40, weight_congestion: int = 30, samples: int = 100,
) -> DataFrame:
    """Retry rate and RTS/CTS load per (sensor, channel) and aligned interval; the signal is the mean of the last ``samples`` frames."""
    keys = ["sensor_id", "channel", "_win"]
    base = frames.withColumn("_win", slot_of("t_us", window_s * US))
    stats = base.groupBy(*keys).agg(
        F.count("*").alias("total_frames"),
        F.count_if(F.col("retry")).alias("_retries"),
        F.count_if(F.col("frame_type").isin("rts", "cts")).alias("rts_cts_count"),
        F.max(F.struct("t_us", "event_id")).alias("_last"),
    ).filter(F.col("total_frames") >= min_frames).select("*", "_last.*")
    share = F.col("_retries") / F.col("total_frames")
    loss = F.when(share > retry_limit, (F.lit(weight_loss) * F.least(F.lit(1.0), (share - retry_limit) / 0.5)).cast("int")).otherwise(0)
    load = F.when(F.col("rts_cts_count") > rts_limit, weight_congestion).otherwise(0)
    bad = stats.select(
        *keys, "t_us", "event_id", "total_frames", share.alias("retry_rate"), "rts_cts_count",
        (loss + load).cast("bigint").alias("score"),
    ).filter(F.col("score") >= high)
    # Signal average over the interval's last samples, read only for alerting intervals.
    newest = Window.partitionBy(*keys).orderBy(F.col("t_us").desc(), F.col("event_id").desc())
    level = (
        base.filter(F.col("rssi_dbm").isNotNull()).select(*keys, "t_us", "event_id", "rssi_dbm")
        .join(bad.select(*keys), keys, "left_semi")
        .withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= samples)
        .groupBy(*keys).agg(F.avg("rssi_dbm").alias("avg_rssi"))
    )
    return jamming_alert(bad.join(level, keys, "left"), critical)


def jamming_alert(hits: DataFrame, critical: int) -> DataFrame:
    out = hits.withColumn("avg_rssi", F.coalesce("avg_rssi", F.lit(-100.0)))
    return as_alert(
        out, "jamming_detected", tiers((F.col("score") >= critical, "CRITICAL"), default="HIGH"),
        "Wireless jamming / interference", "T1465",
        ["channel", "score", "total_frames", "retry_rate", "rts_cts_count", "avg_rssi"],
    )


def deauth_bursts(frames: DataFrame, n: int = 10, window_s: float = 1.0) -> DataFrame:
    """Offline search for bursts: at least n deauths of a sensor's capture within the window ahead."""
    width = int(window_s * US)
    hits = frames.filter(F.col("frame_type") == "deauth").select(
        "event_id", "t_us", (-F.col("t_us")).alias("_back"), "sensor_id", "bssid", F.col("src_addr").alias("attacker"),
        F.col("dst_addr").alias("client"),
    )
    ahead = trailing(hits, ["sensor_id"], width, {"frame_count": None}, t="_back").drop("_back")
    out = cooldown(ahead.filter(F.col("frame_count") >= n), ["sensor_id"], width + 1)
    return as_alert(out, "deauth_burst", "CRITICAL", "Deauthentication burst", "T1499.001", ["client", "frame_count"])


def evil_twin(
    frames: DataFrame, window_s: int = 120, slide_s: int = 30, confirm_s: int = 30, rssi_delta: int = 15,
    jitter_ms: float = 10.0, new_minutes: int = 10, report: int = 40, high: int = 60, critical: int = 80,
    immediate: int = 90,
) -> DataFrame:
    """Pairs of APs sharing a network name in one sensor's view, scored and confirmed over time.

    Frames collapse to panes of ``slide`` seconds per (sensor, name, AP); a window merges its
    panes, so pairing works on a sensor's APs of one name and window, never on frames. The
    busier AP counts as the original. A pair is reported once it scores again ``confirm``
    seconds after it first scored, or at once from ``immediate`` points.
    """
    panes_per = window_s // slide_s
    ads = twin_frames(frames)
    panes = ads.groupBy("sensor_id", "ssid", "bssid", slot_of("t_us", slide_s * US).alias("pane")).agg(*twin_sums())
    debut = panes.groupBy("sensor_id", "ssid", "bssid").agg(F.min("lo").alias("first_us"))
    wins = panes.withColumn("win", F.explode(F.sequence(F.col("pane"), F.col("pane") + panes_per - 1)))
    aps = wins.groupBy("sensor_id", "ssid", "bssid", "win").agg(
        *[F.sum(c).alias(c) for c in ("n", "rs", "rn", "bn", "b1", "b2")], F.min("who").alias("who"),
    ).join(debut, ["sensor_id", "ssid", "bssid"]).withColumn("seen_us", (F.col("win") + 1) * F.lit(slide_s * US))
    aps = twin_profiles(aps, "first_us")
    same = ["sensor_id", "ssid", "seen_us"]
    crowd = aps.groupBy(*same).agg(F.count("*").alias("duplicate_count")).filter(F.col("duplicate_count") > 1)
    a = aps.join(crowd, same).select(*same, "duplicate_count", *[F.col(c).alias(f"o_{c}") for c in aps.columns if c not in same])
    b = aps.select(*same, *[F.col(c).alias(f"s_{c}") for c in aps.columns if c not in same])
    busier = (F.col("o_n") > F.col("s_n")) | (
        (F.col("o_n") == F.col("s_n")) & (F.struct("o_first_us", "o_bssid") < F.struct("s_first_us", "s_bssid"))
    )
    pairs = twin_scores(a.join(b, same).filter(busier), rssi_delta, jitter_ms, new_minutes, report)
    life = Window.partitionBy("sensor_id", "ssid", "original", "bssid")
    upto = life.orderBy("t_us").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pairs = pairs.withColumn("_since", F.min("t_us").over(upto)).withColumn("score", F.max("now_score").over(upto))
    ready = (F.col("t_us") - F.col("_since") >= confirm_s * US) | ((F.col("t_us") == F.col("_since")) & (F.col("now_score") >= immediate))
    out = pairs.filter(ready).withColumn("_k", F.row_number().over(life.orderBy("t_us"))).filter(F.col("_k") == 1)
    return twin_alert(out, high, critical)


def twin_frames(frames: DataFrame) -> DataFrame:
    return frames.filter(F.col("frame_type").isin("beacon", "probe_resp") & F.col("bssid").isNotNull() & (F.col("ssid") != ""))


def twin_sums() -> list:
    """What a pane or window of an access point's frames adds up to, in whole numbers."""
    bi = F.col("beacon_interval").cast("bigint")
    who = F.struct("t_us", "event_id", "vendor_oui", "security", "wps", "pmf")
    return [
        F.count("*").alias("n"), F.sum("rssi_dbm").alias("rs"), F.count("rssi_dbm").alias("rn"),
        F.count(bi).alias("bn"), F.sum(bi).alias("b1"), F.sum(bi * bi).alias("b2"), F.min("t_us").alias("lo"), F.min(who).alias("who"),
    ]


def twin_profiles(aps: DataFrame, first_us: str) -> DataFrame:
    """The profile of each access point in a window, from its sums."""
    # Sample variance from whole-number sums: exact up to the final division.
    var = (F.col("bn") * F.col("b2") - F.col("b1") * F.col("b1")) / (F.col("bn") * (F.col("bn") - 1))
    return aps.select(
        "sensor_id", "ssid", "seen_us", "bssid", "n", F.col(first_us).alias("first_us"),
        F.when(F.col("rn") > 0, F.col("rs") / F.col("rn")).otherwise(-100.0).alias("rssi"),
        F.when(F.col("bn") > 1, F.round(F.sqrt(var), 9)).otherwise(0.0).alias("jitter"),
        F.upper("who.vendor_oui").alias("oui"), F.col("who.security").alias("sec"),
        F.col("who.wps").alias("wps"), F.col("who.pmf").alias("pmf"), *[c for c in ("ts",) if c in aps.columns],
    )


#: Columns of a profile that a pair carries for the original (o_) and the suspect (s_).
TWIN_SIDE = ["bssid", "n", "first_us", "rssi", "jitter", "oui", "sec", "wps", "pmf"]


def twin_scores(pairs: DataFrame, rssi_delta: int, jitter_ms: float, new_minutes: int, report: int) -> DataFrame:
    """Score pairs of profiles (o_..., s_...) of one sensor, name and window; those with at least ``report`` points."""
    gain = F.col("s_rssi") - F.col("o_rssi")
    shake = F.abs(F.col("s_jitter") - F.col("o_jitter"))
    strong, shaky = gain >= rssi_delta, shake > jitter_ms
    vendor, sec = F.col("o_oui") != F.col("s_oui"), F.col("o_sec") != F.col("s_sec")
    fresh = (F.col("seen_us") - F.col("s_first_us")) < F.lit(new_minutes * 60 * US)
    score = (
        F.lit(20)
        + F.when(strong, (F.lit(30) * F.least(F.lit(1.0), (gain - rssi_delta) / 20.0)).cast("int")).otherwise(0)
        + F.when(vendor, 15).otherwise(0) + F.when(sec, 15).otherwise(0)
        + F.when(shaky, (F.lit(10) * F.least(F.lit(1.0), shake / 50.0)).cast("int")).otherwise(0)
        + F.when(fresh, 5).otherwise(0)
    )
    return pairs.filter(score >= report).select(
        "sensor_id", "ssid", "duplicate_count", F.col("o_bssid").alias("original"), F.col("s_bssid").alias("bssid"),
        F.col("seen_us").alias("t_us"), F.least(score, F.lit(100)).cast("bigint").alias("now_score"),
        F.when(strong, gain).otherwise(0.0).alias("rssi_delta"), vendor.alias("vendor_mismatch"), sec.alias("security_mismatch"),
        fresh.alias("is_new"), shaky.alias("jittery"),
        (F.col("o_wps") != F.col("s_wps")).alias("wps_diff"), (F.col("o_pmf") != F.col("s_pmf")).alias("pmf_diff"),
        *[c for c in ("ts",) if c in pairs.columns],
    )


def twin_alert(out: DataFrame, high: int, critical: int) -> DataFrame:
    """Alerts from confirmed pairs; the streaming form makes the same rows."""
    diff = F.col("wps_diff") | F.col("pmf_diff")
    yes = lambda c: c.cast("int")
    out = out.withColumn("ie_diff", diff).withColumn(
        "confidence",
        (yes(F.col("rssi_delta") > 0) + yes(F.col("vendor_mismatch")) + yes(F.col("security_mismatch")) + yes(F.col("is_new")) + yes(F.col("ie_diff"))) / 5.0,
    )
    s = F.col("score")
    level = tiers((s >= critical, "CRITICAL"), (s >= high, "HIGH"), default="MEDIUM")
    advice = tiers(
        (s >= critical, "Immediate: investigate the suspect access point on site"),
        (s >= high, "Investigate: check the suspect against the access point inventory"),
        default="Monitor: duplicate network name, check for roaming or guest access points",
    )
    reasons = F.array_compact(F.array(
        F.lit("DUPLICATE_SSID"), F.when(F.col("rssi_delta") > 0, "STRONGER_SIGNAL"), F.when(F.col("vendor_mismatch"), "VENDOR_MISMATCH"),
        F.when(F.col("security_mismatch"), "SECURITY_MISMATCH"), F.when(F.col("is_new"), "NEW_AP"),
        F.when(F.col("jittery"), "BEACON_JITTER"), F.when(F.col("ie_diff"), "IE_FINGERPRINT_DIFF"),
    ))
    return as_alert(
        out.withColumn("recommendation", advice), "evil_twin", level, "Evil twin access point", "T1557.002",
        ["original", "score", "confidence", "rssi_delta", "duplicate_count", "recommendation"], reasons, attacker=F.col("bssid"),
    )
