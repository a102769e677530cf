"""Streaming forms, run to the end over the whole table and checked with the batch forms' SQL.

Spark writes the frames as files in time order, a file stream replays them, and one closing frame
far in the future moves the watermark past the last real one. A micro-batch may end between the files
of one span of time, so the watermark stays a span behind and no frame is late, however many files there are.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from skyfence.frames import FRAMES_DDL, load_frames
from skyfence.operators import rules as R
from skyfence.operators import scoring as SC
from skyfence.operators import triage as T
from skyfence.plans import detect as PD
from skyfence.plans.base import ORACLES, query
from skyfence.plans.ingest import BASE
from skyfence.plans.respond import PARTS, PLAIN_RULE_SQL, SCALED
from skyfence.plans.risk import findings, ruled
from skyfence.plans.views import simple_alerts
from skyfence.session import shared_dir
from skyfence.sources.networks import read_networks
from skyfence.streaming import stateful as ST
from skyfence.streaming import windowed as W

S = 1_000_000
END = 10**12
LITE_PARTS = {k: v for k, v in PARTS.items() if v.split("_")[0] in ("d01", "d02", "d03", "d04", "d05", "d06")}


def replay(spark, sf, files: int = 3):
    """(frames as a stream with event time, scratch folder)."""
    path = shared_dir(spark, "stream")
    f = load_frames(spark, sf).select(*[c.split(" ")[0] for c in FRAMES_DDL.split(", ")])
    span = (f.agg(F.max("t_us")).first()[0] or 0) // files + 1
    for i in range(files):  # one job per file set, so that file times follow frame times
        low, high = (i * span, (i + 1) * span) if i < files - 1 else (i * span, END)
        f.filter(F.col("t_us").between(low, high - 1)).write.mode("append").parquet(f"{path}/in")
    closing = f.limit(1).withColumns({"t_us": F.lit(END), "event_id": F.lit(-1).cast("bigint")})
    kinds = F.array(*[F.lit(k) for k in ("beacon", "probe_req", "deauth", "disassoc", "auth", "rts", "eapol")])
    closing.withColumn("frame_type", F.explode(kinds)).withColumns({c: F.lit("closing") for c in ("bssid", "src_addr", "dst_addr", "ssid")} | {"eapol_message": F.when(F.col("frame_type") == "eapol", 1).cast("bigint")}).write.mode("append").parquet(f"{path}/in")
    written = spark.read.parquet(f"{path}/in")
    batch = max(8, -(-len(written.inputFiles()) // files))  # about a span, so that larger tables make fuller micro-batches, not more of them
    rows = spark.readStream.schema(written.schema).option("maxFilesPerTrigger", batch).parquet(f"{path}/in")
    return ST.event_time(rows, BASE, f"{max(span, 30 * S)} microseconds"), path


def finish(spark, df, path):
    W.to_parquet(df, f"{path}/out", f"{path}/ck").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


@query("st_a04_collapse_events", ORACLES["a04_collapse_events"])
def st_a04(spark, sf):
    rows, path = replay(spark, sf)
    return finish(spark, W.collapse_events_stream(rows, 60, BASE), path)


@query("st_a05_deauth_counts", ORACLES["a05_deauth_counts"])
def st_a05(spark, sf):
    rows, path = replay(spark, sf)
    return finish(spark, W.deauth_counts_stream(rows, 60, BASE), path)


@query("st_d01_deauth_flood", ORACLES["d01_deauth_flood"])
def st_d01(spark, sf):
    rows, path = replay(spark, sf)
    return PD.flat(finish(spark, ST.deauth_flood_stream(rows, 3 / 60, 60, 60, BASE), path), *PD.D01_COLS)


@query("st_d02_disassoc_flood", ORACLES["d02_disassoc_flood"])
def st_d02(spark, sf):
    rows, path = replay(spark, sf)
    return finish(spark, ST.disassoc_flood_stream(rows, 2 / 300, 300, 60, base_us=BASE), path).select(*PD.D02_COLS)


@query("st_d03_beacon_flood", ORACLES["d03_beacon_flood"])
def st_d03(spark, sf):
    rows, path = replay(spark, sf)
    return finish(spark, ST.beacon_flood_stream(rows, 8, 10, 30, 120, base_us=BASE), path).select(*PD.D03_COLS)


@query("st_d05_pmkid", ORACLES["d05_pmkid"])
def st_d05(spark, sf):
    rows, path = replay(spark, sf)
    return PD.flat(finish(spark, ST.pmkid_stream(rows, 2, 120, 3, 120, 2, 60, BASE), path), *PD.D05_COLS)


@query("st_d08_karma", ORACLES["d08_karma"])
def st_d08(spark, sf):
    rows, path = replay(spark, sf)
    return finish(spark, ST.karma_stream(rows, base_us=BASE), path).select(*PD.D08_COLS)


@query("st_d09_jamming", ORACLES["d09_jamming"])
def st_d09(spark, sf):
    rows, path = replay(spark, sf)
    out = finish(spark, W.jamming_stream(rows, 60, 10, 0.4, 0, 30, 50, samples=5), path)
    return out.select(*PD.D09_COLS, F.round("avg_rssi", 6).alias("avg_rssi"))


@query("st_d07_evil_twin", ORACLES["d07_evil_twin"])
def st_d07(spark, sf):
    rows, path = replay(spark, sf)
    df = finish(spark, ST.evil_twin_stream(rows, base_us=BASE), path).withColumn("rssi_delta", F.round("rssi_delta", 6))
    return PD.flat(df, "severity", "sensor_id", "ssid", "original", "bssid", "t_us", "score", "rssi_delta", "duplicate_count", "confidence", "reasons")


@query("st_d08_karma_steps", ORACLES["d08_karma_steps"])
def st_d08_steps(spark, sf):
    rows, path = replay(spark, sf)
    return finish(spark, ST.karma_stream(rows, **PD.KARMA_STEPS, base_us=BASE), path).select(*PD.D08_COLS)


@query("st_d10_wardriver_steps", ORACLES["d10_wardriver_steps"])
def st_d10_steps(spark, sf):
    rows, path = replay(spark, sf)
    return finish(spark, ST.wardriver_stream(rows, **PD.PROBE_STEPS, base_us=BASE), path).withColumnRenamed("attacker", "src_addr").select(*PD.D10_COLS)


@query("st_d10_wardriver", ORACLES["d10_wardriver"])
def st_d10(spark, sf):
    rows, path = replay(spark, sf)
    return finish(spark, ST.wardriver_stream(rows, base_us=BASE), path).withColumnRenamed("attacker", "src_addr").select(*PD.D10_COLS)


@query("st_d04_krack", ORACLES["d04_krack"])
def st_d04(spark, sf):
    rows, path = replay(spark, sf)
    return finish(spark, ST.krack_stream(rows, 3, 300, 120, base_us=BASE), path).select(*PD.D04_COLS)


@query("st_d06_wep_attacks", ORACLES["d06_wep_attacks"])
def st_d06(spark, sf):
    rows, path = replay(spark, sf)
    return finish(spark, ST.wep_stream(rows, 2, 3, 150, 600, rearm=10, base_us=BASE), path).select(*PD.D06_COLS)


@query("st_d11_apply_rules", ORACLES["d11_apply_rules"])
def st_d11(spark, sf):
    rows, path = replay(spark, sf)
    rules = [r | {"cooldown_seconds": r["cooldown_seconds"] / 60} for r in R.as_rules(R.CORE_RULES)]
    return finish(spark, ST.rules_stream(ruled(rows), rules, BASE), path).filter("event_id >= 0").select("event_id", "t_us", "sensor_id", "rule_id")


@query("st_d18_detectors", "select alert_type, severity, count(*) as alerts, min(t_us) as first_us, max(t_us) as last_us from ("
    + " union all ".join(f"select '{kind}' as alert_type, severity, t_us from ({ORACLES[name]})" for kind, name in LITE_PARTS.items())
    + f" union all select 'rule_match', severity, t_us from ({PLAIN_RULE_SQL})) group by alert_type, severity")
def st_d18(spark, sf):
    rows, path = replay(spark, sf)
    scaled = {k: v for k, v in SCALED.items() if k in ST.STREAMS}
    for q in ST.start_detectors(rows, f"{path}/out", f"{path}/ck", "lite_realtime", scaled, BASE):
        q.awaitTermination()
    out = spark.read.parquet(f"{path}/out").filter("event_id >= 0")
    return out.groupBy("alert_type", "severity").agg(F.count("*").alias("alerts"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"))


@query("st_d18_full_wids", ORACLES["d18_run_detectors"])
def st_d18_full(spark, sf):
    rows, path = replay(spark, sf)
    for q in ST.start_detectors(rows, f"{path}/out", f"{path}/ck", "full_wids", SCALED, BASE):
        q.awaitTermination()
    out = spark.read.parquet(f"{path}/out").filter(F.col("t_us") < END)
    return out.groupBy("alert_type", "severity").agg(F.count("*").alias("alerts"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"))


@query("st_d12_exploit_chains", ORACLES["d12_exploit_chains"])
def st_d12(spark, sf):
    rows, path = replay(spark, sf)
    alerts = simple_alerts(rows, "ts").withColumn("severity", F.when(F.col("severity") == "HIGH", "CRITICAL").otherwise("LOW"))
    chains = finish(spark, ST.exploit_chains_stream(alerts, 20, BASE), path).filter(F.col("t_us") < END)
    return chains.select("sensor_id", "t_us", "event_id", "chain_start", "chain_event", "alerts", "severity", "target_bssid", "attacker")


@query("st_n06_dedup_frames", f"select event_id, t_us, bssid, frame_type from ({ORACLES['n06_dedup_frames']})")
def st_n06(spark, sf):
    rows, path = replay(spark, sf)
    rest = rows.filter("frame_type not in ('deauth', 'disassoc')").withColumn("half", F.col("event_id") % 2)
    ddl = "event_id bigint, t_us bigint, bssid string, frame_type string"
    kept = ST.cooldown_stream(rest, ["bssid", "half", "frame_type", "ssid"], ["bssid", "frame_type"], ddl, 5 * S, BASE)
    exempt = rows.filter("frame_type in ('deauth', 'disassoc') and event_id >= 0").select("event_id", "t_us", "bssid", "frame_type")
    return finish(spark, kept.unionByName(exempt), path)


@query("st_t02_triage", ORACLES["t02_triage"])
def st_t02(spark, sf):
    rows, path = replay(spark, sf)
    f = T.with_fingerprint(SC.score_findings(findings(rows, "ts")))
    return finish(spark, ST.triage_stream(f, 300, base_us=BASE), path)


@query("st_s12_siem_feed", f"select event_id, t_us, bssid from ({ORACLES['s12_siem_splunk']})")
def st_s12(spark, sf):
    rows, path = replay(spark, sf)
    alerts = rows.filter(f"frame_type = 'disassoc' and t_us < {END}").select("event_id", "t_us", "bssid")
    W.siem_stream(alerts, f"{path}/out", f"{path}/ck").awaitTermination()
    return spark.read.schema("event_id bigint, t_us bigint, bssid string").json(f"{path}/out")


@query("st_s10_upsert_networks", ORACLES["s10_upsert_networks"])
def st_s10(spark, sf):
    from skyfence.plans.ingest import sightings

    rows, path = replay(spark, sf, 2)
    W.upsert_stream(sightings(rows.filter(f"t_us < {END}")), f"{path}/net", f"{path}/ck").awaitTermination()
    return read_networks(spark, f"{path}/net").drop("vendor")
