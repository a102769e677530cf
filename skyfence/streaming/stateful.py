"""Keyed detectors over a stream of frames, in event-time order.

Rows wait in state until the watermark passes them and are then handled in time order, so the
answers equal the batch forms' whatever order the rows came in. State per key is the waiting rows
in blocks of typed Arrow columns (bounded by the watermark delay) and a small memory (bounded by the detector's window).
"""

from __future__ import annotations

import json
import random
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from skyfence.operators import detectors as D
from skyfence.operators import rules as R
from skyfence.operators.alerts import normalise_alerts
from skyfence.operators.detector_set import PROFILES
from skyfence.operators.timeline import US
from skyfence.operators.triage import CHAIN_DDL, chain_row, join_chain, no_chains
from skyfence.streaming.windowed import jamming_stream, to_parquet

Step = Callable[[dict, int, list[dict]], list[tuple]]
#: Time up to which a step would ignore every row, by its memory.
Quiet = Callable[[dict], int]
#: Rows of one block of a key's waiting rows.
BLOCK = 1000
#: Rows that are sorted together when they come, and blocks that are opened together when they are due.
RUN, OPEN = 100_000, 32
KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
STORE = "spark.sql.streaming.stateStore.providerClass"


def event_time(frames: DataFrame, base_us: int = 0, delay: str = "30 seconds") -> DataFrame:
    """Add the ``ts`` column of ``t_us`` and its watermark."""
    return frames.withColumn("ts", F.timestamp_micros(F.col("t_us") + F.lit(base_us))).withWatermark("ts", delay)


def keyed_stream(
    frames: DataFrame, keys: list[str], columns: list[str], step: Step, ddl: str, idle_us: int = 600 * US, base_us: int = 0, event_time: str = "",
    quiet: Quiet | None = None,
) -> DataFrame:
    """Run ``step(memory, time, rows of that time)`` over each key's rows in event-time order.

    ``frames`` carries ``ts`` with a watermark. A key's memory is dropped once it has been quiet for
    ``idle`` of event time. ``event_time`` names a timestamp column of the output that a later step of the query goes by.
    ``quiet(memory)``, if given, is the time before which ``step`` would neither emit nor remember anything; such rows are passed over.
    """
    whole = {f"_k{i}": F.coalesce(F.col(k).cast("string"), F.lit("")) for i, k in enumerate(keys)}
    rows = frames.select(*[c.alias(n) for n, c in whole.items()], "ts", "t_us", "event_id", *[c for c in columns if c not in ("t_us", "event_id")])
    fields = [(f.name, f.dataType.simpleString()) for f in rows.schema if f.name not in whole and f.name != "ts"]
    typed_state(frames.sparkSession)
    return rows.groupBy(*whole).transformWithStateInPandas(InOrder(step, fields, ddl, idle_us, base_us, quiet), ddl, "append", "eventTime", eventTimeColumnName=event_time)


def typed_state(spark: SparkSession) -> None:
    """State of several named parts needs the RocksDB store; streams that run already keep the one they began with."""
    if not spark.conf.get(STORE, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """Rows of a key wait in blocks of Arrow columns, keyed by the time of their first row, and are stepped through in time order.

    A micro-batch writes its own rows as new blocks and reads only blocks that the watermark has reached, so what else waits for a
    busy key is neither read nor decoded; due blocks are opened a few at a time. One timer per key, for its first block or, to forget
    it, after ``idle`` of silence.
    """

    def __init__(self, step: Step, fields: list[tuple[str, str]], ddl: str, idle_us: int, base_us: int, quiet: Quiet | None = None):
        self.step, self.fields, self.idle_us, self.base_us, self.quiet = step, fields, idle_us, base_us, quiet
        self.names = [c.strip().split(" ")[0] for c in ddl.split(",")]
        self.schema = pa.schema([(n, KINDS[k] if k in KINDS else to_arrow_type(T.DataType.fromDDL(k))) for n, k in fields])
        self.order = [(n, "ascending") for n, _ in fields[:2]]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", "first bigint, part bigint", "rows binary")
        self.memory = handle.getValueState("memory", "seen bigint, held string")
        self.timer = handle.getValueState("timer", "ms bigint")

    def wake(self, t_us: int) -> None:
        ms = (t_us + self.base_us) // 1000 + 1
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def keep(self, rows: pa.Table) -> int:
        """Store ``rows``, sorted by time; the time of the first."""
        for part in rows.combine_chunks().to_batches(max_chunksize=BLOCK):
            self.blocks.updateValue((part.column(0)[0].as_py(), random.getrandbits(62)), (part.serialize().to_pybytes(),))
        return rows.column(0)[0].as_py()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first: list[int] = []
        waiting: list[pa.Table] = []

        def flush() -> None:
            if waiting:
                first.append(self.keep(pa.concat_tables(waiting).sort_by(self.order)))
                waiting.clear()

        for pdf in rows:
            if len(pdf):
                waiting.append(pa.table([pa.array(pdf[f.name], f.type, from_pandas=True) for f in self.schema], schema=self.schema))
            if sum(map(len, waiting)) >= RUN:
                flush()
        flush()
        if first:
            at, held = (min(first) + self.base_us) // 1000 + 1, self.timer.get()
            if held is None or at < held[0]:
                self.wake(min(first))
        return iter(())

    def due(self, blocks: list[tuple[int, int]], mark: int, later: list[pa.Table]) -> Iterator[pa.Table]:
        """Rows before ``mark`` of sorted ``blocks`` in time order, in parts that share no time; ``later`` takes the others.

        At least as many rows are read at a time as are left over from overlapping blocks, so each is sorted a few times only.
        """
        left, at = None, 0
        while at < len(blocks):
            parts, n = [] if left is None else [left], 0
            while at < len(blocks) and (n < OPEN * BLOCK or n < (0 if left is None else len(left))):
                raw = self.blocks.getValue(blocks[at])[0]
                self.blocks.removeKey(blocks[at])
                parts.append(pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(bytes(raw)), self.schema)]))
                n, at = n + len(parts[-1]), at + 1
            rows = pa.concat_tables(parts).sort_by(self.order)
            times = rows.column(0).to_numpy()
            ready = int(np.searchsorted(times, blocks[at][0] if at < len(blocks) else mark))
            over = int(np.searchsorted(times, mark))
            if over < len(rows):
                later.append(rows.slice(over))
            left = rows.slice(ready, over - ready).combine_chunks()
            if ready:
                yield rows.slice(0, ready)

    def stepped(self, memory: dict, rows: pa.Table) -> list[tuple]:
        times, out = rows.column(0).to_numpy(), []
        if self.quiet:
            at = 0
            while (at := max(at, int(np.searchsorted(times, self.quiet(memory))))) < len(times):
                t, end = int(times[at]), int(np.searchsorted(times, times[at], side="right"))
                out += self.step(memory, t, _dicts(rows.slice(at, end - at)))
                at = end
        else:
            found = _dicts(rows)
            ends = np.append(np.flatnonzero(np.diff(times)) + 1, len(times)).tolist()
            for start, end in zip([0, *ends], ends):
                t = found[start]["t_us"]
                out += self.step(memory, t, found[start:end])
                memory["_seen"] = t
        memory["_seen"] = int(times[-1])
        return out

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000 - self.base_us
        blocks = sorted(tuple(k) for k in self.blocks.keys())
        reached = blocks[:bisect_left(blocks, (mark, -1))]
        held = self.memory.get()
        memory = json.loads(held[1]) if held is not None else {}
        seen = held[0] if held is not None else None
        later: list[pa.Table] = []
        for rows in self.due(reached, mark, later):
            out = self.stepped(memory, rows)
            seen = memory["_seen"]
            if out:
                yield pd.DataFrame(out, columns=self.names)
        if reached and seen is not None:
            self.memory.update((seen, json.dumps(memory)))
        waits = [b[0] for b in blocks[len(reached):len(reached) + 1]] + [self.keep(rows) for rows in later]
        if waits:
            self.wake(min(waits))
        elif seen is not None and (reached or seen + self.idle_us > mark):
            self.wake(max(seen + self.idle_us, mark))
        else:
            self.memory.clear()
            self.timer.clear()

    def close(self) -> None:
        pass


def _dicts(rows: pa.Table) -> list[dict]:
    """Rows as dictionaries of plain values."""
    columns = [
        c.to_pylist() if pa.types.is_nested(c.type) or pa.types.is_floating(c.type) and c.null_count else c.to_pandas(integer_object_nulls=True).tolist()
        for c in rows.itercolumns()
    ]
    return [dict(zip(rows.column_names, r)) for r in zip(*columns)]


def _cooled(memory: dict, t: int, cool_us: int) -> bool:
    last = memory.get("last")
    if last is not None and t - last < cool_us:
        return False
    memory["last"] = t
    return True


def _until(cool_us: int) -> Quiet:
    """``_cooled`` refuses every row until then."""
    return lambda memory: memory["last"] + cool_us if "last" in memory else -(2**62)


def _note(seen: dict, key: str, t: int) -> None:
    """Set the time of ``key``; the oldest stays first."""
    seen.pop(key, None)
    seen[key] = t


def _forget(seen: dict, before: int) -> None:
    """Drop the keys of times before ``before``."""
    while seen and seen[old := next(iter(seen))] < before:
        del seen[old]


def _expire(queue: list[list], before: int) -> list[list]:
    """Take entries ``[time, ...]`` of times before ``before`` off the front; what went."""
    gone = queue[:bisect_left(queue, before, key=lambda x: x[0])]
    del queue[:len(gone)]
    return gone


def _less(counts: dict, key: str) -> None:
    counts[key] -= 1
    if not counts[key]:
        del counts[key]


def deauth_flood_stream(frames: DataFrame, rate: float = 10.0, window_s: float = 2.0, cooldown_s: float = 60.0, base_us: int = 0) -> DataFrame:
    """Deauthentication flood per (bssid, client), the alerts of the batch form."""
    width, cool = int(window_s * US), int(cooldown_s * US)

    def step(memory: dict, t: int, rows: list[dict]) -> list[tuple]:
        times = memory.setdefault("times", [])
        del times[:bisect_left(times, t - width)]
        times += [t] * len(rows)
        if len(times) / window_s < rate or not _cooled(memory, t, cool):
            return []
        r = rows[0]
        return [(r["event_id"], t, r["sensor_id"], r["bssid"], r["client"], len(times), len(times) / window_s)]

    ddl = "event_id bigint, t_us bigint, sensor_id string, bssid string, client string, frame_count bigint, rate_per_sec double"
    hits = _to_clients(frames, "deauth")
    return D.deauth_alert(keyed_stream(hits, ["bssid", "client"], ["sensor_id", "bssid", "client"], step, ddl, width + cool, base_us), rate)


def disassoc_flood_stream(frames: DataFrame, rate: float = 10.0, window_s: float = 5.0, cooldown_s: float = 60.0, min_clients: int = 3, base_us: int = 0) -> DataFrame:
    """Disassociation flood; the state is an access point's, as its clients count together."""
    width, cool = int(window_s * US), int(cooldown_s * US)

    def step(memory: dict, t: int, rows: list[dict]) -> list[tuple]:
        queue, seen, last = memory.setdefault("queue", []), memory.setdefault("seen", {}), memory.setdefault("last", {})
        for _, client in _expire(queue, t - width):
            _less(seen, client)
        _forget(last, t - cool + 1)
        first: dict[str, dict] = {}
        for r in rows:
            queue.append([t, r["client"]])
            seen[r["client"]] = seen.get(r["client"], 0) + 1
            first.setdefault(r["client"], r)
        out = []
        for client, r in first.items():
            n = seen[client]
            if n / window_s >= rate and client not in last:
                last[client] = t
                out.append((r["event_id"], t, r["sensor_id"], r["bssid"], client, n, n / window_s, len(seen)))
        return out

    ddl = "event_id bigint, t_us bigint, sensor_id string, bssid string, client string, frame_count bigint, rate_per_sec double, unique_clients bigint"
    hits = _to_clients(frames, "disassoc")
    return D.disassoc_alert(keyed_stream(hits, ["bssid"], ["sensor_id", "bssid", "client"], step, ddl, width + cool, base_us), rate, min_clients)


def _to_clients(frames: DataFrame, kind: str) -> DataFrame:
    return frames.filter((F.col("frame_type") == kind) & F.col("bssid").isNotNull()).withColumn("client", F.coalesce("dst_addr", F.lit(D.BROADCAST)))


def beacon_flood_stream(
    frames: DataFrame, ssids: int = 50, bssids: int = 10, window_s: int = 30, cooldown_s: int = 120, sample: int = 10, base_us: int = 0
) -> DataFrame:
    """Fake-AP flood per sensor."""
    width, cool = window_s * US, cooldown_s * US

    def step(memory: dict, t: int, rows: list[dict]) -> list[tuple]:
        for field in ("name", "ap", "oui"):
            seen = memory.setdefault(field, {})
            for r in rows:
                if r[field]:
                    _note(seen, r[field], t)
            _forget(seen, t - width)
        counts = memory.setdefault("counts", [])
        memory["frames"] = memory.get("frames", 0) + len(rows) - sum(c for _, c in _expire(counts, t - width))
        counts.append([t, len(rows)])
        n, m = len(memory["name"]), len(memory["ap"])
        if (n < ssids and m < bssids * 2) or not _cooled(memory, t, cool):
            return []
        names = ",".join(sorted(memory["name"])[:sample])
        return [(rows[0]["event_id"], t, rows[0]["sensor_id"], n, m, len(memory["oui"]), memory["frames"], names or None)]

    ddl = "event_id bigint, t_us bigint, sensor_id string, unique_ssids bigint, unique_bssids bigint, oui_count bigint, beacon_count bigint, sample_ssids string"
    beacons = frames.filter((F.col("frame_type") == "beacon") & F.col("bssid").isNotNull()).withColumns({
        "name": F.when(F.col("ssid") != "", F.col("ssid")), "ap": F.upper("bssid"), "oui": F.upper(F.substring("bssid", 1, 8)),
    })
    return D.beacon_alert(keyed_stream(beacons, ["sensor_id"], ["sensor_id", "name", "ap", "oui"], step, ddl, width + cool, base_us), ssids, bssids, window_s)


def _names_stream(frames: DataFrame, key: str, limits: list[int], idle_us: int, base_us: int) -> DataFrame:
    def step(memory: dict, t: int, rows: list[dict]) -> list[tuple]:
        if "_seen" not in memory or t - memory["_seen"] > idle_us:
            memory["names"], memory["began"] = [], t
        names, out = memory["names"], []
        for r in rows:
            if r["name"] and r["name"] not in names and len(names) < limits[-1]:
                names.append(r["name"])
                if len(names) in limits:
                    out.append((r["event_id"], t, r["sensor_id"], r[key], len(names), ",".join(sorted(names)), memory["began"]))
        return out

    ddl = f"event_id bigint, t_us bigint, sensor_id string, {key} string, name_count bigint, names string, began bigint"
    found = keyed_stream(frames, [key], [key, "sensor_id", "name"], step, ddl, idle_us + 1, base_us)
    return found.withColumn("duration_s", F.bround((F.col("t_us") - F.col("began")) / F.lit(US), 1))


def karma_stream(frames: DataFrame, ssids: int = 3, critical: int = 5, idle_s: int = 60, escalate: bool = False, base_us: int = 0) -> DataFrame:
    ads = frames.filter("frame_type in ('beacon', 'probe_resp') and bssid is not null and ssid is not null and ssid not in ('', '<Hidden>')")
    return D.karma_alert(_names_stream(ads.withColumn("name", F.col("ssid")), "bssid", D.name_limits(ssids, [critical], escalate), idle_s * US, base_us), critical)


def wardriver_stream(frames: DataFrame, ssids: int = 5, high: int = 10, critical: int = 15, idle_s: int = 60, escalate: bool = False, base_us: int = 0) -> DataFrame:
    probes = frames.filter("frame_type = 'probe_req' and src_addr is not null").withColumns({"attacker": F.col("src_addr"), "name": F.when(F.col("ssid") != "", F.col("ssid"))})
    return D.wardriver_alert(_names_stream(probes, "attacker", D.name_limits(ssids, [high, critical], escalate), idle_s * US, base_us), high, critical)


def pmkid_stream(
    frames: DataFrame, m1_limit: int = 15, m1_window_s: int = 10, auth_limit: int = 50, auth_window_s: int = 5,
    min_sources: int = 5, cooldown_s: int = 60, base_us: int = 0,
) -> DataFrame:
    """Unanswered message 1 and authentication floods per bssid."""
    wait, span, cool = m1_window_s * US, auth_window_s * US, cooldown_s * US

    def step(memory: dict, t: int, rows: list[dict]) -> list[tuple]:
        out = []
        auths, senders, m1 = memory.setdefault("auths", []), memory.setdefault("senders", {}), memory.setdefault("m1", [])
        for _, sender in _expire(auths, t - span):
            _less(senders, sender)
        for sender in (r["src_addr"] for r in rows if r["frame_type"] in ("auth", "assoc_req") and r["src_addr"]):
            auths.append([t, sender])
            senders[sender] = senders.get(sender, 0) + 1
        sources = len(senders)
        del m1[:bisect_left(m1, t - wait)]
        for r in rows:
            msg = r["eapol_message"]
            if msg == 1:
                m1.append(t)
            elif msg == 2:
                del m1[:1]
                continue
            by_m1, by_auth = len(m1) >= m1_limit, len(auths) >= auth_limit and sources >= min_sources
            if (by_m1 or by_auth) and _cooled(memory, t, cool):
                out.append((r["event_id"], t, r["sensor_id"], r["bssid"], len(m1), len(auths), sources, by_m1, by_auth))
        return out

    ddl = (
        "event_id bigint, t_us bigint, sensor_id string, bssid string, orphaned_m1 bigint, auth_count bigint, unique_sources bigint, "
        "m1_flood boolean, auth_flood boolean"
    )
    talk = frames.filter("bssid is not null and (frame_type in ('auth', 'assoc_req') or eapol_message is not null)")
    return D.pmkid_alert(keyed_stream(talk, ["bssid"], ["sensor_id", "bssid", "frame_type", "src_addr", "eapol_message"], step, ddl, wait + span + cool, base_us))


def krack_stream(
    frames: DataFrame, m3_limit: int = 3, window_s: int = 30, cooldown_s: int = 120, replay_alert: bool = True, keep_s: int = 86_400, base_us: int = 0
) -> DataFrame:
    """Key reinstallation per (bssid, client).

    That a handshake was completed is remembered for ``keep_s`` of silence; the batch form remembers it for good.
    """
    width, cool = window_s * US, cooldown_s * US

    def step(memory: dict, t: int, rows: list[dict]) -> list[tuple]:
        seen, n = memory.setdefault("seen", []), memory.setdefault("n", [0, 0, 0, 0])
        fresh = [[t, r["eapol_message"]] for r in rows if r["eapol_message"] in (1, 2, 3, 4)]
        for sign, part in ((-1, _expire(seen, t - width)), (1, fresh)):
            for _, m in part:
                n[m - 1] += sign
        seen += fresh
        out = []
        for r in rows:
            done = memory.get("turn") == 4
            if r["eapol_message"] == 3 and ((done and replay_alert) or n[2] >= m3_limit) and _cooled(memory, t, cool):
                kind = "m3_replay_after_m4" if done and replay_alert else "excessive_m3_retransmission"
                out.append((r["event_id"], t, r["sensor_id"], r["bssid"], r["client"], kind, *n, done))
            if r["eapol_message"] in (1, 4):
                memory["turn"] = r["eapol_message"]
        return out

    ddl = (
        "event_id bigint, t_us bigint, sensor_id string, bssid string, client string, attack_subtype string, m1_count bigint, m2_count bigint, "
        "m3_count bigint, m4_count bigint, m4_completed boolean"
    )
    msg = F.col("eapol_message")
    client = F.when(msg.isin(1, 3), F.col("dst_addr")).otherwise(F.col("src_addr"))
    talk = frames.filter(msg.isNotNull() & F.col("bssid").isNotNull()).withColumn("client", client).filter(F.col("client").isNotNull())
    return D.krack_alert(keyed_stream(talk, ["bssid", "client"], ["sensor_id", "bssid", "client", "eapol_message"], step, ddl, max(width + cool, keep_s * US), base_us), m3_limit)


def wep_stream(
    frames: DataFrame, iv_limit: int = 5, inject_limit: int = 50, small_len: int = 150, window_s: int = 60, rearm: int = 1000,
    keep_s: int = 3600, base_us: int = 0,
) -> DataFrame:
    """IV reuse and small-packet injection; what the latest beacon said is kept for ``keep_s`` of silence."""
    width, cycle = window_s * US, rearm + inject_limit

    def step(memory: dict, t: int, rows: list[dict]) -> list[tuple]:
        if memory.get("win") != t // width:
            memory["win"], memory["ivs"], memory["small"] = t // width, {}, 0
        out = []
        for r in rows:
            if r["frame_type"] != "data":
                memory["wep"] = r["wep"] if r["wep"] is not None else memory.get("wep")
                continue
            if not memory.get("wep"):
                continue
            iv, n = r["wep_iv"], 0
            if iv is not None:
                n = memory["ivs"][iv] = memory["ivs"].get(iv, 0) + 1
            if n >= iv_limit:
                out.append((r["event_id"], t, r["sensor_id"], r["bssid"], "iv_collision", iv, n))
            elif r["frame_len"] is not None and 1 <= r["frame_len"] <= small_len:
                memory["small"] += 1
                if memory["small"] % cycle == inject_limit % cycle:
                    out.append((r["event_id"], t, r["sensor_id"], r["bssid"], "packet_injection", None, inject_limit))
        return out

    ddl = "event_id bigint, t_us bigint, sensor_id string, bssid string, attack_subtype string, wep_iv string, hit_count bigint"
    ad = F.col("frame_type").isin("beacon", "probe_resp")
    wep = F.when(ad, F.col("privacy") & ~F.col("security").isin("WPA", "WPA2", "WPA3"))
    rows = frames.filter((ad | (F.col("frame_type") == "data")) & F.col("bssid").isNotNull()).withColumn("wep", wep)
    return D.wep_alert(keyed_stream(rows, ["bssid"], ["sensor_id", "bssid", "frame_type", "wep", "wep_iv", "frame_len"], step, ddl, max(width, keep_s * US), base_us))


def rules_stream(frames: DataFrame, rules: list[dict] | None = None, base_us: int = 0) -> DataFrame:
    """Rule matches, then the cooldown of each (sensor, rule)."""
    live = R.live_rules(rules)
    waits = [R.cooldown_us(r) for r in live]

    def step(memory: dict, t: int, rows: list[dict]) -> list[tuple]:
        memory["wait"] = waits[rows[0]["rule_no"]]  # the key names one rule
        return [(r["event_id"], t, r["sensor_id"], r["bssid"], r["ssid"], r["rule_no"]) for r in rows if _cooled(memory, t, memory["wait"])]

    def quiet(memory: dict) -> int:
        return _until(memory.get("wait", 0))(memory)

    ddl = "event_id bigint, t_us bigint, sensor_id string, bssid string, ssid string, rule_no int"
    hits = R.rule_hits(frames, live, "ts")
    return R.named_rules(keyed_stream(hits, ["sensor_id", "rule_no"], ["sensor_id", "bssid", "ssid", "rule_no"], step, ddl, max(waits), base_us, quiet=quiet), live)


def evil_twin_stream(
    frames: DataFrame, window_s: int = 120, slide_s: int = 30, confirm_s: int = 30, rssi_delta: int = 15, jitter_ms: float = 10.0, new_minutes: int = 10,
    report: int = 40, high: int = 60, critical: int = 80, immediate: int = 90, keep_s: int = 7 * 86_400, base_us: int = 0,
) -> DataFrame:
    """Pairs of access points sharing a name in a sensor's view, the alerts of the batch form.

    Spark adds up each access point's frames by sliding window; a closed window's profiles meet by (sensor, name), where the state
    is when each access point was first seen; pairs are scored by the batch form's columns and wait for confirmation by pair.
    First sightings and reported pairs are remembered for ``keep_s`` of silence; the batch form remembers them for good.
    """
    spans = F.window("ts", f"{window_s} seconds", f"{slide_s} seconds", f"{base_us % (slide_s * US)} microseconds")
    aps = D.twin_frames(frames).groupBy(spans, "sensor_id", "ssid", "bssid").agg(*D.twin_sums())
    aps = aps.withColumns({"ts": F.window_time("window"), "seen_us": F.unix_micros("window.end") - F.lit(base_us)})
    rows = D.twin_profiles(aps, "lo").withColumns({"t_us": F.col("seen_us"), "event_id": F.lit(0).cast("bigint")})

    side = list(D.TWIN_SIDE)

    def meet(memory: dict, t: int, rows: list[dict]) -> list[tuple]:
        first = memory.setdefault("first", {})
        for r in rows:
            r["first_us"] = first[r["bssid"]] = min(first.get(r["bssid"], r["first_us"]), r["first_us"])
        rows = sorted(rows, key=lambda r: (-r["n"], r["first_us"], r["bssid"]))  # the busier access point counts as the original
        at = pd.Timestamp(t + base_us - 1, unit="us", tz="UTC")
        return [
            (at, r["sensor_id"], r["ssid"], t, len(rows), *[r[c] for c in side], *[s[c] for c in side])
            for i, r in enumerate(rows) for s in rows[i + 1:]
        ]

    kinds = dict(zip(D.TWIN_SIDE, ("string", "bigint", "bigint", "double", "double", "string", "string", "boolean", "boolean")))
    ddl = "ts timestamp, sensor_id string, ssid string, seen_us bigint, duplicate_count bigint, " + ", ".join(f"{side}_{c} {k}" for side in "os" for c, k in kinds.items())
    pairs = keyed_stream(rows, ["sensor_id", "ssid"], ["sensor_id", "ssid", *D.TWIN_SIDE], meet, ddl, keep_s * US, base_us, "ts")
    scored = D.twin_scores(pairs, rssi_delta, jitter_ms, new_minutes, report).withColumn("event_id", F.lit(0).cast("bigint"))
    columns = [c for c in scored.columns if c not in ("ts", "t_us", "event_id")]

    def confirm(memory: dict, t: int, rows: list[dict]) -> list[tuple]:
        out = []
        for r in rows:
            memory["since"], memory["top"] = min(memory.get("since", t), t), max(memory.get("top", 0), r["now_score"])
            if not memory.get("told") and (t - memory["since"] >= confirm_s * US or t == memory["since"] and r["now_score"] >= immediate):
                memory["told"] = True
                out.append((t, memory["top"], *[r[c] for c in columns]))
        return out

    ddl = "t_us bigint, score bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scored.select(*columns).schema)
    return D.twin_alert(keyed_stream(scored, ["sensor_id", "ssid", "original", "bssid"], columns, confirm, ddl, keep_s * US, base_us), high, critical)


def exploit_chains_stream(alerts: DataFrame, gap_s: float = 300.0, base_us: int = 0) -> DataFrame:
    """Chains of a sensor's alerts, the rows of the batch form. The state is the sensor's live chains."""
    gap = int(gap_s * US)

    def step(memory: dict, t: int, rows: list[dict]) -> list[tuple]:
        held, out = memory.setdefault("live", no_chains()), []
        for r in sorted(rows, key=lambda r: (r["event_id"], r["alert_type"] or "")):
            chain = join_chain(held, gap, t, r["event_id"], r["alert_type"], r["severity"], r["bssid"], r["attacker"])
            if chain:
                out.append(chain_row(r["sensor"], t, r["event_id"], chain))
        return out

    rows = alerts.withColumn("sensor", F.coalesce("sensor_id", F.lit("")))
    return keyed_stream(rows, ["sensor"], ["sensor", "alert_type", "severity", "bssid", "attacker"], step, CHAIN_DDL, gap, base_us)


def _jamming(frames: DataFrame, base_us: int = 0, **limits) -> DataFrame:
    return jamming_stream(frames, **limits)


STREAMS = {
    "deauth_flood": deauth_flood_stream, "disassoc_flood": disassoc_flood_stream, "beacon_flood": beacon_flood_stream, "krack": krack_stream, "pmkid": pmkid_stream,
    "wep_iv": wep_stream, "evil_twin": evil_twin_stream, "karma": karma_stream, "jamming": _jamming, "wardrive": wardriver_stream, "rules": rules_stream,
}


def start_detectors(
    frames: DataFrame, path: str, checkpoint: str, profile: str = "lite_realtime", overrides: dict[str, dict] | None = None, base_us: int = 0, once: bool = True,
    tasks: int = 0,
) -> list[StreamingQuery]:
    """Run a profile over a stream of frames with event time: one query per detector, all writing alerts of the common schema below ``path``.

    Spark allows one operator with free state in a query, hence several; the folder reads as one table with a ``detector`` column.
    Every detector of the profile needs a streaming form (``STREAMS``). ``tasks``: state tasks of each query (``to_parquet``).
    """
    names = PROFILES[profile]
    if missing := [n for n in names if n not in STREAMS]:
        raise ValueError(f"no streaming form for {missing}")
    alerts = {n: normalise_alerts(STREAMS[n](frames, base_us=base_us, **(overrides or {}).get(n, {}))) for n in names}
    return [to_parquet(df, f"{path}/detector={n}", f"{checkpoint}/{n}", once, tasks=tasks) for n, df in alerts.items()]


def cooldown_stream(df: DataFrame, keys: list[str], columns: list[str], ddl: str, cool_us: int, base_us: int = 0) -> DataFrame:
    """Frame de-duplication or alert suppression: keep a row ``cool`` after the last one kept for its key."""
    names = [c.strip().split(" ")[0] for c in ddl.split(",")]

    def step(memory: dict, t: int, rows: list[dict]) -> list[tuple]:
        return [tuple(r[n] for n in names) for r in rows if _cooled(memory, t, cool_us)]

    return keyed_stream(df, keys, columns, step, ddl, cool_us, base_us, quiet=_until(cool_us))


def triage_stream(findings: DataFrame, suppress_s: float = 3600.0, keep_s: float = 30 * 86400, base_us: int = 0) -> DataFrame:
    """Emit new, escalated and recurring findings; ``findings`` carries fingerprint and risk_score."""
    quiet = int(suppress_s * US)

    def step(memory: dict, t: int, rows: list[dict]) -> list[tuple]:
        out = []
        for r in rows:
            top = memory.get("top")
            why = "new" if top is None else "escalated" if r["risk_score"] > top else "recurring" if t - memory["last"] >= quiet else None
            if why:
                memory["last"] = t
                out.append((r["event_id"], r["fingerprint"], why))
            memory["top"] = r["risk_score"] if top is None else max(top, r["risk_score"])
        return out

    ddl = "event_id bigint, fingerprint string, emit_reason string"
    return keyed_stream(findings, ["fingerprint"], ["fingerprint", "risk_score"], step, ddl, int(keep_s * US), base_us)
