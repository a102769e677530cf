"""Capture files to frame rows: a small helper cuts a file into records and their elements, Spark's expressions read the fields.

A record keeps its raw bytes; header fields, element contents and handshake messages are column
expressions over them, so what a query does not select is not computed.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfence.functions.mac import oui
from skyfence.functions.radio import MANAGEMENT, channel_to_mhz, mhz_to_channel

RECORDS_DDL = (
    "path string, frame_no bigint, t_us bigint, frame_len int, rssi_dbm int, frequency_mhz int, header binary, body binary, elements array<struct<kind: int, body: binary>>, parse_error string"
)
COLUMNS = (
    "path frame_no t_us frame_type type_code subtype_code dst_addr src_addr bssid seq_num fragment_num retry protected rssi_dbm frequency_mhz ssid channel beacon_interval "
    "capability_flags ess ibss privacy ht vht he wpa wps rsn_version rsn_group rsn_pairwise rsn_akm pmf_capable pmf_required ies_present reason_code auth_algo auth_seq "
    "status_code wep_iv eapol_message frame_len parse_error"
).split()
BATCH = 5000

# Element numbers, vendor prefixes, and the size and alignment of radiotap fields before the signal byte.
ELEMENTS = {0: "SSID", 3: "DS", 45: "HT", 48: "RSN", 191: "VHT"}
WPA, WPS = "0050F201", "0050F204"
RADIOTAP = [(8, 8), (1, 1), (1, 1), (4, 2), (2, 1)]
EXTENSION, HE = 255, 35


def records(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(time in microseconds, bytes) of each packet; a truncated tail ends the file."""
    order, scale = {
        b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000),
    }.get(content[:4], (None, 1))
    if order is None or len(content) < 24:
        return
    head, at = struct.Struct(order + "IIII"), 24
    while at + 16 <= len(content):
        sec, frac, size, _ = head.unpack_from(content, at)
        at += 16
        if at + size > len(content):
            return
        yield sec * 1_000_000 + frac // scale, content[at : at + size]
        at += size


def radiotap(raw: bytes) -> tuple[int | None, int | None, int | None]:
    """Length of the radiotap header (None if there is none), antenna signal and channel frequency, by field sizes and alignments."""
    size = int.from_bytes(raw[2:4], "little")
    if len(raw) < 8 or raw[0] != 0 or not 8 <= size <= len(raw):
        return None, None, None
    at, present, frequency = 8, raw[4], None
    while raw[at - 1] & 0x80 and at + 4 <= size:  # presence words follow each other while their top bit is set
        at += 4
    for bit, (width, align) in enumerate(RADIOTAP):
        if present >> bit & 1:
            at += -at % align
            if bit == 3 and at + 2 <= size:
                frequency = int.from_bytes(raw[at : at + 2], "little")
            at += width
    return size, int.from_bytes(raw[at : at + 1], "little", signed=True) if present & 32 and at < size else None, frequency


@lru_cache(4096)
def _tap(head: bytes) -> tuple[int | None, int | None, int | None]:
    """``radiotap`` of the header alone, as most records of a sensor begin alike."""
    return radiotap(head)


def elements(body: bytes, at: int) -> Iterator[tuple[int, bytes]]:
    """Tagged elements of a management frame's body."""
    size = len(body)
    while at + 2 <= size and (end := at + 2 + body[at + 1]) <= size:
        yield body[at], body[at + 2 : end]
        at = end


class Cuts:
    """Records in their parts, by column; what they mean is read by ``decode_records``."""

    SCHEMA = pa.schema([
        ("path", pa.string()), ("frame_no", pa.int64()), ("t_us", pa.int64()), ("frame_len", pa.int32()), ("rssi_dbm", pa.int32()), ("frequency_mhz", pa.int32()),
        ("header", pa.binary()), ("body", pa.binary()), ("elements", pa.list_(pa.struct([("kind", pa.int32()), ("body", pa.binary())]))), ("parse_error", pa.string()),
    ])

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.starts: list[int | None] = []
        self.kinds: list[int] = []
        self.bodies: list[bytes] = []

    def add(self, path: str, number: int, t_us: int, raw: bytes) -> None:
        size = int.from_bytes(raw[2:4], "little")
        size, signal, frequency = _tap(raw[:size]) if 8 <= size <= len(raw) else (None, None, None)
        control = b"" if size is None else raw[size : size + 1]
        short = 10 if control and control[0] >> 2 & 3 == 1 else 24  # control frames may end after the receiver's address
        error = "bad radiotap header" if size is None else "short 802.11 header" if len(raw) < size + short else None
        if error:
            self.rows.append((path, number, t_us, len(raw), signal, frequency, None, None, error))
            self.starts.append(None)
            return
        body = raw[size + 24 :]
        self.rows.append((path, number, t_us, len(raw), signal, frequency, raw[size : size + 24], body, None))
        self.starts.append(len(self.kinds))
        first = {0x80: 12, 0x50: 12, 0x40: 0}.get(control[0])
        if first is not None:
            for kind, content in elements(body, first):
                self.kinds.append(kind)
                self.bodies.append(content)

    def batch(self) -> pa.RecordBatch:
        types = [f.type for f in self.SCHEMA if f.name != "elements"]
        plain = [pa.array(c, t) for c, t in zip(zip(*self.rows), types)]
        found = pa.StructArray.from_arrays([pa.array(self.kinds, pa.int32()), pa.array(self.bodies, pa.binary())], fields=list(self.SCHEMA.field("elements").type.value_type))
        tagged = pa.ListArray.from_arrays(pa.array([*self.starts, len(self.kinds)], pa.int32()), found)
        return pa.RecordBatch.from_arrays([*plain[:-1], tagged, plain[-1]], schema=self.SCHEMA)


def split_captures(files: DataFrame) -> DataFrame:
    """Records of a ``(path, content)`` table in their parts; a file is cut by one task and leaves it in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Cuts()
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                name = path.as_py()
                for number, (t_us, raw) in enumerate(records(content.as_py() or b"")):
                    out.add(name, number, t_us, raw)
                    if len(out.rows) >= BATCH:
                        yield out.batch()
                        out = Cuts()
        if out.rows:
            yield out.batch()

    return files.select("path", "content").mapInArrow(run, RECORDS_DDL)


def _byte(h: Column, at: Column | int) -> Column:
    """Byte ``at`` of a text of hexadecimal digits; null behind its end."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.when(F.length(h) >= 2 * at + 2, F.conv(F.substr(h, 2 * at + 1, F.lit(2)), 16, 10).cast("int"))


def _u16(h: Column, at: Column | int) -> Column:
    return _byte(h, at) + 256 * _byte(h, at + 1)


def _part(h: Column, at: Column, size: int) -> Column:
    return F.when(F.length(h) >= 2 * (at + size), F.substr(h, 2 * at + 1, F.lit(2 * size)))


def _mac(h: Column, at: Column) -> Column:
    return F.rtrim(F.regexp_replace(_part(h, at, 6), "(..)", "$1:"), F.lit(":"))


def _bit(value: Column, mask: int) -> Column:
    return value.bitwiseAND(F.lit(mask)) != 0


def _element(kind: int) -> Column:
    """Content of the last element of a kind, as hexadecimal digits."""
    return F.hex(F.try_element_at(F.filter("elements", lambda e: e["kind"] == kind), F.lit(-1))["body"])


def _suites(h: Column, at: Column | int) -> tuple[Column, Column]:
    """Suite selectors of a counted list, and where it ends."""
    at = F.lit(at) if isinstance(at, int) else at
    n = F.coalesce(F.least(_u16(h, at), F.floor((F.length(h) / 2 - at - 2) / 4).cast("int")), F.lit(0))
    one = lambda i: F.lower(F.substr(h, 2 * at + 5 + 8 * i, F.lit(8)))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<string>")), at + 2 + 4 * n


def decode_records(recs: DataFrame) -> DataFrame:
    """Columns of radiotap + 802.11 frames; unreadable input carries ``parse_error``."""
    h, b, c = F.col("h"), F.col("b"), F.col
    df = recs.withColumns({"h": F.hex("header"), "b": F.hex("body")}).withColumn("control", _u16(h, 0))
    df = df.withColumns({"type_code": F.shiftright("control", 2).bitwiseAND(F.lit(3)), "subtype_code": F.shiftright("control", 4).bitwiseAND(F.lit(15))})
    management, data, steering, sub = c("type_code") == 0, c("type_code") == 2, c("type_code") == 1, c("subtype_code")
    beaconlike, auth = management & sub.isin(5, 8), management & (sub == 11)
    names = F.array(*[F.lit(m) for m in MANAGEMENT])
    kind = F.when(management, F.get(names, sub)).when(data, "data").when(steering & (sub == 11), "rts").when(steering & (sub == 12), "cts").when(steering & (sub == 13), "ack").when(c("control").isNotNull(), "other")
    # Handshake messages: key frames behind the LLC header, told apart by the acknowledge, MIC, install and secure bits.
    llc = F.when(_bit(sub, 8), 2).otherwise(0) + F.when(_bit(c("control"), 0x0100) & _bit(c("control"), 0x0200), 6).otherwise(0)
    df = df.withColumns({
        "protected": _bit(c("control"), 0x4000), "retry": _bit(c("control"), 0x0800), "flags": F.when(beaconlike, _u16(b, 10)), "llc": F.when(data & ~_bit(c("control"), 0x4000), llc),
        "rsn": _element(48), "name": F.try_element_at(F.filter("elements", lambda e: e["kind"] == 0), F.lit(-1))["body"],
        "vendors": F.transform(F.filter("elements", lambda e: e["kind"] == 221), lambda e: F.substring(F.hex(e["body"]), 1, 8)),
    })
    key = (_part(b, c("llc"), 8) == "AAAA03000000888E") & (_byte(b, c("llc") + 9) == 3)
    df = df.withColumns({"key": F.when(key, _byte(b, c("llc") + 13) * 256 + _byte(b, c("llc") + 14)), "rsn": F.when(F.length("rsn") >= 16, c("rsn"))})
    ack, mic, install, secure = (_bit(c("key"), m) for m in (0x80, 0x100, 0x40, 0x200))
    message = F.when(ack & ~mic, 1).when(ack & mic & install, 3).when(~ack & mic & secure, 4).when(~ack & mic, 2)
    pairwise, after = _suites(c("rsn"), 6)
    df = df.withColumns({"rsn_pairwise": F.when(c("rsn").isNotNull(), pairwise), "after": after})
    akm, end = _suites(c("rsn"), c("after"))
    df = df.withColumns({"rsn_akm": F.when(c("rsn").isNotNull(), akm), "rsn_caps": _u16(c("rsn"), end)})
    has = lambda k: F.exists("elements", lambda e: e["kind"] == k)
    there = lambda test: F.when(test, True)
    vendor = lambda e: F.substring(F.hex(e["body"]), 1, 8)
    plain = F.create_map(*[F.lit(x) for p in ELEMENTS.items() for x in p])
    label = lambda e: F.when(e["kind"] == 221, F.when(vendor(e) == WPA, "WPA").when(vendor(e) == WPS, "WPS")).when((e["kind"] != 3) | (F.length(e["body"]) > 0), F.try_element_at(plain, e["kind"]))
    return df.withColumns({
        "frame_type": kind, "dst_addr": F.when(c("type_code") < 3, _mac(h, F.lit(4))), "src_addr": F.when(management | data | (steering & (sub == 11)), _mac(h, F.lit(10))), "bssid": F.when(management | data, _mac(h, F.lit(16))),
        "seq_num": F.when(management | data, F.shiftright(_u16(h, 22), 4)), "fragment_num": F.when(management | data, _u16(h, 22).bitwiseAND(F.lit(15))),
        "ssid": F.coalesce(F.try_validate_utf8(F.expr("cast(name as string)")), F.decode("name", "ISO-8859-1")), "channel": _byte(_element(3), 0),
        "beacon_interval": F.when(beaconlike, _u16(b, 8)), "capability_flags": c("flags"), "ess": _bit(c("flags"), 1), "ibss": _bit(c("flags"), 2),
        "privacy": F.when(data & c("protected"), True).otherwise(_bit(c("flags"), 16)),
        "ht": there(has(45)), "vht": there(has(191)), "he": there(F.exists("elements", lambda e: (e["kind"] == EXTENSION) & (F.substring(F.hex(e["body"]), 1, 2) == f"{HE:02X}"))),
        "wpa": there(F.array_contains("vendors", WPA)), "wps": there(F.array_contains("vendors", WPS)),
        "rsn_version": _u16(c("rsn"), 0), "rsn_group": F.lower(F.substring("rsn", 5, 8)), "pmf_capable": _bit(c("rsn_caps"), 0x80), "pmf_required": _bit(c("rsn_caps"), 0x40),
        "ies_present": F.when(beaconlike | (management & (sub == 4)), F.array_compact(F.transform("elements", label))),
        "reason_code": F.when(management & sub.isin(10, 12), _u16(b, 0)), "auth_algo": F.when(auth, _u16(b, 0)), "auth_seq": F.when(auth, _u16(b, 2)),
        "status_code": F.when(auth, _u16(b, 4)).when(management & (sub == 1), _u16(b, 2)),
        "wep_iv": F.when(data & c("protected") & (F.length(b) >= 8), F.lower(_part(b, F.lit(0), 3))), "eapol_message": message,
    }).select(*COLUMNS)


def decode_captures(files: DataFrame) -> DataFrame:
    """Frames of a ``(path, content)`` table."""
    return decode_records(split_captures(files))


def read_captures(spark: SparkSession, path: str, pattern: str = "*.pcap") -> DataFrame:
    """All capture files under a path, decoded where they lie."""
    return decode_captures(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path))


def capture_frames(decoded: DataFrame, sensor: Column | str) -> DataFrame:
    """Decoded captures as the frame table that detectors read (and ``ies_present``); ``sensor`` names where a file comes from.

    The id of a frame is a hash of its file and number. Security follows the live classification; handshake frames are
    of type ``eapol``. Frames that could not be read, or have no sender or receiver, are left out.
    """
    from skyfence.operators.normalise import classify_security

    sensor = F.lit(sensor) if isinstance(sensor, str) else sensor
    named = decoded.filter("parse_error is null and coalesce(src_addr, dst_addr) is not null").withColumns({
        "has_rsn": F.col("rsn_version").isNotNull(), "has_wpa": F.coalesce("wpa", F.lit(False)), "pmf": F.coalesce(F.col("pmf_capable") | F.col("pmf_required"), F.lit(False)),
    })
    beaconlike = F.col("frame_type").isin("beacon", "probe_resp")
    secured = classify_security(named, "live")
    return secured.select(
        F.xxhash64("path", "frame_no").alias("event_id"), "t_us", sensor.alias("sensor_id"), F.when(F.col("eapol_message").isNotNull(), "eapol").otherwise(F.col("frame_type")).alias("frame_type"),
        "bssid", oui("bssid").alias("vendor_oui"), "ssid", "src_addr", "dst_addr", F.coalesce("channel", mhz_to_channel(F.col("frequency_mhz"))).cast("int").alias("channel"), F.coalesce("frequency_mhz", channel_to_mhz(F.col("channel"))).cast("int").alias("frequency_mhz"),
        F.col("rssi_dbm").cast("bigint").alias("rssi_dbm"), F.when(beaconlike, F.when(F.col("security_class") == "OPEN", "Open").otherwise(F.col("security_class"))).alias("security"),
        "privacy", F.coalesce("wps", F.lit(False)).alias("wps"), "pmf", F.col("seq_num").cast("bigint").alias("seq_num"), "retry", F.col("eapol_message").cast("bigint").alias("eapol_message"),
        "wep_iv", F.col("frame_len").cast("bigint").alias("frame_len"), F.col("beacon_interval").cast("bigint").alias("beacon_interval"), "ies_present",
    )
