"""Radio and frame dictionaries as literal lookups (folded into the plan, no join)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the 802.11 standard.
CHANNELS_5GHZ = [36, 40, 44, 48, 52, 56, 60, 64, 100, 104, 108, 112, 116, 120, 124, 128, 132, 136, 140, 144, 149, 153, 157, 161, 165]
FRAME_TYPES = {0: "management", 1: "control", 2: "data", 3: "extension"}
MANAGEMENT = [
    "assoc_req", "assoc_resp", "reassoc_req", "reassoc_resp", "probe_req", "probe_resp", "timing_adv", "reserved",
    "beacon", "atim", "disassoc", "auth", "deauth", "action", "action_noack", "reserved",
]
CONTROL = [
    "reserved", "reserved", "trigger", "tack", "beamforming", "vht_ndp", "ctrl_ext", "ctrl_wrapper",
    "block_ack_req", "block_ack", "ps_poll", "rts", "cts", "ack", "cf_end", "cf_end_ack",
]
DATA = [
    "data", "data_cf_ack", "data_cf_poll", "data_cf_ack_poll", "null", "cf_ack", "cf_poll", "cf_ack_poll",
    "qos_data", "qos_data_cf_ack", "qos_data_cf_poll", "qos_data_cf_ack_poll", "qos_null", "reserved",
    "qos_cf_poll", "qos_cf_ack_poll",
]
REASONS = [
    "unspecified", "unspecified", "prev_auth_not_valid", "deauth_leaving", "disassoc_inactivity", "disassoc_ap_busy",
    "class2_frame_from_nonauth", "class3_frame_from_nonassoc", "disassoc_sta_leaving", "sta_req_assoc_not_auth",
    "disassoc_power_cap_bad", "disassoc_supp_chan_bad", "reserved", "invalid_ie", "mic_failure",
    "4way_handshake_timeout", "group_key_update_timeout", "ie_in_4way_differs", "group_cipher_not_valid",
    "pairwise_cipher_not_valid", "akmp_not_valid", "unsupported_rsn_ie_version", "invalid_rsn_ie_cap",
    "ieee_802_1x_auth_failed", "cipher_suite_rejected",
]
CIPHERS = {
    0: "use_group", 1: "wep40", 2: "tkip", 3: "reserved", 4: "ccmp", 5: "wep104", 6: "bip_cmac", 8: "gcmp", 9: "gcmp256", 10: "ccmp256",
}
AKMS = {1: "8021x", 2: "psk", 3: "ft_8021x", 4: "ft_psk", 5: "8021x_sha256", 6: "psk_sha256", 8: "sae", 9: "ft_sae", 18: "owe"}


def lookup(table: dict, key: Column, default: Column | None = None) -> Column:
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    out = F.try_element_at(pairs, key)
    return out if default is None else F.coalesce(out, default)


def channel_to_mhz(ch: Column) -> Column:
    return F.when(ch.between(1, 13), 2407 + 5 * ch).when(ch == 14, 2484).when(ch.isin(CHANNELS_5GHZ), 5000 + 5 * ch)


def mhz_to_channel(mhz: Column) -> Column:
    low = ((mhz - 2407) / 5).cast("int")
    high = ((mhz - 5000) / 5).cast("int")
    ch = F.when(mhz == 2484, 14).when(low.between(1, 13), low).when(high.isin(CHANNELS_5GHZ), high)
    return F.when(channel_to_mhz(ch) == mhz, ch)


def frame_type_name(code: Column) -> Column:
    return lookup(FRAME_TYPES, code.cast("int"), F.lit("unknown"))


def subtype_name(code: Column, sub: Column) -> Column:
    names = {t * 16 + s: n for t, row in enumerate([MANAGEMENT, CONTROL, DATA]) for s, n in enumerate(row)}
    return F.when(sub.between(0, 15), lookup(names, (code * 16 + sub).cast("int"), F.lit("unknown"))).otherwise("unknown")


def reason_name(code: Column) -> Column:
    unknown = F.concat(F.lit("unknown ("), code.cast("string"), F.lit(")"))
    return lookup(dict(enumerate(REASONS)), code.cast("int"), unknown)


def cipher_name(code: Column) -> Column:
    return lookup(CIPHERS, code.cast("int"), F.lit("unknown"))


def akm_name(code: Column) -> Column:
    return lookup(AKMS, code.cast("int"), F.lit("unknown"))
