"""Address, time and name clean-up, and pseudonyms, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAC_REGEX = "^([0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}$"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical_mac(c: str | Column) -> Column:
    """Upper case, colon separated; any of ``aa-bb-..``, ``aabb.ccdd.eeff``, ``aabbccddeeff``."""
    c = F.upper(_col(c))
    # Nearly all addresses are already well formed: let them pass without the patterns.
    fine = (F.length(c) == 17) & (F.translate(c, "0123456789ABCDEF", "") == ":::::") & (F.substring(c, 3, 1) == ":")
    bare = F.regexp_replace(c, "[-.:]", "")
    paired = F.rtrim(F.regexp_replace(bare, "(..)", "$1:"), F.lit(":"))
    return F.when(fine & (F.substring(c, 15, 1) == ":"), c).when(F.length(bare) == 12, paired).otherwise(F.regexp_replace(c, "[-.]", ":"))


def clean_ssid(c: str | Column) -> Column:
    return F.regexp_replace(_col(c), "\\x00", "")


def parse_time(c: str | Column) -> Column:
    """ISO text (``Z`` or offset allowed, naive means UTC) or epoch seconds to a timestamp."""
    c = _col(c).cast("string")
    number = c.rlike("^[0-9]+(\\.[0-9]+)?$")
    return F.when(number, F.timestamp_micros((c.cast("decimal(20,6)") * 1000000).cast("bigint"))).otherwise(
        F.try_to_timestamp(c)
    )


def oui(c: str | Column) -> Column:
    """Vendor part of an address."""
    c = _col(c)
    head = F.upper(F.substring(c, 1, 8))
    return F.when((F.length(c) == 17) & (F.substring(c, 3, 1) == ":") & (F.substring(c, 6, 1) == ":"), head).otherwise(F.substring(canonical_mac(c), 1, 8))


def mac_hash(c: str | Column, salt: str) -> Column:
    """First 16 hex digits of SHA-256 over salt and canonical address."""
    return F.substring(F.sha2(F.concat(F.lit(salt), canonical_mac(c)), 256), 1, 16)


def pseudonym(c: str | Column, mode: str, salt: str) -> Column:
    """``oui`` keeps the vendor part; anything else becomes a salted pseudo-address."""
    c = _col(c)
    mac = canonical_mac(c)
    if mode.lower() == "oui":
        out = F.when(F.size(F.split(mac, ":")) == 6, F.concat(F.substring(mac, 1, 8), F.lit(":00:00:00"))).otherwise(c)
    else:
        out = F.rtrim(F.regexp_replace(F.upper(F.substring(mac_hash(c, salt), 1, 12)), "(..)", "$1:"), F.lit(":"))
    return F.when(c.isNull() | (c == ""), c).otherwise(out)


def masked_ssid(c: str | Column, mode: str, salt: str) -> Column:
    """``mask``: one asterisk per character; otherwise a short salted hash."""
    c = _col(c)
    out = F.repeat(F.lit("*"), F.length(c)) if mode == "mask" else F.concat(F.substring(mac_hash(c, salt), 1, 8), F.lit("..."))
    return F.when(c.isNotNull() & (c != ""), out).otherwise("")
