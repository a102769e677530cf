"""Names and addresses against an inventory; near-identical names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inventory_mismatch(frames: DataFrame, inventory: DataFrame) -> DataFrame:
    """Known names heard from addresses the inventory (ssid, bssid) does not list."""
    seen = frames.filter(F.col("frame_type").isin("beacon", "probe_resp") & (F.col("ssid") != "")).select("ssid", F.upper("bssid").alias("bssid")).distinct()
    listed = inventory.select("ssid", F.upper("bssid").alias("bssid")).distinct()
    return seen.join(listed.select("ssid").distinct(), "ssid", "left_semi").join(listed, ["ssid", "bssid"], "left_anti")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def most_edits(longer: Column, threshold: float) -> Column:
    """Most edits a name of this length may differ by and still reach the threshold."""
    guess = F.floor((1 - threshold) * longer).cast("int")  # off by one at most, by rounding
    fits = lambda d: (d <= longer) & (1.0 - d / longer >= threshold)
    return F.when(fits(guess + 1), guess + 1).when(fits(guess), guess).otherwise(F.greatest(guess - 1, F.lit(0)))


def similar_ssids(names: DataFrame, threshold: float = 0.85, col: str = "ssid") -> DataFrame:
    """Pairs of distinct names with similarity of at least the threshold, each pair once; names of any length.

    A name cut into d+1 pieces keeps one piece intact under d edits, at most d places away. Pieces
    of the longer name meet equal substrings of the other one, so pairing is an equality join on
    (length, piece, text) and never all against all. Exact for any threshold above 0.
    """
    distinct = names.select(F.col(col).alias("name")).filter(F.col("name").isNotNull() & (F.col("name") != "")).distinct().withColumn("size", F.length("name"))
    # Longer names that a name of this size may match: from its own size to size / threshold.
    a = distinct.select(F.col("name").alias("a"), F.col("size").alias("len"), most_edits(F.col("size"), threshold).alias("d"))
    start = lambda i: F.expr(f"cast(floor(({i}) * len / (d + 1)) as int)")
    a = a.select("a", "len", "d", F.explode(F.expr("sequence(0, d)")).alias("piece")).select("a", "len", "piece", F.substring("a", start("piece") + 1, start("piece + 1") - start("piece")).alias("text"))
    b = distinct.select(F.col("name").alias("b"), "size", F.explode(F.sequence(F.col("size"), F.ceil(F.col("size") / threshold + 1e-9).cast("int"))).alias("len"))
    b = b.withColumn("d", most_edits(F.col("len"), threshold)).filter("len - size <= d").select("b", "size", "len", "d", F.explode(F.expr("sequence(0, d)")).alias("piece"))
    b = b.select("b", "size", "len", "d", "piece", start("piece").alias("from"), (start("piece + 1") - start("piece")).alias("width"))
    low, high = F.greatest(F.lit(0), F.col("from") - F.col("d")), F.least(F.col("size"), F.col("from") + F.col("d"))
    b = b.filter(low <= high).select("b", "len", "piece", "width", F.explode(F.sequence(low, high)).alias("at"))
    b = b.select("b", "len", "piece", F.substring("b", F.col("at") + 1, F.col("width")).alias("text")).distinct()
    la, lb = F.length("a"), F.length("b")
    once = (la > lb) | ((la == lb) & (F.col("a") < F.col("b")))
    pairs = a.join(b, ["len", "piece", "text"]).filter(once & (similarity(F.col("a"), F.col("b")) >= threshold)).select("a", "b").distinct()
    return pairs.select(
        F.least("a", "b").alias("ssid_a"), F.greatest("a", "b").alias("ssid_b"), similarity(F.col("a"), F.col("b")).alias("similarity")
    )
