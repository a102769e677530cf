"""Unanswered handshake starts, counted exactly with first-in-first-out cancelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfence.operators.timeline import running, slot_of

# The waiting message-1 frames of an AP are always its newest ones, so the whole state is the
# position of the oldest waiting one. A frame moves that position by ``max`` (expiry) or by
# "+1, not past the end" (an answer); any run of such moves is again clamp(x + k, lo, hi).

FAR = 1 << 61


def _clamped(x: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(x, lo), hi)


def _move(k: Column, lo: Column, hi: Column) -> Column:
    return F.struct(k.alias("k"), lo.alias("lo"), hi.alias("hi"))


def _after(at: Column, row: Column) -> Column:
    """Position behind a frame: past what expired, and one further if the frame answers."""
    at = F.greatest(at, row["floor"])
    return F.when(row["answer"], F.least(at + 1, row["total"])).otherwise(at)


def _run(rows: str) -> Column:
    """What a run of frames does, as one clamp."""
    step = lambda s, r: _move(F.when(r["answer"], s["k"] + 1).otherwise(s["k"]), _after(s["lo"], r), _after(s["hi"], r))
    return F.aggregate(rows, _move(F.lit(0).cast("bigint"), F.lit(-FAR), F.lit(FAR)), step)


def _chain(moves: str) -> Column:
    """What moves of (k, lo, hi) do one after another."""
    step = lambda s, m: _move(s["k"] + m["k"], _clamped(s["lo"] + m["k"], m["lo"], m["hi"]), _clamped(s["hi"] + m["k"], m["lo"], m["hi"]))
    return F.aggregate(moves, _move(F.lit(0).cast("bigint"), F.lit(-FAR), F.lit(FAR)), step)


def _starts(moves: str, start: Column) -> Column:
    """Position before each of some moves."""
    step = lambda s, m: F.concat(s, F.array(_clamped(F.element_at(s, -1) + m["k"], m["lo"], m["hi"])))
    return F.aggregate(moves, F.array(start), step)


def pending_m1(talk: DataFrame, width_us: int, pack: int = 512) -> DataFrame:
    """Add ``orphaned_m1``: message-1 frames of the bssid in the window not yet answered.

    Each message 2 answers the oldest waiting message 1; waiting ends after ``width``. Frames without bssid or time are left out.
    The frames of a bssid are numbered and dealt into packs of ``pack`` frames, packs into groups of ``pack`` packs, so no
    cell of either holds more at any rate of frames; one row for each ``pack`` squared frames is chained per bssid.
    """
    known = talk.filter("bssid is not null and t_us is not null")
    first = F.col("row.eapol_message") == 1
    frames = known.select("bssid", "t_us", F.struct(F.lit(1).alias("kind"), "event_id").alias("tie"), F.struct(*talk.columns).alias("row"))
    # A message 1 counts as expired from one instant behind its window, before the frames of that instant.
    ends = frames.filter(first).select("bssid", (F.col("t_us") + width_us + 1).alias("t_us"), F.struct(F.lit(0).alias("kind"), "row.event_id").alias("tie"))
    one = lambda test: ("sum", F.when(test, 1).otherwise(0).cast("bigint"))
    counted = running(
        frames.unionByName(ends, allowMissingColumns=True), ["bssid"],
        {"total": one(first), "floor": one(F.col("tie.kind") == 0), "n": one(F.col("tie.kind") == 1)}, tie="tie", inclusive=True,
    ).filter("row is not null")
    answer = F.coalesce(F.col("row.eapol_message") == 2, F.lit(False))
    frame = F.struct("n", "floor", "total", answer.alias("answer"), "row")
    packs = counted.groupBy("bssid", slot_of("n", pack).alias("_pack")).agg(F.array_sort(F.collect_list(frame)).alias("frames"))
    moves = packs.select("bssid", "_pack", slot_of("_pack", pack).alias("_group"), _run("frames").alias("m"))
    groups = moves.groupBy("bssid", "_group").agg(F.array_sort(F.collect_list(F.struct("_pack", "m.k", "m.lo", "m.hi"))).alias("moves"))
    chains = groups.withColumn("m", _chain("moves")).groupBy("bssid").agg(F.array_sort(F.collect_list(F.struct("_group", "m.k", "m.lo", "m.hi"))).alias("chain"))
    pairs = lambda moves, name, start: F.inline(F.arrays_zip(F.col(f"{moves}.{name}").alias(name), F.slice(_starts(moves, start), 1, F.size(moves)).alias("start")))
    heads = chains.select("bssid", pairs("chain", "_group", F.lit(0).cast("bigint")))
    heads = groups.join(heads, ["bssid", "_group"]).select("bssid", pairs("moves", "_pack", F.col("start")))
    walk = F.aggregate("frames", F.array("start"), lambda s, r: F.concat(s, F.array(_after(F.element_at(s, -1), r))))
    done = packs.join(heads, ["bssid", "_pack"]).select("frames", walk.alias("at"))
    placed = done.select(F.inline(F.transform("frames", lambda f, i: F.struct(f["row"].alias("row"), (f["total"] - F.get("at", i + 1)).alias("orphaned_m1")))))
    return placed.select("row.*", "orphaned_m1")
