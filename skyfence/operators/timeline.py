"""Keyed time-line primitives shared by the detectors.

Every primitive splits a key's history by time, so that one busy access point, station or
sensor spreads over many tasks instead of landing in one:

* ``trailing``  counts and distinct counts over the last W of event time. It sweeps +1/-1
  edges with a growing frame: linear in the rows, however dense the window is.
* ``running``   unbounded prior/running aggregates: per-slice partials, a prefix over the
  (few) slices of a key, then a local window inside each slice.
* ``episodes``  activity sessions closed by an idle gap, found on pre-aggregated slots.
* ``cooldown``  the greedy "alert, then stay quiet for C" fold.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

US = 1_000_000
NEVER = -(2**61)


def slot_of(t: str | Column, span_us: int | Column) -> Column:
    """Index of the time slot of length ``span_us`` (also right for negative times)."""
    t = F.col(t) if isinstance(t, str) else t
    span = (span_us if isinstance(span_us, Column) else F.lit(span_us)).cast("bigint")
    return F.call_function("div", t - F.pmod(t, span), span)


def _whole(keys: Sequence[str]) -> dict[str, Column]:
    """Never-null copies of key columns: rows without a key stay together and survive joins."""
    return {f"_k{i}": F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for i, k in enumerate(keys)}


def trailing(
    df: DataFrame,
    keys: Sequence[str],
    width_us: int,
    counts: dict[str, Column | None] | None = None,
    distincts: dict[str, str] | None = None,
    t: str = "t_us",
    slots_per_width: int = 16,
) -> DataFrame:
    """Add, per row, aggregates over the rows of its key with time in ``[t - W, t]``.

    ``counts`` maps output name to a boolean condition (``None`` counts every row);
    ``distincts`` maps output name to a column whose distinct non-null values are counted.
    """
    counts = counts or {}
    distincts = distincts or {}
    span = width_us * slots_per_width
    home = slot_of(t, span)
    late = F.pmod(F.col(t), F.lit(span)) >= F.lit(span - width_us)
    rows = df.withColumn("_home", home).withColumn(
        "_slot", F.explode(F.when(late, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home")))
    )
    part = [*keys, "_slot"]
    rows = rows.repartition(*part)

    ups, downs = {}, {}
    for name, cond in counts.items():
        weight = F.lit(1) if cond is None else F.when(cond, 1).otherwise(0)
        rows = rows.withColumn(f"_w_{name}", weight)
        ups[name], downs[name] = F.col(f"_w_{name}"), -F.col(f"_w_{name}")
    for name, value in distincts.items():
        by_value = Window.partitionBy(*part, value).orderBy(t)
        before, after = F.lag(t).over(by_value), F.lead(t).over(by_value)
        known = F.col(value).isNotNull()
        opens = known & (before.isNull() | (F.col(t) - before > width_us))
        closes = known & (after.isNull() | (after - F.col(t) > width_us))
        rows = rows.withColumn(f"_o_{name}", F.when(opens, 1).otherwise(0))
        rows = rows.withColumn(f"_c_{name}", F.when(closes, -1).otherwise(0))
        ups[name], downs[name] = F.col(f"_o_{name}"), F.col(f"_c_{name}")

    names = [*counts, *distincts]
    edge_in = F.struct(
        F.col(t).alias("at"),
        F.struct(*[F.col(c) for c in df.columns]).alias("row"),
        *[ups[n].alias(n) for n in names],
    )
    row_type = df.select(F.struct(*df.columns).alias("r")).schema["r"].dataType
    edge_out = F.struct(
        (F.col(t) + F.lit(width_us + 1)).alias("at"),
        F.lit(None).cast(row_type).alias("row"),
        *[downs[n].alias(n) for n in names],
    )
    swept = rows.select(*part, "_home", F.inline(F.array(edge_in, edge_out)))
    sweep = Window.partitionBy(*part).orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = swept.select(
        "row", (F.col("_home") == F.col("_slot")).alias("_own"), *[F.sum(n).over(sweep).alias(n) for n in names]
    )
    return out.filter(F.col("row").isNotNull() & F.col("_own")).select("row.*", *names)


def running(
    df: DataFrame,
    keys: Sequence[str],
    spec: dict[str, tuple[str, Column]],
    t: str = "t_us",
    tie: str = "event_id",
    inclusive: bool = False,
    slice_us: int = 3600 * US,
) -> DataFrame:
    """Add aggregates over all earlier rows of the key (plus the row itself if inclusive).

    ``spec`` maps output name to ``(kind, column)``, kind in sum, count, max, min, last
    (``last`` and ``first`` take the latest / earliest non-null value).
    """
    made = _whole(keys)
    rows = df.withColumns(made | {"_slice": F.coalesce(slot_of(t, slice_us), F.lit(0))})
    whole, part = [*made], [*made, "_slice"]
    stop = Window.currentRow if inclusive else -1
    local = Window.partitionBy(*part).orderBy(t, tie).rowsBetween(Window.unboundedPreceding, stop)
    upto = Window.partitionBy(*whole).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)

    def value(kind: str, col: Column) -> Column:
        if kind in ("last", "first"):
            return F.when(col.isNotNull(), F.struct(F.col(t).alias("t"), F.col(tie).alias("i"), col.alias("v")))
        if kind == "count":
            return F.when(col.isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
        return col

    fold = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min, "last": F.max, "first": F.min}
    rows = rows.withColumns({f"_v_{name}": value(kind, col) for name, (kind, col) in spec.items()})
    partial = rows.groupBy(*part).agg(*[fold[k](f"_v_{n}").alias(f"_p_{n}") for n, (k, _) in spec.items()])
    prefix = partial.select(*part, *[fold[k](f"_p_{n}").over(upto).alias(f"_p_{n}") for n, (k, _) in spec.items()])
    rows = rows.select("*", *[fold[k](f"_v_{n}").over(local).alias(f"_l_{n}") for n, (k, _) in spec.items()])
    rows = rows.join(prefix, part)
    out = []
    for name, (kind, _) in spec.items():
        here, there = F.col(f"_l_{name}"), F.col(f"_p_{name}")
        if kind in ("sum", "count"):
            both = F.when(here.isNull(), there).when(there.isNull(), here).otherwise(here + there)
            out.append((F.coalesce(both, F.lit(0)) if kind == "count" else both).alias(name))
        elif kind == "last":
            out.append(F.coalesce(here, there)["v"].alias(name))
        elif kind == "first":
            out.append(F.coalesce(there, here)["v"].alias(name))
        else:
            out.append((F.greatest if kind == "max" else F.least)(here, there).alias(name))
    return rows.select(*[F.col(c) for c in df.columns], *out)


def episodes(df: DataFrame, keys: Sequence[str], gap_us: int, t: str = "t_us") -> DataFrame:
    """``(keys, _slot, episode)``: the start time of the activity episode each slot belongs to.

    Rows that share a slot of length ``gap`` are never further apart than the gap, so episode
    borders can be found on one row per slot instead of one per frame.
    """
    slots = df.groupBy(*keys, slot_of(t, gap_us).alias("_slot")).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    order = Window.partitionBy(*keys).orderBy("_slot")
    idle = F.col("_lo") - F.lag("_hi").over(order)
    marked = slots.withColumn("_start", F.when(idle.isNull() | (idle > gap_us), F.col("_lo")))
    return marked.select(
        *keys, "_slot", F.last("_start", ignorenulls=True).over(order).alias("episode")
    )


def _later(free: np.ndarray, hits: np.ndarray, last: np.ndarray, cool: int) -> np.ndarray:
    """The next instant that restarts the cooldown after each of ``last``; ``-NEVER`` where none does."""
    out = np.append(free, -NEVER)[np.searchsorted(free, last + cool, side="left")]
    return np.minimum(out, np.append(hits, -NEVER)[np.searchsorted(hits, last, side="right")]) if len(hits) else out


def _exit_steps(ts: np.ndarray, head: np.ndarray, forced: np.ndarray, cool: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """How the last emission before a slice turns into the last one after it.

    The map is a step function of the entry time, so a slice of any size is summarised by its few distinct exits.
    Only the instants that can come first are moved on, a cooldown at a time, and neighbours that meet go on as one.
    """
    free, hits = ts if head.all() else ts[head], ts[forced]
    if len(hits):  # whatever came before, a forced row restarts the cooldown
        bounds, now = np.array([2**62]), hits[-1:]
    else:
        # Entry times are below ``start + cool``: only the free instants up to there can come first.
        bounds = now = free[: int(np.searchsorted(free, start + cool, side="left")) + 1]
    while len(now):
        then = _later(free, hits, now, cool)
        moved = then < -NEVER
        now = np.where(moved, then, now)
        keep = np.append(now[1:] != now[:-1], True)
        bounds, now = bounds[keep], now[keep]
        if not moved.any():
            break
    return bounds, now


def _freed(ts: np.ndarray, head: np.ndarray, forced: np.ndarray, cool: int, last: int) -> list[int]:
    """Instants whose first row is emitted because the cooldown is over."""
    free, hits, out = ts if head.all() else ts[head], ts[forced], []
    leads = np.empty(0, ts.dtype) if not len(hits) else ts[head & forced]
    while (t := int(_later(free, hits, np.array([last]), cool)[0])) < -NEVER:
        at = int(np.searchsorted(hits, t))
        led = at == len(hits) or hits[at] != t or bool(np.isin(t, leads[np.searchsorted(leads, t):][:1]))
        if led and t - last >= cool:
            out.append(t)
        last = t
    return out


_LONGS = T.ArrayType(T.LongType())
_STEPS = T.StructType([T.StructField("b", _LONGS), T.StructField("e", _LONGS)])
_ENTRIES = T.ArrayType(T.StructType([T.StructField("s", T.LongType()), T.StructField("l", T.LongType())]))


def _unpack(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Instants with their two flags from ``4 * t + 2 * forced + head``."""
    marks = np.asarray(marks, dtype=np.int64)
    return marks >> 2, (marks & 1).astype(bool), (marks & 2).astype(bool)


@F.pandas_udf(_STEPS)
def _summarise(marks: pd.Series, start: pd.Series, cool: pd.Series) -> pd.DataFrame:
    out = [_exit_steps(*_unpack(m), int(c), int(s)) for m, s, c in zip(marks, start, cool)]
    return pd.DataFrame({"b": [o[0] for o in out], "e": [o[1] for o in out]})


@F.pandas_udf(_ENTRIES)
def _chain(parts: pd.Series, cool: pd.Series) -> pd.Series:
    out = []
    for steps, c in zip(parts, cool):
        last, entry = NEVER, []
        for p in steps:
            entry.append({"s": int(p["s"]), "l": last})
            at = int(np.searchsorted(p["b"], last + c, side="left"))
            if at < len(p["e"]):
                last = int(p["e"][at])
        out.append(entry)
    return pd.Series(out)


@F.pandas_udf(_LONGS)
def _replay(marks: pd.Series, last: pd.Series, cool: pd.Series) -> pd.Series:
    return pd.Series([_freed(*_unpack(m), int(c), int(l)) for m, l, c in zip(marks, last, cool)])


def cooldown(
    df: DataFrame,
    keys: Sequence[str],
    cool_us: int | str,
    t: str = "t_us",
    tie: str = "event_id",
    forced: str | None = None,
    slices: int = 8,
) -> DataFrame:
    """Keep a row if it comes at least ``cool`` after the last row kept for its key.

    ``cool_us`` is a length or the name of a column that is constant within a key. Rows whose
    ``forced`` column is true are always kept and restart the cooldown.

    The fold is sequential per key, but only through the time of the last kept row: each slice of a
    key is summarised on its own, the summaries are chained, and each slice is then replayed on its
    own. Only distinct instants travel through it, eight bytes each; the rows themselves are picked
    by a join at the end. No task sees more than one slice of a key.
    """
    cool = (F.col(cool_us) if isinstance(cool_us, str) else F.lit(cool_us)).cast("bigint")
    flag = F.coalesce(F.col(forced), F.lit(False)) if forced else F.lit(False)
    made = _whole(keys) | {"_cool": F.coalesce(cool, F.lit(0)), "_t": F.col(t).cast("bigint"), "_force": flag}
    rows = df.select("*", *[c.alias(n) for n, c in made.items()])
    part = [n for n in made if n.startswith("_k")] + ["_cool"]
    slot = F.coalesce(slot_of("_t", F.col("_cool") * slices), F.lit(0)).alias("_slice")
    if forced:
        # The first row of an instant decides whether the instant may be freed.
        instants = rows.groupBy(*part, "_t").agg(
            F.max("_force").alias("_any"), F.min(F.struct(F.col(tie), F.col("_force"))).getField("_force").alias("_led")
        )
        mark = F.col("_t") * 4 + F.when(F.col("_any"), 2).otherwise(0) + F.when(F.col("_led"), 0).otherwise(1)
        packed = instants.groupBy(*part, slot).agg(F.sort_array(F.collect_list(mark)).alias("_marks"))
    else:
        packed = rows.groupBy(*part, slot).agg(F.sort_array(F.collect_set(F.col("_t") * 4 + 1)).alias("_marks"))
    start = F.col("_slice") * F.col("_cool") * slices
    steps = packed.select(*part, "_slice", _summarise("_marks", start, "_cool").alias("_m"))
    step = F.struct(F.col("_slice").alias("s"), F.col("_m.b").alias("b"), F.col("_m.e").alias("e"))
    entries = (
        steps.groupBy(*part).agg(F.sort_array(F.collect_list(step)).alias("_p"))
        .select(*part, F.inline(_chain("_p", "_cool")).alias("_slice", "_last"))
    )
    freed = packed.join(entries, [*part, "_slice"]).select(*part, F.explode(_replay("_marks", "_last", "_cool")).alias("_t"))
    chosen = rows.join(freed, [*part, "_t"])
    first = chosen.groupBy(*part, "_t").agg(F.min_by(F.struct(*df.columns), F.col(tie)).alias("_row")).select("_row.*")
    return first.unionByName(df.filter(flag)) if forced else first


def thin(df: DataFrame, keys: Sequence[str], cool_us: int, t: str = "t_us", tie: str = "event_id") -> DataFrame:
    """``cooldown`` for tables in which most rows stand alone.

    A row without a neighbour closer than ``cool`` is kept whatever happened before and changes
    nothing after, so only crowded rows go through the fold.
    """
    span = cool_us * 16
    near_end = F.pmod(F.col(t), F.lit(span)) >= F.lit(span - cool_us)
    near_start = F.pmod(F.col(t), F.lit(span)) < F.lit(cool_us)
    home = F.col("_home")
    seats = F.array_compact(F.array(home, F.when(near_end, home + 1), F.when(near_start, home - 1)))
    made = _whole(keys)
    rows = df.withColumns(made | {"_home": slot_of(t, span)}).withColumn("_slot", F.explode(seats))
    order = Window.partitionBy(*made, "_slot").orderBy(t, tie)
    before, after = F.lag(t).over(order), F.lead(t).over(order)
    alone = (before.isNull() | (F.col(t) - before >= cool_us)) & (after.isNull() | (after - F.col(t) >= cool_us))
    own = rows.withColumn("_alone", alone).filter(F.col("_home") == F.col("_slot"))
    single = own.filter("_alone").select(*df.columns)
    return single.unionByName(cooldown(own.filter("not _alone").select(*df.columns), keys, cool_us, t, tie))
