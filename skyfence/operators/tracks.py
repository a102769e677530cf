"""Constant-velocity filter over tracks, as a prefix over slices of any number.

A step of the filter, and any run of steps, is an element of five 2 x 2 matrices (A, b, C, eta, J): the state
after it has mean ``A M (m + P eta) + b`` and covariance ``A M P A' + C`` with ``M = (I + P J)^-1``, when it
was (m, P) before. Elements compose associatively (Särkkä and García-Fernández, 2021), so a track is cut into
slices by row number, each slice is summed up in one element, and every slice then starts from the
composition of those before it. Both axes share A, C and J; the columns of b and eta are the axes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfence.operators.timeline import US, running, slot_of
from skyfence.session import shared_dir

TRACK_DDL = "bssid string, t_us bigint, x_m double, y_m double, x_s double, y_s double, vx double, vy double, uncertainty double"
NOISE, ERROR, START = 0.1, 1.0, 10.0
EYE = np.eye(2)


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Element of ``first`` followed by ``then``; both of shape (n, 5, 2, 2)."""
    a1, b1, c1, e1, j1 = np.moveaxis(first, 1, 0)
    a2, b2, c2, e2, j2 = np.moveaxis(then, 1, 0)
    forth = a2 @ np.linalg.inv(EYE + c1 @ j2)
    back = a1.transpose(0, 2, 1) @ np.linalg.inv(EYE + j2 @ c1)
    return np.stack([
        forth @ a1, forth @ (b1 + c1 @ e2) + b2, forth @ c1 @ a2.transpose(0, 2, 1) + c2, back @ (e2 - j2 @ b1) + e1, back @ j2 @ a1 + j1,
    ], axis=1)


def steps(seconds: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Elements of measurements, each ``seconds`` after the one before; NaN starts a track at its measurement."""
    out = np.zeros((len(x), 5, 2, 2))
    first = np.isnan(seconds)
    dt, seen = np.where(first, 0.0, seconds), np.stack([x, y], axis=1)
    gain, share = NOISE / (NOISE + ERROR), 1.0 / (NOISE + ERROR)
    out[:, 0] = EYE
    out[:, 0, 0, 1] = dt
    out[:, 0, 0] *= 1.0 - gain
    out[:, 1, 0] = gain * seen
    out[:, 2] = np.diag([NOISE * (1.0 - gain), NOISE])
    sight = np.stack([np.ones_like(dt), dt], axis=1)
    out[:, 3] = share * sight[:, :, None] * seen[:, None, :]
    out[:, 4] = share * sight[:, :, None] * sight[:, None, :]
    out[first] = 0.0
    out[first, 1, 0] = seen[first]
    out[first, 2] = EYE * START
    return out


def prefixes(elements: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Composition of all elements from the last head up to each one, by doubling spans."""
    out, done, span = elements.copy(), heads.copy(), 1
    done[:1] = True
    while not done.all():
        todo = np.flatnonzero(~done)
        out[todo], done[todo] = compose(out[todo - span], out[todo]), done[todo - span]
        span *= 2
    return out


def _scan(batches: Iterator[pd.DataFrame], keys: list[str], element) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches of sorted rows with the composition of each row's elements since its key began."""
    key, carry = None, None
    for pdf in batches:
        if not len(pdf):
            continue
        now = list(pdf[keys].itertuples(index=False, name=None))
        heads = np.array([a != b for a, b in zip(now, [key, *now])])
        elements = element(pdf)
        if not heads[0]:
            elements[:1] = compose(carry, elements[:1])
        out = prefixes(elements, heads)
        key, carry = now[-1], out[-1:]
        yield pdf, out


def _unpack(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(-1, 5, 2, 2)


def _measured(pdf: pd.DataFrame) -> np.ndarray:
    return steps(((pdf["t_us"] - pdf["_before"]) / US).to_numpy(float), pdf["x_m"].to_numpy(float), pdf["y_m"].to_numpy(float))


def smooth_tracks(track: DataFrame, slice_rows: int = 4096) -> DataFrame:
    """Filtered track per address from (bssid, t_us, x_m, y_m); rows of one time follow each other by place.

    Rows without address, time or place are left out. A task holds one Arrow batch and one element, however
    long a track is; between slices go 20 numbers each.
    """
    place = track.select("bssid", "t_us", "x_m", "y_m").dropna()
    path = shared_dir(place.sparkSession, "track")
    place.withColumn("_tie", F.struct("x_m", "y_m")).write.parquet(path)  # read several times, and estimates are not cheap
    place = place.sparkSession.read.parquet(path)
    rows = running(place, ["bssid"], {"_n": ("count", F.lit(1)), "_before": ("last", F.col("t_us"))}, tie="_tie").withColumn("_slice", slot_of("_n", slice_rows))
    rows = rows.select("bssid", "t_us", "x_m", "y_m", "_n", "_before", "_slice")
    keys = ["bssid", "_slice"]

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, upto in _scan(batches, keys, _measured):
            last = ~pdf.duplicated(keys, keep="last").to_numpy()
            yield pdf.loc[last, [*keys, "_n"]].assign(element=list(upto[last].reshape(-1, 20)))

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, upto in _scan(batches, ["bssid"], lambda pdf: _unpack(pdf["element"])):
            yield pd.DataFrame({"bssid": pdf["bssid"], "_slice": pdf["_slice"] + 1, "element": list(upto.reshape(-1, 20))})

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def started(pdf: pd.DataFrame) -> np.ndarray:
            out, begins = _measured(pdf), ((pdf["_n"] % slice_rows == 0) & pdf["element"].notna()).to_numpy()
            if begins.any():
                out[begins] = compose(_unpack(pdf.loc[begins, "element"]), out[begins])
            return out

        for pdf, upto in _scan(batches, keys, started):
            mean, spread = upto[:, 1], upto[:, 2, 0, 0]
            yield pdf[["bssid", "t_us", "x_m", "y_m"]].assign(
                x_s=mean[:, 0, 0], y_s=mean[:, 0, 1], vx=mean[:, 1, 0], vy=mean[:, 1, 1], uncertainty=np.sqrt(np.where(pdf["_n"] == 0, spread, 2 * spread)),
            )

    full = rows.repartition(*keys).sortWithinPartitions(*keys, "_n")
    parts = full.mapInPandas(summarise, "bssid string, _slice bigint, _n bigint, element array<double>")
    parts = parts.groupBy(*keys).agg(F.max_by("element", "_n").alias("element"))
    heads = parts.repartition("bssid").sortWithinPartitions(*keys).mapInPandas(chain, "bssid string, _slice bigint, element array<double>")
    return rows.join(heads, keys, "left").repartition(*keys).sortWithinPartitions(*keys, "_n").mapInPandas(replay, TRACK_DDL)
