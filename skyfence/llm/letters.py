"""Runs of wanted bytes in whole Arrow text columns, found at once on the columns' buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Byte values with A-Z lowered.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, one text behind the other, and where each text begins (and the end). Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, places, data = texts.buffers()
    places = np.frombuffer(places, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[places[0]:places[-1]], places - places[0]


def runs(data: np.ndarray, places: np.ndarray, wanted: np.ndarray, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Maximal runs of wanted bytes within a text, A-Z lowered or not, as a binary array; the place of each run's first byte."""
    begins = wanted.copy()
    begins[1:] &= ~wanted[:-1]
    heads = places[:-1][places[:-1] < len(data)]
    begins[heads] = wanted[heads]
    at = np.flatnonzero(begins)
    kept = LOWER[data[wanted]] if lower else data[wanted]
    # Behind a run lies an unwanted byte, the next text or the end.
    begins[:-1] = ~wanted[1:] | begins[1:]
    begins[-1:] = True
    ends = np.append(0, np.cumsum(np.flatnonzero(begins & wanted) + 1 - at))
    return pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(kept)]), at


def rows_of(at: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The text that each place lies in."""
    return np.searchsorted(places, at, "right") - 1


def encoded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Code of every value, and the distinct values."""
    d = values.dictionary_encode()
    if isinstance(d, pa.ChunkedArray):
        d = d.combine_chunks()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of a first member, size) of every distinct combination of keys."""
    if len(keys[0]) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order)))


def ranked(values: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place of each value among them; all lie in [0, below)."""
    if below > 4 * len(values) + 1024:
        return np.unique(values, return_inverse=True)
    there = np.zeros(below, bool)
    there[values] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[values]
