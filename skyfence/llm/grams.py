"""Words of whole Arrow columns as numbers, without a Python step per word; 64-bit keys of words and word sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def lowered_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code of every word, row of every word, and the 64-bit key of every code.

    A-Z are lowered; words are what ASCII white space (space, \\t to \\r) separates. Null counts as empty.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, row = lists.flatten(), pc.list_parent_indices(lists)
    real = pc.not_equal(flat, "")
    words = flat.filter(real).dictionary_encode()
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    keys = np.fromiter(map(xxhash.xxh64_intdigest, words.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(words.dictionary))
    return words.indices.to_numpy(zero_copy_only=False).astype(np.int64), row.filter(real).to_numpy(zero_copy_only=False).astype(np.int64), keys


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A key of the pair (a, b) of keys, in that order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + ((b << np.uint64(31)) | (b >> np.uint64(33)))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte in planes: the upper planes are zeros and shuffle compression removes them."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64), dtype=np.uint64)
