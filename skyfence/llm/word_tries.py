"""Double-array tries over words, walked from all positions of a text at once."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 128  # places tried at once


class DoubleArray:
    """Phrases as paths of words. A state is a slot; the child of slot s by word code c is slot base[s] + c if check there is s.

    ``words``: the words of the phrases, in the order of their codes. ``slots``: where each phrase given ends.
    """

    def __init__(self, words: pa.Array, base: np.ndarray, check: np.ndarray):
        self.words, self.base, self.check, self.slots = words, base, check, np.empty(0, np.int64)

    @classmethod
    def of(cls, phrases: list[list[bytes]]) -> DoubleArray:
        flat, ends = [w for p in phrases for w in p], np.cumsum([0] + [len(p) for p in phrases])
        all_words = pa.array(flat, pa.large_binary())
        counted = all_words.value_counts()
        order = pc.sort_indices(counted.field("counts"), sort_keys=[("", "descending")]) if len(flat) else pa.array([], pa.int64())
        words = counted.field("values").take(order)
        codes = pc.index_in(all_words, value_set=words).to_numpy(zero_copy_only=False).astype(np.int64)
        depth = max(map(len, phrases), default=0)
        size = np.diff(ends)
        # Nodes, level by level: distinct (parent, code). Node 0 is the root.
        node, parents, labels, count = np.zeros(len(phrases), np.int64), [np.array([-1])], [np.array([-1])], 1
        for level in range(depth):
            deep = np.flatnonzero(size > level)
            keys, inverse = np.unique(node[deep] * len(words) + codes[ends[deep] + level], return_inverse=True)
            parents.append(keys // len(words))
            labels.append(keys % len(words))
            node[deep] = count + inverse
            count += len(keys)
        parent, label = np.concatenate(parents), np.concatenate(labels)
        base = cls._placed(parent, label, count, len(words))
        slot = np.zeros(count, np.int64)
        slot[1:] = base[parent[1:]] + label[1:]
        out_base = np.zeros(int(slot.max()) + 1, np.int64)
        check = np.full(len(out_base), -1, np.int64)
        out_base[slot] = base
        check[slot[1:]] = slot[parent[1:]]
        trie = cls(words, out_base, check)
        trie.slots = slot[node]
        return trie

    @staticmethod
    def _placed(parent: np.ndarray, label: np.ndarray, count: int, words: int) -> np.ndarray:
        """A base for every node with children: many children first; nodes with one child fill the gaps at last."""
        base = np.zeros(count, np.int64)
        by_parent = np.argsort(parent[1:], kind="stable") + 1
        owners, first, fan = np.unique(parent[by_parent], return_index=True, return_counts=True)
        used = np.zeros(2 * count + words + 2, bool)
        used[0] = True
        low = 1
        for i in np.argsort(-fan, kind="stable"):
            if fan[i] == 1:
                break
            codes = np.sort(label[by_parent[first[i]:first[i] + fan[i]]])
            steps, at = codes - codes[0], low
            while True:
                if at + BLOCK + steps[-1] >= len(used):
                    used = np.append(used, np.zeros(len(used) + steps[-1] + BLOCK, bool))
                free = at + np.flatnonzero(~used[at:at + BLOCK])
                fits = free[~used[free[:, None] + steps].any(axis=1)] if len(free) else free
                if len(fits):
                    used[fits[0] + steps] = True
                    base[owners[i]] = fits[0] - codes[0]
                    break
                at += BLOCK
            low = at  # crowded blocks are left to the nodes with one child
        single = np.flatnonzero(fan == 1)
        gaps = np.flatnonzero(~used)
        if len(gaps) < len(single):
            gaps = np.append(gaps, np.arange(len(used), len(used) + len(single)))
        base[owners[single]] = gaps[:len(single)] - label[by_parent[first[single]]]
        return base

    def counts(self, words: pa.Array, codes: np.ndarray, pieces: np.ndarray, starts: np.ndarray | None = None, times: np.ndarray | None = None) -> np.ndarray:
        """How often a path from some position of the text reaches each slot; ``codes`` index ``words``, paths stay in a piece.

        With ``starts``: from these positions only, each counted ``times``.
        """
        mine = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
        out = np.zeros(len(self.base), np.int64)
        at = np.arange(len(mine)) if starts is None else starts
        times = None if times is None else times[mine[at] >= 0]
        at = at[mine[at] >= 0]
        state, start = np.zeros(len(at), np.int64), at
        while len(at):
            nxt = self.base[state].astype(np.int64) + mine[at]
            real = (nxt >= 0) & (nxt < len(self.base))
            real[real] = self.check[nxt[real]] == state[real]
            state, at, start = nxt[real], at[real] + 1, start[real]
            times = None if times is None else times[real]
            out += np.bincount(state, times, minlength=len(out)).astype(np.int64)
            on = at < len(mine)
            on[on] = (pieces[at[on]] == pieces[start[on]]) & (mine[at[on]] >= 0)
            state, at, start = state[on], at[on], start[on]
            times = None if times is None else times[on]
        return out

    def pack(self) -> bytes:
        sink = io.BytesIO()
        lengths = pc.binary_length(self.words).to_numpy(zero_copy_only=False).astype(np.int32)
        joined = np.frombuffer(b"".join(self.words.to_pylist()), np.uint8)
        np.savez(sink, base=self.base.astype(np.int32), check=self.check.astype(np.int32), lengths=lengths, joined=joined)
        return sink.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> DoubleArray:
        z = np.load(io.BytesIO(data))
        places = np.append(0, np.cumsum(z["lengths"], dtype=np.int64))
        words = pa.Array.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(z["joined"])])
        return cls(words, z["base"], z["check"])
