"""Exact Jaccard self-join of n-gram sets by prefix tree, and the groups its links make.

1. One pass turns each whole text into its set of 64-bit shingle keys, of which it keeps the size, a 128-bit signature and a
   sketch: one bit a place, turned over by every key that falls there. Equal sets are one from here on.
2. Two sets that reach the threshold differ in at most d keys, which follows from their sizes. The keys' values are cut into more
   than d parts, so the two agree in all keys of some part. A second pass sums up every part of every set; a set whose sums no
   other set has stands alone, by proof. Numbers alone travel, about a quarter of the keys at a threshold of 90 %.
3. Sets that meet in few at a part are paired. Sketches of sets that differ in d keys differ in at most d bits: pairs with more are
   none. Where many meet at a part (a common phrase), each is paired with the smallest first, and the part's sets are compared
   all with all, by blocks, unless they are connected by then. Parts that share sets are not merged, so common phrases chain
   nothing. What is left are groups nearly as alike as asked, however many texts the corpus has; only their texts are read again.
4. A group's sets are stored in a prefix tree in the order of their keys' frequency in the group. Traversing it, a probing set
   shares the overlap counted so far with all sets below, and leaves subtrees which by the remaining lengths cannot reach the
   threshold, or whose sets it is already linked with. Groups of more than ``block`` sets are cut into blocks by a hash, and each
   pair of blocks is a task of its own; no pair of sets is left out.
5. Each task gives the links that connect its sets; their connected components are the answer.

Rows: a text of null or without words has an empty set and is linked with nothing. Texts with fewer words than a shingle have
one shingle, the whole sequence. Rows with one doc_id but different texts are judged each by its own text; rows whose doc_id is null are
linked with nothing and have no component. Ids of any type that has an order will do. Extra columns are not read; ``one_of_each`` keeps
them, whatever their names.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfence.llm.common import all_columns, by_bytes, free_name, give_back, lean, stored
from skyfence.llm.grams import lowered_words, mixed
from skyfence.llm.links import components

#: Sets that meet in more than so many at a part are compared by blocks, not in pairs.
FEW = 16
#: Narrow rows (at most five numbers each) that may be broadcast to meet texts or keys; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 500_000
_SALT, _NONE = np.uint64(0x9FB21C651E98DF25), np.uint64(0x3C79AC492BA7B653)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct shingles per text, and their keys, sorted within each text."""
    codes, row, words = lowered_words(texts)
    per_row = np.bincount(row, minlength=len(texts))
    keys = words[codes]
    inside = np.flatnonzero(row[size - 1 :] == row[: len(row) - size + 1]) if len(row) >= size else np.zeros(0, np.int64)
    value = keys[inside]
    for k in range(1, size):
        value = mixed(value, keys[inside + k])
    own = row[inside]
    ends = np.cumsum(per_row)
    for n in range(1, size):  # texts shorter than a shingle
        few = np.flatnonzero(per_row == n)
        first = ends[few] - n
        whole = np.full(len(few), n, np.uint64)
        for k in range(n):
            whole = mixed(whole, keys[first + k])
        value, own = np.concatenate([value, whole]), np.concatenate([own, few])
    by = np.lexsort((value, own))
    value, own = value[by], own[by]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
    return np.bincount(own[new], minlength=len(texts)), value[new]


def signatures(counts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that depend on the set alone."""
    ends = np.cumsum(counts)
    out = []
    for salt in (0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(keys, np.full(len(keys), salt, np.uint64)), dtype=np.uint64)])
        out.append((sums[ends] - sums[ends - counts]).view(np.int64))
    return out[0], out[1]


def set_numbers(counts: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
    """The number that each set goes by, as a document id may have several texts."""
    return mixed(mixed(s1.view(np.uint64), s2.view(np.uint64)), counts.astype(np.uint64)).view(np.int64)


def sketches(counts: np.ndarray, keys: np.ndarray) -> pa.Array:
    """A bit a place for about as many places as a set has keys or twice that (a power of two): whether an odd number of keys falls there."""
    width = 64 << np.ceil(np.log2(np.maximum(counts, 64) / 64)).astype(np.int64)
    places = np.append(0, np.cumsum(width))
    bit = np.repeat(places[:-1], counts) + (keys & np.repeat(width - 1, counts).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(bit, minlength=places[-1]) & 1).astype(np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(places // 8), pa.py_buffer(np.packbits(odd, bitorder="little"))]).cast(pa.binary())


def most_apart(n: np.ndarray | int, m: np.ndarray | int, per_cent: int):
    """In how many keys sets of n and m keys that reach the threshold may differ."""
    return (n + m) * (100 - per_cent) // (100 + per_cent)


def cut(label: int, per_cent: int) -> tuple[int, int]:
    """(d, spare) for the sets of size band ``label`` and of that below: d: in how many keys two of them may differ; d + 1 + spare parts."""
    largest = math.floor((100 / per_cent) ** (label + 1) + 1e-6)
    d = most_apart(largest, largest, per_cent)
    return d, math.ceil(2 * (d + 1) * math.exp(-largest * per_cent * per_cent / 1e4 / (d + 1))) + 1


def part_sums(counts: np.ndarray, keys: np.ndarray, per_cent: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, sum) of the parts of each set: sets within the threshold have one in common.

    At least spare + 1 parts of two such sets agree. So parts without any key count only where a set has more than ``spare`` of them.
    """
    band = np.floor(np.log(np.maximum(counts, 1)) / math.log(100 / per_cent) + 1e-9).astype(np.int64)
    upper, sums, own, out = keys >> np.uint64(32), mixed(keys, np.full(len(keys), _SALT)), np.repeat(np.arange(len(counts)), counts), []
    for label in (band, band + 1):
        distinct, at = np.unique(label, return_inverse=True)
        d, spare = (np.array(x)[at] for x in zip(*(cut(int(x), per_cent) for x in distinct))) if len(distinct) else (label, label)
        d = np.where(counts > 0, d, 0)
        parts = np.where(d > 0, d + 1 + spare, 0)  # sets that may not differ at all are equal or alone
        part = (upper * np.repeat(parts, counts).astype(np.uint64)) >> np.uint64(32)
        new = np.ones(len(keys), bool)
        new[1:] = (part[1:] != part[:-1]) | (own[1:] != own[:-1])
        first = np.flatnonzero(new)
        name = lambda of, which, label=label: (label[of] << 32).astype(np.uint64) + which
        if len(first):
            total = mixed(np.add.reduceat(sums, first), name(own[first], part[first]))
            real = parts[own[first]] > 0
            out.append((own[first][real], total[real]))
        full = np.bincount(own[first], minlength=len(counts))
        for i in np.flatnonzero(parts - full > np.where(parts > 0, spare, parts)):
            empty = np.setdiff1d(np.arange(parts[i], dtype=np.uint64), part[first[own[first] == i]] if full[i] else part[:0])
            out.append((np.full(len(empty), i), mixed(np.full(len(empty), _NONE), name(np.full(len(empty), i), empty))))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def document_sets(docs: DataFrame, size: int, full: bool) -> DataFrame:
    """doc_id, h (hash of the text), n, s1, s2, rep (number of the set), sketch; with ``full`` its keys, sorted, instead of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                counts, keys = shingle_sets(part.column("text"), size)
                s1, s2 = signatures(counts, keys)
                last = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(keys.view(np.int64))) if full else sketches(counts, keys)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(counts, pa.int64()), pa.array(s1), pa.array(s2), pa.array(set_numbers(counts, s1, s2)), last], ["doc_id", "h", "n", "s1", "s2", "rep", "keys" if full else "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), text_hash().alias("h")).mapInArrow(
        lean(run), f"doc_id {kind}, h bigint, n bigint, s1 bigint, s2 bigint, rep bigint, " + ("keys array<bigint>" if full else "sketch binary"))


def part_rows(docs: DataFrame, size: int, per_cent: int) -> DataFrame:
    """part, rep: the sums of all parts of every document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in by_bytes(batch, "text"):
                counts, keys = shingle_sets(texts.column("text"), size)
                own, total = part_sums(counts, keys, per_cent)
                yield pa.RecordBatch.from_arrays([pa.array(total.view(np.int64)), pa.array(set_numbers(counts, *signatures(counts, keys))[own])], ["part", "rep"])

    return docs.where("doc_id is not null").select(F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "part bigint, rep bigint")


def meetings(rows: DataFrame) -> DataFrame:
    """a, b, part: pairs of sets with a part in common; where more than FEW sets have it, each with the smallest of them and ``part`` (else null)."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        part, rep = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            part, rep = np.append(part, batch.column(0).to_numpy()), np.append(rep, batch.column(1).to_numpy())
            new = np.ones(len(part), bool)
            new[1:] = (part[1:] != part[:-1]) | (rep[1:] != rep[:-1])
            part, rep = part[new], rep[new]
            yield part, rep
            last = int(np.searchsorted(part, part[-1])) if len(part) else 0
            # Of a part that goes on, FEW + 1 sets are enough to know that it has many, and the smallest.
            keep = np.r_[last : min(last + FEW + 1, len(part))]
            if len(part) > last + FEW + 1:
                keep = np.append(keep, len(part) - 1)
            part, rep = part[keep], rep[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rep in runs(batches):
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.empty(0, np.int64)
            size = np.repeat(np.diff(np.append(first, len(part))), np.diff(np.append(first, len(part))))
            part, rep, size = part[size > 1], rep[size > 1], size[size > 1]  # most parts are one set's own
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.empty(0, np.int64)
            many, least = size > FEW, np.repeat(first, np.diff(np.append(first, len(part))))
            star = np.flatnonzero(many & (least != np.arange(len(part))))
            found = [(rep[least[star]], rep[star], part[star])]
            for k in range(1, FEW):
                i = np.flatnonzero((part[k:] == part[:-k]) & ~many[k:]) if len(part) > k else np.empty(0, np.int64)
                found.append((rep[i], rep[i + k], None))
            for a, b, often in found:
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64()) if often is None else pa.array(often)], ["a", "b", "part"])

    return rows.repartition("part").sortWithinPartitions("part", "rep").mapInArrow(run, "a bigint, b bigint, part bigint")


class Sketches:
    """Sketches of an Arrow column, as words of 64 bits."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_binary())
        _, places, data = column.buffers()
        places = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
        self.words = np.frombuffer(data, np.uint64, len(data) // 8) if data is not None else np.empty(0, np.uint64)
        self.first, self.width = places[:-1] // 8, np.diff(places) // 8

    def of(self, at: np.ndarray, width: int) -> np.ndarray:
        """Sketches of one width, folded to ``width`` words."""
        own = int(self.width[at[0]])
        found = self.words[self.first[at][:, None] + np.arange(own)]
        while own > width:
            own //= 2
            found = found[:, :own] ^ found[:, own:]
        return found


def may_reach(a: Sketches, b: Sketches, n: np.ndarray, m: np.ndarray, per_cent: int) -> np.ndarray:
    """Which of the pairs of sets with these sketches and sizes may reach the threshold."""
    out = np.zeros(len(n), bool)
    fit = np.flatnonzero(100 * np.minimum(n, m) >= per_cent * np.maximum(n, m))
    kinds, kind = np.unique(np.stack([a.width[fit], b.width[fit]]), axis=1, return_inverse=True)
    for k, (v, w) in enumerate(kinds.T):
        at = fit[kind.ravel() == k]
        apart = np.bitwise_count(a.of(at, min(v, w)) ^ b.of(at, min(v, w))).sum(axis=1, dtype=np.int64)
        out[at] = apart <= most_apart(n[at], m[at], per_cent)
    return out


def sketch_links(n: np.ndarray, column: pa.Array, per_cent: int) -> list[tuple[int, int]]:
    """Links between positions that connect all sets which are connected by pairs that may reach the threshold."""
    found = Sketches(column)
    classes = {}
    for w in np.unique(found.width).tolist():
        at = np.flatnonzero(found.width == w)
        at = at[np.argsort(n[at], kind="stable")]
        classes[w] = (at, n[at], found.of(at, w), found.of(at, w // 2) if w > 1 else None, np.ones(len(at), bool))
    spot = np.empty(len(n), np.int64)
    for at, *_ in classes.values():
        spot[at] = np.arange(len(at))
    out: list[tuple[int, int]] = []
    for start in np.argsort(n, kind="stable").tolist():
        if not classes[int(found.width[start])][4][spot[start]]:
            continue
        classes[int(found.width[start])][4][spot[start]] = False
        open_ = [start]
        while open_:
            me = open_.pop()
            w, size = int(found.width[me]), int(n[me])
            _, _, plain, folded, _ = classes[w]
            for v in (w // 2, w, 2 * w):
                if v not in classes:
                    continue
                at, sizes, whole, half, alone = classes[v]
                low, high = np.searchsorted(sizes, -(-per_cent * size // 100)), np.searchsorted(sizes, 100 * size // per_cent, "right")
                near = low + np.flatnonzero(alone[low:high])
                if not len(near):
                    continue
                mine = (folded if v < w else plain)[spot[me]]
                apart = np.bitwise_count((half if v > w else whole)[near] ^ mine).sum(axis=1, dtype=np.int64)
                near = near[apart <= most_apart(size, sizes[near], per_cent)]
                alone[near] = False
                out += [(me, x) for x in at[near].tolist()]
                open_ += at[near].tolist()
    return out


class Node:
    __slots__ = ("edge", "children", "here", "least", "most", "some", "one")

    def __init__(self, edge: list[int]):
        self.edge, self.children = edge, {}
        self.here: list[tuple[int, int]] = []  # (set, size) ending here
        self.least, self.most = math.inf, 0
        self.some, self.one = -1, True  # a set below, and whether all below were linked when they came


class PrefixTree:
    """Sets as sorted rank lists; ``link`` finds those within the threshold, per cent, of a probing one."""

    def __init__(self, per_cent: int, root_of):
        self.root, self.per_cent, self.root_of = Node([]), per_cent, root_of

    def enough(self, overlap: int, n: int, m: int) -> bool:
        return (100 + self.per_cent) * overlap >= self.per_cent * (n + m)

    def link(self, me: int, ranks: list[int], found) -> None:
        """Call found(set) for sets that reach the threshold and are not yet linked with ``me``."""
        n, own = len(ranks), set(ranks)
        stack = [(self.root, 0, 0)]
        while stack:
            node, overlap, depth = stack.pop()
            if node.some >= 0 and node.one and self.root_of(node.some) == self.root_of(me):
                continue
            overlap += len(own.intersection(node.edge))
            depth += len(node.edge)
            rest = n - bisect_right(ranks, node.edge[-1]) if node.edge else n
            best = min(max(depth + rest, node.least), node.most)  # the size below for which most can still be shared
            if not self.enough(overlap + min(best - depth, rest), n, best):
                continue
            for other, m in node.here:
                if self.enough(overlap, n, m) and self.root_of(other) != self.root_of(me):
                    found(other)
            stack += [(child, overlap, depth) for child in node.children.values()]

    def add(self, me: int, ranks: list[int]) -> None:
        node, at, size = self.root, 0, len(ranks)
        while True:
            node.least, node.most = min(node.least, size), max(node.most, size)
            if node.some < 0:
                node.some = me
            elif node.one and self.root_of(node.some) != self.root_of(me):
                node.one = False
            if at == size:
                node.here.append((me, size))
                return
            child = node.children.get(ranks[at])
            if child is None:
                child = node.children[ranks[at]] = Node(ranks[at:])
            else:
                same = 0
                while same < len(child.edge) and at + same < size and child.edge[same] == ranks[at + same]:
                    same += 1
                if same < len(child.edge):  # cut the edge
                    upper = Node(child.edge[:same])
                    upper.least, upper.most, upper.some, upper.one = child.least, child.most, child.some, child.one
                    child.edge = child.edge[same:]
                    upper.children[child.edge[0]] = child
                    node.children[ranks[at]] = child = upper
            at += len(child.edge)
            node = child


def tree_links(sets: list[np.ndarray], per_cent: int) -> list[tuple[int, int]]:
    """Links between positions of ``sets`` that connect all sets which are connected by pairs within the threshold."""
    times = Counter(k for s in sets for k in s.tolist())
    rank = {k: i for i, (k, _) in enumerate(sorted(times.items(), key=lambda x: (-x[1], x[0])))}
    parent = list(range(len(sets)))

    def root_of(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    out: list[tuple[int, int]] = []
    tree = PrefixTree(per_cent, root_of)
    for me in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        ranks = sorted(map(rank.__getitem__, sets[me].tolist()))

        def found(other: int, me: int = me) -> None:
            out.append((me, other))
            parent[root_of(me)] = root_of(other)

        tree.link(me, ranks, found)
        tree.add(me, ranks)
    return out


def small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it is counted to be small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def blocked(groups: DataFrame, block: int) -> DataFrame:
    """rep, root, i, j: a group's sets (node, root) in blocks of about ``block``, each set once for every pair of blocks (i, j) that it belongs to."""
    sizes = groups.groupBy("root").agg(F.count("*").alias("members"))
    placed = groups.join(sizes, "root").select(F.col("node").alias("rep"), "root", F.ceil(F.col("members") / block).alias("blocks"))
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("mine")
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")
    placed = placed.select("rep", "root", mine, "blocks").select("rep", "root", "mine", other)
    return placed.select("rep", "root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))


def near_sets(docs: DataFrame, some: DataFrame, size: int, per_cent: int, block: int) -> DataFrame:
    """(node, root) of groups of sets that hold all pairs within the threshold; ``some``: the sets with their sketches."""
    met = stored(meetings(part_rows(docs, size, per_cent)), "met-sets")
    nodes = stored(met.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "met-nodes")
    sketch = stored(some.select("rep", "n", "sketch").join(small(nodes), "rep", "left_semi").dropDuplicates(["rep"]), "met-sketches")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            n, m = t.column("n").to_numpy(), t.column("m").to_numpy()
            yield t.filter(pa.array(may_reach(Sketches(t.column("x")), Sketches(t.column("y")), n, m, per_cent))).select(["a", "b"])

    def linked(t: pa.Table) -> pa.Table:
        rep = t.column("rep").to_numpy()
        found = sketch_links(t.column("n").to_numpy(), t.column("sketch"), per_cent)
        return pa.table({"a": pa.array([rep[i] for i, _ in found], pa.int64()), "b": pa.array([rep[j] for _, j in found], pa.int64())})

    pairs = met.select("a", "b").distinct()
    pairs = pairs.join(sketch.select(F.col("rep").alias("a"), "n", F.col("sketch").alias("x")), "a").join(sketch.select(F.col("rep").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y")), "b")
    alike = components(pairs.select("a", "b", "n", "m", "x", "y").mapInArrow(close, "a bigint, b bigint"))
    # Where many meet, only parts whose sets are not all connected yet are looked at in full.
    crowd = met.where("part is not null")
    crowd = crowd.select("part", F.col("a").alias("rep")).unionByName(crowd.select("part", F.col("b").alias("rep"))).distinct()
    crowd = stored(crowd.join(alike.withColumnRenamed("node", "rep"), "rep", "left").select("part", "rep", F.coalesce("root", "rep").alias("root")), "met-crowds")
    mixed_ones = crowd.groupBy("part").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("part")
    crowd = crowd.join(mixed_ones, "part", "left_semi").select(F.col("rep").alias("node"), F.col("part").alias("root"))
    crowd = blocked(crowd, 4 * block).join(sketch, "rep").select("root", "i", "j", "rep", "n", "sketch")
    return components(alike.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(crowd.groupBy("root", "i", "j").applyInArrow(linked, "a bigint, b bigint")))


def jaccard_groups(docs: DataFrame, size: int = 3, per_cent: int = 90, block: int = 2000) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    return grouped_rows(docs, size, per_cent, block).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def grouped_rows(docs: DataFrame, size: int, per_cent: int, block: int = 2000) -> DataFrame:
    """doc_id, h (hash of the text), n, s1, s2, component_id and ``root``, which names the component: one id may have texts in several."""
    every = stored(document_sets(docs, size, full=False), "shingle-sets")
    some = every.where("n > 0 and doc_id is not null")

    # From here on a set goes by a number of its own, as a document id may have several texts.
    sets = stored(some.groupBy("rep", "s1", "s2", "n").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "distinct-sets")
    groups = near_sets(docs, some, size, per_cent, block)
    placed = stored(blocked(groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct()), block), "placed-sets")
    left = stored(sets.select("rep", "first").join(placed.select("rep").distinct(), "rep", "left_semi"), "open-sets")
    picked = docs.select("doc_id", "text").join(small(left.select(F.col("first").alias("doc_id")).distinct()), "doc_id", "left_semi")
    full = document_sets(picked, size, full=True).select(F.col("doc_id").alias("first"), "rep", "keys").join(small(left), ["first", "rep"])
    kept = stored(full.select("rep", "keys"), "open-keys")
    rows = kept.join(small(placed), "rep").select("root", "i", "j", "rep", "keys")

    def run(t: pa.Table) -> pa.Table:
        rep, keys = t.column("rep").to_numpy(), t.column("keys").combine_chunks()
        found = tree_links([keys[i].values.to_numpy() for i in range(len(keys))], per_cent)
        if len(keys.values) > 200_000:
            give_back()
        return pa.table({"a": pa.array([rep[i] for i, _ in found], pa.int64()), "b": pa.array([rep[j] for _, j in found], pa.int64())})

    linked = components(rows.groupBy("root", "i", "j").applyInArrow(run, "a bigint, b bigint"))
    linked = linked.select(F.col("node").alias("rep"), "root")
    members = stored(sets.select("rep", "first", "s1", "s2", "n", "copies").join(linked, "rep", "left").withColumn("root", F.coalesce("root", "rep")), "set-roots")
    least = members.join(linked.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("first").alias("least"))
    names = members.join(least, "root", "left").where("least is not null or copies > 1").select("s1", "s2", "n", "root", F.coalesce("least", "first").alias("least"))
    out = every.select("doc_id", "h", "n", "s1", "s2", "rep").join(names, ["s1", "s2", "n"], "left")
    known = F.col("doc_id").isNotNull()
    root = F.when(known & (F.col("n") > 0), F.coalesce("root", "rep"))
    return out.select("doc_id", "h", "n", "s1", "s2", F.when(known, F.coalesce("least", "doc_id")).alias("component_id"), root.alias("root"))


def one_of_each(docs: DataFrame, size: int = 3, per_cent: int = 90) -> DataFrame:
    """One row of ``docs`` for each group: that of the smallest doc_id, of its texts that with the smallest hash.

    Rows without words stay, but those equal in id and text stay once; rows without an id all stay. An id whose texts are in
    several groups may stand for each of them.
    """
    rows = grouped_rows(docs, size, per_cent).where("doc_id is not null")
    best = rows.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("best")).select("best.*")
    keep = best.unionByName(rows.where("root is null").select("doc_id", "h")).distinct()
    h = free_name(docs, "text_hash")
    kept = docs.withColumn(h, text_hash()).join(keep.withColumnRenamed("h", h), ["doc_id", h], "left_semi").dropDuplicates(["doc_id", h])
    return kept.select(*all_columns(docs)).unionByName(docs.where("doc_id is null").select(*all_columns(docs)))
