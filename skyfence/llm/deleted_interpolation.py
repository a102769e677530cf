"""Text probabilities by deleted interpolation.

The probability of a word after its history mixes maximum-likelihood estimates of all orders, from the longest history down to
the uniform distribution over the vocabulary. The mixture weights depend on how often the history was seen (buckets of the
binary logarithm of its count). They are learned by expectation-maximisation on a part of the training documents that is
deleted from the counts meanwhile; afterwards all training documents count.

How the work is laid out. Documents are dealt into blocks of some megabytes of text by a hash. A block sends each of its
distinct n-grams once, packed by ranges of the 64-bit key, to the range's group; there the counts of all blocks are added and
each block gets back the counts for what it asked, in the same order. So a frequent word costs one number per block, whatever
the number of its occurrences, and neither the vocabulary nor the counts are ever gathered in one place: what one task holds is one
block or one range, whose sizes are parameters. The driver gets two totals and a table of event counts on a fixed grid.

Rows: a text of null counts as empty; an empty text has one token, its end. Repeated documents count each time, also with the
same id. An id of null is in fold 0. Without training documents nothing is known and every score is that of the uniform
distribution over one word (0). Extra columns are not read. Very long texts make their block longer, nothing else.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfence.llm.common import fold, give_back, stored
from skyfence.llm.grams import lowered_words, mixed, pack_keys, unpack_keys

HELD_OUT, KEPT, DELETED = 0, 1, 2
#: Key of the end of a text; a word holds no line break. It also stands before the first word.
END = np.uint64(xxhash.xxh64_intdigest(b"\n"))
#: Buckets of a history's count, and steps per factor of two on the grid of probabilities.
BUCKETS, STEPS = 24, 4
#: Counts up to this are sent in 32 bits; the few beyond stand beside them in 64.
MOST = np.iinfo(np.int32).max
ONE = np.uint64(1)


class Block:
    """N-grams of a block of texts: sorted keys, their counts, and where each token's n-grams stand among the keys."""

    def __init__(self, texts: pa.Array, order: int):
        rows, pads = len(texts), order - 1
        codes, row, words = lowered_words(texts)
        words, end = np.append(words, END), len(words)
        self.tokens = np.bincount(row, minlength=rows) + 1
        padded = self.tokens + pads
        self.start = np.concatenate([[0], np.cumsum(padded)[:-1]]) + pads  # of each text's first token
        line = np.full(int(padded.sum()), end, np.int64)
        line[np.arange(len(codes)) + row * (1 + pads) + pads] = codes
        real = np.ones(len(line), bool)
        for k in range(pads):
            real[self.start - 1 - k] = False
        place = np.arange(len(line)) - np.repeat(self.start - pads, padded)
        keys, counts, at = [words & ~ONE], [np.bincount(line[real], minlength=len(words))], [line]
        history, history_keys = line, words
        for k in range(2, order + 1):
            here = place >= k - 1
            pair = np.zeros(len(line), np.int64)
            pair[1:] = history[:-1] * len(words) + line[1:]
            kinds, which = np.unique(pair[here], return_inverse=True)
            now = np.zeros(len(line), np.int64)
            now[here] = which
            history_keys = mixed(history_keys[kinds // len(words)], words[kinds % len(words)])
            keys.append(history_keys | ONE)
            counts.append(np.bincount(which, minlength=len(kinds)))
            at.append(now)
            history = now
        every, counts = np.concatenate(keys), np.concatenate(counts)
        order_ = np.argsort(every, kind="stable")
        rank = np.empty(len(every), np.int64)
        rank[order_] = np.arange(len(every))
        self.keys, self.counts = every[order_], counts[order_].astype(np.int32)
        base = np.cumsum([0, *map(len, keys)])
        self.where = [rank[base[k] + a] for k, a in enumerate(at)]  # for each order, for each place of the line
        self.real = np.flatnonzero(real)

    def values(self, totals: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each token: counts of its n-grams of order 1, 2, ..., and of their histories (from order 2)."""
        own = [totals[w[self.real]] for w in self.where]
        histories = [totals[w[self.real - 1]] for w in self.where[:-1]]
        return own, histories


def bounds(ranges: int) -> np.ndarray:
    """First keys of equal ranges of the key space, without the first."""
    return np.array([-(-(i << 64) // ranges) for i in range(1, ranges)], np.uint64)


def bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(count + 1.0).astype(np.int64), BUCKETS - 1)


def estimates(own: list[np.ndarray], histories: list[np.ndarray], words: float, kinds: int) -> list[np.ndarray]:
    """Probabilities of order 0 (uniform), 1 and up for each token; 0 after an unseen history."""
    out = [np.full(len(own[0]), 1.0 / (kinds + 1)), own[0] / max(words, 1.0)]
    return out + [c / np.maximum(h, 1) for c, h in zip(own[1:], histories)]


def learn_weights(events: np.ndarray, times: np.ndarray, order: int, steps: int = 60) -> np.ndarray:
    """Weights (bucket x order 0 ... n) from probabilities of events (bucket, p0, p1, ..., pn) and how often each was met."""
    which, p = events[:, 0].astype(int), events[:, 1:]
    weights = np.full((BUCKETS, order + 1), 1.0 / (order + 1))
    for _ in range(steps):
        part = weights[which] * p
        part *= (times / part.sum(1))[:, None]
        weights = np.stack([np.bincount(which, weights=part[:, k], minlength=BUCKETS) for k in range(order + 1)], 1) + 0.5  # half an event each
        weights /= weights.sum(1, keepdims=True)
    return weights


def blocks(docs: DataFrame, kind: Column, size_mb: float) -> tuple[DataFrame, int]:
    """doc_id, kind, text with a block number; blocks hold one kind and about ``size_mb`` of text. Second: blocks in all."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), kind.cast("int").alias("kind"))
    sizes = {r["kind"]: r["n"] for r in rows.groupBy("kind").agg(F.sum(F.octet_length("text") + 8).alias("n")).collect()}
    number = {k: max(1, round(sizes.get(k, 0) / (size_mb * 1e6))) for k in (HELD_OUT, KEPT, DELETED)}
    of = F.when(F.col("kind") == HELD_OUT, number[HELD_OUT]).when(F.col("kind") == KEPT, number[KEPT]).otherwise(number[DELETED])
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), of) * 3 + F.col("kind")), sum(number.values())


def narrow(totals: np.ndarray) -> tuple[bytes, bytes | None]:
    """Counts of 64 bits as int32, and (position, count) of those beyond int32 as pairs of int64, None without any."""
    large = np.flatnonzero(totals > MOST)
    if not len(large):
        return totals.astype(np.int32).tobytes(), None
    return np.minimum(totals, MOST).astype(np.int32).tobytes(), np.stack([large, totals[large]], 1).astype(np.int64).tobytes()


def add_blocks(key: tuple, t: pa.Table) -> pa.Table:
    """Counts of one range of keys, added over all blocks and handed back to each block for its own keys."""
    block = t.column("block").to_pylist()
    keys = [unpack_keys(x) for x in t.column("keys").to_pylist()]
    ends = np.cumsum([0, *map(len, keys)])
    kinds, which = np.unique(np.concatenate(keys), return_inverse=True)
    kept, deleted = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
    for i, (b, c) in enumerate(zip(block, t.column("counts").to_pylist())):
        if b % 3 != HELD_OUT:
            np.add.at(kept if b % 3 == KEPT else deleted, which[ends[i] : ends[i + 1]], np.frombuffer(c, np.int32))
    total, single = kept + deleted, (kinds & ONE) == 0
    stats = (int(total[single].sum()), int((total[single] > 0).sum()), int(kept[single].sum()))
    cell = lambda x, i: narrow(x[which[ends[i] : ends[i + 1]]])
    n = len(block)

    def columns(x: np.ndarray, name: str, of: tuple) -> dict[str, pa.Array]:
        large: dict[int, bytes] = {}

        def one(i: int) -> bytes:
            data, more = cell(x, i)
            if more:
                large[i] = more
            return data

        return {name: pa.array((one(i) if b % 3 in of else None for i, b in enumerate(block)), pa.binary(), size=n), name + "_large": pa.array([large.get(i) for i in range(n)], pa.binary())}

    return pa.table({
        "block": pa.array(block, pa.int64()), "part": pa.array([key[0].as_py()] * n, pa.int32()),
        **columns(total, "total", (HELD_OUT, KEPT, DELETED)), **columns(kept, "kept", (DELETED,)),
        **{name: pa.array([v] + [0] * (n - 1), pa.int64()) for name, v in zip(("words", "kinds", "kept_words"), stats)},
    })


def corpus_counts(rows: DataFrame, order: int, ranges: int) -> DataFrame:
    """block, part, total, kept (binary int32, in the order of the block's keys of that range), total_large, kept_large, words, kinds, kept_words.

    ``total_large`` and ``kept_large`` hold the counts beyond 32 bits, see ``narrow``.

    The last three are the range's number of training tokens, of distinct ones, and of tokens kept; they stand in one row per range.
    """
    first = bounds(ranges)

    def ask(key: tuple, t: pa.Table) -> pa.Table:
        b = Block(t.column("text"), order)
        cuts = [0, *np.searchsorted(b.keys, first), len(b.keys)]
        full = [i for i in range(ranges) if cuts[i] < cuts[i + 1]]
        return pa.table({
            "part": pa.array(full, pa.int32()), "block": pa.array([key[0].as_py()] * len(full), pa.int64()),
            "keys": pa.array([pack_keys(b.keys[cuts[i] : cuts[i + 1]]) for i in full], pa.binary()),
            "counts": pa.array([b.counts[cuts[i] : cuts[i + 1]].tobytes() for i in full], pa.binary()),
        })

    asked = rows.groupBy("block").applyInArrow(ask, "part int, block bigint, keys binary, counts binary")
    return asked.groupBy("part").applyInArrow(
        add_blocks, "block bigint, part int, total binary, total_large binary, kept binary, kept_large binary, words bigint, kinds bigint, kept_words bigint")


def joined(t: pa.Table, column: str) -> np.ndarray:
    """A block's counts over all ranges, as floating-point numbers (whole up to 2^53)."""
    t = t.sort_by("part")
    cells, large = t.column(column), t.column(column + "_large").to_pylist()
    out = np.empty(sum(pc.binary_length(cells).to_pylist()) // 4)
    at = 0
    for i, more in enumerate(large):
        here = np.frombuffer(cells[i].as_buffer(), np.int32)
        out[at : at + len(here)] = here
        if more:
            place, count = np.frombuffer(more, np.int64).reshape(-1, 2).T
            out[at + place] = count
        at += len(here)
    return out


def score_texts(docs: DataFrame, kind: Column, order: int = 2, block_mb: float = 12.0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every text.

    ``kind``: HELD_OUT (scored only), KEPT (counted) or DELETED (counted, and used for the weights before). ``order``: longest n-gram.
    """
    rows, number = blocks(docs, kind, block_mb)
    answers = stored(corpus_counts(rows, order, max(1, number)), "ngram-counts")
    sums = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("words", "kinds", "kept_words"))).first()
    words, kinds, kept_words = sums["words"], sums["kinds"], sums["kept_words"]

    def events(key: tuple, texts: pa.Table, counts: pa.Table) -> pa.Table:
        give_back()
        own, histories = Block(texts.column("text"), order).values(joined(counts, "kept"))
        p = estimates(own, histories, kept_words, kinds)
        shown = histories[-1] if histories else own[0]
        with np.errstate(divide="ignore"):
            grid = [bucket(shown)] + [np.where(x > 0, np.rint(-STEPS * np.log2(x)), -1).astype(np.int64) for x in p[1:]]
        cells, times = np.unique(np.stack(grid, 1), axis=0, return_counts=True)
        return pa.table({"cell": pa.array(cells.tolist(), pa.list_(pa.int64())), "times": pa.array(times, pa.int64())})

    learn = rows.where(F.col("kind") == DELETED).groupBy("block").cogroup(answers.where(F.col("block") % 3 == DELETED).groupBy("block"))
    met = learn.applyInArrow(events, "cell array<bigint>, times bigint").groupBy("cell").agg(F.sum("times").alias("times")).collect() if kept_words else []
    if met:
        cell = np.array([r["cell"] for r in met], float)
        p = np.where(cell[:, 1:] < 0, 0.0, np.exp2(-cell[:, 1:] / STEPS))
        weights = learn_weights(np.column_stack([cell[:, 0], np.full(len(cell), 1.0 / (kinds + 1)), p]), np.array([r["times"] for r in met], float), order)
    else:
        weights = np.full((BUCKETS, order + 1), 1.0 / (order + 1)) if words else np.tile(np.eye(order + 1)[0], (BUCKETS, 1))

    def score(key: tuple, texts: pa.Table, counts: pa.Table) -> pa.Table:
        give_back()
        b = Block(texts.column("text"), order)
        own, histories = b.values(joined(counts, "total"))
        mix = weights[bucket(histories[-1] if histories else own[0])]
        probability = sum(mix[:, k] * p for k, p in enumerate(estimates(own, histories, words, kinds)))
        begin = np.concatenate([[0], np.cumsum(b.tokens)[:-1]])
        per_text = lambda x: np.add.reduceat(x, begin)
        return pa.table({
            "doc_id": texts.column("doc_id"), "held_out": pa.array([key[0].as_py() % 3 == HELD_OUT] * len(texts)), "n_tokens": pa.array(b.tokens, pa.int64()),
            "n_known": pa.array(per_text((own[0] > 0).astype(np.int64)), pa.int64()), "train_tokens": pa.array([words] * len(texts), pa.int64()),
            "base_score": pa.array(per_text(np.log10((own[0] + 0.5) / (words + 0.5 * (kinds + 1))))), "score": pa.array(per_text(np.log10(probability))),
        })

    kind_ = docs.schema["doc_id"].dataType.simpleString()
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        score, f"doc_id {kind_}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def score_documents(docs: DataFrame, order: int = 2, block_mb: float = 12.0, deleted_one_in: int = 12) -> DataFrame:
    """Score all documents; those of fold 1 are held out, one in ``deleted_one_in`` of the others shapes the weights."""
    deleted = F.pmod(F.xxhash64(F.lit("deleted"), "doc_id"), F.lit(deleted_one_in)) == 0
    kind = F.when(fold(F.col("doc_id")) == 1, HELD_OUT).when(deleted, DELETED).otherwise(KEPT)
    return score_texts(docs, kind, order, block_mb)
