"""Fingerprints of texts by a randomised edit embedding, with bit-sampled banding and verification.

All texts take the same random walk: at step j the character at hand is written down, and a random bit that depends on j and
the character tells whether to move on to the next one. After an edit, two walks meet again soon, so few edits
change few of the written characters: edit distance becomes Hamming distance (Chakraborty, Goldenberg, Koucky 2016).

Of the written characters a fixed number of steps is sampled. Each slot has its own random order of the steps and takes
the first in that order among those the walk made, so texts of any lengths share most sampled steps. A slot keeps four bits of
its step and character. The likeness of two fingerprints is the share of equal slots, corrected for equality by chance.

Rows: a text of null counts as empty; the empty text has a fingerprint of its own (no step was made). Equal texts have equal
fingerprints. Rows are in the order of doc_id, null first; rows with one id are in the order of a hash of their texts. Extra
columns are not read. A task holds a few megabytes of text, or one longer text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfence.llm.common import by_bytes, per_worker
from skyfence.llm.links import components

SLOTS = 256
#: Steps drawn at one time; walks of this few texts are taken one by one.
STRIDE, FEW = 4096, 16
STAY = np.uint8(63)  # class of what follows a text's end; its bit is never set


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Embedding:
    def __init__(self, seed: int = 11):
        self.seed = np.uint64(seed)
        r = np.random.default_rng(seed)
        at: dict[int, list[int]] = {}
        for slot in range(SLOTS):  # steps at which the slot's order has a new first
            step, least = 0, r.random()
            while step < 1 << 40:
                at.setdefault(step, []).append(slot)
                step += int(r.geometric(max(least, 1e-12)))
                least *= r.random()
        self.records = sorted(at)
        self.slots = [np.array(at[s]) for s in self.records]

    def bits(self, first: int) -> np.ndarray:
        """Move-on bits of STRIDE steps, one bit for each of 63 classes of characters."""
        steps = np.arange(first + 1, first + 1 + STRIDE, dtype=np.uint64)
        return scrambled(steps * np.uint64(0x9E3779B97F4A7C15) + self.seed) >> np.uint64(1)

    def values(self, texts: list[str]) -> np.ndarray:
        """SLOTS four-bit values for each text, 0 where no step was made."""
        points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        lengths = np.fromiter(map(len, points), np.int64, len(points))
        ends = np.cumsum(lengths + 1) - 1
        line = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint32)
        kinds = np.full(len(line), STAY, np.uint8)
        for end, p in zip(ends, points):
            line[end - len(p) : end] = p
            kinds[end - len(p) : end] = scrambled(p.astype(np.uint64) + np.uint64(77)) % np.uint64(63)
        out = np.zeros((len(texts), SLOTS), np.uint8)
        who = np.flatnonzero(lengths)
        place, record, step = (ends - lengths)[who], 0, 0

        def note(record: int, who, chars) -> None:
            mixed = scrambled(np.atleast_1d(chars).astype(np.uint64) * np.uint64(0x100000001B3) + np.uint64(self.records[record]))
            slots = self.slots[record]
            parts = scrambled(mixed[:, None] + slots.astype(np.uint64)[None, :]) & np.uint64(15)
            out[np.ix_(np.atleast_1d(who), slots)] = parts.astype(np.uint8)

        while len(who) > FEW:
            bits = self.bits(step)
            for j in range(STRIDE):
                if step == self.records[record]:
                    live = place < ends[who]
                    note(record, who[live], line[place[live]])
                    record += 1
                place += ((bits[j] >> kinds[place]) & np.uint64(1)).astype(np.int64)
                step += 1
                if not step & 127:
                    live = place < ends[who]
                    if not live.all():
                        who, place = who[live], place[live]
                        if len(who) <= FEW:
                            break
        if len(who):
            self._one_by_one(who, place, ends, line, kinds, record, step, note)
        return out

    def _one_by_one(self, who, place, ends, line, kinds, record, step, note) -> None:
        classes = kinds.tobytes()
        states = [[w, int(p), int(ends[w]), record, step] for w, p in zip(who, place)]
        while states:
            first = states[0][4] // STRIDE * STRIDE
            bits = self.bits(first).tolist()
            for s in states:
                w, at, end, rec, j = s
                while j < first + STRIDE and at < end:
                    stop = min(first + STRIDE, self.records[rec])
                    while j < stop and at < end:
                        at += bits[j - first] >> classes[at] & 1
                        j += 1
                    if at < end and j == self.records[rec]:
                        note(rec, w, line[at])
                        rec += 1
                        at += bits[j - first] >> classes[at] & 1 if j < first + STRIDE else 0
                        j += j < first + STRIDE
                s[1:] = at, end, rec, j
            states = [s for s in states if s[1] < s[2]]


def hexed(values: np.ndarray) -> list[str]:
    digits = np.frombuffer(b"0123456789abcdef", np.uint8)
    return [row.tobytes().decode() for row in digits[values]]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of slot values: share of equal slots above what chance makes equal."""
    return np.maximum(0.0, ((a == b).mean(-1) - 1 / 16) / (15 / 16))


def edited(text: str, following: str) -> str:
    """The last quarter replaced by the beginning of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """part, doc_id, text, extra in partitions sorted so that each row is followed by its next document.

    Ids are cut into ranges; the first row of a range is sent along with the range before as ``extra`` (that of the first range with
    the last). Only ids and hashes of these first rows, at most ``ranges``, pass through the driver.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    number = F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.7e308)).alias("number")
    rows = rows.select("*", F.xxhash64("text").alias("th"), number)
    cuts = rows.approxQuantile("number", [i / ranges for i in range(1, ranges)], 0.25 / ranges) if ranges > 1 else []
    splits = [-float("inf"), *sorted({c for c in cuts if c > -1.7e308}), float("inf")]
    rows = Bucketizer(splits=splits, inputCol="number", outputCol="part").transform(rows) if len(splits) > 2 else rows.withColumn("part", F.lit(0.0))
    rows = rows.drop("number")
    first = rows.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "th")).alias("m")).orderBy("part").collect()
    before = [(first[i - 1]["part"], r["m"]["doc_id"], r["m"]["th"]) for i, r in enumerate(first)]
    kind = docs.schema["doc_id"].dataType.simpleString()
    heads = docs.sparkSession.createDataFrame(before, f"part double, head {kind}, head_th bigint")
    joined = rows.drop("part").join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("th") == F.col("head_th")))  # at most ``ranges`` rows
    both = rows.select("part", "doc_id", "text", "th", F.lit(0).alias("extra")).unionByName(joined.select("part", "doc_id", "text", "th", F.lit(1).alias("extra")))
    return both.repartition("part").sortWithinPartitions("part", "extra", F.col("doc_id").asc_nulls_first(), "th")


def fingerprint_documents(docs: DataFrame, rows_per_range: int = 2500, most_ranges: int = 4096) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    ranges = min(most_ranges, max(1, docs.count() // rows_per_range))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedding = per_worker("embedding", Embedding)
        waiting: list[tuple] = []  # at most one row, that of the last slice: (part, extra, id, text, values)
        for batch in batches:
            for part in by_bytes(batch, "text", 3.0):
                texts = part.column("text").to_pylist()
                rows = waiting + list(zip(part.column("part").to_pylist(), part.column("extra").to_pylist(), part.column("doc_id").to_pylist(), texts, [None] * len(texts)))
                changed = [edited(a[3], b[3]) for a, b in zip(rows, rows[1:])]
                values = embedding.values(texts + changed)
                own = np.vstack([w[4][None] for w in waiting] + [values[: len(texts)]])
                new = values[len(texts) :]
                keep = [i for i in range(len(rows) - 1) if not rows[i][1]]
                if keep:
                    a, b, c = own[keep], new[keep], own[[i + 1 for i in keep]]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([rows[i][2] for i in keep], part.schema.field("doc_id").type), pa.array([len(rows[i][3]) for i in keep], pa.int64()),
                        pa.array([hashlib.sha256(changed[i].encode()).hexdigest() for i in keep]), pa.array(hexed(a)), pa.array(hexed(b)), pa.array(likeness(a, b)), pa.array(likeness(a, c)),
                    ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
                waiting = [(*rows[-1][:4], own[-1])]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_next(docs, ranges).select("part", "extra", "doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every text, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedding = per_worker("embedding", Embedding)
        for batch in batches:
            for part in by_bytes(batch, "text", 6.0):
                values = embedding.values([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(hexed(values))], ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fingerprint string")


def near_groups(docs: DataFrame, least: float = 0.8, width: int = 8, block: int = 2000) -> DataFrame:
    """doc_id, component_id: documents connected by fingerprints of at least the likeness ``least`` that share a band.

    Bands are ``width`` neighbouring slots each. Equal fingerprints are one; the others of a band value meet in blocks of about
    ``block``, each pair of blocks in a task of its own, where all are compared and the links that connect them are kept.
    """
    every = fingerprints(docs).where("doc_id is not null")
    kinds = every.groupBy("fingerprint").agg(F.min("doc_id").alias("rep"))
    bands = F.explode(F.sequence(F.lit(0), F.lit(SLOTS // width - 1))).alias("band")
    keyed = kinds.select("rep", "fingerprint", bands).withColumn("value", F.expr(f"substr(fingerprint, band * {width} + 1, {width})"))
    sizes = keyed.groupBy("band", "value").agg(F.count("*").alias("members")).where("members > 1")
    placed = keyed.join(sizes, ["band", "value"]).withColumn("blocks", F.ceil(F.col("members") / block)).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    placed = placed.withColumn("other", F.explode(F.expr("sequence(cast(0 as bigint), blocks - 1)")))
    placed = placed.select("band", "value", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "rep", "fingerprint")

    def run(t: pa.Table) -> pa.Table:
        rep = t.column("rep").to_pylist()
        f = np.frombuffer("".join(t.column("fingerprint").to_pylist()).encode(), np.uint8).reshape(-1, SLOTS)
        root, links = np.arange(len(rep)), []
        for k in range(1, len(rep)):
            close = np.flatnonzero(likeness(f[:k], f[k]) >= least)
            for r in np.unique(root[close]):
                links.append((rep[k], rep[r]))
                root[root == r] = k
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    linked = components(placed.groupBy("band", "value", "i", "j").applyInArrow(run, "a bigint, b bigint"))
    named = kinds.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("fingerprint", F.coalesce("root", "rep").alias("component_id"))
    return every.join(named, "fingerprint").select("doc_id", "component_id")
