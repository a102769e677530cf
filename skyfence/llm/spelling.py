"""Words that differ by one code point, found through pairs of trie nodes.

Every prefix of a word is a node of a forward trie, every suffix one of a trie of reversed words. With both numbered, a word of
m code points has m + 1 places: (prefix node, suffix node) is the word itself cut at a place, and skipping the code point there
gives (prefix node, suffix node behind it). Two words that differ by a replaced code point share a skipped pair; a word with one
more code point has a skipped pair that equals a whole pair of the shorter one. Joins on integers are thus exact, and a pair has
at most one whole word and as many skipping ones as there are letters, so no key is large.

Numbers: words are sorted into parts by range. A part numbers its own nodes; nodes on the way to a part's last word have numbers
that follow from that word alone, so the parts behind it use the same ones. Only each part's first and last word meet.

Rows: a text of null counts as without words, a doc_id of null as the empty text. Repeated rows count each. Extra columns are not
read. Words of any length work; no string is stored per node.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfence.llm.common import by_bytes, lean, stored
from skyfence.llm.letters import encoded, grouped, raw, rows_of, runs

MB = 12.0
#: Words of one range.
PART = 50_000
#: Numbers of a part's nodes: below ``OWN`` those on the way to its last word, by depth.
SPAN, OWN = 1 << 40, 1 << 32

_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True


def words_of(texts: pa.Array, ids: list[str], damaged: int = 97) -> tuple[list[bytes], list[int]]:
    """Words and their counts: lowered runs of letters of some texts; runs whose crc32 with the id ``damaged`` divides lose a code point."""
    data, places = raw(texts)
    wanted = _ASCII[data] | (data == 0xC3)  # U+00C0 to U+00FF are the byte C3 and a following one
    wanted[1:] |= data[:-1] == 0xC3
    found, at = runs(data, places, wanted)
    code, distinct = encoded(found)
    row = rows_of(at, places)
    first, size = grouped(row, code)
    values, prefix = distinct.to_pylist(), [f"{i}:".encode() for i in ids]
    seeds = [zlib.crc32(p) for p in prefix]
    rows, codes = row[first].tolist(), code[first]
    h = np.fromiter((zlib.crc32(values[c], seeds[r]) for c, r in zip(codes.tolist(), rows)), np.int64, len(rows))
    hit = h % damaged == 0
    kept = np.bincount(codes[~hit], weights=size[~hit], minlength=len(values)).astype(np.int64)
    out, counts = [], []
    for c, n in zip(codes[hit].tolist(), zip(h[hit].tolist(), size[hit].tolist())):
        word = values[c].decode()
        cut = n[0] % len(word)
        out.append((word[:cut] + word[cut + 1:]).encode())
        counts.append(n[1])
    for c in np.flatnonzero(kept):
        out.append(values[c])
        counts.append(int(kept[c]))
    return out, counts


def word_counts(docs: DataFrame, damaged: int = 97, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n) of words with at least ``shortest`` code points and ``least`` occurrences overall."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text", MB):
                words, counts = words_of(part.column("text"), part.column("id").to_pylist(), damaged)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64())], ["word", "n"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = rows.mapInArrow(lean(run), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return found.select(F.col("word").cast("string").alias("word"), "n").where(F.char_length("word") >= shortest)


def common(a: str, b: str) -> int:
    """Code points that two words share at their beginnings."""
    k, most = 0, min(len(a), len(b))
    while k < most and a[k] == b[k]:
        k += 1
    return k


def borders(ends: list[tuple[int, str, str]]) -> dict[int, tuple[str, str, list[int]]]:
    """For each part: the last word of the part before, its own last word, and for each depth the part whose last word owns a shared prefix.

    ``ends``: (part, first word, last word), in order, parts with words only.
    """
    out, before, owners = {}, "", [0]
    for i, (part, first, last) in enumerate(ends):
        if i == 0:
            owners, shared = [part], 0
        else:
            shared = common(before, first)
            owners = owners[:shared + 1]  # the root belongs to the first part
        out[part] = (before, last, list(owners))
        # Prefixes of this part's last word: shared with the part before as far as that word reaches, own ones beyond.
        mine = common(before, last) if i else 0
        owners = owners[:mine + 1] + [part] * (len(last) - mine)
        before = last
    return out


class Nodes:
    """Numbers of the prefixes of one part's sorted words."""

    def __init__(self, part: int, before: str, last: str, owners: list[int]):
        self.part, self.before, self.last, self.owners = part, before, last, owners
        self.word, self.path, self.count = "", [], 0

    def of(self, word: str) -> list[int]:
        """Numbers of word[:0], word[:1], ..., word."""
        old = common(self.before, word)
        new = common(self.last, word)
        same = common(self.word, word) if self.path else 0
        path = self.path[:same + 1]
        for depth in range(len(path), len(word) + 1):
            if depth <= old and depth < len(self.owners):
                path.append(self.owners[depth] * SPAN + depth)
            elif depth <= new:
                path.append(self.part * SPAN + depth)
            else:
                path.append(self.part * SPAN + OWN + self.count)
                self.count += 1
        self.word, self.path = word, path
        return path


def numbered(words: DataFrame, name: str, parts: int) -> DataFrame:
    """(word, place, nodes): the words' order as a number, and the numbers of all prefixes of each word."""
    spread = words.select("word").repartitionByRange(parts, "word") if parts > 1 else words.select("word").coalesce(1)
    dealt = stored(spread.withColumn("part", F.spark_partition_id()), name)
    ends = dealt.groupBy("part").agg(F.min("word").alias("first"), F.max("word").alias("last"))
    known = borders(sorted((r["part"], r["first"], r["last"]) for r in ends.collect()))
    sent = words.sparkSession.sparkContext.broadcast(known)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        part = key[0].as_py()
        own = sorted(rows.column("word").to_pylist())
        nodes = Nodes(part, *sent.value[part])
        paths = [list(nodes.of(w)) for w in own]
        place = np.arange(len(own), dtype=np.int64) + part * SPAN
        return pa.table({"word": pa.array(own, pa.string()), "place": pa.array(place), "nodes": pa.array(paths, pa.list_(pa.int64()))})

    return dealt.groupBy("part").applyInArrow(run, "word string, place bigint, nodes array<bigint>")


def spelling_groups(docs: DataFrame, damaged: int = 97, shortest: int = 5, least: int = 3, part: int = PART) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts.

    ``form``: the near word of largest n, the first in code-point order among equals, if it occurs twice as often; ``root``: where
    forms end.
    """
    return grouped_words(stored(word_counts(docs, damaged, shortest, least), "spelling-words"), part)


def grouped_words(words: DataFrame, part: int = PART) -> DataFrame:
    """The same from a table (word, n) of distinct words."""
    parts = -(-words.count() // part) or 1
    forward = numbered(words, "spelling-forward", parts)
    back = numbered(words.select(F.reverse("word").alias("word")), "spelling-back", parts).select(F.reverse("word").alias("word"), F.reverse("nodes").alias("tails"))
    # places: order of the words in code points, so (n, place) decides ties without the words.
    known = stored(words.join(forward, "word").join(back, "word"), "spelling-nodes")
    m = F.size("nodes") - 1
    whole = known.select("place", "n", F.lit(True).alias("whole"), F.lit(False).alias("shorter"), F.explode(F.arrays_zip(F.col("nodes").alias("p"), F.col("tails").alias("s"))).alias("at"))
    whole = whole.select("place", "n", "whole", "shorter", F.col("at.p").alias("p"), F.col("at.s").alias("s"))
    letters = F.split("word", "")
    # Skipping any code point of a run of equal ones gives the same word: the first of a run stands for it.
    firsts = F.transform(F.slice(letters, 1, m), lambda c, i: (i == 0) | (F.get(letters, i - 1) != c))
    skip = known.select("place", "n", F.explode(F.arrays_zip(F.slice("nodes", 1, m).alias("p"), F.slice("tails", 2, m).alias("s"), firsts.alias("shorter"))).alias("at"))
    skip = skip.select("place", "n", F.lit(False).alias("whole"), F.col("at.shorter").alias("shorter"), F.col("at.p").alias("p"), F.col("at.s").alias("s"))
    met = whole.unionByName(skip)
    row = F.struct((-F.col("n")).alias("n"), "place")
    # Of a key's skipping words each has all others as neighbours (a code point replaced); the whole word has the shorter ones.
    sides = met.groupBy("p", "s").agg(
        F.array_sort(F.collect_list(F.when(~F.col("whole"), row))).alias("skips"),
        F.array_sort(F.collect_list(F.when(F.col("shorter"), row))).alias("shorter"),
        F.min(F.when(F.col("whole"), row)).alias("whole"))
    sides = sides.where("size(skips) > 1 or (whole is not null and size(shorter) > 0)")
    near = F.concat(
        F.when(F.size("skips") > 1, F.transform("skips", lambda x, i: F.struct(x["place"].alias("place"), (F.size("skips") - 1).alias("near"), F.when(i == 0, F.col("skips")[1]).otherwise(F.col("skips")[0]).alias("best")))).otherwise(F.array()),
        F.when(F.col("whole").isNotNull(), F.transform("shorter", lambda x: F.struct(x["place"].alias("place"), F.lit(1).alias("near"), F.col("whole").alias("best")))).otherwise(F.array()),
        F.when(F.col("whole").isNotNull() & (F.size("shorter") > 0), F.array(F.struct(F.col("whole.place").alias("place"), F.size("shorter").alias("near"), F.col("shorter")[0].alias("best")))).otherwise(F.array()))
    best = sides.select(F.explode(near).alias("x")).groupBy("x.place").agg(F.sum("x.near").alias("n_near"), F.min("x.best").alias("best"))
    form = F.when(-F.col("best.n") >= 2 * F.col("n"), F.col("best.place"))
    out = known.select("word", "place", "n").join(best, "place", "left").withColumn("form", form)
    out = stored(out.select("word", "place", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form", F.when(F.col("form").isNotNull(), -F.col("best.n")).alias("form_n")), "spelling-near")
    names = out.select(F.col("place"), F.col("word").alias("name"))
    root = roots(out.select("place", F.coalesce("form", "place").alias("root")))
    out = out.join(root, "place").join(names.select(F.col("place").alias("form"), F.col("name").alias("form_word")), "form", "left")
    out = out.join(names.select(F.col("place").alias("root"), F.col("name").alias("root_word")), "root")
    return out.select("word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", "form_n")


def roots(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(place, root): links followed to their ends by pointer jumping; n doubles along a chain, so few rounds are needed."""
    now = stored(links, "spelling-roots")
    for _ in range(most_rounds):
        to = now.where("place <> root").select(F.col("place").alias("root"), F.col("root").alias("further"))
        moved = now.join(to, "root", "left").select("place", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        moved = stored(moved, "spelling-roots")
        if not moved.where("moved").limit(1).count():
            return moved.select("place", "root")
        now = moved.select("place", "root")
    raise RuntimeError("forms do not end")
