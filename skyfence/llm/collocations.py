"""Phrases of two to four words that recur more than their parts suggest, counted by double-array tries.

1. One pass counts words, and adjacent pairs by a 64-bit key; a second counts longer word sequences by key, but only where
   all their pairs may be frequent. A key's total is never below a phrase's own count, so no frequent phrase is lost.
2. Occurring phrases with a frequent key are the candidates. They are dealt by their first two words into shards of bounded size,
   each a double-array trie.
3. One more pass takes from every text position the longest sequence that may hold candidates; equal ones are summed up and go to
   the trie of their first two words. All of them move through it together, word by word, and the states reached are summed up. These exact
   counts decide. The texts are read as often, and each position walks one trie, however many candidates there are.
4. Cuts, containment and ranks are joins and windows over the counted phrases.

Every word carries its text's language, so nothing below depends on how many languages there are or how large one is.

Rows: a text of null counts as empty, a language of null as ``und``. Repeated rows count each. Extra columns are not read. Without
a phrase that is frequent enough the result is empty. Ties of score and count go by the phrase's UTF-8 bytes. A task holds about
``MB`` of text at a time, or one longer text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfence.llm.common import by_bytes, lean, stored
from skyfence.llm.grams import mixed
from skyfence.llm.letters import encoded, grouped, ranked, raw, rows_of, runs
from skyfence.llm.word_tries import DoubleArray

MB = 4.0
#: Bits of the filter of pairs: 16 MB at any size of the corpus. A fuller filter lets more sequences be counted, and loses none.
FILTER_BITS = 27
#: Candidates of one trie; bytes of sequences that walk it together.
SHARD, ROUND_BYTES = 50_000, 4_000_000
#: Parts of what is ranked together.
SALTS = 64

_KIND = np.zeros(256, np.uint8)  # 0: letter of a word, 1: blank, 2: end of a piece
_KIND[[0x20, 0x09]] = 1
_KIND[list(b".,;:!?") + list(range(0x0A, 0x0E))] = 2


class Words:
    """The words of some texts: ``codes`` into ``words`` ("language\\nword", as bytes) and their pieces, in text order."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        data, places = raw(texts)
        kind = _KIND[data]
        found, at = runs(data, places, kind == 0)
        row = rows_of(at, places)
        self.pieces = np.searchsorted(np.flatnonzero(kind == 2), at) + row
        code, distinct = encoded(found)
        lang, names = encoded(pc.fill_null(langs.cast(pa.large_binary()), b"und"))
        both = code * max(1, len(names)) + lang[row]
        pairs, self.codes = ranked(both, len(distinct) * len(names))
        first, second = pa.array(pairs // max(1, len(names))), pa.array(pairs % max(1, len(names)))
        self.bare = distinct.take(first)
        self.words = pc.binary_join_element_wise(names.take(second), self.bare, pa.scalar(b"\n", pa.large_binary()))
        self.keys = np.fromiter(map(xxhash.xxh64_intdigest, self.words.to_pylist()), np.uint64, len(self.words))
        self.lang_of_word, self.names = pairs % max(1, len(names)), names

    def sequences(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and keys of all sequences of so many words within a piece."""
        n = len(self.codes) - length + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.flatnonzero(self.pieces[:n] == self.pieces[length - 1:])
        return at, self.key_at(at, length)

    def key_at(self, at: np.ndarray, length: int) -> np.ndarray:
        key = self.keys[self.codes[at]]
        for k in range(1, length):
            key = mixed(key, self.keys[self.codes[at + k]])
        return key


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in batches:
        for part in by_bytes(batch, "text", MB):
            yield Words(part.column("text"), part.column("lang"))


def _words_and_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, null, n) of words, with "language\\n" for all words of a language, and (null, key, n) of pairs."""
    for w in _parts(batches):
        n = np.bincount(w.codes, minlength=len(w.words)).astype(np.int64)
        totals = np.bincount(w.lang_of_word, weights=n, minlength=len(w.names)).astype(np.int64)
        alls = pc.binary_join_element_wise(w.names, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
        words = pa.concat_arrays([w.words, alls]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([words, pa.nulls(len(words), pa.int64()), pa.array(np.append(n, totals))], ["word", "key", "n"])
        _, key = w.sequences(2)
        first, size = grouped(key)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(first), pa.binary()), pa.array(key[first].view(np.int64)), pa.array(size)], ["word", "key", "n"])


class _Filter:
    """Bits of keys, by their upper bits."""

    def __init__(self, parts: list[tuple[int, bytes]]):
        self.bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for part, data in parts:
            self.bits[part * 8192:(part + 1) * 8192] = np.frombuffer(data, np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        return (self.bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _filter_of(keys: DataFrame) -> _Filter:
    """The filter of a table of keys: 2,048 pieces of 8 KB at most, whatever the number of keys."""

    def bits(key: tuple, rows: pa.Table) -> pa.Table:
        on = np.zeros(65_536, np.uint8)
        on[rows.column("slot").to_numpy() & 65_535] = 1
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})

    slots = keys.select(F.shiftrightunsigned("key", 64 - FILTER_BITS).alias("slot")).distinct().withColumn("part", F.shiftright("slot", 16))
    return _Filter([(r["part"], bytes(r["bits"])) for r in slots.groupBy("part").applyInArrow(bits, "part bigint, bits binary").collect()])


def _long(w: Words, pairs: _Filter) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Places and keys of sequences of three and four words whose pairs all pass the filter."""
    at, key = w.sequences(2)
    good = np.zeros(len(w.codes), bool)
    good[at] = pairs.has(key)
    for length in (3, 4):
        fit = good[: max(0, len(good) - length + 1)].copy()
        for k in range(1, length - 1):
            fit &= good[k : k + len(fit)]
        at = np.flatnonzero(fit)  # good pairs lie in one piece, and so do overlapping ones
        yield length, at, w.key_at(at, length)


def _long_keys(docs: DataFrame, pairs: _Filter) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _parts(batches):
            for _, _, key in _long(w, sent.value):
                first, size = grouped(key)
                yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(size)], ["key", "n"])

    return docs.mapInArrow(lean(run), "key bigint, n bigint")


def _phrases(docs: DataFrame, pairs: _Filter, longer: _Filter) -> DataFrame:
    """(key, phrase) of occurring phrases whose key passes the filters; phrase: language, \\n, words joined by spaces."""
    sent = docs.sparkSession.sparkContext.broadcast((pairs, longer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two, more = sent.value
        for w in _parts(batches):
            at, key = w.sequences(2)
            fit = two.has(key)
            for length, at, key in [(2, at[fit], key[fit]), *((n, a[f], k[f]) for n, a, k in _long(w, two) for f in [more.has(k)])]:
                words = [w.codes[at + k] for k in range(length)]
                first = one_of_each(key, words)
                parts = [w.words.take(pa.array(words[0][first]))] + [w.bare.take(pa.array(c[first])) for c in words[1:]]
                joined = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), joined], ["key", "phrase"])

    return docs.mapInArrow(lean(run), "key bigint, phrase binary")


def _sequences(docs: DataFrame, pairs: _Filter, longer: _Filter) -> DataFrame:
    """(pair, phrase, n): the longest sequence from each position whose keys pass the filters, the key of its first two words, and how often."""
    sent = docs.sparkSession.sparkContext.broadcast((pairs, longer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two, more = sent.value
        for w in _parts(batches):
            at, key = w.sequences(2)
            fit = two.has(key)
            long, pair = np.zeros(len(w.codes), np.int64), np.zeros(len(w.codes), np.uint64)
            long[at[fit]], pair[at[fit]] = 2, key[fit]
            keys = pair.copy()
            for length, at, key in _long(w, two):
                fit = more.has(key)
                long[at[fit]], keys[at[fit]] = length, key[fit]
            for length in (2, 3, 4):
                at = np.flatnonzero(long == length)
                words = [w.codes[at + k] for k in range(length)]
                first, n = each_with_size(keys[at], words)
                parts = [w.words.take(pa.array(words[0][first]))] + [w.bare.take(pa.array(c[first])) for c in words[1:]]
                joined = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(pair[at[first]].view(np.int64)), joined, pa.array(n)], ["pair", "phrase", "n"])

    return docs.mapInArrow(lean(run), "pair bigint, phrase binary, n bigint")


def each_with_size(key: np.ndarray, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(index of one member, size) of every distinct sequence of words; ``key``: their keys."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    first = order[new]
    like = first[np.cumsum(new) - 1]
    if all((c[order] == c[like]).all() for c in words):
        return first, np.diff(np.append(np.flatnonzero(new), len(k)))
    return grouped(key, *words)  # two sequences share a key


def one_of_each(key: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """The index of one member of every distinct sequence of words; ``key``: their keys."""
    return each_with_size(key, words)[0]


def _words_of(phrase: bytes) -> list[bytes]:
    lang, _, words = phrase.rpartition(b"\n")
    return [lang + b"\n" + w for w in words.split(b" ")]


def _dealt(df: DataFrame, shards: int) -> DataFrame:
    """With the shard of each row, by the key of its first two words."""
    return df.withColumn("shard", F.pmod(F.xxhash64("pair"), F.lit(shards)).cast("int")).drop("pair")


def _with_pair(candidates: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [_words_of(p) for p in batch.column("phrase").to_pylist()]
            first, second = (np.fromiter((xxhash.xxh64_intdigest(w[k]) for w in words), np.uint64, len(words)) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("phrase"), pa.array(mixed(first, second).view(np.int64))], ["phrase", "pair"])

    return candidates.mapInArrow(run, "phrase binary, pair bigint")


def _tries(candidates: DataFrame, shards: int) -> DataFrame:
    """Rows (shard, slot, phrase) of where phrases end, and one row (shard, -1, packed trie) a shard."""

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        phrases = sorted(rows.column("phrase").to_pylist())
        trie = DoubleArray.of(list(map(_words_of, phrases)))
        shard = [key[0].as_py()] * (len(phrases) + 1)
        return pa.table({"shard": pa.array(shard, pa.int32()), "slot": pa.array([-1, *trie.slots.tolist()], pa.int64()), "phrase": pa.array([trie.pack(), *phrases], pa.binary())})

    return stored(_dealt(_with_pair(candidates), shards).groupBy("shard").applyInArrow(build, "shard int, slot bigint, phrase binary"), "phrase-tries")


def _counted(sequences: DataFrame, tries: DataFrame, shards: int, least: int) -> DataFrame:
    """(shard, slot, f): slots of the tries that the sequences reach ``least`` times."""
    mb = ROUND_BYTES / 1e6

    def walk(key: tuple, rows: pa.Table, packed: pa.Table) -> pa.Table:
        slot, total = np.empty(0, np.int64), np.empty(0, np.int64)
        if packed.num_rows and rows.num_rows:
            trie = DoubleArray.unpack(packed.column("trie")[0].as_py())
            total = np.zeros(len(trie.base), np.int64)
            for batch in rows.combine_chunks().to_batches():
                for part in by_bytes(batch, "phrase", mb):
                    words = [_words_of(p) for p in part.column("phrase").to_pylist()]
                    sizes = np.fromiter(map(len, words), np.int64, len(words))
                    codes, distinct = encoded(pa.array([x for w in words for x in w], pa.large_binary()))
                    total += trie.counts(distinct, codes, np.repeat(np.arange(len(words)), sizes), np.cumsum(sizes) - sizes, part.column("n").to_numpy())
            slot = np.flatnonzero(total >= least)
        return pa.table({"shard": pa.array([key[0].as_py()] * len(slot), pa.int32()), "slot": pa.array(slot), "f": pa.array(total[slot])})

    rows = _dealt(sequences.groupBy("pair", "phrase").agg(F.sum("n").alias("n")), shards)
    packed = tries.where("slot = -1").select("shard", F.col("phrase").alias("trie"))
    return rows.groupBy("shard").cogroup(packed.groupBy("shard")).applyInArrow(walk, "shard int, slot bigint, f bigint")


def phrase_counts(docs: DataFrame, least: int = 30) -> DataFrame:
    """(phrase, f) of all phrases of one to four words that occur ``least`` times in a language; "language\\n": all its words."""
    docs = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    short = docs.mapInArrow(lean(_words_and_pairs), "word binary, key bigint, n bigint")
    total = F.col("word").isNotNull() & (F.expr("right(word, 1)") == F.lit(b"\n"))
    short = stored(short.groupBy("word", "key").agg(F.sum("n").alias("f")).where((F.col("f") >= least) | total), "phrase-words")
    pair_keys = short.where("key is not null").select("key")
    pairs = _filter_of(pair_keys)
    long_keys = stored(_long_keys(docs, pairs).groupBy("key").agg(F.sum("n").alias("f")).where(F.col("f") >= least).select("key"), "phrase-keys")
    longer = _filter_of(long_keys)
    found = _phrases(docs, pairs, longer).distinct()
    candidates = stored(found.join(pair_keys.union(long_keys).distinct(), "key", "left_semi").select("phrase").distinct(), "phrase-candidates")
    words = short.where("word is not null").select(F.col("word").cast("string").alias("phrase"), "f")
    shards = math.ceil(candidates.count() / SHARD)
    if not shards:
        return words
    tries = _tries(candidates, shards)
    counts = _counted(_sequences(docs, pairs, longer), tries, shards, least)
    ends = tries.where("slot >= 0").select("shard", "slot", F.col("phrase").cast("string").alias("phrase"))
    return words.unionByName(ends.join(counts, ["shard", "slot"]).select("phrase", "f"))


def _sub(words: Column, lang: Column, start: int, size: Column) -> Column:
    return F.concat(lang, F.lit("\n"), F.array_join(F.slice(words, start, size), " "))


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, absorbed: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language.

    ``least``: occurrences a candidate needs. A candidate inside a longer one with ``absorbed`` percent of its count is left out.
    """
    f = stored(phrase_counts(docs, least), "phrase-counts")
    parts = F.split("phrase", "\n")
    lang = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "\n")
    named = f.select("phrase", "f", lang.alias("lang"), F.element_at(parts, -1).alias("text"))
    totals = named.where("text = ''").select("lang", F.col("f").alias("n"))
    words = F.split("text", " ")
    cand = named.where(F.size(words) > 1).select("lang", "phrase", "text", F.col("f").alias("a"), words.alias("words"))
    size, w, g = F.size("words"), F.col("words"), F.col("lang")
    cuts = cand.select("phrase", "lang", "words", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("phrase", "a", "k", _sub(w, g, 1, F.col("k")).alias("first"), F.concat(g, F.lit("\n"), F.array_join(F.slice(w, F.col("k") + 1, size - F.col("k")), " ")).alias("rest"))
    cuts = cuts.join(f.select(F.col("phrase").alias("first"), F.col("f").alias("l")), "first").join(f.select(F.col("phrase").alias("rest"), F.col("f").alias("r")), "rest")
    score = F.expr("cast(a as decimal(19,0)) * 2000000 div (cast(l as decimal(19,0)) + r)")
    best = cuts.withColumn("score", score).groupBy("phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = cand.where(size > 2).select("a", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(
        F.sequence(F.lit(1), size - k + 1), lambda s: F.concat(g, F.lit("\n"), F.array_join(F.slice(w, s, k), " ")))))).alias("phrase"))
    longer = inner.groupBy("phrase").agg(F.max("a").alias("most"))
    kept = cand.join(longer, "phrase", "left").where("most is null or cast(most as decimal(19,0)) * 100 < cast(a as decimal(19,0)) * " + str(int(absorbed)))
    ranked = kept.join(best, "phrase").select("lang", F.col("text").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    # The best of each language are among the best of its parts, so the last window holds a bounded number of rows.
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = ranked.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("salt")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same in DuckDB's SQL; {docs}: a table with text and lang.
COLLOCATIONS_SQL = r"""
with texts as (
  select row_number() over () as d, coalesce(lang, 'und') as lang,
         regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as p from {docs}),
pieces as (select lang, list_filter(regexp_split_to_array(unnest(p), '[\x20\x09]+'), lambda x: x <> '') as w from texts),
grams as (
  select lang, w[i:i + k - 1] as g, count(*) as f
  from (select lang, w, unnest(range(1, len(w) + 1)) as i from pieces), (values (1), (2), (3), (4)) as ks(k)
  where i + k - 1 <= len(w) group by all),
f as (select * from grams where f >= 30),
n as (select lang, sum(f)::bigint as n from grams where len(g) = 1 group by lang),
cuts as (
  select c.lang, c.g, c.f as a, k, x.f as l, y.f as r, (2000000::hugeint * c.f) // (x.f::hugeint + y.f) as score
  from (select *, unnest(range(1, len(g))) as k from f where len(g) > 1) c
  join f x on x.lang = c.lang and x.g = c.g[1:k] join f y on y.lang = c.lang and y.g = c.g[k + 1:]),
cut as (select lang, g, a, l, r, score from cuts qualify row_number() over (partition by lang, g order by score, k) = 1),
inner_ as (
  select lang, g[s:s + k - 1] as g, max(f) as most
  from (select *, unnest(range(1, len(g))) as s from f where len(g) > 2), (values (2), (3)) as ks(k)
  where k < len(g) and s + k - 1 <= len(g) group by all),
kept as (
  select c.*, array_to_string(c.g, ' ') as phrase from cut c left join inner_ i on i.lang = c.lang and i.g = c.g
  where most is null or 100::hugeint * most < 80::hugeint * a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score::bigint as score
from kept join n using (lang) qualify rank <= 2000
"""
