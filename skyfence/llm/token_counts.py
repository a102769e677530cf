"""Token counts of whole texts; huge ones in overlapping chunks that are spliced at proven boundaries.

Texts of ordinary length are cut at ASCII white space, and each span that differs is encoded once a task.

The vocabulary's tokenizer drops white space and never joins characters across it, and none of its added tokens holds any (which
is checked when it is loaded): cut behind a white-space character, the tokens of a text are those of its parts. So two chunks may be spliced at a place p in their
overlap if the character before p is white space that both have seen: the left one's tokens up to p and the right one's from p
are the text's own. Both encodings of the overlap behind p are compared as well, up to the last white space both know. Where
the overlap has no such place (one endless word), it is doubled, at last to the start of the left chunk, which then grows.

Rows: a text of null counts as empty, with 0 bytes and 0 tokens. Repeated rows give repeated results. Extra columns are not
read. A task holds ``MB`` of text, or one longer text and the tokens of one chunk of it, at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skyfence.llm.common import by_bytes, lean, per_worker
from skyfence.llm.letters import encoded as encoded_values
from skyfence.llm.letters import raw, rows_of, runs

#: White space in the sense of the normaliser's and the splitter's patterns.
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

#: Text that a task takes in at once.
MB = 12.0

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True

Tokens = list[tuple[int, int, int]]  # start, end, id


def encoded(tokenizer: Tokenizer, text: str, start: int, end: int) -> Tokens:
    """Tokens of text[start:end] with their places in the whole text."""
    e = tokenizer.encode(text[start:end], add_special_tokens=False)
    return [(a + start, b + start, i) for (a, b), i in zip(e.offsets, e.ids)]


def splice_at(text: str, left: Tokens, right: Tokens, start: int, end: int) -> int | None:
    """A common boundary inside the overlap text[start:end], or None.

    Boundaries lie behind white space. The first is taken at which both chunks have the same tokens from there to the last
    white space of the overlap.
    """
    places = [m.end() for m in SPACE.finditer(text, start, end)]
    if not places:
        return None
    last = places[-1]
    mine = [t for t in left if start <= t[0] and t[1] <= last]
    other = [t for t in right if t[1] <= last]
    for p in places[:-1] or places:
        if [t for t in mine if t[0] >= p] == [t for t in other if t[0] >= p]:
            return p
    return None


def count_tokens(tokenizer: Tokenizer, text: str, chunk: int = 32_768, overlap: int = 256) -> int:
    """Number of tokens of the whole text, equal to encoding it at once."""
    if len(text) <= chunk + overlap:
        return len(tokenizer.encode(text, add_special_tokens=False))
    done, begin, end = 0, 0, chunk  # tokens before ``begin`` are counted; text[begin:end] is the chunk at hand
    left = encoded(tokenizer, text, begin, end)
    while end < len(text):
        wide = overlap
        while True:
            start, stop = max(begin, end - wide), min(len(text), end - wide + chunk + wide)
            if start == begin:  # no place in the whole chunk: make it longer
                end = min(len(text), begin + 2 * (end - begin))
                left = encoded(tokenizer, text, begin, end)
                break
            right = encoded(tokenizer, text, start, stop)
            place = splice_at(text, left, right, start, end)
            if place is not None:
                done += sum(t[1] <= place for t in left)
                begin, end, left = place, stop, [t for t in right if t[0] >= place]
                break
            wide *= 2
    return done + len(left)


def check_vocabulary(tokenizer: Tokenizer) -> None:
    """Raise unless tokens of a text are those of its parts between white space, which everything here rests on."""
    for token in tokenizer.get_added_tokens_decoder().values():
        if SPACE.search(token.content) or token.lstrip or token.rstrip:
            raise ValueError(f"the added token {token.content!r} reaches across white space")
    ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    for space in filter(SPACE.fullmatch, map(chr, range(0x3001))):
        for left, right in (("a", "b"), ("1", "'s"), ("\u00e9.", "\u0301x"), (",", space)):
            if ids(left + space + right) != ids(left) + ids(right):
                raise ValueError(f"the vocabulary joins tokens across the white space {space!r}")


class SpanCounts:
    """Tokens of spans between ASCII white space. Each span that differs goes through the library once; the first ones are remembered."""

    def __init__(self, tokenizer: Tokenizer, most: int = 300_000):
        self.tokenizer, self.most, self.spans, self.tokens = tokenizer, most, pa.array([], pa.large_binary()), np.empty(0, np.int64)

    def of(self, spans: pa.Array) -> np.ndarray:
        """Tokens of each of some distinct spans."""
        known = pc.index_in(spans, value_set=self.spans)
        fresh = spans.filter(pc.is_null(known))
        made = self.tokenizer.encode_batch_fast([b.decode() for b in fresh.to_pylist()], add_special_tokens=False)
        made = np.fromiter(map(len, made), np.int64, len(fresh))
        out = np.zeros(len(spans), np.int64)
        old = pc.is_valid(known).to_numpy(zero_copy_only=False)
        out[old] = self.tokens[known.drop_null().to_numpy()]
        out[~old] = made
        if len(self.spans) + len(fresh) <= self.most:
            self.spans, self.tokens = pa.concat_arrays([self.spans, fresh]), np.append(self.tokens, made)
        return out

    def rows(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        data, places = raw(texts)
        found, at = runs(data, places, ~_BLANK[data], lower=False)
        code, distinct = encoded_values(found)
        return np.bincount(rows_of(at, places), weights=self.of(distinct)[code], minlength=len(texts)).astype(np.int64)


def count_documents(docs: DataFrame, vocabulary: str, limit: int = 2048, chunk: int = 32_768, overlap: int = 256) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text. ``vocabulary``: a tokenizers file, sent to the executors whole (under 2 MB here)."""
    with open(vocabulary, "rb") as f:
        content = f.read()
    check_vocabulary(Tokenizer.from_str(content.decode()))
    sent = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark hands out the cores
        tokenizer = per_worker(("tokenizer", vocabulary), lambda: Tokenizer.from_str(sent.value.decode()))
        spans = SpanCounts(tokenizer)
        for batch in batches:
            for part in by_bytes(batch, "text", MB):
                texts = part.column("text")
                huge = pc.greater(pc.utf8_length(texts), chunk)
                counts = spans.rows(pc.if_else(huge, "", texts))
                for i in np.flatnonzero(huge.to_numpy(zero_copy_only=False)):
                    counts[i] = count_tokens(tokenizer, texts[int(i)].as_py(), chunk, overlap)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(counts > limit, pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(lean(run), f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
