"""Byte-level BPE by prefix dynamic programming.

For a piece of bytes, ``last[i]`` is the last token of the encoding of the first ``i + 1`` bytes. It is the only token that
ends there and fits the last token of the prefix before it, so one table holds the encodings of all prefixes: bytes can be
appended without touching what is there, and after an edit the table is recomputed only until it agrees with the old one
over as many bytes as the longest token has.

Rows: a text of null counts as empty (no tokens, the hash of no bytes). Repeated rows give repeated results. Texts of any
length pass in one piece through one task, with memory proportional to that text. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfence.llm.common import lean, slices

#: White space as Unicode's White_Space property has it, which the pattern of the rank files means by \s.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Cuts of the pattern that depend on white space alone; what lies between is cut again by the full pattern.
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


class PrefixEncoder:
    """Encoder for one vocabulary: ``ranks`` maps a token's bytes to its id, the merge order."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 300_000):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.longest = max(map(len, ranks))
        self.tails = {token[i:] for token in ranks for i in range(len(token))}
        self.pattern = regex.compile(pattern)
        self.memo_size = memo
        self._chunks: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}
        self._last: dict[bytes, int] = {}
        self._fits: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a single byte."""
        if token not in self._halves:
            parts = [self.ranks[bytes((b,))] for b in self.bytes_of[token]]
            while len(parts) > 2:
                joined = [self.ranks.get(self.bytes_of[a] + self.bytes_of[b], token) for a, b in zip(parts, parts[1:])]
                best = min(joined)
                if best >= token:
                    raise ValueError(f"no merges lead to token {token}")
                at = joined.index(best)
                parts[at : at + 2] = [best]
            self._halves[token] = tuple(parts) if len(parts) == 2 else None
        return self._halves[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether encoding the bytes of both leaves exactly this pair.

        Undo merges beside the seam, the latest first (of equal ranks the right one, as merging goes from the left). If at some
        moment a merge across the seam came before the merge undone last, encoding would have made it.
        """
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 7 * self.memo_size:
                self._fits.clear()
            known = self._fits[key] = self._seam_holds(left, right)
        return known

    def _seam_holds(self, left: int, right: int) -> bool:
        bound = len(self.bytes_of)  # a merge across the seam with a rank below this would win
        while True:
            across = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if across is not None and across < bound:
                return False
            of_left, of_right = self.halves(left), self.halves(right)
            if of_left and (not of_right or left > right):
                bound, left = left, of_left[1]
            elif of_right:
                bound, right = right + 1, of_right[0]
            else:
                return True

    def last_token(self, piece: bytes, end: int, last) -> int:
        """Last token of piece[:end]; ``last(i)`` gives that of the shorter prefix piece[:i]."""
        ranks, tails = self.ranks, self.tails
        for start in range(end - 1, -1, -1):
            part = piece[start:end]
            if part not in tails:
                break
            token = ranks.get(part)
            if token is not None and (start == 0 or self.fits(last(start), token)):
                return token
        raise ValueError("the vocabulary lacks a byte")

    def extend(self, piece: bytes, last: list[int], stop: int | None = None) -> list[int]:
        """Fill ``last`` for further prefixes of ``piece``, from where it ends."""
        before = lambda end: last[end - 1]
        for end in range(len(last) + 1, (len(piece) if stop is None else stop) + 1):
            last.append(self.last_token(piece, end, before))
        return last

    def walk_back(self, last: list[int]) -> list[int]:
        """The encoding of the whole piece from its table."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[last[end - 1]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > 64:
            return self.walk_back(self.extend(piece, []))
        known = self._last  # prefix -> last token, shared by all pieces; with a prefix all shorter ones are known
        end = len(piece)
        while end and piece[:end] not in known:
            end -= 1
        before = lambda i: known[piece[:i]]
        for at in range(end + 1, len(piece) + 1):
            known[piece[:at]] = self.last_token(piece, at, before)
        out, at = [], len(piece)
        while at:
            out.append(token := known[piece[:at]])
            at -= len(self.bytes_of[token])
        if len(known) > 2 * self.memo_size:
            known.clear()
        return out[::-1]

    def edited(self, old: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int], int]:
        """Replace old[start:end] by ``new``: the piece, its table, and how many entries were computed."""
        piece = old[:start] + new + old[end:]
        table, shift, agree = last[:start], len(new) - (end - start), 0
        while len(table) < len(piece):
            self.extend(piece, table, len(table) + 1)
            at = len(table) - 1
            past = at - shift >= end  # beyond the edit, where the old table has an entry for the same byte
            agree = agree + 1 if past and last[at - shift] == table[at] else 0
            if agree >= self.longest:
                done = len(table)
                return piece, table + last[done - shift :], done - start
        return piece, table, len(piece) - start

    def packed(self, text: str) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers."""
        memo, pieces, size = self._chunks, self._pieces, self.memo_size
        out = []
        for chunk in CHUNK.findall(text):
            ids = memo.get(chunk)
            if ids is None:
                ids = b""
                for piece in self.pattern.findall(chunk):
                    part = pieces.get(piece)
                    if part is None:
                        part = array("I", self.encode_piece(piece.encode())).tobytes()
                        if len(piece) < 64:
                            pieces[piece] = part
                    ids += part
                if len(chunk) < 64:
                    memo[chunk] = ids
            out.append(ids)
        if len(memo) > size or len(pieces) > size:
            memo.clear()
            pieces.clear()
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return memoryview(self.packed(text)).cast("I").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class EditableText:
    """A text with its pieces and their tables, kept in step while the text is appended to or edited."""

    #: An appended letter can turn up to three pieces into one ("'", "l", then "l").
    REACH = 3

    def __init__(self, encoder: PrefixEncoder, text: str = ""):
        self.encoder, self.text = encoder, ""
        self.starts: list[int] = []
        self.tables: list[list[int]] = []
        self.append(text)

    def ids(self) -> list[int]:
        return [t for table in self.tables for t in self.encoder.walk_back(table)]

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> int:
        """Replace text[start:end]; returns how many pieces were cut anew."""
        text, shift = self.text[:start] + new + self.text[end:], len(new) - (end - start)
        first = max(0, sum(s < start for s in self.starts) - self.REACH)
        old = {s + shift: i for i, s in enumerate(self.starts) if s >= end}
        known = {self.text[s:e]: t for s, e, t in zip(self.starts[first:], [*self.starts[first + 1 :], len(self.text)], self.tables[first:])}
        at = self.starts[first] if first < len(self.starts) else 0
        starts, tables, rest = self.starts[:first], self.tables[:first], len(self.starts)
        for match in self.encoder.pattern.finditer(text, at):
            if match.start() >= start + len(new) and match.start() in old:
                rest = old[match.start()]  # from a shared cut on, everything is as it was
                break
            piece = match.group()
            grown = next((t for p, t in known.items() if piece.startswith(p)), [])
            starts.append(match.start())
            tables.append(self.encoder.extend(piece.encode(), list(grown)))
        fresh = len(starts) - first
        self.starts, self.tables, self.text = starts + [s + shift for s in self.starts[rest:]], tables + self.tables[rest:], text
        return fresh


def load_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = True, memo: int = 300_000) -> DataFrame:
    """doc_id, n_tokens, ids (binary, optional), ids_sha256, decoded_sha256 of every text; no shuffle, one pass.

    The rank file is read by the driver and sent to the executors whole: its size is that of a vocabulary, under 2 MB here.
    ``memo``: pieces that a task remembers; fewer take less memory and more time, the results are the same.
    """
    with open(ranks_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PrefixEncoder(load_ranks(sent.value), pattern, memo)  # a fraction of a second, and a worker between tasks holds nothing
        for batch in batches:
            for start, texts in slices(batch.column("text")):
                rows = []
                for text in texts:
                    ids = encoder.packed(text or "")
                    plain = encoder.decode(memoryview(ids).cast("I").tolist())
                    rows.append((len(ids) // 4, ids, hashlib.sha256(ids).hexdigest(), hashlib.sha256(plain).hexdigest()))
                counts, ids, a, b = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, len(texts)), pa.array(counts, pa.int64()), pa.array(ids if with_ids else [None] * len(ids), pa.binary()), pa.array(a), pa.array(b)],
                    ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        lean(run), f"doc_id {kind}, n_tokens bigint, ids binary, ids_sha256 string, decoded_sha256 string")
    return out if with_ids else out.drop("ids")
