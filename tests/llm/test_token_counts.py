"""Chunked counts against encoding the whole text at once."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skyfence.llm.token_counts import SpanCounts, check_vocabulary, count_documents, count_tokens, splice_at

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["the ", "Ingthe", "é", "É ", " ", "'s ", "12 ", "345", "<|endoftext|>", "<|end", "oftext|> ", "\n\n", "Σ ", "ß", "日本 ", "#$% ", "…", "İ "]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("chunk,overlap", [(40, 8), (64, 2), (200, 30)])
def test_chunks(tokenizer, chunk, overlap):
    r = random.Random(chunk)
    for _ in range(120):
        text = "".join(r.choice(PARTS) for _ in range(r.randint(1, 400)))
        assert count_tokens(tokenizer, text, chunk, overlap) == len(tokenizer.encode(text, add_special_tokens=False)), repr(text)


def test_endless_word_widens(tokenizer):
    for text in ("ab" * 3000, "x" * 500 + " " + "y" * 2000, " " * 3000, "7" * 900 + "word " * 300):
        assert count_tokens(tokenizer, text, 100, 10) == len(tokenizer.encode(text, add_special_tokens=False))


def test_no_place_without_space():
    assert splice_at("abcdef", [], [], 0, 6) is None


def test_rows(spark, tokenizer):
    rows = [(1, None), (2, ""), (3, "Hello  world"), (3, "Hello  world"), (None, "wörter und mehr " * 6000), (5, "<|endoftext|> a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as n_tokens", "1 as chunk")
    got = sorted((tuple(r) for r in count_documents(df, PATH).collect()), key=str)
    want = []
    for i, t in rows:
        n = len(tokenizer.encode(t or "", add_special_tokens=False))
        want.append((i, len((t or "").encode()), n, n > 2048))
    assert got == sorted(want, key=str)
    assert count_documents(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("most", [0, 5, 300_000])
def test_spans(tokenizer, most):
    import pyarrow as pa

    r, spans = random.Random(most), SpanCounts(tokenizer, most)
    extra = ["<|ENDOFTEXT|>", "<|endoftext|>x", "\x85", "\u00a0", "\x1c", "\u0301", "\x00", "a'S", "\u200b", "\ufeff", "\u2028", "DON'T ", "\u1100\u1161"]
    for _ in range(40):
        texts = ["".join(r.choice(PARTS + extra) for _ in range(r.randint(0, 60))) for _ in range(30)]
        assert spans.rows(pa.array([*texts, None])).tolist() == [len(tokenizer.encode(t, add_special_tokens=False)) for t in texts] + [0]


def test_all_documents_as_the_library(spark, tokenizer):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = df.select("doc_id", "text").collect()
    want = {r["doc_id"]: len(tokenizer.encode(r["text"] or "", add_special_tokens=False)) for r in rows}
    for chunk in (300, 32_768):
        assert {r["doc_id"]: r["n_tokens"] for r in count_documents(df, PATH, chunk=chunk).collect()} == want


def test_vocabulary_is_checked(tokenizer):
    check_vocabulary(tokenizer)
    with pytest.raises(ValueError):
        check_vocabulary(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    from tokenizers import AddedToken

    other = Tokenizer.from_file(PATH)
    other.add_tokens([AddedToken("two words")])
    with pytest.raises(ValueError):
        check_vocabulary(other)
