"""Prefix encoder against the rank files' own library, and edits against encoding anew."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from skyfence.llm.bpe import EditableText, PrefixEncoder, encode_documents, load_ranks

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "b", "'", "s", "l", "r", "e", " ", "\n", "\t", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\xe9", "\u65e5", "1", "\xb2", "!", "#", "\U0001d518", "e\u0301", "the", "ing", "  ", "\r\n", "\u200b", "\ufeff", "aaaaaaa"]


@pytest.fixture(scope="module")
def pair():
    with open(PATH, "rb") as f:
        ranks = load_ranks(f.read())
    return PrefixEncoder(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_library(pair):
    own, library = pair
    r = random.Random(7)
    for _ in range(1500):
        text = "".join(r.choice(PARTS) for _ in range(r.randint(0, 60)))
        assert own.encode(text) == library.encode_ordinary(text), repr(text)
        assert own.decode(own.encode(text)) == text.encode()


def test_every_token_encodes_to_itself(pair):
    own, _ = pair
    for token, rank in list(own.ranks.items())[::37]:
        assert own.walk_back(own.extend(token, [])) == [rank]


def test_long_run_without_space(pair):
    own, library = pair
    text = "ab" * 20_000 + "#" * 5000
    assert own.encode(text) == library.encode_ordinary(text)


def test_edits_equal_encoding_anew(pair):
    own, library = pair
    r = random.Random(3)
    for _ in range(400):
        text = EditableText(own, "".join(r.choice(PARTS) for _ in range(r.randint(0, 40))))
        for _ in range(4):
            a = r.randint(0, len(text.text))
            b = r.randint(a, min(len(text.text), a + 5))
            text.replace(a, b, "".join(r.choice(PARTS) for _ in range(r.randint(0, 4))))
            assert text.ids() == library.encode_ordinary(text.text)
        text.append("'l")
        text.append("l go")
        assert text.ids() == library.encode_ordinary(text.text)


def test_edit_recomputes_little(pair):
    own, _ = pair
    r = random.Random(1)
    piece = bytes(r.choice(b"abcdeht ") for _ in range(4000))
    table = own.extend(piece, [])
    new, fresh, computed = own.edited(piece, table, 100, 103, b"zz")
    assert fresh == own.extend(new, []) and computed < 600


def test_rows(spark, pair):
    _, library = pair
    rows = [(1, None), (2, ""), (3, "Ab c"), (3, "Ab c"), (None, "x" * 70_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "1 as ids", "2 as n_tokens", "text as chunk")
    got = [tuple(x) for x in encode_documents(df, PATH, public_tokenizers.PATTERN).drop("ids").collect()]
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert encode_documents(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_few_remembered_pieces(spark):
    r = random.Random(11)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 80))) for _ in range(120)] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    full, lean = (sorted(map(tuple, encode_documents(docs, PATH, public_tokenizers.PATTERN, with_ids=False, **more).collect())) for more in ({}, {"memo": 20}))
    assert full == lean
    with open(PATH, "rb") as f:
        own = PrefixEncoder(load_ranks(f.read()), public_tokenizers.PATTERN, memo=20)
    for text in texts:
        own.packed(text or "")
        assert max(len(own._chunks), len(own._pieces), len(own._last)) <= 20 * 2 + 200 and len(own._fits) <= 7 * 20 + 1
