"""Every stage of the pipeline against its rule on the stage's own input, and the whole against the stages."""

from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from skyfence.llm import quality_model
from skyfence.llm.bpe import load_ranks
from test_jaccard_join import sets_of
from test_quality import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns(steps):
    assert all(s.schema == steps[0].schema for s in steps[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "n-gram Jaccard join", "mixing sources", "byte-level BPE"]


def test_classifier(spark, steps):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    want = {r.doc_id for r in quality_model.classify(steps[0], labels).collect() if r.predicted}
    assert {i for i, _ in rows(steps[1])} == want
    quality = {r.doc_id: r.quality for r in labels.collect()}
    kept = Counter((quality[i], i in want) for i, _ in rows(steps[0]) if i in quality)
    assert kept[1, False] <= 0.02 * (kept[1, True] + kept[1, False]) and kept[0, True] <= kept[0, False]


def test_rules(steps):
    kept = {i for i, _ in rows(steps[2])}
    for i, t in rows(steps[1]):
        assert not (i in kept and brute(t)[-1])
    assert len(kept) >= 0.95 * sum(not brute(t)[-1] for _, t in rows(steps[1]))


def test_groups(steps):
    before, after = sorted(rows(steps[2])), {i for i, _ in rows(steps[3])}
    sets = sets_of(before, 5)
    root = {i: i for i, _ in before}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, _) in enumerate(before):
        for y in range(x):
            if sets[x] and 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y]):
                a, b = sorted((find(i), find(before[y][0])))
                root[b] = a
    assert after == {find(i) for i, _ in before}


def test_mix_and_tokens(spark, steps):
    size = {i: len(t.split()) for i, t in rows(steps[3])}
    taken = Counter(i for i, _ in rows(steps[4]))
    assert max(taken.values()) <= 3 and set(taken) <= set(size)
    assert abs(sum(size[i] * n for i, n in taken.items()) - sum(size.values())) <= 0.5 * 40 * max(size.values())
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(f.read()), special_tokens={})
    text = dict(rows(steps[4]))
    got = steps[5].collect()
    assert Counter(r.doc_id for r in got) == taken
    assert all(r.n_tokens == len(library.encode_ordinary(text[r.doc_id])) for r in got)
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, got))


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0)], spark.read.parquet(f"{SF}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES:
        for x in (df, df.limit(0)):
            assert stage(spark, x, SF).count() <= 3


def test_encoding_takes_few_rows_at_once(spark, steps, monkeypatch):
    seen = {}
    monkeypatch.setattr(corpus_pipeline, "stored", lambda df, name: seen.update({name: spark.conf.get(corpus_pipeline.BATCH)}) or steps[len(seen)])
    before = spark.conf.get(corpus_pipeline.BATCH)
    corpus_pipeline.run(spark, SF)
    assert seen.pop("pipeline-byte-level-BPE") == str(corpus_pipeline.BATCH_ROWS)
    assert set(seen.values()) == {before} and spark.conf.get(corpus_pipeline.BATCH) == before
