"""Languages of pages with known ones, and of pages that only their host or declaration tells."""

import math
from collections import Counter

import numpy as np
import pytest

from skyfence.llm.html_text import best_path, extract
from skyfence.llm.language_id import CELLS, cells, declared, identify, text_model
from skyfence.llm.markup import Page

EN = "the house and the garden were there when they came to the water with their mother "
DE = "der garten und das haus waren dort als sie mit ihrer mutter zu dem wasser kamen "
ROWS = [(i, (EN if i % 2 else DE) * 3, "en" if i % 2 else "de") for i in range(20)] + [(90, None, "en"), (91, "x", None), (92, "", "de")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string").selectExpr("*", "1 as cell", "'q' as host")


def page(lang, text):
    return f'<html{lang and f" lang={chr(34)}{lang}{chr(34)}"}><body><article><p>{text}</p></article></body></html>'


def test_declared():
    assert declared('<!DOCTYPE html><HTML dir=ltr LANG="de-AT">') == "de" and declared("<html lang=fr>") == "fr" and declared("<html><p lang=en>") == ""
    assert declared('<meta http-equiv="Content-Language" content="es">') == "es"


def test_model(docs):
    langs, table = text_model(docs)
    assert langs == ["de", "en"] and np.allclose(np.exp(table).sum(0), 1)
    assert table[cells(EN)].mean(0).argmax() == 1 and table[cells(DE)].mean(0).argmax() == 0


def test_pages(spark, docs):
    rows = [(i, f"https://a.site.de/{i}", page("de", DE)) for i in range(12)] + [(100 + i, f"https://b.other.com/{i}", page("en", EN)) for i in range(12)]
    rows += [(200, "https://a.site.de/x", page("", "")), (201, "https://b.other.com/x", None), (202, None, page("de", "...")), (203, "https://new.site.de/", page("", "12")), (204, "https://b.other.com/y", page("en", DE)), (5, "https://a.site.de/5", page("de", DE))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' as lang", "1 as first", "2 as domain")
    got = {r.page_id: r for r in identify(df, docs).collect()}
    assert identify(df, docs).count() == len(rows)
    assert all(got[i].lang == "de" and got[100 + i].lang == "en" for i in range(12))
    assert (got[200].lang, got[201].lang, got[202].lang, got[203].lang, got[204].lang) == ("de", "en", "de", "de", "de")
    assert all(0 < r.probability <= 1 for r in got.values())
    assert got[202].host == "" and got[201].n_chars == 0


def test_nothing(spark, docs):
    pages = spark.createDataFrame([(1, "https://a.b/", page("en", EN))], "page_id bigint, url string, html string")
    assert identify(pages.limit(0), docs).count() == 0
    one = identify(pages, docs.limit(0)).first()
    assert (one.lang, one.text_lang, one.declared, one.suffix, one.n_chars) == (None, None, "en", "b", len(EN.strip()))


def test_fusion_against_the_definition(spark, docs):
    rows = [(i, f"https://{'ab'[i % 2]}.{'site' if i % 3 else 'other'}.{'de' if i % 5 else 'com'}/{i}", page(("de", "en", "", "fr")[i % 4], (DE, EN, "das the")[i % 3][: 5 + 7 * i])) for i in range(40)]
    rows += [(100, None, None), (101, "https://a.site.de/x", ""), (3, rows[3][1], rows[3][2])]
    grams = {lang: Counter(int(c) for _, t, at in ROWS if at == lang and t for c in cells(t)) for lang in ("de", "en")}
    size = {lang: sum(n.values()) + CELLS / 2 for lang, n in grams.items()}

    def told(html):
        at = cells(extract(Page(html or ""), best_path(Page(html or ""))))
        logs = [sum(math.log((grams[lang][int(c)] + 0.5) / size[lang]) for c in at) / max(1, len(at)) * math.sqrt(len(at)) for lang in ("de", "en")]
        top = max(logs)
        shares = [math.exp(x - top) for x in logs]
        return logs, [x / sum(shares) for x in shares]

    got = identify(spark.createDataFrame(rows, "page_id bigint, url string, html string"), docs).collect()
    host = {r.page_id: r.host for r in got}
    read = [(i, host[i], ".".join(host[i].split(".")[-2:]), host[i].split(".")[-1], declared(html or ""), *told(html)) for i, _, html in rows]
    want = []
    for me in read:
        others = [r for r in read if r is not me]
        among = lambda k: [sum(r[6][x] for r in others if k is None or r[k] == me[k]) for x in (0, 1)]
        every = among(None)
        prior = [(n + 1) / (sum(every) + 2) for n in every]
        for k, weight in ((2, 20.0), (1, 5.0)):
            n = among(k)
            prior = [(n[x] + weight * prior[x]) / (sum(n) + weight) for x in (0, 1)]
        log = [me[5][x] + math.log(prior[x]) for x in (0, 1)]
        for k in (3, 4):
            kinds, n = len({r[k] for r in read}), among(k)
            log = [log[x] + math.log((n[x] + 1) / (every[x] + kinds)) for x in (0, 1)]
        p = [math.exp(x - max(log)) for x in log]
        want.append((me[0], ("de", "en")[p.index(max(p))], max(p) / sum(p)))
    mine = sorted((r.page_id, r.lang, r.probability) for r in got)
    assert [m[:2] for m in mine] == [w[:2] for w in sorted(want)]
    assert [m[2] for m in mine] == pytest.approx([w[2] for w in sorted(want)], rel=1e-6)
