"""Language of pages by fusing evidence: text, declared language, address suffix, and what its host's pages speak.

1. Character 3-grams of all documents are counted by language (hashed into a fixed number of cells), which gives the likelihood of
   a page's main text under each language.
2. The text alone gives each page a first posterior. Grouped sums of these posteriors estimate how languages go with declared
   languages and address suffixes, and which languages a host, its domain, and all pages use.
3. The posterior of a page multiplies the text's likelihood, P(declared | language), P(suffix | language), and a prior of its
   host that is smoothed towards its domain's, which is smoothed towards that of all pages. A page's own share is taken out
   of the sums before they speak about it.

A text's 3-grams depend on each other: its log-likelihood counts as the mean over them times the square root of their number.

Rows: markup of null, or without text, has no text evidence; the rest decides. An address of null gives the empty host and suffix, a
missing declaration the value "". Documents without text or language are not learned from. Repeated pages count each. Without
any language to learn, language and probability are null and the rest is as always. Extra columns are not read. Hot hosts are combined before they are shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfence.llm.common import by_bytes, stored
from skyfence.llm.html_text import best_path, extract, host_of
from skyfence.llm.markup import Page

CELLS = 1 << 14
#: The languages of the documents are gathered on the driver; more than this are an error in the column.
MOST_LANGUAGES = 1000
DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", re.I)
META = re.compile(r"<meta\b[^>]*http-equiv\s*=\s*[\"']?content-language[\"']?[^>]*content\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", re.I)


def cells(text: str) -> np.ndarray:
    """Cells of a text's character 3-grams, white space as one blank and one at each end."""
    text = " ".join(text.lower().split())
    if not text:
        return np.zeros(0, np.int64)
    c = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    mixed = (c[:-2] * np.uint32(0x9E3779B1) + c[1:-1]) * np.uint32(0x85EBCA6B) + c[2:]
    return ((mixed * np.uint32(0xC2B2AE35)) >> np.uint32(18)).astype(np.int64)


def text_model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and log probability of each cell under each: a table of CELLS x languages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(CELLS, np.int64))
        for batch in batches:
            for part in by_bytes(batch, "text"):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    sums[lang] += np.bincount(cells(text), minlength=CELLS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], ["lang", "cell", "n"])

    known = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = stored(known.mapInArrow(count, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n")), "language-cells")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    table = np.full((CELLS, len(langs)), 0.5)
    for r in counts.groupBy("lang").agg(F.collect_list(F.struct("cell", "n")).alias("cells")).collect():  # CELLS numbers a language
        table[[c["cell"] for c in r["cells"]], langs.index(r["lang"])] += [c["n"] for c in r["cells"]]
    return langs, np.log(table / table.sum(0))


def declared(html: str) -> str:
    m = DECLARED.search(html) or META.search(html)
    return m[1].lower() if m else ""


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def read_pages(pages: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """page_id, url, host, domain, suffix, declared, n_chars, evidence (log-likelihoods), first (posterior from the text alone)."""
    sent = pages.sparkSession.sparkContext.broadcast(model)  # CELLS x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            for part in by_bytes(batch, "html"):
                said, size, logs = [], [], []
                for html in part.column("html").to_pylist():
                    page = Page(html or "")
                    text = extract(page, best_path(page))
                    at = cells(text)
                    said.append(declared(html or ""))
                    size.append(len(text))
                    logs.append(table[at].mean(0) * np.sqrt(len(at)) if len(at) else np.zeros(len(langs)))
                logs = np.array(logs).reshape(len(said), len(langs))
                lists = pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("page_id", "url", "host")), pa.array(said), pa.array(size, pa.int64()), pa.array(logs.tolist(), lists), pa.array((softmax(logs) if langs else logs).tolist(), lists)],
                    ["page_id", "url", "host", "declared", "n_chars", "evidence", "first"])

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html"))
    read = rows.mapInArrow(run, f"page_id {kind}, url string, host string, declared string, n_chars bigint, evidence array<double>, first array<double>")
    return read.select("*", F.substring_index("host", ".", -2).alias("domain"), F.substring_index("host", ".", -1).alias("suffix"))


def identify(pages: DataFrame, docs: DataFrame, towards_domain: float = 5.0, towards_all: float = 20.0, alpha: float = 1.0) -> DataFrame:
    """page_id, url, host, declared, suffix, n_chars, lang, probability, text_lang of every page.

    ``towards_domain``, ``towards_all``: pages that the wider group counts as in the prior of the narrower; ``alpha``: smoothing of the likelihoods.
    """
    langs, model = text_model(docs)
    if not langs:
        none = F.lit(None).cast("string")
        return read_pages(pages, langs, model).select(
            "page_id", "url", "host", "declared", "suffix", "n_chars", none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"))
    rows = stored(read_pages(pages, langs, model), "page-languages")
    vector = rows.select("host", "domain", "suffix", "declared", array_to_vector("first").alias("v"))
    sums = lambda key: vector.groupBy(key).agg(vector_to_array(Summarizer.sum(F.col("v"))).alias(f"{key}_sum"))
    total = vector.groupBy(F.lit("all")).agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("s")).first()  # no row without pages
    total = np.array(total["s"] if total else [0.0] * len(langs))
    for key in ("host", "domain", "suffix", "declared"):  # written, so that a hot key meets a plain table and Spark can split it or broadcast
        rows = rows.join(stored(sums(key), f"language-{key}"), key)
    kinds = {key: max(1, vector.select(key).distinct().count()) for key in ("suffix", "declared")}

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda c: np.array(batch.column(c).to_pylist(), float)
            own = get("first")
            rest = lambda c: np.maximum(get(c) - own, 0.0)  # noqa: E731  without the page itself
            every = np.maximum(total - own, 0.0)
            prior = (every + 1) / (every + 1).sum(1, keepdims=True)
            for key, weight in (("domain", towards_all), ("host", towards_domain)):
                n = rest(f"{key}_sum")
                prior = (n + weight * prior) / (n.sum(1, keepdims=True) + weight)
            log = get("evidence") + np.log(prior)
            for key in ("suffix", "declared"):
                log += np.log((rest(f"{key}_sum") + alpha) / (every + alpha * kinds[key]))
            p = softmax(log)
            best, first = p.argmax(1), own.argmax(1)
            name = lambda at: pa.array([langs[i] for i in at])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "url", "host", "declared", "suffix", "n_chars")), name(best), pa.array(p[np.arange(len(p)), best]), name(first)],
                ["page_id", "url", "host", "declared", "suffix", "n_chars", "lang", "probability", "text_lang"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(fuse, f"page_id {kind}, url string, host string, declared string, suffix string, n_chars bigint, lang string, probability double, text_lang string")
