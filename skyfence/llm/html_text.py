"""Main text of pages by paths that a host's pages agree on.

Every page scores its containers and votes for the generalised tag-and-class path that holds its article best. Spark adds up the
votes by host and path; paths with a fair share of a host's votes win there. Each page is then extracted again by the winning
path that most of its host's pages chose among those it has; a page that has none of them keeps to its own choice. Where other
pages of the host chose the page's own path too, a winner replaces it only if it holds a comparable part of the page.

Rows: markup of null counts as empty and gives an empty text, as does a page without an article. An address of null or without
host neither votes nor is voted on: the page keeps to its own choice. Repeated pages vote each. Extra columns are not read. Pages pass one at a time through a task.
Hot hosts: each page's vote is one narrow row, which meets its host's few paths under a salted key;
pages meet these rows under a hash of the row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfence.llm.common import by_bytes, stored
from skyfence.llm.markup import CONTAINER, Page

#: Pages of a host are dealt over so many keys when they meet its paths.
SALTS = 64
#: A winner replaces a page's own choice only with so much of its score.
COMPARABLE = 0.25
#: Paths of the root and of the html element: they hold every page of a host whole, so nobody votes for them.
LAST_RESORT = re.compile(r"(/html[^/]*)?")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def path_scores(page: Page) -> dict[str, tuple[float, int, bool]]:
    """(score of the blocks below, depth, inside or at an article element) of each container path; html and the root count as containers too.

    All articles beside each other share one more path, whatever their classes.
    """
    out: dict[str, list] = {}
    for e in page.elements:
        if e.score > 0 and (e.tag in CONTAINER or e.tag in ("html", "")):
            for path in (e.path, e.any_article):
                if path is not None:
                    out.setdefault(path, [0.0, e.depth, e.tag in ("article", "main")])[0] += e.score
    return {k: tuple(v) for k, v in out.items()}


def prose(text: str, linked: int) -> bool:
    """A block of sentences rather than of links and labels."""
    return text.count(" ") >= 9 and linked <= 0.2 * len(text) and any(map(text.__contains__, ".!?\u3002"))


def below(page: Page, path: str) -> set[int]:
    """Elements at or below a path."""
    inside: set[int] = set()
    for e in page.elements:
        if e.path == path or e.any_article == path or e.parent is not None and id(e.parent) in inside:
            inside.add(id(e))
    return inside


def best_path(page: Page) -> str | None:
    """Articles that hold half of what the page says, or else the deepest container that holds four fifths, widened while prose stands beside it.

    Of articles beside each other all are taken, unless one holds four fifths of them. The last resort, where body and other tags are
    left out, is the html element or the root (path "").
    """
    scores = path_scores(page)
    most = max((s for s, _, _ in scores.values()), default=0.0)
    if most <= 0:
        return None
    marked = {p: (s, d) for p, (s, d, a) in scores.items() if a and s >= 0.5 * most}
    if marked:
        best = max(s for s, _ in marked.values())
        return max((p for p, (s, _) in marked.items() if s >= 0.8 * best), key=lambda p: (not p.endswith("/article.*"), marked[p][0], -marked[p][1], p))
    path = max((d, s, p) for p, (s, d, _) in scores.items() if s >= 0.8 * most)[2]
    inside = below(page, path)
    beside: Counter[int] = Counter(id(owner) for text, owner, linked in page.blocks if id(owner) not in inside and (prose(text, linked) or owner.tag == "h1"))
    every = sum(beside.values())
    if every:  # up to the innermost container that holds all of these
        for e in reversed(page.elements[1:]):
            beside[id(e.parent)] += beside[id(e)]
        at = next(e for e in page.elements if path in (e.path, e.any_article)).parent
        while at is not None and (beside[id(at)] < every or at.path not in scores):
            at = at.parent
        path = at.path if at is not None else path
    return path


def extract(page: Page, path: str | None) -> str:
    inside = below(page, path) if path is not None else set()
    return "\n".join(text for text, owner, _ in page.blocks if id(owner) in inside)


def choose(page: Page, winners: list[str]) -> str | None:
    """The first winning path that holds a comparable part of what the page's own choice holds; the own choice without any."""
    own = best_path(page)
    if own is None:
        return None
    scores = path_scores(page)
    return next((path for path in winners if path in scores and scores[path][0] >= COMPARABLE * scores[own][0]), own)


def own_paths(pages: DataFrame) -> DataFrame:
    """host, page (hash of its row), path: each page's own choice; without pages that have no host or no article."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "html"):
                paths = [best_path(Page(html or "")) for html in part.column("html").to_pylist()]
                paths = [None if path is None or LAST_RESORT.fullmatch(path) else path for path in paths]
                yield pa.RecordBatch.from_arrays([part.column("host"), part.column("page"), pa.array(paths, pa.string())], ["host", "page", "path"])

    return pages.where("host <> ''").select("host", "page", "html").mapInArrow(vote, "host string, page bigint, path string")


def host_paths(votes: DataFrame, least_share: float = 0.1) -> DataFrame:
    """host, paths: those with at least ``least_share`` of the votes (host, path, votes), most votes first (so at most 1 / least_share)."""
    totals = votes.groupBy("host").agg(F.sum("votes").alias("total"))
    fair = votes.join(totals, "host").where(F.col("votes") >= least_share * F.col("total"))
    return fair.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), "path"))), lambda x: x["path"]).alias("paths"))


def extract_pages(pages: DataFrame, least_share: float = 0.1) -> DataFrame:
    """page_id, url, text, n_chars, path of every page."""
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("page", F.xxhash64("host", "html", "url", "page_id"))
    own = stored(own_paths(rows), "own-paths")
    votes = stored(own.where("path is not null").groupBy("host", "path").agg(F.count("*").alias("votes")), "path-votes")
    salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt")
    once = own.dropDuplicates(["page"]).withColumn("salt", F.pmod(F.xxhash64(F.lit("salt"), "page"), F.lit(SALTS)))
    met = once.join(host_paths(votes, least_share).select("*", salts), ["host", "salt"]).select("page", "paths")
    single = rows.where("host = ''").select("page_id", "url", "html", F.lit(None).cast("array<string>").alias("paths"))
    met = rows.where("host <> ''").join(met, "page", "left").select("page_id", "url", "html", "paths").unionByName(single)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "html"):
                texts, chosen = [], []
                for html, paths in zip(*(part.column(c).to_pylist() for c in ("html", "paths"))):
                    page = Page(html or "")
                    chosen.append(choose(page, paths or []))
                    texts.append(extract(page, chosen[-1]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), pa.array(chosen, pa.string())], ["page_id", "url", "text", "n_chars", "path"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return met.mapInArrow(again, f"page_id {kind}, url string, text string, n_chars bigint, path string")
