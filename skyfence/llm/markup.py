"""A page as text blocks with the containers around them: a forgiving reader for web markup."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from html import unescape

#: What a tag holds. A quote that is not closed where a value may end is an ordinary character, so that the tag ends at the next ">".
INSIDE = r"(?:[^>\"']|\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>])|[\"'])*+"
TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<(?P<raw>script|style|noscript|template|iframe|textarea|xmp|noembed|noframes)\b" + INSIDE + r">.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attributes>" + INSIDE + r")>|<[!?/][^>]*>",
    re.I | re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS_OF_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")

# Elements of the markup language, and words that sites give to what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol "
    "optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
CONTAINER = frozenset("article body div main section td center blockquote".split())
NEVER = frozenset("aside button dialog footer head input menu nav object select svg canvas title audio video".split())
NOT_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar side rail widget "
    "widgets cookie cookies consent gdpr notice notices disclaimer alert popup modal overlay newsletter subscribe signup login comment comments reply replies respond disqus discussion share sharing "
    "social related recommended recommendations pagination pager toolbar search form copyright".split())
#: Of these, words that headings and parts of an article also have in their names. In an article they leave out what is short or mostly links.
ALSO_IN_ARTICLES = frozenset("promotion side rail notice notices disclaimer alert reply replies respond discussion share sharing social related recommended recommendations search form copyright header menu navigation "
    "login signup overlay".split())
#: Words that a compound may have besides those above, as in "related-posts".
IN_COMPOUNDS = frozenset("area articles bar block box buttons container inner items left links list main post posts right section site stories thread title top bottom wrap wrapper".split())
#: Headings, paragraphs and what stands in a line: their ids are slugs.
IN_TEXT = frozenset("h1 h2 h3 h4 h5 h6 p a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var".split())
#: As in "entry-header", which holds the title.
OF_ARTICLE = frozenset("article content entry page post story".split())
#: Links' share of a text, and words, from which and below which a part of an article that is named so is left out.
MOSTLY_LINKS, SHORT = 0.5, 10
NOT_ARTICLE_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar toolbar".split())
#: What a head holds; anything else, or text, ends one that is open, as its end tag may be left out.
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
#: Opening one of the keys closes an open element of the values within the same parent list.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup"),
    "tbody": ("tr", "td", "th", "thead", "tbody"), "thead": ("tbody",), "tfoot": ("tr", "td", "th", "tbody", "thead"),
}
#: Names of a path that are written out; a deeper container goes by the number of names and a hash of all of them.
WRITTEN = 64
#: A part that its tag (form) or a word of its name would leave out stays if it holds so much of what the page says.
MOST = 0.75
SCOPE = frozenset("ul ol dl table select html body article section div".split())


class Element:
    """``out``: False, or why it may be left out: True (always), "name" (unless it holds most of the page), "short" (if it is short or mostly links)."""

    __slots__ = ("tag", "path", "depth", "known", "any_article", "skip", "out", "gone", "parent", "article", "block", "score", "words", "chars", "linked")

    def __init__(self, tag: str, parent: Element | None, name: str | None, out: bool | str, article: bool):
        self.tag, self.parent, self.article, self.out = tag, parent, article, out
        self.skip = parent is not None and (parent.skip or out is True)
        self.gone, self.score, self.words, self.chars, self.linked = False, 0.0, 0, 0, 0
        self.block = self if name is not None or parent is None else parent.block
        self.any_article = None  # the path of all articles beside this one, whatever their classes
        if parent is None:
            self.path, self.depth, self.known = "", 0, 0
        elif name is None:
            self.path, self.depth, self.known = parent.path, parent.depth, parent.known
        else:
            self.depth, self.known = parent.depth + 1, zlib.crc32(name.encode("utf-8", "replace"), parent.known)
            self.path = f"{parent.path}/{name}" if self.depth <= WRITTEN else f"{parent.path.partition('/...')[0]}/...{self.depth}-{self.known:08x}"
            if tag == "article":
                self.any_article = f"{parent.path}/article.*"


def block_score(text: str, linked: int) -> float:
    """Words count, sentences count more, links count nothing."""
    free = max(0.0, 1 - linked / max(1, len(text)))
    words = text.count(" ") + 1
    return free * (words + 2 * min(words / 6, sum(map(text.count, ".,;!?:"))))


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def name_of(tag: str, at: dict[str, str]) -> str:
    """Tag with its classes; numbers in them are generalised, so that "post-17" and "post-18" are one."""
    classes = sorted({re.sub(r"\d+", "#", c.lower()) for c in at.get("class", "").split()})
    return ".".join([tag, *classes])


def words_of_token(token: str) -> list[str]:
    return [w.lower() for w in WORDS_OF_NAME.findall(token)]


def named_so(token: str) -> bool:
    """Whether the whole token is a name of what is not the article: one such word, or a known compound with one."""
    words = words_of_token(token)
    return any(w in NOT_ARTICLE for w in words) and all(w in NOT_ARTICLE or w in IN_COMPOUNDS for w in words)


def left_out(tag: str, at: dict[str, str], in_article: bool) -> bool | str:
    """Whether the element is left out, or what that depends on (see ``Element``)."""
    if tag in NEVER or tag == "header" and not in_article or at.get("role", "").lower() in NOT_ARTICLE_ROLES:
        return True
    if "hidden" in at or at.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", at.get("style", ""), re.I):
        return tag not in ("html", "body", "article", "main")
    if not at or tag in ("html", "body", "article", "main"):
        return "name" if tag == "form" else False
    classes, name = at.get("class", "").split(), at.get("id", "")
    if tag in IN_TEXT:
        found = [c for c in classes if named_so(c)]
        doubtful = all(set(words_of_token(c)) & NOT_ARTICLE <= ALSO_IN_ARTICLES for c in found)
        return False if not found or doubtful and tag not in BLOCK else "short" if doubtful else True
    found = [c for c in [*classes, name] if named_so(c)]
    if in_article:
        if found:
            return "short" if all(set(words_of_token(c)) & NOT_ARTICLE <= ALSO_IN_ARTICLES for c in found) else True
        return "name" if tag == "form" else False
    if any(c in found for c in classes if not set(words_of_token(c)) & OF_ARTICLE):
        return True
    words = [words_of_token(c) for c in classes]
    if tag == "form" or any(w in NOT_ARTICLE for ws in words for w in ws if w != "header" or not set(ws) & OF_ARTICLE):
        return "name"
    if tag == "section":
        return "short" if named_so(name) else False
    if named_so(name):
        return True
    return "name" if any(w in NOT_ARTICLE for w in words_of_token(name)) else False


class Page:
    """``blocks``: (text, element, characters in links) in page order, without what is left out by its element.

    ``elements``: all of them, parents first. Work and memory grow with the page's length, however deep it nests.
    """

    def __init__(self, source: str):
        root = Element("", None, None, False, False)
        self.blocks: list[tuple[str, Element, int]] = []
        self.elements, self.stack, self.open_tags = [root], [root], Counter()
        self.parts, self.links, self.linked = [], 0, 0
        self.owner = root
        at = 0
        for m in TOKEN.finditer(source):
            if m.start() > at:
                self.text(source[at : m.start()])
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if m["end"]:
                self.close(tag)
            else:
                self.open(tag, m["attributes"])
        self.text(source[at:])
        self.flush()
        self.settle()

    def settle(self) -> None:
        """Sum up what each element holds, and drop the blocks of those that are left out for it."""
        self.sum_up()
        if not any(e.out for e in self.elements if not e.skip):
            return
        total = self.elements[0].score
        for e in self.elements[1:]:
            e.gone = e.parent.gone
            if e.out == "name":
                e.gone |= e.score < MOST * total
            elif e.out == "short":
                e.gone |= e.linked >= MOSTLY_LINKS * e.chars or e.words < SHORT and e.tag not in IN_TEXT
        if any(e.gone for e in self.elements):
            self.blocks = [b for b in self.blocks if not b[1].gone]
            self.sum_up()

    def sum_up(self) -> None:
        for e in self.elements:
            e.score, e.words, e.chars, e.linked = 0.0, 0, 0, 0
        for text, e, linked in self.blocks:
            e.score, e.words, e.chars, e.linked = e.score + block_score(text, linked), e.words + text.count(" ") + 1, e.chars + len(text), e.linked + linked
        for e in reversed(self.elements[1:]):
            p = e.parent
            p.score, p.words, p.chars, p.linked = p.score + e.score, p.words + e.words, p.chars + e.chars, p.linked + e.linked

    def text(self, source: str) -> None:
        if self.stack[-1].tag == "head" and source.strip():
            self.close("head")
        top = self.stack[-1]
        if source and not top.skip:
            if not self.parts:
                self.owner = top.block
            self.parts.append(source)
            if self.links:
                self.linked += len(source)

    def flush(self) -> None:
        if self.parts:
            text = " ".join(unescape("".join(self.parts)).split())
            if text:
                self.blocks.append((text, self.owner, self.linked))
        self.parts, self.linked = [], 0

    def open(self, tag: str, source: str) -> None:
        if tag == "body" and self.open_tags["head"] or self.stack[-1].tag == "head" and tag not in IN_HEAD:
            self.close("head")
        if tag == "br":
            self.text(" ")
        if tag in BLOCK:
            self.flush()
            if self.open_tags["p"]:
                self.close("p")
            for other in CLOSES.get(tag, ()):
                self.close(other, SCOPE)
        if tag in VOID or tag in ("html", "body") and self.open_tags[tag]:
            return
        parent, at = self.stack[-1], attributes(source) if source.strip(" /\n\t\r") else {}
        element = Element(tag, parent, name_of(tag, at) if tag in BLOCK else None, left_out(tag, at, parent.article), parent.article or tag in ("article", "main"))
        self.elements.append(element)
        self.stack.append(element)
        self.open_tags[tag] += 1
        self.links += tag == "a"

    def close(self, tag: str, scope: frozenset = frozenset()) -> None:
        """Close the innermost open ``tag`` and what is open inside; an end without a beginning changes nothing."""
        if not self.open_tags[tag]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                gone = self.stack[i:]
                if any(e.tag in BLOCK for e in gone):
                    self.flush()
                for e in gone:
                    self.open_tags[e.tag] -= 1
                    self.links -= e.tag == "a"
                del self.stack[i:]
                return
            if self.stack[i].tag in scope:
                return
