"""Main text of web pages by tag-path ratios.

A page is read once into blocks: runs of text between block-level tags, each with its root-to-leaf tag path.  For every path the text
length and the punctuation of its blocks are added up and divided by their number; the product of both ratios is the path's
score (link text counts for nothing).  The scores, in page order, are smoothed with a Gaussian and compared with their
deviation; blocks above it are content nodes.  The main text is every block of the container that holds the content nodes
(an article if there is one), so that short paragraphs and headings of it stay.  Menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments are told by element, role, class or id, score zero and are left out anywhere; an element told by
class or id alone stays if it wraps the main text (``wrappers``).  A text split into several articles is that of their common container.

Defined cases: a null or empty page, or one without text, gives an empty text; an unfinished tag at the end of a page is dropped;
repeated rows are extracted each; other columns are ignored.  Memory: one page and its blocks.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Container, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Batches, text_bytes, to_batch

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(?P<raw>script|style|textarea|title|iframe|xmp|noembed|noframes)(?=[\s/>])(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+(?:>.*?(?:</(?P=raw)(?=[\s/>])[^>]*(?:>|\Z)|\Z)|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?P<shut>>|\Z)",
    re.S | re.I)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSE_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
            "tbody": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = frozenset("ul ol dl table article section div main body html".split())

SKIP_TAGS = frozenset("head nav footer aside form noscript template svg math button select option dialog menu object canvas audio video frameset".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
SKIP_WORDS = frozenset(
    "ad ads adv adbox adbanner adsense adslot adunit advert adverts advertisement advertisements advertising aside banner breadcrumb breadcrumbs captcha comment comments "
    "commentlist commenting consent cookie cookies copyright disclaimer disqus footer footnav gdpr header hidden legal login masthead menu menubar menus modal nav navbar "
    "navigation navlinks newsletter notice notices notification notifications outbrain overlay pager pagination paywall popup promo promos promoted promotion recommendations "
    "recommended related replies reply respond responses search share sharing sidebar sidebars sidenav signin signup skip social sponsor sponsored sponsors subnav subscribe "
    "subscription taboola toolbar topbar topnav widget widgets".split())
#: Words of reader comments: only nearly the whole of a page makes a wrapper of what they name.
COMMENT_WORDS = frozenset("comment comments commentlist commenting disqus reply replies respond responses".split())
NEGATED = frozenset("has with no without is".split())
MAIN_WORDS = frozenset("article content entry main post story text body".split())
CONTAINERS = frozenset("html body article main section div td center table tbody tr form fieldset".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡\"()]")


class Element:
    __slots__ = ("at", "bad", "inline", "main", "parent", "path", "skip", "tag", "weight")

    def __init__(self, tag: str, attrs: str, parent: Element | None, at: int = 0, spared: Container[int] = ()):
        self.at, self.bad = at, frozenset()
        self.tag, self.parent, self.weight = tag, parent, 0.0
        self.inline = tag in INLINE
        self.skip = parent is not None and parent.skip
        up = parent.path if parent else ()
        self.path = up if self.inline else (*up, tag)
        self.main = 0
        known = {k.lower(): a or b or c or "" for k, a, b, c in ATTRIBUTE.findall(attrs)} if attrs.strip() else {}
        role = known.get("role", "").lower()
        names = [re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", x).lower()) for k in ("class", "id") for x in known.get(k, "").split()]
        inside = "article" in up or "main" in up
        if tag == "article":
            self.main = 3
        elif tag == "main" or role in ("main", "article"):
            self.main = 2
        elif tag in CONTAINERS and any(w in MAIN_WORDS for n in names for w in n):
            self.main = 1
        if tag in ("html", "body"):
            return
        words = {w for n in names if not (n and n[0] in NEGATED) for w in n}
        bad = words & SKIP_WORDS
        if inside or tag in ("article", "main"):
            bad -= {"header"}
        if tag in ("article", "main"):
            bad &= {"comment", "comments", "reply", "replies", "ad", "ads", "advert", "sponsored", "promo", "related", "hidden"}
        style = known.get("style", "").replace(" ", "").lower()
        self.bad = frozenset(bad)
        self.skip |= (bool(bad) and at not in spared) or tag in SKIP_TAGS or (tag == "header" and not inside) or role in SKIP_ROLES or "hidden" in known or \
            known.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style


class Block:
    __slots__ = ("element", "link", "text")

    def __init__(self, element: Element, text: str, link: int):
        self.element, self.text, self.link = element, text, link


def blocks(page: str, spared: Container[int] = ()) -> list[Block]:
    """Text runs between block-level tags, in page order; ``spared``: numbers of the elements whose class and id drop nothing."""
    n_elements = 0
    top = Element("html", "", None)
    stack, out, runs, link = [top], [], [], 0

    def flush() -> None:
        nonlocal runs, link
        by_skip: list[Block] = []
        for element, text in runs:  # an inline part that is left out splits its block
            home = element
            while home.inline and home.parent is not None and home.skip == home.parent.skip:
                home = home.parent
            if by_skip and by_skip[-1].element is home:
                by_skip[-1].text += text
            else:
                by_skip.append(Block(home, text, 0))
        kept: list[Block] = []
        for b in by_skip:  # parts around what is left out stay one block
            if kept and not b.element.skip and kept[-1].element is b.element:
                kept[-1].text += b.text
            elif not b.element.skip or b.text.strip():
                kept.append(b)
        for b in kept:
            b.text = " ".join(b.text.split())
            if b.text:
                b.link = min(link, len(b.text))
                out.append(b)
        runs, link = [], 0

    def close(tags: set[str] | frozenset[str], stop: frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in stop:
                return

    def say(text: str) -> None:
        nonlocal link
        if text:
            text = html.unescape(text)
            runs.append((stack[-1], text))
            if any(e.tag == "a" for e in stack[-4:]):
                link += len(text.strip())

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            say(page[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["raw"] and m["raw"].lower() not in ("script", "style"):
                flush()
            continue
        if not m["shut"]:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            flush()
        if m["end"]:
            if tag in INLINE:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i]
                        break
                    if not stack[i].inline:
                        break
            elif tag == "p":
                close({"p"}, SCOPE)
            elif tag not in ("html", "body"):
                close({tag}, frozenset())
            continue
        if tag in CLOSE_P:
            close({"p"}, SCOPE)
        if tag in SIBLINGS:
            close(SIBLINGS[tag], SCOPE)
        if tag == "html":
            continue
        if tag == "body":
            close({"head"}, frozenset())
        if tag not in VOID:
            n_elements += 1
            stack.append(Element(tag, m["attrs"], stack[-1], n_elements, spared))
    if at < len(page):
        say(page[at:])
    flush()
    return out


def path_scores(found: list[Block]) -> list[float]:
    """Fused tag-path ratio of each block's path; zero for what is left out."""
    sums: dict[tuple, list[float]] = {}
    for b in found:
        if not b.element.skip:
            s = sums.setdefault(b.element.path, [0.0, 0.0, 0.0])
            s[0] += len(b.text) - b.link
            s[1] += len(PUNCTUATION.findall(b.text)) if not b.link else 0
            s[2] += 1
    fused = {p: (length / n) * (marks / n + 0.1) for p, (length, marks, n) in sums.items()}
    return [0.0 if b.element.skip else fused[b.element.path] for b in found]


def smooth(values: list[float], radius: int = 1) -> list[float]:
    weights = [math.exp(-(k * k) / (2 * radius * radius)) for k in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        near = [(w, values[i + k]) for k, w in zip(range(-radius, radius + 1), weights, strict=True) if 0 <= i + k < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def above(e: Element | None) -> Iterator[Element]:
    """An element and all that hold it."""
    while e is not None:
        yield e
        e = e.parent


class Every:
    def __contains__(self, _: int) -> bool:
        return True


def wrappers(page: str, found: list[Block]) -> set[int]:
    """Numbers of elements that a word of their class or id would drop, but that wrap the main text.

    With an article or main part in sight none is sought.  Otherwise, from the outside in, the heaviest that holds half of the page's tag-path
    weight, or a quarter and an article or main part, until one is in sight.
    """
    if any(e.main >= 2 for b in found if not b.element.skip for e in above(b.element)):
        return set()
    known: dict[int, Element] = {}
    weights: dict[int, float] = {}
    holds: set[int] = set()
    chains, total = [], 0.0
    whole = blocks(page, Every())
    for b, score in zip(whole, path_scores(whole), strict=True):
        if not score:
            continue
        chain, weight = list(above(b.element)), float(len(b.text) - b.link)
        total += weight
        chains.append(chain)
        main = False
        for e in chain:
            main |= e.main >= 2 and not e.bad
            if e.bad:
                known[e.at] = e
                weights[e.at] = weights.get(e.at, 0.0) + weight
                if main:
                    holds.add(e.at)
    spared: set[int] = set()
    while True:
        if any(e.main >= 2 for c in chains if not any(x.bad and x.at not in spared for x in c) for e in c):
            return spared
        best = None
        for at, e in known.items():
            if at in spared or any(x.bad and x.at not in spared for x in above(e.parent)):
                continue
            least = 0.9 if e.bad & COMMENT_WORDS else 0.25 if at in holds else 0.5
            if weights[at] >= least * total > 0 and (best is None or weights[at] > weights[best]):
                best = at
        if best is None:
            return spared
        spared.add(best)


def content_root(found: list[Block]) -> Element | None:
    """Container of the content nodes."""
    raw = path_scores(found)
    scores = smooth(raw)
    if not any(raw):
        return None
    mean = sum(scores) / len(scores)
    limit = min(math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores)), max(s for s, r in zip(scores, raw, strict=True) if r))
    total, chains = 0.0, []
    for b, s, r in zip(found, scores, raw, strict=True):
        if r and s >= limit:
            weight, e, chain = float(len(b.text) - b.link + 1), b.element, []
            total += weight
            while e is not None:
                e.weight += weight
                chain.append(e)
                e = e.parent
            chains.append(chain)
    best, rank = None, (-1, -1.0, -1)
    for chain in chains:
        for e in chain:
            if e.tag not in CONTAINERS:
                continue
            if e.weight >= 0.5 * total and e.main:
                key = (e.main, e.weight, -len(e.path))  # an article before a main part, the widest of its kind
            elif e.weight >= 0.95 * total:
                key = (0, 0.0, len(e.path))
            else:
                continue
            if key > rank:
                best, rank = e, key
    if rank[0] <= 0:  # several articles and none with half of the text
        own = {id(e): e for c in chains for e in c if e.main == 3}
        if own and (best is None or best.tag in ("html", "body")):
            best = max(own.values(), key=lambda e: e.weight)
    if best is not None and best.main == 3:  # the text goes on in further articles: the container of all
        tops = {id(t): t for c in chains for t in [next((e for e in reversed(c) if e.main == 3), None)] if t is not None}
        if len(tops) > 1:
            common = [e for e in above(best) if all(any(e is x for x in above(t)) for t in tops.values())]
            best = next((e for e in common if e.tag in CONTAINERS), best)
    return best


def extract(page: str) -> str:
    found = blocks(page)
    spared = wrappers(page, found)
    if spared:
        found = blocks(page, spared)
    if not any(not b.element.skip for b in found):
        found = blocks(page, Every())  # all text is left out by words: the ratios alone
    if not any(not b.element.skip for b in found):
        if not re.search(r"<form", page, re.I):
            return ""
        found = blocks(re.sub(r"</?form\b[^>]*>", "<div>", page, flags=re.I))  # the page itself is one form
    root = content_root(found)
    if root is None:
        return ""

    def below(e: Element | None) -> bool:
        while e is not None and e is not root:
            e = e.parent
        return e is root

    return " ".join(b.text for b in found if not b.element.skip and below(b.element))


def _texts(batches: Batches) -> Batches:
    for b in batches:
        texts = [extract(t.decode("utf-8", "replace")) for t in b.column(2).to_pylist()]
        yield to_batch({"page_id": (b.column(0).to_pylist(), pa.int64()), "url": (b.column(1).to_pylist(), pa.string()), "text": (texts, pa.string()),
                        "n_chars": ([len(t) for t in texts], pa.int64())})


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    raw = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_bytes("html").alias("t"))
    return raw.mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
