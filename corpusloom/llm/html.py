"""Main text of web pages by two-pass block rules (operator 5)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Frequent words of four languages.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or an they which you had we were all their "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son elle ses mais ou "
    "el los las del y por con no su para al lo como más pero sus este ya o fue ha si porque esta son entre cuando muy sin sobre".split()
)
#: Bounds of the first pass: characters of a block, share of stop words, share of characters in links.
SHORT, STOP_HIGH, STOP_LOW, LINKS = 70, 0.30, 0.15, 0.35
RAW = "script|style|noscript|template|textarea|iframe|object|svg|math|title|select|canvas|audio|video"
#: Of these, those that run to the end of the page where they are never closed, and whose "/>" closes nothing.
TO_THE_END = "script|style|title|textarea"
#: Elements that are beside the article by their name; headers only outside the main regions.
DROPPED = frozenset("nav footer aside form menu button dialog fieldset head".split())
#: Words of class, id and role that name what the article comes without.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent notice notices popup modal newsletter subscribe "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus respond replies share sharing social related widget login signup "
    "search pagination pager toolbar masthead header copyright legal disclaimer gdpr complementary contentinfo alert alertdialog dialog".split()
)
#: Words that may stand beside those without changing what they name, and words of the article itself,
#: whose header is its own but not its comments.
PLACES = frozenset("box block area list item items section wrapper container inner outer row col left right top bottom slot unit zone label bar buttons links main primary secondary site page global mobile reader user".split())
OWN = frozenset("post entry article story".split())
HEADERS = frozenset("header masthead banner".split())
#: Words that name readers' comments only together: an article may have a discussion of its own.
TALK, TALKERS = frozenset("discussion discussions feedback reactions thread".split()), frozenset("reader readers user users visitor visitors community".split())
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
_ROLE_MAIN = re.compile(r"(?:^|\s)role\s*=\s*[\"']?main\b", re.I)

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?!(?:{TO_THE_END})\b)(?:{RAW})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*+(?<=/)>"
    rf"|<(?P<end>{TO_THE_END})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>.*?(?:</(?P=end)\s*>|\Z)"
    rf"|<(?P<raw>{RAW})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>.*?</(?P=raw)\s*>"
    r"|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|</?[a-z][^>]*>|</?[a-z][^<>]*\Z|<[!?][^>]*>?|</[^a-z][^>]*>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTRS = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[a-z]+", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)
_EDGES = re.compile(r"^\W+|\W+$")


@dataclass
class Block:
    main: int  # number of the article or main element it lies in, 0: none
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    label: bool | None = None
    tag: str = ""  # of the element that begins here


def _names_something(name: str, inside: bool) -> bool:
    """Whether a class, id or role names something beside the article, and nothing else: "site-footer" or
    "post-comments" do, "has-sidebar", "legal-history" or "entry-header" don't."""
    words = {w for w in _WORDS.findall(name.lower()) if len(w) > 1}
    if words & TALK and words & TALKERS and words <= TALK | TALKERS | PLACES | OWN:
        return True
    hints, rest = words & HINTS, words - HINTS - PLACES
    if not hints or not rest <= OWN:
        return False
    return bool(hints - HEADERS) or not (inside or rest)


def _hinted(tag: str, attrs: str, inside: bool) -> bool:
    """Whether an element is beside the article by its tag, class, id or role; inside: within a main region."""
    if tag in DROPPED or tag == "header" and not inside:
        return True
    if not attrs or tag in ("html", "body"):
        return False
    names = [n for m in _ATTRS.finditer(attrs) for n in (m[1] or m[2] or m[3] or "").split()]
    if tag in MAIN:
        return any(set(_WORDS.findall(n.lower())) & {"comment", "comments"} for n in names)
    return any(_names_something(n, inside) for n in names) or bool(_HIDDEN.search(attrs))


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, those in dropped elements left out."""
    out, current = [], Block(0)
    skip, depth = "", 0  # the dropped element that is open, and how deep its own kind nests in it
    mains: list[list] = []  # open main regions: number, tag, how deep that tag nests
    numbers = links = 0

    def end() -> None:
        nonlocal current
        if current.parts:
            current.text = " ".join(unescape("".join(current.parts)).split())
            if current.text:
                out.append(current)
        current = Block(mains[-1][0] if mains else 0)

    for m in _TOKEN.finditer(page):
        if (text := m["text"]) is not None:
            if not skip:
                current.parts.append(text)
                if links:
                    current.linked += len(text)
            continue
        if m["tag"] is None:
            continue
        tag, closing, attrs = m["tag"].lower(), bool(m["close"]), m["attrs"]
        if skip:
            if tag in MAIN and not closing and not _hinted(tag, attrs, bool(mains)) and skip not in MAIN:
                skip = ""  # the dropped element was never closed
            elif skip == "p" and tag in BLOCKS and not (closing and tag == "p"):
                skip = ""  # an open paragraph ends where the next block begins
            else:
                if tag == skip and not attrs.endswith("/"):
                    depth += -1 if closing else 1
                    if depth == 0:
                        skip = ""
                continue
        if tag == "a":
            links = 0 if closing else 1
        if tag == "br":
            current.parts.append("\n")
        if tag in BLOCKS:
            end()
            links = 0
            current.tag = "" if closing else tag
        if not closing and tag not in VOID and _hinted(tag, attrs, bool(mains)):
            if tag not in BLOCKS:
                current.parts.append(" ")
            skip, depth = tag, 1
            continue
        if not closing and (tag in MAIN or tag in BLOCKS and _ROLE_MAIN.search(attrs)):
            numbers += 1
            mains.append([numbers, tag, 1])
        elif mains and tag == mains[-1][1] and not attrs.endswith("/"):
            mains[-1][2] += -1 if closing else 1
            if mains[-1][2] == 0:
                mains.pop()
        current.main = mains[-1][0] if mains else 0
    end()
    return out


def classify(found: list[Block]) -> list[Block]:
    """Label every block. First pass: many linked characters are bad, but for a paragraph inside a main region,
    whose links are its own; long blocks with many stop words are good, with few of them bad. Inside a main
    region they stay open, as its language may be another; on a page without one whose long blocks all have
    few, the language is unknown, and they are good. Second pass: open blocks take the label of the nearest
    decided neighbour of the same region, on a tie the good one; where a region has none they are good inside
    a main region, and outside if the page has no such region."""
    any_main = any(b.main for b in found)
    long: list[tuple[Block, float]] = []
    for b in found:
        if b.linked > LINKS * max(1, len(b.text)) and not (b.main and b.tag == "p"):
            b.label = False
        elif len(b.text) >= SHORT:
            words = b.text.lower().split()
            long.append((b, sum(_EDGES.sub("", w) in STOP_WORDS for w in words) / len(words)))
    unknown = not any_main and all(share < STOP_LOW for _, share in long)
    for b, share in long:
        b.label = True if share >= STOP_HIGH or unknown else None if b.main or share >= STOP_LOW else False
    first = [b.label for b in found]
    n = len(found)
    before, after = [None] * n, [None] * n
    for order, to in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[int, int] = {}
        for i in order:
            if first[i] is not None:
                last[found[i].main] = i
            else:
                to[i] = last.get(found[i].main)
    for i, b in enumerate(found):
        if first[i] is None:
            near = [(abs(i - j), not first[j]) for j in (before[i], after[i]) if j is not None]
            b.label = not min(near)[1] if near else bool(b.main) or not any_main
    return found


def main_text(page: str | None) -> str:
    return " ".join(b.text for b in classify(blocks(page or "")) if b.label)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages(page_id, url, html).

    Elements go before the rules only where tag, class, id or role names a thing that the article comes
    without; everything else is for the density of stop words and links and for length to decide. A header
    inside a main region is the article's own and holds its headline; outside it is the page's and goes.
    Null or empty html gives an empty text; repeated rows, null ids and null urls give a row each; other
    columns are never read; an empty table gives no rows. Memory follows the longest page of a batch."""
    bounded_batches(pages.sparkSession)
    kinds = {c: pages.schema[c].dataType for c in ("page_id", "url")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [main_text(h if isinstance(h, str) else None) for h in pdf["h"]]
            yield pd.DataFrame({"p": pdf["p"], "u": pdf["u"], "t": texts, "n": [len(t) for t in texts]})

    rows = pages.select(F.col("page_id").cast("string").alias("p"), F.col("url").cast("string").alias("u"), F.col("html").alias("h"))
    done = rows.mapInPandas(run, "p string, u string, t string, n long")
    return done.select(F.col("p").cast(kinds["page_id"]).alias("page_id"), F.col("u").cast(kinds["url"]).alias("url"), F.col("t").alias("text"), F.col("n").alias("n_chars"))
