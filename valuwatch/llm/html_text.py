"""Main text of web pages by two-pass block rules.

A tolerant scan of the tags cuts a page into blocks.  Parts of a page that are named as furniture
(menus, headers, footers, side bars, notices, adverts, forms, comments) never hold text.  The first pass
classifies the other blocks on their own by link density, length and density of stop words; the second
gives short and middling blocks the label of the nearest decided neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Limits of the first pass: link density, lengths in characters, stop word densities.
LINKS, SHORT, LONG = 0.3, 70, 200
STOP_LOW, STOP_HIGH = 0.15, 0.3

# Elements by role.
RAW = frozenset(("script", "style", "textarea", "title", "xmp", "noembed", "noframes"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
                   "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre "
                   "section summary table tbody td tfoot th thead tr ul").split())
FURNITURE = frozenset(("nav footer aside form script style noscript template button select option textarea title head iframe "
                       "object svg math canvas audio video dialog menu input").split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
FURNITURE_NAMES = frozenset((
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "menubar breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar header comment comments commentlist disqus "
    "replies reply cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended widget pagination pager paywall toc skip").split())
#: A header inside an article is its head line; anywhere else it is furniture.
ARTICLE = frozenset(("article", "main"))
STOP_WORDS = frozenset((
    "the of and to in a is that it for on was with as be by at from this are or an have not but they which you one we all "
    "der die das und ist von mit den dem des ein eine zu im nicht sich auf auch als es an aus er hat dass sie nach bei "
    "le la les de des du un une et est en que qui dans pour pas sur au avec ce il par plus ne se sont aux son sa ses "
    "el los las y que en un una es por con para no se su al lo como más o pero sus fue ha del "
    "il di che e per non con una sono da si dei della het een van dat niet zijn").split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
                 r"<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z|(?=<))", re.S)
ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


@dataclass
class Block:
    text: str
    links: int          # characters inside links
    article: int        # number of the article it stands in, 0 for none
    heading: bool


def _furniture_name(name: str) -> bool:
    parts = re.split(r"[-_]+", name)
    if parts[0] in ("has", "with", "no", "without"):          # says what a page has, not what the element is
        return False
    hits = {p for p in (name, *parts) if p in FURNITURE_NAMES}
    return bool(hits) and not (hits == {"header"} and {"article", "post", "entry", "story"} & set(parts))


def _named_furniture(attributes: str) -> bool:
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "role" and value in FURNITURE_ROLES:
            return True
        if name in ("class", "id") and any(_furniture_name(w) for w in value.split()):
            return True
        if name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)))


def blocks_of(html: str) -> list[Block]:
    """Blocks outside furniture, with references decoded and white space folded."""
    out: list[Block] = []
    parts: list[str] = []
    link_chars = 0
    stack: list[tuple[str, bool, int]] = []        # open elements: name, furniture, article
    links, article, articles, heading = 0, 0, 0, False
    pos = 0

    def flush() -> None:
        nonlocal link_chars
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, link_chars, article, heading))
        parts.clear()
        link_chars = 0

    def take(raw: str) -> None:
        nonlocal link_chars
        if raw and not (stack and stack[-1][1]):
            text = unescape(raw)
            parts.append(text)
            if links:
                link_chars += len(text.strip())

    def close(k: int) -> None:
        nonlocal links, article, heading
        for name, _, _ in stack[k:]:
            links -= name == "a"
        del stack[k:]
        article = stack[-1][2] if stack else 0
        heading = any(s[0] in ("h1", "h2", "h3", "h4", "h5", "h6") for s in stack[-3:])

    while m := TAG.search(html, pos):
        take(html[pos:m.start()])
        pos = m.end()
        if m[1] is not None:
            take(m[1])
            continue
        if m[3] is None:
            continue
        name = m[3].lower()
        if name in BLOCK:
            flush()
        elif name == "br":
            parts.append(" ")
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
                if name not in BLOCK and stack[k][0] in BLOCK:
                    break                                   # a stray inline end does not close blocks
            continue
        if name in VOID or m[4].endswith("/") and name in ("svg", "math", "path"):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(html, pos)
            pos = end.end() if end else len(html)
            continue
        if name in ("p", "li", "option", "dt", "dd", "tr", "td", "th") or name in BLOCK:
            # an open paragraph ends where a block starts; list items and cells end at the next one
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or stack[k][0] == name and name in ("li", "option", "dt", "dd", "tr", "td", "th"):
                    close(k)
                    break
                if stack[k][0] in BLOCK:
                    break
        inherited = bool(stack and stack[-1][1])
        furniture = inherited or name in FURNITURE or name == "header" and not article
        if not furniture and name not in ("html", "body", "article", "main") and m[4]:
            # the head of an article may be called a header
            furniture = _named_furniture(m[4] if not (name == "header" and article) else
                                         re.sub(r"(?:class|id)\s*=\s*(?:\"[^\"]*\"|'[^']*')", "", m[4]))
        if name in ARTICLE and not furniture and not article:
            articles += 1
            article = articles
        links += name == "a"
        stack.append((name, furniture, article))
        heading = heading or name in ("h1", "h2", "h3", "h4", "h5", "h6")
    take(html[pos:])
    flush()
    return out


def _first_pass(b: Block) -> str:
    if b.links > LINKS * len(b.text):
        return "bad"
    if not b.article and (b.text.startswith(("©", "(c) ")) or re.search(r"(?i)\ball rights reserved\b", b.text)):
        return "bad"
    if len(b.text) < SHORT:
        return "short"
    words = re.findall(r"[^\W\d_]+", b.text.lower())
    density = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if density >= STOP_HIGH:
        return "good" if len(b.text) > LONG else "near"
    if density >= STOP_LOW:
        return "near"
    return "bad" if not b.article else "near"


def main_blocks(blocks: list[Block]) -> list[Block]:
    """The blocks of the article.  Where a page marks an article, blocks outside every one are furniture
    and undecided blocks only look at neighbours in their own; where no neighbour there is decided, the
    mark decides.  Headings belong to what follows them."""
    if any(b.article for b in blocks):
        blocks = [b for b in blocks if b.article]
    first = [_first_pass(b) for b in blocks]
    out = []
    before: list[str | None] = []
    label = None
    for k, b in enumerate(blocks):
        if k and blocks[k - 1].article != b.article:
            label = None
        before.append(label)
        if first[k] in ("good", "bad"):
            label = first[k]
    label = None
    after: list[str | None] = [None] * len(blocks)
    for k in range(len(blocks) - 1, -1, -1):
        if k + 1 < len(blocks) and blocks[k + 1].article != blocks[k].article:
            label = None
        after[k] = label
        if first[k] in ("good", "bad"):
            label = first[k]
    for k, b in enumerate(blocks):
        near = [x for x in ((after[k],) if b.heading and after[k] else (before[k], after[k])) if x]
        if first[k] in ("good", "bad"):
            keep = first[k] == "good"
        elif b.article:
            keep = not near or "good" in near or b.links == 0
        elif first[k] == "near":
            keep = not near or "good" in near
        else:
            keep = bool(near) and all(x == "good" for x in near) or not near and not b.links
        if keep:
            out.append(b)
    return out


def main_text(html: str | None) -> str:
    return " ".join(b.text for b in main_blocks(blocks_of(html))) if html else ""


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """`pages` without the html, with the main text of each whole page in `text` (replaced if there).

    Null, empty and tagless pages give their text, if any, by the same rules; unclosed tags end where
    their parent does.  Repeated rows are extracted each for itself; an empty table stays empty.
    """
    rest = [f for f in pages.schema.fields if f.name not in (html, text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([main_text(h) for h in b.column(len(rest)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:len(rest)], texts], names=[*(f.name for f in rest), text])

    columns = [F.col(f"`{f.name}`") for f in rest] + [F.col(f"`{html}`")]
    return pages.select(*columns).mapInArrow(run, T.StructType([*rest, T.StructField(text, T.StringType())]))
