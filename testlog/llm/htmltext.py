"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags.  Each block has a length, a share of its
characters inside links, a density of common words, and the region it stands in
(boilerplate by tag, role or class name; an article; or the open page).

First pass, per block: boilerplate regions and link lists are bad; long blocks are good in
an article, and on the open page unless they hold far fewer common words than the page.  A
page whose words are not common in any listed language is judged by length alone.  All
others are undecided, among them headings that are links.
Second pass: undecided blocks take the label of the nearest decided blocks on both
sides within their region; where these disagree, the nearer one counts, the one before
on a tie.  A link list passes its label on only to blocks that hold links themselves.  Where
there is no such neighbour, or the region has no good block, the block is kept.

Defined results: null html counts as empty; a page without text, or of boilerplate
only, gives an empty text; unclosed tags, comments and pages end where the page ends;
repeated rows give repeated rows; other columns are carried unless an output column
has their name.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from testlog.llm.quality import COMMON_WORDS

LONG = 140  # characters of a block that decides by itself
LINK_SHARE = 0.4
COMMON_DENSITY = 0.10  # share of common words from which the page's language counts as listed
RELATIVE_DENSITY = 0.5  # of the page's density, which a long block of the open page needs

# Element names of HTML by their part in a page.
RAW = frozenset("script style template noscript textarea title svg annotation annotation-xml iframe object canvas head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike "
    "strong sub sup time tt u var wbr img ruby rt rp "
    "math semantics mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover "
    "mfenced mstyle mpadded mphantom menclose mmultiscripts mprescripts mtable mtr mtd".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILERPLATE = frozenset("nav footer aside form dialog menu button select fieldset header".split())
ARTICLE = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu".split())
# Parts of class names and ids that mark boilerplate.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notification popup modal overlay newsletter subscribe subscription signup login sidebar "
    "related recommended share sharing social comment comments disqus replies breadcrumb breadcrumbs menu nav "
    "navbar navigation pagination pager footer header masthead widget widgets toolbar".split()
)
# Beside these a mark says what the page has around the element, not what the element is.
ABOUT_OTHERS = frozenset("has with without no layout".split())
# Beside these a header is that of the content.
CONTENT = frozenset("article content entry post".split())
COMMON = frozenset(w for listed in COMMON_WORDS.values() for w in listed)

TAG = re.compile(r"""(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>"']+))?(?=[\s/>]|$)""", re.I)
# The end tag of an element whose content is not parsed; names are ASCII, so no other case rules apply.
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.A | re.I) for name in RAW}
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    region: int  # number of the region it stands in
    kind: str  # what that region is: "boilerplate", "article" or "page"
    parts: list[str] = field(default_factory=list)
    linked: int = 0  # characters inside links
    tag: str = ""  # the element it begins in

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _marked(name: str, attributes: str, inside_article: bool) -> str:
    """Do the tag or its attributes say boilerplate?  "element" or "name" by what says so, else empty."""
    if name in BOILERPLATE and not (name == "header" and inside_article):
        return "element"
    if not attributes:
        return ""
    by_name = ""
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return "element"
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return "element"
        elif key == "role":
            if value.lower() in ROLES:
                return "element"
        elif name not in ("html", "body", "main"):
            for word in value.split():
                parts = {p.lower() for p in NAME_PART.findall(word)}
                found = parts & MARKS
                if inside_article or parts & CONTENT:
                    found = found - {"header"}
                if found and not parts & ABOUT_OTHERS:
                    by_name = "name"
    return by_name


def blocks(page: str) -> list[Block]:
    """The blocks of a page in page order, empty ones left out."""
    found: list[Block] = []
    stack: list[tuple[str, int, str]] = []  # open elements: name, region, kind
    region, kind, regions = 0, "page", 0
    links = 0
    block = Block(region, kind)
    named: set[int] = set()  # boilerplate regions that only a class name or id makes so

    def close() -> None:
        nonlocal block
        if block.parts and "".join(block.parts).strip():
            found.append(block)
        block = Block(region, kind, tag=stack[-1][0] if stack else "")

    def say(text: str) -> None:
        if text:
            text = entities.unescape(text)
            block.parts.append(text)
            if links:
                block.linked += len("".join(text.split()))

    unended: set[str] = set()  # elements without an end tag in the rest of the page
    at, size = 0, len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            say(page[at:])
            break
        say(page[at:start])
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 4)
            at = size if stop < 0 else stop + 3
            continue
        following = page[start + 1 : start + 2]
        if following in ("!", "?"):
            stop = page.find(">", start)
            at = size if stop < 0 else stop + 1
            continue
        tag = TAG.match(page, start + 1)
        if tag is None:
            if not (following.isalpha() or following == "/"):
                say("<")  # a bare sign
                at = start + 1
                continue
            stop = page.find(">", start)  # a tag with an open quote, or cut off
            at = size if stop < 0 else stop + 1
            continue
        at = tag.end()
        closing, name, attributes = bool(tag[1]), tag[2].lower(), tag[3]
        if name in RAW:
            if not closing and not attributes.endswith("/"):
                end = None
                if name not in unended:
                    end = RAW_END[name].search(page, at)
                if end is None:
                    unended.add(name)
                if end is None and name == "head":
                    continue  # its end tag may be left out; its elements are skipped one by one
                stop = size if end is None else page.find(">", end.end())
                at = size if stop < 0 else stop + 1
            continue
        if name in INLINE or name == "br":
            if name == "br":
                say(" ")
            elif name == "a":
                links = max(0, links - 1) if closing else links + 1
            continue
        # a block-level tag ends the block, and links that were left open
        links = 0
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    region, kind = stack[depth][1:]
                    del stack[depth:]
                    break
            close()
            continue
        if name in VOID:
            close()
            continue
        if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == name:
            region, kind = stack.pop()[1:]
        stack.append((name, region, kind))
        if kind != "boilerplate":
            marked = _marked(name, attributes, kind == "article")
            if marked:
                regions += 1
                region, kind = regions, "boilerplate"
                if marked == "name":
                    named.add(region)
            elif name in ARTICLE and kind != "article":
                regions += 1
                region, kind = regions, "article"
        elif name == "main" and region in named:
            # the name was that of a wrapper of the whole page
            regions += 1
            region, kind = regions, "article"
        close()
    close()
    return found


def density(text: str) -> float:
    """Share of common words of the listed languages."""
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in COMMON for w in words) / max(1, len(words))


def is_link_list(block: Block, text: str) -> bool:
    return block.linked > LINK_SHARE * len(text.replace(" ", ""))


def first_pass(block: Block, text: str, page_density: float) -> bool | None:
    """Good, bad or undecided by the block and the density of the whole page."""
    if block.kind == "boilerplate":
        return False
    if is_link_list(block, text):
        return None if block.tag in HEADINGS else False
    if len(text) < LONG:
        return None
    if block.kind == "article" or page_density < COMMON_DENSITY:
        return True
    return density(text) >= RELATIVE_DENSITY * page_density


def second_pass(
    labels: list[bool | None], regions: list[int], lists: list[bool] | None = None, with_links: list[bool] | None = None
) -> list[bool]:
    """Undecided blocks inherit from the nearest decided ones of their region.

    ``lists`` marks link lists, whose label goes to blocks ``with_links`` only.
    """
    size = len(labels)
    lists, with_links = lists or [False] * size, with_links or [True] * size
    good = {region for label, region in zip(labels, regions) if label}

    def nearest(order: Iterable[int]) -> list[tuple[int | None, int | None]]:
        """Nearest decided block seen so far: of all, and without link lists."""
        out: list[tuple[int | None, int | None]] = [(None, None)] * size
        seen: dict[int, tuple[int | None, int | None]] = {}
        for i in order:
            every, plain = seen.get(regions[i], (None, None))
            if labels[i] is not None:
                every, plain = i, plain if lists[i] else i
                seen[regions[i]] = (every, plain)
            out[i] = (every, plain)
        return out

    before, after = nearest(range(size)), nearest(range(size - 1, -1, -1))
    out: list[bool] = []
    for i, label in enumerate(labels):
        if label is None:
            side = 0 if with_links[i] else 1
            a, b = before[i][side], after[i][side]
            if regions[i] not in good or (a is None and b is None):
                label = True
            elif b is None or (a is not None and i - a <= b - i):
                label = labels[a]
            else:
                label = labels[b]
        out.append(bool(label))
    return out


def main_text(page: str | None) -> tuple[str, int, int]:
    """(text, blocks of the page, blocks kept)."""
    found = blocks(page or "")
    texts = [b.text() for b in found]
    page_density = density(" ".join(t for b, t in zip(found, texts) if b.kind != "boilerplate" and not is_link_list(b, t)))
    labels = second_pass(
        [first_pass(b, t, page_density) for b, t in zip(found, texts)],
        [b.region for b in found],
        [is_link_list(b, t) for b, t in zip(found, texts)],
        [b.linked > 0 for b in found],
    )
    kept = [t for t, good in zip(texts, labels) if good and t]
    return "\n\n".join(kept), len(found), len(kept)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replace ``html`` by text, n_chars, n_blocks and n_kept."""
    added = ("text", "n_chars", "n_blocks", "n_kept")
    carried = [c for c in pages.columns if c != html and c not in added]
    body = pages.select(*carried, F.col(html).cast("string").alias(html))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [main_text(page) for page in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in carried],
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([len(r[0]) for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.int64()),
                ],
                names=[*carried, *added],
            )

    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in body.schema.fields if f.name != html]
        + ["text string", "n_chars long", "n_blocks long", "n_kept long"]
    )
    return body.mapInArrow(run, schema)
