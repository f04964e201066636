"""Main-text extraction from HTML with two-pass block rules.

A page is cut into blocks at block-level tags.  First pass, by a block's text: link
density, length and stop-word density make it good, bad or ambiguous.  Second pass:
ambiguous blocks take the label of their nearest decided neighbours (both sides are
looked at; the nearer one wins, a tie is good).  A heading begins a section; blocks
look at their section first, and a heading inherits from what follows it.  Where no
block is good, the ambiguous one with most stop words begins, below a heading if any is.

* A block of links is bad, but one link block between good blocks inherits, and so
  does one inside the page's article; two in a row are a menu.
* A copyright line is bad, as is a block that is mostly labels of buttons; neither
  says anything about its neighbours.
* A long block of few stop words is bad above the first heading and ambiguous below one,
  where it may be a table or a list.
* On a page whose text has hardly a known stop word, density says nothing: length and
  links decide.  An ideograph or syllable sign counts as three characters.

The page's own markup is a feature beside these.  What it names as menu, header,
footer, sidebar, notice, advert, form or comments starts as bad.  Inside its article an
ambiguous block is bad only between two bad ones, and nothing is bad for its words;
outside, ambiguous blocks do not inherit from the article, and a block needs twice the
length.  Without an article, or with every name removed, the rules above decide alone.

The page is scanned once from left to right, whatever it holds, so time grows with its
length only.  A tag ends at the first ``>`` outside quoted values; a quote that is
never closed quotes nothing.

Defined results: null and empty HTML give an empty text; a text without tags is one
block; a tag, comment, script or style that is not closed ends with the page; rows that
repeat get equal results; an empty table gives an empty result; a column of the name of
the result is refused.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import common

#: Frequent function words of the languages served (fixed values).
STOP_WORDS = {
    "en": "a about all also an and any are as at be been but by can do for from had has have he her his how i if in into is it its more my no not of on one or our out she so some than that the their them then there these they this to up was we were what when which who will with would you your",
    "de": "aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer eines er es für hat ich ihr im in ist ja kann man mehr mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wie wir wird zu zum zur",
    "fr": "à au aussi aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui mais me même ne nous on ou où par pas plus pour qu que qui sa sans se ses son sont sur te tu un une vous y",
    "es": "a al como con de del desde el ella en entre era es esta este fue ha hay la las le lo los más me mi muy no nos o para pero por que se ser si sin sobre su sus también te tiene un una uno y ya yo",
}
_STOP = frozenset(w for words in STOP_WORDS.values() for w in words.split())

#: Elements that hold no article text, whose text is never shown, and those without an end tag (fixed values).
BOILERPLATE_TAGS = frozenset("nav header footer aside form select option optgroup textarea fieldset menu dialog".split())
HIDDEN_TAGS = frozenset("script style noscript template svg math iframe object audio video canvas title".split())
#: Of these, the elements whose content is read up to the end tag or the end of the page (fixed values).
RAW_TAGS = frozenset("script style iframe".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
LEAF_TAGS = frozenset("p li dt dd td th tr option h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
REGION_TAGS = frozenset("article main".split())
#: Words in class, id or role that name boilerplate, that name content, and that say nothing (fixed values).
BOILERPLATE_NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus dialog footer header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted recommended related respond replies reply search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets alert complementary contentinfo".split())
CONTENT_NAMES = frozenset("article content main post entry story body text page".split())
EMPTY_NAMES = frozenset("area bar block bottom box button buttons container fixed form global icon inner item items left link links list outer panel primary right secondary section site slot sticky top unit wrap wrapper".split())
COMMENT_NAMES = frozenset("comment comments commentlist disqus".split())

_NAME = re.compile(r"[a-z]+")
_TAG_NAME = re.compile(r"[^\s/>]+")
_ATTR_NAME = re.compile(r"[\s/]*([^\s/>=]*)")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_WORDS = re.compile(r"[^\W\d_]+")
_WIDE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
_ENDS = {tag: re.compile(f"</{tag}(?![\\w-])", re.I) for tag in HIDDEN_TAGS}

LONG_CHARS = 200
SHORT_CHARS = 70
STOP_LOW = 0.10
LINKS_HIGH = 0.33
#: Share of stop words among a page's words below which its language counts as unknown.
STOP_KNOWN = 0.04

GOOD, BAD, NEAR = 1, 0, 2


class Block:
    """A run of text between block-level tags."""

    __slots__ = ("text", "link_chars", "button_chars", "named_bad", "region", "heading")

    def __init__(self, text: str, link_chars: int, button_chars: int, named_bad: bool, region: int, heading: bool) -> None:
        self.text, self.link_chars, self.button_chars = text, link_chars, button_chars
        self.named_bad, self.region, self.heading = named_bad, region, heading


def tokens(html: str) -> Iterator[tuple[str, str, bool, dict[str, str]]]:
    """(text, tag, is an end tag, attributes): the text before each tag; the last token has no tag.

    Comments and the content of hidden elements are left out; a title's content is its attribute ``#text``.
    """
    pos, size = 0, len(html)
    missing: set[str] = set()  # what does not occur from here on: it is not looked for again

    def find(what: str, at: int) -> int:
        if what in missing:
            return -1
        place = html.find(what, at)
        if place < 0:
            missing.add(what)
        return place

    text: list[str] = []
    while True:
        at = html.find("<", pos)
        if at < 0:
            text.append(html[pos:])
            break
        text.append(html[pos:at])
        after = html[at + 1 : at + 2]
        if html.startswith("<!--", at):
            end = find("-->", at + 4)
            pos = end + 3 if end >= 0 else size
            continue
        if after and after in "!?":
            end = find(">", at)
            pos = end + 1 if end >= 0 else size
            continue
        closing = after == "/"
        first = html[at + 1 + closing : at + 2 + closing]
        if not (first.isascii() and first.isalpha()):
            if closing:
                end = find(">", at)
                pos = end + 1 if end >= 0 else size
            else:
                text.append("<")
                pos = at + 1
            continue
        name = _TAG_NAME.match(html, at + 1 + closing)
        tag, pos = name[0].lower(), name.end()
        attrs: dict[str, str] = {}
        while True:
            part = _ATTR_NAME.match(html, pos)
            pos = part.end()
            if pos >= size or html[pos] == ">":
                if part[1]:
                    attrs.setdefault(part[1].lower(), "")
                break
            value = ""
            if equals := _EQUALS.match(html, pos):
                pos = equals.end()
                quote = html[pos : pos + 1]
                end = find(quote, pos + 1) if quote and quote in "\"'" else -1
                if end >= 0:
                    value, pos = html[pos + 1 : end], end + 1
                else:
                    bare = _BARE.match(html, pos)
                    value, pos = bare[0], bare.end()
            if part[1]:
                attrs.setdefault(part[1].lower(), value)
        if pos >= size:
            break  # a tag that is not closed
        pos += 1
        if tag in HIDDEN_TAGS:
            if not closing and tag not in missing:
                end = _ENDS[tag].search(html, pos)
                if tag == "title":
                    attrs["#text"] = html[pos : end.start()] if end else ""
                if end:
                    stop = find(">", end.end())
                    pos = stop + 1 if stop >= 0 else size
                else:
                    missing.add(tag)
                    pos = size if tag in RAW_TAGS else pos
            if not closing and attrs:
                yield "".join(text), tag, False, attrs
                text.clear()
            continue
        yield "".join(text), tag, closing, attrs
        text.clear()
    yield "".join(text), "", False, {}


def _named(attrs: dict[str, str], in_region: bool) -> tuple[bool, bool]:
    """Whether attributes name boilerplate, and whether they hide the element."""
    hidden = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").lower().replace(" ", "")
    bad = comment = content = False
    for key in ("class", "id", "role"):
        for name in attrs.get(key, "").lower().split():
            words = set(_NAME.findall(name))
            named = words & BOILERPLATE_NAMES
            if in_region:
                named -= {"header", "banner"}
            bad |= bool(named) and words <= BOILERPLATE_NAMES | EMPTY_NAMES | CONTENT_NAMES
            comment |= bool(words & COMMENT_NAMES) and words <= BOILERPLATE_NAMES | EMPTY_NAMES | CONTENT_NAMES
            content |= bool(words & CONTENT_NAMES)
    return bad and not content or comment, hidden


def blocks(html: str | None) -> list[Block]:
    """All shown blocks of a page, in order."""
    out: list[Block] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # open containers: tag, starts as boilerplate, is a region
    bad_at: list[int] = []  # places in the stack of those that start as boilerplate
    open_tags: Counter[str] = Counter()
    bad_lists = region = n_regions = anchor = button = link_chars = button_chars = breaks = 0
    heading = False

    def end_block() -> None:
        nonlocal link_chars, button_chars
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, min(link_chars, len(text)), button_chars, bool(bad_at), region, heading))
            parts.clear()
        link_chars = button_chars = 0

    def push(tag: str, is_bad: bool, is_region: bool) -> None:
        nonlocal bad_lists
        if is_bad:
            bad_at.append(len(stack))
            bad_lists += tag in ("div", "section", "ol", "ul")
        stack.append((tag, is_bad, is_region))
        open_tags[tag] += 1

    def pop() -> str:
        nonlocal region, bad_lists
        tag, was_bad, was_region = stack.pop()
        open_tags[tag] -= 1
        if was_bad:
            bad_at.pop()
            bad_lists -= tag in ("div", "section", "ol", "ul")
        if was_region:
            region = 0
        return tag

    for raw, tag, closing, attrs in tokens(html or ""):
        if raw:
            text = unescape(raw) if "&" in raw else raw
            shown = len(text.strip())
            if shown:
                breaks = 0
            parts.append(text)
            link_chars += shown if anchor else 0
            button_chars += shown if button else 0
        if tag in HIDDEN_TAGS:
            continue
        if tag == "a":
            anchor = 0 if closing else 1
        elif tag == "button":
            button = 0 if closing else 1
        elif tag == "br":
            breaks += 1
            if breaks > 1:
                end_block()
            else:
                parts.append(" ")
        elif tag not in BLOCK_TAGS and tag not in BOILERPLATE_TAGS:
            if closing:
                if open_tags[tag]:
                    end_block()
                    while pop() != tag:
                        pass
            elif tag not in VOID_TAGS and (open_tags[tag] or attrs and _named(attrs, region > 0)[1]):
                end_block()
                push(tag, not open_tags[tag], False)
        else:
            end_block()
            breaks = anchor = button = 0
            heading = tag in HEADINGS and not closing
            if closing:
                if open_tags[tag]:
                    while pop() != tag:
                        pass
                continue
            if tag in VOID_TAGS or tag in ("body", "html"):
                continue
            names_bad, hidden = _named(attrs, region > 0) if attrs else (False, False)
            if tag in REGION_TAGS and region == 0 and not names_bad and not hidden:
                # The article ends menus and adverts that were left open before it, but not lists of comments.
                if bad_at and not bad_lists:
                    first = bad_at[0]
                    while len(stack) > first:
                        pop()
                if not bad_at:
                    n_regions += 1
                    region = n_regions
                    push(tag, False, True)
                    continue
            elif tag in BOILERPLATE_TAGS and not (tag == "header" and region):
                names_bad = True
            if names_bad or hidden or tag not in LEAF_TAGS:
                push(tag, names_bad or hidden, False)
    end_block()
    return out


def _measures(block: Block) -> tuple[int, int, int]:
    """Length, words and stop words of a block."""
    words = _WORDS.findall(block.text.lower())
    return len(block.text) + 2 * len(_WIDE.findall(block.text)), len(words), sum(w in _STOP for w in words)


def _of_links(block: Block) -> bool:
    return block.link_chars > LINKS_HIGH * len(block.text)


def _is_notice(block: Block) -> bool:
    """A copyright line, or labels of buttons."""
    return "\u00a9" in block.text or 2 * block.button_chars > len(block.text)


def _sections(found: list[Block]) -> list[int]:
    """The number of headings up to each block."""
    out, section = [], 0
    for b in found:
        section += b.heading and not b.named_bad
        out.append(section)
    return out


def first_pass(found: list[Block]) -> list[int]:
    """The label of each block by its own text."""
    sizes = [_measures(b) for b in found]
    plain = [m for b, m in zip(found, sizes, strict=True) if not b.named_bad and not _of_links(b)]
    known = sum(m[2] for m in plain) >= STOP_KNOWN * sum(m[1] for m in plain)
    has_region = any(b.region and not b.named_bad for b in found)
    sections = _sections(found)
    labels = []
    for b, section, (size, words, stops) in zip(found, sections, sizes, strict=True):
        density = stops / max(1, words)
        outside = has_region and not b.region
        if b.named_bad or _is_notice(b):
            label = BAD
        elif _of_links(b):
            label = NEAR if b.region else BAD
        elif b.heading or size < SHORT_CHARS:
            label = NEAR
        elif size >= (2 if outside else 1) * LONG_CHARS and (not known or density >= STOP_LOW):
            label = GOOD
        else:
            label = NEAR if size < LONG_CHARS or density >= STOP_LOW or b.region or section else BAD
        labels.append(label)
    # Two blocks of links in a row are a menu; one between good blocks of text may be part of it.
    links = [_of_links(b) and not b.named_bad for b in found]
    decided: list[int | None] = [None] * (len(found) + 1)  # the next decided block that is none of links, from the right
    for i in range(len(found) - 1, -1, -1):
        decided[i] = labels[i] if labels[i] != NEAR and not links[i] else decided[i + 1]
    before = None
    for i, label in enumerate(labels):
        menu = links[i] and (i > 0 and links[i - 1] or i + 1 < len(found) and links[i + 1])
        if menu:
            labels[i] = BAD
        elif links[i] and not found[i].region and before == GOOD and decided[i + 1] == GOOD:
            labels[i] = NEAR
        elif label != NEAR and not links[i]:
            before = label
    if GOOD not in labels and not any(x == NEAR and b.region for b, x in zip(found, labels, strict=True)):
        seeds = [i for i, x in enumerate(labels) if x == NEAR and not links[i]]
        if seeds:
            labels[max(seeds, key=lambda i: (sections[i] > 0, not found[i].heading, sizes[i][2], sizes[i][0], -i))] = GOOD
    return labels


def classify(found: list[Block]) -> list[bool]:
    """Which blocks are main text."""
    labels = first_pass(found)
    n = len(found)
    parts = [(b.region, section) for b, section in zip(found, _sections(found), strict=True)]
    inside, across = _nearest(found, labels, parts), _nearest(found, labels, [(b.region, 0) for b in found])
    out = []
    for i, label in enumerate(labels):
        if label == NEAR:
            sides = [x for x in (inside[0][i], inside[1][i]) if x] or [x for x in (across[0][i], across[1][i]) if x]
            if found[i].heading and across[1][i]:
                sides = [across[1][i]]
            if found[i].region:
                label = BAD if [(i - 1, BAD), (i + 1, BAD)] == sides else GOOD
            elif not sides:
                label = BAD
            else:
                closest = min(abs(j - i) for j, _ in sides)
                label = max(x for j, x in sides if abs(j - i) == closest)
        out.append(label == GOOD)
    return out


def _nearest(found: list[Block], labels: list[int], parts: list[tuple[int, int]]) -> list[list[tuple[int, int] | None]]:
    """For each block the nearest decided block (place, label) of its part before and after it."""
    n = len(found)
    nearest: list[list[tuple[int, int] | None]] = [[None] * n, [None] * n]
    for side, order in enumerate((range(n), range(n - 1, -1, -1))):
        last: tuple[int, int] | None = None
        part = None
        for i in order:
            if found[i].named_bad and found[i].region or _is_notice(found[i]):
                continue  # an advert inside an article or a notice says nothing about the text around it
            if parts[i] != part:
                part, last = parts[i], None
            nearest[side][i] = last
            if labels[i] != NEAR:
                last = (i, labels[i])
    return nearest


def main_text(html: str | None) -> str:
    """The main text: good blocks joined by a line feed."""
    found = blocks(html)
    return "\n".join(b.text for b, good in zip(found, classify(found), strict=True) if good)


def plain_text(html: str | None) -> str:
    """All shown text, a line for each block."""
    return "\n".join(b.text for b in blocks(html))


def extract(pages: DataFrame, *, html_col: str = "html", text_col: str = "main_text") -> DataFrame:
    """All columns of ``pages`` but the HTML, and the main text."""
    common.bound_batches(pages.sparkSession)
    others = [c for c in pages.columns if c != html_col]
    if text_col in others:
        raise ValueError(f"column {text_col} exists; give another text_col")
    schema = pages.select(*others, F.lit("").alias(text_col)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py()) for x in batch.column(len(others))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], texts], names=[*others, text_col])

    return pages.select(*others, html_col).mapInArrow(run, schema)
