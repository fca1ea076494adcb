"""Main text of web pages by two-pass block rules.

A page is read once into blocks: runs of text between block-level tags, each with its words, the
words within links, and the zone it stands in. Pass one decides each block by its link density, its
stop-word density and its length; what they leave open (short blocks, and prose full of links or poor
in stop words inside an article) pass two labels by the nearest decided neighbours: as both, if they
agree, else as the nearer one, and good if both are as near. Headings look ahead only.

What elements say of themselves shifts the bars. Within an article or main element, or one named so,
shorter text counts as running text, text poor in stop words is open and not bad, and open blocks
without a decided neighbour there are good. Menus, footers, side bars, notices, adverts, forms and
comments of readers, named by tag, role or whole class, lose at once, for comments are prose too; but
where that leaves a page without any text, blocks in an article within a form or within an element so
named are judged by density after all. Hidden elements never count. On a page none of whose longer
blocks has stop words enough, the language is not one of those listed, and length and links decide.

The reader is linear in the page: each tag is found from its start, quoted values are jumped over, and
scripts and the like end at their own end tag.

Defined results: null html is empty; an empty text is an empty string; repeated rows have equal
results; null ids and urls are passed through; an empty table gives no rows; other columns give way.
A tag that never ends is text; an unclosed comment or script runs to the end of the page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import common

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: From within a tag to where it ends or a quoted value begins.
_TO_QUOTE = re.compile(r"[^>\"']*+")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++)))?")
_NO_DISPLAY = re.compile(r"(?<![\w-])display\s*:\s*none", re.I)
#: Elements whose content is no text of the page.
RAW = frozenset("script style template noscript svg math iframe object canvas select option textarea button title head audio video".split())
#: Where their content ends: their end tag alone, for anything else in them is no markup.
_RAW_END = {t: re.compile(rf"</{t}(?![^\s/>])[^>]*+>?", re.I) for t in RAW if t != "head"}
#: Of these, the ones that run to the end of the page if nothing ends them.
_TO_THE_END = frozenset("script style textarea title iframe noscript".split())
#: Elements that are no part of an article wherever they stand.
ASIDE = frozenset("nav aside form footer menu dialog fieldset".split())
#: Elements that end and begin a block.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in the class, id or role of an element that is no part of an article.
_ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies cookiebar copyright disclaimer discussion disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notification pagination pager popup promo promoted promotion recommended related reply replies search share sharing sidebar signup site-header skip social sponsor sponsored subscribe tags toolbar widget widgets".split()
)
#: Words that say where or in what shape such an element stands, and nothing of what it holds.
_SHAPES = frozenset("area bar block body bottom box button buttons container footer global group header inner item items left link links list main mobile panel primary right secondary section site slot top unit wrap wrapper".split())
#: The commonest words of the languages met most; a block with many of them is running text.
STOP_WORDS = frozenset(
    "a about after all also an and any are as at be because been but by can could do for from had has have he her his how i if in into is it its just like more my no not of on one only or other our out over she so some than that the their them then there these they this to up was we were what when which who will with would you your "
    "aber als am auch auf aus bei bin bis da das dass dem den der des die doch durch ein eine einem einen einer er es für haben hat ich im ist kann mit nach nicht noch nur oder sich sie sind so über um und uns unter vom von vor war was wenn wie wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais même ne nous ou où par pas plus pour qu que qui sa sans se ses son sont sur un une vous "
    "al como con del desde el ella ellos entre era ese esta este ha hay las lo los más me mi muy ni no nos o otro para pero por porque que se ser si sin sobre su sus también te tiene todo una uno y ya".split()
)
#: Two words that, one after the other, name an element as holding the article.
_CLAIM = re.compile(r"(?:article|blog|entry|main|page|post|story|news)[-_]*(?:body|content|text|copy)", re.I)
#: Pass one: a link share above which a block is bad; lengths in characters; stop-word shares.
LINKS, SHORT, LONG, FEW_STOPS, MANY_STOPS = 0.33, 70, 200, 0.1, 0.25
#: The length that counts as SHORT inside an article.
SHORT_INSIDE = 20

GOOD, BAD, OPEN = 1, -1, 0


#: Zones: never the article, anywhere, inside an article or main element.
OUT, PLAIN, INSIDE = 0, 1, 2


class Block:
    """A run of text: its zone, the zone if names and forms counted for nothing, and its measures."""

    __slots__ = ("bare", "heading", "linked", "parts", "stops", "text", "words", "zone")

    def __init__(self, zone: int, bare: int, heading: bool):
        self.zone, self.bare, self.heading, self.parts, self.linked = zone, bare, heading, [], 0

    def end(self) -> bool:
        """Measure the block; whether it has text."""
        words = unescape("".join(self.parts)).split() if len(self.parts) == 1 else "".join(map(unescape, self.parts)).split()
        self.text, self.words, self.parts = " ".join(words), len(words), []
        self.stops = sum(w.strip(".,;:!?\"'()").lower() in STOP_WORDS for w in words) / len(words) if words else 0.0
        return bool(words)


def _aside(name: str) -> bool:
    """Whether a class, id, role or label as a whole names what is no part of an article.

    Each of its words has to be such a name or a shape: `sidebar-left` is one, `has-sidebar` is not.
    """
    words = [w for w in re.split(r"[^a-z]+", name.lower()) if w]
    return name.lower() in _ASIDE_NAMES or (any(w in _ASIDE_NAMES for w in words) and all(w in _ASIDE_NAMES or w in _SHAPES for w in words))


def _zone(tag: str, attributes: str, zone: int, bare: int) -> tuple[int, int]:
    """The zone and bare zone inside an element that stands in the given ones."""
    if bare == OUT:
        return OUT, OUT
    claims = tag in ("article", "main")
    named = tag == "form"
    if tag in ASIDE and not named or (tag == "header" and zone != INSIDE and bare != INSIDE):
        return OUT, OUT
    if attributes:
        names: list[str] = []
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip()
            if (key == "hidden" and value.lower() != "false") or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _NO_DISPLAY.search(value)):
                return OUT, OUT
            if key == "role" and value.lower() == "main" or key == "itemprop" and value.lower() == "articlebody":
                claims = True
            elif key in ("class", "id", "role", "aria-label"):
                names += [value] if key == "aria-label" else value.split()
        if tag not in ("body", "html", "article", "main"):
            # An element that says it holds the article is not known by its other names.
            claims = claims or any(map(_CLAIM.fullmatch, names))
            named = named or (not claims and any(map(_aside, names)))
    inside = INSIDE if claims else None
    return OUT if named or zone == OUT else inside or zone, inside or bare


def _tag_end(html: str, at: int, last: dict[str, int]) -> int:
    """Where the tag ends whose name ends at `at`: the place after its >, or -1. Values in quotes are jumped over."""
    while True:
        at = _TO_QUOTE.match(html, at).end()
        if at >= len(html):
            return -1
        if html[at] == ">":
            return at + 1
        # A quote that nothing closes is a letter like any other.
        at = html.index(html[at], at + 1) + 1 if at < last[html[at]] else at + 1


def tokens(html: str) -> Iterator[tuple[str, bool, str]]:
    """(text, False, ''), (tag, True, attributes) and ('/tag', True, '') in page order; tags in lower case.

    Linear: the search for a tag's end fails once at most, and quotes are ignored from there on.
    """
    at, last, quotes, endless = 0, {q: html.rfind(q) for q in "\"'"}, True, set()
    ends = html.rfind(">")
    seek = 0
    while True:
        lt = html.find("<", seek)
        if lt < 0 or lt > ends and not html.startswith("<!--", lt):
            break
        m = _TAG.match(html, lt)
        if m:
            end = _tag_end(html, m.end(), last) if quotes else html.find(">", m.end()) + 1
            if end < 0:
                quotes = False
                end = html.find(">", m.end()) + 1
            if lt > at:
                yield html[at:lt], False, ""
            tag = m[2].lower()
            at = seek = end
            yield (f"/{tag}", True, "") if m[1] else (tag, True, html[m.end() : end - 1])
            if not m[1] and tag in _RAW_END and tag not in endless and html[end - 2] != "/":
                closed = _RAW_END[tag].search(html, end)
                if closed:
                    at = seek = closed.end()
                elif tag in _TO_THE_END:
                    return
                else:
                    endless.add(tag)
        elif html.startswith("<!--", lt):
            if lt > at:
                yield html[at:lt], False, ""
            end = html.find("-->", lt + 4)
            if end < 0:
                return
            at = seek = end + 3
        elif html.startswith(("<!", "<?", "</"), lt):
            if lt > at:
                yield html[at:lt], False, ""
            at = seek = html.find(">", lt) + 1
        else:
            seek = lt + 1
    if at < len(html):
        yield html[at:], False, ""


def blocks(html: str) -> list[Block]:
    """The page's blocks that have text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, bool]] = []  # tag, zone, bare zone and heading outside of it
    opened: Counter[str] = Counter()
    zone, bare, heading, links = PLAIN, PLAIN, False, 0
    block = Block(zone, bare, heading)

    def close() -> None:
        nonlocal block
        if block.parts and block.end():
            out.append(block)
        block = Block(zone, bare, heading)

    for tag, markup, attributes in tokens(html):
        if not markup:
            block.parts.append(tag)
            if links:
                block.linked += len(tag.split())
        elif tag[0] == "/":
            tag = tag[1:]
            if tag == "a":
                links = max(0, links - 1)
            elif opened[tag]:
                # An end tag closes what was left open within; inline tags change no zone.
                while True:
                    t, zone, bare, heading = stack.pop()
                    opened[t] -= 1
                    if t == tag:
                        break
                if tag in BLOCK or block.zone != zone:
                    links = 0
                    close()
            elif tag == "p":
                close()
        elif tag in RAW:
            continue  # what is in it is passed over by tokens(); a head's title, styles and scripts are raw themselves
        elif tag in VOID or attributes.endswith("/"):
            if tag == "hr":
                close()
            elif tag == "br":
                block.parts.append(" ")
        elif tag == "a":
            links += 1
        elif tag in BLOCK:
            # A paragraph ends where the next block begins; items and cells end at the next of their kind.
            if stack and (stack[-1][0] == "p" or (tag in ("li", "dt", "dd", "td", "th", "tr") and stack[-1][0] == tag)):
                t, zone, bare, heading = stack.pop()
                opened[t] -= 1
            stack.append((tag, zone, bare, heading))
            opened[tag] += 1
            (zone, bare), heading = _zone(tag, attributes, zone, bare), tag in HEADINGS or heading
            links = 0
            close()
        elif attributes:
            inner = _zone(tag, attributes, zone, bare)
            if inner != (zone, bare):  # an inline element that is no part of the article
                stack.append((tag, zone, bare, heading))
                opened[tag] += 1
                zone, bare = inner
                close()
                links = 0
    close()
    return out


def first_pass(found: list[Block]) -> list[int]:
    """GOOD, BAD or OPEN for each block, by its own measures."""
    known = any(b.zone != OUT and len(b.text) >= SHORT and b.stops >= FEW_STOPS for b in found)
    labels = []
    for b in found:
        size, inside = len(b.text), b.zone == INSIDE
        prose = not known or b.stops >= MANY_STOPS
        if b.zone == OUT:
            label = BAD
        elif b.linked > LINKS * b.words:
            label = OPEN if inside and prose and size >= SHORT else BAD
        elif b.linked * 5 > b.words and size < SHORT:
            label = OPEN
        elif known and prose and size >= (SHORT_INSIDE if inside else SHORT) or size >= LONG and (not known or b.stops >= FEW_STOPS):
            label = GOOD
        elif known and size >= LONG and not inside:
            label = BAD
        else:
            label = OPEN
        labels.append(label)
    return labels


def second_pass(found: list[Block], labels: list[int]) -> list[int]:
    """labels with the open ones decided by their nearest decided neighbours of the same zone.

    What stands outside an article says nothing of what is in it.
    """
    out = list(labels)
    n = len(found)
    before, after = [(-1, OPEN)] * n, [(-1, OPEN)] * n
    for order, side in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[int, tuple[int, int]] = {}
        for i in order:
            zone = INSIDE if found[i].zone == INSIDE else PLAIN
            side[i] = last.get(zone, (-1, OPEN))
            if labels[i] != OPEN:
                last[zone] = (i, labels[i])
    for i, label in enumerate(labels):
        if label != OPEN:
            continue
        (p, left), (q, right) = before[i], after[i]
        inside = found[i].zone == INSIDE
        if found[i].heading:
            out[i] = right if right != OPEN else (GOOD if inside else BAD)
        elif left == right:
            out[i] = left if left != OPEN else (GOOD if inside else BAD)
        elif OPEN in (left, right):  # the page or the article ends on one side
            only = left + right
            out[i] = only if inside or only == BAD else (GOOD if len(found[i].text) >= SHORT // 2 else BAD)
        else:
            out[i] = left if i - p < q - i else right if q - i < i - p else GOOD
    return out


def classify(found: list[Block]) -> list[int]:
    """GOOD or BAD for each block, by the two passes."""
    labels = second_pass(found, first_pass(found))
    if GOOD not in labels and any(b.zone == OUT and b.bare == INSIDE for b in found):
        for b in found:
            b.zone = INSIDE if b.bare == INSIDE else OUT
        labels = second_pass(found, first_pass(found))
    return labels


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    return "\n".join(b.text for b, label in zip(found, classify(found)) if label == GOOD)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, common.schema_with(pages, "page_id", "url", text="string", n_chars="long"))
