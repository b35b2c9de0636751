"""HTML of landed pages: native expressions for the common case, the standard parser where structure counts."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.text import normalize_text, once
from jobloom.functions.urls import network_key
from jobloom.operators.cleaning import dedupe_by_url, first_per_key

_DROPPED = r"(?is)<(script|style|svg|head|noscript)\b[^>]*>.*?</\1\s*>|<!--.*?-->"
#: Longest reduced page.
MOST_CHARS = 120_000
_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCK_TAGS = frozenset(
    "address article aside blockquote div dl dd dt fieldset footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th ul".split()
)
#: Elements that a tag ends where they have no end tag, and those beyond which it does not look.
_IMPLIED = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "table"})), "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist", "optgroup"})), "tr": (frozenset({"tr"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})), "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
} | {tag: (frozenset({"p"}), _BLOCK_TAGS - {"p"}) for tag in _BLOCK_TAGS - {"li", "dt", "dd", "td", "th"}}
# Tags whose text stands apart from what is around it, where texts are mined.
BLOCKS = ["li", "p", "div", "br", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "tr"]
# Texts of links that name no posting, without accents.
CALLS = ["megnezem", "reszletek", "tovabb", "bovebben", "jelentkezem", "jelentkezes", "apply", "details", "view", "open", "more"]
# What encloses one posting of a list.
CARDS = "app-job-list-item, article, li, .job-list-item, .job, .position, .listing, .card, .item"
LINKED_CARDS = (
    "app-job-list-item, article, li, .job, .job-list-item, .position, .listing, .card, .item, .vacancy, .vacancies__item,"
    " [data-href], [data-url], [onclick], [role='link'], [routerlink]"
)
HEADINGS = "h1, h2, h3, h4, h5, h6"
#: The shortest title of a candidate.
LEAST_TITLE = 4
#: Ancestors of a heading that may hold its link.
MOST_ANCESTORS = 8
#: Pages whose rows are put together at once.
PAGES_AT_ONCE = 64

_MEDIA = re.compile(r"\.(?:jpe?g|png|gif|svg|webp|pdf|zip|rar|7z)(?:[?#]|$)", re.IGNORECASE)
_SIMPLE = re.compile(r"""[.#]?[\w-]+|\[([\w:-]+)(?:([*$^]?=)["']?([^"'\]]*)["']?)?\]""")


def reduced(html: Column) -> Column:
    """html without scripts, styles, drawings, head and comments, white space collapsed, cut to MOST_CHARS."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(html, _DROPPED, " "), r"\s+", " ")), 1, MOST_CHARS)


def decoded(s: Column) -> Column:
    """s with its commonest named entities and all numeric ones as characters; what is no character is U+FFFD."""

    def char(part: Column) -> Column:
        hexadecimal = F.regexp_extract(part, "^[xX]([0-9a-fA-F]+);", 1)
        code = F.when(hexadecimal != "", F.conv(hexadecimal, 16, 10)).otherwise(F.regexp_extract(part, "^([0-9]+);", 1)).cast("long")
        fine = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        # a space in place of what is not decoded, as all branches of a code point's bytes must be valid
        bytes_ = F.unhex(F.lpad(F.hex(F.when(fine, code).otherwise(0x20)), 8, F.lit("0")))
        return F.concat(F.when(fine, F.decode(bytes_, "UTF-32")).otherwise(F.lit("\ufffd")), F.regexp_replace(part, "^[^;]*;", ""))

    def whole(parts: Column) -> Column:
        return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), char), ""))

    out = once(s, lambda x: F.when(x.contains("&#"), once(F.split(x, "&#(?=(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});)", -1), whole)).otherwise(x))
    for entity, char_ in _ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char_))
    return out


def text_of(html: Column) -> Column:
    """Text of html: every tag is a space, entities are decoded."""
    out = decoded(F.regexp_replace(F.regexp_replace(html, _DROPPED, " "), r"<[^>]*>", " "))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def padded_text(html: Column) -> Column:
    """Text of html as it is mined: only BLOCKS stand apart, so a word with a tag inside stays one."""
    apart = F.regexp_replace(F.regexp_replace(html, _DROPPED, " "), rf"(?i)</?(?:{'|'.join(BLOCKS)})\b[^>]*>", " ")
    return F.trim(F.regexp_replace(decoded(F.regexp_replace(apart, r"<[^>]*>", "")), r"[\s\x{a0}]+", " "))


def attribute(html: Column, tag: str, name: str) -> Column:
    """The decoded value of an attribute of the first such tag that has it in quotes; null if none has."""
    start = rf"(?is)<{tag}\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*?\s{name}\s*=\s*"
    value = lambda quote: F.when(html.rlike(f"{start}{quote}"), F.regexp_extract(html, f"{start}{quote}([^{quote}]*){quote}", 1))
    return decoded(F.coalesce(value('"'), value("'")))


def anchors(html: Column) -> Column:
    """href of each anchor, in order."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\b[^>]*?\shref="([^"]*)"'), F.lit(1))


class _Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: _Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        #: What a script or style holds, which is no text.
        self.code = ""

    def _raw(self, padded: bool, without: frozenset[int]) -> Iterator[str]:
        waiting = self.children[::-1]
        while waiting:
            c = waiting.pop()
            if isinstance(c, str):
                yield c
            elif id(c) not in without:
                edge = [" "] if padded and c.tag in BLOCKS else []
                waiting += [*edge, *reversed(c.children), *edge]

    def text(self, padded: bool = False, without: frozenset[int] = frozenset()) -> str:
        """White space as one space; padded: blocks stand apart. Nodes whose id is in without are passed over."""
        return " ".join("".join(self._raw(padded, without)).split())

    def walk(self) -> Iterator[_Node]:
        waiting = self.children[::-1]
        while waiting:
            c = waiting.pop()
            if isinstance(c, _Node):
                yield c
                waiting += reversed(c.children)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def _end_implied(self, tag):
        """Closes an element that this tag ends without an end tag of its own: an item by the next one, a paragraph by a block."""
        ended, beyond = _IMPLIED.get(tag, (frozenset(), frozenset()))
        at = self.at if ended else self.root
        while at.parent and at.tag not in beyond:
            if at.tag in ended:
                self.at = at.parent
                return
            at = at.parent

    def handle_starttag(self, tag, attrs):
        self._end_implied(tag)
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data):
        if self.at.tag not in ("script", "style"):
            self.at.children.append(data)
        else:
            self.at.code += data


def parsed(html: str | None) -> _Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


class _Simple(NamedTuple):
    """One simple selector, and how its node is to lie under that of the one before: ' ' at any depth, '>' right in it."""

    under: str
    tag: str
    id: str
    classes: tuple[str, ...]
    attributes: tuple[tuple[str, str, str], ...]

    def fits(self, node: _Node) -> bool:
        if self.tag and node.tag != self.tag or self.id and node.attrs.get("id") != self.id:
            return False
        if self.classes and not set(self.classes) <= set(node.attrs.get("class", "").split()):
            return False
        for name, how, wanted in self.attributes:
            value = node.attrs.get(name)
            if value is None or how and not getattr(value, _TESTS[how])(wanted):
                return False
        return True


_TESTS = {"=": "__eq__", "*=": "__contains__", "$=": "endswith", "^=": "startswith"}


def _simple(under: str, said: str) -> _Simple:
    """tag or *, .class, #id, [attr] and [attr=value] (also *=, $= and ^=), in one simple selector such as a.card[href]."""
    tag, id_, classes, attributes, at = "", "", [], [], 0
    if said.startswith("*"):
        said = said[1:] or "[]"
    for part in _SIMPLE.finditer(said):
        if part.start() != at or part.start() and part[0][0] not in ".#[":
            break
        at = part.end()
        if part[1]:
            attributes.append((part[1], part[2] or "", part[3] or ""))
        elif part[0][0] == ".":
            classes.append(part[0][1:])
        elif part[0][0] == "#":
            id_ = part[0][1:]
        else:
            tag = part[0].lower()
    if said != "[]" and (at != len(said) or not said):
        raise ValueError(f"not a selector that is known here: {said}")
    return _Simple(under, tag, id_, tuple(classes), tuple(attributes))


@lru_cache(maxsize=1024)
def _chains(selector: str) -> tuple[tuple[_Simple, ...], ...]:
    """The selectors between commas, each of simple ones from left to right; ValueError for what they do not hold (+, ~ and :pseudo)."""
    chains = []
    # commas, spaces and > in brackets are values
    for one in re.split(r",(?![^\[\]]*\])", selector):
        words = re.split(r"\s+(?![^\[\]]*\])", re.sub(r">(?![^\[\]]*\])", " > ", one).strip())
        unders = [" ", *(">" if a == ">" else " " for a in words[:-1])]
        if words[0] == ">" or words[-1] == ">" or (">", ">") in zip(words, words[1:], strict=False):
            raise ValueError(f"not a selector that is known here: {one}")
        chains.append(tuple(_simple(under, word) for under, word in zip(unders, words, strict=True) if word != ">"))
    return tuple(chains)


def _fits_chain(node: _Node, parts: tuple[_Simple, ...]) -> bool:
    if not parts[-1].fits(node):
        return False
    if len(parts) == 1:
        return True
    above = node.parent
    while above is not None:
        if _fits_chain(above, parts[:-1]):
            return True
        if parts[-1].under == ">":
            return False
        above = above.parent
    return False


def select(root: _Node, selector: str) -> list[_Node]:
    """Nodes under root that fit one of the selectors between commas, each of simple ones, right in (>) or anywhere under the one before; in their order."""
    chains = _chains(selector)
    return [node for node in root.walk() if any(_fits_chain(node, parts) for parts in chains)]


def closest(node: _Node, selector: str) -> _Node | None:
    """node, or the nearest of its ancestors that fits."""
    chains, at = _chains(selector), node
    while at is not None and not any(_fits_chain(at, parts) for parts in chains):
        at = at.parent
    return at


def first_text(node: _Node | None, selector: str) -> str:
    """Text of the first node under node that fits; '' without any."""
    return next((x.text() for x in select(node, selector)), "") if node else ""


def _value(card: _Node, spec: str, base: str) -> str | None:
    selector, _, attribute = spec.partition("@")
    found = select(card, selector)[:1] if selector else [card]
    if not found:
        return None
    if not attribute:
        return found[0].text() or None
    value = found[0].attrs.get(attribute)
    return urljoin(base, value) if value and attribute in ("href", "src") else value


def page_rows(pages: DataFrame, of: Callable[[_Node, str], Iterator[tuple]], columns: str) -> DataFrame:
    """page_id, seq (from 0 in each page) and the string columns that `of` yields for each page's tree and url.

    Defined cases: a null or empty html has no rows, a null url is ''; broken markup is read as far as it
    goes; pages of one page_id are read each; other columns of pages are ignored.
    """
    names = ["page_id", "seq", *columns.split()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, PAGES_AT_ONCE):
                batch = whole.slice(first, PAGES_AT_ONCE)
                rows = [(page, seq, *row) for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True) for seq, row in enumerate(of(parsed(html), url or ""))]
                values = zip(*rows, strict=True) if rows else [()] * len(names)
                arrays = [pa.array(v, pa.int64() if k < 2 else pa.string()) for k, v in enumerate(values)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = ", ".join(f"{n} {'long' if k < 2 else 'string'}" for k, n in enumerate(names))
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(read, schema)


def run_recipe(pages: DataFrame, recipe: dict[str, str]) -> DataFrame:
    """Candidate rows of pages (page_id, url, html) by a recipe: card, title, url, and maybe company and location.

    A spec is a selector, or selector@attribute. Cards without title or url give no row.
    """
    spec = json.dumps(recipe)

    def of(root: _Node, base: str) -> Iterator[tuple]:
        wanted = json.loads(spec)
        for card in select(root, wanted["card"]):
            got = [_value(card, wanted[k], base) if k in wanted else None for k in ("title", "url", "company", "location")]
            if got[0] and got[1]:
                yield tuple(got)

    return page_rows(pages, of, "title url company location")


def _is_call(title: str) -> bool:
    plain = "".join(c for c in unicodedata.normalize("NFD", title.lower()) if not unicodedata.combining(c))
    return len(plain) < LEAST_TITLE or plain in CALLS


def _absolute(href: str | None, base: str) -> str | None:
    """href as a whole http(s) URL, null for media and for what is none."""
    try:
        url = urljoin(base, href or "")
    except ValueError:
        return None
    return url if href and re.match("https?://", url, re.IGNORECASE) and not _MEDIA.search(url) else None


def _company(card: _Node) -> str | None:
    """The company that a card's logo names, else the one in the link to its postings."""
    for logo in select(card, "img[alt*=karrier]")[:1]:
        name = re.sub(r"\s*karrier,?\s*állás\s*és\s*munka\s*$", "", " ".join(logo.attrs["alt"].split()), flags=re.IGNORECASE).strip()
        if name:
            return name
    for link in select(card, "a[href*=/allasok/][href*=',0,0,0,0,0,0,0,0,0,']"):
        slug = re.search("/allasok/([^/]+)/", link.attrs["href"])
        return slug[1].replace("-", " ").strip() if slug else None
    return None


def _description(card: _Node) -> str | None:
    return (first_text(card, "p") or first_text(card, ".description, .job-desc, .job-description"))[:800] or None


def _of_links(root: _Node, base: str) -> Iterator[tuple]:
    for link in select(root, "a[href]"):
        url, said = _absolute(link.attrs["href"], base), link.text()
        if not url:
            continue
        card = closest(link, CARDS) or closest(link, "div") or _Node("", {}, None)
        heading = first_text(card, HEADINGS) or first_text(link.parent, HEADINGS)
        title = heading if heading and (_is_call(said) or len(heading) > len(said) + 3) else said
        if len(title) >= LEAST_TITLE:
            company = _company(card)
            yield title[:300], url, _description(card), company and company[:200], first_text(card, "[id$=-details-location]") or None


def link_candidates(pages: DataFrame) -> DataFrame:
    """A candidate for each link of a page; the heading of its card stands in for a call to act and for a much shorter text.

    Of links with one canonical url the page's first counts.
    """
    return dedupe_by_url(page_rows(pages, _of_links, "title url description company location"), by=["page_id"])


def _card_link(card: _Node) -> str | None:
    """Where a card leads: its own attributes, the place that its handler sets, else its first link."""
    for name in ("data-href", "data-url", "routerlink"):
        if card.attrs.get(name):
            return card.attrs[name]
    handler = card.attrs.get("onclick", "")
    place = re.search(r"""(?:location\.href|window\.location)\s*=\s*['"]([^'"]+)['"]""", handler, re.IGNORECASE) or re.search(r"""['"]([^'"]+)['"]""", handler)
    return place[1] if place else next((a.attrs["href"] for a in select(card, "a[href]")), None)


def _of_cards(root: _Node, base: str) -> Iterator[tuple]:
    for card in select(root, LINKED_CARDS):
        url = _absolute(_card_link(card), base)
        title = first_text(card, HEADINGS) or first_text(card, ".title, .job-title, .position-title, .name") or first_text(card, "strong")
        if len(title) < LEAST_TITLE:
            said = first_text(card, "a[href]")
            title = title if _is_call(said) else said
        if url and not _is_call(title):
            yield title[:300], url, _description(card)


def card_candidates(pages: DataFrame) -> DataFrame:
    """A candidate for each card of a page that leads somewhere, by link, attribute or handler; the first of each canonical url."""
    return dedupe_by_url(page_rows(pages, _of_cards, "title url description"), by=["page_id"])


def heading_candidates(pages: DataFrame, link: str, company: str) -> DataFrame:
    """A candidate for each h2 with a link (selector) under one of its nearest ancestors, and the company (selector) found so."""

    def of(root: _Node, base: str) -> Iterator[tuple]:
        for heading in select(root, "h2"):
            at, href, name = heading.parent, None, None
            for _ in range(MOST_ANCESTORS):
                if at is None or href and name:
                    break
                href = href or next((x.attrs.get("href") for x in select(at, link)), None)
                name = name or first_text(at, company) or None
                at = at.parent
            url = _absolute(href, base)
            if url and heading.text():
                yield heading.text(), url, name

    return dedupe_by_url(page_rows(pages, of, "title url company"), by=["page_id"])


def search_cards(pages: DataFrame) -> DataFrame:
    """Cards of a guest search: title, url, company, location; a card without a place has all its text as one."""

    def of(root: _Node, base: str) -> Iterator[tuple]:
        for card in select(root, "ul.jobs-search__results-list li"):
            names = ("h3.base-search-card__title", "h4.base-search-card__subtitle", "span.job-search-card__location")
            title, company, place = (first_text(card, x) for x in names)
            url = next((x.attrs.get("href") for x in select(card, "a.base-card__full-link")), None)
            if title and url:
                yield title, url, company, place or card.text()

    found = page_rows(pages, of, "title url company location")
    plain = found.withColumns({c: normalize_text(F.col(c)) for c in ("title", "company", "location")})
    return first_per_key(plain.withColumn("_key", network_key(F.col("url"))), ["page_id", "_key"], ["seq"]).drop("_key")


def scoped_texts(pages: DataFrame, scope: str, without: str | None = None) -> DataFrame:
    """page_id, scoped (text of the first node that fits scope, '' without any) and body of each page, as they are mined.

    What fits `without` counts in neither: cards of other postings, say.
    """

    def of(root: _Node, base: str) -> Iterator[tuple]:
        gone = {id(x) for x in select(root, without)} if without else set()
        gone |= {id(x) for x in select(root, "script, style, noscript, head")}
        kept = frozenset(gone)
        first = next((x for x in select(root, scope) if id(x) not in kept), None)
        yield first.text(True, kept) if first else "", root.text(True, kept)

    return page_rows(pages, of, "scoped body").drop("seq")
