"""One pass over the markup of a page: cards and areas are closed as their elements are.

A reader keeps a stack of open elements and hands out what an area holds when it ends, so a page of
any length costs one visit per element and text, and only what the rules need leaves Python. All
rules about texts and links are native expressions over the small rows that come out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from lotwise.functions.batches import slices

# Elements without content or end tag, and elements whose start ends a paragraph.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ENDS_P = {"p", "div", "ul", "ol", "li", "article", "section", "h1", "h2", "h3", "h4", "table", "form", "header", "footer", "nav"}
INLINE = ("b", "i", "em", "strong", "span", "a")
# Elements that carry no text of the page, further ones that a detail page hides, and
# areas of sellers and payments by their name.
HIDDEN = {"script", "style", "noscript"}
HIDDEN_IN_DETAILS = HIDDEN | {"svg", "form", "button"}
PRIVATE_AREA = re.compile("seller|contact|financing|payment", re.IGNORECASE)
SELLER_TYPE = "seller-type"


class Elements(HTMLParser):
    """Elements as they open and close: ``enter`` gives a frame, ``leave`` gets it back."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, object]] = []
        self.tags: Counter[str] = Counter()

    def enter(self, tag: str, attrs: dict[str, str]) -> object:
        raise NotImplementedError

    def leave(self, frame: object) -> None:
        raise NotImplementedError

    def close_to(self, depth: int) -> None:
        while len(self.open) > depth:
            tag, frame = self.open.pop()
            self.tags[tag] -= 1
            self.leave(frame)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ENDS_P and self.tags["p"]:
            depth = len(self.open) - 1
            while self.open[depth][0] in INLINE:
                depth -= 1
            if self.open[depth][0] == "p":
                self.close_to(depth)
        own: dict[str, str] = {}
        for key, value in attrs:
            own.setdefault(key, value or "")
        frame = self.enter(tag, own)
        if tag in VOID:
            self.leave(frame)
        else:
            self.open.append((tag, frame))
            self.tags[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.close_to(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if not self.tags[tag]:
            return
        depth = len(self.open) - 1
        while self.open[depth][0] != tag:
            depth -= 1
        self.close_to(depth)

    def read(self, html: str | None):
        self.feed(html or "")
        self.close()
        self.close_to(0)
        return self


@dataclass(frozen=True)
class CardShape:
    """Which elements are cards and which elements inside a card have their text kept.

    A kept text comes with a key: ``tag:``, ``name:``, ``param:`` or ``field:`` and what matched.
    """

    card_tag: str | None = None
    card_name: str | None = None
    tags: frozenset[str] = frozenset()
    names: frozenset[str] = frozenset()
    params: frozenset[str] = frozenset()
    fields: frozenset[str] = frozenset()
    heading: frozenset[str] = frozenset()
    name_attr: str = "data-testid"
    field_attr: str = "data-field"


class CardReader(Elements):
    """Cards of a page, each with texts, links, images, times and kept texts in document order."""

    def __init__(self, shape: CardShape) -> None:
        super().__init__()
        self.shape = shape
        self.hidden = 0
        self.found: list[dict] = []
        self.inside: list[dict] = []  # cards that are open
        self.kept: list[list[str]] = []  # texts that are being collected

    def _keys(self, tag: str, attrs: dict[str, str]) -> Iterator[str]:
        s = self.shape
        if tag in s.tags:
            yield f"tag:{tag}"
        for kind, wanted, value in (("name", s.names, attrs.get(s.name_attr)), ("param", s.params, attrs.get("data-parameter")), ("field", s.fields, attrs.get(s.field_attr))):
            if value in wanted:
                yield f"{kind}:{value}"

    def enter(self, tag: str, attrs: dict[str, str]) -> object:
        if tag in HIDDEN or self.hidden:
            self.hidden += 1
            return None
        s, card = self.shape, None
        if tag == s.card_tag or (s.card_name is not None and attrs.get(s.name_attr) == s.card_name):
            card = {"card_index": len(self.found), "texts": [], "links": [], "images": [], "times": [], "kept": [], "heading": None}
            self.found.append(card)
            self.inside.append(card)
        held = 0
        if self.inside:
            for key in self._keys(tag, attrs):
                parts: list[str] = []
                self.kept.append(parts)
                held += 1
                for own in self.inside:
                    own["kept"].append((key, parts))
            heading = tag in s.heading
            for own in self.inside:
                if heading and own["heading"] is None:
                    own["heading"] = True
                    heading_of = own
                else:
                    heading_of = None
                if tag == "a":
                    own["links"].append({"href": attrs.get("href"), "heading": own["heading"] is True})
                elif tag == "img":
                    own["images"].append(attrs.get("src"))
                elif tag == "time":
                    own["times"].append(attrs.get("datetime"))
        else:
            heading_of = None
        return card, held, heading_of

    def leave(self, frame: object) -> None:
        if frame is None:
            self.hidden -= 1
            return
        card, held, heading_of = frame
        if held:
            del self.kept[-held:]
        if heading_of is not None:
            heading_of["heading"] = False  # over; later headings don't count
        if card is not None:
            self.inside.pop()

    def handle_data(self, data: str) -> None:
        if self.hidden or not self.inside or not data.strip():
            return
        for card in self.inside:
            card["texts"].append(data)
        for parts in self.kept:
            parts.append(data)


_LINK = pa.struct([("href", pa.string()), ("heading", pa.bool_())])
_KEPT = pa.struct([("key", pa.string()), ("text", pa.string())])
_STRINGS = pa.list_(pa.string())
_CARD = "card_index int, texts array<string>, links array<struct<href:string,heading:boolean>>, images array<string>, times array<string>, kept array<struct<key:string,text:string>>"


def read_cards(pages: DataFrame, shape: CardShape, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per card; nothing is shuffled, and only the cards leave the reader."""
    source = pages.select(key, html)
    kind = source.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, 1)):
            at, cards = [], []
            for row, text in enumerate(part.column(1)):
                for card in CardReader(shape).read(text.as_py()).found:
                    at.append(row)
                    cards.append(card | {"kept": [{"key": k, "text": " ".join(parts)} for k, parts in card["kept"]]})
            kinds = {"card_index": pa.int32(), "texts": _STRINGS, "links": pa.list_(_LINK), "images": _STRINGS, "times": _STRINGS, "kept": pa.list_(_KEPT)}
            columns = [part.column(0).take(pa.array(at, pa.int64())), *[pa.array([c[n] for c in cards], k) for n, k in kinds.items()]]
            yield pa.RecordBatch.from_arrays(columns, [key, *kinds])

    return source.mapInArrow(read, f"`{key}` {kind}, {_CARD}")


@dataclass(frozen=True)
class DetailShape:
    """Names of the areas of a detail page."""

    details: str = "combined-details-and-equipment-section"
    description: str = "content-description-section"
    seller: str = "content-seller-area-section"
    name_attr: str = "data-testid"


class DetailReader(Elements):
    """Labelled pairs, seller words, dates and the declared address of a detail page.

    A pair is an element with exactly two paragraphs inside, of which the first is its grandchild and
    lies in the details area. An element passes the first three paragraphs inside it on to its
    parent when it closes, so none is looked at again.
    """

    def __init__(self, shape: DetailShape) -> None:
        super().__init__()
        self.shape = shape
        self.hidden = 0  # open elements that a detail page hides
        self.unread = 0  # of those, and elsewhere, the ones whose text is never read
        self.areas: Counter[str] = Counter()
        self.seen: set[str] = set()
        self.collecting: list[list[str]] = []
        self.pairs: list[tuple[int, str, str]] = []
        self.order = 0
        self.seller_named: list[str] | None = None
        self.seller_words: list[list[str]] = []
        self.dates: list[str | None] = []
        self.paragraphs: list[list[str]] = []
        self.canonical: str | None = None

    def enter(self, tag: str, attrs: dict[str, str]) -> object:
        s, name = self.shape, attrs.get(self.shape.name_attr, "")
        hides = tag in HIDDEN_IN_DETAILS or (name != SELLER_TYPE and PRIVATE_AREA.search(name) is not None)
        unread = tag in HIDDEN or tag in ("form", "svg")
        frame = {"hides": hides, "unread": unread, "area": None, "held": 0, "paragraphs": [], "own": None}
        self.hidden += hides
        self.unread += unread
        if tag == "link" and attrs.get("rel") == "canonical" and self.canonical is None and not self.unread:
            self.canonical = attrs.get("href")
        if name in (s.details, s.description, s.seller) and name not in self.seen and not self.unread and (not self.hidden or name == s.seller):
            self.seen.add(name)
            frame["area"] = name
            self.areas[name] += 1
        if not self.unread and self.areas[s.seller] and tag in ("p", "span"):
            self.seller_words.append(self._collect(frame))
        if self.hidden:
            return frame
        if name == SELLER_TYPE and self.seller_named is None:
            self.seller_named = self._collect(frame)
        if tag == "time" and self.areas[s.description]:
            self.dates.append(attrs.get("datetime"))
        if tag == "p":
            self.order += 1
            text = self._collect(frame)
            holder = self.open[-2][1] if len(self.open) > 1 else None
            frame["own"] = (self.order, text, holder if self.areas[s.details] else None)
            if self.areas[s.description]:
                self.paragraphs.append(text)
        return frame

    def _collect(self, frame: dict) -> list[str]:
        parts: list[str] = []
        self.collecting.append(parts)
        frame["held"] += 1
        return parts

    def leave(self, frame: object) -> None:
        if frame["held"]:
            del self.collecting[-frame["held"] :]
        if frame["area"] is not None:
            self.areas[frame["area"]] -= 1
        self.hidden -= frame["hides"]
        self.unread -= frame["unread"]
        inside = frame["paragraphs"]
        if len(inside) == 2 and inside[0][2] is frame:
            self.pairs.append((inside[0][0], " ".join(inside[0][1]), " ".join(inside[1][1])))
        if frame["own"] is not None:
            inside = [frame["own"], *inside]
        # A void element is closed before it is put on the stack; its parent is the top then, too.
        if inside and self.open:
            above = self.open[-1][1]["paragraphs"]
            above += inside[: 3 - len(above)]

    def handle_data(self, data: str) -> None:
        if data.strip() and not self.unread:
            for parts in self.collecting:
                parts.append(data)


_DETAIL = {
    "pairs": pa.list_(pa.struct([("label", pa.string()), ("value", pa.string())])),
    "seller_named": pa.string(),
    "seller_words": _STRINGS,
    "dates": _STRINGS,
    "paragraphs": _STRINGS,
    "canonical": pa.string(),
}


def read_details(pages: DataFrame, shape: DetailShape = DetailShape(), key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per detail page: pairs, seller_named, seller_words, dates, paragraphs, canonical."""
    source = pages.select(key, html)
    kind = source.schema[key].dataType.simpleString()

    def row(text: str | None) -> dict:
        found = DetailReader(shape).read(text)
        return {
            "pairs": [{"label": label, "value": value} for _, label, value in sorted(found.pairs, key=lambda p: p[0])],
            "seller_named": None if found.seller_named is None else " ".join(found.seller_named),
            "seller_words": [" ".join(p) for p in found.seller_words],
            "dates": found.dates,
            "paragraphs": [" ".join(p) for p in found.paragraphs],
            "canonical": found.canonical,
        }

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, 1)):
            rows = [row(text.as_py()) for text in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([r[n] for r in rows], k) for n, k in _DETAIL.items()]], [key, *_DETAIL])

    return source.mapInArrow(
        read,
        f"`{key}` {kind}, pairs array<struct<label:string,value:string>>, seller_named string, seller_words array<string>, "
        "dates array<string>, paragraphs array<string>, canonical string",
    )
