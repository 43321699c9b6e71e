"""Pages: text, listing cards, detail facts, page classes, audits.

Only the reading of markup runs in Python, batch by batch over the partitions: cards and labelled
details in one pass (``reading``), whole pages as a node array (:func:`page_nodes`). Every rule about
what was read is a native expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from html import escape, unescape
from html.parser import HTMLParser
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions import facts as X
from lotwise.functions.batches import slices
from lotwise.functions.numbers import is_price_text
from lotwise.functions.text import drop_location_notes, normalize_ws, unescape_embedded, unescape_string
from lotwise.functions.urls import canonical_url, safe_image_url, safe_page_path
from lotwise.sources.reading import SELLER_TYPE, VOID, CardShape, DetailShape, Elements, read_cards, read_details

NODE = (
    "struct<seq:int,last:int,parent:int,tag:string,name:string,field:string,param:string,label:string,"
    "href:string,src:string,content:string,property:string,type:string,id:string,datetime:string,text:string>"
)
NODES = f"array<{NODE}>"
_NUMBERS = ("seq", "last", "parent")
_TEXTS = ("tag", "name", "field", "param", "label", "href", "src", "content", "property", "type", "id", "datetime", "text")
_NODE_LIST = pa.list_(pa.struct([(n, pa.int32()) for n in _NUMBERS] + [(n, pa.string()) for n in _TEXTS]))


class _NodeReader(Elements):
    """Flat list of elements and texts; ``last`` is the highest seq inside an element."""

    def __init__(self, name_attr: str, field_attr: str) -> None:
        super().__init__()
        self.name_attr, self.field_attr = name_attr, field_attr
        self.nodes: list[dict] = []

    def _add(self, tag: str, **values) -> dict:
        node = {"seq": len(self.nodes), "parent": self.open[-1][1]["seq"] if self.open else -1, "tag": tag, **values}
        node["last"] = node["seq"]
        self.nodes.append(node)
        return node

    def enter(self, tag: str, attrs: dict[str, str]) -> dict:
        return self._add(
            tag,
            name=attrs.get(self.name_attr),
            field=attrs.get(self.field_attr),
            param=attrs.get("data-parameter"),
            label=attrs.get("aria-label"),
            href=attrs.get("href"),
            src=attrs.get("src"),
            content=attrs.get("content"),
            property=attrs.get("property", attrs.get("name")),
            type=attrs.get("type", attrs.get("rel")),
            id=attrs.get("id"),
            datetime=attrs.get("datetime"),
        )

    def leave(self, node: dict) -> None:
        node["last"] = len(self.nodes) - 1

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._add("#text", text=data)


def page_nodes(pages: DataFrame, key: str = "page_id", html: str = "html", name_attr: str = "data-testid", field_attr: str = "data-field") -> DataFrame:
    """One row per page: key and ``nodes``. Nothing is shuffled or gathered."""
    source = pages.select(key, html)
    kind = source.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, 1)):
            rows = []
            for text in part.column(1).to_pylist():
                rows.append(_NodeReader(name_attr, field_attr).read(text).nodes)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, _NODE_LIST)], [key, "nodes"])

    return source.mapInArrow(read, f"{key} {kind}, nodes {NODES}")


def _within(nodes: Column, node: Column) -> Column:
    return F.filter(nodes, lambda n: (n["seq"] >= node["seq"]) & (n["seq"] <= node["last"]))


def visible(nodes: Column, private: bool = True) -> Column:
    """Drop scripts, styles and what is inside them.

    Without ``private`` also pictures, forms, buttons and the areas of sellers, contact, financing
    and payment.
    """

    def hides(n: Column) -> Column:
        plain = n["tag"].isin("script", "style", "noscript")
        if private:
            return plain
        area = (F.coalesce(n["name"], F.lit("")) != "seller-type") & F.coalesce(n["name"], F.lit("")).rlike("(?iu)seller|contact|financing|payment")
        return plain | n["tag"].isin("svg", "form", "button") | area

    def shown(hidden: Column) -> Column:
        return F.filter(
            nodes, lambda n: ~F.exists(hidden, lambda h: (n["seq"] >= h["seq"]) & (n["seq"] <= h["last"]))
        )

    # Bound once: named inside the lambda, the hidden nodes would be looked up for every node.
    return X.let(F.filter(nodes, hides), shown)


def text_of(nodes: Column, node: Column) -> Column:
    """Collapsed text inside a node."""
    inside = F.filter(
        nodes, lambda n: (n["tag"] == "#text") & (n["seq"] >= node["seq"]) & (n["seq"] <= node["last"])
    )
    return normalize_ws(F.array_join(F.transform(inside, lambda n: n["text"]), " "))


def leaf_texts(nodes: Column) -> Column:
    """Collapsed texts in document order."""
    texts = F.transform(F.filter(nodes, lambda n: n["tag"] == "#text"), lambda n: normalize_ws(n["text"]))
    return F.filter(texts, lambda t: t != "")


# Markup that carries no visible text, and entities of plain text.
HIDDEN_MARKUP = (
    r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<!--.*?-->|<!doctype[^>]*>"
)
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def page_text(html: Column) -> Column:
    """Visible text of markup, by native expressions only."""
    bare = F.regexp_replace(F.regexp_replace(html, HIDDEN_MARKUP, " "), r"(?s)<[^>]*>", " ")
    for entity, char in ENTITIES:
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return normalize_ws(bare)


def page_links(html: Column) -> Column:
    """Targets of all links."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\b[^>]*?\bhref="([^"]*)"'), F.lit(1))


def contract_gate(df: DataFrame, html: str, attribute: str, version: int) -> DataFrame:
    """Keep pages that declare the supported layout version, or none."""
    declared = F.regexp_extract(html, f'(?i)\\b{re.escape(attribute)}="([^"]*)"', 1)
    return df.filter((declared == "") | (declared == str(version)))


# Wording of pages that hold results back.
BLOCKED = (
    "(?iu)request blocked|403 error|access denied|too many requests|verify you are human|verifique que [ée] humano"
    "|inicie sess[aã]o para continuar|log in to continue"
)


def is_blocked(html: Column) -> Column:
    """Challenge wording in the visible text, or a password field in the markup."""
    return page_text(html).rlike(BLOCKED) | html.rlike(r'(?i)<input\b[^>]*\btype="password"')


# Ordered page rules: kind, scope, URL parts, wordings.
PAGE_RULES = [
    ("checkpoint", "browser", ["/checkpoint/"], ["security checkpoint", "confirma a tua identidade", "checkpoint required"]),
    (
        "login_required",
        "browser",
        ["/login"],
        ["log in to facebook", "inicia sessão no facebook", "email or phone", "e-mail ou telemóvel"],
    ),
    (
        "marketplace_restricted",
        "browser",
        [],
        [
            "marketplace isn't available to you",
            "marketplace is not available to you",
            "não podes aceder ao marketplace",
            "marketplace não está disponível",
        ],
    ),
    (
        "consent_required",
        "browser",
        [],
        ["allow the use of cookies", "cookies on facebook", "permitir a utilização de cookies", "aceitar todos os cookies"],
    ),
    (
        "rate_limited",
        "source",
        [],
        [
            "you're temporarily blocked",
            "you are temporarily blocked",
            "too many requests",
            "try again later",
            "temporariamente bloqueado",
            "demasiados pedidos",
        ],
    ),
    (
        "empty_results",
        "search",
        [],
        ["no listings found", "there are currently no products", "nenhum anúncio encontrado", "não há anúncios"],
    ),
    ("partial_load", "search", [], ["something went wrong", "error loading", "alguma coisa correu mal", "erro ao carregar"]),
]


def classify_page(url: Column, text: Column, cards: Column | None = None, loading: Column | None = None, unchanged: Column | None = None) -> Column:
    """struct(kind, scope) of a failed page; null for a usable one. The first rule that fits wins."""
    where, words = F.lower(url), F.lower(text)
    cards = F.lit(None).cast("int") if cards is None else cards
    loading = F.lit(False) if loading is None else loading
    unchanged = F.lit(0) if unchanged is None else unchanged
    stalled = F.coalesce((cards == 0) & (unchanged >= 2), F.lit(False))
    choice = F.when(
        stalled & (loading | F.contains(where, F.lit("/marketplace/"))),
        F.struct(F.lit("partial_load").alias("kind"), F.lit("search").alias("scope")),
    )
    for kind, scope, parts, wordings in reversed(PAGE_RULES):
        hit = F.lit(False)
        for part in parts:
            hit = hit | F.contains(where, F.lit(part))
        for wording in wordings:
            hit = hit | F.contains(words, F.lit(wording))
        choice = F.when(hit, F.struct(F.lit(kind).alias("kind"), F.lit(scope).alias("scope"))).otherwise(choice)
    return choice


# What a stored page must not contain.
FORBIDDEN = [
    (r"(?iu)<script\b", "scripts"),
    (r"(?iu)<form\b", "forms"),
    (r"(?iu)\b(?:cookie|access_token|session_key|fb_dtsg)\b", "session data"),
    (r"(?iu)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "email address"),
    (r"(?iu)(?:tel:|mailto:|/profile\.php|/people/)", "contact or profile link"),
    (r"(?:\+351\s*)?(?:2[0-9]{8}|9[0-9]{8})\b", "Portuguese phone number"),
    (r"(?iu)reviewed:\s*pending", "pending manual review"),
    (r"REVIEW REQUIRED", "unreviewed inferred field"),
]


def privacy_audit(df: DataFrame, html: str = "html", approved: list[str] | None = None) -> DataFrame:
    """Add findings (labels of forbidden content) and unapproved external links."""
    found = F.array_compact(F.array(*[F.when(F.col(html).rlike(p), F.lit(label)) for p, label in FORBIDDEN]))
    links = F.regexp_extract_all(html, F.lit(r'(?i)(?:href|src)="(https?:[^"#]+)"'), F.lit(1))
    rules = approved or []
    unapproved = links
    if rules:
        unapproved = F.filter(links, lambda u: ~u.rlike("|".join(f"(?:{r})" for r in rules)))
    return df.withColumns({"findings": found, "unapproved_links": unapproved})


@dataclass(frozen=True)
class CardRules:
    """Where cards and their parts are found. All of it differs per marketplace."""

    card_name: str = "item-card"
    host: str = r"^(?:www\.)?market\.example$"
    path: str = r"^/item/([0-9]+)(?:/|$)"
    build: str | None = "https://www.market.example/item/{id}/"
    base: str = "https://www.market.example"
    image_host: str = r"."
    price_name: str = "ad-price"


def _first(values: Column) -> Column:
    return F.get(values, F.lit(0))


def _kept(*keys: str) -> Column:
    """Collapsed texts kept under any of the keys, in document order."""
    found = F.filter(F.col("kept"), lambda x: x["key"].isin(*keys))
    return F.transform(found, lambda x: normalize_ws(x["text"]))


def _filled(texts: Column) -> Column:
    return F.filter(texts, lambda t: t != "")


def extract_cards(pages: DataFrame, rules: CardRules = CardRules(), key: str = "page_id") -> DataFrame:
    """Cards with labelled fields; shown text fills fields that carry no label.

    ``pages`` has the key and ``html``. One row per card with ``reasons`` (empty for accepted cards)
    and ``repeated`` for a listing already seen on the page.
    """
    shape = CardShape(card_name=rules.card_name, fields=frozenset({"description", "price", "title", "location", "fact"}))
    cards = read_cards(pages, shape, key)
    links = F.transform("links", lambda x: canonical_url(x["href"], rules.host, rules.path, rules.build, rules.base))
    cards = cards.withColumns(
        {
            "link": _first(F.filter(links, lambda u: u.isNotNull())),
            "texts": F.array_distinct(_filled(F.transform("texts", normalize_ws))),
            "description": _first(_filled(_kept("field:description"))),
            "_price": _first(_filled(_kept("field:price"))),
            "_title": _first(_filled(_kept("field:title"))),
            "_place": _first(_filled(_kept("field:location"))),
            "_facts": _filled(_kept("field:fact")),
            "_image": _first(F.array_compact("images")),
        }
    )
    texts = F.col("texts")
    cards = cards.withColumn("displayed_price", F.coalesce("_price", _first(F.filter(texts, is_price_text))))

    # Known values are removed as whole elements: a derived column named inside a lambda would be
    # worked out again for every element.
    def without(values: Column, known: Column) -> Column:
        return F.when(known.isNull(), values).otherwise(F.array_remove(values, known))

    other = F.filter(
        without(texts, F.col("displayed_price")),
        lambda t: ~is_price_text(t) & ~t.rlike("(?iu)^(?:sponsored|patrocinado|save|guardar)$"),
    )
    cards = cards.withColumn("title", F.coalesce("_title", _first(other)))
    after = F.slice(texts, F.greatest(F.array_position(texts, F.col("title")) + 1, F.lit(1)).cast("int"), F.greatest(F.size(texts), F.lit(1)))
    place = F.filter(
        without(after, F.col("displayed_price")),
        lambda t: ~t.rlike(r"(?iu)^(?:\d[\d., ]*\s*(?:km|mi)|diesel|petrol|gasolina|manual|automatic|automático)$"),
    )
    cards = cards.withColumn("location", F.coalesce("_place", _first(place)))
    cards = cards.withColumn(
        "card_facts", F.array_distinct(F.concat(F.col("_facts"), F.array_compact(F.array("displayed_price", "title", "location"))))
    )
    first = [
        F.when(F.col("link").isNull(), F.lit("a canonical item URL is required")),
        F.when(F.col("title").isNull(), F.lit("a non-empty listing title is required")),
        F.when(F.length("title") > 1000, F.lit("listing title exceeds 1000 characters")),
        F.when(F.length("displayed_price") > 200, F.lit("displayed price exceeds 200 characters")),
        F.when(F.length("description") > 20_000, F.lit("listing description exceeds 20000 characters")),
    ]
    later = (
        F.when(F.length("location") > 500, F.lit("listing location exceeds 500 characters"))
        .when(F.exists("card_facts", lambda f: F.length(f) > 1000), F.lit("a card fact exceeds 1000 characters"))
        .when(
            X.any_contact_data(F.array_compact(F.array_append("card_facts", F.col("description")))),
            F.lit("seller identity or contact data is not accepted"),
        )
    )
    cards = cards.withColumn("_first", F.array_compact(F.array(*first)))
    cards = cards.withColumn(
        "reasons", F.when(F.size("_first") > 0, F.col("_first")).otherwise(F.array_compact(F.array(later)))
    )
    image = safe_image_url(F.col("_image"), rules.image_host)
    shaped = cards.select(
        key,
        "card_index",
        F.col("link.id").alias("source_listing_id"),
        F.col("link.url").alias("url"),
        "title",
        "displayed_price",
        "location",
        "description",
        image.alias("thumbnail_url"),
        "card_facts",
        "reasons",
    )
    return mark_repeats(shaped, key)


def mark_repeats(cards: DataFrame, key: str) -> DataFrame:
    """Add repeated: an accepted card whose listing already had an accepted card on the page.

    A window and not a filter, since a filter on the reasons would pull all the rules behind them
    down into one expression. Its partitions hold the cards of one listing on one page.
    """
    accepted = F.size("reasons") == 0
    same = Window.partitionBy(key, "source_listing_id")
    return cards.withColumn("_first", F.min(F.when(accepted, F.col("card_index"))).over(same)).withColumn(
        "repeated", F.coalesce(accepted & (F.col("card_index") > F.col("_first")), F.lit(False))
    ).drop("_first")


# Fixed value: a price that stands alone.
_PLAIN_PRICE = r"^[\d\s.,]+(?:\s*(?:EUR|€))?$"


def extract_articles(pages: DataFrame, rules: CardRules = CardRules(), key: str = "page_id") -> DataFrame:
    """Article cards: heading link, euro price, parameter facts, seller, warranty, import, date.

    ``pages`` has the key and ``html``."""
    fields = {
        "location": ("location", "ad-location"),
        "description": ("description", "ad-description"),
        "_seller": (SELLER_TYPE, "seller_type"),
        "_warranty": ("warranty",),
        "_import": ("imported", "country_origin"),
    }
    parameters = ("mileage", "fuel_type", "gearbox", "first_registration_year")
    wanted = frozenset(n for names in fields.values() for n in names)
    shape = CardShape(
        card_tag="article", tags=frozenset({"h1", "h2", "h3"}), names=wanted | {rules.price_name}, params=wanted | set(parameters), heading=frozenset({"h1", "h2"})
    )
    cards = read_cards(pages, shape, key)
    inside = F.filter("links", lambda x: x["heading"])
    links = F.transform(inside, lambda x: canonical_url(x["href"], rules.host, rules.path, rules.build, rules.base))
    plain = F.filter(_kept("tag:h3"), lambda t: t.rlike(_PLAIN_PRICE))
    price = F.coalesce(_first(_kept(f"name:{rules.price_name}")), _first(plain))

    def field(names: tuple[str, ...]) -> Column:
        def told(text: Column) -> Column:
            ok = (text != "") & ~text.rlike(r"(?iu)https?://|www\.") & ~X.contains_contact_data(text)
            return F.when(ok, text)

        return X.let(_first(_kept(*[f"{kind}:{n}" for n in names for kind in ("name", "param")])), told)

    time = _first(F.col("times"))
    images = F.transform("images", lambda x: safe_image_url(x, rules.image_host))
    cards = cards.withColumns(
        {
            "link": _first(F.filter(links, lambda u: u.isNotNull())),
            "title": _first(_kept("tag:h1", "tag:h2")),
            "_price": price,
            "_has_price": price.isNotNull(),
            "_euro": F.exists("texts", lambda t: normalize_ws(t).rlike("^(?:EUR|€)$")),
            "_facts": _filled(_kept(*[f"param:{n}" for n in parameters])),
            **{name: field(names) for name, names in fields.items()},
            "_posted": F.when(time.rlike(r"^\d{4}-\d{2}-\d{2}(?:T.*)?$"), F.try_to_timestamp(time)),
            "thumbnail_url": _first(F.filter(images, lambda u: u.isNotNull())),
        }
    )
    price = F.col("_price")
    marked = price.rlike("EUR|€")
    shown = F.when(
        F.col("_has_price") & (F.length(price) <= 200) & price.rlike(_PLAIN_PRICE) & (marked | F.col("_euro")),
        F.when(marked, F.regexp_replace(price, "EUR", "€")).otherwise(F.concat(price, F.lit(" €"))),
    )
    seller = F.when(F.col("_seller").rlike("(?i)^(?:profissional|dealer)$"), F.lit("dealer")).when(
        F.col("_seller").rlike("(?i)^(?:particular|private)$"), F.lit("private")
    )
    cards = cards.withColumns(
        {
            "displayed_price": shown,
            "seller_type": seller,
            "warranty": X.explicit_indicator(F.col("_warranty"), r"garantia|warranty|\d+\s*(?:meses|months)"),
            "imported": X.explicit_indicator(F.col("_import"), "importad[oa]|imported"),
        }
    )
    origin = (
        F.when(F.col("imported"), F.lit("Importado"))
        .when(~F.col("imported"), F.lit("Nacional"))
        .otherwise(F.concat(F.lit("Origin: "), F.col("_import")))
    )
    iso = F.date_format("_posted", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    card_facts = F.concat(
        F.col("_facts"),
        F.array_compact(
            F.array(
                F.when(F.col("seller_type") == "dealer", F.lit("Profissional")).when(F.col("seller_type") == "private", F.lit("Particular")),
                F.concat(F.lit("Warranty: "), F.col("_warranty")),
                F.when(F.col("_import").isNotNull(), origin),
                F.concat(F.lit("Posted: "), iso),
            )
        ),
    )
    cards = cards.withColumn("card_facts", card_facts)
    bad = F.col("link").isNull() | F.coalesce(F.col("title") == "", F.lit(True)) | (F.length("title") > 1000)
    private = X.any_contact_data(F.array_compact(F.concat(F.array("title", "description"), F.col("card_facts"))))
    reasons = F.array_compact(
        F.array(
            F.when(bad, F.lit("a heading with a listing link is required")).when(
                private, F.lit("seller identity or contact data is not accepted")
            )
        )
    )
    shaped = cards.select(
        key,
        "card_index",
        F.col("link.id").alias("source_listing_id"),
        F.col("link.url").alias("url"),
        "title",
        "displayed_price",
        "location",
        "description",
        "thumbnail_url",
        "seller_type",
        "warranty",
        "imported",
        F.col("_posted").alias("posted_at"),
        "card_facts",
        reasons.alias("reasons"),
    )
    return mark_repeats(shaped, key)


def card_counts(cards: DataFrame, key: str = "page_id") -> DataFrame:
    """Recognised, rejected, repeated and accepted cards per page."""
    return cards.groupBy(key).agg(
        F.count("*").alias("recognized"),
        F.count_if(F.size("reasons") > 0).alias("rejected"),
        F.count_if(F.col("repeated")).alias("repeated"),
        F.count_if((F.size("reasons") == 0) & ~F.col("repeated")).alias("accepted"),
    )


# Detail labels and the key each stands for.
DETAIL_LABELS = {
    "Marca": "make",
    "Modelo": "model",
    "Versão": "variant",
    "Ano": "year",
    "Quilómetros": "mileage",
    "Combustível": "fuel",
    "Tipo de Caixa": "transmission",
    "Potência": "power",
    "Garantia de Stand (incl. no preço)": "warranty",
    "Garantia": "warranty",
    "Inspeção válida até": "inspection",
    "Inspecção válida até": "inspection",
    "Origem": "origin",
    "Anunciante": "seller",
}


def section(nodes: Column, name: str) -> Column:
    """Nodes inside the first element of this name."""
    return _within(nodes, _first(F.filter(nodes, lambda n: n["name"] == name)))


def _with_pairs(read: DataFrame) -> DataFrame:
    """Add ``_pairs`` (different keys and cleaned values) and ``conflict`` to read detail pages."""
    labels = F.create_map(*[F.lit(x) for pair in DETAIL_LABELS.items() for x in pair])

    def named(p: Column) -> Column:
        found = F.struct(F.try_element_at(labels, normalize_ws(p["label"])).alias("key"), X.clean_allowlisted(p["value"], 200).alias("value"))
        return X.let(found, lambda f: F.when(f["key"].isNotNull() & f["value"].isNotNull(), f))

    df = read.withColumn("_pairs", F.array_distinct(F.array_compact(F.transform("pairs", named))))
    keys = F.transform("_pairs", lambda p: p["key"])
    return df.withColumn("conflict", F.size(F.array_distinct(keys)) < F.size(keys))


def extract_labelled_pairs(pages: DataFrame, section_name: str = DetailShape.details, key: str = "page_id") -> DataFrame:
    """Label and value paragraphs of a detail section: ``details`` map and ``conflict``.

    ``pages`` has the key and ``html``. A label counts when its pair of wrappers holds exactly two
    paragraphs, the label first. Two different values for one key reject the page.
    """
    df = _with_pairs(read_details(pages, DetailShape(details=section_name), key))
    return df.select(
        key,
        F.map_from_entries(F.when(~F.col("conflict"), F.col("_pairs"))).alias("details"),
        "conflict",
    )


# Wording of a published date, of sellers and of where a vehicle was first registered.
PUBLISHED = r"(?iU)^\d{1,2} de [\p{L}]+ de \d{4}(?: às \d{2}:\d{2})?$"
DEALER, PRIVATE = "(?i)^(?:profissional|dealer)$", "(?i)^(?:particular|private)$"
NATIONAL, IMPORTED = "(?i)^nacional$", "(?i)^importad[oa]$"


def detail_facts(pages: DataFrame, reference_year: Column, shape: DetailShape = DetailShape(), key: str = "page_id", url: str | None = None) -> DataFrame:
    """Typed facts of detail pages: vehicle, seller, origin, warranty, inspection, date, identity.

    ``pages`` has the key, ``html`` and, where ``url`` names it, the address the page was asked for.
    A page whose fields disagree keeps ``conflict`` and no facts; ``same_page`` is false where the
    page declares another address than that, and null where it declares none.
    """
    df = _with_pairs(read_details(pages, shape, key)).withColumn("_map", F.map_from_entries(F.when(~F.col("conflict"), F.col("_pairs"))))

    def get(name: str) -> Column:
        return F.try_element_at("_map", F.lit(name))

    def fact(name: str, extract, kind: str) -> Column:
        return X.let(get(name), lambda t: extract(t).cast(kind))

    coarse = _first(F.filter(F.transform("seller_words", normalize_ws), lambda t: t.rlike("(?i)^(?:Profissional|Particular)$")))
    seller = F.coalesce(get("seller"), normalize_ws(F.col("seller_named")), coarse)
    posted = _first(F.col("dates"))
    published = _first(F.filter(F.transform("paragraphs", normalize_ws), lambda t: t.rlike(PUBLISHED)))
    named = X.make_model_variant(F.concat_ws(" ", get("make"), F.coalesce(get("model"), F.lit(""))))
    known = ~F.col("conflict")
    out = df.select(
        key,
        "conflict",
        F.when(get("make").isNotNull(), F.coalesce(named["make"], get("make"))).alias("make"),
        get("model").alias("model"),
        get("variant").alias("variant"),
        fact("year", lambda t: F.when(t.rlike(r"^\d{4}$"), X.year_in(t, reference_year)), "int").alias("year"),
        fact("mileage", X.distance_in, "bigint").alias("mileage"),
        X.first_pattern(get("fuel"), X.FUEL_RULES)["value"].alias("fuel"),
        X.first_pattern(get("transmission"), X.GEARBOX_RULES)["value"].alias("gearbox"),
        fact("power", X.power_in, "int").alias("power_hp"),
        F.when(known & seller.rlike(DEALER), F.lit("dealer")).when(known & seller.rlike(PRIVATE), F.lit("private")).alias("seller_type"),
        F.when(get("origin").rlike(NATIONAL), F.lit(False)).when(get("origin").rlike(IMPORTED), F.lit(True)).alias("imported"),
        get("warranty").alias("warranty"),
        get("inspection").alias("inspection"),
        F.when(known, F.when(posted.rlike(r"^\d{4}-\d{2}-\d{2}(?:T.*)?$") & F.try_to_timestamp(posted).isNotNull(), posted).otherwise(published)).alias("posted"),
        "canonical",
    )
    if url is None:
        return out
    asked = pages.select(key, F.col(url).alias("_asked"))
    plain = lambda c: F.regexp_extract(c, r"^[^?#]*", 0)
    # Addresses are as many as pages, whatever the size of the files they are made from suggests.
    return out.join(asked.hint("merge"), key).withColumn("same_page", plain(F.col("canonical")) == plain(F.col("_asked"))).drop("_asked")


def extract_equipment(nodes: Column, section_name: str = "content-equipments-section") -> Column:
    """Distinct cleaned paragraphs of the equipment section."""

    def listed(inside: Column) -> Column:
        paragraphs = F.filter(
            inside,
            lambda p: (p["tag"] == "p")
            & ~F.exists(inside, lambda b: (b["tag"] == "button") & (b["seq"] >= p["seq"]) & (b["seq"] <= p["last"])),
        )
        cleaned = F.transform(paragraphs, lambda p: X.clean_allowlisted(text_of(inside, p), 200))
        return F.array_distinct(F.array_compact(cleaned))

    return X.let(X.let(visible(nodes), lambda v: section(v, section_name)), listed)


# Fixed value: headings over a description.
_DESCRIPTION_HEADING = (
    "(?iu)^(?:description|seller(?:'s|’s)? description|description du vendeur|descri[cç][aã]o(?: do vendedor)?"
    "|descripci[oó]n(?: del vendedor)?)$"
)


def script_text(nodes: Column) -> Column:
    """All script text of a page, unquoted."""

    def joined(scripts: Column) -> Column:
        texts = F.filter(nodes, lambda n: (n["tag"] == "#text") & F.array_contains(scripts, n["parent"]))
        return F.array_join(F.transform(texts, lambda n: n["text"]), "\n")

    scripts = F.transform(F.filter(nodes, lambda n: n["tag"] == "script"), lambda n: n["seq"])
    return unescape_embedded(X.let(scripts, joined))


_STRING = "\"((?:\\\\.|[^\"\\\\])*)\""


def description_candidates(nodes: Column) -> Column:
    """All texts that may be the description, in document order of their kind, without notes that a
    shown location is approximate."""
    told = lambda n: (n["tag"] != "#text") | (F.size(drop_location_notes(F.array(n["text"]))) > 0)
    return X.let(F.filter(visible(nodes), told), lambda v: _descriptions(nodes, v))


def _descriptions(nodes: Column, v: Column) -> Column:
    labelled = F.filter(
        v,
        lambda n: (n["field"] == "description")
        | n["name"].rlike("(?iu)(?:^|[-_:])description(?:$|[-_:])")
        | n["label"].rlike("(?iu)\\bdescription\\b|descri[cç][aã]o|descripci[oó]n"),
    )
    meta = F.filter(nodes, lambda n: (n["tag"] == "meta") & n["property"].rlike("(?i)^(?:og:description|description)$"))
    headings = F.filter(v, lambda n: (n["tag"] != "#text") & text_of(v, n).rlike(_DESCRIPTION_HEADING))
    following = F.flatten(
        F.transform(
            headings,
            lambda h: F.slice(
                F.filter(v, lambda n: (n["parent"] == h["parent"]) & (n["seq"] > h["last"])), 1, 2
            ),
        )
    )
    described = F.regexp_extract_all(script_text(nodes), F.lit("(?i)[\"']description[\"']\\s*:\\s*" + _STRING), F.lit(1))
    texts = F.concat(
        F.transform(labelled, lambda n: text_of(v, n)),
        F.transform(meta, lambda n: n["content"]),
        F.transform(described, unescape_string),
        F.transform(following, lambda n: text_of(v, n)),
    )
    return F.filter(F.transform(texts, normalize_ws), lambda t: t != "")


def extract_detail_description(nodes: Column) -> Column:
    """Longest candidate, when it is free of contact data."""
    longest = F.aggregate(
        description_candidates(nodes),
        F.lit("").cast("string"),
        lambda best, t: F.when(F.length(t) > F.length(best), t).otherwise(best),
    )
    return X.let(
        longest, lambda t: F.when((t != "") & ~X.contains_contact_data(t), t)
    )


# Elements a sanitised page keeps, and elements dropped with their content.
SAFE_TAGS = {
    "html", "body", "main", "section", "article", "div", "span", "a", "img",
    "h1", "h2", "h3", "h4", "p", "ul", "ol", "li", "button", "header", "footer", "nav",
}
OMITTED_TAGS = {"script", "style", "svg", "form", "input", "textarea", "meta", "link"}


class _Skeleton(HTMLParser):
    """Markup without text: allowed elements with a few allowed attributes."""

    def __init__(self, item_path: str, depth: int | None = None, nodes: int | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.item_path = re.compile(item_path)
        self.out: list[str] = []
        self.open: list[tuple[str, bool]] = []
        self.depth, self.left = depth, nodes

    def handle_starttag(self, tag: str, attrs: list) -> None:
        hidden = bool(self.open and self.open[-1][1]) or tag in OMITTED_TAGS
        if self.depth is not None:
            hidden = hidden or len(self.open) > self.depth
        if self.left is not None:
            hidden = hidden or self.left <= 0
            self.left -= 1
        if not hidden and tag in SAFE_TAGS:
            kept = []
            for key, value in attrs:
                value = value or ""
                if key in ("role", "data-testid", "aria-busy") and re.fullmatch(r"[a-zA-Z0-9_-]{1,100}", value):
                    kept.append(f' {key}="{escape(value)}"')
                if key == "href" and (hit := self.item_path.search(value)):
                    kept.append(f' data-marketplace-item="{hit.group(1)}"')
            self.out.append(f"<{tag}{''.join(kept)}>" + (f"</{tag}>" if tag in VOID else ""))
        if tag not in VOID:
            self.open.append((tag, hidden))

    def handle_endtag(self, tag: str) -> None:
        if tag not in [t for t, _ in self.open]:
            return
        while self.open:
            name, hidden = self.open.pop()
            if not hidden and name in SAFE_TAGS:
                self.out.append(f"</{name}>")
            if name == tag:
                return


def structural_sanitize(
    pages: DataFrame, kind: str, detail: str, item_path: str, key: str = "page_id", depth: int | None = None, nodes: int | None = None
) -> DataFrame:
    """Text-free skeleton of each page under a header with its failure kind and redacted path.

    ``depth`` and ``nodes`` cut what lies deeper or comes later, if given.
    """
    source = pages.select(key, "html", safe_page_path(F.col("url")).alias("path"))
    key_type = source.schema[key].dataType.simpleString()

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for html, path in zip(batch["html"], batch["path"]):
                reader = _Skeleton(item_path, depth, nodes)
                reader.feed(html or "")
                reader.close()
                for name, hidden in reversed(reader.open):
                    if not hidden and name in SAFE_TAGS:
                        reader.out.append(f"</{name}>")
                head = f'<header data-diagnostic="{escape(kind)}" data-page-path="{escape(unescape(path))}"><p>{escape(detail)}</p></header>'
                rows.append(f"<!doctype html><html><body>{head}{''.join(reader.out)}</body></html>")
            yield pd.DataFrame({key: batch[key], "sanitized": rows})

    return source.mapInPandas(render, f"{key} {key_type}, sanitized string")
